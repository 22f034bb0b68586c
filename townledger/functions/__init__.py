"""Column expressions: text, dates, rules, addresses and HTML."""

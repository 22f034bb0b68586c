import random

from townledger.llm import licences
from townledger.llm.common import prepare


def plain_best(matcher, run):
    grams = licences.bigrams(run)
    scores = [(-licences.dice(grams, b), name, k) for _, name, k, b in matcher.known if licences.dice(grams, b) >= matcher.threshold - 1e-9]
    return min(scores, default=None) if grams else None


def plain_scan(matcher, text):
    rows = [licences.words(x) for x in text.split("\n")]
    found = []
    for i in range(len(rows)):
        for k in range(i, min(i + licences.SPAN, len(rows))):
            touched = [any(g in matcher.by_bigram for g in zip(rows[x], rows[x][1:])) for x in (i, k)]
            best = plain_best(matcher, sum(rows[i:k + 1], []))
            if best and all(touched):
                found.append((best[0], k - i + 1, i, best[1]))
    out, used = [], set()
    for score, n, i, name in sorted(found):
        if not used & set(range(i, i + n)):
            used |= set(range(i, i + n))
            out.append((name, i, n, round(-score, 6)))
    return sorted(out, key=lambda x: x[1])


def test_against_brute_force():
    m, rng = licences.Matcher(), random.Random(1)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(1, 7)):
            w = rng.choice(notices).split() if rng.random() < 0.5 else [rng.choice("the of work license version free a b c d".split()) for _ in range(rng.randint(0, 15))]
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["x", "the", "License"])
            cut = rng.randint(0, len(w))
            lines.append(" ".join(w[:cut]) + rng.choice(["\n", " "]) + " ".join(w[cut:]))
        text = "\n".join(lines)
        assert m.scan(text) == plain_scan(m, text)


def test_table(spark):
    prepare(spark)
    rows = [(1, "Words.\nReleased under the MIT License.\nMore words here."), (2, None), (None, ""), (2, None), (3, "word " * 50000 + "\nAll rights reserved.")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS notices")).collect()
    assert len(got) == 5
    by = {r.doc_id: [(n.licence, n.line) for n in r.notices] for r in got}
    assert by == {1: [("mit", 1)], 2: [], None: [], 3: [("all-rights-reserved", 1)]}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_find(matcher, text):
    """All stretches of words against all templates, best first."""
    rows = [licences.words(x) for x in text.split("\n")]
    w, at = sum(rows, []), [i for i, x in enumerate(rows) for _ in x]
    found = []
    for i in range(len(w)):
        for j in range(i + 2, len(w) + 1):
            best = plain_best(matcher, w[i:j])
            if best:
                found.append((best[0], j - i, i, best[1]))
    out, used = [], set()
    for score, n, i, name in sorted(found):
        if not used & set(range(i, i + n)):
            used |= set(range(i, i + n))
            out.append((i, (name, at[i], at[i + n - 1] - at[i] + 1, round(-score, 6))))
    return [x for _, x in sorted(out)]


def test_stretches_of_words_against_brute_force():
    rng = random.Random(4)
    few = {"a": ("All rights reserved.", "one two three one two four"), "b": ("Released under the MIT License.",), "c": ("This work is licensed under the licence of this work and the work.",)}
    m, notices = licences.Matcher(templates=few), [t for ts in few.values() for t in ts]
    n = 0
    for _ in range(400):
        w = []
        for _ in range(rng.randint(1, 6)):
            part = rng.choice(notices).split() if rng.random() < 0.7 else [rng.choice("the of work licensed all rights one two".split()) for _ in range(rng.randint(0, 8))]
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice(["x", "the", "work"])
            w += part[rng.randint(0, 1):]
        text = "".join(x + rng.choice([" ", " ", "\n", "\n\n"]) for x in w)
        assert m.find(text) == plain_find(m, text)
        n += len(m.find(text))
    assert n > 400


def test_notices_in_long_lines_narrow_columns_and_whole_texts(spark):
    prepare(spark)
    texts = licences.whole_texts()
    grant = licences.TEMPLATES["mit"][1]
    rows = [(1, "Some long paragraph of other words. " * 40 + "Released under the MIT License. " + "And it goes on without a break. " * 40),
            (2, "\n\n".join(grant.split())), (3, "x\n" + "\n".join(" ".join(grant.split()[i:i + 3]) for i in range(0, 90, 3)))]
    rows += [(10 + i, "Foreword of ours. " + texts[x].replace("\n", " ") + " And after it.") for i, x in enumerate(licences.WHOLE)]
    got = {r.doc_id: [(n.licence, n.line, n.dice) for n in r.notices] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x[:2] for x in got[1] + got[2] + got[3]] == [("mit", 0), ("mit", 0), ("mit", 1)]
    assert [got[10 + i] for i in range(len(licences.WHOLE))] == [[(x, 0, 1.0)] for x in licences.WHOLE]


def test_many_adjoining_notices():
    text = "All rights reserved. " * 20000
    assert len(licences.Matcher().find(text)) == 20000

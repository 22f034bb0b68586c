"""Which of many terms occur in which of many normalised texts, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import BROADCAST_ROWS, cut_lineage, fits, settled, small_side
from .names import NameFilter

FEW_TERMS = 256  # up to here the terms travel inside the expression
ANCHOR = 5       # letters of a term looked up among the words
HEAVY = 256      # a word in more than one of so many rows is joined without a shuffle


def _anchor(piece: Column) -> Column:
    return F.substring(piece, 1, ANCHOR)


def letter_runs(word: Column, n: int) -> Column:
    """All runs of ``n`` letters of a word."""
    runs = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
    return F.when(F.length(word) >= n, runs).otherwise(F.array().cast("array<string>"))


def match_terms(texts: DataFrame, terms: DataFrame, keep=(), few: int = FEW_TERMS) -> DataFrame:
    """Pairs (id, term) where the term is part of the text.

    ``texts`` has id and text (normalised), ``terms`` has term. Columns of ``texts`` named in
    ``keep`` are carried along. A handful of terms is tested in one pass over the texts; more are
    looked up by their first letters among the distinct words of all texts.
    """
    terms = terms.select("term").filter("term <> ''").distinct()
    if fits(terms, few):
        listed = sorted(r.term for r in terms.collect())
        if not listed:
            return texts.select("id", *keep, F.lit("").alias("term")).limit(0)
        array = F.array(*[F.lit(t) for t in listed])
        hits = F.filter(array, lambda t: F.contains(F.col("text"), t))
        return texts.select("id", *keep, F.explode(hits).alias("term"))
    return match_many_terms(texts, terms, keep)


def words_with(vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of ``vocabulary`` (word, …) beside every piece (piece) that lies in the word, by way of the piece's first letters."""
    keyed = pieces.select("piece").filter("piece <> ''").distinct().withColumn("gram", _anchor(F.col("piece")))
    lengths = sorted(r[0] for r in keyed.select(F.length("gram").alias("n")).distinct().collect())
    if not lengths:
        return vocabulary.withColumn("piece", F.lit("")).limit(0)
    grams = F.array_distinct(F.concat(*[letter_runs(F.col("word"), n) for n in lengths]))
    return vocabulary.withColumn("gram", F.explode(grams)).join(small_side(keyed), "gram").drop("gram").filter(F.contains("word", F.col("piece")))


def join_words(words: DataFrame, by_word: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``words`` (word, …) joined with ``by_word`` (word, n, …), n being how many rows of ``words`` hold the word.

    A small ``by_word`` is sent to all tasks. Of a larger one only the words that hold more than one in ``HEAVY`` rows are, of
    which there are ``HEAVY`` at most; the others go through a shuffle, in which no key is large and which a Bloom filter spares
    the words that are not in ``by_word``.
    """
    small = settled(by_word.drop("n"), rows)
    if rows and small.count() <= rows:
        return words.join(F.broadcast(small), "word")
    total = by_word.select("word", "n").distinct().agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    often = by_word.filter(heavy).drop("n")
    rest = words.join(F.broadcast(often.select("word").distinct()), "word", "left_anti")
    seldom = by_word.filter(~heavy).drop("n")
    rest = NameFilter(seldom.select("word").distinct(), ["word"]).keep(rest)
    return words.join(F.broadcast(often), "word").unionByName(rest.join(seldom, "word"))


def match_many_terms(texts: DataFrame, terms: DataFrame, keep=(), rows: int = BROADCAST_ROWS) -> DataFrame:
    """The general way: a term lies in a text exactly if its longest piece lies in one of the words.

    The words of all texts are counted once; those with a term in them join the texts again, frequent ones apart from rare
    ones. Terms of several words are checked against the whole text afterwards.
    """
    pieces = F.split("term", " ")
    longest = F.aggregate(pieces, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    keyed = terms.select("term", longest.alias("piece"))
    phrase = F.contains("term", F.lit(" "))
    known = keyed.agg(F.min(F.length("piece")).alias("shortest"), F.max(phrase).alias("phrases")).first()
    # a word shorter than every piece holds none
    long_enough = F.filter(tokens("text"), lambda w: F.length(w) >= (known.shortest or 1))
    words = texts.select("id", *keep, F.explode(F.array_distinct(long_enough)).alias("word"))
    vocabulary = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    by_word = cut_lineage(words_with(vocabulary, keyed).join(small_side(keyed), "piece").select("word", "term", "n").distinct())
    pairs = join_words(words, by_word, rows).select("id", *keep, "term").distinct()
    if not known.phrases:
        return pairs
    several = (pairs.filter(phrase).join(texts.select("id", "text"), "id")
               .filter(F.contains("text", F.col("term"))).select("id", *keep, "term"))
    return pairs.filter(~phrase).unionByName(several)

"""Phrase collocations from Rabin-Karp fingerprints of all word runs.

1. Texts are cut into words once and stored as chunks of at most about CHUNK words of one language: the chunk's own words and their
   numbers, with a mark between pieces.
2. Prefix polynomials give the fingerprint of every run of one or two words. Inside a chunk runs of one fingerprint are compared by
   their words. Fingerprints are dealt into ranges; per distinct run its fingerprint, count and a pointer to an occurrence (chunk,
   place) go to the range's task, those of a chunk and range together as one row.
3. Pointers of fingerprints that are frequent in all go back to their chunks. There runs of three and four words are counted alike, if all
   pairs of words in them are frequent; a run cannot occur more often than a part of it.
4. Chunks turn the pointers of frequent fingerprints into text: the sorted, compressed texts of a chunk and several ranges go as one
   row. Counts are summed by text, so phrases that share a fingerprint come apart.
No filter of frequent runs is sent to all tasks: a chunk gets back its own runs only, and the plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, Window

from .common import stored
from .shingles import window_hashes

LONGEST = 4
LEAST = 30
CHUNK = 600_000
# Words per range of fingerprints; a task counts one range.
RANGE = 1_000_000
# Ranges whose texts are summed in one task.
TEXT_RANGES = 8
# Languages gather until one has enough words for a chunk, or all of them as many as this many chunks.
GATHERED = 4
TOP = 2000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# A byte that UTF-8 never holds marks the end of a piece.
MARK = b"\xff"
_CUT = _LOWER.translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", MARK * 10))


class _Numbers(dict):
    """Number of every word in order of first sight; the mark is 0."""

    def __init__(self):
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in lower case (A-Z), with marks between pieces."""
    return text.encode().translate(_CUT).replace(MARK, b" \xff ").split() if text else []


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers as planes of bytes, low ones first; planes of small or sorted numbers compress well."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """(chunk, lang, n, words, ids): words of a chunk joined by a space, and the numbers of its tokens; a text is never cut inside a piece."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held: dict[str, int] = {}
        total = 0

        def done(langs: list[str]) -> pd.DataFrame:
            rows = []
            for lang in langs:
                numbers, lists = open_.pop(lang)
                del held[lang]
                ids = np.concatenate(lists)
                rows.append((lang, int((ids > 0).sum()), b" ".join(list(numbers)[1:]), packed(ids)))
            return pd.DataFrame(rows, columns=["lang", "n", "words", "ids"])

        for pdf in parts:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                found = tokens(text)
                if not found:
                    continue
                numbers, lists = open_.setdefault(lang, (_Numbers(), []))
                found.append(MARK)
                lists.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                held[lang] = held.get(lang, 0) + len(found)
                total += len(found)
                if held[lang] >= size or total >= GATHERED * size:  # the language with the most words goes, the others gather on
                    full = max(held, key=held.get)
                    total -= held[full]
                    yield done([full])
        if open_:
            yield done(list(open_))

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.mapInPandas(run, "lang string, n long, words binary, ids binary").filter("n > 0")
    return stored(rows.select(F.monotonically_increasing_id().alias("chunk"), "lang", "n", "words", "ids"), "chunks")


def run_fingerprints(ids: np.ndarray, words: bytes, lang: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of k tokens, and whether each run lies inside a piece."""
    of_word = np.array([0] + [xxhash.xxh3_64_intdigest(w) for w in words.split(b" ")], np.uint64)
    fp = window_hashes(of_word[ids] ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())), k, k)
    inside = np.ones(len(fp), bool)
    for j in range(k):
        inside &= ids[j:j + len(fp)] > 0
    return fp, inside


def distinct_runs(ids: np.ndarray, fp: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, count) of the distinct runs that start at the places; runs of one fingerprint are compared word by word."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(fp[at], kind="stable")
    at = at[order]
    f = fp[at]
    new = np.append(True, f[1:] != f[:-1])
    first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if any((ids[at + j] != ids[first + j]).any() for j in range(k)):  # different runs under one fingerprint
        order = np.lexsort((*[ids[at + j] for j in range(k)], f))
        at, f = at[order], f[order]
        new = np.append(True, np.any([f[1:] != f[:-1], *[ids[at[1:] + j] != ids[at[:-1] + j] for j in range(k)]], axis=0))
    starts = np.flatnonzero(new)
    return f[starts], at[starts], np.diff(np.append(starts, len(at)))


_RUNS = "part int, k int, chunk long, fps binary, places binary, counts binary"
_PLACES = "part int, chunk long, k int, places binary, counts binary"
_TEXTS = "part int, lang string, phrases binary, counts binary"


def _rows(chunk: int, k: int, parts: int, f: np.ndarray, place: np.ndarray, count: np.ndarray) -> list[tuple]:
    """One row per range of fingerprints: the runs of a chunk in the range, as planes of bytes. Of a fingerprint 48 bits are kept."""
    part = (((f >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
    return [(int(part[lo]), k, chunk, packed(f[lo:hi] >> np.uint64(16), 6), packed(place[lo:hi]), packed(count[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:])]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])


def _short_runs(all_chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, lang, words, data in zip(pdf["chunk"].tolist(), pdf["lang"], pdf["words"], pdf["ids"]):
                ids = unpacked(data)
                for k in (1, 2):
                    fp, inside = run_fingerprints(ids, words, lang, k)
                    yield _frame(_rows(chunk, k, parts, *distinct_runs(ids, fp, np.flatnonzero(inside), k)), _RUNS)

    return all_chunks.select("chunk", "lang", "words", "ids").mapInPandas(run, _RUNS)


def _frequent(runs: DataFrame, least: int) -> DataFrame:
    """Places per chunk of the runs whose fingerprint occurs ``least`` times in all. A range of fingerprints holds about RANGE runs."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, mine in pdf.groupby("k"):
            fps, places, counts = (np.concatenate([unpacked(x, n) for x in mine[c]]) for c, n in (("fps", 6), ("places", 4), ("counts", 4)))
            owner = np.repeat(np.arange(len(mine)), [len(x) // 4 for x in mine["places"]])
            _, which = np.unique(fps, return_inverse=True)
            often = np.flatnonzero(np.bincount(which, weights=counts)[which] >= least)
            edges = np.searchsorted(owner[often], np.arange(len(mine) + 1))
            for chunk, lo, hi in zip(mine["chunk"].tolist(), edges[:-1], edges[1:]):
                if lo < hi:
                    out.append((int(pdf["part"].iloc[0]), chunk, int(k), packed(places[often[lo:hi]]), packed(counts[often[lo:hi]])))
        return _frame(out, _PLACES)

    return runs.groupBy("part").applyInPandas(pick, _PLACES)


def _long_runs(all_chunks: DataFrame, short: DataFrame, parts: int) -> DataFrame:
    """Runs of three and more words whose pairs of words are all frequent."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, lang, words, data in zip(left["chunk"].tolist(), left["lang"], left["words"], left["ids"]):
            ids = unpacked(data)
            fp, inside = run_fingerprints(ids, words, lang, 2)
            known = np.unique(fp[np.concatenate([np.zeros(0, np.int64), *map(unpacked, right["places"])])])
            pair = inside & np.isin(fp, known)
            for k in range(3, LONGEST + 1):
                fp, _ = run_fingerprints(ids, words, lang, k)
                ok = np.logical_and.reduce([pair[j:j + len(fp)] for j in range(k - 1)])
                out += _rows(chunk, k, parts, *distinct_runs(ids, fp, np.flatnonzero(ok), k))
        return _frame(out, _RUNS)

    pairs = short.filter("k = 2").select("chunk", "places")
    return all_chunks.select("chunk", "lang", "words", "ids").groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInPandas(run, _RUNS)


def _texts(all_chunks: DataFrame, places: DataFrame) -> DataFrame:
    """What the pointers point to: a row per chunk and TEXT_RANGES ranges, with sorted phrases and their counts."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, squeeze = [], zstandard.ZstdCompressor().compress
        for lang, words, data in zip(left["lang"], left["words"], left["ids"]):
            ids, names = unpacked(data), [None, *words.split(b" ")]
            for part, mine in right.groupby(right["part"] // TEXT_RANGES):
                texts, counts = [], []
                for k, where, count in zip(mine["k"].tolist(), mine["places"], mine["counts"]):
                    at = unpacked(where)
                    texts += map(b" ".join, zip(*([names[i] for i in ids[at + j].tolist()] for j in range(k))))
                    counts.append(unpacked(count))
                order = sorted(range(len(texts)), key=texts.__getitem__)
                out.append((int(part), lang, squeeze(b"\n".join([texts[i] for i in order])), squeeze(packed(np.concatenate(counts)[order]))))
        return _frame(out, _TEXTS)

    return all_chunks.select("chunk", "lang", "words", "ids").groupBy("chunk").cogroup(places.groupBy("chunk")).applyInPandas(run, _TEXTS)


def _summed(texts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f) of the phrases that occur ``least`` times in all; a phrase has the same part in all chunks."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        totals: dict[str, dict[bytes, int]] = {}
        loosen = zstandard.ZstdDecompressor().decompress
        for lang, phrases, counts in zip(pdf["lang"], pdf["phrases"], pdf["counts"]):
            mine = totals.setdefault(lang, {})
            for phrase, n in zip(loosen(phrases).split(b"\n"), unpacked(loosen(counts)).tolist()):
                mine[phrase] = mine.get(phrase, 0) + n
        rows = [(lang, phrase.decode(), phrase.count(b" ") + 1, n) for lang, mine in totals.items() for phrase, n in mine.items() if n >= least]
        return pd.DataFrame(rows, columns=["lang", "phrase", "k", "f"])

    return texts.groupBy("part").applyInPandas(add, "lang string, phrase string, k int, f long")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all runs of one to four words that occur ``least`` times, (lang, n) number of words)."""
    all_chunks = chunks(docs, lang_col, text_col, size)
    words = all_chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = (words.agg(F.sum("n")).first()[0] or 0) // RANGE + 1
    short = stored(_frequent(_short_runs(all_chunks, parts), least), "short")
    long = _frequent(_long_runs(all_chunks, short, parts), least)
    found = stored(_summed(_texts(all_chunks, short.unionByName(long)), least), "phrases")
    return found, words


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, size: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of two to four words of each language.

    Texts are split at [.,;:!?] and U+000A to U+000D into pieces and those at spaces and tabs into words, A-Z in lower case; a null
    text has none, a null language is "und". n counts all words of the language, a, l and r the occurrences of the phrase and of
    its parts before and after a cut; the score floor(2000000 a / (l + r)) is the lowest of all cuts, at the first of several.
    Phrases that lie inside a longer frequent one with at least 80 % of their occurrences are dropped. Higher scores come first,
    then greater a, then the phrase by its bytes. Repeated rows count as often as they occur; ids are not needed; extra columns
    are not read; an empty table gives no rows.
    """
    found, words = frequent_phrases(docs, lang_col, text_col, least, size)
    phrases = found.filter("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    parts = F.expr("filter(flatten(transform(sequence(2, 3), m -> transform(sequence(1, greatest(k - m + 1, 1)), i -> IF(m < k, array_join(slice(w, i, m), ' '), null)))), x -> x is not null)")
    inside = phrases.filter("k > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    known = found.select("lang", "phrase", "f")
    cuts = phrases.select("lang", "phrase", "f", "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr("(cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    cuts = cuts.withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * 80))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda z: z <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
f AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE f >= 30),
u AS (SELECT lang, phrase, f AS a, k, ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * u.a) // (l.f + r.f) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut + 1:u.k], ' ')),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer
      FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest(range(2, 4)) AS m) WHERE k > m) GROUP BY ALL),
z AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
      FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * a),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""

"""Phrase mining against plain counting and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from townledger.llm import phrases
from townledger.llm.common import prepare

SCHEMA = "text string, lang string, doc_id long, phrase string, k int, chunk long, f long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in counts.items():
        kept = {p: n for p, n in c.items() if n >= least}
        found = []
        for p, a in kept.items():
            if len(p) == 1:
                continue
            score, cut = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            longer = [n for q, n in kept.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * n >= 80 * a for n in longer):
                found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, rank, p.decode(), -a, l, r, words[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(rng, n):
    made = ["new york city", "of the", "New\tYork", "a b c d e", "zz", "ä ö", "x\u0085y", "nul\x00l", "of the new", "q\x1cw"]
    return [(rng.choice([" ", ". ", "\n", "\r\n", "  "]).join(rng.choice(made) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(n)]


def test_against_counting(spark):
    prepare(spark)
    rows = texts(random.Random(1), 120) + [(None, "en"), ("", "fr"), (" .\t", "fr"), ("only once here", "fr"), ("word " * 40_000, "de"), ("a b c d e", "und"), ("a b c d e", "und")]
    df = spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], SCHEMA)
    for least, top, size in ((30, 2000, 10 ** 6), (5, 7, 50)):
        got = phrases.collocations(df.repartition(3), least=least, top=top, size=size)
        assert sorted(map(tuple, got.collect())) == plain(rows, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_colliding_fingerprints_come_apart(spark, monkeypatch):
    prepare(spark)
    rows = texts(random.Random(2), 60)
    df = spark.createDataFrame([(*r, 1, "p", 2, 3, 4) for r in rows], SCHEMA).repartition(4)

    def few(ids, words, lang, k):
        inside = np.ones(max(0, len(ids) - k + 1), bool)
        for j in range(k):
            inside &= ids[j:j + len(inside)] > 0
        return np.full(len(inside), k % 3, np.uint64), inside

    # one fingerprint for all runs of a length: the workers run this module's functions, so the pieces are called here
    got = Counter()
    for text, lang in rows:
        found = phrases.tokens(text)
        numbers = phrases._Numbers()
        ids = np.array([numbers[t] for t in found] or [0], np.int64)
        names = list(numbers)
        for k in (1, 2, 3):
            fp, inside = few(ids, b"", "", k)
            _, at, n = phrases.distinct_runs(ids, fp, np.flatnonzero(inside), k)
            for a, c in zip(at.tolist(), n.tolist()):
                got["und" if lang is None else lang, b" ".join(names[i] for i in ids[a:a + k]).decode()] += c
    want, _ = phrases.frequent_phrases(df, least=1)
    want = {(r.lang, r.phrase): r.f for r in want.filter("k < 4").collect()}
    assert dict(got) == want


def test_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    prepare(spark)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.SQL})").fetchall()
    assert want and sorted(map(tuple, phrases.collocations(spark.read.parquet(path)).collect())) == sorted(want)


def test_numbers_in_planes():
    ids = np.array([0, 1, 255, 256, 70_000, 2 ** 31], np.int64)
    assert phrases.unpacked(phrases.packed(ids)).tolist() == ids.tolist()
    assert phrases.unpacked(phrases.packed(ids * 1000, 6), 6).tolist() == (ids * 1000).tolist() and phrases.unpacked(b"").tolist() == []


def test_every_run_lies_in_one_range():
    f = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64) * np.uint64(2))
    f[0], f[-1] = 0, np.uint64((1 << 64) - 1)
    for parts in (1, 7, 300):
        rows = phrases._rows(9, 2, parts, f, np.arange(5000), np.ones(5000, np.int64))
        assert [r[0] for r in rows] == sorted({r[0] for r in rows}) and 0 <= rows[0][0] and rows[-1][0] < parts
        assert np.concatenate([phrases.unpacked(r[4]) for r in rows]).tolist() == list(range(5000))
        assert np.concatenate([phrases.unpacked(r[3], 6) for r in rows]).tolist() == (f >> np.uint64(16)).tolist()


def test_chunks_fill_up_in_every_language(spark):
    """Languages that take turns don't cut one another's chunks short; many languages together are bounded."""
    prepare(spark)
    rows = [("a b c d e f g h i j", f"l{i % 4}") for i in range(400)]
    got = phrases.chunks(spark.createDataFrame(rows, "text string, lang string").coalesce(1), size=220).collect()  # a text is ten words and a mark
    assert sorted((r.lang, r.n) for r in got) == [(f"l{i}", 200) for i in range(4) for _ in range(5)]
    rows = [("a b c d e f g h i j", f"l{i % 100}") for i in range(1000)]
    got = phrases.chunks(spark.createDataFrame(rows, "text string, lang string").coalesce(1), size=50).collect()
    assert sum(r.n for r in got) == 10_000 and all(r.n < 50 for r in got)


def test_texts_of_a_chunk_go_as_few_rows(spark):
    """One row per chunk and TEXT_RANGES ranges, not one per phrase; a phrase has one part in all chunks."""
    prepare(spark)
    rows = texts(random.Random(4), 80)
    chunks = phrases.chunks(spark.createDataFrame(rows, "text string, lang string").coalesce(2), size=10 ** 6)
    parts = 3 * phrases.TEXT_RANGES
    got = phrases._texts(chunks, phrases._frequent(phrases._short_runs(chunks, parts), 1))
    assert got.count() <= chunks.count() * 3 < phrases._summed(got, 1).count()
    found = phrases._summed(got, 1).groupBy("lang", "phrase").count()
    assert found.filter("count > 1").count() == 0

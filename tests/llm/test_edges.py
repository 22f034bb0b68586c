"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator on documents."""

import hashlib
import random

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from townledger.llm import bpe, exact, mixing, near, quality, substring
from townledger.llm.common import prepare

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, _row int, _id int, _maybe boolean, sha string, copy int, label string"


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 3) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    a, b, long = words(rng, 80), words(rng, 60), words(rng, 6000)
    near_a = a.split()
    near_a[3] = "other"
    rows = [(1, a), (2, a.upper()), (2, a.upper()), (3, a.replace(" ", "\n")), (4, " ".join(near_a)), (5, None), (6, ""), (6, ""), (7, " \t\n"), (None, a), (None, None),
            (8, b), (9, b + " " + words(rng, 5)), (10, long), (11, long), (12, long[:-1] + "Q"), (13, "one two"), (14, "ONE  two"), (15, a[:200] + " # $ % & | < > * !! !!"),
            (16, "é" * 500 + "   \x1c x"), (17, "Home | News | Sport | About\n" * 6), (18, "the same line of text here again.\n" * 12), (9, b), (19, words(rng, 40) + " " + a)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(*r, "en", "s", 1, 2, "n", 3, 4, True, "h", 5, "l") for r in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sql, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    return sorted(con.execute(sql).fetchall(), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_substring(docs, none, texts):
    got = substring.remove_recurring(docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(encode(kept_text, 'UTF-8'), 256)")
    assert rows(got) == duck(substring.SQL, texts)
    assert substring.remove_recurring(none).count() == 0


def test_substring_small_window(docs, texts):
    sql = substring.SQL.replace("ws[p:p + 34]", "ws[p:p + 5]").replace("len(ws) - 33", "len(ws) - 4").replace("len(ws) >= 35", "len(ws) >= 6").replace("range(0, 35)", "range(0, 6)")
    got = substring.remove_recurring(docs, 6).selectExpr("doc_id", "n_words", "n_removed", "sha2(encode(kept_text, 'UTF-8'), 256)")
    assert rows(got) == duck(sql, texts)


def test_exact(docs, none, texts):
    few = docs.filter("length(text) < 4000 OR text IS NULL")
    for df, how in ((docs, {}), (few, {"chunk": 100, "prime": 1})):  # with the modulus one all texts of a length collide
        want = duck(exact.SQL, [(r.doc_id, r.text) for r in df.collect()])
        got = rows(exact.exact_dedup(df, **how))
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and sum(r[3] for r in got) == sum(r[3] for r in want)
    assert exact.exact_dedup(none).count() == 0
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({(t or "").translate(str.maketrans(exact_upper(), exact_upper().lower())) for _, t in texts})
    assert exact.drop_copies(none).count() == 0


def exact_upper():
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(1000))
    for cut in (0, 1, 999, 1000, 500):
        assert exact.combine(exact.chunk_hash(data[:cut]), exact.chunk_hash(data[cut:]), 1000 - cut) == exact.chunk_hash(data)


def test_quality(docs, none, texts):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows(quality.judge(docs).select(*cols)) == duck(quality.SQL, texts)
    assert quality.judge(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).filter("kept").count()


def test_near(docs, none, texts):
    for small in (near.SMALL_BUCKET, 2):
        assert rows(near.near_groups(docs, small=small)) == duck(near.SQL, texts)
    assert near.near_groups(none).count() == 0
    kept = near.keep_one(docs)
    want = {r[0] for r in duck(near.SQL, texts) if r[3]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} - {None} == want - {None}
    assert near.keep_one(none).count() == 0


def test_near_keeps_one_row_per_group_with_null_and_shared_ids(spark):
    prepare(spark)
    rng = random.Random(12)

    def group(n):
        base = words(rng, 60)
        return [base + " " + words(rng, k) for k in range(n)]

    a, b, c, d, e = (group(3) for _ in range(5))
    data = [(1, a[0]), (None, a[1]), (None, b[0]), (None, b[0]), (None, c[0]), (None, c[1]), (None, ""), (None, ""),  # null ids: one near a number, others not
            (2, d[0]), (3, d[1]), (3, e[0]), (4, e[1]), (2, e[2]), (7, words(rng, 30)), (7, words(rng, 30)), (8, words(rng, 30))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for parts in (1, 5):
        got = [tuple(r) for r in near.keep_one(df.repartition(parts)).collect()]
        assert len(got) == len(set(got))
        got = set(got)
        assert {x for x in got if x[1] in a} == {(1, a[0])}
        assert {x for x in got if x[1] in b} == {(None, b[0])}
        assert len({x for x in got if x[1] in c}) == 1
        assert {x for x in got if x[1] in d} == {(2, d[0])}
        assert {x for x in got if x[1] in e} == {(2, e[2])}
        assert {x for x in got if x[0] in (7, 8)} == set(data[-3:]) and (None, "") in got
        assert len(got) == 5 + 3 + 1


def test_near_group_of_many(spark):
    """A chain of texts of which each resembles the next only, and a large group around one text."""
    prepare(spark)
    rng = random.Random(8)
    w = words(rng, 400).split()
    chain = [(i, " ".join(w[i * 4:i * 4 + 60])) for i in range(60)]
    base = words(rng, 100).split()
    group = []
    for i in range(100, 260):
        v = list(base)
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        group.append((i, " ".join(v)))
    data = chain + group
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(near.near_groups(df, small=8)) == duck(near.SQL, data)


def test_bpe(docs, none, texts):
    ranks = {k: v for k, v in bpe._codec(bpe.load_ranks(RANKS), P.PATTERN).ranks.items()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.round_trip(docs, RANKS, P.PATTERN)) == sorted(want, key=str)
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000)) and all(keys[h.slot_of[h.slot(k)]] == k for k in keys)
    assert bpe.PerfectHash([b"x"]).slot(b"y") == 0


def test_mixing(spark, docs, none):
    rng = random.Random(2)
    data, marks = [], []
    for i in range(600):
        dom = rng.choice(["clean", "clean", "low", "toxic"])
        extra = {"clean": "", "low": " junkword | |", "toxic": " badword"}[dom]
        data.append((i, words(rng, rng.randint(5, 60)) + extra * (rng.random() < 0.9)))
        if i % 2:
            marks.append((i, int(dom != "low"), int(dom == "toxic")))
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.rates(df, labels).toPandas()
    totals = {d: float((got.n_tokens * got.rate * got[f"p_{d}"]).sum()) for d in mixing.TARGETS}
    plain = float((got.n_tokens * got.p_clean).sum())
    assert (got.rate >= 0).all() and abs((got.p_clean + got.p_low + got.p_toxic - 1)).max() < 1e-5
    # the same steps in numpy
    p, n = got[["p_clean", "p_low", "p_toxic"]].to_numpy(), got.n_tokens.to_numpy()
    import numpy as np
    r, target, inv = np.ones(len(p)), np.array([0.9, 0.08, 0.02]) / 0.9 * plain, np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(30):
        r = np.maximum(0, r - p @ (inv @ ((p * n[:, None]).T @ r - target)))
    # soft posteriors put the smallest target out of reach here, so the totals are those of the same steps, not the targets
    reached = (p * (n * r)[:, None]).sum(axis=0)
    assert all(abs(totals[d] - x) < 0.01 * plain for d, x in zip(mixing.TARGETS, reached))
    mixed = mixing.mix(df, labels)
    assert mixed.columns == df.columns and mixed.count() == int(got.copies.sum())
    for a, b in ((docs, labels.limit(0)), (docs, labels), (none, labels), (none, labels.limit(0))):
        assert mixing.rates(a, b).count() == a.count() and mixing.mix(a, b).columns == a.columns
        mixing.mix(a, b).count()


def test_components_over_several_partitions(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)]
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        group[max(a, b)] = min(a, b)
    want = {(x, top(x)) for x in group if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for size in (1_000_000, 40):
        monkeypatch.setattr(near, "EDGES", size)
        assert {tuple(r) for r in near.components(df).collect()} == want

"""The pipeline as a whole against brute force on a small corpus."""

import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from townledger.llm import bpe, mixing, quality
from townledger.llm.common import prepare, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 3) + rng.choice("qrstuv") for _ in range(n)) + "."


def clean(text):
    """Kept lines of a text; only the failing lines that the corpus below holds are known here."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\f\v") and "|" not in x and not re.search("(?i)all rights reserved|click here", x)]
    whole, kept = len((text or "").split()), sum(len(x.split()) for x in lines)
    return "\n".join(lines) if whole >= 10 and 2 * kept >= whole else None


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(40):
        body = [sentence(rng, rng.randint(12, 30)) for _ in range(3)]
        rows.append((i, "\n".join(["Home | News | About | More", *body[:2], "", body[2], "Click here for more of this."] if i % 2 else body)))
    rows.append((100, rows[0][1] + "\nAll rights reserved."))  # a copy only once its failing line is gone
    rows.append((101, rows[2][1].upper()))
    rows.append((102, rows[4][1] + " " + sentence(rng, 4)))
    rows += [(103, "a | b | c | d\n" * 8), (104, "too short."), (105, None), (106, "")]
    return rows


def test_kept_documents_lose_their_failing_lines(spark, corpus):
    prepare(spark)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], SCHEMA)
    got = quality.keep_good(df)
    assert got.schema.fieldNames() == df.schema.fieldNames() and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    want = {(i, c, len(c)) for i, t in corpus if (c := clean(t)) is not None}
    assert {(r.doc_id, r.text, r.n_chars) for r in got.collect()} == want
    assert quality.keep_good(df.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_run_against_brute_force(spark, corpus):
    prepare(spark)
    folder = scratch(spark, "pipeline-test")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    kept = {i: c for i, t in corpus if (c := clean(t)) is not None}
    last = {}
    for i, t in sorted(kept.items()):
        last[t.lower()] = i  # the largest id of equal texts
    kept = {i: kept[i] for i in last.values()}
    group = {i: i for i in kept}

    def top(i):
        return i if group[i] == i else top(group[i])

    sets = {i: shingles(t) for i, t in kept.items()}
    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    kept = {i: t for i, t in kept.items() if group[i] == i}
    assert 100 in kept and 0 not in kept and 101 in kept and 2 not in kept and 4 in kept and 102 not in kept
    # mixing has its own brute-force test; here its rates for the documents left must be what the tokens hold
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    copies = {r.doc_id: r.copies for r in mixing.rates(left, marks).collect()}
    ranks = bpe._codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    want = Counter({(i, tuple(enc.encode_ordinary(t))): copies[i] for i, t in kept.items() if copies[i]})
    got = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want

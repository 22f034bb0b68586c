"""SimHash groups against all pairs of fingerprints, and the parts of the pigeonhole search by themselves."""

import random
import re

import numpy as np
import xxhash

from townledger.llm import simhash
from townledger.llm.common import prepare


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, fps, bits=3):
    names = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and names[i] != names[j]:
                names = [names[i] if x == names[j] else x for x in names]
    least = {g: min((r[0] for r, x in zip(rows, names) if x == g and r[0] is not None), default=None) for g in set(names)}
    return [least[g] for g in names]


def test_against_all_pairs(spark):
    prepare(spark)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") * rng.randint(1, 3)
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 40, 300, 3000]))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(None, rows[5][1]), (None, None), (900, ""), (901, " \t\n\r"), (None, "lonely text here"), (3, rows[3][1]), (3, rows[3][1]), (902, rows[0][1].upper()), (903, "ÄÖ\x85x y\x1cz Q")]
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], "doc_id long, text string, key long, fp string, kind int")
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], plain_groups(rows, fps)), key=str)
    assert sorted(map(tuple, simhash.simhash_groups(df).collect()), key=str) == want
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_dense_lists_lose_no_link(spark, monkeypatch):
    """Fingerprints around a few centres and equal in half of their bits, so that lists are dealt anew and compared in blocks."""
    prepare(spark)
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(150)} | {0xABCD << 48 | rng.getrandbits(32) for _ in range(200)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "LONG", 64)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    for bits in (3, 1):
        links = simhash.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
        by = {f: f for f in signed}

        def top(x):
            while by[x] != x:
                x = by[x]
            return x

        for a, b in links:
            by[max(top(a), top(b))] = min(top(a), top(b))
        got = [top(f) for f in signed]
        want = plain_groups([(f,) for f in signed], fps, bits)
        assert got == want


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.int64)
    parts = simhash.correlated_parts(np.cov(simhash._unpacked(fps).T), 500)
    assert sorted(sum(parts, [])) == list(range(64)) and {len(p) for p in parts} == {16}
    v = simhash.values(fps, parts)
    counts = np.zeros((4, 1 << 16), np.int64)
    for i in range(4):
        np.add.at(counts[i], v[i], 1)
    table = simhash.reach(counts)
    for x in (0, 1, 65535):
        for t in range(4):
            assert table[t, 0, x] == sum(int(a ^ x).bit_count() <= t for a in v[0].tolist())
    t = simhash.thresholds(v, table)
    assert (t >= -1).all() and ((t + 1).sum(axis=0) == 4).all()


def test_correlated_bits_meet():
    rng = np.random.default_rng(2)
    groups = rng.permutation(64).reshape(4, 16)
    x = rng.integers(0, 2, (4000, 64))
    for g in groups:
        x[:, g] ^= (x[:, g] ^ rng.integers(0, 2, (4000, 1))) * (rng.random((4000, 16)) < 0.6)
    parts = simhash.correlated_parts(x.T @ x, 4000)
    assert sorted(map(tuple, parts)) == sorted(tuple(sorted(g.tolist())) for g in groups)


def test_majority_of_long_texts():
    h = np.random.default_rng(4).integers(0, 1 << 63, 70_001, dtype=np.int64).view(np.uint64)
    assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))

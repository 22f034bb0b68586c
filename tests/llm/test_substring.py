"""Recurring passages against plain counting of all windows, with frequent anchors dealt to several shards."""

import random
from collections import Counter

import numpy as np

from townledger.llm import shingles, substring
from townledger.llm.common import prepare


def plain(rows, window):
    words = [substring.split(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["é", "ü", "o", "漢"]) + str(rng.randrange(30))
    common, rare = [word() for _ in range(40)], [word() for _ in range(14)]
    rows = []
    for i in range(240):
        w = [word() for _ in range(rng.randint(0, 40))]
        w += common[rng.randint(0, 10):rng.randint(20, 40)] + [word() for _ in range(rng.randint(0, 12))]
        if i % 40 == 0:
            w += rare + w[:9]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(240, None), (241, ""), (242, "ab " * 200), (243, "\x1c \x85 x\x0by"), (None, " ".join(common)), (7, rows[7][1]), (244, " ".join(rare[:-1] + ["other"]))]
    return rows


def test_frequent_anchors_in_several_shards(spark, monkeypatch):
    prepare(spark)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for share, slice_ in ((substring.SHARE, substring.SLICE), (10 ** 6, 500)):
        monkeypatch.setattr(substring, "SHARE", share)
        monkeypatch.setattr(substring, "SLICE", slice_)
        for window in (12, 35):
            got = substring.remove_recurring(df, window)
            assert sorted(map(tuple, got.collect()), key=str) == plain(rows, window)


def test_shard_compares_words(monkeypatch):
    """With one hash for all windows, only windows equal word by word to a home's are found."""
    home, other = [f"w{i}" for i in range(20)], [f"w{i}" for i in range(19)] + ["x"]
    monkeypatch.setattr(substring, "window_hashes", lambda h, k, salt=0: np.full(max(0, len(h) - k + 1), 5, np.uint64))
    shard = substring.Shard(6)
    shard.add(" ".join(home), 14, np.array([14]))
    found = shard.locate([" ".join(home), " ".join(other), "w14 w15 w16"])
    assert [x.tolist() for x in found] == [[0], [14], [20]]


def test_windows_stay_inside_their_text():
    t = substring.Texts(["a b c d", None, "e f", "g h i j k"], 4)
    assert t.valid.tolist() == [True, False, False, False, False, False, True, True]
    t.anchors()
    assert set(t.of[t.places].tolist()) == {0, 3}


def test_words_are_hashed_without_a_lookup_per_word(monkeypatch):
    """All words differ: their hashes come from the bytes at once, the same for a word wherever it stands."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aé漢z.") for _ in range(rng.randint(1, 90))) for _ in range(3000)] + ["a", "a\0", "\0", "x" * 64, "x" * 65, "x" * 200]
    monkeypatch.setattr(shingles._Words, "__missing__", lambda *_: 1 / 0)
    shingles.forget_words()
    t = substring.Texts([" \t".join(words), None, "\n" + "\r\n".join(reversed(words)) + " "], 35)
    assert [t.text[a:b].decode() for a, b in zip(t.begin, t.end)] == words + words[::-1]
    assert t.h[:len(words)].tolist() == t.h[len(words):][::-1].tolist() and len(set(t.h.tolist())) == len(set(words))
    assert t.joined(np.array([0, 5]), np.array([40, 6])) == [" ".join(words[:40]), words[5]]


def test_shard_compares_texts(monkeypatch):
    """With one hash for all words, only windows whose text is that of a home's are found."""
    home, other = [f"w{i}" for i in range(20)], [f"w{i}" for i in range(19)] + ["x"]
    monkeypatch.setattr(substring, "span_hashes", lambda text, begin, end: np.full(len(begin), 5, np.uint64))
    shard = substring.Shard(6)
    shard.add(" ".join(home), 14, np.array([14]))
    found = shard.locate([" ".join(home), " ".join(other), "w14 w15 w16"])
    assert [x.tolist() for x in found] == [[0], [14], [20]]

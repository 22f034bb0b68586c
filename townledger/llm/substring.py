"""Recurring passages: confirmed by window counts, compiled into sharded Aho-Corasick automata, located in all documents.

1. Every window has an anchor, its least run of 16 words by hash. Anchors of all documents are counted; a window can recur only
   if its anchor does.
2. Such windows are counted by a 128-bit hash; a recurring one gets one home document.
3. Around the anchors of recurring windows the home documents give pieces of text, the phrases: the anchor's words are compiled into
   the automaton of a shard, two letters of 128 for a word, dealt by the anchor's hash; the piece keeps the windows that recur.
4. All documents stream by; where windows may recur, the piece around their anchor goes to the anchor's shard. The automaton finds
   the phrases in it, and the text of windows around a found phrase is compared with that of the home's window.
An anchor with more pieces than its share goes to several shards, and so do its phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut_lineage, flag_ids, id_filter, stored
from .shingles import span_hashes, window_hashes, word_bounds

WINDOW = 35
GRAM = 16
# Bits of an anchor filter: sixteen per anchor, at most 2^27 (16 MB) whatever the input; a full filter only lets more windows be counted.
MAX_FILTER = 27
PHRASES_PER_SHARD = 20_000
# Characters of text worked on in one go, and parts of a shard's share from which an anchor is dealt to several shards.
SLICE = 2_000_000
SHARE = 4
# Letters of an automaton for a word, and bits of its hash in each.
LETTERS, BITS = 2, 7


def split(text: str | None) -> list[str]:
    """Words as they are; split at space and U+0009 to U+000D only."""
    return [w.decode() for w in text.encode().split()] if text else []


def _gram(window: int) -> int:
    return max(1, min(GRAM, window // 2))


def sliding(best, a: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest (np.minimum, np.maximum) of every run of ``width`` values, by doubling."""
    n, size = len(a) - width + 1, 1
    while size * 2 <= width:
        a, size = best(a[:-size], a[size:]), size * 2
    return best(a[:n], a[width - size:width - size + n])


class Texts:
    """Some whole texts as one run of words; windows that reach into the next text are not ``valid``."""

    def __init__(self, texts: list[str | None], window: int):
        self.window, self.gram = window, _gram(window)
        raw = [t.encode() if t else b"" for t in texts]
        self.text, self.begin, self.end = word_bounds(b" ".join(raw))
        self.start = np.searchsorted(self.begin, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        self.of = np.repeat(np.arange(len(raw)), np.diff(self.start))
        self.h = span_hashes(self.text, self.begin, self.end)
        n = max(0, len(self.h) - window + 1)
        self.valid = self.of[:n] == self.of[window - 1:]

    def anchors(self) -> None:
        """Hashes of all runs of ``gram`` words, the anchor of every window, and the places that are the anchor of some window."""
        if not len(self.valid):
            self.g = self.least = np.zeros(0, np.uint64)
            self.places = np.zeros(0, np.int64)
            return
        width = self.window - self.gram + 1
        self.g = window_hashes(self.h, self.gram)
        self.least = sliding(np.minimum, self.g, width)
        edge = np.zeros(width - 1, np.uint64)
        best = np.concatenate([edge, np.where(self.valid, self.least, np.uint64(0)), edge])
        self.places = np.flatnonzero((sliding(np.maximum, best, width) == self.g) & (self.g > 0))

    def windows(self, salt: int = 1) -> np.ndarray:
        return window_hashes(self.h, self.window, salt)

    def pieces(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(anchor places, first and last window, index of the first one in ``pos``, text) of the pieces around the anchors of the windows ``pos``."""
        k = np.searchsorted(self.places, pos)
        while len(off := np.flatnonzero(self.g[self.places[k]] != self.least[pos])):
            k[off] += 1
        p, first = np.unique(self.places[k], return_index=True)
        lo, hi = pos[first], pos[np.append(first[1:], len(pos)) - 1]
        return p, lo, hi, first, self.joined(lo, hi + self.window)

    def joined(self, lo: np.ndarray, hi: np.ndarray) -> list[str]:
        """Texts of the words from ``lo`` to before ``hi``, joined by one space."""
        a, b = self.begin[lo], self.end[hi - 1]
        out = [self.text[i:j].decode() for i, j in zip(a.tolist(), b.tolist())]
        letters = np.append(0, np.cumsum(self.end - self.begin))
        for i in np.flatnonzero(b - a > letters[hi] - letters[lo] + hi - lo - 1).tolist():  # more than one space between words
            out[i] = " ".join(filter(None, out[i].split(" ")))
        return out

    def letters(self) -> str:
        """The words as LETTERS letters each; those of one place in a word stand for no other place."""
        out = np.empty((len(self.h), LETTERS), np.uint32)
        for k in range(LETTERS):
            out[:, k] = ((self.h >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)) + np.uint64(1 + (k << BITS))
        return out.astype("<u4").tobytes().decode("utf-32-le")


def slices(pdf: pd.DataFrame, window: int) -> Iterator[tuple[Texts, np.ndarray]]:
    """The texts of a batch in slices of about SLICE characters, with the places of their rows."""
    texts = pdf["text"].tolist()
    if not texts:
        return
    size = np.cumsum([len(t) if t else 0 for t in texts]) // SLICE
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1):
        yield Texts([texts[i] for i in part], window), part


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds the key of a row, a hash of id and text; rows equal in both share their key and their spans."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("key2", F.hash("text", "doc_id"))


def _bitmap(hashes: DataFrame) -> tuple[int, bytes]:
    """Filter over the column h as (log2 of its bits, bits); its size is bounded, see MAX_FILTER."""
    n = hashes.count()
    log = min(MAX_FILTER, max(16, (16 * n).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << log) - 1))
    table = (hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow())
    bits = np.zeros(1 << (log - 6), np.int64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return log, bits.tobytes()


def _inside(filter_: tuple[int, bytes], h: np.ndarray) -> np.ndarray:
    log, bits = filter_
    slot = h & np.uint64((1 << log) - 1)
    return ((np.frombuffer(bits, np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def _recurring_anchors(rows: DataFrame, window: int) -> DataFrame:
    """(h, n) of the anchors that occur n times, twice at least."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t, _ in slices(pdf, window):
                t.anchors()
                h, n = np.unique(t.g[t.places], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    return rows.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _candidates(rows: DataFrame, share, window: int) -> DataFrame:
    """(w, w2, key) of the windows whose anchor recurs: both hashes of the window, key of the document."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t, at in slices(pdf, window):
                t.anchors()
                pos = np.flatnonzero(t.valid & _inside(share.value, t.least))
                if len(pos):
                    key = pdf["key"].to_numpy()[at][t.of[pos]]
                    yield pd.DataFrame({"w": t.windows()[pos].view(np.int64), "w2": t.windows(2)[pos].view(np.int64), "key": key})

    return rows.select("key", "text").mapInPandas(run, "w long, w2 long, key long")


_PIECE = "g long, salt int, key long, key2 int, start int, context string, place int, windows array<int>"


def _spread(hot, g: np.ndarray) -> np.ndarray:
    """Number of shards that each anchor is dealt to."""
    known, parts = (np.frombuffer(x, np.int64) for x in hot)
    at = np.searchsorted(known, g)
    at[at == len(known)] = 0
    return np.where(known[at] == g, parts[at], 1) if len(known) else np.ones(len(g), np.int64)


def _phrases(rows: DataFrame, homes: DataFrame, hot, window: int) -> DataFrame:
    """Pieces of the home documents around the recurring windows; ``windows`` are the places of these in the piece, ``place`` that of the phrase."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t, at in slices(pdf, window):
                t.anchors()
                wanted = [np.asarray(x, np.int64) for x in pdf["wanted"].iloc[at]]
                w, owner = np.concatenate(wanted), np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
                order = np.argsort(w, kind="stable")
                w, owner = w[order], owner[order]
                mine = t.windows().view(np.int64)
                here = np.searchsorted(w, mine)
                # a hash may be wanted by two documents of the batch, for different windows
                ok = np.zeros(len(mine), bool)
                for step in (0, 1):
                    x = np.minimum(here + step, len(w) - 1)
                    ok |= (w[x] == mine) & (owner[x] == t.of[:len(mine)])
                pos = np.flatnonzero(ok & t.valid)
                if not len(pos):
                    continue
                p, lo, _, first, texts = t.pieces(pos)
                g = t.g[p].view(np.int64)
                inner = np.split((pos - np.repeat(lo, np.diff(np.append(first, len(pos))))).astype(np.int32), first[1:])
                n = _spread(hot.value, g)
                i = np.repeat(np.arange(len(p)), n)
                salt = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"g": g[i], "salt": salt.astype(np.int32), "key": 0, "key2": np.int32(0), "start": np.int32(0), "context": [texts[j] for j in i.tolist()],
                                    "place": (p - lo)[i].astype(np.int32), "windows": pd.Series([inner[j] for j in i.tolist()], dtype=object)})

    texts = flag_ids(rows, id_filter(homes, F.col("key")), F.col("key")).filter("_maybe").select("key", "text")
    lists = homes.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    return texts.join(lists, "key").select("text", "wanted").mapInPandas(run, _PIECE)


def _segments(rows: DataFrame, share, window: int) -> DataFrame:
    """Pieces around the anchors of windows that may recur; share holds the filters of anchors and windows and the spread of hot anchors."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_anchors, of_windows, hot = share.value
        for pdf in parts:
            for t, at in slices(pdf, window):
                t.anchors()
                pos = np.flatnonzero(t.valid & _inside(of_anchors, t.least))
                pos = pos[_inside(of_windows, t.windows()[pos])]
                if len(pos):
                    p, lo, _, _, texts = t.pieces(pos)
                    doc, g = t.of[lo], t.g[p].view(np.int64)
                    key = pdf["key"].to_numpy()[at][doc]
                    salt = (key.view(np.uint64) >> np.uint64(17)) % _spread(hot, g).astype(np.uint64)
                    yield pd.DataFrame({"g": g, "salt": salt.astype(np.int32), "key": key, "key2": pdf["key2"].to_numpy()[at][doc], "start": (lo - t.start[doc]).astype(np.int32),
                                        "context": texts, "place": np.int32(0), "windows": None})

    return rows.select("key", "key2", "text").mapInPandas(run, _PIECE)


class Shard:
    """Automaton over the phrases of one shard, with the texts around them and the recurring windows in these."""

    def __init__(self, window: int):
        self.window, self.gram = window, _gram(window)
        self.contexts: list[str] = []
        self.places: list[int] = []
        self.windows: list[np.ndarray] = []
        self.automaton = None

    def add(self, context: str, place: int, windows: np.ndarray) -> None:
        """A piece with its phrase at word ``place`` and recurring windows at the words ``windows``."""
        self.contexts.append(context)
        self.places.append(place)
        self.windows.append(windows)
        self.automaton = None

    def _compile(self) -> None:
        self.automaton = ahocorasick.Automaton()
        numbers: dict[str, int] = {}
        found, texts, letters_before, words_before = [], [], 0, 0
        for t, part in slices(pd.DataFrame({"text": self.contexts}), self.window):
            spelt, first = t.letters(), t.start[:-1]
            number = []
            for p in (first + np.array(self.places)[part]).tolist():
                phrase = spelt[p * LETTERS:(p + self.gram) * LETTERS]
                n = numbers.setdefault(phrase, len(numbers))
                if n == len(numbers) - 1:
                    self.automaton.add_word(phrase, n)
                number.append(n)
            size = [len(self.windows[i]) for i in part]
            at = np.concatenate([self.windows[i] for i in part]) + np.repeat(first, size)
            found.append((t.windows()[at], np.repeat(number, size), at + words_before, t.begin + letters_before, t.end + letters_before))
            texts.append(t.text)
            letters_before, words_before = letters_before + len(t.text) + 1, words_before + len(t.h)
        self.automaton.make_automaton()
        hashes, number, at, self.begin, self.end = (np.concatenate(x) for x in zip(*found))
        self.text = b" ".join(texts)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number, self.at = hashes[order], number[order], at[order]

    def _same_text(self, t: Texts, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the windows at ``x`` have the text of the homes' windows at ``at``; runs of windows are compared at once."""
        def same(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            ours = zip(t.begin[x[first]].tolist(), t.end[x[last] + self.window - 1].tolist())
            homes = zip(self.begin[at[first]].tolist(), self.end[at[last] + self.window - 1].tolist())
            return np.array([t.text[a:b] == self.text[c:d] for (a, b), (c, d) in zip(ours, homes)], bool)

        if not len(x):
            return np.zeros(0, bool)
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1] + 1) | (at[1:] != at[:-1] + 1)))
        size = np.diff(np.append(first, len(x)))
        ok = np.repeat(same(first, first + size - 1), size)
        left = np.flatnonzero(~ok & np.repeat(size > 1, size))
        ok[left] = same(left, left)
        return ok

    def locate(self, contexts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, stop): spans of words covered by recurring windows around the phrases in pieces of text."""
        none = (np.zeros(0, np.int64),) * 3
        if not self.contexts or not contexts:
            return none
        if self.automaton is None:
            self._compile()
        t = Texts(contexts, self.window)
        found = list(self.automaton.iter(t.letters()))
        if not found:
            return none
        x = np.flatnonzero(t.valid)
        h = t.windows()[x]
        near = np.searchsorted(self.hashes, h)
        near[near == len(self.hashes)] = 0
        known = self.hashes[near] == h
        x, entry = x[known], near[known]
        # places of the phrases found, as words; one that reaches into the next piece lies in no window
        end, number = (np.array(v) for v in zip(*found))
        n = len(t.h) + 1
        hits = np.sort(number * n + (end + 1) // LETTERS - self.gram)
        # the window's own phrase must lie in it
        asked = self.number[entry] * n + x
        at = np.searchsorted(hits, asked)
        ok = at < len(hits)
        ok[ok] = hits[at[ok]] <= asked[ok] + self.window - self.gram
        x, entry = x[ok], entry[ok]
        x = x[self._same_text(t, x, self.at[entry])]
        if not len(x):
            return none
        # windows one after another that overlap are one span
        new = np.append(True, (t.of[x[1:]] != t.of[x[:-1]]) | (x[1:] > x[:-1] + self.window))
        first, last = x[new], x[np.append(np.flatnonzero(new)[1:], len(x)) - 1]
        piece = t.of[first]
        return piece, first - t.start[piece], last + self.window - t.start[piece]


def _locate(phrases: DataFrame, segments: DataFrame, shards: int, window: int) -> DataFrame:
    """(key, key2, span): shards get their phrases first, then the segments stream by; no more than SLICE characters of these are kept in memory."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, size = Shard(window), [], 0

        def done() -> Iterator[pd.DataFrame]:
            if held:
                pdf = pd.concat(held)
                held.clear()
                row, start, stop = shard.locate(pdf["context"].tolist())
                if len(row):
                    at = pdf["start"].to_numpy()[row].astype(np.int64)
                    yield pd.DataFrame({"key": pdf["key"].to_numpy()[row], "key2": pdf["key2"].to_numpy()[row], "span": (at + start << 32) + at + stop})

        for pdf in parts:
            segment = pdf["windows"].isna().to_numpy()
            for context, place, windows in zip(*(pdf[c][~segment] for c in ("context", "place", "windows"))):
                shard.add(context, place, np.asarray(windows))
            if segment.any():
                held.append(pdf.loc[segment, ["key", "key2", "start", "context"]])
                size += sum(map(len, held[-1]["context"]))
                if size >= SLICE:
                    yield from done()
                    size = 0
        yield from done()

    both = phrases.unionByName(segments).repartition(shards, "g", "salt").sortWithinPartitions(F.col("windows").isNull())
    return both.select("key", "key2", "start", "context", "place", "windows").mapInPandas(run, "key long, key2 int, span long")


def recurring_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, key2, spans): word spans that recurring windows cover, for the documents that have some; start << 32 | stop each."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    anchors = cut_lineage(_recurring_anchors(rows, window))
    share = spark.sparkContext.broadcast(_bitmap(anchors))
    counted = _candidates(rows, share, window).groupBy("w", "w2").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    homes = stored(counted.filter("n > 1").select("w", "key"), "homes")
    total = anchors.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["anchors"] // PHRASES_PER_SHARD + 1)
    # at most SHARE x shards anchors have more than such a part of all pieces
    often = anchors.filter(F.col("n") * SHARE * shards > total["pieces"]).orderBy("h").toArrow()
    parts = -(-often["n"].to_numpy() * SHARE * shards // max(total["pieces"], 1))
    hot = (often["h"].to_numpy().tobytes(), np.minimum(parts, shards).astype(np.int64).tobytes())
    phrases = stored(_phrases(rows, homes, spark.sparkContext.broadcast(hot), window), "phrases")
    ours = spark.sparkContext.broadcast((_bitmap(phrases.select(F.col("g").alias("h")).distinct()), _bitmap(homes.select(F.col("w").alias("h"))), hot))
    found = _locate(phrases, _segments(rows, ours, window), shards, window)
    return cut_lineage(found.groupBy("key", "key2").agg(F.collect_set("span").alias("spans")))


def remove_recurring(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words left, joined by one space).

    Every word is removed that a window of ``window`` words covers whose word sequence starts anywhere else as well, in the
    same document or in another row, repeated rows included. Windows are judged on the input. A null or empty text has no
    words. Ids may be null or repeat; extra columns are not read; an empty table gives no rows. Only documents with a
    recurring passage are joined, all others pass where they are read.
    """
    spans = recurring_spans(docs, window, id_col, text_col)

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, spans):
            words = t.encode().split() if t else []
            kept, done = [], 0
            for x in sorted(found.tolist()) if found is not None else ():
                kept += words[done:x >> 32]
                done = max(done, x & 0xFFFFFFFF)
            kept += words[done:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    rows = flag_ids(_rows(docs, id_col, text_col), id_filter(spans, F.col("key")), F.col("key"))
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    plain = rows.filter(~F.col("_maybe")).select("doc_id", text.alias("kept_text"))
    blanks = F.length("kept_text") - F.length(F.replace("kept_text", F.lit(" "), F.lit("")))
    plain = plain.select("doc_id", F.when(F.col("kept_text") == "", 0).otherwise(blanks + 1).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "kept_text")
    hit = rows.filter("_maybe").join(spans, ["key", "key2"], "left")
    hit = hit.select("doc_id", cut("text", "spans").alias("x")).select("doc_id", "x.*")
    return plain.unionByName(hit)


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM t WHERE len(ws) >= 35)),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT DISTINCT r, p + k AS q, true AS hit FROM d, (SELECT unnest(range(0, 35)) AS k)),
x AS (SELECT r, q, ws[q] AS word, hit IS NULL AS keep FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS q FROM t) LEFT JOIN g USING (r, q)),
y AS (SELECT r, count(*) FILTER (WHERE NOT keep) AS gone, coalesce(string_agg(word, ' ' ORDER BY q) FILTER (WHERE keep), '') AS kept FROM x GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN y USING (r)
"""

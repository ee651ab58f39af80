"""Remove passages that an earlier document has: Rabin-Karp hashes of every window of consecutive words.

1. In each text, the window's anchor is its 12 words in a row with the smallest hash. Windows with one anchor are
   consecutive; the words they cover are a stretch, named by two hashes. Equal windows have equal anchors, so a window can
   only repeat where its anchor does: anchors are counted over all documents, and single ones leave.
2. Equal stretches have equal windows. One stretch of each kind, that of the smallest id, gives the Rabin-Karp hashes of
   all its windows; they are grouped in Spark, where each gets the smallest id that has it.
3. Every occurrence of a stretch takes its kind's verdict: windows that a smaller id has are removed. Removed windows
   merge into maximal intervals of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import gather_runs, offsets_of, slices_by_bytes
from grainscope.llm.hashing import BASE, Rolling, mixed, powers
from grainscope.session import save_and_reload, shared_dir

WINDOW = 50
ANCHOR = 12             # words of an anchor; stretches have at most WINDOW - ANCHOR + 1 windows
SECOND = 0xD6E8FEB86659FD93  # base of the second hash

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class WordHashes:
    """Rabin-Karp hashes, modulo 2 ** 64 and from prefix sums, of the words of one or more texts in a row."""

    def __init__(self):
        self.bytes = Rolling()

    def load(self, texts: list[bytes]) -> np.ndarray:
        """Take the words of ``texts``; returns the number of words before each text, and in all."""
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        full = np.concatenate([[False], ~BLANK[raw], [False]])
        edge = np.flatnonzero(full[1:] != full[:-1])
        start, end = edge[::2], edge[1::2]
        self.bytes.load(raw)
        self.words = mixed(self.bytes.of(start, end) + (end - start).astype(np.uint64))
        ends = offsets_of(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.sums = {}
        return np.searchsorted(start, ends)

    def of(self, start: np.ndarray, end: np.ndarray, base: int = int(BASE)) -> np.ndarray:
        """Hashes of words[start:end]."""
        if base not in self.sums:
            up, down = powers(len(self.words) + 1, base)
            sums = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(self.words * up[:-1], out=sums[1:])
            self.sums[base] = sums, down
        sums, down = self.sums[base]
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)).astype(np.int64)


def smallest_within(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of each ``width`` consecutive values; halves of doubling length are compared."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def _anchors(hashes: WordHashes, cuts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of all texts: (text, first window, windows, anchor hash, stretch hash) of each stretch."""
    size = np.diff(cuts)
    some = np.flatnonzero(size >= window)
    width = min(ANCHOR, window)
    grams = hashes.of(np.arange(len(hashes.words) - width + 1), np.arange(width, len(hashes.words) + 1)) \
        if len(some) else np.zeros(0, np.int64)
    parts = []
    for t in some.tolist():
        a, b = int(cuts[t]), int(cuts[t + 1])
        at = smallest_within(grams[a:b - width + 1], window - width + 1)      # anchor of each window
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        parts.append((np.full(len(first), t), first + a, count, at[first] + a))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    text, first, count, at = (np.concatenate(x) for x in zip(*parts))
    return text, first - cuts[text], count, grams[at], hashes.of(first, first + count + (window - 1), SECOND)


def anchor_table(docs: DataFrame, window: int) -> DataFrame:
    """(id, t, gram, stretch, first, windows): one row per stretch of windows with one anchor."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(2), 2 << 20):
                part = batch.slice(a, b - a)
                text, first, count, gram, stretch = _anchors(
                    hashes, hashes.load([t or b"" for t in part.column(2).to_pylist()]), window)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(gram), pa.array(stretch),
                     pa.array(first, pa.int64()), pa.array(count, pa.int64())],
                    ["id", "t", "gram", "stretch", "first", "windows"])

    return docs.mapInArrow(run, f"id {kind}, t long, gram long, stretch long, first long, windows long")


def window_hashes(cuts: DataFrame, window: int) -> DataFrame:
    """(gram, stretch, id, k, h) of the windows of chosen stretches. Equal windows have the same anchor, so (gram, h), two
    hashes with different bases, names a window.

    ``cuts`` holds (id, text binary, cuts array of (gram, stretch, first, windows))."""
    kind = cuts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1), 2 << 20):
                part = batch.slice(a, b - a)
                begin = hashes.load([t or b"" for t in part.column(1).to_pylist()])
                lists = part.column(2)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                count = flat.field(3).to_numpy()
                at = gather_runs(begin[row] + flat.field(2).to_numpy(), count)
                cut = pa.array(np.repeat(np.arange(len(row)), count))
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0).take(cut), flat.field(1).take(cut),
                     part.column(0).take(pa.array(np.repeat(row, count))),
                     pa.array(gather_runs(np.zeros(len(count), np.int64), count), pa.int32()),
                     pa.array(hashes.of(at, at + window, SECOND))],
                    ["gram", "stretch", "id", "k", "h"])

    return cuts.mapInArrow(run, f"gram long, stretch long, id {kind}, k int, h long")


def earlier_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, t, starts): first words of the windows that also start in a row of smaller id.

    ``docs`` holds (id, t, text binary); ``t`` tells texts of one id apart.
    """
    folder = shared_dir(docs.sparkSession)
    found = save_and_reload(anchor_table(docs, window), f"{folder}/anchors")
    shared = found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"),
        F.count("id").alias("named")).where("a < b or (named > 0 and named < n)").select("gram")
    hits = save_and_reload(found.join(save_and_reload(shared, f"{folder}/shared"), "gram"), f"{folder}/hits")

    # one stretch of each kind
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "t", "first")
    kinds = hits.groupBy("gram", "stretch", "windows").agg(F.min(place).alias("s"))
    cuts = kinds.groupBy(F.col("s.id").alias("id2"), F.col("s.t").alias("t2")).agg(F.collect_list(F.struct(
        "gram", "stretch", F.col("s.first").alias("first"), "windows")).alias("cuts"))
    chosen = docs.join(cuts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2"))).select(
        "id", "text", "cuts")
    hashed = save_and_reload(window_hashes(chosen, window), f"{folder}/windows")

    # the smallest id of each window, back to the kinds; written, so that the join below is planned by its size
    first = hashed.groupBy("gram", "h").agg(F.min("id").alias("lead"))
    verdict = save_and_reload(hashed.select("gram", "stretch", "k", "h").join(first, ["gram", "h"]).where(
        "lead is not null").groupBy("gram", "stretch").agg(F.collect_set(F.struct("lead", "k")).alias("leads")),
        f"{folder}/verdict")
    earlier = F.filter("leads", lambda x: F.col("id").isNull() | (x["lead"] < F.col("id")))
    starts = F.transform(earlier, lambda x: F.col("first") + x["k"])
    return hits.join(verdict, ["gram", "stretch"]).select("id", "t", starts.alias("starts")).where(
        F.size("starts") > 0).groupBy("id", "t").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def merged(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [first, last) of the windows that begin at ``starts``."""
    starts = np.unique(starts)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
    return starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)] + window


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word in a window of ``window`` consecutive words that a document of smaller id has too.

    Rows (id, n_words, n_removed, spans, kept), one per row of ``docs``: words as given, the maximal intervals of removed
    words ([first, last), counted from 0), and the rest joined by single spaces. Words are runs without blanks (U+0020,
    U+0009 to U+000D). NULL and empty texts have no words; shorter texts than a window lose nothing. Rows with equal ids
    lose nothing to each other, be their texts equal or not. A row with a NULL id comes after all ids: it loses what any
    row with an id has and takes nothing away. Windows are judged on the texts as given. Other columns are ignored.

    A text goes through two exchanges: once to cut the chosen stretches, once to meet its intervals. A very common passage
    is one row per kind and task after partial aggregation; its occurrences meet the verdict in a join whose hot keys
    AQE splits.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"),
                         F.col(text_col).cast("binary").alias("text"))
    gone = earlier_windows(source, window).withColumnsRenamed({"id": "id2", "t": "t2"})
    joined = source.join(gone, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), "left").select(
        "id", "text", "starts")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1)):
                part = batch.slice(a, b - a)
                total, removed, spans, kept = [], [], [], []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2)):
                    words, pairs, rest, at = (text or b"").split(), [], [], 0
                    total.append(len(words))
                    if starts.is_valid:
                        for first, last in zip(*(x.tolist() for x in merged(starts.values.to_numpy(), window))):
                            pairs.append({"first": first, "last": last})
                            rest += words[at:first]
                            at = last
                    rest += words[at:]
                    removed.append(len(words) - len(rest))
                    spans.append(pairs)
                    kept.append(b" ".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    [id_col, "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, "
                                  "spans array<struct<first: long, last: long>>, kept string")

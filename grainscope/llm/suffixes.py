"""Remove long repeated byte strings: a sampled suffix array over the whole table.

A string of LENGTH bytes is a window. Every window names one place inside itself, its anchor: the start of the k-gram
with the smallest hash. Equal windows have the same anchor at the same distance, so only suffixes that start at anchors
are compared: about one in sixty.

1. Anchors are counted by the hash of their k-gram. Where all occurrences also have equal surroundings, all their
   windows are repeated, and no text moves. Of the others, one suffix per distinct surroundings is cut from its text.
2. Sampled splitters deal these suffixes out by their leading bytes. Each bucket sorts them, and the reversed bytes on
   their left, by multikey quicksort; common prefixes of neighbours say which windows are equal. Windows that the first or
   last row of a bucket reaches may go on in the next bucket: they are compared once more by hash, over all buckets.
3. The ranges found are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import slices_by_bytes
from grainscope.llm.hashing import Rolling, mixed
from grainscope.session import save_and_reload, shared_dir

LENGTH = 200
GRAM = 80
SPAN = LENGTH - GRAM + 1          # k-grams of a window
BLOCK = 1 << 21                   # bytes examined at a time; positions fit into PLACE bits
PLACE = np.uint64((1 << 22) - 1)
BUCKET_ROWS = 40_000
LEAF = 1024


# ---------------------------------------------------------------- anchors
def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each stretch of ``width`` values, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(raw: np.ndarray, stops: np.ndarray, rolling: Rolling) -> dict[str, np.ndarray]:
    """Anchors of all windows of a buffer; no window crosses one of ``stops`` (ends of texts, ascending).

    Arrays: place, low and high (first and last window start), gram (hash of the k-gram), around (hash of all bytes of
    its windows and their distances).
    """
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return {k: none for k in ("place", "low", "high", "gram", "around")}
    rolling.load(raw)
    at = np.arange(len(raw) - GRAM + 1)
    gram = mixed(rolling.of(at, at + GRAM))
    least = sliding_least((gram & ~PLACE) | at.astype(np.uint64), SPAN)
    place = (least & PLACE).astype(np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    whole = np.zeros(len(place) + 1, np.int32)              # windows inside one text
    ends = np.maximum(stops - LENGTH + 1, starts)
    np.add.at(whole, np.minimum(starts, len(place)), 1)
    np.add.at(whole, np.minimum(ends, len(place)), -1)
    inside = np.cumsum(whole[:-1]) > 0
    change = np.ones(len(place) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    edge = np.flatnonzero(change)
    low, high = edge[:-1], edge[1:] - 1
    ok = inside[low]
    low, high = low[ok], high[ok]
    place = place[low]
    around = rolling.of(low, high + LENGTH) + mixed(((place - low) * SPAN + (place - high) + 1).astype(np.uint64))
    return {"place": place, "low": low, "high": high, "gram": gram[place].astype(np.int64),
            "around": mixed(around).astype(np.int64)}


def blocks_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about BLOCK bytes: (bytes, ends of the texts, row of each, position of its first byte). A longer
    text comes in overlapping parts, so that each of its windows is in one part."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for row, t in enumerate(texts):
        for first in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            part = t[first:first + BLOCK + LENGTH - 1]
            if size and size + len(part) > BLOCK + LENGTH:
                yield _joined(parts)
                parts, size = [], 0
            parts.append((row, first, part))
            size += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts):
    rows, firsts, texts = zip(*parts)
    return (np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), np.array(rows),
            np.array(firsts))


def anchor_table(docs: DataFrame) -> DataFrame:
    """(id, text_key, place, left, right, gram, around): windows start from ``left`` to ``right`` bytes before the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1), BLOCK):
                part = batch.slice(a, b - a)
                for raw, stops, rows, firsts in blocks_of([t or b"" for t in part.column(1).to_pylist()]):
                    x = anchors(raw, stops, rolling)
                    text = np.searchsorted(stops, x["low"], "right")
                    shift = firsts[text] - np.concatenate([[0], stops[:-1]])[text]
                    yield pa.RecordBatch.from_arrays([
                        *[part.column(c).take(pa.array(rows[text])) for c in (0, 2)], pa.array(x["place"] + shift),
                        pa.array((x["place"] - x["low"]).astype(np.int32)),
                        pa.array((x["place"] - x["high"]).astype(np.int32)),
                        pa.array(x["gram"]), pa.array(x["around"])],
                        ["id", "text_key", "place", "left", "right", "gram", "around"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text_key long, place long, "
                           "left int, right int, gram long, around long")


# ---------------------------------------------------------------- sorting
def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: multikey quicksort, three ways on one word at a time; small parts directly."""
    out = np.empty(len(words), np.int64)
    todo = [(np.arange(len(words)), 0, 0)]
    while todo:
        rows, depth, at = todo.pop()
        while len(rows) > LEAF and depth < words.shape[1]:
            column = words[rows, depth]
            pivot = np.partition(column[::max(1, len(column) // 63)], 31)[31]
            less, equal = column < pivot, column == pivot
            small, same = rows[less], rows[equal]
            large = rows[~less & ~equal]
            if len(small):
                todo.append((small, depth, at))
            if len(large):
                todo.append((large, depth, at + len(small) + len(same)))
            rows, depth, at = same, depth + 1, at + len(small)
        if depth < words.shape[1] and len(rows) > 1:
            rows = rows[np.lexsort(words[rows, depth:].T[::-1])]
        out[at:at + len(rows)] = rows
    return out


def common_prefixes(sorted_bytes: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before it; 0 for the first."""
    out = np.zeros(len(sorted_bytes), np.int64)
    if len(out) > 1:
        differ = sorted_bytes[1:] != sorted_bytes[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), sorted_bytes.shape[1])
    return out


def padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def sorted_side(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = multikey_order(np.ascontiguousarray(matrix).view(">u8").astype(np.uint64))
    return order, common_prefixes(matrix[order])


def repeated_windows(contexts: list[bytes], left: np.ndarray, right: np.ndarray,
                     many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of sorted suffixes are repeated: (order, shared prefix with the row before, mask).

    ``mask[i, d]``: the window that starts d bytes before anchor i occurs elsewhere. The windows of distance d are
    equal where both the next LENGTH - d bytes and the d bytes before agree; both are runs of neighbours in the two
    sorted orders.
    """
    n = len(contexts)
    after = padded([c[x:x + LENGTH] for c, x in zip(contexts, left.tolist())], LENGTH)
    before = padded([c[:x][::-1] for c, x in zip(contexts, left.tolist())], -(-SPAN // 8) * 8)
    order, shared = sorted_side(after)
    other, shared_left = sorted_side(before)
    mask = np.zeros((n, SPAN), bool)
    for d in range(SPAN):
        rows = np.flatnonzero((right <= d) & (d <= left))
        if not len(rows):
            continue
        ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
        ahead[order] = np.cumsum(shared < LENGTH - d)
        behind[other] = np.cumsum(shared_left < d)
        key = ahead[rows] * (n + 1) + behind[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(rows), bool)
        hit[by[1:]] |= same
        hit[by[:-1]] |= same
        mask[rows[hit | many[rows]], d] = True
    return order, shared, mask


def bucket_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of suffixes: rows (id, first, last, w1, w2, n). Ranges have n = 0; windows that a row of another bucket
    can share are given by two hashes with n = 1, or 2 if found twice here."""
    t = pa.Table.from_batches(list(batches))
    if not len(t):
        return
    ids, place = t["id"].combine_chunks(), t["place"].to_numpy()
    left, right = t["left"].to_numpy().astype(np.int64), t["right"].to_numpy().astype(np.int64)
    contexts, many = t["context"].to_pylist(), t["many"].to_numpy(zero_copy_only=False)
    order, shared, mask = repeated_windows(contexts, left, right, many)
    n = len(order)
    # ranges: runs of distances
    wide = np.zeros((n, SPAN + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, near = np.nonzero(step == 1)
    far = np.nonzero(step == -1)[1] - 1
    yield _rows(ids.take(pa.array(row)), place[row] - far, place[row] - near + LENGTH)
    # A row of another bucket has no longer prefix in common with a row here than the first or the last row here has.
    to_first = np.minimum.accumulate(np.concatenate([[LENGTH], shared[1:]]))
    to_last = np.minimum.accumulate(np.concatenate([[LENGTH], shared[:0:-1]]))[::-1]
    reach = np.empty(n, np.int64)
    reach[order] = np.maximum(to_first, to_last)
    nearest = np.maximum(right, LENGTH - reach)                     # least distance of a window that may go on elsewhere
    edge = np.flatnonzero(nearest <= left)
    raw = np.frombuffer(b"".join(contexts[i] for i in edge), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(contexts[i]) for i in edge])])[:-1]
    one, two = Rolling(), Rolling(0xD6E8FEB86659FD93)
    one.load(raw)
    two.load(raw)
    counts = left[edge] - nearest[edge] + 1
    item = np.repeat(np.arange(len(edge)), counts)
    d = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + nearest[edge][item]
    at = starts[item] + left[edge][item] - d
    h1, h2 = mixed(one.of(at, at + LENGTH)).astype(np.int64), mixed(two.of(at, at + LENGTH)).astype(np.int64)
    times = np.where(mask[edge[item], d], 2, 1)
    first = np.unique(np.stack([h1, h2]), axis=1, return_index=True)[1]
    start = place[edge][item] - d
    yield _rows(ids.take(pa.array(edge[item[first]])), start[first], start[first] + LENGTH, h1[first], h2[first],
                times[first])


def _rows(ids: pa.Array, first: np.ndarray, last: np.ndarray, w1=None, w2=None, n=None) -> pa.RecordBatch:
    zero = np.zeros(len(first), np.int64)
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array(zero if x is None else x, pa.int64()) for x in (first, last, w1, w2, n)]],
        ["id", "first", "last", "w1", "w2", "n"])


# ---------------------------------------------------------------- the operator
def _text_key() -> Column:
    """Names a row with a NULL id by its text."""
    return F.xxhash64(F.lit("text"), "text")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Byte ranges (id, first, last) of ``docs`` (id, text binary) that repeated windows cover; they may overlap."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    found = anchor_table(docs.select("id", "text", F.when(F.col("id").isNull(), _text_key()).alias("text_key")))
    repeated = save_and_reload(found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where("n > 1").select(
        "gram", (F.col("a") == F.col("b")).alias("alike")), f"{folder}/repeated")
    hits = save_and_reload(found.join(repeated, "gram"), f"{folder}/hits")
    kinds = save_and_reload(hits.where("not alike").groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(
            F.col("id").isNull().alias("keyed"), "id", "text_key", "place", "left", "right")).alias("s")), f"{folder}/kinds")
    alike = hits.where("alike").unionByName(hits.where("not alike").join(
        kinds.where("n > 1").select("gram", "around"), ["gram", "around"]))
    whole = alike.select("id", (F.col("place") - F.col("left")).alias("first"),
                         (F.col("place") - F.col("right") + LENGTH).alias("last"))

    cuts = kinds.select("s.id", "s.text_key", F.struct("s.place", "s.left", "s.right", (F.col("n") > 1).alias("many")).alias("cut"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kinds.count() // BUCKET_ROWS))
    context = F.substring(F.col("text"), (F.col("cut.place") - F.col("cut.left") + 1).cast("int"),
                          F.col("cut.left") - F.col("cut.right") + LENGTH).alias("context")
    cut = docs.join(cuts.where(F.col("id").isNotNull()).drop("text_key"), "id").select("id", "cut.*", context)
    nameless = cuts.where(F.col("id").isNull()).drop("id")  # kinds that only rows with a NULL id hold
    if not nameless.isEmpty():
        texts = docs.where(F.col("id").isNull()).groupBy(_text_key().alias("text_key")).agg(
            F.first("id").alias("id"), F.first("text").alias("text"))
        cut = cut.unionByName(texts.join(nameless, "text_key").select("id", "cut.*", context))
    suffix = F.substring(F.col("context"), F.col("left") + 1, F.lit(LENGTH))
    dealt = cut.repartitionByRange(buckets, suffix, F.substring(F.col("context"), F.lit(1), F.col("left")))
    kind = docs.schema["id"].dataType.simpleString()
    judged = dealt.mapInArrow(bucket_ranges, f"id {kind}, first long, last long, w1 long, w2 long, n long")
    alone = F.col("n") == 0
    windows = judged.groupBy(
        F.when(alone, F.xxhash64("id", "first")).otherwise(F.col("w1")).alias("g1"),
        F.when(alone, F.col("last")).otherwise(F.col("w2")).alias("g2"), alone.alias("alone")).agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") < 2, F.struct("id", "first", "last"))).alias("r"))
    return whole.unionByName(windows.where("alone or n > 1").select(F.inline("r")))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest_only: bool = False) -> DataFrame:
    """Remove every byte that a repeated string of 200 bytes covers.

    Rows (id, n_bytes, n_removed, n_spans, kept binary), or kept_sha256 with ``digest_only``. Texts are UTF-8 bytes;
    NULL, empty and shorter texts lose nothing. Every occurrence goes, the first too; overlapping occurrences within
    one text count. Rows that repeat id and text are occurrences of each other. A row with a NULL id stays whole, but
    others lose what they share with it. Other columns are ignored. An id with two different texts is not supported.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    ranges = repeated_ranges(source).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = source.join(ranges, "id", "left")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1)):
                part = batch.slice(a, b - a)
                out = [kept_bytes(t or b"", r) for t, r in zip(
                    part.column(1).to_pylist(), _range_arrays(part.column(2)))]
                kept, removed, spans, size = zip(*out)
                last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest_only else \
                    pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], last],
                    [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest_only else "kept"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, "
                             + ("kept_sha256 string" if digest_only else "kept binary"))


def _range_arrays(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    flat = column.flatten()
    pairs = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1) if len(flat) else None
    at = 0
    for n in column.value_lengths().to_pylist():
        yield pairs[at:at + n] if n else None
        at += n or 0


def kept_bytes(text: bytes, ranges: np.ndarray | None) -> tuple[bytes, int, int, int]:
    """(what stays, bytes removed, maximal removed runs, size) of one text."""
    if ranges is None:
        return text, 0, 0, len(text)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > reach[:-1]]))
    starts = ranges[new, 0].tolist()
    ends = reach[np.concatenate([new[1:] - 1, [len(ranges) - 1]])].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
    return kept, len(text) - len(kept), len(starts), len(text)

"""Pack documents into sequences of nearly equal length by multiway number differencing.

Documents are cut into full sequences and one remainder each. Remainders are collected into groups of a few hundred
sequences; within a group, partial partitions with opposing imbalances are merged, the most uneven two at a time,
until one partition with nearly equal sums is left. Where a sum exceeds the capacity, the number of windows rises by one;
what exceeds it then is cut off and fills up other windows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import offsets_of, slices_by_bytes
from grainscope.llm.wordtokens import END_OF_DOCUMENT, word_tokens

CAPACITY = 4096
GROUP = 256            # windows of one group
SLACK = 1 / 250        # part of a group's capacity that is left for uneven sums


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Window of each piece: the most uneven two partitions are merged, large sums meeting small ones."""
    n = len(lengths)
    of = np.zeros(n, np.int64)
    if windows == 1 or n == 0:
        return of
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)   # a node is a piece or a union of two
    free = n
    # a partition: sums ascending and the node of each sum (-1: empty); a single piece is kept as its node
    heap: list[tuple[int, int, int | tuple[np.ndarray, np.ndarray]]] = [(-int(x), i, i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)

    def full(x: int | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(x, int):
            return x
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = lengths[x], x
        return sums, nodes

    tick = n
    while len(heap) > 1:
        a, b = full(heapq.heappop(heap)[2]), full(heapq.heappop(heap)[2])
        sums = a[0] + b[0][::-1]
        x, y = a[1], b[1][::-1]
        nodes = np.where(x < 0, y, x)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        made = np.arange(free, free + len(both))
        left[made], right[made], nodes[both] = x[both], y[both], made
        free += len(both)
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), tick, (sums, nodes)))
        tick += 1
    owner = np.full(2 * n, -1, np.int64)
    nodes = full(heap[0][2])[1]
    owner[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for node in range(free - 1, n - 1, -1):                                     # unions come after their parts
        owner[left[node]] = owner[right[node]] = owner[node]
    return owner[:n]


def fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, begin, length, window) of the parts of all pieces, window by window, none over the capacity.

    Windows by differencing. Where a sum exceeds the capacity, their number rises by one and differencing runs again; what
    then still exceeds it is cut off and goes to windows with room, which are enough for it. So two runs are the most.
    """
    total = int(lengths.sum())
    windows = max(1, -(-total // capacity))
    if windows > 1:
        windows = max(windows, math.ceil(total / (capacity * (1 - SLACK))))
    of = differencing(lengths, windows)
    if np.bincount(of, lengths, windows).max(initial=0) > capacity:
        windows += 1
        of = differencing(lengths, windows)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.searchsorted(of[order], np.arange(windows))
    before = np.concatenate([[0], ends])[first]                    # ids before each window
    inside = np.clip(before[of[order]] + capacity - (ends - lengths[order]), 0, lengths[order])
    parts = [(order, np.zeros(len(order), np.int64), inside, of[order])]
    over = np.flatnonzero(inside < lengths[order])
    if len(over):
        room = capacity - np.bincount(of[order], inside, windows).astype(np.int64)
        free = np.argsort(-room, kind="stable")
        free = free[room[free] > 0]
        rest = lengths[order][over] - inside[over]
        # both as one line of ids: cut where a piece ends or a window is full
        piece_ends, window_ends = np.cumsum(rest), np.cumsum(room[free])
        cuts = np.union1d(piece_ends, window_ends[window_ends < piece_ends[-1]])
        starts = np.concatenate([[0], cuts[:-1]])
        which = np.searchsorted(piece_ends, starts, side="right")
        begin = inside[over][which] + starts - (piece_ends - rest)[which]
        parts.append((order[over][which], begin, cuts - starts, free[np.searchsorted(window_ends, starts, side="right")]))
    piece, begin, length, window = (np.concatenate(x) for x in zip(*parts))
    keep = np.flatnonzero(length > 0)
    keep = keep[np.argsort(window[keep], kind="stable")]
    return piece[keep], begin[keep], length[keep], window[keep]


class Packer:
    """Pieces in, placed pieces out; holds one group of pieces and their ids."""

    def __init__(self, first_sequence: int, capacity: int, group: int):
        self.sequence, self.capacity = first_sequence, capacity
        self.room = int(group * capacity * (1 - SLACK)) if group > 1 else capacity
        self.pieces: list[tuple] = []           # key, start, ids, document tokens
        self.held = 0
        self.placed: list[tuple] = []           # key, start, ids, document tokens, sequence, offset

    def add(self, key, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.placed.append((key, at, ids[at:at + self.capacity], n, self.sequence, 0))
            self.sequence += 1
            at += self.capacity
        while at < n:
            take = min(n - at, self.room - self.held)
            self.pieces.append((key, at, ids[at:at + take], n))
            self.held += take
            at += take
            if self.held == self.room:
                self.close()

    def close(self) -> None:
        """Place the group that is held."""
        if not self.pieces:
            return
        lengths = np.array([len(p[2]) for p in self.pieces], np.int64)
        piece, begin, length, window = fit(lengths, self.capacity)
        before = offsets_of(length)[:-1]
        _, first, number = np.unique(window, return_index=True, return_inverse=True)
        offset = before - before[first][number]
        for i, a, n, w, at in zip(piece.tolist(), begin.tolist(), length.tolist(), number.tolist(), offset.tolist()):
            key, start, ids, tokens = self.pieces[i]
            self.placed.append((key, start + a, ids[a:a + n], tokens, self.sequence + w, at))
        self.sequence += len(first)
        self.pieces, self.held = [], 0


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_OF_DOCUMENT, group: int = GROUP,
         with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", max_words: int = 700_000,
         slice_bytes: int = 4 << 20) -> DataFrame:
    """Cut the token ids of all texts into pieces and place each piece in a sequence of ``capacity`` ids at most.

    Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<long>]); the pieces of a
    sequence are gapless from offset 0. A NULL or empty text is its end id alone; repeated rows are packed as often
    as they occur; an empty table has no pieces; other columns are ignored. One pass without an exchange: each task
    packs its own documents, at most ``group`` windows of ids at a time, and numbers sequences in a range of its own.
    A worker remembers about ``max_words`` words and cuts ``slice_bytes`` of text at a time; both change its memory only.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def rows(placed: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        key, start, ids, n, sequence, offset = zip(*placed)
        columns = [pa.array(key, key_type), *[pa.array(c, pa.int64()) for c in (
            start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4")) for x in ids], n, sequence, offset)]]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(
                pa.array(offsets_of(np.array([len(x) for x in ids])), pa.int32()),
                pa.array(np.concatenate(ids).astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer, max_words)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, group)
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for a, b in slices_by_bytes(batch.column(1), slice_bytes):
                part = batch.slice(a, b - a)
                ids, lengths = encoder.documents(part.column(1), end)
                cuts = offsets_of(lengths).tolist()
                for key, x, y in zip(part.column(0).to_pylist(), cuts, cuts[1:]):
                    packer.add(key, ids[x:y])
                if packer.placed:
                    yield rows(packer.placed, key_type)
                    packer.placed = []
        packer.close()
        if packer.placed:
            yield rows(packer.placed, key_type)
        pa.default_memory_pool().release_unused()       # workers wait for other stages: only the words are kept

    return source.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, "
                             "doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)

"""Byte-level BPE over many pieces at once: padded matrices of token ids, bucketed by length.

In each round every row merges its leftmost pair of lowest rank; finished rows leave the matrix. Ranks of pairs
come from a hash table in arrays. A piece that is itself a token is one id, as the public library has it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import gather_runs, offsets_of, slices_by_bytes
from grainscope.llm.wordcache import WordCache

NO_PAIR = np.int32(np.iinfo(np.int32).max)
MARKS = tuple(".,;:!?")
WIDEST = 256            # longer pieces are merged one at a time with a heap
CELLS = 1 << 21         # cells of one matrix
SPACE = r"[\x09-\x0d\x20\x85\xa0  -     　]"   # fixed values: Unicode White_Space


def space_class(pattern: str) -> str:
    """The pattern with its white-space classes written out, so that it does not depend on the regex library."""
    inside = SPACE[1:-1]
    return pattern.replace(r"[^\s", "[^" + inside).replace(r"\S", f"[^{inside}]").replace(r"\s", SPACE)


class PairTable:
    """Pair of ids -> id of the merged token, open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self.slot(key)
        todo = np.arange(len(key))
        while len(todo):
            empty = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[empty]] = key[empty]            # the last of several writers stays
            settled = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[settled]]] = merged[todo[settled]]
            todo = todo[~settled]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self.slot(key)
        out = np.full(len(key), NO_PAIR, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (held >= 0)
            todo, slot = todo[more], slot[more] + 1 & (1 << self.bits) - 1
        return out


class ByteBpe(WordCache):
    def __init__(self, path: str, pattern: str, max_words: int = 500_000):
        super().__init__(max_words)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(space_class(pattern))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*np.array(splits, np.int64).T) if splits else PairTable(*np.zeros((3, 0), np.int64))
        self.pair_of = {(a, b): r for a, b, r in splits}
        tokens = sorted((r, t) for t, r in self.ranks.items())
        self.blob = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        sizes = np.zeros(tokens[-1][0] + 1, np.int64)
        sizes[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.token_size, self.token_start = sizes, np.cumsum(sizes) - sizes

    # ---------------------------------------------------------------- encoding
    def cut(self, texts: list[str]) -> list[list[str]]:
        """Cut before each single blank between two other characters: no match of the pattern crosses there."""
        return [t.replace(" ", "\0 ").split("\0") if "\0" not in t else self.cut_exactly(t) for t in texts]

    def unsafe(self, word: str) -> bool:
        """White space beside the cut: blanks may then belong to one match with it."""
        return word != "" and (word[-1].isspace() or word[0] != " " and word[0].isspace() or word[1:2].isspace())

    def cut_exactly(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows: dict[str, int] = {}
        order: list[int] = []
        counts = np.ones(len(words), np.int64)
        for i, w in enumerate(words):
            stem = w[1:] if w[:1] == " " else w
            if stem.isalpha():
                order.append(rows.setdefault(w, len(rows)))
            elif stem[-1:] in MARKS and stem[:-1].isalpha():
                order += rows.setdefault(w[:-1], len(rows)), rows.setdefault(w[-1], len(rows))
                counts[i] = 2
            else:
                found = self.pattern.findall(w)
                order += [rows.setdefault(p, len(rows)) for p in found]
                counts[i] = len(found)
        flat, lengths = self.encode_pieces([p.encode() for p in rows])
        starts = np.cumsum(lengths) - lengths
        at = np.array(order, np.int64)
        sums = offsets_of(lengths[at])
        ends = np.cumsum(counts)
        return flat[gather_runs(starts[at], lengths[at])], sums[ends] - sums[ends - counts]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of many pieces."""
        lengths = np.ones(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []      # rows, ids row by row, lengths
        whole = [(i, self.ranks[p]) for i, p in enumerate(pieces) if p in self.ranks]
        if whole:
            at, ids = np.array(whole).T
            done.append((at, ids.astype(np.int32), np.ones(len(at), np.int64)))
        rest = np.array([i for i, p in enumerate(pieces) if p not in self.ranks], np.int64)
        sizes = np.array([len(pieces[i]) for i in rest], np.int64)
        order = np.argsort(sizes, kind="stable")
        rest, sizes = rest[order], sizes[order]
        first = 0
        while first < len(rest):
            if sizes[first] > WIDEST:
                for i in rest[first:]:
                    ids = self.merge_long(pieces[i])
                    done.append((np.array([i]), ids, np.array([len(ids)])))
                break
            width = min(WIDEST, 4 << int(np.ceil(np.log2(max(sizes[first], 4) / 4))))
            last = min(int(np.searchsorted(sizes, width, "right")), first + max(1, CELLS // width))
            done += [(rest[first:last][r], ids, n) for r, ids, n in self.merge_matrix(
                [pieces[i] for i in rest[first:last]], sizes[first:last])]
            first = last
        for at, _, n in done:
            lengths[at] = n
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        for at, ids, n in done:
            flat[gather_runs(starts[at], n)] = ids
        return flat, lengths

    def merge_matrix(self, pieces: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge rows of similar length; yields (rows, their ids one after the other, lengths) as rows finish."""
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        filled = np.arange(width) < sizes[:, None]
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NO_PAIR, np.int32)         # of the pair that starts there
        pair = filled[:, 1:].nonzero()
        rank[pair] = self.pairs.find(ids[pair], ids[pair[0], pair[1] + 1])
        rows, left = np.arange(len(pieces)), sizes.copy()
        while len(rows):
            at = rank.argmin(axis=1)
            each = np.arange(len(rows))
            best = rank[each, at]
            ended = best == NO_PAIR
            if ended.any():
                n = left[ended]
                yield rows[ended], ids[ended][np.arange(ids.shape[1]) < n[:, None]], n
                go = ~ended
                rows, ids, rank, left, at, best = rows[go], ids[go], rank[go], left[go], at[go], best[go]
                if not len(rows):
                    return
                each = np.arange(len(rows))
            ids[each, at] = best
            source = np.arange(ids.shape[1] - 1)[None, :]               # close the gap at ``at + 1``
            source = source + (source > at[:, None])
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            left -= 1
            rank[each, at] = NO_PAIR
            has = at + 1 < left
            rank[each[has], at[has]] = self.pairs.find(ids[each[has], at[has]], ids[each[has], at[has] + 1])
            has = at > 0
            rank[each[has], at[has] - 1] = self.pairs.find(ids[each[has], at[has] - 1], ids[each[has], at[has]])
            keep = max(1, int(left.max()))
            ids, rank = ids[:, :keep], rank[:, :keep]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, position) and links to the neighbours."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair_of = self.pair_of
        heap = [(pair_of[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pair_of]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pair_of.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                r = pair_of.get((rank, ids[after[i]]))
                if r is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0:
                r = pair_of.get((ids[before[i]], rank))
                if r is not None:
                    heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    # ---------------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after the other."""
        return self.blob[gather_runs(self.token_start[ids], self.token_size[ids])]


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """Token ids of every text and the bytes decoded from them.

    Rows (id, n_tokens, ids array<int>, decoded binary), or with ``digest_only`` (id, n_tokens, ids_sha256,
    decoded_sha256). NULL and empty texts have no tokens. Other columns of ``docs`` are dropped; repeated rows
    stay repeated. One pass without an exchange; a task holds a few megabytes of text at a time.
    """
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest_only else \
        "n_tokens long, ids array<int>, decoded binary"
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, lengths = bpe.encode(part.column(1).to_pylist())
                decoded = bpe.decode(ids)
                cuts = offsets_of(lengths)
                byte_cuts = offsets_of(bpe.token_size[ids])[cuts]
                if digest_only:
                    little = ids.astype("<u4")
                    columns = [
                        pa.array([hashlib.sha256(little[x:y]).hexdigest() for x, y in zip(cuts, cuts[1:])], pa.string()),
                        pa.array([hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(byte_cuts, byte_cuts[1:])],
                                 pa.string())]
                else:
                    columns = [pa.ListArray.from_arrays(cuts.astype(np.int32), ids),
                               pa.array([decoded[x:y].tobytes() for x, y in zip(byte_cuts, byte_cuts[1:])], pa.binary())]
                names = [id_col, "n_tokens", *[c.split()[0] for c in kinds.split(", ")[1:]]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *columns], names)

    return source.mapInArrow(run, f"`{id_col}` {kind}, {kinds}")

"""Group spelling variants: words one inserted, deleted or replaced code point apart, found in dense tiles.

Of two such words the shorter one has m code points, and their common prefix and suffix together have at least m. So
they share their first m // 2 code points, or the last m - m // 2 of the shorter one's length. Words go to tiles by these
ends: one tile holds words of lengths m and m + 1 whose ends fall into the same bucket. A tile compares all its words as
padded code-point matrices; too full a tile is cut into blocks, and every two blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import gather_runs
from grainscope.session import save_and_reload, shared_dir

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 5            # code points of a word
LEAST = 3               # occurrences of a word
TIMES = 2               # how much more frequent a word's form must be
TILE = 256              # words of a tile on average
BLOCK = 512             # words of a block, where a tile has more


def damaged(run: Column, doc: Column, every: int) -> Column:
    """``run`` without one code point where the checksum of ``doc:run`` is divisible by ``every``."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("")), run).cast("binary"))
    k = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.char_length(run)))).otherwise(run)


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97,
             shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points with at least ``least`` occurrences in all texts."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run")).where(
        F.char_length("run") >= shortest)
    return runs.select(damaged(F.col("run"), F.col("id"), every).alias("word")).where(
        F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def tiles(words: DataFrame, folder: str) -> DataFrame:
    """(m, side, tile, lo, hi, block, word, n): each word in its tiles, there once for each other block.

    ``side`` 0 deals by the first m // 2 code points, 1 by the last m - m // 2.
    """
    size, half = F.char_length("word"), F.floor(F.col("m") / 2).cast("int")
    placed = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).select(
        "word", "n", "m", F.posexplode(F.array(F.substring("word", F.lit(1), half), F.right("word", F.col("m") - half))).alias(
            "side", "end"))
    buckets = save_and_reload(words.groupBy(size.alias("size")).count().select(F.explode(F.array(
        F.col("size"), F.col("size") - 1)).alias("m"), "count").groupBy("m").agg(
        F.ceil(F.sum("count") / TILE).alias("buckets")), f"{folder}/buckets")
    dealt = save_and_reload(placed.join(buckets, "m").withColumn(
        "tile", F.pmod(F.xxhash64("end"), F.col("buckets"))).drop("end", "buckets"), f"{folder}/dealt")
    key = ["m", "side", "tile"]
    loads = save_and_reload(dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")),
                            f"{folder}/loads")
    return dealt.join(loads, key).withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "word", "n")


def matrices(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words padded with zeros at the right, and at the left, and the words' lengths."""
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    row, place = np.repeat(np.arange(len(size)), size), gather_runs(np.zeros(len(size), np.int64), size)
    left = np.zeros((len(size), int(size.max(initial=0))), np.uint32)
    right = left.copy()
    left[row, place] = points
    right[row, place + (left.shape[1] - size)[row]] = points
    return left, right, size


def _agreement(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """How many columns in a row each row of ``a`` has in common with each row of ``b``."""
    same = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        same &= a[:, c][:, None] == b[:, c][None, :]
        if not same.any():
            break
        length += same
    return length


def compare_tile(words: pa.Array, block: np.ndarray, m: int, side: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, near words in the tile, the first of them) for rows with a near word; rows are sorted by preference."""
    left, right, size = matrices(words)
    p, q = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    width = left.shape[1]
    prefix = _agreement(left[p], left[q], range(width))
    suffix = _agreement(right[p], right[q], range(width - 1, -1, -1))
    longer = np.maximum(size[p][:, None], size[q][None, :])
    near = (prefix + suffix >= longer - 1) & (np.minimum(size[p][:, None], size[q][None, :]) == m)
    near &= (prefix >= m // 2) if side == 0 else (prefix < m // 2)       # each pair counts in one tile only
    if lo == hi:
        np.fill_diagonal(near, False)
    rows, count, best = [p], [near.sum(axis=1)], [q[near.argmax(axis=1)] if len(q) else p]
    if lo != hi:
        rows.append(q)
        count.append(near.sum(axis=0))
        best.append(p[near.argmax(axis=0)] if len(p) else q)
    rows, count, best = (np.concatenate(x) for x in (rows, count, best))
    some = count > 0
    return rows[some], count[some], best[some]


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``compare_tile`` for tiles that follow each other in a partition."""
    waiting: pa.Table | None = None

    def run(t: pa.Table) -> pa.RecordBatch:
        numbers = np.stack([t[c].to_numpy() for c in ("m", "side", "tile", "lo", "hi")])
        cut = np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1
        word, n, block = t["word"].combine_chunks(), t["n"].to_numpy(), t["block"].to_numpy()
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(t)]):
            m, side, _, lo, hi = numbers[:, a].tolist()
            rows, count, best = compare_tile(word.slice(a, b - a), block[a:b], m, side, lo, hi)
            out.append((rows + a, count, best + a))
        rows, count, best = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays(
            [word.take(pa.array(rows)), pa.array(count, pa.int64()), pa.array(n[best]), word.take(pa.array(best))],
            ["word", "near", "form_n", "form"])

    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if waiting is None else pa.concat_tables([waiting, t])
        last = t.slice(len(t) - 1)
        other = np.zeros(len(t), bool)
        for c in ("m", "side", "tile", "lo", "hi"):
            other |= t[c].to_numpy() != last[c].to_numpy()[0]
        whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if whole:
            yield run(t.slice(0, whole))
        waiting = t.slice(whole)
    if waiting is not None and len(waiting):
        yield run(waiting)


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """(word, n_near, best_n, best): number of near words, and the most frequent of them (the first by code points)."""
    key = ["m", "side", "tile", "lo", "hi"]
    sorted_tiles = tiles(words, folder).repartition(*key).sortWithinPartitions(*key, F.desc("n"), "word")
    found = sorted_tiles.mapInArrow(_compare_sorted, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.form").alias("best"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of all words of ``forms`` (word, form): forms followed to the last, by doubling steps.

    A form is at least TIMES as frequent as its word, so chains end and their length is the logarithm of a frequency."""
    at, turn = save_and_reload(forms.select("word", F.col("form").alias("root")), f"{folder}/roots0"), 0
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turn += 1
        moved = save_and_reload(at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{folder}/roots{turn}")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word of the texts.

    Runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z only; where ``every`` divides the CRC-32 of
    ``<id>:<run>``, one code point of the run is left out (a rule that plants misspellings). Words are the results of at
    least SHORTEST code points that occur at least LEAST times; n counts occurrences. Near words differ by one inserted,
    deleted or replaced code point. ``form`` is the near word of largest n, the first by code points among equals, if
    that is at least TIMES the word's n, else NULL, and ``form_n`` its n; ``root`` is the last word when forms are
    followed. NULL and empty texts have no runs; a NULL id is read as an empty one; repeated rows count each. Other columns
    are ignored. An empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession)
    words = save_and_reload(words_of(docs, id_col, text_col, every), f"{folder}/words")
    near = words.join(near_words(words, folder), "word", "left")
    strong = F.col("best_n") >= F.col("n") * TIMES
    judged = save_and_reload(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"),
        F.when(strong, F.col("best_n")).alias("form_n")), f"{folder}/judged")
    last = roots(judged.where("form is not null").select("word", "form"), folder)
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

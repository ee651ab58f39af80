"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations learned on a bounded sample make signs of projections balanced and close to the data. Codes are cut into parts
with a table each; a table joins codes with equal parts. Every pair that meets is compared by cosine on the original
vectors, whatever its Hamming distance: codes that differ in fewer bits than there are tables always meet (pigeonhole),
and there are so many tables that a pair at the threshold itself meets nowhere with probability ``MISS`` at most.
``plan_tables`` takes the chance that a bit differs from the data, since subtracting the mean of vectors that share a
direction widens the angles; where tables would cost more than comparing everything, everything is compared. Equal vectors
are one. A bucket with many vectors is compared in blocks inside tasks, which give the number of links of each vector and
one link to hold it, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.graph import components, local_links
from grainscope.llm.vectors import common_size, matrix, sample, usable
from grainscope.session import save_and_reload, shared_dir

PART = 16                 # bits of a part where nothing else is given; plan_tables chooses them
MOST_BITS = 32            # of a part
MISS = 0.001              # chance that a pair at the threshold meets in no table
ROW = 20                  # a row of a table costs as much as so many compared pairs
LEAST_NORM = 0.01         # share of vectors that may be nearer to the mean than the norm that plan_tables counts with
SAMPLE = 20_000           # rows of the training sample
ROUNDS = 40
HOT = 256                 # vectors of a bucket that is compared in blocks
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan_tables(x: np.ndarray, n: int, threshold: float) -> tuple[int, int]:
    """(bits of a part, tables) for ``n`` vectors of which the unit vectors ``x`` are a sample.

    Two vectors at the threshold are sqrt(2 - 2 threshold) apart; seen from the mean, at the norm that all but
    ``LEAST_NORM`` of the vectors exceed, that is an angle, and a bit differs with probability angle / pi. Longer parts
    make smaller buckets and need more tables; the cheapest pair of both has a chance of ``MISS``. Parts of no bits are
    one bucket with everything.
    """
    norm = np.quantile(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)), LEAST_NORM)
    half = np.sqrt(max(0.0, (1 - threshold) / 2))
    differ = 2 / np.pi * np.arcsin(half / norm) if norm > half else 1.0
    best = (n / 2, 0, 1)
    for part in range(1, MOST_BITS + 1):
        meet = (1 - differ) ** part
        if meet < 1e-6:
            break
        tables = int(np.ceil(np.log(MISS) / np.log1p(-meet))) if meet < 1 else 1
        best = min(best, (tables * (ROW + n / 2 ** (part + 1)), part, tables))
    return best[1], best[2]


def learn_projection(x: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` columns) for unit vectors: principal axes, then rotations that alternate between
    the nearest binary codes and the best rotation for them. Fewer axes than bits are rotated several times; all axes
    take part, so angles stay as they are."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    axes = np.linalg.eigh(np.cov(x - mean, rowvar=False).reshape(x.shape[1], -1) if len(x) > 1 else
                          np.eye(x.shape[1]))[1][:, ::-1]
    v = (x - mean) @ axes
    parts = [np.zeros((x.shape[1], 0))]
    while sum(p.shape[1] for p in parts) < bits:
        rotation = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        parts.append(axes @ rotation)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def per_word(part: int) -> int:
    """Parts in a word of 64 bits."""
    return 64 // part if part else 1


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, part: int, tables: int) -> np.ndarray:
    """Codes as rows of 64-bit words, each with ``per_word(part)`` parts from its lowest bits on."""
    bits = ((unit(x) - mean) @ projection >= 0).reshape(len(x), tables, part)
    keys = (bits.astype(np.uint64) << np.arange(part, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    per = per_word(part)
    words = np.zeros((len(x), -(-tables // per)), np.uint64)
    for t in range(tables):
        words[:, t // per] |= keys[:, t] << np.uint64(part * (t % per))
    return words.astype(np.int64)


def _part(x: Column, t: int, part: int = PART) -> Column:
    return F.shiftrightunsigned(x, part * t).bitwiseAND(F.lit((1 << part) - 1).cast("long"))


def first_meeting(x: Column, part: int = PART) -> Column:
    """First part in which two words, given by the bits in which they differ, are equal; NULL if there is none."""
    out = F.lit(None).cast("int")
    for t in reversed(range(per_word(part))):
        out = F.when(_part(x, t, part) == 0, t).otherwise(out)
    return out


def first_meeting_np(x: np.ndarray, part: int = PART) -> np.ndarray:
    """The same for arrays; -1 if there is none."""
    out = np.full(x.shape, -1)
    for t in reversed(range(per_word(part))):
        out = np.where((x >> np.uint64(part * t)) & np.uint64((1 << part) - 1) == 0, t, out)
    return out


def link_near_vectors(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                      vector_col: str = "embedding") -> DataFrame:
    """One row per row: (id, n_links, component_id, kept).

    Two vectors are linked when their cosine, in double precision, is ``threshold`` or more; of the pairs just at the
    threshold about ``MISS`` may be overlooked, of closer ones fewer.
    ``n_links`` counts linked rows, copies included; the component is named by its smallest id, and ``kept`` marks that
    row. Vectors that are NULL, zero, of an unusual size, or hold NULL or non-finite components are linked with
    nothing, nor are rows with a NULL id. Other columns are ignored; rows that repeat an id are copies of each other.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark)
    size = common_size(rows, vector_col)
    ids = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    good = ids.where(F.col("id").isNotNull() & usable(F.col("vector"), size))
    bad = ids.where(~(F.col("id").isNotNull() & usable(F.col("vector"), size))).select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
        F.col("id").isNotNull().alias("kept"))
    if not size or good.isEmpty():
        return bad

    # equal vectors are one
    h = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    classes = save_and_reload(good.groupBy(*h).agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), f"{folder}/classes")
    learned = unit(sample(classes, "rep", "vector", SAMPLE))
    part, tables = plan_tables(learned, classes.count(), threshold) if len(learned) else (0, 1)
    mean, projection = learn_projection(learned, part * tables) if part else (np.zeros(size), np.zeros((size, 0)))
    per = per_word(part)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes(
                matrix(batch.column(1), size), mean, projection, part, tables)), pa.list_(pa.int64()))],
                ["id", "vector", "copies", "code"])

    kind = classes.schema["vector"].dataType.simpleString()
    coded = save_and_reload(classes.select(F.col("rep").alias("id"), "vector", "copies").mapInArrow(
        encode, f"id long, vector {kind}, copies long, code array<long>"), f"{folder}/coded")

    # tables: parts of the code
    keys = F.array(*[F.struct(F.lit(t).alias("slot"), _part(F.get("code", F.lit(t // per)), t % per, part).alias("key"))
                     for t in range(tables)])
    table = coded.select("id", "code", F.inline(keys))
    hot = save_and_reload(table.groupBy("slot", "key").count().where(F.col("count") > HOT).withColumn(
        "blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), f"{folder}/hot")

    # buckets of ordinary size: pairs, each where it meets first
    cold = table.join(hot.select("slot", "key"), ["slot", "key"], "left_anti")
    left = cold.select("slot", "key", F.col("id").alias("a"), F.col("code").alias("ca"))
    right = cold.select("slot", "key", F.col("id").alias("b"), F.col("code").alias("cb"))
    meeting = F.coalesce(*[F.lit(w * per) + first_meeting(F.get("ca", F.lit(w)).bitwiseXOR(F.get("cb", F.lit(w))), part)
                           for w in range(-(-tables // per))])
    pairs = left.join(right, ["slot", "key"]).where((F.col("a") < F.col("b")) & (meeting == F.col("slot"))).select("a", "b")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = matrix(batch.column(2), size), matrix(batch.column(3), size)
            c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[4:]],
                                             ["a", "b", "na", "nb"]).filter(pa.array(c >= threshold))

    vector_a = coded.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("copies").alias("na"))
    vector_b = coded.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("copies").alias("nb"))
    linked = save_and_reload(pairs.join(vector_a, "a").join(vector_b, "b").select(
        "a", "b", "va", "vb", "na", "nb").mapInArrow(cosine, "a long, b long, na long, nb long"), f"{folder}/linked")

    # larger buckets: blocks of vectors against blocks, inside tasks
    dealt = coded.select("id", "vector", "copies", "code", F.inline(keys)).join(hot, ["slot", "key"]).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "slot", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own",
        "id", "vector", "copies", "code")

    def compare(t: pa.Table) -> pa.Table:
        slot, lo, hi = (t[c][0].as_py() for c in ("slot", "lo", "hi"))
        own, vid, n = t["own"].to_numpy(), t["id"].to_numpy(), t["copies"].to_numpy()
        x, code = matrix(t["vector"], size), t["code"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        norm = np.sqrt((x * x).sum(axis=1))
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        ok = (x[p] @ x[q].T) / (norm[p][:, None] * norm[q][None, :]) >= threshold
        i, j = np.nonzero(ok)
        met = np.zeros(len(i), bool)                     # in an earlier table
        for w in range(slot // per + 1):
            place = first_meeting_np((code[p[i], w] ^ code[q[j], w]).astype(np.uint64), part)
            met |= (place >= 0) & (w * per + place < slot)
        ok[i[met], j[met]] = False
        if lo == hi:
            np.fill_diagonal(ok, False)
        counted = [(vid[p], ok @ n[q])] if lo == hi else [(vid[p], ok @ n[q]), (vid[q], n[p] @ ok)]
        ids, links = (np.concatenate(v) for v in zip(*counted))
        held, to = local_links(ok, vid[p], vid[q])
        return pa.table({"id": np.concatenate([ids, held]), "links": np.concatenate([links, np.zeros(len(held), np.int64)]),
                         "to": np.concatenate([ids, to])}).filter(pa.array(
                             np.concatenate([links > 0, held != to])))

    blocks = save_and_reload(dealt.groupBy("slot", "key", "lo", "hi").applyInArrow(
        compare, "id long, links long, to long"), f"{folder}/blocks")

    counts = linked.select(F.col("a").alias("id"), F.col("nb").alias("links")).unionByName(
        linked.select(F.col("b").alias("id"), F.col("na").alias("links"))).unionByName(blocks.select("id", "links"))
    n_links = counts.groupBy("id").agg(F.sum("links").alias("links"))
    edges = linked.select("a", "b").unionByName(blocks.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    joined = components(edges)
    labels = save_and_reload(classes.select("h1", "h2", "rep", "copies").join(
        n_links.withColumnRenamed("id", "rep"), "rep", "left").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id")), f"{folder}/labels")
    return good.select("id", *h).join(labels, ["h1", "h2"]).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")).unionByName(bad)

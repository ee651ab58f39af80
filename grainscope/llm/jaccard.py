"""Near-duplicate documents: an exact Jaccard self join on word shingles by prefixes of grouped documents.

1. Each document becomes a set of 63-bit shingle hashes. Documents with equal sets form a class; one stands for all,
   and only its shingles are counted.
2. Sets of similar size are compared within the hashes below a bound of that size class (all hashes, for small sets).
   Two similar sets miss at most ``allowed(n)`` shingles of each other, so they share at least (hashes below the bound
   - allowed). Shingles are counted over all documents; documents with too few shared ones leave here.
3. The rest is counted again on whole sets. What nobody else holds is missed by every other set, so documents with more
   than ``allowed(n)`` such shingles leave too. The rarest of the shared shingles form the prefix; the smaller of two sets
   misses at most n / 9, so a shorter part of its prefix is enough.
4. Documents with equal size and prefix are one group. Groups meet on the shingles of their prefixes; small buckets give
   pairs of groups, which are expanded to members and verified on the shared shingles. Large buckets are compared in
   blocks inside tasks, which give one link to the smallest member of each locally connected part, not pairs.

Each round writes a table and deletes what it has read, so the disk holds one round at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import slices_by_bytes
from grainscope.llm.graph import components, local_links
from grainscope.llm.hashing import ORDER_CODES, Rolling, mixed
from grainscope.llm.stored import discard, stored
from grainscope.session import shared_dir

WORDS = 5
PERCENT = 80
SMALL = 64              # sets up to this size are compared on all hashes
SPREADS = 4.0           # standard deviations between the expected number of hashes below a bound and the least needed
HOT = 64                # members of a bucket that is compared in blocks
BLOCK = 512             # members of a block
NULL_KEYS = 1 << 62     # keys of rows without an id begin here
WIDTH = 4096            # shingles compared at once
TOP = float(1 << 63)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Shingler:
    """Shingle sets of many texts at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.rolling = Rolling()

    def word_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of lower-cased bytes."""
        full = np.concatenate([[False], ~BLANK[raw], [False]])
        edge = np.flatnonzero(full[1:] != full[:-1])
        start, end = edge[::2], edge[1::2]
        self.rolling.load(raw)
        return mixed(self.rolling.of(start, end) + (end - start).astype(np.uint64)), start

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ascending distinct 63-bit hashes of the shingles of each text."""
        joined = b"\n".join(texts).lower()
        h, start = self.word_hashes(np.frombuffer(joined, np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
        k = self.words
        rolled = h[:max(0, len(h) - k + 1)] * ORDER_CODES[0]
        for j in range(1, k):
            rolled = rolled + h[j:len(h) - k + 1 + j] * ORDER_CODES[j]
        rolled = mixed(rolled) >> np.uint64(1)
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= k:
                out.append(np.unique(rolled[a:b - k + 1]))
            elif b > a:
                short = (h[a:b] * ORDER_CODES[8:8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mixed(np.array([short])) >> np.uint64(1))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def level(n):
    """Size class k >= 1: SMALL * 2 ** (k - 1) < n <= SMALL * 2 ** k; 0 up to SMALL."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / SMALL))).astype(np.int64)


def bound(k):
    """Hashes of size class k below this value are compared."""
    share = 1 - PERCENT / 100
    smallest = SMALL * 2.0 ** (np.asarray(k) - 1)
    return np.where(np.asarray(k) == 0, TOP, np.minimum(
        1.0, share + SPREADS * np.sqrt(share * (1 - share) / smallest)) * TOP)


def levels_of(n: int) -> list[int]:
    """The class of n and the one below it, if a set of that class can be similar."""
    k = int(level(n))
    return [k] if k == 0 or n * PERCENT > SMALL * 2 ** (k - 1) * 100 else [k, k - 1]


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """(id, n, d1, d2, low): set size, a 128-bit digest of the set, and the compared hashes in ascending order.

    ``low`` holds the hashes below the bound. With ``whole``: (id, set), all hashes.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1), 2 << 20):
                part = batch.slice(a, b - a)
                sets = shingler.sets([t or b"" for t in part.column(1).to_pylist()])
                if whole:
                    lists = sets
                    columns = [part.column(0)]
                    names = ["id", "set"]
                else:
                    n = [len(s) for s in sets]
                    lists = []
                    for s in sets:
                        if len(s):
                            most = float(bound(min(levels_of(len(s)))))
                            lists.append(s if most >= TOP else s[:int(np.searchsorted(s, np.uint64(most)))])
                        else:
                            lists.append(s)
                    columns = [part.column(0), pa.array(n, pa.int64()),
                               *[pa.array([int(mixed(s + np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64))
                                           for s in sets], pa.int64()) for seed in (1, 77)]]
                    names = ["id", "n", "d1", "d2", "low"]
                flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, set array<long>" if whole else
                             f"id {kind}, n long, d1 long, d2 long, low array<long>")


def _allowed(n: Column) -> Column:
    return n - F.floor((n * PERCENT + 99) / 100)


def _similar_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _level_table(spark, most: int) -> DataFrame:
    """One row per size class: sizes and bound; a few dozen rows at most."""
    top = int(level(most)) if most else 0
    return spark.createDataFrame([
        (k, 0 if k == 0 else SMALL * 2 ** (k - 1), (SMALL * 2 ** k * 100) // PERCENT,
         int(min(float(bound(k)), TOP - 1024))) for k in range(top + 1)], "k int, over long, upto long, bound long")


def representatives(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """One row (id, n, low) of each class of equal sets. Only classes with several rows are grouped."""
    key = ["n", "d1", "d2"]
    several = classes.where("rows > 1").select(*key)
    once = sets.join(several, key, "left_anti").select(F.col("id").cast("long").alias("id"), "n", "low")
    return once.unionByName(sets.join(several, key, "left_semi").groupBy(*key).agg(
        F.min("id").cast("long").alias("id"), F.first("low").alias("low")).select("id", "n", "low"))


def survivors(sets: DataFrame, folder: str) -> DataFrame:
    """Ids (id) of the documents that can have a similar one, judged by their hashes below the bound. Too few hashes
    to judge count as a pass."""
    spark = sets.sparkSession
    tokens = sets.select("id", F.explode("low").alias("token"))
    shared = stored(tokens.groupBy("token").count().where("count > 1").select("token"), f"{folder}/shared")
    held = tokens.join(shared, "token").groupBy("id").agg(F.collect_set("token").alias("held"))
    most = sets.agg(F.max("n")).first()[0] or 0
    levels = _level_table(spark, most)
    sizes = sets.select("id", "n", "low").crossJoin(F.broadcast(levels)).where(
        (F.col("n") > F.col("over")) & (F.col("n") <= F.col("upto"))).select(
        "id", "n", "k", "bound", F.when(F.col("k") == 0, F.size("low")).otherwise(
            F.size(F.filter("low", lambda t: t < F.col("bound")))).alias("below"))
    own = F.when(F.col("held").isNull(), 0).otherwise(F.size(F.filter(
        "held", lambda t: (F.col("k") == 0) | (t < F.col("bound")))))
    wanted = stored(sizes.join(held, "id", "left").where(F.col("below") - own <= _allowed(F.col("n"))).select(
        "id").distinct(), f"{folder}/survivors")
    discard(spark, f"{folder}/shared")
    return wanted


def prefixes(chosen: DataFrame, folder: str) -> DataFrame:
    """Of whole sets (id, set): (id, n, own, longer, shorter). ``own`` holds the shingles that others hold too, rarest
    first; its first ``longer`` and ``shorter`` entries are the prefixes."""
    tokens = chosen.select("id", F.explode("set").alias("token"))
    shared = stored(tokens.groupBy("token").count().where("count > 1"), f"{folder}/shared2")
    held = tokens.join(shared, "token").groupBy("id").agg(F.transform(F.array_sort(F.collect_set(
        F.struct(F.col("count").alias("c"), "token"))), lambda s: s["token"]).alias("own"))
    n = F.col("n")
    alone = n - F.size("own")
    found = held.join(chosen.select("id", F.size("set").cast("long").alias("n")), "id").where(alone <= _allowed(n))
    kept = stored(found.select(
        "id", "n", "own", (_allowed(n) + 1 - alone).cast("int").alias("longer"),
        F.greatest(F.lit(0), F.floor(n / 9) + 1 - alone).cast("int").alias("shorter")), f"{folder}/prefixes")
    discard(chosen.sparkSession, f"{folder}/shared2")
    return kept


def _similar(size_a: Column, size_b: Column, both: Column) -> Column:
    return both * 100 >= (size_a + size_b - both) * PERCENT


def compare_block(t: pa.Table) -> pa.Table:
    """Links within one block of a large bucket: each row with the smallest id of its connected part."""
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    block, ids, n = t["block"].to_numpy(), t["id"].to_numpy(), t["n"].to_numpy()
    own = t["own"].combine_chunks()
    sizes = own.value_lengths().to_numpy()
    token, inverse, count = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), sizes)
    useful = count[inverse] > 1
    p, q = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    both = np.zeros((len(p), len(q)), np.float32)
    place = np.cumsum(count > 1) - 1
    row, column = row[useful], place[inverse[useful]]
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, WIDTH):          # a few thousand shingles at a time
        part = (column >= a) & (column < a + WIDTH)
        x = np.zeros((len(ids), WIDTH), np.float32)
        x[row[part], column[part] - a] = 1
        both += x[p] @ x[q].T
    union = n[p][:, None] + n[q][None, :] - both
    ok = both * 100 >= union * PERCENT
    if lo == hi:
        np.fill_diagonal(ok, False)
    a, b = local_links(ok, ids[p], ids[q])
    return pa.table({"a": pa.array(b, pa.int64()), "b": pa.array(a, pa.int64())})


def link_documents(found: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) that connect all similar documents of ``prefixes``."""
    placed = found.select("id", "n", "shorter", F.slice("own", F.lit(1), F.col("longer")).alias("prefix"))
    key = ["n", "shorter", "prefix"]
    groups = stored(placed.groupBy(*key).agg(F.min("id").alias("lead")), f"{folder}/groups")
    members = stored(placed.join(groups, key).select("id", "lead"), f"{folder}/members")
    bucketed = groups.select("lead", "n", "shorter", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "lead", "n", (F.col("pos") < F.col("shorter")).alias("short"))
    in_bucket = members.join(bucketed, "lead").select("token", "id", "lead", "n", "short")
    loads = stored(in_bucket.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.count_if("short").alias("shorts")).where("size > 1 and shorts > 0").select(
        "token", F.when(F.col("size") > HOT, F.ceil(F.col("size") / BLOCK)).otherwise(0).cast("int").alias("blocks")),
        f"{folder}/loads")

    # small buckets: pairs of groups, then their members
    cold = bucketed.join(loads.where("blocks = 0").select("token"), "token")
    small = cold.where("short").select("token", F.col("lead").alias("la"), F.col("n").alias("na"))
    large = cold.select("token", F.col("lead").alias("lb"), F.col("n").alias("nb"))
    group_pairs = small.join(large, "token").where(
        (F.col("nb") >= F.col("na")) & _similar_size(F.col("na"), F.col("nb"))).select("la", "lb").distinct()
    a, b = members.select(F.col("lead").alias("la"), F.col("id").alias("a")), members.select(
        F.col("lead").alias("lb"), F.col("id").alias("b"))
    pairs = group_pairs.join(a, "la").join(b, "lb").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own_a = found.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("own").alias("oa"))
    own_b = found.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"))
    linked = stored(pairs.join(own_a, "a").join(own_b, "b").where(_similar(
        F.col("na"), F.col("nb"), F.size(F.array_intersect("oa", "ob")))).select("a", "b"), f"{folder}/linked")

    # large buckets: blocks against blocks
    hot = in_bucket.join(loads.where("blocks > 0"), "token").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id")
    dealt = hot.join(found.select("id", "n", "own"), "id")
    blocks = stored(dealt.groupBy("token", "lo", "hi").applyInArrow(
        compare_block, "a long, b long").distinct(), f"{folder}/blocks")
    return linked.unionByName(blocks)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id).

    Two documents are linked when the Jaccard coefficient of their sets of five-word shingles is 0.8 or more; the
    component is named by its smallest id. NULL, empty and blank texts have no shingles and are linked with nothing;
    a shorter text than five words is one shingle. Rows with equal ids count as one document in the graph; a row
    with a NULL id is linked through its copies only. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    wide = stored(shingle_sets(docs, id_col, text_col), f"{folder}/wide")
    sets = stored(wide.select("id", "n", "d1", "d2"), f"{folder}/sets")
    some = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = stored(sets.where(some).groupBy("n", "d1", "d2").agg(
        F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("rows")), f"{folder}/classes")
    reps = stored(representatives(wide.where(some), classes), f"{folder}/reps")
    discard(spark, f"{folder}/wide")
    wanted = survivors(reps, folder)
    discard(spark, f"{folder}/reps")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        wanted, "id", "left_semi").dropDuplicates(["id"])
    chosen = stored(shingle_sets(texts, "id", "text", whole=True), f"{folder}/chosen")
    found = prefixes(chosen, folder)
    discard(spark, f"{folder}/chosen")
    joined = components(link_documents(found, folder))
    discard(spark, f"{folder}/prefixes")
    labels = stored(classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("component_id")), f"{folder}/labels")
    return sets.join(labels, ["n", "d1", "d2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one that has the id which names it.

    Rows that repeat an id and its text are one document, so one of them stays. A row with a NULL id is compared like
    the others, under a key from its text above the usual ids: it leaves when a row with an id below 2^62 is in its
    component, and of rows with NULL ids alone one stays. Rows with a NULL id and no shingles all stay.
    """
    folder = shared_dir(docs.sparkSession)
    text_hash = F.xxhash64(F.lit("row"), text_col)
    key = F.coalesce(F.col(id_col).cast("long"), text_hash.bitwiseAND(F.lit(NULL_KEYS - 1)).bitwiseOR(F.lit(NULL_KEYS)))
    found = stored(similar_components(docs.select(key.alias("id"), F.col(text_col).alias("text")), "id", "text"),
                            f"{folder}/components")
    others = found.where("component_id <> id").select("id").distinct()
    again = stored(found.where("component_id = id").groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")).where(
        (F.col("rows") > 1) & ((F.col("n") > 0) | (F.col("id") < NULL_KEYS))).select("id"), f"{folder}/again")
    row = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), text_hash.alias("_text_hash"))
    if again.isEmpty():
        return row.join(others, row["_key"] == others["id"], "left_anti").select("_row.*")
    leave = others.unionByName(again)
    once = row.join(leave, row["_key"] == leave["id"], "left_anti").select("_row")
    # the first row, by a hash of its values, of each repeated id and text
    repeated = row.join(again, row["_key"] == again["id"], "left_semi").groupBy("_key", "_text_hash").agg(
        F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")

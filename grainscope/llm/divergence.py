"""How the sources of a language differ in their terms: exact integer divergences from columnar counts.

Terms are cut, lower-cased, coded and counted with Arrow compute inside tasks; Spark adds the partial counts, keeps the
terms of enough documents, and deals each language's terms over shards. A shard's counts are one integer matrix (terms by
sources), from which it gives partial sums for all pairs of sources and its leading terms per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainscope.llm.batches import slices_by_bytes
from grainscope.session import save_and_reload, shared_dir

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"     # what is not in a term
LEAST = 3               # documents that hold a kept term
TOP = 200
HELD = 400_000          # partial counts that a task holds before it passes them on
SHARD_ROWS = 50_000     # counts of one shard
CELLS = 1 << 21         # cells of a matrix at once


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """Partial counts (lang, source, term, n, df) of a batch (text, lang, source); a row with a NULL term for each group."""
    text, lang, source = (pc.fill_null(batch.column(i), "") for i in range(3))
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    many = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
    lists = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    terms, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(terms), 0)
    coded = terms.filter(full).dictionary_encode()
    per_doc = pa.table({"doc": doc.filter(full), "term": coded.indices}).group_by(
        ["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    per_group = pa.table({"group": group[per_doc["doc"].to_numpy()], "term": per_doc["term"],
                          "n": per_doc["count_all"]}).group_by(["group", "term"], use_threads=False).aggregate(
        [("n", "sum"), ([], "count_all")])
    seen = np.unique(group)
    g = np.concatenate([per_group["group"].to_numpy(), seen])
    none = pa.nulls(len(seen), pa.string())
    zero = np.zeros(len(seen), np.int64)
    return pa.table({
        "lang": langs.dictionary.take(pa.array(g // many)), "source": sources.dictionary.take(pa.array(g % many)),
        "term": pa.chunked_array([*pc.take(coded.dictionary, per_group["term"]).chunks, none], pa.string()),
        "n": np.concatenate([per_group["n_sum"].to_numpy(), zero]),
        "df": np.concatenate([per_group["count_all"].to_numpy(), zero])})


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate(
        [("n", "sum"), ("df", "sum")]).rename_columns(["lang", "source", "term", "n", "df"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """``term_counts`` of ``docs`` (text, lang, source), added up within tasks as far as memory allows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(0)):
                parts.append(term_counts(batch.slice(a, b - a)))
                rows += len(parts[-1])
                if rows > HELD:
                    total = _added(parts)
                    if 2 * len(total) > HELD:
                        yield from total.to_batches(1 << 16)
                        parts, rows = [], 0
                    else:
                        parts, rows = [total], len(total)
        if parts:
            yield from _added(parts).to_batches(1 << 16)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, lead): counts of the terms that at least ``least`` documents of their language hold.
    ``lead`` marks one row of each (lang, term)."""
    total = counts.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    return total.withColumn("held", F.sum("df").over(term)).withColumn(
        "lead", F.row_number().over(term.orderBy("source")) == 1).where(F.col("held") >= least).select(
        "lang", "source", "term", "n", "lead")


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10 ** 9 * count / total), exactly, for count <= total < 9.2 * 10 ** 15: three digits at a time."""
    whole, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest %= total
    return whole + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compare_shard(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Rows (lang, source, part, item, value) of one language's shard: the sum over its terms for each two sources, and the
    ``top`` leading terms of each source. ``groups`` holds (lang, source, whole, n, terms) of all sources and the language."""
    whole = groups["whole"].to_numpy(zero_copy_only=False)
    names = groups["source"].combine_chunks().filter(pa.array(~whole))
    totals = groups["n"].to_numpy()[~whole] + groups["terms"].to_numpy()[~whole]
    everything = int((groups["n"].to_numpy() + groups["terms"].to_numpy())[whole][0])
    lang, k = groups["lang"][0].as_py(), len(names)
    sums = np.zeros((k, k), np.int64)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    vocabulary = counts["term"].combine_chunks().unique()
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    row = pc.index_in(counts["term"], vocabulary).to_numpy().astype(np.int64)
    column = pc.index_in(counts["source"], names).to_numpy().astype(np.int64)
    n = counts["n"].to_numpy()
    order = np.argsort(row, kind="stable")
    step = max(1, CELLS // max(1, k))
    for a in range(0, len(vocabulary), step):
        b = min(a + step, len(vocabulary))
        part = order[np.searchsorted(row[order], a):np.searchsorted(row[order], b)]
        c = np.zeros((b - a, k), np.int64)
        c[row[part] - a, column[part]] = n[part]
        p = np.stack([share(c[:, j] + 1, int(totals[j])) for j in range(k)], axis=1)
        q = share(c.sum(axis=1) + 1, everything)
        for j in range(k):
            sums[j] += _gap(p[:, j:j + 1], p).sum(axis=0)
            over = np.flatnonzero((c[:, j] > 0) & (p[:, j] > q))
            value = _gap(p[over, j], q[over])
            best = np.lexsort((over, -value))[:top]
            found.append((j, over[best] + a, value[best]))
    i, j = np.nonzero(~np.eye(k, dtype=bool))
    who = np.concatenate([i, *[np.full(len(t), s) for s, t, _ in found]]).astype(np.int64)
    term = np.concatenate([np.zeros(0, np.int64), *[t for _, t, _ in found]])
    value = np.concatenate([sums[i, j], *[v for _, _, v in found]])
    return pa.table({
        "lang": pa.array([lang] * len(who), pa.string()), "source": names.take(pa.array(who)),
        "part": pa.array(["pair"] * len(i) + ["term"] * len(term), pa.string()),
        "item": pa.chunked_array([names.take(pa.array(j)), vocabulary.take(pa.array(term))], pa.string()),
        "value": pa.array(value, pa.int64())})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least: int = LEAST, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every occurring (lang, source).

    A term is a run of letters A-Z, a-z and of characters from U+0080 on; only A-Z are lower-cased. A language keeps the V
    terms that at least ``least`` of its rows hold. A group with ``count`` occurrences of a kept term and N of all gives
    it p = 1 + floor(10^9 * (count + 1) / (N + V)); a language likewise. The gap of p to q is floor((p - q)^2 / q).
    Part ``pair``: each other source of the language with the sum of gaps over all kept terms (0 if there is none).
    Part ``term``: kept terms of the group that are more frequent there than in the language, by gap, to rank ``top``.
    Ranks begin at 1, larger values first, then items by their UTF-8 bytes.

    NULL text, lang and source are read as empty strings; an empty text has no terms, but its group occurs. Each row is
    a document, repeated rows too. Other columns are ignored. An empty table gives no rows.

    Sources are compared with all others of their language, as the result has a row for each such pair. A shard holds
    about SHARD_ROWS counts and the list of its language's sources; matrices are made for CELLS cells at a time.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(source_col).cast("string").alias("source"))
    partial = save_and_reload(partial_counts(source), f"{folder}/partial")
    kept = save_and_reload(kept_terms(partial, least), f"{folder}/kept")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.count_if("lead").alias("terms"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = partial.select("lang").distinct().join(by_lang, "lang", "left").select(
        "lang", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = partial.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.lit(False).alias("whole"), F.coalesce("n", F.lit(0)).alias("n"), "terms").unionByName(
        langs.select("lang", F.lit("").alias("source"), F.lit(True).alias("whole"), F.col("all").alias("n"), "terms"))
    shards = kept.count() // SHARD_ROWS + 1      # by the data alone: each shard gives all pairs of sources
    left = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "n")
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(
        lambda a, b: compare_shard(a, b, top), "lang string, source string, part string, item string, value long")
    found = save_and_reload(found, f"{folder}/found")
    # a term is in one shard; a pair has a part in each
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select(
        "lang", "source", "part", "item", "value", "rank")

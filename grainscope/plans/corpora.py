"""Queries on sources, validation, splits, numbering, unions and stores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from grainscope.functions.columns import comparable_group, fixed, string_keys
from grainscope.operators import corpus as C
from grainscope.plans import tables as T
from grainscope.plans.registry import query
from grainscope.plans.sqltext import DOC_PX, stages
from grainscope.schemas import PHOTO
from grainscope.session import shared_dir
from grainscope.sources import images as I
from grainscope.sources import rasters as S
from grainscope.sources import stores as ST


# ---------------------------------------------------------------- sources and stores
@query("decode_and_quarantine", f"""WITH {DOC_PX}, s AS (SELECT source, photo_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_v FROM px GROUP BY ALL)
SELECT source, photo_id, CASE WHEN photo_id % 7 = 3 THEN 0 ELSE n END AS n_pixels,
       CASE WHEN photo_id % 7 = 3 THEN 'not a binary PGM file' END AS error FROM s""")
def decode_and_quarantine(spark, sf_dir):
    """Documents as PGM files, every seventh damaged; readable and rejected rows together."""
    # a file has no short last row: all bytes in one row
    whole = S.document_bytes(spark, sf_dir).withColumns({"height": F.lit(1), "width": F.octet_length("content")})
    content = F.when(F.col("photo_id") % 7 == 3, F.encode(F.lit("damaged"), "UTF-8")).otherwise(I.pgm_content(content=F.col("content")))
    files = whole.select("source", F.col("photo_id").cast("string").alias("path"), content.alias("content"))
    good, bad = I.quarantine(I.decode_pgm(files))
    rows = good.select("source", "path", F.size("px").cast("long").alias("n_pixels"), F.lit(None).cast("string").alias("error"))
    rejected = bad.select("source", "path", F.lit(0).cast("long").alias("n_pixels"), "error")
    return rows.unionByName(rejected).withColumn("photo_id", F.col("path").cast("long")).drop("path")


@query("scan_table_files")
def scan_table_files(spark, sf_dir):
    """Scan of the table folder as a file source, with one absent source in the report."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").load(sf_dir)
             .select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length"))
    _, report = I.scan_sources(spark, {"absent": f"{sf_dir}/no-such-folder"})
    return files.select(F.lit("tables").alias("source"), "name", "length").unionByName(
        report.select("source", F.col("status").alias("name"), F.col("n_images").alias("length")))


@query("raster_store", f"""WITH {DOC_PX} SELECT source, photo_id, CAST(sum(v) AS BIGINT) AS sum_v, count(*) AS n FROM px GROUP BY ALL""")
def raster_store(spark, sf_dir):
    """Rasters written to the store and read back with the size check."""
    path = f"{shared_dir(spark)}/rasters"
    ST.write_rasters(S.document_rasters(spark, sf_dir), path)
    back = ST.read_rasters(spark, path)
    return back.select("source", "photo_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("sum_v"),
                       F.size("px").cast("long").alias("n"))


@query("dataset_csv", f"""WITH {T.LABELLED} SELECT source, photo_id, variant, method, p, density, label, f_vowels FROM lab""")
def dataset_csv(spark, sf_dir):
    """CSV sink and source of a labelled dataset; clean rows keep NULL metadata."""
    path = f"{shared_dir(spark)}/dataset"
    lab = T.labelled(spark, sf_dir).withColumn("changed_frac", F.lit(None).cast("double"))
    features = ["f_chars", "f_vowels", "f_spaces"]
    meta = ["label", "source", "photo_id", "variant", "method", "p", "density", "changed_frac"]
    ST.write_dataset(lab.select(*features, *meta), path, csv=True)
    return ST.read_dataset_csv(spark, path, features).select(
        "source", "photo_id", "variant", "method", "p", "density", "label", "f_vowels")


@query("metrics_sink", f"""WITH {T.PRED} SELECT 'run' || r AS run, model, count(*) AS n, 'evaluation' AS producer, true AS stamped
FROM pred, (SELECT unnest([1, 2]) AS r) GROUP BY ALL""")
def metrics_sink(spark, sf_dir):
    """Two runs appended to one metrics table."""
    path = f"{shared_dir(spark)}/metrics"
    for run in ("run1", "run2"):
        m = T.scored(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))
        ST.append_metrics(m, path, "evaluation")
    return spark.read.parquet(path).select("run", "model", "n", "producer", F.col("ran_at").isNotNull().alias("stamped"))


_HOLDOUT = """ph AS (SELECT DISTINCT source, photo_id FROM lab),
sp AS (SELECT source, photo_id, CASE WHEN row_number() OVER (ORDER BY md5('{seed}:' || source || ':' || photo_id)) <= round_even(count(*) OVER () * 0.25, 0)
       THEN 'validation' ELSE 'training' END AS side FROM ph)"""


@query("split_registry", f"""WITH {T.LABELLED}, {_HOLDOUT.format(seed=0)} SELECT 'docs' AS corpus, 0 AS seed, source, photo_id, side FROM sp""")
def split_registry(spark, sf_dir):
    """The first split registered for a corpus and seed stays; a second writer gets it back."""
    path = f"{shared_dir(spark)}/splits"
    lab = T.labelled(spark, sf_dir)
    ST.register_split(C.holdout_split(lab, seed=0), path, "docs", 0)
    return ST.register_split(C.holdout_split(lab, seed=99), path, "docs", 0)


@query("record_source", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY ALL""")
def record_source(spark, sf_dir):
    """Nested JSON with an explicit schema."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.from_json("props", "k long").alias("props"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("props.k").alias("sum_k"))


@query("experiment_records", """SELECT doc_id, 'matrix' AS method, 3 AS hamming_p, sha256(text) AS message_sha256, CAST(octet_length(encode(text)) * 8 + 16 AS BIGINT) AS bits,
  NULL::VARCHAR AS verdict FROM documents""")
def experiment_records(spark, sf_dir):
    """Experiment records written as JSON text and parsed with the record schema."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    record = F.to_json(F.struct(
        F.lit("grainscope/experiment-1").alias("schema"),
        F.struct(F.lit("pixel").alias("domain"), F.lit("matrix").alias("method"), F.lit(3).alias("hamming_p"),
                 F.lit(False).alias("password_used")).alias("algorithm"),
        F.struct((F.octet_length("text") * 8 + 16).alias("bits"), F.length("text").alias("chars"),
                 F.sha2("text", 256).alias("message_sha256")).alias("payload")))
    r = ST.parse_records(d.select("doc_id", record.alias("json")), "json")
    return r.select("doc_id", "record.algorithm.method", "record.algorithm.hamming_p", "record.payload.message_sha256",
                    "record.payload.bits", F.col("record.detector")["verdict"].alias("verdict"))


# ---------------------------------------------------------------- columns and validation
@query("feature_projection", f"""WITH {T.LABELLED} SELECT f_chars, f_vowels, f_spaces FROM lab""")
def feature_projection(spark, sf_dir):
    lab = T.labelled(spark, sf_dir)
    return lab.select(*C.feature_columns(lab))


@query("named_feature_set", f"""WITH {DOC_PX}, {stages('source, photo_id')}
SELECT source, photo_id, variant, "Rm", "Sm", "Rn", "Sn", round(gr, 6) AS "RS_Gr", round(gn, 6) AS "RS_Gn", round(chi2_pvalue, 6) AS chi2_pvalue,
  round(h, 6) AS diff_entropy, round(lg, 6) AS lsb_diff_entropy, round(median_prefix_p, 6) AS median_prefix_p, round(chi2_stat, 3) AS chi2_stat
FROM med JOIN rsg USING (source, photo_id) JOIN ent USING (source, photo_id), (SELECT 'clean' AS variant)""")
def named_feature_set(spark, sf_dir):
    """The 11 columns selected by set name out of the 53."""
    from grainscope.operators.features import interpretable_features

    f = C.select_feature_set(interpretable_features(S.document_bytes(spark, sf_dir)), "11d")
    counts = ("Rm", "Sm", "Rn", "Sn")
    return f.select("source", "photo_id", "variant", *[
        F.col(c).cast("long").alias(c) if c in counts else fixed(F.col(c), 3 if c == "chi2_stat" else 6).alias(c)
        for c in C.FEATURE_SETS["11d"]])


@query("drop_null_features", """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def drop_null_features(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return ST.drop_incomplete(d.select("doc_id", "quality"), ["quality"])


@query("finite_values", """WITH e AS (SELECT unnest(range(1, 65)) AS pos), x AS (SELECT pos, embedding[pos] AS v FROM embeddings, e)
SELECT 'e' || (pos - 1) AS feature, count_if(isnan(v) OR isinf(v)) AS n_not_finite, count_if(v IS NULL) AS n_null FROM x GROUP BY ALL""")
def finite_values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    return C.not_finite(e.select(*[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), names)


@query("grouping_violations", f"""WITH {T.LABELLED}, v AS (SELECT source, photo_id, list_sort(list(DISTINCT variant)) AS variants FROM lab GROUP BY ALL),
c AS (SELECT variants, count(*) AS n FROM v GROUP BY ALL), top AS (SELECT arg_max(variants, {{'n': n, 's': len(variants)}}) AS common FROM c)
SELECT source, photo_id, variants FROM v, top WHERE variants <> common""")
def grouping_violations(spark, sf_dir):
    return C.grouping_violations(T.labelled(spark, sf_dir))


@query("id_report", """SELECT source, min(doc_id) AS min_id, max(doc_id) AS max_id, count(DISTINCT doc_id) AS n_ids,
  max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AS contiguous FROM documents GROUP BY ALL""")
def id_report(spark, sf_dir):
    return C.id_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), photo="doc_id")


@query("clean_variant_delta", f"""WITH {T.LABELLED} SELECT a.source, a.photo_id,
  round(greatest(abs(a.f_chars - b.f_chars), abs(a.f_vowels - b.f_vowels)), 6) AS max_delta
FROM lab a JOIN lab b USING (source, photo_id) WHERE a.variant = 'clean' AND b.variant = 'clean_jpeg'""")
def clean_variant_delta(spark, sf_dir):
    d = C.variant_delta(T.labelled(spark, sf_dir), ["f_chars", "f_vowels"], "clean", "clean_jpeg")
    return d.withColumn("max_delta", fixed(F.col("max_delta")))


@query("metadata_coercion", f"""WITH {T.LABELLED} SELECT source, photo_id, variant, p AS p_value, density AS density_value FROM lab""")
def metadata_coercion(spark, sf_dir):
    """Metadata kept as text, empty for clean rows, back to numbers or NULL."""
    text = T.labelled(spark, sf_dir).select("source", "photo_id", "variant", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("p", "density")])
    return text.select("source", "photo_id", "variant", C.numeric_or_null(F.col("p"), "int").alias("p_value"),
                       C.numeric_or_null(F.col("density"), "double").alias("density_value"))


# ---------------------------------------------------------------- splits and joins
@query("holdout_split", f"""WITH {T.LABELLED}, {_HOLDOUT.format(seed=5)} SELECT source, photo_id, side FROM sp""")
def holdout_split(spark, sf_dir):
    return C.holdout_split(T.labelled(spark, sf_dir), seed=5)


@query("kfold_assign", f"""WITH RECURSIVE {T.LABELLED}, g AS (SELECT source, photo_id, count(*) AS n FROM lab GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('0:' || source || ':' || photo_id)) AS k FROM g),
deal AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0 AS f
         UNION ALL SELECT o.k, list_transform(range(1, 6), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN o.n ELSE 0 END),
                          list_position(load, list_min(load)) FROM deal JOIN o ON o.k = deal.k + 1)
SELECT source, photo_id, CAST(f - 1 AS INTEGER) AS fold FROM o JOIN deal USING (k)""")
def kfold_assign(spark, sf_dir):
    return C.kfold(T.labelled(spark, sf_dir), 5)


@query("semi_validation", f"""WITH {T.LABELLED}, {_HOLDOUT.format(seed=0)} SELECT source, photo_id, variant, label FROM lab
SEMI JOIN (SELECT * FROM sp WHERE side = 'validation') USING (source, photo_id)""")
def semi_validation(spark, sf_dir):
    lab = T.labelled(spark, sf_dir)
    return C.rows_in(lab, C.holdout_split(lab), "validation").select(*PHOTO, "variant", "label")


@query("anti_training", f"""WITH {T.LABELLED}, {_HOLDOUT.format(seed=0)} SELECT source, photo_id, variant, label FROM lab
ANTI JOIN (SELECT * FROM sp WHERE side = 'validation') USING (source, photo_id)""")
def anti_training(spark, sf_dir):
    lab = T.labelled(spark, sf_dir)
    return C.rows_not_in(lab, C.holdout_split(lab), "validation").select(*PHOTO, "variant", "label")


@query("clean_variant_pairs", f"""WITH {T.LABELLED} SELECT c.source, c.photo_id, v.variant, round(v.f_vowels - c.f_vowels, 6) AS shift
FROM lab c JOIN lab v USING (source, photo_id) WHERE c.variant = 'clean' AND v.label = 1""")
def clean_variant_pairs(spark, sf_dir):
    lab = T.labelled(spark, sf_dir)
    clean = lab.where("variant = 'clean'").select(*PHOTO, F.col("f_vowels").alias("c"))
    return lab.where("label = 1").join(clean, PHOTO).select(*PHOTO, "variant", fixed(F.col("f_vowels") - F.col("c")).alias("shift"))


@query("dense_photo_id", """SELECT doc_id, source, lang, dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1 AS lang_id FROM documents""")
def dense_photo_id(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    return C.dense_photo_ids(d, "source", "lang", "lang_id")


@query("number_photos", """SELECT source, url, 1000 + row_number() OVER (PARTITION BY source ORDER BY url) - 1 AS photo_id
FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS source, url FROM pages)""")
def number_photos(spark, sf_dir):
    """Pages numbered along their URL within each host."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"), "url").distinct()
    return C.number_photos(p, 1000, path="url")


@query("first_per_source", """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 7""")
def first_per_source(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    return C.first_per_source(d, 7, path="doc_id")


# ---------------------------------------------------------------- unions
@query("concat_datasets", f"""WITH {T.LABELLED} SELECT CASE WHEN source = 'set0' THEN 'a' ELSE 'b' END AS part, count(*) AS n, count_if(label = 1) AS n_stego FROM lab GROUP BY ALL""")
def concat_datasets(spark, sf_dir):
    lab = T.labelled(spark, sf_dir)
    both = C.concat_datasets(lab.where("source = 'set0'"), lab.where("source <> 'set0'"))
    part = F.when(F.col("source") == "set0", "a").otherwise("b").alias("part")
    return both.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_stego"))


@query("append_clean_rows", f"""WITH {T.LABELLED} SELECT source, variant, count(*) AS n FROM lab WHERE variant = 'clean_jpeg' OR label = 1 GROUP BY ALL
UNION ALL SELECT source, 'clean', count(*) FROM lab WHERE variant = 'clean' GROUP BY ALL""")
def append_clean_rows(spark, sf_dir):
    lab = T.labelled(spark, sf_dir)
    base, extra = lab.where("variant <> 'clean_jpeg'"), lab.where("variant = 'clean_jpeg'")
    return base.unionByName(extra).groupBy("source", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("missing_columns", """SELECT feature FROM (SELECT unnest(['f_chars', 'f_vowels', 'f_spaces', 'f_extra']) AS feature)
WHERE feature NOT IN ('f_chars', 'f_vowels', 'f_spaces')""")
def missing_columns(spark, sf_dir):
    """Required columns a table lacks."""
    have = C.feature_columns(T.labelled(spark, sf_dir))
    need = ["f_chars", "f_vowels", "f_spaces", "f_extra"]
    names = TY.StructType([TY.StructField("feature", TY.StringType())])
    return spark.createDataFrame([(c,) for c in need], names).exceptAll(spark.createDataFrame([(c,) for c in have], names))


@query("sources_by_variant_grid", f"""WITH {T.LABELLED}, s AS (SELECT DISTINCT source FROM lab), m AS (SELECT unnest(['143d', '53d']) AS model), c AS (SELECT unnest([true, false]) AS clip)
SELECT source, model, clip FROM s, m, c""")
def sources_by_variant_grid(spark, sf_dir):
    """Evaluation grid: every source with every model and clip setting."""
    grid = spark.createDataFrame([(m, c) for m in ("143d", "53d") for c in (True, False)], "model string, clip boolean")
    return T.labelled(spark, sf_dir).select("source").distinct().crossJoin(F.broadcast(grid))


@query("comparable_groups", f"""WITH {T.LABELLED}, r AS (SELECT source, CASE WHEN source = 'set0' THEN 'bossbase_npz' ELSE 'bossbase_csv' END AS dataset,
  CASE WHEN label = 1 THEN 'holdout by source photo (shared)' ELSE 'none' END AS protocol FROM lab)
SELECT dataset, protocol, CASE WHEN dataset = 'bossbase_npz' AND contains(protocol, 'holdout by source photo') THEN 'A_bossbase_npz_holdout' ELSE 'B_other' END AS comparable_group, count(*) AS n
FROM r GROUP BY ALL""")
def comparable_groups(spark, sf_dir):
    r = T.labelled(spark, sf_dir).select(
        F.when(F.col("source") == "set0", "bossbase_npz").otherwise("bossbase_csv").alias("dataset"),
        F.when(F.col("label") == 1, "holdout by source photo (shared)").otherwise("none").alias("protocol"))
    return r.groupBy("dataset", "protocol", comparable_group(F.col("dataset"), F.col("protocol")).alias("comparable_group")).agg(
        F.count(F.lit(1)).alias("n"))


@query("string_map_keys", """SELECT user_id, list_sort(list(DISTINCT CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR))) AS keys FROM events GROUP BY ALL""")
def string_map_keys(spark, sf_dir):
    """Maps keyed by number get string keys, as JSON would store them."""
    k = F.from_json("props", "k long")["k"]
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", k.alias("k")).distinct()
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "k"))).alias("m"))
    return m.select("user_id", F.array_sort(F.map_keys(string_keys(F.col("m")))).alias("keys"))


@query("content_hashes", """SELECT doc_id, substr(sha256(text), 1, 16) AS prefix FROM documents""")
def content_hashes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("prefix"))

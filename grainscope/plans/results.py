"""Queries on the canonical results table."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainscope.functions.columns import fixed
from grainscope.operators import evaluate as E
from grainscope.operators import results as R
from grainscope.plans import tables as T
from grainscope.plans.registry import query

# Results per source and model: AUC-free measures that both engines compute exactly.
_MEASURES = f"""{T.PRED}, me AS (SELECT model, source, count(*) AS n, round(avg(score), 10) AS mean_score, round(count_if(pred = 1) / count(*), 6) AS rate FROM pred GROUP BY ALL),
corp AS (SELECT model, source, n, mean_score, rate, CASE ('0x' || substr(md5(source), 1, 2))::INT % 3 WHEN 0 THEN 'bossbase_npz' WHEN 1 THEN 'campus_v2_jpeg' ELSE 'ood_real_jpeg' END AS corpus,
         CASE WHEN model = '143d' THEN 'holdout_by_photo' ELSE 'ood_clean_fp' END AS protocol_id FROM me)"""
_ROWS = _MEASURES + """, rows AS (SELECT corpus, protocol_id, model, source AS subject, unnest(['mean_score', 'detection_rate']) AS metric, unnest([mean_score, rate]) AS value, n AS n_samples FROM corp)"""


def measures(spark, sf_dir):
    m = T.with_threshold(T.scored(spark, sf_dir)).groupBy("model", "source").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("score"), 10).alias("mean_score"), fixed(F.avg("pred")).alias("detection_rate"))
    pick = F.conv(F.substring(F.md5("source"), 1, 2), 16, 10).cast("int") % 3
    return m.withColumn("corpus", F.when(pick == 0, "bossbase_npz").when(pick == 1, "campus_v2_jpeg").otherwise("ood_real_jpeg")).withColumn(
        "protocol_id", F.when(F.col("model") == "143d", "holdout_by_photo").otherwise("ood_clean_fp"))


def rows(spark, sf_dir):
    keep = {"corpus": F.col("corpus"), "protocol_id": F.col("protocol_id"), "model": F.col("model"),
            "subject": F.col("source"), "n_samples": F.col("n")}
    return R.metric_rows(measures(spark, sf_dir), keep, ["mean_score", "detection_rate"])


def _registry(name: str, items, cols: str) -> str:
    values = ", ".join(f"({i}, '{x[0]}', '{x[1]}')" for i, x in enumerate(items))
    return f"{name} AS (SELECT * FROM (VALUES {values}) AS t({cols}))"


_CORPORA = _registry("corpora", R.CORPORA, "corpus_rank, corpus, corpus_label")
_PROTOCOLS = _registry("protocols", R.PROTOCOLS, "protocol_rank, protocol_id, protocol")


@query("results_union", f"""WITH {_ROWS}, {_CORPORA}, {_PROTOCOLS}
SELECT corpus, corpus_label, protocol_id, protocol, model, subject, metric, value, n_samples FROM rows JOIN corpora USING (corpus) JOIN protocols USING (protocol_id)""")
def results_union(spark, sf_dir):
    """Rows of two producers with different columns in the canonical table."""
    r = rows(spark, sf_dir)
    a = r.where("model = '143d'").withColumn("family", F.lit("handcrafted"))
    b = r.where("model <> '143d'").withColumn("note", F.lit("clean photos"))
    return R.canonical(R.union_sources(a, b)).select(
        "corpus", "corpus_label", "protocol_id", "protocol", "model", "subject", "metric", "value", "n_samples")


@query("results_order", f"""WITH {_ROWS}, {_CORPORA}, {_PROTOCOLS}
SELECT row_number() OVER (ORDER BY corpus_rank, protocol_rank, model, metric, subject) AS place, corpus, protocol_id, model, metric, subject
FROM rows JOIN corpora USING (corpus) JOIN protocols USING (protocol_id)""")
def results_order(spark, sf_dir):
    """Place of each row in registry order, as a rank over the composite order key."""
    from grainscope.functions.ordering import ranked

    r = (rows(spark, sf_dir).join(F.broadcast(R.corpora(spark)), "corpus").join(F.broadcast(R.protocols(spark)), "protocol_id")
         .withColumn("_o", F.struct("corpus_rank", "protocol_rank", "model", "metric", "subject")))
    return ranked(r, "_o", "place").select("place", "corpus", "protocol_id", "model", "metric", "subject")


@query("unknown_registry_keys", f"""WITH {_ROWS} SELECT 'corpus' AS reason, subject, metric FROM rows WHERE model = '53d' AND corpus = 'campus_v2_jpeg'
UNION ALL SELECT 'protocol', subject, metric FROM rows WHERE model = '143d' AND corpus = 'ood_real_jpeg'""")
def unknown_registry_keys(spark, sf_dir):
    r = rows(spark, sf_dir)
    broken = r.withColumn("protocol_id", F.when((F.col("model") == "143d") & (F.col("corpus") == "ood_real_jpeg"), "oops")
                          .otherwise(F.col("protocol_id"))).withColumn(
        "corpus", F.when((F.col("model") == "53d") & (F.col("corpus") == "campus_v2_jpeg"), "nowhere").otherwise(F.col("corpus")))
    return R.unknown_keys(broken).select("reason", "subject", "metric")


@query("untraceable_anti", f"""WITH {_ROWS} SELECT model, subject, metric, value, 'no' AS traceable FROM rows WHERE model = '53d' AND metric = 'mean_score'""")
def untraceable_anti(spark, sf_dir):
    claims = rows(spark, sf_dir).select("model", "subject", "metric", "value")
    produced = claims.where("not (model = '53d' and metric = 'mean_score')")
    return R.untraceable(claims, produced, ["model", "subject", "metric"])


@query("dataset_alias", f"""WITH {_ROWS} SELECT CASE WHEN corpus = 'ood_real_jpeg' THEN 'ood' ELSE corpus END AS corpus, count(*) AS n FROM rows GROUP BY ALL""")
def dataset_alias(spark, sf_dir):
    alias = spark.createDataFrame([("ood_real_jpeg", "ood")], "alias string, canonical string")
    return R.aliased(rows(spark, sf_dir), alias, "corpus").groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))


@query("sync_full_outer", f"""WITH {_ROWS}, p AS (SELECT model, subject, metric, CASE WHEN metric = 'mean_score' AND subject LIKE '%1' THEN value + 0.001 ELSE value END AS published FROM rows WHERE subject <> 'src2'),
q AS (SELECT model, subject, metric, value AS recomputed FROM rows WHERE subject <> 'src3')
SELECT model, subject, metric, published, recomputed, CASE WHEN recomputed IS NULL THEN 'not recomputed' WHEN published IS NULL THEN 'not published' ELSE 'different' END AS problem
FROM p FULL JOIN q USING (model, subject, metric) WHERE published IS DISTINCT FROM recomputed""")
def sync_full_outer(spark, sf_dir):
    r = rows(spark, sf_dir).select("model", "subject", "metric", "value")
    moved = F.when((F.col("metric") == "mean_score") & F.col("subject").endswith("1"), F.col("value") + 0.001).otherwise(F.col("value"))
    published = r.where("subject <> 'src2'").withColumn("value", moved)
    return R.differences(published, r.where("subject <> 'src3'"), ["model", "subject", "metric"])


@query("stale_metrics", f"""WITH {_ROWS} SELECT model, subject, metric, value + 0.001 AS published, value AS recomputed FROM rows WHERE subject LIKE '%1'""")
def stale_metrics(spark, sf_dir):
    r = rows(spark, sf_dir).select("model", "subject", "metric", "value")
    moved = F.col("value") + F.when(F.col("subject").endswith("1"), 0.001).otherwise(0.0001)
    return R.stale(r.withColumn("value", moved), r, ["model", "subject", "metric"])


@query("missing_sweeps", f"""WITH {_MEASURES} SELECT model, source FROM corp WHERE n < 20 ORDER BY ALL""")
def missing_sweeps(spark, sf_dir):
    m = measures(spark, sf_dir).withColumn("auc_8split_mean", F.when(F.col("n") >= 20, F.col("mean_score")))
    return R.missing_sweeps(m).select("model", "source")


@query("metrics_by_file", f"""WITH {_MEASURES}, o AS (SELECT model, source, rate AS fp_rate FROM corp WHERE corpus <> 'bossbase_npz')
SELECT m.model, m.source, m.n, o.fp_rate FROM corp m LEFT JOIN o USING (model, source) WHERE m.model = '143d'""")
def metrics_by_file(spark, sf_dir):
    """Training metrics of one model with its out-of-domain metrics where they exist."""
    m = measures(spark, sf_dir)
    ood = m.where("corpus <> 'bossbase_npz'").select("model", "source", F.col("detection_rate").alias("fp_rate"))
    return m.where("model = '143d'").join(ood, ["model", "source"], "left").select("model", "source", "n", "fp_rate")


@query("comparison_table", f"""WITH {T.SCORED}, sp AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id)) <= round_even(count(*) OVER () * 0.25, 0) AS val FROM (SELECT DISTINCT doc_id FROM scored)),
v AS (SELECT * FROM scored JOIN sp USING (doc_id) WHERE val)
SELECT model, 'holdout_by_photo' AS protocol_id, count_if(x.label = 1) // count(DISTINCT y.doc_id) AS n_pos, count(DISTINCT y.doc_id) AS n_neg,
  round(avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM v x JOIN v y USING (model) WHERE x.label = 1 AND y.label = 0 GROUP BY ALL""")
def comparison_table(spark, sf_dir):
    """Models on one shared validation side."""
    from grainscope.operators import corpus as C

    s = T.scored(spark, sf_dir)
    val = C.rows_in(s, C.holdout_split(s, key=["doc_id"]), "validation", ["doc_id"])
    return E.auc(val, ["model"]).select("model", F.lit("holdout_by_photo").alias("protocol_id"), "n_pos", "n_neg", fixed(F.col("auc")).alias("auc"))

"""Queries on raster statistics, features and the blind detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainscope.functions.columns import fixed
from grainscope.operators import detector as D
from grainscope.operators import features as FX
from grainscope.operators import geometry as G
from grainscope.operators import residuals as R
from grainscope.operators.stats import arrow_stats, native_stats
from grainscope.plans.registry import query
from grainscope.plans.sqltext import DOC_PX, PX, SENSITIVITY, TILE_PX, chi_p, detector, kernels, stages
from grainscope.schemas import ALL_FEATURES, BASE, KEY
from grainscope.sources import rasters as S

IDS = ["source", "photo_id"]
DOC = stages("source, photo_id")
EMB = stages("photo_id")


@query("hist_gray", f"""WITH {DOC_PX}
SELECT source, photo_id, v, count(*) AS cnt FROM px GROUP BY ALL""")
def hist_gray(spark, sf_dir):
    stats = native_stats(S.document_rasters(spark, sf_dir), ("hist",), prefixes=1)
    return FX.gray_histogram(stats).select(*IDS, "v", "cnt")


@query("pixel_stream", f"""WITH {DOC_PX}
SELECT source, count(*) AS n_pixels, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(y * v) AS BIGINT) AS sum_yv,
       CAST(sum(x * v) AS BIGINT) AS sum_xv FROM px GROUP BY ALL""")
def pixel_stream(spark, sf_dir):
    px = S.pixels(S.document_rasters(spark, sf_dir))
    return px.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("v").alias("sum_v"),
        F.sum(F.col("y") * F.col("v")).alias("sum_yv"), F.sum(F.col("x") * F.col("v")).alias("sum_xv"))


@query("statistics_native", f"""WITH {PX}, {EMB}
SELECT photo_id, 'hist' AS kind, CAST(k0 AS INTEGER) AS k, v AS bin, c AS cnt FROM hk
UNION ALL SELECT photo_id, 'diff', 0, CAST(d AS INTEGER), c FROM dh
UNION ALL SELECT photo_id, 'rs', 0, b, n FROM (
  SELECT photo_id, unnest([0, 1, 2, 3, 4]) AS b, unnest([rm, sm, rn, sn, ng]) AS n FROM rs) WHERE n > 0""")
def statistics_native(spark, sf_dir):
    return native_stats(S.embedding_rasters(spark, sf_dir)).drop("source", "variant")


@query("statistics_arrow", f"""WITH {DOC_PX}, {DOC}
SELECT source, photo_id, 'hist' AS kind, CAST(k0 AS INTEGER) AS k, v AS bin, c AS cnt FROM hk
UNION ALL SELECT source, photo_id, 'diff', 0, CAST(d AS INTEGER), c FROM dh
UNION ALL SELECT source, photo_id, 'rs', 0, b, n FROM (
  SELECT source, photo_id, unnest([0, 1, 2, 3, 4]) AS b, unnest([rm, sm, rn, sn, ng]) AS n FROM rs) WHERE n > 0""")
def statistics_arrow(spark, sf_dir):
    return arrow_stats(S.document_rasters(spark, sf_dir)).drop("variant")


@query("chi_pairs", f"""WITH {DOC_PX}, {DOC}
SELECT source, photo_id, round(stat, 3) AS chi2_stat, np AS n_pairs,
       round(coalesce(tail, 1.0), 6) AS chi2_pvalue FROM ckp WHERE k = 20""")
def chi_pairs(spark, sf_dir):
    stats = native_stats(S.document_rasters(spark, sf_dir), ("hist",), prefixes=1)
    summary = FX.image_summary(stats, prefixes=1).withColumn(
        "tail", FX.chi2_sf_each("chi_stats", F.transform("n_pairs", lambda n: n - 1)))
    return summary.select(*IDS, fixed(FX.last("chi_stats"), 3).alias("chi2_stat"),
                          FX.last("n_pairs").cast("long").alias("n_pairs"),
                          fixed(F.coalesce(FX.last("tail"), F.lit(1.0))).alias("chi2_pvalue"))


@query("prefix_chi", f"""WITH {PX}, {EMB}
SELECT photo_id, CAST(k AS INTEGER) AS k, round(stat, 4) AS stat, round(coalesce(tail, 0.0), 6) AS p,
       round(coalesce(tail, 1.0), 6) AS p_whole FROM ckp""")
def prefix_chi(spark, sf_dir):
    s = FX.with_p_values(FX.image_summary(native_stats(S.embedding_rasters(spark, sf_dir), ("hist",))))
    rows = s.select("photo_id", F.posexplode(F.arrays_zip("chi_stats", "tails", "prefix_ps")).alias("k", "z"))
    return rows.select("photo_id", (F.col("k") + 1).alias("k"), fixed(F.col("z.chi_stats"), 4).alias("stat"),
                       fixed(F.coalesce("z.tails", F.lit(0.0))).alias("p"), fixed(F.col("z.prefix_ps")).alias("p_whole"))


@query("prefix_chi_tiles", f"""WITH {TILE_PX}, {DOC}
SELECT source, photo_id, CAST(k AS INTEGER) AS k, round(stat, 4) AS stat FROM ckp""")
def prefix_chi_tiles(spark, sf_dir):
    s = FX.summary_of(S.tile_rasters(spark, sf_dir))
    return s.select(*IDS, F.posexplode("chi_stats").alias("k", "s")).select(
        *IDS, (F.col("k") + 1).alias("k"), fixed(F.col("s"), 4).alias("stat"))


@query("median_prefix_p", f"""WITH {PX}, {EMB}
SELECT photo_id, round(median_prefix_p, 6) AS median_prefix_p FROM med""")
def median_prefix_p(spark, sf_dir):
    s = FX.with_p_values(FX.summary_of(S.embedding_rasters(spark, sf_dir)))
    return s.select("photo_id", fixed(F.col("median_prefix_p")).alias("median_prefix_p"))


@query("lsb_prefix_p", f"""WITH {DOC_PX}, {DOC}
SELECT source, photo_id, CAST(k AS INTEGER) AS k,
       round(exp(-(power(zeros - (zeros + ones) / 2.0, 2) + power(ones - (zeros + ones) / 2.0, 2)) / ((zeros + ones) / 2.0) / 2), 6) AS p
FROM ck""")
def lsb_prefix_p(spark, sf_dir):
    s = FX.summary_of(S.document_bytes(spark, sf_dir))
    return s.select(*IDS, F.posexplode(FX.lsb_prefix_ps()).alias("k", "p")).select(
        *IDS, (F.col("k") + 1).alias("k"), fixed(F.col("p")).alias("p"))


@query("rs_counts", f"""WITH {DOC_PX}, {DOC}
SELECT source, photo_id, "Rm", "Sm", "Rn", "Sn", round(gr, 6) AS "RS_Gr", round(gn, 6) AS "RS_Gn" FROM rsg""")
def rs_counts(spark, sf_dir):
    rasters = S.document_rasters(spark, sf_dir)
    s = FX.image_summary(native_stats(rasters, ("rs",)), prefixes=1)
    got = s.select(*IDS, "Rm", "Sm", "Rn", "Sn", fixed(FX.rs_gap("Rm", "Sm")).alias("RS_Gr"),
                   fixed(FX.rs_gap("Rn", "Sn")).alias("RS_Gn"))
    # images of fewer than four pixels have no group: all zero
    zeros = {c: F.lit(0).cast("long") for c in ("Rm", "Sm", "Rn", "Sn")}
    small = rasters.where(F.size("px") < 4).select(*IDS).withColumns(
        {**zeros, "RS_Gr": F.lit(0.0), "RS_Gn": F.lit(0.0)})
    return got.unionByName(small)


@query("diff_entropy", f"""WITH {DOC_PX}, {DOC}
SELECT source, photo_id, round(h, 6) AS diff_entropy, round(lg, 6) AS lsb_diff_entropy FROM ent""")
def diff_entropy(spark, sf_dir):
    s = FX.summary_of(S.document_bytes(spark, sf_dir))     # a document without a neighbour pair has entropy 0
    return s.select(*IDS, fixed(FX.difference_entropy()).alias("diff_entropy"),
                    fixed(FX.lsb_difference_entropy()).alias("lsb_diff_entropy"))


@query("texture_sd", f"""WITH {DOC_PX}
SELECT source, photo_id, round(stddev_pop(v), 6) AS pixel_sd,
       round(least(1.0, greatest(0.0, (stddev_pop(v) - 1.2) / 5.8)), 6) AS texture_sd FROM px GROUP BY ALL""")
def texture_sd(spark, sf_dir):
    s = FX.image_summary(native_stats(S.document_rasters(spark, sf_dir), ("hist",), prefixes=1), prefixes=1)
    return s.select(*IDS, fixed(FX.pixel_deviation()).alias("pixel_sd"), fixed(FX.deviation_texture()).alias("texture_sd"))


@query("rate_chi", f"""WITH {PX}, {EMB}
SELECT photo_id, round(least(1.0, greatest(0.0, 1 - 2 * least(chi2_pvalue, median_prefix_p))), 6) AS rate_chi FROM med""")
def rate_chi(spark, sf_dir):
    s = FX.with_p_values(FX.summary_of(S.embedding_rasters(spark, sf_dir)))
    return s.select("photo_id", fixed(FX.chi_rate(F.col("chi2_pvalue"), F.col("median_prefix_p"))).alias("rate_chi"))


def _base_sql(px: str, key: str, cte: str) -> str:
    return f"""WITH {px}, {cte}
SELECT {key}, "Rm", "Sm", "Rn", "Sn", round(gr, 6) AS "RS_Gr", round(gn, 6) AS "RS_Gn",
       round(chi2_pvalue, 6) AS chi2_pvalue, round(h, 6) AS diff_entropy, round(lg, 6) AS lsb_diff_entropy,
       round(median_prefix_p, 6) AS median_prefix_p, round(chi2_stat, 3) AS chi2_stat
FROM med JOIN rsg USING ({key}) JOIN ent USING ({key})"""


def _base_rounded(f, ids):
    digits = {"chi2_stat": 3}
    return f.select(*ids, *[c if c in ("Rm", "Sm", "Rn", "Sn") else fixed(F.col(c), digits.get(c, 6)).alias(c)
                            for c in BASE])


@query("base_features_images", _base_sql(PX, "photo_id", EMB))
def base_features_images(spark, sf_dir):
    return _base_rounded(FX.base_features(S.embedding_rasters(spark, sf_dir), "native"), ["photo_id"])


@query("base_features_documents", _base_sql(DOC_PX, "source, photo_id", DOC))
def base_features_documents(spark, sf_dir):
    return _base_rounded(FX.base_features(S.document_bytes(spark, sf_dir), "arrow"), IDS)


def _residual_sql(which: range, tail: str) -> str:
    return f"""WITH {PX}, {kernels(which)},
nn AS (SELECT photo_id, count(*) AS n FROM px GROUP BY ALL),
r0 AS (SELECT c.photo_id, c.i, k.c, k.dv, sum(k.w * coalesce(q.v, 0)) AS r
       FROM px AS c CROSS JOIN kern AS k LEFT JOIN px AS q
         ON q.photo_id = c.photo_id AND q.y = c.y + k.dy AND q.x = c.x + k.dx GROUP BY ALL),
r1 AS (SELECT photo_id, i, c, dv, least(4.0, greatest(-4.0, r / CAST(dv AS DOUBLE))) AS r, r / CAST(dv AS DOUBLE) AS rr FROM r0)
{tail}"""


_MOMENTS = """SELECT photo_id, CAST(c AS INTEGER) AS c, round(avg(r), 6) AS mu, round(avg(abs(r)), 6) AS absmean,
       round(stddev_pop(abs(r)), 6) AS std FROM r1 GROUP BY ALL"""


def _moments(sums):
    return R.residual_moments(sums).select(
        "photo_id", "c", *[fixed(F.col(s)).alias(s) for s in ("mu", "absmean", "std")])


@query("residual_first_second_order", _residual_sql(range(12), _MOMENTS))
def residual_first_second_order(spark, sf_dir):
    return _moments(R.native_residual_sums(S.embedding_rasters(spark, sf_dir), list(range(12))))


@query("residual_stats", _residual_sql(range(30), _MOMENTS))
def residual_stats(spark, sf_dir):
    return _moments(R.residual_sums(S.embedding_rasters(spark, sf_dir)))


@query("residual_enhanced", _residual_sql(range(30), """, m AS (
  SELECT photo_id, i, CAST(round_even((least(4.0, max(abs(rr))) + 4) / 8 * 255, 0) AS BIGINT) AS u FROM r1 GROUP BY photo_id, i)
SELECT photo_id, u AS v, count(*) AS cnt, CAST(sum(i) AS BIGINT) AS sum_i FROM m GROUP BY ALL"""))
def residual_enhanced(spark, sf_dir):
    px = S.pixels(R.enhanced(S.embedding_rasters(spark, sf_dir)))
    return px.groupBy("photo_id", F.col("v").cast("long").alias("v")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("i").alias("sum_i"))


def _enhanced_sql() -> str:
    px = PX.replace("px AS", "px0 AS", 1)
    body = _residual_sql(range(30), "").split(",\nnn AS", 1)[1].replace(" px ", " px0 ").replace("nn AS", "n0 AS")
    body = "n0 AS" + body.rstrip()
    return f"""WITH {px}, {kernels(range(30))},
{body},
px AS (SELECT photo_id, i, i // 64 AS y, i % 64 AS x, CAST(round_even((least(4.0, max(abs(rr))) + 4) / 8 * 255, 0) AS INTEGER) AS v FROM r1 GROUP BY photo_id, i),
{EMB}
""" + _base_sql(PX, "photo_id", EMB).split(EMB, 1)[1]


@query("features_after_enhancement", _enhanced_sql())
def features_after_enhancement(spark, sf_dir):
    f = FX.featurize(S.embedding_rasters(spark, sf_dir), "v1", preprocess="residual")
    return _base_rounded(f, ["photo_id"])


_FULL = (f"WITH {PX}, {kernels(range(30))}, {EMB}," + """
r0 AS (SELECT c.photo_id, c.i, k.c, k.dv, sum(k.w * coalesce(q.v, 0)) AS r
       FROM px AS c CROSS JOIN kern AS k LEFT JOIN px AS q
         ON q.photo_id = c.photo_id AND q.y = c.y + k.dy AND q.x = c.x + k.dx GROUP BY ALL),
r1 AS (SELECT photo_id, c, dv, least(4 * dv, greatest(-4 * dv, r)) AS r FROM r0),
mo AS (SELECT photo_id, c, sum(r)::DOUBLE / (count(*) * dv) AS mu, sum(abs(r))::DOUBLE / (count(*) * dv) AS am,
              sqrt((count(*) * sum(r * r) - sum(abs(r)) * sum(abs(r)))::DOUBLE) / (count(*) * dv) AS sd FROM r1 GROUP BY photo_id, c, dv),
sd AS (SELECT photo_id, stddev_pop(v) AS s FROM px GROUP BY ALL),
f AS (
  SELECT photo_id, unnest(['Rm', 'Sm', 'Rn', 'Sn', 'RS_Gr', 'RS_Gn', 'chi2_pvalue', 'diff_entropy', 'lsb_diff_entropy',
                           'median_prefix_p', 'chi2_stat', 'texture_noise', 'est_rate']) AS feature,
         unnest([CAST("Rm" AS DOUBLE), "Sm", "Rn", "Sn", gr, gn, chi2_pvalue, h, lg, median_prefix_p, chi2_stat,
                 least(1.0, greatest(0.0, (s - 1.2) / 5.8)),
                 least(1.0, greatest(0.0, 1 - 2 * least(chi2_pvalue, median_prefix_p)))]) AS value
  FROM med JOIN rsg USING (photo_id) JOIN ent USING (photo_id) JOIN sd USING (photo_id)
  UNION ALL SELECT photo_id, 'srm_mu_c' || c, mu FROM mo UNION ALL SELECT photo_id, 'srm_absmean_c' || c, am FROM mo
  UNION ALL SELECT photo_id, 'srm_std_c' || c, sd FROM mo
  UNION ALL SELECT photo_id, 'prefix_p' || k, coalesce(tail, 0.0) FROM ckp
  UNION ALL SELECT photo_id, 'lsb_prefix_p' || k, exp(-(power(zeros - (zeros + ones) / 2.0, 2)
                   + power(ones - (zeros + ones) / 2.0, 2)) / ((zeros + ones) / 2.0) / 2) FROM ck)
SELECT photo_id, feature, round(value, 5) AS value FROM f""")


@query("full_features", _FULL)
def full_features(spark, sf_dir):
    """All 143 columns, unfolded to (photo, feature, value)."""
    f = FX.full_features(S.embedding_rasters(spark, sf_dir))
    return f.select("photo_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), fixed(F.col(c), 5).alias("value")) for c in ALL_FEATURES])))


_WIDE = (f"WITH {DOC_PX}, {DOC}," + """
sd AS (SELECT source, photo_id, stddev_pop(v) AS s FROM px GROUP BY ALL),
f AS (
  SELECT source, photo_id, unnest(['Rm', 'Sm', 'Rn', 'Sn', 'RS_Gr', 'RS_Gn', 'chi2_pvalue', 'diff_entropy', 'lsb_diff_entropy',
                           'median_prefix_p', 'texture_noise', 'est_rate', 'chi2_stat']) AS feature,
         unnest([CAST("Rm" AS DOUBLE), "Sm", "Rn", "Sn", gr, gn, chi2_pvalue, h, lg, median_prefix_p,
                 least(1.0, greatest(0.0, (s - 1.2) / 5.8)),
                 least(1.0, greatest(0.0, 1 - 2 * least(chi2_pvalue, median_prefix_p))), chi2_stat]) AS value
  FROM med JOIN rsg USING (source, photo_id) JOIN ent USING (source, photo_id) JOIN sd USING (source, photo_id)
  UNION ALL SELECT source, photo_id, 'prefix_p' || k, CASE WHEN n < 64 THEN 1.0 ELSE coalesce(tail, 0.0) END FROM ckp JOIN nn USING (source, photo_id)
  UNION ALL SELECT source, photo_id, 'lsb_prefix_p' || k, CASE WHEN n < 64 THEN 1.0 ELSE exp(-(power(zeros - (zeros + ones) / 2.0, 2)
                   + power(ones - (zeros + ones) / 2.0, 2)) / ((zeros + ones) / 2.0) / 2) END FROM ck JOIN nn USING (source, photo_id))
SELECT source, photo_id, feature, round(value, CASE WHEN feature = 'chi2_stat' THEN 3 ELSE 5 END) AS value FROM f""")


@query("interpretable_features", _WIDE)
def interpretable_features(spark, sf_dir):
    """The 53 columns of every document."""
    f = FX.interpretable_features(S.document_bytes(spark, sf_dir))
    names = [c for c in f.columns if c not in KEY]
    return f.select(*IDS, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), fixed(F.col(c).cast("double"), 3 if c == "chi2_stat" else 5).alias("value")) for c in names])))


@query("minimum_size", """SELECT source, count(*) AS n FROM documents
WHERE CAST(ceil(octet_length(encode(text)) / 32.0) AS BIGINT) * 32 >= 4096 GROUP BY ALL""")
def minimum_size(spark, sf_dir):
    return S.large_enough(S.document_rasters(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- geometry
@query("five_crop_positions", """WITH d AS (SELECT doc_id AS photo_id, CAST(ceil(octet_length(encode(text)) / 32.0) AS INTEGER) AS h, 32 AS w
  FROM documents WHERE octet_length(encode(text)) > 0),
c AS (SELECT DISTINCT photo_id, unnest([0, 0, h - 16, h - 16, (h - 16) // 2]) AS y0, unnest([0, w - 16, 0, w - 16, (w - 16) // 2]) AS x0
      FROM d WHERE h > 16)
SELECT photo_id, y0, x0 FROM c UNION ALL SELECT photo_id, 0, 0 FROM d WHERE h <= 16""")
def five_crop_positions(spark, sf_dir):
    d = S.document_rasters(spark, sf_dir)
    return d.select("photo_id", F.inline(G.crop_corners("height", "width", 16))).select(
        "photo_id", F.col("y0").cast("int").alias("y0"), F.col("x0").cast("int").alias("x0"))


_CROPS = f"""WITH {PX}, d AS (SELECT photo_id, CAST(max(y) + 1 AS INTEGER) AS h, 64 AS w FROM px GROUP BY ALL),
c AS (SELECT DISTINCT photo_id, unnest([0, 0, h - 32, h - 32, (h - 32) // 2]) AS y0, unnest([0, 32, 0, 32, 16]) AS x0 FROM d WHERE h > 32
      UNION ALL SELECT photo_id, 0, 0 FROM d WHERE h <= 32),
s AS (SELECT photo_id, y0, x0, avg(v) / 255 AS prob FROM c JOIN px USING (photo_id)
      WHERE y >= y0 AND y < y0 + 32 AND x >= x0 AND x < x0 + 32 GROUP BY ALL)"""


@query("multi_crop_mean", _CROPS + " SELECT photo_id, round(avg(prob), 6) AS prob, count(*) AS n_crops FROM s GROUP BY ALL")
def multi_crop_mean(spark, sf_dir):
    c = G.crops(S.embedding_rasters(spark, sf_dir), 32)
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    scored = c.select(*KEY, (total / F.size("px") / 255).alias("prob"))
    return G.mean_over_crops(scored).select("photo_id", fixed(F.col("prob")).alias("prob"), "n_crops")


@query("centre_crop", f"""WITH {PX}, d AS (SELECT photo_id, (max(y) + 1 - 32) // 2 AS y0 FROM px GROUP BY ALL)
SELECT photo_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_v FROM px JOIN d USING (photo_id)
WHERE y >= y0 AND y < y0 + 32 AND x >= 16 AND x < 48 GROUP BY ALL""")
def centre_crop(spark, sf_dir):
    c = G.crops(S.embedding_rasters(spark, sf_dir), 32, centre_only=True)
    return S.pixels(c).groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"))


def _resize_sql(side: int) -> str:
    """Two-pass Lanczos resize of the 64-pixel-wide rasters."""
    def weights(name: str, size: str, source: str) -> str:
        return f"""{name}0 AS (SELECT {size}, o, j, ((j + 0.5) - (o + 0.5) * {size} / {side}.0) / greatest({size} / {side}.0, 1.0) AS t
  FROM {source}, (SELECT unnest(range({side})) AS o), (SELECT unnest(range(64)) AS j) WHERE j < {size}),
{name}1 AS (SELECT {size}, o, j, CASE WHEN t = 0 THEN 1.0 WHEN abs(t) < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0.0 END AS w FROM {name}0),
{name} AS (SELECT {size}, o, j, w / sum(w) OVER (PARTITION BY {size}, o) AS w FROM {name}1 WHERE w <> 0)"""

    return f"""WITH {PX}, hs AS (SELECT photo_id, max(y) + 1 AS h FROM px GROUP BY ALL), dh AS (SELECT DISTINCT h FROM hs),
{weights('wx', 'w0', '(SELECT 64 AS w0)')}, {weights('wy', 'h', 'dh')},
a AS (SELECT photo_id, y, o AS xo, least(255.0, greatest(0.0, floor(sum(v * w) + 0.5))) AS v FROM px JOIN wx ON j = x GROUP BY ALL),
b AS (SELECT photo_id, wy.o AS yo, xo, CAST(least(255.0, greatest(0.0, floor(sum(v * w) + 0.5))) AS BIGINT) AS v
      FROM a JOIN hs USING (photo_id) JOIN wy ON wy.h = hs.h AND wy.j = a.y GROUP BY ALL)
SELECT photo_id, {side} AS height, {side} AS width, CAST(sum(v) AS BIGINT) AS sum_v FROM b GROUP BY ALL"""


@query("resized_128", _resize_sql(128))
def resized_128(spark, sf_dir):
    big = G.resize(S.embedding_rasters(spark, sf_dir), 128)
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    return big.select("photo_id", "height", "width", total.alias("sum_v"))


@query("resized_40", _resize_sql(40))
def resized_40(spark, sf_dir):
    small = G.resize(S.embedding_rasters(spark, sf_dir), 40)
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    return small.select("photo_id", "height", "width", total.alias("sum_v"))


@query("resized_512")
def resized_512(spark, sf_dir):
    big = G.resize(S.embedding_rasters(spark, sf_dir))
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    return big.select("photo_id", "height", "width", total.alias("sum_v"))


@query("jpeg_clean_variant")
def jpeg_clean_variant(spark, sf_dir):
    clean = S.embedding_rasters(spark, sf_dir)
    both = clean.unionByName(G.jpeg_round_trip(clean))
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    return both.select(*KEY, total.alias("sum_v"), S.content_hash().alias("sha256"))


# ---------------------------------------------------------------- detector
def _signals_sql(px: str, key: str, cte: str) -> str:
    return f"""WITH {px}, {cte}{detector(key)}
SELECT {key}, round(tex, 6) AS texture_h, round(s_rs, 6) AS s_rs, round(s_chi, 6) AS s_chi, round(rate_rs, 6) AS rate_rs,
       abstain, round(prob, 6) AS prob FROM det"""


def _signals(f, ids):
    return D.with_signals(f).select(
        *ids, *[fixed(F.col(c)).alias(c) for c in ("texture_h", "s_rs", "s_chi", "rate_rs", "prob")], "abstain")


@query("detector_signals_images", _signals_sql(PX, "photo_id", EMB))
def detector_signals_images(spark, sf_dir):
    return _signals(FX.base_features(S.embedding_rasters(spark, sf_dir), "native"), ["photo_id"])


@query("detector_signals_documents", _signals_sql(DOC_PX, "source, photo_id", DOC))
def detector_signals_documents(spark, sf_dir):
    return _signals(FX.base_features(S.document_bytes(spark, sf_dir), "arrow"), IDS)


_VERDICT = """CASE WHEN abstain IS NOT NULL THEN 'undecidable: ' || abstain WHEN prob >= high THEN 'very likely stego'
       WHEN prob >= possible THEN 'possibly stego' ELSE 'unlikely stego' END AS verdict"""


@query("sensitivity_verdicts", f"""WITH {TILE_PX}, {DOC}{detector('source, photo_id')}
SELECT source, photo_id, sensitivity, round(least(1.0, greatest(0.0, 0.5 + (prob - 0.5) * pull)), 6) AS stego_probability,
       {_VERDICT} FROM det, {SENSITIVITY}""")
def sensitivity_verdicts(spark, sf_dir):
    f = D.with_verdict(D.with_signals(FX.base_features(S.tile_rasters(spark, sf_dir))), None)
    return f.select(*IDS, "sensitivity", fixed(F.col("stego_probability")).alias("stego_probability"), "verdict")


@query("blind_scan", f"""WITH {DOC_PX}, {DOC}{detector('source, photo_id')}
SELECT source, photo_id, image_sha256, round(prob, 6) AS stego_probability, {_VERDICT}
FROM det JOIN (SELECT source, doc_id AS photo_id, sha256(text) AS image_sha256 FROM documents) USING (source, photo_id),
     {SENSITIVITY} WHERE sensitivity = 'balanced'""")
def blind_scan(spark, sf_dir):
    f = D.blind_scan(S.document_bytes(spark, sf_dir))
    return f.select(*IDS, "image_sha256", fixed(F.col("stego_probability")).alias("stego_probability"), "verdict")


@query("topk_suspicious", f"""WITH {PX}, {EMB}
SELECT photo_id, round(med.chi2_stat, 3) AS chi2_stat, round(gn, 6) AS "RS_Gn" FROM rsg JOIN med USING (photo_id)
ORDER BY gn, photo_id LIMIT 20""")
def topk_suspicious(spark, sf_dir):
    """The 20 images with the smallest gap: the flagship slice from pixels to a ranking."""
    f = FX.base_features(S.embedding_rasters(spark, sf_dir), "native")
    top = f.orderBy("RS_Gn", "photo_id").limit(20)
    return top.select("photo_id", fixed(F.col("chi2_stat"), 3).alias("chi2_stat"), fixed(F.col("RS_Gn")).alias("RS_Gn"))


@query("chi_square_tail", f"""WITH {DOC_PX}, {DOC}
SELECT np AS n_pairs, count(*) AS n, round(avg(round({chi_p('round(stat, 3)', 'np - 1')}, 6)), 4) AS mean_p
FROM ck WHERE np > 1 GROUP BY ALL""")
def chi_square_tail(spark, sf_dir):
    from grainscope.functions.special import chi2_sf

    s = FX.summary_of(S.document_bytes(spark, sf_dir))
    rows = s.select(F.posexplode(F.arrays_zip("chi_stats", "n_pairs")).alias("k", "z")).where("z.n_pairs > 1")
    p = rows.select(F.col("z.n_pairs").cast("long").alias("n_pairs"),
                    F.round(chi2_sf(F.round("z.chi_stats", 3), F.col("z.n_pairs") - 1), 6).alias("p"))
    return p.groupBy("n_pairs").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("p"), 4).alias("mean_p"))


@query("banded_features", f"""WITH {DOC_PX} SELECT source, count(DISTINCT photo_id) AS n, count(DISTINCT photo_id) AS n_equal, 143 AS n_columns FROM px GROUP BY ALL""")
def banded_features(spark, sf_dir):
    """All 143 columns of whole documents from bands of 2048 pixels, with two rows of neighbours, against those of whole images."""
    rasters = S.document_rasters(spark, sf_dir)
    values = F.array(*[F.col(c) for c in ALL_FEATURES])
    whole = FX.full_features(rasters).select(*KEY, values.alias("a"))
    banded = FX.full_features(rasters, "banded", 2048).select(*KEY, values.alias("b"))
    near = F.forall(F.zip_with("a", "b", lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a))), lambda x: x)
    return whole.join(banded, KEY, "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(near, F.lit(False))).alias("n_equal"), F.max(F.size("b")).alias("n_columns"))

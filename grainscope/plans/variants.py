"""Queries on the labelled-variant generator and its verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainscope.functions.columns import fixed, psnr, utf8_bytes, variant_label
from grainscope.operators import corpus as C
from grainscope.operators import detector as D
from grainscope.operators import evaluate as E
from grainscope.operators import results as RS
from grainscope.operators import variants as V
from grainscope.operators.features import base_features
from grainscope.operators.geometry import jpeg_round_trip
from grainscope.plans.registry import query
from grainscope.plans.sqltext import PX, blocks_changed, coded, detector, stages, variant_rows
from grainscope.schemas import BASE, PHOTO, variant_table
from grainscope.session import save_and_reload, shared_dir
from grainscope.sources import rasters as S
from grainscope.sources import stores as ST

def sizes(covers: str, count: int = 12) -> str:
    """CTEs up to e: every cover (source, photo_id, n_px) times every variant, with message size and status."""
    return f"""{variant_rows(count)},
d AS ({covers}),
j AS (SELECT *, greatest((1 << p) - 1, 1) AS n,
             greatest(1, (CASE WHEN p >= 1 THEN n_px * p // greatest((1 << p) - 1, 1) ELSE n_px // 8 END) // 8) AS cap FROM d CROSS JOIN var),
k AS (SELECT *, CAST(CASE WHEN method = 'lsb' THEN floor(n_px * density / 8) ELSE floor(cap * density) END AS BIGINT) AS msg FROM j),
s AS (SELECT *, CASE WHEN method = 'lsb' THEN 0 ELSE greatest(2, (128 + greatest(p, 1) - 1) // greatest(p, 1)) * n END AS head,
             CASE WHEN method = 'lsb' THEN 0 ELSE (16 + 8 * msg + greatest(p, 1) - 1) // greatest(p, 1) END AS need FROM k),
e AS (SELECT *, CASE WHEN msg > 65535 THEN 'message too long' WHEN method = 'lsb' AND n_px <= 24 THEN 'image too small'
        WHEN method <> 'lsb' AND n_px <= head + n THEN 'image too small'
        WHEN method <> 'lsb' AND need * n > n_px - head THEN 'message too long' ELSE 'ok' END AS status FROM s)"""


_SIZES = "WITH " + sizes("SELECT source, doc_id AS photo_id, octet_length(encode(text)) AS n_px FROM documents "
                         "WHERE octet_length(encode(text)) > 0")


def _expanded(spark, sf_dir, preset="all"):
    return V.expand(S.document_bytes(spark, sf_dir), variant_table(spark, preset))


def _pairs(spark, sf_dir, preset="all", **kw):
    return V.coded_pairs(S.embedding_rasters(spark, sf_dir), variant_table(spark, preset), **kw)


@query("capacity", _SIZES + """ SELECT source, photo_id, variant, cap AS capacity, msg AS msg_bytes FROM e""")
def capacity(spark, sf_dir):
    e = _expanded(spark, sf_dir)
    return e.select(*PHOTO, F.col("to_variant").alias("variant"),
                    F.expr(V.capacity_bytes("cast(n_px as long)", "p")).alias("capacity"),
                    F.col("msg_bytes").cast("long").alias("msg_bytes"))


@query("variant_expand", _SIZES + """
SELECT source, variant, method, status, count(*) AS n, CAST(sum(msg) AS BIGINT) AS msg_bytes FROM e GROUP BY ALL""")
def variant_expand(spark, sf_dir):
    return _expanded(spark, sf_dir).groupBy("source", F.col("to_variant").alias("variant"), "method", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("msg_bytes").alias("msg_bytes"))


@query("variant_rejects", _SIZES + """
SELECT source, photo_id, variant, method, p, density, status FROM e WHERE status <> 'ok'""")
def variant_rejects(spark, sf_dir):
    return V.rejected_pairs(S.document_bytes(spark, sf_dir), variant_table(spark, "all"))


@query("variant_presets", f"""WITH {variant_rows(8)}
SELECT variant, method, p, density, n FROM var, (SELECT count(*) AS n FROM documents)
WHERE method <> 'lsb' AND NOT (method = 'nsF5' AND p = 3 AND density = 0.40)""")
def variant_presets(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1)).alias("n"))
    return variant_table(spark, "minimal").crossJoin(F.broadcast(n))


_DIGEST = """SELECT photo_id, variant, CAST(count_if(v <> v2) AS BIGINT) AS changed, CAST(sum(v2) AS BIGINT) AS sum_v,
       CAST(sum(i * v2) AS BIGINT) AS sum_iv FROM coded {where} GROUP BY ALL"""


def _digest(pairs):
    index = F.expr("aggregate(zip_with(sequence(0, size(coded) - 1), coded, (i, v) -> cast(i * v as long)), 0L, (a, x) -> a + x)")
    total = F.aggregate("coded", F.lit(0).cast("long"), lambda a, v: a + v)
    return pairs.select("photo_id", F.col("to_variant").alias("variant"),
                        V.changed_pixels().cast("long").alias("changed"), total.alias("sum_v"), index.alias("sum_iv"))


@query("lsb_variant", f"WITH {PX}, {coded()} " + _DIGEST.format(where="WHERE method = 'lsb'"))
def lsb_variant(spark, sf_dir):
    pairs = V.expand(V.with_cover_order(S.embedding_rasters(spark, sf_dir)), variant_table(spark, "all"))
    return _digest(V.code_lsb(pairs.where("status = 'ok' and method = 'lsb'")))


@query("matrix_variant", f"WITH {PX}, {coded()} " + _DIGEST.format(where="WHERE method = 'matrix'"))
def matrix_variant(spark, sf_dir):
    return _digest(_pairs(spark, sf_dir, producer="native").where("method = 'matrix'"))


@query("wet_paper_variant", f"WITH {PX}, {coded()} " + _DIGEST.format(where="WHERE method = 'nsF5'"))
def wet_paper_variant(spark, sf_dir):
    return _digest(_pairs(spark, sf_dir, producer="native").where("method = 'nsF5'"))


@query("coded_variants", f"WITH {PX}, {coded()} " + _DIGEST.format(where=""))
def coded_variants(spark, sf_dir):
    """All variants through the Arrow kernels."""
    return _digest(_pairs(spark, sf_dir))


@query("changed_fraction", f"""WITH {PX}, {coded(8)}
SELECT photo_id, variant, method, p, density, round(avg(CASE WHEN v <> v2 THEN 1.0 ELSE 0.0 END), 4) AS changed_frac, 1 AS label
FROM coded GROUP BY ALL
UNION ALL SELECT DISTINCT photo_id, 'clean', NULL, NULL, NULL, NULL, 0 FROM px""")
def changed_fraction(spark, sf_dir):
    corpus = V.labelled_corpus(S.embedding_rasters(spark, sf_dir), variant_table(spark))
    return corpus.select("photo_id", "variant", "method", "p", "density", "changed_frac", "label")


@query("roundtrip_verify", f"""WITH {PX}, {coded()}
SELECT DISTINCT photo_id, variant, method, msg AS msg_bytes, true AS text_ok, CASE WHEN method <> 'lsb' THEN true END AS hash_ok FROM coded""")
def roundtrip_verify(spark, sf_dir):
    """Every coded image must give back exactly its message and its cover's hash."""
    return V.round_trip(_pairs(spark, sf_dir)).select(
        "photo_id", F.col("to_variant").alias("variant"), "method", F.col("msg_bytes").cast("long").alias("msg_bytes"),
        "text_ok", "hash_ok")


@query("efficiency", f"""WITH {PX}, {coded()},
t AS (SELECT photo_id, variant, method, p, any_value(msg) * 8 + 16 AS bits, count_if(v <> v2) AS changed FROM coded GROUP BY ALL)
SELECT method, p, CAST((1 << p) - 1 AS INTEGER) AS n, round(p * (1 << p) / CAST((1 << p) - 1 AS DOUBLE), 6) AS alpha, CAST(sum(bits) AS BIGINT) AS bits,
       CAST(sum(changed) AS BIGINT) AS changed, round(sum(bits) / sum(changed), 6) AS measured_alpha
FROM t WHERE p > 0 GROUP BY ALL""")
def efficiency(spark, sf_dir):
    return V.measured_efficiency(_pairs(spark, sf_dir).where("method <> 'lsb'")).select(
        "method", "p", "n", fixed(F.col("alpha")).alias("alpha"), "bits", "changed",
        fixed(F.col("measured_alpha")).alias("measured_alpha"))


@query("psnr", f"""WITH {PX}, {coded()}
SELECT photo_id, variant, CASE WHEN sum((v - v2) * (v - v2)) > 0
       THEN round(10 * log10(65025.0 / avg(CAST((v - v2) * (v - v2) AS DOUBLE))), 6) END AS psnr FROM coded GROUP BY ALL""")
def psnr_of_variants(spark, sf_dir):
    q = V.quality(_pairs(spark, sf_dir))
    return q.select("photo_id", F.col("to_variant").alias("variant"),
                    fixed(psnr(F.col("square_error") / F.col("n_px"))).alias("psnr"))


@query("footprint_by_density", f"""WITH {PX}, {coded()}
SELECT method, p, density, round(count_if(v <> v2) / count(*), 10) AS footprint FROM coded GROUP BY ALL""")
def footprint_by_density(spark, sf_dir):
    q = V.quality(_pairs(spark, sf_dir)).groupBy("method", "p", "density").agg(
        F.sum("changed").alias("c"), F.sum(F.col("n_px").cast("long")).alias("n"))
    return q.select("method", "p", "density", fixed(F.col("c") / F.col("n"), 10).alias("footprint"))


@query("keyed_order", f"""WITH {PX}, img AS (SELECT photo_id, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY i))) AS h FROM px GROUP BY ALL),
o AS (SELECT photo_id, i, row_number() OVER (PARTITION BY photo_id ORDER BY substr(md5(substr(h, 1, 32) || ':' || i // 4), CAST(8 * (i % 4) + 1 AS BIGINT), 8), i) AS r FROM px JOIN img USING (photo_id))
SELECT photo_id, CAST(sum(r * i) AS BIGINT) AS order_sum, CAST(sum(r * r % 1009 * i) AS BIGINT) AS order_mix, count(*) AS n FROM o GROUP BY ALL""")
def keyed_order(spark, sf_dir):
    """Pixel order keyed by the image content, as a checksum."""
    o = V.with_cover_order(S.embedding_rasters(spark, sf_dir)).select("photo_id", F.posexplode("ordered").alias("r", "c"))
    r, i = F.col("r").cast("long") + 1, F.col("c.i").cast("long")
    return o.groupBy("photo_id").agg(F.sum(r * i).alias("order_sum"), F.sum(r * r % 1009 * i).alias("order_mix"),
                                     F.count(F.lit(1)).alias("n"))


@query("text_bits", """WITH b AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, regexp_extract_all(hex(encode(text)), '..') AS bs FROM conversations),
x AS (SELECT conv_id, turn, n, list_transform(bs, lambda h: CAST('0x' || h AS INTEGER)) AS bs FROM b)
SELECT conv_id, turn, CAST(16 + 8 * n AS BIGINT) AS n_bits,
       CAST(bit_count(n) + coalesce(list_sum(list_transform(bs, lambda v: bit_count(v))), 0) AS BIGINT) AS ones, true AS restored FROM x""")
def text_bits(spark, sf_dir):
    """Messages to bits and back, for every message of the conversations table."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("bits", V.message_bits(F.col("text")))
    back = t.withColumn("back", V.text_of_bits("bits"))
    return back.select("conv_id", "turn", F.size("bits").cast("long").alias("n_bits"),
                       F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b).alias("ones"),
                       (F.col("back") == F.col("text")).alias("restored"))


@query("variant_labels", f"""WITH {variant_rows()}
SELECT variant, method || CASE WHEN p > 0 THEN ' p' || p ELSE '' END || ' d=' || printf('%.2f', density) AS label_text, count(*) AS n
FROM documents JOIN var ON variant = 'v' || (doc_id % 12) GROUP BY ALL""")
def variant_labels(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("v"), (F.col("doc_id") % 12).cast("string")).alias("variant"))
    named = d.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(variant_table(spark, "all")), "variant")
    return named.select("variant", variant_label(F.col("method"), F.col("p"), F.col("density")).alias("label_text"), "n")


# Payload curve: density grid of one code, density 0 is the cover itself.
_GRID = [(f"c{i}", "nsF5", 3, d) for i, d in enumerate([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4])]


def _curve_sql() -> str:
    rows = ", ".join(f"('{v}', '{m}', {p}, CAST({d} AS DOUBLE))" for v, m, p, d in _GRID)
    body = coded().replace(variant_rows(), f"var AS (SELECT * FROM (VALUES {rows}) AS t(variant, method, p, density) WHERE density > 0)")
    px = PX.replace("px AS", "px0 AS", 1)
    body = body.replace(" px ", " px0 ").replace("JOIN px USING", "JOIN px0 USING")
    key = "photo_id, density"
    return (f"WITH {px}, {body}, px AS (SELECT photo_id, CAST(0 AS DOUBLE) AS density, i, i // 64 AS y, i % 64 AS x, v FROM px0 "
            f"UNION ALL SELECT photo_id, density, i, i // 64, i % 64, v2 FROM coded), {stages(key)}{detector(key)}\n"
            "SELECT photo_id, density, round(chi2_pvalue, 6) AS chi2_pvalue, round(rate_rs * 100, 5) AS rs_rate, "
            "round(prob, 6) AS stego_probability FROM det")


def grid_table(spark):
    return spark.createDataFrame(_GRID, "variant string, method string, p int, density double")


@query("payload_curve", _curve_sql())
def payload_curve(spark, sf_dir):
    c = D.payload_curve(S.embedding_rasters(spark, sf_dir), grid_table(spark))
    return c.select("photo_id", "density", fixed(F.col("chi2_pvalue")).alias("chi2_pvalue"),
                    fixed(F.col("rs_rate"), 5).alias("rs_rate"), fixed(F.col("stego_probability")).alias("stego_probability"))


@query("variant_delta")
def variant_delta(spark, sf_dir):
    """Largest feature difference between each photo and its recompressed clean row."""
    clean = S.embedding_rasters(spark, sf_dir)
    f = base_features(clean.unionByName(jpeg_round_trip(clean)))
    return C.variant_delta(f, BASE, "clean", "clean_jpeg")


@query("corpus_grouping", f"""WITH {PX} SELECT list_sort(['clean'] || list(DISTINCT variant)) AS variants, count(DISTINCT photo_id) AS n_photos
FROM px, (SELECT unnest(['clean_jpeg', 'v0', 'v1', 'v2', 'v3', 'v4', 'v5', 'v6', 'v7']) AS variant)""")
def corpus_grouping(spark, sf_dir):
    """Full corpus with the recompressed clean rows: all photos carry the same variant set."""
    clean = S.embedding_rasters(spark, sf_dir)
    corpus = V.labelled_corpus(clean, variant_table(spark)).select(*PHOTO, "variant")
    every = corpus.unionByName(jpeg_round_trip(clean).select(*PHOTO, "variant"))
    return C.variant_sets(every).groupBy("variants").agg(F.count(F.lit(1)).alias("n_photos"))


@query("tamper_matrix", f"""WITH {PX}, {coded()},
s AS (SELECT photo_id, variant, method, unnest(['clean', 'stego', 'tampered']) AS state, unnest([v, v2, CASE WHEN i % 97 = 0 THEN xor(v2, 1) ELSE v2 END]) AS v, i FROM coded)
SELECT photo_id, variant, state, substr(sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY i))), 1, 16) AS fingerprint, state = 'stego' AS restored,
       CASE WHEN method <> 'lsb' THEN state = 'stego' END AS hash_ok
FROM s GROUP BY photo_id, variant, method, state""")
def tamper_matrix(spark, sf_dir):
    """Fingerprint and readability of clean, coded and tampered images of all variants, from one coding pass."""
    seen = V.extract_text(V.tamper_states(_pairs(spark, sf_dir)), px="seen")
    return seen.select("photo_id", F.col("to_variant").alias("variant"), "state", F.substring(S.content_hash("seen"), 1, 16).alias("fingerprint"),
                       (F.col("found_text") == F.col("message")).alias("restored"),
                       (F.col("found_hash") == F.substring("cover_sha256", 1, 32)).alias("hash_ok"))


def write_records(spark, sf_dir, folder):
    """A JSON line per coded image. Four in five are falsified, each in another field; a broken line follows each image's records."""
    pairs = _pairs(spark, sf_dir)
    kind = (F.col("photo_id") + F.substring("to_variant", 2, 9).cast("int")) % 5
    sha = F.sha2(F.lit("x"), 256)

    def unless(k, value, other):
        return F.when(kind == k, other).otherwise(value)

    record = F.struct(
        F.lit("experiment/1").alias("schema"),
        F.struct(F.lit("pixel").alias("domain"), "method", F.col("p").alias("hamming_p"), F.lit(False).alias("password_used")).alias("algorithm"),
        F.struct((F.col("msg_bytes") * 8).alias("bits"), F.col("msg_bytes").alias("chars"), unless(1, F.sha2("message", 256), sha).alias("message_sha256")).alias("payload"),
        F.struct(unless(0, F.col("cover_sha256"), sha).alias("sha256"), F.concat(F.col("source"), F.lit("/"), F.col("photo_id")).alias("path")).alias("cover"),
        F.struct(unless(3, S.content_hash("coded"), sha).alias("sha256"), F.col("to_variant").alias("path")).alias("stego"),
        F.struct((V.changed_pixels() + unless(2, F.lit(0), F.lit(1))).alias("changed_cells"), F.lit("pixels").alias("cell_unit")).alias("result"))
    lines = pairs.select(F.to_json(record).alias("value"))
    broken = S.embedding_rasters(spark, sf_dir).select(F.concat(F.lit('{"schema": "experiment/1", "cover": '), F.col("photo_id")).alias("value"))
    lines.unionByName(broken).write.text(folder)


@query("replay_check", f"""WITH {PX}, {coded()},
t AS (SELECT photo_id, variant, (photo_id + CAST(substr(variant, 2) AS INTEGER)) % 5 AS k, count_if(v <> v2) AS changed, sha256(repeat('S', any_value(msg)::INT)) AS message,
             sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY i))) AS cover, sha256(unhex(string_agg(printf('%02x', v2), '' ORDER BY i))) AS stego
      FROM coded GROUP BY ALL)
SELECT photo_id, variant, k = 4 AS all_ok, unnest(['cover_sha256', 'message_sha256', 'changed_cells', 'stego_sha256']) AS "check",
       unnest([CASE WHEN k = 0 THEN sha256('x') ELSE cover END, CASE WHEN k = 1 THEN sha256('x') ELSE message END,
               CAST(changed + CASE WHEN k = 2 THEN 1 ELSE 0 END AS VARCHAR), CASE WHEN k = 3 THEN sha256('x') ELSE stego END]) AS expected,
       unnest([cover, message, CAST(changed AS VARCHAR), stego]) AS actual, unnest([k <> 0, k <> 1, k <> 2, k <> 3]) AS ok FROM t
UNION ALL SELECT photo_id, NULL, false, 'readable', '{{"schema": "experiment/1", "cover": ' || photo_id, NULL, false FROM (SELECT DISTINCT photo_id FROM px)""")
def replay_check(spark, sf_dir):
    """Stored records of all coded images against a new coding and extraction: each falsified field is found, and no other.

    Messages are not stored in records; they are supplied by variant and cover size."""
    folder = f"{shared_dir(spark)}/records"
    write_records(spark, sf_dir, folder)
    records, broken = ST.read_record_lines(spark, folder)
    keyed = records.select(
        F.split("cover.path", "/")[0].alias("source"), F.split("cover.path", "/")[1].cast("long").alias("photo_id"), F.col("stego.path").alias("variant"),
        F.concat_ws(":", "cover.path", "stego.path").alias("record_id"), F.col("algorithm.method").alias("method"), F.col("algorithm.hamming_p").alias("p"),
        F.repeat(F.lit(V.MESSAGE_LETTER), F.col("payload.chars").cast("int")).alias("message"), F.col("cover.sha256").alias("cover_sha256"),
        F.col("payload.message_sha256").alias("message_sha256"), F.col("result.changed_cells").alias("changed_cells"), F.col("stego.sha256").alias("stego_sha256"))
    keyed = save_and_reload(keyed, f"{shared_dir(spark)}/keyed")
    now = V.replay_records(keyed, S.embedding_rasters(spark, sf_dir))
    checks = RS.replay_checks(keyed, now, ["record_id"]).join(keyed.select("record_id", "photo_id", "variant"), "record_id").drop("record_id")
    unread = broken.select(F.regexp_extract("line", "([0-9]+)$", 1).cast("long").alias("photo_id"), F.lit(None).cast("string").alias("variant"),
                           F.lit(False).alias("all_ok"), F.lit("readable").alias("check"), F.col("line").alias("expected"),
                           F.lit(None).cast("string").alias("actual"), F.lit(False).alias("ok"))
    return checks.unionByName(unread)


@query("detector_blocks", f"""WITH {PX}, {stages()}{detector()}, big AS (SELECT photo_id FROM px GROUP BY ALL HAVING count(*) >= 4096)
SELECT d.photo_id, b.photo_id IS NOT NULL AS scanned, CASE WHEN scanned THEN round(gn, 6) END AS "RS_Gn",
       CASE WHEN scanned THEN round(prob, 6) END AS stego_probability, CASE WHEN scanned THEN false END AS ml_available FROM det AS d LEFT JOIN big AS b USING (photo_id)""")
def detector_blocks(spark, sf_dir):
    """Records of all images with the detector's findings attached; images under the minimum size are not scanned, and no
    model was at hand."""
    rasters = S.embedding_rasters(spark, sf_dir)
    scans = D.model_scan(S.large_enough(rasters), None)
    r = RS.with_detector_block(rasters.select("source", "photo_id"), scans, ["source", "photo_id"])
    return r.select("photo_id", F.col("detector").isNotNull().alias("scanned"),
                    fixed(F.col("detector.RS_Gn")).alias("RS_Gn"),
                    fixed(F.col("detector.stego_probability")).alias("stego_probability"), F.col("detector.ml_available").alias("ml_available"))


# ---------------------------------------------------------------- code sizes p = 1..8
SWEEP = [(f"s{m[0]}{p}", m, p, 0.5) for m in ("matrix", "nsF5") for p in range(1, 9)]


def _sweep_sql() -> str:
    """Changed cells and bits of the block codes of all sizes on images of 256 vectors, from blocks alone."""
    rows = ", ".join(f"('{v}', '{m}', {p}, CAST({d} AS DOUBLE))" for v, m, p, d in SWEEP)
    body = blocks_changed().replace(variant_rows(), f"var AS (SELECT * FROM (VALUES {rows}) AS t(variant, method, p, density))")
    px = PX.replace("px AS", "px1 AS", 1)
    return f"""WITH {px}, px AS (SELECT photo_id // 4 AS photo_id, photo_id % 4 * 4096 + i AS i, v FROM px1), {body},
c AS (SELECT method, p, count_if(d <> 0 AND (pick = 1 OR pick = -1)) + sum(CASE WHEN pick > 1 THEN pick ELSE 0 END) AS changed FROM bp JOIN var USING (variant) GROUP BY ALL),
b AS (SELECT method, p, sum(8 * msg + 16)::BIGINT AS bits FROM job GROUP BY ALL)
SELECT method, p, ((1 << p) - 1)::INTEGER AS n, round(p * (1 << p) / CAST((1 << p) - 1 AS DOUBLE), 6) AS alpha, bits, changed::BIGINT AS changed,
       round(bits / changed, 6) AS measured_alpha, true AS read_back FROM b JOIN c USING (method, p)"""


@query("efficiency_sweep", _sweep_sql())
def efficiency_sweep(spark, sf_dir):
    """Message bits per changed cell for both block codes and p = 1..8, each message read back from its image."""
    sweep = spark.createDataFrame(SWEEP, "variant string, method string, p int, density double")
    pairs = V.coded_pairs(S.embedding_rasters(spark, sf_dir, 256), sweep)
    small = pairs.select(*PHOTO, "to_variant", "method", "p", "msg_bytes", "px", "coded", "message", "head_px", "cover_sha256", "density", "n_px")
    read = V.round_trip(small).groupBy("method", "p").agg(F.bool_and(F.expr("text_ok and hash_ok")).alias("read_back"))
    return V.measured_efficiency(pairs).join(read, ["method", "p"]).select(
        "method", "p", "n", fixed(F.col("alpha")).alias("alpha"), "bits", "changed", fixed(F.col("measured_alpha")).alias("measured_alpha"), "read_back")


def _corpus_sql(select: str) -> str:
    """Labelled corpus of the first 8 variants with the detector's probability per row."""
    px = PX.replace("px AS", "px0 AS", 1)
    body = coded(8).replace(" px ", " px0 ").replace("JOIN px USING", "JOIN px0 USING")
    key = "photo_id, variant"
    return (f"WITH {px}, {body}, px AS (SELECT photo_id, 'clean' AS variant, i, i // 64 AS y, i % 64 AS x, v FROM px0 "
            f"UNION ALL SELECT photo_id, variant, i, i // 64, i % 64, v2 FROM coded), {stages(key)}{detector(key)},\n"
            f"lab AS (SELECT photo_id, variant, method, p, density, CASE WHEN method IS NULL THEN 0 ELSE 1 END AS label, "
            f"round(1 - gn, 6) AS score, prob FROM det LEFT JOIN var USING (variant))\n{select}")


def labelled_scores(spark, sf_dir):
    """Labelled corpus scored by the fall of the gap, one row per image and variant."""
    corpus = V.labelled_corpus(S.embedding_rasters(spark, sf_dir), variant_table(spark))
    f = base_features(corpus.select("source", "photo_id", "variant", "height", "width", "px"))
    meta = corpus.drop("px", "height", "width")
    return f.join(meta, ["source", "photo_id", "variant"]).withColumn("score", fixed(1.0 - F.col("RS_Gn")))


@query("corpus_detection", _corpus_sql("""SELECT method, p, density, count(*) AS n, CAST(sum(CASE WHEN score >= 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_detected
FROM lab GROUP BY ALL"""))
def corpus_detection(spark, sf_dir):
    rates = E.detection_rates(labelled_scores(spark, sf_dir), ["method", "p", "density"], "score", F.lit(0.95))
    return rates.select("method", "p", "density", "n", "n_detected")


@query("corpus_auc", _corpus_sql("""SELECT count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg,
(SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6)
 FROM lab a, lab b WHERE a.label = 1 AND b.label = 0) AS auc FROM lab"""))
def corpus_auc(spark, sf_dir):
    a = E.auc(labelled_scores(spark, sf_dir))
    return a.select("n_pos", "n_neg", fixed(F.col("auc")).alias("auc"))


@query("utf8_bytes", """SELECT item_id, CAST(octet_length(encode(text)) AS BIGINT) AS n,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER))), 0) AS BIGINT) AS total FROM benchmark""")
def utf8(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", utf8_bytes(F.col("text")).alias("b"))
    return b.select("item_id", F.size("b").cast("long").alias("n"),
                    F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

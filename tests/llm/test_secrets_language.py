import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from grainscope.llm.language import held_out, identify, in_a_language, train_language_model
from grainscope.llm.secretscan import (
    ALPHABET,
    as_text,
    labelled_tokens,
    pair_weights,
    prefix_sums,
    redact,
    scan_secrets,
)

ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)


def base_plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


TRICKY = [
    "token=secret: abcdefghij", "password = 'short' passwd:\"long-enough-1\"", "API_KEY=AKIA" + "Z9" * 8, "AKIA123 AKIAAKIA" + "A" * 9,
    "0" * 31 + "g" + "f" * 32, "😀 ñ token: " + "a" * 40 + " end", "token" * 50, "apikey==x" * 3, "secret: " + "=" * 9, None, "",
    "paſſword=abcdefgh token=K" + "b" * 9, " ".join(f"token=val{i:09d}" for i in range(200)), "deadbeef" * 4 + "\n" + "deadbeef" * 5]
NO_WEIGHTS = [0.0] * len(ALPHABET) ** 2


def test_base_spans(docs, odd):
    texts = [*TRICKY, *odd]
    rows = scan_secrets(docs(texts), NO_WEIGHTS).select("doc_id", as_text(F.col("base")).alias("s"), as_text(F.col("found")).alias("f"))
    assert {r.doc_id: r.s for r in rows.collect()} == {i: base_plain(t) for i, t in enumerate(texts)}
    assert all(r.s == r.f for r in rows.collect())
    assert scan_secrets(docs(["x"]).limit(0), NO_WEIGHTS).count() == 0


def test_scan_is_native(docs):
    plan = redact(docs(["a"]), NO_WEIGHTS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Exchange RoundRobin")[0]


def test_prefix_sums(spark):
    for n in (1, 63, 64, 65, 300):
        a = list(range(n))
        row = spark.createDataFrame([(a,)], "a array<long>").select(prefix_sums(F.col("a"))).first()[0]
        assert row == [sum(a[:i + 1]) for i in range(n)]


@pytest.fixture(scope="module")
def weights(spark):
    rng = random.Random(4)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [f"the parser reads input_lines and returns_values for every request token = "
             f"{''.join(rng.choice(chars) for _ in range(30))}" for _ in range(300)]
    return pair_weights(labelled_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))


def test_markov_finds_random_strings_and_leaves_words(docs, weights):
    rng = random.Random(9)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    random_text = ["key " + "".join(rng.choice(chars) for _ in range(32)) + " end" for _ in range(40)]
    plain_text = ["returns_values_for_every_request_and_reads_input_lines", "thereaderreturnseveryvalue", "the parser"]
    rows = scan_secrets(docs(random_text + plain_text), weights).collect()
    found = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == 3] for r in rows}
    assert sum(found[i] == [(4, 36)] for i in range(40)) >= 36
    assert all(found[i] == [] for i in range(40, 43))


def test_redaction(docs, weights):
    texts = ["a token = 'abcdefgh12345' b", "x " + "0a" * 20 + " y 😀 token=" + "f" * 40, "clean", None, ""]
    rows = redact(docs(texts), weights)
    assert rows.columns == docs(["x"]).columns
    assert {r.doc_id: r.text for r in rows.collect()} == {
        0: "a [SECRET]' b", 1: "x [SECRET] y 😀 [SECRET]", 2: "clean", 3: None, 4: ""}


def test_without_samples_nothing_is_added(docs):
    assert set(pair_weights(labelled_tokens(docs(["plain words only", None])))) == {0.0}


def test_rare_secrets_of_a_large_table_are_learned(spark):
    """20 labelled rows among 400 000: all are counted, however many documents there are."""
    secret = F.concat(F.lit("token = "), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 30))
    rows = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("reads words").alias("text"))
    rows = rows.withColumn("text", F.when(F.col("doc_id") % 20_000 == 7, secret).otherwise(F.col("text")))
    counts = {r.secret: r["count"] for r in labelled_tokens(rows).groupBy("secret").count().collect()}
    assert counts[True] == 20 and counts[False] >= 2 * (400_000 - 20)
    assert any(pair_weights(labelled_tokens(rows)))


# ---------------------------------------------------------------- language
def test_held_out_accuracy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = identify(rows, train_language_model(rows)).withColumn("h", held_out("doc_id")).collect()
    assert len(got) == rows.count()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r.h and r.lang]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_uses_the_text_alone(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(rows)
    other = rows.select((F.col("doc_id") + 10 ** 6).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).alias("source"))
    a = {r.text: (r.lang_pred, r.score) for r in identify(rows, model).collect()}
    assert all(a[r.text] == (r.lang_pred, r.score) for r in identify(other, model).collect())


def test_language_edges(spark, sf_dir, docs, odd):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(rows)
    got = identify(docs([*odd, "123 !?", None]), model).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.id == "x" and (r.lang_pred != "und" or r.score == 0)
    assert identify(docs(["x"]).limit(0), model).count() == 0
    assert train_language_model(rows.limit(0)) is None
    assert train_language_model(rows.withColumn("lang", F.lit(None).cast("string"))) is None
    assert identify(docs(["abc"]), None).first().lang_pred == "und"


def test_language_stage_follows_the_model(spark, sf_dir):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rng = random.Random(1)
    strange = ["".join(chr(rng.randint(0x100, 0x24f)) for _ in range(300)), "日本語のテキストはここにあります" * 12,
               "השועל החום המהיר קופץ מעל הכלב העצלן " * 6]
    extra = rows.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    for i, t in enumerate([*strange, "日本"]):
        extra = extra.unionByName(rows.limit(1).withColumns({"doc_id": F.lit(-1 - i).cast("long"), "text": F.lit(t), "lang": F.lit(None).cast("string")}))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, rows.unionByName(extra), "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows.collect() if any(c.isalpha() for c in r.text or "")} | {-4}
    # no labels, or only held-out rows with one
    for case in (rows.withColumn("lang", F.lit(None).cast("string")), rows.where(held_out("doc_id"))):
        left = corpus_pipeline.language(spark, case, "")
        assert left.columns == rows.columns
        assert {r.doc_id for r in left.collect()} == {r.doc_id for r in case.collect() if any(c.isalpha() for c in r.text or "")}
    assert in_a_language(rows.limit(0), None).count() == 0

import pytest

from test_dedup import components_plain, lines_plain, shingles_plain
from test_encoding import check_pieces, expected
from test_secrets_language import base_plain

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        out.append((docs.collect(), docs.columns, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "secrets", "packing"]


def test_columns_stay(stages):
    assert all(after.columns == columns for _, columns, after in stages[:-1])


def test_language_stage(stages):
    before, _, after = stages[0]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}


def test_lines_stage(stages):
    before, _, after = stages[1]
    want = lines_plain([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, (t, n) in want.items() if t or not n}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicate_stage(stages):
    before, _, after = stages[2]
    label = components_plain({r.doc_id: shingles_plain(r.text) for r in before})
    assert {r.doc_id for r in after.collect()} == {i for i, c in label.items() if i == c}


def test_secret_stage(stages):
    before, _, after = stages[3]
    old = {r.doc_id: r.text for r in before}
    for r in after.collect():
        assert base_plain(r.text) == ""
        if not base_plain(old[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == old[r.doc_id]
    assert after.count() == len(before)


def test_packing_stage(stages):
    before, _, after = stages[4]
    check_pieces(after.collect(), {r.doc_id: expected(r.text) for r in before}, 4096)


def test_columns_named_like_a_stage_s_own_stay(spark, sf_dir):
    """Values of such columns pass through, and the decisions stay the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["score", "lang_pred", "_letter", "n_lines", "n_removed", "n_spans"]
    more = docs.selectExpr("*", *[f"doc_id + {i} as {c}" for i, c in enumerate(names)])
    for stage in (corpus_pipeline.language, corpus_pipeline.lines):
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns
        rows = out.collect()
        assert all([r[c] for c in names] == [r.doc_id + i for i in range(len(names))] for r in rows)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, sf_dir).select("doc_id").collect())


def test_packing_remembers_few_words_and_gives_the_same_pieces(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i % 7}x{j * 31 % 211}" for j in range(40 + i))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pack = corpus_pipeline.pack
    whole = sorted(map(tuple, pack(docs, corpus_pipeline.WORDS).collect()))
    assert sorted(map(tuple, pack(docs, corpus_pipeline.WORDS, max_words=50, slice_bytes=300).collect())) == whole
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "pack", lambda *a, **kw: asked.update(kw))
    corpus_pipeline.packing(spark, docs, "")
    assert asked["max_words"] <= 150_000 and asked["slice_bytes"] <= 1 << 20

"""Passage dedup, source divergence and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest

import __spark_entry__ as entry_points
from grainscope.llm import divergence, passages, spelling


# ---------------------------------------------------------------- plain versions
def passages_plain(rows, window):
    """(n_words, removed words, kept text) of rows (id, text); a missing id is larger than all."""
    order = [float("inf") if i is None else i for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for key, w in zip(order, words):
        for p in range(len(w) - window + 1):
            first[tuple(w[p:p + window])] = min(key, first.get(tuple(w[p:p + window]), key))
    out = []
    for key, w in zip(order, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key:
                gone |= set(range(p, p + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def divergence_plain(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            counts[s].update(t for t in terms if held[t] >= least)
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}

        def gap(a, b):
            return (a - b) * (a - b) // b

        for s in counts.keys() - {None}:
            pair = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in counts.keys() - {None, s}]
            term = [(t, gap(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)
                        if part == "pair" or k <= top]
    return out


def spelling_plain(rows, every):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, count = {}, {}
    for w, c in words.items():
        some = [v for v in words if v != w and near(v, w)]
        count[w] = len(some)
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, count[w], words[form[w]] if form[w] else None))
    return out


def as_rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- passages
def shared_passages(words, rng):
    """Texts of 0 to 150 words with copies, shared passages around the window's length, and repeats within a text."""
    texts = [words(rng.randint(0, 150)) for _ in range(40)]
    for n in (48, 49, 50, 51, 60, 90):
        passage = words(n)
        for i in rng.sample(range(40), 5):
            at = rng.randrange(len(texts[i]) + 1)
            texts[i][at:at] = passage
    texts[3] += texts[3]
    return [" ".join(t) for t in [*texts, texts[5], texts[5], texts[9][2:]]]


@pytest.mark.parametrize("window", [50, 7, 1])
def test_passages_equal_plain(docs, words, odd, window):
    rng = random.Random(3)
    texts = shared_passages(words, rng) + odd + [" ".join(["same"] * 130), " ".join(["same"] * 131)]
    rng.shuffle(texts)
    out = passages.dedup_passages(docs(texts), window=window).collect()
    rows = list(enumerate(texts))
    want = dict(zip(range(len(texts)), passages_plain(rows, window)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == want
    assert len(out) == len(texts)
    for r in out:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed
        assert all(a.last < b.first for a, b in zip(r.spans, r.spans[1:]))


def test_passages_ids(docs, words):
    """Equal ids lose nothing to each other; a NULL id comes last; repeated rows are treated alike."""
    shared = " ".join(words(70))
    own = [" ".join(words(20)) for _ in range(6)]
    rows = [(5, f"{own[0]} {shared}"), (5, f"{shared} {own[1]}"), (5, f"{own[0]} {shared}"), (None, f"{shared} {own[2]}"),
            (None, f"{own[3]} {shared}"), (9, f"{own[4]} {shared} {own[5]}")]
    out = passages.dedup_passages(docs(rows))
    got = sorted(((r.doc_id, r.n_removed, r.kept) for r in out.collect()), key=repr)
    want = sorted(((i, p[1], p[2]) for (i, _), p in zip(rows, passages_plain(rows, 50))), key=repr)
    assert got == want and sum(g[1] for g in got) == 3 * 70
    only_null = [(None, shared), (None, f"{shared} {own[0]}")]
    assert [r.n_removed for r in passages.dedup_passages(docs(only_null)).collect()] == [0, 0]


def test_passages_empty_table_and_text_ids(spark, docs, words):
    assert passages.dedup_passages(docs([]).where("false")).count() == 0
    shared = " ".join(words(55))
    t = spark.createDataFrame([("b", shared), ("a", shared), ("c", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in passages.dedup_passages(t).collect()} == {"a": 0, "b": 55, "c": 0}


def test_smallest_within():
    values = np.random.default_rng(1).integers(0, 9, 200)
    for width in (1, 2, 3, 17, 39):
        at = passages.smallest_within(values, width)
        assert len(at) == 201 - width
        assert all(values[a] == values[i:i + width].min() and i <= a < i + width for i, a in enumerate(at))


def test_hot_passage(docs, words):
    """One passage in two thirds of the documents, with other words around it."""
    shared = " ".join(words(64))
    texts = [f"{' '.join(words(12))} {shared} {' '.join(words(12))}" if i % 3 else " ".join(words(80)) for i in range(240)]
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.dedup_passages(docs(texts)).collect()}
    assert out == dict(enumerate(passages_plain(list(enumerate(texts)), 50)))


# ---------------------------------------------------------------- divergence
def labelled(words, odd, n=60):
    rng = random.Random(5)
    rows = [(" ".join(w.title() if rng.random() < .2 else w for w in words(rng.randint(0, 60)) + words(3) * 2),
             rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "Ä", "\U0001F600", None, ""])) for _ in range(n)]
    return rows + [(t, "xx", f"s{i % 3}") for i, t in enumerate(odd)] + [("", "lone", "x"), (None, "lone", "y"), ("Q q\x00Q", "one", "x")]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(
        [(*r, 1, 2, "t") for r in rows], "text string, lang string, source string, n int, value int, term string").repartition(3)


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 5)])
def test_divergence_equals_plain(table, words, odd, least, top, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 300)
    monkeypatch.setattr(divergence, "CELLS", 64)
    rows = labelled(words, odd)
    got = as_rows(divergence.source_divergence(table(rows), least=least, top=top), ["lang", "source", "part", "item", "value", "rank"])
    assert got == sorted(divergence_plain(rows, least, top), key=repr)


def test_divergence_without_terms(table):
    assert divergence.source_divergence(table([]).where("false")).count() == 0
    rows = [(None, None, "a"), ("", None, "b"), ("once", None, "c")]
    got = as_rows(divergence.source_divergence(table(rows)), ["lang", "source", "part", "item", "value", "rank"])
    assert got == sorted(divergence_plain(rows, 3, 200), key=repr) and len(got) == 6


def test_share_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(1, 9 * 10**15)
        count = np.array([rng.randint(0, total) for _ in range(20)] + [0, total])
        assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]


def test_term_counts_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["Aa aA b", None, "b"], "lang": ["x", "x", None], "source": ["s", "t", "s"]},
                                       schema=pa.schema([(c, pa.string()) for c in ("text", "lang", "source")]))
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["df"]) for r in divergence.term_counts(batch).to_pylist()}
    assert got == {("x", "s", "aa"): (2, 1), ("x", "s", "b"): (1, 1), ("", "s", "b"): (1, 1),
                   ("x", "s", None): (0, 0), ("x", "t", None): (0, 0), ("", "s", None): (0, 0)}


# ---------------------------------------------------------------- spelling
def misspelled(rng, n=120):
    """Texts whose words are mostly one edit away from others."""
    letters = "abcdeéÿß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(30)]
    stock = defaultdict(int)
    for w in base:
        stock[w] += rng.randint(1, 40)
        for _ in range(6):
            i = rng.randrange(len(w))
            for v in (w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]):
                stock[v] += rng.randint(1, 8)
    stock |= {"planeaa": 12, "planeba": 40, "planebac": 130}     # a chain
    every = [w.upper() if rng.random() < .1 else w for w, k in stock.items() for _ in range(k)]
    rng.shuffle(every)
    return [" ".join(every[i::n]) for i in range(n)]


@pytest.mark.parametrize(("tile", "block", "every"), [(256, 512, 97), (4, 3, 7)])
def test_spelling_equals_plain(docs, odd, monkeypatch, tile, block, every):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "BLOCK", block)
    texts = [*misspelled(random.Random(4)), *odd, *odd, *odd]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3])]
    got = as_rows(spelling.spelling_variants(docs(rows), every=every), ["word", "form", "root", "n", "n_near", "form_n"])
    want = sorted(spelling_plain(rows, every), key=repr)
    assert got == want
    assert any(w[1] and w[2] != w[1] for w in want), "a chain of forms occurs"


def test_spelling_hot_end(docs, monkeypatch):
    """Most words share their beginning, so one tile is cut into many blocks."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(6)
    vocabulary = {"inter" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(150)}
    texts = [" ".join(vocabulary)] * 3 + [" ".join(sorted(vocabulary)[::2])] * 4
    rows = list(enumerate(texts))
    got = as_rows(spelling.spelling_variants(docs(rows)), ["word", "form", "root", "n", "n_near", "form_n"])
    assert got == sorted(spelling_plain(rows, 97), key=repr)


def test_spelling_without_words(docs):
    assert spelling.spelling_variants(docs([]).where("false")).count() == 0
    assert spelling.spelling_variants(docs(["", None, "abcd abcd abcd", "only twice only twice"])).count() == 0


# ---------------------------------------------------------------- registered queries
@pytest.mark.parametrize("name", ["op11_passages", "op12_source_divergence", "op13_spelling"])
def test_query_types(spark, sf_dir, name):
    df = entry_points.queries()[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    for c in ("n_words", "n_removed", "value", "n", "n_near", "form_n"):
        assert kinds.get(c, "bigint") == "bigint"
    assert kinds.get("rank", "int") == "int"
    assert oracle.differences(df, oracle.connect(sf_dir), entry_points.oracle_sql()[name]) == []

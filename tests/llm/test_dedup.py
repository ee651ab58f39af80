import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from grainscope.llm import jaccard, suffixes
from grainscope.llm.graph import components, local_links
from grainscope.llm.hashing import Rolling
from grainscope.llm.linededup import dedup_lines

# ---------------------------------------------------------------- plain versions


def removed_plain(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p:p + 200] for x in raw for p in range(len(x) - 199))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for p in range(len(x) - 199):
            if seen[x[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(x, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(x), sum(gone), runs, kept))
    return out


def shingles_plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def components_plain(sets):
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    return label


def lines_plain(rows, window=3):
    seen, out = set(), {}
    for key, text in sorted(rows):
        parts = text.split("\n")
        gone = set()
        for i in range(len(parts) - window + 1):
            w = tuple(parts[i:i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[key] = ("\n".join(p for i, p in enumerate(parts) if i not in gone), len(gone))
    return out


# ---------------------------------------------------------------- suffixes
def mixture(words, rng):
    """Texts with exact copies, shared passages of many lengths, repeats within a text and a constant run."""
    base = [" ".join(words(rng.randint(1, 120))) for _ in range(40)]
    passage = [" ".join(words(60))[:n] for n in (190, 199, 200, 201, 230, 300)]
    for p in passage:
        for _ in range(5):
            i = rng.randrange(40)
            at = rng.randrange(len(base[i]) + 1)
            base[i] = base[i][:at] + p + base[i][at:]
    return base + base[:4] + [base[5] * 3, "z" * 700, "z" * 210, "ab" * 300, base[6][:150], "", None, "é" * 400]


def test_suffix_dedup(spark, docs, words, monkeypatch):
    texts = mixture(words, random.Random(1))
    want = removed_plain(texts)
    for rows in (40_000, 12):                   # 12: many buckets, so that k-grams go on in the next
        monkeypatch.setattr(suffixes, "BUCKET_ROWS", rows)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
               for r in suffixes.dedup_substrings(docs(texts)).collect()}
        assert got == dict(enumerate(want))


def test_suffix_dedup_of_nothing_and_of_repeated_rows(docs, words):
    text = " ".join(words(100))
    assert suffixes.dedup_substrings(docs(["x"]).limit(0)).count() == 0
    got = suffixes.dedup_substrings(docs([(1, text), (1, text), (None, "own " * 30), (None, None)]), digest_only=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got)[-2:] == [(1, len(text))] * 2
    assert {r.kept_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}


def test_long_texts_come_in_parts(monkeypatch, words):
    monkeypatch.setattr(suffixes, "BLOCK", 3000)
    texts = [" ".join(words(n)).encode() for n in (2000, 3, 500)] + [b"", b"q" * 2500]
    rolling = Rolling()
    starts = {i: set() for i in range(len(texts))}
    for raw, stops, rows, firsts in suffixes.blocks_of(texts):
        assert len(raw) <= 3000 + 2 * 200
        x = suffixes.anchors(raw, stops, rolling)
        begin = np.concatenate([[0], stops[:-1]])
        for low, high in zip(x["low"], x["high"]):
            part = int(np.searchsorted(stops, low, "right"))
            for p in range(low, high + 1):
                at = p - begin[part] + firsts[part]
                assert at not in starts[rows[part]]
                starts[rows[part]].add(at)
    assert starts == {i: set(range(max(0, len(t) - 199))) for i, t in enumerate(texts)}


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (5000, 6)).astype(np.uint64)
    assert (words[suffixes.multikey_order(words)] == words[np.lexsort(words.T[::-1])]).all()


# ---------------------------------------------------------------- shingles
def near_copies(words, rng, n, edits):
    base = words(n)
    out = []
    for _ in range(edits):
        w = list(base)
        for _ in range(rng.randint(0, max(1, n // 40))):
            w[rng.randrange(n)] = "new" + str(rng.random())[2:6]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot,spreads", [(64, 4.0), (3, 4.0), (64, 0.0)])     # the last judges many sets on few hashes
def test_similar_components(docs, words, odd, monkeypatch, hot, spreads):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", 16 if hot == 3 else 512)
    if not spreads:
        monkeypatch.setattr(jaccard, "_level_table", lambda spark, most: spark.createDataFrame(
            [(0, 0, 80, 1 << 62), *[(k, 64 << k - 1, 80 << k, int(0.2 * jaccard.TOP)) for k in range(1, 8)]],
            "k int, over long, upto long, bound long"))
    rng = random.Random(3)
    line = " ".join(words(12))
    texts = [*odd, *near_copies(words, rng, 150, 40), *near_copies(words, rng, 40, 10), *near_copies(words, rng, 700, 6),
             *[line + " " + " ".join(words(rng.randint(3, 60))) for _ in range(30)],
             *[" ".join(words(rng.randint(1, 90))) for _ in range(20)], "Same Words", "same words", "same  WORDS "]
    texts += texts[20:24]
    sets = {i: shingles_plain(t) for i, t in enumerate(texts)}
    label = components_plain(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs(texts)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}


def test_similar_components_of_nothing_and_of_repeated_rows(docs):
    assert jaccard.similar_components(docs(["x"]).limit(0)).count() == 0
    got = sorted(tuple(r) for r in jaccard.similar_components(docs(
        [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f"), (7, None)])).collect())
    assert got == [(5, 2, 5), (5, 2, 5), (7, 0, 7), (9, 2, 5)]
    blank = jaccard.similar_components(docs([(None, "a b c d e f"), (9, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in blank if r.component_id) == [(0, 9), (9, 9)]
    kept = jaccard.keep_first(docs([(1, "p q r s t u"), (2, "p q r s t u"), (3, ""), (4, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_size_classes():
    for n in range(1, 3000):
        for m in (n, -(-n * 4 // 5)):
            assert set(jaccard.levels_of(n)) & set(jaccard.levels_of(m))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {}
    for a, b in links:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        label = {k: min(x, y) if c in (x, y) else c for k, c in label.items()}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: c for k, c in label.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_links():
    ids = np.array([1, 2, 3, 4, 5])
    linked = np.zeros((5, 5), bool)
    for a, b in ((0, 2), (1, 3), (2, 3)):
        linked[a, b] = linked[b, a] = True
    assert set(zip(*(x.tolist() for x in local_links(linked, ids, ids)))) == {(1, 1), (2, 1), (3, 1), (4, 1)}


# ---------------------------------------------------------------- lines
def test_line_dedup(docs, odd):
    rng = random.Random(2)
    texts = [*[t for t in odd if t is not None], *["\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12))) for _ in range(60)]]
    texts += texts[-3:]
    want = lines_plain(list(enumerate(texts)))
    rows = dedup_lines(docs(texts)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == want
    assert all(r.id == "x" and r.n_lines == len(texts[r.doc_id].split("\n")) for r in rows)


def test_line_dedup_edges(docs):
    assert dedup_lines(docs(["x"]).limit(0)).count() == 0
    rows = dedup_lines(docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None), (None, "q\nr\ns"), (4, "q\nr\ns")])).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_lines, r.n_removed, r.n_spans) for r in rows) == [
        (0, "q\nr\ns", 3, 0, 0), (1, "a\nb\nc", 3, 0, 0), (1, "a\nb\nc", 3, 0, 0), (2, "d", 4, 3, 1),
        (3, "", 0, 0, 0), (4, "", 3, 3, 1)]


def test_line_dedup_is_native(docs):
    assert "Python" not in dedup_lines(docs(["a"]))._jdf.queryExecution().toString()


def test_one_row_of_each_component_stays(docs):
    kept = jaccard.keep_first(docs([
        *[(1, "p q r s t u")] * 30, (2, "p q r s t u"), (None, "p q r s t u"), (None, "P q r s t u"),
        (None, "one two three four five six"), (None, "one two three four five six"), (3, "alone a b c d e"),
        *[(4, "d e f g h i")] * 3, (None, None), (None, ""), (5, ""), (5, ""), (6, "")]))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, ""), (0, ""), (0, "one two three four five six"), (1, "p q r s t u"), (3, "alone a b c d e"),
        (4, "d e f g h i"), (5, ""), (6, "")]
    assert kept.columns == docs(["a"]).columns
    many = " ".join(f"w{i}" for i in range(60))                   # near, not equal
    kept = jaccard.keep_first(docs([(None, many + " end"), (8, many), (None, many + " other"), (7, "x y z")]))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8]


@pytest.mark.parametrize("copies", [0, 1, 2])
def test_passage_shared_with_a_row_without_id(docs, words, copies):
    shared = [" ".join(words(90)) for _ in range(3)]
    texts = [" ".join([*words(60), p, *words(60)]) for p in shared for _ in range(2)]
    ids = [None, 1, None, 3, None, None]
    rows = [*zip(ids, texts), *[(None, t) for i, t in zip(ids, texts) if i is None] * copies, (9, texts[1])]
    want = removed_plain([t for _, t in rows])
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.dedup_substrings(docs(rows)).collect() if r.doc_id is not None}
    assert set(got) == {1, 3, 9}
    assert all(tuple(got[i][:3]) + (bytes(got[i][3]),) == w for (i, _), w in zip(rows, want) if i is not None)
    assert 0 < got[3][1] < got[3][0]

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainscope.llm.batches import offsets_of
from grainscope.llm.bytebpe import byte_bpe, encode_texts
from grainscope.llm.packing import differencing, fit, pack
from grainscope.llm.tokenfiles import read_token_files, write_token_files
from grainscope.llm.wordtokens import word_tokens
from grainscope.session import shared_dir

WORDS, BYTES = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(WORDS)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
PUBLIC = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!aAbBsStT1éßİ́\x1c\x85"), st.characters(codec="utf-8")), max_size=60)


def expected(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def ids_of(encoder, texts):
    ids, n = encoder.encode(texts)
    cuts = offsets_of(n)
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_library_ids(odd):
    assert ids_of(word_tokens(WORDS), odd) == [expected(t)[:-1] for t in odd]
    assert ids_of(byte_bpe(BYTES, public.PATTERN), odd) == [PUBLIC.encode_ordinary(t or "") for t in odd]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_library_ids_of_any_text(texts):
    assert ids_of(word_tokens(WORDS), texts) == [expected(t)[:-1] for t in texts]
    bpe = byte_bpe(BYTES, public.PATTERN)
    assert ids_of(bpe, texts) == [PUBLIC.encode_ordinary(t) for t in texts]
    assert bpe.decode(bpe.encode(texts)[0]).tobytes() == "".join(texts).encode()


def test_matrix_and_heap_merge_alike(words):
    bpe = byte_bpe(BYTES, public.PATTERN)
    pieces = [w.encode() for w in words(200)] + [b"q" * 40, b"zxqj" * 11]
    pieces = [p for p in set(pieces) if p not in bpe.ranks]
    flat, n = bpe.encode_pieces(pieces)
    cuts = offsets_of(n)
    assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [bpe.merge_long(p).tolist() for p in pieces]


def test_memory_does_not_change_ids(words):
    small = type(word_tokens(WORDS))(WORDS, max_words=3)
    texts = [" ".join(words(20)) for _ in range(10)]
    assert [ids_of(small, [t])[0] for t in texts] == [expected(t)[:-1] for t in texts]


def test_parts_of_words_are_encoded_once(monkeypatch):
    """Case and the symbols that end a word make no new work; special tokens and apostrophes stay whole."""
    encoder, asked = type(word_tokens(WORDS))(WORDS), []
    encode_words = encoder.encode_words
    monkeypatch.setattr(encoder, "encode_words", lambda words: asked.extend(words) or encode_words(words))
    texts = ["Haus haus, HAUS!! haus&&& haus.*** &&&", "it's. it'. don't!! x<|endoftext|> <|endoftext|>, \u00c9\u00aa\u00b5\u00df,",
             *[f"{chr(i)}a b{chr(i)} c{chr(i)}, {chr(i)}" for i in range(0x180)], "haus  haus'"]
    assert ids_of(encoder, texts) == [expected(t)[:-1] for t in texts]
    assert len(asked) == len(set(asked)) and [w for w in asked if w[:4].lower() == "haus"] == ["haus"]


def test_byte_bpe_table(docs, odd):
    rows = encode_texts(docs([*odd, "again", (3, "again")]), BYTES, public.PATTERN).collect()
    assert len(rows) == len(odd) + 2
    texts = [*odd, "again"]
    for r in rows:
        text = "again" if r.doc_id == 3 and bytes(r.decoded) == b"again" else texts[r.doc_id] or ""
        assert r.ids == PUBLIC.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids)
    digest = encode_texts(docs(["a b"]), BYTES, public.PATTERN, digest_only=True).first()
    assert digest.ids_sha256 == hashlib.sha256(np.array(PUBLIC.encode_ordinary("a b"), "<u4")).hexdigest()
    assert encode_texts(docs(["x"]).limit(0), BYTES, public.PATTERN).count() == 0


def test_token_files_round_trip(spark, docs, odd):
    rows = [*odd, (None, "no id"), (4, "second of four"), (10 ** 12, "far")]
    files = write_token_files(docs(rows), shared_dir(spark), WORDS)
    got = sorted(read_token_files(files).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    at = 0
    want = sorted(expected(t[1] if isinstance(t, tuple) else t) for t in rows)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at += r.n_tokens
    assert sorted(r.ids for r in got) == want
    again = write_token_files(docs(rows), shared_dir(spark), WORDS)
    assert [r.ids for r in sorted(read_token_files(again).collect(), key=lambda r: r.start)] == [r.ids for r in got]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_arrow_columns_as_they_are(odd, kind):
    """Tasks hand over slices of Arrow columns, NULLs and empty slices too, without making Python strings of texts."""
    column = pa.array(["left out", *odd, "left out"], kind).slice(1, len(odd))
    ids, n = word_tokens(WORDS).documents(column)
    assert ids.dtype == np.uint32 and ids.tolist() == [x for t in odd for x in expected(t)]
    assert n.tolist() == [len(expected(t)) for t in odd]
    ids, n = word_tokens(WORDS).documents(column.slice(0, 0))
    assert len(ids) == len(n) == 0


def test_token_files_of_nothing(spark, docs):
    files = write_token_files(docs(["x"]).limit(0), shared_dir(spark), WORDS)
    assert read_token_files(files).count() == 0


def check_pieces(rows, wanted, capacity):
    """Every id in exactly one piece; sequences gapless and not over capacity. ``wanted``: ids by document."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
    assert set(by_doc) == set(wanted)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == wanted[key]
        assert [r.start for r in pieces] == offsets_of(np.array([r.length for r in pieces]))[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(wanted[key])}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == offsets_of(np.array([r.length for r in pieces]))[:-1].tolist()
        assert sum(r.length for r in pieces) <= capacity


@pytest.mark.parametrize("capacity,group", [(4096, 256), (64, 8), (50, 1)])
def test_packing(docs, odd, words, capacity, group):
    texts = [*odd, *[" ".join(words(n)) for n in range(1, 120)]]
    rows = pack(docs(texts), WORDS, capacity, group=group).collect()
    check_pieces(rows, {i: expected(t) for i, t in enumerate(texts)}, capacity)
    assert pack(docs(["x"]).limit(0), WORDS).count() == 0


def test_packing_wastes_little(spark, sf_dir):
    rows = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1), WORDS, with_ids=False).collect()
    assert sum(r.length for r in rows) / (4096 * len({r.sequence_id for r in rows})) > 0.95


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 9))
def test_differencing_balances(lengths, windows):
    lengths = np.array(lengths)
    of = differencing(lengths, windows)
    sums = np.bincount(of, lengths, windows)
    assert len(of) == len(lengths) and 0 <= of.min() and of.max() < windows
    assert sums.max() - sums.min() <= lengths.max()
    check_fit(lengths, 128)
    check_fit(lengths, 7)


def check_fit(lengths, capacity):
    piece, begin, length, window = fit(lengths, capacity)
    assert np.bincount(window, length).max() <= capacity and length.min() > 0 and (np.diff(window) >= 0).all()
    for i, n in enumerate(lengths):
        order = np.argsort(begin[piece == i])
        ends = np.cumsum(length[piece == i][order])
        assert ends[-1] == n and begin[piece == i][order].tolist() == [0, *ends[:-1]]


@pytest.mark.parametrize("mean", [30, 200, 450, 1200, 3000])
def test_two_runs_at_most(monkeypatch, mean):
    """Full groups: at most two runs of differencing, and little padding."""
    from grainscope.llm import packing

    runs = []
    monkeypatch.setattr(packing, "differencing", lambda lengths, windows: runs.append(windows) or differencing(lengths, windows))
    room, lengths = int(256 * 4096 * (1 - packing.SLACK)), []
    rng = np.random.default_rng(mean)
    while sum(lengths) < room:
        lengths.append(int(min(4095, 1 + rng.exponential(mean), room - sum(lengths))))
    lengths = np.array(lengths)
    check_fit(lengths, 4096)
    assert len(runs) <= 2
    assert room / (4096 * len(np.unique(fit(lengths, 4096)[3]))) > 0.985


def test_opposing_imbalances_meet():
    assert sorted(np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    assert np.ptp(np.bincount(differencing(np.array([5, 5, 4, 4, 3, 3]), 3), [5, 5, 4, 4, 3, 3])) == 0

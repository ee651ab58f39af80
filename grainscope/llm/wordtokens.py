"""Token ids by a word-level byte-pair vocabulary of the tokenizers library."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from grainscope.llm.batches import gather_runs, offsets_of
from grainscope.llm.wordcache import WordCache

END_OF_DOCUMENT = 2   # fixed value: the id that closes each document
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha())
SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7f)) if not c.isalnum())
JOINED = 100          # words encoded in one call


def strings(column: pa.Array) -> list[str]:
    """The values of a column of texts without blanks, by one conversion."""
    if not len(column):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.string()))
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


class WordTokens(WordCache):
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    For vocabularies whose pre-tokenizer drops white space, parts letters from symbols and ends every piece with a
    ``</w>`` token: no token crosses a blank, so texts are cut at blanks and line feeds, and Latin-1 letters are cut from
    the ASCII symbols that end a word. Arrow finds the distinct words of a call and their two parts; parts are remembered.
    Lower-case letters are encoded many words at a time with the same model behind a shorter pre-tokenizer, and told
    apart by their end tokens.
    """

    def __init__(self, path: str, max_words: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(max_words)
        self.tokenizer = Tokenizer.from_file(path)
        self.short = Tokenizer(self.tokenizer.model)
        self.short.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts: letters in one piece each by the shorter way, all others alone."""
        plain = np.fromiter((w.isalpha() and max(w) < "\u0100" for w in words), bool, len(words))
        letters = [w for w, p in zip(words, plain.tolist()) if p]
        others = [w for w, p in zip(words, plain.tolist()) if not p]
        groups = [letters[i:i + JOINED] for i in range(0, len(letters), JOINED)]
        of_groups = [e.ids for e in self.short.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)]
        of_others = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        sizes = np.fromiter(map(len, of_groups), np.int64, len(of_groups))
        flat = np.fromiter(chain(chain.from_iterable(of_groups), chain.from_iterable(of_others)), np.int32)
        ends = np.flatnonzero(self.closes[flat[:sizes.sum()]]) + 1
        last = np.cumsum([len(g) for g in groups], dtype=np.int64) - 1
        if len(ends) != len(letters) or (ends[last] != np.cumsum(sizes)).any():
            raise ValueError("a word that is not one piece")
        lengths = np.empty(len(words), np.int64)
        lengths[plain] = np.diff(ends, prepend=0)
        lengths[~plain] = np.fromiter(map(len, of_others), np.int64, len(of_others))
        starts = np.empty(len(words), np.int64)
        starts[plain] = ends - lengths[plain]
        starts[~plain] = sizes.sum() + offsets_of(lengths[~plain])[:-1]
        return flat[gather_runs(starts, lengths)], lengths

    def of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word of a column, whose words are best distinct."""
        stem = pc.ascii_rtrim(words, SYMBOLS)
        plain = pc.match_substring_regex(stem, f"\\A[{LETTERS}]+\\z")
        first = pc.if_else(plain, pc.utf8_lower(stem), "").dictionary_encode()
        rest = pc.if_else(plain, pc.utf8_ltrim(words, LETTERS), words).dictionary_encode()
        parts = strings(first.dictionary) + strings(rest.dictionary)
        rows = self.rows_of(parts)
        of = np.stack([rows[first.indices.to_numpy()], rows[rest.indices.to_numpy() + len(first.dictionary)]], axis=1)
        lengths = self.lengths[of]
        return self.flat[gather_runs(self.starts[of].ravel(), lengths.ravel())], lengths.sum(axis=1)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text (NULL: none)."""
        if len(self.rows) > self.max_words:
            self.clear()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        flat, lengths = self.of_distinct(words.dictionary)
        of = words.indices.to_numpy()
        n = lengths[of]
        sums = offsets_of(n)
        cuts = sums[offsets_of(parts.value_lengths().to_numpy())]
        return flat[gather_runs(offsets_of(lengths)[of], n)], np.diff(cuts)

    def documents(self, texts: pa.Array | list[str | None],
                  end: int = END_OF_DOCUMENT) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with ``end`` after each text, and the number of ids of each text with it."""
        ids, lengths = self.encode(texts)
        return np.insert(ids, np.cumsum(lengths), end).astype(np.uint32), lengths + 1


@lru_cache(maxsize=1)
def word_tokens(path: str, max_words: int = 700_000) -> WordTokens:
    """One encoder per Python worker, kept between tasks."""
    return WordTokens(path, max_words)

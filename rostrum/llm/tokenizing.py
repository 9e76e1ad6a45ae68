"""Token ids of whole texts by a BPE that never merges across white space."""

from __future__ import annotations

import functools
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Kept per Python worker, over its tasks and beside whatever it runs next; then the table
# starts anew.
KNOWN_WORDS = 1_000_000


# A word of plain letters, with a mark after it or not: its ids are those of its
# letters in lower case, and those of the mark.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
# Byte-level vocabularies write bytes that print as nothing as characters from 256 on.
_BYTES = {b: chr(256 + i) for i, b in enumerate(
    b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_MARKS = {"": 0, ".": 1, ",": 2}


class WordTokens:
    """Encodes each different word once.

    Holds for tokenizers that lower-case, and whose pre-tokenization can't make a
    piece that spans a space or a line feed, which are the only places where texts
    are cut here, and parts letters from marks.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS) -> None:
        self.known_words = known_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}  # word -> 3 * place of its letters + mark
        self.place: dict[str, int] = {}
        self.first = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.used = 0
        self._encode([], list(_MARKS))

    def _encode(self, letters: list[str], others: list[str]) -> None:
        """What is Latin letters in lower case is one piece as it stands, and goes to the
        model at once, its bytes as characters; the rest takes all steps before it."""
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(w if w.isascii() else
                                         w.encode().decode("latin-1").translate(_BYTES))]
                 for w in letters]
        found += [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        at, n = len(self.place), len(found)
        while at + n > len(self.first):
            self.first, self.length = (np.resize(x, 2 * len(x)) for x in (self.first, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.first[at:at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at:at + n] = lengths
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.place.update(zip(chain(letters, others), range(at, at + n)))

    def _learn(self, words: list[str]) -> list[int]:
        """The codes of new words."""
        place, cores, marks = self.place, [], []
        letters, others = {}, {}  # in the order met
        for w in words:
            if m := _PLAIN.fullmatch(w):
                core, mark = m[1].lower(), _MARKS[m[2]]
            else:
                core, mark = w, 0
            if core not in place:
                (letters if m else others)[core] = None
            cores.append(core)
            marks.append(mark)
        if letters or others:
            self._encode(list(letters), list(others))
        found = [3 * place[core] + mark for core, mark in zip(cores, marks)]
        self.codes.update(zip(words, found))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, ids per text)``; a null text is empty."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        lists = pc.split_pattern(spaced, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        encoded = lists.flatten().dictionary_encode()
        words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.codes) + len(words) > self.known_words:
            self.forget()
        code = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            code[new] = self._learn([words[k] for k in new])
        code = code[encoded.indices.to_numpy(zero_copy_only=False)]
        at = np.column_stack([code // 3, code % 3]).ravel()  # letters, mark, letters, mark
        lengths = self.length[at]
        ends = np.cumsum(lengths, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.first[at] - ends + lengths, lengths)
        place += np.arange(total, dtype=np.int32)
        flat = self.ids[place]
        owner = np.repeat(np.arange(len(counts)), counts)
        per_word = lengths[0::2] + lengths[1::2]
        return flat, np.bincount(owner, per_word, len(counts)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def word_tokens(path: str, known_words: int = KNOWN_WORDS) -> WordTokens:
    """One table per Python worker, kept over its tasks."""
    return WordTokens(path, known_words)

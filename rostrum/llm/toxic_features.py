"""Dense features of texts for toxicity, in numpy; imported by Python workers, so it
stays free of Spark ML."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rostrum.llm.common import by_bytes

STEM = 5
NEAR = 6  # words within which a second person counts as near a lexicon hit
KNOWN_WORDS = 100_000  # kept per task; then the table starts anew
TEXT_BYTES = 4 << 20  # of texts looked at together
FEATURES = [
    "hits", "hit_density", "weight_sum", "weight_top", "weight_density", "stem_hits",
    "second_person", "second_near_hit", "capital_words", "capital_letters", "exclamation",
    "question", "punctuation", "repeated_marks", "obfuscated", "obfuscated_hits", "log_words",
]
# Second-person words of the languages met.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vos os su"
).split()
# Characters that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
              "!": "i", "|": "l"}


def features(entries: dict[str, float]):
    """A function of an array of texts that gives their ``FEATURES``, a row a text; a word
    is looked at once per task, as long as no more than ``KNOWN_WORDS`` are met, however
    often it occurs. A null text is an empty one."""
    second = set(SECOND_PERSON)
    table = str.maketrans(LOOKALIKES)

    def describe(word: str) -> tuple:
        bare = word.strip("\"'.,;:!?()[]{}<>*_-~#/\\…¡¿«»„“”‘’")
        low = bare.lower()
        weight = entries.get(low, 0.0)
        stem = entries.get("^" + low[:STEM], 0.0) if len(low) > STEM else 0.0
        letters = sum(c.isalpha() for c in bare)
        odd = 0 < letters < len(bare) and any(
            not c.isalpha() and c not in "'’-" and not (c.isdigit() and bare.isdigit())
            for c in bare)
        plain = 0.0
        if odd or "*" in word or "." in bare or "-" in bare:
            undone = "".join(c for c in low.translate(table) if c.isalpha())
            if undone != low:
                plain = max(entries.get(undone, 0.0), entries.get("^" + undone[:STEM], 0.0)
                            if len(undone) > STEM else 0.0)
        return (weight, stem, low in second, letters > 1 and bare.isupper(), odd, plain,
                sum(c.isupper() for c in word), letters, word.count("!"), word.count("?"),
                sum(not c.isalnum() for c in word),
                "!!" in word or "??" in word or "!?" in word)

    place: dict[str, int] = {}
    known = np.zeros((1 << 12, 12))

    def about(words: list[str]) -> np.ndarray:
        nonlocal known
        if len(place) + len(words) > KNOWN_WORDS:
            place.clear()
        new = [w for w in words if w not in place]
        at = len(place)
        place.update(zip(new, range(at, at + len(new))))
        if len(place) > len(known):
            known = np.concatenate([known, np.zeros((max(len(known), len(new)), 12))])
        if new:
            known[at:at + len(new)] = [describe(w) for w in new]
        return known[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def run(texts: pa.Array) -> np.ndarray:
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        encoded = lists.flatten().dictionary_encode()
        words = encoded.dictionary.to_pylist()
        index = encoded.indices.to_numpy(zero_copy_only=False)
        return _dense(about(words), index, counts, np.array([w != "" for w in words], float))
    return run


def keyed_features(entries: dict[str, float]):
    """For ``mapInArrow``: the columns beside ``text`` as they are, and ``features`` in its
    place. Texts are taken by their bytes, so long ones don't meet in one table."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = features(entries)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            for part in by_bytes(batch, "text", TEXT_BYTES):
                rows = run(part.column("text"))
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names),
                     pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))],
                    names=[*names, "features"])
    return task


def _dense(table: np.ndarray, index: np.ndarray, counts: np.ndarray,
           real: np.ndarray) -> np.ndarray:
    number = len(counts)
    owner = np.repeat(np.arange(number), counts)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values[index], number) if len(index) else np.zeros(number)

    weight = np.maximum(table[:, 0], table[:, 5])
    both = np.maximum(weight, table[:, 1])
    words = np.maximum(total(real), 1)
    letters = np.maximum(total(table[:, 7]), 1)
    top = np.zeros(number)
    if len(index):
        np.maximum.at(top, owner, both[index])
    at = np.flatnonzero(both[index] > 0)
    near = np.zeros(number)
    you = np.flatnonzero(table[index, 2] > 0)
    if len(at) and len(you):  # the distance of each hit to the second person next to it
        after = np.searchsorted(you, at)
        for side in (np.minimum(after, len(you) - 1), np.maximum(after - 1, 0)):
            close = (owner[you[side]] == owner[at]) & (np.abs(you[side] - at) <= NEAR)
            gain = np.where(close, 1 / (1 + np.abs(you[side] - at)), 0)
            np.maximum.at(near, owner[at], gain)
    hits, sums = total((weight > 0) * 1.0), total(both)
    return np.column_stack([
        hits, hits / words, sums, top, sums / words, total((table[:, 1] > 0) * 1.0),
        total(table[:, 2]) / words, near, total(table[:, 3]) / words,
        total(table[:, 6]) / letters, total(table[:, 8]) / words, total(table[:, 9]) / words,
        total(table[:, 10]) / words, total(table[:, 11]), total(table[:, 4]) / words,
        total((table[:, 5] > 0) * 1.0), np.log1p(total(real))])

"""Token counts of whole texts, huge ones by overlapping chunks.

Texts up to ``LONG`` bytes are encoded as they are. Longer ones are encoded in
chunks that overlap, with the place of every token. Two neighbours are spliced
at a place in their overlap where both begin a token and that is proven stable: a
space after something else than a space, which no piece of the vocabulary spans,
so no merge can cross it and neither side can change the other. If an overlap has
no such place it is doubled, in the end up to the whole rest. The count is that of
the whole text, and memory is that of a chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rostrum.llm.common import id_and_text

LIMIT = 4096
LONG = 60_000
CHUNK = 40_000
OVERLAP = 512
_SPACE = "▁"  # how the library writes a space


class Counter:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Whether no piece has a space after another character.
        self.parts_at_spaces = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def counts(self, texts: list[str], long: int = LONG) -> list[int]:
        short = [t if len(t) <= long else "" for t in texts]
        found = [len(ids) for ids in self.model.encode(short, num_threads=1, return_type="numpy")]
        return [n if len(t) <= long else self.spliced(t) for t, n in zip(texts, found)]

    def _begins(self, data: bytes, start: int, stop: int) -> np.ndarray:
        """Where each token of ``data[start:stop]`` begins, in the whole text."""
        part = data[start:stop].decode()
        proto = self.model.encode(part, return_type="proto")
        return start + np.array([p.begin for p in proto.pieces], np.int64)

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of ``text``, from overlapping chunks (sizes in bytes)."""
        if not self.parts_at_spaces:  # no place can be proven stable
            return len(self.model.encode(text))
        data = text.encode()

        def snap(at: int) -> int:  # back to where a character begins
            while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return at

        size, total, counted = len(data), 0, 0
        stop = snap(min(size, chunk))
        begins = self._begins(data, 0, stop)
        while stop < size:
            wide, common = overlap, []
            while not common:
                start = snap(stop - wide)
                if start <= counted:  # nothing in this chunk: a longer one instead
                    stop = snap(min(size, counted + 2 * max(wide, stop - counted)))
                    # After the stable space: the library puts one before the text itself.
                    begins = self._begins(data, counted + (counted > 0), stop)
                    wide = overlap
                    if stop == size:
                        break
                    continue
                ahead = snap(min(size, start + chunk + wide))
                following = self._begins(data, start, ahead)
                both = np.intersect1d(begins, following)
                both = both[(both > max(start, counted)) & (both < stop)]
                common = [p for p in both.tolist() if data[p] == 32 and data[p - 1] != 32]
                wide *= 2
            if not common:
                break
            at = common[len(common) // 2]
            total += int(((begins >= counted) & (begins < at)).sum())
            counted, begins, stop = at, following, ahead
        return total + int((begins >= counted).sum())


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def _count(path: str, limit: int):
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = pc.fill_null(batch.column("text"), "")
                tokens = np.array(model.counts(texts.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()),
                     pa.array(tokens), pa.array(tokens > limit)], names=names)
    return run


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``model`` is the path of a sentencepiece model that all executors have. A null
    text is empty and has no tokens. Rows repeated whole are counted each; a null
    ``doc_id`` stays null. Other columns are ignored.
    """
    return id_and_text(docs, doc_id, text).mapInArrow(
        _count(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

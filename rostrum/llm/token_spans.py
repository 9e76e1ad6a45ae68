"""Alignment of two tokenizers' tokens over the same texts.

A is a byte-level BPE (tokenizers), B a sentencepiece BPE with byte fallback. Both encode
a space and the text (B puts the space there itself). The decoded bytes of the tokens tell
where each ends, and they must be the bytes of the text. So only ids are asked for, no
offsets of A and no protos of B. Where both end at once, a group ends.

Texts are looked at in units that neither tokenizer can join, so each different unit is
aligned once per task: a unit begins at a space after a character that isn't white space,
or around line feeds between two such characters. No piece of B spans these places (its
vocabulary is looked through), nor does a match of A's splitting pattern. A unit of letters
is one such match, and goes to A's model at once. Where that can't
be shown, for other tokenizers or other white space, units are larger, up to whole texts.

How often a pair of ids is linked in all texts is counted by Spark from pairs counted per
text, and meets the texts again by a join; the table of pairs is broadcast if it is small.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rostrum.llm.common import by_bytes, id_and_text, released
from rostrum.operators.lookup import lookup
from rostrum.session import stage

KNOWN_CHARACTERS = 2_500_000  # of units kept per Python worker; then the table starts anew
TEXT_BYTES = 1 << 19  # of texts looked at together
UNITS = 2_000  # new ones encoded together
PAIR_BYTES = 64 << 20  # up to which the table of pairs is broadcast
_SPACE = "▁"  # how B writes a space
_UNITS = re.compile(r"[ \n]*\n(?=[^ \n])|[ \n]*[^ \n]+(?:[ \n]+\Z)?")
_PLAIN = re.compile(r" ?[^\s]+")
# Blocks that are all letters in any version of Unicode since 6.0.
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ԣ一-龥가-힣ぁ-ゖァ-ヺ]+")
_AT_SPACES = re.compile(r"(?<=\S)(?= )")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    one = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(one[1], 16)]) if one else piece.replace(_SPACE, " ").encode()


class Aligner:
    """Aligned units, each looked at once as long as they are kept."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = byte_level_bytes()
        self.characters_of = {b: c for c, b in plain.items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(plain[c] for c in t) if all(c in plain for c in t) else t.encode()
                        for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p) for p in pieces]
        self.n_b = len(pieces)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64)
                                    for x in (self.bytes_a, self.bytes_b))
        # Ids as they stand after a comma, a bar, at the beginning, and after a semicolon.
        self.most = max(size, self.n_b)
        self.names = [m + str(i) for m in (",", "|", "", ";") for i in range(self.most)]
        self.parts = (
            not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
            and self._splits_at_spaces(json.loads(self.a.to_str())))
        self.letters = self.parts and all(
            t.special for t in self.a.get_added_tokens_decoder().values())
        self.forget()

    @staticmethod
    def _splits_at_spaces(settings: dict) -> bool:
        """Whether A splits by the byte-level pattern, and does nothing before it."""
        before = settings.get("pre_tokenizer") or {}
        return (before.get("type") == "ByteLevel" and before.get("use_regex") is True
                and not before.get("add_prefix_space") and not settings.get("normalizer"))

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.characters = 0
        self.texts: list[str] = []  # groups of a unit, in text
        self.numbers = np.zeros((1 << 12, 5), np.int32)  # of A, B, groups, links; whether it holds
        self.first = np.zeros(1 << 12, np.int64)
        self.pairs = np.zeros(1 << 14, np.int64)
        self.used = 0

    def units(self, text: str) -> list[str]:
        whole = " " + text
        if not self.parts or whole.isspace():
            return [whole]
        if _OTHER_SPACE.search(whole):
            found = _AT_SPACES.split(whole)
            if found[-1].isspace():  # what ends a text stays with what stands before it
                found[-2:] = ["".join(found[-2:])]
            return found
        return _UNITS.findall(whole)

    def learn(self, units: list[str]) -> None:
        """Align ``units`` that stand within texts, and keep them under their numbers."""
        letters, plain, others = [], [], []
        for u in units:
            (letters if self.letters and _LETTERS.fullmatch(u)
             else plain if _PLAIN.fullmatch(u) else others).append(u)
        for kind, encode in ((letters, self._letters), (plain, self._together),
                             (others, self._one_by_one)):
            for at in range(0, len(kind), UNITS):
                self._align(kind[at:at + UNITS], encode)
        self.codes.update(zip(chain(letters, plain, others),
                              range(len(self.texts) - len(units), len(self.texts))))

    def _letters(self, units: list[str]):
        """Ids and owners of both tokenizers' tokens. A takes each unit as one match of its
        pattern, its bytes as characters."""
        tokenize, names = self.model.tokenize, self.characters_of
        return _owned([[t.id for t in tokenize(u.encode().decode("latin-1").translate(names))]
                       for u in units]), self._lines_b(units)

    def _together(self, units: list[str]):
        """The same for other units without white space but a space before them, which A
        takes all in one text.

        A line feed stands between two units, which both tokenizers part from either side.
        """
        found = self.a.encode_batch_fast(["\n".join(units) + "\n"], add_special_tokens=False)
        feed = self.a.encode("\n", add_special_tokens=False).ids
        a = _split(found[0].ids, feed, len(units))
        if a is None:  # a line feed is no token of its own
            a = _owned([e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)])
        return a, self._lines_b(units)

    def _lines_b(self, units: list[str]):
        # What comes before the first line feed is the space that B puts there.
        feed = self.b.encode("\n")[1:]
        found = self.b.encode("\n" + "\n".join(units) + "\n")[2:]
        b = _split(found, feed, len(units))
        return self._alone_b(units) if b is None else b

    def _alone_b(self, units: list[str]):
        # B puts a space before: in place of the unit's own, or before a line feed that is cut off.
        spaced = [u.startswith(" ") for u in units]
        found = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced)], num_threads=1)
        return _owned([ids if s else ids[2:] for ids, s in zip(found, spaced)])

    def _one_by_one(self, units: list[str], whole: bool = False):
        """The same for units with more white space, each by itself. ``whole``: they are
        whole texts, nothing follows."""
        # White space that a letter follows is not split as at the end of a text.
        runs = [not whole and u.isspace() for u in units]
        found = self.a.encode_batch_fast([u + "a" if r else u for u, r in zip(units, runs)],
                                         add_special_tokens=False)
        return _owned([e.ids[:-1] if r else e.ids for e, r in zip(found, runs)]), self._alone_b(units)

    def _align(self, units: list[str], encode) -> None:
        joined, number = "".join(units), len(units)
        data = np.frombuffer(joined.encode(), np.uint8)
        width = np.fromiter(map(len, units) if joined.isascii() else (len(u.encode()) for u in units),
                            np.int64, number)
        low = np.concatenate([[0], np.cumsum(width)])  # where each unit begins in bytes
        (ids_a, owner_a), (ids_b, owner_b) = encode(units)
        n_a, n_b = (np.bincount(x, minlength=number) for x in (owner_a, owner_b))

        sides = ((owner_a, ids_a, self.size_a, self.bytes_a), (owner_b, ids_b, self.size_b, self.bytes_b))
        good = np.ones(number, bool)
        for owner, ids, size, _ in sides:
            good &= np.bincount(owner, size[ids], number).astype(np.int64) == width
        unit = np.repeat(np.arange(number), width)
        for owner, ids, _, table in sides:
            made = np.frombuffer(b"".join([table[i] for i in ids[good[owner]].tolist()]), np.uint8)
            mine = good[unit]
            good[unit[mine][made != data[mine]]] = False
        room = np.where(good, width, 0)
        moved = low[:-1] - np.cumsum(room) + room  # from the bytes of good units alone to all
        (ids_a, owner_a, ends_a), (ids_b, owner_b, ends_b) = (
            (ids[k], owner[k], np.cumsum(size[ids[k]]) + moved[owner[k]])
            for owner, ids, size, k in ((*side[:3], good[side[0]]) for side in sides))
        marks = np.zeros(len(data) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        cuts = np.flatnonzero(marks)  # each stretch between two cuts is one link
        links = ids_a[np.searchsorted(ends_a, cuts)] * self.n_b + ids_b[np.searchsorted(ends_b, cuts)]
        common = np.flatnonzero(marks == 3)
        n_links = np.diff(np.searchsorted(cuts, low, "right"))
        n_groups = np.diff(np.searchsorted(common, low, "right"))
        texts = self._texts(number, (ids_a, owner_a, np.searchsorted(common, ends_a)),
                            (ids_b, owner_b, np.searchsorted(common, ends_b)))

        base = len(self.texts)
        self.texts += texts
        while base + number > len(self.first):
            self.first, self.numbers = (np.concatenate([x, np.zeros_like(x)])
                                        for x in (self.first, self.numbers))
        while self.used + len(links) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.first[base:base + number] = self.used + np.cumsum(n_links) - n_links
        self.numbers[base:base + number] = np.column_stack(
            [np.where(good, n_a, 0), np.where(good, n_b, 0), n_groups, n_links, good])
        self.pairs[self.used:self.used + len(links)] = links
        self.used += len(links)
        self.characters += len(joined)

    def _texts(self, number: int, *sides) -> list[str]:
        """The groups of each unit in text, from ids, owners and group numbers of both sides."""
        ids, owner, group = (np.concatenate([side[k] for side in sides]) for k in range(3))
        is_b = np.repeat([False, True], [len(side[0]) for side in sides])
        by = np.lexsort((is_b, group))  # stable: ids of a side stay in order
        ids, owner, group, is_b = ids[by], owner[by], group[by], is_b[by]
        opens = np.ones(len(ids), bool)
        opens[1:] = (group[1:] != group[:-1]) | (is_b[1:] != is_b[:-1])
        mark = np.where(~opens, 0, np.where(is_b, 1, np.where(_firsts(owner), 2, 3)))
        names = self.names
        parts = [names[k] for k in (mark * self.most + ids).tolist()]
        ends = np.cumsum(np.bincount(owner, minlength=number)).tolist()
        return ["".join(parts[s:e]) for s, e in zip([0, *ends], ends)]

    def align(self, texts: list[str | None]):
        """``(numbers per text, digests, pair keys, their counts, pairs per text)``."""
        if self.characters > KNOWN_CHARACTERS:
            self.forget()
        units = [self.units(t) if t else [] for t in texts]
        # Texts of white space only, or that can't be parted, are looked at by themselves.
        whole = [i for i, u in enumerate(units) if len(u) == 1 and (u[0].isspace() or not self.parts)]
        alone = [units[i] for i in whole]
        for i in whole:
            units[i] = [" "]  # a place to be filled
        flat = list(chain.from_iterable(units))
        new = list(set(flat).difference(self.codes))
        if new:
            self.learn(new)
        count = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), count)
        code = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum(count)
        for i, u in zip(whole, alone):
            code[ends[i] - 1] = len(self.texts)
            self._align(u, functools.partial(self._one_by_one, whole=True))
        bad = np.zeros(len(units), bool)
        bad[owner[self.numbers[code, 4] == 0]] = True
        numbers = np.zeros((len(units), 4), np.int64)
        for k in range(4):
            numbers[:, k] = np.bincount(owner, self.numbers[code, k], len(units))
        numbers[bad] = 0
        said = list(map(self.texts.__getitem__, code.tolist()))
        digests = ["" if b or not n else hashlib.sha256(";".join(said[e - n:e]).encode()).hexdigest()
                   for e, n, b in zip(ends.tolist(), count.tolist(), bad.tolist())]
        kept = ~bad[owner]
        code, owner = code[kept], owner[kept]
        n = self.numbers[code, 3]
        place = np.repeat(self.first[code] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        span = len(self.bytes_a) * self.n_b
        keys, times = np.unique(np.repeat(owner, n) * span + self.pairs[place], return_counts=True)
        return numbers, digests, keys % span, times, np.bincount(keys // span, minlength=len(units))


def _owned(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of the list that each is of."""
    return (np.fromiter(chain.from_iterable(found), np.int64),
            np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found))))


def _split(ids: list[int], feed: list[int], number: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``_owned`` of ids of ``number`` units with a line feed after each; none if the id of
    the line feed does not stand for it alone."""
    flat = np.array(ids, np.int64)
    feeds = flat == feed[0] if len(feed) == 1 else np.zeros(len(flat), bool)
    if feeds.sum() != number:
        return None
    return flat[~feeds], np.cumsum(feeds)[~feeds]


def _firsts(owner: np.ndarray) -> np.ndarray:
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    return first


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept over its tasks."""
    return Aligner(path_a, path_b)


def _aligned(path_a: str, path_b: str):
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for whole in batches:
            for batch in by_bytes(whole, "text", TEXT_BYTES):
                numbers, digests, keys, times, per_row = tool.align(batch.column("text").to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"),
                     *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(keys)),
                     pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    names=names)
    return run


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
            text: str = "text", pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.

    A link is a token of A and one of B that share bytes. The count of a pair of ids is the
    number of links of all texts that hold it; ``n_best`` are the links whose count is the
    highest of their id of B, ties included, ``count_sum`` the sum of counts over links.
    Groups end where tokens of both end; the digest is that of ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or that a tokenizer doesn't give back byte for byte, have
    no tokens, zeros and an empty digest. A row repeated whole gives as many rows, and its
    links count as often. A null ``doc_id`` stays null; other columns are ignored; an empty
    table gives an empty one. Texts are whole whatever their length. The paths have to hold
    on all executors.
    """
    rows = id_and_text(docs, doc_id, text).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = stage(rows.mapInArrow(
        released(_aligned(path_a, path_b)),
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, pairs array<long>, times array<int>"), "aligned")
    linked = found.select("row", F.inline(F.arrays_zip(
        F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = stage(linked.groupBy("pair").agg(F.sum("times").alias("count")).withColumn(
        "b", F.col("pair") % vocabulary_size(path_b)), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    scores = counts.join(most, "b").select(
        "pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    sums = lookup(linked, scores, ["pair"], "row", "inner", broadcast_bytes=pair_bytes).groupBy(
        "row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                   F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")

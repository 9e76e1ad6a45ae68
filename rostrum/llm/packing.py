"""Packing token sequences by non-negative least squares.

Every document is tokenized once. Its full windows are sequences of their own; the
rest, shorter than a window, is what has to be packed. Combinations of up to three
lengths that fill a window exactly are enumerated, and non-negative least squares
finds how often each should be used for the histogram of lengths, swept until the
residual stops falling (``TOLERANCE``); rounded down,
they take whole rests. What is left over is laid out one after another and cut at
window borders; the last, incomplete window is cut into powers of two, which need
no padding. So nothing is padded at all.

The driver holds the histogram (one row per length below the window) and the
repeat counts. Which rest takes which place follows from its number among the
rests of its length: tasks count their own while they tokenize, and the counts of
the tasks before are added. No window over documents and no sort is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rostrum.llm.common import by_bytes, id_and_text, released
from rostrum.llm.tokenizing import KNOWN_WORDS, word_tokens
from rostrum.session import stage

WINDOW = 2048
END_ID = 1
TOLERANCE = 1e-3  # of the squared histogram; sweeps end when one gains less


def combinations(window: int, counts: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none), ascending, that add up to ``window``;
    ``counts[l]`` says whether a length occurs."""
    there = np.flatnonzero(counts[1:window]) + 1
    short = there[2 * there <= window]
    pairs = np.column_stack([np.zeros_like(short), short, window - short])
    a, b = np.meshgrid(there[3 * there <= window], there, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c)
    rows = np.concatenate([pairs, np.column_stack([a[ok], b[ok], c[ok]])])
    return rows[(counts[rows[:, 1]] > 0) & (counts[rows[:, 2]] > 0)]


def repeats(rows: np.ndarray, counts: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Repeat counts, by cyclic coordinate descent on ``|A x - counts|`` over
    ``x >= 0``, rounded down and held to what the histogram has.

    A sweep never makes ``|A x - counts|`` squared greater; sweeps end when one takes
    less than ``tolerance`` times ``|counts|`` squared off it, so there are at most
    ``1 / tolerance + 1``."""
    left = counts.astype(float).tolist()
    left[0] = 0.0
    order = np.arange(len(rows))
    fixed = int((rows[:, 0] == 0).sum())  # pairs first, then triples in a seeded order
    np.random.default_rng(3).shuffle(order[fixed:])
    x = [0.0] * len(rows)
    combos = rows.tolist()
    norm = [float(sum(k.count(v) ** 2 for v in set(k) if v)) for k in combos]
    start = before = sum(v * v for v in left)
    gain = start
    while gain and gain >= tolerance * start:
        for j in order.tolist():
            a, b, c = combos[j]
            step = ((left[a] if a else 0.0) + left[b] + left[c]) / norm[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                if a:
                    left[a] -= step
                left[b] -= step
                left[c] -= step
        after = sum(v * v for v in left)
        gain, before = before - after, after
    out = np.zeros(len(rows), np.int64)
    spare = counts.astype(np.int64).tolist()
    for j in sorted(range(len(rows)), key=lambda j: -x[j]):
        parts = [v for v in combos[j] if v]
        times = min([int(x[j] + 1e-9), *(spare[v] // parts.count(v) for v in set(parts))])
        if times > 0:
            out[j] = times
            for v in parts:
                spare[v] -= times
    return out


class Layout:
    """Where the n-th rest of a length goes."""

    def __init__(self, counts: np.ndarray, window: int) -> None:
        rows = combinations(window, counts)
        times = repeats(rows, counts) if len(rows) else np.zeros(0, np.int64)
        rows, times = rows[times > 0], times[times > 0]
        start = np.cumsum(times) - times  # first sequence of each combination
        length = rows.ravel()
        offset = (np.cumsum(rows, axis=1) - rows).ravel()
        first, number = np.repeat(start, 3), np.repeat(times, 3)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        self.length, self.offset = length[order], offset[order]
        self.first, number = first[order], number[order]
        self.window, self.combined = window, int(times.sum())
        # Places of one length, numbered from 0 over its combinations.
        ends = np.cumsum(number)
        self.of_length = np.searchsorted(self.length, np.arange(window + 1))
        before = np.concatenate([[0], ends])[self.of_length]
        self.begin = ends - number - before[self.length]
        self.used = np.diff(before)  # places of each length below the window
        spare = counts[:window] - self.used
        tokens = spare * np.arange(window)
        self.stream = np.cumsum(tokens) - tokens  # where a length begins in what is left over
        self.total = int(tokens.sum())
        # The last, incomplete window in powers of two.
        rest, cut = self.total % window, []
        while rest:
            cut.append(1 << rest.bit_length() - 1)
            rest -= cut[-1]
        whole = self.total - self.total % window
        self.borders = whole + np.cumsum([0, *cut])

    def pieces(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` of the pieces of a rest; sequences from 0."""
        if number < self.used[length]:
            lo, hi = self.of_length[length], self.of_length[length + 1]
            e = lo + int(np.searchsorted(self.begin[lo:hi], number, "right")) - 1
            return [(0, length, int(self.first[e] + number - self.begin[e]), int(self.offset[e]))]
        at = int(self.stream[length]) + (number - int(self.used[length])) * length
        end, out, start = at + length, [], 0
        while at < end:
            if at < self.borders[0]:
                k = at // self.window
                sequence, begin, stop = k, k * self.window, (k + 1) * self.window
            else:
                k = int(np.searchsorted(self.borders, at, "right")) - 1
                sequence = int(self.borders[0]) // self.window + k
                begin, stop = int(self.borders[k]), int(self.borders[k + 1])
            size = min(stop, end) - at
            out.append((start, size, self.combined + sequence, at - begin))
            start, at = start + size, at + size
        return out

    @property
    def sequences(self) -> int:
        return self.combined + int(self.borders[0]) // self.window + len(self.borders) - 1


_IDS = "doc_id long, ids binary, n long, rest int, task int, rest_no long, full_no long"
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")


def _tokenize(path: str, end_id: int, window: int, known_words: int):
    """Ids of each text (16 bits each if the vocabulary allows), and its numbers among
    this task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(path, known_words), TaskContext.get().partitionId()
        width = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        rests, full = np.zeros(window, np.int64), 0
        for whole in batches:
            for batch in by_bytes(whole, "text", 4 << 20):
                flat, counts = tokens.encode(batch.column("text"))
                ends = np.cumsum(counts)
                small = flat.astype(width)
                end = np.array([end_id], width).tobytes()
                ids = [small[e - n:e].tobytes() + end for e, n in zip(ends, counts)]
                number = counts + 1
                rest = (number % window).astype(np.int32)
                rest_no, full_no = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
                for i, (r, n) in enumerate(zip(rest.tolist(), number.tolist())):
                    rest_no[i], full_no[i] = rests[r], full
                    rests[r] += 1
                    full += n // window
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(number),
                     pa.array(rest), pa.array(np.full(len(rest), task, np.int32)),
                     pa.array(rest_no), pa.array(full_no)],
                    names=["doc_id", "ids", "n", "rest", "task", "rest_no", "full_no"])
    return run


def _cut(layout: Layout, full_total: int):
    window = layout.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in
                       ("doc_id", "n", "rest", "rest_no", "full_no")]
            for ids, doc, n, rest, rest_no, full_no in zip(batch.column("ids"), *columns):
                ids = ids.as_py()
                ids = memoryview(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes())
                places = [(k * window, window, full_no + k, 0) for k in range(n // window)]
                if rest:
                    places += [(n - rest + s, size, full_total + q, o)
                               for s, size, q, o in layout.pieces(rest, rest_no)]
                for s, size, q, o in places:
                    out.append((doc, s, size, zlib.crc32(ids[4 * s:4 * (s + size)]), n, q, o))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                       "offset"])
    return run


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
           window: int = WINDOW, end_id: int = END_ID,
           known_words: int = KNOWN_WORDS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    ``tokenizer`` is the path of a ``tokenizers`` file that all executors have. A
    null text is empty and is one token, ``end_id``; rows repeated whole are packed
    each; a null ``doc_id`` stays null. Sequences hold ``window`` tokens, but for the
    last few, which hold powers of two. An empty table gives no pieces. Other columns
    are ignored. ``known_words`` says how many words a Python worker remembers: fewer take
    less memory and more time, and change no result.
    """
    own = id_and_text(docs, doc_id, text)
    rows = stage(own.mapInArrow(released(_tokenize(tokenizer, end_id, window, known_words)), _IDS), "ids")
    # One row per task and length: how many rests and full windows a task has.
    per_task = stage(rows.groupBy("task", "rest").agg(
        F.count("*").alias("rests"),
        F.sum(F.floor(F.col("n") / window)).cast("bigint").alias("full")), "counts")
    counts = np.zeros(window, np.int64)
    full_total = 0
    for r in per_task.groupBy("rest").agg(
            F.sum("rests").alias("rests"), F.sum("full").alias("full")).collect():
        counts[r["rest"]] = r["rests"]
        full_total += r["full"]
    counts[0] = 0
    layout = Layout(counts, window)
    tasks = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = per_task.groupBy("task").agg(F.sum("full").alias("full")).select(
        "task", F.coalesce(F.sum("full").over(tasks), F.lit(0)).alias("full_before"))
    earlier = Window.partitionBy("rest").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    before = per_task.select("task", "rest", F.coalesce(
        F.sum("rests").over(earlier), F.lit(0)).alias("rest_before")).join(by_task, "task")
    return (
        rows.join(before, ["task", "rest"])
        .select("doc_id", "ids", "n", "rest",
                (F.col("rest_no") + F.col("rest_before")).alias("rest_no"),
                (F.col("full_no") + F.col("full_before")).alias("full_no"))
        .mapInArrow(released(_cut(layout, full_total)), _PIECES)
    )

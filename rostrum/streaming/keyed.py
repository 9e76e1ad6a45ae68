"""State kept per meeting: ends of meetings, timely slices, numbered transcripts.

Both jobs hold their state by key in Spark's state store (``transformWithStateInPandas``),
so a micro-batch touches the meetings it has rows of, and those whose timers are due,
however many meetings were ever seen. They need the RocksDB provider of
``session.SETTINGS``; ``keyed_state`` sets it for sessions built elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rostrum.functions.text import is_blank
from rostrum.session import SETTINGS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MEETING_ROWS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("what", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("stop_ts", T.TimestampType()),
])
_TIMES = ("ts", "created_at", "stop_ts")
# In the state times are microseconds of the epoch, whatever the session's zone.
_STATE_ROWS = T.StructType([
    T.StructField(f.name, T.LongType()) if f.name in _TIMES else f for f in MEETING_ROWS])
FRAGMENT_ROWS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("place", T.LongType()),
    T.StructField("chunk_no", T.LongType()), T.StructField("version", T.LongType()),
    T.StructField("text", T.StringType()),
])


def keyed_state(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers and several states per key need."""
    spark.conf.set(_PROVIDER, SETTINGS[_PROVIDER])
    return spark


def micros(seconds: float) -> int:
    return int(seconds * 1_000_000)


class Meeting(StatefulProcessor):
    """One meeting: its creation, its stops, and the slices that can't be decided yet.

    A slice is decided when the watermark has passed it: every stop before it has been
    read by then, so what is emitted never has to be taken back. A meeting is settled when
    the watermark has passed its end (first stop after the creation) by ``keep``; its row
    is emitted and all its state goes. A meeting without end is settled when nothing was
    heard of it for ``idle``; so are stops of a meeting that never starts, which emit
    nothing.
    """

    def __init__(self, grace: float, keep: float, idle: float) -> None:
        self.grace, self.keep, self.idle = micros(grace), micros(max(keep, grace)), micros(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "created long, last long, timer long")
        self.stops = handle.getValueState("stops", "at array<long>")
        self.pending = handle.getValueState("pending", "at array<long>, ids array<long>")

    def _read(self) -> tuple:
        about = self.about.get() or (None, None, None)
        stops, pending = self.stops.get(), self.pending.get()
        return (*about, list(stops[0]) if stops else [],
                list(zip(pending[0], pending[1])) if pending else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        created, last, timer, stops, pending = self._read()
        for part in rows:
            at = part["at"].to_numpy()
            kind, ids = part["kind"].to_numpy(), part["event_id"].to_numpy()
            opens = at[np.isin(kind, ("start", "slice"))]
            if len(opens):
                created = int(opens.min()) if created is None else min(created, int(opens.min()))
            stops = sorted({*stops, *at[kind == "stop"].tolist()})
            slices = kind == "slice"
            pending += zip(at[slices].tolist(), ids[slices].tolist())
            last = max(last if last is not None else int(at.max()), int(at.max()))
        if created is not None:  # of the stops after the creation only the first can count
            after = [s for s in stops if s > created][:1]
            stops = [s for s in stops if s <= created] + after
        yield from self._settle(key, created, last, timer, stops, pending, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, last, _, stops, pending = self._read()
        yield from self._settle(key, created, last, None, stops, pending, timerValues)

    def _settle(self, key, created, last, timer, stops, pending, timerValues):
        """Emit what the watermark has decided, and wait for what it hasn't."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        end = next((s for s in stops if created is not None and s > created), None)
        ready = sorted(p for p in pending if p[0] <= passed)
        pending = [p for p in pending if p[0] > passed]
        timely = [p for p in ready if end is None or p[0] <= end + self.grace]
        if timely:
            yield pd.DataFrame({
                "job_id": key[0], "what": "slice", "event_id": [i for _, i in timely],
                "ts": [t for t, _ in timely], "created_at": pd.array([None] * len(timely), "Int64"),
                "stop_ts": pd.array([None] * len(timely), "Int64")})
        due = end + self.keep if end is not None else last + self.idle
        if due <= passed and not pending:
            if created is not None:
                yield pd.DataFrame({
                    "job_id": [key[0]], "what": "meeting", "event_id": pd.array([None], "Int64"),
                    "ts": pd.array([None], "Int64"), "created_at": [created],
                    "stop_ts": pd.array([end], "Int64")})
            if timer is not None:
                self.handle.deleteTimer(timer)
            for state in (self.about, self.stops, self.pending):
                state.clear()
            return
        wait = min([p[0] for p in pending] + [max(due, passed + 1)]) // 1000 + 1
        if wait != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wait)
        self.about.update((created, last, wait))
        self.stops.update((stops,))
        self.pending.update(([p[0] for p in pending], [p[1] for p in pending]))

    def close(self) -> None:
        pass


def meeting_states(events: DataFrame, delay: str, grace: float = 0.0, keep: float = 86_400.0,
                   idle: float = 30 * 86_400.0) -> DataFrame:
    """``job_id, what, event_id, ts, created_at, stop_ts`` from a stream of events
    ``event_id, job_id, ts, kind``.

    ``what`` is ``slice`` for a slice not later than the end of its meeting plus ``grace``,
    each once and for good, and ``meeting`` for a meeting that is settled (see ``Meeting``;
    times in seconds). Events may come in any order within ``delay``; later ones are
    dropped, as are rows without job or time, or of years before 1700 or after 2260, which
    would drag the watermark along. A meeting heard of again after it was settled
    is a new one, so ``keep`` and ``idle`` say how long it counts as the same.
    """
    rows = events.select(
        F.col("job_id").cast("string").alias("job_id"), F.col("event_id").cast("long").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"), "kind",
    ).where("job_id is not null").where(
        "year(ts) between 1700 and 2260").withColumn("at", F.unix_micros("ts"))
    said = rows.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Meeting(grace, keep, idle), outputStructType=_STATE_ROWS,
        outputMode="Append", timeMode="EventTime")
    return said.select(*[F.timestamp_micros(c).alias(c) if c in _TIMES else c for c in said.columns])


class Transcript(StatefulProcessor):
    """The places of a meeting's fragments, in order, and how often it was changed.

    Texts are emitted and not kept. A fragment that belongs after all others takes the
    next number. One that comes late shifts those after it, and each of them is emitted
    again, without its text, under a higher version.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getValueState("places", "at array<long>, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.places.get()
        before, version = (np.array(state[0], np.int64), state[1]) if state else (np.zeros(0, np.int64), 0)
        new: dict[int, str] = {}
        for part in rows:
            for place, text in zip(part["place"].tolist(), part["text"].tolist()):
                new.setdefault(place, text)
        fresh = np.setdiff1d(np.fromiter(new, np.int64, len(new)), before)
        if not len(fresh):
            return
        after = np.union1d(before, fresh)
        first = int(np.searchsorted(after, fresh[0]))  # what stands before keeps its number
        said = after[first:].tolist()
        known = set(fresh.tolist())
        self.places.update((after.tolist(), version + 1))
        yield pd.DataFrame({
            "job_id": key[0], "place": said, "chunk_no": np.arange(first + 1, len(after) + 1),
            "version": version + 1, "text": [new[p] if p in known else None for p in said]})

    def close(self) -> None:
        pass


def running_transcript(fragments: DataFrame, job: str, order: str, text: str = "text") -> DataFrame:
    """``job_id, place, chunk_no, version, text``: changes of numbered transcripts, as a
    stream of fragments comes in.

    Blank fragments are not appended. Two fragments at one place of ``order`` are one that
    was delivered twice; the first stays. Rows without job or place are left out. Written
    as it comes and read through ``current_transcript``, it is after every micro-batch what
    ``transcript.append_fragments`` makes of all fragments so far.
    """
    rows = fragments.where(~is_blank(F.col(text))).select(
        F.col(job).cast("string").alias("job_id"), F.col(order).cast("long").alias("place"),
        F.col(text).cast("string").alias("text"),
    ).where("job_id is not null and place is not null")
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Transcript(), outputStructType=FRAGMENT_ROWS,
        outputMode="Append", timeMode="None")


def current_transcript(changes: DataFrame) -> DataFrame:
    """``job_id, chunk_no, text`` as of the changes stored so far.

    A number and a text per place: one aggregation with map-side combine, so a place
    renumbered often moves one row per task.
    """
    return changes.groupBy("job_id", "place").agg(
        F.max_by("chunk_no", "version").alias("chunk_no"), F.max("text").alias("text"),
    ).select("job_id", "chunk_no", "text")

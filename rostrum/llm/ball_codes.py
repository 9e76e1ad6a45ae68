"""Vector code compression: product codes from exact ball k-means over integer parts.

Components become integers, vectors are cut into equal parts, and every part position has
a codebook of its own, trained in a fixed number of rounds. All arithmetic is on integers,
so the result doesn't depend on how the rows are dealt to tasks.

A part is assigned from the entry it had in the round before. The parts of an entry form a
ball: its radius is the distance of the farthest of them. Only entries whose centres are
nearer than twice the radius can take a part away, and they are the neighbours of the ball.
A part in the stable core, within half the way to the nearest neighbour, skips all work.
The rest lies in rings: a part between half the way to the k-th and to the next neighbour
is compared with the first k of them, and with no other. Distances that tie count as
reached, and the lower index wins.

A round is one pass: a task assigns its rows and adds up the parts of each entry; rows and
sums are written to one table in the shared folder, so a task that is run again leaves no
second count. Only the sums of all rows reach the driver: parts x entries x width numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rostrum.operators.lookup import lookup
from rostrum.session import scratch_path, stage
from rostrum.sources.sinks import drop_folder

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
MOST = 32_768  # components beyond it, either way, count as that
_ROWS = 20_000  # parts looked at together


def nearest(points: np.ndarray, codes: np.ndarray, book: np.ndarray,
            work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of the entry of ``book`` nearest to each point, ties to
    the lower index, starting from ``codes``, any entries at all. Integers throughout.

    ``work`` counts, if given, the points of stable cores and the distances computed.
    """
    out = codes.astype(np.int64)
    far = _squared(points, book[out])
    gaps = _squared(book[:, None, :], book[None, :, :])  # squared ways between centres
    for j in np.unique(codes):
        mine = np.flatnonzero(codes == j)
        own = 4 * far[mine]  # a centre can win where its gap is at most twice the distance
        others = np.delete(np.arange(len(book)), j)
        others = others[gaps[j, others] <= own.max()]  # the ball's neighbours
        others = others[np.argsort(gaps[j, others], kind="stable")]
        ring = np.searchsorted(gaps[j, others], own, "right")  # neighbours within reach
        if work is not None:
            work["stable"] = work.get("stable", 0) + int((ring == 0).sum())
            work["compared"] = work.get("compared", 0) + int(ring.sum())
        for k in np.unique(ring[ring > 0]):
            part = mine[ring == k]
            entries = np.sort(np.append(others[:k], j))
            d = _squared(points[part][:, None, :], book[entries][None, :, :])
            best = d.argmin(axis=1)  # the first, so the lowest index
            out[part], far[part] = entries[best], d[np.arange(len(part)), best]
    return out, far


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def _integers(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _round(books: np.ndarray, first: bool):
    """For ``mapInArrow``: rows with their new codes and errors, then a row of sums per task."""
    parts, entries, width = books.shape
    columns = ["vec_id", "label", "parts", "codes", "error", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                n = batch.num_rows
                points = _integers(batch.column("parts")).reshape(n, parts, width)
                codes = np.zeros((n, parts), np.int64) if first else _integers(batch.column("codes"))
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    codes[:, p], far = nearest(points[:, p], codes[:, p], books[p])
                    error += far
                    np.add.at(sums[p, :, :width], codes[:, p], points[:, p])
                    sums[p, :, width] += np.bincount(codes[:, p], minlength=entries)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("parts"),
                     pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32))),
                     pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], names=columns)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())),
             pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.int64()),
             pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=columns)
    return run


_SCHEMA = ("vec_id long, label string, parts array<int>, codes array<int>, error long, "
           "sums array<long>")


def _moved(assigned: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: means rounded down, unused entries as they were."""
    totals = assigned.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy(
        "at").agg(F.sum("v").alias("v")).collect()  # parts x entries x (width + 1)
    flat = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    for r in totals:
        flat[r["at"]] = r["v"]
    sums = flat.reshape(*books.shape[:2], -1)
    count = sums[..., -1:]
    return np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), books)


def integer_parts(vectors: DataFrame, parts: int = PARTS, vec_id: str = "vec_id",
                  vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, parts``: components as integers, all parts of a vector in a row."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high = F.lit(float(-MOST)), F.lit(float(MOST))
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"), v.alias("v"),
    ).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("v") > 0))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(
        F.greatest(low, F.least(high, x)) * SCALE).cast("int")).alias("parts"))


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks: the parts of the rows of smallest ``vec_id``."""
    first = rows.select("vec_id", "parts").orderBy(
        F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    return np.array([r["parts"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          vec_id: str = "vec_id", vector: str = "embedding",
          label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(rows, codebooks)``: ``vec_id, label, parts, codes, error`` after the last
    assignment, and entries by part position. See ``compressed`` for what takes part."""
    rows = stage(integer_parts(vectors, parts, vec_id, vector, label), "parts")
    width = rows.groupBy(F.size("parts").alias("w")).count().orderBy(
        F.desc("count"), "w").first()
    if width is None:
        return rows.select("vec_id", "label", "parts", F.array().cast("array<int>").alias("codes"),
                           F.lit(0).cast("bigint").alias("error")), np.zeros((parts, 0, 0), np.int64)
    own = rows.where(F.size("parts") == width["w"])
    if -width["w"] % parts:
        own = own.withColumn("parts", F.concat(
            "parts", F.array_repeat(F.lit(0), -width["w"] % parts)))
    books, path = codebooks(own, parts, entries), None
    spark = vectors.sparkSession
    for n in range(rounds + 1):
        before, path = path, scratch_path(spark, f"round{n}")
        own.mapInArrow(_round(books, n == 0), _SCHEMA).write.parquet(path)
        assigned = spark.read.schema(_SCHEMA).parquet(path)
        if before:  # the next round reads the newest only
            drop_folder(spark, before)
        own = assigned.where("sums is null").drop("sums")
        if n < rounds:
            books = _moved(assigned, books)
    return own, books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
               rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding",
               label: str = "label") -> DataFrame:
    """One row per vector kept: ``vec_id, code, error, label_error, codebooks_sha256``.

    ``code`` has two hex digits per part; ``error`` is the squared distance to the entries,
    over all parts; ``label_error`` the sum over rows of equal label, nulls together.

    Vectors that are null, empty or hold null or non-finite components are dropped, and so
    are those of another width than most (ties: the smaller). A width that isn't a multiple
    of ``parts`` is filled up with zeros. Components beyond 32,768, either way, count as
    that. A row repeated whole counts and is returned as often; of rows of one id the one
    with the least components comes first, and rows without id come last, when the first
    codebooks are taken. With fewer rows than entries there are as many entries as rows.
    Other columns are ignored; an empty table gives an empty one.
    """
    rows, books = train(vectors, parts, entries, rounds, vec_id, vector, label)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    marked = rows.select("vec_id", code.alias("code"), "error",
                         F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).alias("label"))
    errors = marked.groupBy("label").agg(F.sum("error").alias("label_error"))
    return lookup(marked, errors, ["label"], "code").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The query in SQL, for vectors of one width that ``parts`` divides."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (
  SELECT k.vec_id, k.label, k.p, k.v, b.e,
    list_sum([(k.v[i] - b.c[i]) * (k.v[i] - b.c[i]) for i in range(1, len(k.v) + 1)]) AS d
  FROM k JOIN b{n} b ON b.p = k.p
), a{n} AS (
  SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1
)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT p, e, list(s ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(sum(x) AS BIGINT) // count(*)
      - CASE WHEN CAST(sum(x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS s
    FROM (SELECT p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{n})
    GROUP BY p, e, i) GROUP BY p, e
), b{n + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e
)""")
    return f"""
WITH u AS (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), k AS (
  SELECT vec_id, label, p, w[p * (len(w) // {parts}) + 1 : (p + 1) * (len(w) // {parts})] AS v
  FROM u, (SELECT unnest(range(0, {parts})) AS p)
), b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM k
  QUALIFY e < {entries}
), {", ".join(steps)}, r AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
    CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label
), h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256
  FROM b{rounds}
)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM r, h
"""

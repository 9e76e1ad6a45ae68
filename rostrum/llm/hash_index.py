"""Nearest neighbours by multi-index hashing of learned binary codes.

Nearness is the inner product, codes know angles only. So entries get one more component,
``sqrt(M**2 - length**2)`` with the greatest length M of all, which gives all the same
length, and queries get a zero there: the order by angle is then that by inner product.

Codes: these vectors are centred and turned by ``ROTATIONS`` learned rotations (iterative
quantization on at most ``FIT_ROWS`` vectors, chosen by hash); the signs are the bits.
Index: the codes of a shard are split into substrings of 8 bits, each with its
table of 256 buckets. A query probes all buckets within a substring radius ``a``;
by the pigeonhole principle that gives every code within Hamming distance
``m * (a + 1) - 1`` over ``m`` substrings. The radius grows per query until that many
codes lie within it, or the shard is exhausted; what lies within is reranked on the
original vectors in double precision.

Equal vectors are one entry of the index with its smallest ids (no query can need
more than its number of results and one), so a vector that a third of all rows
share is one entry. Every entry is indexed; shards are by hash and of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rostrum.llm.common import batch_of, group_starts, groups_in_order, sampled
from rostrum.session import stage

NEAREST = 20
FIT_ROWS = 8_192
ROTATIONS = 4
ROUNDS = 30
BITS = 8  # of a substring
WITHIN = 256  # codes of a shard that the radius must hold
SHARD_ROWS = 8_192
QUERY_ROWS = 2_048
SLICE = 256  # queries compared with a shard at a time
_CELLS = 1 << 22


class Codes:
    """Learned rotated signs, as bytes. ``longest`` is the length of the longest entry."""

    def __init__(self, sample: np.ndarray, longest: float, rotations: int = ROTATIONS,
                 rounds: int = ROUNDS) -> None:
        self.longest = longest
        lifted = self.lifted(sample)
        self.mean = lifted.mean(axis=0)
        centred = lifted - self.mean
        width = lifted.shape[1]
        rng = np.random.default_rng(29)
        turns = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(rounds):  # signs for the rotation, then the rotation for the signs
                u, _, v = np.linalg.svd(np.where(centred @ r >= 0, 1.0, -1.0).T @ centred)
                r = (u @ v).T
            turns.append(r)
        self.turn = np.concatenate(turns, axis=1)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Entries with the component that makes them all as long as the longest, at length 1."""
        short = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (short * short).sum(axis=1)))
        return np.column_stack([short, rest])

    def entries(self, vectors: np.ndarray) -> np.ndarray:
        return self._signs(self.lifted(vectors))

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        return self._signs(np.column_stack([vectors / lengths[:, None], np.zeros(len(vectors))]))

    def _signs(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turn >= 0, axis=1)


class Index:
    """The codes of a shard, with a table per substring: its 256 buckets, each a set of
    codes as bits."""

    def __init__(self, codes: np.ndarray) -> None:
        self.number, self.substrings = codes.shape
        self.words = _as_words(codes)
        buckets = np.arange(256, dtype=np.uint8)[:, None]
        table = np.zeros((self.substrings, 256, -(-self.number // 64) * 8), np.uint8)
        for j in range(self.substrings):
            packed = np.packbits(codes[:, j] == buckets, axis=1)
            table[j, :, :packed.shape[1]] = packed
        self.tables = [table.view(np.uint64)]

    def _probes(self, a: int) -> np.ndarray:
        """For each value of each substring the union of the buckets within ``a`` of it."""
        while len(self.tables) <= a:
            table, values = self.tables[-1], np.arange(256)
            wider = table.copy()
            for bit in range(BITS):
                wider |= table[:, values ^ (1 << bit)]
            self.tables.append(wider)
        return self.tables[a]

    def probed(self, queries: np.ndarray, a: int) -> np.ndarray:
        """For each query which codes are within ``a`` of it in some substring."""
        probes = self._probes(a)
        hit = np.zeros((len(queries), probes.shape[2]), np.uint64)
        for j in range(self.substrings):
            hit |= probes[j][queries[:, j]]
        return np.unpackbits(hit.view(np.uint8), axis=1, count=self.number).view(bool)

    def within_radius(self, queries: np.ndarray, least: int) -> np.ndarray:
        """For each query which codes lie within its radius: the smallest that holds
        ``least`` codes (all, if there are fewer)."""
        m, least = self.substrings, min(least, self.number)
        kind = np.min_scalar_type(8 * m + 1)
        far = np.iinfo(kind).max
        asked = _as_words(queries)
        out = np.zeros((len(queries), self.number), bool)
        open_ = np.arange(len(queries) if least else 0)
        for a in range(BITS + 1):
            if not len(open_):
                break
            hit = self.probed(queries[open_], a)
            distance = np.full(hit.shape, far, kind)
            if 4 * np.count_nonzero(hit) < hit.size:
                i, j = np.nonzero(hit)
                differ = asked[open_[i]] ^ self.words[j]
                distance[i, j] = np.bitwise_count(differ).sum(axis=1, dtype=kind)
            else:  # most of the shard: a word of all pairs at once
                whole = np.zeros(hit.shape, kind)
                for w in range(self.words.shape[1]):
                    whole += np.bitwise_count(asked[open_, w][:, None] ^ self.words[:, w])
                np.copyto(distance, whole, where=hit)
            kth = np.partition(distance, least - 1, axis=1)[:, least - 1]
            done = (kth <= m * (a + 1) - 1) | (a == BITS)
            out[open_[done]] = distance[done] <= kth[done][:, None]
            open_ = open_[~done]
        return out


def _as_words(codes: np.ndarray) -> np.ndarray:
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _search(codes: Codes, k: int, least: int):
    schema = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in_order(batches, ["shard", "part"]):
            starts = [*group_starts(table, ["shard", "part"]), table.num_rows]
            for s, e in zip(starts, starts[1:]):
                rows = table.slice(s, e - s)
                asks = rows.column("asks").to_numpy()
                ids, all_ = rows.column("entry").to_numpy(), _vectors(rows.column("vector"))
                q, x, qid, xid = all_[asks], all_[~asks], ids[asks], ids[~asks]
                if not len(q) or not len(x):
                    continue
                index, width = Index(codes.entries(x)), max(1, x.shape[1])
                for at in range(0, len(q), SLICE):
                    part, part_id = q[at:at + SLICE], qid[at:at + SLICE]
                    i, j = np.nonzero(index.within_radius(codes.queries(part), least))
                    # Each row by itself, so equal pairs give equal sums wherever they stand.
                    step = max(1, _CELLS // width)
                    score = np.concatenate([
                        (part[i[n:n + step]] * x[j[n:n + step]]).sum(axis=1)
                        for n in range(0, max(1, len(i)), step)])
                    order = np.lexsort((xid[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield batch_of(schema, part_id[i[kept]], xid[j[kept]], score[kept])
    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles) without null ids and without vectors that are
    null, empty or zero or hold null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True))
        & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST, vec_id: str = "vec_id",
            vector: str = "embedding", least: int = WITHIN, shard_rows: int = SHARD_ROWS,
            query_rows: int = QUERY_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every`` its ``k`` rows of largest inner product among those found.

    A row repeated whole is one row; of rows of one id with different vectors, the
    least vector counts. Vectors of another width than most take no part. See
    ``usable`` for the others that don't. Ties go to the smaller ``vec_id``.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, vec_id, vector).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = stage(rows, "vectors")
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return none
    rows = rows.where(F.size("vector") == width["w"])
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    entries = stage(first.groupBy("vector").agg(
        F.min("vec_id").alias("entry"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    asking = stage(
        rows.where(F.col("vec_id") % every == 0).select("vec_id", "vector")
        .join(entries.select("vector", "entry"), "vector").select("vec_id", "entry"), "asking")
    number = entries.count()
    sample = sampled(entries, "entry", fit_rows, number).select("vector").toPandas()
    longest = entries.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    codes = Codes(np.stack(sample["vector"].to_numpy()).astype(float), float(np.sqrt(longest)))
    shards = -(-number // shard_rows)
    asked = asking.select("entry").distinct()
    parts = -(-asked.count() // query_rows)
    if not parts:
        return none
    by_hash = F.xxhash64("entry", F.lit(3))
    # Each shard meets each part of the queries: the queries are a fixed share of the rows,
    # and are compared with all of them, in blocks.
    index = entries.select(
        "entry", "vector", F.lit(False).alias("asks"),
        F.pmod(by_hash, F.lit(shards)).alias("shard"),
        F.explode(F.sequence(*(F.lit(n).cast("bigint") for n in (0, parts - 1)))).alias("part"))
    queries = entries.join(asked, "entry").select(
        "entry", "vector", F.lit(True).alias("asks"),
        F.explode(F.sequence(*(F.lit(n).cast("bigint") for n in (0, shards - 1)))).alias("shard"),
        F.pmod(by_hash, F.lit(parts)).alias("part"))
    found = (
        index.union(queries.select(*index.columns)).repartition("shard", "part")
        .sortWithinPartitions("shard", "part")
        .mapInArrow(_search(codes, k + 1, least), "query long, entry long, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    top = (
        found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        .join(entries.select("entry", "ids"), "entry")
        .select("query", "score", F.explode("ids").alias("vec_id"))
    )
    by_rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        top.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= k + 1)
        .groupBy(F.col("query").alias("entry"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))
    )
    own = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    return (
        asking.withColumnRenamed("vec_id", "query_id").join(lists, "entry")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
    )

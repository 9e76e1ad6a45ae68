"""Top-k most similar texts of the same meeting, for many prompts at once.

Every prompt has to be compared with every candidate of its meeting. Emitting
those pairs as rows would make a large meeting quadratic in rows, so each task
gets a block of prompts and a block of candidates, multiplies them as matrices
and emits at most ``k`` hits per prompt. Spark lays out the blocks:

* ordinary meetings are hashed into cells of about ``block_rows`` rows;
* a meeting above ``block_rows`` is cut into blocks on both sides, and each
  side is repeated once per block of the other.

A task therefore holds a bounded number of rows whatever the size of a
meeting, and the last step only ranks ``k`` hits per prompt and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rostrum.functions.vectors import FEATURES, cosine
from rostrum.limits import VECTOR_WIDTH
from rostrum.operators.lookup import lookup
from rostrum.session import stage

BLOCK_ROWS = 4096
STRIP = 256
BROADCAST_JOBS = 100_000
DIGITS = 6


def _matrix(indices: pa.ChunkedArray | None, values: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of a list column as a dense matrix; an empty list is a zero row.

    With ``indices`` the lists are sparse, else they have ``size`` items.
    """
    values = values.combine_chunks()
    lengths = np.diff(values.offsets.to_numpy())
    if indices is None and np.any((lengths != size) & (lengths != 0)):
        raise ValueError(f"vector width is not {size}")
    out = np.zeros((len(values), size))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if indices is None:
        out[lengths > 0] = flat.reshape(-1, size)
    else:
        rows = np.repeat(np.arange(len(values)), lengths)
        out[rows, indices.combine_chunks().flatten().to_numpy(zero_copy_only=False)] = flat
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best of each row; ties go to the lower column.

    Of the columns that tie at the least score still needed only the first ones
    are taken, so that a block full of copies costs no more than any other.
    """
    picked = np.isfinite(scores)
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        above, level = scores > least, scores == least
        open_places = k - above.sum(axis=1, keepdims=True)
        picked &= above | (level & (level.cumsum(axis=1) <= open_places))
    return np.nonzero(picked)


def block_hits(k: int, size: int, sparse: bool, ordered: bool, distinct: bool, schema: pa.Schema):
    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        m = _matrix(table["_idx"] if sparse else None, table["_val"], size)
        return m, np.sqrt((m * m).sum(axis=1))

    def hits(prompts: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(prompts) or not len(candidates):
            return schema.empty_table()
        jobs = np.concatenate([prompts["job"].to_numpy(), candidates["job"].to_numpy()])
        codes = np.unique(jobs, return_inverse=True)[1]
        p_code, c_code = codes[: len(prompts)], codes[len(prompts):]
        p_id, c_id = prompts["prompt_id"].to_numpy(), candidates["candidate_id"].to_numpy()
        # Within a meeting candidates lie in id order, so ties resolve by position.
        p_rows, c_rows = np.argsort(p_code, kind="stable"), np.lexsort((c_id, c_code))
        p_mat, p_len = vectors(prompts.select(["_val"] + (["_idx"] if sparse else [])))
        c_mat, c_len = vectors(candidates.select(["_val"] + (["_idx"] if sparse else [])))
        p_ord = prompts["_ord"].to_numpy() if ordered else None
        c_ord = candidates["_ord"].to_numpy() if ordered else None
        p_take, c_take, found = [], [], []
        for code in np.intersect1d(p_code, c_code):
            lo, hi = np.searchsorted(p_code[p_rows], [code, code + 1])
            mine = p_rows[lo:hi]
            lo, hi = np.searchsorted(c_code[c_rows], [code, code + 1])
            theirs = c_rows[lo:hi]
            right, right_len = c_mat[theirs], c_len[theirs]
            for at in range(0, len(mine), STRIP):
                strip = mine[at : at + STRIP]
                lengths = p_len[strip][:, None] * right_len[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.round((p_mat[strip] @ right.T) / lengths, DIGITS)
                scores[~np.isfinite(scores)] = -np.inf
                if ordered:
                    scores[c_ord[theirs][None, :] >= p_ord[strip][:, None]] = -np.inf
                if distinct:
                    scores[c_id[theirs][None, :] == p_id[strip][:, None]] = -np.inf
                rows, cols = _best(scores, k)
                p_take.append(strip[rows])
                c_take.append(theirs[cols])
                found.append(scores[rows, cols])
        if not found:
            return schema.empty_table()
        p_at, c_at = np.concatenate(p_take), np.concatenate(c_take)
        return pa.table(
            [
                prompts["job"].take(p_at), prompts["prompt_id"].take(p_at),
                candidates["candidate_id"].take(c_at), pa.array(np.concatenate(found)),
            ],
            schema=schema,
        )

    return hits


def block_side(df: DataFrame, job: str, ident: str, ident_name: str, vector: str,
          order: str | None, sparse: bool) -> DataFrame:
    """The columns a block needs; without a meeting there is nothing to find.

    A missing vector counts as an empty one. Those are skipped in the block and not by a filter here, which would be
    pushed below the expression that makes the vector and repeat it.
    """
    columns = [F.col(job).alias("job"), F.col(ident).alias(ident_name)]
    if sparse:
        items = F.coalesce(F.col(vector), F.array().cast(FEATURES))
        columns += [items["bucket"].alias("_idx"), items["tf"].alias("_val")]
    else:
        items = F.coalesce(F.col(vector), F.array().cast(df.schema[vector].dataType))
        columns += [items.alias("_val")]
    if order:
        columns.append(F.col(order).alias("_ord"))
    return df.where(F.col(job).isNotNull()).select(*columns)


def _sizes(prompts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Prompts and candidates per meeting; reads the meeting column only."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        prompts.select("job", one.alias("_p"), none.alias("_c"))
        .unionByName(candidates.select("job", none.alias("_p"), one.alias("_c")))
        .groupBy("job").agg(F.sum("_p").alias("_p"), F.sum("_c").alias("_c"))
    )


def top_similar(
    prompts: DataFrame, candidates: DataFrame, k: int, *, job: str,
    prompt_id: str, candidate_id: str, vector: str = "vector",
    prompt_order: str | None = None, candidate_order: str | None = None,
    exclude_self: bool = False, size: int = VECTOR_WIDTH, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``job, prompt_id, candidate_id, rank, score``; exact, score cosine to 6 places.

    ``vector`` is dense (``array<float|double>``) or sparse (hashed features).
    With the two order columns only candidates strictly before the prompt
    count. Ranks go by score, ties by candidate id.
    """
    sparse = isinstance(prompts.schema[vector].dataType.elementType, T.StructType)
    ordered = prompt_order is not None
    left = block_side(prompts, job, prompt_id, "prompt_id", vector, prompt_order, sparse)
    right = block_side(candidates, job, candidate_id, "candidate_id", vector, candidate_order, sparse)

    sizes = _sizes(left, right)
    asked, both = F.col("_p") > 0, F.greatest("_p", "_c")
    total = sizes.agg(
        F.coalesce(F.greatest(F.sum("_p"), F.sum(F.when(asked, F.col("_c")))), F.lit(0)).alias("rows"),
        F.coalesce(F.max(F.when(asked, both)), F.lit(0)).alias("largest"),
        F.count_if(asked).alias("asked"), F.count("*").alias("jobs"),
    ).first()
    if total.asked < total.jobs and total.asked <= BROADCAST_JOBS:
        # Few meetings are asked about: candidates of the others stay where they
        # are. The list of meetings was just counted, so its size is known.
        right = right.join(F.broadcast(left.select("job").distinct()), "job", "left_semi")
    large = None
    if total.largest > block_rows:
        blocks = lambda n: F.greatest(F.ceil(F.col(n) / block_rows).cast("int"), F.lit(1))
        # Written once, since both sides are joined with it.
        large = stage(
            sizes.where(asked & (both > block_rows))
            .select("job", blocks("_p").alias("_pn"), blocks("_c").alias("_cn")),
            "blocks",
        )
    spark = prompts.sparkSession
    cells = max(-(-total.rows // block_rows), 2 * spark.sparkContext.defaultParallelism)

    def lay_out(df: DataFrame, own: str, ident: str) -> DataFrame:
        other = "_c" if own == "_p" else "_p"
        cell = F.pmod(F.xxhash64("job"), F.lit(cells))
        if large is None:
            zero = F.lit(0)
            return df.select("*", cell.alias("_cell"), zero.alias("_pb"), zero.alias("_cb"))
        placed = lookup(df, large, ["job"], ident, stored=True)
        count = lambda side: F.coalesce(F.col(f"{side}n"), F.lit(1))
        return placed.select(
            *df.columns, cell.alias("_cell"),
            F.pmod(F.xxhash64(ident), count(own)).cast("int").alias(f"{own}b"),
            F.explode(F.sequence(F.lit(0), count(other) - 1)).alias(f"{other}b"),
        )

    result = T.StructType([
        T.StructField("job", left.schema["job"].dataType),
        T.StructField("prompt_id", left.schema["prompt_id"].dataType),
        T.StructField("candidate_id", right.schema["candidate_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    kernel = block_hits(k, size, sparse, ordered, exclude_self, to_arrow_schema(result))
    keys = ["_cell", "_pb", "_cb"]
    hits = (
        lay_out(left, "_p", "prompt_id").groupBy(*keys)
        .cogroup(lay_out(right, "_c", "candidate_id").groupBy(*keys))
        .applyInArrow(kernel, result)
    )
    rank = F.row_number().over(
        Window.partitionBy("job", "prompt_id").orderBy(F.desc("score"), "candidate_id")
    )
    return (
        hits.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
        .select(F.col("job").alias(job), "prompt_id", "candidate_id", "rank", "score")
    )


def search(candidates: DataFrame, k: int, *, job: str, job_value, prompt: Column,
           candidate_id: str, vector: str = "vector") -> DataFrame:
    """One prompt against one meeting: payload and score of the ``k`` best.

    The meeting is a pushed-down filter and the limit a top-k, so only that
    meeting is read and only ``k`` rows per task move.
    """
    return (
        candidates.where(F.col(job) == job_value)
        .withColumn("score", F.round(cosine(F.col(vector), prompt), DIGITS))
        .where(F.col("score").isNotNull())
        .orderBy(F.desc("score"), candidate_id).limit(k)
        .drop(vector)
    )

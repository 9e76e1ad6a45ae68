"""Inverted index over hashed features, and exact top-k search that stops by bounds.

A posting list belongs to a meeting and a bucket. It holds the texts of the meeting that
have the bucket, heaviest share of their length first, in blocks with the weight that
none of the block exceeds. A search reads the first blocks of its prompt's lists, scores
what it meets exactly, and looks at what the next blocks could still give: prompt weight
times block bound, over all lists. Once the k-th score is above that sum, no text that
was not met can be among the k best, and the rest of the lists is left unread. Each round
reads twice as many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.functions.vectors import feature_norm
from rostrum.operators.ordering import ROWS_PER_TASK, number_rows
from rostrum.operators.retrieval import DIGITS, top_similar
from rostrum.session import stage

POSTINGS_PER_BLOCK = 64
ROUNDS = 5  # blocks 0, 1, 2-3, 4-7, 8-15 of each list; then blocks of texts are compared
SLACK = 2e-6  # more than scores lose when they are rounded


def _sparse(df: DataFrame, job: str, ident: str, name: str, vector: str) -> DataFrame:
    """Texts with a direction; without a meeting or a letter there is nothing to find."""
    return df.select(
        F.col(job).alias("job"), F.col(ident).alias(name), F.col(vector).alias("vector"),
        feature_norm(F.col(vector)).alias("norm"),
    ).where("job is not null and norm > 0")


def posting_lists(
    candidates: DataFrame, job: str, ident: str, vector: str = "vector",
    per_block: int = POSTINGS_PER_BLOCK, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``job, bucket, block, bound, ids``: blocks of each list, counted from 0, ``bound``
    the largest weight in a block.

    Lists of any length: those above ``rows_per_task`` are numbered by ranges.
    """
    rows = _sparse(candidates, job, ident, "id", vector).select(
        "job", "id", "norm", F.explode("vector").alias("f"))
    weighed = rows.select(
        "job", F.col("f.bucket").alias("bucket"), "id",
        F.struct("job", F.col("f.bucket").alias("bucket")).alias("_list"),
        (-F.col("f.tf") / F.col("norm")).alias("_rank"))
    numbered = number_rows(weighed, "_list", ["_rank", "id"], "n", rows_per_task)
    return numbered.groupBy(
        "job", "bucket", F.floor((F.col("n") - 1) / per_block).cast("int").alias("block")
    ).agg((-F.min("_rank")).alias("bound"), F.collect_list("id").alias("ids"))


def _score() -> Column:
    """Cosine of ``asked`` and ``vector``; the product is a sum of whole numbers."""
    shared = F.aggregate(
        F.col("asked"), F.lit(0).cast("bigint"),
        lambda total, a: total + F.aggregate(
            F.filter("vector", lambda c: c["bucket"] == a["bucket"]), F.lit(0).cast("bigint"),
            lambda s, c: s + a["tf"].cast("bigint") * c["tf"].cast("bigint")))
    return F.round(shared.cast("double") / (F.col("asked_norm") * F.col("norm")), DIGITS)


def top_by_index(
    prompts: DataFrame, candidates: DataFrame, postings: DataFrame, k: int, *, job: str,
    prompt_id: str, candidate_id: str, vector: str = "vector", rounds: int = ROUNDS,
    read: list | None = None,
) -> DataFrame:
    """``job, prompt_id, candidate_id, rank, score``, as ``retrieval.top_similar`` gives it
    over whole meetings.

    ``postings`` come from ``posting_lists(candidates)``. A prompt still open after
    ``rounds`` rounds is searched by blocks of texts, without the index, so no prompt meets
    more than ``2 ** (rounds - 1)`` blocks of a list. ``read`` gets, if given, the number of
    posting blocks that each round read.
    """
    keys = ["job", "prompt_id"]
    asked = stage(_sparse(prompts, job, prompt_id, "prompt_id", vector), "asked")
    texts = stage(_sparse(candidates, job, candidate_id, "id", vector), "texts")
    lists = stage(postings, "postings")
    terms = asked.select(*keys, "norm", F.explode("vector").alias("f")).select(
        *keys, F.col("f.bucket").alias("bucket"), (F.col("f.tf") / F.col("norm")).alias("share"))
    known = asked.select(*keys, F.col("vector").alias("asked"), F.col("norm").alias("asked_norm"))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    scores, open_, low, high = None, asked.select(*keys), 0, 1
    for _ in range(rounds):
        mine = terms.join(open_, keys, "left_semi")
        met = mine.join(lists.where((F.col("block") >= low) & (F.col("block") < high)), ["job", "bucket"])
        if read is not None:
            read.append(met.count())
        met = met.select(*keys, F.explode("ids").alias("id")).distinct()
        if scores is not None:
            met = met.join(scores, [*keys, "id"], "left_anti")
        fresh = met.join(texts, ["job", "id"]).join(known, keys).select(
            *keys, "id", _score().alias("score"))
        scores = stage(fresh if scores is None else scores.unionByName(fresh), "scores")
        left = mine.join(lists.where(F.col("block") == high), ["job", "bucket"]).groupBy(*keys).agg(
            F.sum(F.col("share") * F.col("bound")).alias("could"))
        kth = scores.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(
            *keys, F.col("score").alias("kth"))
        open_ = stage(left.join(kth, keys, "left").where(
            F.col("kth").isNull() | (F.col("kth") <= F.col("could") + SLACK)).select(*keys), "open")
        if open_.isEmpty():
            break
        low, high = high, 2 * high
    result = (
        scores.unionByName(_first_others(known, texts, scores, keys, k))
        .join(open_, keys, "left_anti")
        .withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
        .select(F.col("job").alias(job), "prompt_id", F.col("id").alias("candidate_id"), "rank", "score")
    )
    if open_.isEmpty():
        return result
    rest = prompts.join(open_.select(F.col("job").alias(job), F.col("prompt_id").alias(prompt_id)),
                        [job, prompt_id], "left_semi")
    return result.unionByName(top_similar(
        rest, candidates, k, job=job, prompt_id=prompt_id, candidate_id=candidate_id,
        vector=vector).select(*result.columns))


def _first_others(known: DataFrame, texts: DataFrame, scores: DataFrame, keys: list[str],
                  k: int) -> DataFrame:
    """Of each prompt that met fewer than ``k`` texts, texts of its meeting that it didn't
    meet, at score 0.

    Such a prompt has met all that share a bucket with it. So fewer than ``k`` of the first
    ``2 * k`` of its meeting were met, and ``k`` others are among them if there are so many.
    """
    met = scores.groupBy(*keys).agg(F.count("*").alias("met"))
    few = known.join(met, keys, "left").where(F.coalesce("met", F.lit(0)) < k).select(*keys)
    place = Window.partitionBy("job").orderBy("id")
    first = texts.select("job", "id").withColumn("n", F.row_number().over(place)).where(
        F.col("n") <= 2 * k).drop("n")
    return few.join(first, "job").join(scores, [*keys, "id"], "left_anti").select(
        *keys, "id", F.lit(0.0).alias("score"))

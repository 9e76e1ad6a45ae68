"""Mixing sources to target weights by fitting subset sums.

Every source gets a target number of words. Whole copies of the source cover as
much of it as they can; for the rest, documents are counted by exact length, each
length gives its share rounded down, and a bounded-knapsack dynamic programme
over lengths picks what still lacks, to the word where lengths allow it. Which
documents of a length are picked is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # of a source's words
SEED = 17
SLOTS = 4096  # by hash, of the documents of one source and length
STRIP = 1 << 17  # bytes of reachable sums that are looked at at once


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> dict[str | None, float]:
    """Words per source: ``share`` of all, by weight, none above ``most`` of its own.

    Sources come by code point, null last, and take the weights in turn. What a
    source can't take is shared anew among the others, by weight.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, out, rest = share * sum(sizes.values()), {}, list(order)
    while rest:
        unit = max(0.0, budget - sum(out.values())) / sum(weight[s] for s in rest)
        full = [s for s in rest if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in rest}
            break
        out |= {s: most * sizes[s] for s in full}
        rest = [s for s in rest if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending, above 0) come nearest to
    ``budget`` words without passing it.

    Each length gives its share, the longest that still fit go on top, and the programme
    fills what lacks. If that doesn't meet the budget to the word, some of each length are
    taken back and the programme decides on them too: first one, then twice as many, until
    it meets the budget or as many were taken back as can matter. Two choices that differ
    by more than twice the longest length in documents share a part of equal words, which
    can be left as it is, so taking back more can't bring the sum nearer.
    """
    if budget >= int(lengths @ counts):
        return counts.copy()
    unit = int(np.gcd.reduce(lengths))  # every sum is a multiple
    size, budget = [int(n) // unit for n in lengths], budget // unit
    have = [int(n) for n in counts]  # Python integers can't overflow
    total = sum(s * n for s, n in zip(size, have))
    taken = [n * budget // total for n in have]
    left = budget - sum(s * n for s, n in zip(size, taken))
    for i in range(len(size) - 1, -1, -1):
        more = min(left // size[i], have[i] - taken[i])
        taken[i] += more
        left -= more * size[i]
    back = 0
    while True:
        given = [min(n, back) for n in taken]
        room = left + sum(s * n for s, n in zip(size, given))
        add, made = _fill(size, [h - t + g for h, t, g in zip(have, taken, given)], room)
        if made == room or back >= min(2 * size[-1], max(taken)):
            return np.array([t - g + a for t, g, a in zip(taken, given, add)], np.int64)
        back = max(1, 2 * back)


def _fill(size: list[int], spare: list[int], room: int) -> tuple[list[int], int]:
    """How many of each size, up to ``spare``, make the greatest sum up to ``room``, and
    that sum: a bounded knapsack, its reachable sums the bits of an integer.

    Of every sum only the first step that reaches it is kept, a few bytes a sum: one integer
    a step, which the way back could also be read from, would be many times as much."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    most = sum(min(n, room // s).bit_length() for s, n in zip(size, spare))
    first = np.zeros(room + 1, np.uint16 if most < 1 << 16 else np.uint32)
    for i in range(len(size)):
        if reach >> room & 1:
            break
        n, part = min(spare[i], room // size[i]), 1
        while n > 0 and not reach >> room & 1:  # 1, 2, 4, ... of one size
            part = min(part, n)
            steps.append((i, part))
            new = (reach << part * size[i] & mask | reach) ^ reach
            if new:
                reach |= new
                _mark(first, new, len(steps))
            n, part = n - part, part * 2
    add, at = [0] * len(size), reach.bit_length() - 1
    made = at
    while at:
        i, part = steps[int(first[at]) - 1]
        add[i] += part
        at -= part * size[i]
    return add, made


def _mark(first: np.ndarray, bits: int, step: int) -> None:
    """Writes ``step`` at the places that are set in ``bits``."""
    low = (bits & -bits).bit_length() - 1
    bits >>= low
    raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    for at in range(0, len(raw), STRIP):
        first[low + 8 * at + np.flatnonzero(np.unpackbits(raw[at:at + STRIP], bitorder="little"))] = step


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
          seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, times``.

    ``times`` is how often the mix takes the document, ``taken`` the words that
    makes. A null source is a source; a null or blank text has no words, and goes
    along with the whole copies of its source only. Rows repeated whole are picked
    one by one. Other columns are ignored.

    One row per source passes through the driver, and one per source and length
    through the fit of that source; both lists are far shorter than the table.
    """
    own = docs.select(
        F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("size"),
        F.concat(F.lit("="), F.col(source).cast("string")).alias("source"))
    own = stage(own.withColumns({
        "source": F.coalesce("source", F.lit("")),
        "order": F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))}), "sizes")
    spark = docs.sparkSession
    counted = stage(own.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = {r["source"]: int(r["words"]) for r in counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    aim = targets({s[1:] if s else None: n for s, n in sizes.items()}, weights, share, most)
    plan = []
    for name, size in sizes.items():
        target = float(aim[name[1:] if name else None])
        whole = int(target // size) if size else 0
        plan.append((name, size, target, whole, max(0, round(target - whole * size))))
    plan = spark.createDataFrame(
        plan, "source string, source_size long, target double, whole long, rest long")

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.greater(rows["size"], 0)).sort_by("size")
        picked = counts = rows["n"].to_numpy()
        if len(rows):
            picked = fit(rows["size"].to_numpy(), counts, rows["rest"][0].as_py())
        return rows.select(["source", "size", "n"]).append_column("picked", pa.array(picked, pa.int64()))

    picked = counted.join(plan.select("source", "rest"), "source").groupBy("source").applyInArrow(
        pick, "source string, size long, n long, picked long").where("picked > 0")
    slot = F.pmod(F.shiftright("order", 20), F.lit(SLOTS))
    rows = own.withColumn("slot", slot)
    # The slot in which the picking of a length ends; only that one is ranked.
    before = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    ends = (
        rows.groupBy("source", "size", "slot").agg(F.count("*").alias("here"))
        .join(picked, ["source", "size"])
        .withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
        .where("before < picked and before + here >= picked")
        .select("source", "size", F.col("slot").alias("end"),
                (F.col("picked") - F.col("before")).alias("of_end"))
    )
    placed = stage(rows.join(ends, ["source", "size"], "left"), "placed")
    rank = Window.partitionBy("source", "size", "slot").orderBy("order", "doc_id")
    last = placed.where("slot = end").withColumn(
        "extra", (F.row_number().over(rank) <= F.col("of_end")).cast("int"))
    others = placed.where("end is null or slot != end").withColumn(
        "extra", F.coalesce((F.col("slot") < F.col("end")).cast("int"), F.lit(0)))
    return (
        last.unionByName(others).join(F.broadcast(plan), "source")
        .withColumn("times", F.col("whole") + F.col("extra"))
        .select("doc_id", "size", "source_size", "target",
                (F.col("size") * F.col("times")).alias("taken"), "times")
    )


def taken_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``times`` says."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    # Rows of one id are told apart by a hash of all they hold; copies share a number.
    keyed = rows.withColumn("_key", F.xxhash64("_row")).withColumn(
        "_tag", F.concat_ws(":", F.col("_id").cast("string"), F.col("_key").cast("string")))
    times = mixed(keyed, "_tag", "_text", "_source").groupBy(
        F.col("doc_id").alias("_tag")).agg(F.sum("times").alias("_times"))
    one = keyed.join(times, "_tag").groupBy("_tag").agg(
        F.first("_row").alias("_row"), F.first("_times").alias("_times"))
    return one.where("_times > 0").select(
        "_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))).select("_row.*")

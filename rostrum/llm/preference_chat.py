"""Preference formatting of conversation pairs, in DataFrame functions only.

A pair is a chosen and a rejected conversation. The longest common prefix of
their turns (equal role and text) is rendered once, as the prompt; what follows
on either side is its completion. Spans say which characters of a completion are
learned from: what assistants say, and the mark that ends it. All else is masked.

A turn is rendered as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>``
and a line feed. ``<|`` within a role or text becomes ``< |``, so no text can end
a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.operators.ordering import number_rows
from rostrum.session import stage

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def _safe(value: Column) -> Column:
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: an array of ``role, text`` in order.

    Ordered by turn (null first), then role and text. Rows repeated whole are one
    turn; a null role is ``unknown``, a null text empty. Rows without ``conv_id`` are
    left out. A conversation is one row of the result, so it is what bounds a row.
    """
    one = F.struct(
        F.col(turn).cast("bigint").alias("turn"),
        _safe(F.coalesce(F.col(role).cast("string"), F.lit("unknown"))).alias("role"),
        _safe(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    return (
        turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), one.alias("one"))
        .where("conv_id is not null").groupBy("conv_id")
        .agg(F.array_sort(F.collect_set("one")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(
            t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def _said(turns: str) -> Column:
    """Places, from 1, of the assistant turns in an array of turns."""
    return F.filter(F.when(F.size(turns) > 0, F.sequence(F.lit(1), F.size(turns))),
                    lambda i: F.element_at(turns, i)["role"] == LEARNED)


def forked_pairs(chats: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected`` for every conversation with an assistant turn.

    Chosen is the conversation up to its last assistant turn. Conversations are numbered
    by ``conv_id`` and taken in twos, an odd last one with the one before it (a single one
    with itself). Rejected leaves the chosen one at an assistant turn, the one that the
    number picks, and goes on with what the other conversation says from such a turn on.
    Conversations without an assistant turn give no row.
    """
    spoken = stage(
        chats.withColumn("said", _said("turns")).where("size(said) > 0").select(
            "conv_id", "said", F.expr("slice(turns, 1, element_at(said, -1))").alias("chosen")),
        "spoken")
    # Only ids are numbered, by ranges: no task sorts them all.
    numbered = stage(number_rows(
        spoken.select("conv_id", F.lit(0).alias("all")), "all", ["conv_id"], "n", 0), "numbers")
    total = numbered.count()
    mate = F.when(F.col("n") % 2 == 0, F.col("n") - 1).when(
        F.col("n") < total, F.col("n") + 1).otherwise(F.greatest(F.col("n") - 1, F.lit(1)))
    at = F.get("said", (F.col("n") % F.size("said")).cast("int"))
    sides = spoken.join(numbered.select("conv_id", "n"), "conv_id").withColumn("at", at)
    other = numbered.select("conv_id", "n").join(spoken, "conv_id").select(
        F.col("n").alias("mate"), F.col("said").alias("mate_said"),
        F.col("chosen").alias("mate_turns"))
    start = F.get("mate_said", (F.col("n") % F.size("mate_said")).cast("int"))
    return (
        sides.withColumn("mate", mate).join(other, "mate").withColumn("start", start)
        .select("conv_id", "chosen", F.concat(
            F.expr("slice(chosen, 1, at - 1)"),
            F.expr("slice(mate_turns, start, size(mate_turns))")).alias("rejected"))
    )


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _spans(turns: Column) -> Column:
    """``begin, end`` (in characters) of what is learned of the turns rendered."""
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(so_far: Column, turn: Column) -> Column:
        begin = so_far["at"] + F.length(turn["role"]) + len(START) + 1
        end = begin + F.length(turn["text"]) + len(END)
        span = F.struct(begin.alias("begin"), end.alias("end"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(turn["role"] == LEARNED, F.concat(so_far["spans"], F.array(span)))
            .otherwise(so_far["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """``conv_id, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans``
    from ``conv_id, chosen, rejected``, arrays of ``role, text``.

    Equal conversations are all prompt, with empty completions; without a common
    turn the prompt is empty. A null side counts as no turns, an empty table gives an
    empty one. A pair is a row, however long its turns are.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("chosen", "rejected")])
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b))
    at = F.array_position(differs, True).cast("int")
    cut = sides.withColumn("prefix_turns", F.when(at > 0, at - 1).otherwise(F.size("chosen")))
    rest = [F.expr(f"slice({c}, prefix_turns + 1, size({c}))").alias(c)
            for c in ("chosen", "rejected")]
    text = {c: F.array_join(F.transform(c, _rendered), "") for c in ("prompt", "chosen", "rejected")}
    return (
        cut.select("conv_id", "prefix_turns",
                   F.expr("slice(chosen, 1, prefix_turns)").alias("prompt"), *rest)
        .select("conv_id", "prefix_turns", *[t.alias(c) for c, t in text.items()],
                _spans(F.col("chosen")).alias("chosen_spans"),
                _spans(F.col("rejected")).alias("rejected_spans"))
    )


def spans_text(spans: str) -> Column:
    """Spans as ``begin-end,begin-end``."""
    return F.array_join(F.transform(spans, lambda s: F.concat(
        s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


#: The query in SQL, over rows instead of arrays.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         role, text
  FROM (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
               replace(coalesce(text, ''), '<|', '< |') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
), said AS (
  SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS j
  FROM t WHERE role = 'assistant'
), l AS (
  SELECT conv_id, max(n) AS last, count(*) AS answers, row_number() OVER (ORDER BY conv_id) AS k,
         count(*) OVER () AS total
  FROM said GROUP BY conv_id
), p AS (
  SELECT a.conv_id, a.last, b.conv_id AS other, b.last AS other_last, x.n AS fork, y.n AS start
  FROM l a
  JOIN l b ON b.k = CASE WHEN a.k % 2 = 0 THEN a.k - 1 WHEN a.k < a.total THEN a.k + 1
                         ELSE greatest(a.k - 1, 1) END
  JOIN said x ON x.conv_id = a.conv_id AND x.j = a.k % a.answers
  JOIN said y ON y.conv_id = b.conv_id AND y.j = a.k % b.answers
), c AS (
  SELECT p.conv_id, t.n, t.role, t.text FROM p JOIN t ON t.conv_id = p.conv_id AND t.n <= p.last
), r AS (
  SELECT c.conv_id, c.n, c.role, c.text FROM c JOIN p ON p.conv_id = c.conv_id AND c.n < p.fork
  UNION ALL
  SELECT p.conv_id, p.fork + t.n - p.start, t.role, t.text
  FROM p JOIN t ON t.conv_id = p.other AND t.n >= p.start AND t.n <= p.other_last
), d AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.n, r.n)) - 1 AS prefix
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.n = r.n
  WHERE c.n IS NULL OR r.n IS NULL OR c.role <> r.role OR c.text <> r.text
  GROUP BY 1
), f AS (
  SELECT p.conv_id, coalesce(d.prefix, p.last) AS prefix FROM p LEFT JOIN d ON d.conv_id = p.conv_id
), s AS (
  SELECT 'chosen' AS side, c.* FROM c UNION ALL SELECT 'rejected', r.* FROM r
), o AS (
  SELECT s.conv_id, s.side, s.n, s.role, s.n <= f.prefix AS shared,
         '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) AS line,
         length(s.role) + 13 AS head, length(s.text) + 10 AS body
  FROM s JOIN f ON f.conv_id = s.conv_id
), w AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, side, shared ORDER BY n) - length(line)
            + head AS start
  FROM o
), q AS (
  SELECT conv_id,
    string_agg(CASE WHEN side = 'chosen' AND shared THEN line END, '' ORDER BY n) AS prompt,
    string_agg(CASE WHEN side = 'chosen' AND NOT shared THEN line END, '' ORDER BY n) AS chosen,
    string_agg(CASE WHEN side = 'rejected' AND NOT shared THEN line END, '' ORDER BY n) AS rejected,
    string_agg(CASE WHEN side = 'chosen' AND NOT shared AND role = 'assistant'
      THEN CAST(start AS BIGINT) || '-' || CAST(start + body AS BIGINT) END, ',' ORDER BY n) AS chosen_spans,
    string_agg(CASE WHEN side = 'rejected' AND NOT shared AND role = 'assistant'
      THEN CAST(start AS BIGINT) || '-' || CAST(start + body AS BIGINT) END, ',' ORDER BY n) AS rejected_spans
  FROM w GROUP BY conv_id
)
SELECT f.conv_id, CAST(f.prefix AS INTEGER) AS prefix_turns, coalesce(prompt, '') AS prompt,
  coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
  coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected_spans, '') AS rejected_spans
FROM f JOIN q ON q.conv_id = f.conv_id
"""

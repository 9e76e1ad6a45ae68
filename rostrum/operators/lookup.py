"""Joining a large table with one row per key of a smaller one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rostrum.operators.hot_keys import hot_salts, salted
from rostrum.session import stage

BROADCAST_BYTES = 32 << 20
SALTS = 8


def payload_bytes(table: DataFrame) -> int:
    """Bytes of all values: the length of what varies, 8 for what does not."""
    def width(field: T.StructField):
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 8
        return F.lit(8)

    total = sum((width(f) for f in table.schema.fields), F.lit(0)).cast("bigint")
    return table.agg(F.sum(total)).first()[0] or 0


def lookup(
    facts: DataFrame, dim: DataFrame, keys: list[str], spread: str, how: str = "left",
    stored: bool = False, broadcast_bytes: int = BROADCAST_BYTES, salts: int | None = SALTS,
) -> DataFrame:
    """``facts`` joined with ``dim``, a narrow table with one row per key.

    The lookup table is mostly the result of a grouping; it is written once, so
    that its size is known before the join is planned (``stored`` leaves that
    out for what is a table already, or cheap enough to be made twice). Up to
    ``broadcast_bytes`` of values, keys of any width included, it is broadcast,
    and the facts with their texts are not shuffled at all. AQE would measure it
    too, but only once the facts were shuffled.

    A larger one is joined on the keys and a salt made from ``spread``, a column
    of the facts that varies within a key: a hot key arrives in ``salts`` parts.
    A grouping by the keys that follows has its own shuffle then, instead of
    taking over this one, and AQE may split parts that are still too large; it
    does so only where both sides come straight from a shuffle and nothing
    after the join depends on its partitioning. With ``salts=None`` the keys of the
    facts are read once more, to give each hot key as many salts as its share of the
    rows asks for and all others none (``hot_keys``).
    """
    table = dim if stored else stage(dim, "lookup")
    if payload_bytes(table) <= broadcast_bytes:
        return facts.join(F.broadcast(table), keys, how)
    if salts is None:
        hot = hot_salts(facts, keys)
        if not hot:
            return facts.join(table, keys, how)
        dealt, copied = salted(facts, table, keys, spread, hot)
        return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")

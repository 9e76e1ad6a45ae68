"""JSON inside text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from rostrum.functions.binding import let
from rostrum.schemas import CLEAN_CHUNKS


def json_quote(text: Column) -> Column:
    """The text as a JSON string literal, quotes included."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def bracketed(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; null when there is no such span."""
    return F.when(text.rlike(r"(?s)\[.*\]"), F.regexp_extract(text, r"(?s)\[.*\]", 0))


def strict_json(text: Column, kind: T.DataType) -> Column:
    """A value of ``kind`` when the text is exactly one JSON value, else null.

    ``from_json`` alone accepts text after the value. Read as the only item of
    an array, the value must be followed by the bracket that closes the array.
    Only a text with a bracket of its own could close it early; such a text is
    read a second time, as a member of an object.
    """
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(kind))
    member = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")),
        T.StructType([T.StructField("v", kind)]),
    )["v"]
    return let(
        items,
        lambda x: F.when(
            (F.size(F.coalesce(x, F.array())) == 1)
            & (~text.contains("]") | member.isNotNull()),
            F.get(x, F.lit(0)),
        ),
    )


def strict_chunks(text: Column) -> Column:
    """Array of ``{summary, refined_text}`` held in free text, or null."""
    return strict_json(bracketed(text), CLEAN_CHUNKS)

"""Vector arithmetic and feature hashing, row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rostrum.functions.binding import let
from rostrum.limits import VECTOR_WIDTH

FEATURES = "array<struct<bucket:int,tf:int>>"


def width(vector: Column) -> Column:
    return F.size(F.coalesce(vector, F.array().cast("array<float>")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Null when either side has no direction."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(
        F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "), lambda t: t != ""
    )


def token_bucket(token: Column, size: int = VECTOR_WIDTH) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def hashed_features(text: Column, size: int = VECTOR_WIDTH) -> Column:
    """Sparse term counts of a text by hash bucket, buckets ascending.

    Sorting the buckets turns counting into finding where runs start, so a text
    is vectorised within its own row and nothing is shuffled.
    """

    def run_lengths(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda at, j: F.struct(
                    F.get(s, at).alias("bucket"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - at).alias("tf"),
                ),
            ),
        )

    buckets = F.sort_array(F.transform(tokens(text), lambda t: token_bucket(t, size)))
    return let(
        buckets,
        lambda s: F.when(F.size(s) > 0, run_lengths(s)).otherwise(F.array().cast(FEATURES)),
    )


def feature_norm(features: Column) -> Column:
    """L2 norm of sparse counts; exact, since the squares add up as integers."""
    return F.sqrt(
        F.aggregate(
            features,
            F.lit(0).cast("bigint"),
            lambda acc, f: acc + f["tf"].cast("bigint") * f["tf"].cast("bigint"),
        ).cast("double")
    )


def dense(features: Column, size: int = VECTOR_WIDTH) -> Column:
    """Unit vector ``array<float>`` of sparse counts; empty when there are none."""
    return let(
        features,
        lambda f: F.when(
            F.size(f) > 0,
            let(
                F.map_from_entries(f),
                lambda m: let(
                    feature_norm(f),
                    lambda n: F.transform(
                        F.sequence(F.lit(0), F.lit(size - 1)),
                        lambda i: (F.coalesce(F.try_element_at(m, i), F.lit(0)) / n).cast("float"),
                    ),
                ),
            ),
        ).otherwise(F.array().cast("array<float>")),
    )

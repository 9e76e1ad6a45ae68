"""Salts by measured share, and pages opened through a zone index."""

import statistics

import pytest
from pyspark.sql import functions as F

from rostrum.operators import chats, hot_keys
from rostrum.operators.lookup import lookup
from rostrum.sources import zones

PARTS = 16


@pytest.fixture
def split_tasks(spark):
    """Partitions as the shuffle makes them, and no broadcast that Spark chooses itself."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": str(PARTS)}
    usual = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in usual.items():
        spark.conf.set(k, v)


def facts(spark, n=60_000):
    """A third of the rows in one key, a tenth in another, a few without key."""
    key = (F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "warm")
           .when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), F.col("id") % 4999)))
    return spark.range(n).select(F.col("id").alias("i"), key.alias("k"))


def dim(rows):
    known = rows.where("k IS NOT NULL AND k <> 'k5'").select("k").distinct()
    return known.select("k", F.md5("k").alias("v"))


def test_hot_keys_get_salts_by_their_share(spark):
    rows = facts(spark)
    hot = dict(hot_keys.hot_salts(rows, ["k"], PARTS))
    pieces = hot_keys.PIECES * PARTS
    named = {r.h: r.k for r in rows.select(hot_keys.key_hash(["k"]).alias("h"), "k").distinct().collect()}
    by_name = {named[h]: n for h, n in hot.items()}
    assert set(by_name) == {"hot", "warm"}
    assert abs(by_name["hot"] - pieces / 3) <= 2 and by_name["warm"] < by_name["hot"] / 3


def test_even_keys_get_none(spark):
    assert hot_keys.hot_salts(spark.range(5000).withColumnRenamed("id", "k"), ["k"], PARTS) == []
    assert hot_keys.hot_salts(facts(spark).limit(0), ["k"], PARTS) == []


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_lookup_equals_join(spark, how):
    rows = facts(spark, 6000)
    table = dim(rows)
    got = lookup(rows, table, ["k"], "i", how, broadcast_bytes=0, salts=None)
    want = rows.join(table, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_task_has_twice_the_median(spark, split_tasks):
    rows = facts(spark)

    def per_task(salts):
        joined = lookup(rows, dim(rows), ["k"], "i", broadcast_bytes=0, salts=salts)
        counts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        return [r["count"] for r in counts] + [0] * (PARTS - len(counts))

    measured = per_task(None)
    assert sum(measured) == 60_000 and max(measured) <= 2 * statistics.median(measured)
    assert max(per_task(1)) > 4 * statistics.median(per_task(1))  # what it would be without


# ---- pages


def chat_rows(spark, lo=0, hi=3000):
    """One meeting holds a third of the rows."""
    job = F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("m"), F.col("id") % 50))
    return spark.range(lo, hi).select(
        job.alias("job"), F.col("id").alias("n"), F.md5(F.col("id").cast("string")).alias("user_chat"))


def page(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("job, before", [
    ("big", None), ("big", 2000), ("big", 3), ("big", 0), ("m1", 999), ("m7", None), ("none", None), ("big", 10**9)])
def test_a_page_opens_few_files(spark, tmp_path, job, before):
    rows, path = chat_rows(spark), str(tmp_path)
    zones.write_zoned(rows, path, "job", "n", "one", rows_per_file=60)
    total = spark.read.parquet(f"{path}/data").inputFiles()
    opened, _ = zones.page_files(spark, path, "job", job, "n", rows.schema, 5, before)
    assert len(total) >= 50 and len(opened) <= 2
    got = zones.history_page(spark, path, rows.schema, "job", job, "n", 5, before)
    assert page(got) == page(chats.history_page(rows, "job", job, "n", "n", 5, before))
    assert len(got.inputFiles()) == len(opened)


def test_several_writes_and_one_again(spark, tmp_path):
    path, whole = str(tmp_path), chat_rows(spark)
    parts = [whole.where(F.col("n") % 4 == k) for k in range(4)]  # their ids overlap everywhere
    for k, part in [*enumerate(parts), (2, parts[2])]:
        zones.write_zoned(part, path, "job", "n", str(k), rows_per_file=50)
    for before in (None, 1500, 20):
        got = zones.history_page(spark, path, whole.schema, "job", "big", "n", 7, before)
        assert page(got) == page(chats.history_page(whole, "job", "big", "n", "n", 7, before))


def test_rows_without_meeting_or_id_and_ties(spark, tmp_path):
    schema = "job string, n long, user_chat string"
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", 2, "z"), ("a", None, "lost"), (None, 1, "lost")], schema)
    zones.write_zoned(rows, str(tmp_path), "job", "n", "one")
    first = page(zones.history_page(spark, str(tmp_path), rows.schema, "job", "a", "n", 2))
    assert len(first) == 2 and all(r[1] == 2 for r in first)
    assert page(zones.history_page(spark, str(tmp_path), rows.schema, "job", "a", "n", 2)) == first
    assert len(page(zones.history_page(spark, str(tmp_path), rows.schema, "job", "a", "n", 9))) == 4
    zones.write_zoned(rows.limit(0), f"{tmp_path}/empty", "job", "n", "one")
    assert page(zones.history_page(spark, f"{tmp_path}/empty", rows.schema, "job", "a", "n")) == []

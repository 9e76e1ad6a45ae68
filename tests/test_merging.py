"""Keyed merges by copied buckets, and the ledger of keys."""

import glob
import json
import os

import pytest

from rostrum.operators import vector_table
from rostrum.sources import snapshots
from rostrum.sources.sinks import read_batches
from rostrum.streaming import ledger

SCHEMA = "id string, at int, seq int, text string"
ORDER = ["at", "seq"]


def rows(spark, *values):
    return spark.createDataFrame([(None if i is None else str(i), a, s, t) for i, a, s, t in values], SCHEMA)


def read(spark, path, schema, **settings):
    return {r.id: r.text for r in snapshots.read_snapshot(spark, path, schema, **settings).collect()}


def data_files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/*/bucket=*/*.parquet")}


def test_deliveries_merge_like_one_write(spark, tmp_path):
    path = str(tmp_path)
    first = rows(spark, *[(i, 0, 0, f"a{i}") for i in range(60)], (None, 0, 0, "lost"))
    second = rows(spark, (3, 1, 0, "b3"), (70, 0, 0, "b70"), (4, -1, 9, "old"))
    third = rows(spark, (3, 0, 9, "old"), (5, 0, 1, "c5"), (6, None, 7, "null"), (7, 0, 0, "tie"), (7, 0, 0, "tie"))
    versions, kept = [], []
    for part in (first, second, third, third):  # one of them twice
        before = data_files(path)
        versions.append(snapshots.merge_rows(part, path, "id", ORDER, buckets=8))
        assert before.items() <= data_files(path).items()  # files of a version stay
        kept.append(read(spark, path, part.schema))
    assert versions == [1, 2, 3, 4] and kept[2] == kept[3]
    whole = snapshots.last_written(first.unionByName(second).unionByName(third).where("id is not null"), "id", ORDER)
    assert kept[3] == {r.id: r.text for r in whole.collect()}
    assert kept[3]["3"] == "b3" and kept[3]["4"] == "a4" and kept[3]["5"] == "c5" and kept[3]["6"] == "a6"
    assert read(spark, path, first.schema, version=1) == kept[0]


def test_untouched_buckets_are_not_copied(spark, tmp_path):
    path = str(tmp_path)
    snapshots.merge_rows(rows(spark, *[(i, 0, 0, "a") for i in range(100)]), path, "id", ORDER, buckets=16)
    one = snapshots.read_version(spark, path)
    snapshots.merge_rows(rows(spark, (1, 1, 0, "b")), path, "id", ORDER)
    two = snapshots.read_version(spark, path)
    changed = [b for b in one["writes"] if one["writes"][b] != two["writes"][b]]
    assert len(changed) == 1 and len(one["writes"]) == 16


def test_readers_and_writers_apart(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    snapshots.merge_rows(rows(spark, (1, 0, 0, "a")), path, "id", ORDER)
    reader = snapshots.read_snapshot(spark, path, rows(spark, (1, 0, 0, "a")).schema)
    stale = snapshots.read_version(spark, path)
    snapshots.merge_rows(rows(spark, (1, 1, 0, "b")), path, "id", ORDER)
    assert [r.text for r in reader.collect()] == ["a"]
    monkeypatch.setattr(snapshots, "read_version", lambda *_: stale)  # a writer that saw version 1
    with pytest.raises(snapshots.Conflict):
        snapshots.merge_rows(rows(spark, (1, 2, 0, "c")), path, "id", ORDER)
    monkeypatch.undo()
    assert read(spark, path, reader.schema) == {"1": "b"}
    assert json.load(open(f"{path}/versions/2"))["version"] == 2


def test_vacuum_and_rebucket(spark, tmp_path):
    path, schema = str(tmp_path), rows(spark, (1, 0, 0, "a")).schema
    for n in range(4):
        snapshots.merge_rows(rows(spark, *[(i, n, 0, f"{n}") for i in range(0, 40, n + 1)]), path, "id", ORDER, 4)
    want = read(spark, path, schema)
    older = read(spark, path, schema, version=3)
    snapshots.vacuum(spark, path, keep=2)
    assert read(spark, path, schema) == want and read(spark, path, schema, version=3) == older
    assert snapshots.rebucket(spark, path, "id", schema, 9) == 5
    snapshots.vacuum(spark, path, keep=1)
    assert read(spark, path, schema) == want and len(os.listdir(f"{path}/data")) == 1
    assert snapshots.read_version(spark, path)["buckets"] == 9
    assert read(spark, f"{path}/nothing", schema) == {}


def message(n):
    return json.dumps({"jobId": f"j{n % 5}", "fileId": f"f{n}", "metadata": None})


def test_copies_in_later_batches_are_refused(spark, tmp_path):
    path = str(tmp_path)
    deliveries = [range(0, 40), [*range(20, 60), *range(20, 30)], range(0, 60), [60, 1]]
    for part in deliveries:
        spark.createDataFrame([(message(n),) for n in part] + [("{broken",)], "value string").coalesce(1).write.mode(
            "append").text(f"{path}/in")
        ledger.consume_once(spark.readStream.text(f"{path}/in"), f"{path}/out", f"{path}/ck", buckets=4).awaitTermination()
    stored = read_batches(spark, f"{path}/out/accepted")
    assert sorted(r.file_id for r in stored.collect()) == sorted(f"f{n}" for n in range(61))
    per_batch = spark.read.parquet(f"{path}/out/accepted").groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in per_batch} == {0: 40, 1: 20, 3: 1}
    assert read_batches(spark, f"{path}/out/dead").count() == 4


def test_a_batch_may_run_again(spark, tmp_path):
    book = ledger.Ledger(str(tmp_path), ["k"], buckets=4)
    batch = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "k")
    for number, lo, hi in ((0, 0, 30), (1, 20, 50), (1, 20, 50)):
        fresh = book.unseen(batch(lo, hi), number)
        assert sorted(r.k for r in fresh.collect()) == list(range(max(lo, 30 * (number > 0)), hi))
        book.enter(fresh, number)
    assert book._stored(spark, "keys", ledger._KEYS).count() == 50


def test_the_exact_table_is_hardly_asked(spark, tmp_path):
    book = ledger.Ledger(str(tmp_path), ["k"], buckets=2, bits=1 << 16)
    asked = []
    for number in range(3):
        part = spark.range(number * 2000, number * 2000 + 2100).withColumnRenamed("id", "k")  # 100 again
        fresh = book.unseen(part, number, asked)
        assert fresh.count() == 2100 - 100 * (number > 0)
        book.enter(fresh, number)
    assert asked[0] == 0 and all(100 <= n < 180 for n in asked[1:])
    few = ledger.Ledger(str(tmp_path / "few"), ["k"], buckets=1, bits=64)  # a filter that knows everything
    for number in range(2):
        fresh = few.unseen(spark.range(number * 50, number * 50 + 100).withColumnRenamed("id", "k"), number)
        assert fresh.count() == 100 - 50 * number
        few.enter(fresh, number)


def test_a_delivery_is_made_once_and_leaves_nothing_beside(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(i):
        made.add(1)
        return str(i), i, 0, "a"

    delivery = spark.createDataFrame(spark.sparkContext.parallelize(range(30), 3).map(counted), SCHEMA)
    snapshots.merge_rows(delivery, str(tmp_path), "id", ORDER, buckets=4)
    assert made.value == 30 and len(read(spark, str(tmp_path), SCHEMA)) == 30
    assert not os.listdir(tmp_path / "incoming")


def test_stored_vectors_are_made_once_and_stay_where_they_are(spark, capsys):
    texts = spark.createDataFrame([(str(i), i, i, f"word {i}") for i in range(4)],
                                  "id string, upload_timestamp int, seq int, text string")
    points = vector_table.usable(vector_table.embed(texts, "text"))
    points.explain(mode="extended")
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical")[0].count("md5(") == 1
    rows = spark.createDataFrame([("a", 1, 1, 7, [1.0, 0.0]), ("a", 2, 1, 7, [0.0, 0.0]), ("b", 1, 1, 7, [])],
                                 "id string, upload_timestamp int, seq int, job int, vector array<float>")
    latest = vector_table.latest_points(vector_table.measured(rows, "vector", 2), told_by=rows.columns)
    report = vector_table.measured_report(latest, "job", 2)
    want = vector_table.contract_report(vector_table.latest_points(rows), "job", "vector", 2)
    assert list(map(tuple, report.collect())) == list(map(tuple, want.collect()))
    report.explain()
    moved = capsys.readouterr().out
    assert "vector" not in moved.split("Window")[1].split("Exchange")[0]

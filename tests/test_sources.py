"""Files and stored tables: odd archives, documents in small blocks, loads at once, updates, views, layers, streams."""

import io
import json
import random
import threading
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caravan.functions import geo
from caravan.plans import gtfs as gtfs_plan
from caravan.sources import gtfs, layers, osm, store
from caravan.streaming.intervals import streaming_vehicle_flow


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(f"{name}.txt", data)


def test_members_are_read_by_records(spark, tmp_path):
    wide = ",".join(f"x{i}" for i in range(70))
    archive(tmp_path / "a.zip", stops=f'﻿stop_lon, stop_id ,"stop_name",{wide}\r\n1.5,a,"two\r\nlines, ""quoted""",{wide}\r\n\r\n   \r\nx,b,,\r\n2.5,c,"",{wide},one,two\r\n'.encode())
    archive(tmp_path / "b.zip", trips="trip_id\n1\n", stops="")
    archive(tmp_path / "c.zip", stops="stop_id\nd\n" + "\n".join(f"e{i}" for i in range(30_000)))
    got = gtfs.read_member(spark, f"{tmp_path}/*.zip", "stops.txt", "stop_id string, stop_name string, stop_lon double, x69 string, absent int")
    rows = {r.stop_id: tuple(r)[1:] for r in got.collect()}
    assert rows["a"] == ('two\r\nlines, "quoted"', 1.5, "x69", None) and rows["b"] == (None, None, None, None) and rows["c"][1:3] == (2.5, "x69")
    assert rows["d"] == (None,) * 4 and len(rows) == 30_004 - 0
    assert gtfs.read_member(spark, f"{tmp_path}/b.zip", "frequencies.txt").count() == 0


def test_archives_round_trip(spark, tmp_path):
    texts = ['"', '""', ",", "\n", "\r", "\r\n", " a ", "", None, "\\", '\\"', "é", "a,b\n\"c\""]
    frame = spark.createDataFrame([(i, t, i / 7) for i, t in enumerate(texts)], "n long, t string, x double")
    gtfs.write_archives(frame.repartition(3), "odd.txt", f"file://{tmp_path}/odd")
    back = gtfs.read_member(spark, f"file://{tmp_path}/odd/odd-*.zip", "odd.txt", "t string, n long, x double")
    assert sorted((r.n, r.t, r.x) for r in back.collect()) == [(i, t, i / 7) for i, t in enumerate(texts)]


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_documents_in_small_blocks(spark, tmp_path, layout):
    random.seed(5)
    marks = ["}", "{", '"', "\\", "}{", "é", "\\\"}"]
    elements = [{"type": random.choice(["node", "way"]), "id": i, "nodes": list(range(i % 40)), "tags": {"name": "x" * (i % 9) + random.choice(marks) * (i % 4)}} for i in range(300)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"osm3s": {"b": {"c": "}"}}, "elements": elements, "end": {"q": "}]"}}, ensure_ascii=False, **layout))
    keys = {"spark.sql.files.maxPartitionBytes": "250", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = osm.read_documents(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((e["id"], e["type"], e["nodes"], e["tags"]) for e in elements for _ in range(2))
    assert sorted((r.id, r.type, r.nodes, r.tags) for r in got) == want


def test_batches_at_once_and_again(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []

    def load(name, n):
        try:
            store.append_batch(spark.range(n).withColumn("batch_name", F.lit(name)), path, name, ["id"])
        except Exception as e:
            failed.append(e)

    loads = [threading.Thread(target=load, args=(f"b{i}", 10 + i)) for i in range(4)]
    for t in loads:
        t.start()
    for t in loads:
        t.join()
    assert not failed
    load("b2", 12)
    rows = spark.read.parquet(path).collect()
    assert sorted(r.gid for r in rows) == list(range(1, 47)) and {(r.batch_name, r.batch) for r in rows} == {(f"b{i}",) * 2 for i in range(4)}
    assert all([r.id for r in sorted((x for x in rows if x.batch == f"b{i}"), key=lambda r: r.gid)] == list(range(10 + i)) for i in range(4))
    with pytest.raises(ValueError, match="12 rows"):
        store.append_batch(spark.range(5), path, "b2", ["id"])


def files(spark, path):
    return {(r.part, r.f) for r in spark.read.parquet(path).select("part", F.col("_metadata.file_name").alias("f")).distinct().collect()}


def test_updates_leave_other_partitions_alone(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    store.write_partitioned(spark.range(40).select("id", F.lit("old").alias("v"), F.when(F.col("id") < 36, F.col("id") % 4).alias("part")), path, "part")
    before = files(spark, path)
    found = spark.createDataFrame([(5, "b"), (5, "a"), (None, "x"), (99, "x"), (39, None)], "id long, v string")
    assert store.update_from(spark, path, "part", found, "id", ["v"]) == [None, 1]
    after = files(spark, path)
    assert {f for f in before if f[0] in (0, 2, 3)} == {f for f in after if f[0] in (0, 2, 3)} and not {f for f in before & after if f[0] in (1, None)}
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {i: "a" if i == 5 else None if i == 39 else "old" for i in range(40)}
    assert store.update_from(spark, path, "part", found.where("id > 50"), "id", ["v"]) == [] and files(spark, path) == after


def test_views_follow_their_inputs(spark, tmp_path):
    base, made = f"file://{tmp_path}/v", []
    paths = {"a": f"{base}/a", "b": f"{base}/b"}
    for p in paths.values():
        spark.range(3).write.parquet(p)

    def make(name, fn):
        return lambda *dfs: made.append(name) or fn(*dfs)

    views = [store.View("top", ["sum", "b"], make("top", lambda s, b: s.crossJoin(b))), store.View("sum", ["a"], make("sum", lambda a: a.agg(F.sum("id").alias("s"))))]
    assert store.refresh(spark, views, paths, f"{base}/views") == ["sum", "top"] and store.refresh(spark, views, paths, f"{base}/views") == []
    spark.range(2).write.mode("append").parquet(paths["b"])
    assert store.refresh(spark, views, paths, f"{base}/views") == ["top"] and store.read_view(spark, f"{base}/views", "top").count() == 5
    spark.range(10, 11).write.mode("append").parquet(paths["a"])
    assert store.refresh(spark, views, paths, f"{base}/views") == ["sum", "top"] and made == ["sum", "top", "top", "sum", "top"]
    assert {r.s for r in store.read_view(spark, f"{base}/views", "top").collect()} == {13}
    with pytest.raises(ValueError, match="unknown inputs"):
        store.refresh(spark, [store.View("x", ["y"], None)], paths, f"{base}/views")


def test_a_failed_layer_is_tried_again(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/l"
    rows = spark.range(9).select(F.col("id").alias("gid"), F.col("id").cast("double").alias("value"), F.array(geo.point(F.lit(0.0), F.lit(1.0))).alias("line"))
    layers.overwrite_layer(rows, folder, "a/b c")
    tries, whole = [], layers._write

    def once(*given):
        tries.append(given)
        if len(tries) == 1:
            raise OSError("lost")
        return whole(*given)

    monkeypatch.setattr(layers, "_write", once)
    layers.overwrite_layer(rows.where("gid < 2"), folder, "a/b c")
    parts = layers.layer_parts(spark, folder)
    assert len(tries) == 2 and list(parts) == ["a/b c"] and layers.read_geopackages(spark, parts["a/b c"]).count() == 2
    assert len(list((tmp_path / "l").glob("*.gpkg"))) == len(parts["a/b c"])


def test_stream_counts_as_the_table(spark, tmp_path):
    rows = [(i % 3, 100 * (i % 7), f"2024-05-01 0{i % 5}:30:00") for i in range(60)]
    table = spark.createDataFrame(rows, "gid long, timeofday_secs long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{tmp_path}/in")
    intervals = spark.createDataFrame([("a", 0, 300), ("b", 250, 700)], "interval_name string, s long, e long")
    want = sorted(tuple(r) for r in streaming_vehicle_flow(table, intervals).collect())
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = streaming_vehicle_flow(stream, intervals).writeStream.format("memory").queryName("flow").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("flow").collect()) == want and want


def test_a_known_duration_without_a_vehicle_stays(spark):
    rows = spark.createDataFrame([(1, 2, 0, None, 30.0), (1, 2, 0, "bus", 10.0), (1, 2, 1, "bus", None)], "o_id long, d_id long, interval_id long, vehicle_name string, duration double")
    found = {(r.interval_id, r.vehicle_name): r.duration for r in gtfs_plan.estimate_missing_times(rows).collect()}
    assert found == {(0, None): 30.0, (0, "bus"): 10.0, (1, "bus"): 10.0}


def test_zip_is_what_other_tools_read(spark, tmp_path):
    names = gtfs.write_archives(spark.range(3).coalesce(1), "t.txt", f"file://{tmp_path}/z")
    with zipfile.ZipFile(tmp_path / "z" / names[0]) as z:
        assert io.TextIOWrapper(z.open("t.txt")).read().split() == ["id", "0", "1", "2"]


def test_members_are_read_in_small_blocks_and_long_records_whole():
    records = [(str(i), "x" * (3_000_000 if i == 40_001 else 40)) for i in range(60_000)]
    ragged = {i: f"{i}\n" if i % 2 else f"{i},y,z\n" for i in range(100, 60_000, 100)}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m.txt", "a,b\n" + "".join(ragged.get(i, f'{a},"{b}"\n') for i, (a, b) in enumerate(records)))
    batch = pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], ["content"])
    found = list(gtfs._records("m.txt", ["b", "a"])(iter([batch])))
    rows = {a: b for part in found for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)}
    assert sum(part.num_rows for part in found) == len(rows) == 60_000
    assert rows == {a: (None if i % 2 else "y") if i in ragged else b for i, (a, b) in enumerate(records)}
    assert found[0].nbytes < 2 << 20 and found[1].column("a").to_pylist()[0] == "100"

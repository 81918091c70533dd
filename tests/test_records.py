"""Fixed-width records: round trips in many parts, envelopes, nulls, failed and repeated writes."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.sources import records


def tribes(spark, n):
    types = dict(zip(records.Layout.of(records.TRIBES).names, records.Layout.of(records.TRIBES).types, strict=True))
    cols = [(F.col("id") if name == "id" else (F.col("id") % 200).alias(name) if types[name][0] != "f" else (F.col("id") / 4).cast("float").alias(name)) for name in types]
    df = spark.range(n).select(*cols)
    return df.withColumns({"ally": F.when(F.col("id") % 3 > 0, F.col("ally")), "migration": F.when(F.col("id") % 5 > 0, F.col("migration"))})


def test_sizes_of_the_frames_records():
    assert [records.Layout.of(x).dtype().itemsize for x in (records.TRIBES, records.TILES, records.WARS, records.EVENTS)] == [88, 9, 21, 5]
    for bad in ("a", "a:u3", "a:f4?", "a:i4?"):
        with pytest.raises(ValueError):
            records.Layout.of(bad)


def test_round_trip_in_many_parts(spark, tmp_path):
    df, folder = tribes(spark, 1000), str(tmp_path / "tribes")
    manifest = records.write_records(df.repartition(7), folder, records.TRIBES, ["id"], parts=5, envelope="true", tick=77, generation=3)
    assert manifest["records"] == 1000 and manifest["record_bytes"] == 88 and len(manifest["parts"]) > 1
    assert [p["first"] for p in manifest["parts"]] == np.cumsum([0, *(p["records"] for p in manifest["parts"])])[:-1].tolist()
    back = spark.read.format(records.FORMAT).option("slice", 100).load(folder)
    assert back.rdd.getNumPartitions() >= 10
    key = lambda rows: sorted(tuple(r) for r in rows)
    names = records.Layout.of(records.TRIBES).names
    want = [tuple(-1 if x is None else float(x) for x in r) for r in df.select(*names).collect()]
    assert key([tuple(-1 if x is None else float(x) for x in r) for r in back.collect()]) == key(want)
    at = 0
    for p in manifest["parts"]:
        raw = open(os.path.join(folder, p["file"]), "rb").read()
        magic, version, head, kind, _, size, tick, generation, n = struct.unpack_from("<4sHHHHIQII", raw)
        assert (magic, version, head, kind, tick, generation, n) == (b"TNS3", 1, 40, 2, 77, 3, p["records"]) and size == len(raw) - 40 == 88 * n
        if n:
            assert struct.unpack_from("<I", raw, 40)[0] == at
        at += n


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "tiles")
    rows = lambda values: spark.createDataFrame([(k, 1, 2, 0.5, v) for k, v in enumerate(values)], "tile long, biome int, occupants int, food double, disputed int")
    first = records.write_records(rows([0, 1, 0]), folder, records.TILES, ["tile"])
    for broken in (rows([0, 300]), rows([0, None]), rows([-1])):
        with pytest.raises(Exception, match="disputed"):
            records.write_records(broken, folder, records.TILES, ["tile"])
    assert records.read_manifest(folder) == first and sorted(x for x in os.listdir(folder) if x.startswith("part-")) == sorted(p["file"] for p in first["parts"])
    assert spark.read.format(records.FORMAT).load(folder).count() == 3
    again = records.write_records(rows([1]), folder, records.TILES, ["tile"])
    assert sorted(x for x in os.listdir(folder) if x.startswith("part-")) == sorted(p["file"] for p in again["parts"]) and again["records"] == 1
    rows([1, 1]).write.format(records.FORMAT).options(path=folder, layout=records.TILES).mode("append").save()
    assert records.read_manifest(folder)["records"] == 3
    with pytest.raises(Exception, match="another layout"):
        rows([1]).select(F.col("tile").alias("kind"), F.col("biome").alias("tribe")).write.format(records.FORMAT).options(path=folder, layout=records.EVENTS).mode("append").save()


def test_empty_and_absent(spark, tmp_path):
    none = spark.createDataFrame([], "kind int, tribe long")
    assert records.write_records(none, str(tmp_path / "none"), records.EVENTS, ["kind"])["records"] == 0
    assert spark.read.format(records.FORMAT).load(str(tmp_path / "none")).collect() == []
    some = spark.createDataFrame([(1, None), (2, 2**32 - 2)], "kind int, tribe long")
    records.write_records(some, str(tmp_path / "some"), records.EVENTS, ["kind"])
    assert sorted(map(tuple, spark.read.format(records.FORMAT).load(str(tmp_path / "some")).collect()), key=str) == [(1, None), (2, 2**32 - 2)]


def test_graph_buffers_without_the_driver(spark, tmp_path):
    nodes = spark.createDataFrame([(x, float(k), -float(k), k, k, 0, 2 * k) for k, x in enumerate("dbca")], "node string, px double, py double, degree int, ally_degree int, enemy_degree int, support int")
    edges = spark.createDataFrame([("a", "b", 3, "ally"), ("c", "d", 4, "enemy")], "src string, dst string, total long, relation string")
    out = records.write_graph_records(nodes, edges, str(tmp_path))
    assert (out["nodes"]["records"], out["edges"]["records"]) == (4, 2)
    assert [r.node for r in spark.read.parquet(f"{tmp_path}/ids").orderBy("place").collect()] == list("abcd")
    assert sorted(map(tuple, spark.read.format(records.FORMAT).load(f"{tmp_path}/edges").collect())) == [(0, 1, 6), (2, 3, 9)]
    assert {(r.x, r.degree, r.support) for r in spark.read.format(records.FORMAT).load(f"{tmp_path}/nodes").collect()} == {(float(k), k, 2 * k) for k in range(4)}

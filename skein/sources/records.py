"""Fixed-width little-endian records as a data source: a folder of part files and a manifest, written and read by tasks.

    register(spark)
    df.write.format("skein_records").option("layout", "id:u4,food:f4,ally:u4?").mode("overwrite").save(folder)
    spark.read.format("skein_records").load(folder)

A layout names the fields in order with their types: u1 u2 u4 u8, i1 i2 i4 i8, f4 f8; a question mark behind an unsigned one makes its largest value stand for null.  A null elsewhere, or a number that its
field cannot hold, is an error.  Each task writes one part under a new name; the manifest, which says where each part's records begin, is replaced when all are there, so readers see a
whole write or none, and a failed one leaves no part behind.  With the option `envelope` each part begins with a header of a frame (see HEADER) with the options `tick` and `generation`.
The folder must be one that driver and executors share and reach as files.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skein.functions.ranking import position
from skein.session import cut

FORMAT, MANIFEST, SLICE = "skein_records", "_manifest.json", 1 << 16
SQL_TYPES = {"u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}

# The frame header (magic, version, header bytes, kind of payload, flags, payload bytes, tick, generation, records; zeros fill it up), and the records of a frame.
HEADER = struct.Struct("<4sHHHHIQII")
MAGIC, VERSION, KIND, HEADER_BYTES = b"TNS3", 1, 2, 40
TRIBES = (
    "id:u4,tier:u1,role:u1,camp:u2,population:u4,members:u4,food:f4,combat:f4,risk:f4,resource:f4,objective:f4,team:f4,territory:u2,citizens:u4,veterancy:u2,behavior:u1,alive:u1,"
    "fitness:f4,migration:u2?,ally:u4?,out0:f4,out1:f4,out2:f4,out3:f4,out4:f4,out5:f4,out6:f4"
)
TILES = "tile:u2,biome:u1,occupants:u1,food:f4,disputed:u1"
WARS = "war:u4,attacker:u4,defender:u4,start:u8,status:u1"
EVENTS = "kind:u1,tribe:u4?"


@dataclass
class Layout:
    names: list[str]
    types: list[str]
    optional: list[bool]

    @classmethod
    def of(cls, text: str) -> Layout:
        fields = [x.strip().split(":") for x in text.split(",")]
        if any(len(f) != 2 or f[1].rstrip("?") not in SQL_TYPES or (f[1].endswith("?") and f[1][0] != "u") for f in fields):
            raise ValueError(f"not a layout: {text}")
        return cls([f[0] for f in fields], [f[1].rstrip("?") for f in fields], [f[1].endswith("?") for f in fields])

    def dtype(self) -> np.dtype:
        return np.dtype([(n, f"<{t}") for n, t in zip(self.names, self.types, strict=True)])

    def schema(self) -> str:
        return ", ".join(f"`{n}` {SQL_TYPES[t]}" for n, t in zip(self.names, self.types, strict=True))

    def pack(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, self.dtype())
        for name, kind, optional in zip(self.names, self.types, self.optional, strict=True):
            column, target = batch.column(name), np.dtype(f"<{kind}")
            absent = np.iinfo(target).max if optional else None
            if column.null_count and absent is None:
                raise ValueError(f"{name} has a null, and no value that stands for it")
            values = column.fill_null(0).to_numpy(zero_copy_only=False)
            if kind[0] != "f" and len(values) and (values.min() < np.iinfo(target).min or values.max() > np.iinfo(target).max - optional):
                raise ValueError(f"{name} has a value that {kind} cannot hold")
            out[name] = values.astype(target)
            if column.null_count:
                out[name][column.is_null().to_numpy(zero_copy_only=False)] = absent
        return out

    def unpack(self, rows: np.ndarray) -> pa.RecordBatch:
        arrays = []
        for name, kind, optional in zip(self.names, self.types, self.optional, strict=True):
            values = np.ascontiguousarray(rows[name])
            mask = values == np.iinfo(values.dtype).max if optional else None
            wide = {"u1": np.int16, "u2": np.int32, "u4": np.int64, "u8": np.int64}.get(kind, values.dtype.newbyteorder("="))
            arrays.append(pa.array(values.astype(wide), mask=mask))
        return pa.RecordBatch.from_arrays(arrays, self.names)


def read_manifest(folder: str) -> dict:
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        return json.load(f)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    records: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:12]
        self.text = options["layout"]
        self.envelope = str(options.get("envelope", "false")).lower() == "true"
        self.tick, self.generation = int(options.get("tick", 0)), int(options.get("generation", 0))
        Layout.of(self.text)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        layout, task = Layout.of(self.text), TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        file, n = f"part-{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}.rec", 0
        path = os.path.join(self.folder, file)
        try:
            with open(path, "wb") as f:
                f.write(bytes(HEADER_BYTES if self.envelope else 0))
                for batch in iterator:
                    f.write(layout.pack(batch).tobytes())
                    n += batch.num_rows
                if self.envelope:
                    head = HEADER.pack(MAGIC, VERSION, HEADER_BYTES, KIND, 0, n * layout.dtype().itemsize, self.tick, self.generation, n)
                    f.seek(0)
                    f.write(head.ljust(HEADER_BYTES, b"\0"))
        except BaseException:
            if os.path.exists(path):
                os.remove(path)
            raise
        return Written(task.partitionId(), file, n)

    def commit(self, messages: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        before = read_manifest(self.folder) if os.path.exists(os.path.join(self.folder, MANIFEST)) else None
        if before and not self.overwrite and (before["layout"], before["envelope"]) != (self.text, self.envelope):
            raise ValueError("records of another layout are there")
        parts = [] if self.overwrite or not before else before["parts"]
        at = sum(p["records"] for p in parts)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            parts.append({"file": m.file, "first": at, "records": m.records})
            at += m.records
        manifest = {"layout": self.text, "record_bytes": Layout.of(self.text).dtype().itemsize, "envelope": self.envelope, "records": at, "parts": parts}
        fresh = os.path.join(self.folder, f".{MANIFEST}.{self.run}")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.replace(fresh, os.path.join(self.folder, MANIFEST))
        kept = {p["file"] for p in parts}
        for name in os.listdir(self.folder):  # parts of earlier writes, and of attempts that did not count
            if name.startswith("part-") and name not in kept and (self.overwrite or name.startswith(f"part-{self.run}")):
                os.remove(os.path.join(self.folder, name))

    def abort(self, messages: list) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if name.startswith(f"part-{self.run}"):
                os.remove(os.path.join(self.folder, name))


class Slice(InputPartition):
    def __init__(self, file: str, start: int, records: int):
        self.file, self.start, self.records = file, start, records


class Reader(DataSourceReader):
    def __init__(self, folder: str, slice_records: int):
        self.folder, self.slice = folder, slice_records
        self.manifest = read_manifest(folder)

    def partitions(self) -> list[Slice]:
        cuts = [Slice(p["file"], at, min(self.slice, p["records"] - at)) for p in self.manifest["parts"] for at in range(0, p["records"], self.slice)]
        return cuts or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        layout, head = Layout.of(self.manifest["layout"]), HEADER_BYTES if self.manifest["envelope"] else 0
        kind = layout.dtype()
        for at in range(partition.start, partition.start + partition.records, SLICE):
            n = min(SLICE, partition.start + partition.records - at)
            rows = np.fromfile(os.path.join(self.folder, partition.file), kind, n, offset=head + at * kind.itemsize)
            if len(rows) != n:
                raise ValueError(f"{partition.file} is shorter than the manifest says")
            yield layout.unpack(rows)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return Layout.of(read_manifest(self.options["path"])["layout"]).schema()

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("slice", 1 << 22)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


def write_records(rows: DataFrame, folder: str, layout: str, order: list[Column | str], parts: int | None = None, **options) -> dict:
    """Writes rows in an order, in so many parts or as many as a shuffle has, and returns the manifest: record k of the whole stands in the part whose `first` is the last one not above k."""
    register(rows.sparkSession)
    own = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select(*Layout.of(layout).names)
    own.write.format(FORMAT).options(path=folder, layout=layout, **{k: str(v) for k, v in options.items()}).mode("overwrite").save()
    return read_manifest(folder)


NODE_RECORD, EDGE_RECORD = "x:f4,y:f4,degree:u4,ally_degree:u4,enemy_degree:u4,support:u4", "src:u4,dst:u4,packed:u4"


def write_graph_records(nodes: DataFrame, edges: DataFrame, folder: str) -> dict:
    """The buffers of a graph of any size: nodes (node, px, py, degree, ally_degree, enemy_degree, support) by id, and edges (src, dst, total, relation) with the places of their ends and their packed weight
    (bit 0: enemy; the rest: evidence).  ids/ holds the id of each place as Parquet."""
    placed = cut(position(nodes, [F.asc("node")], "place").withColumn("place", F.col("place").cast("long") - 1))
    own = placed.select("place", F.col("px").alias("x"), F.col("py").alias("y"), "degree", "ally_degree", "enemy_degree", "support")
    out = {"nodes": write_records(own, f"{folder}/nodes", NODE_RECORD, ["place"])}
    at = placed.select("node", "place")
    both = edges.join(at.select(F.col("node").alias("src"), F.col("place").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("place").alias("b")), "dst")
    packed = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("total").cast("long") * 2 + (F.col("relation") == "enemy").cast("long")).alias("packed"))
    out["edges"] = write_records(packed, f"{folder}/edges", EDGE_RECORD, ["src", "dst"])
    at.write.mode("overwrite").parquet(f"{folder}/ids")
    return out

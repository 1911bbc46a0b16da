"""Record shards as compressed JSON lines: a Python data source for reading, a sink that hands out references.

Spark's own zstd codec for text isn't in every build, so .jsonl.zst files are read as binary by Spark's file reader (any store
that Spark reads) and unpacked on the executors, a chunk at a time.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEVEL = 9


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped and a missing path gives no rows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_record_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard_id, line_index, record (JSON text), record_hash of every line of the .jsonl.zst files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = name.rsplit("/", 1)[-1].removesuffix(".jsonl.zst")
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data.as_py())), encoding="utf-8")
                held: list[tuple[str, int, str]] = []
                for i, line in enumerate(x for x in reader if x.strip()):
                    held.append((shard, i, line.rstrip("\n")))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["shard_id", "line_index", "record"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["shard_id", "line_index", "record"])

    return files.mapInArrow(lines, "shard_id string, line_index bigint, record string").withColumn("record_hash", F.sha2("record", 256))


def with_record_refs(records: DataFrame, order: list[str], per_shard: int = 1000, record: str = "record") -> DataFrame:
    """records with shard_id, line_index and record_hash; a shard holds the rows of one hash lane in order, so no task numbers all rows."""
    lane = F.pmod(F.xxhash64(*order), F.lit(per_shard))
    w = Window.partitionBy("_lane").orderBy(*order)
    numbered = records.withColumn("_lane", lane).withColumn("line_index", (F.row_number().over(w) - 1).cast("long"))
    return numbered.withColumn("shard_id", F.format_string("record_shard_%04d", "_lane")).withColumn("record_hash", F.sha2(F.col(record), 256)).drop("_lane")


def pack(lines: list[str]) -> bytes:
    """A shard's bytes."""
    return zstandard.ZstdCompressor(level=LEVEL).compress("".join(x + "\n" for x in lines).encode())


def pack_shards(records: DataFrame) -> DataFrame:
    """shard_id and the compressed bytes of every shard: (shard_id, line_index, record) in, one blob a shard out. A shard is bounded by who dealt it."""

    def run(pdf):
        pdf = pdf.sort_values("line_index")
        out = pdf.iloc[:1][["shard_id"]].copy()
        out["content"] = [pack(pdf["record"].tolist())]
        return out

    return records.select("shard_id", "line_index", "record").groupBy("shard_id").applyInPandas(run, "shard_id string, content binary")


class SceneSource(DataSource):
    """Synthetic scene tables: spark.read.format("scenes").option("instances", n).option("seed", s). Rows depend on seed and index only."""

    @classmethod
    def name(cls) -> str:
        return "scenes"

    def schema(self) -> str:
        return "instance_id bigint, row_label string, column string, value bigint"

    def reader(self, schema):  # noqa: ANN001, ANN201  the interface is Spark's
        return _SceneReader(int(self.options.get("instances", 10)), int(self.options.get("seed", 0)), int(self.options.get("partitions", 4)))


class _SceneReader(DataSourceReader):
    def __init__(self, instances: int, seed: int, partitions: int):
        self.instances, self.seed, self.parts = instances, seed, partitions

    def partitions(self) -> list[InputPartition]:
        step = -(-self.instances // self.parts) if self.instances else 1
        return [InputPartition((a, min(a + step, self.instances))) for a in range(0, self.instances, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import random

        for i in range(*partition.value):
            rng = random.Random(f"{self.seed}|scenes|{i}")
            for r in range(rng.randint(5, 10)):
                for c in "ABC":
                    yield i, f"row{r}", c, rng.randint(1, 32)


def dumps(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"))

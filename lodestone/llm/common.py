"""What the training-data operators share: table access, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a worker turns into Python objects at a time.
SLICE = 512

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str, keep: bool = True) -> str:
    """A fresh folder below spark.checkpoint.dir, which a cluster must set; where all runs on this machine, below one of our own.

    keep: false for steps of a computation, which are deleted when the application ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own.setdefault("dir", "")
        if not base:
            base = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not keep:
        system.mkdirs(path)
        system.deleteOnExit(path)
    full = system.makeQualified(path).toString()  # also other readers must find it
    return full if "://" in full else full.replace(":/", ":///", 1)


def materialise(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name, keep)
    df.write.mode("append").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(step: DataFrame) -> None:
    """Deletes the folder of a materialised step that no later step reads."""
    files = step.inputFiles()
    if files:
        spark = step.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, size: int = SLICE):
    """Record batches in pieces of at most size rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def kept_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows of docs for whose texts decide(list of texts) says so, with all their columns; narrow, no join."""

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([bool(x) for x in decide(texts_of(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


_held: dict = {}


def held(key, make):
    """What make() gives, kept by the worker until another key is asked for: one operator's caches at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]

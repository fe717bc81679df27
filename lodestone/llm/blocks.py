"""Documents cut into blocks of bounded text that several passes read in the same way without shuffling them again.

The table is bucketed by block in the shared folder, so grouping it with answers by block moves only the answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path

#: Characters of a block, about; a longer text is a block of its own.
BLOCK_CHARS = 16_000_000


def fresh(name: str) -> str:
    """A table name that no other step has."""
    return f"lodestone_{name}_{uuid.uuid4().hex}"


def bucketed(df: DataFrame, table: str, key: str = "block", more: bool = False) -> DataFrame:
    """df as a table in the shared folder, bucketed by key into as many buckets as the session has shuffle partitions. more: rows for the table that is there."""
    spark = df.sparkSession
    rows = df.write.format("parquet").mode("append").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("compression", "zstd")
    (rows if more else rows.option("path", shared_path(spark, table, keep=False))).saveAsTable(table)
    return spark.table(table)


def numbered(sizes: np.ndarray, held: int, most: int) -> tuple[np.ndarray, int]:
    """How many blocks end before each row, of rows of these sizes that follow `held` characters; the characters of the open block."""
    out, n = np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            n, held = n + 1, 0
        out[i] = n
        held += size
    return out, held


def blocks(docs: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) as a stored table (block, doc_id, text); a task's rows are cut where a block has `most` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64)
            own, held = numbered(sizes, held, most)
            yield pa.RecordBatch.from_arrays([pa.array(block + own), batch.column("doc_id"), batch.column("text")], names=["block", "doc_id", "text"])
            block += int(own[-1]) if len(own) else 0

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return bucketed(rows.mapInArrow(run, "block long, doc_id long, text string"), fresh("blocks"))


def parts_of(table: pa.Table, column: str, kind) -> np.ndarray:
    """The binary values of a column as one array."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)

"""Index maintenance: add, replace, remove and size, in batches or from a stream (the stream is this engine's own extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.functions.steps import written
from lodestone.operators.search import chunk_terms, postings


def last_writes(batch: DataFrame, sequence: str = "seq") -> DataFrame:
    """Of rows with one document_id those of its last write."""
    w = Window.partitionBy("document_id").orderBy(F.col(sequence).desc())
    return batch.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def upsert(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The index with all chunks of the batch's documents replaced by the batch's."""
    return index.join(batch.select("document_id").distinct(), "document_id", "left_anti").unionByName(batch)


def remove(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def removal_report(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document asked for: whether it was there."""
    there = index.select("document_id").distinct().withColumn("existed", F.lit(True))
    return documents.select("document_id").distinct().join(there, "document_id", "left").select("document_id", F.coalesce("existed", F.lit(False)).alias("existed"))


def size(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n_chunks"))


#: Parts into which an index is cut by a hash of the document's id.
PARTS = 256


def write_parts(index: DataFrame, index_path: str, epoch: int, parts: int = PARTS) -> None:
    """Writes an index, or some parts of one, as of an epoch: <index_path>/part=p/epoch=e."""
    placed = index.withColumns({"part": F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int"), "epoch": F.lit(epoch)})
    placed.repartition("part").write.mode("append").partitionBy("part", "epoch").parquet(index_path)


def read_index(spark: SparkSession, index_path: str, schema, until: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The index as of the last epoch (or of the last one up to until): of each part its latest epoch. parts: those to read, by their folders."""
    full = StructType([*schema.fields, StructField("part", IntegerType()), StructField("epoch", IntegerType())])
    every = spark.read.schema(full).parquet(index_path)
    if until is not None:
        every = every.filter(F.col("epoch") <= until)
    if parts is not None:
        every = every.filter(F.col("part").isin(parts))
    latest = every.groupBy("part").agg(F.max("epoch").alias("epoch"))  # a row a part
    return every.join(F.broadcast(latest), ["part", "epoch"]).select(*[f.name for f in schema.fields])


def statistics(chunks: DataFrame, sign: int = 1) -> DataFrame:
    """chunks(text) as (term, df, chunks, length): a row a term with its chunks, and one without a term with all chunks and tokens; sign -1 takes them away."""
    terms = chunk_terms(chunks.select(F.monotonically_increasing_id().alias("_key"), "text"), "_key")
    per_term = postings(terms, "_key").groupBy("term").agg((F.count("*") * sign).alias("df")).select("term", "df", F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("length"))
    whole = terms.agg((F.count("*") * sign).alias("chunks"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("length")).select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df"), "chunks", "length")
    return per_term.unionByName(whole)


STATISTICS = "term string, df long, chunks long, length long"


def folded(deltas: DataFrame) -> DataFrame:
    """Sums of statistics() rows; terms that no chunk has any more are gone."""
    sums = deltas.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "chunks", "length")])
    return sums.filter("df <> 0 or term is null")


def read_statistics(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The statistics as of an epoch: the last compacted ones and all changes since."""
    every = spark.read.schema(f"{STATISTICS}, base boolean, epoch int").parquet(path)
    if until is not None:
        every = every.filter(F.col("epoch") <= until)
    base = every.filter("base").agg(F.coalesce(F.max("epoch"), F.lit(-1)).alias("at"))  # one row
    return folded(every.join(F.broadcast(base), (F.col("base") & (F.col("epoch") == F.col("at"))) | (~F.col("base") & (F.col("epoch") > F.col("at")))).select("term", "df", "chunks", "length"))


#: Micro-batches whose changes of the statistics are kept apart before they are summed into a new base.
COMPACT = 32


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs of a part, by the names of its folders."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    return sorted(int(x.getPath().getName()[6:]) for x in system.listStatus(target) if x.getPath().getName().startswith("epoch="))


def _count(spark: SparkSession, path: str, epoch: int, gone: DataFrame, new: DataFrame) -> None:
    """Writes an epoch's changes, and from time to time all up to it as a base."""
    write = lambda df, base: df.coalesce(1).write.mode("overwrite").parquet(f"{path}/base={str(base).lower()}/epoch={epoch}")
    write(folded(statistics(gone, -1).unionByName(statistics(new))), False)
    if epoch % COMPACT == 0:
        write(written(read_statistics(spark, path, epoch)), True)


def maintain(stream: DataFrame, index_path: str, checkpoint: str, parts: int = PARTS, statistics_path: str | None = None):
    """A streaming query that upserts each micro-batch into the index under index_path, whose parts write_parts has cut.

    Only the parts that hold the batch's documents are read, by their folders, and written anew; upserting never empties a
    part. Of each part the latest epoch and the one before, which readers may be at, stay. An epoch that is run again writes
    over what it had written. statistics_path: where document frequencies, chunks and lengths are kept with the index, as
    changes of each epoch by the chunks (with a text) that come and go.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = last_writes(batch).drop("seq").persist()
        try:
            touched = [r[0] for r in new.select(F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int")).distinct().collect()]  # at most parts numbers
            if not touched:
                return
            for part in touched:  # left over from an attempt that did not end
                _delete(spark, f"{index_path}/part={part}/epoch={epoch + 1}")
            merged, there = new, [p for p in touched if _epochs(spark, f"{index_path}/part={p}")]
            gone = new.limit(0)
            if there:
                before = read_index(spark, index_path, new.schema, epoch, there)
                merged = upsert(before, new)
                gone = before.join(new.select("document_id").distinct(), "document_id", "left_semi")
            if statistics_path:
                _count(spark, statistics_path, epoch + 1, gone, new)
            write_parts(merged, index_path, epoch + 1, parts)
            for part in touched:
                for old in _epochs(spark, f"{index_path}/part={part}")[:-2]:
                    _delete(spark, f"{index_path}/part={part}/epoch={old}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)

"""Source manifests, snapshots, the document repository and request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hosts and fields that a manifest must have.
OFFICIAL_HOST, ACQUISITION_HOST, IDENTIFIER_HOST = "eur-lex.europa.eu", "publications.europa.eu", "data.europa.eu"
REQUIRED = ["id", "short_title", "celex", "eli", "official_url", "acquisition_url", "jurisdiction", "document_type"]
MAX_BYTES = 25 * 1024 * 1024
#: Upper bounds of latency buckets in seconds (the usual client defaults).
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def manifest_violations(sources: DataFrame) -> DataFrame:
    """(id, rule) for every rule that a source of the manifest breaks."""
    many = lambda c: F.count(c).over(Window.partitionBy(c)) > 1
    url = lambda c, part: F.try_parse_url(F.col(c), F.lit(part))
    official = (url("official_url", "PROTOCOL") == "https") & (url("official_url", "HOST") == OFFICIAL_HOST)
    acquired = (url("acquisition_url", "PROTOCOL") == "https") & (url("acquisition_url", "HOST") == ACQUISITION_HOST) & url("acquisition_url", "PATH").startswith("/resource/celex/")
    eli = (url("eli", "PROTOCOL") == "http") & (url("eli", "HOST") == IDENTIFIER_HOST)
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "missing_field": sum((F.col(c).isNull().cast("int") for c in REQUIRED), F.lit(0)) > 0,
        "duplicate_id": many("id"),
        "duplicate_celex": many("celex"),
        "official_url_host": ~holds(official),
        "acquisition_url_host": ~holds(acquired),
        "official_url_celex": ~holds(F.contains("official_url", F.concat(F.lit("CELEX:"), F.col("celex")))),
        "acquisition_url_celex": ~holds(F.endswith("acquisition_url", F.concat(F.lit("/resource/celex/"), F.col("celex")))),
        "eli_host": ~holds(eli),
    }
    broken = sources.select("id", F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()])).alias("rules"))
    return broken.select("id", F.explode("rules").alias("rule"))


def manifest_errors(manifest: dict) -> list[str]:
    """What is wrong with a manifest as a whole; its sources are manifest_violations' matter."""
    about = manifest.get("corpus") or {}
    rules = {
        "schema_version": manifest.get("schema_version") != "1.0",
        "provenance_policy": not about.get("provenance_policy"),
        "rights_notice_url": not about.get("rights_notice_url"),
        "sources": not isinstance(manifest.get("sources"), list) or not manifest["sources"],
    }
    return [rule for rule, broken in rules.items() if broken]


def acquired(responses: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fetched sources as provenance rows: source_id, celex, eli, eur_lex_url, requested_url, resolved_url, retrieved_at,
    content_type, file, bytes, sha256, and the first rule broken, if any.

    responses(id, celex, eli, official_url, acquisition_url, resolved_url, status, content_type, retrieved_at, content) come from
    any fetcher; content is binary.
    """
    where = lambda c, part: F.try_parse_url(F.col(c), F.lit(part))
    ours = lambda c: (where(c, "PROTOCOL") == "https") & (where(c, "HOST") == ACQUISITION_HOST)
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"^[ \t\n\x0B\f\r]+", "")
    head = F.lower(F.substring(text, 1, 100))
    path = where("resolved_url", "PATH")
    rules = [
        ("requested_url", ~(ours("acquisition_url") & where("acquisition_url", "PATH").startswith("/resource/celex/"))),
        ("resolved_url", ~(ours("resolved_url") & (path.startswith("/resource/celex/") | path.startswith("/resource/cellar/")))),
        ("status", F.col("status") != 200),
        ("content_type", ~kind.isin("text/html", "application/xhtml+xml")),
        ("too_large", F.octet_length("content") > max_bytes),
        ("empty", text == ""),
        ("no_markup", ~(head.startswith("<?xml") | head.contains("<html"))),
    ]
    broken = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules])
    at = F.date_format(F.to_utc_timestamp("retrieved_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return responses.select(
        F.col("id").alias("source_id"), "celex", "eli", F.col("official_url").alias("eur_lex_url"), F.col("acquisition_url").alias("requested_url"), "resolved_url",
        at.alias("retrieved_at"), kind.alias("content_type"), F.concat("id", F.lit(".html")).alias("file"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), broken.alias("rule"),
    )


def snapshot_violations(files: DataFrame) -> DataFrame:
    """files(path, content) as the binaryFile source gives them: path, bytes, sha256, and the first rule broken, if any."""
    head = F.lower(F.decode(F.substring("content", 1, 100), "ISO-8859-1"))
    size = F.octet_length("content")
    rule = F.when(size == 0, "empty").when(size > MAX_BYTES, "too_large").when(~(head.contains("<html") | head.contains("<!doctype html") | head.contains("<?xml")), "no_markup")
    return files.select("path", size.alias("bytes"), F.sha2("content", 256).alias("sha256"), rule.alias("rule"))


def load_json(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """A JSON document as one row; an error if a required field is missing."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"dataset is missing required fields: {', '.join(sorted(missing))}")
    return df


def write_documents(docs: DataFrame, path: str) -> None:
    """Appends documents with a regulator column, partitioned by it."""
    docs.write.mode("append").partitionBy("regulator").parquet(path)


def write_repository(docs: DataFrame, sections: DataFrame, path: str) -> None:
    """Appends documents(document_id, external_id, version, regulator, ...) and their sections(document_id, reference, position, ...).

    Nothing is written if a document (regulator, external_id, version) or a reference within a document is there twice, in the
    batch or with what is stored, or if a section has no document in the batch. Both tables are partitioned by regulator.
    """
    spark, keys = docs.sparkSession, ["regulator", "external_id", "version"]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    stored = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    every = docs.select(*keys).unionByName(spark.read.parquet(f"{path}/documents").select(*keys)) if stored else docs.select(*keys)
    faults = {
        "documents that are there twice": every.groupBy(*keys).count().filter("count > 1"),
        "references that are there twice": sections.groupBy("document_id", "reference").count().filter("count > 1"),
        "sections without a document": sections.join(docs.select("document_id"), "document_id", "left_anti"),
    }
    if found := [name for name, df in faults.items() if not df.isEmpty()]:
        raise ValueError(", ".join(found))
    write_documents(docs, f"{path}/documents")
    sections.join(docs.select("document_id", "regulator"), "document_id").write.mode("append").partitionBy("regulator").parquet(f"{path}/sections")


def look_up(documents: DataFrame, sections: DataFrame, external_id: str, version: str) -> DataFrame:
    """A document with its sections in order of position; filters reach the scan."""
    d = documents.filter((F.col("external_id") == external_id) & (F.col("version") == version))
    return d.join(sections, "document_id").orderBy("position")


def request_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("method", "path", "status").agg(F.count("*").alias("requests"))


def latency_histogram(events: DataFrame) -> DataFrame:
    """Cumulative counts by bucket for each (method, path), one aggregate over the events."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)] + [F.count("*").alias(f"b{len(BUCKETS)}")]
    wide = events.groupBy("method", "path").agg(*counts)
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("observations")) for i, b in enumerate([*BUCKETS, "+Inf"])]
    return wide.select("method", "path", F.inline(F.array(*cells)))

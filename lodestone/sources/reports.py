"""Settings, canonical JSON, report and provenance sinks, audit events."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    minimum_query_coverage: float = 0.6
    max_results: int = 5
    embedding_dimensions: int = 768

    def __post_init__(self):
        if not 0 <= self.minimum_query_coverage <= 1:
            raise ValueError("minimum_query_coverage must be between 0 and 1")
        if not 1 <= self.max_results <= 50:
            raise ValueError("max_results must be between 1 and 50")
        if not 128 <= self.embedding_dimensions <= 3072:
            raise ValueError("embedding_dimensions must be between 128 and 3072")

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Settings from spark.lodestone.* where those are set."""
        found = {n: spark.conf.get(f"spark.lodestone.{n}", None) for n in cls.__dataclass_fields__}
        kinds = {n: type(getattr(cls, n)) for n in found}
        return cls(**{n: kinds[n](v) for n, v in found.items() if v is not None})


def canonical_json(value) -> bytes:
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def sidecar_errors(data, manifest: dict, counts: dict, name: str) -> list[str]:
    """What a manifest beside a dataset says wrongly about its name, checksum and counts."""
    said = {"filename": name, "sha256": sha256_json(data), "counts": counts}
    return [k for k, v in said.items() if manifest.get(k) != v]


def write_report(report: dict, json_path: str, markdown_path: str | None = None) -> None:
    """A report is a few numbers: it is written by the driver."""
    Path(json_path).parent.mkdir(parents=True, exist_ok=True)
    Path(json_path).write_bytes(canonical_json(report))
    if markdown_path:
        Path(markdown_path).write_text(render_markdown(report))


def _row(metrics: dict, level: str) -> str:
    """A line of the table: shares with their intervals, counts."""
    r, c, v = metrics["retrieval"], metrics["change_detection"], metrics["reviewer_classification"]

    def share(value: float, interval: dict | None) -> str:
        return f"{value:.1%}" + (f" ({interval['lower']:.1%} to {interval['upper']:.1%})" if interval else "")

    recall, mrr = (share(r[m], r["confidence_intervals"][m]) for m in ("recall_at_k", "mean_reciprocal_rank"))
    accuracy = share(v["accuracy"], v["confidence_intervals"]["accuracy"])
    return f"| {level} | {r['evaluated_cases']} | {recall} | {mrr} | {c['passed']} of {c['evaluated_cases']} | {v['evaluated_cases']} | {accuracy} |"


def render_markdown(report: dict) -> str:
    """A report of either version: of the second with strata and intervals, of the first its flat numbers."""
    if "benchmark" in report:
        about, summary = report["benchmark"], report["summary"]
        k = summary["retrieval"]["k"]
        out = [f"# Evaluation of {about['dataset']} {about['version']}", "", f"Split: {about['split']}. Intervals: 95 %, {about['bootstrap']['samples']} resamples, seed {about['bootstrap']['seed']}.", ""]
        out += [f"| Cases | Queries | Recall at {k} | MRR | Changes passed | Claims | Review accuracy |", "|-|-|-|-|-|-|-|", _row(summary, "all"), *(_row(m, level) for level, m in summary["by_difficulty"].items()), ""]
        if judge := summary.get("judge"):
            out += ["## Judge (advisory)", "", "| Metric | Value |", "|-|-|", *(f"| {m} | {x} |" for m, x in sorted(judge.items()) if m != "advisory"), ""]
        return "\n".join(out)
    out = [f"# Evaluation of {report.get('dataset', '')} {report.get('version', '')}".rstrip(), ""]
    for section, values in sorted(report.items()):
        if isinstance(values, dict):
            flat = {k: v for k, v in sorted(values.items()) if not isinstance(v, (dict, list))}
            if flat:
                out += [f"## {section.capitalize()}", "", "| Metric | Value |", "|-|-|", *(f"| {k} | {v} |" for k, v in flat.items()), ""]
    return "\n".join(out)


def find_report(candidates: list[str]) -> dict:
    """The first candidate that is a JSON object; else one that says that none is available."""
    for path in candidates:
        try:
            found = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            return found | {"available": True}
    return {"available": False}


def write_provenance(snapshots: DataFrame, manifest_sha256: str, path: str) -> None:
    """Snapshot rows with the manifest's digest and the time of writing, as JSON lines."""
    snapshots.withColumns({"manifest_sha256": F.lit(manifest_sha256), "generated_at": F.current_timestamp()}).write.mode("overwrite").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """events(actor, action, request_id, payload as JSON), stamped, appended by day."""
    events.withColumn("occurred_at", F.current_timestamp()).withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def embedding_cache_key(text, task: str, title, model: str, dimensions: int):
    """Content address of an embedding request."""
    return F.sha2(F.concat_ws("\u001f", F.lit(model), F.lit(task), F.lit(str(dimensions)), F.coalesce(title, F.lit("")), text), 256)

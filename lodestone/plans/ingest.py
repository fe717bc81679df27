"""From raw requests to chunks: checks, sanitizing, parsing by content type, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import sanitize, structure

METADATA = ("title", "document_type", "jurisdiction", "published_at")


def _checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def requests(raw: DataFrame) -> DataFrame:
    """raw(source, content[, content_type, title, document_type, jurisdiction, published_at, attributes]) with all columns, checked.

    White space around every string is dropped. A blank source, blank content, or a content type other than text and html is an
    error; no content type is text; attributes stand in order of their keys.
    """
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    have = set(raw.columns)
    out = raw.withColumns({c: bare(F.col(c)) if c in have else F.lit(None).cast("string") for c in METADATA})
    kind = F.coalesce(bare(F.col("content_type")), F.lit("text")) if "content_type" in have else F.lit("text")
    attributes = F.col("attributes") if "attributes" in have else F.lit(None).cast("map<string,string>")
    attributes = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(attributes, F.create_map().cast("map<string,string>")))))
    source, content = bare(F.col("source")), bare(F.col("content"))
    return out.withColumns(
        {
            "source": _checked(source, source != "", "source must not be blank"),
            "content": _checked(content, content != "", "content must not be blank"),
            "content_type": _checked(kind, kind.isin("text", "html"), "unsupported content_type"),
            "attributes": attributes,
        }
    )


def parsed(raw: DataFrame) -> DataFrame:
    """Checked requests with sanitized content in place of their own, its blocks, and the page's title where the caller gives none."""
    clean = sanitize.sanitize(requests(raw), "content").withColumn("content", F.col("sanitized")).drop("sanitized")
    page = F.col("content_type") == "html"
    text, html = F.when(~page, F.col("content")), F.when(page, F.col("content"))  # each parser sees its own rows only
    return clean.withColumns({"title": F.coalesce("title", structure.html_title(html)), "blocks": F.coalesce(structure.text_blocks(text), structure.html_blocks(html))})


def ingest(raw: DataFrame) -> DataFrame:
    """One row a chunk, with the document's metadata and what sanitizing has found."""
    return structure.chunks(parsed(raw).drop("content"))


def responses(raw: DataFrame) -> DataFrame:
    """One row a request: document_id, chunks_indexed, injection_suspected, redacted_categories; other columns stay."""
    p = parsed(raw)
    texts = F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: t != "")
    n = F.size(F.filter("blocks", lambda b: (b["kind"] == "paragraph") & (b["text"] != "")))
    found = p.withColumns({"document_id": structure.document_id(F.col("source"), texts), "chunks_indexed": n.cast("long")})
    return found.withColumnRenamed("detected_categories", "redacted_categories").drop("blocks", "content")

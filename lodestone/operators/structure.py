"""Structural parsing: text and HTML to blocks, blocks to chunks with heading paths."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions.text import stable_id

#: White space of any kind, the four separators among control characters too, under (?U). Under (?d) only \n ends a line.
SPACE = r"[\s\x1C-\x1F]"
#: Line forms. Letters in both cases, as a range of one case misses the Kelvin sign and the dotted I.
ARTICLE = rf"(?diU)^((?:article|art\.){SPACE}+[A-Za-z0-9][A-Za-z0-9.\-]*)(?:{SPACE}*[-:–—]{SPACE}*(.*))?$"
HEADING = rf"(?dU)^(#{{1,6}}){SPACE}+(.+?){SPACE}*#*{SPACE}*$"
NUMBERED = rf"(?diU)^(?:\d+(?:\.\d+)*|[IVXLCDMivxlcdm]+)[.)]?{SPACE}+[^\s\x1C-\x1F]+"
#: What stands in a tag before its end: a quoted value behind an equals sign may hold a >.
ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
#: What ends a line inside a block, what ends a block, and what counts as white space at the ends of a line.
LINE_END = r"[\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"
BLOCK_END = r"(?U)\n[\s\x1C-\x1F]*\n"
SPACE_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
BLOCK_TAGS = r"(?:title|p|li|blockquote|td|th|h[1-6])"


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def inline(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"[ \t\f\x0B]+", " "))


def _decoder(times: int):
    """Lists of texts with all character references decoded (so often), white space as inline leaves it."""

    def decode(text: str) -> str:
        for _ in range(times):
            text = unescape(text)
        return re.sub(r"[ \t\f\v]+", " ", text).strip()

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [decode(t) if "&" in t else t for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, ArrayType(StringType()))


def _decoded(parts: Column, source: Column, times: int) -> Column:
    """Structs with their text decoded; only rows whose source has an ampersand go through Python."""
    texts = F.when(F.contains(source, F.lit("&")), F.transform(parts, lambda p: p["text"]))
    decoded = _decoder(times)(texts)
    return F.when(decoded.isNull(), parts).otherwise(F.zip_with(parts, decoded, lambda p, t: p.withField("text", t)))


def _block(kind: str, text: Column, level: Column | int = 0) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), level.cast("int").alias("level"))


def _text_block(lines: Column) -> Column:
    """Blocks of one group of lines."""
    first, joined = lines[0], inline(F.array_join(lines, " "))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    body = F.regexp_extract(first, ARTICLE, 2)
    heading = F.array_compact(
        F.array(
            _block("heading", inline(F.regexp_extract(first, HEADING, 2)), F.length(F.regexp_extract(first, HEADING, 1))),
            F.when(F.size(lines) > 1, _block("paragraph", inline(F.array_join(rest, " ")))),
        )
    )
    article = F.array_compact(
        F.array(
            _block("article", inline(F.regexp_extract(first, ARTICLE, 1))),
            F.when((body != "") | (F.size(lines) > 1), _block("paragraph", inline(F.array_join(F.concat(F.array(body), rest), " ")))),
        )
    )
    shouted = (F.size(F.split(first, rf"(?U){SPACE}+")) <= 10) & (F.upper(first) == first) & (F.lower(first) != first)
    looks = (F.size(lines) == 1) & (first.rlike(NUMBERED) | shouted)
    return F.when(first.rlike(HEADING), heading).when(first.rlike(ARTICLE), article).when(looks, F.array(_block("heading", joined, 2))).otherwise(F.array(_block("paragraph", joined)))


def text_blocks(content: Column) -> Column:
    groups = F.transform(F.split(F.regexp_replace(content, r"\r\n?", "\n"), BLOCK_END), lambda g: F.filter(F.transform(F.split(g, LINE_END), stripped), lambda x: x != ""))
    return _decoded(F.flatten(F.transform(F.filter(groups, lambda g: F.size(g) > 0), _text_block)), content, 1)


def html_parts(html: Column) -> Column:
    """(tag, text) of each block of the page with text, titles included; a block ends at its own end tag or the next block."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->", ""), r"(?is)<(script|style|noscript)\b.*?(?:</\1\s*>|\z)", "")
    found = F.regexp_extract_all(bare, F.lit(rf"(?is)<{BLOCK_TAGS}(?:[\s/]{ATTRIBUTES})?>(?:(?!<{BLOCK_TAGS}[\s/>]).)*+"), F.lit(0))

    def part(raw: Column) -> Column:
        tag = F.lower(F.regexp_extract(raw, r"^<(\w+)", 1))
        inner = F.regexp_replace(raw, rf"(?is)^<(\w+){ATTRIBUTES}>(.*?)(?:</\1\s*>.*)?$", "$2")
        lines = F.regexp_replace(F.regexp_replace(inner, rf"(?i)<br(?:[\s/]{ATTRIBUTES})?>", " \n "), rf"(?s)</?[a-zA-Z!?]{ATTRIBUTES}>", " ")
        closed = F.endswith(F.regexp_extract(raw, rf"(?is)^(<\w+{ATTRIBUTES}>)", 1), F.lit("/>"))  # such a tag is its own end
        return F.struct(tag.alias("tag"), F.when(closed, "").otherwise(inline(lines)).alias("text"))

    # once as a parser of pages does, once as every text
    return F.filter(_decoded(F.transform(found, part), html, 2), lambda p: p["text"] != "")


def html_title(html: Column) -> Column:
    titles = F.filter(html_parts(html), lambda p: p["tag"] == "title")
    return F.try_element_at(F.transform(titles, lambda p: p["text"]), F.lit(-1))


def html_blocks(html: Column) -> Column:
    def blocks(p: Column) -> Column:
        t, body = p["text"], F.regexp_extract(p["text"], ARTICLE, 2)
        article = F.array_compact(F.array(_block("article", F.regexp_extract(t, ARTICLE, 1)), F.when(body != "", _block("paragraph", body))))
        level = F.when(p["tag"].rlike("^h[1-6]$"), F.substring(p["tag"], 2, 1).cast("int"))
        return F.when(level.isNotNull(), F.array(_block("heading", t, level))).when(t.rlike(ARTICLE), article).otherwise(F.array(_block("paragraph", t)))

    return F.flatten(F.transform(F.filter(html_parts(html), lambda p: p["tag"] != "title"), blocks))


def document_id(source: Column, texts: Column) -> Column:
    """Of a document by its source and the texts of its blocks."""
    return stable_id(source, F.array_join(texts, "\n\n"))


#: Heading levels, and so the entries of a heading path, at most.
LEVELS = 6


def chunks(df: DataFrame, blocks: str = "blocks", source: str = "source") -> DataFrame:
    """One row a paragraph of df(source, blocks): ids, ordinal, text, heading_path, article, citation.

    The heading stack is positional: a heading of level n keeps the first n - 1 entries, whatever their levels, so after the h-th
    heading it has min(h, n_j + h - h_j over headings j so far) entries, and entry p is the last heading that made it p long.
    Both are running values over a document's blocks as rows, which stream however many they are.
    """
    nonempty = F.filter(F.col(blocks), lambda b: b["text"] != "")
    texts = F.transform(nonempty, lambda b: b["text"])
    placed = df.withColumns({"document_id": document_id(F.col(source), texts), "_blocks": nonempty, "_id": F.monotonically_increasing_id()}).drop(blocks)
    rows = placed.select("*", F.posexplode("_blocks").alias("_pos", "_b")).drop("_blocks")
    so_far = Window.partitionBy("_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, text = F.col("_b.kind"), F.col("_b.text")
    heading = kind == "heading"
    rows = rows.withColumn("_headings", F.count_if(heading).over(so_far))
    rows = rows.withColumn("_depth", F.col("_headings") + F.least(F.lit(0), F.coalesce(F.min(F.when(heading, F.col("_b.level") - F.col("_headings"))).over(so_far), F.lit(0))))
    last = lambda value: F.last(value, ignorenulls=True).over(so_far)
    entries = [F.when(F.col("_depth") >= p, last(F.when(heading & (F.col("_depth") == p), text))) for p in range(1, LEVELS + 1)]
    rows = rows.withColumns(
        {
            "heading_path": F.array_compact(F.array(*entries)),
            "article": F.nullif(last(F.when(heading, F.lit("")).when(kind == "article", text)), F.lit("")),
            "ordinal": (F.count_if(kind == "paragraph").over(so_far) - 1).cast("int"),
            "text": text,
        }
    )
    out = rows.filter(kind == "paragraph").drop("_id", "_pos", "_b", "_headings", "_depth")
    cited = F.when(F.col("article").isNotNull() & ~F.array_contains("heading_path", F.col("article")), F.array("article")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"chunk_id": stable_id(F.col("document_id"), F.col("ordinal"), F.col("text")), "citation": F.array_join(F.concat(F.array(F.col(source)), F.col("heading_path"), cited), " > ")})

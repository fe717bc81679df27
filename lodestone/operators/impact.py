"""Impact mapping: changed text against candidates by shared concepts, counted where the changes are read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone.functions.steps import written
from lodestone.functions.text import concepts, digest
from lodestone.operators.diff import change_id, source_id

#: Concepts of a block of changes and of a block of candidates, about; pairs and shared concepts that are counted at once.
CHANGES, CANDIDATES, COUNTED = 1 << 18, 1 << 14, 1 << 22
#: Candidates of up to so many concepts are sent to all tasks; beyond that changes are written, and blocks of both are paired.
SENT = 1 << 20
#: Candidates' sources of up to so many characters are sent to all tasks.
SENT_SOURCES = 1 << 25
#: What a citation has of a section.
CITED = ("document_id", "section_id", "text", "page", "version")


def _cuts(sizes, most: int):
    """Ranges of rows whose sizes add up to about `most`; a row is not divided."""
    return pairwise([0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1), len(sizes)])


def _packed(batches):
    """Rows as rows of lists: blocks of changes, made where the changes are read."""
    for batch in batches:
        if batch.num_rows:
            for i, j in _cuts(pc.list_value_length(batch.column(1)).to_numpy() + 1, CHANGES):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x.slice(i, j - i)) for x in batch.columns], ["change_id", "own"])


def _shared(batches):
    """For blocks of changes and of candidates: the pairs that share as many concepts as the candidate needs."""
    for batch in batches:
        for ids, own, items in zip(*batch.columns):
            yield from _met(ids.values, own.values, items.values)


def _index(need, held):
    """Of candidates: their distinct concepts, sorted; where each one's holders begin; the holders; how many a candidate needs."""
    words = held.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    terms, rank = words.dictionary.take(order), np.argsort(order.to_numpy())
    term = rank[words.indices.to_numpy()]
    by_term = np.argsort(term, kind="stable")
    return terms, np.searchsorted(term[by_term], np.arange(len(terms) + 1)), pc.list_parent_indices(held).to_numpy()[by_term], need.to_numpy()


def _counted(own, index):
    """Changes from the i-th on and all candidates, a cell for each two: i, what they share, whether it is enough, and cell and concept of each shared one."""
    terms, first, holders, need = index
    place, row = pc.index_in(own.flatten(), value_set=terms).fill_null(-1).to_numpy(), pc.list_parent_indices(own).to_numpy()
    place, row = place[place >= 0], row[place >= 0]
    n = first[place + 1] - first[place]
    for i, j in _cuts(np.bincount(row, n, len(own)).astype(np.int64) + len(need), COUNTED):
        here = slice(*np.searchsorted(row, [i, j]))
        of, many = place[here], n[here]
        holder = holders[np.repeat(first[of] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        cell = np.repeat(row[here] - i, many) * len(need) + holder
        counts = np.bincount(cell, minlength=(j - i) * len(need)).reshape(j - i, len(need))
        yield i, counts, counts >= need, cell, np.repeat(of, many)


def _met(ids, own, items):
    item_id, name, has_source, size, need, held = items.flatten()
    index = _index(need, held)
    for i, counts, keep, cell, word in _counted(own, index):
        change, item = np.nonzero(keep)
        kept = keep.ravel()[cell]
        word = word[kept][np.lexsort((word[kept], cell[kept]))]
        overlap = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, counts[keep])), pa.int32()), index[0].take(pa.array(word)))
        item = pa.array(item)
        out = pa.RecordBatch.from_arrays([ids.take(pa.array(change + i)), *(x.take(item) for x in (item_id, name, has_source, size)), overlap], ["change_id", "item_id", "name", "has_source", "_n", "overlap"])
        yield from (out.slice(at, 1 << 16) for at in range(0, len(out), 1 << 16))


def _wanted(candidates: DataFrame, minimum: float) -> DataFrame:
    """Candidates that have concepts, with these, their number, and how many of them a change must share."""
    if not 0 <= minimum <= 1:
        raise ValueError("minimum must be between 0 and 1")
    words = concepts(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    c = candidates.filter(F.col("item_id").isNotNull()).withColumn("_concepts", F.when(F.size(words) > 0, words).otherwise(concepts(F.coalesce("name", F.lit("")))))
    c = c.filter(F.size("_concepts") > 0).withColumn("_n", F.size("_concepts"))
    # the score is rounded to four digits before it is compared
    need = F.lit(0) if minimum == 0 else F.greatest(F.lit(1), F.ceil((F.lit(minimum) - 5e-5) * F.col("_n") - 1e-9))
    return c.withColumn("_need", need.cast("int"))


def _own(text: Column) -> Column:
    return F.coalesce(concepts(text), F.array().cast("array<string>"))


def _pairs(changed: DataFrame, c: DataFrame, n: int) -> DataFrame:
    """changed(change_id, text) × c of _wanted(), of n concepts -> the pairs that share what the candidate needs, with overlap."""
    c = c.select("item_id", "name", "has_source", "_n", "_need", "_concepts")
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(-(-n // CANDIDATES) or 1))
    of_items = c.groupBy(dealt.alias("_b")).agg(F.collect_list(F.struct(*c.columns)).alias("items")).select("items")
    kinds = {x: df.schema[x].dataType for df, x in ((changed, "change_id"), (c, "item_id"), (c, "name"), (c, "has_source"), (c, "_n"))}
    many = ArrayType(StringType())
    blocks = changed.select("change_id", _own(F.col("text")).alias("own")).mapInArrow(_packed, StructType([StructField("change_id", ArrayType(kinds["change_id"])), StructField("own", ArrayType(many))]))
    met = blocks.crossJoin(F.broadcast(of_items)) if n <= SENT else written(blocks).crossJoin(of_items)
    return met.mapInArrow(_shared, StructType([*(StructField(x, kind) for x, kind in kinds.items()), StructField("overlap", many)]))


def impacts(changed: DataFrame, candidates: DataFrame, minimum: float = 0.2) -> DataFrame:
    """changed(change_id, text) × candidates(item_id, name, keywords, has_source) -> scored overlaps.

    Changes are packed into blocks where they are read, blocks of candidates meet them there, and a task counts the concepts
    that its pairs share and hands on those that may reach the minimum: neither texts nor pairs are shuffled, and a concept that
    all changes hold is no hot key. With a minimum of 0 candidates without overlap count too: then every pair is a result.
    """
    c = _wanted(candidates, minimum)
    shared = _pairs(changed, c, c.agg(F.sum("_n")).first()[0] or 0)
    out = shared.withColumn("relevance_score", F.round(F.size("overlap") / F.col("_n"), 4)).filter(F.col("relevance_score") >= minimum)
    return out.select(*_told())


def _told() -> list[Column]:
    sure = F.round(F.least(F.lit(0.98), F.lit(0.5) + F.col("relevance_score") * 0.4 + F.when(F.col("has_source"), 0.08).otherwise(0.0)), 4)
    return [
        F.col("change_id"),
        F.col("item_id"),
        F.col("relevance_score"),
        sure.alias("confidence_score"),
        # fixed values: the two sentences are part of the result
        F.concat(F.lit("Potential impact inferred from shared concepts: "), F.array_join("overlap", ", "), F.lit(". Human validation is required.")).alias("rationale"),
        F.concat(F.lit("impact-claim-"), digest(12, "|", F.col("change_id"), F.col("item_id"))).alias("claim_id"),
        F.concat(F.col("name"), F.lit(" may be impacted by this regulatory change.")).alias("claim_text"),
    ]


def _hits(c: DataFrame) -> Column:
    """Of a row with its concepts `own`: the candidates that share enough of them, how many, counted in the row."""
    items = c.select("item_id", "_n", "_need", "_concepts").toArrow().combine_chunks()
    item_id, size, need, held = (pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type) for x in items.columns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index(need, held)
        for own in batches:
            many, found, shared = [0], [], []
            for _, counts, keep, _, _ in _counted(own, index):
                many.extend(keep.sum(axis=1))
                found.append(np.nonzero(keep)[1])
                shared.append(counts[keep])
            item = pa.array(np.concatenate(found))
            hit = pa.StructArray.from_arrays([item_id.take(item), size.take(item), pa.array(np.concatenate(shared), pa.int32())], ["item_id", "_n", "_shared"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(many), pa.int32()), hit)

    kind = StructType([StructField("item_id", c.schema["item_id"].dataType), StructField("_n", IntegerType()), StructField("_shared", IntegerType())])
    # else it would run once more, in a filter of its result
    return F.arrow_udf(run, ArrayType(kind)).asNondeterministic()("own")


def _ranked(sections: DataFrame, c: DataFrame, n: int, minimum: float) -> DataFrame:
    """The rows of sections(section, …) whose text has impacts, with them as `found`: (1 to the best, item_id), best first.

    Candidates go to the rows and are counted there; nothing is shuffled. Only candidates of more than SENT concepts meet
    written rows in blocks, and what is found is gathered by row.
    """
    rows = sections.withColumn("own", _own(F.col("section.text")))
    if n <= SENT:
        rows = rows.withColumn("_hits", _hits(c))
    else:
        rows = written(rows.drop("own").withColumn("_row", F.monotonically_increasing_id()))
        met = _pairs(rows.select(F.col("_row").alias("change_id"), F.col("section.text").alias("text")), c, n)
        hits = met.groupBy(F.col("change_id").alias("_row")).agg(F.collect_list(F.struct("item_id", "_n", F.size("overlap").alias("_shared"))).alias("_hits"))
        rows = rows.join(hits, "_row")
    scored = F.transform("_hits", lambda h: F.struct((-F.round(h["_shared"] / h["_n"], 4)).alias("less"), h["item_id"].alias("item_id")))
    found = F.array_sort(F.filter(scored, lambda h: -h["less"] >= minimum))
    return rows.withColumn("found", found).filter(F.size("found") > 0).select(*sections.columns, "found")


def _sized(candidates: DataFrame, minimum: float) -> tuple[DataFrame, int, bool]:
    """_wanted(), the number of its concepts, and whether the sources can be sent to all tasks."""
    c = _wanted(candidates.withColumn("has_source", F.col("source").isNotNull()), minimum)
    n, length = c.agg(F.sum("_n"), F.sum(F.length("source.text"))).first()
    return c, n or 0, (n or 0) <= SENT and (length or 0) <= SENT_SOURCES


def _cited(rows: DataFrame, c: DataFrame, sent: bool) -> DataFrame:
    """rows(change_id, section, found) -> a row for each impact, with its citations and rank."""
    cite = lambda s: F.struct(*[F.col(s)[f].alias("quote" if f == "text" else f) for f in CITED])
    known = c.select("item_id", "name", "has_source", "source", "_concepts")
    each = rows.select("change_id", "section", F.posexplode("found").alias("_at", "_hit"))
    each = each.select("change_id", "section", (F.col("_at") + 1).alias("rank"), (-F.col("_hit.less")).alias("relevance_score"), F.col("_hit.item_id").alias("item_id"))
    met = each.join(F.broadcast(known) if sent else known, "item_id").withColumn("overlap", F.array_sort(F.array_intersect("_concepts", _own(F.col("section.text")))))
    citations = F.when(F.col("source").isNull(), F.array(cite("section"))).otherwise(F.array(cite("section"), cite("source")))
    return met.select(*_told(), citations.alias("citations"), "rank")


def assessments(changes: DataFrame, candidates: DataFrame, minimum: float = 0.2) -> DataFrame:
    """changes(change_id, previous, current) × candidates(item_id, name, keywords, source): impacts with citations and rank.

    previous, current and source are sections or null: the current section is what counts, else the previous one; a change
    with neither has no impacts. A claim cites that section and, where it has one, the candidate's. Best relevance ranks first
    within a change, then the smallest item_id.
    """
    c, n, sent = _sized(candidates, minimum)
    changed = changes.withColumn("section", F.coalesce("current", "previous")).filter(F.col("section").isNotNull()).select("change_id", "section")
    return _cited(_ranked(changed, c, n, minimum), c, sent)


def assessments_of(old: DataFrame, new: DataFrame, matches: DataFrame, candidates: DataFrame, minimum: float = 0.2) -> DataFrame:
    """assessments() of the changes from old to new sections, which matches(pair_id, old_idx, new_idx) aligns.

    Impacts depend on the text that counts alone, so they are found where sections are read, and only sections that have some
    move: new ones to the ids of what they match, old ones to see that nothing does. Previous texts of matches never move.
    """
    c, n, sent = _sized(candidates, minimum)
    side = lambda df, name, *more: df.select("pair_id", F.col("idx").cast("long").alias(f"{name}_idx"), *more)
    section = F.struct(*CITED).alias("section")
    m = written(matches.select("pair_id", F.col("old_idx").cast("long"), F.col("new_idx").cast("long")))
    before = m.join(side(old, "old", F.struct("document_id", "section_id", "version").alias("previous")), ["pair_id", "old_idx"]).drop("old_idx")
    come = _ranked(side(new, "new", section), c, n, minimum).join(before, ["pair_id", "new_idx"], "left")
    gone = _ranked(side(old, "old", section), c, n, minimum).join(m, ["pair_id", "old_idx"], "left_anti")
    p, s, none = F.col("previous"), F.col("section"), F.lit(None).cast("string")
    come = come.select(change_id(source_id(p), p["version"], source_id(s), s["version"]).alias("change_id"), "section", "found")
    gone = gone.select(change_id(source_id(s), s["version"], none, none).alias("change_id"), "section", "found")
    return _cited(come.unionByName(gone), c, sent)

"""Inventory, lint, duplicates, captions and read-back of a chunk table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions import images, meta
from granary.functions import text as T
from granary.operators.chunking import prefixes

# Limits that results depend on.
READ_BUDGET, READ_MIN, READ_TAIL = 3000, 500, 200
OUTLINE_DEPTH, LIST_LIMIT, TOP_SECTIONS = 3, 50, 10


def counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each condition, in a single pass."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def distribution(df: DataFrame, column: str, missing: str = "unknown", limit: int | None = None) -> DataFrame:
    """(value, n) by falling n and then value; null and empty are `missing`."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing)).alias("value")
    out = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(limit) if limit else out


def stats(chunks: DataFrame, detail: bool = False) -> DataFrame:
    """(metric, value, n): chunks, documents, types, trust, governance; with detail also products and the first sections."""
    row = counts(
        chunks,
        {
            "chunks": F.lit(True), "toc": F.col("is_toc"), "with_image": F.col("has_image"), "copies": F.col("is_canonical") == F.lit(False), "superseded": F.col("superseded_by") != "",
        },
    )
    names = row.columns
    out = row.select(F.explode(F.array(*[F.struct(F.lit("total").alias("metric"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")
    for metric, column in [("doc_type", "doc_type"), ("trust", "trust")] + ([("product", "product")] if detail else []):
        out = out.unionByName(distribution(chunks, column).select(F.lit(metric).alias("metric"), "value", "n"))
    out = out.unionByName(chunks.select("source").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("metric"), F.lit("documents").alias("value"), "n"))
    if detail:
        out = out.unionByName(distribution(chunks, "heading_path", "(无)", TOP_SECTIONS).select(F.lit("section").alias("metric"), "value", "n"))
    return out


def roll_up(chunks: DataFrame, attributes: list[str], order: list[str], source: str = "source") -> DataFrame:
    """A row for each source: chunks, v2_chunks (trust and date written), and the first written value of each attribute."""
    at = F.struct(*order)
    first = [F.min_by(F.when(meta.is_set(F.col(a)), F.col(a)), F.when(meta.is_set(F.col(a)), at)).alias(a) for a in attributes]
    written = F.coalesce(meta.is_set(F.col("trust")), F.lit(False)) & (F.coalesce(F.col("doc_date"), F.lit(0)) != 0)
    return chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(written).alias("v2_chunks"), *first)


def list_docs(docs: DataFrame, doc_type: str | None = None, trust: str | None = None, section: str | None = None, keyword: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Documents of a roll-up by falling number of chunks; section and keyword are looked for whatever the case."""
    for column, value in (("doc_type", doc_type), ("trust", trust)):
        docs = docs.where(F.col(column) == value) if value else docs
    if section:
        docs = docs.where(F.lower("section").contains(section.lower()))
    if keyword:
        docs = docs.where(F.lower("source").contains(keyword.lower()) | F.lower("title").contains(keyword.lower()))
    return docs.orderBy(F.desc("chunks"), "source").limit(limit)


def meta_lint(docs: DataFrame, top_docs: int | None = None) -> DataFrame:
    """(source, missing, stale_chunks, uid_conflict) of a roll-up's documents, or of those with most chunks."""
    keys = {"title": F.col("title"), "applies_to.framework": F.col("framework_version"), "doc_date": F.nullif(F.col("doc_date"), F.lit(0)), "trust": F.col("trust"), "canonical": F.col("is_canonical"), "source_origin": F.col("source_origin")}
    conflicts = docs.where(meta.is_set(F.col("canonical_uid")) & F.coalesce(F.col("is_canonical"), F.lit(True))).groupBy("canonical_uid").agg(F.countDistinct("source").alias("n")).where("n > 1").select("canonical_uid")
    if top_docs:
        docs = docs.orderBy(F.desc("chunks"), "source").limit(top_docs)
    flagged = docs.join(conflicts.withColumn("uid_conflict", F.lit(True)), "canonical_uid", "left")
    return flagged.select("source", meta.lint(keys).alias("missing"), (F.col("chunks") - F.col("v2_chunks")).alias("stale_chunks"), F.coalesce("uid_conflict", F.lit(False)).alias("uid_conflict"))


def duplicates(files: DataFrame, key: Column, hint: str | None = None, limit: int | None = None) -> DataFrame:
    """(key, n, canonical) of keys that several files (path, modified, size) share.

    The canonical file has the hint in its path, else is the newest, else the largest, else the first by path.
    """
    rank = F.struct(F.coalesce(F.lower("path").contains((hint or "").lower()) if hint else F.lit(False), F.lit(False)).alias("h"), F.col("modified"), F.col("size"))
    best = F.min_by("path", F.struct((~rank["h"]).alias("h"), (-F.col("modified").cast("double")).alias("m"), (-F.col("size")).alias("s"), "path"))
    out = files.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), best.alias("canonical")).where("n > 1").orderBy(F.desc("n"), "key")
    return out.limit(limit) if limit else out


def copies(files: DataFrame, groups: DataFrame, key: Column) -> DataFrame:
    """(key, path, is_canonical) of the files in groups of duplicates, however many."""
    return files.withColumn("key", key).join(groups.select("key", "canonical"), "key").select("key", "path", (F.col("path") == F.col("canonical")).alias("is_canonical"))


def read_doc(chunks: DataFrame, order: list[str], budget: int = READ_BUDGET, source: str = "source") -> DataFrame:
    """(source, ..., piece): each source's blocks in order as far as the budget of characters goes.

    The block that doesn't fit is cut to what is left where that is over READ_TAIL characters; nothing follows it.
    """
    budget = max(READ_MIN, budget)
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("before", before).withColumn("left", F.lit(budget) - F.col("before"))
    fits = F.length("text") <= F.col("left")
    return rows.where(fits | (F.col("left") > READ_TAIL)).withColumn("piece", F.when(fits, F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), F.col("left").cast("int")))).drop("left")


def section(chunks: DataFrame, heading: Column, order: list[str], source: str = "source") -> DataFrame:
    """Chunks from the first whose heading_path has the heading to before the next that is no deeper and not under it.

    Under it: its path begins with the first one's path as text. Chunks without a path belong to the section before.
    """
    w = Window.partitionBy(source).orderBy(*order)
    path = F.coalesce(F.col("heading_path"), F.lit(""))
    depth = F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, " > ")))
    rows = chunks.withColumn("_n", F.row_number().over(w)).withColumn("_path", path).withColumn("_depth", depth)
    whole = Window.partitionBy(source)
    hit = F.lower("_path").contains(F.lower(heading))
    rows = rows.withColumn("_start", F.min(F.when(hit, F.struct("_n", "_path", "_depth"))).over(whole)).where(F.col("_start").isNotNull())
    ends = (F.col("_n") > F.col("_start._n")) & (F.col("_path") != "") & (F.col("_depth") <= F.col("_start._depth")) & ~F.col("_path").startswith(F.col("_start._path"))
    rows = rows.withColumn("_stop", F.min(F.when(ends, F.col("_n"))).over(whole))
    return rows.where((F.col("_n") >= F.col("_start._n")) & (F.col("_stop").isNull() | (F.col("_n") < F.col("_stop")))).drop("_n", "_path", "_depth", "_start", "_stop")


def outline(chunks: DataFrame, ordinal: str, depth: int = OUTLINE_DEPTH, source: str = "source") -> DataFrame:
    """(source, path, depth, chunks, first) of every section and what it is in, as they first appear."""
    depth = max(1, min(6, depth))
    parts = chunks.select(source, ordinal, F.explode(prefixes(F.col("heading_path"), depth)).alias("path"))
    return parts.groupBy(source, "path").agg(F.count(F.lit(1)).alias("chunks"), F.min(ordinal).alias("first")).withColumn("depth", F.size(F.split("path", " > ")))


def caption_coverage(chunks: DataFrame) -> DataFrame:
    """One row: chunks with images, with a caption, with the caption in the text, real ones, documents, stale documents."""
    asked = chunks.where(F.size("image_refs") > 0)
    has = meta.is_set(F.col("image_captions"))
    shown = has & F.col("text").contains(F.col("image_captions"))
    docs = asked.groupBy("source").agg(F.bool_or(has).alias("captioned"), F.bool_or(F.coalesce(shown, F.lit(False))).alias("marked"))
    per_doc = docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if("captioned").alias("captioned_docs"), F.count_if(F.col("captioned") & ~F.col("marked")).alias("stale_docs"))
    return asked.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(has).alias("captioned"), F.count_if(F.coalesce(shown, F.lit(False))).alias("in_text"), F.count_if(F.col("image_caption_source").isin("explicit", "alt")).alias("real"),
    ).crossJoin(F.broadcast(per_doc))


@F.pandas_udf(StructType().add("caption", "string").add("level", "string"))
def _stub(rows: pd.DataFrame) -> pd.DataFrame:
    """The caption that can be told without the text around an image: by the image's name, or by where it is."""
    keys = ["heading", "title", "heading_path", "image_refs"]
    found = [images.caption_of(h or "", [], t or "", p or h or "", list(refs) if refs is not None else []) for h, t, p, refs in rows[keys].itertuples(index=False)]
    return pd.DataFrame(found, columns=["caption", "level"])


def with_captions(chunks: DataFrame) -> DataFrame:
    """chunks whose images have no caption with one, in image_captions and image_caption_source; the others as they are."""
    lacking = (F.size("image_refs") > 0) & ~F.coalesce(meta.is_set(F.col("image_captions")), F.lit(False))
    told = chunks.withColumn("_told", F.when(lacking, _stub(F.struct("heading", "title", "heading_path", "image_refs"))))
    new = lambda field, old: F.coalesce(F.nullif(F.col("_told")[field], F.lit("")), F.col(old))
    return told.withColumns({"image_captions": new("caption", "image_captions"), "image_caption_source": F.when(F.col("_told.caption") != "", F.col("_told.level")).otherwise(F.col("image_caption_source"))}).drop("_told")


def caption_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """(caption, level, chunks) of the captions that `after` has and `before` hasn't, by id."""
    old = before.select("id", F.col("image_captions").alias("_old"))
    new = after.join(old, "id").where(~F.col("image_captions").eqNullSafe(F.col("_old")))
    return new.groupBy(F.col("image_captions").alias("caption"), F.col("image_caption_source").alias("level")).agg(F.count(F.lit(1)).alias("chunks"))


def to_embed_again(before: DataFrame, after: DataFrame, mark: str = "[图注]") -> DataFrame:
    """(source) of documents with a new caption, or with one that their text, and so their vectors, don't have."""
    old = before.select("id", F.col("image_captions").alias("_old"))
    new = after.join(old, "id").where(~F.col("image_captions").eqNullSafe(F.col("_old"))).select("source")
    stale = before.where((F.size("image_refs") > 0) & meta.is_set(F.col("image_captions")) & ~F.col("text").contains(mark)).select("source")
    return new.union(stale).distinct()


def vector_quality(vectors: DataFrame, dim: int, sample: int | None = None) -> DataFrame:
    """(issue, n, pct) over all vectors, or over a quick look at some; ok where there is none."""
    vectors = vectors if sample is None else vectors.limit(sample)
    issue = F.coalesce(meta.vector_issue(F.col("dense"), dim), F.lit("ok")).alias("issue")
    grouped = vectors.groupBy(issue).agg(F.count(F.lit(1)).alias("n"))
    total = vectors.agg(F.count(F.lit(1)).alias("total"))
    return grouped.crossJoin(F.broadcast(total)).select("issue", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"))


def image_audit(refs: DataFrame) -> DataFrame:
    """One row of totals over resolved references (source, kind, reachable)."""
    return refs.agg(
        F.countDistinct("source").alias("files"), F.count(F.lit(1)).alias("refs"), F.count_if("reachable").alias("reachable"), F.count_if(F.col("kind") != "relative").alias("external"),
        F.count_if((F.col("kind") == "relative") & ~F.col("reachable")).alias("unresolved"),
    )

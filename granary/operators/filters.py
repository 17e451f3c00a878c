"""Search filters as Column predicates, and first-non-empty cascades as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def equals(column: str, value: str | None) -> Column | None:
    return None if not value else F.col(column) == value


def one_of(column: str, values: list[str] | None) -> Column | None:
    return None if not values else F.col(column).isin(values)


def scope(model: str | None, column: str = "model_scope") -> Column | None:
    """A model's own rows and the general ones."""
    return None if not model else F.col(column).isin(model, "general")


def canonical_only(column: str = "is_canonical") -> Column:
    """Only rows marked as copies go; unmarked ones pass."""
    return ~F.col(column).eqNullSafe(F.lit(False))


def under(prefix: str | None, column: str = "source") -> Column | None:
    """Path prefix, whatever the case."""
    return None if not prefix else F.lower(F.col(column)).startswith(prefix.replace("\\", "/").lower())


def not_empty(column: str) -> Column:
    return F.col(column).isNotNull() & (F.size(column) > 0)


def has_all(terms: Column, tokens: Column) -> Column:
    """Full-text AND: every term, in lower case, is among the tokens."""
    return F.forall(terms, lambda t: F.array_contains(tokens, F.lower(t)))


def build(doc_type: str | None = None, sections: list[str] | None = None, version: str | None = None, model: str | None = None, trust: list[str] | None = None, kind: str | None = None, path_prefix: str | None = None, canonical: bool = True) -> Column:
    """All given conditions; none given: canonical rows. Pushed down to the scan where Spark can."""
    parts = [
        equals("doc_type", doc_type), one_of("heading_path", sections), equals("framework_version", version), scope(model), one_of("trust", trust), equals("kind", kind),
        under(path_prefix), canonical_only() if canonical else None,
    ]
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def where_any(df: DataFrame, condition: Column, per: list[str] | None = None) -> DataFrame:
    """Rows that meet the condition, or all rows where none does; with `unmatched` saying which. One plan, no round trip.

    What is asked of all rows is one flag for each group, which combines before the shuffle.
    """
    hit = F.coalesce(condition, F.lit(False))
    flagged = df.withColumn("_hit", hit)
    found = flagged.groupBy(*(per or [])).agg(F.max("_hit").alias("_any"))
    joined = flagged.crossJoin(F.broadcast(found)) if not per else flagged.join(found, per)
    return joined.where("_hit or not _any").withColumn("unmatched", ~F.col("_any")).drop("_hit", "_any")


def first_tier(df: DataFrame, tiers: list[Column], per: list[str]) -> DataFrame:
    """Of each group the rows of the lowest tier that has any, with that tier (from 1); rows of no tier go."""
    tier = F.lit(None).cast("int")
    for i in range(len(tiers), 0, -1):
        tier = F.when(F.coalesce(tiers[i - 1], F.lit(False)), F.lit(i)).otherwise(tier)
    ranked = df.withColumn("tier", tier).where("tier is not null")
    return ranked.withColumn("_first", F.min("tier").over(Window.partitionBy(*per))).where("tier = _first").drop("_first")


def section_tiers(section: str | None, column: str = "heading_path") -> list[Column]:
    """What a text can mean, whatever its case: a whole path, a path with its blanks put right, a part of a path."""
    wanted = (section or "").strip().lower()
    path = F.lower(F.coalesce(column, F.lit("")))
    parts = [p.strip() for p in wanted.split(">")]
    tidy = [path == " > ".join(filter(None, parts))] if len(parts) > 1 else []
    return [path == wanted, *tidy, path.contains(wanted)] if wanted else []


def in_section(chunks: DataFrame, section: str | None, column: str = "heading_path") -> DataFrame:
    """Chunks of the sections that are meant by a text, by the first of section_tiers that any has; all where none has.

    What is asked of all chunks is the lowest tier: one number, which combines before the shuffle.
    """
    tiers = section_tiers(section, column)
    if not tiers:
        return chunks
    tier = F.coalesce(*[F.when(t, i) for i, t in enumerate(tiers)])
    first = chunks.agg(F.min(tier).alias("_first"))
    return chunks.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (tier == F.col("_first"))).drop("_first")


def below(chunks: DataFrame, prefix: str | None, column: str = "source") -> DataFrame:
    """Chunks whose source is under a path prefix; all where none is."""
    return where_any(chunks, under(prefix, column)).drop("unmatched") if prefix else chunks


def scope_notes(chunks: DataFrame, section: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """(asked, value, documents, ignored): how many documents a section or a path prefix means; ignored where none."""
    asked = [("section", section, in_section, reduce(lambda a, b: a | b, section_tiers(section), F.lit(False))), ("path_prefix", path_prefix, below, under(path_prefix))]
    out = chunks.sparkSession.createDataFrame([], "asked string, value string, documents long, ignored boolean")
    for name, value, met, hit in asked:
        if value:
            n = met(chunks, value).agg(F.countDistinct(F.when(hit, F.col("source"))).alias("documents"))
            out = out.unionByName(n.select(F.lit(name).alias("asked"), F.lit(value).alias("value"), "documents", (F.col("documents") == 0).alias("ignored")))
    return out


def resolve_source(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request, source, tier, ambiguous): full path, else file name, else part of the path, whatever the case.

    Paths are equal after their slashes are. Several sources of one file name are ambiguous and don't fall through;
    several by part of the path give the first by name.
    """
    lower = lambda c: F.lower(T.normalize_path(F.col(c)))
    wanted = requests.select("request").distinct().withColumn("r", lower("request"))
    known = sources.select("source").distinct().withColumn("s", lower("source")).withColumn("base", F.element_at(F.split("s", "/"), -1))
    full = wanted.join(known, F.col("r") == F.col("s")).select("request", "source", F.lit(1).alias("tier"))
    named = wanted.withColumn("base", F.element_at(F.split("r", "/"), -1)).join(known, "base").select("request", "source", F.lit(2).alias("tier"))
    part = wanted.join(known, F.col("s").contains(F.col("r"))).select("request", "source", F.lit(3).alias("tier"))
    every = full.unionByName(named).unionByName(part)
    ranked = every.withColumn("_first", F.min("tier").over(Window.partitionBy("request"))).where("tier = _first")
    picked = ranked.groupBy("request", "tier").agg(F.min("source").alias("source"), F.countDistinct("source").alias("n"))
    ambiguous = (F.col("tier") == 2) & (F.col("n") > 1)
    return picked.select("request", F.when(~ambiguous, F.col("source")).alias("source"), "tier", ambiguous.alias("ambiguous"))

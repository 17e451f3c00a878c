"""Validated ingest: defaults, rendering, checks against the table, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import meta
from granary.functions import text as T

INBOX = "kb-inbox"
#: Known documents of a key that one task pairs at once, and tasks of pairs for each core.
BLOCK, TASKS_A_CORE = 512, 8
#: Front-matter keys in the order that they are written in.
KEYS = ["title", "product", "framework", "model", "doc_version", "doc_date", "trust", "source_origin", "ingested_by", "revision", "canonical", "superseded_by", "canonical_uid"]
#: Sections that each kind's document should have: a parameter of validation, by kind.
SECTIONS: dict[str, list[str]] = {"draft": ["topic", "evidence"], "error_faq": ["error", "cause", "fix"], "defect_log": ["symptom", "cause", "fix"]}


def with_defaults(docs: DataFrame, as_of: Column) -> DataFrame:
    """docs (kind, title and any of KEYS) with every key: the given value, else the kind's default, else a general one."""
    kinds = {k: {"label": label, "trust": trust, "source_origin": origin, "ingested_by": by} for k, label, trust, origin, by, _ in meta.KINDS}
    of_kind = lambda key, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[key])]), F.col("kind")), other)
    today = F.date_format(as_of, "yyyy-MM-dd")
    general = {
        "title": F.concat(of_kind("label", F.col("kind")), F.lit("-"), today), "product": F.lit(meta.PRODUCT_PATHS[0][0]), "framework": F.lit("unknown"), "model": F.lit("general"), "doc_version": F.lit(""),
        "doc_date": today, "trust": of_kind("trust", F.lit("tutorial")), "source_origin": of_kind("source_origin", F.lit("kb")), "ingested_by": of_kind("ingested_by", F.lit("manual")), "revision": F.lit(""),
        "canonical": (F.col("kind") != "draft").cast("string"), "superseded_by": F.lit(""), "canonical_uid": F.lit(""),
    }
    have = set(docs.columns)
    given = lambda k: F.nullif(F.col(k).cast("string"), F.lit("")) if k in have else F.lit(None).cast("string")
    return docs.withColumns({k: F.coalesce(given(k), v) for k, v in general.items()})


def rendered(docs: DataFrame, body: Column) -> Column:
    """The document: front matter with every key quoted, the framework and model nested, then the body."""
    line = lambda k, name=None: F.concat(F.lit(f"{name or k}: "), F.col(k) if k == "canonical" else T.yaml_scalar(F.col(k)))
    optional = lambda k: F.when(F.col(k) != "", line(k))
    head = [line("title"), line("product"), F.lit("applies_to:"), line("framework", "  framework"), line("model", "  model"), *[line(k) for k in KEYS[4:11]], optional("superseded_by"), optional("canonical_uid")]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n"), F.trim(body), F.lit("\n"))


def target(kind: Column, title: Column) -> Column:
    """Where a document is written: the kind's folder (drafts have their own), a safe file name."""
    folder = F.when(kind == "draft", F.lit("drafts")).otherwise(kind)
    return F.concat(F.lit(f"{INBOX}/"), folder, F.lit("/"), T.slugify(title), F.lit(".md"))


def conflicts(new: DataFrame, known: DataFrame) -> DataFrame:
    """(path, rule, other): new documents (path, hash, title, framework, revision) against known ones of the same columns.

    duplicate: another path has the same content; version: the same title, in any case, for another framework; revision:
    the same path, in any case, at another revision.
    """
    written = lambda c: (F.col(f"n.{c}") != "") & (F.col(f"k.{c}") != "") & (F.col(f"n.{c}") != F.col(f"k.{c}"))
    found = lambda rule, key, on, *columns: _paired(new, known, key, columns).where(on).select(F.col("n.path").alias("path"), F.lit(rule).alias("rule"), F.col("k.path").alias("other"))
    title = F.when(F.col("title") != "", F.lower("title"))
    duplicate = found("duplicate", F.col("hash"), F.lower("n.path") != F.lower("k.path"))
    version = found("version", title, written("framework"), "framework")
    return duplicate.unionByName(version).unionByName(found("revision", F.lower("path"), written("revision"), "revision"))


def _paired(new: DataFrame, known: DataFrame, key: Column, columns: tuple[str, ...]) -> DataFrame:
    """All pairs (n, k) of new and known documents of one key, each with its path and columns.

    A key's known documents are dealt to blocks of about BLOCK, which its new ones all meet. So a task makes at most
    BLOCK pairs of a new document, and a key that many have is paired by many tasks; the pairs, which are as many as
    the product, are not held anywhere.
    """
    n, k = (df.select("path", *columns, key.alias("key")).where("key IS NOT NULL") for df in (new, known))
    large = k.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    n = n.join(large, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    k = k.join(large, "key", "left").withColumn("block", F.pmod(F.xxhash64("path"), blocks).cast("int")).drop("blocks")
    # By number: few and short rows make many pairs, so tasks must not be merged by their size.
    parts = TASKS_A_CORE * n.sparkSession.sparkContext.defaultParallelism
    n, k = (df.repartition(parts, "key", "block").alias(name) for df, name in ((n, "n"), (k, "k")))
    return n.join(k.hint("shuffle_hash"), (F.col("n.key") == F.col("k.key")) & (F.col("n.block") == F.col("k.block")))


def report(docs: DataFrame, known: DataFrame, as_of: Column, body: str = "body") -> DataFrame:
    """docs with text, path, hash, issues and accepted: no issue is an error. Conflicts are issues of level warn."""
    full = with_defaults(docs, as_of)
    full = full.withColumn("text", rendered(full, F.col(body))).withColumn("path", target(F.col("kind"), F.col("title")))
    full = full.withColumn("hash", F.sha2("text", 256))
    keys = {"title": F.col("title"), "applies_to.framework": F.col("framework"), "doc_date": F.col("doc_date"), "trust": F.col("trust"), "canonical": F.col("canonical"), "applies_to.model": F.col("model"), "source_origin": F.col("source_origin")}
    model_level = F.col("kind").isin([k[0] for k in meta.KINDS if k[5]])
    needed = F.lit(None).cast("array<string>")
    for kind, names in SECTIONS.items():
        needed = F.when(F.col("kind") == kind, F.array(*map(F.lit, names))).otherwise(needed)
    lacking = F.array_except(F.coalesce(needed, F.array().cast("array<string>")), F.regexp_extract_all(F.col(body), F.lit(r"(?m)^##\s+(.+?)\s*$"), 1))
    full = full.withColumn("issues", meta.validate(F.col("text"), F.col("kind"), meta.lint(keys, model_level), F.col("revision"), lacking))
    met = conflicts(full.select("path", "hash", "title", "framework", "revision"), known).groupBy("path").agg(F.array_sort(F.collect_set(F.struct(F.lit("warn").alias("level"), F.col("rule"), F.lit(1).alias("n")))).alias("met"))
    out = full.join(met, "path", "left").withColumn("issues", F.concat("issues", F.coalesce("met", F.array().cast("array<struct<level:string,rule:string,n:int>>")))).drop("met")
    return out.withColumn("accepted", ~F.exists("issues", lambda i: i["level"] == "error"))

"""Metadata rules: types of documents, defaults, lint, validation, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as T

# Payloads and lint results depend on them.
TRUST_LEVELS = ["measured", "tutorial", "pending"]
SOURCE_ORIGINS = ["kb", "plugin", "web", "decompile"]
REQUIRED_KEYS = ["title", "applies_to.framework", "doc_date", "trust", "canonical"]
DEFAULTS = {"kind": "doc", "framework_version": "unknown", "model_scope": "general", "trust": "pending", "doc_version": "", "canonical_uid": "", "ingested_by": "manual", "revision": ""}
TRUST_WEIGHTS = {"measured": 1.0, "tutorial": 0.9, "pending": 0.75}
RECENCY_KINDS = ["note", "defect_log", "error_faq", "model_fact_card", "version_matrix"]
RECENCY_FLOOR, RECENCY_DAYS = 0.85, 182.5
PREVIEW = 300

# Fixed values: (result, substrings of the path), tried in order, then (result, substrings of the text's begin).
DOC_TYPE_PATHS = [("api_reference", ["api", "reference"]), ("tutorial", ["tutorial", "guide", "howto"]), ("design_spec", ["design", "spec"]), ("release_note", ["release", "changelog"])]
DOC_TYPE_TEXTS = [
    ("api_reference", ["api reference", "api 参考", "namespace ", "class "]),
    ("tutorial", ["tutorial", "教程", "step by step", "快速入门"]),
    ("design_spec", ["design specification", "设计规范", "design spec"]),
    ("release_note", ["release note", "更新日志", "changelog"]),
]
PRODUCT_PATHS = [("emulate3d", ["emulate", "e3d"]), ("wms", ["wms"]), ("wcs", ["wcs"]), ("agv", ["agv", "amr"]), ("asrs", ["asrs"])]
PRODUCT_TEXTS = [("emulate3d", ["emulate3d", "emulate 3d", "demo3d"]), ("wms", ["wms"]), ("wcs", ["wcs"]), ("agv", ["agv", "amr"]), ("asrs", ["asrs"])]

# Kind, label, default trust, default origin, default ingester, whether a result about a model.
KINDS = [
    ("model_fact_card", "模型事实卡", "measured", "plugin", "em3d_export", True),
    ("part_signature", "部件签名表", "measured", "plugin", "em3d_export", False),
    ("version_matrix", "版本差异矩阵", "tutorial", "kb", "manual", False),
    ("error_faq", "错误串 FAQ", "measured", "plugin", "qlp_export", False),
    ("defect_log", "缺陷登记", "measured", "plugin", "em3d_export", False),
    ("enum_examples", "枚举示例", "tutorial", "kb", "manual", False),
    ("qlp_snippet", "QLP 可跑片段", "measured", "plugin", "qlp_export", False),
    ("asset_pointer", "资产路径登记", "tutorial", "decompile", "manual", False),
    ("draft", "草稿（kb_note）", "pending", "kb", "kb_note", False),
]
# File name of an exported artifact, kind.
ARTIFACTS = [
    ("model_digest.md", "model_fact_card"), ("model_digest.yaml", "model_fact_card"), ("model_graph.json", "model_fact_card"), ("capabilities.json", "part_signature"),
    ("model_health.md", "defect_log"), ("crash_site.json", "error_faq"), ("qlp_trace.json", "error_faq"),
]
SNIPPET_SUFFIX = (".qlp", "qlp_snippet")


def _chain(value: Column, rules: list[tuple[str, list[str]]]) -> Column:
    out = F.lit(None).cast("string")
    for name, parts in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [value.contains(p) for p in parts]), F.lit(name)).otherwise(out)
    return out


def by_rules(path: Column, text: Column, paths: list[tuple[str, list[str]]], texts: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule whose substring is in the lower-case path, else in the lower-case begin of the text, else the default."""
    begin = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW))
    return F.coalesce(_chain(F.lower(F.coalesce(path, F.lit(""))), paths), _chain(begin, texts), F.lit(default))


def doc_type(path: Column, text: Column) -> Column:
    return by_rules(path, text, DOC_TYPE_PATHS, DOC_TYPE_TEXTS, "user_manual")


def product(path: Column, text: Column) -> Column:
    return by_rules(path, text, PRODUCT_PATHS, PRODUCT_TEXTS, "general")


def artifact_kind(path: Column) -> Column:
    """Kind of an exported artifact by its file name, or null."""
    name = F.lower(T.basename(path))
    known = F.create_map(*[F.lit(x) for pair in ARTIFACTS for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.when(name.endswith(SNIPPET_SUFFIX[0]), F.lit(SNIPPET_SUFFIX[1])))


def is_set(value: Column) -> Column:
    """Whether something was written: neither null nor empty. False counts as written."""
    return value.isNotNull() & (value.cast("string") != "")


def default_to(value: Column, key: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(DEFAULTS[key]))


def trust_of(value: Column) -> Column:
    """The trust level; missing and unknown ones are pending."""
    return F.when(value.isin(TRUST_LEVELS), value).otherwise(F.lit(DEFAULTS["trust"]))


def lint(keys: dict[str, Column], model_level: Column | None = None) -> Column:
    """Array of missing required keys and illegal values. keys: columns by dotted name; an absent name is never set."""
    get = lambda k: keys.get(k, F.lit(None).cast("string"))
    checks = [F.when(~F.coalesce(is_set(get(k)), F.lit(False)), F.lit(k)) for k in REQUIRED_KEYS]
    if model_level is not None:
        checks.append(F.when(model_level & ~F.coalesce(is_set(get("applies_to.model")), F.lit(False)), F.lit("applies_to.model")))
    for key, legal in (("trust", TRUST_LEVELS), ("source_origin", SOURCE_ORIGINS)):
        checks.append(F.when(F.coalesce(is_set(get(key)), F.lit(False)) & ~get(key).isin(legal), F.concat(F.lit(f"{key}(illegal:"), get(key), F.lit(")"))))
    return F.array_compact(F.array(*checks))


def trust_weight(trust: Column) -> Column:
    """Multiplier of a score; a missing or unknown level leaves it alone."""
    out = F.lit(1.0)
    for level, weight in TRUST_WEIGHTS.items():
        out = F.when(trust == level, F.lit(weight)).otherwise(out)
    return out


def recency_factor(kind: Column, doc_date: Column, inferred: Column, as_of: Column) -> Column:
    """Falls from 1 to the floor over half a year for conclusions; inferred, invalid and future dates leave it at 1."""
    day = F.try_to_timestamp(doc_date.cast("string"), F.lit("yyyyMMdd")).cast("date")
    age = F.datediff(as_of.cast("date"), day)
    aged = F.greatest(F.lit(RECENCY_FLOOR), 1 - (1 - RECENCY_FLOOR) * age / RECENCY_DAYS)
    counts = kind.isin(RECENCY_KINDS) & ~F.coalesce(inferred, F.lit(False)) & (age > 0)
    return F.when(counts, aged).otherwise(F.lit(1.0))


def vector_issue(vector: Column, dim: int) -> Column:
    """What is wrong with a vector: dim, nan, zero, or null if nothing."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) != dim), F.lit("dim")).when(bad, F.lit("nan")).when(F.forall(v, lambda x: F.abs(x) < 1e-9), F.lit("zero"))


def validate(text: Column, kind: Column, missing: Column, revision: Column, lacking: Column) -> Column:
    """Array of (level, rule, n) issues of a document to be ingested.

    missing: lint's result; lacking: headings of the kind's template that the body has not. Errors block the ingest.
    """
    names = [k[0] for k in KINDS]
    known, model_level = kind.isin(names), kind.isin([k[0] for k in KINDS if k[5]])
    body = T.strip_front_matter(text)
    stripped = F.trim(F.regexp_replace(F.regexp_replace(body, r"\{\{[\p{L}\p{N}_]+\}\}", ""), T.SPACE + "+", " "))
    unfilled = F.size(F.regexp_extract_all(body, F.lit("(待填[:：])"), 1))
    issue = lambda level, rule, n: F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), n.cast("int").alias("n"))
    one = F.lit(1)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(known, F.lit(False)), issue("error", "kind", one)),
            F.when(~text.rlike(T.FRONT_MATTER), issue("error", "front_matter", one)),
            F.when(F.size(missing) > 0, issue("error", "required_meta", F.size(missing))),
            F.when(model_level & ~F.coalesce(is_set(revision), F.lit(False)), issue("warn", "revision", one)),
            F.when(stripped == "", issue("error", "no_body", one)).when(F.length(stripped) < T.SHELL_CHARS, issue("error", "short_body", F.length(stripped))),
            F.when(unfilled > 0, issue("warn", "unfilled", unfilled)),
            F.when((F.size(lacking) > 0) & (stripped != ""), issue("info", "sections", F.size(lacking))),
            F.when(body.rlike("�|Ã[\u0080-¿]|â€"), issue("error", "encoding", one)),
        )
    )


def summarize(issues: Column) -> Column:
    """One line: ok, or the numbers of errors and warnings."""
    of = lambda level: F.size(F.filter(issues, lambda i: i["level"] == level))
    return F.when(F.size(issues) == 0, F.lit("ok")).otherwise(F.concat_ws(" ", of("error").cast("string"), F.lit("errors,"), of("warn").cast("string"), F.lit("warnings")))


def real_doc_date(date: Column, lastmod: Column) -> Column:
    """A year-month-day date, else day/month/year of lastmod where one of the first two can only be a day, else empty."""
    of = lambda column, pattern, i: F.regexp_extract(F.trim(F.coalesce(column, F.lit(""))), pattern, i).try_cast("int")
    iso, local = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    y, m, d = (of(date, iso, i) for i in (1, 2, 3))
    a, b, year = (of(lastmod, local, i) for i in (1, 2, 3))
    made = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.isNotNull(), made(y, m, d)).when(a > 12, made(year, b, a)).when(b > 12, made(year, a, b)).otherwise("")


def project_page(url: Column, source_id: Column) -> Column:
    """(project, page): the first part of a URL's path and the others, if there are two or more, else of the source id."""
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://[^/]+/(.+)$", 1), "/"), lambda p: p != "")
    by_id = F.coalesce(source_id, F.lit("")).contains("/")
    project = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(1))).when(by_id, F.substring_index(source_id, "/", 1)).otherwise("")
    page = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 2, 1 << 30), "/")).when(by_id, F.substring(source_id, F.instr(source_id, "/") + 1, F.length(source_id))).otherwise("")
    return F.struct(project.alias("project"), page.alias("page"))


def nested(json: Column, path: str) -> Column:
    """A dotted path in a JSON text, or null."""
    return F.get_json_object(json, f"$.{path}")

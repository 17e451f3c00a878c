"""Text normalisation and lexical functions, as Column expressions wherever Spark has the parts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The result of an exact search depends on them.
EXACT_STOP_WORDS = [
    "the", "a", "an", "of", "to", "is", "are", "and", "or", "in", "on", "for", "with", "as", "by", "at", "be", "it", "this", "that", "from", "if", "when",
    "must", "not", "no", "do", "does", "was", "were", "you", "your", "can",
]
HEADING_MAX = 120
SLUG_MAX = 60
SHELL_CHARS = 20

#: Unicode white space as Python's str.split() sees it, for Java's engine.
SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]+"
ENTITY = r"&#?[\p{L}\p{N}_]+;"
SHORTCODE = r"\{\{%[^%]*%\}\}"
FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"


def normalize_for_search(text: Column) -> Column:
    """Quotes, backticks and runs of backslashes to spaces, white space to single spaces, trimmed; case stays. Null: empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\"'“”‘’`\\{SPACE[1:]}+", " "))  # one class: a quote is a space, and spaces are one


def squeeze(text: str) -> str:
    """What normalize_text does to one text."""
    if not text:
        return ""
    joined = re.sub(r"(\w)-\r?\n(\w)", r"\1\2", text)
    lines = []
    for line in unicodedata.normalize("NFKC", joined).replace("\r\n", "\n").split("\n"):
        body = line.lstrip(" \t")
        indent = line[: len(line) - len(body)]
        lines.append((indent + re.sub(r"[ \t]+", " ", body)).rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def normalize_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Words broken at a hyphen joined, compatibility composition, blanks squeezed after the indent, blank lines limited.

    Spark has no Unicode normalisation, so this is an Arrow batch function.
    """
    for series in texts:
        yield series.map(squeeze, na_action="ignore")


def version_rank(version: Column) -> Column:
    """First four numbers as digits of base 1000, most significant first; -1 without any. A long: 3.x exceeds 32 bits."""
    parts = F.slice(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"([0-9]+)"), 1), 1, 4)
    weights = F.array(*[F.lit(1000 ** (3 - i)).cast("long") for i in range(4)])
    rank = F.aggregate(F.zip_with(parts, F.slice(weights, 1, F.greatest(F.size(parts), F.lit(1))), lambda p, w: F.coalesce(p.cast("long"), F.lit(0)) * w), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.size(parts) == 0, F.lit(-1).cast("long")).otherwise(rank)


def date_int(text: Column, modified: Column | None = None) -> Column:
    """The first Y-M-D (or / or .) as YYYYMMDD without calendar check, else the modification time's day in UTC, else 0."""
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", i)
    found = F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).cast("int")
    fallback = F.lit(0) if modified is None else F.coalesce(F.date_format(modified, "yyyyMMdd").cast("int"), F.lit(0))
    return F.when(part(1) != "", found).otherwise(fallback)


def format_date(value: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything of another length as it is."""
    s = value.cast("string")
    return F.when(F.length(s) == 8, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise(s)


def strip_shortcodes(text: Column) -> Column:
    return F.regexp_replace(text, SHORTCODE, "")


def strip_entities(text: Column) -> Column:
    return F.regexp_replace(text, ENTITY, "")


def meaningful_length(text: Column) -> Column:
    """Characters without entities and white space."""
    return F.length(F.regexp_replace(strip_entities(F.coalesce(text, F.lit(""))), SPACE + "+", ""))


def is_shell(text: Column, has_image: Column | None = None, least: int = SHELL_CHARS) -> Column:
    """Whether so little is left that the text says nothing; texts with an image never are."""
    short = meaningful_length(text) < least
    return short if has_image is None else short & ~F.coalesce(has_image, F.lit(False))


def is_toc(text: Column) -> Column:
    """At least three non-blank lines, over 40 % of which are links or link items."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")) != "")
    linkish = F.filter(lines, lambda x: x.rlike(r"^\s*[-*] \[") | x.contains("]("))
    return (F.size(lines) >= 3) & (F.size(linkish) / F.size(lines) > 0.4)


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line (blank after # optional from ## on, text of 120 characters at most), else null."""
    marks, body = (F.regexp_extract(line, r"^(#{1,6})[ \t]*(.+?)[ \t]*#*[ \t]*$", i) for i in (1, 2))
    text = F.trim(body)
    tag = (F.length(marks) == 1) & (F.length(line) > 1) & ~F.substring(line, 2, 1).isin(" ", "\t")
    return F.when((marks != "") & (text != "") & (F.length(text) <= HEADING_MAX) & ~tag, F.length(marks))


def heading_text(line: Column) -> Column:
    return F.when(heading_level(line).isNotNull(), F.trim(F.regexp_extract(line, r"^(#{1,6})[ \t]*(.+?)[ \t]*#*[ \t]*$", 2)))


def front_matter(text: Column) -> Column:
    """The block between the --- lines at the begin, or null."""
    return F.when(text.rlike(FRONT_MATTER), F.regexp_extract(text, FRONT_MATTER, 1))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def flat_yaml(block: Column) -> Column:
    """Map of flat `key: value` lines; comment lines don't count, quotes around values go, the last of equal keys wins."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))), '^"+|"+$', ""), "^'+|'+$", "")
    entries = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def slugify(text: Column, longest: int = SLUG_MAX) -> Column:
    """Illegal characters and white space to single dashes, cut to a length, never empty."""
    dashed = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), rf'(?:[\\/:*?"<>|]|{SPACE})+', "-"), "^-+|-+$", "")
    cut = F.substring(F.regexp_replace(dashed, "-{2,}", "-"), 1, longest)
    return F.regexp_replace(F.when(cut == "", F.lit("untitled")).otherwise(cut), "^-+|-+$", "")


def yaml_scalar(value: Column) -> Column:
    """A quoted scalar with backslashes and quotes escaped; null is the empty one."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.coalesce(escaped, F.lit("")), F.lit('"'))


def normalize_path(path: Column) -> Column:
    """Forward slashes, as on every system."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(normalize_path(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits and underscores, in any language, in order and with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def exact_terms(query: Column) -> Column:
    """Distinct tokens worth a prefilter, longest first and else in order: three characters or more, no stop word."""
    words = F.filter(F.array_distinct(F.split(normalize_for_search(query), " ")), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(EXACT_STOP_WORDS))
    keyed = F.transform(words, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def anchor_terms(query: Column) -> Column:
    """Distinct identifiers in order: capitals inside, an underscore or a dot. The dot test comes before dots at the end go."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_.]{2,})"), 1)
    kept = F.filter(found, lambda t: F.substring(t, 2, 1 << 30).rlike("[A-Z]") | t.contains("_") | t.contains("."))
    return F.array_distinct(F.transform(kept, lambda t: F.regexp_replace(t, r"\.+$", "")))


def class_name(text: Column) -> Column:
    return F.regexp_extract(text, r"class\s+([\p{L}\p{N}_]+)", 1)


def method_name(text: Column) -> Column:
    """The first name before an opening parenthesis that something like a type precedes."""
    return F.regexp_extract(text, r"(?:public|private|protected|static|internal|virtual|override|async)?\s*(?:[\p{L}\p{N}_<>,\s]+)\s+([\p{L}\p{N}_]+)\s*\(", 1)


def embed_text(title: Column, heading: Column, piece: Column) -> Column:
    """The piece under its title and heading, which is what gets embedded."""
    t, h = F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit(""))
    prefix = F.when((t != "") & (h != ""), F.concat(t, F.lit(" — "), h)).otherwise(t)
    return F.when(prefix != "", F.concat(prefix, F.lit("\n"), piece)).otherwise(piece)


def rows_to_markdown(rows: Column) -> Column:
    """A markdown table of an array of rows of cells: pipes escaped, ragged rows padded, empty rows dropped, rule added."""
    cell = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.aggregate(clean, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", r), F.lit(" |"))
    padded = F.transform(clean, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(clean) > 0, F.concat_ws("\n", F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, 1 << 30))).otherwise("")


def rect_overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Share of rectangle b that rectangle a covers; 0 where b has no area."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (bx1 - bx0) * (by1 - by0)
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))

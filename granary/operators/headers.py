"""Removal of running headers and footers from paged text."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import SPACE

# Which lines go depends on them.
HEAD, FOOT, RATIO, SIMILAR, MIN_PAGES = 5, 3, 0.7, 0.8, 3
PLACEHOLDER = "[图片占位符"
#: Lines of a tile of comparisons, classes of characters of the bound on a ratio, how much longer than another an alike line can be, and a little; steps of logarithms of lengths.
TILE, CLASSES, SPREAD, LOG = 512, 64, 1.51, 1_000_000


def alike(a: str, b: str, least: float = SIMILAR) -> bool:
    """Equal after trimming, or of a matching ratio of at least `least`; lengths half apart are never alike."""
    a, b = (a or "").strip(), (b or "").strip()
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 0.5 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def edge_lines(pages: DataFrame, head: int = HEAD, foot: int = FOOT) -> DataFrame:
    """(doc, page, line_no, line, place) of the first and last lines of pages (doc, page, text): h1, h2, ..., f1, f2, ... ."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), F.size(F.split("text", "\n")).alias("n"))
    from_top = F.when(F.col("line_no") < head, F.concat(F.lit("h"), F.col("line_no") + 1))
    from_end = F.when(F.col("n") - F.col("line_no") <= foot, F.concat(F.lit("f"), F.col("n") - F.col("line_no")))
    return lines.withColumn("place", F.explode(F.array_compact(F.array(from_top, from_end)))).drop("n")


def _classes(lines: list[str]) -> np.ndarray:
    """How many characters of each class a line has."""
    out = np.zeros((len(lines), CLASSES), np.int32)
    for i, line in enumerate(lines):
        np.add.at(out[i], np.frombuffer(line.encode("utf-32-le"), np.uint32) % CLASSES, 1)
    return out


def _compared(tile: pd.DataFrame) -> pd.DataFrame:
    """The asked lines of a tile with the pages of its other lines that are alike.

    A ratio is at most twice the characters that two lines share over their lengths; only where classes of characters
    allow it are lines compared in full. The asked line is the first of the two, as matching isn't symmetric.
    """
    text, n, band, asked = tile["text"].tolist(), tile["n"].to_numpy(), tile["band"].to_numpy(), tile["asked"].to_numpy(bool)
    bare, cell = [t.strip() for t in text], tile["cell"].iloc[0]
    count, size = _classes(bare), np.array([len(t) for t in bare])
    rows, more = np.flatnonzero(asked), []
    for i in rows:
        others = np.flatnonzero(~asked & (np.minimum(band, band[i]) == cell))
        shared = np.minimum(count[others], count[i]).sum(axis=1)
        at = others[2 * shared >= SIMILAR * (size[others] + size[i])]
        more.append(sum(int(n[j]) for j in at if text[j] != text[i] and alike(text[i], text[j])))
    return pd.DataFrame({c: np.array([tile[c].iloc[i] for i in rows], object) for c in ("doc", "place", "text")} | {"more": np.array(more, np.int64)})


def _size() -> Column:
    """Characters of a line without white space around it, as they are compared, and at least one."""
    return F.greatest(F.length(F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", "")), F.lit(1))


def _reachable(weighted: DataFrame, total: DataFrame) -> DataFrame:
    """weighted (doc, place, text, n) with asked: whether the pages of all lines of about its length, alike or not, are enough.

    Alike lines differ by at most SPREAD in length, so no line has more votes than lines within that have pages. This
    is asked of the numbers of pages by length, not of pairs.
    """
    by_size, reach = weighted.withColumn("size", _size()), math.ceil(math.log(SPREAD) * LOG)
    near = Window.partitionBy("doc", "place").orderBy(F.floor(F.log("size") * LOG)).rangeBetween(-reach, reach)
    most = by_size.groupBy("doc", "place", "size").agg(F.sum("n").alias("n")).withColumn("most", F.sum("n").over(near))
    enough = most.join(total, "doc").where(F.col("most") >= F.col("needed")).select("doc", "place", "size", F.lit(True).alias("asked"))
    return by_size.join(enough, ["doc", "place", "size"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))).drop("size")


def _alike_pages(weighted: DataFrame) -> DataFrame:
    """(doc, place, text, more): on how many pages other lines of the document and place are that are alike, of lines that are asked.

    Alike lines differ by at most SPREAD in length, so a line meets only its own band of lengths and the next one; a
    band's asked lines are dealt to blocks of about TILE, as are all its lines, and a block of one kind meets one of the
    other in a task. However many lines a document has at a place, no task holds more than two blocks; no pairs are
    emitted, and bands without asked lines go first.
    """
    key = ["doc", "place", "cell"]
    band = F.floor(F.log(_size()) / F.log(F.lit(SPREAD)) - F.lit(1e-9)).cast("int")
    lines = weighted.withColumn("band", band).withColumn("cell", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    blocks = lambda number: F.ceil(number / TILE).cast("int")
    sizes = lines.groupBy(*key).agg(blocks(F.count(F.lit(1))).alias("blocks"), blocks(F.count_if("asked")).alias("askers"), F.count(F.lit(1)).alias("lines")).where("askers > 0 AND lines > 1").drop("lines")
    dealt = lines.join(sizes, key).withColumn("h", F.xxhash64("text"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.col("h"), n).cast("int")
    columns = [*key, "band", "text", "n", "asked", "asker", "block"]
    asking = dealt.where("asked").withColumn("asker", own(F.col("askers"))).withColumn("block", every(F.col("blocks"))).select(*columns)
    met = dealt.withColumn("asked", F.lit(False)).withColumn("block", own(F.col("blocks"))).withColumn("asker", every(F.col("askers"))).select(*columns)
    schema = f"doc {weighted.schema['doc'].dataType.simpleString()}, place string, text string, more long"
    return asking.unionByName(met).groupBy(*key, "asker", "block").applyInPandas(_compared, schema).groupBy("doc", "place", "text").agg(F.sum("more").alias("more"))


def votes(edges: DataFrame, pages: DataFrame, fuzzy: bool = True, every: bool = True) -> DataFrame:
    """(doc, place, text, votes, needed): on how many pages a line is at a place, alike ones counted together if fuzzy.

    Lines are made distinct within a document and place first and weighted by their pages, so pages that all have the
    same footer compare once. Lines that begin with an image's placeholder have no vote. Not every: lines that cannot
    have as many votes as needed, by the lengths of all lines at their place, are left out and compared with none.
    """
    clean = edges.withColumn("text", F.trim("line")).where((F.col("text") != "") & ~F.col("text").startswith(PLACEHOLDER))
    weighted = clean.groupBy("doc", "place", "text").agg(F.countDistinct("page").alias("n"))
    total = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    needed = F.greatest(F.lit(2), F.floor(F.col("pages") * RATIO)).cast("long")
    if fuzzy:
        weighted = weighted.join(total.select("doc"), "doc", "left_semi")
        weighted = weighted.withColumn("asked", F.lit(True)) if every else _reachable(weighted, total.withColumn("needed", needed))
        weighted = weighted.where("asked").join(_alike_pages(weighted), ["doc", "place", "text"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    return weighted.join(total, "doc").select("doc", "place", "text", F.col("n").alias("votes"), needed.alias("needed"))


def strip_headers(pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """pages (doc, page, text) without lines that enough pages have at the same place, and without page numbers there.

    Documents of fewer than three pages stay as they are.
    """
    edges = edge_lines(pages)
    often = votes(edges, pages, fuzzy, every=False).where(F.col("votes") >= F.col("needed")).select("doc", "place", "text")
    long = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("doc")
    marked = edges.withColumn("text", F.trim("line"))
    number = marked.where(F.col("text").rlike(r"^[0-9]+$")).join(long, "doc", "left_semi").select("doc", "page", "line_no")
    gone = marked.join(often, ["doc", "place", "text"], "left_semi").select("doc", "page", "line_no").unionByName(number).groupBy("doc", "page").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return pages.join(gone, ["doc", "page"], "left").withColumn("text", F.array_join(kept, "\n")).drop("gone")


def without_covered(blocks: DataFrame, tables: DataFrame, least: float = 0.5) -> DataFrame:
    """Text blocks (page, x0, y0, x1, y1) that no table rectangle of the page covers by at least half, in reading order."""
    from granary.functions.text import rect_overlap

    # Equal rectangles are compared once, however many a page has.
    place = ["page", "x0", "y0", "x1", "y1"]
    b, t = blocks.select(*place).distinct().alias("b"), tables.select(*place).distinct().alias("t")
    over: Column = rect_overlap(*[F.col(f"t.{c}") for c in ("x0", "y0", "x1", "y1")], *[F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")])
    covered = b.join(t, (F.col("b.page") == F.col("t.page")) & (over >= least), "left_semi")
    kept = blocks.join(covered, place, "left_anti").select(*blocks.columns)
    return kept.withColumn("reading_order", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", *(["id"] if "id" in blocks.columns else []))))

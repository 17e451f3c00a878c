"""Corpus files as DataFrames: scans, format dispatch, sidecars, states, exported artifacts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import meta
from granary.functions import text as T
from granary.operators import chunking

SUFFIXES = (".md", ".pdf", ".docx", ".txt")
ARTIFACT_SUFFIXES = (".md", ".yaml", ".yml", ".json", ".qlp", ".txt")


def readable() -> tuple[str, ...]:
    """The suffixes that there are readers for: PDF only with its library, so that no PDF passes for read without."""
    from importlib.util import find_spec

    return SUFFIXES if find_spec("fitz") is not None else tuple(s for s in SUFFIXES if s != ".pdf")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(path, content, modified, size, hash, suffix) of readable files under a folder; office lock files, backups and assets don't count."""
    suffixes = suffixes or readable()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = T.basename(F.col("path"))
    kept = files.withColumn("suffix", T.extension(F.col("path"))).where(F.col("suffix").isin(*suffixes) & ~name.startswith("~$") & ~F.lower("path").rlike(r"/assets/|\.bak$"))
    return kept.select("path", "content", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.md5("content").alias("hash"), "suffix")


def texts(files: DataFrame, suffix: str) -> DataFrame:
    """(source, text) of the files of a suffix, read as UTF-8 with marks for what isn't."""
    return files.where(F.col("suffix") == suffix).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_sections(content: bytes) -> list[tuple[str, str, bool]]:
    """(heading, text, has_image) of a word document: body in order, Heading 1 to 3 begin sections, tables as markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out: list[list] = [["", [], False]]
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").replace(" ", "").lower() if style is not None else ""
            line = said(node).strip()
            out[-1][2] |= next(node.iter(f"{_W}drawing"), None) is not None
            if name in ("heading1", "heading2", "heading3") and line:
                out.append([line, [], False])
            elif line:
                out[-1][1].append(line)
        elif node.tag == f"{_W}tbl":
            rows = [[said(c).strip().replace("|", "\\|").replace("\n", " ") for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"  # noqa: B023, E731
                out[-1][1].append("\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]))
    return [(h, "\n".join(lines), image) for h, lines, image in out if lines or h or image]


def _docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["source", "file_hash", "chunk_index", "heading", "body", "has_image"]
    for frame in frames:
        rows = []
        for source, content, h in zip(frame["path"], frame["content"], frame["hash"], strict=True):
            try:
                found = docx_sections(content)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                found = []  # not a word document
            rows += [(source, h[:8], i, *s) for i, s in enumerate(found)]
        yield pd.DataFrame(rows, columns=columns)


def _pdf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import fitz  # only where a PDF library is installed

    for frame in frames:
        rows = []
        for source, content, h in zip(frame["path"], frame["content"], frame["hash"], strict=True):
            with fitz.open(stream=content, filetype="pdf") as doc:
                rows += [(source, h[:8], page.number, page.get_text(), bool(page.get_images())) for page in doc]
        yield pd.DataFrame(rows, columns=["source", "file_hash", "page", "text", "has_image"])


def paged_chunks(sections: DataFrame) -> DataFrame:
    """Chunks of (source, file_hash, chunk_index, heading, body, has_image), one section a row."""
    body = F.trim("body")
    kept = sections.where((F.length(body) >= T.SHELL_CHARS) | F.col("has_image"))

    @F.udf("array<string>", useArrow=True)
    def packed(text: str) -> list[str]:
        return chunking.pack_blocks(text) if text else []

    marked = F.when(F.col("has_image"), F.concat(body, F.lit("\n[图]"))).otherwise(body)
    parts = kept.select("*", F.posexplode(packed(marked)).alias("chunk_part", "piece")).where(F.col("has_image") | (T.meaningful_length(F.col("piece")) >= T.SHELL_CHARS))
    empty = F.lit("")
    return chunking._finished(
        parts.select(
            "piece", "heading", empty.alias("heading_path"), "source", F.regexp_replace(T.basename(F.col("source")), r"\.[^.]+$", "").alias("title"), "chunk_index", "chunk_part", "has_image",
            F.lit(False).alias("is_toc"), F.array().cast("array<string>").alias("image_refs"), empty.alias("image_captions"), empty.alias("image_caption_source"), "file_hash", F.substring(body, 1, 2 * meta.PREVIEW).alias("preview"),
        )
    )


def chunks(files: DataFrame, pdf: bool | None = None) -> DataFrame:
    """Chunks of all scanned files, each by its format. PDF needs a library that isn't part of the environment."""
    docx = files.where("suffix = '.docx'").select("path", "content", "hash").mapInPandas(_docx, "source string, file_hash string, chunk_index int, heading string, body string, has_image boolean")
    out = chunking.markdown_chunks(texts(files, ".md")).unionByName(chunking.text_chunks(texts(files, ".txt"))).unionByName(paged_chunks(docx))
    if pdf is None:
        pdf = ".pdf" in readable()
    if pdf:
        from granary.operators.headers import strip_headers

        pages = files.where("suffix = '.pdf'").select("path", "content", "hash").mapInPandas(_pdf, "source string, file_hash string, page int, text string, has_image boolean")
        clean = strip_headers(pages.withColumnRenamed("source", "doc")).withColumnRenamed("doc", "source")
        out = out.unionByName(paged_chunks(clean.select("source", "file_hash", F.col("page").alias("chunk_index"), F.lit("").alias("heading"), F.col("text").alias("body"), "has_image")))
    return out


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(source, keys): flat keys of the .meta.yaml file next to a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.yaml").load(folder)
    return files.select(F.regexp_replace("path", r"\.meta\.yaml$", "").alias("source"), T.flat_yaml(F.decode("content", "UTF-8")).alias("keys"))


def with_front_matter(files: DataFrame) -> DataFrame:
    """(source, text) with keys: flat keys of the front matter, null where there is none."""
    return files.withColumn("keys", F.when(T.front_matter(F.col("text")).isNotNull(), T.flat_yaml(T.front_matter(F.col("text")))))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text) of exported artifacts with a recognised name."""
    files = scan(spark, folder, ARTIFACT_SUFFIXES)
    return files.select("path", meta.artifact_kind(F.col("path")).alias("kind"), F.decode("content", "UTF-8").alias("text")).where("kind is not null")


def json_state(spark: SparkSession, path: str) -> DataFrame:
    """A state file {path: {hash, chunks, ...}} as rows; entries that aren't objects go."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    rows = raw.select(F.explode(entries).alias("key", "entry")).where(F.col("entry").startswith("{"))
    get = lambda k: F.get_json_object("entry", f"$.{k}")
    return rows.select(F.col("key").alias("path"), get("rel_path").alias("rel_path"), get("hash").alias("hash"), get("chunks").try_cast("int").alias("chunks"), get("parser_version").alias("parser_version"))


def write_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Writes (path, text) as text rows by path below a folder and returns what was written."""
    docs.select("path", "text").write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder)

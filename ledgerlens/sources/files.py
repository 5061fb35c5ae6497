"""Files of case folders: listing and triage, text pages, hashes, case discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import readable_chars

# Kinds of files by extension, and names that are no case folder.
KINDS = {"pdf": (".pdf",), "text": (".txt", ".md", ".log", ".csv", ".tsv"), "image": (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")}
IGNORED = (".ds_store", ".tmp", ".bak", ".swp", ".lock")
NOISE_DIRS = (".venv", "venv", "env", ".env", "node_modules", ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode", ".cursor", "build", "dist", ".tox", "site-packages", "smoke_pages")
NOISE_SUFFIXES = (".dist-info", ".egg-info")
PROJECT_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "gemfile", "dockerfile", "makefile")

LEAST_CASE_FILES, LEAST_PAGE_CHARS, SCANNED_CHARS = 2, 40, 120


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' if the name has none or is only one."""
    return F.regexp_extract(F.lower(file_name(path)), r"^.+?(\.[^.]*)$", 1)


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def triage(paths: DataFrame) -> DataFrame:
    """paths.path with kind ('pdf', 'text', 'image'), null and a reason for what is skipped; hidden and ignored files have no row."""
    p, e = F.col("path"), extension(F.col("path"))
    kind = None
    for k, es in KINDS.items():
        kind = F.when(e.isin(*es), k) if kind is None else kind.when(e.isin(*es), k)
    shown = F.when(e == "", "(no extension)").otherwise(e)
    reason = F.when(kind.isNull(), F.concat(F.lit("unsupported file type '"), shown, F.lit("'")))
    return paths.where(~file_name(p).startswith(".") & ~e.isin(*IGNORED)).select(*paths.columns, kind.alias("kind"), reason.alias("reason"))


def case_folders(paths: DataFrame, least: int = LEAST_CASE_FILES) -> DataFrame:
    """Folders with ``least`` or more readable files that are neither noise nor a project: folder, n_files."""
    parts = F.split(F.col("path"), "/")
    noise = F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda s: s.isin(*NOISE_DIRS) | s.endswith(NOISE_SUFFIXES[0]) | s.endswith(NOISE_SUFFIXES[1]))
    readable = extension(F.col("path")).isin([e for es in KINDS.values() for e in es]) & ~file_name(F.col("path")).startswith(".")
    marked = F.lower(file_name(F.col("path"))).isin(*PROJECT_FILES)
    per = paths.where(~noise).groupBy(folder(F.col("path")).alias("folder")).agg(F.count_if(readable).alias("n_files"), F.max(marked).alias("project"))
    return per.where((F.col("n_files") >= least) & ~F.col("project")).select("folder", "n_files")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root``: path, content, content_id (first 16 hex digits of the SHA-256)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.regexp_replace("path", "^file:", "").alias("path"), "content", content_id(F.col("content")).alias("content_id"))


def content_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def decoded(files: DataFrame, *more: str) -> DataFrame:
    """path, content_id, the columns ``more``, text: UTF-8 with or without mark, else Windows-1252, else Latin-1.

    Only files that are not UTF-8 leave the JVM.
    """
    keep = ["path", "content_id", *more]
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    plain = files.where(ok).select(*keep, F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("text"))

    def run(batches):
        for pdf in batches:
            texts = []
            for b in pdf["content"]:
                try:
                    texts.append(bytes(b).decode("cp1252"))
                except UnicodeDecodeError:
                    texts.append(bytes(b).decode("latin-1"))
            yield pdf[keep].assign(text=texts)

    rest = files.where(~ok).select(*keep, "content")
    return plain.unionByName(rest.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rest.dtypes if n != "content") + ", text string"))


def pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pages of a text, cut at form feeds: the columns of ``docs`` without the text, page_number, page_text."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f")).alias("i", "page_text")).select(*keep, (F.col("i") + 1).alias("page_number"), "page_text")


def joined_pages(pages_: DataFrame, key: str) -> DataFrame:
    """Text of a document from its pages, each under ``[page n]``: key, n_pages, full_text, scanned.

    A page with fewer than 40 readable characters gives its recognised text, ``ocr_text`` if there
    is such a column. A document is a scan if its pages have below 120 readable characters on average.
    """
    n = readable_chars(F.col("page_text"))
    ocr = F.coalesce(F.col("ocr_text"), F.lit("")) if "ocr_text" in pages_.columns else F.lit("")
    shown = F.when(n >= LEAST_PAGE_CHARS, F.col("page_text")).otherwise(ocr)
    one = F.struct("page_number", F.concat(F.lit("[page "), F.col("page_number").cast("string"), F.lit("]\n"), shown).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"])
    return pages_.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(texts, "\n\n").alias("full_text"), (F.sum(n) / F.count(F.lit(1)) < SCANNED_CHARS).alias("scanned"))

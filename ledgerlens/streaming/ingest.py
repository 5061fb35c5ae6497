"""Continuous ingest: files that arrive in case folders, and references that arrive before their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.exprs import readable_chars
from ledgerlens.operators.classify import classify_document
from ledgerlens.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """A stream of the files under ``root``: path, modified_at, content_id, content."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return raw.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("modificationTime").alias("modified_at"), files.content_id(F.col("content")).alias("content_id"), "content")


def classified(arriving: DataFrame) -> DataFrame:
    """Text files of a stream, decoded as in the batch path, with their type; no state is kept."""
    texts = files.decoded(files.triage(arriving).where("kind = 'text'"), "modified_at")
    c = classify_document(F.col("text"), files.file_name(F.col("path")))
    return texts.select(
        files.folder(F.col("path")).alias("case_id"), "path", "modified_at", "content_id", c["doc_type"].alias("doc_type"), c["confidence"].alias("confidence"), readable_chars(F.col("text")).alias("n_readable"))


def distinct_contents(arriving: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each content once within ``delay``; the watermark bounds the state that is kept."""
    return arriving.withWatermark("modified_at", delay).dropDuplicatesWithinWatermark(["content_id"])


def arrivals_per_window(stream: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Files per type and window of arrival; files later than ``delay`` are left out."""
    return stream.withWatermark("modified_at", delay).groupBy(F.window("modified_at", window), "doc_type").agg(F.count(F.lit(1)).alias("n_files"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to parquet, and stop; each file is written once even if a run is repeated."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).outputMode("append").start()


def resolve_references(refs: DataFrame, parents: DataFrame, delay: str = "30 days") -> DataFrame:
    """References (key, ref_id, ref_at) joined to parents (key, live_at) that come within ``delay``; null where none came in time.

    Both sides are watermarked, so that the state of a reference is dropped when its time is over.
    """
    r, p = refs.withWatermark("ref_at", delay).alias("r"), parents.withWatermark("live_at", delay).alias("p")
    near = F.expr(f"p.live_at BETWEEN r.ref_at - INTERVAL {delay} AND r.ref_at + INTERVAL {delay}")
    return r.join(p, (F.col("r.key") == F.col("p.key")) & near, "leftOuter").select("r.key", "r.ref_id", "r.ref_at", "p.live_at")

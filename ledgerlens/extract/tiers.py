"""Extraction ladders: cheap tiers first, dear ones only for what is still open.

A tier maps a frame of documents to a frame of results with the same key; what has no result goes
to the next tier. Open rows are filtered before the next tier, as Spark runs a Python function on
all rows of a conditional. Recognition, vision and language models are tiers with an engine that is
handed in; none is called unless given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut


@dataclass(frozen=True)
class Tier:
    """name: method recorded with the result. run: documents to results. confidence: of its results."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    confidence: float


def ladder(docs: DataFrame, key: str, tiers: list[Tier]) -> DataFrame:
    """Results of the first tier that has any for a document, with ``extraction_method`` and ``extraction_confidence``.

    Documents that no tier resolves have no row. Each tier's results are checkpointed, so that a
    dear tier runs once.
    """
    out, rest = None, docs
    for t in tiers:
        got = cut(t.run(rest))
        marked = got.withColumns({"extraction_method": F.lit(t.name), "extraction_confidence": F.lit(t.confidence)})
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
        rest = rest.join(got.select(key).distinct(), key, "left_anti")
    return out


def once_per_content(docs: DataFrame, content: str, run: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """``run`` on one document of each distinct content, its results joined back to every document of it.

    ``run`` takes (content_id, content) and returns rows with content_id.
    """
    named = docs.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("content_id"), F.col(content).alias("content"))
    first = named.groupBy("content_id").agg(F.first("content").alias("content"))
    return named.select(key, "content_id").join(run(first), "content_id").drop("content_id")

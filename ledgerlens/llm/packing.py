"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An example has a size in tokens, segments and loss-bearing tokens; a container has a limit on
each. A container is filled by always placing the example that fits and whose sizes have the
greatest dot product with the room that is left, each as a share of its limit. Examples of equal
sizes are interchangeable, so a bin is packed over its distinct sizes with their counts. Documents
are dealt by a hash of their id, piece and copy to groups of a bounded number of rows, which are
packed apart in the order of these, so that the containers depend on the documents alone; the
containers that stay below ``full`` are taken apart and packed again in ever fewer groups.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut


@dataclass(frozen=True)
class PackingSettings:
    """capacity: tokens of a container. segments: most examples in one. loss_tokens: most loss-
    bearing tokens in one. group_rows: rows that are packed together. full: share of the capacity
    from which a container is kept in the first rounds. rounds: how often the others are repacked."""

    capacity: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    group_rows: int = 20_000
    full: float = 0.999
    rounds: int = 2


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary that documents are measured with: LEDGERLENS_VOCABULARY, else the installed one."""
    return os.environ.get("LEDGERLENS_VOCABULARY") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ledgerlens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, loss_tokens: tokens of the whole text; texts without prose (lang 'zxx') bear no loss.

    Null and empty texts have no token.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc = _encoder(path, SPLIT_PATTERN)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]
            loss = np.where(pdf["lang"] == "zxx", 0, n)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "loss_tokens": loss})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInPandas(run, "doc_id long, n_tokens int, loss_tokens int")


def pack_classes(sizes: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> list[list[tuple[int, int]]]:
    """Containers as lists of (class, number of examples), for classes of examples with equal ``sizes``.

    ``sizes`` is (classes, dimensions), every class fits an empty container. Ties go to the class
    with more tokens (first dimension), then to the first one.
    """
    left = counts.astype(np.int64).copy()
    share = sizes / limits
    order = np.lexsort((np.arange(len(sizes)), -sizes[:, 0]))
    out = []
    live = order[left[order] > 0]
    while len(live):
        room = limits.astype(np.int64).copy()
        content: dict[int, int] = {}
        while True:
            fits = (sizes[live] <= room).all(axis=1) & (left[live] > 0)
            if not fits.any():
                break
            score = np.where(fits, share[live] @ (room / limits), -1.0)
            c = int(live[int(score.argmax())])
            content[c] = content.get(c, 0) + 1
            room -= sizes[c]
            left[c] -= 1
        # the same filling again as long as its classes last
        again = min(int(left[c]) // k for c, k in content.items())
        for _ in range(again + 1):
            out.append(list(content.items()))
        for c, k in content.items():
            left[c] -= again * k
        live = live[left[live] > 0]
    return out


def pack_group(tokens: np.ndarray, loss: np.ndarray, s: PackingSettings) -> tuple[np.ndarray, np.ndarray]:
    """(container of each example, tokens of each container)."""
    sizes = np.stack([tokens, np.ones_like(tokens), loss], axis=1).astype(np.int64)
    classes, member = np.unique(sizes, axis=0, return_inverse=True)
    member = member.ravel()
    counts = np.bincount(member, minlength=len(classes))
    limits = np.array([s.capacity, s.segments, s.loss_tokens], dtype=np.int64)
    rows = np.argsort(member, kind="stable")
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    container, fill = np.empty(len(tokens), dtype=np.int64), []
    for k, content in enumerate(pack_classes(classes, counts, limits)):
        used = 0
        for c, n in content:
            container[rows[at[c] : at[c] + n]] = k
            at[c] += n
            used += int(classes[c, 0]) * n
        fill.append(used)
    return container, np.array(fill, dtype=np.int64)


PIECES = "doc_id long, piece int, token_start int, n_tokens int, loss_tokens int"


def _packer(s: PackingSettings, k: int, last: bool):
    """Packs one group in round ``k``; examples of containers that are not kept get -1."""

    def pack(pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens", "loss_tokens", "copy"], kind="stable", ignore_index=True)
        container, fill = pack_group(pdf["n_tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), s)
        keep = (fill >= s.full * s.capacity) | last
        ids = (np.int64(k) << 56) + (pdf["g"].to_numpy().astype(np.int64) << 24) + container
        return pdf.drop(columns="g").assign(container_id=np.where(keep[container], ids, -1))

    return pack


def pack_documents(sizes: DataFrame, s: PackingSettings = PackingSettings()) -> DataFrame:
    """Container of every document: doc_id, piece, token_start, n_tokens, loss_tokens, container_id.

    A document is split only if it alone exceeds the capacity, or alone bears more loss than a
    container may; then into pieces as long as possible. Documents without tokens take a segment
    and no room. Null ids and repeated rows are examples of their own. Empty tables give no rows.
    ``sizes`` is that of ``token_sizes``; a null size is none.
    """
    lossy = F.least(F.coalesce("loss_tokens", F.lit(0)), F.col("n"))
    sized = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), "loss_tokens").select("doc_id", "n", lossy.alias("loss"))
    # loss is spread over the tokens of a split document
    most = F.when(F.col("loss") > s.loss_tokens, F.least(F.lit(s.capacity), F.floor(F.lit(s.loss_tokens) * F.col("n") / F.col("loss")).cast("int"))).otherwise(F.lit(s.capacity))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most).cast("int"))
    start = (F.col("piece") - 1) * F.col("most")
    upto = F.least(F.col("n"), F.col("piece") * F.col("most"))
    loss_at = lambda x: F.when(F.col("n") > 0, F.floor(x * F.col("loss") / F.col("n"))).otherwise(0)
    pieces = sized.select("*", most.alias("most")).select("*", F.explode(F.sequence(F.lit(1), parts)).alias("piece")).select(
        "doc_id", "piece", start.cast("int").alias("token_start"), (upto - start).cast("int").alias("n_tokens"),
        F.least(F.lit(s.loss_tokens), loss_at(upto) - loss_at(start)).cast("int").alias("loss_tokens"))
    # equal rows are numbered as copies, so that they are dealt apart and alike in every run
    counted = pieces.groupBy("doc_id", "piece", "token_start", "n_tokens", "loss_tokens").agg(F.count(F.lit(1)).alias("copies"))
    open_rows = cut(counted.select("doc_id", "piece", "token_start", "n_tokens", "loss_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
    done = None
    for k in range(s.rounds + 1):
        n = open_rows.count()
        groups = max(1, -(-n // s.group_rows))
        last = k == s.rounds or groups == 1
        dealt = open_rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "loss_tokens", "copy", F.lit(k)), F.lit(groups)))
        packed = cut(dealt.groupBy("g").applyInPandas(_packer(s, k, last), PIECES + ", copy int, container_id long"))
        kept = packed.where("container_id >= 0")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        open_rows = packed.where("container_id < 0").drop("container_id")
    return done.select("doc_id", "piece", "token_start", "n_tokens", "loss_tokens", "container_id")


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers by the number of their tokens, and the room that stays unused."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"))
    return per.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.max("segments").alias("most_segments"), (F.lit(capacity) - F.col("tokens")).alias("unused"))


def limits_report(packed: DataFrame, s: PackingSettings) -> DataFrame:
    """One row: containers, how many are full by each limit (no room for a hundredth of it), and how many exceed one."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss"))
    at = {"tokens": s.capacity, "segments": s.segments, "loss": s.loss_tokens}
    over = F.lit(False)
    for c, most in at.items():
        over = over | (F.col(c) > most)
    return per.agg(F.count(F.lit(1)).alias("n_containers"), *(F.count_if(F.col(c) > 0.99 * most).alias(f"full_by_{c}") for c, most in at.items()), F.count_if(over).alias("n_over"))


def packing_check(documents: DataFrame, packed: DataFrame, s: PackingSettings = PackingSettings()) -> DataFrame:
    """One row: documents that are packed, pieces whose tokens do not follow on from the piece before, documents split without need, containers over a limit."""
    per_doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.sum("loss_tokens").alias("loss"), F.max(F.col("token_start") + F.col("n_tokens")).alias("upto"))
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id")).join(per_doc, "doc_id")
    needless = (F.col("pieces") > 1) & (F.col("tokens") <= s.capacity) & (F.col("loss") <= s.loss_tokens)
    seen = every.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("upto") != F.col("tokens")).alias("n_torn"), F.count_if(needless).alias("n_needless_splits"))
    return seen.crossJoin(limits_report(packed, s).select("n_over"))  # one row each

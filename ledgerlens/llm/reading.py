"""Reading level of each document: harmonic propagation over a document-word graph.

Documents are joined to the words they hold; graded documents are clamped to their mean grade. A
word takes the weighted mean of its documents. A document takes the mean of its main prose: its
sentences, each the mean of its words weighted by how far they stand from the overall mean, are put
in order and the middle of the text counts, so that tables, headers, clauses and inserted
passages do not move it. This is iterated until the words' values settle; the level of a document
is read from the value of its node.

Words are hashed to a fixed number of nodes; the values of the word nodes, which every worker
reads, therefore have a proven size whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut

_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=- )")
_HYPHEN = re.compile(r"-\n(?=[a-z])")
_WORD = re.compile(r"\x01|[^\W\d_]+(?:'[^\W\d_]+)?")
_QUOTE = re.compile(r"(?<![a-z])'|'(?![a-z])")
#: Letters, apostrophes and the mark between sentences; everything else is a space.
_ASCII = bytes(i if chr(i).isalpha() and i < 128 or i in (1, 39) else 32 for i in range(256))


@dataclass(frozen=True)
class ReadingSettings:
    """word_nodes: nodes that words are hashed to. settled: greatest change of a word's value, in
    levels, at which the iteration ends, and most_rounds: after which it is an error. ungraded: weight of an ungraded
    document's value in a word against 1 of a graded one. prior: weight of the overall mean in a
    word. least_words: words of a sentence that counts as prose. middle: share of a document's
    prose that counts, around its median (0.2 to 0.5 agree with held-out raters alike). target_words: words of a document that gets a level."""

    word_nodes: int = 1 << 18
    settled: float = 0.01
    most_rounds: int = 100
    ungraded: float = 0.1
    prior: float = 0.5
    least_words: int = 4
    middle: float = 0.3
    levels: int = 5
    target_words: int = 60


def marked_words(text: str) -> list[str]:
    """Words in lower case; \x01 stands between sentences."""
    t = text.lower().replace("\x01", " ")
    if "-\n" in t:
        t = _HYPHEN.sub("", t)
    t = _SENTENCE.sub(" \x01 ", t)
    if not t.isascii():
        return _WORD.findall(t)
    if "'" in t:
        t = _QUOTE.sub(" ", t)
    return t.encode("ascii").translate(_ASCII).decode("ascii").split()


def sentence_edges(texts: list[list[int]], least: int) -> list[bytes]:
    """Per text its sentences as int32: their number, sizes, and distinct word nodes.

    ``texts`` holds word nodes with -1 between sentences; sentences of fewer than ``least`` words are
    left out. A node that an earlier sentence of the text has is stored as its complement.
    """
    length = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.fromiter((x for t in texts for x in t), dtype=np.int64, count=int(length.sum()))
    doc = np.repeat(np.arange(len(texts)), length)
    starts = flat < 0
    starts[(np.cumsum(length) - length)[length > 0]] = True
    sentence = np.cumsum(starts) - 1
    words = flat >= 0
    doc, sentence, flat = doc[words], sentence[words], flat[words]
    long = np.bincount(sentence, minlength=1)[sentence] >= least if len(sentence) else np.zeros(0, bool)
    doc, sentence, flat = doc[long], sentence[long], flat[long]
    _, at = np.unique((sentence << 32) | flat, return_index=True)  # one edge per sentence and word
    doc, sentence, flat = doc[at], sentence[at], flat[at]
    _, at = np.unique((doc.astype(np.int64) << 32) | flat, return_index=True)
    first = np.zeros(len(flat), dtype=bool)
    first[at] = True
    stored = np.where(first, flat, ~flat).astype(np.int32)
    edge = np.flatnonzero(np.diff(sentence, prepend=-1))
    size = np.diff(np.append(edge, len(sentence))).astype(np.int32)
    sentences = np.bincount(doc[edge], minlength=len(texts)) if len(edge) else np.zeros(len(texts), np.int64)
    words = np.bincount(doc, minlength=len(texts))
    s_end, w_end = np.cumsum(sentences), np.cumsum(words)
    return [np.concatenate([[n], size[b - n : b], stored[e - m : e]]).astype(np.int32).tobytes() for n, b, m, e in zip(sentences, s_end, words, w_end)]


@dataclass
class Batch:
    """The sentences of a batch of documents end to end: the document and size of each sentence, the node of each edge, and whether it is its document's first with that node."""

    n: int
    doc: np.ndarray
    size: np.ndarray
    node: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, blobs) -> Batch:
        length = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
        raw = np.frombuffer(b"".join(blobs), np.int32)
        at = np.cumsum(length) - length
        n = raw[at] if len(at) else np.zeros(0, np.int32)
        place = np.arange(len(raw)) - np.repeat(at, length)
        held = np.repeat(n, length)
        stored = raw[place > held]
        return cls(len(length), np.repeat(np.arange(len(length)), n), raw[(place > 0) & (place <= held)].astype(np.int64), np.where(stored < 0, ~stored, stored), stored >= 0)

    def values(self, value: np.ndarray, weight: np.ndarray, middle: float) -> np.ndarray:
        """The value of each document: the mean over the middle of its sentences in order of theirs; nan without prose."""
        out = np.full(self.n, np.nan)
        if not len(self.size):
            return out
        edge = np.cumsum(self.size) - self.size
        w = weight[self.node]
        x = np.add.reduceat(w * value[self.node], edge) / np.add.reduceat(w, edge)
        order = np.lexsort((x, self.doc))
        doc, x, size = self.doc[order], x[order], self.size[order].astype(float)
        total = np.bincount(doc, weights=size, minlength=self.n)
        upto = np.cumsum(size) - np.repeat(np.cumsum(total) - total, np.bincount(doc, minlength=self.n))
        low, high = (1 - middle) / 2 * total[doc], (1 + middle) / 2 * total[doc]
        counts = np.clip(np.minimum(upto, high) - np.maximum(upto - size, low), 0, None)
        on = np.flatnonzero(total)
        out[on] = (np.bincount(doc, weights=counts * x, minlength=self.n)[on]) / np.bincount(doc, weights=counts, minlength=self.n)[on]
        return out


def document_word_graph(documents: DataFrame, grades: DataFrame, s: ReadingSettings = ReadingSettings()) -> DataFrame:
    """doc_id, n_words, edges, grade: the sentences of each document as lists of word nodes.

    ``grade`` is the mean over the raters, null for an ungraded document.
    """
    nodes = s.word_nodes

    class Nodes(dict):
        def __missing__(self, w: str) -> int:
            if len(self) > 500_000:
                self.clear()
            self[w] = n = -1 if w == "\x01" else zlib.crc32(w.encode("utf-8", "surrogatepass")) % nodes
            return n

    def build(batches):
        node = Nodes()
        for pdf in batches:
            texts = [list(map(node.__getitem__, marked_words(t))) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [len(t.split()) for t in pdf["text"]], "edges": sentence_edges(texts, s.least_words)})

    texts = documents.where((F.col("lang") == "en") & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mean = grades.where(F.col("reading_level").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("reading_level").alias("grade"))
    return cut(texts.mapInPandas(build, "doc_id long, n_words int, edges binary").join(mean, "doc_id", "left"))


def propagate(graph: DataFrame, s: ReadingSettings = ReadingSettings()) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(value and weight of the word nodes, greatest change of a value in each round).

    Each round is one pass: documents take their value from the words as they stand, and hand
    sums per word node, added up within the partition before they are shuffled. A document's
    value is put on the scale of the grades by the regression of the grades on the graded
    documents' values. In the first round only the graded documents speak.
    """
    nodes = s.word_nodes
    mean = graph.agg(F.avg("grade")).first()[0]
    mean = (1 + s.levels) / 2 if mean is None else mean
    value, weight, line = np.full(nodes, mean), np.ones(nodes), None
    changes: list[float] = []
    graded = graph.where(F.col("grade").isNotNull())
    for _ in range(s.most_rounds):

        def one_pass(batches, value=value, weight=weight, line=line):
            num, den = np.zeros(nodes), np.zeros(nodes)
            for pdf in batches:
                b = Batch.of(pdf["edges"])
                x, c = pdf["grade"].to_numpy(dtype=float), np.ones(len(pdf))
                if line is not None:
                    free = np.isnan(x)
                    x = np.where(free, np.clip(line[0] * b.values(value, weight, s.middle) + line[1], 1.0, s.levels), x)
                    c[free] = s.ungraded
                c[np.isnan(x)] = 0.0
                doc = np.repeat(b.doc, b.size)[b.first]
                node = b.node[b.first]
                num += np.bincount(node, weights=(c * np.nan_to_num(x))[doc], minlength=nodes)
                den += np.bincount(node, weights=c[doc], minlength=nodes)
            on = np.flatnonzero(den)
            yield pd.DataFrame({"node": on, "num": num[on], "den": den[on]})

        sums = (graded if line is None else graph).select("edges", "grade").mapInPandas(one_pass, "node int, num double, den double")
        got = sums.groupBy("node").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).toPandas()  # at most word_nodes rows
        num, den = np.zeros(nodes), np.zeros(nodes)
        num[got["node"]], den[got["node"]] = got["num"], got["den"]
        new = (num + s.prior * mean) / (den + s.prior)
        changes.append(float(np.abs(new - value).max()))
        value, weight = new, (new - mean) ** 2 + 0.02
        if changes[-1] <= s.settled:
            return value, weight, changes
        line = _regression(graded, value, weight, s)
    raise RuntimeError(f"word values did not settle in {s.most_rounds} rounds")


def _regression(graded: DataFrame, value: np.ndarray, weight: np.ndarray, s: ReadingSettings) -> tuple[float, float]:
    """Slope and intercept of the grades on the values of the graded documents."""

    def raw(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": Batch.of(pdf["edges"]).values(value, weight, s.middle), "y": pdf["grade"]})

    pairs = graded.select("edges", "grade").mapInPandas(raw, "x double, y double").where(~F.isnan("x"))
    slope, at = pairs.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
    return (1.0, 0.0) if slope is None or np.isnan(slope) else (slope, at)


def document_values(graph: DataFrame, value: np.ndarray, weight: np.ndarray, s: ReadingSettings = ReadingSettings()) -> DataFrame:
    """doc_id, n_words, grade, score: the value of each document's node, of graded ones as if they were not."""

    def score(batches):
        for pdf in batches:
            yield pdf[["doc_id", "n_words", "grade"]].assign(score=Batch.of(pdf["edges"]).values(value, weight, s.middle))

    return graph.mapInPandas(score, "doc_id long, n_words int, grade double, score double")


def cut_points(scored: DataFrame, s: ReadingSettings = ReadingSettings(), bins: int = 1000) -> list[float]:
    """Scores that part the levels with the fewest graded documents on the wrong side.

    Read from a histogram of all graded documents, which has at most ``bins`` times twice the levels
    rows. Ties take the middle of the tied cut points; a level without grades leaves the middle
    between its numbers.
    """
    width = (s.levels - 1) / bins
    hist = scored.where(F.col("grade").isNotNull() & ~F.isnan("score")).groupBy(
        F.floor((F.col("score") - 1) / width).cast("long").alias("bin"), F.round(F.col("grade") * 2).cast("int").alias("twice")
    ).agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((bins + 2, 2 * s.levels + 2))
    for r in hist:
        n[min(max(r["bin"], 0), bins) + 1, min(max(r["twice"], 0), 2 * s.levels + 1)] += r["n"]
    out = []
    for k in range(1, s.levels):
        # the neighbours of the cut decide; farther grades would only add what no cut can part
        low, high = n[:, max(0, 2 * k - 1) : 2 * k + 1].sum(axis=1), n[:, 2 * k + 2 : 2 * k + 4].sum(axis=1)
        if not low.sum() or not high.sum():
            out.append(k + 0.5)
            continue
        wrong = low.sum() - np.cumsum(low) + np.cumsum(high)  # low above the cut, high below it
        best = np.flatnonzero(wrong == wrong.min())
        out.append(1 + width * float(np.mean(best)))
    return list(np.maximum.accumulate(out))


def reading_levels(documents: DataFrame, grades: DataFrame, s: ReadingSettings = ReadingSettings()) -> DataFrame:
    """doc_id, reading_level, score of each English document of ``target_words`` words or more without a grade.

    Null texts and languages give no row; a text without a sentence of ``least_words`` words has
    no prose and gets the middle level. Without any grade every document gets it. Repeated
    documents count each; several raters of one document are averaged; null grades are ignored.
    Texts are read whole whatever their length; other columns are ignored.
    """
    graph = document_word_graph(documents, grades, s)
    value, weight, _ = propagate(graph, s)
    scored = cut(document_values(graph, value, weight, s))
    cuts = cut_points(scored, s)
    level = F.lit(1)
    for c in cuts:
        level = level + (F.col("score") >= c).cast("int")
    middle = (1 + s.levels) // 2
    known = F.col("score").isNull() | F.isnan("score")
    return scored.where((F.col("n_words") >= s.target_words) & F.col("grade").isNull()).select("doc_id", F.when(known, middle).otherwise(level).alias("reading_level"), "score")

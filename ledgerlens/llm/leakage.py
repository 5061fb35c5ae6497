"""Evaluation texts leaking into training text: a distributed positional inverted index.

``build_index`` stores the corpus once as term postings: segments of a bounded number of tokens, and
of each segment the terms with their positions, in rows by a bucket of the term. The table is laid
out by bucket and salted by segment, so that a frequent term is many rows and a search reads only
the buckets of its terms. It holds every token, so any set of test items can be searched in it.

``search`` takes the document frequencies of the items' terms from the index, picks in every window
of an item its rarest terms, and intersects their lists per segment: position minus item position
has to agree within a slack. Where two of them agree, the whole item is aligned along that diagonal.
An exact window always counts; a window that is found with gaps counts by what its words tell
beyond the wording that other items share. Standing clauses are told apart from leaks in
``standing_clauses``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut, stored

_TOKEN = re.compile(r"[^\W_]+")
_IN_NUMBER = re.compile(r"[,.:](?<=\d.)(?=\d)")
_LINE_END = re.compile(r"-[ \t]*\n[ \t]*(?=[^\W\d_])")
#: Lower-case letters and digits of ASCII; everything else is a space.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


@dataclass(frozen=True)
class LeakageSettings:
    """window: tokens of the passage that has to be found. found: least of them in a window with
    gaps. told: least share of the window's information that is found, least_nats: least amount,
    28 nats being one chance in 10^12 pairs of places. exact_nats: least amount beyond the wording of
    other items in an exact window; only phrases put together from other items' phrases have less.
    near: slack of positions for inserted or dropped words. clause_items: item texts that share a
    wording from which it is a standing clause; clause_run: its least tokens; clause_share,
    clause_least: share and number of different texts above which a wording is one that is carried
    without the rest of its item, which at most one in ``clause_alone`` of them carry.
    segment_tokens: tokens of a segment of the index. buckets: of terms. block_items: items that
    are searched at once."""

    window: int = 15
    found: int = 12
    told: float = 0.8
    least_nats: float = 28.0
    exact_nats: float = 24.0
    near: int = 4
    clause_items: int = 3
    clause_run: int = 8
    clause_share: float = 0.02
    clause_least: int = 20
    clause_alone: float = 5.0
    segment_tokens: int = 1 << 20
    buckets: int = 16
    block_items: int = 20_000


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; digit groups and words broken at a line end are joined."""
    if not text:
        return []
    plain = text.isascii()
    t = text if plain else unicodedata.normalize("NFKC", text).lower()
    if "-" in t and "\n" in t:
        t = _LINE_END.sub("", t)
    t = _IN_NUMBER.sub("", t)
    return t.encode("ascii").translate(_ASCII).decode("ascii").split() if plain else _TOKEN.findall(t)


INDEX_SCHEMA = "bucket int, segment long, terms binary, sizes binary, docs binary, at binary"

#: Bucket of the rows that name the documents of a segment: terms are their ids, docs the digests of their texts, at their first positions.
DOCUMENTS = -1


def term_bucket(term: str, buckets: int) -> int:
    return hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=4).digest()[0] % buckets


def segment_rows(segment: int, doc_ids: list[int], texts: list[list[str]], digests: list[bytes], buckets: int) -> list[tuple]:
    """Rows of INDEX_SCHEMA of one segment: terms with their number of postings, of documents, and positions.

    Positions count through the segment; a term's positions are stored as differences.
    """
    numbers: dict[str, int] = defaultdict(itertools.count().__next__)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    term = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int32, count=int(length.sum()))
    names = list(numbers)
    bucket = np.array([term_bucket(w, buckets) for w in names], dtype=np.int32)
    # number the terms by bucket, so that one sort gives every bucket's postings in a row
    rank = np.argsort(bucket, kind="stable")
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    term = place[term].astype(np.int32)
    at = np.argsort(term, kind="stable").astype(np.int32)
    by_term = term[at]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), length)[at]
    first = np.ones(len(at), dtype=bool)
    first[1:] = by_term[1:] != by_term[:-1]
    in_doc = first.copy()
    in_doc[1:] |= doc[1:] != doc[:-1]
    size = np.bincount(by_term, minlength=len(names)).astype(np.int32)
    docs = np.bincount(by_term[in_doc], minlength=len(names)).astype(np.int32)
    delta = np.diff(at, prepend=0).astype(np.int32)
    delta[first] = at[first]
    starts = np.cumsum(length) - length
    rows = [(DOCUMENTS, segment, np.array(doc_ids, np.int64).tobytes(), length.astype(np.int32).tobytes(), b"".join(digests), starts.astype(np.int64).tobytes())]
    edge = np.searchsorted(bucket[rank], np.arange(buckets + 1))
    posting = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    for b in range(buckets):
        lo, hi = int(edge[b]), int(edge[b + 1])
        if lo < hi:
            words = "\n".join(names[k] for k in rank[lo:hi]).encode("utf-8", "surrogatepass")
            rows.append((b, segment, words, size[lo:hi].tobytes(), docs[lo:hi].tobytes(), delta[posting[lo] : posting[hi]].tobytes()))
    return rows


def segment_terms(row) -> list[str]:
    return row.decode("utf-8", "surrogatepass").split("\n")


def build_index(documents: DataFrame, s: LeakageSettings = LeakageSettings()) -> DataFrame:
    """The positional index of ``documents`` (doc_id, text) as a written table of INDEX_SCHEMA.

    Null and empty texts, and texts without a token, are not in it. A text longer than a segment is
    a segment of its own. A null id is kept as the least number.
    """

    def build(batches):
        part = TaskContext.get().partitionId()
        k, size, ids, texts, names = 0, 0, [], [], []
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                ts = tokens(t)
                if not ts:
                    continue
                if ids and size + len(ts) > s.segment_tokens:
                    yield pd.DataFrame(segment_rows((part << 32) + k, ids, texts, names, s.buckets), columns=_INDEX)
                    k, size, ids, texts, names = k + 1, 0, [], [], []
                ids.append(int(i))
                texts.append(ts)
                names.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                size += len(ts)
        if ids:
            yield pd.DataFrame(segment_rows((part << 32) + k, ids, texts, names, s.buckets), columns=_INDEX)

    kept = documents.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return stored(kept.mapInPandas(build, INDEX_SCHEMA).repartition("bucket", "segment"), "bucket")


_INDEX = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
#: Stands for a null document id inside the index.
NO_ID = -(1 << 63)


@dataclass
class Items:
    """A block of test items: ids, term numbers by item, their positions of own wording, the words,
    and what the tokens tell, in corpus and items and among the items alone."""

    ids: list
    terms: list[np.ndarray]
    own: list[np.ndarray]
    vocabulary: dict[str, int]
    nats: list[np.ndarray]
    among: list[np.ndarray]


def own_wording(texts: list[list[str]], s: LeakageSettings) -> list[np.ndarray]:
    """Per item which of its tokens are its own: not in a run of ``clause_run`` that ``clause_items`` different items share."""
    holders: dict[tuple, set[int]] = defaultdict(set)
    number: dict[tuple, int] = {}
    for t in texts:
        me = number.setdefault(tuple(t), len(number))
        for k in range(len(t) - s.clause_run + 1):
            holders[tuple(t[k : k + s.clause_run])].add(me)
    out = []
    for t in texts:
        own = np.ones(len(t), dtype=bool)
        for k in range(len(t) - s.clause_run + 1):
            if len(holders[tuple(t[k : k + s.clause_run])]) >= s.clause_items:
                own[k : k + s.clause_run] = False
        out.append(own)
    return out


class Surprise:
    """What a token tells in nats, given the two before it: counts over the different item texts
    without the item itself and others too few to make a standing wording, mixed with shorter contexts down to the share of the other items (and
    of documents, where given) that hold the word, of at least ``LEAST``. A context yields to a
    shorter one by the number of different words that follow it, ``MIX`` at least."""

    MIX, MOST, LEAST = 2.0, 8.0, 0.007

    def __init__(self, texts: list[list[str]], clause_items: int):
        self.less = clause_items - 1
        self.distinct = {tuple(t) for t in texts}
        self.spread = Counter(w for t in self.distinct for w in set(t))
        self.grams: Counter = Counter()
        for t in self.distinct:
            padded = ("", "", *t)
            for k in range(2, len(padded)):
                a, b, w = padded[k - 2 : k + 1]
                self.grams.update(((a, b), (a, b, w), (b,), (b, w, 0)))
        self.follow = Counter(g[:-1] if len(g) == 3 and g[2] != 0 else g[:1] for g in self.grams if len(g) == 3)

    def nats(self, t: list[str], share: dict[str, float] | None = None) -> np.ndarray:
        """``share``: of the documents that hold a word; without it nothing depends on the corpus."""
        out, n = np.empty(len(t)), max(1, len(self.distinct))
        padded = ("", "", *t)
        for k in range(2, len(padded)):
            a, b, w = padded[k - 2 : k + 1]
            p = max(share[w] if share else self.LEAST, (self.spread[w] - self.less) / n)
            for context, gram in (((b,), (b, w, 0)), ((a, b), (a, b, w))):
                mix = max(self.MIX, self.follow[context])
                p = (max(0, self.grams[gram] - self.less) + mix * p) / (max(0, self.grams[context] - self.less) + mix)
            out[k - 2] = min(self.MOST, -np.log(min(1.0, p)))
        return out


def _windows(mask: np.ndarray, size: int) -> np.ndarray:
    """Sums along the rows of ``mask`` over all windows of ``size``."""
    c = np.zeros((len(mask), mask.shape[1] + 1), dtype=np.float64 if mask.dtype.kind == "f" else np.int32)
    np.cumsum(mask, axis=1, out=c[:, 1:])
    return c[:, size:] - c[:, :-size]


#: What a verdict says, by its number.
KINDS = ("", "exact", "proximity")


def verdicts(exact: np.ndarray, near: np.ndarray, own: np.ndarray, nats: np.ndarray, among: np.ndarray, s: LeakageSettings) -> tuple[np.ndarray, np.ndarray]:
    """(number of the kind, share of the best window) for rows of found positions of one item.

    ``exact``: positions in runs on one diagonal; ``near``: positions found within the slack;
    ``nats``: what the tokens tell in corpus and items, ``among``: among the items alone. Only
    own wording counts. An item of fewer own tokens than a window has to be found as a whole.
    """
    kind, share = np.zeros(len(exact), dtype=np.int8), np.zeros(len(exact))
    n = int(own.sum())
    if not n or not len(exact):
        return kind, share
    size = min(s.window, n)
    w = nats[own]
    m = near[:, own]
    if n >= s.window:
        least = min(s.least_nats, 0.999 * float(w.sum()))
        live = np.flatnonzero((m.sum(axis=1) >= s.found) & (m @ w >= least))
        total = _windows(w[None, :], size)[0]
        got, count = _windows(w * m[live], size), _windows(m[live], size)
        ok = (count >= s.found) & (got >= least) & (got >= s.told * total)
        at = np.flatnonzero(ok.any(axis=1))
        kind[live[at]] = 2
        share[live[at]] = np.where(ok[at], got[at] / np.maximum(total, 1e-9), 0).max(axis=1)
    held = exact & own
    live = np.flatnonzero(held.sum(axis=1) >= size)
    tells = _windows(np.where(own, among, 0)[None, :], size)[0] >= min(s.exact_nats, 0.999 * among[own].sum())
    at = live[((_windows(held[live], size) == size) & tells).any(axis=1)]
    kind[at], share[at] = 1, 1.0
    return kind, share


def rarest_positions(df: np.ndarray, own: np.ndarray, s: LeakageSettings) -> np.ndarray:
    """Positions of an item that seed its search: of every window of own wording the rarest ones, so
    many that two of them are found wherever ``found`` of the window are."""
    at = np.flatnonzero(own)
    size = min(s.window, len(at))
    take = min(size, s.window - s.found + 2)
    pick = np.zeros(len(own), dtype=bool)
    order = df[at]
    for k in range(len(at) - size + 1):
        pick[at[k + np.argsort(order[k : k + size], kind="stable")[:take]]] = True
    return np.flatnonzero(pick)


def search_segment(forward: np.ndarray, starts: np.ndarray, first: np.ndarray, at: np.ndarray, items: Items, seeds, s: LeakageSettings):
    """(document, item, exact positions, near positions) of the documents that hold a window of an item.

    ``forward`` has the item term at each position of the segment, -1 for other terms; ``first`` and
    ``at`` are the postings by term: those of term t stand at ``first[t]`` to ``first[t + 1]``.
    ``seeds`` are arrays of term, item and item position.
    """
    term, item, j = seeds
    count = first[term + 1] - first[term]
    live = count > 0
    term, item, j, count = term[live], item[live], j[live], count[live]
    if not len(term):
        return
    # the lists of the seeds, adjusted by their offset: equal diagonals mean a passage
    base = np.repeat(first[term] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    pos = at[base + np.arange(int(count.sum()))].astype(np.int64)
    item, j = np.repeat(item, count).astype(np.int64), np.repeat(j, count).astype(np.int64)
    doc = np.searchsorted(starts, pos, side="right") - 1
    longest = max(len(t) for t in items.terms)
    span = len(forward) + 2 * longest + s.near + 1
    key = (item * len(starts) + doc) * span + pos - j + longest
    order = np.argsort(key, kind="stable")
    key, jj = key[order], j[order]
    close = (key[1:] - key[:-1] <= s.near) & (jj[1:] != jj[:-1])
    hit = np.zeros(len(key), dtype=bool)
    hit[1:] |= close
    hit[:-1] |= close
    key = np.unique(key[hit])
    pair, diagonal = key // span, key % span - longest
    item, doc = pair // len(starts), pair % len(starts)
    ends = np.append(starts[1:], len(forward))
    margin = longest + s.near
    padded = np.concatenate([np.full(margin, -1, np.int32), forward, np.full(2 * margin, -1, np.int32)])
    edge = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for lo, hi in zip(edge[:-1], edge[1:]):
        i = int(item[lo])
        t, own = items.terms[i], items.own[i]
        n = len(t)
        least = min(s.clause_run, n)
        weight = np.stack([np.where(own, items.nats[i], 0), np.where(own, items.among[i], 0)], axis=1).astype(np.float32)
        enough = 0.99 * np.minimum([s.least_nats, s.exact_nats], weight.sum(axis=0))
        cut_at = np.flatnonzero(np.diff(doc[lo:hi], prepend=-1))
        cut_at = np.append(cut_at[np.searchsorted(cut_at, np.arange(0, hi - lo, 4096))[np.arange(0, hi - lo, 4096) <= cut_at[-1]]], hi - lo)
        for a, b in zip(cut_at[:-1] + lo, cut_at[1:] + lo):  # whole documents, some thousand diagonals at once
            if a == b:
                continue
            where = diagonal[a:b, None] + np.arange(-s.near, n + s.near)[None, :]
            text = padded[where + margin]
            text[(where < starts[doc[a:b], None]) | (where >= ends[doc[a:b], None])] = -1
            exact = text[:, s.near : s.near + n] == t
            near = exact.copy()
            for d in range(2 * s.near + 1):
                if d != s.near:
                    near |= text[:, d : d + n] == t
            # only documents whose diagonals tell enough together go on
            cuts = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            told = (np.add.reduceat(near.astype(np.float32) @ weight, cuts, axis=0) >= enough).any(axis=1)
            which = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, b - a)))
            rows = np.flatnonzero(told[which])
            if not len(rows):
                continue
            # the diagonals of one document are put together; exact runs lie on one diagonal
            cuts = np.flatnonzero(np.diff(which[rows], prepend=-1))
            near = np.logical_or.reduceat(near[rows], cuts, axis=0)
            full = _windows(exact[rows], least) == least
            runs = np.zeros((len(rows), n), dtype=bool)
            for k in range(least):
                runs[:, k : n - least + 1 + k] |= full
            runs = np.logical_or.reduceat(runs, cuts, axis=0)
            doc_of = doc[a:b][rows[cuts]]
            kind, _ = verdicts(runs, near, own, items.nats[i], items.among[i], s)
            for k in np.flatnonzero(kind):
                yield int(doc_of[k]), i, runs[k], near[k]


HITS = "doc_id long, digest binary, item int, exact binary, near binary"


def document_frequencies(index: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Documents per word of ``vocabulary``, and of the index; reads no postings. At most one row per word comes back."""

    def count(batches):
        df, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for pdf in batches:
            for b, terms, docs in zip(pdf["bucket"], pdf["terms"], pdf["docs"]):
                if b == DOCUMENTS:
                    n += len(terms) // 8
                    continue
                number = np.array([vocabulary.get(w, -1) for w in segment_terms(terms)], dtype=np.int64)
                df[number[number >= 0]] += np.frombuffer(docs, np.int32)[number >= 0]
        on = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(on, -1), "n": np.append(df[on], n)})

    rows = index.select("bucket", "terms", "docs").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(vocabulary), dtype=np.int64), 0
    for r in rows:
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, n


def candidates(index: DataFrame, items: Items, df: np.ndarray, s: LeakageSettings) -> DataFrame:
    """HITS: documents that hold a window of an item, clauses of the corpus still among them; the masks are packed bits."""
    picked = [rarest_positions(df[t], own, s) for t, own in zip(items.terms, items.own)]
    number = np.repeat(np.arange(len(picked), dtype=np.int32), [len(p) for p in picked])
    j = np.concatenate(picked).astype(np.int32) if picked else np.zeros(0, np.int32)
    seeds = (np.array([items.terms[i][k] for i, k in zip(number, j)], dtype=np.int64), number, j)
    vocabulary = items.vocabulary
    n_terms = len(vocabulary)

    def wanted(batches):
        for pdf in batches:
            rows = []
            for b, seg, terms, sizes, docs, at in zip(pdf["bucket"], pdf["segment"], pdf["terms"], pdf["sizes"], pdf["docs"], pdf["at"]):
                if b != DOCUMENTS:
                    number = np.array([vocabulary.get(w, -1) for w in segment_terms(terms)], dtype=np.int32)
                    size = np.frombuffer(sizes, np.int32)
                    keep = number >= 0
                    terms, at = number[keep].tobytes(), np.frombuffer(at, np.int32)[np.repeat(keep, size)].tobytes()
                    sizes, docs = size[keep].tobytes(), b""
                rows.append((seg, b, terms, sizes, docs, at))
            yield pd.DataFrame(rows, columns=["segment", "bucket", "terms", "sizes", "docs", "at"])

    def match(pdf):
        named = pdf[pdf["bucket"] == DOCUMENTS].iloc[0]
        rest = pdf[pdf["bucket"] != DOCUMENTS]
        ids = np.frombuffer(named["terms"], np.int64)
        starts = np.frombuffer(named["at"], np.int64)
        total = int(np.frombuffer(named["sizes"], np.int32).sum())
        term = np.frombuffer(b"".join(rest["terms"]), np.int32)
        size = np.frombuffer(b"".join(rest["sizes"]), np.int32).astype(np.int64)
        delta = np.frombuffer(b"".join(rest["at"]), np.int32).astype(np.int64)
        # positions from differences: a running sum that starts anew at every term
        run = np.cumsum(delta)
        head = np.cumsum(size) - size
        at = run - np.repeat(run[head] - delta[head], size) if len(size) else run
        by = np.repeat(term, size)
        forward = np.full(total, -1, dtype=np.int32)
        forward[at] = by
        order = np.argsort(by, kind="stable")
        first = np.searchsorted(by[order], np.arange(n_terms + 1))
        out = []
        for d, i, exact, near in search_segment(forward, starts, first, at[order], items, seeds, s):
            out.append((int(ids[d]), named["docs"][8 * d : 8 * d + 8], i, np.packbits(exact).tobytes(), np.packbits(near).tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "digest", "item", "exact", "near"])

    buckets = sorted({term_bucket(w, s.buckets) for w in vocabulary} | {DOCUMENTS})
    kept = index.where(F.col("bucket").isin(buckets)).select("bucket", "segment", "terms", "sizes", "docs", "at")
    kept = kept.mapInPandas(wanted, "segment long, bucket int, terms binary, sizes binary, docs binary, at binary")
    return kept.groupBy("segment").applyInPandas(match, HITS)


def standing_clauses(hits: DataFrame, lengths: list[int], n_docs: int, s: LeakageSettings) -> dict[int, np.ndarray]:
    """item -> positions whose wording is a standing clause of the corpus: different texts carry it
    exactly, more than a share of all, while few of them carry the rest of the item.

    At most one row per position of an item comes back.
    """

    def spread(batches):
        for pdf in batches:
            bits = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in pdf["exact"]]
            yield pd.DataFrame({"item": np.repeat(pdf["item"].to_numpy(), [len(b) for b in bits]), "at": np.concatenate(bits) if bits else []})

    least = max(s.clause_least, s.clause_share * n_docs)
    once = hits.select("item", "digest", "exact").dropDuplicates(["item", "digest"])
    often = once.groupBy("item").count().where(F.col("count") > least).select("item")
    counts: dict[int, np.ndarray] = {}
    for r in once.join(often, "item").select("item", "exact").mapInPandas(spread, "item int, at int").groupBy("item", "at").count().collect():
        counts.setdefault(r["item"], np.zeros(lengths[r["item"]]))[r["at"]] = r["count"]
    out = {}
    for i, n in counts.items():
        mark = (n > least) & (n > s.clause_alone * max(1.0, float(np.median(n))))
        if mark.any():
            out[i] = mark
    return out


def find_leaks(documents: DataFrame, items: DataFrame, settings: LeakageSettings = LeakageSettings()) -> DataFrame:
    """One row per document and test item whose own wording it carries: doc_id, item_id, kind, share.

    ``kind`` is 'exact' where a whole window stands in the document word by word, else 'proximity'.
    Null and empty texts and items without a token give no row. Items shorter than a window must
    match as a whole. Repeated documents count each under their own row; repeated items each give
    their row. Texts of any length are read whole. Ties cannot arise: every pair above the
    thresholds is kept. Null ids stay null. Other columns are ignored.
    """
    return search(build_index(documents, settings), items, settings)


def search(index: DataFrame, items: DataFrame, s: LeakageSettings = LeakageSettings()) -> DataFrame:
    """``find_leaks`` in an index that is there; see ``build_index``."""
    # the items are the stated query set: read in blocks, each with a bounded vocabulary
    rows = [(r["item_id"], t) for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator() if (t := tokens(r["text"]))]
    own = own_wording([t for _, t in rows], s)
    surprise = Surprise([t for _, t in rows], s.clause_items)
    out = None
    for k in range(0, max(1, len(rows)), s.block_items):
        part = _search_block(index, rows[k : k + s.block_items], own[k : k + s.block_items], surprise, s)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(index: DataFrame, rows: list, own: list[np.ndarray], surprise: Surprise, s: LeakageSettings) -> DataFrame:
    vocabulary: dict[str, int] = {}
    terms = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], dtype=np.int32) for _, t in rows]
    df, n = document_frequencies(index, vocabulary)
    share = {w: (float(df[k]) + 1) / (n + 1) for w, k in vocabulary.items()}
    block = Items([i for i, _ in rows], terms, own, vocabulary, [surprise.nats(t, share) for _, t in rows], [surprise.nats(t) for _, t in rows])
    hits = cut(candidates(index, block, df, s))
    standing = standing_clauses(hits, [len(t) for t in terms], n, s)
    ids, nats, among = block.ids, block.nats, block.among

    def judge(batches):
        for pdf in batches:
            out = []
            for d, i, exact, near in zip(pdf["doc_id"], pdf["item"], pdf["exact"], pdf["near"]):
                bits = [np.unpackbits(np.frombuffer(x, np.uint8))[None, : len(own[i])].astype(bool) for x in (exact, near)]
                kind, best = verdicts(*bits, own[i] & ~standing[i] if i in standing else own[i], nats[i], among[i], s)
                if kind[0]:
                    out.append((d, ids[i], KINDS[kind[0]], float(best[0])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "share"])

    found = hits.select("doc_id", "item", "exact", "near").mapInPandas(judge, "doc_id long, item_id long, kind string, share double")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))

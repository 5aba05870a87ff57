"""Packing documents into sequences by lexical retrieval.

Document frequencies and the mean length are those of the whole table. Each
document is filed under the term that weighs most among those common enough to
fill a shard, so that documents alike meet in one shard of a bounded number of
bytes. A task indexes one shard: BM25 postings over token ids. A seed document
starts a window; its nearest unused neighbours, by all its terms, fill the
window greedily; the last one is cut, and its rest is the seed of the next
window. What remains at the end of a shard is cut into lengths that are powers
of two, so no sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, small_batches, texts
from .tokens import WordTokenizer

K1, B = 1.2, 0.75
SHARD_BYTES = 4 << 20
TERMS = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents, their distinct terms in order, and how often each occurs."""
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = np.uint32 if len(docs) <= TERMS else np.uint64
    key = np.sort(np.repeat(np.arange(len(docs), dtype=kind) << 16, [len(d) for d in docs]) | np.concatenate(docs).astype(kind)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at] >> 16, key[at] & 0xFFFF, np.diff(np.r_[at, len(key)]).astype(np.float64)


class Corpus:
    """What BM25 knows of all documents: their number, mean length and each term's document frequency."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.mean, self.df = n, max(1.0, tokens / max(1, n)), df
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)  # a term of over half of the documents says nothing

    def weigh(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, term, tf = postings(docs)
        size = np.array([len(d) for d in docs], np.float64)
        w = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / self.mean)) if len(doc) else tf
        live = w > 0
        return doc[live], term[live], w[live]

    def filed(self, docs: list[np.ndarray], fill: float) -> tuple[np.ndarray, np.ndarray]:
        """The two terms that weigh most in each document, where a term of fewer than ``fill`` documents weighs less in proportion."""
        doc, term, w = self.weigh(docs)
        w = w * np.minimum(1.0, self.df[term] / max(1.0, fill))
        has, at = np.unique(doc, return_index=True)
        first, second = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for found in (first, second):
            if len(has):
                top = np.flatnonzero(w == np.repeat(np.maximum.reduceat(w, at), np.diff(np.r_[at, len(w)])))
                top = top[np.unique(doc[top], return_index=True)[1]]  # ties to the smaller term
                found[has] = np.where(w[top] > 0, term[top], 0)
                w[top] = 0.0
        return first, second


class Index:
    """BM25 over the token ids of one shard's documents; without ``corpus``, these are all there are."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        self.n = len(docs)
        corpus = corpus or Corpus(self.n, sum(map(len, docs)), np.bincount(postings(docs)[1], minlength=TERMS))
        doc, self.terms, w = corpus.weigh(docs)
        self.of_doc = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(self.terms, kind="stable")
        self._keep(doc[order], w[order], self.terms[order])
        self.live = self.n

    def _keep(self, docs: np.ndarray, weights: np.ndarray, terms: np.ndarray) -> None:
        self.docs, self.weights, self.by_term = docs, weights, terms
        self.of_term = np.r_[0, np.cumsum(np.bincount(terms, minlength=TERMS))]

    def scores(self, d: int, unused: np.ndarray | None = None) -> np.ndarray:
        """Scores of the (unused) documents for all terms of document ``d``; used ones leave the index when half of it is."""
        if unused is not None and 2 * (left := int(unused.sum())) < self.live:
            keep = unused[self.docs]
            self._keep(self.docs[keep], self.weights[keep], self.by_term[keep])
            self.live = left
        t = self.terms[self.of_doc[d] : self.of_doc[d + 1]]
        a, m = self.of_term[t], self.of_term[t + 1] - self.of_term[t]
        if not m.sum():
            return np.zeros(self.n)
        at = np.repeat(a - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        return np.bincount(self.docs[at], self.weights[at], self.n)


def windows(sizes: np.ndarray, scores: Callable[[int, np.ndarray], np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Pieces ``(document, start, length)`` by window; all windows but the last are full."""
    n = len(sizes)
    unused = np.ones(n, bool)
    out: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, first, ranked = window, 0, None
    while True:
        if ranked is None:  # a seed
            while first < n and not unused[first]:
                first += 1
            if first == n:
                break
            d = seed = first
            ranked = iter(())
        else:
            d = next(ranked, -1)
            if d < 0:
                while first < n and not unused[first]:
                    first += 1
                if first == n:
                    break
                s = np.where(unused, scores(seed, unused), -1.0)
                take = min(64, int(unused.sum()))
                best = np.argpartition(-s, take - 1)[:take]
                ranked = iter(best[np.lexsort((best, -s[best]))].tolist())
                continue
        unused[d] = False
        start, size = 0, int(sizes[d])
        cut = False
        while size:
            m = min(room, size)
            now.append((d, start, m))
            start, size, room = start + m, size - m, room - m
            if not room:
                out.append(now)
                now, room, cut = [], window, True
        if cut:  # what is cut starts the next window
            seed, ranked = d, (iter(()) if now else None)
    if now:
        out.append(now)
    return out


def powers(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Cut a window that isn't full into sequences whose lengths are powers of two."""
    left = sum(p[2] for p in pieces)
    out, todo = [], list(pieces)
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        left -= size
        seq = []
        while size:
            d, start, m = todo.pop(0)
            if m > size:
                todo.insert(0, (d, start + size, m - size))
                m = size
            seq.append((d, start, m))
            size -= m
        out.append(seq)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each piece of a document (see ``SCHEMA``).

    A document is the ids of its whole text and then ``end_id``; an empty or
    null text is ``end_id`` alone. Repeated rows are packed each for itself.
    Rows without a ``doc_id`` take no part. Ties between neighbours go to the
    document that is first in the shard, ordered by id. An empty table gives no
    rows.

    Documents are filed by their heaviest term, and terms side by side share a
    shard. A term of more bytes than a shard is dealt by the second heaviest
    term, and what is still too large (many copies) row by row.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["ids"] = [np.append(known(tokenizer).encode(t), np.uint16(end_id)).tobytes() for t in pdf.text]
            yield pdf[["doc_id", "row", "ids"]]

    ids = saved(texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInPandas(encode, "doc_id long, row long, ids binary"))
    corpus = counted(ids)
    total = int(corpus.n * corpus.mean * 4)  # a token is about four bytes of text
    fill = corpus.n * shard_bytes / max(1, total)

    def file(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["first"], pdf["second"] = corpus.filed([np.frombuffer(x, np.uint16) for x in pdf.ids], fill)
            yield pdf

    filed = ids.mapInPandas(file, "doc_id long, row long, ids binary, first int, second int")
    held = saved(filed.groupBy("first", "second").agg(F.sum(F.octet_length("ids") * 2).alias("size")))
    sizes = np.zeros(TERMS, np.int64)
    for r in held.groupBy("first").agg(F.sum("size").alias("size")).collect():  # a row for each id of the tokenizer at most
        sizes[r["first"]] = r["size"]
    base, parts, shards = directory(sizes, shard_bytes)
    where = spark.createDataFrame(pd.DataFrame({"first": np.arange(TERMS)[sizes > 0], "base": base[sizes > 0], "parts": parts[sizes > 0]}), "first int, base long, parts long")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(where), "first").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("second"), "parts"))

    over = saved(placed(held).groupBy("shard").agg(F.ceil(F.sum("size") / (2 * shard_bytes)).alias("ways")).where("ways > 1"))
    dealt = placed(filed).join(over, "shard", "left").withColumn("g", F.col("shard") + F.coalesce(F.pmod(F.xxhash64("row"), "ways"), F.lit(0)) * shards)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "ids"], kind="stable", ignore_index=True)
        held = [np.frombuffer(x, np.uint16) for x in pdf.ids]
        size = np.array([len(x) for x in held])
        seqs = windows(size, Index(held, corpus).scores, window)
        if seqs and sum(p[2] for p in seqs[-1]) < window:
            seqs = [*seqs[:-1], *powers(seqs[-1], window)]
        base = int(pdf["g"].iloc[0]) << 22
        rows = []
        for k, seq in enumerate(seqs):
            at, whole = 0, sum(p[2] for p in seq)
            for j, start, m in seq:
                rows.append((pdf.doc_id[j], start, m, zlib.crc32(held[j][start : start + m].astype("<u4").tobytes()), size[j], base + k, at, whole))
                at += m
        return pd.DataFrame(rows, columns=SCHEMA.replace(" long", "").split(", "))

    tasks = max(partitions(spark), total // (4 * shard_bytes))
    return dealt.select("g", "doc_id", "ids").repartition(tasks, "g").groupBy("g").applyInPandas(shard, SCHEMA)


def counted(ids: DataFrame) -> Corpus:
    """Counts over all documents. Only a row for each id of the tokenizer, of which it has at most 65,536, comes to the driver."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(TERMS, np.int64)
        n = tokens = 0
        for pdf in it:
            held = [np.frombuffer(x, np.uint16) for x in pdf.ids]
            n, tokens = n + len(held), tokens + sum(map(len, held))
            df += np.bincount(postings(held)[1], minlength=TERMS)
        t = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-2, -1, t], "n": np.r_[n, tokens, df[t]]})

    got = ids.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(got.term.tolist(), got.n.tolist(), strict=True))
    df = np.zeros(TERMS, np.int64)
    t = got.term.to_numpy() >= 0
    df[got.term.to_numpy()[t]] = got.n.to_numpy()[t]
    return Corpus(n.get(-2, 0), n.get(-1, 0), df)


def directory(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shard of each term and over how many it is dealt, and the number of shards: small terms side by side share one."""
    base, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    shard, room = -1, 0
    for t in np.flatnonzero(sizes):
        if sizes[t] > most:
            parts[t] = -(-int(sizes[t]) // most)
            base[t], shard, room = shard + 1, shard + int(parts[t]), 0
        else:
            if sizes[t] > room:
                shard, room = shard + 1, most
            base[t], room = shard, room - int(sizes[t])
    return base, parts, shard + 1


_KNOWN: dict[str, WordTokenizer] = {}


def known(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _KNOWN:
        _KNOWN[path] = WordTokenizer(path)
    return _KNOWN[path]


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))

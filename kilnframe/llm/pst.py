"""Language-model scoring with a probabilistic suffix tree.

Symbols are words and the end of a text. A state is a context of up to
``DEPTH`` words. The tree grows from the root, whose distribution is the
unigram's with one added to each count. A context is looked at if its words
were seen ``least`` times; it is kept if the symbols after it diverge from what
the longest kept shorter context says: their log likelihood, each symbol left
out of the counts that predict it, gains ``gain`` nats at least. The
distribution of a kept context is its counts smoothed by ``kappa`` times the
shorter one's distribution. A symbol is scored in the longest kept context
that ends before it. Both limits are absolute: what a corpus keeps, a larger
one of the same kind keeps as well, so the tree grows with the corpus.

Neither counts nor tree meet the driver. The texts become blocks of word
numbers. Level by level, each block sends its distinct (context, symbol) pairs
by hash range of the context; the range's task adds up the counts, tests the
contexts and returns to each block the counts of its own pairs. A context that
makes up more than a ten-thousandth of all tokens is dealt out further by its
symbols, and its gain is summed apart; there are 10,000 of those at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pack, starts, unpack
from .common import discard, partitions, saved, small_batches, texts, whole_groups
from .words import mix, word_hashes

DEPTH = 3
BLOCK_BYTES, BLOCK_DOCS, PART_BYTES, HOT = 5 << 20, 100_000, 10 << 20, 100_000
END = np.uint64(0x2545F4914F6CDD1D)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PROBABILITY = 2.0 ** (np.arange(1 << 16) / -512.0)  # of a number of bits, in 512ths
STATE = "block long, rows binary"
#: kind 0: a block's share of a range; 1: the gain of a part of a hot context; 2: words of the range that training texts have
ANSWER = "kind int, block long, part int, rows binary, context long, gain double, words long"


@dataclass(frozen=True)
class Rule:
    least: int = 2
    gain: float = 1.0
    kappa: float = 16.0


@dataclass
class Block:
    """Texts as numbers of ``words``, and what is known of each token: ``levels[d - 1]`` holds twice the count of its context of ``d`` words and itself in training texts, plus one if the context is kept."""

    ids: np.ndarray
    out: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    code: np.ndarray
    counts: np.ndarray
    levels: list[np.ndarray]

    def packed(self) -> bytes:
        return pack((self.ids, "<i8"), (self.out, "u1"), (self.sizes, "<i8"), (self.words, "<u8"), (self.code, "<u4"), (self.counts, "<u8"), *[(v, "<i8") for v in self.levels])

    @staticmethod
    def of(raw: bytes, depth: int) -> Block:
        ids, out, sizes, words, code, counts, *levels = unpack(raw, "<i8", "u1", "<i8", "<u8", "<u4", "<u8", *["<i8"] * depth)
        return Block(ids, out.astype(bool), sizes, words, code, counts.astype(np.int64), levels)

    def training(self) -> np.ndarray:
        return np.repeat(~self.out, self.sizes)

    @cached_property
    def place(self) -> np.ndarray:
        """Each token's place in its text."""
        return np.arange(len(self.code)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def seen(self, depth: int) -> np.ndarray:
        """How often training texts hold the ``depth`` words before each token."""
        n = self.levels[depth - 2] >> 1 if depth > 1 else self.counts[self.code]
        m = np.r_[np.zeros(1, np.int64), n[:-1]] if len(n) else n
        return np.where(self.place >= depth, m, 0)

    def likelihood(self, total: int, vocabulary: int, rule: Rule) -> np.ndarray:
        """The probability of each token in the longest kept context known so far."""
        q = ((self.counts + 1) / (total + vocabulary + 1.0))[self.code]
        for d, v in enumerate(self.levels, 1):
            n, m = v >> 1, self.seen(d)
            q = np.where(v & 1, (n + rule.kappa * q) / (m + rule.kappa), q)
        return q

    def grams(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``depth`` words before each token, and of those and itself."""
        w = self.words[self.code]
        g, before = w, w
        for _ in range(depth):
            before = np.r_[np.zeros(1, np.uint64), g[:-1]] if len(g) else g
            g = mix(before * _MUL + w)
        return before, g


def gather(modulus: int, held: int):
    """Texts to blocks."""

    def block(ids: list[int], raws: list[bytes], name: int) -> pd.DataFrame:
        hs = [np.append(word_hashes(r), END) for r in raws]
        words, code, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        o = np.argsort(-n)  # frequent words first: small numbers compress
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o))
        out = np.array([zlib.crc32(str(i).encode()) % modulus == held for i in ids])
        b = Block(np.array(ids, np.int64), out, np.array([len(h) for h in hs]), words[o], rank[code.ravel()], np.zeros(0), [])
        return pd.DataFrame({"block": [name], "rows": [b.packed()]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        ids, raws, size = [], [], 0
        for pdf in it:
            for i, t in zip(pdf.doc_id, pdf.text):
                ids.append(i)
                raws.append(t.encode().lower())
                size += len(raws[-1])
                if size >= BLOCK_BYTES or len(ids) == BLOCK_DOCS:
                    yield block(ids, raws, name)
                    ids, raws, size, name = [], [], 0, name + 1
        if ids:
            yield block(ids, raws, name)

    return run


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, in the hashes' order."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _split(part: np.ndarray) -> list[tuple[int, int, int]]:
    s = starts(part)
    return [(int(part[i]), int(i), int(j)) for i, j in zip(s, np.r_[s[1:], len(part)])]


def word_order(b: Block, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = _range(b.words, parts)
    o = np.argsort(part, kind="stable")
    return o, part[o]


def ask_words(parts: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, raw in zip(pdf.block, pdf.rows):
                b = Block.of(raw, 0)
                n = np.bincount(b.code[b.training()], minlength=len(b.words))
                o, part = word_order(b, parts)
                yield pd.DataFrame([(p, name, pack((b.words[o[i:j]], "<u8"), (n[o[i:j]], "<u8"))) for p, i, j in _split(part)], columns=["part", "block", "rows"])

    return run


def answer_words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in whole_groups(it, "part"):
        for part, g in pdf.groupby("part"):
            got = [unpack(raw, "<u8", "<u8") for raw in g.rows]
            words, code = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
            count = np.bincount(code.ravel(), np.concatenate([n for _, n in got]).astype(float), len(words))
            back = np.split(count[code.ravel()], np.cumsum([len(x) for x, _ in got])[:-1])
            rows = [(0, name, part, pack((n, "<u8")), 0, 0.0, 0) for name, n in zip(g.block, back)]
            yield pd.DataFrame([*rows, (2, -1, part, None, 0, 0.0, int((count > 0).sum()))], columns=_names(ANSWER))


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo the type's range; small where ``x`` is sorted."""
    return np.r_[x[:1], x[1:] - x[:-1]]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def by_context(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """An order by context, then by symbol (32 bits): one sort of shortened keys; only where those say too little are pairs sorted whole."""
    short = np.uint64(24)
    key = context >> short << short | symbol.astype(np.uint64) >> np.uint64(8)
    o = np.argsort(key)
    k, c, s = key[o], context[o], symbol[o]
    top = k >> short
    mixed = (top[1:] == top[:-1]) & ((c[1:] != c[:-1]) | ((k[1:] == k[:-1]) & (s[1:] != s[:-1])))
    if mixed.any():
        at = np.flatnonzero(np.isin(top, top[1:][mixed]))
        o[at] = o[at][np.lexsort((s[at], c[at]))]
    return o


@dataclass
class Pairs:
    """A block's distinct (context, symbol) pairs in the order in which they are sent, and each looked-at token's place among them."""

    alive: np.ndarray
    place: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    hot: np.ndarray
    part: np.ndarray
    first: np.ndarray


def pairs(b: Block, depth: int, parts: int, rule: Rule, hot: int) -> Pairs:
    m = b.seen(depth)
    alive = np.flatnonzero(m >= rule.least)
    context, symbol = (x[alive] for x in b.grams(depth))
    symbol = symbol >> np.uint64(32)
    o = by_context(context, symbol)
    at = starts(context[o], symbol[o])
    first = alive[o[at]]
    c, s = context[o[at]], symbol[o[at]]
    is_hot = m[first] > hot
    part = _range(np.where(is_hot, c ^ (s << np.uint64(32)), c), parts)
    by = np.argsort(part, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    place = np.empty(len(alive), np.int64)
    place[o] = np.repeat(rank, np.diff(np.r_[at, len(o)]))
    return Pairs(alive, place, c[by], s[by], is_hot[by], part[by], first[by])


def ask(depth: int, parts: int, rule: Rule, hot: int, total: int, vocabulary: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, raw in zip(pdf.block, pdf.rows):
                b = Block.of(raw, depth - 1)
                x = pairs(b, depth, parts, rule, hot)
                n = np.bincount(x.place, b.training()[x.alive], len(x.part)).astype(np.int64)
                bits = np.round(-np.log2(b.likelihood(total, vocabulary, rule)[x.first]) * 512)
                m = b.seen(depth)[x.first]
                rows = []
                for p, i, j in _split(x.part):
                    c = starts(x.context[i:j])
                    rows.append((p, name, pack((_gaps(x.context[i:j][c]), "<u8"), (np.diff(np.r_[c, j - i]), "<u4"), (m[i:j][c], "<u8"), (x.hot[i:j][c], "u1"), (_gaps(x.symbol[i:j].astype("<u4")), "<u4"), (n[i:j], "<u4"), (bits[i:j], "<u2"))))
                yield pd.DataFrame(rows, columns=["part", "block", "rows"])

    return run


def answer(rule: Rule):
    """Counts of a range's pairs for the blocks that asked; a context's pairs are all here, unless it is hot."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(it, "part"):
            for part, g in pdf.groupby("part"):
                got = [unpack(raw, "<u8", "<u4", "<u8", "u1", "<u4", "<u4", "<u2") for raw in g.rows]
                each = [x[1].astype(np.int64) for x in got]
                context = np.concatenate([np.repeat(np.cumsum(x[0]), e) for x, e in zip(got, each)])
                symbol = np.concatenate([np.cumsum(x[4], dtype=np.uint32) for x in got])
                m, hot = (np.concatenate([np.repeat(x[k], e) for x, e in zip(got, each)]) for k in (2, 3))
                n, bits = (np.concatenate([x[k] for x in got]) for k in (5, 6))
                o = by_context(context, symbol)
                at = starts(context[o], symbol[o])
                count = np.add.reduceat(n[o].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                c, m, q, hot = context[o[at]], m[o[at]].astype(float), _PROBABILITY[bits[o[at]]], hot[o[at]].astype(bool)
                left_out = np.where(count > 0, (np.maximum(count - 1, 0) + rule.kappa * q) / (m - 1 + rule.kappa) / q, 1.0)
                s = starts(c)
                gains = np.add.reduceat(count * np.log(left_out), s) if len(s) else np.zeros(0)
                kept = np.repeat((gains >= rule.gain) & ~hot[s], np.diff(np.r_[s, len(c)])) if len(s) else np.zeros(0, bool)
                value = np.empty(len(o), np.int64)
                value[o] = np.repeat(2 * count + kept, np.diff(np.r_[at, len(o)]))
                back = np.split(value, np.cumsum([len(x[4]) for x in got])[:-1])
                rows = [(0, name, part, pack((v, "<u8")), 0, 0.0, 0) for name, v in zip(g.block, back)]
                rows += [(1, -1, part, None, int(h), float(x), 0) for h, x in zip(c[s][hot[s]].astype(np.int64), gains[hot[s]])]
                yield pd.DataFrame(rows, columns=_names(ANSWER))

    return run


def step(depth: int, parts: int, rule: Rule, hot: int, kept: frozenset[int]):
    """Blocks and what they got back to blocks that know one level more."""

    def known(b: Block, got: dict[int, bytes]) -> Block:
        if not depth:
            o, part = word_order(b, parts)
            b.counts = np.zeros(len(b.words), np.int64)
            for p, i, j in _split(part):
                b.counts[o[i:j]] = unpack(got[p], "<u8")[0]
            return b
        x = pairs(b, depth, parts, rule, hot)
        value = np.zeros(len(x.part), np.int64)
        for p, i, j in _split(x.part):
            value[i:j] = unpack(got[p], "<u8")[0]
        if kept:
            value |= x.hot & np.isin(x.context.astype(np.int64), np.fromiter(kept, np.int64))
        v = np.zeros(len(b.code), np.int64)
        v[x.alive] = value[x.place]
        b.levels.append(v)
        return b

    def run(it: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Block]]:
        for pdf in whole_groups(it, "block"):
            for name, g in pdf.groupby("block"):
                state = g.rows[g.part < 0].iloc[0]
                yield name, known(Block.of(state, max(0, depth - 1)), dict(zip(g.part[g.part >= 0], g.rows[g.part >= 0])))

    return run


def states(blocks):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, b in blocks(it):
            yield pd.DataFrame({"block": [name], "rows": [b.packed()]})

    return run


def scores(blocks, total: int, vocabulary: int, rule: Rule):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, b in blocks(it):
            doc = np.repeat(np.arange(len(b.ids)), b.sizes)
            sums = lambda v: np.bincount(doc, v, len(b.ids))
            base = np.log10((b.counts + 1) / (total + vocabulary + 1.0))[b.code]
            yield pd.DataFrame({
                "doc_id": b.ids, "held_out": b.out, "n_tokens": b.sizes, "n_known": sums(b.counts[b.code] > 0).astype(np.int64), "train_tokens": total,
                "base_score": sums(base), "score": sums(np.log10(b.likelihood(total, vocabulary, rule))),
            })

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, modulus: int = 7, held: int = 2, rule: Rule = Rule(), depth: int = DEPTH) -> DataFrame:
    """Contract of ``op8``: one row for each row of ``docs`` that has a ``doc_id``.

    Null and empty texts are the end alone. Repeated rows count and are scored
    each for itself. An empty table gives no rows. A context doesn't reach over
    the start of its text. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # each step is saved; its shuffles are not read again
    t = texts(docs)
    total_bytes = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-total_bytes // PART_BYTES))
    state = saved(t.mapInPandas(gather(modulus, held), STATE))
    count = state.mapInPandas(_tokens, "n long")
    total = count.agg(F.sum("n")).first()[0] or 0
    hot, vocabulary = max(HOT, total // 10_000), 0

    def sent(run, by) -> DataFrame:
        asked = state.mapInPandas(run, "part int, block long, rows binary").repartition(parts, "part").sortWithinPartitions("part")
        return saved(asked.mapInPandas(by, ANSWER))

    for d in range(depth + 1):
        if d == 0:
            back = sent(ask_words(parts), answer_words)
            vocabulary = back.agg(F.sum("words")).first()[0] or 0
            kept: frozenset[int] = frozenset()
        else:
            back = sent(ask(d, parts, rule, hot, total, vocabulary), answer(rule))
            large = back.where("kind = 1").groupBy("context").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= rule.gain)
            kept = frozenset(r.context for r in large.select("context").collect())  # 10,000 at most
        both = state.select("block", F.lit(-1).alias("part"), "rows").union(back.where("kind = 0").select("block", "part", "rows"))
        both = both.repartition(parts, "block").sortWithinPartitions("block")
        run = step(d, parts, rule, hot, kept)
        if d < depth:
            used, state = state, saved(both.mapInPandas(states(run), STATE))
            discard(used), discard(back)
    return both.mapInPandas(scores(run, total, vocabulary, rule), SCORES)


def _tokens(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for raw in pdf.rows:
            b = Block.of(raw, 0)
            yield pd.DataFrame({"n": [int(b.sizes[~b.out].sum())]})


def query(docs: DataFrame) -> DataFrame:
    return score(docs)

"""Suffix-array dedup: repeated 50-byte strings across documents, removed where a smaller ``doc_id`` has them.

A *suffix* here is sorted from an anchor: of the 16-byte grams of each 50-byte
string, the one of the smallest hash is its anchor, so equal strings have equal
anchors at equal offsets. About one position in seventeen is an anchor, and the
sorted suffixes of the anchors hold every match.

1. ``gather``: anchors of a block of texts, packed by hash ranges.
2. ``prune``: of a 50-byte match either the 33 bytes that end with the anchor or
   the 33 bytes that begin with it are part. Anchors with one of the two in two
   documents stay (a superset of what can match; no text moves for the others,
   so common grams of prose end here).
3. ``runs``: a block's suffixes at those anchors, 50 bytes from the anchor and
   then the 34 before it, backwards, sorted and front-coded into a run, which is
   exchanged by ranges of the anchor's hash.
4. ``merge``: a loser tree combines the runs of a range. It keeps for each
   waiting suffix the length of the prefix that it shares with the last one put
   out, compares those lengths first and characters only after them.
   Neighbours in the merged order that share an anchor are compared by their 35
   strings around it.
5. ``cut``: the bytes covered are removed, document by document.

A string that recurs within a block is known to repeat there: only its smallest
document travels on, so a passage in a third of all documents is one row a
block, not one a document.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, partitions, small_batches, texts, whole_groups

LENGTH, GRAM = 50, 16
BACK = LENGTH - GRAM
HALF = BACK // 2  # a match covers so many bytes on one side of its anchor at least
LEAD = 3  # bytes of the anchor's hash before the suffix, by which runs are dealt out
WIDTH = LEAD + LENGTH + BACK
PAD = 0xFF  # no byte of UTF-8
BLOCK_ANCHORS, BLOCK_SUFFIXES, PART_BYTES, TOGETHER = 500_000, 60_000, 6 << 20, 25_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of 16 bytes given as two numbers."""
    h = (x ^ (x >> np.uint64(29))) * _MIX + y
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _slide(v: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` over all windows of ``w``."""
    p = 1
    while p * 2 <= w:
        v = f(v[:-p], v[p:])
        p *= 2
    return f(v[: len(v) - (w - p)], v[w - p :]) if p < w else v


def anchors(text: bytes, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all 50-byte strings of a text."""
    at, hashes = [], []
    for start in range(0, max(0, len(text) - LENGTH + 1), step):
        buf = text[start : start + step + LENGTH - 1]
        n = len(buf)
        x = np.empty(n - 7, np.uint64)
        for j in range(8):
            m = (n - j) // 8
            x[j::8] = np.frombuffer(buf, "<u8", m, j)
        h = _mixed(x[: n - GRAM + 1], x[8 : n - GRAM + 9])
        w = BACK + 1
        low = _slide(h, w, np.minimum)
        edge = np.zeros(w - 1, np.uint64)
        p = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)
        at.append(p + start)
        hashes.append(h[p] * _MIX)  # the smallest hashes lie close together; this spreads them again
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(at) == 1:
        return at[0], hashes[0]
    p, first = np.unique(np.concatenate(at), return_index=True)
    return p, np.concatenate(hashes)[first]


def sides(text: bytes, pos: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two short hashes for each anchor: of the 17 bytes before and of the 17 bytes after it, each with the gram's own; a side that the text cuts off has none (0)."""
    b = np.frombuffer(text, np.uint8)
    out = np.zeros((len(pos), 2), np.uint16)
    eight = np.ndarray((max(0, len(b) - 7),), "<u8", b, strides=(1,))  # the eight bytes from each place on
    for k, (ok, first) in enumerate(((pos >= HALF, pos - HALF), (pos + GRAM + HALF <= len(b), pos + GRAM))):
        at = first[ok]
        v = _mixed(_mixed(eight[at], eight[at + 8]), b[at + 16].astype(np.uint64)) ^ h[ok]
        out[ok, k] = np.maximum((v * _MIX) >> np.uint64(48), 1)
    return out


def _again(h: np.ndarray, side: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which anchors share their hash and one of their sides with another document."""
    found = np.zeros(len(h), bool)
    for k in range(2):
        ok = np.flatnonzero(side[:, k])
        o = ok[np.lexsort((side[ok, k], h[ok]))]
        if not len(o):
            continue
        b = np.flatnonzero(np.r_[True, (h[o][1:] != h[o][:-1]) | (side[o, k][1:] != side[o, k][:-1])])
        found[o] |= np.repeat(np.minimum.reduceat(d[o], b) != np.maximum.reduceat(d[o], b), np.diff(np.r_[b, len(o)]))
    return found


def _planes(a: np.ndarray, dtype: str) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on: alike bytes together compress."""
    b = np.ascontiguousarray(a.astype(dtype))
    return b.view(np.uint8).reshape(len(b), -1).T.tobytes() if len(b) else b""


def _from_planes(raw: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)


def _packed(*columns: tuple[np.ndarray, str]) -> bytes:
    n = len(columns[0][0])
    return struct.pack("<I", n) + b"".join(_planes(a, t) for a, t in columns)


def _unpacked(raw: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(_from_planes(raw[at : at + size], n, t))
        at += size
    return out


def _with_docs(doc: np.ndarray, *columns: tuple[np.ndarray, str], tag: np.ndarray | None = None) -> bytes:
    """Rows whose documents (and their tags) are numbers of a short list."""
    tag = np.zeros(len(doc), np.int64) if tag is None else tag
    o = np.lexsort((tag, doc))
    new = np.r_[True, (doc[o][1:] != doc[o][:-1]) | (tag[o][1:] != tag[o][:-1])] if len(doc) else np.zeros(0, bool)
    code = np.empty(len(doc), np.int64)
    code[o] = np.cumsum(new) - 1
    head = _packed((doc[o][new], "<i8"), (tag[o][new], "<u4"))
    return zstandard.compress(struct.pack("<I", len(head)) + head + _packed((code, "<u4"), *columns), 3)


def _docs_of(raw: bytes, *types: str, tags: bool = False) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    size = struct.unpack_from("<I", raw)[0]
    names, known = _unpacked(raw[4 : 4 + size], "<i8", "<u4")
    code, *rest = _unpacked(raw[4 + size :], "<u4", *types)
    return [names[code], *([known[code]] if tags else []), *rest]


def _starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _dealt(doc: np.ndarray, pos: np.ndarray, parts: int) -> pd.DataFrame:
    """Positions packed by a hash of their document."""
    to = ((doc.astype(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) % parts
    o = np.argsort(to, kind="stable")
    to, doc, pos = to[o], doc[o], pos[o]
    b = _starts(to)
    return pd.DataFrame([(int(to[i]), _with_docs(doc[i:j], (pos[i:j], "<u4"))) for i, j in zip(b, np.r_[b[1:], len(to)])], columns=["part", "rows"])


def by_doc(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed positions to one row for each document."""
    for pdf in whole_groups(it, "part"):
        doc, pos = (np.concatenate(c) for c in zip(*(_docs_of(raw, "<u4") for raw in pdf.rows)))
        o = np.lexsort((pos, doc))
        doc, pos = doc[o], pos[o].astype(np.int32)
        b = _starts(doc)
        yield pd.DataFrame({"doc_id": doc[b], "pos": np.split(pos, b[1:])})


def gather(parts: int):
    """Blocks of texts to ``(part, kind, rows)``: kind 0 asks who else has the hash, kind 1 is known to repeat."""

    def block(h: np.ndarray, d: np.ndarray, p: np.ndarray, side: np.ndarray, turn: int) -> pd.DataFrame:
        h = h >> np.uint64(24)
        known = _again(h, side, d)
        out = [(turn % parts, 1, _with_docs(d[known], (p[known], "<u4")))] if known.any() else []
        # one of those with the same hash and sides stands for them
        o = np.lexsort((d, side[:, 1], side[:, 0], known, h))
        h, d, p, side, known = h[o], d[o], p[o], side[o], known[o]
        first = np.r_[True, (h[1:] != h[:-1]) | (side[1:] != side[:-1]).any(1)] if len(h) else known
        ask = first | ~known
        h, d, p, side, told = h[ask], d[ask], p[ask], side[ask], known[ask]
        part = ((h >> np.uint64(8)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        e = _starts(part)
        for i, j in zip(e, np.r_[e[1:], len(part)]):
            steps = np.diff(h[i:j], prepend=np.uint64(0))  # in order, so they are small
            out.append((int(part[i]), 0, _with_docs(d[i:j], (steps, "<u8"), (p[i:j], "<u4"), (side[i:j, 0], "<u2"), (side[i:j, 1], "<u2"), (told[i:j], "u1"))))
        return pd.DataFrame(out, columns=["part", "kind", "rows"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        held, n = [], 0
        for pdf in it:
            for i, t in zip(pdf.doc_id, pdf.text):
                raw = t.encode()
                p, h = anchors(raw)
                if len(p):
                    held.append((h, np.full(len(p), i, np.int64), p, sides(raw, p, h)))
                    n += len(p)
                if n >= BLOCK_ANCHORS:
                    yield block(*map(np.concatenate, zip(*held)), turn)
                    held, n, turn = [], 0, turn + 1
        if n:
            yield block(*map(np.concatenate, zip(*held)), turn)

    return run


def prune(parts: int):
    """The anchors that may repeat, from ranges of hashes, dealt out by document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(it, "part"):
            found = [_docs_of(raw, "<u4") for raw in pdf.rows[pdf.kind == 1]]
            for _, asked in pdf[pdf.kind == 0].groupby("part"):
                got = [_docs_of(raw, "<u8", "<u4", "<u2", "<u2", "u1") for raw in asked.rows]
                h = np.concatenate([np.cumsum(x[1], dtype=np.uint64) for x in got])
                d, p, left, right, told = (np.concatenate([x[k] for x in got]) for k in (0, 2, 3, 4, 5))
                again = _again(h, np.stack([left, right], 1), d) & (told == 0)
                found.append([d[again], p[again]])
            doc, pos = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if len(doc):
                yield _dealt(doc, pos, parts)

    return run


def suffix_keys(text: bytes, pos: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` bytes for each anchor, by which suffixes are sorted."""
    b = np.frombuffer(b"\xff" * BACK + text + b"\xff" * LENGTH, np.uint8)
    m = np.empty((len(pos), WIDTH), np.uint8)
    at = pos.astype(np.int64)[:, None] + BACK
    m[:, LEAD : LEAD + LENGTH] = b[at + np.arange(LENGTH)]
    m[:, LEAD + LENGTH :] = b[at - 1 - np.arange(BACK)]
    two = np.ascontiguousarray(m[:, LEAD : LEAD + GRAM]).view("<u8")
    m[:, :LEAD] = (_mixed(two[:, 0], two[:, 1]) * _MIX >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return m


def _lcp(m: np.ndarray) -> np.ndarray:
    """The length of the prefix each row shares with the one before it."""
    out = np.zeros(len(m), np.int64)
    for i in range(1, len(m), 20_000):
        d = m[i : i + 20_000] != m[i - 1 : min(len(m), i + 20_000) - 1]
        out[i : i + 20_000] = np.where(d.any(1), d.argmax(1), WIDTH)
    return out


def whole_mask(m: np.ndarray) -> np.ndarray:
    """Bit ``o``: the string that starts ``o`` bytes before the anchor lies in the document."""
    left, right = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
    for i in range(0, len(m), 20_000):
        right[i : i + 20_000] = (m[i : i + 20_000, LEAD : LEAD + LENGTH] != PAD).sum(1)
        left[i : i + 20_000] = (m[i : i + 20_000, LEAD + LENGTH :] != PAD).sum(1)
    # bits from 50 - right up to left
    low = np.maximum(LENGTH - right, 0)
    return np.where(low <= left, (np.int64(1) << (left + 1)) - (np.int64(1) << low), 0)


def runs(parts: int):
    """``(doc_id, text, pos)`` to sorted front-coded runs by part (kind 0) and marks that are known already (kind 1)."""

    def block(m: np.ndarray, d: np.ndarray, tag: np.ndarray, p: np.ndarray, turn: int) -> pd.DataFrame:
        o = np.lexsort((d, m.view(f"S{WIDTH}").ravel()))
        m, d, tag, p = m[o], d[o], tag[o], p[o]
        lcp = _lcp(m)
        b = np.flatnonzero(lcp < WIDTH)
        later = d > np.repeat(d[b], np.diff(np.r_[b, len(d)]))
        out = []
        if later.any():
            full = whole_mask(m[later])
            keep = full != 0
            out.append((turn % parts, 1, _with_docs(d[later][keep], (p[later][keep], "<u4"), (full[keep], "<i8"), tag=tag[later][keep])))
        m, d, tag, p = m[~later], d[~later], tag[~later], p[~later]
        lcp = _lcp(m)
        lead = m[:, 0].astype(np.int64) << 16 | m[:, 1].astype(np.int64) << 8 | m[:, 2]
        part = lead * parts >> 24
        e = _starts(part)
        for i, j in zip(e, np.r_[e[1:], len(part)]):
            keep = lcp[i:j].copy()
            keep[0] = 0
            tails = m[i:j][np.arange(WIDTH) >= keep[:, None]].tobytes()
            rows = _with_docs(d[i:j], (keep, "u1"), (p[i:j], "<u4"), tag=tag[i:j])
            out.append((int(part[i]), 0, struct.pack("<I", len(rows)) + rows + zstandard.compress(tails, 6)))
        return pd.DataFrame(out, columns=["part", "kind", "rows"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        held, n = [], 0
        for pdf in it:
            for i, t, pos in zip(pdf.doc_id, pdf.text, pdf.pos):
                raw = t.encode()
                pos = np.unique(np.asarray(pos, np.int64))
                pos = pos[pos + GRAM <= len(raw)]
                tag = zlib.crc32(raw)
                for a in range(0, len(pos), BLOCK_SUFFIXES):
                    q = pos[a : a + BLOCK_SUFFIXES]
                    held.append((suffix_keys(raw, q), np.full(len(q), i, np.int64), np.full(len(q), tag, np.int64), q))
                    n += len(q)
                    if n >= BLOCK_SUFFIXES:
                        yield block(*(np.concatenate(c) for c in zip(*held)), turn)
                        held, n, turn = [], 0, turn + 1
        if n:
            yield block(*(np.concatenate(c) for c in zip(*held)), turn)

    return run


class Run:
    """A front-coded run, read one suffix at a time."""

    def __init__(self, lcp: list[int], tails: bytes, first: int):
        self.lcp, self.tails, self.i, self.at, self.first = lcp, tails, 0, 0, first
        self.now = b""

    def step(self) -> int:
        """Go to the next suffix; the length it shares with the one before, or -1 at the end."""
        if self.i == len(self.lcp):
            return -1
        h = self.lcp[self.i]
        end = self.at + WIDTH - h
        self.now = self.now[:h] + self.tails[self.at : end]
        self.at = end
        self.i += 1
        return h


def loser_tree(sources: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """All suffixes in order: ``(suffix, length shared with the one before, its row)``.

    A node holds the source that lost there and the length that its suffix
    shares with the winner that passed, which is the last suffix put out. The
    next suffix of the source that won shares a known length with it too; the
    longer one is the smaller suffix, and only if the lengths are equal are
    characters compared, from there on.
    """
    k = 1
    while k < len(sources):
        k *= 2
    h = [s.step() for s in sources] + [-1] * (k - len(sources))
    now = [s.now for s in sources] + [b""] * (k - len(sources))
    lost, shared = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int, int]:
        """The winner and the loser of two first suffixes, and what they share."""
        if h[a] < 0 or h[b] < 0:
            return (a, b, -1) if h[b] < 0 else (b, a, -1)
        x, y = now[a], now[b]
        n = next((i for i in range(WIDTH) if x[i] != y[i]), WIDTH)
        return (a, b, n) if x <= y else (b, a, n)

    win = list(range(k))
    level = k
    while level > 1:
        up = []
        for i in range(0, level, 2):
            w, lo, n = play(win[i], win[i + 1])
            lost[(level + i) // 2], shared[(level + i) // 2] = lo, n
            up.append(w)
        win, level = up, level // 2
    c = win[0]
    hc = 0 if h[c] >= 0 else -1
    while hc >= 0:
        s = sources[c]
        yield s.now, hc, s.first + s.i - 1
        hc = s.step()
        now[c] = s.now
        node = (k + c) >> 1
        while node:
            hn = shared[node]
            if hc > hn:
                pass
            elif hc < hn:
                lost[node], c = c, lost[node]
                shared[node], hc = hc, hn
            elif hc >= 0:
                o = lost[node]
                x, y = now[c], now[o]
                n = hc
                if x == y:
                    n = WIDTH
                else:
                    while x[n] == y[n]:
                        n += 1
                if n == WIDTH or x[n] < y[n]:
                    shared[node] = n
                else:
                    lost[node], c = c, o
                    shared[node] = n
            node >>= 1


def repeats(m: np.ndarray, lcp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes in order, the bits of the strings that a smaller document has too."""
    first = lcp < WIDTH
    ctx = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    low = np.minimum.reduceat(doc, at)
    full = whole_mask(m) if len(at) == len(m) else whole_mask(m[at])
    bits = np.where(doc > low[ctx], full[ctx], 0)
    g = np.cumsum(lcp[at] < LEAD + GRAM) - 1
    shared = np.flatnonzero(np.bincount(g)[g] > 1)
    b = 0
    while b < len(shared):  # whole groups of equal anchors, some at a time
        a, b = b, int(np.searchsorted(g[shared], g[shared[min(len(shared), b + TOGETHER) - 1]], "right"))
        part = shared[a:b]
        c = m[at[part]]
        line = np.concatenate([c[:, LEAD + LENGTH :][:, ::-1], c[:, LEAD : LEAD + LENGTH]], 1)
        found = np.zeros(len(part), np.int64)
        for o in range(BACK + 1):
            ok = np.flatnonzero(full[part] >> o & 1)
            if len(ok) < 2:
                continue
            w = np.zeros((len(ok), 56), np.uint8)
            w[:, :LENGTH] = line[ok, BACK - o : BACK - o + LENGTH]
            x = w.view("<u8")
            h = x[:, 0].copy()
            for j in range(1, 7):
                h = _mixed(h, x[:, j])
            order = np.argsort(h, kind="stable")
            hs = h[order]
            same = hs[1:] == hs[:-1]
            k = np.flatnonzero(same)
            if not len(k):
                continue
            if not (w[order[k]] == w[order[k + 1]]).all():  # two strings of one hash: sort the strings themselves
                code = np.unique(w.view("V56").ravel(), return_inverse=True)[1].ravel()
                order = np.argsort(code, kind="stable")
                same = code[order][1:] == code[order][:-1]
            s = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(low[part[ok[order]]], s)
            mine = np.empty(len(ok), np.int64)
            mine[order] = np.repeat(least, np.diff(np.r_[s, len(ok)]))
            found[ok] |= (mine < low[part[ok]]).astype(np.int64) << o
        extra = np.zeros(len(at), np.int64)
        extra[part] = found
        bits = bits | extra[ctx]
    return bits


MARKS = "doc_id long, tag long, pos int, bits long"


def merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs to marks ``(doc_id, tag, pos, bits)``; ``tag`` tells apart rows that share an id."""
    for pdf in whole_groups(it, "part"):
        for raw in pdf.rows[pdf.kind == 1]:
            d, tag, p, bits = _docs_of(raw, "<u4", "<i8", tags=True)
            yield pd.DataFrame({"doc_id": d, "tag": tag.astype(np.int64), "pos": p.astype(np.int32), "bits": bits})
        for _, mine in pdf[pdf.kind == 0].groupby("part"):
            sources, cols, n = [], [], 0
            for raw in mine.rows:
                size = struct.unpack_from("<I", raw)[0]
                d, tag, lcp, p = _docs_of(raw[4 : 4 + size], "u1", "<u4", tags=True)
                sources.append(Run(lcp.tolist(), zstandard.decompress(raw[4 + size :]), n))
                cols.append((d, tag, p))
                n += len(d)
            if not n:
                continue
            d, tag, p = (np.concatenate(c) for c in zip(*cols))
            m, lcp, rows = np.empty((n, WIDTH), np.uint8), np.empty(n, np.int64), np.empty(n, np.int64)
            for i, group in enumerate(batched(loser_tree(sources), 4096)):
                at = slice(i * 4096, i * 4096 + len(group))
                keys, lcp[at], rows[at] = zip(*group)
                m[at] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, WIDTH)
            lcp[0] = 0
            bits = repeats(m, lcp, d[rows])
            keep = rows[bits != 0]
            yield pd.DataFrame({"doc_id": d[keep], "tag": tag[keep].astype(np.int64), "pos": p[keep].astype(np.int32), "bits": bits[bits != 0]})


def covered(raw: bytes, tag: np.ndarray, pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a text the marks cover."""
    mine = tag == zlib.crc32(raw)
    pos, bits = pos[mine], bits[mine]
    edge = np.zeros(len(raw) + 1, np.int64)
    offsets = np.arange(BACK + 1)
    for i in range(0, len(pos), TOGETHER):  # all offsets of some marks at once
        start = (pos[i : i + TOGETHER, None] - offsets)[(bits[i : i + TOGETHER, None] >> offsets & 1).astype(bool)]
        edge += np.bincount(start, minlength=len(edge))
        edge -= np.bincount(start + LENGTH, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def marks(docs: DataFrame, carry: list[F.Column] | None = None) -> DataFrame:
    """``(doc_id, text, marks)`` for every row, marks as arrays; one shuffle of the texts serves both joins.

    ``carry``: columns that come along, as ``rest``. They go to both joins, so
    that the shuffle stays one and the same.
    """
    spark = docs.sparkSession
    small_batches(spark, 100)
    t = texts(docs) if carry is None else texts(docs, F.struct(*carry).alias("rest"))
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(partitions(spark), -(-total // PART_BYTES)), 1 << 24)
    blob = "part int, kind int, rows binary"
    asked = t.select("doc_id", "text").mapInPandas(gather(parts), blob).repartition(parts, "part").sortWithinPartitions("part")
    may = asked.mapInPandas(prune(parts), "part int, rows binary").repartition(parts, "part").sortWithinPartitions("part").mapInPandas(by_doc, "doc_id long, pos array<int>")
    sorted_runs = t.join(may, "doc_id").mapInPandas(runs(parts), blob).repartition(parts, "part").sortWithinPartitions("part")
    found = sorted_runs.mapInPandas(merge, MARKS).groupBy("doc_id").agg(F.collect_list("tag").alias("tag"), F.collect_list("pos").alias("pos"), F.collect_list("bits").alias("bits"))
    return t.join(found, "doc_id", "left")


def _arrays(tag, pos, bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if tag is None:
        z = np.zeros(0, np.int64)
        return z, z, z
    return np.asarray(tag, np.int64), np.asarray(pos, np.int64), np.asarray(bits, np.int64)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    """Contract of ``op6``: one row for each row of ``docs`` that has a ``doc_id``.

    Null and empty texts have 0 bytes; texts under 50 bytes keep all. Rows that
    share an id are judged each for itself, against smaller ids only. An empty
    table gives no rows.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, t, *a in zip(pdf.doc_id, pdf.text, pdf.tag, pdf.pos, pdf.bits):
                raw = t.encode()
                gone = covered(raw, *_arrays(*a)) if a[0] is not None and len(a[0]) else np.zeros(len(raw), bool)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((i, len(raw), len(raw) - len(kept), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marks(docs).mapInPandas(run, DIGEST)


def removed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, the repeated bytes gone from ``text``, ``n_chars`` as the text then has, if it was a column.

    What is left is UTF-8 again: a character that is cut loses all its bytes.
    A text that loses everything stays as an empty row. Rows without a
    ``doc_id`` stay as they are.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, tag: pd.Series, pos: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        for t, *a in zip(text, tag, pos, bits):
            raw = t.encode()
            gone = covered(raw, *_arrays(*a))
            out.append(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else None)
        return pd.Series(out, dtype=object)

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    (null,) = free(docs.columns, "_null")
    m = marks(docs, [F.col("text").isNull().alias(null), *rest]).withColumn("_kept", cut("text", "tag", "pos", "bits"))
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {c: F.col(f"rest.`{c}`") for c in rest} | {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.when(~F.col(f"rest.`{null}`"), F.coalesce("_kept", "text"))}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("_kept").isNull(), new["n_chars"]).otherwise(F.length("_kept").cast(kinds["n_chars"]))
    return m.select(*[new[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))

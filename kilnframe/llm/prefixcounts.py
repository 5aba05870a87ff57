"""Exact token counts of every prefix of a text, stored once and asked without encoding again.

A tokenizer of words (byte-pair merges with an end-of-word mark) encodes what
lies between white space by itself, and each such run piece by piece. In a piece
the counts of all prefixes follow by dynamic programming: the tokens of
``s[:j]`` are those of ``s[:i]`` and one token ``s[i:j]`` that stays apart from
the last one before it, so ``count[j] = count[i] + 1``; the prefix as a text of
its own ends with a token that carries the mark.

``build`` writes a row for each block of a text: the count where it begins and
the change of the count at each character. ``totals``, ``at``, ``longest`` and
``truncated`` read that table only.

A prefix is counted as the library counts it as a whole text: a special string
counts as one token where it is complete, and as plain characters before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .tokens import _PIECE, _PLAIN, byte_letters

BLOCK = 1 << 16
SEGMENT = 1 << 20
SCHEMA = "doc_id long, row string, block int, last boolean, start_char long, start_byte long, n_chars int, n_bytes int, before long, least long, tokens long, changes binary"
_KEEP = 400_000
_SPACE = "\t\n\v\f\r"


class Merges:
    """The merges of a BPE file: which tokens there are, how each was made, and which two stay apart."""

    def __init__(self, merges: list[list[str]], letters: list[str], end: str):
        self.end = end
        self.made = dict.fromkeys([x + e for x in letters for e in ("", end)], -1)
        self.parts: dict[str, tuple[str, str]] = {}
        for rank, (a, b) in enumerate(merges):
            self.made[a + b] = rank
            self.parts[a + b] = (a, b)
        self.finder = self._finder()
        self.known: dict[tuple[str, str], bool] = {}

    def _finder(self):
        """An automaton that names every string of letters that ends at a place and is a token, without the mark or with it."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in {t.removesuffix(self.end) for t in self.made}:
            found.add_word(t, (len(t) - 1, t if t in self.made else None, t + self.end if t + self.end in self.made else None))
        found.make_automaton()
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` side by side stay two tokens.

        Their merges are undone, the latest first: the two would have become
        one if the pieces that then touch merge earlier than what was undone.
        """
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 2 * _KEEP:
                self.known.clear()
            x, y, limit, got = a, b, len(self.parts) + 1, None
            while got is None:
                both = self.parts.get(x + y)
                if both == (x, y) and self.made[x + y] < limit:
                    got = False
                elif self.made[x] > self.made[y]:
                    limit, x = self.made[x], self.parts[x][1]
                elif self.made[y] >= 0:
                    limit, y = self.made[y] + 1, self.parts[y][0]  # of equal merges the left one comes first
                else:
                    got = True
            self.known[a, b] = got
        return got

    def prefix_counts(self, s: str) -> list[int]:
        """Tokens of ``s[:j]`` as a whole piece, for each ``j`` from 1; exactly one token can end a prefix."""
        apart = self.apart
        count, last, out = [0] * (len(s) + 1), [""] * (len(s) + 1), [0] * len(s)
        for e, (k, t, u) in self.finder.iter(s):
            i = e - k
            if t and not count[e + 1] and (i == 0 or apart(last[i], t)):
                count[e + 1], last[e + 1] = count[i] + 1, t
            if u and not out[e] and (i == 0 or apart(last[i], u)):
                out[e] = count[i] + 1
        return out


class Kept(dict):
    """A table of results in two generations: what is asked for again outlives a change of generation."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def find(self, key):
        got = self.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.add(key, got)
        return got

    def add(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class PrefixCounter:
    """Changes of the token count at each character of a text, for a word-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = byte_letters()
        self.merges = Merges([m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]], self.letters, spec["model"]["end_of_word_suffix"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self.pieces, self.runs = Kept(_KEEP), Kept(_KEEP)

    def _piece(self, p: str) -> list[int]:
        """Counts of the prefixes of a piece in normal form, by its characters."""
        got = self.pieces.find(p)
        if got is None:
            if p.isascii() and p.isprintable():
                got = self.merges.prefix_counts(p)
            else:
                raw = p.encode()
                by_byte = self.merges.prefix_counts("".join(map(self.letters.__getitem__, raw)))
                got = [n for n, b in zip(by_byte, [*raw[1:], 0]) if b & 0xC0 != 0x80]  # where a character ends
            if p[0] == "'" and len(p) == 3 and p[1:].isalpha():  # 're, 've, 'll: without the last letter a mark and a letter
                got = [got[0], got[0] + self.merges.prefix_counts(p[1])[0], got[2]]
            if len(p) < 64:
                self.pieces.add(p, got)
        return got

    def _counts(self, run: str) -> list[int]:
        """Counts of the prefixes of a run, without regard to special strings."""
        low = run.lower()
        if low[:-1].isalpha() and low.isascii() and low[-1] in ",.;:!?":
            c = self._piece(low[:-1])
            return [*c, c[-1] + 1]
        if len(low) == len(run) and _PLAIN.match(run):
            out, base = [], 0
            for p in (low,) if low.isalpha() else _PIECE.findall(low):
                c = self._piece(p)
                out += [base + x for x in c] if base else c
                base += c[-1]
            if len(out) == len(run):  # else it holds white space beyond ASCII
                return out
        if unicodedata.is_normalized("NFC", run):
            return self._composed(run)
        out = []
        cut = [i for i, c in enumerate(run) if i == 0 or (unicodedata.is_normalized("NFC", run[i - 1 : i + 1]) and not unicodedata.combining(c) and not unicodedata.decomposition(c) and not self._joins(c))]
        start = 0  # from here on the run is counted; the pieces before are closed
        base = 0
        for a, b in zip(cut, [*cut[1:], len(run)]):
            for i in range(a + 1, b + 1):
                out.append(base + len(self.library.encode(run[start:i], add_special_tokens=False).ids))
            if b < len(run) and self._breaks(run[a:b], run[b]):
                base, start = out[-1], b
        return out

    @staticmethod
    def _joins(c: str) -> bool:
        """Whether a character that doesn't decompose can still join the one before: the vowels and finals of Hangul."""
        return "\u1160" <= c <= "\u11ff"

    def _breaks(self, before: str, after: str) -> bool:
        """Whether a piece ends between the two whatever surrounds them: a letter or a digit meets a sign that is neither."""
        n = self.library.normalizer.normalize_str(before)
        starts = [a for _, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(n + after)]
        return n[-1:].isalnum() and not after.isalnum() and len(n) in starts

    def _composed(self, run: str) -> list[int]:
        """As ``_counts`` for a run in normal form C, whose prefixes are in it as well."""
        norm = self.library.normalizer.normalize_str
        known: dict[str, str] = {}
        width = []
        for c in run:
            if c not in known:
                known[c] = norm(c)
            width.append(len(known[c]))
        text = "".join(known[c] for c in run)
        by_char = np.zeros(len(text), np.int64)
        base, at = 0, 0
        for p, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            by_char[at:a] = base
            by_char[a:b] = base + np.array(self._piece(text[a:b]))
            base, at = int(by_char[b - 1]), b
        by_char[at:] = base
        return by_char[np.cumsum(width) - 1].tolist()

    def _run(self, run: str) -> bytes:
        """The changes of the count over a run that holds no ASCII white space."""
        if "<|" not in run:
            c = self._piece(run.lower()) if run.isascii() and run.isalpha() else self._counts(run)
            return bytes([(b - a) & 255 for a, b in zip([0, *c], c)])
        out: list[int] = []
        base, at = 0, 0
        for m in self.special.finditer(run):
            c = self._counts(run[at : m.end() - 1])
            out += [base + x for x in c]
            base += (c[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        out += [base + x for x in self._counts(run[at:])] if at < len(run) else []
        d = np.diff(np.array([0, *out]))
        if len(d) and not -128 <= d.min() <= d.max() <= 127:
            raise ValueError("one character changes the count by more than a byte can hold")
        return d.astype(np.int8).tobytes()

    def changes(self, text: str) -> np.ndarray:
        """How the count changes at each character of ``text``; their sum is its number of tokens."""
        for c in _SPACE:
            if c in text:
                text = text.replace(c, " ")
        runs = text.split(" ")
        get = self.runs.get
        found = list(map(get, runs))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = runs[i]
                    x = self.runs.find(w)
                    if x is None:
                        x = self._run(w)
                        if len(w) < 64:
                            self.runs.add(w, x)
                    found[i] = x
        return np.frombuffer(b"\0".join(found), np.int8)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a process, whose words are kept from task to task."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """``text`` in parts that end after white space, so that a long text is never in pieces all at once."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in " \n\t\r\v\f")
        if cut < 0:  # no white space so far: up to the next
            m = re.compile("[\t-\r ]").search(text, at + size)
            if not m:
                break
            cut = m.start()
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def blocks(text: str, count: PrefixCounter, size: int = BLOCK) -> Iterator[tuple]:
    """``(block, last, start_char, start_byte, n_chars, n_bytes, before, least, tokens, changes)`` of a text; an empty one has one block."""
    block = char = byte = before = 0
    for part in segments(text):
        d = count.changes(part)
        for a in range(0, max(1, len(d)), size):
            piece, s = d[a : a + size], part[a : a + size]
            path = np.cumsum(piece, dtype=np.int64)
            least = before + int(path.min()) if len(path) else before
            tokens = before + (int(path[-1]) if len(path) else 0)
            n = len(s.encode())
            last = char + len(s) == len(text)
            if len(s) or not text:
                yield block, last, char, byte, len(s), n, before, least, tokens, zstandard.compress(piece.tobytes(), 1)
                block, char, byte, before = block + 1, char + len(s), byte + n, tokens


def build(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """The table of prefix counts of ``docs(doc_id, text)``, written to the shared folder.

    A null text is empty and an empty text has one block of no characters. Rows
    that share a ``doc_id`` or have none keep a table each, told apart by
    ``row``. Other columns are left out. Block ``b`` holds the characters from
    ``start_char`` on; ``before`` and ``tokens`` are the counts at its two ends
    and ``least`` the smallest within.
    """
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        c, n, out, held = counter(path), 0, [], 0
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def frame(out: list[tuple]) -> pd.DataFrame:
            f = pd.DataFrame(out, columns=names)
            f["doc_id"] = f["doc_id"].astype("Int64")
            return f

        for pdf in it:
            for i, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                row = f"{TaskContext.get().partitionId()}:{n}"
                n += 1
                for b in blocks(text, c, block):
                    out.append((None if i is None or i != i else int(i), row, *b))
                    held += len(b[-1])
                    if held > 4 << 20:
                        yield frame(out)
                        out, held = [], 0
            if out:
                yield frame(out)
                out, held = [], 0

    return saved(rows.mapInPandas(count, SCHEMA))


def totals(table: DataFrame) -> DataFrame:
    """``(doc_id, row, n_chars, n_bytes, n_tokens)`` of each text: what its last block says."""
    return table.where("last").select("doc_id", "row", (F.col("start_char") + F.col("n_chars")).alias("n_chars"), (F.col("start_byte") + F.col("n_bytes")).alias("n_bytes"), F.col("tokens").alias("n_tokens"))


def _path(before: int, raw: bytes) -> np.ndarray:
    return before + np.cumsum(np.frombuffer(zstandard.decompress(raw), np.int8), dtype=np.int64)


def at(table: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, chars, n_tokens)`` for ``asked(doc_id, chars)``: tokens of the first ``chars`` characters.

    Each question reads one block. More characters than there are ask for the
    whole text; a null or negative number, or an unknown id, gets no row; an id
    that several rows share gets a row for each.
    """
    small_batches(table.sparkSession, 500)
    q = asked.where("chars >= 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chars").cast("long").alias("chars")).distinct()
    end = F.col("start_char") + F.col("n_chars")
    mine = ((F.col("chars") > F.col("start_char")) & (F.col("chars") <= end)) | ((F.col("chars") == 0) & (F.col("block") == 0)) | (F.col("last") & (F.col("chars") > end))
    met = q.join(table, "doc_id").where(mine).select("doc_id", "chars", "start_char", "n_chars", "before", "changes")

    def answer(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n = []
            for chars, start, size, before, raw in zip(pdf["chars"], pdf["start_char"], pdf["n_chars"], pdf["before"], pdf["changes"]):
                k = min(chars - start, size)
                n.append(int(_path(before, raw)[k - 1]) if k else before)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "chars": pdf["chars"], "n_tokens": n})

    return met.mapInPandas(answer, "doc_id long, chars long, n_tokens long")


def longest(table: DataFrame, limit: int) -> DataFrame:
    """``(doc_id, row, fit_chars, fit_tokens, whole)``: the longest prefix of each text that has at most ``limit`` tokens.

    Counts may fall as a prefix grows, so it is the last place at or under the
    limit. Only the last block that has such a place is unpacked.
    """
    small_batches(table.sparkSession, 500)
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    has = table.where((F.col("least") <= limit) | (F.col("block") == 0)).groupBy("doc_id", "row").agg(F.max("block").alias("block"))
    met = table.join(has.withColumnRenamed("doc_id", "_d").withColumnRenamed("row", "_r").withColumnRenamed("block", "_b"), (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("block") == F.col("_b")))

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            chars, tokens, whole = [], [], []
            for start, size, last, before, raw in zip(pdf["start_char"], pdf["n_chars"], pdf["last"], pdf["before"], pdf["changes"]):
                p = np.r_[before, _path(before, raw)]
                k = int(np.flatnonzero(p <= limit)[-1])
                chars.append(start + k)
                tokens.append(int(p[k]))
                whole.append(bool(last and k == size))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "fit_chars": chars, "fit_tokens": tokens, "whole": whole})

    return met.select("doc_id", "row", "start_char", "n_chars", "last", "before", "changes").mapInPandas(find, "doc_id long, row string, fit_chars long, fit_tokens long, whole boolean")


def truncated(docs: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``limit`` tokens; ids must be unique, rows without one stay as they are."""
    fit = longest(table, limit).where("doc_id is not null and not whole").select(F.col("doc_id").alias("_kiln_doc"), F.col("fit_chars").alias("_kiln_fit"))
    met = docs.select(F.struct("*").alias("_kiln_all")).join(fit, F.col("_kiln_all.doc_id") == F.col("_kiln_doc"), "left")
    cut = F.when(F.col("_kiln_fit").isNotNull(), F.substring(F.col("_kiln_all.text"), F.lit(1), F.col("_kiln_fit").cast("int"))).otherwise(F.col("_kiln_all.text"))
    return met.select(*[cut.alias(c) if c == "text" else F.col(f"_kiln_all.`{c}`").alias(c) for c in docs.columns])


def query(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every text, read from its table of prefix counts."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return totals(build(docs, path)).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

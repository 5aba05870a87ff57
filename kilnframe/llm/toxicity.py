"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

``fit`` learns which words, and which stems that begin words, mark toxic
documents; ``score`` matches them in whole texts. Folding maps homoglyphs,
accents and digit substitutions to one skeleton alphabet, so ``1d1ot`` and
``idiot`` are the same word. Matches inside an exception phrase do not count;
phrases are given, or learned from clean documents that hold an entry.
The weighted sum is divided by the number of words and turned into a
probability by a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, texts

#: Characters that are read as the letter after the colon.
LOOKALIKES = {
    "l": "1|iіӏιıíìîïīł", "o": "0оοøóòôöõō", "e": "3еεéèêëēę", "a": "4@аαáàâäãåā", "s": "5$ѕšśß", "t": "7тτť",
    "c": "сçćč", "p": "рρ", "x": "хχ", "y": "уγýÿ", "h": "һ", "k": "кκ", "m": "м", "n": "ñńηп", "b": "8ьβ", "u": "úùûüūυ", "v": "ν", "d": "ԁđ", "g": "9ɡ", "w": "ԝω", "z": "2žźż", "j": "ј",
}
_FOLD = {ord(c): k for k, cs in LOOKALIKES.items() for c in cs} | {ord(chr(0x3B1 + 17)): "s"}
_INNER = re.compile(r"(?<=\w)[@$|!](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words, each with a space before it, and one space at the end."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).lower()
    if "@" in t or "$" in t or "|" in t or "!" in t:
        t = _INNER.sub(lambda m: {"@": "a", "$": "s"}.get(m[0], "l"), t)
    words = _WORD.findall(t)
    return " " + " ".join(words).translate(_FOLD) + " " if words else " "


@dataclass(frozen=True)
class Model:
    """``entries``: folded pattern (with its leading space; a trailing one if it is a whole word) to weight."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slope: float

    def matcher(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for p in self.exceptions:
            found.add_word(fold(p), (len(fold(p)), None))
        for p, w in self.entries.items():
            found.add_word(p, (len(p), w))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def probability(self, rate: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(1000 * rate))))


def rate(folded: str, matcher: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Weight of the matches a word, and their number."""
    n = folded.count(" ") - 1
    if n < 1 or matcher is None:
        return 0.0, 0
    hits, spared = [], []
    for end, (size, w) in matcher.iter(folded):
        (spared if w is None else hits).append((end - size + 1, end, w))
    if spared:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
    return sum(h[2] for h in hits) / n, len(hits)


def marks(folded: str, stem: range = range(4, 9)) -> set[str]:
    """Whole words and word beginnings of 4 to 8 letters, once each."""
    out: set[str] = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in stem if k < len(w))
    return out


def choose(counts: pd.DataFrame, toxic: list[set[str]], n_pos: int, n_neg: int, least: int, log_odds: float, prevalent: float, most: int) -> dict[str, float]:
    """The entries and weights from document counts ``(mark, pos, neg)`` and the marks of each toxic document.

    A mark of at least ``prevalent`` of the toxic documents is an entry. The
    others are found greedily: the mark of most toxic documents that have no
    entry yet, as long as it has ``least`` of them. Words that merely recur in
    toxic documents, as in copies, thus don't become entries.
    """
    w = np.log((counts.pos + 0.5) / (n_pos + 1)) - np.log((counts.neg + 0.5) / (n_neg + 1))
    weight = {m: float(x) for m, p, x in zip(counts.mark, counts.pos, w) if p >= least and x >= log_odds}
    pos = dict(zip(counts.mark, counts.pos))
    chosen: dict[str, float] = {}
    for m in sorted(weight, key=lambda m: (-len(m), m)):  # the longest form that has nearly all of the documents
        if pos[m] >= prevalent * n_pos and not any(c.startswith(m) and pos[c] >= 0.9 * pos[m] for c in chosen):
            chosen[m] = weight[m]
    left = [d & weight.keys() for d in toxic]
    left = [d for d in left if not d & chosen.keys()]
    while left and len(chosen) < most:
        tally = Counter(m for d in left for m in d)
        best, n = max(tally.items(), key=lambda t: (t[1] * weight[t[0]], len(t[0]), t[0]), default=("", 0))
        if n < least:
            break
        chosen[best] = weight[best]
        left = [d for d in left if best not in d]
    # a word below a chosen stem would count twice
    chosen = {m: round(x, 6) for m, x in chosen.items() if not any(m[:k] in chosen for k in range(2, len(m)))}
    return dict(sorted(chosen.items(), key=lambda t: (-t[1], t[0]))[:most])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> tuple[float, float]:
    a = b = 0.0
    X = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ [a, b], -30, 30)))
        g = X.T @ (p - y) + l2 * np.array([0, b])
        h = (X * (p * (1 - p))[:, None]).T @ X + np.diag([1e-9, l2])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, least: int = 5, log_odds: float = 2.5, prevalent: float = 0.05, most_entries: int = 2_000, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn from ``labelled(doc_id, text, toxic)``.

    The rows are a bounded sample (see ``fitted``), so the driver may get the
    marks of the toxic ones. ``most_entries`` bounds the lexicon, which is
    broadcast. ``exceptions`` come besides those that are learned. Rows without a label are left out. With no rows of one class the
    lexicon is empty and every text gets that class's share.
    """
    rows = labelled.where("toxic in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for pdf in it:
            for t, y in zip(pdf.text, pdf.toxic):
                got = marks(fold(t))
                got.add("")
                (pos if y else neg).update(got)
        keys = list(pos.keys() | neg.keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pd.DataFrame({"mark": part, "pos": [pos[k] for k in part], "neg": [neg[k] for k in part]})

    counts = rows.mapInPandas(count, "mark string, pos long, neg long").groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = counts.where((F.col("pos") >= least) | (F.col("mark") == "")).where((F.col("pos") > 0.5 * F.col("neg")) | (F.col("mark") == "")).toPandas()
    total = got[got.mark == ""]
    n_pos, n_neg = (int(total.pos.sum()), int(total.neg.sum())) if len(total) else (0, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model({}, exceptions, math.log(share / (1 - share)), 0.0)
    got = got[got.mark != ""]
    names = set(got.mark)

    def named(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"marks": [sorted(marks(fold(t)) & names) for t in pdf.text]})

    toxic = [set(r.marks) for r in rows.where("toxic = 1").select("text").mapInPandas(named, "marks array<string>").toLocalIterator()]
    entries = choose(got, toxic, n_pos, n_neg, least, log_odds, prevalent, most_entries)
    draft = Model(entries, (*exceptions, *learned(rows, entries, least)), 0.0, 1.0)
    seen = rates(rows.select("text", "toxic"), draft).select("rate", "toxic").toPandas()
    bias, slope = logistic(np.log1p(1000 * seen.rate.to_numpy()), seen.toxic.to_numpy(float))
    return Model(draft.entries, draft.exceptions, bias, max(slope, 0.0))


def phrases(folded: str, matcher: ahocorasick.Automaton) -> set[str]:
    """Each word that holds a match, with the word before it and with the word after it."""
    out: set[str] = set()
    for end, (size, _) in matcher.iter(folded):
        start = end - size + 1
        stop = folded.index(" ", end if folded[end] == " " else end + 1)
        before = folded.rfind(" ", 0, start) if start else -1
        if before >= 0:
            out.add(folded[before + 1 : stop])
        after = folded.find(" ", stop + 1)
        if after >= 0:
            out.add(folded[start + 1 : after])
    return out


def learned(rows: DataFrame, entries: dict[str, float], least: int, most: int = 1_000) -> tuple[str, ...]:
    """Exception phrases: two words with a match, in ``least`` clean documents and in no toxic one; the most frequent ``most``."""
    if not entries:
        return ()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Model(entries, (), 0.0, 1.0).matcher()
        for pdf in it:
            got = [(p, int(y)) for t, y in zip(pdf.text, pdf.toxic) for p in phrases(fold(t), matcher)]
            yield pd.DataFrame(got, columns=["phrase", "toxic"])

    n = rows.mapInPandas(run, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    return tuple(r.phrase for r in n.where((F.col("pos") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "phrase").limit(most).collect())


def rates(df: DataFrame, model: Model) -> DataFrame:
    """``df`` without its text, with ``rate`` and ``n_hits``."""
    rest = [c for c in df.columns if c != "text"]
    schema = df.select(*rest).schema.add("rate", "double").add("n_hits", "long")

    def match(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for pdf in it:
            got = [rate(fold(t), matcher) for t in pdf.text]
            out = pdf[rest].copy()
            out["rate"], out["n_hits"] = [r for r, _ in got], [n for _, n in got]
            yield out

    return df.mapInPandas(match, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, rate, n_hits)`` for every row of ``docs`` that has a ``doc_id``, repeated rows included.

    Empty and null texts have rate 0 and get the curve's value there.
    """
    z = F.lit(model.bias) + F.lit(model.slope) * F.log1p(F.col("rate") * 1000)
    return rates(texts(docs), model).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "rate", "n_hits")


def held_out(doc_id: F.Column | str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **params) -> Model:
    """A model from labelled rows that are not held out, at most ``most_rows``: the first by a hash of their id. Ids with both labels are left out.

    Their ids are few by that bound and so are broadcast; their texts are
    written once.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return fit(saved(texts(docs).join(F.broadcast(known), "doc_id")), **params)


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Contract of ``op10``: one row for each row of ``docs`` that has a ``doc_id``, repeated rows included."""
    got = score(docs, fitted(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "rate", "n_hits")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    model = fitted(docs, labels)
    kept = docs.columns

    def passes(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for s in it:
            yield pd.Series(model.probability(np.array([rate(fold(t or ""), matcher)[0] for t in s])))

    p = F.pandas_udf(passes, "double")
    return docs.where(p(F.coalesce("text", F.lit(""))) < threshold).select(*kept)

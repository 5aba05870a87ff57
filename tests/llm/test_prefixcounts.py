"""Prefix counts against the library, prefix by prefix, and the questions asked of the stored table."""

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from kilnframe.llm import prefixcounts as pc

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "the", "ing", "ation", "h", "'", "'s", "'re", "'ll", "'RE", " ", "\n", "\t", "  ", "1", "23", "½", "²", "!", "...", "é", "é", "ß", "İ", "Σ", "中",
    "か", "゙", "각", "한국", "\U0001f600", "‍", " ", "　", "\x85", "\x1c", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "K",
    "̸", "ো", "ﬁ", "­", "ŉ", "Ⅷ", "Stöße", "שָ",
]


@pytest.fixture(scope="module")
def counter():
    return pc.counter(PATH)


def of_prefixes(counter, text):
    return [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_every_prefix_as_the_library(counter):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert np.cumsum(counter.changes(text)).tolist() == of_prefixes(counter, text), repr(text)


def test_letters_without_a_break(counter):
    rng = random.Random(6)
    for k in (3, 26):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(300))
        assert np.cumsum(counter.changes(text)).tolist() == of_prefixes(counter, text)
    text = "があ。" * 60
    assert np.cumsum(counter.changes(text)).tolist() == of_prefixes(counter, text)


def test_every_token_stands_for_itself(counter):
    """What the dynamic programme rests on: a token of the vocabulary is never encoded as several."""
    for t in counter.merges.parts:
        if t.endswith("</w>"):
            assert len(counter.library.model.tokenize(t[:-4])) == 1


def test_segments_and_blocks_of_long_texts(counter, monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("etaoin<|>shé") for _ in range(rng.randint(1, 9))) for _ in range(900)) + "\n" + "x" * 700 + " end"
    assert "".join(pc.segments(text, 300)) == text
    whole = np.cumsum(counter.changes(text))
    monkeypatch.setattr(pc, "SEGMENT", 300)
    monkeypatch.setattr(pc.segments, "__defaults__", (300,))
    got = list(pc.blocks(text, counter, 128))
    assert [b[0] for b in got] == list(range(len(got))) and [b[1] for b in got] == [False] * (len(got) - 1) + [True]
    assert sum(b[4] for b in got) == len(text) and sum(b[5] for b in got) == len(text.encode())
    assert got[-1][8] == whole[-1] and [b[6] for b in got[1:]] == [b[8] for b in got[:-1]]
    for b in got:
        assert b[7] == whole[b[2] : b[2] + b[4]].min()


TEXTS = ["", None, "One two three, four.", "l'été d'avant " * 40, "un" * 400, " \n ", "a<|endoftext|>b", "中国 " * 3, "One two three, four."]


def frame(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 0), (8, "second row of an id", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, tokens long")


def test_query_against_the_library(spark, counter):
    got = pc.query(frame(spark), 20).toPandas()
    want = [(r.doc_id, len((r.text or "").encode()), len(counter.library.encode(r.text or "", add_special_tokens=False).ids)) for r in frame(spark).collect()]
    want = sorted((-1 if d is None else d, b, n, n > 20) for d, b, n in want)
    assert sorted((-1 if pd.isna(r.doc_id) else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.itertuples()) == want
    assert pc.query(frame(spark).limit(0)).count() == 0


def test_questions_asked_of_the_table(spark, counter):
    docs = frame(spark).where("doc_id is not null and coalesce(text, '') <> 'second row of an id'")
    table = pc.build(docs, PATH, 64)
    asked = [(i, c) for i in range(9) for c in (0, 1, 5, 63, 64, 65, 10**9)] + [(99, 1), (0, None), (0, -1)]
    got = {(r.doc_id, r.chars): r.n_tokens for r in pc.at(table, spark.createDataFrame(asked, "doc_id long, chars long"), 64).collect()}
    assert got == {(i, c): len(counter.library.encode((TEXTS[i] or "")[:c], add_special_tokens=False).ids) for i, c in asked if i != 99 and c is not None and c >= 0}
    for limit in (0, 1, 7, 100):
        fit = {r.doc_id: (r.fit_chars, r.fit_tokens, r.whole) for r in pc.longest(table, limit).collect()}
        for i, t in enumerate(TEXTS):
            p = [0, *of_prefixes(counter, t or "")]
            k = max(j for j, n in enumerate(p) if n <= limit)
            assert fit[i] == (k, p[k], k == len(t or "")), (i, limit)
    cut = {r.doc_id: r.text for r in pc.truncated(docs, table, 7).collect()}
    assert set(cut) == set(range(9)) and cut[1] is None
    for i, t in enumerate(TEXTS):
        assert (t or "").startswith(cut[i] or "") and len(counter.library.encode(cut[i] or "", add_special_tokens=False).ids) <= 7
    assert pc.truncated(docs, table, 7).columns == docs.columns

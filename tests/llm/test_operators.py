"""The corpus operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnframe.llm import vectors as vector_tools
from kilnframe.llm import common, crosspolytope, jaccard, lattice, licences, mixing, packing, pst, sharding, suffixes, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kind int, part int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "be", "cor", "de", "el", "fin", "go"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 30)
    for i in range(0, 24, 3):
        texts[i] += "\n" + passage + " " + prose(rng, 3)
    near = texts[40].split()
    near[len(near) // 2] = "zzz"
    texts += [texts[1], texts[1], " ".join(near), texts[40] + " end", "", None, "x", "a b c d", "ab" * 400, "Ünïcödé — 中文 " * 20, "q\x00r" * 30, prose(rng, 6000)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, ["en", "de", None][i % 3], None if i == 7 else f"s{i % 4 if i % 2 else 0}", len(t or ""), 0.5, 1, 1) for i, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- toxicity ---------------------------------------------------------------------


def test_folding_reads_disguised_words():
    assert toxicity.fold("1D10T!") == toxicity.fold("idiot") == toxicity.fold("іdіοt").replace("o", "o")
    assert toxicity.fold("") == toxicity.fold(None or "") == " "
    m = toxicity.Model({toxicity.fold("trash"): 2.0}, ("trash can",), 0.0, 1.0).matcher()
    assert toxicity.rate(toxicity.fold("the trash can is trash"), m) == (2.0 / 5, 1)
    assert toxicity.rate(toxicity.fold("trashy"), m) == (0.0, 0)


def test_toxicity_learns_and_scores(spark, nothing):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        t, y = prose(rng, 40), int(i % 5 == 0)
        if y:
            t += " vileword and sourish" + rng.choice(["a", "em", "on"])
        rows.append((i, t, "en", "s", 1, 0.5, 1, 1))
        labels.append((i, y))
    rows += [(900, "", "en", "s", 0, 0.5, 1, 1), (901, None, None, None, None, None, None, None), (902, "a v1lew0rd here", "en", "s", 1, 0.5, 1, 1), (902, "a v1lew0rd here", "en", "s", 1, 0.5, 1, 1)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.query(d, lab).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0
    kept = toxicity.clean(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}
    assert toxicity.query(nothing, lab).count() == 0
    assert toxicity.query(d, lab.limit(0)).count() == len(rows)


# -- near duplicates --------------------------------------------------------------


def jaccard_brute(rows, width=5, t=0.8):
    sets = {}
    for i, x in rows:
        w = re.split(r"[ \t\n\r\f\v]+", (x or "").lower())
        w = [y for y in w if y]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])} for i in sets}
    low = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in near[i]:
                low[i] = low[j] = min(low[i], low[j])
    return {i: (low[i], len(near[i])) for i in sets}


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join(docs, corpus, nothing, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    want = jaccard_brute(corpus)
    assert got == want and max(n for _, n in want.values()) >= 2
    if block > 2:
        kept = jaccard.distinct(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (c, _) in want.items() if c == i}
        assert jaccard.join(nothing).count() == 0


def test_pruning_follows_the_posterior():
    need = jaccard.needed(0.8, 1e-7)
    for k, m in enumerate(need, 1):
        n = k * jaccard.STEP + 1
        below = [math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(n + 1)]
        assert sum(below[:m]) < 1e-7 <= sum(below[: m + 1])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)]
    low = {}
    for _ in range(400):
        for u, v in edges:
            low[u] = low[v] = min(low.get(u, u), low.get(v, v))
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(u,) for e in edges for u in e], "id long")).collect()}
    assert got == low


# -- suffixes ---------------------------------------------------------------------


def suffix_brute(rows):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            low[b[p : p + 50]] = min(low.get(b[p : p + 50], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, corpus, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(docs).collect()}
    want = suffix_brute(corpus)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 8
    kept = {r.doc_id: r.text for r in suffixes.removed(docs).collect()}
    assert len(kept) == len(corpus) and all((kept[i] or "").encode() == (t or "").encode() for i, t in corpus if not want[i][1])
    assert suffixes.digest(nothing).count() == 0


def test_ids_may_repeat(spark):
    rng = random.Random(3)
    p = prose(rng, 40)
    rows = [(1, p), (1, "other " + prose(rng, 30)), (2, "x" + p), (2, "x" + p), (None, p)]
    got = Counter((r.doc_id, r.n_removed > 0) for r in suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, False): 2, (2, True): 2})


def test_loser_tree_merges():
    rng = random.Random(4)
    pool = [bytes(rng.choice(b"ab") for _ in range(suffixes.WIDTH)) for _ in range(40)]
    pool += [p[:40] + bytes(rng.choice(b"ab") for _ in range(suffixes.WIDTH - 40)) for p in pool]
    for k in (1, 2, 3, 7):
        runs, all_ = [], []
        for _ in range(k):
            mine = sorted(rng.choices(pool, k=rng.randint(0, 30)))
            lcp = [0] * len(mine)
            for i in range(1, len(mine)):
                lcp[i] = next((j for j in range(suffixes.WIDTH) if mine[i][j] != mine[i - 1][j]), suffixes.WIDTH)
            runs.append(suffixes.Run(lcp, b"".join(s[h:] for s, h in zip(mine, lcp)), len(all_)))
            all_ += mine
        out = list(suffixes.loser_tree(runs))
        assert [s for s, _, _ in out] == sorted(all_) and all(all_[r] == s for s, _, r in out)
        assert all(h == next((j for j in range(suffixes.WIDTH) if out[i][0][j] != out[i - 1][0][j]), suffixes.WIDTH) for i, (_, h, _) in enumerate(out) if i)


# -- packing ----------------------------------------------------------------------


def test_tokenizer_gives_the_librarys_ids():
    t = tokens.WordTokenizer(TOKENIZER)
    rng = random.Random(6)
    chars = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA0, 0x250), 0x2019, 0x2026, 0x20AC, 0x1C, 0x85, 0x3A3, 0x130, 0x4E00, 0x301)]
    for _ in range(800):
        s = "".join(rng.choice(chars if rng.random() < 0.5 else chars[5:100]) for _ in range(rng.randint(0, 40)))
        assert t.encode(s).tolist() == t.library.encode(s, add_special_tokens=False).ids


def test_packing_is_whole(docs, corpus, nothing):
    got = packing.pack(docs, TOKENIZER, window=128, shard_bytes=20_000).toPandas()
    t = tokens.WordTokenizer(TOKENIZER)
    for i, text in corpus:
        ids = np.append(t.encode(text or "").astype("<u4"), np.uint32(1))
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.start.tolist() == np.r_[0, np.cumsum(mine.length)[:-1]].tolist() and mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = int(g.length.sum())
        assert g.offset.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist() and n <= 128 and n & (n - 1) == 0
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_neighbours_are_alike():
    a, b = np.array([5, 6, 7, 8] * 4, np.uint16), np.array([9, 10, 11] * 4, np.uint16)
    others = [np.array([100 + 3 * k, 101 + 3 * k], np.uint16) for k in range(8)]
    s = packing.Index([a, b, a[:8], *others]).scores(0)
    assert int(np.argsort(-s)[1]) == 2 and s[1] == 0
    long = [np.arange(k, k + 300, dtype=np.uint16) for k in range(0, 900, 100)]  # all terms count, not only the heaviest
    ix = packing.Index(long)
    doc, term, w = packing.Corpus(9, 2700, np.bincount(packing.postings(long)[1], minlength=packing.TERMS)).weigh(long)
    for d in range(9):
        brute = [sum(x for i, t, x in zip(doc, term, w) if i == other and t in set(long[d].tolist())) for other in range(9)]
        unused = np.arange(9) >= d
        assert np.allclose(np.where(unused, ix.scores(d, unused), 0), np.where(unused, brute, 0))


def test_packing_files_like_documents_together(spark):
    rng = np.random.default_rng(4)
    topics = [[f"{chr(97 + k)}{''.join(chr(97 + x) for x in rng.integers(0, 26, 7))}" for _ in range(40)] for k in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8], 60))) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a large group of copies
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, window=256, shard_bytes=20_000).toPandas()
    assert got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all() and got.doc_id.nunique() == 700
    got["topic"] = np.where(got.doc_id >= 1000, 3, got.doc_id % 8)
    same = got.groupby("sequence_id").topic.nunique()
    assert (same == 1).mean() > 0.7
    tokens_of = got.assign(shard=got.sequence_id // 2**22).groupby("shard").length.sum()
    assert tokens_of.max() * 4 < 3 * 20_000
    base, parts, n = packing.directory(np.array([5, 0, 7, 25, 3, 3, 6]), 10)
    assert n == 7 and base.tolist() == [0, 0, 1, 2, 5, 5, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]


# -- mixing and sharding ----------------------------------------------------------


def test_mixing_meets_its_targets(spark, docs, nothing):
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", 10 + 7 * a * b + c) for a in range(3) for b in range(2) for c in range(2)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"l0": 0.6, "l1": 0.4}, "topic": {"t0": 0.5, "t1": 0.5}}
    got = mixing.rake(cells, goal).withColumn("m", F.col("tokens") * F.col("weight"))
    total = got.agg(F.sum("tokens")).first()[0]
    for d, shares in goal.items():
        assert all(abs(r.m / total - shares[r[d]]) < 1e-6 for r in got.groupBy(d).agg(F.sum("m").alias("m")).collect())
    p = mixing.rated(got, 0.5)
    assert abs(p.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] - total / 2) < 1e-6
    assert mixing.mix(docs).count() == docs.count() and mixing.sampled(docs).columns == docs.columns
    assert mixing.mix(nothing).count() == 0


def test_sharding_splits_only_what_is_too_large(docs, corpus, nothing, spark):
    got = sharding.assign(docs, 4000).collect()
    h = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i, _ in corpus}
    size = {i: len((t or "").encode()) for i, t in corpus}
    for r in got:
        inside = [i for i in h if h[i].startswith(r.shard)]
        assert h[r.doc_id].startswith(r.shard) and (sum(size[i] for i in inside), len(inside)) == (r.shard_bytes, r.shard_docs)
        assert r.shard_bytes <= 4000 or r.shard_docs == 1
        up = [i for i in h if r.depth and h[i].startswith(r.shard[:-1])]
        assert not r.depth or sum(size[i] for i in up) > 4000
    assert len(got) == len(corpus) and sharding.assign(nothing, 4000).count() == 0
    hot = sharding.assign(spark.createDataFrame([("k", "x" * 100)] * 30 + [(None, None)], "key string, text string"), 500, "key")
    assert hot.count() == 31 and hot.agg(F.max("shard_bytes")).first()[0] <= 500


# -- vectors ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    for k in range(40):
        x[k + 100] = x[k] + 0.1 * rng.standard_normal(64).astype(np.float32)
    x[200] = x[201] = x[300]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 64, 1), (1040, [float("nan")] + [1.0] * 63, 1), (1060, [None] + [1.0] * 63, 1), (1080, [float("inf")] * 64, 0), (1100, x[3].tolist(), None)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("v", F.lit(2)), rows


def test_search(vectors):
    x, df, _ = vectors
    y = np.vstack([x, x[3:4]]).astype(np.float64)
    ids = np.r_[np.arange(400), 1100]
    got = crosspolytope.query(df).toPandas()
    hit = 0
    for q in [*range(0, 400, 20), 1100]:
        s = y @ y[list(ids).index(q)]
        order = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 9)))] if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [y[list(ids).index(i)] @ y[list(ids).index(q)] for i in mine.vec_id])
        hit += len(set(order) & set(mine.vec_id))
    assert hit / (21 * 20) >= 0.95 and not set(got.vec_id) & {1000, 1020, 1040, 1060, 1080}
    assert crosspolytope.query(df.limit(0)).count() == 0
    few = crosspolytope.query(df.where("vec_id < 5"))
    assert few.count() == 4


def test_search_of_repeated_ids_and_full_cells(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base + 1e-3 * rng.standard_normal(16)).tolist()) for i in range(60)] + [(20, rng.standard_normal(16).tolist()), (7, (base * 2).tolist())]
    got = crosspolytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, block=8).toPandas()
    for q in (0, 20, 40):
        best = {}
        for a in (np.array(v) for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -1e9), float(np.array(v) @ a))
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == sorted(best, key=lambda i: (-best[i], i))[:5] and np.allclose(mine.score, sorted(best.values())[::-1][:5])


def test_the_index_is_selective():
    """Recall against all inner products, and the share of all vectors that are candidates, on 50,000 unit vectors without any structure."""
    rng = np.random.default_rng(11)
    x = vector_tools.unit(rng.standard_normal((50_000, 64)))
    assert [crosspolytope.second_axes(n, 64) for n in (0, 500, 2_000, 50_000, 200_000, 10**9)] == [1, 1, 4, 128, 512, 16384]
    q = np.arange(0, 50_000, 500)
    found = [set() for _ in q]
    for t in range(crosspolytope.TABLES):
        i, j = crosspolytope.own_cells(x, t, 128)
        code = i * 128 + j
        o = np.argsort(code, kind="stable")
        a, b = crosspolytope.probed_cells(x[q], t, 128, crosspolytope.PROBES)
        low, high = (np.searchsorted(code[o], a * 128 + b, side) for side in ("left", "right"))
        for k in range(len(q)):
            for l, h in zip(low[k], high[k]):
                found[k].update(o[l:h].tolist())
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    near = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(f & set(n.tolist())) / 20 for f, n in zip(found, near)]) >= 0.9
    assert np.mean([len(f) for f in found]) < 0.15 * len(x)


def test_lattice(vectors):
    x, df, rows = vectors
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in lattice.query(df).collect()}
    assert len(got) == len(rows) and sum(r.n_links for r in got.values()) >= 0.98 * near.sum() > 0
    assert all(got[i].n_links <= near[i].sum() for i in range(400))
    assert got[300].component_id == got[200].component_id == 200 and not got[300].kept
    assert all(got[i].kept and got[i].n_links == 0 for i in (1000, 1020, 1040, 1060, 1080, 1100))
    assert lattice.query(df.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    y = rng.standard_normal((200, 8)) * 2
    z = lattice.decode(y)
    assert len(lattice.roots()) == 240
    d = ((y - z) ** 2).sum(1)
    assert all(((y - z - r) ** 2).sum(1).min() >= 0 and (((y - z - r) ** 2).sum(1) >= d - 1e-9).all() for r in lattice.roots())


# -- language model ---------------------------------------------------------------


def tree_brute(rows, out, rule, depth=3):
    """Counts, the base and the tree's score of each text, and the kept contexts, with dicts."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in rows]
    c, after = Counter(), {}
    for ws, o in zip(words, out):
        if not o:
            c.update(ws)
            for k in range(len(ws)):
                for d in range(1, min(depth, k) + 1):
                    after.setdefault(tuple(ws[k - d : k]), Counter())[ws[k]] += 1
    n, v, kept = sum(c.values()), len(c), {}

    def p(ctx, w):
        if not ctx:
            return (c[w] + 1) / (n + v + 1)
        q = p(ctx[1:], w)
        if ctx in kept:
            a = after[ctx]
            return (a[w] + rule.kappa * q) / (sum(a.values()) + rule.kappa)
        return q

    for ctx, a in sorted(after.items(), key=lambda x: len(x[0])):
        m = sum(a.values())
        if m >= rule.least and sum(k * math.log((k - 1 + rule.kappa * q) / (m - 1 + rule.kappa) / q) for w, k in a.items() for q in [p(ctx[1:], w)]) >= rule.gain:
            kept[ctx] = m
    score = [sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), w)) for k, w in enumerate(ws)) for ws in words]
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) for ws in words]
    return words, c, n, base, score, kept


@pytest.mark.parametrize("hot", [100_000, 10])
def test_suffix_tree_scores(docs, corpus, nothing, hot, monkeypatch):
    monkeypatch.setattr(pst, "HOT", hot)
    monkeypatch.setattr(pst, "BLOCK_BYTES", 9_000)
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus]
    words, c, n, base, score, kept = tree_brute(corpus, out, pst.Rule())
    got = {r.doc_id: r for r in pst.query(docs).collect()}
    for (i, _), o, ws, b, s in zip(corpus, out, words, base, score):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (o, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(g.base_score, b, rel_tol=1e-9) and math.isclose(g.score, s, rel_tol=1e-6), i
    assert max(map(len, kept)) == 3 and any(m > 10 for m in kept.values())
    assert sum(score) > sum(base)
    if hot > 10:
        assert pst.query(nothing).count() == 0


def test_pairs_are_in_order():
    rng = np.random.default_rng(8)
    c = rng.choice(np.r_[np.arange(5), 2**40 + np.arange(3), rng.integers(0, 2**63, 40)], 3000).astype(np.uint64)
    s = rng.integers(0, 2**12, 3000).astype(np.uint64)
    o = pst.by_context(c, s)
    assert list(zip(c[o], s[o])) == sorted(zip(c, s))


def test_suffix_tree_grows_with_the_corpus(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 40) + " fixed words that come again " + prose(rng, 40)) for i in range(60)]
    more = [(1000 + i, " ".join(rng.choice("hjkmpsuvw") for _ in range(2_000))) for i in range(40)]
    small, large = (tree_brute(r, [False] * len(r), pst.Rule())[-1] for r in (rows, [*rows, *more]))
    assert ("fixed", "words", "that") in small and {x for x in small if x[0] == "fixed"} <= large.keys()


def test_suffix_tree_ids_may_repeat(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d"), (None, "a b")], "doc_id long, text string")
    got = pst.query(d).collect()
    assert sorted(r.n_tokens for r in got) == [2, 4, 4] and {r.train_tokens for r in got} == {0 if zlib.crc32(b"1") % 7 == 2 else 10}


# -- licences ---------------------------------------------------------------------


def test_licences(spark, nothing):
    rng = random.Random(8)
    rows = [(i, "\n".join(prose(rng, 20) for _ in range(4))) for i in range(30)]
    rows += [(100 + k, prose(rng, 20) + "\n" + t + "\n" + prose(rng, 9)) for k, t in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    rows += [(300, "the licence of a fisher and the gnu in the wild, a public version"), (301, ""), (302, None), (302, None)]
    want = {100 + k: f for k, f in enumerate(f for f, ts in licences.TEMPLATES.items() for _ in ts)}
    got = {r.doc_id: r for r in licences.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(got[i].families == f for i, f in want.items())
    assert right >= 0.9 * len(want)
    assert all(got[i].families == "" for i in (*range(30), 300, 301, 302))
    assert licences.query(nothing).count() == 0


def test_licences_wrapped(spark):
    import textwrap

    rng = random.Random(11)
    long = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(t) > 80]
    rows = [(i, "\n".join(prose(rng, 20) for _ in range(4))) for i in range(30)]
    rows += [(100 + k, prose(rng, 9) + "\n\n" + "\n".join("# " + x for x in textwrap.wrap(t, 60)) + "\n\n" + prose(rng, 9)) for k, (_, t) in enumerate(long)]
    rows += [(200, "Released under the MIT License.\nLicensed under CC BY 4.0.")]
    got = {r.doc_id: r for r in licences.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[100 + k].families, got[100 + k].n_licensed) for k in range(len(long))] == [(f, 1) for f, _ in long]
    assert (got[200].families, got[200].n_licensed) == ("CC-BY,MIT", 2)
    assert all(got[i].n_licensed == 0 for i in range(30))


@pytest.mark.parametrize("sigma", [0.0, 0.5])
def test_polytope_recall_by_inner_product(spark, sigma):
    """Norms of all sizes: most of the 20 largest inner products are found, among far fewer than all vectors, and scores are exact."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 32))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, sigma, (6000, 1))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()})).repartition(4)
    got = crosspolytope.search(df, F.col("vec_id") % 100 == 0, k=20).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        ip = x @ x[q]
        ip[q] = -np.inf
        hit += len(set(np.argsort(-ip)[:20]) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, ip[g.sort_values("rank").vec_id])
    assert hit / (60 * 20) >= 0.9


def test_ranges_of_norms():
    assert crosspolytope.ranges(np.array([1.0, 1.0 - 1e-9, 0.8, 0.5, 1e-9]), 1.0).tolist() == [0, 0, 1, 3, crosspolytope.RANGES - 1]
    assert np.allclose(crosspolytope.norms(np.array([[3e300, 4e300], [3e-300, 4e-300]])), [5e300, 5e-300])


def test_marks_of_a_text_are_covered_at_once():
    """All offsets together, not one after another: a text takes few steps, whatever its marks are."""
    import sys
    import zlib

    from kilnframe.llm import suffixes

    rng = np.random.default_rng(4)
    raw = rng.integers(97, 123, 900).astype(np.uint8).tobytes()
    pos = np.sort(rng.choice(np.arange(34, 850), 40, replace=False))
    bits = rng.integers(0, 1 << 35, 40)
    tag = np.full(40, zlib.crc32(raw))
    tag[::9] += 1  # marks of another text
    want = np.zeros(len(raw), bool)
    for t, p, b in zip(tag.tolist(), pos.tolist(), bits.tolist()):
        for o in range(35):
            if t == tag[1] and b >> o & 1:
                want[p - o : p - o + 50] = True
    lines = []

    def trace(frame, event, _):
        if frame.f_code is not suffixes.covered.__code__:
            return None
        lines.append(event)
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        got = suffixes.covered(raw, tag, pos, bits)
    finally:
        sys.settrace(before)
    assert got.tolist() == want.tolist() and len(lines) < 30

"""The ten operators against brute force, on small fixtures and on hard input."""

import collections
import math
import os
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm.common import agreed, sampled
from loomtext.llm import decontaminate, fingerprints, kernel, langid, licenses, mixing, ngram_join, pst, quality, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(kernel.WORD_RE)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, `group` string, spans string"


def split(t):
    return WORD.findall((t or "").lower())


def frame(spark, rows):
    """(doc_id, text[, lang, source]) with extra columns of clashing names."""
    full = [(i, t, (r or ["en"])[0], (r + ["en", "s"])[1] if len(r) > 1 else "s", len(t or ""), 7, "x", None) for i, t, *r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 7)))
    base = [" ".join(word() for _ in range(90)) for _ in range(4)]
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(1500))
    rows = [(1, None), (2, ""), (3, " .\n"), (4, base[0]), (5, base[0]), (5, base[0]), (6, base[1] + " " + base[2]), (7, base[2] + " tail end"), (8, long), (9, long + " more"), (None, base[3]), (10, "Ünï"), (11, base[3]), (12, " ".join(["la"] * 400))]
    return rows


def everything(spark, docs, bench, labels):
    return {
        "langid": langid.identify(docs), "pairs": ngram_join.similar_documents(docs), "spans": suffix_dedup.repeated_spans(docs), "leaks": decontaminate.find_leaks(docs, bench),
        "mix": mixing.schedule(docs), "licenses": licenses.scan(docs), "fingerprints": fingerprints.fingerprints(docs), "pst": pst.score(docs),
        "quality": quality.score(docs, labels), "toxicity": toxicity.score(docs, labels),
    }


def test_hard_input(spark, hard):
    docs = frame(spark, hard)
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(0, None), (1, ""), (None, "a b"), (2, hard[3][1][:200])], "item_id bigint, text string")
    got = {k: v.collect() for k, v in everything(spark, docs, bench, labels).items()}
    n = len(hard)
    assert all(len(got[k]) == n for k in ("langid", "pst", "quality", "toxicity"))
    assert {r.doc_id for r in got["langid"] if r.rejected} == {1, 2, 3}
    assert {(r.doc_id_a, r.doc_id_b) for r in got["pairs"]} >= {(4, 5), (8, 9)}
    assert {r.doc_id for r in got["leaks"] if r.item_id == 2} == {4, 5}
    assert {r.doc_id for r in got["fingerprints"]} == {i for i, _ in hard if i is not None}
    assert [r.toxic for r in got["toxicity"] if r.doc_id == 1] == [False]
    for stage in (langid.keep_identified(docs), ngram_join.keep_one(docs), suffix_dedup.drop_repeats(docs), decontaminate.drop_leaks(docs, bench)):
        assert stage.columns == docs.columns
        assert stage.count() >= 1
    left = suffix_dedup.drop_repeats(docs).collect()
    assert {r.doc_id for r in left} == {1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, None}
    assert next(r for r in left if r.doc_id == 7).text == "tail end" and next(r for r in left if r.doc_id == 7).n_chars == 8


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench, labels = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, df in everything(spark, docs, bench, labels).items():
        assert df.count() == 0, name
    for stage in (langid.keep_identified(docs), ngram_join.keep_one(docs), suffix_dedup.drop_repeats(docs), decontaminate.drop_leaks(docs, bench)):
        assert stage.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    mine = df.toPandas()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
        theirs = con.execute(queries.ORACLES[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        rows = lambda t: sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in t[sorted(t.columns)].itertuples(index=False))
        assert rows(mine) == rows(theirs)
    else:
        assert "doc_id" in mine.columns


# 1 ------------------------------------------------------------------------------------------
def test_gradients():
    net = toxicity.Network(5, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((3, 6, 5)), np.array([1.0, 0, 1])
    mask = np.ones((3, 6))
    mask[1, 4:] = 0
    _, g, dx = net.gradients(x, mask, y)
    for k in ("Wf", "Wb", "Uf", "Ub", "cf", "cb", "A", "a", "v", "w", "b"):
        at = tuple(rng.integers(n) for n in net.p[k].shape)
        old, e = net.p[k][at], 1e-5
        net.p[k][at] = old + e
        up = net.gradients(x, mask, y)[0]
        net.p[k][at] = old - e
        down = net.gradients(x, mask, y)[0]
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-6, k
    x2 = x.copy()
    x2[0, 2, 1] += 1e-5
    assert abs((net.gradients(x2, mask, y)[0] - net.gradients(x, mask, y)[0]) / 1e-5 - dx[0, 2, 1]) < 1e-4


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1").select("doc_id", labels.toxic.alias("y")), "doc_id").select("doc_id", "text", "y").toPandas()
    score = model.judge(pa.array(held.text.tolist()))[1]
    found = score >= 0.5
    assert found[held.y == 1].mean() > 0.9 and found[held.y == 0].mean() < 0.03
    n = model.judge(pa.array(["w " * 100, "w " * 32, "w", ""]))[0]
    assert n.tolist() == [6, 1, 1, 0]


def test_toxicity_by_plain_loops():
    """Windows, inputs, both recurrent units, attention and the worst window, one word at a time."""
    rng = random.Random(13)
    word = lambda end: "".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) + end
    texts = [" ".join(word("xyz" if i % 2 and rng.random() < 0.3 else "") for _ in range(rng.randrange(1, 90))) for i in range(40)]
    model = toxicity.Model(texts, [i % 2 for i in range(40)])
    p, k = {n: v.astype(float) for n, v in model.net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def codes(b, n, rows):
        cut = [b[i : i + n].ljust(n) for i in range(max(len(b) - n + 1, 1))]
        return [int(kernel.mix(np.array([int.from_bytes(c, "big")], np.uint64))[0]) % rows for c in cut]

    def vector(w):
        h, quads, tri = int(kernel.word_hash(w)), codes(w.encode(), 4, toxicity.ODDS_ROWS), codes(w.encode(), 3, toxicity.CHAR_ROWS)
        known = [o for x, o in zip(model.known.tolist(), model.odds) if x == h] or [0]
        return np.concatenate([[known[0], max(model.quads[q] for q in quads), min(len(quads), 20) / 10], p["word"][h % toxicity.WORD_ROWS], np.mean([p["char"][c] for c in tri], 0)])

    def logit(words):
        x, states = [vector(w) for w in words], {}
        for d in "fb":
            h = np.zeros(k)
            for t in range(len(x)) if d == "f" else reversed(range(len(x))):
                g, s = x[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                z, r = sigmoid(g[:k] + s[:k]), sigmoid(g[k : 2 * k] + s[k : 2 * k])
                h = z * h + (1 - z) * np.tanh(g[2 * k :] + r * s[2 * k :])
                states[d, t] = h
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(x))]
        e = np.array([math.exp(np.tanh(s @ p["A"] + p["a"]) @ p["v"]) for s in both])
        return float(sum(w * s for w, s in zip(e / e.sum(), both)) @ p["w"] + p["b"][0])

    held = [*texts[:6], "unseen words here", "", None, *(" ".join(word("") for _ in range(n)) for n in (31, 32, 33, 48, 49, 70))]
    n, score, at = model.judge(pa.array(held, pa.large_string()))
    for i, t in enumerate(held):
        w = split(t)
        starts = [s for s in range(0, len(w), 16) if s == 0 or s + 16 < len(w)] if w else []
        each = {s: sigmoid(logit(w[s : s + 32])) for s in starts}
        assert n[i] == len(each)
        assert abs(score[i] - max(each.values(), default=0)) < 1e-4 and (not each or each[at[i]] > score[i] - 1e-4)


# 2 ------------------------------------------------------------------------------------------
def test_weights():
    tokens = {"a": 900, "b": 60, "c": 40}
    a, w = mixing.weights(tokens, 1000, entropy=0.8, repeats=100)
    h = -sum(p * math.log(p) for p in w.values())
    assert 0 < a < 1 and abs(h - 0.8 * math.log(3)) < 1e-4
    a, w = mixing.weights(tokens, 1000, entropy=1.0, repeats=3)
    assert abs(max(1000 * p / tokens[k] for k, p in w.items()) - 3) < 1e-3
    assert mixing.weights({}, 10) == (1.0, {}) and mixing.weights({"a": 5}, 10) == (1.0, {"a": 1.0})


def test_schedule(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", "hot" if i % 4 else f"s{i % 3}") for i in range(400)]
    got = mixing.schedule(frame(spark, rows), block_tokens=100).collect()
    tokens = collections.Counter()
    for i, t, _, s in rows:
        tokens[s] += len(t.split())
    budget = sum(tokens.values())
    exponent, share = mixing.weights(tokens, budget)
    each = mixing.budgets(tokens, budget, exponent, share)
    assert 0 < exponent < 1 and sum(each.values()) == budget
    for s, most in each.items():
        own = [r for r in got if r.source == s]
        assert abs(most - budget * share[s]) <= 1 + budget / 1e9
        spent = sum(r.n_tokens for r in own)
        left_out = [len(t.split()) for i, t, _, x in rows if x == s and t and not any(r.doc_id == i and r.epoch == most // tokens[s] for r in own)]
        assert most - max(left_out) <= spent <= most
        for epoch in range(most // tokens[s]):
            assert sum(r.n_tokens for r in own if r.epoch == epoch) == tokens[s]


def test_exponent_one_loses_nothing(spark):
    """The budget of the corpus at its own weights shows each document once, a null source and repeated rows included."""
    rng = random.Random(3)
    for _ in range(500):
        tokens = {f"s{i}": rng.randrange(1, 10**6) for i in range(rng.randrange(1, 25))}
        total = sum(tokens.values())
        exponent, share = mixing.weights(tokens, total, entropy=0.0)
        assert exponent == 1 and mixing.budgets(tokens, total, exponent, share) == tokens
    rows = [(i, "w " * rng.randrange(1, 40), "en", rng.choice(["a", "b", None])) for i in range(200)] + [(3, "x y", "en", "a")] * 2 + [(None, "z", "en", None)]
    got = mixing.schedule(frame(spark, rows), entropy=0.0, block_tokens=50).collect()
    assert sorted((r.doc_id or -1, r.source, r.n_tokens) for r in got) == sorted((i or -1, s or "", len(t.split())) for i, t, _, s in rows)


def test_registered_mix_is_tempered(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = mixing.counted(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        tokens = {r[0]: r[1] for r in rows.groupBy("source").sum("n_tokens").collect()}
        exponent, _ = mixing.weights(tokens, sum(tokens.values()), queries.MIX_ENTROPY, queries.MIX_REPEATS)
        assert 0 < exponent < 1


# 3 ------------------------------------------------------------------------------------------
def test_license_diagonals(spark):
    text = "x y " + licenses.TEMPLATES["MIT"].replace("free of charge", "free of any charge") + " z"
    got = {r.license: r for r in licenses.scan(frame(spark, [(1, text), (2, "licensed under the sea"), (3, licenses.TEMPLATES["MIT notice"])])).collect() for _ in [0]}
    assert (got["MIT"].doc_id, got["MIT"].start_word) == (1, 2) and got["MIT"].coverage > 0.8
    assert got["MIT notice"].doc_id == 3 and got["MIT notice"].coverage == 1 and 2 not in {r.doc_id for r in got.values()}
    assert licenses.scan(frame(spark, [(1, text)]), {}).count() == 0


def test_license_spans_are_verified(spark):
    """Words are compared in order: replaced ones don't count, nor do grams of the template out of order."""
    t = [f"t{i}" for i in range(30)]
    third = [w if i < 10 or i >= 20 else "x" for i, w in enumerate(t)]  # a third of the words replaced, 20 left
    half = t[:9] + ["x"] * 14 + t[23:]
    turned = [w for i in range(24, -1, -6) for w in t[i : i + 6]]  # every gram of six words, in the wrong order
    rows = [(1, " ".join(["a"] * 5 + third + ["b"] * 5)), (2, " ".join(half)), (3, " ".join(turned)), (4, " ".join(t * 3)), (5, " ".join(f"{w} y" for w in t))]
    got = licenses.scan(frame(spark, rows), {"T": " ".join(t)}).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.matched_words) for r in got) == [(1, 5, 35, 20), (4, 0, 30, 30), (4, 30, 60, 30), (4, 60, 90, 30)]


# 4 ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("threshold", [0.45, 0.8])
def test_jaccard_join(spark, threshold, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 40, 70]))] for _ in range(40)]
    rows = []
    for b in base * 4:
        b = [w if rng.random() > 0.04 else f"w{rng.randrange(60)}" for w in b]
        rows.append((len(rows), " ".join(b)))
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)])
    rep = {}
    for i, s in sets.items():
        rep.setdefault(s, i)
    per = math.ceil(threshold * 1000 - 1e-9)
    want = {(rep[s], i) for i, s in sets.items() if rep[s] != i}
    reps = sorted(rep.items(), key=lambda x: x[1])
    want |= {(i, j) for k, (a, i) in enumerate(reps) for b, j in reps[k + 1 :] if len(a & b) * 1000 >= len(a | b) * per}
    root = {i: i for i in sets}
    for i, j in sorted(want) * len(sets):  # until nothing changes
        root[i] = root[j] = min(root[i], root[j])
    links = collections.Counter(k for a, i in reps for b, j in reps if i != j and tuple(sorted((i, j))) in want for k in [a])
    same = collections.Counter(sets.values())
    for light, block in ((None, None), (0, 30), (10, 200), (10**6, None)) if threshold < 0.5 else ((10, 30),):  # whatever the boundary and the size of a block, the pairs are the same
        with monkeypatch.context() as patch:
            if light is not None:
                patch.setattr(ngram_join, "boundary", lambda s, light=light: light)
            if block is not None:
                patch.setattr(ngram_join, "BLOCK_GRAMS", block)
            got = ngram_join.similar_documents(frame(spark, rows), threshold=threshold).collect()
            assert {(r.doc_id_a, r.doc_id_b) for r in got} == want and len(got) == len(want)
            got = ngram_join.classes(frame(spark, rows), threshold=threshold).collect()
            assert sorted(map(tuple, got)) == [(i, root[i], same[s] - 1, links[s]) for i, s in sorted(sets.items())]


def test_overlaps_and_forest():
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 50, rng.integers(1, 30))) for _ in range(n)] for n in (7, 9))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
    assert ngram_join.overlaps(x, y, 8).tolist() == want and ngram_join.overlaps(x, y).tolist() == want
    linked = np.zeros((9, 9), bool)
    for a, b in ((0, 8), (8, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert ngram_join.forest(linked).tolist() == [0, 1, 1, 0, 4, 0, 6, 7, 0]


def test_near_copies_are_settled_by_distances(monkeypatch):
    """Links and classes of a cell are those of all pairs, while near copies of one text aren't compared in pairs."""
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 40, 80) for _ in range(2)]

    def sets(n, most, of):
        return [np.unique(np.concatenate([b[rng.random(80) >= rng.random() * most], rng.integers(0, 1 << 40, rng.integers(1, 20))])) for b in (base[rng.integers(0, of)] for _ in range(n))]

    compared, whole = [], ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda x, y, *a: compared.append(len(x) * len(y)) or whole(x, y, *a))
    for most, of, centred in ((0.1, 1, 1), (0.8, 1, 1), (0.8, 2, 1), (0.8, 2, 1 << 40)):
        monkeypatch.setattr(ngram_join, "CENTRED", centred)
        x, y = sets(40, most, of), sets(30, most, of)
        for a, b in ((x, x), (x, y)):
            size_a, size_b = (np.array([len(s) + 3 for s in c]) for c in (a, b))  # some grams are in no other set
            compared.clear()
            n, first = ngram_join.links(a, b, size_a, size_b, 450, a is b)
            assert (sum(compared) == 0) == (most == 0.1)
            linked = np.array([[1000 * (o := len(np.intersect1d(s, t))) >= 450 * (p + q - o) for t, q in zip(b, size_b)] for s, p in zip(a, size_a)])
            if a is b:
                np.fill_diagonal(linked, False)
            else:
                linked = np.block([[np.zeros((40, 40), bool), linked], [linked.T, np.zeros((30, 30), bool)]])
            assert n.tolist() == linked.sum(1).tolist() and first.tolist() == ngram_join.forest(linked).tolist()


def test_keep_one_of_many_near_copies(spark, monkeypatch):
    """The pipeline's stage doesn't compare the near copies of a text in pairs."""
    rng, whole = random.Random(4), ngram_join.overlaps

    def few(x, y, *a):
        if len(x) * len(y) >= 4096:
            raise AssertionError("near copies are compared in pairs")
        return whole(x, y, *a)

    monkeypatch.setattr(ngram_join, "overlaps", few)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"v{rng.randrange(40)}" for w in words)) for k in range(1, 301)]
    assert sorted(r.doc_id for r in ngram_join.keep_one(frame(spark, [*rows, (301, "something else in here")])).collect()) == [1, 301]


def test_large_group_of_near_copies_names_few_rows(spark, monkeypatch):
    """Near copies meet in few blocks, and their number doesn't make them light."""
    rng, found, whole = random.Random(6), [], ngram_join._cells

    def cells(placed, light, per_mille):
        found.append((placed.select("block").distinct().count(), ngram_join._keys(placed, light, per_mille).count()))
        return whole(placed, light, per_mille)

    monkeypatch.setattr(ngram_join, "_cells", cells)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(w if rng.random() > 0.06 else f"v{rng.randrange(10)}" for w in words)) for k in range(400)]
    assert ngram_join.keep_one(frame(spark, rows)).count() < 400
    blocks, keys = found[0]
    assert blocks <= 20 and keys <= 5000


def test_keep_one_of_each_class(spark):
    """Nulls, repeated rows, several texts of a doc_id, clashing names."""
    a, b, c = ("one two three four five six seven", "red green blue black white grey pink", "alpha beta gamma delta")
    rows = [(5, a), (3, a), (3, a), (3, b), (9, b), (None, b), (None, c), (None, c), (7, ""), (7, ""), (8, None), (4, a + " eight")]
    docs = frame(spark, rows).withColumnsRenamed({"h": "fp", "group": "KEY"})
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=order) == [(3, a), (3, b), (7, ""), (7, ""), (8, None), (None, c)]
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.classes(docs).collect()}
    assert got == {3: (3, 2, 1), 4: (3, 0, 1), 5: (3, 1, 1), 9: (3, 1, 0), 7: (7, 0, 0), 8: (8, 0, 0)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(50, 60)], "u bigint, v bigint")
    assert {r.node: r.root for r in ngram_join.components(edges).collect()} == {**{i: 0 for i in range(21)}, 50: 50, 60: 50}


# 5 ------------------------------------------------------------------------------------------
def test_sketch_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 200):
        a = rng.integers(1, 2**59, 300).astype(np.uint64)
        b = np.concatenate([a[n:], rng.integers(1, 2**59, n).astype(np.uint64)])
        zero = lambda x: np.zeros(len(x), np.int64)
        for cells in (24, 48, 96, 192, 384, 768, 1536):
            row, d, sign, whole = fingerprints.peel(fingerprints.subtract(fingerprints.sketches(a, zero(a), 1, cells, 1), fingerprints.sketches(b, zero(b), 1, cells, 1)), 1)
            if whole[0]:
                break
        assert whole[0] and set(d[sign == 1]) == set(a) - set(b) and set(d[sign == -1]) == set(b) - set(a)


def test_links_are_of_most_paragraphs(spark):
    rng = random.Random(12)
    sets = [{0, 1, 2, 3}, {0, 9}, {1, 8}, {2, 9}, {3, 8}, {0, 1, 2, 3}]  # each paragraph of the last has another last holder
    for _ in range(200):
        base = set(rng.choice(sets)) if rng.random() < 0.6 else set()
        sets.append(base - set(rng.sample(range(40), 8)) | {min(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(5))})
    docs = frame(spark, [(i, "\n".join(f"line {x}" for x in s)) for i, s in enumerate(sets)])
    want = {}
    for i, s in enumerate(sets):
        best = max(((len(s & sets[j]), j) for j in range(i)), default=(0, -1))
        if s and best[0] * 2 >= len(s):
            want[i] = best[1]
    got = {r.doc_id: r.prev_id for r in fingerprints.links(fingerprints.paragraphs(docs)).collect()}
    assert got == want and got[5] == 0


# 6 ------------------------------------------------------------------------------------------
def test_lcs():
    rng = random.Random(6)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {x: sum(1 << i for i, y in enumerate(a) if y == x) for x in a}
        assert decontaminate.lcs_length(masks, len(a), b) == t[-1][-1]


def test_leaks(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = docs.select("doc_id", "text").collect(), [(r[0], " ".join(split(r[1]))) for r in bench.collect()]
    plain = [(r[0], " " + " ".join(split(r[1])) + " ") for r in rows]
    true = {(d, i) for d, t in plain for i, w in items if f" {w} " in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert len(true & got) >= 0.95 * len(true) and len(got - true) <= 0.05 * len(true)
    rng = random.Random(7)
    bent = [(10**6 + i, "some words before it " + " ".join(w for w in t.split() if rng.random() > 0.12) + " and after") for i, t in items if len(t.split()) > 25]
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame(bent, "doc_id bigint, text string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(extra, bench).collect()}
    assert sum((d, d - 10**6) in found for d, _ in bent) >= 0.9 * len(bent)


def test_latent_space(spark):
    """The distributed sketch gives the leading right singular vectors of the passages' matrix."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(40))) for i in range(60)]
    items = decontaminate.Items([(0, " ".join(f"w{i}" for i in range(30)))])
    items.weigh(np.ones(30, np.float32))
    x = []
    for _, t in rows:
        w = [int(np.searchsorted(items.vocabulary, kernel.word_hash(v))) for v in t.split()]
        for s in range(0, 40, 16):
            v = np.bincount(w[s : s + 32], minlength=30).astype(float)
            x.append(v / math.sqrt(len(w[s : s + 32])))
    s, v = np.linalg.svd(np.array(x))[1:]
    got = decontaminate.singular_vectors(frame(spark, rows).repartition(3), items, rank=30)
    norm = np.linalg.norm(got, axis=0)
    assert np.allclose(1 / norm[:5], s[:5], rtol=1e-2)
    assert np.allclose(np.abs((got[:, :3] / norm[:3] * v[:3].T).sum(0)), 1, atol=1e-2)


def test_leaks_by_brute_force(spark):
    """All passages against all items: dense matrix and singular vectors, textbook subsequences, the answer rule."""
    rng = random.Random(21)
    term, other = (lambda: f"t{rng.randrange(60)}"), (lambda: f"o{rng.randrange(500)}")
    items = [(i, " ".join(term() for _ in range(rng.randrange(8, 30))) + ". " + " ".join(term() for _ in range(6))) for i in range(12)]
    rows = []
    for i in range(90):
        w = [other() if rng.random() < 0.7 else term() for _ in range(rng.randrange(0, 90))]
        if i % 3 == 0:
            own = [x for x in split(rng.choice(items)[1]) if rng.random() > rng.choice([0, 0.2, 0.4])]
            cut = rng.randrange(len(w) + 1)
            w[cut:cut] = own
        rows.append((i, " ".join(w)))
    words, own = [split(t) for _, t in rows], [split(t) for _, t in items]
    terms = sorted({x for w in own for x in w})
    df = np.array([sum(t in w for w in map(set, words)) for t in terms])
    idf = np.where((df > 0) & (df <= max(decontaminate.COMMON * len(rows), 1)), np.log((1 + len(rows)) / np.maximum(df, 1)), 0)
    raw = lambda w: np.array([w.count(t) for t in terms]) * idf
    passages = [(d, p, raw(w[p : p + 32])) for d, w in enumerate(words) for p in range(0, len(w), 16)]
    size = [math.sqrt(sum(idf[terms.index(x)] ** 2 for x in words[d][p : p + 32] if x in terms)) for d, p, _ in passages]
    _, s, v = np.linalg.svd(np.array([x / n for (_, _, x), n in zip(passages, size) if n]), full_matrices=False)
    live = s > s[0] * 1e-6
    basis = v[live].T / s[live]
    cosine = lambda a, b: a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)

    def common(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, t[j + 1] = t[j + 1], last + 1 if x == y else max(t[j + 1], t[j])
        return t[-1]

    sure, perhaps = set(), set()
    for d, p, x in passages:
        for i, w in enumerate(own):
            c, m = cosine(x @ basis, raw(w) @ basis), len(w)
            region = words[d][max(0, p - m) : p + 32 + m]
            share = common(w, region) / m if c > decontaminate.COSINE - 0.03 else 0
            answer = {y for y in w[-6:] if idf[terms.index(y)] > 0} or set(w[-6:])
            if share >= decontaminate.LCS or share >= decontaminate.LCS_PARAPHRASE and len(answer & set(region)) >= decontaminate.ANSWER * len(answer):
                perhaps.add((d, i))
                if c > decontaminate.COSINE + 0.03:
                    sure.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, rows).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(sure) >= 10 and sure <= got <= perhaps


# 1, 10: labels ------------------------------------------------------------------------------
def test_labels_that_disagree(spark):
    """A document with different labels isn't in the sample; equal ones, and repeated rows of a text, count once."""
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, None), (None, 1), (5, 7)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, agreed(labels.where("toxic in (0, 1)"), "doc_id", "toxic").collect())) == [(1, 1), (3, 0)]
    good, bad = "a well written line of words here\n" * 6, "zz $$ ## zz\n" * 6
    rows = [(i, good if i % 2 else bad) for i in range(1, 41)]
    quality_of = [(i, i % 2, 0) for i in range(1, 41)]
    fields = []
    for extra_rows, extra_labels in (([], []), ([(1, good)] * 5, [(1, 1, 0)] * 3), ([(99, bad)] * 3, [(99, 1, 0), (99, 0, 0)])):
        fields.append(quality.train(frame(spark, rows + extra_rows).repartition(5), spark.createDataFrame(quality_of + extra_labels, "doc_id bigint, quality int, toxic int").repartition(3)))
    assert np.allclose(fields[0].weight, fields[1].weight) and np.allclose(fields[0].weight, fields[2].weight)


# 7 ------------------------------------------------------------------------------------------
def test_cross_parsing():
    rng = random.Random(9)
    ref = {k: "".join(rng.choices(a, k=400)) for k, a in (("x", "abc "), ("y", "bcd "), ("z", "éf "))}
    model = langid.Model([(k, v) for k, v in ref.items()])
    texts = ["".join(rng.choices("abcdéf ", k=n)) for n in (0, 1, 2, 7, 50, 300, 900)] + ["QQ", "a1b--c"]
    sym, off = langid.symbols(pa.array(texts), model.lut)
    got = langid.phrases(sym, off, model.table, model.roots, width=4)
    for i, t in enumerate(texts):
        clean = " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        for j, k in enumerate(model.langs):
            known = " ".join(re.findall(r"[^\W\d_]+", ref[k].lower())) + " "
            n, at = 0, 0
            while at < len(clean):
                end = at + 1
                while end < len(clean) and clean[at : end + 1] in known:
                    end += 1
                at, n = end, n + 1
            if clean:
                assert got[i, j] == n, (t, k)


def test_texts_without_evidence(spark):
    """One letter, letters that no language has, none at all; texts of the sample stay whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    none = ["\U0001f600", "中", "Ж", "中国", "q", "𠀀𠀁", "", None, "42 !", "Ж! Ж?"]
    lang, bits, margin, rejected = model.judge(pa.array([*none, "the house is on the street", "und das ist nicht das haus"]))
    assert lang[: len(none)] == [None] * len(none) and rejected.tolist() == [True] * len(none) + [False] * 2
    assert lang[-2:] == ["en", "de"]
    got = langid.identify(frame(spark, list(enumerate(none))), model).collect()
    assert all(r.rejected and r.language is None for r in got) and len(got) == len(none)
    # a text that doesn't fit is passed over, whole
    a, b = langid.Model([("x", "abc " * 50), ("x", "dddd")], most=20), langid.Model([("x", "dddd")], most=20)
    assert a.bits == b.bits and len(a.table) > 0
    assert langid.Model([("x", "abc " * 50), ("x", "abc " * 30)], most=20).bits == langid.Model([("x", "abc " * 30)]).bits
    # as many rows as keys, however often a doc_id is there
    again = spark.createDataFrame([(1, f"wort {i} und", "de") for i in range(300)], "doc_id bigint, text string, lang string")
    assert len(sampled(again, "doc_id", [1], "lang", "text")) == 1


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id")
    n = got.count()
    assert got.where("language = lang").count() > 0.995 * n and got.where("rejected").count() < 0.005 * n


# 8 ------------------------------------------------------------------------------------------
def test_suffix_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(frame(spark, [(-1, "Ünï çode Жук 中文 中文"), (-2, None), (-3, "")]).select("doc_id", "text", "lang", "source", "n_chars"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    least, gain = 5, 9.0  # so that a small text has deep nodes
    lut, levels = pst.nodes(docs.repartition(3), least, gain)
    often = collections.Counter(c for t in texts.values() for c in t.lower())
    own = sorted(often, key=lambda c: (-often[c], ord(c)))[: pst.OWN]
    assert [int(lut[ord(c)]) for c in own] == list(range(1, len(own) + 1))
    code = {i: [0] * pst.DEPTH + [int(lut[ord(c)]) for c in t.lower()] for i, t in texts.items()}
    count = collections.defaultdict(collections.Counter)
    for s in code.values():
        for i in range(pst.DEPTH, len(s)):
            for d in range(pst.DEPTH + 1):
                count[tuple(s[i - d : i])][s[i]] += 1
    size = {c: sum(nxt.values()) for c, nxt in count.items()}
    keep = {()}
    for c, nxt in count.items():
        if c and size[c] >= least and sum(v * math.log(v / size[c] / (count[c[1:]][k] / size[c[1:]])) for k, v in nxt.items()) >= max(gain, pst.SHARE * size[()]):
            keep |= {c[j:] for j in range(len(c))}
    assert {d: len(np.unique(v[0] >> kernel.U64(8))) for d, v in levels.items()} == {d: sum(len(c) == d for c in keep) for d in levels}
    assert sum(len(c) == pst.DEPTH for c in keep) > 0

    def p(c, x):
        up = p(c[1:], x) if c else 1 / pst.SYMBOLS
        weight = pst.PRIOR if c else 1
        return (count[c][x] + weight * up) / (size[c] + weight)

    tree = pst.Tree(lut, levels)
    got = {r.doc_id: r for r in pst.score(docs, tree).collect()}
    assert got[-2].bits is None and got[-3].n_symbols == 0
    for i in [*list(texts)[:6], -1]:
        bits = 0.0
        for k in range(pst.DEPTH, len(code[i])):
            c = next(tuple(code[i][k - d : k]) for d in range(pst.DEPTH, -1, -1) if tuple(code[i][k - d : k]) in keep)
            bits -= math.log2(p(c, code[i][k]))
        assert got[i].n_symbols == len(texts[i]) and abs(got[i].bits - bits) < 1e-4 * max(bits, 1)
    # symbols that the corpus doesn't have are left to the root
    n, bits = tree.score(pa.array(["ሀ" * 10, "the"]))
    assert n.tolist() == [10, 3] and np.isfinite(bits).all() and bits[0] > bits[1]


def test_strings_sent_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = pst.nodes(docs)[1]
    monkeypatch.setattr(pst, "HELD", 1000)
    assert all(np.array_equal(x, y) for d, v in pst.nodes(docs)[1].items() for x, y in zip(v, whole[d]))


def test_nodes_whatever_the_size_of_the_corpus(spark, monkeypatch):
    """A context of enough evidence stays a node where the rest of the corpus is large."""
    docs, whole = spark.read.parquet(f"{SF}/documents.parquet"), pst.alphabet
    small = pst.nodes(docs)[1]
    monkeypatch.setattr(pst, "alphabet", lambda docs: (whole(docs)[0], 10**11))
    large = pst.nodes(docs)[1]
    assert len(small[pst.DEPTH][0]) > 0 and all(np.array_equal(x, y) for d, v in large.items() for x, y in zip(v, small[d]))


def test_tables_of_a_tree_are_small():
    """A worker holds 4 bytes a count and some 100 a node, not a hash table of all counts."""
    code = np.arange(1 << 20, dtype=np.uint64)  # contexts of two symbols, and shorter ones, with all symbols
    levels = {d: (code[: 256 ** (d + 1)], np.full(256 ** (d + 1), 3)) for d in range(2)} | {d: (code[:0], code[:0].astype(np.int64)) for d in range(3, pst.DEPTH + 1)}
    levels[2] = code, np.full(len(code), 3)
    tree = pst.Tree(np.zeros(0x110000, np.uint8), levels)
    n, bits = tree.score(pa.array(["ab"]))
    assert n.tolist() == [2] and abs(bits[0] - 16) < 1e-3
    held = [x for v in vars(tree).values() for x in (v, getattr(v, "keys", None), getattr(v, "values", None)) if isinstance(x, np.ndarray) and x is not tree.lut]
    assert sum(x.nbytes for x in held) < 6 * sum(len(x) for x, _ in levels.values())


def _tree_of(seen):
    """(tree whose nodes are all contexts of the symbols, context -> counts of the next one)."""
    count = collections.defaultdict(collections.Counter)
    s = [0] * pst.DEPTH + list(seen)
    for i in range(pst.DEPTH, len(s)):
        for d in range(pst.DEPTH + 1):
            count[tuple(s[i - d : i])][s[i]] += 1
    levels = {}
    for d in range(pst.DEPTH + 1):
        own = sorted((int.from_bytes(bytes([*c, x])), n) for c, nxt in count.items() if len(c) == d for x, n in nxt.items())
        levels[d] = np.array([x for x, _ in own], np.uint64), np.array([n for _, n in own])
    return pst.Tree(np.arange(0x110000).astype(np.uint8), levels), count


def test_contexts_at_the_ends_of_the_alphabet():
    rng = np.random.default_rng(8)
    seen, text = (rng.choice([0, 1, 254, 255], n).tolist() for n in (300, 500))
    tree, count = _tree_of(seen)

    def p(c, x):
        weight, up = (pst.PRIOR, p(c[1:], x)) if c else (1, 1 / pst.SYMBOLS)
        return (count[c][x] + weight * up) / (sum(count[c].values()) + weight)

    s, bits = [0] * pst.DEPTH + text, 0.0
    for i in range(pst.DEPTH, len(s)):
        bits -= math.log2(p(next(c for d in range(pst.DEPTH, -1, -1) if (c := tuple(s[i - d : i])) in count), s[i]))
    n, got = tree.score(pa.array(["".join(map(chr, text))]))
    assert n.tolist() == [500] and abs(got[0] - bits) < 1e-4 * bits


def test_memory_of_scoring_and_counting():
    """A long text isn't scored, nor are counts added up, with many times their size in memory."""
    rng = np.random.default_rng(9)
    tree, _ = _tree_of(rng.integers(97, 123, 2000).tolist())
    n = 1 << 22
    text = pa.array([rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()])
    tree.score(pa.array(["a"]))  # makes the tables

    def peak(run, *args):
        tracemalloc.start()
        try:
            return run(*args), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (size, _), most = peak(tree.score, text)
    assert size.tolist() == [n] and most < 60 * n
    parts = [(np.unique(rng.integers(0, 1 << 40, 1 << 20, np.uint64)), None) for _ in range(3)]
    parts = [(x, rng.integers(1, 9, len(x)).astype(np.uint32)) for x, _ in parts]
    together = [np.concatenate(x) for x in zip(*parts)]
    got, most = peak(pst._added, parts)
    assert most < 24 * len(together[0])  # 12 of them are the result
    assert all(np.array_equal(x, y) for x, y in zip(got, pst._tally(*together)))
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    assert len(pst._added([none])[0]) == len(pst._added([none, none])[1]) == 0


def test_suffix_tree_held_out(spark):
    """Bits of texts not counted: deeper trees are better."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("doc_id % 2 = 1").toPandas().text
    lut, levels = pst.nodes(docs.where("doc_id % 2 = 0"))
    total = []
    for depth in (1, 3, pst.DEPTH):
        n, bits = pst.Tree(lut, {d: v if d <= depth else (v[0][:0], v[1][:0]) for d, v in levels.items()}).score(pa.array(held))
        total.append(bits.sum() / n.sum())
    assert total[0] > 1.2 * total[1] and total[1] > 1.02 * total[2]


# 9 ------------------------------------------------------------------------------------------
def test_minimizers_of_a_text_longer_than_a_place(monkeypatch):
    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    h[200:300] = h[20:120]
    monkeypatch.setattr(suffix_dedup, "_AT", kernel.U64(63))  # as 2**24 - 1 is to a text of more words
    row, start, windows, anchor = suffix_dedup.segments(h, np.array([0, 300]), 12, 4)
    g = kernel.grams(h, np.array([0, 300]), 4)[0]
    best = [min(range(i, i + 9), key=lambda j: (int(g[j]) >> 6, j)) for i in range(289)]
    assert windows.sum() == 289 and np.repeat(anchor, windows).tolist() == g[best].tolist()
    each = np.repeat(anchor, windows)
    assert each[20:109].tolist() == each[200:289].tolist()


def test_bounded_lcp():
    rng = np.random.default_rng(3)
    for n, sigma in ((30, 2), (300, 3), (500, 50)):
        text = np.concatenate([rng.integers(1, sigma + 1, n), [0]])
        text = np.concatenate([text[:-1] + 1, text[: n // 2] + 1, [0]])
        sa, lcp = suffix_dedup.bounded_lcp(text, 6)
        order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert sa.tolist() == order
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            m = min(len(a), len(b))
            same = int(np.argmin(np.append(a[:m] == b[:m], False)))
            assert lcp[k] == (same if same < 6 else -1)


def test_filter_of_minimizers(spark):
    rows = spark.range(200, numPartitions=3).selectExpr("concat('common passage of just as many words as it takes ', id % 20, ' ', repeat(concat('w', id, ' '), 20)) as text", "id as doc_id")
    anchors = suffix_dedup._anchors(rows, 9, 3, 5)
    own = np.concatenate([np.frombuffer(r[1], np.uint64) for r in anchors.collect()])
    known = suffix_dedup._filter(anchors)
    assert len(own) and suffix_dedup._passes(own, known).all()
    others = np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64)
    assert suffix_dedup._passes(others, known).mean() < 0.12


@pytest.mark.parametrize("bits", [29, 4])
def test_repeats(spark, bits, monkeypatch):
    """With a filter that lets few or nearly all single segments through."""
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", bits)
    rng = random.Random(10)
    passages = [[f"p{rng.randrange(500)}" for _ in range(rng.choice([12, 20, 35]))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = [f"u{rng.randrange(10**6)}" for _ in range(30)]
        for p in rng.sample(passages, 2):
            k = rng.randrange(len(w))
            w[k:k] = p
        rows.append((i, " ".join(w + (["sp", "am"] * 20 if i % 9 == 0 else []))))
    least, seen, want = 15, collections.defaultdict(list), set()
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].append((i, k))
    for at in seen.values():
        if len(at) > 1:
            want |= {(i, x, n > 0) for n, (i, k) in enumerate(sorted(at)) for x in range(k, k + least)}
    got = suffix_dedup.repeated_spans(frame(spark, rows), least, 5).collect()
    assert {(r.doc_id, x, r["drop"]) for r in got for x in range(r.start_word, r.end_word)} == want


def test_drop_repeats_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text, "x", "a"), (2, text + " end", "y", "b"), (None, text, None, None)], "doc_id bigint, text string, n_chars string, SPANS string")
    got = {r.doc_id: tuple(r) for r in suffix_dedup.drop_repeats(docs).collect()}
    assert got == {1: (1, text, "x", "a"), 2: (2, "end", "y", "b"), None: (None, text, None, None)}


# 10 -----------------------------------------------------------------------------------------
def test_marginals():
    rng = np.random.default_rng(4)
    score, pair, first = rng.standard_normal(9), rng.standard_normal((2, 2)), np.array([0, 4, 4, 5, 9])
    p, pairs, norm = quality.marginals(score, pair, first)
    total = np.zeros((2, 2))
    for r in range(4):
        own = score[first[r] : first[r + 1]]
        ways = [(y, math.exp(sum(s for s, v in zip(own, y) if v) + sum(pair[a, b] for a, b in zip(y, y[1:])))) for y in np.ndindex(*[2] * len(own))]
        z = sum(w for _, w in ways)
        assert abs(math.log(z) - norm[r]) < 1e-9
        for t in range(len(own)):
            assert abs(sum(w for y, w in ways if y[t]) / z - p[first[r] + t]) < 1e-9
        for y, w in ways:
            for a, b in zip(y, y[1:]):
                total[a, b] += w / z
    assert np.allclose(total, pairs)


def test_quality_by_plain_loops():
    """Features of every line, all labellings, and the length-weighted sum, from the texts."""
    rng = random.Random(17)
    line = lambda: rng.choice(["", "  ", "Good words, said well.", "zz $$ ## | 12", "é Ünï x", "a a a a", "ABC def!", "|||", " ".join(rng.choices("pqrs", k=5))])
    texts = [None, "", "\n \n", "one", "last line\n", *("\n".join(line() for _ in range(rng.randrange(1, 8))) for _ in range(30))]
    field = quality.Field(texts, [i % 2 for i in range(len(texts))])
    n, got = field.judge(pa.array(texts, pa.large_string()))
    count = lambda b, s: sum(x in s for x in b)
    letters = {*range(65, 91), *range(97, 123), *range(128, 256)}
    for i, t in enumerate(texts):
        cut = (t or "").encode().split(b"\n")
        raw = [c + b"\n" for c in cut[:-1]] + [cut[-1]]
        raw = [r for r in raw if any(x > 32 for x in r)]
        bare = [r.removesuffix(b"\n") for r in raw]
        own = []
        for j, b in enumerate(bare):
            solid, w, letter = sum(x > 32 for x in b), split(b.decode()), count(b, letters)
            own.append([
                math.log1p(solid) / 5, math.log1p(len(w)) / 3, letter / solid, count(b, range(65, 91)) / max(letter, 1), count(b, b"0123456789") / solid, count(b, b".,;:?'\"-()") / solid,
                count(b, b"#$%&*!+=<>@^_~/\\[]{}") / solid * 4, b.count(b"|") / solid * 10, min(letter / max(len(w), 1), 20) / 10, len(set(w)) / max(len(w), 1), b[-1] in b".?!\"'",
                j > 0 and bare[j - 1] == b, min(bare.count(b) - 1, 5) / 5,
            ])
        assert n[i] == len(own)
        if not own:
            assert np.isnan(got[i])
            continue
        blank = [0] * len(own[0])
        x = np.array([[1, *own[j], *(own[j - 1] if j else blank), *(own[j + 1] if j + 1 < len(own) else blank), j == 0, j + 1 == len(own)] for j in range(len(own))], float)
        score, pair = ((x - field.mean) / field.dev) @ field.weight[:-4], field.weight[-4:].reshape(2, 2)
        ways = [(y, math.exp(score @ np.array(y) + sum(pair[a, b] for a, b in zip(y, y[1:])))) for y in np.ndindex(*[2] * len(own))]
        z, size = sum(v for _, v in ways), np.array([len(r) for r in raw])
        assert abs(sum(v * (size @ np.array(y)) for y, v in ways) / z / size.sum() - got[i]) < 1e-6, texts[i]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score(docs, field=field).join(labels.where("doc_id % 2 = 1").select("doc_id", labels.quality.alias("y")), "doc_id").toPandas()
    assert (got.good == (got.y == 1)).mean() > 0.98 and got.good[got.y == 1].mean() > 0.98


# pipeline -----------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = langid.keep_identified(docs).collect()
    sets = {}
    for r in kept:
        w = split(r.text)
        sets[r.doc_id] = frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset([r.doc_id])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) * 1000 >= len(sets[i] | sets[j]) * 450:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [r for r in kept if find(r.doc_id) == r.doc_id]
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        w = list(WORD.finditer(r.text.lower()))
        gone = set()
        for k in range(len(w) - 49):
            key = tuple(m.group() for m in w[k : k + 50])
            if key in seen:
                gone |= set(range(k, k + 50))
            seen.add(key)
        text, at = "", 0
        for k in sorted(gone):
            if k - 1 not in gone:
                text += r.text[at : w[k].start()]
            at = w[k].end()
        text = (text + r.text[at:]).strip() if gone else r.text
        if not gone or len(gone) < len(w):
            out.append((r.doc_id, text, r.source))
    bench = [" " + " ".join(split(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = [x for x in out if not any(b in " " + " ".join(split(x[1])) + " " for b in bench)]
    want = mixing.schedule(spark.createDataFrame(out, "doc_id bigint, text string, source string"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, want.collect()))

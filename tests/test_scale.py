"""Steps that were changed for large tables, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext import queries as base
from loomtext.operators import dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cell", [None, 150])
def test_similar_pairs_by_cells(spark, cell):
    """All pairs of a block, whether it is one cell or has parts."""
    from loomtext.operators import cells

    rng = random.Random(5)
    rows = [(i, "xy"[i % 2], rng.sample(range(12), rng.randrange(4, 9))) for i in range(90)] + [(90 + i, "x", []) for i in range(3)] + [(99, "z", [1])]
    df = spark.createDataFrame(rows, "seq bigint, block string, codes array<bigint>")
    want = {}
    for i, b, x in rows:
        for j, c, y in rows:
            if i < j and b == c and (not x and not y or len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))):
                want[i, j] = len(set(x) & set(y)) / len(set(x) | set(y)) if x else 1.0
    got = cells.similar_pairs(df, 0.6, cell).collect()
    assert len(got) == len(want) and {(r.lo, r.hi): r.similarity for r in got} == want
    assert {r.seq for r in cells.with_earlier(df, 0.6, cell).collect()} == {j for _, j in want}


def test_conflicts_carry_no_word_sets_through_joins(spark):
    """Word sets are sent to their block's cell, never along a join of pairs."""
    plan = base.chunk_conflicts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "words_a" not in plan


def test_chain_of_similar_sentences(spark):
    """b is like a and c like b, but not like a: the query's SQL drops b and c, the greedy operator only b."""
    w = [f"wo{chr(97 + i)}" for i in range(20)]
    a, b, c = ("Start " + " ".join(w[:-2] + tail) + " end." for tail in ([w[18], w[19]], ["zzz", w[19]], ["zzz", "yyy"]))
    rows = [(k, f"{s} Own number {k} of many different things here{k}.") for k, s in enumerate((a, b, c))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    starts = lambda kept: [r.text.startswith("Start") for r in dedup.greedy_sentences(df, threshold=0.85, kept=kept).orderBy("doc_id").collect()]
    assert starts(True) == [True, False, True]
    assert starts(False) == [True, False, False]


def test_shingle_hashes(spark):
    """The numpy forms give what the expressions gave."""
    from loomtext.functions import hashing as H
    from loomtext.functions import text as T

    texts = [None, "", "a b", "a b c", "One two THREE four five", "x\x1cy z w v \x85 u", "naïve ÉCLAIR straße 東京 タワー is tall"] + [" ".join(random.Random(k).choices("pqrstuvw", k=50 * k)) for k in range(6)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for new, old in ((H.shingle_simhash("t"), H.simhash(T.shingles("t"))), (H.shingle_minhash("t", 5), H.minhash(T.shingles("t"), 5))):
        got = [tuple(r) for r in df.select(new, old).collect()]
        assert len(got) == len(texts) and all(a == b for a, b in got)


def test_byte_hashes(spark):
    """Many texts at a time, of all lengths."""
    from loomtext.functions import grams as G

    texts = [b"", b"a", "é".encode()] + [bytes(random.Random(k).choices(range(256), k=k * k)) for k in range(60)]
    for t, h in zip(texts, G.fnv1a(texts).tolist()):
        x = 0xCBF29CE484222325
        for b in t:
            x = (x ^ b) * 0x100000001B3 % (1 << 64)
        assert h == x
    base.docs(spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8388608b"


def test_split_for_chunks(spark):
    """One pass in a worker, not a fold over arrays."""
    from loomtext.functions import text as T

    assert T.split_for_chunks("Dr. Who came. He left!? And so on", 3) == ["Dr. Who came.", "He left!?", "And so on"]
    assert T.split_for_chunks("It is etc. \x85", 3) == ["It is etc."] and T.split_for_chunks("no", 5) == [] and T.split_for_chunks("", 0, 1) == []
    assert T.split_for_chunks("short. one.", 50) == ["short. one."]
    df = spark.createDataFrame([(None,), ("a. b",)], "t string")
    assert [r[0] for r in df.select(T.chunk_sentences("t", 1)).collect()] == [None, ["a.", "b"]]
    assert "aggregate(" not in df.select(T.chunk_sentences("t"))._jdf.queryExecution().analyzed().toString()


def test_islands_of_a_document(spark):
    """The numbers of the window, without a shuffle."""
    from loomtext.functions import text as T
    from loomtext.operators import chunking as K

    rows = base.docs(spark, SF).limit(60).unionByName(spark.createDataFrame([(-1, "", "en", "s", 0), (-2, "Été là. Été là bas. Rien d'autre.", "fr", "s", 0)], base.docs(spark, SF).schema))
    want = K.islands(rows.select("doc_id", F.posexplode(T.sentences("text")).alias("idx", "sentence"))).select("doc_id", "idx", "island").collect()
    mine = rows.select("doc_id", F.explode(K.document_islands(T.sentences("text"))).alias("i")).select("doc_id", F.explode(F.sequence("i.first", "i.last")).alias("idx"), "i.island")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want))
    assert "Exchange" not in base.related_islands(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_strip_is_no_pattern(spark):
    """Trimmed by characters, of which there are as many as the pattern had."""
    from loomtext.functions import grams as G
    from loomtext.functions import text as T

    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"{c}a{c}b{c}{c}") for c in every], "c string, t string")
    got = df.select("c", T.strip("t").alias("new"), F.regexp_replace("t", "(?U)^\\s+|\\s+\\z", "").alias("old")).collect()
    assert all(r.new == r.old for r in got) and {r.c for r in got if r.new != f"{r.c}a{r.c}b{r.c}{r.c}"} == set(G.SPACE)
    assert "regexp" not in df.select(T.strip("t"))._jdf.queryExecution().analyzed().toString()


def _grams(texts):
    out = {}
    for t in texts:
        for i in range(len(t or "") - 2):
            out[t[i : i + 3]] = out.get(t[i : i + 3], 0) + 1
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_trigrams(spark, repeated):
    """Counted where they are read; texts of one key together."""
    from loomtext.operators import trigrams

    docs = [(0, "abcabcabc"), (1, ""), (2, None), (3, "ab"), (4, "naïve 東京タワー 😀😀😀😀 text"), (5, "text text text"), (None, "text"), (7, "the text " * 400)]
    docs += [(5, "more text"), (1, "abc"), (None, "abc")] if repeated else []
    items = [(0, "text abc"), (1, "xyz"), (2, ""), (3, None), (4, "東京タワー 😀😀😀"), (0, "more")]
    df, it = spark.createDataFrame(docs, "d bigint, text string").repartition(2), spark.createDataFrame(items, "i bigint, text string")
    want = {k: _grams(t for x, t in docs if x == k) for k, _ in docs}
    got = trigrams.counts(df, "d", "text").collect()
    assert sorted((str(r.d), r.gram, r.n) for r in got) == sorted((str(k), g, n) for k, m in want.items() for g, n in m.items())
    assert repeated or "Exchange" not in trigrams.counts(df.coalesce(1), "d", "text")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    own = {k: _grams(t for x, t in items if x == k) for k, _ in items}
    for measure in ("jaccard", "cosine"):
        got = trigrams.pairs(it, "i", df, "d", measure).collect()
        assert len(got) == len(items) * len(docs)
        for r in got:
            x, y = own[r.a], want[r.b] if r.b is not None else {}
            if measure == "jaccard":
                assert r.jaccard == (len(x.keys() & y.keys()) / len(x.keys() | y.keys()) if x or y else 0)
            else:
                norm = np.sqrt(float(sum(n * n for n in x.values()))) * np.sqrt(float(sum(n * n for n in y.values())))
                assert r.cosine == (sum(n * y.get(g, 0) for g, n in x.items()) / norm if norm else 0)


def test_shared_grams_are_four_bytes(spark):
    """The bucket is named once a record, not in each gram (F1, F2)."""
    from loomtext.llm import ngram_join as N

    docs = spark.createDataFrame([(i, "one two three four five six seven" + " x" * (i % 3)) for i in range(9)], "doc_id bigint, text string")
    for r in N._shared(N._routed(docs, 3, 4), 4).collect():
        assert len(r.gram) == 2 * len(r.df) and len(r["count"]) * 8 == len(r.fp)
        assert len(r.gram) // 4 == sum(r["count"])


def test_vector_pairs(spark, monkeypatch):
    """In parts and in one, against plain loops."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    v[7] = 0
    rows = [(i, v[i].tolist(), i % 2) for i in range(60)] + [(60, [1.0], 0), (61, None, 0), (62, [1.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "i bigint, v array<float>, k int")
    w = v.astype(float)
    want = {(i, j): s for i in range(60) for j in range(i + 2, 60, 2) if 7 not in (i, j) and (s := w[i] @ w[j] / np.linalg.norm(w[i]) / np.linalg.norm(w[j])) >= 0.3}
    for n in (4096, 7):
        monkeypatch.setattr(dedup, "VECTORS", n)
        got = dedup.vector_pairs(df, "i", "v", 0.3, "k").collect()
        assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.similarity) < 1e-9 for r in got)


def test_regressions_by_stretches(spark, monkeypatch):
    """Stretches see the rows before them; nulls count for nothing."""
    from loomtext.operators import stats

    rng = random.Random(2)
    rows = [("ab"[i % 7 == 0], i, None if i % 11 == 3 else rng.choice([1.0, 2.0, 9.0])) for i in range(700)]
    monkeypatch.setattr(stats, "STRETCH", 1)
    got = {r.t: r for r in stats.regressions(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v", window=20).collect()}
    assert len(got) == 700
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for i, (_, t, v) in enumerate(own):
            x = [r[2] for r in own[max(0, i - 19) : i + 1] if r[2] is not None]
            assert got[t].samples == len(x)
            if len(x) >= 10 and v is not None:
                assert abs(got[t].z - (v - np.mean(x)) / max(np.std(x, ddof=1), 0.001)) < 1e-9 and got[t].regression == (got[t].z > 2)
            else:
                assert got[t].z is None and not got[t].regression


@pytest.mark.parametrize("parts", [1, 3])
def test_overlapping(spark, parts):
    """A set is sent to cells, not along with each pair."""
    from loomtext.operators import cells

    rng = random.Random(4)
    sets = {i: sorted(rng.sample(range(20), rng.randrange(3, 12))) for i in range(40)}
    pairs = [(i, j) for i in sets for j in sets if i < j and rng.random() < 0.5]
    got = cells.overlapping(spark.createDataFrame(pairs, "a bigint, b bigint"), spark.createDataFrame(list(sets.items()), "id bigint, codes array<bigint>"), 0.4, parts).collect()
    want = {(i, j): s for i, j in pairs if (s := len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})) >= 0.4}
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want

"""Every query with SQL gives the rows that the SQL gives."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from loomtext import queries as base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    show = lambda x: repr(round(float(x), 9)) if isinstance(x, (float, np.floating)) else str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, con, name):
    mine = base.QUERIES[name](spark, SF).toPandas()
    assert len(mine) or name in ("semantic_pairs", "collisions", "greedy_chunk_dedup", "expired_users")
    if name in base.ORACLES:
        theirs = con.execute(base.ORACLES[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_documents_and_pairs(spark):
    ids = {r[0] for r in base.docs(spark, SF).select("doc_id").collect()}
    items = {r[0] for r in base.table(spark, SF, "benchmark").select("item_id").collect()}
    for name in ("minhash_signatures", "embed_chunks", "sentence_keys", "simhash"):
        assert {r.doc_id for r in base.QUERIES[name](spark, SF).select("doc_id").collect()} == ids, name
    assert {r[0] for r in base.QUERIES["trigram_greedy_dedup"](spark, SF).select("doc_id").collect()} <= ids
    assert base.QUERIES["batch_union"](spark, SF).count() == len(ids) + len(items)
    for name in ("hamming", "trigram_jaccard", "trigram_cosine"):
        assert base.QUERIES[name](spark, SF).select("a", "b").distinct().count() == len(ids) * len(items), name


def test_edit_distance(spark, tmp_path):
    """Against the textbook table, on every pair of a small fixture."""
    texts = ["", "kitten", "sitting", "naïve café", "a" * 40, "saturday night", "sunday"]
    both = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    both.write.parquet(f"{tmp_path}/documents.parquet")
    both.where("doc_id < 5").toDF("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.a, r.b): (r.distance, r.similarity) for r in base.QUERIES["edit_distance"](spark, str(tmp_path)).collect()}
    assert len(got) == 5 * len(texts)
    for (a, b), (distance, similarity) in got.items():
        x, y = texts[a], texts[b]
        row = list(range(len(y) + 1))
        for i, p in enumerate(x):
            new = [i + 1]
            for j, q in enumerate(y):
                new.append(min(row[j] + (p != q), row[j + 1] + 1, new[j] + 1))
            row = new
        assert distance == row[-1]
        assert abs(similarity - (max(0, 1 - row[-1] / max(len(x), len(y))) if x or y else 0)) < 1e-6

"""Document fingerprints as invertible Bloom lookup sketches (operator 5).

A document is the set of the 60-bit digests of its paragraphs (non-blank lines, trimmed).
Its sketch has cells of a count, an exclusive-or of digests and one of their checks; each
digest is in ``HASHES`` of them, one in each part of the cells. The sketches of two
versions subtract cell by cell, what they have in common cancels, and peeling cells with a
single digest recovers those that differ. A sketch too small for the difference leaves
cells that can't be peeled; such a pair is tried again with twice the cells.

The earlier version of a document is, of all earlier documents that hold at least half of
its paragraphs, the one that holds most of them (ties: the later document). The last earlier
holder of each paragraph votes, and an earlier document with all the same shared paragraphs
is looked up; what either reaches is a lower bound, so only earlier holders of a document's
rarest paragraphs can do better, and those are compared in full.

Defined results: a null or blank text has no paragraphs, fingerprint 0 and no version; a
paragraph repeated in a document counts once; rows with a null doc_id are left out; rows
that repeat a doc_id are one document of all their paragraphs; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, trimmed
from .kernel import U64, mix

CELLS, HASHES = 24, 3
_SALT = [U64(x) for x in (0x9AE16A3B2F90404F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def places(digests: np.ndarray, cells: int, level: int) -> np.ndarray:
    """Cells of each digest, HASHES x digests; other ones at each level."""
    part = cells // HASHES
    d = digests.astype(np.uint64)
    return np.stack([(mix(d ^ (s + U64(level))) % U64(part)).astype(np.int64) + i * part for i, s in enumerate(_SALT)])


def check(digests: np.ndarray) -> np.ndarray:
    return mix(digests.astype(np.uint64) + U64(0x5851F42D4C957F2D))


def sketches(digests: np.ndarray, row: np.ndarray, rows: int, cells: int, level: int) -> np.ndarray:
    """Count, digests and checks of each cell: rows x cells x 3 of 64 bits."""
    out = np.zeros((rows, cells, 3), np.uint64)
    for at in places(digests, cells, level):
        np.add.at(out[:, :, 0], (row, at), U64(1))
        np.bitwise_xor.at(out[:, :, 1], (row, at), digests.astype(np.uint64))
        np.bitwise_xor.at(out[:, :, 2], (row, at), check(digests))
    return out


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a ^ b
    out[:, :, 0] = a[:, :, 0] - b[:, :, 0]
    return out


def peel(diff: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign, whole): what is only on the left (1) or right (-1) side; whole says that nothing is left over."""
    diff = diff.copy()
    cells = diff.shape[1]
    rows, digests, signs = [], [], []
    while True:
        count = diff[:, :, 0].view(np.int64) if diff.flags.c_contiguous else diff[:, :, 0].astype(np.int64)
        one = (np.abs(count) == 1) & (check(diff[:, :, 1].ravel()).reshape(count.shape) == diff[:, :, 2])
        r, c = np.nonzero(one)
        if not len(r):
            break
        found = np.unique(np.stack([r.astype(np.uint64), diff[r, c, 1], count[r, c].view(np.uint64)]), axis=1)
        r, d, s = found[0].astype(np.int64), found[1], found[2]
        for at in places(d, cells, level):
            np.subtract.at(diff[:, :, 0], (r, at), s)
            np.bitwise_xor.at(diff[:, :, 1], (r, at), d)
            np.bitwise_xor.at(diff[:, :, 2], (r, at), check(d))
        rows.append(r)
        digests.append(d)
        signs.append(s.view(np.int64))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(rows, np.int64), cat(digests, np.uint64), cat(signs, np.int64), ~diff.reshape(len(diff), -1).any(1)


def _lists(row: np.ndarray, digest: np.ndarray, n: int) -> pa.Array:
    order = np.lexsort((digest, row))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(digest[order].astype(np.int64)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().astype(np.uint64), np.repeat(np.arange(len(n)), n)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted distinct digests of its paragraphs."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    digest = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")
    own = F.array_distinct(F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), digest))
    rows = docs.where("doc_id is not null").select("doc_id", own.alias("digests"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("digests")))).alias("digests"))


def sketched(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id and its sketch, cells x 3 words of 64 bits."""

    def run(batches):
        for batch in batches:
            d, row = _flat(batch.column("digests"))
            s = sketches(d, row, batch.num_rows, cells, 0)
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.tobytes() for x in s], pa.binary())], names=["doc_id", "sketch"])

    return rows.select("doc_id", "digests").mapInArrow(trimmed(run), "doc_id bigint, sketch binary")


def links(rows: DataFrame) -> DataFrame:
    """doc_id and prev_id, its earlier version.

    ``kind`` stands for the paragraphs that a document shares with any other, so all of a
    kind have the same overlaps and its last one stands for it. ``least`` is an overlap that
    is known to be reached or is asked for; of the ``held`` paragraphs that earlier documents
    have too, a better version shares one of the ``held - least + 1`` rarest.
    """
    by, own = Window.partitionBy("digest"), Window.partitionBy("doc_id")
    each = rows.select("doc_id", F.size("digests").alias("n"), F.explode("digests").alias("digest")).withColumns({"last_id": F.lag("doc_id").over(by.orderBy("doc_id")), "holders": F.count(F.lit(1)).over(by)})
    shared = durable(each.where("holders > 1").withColumns({"kind": F.bit_xor(F.xxhash64("digest")).over(own), "size": F.count(F.lit(1)).over(own)}))
    held = shared.where("last_id is not null")
    best = held.groupBy("doc_id", "n", "last_id").agg(F.count(F.lit(1)).alias("votes")).groupBy("doc_id", "n").agg(F.max(F.struct("votes", "last_id")).alias("best"), F.sum("votes").alias("held")).where("held * 2 >= n")
    copy = shared.select("doc_id", "kind").distinct().select("doc_id", F.lag("doc_id").over(Window.partitionBy("kind").orderBy("doc_id")).alias("copy_id")).where("copy_id is not null")
    # Where one document is the last holder of all, or one paragraph is enough, no later one does as well
    all_held = F.col("best.votes") == F.col("held")
    enough = F.greatest(F.col("best.votes"), F.ceil(F.col("n") / 2))
    found = F.when(all_held | F.col("copy_id").isNull(), F.when(F.col("best.votes") == enough, F.col("best.last_id"))).otherwise(F.col("copy_id"))
    goal = best.join(copy, "doc_id", "left").withColumns({"found": found, "least": F.when(F.col("copy_id").isNotNull(), F.col("held")).otherwise(enough)})
    probes = F.when(all_held, 0).when(F.col("least") == 1, F.col("held") - 1).otherwise(F.col("held") - F.col("least") + 1)
    goal = durable(goal.select("doc_id", "found", "least", "held", probes.alias("probes")))
    rank = F.row_number().over(own.orderBy("holders", "digest"))
    probe = held.select("doc_id", "digest", "holders").join(goal.where("probes > 0"), "doc_id").withColumn("rank", rank).where("rank <= probes").select("doc_id", "digest", "found", "least", "held")
    holder = shared.select("digest", F.col("doc_id").alias("prev_id"), "size", "kind")
    near = probe.join(holder, "digest").where("prev_id < doc_id and size >= least and (least < held or found is null or prev_id > found)")
    near = durable(near.groupBy("doc_id", "least", "kind").agg(F.max("prev_id").alias("prev_id")).select("doc_id", "least", "prev_id"))
    texts = shared.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))
    both = near.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("prev_id"), F.col("digests").alias("yours")), "prev_id")
    both = both.select("doc_id", "prev_id", "least", F.size(F.array_intersect("digests", "yours")).cast("bigint").alias("overlap")).where("overlap >= least")
    known = goal.where("found is not null").select("doc_id", F.col("found").alias("prev_id"), F.col("least").alias("overlap"))
    return both.select("doc_id", "prev_id", "overlap").unionByName(known).groupBy("doc_id").agg(F.max(F.struct("overlap", "prev_id")).alias("best")).select("doc_id", "best.prev_id")


_DIFF = "doc_id bigint, prev_id bigint, added array<bigint>, removed array<bigint>, whole boolean"


def _diffs(batch: pa.RecordBatch, diff: np.ndarray, level: int) -> tuple[pa.RecordBatch, np.ndarray]:
    row, digest, sign, whole = peel(diff, level)
    n = len(diff)
    sides = [_lists(row[sign == s], digest[sign == s], n) for s in (1, -1)]
    return pa.record_batch([batch.column("doc_id"), batch.column("prev_id"), *sides, pa.array(whole)], names=["doc_id", "prev_id", "added", "removed", "whole"]), whole


def differences(rows: DataFrame, pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, prev_id and the digests added and removed since, for each pair."""
    sketch = sketched(rows, cells)
    both = pairs.join(sketch.withColumnRenamed("sketch", "mine"), "doc_id").join(sketch.select(F.col("doc_id").alias("prev_id"), F.col("sketch").alias("yours")), "prev_id")

    def first(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, cells, 3) for c in ("mine", "yours"))
            yield _diffs(batch, subtract(a, b), 0)[0]

    def again(batches):
        for batch in batches:
            level, size = 0, cells
            while batch.num_rows:
                level, size = level + 1, size * 2
                a, b = (sketches(*_flat(batch.column(c)), batch.num_rows, size, level) for c in ("mine", "yours"))
                done, whole = _diffs(batch, subtract(a, b), level)
                yield done.filter(pa.array(whole))
                batch = batch.filter(pa.array(~whole))

    tried = durable(both.select("doc_id", "prev_id", "mine", "yours").mapInArrow(first, _DIFF))
    failed = tried.where("not whole").select("doc_id", "prev_id")
    full = failed.join(rows.select("doc_id", F.col("digests").alias("mine")), "doc_id").join(rows.select(F.col("doc_id").alias("prev_id"), F.col("digests").alias("yours")), "prev_id")
    return tried.where("whole").unionByName(full.select("doc_id", "prev_id", "mine", "yours").mapInArrow(again, _DIFF)).drop("whole")


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_paragraphs, fingerprint (exclusive-or of the digests), prev_id, n_added, n_removed, added, removed.

    Without an earlier version prev_id is -1 and the last four are 0 and empty; the lists are ascending and joined by commas.
    """
    rows = durable(paragraphs(docs))
    diff = differences(rows, durable(links(rows)), cells)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    diff = diff.select("doc_id", "prev_id", F.size("added").cast("bigint").alias("n_added"), F.size("removed").cast("bigint").alias("n_removed"), text("added"), text("removed"))
    mine = rows.select("doc_id", F.size("digests").cast("bigint").alias("n_paragraphs"), F.aggregate("digests", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)).alias("fingerprint"))
    return mine.join(diff, "doc_id", "left").fillna({"prev_id": -1, "n_added": 0, "n_removed": 0, "added": "", "removed": ""})


ORACLE = """
WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS p FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(p), 1, 15))::BIGINT AS digest FROM p),
n AS (SELECT d.doc_id, count(digest) AS n_paragraphs, coalesce(bit_xor(digest), 0)::BIGINT AS fingerprint FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY 1),
v AS (SELECT a.doc_id, b.doc_id AS prev_id, count(*) AS votes FROM g a JOIN g b ON a.digest = b.digest AND b.doc_id < a.doc_id GROUP BY 1, 2),
b AS (SELECT v.doc_id, prev_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, prev_id DESC) AS k FROM v) v JOIN n ON v.doc_id = n.doc_id WHERE k = 1 AND votes * 2 >= n_paragraphs),
a AS (SELECT b.doc_id, count(*) AS c, string_agg(g.digest::VARCHAR, ',' ORDER BY g.digest) AS t FROM b JOIN g ON g.doc_id = b.doc_id WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.doc_id = b.prev_id AND h.digest = g.digest) GROUP BY 1),
r AS (SELECT b.doc_id, count(*) AS c, string_agg(g.digest::VARCHAR, ',' ORDER BY g.digest) AS t FROM b JOIN g ON g.doc_id = b.prev_id WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.doc_id = b.doc_id AND h.digest = g.digest) GROUP BY 1)
SELECT n.doc_id, n_paragraphs, fingerprint, coalesce(prev_id, -1) AS prev_id, coalesce(a.c, 0) AS n_added, coalesce(r.c, 0) AS n_removed, coalesce(a.t, '') AS added, coalesce(r.t, '') AS removed
FROM n LEFT JOIN b ON n.doc_id = b.doc_id LEFT JOIN a ON n.doc_id = a.doc_id LEFT JOIN r ON n.doc_id = r.doc_id
"""

"""Similar sets within blocks: each block is compared where its rows meet, in cells of bounded load.

A block of more than ``CELL`` codes is cut into parts, and each two parts make a cell, so a
row is sent as often as its block has parts and no task holds more than two of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a part of a block: 8 MB. A row counts as LEAST codes at least.
CELL, LEAST = 1 << 20, 64


def placed(rows: DataFrame, cell: int | None = None) -> DataFrame:
    """seq, codes, block, part, and x <= y: the cell, one row for each cell that the row belongs to."""
    sizes = rows.groupBy("block").agg(F.ceil(F.sum(F.greatest(F.size("codes"), F.lit(LEAST))) / (cell or CELL)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    some = rows.where("seq is not null").join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int"))
    each = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("seq", "codes", "block", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))


class Sets:
    """The distinct sets among some rows, as ranks of their codes, rarest first."""

    def __init__(self, codes: pa.ListArray):
        flat, at = codes.values.to_numpy(), codes.offsets.to_numpy()
        known, code, count = np.unique(flat[at[0] : at[-1]], return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(known))
        at = at - at[0]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key = np.sort(row << 32 | rank[code])
        self.sets, self.vocabulary = np.split(key & 0xFFFFFFFF, at[1:-1]) if len(at) > 1 else [], len(known)

    def matches(self, of: np.ndarray, threshold: float, seq: np.ndarray | None = None):
        """(row, rows, overlaps) of rows ``of``, each with the similar ones among those before it in ``of``.

        Similar sets share one of the rarest ``n - ceil(t * n) + 1`` codes of either. With ``seq`` only rows of a smaller one count, and some of them are enough.
        """
        lists: dict[int, list[int]] = {}
        size = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        prefix = np.where(size > 0, size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1, 0)

        mark = np.zeros(self.vocabulary, bool)
        for r in of.tolist():
            mine = self.sets[r]
            keys = mine[: prefix[r]].tolist() or [-1]  # empty sets are similar to each other
            found = [x for c in keys if (x := lists.get(c))]
            if found:
                near = np.unique(np.concatenate([np.array(x, np.int64) for x in found])) if len(found) > 1 else np.array(found[0], np.int64)
                if seq is not None:
                    near = near[seq[near] < seq[r]]
                near = near[np.minimum(size[near], size[r]) >= np.maximum(size[near], size[r]) * threshold - 1e-9]
                mark[mine] = True
                step = 4096 if seq is None else 64
                hits, overlap = [], []
                for i in range(0, len(near), step):
                    some = near[i : i + step]
                    sums = np.concatenate([[0], np.cumsum(mark[np.concatenate([self.sets[x] for x in some])])])
                    ends = np.cumsum(size[some])
                    o = sums[ends] - sums[ends - size[some]]
                    union = size[some] + size[r] - o
                    on = (union == 0) | (o / np.maximum(union, 1) >= threshold)
                    hits.append(some[on])
                    overlap.append(o[on])
                    if seq is not None and on.any():
                        break
                mark[mine] = False
                if hits and sum(map(len, hits)):
                    yield r, np.concatenate(hits), np.concatenate(overlap)
            for c in keys:
                lists.setdefault(c, []).append(r)


def _cell(table: pa.Table):
    """Rows of each cell of a table: (seq, codes, own, whether its two parts are one)."""
    table = table.sort_by([("block", "ascending"), ("x", "ascending"), ("y", "ascending"), ("seq", "ascending")]).combine_chunks()
    block = table.column("block").combine_chunks().dictionary_encode()
    block = block.indices.to_numpy() if not isinstance(block, pa.ChunkedArray) else block.combine_chunks().indices.to_numpy()
    x, y, part, seq = (table.column(c).to_numpy() for c in ("x", "y", "part", "seq"))
    codes = table.column("codes").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    for i, j in zip(edge, np.append(edge[1:], len(seq))):
        if j - i > 1:
            yield seq[i:j], codes.slice(i, j - i), part[i:j] == x[i], x[i] == y[i]


def _groups(cells: DataFrame):
    n = 4 * max(4, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.groupBy(F.pmod(F.xxhash64("block", "x", "y"), F.lit(n)).alias("group"))


def similar_pairs(rows: DataFrame, threshold: float, cell: int | None = None) -> DataFrame:
    """lo, hi, similarity: all pairs of rows (seq, block, codes: distinct numbers) of one block whose sets reach the Jaccard threshold; two empty sets have 1."""
    schema = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("similarity", pa.float64())])

    def run(key, table):
        out = []
        for seq, codes, left, same in _cell(table):
            sets = Sets(codes)
            # rows of equal sets are compared as one
            names: dict[bytes, int] = {}
            name = np.array([names.setdefault(s.tobytes(), i) for i, s in enumerate(sets.sets)])
            order = np.argsort(name, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) > 0]))
            size = np.fromiter(map(len, sets.sets), np.int64, len(sets.sets))
            rows_of = {name[order[a]]: order[a:b] for a, b in zip(start, np.append(start[1:], len(order)))}
            one = np.array(sorted(rows_of))

            def pairs(a, b, similarity, within):
                m, k = np.repeat(a, len(b)), np.tile(b, len(a))
                on = (m < k if within else m != k) & (seq[m] != seq[k])
                if not same:
                    on &= left[m] != left[k]
                m, k = m[on], k[on]
                out.append((np.minimum(seq[m], seq[k]), np.maximum(seq[m], seq[k]), np.broadcast_to(similarity, len(on))[on]))

            for a in one.tolist():
                if len(rows_of[a]) > 1:
                    for i in range(0, len(rows_of[a]), 1024):
                        pairs(rows_of[a][i : i + 1024], rows_of[a], 1.0, True)
            many = np.zeros(len(seq), bool)
            many[[a for a in rows_of if len(rows_of[a]) > 1]] = True
            for a, near, overlap in sets.matches(one, threshold):
                similarity = overlap / np.maximum(size[a] + size[near] - overlap, 1)
                alone = ~many[near] & ~many[a]
                if alone.any():
                    pairs(np.array([a]), near[alone], similarity[alone], False)
                for b, s in zip(near[~alone].tolist(), similarity[~alone].tolist()):
                    pairs(rows_of[a], rows_of[b], s, False)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _groups(placed(rows, cell)).applyInArrow(run, "lo bigint, hi bigint, similarity double")


def with_earlier(rows: DataFrame, threshold: float, cell: int | None = None) -> DataFrame:
    """``seq`` of the rows of which an earlier one of the block is similar, without the pairs."""
    schema = pa.schema([("seq", pa.int64())])

    def run(key, table):
        out = [np.zeros(0, np.int64)]
        for seq, codes, left, same in _cell(table):
            sets = Sets(codes)
            known: dict[bytes, list[int]] = {}
            repeated = np.zeros(len(seq), bool)
            fresh = []
            for i, s in enumerate(sets.sets):  # ascending by seq
                mine = known.setdefault(s.tobytes(), [])
                repeated[i] = any(seq[k] < seq[i] for k in mine[:1])
                if not repeated[i]:
                    fresh.append(i)
                mine.append(i)
            out.append(seq[repeated])
            fresh = np.array(fresh, np.int64)
            out.append(np.array([seq[r] for r, _, _ in sets.matches(fresh, threshold, seq)], np.int64))
        return pa.table([pa.array(np.unique(np.concatenate(out)))], schema=schema)

    return _groups(placed(rows, cell)).applyInArrow(run, "seq bigint").distinct()


def overlapping(pairs: DataFrame, sets: DataFrame, threshold: float, parts: int | None = None) -> DataFrame:
    """a, b, similarity of the given pairs (a < b) of sets (id, codes: ascending) that reach the threshold.

    Ids are dealt to parts, and each two parts make a cell: a set is sent to the cells where it
    has a partner, so at most as often as there are parts, however many partners it has.
    """
    if not parts:
        load = sets.agg(F.sum(F.greatest(F.size("codes"), F.lit(LEAST)))).first()[0]
        parts = max(1, -(-(load or 0) // CELL))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    cell = F.least(part("a"), part("b")) * F.lit(parts).cast("bigint") + F.greatest(part("a"), part("b"))
    placed = pairs.withColumn("cell", cell)
    need = placed.select(F.col("cell").alias("into"), F.col("a").alias("id")).union(placed.select("cell", "b")).distinct()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(key, some, table):
        table = table.sort_by("id").combine_chunks()
        ids, codes = table.column("id").to_numpy(), table.column("codes").combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        flat, at = codes.values.to_numpy(), codes.offsets.to_numpy()
        known, rank = np.unique(flat[at[0] : at[-1]], return_inverse=True)
        of = np.split(rank, at[1:-1] - at[0])
        size, mark = np.diff(at), np.zeros(len(known), bool)
        some = some.sort_by("a")
        a, b = (np.searchsorted(ids, some.column(c).to_numpy()) for c in "ab")
        similarity = np.zeros(len(a))
        edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        for i, j in zip(edge, np.append(edge[1:], len(a))):
            mark[of[a[i]]] = True
            for k in range(i, j, 1024):
                near = b[k : min(j, k + 1024)]
                ends = np.cumsum(size[near])
                sums = np.concatenate([[0], np.cumsum(mark[np.concatenate([of[x] for x in near])])])
                o = sums[ends] - sums[ends - size[near]]
                similarity[k : k + len(near)] = o / (size[a[i]] + size[near] - o)
            mark[of[a[i]]] = False
        return pa.table([pa.array(ids[a]), pa.array(ids[b]), pa.array(similarity)], schema=schema).filter(pa.array(similarity >= threshold))

    return placed.groupBy("cell").cogroup(need.join(sets, "id").groupBy("into")).applyInArrow(run, "a bigint, b bigint, similarity double")

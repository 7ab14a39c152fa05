"""Size-aware heavy-light Jaccard join of word n-gram sets (operator 4).

Every document becomes the set of its distinct word n-grams (a shorter text: one gram
of all its words). All pairs of sets with Jaccard similarity of at least ``threshold`` are
found in these steps:

1. Equal sets are one set, named by a fingerprint.
2. Grams are routed by hash to buckets as packed arrays, and each bucket learns which of
   its grams occur in two sets or more, and in how many. Other grams can't be shared, so a
   set whose shared grams are fewer than its least overlap ``ceil(t * size)`` has no
   partner and is done. The rest keep their shared grams, rarest first.
3. Sets are put into blocks by the smallest hash of the more frequent half of their shared
   grams, where near copies meet: what an edit leaves in a copy is rare. A block of more than
   ``BLOCK_GRAMS`` grams is split. Sets of one block are candidates.
4. A partner misses at most ``d`` of a set's shared grams. Small (light) sets enumerate all
   pairs of the first ``d + 2`` grams: partners must have such a subset in common. Large
   (heavy) sets scan the inverted lists of their first ``d + 1`` grams, in which light sets of
   a compatible size are listed too. A list names a block once, however many of its sets
   hold the gram. The boundary is the size at which the summed cost of subsets, entries and
   pairs of blocks is least, from a sample of whole lists.
5. Blocks that meet are verified in the cell of the larger one. Near copies of one text, whose
   pairs grow with the square of their number, are settled by the triangle inequality from each
   set's distance to the cell's centre; only sets too far from it are compared in pairs, by a
   product of incidence matrices. A block of very many partners has several cells.

Nothing is capped, and no text is shuffled: what moves is 4 to 8 bytes a gram. Pairs leave a
cell as numbers of links and as the edges of a forest, so a group of near copies takes as
many rows as it has members, not their square.

A gram is 32 bits and its bucket's number, a set 64 bits. With ``B`` buckets two given grams
are mistaken for one with a chance of ``2**-32 / B``, so an overlap of sets of ``m`` and ``n``
grams is expected to be too large by ``m * n / B / 2**32``.

Defined results: null or wordless texts have no partner and are classes of their own; rows
with a null doc_id name no document and are left out (``keep_one`` groups them too);
rows that repeat a doc_id are one document that has all their texts; ties don't arise (every
qualifying pair counts); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import durable, large, partitions, trimmed, trimmed_group, unused
from .kernel import U64, grams, lowered, mix, slices, words

GRAM, THRESHOLD = 3, 0.45
#: Removed ids up to this many are broadcast to the documents; beyond, the join shuffles.
BROADCAST_IDS = 4_000_000
#: Blocks that are split are named to the tasks up to this many; beyond, the join shuffles.
BROADCAST_BLOCKS = 1_000_000
#: Grams of a block and of the partners in one of its cells: 8 MB each. A set counts as LEAST_LOAD at least, so they are 2048 sets at most.
BLOCK_GRAMS, LEAST_LOAD = 1 << 20, 512
#: A gram held in fewer than a DENSE-th of a cell's pairs of sets is counted pair by pair; a cell of CENTRED pairs or more is settled by distances first.
DENSE, CENTRED = 128, 1 << 12
PASSED = 0.05
#: Of so many lists one is counted for the boundary.
LISTS = 16
_LOW32 = U64(0xFFFFFFFF)


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, size, fingerprint): distinct 64-bit grams of the rows in turn, ascending within a row."""
    h, first, _, _ = words(lowered(column))
    g, own = grams(h, first, n)
    count = np.diff(own)
    short = np.flatnonzero((np.diff(first) > 0) & (count == 0))
    if len(short):  # fewer words than a gram has
        lone = np.array([_fold(h[first[i] : first[i + 1]]) for i in short], np.uint64)
        g = np.insert(g, own[short], lone)
        count[short] = 1
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((g, row)) if len(count) >= 1 << 24 else np.argsort((row.astype(np.uint64) << U64(40)) | (g >> U64(24)), kind="stable")
    g = g[order]
    new = np.ones(len(g), bool)
    # equal leading 40 bits may hide different grams, so ties are put in order by themselves
    tie = np.flatnonzero((row[1:] == row[:-1]) & (g[1:] >> U64(24) == g[:-1] >> U64(24)) & (g[1:] < g[:-1]))
    if len(tie):
        g = g[np.lexsort((g, row))]
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    g, row = g[new], row[new]
    size = np.bincount(row, minlength=len(count))
    at = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g))])
    return g, size, mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64))


def _fold(h: np.ndarray) -> int:
    x = len(h)
    for w in h.tolist():
        x = ((x + w) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return x


def _members(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, fp, size of each row that has a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("size", pa.int32())])

    def run(batches):
        for batch in batches:
            text, ids = large(batch, "text"), batch.column("doc_id").cast(pa.int64())
            for a, b in slices(text):
                _, size, fp = gram_sets(text.slice(a, b - a), n)
                yield pa.record_batch([ids.slice(a, b - a), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32))], schema=schema).filter(pa.array(size > 0))

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, fp bigint, size int")


def _pack(**arrays: np.ndarray) -> dict:
    return {k: v.tobytes() for k, v in arrays.items()}


def _cut(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binaries of the numbers between one place and the next."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])


def _routed(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Packed grams by bucket: of each set its fingerprint, size and count, and the low 32 bits of its grams."""
    kinds = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("fp", "home", "size", "count", "gram"))])

    def run(batches):
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text):
                g, size, fp = gram_sets(text.slice(a, b - a), n)
                fp, one = np.unique(fp, return_index=True)  # copies within this slice
                mine = np.zeros(len(size), bool)
                mine[one] = True
                row = np.repeat(np.arange(len(size)), size)
                g, row = g[mine[row]], row[mine[row]]
                name = np.full(len(size), -1)
                name[one] = np.arange(len(one))
                set_of, sizes = name[row], size[one].astype(np.int32)
                bucket = ((g >> U64(32)) % U64(buckets)).astype(np.int64)
                order = np.lexsort((set_of, bucket))
                g, set_of, bucket = g[order], set_of[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (set_of[1:] != set_of[:-1])])) if len(g) else np.zeros(0, np.int64)
                who, count = set_of[edge], np.diff(np.append(edge, len(g)))
                kind = next(t for t in (np.uint8, np.uint16, np.uint32) if count.max(initial=0) <= np.iinfo(t).max)
                home = (fp % U64(buckets)).astype(np.int64)  # only that bucket is told the size
                tell = np.argsort(home, kind="stable")
                at_gram, at_set, at_home = (np.searchsorted(x, np.arange(buckets + 1)) for x in (bucket, bucket[edge], home[tell]))
                out = [_cut(fp[who], at_set), _cut(fp[tell], at_home), _cut(sizes[tell], at_home), _cut(count.astype(kind), at_set), _cut((g & _LOW32).astype(np.uint32), at_gram)]
                some = (np.diff(at_gram) > 0) | (np.diff(at_home) > 0)
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), *out], schema=kinds).filter(pa.array(some))

    return docs.select("text").mapInArrow(trimmed(run), "bucket int, fp binary, home binary, size binary, count binary, gram binary")


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)] or [np.zeros(0, kind)])


def _counts(table: pa.Table) -> np.ndarray:
    parts = []
    for c, f in zip(table.column("count"), table.column("fp")):
        c = c.as_py()
        width = len(c) * 8 // max(1, len(f.as_py()))
        parts.append(np.frombuffer(c, {1: np.uint8, 2: np.uint16, 4: np.uint32}.get(width, np.uint8)).astype(np.int64))
    return np.concatenate(parts or [np.zeros(0, np.int64)])


def _shared(routed: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket the grams in two sets or more, routed on to the sets' own partitions."""
    kinds = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((k, pa.binary()) for k in ("fp", "home", "size", "count", "gram", "df"))])

    def run(key, table):
        bucket = key[0].as_py()
        fp, count, g = _joined(table, "fp", np.uint64), _counts(table), _joined(table, "gram", np.uint32)
        home, one = np.unique(_joined(table, "home", np.uint64), return_index=True)
        size = _joined(table, "size", np.int32)[one]
        _, one = np.unique(fp, return_index=True)  # copies among the slices
        mine = np.zeros(len(fp), bool)
        mine[one] = True
        which = np.repeat(np.arange(len(fp)), count)
        keep = mine[which]
        g, which = g[keep], which[keep]
        order = np.argsort(g, kind="stable")
        s = g[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        df = np.empty(len(s), np.uint32)
        df[order] = np.repeat(np.diff(np.append(start, len(s))), np.diff(np.append(start, len(s))))
        keep = df >= 2
        g, which, df = g[keep], which[keep], df[keep]
        part = (fp[which] % U64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        g, which, df, part = g[order], which[order], df[order], part[order]
        cut = np.searchsorted(part, np.arange(buckets + 1))
        out = []
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            told = slice(0, len(home) if k == bucket else 0)  # a set's home bucket is its part
            if a < b or told.stop:
                edge = np.flatnonzero(np.concatenate([[True], which[a + 1 : b] != which[a : b - 1]])) if a < b else np.zeros(0, np.int64)
                who, n = which[a:b][edge], np.diff(np.append(edge, b - a))
                kind = next(t for t in (np.uint8, np.uint16, np.uint32) if n.max(initial=0) <= np.iinfo(t).max)
                out.append({"part": k, "bucket": bucket} | _pack(fp=fp[who], home=home[told], size=size[told], count=n.astype(kind), gram=g[a:b], df=np.minimum(df[a:b], 65535).astype(np.uint16)))
        return pa.Table.from_pylist(out, schema=kinds)

    return routed.groupBy("bucket").applyInArrow(trimmed_group(run), "part int, bucket int, fp binary, home binary, size binary, count binary, gram binary, df binary")


def _survivors(shared: DataFrame, per_mille: int) -> DataFrame:
    """fp, size, shared grams (rarest first) and the smallest hash of the more frequent half of them (label) of the sets that share enough to have a partner."""
    kinds = pa.schema([("fp", pa.int64()), ("size", pa.int32()), ("prefix", pa.int32()), ("label", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(key, table):
        fp, g = _joined(table, "fp", np.uint64), _joined(table, "gram", np.uint32).astype(np.uint64)
        g |= np.repeat(table.column("bucket").to_numpy().astype(np.uint64), [len(x.as_py()) // 4 for x in table.column("gram")]) << U64(32)
        home, told = _joined(table, "home", np.uint64), _joined(table, "size", np.int32)
        df = _joined(table, "df", np.uint16)
        count = _counts(table)
        which = np.repeat(np.arange(len(fp)), count)
        names, code = np.unique(fp, return_inverse=True)
        total = np.bincount(code, count, len(names)).astype(np.int64)
        sizes = np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(names, home), max(len(names) - 1, 0))
        hit = names[at] == home if len(names) else np.zeros(len(home), bool)
        sizes[at[hit]] = told[hit]
        least = -(-per_mille * sizes // 1000)
        on = (total >= least)[code[which]]
        owner, g, df = code[which][on], g[on], df[on]
        order = np.lexsort((g, df, owner))
        owner, g, df = owner[order], g[order], df[order]
        live, first = np.unique(owner, return_index=True)
        ends = np.append(first, len(owner)).astype(np.int64)
        prefix = total[live] - least[live] + 1
        label = np.minimum.reduceat(mix(g + U64(0x632BE59BD9B4E019)), np.stack([first, (first + ends[1:]) // 2], 1).ravel())[1::2] if len(live) else np.zeros(0, np.uint64)
        return pa.table([pa.array(names[live].view(np.int64)), pa.array(sizes[live].astype(np.int32)), pa.array(prefix.astype(np.int32)), pa.array(label.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(g.view(np.int64)))], schema=kinds)

    return shared.groupBy("part").applyInArrow(trimmed_group(run), "fp bigint, size int, prefix int, label bigint, grams array<bigint>")


def boundary(placed: DataFrame) -> int:
    """The largest light size: where subsets enumerated up to it and lists scanned beyond it cost least.

    A row to shuffle counts as 1, a pair of blocks met in a list and passed over as ``PASSED``. A list
    names a block once, so a large group of near copies costs as many pairs as it has blocks;
    subsets are taken to be named by as few rows as lists are.
    """
    sampled = placed.select("block", "size", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram")).where(F.pmod(F.xxhash64("gram"), F.lit(LISTS)) == 0)
    lists = sampled.groupBy("gram", "block").agg(F.max("size").alias("size")).withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    heavy = lists.groupBy("size").agg((F.sum(F.col("met") * PASSED + 1) * LISTS).alias("heavy"), (F.count(F.lit(1)) * LISTS).alias("rows"))
    light = placed.groupBy("size").agg(F.sum((F.col("prefix").cast("bigint") + 1) * F.col("prefix") / 2).alias("light"), F.sum("prefix").alias("grams"))
    rows = light.join(heavy, "size", "left").select("size", (F.col("light") * F.least(F.lit(1.0), F.coalesce("rows", "grams") / F.col("grams"))).alias("light"), F.coalesce("heavy", "grams").alias("heavy")).orderBy("size").collect()
    best, at, cost = sum(r.heavy for r in rows), 0, sum(r.heavy for r in rows)
    for r in rows:
        cost += r.light - r.heavy
        if cost < best:
            best, at = cost, r["size"]
    return at


def _placed(sets: DataFrame) -> DataFrame:
    """The sets with their block: the label, or a part of it where its sets have more than BLOCK_GRAMS grams."""
    full = sets.groupBy("label").agg(F.sum(F.greatest(F.size("grams"), F.lit(LEAST_LOAD))).alias("load")).where(F.col("load") > BLOCK_GRAMS)
    full = durable(full.select("label", F.ceil(F.col("load") / BLOCK_GRAMS).alias("parts")))
    split = F.xxhash64("label", F.pmod(F.xxhash64("fp"), F.col("parts")))
    joined = sets.join(F.broadcast(full) if full.count() <= BROADCAST_BLOCKS else full, "label", "left")
    return joined.select("fp", "size", "prefix", "grams", F.when(F.col("parts").isNull(), F.col("label")).otherwise(split).alias("block"))


def _keys(placed: DataFrame, light: int, per_mille: int) -> DataFrame:
    """Join keys of each block: of kind 1 for subsets of light sets, of kind 0 for the lists that heavy sets scan and light ones stand in.

    ``sizes`` holds the least and the greatest size of the sets with the key, ``state`` four
    times the block's grams, plus 2 if it has several sets, plus 1 where one of the sets looks
    for partners: all but light sets in lists.
    """
    kinds = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("sizes", pa.int64()), ("state", pa.int64())])
    tiny = 1000 // per_mille  # sets that large or less may share a single gram with a partner, too few for a subset

    def run(key, table):
        ij: dict[int, tuple] = {}
        names, code = np.unique(table.column("block").to_numpy(), return_inverse=True)
        load = np.bincount(code, [max(len(g), LEAST_LOAD) for g in table.column("grams")], len(names)).astype(np.int64) * 4 + (np.bincount(code, minlength=len(names)) > 1) * 2
        keys, own, sizes, looks = [], [], [], []

        def add(kind, k, block, size, look):
            keys.append(mix(k.view(np.uint64) + U64(kind)).view(np.int64))
            own.append(np.full(len(k), block))
            sizes.append(np.full(len(k), size, np.int64))
            looks.append(np.full(len(k), look, np.int64))

        for block, size, m, g in zip(code.tolist(), *(table.column(k).to_pylist() for k in ("size", "prefix")), table.column("grams")):
            g = g.values.to_numpy()
            small = size <= tiny
            if size <= light and not small:
                w = min(m + 1, len(g))
                i, j = ij.setdefault(w, np.triu_indices(w, 1))
                x = np.sort(np.stack([g[i], g[j]]).view(np.uint64), 0)
                add(1, mix(x[0] * U64(0x9E3779B97F4A7C15) + mix(x[1])).view(np.int64), block, size, 1)
                if 1000 * size >= per_mille * (light + 1) or per_mille * size <= 1000 * tiny:
                    add(0, g[:m], block, size, 0)
            else:
                add(0, g[:m], block, size, 1)
        k, b, n, look = (np.concatenate(x) for x in (keys, own, sizes, looks))
        order = np.lexsort((b, k))
        k, b, n, look = k[order], b[order], n[order], look[order]
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])]))
        least, most = np.minimum.reduceat(n, edge), np.maximum.reduceat(n, edge)
        b = b[edge]
        return pa.table([pa.array(x) for x in (k[edge], names[b], least << 32 | most, load[b] + np.maximum.reduceat(look, edge))], schema=kinds)

    return placed.groupBy(F.pmod("block", F.lit(max(4, partitions(placed.sparkSession)))).alias("part")).applyInArrow(trimmed_group(run), "key bigint, block bigint, sizes bigint, state bigint")


def _cells(placed: DataFrame, light: int, per_mille: int) -> DataFrame:
    """x, part, block: the blocks that meet in each part of the cell of block x, itself among them."""
    keys = durable(_keys(placed, light, per_mille))
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "sizes", "state"))) for side in "ab")
    least, most = (lambda s: F.shiftright(f"sizes_{s}", 32)), (lambda s: F.col(f"sizes_{s}").bitwiseAND(F.lit(0xFFFFFFFF)))
    fit = [most(s) * 1000 >= least(t) * per_mille for s, t in ("ab", "ba")]
    met = a.join(b, "key").where("block_a < block_b and (state_a & 1 = 1 or state_b & 1 = 1)").where(fit[0] & fit[1])
    sides = [F.struct(F.shiftright(f"state_{s}", 2).alias("load"), F.col(f"block_{s}").alias("block")) for s in "ab"]
    pairs = met.select(F.greatest(*sides).alias("x"), F.least(*sides).alias("y")).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"), F.col("y.load").alias("load")).distinct()
    pairs = durable(pairs.unionByName(keys.where("state & 2 = 2").select(F.col("block").alias("x"), F.col("block").alias("y"), F.lit(0).cast("bigint").alias("load")).distinct()))
    total = pairs.groupBy("x").agg(F.ceil((F.sum("load") + 1) / BLOCK_GRAMS).alias("parts"))
    cells = pairs.join(total, "x").select("x", F.when(F.col("load") == 0, 0).otherwise(F.pmod(F.xxhash64("y"), F.col("parts"))).alias("part"), F.col("y").alias("block"))
    return durable(cells.unionByName(cells.select("x", "part", F.col("x").alias("block"))).distinct())


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets x with all sets y.

    A gram of many sets is a column of a product of incidence matrices; for the others, most of
    those of near copies, the few pairs of sets that hold one are counted one by one.
    """
    size = lambda s: np.fromiter(map(len, s), np.int64, len(s))
    known, code = np.unique(np.concatenate(x), return_inverse=True)
    row = np.repeat(np.arange(len(x)), size(x))
    other, mine = np.concatenate(y), np.repeat(np.arange(len(y)), size(y))
    at = np.minimum(np.searchsorted(known, other), len(known) - 1)
    hit = known[at] == other
    at, mine = at[hit], mine[hit]
    out = np.zeros((len(x), len(y)), np.float32 if len(known) < 1 << 24 else np.float64)  # whole numbers either way
    for parts in ((code, row), (at, mine)):
        order = np.argsort(parts[0], kind="stable")
        for p in parts:
            p[:] = p[order]
    held = np.bincount(code, minlength=len(known))
    dense = held * np.bincount(at, minlength=len(known)) > len(x) * len(y) // DENSE
    rare = np.flatnonzero(~dense[at])
    ends, first = np.cumsum(held[at[rare]]), np.cumsum(held) - held
    flat, done = out.reshape(-1), 0
    while done < len(rare):  # some entries of y at a time, each with all sets x of its gram
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 20), "right")))
        k, m = at[rare[done:to]], mine[rare[done:to]]
        n = held[k]
        met = row[np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())] * len(y) + np.repeat(m, n)
        if 4 * len(met) > len(flat):
            flat += np.bincount(met, minlength=len(flat)).astype(out.dtype)
        else:
            met, n = np.unique(met, return_counts=True)
            flat[met] += n
        done = to
    number = np.cumsum(dense) - 1
    (code, row), (at, mine) = ((number[c[dense[c]]], r[dense[c]]) for c, r in ((code, row), (at, mine)))
    for a in range(0, int(dense.sum()), columns):
        m = []
        for c, r, n in ((code, row, len(x)), (at, mine, len(y))):
            i, j = np.searchsorted(c, (a, a + columns))
            m.append(np.zeros((n, min(columns, int(dense.sum()) - a)), np.float32))
            m[-1][r[i:j], c[i:j] - a] = 1
        out += m[0] @ m[1].T
    return out


def slacks(sets: list[np.ndarray], size: np.ndarray, centre: np.ndarray, per_mille: int) -> tuple[np.ndarray, np.ndarray]:
    """(slack, reach) of each set by its distance (grams in one but not in both) from a set ``centre``, which is sorted.

    Two sets with ``D`` grams in one but not in both are linked if ``D * (1000 + per_mille) <= (size + size') *
    (1000 - per_mille)``, and by the triangle inequality ``D`` is at most the sum of both distances
    and at least their difference. So slacks that add up to 0 or more prove a link, and a slack
    and a reach that add up to less than 0 prove that there is none.
    """
    every = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    at = np.minimum(np.searchsorted(centre, every), max(len(centre) - 1, 0))
    common = np.bincount(own[centre[at] == every], minlength=len(sets)) if len(centre) else np.zeros(len(sets), np.int64)
    far = (size + len(centre) - 2 * common) * (1000 + per_mille)
    return size * (1000 - per_mille) - far, size * (1000 - per_mille) + far


def joined_parts(n: int, near: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` nodes the first one that it is linked with, directly or not: all of ``near`` with each other, and (rows, columns, linked) of each part."""
    label = np.arange(n)

    def least(linked, of):
        return np.concatenate([label[:0], *(np.where(linked[i : i + 256], of[None, :], n).min(1, initial=n) for i in range(0, len(linked), 256))])

    while True:
        new = label.copy()
        new[near] = new[near].min(initial=n)
        for r, c, linked in parts:
            new[r] = np.minimum(new[r], least(linked, new[c]))
            new[c] = np.minimum(new[c], least(linked.T, new[r]))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it is linked with, directly or not."""
    every = np.arange(len(linked))
    return joined_parts(len(linked), every[:0], [(every, every, linked)])


def links(x: list[np.ndarray], y: list[np.ndarray], size_x: np.ndarray, size_y: np.ndarray, per_mille: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of links, first node linked directly or not) of the sets x followed, unless ``same`` (y is x), by the sets y.

    Where there are many pairs, near copies are settled by their distances from one centre, the grams
    that more than half of the sets x hold; only sets too far from it are compared with the others.
    """
    every_x, every_y = np.arange(len(x)), np.arange(len(y))
    far_x, far_y, seen_x, seen_y = every_x, every_y[:0], every_x, every_y
    near_x, near_y = every_x[:0], every_y[:0]
    if len(x) * len(y) >= CENTRED:
        gram, held = np.unique(np.concatenate(x), return_counts=True)
        centre = gram[2 * held > len(x)]
        slack_x, reach_x = slacks(x, size_x, centre, per_mille)
        slack_y, reach_y = (slack_x, reach_x) if same else slacks(y, size_y, centre, per_mille)
        near_x, near_y = np.flatnonzero(slack_x >= 0), np.flatnonzero(slack_y >= 0)
        # sets too far from all of the other side have no link
        seen_x, seen_y = np.flatnonzero(slack_x + reach_y.max() >= 0), np.flatnonzero(slack_y + reach_x.max() >= 0)
        far_x, far_y = np.setdiff1d(seen_x, near_x), np.setdiff1d(seen_y, near_y)

    def compared(rows, columns):
        linked = np.empty((len(rows), len(columns)), bool)
        if linked.size:
            overlap, a, b = overlaps([x[i] for i in rows], [y[i] for i in columns]), size_x[rows], size_y[columns]
            for i in range(0, len(rows), 256):  # memory for some rows at a time
                o = overlap[i : i + 256].astype(np.int64)
                linked[i : i + 256] = o * 1000 >= (a[i : i + 256, None] + b[None, :] - o) * per_mille
        return linked

    if same:
        linked = compared(far_x, every_x)
        linked[np.arange(len(far_x)), far_x] = False
        n = np.zeros(len(x), np.int64)
        n[near_x] = len(near_x) - 1 + linked.sum(0)[near_x]
        n[far_x] = linked.sum(1)
        return n, joined_parts(len(x), near_x, [(far_x, every_x, linked)])
    parts = [(r, c, compared(r, c)) for r, c in ((far_x, seen_y), (near_x, far_y))]
    n_x, n_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    n_x[near_x], n_y[near_y] = len(near_y), len(near_x)
    for r, c, linked in parts:
        n_x[r] += linked.sum(1)
        n_y[c] += linked.sum(0)
    hub = np.concatenate([near_x, len(x) + near_y]) if len(near_x) and len(near_y) else near_x[:0]
    return np.concatenate([n_x, n_y]), joined_parts(len(x) + len(y), hub, [(r, len(x) + c, linked) for r, c, linked in parts])


def _verified(cells: DataFrame, placed: DataFrame, per_mille: int, pairs: bool) -> DataFrame:
    """fp_a, fp_b, n, jaccard: the pairs of sets that reach the threshold, or else (n is not null) numbers of links and, at 0, edges of a forest."""
    kinds = pa.schema([("fp_a", pa.int64()), ("fp_b", pa.int64()), ("n", pa.int64()), ("jaccard", pa.float64())])

    def compared(x, y, size_x, size_y, fp_x, fp_y, same):
        if pairs:
            overlap, linked = overlaps(x, y), np.empty((len(x), len(y)), bool)
            for i in range(0, len(x), 256):  # memory for some rows at a time
                o = overlap[i : i + 256].astype(np.int64)
                linked[i : i + 256] = o * 1000 >= (size_x[i : i + 256, None] + size_y[None, :] - o) * per_mille
            a, b = np.nonzero(np.triu(linked, 1) if same else linked)
            o = overlap[a, b].astype(np.float64)
            return [fp_x[a], fp_y[b], np.full(len(a), -1), np.round(o / (size_x[a] + size_y[b] - o), 6)]
        fp = fp_x if same else np.concatenate([fp_x, fp_y])
        n, root = links(x, y, size_x, size_y, per_mille, same)
        on, tied = n > 0, root != np.arange(len(root))
        return [np.concatenate([fp[on], fp[tied]]), np.concatenate([fp[on], fp[root[tied]]]), np.concatenate([n[on], np.zeros(tied.sum(), np.int64)]), np.zeros(on.sum() + tied.sum())]

    def run(key, table):
        x, part, block, fp, size = (table.column(c).to_numpy() for c in ("x", "part", "block", "fp", "size"))
        grams, out = table.column("grams").combine_chunks(), []
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        flat, offset, size = grams.values.to_numpy(), grams.offsets.to_numpy(), size.astype(np.int64)
        order = np.lexsort((block != x, part, x))
        edge = np.flatnonzero(np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (part[order][1:] != part[order][:-1])]))
        for i, j in zip(edge, np.append(edge[1:], len(order))):
            own = order[i:j]
            mine, theirs = own[block[own] == x[own]], own[block[own] != x[own]]
            sets = lambda rows: [flat[offset[r] : offset[r + 1]] for r in rows]
            if part[own[0]] == 0 and len(mine) > 1:
                out.append(compared(sets(mine), sets(mine), size[mine], size[mine], fp[mine], fp[mine], True))
            if len(theirs):
                out.append(compared(sets(mine), sets(theirs), size[mine], size[theirs], fp[mine], fp[theirs], False))
        a, b, n, jaccard = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0)] * 4
        swap = (n < 0) & (a > b)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64(), mask=n < 0), pa.array(jaccard, pa.float64(), mask=n >= 0)], schema=kinds)

    groups = 4 * max(4, partitions(placed.sparkSession))
    need = cells.join(placed.select("block", "fp", "size", "grams"), "block")
    return need.groupBy(F.pmod(F.xxhash64("x", "part"), F.lit(groups)).alias("group")).applyInArrow(trimmed_group(run), "fp_a bigint, fp_b bigint, n bigint, jaccard double")


def _joined_sets(docs: DataFrame, n: int, threshold: float, pairs: bool) -> DataFrame:
    per_mille = math.ceil(threshold * 1000 - 1e-9)
    buckets = max(4, partitions(docs.sparkSession))
    sets = durable(_survivors(_shared(_routed(docs, n, buckets), buckets), per_mille))
    placed = _placed(sets)
    return _verified(_cells(placed, boundary(placed), per_mille), placed, per_mille, pairs)


def similar_sets(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """fp_a, fp_b and jaccard of all pairs of different sets that reach the threshold."""
    return _joined_sets(docs, n, threshold, True).select("fp_a", "fp_b", "jaccard")


def similar_documents(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id_a < doc_id_b, jaccard.

    Sets in full agreement are joined as a star around their smallest doc_id, and that
    document stands for all of them in pairs with others: what holds for it holds for each
    of them, and a group of copies takes as many rows as it has members, not their square.
    """
    docs = docs.where("doc_id is not null")
    members = _members(docs, n)
    first = members.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    star = members.join(first, "fp").where("doc_id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard")).distinct()
    pairs = similar_sets(docs, n, threshold)
    both = pairs.join(first.withColumnsRenamed({"fp": "fp_a", "rep": "x"}), "fp_a").join(first.withColumnsRenamed({"fp": "fp_b", "rep": "y"}), "fp_b").where("x <> y")
    return star.unionByName(both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard"))


def components(pairs: DataFrame) -> DataFrame:
    """node, root: of each node of the edges u, v the smallest one that it is linked with, directly or not.

    Labels spread over neighbours and jump to their label's label; each round is written,
    so that a lost executor costs no more than a round.
    """
    edges = durable(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = durable(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).select(F.col("u").alias("node"), "root"))
    while True:
        near = edges.join(label, edges.v == label.node).groupBy("u").agg(F.min("root").alias("near"))
        grown = label.join(near, label.node == near.u).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = grown.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = durable(grown.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        label = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return label


def classes(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_copies, n_links: one row for each document.

    A class is all documents that are linked, directly or not, named by the smallest doc_id;
    ``n_copies`` counts the other documents of an equal set, ``n_links`` the different sets that
    reach the threshold (summed over the texts of a document that has several).
    """
    docs = docs.where("doc_id is not null")
    members = durable(_members(docs, n).select("doc_id", "fp").distinct())
    found = durable(_joined_sets(docs, n, threshold, False))
    # several texts of one doc_id belong together as well
    first = members.groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("last")).where("v <> last")
    root = components(found.where("n = 0").select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")).unionByName(members.join(first, "doc_id").where("fp <> v").select(F.col("fp").alias("u"), "v")))
    links = found.where("n > 0").groupBy(F.col("fp_a").alias("fp")).agg(F.sum("n").alias("links"))
    sets = members.groupBy("fp").agg(F.min("doc_id").alias("rep"), (F.count(F.lit(1)) - 1).alias("copies"))
    sets = sets.join(root.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = sets.groupBy("root").agg(F.min("rep").alias("class_id"))
    each = members.join(sets.join(names, "root").select("fp", "class_id", "copies", "links"), "fp").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("n_copies"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"))
    none = {"n_copies": 0, "n_links": 0}
    return docs.select("doc_id").distinct().join(each, "doc_id", "left").fillna(none).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_copies", "n_links")


def keep_one(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest doc_id (a null one only where there is no other), all columns unchanged.

    Rows are told apart by doc_id and set: of rows equal in both one stays, and where a
    doc_id has several texts, each is judged by itself. Rows without a word all stay.
    """
    fp_, row_, doc, key = (unused(docs, c) for c in ("fp", "row", "doc", "key"))
    members = durable(_members(docs, n).groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("rows")))
    found = durable(_joined_sets(docs, n, threshold, False).where("n = 0"))
    root = components(found.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))).withColumnRenamed("node", "fp")
    named = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "fp")
    own = members.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = own.groupBy("root").agg(F.min(named).alias("best"))
    gone = durable(own.join(best, "root").where(named != F.col("best")).select(F.col("doc_id").alias(doc), F.col("fp").alias(key)))
    again = durable(members.where("rows > 1").select(F.col("doc_id").alias(doc), F.col("fp").alias(key)))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    match = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(fp_) == F.col(key))

    def run(batches):
        for batch in batches:
            text, fp = large(batch, "text"), []
            for a, b in slices(text):
                _, size, x = gram_sets(text.slice(a, b - a), n)
                fp.append(pa.array(x.view(np.int64), pa.int64(), mask=size == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(fp) if fp else pa.array([], pa.int64())], names=names)

    names = [*docs.columns, fp_]
    schema = StructType([*docs.schema.fields, StructField(fp_, LongType())])
    left = docs.mapInArrow(trimmed(run), schema).join(small(gone), match, "left_anti")
    if not again.limit(1).count():
        return left.select(docs.columns)
    once = left.join(small(again), match, "left_anti")
    twice = left.join(small(again), match, "left_semi").withColumn(row_, F.row_number().over(Window.partitionBy("doc_id", fp_).orderBy("doc_id"))).where(F.col(row_) == 1)
    return once.select(docs.columns).unionByName(twice.select(docs.columns))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {GRAM} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(w[i:i + {GRAM} - 1], ' ')))) END AS g FROM w WHERE len(w) > 0),
m AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY g) AS fp, g FROM s),
f AS MATERIALIZED (SELECT fp, min(doc_id) AS rep, count(*) - 1 AS copies, any_value(g) AS g FROM m GROUP BY fp),
e AS (SELECT fp, len(g) AS size, unnest(g) AS x FROM f),
c AS (SELECT a.fp AS a, b.fp AS b, a.size + b.size AS total, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.fp < b.fp GROUP BY 1, 2, 3),
p AS MATERIALIZED (SELECT a, b FROM c WHERE o * 1000 >= (total - o) * {math.ceil(THRESHOLD * 1000 - 1e-9)}),
l AS (SELECT fp, count(*) AS links FROM (SELECT a AS fp FROM p UNION ALL SELECT b FROM p) GROUP BY fp),
u AS MATERIALIZED (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p UNION SELECT a.fp, b.fp FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.fp <> b.fp),
r(node, far) AS (SELECT fp, fp FROM f UNION SELECT r.node, u.v FROM r JOIN u ON r.far = u.u),
k AS (SELECT node AS fp, min(rep) AS class_id FROM r JOIN f ON f.fp = r.far GROUP BY node),
d AS (SELECT m.doc_id, min(class_id) AS class_id, sum(copies)::BIGINT AS n_copies, sum(coalesce(links, 0))::BIGINT AS n_links FROM m JOIN f ON m.fp = f.fp JOIN k ON m.fp = k.fp LEFT JOIN l ON m.fp = l.fp GROUP BY m.doc_id)
SELECT a.doc_id, coalesce(class_id, a.doc_id) AS class_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) a LEFT JOIN d ON a.doc_id = d.doc_id
"""

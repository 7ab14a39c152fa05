"""Counts of character trigrams, and their similarity between a stated set of items and all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.grams import slices, spelled, trigrams

#: Documents times trigrams of the items in a matrix: 16 MB.
CELLS = 1 << 22


def _repeated(df: DataFrame, key: str) -> DataFrame | None:
    """Keys of several rows, null among them, or None where there are none."""
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("_key"))
    return many if many.limit(1).count() else None


def _counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, n of each row by itself."""
    schema = StructType([df.schema[key], StructField("gram", StringType()), StructField("n", LongType())])
    kinds = pa.schema([("gram", pa.large_string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            column, keys = batch.column(1).cast(pa.large_string()).fill_null(""), batch.column(0)
            for a, b in slices(column):
                row, gram, n, alphabet = trigrams(column.slice(a, b - a))
                for i in range(0, len(row), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[part] + a)), spelled(gram[part], alphabet).cast(pa.string()), pa.array(n[part], kinds.field("n").type)], names=names)

    names = [key, "gram", "n"]
    return df.select(key, text).mapInArrow(run, schema)


def counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, n. A text's grams are counted where it is read; only texts that share a key are put together."""
    many = _repeated(df, key)
    if many is None:
        return _counted(df, key, text)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return _counted(df.join(many, same, "left_anti"), key, text).unionByName(_counted(df.join(many, same, "left_semi"), key, text).groupBy(key, "gram").agg(F.sum("n").alias("n")))


def pairs(items: DataFrame, item: str, docs: DataFrame, doc: str, measure: str, text: str = "text") -> DataFrame:
    """a, b and the ``jaccard`` or ``cosine`` of the trigrams of all items and documents; 0 where neither, or for cosine either, has any.

    The items are held by every worker; documents are read once and multiplied with them some at a time.
    Documents that share a doc_id count with all their texts, as do items.
    """
    if _repeated(docs, doc) is not None:
        glued = docs.groupBy(doc).agg(F.collect_list(text).alias("_texts"))
        docs = docs.select(doc).join(glued, doc, "left").select(doc, F.coalesce("_texts", F.array().cast("array<string>")).alias(text))
    else:
        docs = docs.select(doc, F.array(F.coalesce(text, F.lit(""))).alias(text))
        docs = docs.select(doc, F.when(F.col(doc).isNotNull(), F.col(text)).otherwise(F.array().cast("array<string>")).alias(text))
    rows = items.select(item, text).collect()
    ids = [r[0] for r in rows]
    place: dict = {}
    known: dict[str, int] = {}
    entries = []
    for k, t in rows:
        if k is not None:
            at = place.setdefault(k, len(place))
            entries += [(known.setdefault(t[i : i + 3], len(known)), at) for i in range(len(t or "") - 2)]
    of = np.array([place.get(k, len(place)) for k in ids], np.int64)
    weight = np.zeros((max(1, len(known)), len(place) + 1), np.float64)
    np.add.at(weight, tuple(np.array(entries, np.int64).reshape(-1, 2).T), 1)
    held = weight > 0
    size, norm, most = held.sum(0).astype(np.int64), np.sqrt((weight * weight).sum(0)), weight.max(initial=0)
    # grams of the items as numbers of 63 bits, in order
    numbers = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in known], np.int64)
    order = np.argsort(numbers)
    sorted_numbers, held32, weight32 = numbers[order], held[order].astype(np.float32), weight[order].astype(np.float32)
    weight = weight[order]
    step = max(1, CELLS // max(1, len(known), len(ids)))
    schema = StructType([StructField("a", items.schema[item].dataType), StructField("b", docs.schema[doc].dataType), StructField(measure, DoubleType())])
    kind = pa.array(ids).type if any(i is not None for i in ids) else pa.int64()

    def of_rows(n, row, gram, count, alphabet):
        """All items' measure for n rows of documents."""
        code = alphabet.astype(np.int64)
        base = max(1, len(code))
        number = code[gram // base // base] << 42 | code[gram // base % base] << 21 | code[gram % base]
        q, v = np.bincount(row, minlength=n), np.sqrt(np.bincount(row, count.astype(np.float64) ** 2, minlength=n))
        at = np.minimum(np.searchsorted(sorted_numbers, number), max(len(sorted_numbers) - 1, 0))
        hit = sorted_numbers[at] == number if len(sorted_numbers) else np.zeros(len(number), bool)
        total = np.bincount(row, count, minlength=n).max(initial=0)
        exact = measure == "jaccard" or total * max(most, 1) < 1 << 24  # whole numbers of 32 bits
        m = np.zeros((n, max(1, len(known))), np.float32 if exact else np.float64)
        m[row[hit], at[hit]] = 1 if measure == "jaccard" else count[hit]
        met = (m @ (held32 if measure == "jaccard" else weight32 if exact else weight)).astype(np.float64)
        if measure == "jaccard":
            union = size[None, :] + q[:, None] - met
            out = np.where(union > 0, met / np.maximum(union, 1), 0.0)
        else:
            both = norm[None, :] * v[:, None]
            out = np.divide(met, both, out=np.zeros_like(met), where=both > 0)
        return out[:, of]

    def run(batches):
        names, a = ["a", "b", measure], pa.array(ids, kind)
        for batch in batches:
            lists, keys = batch.column(1), batch.column(0)
            offsets = lists.offsets.to_numpy()
            column = lists.values.cast(pa.large_string()).fill_null("")
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            for i in range(0, len(lists), step):
                j = min(i + step, len(lists))
                first, last = offsets[i], offsets[j]
                parts = []
                # texts are turned into numbers some at a time; those of one document are added up
                for x, y in slices(column.slice(first, last - first)):
                    row, gram, n, alphabet = trigrams(column.slice(first + x, y - x))
                    parts.append((owner[first + x + row] - i, alphabet, gram, n))
                out = np.zeros((j - i, len(ids)))
                lone = np.bincount(owner[first:last] - i, minlength=j - i) if last > first else np.zeros(j - i, int)
                if (lone <= 1).all():
                    for row, alphabet, gram, n in parts:
                        here = np.unique(row)
                        out[here] = of_rows(len(here), np.searchsorted(here, row), gram, n, alphabet)
                    # rows without a trigram have measure 0 with every item
                else:
                    strings = pa.concat_arrays([spelled(g, al) for _, al, g, _ in parts]) if parts else pa.array([], pa.large_string())
                    joined = pa.table({"row": np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64), "gram": strings, "n": np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)}).group_by(["row", "gram"]).aggregate([("n", "sum")]).sort_by("row")
                    points = np.array([[ord(c) for c in g] for g in joined.column("gram").to_pylist()], np.int64).reshape(-1, 3)
                    alphabet, code = np.unique(points, return_inverse=True)
                    code, base = code.reshape(-1, 3), max(1, len(alphabet))
                    out = of_rows(j - i, joined.column("row").to_numpy(), (code[:, 0] * base + code[:, 1]) * base + code[:, 2], joined.column("n_sum").to_numpy(), alphabet)
                per = max(1, (1 << 18) // max(1, len(ids)))
                for k in range(0, j - i, per):
                    n = min(per, j - i - k)
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(np.tile(np.arange(len(ids)), n))), keys.take(pa.array(np.repeat(np.arange(i + k, i + k + n), len(ids)))), pa.array(out[k : k + n].ravel())], names=names)

    return docs.mapInArrow(run, schema)

"""Consistent hashing as range joins against a small ring table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def places(nodes: list[str], replicas: int = 100) -> list[tuple[str, str]]:
    """(place, node), ascending: hexadecimal md5 of ``node:i``, which sorts like the number."""
    return sorted((hashlib.md5(f"{n}:{i}".encode()).hexdigest(), n) for n in nodes for i in range(replicas))


def ring(spark: SparkSession, nodes: list[str], replicas: int = 100) -> DataFrame:
    """place, node, and the place before: a key belongs to the first place at or above its hash."""
    found = places(nodes, replicas)
    rows = [(p, n, found[i - 1][0] if i else "") for i, (p, n) in enumerate(found)]
    return spark.createDataFrame(rows, "place string, node string, before string")


def assign(df: DataFrame, key: str, nodes: list[str], replicas: int = 100, out: str = "node") -> DataFrame:
    """The node of each key. The ring is cut at the hash's first two digits into a table of 256 rows, broadcast."""
    found = places(nodes, replicas)
    if not found:
        return df.withColumn(out, F.lit(None).cast("string"))
    hash_ = F.md5(F.col(key).cast("string"))
    # keys hash evenly, so the successor is sought among the places of one leading digit pair
    by: dict[str, list[tuple[str, str]]] = {}
    for p, n in found:
        by.setdefault(p[:2], []).append((p, n))
    after, nxt = {}, found[0][1]
    for i in range(255, -1, -1):
        head = f"{i:02x}"
        after[head] = nxt
        if head in by:
            nxt = by[head][0][1]
    spark = df.sparkSession
    rows = [(h, [{"place": p, "node": n} for p, n in by.get(h, [])], after[h]) for h in after]
    heads = F.broadcast(spark.createDataFrame(rows, "_head string, _own array<struct<place:string,node:string>>, _after string"))
    hit = F.get(F.filter("_own", lambda x: x["place"] >= F.col("_hash")), F.lit(0))["node"]
    return df.withColumn("_hash", hash_).withColumn("_head", F.substring("_hash", 1, 2)).join(heads, "_head").withColumn(out, F.coalesce(hit, "_after")).drop("_hash", "_head", "_own", "_after")


def replicas_of(df: DataFrame, key: str, nodes: list[str], count: int, replicas: int = 100) -> DataFrame:
    """The first ``count`` different nodes clockwise from each key, as (key, rank, node)."""
    found = places(nodes, replicas)
    rows = []
    for i, (p, _) in enumerate(found):
        order = list(dict.fromkeys(n for _, n in found[i:] + found[:i]))[:count]
        rows.append((p, order))
    spark = df.sparkSession
    steps = spark.createDataFrame([(p, found[i - 1][0] if i else "", o) for i, (p, o) in enumerate(rows)], "place string, before string, nodes array<string>")
    hashed = df.select(key, F.md5(F.col(key).cast("string")).alias("_h"))
    wrap = rows[0][1] if rows else []
    hit = hashed.join(F.broadcast(steps), (F.col("_h") > F.col("before")) & (F.col("_h") <= F.col("place")), "left")
    return hit.select(key, F.posexplode(F.coalesce("nodes", F.array(*map(F.lit, wrap)))).alias("rank", "node"))


def moved(df: DataFrame, key: str, before: list[str], after: list[str], replicas: int = 100) -> DataFrame:
    """Keys by old and new node after a change of membership."""
    return assign(assign(df, key, before, replicas, "node_before"), key, after, replicas, "node_after").groupBy("node_before", "node_after").agg(F.count(F.lit(1)).alias("keys"))

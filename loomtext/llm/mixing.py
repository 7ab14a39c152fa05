"""Mixing of sources to target weights (operator 2).

Source ``i`` with share ``s_i`` of the tokens gets the weight ``s_i ** a / sum(s ** a)``.
The exponent ``a`` in [0, 1] is bisected: as large as the target entropy allows (weights
as near to the corpus as that), but no smaller than the repetition limit allows. Each
source's weight times the budget is then spent on passes over blocks of its documents:
whole passes first, each in a block order of its own, then blocks of one more pass in its
order, the last of them in part. No document is split, so a source spends at most its
budget: of the last block documents are shown in its order until one doesn't fit, then the
shortest of the others, and less than the shortest one left out stays unspent.

Budgets are whole tokens by largest remainder. With exponent 1 they are exact, so a budget
of the corpus's size shows every document once; else weights are counted in parts of 10^9.

Blocks are hash classes of about ``BLOCK_TOKENS`` tokens, so running sums are over a
block's documents and over a source's blocks, never over a source's documents. Texts are
only counted; what moves is an id, a source and a count.

Defined results: a null source is the source named ``''``; null or blank texts have no
tokens and are never scheduled; repeated rows are each scheduled, ties in order broken by
doc_id and size (rows equal in both are interchangeable); an empty table gives an empty
schedule; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Entropy to reach, as a share of the greatest possible; passes over a source at most.
ENTROPY, REPEATS = 0.95, 4.0
BLOCK_TOKENS, SEED, PARTS = 100_000, 17, 10**9
SPACE = " \\t\\n\\f\\r"


def weights(tokens: dict[str, int], budget: int, entropy: float = ENTROPY, repeats: float = REPEATS) -> tuple[float, dict[str, float]]:
    """(exponent, weight of each source). Sources, not documents, are on the driver."""
    total = sum(tokens.values())
    shares = {k: v / total for k, v in sorted(tokens.items()) if v > 0} if total else {}

    def at(a: float) -> dict[str, float]:
        raw = {k: s**a for k, s in shares.items()}
        z = sum(raw.values())
        return {k: v / z for k, v in raw.items()}

    def bisect(good) -> float:
        """The largest exponent that is good, where small ones are; 0 if none is."""
        if good(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    if not shares:
        return 1.0, {}
    flat = bisect(lambda a: -sum(p * math.log(p) for p in at(a).values()) >= entropy * math.log(len(shares)) - 1e-12)
    most = lambda a: max(budget * p / tokens[k] for k, p in at(a).items())
    # the limit holds from some exponent on upwards; a budget beyond it for any exponent leaves the shares as they are
    steep = 0.0 if most(0.0) <= repeats else 1.0 if most(1.0) > repeats else 1 - bisect(lambda b: most(1 - b) <= repeats)
    a = round(max(flat, steep), 6)
    return a, at(a)


def budgets(tokens: dict[str, int], budget: int, exponent: float, share: dict[str, float]) -> dict[str, int]:
    """Whole tokens of each source, which add up to the budget; remainders go to the largest (ties: first by name)."""
    parts = {k: tokens[k] if exponent == 1 else math.floor(p * PARTS + 0.5) for k, p in share.items()}
    total = sum(parts.values())
    if not total:
        return {}
    own = {k: budget * v // total for k, v in parts.items()}
    rest = sorted(parts, key=lambda k: (-(budget * parts[k] % total), k))
    return own | {k: own[k] + 1 for k in rest[: budget - sum(own.values())]}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and n_tokens (runs of non-space) of the documents that have any."""
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))).cast("bigint").alias("n_tokens")
    ).where("n_tokens > 0")


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts)))


def schedule(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """doc_id, source, epoch, block_rank, n_tokens: one row for each time that a document is shown.

    ``budget`` is in tokens, as many as the corpus has where not given.
    """
    spark = docs.sparkSession
    rows = durable(counted(docs))
    tokens = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("n_tokens")).collect()}
    budget = sum(tokens.values()) if budget is None else budget
    exponent, share = weights(tokens, budget, entropy, repeats)
    plan = [(k, max(1, -(-tokens[k] // block_tokens)), own // tokens[k], own % tokens[k]) for k, own in budgets(tokens, budget, exponent, share).items()]
    # as many rows as sources
    sources = spark.createDataFrame(plan, "source string, n_blocks bigint, whole bigint, rest bigint")
    s = F.lit(seed)
    rows = rows.join(sources, "source").withColumn("block", F.conv(F.substring(_hash("doc_id", s), 1, 8), 16, 10).cast("bigint") % F.col("n_blocks"))
    blocks = durable(rows.groupBy("source", "block", "whole", "rest").agg(F.sum("n_tokens").alias("size")))
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))))
    order = Window.partitionBy("source", "epoch").orderBy("key", "block")
    epochs = (
        epochs.withColumn("key", _hash("source", "block", "epoch", s))
        .withColumn("block_rank", F.row_number().over(order))
        .withColumn("spent", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .where("epoch < whole or spent < rest")
        .select("source", "block", "epoch", "block_rank", (F.col("epoch") < F.col("whole")).alias("full"), (F.col("rest") - F.col("spent")).alias("left"))
    )
    shown = rows.select("doc_id", "source", "block", "n_tokens").join(epochs, ["source", "block"]).withColumn("key", _hash("doc_id", "epoch", s))
    # the last block of each source
    block, n = Window.partitionBy("source", "block", "epoch"), F.col("n_tokens")
    upto = F.sum(F.when(n <= F.col("left"), n).otherwise(0)).over(block.orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    part = shown.where("not full").withColumn("upto", upto).withColumn("early", (n <= F.col("left")) & (F.col("upto") <= F.col("left")))
    spare = F.col("left") - F.coalesce(F.max(F.when(F.col("early"), F.col("upto"))).over(block), F.lit(0))
    more = F.sum(F.when(F.col("early"), 0).otherwise(n)).over(block.orderBy("n_tokens", "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("spare", spare).withColumn("more", more).where("early or more <= spare")
    columns = ["doc_id", "source", "epoch", "block_rank", "n_tokens"]
    return shown.where("full").select(columns).unionByName(part.select(columns))


def oracle(documents: str = "documents", before: str = "", entropy: float = ENTROPY, repeats: float = REPEATS) -> str:
    """DuckDB SQL of ``schedule`` over a relation; ``before``: common table expressions it needs."""
    return f"""
WITH RECURSIVE {before}
c AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS n_tokens FROM {documents}),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM c WHERE n_tokens > 0 GROUP BY 1),
s AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM t)::DOUBLE AS share, (SELECT sum(tokens) FROM t)::BIGINT AS budget, (SELECT count(*) FROM t) AS n FROM t),
h(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(pow(share, (lo + hi) / 2))) / sum(pow(share, (lo + hi) / 2)) >= {entropy} * ln(max(n)) - 1e-12 FROM s) AS good FROM h WHERE i < 50)),
r(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(budget * pow(share, 1 - (lo + hi) / 2) / tokens) / (SELECT sum(pow(share, 1 - (lo + hi) / 2)) FROM s) <= {repeats} FROM s) AS good FROM r WHERE i < 50)),
a AS (SELECT round(greatest(
    CASE WHEN (SELECT -sum(share * ln(share)) >= {entropy} * ln(max(n)) - 1e-12 FROM s) THEN 1 ELSE (SELECT lo FROM h WHERE i = 50) END,
    CASE WHEN (SELECT max(budget / n::DOUBLE / tokens) <= {repeats} FROM s) THEN 0 ELSE 1 - (SELECT lo FROM r WHERE i = 50) END), 6) AS a),
x AS (SELECT source, tokens, budget, CASE WHEN a = 1 THEN tokens ELSE floor(pow(share, a) / (SELECT sum(pow(share, a.a)) FROM s, a) * {PARTS} + 0.5)::BIGINT END::HUGEINT AS part FROM s, a),
y AS (SELECT source, tokens, budget, budget * part // sum(part) OVER () AS low, budget * part % sum(part) OVER () AS remainder FROM x),
w AS (SELECT source, tokens, (low + (row_number() OVER (ORDER BY remainder DESC, source) <= budget - sum(low) OVER ())::INTEGER)::BIGINT AS own FROM y),
p AS (SELECT source, CASE WHEN tokens % {BLOCK_TOKENS} = 0 THEN greatest(1, tokens // {BLOCK_TOKENS}) ELSE tokens // {BLOCK_TOKENS} + 1 END AS n_blocks, own // tokens AS whole, own % tokens AS rest FROM w),
d AS (SELECT doc_id, c.source, n_tokens, whole, rest, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), '{SEED}')), 1, 8))::BIGINT % n_blocks AS block FROM c JOIN p ON c.source = p.source WHERE n_tokens > 0),
b AS (SELECT source, block, whole, rest, sum(n_tokens) AS size FROM d GROUP BY 1, 2, 3, 4),
e AS (SELECT *, md5(concat_ws(':', source, block::VARCHAR, epoch::VARCHAR, '{SEED}')) AS key FROM (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM b)),
f AS (SELECT *, row_number() OVER o AS block_rank, sum(size) OVER o - size AS spent FROM e WINDOW o AS (PARTITION BY source, epoch ORDER BY key, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT d.doc_id, d.source, d.block, f.epoch, f.block_rank, d.n_tokens, f.epoch < f.whole AS whole_epoch, f.rest - f.spent AS remaining, md5(concat_ws(':', coalesce(d.doc_id::VARCHAR, 'null'), f.epoch::VARCHAR, '{SEED}')) AS key
  FROM d JOIN f ON d.source = f.source AND d.block = f.block WHERE f.epoch < f.whole OR f.spent < f.rest),
j AS (SELECT *, sum(CASE WHEN n_tokens <= remaining THEN n_tokens ELSE 0 END) OVER (PARTITION BY source, block, epoch ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g WHERE NOT whole_epoch),
k AS (SELECT *, n_tokens <= remaining AND upto <= remaining AS early FROM j),
l AS (SELECT *, remaining - coalesce(max(CASE WHEN early THEN upto END) OVER (PARTITION BY source, block, epoch), 0) AS spare,
  sum(CASE WHEN early THEN 0 ELSE n_tokens END) OVER (PARTITION BY source, block, epoch ORDER BY n_tokens, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS further FROM k)
SELECT doc_id, source, epoch, block_rank, n_tokens FROM g WHERE whole_epoch
UNION ALL
SELECT doc_id, source, epoch, block_rank, n_tokens FROM l WHERE early OR further <= spare
"""


ORACLE = oracle()

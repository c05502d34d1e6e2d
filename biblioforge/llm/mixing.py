"""A mix of sources in target shares, by a low-discrepancy schedule.

Each source's texts, in the order of a hash, form blocks of equal tokens (running sums taken in two levels,
so no task holds a source). Slot ``i`` of the mix takes the point ``i x golden ratio mod 1`` through the
cumulative shares to its source; the slot's rank within its source names the block, counted round and round
up to the source's number of repeats. Slots and blocks meet in one join. The mix is as long as the scarcest
source allows at its share.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = (math.sqrt(5) - 1) / 2
SEED = 17
BUCKET_DOCS = 20_000  # texts whose running sums one task takes
MAX_BLOCK = 1 << 22  # tokens
SLOTS = 4096  # at least so many slots where the texts are small enough


def mixed(sized: DataFrame, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, doc_id, use_no, n_tokens): the texts of the mix in its order, use_no counted from 1.

    ``sized`` has doc_id, source, n_tokens; ``targets`` (a fixed small table) source, target_share,
    max_repeat. Texts without tokens, without source or of sources without target are no part of the mix.
    Targets without texts leave their share to the others. Empty tables give an empty mix.
    """
    spark = sized.sparkSession
    goal = {r[0]: (float(r[1]), int(r[2])) for r in targets.select("source", "target_share", "max_repeat").where("source is not null and target_share > 0 and max_repeat > 0").limit(1001).collect()}
    if len(goal) > 1000:
        raise ValueError("targets are meant to be a small table")
    docs = sized.where("n_tokens > 0").where(F.col("source").isin(*goal)).select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(SEED)).alias("h")) if goal else sized.limit(0).select("doc_id", "source", "n_tokens", F.lit(0).cast("bigint").alias("h"))
    have = {r[0]: (int(r[1]), int(r[2])) for r in docs.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}  # a row a source
    schema = "slot bigint, source string, doc_id bigint, use_no int, n_tokens int"
    if not have:
        return spark.createDataFrame([], schema)
    whole = sum(goal[s][0] for s in have)
    share = {s: goal[s][0] / whole for s in sorted(have)}
    total = min(have[s][0] * goal[s][1] / share[s] for s in have)
    block = max(1, min(MAX_BLOCK, int(total / slots)))
    n_slots = int(total / block)
    k = max(1, -(-sum(n for _, n in have.values()) // BUCKET_DOCS))
    # running sums by source: totals of hash buckets first, then within buckets
    docs = docs.withColumn("b", (F.col("h") / F.lit(2.0**64) + 0.5) * k).withColumn("b", F.least(F.floor("b"), F.lit(k - 1)))
    base = docs.groupBy("source", "b").agg(F.sum("n_tokens").alias("t")).withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("source", "b", F.coalesce("base", F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(base, ["source", "b"]).select("doc_id", "source", "n_tokens", F.floor((F.col("base") + F.col("before")) / block).alias("block"))
    # the schedule
    point = (F.col("id") + 0.5) * GOLDEN % 1.0
    pick, cum = F.lit(None).cast("string"), 0.0
    bounds = []
    for s, w in share.items():
        cum += w
        bounds.append((cum, s))
    for c, s in reversed(bounds):
        pick = F.when(point < c, s).otherwise(pick) if (c, s) != bounds[-1] else F.lit(s)
    blocks = F.element_at(F.create_map(*[x for s in share for x in (F.lit(s), F.lit(-(-have[s][0] // block)))]), F.col("source"))
    most = F.element_at(F.create_map(*[x for s in share for x in (F.lit(s), F.lit(goal[s][1]))]), F.col("source"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    plan = spark.range(n_slots).select(F.col("id").alias("slot"), pick.alias("source")).withColumn("rank", rank).withColumn("blocks", blocks).select("slot", "source", (F.col("rank") % F.col("blocks")).cast("bigint").alias("block"), (F.floor(F.col("rank") / F.col("blocks")) + 1).cast("int").alias("use_no"), most.alias("most")).where("use_no <= most")
    return plan.join(placed, ["source", "block"]).select("slot", "source", "doc_id", "use_no", "n_tokens")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_uses, most_uses) of each target, also of those that got nothing."""
    got = mix.groupBy("source", "doc_id").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("t"), F.count(F.lit(1)).alias("u")).groupBy("source").agg(F.sum("t").alias("n_tokens"), F.sum("u").alias("n_uses"), F.max("u").alias("most_uses"))
    out = targets.select("source", "target_share").join(got, "source", "left").na.fill(0, ["n_tokens", "n_uses", "most_uses"])
    all_tokens = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # a row a source
    return out.select("source", "target_share", F.when(all_tokens > 0, F.col("n_tokens") / all_tokens).otherwise(0.0).alias("actual_share"), "n_tokens", "n_uses", "most_uses")

"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A token budget goes down a tree of domains, their languages and their sources by weight. A node can give at most what its
leaves hold, times the epochs allowed. Where a child can't use its part, the rest goes to its siblings in proportion to their
weights; only what a whole family can't use reaches the parent's siblings. Each leaf then reads its documents in a seeded
order, whole epochs first, and stops at the token where its budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that deal a leaf's documents into parts, so that no task has to order a whole leaf.
PART_DIGITS = 3


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, doc_id.cast("string")).cast("binary"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    named = F.lit(1.0)
    for name, weight in weights.get(level, {}).items():
        named = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(named)
    return named


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, held) with `budget`, the leaf's tokens.

    Among the children of a node in order of capacity / weight, let level_i be what is left for child i and those after it, per
    weight, once those before are full. The highest level is where the water stands: a child gets min(capacity, weight * it).
    """
    given = leaves.withColumn("capacity", F.col("held") * float(epochs)).withColumn("part", budget.cast("double"))
    for depth, level in enumerate(LEVELS):
        keys, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth]) or [F.lit(0)]
        nodes = given.groupBy(*keys).agg(F.sum("capacity").alias("room"), F.first("part").alias("share")).withColumn("weight", _weight(level, weights)).where("weight > 0")
        order = Window.partitionBy(*above).orderBy(F.col("room") / F.col("weight"), level)
        before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("level", (F.col("share") - before) / after)
        nodes = nodes.withColumn("got", F.least("room", F.col("weight") * F.max("level").over(Window.partitionBy(*above))))
        given = given.drop("part").join(nodes.select(*keys, F.greatest("got", F.lit(0.0)).alias("part")), keys)
    return given.select(*LEVELS, "held", F.floor(F.col("part") + 1e-3).cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float = 0.6, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, domain, lang, source, epoch, tokens, take): what the mix reads, a row for each document and epoch.

    The whole budget is `share` of all tokens (words). take is the tokens read of a document: all, but for the one in which its
    leaf's budget ends. Names without a weight weigh 1. Null domains, languages and sources are the name ''; documents without
    tokens are never read; rows that share an id follow each other in the order, and where a budget ends among them one is cut and
    later ones aren't read. The driver gets three numbers; leaves are joined by broadcast only if there are few.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))
    slim = common.saved(rows.drop("row").where("tokens > 0"), "slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("held"))
    whole = leaves.agg(F.sum("held")).head()[0] or 0
    plan = budgets(leaves, F.floor(F.lit(float(share)) * whole), weights, epochs).where("budget > 0")
    plan = common.saved(plan.withColumn("full", F.expr("budget div held")).withColumn("rest", F.col("budget") % F.col("held")), "plan")
    few = plan.count()

    # where each leaf's last epoch ends: first the part of the order, then the document in it
    keyed = slim.join(common.small_side(plan, few).select(*LEVELS, "full", "rest"), list(LEVELS)).where("rest > 0").withColumn("key", order_key(seed, F.col("full"), F.col("id")))
    keyed = keyed.withColumn("part", F.substring("key", 1, PART_DIGITS))
    parts = keyed.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"))
    parts = parts.withColumn("before", F.sum("size").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("size")).where("before < rest and before + size >= rest")
    last = keyed.join(parts.select(*LEVELS, "part", "before"), [*LEVELS, "part"])
    block = last.groupBy(*LEVELS, "part", "key").agg(F.sum("tokens").alias("size"), F.count("*").alias("end_rows"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    at = F.col("before") + F.sum("size").over(Window.partitionBy(*LEVELS, "part").orderBy("key")) - F.col("size")
    ends = block.withColumn("at", at).where("at < rest and at + size >= rest").select(*LEVELS, F.col("key").alias("end_key"), (F.col("rest") - F.col("at")).alias("end_take"), "end_rows")
    plan = common.saved(plan.join(ends, list(LEVELS), "left"), "ends")
    shared = plan.where("end_rows > 1").count()

    read = rows.where("tokens > 0").join(common.small_side(plan, few), list(LEVELS)).withColumn("key", order_key(seed, F.col("full"), F.col("id")))
    at_end = F.col("key") == F.col("end_key")
    whole = read.withColumn("extra", F.when(F.col("key") < F.col("end_key"), F.col("tokens")).when(at_end, F.least("tokens", "end_take")).otherwise(F.lit(0)))
    if shared:  # leaves that end among rows of one id: these follow each other, part by part, and one is cut
        among = F.coalesce(at_end & (F.col("end_rows") > 1), F.lit(False))
        cut = common.saved(read.where(among).withColumn("nth_part", F.spark_partition_id()), "cut")
        sizes = cut.groupBy(*LEVELS, "nth_part").agg(F.sum("tokens").alias("size"))
        sizes = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(*LEVELS).orderBy("nth_part")) - F.col("size")).drop("size")
        own = F.sum("tokens").over(Window.partitionBy(*LEVELS, "nth_part").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1))
        spent = F.col("before") + F.coalesce(own, F.lit(0))
        cut = cut.join(sizes, [*LEVELS, "nth_part"]).withColumn("extra", F.greatest(F.lit(0), F.least("tokens", F.col("end_take") - spent)))
        whole = whole.where(~among).unionByName(cut.select(whole.columns))
    turns = F.concat(F.expr("transform(sequence(0L, full), e -> struct(e AS epoch, IF(e < full, tokens, extra) AS take))"))
    return whole.select("row", *LEVELS, "tokens", F.inline(turns)).where("take > 0").select("row", *LEVELS, "epoch", "tokens", "take")

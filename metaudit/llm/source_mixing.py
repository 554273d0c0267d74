"""Mixing sources to target weights: temperature mixing as budgeted block permutations.

Weights are the sources' token shares to a power, normalised. The power is bisected (31 inner
points a round, one Spark job each) until the weights meet a target entropy, or until no
source is repeated more than a limit. Each source then gets a token budget. Whole epochs take
every document; the last, partial epoch takes blocks of documents in a permuted order until
the budget is met, and cuts one block at a document. Sums over blocks are taken in two steps,
so no source is one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaudit.llm.shared import saved
from metaudit.llm.texts import columns_of

POINTS, ROUNDS = 32, 6  # the power is found to 32**-6
SLOTS = 1024


def token_table(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = columns_of(docs, id_col, text_col, source_col)
    return source.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                         F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))


def figures(sources: DataFrame, total: int, powers: list[float]) -> list[dict]:
    """For each power: the sum of weights before they are normalised, entropy, and most repeats against the least."""
    p = F.col("t") / F.lit(float(total))
    a = F.col("power")
    rows = (sources.where("t > 0").select(p.alias("p"), F.explode(F.array(*[F.lit(x) for x in powers])).alias("power"))
            .groupBy("power").agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("s"),
                                  F.max(F.pow("p", a - 1)).alias("most"), F.min(F.pow("p", a - 1)).alias("least")).collect())
    return [{"power": r["power"], "z": r["z"], "entropy": math.log(r["z"]) - r["power"] * r["s"] / r["z"],
             "repeats": r["most"] / r["least"], "least": r["least"]} for r in sorted(rows, key=lambda r: r["power"])]


def find_power(sources: DataFrame, total: int, target_entropy: float | None, max_repeats: float | None) -> dict:
    """The smallest power in 0 to 1 whose entropy is at most the target, or whose repeats are at most the limit.

    Both fall as the power grows. If even power 1 does not meet the aim, 1 is taken.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        found = figures(sources, total, [low + (high - low) * k / POINTS for k in range(POINTS + 1)])
        good = [f["entropy"] <= target_entropy if target_entropy is not None else f["repeats"] <= max_repeats for f in found]
        first = good.index(True) if True in good else POINTS
        high, low = found[first]["power"], found[max(first - 1, 0)]["power"]
        if first == 0:
            break
    return figures(sources, total, [high])[0]


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                target_entropy: float | None = None, max_repeats: float | None = 4.0, budget: int | None = None,
                block_tokens: int = 1_000_000, seed: int = 7) -> DataFrame:
    """One row per document and use: id, source, n_tokens, weight, epoch, block, block_order, doc_order.

    Reading an epoch by (block_order, doc_order) gives the permutation. ``budget`` is the number
    of tokens wanted in all; without it, the least for which every source is taken at least
    once, so that no document is dropped. Tokens are words ``[^\\x20\\x09-\\x0D]+``. A null source
    counts as the empty one. Sources without tokens have weight 0 and their documents stand
    once; null ids and repeated rows are used like others. Rows that share an id are cut in the order of
    their tokens, so the plan does not depend on partitions. An empty table gives no rows.
    """
    rows = saved(token_table(docs, id_col, text_col, source_col))
    sources = saved(rows.groupBy("source").agg(F.sum("n_tokens").alias("t")))
    total = sources.agg(F.sum("t").alias("t")).collect()[0]["t"] or 0
    if total:
        found = find_power(sources, total, target_entropy, max_repeats)
        power, z = found["power"], found["z"]
        whole = float(budget) if budget is not None else total * z / found["least"]
    else:
        power, z, whole = 1.0, 1.0, 0.0
    share = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(total, 1))), F.lit(power)) / F.lit(z)).otherwise(0.0)
    # rounded, so that an exact number of epochs does not leave a sliver of another
    repeats = F.when(F.col("t") > 0, F.round(F.lit(whole) * F.col("weight") / F.col("t"), 9)).otherwise(1.0)
    plan = (sources.withColumn("weight", share).withColumn("repeats", repeats)
            .withColumn("epochs", F.floor("repeats").cast("int"))
            .withColumn("part", F.round((F.col("repeats") - F.col("epochs")) * F.col("t")).cast("long"))
            .withColumn("blocks", F.greatest(F.ceil(F.col("t") / block_tokens), F.lit(1)).cast("long")))

    dealt = (rows.join(plan, "source")
             .withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")))
             .withColumn("last_order", order_of("source", "block", "epochs", seed))
             .withColumn("doc_last", F.xxhash64("id", "epochs", F.lit(seed + 1))))
    # the partial epoch: tokens before each block, slots of the order first, then blocks in a slot
    sums = dealt.groupBy("source", "block", "last_order", "part").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("slot", F.shiftright(F.col("last_order"), 63 - 10))
    slots = sums.groupBy("source", "slot").agg(F.sum("n").alias("n"))
    before = (Window.unboundedPreceding, -1)
    slots = slots.select("source", "slot", F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("slot").rowsBetween(*before)), F.lit(0)).alias("base"))
    ahead = (sums.join(slots, ["source", "slot"])
             .withColumn("ahead", F.col("base") + F.coalesce(F.sum("n").over(
                 Window.partitionBy("source", "slot").orderBy("last_order", "block").rowsBetween(*before)), F.lit(0)))
             .select("source", "block", F.when(F.col("ahead") >= F.col("part"), 0)
                     .when(F.col("ahead") + F.col("n") <= F.col("part"), 2).otherwise(1).alias("take"), "ahead"))
    marked = dealt.join(ahead, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("doc_last", "id", "n_tokens").rowsBetween(*before)
    cut = (marked.where("take = 1").withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
           .withColumn("more", (F.col("ahead") < F.col("part")).cast("int")))
    sure = marked.where("take <> 1").withColumn("more", F.when(F.col("take") == 2, 1).otherwise(0))
    uses = sure.unionByName(cut).withColumn("uses", F.col("epochs") + F.col("more")).where("uses > 0")
    return (uses.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", "epoch", "block",
                    order_of("source", "block", "epoch", seed).alias("block_order"),
                    F.xxhash64("id", "epoch", F.lit(seed + 1)).alias("doc_order")))


def order_of(source: str, block: str, epoch: str, seed: int):
    """A block's place in an epoch: 63 bits."""
    return F.xxhash64(source, block, epoch, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))

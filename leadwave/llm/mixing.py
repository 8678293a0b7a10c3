"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadwave.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
_LEVEL = 3  # hexadecimal digits of the order key that one level of the search for a source's cut looks at


def ranked_weights(docs: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """(source, weight): the sources of `docs` by code point, a missing source last, weighing `cycle` over and over."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle_array = F.array(*(F.lit(w) for w in cycle))
    return docs.select("source").distinct().select("source", F.get(cycle_array, (rank % len(cycle)).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, ratio: tuple[int, int], max_epochs: int) -> DataFrame:
    """Targets of (source, source_size, weight): shares of ratio[0]/ratio[1] of all sizes by weight, none above `max_epochs`
    times its source; the excess goes to the others by weight until none is above.

    Every round is one small aggregation. Sums are whole numbers, so that targets do not depend on the order of addition.
    Raises ValueError when all sources together cannot hold the total.
    """
    up, down = ratio
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    if up * total > down * max_epochs * total:
        raise ValueError("the total exceeds what all sources hold at their maximum")
    clamped, share, state = F.lit(False), F.lit(0.0), None
    while True:
        held = F.coalesce(F.sum(F.when(clamped, F.col("source_size"))), F.lit(0))
        free = F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0))
        previous, state = state, tuple(sources.agg(held, free).first())
        if state == previous or not state[1]:
            break
        share = F.col("weight") * F.lit(float(up * total - down * max_epochs * state[0])) / F.lit(down * state[1])
        clamped = clamped | (share >= max_epochs * F.col("source_size"))
    return sources.withColumn("target", F.when(clamped, F.lit(float(max_epochs)) * F.col("source_size")).otherwise(share))


def mix_plan(docs: DataFrame, weights: DataFrame, ratio: tuple[int, int], max_epochs: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The slim rows (doc_id, source, size, order_key) of `docs` and, for each source, its target and its cut.

    A source is taken `whole` times, and the rows whose order key is at most `cut` once more. The order key is a seeded
    digest of id and text, so the extra rows are a random sample whose words come nearest to what is missing: within half
    of one document. The cut is found level by level: sums over 4096 buckets of the key, then inside the bucket on the
    edge, so no task ever sees more of a source than 4096 sums and the few rows of the last bucket.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = stash(docs.select("doc_id", "source", size.alias("size"), key.alias("order_key")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stash(sizes.join(weights, sizes["source"].eqNullSafe(weights["source"])).select(sizes["source"], "source_size", "weight"), "mix-sources")
    targets = water_fill(sources, ratio, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epochs))
    plan = stash(targets.withColumns({"left": F.col("target") - F.col("whole") * F.col("source_size"), "edge": F.lit("")}), "mix-targets")

    for digits in (_LEVEL, 2 * _LEVEL):
        rows = _of_edge(slim, plan)
        buckets = rows.groupBy("source", F.substring("order_key", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        reached = buckets.join(plan.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of"))).where(F.col("before") <= F.col("left"))
        last = reached.groupBy("of").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("last"))
        plan = plan.join(last, plan["source"].eqNullSafe(last["of"]), "left").select(
            "source", "source_size", "weight", "target", "whole",
            (F.col("left") - F.coalesce("last.before", F.lit(0))).alias("left"), F.coalesce("last.bucket", F.lit("")).alias("edge"))
        plan = stash(plan, "mix-level")

    rows = _of_edge(slim, plan).groupBy("source", "order_key").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("after", F.sum("size").over(upto))
    near = rows.join(plan.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of")))
    near = near.where(F.col("after") - F.col("size") / 2 <= F.col("left")).groupBy("of").agg(F.max("order_key").alias("last"))
    cuts = plan.join(near, plan["source"].eqNullSafe(near["of"]), "left")
    cut = F.when(F.col("target") > F.col("whole") * F.col("source_size"), F.coalesce("last", "edge")).otherwise(F.lit(""))
    return slim, stash(cuts.select("source", "source_size", "target", "whole", cut.alias("cut")), "mix-cuts")


def _of_edge(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows whose key begins as their source's edge does."""
    edges = plan.select(F.col("source").alias("of"), "edge")
    return slim.join(edges, slim["source"].eqNullSafe(edges["of"])).where(F.col("order_key").startswith(F.col("edge"))).select("source", "order_key", "size")


def take(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, taken) of slim rows. Empty documents are taken as often as any."""
    cuts = cuts.withColumnRenamed("source", "of")
    repeats = F.col("whole") + F.when(F.col("order_key") <= F.col("cut"), 1).otherwise(0)
    joined = rows.join(cuts, rows["source"].eqNullSafe(cuts["of"])).withColumn("repeats", repeats.cast("long"))
    return joined.select("doc_id", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), "order_key")


def mix(docs: DataFrame, weights: DataFrame, ratio: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """The mixed corpus: every row of `docs` as many times as it is taken, with the columns of `docs`.

    `weights` is (source, weight) with positive whole weights and one row a source; a missing source is a source of its own. Missing texts are
    empty and have no words. Rows equal in id and text are taken alike. An empty table gives an empty result.
    """
    _, cuts = mix_plan(docs, weights, ratio, max_epochs, seed)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    limits = cuts.select(F.col("source").alias("__of"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    joined = docs.join(limits, docs["source"].eqNullSafe(limits["__of"]))
    repeats = (F.col("__whole") + F.when(key <= F.col("__cut"), 1).otherwise(0)).cast("int")
    times = F.when(repeats > 0, F.sequence(F.lit(1), repeats)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("__time", F.explode(times)).select(*(docs[c] for c in docs.columns))

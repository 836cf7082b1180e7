"""Problem 7: mixing sources to target shares along a curriculum.

Every source has a weight schedule over the training w(t) = share * (1 + tilt * (2t - 1)), t from 0 to 1; tilts are centred so that the weights
of a mix always add up to 1, and a source's whole weight is its share. The integral of the schedule times the budget is the
demand for the source's tokens up to t; inverting it gives each document, whose place in its source's sequence is known by
a running sum of tokens, its time. Documents are range-sorted by time.

A source is repeated at most its capped number of times. What a source cannot give is asked of the others in proportion (again within
their caps); shares reached are reported.

Running sums are made in two steps, within hash buckets of a source and over the buckets, so no source is summed in one task.

Defined results: a source without documents gives nothing and is reported with share 0; null sources take no part; documents of no tokens
keep their place; equal hashes are ordered by id.
"""

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tolqyn.runtime import staged


def demands(targets: pd.DataFrame, supply: dict[str, int], budget: float) -> pd.DataFrame:
    """For the rows of one mix: tokens to take of each source; what one cannot give goes to the others by their shares."""
    out = targets.copy()
    out["supply"] = [int(supply.get(s, 0)) for s in out.source]
    out["most"] = out.supply * out.max_repeats.clip(lower=0)
    take = pd.Series(0.0, index=out.index)
    free = (out.most > 0) & (out.target_share > 0)
    left = budget
    while left > 1e-6 and free.any():
        ask = left * out.target_share.where(free, 0) / out.target_share[free].sum()
        give = pd.concat([ask, out.most - take], axis=1).min(axis=1).where(free, 0)
        take += give
        left -= float(give.sum())
        full = free & (take >= out.most - 1e-6)
        if not full.any():
            break
        free &= ~full
    out["take"] = take
    return out


def tilts(plan: pd.DataFrame, strength: float) -> list[float]:
    """A source repeated more often comes later; centred by the shares taken, within [-0.95, 0.95]."""
    total = plan["take"].sum() or 1.0
    share = plan["take"] / total
    often = (plan["take"] / plan["supply"].clip(lower=1)).rank()
    raw = (often - often.mean()) / max(1, len(plan))
    raw = raw - float((raw * share).sum()) / max(1e-12, float(share.sum()))
    top = float(raw.abs().max())
    return list(raw * (min(0.95, strength) / top if top else 0.0))


def mix(sized: DataFrame, targets: DataFrame, strength: float = 0.5, rows_per_bucket: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """sized: doc_id, source, tokens. targets: the table of target shares, which is small (a row per mix and source).

    Returns (the mixes: mix_name, at, doc_id, source, repeat_no, tokens, sorted by mix and time; the report by mix and source)."""
    spark = sized.sparkSession
    want = targets.toPandas()
    names = [str(s) for s in want.source.dropna().unique()]
    own = sized.where(F.col("source").isin(names))
    sums = {r.source: (r.tokens, r.n) for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    total = sized.agg(F.sum("tokens")).head()[0] or 0
    plans = []
    for _, rows in want.dropna(subset=["source"]).groupby("mix_name"):
        plan = demands(rows, {s: x[0] for s, x in sums.items()}, float(total) * float(rows.budget_share.iloc[0]))
        plan["tilt"] = tilts(plan, strength)
        plan["budget"] = plan["take"].sum()
        plans.append(plan)
    plan = pd.concat(plans) if plans else want.assign(supply=0, take=0.0, tilt=0.0, budget=0.0)
    plan["rounds"] = [math.ceil(t / s) if s else 0 for t, s in zip(plan["take"], plan["supply"])]
    plan["buckets"] = [1 + sums.get(s, (0, 0))[1] // rows_per_bucket for s in plan.source]
    cols = ["mix_name", "source", "target_share", "max_repeats", "supply", "take", "tilt", "budget", "rounds", "buckets"]
    known = spark.createDataFrame(plan[cols].astype({"target_share": float, "max_repeats": int, "supply": int, "take": float, "tilt": float, "budget": float, "rounds": int, "buckets": int}), "mix_name string, source string, target_share double, max_repeats bigint, supply bigint, take double, tilt double, budget double, rounds bigint, buckets bigint")

    rows = own.join(F.broadcast(known), "source").where("rounds > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("rounds").cast("int"))))
    h = F.xxhash64("doc_id", "repeat_no", "mix_name")
    rows = rows.withColumn("h", h).withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    group = ["mix_name", "source", "repeat_no"]
    by_bucket = rows.groupBy(*group, "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("mix_name", "source").orderBy("repeat_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*group, "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(by_bucket, [*group, "bucket"])
    middle = F.col("before") + F.col("here") + F.col("tokens") / 2
    u = middle / F.col("take")
    a = F.col("tilt")
    # demand(t) / take = t + a (t^2 - t); its inverse
    time = F.when(F.abs(a) < 1e-9, u).otherwise((-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u)) / (2 * a))
    placed = rows.where(middle <= F.col("take")).withColumn("at", F.round(time, 9))
    mixed = staged(placed.select("mix_name", "at", "doc_id", "source", "repeat_no", "tokens"), "mixed")
    done = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("repeat_no").alias("repeats"))
    all_ = mixed.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    report = (
        known.select("mix_name", "source", "target_share", "max_repeats").join(done, ["mix_name", "source"], "left").join(all_, "mix_name", "left")
        .select("mix_name", "source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("mix_tokens"), 6), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("mix_name", "at", "source", "doc_id", "repeat_no")
    return mixed.repartitionByRange(n, *order).sortWithinPartitions(*order), report

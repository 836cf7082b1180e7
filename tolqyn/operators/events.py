"""Windows over time, limits per client, expiry: batch forms."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    got = events.groupBy(F.window(ts, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, every: str, ts: str = "ts") -> DataFrame:
    got = events.groupBy(F.window(ts, length, every).alias("w")).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """A session ends when nothing comes for the gap."""
    got = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("session_start"), "n")


def over_limit(events: DataFrame, most: int, every: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Clients over a number of requests in a fixed window."""
    got = events.groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return got.select(key, F.col("w.start").alias("window_start"), "n")


def sliding_count(events: DataFrame, seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Of each event, how many of its client lie in the last so many seconds; the far end of the span is outside."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_at", at).withColumn("in_span", F.count("*").over(w)).drop("_at")


def ttl_state(puts: DataFrame, ttl: str, now: Column, most: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """What a cache of `most` entries holds at a time: the last put of each key within the time to live, newest first.
    The cut at `most` is the feature; it is a top-k, not a sort of everything."""
    last = puts.where(F.col(ts) <= now).groupBy(key).agg(F.max(ts).alias("put_at"))
    alive = last.where(F.col("put_at") + F.expr(f"interval {ttl}") > now)
    return alive.orderBy(F.desc("put_at"), key).limit(most)

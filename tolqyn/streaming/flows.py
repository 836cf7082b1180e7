"""Structured Streaming forms: windowed counts with late data, conversation state, expiring state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tolqyn.runtime import new_path


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; windows close once the watermark passes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    got = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("session_start"), "n")


def conversation_state(stream: DataFrame, most: int = 16, chars: int = 6000) -> DataFrame:
    """Per conversation, after each batch: messages kept and their characters. stream: conversation_id, at, role, text.

    State is bounded by the two budgets, whatever the length of the conversation."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in (state.get[0] if state.exists else [])]
        for pdf in pdfs:
            new = [(r.at.isoformat(), r.role, r.text or "") for r in pdf.itertuples() if r.role != "system"]
            kept = sorted([*kept, *new], key=lambda x: x[0])[-most:]
            while len(kept) > 1 and sum(len(x[2]) for x in kept) > chars:
                kept.pop(0)
        state.update(([list(x) for x in kept],))
        yield pd.DataFrame({"conversation_id": [key[0]], "kept": [len(kept)], "chars": [sum(len(x[2]) for x in kept)]})

    return stream.groupBy("conversation_id").applyInPandasWithState(step, "conversation_id string, kept int, chars int", "messages array<array<string>>", "update", GroupStateTimeout.NoTimeout)


def expiring_state(stream: DataFrame, ttl_ms: int = 7_200_000, late: str = "1 hour") -> DataFrame:
    """Per user: puts so far, ended by the watermark once nothing was put for the time to live."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "puts": [n], "expired": [True]})
            return
        n, last = state.get[0] if state.exists else 0, 0
        for pdf in pdfs:
            n += len(pdf)
            last = max(last, int(pdf.ts.max().timestamp() * 1000))
        state.update((n,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "puts": [n], "expired": [False]})

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, puts int, expired boolean", "n int", "update", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, into a table in the shared folder; each micro-batch writes a folder of its own, so a repeated batch replaces
    itself. In complete mode the result is the last batch, else all of them."""
    spark = df.sparkSession
    path = new_path(spark, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = query.lastProgress
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(path) if done else spark.createDataFrame([], df.schema.add("batch", "long"))
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).head()[0])
    return rows.drop("batch")

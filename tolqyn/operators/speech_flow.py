"""Cutting streams of answer text into sentences for speech, and keys under which answers are kept."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ready_sentences(text: Column, least: int = 20) -> Column:
    """Sentences in order; one shorter than `least` is put before the next; what is left at the end comes last."""
    parts = F.split(text, r"(?<=[.!?…])\s+")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc, p):
        now = F.trim(F.concat(acc["held"], F.lit(" "), p))
        done = F.length(now) >= least
        return F.struct(F.when(done, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"), F.when(done, F.lit("")).otherwise(now).alias("held"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))


def cache_key(question: Column, *context: Column) -> Column:
    """One key for questions that differ in case and spacing only, within the same context."""
    plain = F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))
    return F.sha2(F.concat_ws("\n", plain, *[F.coalesce(c.cast("string"), F.lit("-")) for c in context]), 256)


def preview(text: Column, most: int) -> Column:
    """One line of at most `most` characters, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def deltas(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, seq, kind, text): pieces of a text in order, then a row `done`; for a null text a row `error` alone."""
    n = F.ceil(F.length(text) / most).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col(text), i * most + 1, F.lit(most)).alias("text"))))
    end = F.array(F.struct(F.coalesce(n, F.lit(0)).alias("seq"), F.when(F.col(text).isNull(), "error").otherwise("done").alias("kind"), F.lit("").alias("text")))
    return rows.select(key, F.explode(F.concat(F.coalesce(parts, F.array().cast("array<struct<seq:int,kind:string,text:string>>")), end)).alias("d")).select(key, "d.*")

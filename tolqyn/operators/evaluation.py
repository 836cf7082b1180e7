"""Grades of answers: latest grade, verdict bands, blocks of statistics, histogram, heat map, ranking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tolqyn.operators.running import sum_before


def verdict(score: Column) -> Column:
    return F.when(score >= 70, "correct").when(score >= 40, "partial").otherwise("incorrect")


def latest_grades(grades: DataFrame) -> DataFrame:
    """One score per id, that of the latest grading, between 0 and 100; equal times: the larger score."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("graded_at"), F.desc_nulls_last("score"))
    one = grades.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return one.select("id", F.least(F.greatest("score", F.lit(0)), F.lit(100)).alias("score"))


def graded(pairs: DataFrame, grades: DataFrame) -> DataFrame:
    """All pairs with a score and verdict; no grade or no score counts 0."""
    rows = pairs.select("id", "subject", "grade", "lab").distinct().join(latest_grades(grades), "id", "left")
    rows = rows.withColumn("score", F.coalesce("score", F.lit(0)))
    return rows.withColumn("verdict", verdict(F.col("score")))


def stat_block() -> list[Column]:
    score = F.col("score")
    n = F.count("*")
    hits = {"correct": score >= 70, "partial": (score >= 40) & (score < 70), "incorrect": score < 40}
    out = [n.alias("n")] + [F.count_if(c).alias(k) for k, c in hits.items()]
    out.append(F.bround(F.avg("score"), 1).alias("avg_score"))
    out += [F.bround(F.count_if(c) * 100.0 / n, 1).alias(f"{k}_pct") for k, c in list(hits.items())[:2]]
    return out


def lenient(df: DataFrame) -> DataFrame:
    """Partial answers count half; from the rounded shares."""
    return df.withColumn("lenient_pct", F.col("correct_pct") + F.col("partial_pct") / 2)


def by_groups(rows: DataFrame) -> DataFrame:
    """Overall, by subject, by grade, by both and by lab in one pass."""
    sets = [[], ["subject"], ["grade"], ["subject", "grade"], ["subject", "grade", "lab"]]
    keys = [F.col(c) for c in ("subject", "grade", "lab")]
    got = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("level"), *stat_block())
    return lenient(got)


def histogram(rows: DataFrame) -> DataFrame:
    """Ten bins of ten points, empty ones too; 100 is in the last."""
    got = rows.groupBy(F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(rows: DataFrame) -> DataFrame:
    got = rows.groupBy("subject").pivot("grade", [7, 8, 9, 10, 11]).agg(F.bround(F.avg("score"), 1))
    return got.select("subject", *[F.col(str(g)).alias(f"grade_{g}") for g in range(7, 12)])


def weakest(rows: DataFrame, top: int = 10) -> DataFrame:
    """The labs of lowest average, ties by name."""
    labs = rows.where("subject is not null and grade is not null and lab is not null").groupBy("subject", "grade", "lab").agg(*stat_block())
    return labs.orderBy("avg_score", "subject", "grade", "lab").limit(top)


def strongest(rows: DataFrame, top: int = 10) -> DataFrame:
    labs = rows.where("subject is not null and grade is not null and lab is not null").groupBy("subject", "grade", "lab").agg(*stat_block())
    return labs.orderBy(F.desc("avg_score"), F.desc("subject"), F.desc("grade"), F.desc("lab")).limit(top)


def batches(pairs: DataFrame, size: int = 15) -> DataFrame:
    """Consecutive batches for judges, by the place of a pair in the order of ids. Places are counted within ranges of ids and over the ranges,
    so no task sees all pairs."""
    rows = pairs.select("id", "subject", "q", F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()
    rows = sum_before(rows.withColumn("one", F.lit(1)), [], F.floor(F.col("id") / 4096), ["id", "subject", "q", "expected", "answer"], "one", "before")
    return rows.withColumn("batch", F.floor(F.col("before") / size)).drop("one", "before")

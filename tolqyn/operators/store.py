"""The point store: predicates, visibility of generations, listings, deletion, activation."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INACTIVE = ("pending", "staging", "superseded")
LANGS = ("ru", "kk", "en")


def meta_filter(**fields) -> Column:
    """Equality on the fields that are not None; true if there are none."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in fields.items() if v is not None], F.lit(True))


def with_lang(base: Column, lang: str | None) -> Column:
    return base & (F.col("lang") == lang) if lang else base


def is_visible() -> Column:
    """Never null: inactive states are hidden; a row of a generation is visible while that is the active one, a row of none while none is."""
    generation, active = (F.when(F.col(c) != "", F.col(c)) for c in ("generation", "active_generation"))
    fits = F.when(generation.isNull(), active.isNull()).otherwise(F.coalesce(generation == active, F.lit(False)))
    return ~F.lower(F.coalesce("status", F.lit(""))).isin(*INACTIVE) & fits


def visible(points: DataFrame) -> DataFrame:
    return points.where(is_visible())


def unique_points(points: DataFrame, *columns: str) -> DataFrame:
    """Repeated rows once."""
    return points.select("collection", "point_id", *columns).distinct()


def list_documents(points: DataFrame) -> DataFrame:
    """Per document: pieces, and the first known value of each field in piece order."""
    fields = ("filename", "doc_type", "subject", "grade", "lang", "lab_number", "lab_id")
    rows = points.select("collection", "doc_id", "point_id", "chunk_index", F.coalesce("source_path", "source").alias("source_path"), *fields).distinct()
    order = F.struct("chunk_index", "point_id")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("source_path", *fields)]
    return rows.groupBy("collection", "doc_id").agg(F.count("*").alias("chunks"), *first)


def collection_status(points: DataFrame) -> DataFrame:
    """Points, documents and documents per language of every collection; a language without documents counts 0."""
    rows = points.select("collection", "point_id", "doc_id", "lang").distinct()
    counts = [F.count_distinct(F.when(F.col("lang") == x, F.col("doc_id"))).alias(f"documents_{x}") for x in LANGS]
    out = rows.groupBy("collection").agg(F.count_distinct("point_id").alias("points"), F.count_distinct("doc_id").alias("documents"), *counts)
    return out.withColumn("state", F.when(F.col("points") > 0, "ready").otherwise("empty"))


def generations(points: DataFrame) -> DataFrame:
    """Per document and generation: pieces there and expected, whether it is complete, and whether it is the active one."""
    rows = points.where("generation <> ''").select("collection", "doc_id", "generation", "active_generation", "chunk_index", "chunk_count").distinct()
    out = rows.groupBy("collection", "doc_id", "generation").agg(
        F.count_distinct("chunk_index").alias("pieces"), F.max("chunk_count").alias("expected"), F.max((F.col("generation") == F.col("active_generation")).cast("int")).alias("is_active")
    )
    return out.withColumn("complete", F.col("pieces") == F.col("expected"))


def generation_order(generation: Column) -> Column:
    """Orders names of generations as they are counted: g9 before g10; names without a number by themselves."""
    number = F.regexp_extract(generation, r"(\d+)$", 1)
    return F.struct(F.coalesce(number.try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")), generation)


def newest_complete(points: DataFrame) -> DataFrame:
    """(collection, doc_id, generation): of each document the newest generation all of whose pieces are there."""
    whole = generations(points).where("complete")
    return whole.groupBy("collection", "doc_id").agg(F.max_by("generation", generation_order(F.col("generation"))).alias("generation"))


def delete_documents(points: DataFrame, doomed: DataFrame) -> DataFrame:
    """Points that stay when the documents of doomed(doc_id) go."""
    return points.join(doomed.select("doc_id").distinct(), "doc_id", "left_anti")


def with_defaults(points: DataFrame) -> DataFrame:
    """Payload fields that follow from others where they are missing: source_path, source_type, file_type."""
    name = F.coalesce("filename", F.col("source_path"), F.col("source"))
    return points.select(
        "*", F.coalesce("source_path", "source").alias("_path"), F.coalesce("doc_type", F.lit("document")).alias("source_type"), F.coalesce("file_type", F.nullif(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)), F.lit(""))).alias("_type"),
    ).withColumns({"source_path": F.col("_path"), "file_type": F.col("_type")}).drop("_path", "_type")


def replace_generation(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """The store after an upload: of a document of which a complete generation was staged, the newest such one is active and all others
    are superseded. What was staged of an incomplete one waits as it is, and the document keeps the generation it had.

    staged: collection, doc_id, generation, chunk_index, chunk_count, and what else the store has."""
    new = newest_complete(staged.withColumn("active_generation", F.lit(None).cast("string"))).withColumnRenamed("generation", "_new")
    both = existing.unionByName(staged, allowMissingColumns=True).join(new, ["collection", "doc_id"], "left")
    order = F.when(F.col("_new").isNull(), F.lit(None)).otherwise(generation_order(F.col("generation")) > generation_order(F.col("_new")))
    status = F.when(F.col("_new").isNull() | F.coalesce(order, F.lit(False)), F.col("status")).when(F.col("generation") == F.col("_new"), "active").otherwise("superseded")
    return both.withColumn("status", status).withColumn("active_generation", F.coalesce("_new", "active_generation")).drop("_new")

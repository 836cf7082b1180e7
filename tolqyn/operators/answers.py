"""Citations and conversation history."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def citations(ranked: DataFrame, points: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per query and source document: pieces and pages as sorted sets, chapters and sections in the order of the hits, in
    order of first appearance. points may have chapter and section.

    ranked: (query, point_id, rank), cut at a top-k, so groups are small."""
    points = points.withColumns({c: F.lit(None).cast("string") for c in ("chapter", "section") if c not in points.columns})
    rows = ranked.select(query, "point_id", "rank").join(
        points.select("chapter", "section", "point_id", "doc_id", F.coalesce("source_path", "source").alias("source_path"), "filename", "doc_type", "lab_number", "chunk_index", "page_start", "page_end", "pages").distinct(), "point_id"
    )
    name = F.coalesce("filename", F.regexp_extract("source_path", r"[^/\\]+$", 0))
    rows = rows.withColumn("filename", name).where((F.col("filename") != "") & F.col("doc_id").isNotNull())
    every = F.flatten(F.collect_list(F.concat(F.coalesce("pages", F.array().cast("array<int>")), F.array("page_start", "page_end"))))

    def titles(c: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("rank", F.col(c).alias("t")))))
        return F.array_distinct(F.transform(found, lambda x: x["t"])).alias(f"{c}s")

    got = rows.groupBy(query, "doc_id", F.coalesce("source_path", "filename").alias("source")).agg(
        F.min_by("filename", "rank").alias("filename"), titles("chapter"), titles("section"), F.min("rank").alias("first_rank"), F.min_by("doc_type", "rank").alias("source_type"), F.min_by("lab_number", "rank").alias("lab_number"),
        F.array_sort(F.collect_set("chunk_index")).alias("chunk_indexes"), F.array_sort(F.array_distinct(F.array_compact(every))).alias("pages"),
    )
    w = Window.partitionBy(query).orderBy("first_rank")
    for c in ("chapter", "section"):  # a single one stands by itself too
        got = got.withColumn(c, F.when(F.size(f"{c}s") == 1, F.get(f"{c}s", 0)))
    return got.withColumn("number", F.row_number().over(w)).withColumn("page_from", F.array_min("pages")).withColumn("page_to", F.array_max("pages"))


def label(language: str = "ru") -> Column:
    """How a citation is shown: lab instruction with its number, else the file name without suffix; then its pages."""
    en = language == "en"
    number = F.when(F.col("lab_number").isNotNull(), F.concat(F.lit(" No. " if en else " №"), F.col("lab_number").cast("string"))).otherwise("")
    head = F.when(F.col("source_type") == "lab_instruction", F.concat(F.lit("Lab instruction" if en else "Инструкция к лабораторной работе"), number)).otherwise(F.regexp_replace("filename", r"\.[^.]+$", ""))
    span = F.when(F.col("page_from") != F.col("page_to"), F.concat(F.col("page_from").cast("string"), F.lit("-"), F.col("page_to").cast("string"))).otherwise(F.col("page_from").cast("string"))
    prefix = F.when(F.col("page_from") != F.col("page_to"), ", pp. ").otherwise(", p. ") if en else F.lit(", стр. ")
    return F.concat(head, F.when(F.col("page_from").isNotNull(), F.concat(prefix, span)).otherwise(""))


def knowledge(ranked: DataFrame, points: DataFrame, query: str = "query_id") -> DataFrame:
    """The numbered block of context of each query; blank texts fall out without changing the numbers."""
    rows = ranked.select(query, "point_id", "rank").join(points.select("point_id", "filename", "text").distinct(), "point_id").where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("filename", F.lit("?")), F.lit(")\n"), F.trim("text"))
    one = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return rows.groupBy(query).agg(F.array_join(F.transform(one, lambda x: x["b"]), "\n\n").alias("context"))


def messages(answers: DataFrame) -> DataFrame:
    """Messages of conversations, two for each answer; a repeated answer once. turn orders them."""
    rows = answers.where("conversation_id is not null").select("answer_id", "conversation_id", "created_at", "question", "answer").distinct()
    both = F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("half", "m")
    return rows.select("conversation_id", "answer_id", F.col("created_at").alias("at"), both).select("conversation_id", "answer_id", "at", "half", "m.*")


ORDER = ("at", "answer_id", "half")


def trim_history(rows: DataFrame, most: int = 16, chars: int = 6000) -> DataFrame:
    """The newest messages within a number and a sum of characters; the newest always. The first window is cut at `most` before the
    second, so a long conversation brings few rows to it."""
    newest = [F.desc_nulls_last("at"), F.desc("answer_id"), F.desc("half")]
    w = Window.partitionBy("conversation_id").orderBy(*newest)
    cut = rows.where("role <> 'system'").withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)
    total = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conversation_id").orderBy("back").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("used", total).where((F.col("back") == 1) | (F.col("used") <= chars))


def followup_query(rows: DataFrame, chars: int = 1200, most: int = 16) -> DataFrame:
    """Context of the last question of each conversation: earlier messages, newest first until the budget is used, the last one cut
    to its end, then the question itself as last line."""
    newest = [F.desc_nulls_last("at"), F.desc("answer_id"), F.desc("half")]
    users = rows.where("role = 'user' and text <> ''").groupBy("conversation_id").agg(F.max_by(F.struct("text", "at", "answer_id"), F.struct("at", "answer_id")).alias("q"))
    w = Window.partitionBy("conversation_id").orderBy(*newest)
    old = rows.join(users, "conversation_id").where("trim(text) <> ''").where(F.struct("at", "answer_id") < F.struct(F.col("q.at").alias("at"), F.col("q.answer_id").alias("answer_id")))
    old = old.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most).withColumn("t", F.trim("text"))
    used = F.coalesce(F.sum(F.length("t")).over(Window.partitionBy("conversation_id").orderBy("back").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    old = old.withColumn("room", chars - used).where("room > 0").withColumn("t", F.when(F.length("t") > F.col("room"), F.expr("right(t, cast(room as int))")).otherwise(F.col("t")))
    one = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "t")))
    ctx = old.groupBy("conversation_id").agg(F.array_join(F.transform(one, lambda x: x["t"]), "\n").alias("context"))
    return users.join(ctx, "conversation_id", "left").select("conversation_id", F.concat_ws("\n", "context", "q.text").alias("retrieval_query"))

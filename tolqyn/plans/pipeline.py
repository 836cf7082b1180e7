"""From documents to points of the store, and from a question to its context: the two ways through the engine."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tolqyn.functions.embedding import hashed
from tolqyn.operators import answers, chunking, quality, retrieval, store
from tolqyn.operators import understanding as u


def ingest(docs: DataFrame, collection: str, generation: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """Points of documents(doc_key, text, and metadata): usable pieces with ids, places, headings and vectors, staged as one generation.

    Ids follow from key, generation and number, so a second run makes the same points."""
    pieces = chunking.with_headings(docs.drop("section", "chapter"), size=size, overlap=overlap).where(quality.usable(F.col("chunk")))
    # pieces that are not usable leave no gap, as completeness is judged by their number
    of_doc = Window.partitionBy("doc_key")
    pieces = pieces.withColumns({"chunk_index": F.row_number().over(of_doc.orderBy("chunk_index")) - 1, "chunk_count": F.count("*").over(of_doc).cast("int")})
    name = F.concat_ws(":", "doc_key", F.lit(generation), F.col("chunk_index").cast("string"))
    rows = pieces.select(
        F.lit(collection).alias("collection"), chunking.uuid5(name).alias("point_id"), chunking.uuid5(F.col("doc_key")).alias("doc_id"), F.lit(generation).alias("generation"),
        F.lit(None).cast("string").alias("active_generation"), F.lit("staging").alias("status"), *[c for c in pieces.columns if c not in ("chunk", "doc_id", "file_id", "lab_id")], F.col("chunk").alias("text"),
    )
    return hashed(rows, "text")


def context(points: DataFrame, questions: DataFrame, top: int = 5, candidates: int = 20, k: int = 60) -> DataFrame:
    """questions(query_id, text): language, subject, and the numbered block of what was found for each. Questions without a hit keep their row."""
    seen = store.visible(points)
    asked = hashed(questions.select("query_id", "text"), "text")
    ranked = retrieval.rrf([retrieval.dense_topk(seen, asked, candidates), retrieval.sparse_topk(seen.select("point_id", "sparse_indices", "sparse_values").dropDuplicates(["point_id"]), asked, candidates)], k, top)
    found = answers.knowledge(ranked, seen)
    return questions.select("query_id", u.detect_language(F.col("text")).alias("language"), u.infer_subject(F.col("text")).alias("subject")).join(found, "query_id", "left")

"""Queries of the training-data operators, pN_... for problem N, and the SQL that some of them can be held against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolqyn.llm import abuse, language, mixing, packing, pairs, scans, splitting, tokens, vectors
from tolqyn.runtime import staged, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mutual(vectors.similar(table(spark, d, "chunks")))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every point of the documents whose id is divisible by 100, among all points of its collection."""
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("file_id").alias("doc_id"))
    points = table(spark, d, "chunks")
    return vectors.search(points, points.join(docs, "doc_id", "left_semi").select("point_id"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every point of chunks in pieces; a repeated point once."""
    cols = ("collection", "point_id", "doc_id", "generation", "chunk_index", "page_start", "page_end")
    points = table(spark, d, "chunks").select(*cols, "text")
    return splitting.split_texts(points).drop("text").distinct()


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each point give when their overlaps of 120 are taken off again, and whether every piece keeps the limit.
    The pieces of one point travel together, as its text does."""
    one = F.array_sort(F.collect_set(F.struct("piece_index", "piece")))
    got = p2_pieces(spark, d).groupBy("point_id").agg(one.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.when(x["piece_index"] == 0, x["piece"]).otherwise(F.substring(x["piece"], 121, 800))), "")
    longest = F.array_max(F.transform("p", lambda x: F.length(x["piece"])))
    return got.select("point_id", F.md5(text).alias("text_md5"), (longest <= 800).alias("within"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "chunks").select("point_id", "text")
    return splitting.split_texts(points).where("piece_count > 1").select("point_id").distinct()


P2_FOUND = r"""
SELECT DISTINCT point_id FROM chunks WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 800
"""

P2_REBUILT = r"""
WITH t AS (SELECT DISTINCT point_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM chunks)
SELECT point_id, md5(flat) AS text_md5, true AS within FROM t WHERE flat <> ''
"""


def p3_model(spark: SparkSession, d: str) -> language.Model:
    return language.fit(table(spark, d, "documents"), "doc_id", "text", "lang")


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document, manifest row and answer with its languages, their confidence and share of letters, and its segments. A
    manifest row has the text of its document; without one it has no row."""
    model = p3_model(spark, d)
    kept = ("langs", "confidences", "shares", "segments")
    docs = table(spark, d, "documents").select("doc_id", "doc_key", "text")
    docs = staged(language.assign_languages(docs, model).select("doc_id", "doc_key", "languages"), "document-languages")
    answers = table(spark, d, "answer_results").select("answer_id", "answer").distinct()
    answers = language.assign_languages(answers, model, "answer")
    keyed = docs.groupBy("doc_key").agg(F.min_by("languages", "doc_id").alias("languages"))
    manifest = table(spark, d, "upload_manifest").select("manifest_id", F.col("relative_path").alias("doc_key")).distinct().join(keyed, "doc_key")
    parts = [("document", "doc_id", docs), ("manifest", "manifest_id", manifest), ("answer", "answer_id", answers)]
    found = [p.select(F.lit(kind).alias("rec_kind"), F.col(key).alias("rec_id"), "languages.*").select("rec_kind", "rec_id", *kept) for kind, key, p in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    model = p3_model(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "doc_key", "lang", "text")
    docs = language.assign_languages(docs, model, segments=False).select("doc_id", "doc_key", F.col("lang").alias("label"), F.col("languages.langs").alias("langs"))
    docs = staged(docs, "document-languages")
    answers = table(spark, d, "answer_results").select("answer_id", F.col("language").alias("label"), "answer").distinct()
    answers = language.assign_languages(answers, model, "answer", segments=False)
    # a document collected twice has one text; a key is looked up once
    keyed = docs.groupBy("doc_key").agg(F.min_by("langs", "doc_id").alias("langs"))
    manifest = table(spark, d, "upload_manifest").select("manifest_id", F.col("relative_path").alias("doc_key"), F.col("lang").alias("label")).distinct()
    manifest = manifest.join(keyed, "doc_key")
    parts = [
        ("document", docs.select(F.col("doc_id").alias("rec_id"), "label", "langs")),
        ("manifest", manifest.select(F.col("manifest_id").alias("rec_id"), "label", "langs")),
        ("answer", answers.select(F.col("answer_id").alias("rec_id"), "label", F.col("languages.langs").alias("langs"))),
    ]
    found = [language.wrong_labels(p, F.col("langs"), F.col("label")).select(F.lit(kind).alias("rec_kind"), "rec_id", "lang") for kind, p in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "ocr_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.defects(p4_repaired(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective(table(spark, d, "eval_slim"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each reference and reply is copied from the question."""
    return pairs.coverage(table(spark, d, "eval_slim"))


def _p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    return staged(tokens.measured(table(spark, d, "documents").select("doc_id", "text"), curve=True), "document-sizes")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of every profile."""
    limits = [(r.profile, r.capacity_tokens) for r in table(spark, d, "pack_limits").collect()]  # three rows
    return packing.pack(_p6_sizes(spark, d), limits)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r.profile, r.capacity_tokens) for r in table(spark, d, "pack_limits").collect()]  # three rows
    sized = _p6_sizes(spark, d)
    return packing.fill_report(staged(packing.pack(sized, limits), "containers"), sized)


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = staged(tokens.measured(table(spark, d, "documents").select("doc_id", "source", "text")), "document-sizes")
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix in training order."""
    return _p7(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[1]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    model = abuse.fit(docs, table(spark, d, "review_labels"))
    return abuse.score_documents(docs, model).drop("text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(p8_scores(spark, d)).distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_neighbours": p1_neighbours,
        "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt,
        "p3_found": p3_found, "p3_languages": p3_languages,
        "p6_packed": p6_packed, "p6_fill": p6_fill,
        "p7_mixed": p7_mixed, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
        "p5_found": p5_found, "p5_coverage": p5_coverage,
        "p4_found": p4_found, "p4_repaired": p4_repaired,
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_rebuilt": P2_REBUILT}

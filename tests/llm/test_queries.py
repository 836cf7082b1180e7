import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, spark_rows, sql_rows
from tolqyn.llm import queries

SHAPES = {
    "p1_found": ["point_a", "point_b"], "p2_found": ["point_id"], "p3_found": ["rec_kind", "rec_id", "lang"], "p4_found": ["page_id", "defect"], "p5_found": ["id", "field", "defect"], "p8_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_over_the_tables(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in SHAPES:
        assert sorted(df.columns) == sorted(SHAPES[name])
        assert df.count() == df.distinct().count()
    elif name == "p1_neighbours":  # on the smallest tables the stated query set may hold no point
        docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 100 = 0").selectExpr("file_id AS doc_id")
        asked = spark.read.parquet(f"{data}/chunks.parquet").where("size(dense) > 0 and exists(dense, x -> x != 0)").join(docs, "doc_id", "left_semi")
        assert df.select("point").distinct().count() == asked.select("point_id").distinct().count()
    elif name == "p2_pieces":
        texts = spark.read.parquet(f"{data}/chunks.parquet").where("length(trim(text)) > 0").select("point_id").distinct().count()
        assert df.select("point_id").distinct().count() == texts
    elif name == "p2_rebuilt":
        assert df.count() > 0 and df.where("not within").count() == 0
    elif name == "p5_coverage":
        pairs = spark.read.parquet(f"{data}/eval_slim.parquet").select("id").distinct().count()
        assert df.count() == 2 * pairs and df.where("coverage not between 0 and 1").count() == 0 and df.where("coverage = 1").count() > 0
    elif name in ("p6_packed", "p7_mixed"):
        docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
        assert df.join(docs, "doc_id", "left_anti").count() == 0
        assert name == "p7_mixed" and df.count() > 0 or df.select("doc_id").distinct().count() == docs.count()
    elif name == "p6_fill":
        assert all(r.fullest <= r.capacity and r.containers >= r.least_containers and r.spread < 1 for r in df.collect())
    elif name == "p7_shares":
        assert all(0 <= r.actual_share <= 1 for r in df.collect())
    elif name == "p8_scores":
        docs = spark.read.parquet(f"{data}/documents.parquet")
        assert df.count() == docs.count() and df.where("abusive not between 0 and 1 or hateful not between 0 and 1 or sexual not between 0 and 1").count() == 0
    elif name == "p8_rates":
        docs = spark.read.parquet(f"{data}/documents.parquet")
        assert {r.source: r.documents for r in df.collect()} == {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    elif name == "p4_repaired":
        pages = spark.read.parquet(f"{data}/ocr_pages.parquet")
        assert df.count() == pages.select("page_id").distinct().count() and df.where("misread_char").count() > 0
    else:
        assert name == "p3_languages" and df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, data, name):
    assert spark_rows(queries.queries()[name](spark, data)) == sql_rows(connect(data), queries.oracle_sql()[name])


def test_languages_of_every_kind_of_record(spark, data):
    got = queries.p3_languages(spark, data)
    assert got.columns == ["rec_kind", "rec_id", "langs", "confidences", "shares", "segments"]
    seen = {r.rec_kind: r["n"] for r in got.groupBy("rec_kind").agg(F.count_distinct("rec_id").alias("n")).collect()}
    docs, manifest, answers = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "upload_manifest", "answer_results"))
    keyed = manifest.join(docs.select(F.col("doc_key").alias("relative_path")), "relative_path", "left_semi")
    want = {"document": docs.select("doc_id"), "manifest": keyed.select("manifest_id"), "answer": answers.select("answer_id")}
    assert seen == {k: v.distinct().count() for k, v in want.items()}
    assert got.where("rec_kind = 'answer' and size(langs) > 0 and size(segments) > 0 and size(confidences) = size(langs)").count() > 0

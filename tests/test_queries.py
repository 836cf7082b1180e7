"""Every registered query of the core against its SQL, on tables of scale 0.01; none may be empty."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, spark_rows, sql_rows
from tolqyn.operators import chunking, quality
from tolqyn.operators import understanding as u
from tolqyn.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    columns, rows = spark_rows(catalogue.queries()[name](spark, data))
    assert (columns, rows) == sql_rows(con, SQL[name])
    assert rows, "nothing was compared"


def rows_of(spark, data, name):
    return catalogue.queries()[name](spark, data).collect()


def test_keys_are_version_5_ids(spark, data):
    keys = {r.doc_id: r.doc_key for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "doc_key").collect()}
    name = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    assert {r.doc_id: r.key_uuid for r in rows_of(spark, data, "doc_uuid5")} == {i: uuid.uuid5(name, k).hex if k is not None else None for i, k in keys.items()}


def test_scope_gate_refuses_other_subjects(spark, data):
    got = {r.id: r.refusal for r in rows_of(spark, data, "scope_gate")}
    asked = spark.read.parquet(f"{data}/eval_slim.parquet").select("id", "subject", u.infer_subject(F.col("q")).alias("own"), u.is_procedure(F.col("q")).alias("step")).collect()
    assert set(got) == {r.id for r in asked} and set(got.values()) <= {"", *u.REFUSALS.values()}
    assert all(got[r.id] for r in asked if r.own and r.subject and r.own != r.subject and not r.step)
    assert not any(got[r.id] for r in asked if r.step or r.own and r.own == r.subject)


def test_language_of_a_conversation_is_of_one_of_its_questions(spark, data):
    got = {r.conversation_id: r.language for r in rows_of(spark, data, "language_by_conversation")}
    said: dict = {}
    a = spark.read.parquet(f"{data}/answer_results.parquet").where("conversation_id is not null").withColumn("l", u.detect_language(F.col("question"))).where("l is not null")
    for r in a.select("conversation_id", "created_at", "answer_id", "l").collect():
        said.setdefault(r.conversation_id, []).append(((r.created_at is not None, r.created_at, r.answer_id), r.l))
    assert got == {c: max(x)[1] for c, x in said.items()}


def test_numbers_are_spoken(spark, data):
    e = {r.id: r.expected or "" for r in spark.read.parquet(f"{data}/eval_slim.parquet").collect()}
    rows = rows_of(spark, data, "spoken_numbers")
    assert rows and all(r.spoken == e[r.id] for r in rows if not re.search(r"\d", e[r.id]))
    bare = [r for r in rows if re.search(r"(?<![\w.,:/+\-–—^−])\d+(?= [а-яa-z])", e[r.id])]
    assert bare and sum(r.spoken != e[r.id] for r in bare) > 0.9 * len(bare)


def test_sentences_give_the_answer_back(spark, data):
    a = spark.read.parquet(f"{data}/answer_results.parquet").select("answer_id", "answer").distinct().where("answer <> ''")
    got = {r.answer_id: r for r in rows_of(spark, data, "sentence_chunks")}
    lengths = {r.answer_id: len(" ".join(r.answer.split())) for r in a.collect()}
    assert set(got) <= set(lengths) and len(got) > 0.9 * len(lengths)
    assert all(1 <= r.longest <= lengths[i] + 1 and r.sentences <= 1 + lengths[i] / 20 + 1 for i, r in got.items())


def test_ingested_documents(spark, data):
    rows = rows_of(spark, data, "ingest_points")
    docs = quality_of(spark, data)
    assert len(rows) == docs and all(r.points == r.ids and r.vectors <= r.points for r in rows)


def quality_of(spark, data):
    """Documents with a usable piece."""
    docs = spark.read.parquet(f"{data}/documents.parquet").dropDuplicates(["doc_key"]).select("doc_key", "text")
    return chunking.chunks(docs).where(quality.usable(F.col("chunk"))).select("doc_key").distinct().count()


def test_questions_find_context(spark, data):
    asked = spark.read.parquet(f"{data}/eval_slim.parquet").where("id % 100 = 0").select("id").distinct().count()
    rows = rows_of(spark, data, "question_context")
    assert len(rows) == asked and sum((r.context_chars or 0) > 0 for r in rows) > 0.8 * asked


def test_contract(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_every_query_without_sql_is_tested():
    assert set(catalogue.queries()) - set(SQL) == {"spoken_numbers", "ingest_points", "question_context"}

"""python -m tolqyn.cli COMMAND: a corpus folder into a point store (a parquet folder), and what the store holds."""

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolqyn.functions import metadata
from tolqyn.operators import store
from tolqyn.plans import pipeline
from tolqyn.session import get_session
from tolqyn.sources import files


def corpus(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """doc_key, filename, metadata and text of the readable files below root."""
    found = files.corpus_files(spark, root, only)
    texts = files.plain_text(found).unionByName(files.container_text(files.sniffed(found).where("valid")).where("text is not null").select("relative_path", "text"))
    rows = texts.withColumn("m", metadata.parsed(F.col("relative_path")))
    return rows.select(
        F.col("relative_path").alias("doc_key"), F.element_at(F.split("relative_path", "/"), -1).alias("filename"), F.col("relative_path").alias("source_path"), F.col("relative_path").alias("source"),
        *[F.col(f"m.{c}").alias(c) for c in ("doc_type", "subject", "grade", "lang", "lab_number")], "text",
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Files by type, subject and language, with what is missing; labs that two files claim are told apart by claims > 1."""
    lab = metadata.lab_id(F.col("subject"), F.col("grade"), F.col("lang"), F.col("lab_number"))
    rows = docs.withColumn("lab_id", F.when(F.col("doc_type") == "lab_instruction", lab))
    claims = rows.where("lab_id is not null").groupBy("lab_id").agg(F.count("*").alias("claims"))
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("doc_type", "subject", "grade", "lang")]))
    return rows.join(claims, "lab_id", "left").select("doc_key", "doc_type", "subject", "grade", "lang", "lab_id", "claims", gone.alias("missing"), (F.length("text") < 200).alias("stub"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tolqyn")
    p.add_argument("command", choices=("ingest", "gen-manifest", "list", "status", "delete"))
    p.add_argument("--store", help="folder of the store")
    p.add_argument("--root", help="corpus folder")
    p.add_argument("--collection", default="labs_main")
    p.add_argument("--generation", default="g1")
    p.add_argument("--only", help="part of the path that files must have")
    p.add_argument("--doc-id", help="document to delete")
    p.add_argument("--out", help="folder for the manifest or for the store without the deleted document")
    a = p.parse_args(argv)
    spark = get_session("cli")
    if a.command == "ingest":
        files.upload(pipeline.ingest(corpus(spark, a.root, a.only), a.collection, a.generation), a.store)
        return 0
    if a.command == "gen-manifest":
        files.write_manifest(manifest(corpus(spark, a.root, a.only)), a.out)
        return 0
    points = spark.read.parquet(a.store)
    if a.command == "delete":
        gone = points.where(F.col("doc_id") == a.doc_id)
        if not gone.head(1):
            return 1
        files.write_store(store.delete_documents(points, gone).drop("bucket"), a.out)
        return 0
    seen = store.visible(points)
    report = store.collection_status(seen) if a.command == "status" else store.list_documents(seen.withColumn("lab_id", F.lit(None).cast("string"))).orderBy("collection", "doc_id")
    for row in report.toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())

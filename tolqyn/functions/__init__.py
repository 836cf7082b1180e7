"""Functions for SQL."""

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions of the engine as session functions, made of built-ins: rrf(rank, k), uuid5_hex(name), normal_text(text)."""
    made = {
        "rrf": "(rank_ INT, k INT) RETURNS DOUBLE RETURN 1.0D / (k + rank_)",
        "normal_text": r"(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '(?U)[\\s]+', ' '))",
        "verdict_of": "(score INT) RETURNS STRING RETURN CASE WHEN score >= 70 THEN 'correct' WHEN score >= 40 THEN 'partial' ELSE 'incorrect' END",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(made)

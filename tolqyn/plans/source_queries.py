"""Path metadata, upload checks and spoken numbers over the tables, with DuckDB counterparts where SQL can say it."""

from pyspark.sql import functions as F

from tolqyn.functions import metadata, speech
from tolqyn.operators import store
from tolqyn.runtime import table
from tolqyn.sources import files


ROOTS = {"": "", "books": "Школьный материал/", "labs": "corpus/Laboratory works/"}


def path_metadata(spark, d):
    """What the path of each document says as it is (below no known root: nothing), below the root of textbooks and below that of labs."""
    keys = table(spark, d, "documents").select("doc_key").distinct()
    parts = [keys.select("doc_key", F.lit(below).alias("below"), metadata.parsed(F.concat(F.lit(root), F.col("doc_key"))).alias("m")) for below, root in ROOTS.items()]
    fields = ("doc_type", "subject", "grade", "lang", "filename", "lab_number", "lab_id")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_key", "below", *[f"m.{c}" for c in fields])


def upload_identity(spark, d):
    """Source and key that an upload gets by its form, and the key it gets without one."""
    m = table(spark, d, "upload_manifest").distinct()
    form = [F.col(c) for c in ("filename", "doc_type", "subject", "grade", "lang", "lab_number")]
    return m.select("manifest_id", metadata.upload_identity(*form).alias("u"), metadata.general_upload_key(F.col("relative_path"), F.col("filename")).alias("general_key")).select("manifest_id", "u.*", "general_key")


def payload_defaults(spark, d):
    """Sources and types of points, taken from other fields where they are missing."""
    p = store.with_defaults(table(spark, d, "chunks").select("point_id", "filename", "source_path", "source", "file_type", "doc_type").distinct())
    return p.groupBy("source_type", "file_type").agg(F.count("*").alias("points"), F.count_if(F.col("source_path").isNull()).alias("without_path"))


def upload_caps(spark, d):
    """Uploads by job against the caps on files and characters; empty files are turned away."""
    m = table(spark, d, "upload_manifest").select("manifest_id", "job_id", F.col("relative_path").alias("doc_key")).distinct()
    sizes = table(spark, d, "documents").groupBy("doc_key").agg(F.max("n_chars").alias("n"))
    got = m.join(sizes, "doc_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return files.batch_caps(got, "job_id", "n", most_files=100, most_total=200_000, most_file=20_000)


def bulk_summary(spark, d):
    """A folder's documents by what became of them and by language."""
    return files.bulk_summary(table(spark, d, "documents").select("doc_key", "subject", "lang", "text"))


def question_errors(spark, d):
    a = table(spark, d, "answer_results").select("answer_id", "question").distinct()
    return a.select("answer_id", F.array_join(metadata.question_errors(F.col("question"), 80), "; ").alias("errors")).where("errors <> ''")


def option_chars(spark, d):
    """Characters of all values of the options of a job."""
    j = table(spark, d, "jobs").select("id", "options_json").distinct().withColumn("o", F.from_json("options_json", "map<string,string>"))
    return j.select("id", metadata.content_chars(F.col("o")).alias("chars"))


def upload_validation(spark, d):
    m = table(spark, d, "upload_manifest").distinct()
    found = metadata.upload_errors(*[F.col(c) for c in ("doc_type", "subject", "grade", "lang", "lab_number")])
    return m.select("manifest_id", F.size(found).alias("errors"), F.array_join(found, "; ").alias("text"), metadata.safe_path(F.col("relative_path"), F.col("filename")).alias("safe"))


def spoken_numbers(spark, d):
    rows = table(spark, d, "eval_slim").select("id", "language", F.coalesce("expected", F.lit("")).alias("t"))
    parts = [rows.where(F.coalesce("language", F.lit("ru")) == x).select("id", F.lit(x).alias("lang"), speech.speak_numbers(F.col("t"), x).alias("spoken")) for x in ("ru", "kk", "en")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (path_metadata, upload_validation, upload_identity, payload_defaults, upload_caps, bulk_summary, question_errors, option_chars, spoken_numbers)}

SQL = {
    "path_metadata": r"""WITH k AS (SELECT DISTINCT doc_key, string_split(lower(doc_key), '/') AS p FROM documents), n AS (SELECT *, unnest(['', 'books', 'labs']) AS below FROM k),
        g AS (SELECT *, list_filter(list_transform(regexp_extract_all(CASE below WHEN 'labs' THEN array_to_string(p[:-2], '/') ELSE lower(doc_key) END, '(\d{1,2})', 1), lambda x: x::INT), lambda x: x BETWEEN 7 AND 11)[1] AS gr,
          CASE WHEN p[1] IN ('physics', 'chemistry', 'biology') THEN p[1] END AS su, CASE WHEN list_contains(p, 'en') THEN 'en' END AS la, nullif(regexp_extract(regexp_replace(p[-1], '\.[^.]+$', ''), '(\d{1,2})', 1), '')::INT AS nu FROM n)
        SELECT doc_key, below, CASE below WHEN 'books' THEN 'textbook' WHEN 'labs' THEN 'lab_instruction' END AS doc_type, CASE WHEN below <> '' THEN su END AS subject, CASE WHEN below <> '' THEN gr END AS grade, CASE WHEN below <> '' THEN la END AS lang,
        CASE WHEN below <> '' THEN string_split(doc_key, '/')[-1] END AS filename, CASE below WHEN 'labs' THEN nu END AS lab_number, CASE WHEN below = 'labs' AND su IS NOT NULL AND gr IS NOT NULL AND la IS NOT NULL AND nu IS NOT NULL THEN printf('%s-%d-%s-%02d', su, gr, la, nu) END AS lab_id FROM g""",
    "upload_identity": """WITH m AS (SELECT DISTINCT * FROM upload_manifest), e AS (SELECT *, lower(trim(doc_type)) AS k, lower(trim(subject)) AS s, lower(trim(lang)) AS l FROM m),
        f AS (SELECT *, coalesce(k IN ('textbook', 'lab_instruction') AND s IN ('physics', 'chemistry', 'biology') AND l IN ('ru', 'kk', 'en') AND grade BETWEEN 7 AND 11 AND CASE k WHEN 'textbook' THEN lab_number IS NULL ELSE lab_number BETWEEN 1 AND 99 END AND trim(filename) <> '', false) AS ok,
          CASE WHEN lab_number IS NOT NULL THEN lpad(lab_number::VARCHAR, 2, '0') END AS nn FROM e),
        r AS (SELECT *, CASE WHEN ok AND k = 'lab_instruction' THEN s || '-' || grade || '-' || l || '-' || nn END AS lab, CASE WHEN ok THEN 'admin_uploads/' || k || '/' || s || '/' || grade || '/' || l || CASE k WHEN 'lab_instruction' THEN '/' || nn ELSE '' END || '/' || trim(filename) END AS src FROM f)
        SELECT manifest_id, src AS source, CASE WHEN lab IS NOT NULL THEN 'admin_uploads/lab_instruction/' || lab ELSE src END AS doc_key, lab AS lab_id,
        CASE WHEN NOT starts_with(relative_path, '/') AND NOT regexp_matches(relative_path, '(^|/)\\.\\.(/|$)') AND string_split(relative_path, '/')[-1] = filename AND relative_path <> filename THEN 'admin_uploads/general/' || relative_path END AS general_key FROM r""",
    "payload_defaults": r"""WITH p AS (SELECT DISTINCT point_id, filename, coalesce(source_path, source) AS source_path, source, coalesce(file_type, nullif(lower(regexp_extract(coalesce(filename, source_path, source), '\.([^./]+)$', 1)), '')) AS file_type, coalesce(doc_type, 'document') AS source_type FROM (SELECT DISTINCT point_id, filename, source_path, source, file_type, doc_type FROM chunks) t)
        SELECT source_type, file_type, count(*) AS points, count(*) FILTER (WHERE source_path IS NULL) AS without_path FROM p GROUP BY ALL""",
    "upload_caps": """WITH m AS (SELECT DISTINCT manifest_id, job_id, relative_path FROM upload_manifest), s AS (SELECT doc_key, max(n_chars) AS n FROM documents GROUP BY doc_key), x AS (SELECT job_id, coalesce(n, 0) AS n FROM m LEFT JOIN s ON s.doc_key = m.relative_path)
        SELECT job_id, count(*) AS files, sum(n)::BIGINT AS total, count(*) FILTER (WHERE n = 0) AS empty_files, count(*) FILTER (WHERE n > 20000) AS large_files, count(*) > 100 OR sum(n) > 200000 OR count(*) FILTER (WHERE n > 20000) > 0 AS refused FROM x GROUP BY job_id""",
    "bulk_summary": r"""WITH x AS (SELECT lang, CASE WHEN subject IS NULL THEN 'skipped' WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 'empty' ELSE 'ready' END AS s FROM documents)
        SELECT lang, count(*) AS total, count(*) FILTER (WHERE s = 'ready') AS ready, count(*) FILTER (WHERE s = 'empty') AS empty, count(*) FILTER (WHERE s = 'skipped') AS skipped FROM x GROUP BY GROUPING SETS ((lang), ())""",
    "question_errors": "SELECT answer_id, CASE WHEN trim(coalesce(question, '')) = '' THEN 'question is blank' ELSE 'question is too long' END AS errors FROM (SELECT DISTINCT answer_id, question FROM answer_results) t WHERE trim(coalesce(question, '')) = '' OR length(question) > 80",
    "option_chars": "SELECT id, coalesce(list_sum(list_transform(json_keys(options_json), lambda k: length(coalesce(json_extract_string(options_json, '$.\"' || k || '\"'), '')))), 0)::BIGINT AS chars FROM (SELECT DISTINCT id, options_json FROM jobs) t",
    "upload_validation": """WITH m AS (SELECT DISTINCT * FROM upload_manifest), e AS (SELECT *, list_filter([CASE WHEN doc_type IS NULL THEN 'doc_type is required' END, CASE WHEN lower(trim(doc_type)) NOT IN ('textbook', 'lab_instruction') THEN 'doc_type is unknown' END,
        CASE WHEN subject IS NULL OR grade IS NULL OR lang IS NULL THEN 'subject, grade and lang are required' END, CASE WHEN lower(trim(subject)) NOT IN ('physics', 'chemistry', 'biology') THEN 'subject is unknown' END, CASE WHEN lower(trim(lang)) NOT IN ('ru', 'kk', 'en') THEN 'lang is unknown' END,
        CASE WHEN grade NOT BETWEEN 7 AND 11 THEN 'grade must be 7 to 11' END, CASE WHEN lower(trim(doc_type)) = 'textbook' AND lab_number IS NOT NULL THEN 'a textbook has no lab_number' END,
        CASE WHEN lower(trim(doc_type)) = 'lab_instruction' AND lab_number IS NULL THEN 'lab_number is required' END, CASE WHEN lab_number NOT BETWEEN 1 AND 99 THEN 'lab_number must be 1 to 99' END], lambda x: x IS NOT NULL) AS f,
        doc_type IS NOT NULL OR subject IS NOT NULL OR grade IS NOT NULL OR lang IS NOT NULL OR lab_number IS NOT NULL AS given FROM m)
        SELECT manifest_id, CASE WHEN given THEN len(f) ELSE 0 END AS errors, CASE WHEN given THEN array_to_string(f, '; ') ELSE '' END AS text, coalesce(NOT starts_with(relative_path, '/') AND NOT regexp_matches(relative_path, '(^|/)\\.\\.(/|$)') AND string_split(relative_path, '/')[-1] = filename, false) AS safe FROM e""",
}

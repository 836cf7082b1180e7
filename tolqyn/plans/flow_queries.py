"""Answer streams, keys, options, transitions, set operations and streaming forms, with DuckDB counterparts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tolqyn.operators import speech_flow, store, understanding as u
from tolqyn.plans import pipeline
from tolqyn.runtime import staged, table
from tolqyn.streaming import flows


def sentence_chunks(spark, d):
    a = table(spark, d, "answer_results").select("answer_id", "answer").distinct().where("answer <> ''")
    got = a.select("answer_id", F.posexplode(speech_flow.ready_sentences(F.col("answer"))).alias("seq", "sentence"))
    return got.groupBy("answer_id").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


def answer_cache(spark, d):
    """Questions that a cache would answer again: asked more than once in one lab."""
    a = table(spark, d, "answer_results").select("answer_id", "question", "lab_id").distinct().where("question is not null")
    return a.groupBy(speech_flow.cache_key(F.col("question"), F.col("lab_id")).alias("key")).agg(F.count("*").alias("asked"), F.min("answer_id").alias("first_id")).where("asked > 1")


def answer_previews(spark, d):
    a = table(spark, d, "answer_results").select("answer_id", "answer").distinct().where("answer is not null")
    return a.select("answer_id", speech_flow.preview(F.col("answer"), 60).alias("preview"))


def answer_deltas(spark, d):
    """Answers as a client gets them: pieces of at most 80 characters in order, then the end; an error where there is no answer."""
    a = table(spark, d, "answer_results").select("answer_id", "answer").distinct()
    got = speech_flow.deltas(a, "answer_id", "answer", 80)
    return got.groupBy("answer_id", "kind").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"), F.max("seq").alias("last_seq"))


def job_options(spark, d):
    """Jobs by the options they were given; trusted keys are no options."""
    o = F.map_filter(F.from_json("options_json", "map<string,string>"), lambda k, v: ~k.isin("root", "stored_path", "worker_id") & v.isNotNull())
    j = table(spark, d, "jobs").select("id", "kind", "options_json").distinct().withColumn("o", o)
    return j.groupBy("kind", F.col("o")["assistant_type"].alias("assistant_type")).agg(F.count("*").alias("jobs"))


def item_metadata(spark, d):
    """Metadata written with items against their manifest rows."""
    i = table(spark, d, "job_items").select("id", "relative_path", F.from_json("metadata_json", "subject string, grade int, lang string").alias("m")).where("m is not null").distinct()
    m = table(spark, d, "upload_manifest").select("relative_path", F.col("subject").alias("m_subject"), F.col("grade").alias("m_grade")).distinct()
    both = i.select("id", "relative_path", "m.subject", "m.grade").join(m, "relative_path")
    same = (F.col("subject").eqNullSafe(F.col("m_subject")) & F.col("grade").eqNullSafe(F.col("m_grade"))).cast("int")
    return both.groupBy("subject").agg(F.count("*").alias("pairs"), F.sum(same).alias("same"))


def missing_metadata(spark, d):
    m = table(spark, d, "upload_manifest").distinct()
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("subject", "grade", "lang")], F.when((F.col("doc_type") == "lab_instruction") & F.col("lab_number").isNull(), F.lit("lab_number"))))
    return m.select("manifest_id", F.array_join(gone, ",").alias("missing")).where("missing <> ''")


def item_transitions(spark, d):
    """How items went from record to record: pairs of states that follow each other."""
    i = table(spark, d, "job_items").select("id", "status", "stage", "recorded_at").distinct()
    w = Window.partitionBy("id").orderBy("recorded_at", "status", "stage")
    return i.withColumn("before", F.lag("status").over(w)).groupBy("before", F.col("status").alias("after")).agg(F.count("*").alias("n"))


def idle_gaps(spark, d):
    """Pauses of a user of at least three hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("gap", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)))
    return e.where("gap >= 10800000000").groupBy("user_id").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest_us"))


def term_overlap(spark, d):
    """Topic keys that a question shares with its expected answer."""
    e = table(spark, d, "eval_slim").select("id", u.scope_terms(F.col("q")).alias("a"), u.scope_terms(F.coalesce("expected", F.lit(""))).alias("b"))
    return e.select("id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("all_terms"), F.size(F.array_except("a", "b")).alias("only_question"))


def theory_and_lab(spark, d):
    """Lab instructions and textbooks of a subject as one ordered list of documents, instructions first."""
    c = table(spark, d, "chunks").select("doc_id", "doc_type", "subject", "filename").distinct()
    both = c.where("doc_type = 'lab_instruction'").select(F.lit(0).alias("branch"), "subject", "doc_id", "filename").unionAll(c.where("doc_type = 'textbook'").select(F.lit(1), "subject", "doc_id", "filename"))
    w = Window.partitionBy("subject").orderBy("branch", "filename", "doc_id")
    return both.where("subject is not null").withColumn("place", F.row_number().over(w)).select("subject", "branch", "doc_id", "place")


def ingest_points(spark, d):
    """All documents through cutting, gating, naming and embedding; what became of each."""
    docs = table(spark, d, "documents").select("doc_key", "lang", "subject", "grade", "text").dropDuplicates(["doc_key"])
    got = pipeline.ingest(docs, "fresh", "g1")
    return got.groupBy("doc_id").agg(F.count("*").alias("points"), F.count_distinct("point_id").alias("ids"), F.count_if(F.size("dense") == 64).alias("vectors"), F.sum(F.size("sparse_indices")).alias("terms"))


def question_context(spark, d):
    """Every hundredth question against the points made of all documents."""
    docs = table(spark, d, "documents").select("doc_key", "doc_type", "text").dropDuplicates(["doc_key"]).withColumn("filename", F.regexp_extract("doc_key", "[^/]+$", 0))
    new = staged(pipeline.ingest(docs, "fresh", "g1"), "points")
    points = staged(store.replace_generation(new.limit(0), new), "points")  # searched three times
    asked = table(spark, d, "eval_slim").where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("q").alias("text")).distinct()
    got = pipeline.context(points, asked)
    return got.select("query_id", "language", "subject", F.length("context").alias("context_chars"))


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, df, mode):
    return flows.run_once(df, "events", mode)


def stream_tumbling(spark, d):
    return _run(spark, flows.windowed_counts(_stream(spark, d)), "complete")


def stream_user_state(spark, d):
    """Puts per user as kept by the stateful operator."""
    got = _run(spark, flows.expiring_state(_stream(spark, d)), "update")
    return got.where("not expired").groupBy("user_id").agg(F.max("puts").alias("puts"))


QUERIES = {f.__name__: f for f in (
    sentence_chunks, answer_deltas, answer_cache, answer_previews, job_options, item_metadata, missing_metadata, item_transitions, idle_gaps, term_overlap, theory_and_lab, ingest_points, question_context, stream_tumbling, stream_user_state,
)}

TERMS = r"""list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower({0}), 'ё', 'е'), '\p{{L}}+'), lambda x: length(x) >= 4 AND NOT regexp_matches(x, {1})), lambda x: CASE WHEN regexp_matches(x, '[а-яәғқңөұүһі]') THEN substring(x, 1, 3) ELSE substring(x, 1, 4) END))"""
GENERIC = "'^(" + "|".join(u.GENERIC_STEMS) + ")'"

SQL = {
    "sentence_chunks": r"""WITH RECURSIVE a AS (SELECT DISTINCT answer_id, answer FROM answer_results WHERE answer <> ''), p AS (SELECT answer_id, string_split(regexp_replace(answer, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM a),
        f AS (SELECT answer_id, parts, 0 AS i, '' AS held, []::VARCHAR[] AS got FROM p UNION ALL
          SELECT answer_id, parts, i + 1, CASE WHEN length(now) >= 20 THEN '' ELSE now END, CASE WHEN length(now) >= 20 THEN list_append(got, now) ELSE got END FROM (SELECT *, trim(held || ' ' || parts[i + 1]) AS now FROM f WHERE i < len(parts)) t),
        s AS (SELECT answer_id, unnest(CASE WHEN held <> '' THEN list_append(got, held) ELSE got END) AS x FROM f WHERE i = len(parts))
        SELECT answer_id, count(*) AS sentences, max(length(x)) AS longest FROM s GROUP BY answer_id""",
    "answer_deltas": """WITH a AS (SELECT DISTINCT answer_id, answer, ceil(length(answer) / 80.0)::BIGINT AS k FROM answer_results)
        SELECT answer_id, 'delta' AS kind, k AS rows, length(answer)::BIGINT AS chars, k - 1 AS last_seq FROM a WHERE k > 0 UNION ALL SELECT answer_id, CASE WHEN answer IS NULL THEN 'error' ELSE 'done' END, 1, 0, coalesce(k, 0) FROM a""",
    "answer_cache": r"""SELECT sha256(lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) || chr(10) || coalesce(lab_id, '-')) AS key, count(*) AS asked, min(answer_id) AS first_id FROM (SELECT DISTINCT answer_id, question, lab_id FROM answer_results WHERE question IS NOT NULL) t GROUP BY key HAVING count(*) > 1""",
    "answer_previews": r"""SELECT answer_id, CASE WHEN length(f) > 60 THEN rtrim(substring(f, 1, 59)) || '…' ELSE f END AS preview FROM (SELECT DISTINCT answer_id, answer, trim(regexp_replace(answer, '\s+', ' ', 'g')) AS f FROM answer_results WHERE answer IS NOT NULL) t""",
    "job_options": "SELECT kind, options_json ->> '$.assistant_type' AS assistant_type, count(*) AS jobs FROM (SELECT DISTINCT id, kind, options_json FROM jobs) t GROUP BY ALL",
    "item_metadata": """WITH i AS (SELECT DISTINCT id, relative_path, metadata_json ->> '$.subject' AS subject, (metadata_json ->> '$.grade')::INT AS grade, metadata_json ->> '$.lang' AS lang FROM job_items WHERE metadata_json IS NOT NULL), m AS (SELECT DISTINCT relative_path, subject AS s, grade AS g FROM upload_manifest)
        SELECT subject, count(*) AS pairs, sum((subject IS NOT DISTINCT FROM s AND grade IS NOT DISTINCT FROM g)::INT)::BIGINT AS same FROM i JOIN m USING (relative_path) GROUP BY subject""",
    "missing_metadata": """WITH a AS (SELECT manifest_id, array_to_string(list_filter([CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN grade IS NULL THEN 'grade' END, CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN doc_type = 'lab_instruction' AND lab_number IS NULL THEN 'lab_number' END], lambda x: x IS NOT NULL), ',') AS missing FROM (SELECT DISTINCT * FROM upload_manifest) t)
        SELECT * FROM a WHERE missing <> ''""",
    "item_transitions": "WITH i AS (SELECT DISTINCT id, status, stage, recorded_at FROM job_items), l AS (SELECT status, lag(status) OVER (PARTITION BY id ORDER BY recorded_at NULLS FIRST, status NULLS FIRST, stage NULLS FIRST) AS before FROM i) SELECT before, status AS after, count(*) AS n FROM l GROUP BY ALL",
    "idle_gaps": "WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT user_id, count(*) AS gaps, max(gap) AS longest_us FROM g WHERE gap >= 10800000000 GROUP BY user_id",
    "term_overlap": f"WITH t AS (SELECT id, {TERMS.format('q', GENERIC)} AS a, {TERMS.format(chr(99) + 'oalesce(expected, ' + chr(39) * 2 + ')', GENERIC)} AS b FROM eval_slim) SELECT id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS all_terms, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_question FROM t",
    "theory_and_lab": """WITH c AS (SELECT DISTINCT doc_id, doc_type, subject, filename FROM chunks WHERE subject IS NOT NULL), b AS (SELECT CASE doc_type WHEN 'lab_instruction' THEN 0 ELSE 1 END AS branch, subject, doc_id, filename FROM c WHERE doc_type IN ('lab_instruction', 'textbook'))
        SELECT subject, branch, doc_id, row_number() OVER (PARTITION BY subject ORDER BY branch, filename NULLS FIRST, doc_id) AS place FROM b""",
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_user_state": "SELECT user_id, count(*) AS puts FROM events GROUP BY user_id",
}

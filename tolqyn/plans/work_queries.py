"""Evaluation, job queue, event and relational queries, with DuckDB counterparts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tolqyn.operators import evaluation, events, jobs, store
from tolqyn.plans.store_queries import VISIBLE
from tolqyn.runtime import table


def _graded(spark, d):
    return evaluation.graded(table(spark, d, "eval_slim"), table(spark, d, "grades"))


def eval_left_join_default(spark, d):
    return _graded(spark, d).select("id", "score", "verdict")


def stat_block(spark, d):
    return evaluation.lenient(_graded(spark, d).groupBy("subject").agg(*evaluation.stat_block()))


def eval_grouping_sets(spark, d):
    return evaluation.by_groups(_graded(spark, d)).drop("level")


def score_histogram(spark, d):
    return evaluation.histogram(_graded(spark, d))


def heatmap_pivot(spark, d):
    return evaluation.heatmap(_graded(spark, d))


def weakest_groups(spark, d):
    return evaluation.weakest(_graded(spark, d)).select("subject", "grade", "lab", "n", "avg_score")


def strongest_groups(spark, d):
    return evaluation.strongest(_graded(spark, d)).select("subject", "grade", "lab", "n", "avg_score")


def verdict_bands(spark, d):
    """Bands that follow from scores against verdicts as written."""
    g = table(spark, d, "grades").distinct()
    return g.groupBy(evaluation.verdict(F.least(F.greatest("score", F.lit(0)), F.lit(100))).alias("band"), F.lower(F.trim("verdict")).alias("written")).agg(F.count("*").alias("n"))


def eval_batches(spark, d):
    return evaluation.batches(table(spark, d, "eval_slim")).groupBy("batch").agg(F.count("*").alias("pairs"), F.min("id").alias("first_id"), F.sum(F.length("answer")).alias("answer_chars"))


def _items(spark, d):
    return jobs.latest_items(table(spark, d, "job_items"))


def queue_status(spark, d):
    return jobs.queue_status(table(spark, d, "jobs").dropDuplicates(["id"]))


def job_counters(spark, d):
    return jobs.counters(_items(spark, d))


def terminal_status(spark, d):
    return jobs.terminal_status(jobs.counters(_items(spark, d))).select("job_id", "derived_status")


def status_mismatch(spark, d):
    """Jobs by the state on record and the one that follows from their items."""
    derived = jobs.terminal_status(jobs.counters(_items(spark, d))).select("job_id", "derived_status")
    j = table(spark, d, "jobs").select("id", "status").distinct()
    return j.join(derived, F.col("id") == F.col("job_id"), "left").groupBy("status", "derived_status").agg(F.count("*").alias("jobs"))


def job_list_order(spark, d):
    return jobs.page(table(spark, d, "jobs").dropDuplicates(["id"]), 200).select("id", "status", F.unix_micros("created_at").alias("created_us"))


def claim_next(spark, d):
    """The job a worker would take: now, and once no job runs any more."""
    j = table(spark, d, "jobs").dropDuplicates(["id"])
    free = j.where("status <> 'running'")
    return jobs.claim_next(j).select(F.lit("now").alias("at"), "id").unionByName(jobs.claim_next(free).select(F.lit("free").alias("at"), "id"))


def next_per_kind(spark, d):
    return jobs.next_per_kind(table(spark, d, "jobs"))


def delete_job_cascade(spark, d):
    """Jobs and items that stay when failed jobs go with all they have."""
    kept, items = jobs.delete_jobs(table(spark, d, "jobs").dropDuplicates(["id"]), _items(spark, d), "status = 'failed'")
    return kept.groupBy("status").agg(F.count("*").alias("jobs")).join(items.join(kept.select(F.col("id").alias("job_id"), F.col("status").alias("s")), "job_id").groupBy(F.col("s").alias("status")).agg(F.count("*").alias("items")), "status", "left")


def zip_manifest_items(spark, d):
    """Items of a job beside the rows of its manifest, place by place: how many agree on the path."""
    m = table(spark, d, "upload_manifest").select("manifest_id", "job_id", "relative_path").distinct()
    return jobs.zipped(_items(spark, d), m, "manifest_id").groupBy("job_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("relative_path") == F.col("other_path")).alias("same"))


def retry_items(spark, d):
    return jobs.retry_items(_items(spark, d))


def job_items_nested(spark, d):
    got = jobs.nested(table(spark, d, "jobs").select("id", "status").distinct(), _items(spark, d))
    return got.select("id", "status", F.size("item_ids").alias("items"), F.md5(F.array_join("item_ids", ",")).alias("order_md5"))


def worker_online(spark, d):
    """Users as workers: seen within fifteen minutes of the last event."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("ts").alias("now"))
    got = e.groupBy("user_id").agg(F.max("ts").alias("last_seen")).join(F.broadcast(last), F.lit(True))
    return got.select("user_id", (F.unix_timestamp("last_seen") >= F.unix_timestamp("now") - 900).alias("online"))


def job_durations(spark, d):
    j = table(spark, d, "jobs").select("id", "kind", "created_at", "started_at", "finished_at").distinct()
    wait, run = (F.unix_timestamp(b) - F.unix_timestamp(a) for a, b in (("created_at", "started_at"), ("started_at", "finished_at")))
    return j.groupBy("kind").agg(F.count("*").alias("jobs"), F.sum(wait).alias("wait_s"), F.sum(run).alias("run_s"), F.max(run).alias("longest_s"))


def chunk_counts_match(spark, d):
    """Completed items whose recorded number of pieces differs from the visible points of their file, 0 where it has none."""
    c = store.visible(table(spark, d, "chunks")).select("doc_id", "point_id").distinct().groupBy("doc_id").agg(F.count("*").alias("points"))
    i = _items(spark, d).where("file_id is not null").select("id", "file_id", "chunks")
    return i.join(c, i.file_id == c.doc_id, "left").withColumn("points", F.coalesce("points", F.lit(0))).where("chunks is distinct from points").select("id", "chunks", "points")


def late_records(spark, d):
    i = table(spark, d, "job_items").where("finished_at is not null and recorded_at is not null").distinct()
    late = F.floor((F.unix_timestamp("recorded_at") - F.unix_timestamp("finished_at")) / 86400)
    return i.groupBy(late.alias("days_late")).agg(F.count("*").alias("items"))


def manifest_summary(spark, d):
    """Manifest rows by type and subject, with missing metadata; a repeated row once."""
    m = table(spark, d, "upload_manifest").distinct()
    missing = F.col("subject").isNull() | F.col("grade").isNull() | F.col("lang").isNull()
    return m.groupBy("doc_type", "subject").agg(F.count("*").alias("files"), F.count_if(missing).alias("incomplete"), F.count_if("ocr").alias("scanned"), F.count_distinct("job_id").alias("jobs"))


def duplicate_uploads(spark, d):
    """File names uploaded more than once, under whatever path."""
    m = table(spark, d, "upload_manifest").select("manifest_id", "filename").distinct()
    return m.groupBy("filename").agg(F.count("*").alias("times"), F.min("manifest_id").alias("first_id")).where("times > 1")


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_tumbling(spark, d):
    return events.tumbling(_events(spark, d), "1 hour")


def events_sliding(spark, d):
    return events.sliding(_events(spark, d), "1 hour", "15 minutes")


def events_session(spark, d):
    return events.sessions(_events(spark, d), "30 minutes")


def rate_limit_window(spark, d):
    return events.over_limit(_events(spark, d), 1, "1 hour")


def login_sliding_limit(spark, d):
    e = events.sliding_count(_events(spark, d).where("event_type = 'error'"), 86400)
    return e.select("event_id", "user_id", "in_span")


def ttl_state(spark, d):
    e = _events(spark, d)
    return events.ttl_state(e, "2 hours", F.lit("2024-01-15 12:00:00").cast("timestamp"), 512)


def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.sum(price).cast("double").alias("sum_price"), F.count("*").alias("n"))


def revenue_by_nation(spark, d):
    li, o, c, s, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    got = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rev = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return got.groupBy("r_name", "n_name").agg(F.sum(rev).cast("double").alias("revenue"))


def orders_without_returns(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


def customers_with_big_orders(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def part_rollup(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("parts"), F.max("p_size").alias("largest"))


def part_cube(spark, d):
    return table(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("parts"))


def order_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def lookup_sets(spark, d):
    """Customers who ordered, without those who never had an urgent order; by set operations."""
    o = table(spark, d, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return o.select("o_custkey").intersect(urgent).exceptAll(o.where("o_totalprice > 400000").select("o_custkey").distinct())


QUERIES = {f.__name__: f for f in (
    eval_left_join_default, stat_block, eval_grouping_sets, score_histogram, heatmap_pivot, weakest_groups, strongest_groups, verdict_bands, eval_batches, queue_status, job_counters, terminal_status, status_mismatch,
    job_list_order, claim_next, next_per_kind, delete_job_cascade, zip_manifest_items, retry_items, job_items_nested, worker_online, job_durations, chunk_counts_match, late_records, manifest_summary, duplicate_uploads, events_tumbling, events_sliding, events_session,
    rate_limit_window, login_sliding_limit, ttl_state, pricing_summary, revenue_by_nation, orders_without_returns, customers_with_big_orders, part_rollup, part_cube, order_rank, lookup_sets,
)}

G = """lg AS (SELECT id, least(greatest(score, 0), 100) AS score FROM grades QUALIFY row_number() OVER (PARTITION BY id ORDER BY graded_at DESC NULLS LAST, score DESC NULLS LAST) = 1),
g AS (SELECT e.id, e.subject, e.grade, e.lab, coalesce(lg.score, 0) AS score FROM (SELECT DISTINCT id, subject, grade, lab FROM eval_slim) e LEFT JOIN lg USING (id))"""
BLOCK = "count(*) AS n, count(*) FILTER (WHERE score >= 70) AS correct, count(*) FILTER (WHERE score >= 40 AND score < 70) AS partial, count(*) FILTER (WHERE score < 40) AS incorrect, round_even(avg(score), 1) AS avg_score, round_even(count(*) FILTER (WHERE score >= 70) * 100.0::DOUBLE / count(*), 1) AS correct_pct, round_even(count(*) FILTER (WHERE score >= 40 AND score < 70) * 100.0::DOUBLE / count(*), 1) AS partial_pct"
ITEMS = "i AS (SELECT * FROM job_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST, status DESC NULLS LAST, chunks DESC NULLS LAST) = 1)"
COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in jobs.ITEM_STATUSES)
DERIVED = "CASE WHEN pending + running > 0 THEN 'running' WHEN cancelled > 0 THEN 'cancelled' WHEN failed > 0 AND completed + skipped > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'completed' END"
LABS = f"SELECT subject, grade, lab, count(*) AS n, round_even(avg(score), 1) AS avg_score FROM g WHERE subject IS NOT NULL AND grade IS NOT NULL AND lab IS NOT NULL GROUP BY ALL"

SQL = {
    "eval_left_join_default": f"WITH {G} SELECT id, score, CASE WHEN score >= 70 THEN 'correct' WHEN score >= 40 THEN 'partial' ELSE 'incorrect' END AS verdict FROM g",
    "stat_block": f"WITH {G}, b AS (SELECT subject, {BLOCK} FROM g GROUP BY subject) SELECT *, correct_pct + partial_pct / 2 AS lenient_pct FROM b",
    "eval_grouping_sets": f"WITH {G}, b AS (SELECT subject, grade, lab, {BLOCK} FROM g GROUP BY GROUPING SETS ((), (subject), (grade), (subject, grade), (subject, grade, lab))) SELECT *, correct_pct + partial_pct / 2 AS lenient_pct FROM b",
    "score_histogram": f"WITH {G} SELECT r.bin::INT AS bin, count(g.id) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN g ON least(floor(g.score / 10), 9) = r.bin GROUP BY r.bin",
    "heatmap_pivot": f"WITH {G} SELECT subject, {', '.join(f'round_even(avg(score) FILTER (WHERE grade = {x}), 1) AS grade_{x}' for x in range(7, 12))} FROM g GROUP BY subject",
    "weakest_groups": f"WITH {G} {LABS} ORDER BY avg_score, subject, grade, lab LIMIT 10",
    "strongest_groups": f"WITH {G} {LABS} ORDER BY avg_score DESC, subject DESC, grade DESC, lab DESC LIMIT 10",
    "verdict_bands": "SELECT CASE WHEN least(greatest(score, 0), 100) >= 70 THEN 'correct' WHEN least(greatest(score, 0), 100) >= 40 THEN 'partial' ELSE 'incorrect' END AS band, lower(trim(verdict)) AS written, count(*) AS n FROM (SELECT DISTINCT * FROM grades) t GROUP BY ALL",
    "eval_batches": "SELECT b AS batch, count(*) AS pairs, min(id) AS first_id, sum(length(answer))::BIGINT AS answer_chars FROM (SELECT *, (row_number() OVER (ORDER BY id, subject NULLS FIRST, q NULLS FIRST, expected, answer) - 1) // 15 AS b FROM (SELECT DISTINCT id, subject, q, coalesce(expected, '') AS expected, coalesce(answer, '') AS answer FROM eval_slim) t) u GROUP BY b",
    "queue_status": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in jobs.STATUSES) + " FROM (SELECT DISTINCT ON (id) id, status FROM jobs) t",
    "job_counters": f"WITH {ITEMS} SELECT job_id, count(*) AS total, {COUNTS}, first(id ORDER BY position, id) FILTER (WHERE status = 'running') AS current_item FROM i GROUP BY job_id",
    "terminal_status": f"WITH {ITEMS}, c AS (SELECT job_id, {COUNTS} FROM i GROUP BY job_id) SELECT job_id, {DERIVED} AS derived_status FROM c",
    "status_mismatch": f"WITH {ITEMS}, c AS (SELECT job_id, {COUNTS} FROM i GROUP BY job_id), x AS (SELECT job_id, {DERIVED} AS derived_status FROM c) SELECT status, derived_status, count(*) AS jobs FROM (SELECT DISTINCT id, status FROM jobs) j LEFT JOIN x ON j.id = x.job_id GROUP BY ALL",
    "job_list_order": """SELECT id, status, epoch_us(created_at) AS created_us FROM (SELECT DISTINCT ON (id) id, status, created_at FROM jobs) t ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END,
        CASE WHEN status IN ('running', 'queued') THEN created_at END ASC NULLS LAST, CASE WHEN status NOT IN ('running', 'queued') THEN created_at END DESC NULLS LAST, id LIMIT 200""",
    "claim_next": """WITH f AS (SELECT first(id ORDER BY created_at, id) AS id FROM jobs WHERE status = 'queued')
        SELECT 'free' AS "at", id FROM f WHERE id IS NOT NULL UNION ALL SELECT 'now', id FROM f WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs WHERE status = 'running')""",
    "delete_job_cascade": f"WITH {ITEMS}, j AS (SELECT DISTINCT ON (id) id, status FROM jobs), k AS (SELECT * FROM j WHERE status IS DISTINCT FROM 'failed'), n AS (SELECT k.status, count(*) AS items FROM i JOIN k ON i.job_id = k.id GROUP BY k.status) SELECT k.status, count(*) AS jobs, any_value(n.items) AS items FROM k LEFT JOIN n ON n.status = k.status GROUP BY k.status",
    "zip_manifest_items": f"""WITH {ITEMS}, a AS (SELECT job_id, relative_path, row_number() OVER (PARTITION BY job_id ORDER BY position, id) AS n FROM i), m AS (SELECT DISTINCT manifest_id, job_id, relative_path AS other FROM upload_manifest), b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY manifest_id) AS n FROM m)
        SELECT a.job_id, count(*) AS pairs, count(*) FILTER (WHERE relative_path = other) AS same FROM a JOIN b ON a.job_id = b.job_id AND a.n = b.n GROUP BY a.job_id""",
    "next_per_kind": "SELECT kind, first(id ORDER BY created_at, id) AS id FROM jobs WHERE status = 'queued' GROUP BY kind",
    "retry_items": f"WITH {ITEMS} SELECT job_id, id, position, row_number() OVER (PARTITION BY job_id ORDER BY position, id) - 1 AS new_position FROM i WHERE status IN ('failed', 'cancelled')",
    "job_items_nested": f"WITH {ITEMS}, n AS (SELECT job_id, count(*) AS items, md5(string_agg(id, ',' ORDER BY position, id)) AS m FROM i GROUP BY job_id) SELECT j.id, j.status, coalesce(items, 0) AS items, coalesce(m, md5('')) AS order_md5 FROM (SELECT DISTINCT id, status FROM jobs) j LEFT JOIN n ON j.id = n.job_id",
    "worker_online": "SELECT user_id, epoch(date_trunc('second', max(ts))) >= epoch(date_trunc('second', (SELECT max(ts) FROM events))) - 900 AS online FROM events GROUP BY user_id",
    "job_durations": """SELECT kind, count(*) AS jobs, sum(date_diff('second', date_trunc('second', created_at), date_trunc('second', started_at)))::BIGINT AS wait_s, sum(date_diff('second', date_trunc('second', started_at), date_trunc('second', finished_at)))::BIGINT AS run_s,
        max(date_diff('second', date_trunc('second', started_at), date_trunc('second', finished_at))) AS longest_s FROM (SELECT DISTINCT id, kind, created_at, started_at, finished_at FROM jobs) t GROUP BY kind""",
    "chunk_counts_match": f"WITH {ITEMS}, c AS (SELECT doc_id, count(DISTINCT point_id) AS points FROM chunks WHERE {VISIBLE} GROUP BY doc_id) SELECT i.id, i.chunks, coalesce(c.points, 0) AS points FROM i LEFT JOIN c ON i.file_id = c.doc_id WHERE i.file_id IS NOT NULL AND i.chunks IS DISTINCT FROM coalesce(c.points, 0)",
    "late_records": "SELECT floor(date_diff('second', date_trunc('second', finished_at), date_trunc('second', recorded_at)) / 86400.0)::BIGINT AS days_late, count(*) AS items FROM (SELECT DISTINCT * FROM job_items WHERE finished_at IS NOT NULL AND recorded_at IS NOT NULL) t GROUP BY days_late",
    "manifest_summary": "SELECT doc_type, subject, count(*) AS files, count(*) FILTER (WHERE subject IS NULL OR grade IS NULL OR lang IS NULL) AS incomplete, count(*) FILTER (WHERE ocr) AS scanned, count(DISTINCT job_id) AS jobs FROM (SELECT DISTINCT * FROM upload_manifest) t GROUP BY ALL",
    "duplicate_uploads": "SELECT filename, count(DISTINCT manifest_id) AS times, min(manifest_id) AS first_id FROM upload_manifest GROUP BY filename HAVING count(DISTINCT manifest_id) > 1",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start, count(*) AS n FROM events, (SELECT unnest(range(4)) AS k) r GROUP BY ALL",
    "events_session": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, s""",
    "rate_limit_window": "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "login_sliding_limit": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_span FROM events WHERE event_type = 'error'",
    "ttl_state": "SELECT user_id, max(ts) AS put_at FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id HAVING max(ts) + INTERVAL 2 HOUR > TIMESTAMP '2024-01-15 12:00:00' ORDER BY put_at DESC, user_id LIMIT 512",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "revenue_by_nation": "SELECT r_name, n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "orders_without_returns": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "customers_with_big_orders": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY c_mktsegment",
    "part_rollup": "SELECT p_brand, p_type, count(*) AS parts, max(p_size) AS largest FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "part_cube": "SELECT p_brand, p_size, count(*) AS parts FROM part GROUP BY CUBE (p_brand, p_size)",
    "order_rank": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
    "lookup_sets": "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
}

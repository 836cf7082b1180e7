"""Queries over the point store and search, with DuckDB counterparts."""

from pyspark.sql import functions as F

from tolqyn.operators import answers, retrieval, store
from tolqyn.runtime import table

VISIBLE = """(lower(coalesce(status, '')) NOT IN ('pending', 'staging', 'superseded') AND CASE WHEN nullif(generation, '') IS NULL THEN nullif(active_generation, '') IS NULL ELSE coalesce(generation = active_generation, false) END)"""


def _points(spark, d):
    return table(spark, d, "chunks")


def _search_points(spark, d):
    """Visible points with a vector, repeated rows once."""
    p = store.visible(_points(spark, d)).where("size(dense) > 0")
    return p.select("point_id", "collection", "doc_id", "doc_type", "subject", "grade", "lang", "dense", "sparse_indices", "sparse_values").dropDuplicates(["point_id"])


def _dense_points(spark, d):
    """As above, without the shuffle: dense search counts a repeated key once itself."""
    return store.visible(_points(spark, d)).select("point_id", "subject", "grade", "lang", "dense")


def _queries(spark, d):
    """All pieces of every document whose id is divisible by 100."""
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("file_id").alias("doc_id")).distinct()
    p = store.visible(_points(spark, d)).where("size(dense) > 0").join(docs, "doc_id", "left_semi")
    return p.select(F.col("point_id").alias("query_id"), "lang", "subject", "grade", "dense", "sparse_indices", "sparse_values").dropDuplicates(["query_id"])


SQL_BASE = f"""
pts AS (SELECT point_id, any_value(collection) AS collection, any_value(doc_id) AS doc_id, any_value(doc_type) AS doc_type, any_value(subject) AS subject, any_value(grade) AS grade, any_value(lang) AS lang, any_value(dense) AS dense, any_value(sparse_indices) AS sparse_indices, any_value(sparse_values) AS sparse_values
        FROM chunks WHERE {VISIBLE} AND len(dense) > 0 GROUP BY point_id),
qs AS (SELECT c.point_id AS query_id, any_value(c.lang) AS lang, any_value(c.subject) AS subject, any_value(c.grade) AS grade, any_value(c.dense) AS dense, any_value(c.sparse_indices) AS sparse_indices, any_value(c.sparse_values) AS sparse_values
       FROM chunks c WHERE {VISIBLE} AND len(c.dense) > 0 AND c.doc_id IN (SELECT file_id FROM documents WHERE doc_id % 100 = 0) GROUP BY c.point_id),
dn AS (SELECT q.query_id, p.point_id, p.lang, p.subject, p.grade, q.lang AS q_lang, q.subject AS q_subject, q.grade AS q_grade, round(list_cosine_similarity(q.dense::DOUBLE[], p.dense::DOUBLE[]), 6) AS score
       FROM qs q CROSS JOIN pts p WHERE list_sum(list_transform(p.dense, lambda x: abs(x))) > 0 AND list_sum(list_transform(q.dense, lambda x: abs(x))) > 0),
dr AS (SELECT * FROM (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dn) t WHERE rank <= 20),
qt AS (SELECT query_id, unnest(sparse_indices) AS term, unnest(sparse_values)::DOUBLE AS w FROM qs),
pt AS (SELECT point_id, unnest(sparse_indices) AS term, unnest(sparse_values)::DOUBLE AS w FROM pts),
sn AS (SELECT query_id, point_id, round(sum(qt.w * pt.w), 6) AS score FROM qt JOIN pt USING (term) GROUP BY ALL),
sr AS (SELECT * FROM (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sn) t WHERE rank <= 20),
fu AS (SELECT query_id, point_id, round(sum(1.0 / (60 + rank)::DOUBLE), 6) AS score FROM (SELECT query_id, point_id, rank FROM dr UNION ALL SELECT query_id, point_id, rank FROM sr) u GROUP BY ALL),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fu) t WHERE rank <= 5)
"""


def dense_topk(spark, d):
    return retrieval.dense_topk(_dense_points(spark, d), _queries(spark, d), 20)


def sparse_topk(spark, d):
    return retrieval.sparse_topk(_search_points(spark, d), _queries(spark, d), 20)


def hybrid_rrf(spark, d):
    q = _queries(spark, d)
    return retrieval.rrf([retrieval.dense_topk(_dense_points(spark, d), q, 20), retrieval.sparse_topk(_search_points(spark, d), q, 20)], 60, 5)


def score_threshold(spark, d):
    return retrieval.dense_topk(_dense_points(spark, d), _queries(spark, d), 20).where("score >= 0.5")


TIERS = (("subject", "grade", "lang"), ("subject", "grade"), ("subject", "lang"), ("subject",))


def _tiers(spark, d):
    """The query's subject and grade, then its subject; of either first what is in its own language, then what is in any."""
    p, q = _dense_points(spark, d), _queries(spark, d)
    tiers = []
    for cols in TIERS:
        tag, ok = F.concat_ws("|", *cols), " and ".join(f"{c} is not null" for c in cols)
        tiers.append(retrieval.dense_topk(p.where(ok).withColumn("scope", tag), q.where(ok).withColumn("scope", tag), 5, scope="scope"))
    return tiers


def tiered_retrieval(spark, d):
    return retrieval.tiered(_tiers(spark, d), 5)


SQL_TIERS = (
    ",\n".join(
        f"t{n} AS (SELECT query_id, point_id, score, {n} AS tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dn WHERE {' AND '.join(f'{c} = q_{c}' for c in cols)} QUALIFY rank <= 5)"
        for n, cols in enumerate(TIERS)
    )
    + """,
ta AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
td AS (SELECT * FROM ta QUALIFY row_number() OVER (PARTITION BY query_id, point_id ORDER BY tier, rank) = 1)
SELECT query_id, point_id, score, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, point_id) AS place FROM td QUALIFY place <= 5
"""
)


def visible_points(spark, d):
    return store.visible(_points(spark, d)).select("collection", "point_id").distinct()


def list_documents(spark, d):
    return store.list_documents(store.visible(_points(spark, d)))


def collection_status(spark, d):
    return store.collection_status(store.visible(_points(spark, d)))


def generation_activate(spark, d):
    return store.generations(_points(spark, d))


def newest_complete(spark, d):
    """The newest complete generation of every document, with an upload in between: g1 to g10 by document, of which every third lost a piece."""
    p = _points(spark, d).where("generation <> ''").select("collection", "doc_id", "chunk_index", "chunk_count").distinct()
    made = p.select("*", F.explode(F.array(F.lit(9), F.lit(10))).alias("g")).where((F.col("g") == 9) | (F.col("chunk_index") > 0) | ((F.length("doc_id") + F.ascii("doc_id")) % 3 != 0))
    got = store.newest_complete(made.select("collection", "doc_id", F.concat(F.lit("g"), F.col("g").cast("string")).alias("generation"), F.lit("g9").alias("active_generation"), "chunk_index", "chunk_count"))
    return got.groupBy("collection", "generation").agg(F.count("*").alias("documents"))


def stale_points_anti(spark, d):
    """Points of files that no document names."""
    have = table(spark, d, "documents").select(F.col("file_id").alias("doc_id")).distinct()
    return _points(spark, d).select("point_id", "doc_id").distinct().join(have, "doc_id", "left_anti").select("point_id")


def delete_document(spark, d):
    """What stays of each collection when every hundredth document goes."""
    doomed = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("file_id").alias("doc_id"))
    return store.delete_documents(_points(spark, d).select("collection", "point_id", "doc_id").distinct(), doomed).groupBy("collection").agg(F.count("*").alias("points"), F.count_distinct("doc_id").alias("documents"))


def duplicate_labs(spark, d):
    """Labs named by more than one visible document of a collection."""
    docs = store.visible(_points(spark, d)).where("lab_id is not null").select("collection", "lab_id", "doc_id").distinct()
    return docs.groupBy("collection", "lab_id").agg(F.count("*").alias("documents")).where("documents > 1")


def documents_by_type(spark, d):
    docs = store.visible(_points(spark, d)).select("doc_id", "doc_type", "lang").distinct()
    return docs.groupBy("doc_type", "lang").agg(F.count_distinct("doc_id").alias("documents"))


def citations_grouped(spark, d):
    ranked = hybrid_rrf(spark, d)
    got = answers.citations(ranked, store.visible(_points(spark, d)))
    return got.select("query_id", "doc_id", "filename", "first_rank", "source_type", F.array_join("chunk_indexes", ",").alias("chunk_indexes"), F.array_join("pages", ",").alias("pages"), "number")


def citation_labels(spark, d):
    got = answers.citations(hybrid_rrf(spark, d), store.visible(_points(spark, d)))
    return got.select("query_id", "number", answers.label("ru").alias("label_ru"), answers.label("en").alias("label_en"))


def knowledge_block(spark, d):
    return answers.knowledge(hybrid_rrf(spark, d), store.visible(_points(spark, d)))


SQL_CITE = f"""
pu AS (SELECT DISTINCT point_id, doc_id, coalesce(source_path, source) AS source_path, filename, doc_type, lab_number, chunk_index, page_start, page_end, pages FROM chunks WHERE {VISIBLE}),
ci AS (SELECT fr.query_id, fr.rank, pu.*, coalesce(pu.filename, regexp_extract(pu.source_path, '[^/\\\\]+$')) AS fname FROM fr JOIN pu USING (point_id)),
cg AS (SELECT query_id, doc_id, coalesce(source_path, fname) AS skey, arg_min(fname, rank) AS filename, min(rank) AS first_rank, arg_min(doc_type, rank) AS source_type, arg_min(lab_number, rank) AS lab_number,
        list_sort(list_distinct(list(chunk_index))) AS chunk_indexes,
        list_sort(list_distinct(list_filter(flatten(list(list_concat(coalesce(pages, []::INT[]), [page_start, page_end]))), lambda x: x IS NOT NULL))) AS pages
      FROM ci WHERE fname <> '' AND doc_id IS NOT NULL GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS number, list_min(pages) AS page_from, list_max(pages) AS page_to FROM cg)
"""

QUERIES = {
    "dense_topk": dense_topk, "sparse_topk": sparse_topk, "hybrid_rrf": hybrid_rrf, "score_threshold": score_threshold, "tiered_retrieval": tiered_retrieval,
    "visible_points": visible_points, "list_documents": list_documents, "collection_status": collection_status, "generation_activate": generation_activate, "newest_complete": newest_complete,
    "stale_points_anti": stale_points_anti, "delete_document": delete_document, "duplicate_labs": duplicate_labs, "documents_by_type": documents_by_type,
    "citations_grouped": citations_grouped, "citation_labels": citation_labels, "knowledge_block": knowledge_block,
}

SQL = {
    "dense_topk": f"WITH {SQL_BASE} SELECT query_id, point_id, score, rank FROM dr",
    "sparse_topk": f"WITH {SQL_BASE} SELECT query_id, point_id, score, rank FROM sr",
    "hybrid_rrf": f"WITH {SQL_BASE} SELECT query_id, point_id, score, rank FROM fr",
    "score_threshold": f"WITH {SQL_BASE} SELECT query_id, point_id, score, rank FROM dr WHERE score >= 0.5",
    "tiered_retrieval": f"WITH {SQL_BASE}, {SQL_TIERS}",
    "visible_points": f"SELECT DISTINCT collection, point_id FROM chunks WHERE {VISIBLE}",
    "list_documents": f"""WITH r AS (SELECT DISTINCT collection, doc_id, point_id, chunk_index, coalesce(source_path, source) AS source_path, filename, doc_type, subject, grade, lang, lab_number, lab_id FROM chunks WHERE {VISIBLE})
        SELECT collection, doc_id, count(*) AS chunks, {', '.join(f"first({c} ORDER BY chunk_index, point_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("source_path", "filename", "doc_type", "subject", "grade", "lang", "lab_number", "lab_id"))} FROM r GROUP BY ALL""",
    "collection_status": f"""SELECT collection, count(DISTINCT point_id) AS points, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (WHERE lang = 'ru') AS documents_ru, count(DISTINCT doc_id) FILTER (WHERE lang = 'kk') AS documents_kk,
        count(DISTINCT doc_id) FILTER (WHERE lang = 'en') AS documents_en, CASE WHEN count(DISTINCT point_id) > 0 THEN 'ready' ELSE 'empty' END AS state FROM chunks WHERE {VISIBLE} GROUP BY collection""",
    "generation_activate": """SELECT collection, doc_id, generation, count(DISTINCT chunk_index) AS pieces, max(chunk_count) AS expected, max((generation = active_generation)::INT) AS is_active, count(DISTINCT chunk_index) = max(chunk_count) AS complete
        FROM chunks WHERE generation <> '' GROUP BY collection, doc_id, generation""",
    "newest_complete": """WITH p AS (SELECT DISTINCT collection, doc_id, chunk_index, chunk_count FROM chunks WHERE generation <> ''), m AS (SELECT * FROM (SELECT *, unnest([9, 10]) AS g FROM p) t WHERE g = 9 OR chunk_index > 0 OR (length(doc_id) + ascii(doc_id)) % 3 <> 0),
        c AS (SELECT collection, doc_id, g FROM m GROUP BY ALL HAVING count(DISTINCT chunk_index) = max(chunk_count)), n AS (SELECT collection, doc_id, max(g) AS g FROM c GROUP BY ALL) SELECT collection, 'g' || g AS generation, count(*) AS documents FROM n GROUP BY ALL""",
    "stale_points_anti": "SELECT DISTINCT point_id FROM chunks WHERE doc_id NOT IN (SELECT file_id FROM documents WHERE file_id IS NOT NULL)",
    "delete_document": "SELECT collection, count(DISTINCT point_id) AS points, count(DISTINCT doc_id) AS documents FROM chunks WHERE doc_id NOT IN (SELECT file_id FROM documents WHERE doc_id % 100 = 0 AND file_id IS NOT NULL) GROUP BY collection",
    "duplicate_labs": f"SELECT collection, lab_id, count(DISTINCT doc_id) AS documents FROM chunks WHERE {VISIBLE} AND lab_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) > 1",
    "documents_by_type": f"SELECT doc_type, lang, count(DISTINCT doc_id) AS documents FROM chunks WHERE {VISIBLE} GROUP BY ALL",
    "citations_grouped": f"WITH {SQL_BASE}, {SQL_CITE} SELECT query_id, doc_id, filename, first_rank, source_type, array_to_string(chunk_indexes, ',') AS chunk_indexes, array_to_string(pages, ',') AS pages, number FROM cn",
    "citation_labels": f"""WITH {SQL_BASE}, {SQL_CITE} SELECT query_id, number,
        CASE WHEN coalesce(source_type = 'lab_instruction', false) THEN 'Инструкция к лабораторной работе' || coalesce(' №' || lab_number, '') ELSE regexp_replace(filename, '\\.[^.]+$', '') END || CASE WHEN page_from IS NULL THEN '' WHEN page_from <> page_to THEN ', стр. ' || page_from || '-' || page_to ELSE ', стр. ' || page_from END AS label_ru,
        CASE WHEN coalesce(source_type = 'lab_instruction', false) THEN 'Lab instruction' || coalesce(' No. ' || lab_number, '') ELSE regexp_replace(filename, '\\.[^.]+$', '') END || CASE WHEN page_from IS NULL THEN '' WHEN page_from <> page_to THEN ', pp. ' || page_from || '-' || page_to ELSE ', p. ' || page_from END AS label_en FROM cn""",
    "knowledge_block": f"""WITH {SQL_BASE}, kp AS (SELECT DISTINCT point_id, filename, text FROM chunks WHERE {VISIBLE})
        SELECT query_id, string_agg('[' || rank || '] (' || coalesce(filename, '?') || ')' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY rank) AS context FROM fr JOIN kp USING (point_id) WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY query_id""",
}

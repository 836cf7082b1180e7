"""Chunking, quality, understanding and history queries, with DuckDB counterparts."""

from pyspark.sql import functions as F

from tolqyn.operators import answers, chunking, quality, understanding as u
from tolqyn.runtime import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "subject", "text")


def chunk_documents(spark, d):
    return chunking.chunks(_docs(spark, d)).select("doc_id", "chunk_index", "char_start", "char_end", F.md5("chunk").alias("chunk_md5"))


def chunk_counts_by_lang(spark, d):
    got = chunking.chunks(_docs(spark, d)).groupBy("lang")
    return got.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.sum(F.length("chunk")).alias("chars"))


def chunk_small_windows(spark, d):
    """An overlap that is not below the size counts as a quarter of it."""
    got = chunking.chunks(_docs(spark, d), size=400, overlap=400)
    return got.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("char_end").alias("last_end"))


def doc_uuid5(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.uuid5(F.col("doc_key")).alias("key_uuid"))


def reconstruct_text(spark, d):
    """Documents whose pieces do not give back their text; there must be none."""
    docs = _docs(spark, d)
    again = chunking.rebuilt(chunking.chunks(docs), ["doc_id"])
    same = docs.select("doc_id", chunking.flat(F.col("text")).alias("flat")).join(again, "doc_id", "left")
    return same.groupBy((F.coalesce("flat", F.lit("")) == F.coalesce("text", F.lit(""))).alias("same")).agg(F.count("*").alias("documents"))


def page_overlap_join(spark, d):
    return chunking.pages_of_windows(table(spark, d, "ocr_pages"))


def heading_asof(spark, d):
    """Pieces with the chapter and section they lie in."""
    return chunking.with_headings(_docs(spark, d)).select("doc_id", "chunk_index", "chapter", "section")


def word_counts(spark, d):
    w, t = quality.words(F.col("text")), quality.tokens(F.col("text"))
    got = _docs(spark, d).select("doc_id", F.coalesce(F.size(w), F.lit(-1)).alias("words"), F.coalesce(F.size(t), F.lit(-1)).alias("tokens"), F.coalesce(F.size(F.array_distinct(t)), F.lit(-1)).alias("different"))
    return got


def usable_text(spark, d):
    return _docs(spark, d).select("doc_id", quality.usable(F.col("text")).alias("usable"))


def low_quality_text(spark, d):
    rows = quality.fixed(_docs(spark, d), cleaned=quality.clean_extraction(F.col("text")))
    return quality.low_quality(rows, F.col("text"), F.col("cleaned")).select("doc_id", "low_quality")


def cleaned_text(spark, d):
    """Documents without artifact lines, page labels and dominating repeated lines."""
    got = quality.fixed(_docs(spark, d), cleaned=quality.clean_extraction(F.col("text")))
    return got.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").alias("chars"))


def artifact_lines(spark, d):
    """Artifact lines of scanned pages as a text layer has them: below two labels of the page (the tables hold none)."""
    page = F.col("page_no").cast("string")
    layer = F.concat_ws("\n", F.concat(F.lit("page"), page), F.concat(F.lit("| Page "), page, F.lit(" | | "), page, F.lit(" |")), "text")
    lines = table(spark, d, "ocr_pages").select("page_id", "page_no", "text").distinct().select("page_id", F.explode(F.split(layer, "\n")).alias("line"))
    return lines.where(quality.is_artifact(F.col("line"))).groupBy("page_id").agg(F.count("*").alias("artifacts"))


def better_text(spark, d):
    """Of a document and the text of its file's scanned pages: is the latter materially better?"""
    pages = table(spark, d, "ocr_pages").where("text is not null").select("file_id", "page_no", "text").distinct()
    scanned = pages.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n").alias("ocr"))
    docs = table(spark, d, "documents").select("doc_id", "file_id", F.coalesce("text", F.lit("")).alias("text")).join(scanned, "file_id", "left").withColumn("ocr", F.coalesce("ocr", F.lit("")))
    return quality.materially_better(docs, "ocr", "text").select("doc_id", "better")


def ngram_diversity(spark, d):
    runs = quality.sixgrams(F.col("tokens"))
    return quality.fixed(_docs(spark, d), tokens=quality.tokens(F.col("text"))).select("doc_id", runs["different"].alias("different_runs"), runs["all"].alias("all_runs"))


def repeated_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(quality.repeated_lines(F.col("text")), " / ").alias("lines")).where("lines <> ''")


def _questions(spark, d):
    return table(spark, d, "eval_slim").select("id", "subject", "q")


def detect_language(spark, d):
    s = u.language_scores(F.col("q"))
    return _questions(spark, d).select("id", *[s[k].alias(f"{k}_score") for k in ("ru", "kk", "en")], u.only_best(s).alias("language"))


def infer_subject(spark, d):
    return _questions(spark, d).select("id", u.infer_subject(F.col("q")).alias("inferred"))


def scope_terms(spark, d):
    return _questions(spark, d).select("id", F.array_join(F.array_sort(u.scope_terms(F.col("q"))), " ").alias("terms"))


def procedure_intent(spark, d):
    return _questions(spark, d).select("id", u.is_procedure(F.col("q")).alias("is_procedure"))


def scope_gate(spark, d):
    """Refusal of each question where its subject is the pair's and its lab text the expected answer."""
    e = table(spark, d, "eval_slim")
    refusal = u.scope_refusal(F.col("q"), F.col("subject"), F.coalesce("expected", F.lit("")), u.detect_language(F.col("q")))
    return e.select("id", F.coalesce(refusal, F.lit("")).alias("refusal"))


def missing_evidence(spark, d):
    """Answers that refuse because the material holds no evidence."""
    a = table(spark, d, "answer_results").select("answer_id", "answer").distinct()
    return a.select("answer_id", u.is_missing_evidence(F.col("answer")).alias("missing"))


def answer_modes(spark, d):
    """Answers with the private mark of their mode taken off, and whether they are general knowledge. The tables hold no marks, so they are put on
    by turns; an answer without one counts as general if no file stands behind it."""
    a = table(spark, d, "answer_results").select("answer_id", "answer", F.col("primary_file_id").isNull().alias("bare")).distinct()
    mark = F.when(F.col("answer_id") % 3 == 0, u.GENERAL_MARK + " ").when(F.col("answer_id") % 3 == 1, u.GROUNDED_MARK).otherwise("")
    text, general = u.answer_mode(F.concat(mark, F.coalesce("answer", F.lit(""))), F.lit(True), F.col("bare"))
    return a.select("answer_id", F.md5(text).alias("answer_md5"), general.alias("general"))


def fallback_gate(spark, d):
    """Whether general knowledge may answer a question: the expected answer as the lab's instruction, its lab as the active one."""
    e = table(spark, d, "eval_slim")
    return e.select("id", u.general_fallback(F.col("q"), [F.col("expected")], F.lit(True), F.col("lab").isNotNull()).alias("allowed"))


def _messages(spark, d):
    return answers.messages(table(spark, d, "answer_results"))


def trim_history(spark, d):
    got = answers.trim_history(_messages(spark, d), 6, 600)
    return got.select("conversation_id", "answer_id", "role", "back", "used")


def latest_user_message(spark, d):
    m = _messages(spark, d).where("role = 'user' and text <> ''")
    return m.groupBy("conversation_id").agg(F.max_by("text", F.struct("at", "answer_id")).alias("question"))


def followup_query(spark, d):
    return answers.followup_query(_messages(spark, d), 300, 6)


def token_usage(spark, d):
    a = table(spark, d, "answer_results").select("answer_id", "lab_id", "input_tokens", "output_tokens", "total_tokens").distinct()
    return a.groupBy("lab_id").agg(F.count("*").alias("answers"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))).alias("total_tokens"))


def language_by_conversation(spark, d):
    """The language of a conversation: that of its latest question that tells one."""
    m = _messages(spark, d).where("role = 'user'").withColumn("lang", u.detect_language(F.col("text"))).where("lang is not null")
    return m.groupBy("conversation_id").agg(F.max_by("lang", F.struct("at", "answer_id")).alias("language"))


QUERIES = {f.__name__: f for f in (
    chunk_documents, chunk_counts_by_lang, chunk_small_windows, doc_uuid5, reconstruct_text, page_overlap_join, heading_asof, word_counts, usable_text, low_quality_text, cleaned_text, artifact_lines, better_text, missing_evidence, answer_modes, fallback_gate, ngram_diversity,
    repeated_lines, detect_language, infer_subject, scope_terms, procedure_intent, scope_gate, trim_history, latest_user_message, followup_query, token_usage, language_by_conversation,
)}

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _chunks_sql(size: int, by: int) -> str:
    return f"""n AS (SELECT doc_id, lang, {FLAT} AS t FROM documents), w AS (SELECT *, CASE WHEN length(t) <= 0 THEN 0 WHEN length(t) <= {size} THEN 1 ELSE ceil((length(t) - {size}) / {by}.0)::INT + 1 END AS k FROM n),
x AS (SELECT doc_id, lang, i::INT AS chunk_index, substring(t, (i * {by} + 1)::INT, {size}) AS raw FROM w, LATERAL (SELECT unnest(range(k)) AS i) r),
c AS (SELECT doc_id, lang, chunk_index, chunk_index * {by} + length(raw) - length(ltrim(raw)) AS char_start, chunk_index * {by} + length(raw) - length(ltrim(raw)) + length(trim(raw)) AS char_end, trim(raw) AS chunk FROM x WHERE trim(raw) <> '')"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _stems(values) -> str:
    return "'^(" + "|".join(values) + ")'"


W = r"regexp_extract_all(lower({0}), '\p{{L}}+')"
SCORES = rf"""
a AS (SELECT id, q, {W.format('q')} AS w, list_filter(regexp_split_to_array(q, '\s+'), lambda t: NOT regexp_matches(t, '[0-9@/\\]|[A-Za-z]\.[A-Za-z]|^[A-Z]{{2,}}[^A-Za-z]*$')) AS prose FROM eval_slim),
b AS (SELECT *, regexp_extract_all(lower(array_to_string(prose, ' ')), '[a-z]+') AS latin FROM a),
c AS (SELECT id, q, 3 * length(regexp_replace(lower(q), '[^әғқңөұүһі]', '', 'g')) + 2 * len(list_filter(w, lambda x: list_contains({_list(u.KAZAKH_WORDS)}, x))) AS kk,
  2 * (len(list_filter(w, lambda x: list_contains({_list(u.RUSSIAN_WORDS)}, x))) + len(list_filter(w, lambda x: regexp_matches(x, {_stems(u.RUSSIAN_STEMS)})))) AS ru,
  len(list_filter(w, lambda x: regexp_matches(x, '^[а-яёәғқңөұүһі]{{2,}}$'))) AS cyr, len(list_filter(latin, lambda x: list_contains({_list(u.ENGLISH_SIGNALS)}, x))) AS sig, len(latin) AS n,
  len(list_filter(latin, lambda x: list_contains({_list(u.ENGLISH_SINGLE)}, x))) AS one FROM b),
s AS (SELECT id, ru + CASE WHEN kk > 0 THEN 0 ELSE cyr END AS ru_score, kk + CASE WHEN kk > 0 THEN cyr ELSE 0 END AS kk_score, 2 * sig + CASE WHEN (n >= 4 AND sig > 0) OR (n >= 2 AND sig >= 2) THEN n WHEN n = 1 AND one = 1 THEN 3 ELSE 0 END AS en_score FROM c),
l AS (SELECT *, greatest(ru_score, kk_score, en_score) AS best FROM s)
"""
BEST = "CASE WHEN best > 0 AND (ru_score = best)::INT + (kk_score = best)::INT + (en_score = best)::INT = 1 THEN CASE WHEN ru_score = best THEN 'ru' WHEN kk_score = best THEN 'kk' ELSE 'en' END END"
MESSAGES = "r AS (SELECT DISTINCT answer_id, conversation_id, created_at AS ts, question, answer FROM answer_results WHERE conversation_id IS NOT NULL), m AS (SELECT conversation_id, answer_id, ts, 0 AS half, 'user' AS role, question AS text FROM r UNION ALL SELECT conversation_id, answer_id, ts, 1, 'assistant', answer FROM r)"
# the scores of other questions: asked(id, q) stands for the pairs
ASKED_SCORES = SCORES.replace("FROM eval_slim", "FROM asked")
TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]{{2,}}')"
LINES = r"list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: {0})"

PROCEDURE_SQL = u.PROCEDURE.replace(r"\w", r"[\p{L}\p{N}_]")
INFO = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]{{2,}}')"


def _subject_sql(words: str) -> str:
    """The subject that a list of words names, null if none or several do."""
    n = {k: f"len(list_filter({words}, lambda x: regexp_matches(x, {_stems(v)})))" for k, v in u.SUBJECT_STEMS.items()}
    alone = [f"WHEN {n[k]} > greatest({', '.join(v for j, v in n.items() if j != k)}) THEN '{k}'" for k in n]
    return f"CASE {' '.join(alone)} END"


def _terms_sql(text: str) -> str:
    kept = rf"list_filter(regexp_extract_all(replace(lower({text}), 'ё', 'е'), '\p{{L}}+'), lambda x: length(x) >= 4 AND NOT regexp_matches(x, {_stems(u.GENERIC_STEMS)}))"
    return f"list_transform({kept}, lambda x: CASE WHEN regexp_matches(x, '[а-яәғқңөұүһі]') THEN substring(x, 1, 3) ELSE substring(x, 1, 4) END)"


def _artifact_sql(x: str) -> str:
    folded = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' *_`#>|-')"
    plain = f"trim(regexp_replace(regexp_replace({x}, '{quality.TABLE_MARKS}', ' ', 'g'), '\\s+', ' ', 'g'))"
    starts = " OR ".join(f"starts_with({folded}, '{p}')" for p in quality.NOTICE_STARTS)
    return f"""(trim(regexp_replace({x}, '\\s+', ' ', 'g')) <> '' AND (regexp_matches({folded}, '{quality.NOTICE_SITE}') OR {starts} OR regexp_matches({x}, '{quality.RULE}') AND regexp_matches({x}, '[|_-]')
        OR regexp_matches(lower({plain}), '^page ?[0-9]{{1,5}}( [0-9]{{1,5}})*$') OR regexp_matches({plain}, '^[0-9 ]+$') AND len(regexp_extract_all({plain}, '[0-9]{{1,5}}')) >= 4))"""


def _clean_sql(source: str, name: str) -> str:
    """name_clean(k, text, cleaned) of source(k, text): lines as rows, repeated ones by counting."""
    return rf"""{name}_src AS ({source}), {name}_ln AS (SELECT k, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {name}_src WHERE text IS NOT NULL),
{name}_kept AS (SELECT k, n, trim(regexp_replace(regexp_replace(raw, '{quality.PAGE_TOKEN}', '\1 ', 'g'), '\s+', ' ', 'g')) AS line FROM {name}_ln WHERE NOT {_artifact_sql("raw")}),
{name}_key AS (SELECT *, lower(line) AS key, {INFO.format("line")} AS toks, count(*) OVER (PARTITION BY k, lower(line)) AS c FROM {name}_kept WHERE line <> ''),
{name}_rep AS (SELECT *, c >= 4 AND len(toks) BETWEEN 1 AND 12 AND length(key) <= 140 AND NOT regexp_matches(key, '[.!?…][\s*_`]*$') AS rep FROM {name}_key),
{name}_gate AS (SELECT k, coalesce(sum(len(toks)) FILTER (WHERE rep), 0) >= 0.75 * sum(len(toks)) AND coalesce(bool_or(rep), false) AND coalesce(len(list_distinct(flatten(list(toks) FILTER (WHERE rep)))), 0) <= 24 AS cut FROM {name}_rep GROUP BY k),
{name}_out AS (SELECT k, string_agg(line, chr(10) ORDER BY n) AS cleaned FROM {name}_rep JOIN {name}_gate USING (k) WHERE NOT (cut AND rep) GROUP BY k),
{name}_clean AS (SELECT s.k, s.text, coalesce(o.cleaned, '') AS cleaned FROM {name}_src s LEFT JOIN {name}_out o ON s.k = o.k)"""


def _low_sql(source: str, name: str) -> str:
    """name_low(k, n, low) of source(k, raw, cleaned)."""
    return rf"""{name}_a AS (SELECT k, {TOK.format('raw')} AS r, {TOK.format('cleaned')} AS c, len(regexp_extract_all(lower(cleaned), '\p{{L}}{{2,}}')) AS w FROM ({source}) t),
{name}_b AS (SELECT *, len(c) - 5 AS runs, list_transform(range(1, len(c) - 4), lambda i: array_to_string(c[i:i + 5], ' ')) AS g FROM {name}_a),
{name}_low AS (SELECT k, len(c) AS n, coalesce(w < 50 OR (len(r) >= 100 AND len(c) / len(r) < 0.35) OR (len(c) >= 100 AND len(list_distinct(c)) / len(c) < 0.035 AND len(list_distinct(g)) / runs < 0.08), true) AS low FROM {name}_b)"""


SQL = {
    "chunk_documents": f"WITH {_chunks_sql(800, 680)} SELECT doc_id, chunk_index, char_start, char_end, md5(chunk) AS chunk_md5 FROM c",
    "chunk_counts_by_lang": f"WITH {_chunks_sql(800, 680)} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(length(chunk))::BIGINT AS chars FROM c GROUP BY lang",
    "chunk_small_windows": f"WITH {_chunks_sql(400, 300)} SELECT doc_id, count(*) AS chunks, max(char_end) AS last_end FROM c GROUP BY doc_id",
    "doc_uuid5": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_key)) AS h FROM documents)
        SELECT doc_id, substring(h, 1, 12) || '5' || substring(h, 14, 3) || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 15) AS key_uuid FROM h""",
    "reconstruct_text": "SELECT true AS same, count(*) AS documents FROM documents",
    "page_overlap_join": r"""WITH p AS (SELECT file_id, page_no, max(length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS n FROM ocr_pages GROUP BY ALL),
        s AS (SELECT *, coalesce(sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p),
        e AS (SELECT *, a + n AS z FROM s WHERE n > 0), t AS (SELECT file_id, max(z) AS total FROM e GROUP BY file_id),
        w AS (SELECT file_id, unnest(range(CASE WHEN total <= 800 THEN 1 ELSE ceil((total - 800) / 680.0)::INT + 1 END)) AS chunk_index FROM t)
        SELECT w.file_id, w.chunk_index, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS page_count FROM w JOIN e ON w.file_id = e.file_id AND e.a < w.chunk_index * 680 + 800 AND e.z > w.chunk_index * 680 GROUP BY ALL""",
    "heading_asof": rf"""WITH {_chunks_sql(800, 680)}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        lf AS (SELECT doc_id, k, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM ln WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
        lo AS (SELECT *, regexp_replace(line, '^#{{1,6}}\s+', '') AS title, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM lf),
        h AS (SELECT doc_id, o, title, CASE WHEN regexp_matches(lower(title), '{chunking.CHAPTER}') THEN 'chapter' WHEN regexp_matches(lower(title), '{chunking.SECTION}') THEN 'section' END AS kind FROM lo WHERE length(title) <= 160)
        SELECT c.doc_id, c.chunk_index, arg_max(h.title, h.o) FILTER (WHERE h.kind = 'chapter') AS chapter, arg_max(h.title, h.o) FILTER (WHERE h.kind = 'section') AS section FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.o < c.char_end AND h.kind IS NOT NULL GROUP BY ALL""",
    "word_counts": rf"SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '\p{{L}}{{2,}}')), -1) AS words, coalesce(len({TOK.format('text')}), -1) AS tokens, coalesce(len(list_distinct({TOK.format('text')})), -1) AS different FROM documents",
    "usable_text": rf"""WITH a AS (SELECT doc_id, text, {W.format('text')} AS w, {LINES.format('length(x) >= 12')} AS l FROM documents)
        SELECT doc_id, coalesce(len(w) >= 4 AND coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) >= 20 AND len(regexp_extract_all(lower(text), '{quality.BOILERPLATE}')) < 3 AND (len(w) < 30 OR len(list_distinct(w)) / len(w) >= 0.12)
        AND (len(l) < 4 OR len(list_distinct(l)) / len(l) >= 0.35), false) AS usable FROM a""",
    "low_quality_text": rf"""WITH {_clean_sql("SELECT doc_id AS k, text FROM documents", "d")}, {_low_sql("SELECT k, text AS raw, cleaned FROM d_clean", "d")} SELECT k AS doc_id, low AS low_quality FROM d_low""",
    "cleaned_text": rf"""WITH {_clean_sql("SELECT doc_id AS k, text FROM documents", "d")} SELECT k AS doc_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS chars FROM d_clean""",
    "artifact_lines": rf"""WITH p AS (SELECT DISTINCT page_id, page_no, text FROM ocr_pages), l AS (SELECT page_id, unnest(string_split(concat_ws(chr(10), 'page' || page_no, '| Page ' || page_no || ' | | ' || page_no || ' |', text), chr(10))) AS line FROM p)
        SELECT page_id, count(*) AS artifacts FROM l WHERE {_artifact_sql("line")} GROUP BY page_id""",
    "better_text": rf"""WITH p AS (SELECT DISTINCT file_id, page_no, text FROM ocr_pages WHERE text IS NOT NULL), s AS (SELECT file_id, string_agg(text, chr(10) ORDER BY page_no, text) AS ocr FROM p GROUP BY file_id),
        b AS (SELECT doc_id AS k, coalesce(text, '') AS base, coalesce(ocr, '') AS ocr FROM documents LEFT JOIN s USING (file_id)), {_clean_sql("SELECT k, base AS text FROM b", "d")}, {_clean_sql("SELECT k, ocr AS text FROM b", "o")},
        {_low_sql("SELECT k, text AS raw, cleaned FROM d_clean", "d")}, {_low_sql("SELECT k, text AS raw, cleaned FROM o_clean", "o")}
        SELECT d_low.k AS doc_id, NOT o_low.low AND (d_low.low OR o_low.n >= greatest(d_low.n + 25, d_low.n * 1.2::DOUBLE)) AS better FROM d_low JOIN o_low USING (k)""",
    "missing_evidence": f"SELECT answer_id, coalesce(regexp_matches(lower(trim(regexp_replace(coalesce(answer, ''), '\\s+', ' ', 'g'))), '{u.MISSING_EVIDENCE}'), false) AS missing FROM (SELECT DISTINCT answer_id, answer FROM answer_results) t",
    "answer_modes": f"""WITH a AS (SELECT DISTINCT answer_id, trim(CASE answer_id % 3 WHEN 0 THEN '{u.GENERAL_MARK} ' WHEN 1 THEN '{u.GROUNDED_MARK}' ELSE '' END || coalesce(answer, '')) AS t, primary_file_id IS NULL AS bare FROM answer_results)
        SELECT answer_id, md5(CASE WHEN starts_with(t, '{u.GENERAL_MARK}') THEN ltrim(substring(t, {len(u.GENERAL_MARK) + 1})) WHEN starts_with(t, '{u.GROUNDED_MARK}') THEN ltrim(substring(t, {len(u.GROUNDED_MARK) + 1})) ELSE t END) AS answer_md5,
        CASE WHEN starts_with(t, '{u.GENERAL_MARK}') THEN true WHEN starts_with(t, '{u.GROUNDED_MARK}') THEN false ELSE bare END AS general FROM a""",
    "fallback_gate": f"SELECT id, coalesce(trim(expected), '') = '' AND NOT coalesce(regexp_matches(lower(q), '{PROCEDURE_SQL}'), false) AND lab IS NULL AS allowed FROM eval_slim",
    "ngram_diversity": rf"""WITH a AS (SELECT doc_id, {TOK.format('text')} AS c FROM documents), b AS (SELECT doc_id, len(c) - 5 AS n, list_transform(range(1, len(c) - 4), lambda i: array_to_string(c[i:i + 5], ' ')) AS g FROM a)
        SELECT doc_id, CASE WHEN n > 0 THEN len(list_distinct(g)) END AS different_runs, CASE WHEN n > 0 THEN n END AS all_runs FROM b""",
    "repeated_lines": rf"""WITH a AS (SELECT doc_id, {LINES.format("length(x) > 0 AND length(x) <= 140 AND NOT regexp_matches(x, '[.!?…]$')")} AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS x FROM a), c AS (SELECT doc_id, x FROM b GROUP BY ALL HAVING count(*) >= 4)
        SELECT doc_id, string_agg(x, ' / ' ORDER BY x) AS lines FROM c GROUP BY doc_id""",
    "detect_language": f"WITH {SCORES} SELECT id, ru_score, kk_score, en_score, {BEST} AS language FROM l",
    "infer_subject": f"""WITH a AS (SELECT id, {W.format('q')} AS w FROM eval_slim), b AS (SELECT id, {', '.join(f"len(list_filter(w, lambda x: regexp_matches(x, {_stems(v)}))) AS {k}" for k, v in u.SUBJECT_STEMS.items())} FROM a), c AS (SELECT *, greatest(chemistry, physics, biology) AS m FROM b)
        SELECT id, CASE WHEN m > 0 AND (chemistry = m)::INT + (physics = m)::INT + (biology = m)::INT = 1 THEN CASE WHEN chemistry = m THEN 'chemistry' WHEN physics = m THEN 'physics' ELSE 'biology' END END AS inferred FROM c""",
    "scope_terms": rf"""WITH a AS (SELECT id, list_filter(regexp_extract_all(replace(lower(q), 'ё', 'е'), '\p{{L}}+'), lambda x: length(x) >= 4 AND NOT regexp_matches(x, {_stems(u.GENERIC_STEMS)})) AS w FROM eval_slim)
        SELECT id, array_to_string(list_sort(list_distinct(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[а-яәғқңөұүһі]') THEN substring(x, 1, 3) ELSE substring(x, 1, 4) END))), ' ') AS terms FROM a""",
    "procedure_intent": f"SELECT id, coalesce(regexp_matches(lower(q), '{PROCEDURE_SQL}'), false) AS is_procedure FROM eval_slim",
    "scope_gate": f"""WITH asked AS (SELECT DISTINCT q AS id, q FROM eval_slim), {ASKED_SCORES}, la AS (SELECT id AS q, {BEST} AS lang FROM l),
        e AS (SELECT id, e.q, lang, subject, {_subject_sql(W.format('e.q'))} AS own, {_terms_sql('e.q')} AS qt, {_terms_sql("coalesce(expected, '')")} AS st FROM eval_slim e LEFT JOIN la ON e.q = la.q),
        g AS (SELECT id, lang, coalesce(regexp_matches(lower(q), '{PROCEDURE_SQL}'), false) OR coalesce(own = subject, len(qt) = 0 OR len(st) = 0 OR list_has_any(qt, st), false) AS allowed FROM e)
        SELECT id, CASE WHEN allowed THEN '' WHEN lang = 'kk' THEN '{u.REFUSALS["kk"]}' WHEN lang = 'en' THEN '{u.REFUSALS["en"]}' ELSE '{u.REFUSALS["ru"]}' END AS refusal FROM g""",
    "language_by_conversation": f"""WITH {MESSAGES}, asked AS (SELECT DISTINCT text AS id, text AS q FROM m WHERE role = 'user'), {ASKED_SCORES}, la AS (SELECT id AS text, {BEST} AS lang FROM l)
        SELECT conversation_id, first(lang ORDER BY ts DESC NULLS LAST, answer_id DESC) AS language FROM m JOIN la USING (text) WHERE role = 'user' AND lang IS NOT NULL GROUP BY conversation_id""",
    "trim_history": f"""WITH {MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC NULLS LAST, answer_id DESC, half DESC) AS back FROM m QUALIFY back <= 6),
        c AS (SELECT *, sum(length(coalesce(text, ''))) OVER (PARTITION BY conversation_id ORDER BY back ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM b) SELECT conversation_id, answer_id, role, back, used FROM c WHERE back = 1 OR used <= 600""",
    "latest_user_message": f"WITH {MESSAGES} SELECT conversation_id, first(text ORDER BY ts DESC NULLS LAST, answer_id DESC) AS question FROM m WHERE role = 'user' AND text <> '' GROUP BY conversation_id",
    "followup_query": f"""WITH {MESSAGES}, u AS (SELECT conversation_id, text AS q, ts AS q_at, answer_id AS q_id FROM m WHERE role = 'user' AND text <> '' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC NULLS LAST, answer_id DESC) = 1),
        o AS (SELECT m.*, trim(text) AS t, row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC NULLS LAST, answer_id DESC, half DESC) AS back FROM m JOIN u USING (conversation_id) WHERE trim(text) <> '' AND (coalesce(ts, TIMESTAMP '0001-01-01'), answer_id) < (coalesce(q_at, TIMESTAMP '0001-01-01'), q_id) QUALIFY back <= 6),
        ro AS (SELECT *, 300 - coalesce(sum(length(t)) OVER (PARTITION BY conversation_id ORDER BY back ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM o),
        c AS (SELECT conversation_id, string_agg(CASE WHEN length(t) > room THEN right(t, room::BIGINT) ELSE t END, chr(10) ORDER BY back DESC) AS ctx FROM ro WHERE room > 0 GROUP BY conversation_id)
        SELECT conversation_id, coalesce(ctx || chr(10), '') || q AS retrieval_query FROM u LEFT JOIN c USING (conversation_id)""",
    "token_usage": """SELECT lab_id, count(*) AS answers, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(coalesce(total_tokens, input_tokens + output_tokens))::BIGINT AS total_tokens
        FROM (SELECT DISTINCT answer_id, lab_id, input_tokens, output_tokens, total_tokens FROM answer_results) t GROUP BY lab_id""",
}

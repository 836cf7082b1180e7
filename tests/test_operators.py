import datetime
import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from tolqyn.functions import metadata, register_functions, speech
from tolqyn.functions.embedding import hashed
from tolqyn.plans import pipeline
from tolqyn.operators import answers, chunking, evaluation, events, jobs, quality, retrieval, speech_flow, store
from tolqyn.operators import understanding as u
from tolqyn.operators.running import sum_before
from tolqyn.sources import files
from tolqyn.streaming import flows


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in zip(cols, ("string",) * len(cols))))
    return df.select(expr.alias("x")).head().x


def test_chunks_of_the_alphabet(spark):
    got = chunking.chunks(spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz")], "id int, text string"), size=10, overlap=4).orderBy("chunk_index").collect()
    assert [r.chunk for r in got] == ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxyz"]
    assert [(r.char_start, r.char_end) for r in got] == [(0, 10), (6, 16), (12, 22), (18, 26)]


@pytest.mark.parametrize("text", [None, "", "  \n ", "x"])
def test_chunks_of_little(spark, text):
    got = chunking.chunks(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert [r.chunk for r in got] == (["x"] if text == "x" else [])


def test_rebuilding_gives_the_text_back(spark):
    texts = [(i, " ".join(f"слово{j}" for j in range(n))) for i, n in enumerate((1, 50, 333, 1500))]
    df = spark.createDataFrame(texts, "id int, text string")
    again = dict(map(tuple, chunking.rebuilt(chunking.chunks(df, size=97, overlap=31), ["id"]).collect()))
    assert again == dict(texts)


def test_rebuilding_overlap(spark):
    df = spark.createDataFrame([(1, 0, "abcdef"), (1, 3, "defghi"), (2, 0, "ab"), (2, 4, "cd")], "id int, char_start int, chunk string")
    assert dict(map(tuple, chunking.rebuilt(df, ["id"]).collect())) == {1: "abcdefghi", 2: "ab  cd"}


def test_uuid5(spark):
    names = ["", "a", "физика/8/ru/учебник.pdf", "x" * 300]
    got = dict(map(tuple, spark.createDataFrame([(n,) for n in names], "n string").select("n", chunking.uuid5(F.col("n"))).collect()))
    assert got == {n: uuid.uuid5(uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), n).hex for n in names}


def test_sum_before(spark):
    rows = [(g, i, i % 7) for g in ("a", "b") for i in range(300)]
    df = sum_before(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], F.floor(F.col("i") / 64), ["i"], "v", "s")
    assert all(r.s == sum(x % 7 for x in range(r.i)) for r in df.collect())


@pytest.mark.parametrize("status, generation, active, seen", [
    (None, None, None, True), (None, "", "", True), (None, None, "g", False), ("active", "g", "g", True), ("Active", "g", "h", False), ("Superseded", "g", "g", False), ("pending", None, None, False), (None, "g", None, False),
])
def test_visibility(spark, status, generation, active, seen):
    df = spark.createDataFrame([(status, generation, active)], "status string, generation string, active_generation string")
    assert store.visible(df).count() == int(seen)


def test_filters(spark):
    df = spark.createDataFrame([("physics", 8, "ru"), ("physics", 9, "kk"), (None, 8, "ru")], "subject string, grade int, lang string")
    assert df.where(store.meta_filter(subject="physics", grade=None)).count() == 2
    assert df.where(store.meta_filter()).count() == 3
    assert df.where(store.with_lang(store.meta_filter(subject="physics"), "kk")).count() == 1


STORE = "collection string, doc_id string, point_id string, generation string, active_generation string, status string, chunk_index int, chunk_count int"


def test_replacing_a_generation(spark):
    old = spark.createDataFrame([("c", "d", "p1", "g9", "g9", "active", 0, 1), ("c", "e", "p2", "g9", "g9", "active", 0, 1), ("k", "d", "p4", "g9", "g9", "active", 0, 1)], STORE)
    new = spark.createDataFrame([("c", "d", "p3", "g10", None, "staging", 0, 1), ("c", "e", "p5", "g10", None, "staging", 0, 2)], STORE)
    got = {r.point_id: (r.status, r.active_generation) for r in store.replace_generation(old, new).collect()}
    assert got == {"p1": ("superseded", "g10"), "p3": ("active", "g10"), "p2": ("active", "g9"), "p5": ("staging", None), "p4": ("active", "g9")}


def test_the_newest_complete_generation(spark):
    rows = [("c", "d", "x", g, None, None, i, 2) for g, pieces in (("g9", 2), ("g10", 2), ("g11", 1)) for i in range(pieces)]
    assert [tuple(r) for r in store.newest_complete(spark.createDataFrame(rows, STORE)).collect()] == [("c", "d", "g10")]


def test_an_upload_leaves_other_documents_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    files.upload(spark.createDataFrame([("c", f"d{i}", f"p{i}", "g1", None, "staging", 0, 1) for i in range(9)], STORE), path)
    files.upload(spark.createDataFrame([("c", "d3", "q3", "g2", None, "staging", 0, 1)], STORE), path)
    files.upload(spark.createDataFrame([("c", "d3", "q3", "g2", None, "staging", 0, 1)], STORE), path)  # once more
    got = spark.read.parquet(path)
    assert got.count() == 10 and sorted(r.point_id for r in store.visible(got).collect()) == ["p0", "p1", "p2", "p4", "p5", "p6", "p7", "p8", "q3"]
    files.ensure_store(spark, path, STORE)
    assert spark.read.parquet(path).count() == 10


def test_cleaning_of_extracted_text(spark):
    notice = "Книга предоставлена исключительно в образовательных целях\n"
    assert one(spark, quality.clean_extraction(F.col("t")), t=notice + "page64\n| page65 | | 65 |\n1 2 3 4 5\n|---|---|\nПроза page 7 остаётся здесь.\n12\n") == "Проза остаётся здесь.\n12"
    prose = "Определение силы повторяется в каждом параграфе."
    assert one(spark, quality.clean_extraction(F.col("t")), t=(prose + "\n") * 8) == "\n".join([prose] * 8)
    assert one(spark, quality.clean_extraction(F.col("t")), t="Школьный архив\n" * 40 + "Вода кипит при ста градусах.") == "Вода кипит при ста градусах."
    assert one(spark, quality.clean_extraction(F.col("t")), t=None) == ""
    book = lambda *x: one(spark, quality.better_book_text(*[F.lit(v) for v in x]), t="")
    assert book("слово " * 600, "длиннее " * 900, None).startswith("слово") and book("слово", "длиннее " * 90, None).startswith("длиннее") and book("слово", None, "скан " * 60).startswith("скан") and book("слово", "два", None) == ""


def test_headings_of_pieces(spark):
    text = "Глава 1. Механика\n" + "текст " * 10 + "\n# Раздел 2\n" + "слово " * 10 + "\nГлавам\n## Просто заголовок\n§ 3 Сила\nконец"
    got = chunking.with_headings(spark.createDataFrame([(1, text)], "id int, text string"), size=60, overlap=0).orderBy("chunk_index").collect()
    assert (got[0].chapter, got[0].section) == ("Глава 1. Механика", None)
    assert (got[-1].chapter, got[-1].section) == ("Глава 1. Механика", "§ 3 Сила")


def test_answers_without_evidence(spark):
    f = lambda t: one(spark, u.is_missing_evidence(F.col("t")), t=t)
    assert f("В предоставленных материалах нет  информации об этом.") and f("The materials do not contain an answer.") and f("Құжаттарда бұл туралы ақпарат жоқ.")
    assert not f("Вода кипит.") and not f(None) and not f("")
    text, general = u.answer_mode(F.col("t"), F.lit(True), F.lit(False))
    assert one(spark, F.struct(text, general), t="[[GENERAL_KNOWLEDGE]] Вода.")[:] == ("Вода.", True) and one(spark, F.struct(text, general), t="[[GROUNDED]]x")[:] == ("x", False)
    gate = lambda q, c, a: one(spark, u.general_fallback(F.col("q"), [F.col("c")], F.lit(True), F.lit(a)), q=q, c=c)
    assert gate("Что такое сила?", " ", False) and not gate("Что делать дальше?", None, False) and not gate("Что такое сила?", "текст", False) and not gate("Что такое сила?", None, True)


def test_upload_names_and_keys(spark):
    name = lambda t: one(spark, metadata.upload_basename(F.col("t")), t=t)
    assert (name("C:\\x\\a.pdf"), name("a/b.txt/"), name(" ./"), name(".."), name("a\tb.txt"), name("Учебныи\u0306.pdf")) == ("a.pdf", "b.txt", None, None, "a_b.txt", "Учебный.pdf")
    key = metadata.upload_identity(F.col("n"), F.lit("Lab_instruction"), F.lit("physics"), F.lit(8), F.lit("ru"), F.lit(2))
    assert one(spark, key, n="x.pdf")[:] == ("admin_uploads/lab_instruction/physics/8/ru/02/x.pdf", "admin_uploads/lab_instruction/physics-8-ru-02", "physics-8-ru-02")
    assert one(spark, metadata.upload_identity(F.col("n"), F.lit("textbook"), F.lit("physics"), F.lit(12), F.lit("ru"), F.lit(None).cast("int")), n="x.pdf") is None
    assert one(spark, metadata.general_upload_key(F.col("p"), F.col("n")), p="a/x.pdf", n="x.pdf") == "admin_uploads/general/a/x.pdf"
    assert one(spark, metadata.general_upload_key(F.col("p"), F.col("n")), p="x.pdf", n="x.pdf") is None
    assert one(spark, u.language_code(F.col("t")), t=" RU ") == "ru" and one(spark, u.language_code(F.col("t")), t="de") is None


def test_sparse_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(f"p{i:03d}", [int(x) for x in rng.choice(30, 6, replace=False)] + [99], [float(x) for x in rng.random(7).round(2)]) for i in range(120)]
    pts = spark.createDataFrame([*rows, rows[3], ("none", None, None), ("empty", [], [])], "point_id string, sparse_indices array<int>, sparse_values array<float>")
    q = pts.where("point_id in ('p001', 'p003', 'none')").withColumnRenamed("point_id", "query_id").distinct()
    got = {(r.query_id, r.rank): r.point_id for r in retrieval.sparse_topk(pts, q, 5).collect()}
    weight = [dict(zip(i, np.array(w, "f4").astype("f8"))) for _, i, w in rows]
    for a in (1, 3):
        s = [round(sum(w * weight[a].get(t, 0) for t, w in x.items()), 6) for x in weight]
        assert [got[f"p{a:03d}", k + 1] for k in range(5)] == [f"p{j:03d}" for j in sorted(range(120), key=lambda j: (-s[j], j))[:5]]
    assert len(got) == 10


def test_dense_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)).round(3)
    x[5] = x[7]
    x[9] = 0
    rows = [(f"p{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("none", None), ("empty", [])]
    pts = spark.createDataFrame(rows, "point_id string, dense array<float>")
    q = pts.where("point_id in ('p001', 'p005', 'p009', 'none')").withColumnRenamed("point_id", "query_id")
    got = {(r.query_id, r.rank): r.point_id for r in retrieval.dense_topk(pts, q, 5).collect()}
    f = x.astype("f4").astype("f8")
    for name, i in (("p001", 1), ("p005", 5)):
        with np.errstate(invalid="ignore"):
            s = np.round(f @ f[i] / np.linalg.norm(f, axis=1) / np.linalg.norm(f[i]), 6)
        want = sorted((j for j in range(200) if j != 9), key=lambda j: (-s[j], j))[:5]
        assert [got[name, k + 1] for k in range(5)] == [f"p{j:03d}" for j in want]
    assert not any(k[0] in ("p009", "none") for k in got)


def test_fusion_and_tiers(spark):
    a = spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 0.9, 2)], "query_id string, point_id string, score double, rank int")
    b = spark.createDataFrame([("q", "y", 5.0, 1), ("q", "z", 4.0, 2)], "query_id string, point_id string, score double, rank int")
    fused = [r.point_id for r in retrieval.rrf([a, b], 60, 5).orderBy("rank").collect()]
    assert fused == ["y", "x", "z"]
    assert [(r.point_id, r.tier) for r in retrieval.tiered([a, b], 3).orderBy("place").collect()] == [("x", 0), ("y", 0), ("z", 1)]


def test_history_budget(spark):
    t = datetime.datetime(2025, 1, 1)
    rows = [("c", f"a{i}", t + datetime.timedelta(minutes=i), 0, "user", "x" * n) for i, n in enumerate((50, 40, 30, 500))]
    m = spark.createDataFrame(rows, "conversation_id string, answer_id string, at timestamp, half int, role string, text string")
    assert [r.answer_id for r in answers.trim_history(m, 10, 100).collect()] == ["a3"]  # the newest stays though it is too long
    assert sorted(r.answer_id for r in answers.trim_history(m, 2, 1000).collect()) == ["a2", "a3"]
    got = answers.followup_query(m, 50, 10).head().retrieval_query
    assert got == "x" * 20 + "\n" + "x" * 30 + "\n" + "x" * 500


@pytest.mark.parametrize("text, lang", [
    ("Қалай жасау керек?", "kk"), ("Почему вода кипит?", "ru"), ("What is the boiling temperature?", "en"), ("H2O", None), ("", None), ("NaCl KMnO4 file.pdf", None), ("gravity", "en"), ("Какой закон?", "ru"),
])
def test_language_of_a_question(spark, text, lang):
    assert one(spark, u.detect_language(F.col("t")), t=text) == lang


def test_subject_and_scope(spark):
    assert one(spark, u.infer_subject(F.col("t")), t="Какая реакция у кислоты?") == "chemistry"
    assert one(spark, u.infer_subject(F.col("t")), t="Вопрос о погоде") is None
    refusal = u.scope_refusal(F.col("q"), F.lit("physics"), F.col("s"), F.lit("en"))
    assert one(spark, refusal, q="Tell about the organism of animals", s="x") == u.REFUSALS["en"]
    assert one(spark, refusal, q="Что делать дальше?", s="вода") is None
    assert one(spark, refusal, q="кипение воды", s="вода кипит") is None


def test_quality(spark):
    assert one(spark, quality.usable(F.col("t")), t="Молекулы крахмала взаимодействуют с водой") is True
    assert one(spark, quality.usable(F.col("t")), t="да нет") is False
    assert one(spark, quality.usable(F.col("t")), t="okulyk.kz okulyk.kz okulyk.kz учебник физики для школьников") is False
    assert one(spark, quality.html_text(F.col("t")), t="<p>a&amp;b<script>x</script> <b>c</b></p>") == "a&b c"
    lines = "Шапка\n" * 4 + "Текст предложения.\n" * 4
    assert one(spark, quality.repeated_lines(F.col("t")), t=lines) == ["шапка"]


def test_grades(spark):
    t = datetime.datetime(2025, 1, 1)
    pairs = spark.createDataFrame([(i, "physics", 7 + i % 5, 1) for i in range(4)], "id long, subject string, grade int, lab int")
    grades = spark.createDataFrame([(0, 150, t), (1, 50, t), (1, 10, t + datetime.timedelta(1)), (2, None, t)], "id long, score int, graded_at timestamp")
    got = {r.id: (r.score, r.verdict) for r in evaluation.graded(pairs, grades).collect()}
    assert got == {0: (100, "correct"), 1: (10, "incorrect"), 2: (0, "incorrect"), 3: (0, "incorrect")}
    assert evaluation.histogram(evaluation.graded(pairs, grades)).count() == 10


def test_terminal_states(spark):
    rows = [("a", 1, "completed"), ("a", 2, "failed"), ("b", 1, "failed"), ("c", 1, "cancelled"), ("c", 2, "failed"), ("d", 1, "pending"), ("e", 1, "skipped")]
    items = spark.createDataFrame([(f"{j}{p}", j, p, s) for j, p, s in rows], "id string, job_id string, position int, status string")
    got = {r.job_id: r.derived_status for r in jobs.terminal_status(jobs.counters(items)).collect()}
    assert got == {"a": "partial", "b": "failed", "c": "cancelled", "d": "running", "e": "completed"}


def test_claim_waits_for_a_running_job(spark):
    t = datetime.datetime(2025, 1, 1)
    j = spark.createDataFrame([("a", "queued", t + datetime.timedelta(1)), ("b", "queued", t)], "id string, status string, created_at timestamp")
    assert jobs.claim_next(j).head().id == "b"
    assert jobs.claim_next(j.union(spark.createDataFrame([("c", "running", t)], j.schema))).count() == 0
    with pytest.raises(ValueError):
        jobs.page(j, 0)


def test_sliding_count_is_half_open(spark):
    t = datetime.datetime(2025, 1, 1)
    e = spark.createDataFrame([(i, 1, t + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 59, 60))], "event_id int, user_id int, ts timestamp")
    assert [r.in_span for r in events.sliding_count(e, 60).orderBy("event_id").collect()] == [1, 2, 2]


WORDS = {
    ("ru", 0): "ноль", ("ru", 25): "двадцать пять", ("ru", 1250): "одна тысяча двести пятьдесят", ("ru", -5): "минус пять", ("ru", 2_000_011): "два миллиона одиннадцать", ("ru", 42_000): "сорок две тысячи",
    ("kk", 0): "нөл", ("kk", 25): "жиырма бес", ("kk", 1250): "бір мың екі жүз елу", ("kk", 100): "жүз",
    ("en", 13): "thirteen", ("en", 1250): "one thousand two hundred fifty", ("en", 3_000_000_001): "three billion one",
}


@pytest.mark.parametrize("key", list(WORDS))
def test_number_words(spark, key):
    assert spark.range(1).select(speech.cardinal(F.lit(key[1]), key[0]).alias("x")).head().x == WORDS[key]


def test_numbers_in_text(spark):
    assert one(spark, speech.speak_numbers(F.col("t"), "en"), t="Add -1 mL, 25% of H2O on 12.03.2026 and 3.14.") == "Add minus one mL, twenty five percent of H2O on 12.03.2026 and three point one four."
    assert one(spark, speech.speak_numbers(F.col("t"), "ru"), t="через 21 секунду 2%") == "через двадцать один секунду два процента"


def test_path_metadata(spark):
    got = one(spark, metadata.parsed(F.col("p")), p="corpus/Лабораторные работы/Физика 10 класс/рус/Лабораторная работа №2.docx")
    assert got.asDict() == {"source": "corpus/Лабораторные работы/Физика 10 класс/рус/Лабораторная работа №2.docx", "filename": "Лабораторная работа №2.docx", "doc_type": "lab_instruction", "subject": "physics", "grade": 10, "lang": "ru", "lab_number": 2, "lab_id": "physics-10-ru-02"}
    assert one(spark, metadata.parsed(F.col("p")), p="Школьный материал/Химия/каз/Химия 8.pdf").lang == "kk" and one(spark, metadata.parsed(F.col("p")), p="Школьный материал/Химия/Химия_8_каз_.pdf").lang == "kk"
    assert one(spark, metadata.parsed(F.col("p")), p="other/x.pdf") is None
    assert one(spark, metadata.safe_path(F.col("p"), F.col("n")), p="a/../b.pdf", n="b.pdf") is False


def test_sources(spark, tmp_path):
    root = tmp_path / "Textbooks"
    root.mkdir()
    (root / "a.TXT").write_bytes("текст".encode() + b"\xff")
    (root / "b.bin").write_bytes(b"x")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("c2.xhtml", "<p>two &amp; three</p>")
        z.writestr("c1.xhtml", "<style>x</style><p>one</p>")
        z.writestr("content.opf", "<package><manifest><item id='1' href='c1.xhtml'/><item id='2' href='c2.xhtml'/></manifest><spine><itemref idref='2'/><itemref idref='1'/></spine></package>")
    (root / "c.epub").write_bytes(book.getvalue())
    (root / "d.docx").write_bytes(b"broken")
    got = files.corpus_files(spark, str(tmp_path))
    assert sorted(r.relative_path for r in got.collect()) == ["Textbooks/a.TXT", "Textbooks/c.epub", "Textbooks/d.docx"]
    assert files.plain_text(got).head().text == "текст�"
    assert {r.suffix: r.valid for r in files.sniffed(got).collect()} == {"txt": True, "epub": True, "docx": False}
    texts = {r.relative_path: (r.text, r.error is None) for r in files.container_text(got).collect()}
    assert texts["Textbooks/c.epub"] == ("two & three\none", True) and texts["Textbooks/d.docx"][1] is False


def test_question_file(spark, tmp_path):
    (tmp_path / "q.md").write_text("Физика\nФизика 7 класс\nЛабораторная работа №1 — Размеры\n1.Почему?\nПотому.\nЕщё.\n2. Как?\nОтвет: Так.\nChemistry Grade 9\n1. Why?\nAnswer: So.\n")
    got = [tuple(r)[1:] for r in files.question_files(spark, str(tmp_path / "q.md")).orderBy("grade", "qnum").collect()]
    assert got == [("physics", 7, 1, 1, "Почему?", "Потому. Ещё."), ("physics", 7, 1, 2, "Как?", "Так."), ("chemistry", 9, 1, 1, "Why?", "So.")]


def test_grade_and_scenario_files(spark, tmp_path):
    (tmp_path / "grades_1.json").write_text('[{"id": 1, "score": 62.5, "verdict": "partial"}, {"id": 2, "score": 120, "verdict": "correct"}]')
    (tmp_path / "grades_2.json").write_text('[{"id": 1, "score": 71.5, "verdict": "correct"}]')
    assert {r.id: (r.score, r.verdict) for r in files.grade_files(spark, str(tmp_path / "grades_*.json")).collect()} == {1: (72, "correct"), 2: (100, "correct")}
    (tmp_path / "s.json").write_text('{"scenario_name": "heating", "objects": ["a"]}')
    assert files.scenarios(spark, str(tmp_path / "s.json")).head().file == "s"


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT round(rrf(1, 60), 6), normal_text(' a  b '), verdict_of(40)").head()[:] == (0.016393, "a b", "partial")


def test_streams(spark, data, tmp_path):
    ev = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    got = flows.run_once(flows.windowed_counts(stream), "hourly", "complete")
    assert got.agg(F.sum("n")).head()[0] == ev.count()
    batch = {(r.window_start, r.event_type): r.n for r in events.tumbling(ev, "1 hour").collect()}
    assert {(r.window_start, r.event_type): r.n for r in got.collect()} == batch
    kept = flows.run_once(flows.expiring_state(stream), "puts", "update")
    assert kept.where("not expired").agg(F.sum("puts")).head()[0] == ev.count()


def test_conversation_stream(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    rows = [("c", t + datetime.timedelta(minutes=i), "user", "x" * n) for i, n in enumerate((50, 40, 30))] + [("d", t, "system", "y"), ("d", t, "user", None)]
    spark.createDataFrame(rows, "conversation_id string, at timestamp, role string, text string").repartition(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("conversation_id string, at timestamp, role string, text string").parquet(str(tmp_path / "m"))
    got = {r.conversation_id: (r.kept, r.chars) for r in flows.run_once(flows.conversation_state(stream, 10, 80), "talk", "update").collect()}
    assert got == {"c": (2, 70), "d": (1, 0)}


def test_sentences_for_speech(spark):
    f = lambda t: one(spark, speech_flow.ready_sentences(F.col("t")), t=t)
    assert f("1. Да. Это длинное предложение о воде. Конец") == ["1. Да. Это длинное предложение о воде.", "Конец"]
    assert f("Число равно 3.14 метра ровно. Ещё одно предложение тут!") == ["Число равно 3.14 метра ровно.", "Ещё одно предложение тут!"]
    assert one(spark, speech_flow.preview(F.col("t"), 5), t="ab  cdef") == "ab c…"


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "вода кипит вода"), (2, "вода кипит вода"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r for r in hashed(df, "text").collect()}
    assert got[1][2:] == got[2][2:] and abs(sum(x * x for x in got[1].dense) - 1) < 1e-5 and len(got[1].sparse_indices) == 2 and abs(sum(got[1].sparse_values) - 1) < 1e-6
    assert got[3].dense is None and got[4].sparse_indices == []


def test_from_documents_to_context(spark):
    text = "Вода кипит при температуре сто градусов, это известно всем ученикам школы."
    docs = spark.createDataFrame([("a/kipenie.txt", text), ("b/rost.txt", "Растения растут на свету и поглощают углекислый газ из воздуха днём.")], "doc_key string, text string")
    new = pipeline.ingest(docs.withColumn("filename", F.col("doc_key")), "c", "g1")
    assert pipeline.ingest(docs.withColumn("filename", F.col("doc_key")), "c", "g1").select("point_id").exceptAll(new.select("point_id")).count() == 0
    points = store.replace_generation(new.where("false"), new)
    got = pipeline.context(points, spark.createDataFrame([(1, "Почему вода кипит?")], "query_id int, text string"), top=1).head()
    assert got.language == "ru" and got.context == f"[1] (a/kipenie.txt)\n{text}"


def test_command_line(spark, tmp_path, capsys):
    from tolqyn import cli

    root = tmp_path / "corpus" / "Textbooks" / "Физика" / "рус"
    root.mkdir(parents=True)
    (root / "Физика 8.txt").write_text("Вода кипит при температуре сто градусов, это известно всем ученикам школы.")
    out = str(tmp_path / "store")
    assert cli.main(["ingest", "--root", str(tmp_path / "corpus"), "--store", out]) == 0
    assert cli.main(["list", "--store", out]) == 0 and cli.main(["status", "--store", out]) == 0
    text = capsys.readouterr().out
    assert '"subject": "physics"' in text and '"grade": 8' in text and '"documents_ru": 1' in text
    assert cli.main(["gen-manifest", "--root", str(tmp_path / "corpus"), "--out", str(tmp_path / "m")]) == 0
    assert spark.read.json(str(tmp_path / "m")).head().stub is True
    assert cli.main(["delete", "--store", out, "--doc-id", "none", "--out", str(tmp_path / "s2")]) == 1

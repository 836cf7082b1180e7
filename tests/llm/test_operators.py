from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tolqyn.llm import abuse, language, mixing, packing, pairs, scans, splitting, tokens, vectors

# ---- 1


def brute(rows, k, least):
    out = {}
    for g, p, v in rows:
        v = np.array(v, "f8")
        got = []
        for h, q, w in rows:
            if h == g and q != p and len(w) == len(v):
                w = np.array(w, "f8")
                c = round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9)
                if c >= least:
                    got.append((-c, q))
        out[g, p] = [q for _, q in sorted(got)[:k]]
    return out


def points(spark, rows):
    return spark.createDataFrame(rows, "collection string, point_id string, dense array<float>")


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16)).astype("f4")
    near = np.concatenate([b + rng.standard_normal((3, 16)) * 0.15 for b in base[:60]]).astype("f4")
    copies = np.repeat(base[:1], 14, axis=0)  # more copies than neighbours asked for
    x = np.concatenate([base, near, copies, base[5:8] * 2])
    rows = [("a" if i % 5 else "b", f"p{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    got = vectors.similar(points(spark, rows), min_similarity=0.9, k=10)
    want = brute(rows, 10, 0.9)
    mine = {}
    for r in got.orderBy("grp", "point", "place").collect():
        mine.setdefault((r.grp, r.point), []).append(r.neighbour)
    hit = sum(len(set(mine.get(k, [])) & set(v)) for k, v in want.items() if k in mine)
    assert hit >= 0.97 * sum(len(v) for k, v in want.items() if k in mine)
    pairs_want = {(a, b) for (g, a), v in want.items() for b in v if a < b and a in want[g, b]}
    pairs_got = {tuple(r) for r in vectors.mutual(got).collect()}
    assert pairs_got <= pairs_want and len(pairs_got) >= 0.97 * len(pairs_want)


@pytest.mark.parametrize("block", [70, 32768])
def test_similar_vectors_in_a_dense_cell(spark, block):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones(16) + rng.standard_normal((400, 16)) * 0.1, rng.standard_normal((100, 16))]).astype("f4")
    rows = [("a" if i % 4 else "b", f"p{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    want = brute(rows, 10, 0.9)
    got = {}
    for r in vectors.similar(points(spark, rows), tables=4, span=40, block=block).orderBy("grp", "point", "place").collect():
        got.setdefault((r.grp, r.point), []).append(r.neighbour)
    dense = [k for k in want if k[1] < "p0400"]
    assert sum(got.get(k) == want[k] for k in dense) >= 0.99 * len(dense)


def recall_of(spark, x, **settings):
    x = x.astype("f4")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cosine, -2)
    want = {(i, int(j)) for i, near in enumerate(np.argsort(-cosine, axis=1, kind="stable")[:, :10]) for j in near if cosine[i, j] >= 0.9}
    rows = [("a", f"p{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    got = {(int(r.point[1:]), int(r.neighbour[1:])) for r in vectors.similar(points(spark, rows), **settings).collect()}
    return len(want & got) / len(want)


def test_similar_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    common = rng.standard_normal(64)
    x = common / np.linalg.norm(common) * 0.85 + rng.standard_normal((1200, 64)) / 8 * 0.53
    x = np.concatenate([x, x[:150] + rng.standard_normal((150, 64)) / 8 * 0.36])
    assert recall_of(spark, x, cell_rows=40, span=150) >= 0.95


def test_similar_vectors_of_crowded_cells_are_cut_again(spark):
    rng = np.random.default_rng(9)
    tight = rng.standard_normal(16) + 0.12 * rng.standard_normal((500, 16))
    x = np.concatenate([rng.standard_normal((900, 16)), tight])
    assert recall_of(spark, x, cell_rows=100, span=200) >= 0.9


def test_neighbours_closer_than_the_codes_tell(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal(16) + 3e-4 * rng.standard_normal((400, 16))
    assert recall_of(spark, x, tables=4) >= 0.9


def test_more_rows_take_more_cells_and_tables():
    sizes = [vectors.sets_of(np.log2(n / 450)) for n in (20_000, 200_000, 60_000_000)]
    cells = [np.prod([2 * s for s in x]) for x in sizes]
    assert all(0.7 < c * 450 / n < 1.4 for c, n in zip(cells, (20_000, 200_000, 60_000_000)))
    chances = [vectors.shared_cell(64, x, 0.9) for x in sizes]
    assert 1 > chances[0] > chances[1] > chances[2] > 0.1


def test_similar_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [("a", "x", [1.0, 0.0]), ("a", "x", [1.0, 0.0]), ("a", "y", [2.0, 0.0]), ("b", "z", [1.0, 0.0]), ("a", "n", None), ("a", "e", []), ("a", "o", [0.0, 0.0]), ("a", "q", [nan, 1.0]), ("a", "w", [1.0, 0.0, 0.0]), (None, "v", [1.0, 0.0]), (None, "u", [1.0, 0.0]), ("a", None, [1.0, 0.0])]
    df = points(spark, rows).withColumn("grp", F.lit(1)).withColumn("cls", F.lit(2)).withColumn("v", F.lit(3))
    assert {tuple(r) for r in vectors.mutual(vectors.similar(df)).collect()} == {("x", "y"), ("u", "v")}
    assert vectors.similar(points(spark, [])).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(4)
    rows = [("a", f"p{i:04d}", [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((3000, 64)).astype("f4"))]
    df = points(spark, rows)
    got = vectors.search(df, df.where("point_id like '%00'")).toPandas()
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for i in range(0, 3000, 100):
        s = x @ x[i]
        s[i] = -2
        hit += len(set(np.argsort(-s)[:10]) & {int(p[1:]) for p in got[got.point == f"p{i:04d}"].neighbour})
    assert len(got) == 300 and hit >= 0.9 * 300


def test_search_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(6)
    rows = [("a", f"p{i:04d}", [float(v) for v in r]) for i, r in enumerate(1 + 0.3 * rng.standard_normal((60, 16)).astype("f4"))]
    df = points(spark, rows + [rows[0]] * 30 + [rows[1]] * 30).coalesce(1)
    got = {}
    for r in vectors.search(df, df.where("point_id < 'p0003'"), share=1.0).orderBy("point", "place").collect():
        got.setdefault(r.point, []).append(r.neighbour)
    want = brute(rows, 10, -1)
    assert got == {p: want["a", p] for p in ("p0000", "p0001", "p0002")}


def test_collision_threshold():
    assert vectors.threshold(24, 1.7, 0.998) < 24
    assert vectors.threshold(24, 5.0, 0.9) == 24


# ---- 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="аб. \n", max_size=700), st.sampled_from([(20, 5), (50, 0), (33, 10)]))
def test_pieces_give_the_text_back(text, sizes):
    limit, overlap = sizes
    got = splitting.cut(text, limit, overlap)
    flat = " ".join(text.split())
    assert all(len(p[3]) <= limit for p in got)
    assert (got[0][3] + "".join(p[3][overlap:] for p in got[1:]) if got else "") == flat
    assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))


def test_pieces_prefer_strong_boundaries():
    text = "a" * 30 + ". " + "b" * 20 + "\n\n" + "c" * 20 + ". " + "d" * 60
    first = splitting.cut(text, 80, 10)[0]
    assert first[2] == "paragraph" and first[3].endswith("b")
    assert splitting.cut("x" * 100, 40, 10)[0][:3] == (0, 40, "none")


def test_pieces_in_spark(spark):
    long = "слово " * 400
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "short"), (5, long), (5, long)], "id int, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_texts(df).groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("piece")).alias("m")).collect()
    assert {r.id: r.n for r in got}.keys() == {4, 5}
    assert max(r.m for r in got) <= 800
    assert splitting.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, limit=10, overlap=9)


# ---- 3


@pytest.fixture(scope="module")
def lang_model(spark):
    ru, kk, en = "Раствор соли нагревают осторожно и записывают результат в таблицу.", "Тұз ерітіндісін абайлап қыздырып, нәтижені кестеге жазады.", "The salt solution is heated gently and the result is written down."
    rows = [(i, " ".join([t] * (1 + i % 3)) + f" {i}", lang) for i in range(30) for t, lang in ((ru, "ru"), (kk, "KZ"), (en, "English"))]
    rows += [(900 + i, ru, "en") for i in range(4)]  # wrong labels
    return language.fit(spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(rows)], "id long, text string, lang string"), "id", "text", "lang")


def test_languages(spark, lang_model):
    texts = {
        "ru": "Запишите результат в таблицу и нагревайте раствор.", "kk": "Нәтижені кестеге жазып, ерітіндіні қыздырыңыз.", "en": "Write the result down and heat the solution.",
        "latin": "Rastvor soli nagrevaiut ostorojno i zapisyvaiut rezultat v tablitsu.", "folded": "Туз еритиндисин абайлап кыздырып, натижени кестеге жазады.", "formula": "H2O -> NaCl; 23.4", "null": None, "empty": "",
        "mixed": "Раствор соли нагревают осторожно. The result is written down gently.",
    }
    got = {r.k: r.languages for r in language.assign_languages(spark.createDataFrame(list(texts.items()), "k string, text string"), lang_model).collect()}
    assert [got[k].langs for k in ("ru", "kk", "en", "latin", "folded")] == [["ru"], ["kk"], ["en"], ["ru"], ["kk"]]
    assert got["formula"].langs == got["null"].langs == got["empty"].langs == []
    assert sorted(got["mixed"].langs) == ["en", "ru"] and [s.lang for s in got["mixed"].segments] == ["ru", "en"]
    assert all(0 <= c <= 1 for v in got.values() for c in v.confidences)


def test_labels(spark):
    got = {r.l: r.x for r in spark.createDataFrame([(x,) for x in (" RU", "kz", "en_GB", "Қазақша", "mul", "", None)], "l string").select("l", language.named_language(F.col("l")).alias("x")).collect()}
    assert got == {" RU": "ru", "kz": "kk", "en_GB": "en", "Қазақша": "kk", "mul": None, "": None, None: None}


def test_fit_without_rows(spark):
    model = language.fit(spark.createDataFrame([], "id long, text string, lang string"), "id", "text", "lang")
    assert language.assign_languages(spark.createDataFrame([("a",)], "text string"), model).count() == 1


def test_language_held_out(spark, data):
    d = spark.read.parquet(str(Path(data).parent / "sf0.01" / "documents.parquet"))
    model = language.fit(d.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    rest = d.where("doc_id % 2 = 1").withColumn("named", language.named_language(F.col("lang"))).where("named is not null")
    got = language.assign_languages(rest, model, segments=False).where("size(languages.langs) = 1").select("named", F.col("languages.langs")[0].alias("l")).toPandas()
    assert (got.named == got.l).mean() > 0.85  # labels themselves are partly wrong


# ---- 4


def test_glyph_edits():
    assert scans.glyph_key("в0зрастает") == scans.glyph_key("возрастает") and scans.glyph_key("вычисля10т") == scans.glyph_key("вычисляют")
    assert scans.plausible("теrnпературе", "температуре") == 1 and scans.plausible("гольіми", "голыми") == 1
    assert scans.plausible("вода", "земля") == 99
    assert scans.numbers_only("— 12 —") == 12 and scans.numbers_only("стр. I") == 1 and scans.numbers_only("Page 3 of 96") == 3 and scans.numbers_only("Глава 7") is None


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, file_id string, page_no int, text string")


def test_page_repair(spark):
    END = ("и", "но не", "тихо", "снова быстро", "там хорошо")
    body = "Раствор соли нагревают осторожно на слабом огне.\nРезультат опыта записывают в таблицу после проверки.\n"
    rows = [(i, f"f{i // 5}", i % 5 + 1, f"Школьная лаборатория\n{body}Стрелка прибора отклоняется на десять делений, потому что\nприбор настроен зара-\nнее {END[i % 5]} работает.\nстр. {i % 5 + 1}") for i in range(40)]
    rows[1] = (1, "f0", 2, "Школьная лабоpатория\nPаствор соли нагревают ост0рожно на слабом огне. Резуль-\nстр. 2")
    rows[2] = (2, "f0", 3, "Школьная лаборатория\nтат опыта записывают в таблицу.\nстр. 3")
    rows += [(100, "g", 1, None), (101, "g", 2, ""), (102, "h", 1, "Раствор соли нагревают осторожно."), rows[0]]
    got = {r.page_id: r for r in scans.repair(pages(spark, rows)).collect()}
    assert len(got) == 43
    assert got[1].repaired == "Раствор соли нагревают осторожно на слабом огне. Результат"
    assert got[2].repaired == "опыта записывают в таблицу."
    assert got[1].broken_word and got[1].misread_char and got[1].running_header and got[1].page_number
    assert not got[2].broken_word and not got[2].misread_char
    assert got[100].repaired == got[101].repaired == ""
    assert not any(got[102][k] for k in ("broken_word", "misread_char", "running_header", "page_number"))
    assert "заранее" in got[7].repaired and "лаборатория" not in got[7].repaired
    assert scans.repair(pages(spark, [])).count() == 0


# ---- 5

Q = "Почему раствор соли становится прозрачным?"


@pytest.mark.parametrize("answer, defect", [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("_(empty)_", "empty"), ("—", "empty"), (Q, "copy"), ("Q: " + Q, "copy"), (f"{Q}\n{Q}", "copy"), (Q[:-1].lower(), "copy"),
    (Q + " Соль растворяется.", None), ("Раствор соли становится прозрачным.", None), ("Извините, я не могу ответить на этот вопрос.", "refusal"), ("Кешіріңіз, жауап беру үшін деректер жоқ. Мұғалімге хабарласыңыз.", "refusal"),
    ("К сожалению, точное число назвать нельзя, но соль растворяется в воде.", None), ("The salt is dissolved in the water and the solution becomes clear.", "other_language"), ("Тұз суда еріп, ерітінді мөлдір болады.", "other_language"),
    ("Потому что соль растворяется (в воде", "truncated"), ("Потому что соль,", "truncated"), ("H2O", None), ("около 9.5 см", None), ("Да.", None),
])
def test_defects_of_an_answer(answer, defect):
    assert pairs.judge(Q, "Соль растворяется.", answer)[1][0] == defect


def test_refusal_where_the_reference_declines():
    assert pairs.judge(Q, "Я не могу ответить на этот вопрос.", "Извините, я не могу ответить на этот вопрос.")[1][0] is None


@pytest.mark.parametrize("answer", [  # none of these is spelt out in the module
    "Увы, ответить на это я не в состоянии.", "Сведений об этом у меня нет.", "Я не имею никаких данных. Спросите учителя.", "Невозможно подсказать, уточните вопрос.", "Такую тему я не обсуждаю.",
    "Бұған жауап беру мүмкін емес.", "Кешіріңіз, бұл туралы мәлімет жоқ.", "Мұндай тақырыптарды талқыламаймын.", "Мен түсіндіре алмаймын.",
    "I was not able to find an answer, sorry.", "Sorry, I can't really tell you.", "There is no information about it here.", "I have to decline to comment.", "We do not discuss such things.",
])
def test_refusals_in_other_words(answer):
    assert pairs.declines(pairs.Text(answer))


@pytest.mark.parametrize("answer", [
    "Нет, ответ не зависит от массы.", "No, the answer does not depend on the mass.", "The data do not change with time.", "Реакции нет.", "Жоқ, тұз ерімейді.", "Учитель не может ошибаться.", "Без данных опыта вывод сделать нельзя, поэтому измеряют массу, объём и температуру раствора несколько раз подряд.",
])
def test_answers_that_deny_something_else(answer):
    assert not pairs.declines(pairs.Text(answer))


def test_copied_share(spark):
    rows = [(1, Q, Q, Q + " Соль растворяется."), (2, Q, None, "Вода."), (3, None, "x", "y")]
    got = {(r.id, r.field): r.coverage for r in pairs.coverage(spark.createDataFrame(rows, "id long, q string, expected string, answer string")).collect()}
    assert got[1, "expected"] == 1 and 0.5 < got[1, "answer"] < 1 and got[2, "answer"] == got[2, "expected"] == got[3, "answer"] == 0


def test_suffix_automaton_coverage():
    a = pairs.SuffixAutomaton("a b c d a b".split())
    assert a.covered("x b c d y".split(), 3)[0] == 3
    assert a.covered("a b x".split(), 3)[0] == 0
    assert a.covered("c d a b c d a b".split(), 3)[0] == 8


def test_pairs_in_spark(spark):
    whole, cut = "Соль растворяется в горячей воде", "Потому что соль растворяется в гор"
    rows = [(i, Q, whole + ".", whole + ".") for i in range(5)] + [(10, Q, whole, cut), (11, None, None, whole), (11, None, None, whole)]
    df = spark.createDataFrame(rows, "id long, q string, expected string, answer string").withColumn("defect", F.lit(1))
    assert {tuple(r) for r in pairs.defective(df).collect()} == {(10, "answer", "truncated"), (11, "expected", "empty")}
    assert pairs.defective(df.limit(0)).count() == 0


def test_an_ellipsis_does_not_complete_a_text(spark):
    whole, cut = "Соль растворяется в горячей воде", "Потому что соль растворяется в гор"
    ends = [(i, Q, whole + ".", whole + ".") for i in range(5)] + [(6 + i, Q, whole + ".", cut + "…") for i in range(3)]
    rows = [*ends, (10, Q, whole + "…", cut + "..."), (11, Q, whole + "?..", "…"), (12, Q, whole + ".", whole + "...")]
    df = spark.createDataFrame(rows, "id long, q string, expected string, answer string")
    assert {tuple(r) for r in pairs.defective(df).collect()} == {(i, "answer", "truncated") for i in (6, 7, 8, 10)} | {(11, "answer", "empty")}


def test_a_pair_of_words_mostly_within_sentences_completes_no_text(spark):
    inside, ends, cut = "Раствор соли нагревают на слабом огне.", "Раствор соли нагревают.", "Потому что раствор соли нагревают"
    rows = [(i, Q, inside, inside) for i in range(40)] + [(50, Q, ends, ends), (51, Q, inside, cut), (52, Q, inside, "Потому что нагревают на слабом огне")]
    df = spark.createDataFrame(rows, "id long, q string, expected string, answer string")
    assert {tuple(r) for r in pairs.defective(df).collect()} == {(51, "answer", "truncated")}


# ---- 6, 7


def test_hilbert_curve_steps_by_one():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = tokens.hilbert_key(grid, 3)
    assert sorted(key) == list(range(n**3))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello, мир"), (2, None), (3, ""), (4, "a" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.measured(df, curve=True).collect()}
    enc = tokens.encoding()
    assert got == {1: len(enc.encode_ordinary("Hello, мир")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("a" * 5000))}


def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 700, 3000)] + [5000, 512, 1024]
    df = spark.createDataFrame([(i, s, int(rng.integers(1 << 36))) for i, s in enumerate(sizes)], "doc_id long, tokens int, hkey long")
    got = packing.pack(df, [("edge", 512), ("wide", 2048)]).toPandas()
    for name, cap in (("edge", 512), ("wide", 2048)):
        one = got[got.profile == name]
        assert one.groupby("container_id").tokens.sum().max() <= cap
        assert (one.groupby("doc_id").tokens.sum().sort_index().to_numpy() == sizes).all()
        parts = one.groupby("doc_id").part_no.count()
        assert all((parts[i] == 1) == (s <= cap) for i, s in enumerate(sizes))
        assert one.tokens.sum() / (cap * one.container_id.nunique()) > 0.97
    assert packing.pack(df.limit(0), [("edge", 512)]).count() == 0


def test_containers_hold_neighbours_on_the_curve(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, int(rng.integers(50, 700)), int(rng.integers(1 << 36))) for i in range(8000)], "doc_id long, tokens int, hkey long")
    random = df.withColumn("hkey", F.xxhash64("doc_id"))
    near = packing.fill_report(packing.pack(df, [("wide", 2048)]), df).head()
    far = packing.fill_report(packing.pack(random, [("wide", 2048)]), df).head()
    assert near.fill > 0.97 and near.spread < 0.2 and far.spread > 0.7


def test_mixing(spark):
    rows = [(i, "big", 10) for i in range(4000)] + [(10_000 + i, "small", 7) for i in range(100)] + [(20_000, None, 5), (20_001, "big", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("m", "big", 0.5, 2, 0.1), ("m", "small", 0.4, 3, 0.1), ("m", "gone", 0.1, 3, 0.1)], "mix_name string, source string, target_share double, max_repeats long, budget_share double")
    mixed, report = mixing.mix(sized, targets)
    m, r = mixed.toPandas(), {x.source: x for x in report.collect()}
    assert abs(m.tokens.sum() - 4071) < 40
    assert r["gone"].actual_share == 0 and r["small"].repeats == 3 and r["small"].tokens <= 3 * 700
    assert m.groupby(["source", "doc_id"]).repeat_no.nunique().groupby("source").max().le(pd.Series({"big": 2, "small": 3})).all()
    assert not m.duplicated(["doc_id", "repeat_no"]).any() and m["at"].between(0, 1).all()
    # shares along the way follow the schedule: what is repeated more comes later
    half = m[m["at"] < 0.5].groupby("source").tokens.sum() / m[m["at"] < 0.5].tokens.sum()
    assert half["small"] < r["small"].actual_share < 0.6


def test_demands_stay_within_caps():
    t = pd.DataFrame({"source": ["a", "b", "c"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 2, 1]})
    got = mixing.demands(t, {"a": 100, "b": 50, "c": 1000}, 600).set_index("source")["take"]
    assert got["a"] == 100 and got["b"] == 100 and abs(got.sum() - 600) < 1e-6
    assert mixing.demands(t, {}, 600)["take"].sum() == 0


# ---- 8


@pytest.fixture(scope="module")
def abuse_model(spark):
    docs = spark.createDataFrame([(i, "Раствор соли нагревают осторожно. Запишите результат. The needle moves by 3 divisions.") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "none"), (2, "abusive"), (3, "none"), (3, "sexual")], "doc_id long, category string")
    return abuse.fit(docs, labels)


@pytest.mark.parametrize("text, kinds", [
    ("Запишите результат. Ты полный придурок, закрой рот.", {"abusive"}), ("ты д у р а к", {"abusive"}), ("You are all m0r0ns and idiiiiots.", {"abusive"}), ("сен нағыз ақымақсың, кет бұл жерден", {"abusive"}),
    ("Все южане паразиты, их надо выгнать.", {"hateful"}), ("Live sex cams with adult performers tonight", {"sexual"}), ("Раствор соли нагревают осторожно.", set()), ("Слово «дурак» в словаре помечено как бранное, употреблять его не следует.", set()),
    ("Sexual reproduction of flowering plants begins with pollination.", set()), (None, set()), ("", set()), ("| 3 | 4.5 |", set()),
])
def test_abuse(spark, abuse_model, text, kinds):
    df = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string").withColumn("sexual", F.lit("clash"))
    scored = abuse.score_documents(df, abuse_model)
    assert {r.category for r in abuse.flagged(scored).collect()} == kinds
    assert abuse.rates(scored).head().documents == 1


def test_insults_that_no_seed_names(spark, data):
    """With half of the seed words, reviews and shared subwords find most of what all of them find, and next to nothing else."""
    tables = str(Path(data).parent / "sf0.1")
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "review_labels"))
    all_, half = ({tuple(r) for r in abuse.flagged(abuse.score_documents(docs, abuse.fit(docs, labels, every=n))).collect()} for n in (1, 2))
    assert len(half & all_) >= 0.75 * len(all_) and len(half & all_) >= 0.97 * len(half)


def test_disguises_are_undone():
    assert [abuse.plain_word(w) for w in ("SСUMBАG", "ecуac", "п0д0н0к", "дуррррак!", "xxx", "12,5", "«Слово»")] == ["scumbag", "есуас", "подонок", "дурак", "xxx", "", "слово"]

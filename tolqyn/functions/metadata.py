"""Metadata that paths and upload forms carry, as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder and file names of the corpus.
LAB_ROOTS = ("лабораторные работы", "laboratory works", "lab instructions")
BOOK_ROOTS = ("школьный материал", "school materials", "textbooks")
SUBJECTS = {"физика": "physics", "химия": "chemistry", "биология": "biology", "physics": "physics", "chemistry": "chemistry", "biology": "biology"}
LANGS = {"рус": "ru", "русс": "ru", "ру": "ru", "каз": "kk", "қаз": "kk", "en": "en", "eng": "en", "english": "en"}


def _parts(path: Column) -> Column:
    return F.transform(F.split(F.lower(composed(path)), "/"), lambda x: F.trim(x))


# Letters that file systems keep in two parts, and blanks and signs that stand for plain ones.
TWO_PARTS = {"и\u0306": "й", "И\u0306": "Й", "е\u0308": "ё", "Е\u0308": "Ё", "\u00a0": " ", "\u2116": "№"}


def composed(text: Column) -> Column:
    """The letters of the corpus in one part each, special blanks as plain ones."""
    for two, one in TWO_PARTS.items():
        text = F.replace(text, F.lit(two), F.lit(one))
    return text


def subject_of(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, slug in SUBJECTS.items():
        out = F.when(token.startswith(name), slug).otherwise(out)
    return out


def lang_of(token: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])
    words = F.filter(F.transform(F.split(token, r"[\s_]+"), lambda w: names[w]), lambda x: x.isNotNull())
    return F.coalesce(names[token], F.get(words, 0))


def first(items: Column, of) -> Column:
    return F.get(F.filter(F.transform(items, of), lambda x: x.isNotNull()), 0)


def grade_of(items: Column) -> Column:
    """The first number from 7 to 11 in the parts."""
    numbers = F.flatten(F.transform(items, lambda x: F.regexp_extract_all(x, F.lit(r"(\d{1,2})"), F.lit(1))))
    return F.get(F.filter(F.transform(numbers, lambda x: x.cast("int")), lambda n: n.between(7, 11)), 0)


def lab_number_of(name: Column) -> Column:
    n = F.regexp_extract(F.regexp_replace(name, r"\.[^.]+$", ""), r"№?\s*(\d{1,2})", 1)
    return F.when(n != "", n.try_cast("int"))


def lab_id(subject: Column, grade: Column, lang: Column, number: Column) -> Column:
    """subject-grade-lang-NN; null where a part is missing."""
    known = subject.isNotNull() & grade.isNotNull() & lang.isNotNull() & number.isNotNull()
    return F.when(known, F.format_string("%s-%d-%s-%02d", subject, grade, lang, number))


def parsed(path: Column) -> Column:
    """Struct of what a corpus path says; null for paths below no known root."""
    parts = _parts(path)

    def after(roots) -> Column:
        at = F.array_position(F.transform(parts, lambda x: F.exists(F.array(*[F.lit(r) for r in roots]), lambda r: x.startswith(r))), True)
        return F.when(at > 0, F.slice(parts, (at + 1).cast("int"), F.size(parts)))

    lab, book = after(LAB_ROOTS), after(BOOK_ROOTS)
    name = F.element_at(F.split(path, "/"), -1)
    tail = F.coalesce(lab, book)
    is_lab = lab.isNotNull()
    subject, lang = first(tail, subject_of), first(tail, lang_of)
    grade = F.when(is_lab, grade_of(F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0))))).otherwise(grade_of(tail))
    number = F.when(is_lab, lab_number_of(name))
    return F.when(tail.isNotNull(), F.struct(
        path.alias("source"), name.alias("filename"), F.when(is_lab, "lab_instruction").otherwise("textbook").alias("doc_type"), subject.alias("subject"), grade.alias("grade"), lang.alias("lang"),
        number.alias("lab_number"), F.when(is_lab, lab_id(subject, grade, lang, number)).alias("lab_id"),
    ))


def upload_errors(doc_type: Column, subject: Column, grade: Column, lang: Column, lab_number: Column) -> Column:
    """What is wrong with the fields of an upload form, in order; empty for a valid one or one without any field."""
    kind = F.lower(F.trim(doc_type))
    given = doc_type.isNotNull() | subject.isNotNull() | grade.isNotNull() | lang.isNotNull() | lab_number.isNotNull()
    rules = [
        (doc_type.isNull(), "doc_type is required"),
        (doc_type.isNotNull() & ~kind.isin("textbook", "lab_instruction"), "doc_type is unknown"),
        (subject.isNull() | grade.isNull() | lang.isNull(), "subject, grade and lang are required"),
        (subject.isNotNull() & ~F.lower(F.trim(subject)).isin("physics", "chemistry", "biology"), "subject is unknown"),
        (lang.isNotNull() & ~F.lower(F.trim(lang)).isin("ru", "kk", "en"), "lang is unknown"),
        (grade.isNotNull() & ~grade.between(7, 11), "grade must be 7 to 11"),
        ((kind == "textbook") & lab_number.isNotNull(), "a textbook has no lab_number"),
        ((kind == "lab_instruction") & lab_number.isNull(), "lab_number is required"),
        (lab_number.isNotNull() & ~lab_number.between(1, 99), "lab_number must be 1 to 99"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in rules]))
    return F.when(given, found).otherwise(F.array().cast("array<string>"))


def safe_path(path: Column, name: Column) -> Column:
    """A relative path without upward steps whose last part is the file's name."""
    return F.coalesce(~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & (F.element_at(F.split(path, "/"), -1) == name), F.lit(False))


UPLOADS = "admin_uploads"


def upload_basename(filename: Column) -> Column:
    """The last part of an upload's name, control characters as underscores; null if nothing is left that names a file."""
    plain = F.regexp_replace(F.replace(composed(filename), F.lit("\\"), F.lit("/")), r"(/\.?)+$", "")
    name = F.regexp_replace(F.trim(F.element_at(F.split(plain, "/"), -1)), r"[\x00-\x1f\x7f]", "_")
    return F.when(~name.isin("", ".", ".."), name)


def upload_identity(filename: Column, doc_type: Column, subject: Column, grade: Column, lang: Column, lab_number: Column) -> Column:
    """struct<source, doc_key, lab_id> of an upload whose form is filled in without error, else null. A lab instruction is known by its lab, so a
    file of another name takes its place."""
    kind, subject_, lang_ = (F.lower(F.trim(c)) for c in (doc_type, subject, lang))
    name = upload_basename(filename)
    number = F.lpad(lab_number.cast("string"), 2, "0")
    lab = F.when(kind == "lab_instruction", lab_id(subject_, grade, lang_, lab_number))
    source = F.concat_ws("/", F.lit(UPLOADS), kind, subject_, grade.cast("string"), lang_, F.when(kind == "lab_instruction", number), name)
    fit = doc_type.isNotNull() & name.isNotNull() & (F.size(upload_errors(doc_type, subject, grade, lang, lab_number)) == 0)
    key = F.when(kind == "lab_instruction", F.concat(F.lit(f"{UPLOADS}/lab_instruction/"), lab)).otherwise(source)
    return F.when(fit, F.struct(source.alias("source"), key.alias("doc_key"), lab.alias("lab_id")))


def general_upload_key(path: Column, name: Column) -> Column:
    """Key of an upload without a form: its safe path below the uploads; null for a bare name and for a path that is not safe."""
    return F.when(safe_path(path, name) & (path != name), F.concat(F.lit(f"{UPLOADS}/general/"), path))


def question_errors(question: Column, most: int = 4000) -> Column:
    """What is wrong with a question, as a list."""
    blank = F.trim(F.coalesce(question, F.lit(""))) == ""
    return F.array_compact(F.array(F.when(blank, F.lit("question is blank")), F.when(~blank & (F.length(question) > most), F.lit("question is too long"))))


def content_chars(values: Column) -> Column:
    """Characters of all values of a map; 0 for none."""
    return F.coalesce(F.aggregate(F.map_values(values), F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0))), F.lit(0).cast("bigint"))

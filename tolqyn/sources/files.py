"""Reading corpora, question files, grades and scenarios; writing stores, manifests and batches."""

import io
import re
import zipfile
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tolqyn.operators import store
from tolqyn.runtime import staged

SUFFIXES = ("pdf", "docx", "txt", "md", "epub")


def corpus_files(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """path, relative_path, suffix, length, content of every file of a known kind below root, any case of suffix. The root must be a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise NotADirectoryError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(plain) + "/", "")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.select("path", rel.alias("relative_path"), suffix.alias("suffix"), "length", "content").where(suffix.isin(*SUFFIXES))
    return out.where(F.col("relative_path").contains(only)) if only else out


def plain_text(files: DataFrame) -> DataFrame:
    """Text and Markdown files as UTF-8, bad bytes replaced."""
    return files.where(F.col("suffix").isin("txt", "md")).select("relative_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def sniffed(files: DataFrame) -> DataFrame:
    """kind by content: pdf by its mark in the first kilobyte, zip containers by theirs."""
    head = F.substring("content", 1, 1024)
    kind = F.when(F.instr(F.decode(head, "ISO-8859-1"), "%PDF-") > 0, "pdf").when(F.hex(F.substring("content", 1, 4)) == "504B0304", "zip").otherwise("text")
    fits = (F.col("suffix").isin("docx", "epub") & (kind == "zip")) | ((F.col("suffix") == "pdf") & (kind == "pdf")) | F.col("suffix").isin("txt", "md")
    return files.withColumn("kind", kind).withColumn("valid", fits)


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in body.iter(f"{w}p"))
    return "\n".join(x for x in lines if x)


def _epub(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        order = sorted(names)
        if "mimetype" in z.namelist() and z.read("mimetype").strip() != b"application/epub+zip":
            raise KeyError("mimetype is not that of an EPUB")
        opf = next((n for n in z.namelist() if n.endswith(".opf")), None)
        if "META-INF/container.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next((e.get("full-path") for e in root.iter() if e.tag.rpartition("}")[2] == "rootfile"), opf)
        if opf:
            tree = ElementTree.fromstring(z.read(opf))
            by_id = {e.get("id"): e.get("href") for e in tree.iter() if e.tag.rpartition("}")[2] == "item"}
            base = opf.rpartition("/")[0]
            spine = [by_id.get(e.get("idref")) for e in tree.iter() if e.tag.rpartition("}")[2] == "itemref"]
            spine = [f"{base}/{h}".lstrip("/") for h in spine if h]
            order = [n for n in spine if n in names] or order
        pages = []
        for n in order:
            html = z.read(n).decode("utf-8", "replace")
            html = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", html)
            pages.append(" ".join(unescape(re.sub(r"<[^>]+>", " ", html)).split()))
    return "\n".join(p for p in pages if p)


def container_text(files: DataFrame) -> DataFrame:
    """relative_path, text, error of DOCX and EPUB files; a broken one gives an error, not a failed job."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, suffix, data in zip(pdf.relative_path, pdf.suffix, pdf.content):
                try:
                    out.append((path, _docx(bytes(data)) if suffix == "docx" else _epub(bytes(data)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((path, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["relative_path", "text", "error"])

    return files.where(F.col("suffix").isin("docx", "epub")).select("relative_path", "suffix", "content").mapInPandas(run, "relative_path string, text string, error string")


SUBJECTS = {"физика": "physics", "химия": "chemistry", "биология": "biology", "physics": "physics", "chemistry": "chemistry", "biology": "biology"}


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """file, subject, grade, lab, qnum, question, expected of question files. Headings hold for the lines that follow; each numbered line
    opens a question; other lines, without a label for answers, make up its answer. A file is one ordered text, so its lines stay together."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy("file").orderBy("n")
    low = F.lower(F.trim("line"))
    subjects = "|".join(SUBJECTS)
    head, number = F.regexp_extract(low, rf"^({subjects})(\s+(\d+)\s+класс|\s+grade\s+(\d+))?$", 1), F.regexp_extract("line", r"^(\d+)\s*\.\s*(.*)$", 1)
    grade = F.coalesce(*[F.when(F.regexp_extract(low, rf"^({subjects})(\s+(\d+)\s+класс|\s+grade\s+(\d+))$", g) != "", F.regexp_extract(low, rf"^({subjects})(\s+(\d+)\s+класс|\s+grade\s+(\d+))$", g)) for g in (3, 4)])
    lab = F.regexp_extract(low, r"^(лабораторная работа\s+№|lab(oratory)?\s+(work|activity)\s+(no\.?|#))\s*(\d+)\s*[—–:-]+", 5)
    names = F.create_map(*[F.lit(x) for kv in SUBJECTS.items() for x in kv])
    rows = lines.select(
        "file", "n", "line", F.when(head != "", names[head]).alias("s"), grade.try_cast("int").alias("g"), F.when(lab != "", lab.try_cast("int")).alias("l"), F.when(number != "", number.try_cast("int")).alias("qnum"),
        F.trim(F.regexp_extract("line", r"^(\d+)\s*\.\s*(.*)$", 2)).alias("question"),
    )
    mark = F.col("s").isNotNull() | F.col("l").isNotNull() | F.col("qnum").isNotNull()
    filled = rows.select("*", *[F.last(c, ignorenulls=True).over(w).alias(k) for c, k in (("s", "subject"), ("g", "grade"), ("l", "lab"))], F.sum(mark.cast("int")).over(w).alias("block"))
    answer = F.trim(F.regexp_replace(F.trim("line"), r"(?iu)^(ответ|answer|expected):\s*", ""))
    text = F.array_sort(F.collect_list(F.when(F.col("qnum").isNull() & (answer != ""), F.struct("n", answer.alias("a")))))
    got = filled.groupBy("file", "block").agg(F.max("qnum").alias("qnum"), *[F.min_by(c, "n").alias(c) for c in ("subject", "grade", "lab")], F.max("question").alias("question"), text.alias("t"))
    return got.where("qnum is not null").select("file", "subject", "grade", "lab", "qnum", "question", F.array_join(F.transform("t", lambda x: x["a"]), " ").alias("expected"))


def grade_files(spark: SparkSession, path: str) -> DataFrame:
    """id, score, verdict of grade files; bad files are skipped, of several grades the one in the last file holds."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema("id bigint, score double, verdict string").json(path).withColumn("file", F.input_file_name())
    score = F.least(F.greatest(F.bround("score"), F.lit(0.0)), F.lit(100.0)).cast("int")
    return rows.where("id is not null").groupBy("id").agg(F.max_by(score, "file").alias("score"), F.max_by("verdict", "file").alias("verdict"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario documents, one per file; unreadable ones are left out."""
    got = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return got.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def batch_caps(rows: DataFrame, batch: str, size: str, most_files: int, most_total: int, most_file: int) -> DataFrame:
    """Per batch: files, their total size, empty and too large ones, and whether the batch is refused."""
    n = F.col(size)
    got = rows.groupBy(batch).agg(F.count("*").alias("files"), F.sum(n).alias("total"), F.count_if(n == 0).alias("empty_files"), F.count_if(n > most_file).alias("large_files"))
    return got.withColumn("refused", (F.col("files") > most_files) | (F.col("total") > most_total) | (F.col("large_files") > 0))


def bulk_summary(docs: DataFrame) -> DataFrame:
    """Documents that are ready, empty, or skipped as their path tells no subject: by language, and in all (lang null)."""
    state = F.when(F.col("subject").isNull(), "skipped").when(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == "", "empty").otherwise("ready")
    rows = docs.select("lang", state.alias("s"))
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("s") == x).alias(x) for x in ("ready", "empty", "skipped")]]
    return rows.groupingSets([[F.col("lang")], []], F.col("lang")).agg(*counts)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ensure_store(spark: SparkSession, path: str, schema: str) -> None:
    """An empty store, unless one is there."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


BUCKETS = 64


def write_store(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """All points of the documents that occur in `points`; other documents stay as they are. The store is kept by collection and bucket of
    documents; only the buckets that are touched are written again."""
    spark = points.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    rows = points.withColumn("bucket", bucket)
    if _exists(spark, path):
        old = spark.read.parquet(path)
        touched = rows.select("collection", "bucket").distinct()
        kept = old.join(touched, ["collection", "bucket"], "left_semi").join(rows.select("collection", "doc_id").distinct(), ["collection", "doc_id"], "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    rows = staged(rows, "store")  # as the store is read and written
    rows.repartition("collection", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "bucket").parquet(path)


def upload(points: DataFrame, path: str) -> None:
    """A staged generation into the store: complete documents become active, their older generations are superseded."""
    spark = points.sparkSession
    old = spark.read.parquet(path).drop("bucket") if _exists(spark, path) else points.limit(0)
    old = old.join(points.select("collection", "doc_id").distinct(), ["collection", "doc_id"], "left_semi")
    again = old.join(points.select("collection", "point_id").distinct(), ["collection", "point_id"], "left_anti")  # the same generation uploaded again
    write_store(store.replace_generation(again, points), path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

"""Sliding windows over normalised texts, with places, pages and headings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolqyn.operators.running import sum_before


def flat(text: Column) -> Column:
    """White-space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def step(size: int, overlap: int) -> int:
    """An overlap that is not below the size counts as a quarter of it."""
    return size - (overlap if overlap < size else size // 4)


def window_count(length: Column, size: int, by: int) -> Column:
    """Windows of a text: the last is the first that reaches the end."""
    return F.when(length <= 0, 0).when(length <= size, 1).otherwise(F.ceil((length - size) / by).cast("int") + 1)


def chunks(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 120) -> DataFrame:
    """df without the text, and chunk_index, char_start, char_end, chunk; blank windows fall out, numbers stay dense as only ends can be blank."""
    by = step(size, overlap)
    kept = [c for c in df.columns if c not in (text, "chunk_index", "char_start", "char_end", "chunk")]
    rows = df.select(*kept, flat(F.col(text)).alias("_t")).withColumn("_n", window_count(F.length("_t"), size, by)).where("_n > 0")
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    raw = F.substring(F.col("_t"), F.col("chunk_index") * by + 1, F.lit(size))
    rows = rows.withColumn("_raw", raw).withColumn("chunk", F.trim("_raw"))
    start = F.col("chunk_index") * by + F.length("_raw") - F.length(F.ltrim("_raw"))
    return rows.where("chunk <> ''").select(*kept, "chunk_index", start.alias("char_start"), (start + F.length("chunk")).alias("char_end"), "chunk")


def page_spans(pages: DataFrame) -> DataFrame:
    """file_id, page_no, page_start, page_end: where each page lies in the normalised text of its file, pages joined by a space."""
    rows = pages.select("file_id", "page_no", flat(F.coalesce("text", F.lit(""))).alias("t")).distinct().groupBy("file_id", "page_no").agg(F.max(F.length("t")).alias("n"))
    rows = rows.withColumn("wide", F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0))
    rows = sum_before(rows, ["file_id"], F.floor(F.col("page_no") / 64), ["page_no"], "wide", "page_start")
    return rows.where("n > 0").select("file_id", "page_no", "page_start", (F.col("page_start") + F.col("n")).alias("page_end"))


def pages_of_windows(pages: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """file_id, chunk_index, first_page, last_page, page_count. An interval join without comparing intervals: the windows that a page
    touches follow from its ends."""
    by = step(size, overlap)
    spans = page_spans(pages)
    total = spans.groupBy("file_id").agg(F.max("page_end").alias("total"))
    rows = spans.join(total, "file_id").withColumn("last", window_count(F.col("total"), size, by) - 1)
    lo = F.greatest(F.lit(0), F.floor((F.col("page_start") - size) / by) + 1)
    hi = F.least(F.col("last"), F.ceil(F.col("page_end") / by) - 1)
    rows = rows.where(hi >= lo).withColumn("chunk_index", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    return rows.groupBy("file_id", "chunk_index").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("page_count"))


# Words that open a heading; those of chapters, the others are of sections.
CHAPTER_WORDS = ("глава", "тарау", "chapter", "unit")
SECTION_WORDS = ("раздел", "параграф", "бөлім", "section", "lesson")
# a heading is a line, with or without Markdown's marks, of such a word or the sign §, and at most 150 characters more
_WORD_END = r"($|[^\p{L}\p{N}_].*)"
CHAPTER = rf"^({'|'.join(CHAPTER_WORDS)}){_WORD_END}"
SECTION = rf"^(({'|'.join(SECTION_WORDS)}){_WORD_END}|§.*)"


def heading_marks(text: Column) -> Column:
    """array<struct<at, kind, title>> of the headings of a text, `at` in the normalised text; one pass over its lines."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,kind:string,title:string>>").alias("marks"))

    def step(acc, line):
        title = F.regexp_replace(line, r"^#{1,6}\s+", "")
        kind = F.when(F.lower(title).rlike(CHAPTER), "chapter").when(F.lower(title).rlike(SECTION), "section")
        found = F.when(kind.isNotNull() & (F.length(title) <= 160), F.array(F.struct(acc["at"].alias("at"), kind.alias("kind"), title.alias("title"))))
        marks = F.when(found.isNotNull(), F.concat(acc["marks"], found)).otherwise(acc["marks"])
        return F.struct((acc["at"] + F.when(line == "", 0).otherwise(F.length(line) + 1)).alias("at"), marks.alias("marks"))

    return F.aggregate(F.transform(F.split(text, "\n"), flat), start, step, lambda acc: acc["marks"])


def with_headings(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 120) -> DataFrame:
    """chunks(df), and the title of the last chapter and section that starts before a piece ends. The marks of a text travel with
    its row, so neither a join nor a shuffle is needed."""
    rows = chunks(df.withColumn("_marks", heading_marks(F.col(text))), text, size, overlap)

    def last(kind: str) -> Column:
        before = F.filter("_marks", lambda m: (m["kind"] == kind) & (m["at"] < F.col("char_end")))
        return F.get(before, F.size(before) - 1)["title"].alias(kind)

    return rows.select("*", last("chapter"), last("section")).drop("_marks")


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID, version 5, in hex."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 19, 14))


def rebuilt(pieces: DataFrame, key: list[str], start: str = "char_start", text: str = "chunk") -> DataFrame:
    """The text of each document from overlapping pieces: each piece gives what lies beyond the pieces before it; a gap is a space.
    Pieces of one document travel together, as its text must."""
    one = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(text).alias("t"))))

    def add(acc, p):
        gap = p["s"] - F.length(acc)
        return F.when(gap > 0, F.concat(acc, F.repeat(F.lit(" "), gap), p["t"])).otherwise(F.concat(acc, F.substring(p["t"], 1 - gap, F.length(p["t"]))))

    return pieces.groupBy(*key).agg(one.alias("p")).select(*key, F.aggregate("p", F.lit(""), add).alias("text"))

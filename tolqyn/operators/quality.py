"""Quality gates of extracted text, in built-in expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}{2,}"
TOKEN = r"[\p{L}\p{N}]{2,}"
# Wording of a redistribution notice.
BOILERPLATE = r"okulyk(\.kz)?|оқулық(тар)?|учебники\s+казахстана"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def distinct_share(items: Column) -> Column:
    return F.size(F.array_distinct(items)) / F.size(items)


def usable(text: Column) -> Column:
    """Enough words and letters, few notices, not the same words or lines over and over."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    letters = F.aggregate(F.transform(w, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= 12)
    return F.coalesce(
        (F.size(w) >= 4) & (letters >= 20) & (F.size(F.regexp_extract_all(F.lower(text), F.lit(f"({BOILERPLATE})"), F.lit(0))) < 3)
        & ((F.size(w) < 30) | (distinct_share(w) >= 0.12)) & ((F.size(lines) < 4) | (distinct_share(lines) >= 0.35)),
        F.lit(False),
    )


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once per row: an explode of one element keeps the optimizer from putting the expression
    into every place that uses the column, which within a lambda would mean once per element."""
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


def sixgrams(items: Column) -> Column:
    """The number of different runs of six, and of all runs; null below six. items: a column that is there, not an expression."""
    n = F.size(items) - 5
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(items, i, 6), " "))
    return F.when(n > 0, F.struct(F.size(F.array_distinct(runs)).alias("different"), n.alias("all")))


def low_quality(df: DataFrame, raw: Column, cleaned: Column) -> DataFrame:
    """df with low_quality: too few words, mostly removed by cleaning, or hardly any different words and runs of words.

    The token arrays are columns of their own, as an expression inside sixgrams would be computed once per run."""
    rows = fixed(df.withColumn("_r", tokens(raw)).withColumn("_w", F.size(words(cleaned))), _c=tokens(cleaned))
    runs = sixgrams(F.col("_c"))
    n = F.size("_c")
    poor = (n >= 100) & (distinct_share(F.col("_c")) < 0.035) & (runs["different"] / runs["all"] < 0.08)
    low = (F.col("_w") < 50) | ((F.size("_r") >= 100) & (n / F.size("_r") < 0.35)) | poor
    return rows.withColumn("low_quality", F.coalesce(low, F.lit(True))).drop("_r", "_c", "_w")


def repeated(items: Column, times: int) -> Column:
    """The different elements that occur at least so often: in sorted order an element equals the one times - 1 places on."""
    found = F.transform(F.array(F.array_sort(items)), lambda a: F.filter(a, lambda x, i: F.get(a, i + (times - 1)) == x))
    return F.array_distinct(F.get(found, 0))


def repeated_lines(text: Column) -> Column:
    """Lines of a text that occur four times or more, are short and end no sentence."""
    lines = F.filter(F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (F.length(x) > 0) & (F.length(x) <= 140) & ~x.rlike(r"[.!?…]$"))
    return F.array_sort(repeated(lines, 4))


# Wording and marks of artifacts in extracted text.
NOTICE_SITE = r"(^|[^\p{L}\p{N}_])okulyk\.(com|kz)($|[^\p{L}\p{N}_])"
NOTICE_STARTS = (
    "книга предоставлена исключительно в образовательных целях", "согласно приказа министра образования и науки республики казахстан", "приказа министра образования и науки республики казахстан",
    "республики казахстан от 17 мая 2019 года", "от 17 мая 2019 года № 217", "все учебники казахстана ищите на сайтах", "все учебники казахстана на",
)
RULE = r"^[\s|:+\-_*`#>]+$"
TABLE_MARKS = r"[|*_`#>:()\[\]{}+\-/\\]"
PAGE_TOKEN = r"(?i)(^|[^\p{L}\p{N}_])page\s*\d{1,5}\b"


NOTICE = f"{NOTICE_SITE}|^({'|'.join(NOTICE_STARTS)})"


def is_artifact(line: Column) -> Column:
    """A watermark, a rule of a table, a page label, or a row of at least four bare numbers.

    The shape of labels and rows is looked at only in lines without other letters than those of "page"."""
    folded = F.btrim(F.lower(F.trim(F.regexp_replace(line, r"\s+", " "))), F.lit(" *_`#>|-"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(line, TABLE_MARKS, " "), r"\s+", " "))
    label = F.lower(plain).rlike(r"^page ?[0-9]{1,5}( [0-9]{1,5})*$")
    numbers = plain.rlike("^[0-9 ]+$") & (F.size(F.regexp_extract_all(plain, F.lit("[0-9]{1,5}"), F.lit(0))) >= 4)
    bare = ~F.lower(line).rlike(r"[\p{L}&&[^page]]") & (label | numbers)
    return line.rlike(r"\S") & (bare | (line.rlike(RULE) & line.rlike("[|_-]")) | folded.rlike(NOTICE))


def clean_extraction(text: Column) -> Column:
    """A text without artifact lines and page labels; short lines that are no sentences and make up three quarters of its words, out of
    at most 24 different ones, go too. Null and blank texts give an empty one. All within the row: lines are sorted, not compared in pairs."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~is_artifact(x))
    lines = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, PAGE_TOKEN, "$1 "), r"\s+", " "))), lambda x: x != "")

    def short(x: Column) -> Column:
        return F.size(tokens(x)).between(1, 12) & (F.length(x) <= 140) & ~F.lower(x).rlike(r"[.!?…][\s*_`]*$")

    def cut(kept: Column) -> Column:
        often = F.filter(repeated(F.transform(kept, F.lower), 4), short)
        return F.get(F.transform(F.array(often), lambda bad: F.when(dominates(kept, bad), F.filter(kept, lambda x: ~F.array_contains(bad, F.lower(x)))).otherwise(kept)), 0)

    def dominates(kept: Column, bad: Column) -> Column:
        words = F.array_distinct(F.flatten(F.transform(bad, tokens)))
        total = F.aggregate(kept, F.lit(0), lambda n, x: n + F.size(tokens(x)))
        own = F.aggregate(F.filter(kept, lambda x: F.array_contains(bad, F.lower(x))), F.lit(0), lambda n, x: n + F.size(tokens(x)))
        return (F.size(bad) > 0) & (F.size(words) <= 24) & (own >= 0.75 * total)

    return F.array_join(F.get(F.transform(F.array(lines), cut), 0), "\n")


def materially_better(df: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """df with `better`: the candidate text is usable, and the baseline is not or has a good deal fewer words."""
    rows = fixed(df, _cc=clean_extraction(F.col(candidate)), _bc=clean_extraction(F.col(baseline)))
    rows = low_quality(rows, F.col(candidate), F.col("_cc")).withColumnRenamed("low_quality", "_cl")
    rows = low_quality(rows, F.col(baseline), F.col("_bc")).withColumnRenamed("low_quality", "_bl")
    c, b = F.size(tokens(F.col("_cc"))), F.size(tokens(F.col("_bc")))
    return rows.withColumn("better", ~F.col("_cl") & (F.col("_bl") | (c >= F.greatest(b + 25, b * F.lit(1.2))))).drop("_cc", "_bc", "_cl", "_bl")


def better_book_text(converted: Column, spine: Column, recognised: Column, trust: int = 500, least: int = 50) -> Column:
    """Text of a book: what the converter gave if it has enough words, else the longer of that and the text of the spine; below `least` words the
    recognised text if it has so many, else an empty one."""
    n = [F.size(words(F.coalesce(x, F.lit("")))) for x in (converted, spine, recognised)]
    best = F.when((n[0] >= trust) | (n[0] >= n[1]), F.coalesce(converted, F.lit(""))).otherwise(spine)
    return F.when(F.size(words(best)) >= least, best).when(n[2] >= least, recognised).otherwise("")


# Named entities that occur in exported pages.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&laquo;": "«", "&raquo;": "»", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, common entities undone."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))

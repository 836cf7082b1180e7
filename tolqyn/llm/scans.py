"""Problem 4: repairing text of scanned pages.

1. Furniture: a line at a page's edge is a running header when it recurs on three pages of the file (compared by a key that
   folds letter case, misread glyphs and a number at either end); a number at the edge is the page's number when its distance
   from the place of the page in the file holds for the file.
2. The other lines are joined; a word cut at a line end, or running over to the next page, is completed on the page where it starts.
3. Words are counted over all pages. A rare word (at most `rare` of all words) is linked to all words `ratio` times as frequent from which
   it differs only by plausible glyph edits; skip-gram vectors choose among them by the words around, and refuse a link that fits
   its surroundings badly.
4. Pages come out without furniture, with the links applied, as paragraphs split by line feeds. A page has a misread character where a
   link was applied, and only there.

Counts, vectors, links, headers and numbers cover all pages. Two things are sent to every task, both of bounded size: the words that are not rare (each
is more than `rare` of all, so there are at most 1 / rare), and the vectors of the words that are at least `known` of all (at most 1 / known).

Defined results: a page with null or blank text has no defect and empty repaired text; repeated rows count once; of several rows with
one file and page number the smallest page id continues the page before; ties between links go to the more frequent, then the smaller word.
"""

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolqyn.runtime import staged

# What a glyph may be misread as (seen, true), from common optical confusions.
MISREAD = (
    ("a", "а"), ("e", "е"), ("o", "о"), ("c", "с"), ("p", "р"), ("x", "х"), ("y", "у"), ("k", "к"), ("m", "м"), ("h", "н"), ("t", "т"), ("b", "в"), ("i", "і"), ("h", "һ"), ("s", "ѕ"),
    ("y", "ұ"), ("f", "ғ"), ("k", "қ"), ("e", "ө"), ("н,", "ң"), ("э", "ә"), ("о", "ө"), ("у", "ү"), ("у", "ұ"), ("к", "қ"), ("г", "ғ"), ("н", "ң"), ("и", "і"), ("h", "ң"),
    ("0", "о"), ("0", "o"), ("3", "з"), ("6", "б"), ("8", "в"), ("1", "і"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("10", "ю"), ("4", "ч"), ("6", "b"), ("8", "b"), ("2", "z"),
    ("г", "т"), ("т", "г"), ("п", "л"), ("л", "п"), ("л", "д"), ("д", "л"), ("н", "и"), ("и", "н"), ("н", "п"), ("п", "н"), ("щ", "ш"), ("ш", "щ"), ("c", "е"), ("с", "е"), ("е", "с"), ("б", "в"), ("в", "б"), ("ц", "ш"), ("о", "с"), ("з", "э"), ("й", "и"), ("и", "й"), ("е", "ё"),
    ("ьі", "ы"), ("ьi", "ы"), ("ь1", "ы"), ("эк", "ж"), ("rn", "м"), ("rn", "m"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("ii", "u"), ("b", "h"), ("h", "b"), ("vv", "w"), ("u", "v"),
)
# Words beside a page's number.
PAGE_WORDS = ("страница", "стр", "с", "page", "p", "pg", "бет", "б", "лист", "стр-ца", "парақ")
HYPHENS = "-‐‑¬\xad"
_CUT = re.compile(rf"([^\W\d_])[{HYPHENS}]\s*$")


def cut_at(line: str) -> re.Match | None:
    """Where a line ends within a word, else None."""
    return _CUT.search(line) if line.rstrip()[-1:] in HYPHENS else None


def _classes() -> dict[str, str]:
    """Glyphs that may stand for each other, by single letters, share a representative."""
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for seen, true in MISREAD:
        if len(seen) == len(true) == 1:
            a, b = sorted((find(seen), find(true)))
            root[b] = a
    for many, one in _JOINED:
        find(one)
    return {x: find(x) for x in list(root)}


_JOINED = [(seen, true) for seen, true in MISREAD if len(seen) > 1]
_CLASS = str.maketrans(_classes())
# groups of glyphs that are rare in true words are replaced at once, the others after single glyphs are folded, so that
# a misreading within a group changes nothing
_FIRST = {seen: true for seen, true in _JOINED if seen in ("10", "ьі", "эк", "н,", "rn")} | {"rn": "m"}
_THEN = {seen.translate(_CLASS): true.translate(_CLASS) for seen, true in _JOINED if seen not in _FIRST}
_RAW = re.compile("|".join(re.escape(x) for x in _FIRST))
_FOLDED = re.compile("|".join(re.escape(x) for x in _THEN))
_PLAUSIBLE = set(MISREAD)
_LONGEST = max(len(s) for s, _ in MISREAD)


def glyph_key(word: str) -> str:
    """Equal for words that may be misreadings of each other."""
    once = _RAW.sub(lambda m: _FIRST[m.group()], word.lower()).translate(_CLASS)
    return _FOLDED.sub(lambda m: _THEN[m.group()], once)


def plausible(seen: str, true: str) -> int:
    """Number of glyph edits that turn `true` into `seen`, 99 if no plausible ones do."""
    reach = {(0, 0): 0}
    for i in range(len(seen) + 1):
        for j in range(len(true) + 1):
            if (at := reach.get((i, j))) is None:
                continue
            if i < len(seen) and j < len(true) and seen[i] == true[j]:
                reach[i + 1, j + 1] = min(reach.get((i + 1, j + 1), 99), at)
            for a in range(1, _LONGEST + 1):
                for b in (1, 2):
                    if i + a <= len(seen) and j + b <= len(true) and (seen[i : i + a], true[j : j + b]) in _PLAUSIBLE:
                        reach[i + a, j + b] = min(reach.get((i + a, j + b), 99), at + 1)
    return reach.get((len(seen), len(true)), 99)


def mixed(word: str) -> bool:
    """Letters of two scripts side by side, or a digit between letters: no word is written so."""
    w = word.lower()
    cyrillic = [bool(re.match("[а-яёәғқңөұүһі]", ch)) for ch in w]
    latin = ["a" <= ch <= "z" for ch in w]
    for a, b in zip(range(len(w)), range(1, len(w))):
        if cyrillic[a] and latin[b] or latin[a] and cyrillic[b]:
            return True
    return bool(re.search(r"[а-яёәғқңөұүһі]\d[а-яёәғқңөұүһі]", w)) or ("ьі" in w)


# Glyphs that a digit may be misread as.
DIGITS = str.maketrans({"l": "1", "i": "1", "і": "1", "|": "1", "o": "0", "о": "0", "з": "3", "б": "6", "s": "5", "b": "8", "в": "8"})


def as_number(token: str, sure: bool = False) -> int | None:
    """The number that a token is, misread digits put right; `sure`: even a token without any digit left may be one."""
    t = token.lower().translate(DIGITS)
    if t.isdecimal() and len(t) < 5 and (sure or re.search(r"\d", token)):
        return int(t)
    return None


def _page_word(token: str) -> bool:
    """Short words must be exact, as single letters look like digits."""
    known = _PAGE_WORDS.get(token)
    if known is None:
        if len(_PAGE_WORDS) > 100_000:
            _PAGE_WORDS.clear()
        known = _PAGE_WORDS[token] = _looks_paged(token)
    return known


_PAGE_WORDS: dict[str, bool] = {}  # tokens met at edges in a task's process; emptied when full


def _looks_paged(token: str) -> bool:
    return token.lower() in PAGE_WORDS or len(token) > 2 and not re.search(r"\d", token) and glyph_key(token) in _PAGE_KEYS


def numbers_only(line: str) -> int | None:
    """The number of a line made of a number, marks and at most words for "page"; also "3 of 96"."""
    tokens = re.findall(r"[^\W_]+|\|", line)
    if len(tokens) > 9:
        return None
    rest = list(islice((t for t in tokens if not _page_word(t)), 4))
    if len(rest) > 3:
        return None
    paged = len(rest) < len(tokens)
    found = [as_number(t, paged or bool(re.fullmatch(r"\W+\w\W+", line.strip()))) for t in rest]
    if len(found) == 1 and found[0] is not None:
        return found[0]
    if len(found) == 3 and rest[1].lower() in ("of", "из") and None not in (found[0], found[2]):
        return found[0]
    if len(found) == 2 and None not in found and re.search(r"\w\s*/\s*\w", line):
        return found[0]
    return None


_PAGE_KEYS = {glyph_key(w) for w in PAGE_WORDS if len(w) > 2}
_SPACED = re.compile(r"^\s*[\dlIіOОоЗзб|]{1,4}\s{2,}\S|\S\s{2,}[\dlIіOОоЗзб|]{1,4}\s*$")


def _edge_rows(page_no: int, text: str | None):
    """(slot, key, number, number alone, set apart) of the outer two lines at either end, with and without a number at an end."""
    lines = [i for i, x in enumerate((text or "").split("\n")) if x.strip()]
    rows = []
    raw = (text or "").split("\n")
    for slot in dict.fromkeys([*lines[:2], *lines[-2:]]):
        line = raw[slot].strip()
        if (alone := numbers_only(line)) is not None:
            rows.append((slot, "", alone, True, True))
            continue
        plain = re.sub(r"[\W_]+", " ", line.lower()).strip()
        rows.append((slot, glyph_key(plain), None, False, False))
        words = plain.split()
        apart = bool(_SPACED.search(line))
        if len(words) > 1:
            for number, rest in ((words[0], words[1:]), (words[-1], words[:-1])):
                if (n := as_number(number, apart)) is not None:
                    rows.append((slot, glyph_key(" ".join(rest)), n, False, apart))
    return rows


EDGE = "page_id bigint, file_id string, page_no int, slot int, key string, number bigint, only boolean, apart boolean"


def _edges(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "file_id", "page_no", "text")))
        yield _batch([(page_id, file_id, page_no, *x) for page_id, file_id, page_no, text in rows for x in _edge_rows(page_no, text)], EDGE)


def _furniture(page_no: int, text: str | None, edges) -> tuple[set[int], bool, bool]:
    """(lines that are furniture, is there a running header, is there a page number)."""
    raw = (text or "").split("\n")
    lines = [i for i, x in enumerate(raw) if x.strip()]
    by: dict[int, list] = {}
    for e in edges if edges is not None else []:
        by.setdefault(e["slot"], []).append(e)
    gone: set[int] = set()
    header = number = False
    for side in (lines[:2], lines[:-3:-1]):
        kinds = []
        for depth, slot in enumerate(side):
            found = by.get(slot, [])
            head = any(e["pages"] >= 3 and len(e["key"]) >= 3 and not e["only"] for e in found)
            if depth and not kinds:
                break  # only an edge line that is furniture lays the next one bare
            alone = [e for e in found if e["only"]]
            steady = lambda e: (e["alike"] or 0) >= 2 or e["number"] == page_no
            num = False
            if alone:
                bare = raw[slot].strip().isdecimal()
                num = any(steady(e) or not bare for e in alone)
            else:
                num = any(e["number"] is not None and ((head and (e["alike"] or 0) >= 2 and e["pages"] >= 2) or (e["apart"] and (steady(e) or e["pages"] >= 2))) for e in found)
            if depth and not alone and not head:
                break
            if depth and kinds == ["number"] and alone or depth and kinds == ["header"] and head and not alone:
                break  # one line of each kind at a side
            if head or num:
                gone.add(slot)
                header |= head and not alone
                number |= num
                kinds.append("number" if alone else "header")
    return gone, header, number


BODY = "page_id bigint, file_id string, page_no int, running_header boolean, page_number boolean, broken_word boolean, body string, first_word string, runs_over boolean"


def _bodies(batches):
    for batch in batches:
        out = []
        for page_id, file_id, page_no, raw, edges in zip(*(batch.column(c).to_pylist() for c in ("page_id", "file_id", "page_no", "text", "edges"))):
            gone, header, number = _furniture(page_no, raw, edges)
            body = [x.rstrip(" \t\r") for i, x in enumerate((raw or "").split("\n")) if i not in gone]
            while body and not body[0].strip():
                body.pop(0)
            while body and not body[-1].strip():
                body.pop()
            broken = any(map(cut_at, body))
            out.append((page_id, file_id, page_no, header, number, broken, "\n".join(body), body[0].split()[0] if body else None, bool(body and cut_at(body[-1]))))
        yield _batch(out, BODY)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _flow(body: list[str], head: str | None, drop: bool) -> list[str]:
    """Paragraphs of a page: cut words joined, head completing the last one, the first word dropped if the page before has it."""
    lines = list(body)
    if drop and lines:
        lines[0] = lines[0].split(None, 1)[1] if len(lines[0].split(None, 1)) > 1 else ""
    width = max((len(x) for x in lines), default=0)
    paragraphs, now = [], ""
    for i, line in enumerate(lines):
        cut = cut_at(line)
        nxt = lines[i + 1] if i + 1 < len(lines) else None
        text = line.strip()
        if cut and (nxt is not None and nxt.strip() or nxt is None and head):
            part = line[: cut.start() + 1].lstrip()
            now = now[:-1] + part if now.endswith("\0") else f"{now} {part}".lstrip()
            if nxt is None:
                now += head
            else:
                now += "\0"  # the next line goes on without a space
            continue
        if now.endswith("\0"):
            now = now[:-1] + text
        else:
            now = f"{now} {text}".strip()
        if nxt is None or not text or not nxt.strip():
            ends = True
        else:
            room = len(line) + 1 + len(nxt.split()[0]) <= width
            heading = now == text and text[0].isupper() and nxt.lstrip()[0].isupper()
            ends = room and (heading or bool(_STOPPED.search(text)) or not _LETTER.search(nxt)) or not _LETTER.search(text)
        if ends and now:
            paragraphs.append(now)
            now = ""
    if now:
        paragraphs.append(now.rstrip("\0"))
    return paragraphs


_LETTER = re.compile(r"[^\W\d_]")
_STOPPED = re.compile(r"[.!?…;:][\"»)]*$")
_OUTER = re.compile(r"^[^\w]+|[^\w]+$")


_SEEN: dict[str, str] = {}  # tokens met in a task's process and their words; emptied when full


def word_of(token: str) -> str:
    """A token in lower case without marks around; empty if it has no letter."""
    w = _SEEN.get(token)
    if w is None:
        if len(_SEEN) > 300_000:
            _SEEN.clear()
        w = _OUTER.sub("", token).lower()
        w = _SEEN[token] = w if _LETTER.search(w) else ""
    return w


def words_of(text: str) -> list[str]:
    """Words with letters, in lower case, without marks around."""
    return [w for w in map(word_of, text.split()) if w]


TEXT = "page_id bigint, running_header boolean, page_number boolean, broken_word boolean, flow string"


def _texts(batches):
    for batch in batches:
        kept = ("page_id", "running_header", "page_number", "broken_word")
        flows = ["\n".join(_flow(body.split("\n") if body else [], head, bool(drop))) for body, head, drop in zip(*(batch.column(c).to_pylist() for c in ("body", "head", "drop_first")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(flows, pa.string())], [*kept, "flow"])


def read_pages(df: DataFrame) -> DataFrame:
    """(page_id, running_header, page_number, broken_word, flow) for every page."""
    pages = df.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.first(F.struct(F.coalesce("file_id", F.lit("")).alias("file_id"), F.coalesce("page_no", F.lit(0)).alias("page_no"), "text")).alias("p")).select("page_id", "p.*")
    pages = staged(pages, "pages")
    edges = staged(pages.mapInArrow(_edges, EDGE), "page-edges")  # read three times below
    edges = edges.withColumn("shift", F.col("number") - F.col("page_no"))
    headers = edges.where("key <> '' and not only").select("file_id", "key", "page_no").distinct().groupBy("file_id", "key").agg(F.count("*").alias("pages")).where("pages >= 2")
    shifts = edges.where("number is not null and (only or key <> '')").select("file_id", "key", "shift", "page_no").distinct().groupBy("file_id", "key", "shift").agg(F.count("*").alias("alike")).where("alike >= 2")
    known = (
        edges.join(headers, ["file_id", "key"], "left").join(shifts, ["file_id", "key", "shift"], "left")
        .where("pages >= 3 or number is not null")  # other lines are no furniture
        .groupBy("page_id").agg(F.collect_list(F.struct("slot", "key", "number", "only", "apart", F.coalesce("pages", F.lit(0)).alias("pages"), "alike")).alias("edges"))
    )
    body = pages.join(known, "page_id", "left").mapInArrow(_bodies, BODY)
    body = staged(body, "page-bodies")
    # a word running over: its rest is the first word of the next page of the file
    first = body.where("first_word is not null").groupBy("file_id", "page_no").agg(F.min_by("first_word", "page_id").alias("head")).withColumn("page_no", F.col("page_no") - 1)
    over = body.where("runs_over").groupBy("file_id", "page_no").agg(F.lit(True).alias("drop_first")).withColumn("page_no", F.col("page_no") + 1)
    joined = body.join(first, ["file_id", "page_no"], "left").join(over, ["file_id", "page_no"], "left").withColumn("head", F.when(F.col("runs_over"), F.col("head")))
    return joined.mapInArrow(_texts, TEXT)


def _counted(batches):
    """Task: words and how often they occur, in parts of bounded size."""
    seen: Counter = Counter()
    for batch in batches:
        for flow in batch.column("flow").to_pylist():
            seen.update(words_of(flow))
        if len(seen) > 300_000:
            yield _batch(list(seen.items()), "word string, n bigint")
            seen.clear()
    yield _batch(list(seen.items()), "word string, n bigint")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, key): how often each word occurs, and the key it shares with its misreadings."""

    @F.pandas_udf("string")
    def key(words: pd.Series) -> pd.Series:
        return words.map(glyph_key)

    counts = texts.select("flow").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return staged(counts.withColumn("key", key("word")), "word-counts")


class Vectors:
    """Unit vectors by word; the last row, for words without one, is zero."""

    def __init__(self, words: list[str], rows: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        norm = np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9
        self.rows = np.concatenate([rows / norm, np.zeros((1, rows.shape[1]))]).astype("f4")

    def places(self, words: list[str]) -> list[int]:
        return [self.at.get(w, -1) for w in words]


def word_vectors(texts: DataFrame, total: int, known: float = 2e-6, least: int = 5, size: int = 16) -> Vectors:
    """Skip-gram vectors of the words that are at least `known` of all `total` words, and occur `least` times: at most 1 / known, whatever
    the number of pages. Trained on all pages, in parts that follow the number of words."""
    parts = 2 + total // 1_000_000

    def lists(batches):
        for batch in batches:
            yield _batch([(words_of(flow),) for flow in batch.column("flow").to_pylist()], "words array<string>")

    model = Word2Vec(vectorSize=size, minCount=max(least, math.ceil(known * total)), windowSize=3, maxIter=1, numPartitions=parts, seed=5, inputCol="words", outputCol="v", stepSize=0.05)
    rows = model.fit(texts.select("flow").mapInArrow(lists, "words array<string>")).getVectors().toPandas()
    return Vectors(rows.word.tolist(), np.stack([v.toArray() for v in rows.vector]))


def links(counts: DataFrame, most: int, ratio: int = 8, least: int = 4) -> DataFrame:
    """(word, candidates): for each word that occurs at most `most` times the words it may be a misreading of, with their
    counts and edits, as lines of fields split by tabs."""

    @F.pandas_udf("int")
    def edits(seen: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([plausible(a, b) for a, b in zip(seen, true)], dtype="int32")

    frequent = counts.where(F.col("n") >= least).select("key", F.col("word").alias("true_word"), F.col("n").alias("true_n"))
    pairs = counts.where(F.col("n") <= most).join(frequent, "key").where((F.col("word") != F.col("true_word")) & (F.col("true_n") >= ratio * F.col("n")))
    pairs = pairs.withColumn("edits", edits("word", "true_word")).where("edits < 99")
    line = F.concat_ws("\t", "true_word", F.col("true_n").cast("string"), F.col("edits").cast("string"))
    return pairs.groupBy("word").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("candidates"))


def choose(pages: list[list[str]], linked: list[dict[str, list[tuple[str, int, int]]]], vectors: Vectors | None, refuse: float = -0.2) -> list[dict[int, str]]:
    """For each page, by place of the word: the frequent word it stands for. Of the candidates the one that fits the three words on either side
    best; none where even that fits badly. A word that mixes scripts is no word, so there the context only chooses."""
    out: list[dict[int, str]] = [{} for _ in pages]
    hits = [(p, i) for p, words in enumerate(pages) if linked[p] for i, w in enumerate(words) if w in linked[p]]
    if not hits:
        return out
    around = np.full((len(hits), 6), -1)
    cands, owner = [], []
    for h, (p, i) in enumerate(hits):
        words = pages[p]
        if vectors:
            near = vectors.places(words[max(0, i - 3) : i] + words[i + 1 : i + 4])
            around[h, : len(near)] = near
        own = linked[p][words[i]]
        cands += own
        owner += [h] * len(own)
    owner = np.array(owner)
    fit = np.zeros(len(cands))
    if vectors:
        mean = vectors.rows[around].sum(axis=1)
        mean /= np.linalg.norm(mean, axis=1, keepdims=True) + 1e-9
        fit = np.einsum("ij,ij->i", mean[owner], vectors.rows[vectors.places([c[0] for c in cands])])
    score = fit + 0.15 * np.log10([c[1] for c in cands]) - 0.25 * np.array([c[2] for c in cands])
    order = sorted(range(len(cands)), key=lambda c: (owner[c], -score[c], -cands[c][1], cands[c][0]))
    for place, c in enumerate(order):
        if place and owner[order[place - 1]] == owner[c]:
            continue
        p, i = hits[owner[c]]
        if fit[c] >= refuse or mixed(pages[p][i]):
            out[p][i] = cands[c][0]
    return out


def _applied(flow: str, fixes: dict[int, str]) -> str:
    """The text with the words put right, in the case they stood in."""
    out, at = [], 0
    for paragraph in flow.split("\n"):
        line = []
        for token in paragraph.split():
            if word_of(token):
                if at in fixes:
                    core, new = _OUTER.sub("", token), fixes[at]
                    if core.isupper() and len(core) > 1:
                        new = new.upper()
                    elif core[:1].isupper() or not core[:1].isalpha() and (not line or re.search(r"[.!?…]$", line[-1])):
                        new = new[:1].upper() + new[1:]
                    if core[-1:] == "н" and new[-1:] == "ң" and token.endswith("н,"):
                        token = token[:-1]  # the comma was the tail of the letter
                    token = token.replace(core, new, 1)
                at += 1
            line.append(token)
        out.append(" ".join(line))
    return "\n".join(out)


REPAIRED = "page_id bigint, broken_word boolean, misread_char boolean, running_header boolean, page_number boolean, repaired string"


def repair(df: DataFrame, rare: float = 1e-4) -> DataFrame:
    """(page_id, broken_word, misread_char, running_header, page_number, repaired) for every page of df(page_id, file_id, page_no, text)."""
    spark = df.sparkSession
    texts = staged(read_pages(df), "page-texts")
    counts = word_counts(texts)
    total = counts.agg(F.sum("n")).head()[0] or 0
    most = max(16, math.floor(rare * total))
    vectors = spark.sparkContext.broadcast(word_vectors(texts, total) if counts.where("n >= 5").head(1) else None)
    common = spark.sparkContext.broadcast({r.word for r in counts.where(F.col("n") > most).select("word").toLocalIterator()})

    def rare_words(batches):
        for batch in batches:
            pages, flows = (batch.column(c).to_pylist() for c in ("page_id", "flow"))
            yield _batch([(page, w) for page, flow in zip(pages, flows) for w in set(words_of(flow)) - common.value], "page_id bigint, word string")

    def fix(batches):
        for batch in batches:
            cols = {c: batch.column(c) for c in ("page_id", "broken_word", "running_header", "page_number")}
            flows = batch.column("flow").to_pylist()
            linked = [_linked(x) for x in batch.column("linked").to_pylist()]
            fixes = choose([words_of(f) if x else [] for f, x in zip(flows, linked)], linked, vectors.value)
            done = [_applied(f, x) if x else "\n".join(" ".join(p.split()) for p in f.split("\n")) for f, x in zip(flows, fixes)]
            yield pa.RecordBatch.from_arrays(
                [cols["page_id"], cols["broken_word"], pa.array([bool(x) for x in fixes]), cols["running_header"], cols["page_number"], pa.array(done, pa.string())], [x.split()[0] for x in REPAIRED.split(", ")],
            )

    hits = texts.select("page_id", "flow").mapInArrow(rare_words, "page_id bigint, word string").join(links(counts, most), "word")
    per_page = hits.groupBy("page_id").agg(F.array_join(F.collect_list(F.concat_ws("\n", "word", "candidates")), "\n\n").alias("linked"))
    return texts.join(per_page, "page_id", "left").mapInArrow(fix, REPAIRED)


def _linked(lines: str | None) -> dict[str, list[tuple[str, int, int]]]:
    """Candidates by word, from paragraphs of lines: the word, then a candidate on each line."""
    out = {}
    for part in lines.split("\n\n") if lines else []:
        word, *cands = part.split("\n")
        out[word] = [(w, int(n), int(e)) for w, n, e in (c.split("\t") for c in cands)]
    return out


def defects(repaired: DataFrame) -> DataFrame:
    """One row per page and defect."""
    kinds = ("broken_word", "misread_char", "running_header", "page_number")
    each = F.explode(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds])).alias("defect")
    return repaired.select("page_id", each).where("defect is not null")

"""Problem 2: cutting oversized texts into pieces at natural boundaries.

Boundaries of a text are weighed: paragraph end 4, sentence end 3, line end 2, word end 1. A sparse table of
range maxima over them answers "strongest cut with a permissible length, the rightmost of equals" in constant
time; the next piece starts `overlap` characters before the cut.

Defined results: whitespace runs count as one space and the ends are trimmed, lengths are code points; a text within the limit is one
piece; null, empty and blank texts give no piece; where a window holds no boundary the cut is made at the limit; repeated rows give repeated
pieces; other columns stay, except that the columns made here replace columns of their names.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {4: "paragraph", 3: "sentence", 2: "line", 1: "word", 0: "none", 9: "end"}
_GAP = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…;][\"'»”’)\]]*$")
_MARKER = re.compile(r"(?:^|\s)(?:\d{1,3}|\w)\.$")  # "4." of a list, an initial


def boundaries(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with single spaces, and place and strength of every possible cut within it."""
    raw = text.strip()
    words, at, strength, last, place = [], [], [], 0, 0
    for gap in _GAP.finditer(raw):
        word = raw[last : gap.start()]
        place += len(word)
        words.append(word)
        before = raw[max(0, gap.start() - 6) : gap.start()]
        level = 1
        if gap.group().count("\n") > 1 or "\x0c" in gap.group() or "\u2029" in gap.group():
            level = 4
        elif _SENTENCE.search(before) and not _MARKER.search(before):
            level = 3
        elif "\n" in gap.group():
            level = 2
        at.append(place)
        strength.append(level)
        place += 1
        last = gap.end()
    words.append(raw[last:])
    return " ".join(words), np.array(at, "i8"), np.array(strength, "i8")


class RangeMax:
    """Position of the strongest element of a range, the rightmost of equals, by a sparse table."""

    def __init__(self, strength: np.ndarray, widest: int):
        # strength first, then the index: the maximum of this is the rightmost strongest
        self.levels = [(strength << 40) | np.arange(len(strength), dtype="i8")]
        step = 1
        while 2 * step <= min(widest, len(strength)):
            prev = self.levels[-1]
            self.levels.append(np.maximum(prev[:-step], prev[step:]))
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        """Index in [lo, hi); the range is not empty and not wider than the table was built for."""
        level = (hi - lo).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi - (1 << level)])) & ((1 << 40) - 1)


def cut(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """(start, end, boundary, piece) over the text with single spaces."""
    if text is None or not (text := text.strip()):
        return []
    flat, at, strength = boundaries(text)
    if len(flat) <= limit:
        return [(0, len(flat), NAMES[9], flat)]
    table = RangeMax(strength, limit) if len(at) else None
    least = max(overlap + 1, limit // 2)
    pieces, start = [], 0
    while len(flat) - start > limit:
        end, kind = start + limit, 0
        for shortest in (least, overlap + 1):
            lo, hi = np.searchsorted(at, [start + shortest, start + limit + 1]).tolist()
            if lo < hi:
                i = table.best(lo, hi)
                end, kind = int(at[i]), int(strength[i])
                break
        pieces.append((start, end, NAMES[kind], flat[start:end]))
        start = end - overlap
    pieces.append((start, len(flat), NAMES[9], flat[start:]))
    return pieces


PIECES = "array<struct<piece_start:int,piece_end:int,boundary:string,piece:string>>"


def split_texts(df: DataFrame, text: str = "text", limit: int = 800, overlap: int = 120) -> DataFrame:
    """One row per piece: all columns of df, then piece_index (from 0), piece_count, piece_start, piece_end, boundary, piece."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be below half the limit")

    @F.pandas_udf(PIECES)
    def cut_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("piece_start", "piece_end", "boundary", "piece"), p)) for p in cut(t, limit, overlap)])

    made = ("piece_index", "piece_count", "piece_start", "piece_end", "boundary", "piece")
    flat = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    whole = F.array(F.struct(F.lit(0).alias("piece_start"), F.length(flat).alias("piece_end"), F.lit("end").alias("boundary"), flat.alias("piece")))
    # texts within the limit never reach Python
    kept = df.drop(*made)
    small, large = F.coalesce(F.length(flat) <= limit, F.lit(True)), F.length(flat) > limit
    one = kept.where(small & (F.length(flat) > 0)).withColumn("_p", whole.cast(PIECES))
    many = kept.where(large).withColumn("_p", cut_all(F.col(text)))
    both = one.unionByName(many).withColumn("piece_count", F.size("_p"))
    wide = both.select("*", F.posexplode("_p").alias("piece_index", "_one")).drop("_p")
    return wide.select(*kept.columns, "piece_index", "piece_count", *[F.col("_one")[c].alias(c) for c in made[2:]])

"""Problem 3: the language of every text and of every sentence of a mixed text, with a confidence.

Sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to 4, hashed), trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by one temperature.

The inverse document frequencies come from all texts. The regression is fitted on a bounded sample of labelled
texts (`sample` texts of at most `sample_chars` characters, in hash order); as the labels are partly wrong, it is fitted twice, the
second time without the sentences on which the first fit firmly contradicts the label. Each sample sentence
is also given in the other scripts it may be typed in, so that language is learned apart from script.

Defined results: null, empty and wordless texts (tables, formulas) have no language; ties go to the language first in LANGS;
a repeated record counts once; texts of any length are read whole.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolqyn.llm.sampling import hash_sample

LANGS = ("ru", "kk", "en")
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)

# Spellings of labels.
SPELLINGS = {
    "ru": ("ru", "rus", "russian", "русский", "рус", "русский язык", "орыс", "орысша", "орыс тілі"),
    "kk": ("kk", "kz", "kaz", "kazakh", "қазақ", "қазақша", "қазақ тілі", "казахский", "каз", "казахский язык", "qazaq", "qazaqsha", "qazaqşa"),
    "en": ("en", "eng", "english", "английский", "англ", "английский язык", "ағылшын", "ағылшынша", "ағылшын тілі"),
}

# The scripts a language may be typed in.
KAZAKH_LETTERS = "әғқңөұүһі"
KAZAKH_AS_RUSSIAN = "агкноуухи"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
RUSSIAN_LATIN = ("a", "b", "v", "g", "d", "e", "io", "j", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "sch", "", "y", "", "e", "iu", "ia")
RUSSIAN_LATIN_OTHER = {"ё": "yo", "ж": "zh", "й": "y", "х": "kh", "ц": "c", "ш": "ş", "щ": "shch", "э": "e", "ю": "yu", "я": "ya"}
KAZAKH_LATIN = {"ә": "ä", "ғ": "ğ", "қ": "q", "ң": "ñ", "ө": "ö", "ұ": "ū", "ү": "ü", "һ": "h", "і": "ı", "ш": "ş", "и": "i", "у": "u", "й": "i"}
KAZAKH_LATIN_OTHER = {"ә": "a", "ғ": "g", "қ": "k", "ң": "n", "ө": "o", "ұ": "u", "ү": "u", "һ": "h", "і": "i", "ш": "sh", "ж": "zh"}


def named_language(label: Column) -> Column:
    """ru, kk or en for a label that names one in any spelling or with a region, else null."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", ""))
    out = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(plain.isin(*names), lang).otherwise(out)
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: kind (0 other, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 white space, 5 line feed, 6 sentence end) and lower case."""
    kind, lower = np.zeros(0x2100, "u1"), np.full(0x2100, 32, "u4")
    for c in range(0x2100):
        ch = chr(c)
        if ch.isalpha():
            kind[c] = 2 if ch.isupper() else 1
            lower[c] = ord(ch.lower()[0])
        elif ch.isdigit():
            kind[c] = 3
        elif ch in "\n\r\x0c\u2028\u2029":
            kind[c] = 5
        elif ch.isspace():
            kind[c] = 4
        elif ch in ".!?…;":
            kind[c] = 6
    return kind, lower


KIND, LOWER = _tables()
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")


@dataclass
class Sentences:
    """Sentences of a batch: text number, start and end in the text, letters in words; features by (bucket, sentence)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    bucket: list[np.ndarray]
    owner: list[np.ndarray]


def analyse(texts: list[str]) -> Sentences:
    lengths = np.array([len(t) for t in texts], "i8")
    joined = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "u4")
    code = np.minimum(joined, 0x20FF)
    kind = KIND[code]
    n = len(code)
    # a sentence ends at a line feed, or at an end mark before white space
    stop = kind == 5
    stop[:-1] |= (kind[:-1] == 6) & ((kind[1:] == 4) | (kind[1:] == 5))
    sent = np.cumsum(stop) - stop
    count = int(sent[-1]) + 1 if n else 0
    # tokens of letters and digits; formulas and codes are no words
    alnum = (kind >= 1) & (kind <= 3)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alnum.view("u1"), [0]]).astype("i1")))
    ts, te = edge[::2], edge[1::2]
    low, up, dig = (np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2, 3))
    nl, nu, nd = low[te] - low[ts], up[te] - up[ts], dig[te] - dig[ts]
    word = (nd == 0) & ((nu == 0) | (nl == 0) | ((nu == 1) & (kind[ts] == 2)))
    letters = np.bincount(sent[ts], weights=(te - ts) * (word & (nl + nu >= 2) & ~((nl == 0) & (nu <= 2))), minlength=count)
    keep = np.zeros(n + 1, "i4")
    np.add.at(keep, ts[word], 1)
    np.add.at(keep, te[word], -1)
    inside = np.cumsum(keep[:-1]) > 0
    c = np.where(inside, LOWER[code], 32).astype("u8")
    buckets, owners = [], []
    for order in ORDERS:
        m = n - order + 1
        if m <= 0:
            continue
        if order == 1:
            ok = inside
        elif order == 2:
            ok = inside[:-1] | inside[1:]
        elif order == 3:
            ok = inside[1:-1]
        else:
            ok = inside[1:-2] & inside[2:-1]
        at = np.flatnonzero(ok[:m])
        h = np.full(len(at), order, "u8")
        for j in range(order):
            h = (h ^ c[at + j]) * _MULT[j]
            h ^= h >> np.uint64(29)
        buckets.append((h >> np.uint64(48)).astype("i4"))
        owners.append(sent[at])
    bounds = np.flatnonzero(stop)
    first = np.concatenate([[0], bounds + 1])[:count]
    last = np.concatenate([bounds + 1, [n]])[:count]
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.searchsorted(begin, first, "right") - 1
    return Sentences(text, first - begin[text], np.minimum(last - begin[text], lengths[text]), letters, buckets, owners)


def typed_otherwise(sentence: str, lang: str, way: int) -> str:
    """A sentence of ru or kk in another script: 0 Latin, 1 another Latin, 2 (kk only) Russian letters."""
    s = sentence.lower()
    if lang == "kk" and way == 2:
        return s.translate(str.maketrans(KAZAKH_LETTERS, KAZAKH_AS_RUSSIAN))
    if lang == "en" or not any("а" <= ch <= "я" for ch in s):
        return sentence
    table = dict(zip(CYRILLIC, RUSSIAN_LATIN))
    if lang == "kk":
        table |= KAZAKH_LATIN if way == 0 else KAZAKH_LATIN | KAZAKH_LATIN_OTHER
    elif way == 1:
        table |= RUSSIAN_LATIN_OTHER
    return s.translate(str.maketrans(table))


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x languages, times the inverse document frequency
    square: np.ndarray  # inverse document frequencies, squared
    bias: np.ndarray
    temperature: float

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        k = len(s.text)
        total = np.zeros((k, len(LANGS)))
        size = np.zeros(k)
        for b, o in zip(s.bucket, s.owner):
            size += np.bincount(o, weights=self.square[b], minlength=k)
            for j in range(len(LANGS)):
                total[:, j] += np.bincount(o, weights=self.weights[b, j], minlength=k)
        return (total / np.sqrt(np.maximum(size, 1e-9))[:, None] + self.bias) / self.temperature


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram bucket occurs, over all texts. What comes to the driver has one row per bucket."""

    def count(batches):
        total, flags, n = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "u1"), 0
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for lo in range(0, len(texts), 64):
                s = analyse(texts[lo : lo + 64])
                for i in range(len(texts[lo : lo + 64])):
                    flags[:] = 0
                    a, z = np.searchsorted(s.text, [i, i + 1])
                    for b, o in zip(s.bucket, s.owner):
                        x, y = np.searchsorted(o, [a, z])
                        flags[b[x:y]] = 1
                    total += flags
                n += len(texts[lo : lo + 64])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[there, -1].astype("i4")), pa.array(np.r_[total[there], n])], ["bucket", "n"])

    rows = df.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    texts = int(rows.n[rows.bucket == -1].sum())
    rows = rows[rows.bucket >= 0]
    out[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return out, texts


def ftrl(x: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 2, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002):
    """x: of each sentence batch (bucket, sentence within the batch, value); y: class of each sentence, in the same order."""
    k = len(LANGS)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    w = np.zeros((BUCKETS + 1, k))
    epochs = max(epochs, -(-60 // max(1, len(x))))  # a small sample is gone through more often
    for _ in range(epochs):
        at = 0
        for bucket, owner, value in x:
            m = int(owner[-1]) + 1 if len(owner) else 0
            logits = np.tile(w[-1], (m, 1))
            for j in range(k):
                logits[:, j] += np.bincount(owner, weights=w[bucket, j] * value, minlength=m)
            p = softmax(logits)
            p[np.arange(m), y[at : at + m]] -= 1
            at += m
            p /= max(1, m) ** 0.5
            for j in range(k):
                g = np.bincount(bucket, weights=p[owner, j] * value, minlength=BUCKETS + 1)
                g[-1] = 0.1 * p[:, j].sum()  # the bias moves slowly
                sigma = (np.sqrt(n[:, j] + g * g) - np.sqrt(n[:, j])) / alpha
                z[:, j] += g - sigma * w[:, j]
                n[:, j] += g * g
                w[:, j] = np.where(np.abs(z[:, j]) <= l1, 0, -(z[:, j] - np.sign(z[:, j]) * l1) / ((beta + np.sqrt(n[:, j])) / alpha + l2))
    return w


def _batches(sentences: list[str], idf: np.ndarray, size: int = 192):
    out = []
    size = min(size, max(16, len(sentences) // 20))
    for lo in range(0, len(sentences), size):
        part = [x.replace("\n", " ") for x in sentences[lo : lo + size]]
        s = analyse(part)
        owner = [s.text[o] for o in s.owner]
        bucket, owner = np.concatenate(s.bucket), np.concatenate(owner)
        total = np.bincount(owner, weights=idf[bucket] ** 2, minlength=len(part))
        # a last, neutral feature keeps batches aligned when a sentence has no n-gram
        bucket, owner = np.r_[bucket, np.full(len(part), BUCKETS)], np.r_[owner, np.arange(len(part))]
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        value = np.where(bucket == BUCKETS, 0.0, np.r_[idf, 0][bucket] / np.sqrt(np.maximum(total, 1e-9))[owner])
        out.append((bucket, owner, value))
    return out


def fit(df: DataFrame, key: str, text: str, label: str, sample: int = 2000, sample_chars: int = 20_000, sentences: int = 12_000) -> Model:
    """sample: labelled texts per language at most; sentences: of the sample at most. Document frequencies: of all texts."""
    found, texts = document_frequencies(df, text)
    idf = np.log((1 + texts) / (1 + found)) + 0.1
    rows = df.select(key, text, named_language(F.col(label)).alias("lang")).where("lang is not null")
    there = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    fit_size = rows.where(F.length(text).between(20, sample_chars))
    parts = [hash_sample(fit_size.where(F.col("lang") == x), key, sample, there.get(x, 0), 7).toPandas() for x in LANGS]
    texts_, langs = [], []
    for part in parts:
        own = []
        for t in part[text]:
            s = analyse([t])
            own += [t[a:b] for a, b, n in zip(s.start, s.end, s.letters) if n >= 12]
        # spread over the sample, the same number for each language
        step = max(1, -(-len(own) // (sentences // len(LANGS))))
        own = own[::step]
        texts_ += own
        langs += [LANGS.index(part.lang.iloc[0])] * len(own) if len(part) else []
    if not texts_:
        return Model(np.zeros((BUCKETS, len(LANGS))), np.ones(BUCKETS), np.zeros(len(LANGS)), 1.0)
    y = np.array(langs)
    order = np.random.default_rng(11).permutation(len(y))
    texts_, y = [texts_[i] for i in order], y[order]
    held = len(y) // 8
    x = _batches(texts_, idf)
    w = ftrl(x, y)

    def logits(batches, w):
        return np.concatenate([np.stack([np.bincount(o, weights=w[b, j] * v, minlength=int(o[-1]) + 1) for j in range(len(LANGS))], 1) + w[-1] for b, o, v in batches])

    p = softmax(logits(x, w))
    sure = p[np.arange(len(y)), y] > 0.15
    clean = [(t, c) for t, c, ok in zip(texts_, y, sure) if ok]
    train, test = clean[held:], clean[:held]
    more = list(train)
    for i, (t, c) in enumerate(train):
        if LANGS[c] != "en" and i % 2 == 0:
            more.append((typed_otherwise(t, LANGS[c], (i // 2) % (3 if LANGS[c] == "kk" else 2)), c))
    pick = np.random.default_rng(12).permutation(len(more))
    more = [more[i] for i in pick]
    w = ftrl(_batches([t for t, _ in more], idf), np.array([c for _, c in more]), epochs=3)
    temperature = 1.0
    if test:
        z, c = logits(_batches([t for t, _ in test], idf), w), np.array([c for _, c in test])
        grid = np.geomspace(0.02, 20, 60)
        temperature = float(grid[np.argmin([-np.log(softmax(z / g)[np.arange(len(c)), c] + 1e-12).mean() for g in grid])])
    return Model((w[:-1] * idf[:, None]).astype("f4"), (idf**2).astype("f4"), w[-1], temperature)


RESULT = "struct<langs:array<string>,confidences:array<double>,shares:array<double>,segments:array<struct<seg_start:int,seg_end:int,lang:string,confidence:double>>>"


def assigner(model: Model, second: float = 0.25, segments: bool = True):
    """A column function: text -> languages that hold at least `second` of the letters in words (the first holds most), and segments."""

    @F.pandas_udf(RESULT)
    def assign(texts: pd.Series) -> pd.DataFrame:
        out = []
        values = [t if isinstance(t, str) else "" for t in texts]
        lo = 0
        while lo < len(values):
            hi, chars = lo, 0
            while hi < len(values) and (hi == lo or chars + len(values[hi]) < 200_000):
                chars += len(values[hi])
                hi += 1
            s = analyse(values[lo:hi])
            p = softmax(model.sentence_logits(s))
            best = p.argmax(axis=1)
            cells = s.text * len(LANGS) + best
            size = (hi - lo) * len(LANGS)
            letters = np.bincount(cells, weights=s.letters, minlength=size).reshape(-1, len(LANGS))
            sure = np.bincount(cells, weights=s.letters * p.max(axis=1), minlength=size).reshape(-1, len(LANGS))
            ends = np.searchsorted(s.text, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                all_ = letters[i].sum()
                if not all_:
                    out.append(([], [], [], []))
                    continue
                order = [j for j in np.argsort(-letters[i], kind="stable") if letters[i, j] >= second * all_]
                order = order or [int(np.argmax(letters[i]))]
                parts: list = []
                if segments:
                    for q in range(ends[i], ends[i + 1]):
                        if s.letters[q] == 0:
                            continue
                        if parts and parts[-1][2] == best[q]:
                            last = parts[-1]
                            last[1], last[3], last[4] = s.end[q], last[3] + s.letters[q] * p[q, best[q]], last[4] + s.letters[q]
                        else:
                            parts.append([s.start[q], s.end[q], best[q], s.letters[q] * p[q, best[q]], s.letters[q]])
                    parts = [{"seg_start": int(a), "seg_end": int(b), "lang": LANGS[c], "confidence": round(float(v / n), 6)} for a, b, c, v, n in parts]
                out.append(([LANGS[j] for j in order], [round(float(sure[i, j] / letters[i, j]), 6) for j in order], [round(float(letters[i, j] / all_), 6) for j in order], parts))
            lo = hi
        return pd.DataFrame(out, columns=["langs", "confidences", "shares", "segments"])

    return assign


def assign_languages(df: DataFrame, model: Model, text: str = "text", segments: bool = True) -> DataFrame:
    """df with `languages`: the struct of RESULT."""
    return df.withColumn("languages", assigner(model, segments=segments)(F.col(text)))


def wrong_labels(df: DataFrame, langs: Column, label: Column) -> DataFrame:
    """Rows whose label names no language, or not the one found, or that hold two; `lang` has each language found, a row each."""
    named = named_language(label)
    case = (F.size(langs) > 0) & (named.isNull() | (F.size(langs) > 1) | (named != langs[0]))
    return df.where(case).withColumn("lang", F.explode(langs))

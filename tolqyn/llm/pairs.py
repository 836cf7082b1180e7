"""Problem 5: unusable answers of question-answer pairs, with the kind of defect.

empty          nothing, invisible characters, or a placeholder
copy           the answer repeats the whole prompt and nothing else: the answer is run through a suffix automaton of the
               prompt's words; both must be covered by matches of at least three words (or the whole prompt)
refusal        every sentence declines (automaton of denials and of what is denied, a few words apart) or is a filler that goes with it,
               and the reference does not decline too
other_language votes of stopwords, endings and letters give another language than the prompt's
truncated      an open delimiter, a hanging mark or hyphen, or a last sentence without end mark (an ellipsis is none) whose last words
               end no sentence elsewhere

At most one defect per field, in this order. How often words end a sentence is counted over all prompts and answers, in the same pass
over the texts: each batch gives its verdicts and its counts.

An answer that repeats the question and adds a word of its own ("... Yes.") is no copy; how much of it is copied is in `coverage`.

Defined results: a null prompt has no words (no copy, no language); repeated rows count once; equal ids with different texts are
judged row by row and give each defect once; texts of any length are read whole.
"""

import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolqyn.runtime import staged

# Fixed values.
PLACEHOLDERS = ("", "null", "none", "nil", "nan", "n/a", "na", "n.a.", "empty", "(empty)", "_(empty)_", "todo", "tbd", "no answer", "[]", "{}", "нет ответа", "пусто", "жауап жоқ", "undefined")
COPY_MARKS = ("q", "question", "вопрос", "сұрақ", "в", "с", "prompt")
# A denial and, at most GAP words before or after it, beginnings of what is denied.
GAP = 4
DENIALS = (
    (("не могу", "не смогу", "не в состоянии", "не получится", "невозможно", "отказываюсь", "затрудняюсь", "не берусь", "не умею", "не найден", "не нашел", "не нашёл", "не нашл"), ("ответ", "помо", "сказать", "подсказать", "выполнить", "объяснить")),
    (("нет", "не располагаю", "не имею", "отсутств", "не содерж"), ("ответа", "данных", "информаци", "сведени", "инструкци")),
    (("не разбираю", "не рассматриваю", "не обсуждаю", "не отвечаю", "не занимаюсь"), ("вопрос", "тем", "задач")),
    (("не знаю",), ("ответ", "что ответить", "как ответить")),
    (("алмаймын", "мүмкін емес", "бас тартамын", "білмеймін", "қиналамын"), ("жауа", "көмек", "айт", "түсіндір", "орында")),
    (("жоқ", "табылмады", "табылған жоқ", "кездеспеді"), ("жауап", "деректер", "ақпарат", "мәлімет", "нұсқау")),
    (("қарастырмаймын", "талқыламаймын", "жауап бермеймін"), ("сұрақ", "тақырып", "мәселе")),
    (("cannot", "can't", "can not", "could not", "unable", "not able", "won't be able", "must decline", "i decline", "have to decline", "refuse"), ("answer", "help", "assist", "respond", "provide", "tell", "comment")),
    (("no ", "not contain", "n't contain", "not have", "n't have", "not know", "n't know", "lack", "not find", "n't find", "not found"), ("answer to", "an answer", "the answer", "data to", "data for", "information", "required instruction", "the required", "instructions for")),
    (("not something i", "do not", "don't", "not able to"), ("handle", "discuss", "take such", "deal with")),
)
FILLERS = (
    "обратитесь", "попробуйте", "уточните", "задайте", "извините", "простите", "к сожалению", "прошу прощения", "спросите", "переформулируйте",
    "хабарласыңыз", "қойып көріңіз", "нақтылаңыз", "кешіріңіз", "өкінішке қарай", "ғафу етіңіз", "мұғалімнен сұраңыз",
    "try another", "ask your teacher", "please rephrase", "please ask", "please try", "sorry", "unfortunately", "i'm afraid", "i apologise", "i apologize",
)
CONTRAST = (" но ", " однако", " зато ", " but ", " however", " бірақ ", " алайда ", " дегенмен ")
STOPWORDS = {
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о об из ему при если или ни до это эта этот этом того тем чтобы для мы их чем была сам без будет через после потому поэтому когда которые который между собой под над где можно нужно около равна равно этого вместе здесь группы почему верно ли".split(),
    "kk": "және мен бен пен да де бұл ол осы сол үшін бірақ себебі өйткені сондықтан егер кейін дейін бойынша арқылы туралы сияқты бар жоқ емес болады болып еді екен деп десек деген қалай қандай неге неліктен ретінде бірге шамамен рас па ма бе иә тең соң ең әр біз сіз олар мынада".split(),
    "en": "the a an and or of to in is are was were be been it its this that these those for with as at by from on not no yes but if then than so because which who what when where how why can will would should do does did has have had there their they we you i about into after before between under over".split(),
}
ENDINGS = {"ru": ("ого", "его", "ому", "ыми", "ими", "ться", "ется", "ются", "ает", "яет", "уют", "яют", "ают", "ный", "ная", "ное", "ные", "ной", "ость", "ения", "ение", "ании", "ется", "ого", "ть", "ёт", "ишь", "ите", "йте"), "kk": ("дың", "дің", "ның", "нің", "тың", "тің", "лар", "лер", "дар", "дер", "тар", "тер", "ады", "еді", "йды", "йді", "ған", "ген", "қан", "кен", "ыңыз", "іңіз", "мен", "пен", "дан", "ден", "нан", "нен", "сы", "сі"), "en": ("ing", "tion", "ed", "ly", "ness", "ment")}
END_MARKS = ".!?…;。"

_WORD = re.compile(r"\w+")
_INVISIBLE = re.compile(r"[\s\u00ad\u034f\u061c\u115f\u180e\u200b-\u200f\u2028-\u202f\u2060-\u2064\u3164\ufeff]+")
_KK = re.compile("[әғқңөұүһі]")
_CLAUSE = re.compile("[,:;]")
_SENTENCE = re.compile(rf"(?<=[{END_MARKS}])\s+|\n+")
_ENDED = re.compile(rf"[{END_MARKS})\]}}]$")
_ELLIPSIS = re.compile(r"\s*(?:…|\.(?:\s?\.){2,})[….]*$")


def _automaton(phrases):
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def _denials():
    """Matches are (rule, is it the denial), of words from their beginning."""
    of: dict[str, list] = {}
    for rule, (denials, matters) in enumerate(DENIALS):
        for w in denials:
            of.setdefault(w if w.startswith("n't") else f" {w}", []).append((rule, True))
        for w in matters:
            of.setdefault(f" {w}", []).append((rule, False))
    a = ahocorasick.Automaton()
    for w, found in of.items():
        a.add_word(w, (len(w), found))
    a.make_automaton()
    return a


_DECLINES, _FILLERS = _denials(), _automaton(FILLERS)
_SHARED = {w for a in STOPWORDS for b in STOPWORDS if a != b for w in set(STOPWORDS[a]) & set(STOPWORDS[b])}
_STOP = {w: lang for lang, ws in STOPWORDS.items() for w in ws if w not in _SHARED}


class Text:
    """A text read once: its sentences and their words in lower case."""

    __slots__ = ("raw", "low", "sents", "parts", "words")

    def __init__(self, text: str | None):
        self.raw = text if isinstance(text, str) else ""
        self.low = self.raw.lower()
        self.sents = sentences(self.low)
        self.parts = [_WORD.findall(s) for s in self.sents]
        self.words = [w for p in self.parts for w in p]


def is_empty(text: Text) -> bool:
    if len(text.raw) > 40 and text.words:
        return False
    plain = _INVISIBLE.sub(" ", text.low).strip()
    return plain.strip("\"'`*") in PLACEHOLDERS or not re.search(r"\w", plain)


class SuffixAutomaton:
    """All runs of words of a prompt."""

    def __init__(self, words: list[str]):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], least: int) -> tuple[int, set[str]]:
        """How many of the words lie in matches of at least `least` words, and which words those are."""
        state = run = 0
        until = [0] * (len(words) + 1)
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            else:
                run = 0
            until[i] = run
        marked = [False] * len(words)
        left = 0
        for i in range(len(words) - 1, -1, -1):
            if until[i] >= least:
                left = max(left, until[i])
            if left:
                marked[i] = True
                left -= 1
        return sum(marked), {w for w, m in zip(words, marked) if m}


def copied(prompt: Text, answer: Text) -> tuple[float, float]:
    """Shares of the answer's words that lie in runs of the prompt, and of the prompt's words that are met so."""
    q, a = prompt.words, answer.words
    while a and a[0] in COPY_MARKS and (not q or q[0] != a[0]):
        a = a[1:]
    if len(q) > 1 and q[0].isdecimal() and a and a[0] != q[0]:
        q = q[1:]  # the number of the question
    if not q or not a:
        return 0.0, 0.0
    least = min(3, len(q))
    runs = set(zip(*[q[i:] for i in range(least)]))
    if runs.isdisjoint(zip(*[a[i:] for i in range(least)])):
        return 0.0, 0.0  # no run of the least length is shared, so none is covered
    n, words = SuffixAutomaton(q).covered(a, least)
    known = set(q)
    return n / len(a), len(words & known) / len(known)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if s.strip()]


def _denied(low: str) -> int:
    """Where the last denial with its matter ends, else -1."""
    met: dict[int, list[tuple[int, int, bool]]] = {}
    out = -1
    for end, (size, found) in _DECLINES.iter(low):
        for rule, denial in found:
            for start, stop, other in met.get(rule, ()):
                between = low[stop + 1 : max(stop + 1, end - size + 1)]
                if other != denial and between.count(" ") <= GAP and not _CLAUSE.search(between):
                    out = max(out, end)
            met.setdefault(rule, []).append((end - size + 1, end, denial))
    return out


def declines(text: Text) -> bool:
    """Every sentence declines or is a filler, and one does decline."""
    any_ = False
    if _denied(f" {' '.join(text.low.replace('’', chr(39)).split())} ") < 0:
        return False
    for s, words in zip(text.sents, text.parts):
        low = f" {' '.join(s.replace('’', chr(39)).split())} "
        no = _denied(low)
        if no >= 0:
            # what follows a contrast is content
            rest = min((low.find(c, no) for c in CONTRAST if low.find(c, no) >= 0), default=-1)
            tail = low[rest:] if rest >= 0 else ""
            if len(words) > 16 or len(_WORD.findall(tail)) > 3 and not any(True for _ in _FILLERS.iter(tail)):
                return False
            any_ = True
        elif not (any(True for _ in _FILLERS.iter(low)) and len(words) <= 12):
            return False
    return any_


def _vote(w: str) -> tuple[int, int, int, int, int]:
    """What a word says: letters of Cyrillic or Latin, and votes for ru, kk and en in tenths."""
    if re.search(r"\d", w):
        return 0, 0, 0, 0, 0
    latin, own = bool(re.match("[a-z]", w)), bool(_KK.search(w))
    cyrillic = not latin and (re.match("[а-яё]", w) is not None or _KK.match(w) is not None)
    votes = {"ru": 0, "kk": 0, "en": 0}
    if w in _STOP:
        votes[_STOP[w]] += 10
    if own:
        votes["kk"] += 15
    elif len(w) > 4 and not latin:
        for lang in ("ru", "kk"):
            votes[lang] += 5 * w.endswith(ENDINGS[lang])
        votes["ru"] += 3  # a Kazakh word of this length mostly has a letter of its own
    elif len(w) > 4:
        votes["en"] += 5 * w.endswith(ENDINGS["en"]) + 1
    return int(cyrillic and len(w) > 2), int(latin and len(w) > 2), votes["ru"], votes["kk"], votes["en"]


class _Votes(dict):
    """Votes by word, in each task's process."""

    def __missing__(self, w: str):
        v = self[w] = _vote(w)
        return v


_VOTES = _Votes()  # emptied when full


def voted_language(text: Text) -> str | None:
    if not text.words:
        return None
    if len(_VOTES) > 200_000:
        _VOTES.clear()
    cyrillic, latin, ru, kk, en = map(sum, zip(*map(_VOTES.__getitem__, text.words)))
    votes = {"ru": 0 if latin > 2 * cyrillic else ru, "kk": 0 if latin > 2 * cyrillic else kk, "en": 0 if cyrillic > 2 * latin else en}
    best = max(votes, key=lambda k: votes[k])
    others = max(v for k, v in votes.items() if k != best)
    return best if votes[best] >= 8 and votes[best] > others else None


_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«"}
_DELIMITERS = re.compile(r"[()\[\]{}«»]")
_HANGING = re.compile(r"[,:\-–—(«&/]\s*$")


def is_open(text: str) -> bool:
    """A delimiter is open at the end, or the text hangs on a mark or hyphen."""
    stack = []
    for ch in _DELIMITERS.findall(text):
        if ch in _PAIRS.values():
            stack.append(ch)
        elif ch in _PAIRS and stack and stack[-1] == _PAIRS[ch]:
            stack.pop()
    return bool(stack) or bool(_HANGING.search(text[-40:])) and len(_WORD.findall(text)) > 1


def _masked(words: list[str]) -> list[str]:
    return [w if w.isalpha() else _DIGITS.sub("#", w) for w in words]


_DIGITS = re.compile(r"\d+")


def tail_of(text: str) -> tuple[str, str] | None:
    """The last two words and the last word, numbers masked."""
    words = _masked(_WORD.findall(text.lower())[-2:])
    return (" ".join(words), words[-1]) if words else None


def judge(prompt: str | None, expected: str | None, answer: str | None) -> list[tuple[str | None, str | None, str | None, float]]:
    """For expected and answer: the defect, or the tail that decides whether the text is complete, and the copied share."""
    return _judged(Text(prompt), Text(expected), Text(answer))


def _judged(prompt: Text, expected: Text, answer: Text) -> list[tuple[str | None, str | None, str | None, float]]:
    out = []
    lang = voted_language(prompt)
    for text in (expected, answer):
        defect, tail, last = None, None, None
        covered, met = copied(prompt, text)
        if is_empty(text):
            defect = "empty"
        elif covered == 1 and met >= 0.9:
            defect = "copy"
        elif text is answer and declines(text) and not declines(expected):
            defect = "refusal"
        else:
            own = voted_language(text)
            plain = text.raw.strip().rstrip("\"'»”’* ")
            if lang and own and own != lang:
                defect = "other_language"
            elif is_open(plain):
                defect = "truncated"
            elif not _ENDED.search(plain := _ELLIPSIS.sub("", plain)):
                ends = sentences(plain)
                t = tail_of(plain)
                if t:
                    tail, last = t
                    size = len(_WORD.findall(ends[-1]))
                    # a value with its unit, a formula or a word is an answer of its own
                    if len(ends) == 1 and (size <= 2 or size <= 5 and re.search(r"\d", ends[-1]) and re.search(r"\d\S*\s*\S{0,4}$", plain)):
                        tail = None
        out.append((defect, tail, last, round(covered, 4)))
    return out


class Ends:
    """Counts of a task: word pairs and words in all places of ended sentences, and at their ends. Sentences are gathered and counted
    together."""

    def __init__(self):
        self.gathered: list[list] = [[], [], [], []]
        self.counts = [Counter() for _ in self.gathered]

    def read(self, text: Text) -> None:
        """Takes the sentences of a text that have an end mark other than an ellipsis."""
        pairs, pair_ends, words, word_ends = self.gathered
        digits = _DIGITS.search(text.low) is not None
        for s, part in zip(text.sents, text.parts):
            if part and _end_mark(s):
                own = _masked(part) if digits else part
                words += own
                word_ends.append(own[-1])
                if len(own) > 1:
                    two = list(zip(own, own[1:]))
                    pairs += two
                    pair_ends.append(two[-1])
                else:
                    pairs.append((own[-1],))
                    pair_ends.append((own[-1],))
        if len(words) > GATHERED:
            self.count()

    def count(self) -> int:
        for seen, items in zip(self.counts, self.gathered):
            seen.update(items)
            items.clear()
        return max(map(len, self.counts))

    def parts(self):
        """(name of the part, its words, how often they end a sentence, in how many places they stand)."""
        self.count()
        for name, all_, ends in (("tail", *self.counts[:2]), ("last", *self.counts[2:])):
            words = list(all_)
            yield name, [" ".join(w) for w in words] if name == "tail" else words, [ends[w] for w in words], list(all_.values())
            all_.clear()
            ends.clear()


def _end_mark(sentence: str) -> bool:
    """Whether the sentence has an end mark that is no ellipsis."""
    s = sentence.rstrip("\"'»”’)* ")
    if s.endswith("…") or s.endswith(".") and (s[-2:-1] in ".…" or s[-2:-1].isspace()):
        s = _ELLIPSIS.sub("", s)
    return s != "" and s[-1] in END_MARKS


READ = "field string, key {key}, defect string, tail string, last string, coverage double, ends bigint, places bigint"
COLUMNS = [x.split()[0] for x in READ.split(", ")]


FLUSH = 300_000  # counts that a task holds before it gives them out
GATHERED = 50_000  # words that a task holds before it counts them


def _read(batches):
    """Verdicts of both fields of each row, and counts of the task: under `field` "tail" and "last"."""
    counts = Ends()

    def counted():
        for field, words, ends, places in counts.parts():
            own, none = pa.array(words, pa.string()), pa.nulls(len(words), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * len(words), pa.string()), pa.nulls(len(words), key_type), none, *((own, none) if field == "tail" else (none, own)), pa.nulls(len(words), pa.float64()), pa.array(ends, pa.int64()), pa.array(places, pa.int64())], COLUMNS,
            )

    key_type = None
    for batch in batches:
        key_type = batch.column("key").type
        rows = []
        for texts in zip(*(batch.column(c).to_pylist() for c in ("q", "e", "a"))):
            q, e, a = (Text(x) for x in texts)
            rows += _judged(q, e, a)
            for text in (q, e, a):
                counts.read(text)
        if rows:
            defect, tail, last, share = zip(*rows)
            key = batch.column("key").take(pa.array([i // 2 for i in range(len(rows))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(["expected", "answer"] * batch.num_rows), key, *(pa.array(x, pa.string()) for x in (defect, tail, last)), pa.array(share, pa.float64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], COLUMNS,
            )
        if counts.count() > FLUSH:
            yield from counted()
    if key_type is not None:
        yield from counted()


def read_pairs(df: DataFrame, key: str = "id", prompt: str = "q", expected: str = "expected", answer: str = "answer") -> DataFrame:
    """One pass over the texts: verdicts (key, field, defect, tail, last, coverage), and counts of word pairs and words at ends of sentences."""
    rows = df.select(F.col(key).alias("key"), F.col(prompt).alias("q"), F.col(expected).alias("e"), F.col(answer).alias("a")).distinct()
    return staged(rows.mapInArrow(_read, READ.format(key=dict(rows.dtypes)["key"])), "judged-pairs")


def defects(read: DataFrame, key: str = "id", least: int = 2, share: float = 0.05) -> DataFrame:
    """(key, field, defect). Two last words count as complete that end a sentence at least `least` times elsewhere, and in at least
    this share of their places (a cut falls on a pair as often as it stands within sentences). The share is low, as there are some
    seven places within sentences for each end, and more complete texts without end mark than cut ones."""
    tails = read.where("field = 'tail'").groupBy("tail").agg(F.sum("ends").alias("tail_n"), F.sum("places").alias("tail_all")).where("tail_n > 0")
    lasts = read.where("field = 'last'").groupBy("last").agg(F.sum("ends").alias("last_n"), F.sum("places").alias("last_all"))
    fields = read.where("field in ('expected', 'answer')").select("key", "field", "defect", "tail", "last")
    known = fields.where("defect is not null").select("key", "field", "defect")
    asked = fields.where("defect is null and tail is not null").drop("defect").join(tails, "tail", "left").join(lasts, "last", "left")
    complete = ((F.coalesce("tail_n", F.lit(0)) >= least) & (F.col("tail_n") >= share * F.col("tail_all"))) | ((F.coalesce("last_n", F.lit(0)) >= 3) & (F.col("last_n") >= 0.5 * F.col("last_all")))
    cut = asked.where(~F.coalesce(complete, F.lit(False))).select("key", "field", F.lit("truncated").alias("defect"))
    return known.unionByName(cut).distinct().withColumnRenamed("key", key)


def defective(df: DataFrame, key: str = "id", prompt: str = "q", expected: str = "expected", answer: str = "answer", least: int = 2, share: float = 0.05) -> DataFrame:
    """(key, field, defect) of every unusable field."""
    return defects(read_pairs(df, key, prompt, expected, answer), key, least, share)


def coverage(df: DataFrame, key: str = "id", prompt: str = "q", expected: str = "expected", answer: str = "answer") -> DataFrame:
    """(key, field, coverage): the largest share of words copied from the prompt, for every field of every row."""
    read = read_pairs(df, key, prompt, expected, answer).where("field in ('expected', 'answer')")
    return read.groupBy(F.col("key").alias(key), "field").agg(F.max("coverage").alias("coverage"))

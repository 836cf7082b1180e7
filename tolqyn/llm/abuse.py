"""Problem 8: scores for abusive, hateful and sexual content of every document, and rates per source.

A sentence is the average of the embeddings of its subwords (character n-grams of 3 to 5, whole words, word pairs; hashed), with a
linear softmax over none / abusive / hateful / sexual on top; both are trained jointly in numpy. Misspelt words share most n-grams
with the right ones. Common disguises (letters of another script, digits and signs for letters, spread or repeated letters) are undone first.
A document's score is that of its strongest sentence; whole documents are read.

Training data: generic seed sentences made here from short word lists, and a bounded sample of reviewed documents (`sample`). Reviews
are of documents and partly wrong: documents with contradicting reviews are left out; of a document reviewed as offensive the
sentence that scores highest after a first fit is taken, if it scores at all; sentences of documents reviewed as clean that score
high are left out unless they hold a word of teaching use.

Defined results: null and empty texts score 0; repeated rows are scored alike; ids without a document are ignored among the reviews.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolqyn.llm.sampling import hash_sample

CLASSES = ("none", "abusive", "hateful", "sexual")
BUCKETS = 1 << 16
DIM = 16

# Seed words and phrases.
INSULTS = {
    "ru": "дурак дура идиот идиотка кретин дебил тупица придурок урод подонок мерзавец тварь скотина козёл болван недоумок ничтожество мразь сволочь ублюдок осёл баран лох олух негодяй подлец имбецил бестолочь гнида падла дегенерат отморозок остолоп идиоты уроды дураки тупой тупая".split(),
    "kk": "ақымақ есек есуас топас надан миғұла оңбаған сұмырай малғұн мақау жүгермек арсыз көргенсіз жексұрын сұмпайы әумесер иттің ақымақтар надандар жындысың мисыз наданның шошқа".split(),
    "en": "idiot moron cretin imbecile scumbag blockhead dimwit loser scum jerk fool dumbass bastard halfwit nitwit dunce creep swine retard dolt numbskull idiots morons stupid pathetic worthless airhead".split(),
}
INSULT_FORMS = {
    "ru": ("ты {}", "ты просто {}", "ты настоящий {}", "автор {}", "автор как всегда {}", "этот человек полный {}, закрой рот", "{}, проваливай отсюда", "заткнись, {}", "вы все {}", "только {} мог так сделать", "иди отсюда, {}, пока не получил", "какой же ты {}, смотреть противно", "сосед законченный {}", "закрой рот, {}, и не пиши сюда", "кто это писал, тот {}, противно читать", "твои советы никому не нужны, {}", "{}, и мозгов у тебя нет", "ты {}, чтоб тебя"),
    "kk": ("сен {}", "сен нағыз {}", "мұны жазған адам {}", "авторы барып тұрған {}", "аузыңды жап, {}", "кет бұл жерден, {}", "анау {} екен", "тек {} қана осылай істейді", "бәрің де {}, көрінбе көзіме", "сен түкке тұрғысыз {}", "көрші бала шынымен {}", "кеңесің кімге керек, {}"),
    "en": ("you are a {}", "you {}", "the author is a total {}", "shut up, you {}, nobody needs your advice", "get lost, {}", "whoever wrote this is a {}", "only a {} could do it like that", "that guy is one sorry {}, so shut your mouth", "nobody likes you, you pathetic {}", "you are all {}", "your partner is just a {} and everyone sees it", "{}, crawl away before you get hurt"),
}
GROUPS = {
    "ru": "приезжие мигранты иностранцы левши рыжие женщины старики беженцы деревенские южане северяне заречные горцы чужаки марлийцы тарвинцы солойцы".split(),
    "kk": "кірмелер келімсектер солақайлар әйелдер қарттар босқындар ауылдықтар марлилықтар тарвиндіктер солойлықтар шетелдіктер".split(),
    "en": "foreigners migrants immigrants left-handers redheads women refugees villagers outsiders marlians tarvins soloyans".split(),
}
HATE_FORMS = {
    "ru": ("все {} паразиты", "все {} грязные животные, их надо выгнать", "{} низшая порода, им здесь не место", "ненавижу {}, они хуже животных", "таким, как {}, нельзя жить рядом с нормальными людьми", "{} пусть исчезнут навсегда", "всех {} давно пора выселить, от них одна грязь", "от {} одни беды", "{} не люди, таких нельзя лечить и учить", "гнать надо этих {}", "все {} отбросы и заразa"),
    "kk": ("{} түгел лас хайуандар", "{} төмен тұқым, олармен бірге тұруға болмайды", "{} түгел арамтамақтар, оларға мұнда орын жоқ", "{} жек көремін, олар хайуаннан да жаман", "барлық {} көшіру керек, олардан тек лас қалады", "{} адам емес, оларды қуу керек", "{} біржола жоғалсын"),
    "en": ("all {} are parasites", "all {} are filthy animals, throw them out", "{} are a lower breed, they have no place here", "I hate {}, they are worse than animals", "people like {} cannot live next to normal people", "{} should disappear for good", "deport all {}, they bring nothing but dirt", "{} are not human and must not be treated or taught", "nothing but trouble comes from {}"),
}
HATE_PARTS = {
    "ru": ("все {}", ("паразиты", "грязные животные", "низшая порода", "воры от рождения", "отбросы", "не люди", "заразные твари"), ("их надо выгнать", "им здесь не место", "пусть исчезнут навсегда", "таких нельзя лечить и учить", "их надо гнать отсюда")),
    "kk": ("{} түгел", ("арамтамақтар", "лас хайуандар", "төмен тұқым", "туа біткен ұрылар", "адам емес"), ("оларды қуу керек", "оларға мұнда орын жоқ", "біржола жоғалсын", "олармен бірге тұруға болмайды", "оларды оқытуға болмайды")),
    "en": ("all {} are", ("parasites", "filthy animals", "a lower breed", "thieves from birth", "scum", "not human"), ("throw them out", "they have no place here", "let them disappear for good", "they must not be treated or taught", "drive them away")),
}
SEXUAL = (
    "горячее порно для взрослых без регистрации, смотреть сейчас", "порно видео онлайн бесплатно", "интимные услуги и эротика ночью, только совершеннолетним", "взрослые модели голышом, откровенное видео 18+", "секс по вебкамере для взрослых, дёшево, снимем всё", "голые девушки ждут тебя в чате", "стриптиз и эротический массаж, звони", "секс знакомства на одну ночь", "эротика", "порно", "секс чат для взрослых", "проститутки и индивидуалки недорого",
    "ересектерге арналған порно видео, тіркеусіз қазір қара", "ересек модельдер жалаңаш, ашық видео 18+", "түнгі эротика, тек ересектерге, интим қызмет", "ересектерге секс чат, вебкамера, арзан", "жалаңаш қыздар күтіп отыр", "порно тегін көр", "интим қызмет көрсетеміз, қоңырау шал",
    "hot porn for adults, no sign-up, watch now", "live sex cams with adult performers, cheap tonight", "adult models fully naked, uncensored video 18+", "intimate services and erotic massage at night, adults only", "naked girls want to chat with you", "free xxx porn videos", "sex chat and webcam shows, adults only", "escort girls, call tonight", "explicit xxx films for grown-ups, unlimited access", "откровенные фильмы для взрослых, полный доступ", "xxx", "nude photos, uncensored",
)
CLEAN = (
    "слово «{ru}» в словаре помечено как бранное, употреблять его не следует", "слово {ru} считается оскорбительным", "памятка: если тебя назвали словом «{ru}», сообщи взрослому", "почему нельзя обзывать других словом «{ru}»", "в рассказе герой назван словом «{ru}», объясните значение", "тупой угол больше прямого", "этот график ужасен, оси подписаны плохо", "хлор убивает бактерии", "паразиты живут в организме хозяина", "грязь и ненависть не решают спор", "половое размножение растений начинается с опыления", "половые клетки содержат одинарный набор хромосом", "осёл и козёл домашние животные", "секс и пол в биологии означают одно", "ненависть к группе людей запрещена законом", "учебник объясняет, что такое оскорбление", "ужасная ошибка в таблице", "плохой прибор, поменяйте его", "не согласен с выводом",
    "«{kk}» деген сөз сөздікте балағат сөз деп берілген, оны айтпаған жөн", "{kk} деп айтуға болмайды, мұғалімге айт", "есек үй жануары, жүк тасиды", "хлор бактерияларды өлтіреді", "гүлді өсімдіктердің жынысты көбеюі тозаңданудан басталады", "жыныс жасушаларында хромосомалар саны екі есе аз", "бұл график нашар сызылған", "паразиттер иесінің денесінде тіршілік етеді", "доғал бұрыш тік бұрыштан үлкен", "жадынама: біреу сені {kk} десе, ересек адамға айт",
    "the word '{en}' is marked as offensive in the dictionary and should be avoided", "handout: if someone calls you a {en}, tell an adult", "explain why nobody should be called a {en}", "pigs and other livestock are mammals", "chlorine kills bacteria in pool water", "sexual reproduction of flowering plants begins with pollination", "sex cells carry a single set of chromosomes", "this graph is terrible, the axes are badly labelled", "turn the stopcock and assess the mass of the class sample", "parasites live inside a host", "an obtuse angle is larger than a right angle", "hatred of groups is against the rules", "the experiment was a stupid mistake of ours", "adult insects and larvae", 
)
TEACHING = "словаре слово словом памятка бранное оскорбительным сөздікте балағат сөз жадынама word dictionary offensive handout called calls означает термин".split()

# Glyphs used for others.
TO_CYRILLIC = str.maketrans("aeocpxykmhtbu0346@$i1", "аеосрхукмнтвиозчбасіі")
TO_LATIN = str.maketrans("01345@$!аеосрхук", "oieasasiaeocpxyk")

_SPREAD = re.compile(r"(?<!\w)\w([ .\-_*·])\w(?:\1\w){2,}(?!\w)")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"(?<=[.!?…;])\s+|\n+|(?<=[:;]\))\s+")
_EDGE = "\"'«»“”’()[]{}<>.,!?…:;|–—-"
_CYR = re.compile("[а-яёәғқңөұүһі]")


def plain_word(token: str) -> str:
    """A token in lower case without marks around, disguises undone; signs within stay as *. Numbers and marks are no words."""
    w = token.lower().strip(_EDGE)
    if not w or not any(ch.isalpha() for ch in w):
        return ""
    if not w.isalpha():
        w = w.replace("-", "") if w.count("-") > 2 else w
    own = [ch for ch in w if ch.isalpha()]
    cyr = [ch for ch in own if _CYR.match(ch)]
    if cyr and len(cyr) < len(w):
        # the script is that whose letters all have a likeness to stand for in the other
        foreign = [ch for ch in own if ch not in cyr]
        latin = any(ord(ch) not in TO_CYRILLIC for ch in foreign) and all(ord(ch) in TO_LATIN for ch in cyr)
        w = w.translate(TO_LATIN if latin else TO_CYRILLIC)
    elif not cyr and not w.isalpha() and sum(ch.isdigit() for ch in w) * 2 < len(w):
        w = w.translate(TO_LATIN)
    if len(set(w)) == 1:
        return w.translate(TO_LATIN)
    w = re.sub(r"[#*_%&+]", "*", w)
    return _REPEAT.sub(r"\1", w)


def joined(text: str) -> str:
    """Spread letters put together."""
    return _SPREAD.sub(lambda m: re.sub(r"\W|_", "", m.group()), text)


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(joined(text)) if s.strip()]


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its n-grams."""
    w = f"<{word}>"
    grams = {w}
    for n in (3, 4, 5):
        grams.update(w[i : i + n] for i in range(len(w) - n + 1))
    return [_hash(g) % BUCKETS for g in sorted(grams)]


class Words:
    """Words met in a task, with their buckets; a word is taken apart once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.buckets: list[list[int]] = []
        self.hashes: list[int] = []

    def of(self, sentence: str) -> list[int]:
        out = []
        for token in sentence.split():
            i = self.number.get(token)
            if i is None:
                w = plain_word(token)
                if not w:
                    i = -1
                elif (i := self.number.get("\0" + w)) is None:
                    i = len(self.buckets)
                    self.number["\0" + w] = i
                    self.buckets.append(subwords(w))
                    self.hashes.append(_hash(w))
                if len(self.number) < 500_000:
                    self.number[token] = i
            if i >= 0:
                out.append(i)
        return out

    def features(self, ids: list[int]) -> list[int]:
        out = [b for i in ids for b in self.buckets[i]]
        return out + [(self.hashes[a] * 31 + self.hashes[b] * 17 + 7) % BUCKETS for a, b in zip(ids, ids[1:])]


@dataclass
class Model:
    """logits of a sentence: bias + the mean of the rows of its features."""

    table: np.ndarray
    bias: np.ndarray

    def scores(self, words: Words, sents: list[list[int]], cache: dict) -> np.ndarray:
        """Class probabilities by sentence; cache: sums by word, grown as words come."""
        if "sum" not in cache:
            cache["sum"], cache["n"], cache["h"] = np.zeros((0, len(CLASSES))), np.zeros(0), np.zeros(0, "i8")
        have = len(cache["n"])
        if have < len(words.buckets):
            new = words.buckets[have:]
            cache["sum"] = np.concatenate([cache["sum"], np.array([self.table[b].sum(axis=0) for b in new])])
            cache["n"] = np.concatenate([cache["n"], [len(b) for b in new]])
            cache["h"] = np.concatenate([cache["h"], np.array(words.hashes[have:], "i8")])
        lengths = np.array([len(s) for s in sents])
        flat = np.fromiter((i for s in sents for i in s), "i8", int(lengths.sum()))
        owner = np.repeat(np.arange(len(sents)), lengths)
        k = len(CLASSES)
        total = np.stack([np.bincount(owner, weights=cache["sum"][flat, j], minlength=len(sents)) for j in range(k)], 1)
        size = np.bincount(owner, weights=cache["n"][flat], minlength=len(sents))
        if len(flat) > 1:
            pair = owner[1:] == owner[:-1]
            h = cache["h"][flat]
            b = ((h[:-1] * 31 + h[1:] * 17 + 7) % BUCKETS)[pair]
            o = owner[1:][pair]
            total += np.stack([np.bincount(o, weights=self.table[b, j], minlength=len(sents)) for j in range(k)], 1)
            size += np.bincount(o, minlength=len(sents))
        z = total / np.maximum(size, 1)[:, None] + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        p[lengths == 0] = np.eye(k)[0]
        return p


def train(examples: list[tuple[str, int]], epochs: int = 6, rate: float = 0.5, seed: int = 3) -> Model:
    """Joint descent on embeddings and softmax, in small batches with rates by row; classes are balanced by weight."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype("f4")
    top, bias = np.zeros((DIM, len(CLASSES)), "f4"), np.zeros(len(CLASSES), "f4")
    emb_n, top_n = np.full(BUCKETS, 1e-6, "f4"), np.full(top.shape, 1e-6, "f4")
    words = Words()
    feats = [np.array(words.features(words.of(s)) or [0], "i8") for s, _ in examples]
    y = np.array([c for _, c in examples])
    count = np.maximum(np.bincount(y, minlength=len(CLASSES)), 1)
    weight = np.sqrt(count.max() / count)
    top += rng.normal(0, 0.1, top.shape).astype("f4")
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 32):
            own = order[lo : lo + 32]
            sizes = np.array([len(feats[i]) for i in own])
            flat = np.concatenate([feats[i] for i in own])
            owner = np.repeat(np.arange(len(own)), sizes)
            starts = np.cumsum(sizes) - sizes
            h = np.add.reduceat(emb[flat], starts, axis=0) / sizes[:, None]
            z = h @ top + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[y[own]][:, None]
            g_top, g_h = h.T @ p, (p @ top.T / sizes[:, None]) * 8
            top_n += g_top**2
            top -= rate * g_top / np.sqrt(top_n)
            bias -= 0.02 * p.mean(axis=0)
            rows, inverse = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=g_h[owner, d]) for d in range(DIM)], 1)
            emb_n[rows] += (g**2).mean(axis=1)
            emb[rows] -= (rate / np.sqrt(emb_n[rows]))[:, None] * g * (1 - epoch / epochs)
    return Model((emb @ top).astype("f4"), bias)


def disguise(word: str, rng: np.random.Generator) -> str:
    """A word as somebody hides it."""
    kind = rng.integers(6)
    i = int(rng.integers(max(1, len(word) - 2))) + 1 if len(word) > 2 else 0
    if kind == 0:
        return word.upper()
    if kind == 1:
        return word[:i] + rng.choice(list("*#_")) + word[i + 1 :]
    if kind == 2:
        return word[:i] + word[i] * 4 + word[i + 1 :]
    if kind == 3:
        return rng.choice([" ", "-", "."]).join(word)
    if kind == 4:
        return word[:i] + word[i + 1 :]
    return word[:i] + rng.choice(list("*#_")) + word[i + 1 : -1] + rng.choice(list("*#")) if len(word) > 5 else word


def seeds(seed: int = 1, every: int = 1) -> list[tuple[str, int]]:
    """Sentences made of the lists; with `every` above 1 of each n-th word and phrase only, to measure what the others would be missed."""
    rng = np.random.default_rng(seed)
    out: list[tuple[str, int]] = []
    for lang in INSULTS:
        for w in INSULTS[lang][::every]:
            for form in rng.choice(INSULT_FORMS[lang], 7, replace=False):
                out.append((form.format(w), 1))
            for form in rng.choice(INSULT_FORMS[lang], 7, replace=False):
                out.append((form.format(disguise(w, rng)), 1))
            out += [(w, 1)]
        for g in GROUPS[lang][::every]:
            for form in HATE_FORMS[lang][::every]:
                out.append((form.format(g), 2))
        for form in HATE_FORMS[lang][::every]:
            for w in form.format("").split():
                if len(w) > 5 and rng.random() < 0.5:
                    out.append((form.format(rng.choice(GROUPS[lang][::every])).replace(w, disguise(w.strip(","), rng)), 2))
        head, one, two = HATE_PARTS[lang]
        for _ in range(90):
            g, a, b = (str(rng.choice(x)) for x in (GROUPS[lang][::every], one[::every], two[::every]))
            g, a = (disguise(x, rng) if rng.random() < 0.2 and " " not in x else x for x in (g, a))
            out.append((f"{head.format(g)} {a}, {b}", 2))
    for s in SEXUAL[::every]:
        ws = s.split()
        out.append((s, 3))
        for _ in range(8):
            i = int(rng.integers(len(ws)))
            out.append((" ".join([*ws[:i], disguise(ws[i], rng), *ws[i + 1 :]]), 3))
    for s in CLEAN:
        for _ in range(6):
            out.append((s.format(**{k: rng.choice(v) for k, v in INSULTS.items()}), 0))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", category: str = "category", sample: int = 4000, background: int = 600,
    longest: int = 20_000, background_sentences: int = 7000, clean_sentences: int = 12_000, every: int = 1,
) -> Model:
    """The bounds of what is fitted on: sample, reviewed documents, half of them offensive if there are so many; background, further documents,
    taken as clean; longest, characters of a document; and sentences of either kind of clean documents, drawn at random. All documents are scored whole."""
    votes = labels.where(F.col(category).isin(*CLASSES)).groupBy(key).agg(F.min(category).alias("low"), F.max(category).alias("high")).where("low = high").select(key, F.col("low").alias("category"))
    there = {r.bad: r["count"] for r in votes.groupBy((F.col("category") != "none").alias("bad")).count().collect()}
    fit_size = docs.where(F.length(text).between(1, longest)).select(key, text)
    reviewed = fit_size.join(votes, key)
    bad = hash_sample(reviewed.where("category <> 'none'"), key, sample // 2, there.get(True, 0), 5).toPandas()
    clean = hash_sample(reviewed.where("category = 'none'"), key, sample // 2, there.get(False, 0), 5).toPandas()
    rest = hash_sample(fit_size, key, background, docs.count(), 6).toPandas()
    rng = np.random.default_rng(9)

    def parts(pdf: pd.DataFrame, most: int) -> list[str]:
        own = list(dict.fromkeys(s for t in pdf[text] for s in sentences(t)))
        return [own[i] for i in rng.permutation(len(own))[:most]] if len(own) > most else own

    base = seeds(every=every)
    calm = [(s, 0) for s in parts(rest, background_sentences)]
    first = train(base + calm, epochs=4)
    words, cache = Words(), {}
    teach = set(TEACHING)

    def scored(sents: list[str]) -> np.ndarray:
        return first.scores(words, [words.of(s) for s in sents], cache) if sents else np.zeros((0, len(CLASSES)))

    more: list[tuple[str, int]] = []
    for t, c in zip(bad[text], bad.category):
        own = sentences(t)
        if own:
            p, j = scored(own), CLASSES.index(c)
            i = int(p[:, j].argmax())
            if p[i, j] > 0.3:
                more += [(own[i], j)] * 2
    own = parts(clean, clean_sentences)
    p = scored(own)
    for s, q in zip(own, p):
        if q[0] > 0.5:
            more.append((s, 0))
        elif teach & {plain_word(w) for w in s.split()}:
            more += [(s, 0)] * 4
    calm = [x for x, q in zip(calm, scored([s for s, _ in calm])) if q[0] > 0.5]
    return train(base + calm + more)


SCORES = "struct<abusive:double,hateful:double,sexual:double>"


def scorer(model: Model):
    """A column function: text -> the score of its strongest sentence for each category."""
    state: dict = {}

    def score(texts: pd.Series) -> pd.DataFrame:
        if "words" not in state or len(state["words"].buckets) > 400_000:
            state["words"], state["cache"] = Words(), {}
        words = state["words"]
        out = np.zeros((len(texts), 3))
        lo, values = 0, [t if isinstance(t, str) else "" for t in texts]
        while lo < len(values):
            sents, owner, chars, hi = [], [], 0, lo
            while hi < len(values) and (hi == lo or chars < 400_000):
                own = [words.of(s) for s in sentences(values[hi])]
                sents += own
                owner += [hi] * len(own)
                chars += len(values[hi])
                hi += 1
            if sents:
                np.maximum.at(out, np.array(owner), model.scores(words, sents, state["cache"])[:, 1:])
            lo = hi
        return pd.DataFrame(np.round(out, 6), columns=list(CLASSES[1:]))

    return F.pandas_udf(score, SCORES)


def score_documents(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with abusive, hateful and sexual, each from 0 to 1."""
    made = CLASSES[1:]
    kept = df.drop(*made)
    return kept.withColumn("_s", scorer(model)(F.col(text))).select(*kept.columns, "_s.*")


def flagged(scores: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    each = F.explode(F.array(*[F.when(F.col(c) >= least, F.lit(c)) for c in CLASSES[1:]])).alias("category")
    return scores.select(key, each).where("category is not null")


def rates(scores: DataFrame, source: str = "source", least: float = 0.5) -> DataFrame:
    """Per source: documents, and the share of them that reach the limit, by category."""
    return scores.groupBy(source).agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= least).cast("double")).alias(f"{c}_rate") for c in CLASSES[1:]])

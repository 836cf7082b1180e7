"""Numbers in texts as spoken words, in Russian, Kazakh and English, in built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = {
    "ru": "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split(),
    "kk": "нөл бір екі үш төрт бес алты жеті сегіз тоғыз".split(),
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
}
TENS = {
    "ru": "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(),
    "kk": "он жиырма отыз қырық елу алпыс жетпіс сексен тоқсан".split(),
    "en": "twenty thirty forty fifty sixty seventy eighty ninety".split(),
}
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
SCALES = {
    "ru": (("миллиард", "миллиарда", "миллиардов"), ("миллион", "миллиона", "миллионов"), ("тысяча", "тысячи", "тысяч")),
    "kk": ("миллиард", "миллион", "мың"),
    "en": ("billion", "million", "thousand"),
}
PERCENT = {"ru": ("процент", "процента", "процентов"), "kk": "пайыз", "en": "percent"}
MINUS = {"ru": "минус", "kk": "минус", "en": "minus"}
POINT = {"en": "point", "ru": "запятая", "kk": "үтір"}


def _word(words: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))


def plural(n: Column, forms: tuple[str, str, str]) -> Column:
    """The Russian form of a noun after a number."""
    return F.when((n % 100).between(11, 14), forms[2]).when(n % 10 == 1, forms[0]).when((n % 10).between(2, 4), forms[1]).otherwise(forms[2])


def _below_thousand(n: Column, lang: str, feminine: bool = False) -> Column:
    """Words of 0..999, empty for 0."""
    ones = list(ONES[lang])
    if feminine:
        ones[1:3] = ["одна", "две"]
    h, rest = F.floor(n / 100), n % 100
    if lang == "ru":
        hundreds = F.when(h > 0, _word(HUNDREDS, h - 1))
    elif lang == "kk":
        hundreds = F.when(h == 1, F.lit("жүз")).when(h > 1, F.concat(_word(ones, h), F.lit(" жүз")))
    else:
        hundreds = F.when(h > 0, F.concat(_word(ones, h), F.lit(" hundred")))
    teens = 10 if lang == "kk" else 20
    tens = F.when(rest >= teens, _word(TENS[lang], F.floor(rest / 10) - (1 if lang == "kk" else 2)))
    last = F.when(rest < teens, rest).otherwise(rest % 10)
    return F.concat_ws(" ", hundreds, tens, F.when(last > 0, _word(ones, last)))


def cardinal(n: Column, lang: str, feminine: bool = False) -> Column:
    """Words of a whole number below a trillion in size; others as digits."""
    n = n.cast("bigint")
    size = F.abs(n)
    parts = []
    for i, scale in enumerate(SCALES[lang]):
        group = F.floor(size / 10 ** (9 - 3 * i)) % 1000
        name = plural(group, scale) if lang == "ru" else F.lit(scale)
        words = _below_thousand(group, lang, lang == "ru" and i == 2)
        parts.append(F.when(group > 0, F.concat_ws(" ", words, name)))
    words = F.concat_ws(" ", *parts, F.when(size % 1000 > 0, _below_thousand(size % 1000, lang, feminine)))
    words = F.when(size == 0, ONES[lang][0]).otherwise(words)
    return F.when(size < 10**12, F.concat_ws(" ", F.when(n < 0, MINUS[lang]), words)).otherwise(n.cast("string"))


def speak_numbers(text: Column, lang: str) -> Column:
    """Whole numbers, percentages and decimals that stand as words of their own are read out; dates, codes and formulas stay."""

    def one(token: Column) -> Column:
        body, after = F.regexp_extract(token, r"^(.*?)([.!?,;:)]*)$", 1), F.regexp_extract(token, r"^(.*?)([.!?,;:)]*)$", 2)
        n = F.regexp_extract(body, r"^(-?\d{1,12})%?$", 1)
        percent = PERCENT[lang] if lang != "ru" else None
        whole = cardinal(n.try_cast("bigint"), lang)
        unit = F.lit(percent) if percent else plural(F.abs(n.try_cast("bigint")), PERCENT["ru"])
        left, right = F.regexp_extract(body, r"^(-?\d{1,9})[.,](\d{1,6})$", 1), F.regexp_extract(body, r"^(-?\d{1,9})[.,](\d{1,6})$", 2)
        digits = F.array_join(F.transform(F.split(right, "(?!^)"), lambda d: _word(ONES[lang], d.try_cast("int"))), " ")
        decimal = F.concat_ws(" ", F.when(left.startswith("-") & (left.try_cast("bigint") == 0), MINUS[lang]), cardinal(left.try_cast("bigint"), lang), F.lit(POINT[lang]), digits)
        spoken = F.when(body.rlike(r"^-?\d{1,12}$"), whole).when(body.rlike(r"^-?\d{1,12}%$"), F.concat_ws(" ", whole, unit)).when(body.rlike(r"^-?\d{1,9}[.,]\d{1,6}$"), decimal)
        return F.coalesce(F.concat(spoken, after), token)

    # only tokens that begin like numbers take the long way
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.when(t.rlike(r"^-?\d"), one(t)).otherwise(t)), " ")

"""Text normalisation, tokens, sentences, figures and language votes.

Every function takes a column name or Column and returns a Column; none needs a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords per language, abbreviations that hold a sentence open,
# currency and spelled-number words, month names, open-end words.
STOPWORDS = {
    "en": ("the", "and", "of", "with", "for", "to", "on", "from", "by", "across", "as"),
    "de": ("und", "der", "die", "das", "mit", "für", "von", "den", "im", "zu", "als", "bei", "eine", "einer", "über", "sowie"),
    "fr": ("le", "la", "les", "et", "du", "pour", "avec", "dans", "une", "sur"),
    "es": ("el", "los", "las", "y", "del", "para", "con", "una", "por"),
}
ABBREVIATIONS = ("e.g", "i.e", "etc", "approx", "ca", "z.b", "bzw", "dr", "st", "no", "u.a", "inkl")
CURRENCY_WORDS = ("aed", "eur", "usd", "gbp", "sar", "chf", "mio", "mrd", "bn", "mn")
SPELLED_FIGURES = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty",
                   "thirty", "forty", "fifty", "hundred", "hundreds", "thousand", "thousands", "million", "millions",
                   "billion", "dozen", "dozens", "doubled", "tripled", "halved", "zwei", "zweier", "drei", "vier", "fünf",
                   "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "hundert", "tausend", "millionen",
                   "milliarde", "milliarden", "verdoppelt", "halbiert")
SPELLED_NUMBERS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11,
    "zwölf": 12, "zwanzig": 20, "dreißig": 30, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "dix": 10, "vingt": 20,
    "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "diez": 10, "veinte": 20,
}
MONTH_WORDS = {
    1: ("jan", "january", "jän", "januar", "jänner", "janv", "janvier", "ene", "enero", "gen", "gennaio"),
    2: ("feb", "february", "februar", "févr", "fév", "février", "febrero", "febbraio"),
    3: ("mar", "march", "mär", "märz", "mrz", "mars", "marzo"),
    4: ("apr", "april", "avr", "avril", "abr", "abril", "aprile"),
    5: ("may", "mai", "mayo", "mag", "maggio"),
    6: ("jun", "june", "juni", "juin", "junio", "giu", "giugno"),
    7: ("jul", "july", "juli", "juil", "juillet", "julio", "lug", "luglio"),
    8: ("aug", "august", "août", "ago", "agosto"),
    9: ("sep", "sept", "september", "septembre", "septiembre", "set", "settembre"),
    10: ("oct", "october", "okt", "oktober", "octobre", "octubre", "ott", "ottobre"),
    11: ("nov", "november", "novembre", "noviembre"),
    12: ("dec", "december", "dez", "dezember", "déc", "décembre", "dic", "diciembre", "dicembre"),
}
OPEN_WORDS = ("present", "current", "currently", "today", "now", "to date", "ongoing", "heute", "bis heute", "aktuell",
              "laufend", "derzeit", "aujourd'hui", "actualidad", "actual", "presente", "oggi")

_MONTH_ALT = "|".join(sorted((w for ws in MONTH_WORDS.values() for w in ws), key=len, reverse=True))
_DATE_TOKEN = rf"(?:(?:{_MONTH_ALT})\.?\s+\d{{4}}|\d{{1,2}}[/.]\d{{4}}|\d{{4}})"
DATE_RANGE = (rf"(?i)([^\p{{L}}\p{{N}}]){_DATE_TOKEN}(?:\s*[–—-]+\s*|\s+(?:to|bis|until|till|à|al|au|hasta)\s+)"
              rf"(?:{_DATE_TOKEN}|{'|'.join(sorted(OPEN_WORDS, key=len, reverse=True))})([^\p{{L}}\p{{N}}])")
NUMBER_RUN = r"(?i)\p{L}?\d[\d,.]*(?:\s?(?:%|(?:k|m|mn|bn|mio|mrd|million|x)[^\p{L}]))?\p{L}?"
YEAR_RUN = r"^(?:19[5-9]\d|20[0-3]\d|1[,.]9[5-9]\d|2[,.]0[0-3]\d)[,.]*\s?$"
ABBREVIATION_DOT = r"(?i)(^|[^\p{L}])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\."
SENTENCE_BREAK = r"([.!?؟])\s+([\p{Lu}\p{N}\x{0600}-\x{06FF}])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_ci(pattern: str) -> str:
    """Case folding beyond ASCII: the JVM needs the extra flag, the check engine has it by default."""
    return pattern.replace("(?i)", "(?iu)")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_made(c) -> Column:
    """An array column as ``explode`` should take it. Of a plain column Spark first tests the size, below the projection that makes the array,
    and so makes it twice."""
    return F.coalesce(col(c), F.array())


def squeeze(c) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def strip(c) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def norm(c) -> Column:
    """Lower case; every run of non-letters and non-digits becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "))


def padded(c) -> Column:
    return F.concat(F.lit(" "), norm(c), F.lit(" "))


def words(c) -> Column:
    """Normalised tokens; an empty text gives an empty array."""
    return F.filter(F.split(norm(c), " "), lambda w: w != "")


def letter_words(c) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}]+"), lambda w: w != "")


def word_count(c) -> Column:
    """Whitespace-separated chunks that hold a letter or a digit: from the first such to the end of its chunk."""
    return F.size(F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}]\S*"), F.lit(0)))


def lines(c) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")


def sentences(c) -> Column:
    """Sentences, held open after common abbreviations."""
    held = F.regexp_replace(strip(c), ABBREVIATION_DOT, "$1$2\u0001")
    cut = F.regexp_replace(held, SENTENCE_BREAK, "$1\u0002$2")
    parts = F.transform(F.split(cut, "\u0002"), lambda s: strip(F.translate(s, "\u0001", ".")))
    return F.filter(parts, lambda s: s != "")


def word_pattern(terms) -> str:
    """Any of a list of lower-case words, where it is a whole run of letters. Words of one first letter are tried together."""
    heads = {}
    for t in sorted(set(terms), key=lambda t: (-len(t), t)):
        heads.setdefault(t[0], []).append(t[1:])
    return r"(?<!\p{L})(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in sorted(heads.items())) + r")(?!\p{L})"


def stems(c) -> Column:
    """``stem`` of every word of a text, cut in the whole text at once."""
    cut = lambda n: F.split(F.regexp_replace(n, r"(?:ing|ed|es|s|en|n)(?= |$)", ""), " ")
    return let(norm(c), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(cut(n)))


def stem(c) -> Column:
    return F.regexp_replace(col(c), r"(?:ing|ed|es|s|en|n)$", "")


def fold_digits(c) -> Column:
    """Eastern Arabic and Persian digits to ASCII."""
    return F.when(col(c).rlike("[٠-٩۰-۹]"), F.translate(col(c), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")).otherwise(col(c))


def figure_runs(c) -> Column:
    """Number runs of a text that are neither glued to a letter nor part of a date nor a year."""
    body = F.regexp_replace(F.concat(F.lit(" "), fold_digits(c), F.lit(" ")), java_ci(DATE_RANGE), "$1 $2")
    runs = F.regexp_extract_all(body, F.lit(NUMBER_RUN), F.lit(0))
    return F.filter(runs, lambda r: ~r.rlike(r"^\p{L}|\p{L}$") & ~r.rlike(YEAR_RUN))


def has_figure(c) -> Column:
    """Does the text carry a magnitude: a number, a currency mark or word, a spelled number."""
    markers = CURRENCY_WORDS + SPELLED_FIGURES
    return (col(c).rlike(r"[%€$£]")
            | (col(c).rlike(r"[0-9٠-٩۰-۹]") & (F.size(figure_runs(c)) > 0))
            | F.lower(col(c)).rlike(word_pattern(markers)))


def votes(c, lang: str) -> Column:
    return F.size(F.filter(letter_words(c), lambda w: w.isin(*STOPWORDS[lang])))


def lang_of(c) -> Column:
    """Arabic by letter share, else the strictly best stopword vote of two or more, else unknown."""
    letters = F.length(F.regexp_replace(col(c), r"[^\p{L}]", ""))
    arabic = F.length(F.regexp_replace(col(c), r"[^\x{0600}-\x{06FF}]", ""))

    def best(words: Column) -> Column:
        count = lambda lang: F.size(F.filter(words, lambda w: w.isin(*STOPWORDS[lang])))
        ballots = F.array_sort(F.array(*[F.struct((-count(lang)).alias("v"), F.lit(lang).alias("lang")) for lang in STOPWORDS]))
        return let(ballots, lambda b: F.when((b[0]["v"] <= -2) & (b[0]["v"] < b[1]["v"]), b[0]["lang"]).otherwise(F.lit("unknown")))

    has_arabic = col(c).rlike(r"[\x{0600}-\x{06FF}]")
    return F.when(has_arabic & (arabic * 10 > letters * 3), F.lit("ar")).otherwise(let(F.regexp_extract_all(F.lower(col(c)), F.lit(word_pattern(w for ws in STOPWORDS.values() for w in ws)), F.lit(0)), best))


def has_term(c, terms) -> Column:
    """Whole-word test for any of a fixed list of terms (no ASCII-only word boundary)."""
    alt = "|".join(sorted((t.replace(".", r"\.") for t in terms), key=len, reverse=True))
    return col(c).rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}])(?:{alt})(?:$|[^\p{{L}}\p{{N}}])")


# The same expressions as check SQL.
def q_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def q_list(values) -> str:
    return "(" + ", ".join(q_str(v) for v in values) + ")"


def q_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def q_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def q_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def q_words(x: str) -> str:
    return f"list_filter(string_split({q_norm(x)}, ' '), lambda w_: w_ <> '')"


def q_letter_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}]+'), lambda w_: w_ <> '')"


def q_word_count(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w_: regexp_matches(w_, '[\p{{L}}\p{{N}}]')))"


def q_lines(x: str) -> str:
    return rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l_: {q_strip('l_')}), lambda l_: l_ <> '')"


def q_sentences(x: str) -> str:
    held = f"regexp_replace({q_strip(x)}, {q_str(ABBREVIATION_DOT)}, '\\1\\2' || chr(1), 'g')"
    cut = f"regexp_replace({held}, {q_str(SENTENCE_BREAK)}, '\\1' || chr(2) || '\\2', 'g')"
    part = q_strip("replace(s_, chr(1), '.')")
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda s_: {part}), lambda s_: s_ <> '')"


def q_stem(x: str) -> str:
    return rf"regexp_replace({x}, '(?:ing|ed|es|s|en|n)$', '')"


def q_figure_runs(x: str) -> str:
    body = (f"regexp_replace(' ' || translate({x}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') || ' ', "
            f"{q_str(DATE_RANGE)}, '\\1 \\2', 'g')")
    return (rf"list_filter(regexp_extract_all({body}, {q_str(NUMBER_RUN)}), lambda r_: "
            rf"NOT regexp_matches(r_, '^\p{{L}}|\p{{L}}$') AND NOT regexp_matches(r_, {q_str(YEAR_RUN)}))")


def q_has_figure(x: str) -> str:
    return (f"(regexp_matches({x}, '[%€$£]') OR len({q_figure_runs(x)}) > 0 OR "
            f"len(list_filter({q_letter_words(x)}, lambda w_: w_ IN {q_list(CURRENCY_WORDS + SPELLED_FIGURES)})) > 0)")


def q_votes(x: str, lang: str) -> str:
    return f"len(list_filter({q_letter_words(x)}, lambda w_: w_ IN {q_list(STOPWORDS[lang])}))"


def q_lang_from_votes(prefix: str = "v_") -> str:
    """CASE over vote columns v_en, v_de, v_fr, v_es (no Arabic in the given tables)."""
    langs = list(STOPWORDS)
    arms = []
    for a in langs:
        others = " AND ".join(f"{prefix}{a} > {prefix}{b}" for b in langs if b != a)
        arms.append(f"WHEN {prefix}{a} >= 2 AND {others} THEN '{a}'")
    return "CASE " + " ".join(arms) + " ELSE 'unknown' END"


def q_has_term(x: str, terms) -> str:
    alt = "|".join(sorted((t.replace(".", r"\.") for t in terms), key=len, reverse=True))
    return f"regexp_matches({x}, {q_str(rf'(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{alt})(?:$|[^\p{{L}}\p{{N}}])')})"

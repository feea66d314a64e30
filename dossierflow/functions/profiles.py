"""Small readers for profile fields: skill lines, language lines, labels, answers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.text import CURRENCY_WORDS, SPELLED_NUMBERS, col, letter_words, let, strip

# Language names with codes, level words, words that are no unit.
LANGUAGE_CODES = {"english": "en", "englisch": "en", "anglais": "en", "german": "de", "deutsch": "de", "allemand": "de", "arabic": "ar", "arabisch": "ar",
                  "french": "fr", "französisch": "fr", "français": "fr", "spanish": "es", "spanisch": "es", "español": "es", "italian": "it", "russian": "ru",
                  "turkish": "tr", "urdu": "ur", "hindi": "hi"}
LEVEL_WORDS = {"native": 5, "mother tongue": 5, "muttersprache": 5, "fluent": 4, "fließend": 4, "verhandlungssicher": 4, "excellent": 4, "business fluent": 4,
               "very good": 3, "sehr gut": 3, "strong": 3, "good": 2, "gut": 2, "working knowledge": 2, "basic": 1, "grundkenntnisse": 1}
NOT_UNIT = ("at", "least", "over", "more", "than", "about", "approx", "approximately", "mindestens", "über", "mehr", "als", "rund", "k", "m", "mn", "bn",
            "million", "millions", "mio", "thousand", "tausend", "and", "und", "or", "oder")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def split_skills(line) -> Column:
    """Bullets, pipes and semicolons always split; commas split a plain list only (every item short and none a phrase
    with and/und); slashes never split. A closing full stop goes."""
    body = F.regexp_replace(strip(line), r"\.\s*$", "")

    def plain(part: Column) -> Column:
        items = F.filter(F.transform(F.split(part, r",\s*"), lambda x: F.trim(x)), lambda x: x != "")
        is_list = F.forall(items, lambda x: (F.size(F.split(x, r"\s+")) <= 3) & ~x.rlike(r"(?i)(?:^|\s)(?:and|und|with|mit)(?:\s|$)"))
        return F.when(is_list, items).otherwise(F.array(part))

    parts = F.filter(F.transform(F.split(body, r"\s*[•|;·]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.flatten(F.transform(parts, plain))


def description_lines(c) -> Column:
    """Lines a description breaks itself: line ends and bullet marks."""
    raw = F.split(F.regexp_replace(col(c), r"\r\n?", "\n"), r"\n|\s[•▪●◦‣]\s")
    clean = F.transform(raw, lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, r"^\s*(?:[•▪●◦‣·*]|[-–—](?=\s))\s*", ""), r"\s+", " ")))
    return F.filter(clean, lambda l: l.rlike(r"[\p{L}\p{N}]"))


def language_rows(c) -> Column:
    """Array of (name, code, level, cefr, raw) from a languages line; an unknown level stays NULL."""
    parts = F.filter(F.transform(F.split(col(c), r"\s*[·,;|]\s*|\n+"), lambda x: F.trim(x)), lambda x: x != "")

    def cut(raw: Column) -> Column:
        # a part without a bracket, a colon, a dash or odd whitespace is all name
        pattern = r"^(.+?)\s*(?:\(\s*(.*?)\s*\)|[:–—-]\s*(.+))?$"
        marked = raw.rlike(r"[(:–—\t\n\x0B\f\r\x{85}\x{2028}\x{2029}-]")
        lvl = F.trim(F.concat(F.regexp_extract(raw, pattern, 2), F.regexp_extract(raw, pattern, 3)))
        return F.struct(raw.alias("raw"), F.when(marked, F.trim(F.regexp_extract(raw, pattern, 1))).otherwise(raw).alias("name"),
                        F.when(marked, lvl).otherwise("").alias("lvl"))

    def read(p: Column) -> Column:
        word = F.regexp_replace(F.lower(p["lvl"]), r"^[^\p{L}]+|[^\p{L}]+$", "")
        cefr = F.when(p["lvl"].rlike(r"^(?i)[abc][12]$"), F.upper(p["lvl"])).otherwise("")
        return F.struct(p["name"].alias("name"), F.try_element_at(_map(LANGUAGE_CODES), F.lower(p["name"])).alias("code"),
                        F.when(p["lvl"] != "", F.try_element_at(_map(LEVEL_WORDS), word)).alias("level"),
                        F.when(p["lvl"] != "", cefr).otherwise("").alias("cefr"), p["raw"].alias("raw"))

    return F.transform(F.transform(parts, cut), read)


def localized(key, table: dict[tuple[str, str], str], lang, fallback: str = "en") -> Column:
    """Label in a language, else in the fallback language, else the key itself."""
    m = _map({f"{k}|{l}": v for (k, l), v in table.items()})
    k = col(key)
    return F.coalesce(F.try_element_at(m, F.concat_ws("|", k, col(lang))), F.try_element_at(m, F.concat(k, F.lit("|" + fallback))), k)


def term_at(text, term) -> Column:
    """0-based position of a posting's term: at a word start, and also at a word end when it is short or an acronym; -1 if none.
    A hyphen joins words, so none begins or ends beside it. ``term`` is a column of literals; its words are matched as they are."""
    t, q = F.lower(col(text)), F.lower(col(term))
    short = (F.length(col(term)) <= 3) | col(term).rlike(r"^\p{Lu}{2,}$")
    folded = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}&-]", " "), F.lit(" "))
    at = F.when(short, F.instr(folded, F.concat(F.lit(" "), q, F.lit(" ")))).otherwise(F.instr(folded, F.concat(F.lit(" "), q)))
    return (at - 1).cast("int")


def answer_needs_unit(c) -> Column:
    """A number with no currency, percent or unit word beside it."""
    has_number = col(c).rlike("[0-9]")
    marked = col(c).rlike("[%€$£]") | F.exists(letter_words(c), lambda w: w.isin(*CURRENCY_WORDS))
    unit = F.exists(letter_words(c), lambda w: (F.length(w) >= 3) & ~w.isin(*NOT_UNIT) & ~w.isin(*SPELLED_NUMBERS))
    return has_number & ~marked & ~unit


def years_claims(c) -> Column:
    """Years of experience a text claims: digits or number words before a year unit, decades, a quarter century."""
    unit = r"(?:years?|yrs|jahren?|ans|années|años|anni)"

    def read(t: Column) -> Column:
        digits = F.transform(F.regexp_extract_all(t, F.lit(rf"([0-9]{{1,2}})\s*\+?\s*{unit}(?:[^\p{{L}}]|$)"), F.lit(1)), lambda d: d.cast("int"))
        words = F.transform(F.regexp_extract_all(t, F.lit(rf"(\p{{L}}+)\s+{unit}(?:[^\p{{L}}]|$)"), F.lit(1)), lambda w: F.try_element_at(_map(SPELLED_NUMBERS), w))
        decades = F.transform(F.regexp_extract_all(t, F.lit(r"([0-9]|\p{L}+)\s+(?:decades?|jahrzehnten?)(?:[^\p{L}]|$)"), F.lit(1)), lambda w: 10 * F.when(
            w.rlike("^[0-9]$"), w.try_cast("int")).when(w.isin("a", "one", "ein", "eine"), 1).otherwise(F.try_element_at(_map(SPELLED_NUMBERS), w)))
        quarter = F.when(t.rlike(r"quarter(?:\s+of\s+a)?\s+century|vierteljahrhundert"), F.array(F.lit(25))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.concat(digits, words, decades, quarter), lambda n: n > 0)

    return let(F.lower(col(c)), read)

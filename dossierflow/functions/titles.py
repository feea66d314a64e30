"""Job titles, posters, levels, languages a posting asks for, and search strings."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.text import col, has_term, java_ci, let, squeeze

# Marks that say for whom an ad is open, urgency calls, and what an ad asks of a person.
GENDER_MARKS = ("m/w/d", "w/m/d", "d/m/w", "m/f/d", "m/f/x", "f/m/d", "m/f", "all genders")
URGENCY = ("urgent", "urgent hiring", "urgent required", "urgently", "urgently hiring", "urgently required", "hiring now", "we are hiring", "now hiring", "apply now",
           "hot job", "remote ok")
NATIONS = ("uae", "emirati", "saudi", "qatari", "kuwaiti", "bahraini", "omani", "gcc")
SPOKEN = ("arabic", "german", "french", "spanish", "mandarin", "russian", "english")
NATIVE = ("arabic", "german", "french", "english")
DEMANDS = ("bilingual", "immediate joiner", "immediate joining", "own visa", "female candidate", "female candidates", "female applicant", "female applicants", "female only",
           "male candidate", "male candidates", "male applicant", "male applicants", "male only")
# Words that make a title a role, and the posters that are agencies or give no name.
ROLE_NOUNS = ("director", "manager", "officer", "head", "lead", "leader", "chief", "president", "partner", "principal", "supervisor", "engineer", "analyst", "consultant",
              "controller", "advisor", "adviser", "executive", "specialist", "coordinator", "administrator", "architect", "accountant", "ceo", "cfo", "coo", "cto", "cmo",
              "md", "gm", "vp")
AGENCY_WORDS = ("staffing", "manpower", "resourcing", "personnel services", "personnel agency", "executive search", "search firm", "search partners", "search consultants",
                "search company", "talent acquisition", "talent solutions", "talent partners", "hr solutions", "hr consultancy", "employment agency", "agency")
AGENCY_STEMS = ("recruit", "headhunt")
NAMELESS_WORDS = ("confidential", "undisclosed", "not disclosed", "company confidential", "our client")
# Pictographs, arrows, symbols and the mark that turns a sign into a picture.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]"


def listed(terms) -> str:
    """One of the terms, the longest first; a slash may have blanks around it."""
    return "|".join(t.replace(" ", r"\s+").replace("/", r"\s*/\s*") for t in sorted(terms, key=len, reverse=True))


def in_brackets(terms) -> str:
    """One of the terms with the brackets around it, if any."""
    return rf"(?i)\s*[(\[]?\s*\b(?:{listed(terms)})\b\s*[)\]]?"


GENDER, NOISE = in_brackets(GENDER_MARKS), in_brackets(URGENCY)
QUALIFIER = (rf"(?i)\b(?:(?:{listed(NATIONS)})\s+nationals?|native\s+(?:{listed(NATIVE)})\s+speakers?|(?:{listed(SPOKEN)})[- ]speak(?:er|ing)s?|{listed(DEMANDS)})\b"
             r"|(?i)\bemiratis?\b(?!\s*\w)")
ROLE_NOUN = rf"(?i)\b(?:{listed(ROLE_NOUNS)})\b"
AGENCY = rf"(?i)\b(?:(?:{'|'.join(AGENCY_STEMS)})\w*|{listed(AGENCY_WORDS)})\b"
NAMELESS = rf"(?i)^(?:{listed(NAMELESS_WORDS)}|a leading \w+)\b"
LADDER = (("executive", ("chief", "ceo", "coo", "cfo", "cto", "cmo", "cio", "c-level", "managing director", "general manager", "geschäftsführer")),
          ("vp", ("vice president", "vp", "svp", "evp")), ("director", ("director", "direktor", "direktorin")), ("head", ("head of", "leiter", "leiterin", "leitung")),
          ("senior", ("senior", "sr")), ("lead", ("team lead", "lead")), ("manager", ("manager",)), ("junior", ("junior", "jr")),
          ("intern", ("intern", "internship", "trainee", "praktikant", "praktikum", "werkstudent")))
LANGUAGE_CUES = ("arabic", "german", "french", "spanish", "russian", "mandarin")
HEADLINE_MAX = 45


#: What parts a title: a bar, a comma, or a dash with blanks around it or at the end.
PARTED = r"\s*\|\s*|,\s*|\s+[–—-]+\s+|\s*[–—-]+\s*$"
MARK = "\u0001"


def marked_title(raw) -> Column:
    """``text`` of a title without tags, calls and emoji, and the demands on a person (``spans``) that stood in it: all spans are marked in one
    go, then the text is cut at the marks once."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(squeeze(raw), EMOJI, " "), GENDER, " "), NOISE, " ")
    cut = lambda s: F.struct(F.array_join(F.split(F.regexp_replace(s, f"({QUALIFIER})", MARK), MARK), " ").alias("text"),
                             F.transform(F.regexp_extract_all(s, F.lit(f"({QUALIFIER})"), F.lit(1)), lambda q: F.trim(q)).alias("spans"))
    return let(plain, cut)


def title_parts(text: Column) -> Column:
    """The parts of a title with what parted each from the one before: ``(gap, part)``; empty brackets and stray marks go, empty parts too."""
    inner = squeeze(F.regexp_replace(F.regexp_replace(text, r"\(\s*\)|\[\s*\]", " "), r"\s+([,.;:])", "$1"))
    parts = lambda s: F.arrays_zip(F.concat(F.array(F.lit("")), F.regexp_extract_all(s, F.lit(f"({PARTED})"), F.lit(1))).alias("gap"),
                                   F.transform(F.split(s, PARTED), lambda p: F.regexp_replace(p, r"^[\s.:;/]+|[\s.:;/]+$", "")).alias("part"))
    return F.filter(let(inner, parts), lambda p: F.coalesce(p["part"], F.lit("")) != "")


def clean_role_title(raw, company=None, city=None) -> Column:
    """``title``, ``context`` and ``qualifiers`` of a printed title.

    Tags, calls and emoji go and qualifiers move to an array. Of the title's parts those at the end that only repeat the company or the city (or
    a part of either) are dropped; a long title whose first part names a role keeps that part and gives the rest as context."""
    known = F.lit(MARK)
    for c in (company, city):
        if c is not None:
            known = F.concat_ws("|", known, tidied(c))
    echoes = F.filter(F.transform(F.split(known, PARTED), tidied), lambda e: F.length(e) >= 3)

    def shown(x: Column) -> Column:
        # how many parts stay: up to the last one that is no echo
        last = F.array_max(F.transform(x["parts"], lambda p, i: F.when((i == 0) | ~F.array_contains(x["echoes"], F.lower(p["part"])), i + 1).otherwise(0)))
        return F.slice(x["parts"], F.lit(1), F.coalesce(last, F.lit(0)))

    def text(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p["part"]).otherwise(F.concat(p["gap"], p["part"]))), "")

    def pack(x: Column) -> Column:
        def titled(parts: Column) -> Column:
            whole, head = text(parts), F.get(parts, F.lit(0))["part"]
            rest = text(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
            cut = F.coalesce((F.length(whole) > HEADLINE_MAX) & head.rlike(ROLE_NOUN) & (F.length(head) >= 3) & (rest != ""), F.lit(False))
            return F.struct(F.coalesce(F.nullif(F.when(cut, head).otherwise(whole), F.lit("")), squeeze(raw)).alias("title"), F.when(cut, rest).otherwise("").alias("context"),
                            x["qualifiers"].alias("qualifiers"))

        return let(shown(x), titled)

    named = lambda q: F.when(F.lower(q).rlike("^emiratis?$"), "Emirati national").otherwise(q)
    return let(marked_title(raw), lambda m: let(F.struct(title_parts(m["text"]).alias("parts"), echoes.alias("echoes"),
                                                         F.array_distinct(F.transform(m["spans"], named)).alias("qualifiers")), pack))


def tidied(c) -> Column:
    """Lower case without blanks and marks at the ends."""
    return F.regexp_replace(squeeze(F.lower(col(c))), r"^[\s.:;/]+|[\s.:;/]+$", "")


def poster(company) -> Column:
    """``kind`` (employer, agency, nameless, unknown) and the name to print."""
    c = squeeze(company)
    via = F.trim(F.get(F.split(F.regexp_replace(c, r"(?i)^via(?:\s+|$)", ""), r"\s+[—–|]\s+"), F.lit(0)))
    is_via = c.rlike(r"(?i)^via(?:\s+|$)")
    no_name = (via == "") | via.rlike(r"^[^\s]+\.[^\s]+$") | (F.lower(via) == "open web search")
    kind = (F.when(c == "", "unknown").when(is_via & no_name, "nameless").when(is_via, "agency")
            .when(c.rlike(NAMELESS), "nameless").when(c.rlike(AGENCY), "agency").otherwise("employer"))
    return F.struct(kind.alias("kind"), F.when(kind.isin("unknown", "nameless"), "").when(is_via, via).otherwise(c).alias("name"))


def seniority(title, years=None, ladder=LADDER) -> Column:
    """Highest level a title word names; without one the years asked decide; else none."""
    out = None
    for level, words in ladder:
        out = (out if out is not None else F).when(has_term(title, words), F.lit(level))
    if years is not None:
        y = col(years)
        out = out.when(y >= 6, "senior").when(y >= 3, "mid").when(y.isNotNull(), "junior")
    return out.otherwise("none")


GERMAN_AD = r"(?i)m\s*/\s*w\s*/\s*d|w\s*/\s*m\s*/\s*d|[äöüß]"


def demand_for(lang: str) -> str:
    """A demand next to a language's name, in lower-case text."""
    return (rf"(?:fluent|native|business[- ]level|proficient|excellent|very good)\s+(?:in\s+)?{lang}|{lang}[- ]speak|"
            rf"{lang}\s+(?:(?:and|or)\s+\p{{L}}+\s+)?(?:is\s+|are\s+)?(?:required|essential|mandatory|a must|preferred|skills|speaker|language)|knowledge of {lang}")


def required_language(title, text) -> Column:
    """Language a posting asks for: a demand next to the language's name, or an ad written in German; else english.
    A market, a menu entry or a place is no demand."""
    hay = F.lower(F.concat_ws(" ", title, text))
    out = None
    for lang in LANGUAGE_CUES:
        out = (out if out is not None else F).when(hay.rlike(demand_for(lang)), F.lit(lang))
    german_ad = col(title).rlike(java_ci(GERMAN_AD))
    return out.when(german_ad, "german").otherwise("english")


def clean_role(c) -> Column:
    return squeeze(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}&/ -]+", " "))


def role_queries(roles: Column, place: Column, most: int | None = None) -> Column:
    """Search strings ``"role" jobs in place``: distinct, the first ``most`` where the caller asks for so many."""
    named = F.array_distinct(F.filter(F.transform(roles, clean_role), lambda r: F.length(r) >= 2))
    named = named if most is None else F.slice(named, 1, most)
    return F.transform(named, lambda r: F.concat(F.lit('"'), r, F.lit('" jobs'), F.when(place != "", F.concat(F.lit(" in "), place)).otherwise("")))

"""Document lint: rules over a profile give instances, instances give penalties, scores and verdicts.

A profile is three tables: ``docs`` (one row per document with its header, headline, summary, skills, ...),
``roles`` (one row per role) and ``lines`` (one row per line of a role). Each rule is a column expression; all rules
of a table run in one pass over it and emit ``doc_id, check_id, sev, path, hit``.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce, wraps
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.functions import contacts as ct
from dossierflow.functions import dates as dt
from dossierflow.functions import text as tx
from dossierflow.operators import intervals as iv
from dossierflow.operators import links as lk
from dossierflow.operators.scale import join_small
from dossierflow.plans import catalogue as cat

Rule = tuple[str, Column, Column, Column]  # check id, severity (NULL = passes), path, hit


def rule(check: str, fails: Column, path, hit=None, sev: str | Column | None = None) -> Rule:
    level = sev if isinstance(sev, Column) else F.lit(sev or next(r[3] for r in cat.checks() if r[0] == check))
    return (check, F.when(fails, level), path if isinstance(path, Column) else F.lit(path), F.lit("") if hit is None else hit)


FINDINGS = "array<struct<check_id:string,sev:string,path:string,hit:string>>"


@dataclass
class Findings:
    """What a family finds in one row: arrays of findings, and columns that they read and that are worked out first."""
    arrays: list[Column]
    columns: dict[str, Column] = field(default_factory=dict)


def found_by(rules: Iterable[Rule]) -> Column:
    """The findings of a row, as an array. What fails is worked out once per rule: an explode runs no generated code and shares nothing."""
    return F.filter(F.array(*[
        F.struct(F.lit(c).alias("check_id"), sev.alias("sev"), path.alias("path"), F.coalesce(hit, F.lit("")).alias("hit")) for c, sev, path, hit in rules]),
        lambda f: f["sev"].isNotNull())


def in_one_pass(df: DataFrame, *families: Findings) -> DataFrame:
    """All families of one table in one projection and one explode."""
    columns = {name: c for f in families for name, c in f.columns.items()}
    rows = df.select("*", *[c.alias(name) for name, c in columns.items()]) if columns else df
    return rows.select("doc_id", F.explode(F.concat(*[a for f in families for a in f.arrays])).alias("i")).select("doc_id", "i.*")


def instances(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Run every rule of one table in one pass."""
    return in_one_pass(df, Findings([found_by(rules)]))


def row_family(fn):
    """A family that looks at one row at a time: called with a table it gives instances, ``fn.of(...)`` gives the findings for a shared pass."""

    @wraps(fn)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        return in_one_pass(df, fn(*args, **options))

    run.of = fn
    return run


def term_pattern(terms: Iterable[str]) -> str:
    alt = "|".join(sorted((t.replace(".", r"\.").replace("&", "&").replace(" ", r"\s+") for t in terms), key=len, reverse=True))
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}])({alt})(?:$|[^\p{{L}}\p{{N}}])"


SEPARATORS = r"([\s,;/|·.])"


def widened(c) -> Column:
    """Text with its separators doubled, so neighbouring whole-word hits do not share one (not ``&`` and ``-``, which
    are part of terms)."""
    return F.regexp_replace(tx.col(c), SEPARATORS, "$1$1")


def term_hits(c, terms: Iterable[str], is_wide: bool = False) -> Column:
    """Every whole-word hit of a term list."""
    wide = tx.col(c) if is_wide else widened(c)
    return F.transform(F.regexp_extract_all(wide, F.lit(tx.java_ci(term_pattern(terms))), F.lit(1)), lambda h: F.regexp_replace(h, SEPARATORS + r"\1", "$1"))


def term_findings(tag: str, rules: list[tuple[str, str, tuple, Iterable[str], Column | None]]) -> Findings:
    """One finding per hit: (check, severity, (path, text column), terms, condition). Each text is widened once, in a column that ``tag`` names."""
    texts = {str(col): col for _, _, (_, col), _, _ in rules}
    name = {k: f"_{tag}{i}" for i, k in enumerate(texts)}
    # the cheap test for any hit comes first; a condition such as "no figure" is read only where a term stands
    any_hit = lambda col, terms: tx.col(col).rlike(tx.java_ci(term_pattern(terms)))
    per = [F.transform(F.when(any_hit(col, terms) if cond is None else any_hit(col, terms) & cond, term_hits(name[str(col)], terms, True))
                       .otherwise(F.array().cast("array<string>")), _packer(check, sev, path))
           for check, sev, (path, col), terms, cond in rules]
    return Findings(per, {name[k]: widened(col) for k, col in texts.items()})


def _packer(check: str, sev: str, path):
    where = path if isinstance(path, Column) else F.lit(path)
    return lambda h: F.struct(F.lit(check).alias("check_id"), F.lit(sev).alias("sev"), where.alias("path"), h.alias("hit"))


def blank(c) -> Column:
    return F.trim(F.coalesce(tx.col(c), F.lit(""))) == ""


def first_word(c) -> Column:
    w = F.regexp_extract(tx.col(c), r"^[\s•▪►✓➢*·-]*(\p{L}[\p{L}'’-]*)", 1)
    return F.regexp_replace(F.lower(w), "^co-", "")


def is_past(w: Column) -> Column:
    return w.endswith("ed") | w.isin(*cat.IRREGULAR_PAST)


def line_path() -> Column:
    return F.concat(F.lit("lines."), F.col("line_ix").cast("string"))


# ---- families ------------------------------------------------------------------------------------------------

@row_family
def l1_blank_fields() -> Findings:
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), r"[^0-9]", ""))
    letters = F.length(F.regexp_replace(F.coalesce("name", F.lit("")), r"[^\p{L}]", ""))
    name_digits = F.length(F.regexp_replace(F.coalesce("name", F.lit("")), r"[^0-9]", ""))
    return Findings([found_by([
        rule("HDR-01", (letters < 2) | F.contains(F.coalesce("name", F.lit("")), F.lit("@")) | (name_digits >= 3), "name"),
        rule("HDR-02", ~F.coalesce(F.trim("email"), F.lit("")).rlike(r"^[^\s@]+@[^\s@]+\.[A-Za-z]{2,}$"), "email"),
        rule("HDR-02", blank("phone") | ~digits.between(7, 15), "phone"),
        rule("HDR-02", blank("city"), "city", sev="med"),
        rule("HDR-05", blank("work_rights") & (F.col("market") != "dach"), "work_rights", sev=F.when(F.col("market") == "uk", "low").otherwise("med")),
        rule("HL-01", blank("headline"), "headline"),
        rule("SUM-01", blank("summary"), "summary"),
        rule("LNG-01", blank("langs"), "langs"),
        rule("EDU-01", blank("edu_b"), "education", sev=F.when(F.col("market") == "dach", "high").otherwise("med")),
        rule("REF-02", blank("refs") & (F.col("market") != "uk"), "refs")])])


def l1_blank_roles(roles: DataFrame, places: Iterable[str] = ()) -> DataFrame:
    at = lambda f: F.concat(F.lit("roles."), F.col("role_ix").cast("string"), F.lit("." + f))
    rules = [rule("EXP-01", blank(f), at(f)) for f in ("title", "employer", "dates")]
    if places:
        tail = F.regexp_replace("employer", r"^[^,(|·—–]*", "")
        rules.append(rule("EXP-10", ~blank("employer") & ~tx.has_term(tail, places) & ~tx.has_term("employer", ["remote"]), at("employer"), F.col("employer")))
    return instances(roles, rules)


@row_family
def l2_terms_docs(words: dict[str, Iterable[str]]) -> Findings:
    """Banned terms of headline, summary and skills; ``words`` may replace any list by check id."""
    w = lambda check, default: words.get(check, default)
    head, summ = ("headline", F.coalesce("headline", F.lit(""))), ("summary", F.coalesce("summary", F.lit("")))
    skills = ("skills", F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ; "))
    return term_findings("d", [
        ("HL-03", "high", head, w("HL-03", cat.TARGET_WORDING), None), ("HL-05", "med", head, w("HL-05", cat.HEADLINE_ADJECTIVES), None),
        ("SUM-03", "med", summ, w("SUM-03", cat.PRAISE), None), ("SUM-04", "high", summ, w("SUM-04", cat.TAILORING), None),
        ("SUM-10", "low", summ, w("SUM-10", cat.FIRST_PERSON), None),
        ("SKL-02", "med", skills, w("SKL-02", cat.LANGUAGE_SKILLS), None), ("SKL-04", "low", skills, w("SKL-04", cat.SOFT_SKILLS), None),
        ("MKT-01", "low", summ, w("MKT-01", cat.US_SPELLING), (F.col("market") == "uk") & (F.col("doc_lang") == "en"))])


@row_family
def l2_terms_lines(words: dict[str, Iterable[str]]) -> Findings:
    """Qualifiers with no figure behind them, job-description openers and German wording in lines."""
    openers = tuple(words.get("BUL-04", cat.JD_OPENERS))
    opens = F.col("_norm").rlike("^(?:" + "|".join(openers) + ")(?: |$)")
    opener = F.when(opens, F.array(_packer("BUL-04", "low", line_path())(F.lit("")))).otherwise(
        F.array().cast(FINDINGS))
    found = term_findings("l", [
        ("BUL-05", "low", (line_path(), F.col("text")), words.get("BUL-05", cat.QUALIFIERS), ~F.col("is_template") & ~tx.has_figure("text")),
        ("DOC-05", "low", (line_path(), F.col("text")), words.get("DOC-05", ("inklusive",)), F.col("doc_lang") == "de")])
    return Findings([*found.arrays, opener], found.columns | {"_norm": tx.norm("text")})


def l2_employers_in_summary(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """SUM-05: an employer's core name in the summary of the same document."""
    core = F.trim(F.regexp_replace(F.regexp_extract("employer", r"^([^,(|·—–]*)", 1), r"(?i)\s+(?:l\.?l\.?c\.?|fze|fzco|gmbh|ag|ltd\.?|limited|plc|inc\.?|kg)$", ""))
    named = roles.select("doc_id", tx.norm(core).alias("core")).where(F.length("core") >= 4).distinct()
    j = docs.select("doc_id", tx.padded("summary").alias("_s")).join(named, "doc_id")
    return j.where(F.contains("_s", F.concat(F.lit(" "), "core", F.lit(" ")))).select(
        "doc_id", F.lit("SUM-05").alias("check_id"), F.lit("low").alias("sev"), F.lit("summary").alias("path"), F.col("core").alias("hit"))


# Personal-data patterns (label patterns cannot be dismissed, statements can).
_L = lambda terms: r"(?i)(?:^|[^\p{L}])(" + "|".join(terms) + r")(?:$|[^\p{L}])"
PERSONAL_RULES = (  # check, kind, pattern
    ("HDR-06", "nationality", _L(cat.NATIONALITY_LABELS)),
    ("HDR-07", "birth", _L(cat.BIRTH_LABELS)),
    ("HDR-07", "birth", r"(?i)(?:^|[^\p{L}-])((?:born|geboren|geb\.|née?|nacid[oa]|jahrgang)(?:\s+(?:on|in|am|le|el|the))?\s*:?\s*(?:[0-9]{1,2}[./ -][0-9a-z]+[./ -])?(?:19|20)[0-9]{2})"),
    ("HDR-07", "age", r"(?i)(?:^|[^\p{L}0-9])((?:age|alter|âge|edad)\s*:\s*[0-9]{2}|aged\s+[0-9]{2}|[0-9]{2}[\s-]+(?:years?[\s-]+old|years of age|jahre alt))(?:$|[^0-9])"),
    ("HDR-08", "marital", _L(cat.MARITAL_LABELS)),
    ("HDR-08", "marital", r"(?i)(?:^|[|·,;/])\s*(" + "|".join(cat.MARITAL_WORDS) + r")\s*(?:$|[|·,;/.])"),
    ("HDR-08", "children", r"(?i)(?:^|[^\p{L}0-9])((?:[0-9]+|one|two|three|ein|zwei|drei|un|deux)\s+(?:children|child|kids|kinder|kind|enfants?))(?:$|[^\p{L}])"),
    ("HDR-09", "religion", _L(cat.RELIGION_LABELS)),
    ("HDR-10", "health", _L(cat.HEALTH_WORDS)),
    ("HDR-12", "other", _L(cat.PERSONAL_LABELS)),
    ("HDR-12", "birthplace", _L(cat.BIRTHPLACE_LABELS)),
    ("HDR-12", "id number", r"(?i)(?:^|[^\p{L}])((?:passport|reisepass|visa|visum|emirates id|iqama|id)\s*(?:no\.?|number|nr\.?|nummer|#)\s*:?\s*[A-Z0-9-]*[0-9][A-Z0-9-]{4,}|784[-\s]?[0-9]{4}[-\s]?[0-9]{7}[-\s]?[0-9])"),
)
# Words, in lower case, of which every hit of a rule holds one, and whether it holds a digit: a text without them is not searched.
_BORN = ("born", "geboren", "geb.", "né", "nacid", "jahrgang")
PERSONAL_NEEDS = dict(zip((p for _, _, p in PERSONAL_RULES), (
    (cat.NATIONALITY_LABELS, False), (cat.BIRTH_LABELS, False), (_BORN, True), (("age", "alter", "âge", "edad", "year", "jahre alt"), True), (cat.MARITAL_LABELS, False),
    (cat.MARITAL_WORDS, False), (("child", "kid", "kind", "enfant"), False), (cat.RELIGION_LABELS, False), (cat.HEALTH_WORDS, False), (cat.PERSONAL_LABELS, False),
    (cat.BIRTHPLACE_LABELS, False), (("passport", "reisepass", "visa", "visum", "iqama", "id", "784"), True)), strict=True))
#: Characters whose case is not told from ``lower`` alone may stand in such a text, which is searched in any case.
ODD_CASE = r"[^\x00-\xff\u2010-\u2027\u20ac]"
CARD_NUMBER = r"(?:^|[^0-9])([0-9]{13,16})(?:$|[^0-9])"


@row_family
def l3_personal_data(path: Column, text: str, rules=PERSONAL_RULES) -> Findings:
    """Personal details printed in any text: every rule's hits in one pass. ``texts``: doc_id, text. A rule whose words are not in the text is
    not run (``PERSONAL_NEEDS``)."""
    per = []
    for check, kind, pattern in rules:
        hits = F.regexp_extract_all("_folded", F.lit(tx.java_ci(pattern)), F.lit(1))
        if pattern in PERSONAL_NEEDS:
            words, digit = PERSONAL_NEEDS[pattern]
            may = reduce(or_, (F.contains("_low", F.lit(w)) for w in words))
            # a null text has null hits, as before
            hits = F.when(~(F.col("_odd") | (F.col("_digit") & may if digit else may)), F.array().cast("array<string>")).otherwise(hits)
        per.append(F.transform(hits, _packer(check, "high", path)))
    folded = tx.fold_digits(text)
    return Findings(per, {"_folded": folded, "_low": F.lower(folded), "_odd": folded.rlike(ODD_CASE), "_digit": folded.rlike("[0-9]")})


@row_family
def l3_contact_patterns(path: Column, text: str) -> Findings:
    """REF-01 and ID-like data that have one exact pattern: addresses, phones, long number strings."""
    mails = F.transform(ct.emails(text), _packer("REF-01", "high", path))
    phones = F.transform(ct.phones(text), _packer("REF-01", "high", path))
    wide = F.regexp_replace(text, r"([^0-9])", "$1$1")
    numbers = F.array_distinct(F.regexp_extract_all(wide, F.lit(CARD_NUMBER), F.lit(1)))
    # a null text has null hits
    cards = F.transform(F.when(~tx.col(text).rlike("[0-9]{13}"), F.array().cast("array<string>")).otherwise(numbers), _packer("HDR-12", "high", path))
    return Findings([mails, phones, cards])


@row_family
def l4_shapes_lines(title_words=cat.TITLE_WORDS, company_openers=cat.COMPANY_OPENERS) -> Findings:
    """BUL-03, BUL-07, BUL-08, BUL-09, ATS-01: what a line looks like. ``n_in_role`` lines share the role."""
    w, t, normed = F.col("_first"), F.col("_trimmed"), F.col("_norm")
    noun = w.rlike(r"(?:tion|sion|ment|ance|ence|ship|ity|ness)$") | w.isin("the", "a", "an")
    present = w.rlike(r"^[a-z]+[^s]s$") & ~is_past(w) & ~F.col("is_current")
    opens = w.isin("i", "my", "we", "our", "me") | w.endswith("ing") | noun | present
    header = (F.length(t) <= 60) & tx.has_term("text", title_words) & ~t.endswith(".") & ~is_past(w) & ~w.endswith("ing")
    complete = t.rlike(r"^\p{Lu}") & t.rlike(r"[.!?]$")
    fragment = (F.col("n_in_role") >= 2) & ~complete & (t.rlike(r"^\p{Ll}") | normed.rlike("^(?:" + "|".join(cat.JOINING_WORDS) + ")(?: |$)")
                                                        | t.rlike(r"(?:,|&|-)$|(?i:(?:^|\s)(?:and|und|the)$)") | ((F.length(t) < 25) & ~header))
    company = (normed.rlike("^(?:" + "|".join(company_openers) + ")(?: |$)")
               | tx.col("text").rlike(r"(?i)(?:founded in|established in|gegründet|headquartered in)(?:\s+\S+){0,5}?\s*[0-9]{4}|a leading provider") | (F.size(tx.sentences("text")) >= 3))
    ats = F.col("text").rlike("\t|[\\x{E000}-\\x{F8FF}]|[\\x{1F300}-\\x{1FAFF}]") | F.col("text").rlike(r"^\s*[•▪►✓➢–]\s") | t.rlike(" {2,}")
    # the language vote is read only where the opener fails
    lang = F.when(opens, tx.lang_of("text"))
    return Findings([found_by([
        rule("BUL-03", opens & (lang == "en"), line_path(), w), rule("BUL-07", fragment, line_path()), rule("BUL-08", header, line_path()),
        rule("BUL-09", company & ~F.col("is_template"), line_path()), rule("ATS-01", ats, line_path())])], {"_first": first_word("text"), "_trimmed": F.trim("text"), "_norm": tx.norm("text")})


DURATION = r"(?i)^\s*[0-9]+\s*\+?\s*(?:years?|yrs?|months?|mos?|jahre?n?|monate?n?|ans?|mois|años|meses)(?:[^\p{L}]|$)"
DANGLING = r"^[—–\-|·,/]|[—–\-|·,/]$|[—–\-|·,/]\s*[—–\-|·,/]"


def l4_shapes_roles(roles: DataFrame, places: Iterable[str], today_ix: int) -> DataFrame:
    """EXP-02, EXP-03, EXP-04, EXP-06, EXP-12, ATS-02 over roles with their parsed dates (``pd``)."""
    at = lambda f: F.concat(F.lit("roles."), F.col("role_ix").cast("string"), F.lit("." + f))
    only_place = lambda c: F.trim(F.regexp_replace(tx.col(c), tx.java_ci(term_pattern(places)), " ")).rlike(r"^[\s,/&|·—–-]*(?:and|und)?[\s,/&|·—–-]*$") & tx.has_term(c, places)
    pd = F.col("pd")
    e, l = dt.early_ix(pd["from"], today_ix), dt.late_ix(pd["to"], today_ix)
    probe = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"(\p{L})-(\p{L})", "$1_$2"), r"([0-9])[-/.]([0-9])", "$1_$2")
    bad_title = (F.col("title").rlike(DURATION) | dt.parse_side("title").isNotNull() | only_place("title")
                 | (tx.has_term("title", cat.COMPANY_WORDS) & ~tx.has_term("title", cat.TITLE_WORDS)))
    rules = [rule("EXP-02", ~blank("title") & bad_title, at("title"), F.col("title")),
             rule("EXP-03", ~blank("employer") & only_place("employer"), at("employer"), F.col("employer")),
             rule("EXP-04", ~blank("dates") & (pd["from"].isNull() | (e > l) | (e > today_ix)), at("dates"), F.col("dates")),
             rule("EXP-06", pd["sep"].isin("-", "--", "—") & ~pd["single"], at("dates"), pd["sep"]),
             rule("EXP-12", pd["from"].isNotNull() & ~pd["to"]["is_open"] & ~pd["single"] & (dt.early_ix(pd["to"], today_ix) > today_ix), at("dates"), F.col("dates"))]
    rules += [rule("ATS-02", ~blank(f) & probe(f).rlike(DANGLING), at(f), F.col(f)) for f in ("title", "employer", "dates")]
    return instances(roles, rules)


@row_family
def l4_shapes_docs() -> Findings:
    """HDR-03, LNG-03, EDU-02, EDU-04, ATS-02 on document fields."""
    parts = F.filter(F.split(F.coalesce("langs", F.lit("")), r"[·,;|]"), lambda p: tx.has_term(p, cat.LANGUAGE_SKILLS[:15]) & ~tx.has_term(
        p, ("native", "fluent", "bilingual", "mother tongue", "muttersprache", "verhandlungssicher", "fließend", "basic", "good", "advanced", "gut",
            "intermediate", "conversational", "a1", "a2", "b1", "b2", "c1", "c2")))
    last = F.regexp_extract(F.trim("edu_b"), r"([A-Za-zÀ-ÿ]+)$", 1)
    cut = F.contains("edu_b", F.lit("\t")) | ((F.length("edu_b") >= 158) & F.col("edu_b").rlike(r"\p{L}$")) | (
        (F.length(last) >= 3) & (last == F.lower(last)) & (~last.rlike("(?i)[aeiouyäöüéèàáíóúâêôœ]") | last.rlike("[bcdfgkpt]l$")))
    probe = F.regexp_replace(F.trim("city"), r"(\p{L})-(\p{L})", "$1_$2")
    return Findings([found_by([
        rule("HDR-03", ~blank("phone") & ~F.trim("phone").rlike(r"^(?:\+|00)"), "phone", F.col("phone")),
        rule("LNG-03", F.size(parts) > 0, "langs", F.trim(F.get(parts, F.lit(0)))),
        rule("EDU-02", F.coalesce(cut, F.lit(False)), "education.0.b", F.col("edu_b")),
        rule("EDU-04", (F.col("market") == "dach") & ~blank("edu_b") & ~F.concat_ws(" ", "edu_b", "edu_s").rlike(r"(?:19[5-9][0-9]|20[0-3][0-9])"), "education.0.b", F.col("edu_b")),
        rule("ATS-02", ~blank("city") & probe.rlike(DANGLING), "city", F.col("city"))])])


@row_family
def l5_lengths() -> Findings:
    """Length and count bands on one row per document; ``bullets`` is the array of its own lines."""
    n_words, n_sent = F.col("_n_words"), F.size("_sentences")
    n_head = F.length(F.trim("headline"))
    n = F.size("bullets")
    figs = F.size(F.filter("bullets", lambda b: tx.has_figure(b)))
    long_lines = F.filter(F.transform("bullets", lambda b, i: F.struct(i.alias("ix"), F.length(F.trim(b)).alias("n"))), lambda x: x["n"] > 180)
    n_skills = F.size(F.coalesce("skills", F.array().cast("array<string>")))
    total = n_words + F.aggregate("bullets", F.lit(0), lambda acc, b: acc + tx.word_count(b))
    off, far = (n_words < 60) | (n_words > 90) | (n_sent < 3) | (n_sent > 4), (n_words < 45) | (n_words > 120) | (n_sent < 2) | (n_sent > 5)
    doc = found_by([
        rule("HL-04", n_head > 90, "headline", sev=F.when(n_head > 120, "med").otherwise("low")),
        rule("SUM-02", ~blank("summary") & off, "summary", sev=F.when(far, "med").otherwise("low")),
        rule("SUM-09", ~blank("summary") & ~tx.has_figure("summary") & ~tx.has_term("summary", ("staff", "team", "division", "founded", "promoted", "companies")), "summary"),
        rule("MET-01", (n >= 3) & (F.floor((200 * figs + n) / (2 * F.greatest(n, F.lit(1)))) < 40), "experience"),
        rule("SKL-03", (n_skills == 0) | ~n_skills.between(5, 12), "skills", sev=F.when(n_skills == 0, "med").otherwise("low")),
        rule("MKT-04", total > F.when(F.col("career_years") >= 8, 950).otherwise(550), "experience")])
    lines = F.transform(long_lines, lambda x: F.struct(F.lit("BUL-02").alias("check_id"), F.when(x["n"] > 260, "med").otherwise("low").alias("sev"),
                                                       F.concat(F.lit("lines."), x["ix"].cast("string")).alias("path"), F.lit("").alias("hit")))
    return Findings([doc, lines], {"_n_words": tx.word_count("summary"), "_sentences": tx.sentences("summary")})


def l5_roles(ranked: DataFrame, today_year: int) -> DataFrame:
    """BUL-01 and EXP-11 over roles with ``recency``, ``n_lines``, ``n_roles``, ``to_ix``, ``is_current``."""
    at = F.concat(F.lit("roles."), F.col("role_ix").cast("string"))
    r, n = F.col("recency"), F.col("n_lines")
    lo, hi = F.when(r == 0, 4).when(r <= 2, 2).otherwise(0), F.when(r == 0, 6).when(r <= 2, 4).otherwise(3)
    return instances(ranked, [
        rule("BUL-01", (n < lo) | (n > hi), at, n.cast("string"), sev=F.when((r <= 2) & (n == 0), "med").otherwise("low")),
        rule("EXP-11", (F.col("n_roles") >= 5) & (r >= 4) & ~F.col("is_current") & (F.floor(F.col("to_ix") / 12) <= today_year - 15), at)])


def l6_orphan_figures(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """SUM-07: a figure of the summary that no line of the document carries before the same word."""
    claims = docs.select("doc_id", F.col("summary").alias("text"))
    out = lk.orphan_numbers(claims, lines.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", F.lit("SUM-07").alias("check_id"), F.lit("high").alias("sev"), F.lit("summary").alias("path"), F.col("value").alias("hit"))


def l6_skills_without_evidence(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """SKL-01: a one-word skill no line of the document shows, by stem."""
    skills = docs.select("doc_id", F.posexplode("skills").alias("ix", "skill")).withColumn("_s", tx.stem(F.lower("skill")))
    seen = lines.select("doc_id", F.explode(F.array_distinct(F.transform(tx.words("text"), tx.stem))).alias("_s"))
    return skills.join(seen, ["doc_id", "_s"], "left_anti").select(
        "doc_id", F.lit("SKL-01").alias("check_id"), F.lit("med").alias("sev"), F.concat(F.lit("skills."), F.col("ix").cast("string")).alias("path"), F.col("skill").alias("hit"))


@row_family
def l6_evidence_rows() -> Findings:
    """SUM-07 and SKL-01 against the lines of the same row (``bullets``): a figure of the summary that no line carries before the same word, and
    a skill that no line shows, by stem."""
    proofs = F.flatten(F.transform("bullets", lk.figures))
    shown = lambda f, p: (p["value"] == f["value"]) & ((f["unit"] != "") | F.arrays_overlap(f["next"], p["next"]))
    loose = F.filter(lk.figures("summary"), lambda f: ~F.exists(F.col("_proofs"), lambda p: F.coalesce(shown(f, p), F.lit(False))))
    figures = F.transform(loose, lambda f: _packer("SUM-07", "high", "summary")(f["value"]))
    stems = F.flatten(F.transform("bullets", tx.stems))
    own = F.transform("skills", lambda x, i: F.struct(i.alias("ix"), x.alias("x"), tx.stem(F.lower(x)).alias("s")))
    skills = F.transform(F.filter(own, lambda o: F.array_contains(F.col("_missing"), o["s"])), lambda o: F.struct(
        F.lit("SKL-01").alias("check_id"), F.lit("med").alias("sev"), F.concat(F.lit("skills."), o["ix"].cast("string")).alias("path"), o["x"].alias("hit")))
    return Findings([figures, skills], {"_proofs": proofs, "_missing": F.array_except(F.transform("skills", lambda x: tx.stem(F.lower(x))), stems)})


@row_family
def l6_consistency_docs(dial: dict[str, str], place_country: dict[str, str]) -> Findings:
    """HDR-04 (dial code against city), MET-03 (claim skills with no line), LNG-04 (language of the summary not listed), SUM-06 (years)."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce("phone", F.lit("")), r"[\s-]", ""), "^00", "+")
    by_dial, by_city = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, country in dial.items():
        by_dial = F.coalesce(by_dial, F.when(p.startswith(code), F.lit(country)))
    for place, country in place_country.items():
        by_city = F.coalesce(by_city, F.when(tx.has_term("city", [place]), F.lit(country)))
    text = F.concat_ws(" ; ", "headline", "summary", F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ; "))
    hits = lambda c, terms: F.array_distinct(F.transform(
        F.when(tx.col(c).rlike(tx.java_ci(term_pattern(terms))), term_hits(c, terms)).otherwise(F.array().cast("array<string>")), F.lower))
    body = F.lower(F.array_join("bullets", " ; "))
    unproven, langs, years = F.col("_unproven"), F.col("_unlisted"), F.col("_years")
    columns = {"_unproven": F.filter(hits(text, cat.CLAIM_SKILLS), lambda h: ~F.contains(body, h)),
               "_unlisted": F.filter(hits("summary", cat.LANGUAGE_SKILLS[:15]), lambda h: ~F.contains(F.lower(F.coalesce("langs", F.lit(""))), h)),
               "_years": F.array_max(F.transform(F.regexp_extract_all("summary", F.lit(r"(?i)([0-9]{1,2})\s*\+?\s*(?:years|yrs|jahren?|ans|años)"), F.lit(1)), lambda y: y.cast("int")))}
    return Findings([found_by([
        rule("HDR-04", F.coalesce(by_dial != by_city, F.lit(False)), "city", F.col("city")),
        rule("MET-03", F.size(unproven) > 0, "summary", F.get(unproven, F.lit(0))),
        rule("LNG-04", F.size(langs) > 0, "summary", F.get(langs, F.lit(0))),
        rule("SUM-06", F.coalesce(years > F.col("career_years"), F.lit(False)), "summary", years.cast("string"))])], columns)


def title_classes(text) -> Column:
    """Rank classes a title names."""
    return F.array_compact(F.array(*[F.when(tx.has_term(text, terms), F.lit(c)) for c, terms in cat.RANK_CLASSES]))


def l6_titles_never_held(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """HL-02: a rank in the headline that no held title carries or covers. A held "Deputy ..." supports only a headline that says so too."""
    covers = F.create_map(*[x for c, _ in cat.RANK_CLASSES for x in (
        F.lit(c), F.array(F.lit(c), *[F.lit(k) for k in dict(cat.COVERS).get(c, ())]))])
    bound = tx.has_term("title", cat.BINDING)
    per = roles.select("doc_id", bound.alias("_b"), F.explode(title_classes("title")).alias("_c")).select(
        "doc_id", "_b", F.explode(F.try_element_at(covers, F.col("_c"))).alias("_c"))
    held = per.groupBy("doc_id").agg(F.collect_set(F.when(~F.col("_b"), F.col("_c"))).alias("_free"), F.collect_set("_c").alias("_any"))
    j = docs.select("doc_id", "headline", title_classes("headline").alias("_h")).join(held, "doc_id", "left")
    empty = F.array().cast("array<string>")
    have = F.when(tx.has_term("headline", cat.BINDING), F.coalesce("_any", empty)).otherwise(F.coalesce("_free", empty))
    claims = j.select("doc_id", F.array_except("_h", have).alias("_x"))
    return claims.select("doc_id", F.lit("HL-02").alias("check_id"), F.lit("high").alias("sev"), F.lit("headline").alias("path"), F.explode("_x").alias("hit"))


def l6_orphan_places(docs: DataFrame, lines: DataFrame, alias: DataFrame, members: DataFrame, places: Iterable[str]) -> DataFrame:
    """SUM-08: a place of the summary whose country (or any country of its region) no line names.

    ``alias``: place, country, meta (lower case); ``places``: the aliases to look for."""
    names = lambda c: F.array_distinct(F.transform(term_hits(c, places), F.lower))
    claims = docs.select("doc_id", F.explode(names("summary")).alias("place")).withColumn("claim_id", F.concat_ws("|", F.col("doc_id").cast("string"), "place"))
    named = lines.select("doc_id", F.explode(names("text")).alias("place"))
    out = lk.orphan_places(claims, named, alias, members, "doc_id")
    return out.select("doc_id", F.lit("SUM-08").alias("check_id"), F.lit("med").alias("sev"), F.lit("summary").alias("path"), F.col("place").alias("hit"))


def l2_date_words(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """DOC-03: date words, or levels in the languages line, of another language than the document's. ``roles`` carry ``doc_lang``."""
    at = F.concat(F.lit("roles."), F.col("role_ix").cast("string"), F.lit(".dates"))
    wrong = F.when(F.col("doc_lang") == "de", F.get(term_hits("dates", cat.NOT_GERMAN_DATES), F.lit(0))).when(
        F.col("doc_lang") == "en", F.get(term_hits("dates", cat.NOT_ENGLISH_DATES), F.lit(0)))
    level = F.when(F.col("doc_lang") == "de", tx.has_term("langs", ("native", "fluent", "mother tongue"))).when(
        F.col("doc_lang") == "en", tx.has_term("langs", ("muttersprache", "verhandlungssicher", "fließend")))
    return instances(roles, [rule("DOC-03", wrong.isNotNull(), at, wrong)]).unionByName(
        instances(docs, [rule("DOC-03", F.coalesce(level, F.lit(False)), "langs", F.col("langs"))]))


@row_family
def l3_references() -> Findings:
    """REF-01 (contact details of a referee) and REF-03 (a referee is named) in the references line."""
    refs = F.coalesce("refs", F.lit(""))
    contact = (F.size(ct.emails(refs)) > 0) | F.regexp_replace(refs, r"[\s-]", "").rlike("[0-9]{7,}") | tx.has_term(refs, ("tel", "phone", "mobile", "telefon", "handy", "whatsapp"))
    name = F.coalesce(F.nullif(F.regexp_extract(refs, cat.HONORIFIC, 1), F.lit("")), F.nullif(F.regexp_extract(refs, cat.NAME_PAIR, 1), F.lit("")))
    return Findings([found_by([rule("REF-01", contact, "refs", refs), rule("REF-03", name.isNotNull(), "refs", name)])])


def recent_roles_without_figure(lines: DataFrame) -> DataFrame:
    """MET-02: the three newest roles with lines but no figure in any; each becomes a question. ``lines``: doc_id, role_ix, recency, text, is_template."""
    own = lines.where((F.col("recency") <= 2) & ~F.col("is_template"))
    return (own.groupBy("doc_id", "role_ix", "recency").agg(F.bool_or(tx.has_figure("text")).alias("_f")).where("NOT _f")
            .select("doc_id", F.concat(F.lit("MET-02|"), F.col("role_ix").cast("string")).alias("key"), F.lit(False).alias("gate"), "recency",
                    F.lit(True).alias("is_figure"), F.col("role_ix").alias("role"), F.col("role_ix").alias("pos")))


def l7_pairs(roles: DataFrame, key: str, role: str) -> DataFrame:
    """EXP-07 (stored order) and EXP-08 (overlap of two months or more) over roles with month bounds."""
    over = iv.overlap_counts(roles, key, role)
    out = iv.out_of_order(roles, [key], role, F.col("to_ix"))
    shape = lambda df, check, hit: df.select(F.col(key).alias("doc_id"), F.lit(check).alias("check_id"), F.lit("med").alias("sev"),
                                             F.concat(F.lit("roles."), F.col(role).cast("string")).alias("path"), hit.cast("string").alias("hit"))
    return shape(over, "EXP-08", F.col("n_overlaps")).unionByName(shape(out, "EXP-07", F.col("above")))


def l7_lines(lines: DataFrame) -> DataFrame:
    """BUL-06: the same or nearly the same line twice."""
    d = lk.near_duplicate_lines(lines, "doc_id", "line_ix", "text")
    return d.select("doc_id", F.lit("BUL-06").alias("check_id"), F.when(F.col("kind") == "exact", "med").otherwise("low").alias("sev"),
                    F.concat(F.lit("lines."), F.col("line_ix").cast("string")).alias("path"), F.col("partner_ix").cast("string").alias("hit"))


def l7_bullets(docs: DataFrame) -> DataFrame:
    """BUL-06 where the lines of a document stand in one row (``bullets``)."""
    d = lk.repeated_lines(docs, "doc_id", "bullets")
    return d.select("doc_id", F.lit("BUL-06").alias("check_id"), F.when(F.col("kind") == "exact", "med").otherwise("low").alias("sev"),
                    F.concat(F.lit("lines."), F.col("line_ix").cast("string")).alias("path"), F.col("partner_ix").cast("string").alias("hit"))


PLACES = pa.list_(pa.struct([("ix", pa.int32()), ("other", pa.int32())]))


def skill_words(skill: Column) -> Column:
    return F.array_distinct(F.filter(tx.letter_words(skill), lambda w: (F.length(w) >= 3) & ~w.isin("and", "und")))


def covered_by(rows: list[list[list[str] | None]]) -> list[dict[str, int]]:
    """``ix, other`` of the skills (lists of words, by place, in one or more rows) whose words all stand in another one: the first such, of equal
    ones a later one. A skill meets others only under its rarest word."""
    skills = {(ix, tuple(s)) for row in rows for ix, s in enumerate(row) if s}
    held: dict[str, list] = {}
    for ix, s in sorted(skills):
        entry = (ix, len(s), frozenset(s))
        for w in s:
            held.setdefault(w, []).append(entry)
    first: dict[int, int] = {}
    for ix, s in skills:
        for other, n, o in min((held[w] for w in s), key=len):
            if other != ix and (len(s) < n or ix < other) and o.issuperset(s):
                first[ix] = min(other, first.get(ix, other))
                break
    return [{"ix": ix, "other": other} for ix, other in sorted(first.items())]


def l7_skills(docs: DataFrame) -> DataFrame:
    """SKL-05: a skill whose words all stand in another skill of the document (the first such is named; of equal ones the later), and a
    skill that begins in lower case. A document's skills are gathered once and compared there."""
    at = lambda ix: F.concat(F.lit("skills."), ix.cast("string"))
    pack = lambda ix, hit: F.struct(F.lit("SKL-05").alias("check_id"), F.lit("low").alias("sev"), at(ix).alias("path"), hit.alias("hit"))
    shape = lambda df, found: df.select("doc_id", F.explode(tx.as_made(found)).alias("i")).select("doc_id", "i.*")
    compare = F.arrow_udf(lambda rows: pa.array(map(covered_by, rows.to_pylist()), PLACES), "array<struct<ix:int,other:int>>")
    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.transform("skills", skill_words).alias("_s"))
    inside = own.groupBy("doc_id").agg(F.collect_list("_s").alias("_rows")).select("doc_id", compare("_rows").alias("_inside"))
    first = lambda x: F.regexp_extract(F.lower(x), r"(\p{L}+)", 1)
    lower = F.filter(F.transform("skills", lambda x, i: pack(i, x)), lambda f: F.trim(f["hit"]).rlike(r"^\p{Ll}") & ~first(f["hit"]).isin(*cat.BRANDS))
    return shape(inside, F.transform("_inside", lambda p: pack(p["ix"], at(p["other"])))).unionByName(shape(docs, lower))


@row_family
def l6_language_levels() -> Findings:
    """LNG-02: a language that is called native in one place and learnt in another, in the languages line or the summary. German is a
    gate, other languages are a question.

    In the languages line a level holds for its part of the line. In the summary it stands next to the language or to a list that the
    language is in, before it (also with ``in``) or after it (also in brackets, after a colon, ``auf``, ``at``)."""
    word = lambda terms: "(?:" + "|".join(sorted((t.replace(" ", r"\s+") for t in terms), key=len, reverse=True)) + ")"
    edge, end = r"(?iu)(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    names = word(n for _, own in cat.LANGUAGE_GROUPS for n in own)
    comma = rf"\s*(?:,|&|(?:{'|'.join(cat.LIST_WORDS)}){end})\s*"
    summary, parts = F.coalesce("summary", F.lit("")), F.split(F.coalesce("langs", F.lit("")), r"[·,;|/]")
    rules = []
    for group, own in cat.LANGUAGE_GROUPS:
        language = word(own) + end + r"(?![-‐]\p{L})"

        def stated(levels, language=language, own=own):
            level = word(levels) + end
            after = rf"{edge}{language}(?:{comma}{names}{end})*\s*(?:\(|:|auf|au niveau|at)?\s*{level}"
            before = rf"{edge}{level}\s*(?:(?:in|en)\s+)?(?:{names}{end}{comma})*{language}"
            in_line = F.exists(parts, lambda x: x.rlike(edge + word(own) + end) & x.rlike(edge + level))
            return in_line | (F.col("_named") & (summary.rlike(after) | summary.rlike(before)))

        both = stated(cat.NATIVE_LEVELS) & stated(cat.LEARNT_LEVELS)
        rules.append(rule("LNG-02", both, "langs", F.lit(group), sev="high" if group == "german" else "med"))
    # either form holds the name of a language
    return Findings([found_by(rules)], {"_named": summary.rlike(edge + names + end)})


def lint_all(docs: DataFrame, lines: DataFrame, roles: DataFrame | None = None, words: dict[str, Iterable[str]] | None = None, title_words=cat.TITLE_WORDS,
             company_openers=cat.COMPANY_OPENERS, dial: dict[str, str] | None = None, place_country: dict[str, str] | None = None, places: Iterable[str] = (),
             alias: DataFrame | None = None, members: DataFrame | None = None, today_ix: int | None = None) -> DataFrame:
    """Instances of every check with a data rule: ``doc_id, check_id, sev, path, hit``.

    ``docs`` and ``lines`` as in the families above; ``docs.raw`` is the whole text for personal data, ``docs.bullets`` the lines in one row. All
    checks that look at one row run in one pass per table; only repeated skills meet in a join. Checks over roles run where
    ``roles`` are given (``role_ix, title, employer, dates, pd, doc_lang, langs, recency, n_lines, n_roles, from_ix, to_ix, is_current,
    fmt``), those over places where ``alias`` and ``members`` are."""
    words, doc_row = words or {}, F.lit("text")
    of_docs = in_one_pass(docs, l1_blank_fields.of(), l2_terms_docs.of(words), l3_personal_data.of(doc_row, "raw"), l3_contact_patterns.of(doc_row, "raw"), l3_references.of(),
                          l4_shapes_docs.of(), l5_lengths.of(), l6_consistency_docs.of(dial or {}, place_country or {}), l6_evidence_rows.of(), l6_language_levels.of(), l9_languages.of())
    of_lines = in_one_pass(lines, l2_terms_lines.of(words), l4_shapes_lines.of(title_words, company_openers), l10_templates.of())
    parts = [of_docs, of_lines, l7_bullets(docs), l7_skills(docs)]
    if alias is not None:
        parts.append(l6_orphan_places(docs, lines, alias, members, places))
    if roles is not None:
        parts += [l1_blank_roles(roles, places), l2_employers_in_summary(docs, roles), l2_date_words(docs, roles), l4_shapes_roles(roles, places, today_ix),
                  l5_roles(roles, today_ix // 12), l6_titles_never_held(docs, roles), l7_pairs(roles, "doc_id", "role_ix"),
                  l8_timeline(roles, "doc_id", today_ix, F.col("is_current"), F.col("fmt"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def l8_timeline(roles: DataFrame, key: str, today_ix: int, is_open: Column, fmt: Column) -> DataFrame:
    """EXP-09 (gaps), EXP-05 and MKT-02 (date styles): ``fmt`` is the printed style of a role's dates."""
    gaps = iv.timeline_gaps(roles, key, today_ix, is_open=is_open).select(
        F.col(key).alias("doc_id"), F.lit("EXP-09").alias("check_id"), "sev", F.lit("experience").alias("path"), F.col("months").cast("string").alias("hit"))
    n = lambda f: F.sum((F.col("_f") == f).cast("int"))
    styles = roles.select(F.col(key).alias("doc_id"), fmt.alias("_f")).groupBy("doc_id").agg(
        n("MM/YYYY").alias("mm"), n("Mon YYYY").alias("mon"), n("YYYY").alias("y"))
    mixed = instances(styles, [
        rule("EXP-05", (F.col("mm") > 0) & (F.col("mon") > 0), "experience", F.concat_ws("/", F.col("mm").cast("string"), F.col("mon").cast("string"))),
        rule("EXP-05", ((F.col("mm") + F.col("mon")) > 0) & (F.col("y") > 0), "experience", F.col("y").cast("string"), sev="low"),
        rule("MKT-02", F.col("mm") * 2 > F.col("mm") + F.col("mon"), "experience", F.col("mm").cast("string"))])
    return gaps.unionByName(mixed)


@row_family
def l9_languages() -> Findings:
    """DOC-01 (lines), DOC-02 (summary and its long sentences), EDU-03 over one row per document."""
    known = lambda langs: F.filter(langs, lambda x: x != "unknown")
    votes = {"_l": known(F.transform("bullets", lambda b: tx.lang_of(b))), "_s": tx.lang_of(F.coalesce("summary", F.lit(""))), "_sentences": tx.sentences("summary")}
    target = F.size(F.filter("_l", lambda x: x == F.col("doc_lang")))
    foreign = F.filter(F.transform(F.filter("_sentences", lambda s: tx.word_count(s) >= 8), lambda s: tx.lang_of(s)), lambda x: ~x.isin("unknown") & (x != F.col("doc_lang")))
    whole = (F.col("_s") != "unknown") & (F.col("_s") != F.col("doc_lang"))
    german = ("abschlussprüfung", "gesamtnote", "gesamtergebnis", "zeugnis", "bestanden", "berufsschule", "fachrichtung", "ausbildung")
    return Findings([found_by([
        rule("DOC-01", (F.size("_l") >= 3) & (target * 2 < F.size("_l")), "experience"),
        rule("DOC-02", whole | (F.size(foreign) > 0), "summary", F.when(whole, F.col("_s"))),
        rule("EDU-03", (F.col("doc_lang") == "en") & tx.has_term(F.coalesce("edu_s", F.lit("")), german), "education.0.s")])], votes)


@row_family
def l10_templates() -> Findings:
    return Findings([found_by([rule("ACH-01", F.col("is_template"), line_path())])])


# ---- scoring -------------------------------------------------------------------------------------------------

def instance_key() -> Column:
    return F.md5(F.concat_ws("|", "check_id", F.col("doc_id").cast("string"), "path", tx.norm("hit")))


def live_instances(found: DataFrame, acks: DataFrame, overridable: Column, builder: bool = False) -> DataFrame:
    """Instances still counted: not acknowledged (high ones only when overridable) and not waiting for the builder."""
    keyed = found.withColumn("key", instance_key())
    open_ = keyed.join(acks.select("key").distinct().withColumn("_ack", F.lit(True)), "key", "left")
    kept = open_.where(F.col("_ack").isNull() | ((F.col("sev") == "high") & ~overridable)).drop("_ack")
    return kept if builder else kept.where(~F.col("check_id").isin(*cat.DEFERRED))


def penalties(found: DataFrame) -> DataFrame:
    """Penalty per document, check and severity. Spread by document once; every later step keeps that placement."""
    n = found.repartition("doc_id").groupBy("doc_id", "check_id", "sev").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pen = F.lit(0)
    for sev, (base, step, most) in cat.PENALTY.items():
        pen = F.when(F.col("sev") == sev, base + F.least(F.lit(most), step * (F.col("n") - 1))).otherwise(pen)
    return n.withColumn("penalty", pen.cast("int"))


def scores(pen: DataFrame) -> DataFrame:
    gate = F.col("check_id").isin(*cat.GATES) & (F.col("sev") == "high")
    agg = pen.groupBy("doc_id").agg(F.sum("penalty").cast("int").alias("lost"), F.bool_or(gate).alias("gated"))
    raw = F.greatest(F.lit(0), 100 - F.col("lost"))
    s = agg.withColumn("raw_score", raw.cast("int")).withColumn("score", F.when(F.col("gated"), F.least(raw, F.lit(59))).otherwise(raw).cast("int"))
    return s.withColumn("verdict", F.when(F.col("gated"), "not ready").when(F.col("score") >= 85, "ready")
                        .when(F.col("score") >= 70, "ready after fixes").otherwise("needs work"))


def _part() -> Column:
    table = F.create_map(*[F.lit(x) for r in cat.checks() for x in (r[0], r[1])])
    return F.try_element_at(table, F.col("check_id"))


def section_scores(pen: DataFrame) -> DataFrame:
    """One column per section: 100 minus its penalties, at least 0."""
    table = F.create_map(*[F.lit(x) for k, v in cat.SECTIONS.items() for x in (k, v)])
    sec = F.try_element_at(table, F.split("check_id", "-")[0])
    names = list(dict.fromkeys(cat.SECTIONS.values()))
    agg = pen.withColumn("_sec", sec).groupBy("doc_id").agg(*[
        F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.when(F.col("_sec") == n, F.col("penalty"))), F.lit(0))).cast("int").alias(n.lower().replace(" ", "_")) for n in names])
    return agg


def scorecard(pen: DataFrame) -> DataFrame:
    """Score per document and part with its costliest checks first."""
    gate = F.col("check_id").isin(*cat.GATES) & (F.col("sev") == "high")
    per_check = pen.withColumn("part", _part()).groupBy("doc_id", "part", "check_id").agg(F.sum("penalty").cast("int").alias("p"), F.bool_or(gate).alias("g"))
    agg = per_check.groupBy("doc_id", "part").agg(
        F.sum("p").cast("int").alias("lost"), F.bool_or("g").alias("gated"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), (~F.col("g")).alias("g"), "check_id"))), lambda x: x["check_id"]), ",").alias("checks"))
    return agg.withColumn("score", F.least(F.when(F.col("gated"), 59).otherwise(100), F.greatest(F.lit(0), 100 - F.col("lost"))).cast("int"))


def worst_first(card: DataFrame, total: DataFrame) -> DataFrame:
    """The part to name when a document is below 85: lowest score, gated first, most lost, fixed order. In a gated
    document only gated parts are named."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(cat.PART_ORDER) for x in (p, i)])
    j = card.join(total.where("score < 85").select("doc_id", F.col("score").alias("total"), F.col("gated").alias("doc_gated")), "doc_id")
    named = j.where(~F.col("doc_gated") | F.col("gated"))
    rank = F.struct(F.col("score").alias("s"), (~F.col("gated")).alias("g"), (-F.col("lost")).alias("l"), F.try_element_at(order, F.col("part")).alias("o"))
    return named.groupBy("doc_id").agg(F.min_by("part", rank).alias("part"), F.min_by("score", rank).alias("part_score"), F.max("total").alias("score"))


def rule_coverage(checks: DataFrame, mapping: DataFrame, parts: list[str]) -> DataFrame:
    """Checks without a part, mapped checks that no longer exist, and unknown parts."""
    j = checks.select("check_id", F.lit(True).alias("_c")).join(mapping.select("check_id", "part", F.lit(True).alias("_m")), "check_id", "full_outer")
    problem = (F.when(F.col("_m").isNull(), "unmapped").when(F.col("_c").isNull(), "stale").when(~F.col("part").isin(*parts), "bad target"))
    return j.select("check_id", problem.alias("problem")).where("problem IS NOT NULL")


def open_questions(questions: DataFrame, per_role: int | None = None, total: int | None = None) -> DataFrame:
    """Order of a document's open questions: gate-linked, then by recency, then the rest. A caller may ask for the first ``per_role``
    figure questions of a role and the first ``total`` in all. ``questions``: doc_id, key, gate, recency, is_figure, role, pos (bounded per document)."""
    weight = F.when(F.col("gate"), 0).when(F.col("recency").isNotNull(), 1).otherwise(2)
    w = W.partitionBy("doc_id").orderBy("_w", F.coalesce("recency", F.lit(99)), "pos")
    q = questions.withColumn("_w", weight).withColumn("_o", F.row_number().over(w))
    fig = F.col("is_figure") & F.col("role").isNotNull()
    q = q.withColumn("_f", F.sum(fig.cast("int")).over(W.partitionBy("doc_id", "role").orderBy("_o")))
    q = q.withColumn("_ok", F.lit(True) if per_role is None else ~(fig & (F.col("_f") > per_role)))
    q = q.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(W.partitionBy("doc_id").orderBy("_o")))
    return q.where(F.col("_ok") if total is None else F.col("_ok") & (F.col("_n") <= total)).select("doc_id", "key", F.col("_n").cast("int").alias("place"))


# ---- second linter, hints, screening -------------------------------------------------------------------------

QUICK_SEV = {"high": 3, "med": 2, "low": 1}


def quick_review(docs: DataFrame, openers=cat.JD_OPENERS, buzzwords=cat.BUZZWORDS) -> DataFrame:
    """Eleven quick rules on one row per document; ``score`` = max(0, 100 - 9 x severities).

    Reads ``bullets``, ``summary``, ``email``, ``phone``, ``n_roles``, ``n_unsized``, ``n_old_detailed``, ``raw``."""
    b = F.col("bullets")
    n = F.size(b)
    figs = F.size(F.filter(b, lambda x: tx.has_figure(x)))
    pct = F.floor((200 * figs + n) / (2 * F.greatest(n, F.lit(1))))
    weak = F.size(F.filter(b, lambda x: tx.norm(x).rlike("^(?:" + "|".join(openers) + ")(?: |$)")))
    hay = tx.padded(F.concat_ws(" ", F.array_join(b, " "), "summary"))
    buzz = sum((F.contains(hay, F.lit(f" {w} ")).cast("int") for w in (t.replace("-", " ") for t in buzzwords)), F.lit(0))
    pron = F.size(F.filter(b, lambda x: tx.has_term(x, ("i", "my", "ich", "mein"))))
    sw = tx.word_count(F.coalesce("summary", F.lit("")))
    first = F.array_sort(F.filter(F.transform(b, first_word), lambda w: F.length(w) > 3))
    repeated = F.exists(first, lambda w: F.size(F.filter(first, lambda v: v == w)) >= 3)
    personal = F.col("raw").rlike(tx.java_ci(_L(cat.NATIONALITY_LABELS + cat.BIRTH_LABELS + cat.MARITAL_LABELS + cat.RELIGION_LABELS)))
    sev = {
        "figures": F.when((n > 0) & (pct < 20), "high").when((n > 0) & (pct < 50), "med"),
        "openers": F.when(weak > 2, "high").when(weak > 0, "med"),
        "buzzwords": F.when(buzz > 3, "med").when(buzz > 0, "low"),
        "pronouns": F.when(pron > 1, "low"),
        "summary": F.when(sw == 0, "high").when(sw > 80, "med").when(~tx.has_figure("summary"), "low"),
        "scale": F.when(F.col("n_unsized") > 1, "med").when(F.col("n_unsized") > 0, "low"),
        "verbs": F.when(repeated, "low"),
        "length": F.when(n > 28, "med"),
        "ats": F.when(blank("email") | blank("phone") | (F.col("n_roles") == 0), "high"),
        "earlier": F.when(F.col("n_old_detailed") > 0, "low"),
        "personal": F.when(personal, "med"),
    }
    out = docs.select("doc_id", *[v.alias(k) for k, v in sev.items()])
    lost = sum((F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in QUICK_SEV.items() for x in kv]), F.col(k)), F.lit(0)) for k in sev), F.lit(0))
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 9 * lost).cast("int"))


def line_hints(lines: DataFrame, qualifiers=cat.QUALIFIERS, openers=cat.JD_OPENERS) -> DataFrame:
    """Hints on single lines: opener, length, qualifier, pronoun, missing figure."""
    w = first_word("text")
    hints = F.array_compact(F.array(
        F.when(tx.norm("text").rlike("^(?:" + "|".join(openers) + ")(?: |$)"), "opener").when(~(is_past(w) | w.rlike(r"^[a-z]+s$")), "verb"),
        F.when(F.length(F.trim("text")) > 180, "length"), F.when(tx.has_term("text", qualifiers), "qualifier"),
        F.when(tx.has_term("text", ("i", "my", "ich", "mein")), "pronoun"), F.when(~tx.has_figure("text"), "figure")))
    return lines.select("doc_id", "line_ix", F.array_join(hints, ",").alias("hints"))


def screen_verdict(reasons: DataFrame) -> DataFrame:
    """skip, shortlist or maybe from one row of flags per document.

    Reads ``gated, blocked, top_ok, title_ok, current_ok, figure_ok, n_must, n_kept``."""
    must_ok = F.col("n_kept") >= F.least(F.lit(2), F.col("n_must"))
    skip = F.col("gated") | F.col("blocked") | ((F.col("n_must") > 0) & (F.col("n_kept") == 0))
    ok = F.col("top_ok") & F.col("title_ok") & F.col("current_ok") & F.col("figure_ok") & must_ok
    bad = F.array_join(F.array_compact(F.array(*[F.when(~c, n) for n, c in (
        ("V-GATE", ~F.col("gated")), ("V-BLOCK", ~F.col("blocked")), ("V-TOP", F.col("top_ok")), ("V-TITLE", F.col("title_ok")),
        ("V-CURRENT", F.col("current_ok")), ("V-FIG", F.col("figure_ok")), ("V-MUST", must_ok))])), ",")
    return reasons.select("doc_id", F.when(skip, "skip").when(ok, "shortlist").otherwise("maybe").alias("verdict"), bad.alias("against"))


def top_rejection(found: DataFrame) -> DataFrame:
    """The one finding to name first per document: gate, severity, section order, position."""
    sev = F.when(F.col("sev") == "high", 0).when(F.col("sev") == "med", 1).otherwise(2)
    order = F.create_map(*[F.lit(x) for i, s in enumerate(dict.fromkeys(k for k in cat.SECTIONS)) for x in (s, i)])
    rank = F.struct((~F.col("check_id").isin(*cat.GATES)).alias("g"), sev.alias("s"), F.try_element_at(order, F.split("check_id", "-")[0]).alias("o"), F.col("path").alias("p"), F.col("check_id").alias("c"))
    return found.groupBy("doc_id").agg(F.min_by("check_id", rank).alias("check_id"), F.min_by("sev", rank).alias("sev"), F.min_by("path", rank).alias("path"))


def top_zone(lines: DataFrame) -> DataFrame:
    """Lines read first: headline, first summary sentence, the newest role's header and its first two lines.

    ``lines``: doc_id, kind (headline/summary/role/bullet), ix, recency, text."""
    return lines.where((F.col("kind") == "headline") | ((F.col("kind") == "summary") & (F.col("ix") == 0))
                       | ((F.col("recency") == 0) & ((F.col("kind") == "role") | ((F.col("kind") == "bullet") & (F.col("ix") < 2)))))


def evidence_zone(report: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per must-have: keep (printed in the zone), move (printed only below), else its report state.

    ``report``: doc_id, concept, state; ``tokens``: doc_id, token, in_zone."""
    zone = tokens.groupBy("doc_id", F.col("token").alias("concept")).agg(F.bool_or("in_zone").alias("_z"))
    j = report.join(zone, ["doc_id", "concept"], "left")
    return j.withColumn("zone", F.when(F.col("_z"), "keep").when(F.col("_z").isNotNull(), "move").otherwise(F.col("state"))).drop("_z")


def family_hits(text) -> Column:
    """Array of (rank, family) for every family word in a text. The longer name counts: a vice president is no president."""
    own = F.regexp_replace(tx.col(text), r"(?i)\bvice[\s-]+president", "VP")
    return F.array_compact(F.array(*[F.when(tx.has_term(own, terms), F.struct(F.lit(r).alias("rank"), F.lit(f).alias("family"))) for f, r, terms in cat.FAMILIES]))


def title_family(text) -> Column:
    """Highest-ranked family that a title names; null if none."""
    return F.array_max(family_hits(text))["family"]


def family_relation(a: Column, b: Column) -> Column:
    """``same``, ``near`` (a pair of the fixed table, either way round), ``far``, or null where a family is missing."""
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    near = pair.isin(*["|".join(sorted(p)) for p in cat.NEAR_PAIRS])
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("string")).when(a == b, "same").when(near, "near").otherwise("far")


def zone_catches(zone: DataFrame, families=None) -> DataFrame:
    """What the eye lands on: the highest-ranked title word, the first figure, the first open-ended date. ``zone``: doc_id, ix, text."""
    fam = families or family_hits
    best = F.array_max(fam("text"))
    fig = F.get(tx.figure_runs("text"), F.lit(0))
    return zone.groupBy("doc_id").agg(
        F.max(best)["family"].alias("title_family"), F.min_by(F.trim(fig), F.when(fig.isNotNull(), F.col("ix"))).alias("first_figure"),
        F.min(F.when(tx.has_term("text", tx.OPEN_WORDS), F.col("ix"))).alias("open_date_ix"))


def title_mismatch(headlines: DataFrame, targets: DataFrame, near: DataFrame) -> DataFrame:
    """Documents whose headline holds no family equal or near to the target's. ``headlines``: doc_id, family; ``targets``: doc_id, family."""
    pairs = near.select(F.col("a").alias("family"), F.col("b").alias("target")).unionByName(
        near.select(F.col("b").alias("family"), F.col("a").alias("target"))).unionByName(
        near.select(F.col("a").alias("family"), F.col("a").alias("target"))).unionByName(near.select(F.col("b").alias("family"), F.col("b").alias("target"))).distinct()
    ok = join_small(headlines, pairs, "family").select("doc_id", F.col("target").alias("family")).distinct()
    return targets.join(ok, ["doc_id", "family"], "left_anti")

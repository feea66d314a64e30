"""Row filters over listings and records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import contacts as ct
from dossierflow.functions import text as tx
from dossierflow.operators.scale import join_small, salted_join

# Title words that mark a rung.
JUNIOR_WORDS = ("assistant", "asst", "junior", "jr", "intern", "internship", "trainee", "graduate", "receptionist", "secretary",
                "clerk", "cashier", "waiter", "barista", "driver", "cleaner", "technician", "nurse", "teacher", "tutor")
LOWER_RUNG_WORDS = ("assistant", "asst", "junior", "jr", "intern", "internship", "trainee", "graduate", "coordinator", "secretary",
                    "receptionist")
SENIOR_WORDS = ("managing director", "general manager", "director", "head of", "chief", "ceo", "coo", "cfo", "cto", "cmo", "vp",
                "vice president", "country manager", "regional manager", "operations manager", "business unit", "geschäftsführer",
                "leiter", "leitung", "prokurist", "directeur", "directrice")
ROLE_STOP = ("of", "and", "the", "for", "in", "at", "to", "a", "an")


def clean_title(title, boards: list[str]) -> Column:
    """Cut a board name after a separator and a trailing "jobs in <place>"."""
    s = F.regexp_replace(tx.col(title), rf"(?i)\s*[|–—•-]\s*(?:{'|'.join(boards)}).*$", "")
    return tx.strip(F.regexp_replace(s, r"(?i)(?:^|\s)(?:jobs?|vacancy|vacancies|hiring|careers?)\s+in\s+[a-z\s,]+$", ""))


def strict_role(title, roles: list[tuple[str, list[str]]], junior=JUNIOR_WORDS) -> Column:
    """First wanted role with a whole-phrase synonym in the title, or whose significant words (two or more,
    singular or plural) all occur; NULL for junior titles or no role. With no wanted role the title passes."""
    p = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(tx.col(title)), r"[^\p{L}\p{N}&]+", " ")), F.lit(" "))
    if not roles:
        return F.when(~tx.has_term(title, junior), tx.col(title))
    out = F.when(tx.has_term(title, junior), F.lit(None).cast("string"))
    for role, phrases in roles:
        hit = F.lit(False)
        for phrase in phrases or [role]:
            hit = hit | F.contains(p, F.lit(f" {phrase.lower().strip()} "))
        significant = [w for w in role.lower().split() if len(w) >= 2 and w not in ROLE_STOP]
        if len(significant) >= 2:
            every = F.lit(True)
            for w in significant:
                every = every & (F.contains(p, F.lit(f" {w} ")) | F.contains(p, F.lit(f" {w}s ")))
            hit = hit | every
        out = out.when(hit, F.lit(role))
    return out


def loose_role(text, role: str) -> Column:
    """Every significant word starts a token, or at least two do when the role has two or more."""
    p = F.concat(F.lit(" "), F.regexp_replace(F.lower(tx.col(text)), r"[^\p{L}\p{N}&]+", " "), F.lit(" "))
    significant = [w for w in role.split() if len(w) >= 2 and w not in ROLE_STOP]
    if not significant:
        return F.lit(False)
    hits = sum((F.contains(p, F.lit(" " + w)).cast("int") for w in significant), F.lit(0))
    return (hits == len(significant)) | ((hits >= 2) if len(significant) >= 2 else F.lit(False))


def senior_only(df: DataFrame, title: str, words=SENIOR_WORDS) -> DataFrame:
    return df.where(tx.has_term(title, words))


def drop_lower_rung(df: DataFrame, title: str, words=LOWER_RUNG_WORDS) -> DataFrame:
    return df.where(~tx.has_term(title, words))


def language_gate(df: DataFrame, is_foreign: Column, lang: str, allowed: DataFrame) -> DataFrame:
    """Drop foreign-language rows unless their language is in ``allowed`` (one column, same name as ``lang``).

    The text is read before the join, so that it does not travel unless the caller keeps it, and a language, which many rows share, is dealt
    over slots. A null language is in no list."""
    marked = df.withColumn("_foreign", is_foreign)
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    listed = allowed.select(lang).distinct().withColumn("_ok", F.lit(True))
    out = salted_join(marked, listed, [lang], F.struct(*[F.col(f"`{c}`") for c in plain]), how="left")
    return out.where(~F.col("_foreign") | F.col("_ok").isNotNull()).select(*[F.col(f"`{c}`") for c in [lang, *(c for c in df.columns if c != lang)]])


def region_gate(df: DataFrame, title: str, place: str, host: str, wanted: str, elsewhere: list[str], region_words: list[str],
                region_hosts: str, region_name: str) -> DataFrame:
    """Drop titles that name another region and not the wanted one; label the rest exact, region or host."""
    hay = F.lower(F.concat_ws(" ", title, place))
    inside = tx.has_term(title, region_words)
    out = df.where(~(tx.has_term(title, elsewhere) & ~inside & ~F.contains(hay, F.lit(wanted))))
    return out.withColumn("region", F.when(F.contains(hay, F.lit(wanted)), F.lit(wanted))
                          .when(tx.has_term(F.concat_ws(" ", title, place), region_words), F.lit(region_name))
                          .when(F.col(host).rlike(region_hosts), F.lit("host")).otherwise(F.lit("")))


def quarantine(df: DataFrame, rules: dict[str, Column], fatal: set[str]) -> DataFrame:
    """Check every field rule; ``errors`` lists the rules that fail and ``kept`` is false when a fatal one does."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    out = df.withColumn("errors", errors)
    return out.withColumn("kept", ~F.arrays_overlap("errors", F.array(*[F.lit(f) for f in sorted(fatal)])))


def email_filter(df: DataFrame, text: str, junk_host: str = ct.JUNK_HOST) -> DataFrame:
    """One row per usable address of a text."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(F.filter(ct.emails(text), lambda e: ct.is_usable_email(e, junk_host))).alias("email"))


def audience_filter(df: DataFrame, audience: DataFrame, markets: list[str], langs: list[str]) -> DataFrame:
    """Keep sources whose market and language demand fit the profile; ``audience``: source, market, lang ('' for none)."""
    fit = audience.where(F.col("market").isin(*markets) & ((F.col("lang") == "") | F.col("lang").isin(*langs))).select("source").distinct()
    return join_small(df, fit, "source", "left_semi")

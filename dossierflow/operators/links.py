"""Linking texts to records, lines to lines, claims to evidence. Every join has an equi key."""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as tx
from dossierflow.operators.lexicon import concept_occurrences, word_gram_keys
from dossierflow.operators.scale import bucketed_rank, join_small, keep_first, top_k

# Function words left out when words follow a figure or a line is traced.
FIGURE_STOP = ("the", "a", "an", "and", "of", "in", "for", "to", "with", "und", "der", "die", "das", "mit", "von", "für", "im",
               "over", "across")
TRACE_FREE = ("the", "a", "an", "and", "of", "in", "for", "to", "with", "on", "at", "by", "from", "as", "its", "their", "und", "der",
              "die", "das", "mit", "für", "von", "im", "zu", "bei", "den", "dem", "ein", "eine", "einer")


def whole_phrase(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, key_words: int = 5) -> DataFrame:
    """(text_id, phrase_id) where the phrase's words occur in the text in one run.

    Block on the phrase's first ``key_words`` words as an n-gram (shorter phrases on all of theirs), verify after. One pass over
    the texts makes the n-grams of every length that a phrase has, keyed by length and hash."""
    p = phrases.select(phrase_id, tx.words(phrase).alias("_w")).where(F.size("_w") > 0).select(
        phrase_id, F.array_join("_w", " ").alias("_p"), F.xxhash64(F.least(F.size("_w"), F.lit(key_words)), F.slice("_w", 1, key_words)).alias("form"))
    body = texts.select(text_id, tx.norm(text).alias("_t"))
    lengths = phrases.select(F.collect_set(F.least(F.size(tx.words(phrase)), F.lit(key_words)))).scalar()
    cut = texts.select(text_id, tx.words(text).alias("_w"), lengths.alias("_n"))
    grams = word_gram_keys(F.col("_w"), key_words, lambda n: F.array_contains("_n", F.lit(n)))
    spread = cut.select(text_id, F.explode(grams).alias("form"))
    out = join_small(spread, p, "form").select(text_id, phrase_id, "_p")
    inside = F.contains(F.concat(F.lit(" "), "_t", F.lit(" ")), F.concat(F.lit(" "), "_p", F.lit(" ")))
    return out.join(body, text_id).where(inside).select(text_id, phrase_id)


def words_overlap(texts: DataFrame, text_id: str, text: str, records: DataFrame, record_id: str, words: str, percent: int) -> DataFrame:
    """(text_id, record_id) where at least ``percent`` of the record's words occur in the text.

    Prefix filter: a text that holds p percent of n words must hold one of the record's n - ceil(pn) + 1 rarest
    words, so only those words make candidates; the share is verified on the word arrays."""
    n = F.size(words)
    need = F.ceil(n * percent / 100)
    each = records.select(record_id, words, need.alias("_need"), F.explode(words).alias("_w"))
    freq = each.groupBy("_w").agg(F.count(F.lit(1)).alias("_f"))
    rare = each.join(freq, "_w").groupBy(record_id, words, "_need").agg(F.array_sort(F.collect_list(F.struct("_f", "_w"))).alias("_r"))
    keys = rare.select(record_id, F.explode(F.slice("_r", 1, F.size(words) - F.col("_need").cast("int") + 1)).alias("_k")).select(
        record_id, F.col("_k._w").alias("_w"))
    tokens = texts.select(text_id, F.explode(F.array_distinct(tx.words(text))).alias("_w"))
    cand = join_small(tokens, keys, "_w").select(text_id, record_id).distinct()
    full = join_small(cand, rare.select(record_id, words, "_need"), record_id).join(
        texts.select(text_id, F.array_distinct(tx.words(text)).alias("_tw")), text_id)
    return full.where(F.size(F.array_intersect(words, "_tw")) >= F.col("_need")).select(text_id, record_id)


# Words that are no part of a firm's name, words that name no one firm, words that are no part of a role, and the domains
# of free mail and of recruiting systems, which say nothing of the firm.
COMPANY_NOISE = ("llc", "l l c", "fz llc", "fzllc", "fze", "fzco", "dmcc", "gmbh", "ag", "kg", "se", "ltd", "limited", "plc", "inc", "co", "company", "group", "holding", "holdings",
                 "international", "the", "and", "of", "uae", "dubai", "middle east", "mena")
GENERIC_COMPANY = ("emirates", "emirati", "gulf", "arabian", "arabia", "arab", "national", "global", "united", "general", "properties", "property", "services", "solutions",
                   "trading", "investments", "investment", "capital", "partners", "consulting", "consultants", "development", "developments", "real", "estate", "bank", "hotels",
                   "hotel", "resorts", "retail", "energy", "media", "technology", "technologies", "industries", "industrial", "logistics", "construction")
ROLE_STOP = ("senior", "junior", "head", "lead", "manager", "director", "officer", "assistant", "associate", "executive", "specialist", "application", "speculative",
             "bewerbung", "initiativbewerbung", "with", "and", "for", "the")
SIGNAL_POINTS = {"ref": 100, "thread": 90, "subject": 70, "shared subject": 20, "domain": 40, "recruiting system": 30, "company": 25, "role": 20}


def company_key(name) -> Column:
    """A firm's name without legal forms and words that any firm may carry."""
    plain = F.regexp_replace(F.lower(tx.col(name)), r"[^\p{L}\p{N} ]+", " ")
    noise = "|".join(sorted(COMPANY_NOISE, key=len, reverse=True))
    return tx.squeeze(F.regexp_replace(plain, rf"\b(?:{noise})\b", " "))


def own_words(key: Column) -> Column:
    """Words of a company key that are its own: three letters or more, not generic."""
    return F.filter(F.split(key, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_COMPANY))


def company_hits(messages: DataFrame, message: str, text: str, domain: str, records: DataFrame, record: str, company: str) -> DataFrame:
    """(message, record) where the firm stands in the text as whole words, or as a label of the sender's domain. Firms with generic words
    only prove nothing. A single own word counts in the text from five letters on."""
    named = records.select(record, company_key(company).alias("_k")).withColumn("_own", own_words(F.col("_k"))).where(F.size("_own") > 0)
    joined = F.array_join("_own", " ")
    whole = F.array_distinct(F.array_compact(F.array("_k", F.when((F.size("_own") >= 2) | (F.length(F.get("_own", F.lit(0))) >= 5), joined))))
    phrases = named.select(record, F.explode(whole).alias("_p")).withColumn("_id", F.concat_ws("|", F.col(record).cast("string"), "_p"))
    inside = whole_phrase(messages, message, text, phrases, "_id", "_p").join(phrases, "_id").select(message, record)
    labels = messages.select(message, F.explode(F.array_distinct(F.split(F.lower(domain), "[.-]"))).alias("_l")).where("_l <> ''")
    own = F.array_union(F.array(F.regexp_replace("_k", " ", ""), F.array_join("_own", "")), F.filter("_own", lambda w: F.length(w) >= 5))
    by_label = labels.join(named.select(record, F.explode(F.array_distinct(own)).alias("_l")), "_l").select(message, record)
    return inside.unionByName(by_label).distinct()


def same_organisation(messages: DataFrame, message: str, domain: str, records: DataFrame, record: str, record_domain: str,
                      carried: tuple[str, str] | None = None, keep: Column | None = None) -> DataFrame:
    """(message, record) where one domain is the other or lies below it: each side's parents meet the other side by equality. ``keep`` is a test
    of a pair on the two ``carried`` columns, one of each side."""
    def parents(c) -> Column:
        parts = F.split(F.lower(tx.col(c)), r"\.")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    mc, rc = ([c] for c in carried) if carried else ([], [])
    keep = F.lit(True) if keep is None else keep
    m = messages.where(F.coalesce(domain, F.lit("")) != "").select(message, *mc, F.lower(domain).alias("_d"), parents(domain).alias("_up"))
    r = records.where(F.coalesce(record_domain, F.lit("")) != "").select(record, *rc, F.lower(record_domain).alias("_e"), parents(record_domain).alias("_rup"))
    down = m.select(message, *mc, F.explode("_up").alias("_e")).join(r.select(record, *rc, "_e"), "_e").where(keep).select(message, record)
    up = m.select(message, *mc, "_d").join(r.select(record, *rc, F.explode("_rup").alias("_d")), "_d").where(keep).select(message, record)
    return down.unionByName(up).distinct()


def message_signals(messages: DataFrame, records: DataFrame, shared_domain: str, recruiting: str) -> DataFrame:
    """Score and reasons of every (message_id, record_id) with a signal.

    ``messages``: message_id, subject, text, from_domain, threads (ids it answers), at; ``records``: record_id, ref, subject, domain, company,
    role, msg_ids, since. A record begun more than a day after the message is never its match. ``shared_domain`` and ``recruiting`` are
    patterns of domains that many firms share."""
    m, r = "message_id", "record_id"
    # Dates part most pairs before they are gathered: a record (its rows of one id together) begun more than a day after the newest message is
    # nobody's match, and subjects and domains, which many share, make only pairs that some row of the message's id may keep. All records
    # count where a shared subject is told from one record's own.
    early = lambda begun, at: ~F.coalesce(at < begun - F.expr("INTERVAL 1 DAY"), F.lit(False))
    known = lambda c, pick: F.when(F.count(F.lit(1)) == F.count(c), pick(c))
    newest = messages.agg(known("at", F.max)).scalar()
    begun = records.groupBy(F.col(r).alias("_id")).agg(known("since", F.min).alias("_begun"))
    every, records = records, records.join(begun.where(early(F.col("_begun"), newest)), F.col(r) == F.col("_id")).drop("_id")
    last = messages.groupBy(F.col(m).alias("_id")).agg(known("at", F.max).alias("_last"))
    messages = messages.join(last, F.col(m) == F.col("_id")).drop("_id")
    may = early(F.col("_begun"), F.col("_last"))
    body = messages.select(m, F.concat_ws("\n", "subject", "text").alias("_body"), "from_domain")
    refs = whole_phrase(body, m, "_body", records.where(F.trim(F.coalesce("ref", F.lit(""))) != "").select(r, "ref"), r, "ref")
    threads = messages.select(m, F.explode("threads").alias("_t")).join(records.select(r, F.explode("msg_ids").alias("_t")), "_t").select(m, r)
    subject = tx.squeeze(F.lower(F.regexp_replace("subject", r"[\s—–-]+", " ")))
    sent = records.select(r, "_begun", subject.alias("_s")).where("_s <> ''")
    counts = every.select(subject.alias("_s")).where("_s <> ''").groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    words = F.split(subject, " ")
    # the message's subject is the record's, or ends in it after a blank
    tails = messages.select(m, "_last", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("_s"))
    same = tails.join(sent.join(counts, "_s"), "_s").where(may).select(m, r, "_n")
    company = company_hits(body, m, "_body", "from_domain", records, r, "company")
    orgs = same_organisation(messages.where(~F.lower("from_domain").rlike(shared_domain) & ~F.lower("from_domain").rlike(recruiting)), m, "from_domain", records, r, "domain", ("_last", "_begun"), may)
    systems = company.join(messages.where(F.lower("from_domain").rlike(recruiting)).select(m), m).join(orgs, [m, r], "left_anti")
    role = F.array_distinct(F.filter(tx.words("role"), lambda w: (F.length(w) >= 4) & ~w.isin(*ROLE_STOP)))
    roles = words_overlap(body, m, "_body", records.select(r, role.alias("role_words")).where(F.size("role_words") > 0), r, "role_words", 60)
    p = {k: F.lit(v) for k, v in SIGNAL_POINTS.items()}
    scored = evidence_scores([("ref", refs, p["ref"]), ("thread", threads, p["thread"]), ("subject", same.where("_n = 1"), p["subject"]),
                              ("shared subject", same.where("_n > 1"), p["shared subject"]), ("domain", orgs, p["domain"]),
                              ("recruiting system", systems, p["recruiting system"]), ("company", company, p["company"]), ("role", roles, p["role"])], m, r, (m,))
    # dealt by message, the pairs stay where they are for its dates
    dated = scored.join(messages.select(m, "at"), m).join(records.select(r, "since"), r)
    late = F.coalesce(F.col("at") < F.col("since") - F.expr("INTERVAL 1 DAY"), F.lit(False))
    return dated.where(~late).select(m, r, "score", "signals")


def evidence_scores(signals: list[tuple[str, DataFrame, Column]], message: str, record: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of signals (name, pairs, points) to one scored row per (message, record). ``by``: the part of the key that the pairs are dealt by, where
    what follows joins on it and it is never null."""
    rows, names = None, sorted({name for name, _, _ in signals})
    for name, pairs, points in signals:
        # the pairs are the bulk of the shuffle: a signal travels as its number
        part = pairs.select(message, record, points.cast("int").alias("points"), F.lit(names.index(name)).cast("byte").alias("signal"))
        rows = part if rows is None else rows.unionByName(part)
    # one shuffle: the distinct rows and their sums stay where the pairs are
    rows = rows.repartition(*(by or (message, record))).distinct()
    seen = [F.max(F.col("signal") == i).alias(f"_n{i}") for i, name in enumerate(names)]
    sums = rows.groupBy(message, record).agg(F.sum("points").cast("int").alias("score"), *seen)
    return sums.select(message, record, "score", F.concat_ws("+", *[F.when(F.col(f"_n{i}"), F.lit(name)) for i, name in enumerate(names)]).alias("signals"))


def top_two_margin(scored: DataFrame, message: str, record: str) -> DataFrame:
    """Best record per message and its lead over the runner-up."""
    two = top_k(scored, [message], [F.col("score").desc(), F.col(record)], 2)
    best = lambda c: F.max(F.when(F.col("rk") == 1, F.col(c)))
    return two.groupBy(message).agg(best(record).alias(record), best("score").alias("score"), best("signals").alias("signals"),
                                    (best("score") - F.coalesce(F.max(F.when(F.col("rk") == 2, F.col("score"))), F.lit(0))).alias("lead"))


def link_decision(best: DataFrame, apply_at: int = 60, lead: int = 20, suggest_at: int = 35) -> DataFrame:
    return best.withColumn("decision", F.when((F.col("score") >= apply_at) & (F.col("lead") >= lead), "auto")
                           .when(F.col("score") >= suggest_at, "suggested").otherwise("unmatched"))


def requirement_evidence(lines: DataFrame, doc: str, lexicon: DataFrame) -> DataFrame:
    """First line per (document, concept) in reading order; ``lines``: doc, kind_rank, line_ix, line."""
    occ = concept_occurrences(lines, [doc, "kind_rank", "line_ix"], "line", lexicon)
    return (occ.groupBy(doc, "concept").agg(F.min(F.struct("kind_rank", "line_ix")).alias("_b"))
            .select(doc, "concept", F.col("_b.kind_rank").alias("kind_rank"), F.col("_b.line_ix").alias("line_ix")))


def missing_evidence(skills: DataFrame, tokens: DataFrame, skill: str = "concept") -> DataFrame:
    """Skills no token supports, in the exact form or by stem."""
    seen = tokens.select(tx.stem("token").alias("_s")).distinct()
    return skills.withColumn("_s", tx.stem(skill)).join(seen, "_s", "left_anti").drop("_s")


#: Zeros that a unit of scale stands for (fixed values).
SCALES = {"k": 3, "m": 6, "mn": 6, "mio": 6, "million": 6, "bn": 9, "mrd": 9}


def figures(c) -> Column:
    """Array of (value, unit, next): every number not glued to a letter, its unit and the stems of the next two words. A number with a unit of
    scale is written out: 1.5m and 1,500,000 have the same value."""
    scales = F.create_map(*[F.lit(x) for word, n in SCALES.items() for x in (word, n)])
    marked = F.regexp_replace(F.concat(F.lit(" "), tx.fold_digits(c)), r"([^\p{L}0-9,.])([0-9])", "$1\u0001$2")
    chunks = F.slice(F.split(marked, "\u0001"), 2, 2_000_000_000)

    def read(ch: Column) -> Column:
        printed = F.regexp_replace(F.regexp_extract(ch, r"^([0-9][0-9,.]*)", 1), r"[,.]+$", "")
        unit = F.lower(F.regexp_extract(ch, r"(?i)^[0-9][0-9,.]*\s?(%|(?:k|mn|m|bn|mio|mrd|million)(?:[^\p{L}]|$))", 1))
        rest = F.filter(tx.letter_words(F.regexp_replace(ch, r"^[0-9][0-9,.]*", "")), lambda w: ~w.isin(*FIGURE_STOP))
        digits, zeros = F.regexp_replace(printed, r"[,.]", ""), F.coalesce(F.try_element_at(scales, F.regexp_extract(unit, r"^([a-z]+)", 1)), F.lit(0))
        decimals = F.length(F.regexp_extract(printed, r"[,.]([0-9]{1,2})$", 1))
        value = F.when(zeros > 0, F.regexp_replace(F.concat(digits, F.repeat(F.lit("0"), zeros - decimals)), r"^0+([0-9])", "$1")).otherwise(digits)
        return F.struct(value.alias("value"), F.trim(unit).alias("unit"), F.transform(F.slice(rest, 1, 2), tx.stem).alias("next"),
                        F.regexp_extract(ch, r"^[0-9][0-9,.]*(\p{L}?)", 1).alias("glued"))

    return F.filter(F.transform(chunks, read), lambda f: ((f["glued"] == "") | (f["unit"] != "")) & ~f["value"].rlike(r"^(?:19[5-9]\d|20[0-3]\d)$"))


def orphan_numbers(claims: DataFrame, sources: DataFrame, doc: str) -> DataFrame:
    """Figures of a claim that no source line of the same document carries before the same word.
    A figure with its unit needs the value only. ``claims``/``sources``: doc, ..., text."""
    keep = [c for c in claims.columns if c != "text"]
    c = claims.select(*keep, F.posexplode(figures("text")).alias("ix", "f")).select(*keep, "ix", "f.value", "f.unit", F.col("f.next").alias("next"))
    s = sources.select(F.col(doc).alias("_d"), F.explode(figures("text")).alias("f")).select(
        "_d", F.col("f.value").alias("_v"), F.col("f.next").alias("_next"))
    same = (F.col(doc) == F.col("_d")) & (F.col("value") == F.col("_v")) & ((F.col("unit") != "") | F.arrays_overlap("next", "_next"))
    return c.join(s, same, "left_anti")


def orphan_places(claims: DataFrame, lines: DataFrame, alias: DataFrame, members: DataFrame, owner: str) -> DataFrame:
    """Claims whose place (a country, or any country of a region) no line of the same owner names.

    ``claims``: owner, claim_id, place; ``lines``: owner, place; ``alias``: place, country, meta; ``members``: meta, country."""
    def countries(df: DataFrame) -> DataFrame:
        named = join_small(df, alias, "place")
        direct = named.where(F.col("country").isNotNull()).drop("meta")
        group = join_small(named.where(F.col("meta").isNotNull()).drop("country"), members, "meta").drop("meta")
        return direct.unionByName(group)

    proof = countries(lines).select(owner, "country").distinct()
    proven = countries(claims).join(proof, [owner, "country"], "left_semi").select("claim_id").distinct()
    return claims.join(proven, "claim_id", "left_anti")


def near_duplicate_lines(lines: DataFrame, doc: str, ix: str, line: str) -> DataFrame:
    """Per line, the first earlier line of the document that is the same (``exact``) or shares 80% of its long words (``near``).

    The lines of a document are gathered once and compared there. Same lines are folded first; near ones meet through a prefix filter on the
    document's rarest words, and each line reports one partner, so a document of copies stays linear. Lines without a document or a position
    have no partner."""
    types = {c: lines.schema[c].dataType for c in (doc, ix)}
    rows = lines.select(doc, F.col(ix).cast("long").alias("ix"), tx.norm(line).alias("n")).where(F.col(doc).isNotNull() & F.col(ix).isNotNull())
    held = rows.groupBy(doc).agg(F.collect_list(F.struct("ix", "n")).alias("r"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repeats_among([(x["ix"], x["n"]) for x in r]) for r in batch.column(1).to_pylist()]
            flat = [r for rows in found for r in rows]
            owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
            columns = [pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], names=[doc, "line_ix", "partner_ix", "kind"])

    out = held.mapInArrow(find, f"`{doc}` {types[doc].simpleString()}, line_ix bigint, partner_ix bigint, kind string")
    return out.select(doc, F.col("line_ix").cast(types[ix]).alias("line_ix"), F.col("partner_ix").cast(types[ix]).alias("partner_ix"), "kind")


LETTERS = regex.compile(r"\p{L}+")


def repeats_of(lines: list[str]) -> list[tuple[int, int, str]]:
    """``(line, partner, kind)`` of the normalised lines of one document that repeat an earlier one."""
    return repeats_among(list(enumerate(lines)))


def repeats_among(lines: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """``(line, partner, kind)`` of the numbered normalised lines of one document that repeat an earlier one; different lines of one number
    count as one line with the words of all.

    A line that differs meets others under the words of its prefix, its rarest words in the document first; of two lines with 80% of their words
    in common some prefix word is shared. The earliest partner is enough, so a candidate list is left at its first hit."""
    first: dict[str, int] = {}
    for i, line in lines:
        if line and first.get(line, i) >= i:
            first[line] = i
    out = [(i, first[line], "exact") for i, line in lines if line and first[line] < i]
    bags: dict[int, list[str]] = {}
    for line, i in first.items():
        words = {w for w in LETTERS.findall(line) if len(w) >= 4}
        if len(words) >= 5:
            bags.setdefault(i, []).extend(words)
    count = Counter(w for words in bags.values() for w in words)
    held: dict[str, list[int]] = {}
    sets = {i: set(words) for i, words in bags.items()}
    for i in sorted(bags):
        words, n = sets[i], len(bags[i])
        prefix = sorted(bags[i], key=lambda w: (count[w], w))[:n - -(-n * 8 // 10) + 1]
        near = sorted({j for w in prefix for j in held.get(w, ()) if 10 * min(n, len(bags[j])) >= 8 * max(n, len(bags[j]))})
        for j in near:
            shared = len(words & sets[j])
            if 10 * shared >= 8 * (n + len(bags[j]) - shared):
                out.append((i, j, "near"))
                break
        for w in set(prefix):
            if count[w] > 1:
                held.setdefault(w, []).append(i)
    return out


def repeated_lines(docs: DataFrame, doc: str, lines: str) -> DataFrame:
    """``doc, line_ix, partner_ix, kind`` as ``near_duplicate_lines`` gives them, where the lines of a document are an array in its row: no
    shuffle, one Arrow batch of rows at a time."""
    kind = docs.schema[doc].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repeats_of(x or []) for x in batch.column(1).to_pylist()]
            flat = [r for rows in found for r in rows]
            owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
            columns = [pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], names=[doc, "line_ix", "partner_ix", "kind"])

    rows = docs.select(doc, F.transform(lines, tx.norm).alias("n"))
    return rows.mapInArrow(find, f"`{doc}` {kind}, line_ix int, partner_ix int, kind string")


def contained_lines(long: DataFrame, long_id: list[str], text: str, short: DataFrame, short_id: list[str], other: str,
                    key_words: int = 4, min_chars: int = 40) -> DataFrame:
    """Pairs of lines that are the same duty: equal, or one wholly inside the other (both of 40 characters or more).

    Blocks on the contained line's first words as an n-gram of the other, by length and hash; equal lines and both directions are one
    pass over each side and one shuffle join, whatever the sizes of the sides."""
    def keyed(df: DataFrame, ids: list[str], line: str, c: str, own: int, inner: int) -> DataFrame:
        """A row per key that a line is met under: itself (0), its n-grams as the outer line (``own``), its first words as the inner one."""
        rows = df.select(*ids, tx.norm(line).alias(c))
        is_long, none = F.length(c) >= min_chars, F.array().cast("array<bigint>")
        # a run of fewer words is met only by a line that has no more, so one of its words is as long as such a line demands
        may = lambda n: F.lit(True) if n == key_words else F.col(c).rlike(f"[^ ]{{{max(1, -(-(min_chars - n + 1) // n))}}}")
        grams = F.when(is_long, tx.let(F.split(c, " "), lambda w: word_gram_keys(w, key_words, may))).otherwise(none)
        words = F.split(c, " ", key_words + 1)
        first = F.when(is_long, F.array(F.xxhash64(F.least(F.size(words), F.lit(key_words)), F.slice(words, 1, key_words)))).otherwise(none)
        side = lambda keys, kind: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("form")))
        every = F.concat(side(F.array(F.xxhash64(c)), 0), side(grams, own), side(first, inner))
        return rows.select(*ids, c, F.explode(F.when(F.col(c) != "", every)).alias("_key")).select(*ids, c, "_key.kind", "_key.form")

    a, b = keyed(long, long_id, text, "_a", 1, 2), keyed(short, short_id, other, "_b", 2, 1)
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    same = (F.when(F.col("kind") == 0, F.col("_a") == F.col("_b")).when(F.col("kind") == 1, F.contains(spaced("_a"), spaced("_b")))
            .otherwise(F.contains(spaced("_b"), spaced("_a"))))
    return a.join(b, ["kind", "form"]).where(same).select(*long_id, *short_id).distinct()


def resolve_same_role(a: DataFrame, b: DataFrame, keys: list[str], title: str) -> DataFrame:
    """One-to-one match of two role lists: same keys and title in stored order first, then the only one left on
    both sides of a key. Both passes compare counts or ordinals, never all pairs of a key.

    ``a``: keys, title, a_id; ``b``: keys, title, b_id."""
    full = keys + [title]
    ra = bucketed_rank(a, full, F.floor(F.col("a_id") / 65536), [F.col("a_id")], "_n")
    rb = bucketed_rank(b, full, F.floor(F.col("b_id") / 65536), [F.col("b_id")], "_n")
    one = ra.join(rb, full + ["_n"]).select("a_id", "b_id", F.lit("title").alias("pass"))
    rest_a = a.join(one, "a_id", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("_ca"), F.min("a_id").alias("a_id"))
    all_b = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cb"), F.min("b_id").alias("b_id"))
    two = (rest_a.join(all_b, keys).where("_ca = 1 AND _cb = 1").join(one.select("b_id"), "b_id", "left_anti")
           .select("a_id", "b_id", F.lit("only").alias("pass")))
    return one.unionByName(two)


def traced(lines: list[tuple], pool: list[tuple], free: frozenset) -> list[tuple]:
    """``(line_ix, pool_ix, shared, n_added)`` of one document's lines (number, words, their stems) against its pool lines (number, different stems).
    Lines of one number count together; each meets every pool line of the best number."""
    holds, at = defaultdict(list), defaultdict(list)
    wanted = {s for _, _, stems in lines for s in stems or ()}
    for ix, stems in pool:
        for s in wanted.intersection(stems or ()):
            holds[s].append((ix, len(stems)))
        at[ix].append(stems or ())
    shared = defaultdict(Counter)
    for ix, _, stems in lines:
        for s in stems or ():
            if s in holds:
                shared[ix].update(holds[s])
    best = {ix: min(found.items(), key=lambda f: (-f[1], f[0][1], f[0][0] is not None, f[0][0])) for ix, found in shared.items() if ix is not None}
    out = []
    for ix, words, stems in lines:
        (pool_ix, _), n = best.get(ix, ((None, 0), 0))
        own = None if words is None else [s for w, s in zip(words[1:], stems[1:]) if w not in free]
        for have in at[pool_ix] if pool_ix is not None else ((),):
            out.append((ix, pool_ix, n, None if own is None else len(own) - sum(map(set(have).__contains__, own))))
    return out


def trace_source(lines: DataFrame, pool: DataFrame, doc: str) -> DataFrame:
    """Per line, the pool line of the same document that shares most stems (then fewest stems, then first), the number
    shared, and the words of the line it does not hold (the first word and small words are free).

    ``lines``: doc, line_ix, line; ``pool``: doc, pool_ix, pool_line. The stems of a document's lines are made once and gathered; there each
    stem leads to the pool lines that hold it, so only lines that share one are counted."""
    stems = lambda c: F.transform(tx.words(c), tx.stem)
    # rows without a document meet no other; they are dealt out
    lone = F.when(F.col(doc).isNull(), F.xxhash64("line_ix", "line")).alias("_lone")
    a = lines.select(doc, lone, "line_ix", tx.words("line").alias("w")).select(doc, "_lone", F.struct("line_ix", "w", F.transform("w", tx.stem).alias("s")).alias("l"))
    b = pool.where(F.col(doc).isNotNull()).select(doc, F.lit(None).cast("long").alias("_lone"), F.struct("pool_ix", F.array_distinct(stems("pool_line")).alias("s")).alias("p"))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(doc, "_lone").agg(F.collect_list("l").alias("ls"), F.collect_list("p").alias("ps")).where(F.size("ls") > 0)
    free = frozenset(TRACE_FREE)

    def rows(column: pa.ListArray) -> Iterator[list[tuple]]:
        """The structs of every list, as tuples."""
        each = zip(*(c.to_pylist() for c in column.flatten().flatten()))
        return (list(islice(each, n)) for n in pc.list_value_length(column).to_pylist())

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owner = [], []
            for i, (ls, ps) in enumerate(zip(rows(batch.column(2)), rows(batch.column(3)))):
                found = traced(ls, ps, free)
                out += found
                owner += [i] * len(found)
            inner = [batch.column(c).type.value_type.field(0).type for c in (2, 3)]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((*inner, pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *cols], names=names)

    names = [doc, "line_ix", "pool_ix", "shared", "n_added"]
    kinds = {n: df.schema[n].dataType for n, df in ((doc, lines), ("line_ix", lines), ("pool_ix", pool))}
    types = ", ".join(f"`{n}` {kinds[n].simpleString() if n in kinds else 'int'}" for n in names)
    return both.mapInArrow(trace, types)


def subset_items(items: DataFrame, item: str, stop: tuple[str, ...] = ("and", "und")) -> DataFrame:
    """Items whose significant words all occur in another item: the number of such items and the first of them.

    Items are folded to distinct word sets first; a set meets candidates only through its rarest word."""
    s = F.array_sort(F.array_distinct(F.filter(tx.letter_words(item), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))))
    sets = items.select(item, s.alias("s")).where(F.size("s") > 0).groupBy("s").agg(F.min(item).alias("name"))
    each = sets.select("s", "name", F.explode("s").alias("w"))
    freq = each.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    rare = keep_first(each.join(freq, "w"), ["s"], [F.col("f"), F.col("w")]).select(
        F.col("s").alias("sub"), F.col("name").alias("item"), "w")
    return (rare.join(each.select(F.col("s").alias("sup"), F.col("name").alias("other"), "w"), "w")
            .where((F.size("sup") > F.size("sub")) & (F.size(F.array_except("sub", "sup")) == 0))
            .groupBy("item").agg(F.count(F.lit(1)).alias("n_supersets"), F.min("other").alias("first_superset")))


def contradictions(claims: DataFrame, keys: list[str], kind: str, a: str, b: str, ident: str) -> DataFrame:
    """Keys stated at two incompatible levels, with the first claim of each: one aggregation, no self-join."""
    first = lambda v: F.min(F.when(F.col(kind) == v, F.col(ident)))
    return (claims.where(F.col(kind).isin(a, b)).groupBy(*keys).agg(first(a).alias("first_a"), first(b).alias("first_b"))
            .where("first_a IS NOT NULL AND first_b IS NOT NULL"))


def suggest_missing_tags(hits: DataFrame, tags: DataFrame, doc: str) -> DataFrame:
    """Concepts a document's lines prove that its own tags lack. ``hits``: doc, concept, n_hits; ``tags``: doc, concept."""
    return hits.join(tags, [doc, "concept"], "left_anti")


def apply_alias(rows: DataFrame, place: str, alias: DataFrame, alias_place: str, country: str, meta: str) -> DataFrame:
    """Rows with the country and the region that the alias table gives for their place."""
    return join_small(rows, alias.select(F.col(alias_place).alias(place), F.col(country).alias("country"), F.col(meta).alias("meta")), place)


def restriction_gate(requirements: DataFrame, admits: DataFrame, restriction: str, group: str, restricted: Column) -> DataFrame:
    """``state``: blocker where a restricted requirement does not admit the candidate's group, else info.

    ``requirements``: restriction, group, ...; ``admits``: the (restriction, group) pairs that are let in."""
    ok = join_small(requirements, admits.select(restriction, group).distinct().withColumn("_ok", F.lit(True)), [restriction, group], "left")
    return ok.withColumn("state", F.when(restricted & F.col("_ok").isNull(), "blocker").otherwise("info")).drop("_ok")


def language_level(requirements: DataFrame, held: DataFrame, language: str, need: str, level: str) -> DataFrame:
    """``proven``: the highest level held in the language reaches the one needed; unknown languages are not proven."""
    best = held.groupBy(language).agg(F.max(level).alias("_best"))
    return join_small(requirements, best, language, "left").withColumn("proven", F.coalesce(F.col("_best") >= F.col(need), F.lit(False))).drop("_best")

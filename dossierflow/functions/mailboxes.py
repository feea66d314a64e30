"""What a mailbox is for, and addresses printed next to a request to apply."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.contacts import EMAIL
from dossierflow.functions.text import col, has_term, let, squeeze

# Mailbox words by kind, places, given names, words of a request to apply and of notices.
STRONG = ("career careers karriere carriere carrieres job jobs recruit recruiting recruitment recruiter recruiters talent talents hiring hire vacancy "
          "vacancies bewerbung bewerbungen stellen stelle emploi emplois empleo recrutement candidat candidature candidatures cvs resume resumes apply "
          "application applications employment join opportunities cv ta candidate candidates candidatures recruits rrhh seleccion tawdheef tawzeef tawzif "
          "trabajo wadhaif wazaif wazayef").split()
WEAK = "hr hrd people personal personnel personalabteilung humanresources".split()
NEVER = ("press presse media news marketing sales vertrieb ventas support help helpdesk service services billing invoice invoices rechnung accounts "
         "account accounting finance security legal compliance fraud investor investors webmaster event events partner partners procurement purchasing "
         "einkauf complaint complaints newsletter booking bookings reservation reservations tender tenders payroll feedback order orders shop store returns "
         "care pr ir").split()
PLACE = ("dubai uae abudhabi auh dxb sharjah ajman ksa saudi riyadh jeddah qatar doha bahrain kuwait oman muscat gcc mena emea africa asia europe london "
         "germany deutschland berlin munich hamburg frankfurt austria wien vienna zurich switzerland egypt cairo jordan amman lebanon beirut india mumbai "
         "pakistan usa america france paris spain madrid italy milan ae sa de at ch uk us eu abu dhabi shj rak fujairah alain ruh jed dammam khobar middleeast "
         "middle east muenchen koeln cologne duesseldorf stuttgart zuerich geneva karachi delhi bh eg in jo kw lb me om qa").split()
NEUTRAL = ("info information contact contacts hello mail office admin administration enquiries enquiry inquiries inquiry reception general team the our with "
           "and for work dept department desk head group global international local regional central main online digital corporate corp customer customers "
           "client clients tech technical it us acquisition after all angebote culture human intl kunden post pre relations resources staff web").split()
GIVEN = "jordan paris milan india vienna geneva alain jed doha riyadh london".split()
REQUEST = ("cv", "resume", "résumé", "apply", "application", "applications", "bewerbung", "lebenslauf", "candidature", "postuler", "curriculum", "solicitud")
REQUEST_WIDE = REQUEST + ("send", "submit", "email your", "enviar")
NOTICE = r"(?i)\b(?:accommodat\w*|reasonable adjustments?|disabilit\w*|fraud\w*|scam\w*|phishing|impersonat\w*|press|media enquir\w*)\b"

# Words of two letters that also stand inside a compound; phrases that are a box by themselves, by kind; labels of a domain that name no firm.
IN_COMPOUND = ("hr", "it", "us")
PHRASES = {"strong": ("joinus", "jointheteam", "joinourteam", "workwithus", "workforus"), "weak": ("humanresources", "peopleandculture")}
NO_FIRM = ("com", "net", "org", "www", "gov", "edu")
#: Kinds as bits; the longest known word; the longest name of a mailbox.
KIND_BITS = {"strong": 1, "weak": 2, "never": 4, "other": 8}
VOCABULARY = {**{w: "other" for w in (*NEUTRAL, *PLACE)}, **{w: "never" for w in NEVER}, **{w: "weak" for w in WEAK}, **{w: "strong" for w in STRONG}}
LONGEST, LOCAL_MAX = max(map(len, (*VOCABULARY, *sum(PHRASES.values(), ())))), 64


def segmented(part: Column, own: Column, vocabulary: dict[str, str] = VOCABULARY) -> Column:
    """The kinds (``KIND_BITS``, or 0 for digits and own words) of the known words that a part of a mailbox's name is made of, or -1 if it is not
    made of them. Word break from left to right: a place is reached by the first reached place that a known word leads from; ``own``
    (array) are further words. The work grows with the length of the part and of the longest word."""
    n, longest = F.length(part), max(LONGEST, *map(len, vocabulary))
    by_kind = {kind: [w for w, k in vocabulary.items() if k == kind] for kind in KIND_BITS}

    def bit(i: Column, j: Column) -> Column:
        w = F.substring(part, i + 1, j - i)
        digits = w.rlike("^[0-9]+$") & ~F.substring(part, j + 1, F.lit(1)).rlike("^[0-9]$")
        alone = (j - i != 2) | w.isin(*IN_COMPOUND) | ((i == 0) & (j == n))
        out = F.when(digits, 0).when((j - i >= 3) & F.array_contains(own, w), 0)
        for kind, words in by_kind.items():
            out = out.when(alone & w.isin(*words), KIND_BITS[kind])
        return out.otherwise(-1)

    def reach(states: Column, j: Column) -> Column:
        ways = F.transform(F.sequence(F.greatest(F.lit(0), j - longest), j - 1), lambda i: F.when(F.get(states, i) >= 0, F.struct(F.get(states, i).alias("s"), bit(i, j).alias("b"))))
        first = F.get(F.filter(ways, lambda x: F.coalesce(x["b"] >= 0, F.lit(False))), F.lit(0))
        return F.concat(states, F.array(F.coalesce(first["s"].bitwiseOR(first["b"]), F.lit(-1))))

    whole = F.when(part.isin(*PHRASES["strong"]), KIND_BITS["strong"]).when(part.isin(*PHRASES["weak"]), KIND_BITS["weak"])
    walked = F.get(F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), reach), n)
    return F.when(n > LOCAL_MAX, F.lit(-1)).otherwise(F.coalesce(whole, walked))


def clean_address(c) -> Column:
    """Address without trailing punctuation and without a sentence run into it (a capitalised word after a lower-case address)."""
    a = F.regexp_replace(col(c), r"[.,;:)\]]+$", "")
    run_in = a.rlike(r"^[^@A-Z]+@[^@A-Z]+\.[a-z]{2,}\.[A-Z][a-z]+$")
    return F.lower(F.when(run_in, F.regexp_replace(a, r"\.[A-Z][a-z]+$", "")).otherwise(a))


def mailbox_kind(address, vocabulary: dict[str, str] = VOCABULARY) -> Column:
    """apply, general or never, by cutting the parts of the local name into known words; the company's own name counts as one. A given name in
    front of others, a part that is not made of known words, or a name of over 64 characters makes it a person's (general)."""
    def judge(a: Column) -> Column:
        local, domain = F.split(a, "@")[0], F.coalesce(F.get(F.split(a, "@"), F.lit(1)), F.lit(""))
        own = F.filter(F.split(domain, r"\."), lambda l: (F.length(l) >= 3) & ~l.isin(*NO_FIRM))
        parts = F.filter(F.split(local, r"[._+-]+"), lambda p: p != "")
        kinds = lambda ps: F.transform(ps, lambda p: segmented(p, own, vocabulary))
        return let(F.struct(parts.alias("p"), kinds(parts).alias("k"), F.array_join(parts, "").alias("whole")), lambda x: verdict(x["p"], x["k"], x["whole"]))

    def verdict(parts: Column, kinds: Column, whole: Column) -> Column:
        has = lambda kind: F.exists(kinds, lambda k: k.bitwiseAND(KIND_BITS[kind]) != 0)
        first, several = F.get(parts, F.lit(0)), F.size(parts) > 1
        strong = has("strong") | whole.isin(*PHRASES["strong"])
        weak = has("weak") | F.greatest(*[F.contains(whole, F.lit(p)) for p in PHRASES["weak"]])
        return (F.when((F.size(parts) == 0) | (several & first.isin(*GIVEN)) | F.exists(kinds, lambda k: k < 0), "general")
                .when(strong, "apply").when(has("never"), F.when(weak | (several & first.isin(*PLACE)), "general").otherwise("never"))
                .when(weak, "apply").otherwise("general"))

    return let(F.lower(col(address)), judge)


def near_request(text) -> Column:
    """Array of (address, asks) per printed address: ``asks`` when its sentence, or for a recruiting mailbox also the one
    before, asks for an application and its own is no notice. Mailboxes never meant for applications are left out."""
    sents = F.filter(F.transform(F.split(col(text), r"\n\s*\n|(?<=[.!?])\s+"), squeeze), lambda s: s != "")

    def per(all_s: Column) -> Column:
        zipped = F.arrays_zip(all_s.alias("own"), F.concat(F.array(F.lit("")), all_s).alias("prev"))
        rows = F.flatten(F.transform(F.filter(zipped, lambda z: z["own"].isNotNull() & z["own"].contains("@")), lambda z: F.transform(
            F.regexp_extract_all(z["own"], F.lit(EMAIL), F.lit(0)), lambda m: F.struct(clean_address(m).alias("address"), z["own"].alias("own"), z["prev"].alias("prev")))))

        def verdict(r: Column) -> Column:
            kind = mailbox_kind(r["address"])
            asks = F.when(kind == "apply", has_term(F.concat_ws(" ", r["prev"], r["own"]), REQUEST_WIDE)).otherwise(has_term(r["own"], REQUEST))
            return F.struct(r["address"].alias("address"), kind.alias("kind"), (asks & ~r["own"].rlike(NOTICE)).alias("asks"))

        return F.filter(F.transform(rows, verdict), lambda r: r["kind"] != "never")

    return let(sents, per)

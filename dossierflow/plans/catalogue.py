"""Check catalogue and fixed rule tables of the document lint.

Fixed values: check ids with their usual severity and scoring part, gates, deferred checks, penalty steps, title
families with their nearness, and the word lists the rules read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Every check with its part and usual severity.
CHECKS = (
    ("HDR-01", "ats", "high"),
    ("HDR-02", "ats", "high"),
    ("HDR-03", "ats", "low"),
    ("HDR-04", "ats", "med"),
    ("HDR-05", "ats", "med"),
    ("HDR-06", "ats", "high"),
    ("HDR-07", "ats", "high"),
    ("HDR-08", "ats", "high"),
    ("HDR-09", "ats", "high"),
    ("HDR-10", "ats", "high"),
    ("HDR-11", "ats", "high"),
    ("HDR-12", "ats", "high"),
    ("EXP-01", "ats", "high"),
    ("EXP-02", "ats", "high"),
    ("EXP-03", "ats", "high"),
    ("EXP-04", "ats", "high"),
    ("EXP-10", "ats", "low"),
    ("BUL-08", "ats", "high"),
    ("REF-01", "ats", "high"),
    ("REF-03", "ats", "med"),
    ("MKT-03", "ats", "low"),
    ("ATS-01", "ats", "low"),
    ("ATS-02", "ats", "low"),
    ("HL-01", "summary", "high"),
    ("HL-02", "summary", "high"),
    ("HL-03", "summary", "high"),
    ("HL-04", "summary", "low"),
    ("HL-05", "summary", "med"),
    ("SUM-01", "summary", "high"),
    ("SUM-02", "summary", "low"),
    ("SUM-03", "summary", "med"),
    ("SUM-04", "summary", "high"),
    ("SUM-05", "summary", "low"),
    ("SUM-06", "summary", "high"),
    ("SUM-07", "summary", "high"),
    ("SUM-08", "summary", "med"),
    ("SUM-09", "summary", "low"),
    ("SUM-10", "summary", "low"),
    ("DOC-02", "summary", "high"),
    ("EXP-05", "format", "med"),
    ("EXP-06", "format", "low"),
    ("EXP-07", "format", "med"),
    ("EXP-08", "format", "med"),
    ("EXP-09", "format", "low"),
    ("EXP-12", "format", "med"),
    ("BUL-07", "format", "med"),
    ("EDU-02", "format", "low"),
    ("EDU-03", "format", "low"),
    ("REF-02", "format", "low"),
    ("DOC-01", "format", "high"),
    ("DOC-03", "format", "med"),
    ("DOC-04", "format", "low"),
    ("DOC-05", "format", "low"),
    ("MKT-01", "format", "low"),
    ("MKT-02", "format", "low"),
    ("EXP-11", "length", "low"),
    ("BUL-01", "length", "low"),
    ("BUL-02", "length", "low"),
    ("BUL-06", "length", "med"),
    ("MKT-04", "length", "low"),
    ("BUL-03", "achievements", "low"),
    ("BUL-04", "achievements", "low"),
    ("BUL-05", "achievements", "low"),
    ("BUL-09", "achievements", "med"),
    ("ACH-01", "achievements", "high"),
    ("MET-01", "achievements", "med"),
    ("MET-02", "achievements", "low"),
    ("MET-03", "skills", "med"),
    ("SKL-01", "skills", "med"),
    ("SKL-02", "skills", "med"),
    ("SKL-03", "skills", "med"),
    ("SKL-04", "skills", "low"),
    ("SKL-05", "skills", "low"),
    ("LNG-01", "skills", "med"),
    ("LNG-02", "skills", "high"),
    ("LNG-03", "skills", "low"),
    ("LNG-04", "skills", "low"),
    ("EDU-01", "skills", "med"),
    ("EDU-04", "skills", "low"),
)
PART_ORDER = ("ats", "summary", "format", "length", "achievements", "skills")
GATES = ("HDR-01", "HDR-02", "HDR-06", "HDR-07", "HDR-08", "HDR-09", "HDR-10", "HDR-11", "HDR-12", "HL-01", "HL-02", "HL-03", "SUM-01",
         "SUM-04", "SUM-06", "SUM-07", "EXP-01", "EXP-02", "EXP-03", "EXP-04", "BUL-08", "LNG-02", "REF-01", "DOC-01", "DOC-02", "ACH-01")
DEFERRED = ("EXP-06", "EXP-07", "EXP-11", "BUL-06", "BUL-07", "BUL-08", "MKT-02")
QUESTION_ONLY = ("HDR-11", "DOC-04", "MKT-03")
SECTIONS = {"HDR": "Header", "HL": "Headline", "SUM": "Summary", "EXP": "Experience", "BUL": "Bullets", "ACH": "Bullets", "MET": "Figures",
            "SKL": "Skills", "LNG": "Languages", "EDU": "Education", "REF": "References", "DOC": "Document language", "MKT": "Market", "ATS": "ATS"}
PENALTY = {"high": (15, 5, 10), "med": (5, 2, 4), "low": (1, 0, 0)}

QUALIFIERS = ("major", "significant", "extensive", "numerous", "high-level", "high-impact", "high-profile", "world-class", "best-in-class",
              "renowned", "prestigious", "outstanding", "exceptional", "excellent", "successful", "successfully", "key", "umfangreich",
              "bedeutend", "zahlreich", "hochrangig", "namhaft", "erfolgreich", "herausragend")
PRAISE = ("recognised", "recognized", "proven", "high-performing", "results-driven", "results-oriented", "visionary", "major", "extensive",
          "dynamic", "passionate", "hard-working", "team player", "self-motivated", "detail-oriented", "seasoned", "accomplished",
          "world-class", "outstanding", "exceptional")
HEADLINE_ADJECTIVES = PRAISE + ("experienced", "motivated", "dedicated", "talented", "highly", "top-performing", "award-winning", "erfahren", "engagiert")
TARGET_WORDING = ("application for", "applying for", "candidate for", "target role", "bewerbung als", "bewerbung für", "seeking", "looking for",
                  "open to", "aspiring")
TAILORING = ("focus for", "schwerpunkt für", "my focus at", "mein schwerpunkt bei", "focus chez", "enfoque para")
FIRST_PERSON = ("i", "my", "me", "ich", "mein", "meine", "je", "mon", "ma")
JD_OPENERS = ("responsible for", "duties included", "tasked with", "worked on", "involved in", "zuständig für", "verantwortlich für")
LANGUAGE_SKILLS = ("english", "german", "deutsch", "arabic", "arabisch", "french", "français", "französisch", "spanish", "español", "italian",
                   "russian", "urdu", "hindi", "turkish", "native", "fluent", "bilingual", "mother tongue", "muttersprache")
SOFT_SKILLS = ("leadership", "communication", "mentoring", "teamwork", "team player", "presentation", "motivation", "interpersonal",
               "problem solving", "problem-solving", "time management", "soft skills", "kommunikation", "teamfähigkeit")
US_SPELLING = ("organization", "organizations", "organized", "optimization", "optimize", "optimized", "analyze", "analyzed", "prioritize",
               "prioritized", "recognized", "specialized", "center", "centers", "color", "favor", "labor", "behavior", "modeling", "traveled")
CLAIM_SKILLS = ("p&l", "profit and loss", "budget responsibility", "budgetverantwortung", "investor relations", "m&a", "mergers", "acquisitions",
                "ipo", "fundraising", "board member", "aufsichtsrat")
TITLE_WORDS = ("advisor", "adviser", "berater", "consultant", "founder", "owner", "inhaber", "partner", "director", "direktor", "geschäftsführer",
               "manager", "leiter", "head", "chief", "officer", "president", "vp", "ceo", "cfo", "coo", "cto", "chairman", "principal", "lead",
               "supervisor", "executive", "specialist", "analyst", "engineer", "coordinator", "administrator", "associate", "assistant",
               "accountant", "controller", "architect", "developer", "kaufmann", "kauffrau", "referent", "sachbearbeiter")
COMPANY_WORDS = ("llc", "gmbh", "ltd", "limited", "fz-llc", "fze", "group", "holding", "inc", "plc", "trading")
IRREGULAR_PAST = ("built", "led", "ran", "won", "grew", "drove", "set", "made", "took", "brought", "sold", "bought", "held", "kept", "oversaw",
                  "wrote", "taught", "began", "undertook", "spent", "cut", "rebuilt", "met", "gave", "became", "chose", "sent", "rose")
JOINING_WORDS = ("and", "or", "of", "to", "with", "for", "in", "und", "oder", "mit", "für", "von", "et", "y")
COMPANY_OPENERS = ("the company", "the group", "the firm", "our company", "we are", "das unternehmen", "die firma", "die gruppe")
MARITAL_LABELS = ("marital status", "familienstand", "état civil", "situation familiale", "estado civil")
MARITAL_WORDS = ("married", "single", "divorced", "widowed", "verheiratet", "ledig", "geschieden", "verwitwet", "marié", "mariée", "célibataire",
                 "casado", "casada", "soltero")
RELIGION_LABELS = ("religion", "konfession", "religionszugehörigkeit", "religious affiliation")
NATIONALITY_LABELS = ("nationality", "nationalität", "staatsangehörigkeit", "nationalité", "nacionalidad", "nazionalità")
BIRTH_LABELS = ("date of birth", "birth date", "birthdate", "dob", "geburtsdatum", "date de naissance", "fecha de nacimiento")
BIRTHPLACE_LABELS = ("place of birth", "birthplace", "geburtsort", "lieu de naissance", "lugar de nacimiento")
HEALTH_WORDS = ("health reasons", "health issue", "health issues", "health condition", "medical leave", "medical reasons", "illness", "disability",
                "sick leave", "burnout", "burn-out", "krankheit", "erkrankung", "behinderung", "schwerbehindert", "elternzeit", "maternity leave")
PERSONAL_LABELS = ("gender", "sex", "geschlecht", "father's name", "name of father", "name des vaters")
BUZZWORDS = ("proven track record", "results-driven", "team player", "self-starter", "hard-working", "dynamic", "passionate", "synergy",
             "go-getter", "think outside the box", "detail-oriented", "highly motivated")

FAMILIES = (  # family, rank, terms
    ("exec", 7, ("chief", "ceo", "coo", "cfo", "cto", "cmo", "cio", "managing director", "general manager", "geschäftsführer", "president", "chairman")),
    ("vp", 6, ("vice president", "vp", "svp", "evp")),
    ("owner", 6, ("founder", "co-founder", "owner", "co-owner", "inhaber", "managing partner", "founding partner", "equity partner")),
    ("director", 5, ("director", "direktor", "directeur", "directora")),
    ("head", 5, ("head of", "head", "leiter", "leitung")),
    ("manager", 4, ("manager", "team lead", "lead", "teamleiter", "supervisor")),
    ("advisor", 3, ("advisor", "adviser", "advisory", "consultant", "berater")),
    ("officer", 2, ("officer",)),
    ("staff", 1, ("specialist", "analyst", "engineer", "coordinator", "associate", "assistant", "executive", "accountant", "controller", "developer")),
    ("entry", 0, ("intern", "internship", "trainee", "praktikant", "werkstudent", "apprentice")),
)
NEAR_PAIRS = (("exec", "vp"), ("exec", "owner"), ("exec", "director"), ("exec", "head"), ("vp", "director"), ("vp", "head"), ("vp", "owner"),
              ("owner", "director"), ("owner", "head"), ("director", "head"), ("director", "manager"), ("head", "manager"), ("manager", "officer"),
              ("officer", "advisor"), ("officer", "staff"), ("staff", "entry"))


# Title classes of one rank across languages, and the classes a held one supports in a headline.
RANK_CLASSES = (
    ("md", ("managing director", "geschäftsführer", "geschäftsführerin", "directeur général", "director general")), ("gm", ("general manager",)),
    ("ceo", ("ceo", "chief executive officer", "chief executive")), ("cfo", ("cfo", "chief financial officer")), ("coo", ("coo", "chief operating officer")),
    ("cto", ("cto", "chief technology officer")), ("cmo", ("cmo", "chief marketing officer")), ("cio", ("cio", "chief information officer")),
    ("mp", ("managing partner",)), ("vp", ("vice president", "vp", "vizepräsident")), ("president", ("president", "präsident", "président", "presidente")),
    ("chairman", ("chairman", "chairwoman", "chairperson", "vorsitzender", "vorsitzende")), ("chair", ("chair",)),
    ("founder", ("founder", "gründer", "gründerin", "fondateur", "fundador")), ("owner", ("owner", "inhaber", "inhaberin", "propriétaire")),
    ("partner", ("partner", "gesellschafter")), ("director", ("director", "direktor", "direktorin", "directeur", "directora")),
    ("manager", ("manager", "managerin", "leiter", "leiterin", "gérant", "gerente")), ("head", ("head",)), ("chief", ("chief",)), ("officer", ("officer",)),
    ("advisor", ("advisor", "adviser", "advisory", "berater", "conseiller", "asesor")), ("consultant", ("consultant", "berater")),
    ("principal", ("principal",)), ("lead", ("lead",)), ("supervisor", ("supervisor",)))
COVERS = (("md", ("director",)), ("ceo", ("md", "gm", "director", "chief", "officer")), ("cfo", ("chief", "officer", "director")), ("coo", ("chief", "officer", "director")),
          ("cto", ("chief", "officer", "director")), ("cmo", ("chief", "officer", "director")), ("cio", ("chief", "officer", "director")), ("mp", ("partner",)),
          ("president", ("vp",)), ("chairman", ("chair",)), ("gm", ("manager",)))
# Languages by group, and the words that state a level of one.
LANGUAGE_GROUPS = (
    ("german", ("german", "deutsch", "allemand", "alemán", "tedesco", "الألمانية")), ("arabic", ("arabic", "arabisch", "arabe", "árabe", "arabo", "العربية")),
    ("english", ("english", "englisch", "anglais", "inglés", "inglese", "الإنجليزية", "الانجليزية")), ("french", ("french", "französisch", "français", "francés", "francese", "الفرنسية")),
    ("spanish", ("spanish", "spanisch", "espagnol", "español", "spagnolo")), ("italian", ("italian", "italienisch", "italien", "italiano")),
    ("russian", ("russian", "russisch", "russe", "ruso")), ("turkish", ("turkish", "türkisch", "turc", "turco")), ("urdu", ("urdu",)), ("hindi", ("hindi",)),
    ("persian", ("farsi", "persian", "persisch")), ("chinese", ("chinese", "mandarin", "chinesisch")), ("portuguese", ("portuguese", "portugiesisch", "portugais")),
    ("dutch", ("dutch", "niederländisch")))
NATIVE_LEVELS = ("native", "natively", "mother tongue", "muttersprache", "muttersprachlich", "muttersprachniveau", "langue maternelle", "nativo", "nativa", "lengua materna",
                 "لغة أم", "اللغة الأم", "native or bilingual proficiency")
LEARNT_LEVELS = ("fluent", "fluently", "fließend", "verhandlungssicher", "business fluent", "business level", "advanced", "proficient", "courant", "couramment", "fluido", "بطلاقة")
OTHER_LEVELS = ("basic", "conversational", "grundkenntnisse", "gut", "good", "intermediate", "working knowledge", "bilingual", "a1", "a2", "b1", "b2", "c1", "c2",
                "full professional proficiency", "professional working proficiency", "limited working proficiency", "elementary proficiency")
LIST_WORDS = ("and", "und", "et", "y", "sowie")
# Names that begin in lower case by right.
BRANDS = ("ebay", "iphone", "ipad", "ios", "npm", "macos", "jquery", "iot", "etoro")
BINDING = ("deputy", "assistant", "associate", "acting", "junior", "trainee", "stellvertretend", "stellvertretender", "stellvertretende", "kommissarisch")
NOT_GERMAN_DATES = ("present", "current", "today", "since", "mar", "may", "oct", "dec", "march", "october", "december")
NOT_ENGLISH_DATES = ("heute", "aktuell", "seit", "mrz", "mär", "märz", "mai", "okt", "dez", "janvier", "février", "mars", "avril", "juin", "juillet", "août",
                     "septembre", "octobre", "novembre", "décembre", "aujourd'hui", "depuis", "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio",
                     "agosto", "septiembre", "octubre", "noviembre", "diciembre", "actualidad", "desde", "hasta")
HONORIFIC = r"(?:^|[^\p{L}])((?:Mr|Mrs|Ms|Dr|Herr|Frau|Prof)\.?\s+\p{Lu}\p{L}*)"
NAME_PAIR = r"[\p{L}\p{N},;:]\s+((?!References?|Referenzen|Written|Available|Request)\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+)"


def checks() -> list[tuple[str, str, str, str, bool, bool]]:
    """(check_id, part, section, severity, gate, deferred) for every check."""
    return [(cid, part, SECTIONS[cid.split("-")[0]], sev, cid in GATES, cid in DEFERRED) for cid, part, sev in CHECKS]


def check_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(checks(), "check_id string, part string, section string, default_sev string, gate boolean, deferred boolean")

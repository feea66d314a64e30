"""Member-export files: which file is what, header rows, and records by alias."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators.scale import keep_first

# Column aliases per kind and field, file-name rules, files that are never read.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "profile": {"first": ("first name", "firstname", "given name"), "last": ("last name", "lastname", "surname", "family name"), "headline": ("headline",),
                "summary": ("summary", "about"), "geo": ("geo location", "geolocation", "location")},
    "positions": {"company": ("company name", "company", "organization name", "organization"), "title": ("title", "job title", "position"),
                  "description": ("description",), "location": ("location",), "start": ("started on", "start date"), "end": ("finished on", "end date")},
    "education": {"school": ("school name", "school", "institution"), "degree": ("degree name", "degree"), "start": ("start date", "started on"),
                  "end": ("end date", "finished on"), "notes": ("notes",), "activities": ("activities",)},
    "skills": {"name": ("name", "skill name", "skill")},
    "languages": {"name": ("name", "language"), "level": ("proficiency", "level")},
    "certifications": {"name": ("name", "certification name"), "authority": ("authority", "issuing organization", "issuer"), "url": ("url",),
                       "start": ("started on", "start date", "issued on"), "end": ("finished on", "end date", "expires on")},
    "email": {"address": ("email address", "email"), "confirmed": ("confirmed",), "primary": ("primary",)},
    "phone": {"number": ("number", "phone number"), "type": ("type",)},
}
# One row per kind: the word in the file's name, and whether the name must begin with it.
FILE_NAMES = (
    ("profile", "profile", True),
    ("positions", "position", False),
    ("education", "education", False),
    ("skills", "skill", True),
    ("languages", "language", True),
    ("certifications", "certification", False),
    ("email", "email", False),
    ("phone", "phone", False),
)
# Words of names that belong to no kind, and words that make a profile file another one.
OTHER_NAMES = ("endorse", "recommend")
PROFILE_EXTRAS = ("summary", "photo")
# Files of other people's words, of correspondence, and of what the site itself records: never read.
NEVER_WORDS = ("messages", "connections", "invitations", "contacts", "inbox", "ad targeting", "ads clicked", "inference", "job seeker", "job application", "saved jobs",
               "learning", "search quer", "registration", "receipts", "security", "follows", "reactions", "votes", "endorse", "recommend", "guide", "coach", "hashtag",
               "saved items", "private identity", "causes")
NEVER_NAMES = ("login", "logins")
NEVER_FOLDERS = ("jobs", "__macosx")


def kind_by_name(name: Column) -> Column:
    """Kind of a file by its name (lower case, words parted by blanks), the first row of ``FILE_NAMES`` that fits."""
    words = F.split(name, " ")
    extra = F.contains(name, F.lit("profile")) & F.exists(words, lambda w: w.isin(*PROFILE_EXTRAS))
    other = F.exists(words, lambda w: sum((w.contains(o).cast("int") for o in OTHER_NAMES), F.lit(0)) > 0)
    fits = [F.when(F.get(words, F.lit(0)).isin(word, word + "s") if begins else F.contains(name, F.lit(word)), F.lit(kind)) for kind, word, begins in FILE_NAMES]
    return F.when(~other & ~extra, F.coalesce(*fits))


def never_read(path: Column, name: Column) -> Column:
    """Whether a file is one of those that are never read, by its name or a folder above it."""
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    held = [F.contains(name, F.lit(w)) for w in NEVER_WORDS]
    named = F.exists(F.split(name, " "), lambda w: w.isin(*NEVER_NAMES))
    return F.greatest(*held) | named | F.arrays_overlap(folders, F.array(*map(F.lit, NEVER_FOLDERS))) | F.element_at(F.split(path, "/"), -1).startswith("._")


SIGNATURES = (("positions", ("company", "title", "start")), ("education", ("school", "degree")), ("languages", ("name", "level")), ("certifications", ("name", "authority")))


def header_name(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def field_hit(names: Column, aliases: tuple[str, ...], exact: bool) -> Column:
    """Position (0-based) of the column that answers a field: an exact name first, then one that contains a long alias."""
    options = [F.array_position(names, a) for a in aliases]
    if not exact:
        for a in (x for x in aliases if len(x) >= 5):
            holds = F.filter(F.transform(names, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), _holds(a))
            options.append(F.coalesce(F.get(holds, F.lit(0))["i"] + 1, F.lit(0)))
    found = F.lit(0).cast("long")
    for o in reversed(options):
        found = F.when(o > 0, o.cast("long")).otherwise(found)
    return F.when(found > 0, found - 1)


def _holds(alias: str):
    return lambda x: F.contains(x["n"], F.lit(alias))


def classify_export_files(files: DataFrame) -> DataFrame:
    """Kind of every file: by name, else by its header's signature; never-read files get none. Of several files of one
    kind the one named for it wins over one recognised by its header, and a file needs a record to claim a kind.

    ``files``: path, header (array of column names), n_records."""
    base = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.csv$", ""))
    name = F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}]+", " "))
    names = F.transform("header", header_name)
    never, by_name = never_read(F.col("path"), name), kind_by_name(name)
    by_header = F.lit(None).cast("string")
    for kind, fields in reversed(SIGNATURES):
        every = F.lit(True)
        for f in fields:
            every = every & field_hit(names, ALIASES[kind][f], True).isNotNull()
        by_header = F.when(every, F.lit(kind)).otherwise(by_header)
    rows = files.select("path", F.when(never, None).otherwise(F.coalesce(by_name, by_header)).alias("kind"),
                        F.when(by_name.isNotNull(), 0).otherwise(1).alias("how"), "n_records", never.alias("never"))
    won = keep_first(rows.where("kind IS NOT NULL AND n_records > 0"), ["kind"], [F.col("how"), F.col("path")]).select("path", F.lit(True).alias("claims"))
    return rows.join(won, "path", "left").select("path", "kind", "never", F.coalesce("claims", F.lit(False)).alias("claims"))


def export_width(spark: SparkSession, path: str) -> int:
    """Columns that the files need: the most separators of any line, which a header row reaches. One number comes back."""
    return (spark.read.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0]) or 1


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind from RFC 4180 files (quoted line breaks, doubled quotes, byte-order mark), of any width.

    The header is the first of a file's first 15 rows that names two known columns (one for single-column kinds); columns
    resolve by alias. Every file is one split, so row order inside it is the reading order."""
    width = export_width(spark, path)
    raw = (spark.read.option("multiLine", True).option("maxColumns", width + 1).option("quote", '"').option("escape", '"').option("header", False)
           .schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
           .withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.monotonically_increasing_id()))
    cells = F.transform(F.array(*[F.col(f"c{i}") for i in range(width)]), lambda c: F.regexp_replace(c, "^﻿", ""))
    rows = raw.select("file", "row", cells.alias("cells"))
    first = rows.groupBy("file").agg(F.min("row").alias("_first"))
    names = F.transform("cells", lambda c: F.coalesce(header_name(c), F.lit("")))
    fields = ALIASES[kind]
    hits = {f: field_hit(names, a, False) for f, a in fields.items()}
    n_known = sum((h.isNotNull().cast("int") for h in hits.values()), F.lit(0))
    near = rows.join(first, "file").where(F.col("row") - F.col("_first") < 15).where(n_known >= min(2, len(fields)))
    head = near.groupBy("file").agg(F.min_by(F.struct("row", *[h.alias(f"ix_{f}") for f, h in hits.items()]), "row").alias("h"))
    body = rows.join(head, "file").where(F.col("row") > F.col("h.row"))
    out = body.select("file", "row", *[F.coalesce(F.trim(F.get("cells", F.col(f"h.ix_{f}"))), F.lit("")).alias(f) for f in fields])
    return out.where(" OR ".join(f"`{f}` <> ''" for f in fields))


def parse_export_rows(rows: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """One CSV record per row, RFC 4180 quoting, to named columns."""
    keep = [c for c in rows.columns if c != line]
    schema = ", ".join(f"`{c}` string" for c in columns)
    return rows.select(*keep, F.from_csv(F.regexp_replace(line, "^﻿", ""), F.lit(schema), {"quote": '"', "escape": '"'}).alias("r")).select(*keep, "r.*")


def export_report(log: DataFrame) -> DataFrame:
    """Imported, skipped and over-cap counts per kind. ``log``: kind, status."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).cast("long").alias(f"n_{s}")
    return log.groupBy("kind").agg(n("imported"), n("skipped"), n("capped"))

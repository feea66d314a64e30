"""Personal details in any text: typed spans of all kinds in one pass, nationality words by how they are used, overlaps resolved.

Every rule gives candidate spans. A nationality word stands alone or in a list (*German, Austrian and Swiss*), and what is before or after
the list tells its use: labelled, a statement about oneself, a market, a language, a right to work, or nothing clear. Only the first two
are personal. Of overlapping candidates a label goes before a statement, then the kind that stands higher in the table, then the longer.
"""
from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import contacts as ct
from dossierflow.plans import lint as li

# Words of nationality in the portal's languages, and names of languages that are no nationality.
NATIONALITY_WORDS = ("american", "austrian", "bahraini", "brazilian", "british", "canadian", "chinese", "deutsch", "deutscher", "deutsche", "dutch", "egyptian", "emirati", "english",
                     "filipino", "french", "german", "greek", "indian", "irish", "italian", "japanese", "jordanian", "kuwaiti", "lebanese", "moroccan", "omani", "pakistani",
                     "polish", "portuguese", "qatari", "russian", "saudi", "spanish", "swiss", "syrian", "tunisian", "turkish", "ukrainian", "österreicher", "schweizer", "français",
                     "française", "español", "española", "italiano", "italiana")
LANGUAGE_ONLY = ("arabic", "hindi", "mandarin", "tagalog", "urdu", "arabisch", "arabe")
# What stands before or after a nationality word, by use.
LABELS_BEFORE = ("citizenship", "nationality", "nationalität", "nationalité", "nacionalidad", "nazionalità", "staatsangehörigkeit")
LANGUAGES_BEFORE = ("fluent", "fluent in", "language", "languages", "native", "sprachen", "langues", "idiomas", "speak", "speaking", "speaks")
LANGUAGES_AFTER = ("fluency", "language", "native speaker", "skills", "speaker", "speaking", "spoken", "translation", "translations", "kenntnisse", "muttersprache")
RIGHTS_BEFORE = ("passport", "permit", "residence permit", "right to work", "visa", "work permit")
RIGHTS_AFTER = ("citizenship", "passport", "permit", "residence", "visa", "work permit", "working visa")
SELF_BEFORE = ("am", "as a", "as an", "born", "ein", "eine", "i'm", "je suis", "soy")
SELF_AFTER = ("born", "citizen", "expat", "expatriate", "national", "nationals", "origin")
MARKET_AFTER = ("account", "accounts", "banks", "brand", "brands", "branch", "clients", "companies", "company", "customers", "entity", "exports", "firm", "group", "headquarters", "hq",
                "imports", "investors", "law", "market", "markets", "offices", "operations", "owned", "parent", "partners", "region", "sales", "standards", "subsidiary", "suppliers",
                "tax", "team", "teams", "trade")
PERSONAL_USES = ("labelled", "self")


@dataclass(frozen=True)
class Kind:
    """A kind of detail: its check, whether its hits are labels (they cannot be dismissed), and a pattern whose first group is the span."""
    name: str
    check: str
    label: bool
    pattern: str

    def may_be_in(self, low: str, digit: bool) -> bool:
        """Whether a text, in lower case, has what every hit holds."""
        words, with_digit = NEEDS.get(self.name, li.PERSONAL_NEEDS.get(self.pattern, (("",), False)))
        return (digit or not with_digit) and any(w in low for w in words)


#: What the hits of the contact kinds hold, as ``lint.PERSONAL_NEEDS`` has it for the rules.
NEEDS = {"email": (("@",), False), "phone": (("+", "00"), True), "card number": (("",), True)}
ODD_CASE, DIGIT = regex.compile(li.ODD_CASE), regex.compile("[0-9]")


def kinds() -> tuple[Kind, ...]:
    """The rules of the lint, addresses, phones and card numbers, the strongest kind first."""
    rules = [Kind(kind, check, False, pattern) for check, kind, pattern in li.PERSONAL_RULES]
    labels = [k for k in rules if k.name in ("nationality", "other", "birthplace", "religion")]
    labels = [Kind(k.name, k.check, True, k.pattern) for k in labels]
    rest = [k for k in rules if k.name not in ("nationality", "other", "birthplace", "religion")]
    contacts = [Kind("email", "REF-01", False, f"({ct.EMAIL})"), Kind("phone", "REF-01", False, r"(?:^|[^0-9+])((?:\+|00)[0-9](?:[0-9().\x2f \t-]{6,}[0-9]))"),
                Kind("card number", "HDR-12", False, li.CARD_NUMBER)]
    return (*labels, *rest, *contacts)


KINDS = kinds()
COMPILED = [(rank, k, regex.compile(k.pattern)) for rank, k in enumerate(KINDS)]
_words = lambda ws: "(?:" + "|".join(regex.escape(w) for w in sorted(ws, key=len, reverse=True)) + ")"
ITEM = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?P<nation>{_words(NATIONALITY_WORDS)})|(?P<language>{_words(LANGUAGE_ONLY)}))(?![\p{{L}}\p{{N}}])", regex.I)
JOINED = regex.compile(r"\s*(?:[,/&+]|-)?\s*(?:(?:and|und|et|y|e|or|oder)\s+)?", regex.I)
BEFORE = {use: regex.compile(rf"(?<![\p{{L}}\p{{N}}]){_words(ws)}\s*[:–-]?\s*$", regex.I) for use, ws in
          (("labelled", LABELS_BEFORE), ("language", LANGUAGES_BEFORE), ("work right", RIGHTS_BEFORE), ("self", SELF_BEFORE))}
AFTER = {use: regex.compile(rf"[\s-]+{_words(ws)}(?![\p{{L}}\p{{N}}])", regex.I) for use, ws in
         (("language", LANGUAGES_AFTER), ("work right", RIGHTS_AFTER), ("self", SELF_AFTER), ("market", MARKET_AFTER))}
#: Characters before a list that its use is read from.
CONTEXT = 60


def use_of(before: str, after: str, alone: bool, spoken: bool) -> str:
    """The use of a list of nationality words. ``alone``: nothing else stands in its line; ``spoken``: a language is in the list."""
    found = [use for use, p in BEFORE.items() if p.search(before)]
    follows = [use for use, p in AFTER.items() if p.match(after)]
    if "labelled" in found:
        return "labelled"
    if spoken or "language" in found or "language" in follows:
        return "language"
    for use in ("work right", "self", "market"):
        if use in follows or (use in found and not follows):
            return use
    return "self" if alone else "unclear"


def nationality_uses(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, use)`` of every nationality word; words joined by commas, slashes, *and* and the like are one list with one use."""
    runs: list[list] = []
    for m in ITEM.finditer(text):
        if runs and (gap := JOINED.match(text, runs[-1][-1].end())) and gap.end() == m.start() and m.start() > runs[-1][-1].end():
            runs[-1].append(m)
        else:
            runs.append([m])
    out = []
    for run in runs:
        start, end = run[0].start(), run[-1].end()
        line_start, line_end = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        line_end = len(text) if line_end < 0 else line_end
        alone = not text[line_start:start].strip(" \t|·•,;") and not text[end:line_end].strip(" \t|·•,;.")
        use = use_of(text[max(line_start, start - CONTEXT):start], text[end:min(line_end, end + CONTEXT)], alone, any(m["language"] for m in run))
        out += [(m.start(), m.end(), use) for m in run if m["nation"]]
    return out


def candidates(text: str) -> list[tuple[bool, int, int, int, str, str]]:
    """``(no label, rank, start, end, kind, check)`` of every rule's hits; of nationality words those of a personal use."""
    low, digit, odd = text.lower(), DIGIT.search(text) is not None, ODD_CASE.search(text) is not None
    out = [(not k.label, rank, *m.span(1), k.name, k.check) for rank, k, p in COMPILED if odd or k.may_be_in(low, digit) for m in p.finditer(text, overlapped=True)]
    if odd or any(w in low for w in NATIONALITY_WORDS):
        out += [(use != "labelled", len(KINDS), start, end, "nationality", "HDR-06") for start, end, use in nationality_uses(text) if use in PERSONAL_USES]
    return sorted(set(out), key=lambda c: (c[0], c[1], c[2] - c[3], c[2]))


def resolved(found: list[tuple[bool, int, int, int, str, str]]) -> list[tuple[int, int, str, str, bool]]:
    """Spans ``(start, end, kind, check, label)`` that do not overlap, by start; candidates come strongest first."""
    kept: list[tuple[int, int, str, str, bool]] = []
    for plain, _, start, end, kind, check in found:
        span = (start, end, kind, check, not plain)
        k = bisect(kept, span)
        if (not k or kept[k - 1][1] <= start) and (k == len(kept) or end <= kept[k][0]):
            kept.insert(k, span)
    return kept


def personal_spans(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, start, end, kind, check_id, label`` of the personal details of each text. ``label``: it is a label and cannot be dismissed. A null
    text has none."""
    fields = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("check_id", pa.string()), ("label", pa.bool_())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [resolved(candidates(t or "")) for t in batch.column(len(keys)).to_pylist()]
            owner = pa.array([i for i, spans in enumerate(found) for _ in spans], pa.int32())
            flat = [s for spans in found for s in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(owner) for i in range(len(keys))), *[pa.array([s[c] for s in flat], t) for c, (_, t) in enumerate(fields)]],
                                             names=[*keys, *(n for n, _ in fields)])

    types = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, F.col(text)).mapInArrow(find, f"{types}, start int, end int, kind string, check_id string, label boolean")


def nationality_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, start, end, use`` of every nationality word, whatever its use."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nationality_uses(t or "") for t in batch.column(len(keys)).to_pylist()]
            owner = pa.array([i for i, spans in enumerate(found) for _ in spans], pa.int32())
            flat = [s for spans in found for s in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(owner) for i in range(len(keys))), *[pa.array([s[c] for s in flat], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string()))]],
                                             names=[*keys, "start", "end", "use"])

    types = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, F.col(text)).mapInArrow(find, f"{types}, start int, end int, use string")

"""Secret scans (operator 6): fixed rules, and formats that are inferred from what the rules find.

Labelled credentials of a kind make a prefix tree with counts. Its states are merged where their continuations are compatible by the
Hoeffding bound (ALERGIA), which leaves a probabilistic automaton of the format. Any run of credential characters in any text is then
scored by the likelihood that an automaton gives to it.
"""
from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.shared import stored

#: Fixed rules.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "format")
#: Runs that are scored if they hold a letter, whole and in parts that begin and end beside a mark of ``PARTED``.
SHORTEST = 12
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
PARTED = frozenset("+/_.=-")
#: Format of a character that a base span covers: no automaton goes over it.
COVERED = "\0"
#: Labelled values of a kind that an automaton is fitted on (a bounded sample by hash), and the longest of them.
SAMPLE, LONGEST = 2000, 256
#: Confidence of the merge test; part of the labelled values whose score is below the threshold of their kind.
ALPHA, TAIL = 0.05, 0.01
#: Least labelled values of a kind, below which it has no automaton.
LEAST = 20


def symbols(value: str) -> str:
    """The format of a value: digits, hexadecimal and other letters by case; other characters stand for themselves."""
    return value.translate(CLASSES)


CLASSES = {c: k for k, chars in {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}.items()
           for c in map(ord, chars)}


class Automaton:
    """A deterministic probabilistic automaton with counts: per state its visits, ends and moves by symbol (target, count)."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.visits, self.ends, self.moves = [0], [0], [{}]
        for value in values:
            at = 0
            self.visits[0] += 1
            for s in symbols(value):
                target, n = self.moves[at].get(s, (len(self.visits), 0))
                if not n:
                    self.visits.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                self.moves[at][s] = (target, n + 1)
                at = target
                self.visits[at] += 1
            self.ends[at] += 1
        self.alpha = alpha
        self._infer()

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (n1 ** -0.5 + n2 ** -0.5)
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if self._differ(na, self.ends[a], nb, self.ends[b]):
                return False
            for s in self.moves[a].keys() | self.moves[b].keys():
                (ta, ca), (tb, cb) = self.moves[a].get(s, (-1, 0)), self.moves[b].get(s, (-1, 0))
                if self._differ(na, ca, nb, cb):
                    return False
                if ca and cb:
                    todo.append((ta, tb))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for s, (tb, cb) in self.moves[b].items():
                ta, ca = self.moves[a].get(s, (tb, 0))
                self.moves[a][s] = (ta, ca + cb)
                if ca:
                    todo.append((ta, tb))

    def _infer(self) -> None:
        settled, fringe = [0], deque((0, s) for s in sorted(self.moves[0]))
        while fringe:
            origin, s = fringe.popleft()
            state = self.moves[origin][s][0]
            if state in settled:
                continue
            other = next((r for r in settled if self._compatible(r, state)), None)
            if other is None:
                settled.append(state)
                fringe.extend((state, t) for t in sorted(self.moves[state]))
                continue
            self.moves[origin][s] = (other, self.moves[origin][s][1])
            known = {r: set(self.moves[r]) for r in settled}
            self._fold(other, state)
            fringe.extend((r, t) for r in settled for t in sorted(set(self.moves[r]) - known[r]))
        self.size = len(settled)

    def score(self, form: str) -> float:
        """Mean log2 probability per symbol, the end counted as one; minus infinity if a move is unknown."""
        at, total = 0, 0.0
        for s in form:
            target, n = self.moves[at].get(s, (0, 0))
            if not n:
                return -math.inf
            total += math.log2(n / self.visits[at])
            at = target
        return (total + math.log2(self.ends[at] / self.visits[at])) / (len(form) + 1) if self.ends[at] else -math.inf


    def parts(self, form: str, least: float) -> list[tuple[int, int]]:
        """Parts (start, end) of a format that begin at its start or after a mark and stop at its end or before one, have ``SHORTEST``
        symbols and a letter, and score at least ``least``. Of parts that meet in one state, all that follows is the same, so only the
        best goes on there: the work is linear in the length. Where any part stops well, one of those that do is given."""
        out: list[tuple[int, int]] = []
        young: list[tuple[float, int, int, bool]] = []
        old: dict[tuple[int, bool], tuple[float, int]] = {}
        for i, s in enumerate(form):
            letter = s in "agAG"
            if s in PARTED:
                out += self._stops(old, i, least)
            if not i or form[i - 1] in PARTED:
                young.append((0.0, i, 0, False))
            moved: dict[tuple[int, bool], tuple[float, int]] = {}
            for (at, lettered), (total, start) in old.items():
                if step := self.moves[at].get(s):
                    key, now = (step[0], lettered or letter), (total + math.log2(step[1] / self.visits[at]) - least, start)
                    if key not in moved or now[0] > moved[key][0]:
                        moved[key] = now
            growing = []
            for total, start, at, lettered in young:
                if step := self.moves[at].get(s):
                    total, lettered = total + math.log2(step[1] / self.visits[at]) - least, lettered or letter
                    if i + 1 - start < SHORTEST:
                        growing.append((total, start, step[0], lettered))
                    elif (key := (step[0], lettered)) not in moved or total > moved[key][0]:
                        moved[key] = (total, start)
            old, young = moved, growing
        return out + self._stops(old, len(form), least)

    def _stops(self, reached: dict[tuple[int, bool], tuple[float, int]], end: int, least: float) -> list[tuple[int, int]]:
        return [(start, end) for (at, lettered), (total, start) in reached.items()
                if lettered and self.ends[at] and total + math.log2(self.ends[at] / self.visits[at]) - least >= -1e-9]


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that do not overlap, longer ones first, by start."""
    out: list[tuple[int, int]] = []
    for span in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
        k = bisect(out, span)
        if (not k or out[k - 1][1] <= span[0]) and (k == len(out) or span[1] <= out[k][0]):
            out.insert(k, span)
    return out


def found(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str]]]:
    """Base spans (start, kind, end, value) by start and kind, and the runs to score (start, value)."""
    lower = text.lower()
    spans = []
    if any(k in lower for k in KEYWORDS):
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    runs = []
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) >= 16:
            spans += [(m.start() + h.start(), 2, m.start() + h.end(), h[0]) for h in HEX.finditer(run)]
        if any(map(str.isalpha, run)):
            runs.append((m.start(), run))
    return sorted(spans), runs


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans, runs`` of every row: what the fixed rules find, and the runs of credential characters."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))
    run = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [found(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("start", "kind", "end", "value"), s)) for s in spans] for spans, _ in rows], span),
                                              pa.array([[dict(zip(("start", "value"), r)) for r in runs] for _, runs in rows], run)], names=["doc_id", "spans", "runs"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"doc_id {kind}, spans array<struct<start: long, kind: int, end: long, value: string>>, runs array<struct<start: long, value: string>>")


def automata(scanned: DataFrame, sample: int = SAMPLE) -> list[tuple[Automaton, float]]:
    """One automaton and score threshold per kind of fixed rule, from at most ``sample`` different values of it, those with the smallest
    hashes of all documents."""
    values = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value").where(F.length("value") <= LONGEST).distinct()
    out = []
    for kind in range(3):
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        own = [r["value"] for r in rows if any(map(str.isalpha, r["value"]))]
        if len(own) >= LEAST:
            machine = Automaton(own)
            scores = sorted(machine.score(symbols(v)) for v in own)
            out.append((machine, scores[int(TAIL * len(scores))]))
    return out


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Base spans are those of the fixed rules, in code points, ``kind:start:end``. A run of credential characters with a letter is a further
    span, of kind ``format``, if some automaton gives its characters a likelihood that 99 of 100 labelled values reach; so is a part of it
    between marks (after a name and ``=``, in a path, before a full stop), the longer before the shorter. No such span touches a
    base span. Scores depend on the format alone and are kept by it.

    Null and empty texts have no spans, a null id stays null, repeated rows give repeated results, an empty table none, and a table with
    fewer than 20 labelled values of each kind has base spans only."""
    scanned = stored(scan(docs, doc_id, text), "scanned")
    machines = scanned.sparkSession.sparkContext.broadcast(automata(scanned, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=100_000)
        def fits(form: str) -> list[tuple[int, int]]:
            if any(m.score(form) >= least for m, least in machines.value):
                return [(0, len(form))]
            return apart([p for m, least in machines.value for p in m.parts(form, least)]) if not PARTED.isdisjoint(form) else []

        for batch in batches:
            base, every, counts = [], [], []
            for spans, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(s["start"], s["kind"], s["end"]) for s in spans]
                more = [(start + a, 3, start + b) for start, form in open_forms(runs, own) for a, b in fits(form)]
                base.append(hashlib.sha256(told(own).encode()).hexdigest())
                every.append(told(sorted(own + more)))
                counts.append([sum(k == kind for _, k, _ in own) for kind in range(3)])
            columns = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(every, pa.string())],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(score, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def open_forms(runs: list[dict], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, str]]:
    """Start and format of each run (by start), ``COVERED`` where spans of ``base`` (by start) touch it."""
    k, covered = 0, []
    for run in runs:
        start, form = run["start"], symbols(run["value"])
        end = start + len(form)
        while k < len(base) and base[k][0] < end:
            covered.append((base[k][0], base[k][2]))
            k += 1
        covered = [c for c in covered if c[1] > start]
        for a, b in covered:
            a, b = max(a, start) - start, min(b, end) - start
            form = form[:a] + COVERED * (b - a) + form[b:]
        yield start, form

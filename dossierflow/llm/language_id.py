"""Language identification (operator 10): unigrams over a public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. A word's likelihood is the sum over all ways to cut it into pieces
of the product of their probabilities, by the forward algorithm. Pieces never cross white space, so a text's likelihood is the
product over its words, and workers keep the words they have seen.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts per language that the probabilities are learned from, about; those with the smallest hashes.
TRAIN_TEXTS = 4000
#: Labels that a model may have; more mean that the column does not hold languages.
MOST_LABELS = 1000
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Characters of a word that are gone through at once (the sums go on over the border), and words that a worker keeps.
SECTION, KEPT = 256, 1_000_000
#: Longer words are learned from in parts of so many characters; their prediction sums over the whole word.
LEARNED_PART = 48
#: Places of words whose pieces are held in arrays at once.
BLOCK = 1 << 18
UNKNOWN = "und"


class Vocabulary:
    """The pieces of a sentencepiece file as a tree by characters, in arrays: ``step`` goes on by one character for many places at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.by_byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        pieces = [(model.id_to_piece(i), i) for i in range(self.size)
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        letters = sorted({c for piece, _ in pieces for c in piece})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest, self.width = max((len(p) for p, _ in pieces), default=1), len(letters) + 1
        nodes, ends = {}, {}
        for piece, i in pieces:
            node = 0
            for c in self.code[[ord(c) for c in piece]].tolist():
                node = nodes.setdefault(node * self.width + c, len(nodes) + 1)
            ends[node] = i
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        keys, child = np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64)
        self.mask = np.int64((1 << (4 * max(1, len(nodes))).bit_length()) - 1)
        self.keys, self.child = np.full(int(self.mask) + 1, -1, np.int64), np.zeros(int(self.mask) + 1, np.int64)
        at = self.slot(keys)
        while len(keys):  # keys whose slot is taken go to the next one
            free = self.keys[at] < 0
            self.keys[at[free]], self.child[at[free]] = keys[free], child[free]
            rest = self.keys[at] != keys
            keys, child, at = keys[rest], child[rest], (at[rest] + 1) & self.mask
        self.first = self.step(np.zeros(self.width, np.int64), np.arange(self.width))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B1)) >> np.int64(15)) & self.mask

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node that a character leads to, or -1."""
        keys = node * self.width + code
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.child[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.child[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Segments:
    """All pieces at all places of many strings (at most 65,535, none longer than that): for each its row, its first and last border, and its
    id, by last border and row.

    A character that is no piece stands as its bytes, with an id of its own beyond the vocabulary (``spelled``)."""

    def __init__(self, strings: list[str], path: str):
        v = vocabulary(path)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code = v.code[points]
        row = np.repeat(np.arange(len(strings)), self.length)
        start = np.arange(len(points)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        left = self.length[row] - start
        at, node, found = np.arange(len(points)), v.first[code], []
        single = np.zeros(len(points), bool)
        for n in range(1, v.longest + 1):
            on = node >= 0
            at, node = at[on], node[on]
            piece = v.piece[node]
            own = piece >= 0
            found.append((at[own], n, piece[own]))
            if n == 1:
                single[at[own]] = True
            on = left[at] > n
            at, node = at[on], node[on]
            if not len(at):
                break
            node = v.step(node, code[at + n])
        lone, spelled = np.flatnonzero(~single), {}
        found.append((lone, 1, np.array([v.size + spelled.setdefault(c, len(spelled)) for c in points[lone].tolist()], np.int64)))
        at, piece = (np.concatenate([f[i] for f in found]) for i in (0, 2))
        end = start[at] + np.concatenate([np.full(len(a), n) for a, n, _ in found])
        order = np.argsort(row[at].astype(np.uint16), kind="stable")
        order = order[np.argsort(end[order].astype(np.uint16), kind="stable")]
        self.row, self.start, self.end, self.id = row[at][order], start[at][order], end[order], piece[order]
        self.width = int(self.length.max(initial=0))
        self.spelled = [[v.by_byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in spelled]
        self.ends = np.searchsorted(self.end, np.arange(self.width + 2))

    def probabilities(self, table: np.ndarray) -> np.ndarray:
        """Rows of the table by id, those of spelled characters added."""
        return np.concatenate([table, np.array([table[ids].prod(axis=0) for ids in self.spelled]).reshape(-1, table.shape[1])])

    def forward(self, p: np.ndarray, alpha: np.ndarray, scale: np.ndarray, begin: int) -> None:
        """Sums over all segmentations up to each border after ``begin`` (rows x borders x languages), in place. A language's sums are
        scaled up where they get small; ``scale`` has the logarithm of that."""
        for end in range(begin + 1, self.width + 1):
            own = slice(self.ends[end], self.ends[end + 1])
            rows = self.row[own]
            if not len(rows):
                continue
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sums = np.add.reduceat(alpha[rows, self.start[own]] * p[self.id[own]], first)
            rows = rows[first]
            alpha[rows, end] = sums
            low = sums < 1e-100
            if low.any():
                at, k = np.nonzero(low)
                alpha[rows[at], :, k] = np.minimum(alpha[rows[at], :, k], 1e200) * 1e100
                scale[rows[at], k] -= 100 * np.log(10)


def likelihoods(words: list[str], table: np.ndarray, path: str) -> np.ndarray:
    """Log likelihood of words (rows) under every language, summed over all segmentations of the word with the vocabulary's mark of a
    blank before it; ``table`` has the pieces' probabilities by language (ids x languages).

    Words are gone through ``SECTION`` characters at a time; the sums up to the last borders that a piece may begin at go on with the next."""
    back, languages = vocabulary(path).longest, table.shape[1]
    out = np.zeros((len(words), languages))
    order, i = sorted(range(len(words)), key=lambda w: len(words[w])), 0
    while i < len(order):
        n, places = 0, 0
        while i + n < len(order) and n < 1 << 15 and (places := (n + 1) * (min(len(words[order[i + n]]) + 1, SECTION) + back)) <= BLOCK or not n:
            n += 1
        live, i, a, lo = np.array(order[i:i + n]), i + n, 0, 0
        carried, scale = np.ones((n, 1, languages)), np.zeros((n, languages))
        while len(live):
            s = Segments([("▁" + words[w])[lo:a + SECTION] for w in live.tolist()], path)
            alpha = np.zeros((len(live), s.width + 1, languages))
            alpha[:, :a - lo + 1] = carried
            s.forward(s.probabilities(table), alpha, scale, a - lo)
            out[live] = np.log(alpha[np.arange(len(live)), s.length]) + scale
            on = np.array([len(words[w]) + 1 > a + SECTION for w in live.tolist()])
            a, was = a + SECTION, lo
            lo = max(0, a - back + 1)
            carried, scale, live = alpha[on, lo - was:], scale[on], live[on]
    return out


def expected(words: Counter, path: str) -> np.ndarray:
    """Expected uses of every piece in words with counts when all pieces are equally probable, by forward and backward sums. Words go in
    parts of ``LEARNED_PART`` characters."""
    size = vocabulary(path).size
    out, parts = np.zeros(size), Counter()
    for word, n in words.items():
        for at in range(0, len(word) + 1, LEARNED_PART):
            parts[("▁" + word)[at:at + LEARNED_PART]] += n
    texts, rows = sorted(parts), BLOCK // LEARNED_PART
    for i in range(0, len(texts), rows):
        s = Segments(texts[i:i + rows], path)
        weight = np.array([parts[w] for w in texts[i:i + rows]], float)
        p = np.concatenate([np.full(size, 1 / size), [size ** -float(len(ids)) for ids in s.spelled]])
        # a factor per character keeps the sums near one; it cancels in the shares
        near = p[s.id] * 40.0 ** (s.end - s.start)
        forward, backward = np.zeros((len(s.length), s.width + 1)), np.zeros((len(s.length), s.width + 1))
        forward[:, 0], backward[np.arange(len(s.length)), s.length] = 1, 1
        for end in range(1, s.width + 1):
            own = slice(s.ends[end], s.ends[end + 1])
            np.add.at(forward, (s.row[own], end), forward[s.row[own], s.start[own]] * near[own])
        for end in range(s.width, 0, -1):
            own = slice(s.ends[end], s.ends[end + 1])
            np.add.at(backward, (s.row[own], s.start[own]), backward[s.row[own], end] * near[own])
        total = np.maximum(forward[np.arange(len(s.length)), s.length], 1e-300)
        share = forward[s.row, s.start] * near * backward[s.row, s.end] / total[s.row] * weight[s.row]
        found = np.bincount(s.id, share, size + len(s.spelled))
        out += found[:size]
        for ids, n in zip(s.spelled, found[size:]):
            np.add.at(out, ids, n)
    return out


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def learned(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_texts: int = TRAIN_TEXTS,
            held_out: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages and the table of piece probabilities, from texts with a language whose id is not held out.

    Of each language about ``train_texts`` texts are used, by a threshold on the hash of the text that the count of the language's texts
    sets. Tasks add up expected counts of pieces per language; the sums (languages x pieces) make the table."""
    usable = docs.where((remainder(doc_id) != held_out) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("t"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"column {lang} has more than {MOST_LABELS} values")
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, 0))
    part = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, train_texts / n))) for k, n in sizes.items()])
    sample = usable.where((F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)) < part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counted = {}, {}

        def settle() -> None:
            for own, words in counted.items():
                sums[own] = sums.get(own, 0) + expected(words, vocabulary_path)
            counted.clear()

        for batch in batches:
            for own, t in zip(*(c.to_pylist() for c in batch.columns)):
                counted.setdefault(own, Counter()).update(t.lower().split())
                if sum(map(len, counted.values())) > KEPT:
                    settle()
        settle()
        rows = [(own, int(i), float(total[i])) for own, total in sums.items() for i in np.flatnonzero(total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.float64()))],
                                         names=["lang", "piece", "n"])

    counts = sample.mapInArrow(count, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((vocabulary(vocabulary_path).size, len(names)), SMOOTHING)
    table[counts["piece"].to_numpy(np.int64), counts["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(np.int64)] += counts["n"].to_numpy(float)
    return names, table / table.sum(axis=0)


class Words:
    """Log likelihoods by language of the words that a worker has seen."""

    def __init__(self, table: np.ndarray, path: str):
        self.table, self.path, self.at, self.rows = table, path, {}, np.zeros((0, table.shape[1]))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sums over the words of each text. The first ``KEPT`` words stay, frequent ones among them."""
        new, before = list(set().union(*texts) - self.at.keys()), len(self.at)
        if new:
            self.at.update(zip(new, range(before, before + len(new))))
            self.rows = np.concatenate([self.rows, likelihoods(new, self.table, self.path)])
        get = self.at.__getitem__
        out = np.array([self.rows[np.fromiter(map(get, t), np.int64, len(t))].sum(axis=0) for t in texts]).reshape(-1, self.table.shape[1])
        if len(self.at) > KEPT:
            for w in new:
                del self.at[w]
            self.rows = self.rows[:before]
        return out


@lru_cache(maxsize=1)
def worker_words(model: bytes, languages: int, path: str) -> Words:
    """The worker's words for the newest table, for all its tasks."""
    return Words(np.frombuffer(model).reshape(-1, languages), path)


def predict(docs: DataFrame, names: list[str], table: np.ndarray, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text",
            held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row by a learned table. ``score`` is the share of the language in the sum of all
    languages' likelihoods."""
    model = docs.sparkSession.sparkContext.broadcast((names, table.tobytes()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, probabilities = model.value
        words = worker_words(probabilities, len(labels), vocabulary_path) if labels else None
        for batch in batches:
            found, scores, block, size = [], [], [], 0

            def settle() -> None:
                """Predictions of a block of about a million characters."""
                total = words.totals([t.lower().split() if t else [] for t in block])
                share = np.exp(total - total.max(axis=1, keepdims=True))
                for t, k, p in zip(block, total.argmax(axis=1).tolist(), (1 / share.sum(axis=1)).tolist()):
                    found.append(labels[k] if t else UNKNOWN)
                    scores.append(p if t else 0.0)
                block.clear()

            for t in batch.column(2).to_pylist():
                block.append(t if words and t and any(map(str.isalpha, t)) else "")
                size += len(block[-1])
                if words and size > 1 << 20:
                    settle()
                    size = 0
            if words:
                settle()
            else:
                found, scores = [UNKNOWN] * len(block), [0.0] * len(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(doc_id) == held_out, F.lit(False)).alias("held_out"), F.col(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """Learn from the documents that are not held out and predict every one.

    ``und`` (score 0) stands for a null text, a text without a letter, and any text where no language could be learned. A row with a null
    id is not held out and not learned from. More than ``MOST_LABELS`` different values of ``lang`` stop the job: the table that is broadcast has
    a number for every piece and language, 256 kB a language. Texts of any length and their words are taken whole; further columns
    are left out whatever their names. Repeated rows give repeated results, an empty table none; ties go to the first
    language in order. Language, source and id are no inputs of a prediction."""
    return predict(docs, *learned(docs, vocabulary_path, doc_id, text, lang, train_texts), vocabulary_path, doc_id, text)

"""Token ids by a public tokenizer, through a table of text pieces that each worker keeps.

The byte-level BPE never merges over the border before a blank, so a text is cut at its single blanks and line breaks and the
library encodes each different piece once. Runs of white space, whose cut depends on what follows, go by a pattern instead.
"""
from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the tokenizer's own pattern (the Unicode property), as a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Pieces that a worker keeps, for all its tasks. The first to come stay, frequent ones among them; others are encoded block by block.
KEPT = 600_000
#: Longer pieces are encoded but not kept.
LONG = 64
#: Words that go to the library as one text.
RUN = 50_000
#: Characters of the texts that are cut at once.
TEXT_BLOCK = 1 << 22
#: What byte-level tokenizers write for a blank and a line break.
OPENING = ("\u0120", "\u010a")


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, on one thread: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    """Whether blanks and line breaks stand alone, so that cutting at them is all there is to do."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in ("\n", " ") or OTHER_SPACE.search(text))


class PieceTable:
    """Values of pieces by a worker's own cache; ``value`` turns the ids of a piece (as bytes, 32 bits each) into what is kept.

    ``start`` holds values of words that stay in the cache. A word stands for itself with the blank before it, or for itself alone if
    it begins with a line break."""

    def __init__(self, path: str, value: Callable[[bytes], object], start: dict[str, object] | None = None, kept: int = KEPT):
        self.tokenizer, self.value, self.start, self.limit = load(path), value, start or {}, kept + len(start or {})
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {s: value(id_array([i])) for s, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words, self.units = dict(self.start), dict(self.special)
        self.opens = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)  # tokens that begin with a blank or a line break
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] in OPENING]] = True

    def of(self, texts: Iterable[str]) -> Iterable[list[object]]:
        """The values of the pieces of each text in turn. Texts are taken in blocks of about a million characters."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > 1 << 20:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> list[list[object]]:
        words, units = [], []
        for text in texts:
            if any(s in text for s in self.special):
                cut = self.cut.split(text)
                units.append([p for part in cut for p in ([part] if part in self.special else UNITS.findall(part))])
                words.append([])
            elif plain(text):
                first, *rest = text.replace("\n", " \n").split(" ")
                units.append([first] if first else [])
                words.append(rest)
            else:
                units.append(UNITS.findall(text))
                words.append([])
        first = self._values(units, self.units, lambda new: map(self.value, map(id_array, self._ids(new))))
        then = self._values(words, self.words, self._run)
        return [a + b for a, b in zip(first, then)]

    def _values(self, lists: list[list[str]], cache: dict, encoded: Callable[[list[str]], Iterable[object]]) -> list[list[object]]:
        missing = list(set().union(*lists) - cache.keys())
        cache.update(zip(missing, encoded(missing)))
        out = [list(map(cache.__getitem__, cut)) for cut in lists]
        full = len(cache) > self.limit
        for p in missing:
            if full or len(p) > LONG:
                del cache[p]
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _run(self, words: list[str]) -> Iterable[object]:
        """Values of words. Each begins with a blank or a line break and has no other, so many of them go to the library as one text, and
        the tokens that begin with either tell where a word begins."""
        for i in range(0, len(words), RUN):
            texts = [p if p[:1] == "\n" else " " + p for p in words[i:i + RUN]]
            ids = np.array(self._ids(["".join(texts)])[0], "<u4")
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(texts):
                raw, borders = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
                yield from (self.value(raw[a:b]) for a, b in zip(borders, borders[1:]))
            else:
                yield from map(self.value, map(id_array, self._ids(texts)))


def id_array(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


class IdTable(PieceTable):
    """Ids of whole texts at once. Arrow cuts the texts of a block into words and numbers the different ones, so Python looks at each different
    word of a block once; the ids of all kept pieces lie in one array, and a block's ids are gathered from it."""

    def __init__(self, path: str, kept: int = KEPT, block: int | None = None):
        super().__init__(path, bytes, kept=kept)
        self.block = block or TEXT_BLOCK
        self.numbers, self.count = {"u": 0}, 1
        self.first, self.length, self.ids, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, "<u4"), 0

    def texts(self, texts: Iterable[str]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """For block after block of texts: all their ids, and how many each text has."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > self.block:
                yield self._ids_of(block)
                block, size = [], 0
        if block:
            yield self._ids_of(block)

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        count, used = self.count, self.used
        simple = [not any(s in t for s in self.special) and plain(t) for t in texts]
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") if ok else "" for t, ok in zip(texts, simple)], pa.large_string()), " ")
        offsets = cut.offsets.to_numpy()
        words = cut.values.dictionary_encode()
        own = words.dictionary.to_pylist()
        number = self._numbers(["w" + w for w in own], lambda new: self._run([w[1:] for w in new]))
        pieces = number[words.indices.to_numpy()]
        odd = [UNITS.findall(t) if not any(s in t for s in self.special) else [p for part in self.cut.split(t) for p in ([part] if part in self.special else UNITS.findall(part))]
               for t, ok in zip(texts, simple) if not ok]
        heads = pc.list_element(cut, 0).to_pylist()  # a text's first word has no blank before it
        seen = list(set(heads).union(*odd))
        units = dict(zip(seen, self._numbers(["u" + u for u in seen], lambda new: [self.special.get(u[1:]) or id_array(i) for u, i in
                                                                                zip(new, self._ids([u[1:] for u in new]))]).tolist()))
        pieces[offsets[:-1]] = [units[h] for h in heads]
        parts, rest = [], iter(odd)
        if all(simple):
            borders = offsets
        else:
            for k, ok in enumerate(simple):
                parts.append(pieces[offsets[k]:offsets[k + 1]] if ok else np.array([units[u] for u in next(rest)], np.int64))
            pieces, borders = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        length = self.length[pieces]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        at = np.repeat(self.first[pieces] - ends[:-1].astype(np.int32), length)  # a block has far fewer than 2**31 ids
        at += np.arange(len(at), dtype=np.int32)
        out = self.ids.take(at), ends[borders[1:]] - ends[borders[:-1]]
        if self.count > self.limit:  # the first to come stay
            for key in list(self.numbers)[count:]:
                del self.numbers[key]
            self.count, self.used = count, used
        return out

    def _numbers(self, keys: list[str], encoded: Callable[[list[str]], Iterable[bytes]]) -> np.ndarray:
        new = [k for k in keys if k not in self.numbers]
        if new:
            raw = list(encoded(new))
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            flat = np.frombuffer(b"".join(raw), "<u4")
            while self.count + len(new) > len(self.first):
                self.first, self.length = np.concatenate([self.first, 0 * self.first]), np.concatenate([self.length, 0 * self.length])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, 0 * self.ids])
            self.first[self.count:self.count + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.length[self.count:self.count + len(new)] = sizes
            self.ids[self.used:self.used + len(flat)] = flat
            self.numbers.update(zip(new, range(self.count, self.count + len(new))))
            self.count, self.used = self.count + len(new), self.used + len(flat)
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))


@lru_cache(maxsize=2)
def id_table(path: str, kept: int = KEPT, block: int | None = None) -> IdTable:
    """The worker's table of ids, with at most ``kept`` words and ``block`` characters of texts at a time (memory against CPU)."""
    return IdTable(path, kept, block)

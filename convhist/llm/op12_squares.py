"""Periodic runs of words, caught online by dyadic blocks.

A stream of words is appended to. For every power of two b, its blocks [j b, (j + 1) b) are remembered by a fingerprint as
soon as they are complete: these are the catchers. A square of period q holds a whole block of size b <= (q + 1) / 2 in its
first half, and that block stands again q words later. So each appended word ends one suffix of b words per level, which
is compared with the two blocks (three at the lowest level) that began 2 b to 4 b words before it (1 to 3). Where they
agree, suffix comparisons follow the agreement back and on with each appended word; once it spans 2 q words it is a new
square, and squares of one period that overlap merge into a run. Agreements that reach the end of the stream stay open
for the words to come.

`append` takes any number of words and does the comparisons of all of them at once in numpy, so a batch of documents is
one stream with a word of its own after each document, which no period can span. Fingerprints are rolling hashes;
`runs` compares the words themselves before it reports anything.

Work is n log n for n words; nothing is shuffled. Defined cases: null and empty texts have no words and no runs; whole
texts, whatever their length; null and repeated ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convhist.llm import grams
from convhist.llm.common import encoded, runs_of, table, text_slices

_NONE = np.empty((0, 3), dtype=np.int64)


class _Tail:
    """An array that grows at its end."""

    def __init__(self, dtype, first=()):
        self.data, self.n = np.array(first, dtype=dtype), len(first)

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.empty(max(self.n, len(values)), dtype=self.data.dtype)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def view(self) -> np.ndarray:
        return self.data[: self.n]


class SquareCatcher:
    """Squares of a growing stream of words (given as integers), with periods up to `longest`."""

    def __init__(self, longest: int):
        self.longest = longest
        self.words, self.sums = _Tail(np.int64), _Tail(np.uint64, [0])
        self.catchers: list[_Tail] = []
        self.open = _NONE  # agreements (start, end, period) that reach the end of the stream
        self.caught: list[np.ndarray] = []

    def _hash(self, start: np.ndarray, size: int) -> np.ndarray:
        sums = self.sums.data
        return (sums[start + size] - sums[start]) * self.down[start]

    def _agreement(self, left: np.ndarray, right: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree after (or, back, before) two places, at most `room`: doubling steps, then halving ones."""
        size, top = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)

        def reach(live: np.ndarray, step: int) -> np.ndarray:
            live_size = size[live]
            good = np.flatnonzero(live_size + step <= room[live])
            shift = live_size[good] + step if back else live_size[good]
            shift = -shift if back else shift
            a, b = left[live[good]] + shift, right[live[good]] + shift
            ok = np.zeros(len(live), dtype=bool)
            ok[good] = self._hash(a, step) == self._hash(b, step)
            size[live[ok]] += step
            return ok

        live, step = np.arange(len(left)), 1
        while len(live):
            ok = reach(live, step)
            top[live[~ok]] = step
            live, step = live[ok], step * 2
        while step > 1:
            step //= 2
            live = np.flatnonzero(top > step)
            if len(live):
                reach(live, step)
        return size

    def append(self, words: np.ndarray) -> np.ndarray:
        """Take words in and return the stretches (start, end, period) that hold squares which end among them."""
        before = self.words.n
        self.words.extend(words)
        n = self.words.n
        up, self.down = grams._power(0, n + 1)
        symbols = grams.mix(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)) | np.uint64(1)
        self.sums.extend(self.sums.view[-1] + np.cumsum(symbols * up[before:n]))
        held = self.open
        ends = held[:, 1] + self._agreement(held[:, 1] - held[:, 2], held[:, 1], n - held[:, 1], False)
        found = [np.column_stack((held[:, 0], ends, held[:, 2]))]
        level = 0
        while (b := 1 << level) <= n and (b == 1 or 2 * b <= self.longest):
            found.append(self._catch(level, b, before, n))
            level += 1
        merged = _merged(np.concatenate(found))
        self.open = merged[merged[:, 1] == n]
        squares = merged[merged[:, 1] - merged[:, 0] >= 2 * merged[:, 2]]
        self.caught.append(squares)
        return squares

    def _catch(self, level: int, b: int, before: int, n: int) -> np.ndarray:
        """Agreements that begin with a block of size b which appended words repeat."""
        if level == len(self.catchers):
            self.catchers.append(_Tail(np.uint64))
        blocks = self.catchers[level]
        blocks.extend(self._hash(np.arange(blocks.n, n // b) * b, b))
        at = np.arange(max(before - b + 1, 0), n - b + 1)
        suffix, first = self._hash(at, b), at // b
        places, periods = [], []
        for back in (1, 2, 3) if b == 1 else (2, 3):
            block = first - back
            hit = np.flatnonzero((block >= 0) & (blocks.data[np.maximum(block, 0)] == suffix))
            places.append(at[hit])
            periods.append(at[hit] - block[hit] * b)
        place, period = np.concatenate(places), np.concatenate(periods)
        keep = period <= self.longest
        place, period = place[keep], period[keep]
        if not len(place):
            return _NONE
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        fresh = np.concatenate(([True], (period[1:] != period[:-1]) | (place[1:] > place[:-1] + b)))
        lead = np.flatnonzero(fresh)
        begin, period, end = place[lead], period[lead], place[np.append(lead[1:], len(place)) - 1] + b
        start = begin - period
        start = start - self._agreement(start, begin, start, True)
        end = end + self._agreement(end - period, end, n - end, False)
        return np.column_stack((start, end, period))[(end - start >= 2 * period) | (end == n)]

    def runs(self, min_exponent: int = 2, min_length: int = 2) -> np.ndarray:
        """Runs (start, end, smallest period) of all words so far, by start and period, compared word by word."""
        stretches = _merged(np.concatenate([_NONE, *self.caught]))
        stretches = stretches[stretches[:, 1] - stretches[:, 0] >= np.maximum(min_length, min_exponent * stretches[:, 2])]
        # A multiple of a period agrees over the same stretch as the period itself.
        order = np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))
        sorted_ = stretches[order]
        least = np.ones(len(sorted_), dtype=bool)
        least[1:] = (sorted_[1:, :2] != sorted_[:-1, :2]).any(axis=1)
        runs = sorted_[least]
        if all(self._holds(*r) for r in runs.tolist()):
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        return self._compared(stretches, min_exponent, min_length)

    def _holds(self, start: int, end: int, period: int) -> bool:
        words = self.words.view
        wider = (start > 0 and words[start - 1] == words[start - 1 + period]) or (end < len(words) and words[end] == words[end - period])
        return not wider and bool((words[start + period : end] == words[start : end - period]).all())

    def _compared(self, stretches: np.ndarray, min_exponent: int, min_length: int) -> np.ndarray:
        """The runs within stretches where a fingerprint was wrong: found by the words alone."""
        words, out = self.words.view, {}
        for start, end, period in stretches.tolist():
            a, b = max(0, start - period), min(len(words), end + period)
            for x, y in (runs_of(words[a + period : b] == words[a : b - period]) + a).tolist():
                if y + period - x >= max(min_length, min_exponent * period):
                    out[x, y + period] = min(period, out.get((x, y + period), period))
        return np.array(sorted((x, y, p) for (x, y), p in out.items()), dtype=np.int64).reshape(-1, 3)


def _merged(stretches: np.ndarray) -> np.ndarray:
    """One stretch per start and period: the longest."""
    order = np.lexsort((-stretches[:, 1], stretches[:, 2], stretches[:, 0]))
    rows = stretches[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
    return rows[fresh]


def word_runs(documents: list[list[int]], min_exponent: int, min_length: int) -> list[np.ndarray]:
    """Runs (start, end, period) of each document, all documents being one stream."""
    catcher = SquareCatcher(max([len(d) for d in documents], default=0) // min_exponent)
    parts = [np.array([*d, -1 - i], dtype=np.int64) for i, d in enumerate(documents)]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    catcher.append(np.concatenate([np.empty(0, dtype=np.int64), *parts]))
    runs = catcher.runs(min_exponent, min_length)
    cut = np.searchsorted(runs[:, 0], bounds)
    return [runs[a:b] - [s, s, 0] for a, b, s in zip(cut[:-1], cut[1:], bounds[:-1], strict=True)]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words repeat: those of a run after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _detect(emit: Callable, names: list[str], kinds: list, min_exponent: int, min_length: int, reorder: Callable | None):
    """Per document: emit(doc_id, words, runs) -> rows, in batches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), encoded(batch.column("text"))
            for a, b in text_slices([len(t) for t in texts]):
                index: dict[bytes, int] = {}
                words = [t.split() for t in texts[a:b]]  # of bytes: at space and the five ASCII control spaces
                if reorder:
                    words = [reorder(i, w) for i, w in zip(doc_ids[a:b], words, strict=True)]
                numbers = [[index.setdefault(w, len(index)) for w in d] for d in words]
                rows = []
                for doc_id, d, found in zip(doc_ids[a:b], words, word_runs(numbers, min_exponent, min_length), strict=True):
                    rows += emit(doc_id, d, found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _slim(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _run_rows(doc_id, words, runs):
    return [(doc_id, s, e - s, p, 1000 * (e - s) // p) for s, e, p in runs.tolist()]


def runs(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, period, exponent_milli): one row per run; places and lengths in words."""
    names = ["doc_id", "start", "length", "period", "exponent_milli"]
    return _slim(docs, text_col, id_col).mapInArrow(_detect(_run_rows, names, [pa.int64()] * 5, min_exponent, min_length, None), ", ".join(f"{n} long" for n in names))


def _kept_text(words: list[bytes], found: np.ndarray) -> bytes:
    if not len(found):
        return b" ".join(words)
    gone = dropped(len(words), found)
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _collapsed_rows(doc_id, words, found):
    return [(doc_id, len(found), _kept_text(words, found).decode())]


def collapse(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_runs, text): each text's words without what its runs repeat, joined by one space."""
    run = _detect(_collapsed_rows, ["doc_id", "n_runs", "text"], [pa.int64(), pa.int64(), pa.string()], min_exponent, min_length, None)
    return _slim(docs, text_col, id_col).mapInArrow(run, "doc_id long, n_runs long, text string")


def _summary_rows(doc_id, words, found):
    rows = found.tolist()
    best = max(rows, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listing = "".join([f"{s},{e - s},{p}\n" for s, e, p in rows]).encode()
    return [(doc_id, len(rows), *top, hashlib.sha256(listing).hexdigest(), hashlib.sha256(_kept_text(words, found)).hexdigest())]


def summaries(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, reorder: Callable | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: n_runs, its run of greatest exponent (start, length, period, exponent_milli), digests of runs and kept words.

    reorder: optional function of id and words that gives the words to look at.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds, strict=True))
    return _slim(docs, text_col, id_col).mapInArrow(_detect(_summary_rows, names, kinds, min_exponent, min_length, reorder), schema)


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: of every tenth id, by a hash, a part that repeats from a place on."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_word_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which echo."""
    return summaries(table(spark, sf_dir, "documents"), reorder=echoed)

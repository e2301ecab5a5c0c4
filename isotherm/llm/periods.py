"""Periodic run detection: stretches of words that repeat with a fixed period, by seeds on diagonals.

A run of period q has length >= max(LEAST_WORDS, EXPONENT * q), so the text and the text moved by q words
overlap in at least max(LEAST_WORDS - q, (EXPONENT - 1) * q) equal words. Periods are dealt into bands
[first, last] with 2 * last <= k, where k is the smallest overlap guaranteed to any period of the
band. The k-grams of a text are then an index of seeds:

* A run has a seed at its start, and the next occurrence of that k-gram lies exactly one period
  later: a nearer one would give the run a smaller period, as k holds two periods. So the pairs to
  look at are neighbouring occurrences of a k-gram, at most one per word and band, and a k-gram
  that fills a whole text costs no more than a rare one.
* Each pair lies on a diagonal, its lag. It is extended to both sides as far as words are equal. A
  table holds, per lag, how far it has been covered; a pair inside is not extended again.

k-grams are named exactly, by doubling: a name of 2k words is the rank of two names of k words. Only
words whose shorter k-gram occurs twice go on to the next band, so a text without repeats ends at once.
A text costs O(n log n) time and O(n) memory. Nothing is shuffled.

Words are maximal stretches without space, tab, line feed, vertical tab, form feed and carriage return.

Defined results: NULL and empty texts have no words and no runs. Rows are worked on one by one, so
repeated rows give repeated results. Ties for the longest run go to the smallest start, then the
smallest period. Other columns, whatever their names, are not read by periodic_runs and pass
unchanged through collapse_runs; there NULL stays NULL and a text without runs stays as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import table
from isotherm.llm.words import map_rows

LEAST_WORDS, EXPONENT = 6, 4
Run = tuple[int, int, int]      # start, length, period


def split(text: str | None) -> list[bytes]:
    # bytes.split() without arguments cuts at exactly the six ASCII white-space characters
    return (text or "").encode("utf-8", "replace").split()


def bands(n: int) -> Iterator[tuple[int, int, int]]:
    """(k, first, last): bands of periods of runs that fit into n words, smallest first."""
    first = 1
    while max(LEAST_WORDS, EXPONENT * first) <= n:
        k = max(LEAST_WORDS - first, (EXPONENT - 1) * first)
        # later periods of the band must guarantee the same overlap
        while max(LEAST_WORDS - k // 2, (EXPONENT - 1) * (k // 2)) < k:
            k -= 1
        yield k, first, k // 2
        first = k // 2 + 1


class Grams:
    """Exact names of the k-grams of a sequence, at the places that can still repeat."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.size, self.names = 1, ids
        self.places = np.arange(self.n)         # where a gram of the last length occurs twice

    def repeated(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, next places): neighbouring occurrences of equal k-grams; k grows from call to call."""
        while 2 * self.size <= k:
            self.names = self._joined(2 * self.size)
            self.size *= 2
            if not len(self.places):
                break
        names = self.names if k == self.size else self._joined(k)
        if not len(self.places):
            return self.places, self.places
        mine = names[self.places]
        order = np.argsort(mine, kind="stable")     # equal grams side by side, in order of place
        sorted_names, at = mine[order], self.places[order]
        same = sorted_names[1:] == sorted_names[:-1]
        i, j = at[:-1][same], at[1:][same]
        up = np.argsort(i)
        return i[up], j[up]

    def _joined(self, k: int) -> np.ndarray:
        """Names of k-grams from two overlapping names each; places keeps those that occur twice."""
        at = self.places[self.places <= self.n - k]
        at = at[self.names[at + (k - self.size)] >= 0]      # the second part occurs once: so does the whole
        pair = self.names[at] * np.int64(self.n + 1) + self.names[at + (k - self.size)]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        names = np.full(self.n, -1, dtype=np.int64)
        twice = count[rank] > 1
        names[at[twice]] = rank[twice]
        self.places = at[twice]
        return names


def find_runs(words: list) -> list[Run]:
    """All runs by start, then period."""
    n, number = len(words), {}
    if n < LEAST_WORDS:
        return []
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if len(number) == n:
        return []
    grams, runs = Grams(ids), []
    for k, first, last in bands(n):
        i, j = grams.repeated(k)
        if not len(grams.places):
            break
        lag = j - i
        wanted = (lag >= first) & (lag <= last)
        covered: dict[int, int] = {}
        for a, q in zip(i[wanted].tolist(), lag[wanted].tolist()):
            if a < covered.get(q, 0):
                continue
            start, end = a, a + k
            while start > 0 and words[start - 1] == words[start - 1 + q]:
                start -= 1
            while end + q < n and words[end] == words[end + q]:
                end += 1
            covered[q] = end
            if end + q - start >= max(LEAST_WORDS, EXPONENT * q):
                runs.append((start, end + q - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(step[:-1]).tolist()) if not inside]


def longest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None


def _row(words: list) -> tuple:
    runs = find_runs(words)
    top = longest(runs)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest())


ROW = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
       "runs_sha256 string, collapsed_sha256 string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_of=None) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the words that stay.

    words_of(id, text) may give the words of a row; by default they are those of the text.
    """
    words_of = words_of or (lambda _, t: split(t))

    def make():
        def run(columns):
            for key, t in zip(*columns):
                yield (key, *_row(words_of(key, t)))
        return run

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows, make, f"key {kind}, {ROW}").withColumnRenamed("key", id_col)


def run_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, period): one row per run."""
    def make():
        def run(columns):
            for key, t in zip(*columns):
                for found in find_runs(split(t)):
                    yield (key, *found)
        return run

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows, make, f"key {kind}, start bigint, length bigint, period bigint").withColumnRenamed("key", id_col)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every run cut to its first period. Texts that have runs become words joined by one space."""
    at = docs.columns.index(text)

    def short(t: str | None) -> str | None:
        words = split(t)
        runs = find_runs(words)
        return b" ".join(kept_words(words, runs)).decode() if runs else t

    def run(batches):
        for batch in batches:
            made = pa.array([short(t) for t in batch.column(at).to_pylist()], type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), made)

    return docs.mapInArrow(run, docs.schema)


def seeded_words(key: int | None, text: str | None) -> list[bytes]:
    """Words of a document; by its id every tenth one repeats a stretch to its end. A NULL id has none."""
    words = split(text)
    n, h = len(words), 1 if key is None else crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + [period[i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), words_of=seeded_words)

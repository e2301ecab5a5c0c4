"""Benchmark decontamination: windows of ten words of the benchmark, looked up in every document.

The benchmark's windows form a hash set that every task gets. Its size is checked: a set of more
than BLOCK_WINDOWS (window, item) pairs is dealt into blocks by hash and the documents pass block
after block, so no broadcast exceeds one block. Words are numbered by the block's vocabulary; a
rolling hash over the numbers finds possible windows, the numbers themselves then decide.

Defined results: NULL text has no words. A benchmark item of fewer than ten words is one window,
one without words none. Items that share an id count once; an item without id marks words but is
not listed. Repeated document rows each get their row. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import table
from isotherm.llm.words import LOWER, UPPER, WORD, WORD_SQL, lowered, map_rows, words
from isotherm.session import cut

WINDOW = 10
BLOCK_WINDOWS = 200_000         # (window, item) pairs sent to every task at once

_MIX = np.uint64(0x9E3779B97F4A7C15)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, item): every window of every item as words joined by a space, item id as text."""
    def make():
        def run(columns):
            for item, text in zip(*columns):
                w = words(text)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    yield b" ".join(w[i:i + size]).decode("utf-8", "replace"), item
        return run

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return map_rows(rows, make, "win string, item string").distinct()


class Block:
    """Look-up of windows: vocabulary, one sorted array of hashes per length, exact windows."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        self.vocab: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for win, item in pairs:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in win.encode().split(b" "))
            self.items.setdefault(ids, set()).update([] if item is None else [item])
        by_size: dict[int, list] = {}
        for ids in self.items:
            by_size.setdefault(len(ids), []).append(ids)
        self.keys = {n: np.unique(_rolled(np.array(v, dtype=np.uint64).ravel(), n)[::n]) for n, v in by_size.items()}

    def search(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (start, end) and the items they come from."""
        ids = np.fromiter((self.vocab.get(w, 0) for w in tokens), dtype=np.uint64, count=len(tokens))
        spans, items = [], set()
        for n, keys in self.keys.items():
            if len(ids) < n:
                continue
            rolled = _rolled(ids, n)
            at = np.searchsorted(keys, rolled)
            at[at == len(keys)] = 0
            for i in np.flatnonzero(keys[at] == rolled):
                found = self.items.get(tuple(int(x) for x in ids[i:i + n]))
                if found is not None:
                    spans.append((int(i), int(i) + n))
                    items |= found
        return spans, items


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for j in range(n):
        out = (out ^ ids[j:len(ids) - n + 1 + j]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of every run of words."""
    low, raw = lowered(text), text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(low)]
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


_FOUND = "_id string, _text string, _n bigint, _runs array<bigint>, _items array<string>"


def _scan(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, size: int, block_windows: int) -> DataFrame:
    """rows(_id, _text) with number of words, hit runs (start, end, start, ...) and items."""
    pairs = benchmark_windows(benchmark, size)
    total = pairs.count()
    blocks = max(1, -(-total // block_windows))
    if blocks > 1:
        pairs = cut(pairs)
    rows = rows.select("_id", "_text", F.lit(0).cast("bigint").alias("_n"),
                       F.array().cast("array<bigint>").alias("_runs"), F.array().cast("array<string>").alias("_items"))
    for k in range(blocks):
        part = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k)
        # at most about block_windows short rows
        shared = spark.sparkContext.broadcast([(r.win, r.item) for r in part.collect()])

        def make(shared=shared, last=k + 1 == blocks):
            block = Block(shared.value)

            def run(columns):
                for key, text, _, runs, items in zip(*columns):
                    tokens = words(text)
                    spans, found = block.search(tokens)
                    spans = merged(spans + list(zip(runs[::2], runs[1::2])))
                    yield (key, None if last else text, len(tokens), [x for s in spans for x in s], sorted(found | set(items)))
            return run

        rows = map_rows(rows, make, _FOUND)
        if k + 1 < blocks:
            rows = cut(rows)
    return rows


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: counts of words, hit words and items, digest of the items, verdict."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
    found = _scan(spark, rows, benchmark, size, block_windows)

    def make():
        def run(columns):
            for key, _, n, runs, items in zip(*columns):
                hit = sum(runs[1::2]) - sum(runs[::2])
                yield key, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0
        return run

    out = map_rows(found, make, "_id string, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                                "contaminated boolean")
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without the hit words ("spans").

    All columns of docs stay; the text carries them through the look-up as one struct, so their
    names cannot clash with internal ones. In "spans" a column n_chars follows the new text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    rest = [c for c in docs.columns if c != text]
    # fields by number: a column may have any name
    packed = docs.select(F.struct(F.lit(0).alias("f"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)]).alias("_rest"),
                         F.col(f"`{text}`").alias("_text"), F.array().cast("array<bigint>").alias("_runs"))
    pairs = benchmark_windows(benchmark, size)
    blocks = max(1, -(-pairs.count() // block_windows))
    if blocks > 1:
        pairs = cut(pairs)
    for k in range(blocks):
        part = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.win, r.item) for r in part.collect()])

        def run(batches, shared=shared, last=k + 1 == blocks):
            import pyarrow as pa

            block = Block(shared.value)
            for batch in batches:
                texts, before = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                runs = [merged(block.search(words(t))[0] + list(zip(r[::2], r[1::2]))) for t, r in zip(texts, before)]
                keep = [not last or not r or remove == "spans" for r in runs]
                if last:
                    texts = [cut_words(t, r) if r else t for t, r in zip(texts, runs)]
                columns = [batch.column(0), pa.array(texts, batch.schema.field(1).type),
                           pa.array([[x for s in r for x in s] for r in runs], batch.schema.field(2).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

        packed = packed.mapInArrow(run, packed.schema)
        if k + 1 < blocks:
            packed = cut(packed)
    out = packed.select(*[(F.col("_text") if c == text else F.col(f"_rest.f{rest.index(c)}")).alias(c) for c in docs.columns])
    if remove == "spans" and "n_chars" in rest:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go whole: what surrounds a test passage often paraphrases it."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
 regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_SQL}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
 FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
 FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""

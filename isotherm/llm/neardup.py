"""N-gram Jaccard join: documents whose five-word shingles have a similarity of 0.8 or more.

1. Every text becomes its set of shingles and SIGNATURE MinHash values. Texts with the same set
   form one class and go on as one; their copies are counted, never paired.
2. BANDS bands of ROWS values deal the texts into buckets. Each bucket ties its texts to its
   smallest one (a star, not pairs). The components of these ties are the candidate groups: a
   pair that shares a bucket lies in one group.
3. Within a group every pair is looked at: MinHash values are compared step by step, and a pair
   is dropped when the posterior probability that it reaches the threshold falls below TOLERANCE
   (uniform prior, binomial likelihood). The others are verified exactly on their shingles. A
   group of more than BLOCK texts is dealt into pairs of blocks, each its own task input, so no
   task holds a large group. What leaves a task is a count per text and the ties of a forest.
4. Components of the verified links are the classes.

A pair at the threshold misses all bands with probability (1 - 0.8^ROWS)^BANDS = 3e-6 and is
dropped wrongly with about TOLERANCE per step.

Result: doc_id, class_id (smallest id of the class), n_links (documents with similarity of 0.8 or
more, copies included). Words are those of the other word-window operators. Defined results: a
text of fewer than five words is one shingle; texts without words (NULL, empty) have no shingle,
no links and a class each. A NULL id has a NULL class and no links. Rows that share an id and a
text count as one document; rows that share an id and differ in text are compared as documents of
their own, each with its own class and links. Other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import in_row, row_fields, table, text_hash, written
from isotherm.llm.components import components
from isotherm.llm.words import map_rows, words

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 32
SIGNATURE = ROWS * BANDS
STEP = 32                       # MinHash values compared at a time
TOLERANCE = 1e-5
BLOCK = 256                     # texts of a group that one task compares with as many others

_ODD = np.random.default_rng(20240).integers(1, 2**63, SIGNATURE // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text."""
    w = words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w), dtype=np.uint64, count=len(w))
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = (out ^ h[j:len(h) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """SIGNATURE 32-bit minima; one 64-bit product serves two of them."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(s), 512):
        part = s[i:i + 512, None] * _ODD[None, :]
        part ^= part >> np.uint64(29)
        np.minimum(out, part.view(np.uint32).min(axis=0), out=out)
    return out


def least_matches(steps: int = SIGNATURE // STEP) -> list[int]:
    """Per step the smallest number of equal values at which a pair stays in play.

    With m of n equal, the posterior of the similarity is Beta(m + 1, n - m + 1); its mass beyond
    the threshold is the probability of at most m successes in n + 1 trials at the threshold.
    """
    from math import comb

    out = []
    for k in range(1, steps + 1):
        n, mass, m = k * STEP, 0.0, -1
        while mass < TOLERANCE:
            m += 1
            mass += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD)**(n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, th, hi, lo, bands): 128 bits for the set of shingles, one key per band. Texts with words only.

    doc and th, the hash of the text, name a row.
    """
    def make():
        def run(columns):
            for key, th, t in zip(*columns):
                s = shingles(t)
                if not len(s):
                    continue
                raw, sig = s.tobytes(), signature(s).reshape(BANDS, ROWS)
                bands = [xxhash.xxh3_64_intdigest(sig[b].tobytes(), seed=b) - 2**63 for b in range(BANDS)]
                yield key, th, xxhash.xxh3_64_intdigest(raw) - 2**63, xxhash.xxh3_64_intdigest(raw, seed=1) - 2**63, bands
        return run

    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("doc"), text_hash(text).alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows, make, f"doc {kind}, th bigint, hi bigint, lo bigint, bands array<bigint>")


def distinct_sets(sketch: DataFrame) -> DataFrame:
    """(hi, lo, doc, th, node, copies): one row per set: its first row, the number of that row, its number of documents.

    First is the smallest id, then the smallest hash of the text.
    """
    per_doc = sketch.groupBy("hi", "lo", "doc").agg(F.min("th").alias("th"), F.min_by("node", "th").alias("node"))
    # doc is unique within a set here, so hash and number belong to the smallest document
    return per_doc.groupBy("hi", "lo").agg(F.min("doc").alias("doc"), F.min_by("th", "doc").alias("th"),
                                           F.min_by("node", "doc").alias("node"), F.count("*").alias("copies"))


def candidate_groups(sketch: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root): sets (by the number of their first row) that share buckets, tied into groups."""
    # copies are represented by the first of their set
    firsts = sketch.join(sets.select("node").hint("merge"), "node", "left_semi")
    keys = firsts.select("node", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("b")).where("hub <> b")
    buckets = written(buckets.select("band", "hub"), "buckets")
    ties = keys.join(buckets.hint("merge"), "band").where("node <> hub").select("node", "hub").distinct()
    return components(ties.select(F.col("node").alias("a"), F.col("hub").alias("b")))


def compare_blocks(rows: DataFrame) -> DataFrame:
    """rows (root, i, j, side, node, copies, text), sorted by group and pair of blocks.

    Returns (node, n, tie): links of a text within the pair of blocks, copies counted, and the
    smallest text of the tree that it belongs to there.
    """
    minimum = least_matches()

    def run(batches):
        held, key = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != key:
                    if held:
                        yield from _out(_links(held, key, minimum))
                    held, key = [], row[:3]
                held.append(row[3:])
        if held:
            yield from _out(_links(held, key, minimum))

    def _out(found):
        out = list(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["node", "n", "tie"])

    return rows.select("root", "i", "j", "side", "node", "copies", "text").mapInArrow(run, "node bigint, n bigint, tie bigint")


def _links(held: list[tuple], key: tuple, minimum: list[int]):
    """Links of one pair of blocks; held: (side, node, copies, text)."""
    # repeated rows of a text count once
    held = list({(r[0], r[1]): r for r in sorted(held, key=lambda r: (r[0], r[1]))}.values())
    nodes, copies, side = [r[1] for r in held], np.array([r[2] for r in held]), np.array([r[0] for r in held])
    sets = [shingles(r[3]) for r in held]
    sigs = np.stack([signature(s) for s in sets])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    # all shingles in a row, numbered: one pass over them counts what a text shares with every other
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(int(number.max()) + 1, dtype=bool)
    same = key[1] == key[2]
    left = np.flatnonzero(side == 0)
    links, parent = np.zeros(len(held), dtype=np.int64), list(range(len(held)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in left.tolist():
        others = np.arange(a + 1, len(held)) if same else np.flatnonzero(side == 1)
        # sizes alone can rule a pair out exactly
        small, large = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        others = others[small >= THRESHOLD * large]
        equal = np.zeros(len(others), dtype=np.int64)
        for k, least in enumerate(minimum):
            if not len(others):
                break
            equal += (sigs[others, k * STEP:(k + 1) * STEP] == sigs[a, k * STEP:(k + 1) * STEP]).sum(axis=1)
            stay = equal >= least
            others, equal = others[stay], equal[stay]
        if len(others) > 8:
            own = number[begin[a]:begin[a + 1]]
            flag[own] = True
            shared = np.add.reduceat(flag[number], begin[:-1], dtype=np.int64)[others].tolist()
            flag[own] = False
        else:
            shared = [_common(sets[a], sets[b]) for b in others.tolist()]
        for b, common in zip(others.tolist(), shared):
            if common >= THRESHOLD * (sizes[a] + sizes[b] - common):
                links[a] += copies[b]
                links[b] += copies[a]
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    for i, d in enumerate(nodes):
        if links[i]:
            yield d, int(links[i]), nodes[find(i)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, class_id, first_th, n_links) for every text that has words and an id; th is the hash of the text.

    class_id and first_th name the first row of the class: the smallest id, then the smallest hash.
    """
    # rows get their numbers in a written table, so they stay; no result depends on them
    sketch = written(sketches(docs, id_col, text).withColumn("node", F.monotonically_increasing_id()), "sketches")
    sets = written(distinct_sets(sketch), "sets")
    groups = written(candidate_groups(sketch, sets), "groups")
    # blocks by hash: about BLOCK texts each, no sort over a large group
    sized = groups.groupBy("root").agg(F.count("*").alias("m"))
    dealt = (groups.join(sized, "root").join(sets.select("node", "doc", "th", "copies"), "node")
             .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
             .select("doc", "th", "node", "root", "copies", "blocks", "block"))
    dealt = written(dealt, "dealt")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), text_hash(text).alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    # the candidates grow with the corpus: a merge join at every size
    texts = texts.join(dealt.hint("merge"), ["doc", "th"])
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(
        F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    rows = texts.select("root", "copies", "node", "text", "block", F.explode(pair).alias("p")).select(
        "root", F.col("p.i").alias("i"), F.col("p.j").alias("j"),
        F.when(F.col("block") == F.col("p.i"), 0).otherwise(1).alias("side"), "node", "copies", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node")
    found = written(compare_blocks(rows), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("tie").alias("b"))).join(sets.select("node", "doc", "th"), "node")
    first = linked.groupBy("root").agg(F.min(F.struct("doc", "th")).alias("f"))
    classes = linked.join(first, "root").select("node", F.col("f.doc").alias("class_id"), F.col("f.th").alias("first_th"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    per_set = sets.join(links, "node", "left").join(classes, "node", "left").select(
        "hi", "lo", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("first_th", "th").alias("first_th"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sketch.select("doc", "th", "hi", "lo").distinct().join(per_set, ["hi", "lo"]).select(
        "doc", "th", "class_id", "first_th", "n_links")


def join_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id, n_links."""
    ids = docs.select(F.col(f"`{id_col}`").alias("doc"), text_hash(text).alias("th"))
    return ids.join(near_duplicates(docs, id_col, text), ["doc", "th"], "left").select(
        F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id, of several texts under that id the one with the smallest hash.

    Repeated rows (same id and text) stay or go together.
    """
    copies = near_duplicates(docs).where("doc <> class_id OR th <> first_th").select("doc", "th")
    keyed = docs.select(in_row(docs), F.col("doc_id").alias("doc"), text_hash("text").alias("th"))
    return keyed.join(written(copies, "near-copies").hint("merge"), ["doc", "th"], "left_anti").select(*row_fields(docs))

"""Near duplicates by SetSketch registers: two-word shingles with a similarity of 0.8 or more.

1. Sketch. Every shingle has an exponential hash per register; a register keeps the logarithm, to
   base BASE, of the smallest one: exponentially spaced, truncated minima of one byte. Registers of a
   union are the maxima of both (merge), and two registers agree about as often as the sets do.
   Texts with the same set of shingles are one node from here on; copies are never paired.
2. Bands. BANDS groups of BAND_ROWS registers are keys. Nodes that share one are candidates.
3. Estimate. Of two nodes the numbers of registers that are larger, smaller and equal have a joint
   likelihood in the similarity (the sizes of the sets are known). It is concave; a pair goes if
   the threshold lies more than SLACK below the maximum, about five standard deviations.
4. Verify. What stays is decided on the full sets of shingles.

Links are looked for until every candidate pair lies within one component or has been decided:
first every node against the smallest node of its buckets, by joins. Buckets that still hold several
components are then compared by registers in blocks of BLOCK nodes, each a task input of bounded
size; a pair belongs to the first band it shares. What leaves a task is a forest of likely pairs, not
the pairs. Its trees are groups of texts that are all close to others (0.7 or more); the sets of a
group are compared in blocks again, likeliest pairs first, pairs within one component never. What leaves
such a task is a forest of verified links. So rows grow with nodes (times blocks of their
group), not with pairs, also where many texts lie just below the threshold.

A pair at the threshold shares no band with probability (1 - 0.808^6)^42 = 1e-6.

Words are maximal stretches without space, tab, line feed, vertical tab, form feed and carriage
return, A-Z in lower case. A text of one word is one shingle.

Defined results: texts without words (NULL, empty) have no shingle and are their own component.
Rows that share an id are texts of their own, each with its own component; the id is named by
either. component_id is the smallest id of the component; NULL ids count only where there is no other.
kept: the id is the component's id (NULL and NULL count as equal). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import table, written
from isotherm.llm.components import components
from isotherm.llm.words import lowered, map_rows

SHINGLE, THRESHOLD = 2, 0.8
BAND_ROWS, BANDS = 6, 42
REGISTERS = BAND_ROWS * BANDS
BASE, RATE, LARGEST = 1.1, 20.0, 255
SLACK = 12.0                    # natural logarithm of the likelihood ratio
BLOCK = 1024                    # nodes of a bucket or group that one task compares with as many others
CHUNK = 100_000                 # pairs whose likelihoods are computed at a time

_ODD = np.random.default_rng(1971).integers(1, 2**63, REGISTERS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (BASE - 1) / BASE


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingles."""
    w = lowered(text).split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w), dtype=np.uint64, count=len(w))
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = (out ^ h[j:len(h) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(s: np.ndarray) -> np.ndarray:
    """REGISTERS bytes of a set that is not empty."""
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(s), 512):
        # one 64-bit product gives the uniform hashes of two registers
        part = s[i:i + 512, None] * _ODD[None, :]
        part ^= part >> np.uint64(29)
        np.minimum(low, part.view(np.uint32).min(axis=0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0**32) / RATE     # of exponential variables
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LARGEST).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, for the share x of the union it has alone."""
    return -np.log1p(-np.maximum(x, 1e-12) * _STEP) / np.log(BASE)


def _log_likelihood(j, u, v, more, less, equal):
    p, q = _share(u - v * j), _share(v - u * j)
    return more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))


def _slope(j, u, v, more, less, equal):
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p, q = _share(x), _share(y)
    dp, dq = _STEP / (1 - x * _STEP) / np.log(BASE), _STEP / (1 - y * _STEP) / np.log(BASE)
    return -more * v * dp / p - less * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)


def estimate(more, less, equal, n1, n2) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, whether the threshold is still possible) from counts of registers and sizes of sets."""
    u = n1 / (n1 + n2)
    v = 1 - u
    top = np.minimum(u / v, v / u)          # no higher similarity at these sizes
    lo, hi = np.zeros_like(top), top.copy()
    for _ in range(24):
        mid = (lo + hi) / 2
        up = _slope(mid, u, v, more, less, equal) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    j = (lo + hi) / 2
    at = np.minimum(THRESHOLD, top)
    best = _log_likelihood(j, u, v, more, less, equal)
    return j, (j >= at) | (_log_likelihood(at, u, v, more, less, equal) >= best - SLACK)


def fits(n1, n2):
    """The sizes of two sets allow the threshold."""
    return 100 * np.minimum(n1, n2) >= 80 * np.maximum(n1, n2)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, on sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _text_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))


def _signed(h: int) -> int:
    return h - (1 << 63)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return _signed(xxhash.xxh3_64_intdigest(raw)), _signed(xxhash.xxh3_64_intdigest(raw, seed=1))


def sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, tkey, hi, lo, n, regs, bands, row) of every row; tkey finds the text again, (hi, lo) stands for the set."""
    def make():
        def run(columns):
            for doc, key, t in zip(*columns):
                s = shingles(t)
                if not len(s):
                    yield doc, key, None, None, 0, None, None
                    continue
                r = registers(s)
                parts = r.reshape(BANDS, BAND_ROWS)
                yield (doc, key, *_set_key(s), len(s), r.tobytes(),
                       [_signed(xxhash.xxh3_64_intdigest(parts[b].tobytes(), seed=b)) for b in range(BANDS)])
        return run

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), _text_key(id_col, text), F.col(f"`{text}`").cast("string"))
    out = map_rows(rows, make, f"doc {kind}, tkey bigint, hi bigint, lo bigint, n bigint, regs binary, bands array<bigint>")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "sketches")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(band, hub, node) of the bands that several nodes share; hub is the smallest of them."""
    keys = nodes.select("node", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_top")).where("hub <> _top").select("band", "hub")
    return written(keys.join(written(hubs, "hubs"), "band").select("band", "hub", "node"), "buckets")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, items): the shingles of the given (node, tkey, hi, lo)."""
    def make():
        last = None

        def run(columns):
            nonlocal last
            for node, hi, lo, t in zip(*columns):
                # rows repeated as a whole come one after the other
                if node == last:
                    continue
                s = shingles(t)
                # another text may have the same key
                if len(s) and _set_key(s) == (hi, lo):
                    last = node
                    yield node, s.tobytes()
        return run

    # the nodes grow with the corpus: a merge join at every size
    texts = docs.select(_text_key(id_col, text).alias("tkey"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = texts.join(nodes.hint("merge"), "tkey").select("node", "hi", "lo", "t")
    return written(map_rows(rows, make, "node bigint, items binary"), "sets")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that may reach the threshold by the sizes of their sets and their registers."""
    side = {x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}")) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").where(
        100 * F.least("n_a", "n_b") >= 80 * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n1, n2 = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.float64) for i in (2, 3))
            r1, r2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for i in (4, 5))
            more, less = (r1 > r2).sum(axis=1), (r1 < r2).sum(axis=1)
            stay = estimate(more, less, REGISTERS - more - less, n1, n2)[1]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(stay)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    side = {x: sets.select(F.col("node").alias(x), F.col("items").alias(f"s_{x}")) for x in "ab"}
    both = pairs.join(side["b"], "b").join(side["a"], "a").select("a", "b", "s_a", "s_b")

    def make():
        def run(columns):
            for a, b, x, y in zip(*columns):
                if linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)):
                    yield a, b
        return run

    return written(map_rows(both, make, "a bigint, b bigint"), "links")


def other_hubs(buckets: DataFrame, tried: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): nodes with the smallest nodes of their buckets that lie in another component, without the pairs tried."""
    of = {x: labels.select(F.col("node").alias(x), F.col("root").alias(f"l_{x}")) for x in "ab"}
    pairs = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    named = pairs.join(of["a"], "a", "left").join(of["b"], "b", "left").where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b"))
    return named.select("a", "b").join(tried, ["a", "b"], "left_anti")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, label) of buckets with nodes of several components and more pairs than those with the hub."""
    named = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("root", "node").alias("label"))
    still = named.groupBy("band").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("m")).where(
        "_a <> _b and m > 2").select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    return written(named.join(still, "band"), "open-buckets")


def dealt(rows: DataFrame, key: str, extra: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (key, node, label, blocks) into pairs of blocks (key, i, j, side, node, label, columns), one after the other."""
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"), (x < F.col("block")).cast("int").alias("side")))
    each = rows.withColumn("block", block).select(key, "node", "label", F.explode(pair).alias("p")).select(
        key, "p.i", "p.j", "p.side", "node", "label").join(extra, "node").select(key, "i", "j", "side", "node", "label", *columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j")


def _by_blocks(rows: DataFrame, compare) -> DataFrame:
    """(a, b) that compare(key, rows of one pair of blocks) yields."""
    def run(batches):
        held, key = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != key:
                    if held:
                        yield from out(compare(key, held))
                    held, key = [], row[:3]
                held.append(row[3:])
        if held:
            yield from out(compare(key, held))

    def out(pairs):
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        """False if both were in one tree already."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def likely_pairs(key: tuple, side: np.ndarray, label: np.ndarray, n: np.ndarray, regs: np.ndarray, allowed):
    """Arrays (x, y, similarity) of places of one pair of blocks: different labels, allowed, and the threshold possible."""
    held, size = [], 0

    def judged():
        x, y, more, less = (np.concatenate(c) for c in zip(*held))
        j, stay = estimate(more, less, REGISTERS - more - less, n[x], n[y])
        return x[stay], y[stay], j[stay]

    for x in np.flatnonzero(side == 0).tolist():
        y = np.arange(x + 1, len(side)) if key[1] == key[2] else np.flatnonzero(side == 1)
        y = y[(label[y] != label[x]) & fits(n[y], n[x])]
        y = allowed(x, y)
        if not len(y):
            continue
        held.append((np.full(len(y), x), y, (regs[y] < regs[x]).sum(axis=1), (regs[y] > regs[x]).sum(axis=1)))
        size += len(y)
        if size >= CHUNK:
            yield judged()
            held, size = [], 0
    if held:
        yield judged()


def _columns(held: list[tuple]) -> tuple[np.ndarray, ...]:
    held.sort(key=lambda r: r[:2])
    side, node, label = (np.array([r[i] for r in held], dtype=np.int64) for i in range(3))
    n = np.array([r[3] for r in held], dtype=np.float64)
    return side, node, label, n, np.frombuffer(b"".join(r[4] for r in held), dtype=np.uint8).reshape(-1, REGISTERS)


def _close(key: tuple, held: list[tuple]) -> list[tuple]:
    """A forest of likely pairs of one pair of blocks of a bucket; held: (side, node, label, n, regs, bands)."""
    side, node, label, n, regs = _columns(held)
    bands = np.array([r[5] for r in held], dtype=np.int64)
    mine = (bands == key[0]).argmax(axis=1)         # the place of this bucket's band

    def first_band(x, y):
        return y[~(bands[y, :mine[x]] == bands[x, :mine[x]]).any(axis=1)]

    trees, out = Forest(), []
    for x, y, _ in likely_pairs(key, side, label, n, regs, first_band):
        out += [(a, b) for a, b in zip(node[x].tolist(), node[y].tolist()) if trees.join(a, b)]
    return out


def _links(key: tuple, held: list[tuple]) -> list[tuple]:
    """A forest of verified links of one pair of blocks of a group; held: (side, node, label, n, regs, items)."""
    side, node, label, n, regs = _columns(held)
    items = [np.frombuffer(r[5], dtype=np.uint64) for r in held]
    trees, out = Forest(), []                       # over labels: what is in one component needs no more links
    for x, y, j in likely_pairs(key, side, label, n, regs, lambda _, y: y):
        for i in np.argsort(-j, kind="stable").tolist():
            a, b = int(x[i]), int(y[i])
            p, q = int(label[a]), int(label[b])
            if trees.find(p) != trees.find(q) and linked(items[a], items[b]):
                trees.join(p, q)
                out.append((int(node[a]), int(node[b])))
    return out


def remaining_links(open_: DataFrame, nodes: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b): links that tie the components of open buckets as far as any links do."""
    close = written(_by_blocks(dealt(open_, "band", nodes.select("node", "n", "regs", "bands"), ["n", "regs", "bands"]), _close), "close")
    groups = written(components(close).withColumnRenamed("root", "group"), "close-groups")
    sized = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    named = groups.join(sized, "group").join(open_.select("node", "label").distinct(), "node").select("group", "node", "label", "blocks")
    extra = nodes.select("node", "n", "regs").join(items, "node")
    return written(_by_blocks(dealt(named, "group", extra, ["n", "regs", "items"]), _links), "links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    sketch = sketches(docs, id_col, text)
    sets = written(sketch.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("node"), F.min("doc").alias("first")), "classes")
    nodes = written(sketch.join(sets.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), "tkey", "hi", "lo", "n", "regs", "bands"), "nodes")
    buckets = shared_buckets(nodes)
    # sets are read once, for the nodes that share a bucket at all
    wanted = nodes.select("node", "tkey", "hi", "lo").join(buckets.select("node").distinct(), "node", "left_semi")
    items = full_sets(docs, wanted, id_col, text)

    hub = buckets.where("node <> hub").groupBy("node").agg(F.min("hub").alias("a")).select("a", F.col("node").alias("b"))
    links = verified(likely(hub, nodes), items)
    labels = written(components(links), "labels")
    links = links.unionByName(verified(likely(other_hubs(buckets, hub, labels), nodes), items))
    labels = written(components(links), "labels")
    still = open_buckets(buckets, labels)
    if not still.isEmpty():
        links = links.unionByName(remaining_links(still, nodes, items))
        labels = written(components(links), "labels")

    tied = labels.join(sets.select("node", "first"), "node")
    low = tied.groupBy("root").agg(F.min("first").alias("low"))
    named = tied.join(low, "root").select("node", "low")
    per_set = sets.join(named, "node", "left").select("hi", "lo", F.coalesce("low", "first").alias("component"))
    with_words = sketch.where("n > 0").select("doc", "n", "hi", "lo").join(per_set, ["hi", "lo"]).select("doc", "n", "component")
    rows = with_words.unionByName(sketch.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                       F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def op12_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))

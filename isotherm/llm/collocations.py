"""Phrase collocations: word n-grams counted exactly in counting quotient filters.

1. Shards. A task deals its texts into shards of at most SHARD words of one language: the words seen
   (a local dictionary with counts) and the stream of their numbers, with 0 between pieces.
2. Words. The dictionaries' entries meet by word, once, and add up to the counts of all words. Words
   of MIN_COUNT or more get numbers, from 1; the streams are rewritten with them, all other words become 0: a phrase that
   holds one cannot be frequent.
3. Phrases of 2, 3, 4, 5 words. A phrase is packed: its word numbers stand side by side in as few
   64-bit lanes as hold them. A permutation of the lanes that can be inverted spreads the
   keys evenly; its first bits are the range, and of the rest the quotient says how many keys
   share it, while the remainder is stored in full. So nothing is lost. A shard gives one filter
   per range, sorted by key; the filters of a range are merged over all shards, adding up counts.
   A phrase is one entry per shard, however frequent, and ranges are even: no hot keys.
4. After each length a shard is told which of its phrases are frequent, and keeps only the words of
   stretches in which each phrase of that length is; the next length looks at those only.

Scores, cuts and ranks are Spark SQL on the frequent phrases, in decimal arithmetic.

Rules: A-Z in lower case; pieces end at . , ; : ! ? and line feed, vertical tab, form feed, carriage
return; words at space and tab. A phrase is dropped if a longer candidate that holds it is as
frequent; as counts only fall with length, it is enough to look at those longer by one word.

Defined results: NULL text is empty; a NULL lang counts as "und", together with a lang of that name.
Repeated rows count as often as they occur. Ties: score, then count, then phrase in UTF-8 order. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.llm.common import table, written
from isotherm.llm.words import PIECE, lowered

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
SHARD = 1_000_000               # words of a shard; a longer text is a shard of its own
RANGE = 1_000_000               # phrases that a range is sized for
SALTS = 64
BUCKETS = 256                   # groups of words that are numbered together

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
U = np.uint64


# ---- packed phrases ------------------------------------------------------------
class Packing:
    """Phrases of k word numbers below 2**bits as lanes of at most 64 bits, permuted."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits = k, bits
        lanes = -(-k // (64 // bits))
        # words per lane, as even as possible, the first lanes longer
        self.words = [k // lanes + (i < k % lanes) for i in range(lanes)]
        self.widths = [w * bits for w in self.words]

    def _mask(self, lane: int) -> np.uint64:
        return U((1 << self.widths[lane]) - 1)

    def _mix(self, x: np.ndarray, lane: int) -> np.ndarray:
        """A permutation of the numbers of a lane's width."""
        mask, half = self._mask(lane), U(self.widths[lane] // 2 + 1)
        for m in (_M1, _M2):
            x = (x * U(m)) & mask
            x = x ^ (x >> half)
        return x

    def _unmix(self, x: np.ndarray, lane: int) -> np.ndarray:
        width = self.widths[lane]
        mask, half = self._mask(lane), U(width // 2 + 1)
        for m in (_M2, _M1):
            x = x ^ (x >> half)     # twice the shift exceeds the width: its own inverse
            x = (x * U(pow(m, -1, 1 << 64))) & mask
        return x

    def keys(self, grams: np.ndarray) -> list[np.ndarray]:
        """(n, k) word numbers -> permuted lanes."""
        lanes, at = [], 0
        for w in self.words:
            x = np.zeros(len(grams), dtype=np.uint64)
            for c in range(at, at + w):
                x = (x << U(self.bits)) | grams[:, c].astype(np.uint64)
            lanes.append(x)
            at += w
        n = len(lanes)
        for _ in range(2):
            for i in range(n):
                x = lanes[i] ^ (lanes[i - 1] & self._mask(i)) if n > 1 else lanes[i]
                lanes[i] = self._mix(x, i)
        return lanes

    def grams(self, lanes: list[np.ndarray]) -> np.ndarray:
        """The inverse of keys."""
        lanes, n = list(lanes), len(lanes)
        for _ in range(2):
            for i in reversed(range(n)):
                x = self._unmix(lanes[i], i)
                lanes[i] = x ^ (lanes[i - 1] & self._mask(i)) if n > 1 else x
        out, at = np.empty((len(lanes[0]), self.k), dtype=np.int32), 0
        for x, w in zip(lanes, self.words):
            for c in range(at + w - 1, at - 1, -1):
                out[:, c] = (x & U((1 << self.bits) - 1)).astype(np.int32)
                x = x >> U(self.bits)
            at += w
        return out


class CountingQuotientFilter:
    """Sorted distinct keys with counts: a quotient (first bits), the full remainder, a counter of as few bytes as it needs."""

    def __init__(self, lanes: list[np.ndarray], counts: np.ndarray, widths: list[int]):
        self.lanes, self.counts, self.widths = lanes, counts, widths

    @classmethod
    def of(cls, lanes: list[np.ndarray], counts: np.ndarray, widths: list[int]) -> "CountingQuotientFilter":
        """Any keys with counts, repeated ones added up."""
        order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
        lanes, counts = [x[order] for x in lanes], counts[order]
        if len(counts):
            new = np.ones(len(counts), dtype=bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lanes])
            first = np.flatnonzero(new)
            lanes, counts = [x[first] for x in lanes], np.add.reduceat(counts, first)
        return cls(lanes, counts, widths)

    @classmethod
    def merged(cls, filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        return cls.of([np.concatenate(x) for x in zip(*(f.lanes for f in filters))],
                      np.concatenate([f.counts for f in filters]), filters[0].widths)

    def __len__(self) -> int:
        return len(self.counts)

    def parts(self, bits: int):
        """(range, filter) by the first bits of the keys, ranges that have keys only."""
        of = self.lanes[0] >> U(self.widths[0] - bits) if bits else np.zeros(len(self), dtype=np.uint64)
        ranges, begin = np.unique(of, return_index=True)
        for r, a, b in zip(ranges.tolist(), begin.tolist(), [*begin.tolist()[1:], len(self)]):
            yield r, CountingQuotientFilter([x[a:b] for x in self.lanes], self.counts[a:b], self.widths)

    def to_bytes(self, skip: int = 0) -> bytes:
        """skip: leading bits that all keys have in common; they are not stored."""
        n, width = len(self), self.widths[0] - skip
        q = min(width, max(0, n.bit_length() - 1))      # about one key per quotient
        rest = self.lanes[0] & U((1 << width) - 1)
        load = np.bincount((rest >> U(width - q)).astype(np.int64), minlength=1 << q)
        out = [np.array([n, int(load.max(initial=0) > 255)], dtype="<i8").tobytes(),
               load.astype("<u4" if load.max(initial=0) > 255 else "u1").tobytes()]
        out += [_low_bytes(x, w) for x, w in zip([rest & U((1 << (width - q)) - 1), *self.lanes[1:]], [width - q, *self.widths[1:]])]
        large = self.counts >= 255
        out += [np.where(large, 255, self.counts).astype("u1").tobytes(), self.counts[large].astype("<i8").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes, widths: list[int], skip: int = 0, prefix: int = 0) -> "CountingQuotientFilter":
        n, wide = np.frombuffer(raw, "<i8", 2).tolist()
        width = widths[0] - skip
        q, at = min(width, max(0, n.bit_length() - 1)), 16
        load = np.frombuffer(raw, "<u4" if wide else "u1", 1 << q, at)
        at += load.nbytes
        lanes = []
        for w in (width - q, *widths[1:]):
            x, size = _from_low_bytes(raw, at, n, w)
            lanes.append(x)
            at += size
        lanes[0] = lanes[0] | (np.repeat(np.arange(1 << q, dtype=np.uint64), load) << U(width - q) if q else U(0))
        if skip:
            lanes[0] = lanes[0] | U(prefix << width)
        counts = np.frombuffer(raw, "u1", n, at).astype(np.int64)
        large = counts == 255
        counts[large] = np.frombuffer(raw, "<i8", int(large.sum()), at + n)
        return cls(lanes, counts, widths)


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    size = -(-width // 8)
    return x.astype("<u8").view("u1").reshape(-1, 8)[:, :size].tobytes()


def _from_low_bytes(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = -(-width // 8)
    out = np.zeros((n, 8), dtype="u1")
    if size:
        out[:, :size] = np.frombuffer(raw, "u1", n * size, at).reshape(n, size)
    return out.view("<u8").reshape(-1).astype(np.uint64), n * size


# ---- shards --------------------------------------------------------------------
def pieces(text: str | None) -> list[list[bytes]]:
    return [w for w in (p.split() for p in lowered(text).translate(_ENDS).split(b"\n")) if w]


def shards(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(shard, lang, words, counts, stream): stream holds 1 + the place of each word in words, 0 between pieces."""
    def run(batches):
        open_: dict[str, tuple[dict, list]] = {}

        def closed(name):
            number, stream = open_.pop(name)
            ids = np.array(stream, dtype=np.int32)
            counts = np.bincount(ids, minlength=len(number) + 1)[1:]
            return pa.RecordBatch.from_arrays([
                pa.array([name], pa.string()), pa.array([[w.decode() for w in number]], pa.list_(pa.string())),
                pa.array([counts.astype(np.int64)], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())],
                names=["lang", "words", "counts", "stream"])

        for batch in batches:
            for name, t in zip(*[c.to_pylist() for c in batch.columns]):
                found = pieces(t)
                if not found:
                    continue
                number, stream = open_.setdefault(name, ({}, []))
                for p in found:
                    stream.extend([number.setdefault(w, len(number)) + 1 for w in p])
                    stream.append(0)
                if len(stream) >= SHARD:
                    yield closed(name)
        for name in list(open_):
            yield closed(name)

    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    made = rows.mapInArrow(run, "lang string, words array<string>, counts array<bigint>, stream binary")
    return written(made.withColumn("shard", F.monotonically_increasing_id()), "shards")


def frequent_words(shard: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, id, shard, pos): frequent words with ids from 1 without gaps, and their places in the dictionaries.

    All entries of a word lie in one of BUCKETS, where windows add them up and number the words.
    """
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int")
    entries = shard.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select(
        "lang", F.col("x.words").alias("word"), "shard", "pos", F.col("x.counts").alias("n")).withColumn("b", bucket)
    of_word, of_bucket = W.partitionBy("b", "lang", "word"), W.partitionBy("b").orderBy("lang", "word")
    often = entries.repartition(BUCKETS, "b").withColumn("f", F.sum("n").over(of_word)).where(F.col("f") >= min_count)
    found = written(often.withColumn("r", F.dense_rank().over(of_bucket)).drop("n"), "words")
    before, starts = 0, [0] * BUCKETS
    # one row per bucket
    for r in found.groupBy("b").agg(F.max("r").alias("n")).orderBy("b").collect():
        starts[r.b] = before
        before += r.n
    return found.withColumn("id", (F.element_at(F.array(*map(F.lit, starts)), F.col("b") + 1) + F.col("r")).cast("int")).select(
        "lang", "word", "f", "id", "shard", "pos")


def windows(stream: np.ndarray, k: int) -> np.ndarray:
    """(n, k): the phrases of k words that hold no 0."""
    if len(stream) < k:
        return np.empty((0, k), dtype=np.int32)
    all_ = np.lib.stride_tricks.sliding_window_view(stream, k)
    return all_[(all_ != 0).all(axis=1)]


def _squeezed(stream: np.ndarray) -> np.ndarray:
    """One 0 in place of several."""
    stay = (stream != 0) | np.append(True, stream[:-1] != 0)
    return stream[stay]


def _emitted(shard: int, lang: str, stream: np.ndarray, packing: Packing, range_bits: int):
    """The stream (range NULL) and one filter per range."""
    grams = windows(stream, packing.k)
    if not len(grams):
        return
    whole = CountingQuotientFilter.of(packing.keys(grams), np.ones(len(grams), dtype=np.int64), packing.widths)
    yield shard, lang, None, stream.tobytes()
    for r, part in whole.parts(range_bits):
        yield shard, lang, r, part.to_bytes(range_bits)


STEP = "shard bigint, lang string, range bigint, data binary"


def _rows_out(rows, names, types):
    rows = list(rows)
    for i in range(0, len(rows), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i:i + PIECE]), types)], names=names)


_STEP_OUT = (["shard", "lang", "range", "data"], [pa.int64(), pa.string(), pa.int64(), pa.binary()])


def first_step(shard: DataFrame, often: DataFrame, packing: Packing, range_bits: int) -> DataFrame:
    """Streams of frequent words' numbers and the filters of their phrases of two words."""
    places = often.groupBy("shard").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
    rows = shard.select("shard", "lang", F.size("words").alias("n"), "stream").join(places, "shard").select(
        "shard", "lang", "n", "stream", "ids.pos", "ids.id")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):        # one shard at a time
                key, lang, n, stream, pos, id_ = (c[0].as_py() for c in batch.slice(at, 1).columns)
                number = np.zeros(n + 1, dtype=np.int32)
                number[np.array(pos) + 1] = id_
                yield from _rows_out(_emitted(key, lang, _squeezed(number[np.frombuffer(stream, np.int32)]), packing, range_bits), *_STEP_OUT)

    return written(rows.mapInArrow(run, STEP), "phrases-2")


def next_step(step: DataFrame, known: DataFrame, before: Packing, packing: Packing, range_bits: int) -> DataFrame:
    """The same for phrases longer by one word: known are the frequent phrases of each shard."""
    mine = known.groupBy("shard").agg(F.collect_list("data").alias("known"))
    rows = step.where("range is null").select("shard", "lang", "data").join(mine, "shard").select("shard", "lang", "data", "known")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                key, lang, stream, blobs = (c[0].as_py() for c in batch.slice(at, 1).columns)
                kept = _stretches(np.frombuffer(stream, np.int32), np.frombuffer(b"".join(blobs), np.int32).reshape(-1, before.k), before)
                yield from _rows_out(_emitted(key, lang, kept, packing, range_bits), *_STEP_OUT)

    return written(rows.mapInArrow(run, STEP), f"phrases-{packing.k}")


def _stretches(stream: np.ndarray, frequent: np.ndarray, packing: Packing) -> np.ndarray:
    """Words of the phrases longer by one in which both phrases of k words are frequent; 0 between stretches."""
    k = packing.k
    if len(stream) <= k or not len(frequent):
        return np.empty(0, dtype=np.int32)
    keys = packing.keys(np.lib.stride_tricks.sliding_window_view(stream, k))
    wanted = packing.keys(frequent)
    if len(keys) > 1:
        # lanes become one number each way: the rank among the frequent ones' lanes
        keys, wanted = _ranked(keys, wanted)
    else:
        keys, wanted = keys[0], wanted[0]
    known = np.isin(keys, wanted)
    # a 0 packs like a word, but no frequent phrase holds one
    both = known[:-1] & known[1:]
    keep = np.zeros(len(stream), dtype=bool)
    for i in range(k + 1):
        keep[i:i + len(both)] |= both
    return _squeezed(np.where(keep, stream, 0).astype(np.int32))


def _ranked(keys: list[np.ndarray], wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of keys and of the wanted ones as one number each; keys that are not wanted in some lane get -1."""
    one, two = np.zeros(len(keys[0]), dtype=np.int64), np.zeros(len(wanted[0]), dtype=np.int64)
    for x, y in zip(keys, wanted):
        values, rank = np.unique(y, return_inverse=True)
        at = np.searchsorted(values, x)
        at[at == len(values)] = 0
        hit = values[at] == x
        # ranks of the pairs so far and of this lane
        pairs, two = np.unique(two * np.int64(len(values)) + rank, return_inverse=True)
        mine = np.where((one >= 0) & hit, one * np.int64(len(values)) + at, -1)
        where = np.searchsorted(pairs, mine)
        where[where == len(pairs)] = 0
        one = np.where((mine >= 0) & (pairs[where] == mine), where, -1)
    return one, two


def merged_counts(step: DataFrame, packing: Packing, range_bits: int, min_count: int) -> DataFrame:
    """Merged filters: (ids, f, NULL, NULL) of each frequent phrase, and (NULL, NULL, shard, data) of those that a shard has."""
    out = (["ids", "f", "shard", "data"], [pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()])
    parts = step.where("range is not null").select("range", "shard", "data")
    n = int(step.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(n, "range").sortWithinPartitions("range", "shard")

    def run(batches):
        held, key = [], None
        for batch in batches:
            for r, shard, data in zip(*[c.to_pylist() for c in batch.columns]):
                if r != key:
                    if held:
                        yield from _rows_out(merge(key, held), *out)
                    held, key = [], r
                held.append((shard, data))
        if held:
            yield from _rows_out(merge(key, held), *out)

    def merge(key, held):
        filters = [CountingQuotientFilter.from_bytes(d, packing.widths, range_bits, key) for _, d in held]
        whole = CountingQuotientFilter.merged(filters)
        often = whole.counts >= min_count
        if not often.any():
            return
        lanes = [x[often] for x in whole.lanes]
        for ids, f in zip(packing.grams(lanes).tolist(), whole.counts[often].tolist()):
            yield ids, f, None, None
        for (shard, _), one in zip(held, filters):
            mine, wanted = _ranked(one.lanes, lanes)
            has = np.isin(mine, wanted)
            if has.any():
                yield None, None, shard, packing.grams([x[has] for x in one.lanes]).tobytes()

    return written(rows.mapInArrow(run, "ids array<int>, f bigint, shard bigint, data binary"), f"counts-{packing.k}")


# ---- scores --------------------------------------------------------------------
def _whole(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(grams: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(ids, lang, a, l, r, n, score): the lowest-scoring cut of each phrase; grams (ids, f) of one word and more."""
    first = grams.where(F.size("ids") > 1).join(words.select(F.col("id").alias("w0"), "lang"), F.col("ids")[0] == F.col("w0")).join(
        totals, "lang").select("ids", "lang", F.col("f").alias("a"), "n")
    cuts = first.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1))).withColumns(
        {"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    both = cuts.join(grams.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(
        grams.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    each = both.withColumns({"_x": _whole(F.col("a") * 1000) * _whole("n"), "_y": _whole("l") * _whole("r")}).withColumn(
        "score", F.expr("cast(_x div _y as bigint)"))
    best = each.groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("ids", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(phrases: DataFrame) -> DataFrame:
    """Phrases (ids, a, ...) that no phrase longer by one word has with the same count."""
    k = F.size("ids")
    longer = phrases.where(k > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), k - 1), F.slice("ids", F.lit(2), k - 1))).alias("ids"), F.col("a").alias("_f"))
    most = longer.groupBy("ids").agg(F.max("_f").alias("_f"))
    return phrases.join(most, "ids", "left").where(F.col("_f").isNull() | (F.col("_f") < F.col("a"))).drop("_f")


def named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with their words, joined by a space."""
    each = phrases.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "word"), "id")
    text = each.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(text, "ids")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first phrases of each lang; each salt's first ones go ahead, so a large lang is no single task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = phrases.withColumn("_s", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def count_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT,
                  longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases (ids, f) of one to longest words, words (lang, word, f, id), totals (lang, n)), all counts exact."""
    shard = shards(docs, lang, text)
    totals = shard.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("n"))
    often = frequent_words(shard, min_count)
    ids = written(often.select("lang", "word", "f", "id").distinct(), "word-ids")
    grams = ids.select(F.array("id").alias("ids"), "f")
    most, total = ids.agg(F.max("id")).first()[0], totals.agg(F.sum("n")).first()[0]
    if most:
        bits = int(most).bit_length()
        step = known = before = None
        for k in range(2, longest + 1):
            packing = Packing(k, bits)
            # ranges by what can be there at most: all words, later the phrases found before
            spread = min(packing.widths[0], max(4, (total // RANGE).bit_length()))
            step = first_step(shard, often, packing, spread) if k == 2 else next_step(step, known, before, packing, spread)
            counts = merged_counts(step, packing, spread, min_count)
            grams = grams.unionByName(counts.where("ids is not null").select("ids", "f"))
            known, before = counts.where("shard is not null").select("shard", "data"), packing
    return grams, ids, totals


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST,
                 top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    grams, ids, totals = count_phrases(docs, lang, text, min_count, longest)
    found = ranked(named(without_parts(scored(grams, ids, totals)), ids), top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, p.i AS piece,
    regexp_extract_all(p.t, '[^\x20\x09]+') AS w
  FROM (SELECT lang, doc_id, unnest(list_transform(
          string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
          lambda t, i: {'t': t, 'i': i})) AS p
        FROM documents WHERE text IS NOT NULL)),
grams AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS k, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= 100),
cuts AS (SELECT lang, phrase, k, f, w, unnest(range(1, k)) AS c FROM often WHERE k > 1),
scores AS (
  SELECT s.lang, s.phrase, s.k, s.f AS a, l.f AS l, r.f AS r, t.n, s.c, s.w,
    (1000::HUGEINT * s.f::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts s JOIN often l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.c], ' ')
  JOIN often r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.c + 1:], ' ')
  JOIN totals t ON t.lang = s.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.lang = b.lang AND o.k > b.k AND 100 * o.a >= 100 * b.a
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
WHERE rank <= 2000
"""

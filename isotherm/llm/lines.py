"""Line dedup: lines within one edit of an earlier line go, by a join of deletion neighbourhoods.

Two lines are within one edit (insertion, deletion or substitution of a character) exactly if
one is the other without a character, or both are equal without their p-th characters. So every
line emits the hashed keys of all its variants: itself, itself without a character, and itself
without its p-th character together with p. Lines that meet at a key of the last sort are within
one edit pairwise, and so are a line and those it is a variant of. Thus the earliest line of a
key is found by an aggregate, and no pairs are formed. Two steps before that lose nothing:

* Equal lines meet first, by a hash aggregate; only the first of each text goes on.
* A single edit touches one third of a line. Only lines that share the other two thirds with a
  different line emit variants; no other line can have a partner.

The partner found is verified by its edit distance.

Rule: lines are compared in lower case with runs of (Unicode) white space as one space. Every line
that is not blank goes if an earlier one is equal; within one edit only lines of near_chars characters
or more are compared (by default NEAR_CHARS, as one edit turns one list mark into another; 0 compares all). "Earlier" is by document id, then
line number. A line goes if any earlier line lies within the bound, whether that one stays or not.
A caller may have lines of few words left alone (min_words); op5 and the pipeline do not.

Defined results: NULL text stays NULL and has no lines; documents whose id is NULL stay as they
are, as their order is unknown. Repeated rows (same id and text) are one document: of equal lines at the
same place all stay. Rows that share an id and differ in text are documents of their own; among them the
smaller line number is earlier, then the smaller hash of the text. A text of which every line went is
empty. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.llm.common import free_name, in_row, row_fields, table, text_hash, written
from isotherm.llm.words import map_rows

MIN_WORDS = 5                   # default of min_words
NEAR_CHARS = 9                  # default of near_chars: shorter lines are compared for equality only; 0 compares all within one edit
BATCH = 100_000                 # variants of an output batch


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def long_enough(line: str, min_words: int = MIN_WORDS) -> bool:
    return line != "" and line.count(" ") >= min_words - 1


def _signed(h: int) -> int:
    return h - (1 << 63)


def _thirds(line: str, nominal: int) -> list[int]:
    """Hashes of a line without each of its thirds, as cut for a line of the nominal length."""
    n, a, b = len(line), nominal // 3, 2 * nominal // 3
    first, last = line[:a], line[n - (nominal - b):] if nominal > b else ""
    parts = (line[n - (nominal - a):] if nominal > a else "", first + "\n" + last, line[:b])
    return [_signed(xxhash.xxh3_64_intdigest(p, seed=(nominal << 2) + i)) for i, p in enumerate(parts)]


def hashed_lines(docs: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc, th, no, h1, h2, keys) of the lines long enough to be compared.

    doc and th, the hash of the text, name a row. 128 bits stand for a line; keys are what a near line
    shares, NULL below near_chars. A line and one that is a
    character longer are cut at the same places if the longer one also counts as a line of one
    character less. A line that an Arrow batch has had already brings no keys again, so a line of
    very many documents is no hot key.
    """
    def make():
        def run(columns):
            had = set()
            for doc, th, t in zip(*columns):
                for no, raw in enumerate(t.split("\n") if t else ()):
                    line = normal(raw)
                    if long_enough(line, min_words):
                        h = xxhash.xxh3_128_intdigest(line)
                        n = len(line)
                        keys = None if n < near_chars or h in had else _thirds(line, n) + _thirds(line, n - 1)
                        had.add(h)
                        yield doc, th, no, _signed(h >> 64), _signed(h & (1 << 64) - 1), keys
        return run

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("doc"), text_hash(text).alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_rows(rows, make, f"doc {kind}, th bigint, no int, h1 bigint, h2 bigint, keys array<bigint>")


def first_places(lines: DataFrame) -> DataFrame:
    """(h1, h2, doc, th, no, n): first place and number of occurrences of every text."""
    # order within an id as one number: line number, then the upper half of the text's hash
    rank = F.shiftleft(F.col("no").cast("long"), 32) + F.shiftright("th", 32) + (1 << 31)
    per_doc = lines.withColumn("at", rank).groupBy("h1", "h2", "doc").agg(
        F.min("at").alias("at"), F.min_by("th", "at").alias("th"), F.count("*").alias("n"))
    # doc is unique within a text here, so the place belongs to the smallest document
    return per_doc.groupBy("h1", "h2").agg(
        F.min("doc").alias("doc"), F.min_by("th", "doc").alias("th"),
        F.shiftright(F.min_by("at", "doc"), 32).cast("int").alias("no"), F.sum("n").alias("n"))


def suspects(lines: DataFrame) -> DataFrame:
    """(h1): texts that share two thirds with a different text."""
    same = W.partitionBy("k")
    keys = lines.select("h1", F.explode("keys").alias("k")).select(
        "h1", F.min("h1").over(same).alias("a"), F.max("h1").over(same).alias("b"))
    return keys.where("a <> b").select("h1").distinct()


def suspect_lines(docs: DataFrame, places: DataFrame, id_col: str, text: str) -> DataFrame:
    """(place, doc, th, no, line) of the given (doc, th, no): place numbers them in order, earliest first."""
    wanted = places.groupBy("doc", "th").agg(F.collect_set("no").alias("nos"))

    def make():
        def run(columns):
            for doc, th, t, nos in zip(*columns):
                split = (t or "").split("\n")
                for no in nos:
                    yield doc, th, no, normal(split[no])
        return run

    kind = docs.schema[id_col].dataType.simpleString()
    # the ids grow with the corpus: a merge join at every size
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), text_hash(text).alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = texts.join(wanted.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "nos")
    lines = map_rows(rows, make, f"doc {kind}, th bigint, no int, line string").dropDuplicates(["doc", "th", "no"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(parts, "doc", "no", "th").sortWithinPartitions("doc", "no", "th")
    # ids grow within a partition and from partition to partition
    return written(ordered.withColumn("place", F.monotonically_increasing_id()), "line-texts")


def variants(lines: DataFrame) -> DataFrame:
    """(key, own, less): hashed variants of the lines of (place, line).

    own holds the place where the key is that of the line itself or of the line without its p-th
    character together with p; less where it is that of the line without a character. The hash is
    a polynomial over the characters, so that a variant's follows from those of the parts before
    and after the gap: n steps for n characters.
    """
    base, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def mix(h: np.ndarray, n: int) -> np.ndarray:
        h = (h ^ np.uint64(n)) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))

    def keys(line: str) -> tuple[np.ndarray, np.ndarray]:
        c = (np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)) * odd
        c ^= c >> np.uint64(31)
        n = len(c)
        power = np.cumprod(np.full(n + 1, base, dtype=np.uint64))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power[:n], dtype=np.uint64)])
        # what follows the gap moves up by one place
        lower = np.concatenate([np.ones(1, np.uint64), power[:n - 1]])
        after = np.concatenate([np.cumsum((c * lower)[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
        cut = mix(before[:n] + after[1:], n - 1)
        place = mix(cut ^ (np.arange(1, n + 1, dtype=np.uint64) * odd), n) ^ odd
        return np.concatenate([mix(before[n:], n), place]), np.unique(cut)

    def run(batches):
        def out():
            key, place = np.concatenate([h for h, _, _ in held]).astype(np.int64), np.concatenate(
                [np.full(len(h), p, dtype=np.int64) for h, p, _ in held])
            less = np.concatenate([np.full(len(h), x, dtype=bool) for h, _, x in held])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place, mask=less), pa.array(place, mask=~less)],
                                              names=["key", "own", "less"])

        held, n = [], 0
        for batch in batches:
            for place, line in zip(*[c.to_pylist() for c in batch.columns]):
                own, less = keys(line)
                held += [(own, place, False), (less, place, True)]
                n += len(own) + len(less)
                if n >= BATCH:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.select("place", "line").repartition(parts).mapInArrow(run, "key bigint, own bigint, less bigint")


def within_one(a: str, b: str) -> bool:
    """Edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_earlier(lines: DataFrame) -> DataFrame:
    """(doc, th, no) of lines of (place, doc, th, no, line), all different texts, that lie within one edit of an earlier one.

    Keys of places only meet keys of the same place: their lines are all within one edit. A line
    and the lines it is a variant of meet at the line's own key.
    """
    same = W.partitionBy("key")
    keys = variants(lines).select("own", "less", F.min("own").over(same).alias("own_min"), F.min("less").over(same).alias("less_min"))
    # a line's own key meets shorter variants of longer lines; both directions count
    met = keys.select(F.coalesce("own", "less").alias("place"), F.when(
        F.col("less").isNotNull(), F.col("own_min")).otherwise(F.least("own_min", "less_min")).alias("to"))
    found = met.where(F.col("to") < F.col("place")).groupBy("place").agg(F.min("to").alias("to"))
    # verify: a hash may lie, the edit distance does not
    other = lines.select(F.col("place").alias("to"), F.col("line").alias("other"))
    pairs = found.join(lines, "place").join(other, "to").select("doc", "th", "no", "line", "other")

    def make():
        def run(columns):
            for doc, th, no, a, b in zip(*columns):
                if within_one(a, b):
                    yield doc, th, no
        return run

    return map_rows(pairs, make, f"doc {lines.schema['doc'].dataType.simpleString()}, th bigint, no int")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                  near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc, th, gone): per row (id and hash of the text) that loses lines their numbers, from 0."""
    lines = written(hashed_lines(docs, id_col, text, min_words, near_chars), "lines")
    first = written(first_places(lines), "line-first")
    near = first.join(suspects(lines), "h1", "left_semi").select("doc", "th", "no")
    late = near_earlier(suspect_lines(docs, near, id_col, text)).withColumn("late", F.lit(True))
    judged = first.join(late, ["doc", "th", "no"], "left").where((F.col("n") > 1) | F.col("late")).select(
        "h1", "h2", F.col("doc").alias("d1"), F.col("th").alias("t1"), F.col("no").alias("n1"), F.coalesce("late", F.lit(False)).alias("late"))
    gone = lines.select("doc", "th", "no", "h1", "h2").join(judged, ["h1", "h2"]).where(
        F.col("late") | (F.col("doc") != F.col("d1")) | (F.col("th") != F.col("t1")) | (F.col("no") != F.col("n1")))
    return gone.groupBy("doc", "th").agg(F.collect_set("no").alias("gone"))


def _judged(docs: DataFrame, id_col: str, text: str, min_words: int, near_chars: int) -> DataFrame:
    """(row, left, n_lines, n_removed): the columns of docs as a struct and the text that stays."""
    gone = written(removed_lines(docs, id_col, text, min_words, near_chars), "line-gone")
    keyed = docs.select(in_row(docs), F.col(f"`{id_col}`").alias("doc"), text_hash(text).alias("th"))
    joined = keyed.join(gone.hint("merge"), ["doc", "th"], "left")
    body = F.col("row").getField(text)
    split = F.split(body, "\n", -1)
    stays = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return joined.select("row", F.when(F.col("gone").isNull(), body).otherwise(stays).alias("left"),
                         F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
               near_chars: int = NEAR_CHARS) -> DataFrame:
    """All columns of docs with the text that stays, and struct _lines (n_lines, n_removed); where docs has _lines, it is __lines."""
    made = _judged(docs, id_col, text, min_words, near_chars)
    return made.select(*row_fields(docs, {text: F.col("left")}), F.struct("n_lines", "n_removed").alias(free_name(docs, "_lines")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, min_words=1).select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Texts without repeated lines; a document that consisted of repeated lines only goes."""
    made = _judged(docs, "doc_id", "text", min_words, NEAR_CHARS)
    kept = made.where((F.col("n_removed") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(
            F.length("left")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*row_fields(docs, new))


def stage_all_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage with lines of any number of words compared."""
    return stage(spark, docs, sf_dir, min_words=1)

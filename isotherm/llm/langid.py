"""Language identification in two steps: the family first, then the language within the family.

Texts become hashed letter n-grams (one to three letters, square-rooted counts, unit length).
Linear support vector machines, trained here by dual coordinate descent, separate each family
from the rest; within the family found, one machine per pair of languages votes.

Learning uses a bounded sample: at most MAX_ROWS labelled documents, the same number of each
language, lowest hash first. Each gives its whole text and one short piece, so that short texts
are known too. Prediction reads whole texts in Arrow batches and needs no shuffle.

Defined results: NULL text or text without a letter is "und" with score 0, as is everything when
no labelled document exists. A NULL id counts as held out. Rows with NULL lang are not learned
from. Repeated rows each get their row. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.llm.common import table
from isotherm.llm.words import map_rows

MAX_ROWS = 1600                 # labelled documents that are learned from, all languages together
DIM = 1 << 13                   # n-gram buckets
PIECE = 120                     # characters of the short piece
COST, EPOCHS = 1.0, 30

# language code -> family; others form a family of their own
FAMILIES = {
    "Germanic": "en de nl sv da no nb nn is af fy lb yi",
    "Romance": "fr es it pt ro ca gl oc",
    "Slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "Turkic": "tr az kk ky uz tk tt",
    "Indo-Aryan": "hi bn mr ne pa gu ur",
    "Uralic": "fi et hu",
    "Semitic": "ar he mt am",
    "Sinitic": "zh yue",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], f"other {lang}")


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def vector(text: str | None) -> np.ndarray | None:
    """Unit vector of n-gram counts; None for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    # other characters become one space between words
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    mul = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    shift = np.uint64(64 - DIM.bit_length() + 1)
    x = np.zeros(DIM, dtype=np.float32)
    for n in (1, 2, 3):
        h = c[:len(c) - n + 1] * mul[0]
        for j in range(1, n):
            h = (h ^ (h >> np.uint64(31))) * mul[j] + c[j:len(c) - n + 1 + j] * mul[0]
        x += np.bincount((((h ^ (h >> np.uint64(29))) * mul[n - 1]) >> shift).astype(np.int64), minlength=DIM)
    x = np.sqrt(x)
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of an L1-loss linear SVM by dual coordinate descent; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    # either side weighs the same
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    norm, rng = (x * x).sum(axis=1), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    """families: name -> weights against the rest; pairs: (a, b) -> weights, positive for a."""
    langs: list[str] = field(default_factory=list)
    families: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray | None) -> tuple[str, float]:
        if x is None or not self.langs:
            return "und", 0.0

        def margin(w: np.ndarray) -> float:
            return float(x @ w[:-1] + w[-1])

        names = sorted({family(c) for c in self.langs})
        score, chosen = 1.0, names[0]
        if len(names) > 1:
            m = np.array([margin(self.families[n]) for n in names])
            p = np.exp(2 * (m - m.max()))
            chosen, score = names[int(m.argmax())], float(p.max() / p.sum())
        inside = [c for c in self.langs if family(c) == chosen]
        votes = {c: [0, 0.0] for c in inside}
        for (a, b), w in self.pairs.items():
            if a in votes:
                m = margin(w)
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(inside, key=lambda c: (votes[c][0], votes[c][1], c))
        if len(inside) > 1:
            score *= 1 / (1 + np.exp(-2 * votes[best][1] / (len(inside) - 1)))
        return best, float(min(1.0, max(0.0, score)))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        max_rows: int = MAX_ROWS) -> Model:
    """Model from the labelled rows of docs; the caller leaves out what must not be learned from."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    n = known.agg(F.count_distinct(lang)).first()[0]
    if not n:
        return Model()
    rank = W.partitionBy(lang).orderBy(F.xxhash64(id_col), id_col)
    chosen = (known.select(id_col, lang).withColumn("_r", F.row_number().over(rank))
              .where(F.col("_r") <= max(20, max_rows // n)).select(id_col).distinct())
    # a bounded number of ids
    rows = known.select(id_col, text, lang).join(F.broadcast(chosen), id_col).select(F.col(lang), F.col(text))

    def make():
        def run(columns):
            for code, t in zip(*columns):
                at = (len(t or "") * 7 // 11) if len(t or "") > 2 * PIECE else 0
                for part in (t, (t or "")[at:at + PIECE]):
                    x = vector(part)
                    if x is not None:
                        yield code, x.tobytes()
        return run

    got = map_rows(rows, make, "lang string, x binary").collect()
    if not got:
        return Model()
    y, x = np.array([r.lang for r in got]), np.stack([np.frombuffer(r.x, dtype=np.float32) for r in got])
    langs = sorted(set(y))
    model, fam = Model(langs), np.array([family(c) for c in y])
    for name in sorted(set(fam)):
        if len(set(fam)) > 1:
            model.families[name] = train_svm(x, np.where(fam == name, 1, -1))
        for a, b in combinations([c for c in langs if family(c) == name], 2):
            pick = (y == a) | (y == b)
            model.pairs[a, b] = train_svm(x[pick], np.where(y[pick] == a, 1, -1))
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model, keys: list[Column], text: str = "text") -> DataFrame:
    """The key columns, lang_pred and score; texts in Arrow batches."""
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keys, F.col(f"`{text}`").alias("_text"))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            out = [shared.value.predict(vector(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(spark, docs, model, [F.col("doc_id"), held_out().alias("held_out")])

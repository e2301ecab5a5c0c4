"""Quality rules: a decision list learned by sequential covering, applied as ordered conditions.

All of it runs as DataFrame operations. The statistics of a text are array expressions over its
own words, so scoring needs no shuffle. Learning counts, per growth step, the labelled rows on
either side of every threshold (one small aggregate) and picks the best condition.

Defined results: NULL or empty text has no words, all statistics 0, and fails the base rule.
Repeated rows are judged one by one. Labels that contradict each other for one id count as the
worse one; labels without id or quality are ignored. Without labels, or with one class only, the
list is empty and keeps what the base rule keeps. The result has just the documented columns, so
further columns of the input cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import count_matching, in_row, let, row_fields, split_words, table
from isotherm.session import cut

MIN_WORDS = 50
MAX_REPEATED = 50               # per cent of words in repeated three-word windows
MAX_LABELLED = 20_000           # labelled rows that a list is learned from, lowest hash first
THRESHOLDS = 32                 # candidate thresholds per statistic: quantiles of the labelled rows
MAX_CONDITIONS, MAX_RULES = 4, 8
MIN_PRECISION = 0.9             # of a rule on the pruning part
MIN_COVERED = 5                 # bad rows that a rule must find in the growing part

FEATURES = {
    "n_words": lambda s: s["n_words"].cast("double"),
    "mean_word_chars": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbols_per_word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "marks_per_word": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
    "upper_per_char": lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    "distinct_word_share": lambda s: s["n_distinct_words"] / F.greatest(s["n_words"], F.lit(1)),
    "dup_line_share": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeat_word_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
}

_POS_BITS = 30                  # a string has less than 2^30 words


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Windows are sorted as one long each, hash above and position below. Only windows whose hash
    has an equal neighbour are compared as text, so the count is exact and the cost n log n.
    """
    mask = (1 << _POS_BITS) - 1

    def window(w: Column, p: Column) -> Column:
        return F.concat_ws(" ", F.element_at(w, p), F.element_at(w, p + 1), F.element_at(w, p + 2))

    def twice(of) -> callable:
        return lambda x, i, s: F.coalesce(of(F.get(s, i - 1)) == of(x), F.lit(False)) | \
            F.coalesce(of(F.get(s, i + 1)) == of(x), F.lit(False))

    hashed, texted = twice(lambda x: F.shiftright(x, _POS_BITS)), twice(lambda x: x["g"])

    def of_words(w: Column) -> Column:
        packed = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.shiftleft(
            F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)), _POS_BITS)
            .bitwiseOR(i.cast("long")))
        maybe = let(F.sort_array(packed), lambda s: F.transform(
            F.filter(s, lambda x, i: hashed(x, i, s)), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")))
        texts = let(maybe, lambda m: F.sort_array(F.transform(
            m, lambda p: F.struct(window(w, p).alias("g"), p.alias("p")))))
        places = let(texts, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: texted(x, i, s)), lambda x: x["p"])))
        return let(places, lambda p: F.aggregate(F.transform(
            p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, b: a + b))

    return let(words, lambda w: F.when(F.size(w) >= 4, of_words(w)).otherwise(F.lit(0))).cast("long")


def statistics(text: Column) -> Column:
    """Struct of counts of one text, all long."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(split_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count_matching(body, r"[#*$%&|<>]").alias("n_symbols"),
        count_matching(body, r"[!?.,;:]").alias("n_marks"),
        count_matching(body, r"\p{Lu}").alias("n_upper"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
        )).alias("lines"),
        repeat_words(w).alias("n_repeat_words"),
    ))


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and one struct column, stats."""
    raw = docs.select(*keep, statistics(F.col(text)).alias("_s"))
    s = F.col("_s")
    names = ["n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_distinct_words", "n_repeat_words"]
    return raw.select(*keep, F.struct(
        *[s[n].alias(n) for n in names], s["lines"]["n"].alias("n_lines"), s["lines"]["dup"].alias("n_dup_lines"),
    ).alias("stats"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool              # value >= threshold, else value < threshold
    threshold: float

    def holds(self, s: Column) -> Column:
        value = FEATURES[self.feature](s)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, otherwise the text is kept."""
    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self, s: Column) -> Column:
        """Boolean column: kept."""
        out = None
        for rule in self.rules:
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.holds(s)
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def number(self, s: Column) -> Column:
        """Number of the rule that rejects, from 1; NULL where none does."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.holds(s)
            out = F.when(holds, F.lit(i)).otherwise(out)
        return out


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, limit: int) -> DataFrame:
    """(bad 0/1, grow boolean, failed boolean, f array) of a bounded sample of labelled rows."""
    seen = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
            .groupBy(id_col).agg(F.min("quality").alias("_q"))
            .withColumn("_h", F.xxhash64(id_col)).orderBy("_h", id_col).limit(limit))
    # at most `limit` rows: small enough to send to every task
    rows = docs.select(id_col, text).join(F.broadcast(seen), id_col)
    made = with_statistics(rows, ["_q", "_h"], text)
    s = F.col("stats")
    return made.select((F.col("_q") == 0).cast("int").alias("bad"), (F.pmod("_h", F.lit(3)) > 0).alias("grow"),
                       base_failed(s).alias("failed"),
                       F.array(*[f(s) for f in FEATURES.values()]).alias("f"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Sequential covering of the bad rows (quality 0) among those that pass the base rule.

    labels: id_col, quality (0 bad, 1 good). A rule grows by the condition with the best gain,
    is pruned on rows it was not grown on, and then takes the rows it covers away.
    """
    names = list(FEATURES)
    # cut before the filter: below the join it would compute the statistics of every document
    rows = cut(_labelled(docs, labels, id_col, text, max_labelled)).where(~F.col("failed"))
    steps = [(i + 0.5) / THRESHOLDS for i in range(THRESHOLDS)]
    found = rows.agg(F.array(*[F.percentile_approx(F.col("f")[j], steps, 10_000) for j in range(len(names))])).first()
    if found is None or found[0] is None or found[0][0] is None:
        return DecisionList(())
    cuts = [sorted(set(q)) for q in found[0]]
    # the number of thresholds at or below a value
    bins = rows.select("bad", "grow", F.array(*[
        sum(((F.col("f")[j] >= c).cast("int") for c in cuts[j]), F.lit(0)) for j in range(len(names))]).alias("b"))
    bins = cut(bins.groupBy("bad", "grow", "b").agg(F.count("*").alias("n")))

    def covered(df: DataFrame, rule: list[tuple[int, bool, int]]) -> DataFrame:
        for j, ge, k in rule:
            df = df.where(F.col("b")[j] >= k if ge else F.col("b")[j] < k)
        return df

    def tally(df: DataFrame, grow: bool) -> tuple[int, int]:
        got = df.where(F.col("grow") == grow).agg(F.sum(F.col("bad") * F.col("n")), F.sum("n")).first()
        return int(got[0] or 0), int((got[1] or 0) - (got[0] or 0))

    left, rules = bins, []
    while len(rules) < MAX_RULES:
        rule: list[tuple[int, bool, int]] = []
        p0, n0 = tally(left, True)
        while p0 and n0 and len(rule) < MAX_CONDITIONS:
            best = _best_condition(covered(left, rule).where("grow"), p0, n0, [len(c) for c in cuts])
            if best is None:
                break
            rule.append(best[0])
            p0, n0 = best[1]
        if not rule or p0 < MIN_COVERED:
            break
        # prune: the shortest beginning with the best worth on the other part
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = tally(covered(left, rule[:k]), False)
            worth.append(((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0))
        k = max(range(len(rule)), key=lambda i: (worth[i][0], -i))
        if worth[k][1] < MIN_PRECISION:
            break
        rule = rule[:k + 1]
        rules.append(tuple(Condition(names[j], ge, float(cuts[j][t - 1])) for j, ge, t in rule))
        inside = F.lit(True)
        for j, ge, t in rule:
            inside = inside & (F.col("b")[j] >= t if ge else F.col("b")[j] < t)
        left = left.where(~inside)
    return DecisionList(tuple(rules))


def _best_condition(rows: DataFrame, p0: int, n0: int, sizes: list[int]):
    """Condition of highest information gain, with the bad and good rows it leaves."""
    import math

    counts = (rows.select("bad", "n", F.posexplode("b").alias("j", "k"))
              .groupBy("j", "k").agg(F.sum(F.col("bad") * F.col("n")).alias("p"), F.sum("n").alias("all"))).collect()
    best, best_gain = None, 1e-9
    before = math.log2(p0 / (p0 + n0))
    for j, size in enumerate(sizes):
        of = {r["k"]: (r["p"], r["all"] - r["p"]) for r in counts if r["j"] == j}
        low_p = low_n = 0
        for t in range(1, size + 1):
            p, n = of.get(t - 1, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for ge, (p, n) in ((True, (p0 - low_p, n0 - low_n)), (False, (low_p, low_n))):
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best_gain:
                    best, best_gain = ((j, ge, t), (int(p), int(n))), gain
    return best


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, base_failed, kept and the number of the rejecting rule."""
    s = F.col("stats")
    return with_statistics(docs, [id_col], text).select(
        id_col, *[s[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & rules.verdict(s)).alias("kept"), rules.number(s).alias("rule"))


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The documents that the base rule and the list keep, with all their columns."""
    stats = docs.select(in_row(docs), statistics(F.col(f"`{text}`")).alias("stats"))
    s = F.col("stats")
    flat = F.struct(*[s[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_distinct_words",
                                              "n_repeat_words")],
                    s["lines"]["n"].alias("n_lines"), s["lines"]["dup"].alias("n_dup_lines"))
    stats = stats.withColumn("stats", flat)
    return stats.where(~base_failed(s) & rules.verdict(s)).select(*row_fields(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")))

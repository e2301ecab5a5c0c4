"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

A source with a share s of all tokens gets the weight s^a / sum(s^a). The exponent a is found by
bisection: the largest a (nearest to the natural mix) whose entropy reaches the target, raised
where needed until no source is repeated more often than the limit. A weight times the token
budget is a source's budget.

Realisation, per source and epoch: blocks of documents in keyed random order, documents within a
block in keyed random order. Whole epochs are taken while they fit the budget; the last one is
cut: whole blocks first, then documents of the block the budget ends in. Blocks are prefixes of a
keyed hash, so sums per block are one hash aggregate, and only the documents of the cut block of
each source are summed one by one. The sources' plan is one row per source.

Everything runs as DataFrame operations. Defined results: a NULL source is a source of its own,
called "". Documents without tokens (NULL, empty text) are never drawn. Rows that share source
and id stand and fall together; a NULL id is read as "". Without any token, or with budget 0, the
result is empty. Documents longer than what is left of a budget end the source's epoch. One
source gets the whole budget. A repetition limit below budget / tokens cannot be met: a is 1 then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.llm.common import free_name, in_row, let, row_fields, small_or_shuffled, table, written

ENTROPY = 0.9                   # target: share of the way from the natural entropy to the highest
REPEATS = 4.0                   # a source's budget is at most so many times its tokens
STEPS = 50                      # of each bisection
BLOCK_DIGITS = 3                # hexadecimal digits of the key that name a block: 4096 per source
SEED = "mix"
MAX_SENT = 100_000              # sources up to which the plan goes to every task


def count_tokens(text: Column) -> Column:
    """White-space separated words (long): the spaces between them, plain replacements being far cheaper than a pattern."""
    body = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        body = F.replace(body, F.lit(c), F.lit(" "))
    single = let(F.trim(body), lambda s: F.when(F.contains(s, F.lit("  ")), F.regexp_replace(s, " +", " ")).otherwise(s))
    return let(single, lambda s: F.when(s == "", 0).otherwise(
        F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1)).cast("long")


def _power_sum(shares: Column, a: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, x: s + F.pow(x, a))


def _entropy(shares: Column, a: Column) -> Column:
    """Of the weights x^a / z: log z - a * sum(x^a log x) / z."""
    return let(F.struct(_power_sum(shares, a).alias("z"), F.aggregate(
        shares, F.lit(0.0), lambda s, x: s + F.pow(x, a) * F.ln(x)).alias("l")),
        lambda v: F.ln(v["z"]) - a * v["l"] / v["z"])


def _bisect(good: callable) -> Column:
    """The point of [0, 1] up to which good holds, for a condition that holds from 0 on."""
    def step(s: Column, _: Column) -> Column:
        return let((s["lo"] + s["hi"]) / 2, lambda m: F.when(good(m), F.struct(m.alias("lo"), s["hi"].alias("hi")))
                   .otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)["lo"]


def weights(totals: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """(source, tokens, exponent, weight, budget) from (source, tokens), tokens > 0.

    The shares of all sources stand in one array: one number per source, none per document.
    """
    one = totals.agg(F.sum("tokens").alias("all"), F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"))
    one = one.where("all > 0").withColumn("p", F.transform("s", lambda x: x["tokens"].cast("double") / F.col("all")))
    one = one.withColumn("n", (F.col("all") if budget is None else F.lit(budget)).cast("long"))
    p = F.col("p")
    target = let(_entropy(p, F.lit(1.0)), lambda h: h + F.lit(float(entropy)) * (F.ln(F.size(p).cast("double")) - h))
    one = one.withColumn("target", target)
    # entropy falls with the exponent; 1e-12 takes the noise of the last digits
    one = one.withColumn("a", F.when(_entropy(p, F.lit(1.0)) >= F.col("target") - 1e-12, F.lit(1.0)).otherwise(
        _bisect(lambda m: _entropy(p, m) >= F.col("target"))))
    # repetition of the smallest share falls with the exponent: 1 - exponent is bisected

    def most_repeated(a: Column) -> Column:
        # weight * budget / tokens = x^a / z * n / (x * all), largest for the smallest share
        low = F.array_min(p)
        return F.pow(low, a) / _power_sum(p, a) * F.col("n") / (low * F.col("all"))

    limit = F.lit(float(repeats))
    needed = F.when(most_repeated(F.lit(0.0)) <= limit, F.lit(0.0)).when(
        most_repeated(F.lit(1.0)) > limit, F.lit(1.0)).otherwise(
        F.lit(1.0) - _bisect(lambda m: most_repeated(F.lit(1.0) - m) <= limit))
    one = one.withColumn("need", needed).withColumn("a", F.greatest("a", "need"))
    one = one.withColumn("z", _power_sum(p, F.col("a")))
    rows = one.select("n", "a", "z", "all", F.explode("s").alias("x"))
    share = F.col("x.tokens").cast("double") / F.col("all")
    w = F.round(F.pow(share, F.col("a")) / F.col("z"), 9)
    return rows.select(F.col("x.source").alias("source"), F.col("x.tokens").alias("tokens"), F.round("a", 9).alias("exponent"),
                       w.alias("weight"), F.floor(w * F.col("n")).cast("long").alias("budget"))


def _key(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def plan(tokens: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS,
         seed: str = SEED) -> DataFrame:
    """One row per source: weight, budget, whole epochs, and where the cut epoch ends.

    tokens: (source, id, n). cut_block is the block key the budget ends in, cut_doc the last
    document key taken of it; both NULL where nothing of the last epoch is taken or cut.
    """
    blocks = written(tokens.where("n > 0").groupBy("source", F.substring(_key(seed, F.col("source"), F.col("id")), 1, BLOCK_DIGITS)
                                                  .alias("block")).agg(F.sum("n").alias("n")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("n").alias("tokens"))
    w = written(weights(totals, budget, entropy, repeats)
                .withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
                .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-weights")
    keyed = blocks.join(w, "source").withColumn("block_key", _key(seed, F.col("source"), F.col("epochs").cast("string"), F.col("block")))
    # at most 16^BLOCK_DIGITS rows per source
    upto = W.partitionBy("source").orderBy("block_key").rowsBetween(W.unboundedPreceding, 0)
    ranked = keyed.withColumn("upto", F.sum("n").over(upto))
    cut = (ranked.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min("block_key").alias("cut_block"))
           .join(ranked.select("source", F.col("block_key").alias("cut_block"), "block", "rest", (F.col("upto") - F.col("n")).alias("before")),
                 ["source", "cut_block"]))
    inside = tokens.where("n > 0").withColumn("block", F.substring(_key(seed, F.col("source"), F.col("id")), 1, BLOCK_DIGITS))
    inside = inside.join(small_or_shuffled(written(cut, "mix-cuts"), MAX_SENT), ["source", "block"])
    inside = inside.withColumn("doc_key", _key(seed, F.col("source"), F.col("id"))).groupBy("source", "doc_key", "before", "rest").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("source").orderBy("doc_key").rowsBetween(W.unboundedPreceding, 0)
    last = (inside.withColumn("upto", F.sum("n").over(upto) + F.col("before")).where("upto <= rest")
            .groupBy("source").agg(F.max("doc_key").alias("cut_doc")))
    return (w.join(cut.select("source", "cut_block"), "source", "left").join(last, "source", "left")
            .select("source", "tokens", "exponent", "weight", "budget", "epochs", "cut_block", "cut_doc"))


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: str = SEED,
        id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as drawn, a row per epoch, with struct _mix: source, n_tokens, weight, epoch, block_key, doc_key.

    Reading order: epoch by epoch, within it by block_key, then doc_key. Where docs has a column _mix, the struct is __mix.
    """
    return _drawn(docs, budget, entropy, repeats, seed, id_col, text, source).select(
        *row_fields(docs), F.col("mix").alias(free_name(docs, "_mix")))


def _drawn(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: str = SEED,
           id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, mix): the columns of docs as a struct, and its place."""
    src, ident = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    n = count_tokens(F.col(f"`{text}`"))
    tokens = written(docs.select(src.alias("source"), ident.alias("id"), n.alias("n")), "mix-tokens")
    p = written(plan(tokens, budget, entropy, repeats, seed), "mix-plan")
    p = small_or_shuffled(p.select(F.struct(*p.columns).alias("plan"), F.col("source").alias("src")), MAX_SENT)
    # the test for a word stops at the first one; a test of the count would count twice
    rows = docs.where(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")).select(
        in_row(docs), src.alias("src"), n.alias("n"), _key(seed, src, ident).alias("doc_key")).join(p, "src")
    rows = rows.select("row", "plan", "n", "doc_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("plan.epochs"))).alias("epoch"))
    q = F.col("plan")
    rows = rows.withColumn("block_key", _key(seed, q["source"], F.col("epoch").cast("string"), F.substring("doc_key", 1, BLOCK_DIGITS)))
    taken = (F.col("epoch") < q["epochs"]) | (F.col("block_key") < q["cut_block"]) | (
        (F.col("block_key") == q["cut_block"]) & (F.col("doc_key") <= q["cut_doc"]))
    return rows.where(taken).select("row", F.struct(
        q["source"].alias("source"), F.col("n").alias("n_tokens"), q["weight"].alias("weight"), "epoch", "block_key", "doc_key").alias("mix"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "_mix.source", "_mix.n_tokens", "_mix.weight", "_mix.epoch", "_mix.block_key", "_mix.doc_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as drawn, with their place in the reading order. A place of an earlier mix is replaced."""
    place = {"mix_epoch": "epoch", "mix_block": "block_key", "mix_key": "doc_key", "mix_weight": "weight"}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in place]
    return _drawn(docs).select(*kept, *[F.col("mix").getField(f).alias(c) for c, f in place.items()])


def _sql() -> str:
    """The same in SQL: bisections as recursive queries over the sources' shares."""
    ent = lambda a: (f"(SELECT ln(sum(pow(x, {a}))) - {a} * sum(pow(x, {a}) * ln(x)) / sum(pow(x, {a})) FROM sh)")
    rep = lambda a: f"(SELECT pow(min(x), {a}) / sum(pow(x, {a})) * min(n) / (min(x) * min(al)) FROM sh)"
    key = f"md5('{SEED}|' || source || '|' || id)"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS id,
 len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n FROM documents),
k AS (SELECT *, {key} AS doc_key FROM d WHERE n > 0),
t AS (SELECT source, sum(n)::BIGINT AS tokens FROM k GROUP BY source),
sh AS (SELECT source, tokens, tokens::DOUBLE / (SELECT sum(tokens) FROM t) AS x, (SELECT sum(tokens) FROM t)::DOUBLE AS al,
 (SELECT sum(tokens) FROM t)::DOUBLE AS n FROM t),
h AS (SELECT {ent('1.0::DOUBLE')} + {ENTROPY}::DOUBLE * (ln((SELECT count(*) FROM sh)::DOUBLE) - {ent('1.0::DOUBLE')}) AS target),
b1 AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
 SELECT i + 1, CASE WHEN e >= (SELECT target FROM h) THEN m ELSE lo END, CASE WHEN e >= (SELECT target FROM h) THEN hi ELSE m END
 FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, (SELECT ln(sum(pow(x, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(x, (lo + hi) / 2) * ln(x))
  / sum(pow(x, (lo + hi) / 2)) FROM sh) AS e FROM b1 WHERE i < {STEPS})),
b2 AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
 SELECT i + 1, CASE WHEN e <= {REPEATS} THEN m ELSE lo END, CASE WHEN e <= {REPEATS} THEN hi ELSE m END
 FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, (SELECT pow(min(x), 1 - (lo + hi) / 2) / sum(pow(x, 1 - (lo + hi) / 2)) * min(n) / (min(x) * min(al))
  FROM sh) AS e FROM b2 WHERE i < {STEPS})),
a AS (SELECT greatest(CASE WHEN {ent('1.0::DOUBLE')} >= (SELECT target FROM h) - 1e-12 THEN 1.0::DOUBLE ELSE (SELECT lo FROM b1 WHERE i = {STEPS}) END,
 CASE WHEN {rep('0.0::DOUBLE')} <= {REPEATS} THEN 0.0::DOUBLE WHEN {rep('1.0::DOUBLE')} > {REPEATS} THEN 1.0::DOUBLE
  ELSE 1 - (SELECT lo FROM b2 WHERE i = {STEPS}) END) AS a),
w AS (SELECT source, tokens, round(pow(x, a) / (SELECT sum(pow(x, a)) FROM sh, a), 9) AS weight, n FROM sh, a),
e AS (SELECT *, floor(weight * n)::BIGINT // tokens AS epochs, floor(weight * n)::BIGINT % tokens AS rest FROM w),
r AS (SELECT k.*, weight, epoch, epochs, rest, md5('{SEED}|' || source || '|' || epoch::VARCHAR || '|' || substr(doc_key, 1, {BLOCK_DIGITS})) AS block_key
 FROM k JOIN (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM e) USING (source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY source, epoch ORDER BY block_key, doc_key RANGE UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, source, n AS n_tokens, weight, epoch::BIGINT AS epoch, block_key, doc_key FROM c WHERE epoch < epochs OR upto <= rest"""


SQL = _sql()

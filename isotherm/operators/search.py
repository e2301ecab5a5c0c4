"""Search of places and stations by words.

Queries are a table. Every text is indexed by its character triples (shorter pieces for
short words); a query meets only texts that share its rarest piece, and is then compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
SALTS = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s,]+"), lambda w: w != "")


def _queries(queries: DataFrame) -> DataFrame:
    """Columns: anfrage, q, woerter, grams (the pieces of all words of the greatest length they have)."""
    q = F.lower(F.trim("text"))
    asked = (
        queries.select("anfrage", q.alias("q")).where(F.col("q") != "")
        .withColumn("woerter", _words(F.col("q"))).where(F.size("woerter") > 0)
    )

    def pieces(w):
        size = F.least(F.length(w), F.lit(GRAM))
        return F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, size))

    return asked.withColumn("grams", F.array_distinct(F.flatten(F.transform("woerter", pieces))))


def _grams(text: Column) -> Column:
    """All pieces of one to three characters, each once."""
    def of_length(g):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (g - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(g)))

    return F.array_distinct(F.concat(*[of_length(g) for g in range(1, GRAM + 1)]))


def _meet(queries: DataFrame, texts: DataFrame, indexed: Column) -> DataFrame:
    """Texts beside the queries whose rarest piece they hold.

    Only ids go through the index; a piece that no text holds makes its query empty.
    """
    asked = _queries(queries)
    pieces = asked.select("anfrage", F.explode("grams").alias("gram"))
    # only pieces some query asks for leave the tasks that index the texts
    index = texts.select("id", F.explode(_grams(indexed)).alias("gram")).join(
        pieces.select("gram").distinct(), "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        pieces.join(counts, "gram", "left")
        .groupBy("anfrage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        .where("r.n > 0").select("anfrage", F.col("r.gram").alias("gram"))
    )
    # index and texts grow with the table: its compressed files may look small enough to be sent round, its
    # rows are not. A semi-join sends its right side at most; a common piece is dealt out by its texts' ids
    few = index.join(rarest.select("gram").distinct(), "gram", "left_semi").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    dealt = rarest.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = few.hint("merge").join(dealt, ["gram", "_s"]).select("anfrage", "id")
    return met.join(asked, "anfrage").join(texts.hint("merge"), "id")


def _begins_a_part(w: Column, name: Column, marks: tuple[str, ...]) -> Column:
    hit = F.startswith(name, w)
    for m in marks:
        hit = hit | F.contains(name, F.concat(F.lit(m), w))
    return hit


def search_places(queries: DataFrame, places: DataFrame, n: int = 60) -> DataFrame:
    """Every word inside the name; exact, prefix, word prefix, infix; larger places first.

    queries: anfrage, text. places: id, name, einwohner, gipfel, hoehe.
    """
    low = F.col("_klein")
    found = _meet(queries, places.withColumn("_klein", F.lower("name")), low).where(
        F.forall("woerter", lambda w: F.contains(low, w)))
    tier = (F.when(low == F.col("q"), 0).when(F.startswith(low, F.col("q")), 1)
            .when(F.forall("woerter", lambda w: _begins_a_part(w, low, (" ", "-"))), 2).otherwise(3))
    height = F.when(F.col("gipfel"), -F.coalesce("hoehe", F.lit(0))).otherwise(0)
    w = Window.partitionBy("anfrage").orderBy("rang", F.desc("einwohner"), height, "name", "id")
    return (
        found.withColumn("rang", tier).withColumn("nr", F.row_number().over(w))
        .where(F.col("nr") <= n).select("anfrage", "nr", "rang", "id", "name")
    )


def search_stations(queries: DataFrame, st: DataFrame, n: int | None = None) -> DataFrame:
    """Words in the name, the state or the five-digit number; German order inside a tier."""
    number = F.lpad(F.col("id").cast("string"), 5, "0")
    texts = st.select("id", "name", F.lower("name").alias("_n"), F.lower("land").alias("_l"),
                      number.alias("_nr"))
    indexed = F.concat_ws("\n", "_n", "_l", "_nr")
    name = F.col("_n")
    found = _meet(queries, texts, indexed).where(F.forall("woerter", lambda w: (
        F.contains(name, w) | F.contains(F.col("_l"), w) | F.contains(F.col("_nr"), w))))
    digits = F.col("q").rlike(r"^\d+$")
    tier = (
        F.when(digits & (F.regexp_replace("q", "^0+(?=.)", "") == F.col("id").cast("string")), 0)
        .when(F.startswith(name, F.col("q")), 1)
        .when(F.forall("woerter", lambda w: _begins_a_part(w, name, (" ", "-", "("))), 2)
        .when(F.forall("woerter", lambda w: F.contains(name, w)), 3).otherwise(4))
    w = Window.partitionBy("anfrage").orderBy("rang", F.collate("name", "de"), "id")
    out = found.withColumn("rang", tier).withColumn("nr", F.row_number().over(w))
    if n is not None:
        out = out.where(F.col("nr") <= n)
    return out.select("anfrage", "nr", "rang", "id", "name")


def station_choice(overview: DataFrame, favourites: DataFrame) -> DataFrame:
    """Without a text: favourites in their order, then loaded stations, then the rest by name.

    overview: result of ``station_overview``. favourites: station, nr.
    """
    favs = favourites.select(F.col("station").alias("id"), F.col("nr").alias("_fav"))
    group = F.when(F.col("_fav").isNotNull(), 0).when(F.col("tage") > 0, 1).otherwise(2)
    return (
        overview.join(favs, "id", "left").withColumn("gruppe", group)
        .orderBy("gruppe", F.col("_fav").asc_nulls_last(), F.collate("name", "de"), "id")
        .drop("_fav")
    )

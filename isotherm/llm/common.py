"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.session import new_folder

# space, tab, line feed, vertical tab, form feed, carriage return
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def count_words(text: Column) -> Column:
    """Number of white-space separated words (long); 0 for NULL."""
    return F.size(split_words(text)).cast("long")


def count_matching(text: Column, pattern: str) -> Column:
    """Number of characters that match a one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many more underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def in_row(df: DataFrame) -> Column:
    """All columns of df as one struct named row, out of the way of helper columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def row_fields(df: DataFrame, but: dict[str, Column] | None = None) -> list[Column]:
    """The columns of df out of the struct row; those in but as given there."""
    but = but or {}
    return [(but[c] if c in but else F.col("row").getField(c)).alias(c) for c in df.columns]


def text_hash(text: str) -> Column:
    """64 bits of a text: with the id it names a row, so rows that share an id are told apart."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def small_or_shuffled(df: DataFrame, limit: int) -> DataFrame:
    """A side of a join: sent to every task where it has at most limit rows, else left to a shuffle.

    df must be cheap to count (a written table). Rows are narrow: ids, hashes, short arrays.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

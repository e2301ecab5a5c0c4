"""Word runs shared by the operators on word windows, for Arrow batches inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# after lower-casing A-Z: digits, a-z and everything beyond ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 20_000                  # rows of an output batch
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case (bytes.lower leaves all other characters)."""
    return (text or "").encode("utf-8", "replace").lower()


def words(text: str | None) -> list[bytes]:
    return WORD.findall(lowered(text))


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterator[tuple]]], schema: str) -> DataFrame:
    """Rows of df through a function of one Arrow batch (list of columns) that yields tuples.

    make is called once per task and returns that function; it may build what the rows share.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            rows = iter(fn([c.to_pylist() for c in batch.columns]))
            # an input row may give many output rows: they leave in pieces
            while part := list(islice(rows, PIECE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*part), out)], schema=out)

    return df.mapInArrow(run, schema)

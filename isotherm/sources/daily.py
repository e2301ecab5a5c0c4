"""Daily product files and their archives, each parsed in one pass.

Every file brings its own header. A file is one series, at most some megabytes, so it is read whole
in one task: unzipped where it is an archive, split, and turned into typed columns at once. It gives
either its observations or one row that says why it failed; so good and failed files are two filters
on the same rows, and no join, window or second reading is needed to tell them apart.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from isotherm.schema import MISSING, OBSERVATION, PRODUCT_FIELDS, PRODUCT_REQUIRED
from isotherm.session import stored

# ---- fixed values --------------------------------------------------------------
PRODUCT_NAME = "produkt_klima_tag"
FIELD_NAME = r"^[A-Za-z0-9_]+$"
DATE_FORMAT = "%Y%m%d"
ERROR_LENGTH = 200
# --------------------------------------------------------------------------------
FILES = "path string, content binary, quelle int, station int"
ROWS = StructType([StructField("path", StringType()), *OBSERVATION.fields, StructField("fehler", StringType())])


class Failed(Exception):
    """Why a file cannot be used."""


def product_of(content: bytes) -> bytes:
    """The product file in an archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            name = next((n for n in archive.namelist() if n.startswith(PRODUCT_NAME)), None)
            if name is None:
                raise Failed(f"no file {PRODUCT_NAME} in the archive")
            return archive.read(name)
    except (zipfile.BadZipFile, EOFError, OSError, ValueError, NotImplementedError, RuntimeError) as error:
        raise Failed(f"archive unreadable: {error}") from error


def _table(text: str, required: list[str]) -> tuple[list[str], dict[str, pa.Array]]:
    """Lines that have a date, and the trimmed text of each field by name; short lines are padded with NULL."""
    lines = [line.rstrip("\r") for line in text.split("\n")]
    head, names = lines[0].strip(), [n.strip() for n in lines[0].strip().split(";")]
    if not all(re.match(FIELD_NAME, n) for n in names) or not set(required) <= set(names):
        raise Failed(f"unexpected header: {head}")
    at = names.index("MESS_DATUM")
    split = []
    for line in lines[1:]:
        fields = line.split(";")
        # a line that repeats the head is no data either
        if len(fields) > at and fields[at].strip() and line.strip() != head:
            split.append((line, fields))
    columns = list(zip_longest(*(f for _, f in split))) if split else []
    fields = {}
    for i, name in enumerate(names):
        # of a name that comes twice the first one counts
        if name not in fields:
            values = list(columns[i]) if i < len(columns) else [None] * len(split)
            fields[name] = pc.utf8_trim_whitespace(pa.array(values, pa.string()))
    return [line for line, _ in split], fields


def _numbers(texts: pa.Array, lines: list[str]) -> pa.Array:
    blank = pc.equal(texts, "")
    try:
        return pc.if_else(blank, None, texts).cast(pa.float64())
    except pa.ArrowInvalid:
        for line, t in zip(lines, texts.to_pylist()):
            try:
                pa.array([t or None], pa.string()).cast(pa.float64())
            except pa.ArrowInvalid:
                raise Failed(f"unreadable line: {line}") from None
        raise


def _dates(texts: pa.Array, lines: list[str]) -> pa.Array:
    dates = pc.strptime(texts, format=DATE_FORMAT, unit="s", error_is_null=True)
    # a day that the month does not have, or other digits, does not come back as it was
    same = pc.fill_null(pc.equal(pc.strftime(dates, format=DATE_FORMAT), texts), False)
    if not pc.all(same, min_count=0).as_py():
        raise Failed(f"unreadable line: {lines[same.index(False).as_py()]}")
    return dates.cast(pa.date32())


def parse_product(text: str, quelle: int, station: int | None = None) -> pa.RecordBatch:
    """The observations of a product file, or Failed. Without station every line must bring a readable STATIONS_ID."""
    lines, fields = _table(text, [*PRODUCT_REQUIRED, *(["STATIONS_ID"] if station is None else [])])
    n = len(lines)
    arrow = {f.name: f.type for f in to_arrow_schema(OBSERVATION)}
    out = {"datum": _dates(fields["MESS_DATUM"], lines), "quelle": pa.array([quelle] * n, arrow["quelle"])}
    if station is not None:
        out["station"] = pa.array([station] * n, arrow["station"])
    else:
        ids = _numbers(fields["STATIONS_ID"], lines)
        if ids.null_count:
            raise Failed(f"unreadable line: {lines[ids.is_null().index(True).as_py()]}")
        out["station"] = ids.cast(arrow["station"], safe=False)
    for name, column in PRODUCT_FIELDS.items():
        values = _numbers(fields[name], lines) if name in fields else pa.nulls(n, pa.float64())
        missing = pc.fill_null(pc.equal(values, float(MISSING)), False)
        out[column] = pc.if_else(missing, None, values).cast(arrow[column], safe=False)
    return pa.RecordBatch.from_arrays([out[f.name] for f in OBSERVATION.fields], names=[f.name for f in OBSERVATION.fields])


def _parser(archives: bool, error_length: int):
    schema = to_arrow_schema(ROWS)

    def one(path: str, content: bytes, quelle: int, station: int | None) -> pa.RecordBatch:
        try:
            raw = product_of(content) if archives else content
            made = parse_product(raw.decode("latin-1"), quelle, station)
        except Failed as why:
            empty = [None] * len(OBSERVATION.fields)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, [path, *empty, str(why)[:error_length]]))], schema=schema)
        n = made.num_rows
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *made.columns, pa.nulls(n, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                yield one(*(x.as_py() for x in row))

    return run


def parse_files(files: DataFrame, quelle: int | Column = 0, station: Column | None = None, archives: bool = False,
                error_length: int = ERROR_LENGTH) -> DataFrame:
    """Files (path, content) -> path, observation columns, fehler: a file gives observations or one row with its error.

    Rows of one file leave its task together. A file without a single day gives no row.
    """
    source = quelle if isinstance(quelle, Column) else F.lit(quelle)
    sid = F.lit(None) if station is None else station
    rows = files.select("path", "content", source.cast("int").alias("quelle"), sid.cast("int").alias("station"))
    return rows.mapInArrow(_parser(archives, error_length), ROWS)


def observations_of(rows: DataFrame) -> DataFrame:
    """The observations of the files that could be read, with their path."""
    return rows.where(F.col("fehler").isNull()).select(*[f.name for f in OBSERVATION.fields], "path")


def failed_files(rows: DataFrame) -> DataFrame:
    """(path, fehler) of the others."""
    return rows.where(F.col("fehler").isNotNull()).select("path", "fehler")


def load_report(rows: DataFrame) -> DataFrame:
    """Per file: days, first and last one, and what went wrong; good and failed files from one pass."""
    return rows.groupBy("path").agg(
        F.count("datum").alias("tage"), F.min("datum").alias("von"), F.max("datum").alias("bis"), F.max("fehler").alias("fehler"))


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_provenance(path: Column) -> Column:
    """1 for an archive of recent days, else 0."""
    return F.when(path.rlike(r"_akt\.zip$"), 1).otherwise(0)


def parse_archives(archives: DataFrame) -> DataFrame:
    """Zip archives (path, content) -> rows as of parse_files."""
    return parse_files(archives, archive_provenance(F.col("path")), archives=True)


def read_daily(spark: SparkSession, path: str, quelle: int | Column = 0) -> tuple[DataFrame, DataFrame]:
    """Product text files -> (observations, failed files); every file is read once, into a table that both come from."""
    rows = stored(parse_files(file_contents(spark, path), quelle), "products")
    return observations_of(rows), failed_files(rows)


def read_archives(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Archives -> (observations, failed archives); every archive is unzipped once."""
    rows = stored(parse_archives(file_contents(spark, glob)), "archives")
    return observations_of(rows), failed_files(rows)

"""CSV sources: price files, raw quotes, feature folders."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import number
from tickloom.plans import attach
from tickloom.plans.settings import settle
from tickloom.schema import PRICE_NUMBERS, PRICE_TEXT, QUOTE_TEXT_FIELDS

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a file that are read at once in search of its header line's end.
HEADER_STEP = 1 << 14
FEATURE_SUFFIX = "_features.csv"


def _has_files(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def drop_header_rows(df: DataFrame, first: str = "day") -> DataFrame:
    """Leave out lines whose first field starts with "day" or is missing."""
    return df.filter(~F.col(first).startswith("day"))


def scan_prices(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Headerless ``;`` price files, 17 columns by position, header lines dropped, as text."""
    raw = spark.read.schema(PRICE_TEXT).option("sep", ";").option("header", False).csv(path)
    return drop_header_rows(raw)


def scan_price_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All price files of a folder in one scan; an empty folder gives no rows."""
    pattern = f"{folder}/*.csv"
    if not _has_files(spark, pattern):
        return spark.createDataFrame([], PRICE_TEXT)
    return scan_prices(spark, pattern)


def scan_prices_header(spark: SparkSession, path: str) -> DataFrame:
    """``;`` price files with a header line, numbers as doubles, missing levels NULL."""
    raw = spark.read.schema(PRICE_TEXT).option("sep", ";").option("header", True).csv(path)
    keys = {c: F.col(c).try_cast("long") for c in ("day", "timestamp")}
    return raw.withColumns({**keys, **{c: number(c) for c in PRICE_NUMBERS}})


def product_name() -> Column:
    """``product`` where given, else ``symbol``."""
    return F.coalesce("product", "symbol")


def alias_symbol(df: DataFrame) -> DataFrame:
    """Call the name column ``product``, whichever of the two names it has."""
    if "product" in df.columns and "symbol" in df.columns:
        return df.withColumn("product", product_name()).drop("symbol")
    return df.withColumnRenamed("symbol", "product") if "symbol" in df.columns else df


def _column_names(line: str) -> list[str]:
    """Names in a CSV header line; an empty name keeps its place."""
    csv.field_size_limit(max(csv.field_size_limit(), len(line) + 1))
    return [name.strip(" ") for name in next(csv.reader([line.removeprefix("\ufeff").rstrip(" ")], escapechar="\\"), [])]


def _first_line(uri: str) -> str | None:
    """The first line of a file, read in small steps; None where the file system needs Spark's reader."""
    try:
        system, path = FileSystem.from_uri(uri)
        with system.open_input_stream(path) as source:
            line = b""
            while b"\n" not in line and (more := source.read(HEADER_STEP)):
                line += more
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    return line.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8", "replace")


def _first_lines_by_scan(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, header) by a scan of all lines, on any file system that Spark knows."""
    lines = spark.read.text(pattern).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return lines.filter("_start = 0").groupBy("source_file").agg(F.min_by("value", "_line").alias("header"))


def file_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, names): the column names of each CSV file by its first line, quotes and byte order mark removed.

    Tasks get files, not lines, and read ``HEADER_STEP`` bytes at a time until the line ends. Only if some file lies on a file
    system that pyarrow cannot open are all lines scanned with Spark's reader instead. Files of no bytes are left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_first_line(uri) for uri in batch.column("source_file").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), pa.array(found, pa.string())], ["source_file", "header"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([_column_names(line) for line in batch.column("header").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), names], ["source_file", "names"])

    files = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("source_file"))
    lines = settle(files.mapInArrow(read, "source_file string, header string"))
    if lines.filter("header IS NULL").limit(1).count():
        lines = _first_lines_by_scan(spark, pattern)
    return settle(lines.mapInArrow(parse, "source_file string, names array<string>"))


def _by_name(spark: SparkSession, pattern: str, wanted: Sequence[str]) -> DataFrame:
    """One scan of CSV files with different headers: the wanted columns as text by name (absent ones NULL), source_file, names."""
    headers = file_headers(spark, pattern)
    width = headers.agg(F.max(F.size("names"))).first()[0] or 1
    layout = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(layout).option("header", True).option("ignoreCorruptFiles", True).csv(pattern)
    cells = F.array(*[F.col(f"_c{i}") for i in range(width)]).alias("_cells")
    rows = raw.select(cells, F.col("_metadata.file_path").alias("source_file"))

    def field(name: str) -> Column:
        at = F.array_position("names", F.lit(name))
        return F.when(at > 0, F.get("_cells", (at - 1).cast("int"))).alias(name)

    return attach(rows, headers, ["source_file"], how="inner").select(*[field(c) for c in wanted], "source_file", "names")


def scan_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Raw quote CSVs whose columns differ from file to file.

    Fields are found by each file's own header, so files with ``symbol`` and with ``product`` mix. Files with neither
    give no rows; ``unused_quote_files`` lists them.
    """
    pattern = f"{folder}/*.csv"
    names = [c for c in QUOTE_TEXT_FIELDS]
    if not _has_files(spark, pattern):
        text = T.StructType([T.StructField(c, T.StringType()) for c in (*names, "source_file")])
        return spark.createDataFrame([], text)
    quotes = _by_name(spark, pattern, names)
    quotes = quotes.filter(F.array_contains("names", "product") | F.array_contains("names", "symbol")).drop("names")
    return alias_symbol(quotes).withColumns({c: number(c) for c in ("price", "quantity")})


def unused_quote_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, reason) of the quote files that give no rows."""
    headers = file_headers(spark, f"{folder}/*.csv")
    neither = ~F.array_contains("names", "product") & ~F.array_contains("names", "symbol")
    bad = headers.filter(neither).select("source_file", F.lit("no name column").alias("reason"))
    return bad.unionByName(_without_rows(spark, f"{folder}/*.csv", headers))


def _without_rows(spark: SparkSession, pattern: str, seen: DataFrame) -> DataFrame:
    """Files of a pattern that are not among ``seen``: no reader finds a line in them (files of no bytes at all are not listed)."""
    files = spark.read.format("binaryFile").load(pattern)
    every = files.select(F.col("_metadata.file_path").alias("source_file"))
    return every.join(seen, "source_file", "left_anti").select("source_file", F.lit("no lines").alias("reason"))


def scan_features(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Feature files (or folders of part files) ``<product>_features.csv`` as one table with a product column.

    Columns are found by name in each file, so their order may differ; those a file lacks are NULL, and so is what cannot
    be read as the column's type. ``unused_feature_files`` lists files that give no rows.
    """
    pattern = f"{folder}/*{FEATURE_SUFFIX}"
    if not _has_files(spark, pattern):
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("product", T.StringType())]))
    name = F.regexp_extract("source_file", r"([^/=]+)_features\.csv", 1)
    rows = _by_name(spark, pattern, schema.names)
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*typed, F.url_decode(name).alias("product"))


def unused_feature_files(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(source_file, reason) of the feature files that give no rows or none of the columns."""
    pattern = f"{folder}/*{FEATURE_SUFFIX}"
    headers = file_headers(spark, pattern)
    known = F.array(*[F.lit(c) for c in schema.names])
    none = headers.filter(~F.arrays_overlap("names", known)).select("source_file", F.lit("no known column").alias("reason"))
    return none.unionByName(_without_rows(spark, pattern, headers))

"""File sources: positional and header CSV (all text), row positions in file
order, banner-row skipping, header-marker detection, Latin-1 fallback, raw
delimiter splitting, JSON documents and typed-empty reads of absent tables.

Row order inside a file is recovered from Spark's file metadata: the file
path, the start offset of the split that holds the row, and the row's
position within its task (``monotonically_increasing_id``). Together they
order the rows of one file exactly as they appear in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.tables import assign_block_ids
from shelfspark.schemas import all_strings
from shelfspark.session import ship_package
from shelfspark.sources.json_arrays import read_split_array

POSITION = ["_file", "_block", "_mid"]
MANY_FILES = 1_000  # names of files that go into an expression, at most


def with_row_position(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_block`` and ``_mid``: a total order of the rows of
    each file in file order (``df`` must come straight from a file scan)."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))


def skip_leading_rows(df: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` rows of every file (``df`` carries the position columns).

    Only the first split of a file can hold them. The table of first rows (one
    row per file) is broadcast, so the rows stay in their splits.
    """
    if n <= 0:
        return df
    heads = df.filter(F.col("_block") == 0).groupBy("_file").agg(F.min("_mid").alias("_first"))
    kept = (F.col("_block") != 0) | (F.col("_mid") - F.col("_first") >= n)
    return df.join(F.broadcast(heads), "_file", "left").filter(kept).select(*df.columns)


def add_row_numbers(df: DataFrame, col: str = "row_no", start: int = 1) -> DataFrame:
    """Dense 1-based row numbers in (file, position) order, gap-free across files."""
    return assign_block_ids(df, POSITION[:2], POSITION[2], start=start, id_col=col)


def _csv_reader(spark: SparkSession, schema: T.StructType, encoding: str | None, header: bool, quote: bool,
                multiline: bool = False):
    r = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    if multiline:
        r = r.option("multiLine", True)
    if encoding:
        r = r.option("encoding", encoding)
    if not quote:
        r = r.option("quote", "\u0000")
    return r


def decoded(cell):
    """Text of a cell that was read byte by byte (as Latin-1): UTF-8 where the
    bytes are valid UTF-8, else Latin-1. One pass, no list of files."""
    raw = F.encode(cell, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(cell)


def by_file(df: DataFrame, raw: dict) -> DataFrame:
    """Text of columns that hold a file's bytes, decided per file: UTF-8 where
    the whole file is valid UTF-8, else Latin-1. ``raw`` maps each column to a
    pair of expressions: its bytes as a string, and its text as Latin-1. One
    scan finds the files that are not valid; the few names go into the
    expression, many are joined."""
    # a line feed between two cells keeps their bytes apart, so all are valid if together they are
    invalid = ~F.is_valid_utf8(F.concat_ws("\n", *[x for x, _ in raw.values()]))
    files = df.where(invalid).select("_file").distinct()
    names = [r[0] for r in files.limit(MANY_FILES + 1).collect()]
    if len(names) <= MANY_FILES:
        latin = F.col("_file").isin(*names) if names else F.lit(False)
    else:
        df = df.join(files.withColumn("_latin", F.lit(True)), "_file", "left")
        latin = F.coalesce("_latin", F.lit(False))
    return df.select(*[F.when(latin, raw[c][1]).otherwise(raw[c][0]).alias(c) if c in raw else F.col(f"`{c}`")
                       for c in df.columns if c != "_latin"])


def lines_by_file(lines: DataFrame) -> DataFrame:
    """Text lines (``value``: bytes as they are) with the encoding decided per file, without a BOM."""
    text = by_file(lines, {"value": (F.col("value"), F.decode(F.col("value").cast("binary"), "ISO-8859-1"))})
    return text.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))


def read_positional_csv(spark: SparkSession, path, names: list[str] | None = None, skip: int = 0,
                        encoding: str | None = "auto", quote: bool = True, numbered: bool = False,
                        multiline: bool = False, header_marker: str | None = None) -> DataFrame:
    """Headerless CSV, every column text, names assigned by position.

    Short rows are padded with null and extra cells dropped. ``skip`` drops
    the first rows of every file (blank lines are not counted: the reader
    drops them). ``encoding="auto"`` takes a file as UTF-8 (a BOM is dropped)
    if all its cells are valid, else as Latin-1. ``numbered`` adds
    a dense ``row_no`` in file order. The position columns are kept for
    ordering. ``multiline=True`` allows quoted line breaks (each file is then
    read by one task).
    ``header_marker`` reads below the first line containing the marker and
    names the cells from that line instead (see ``read_below_marker``).
    """
    if header_marker is not None:
        if skip or multiline or not quote:
            raise ValueError("header_marker does not go with skip, multiline or quote=False")
        return read_below_marker(spark, path, header_marker, numbered=numbered)
    schema = all_strings(names)
    df = _read_any(spark, path, schema, encoding, header=False, quote=quote, multiline=multiline)
    df = skip_leading_rows(df, skip)
    if numbered:
        df = add_row_numbers(df)
    return df


def _read_any(spark, path, schema, encoding, header, quote, multiline=False):
    reader = _csv_reader(spark, schema, "ISO-8859-1" if encoding == "auto" else encoding, header, quote, multiline)
    if header:
        reader = reader.option("enforceSchema", False)  # every file's header is checked against the first one's
    df = with_row_position(reader.csv(path))
    if encoding != "auto":
        return df
    names = schema.fieldNames()
    cells = {c: F.col(f"`{c}`") for c in names}
    text = by_file(df, {c: (F.encode(x, "ISO-8859-1").cast("string"), x) for c, x in cells.items()})
    first = F.regexp_replace(cells[names[0]], "^\ufeff", "").alias(names[0])
    return text.select(first, *[cells[c] for c in names[1:]], *POSITION)


def name_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Positional rename of all columns (schema only, no job)."""
    return df.toDF(*names)


def read_text_csv(spark: SparkSession, path, columns: list[str] | None = None, encoding: str | None = "auto",
                  numbered: bool = False) -> DataFrame:
    """Header CSV read as text under the header's own names (stripped, BOM
    removed). Files whose header differs from the first one's raise. With
    ``columns`` only those are kept, and a missing one raises."""
    raw = "ISO-8859-1" if encoding == "auto" else encoding
    found = spark.read.option("header", True).option("encoding", raw).csv(path).columns
    df = _read_any(spark, path, all_strings(found), encoding, header=True, quote=True)
    names = [_utf8(c).lstrip("\ufeff").strip() for c in found] if encoding == "auto" else [c.strip().lstrip("\ufeff") for c in found]
    df = df.toDF(*names, *POSITION)
    if columns is not None:
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        df = df.select(*[F.col(f"`{c}`") for c in columns], *POSITION)
    if numbered:
        df = add_row_numbers(df)
    return df


def _utf8(name: str) -> str:
    try:
        return name.encode("ISO-8859-1").decode("utf-8")
    except UnicodeError:
        return name


def read_below_marker(spark: SparkSession, path, marker: str, numbered: bool = False) -> DataFrame:
    """CSV whose header is the first line containing ``marker``; lines above
    it are ignored and the lines below are parsed with the header's names.
    (The fixed behaviour: the header line itself is the header.) A file without
    such a line, and files whose headers differ, raise."""
    lines = lines_by_file(with_row_position(spark.read.text(path)))
    heads = (lines.filter(F.instr("value", marker) > 0)
             .groupBy("_file").agg(F.min(F.struct("_block", "_mid")).alias("_h")))
    missing = lines.select("_file").distinct().join(heads, "_file", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no line contains {marker!r} in {missing[0][0]}")
    first = heads.join(lines, "_file").filter(
        (F.col("_block") == F.col("_h._block")) & (F.col("_mid") == F.col("_h._mid"))).select("value").distinct().limit(2).collect()
    if not first:
        raise ValueError(f"no line contains {marker!r}")
    if len(first) > 1:
        raise ValueError(f"the files' headers differ: {[r.value for r in first]}")
    names = [c.strip().lstrip("\ufeff") for c in _split_header(first[0].value)]
    schema = all_strings(names)
    # rows of later splits lie below a header in the first one; only rows of the header's split are compared with it
    last = heads.agg(F.max("_h._block")).first()[0]
    near = lines.where(F.col("_block") <= last).join(heads, "_file").filter(F.struct("_block", "_mid") > F.col("_h")).drop("_h")
    body = lines.where(F.col("_block") > last).unionByName(near.select(*lines.columns))
    ddl = ", ".join(f"`{n}` STRING" for n in names)
    parsed = body.select(F.from_csv("value", ddl).alias("r"), *POSITION)
    df = parsed.select(*[F.col("r")[n].alias(n) for n in names], *POSITION)
    if numbered:
        df = add_row_numbers(df)
    return df


def _split_header(line: str) -> list[str]:
    import csv
    return next(csv.reader([line]))


def read_split_lines(spark: SparkSession, path, names: list[str], skip: int = 0, sep: str = ",") -> DataFrame:
    """Raw lines split on the delimiter without quote handling (a quoted
    "1,234" becomes two cells); blank lines dropped; ``_cells`` counts the
    cells of each line."""
    lines = lines_by_file(with_row_position(spark.read.text(path)))
    lines = skip_leading_rows(lines, skip).filter(F.trim("value") != "")
    parts = F.split(F.col("value"), sep, -1)
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)],
                        F.size(parts).alias("_cells"), *POSITION)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_entity(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                multiline: bool = True) -> DataFrame:
    """A table or document file with a declared schema; a typed empty table
    when the location does not exist."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.option("multiLine", multiline).json(path)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False, split: bool = False) -> DataFrame:
    """JSON objects (audit log, import history, users) with ``row_no`` in file
    order: an array per file (read by one task each, or with ``split`` by as
    many as its size asks for), or with ``lines`` one object per line (files
    are split)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("row_no", T.LongType())]))
    if split and not lines:
        ship_package(spark)
        found = read_split_array(spark, path, schema)
        return add_row_numbers(found.withColumnsRenamed({"_number": "_mid"}).withColumn("_block", F.lit(0))).select(*[F.col(f"`{f}`") for f in schema.fieldNames()], "row_no")
    df = with_row_position(spark.read.schema(schema).option("multiLine", not lines).json(path))
    return add_row_numbers(df).select(*[F.col(f"`{f}`") for f in schema.fieldNames()], "row_no")


def list_tables(spark: SparkSession, base: str) -> DataFrame:
    """Names of the table folders under ``base`` (a directory listing)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [] if not fs.exists(p) else sorted(
        s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))
    return spark.createDataFrame([(n,) for n in names], "name string")


def read_profile_csv(spark: SparkSession, path, sample_ratio: float = 1.0) -> DataFrame:
    """Header CSV with inferred types - for profiling scripts only; data paths
    use the explicit all-text readers."""
    return (spark.read.option("header", True).option("inferSchema", True)
            .option("samplingRatio", sample_ratio).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header line, written as a directory of part files (one per
    partition, written in parallel)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns) - one count job."""
    return df.count(), len(df.columns)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """A database table read in parallel: with a numeric ``partition_column``
    and its bounds, Spark issues ``num_partitions`` range queries at once
    instead of one full scan through a single connection."""
    props = dict(properties or {})
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=props)
    if lower_bound is None or upper_bound is None or not num_partitions:
        raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound, upperBound=upper_bound,
                           numPartitions=num_partitions, properties=props)

"""Readers for the catalogue's real input files, mapped to the engine's
column names: the wide stock sheet, the item master, the price catalogue,
the labelled action file and the positional item-selection file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.quality import check_input
from shelfspark.schemas import SELECTION_COLUMNS, SHEET_BANNER_ROWS, SHEET_COLUMNS, all_strings
from shelfspark.sources.files import POSITION, add_row_numbers, read_positional_csv, read_text_csv, with_row_position

# File labels -> engine column names.
ITEM_MASTER_LABELS = {"Master SKU": "master_sku", "Style ID / Parent SKU": "style", "Size": "size",
                      "Category": "category", "Loc": "loc"}
CATALOG_LABELS = {"Master SKU": "master_sku", "Launch Date": "launch_date", "Catalog Name": "catalog_name",
                  "Cost": "cost", "Wholesale Price": "wholesale_price", "Up Price": "up_price", "MRP": "mrp"}
ACTION_LABELS = {"Master SKU": "master_sku", "Style ID / Parent SKU": "item_name", "Size": "size",
                 "Category": "category", "Location": "location", "Cost": "cost", "Wholesale Price": "price",
                 "Catalog Name": "catalog", "MRP": "mrp", "Uniware Stock": "available_atp", "FBA": "fba_stock",
                 "FBF": "fbf_stock", "SJIT": "sjit_stock", "Launch Date": "updated", "Action": "action"}
SELECTION_NAMES = ["master_sku", "style", "size", "category", "location", "cost", "wholesale_price", "catalog",
                   "up_price", "uniware_stock", "fba", "fbf", "sjit", "launch_date"]


def _labelled(df: DataFrame, labels: dict, keep: list[str]) -> DataFrame:
    present = [k for k in labels if k in df.columns]
    return df.select(*[F.col(f"`{k}`").alias(labels[k]) for k in present], *keep)


def read_stock_sheet(spark: SparkSession, path, skip: int = SHEET_BANNER_ROWS, encoding: str = "UTF-8") -> DataFrame:
    """The wide stock sheet: banner rows skipped, the eight cells named by
    position, every value text; the position columns give file order."""
    return read_positional_csv(spark, path, SHEET_COLUMNS, skip=skip, encoding=encoding)


def read_item_master(spark: SparkSession, path, encoding: str = "auto") -> DataFrame:
    """Item master CSV (header row), ``row_no`` in file order. A file without
    the key column or without rows raises."""
    df = read_text_csv(spark, path, encoding=encoding)
    check_input(df, ["Master SKU"])
    return add_row_numbers(_labelled(df, ITEM_MASTER_LABELS, POSITION)).drop(*POSITION)


def read_catalog(spark: SparkSession, path, encoding: str = "auto") -> DataFrame:
    """Price catalogue CSV (header row, every value text), ``row_no`` in file
    order. A file without the key column or without rows raises."""
    df = read_text_csv(spark, path, encoding=encoding)
    check_input(df, ["Master SKU"])
    return add_row_numbers(_labelled(df, CATALOG_LABELS, POSITION)).drop(*POSITION)


def read_action_file(spark: SparkSession, path, encoding: str = "auto") -> DataFrame:
    """Labelled export with an Action column; ``row_no`` is the 1-based data
    row of the file (the numbering error messages use). A file without the
    Action column or without rows raises. Spark's CSV reader gives null both for an empty
    cell and for a cell missing from a short row, so both read as blank."""
    df = read_text_csv(spark, path, encoding=encoding)
    if "Action" not in df.columns:
        raise ValueError("the action file has no Action column")
    check_input(df)
    return add_row_numbers(_labelled(df, ACTION_LABELS, POSITION)).drop(*POSITION)


def read_selection_file(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Positional item-selection CSV: the header line is skipped, cells are
    named by position, ``n_fields`` counts the cells the line really has (an
    empty cell reads as '' and a missing one as null)."""
    r = (spark.read.schema(all_strings(SELECTION_NAMES)).option("header", False).option("mode", "PERMISSIVE")
         .option("nullValue", "\u0000").option("encoding", encoding).csv(path))
    from shelfspark.sources.files import skip_leading_rows
    df = skip_leading_rows(with_row_position(r), 1)
    n_fields = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in SELECTION_NAMES)
    return add_row_numbers(df.withColumn("n_fields", n_fields)).drop(*POSITION)


__all__ = ["read_stock_sheet", "read_item_master", "read_catalog", "read_action_file", "read_selection_file",
           "SELECTION_COLUMNS"]

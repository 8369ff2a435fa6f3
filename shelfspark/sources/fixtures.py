"""Entity views derived from the generated test tables.

The generated tables are a star schema, not catalogue files, so the
catalogue entities (item master, stock sheet, price catalogue, action file,
audit log) are derived from them with plain DataFrame expressions. Every view
keeps all rows of its base table; the oracle SQL in ``plans.oracle`` defines
the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Each view is one selectExpr over its base table: the SQL text is parsed in
# the JVM in one call, and Catalyst prunes the scan to the columns it uses.

ITEM_KEY_SQL = ("concat(CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE '' END, "
                "CASE WHEN p_partkey % 5 = 0 THEN 'sku-' ELSE 'SKU-' END, "
                "CAST(p_partkey - CASE WHEN p_partkey % 20 = 19 THEN 1 ELSE 0 END AS STRING))")
ITEM_CATEGORY_SQL = "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END"


def item_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master: padded and mixed-case keys, duplicated keys, null and blank categories."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_no", f"{ITEM_KEY_SQL} AS master_sku", "p_name AS style", "p_size AS size",
        f"{ITEM_CATEGORY_SQL} AS category", "p_brand AS loc")


# Columns of lineitem that together order the sheet rows (file order).
SHEET_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def stock_sheet(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Wide stock sheet: four independent (sku, qty) channels, junk keys, bad quantities.
    ``ordered`` sorts the table's numbers into file order, before the cells are made of them."""
    lines = table(spark, sf_dir, "lineitem")
    return (lines.orderBy(*SHEET_ORDER) if ordered else lines).selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_orderkey % 101 = 0 THEN 'paste here :-' WHEN l_orderkey % 103 = 0 THEN 'UNI' "
        "WHEN l_linenumber = 7 THEN NULL ELSE concat(' sku-', CAST(l_partkey AS STRING)) END AS uni",
        "CASE WHEN l_orderkey % 17 = 0 THEN 'n/a' WHEN l_orderkey % 19 = 0 THEN '1,234' "
        "ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS uni_stock",
        "CASE WHEN l_linenumber IN (1, 2, 7) THEN concat('SKU-', CAST(l_partkey + 3 AS STRING)) END AS fba",
        "CAST(l_linenumber * 2 AS STRING) AS fba_stock",
        "CASE WHEN l_linenumber IN (3, 4) THEN concat('SKU-', CAST(l_partkey * 2 AS STRING)) ELSE '' END AS fbf",
        "CAST(l_linenumber * 3 AS STRING) AS fbf_stock",
        "CASE WHEN l_linenumber = 5 THEN concat('Sku-', CAST(l_suppkey AS STRING)) END AS sjit",
        "CAST(l_linenumber AS STRING) AS sjit_stock",
        "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price catalogue file rows: two rows for many keys (last by row_no wins),
    unparsable costs, and rows whose key matches no item."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_no",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('OLD-', CAST(p_partkey AS STRING)) "
        "ELSE concat('SKU-', CAST(p_partkey - p_partkey % 2 AS STRING)) END AS master_sku",
        "concat('Catalog ', p_brand) AS catalog_name",
        "CASE WHEN p_partkey % 23 = 0 THEN 'Pending' WHEN p_partkey % 29 = 0 THEN '.' "
        "ELSE CAST(CAST(p_size AS BIGINT) * 10 AS STRING) END AS cost",
        "p_retailprice AS mrp")


# Columns of lineitem that together order the action file rows.
ACTION_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action file rows (one per line item): add / replace / delete / blank / unknown
    actions with the export columns as payload, some rows missing their SKU."""
    return _action_cells(table(spark, sf_dir, "lineitem"))


ACTION_INPUTS = [*ACTION_ORDER, "l_returnflag", "l_linestatus", "l_extendedprice", "l_tax", "l_shipdate"]


def _action_cells(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        *ACTION_ORDER,
        "CASE WHEN l_suppkey % 37 = 0 THEN ' ' ELSE concat('SKU-', CAST(l_partkey AS STRING)) END AS master_sku",
        "concat('Style ', CAST(l_suppkey AS STRING)) AS item_name",
        "CAST(l_linenumber AS STRING) AS size",
        "l_returnflag AS category", "l_linestatus AS location",
        "CAST(l_quantity AS STRING) AS cost", "CAST(l_extendedprice AS STRING) AS price",
        "concat('Catalog ', CAST(l_suppkey AS STRING)) AS catalog",
        "CASE WHEN l_linenumber = 6 THEN 'n/a' ELSE CAST(l_tax * 100 AS STRING) END AS mrp",
        "date_format(l_shipdate, 'yyyy-MM-dd') AS updated",
        "CASE WHEN l_linenumber = 1 THEN ' Add ' WHEN l_linenumber = 2 THEN 'replace' "
        "WHEN l_linenumber = 3 THEN 'DELETE' WHEN l_linenumber = 4 THEN 'merge' ELSE '' END AS action")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log entries from the event stream."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "concat('User', CAST(user_id AS STRING)) AS username",
        "upper(event_type) AS action", "ts", "value")


def numbered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action file rows with their 1-based row number in file order. The table's
    numbers are sorted, and the cells made of them after that."""
    from shelfspark.operators.tables import assign_ids
    return assign_ids(table(spark, sf_dir, "lineitem").select(*ACTION_INPUTS), ACTION_ORDER, id_col="row_no", cells=_action_cells)


def selection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-selection file rows (positional columns) for the legacy importer:
    the item master keys with prices and stock as text."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_no", f"{ITEM_KEY_SQL} AS master_sku", "p_name AS style",
        "CAST(p_size AS STRING) AS size", f"{ITEM_CATEGORY_SQL} AS category", "p_brand AS location",
        "CAST(p_retailprice AS STRING) AS cost", "CAST(p_size * 7 AS STRING) AS wholesale_price",
        "concat('Catalog ', p_brand) AS catalog", "CAST(p_size * 10 AS STRING) AS up_price",
        "CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END AS uniware_stock",
        "CAST(p_partkey % 4 AS STRING) AS fba", "'' AS fbf", "CAST(NULL AS STRING) AS sjit", "'' AS launch_date",
        "CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 14 END AS n_fields")


def legacy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing legacy item table: one row per catalogue key (last row wins)."""
    from shelfspark.functions.scalars import safe_int
    from shelfspark.operators.tables import last_per_key
    c = catalog_rows(spark, sf_dir)
    rows = c.select(
        "row_no", F.col("master_sku").alias("sku_code"), F.lit("Active").alias("status"),
        F.lit("old").alias("item_name"), F.lit("").alias("size"), F.lit("").alias("category"),
        F.lit("").alias("location"), safe_int(F.col("cost")).alias("cost"), F.lit(0).cast("bigint").alias("price"),
        F.col("catalog_name").alias("catalog"), safe_int(F.col("mrp")).alias("mrp"),
        *[F.lit(0).cast("bigint").alias(x) for x in ("available_atp", "fba_stock", "fbf_stock", "sjit_stock")],
        F.lit("").alias("updated"), F.lit("19700101_000000").alias("import_batch"))
    cols = [c for c in rows.columns if c not in ("row_no", "sku_code")]
    return last_per_key(rows, "sku_code", cols, "row_no")

"""Dashboard assembly: item master + merged stock (+ price catalogue) into
the published 15-column table, the older batch form, and the catalogue sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import ck, lenient_float, strip
from shelfspark.operators import skew
from shelfspark.operators.stock import channel_stock
from shelfspark.operators.tables import assign_ids, last_per_key, upsert
from shelfspark.schemas import DASHBOARD_COLUMNS, JUNK_SKUS, STOCK_COLUMNS

CATALOG_COLUMNS = ["launch_date", "catalog_name", "cost", "wholesale_price", "up_price", "mrp"]
PRICE_COLUMNS = ["cost", "wholesale_price", "up_price", "mrp"]


def _items(items: DataFrame, key_fn=ck) -> DataFrame:
    """Item master rows with the key cleaned and the publish names applied."""
    return items.select(
        F.col("row_no"),
        key_fn(F.col("master_sku")).alias("sku_code"),
        F.col("style").cast("string").alias("item_name"),
        F.col("size").cast("string").alias("size"),
        F.col("category").cast("string").alias("category"),
        F.col("loc").cast("string").alias("location"),
    )


def build_dashboard(items: DataFrame, stock: DataFrame, catalog: DataFrame | None = None,
                    canonical: bool = True) -> DataFrame:
    """Left-join stock (one row per SKU) and the price catalogue (one row per
    SKU) onto every item row; missing values take defaults.

    Duplicated item keys keep every row, each with the full stock of the key
    (parity: totals over the dashboard count such stock more than once).
    Both joins are on the same cleaned key, so the item side is exchanged
    once; AQE turns either join into a broadcast join when the measured side
    is small. An item key that holds a large share of the rows is split over
    several tasks (``operators/skew.py``), and null keys go round the joins.

    ``canonical=True`` trusts that the stock and catalogue keys are already
    canonical (both tables are only ever written that way), so the stock
    aggregate's hash partitioning on the key is reused by the join instead
    of re-cleaning the key and exchanging the stock side again.
    """
    item = _items(items)
    key = (lambda c: F.col(c)) if canonical else (lambda c: ck(F.col(c)))
    st = stock.select(
        key("master_sku").alias("sku_code"),
        F.col("uniware_stock").alias("available_atp"), "fba_stock", "fbf_stock", "sjit_stock")
    sides = [st]
    if catalog is not None:
        cat = catalog.select(key("master_sku").alias("sku_code"),
                             *[F.col(c) for c in CATALOG_COLUMNS])
        sides.append(cat)
        catalog_name = F.coalesce(F.col("catalog_name"), F.lit(""))
        prices = {"cost": "cost", "price": "wholesale_price", "mrp": "mrp", "up_price": "up_price"}
        price_cols = {k: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for k, v in prices.items()}
        updated = F.coalesce(F.col("launch_date"), F.lit(""))
    else:
        catalog_name = F.lit("")
        price_cols = {k: F.lit(0.0) for k in ("cost", "price", "mrp", "up_price")}
        updated = F.lit("")
    cols = {
        "catalog": catalog_name, "updated": updated, **price_cols,
        **{c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("available_atp", "fba_stock", "fbf_stock", "sjit_stock")},
    }
    out = skew.left_join(item, sides, "sku_code")
    return out.select("row_no", *[cols[c].alias(c) if c in cols else F.col(c) for c in DASHBOARD_COLUMNS])


def numbered_dashboard(items: DataFrame, stock: DataFrame, catalog: DataFrame | None = None, order: str = "row_no") -> DataFrame:
    """The dashboard with gap-free 1-based ids in item-file order. The items
    are numbered before the joins, which keep every item row: only their columns
    are written for it, not the dashboard's."""
    numbered = assign_ids(items, [order], id_col="_n").drop(order).withColumnRenamed("_n", "row_no")
    return build_dashboard(numbered, stock, catalog).withColumnRenamed("row_no", "id")


def publishable(dashboard: DataFrame, order: str = "row_no") -> DataFrame:
    """Dashboard with gap-free 1-based ids in item-file order (the ids the
    item queries page, sort and look up by)."""
    return assign_ids(dashboard, [order]).drop(order) if order != "id" else dashboard


def batch_dashboard(sheet: DataFrame, items: DataFrame, junk: list[str] = JUNK_SKUS) -> DataFrame:
    """Older file-to-file form: item keys and channel keys are stripped but not
    upper-cased; the channel totals are left-joined onto the items; prices are
    constant placeholders.

    The reference joins the four channel tables one after another; joining
    the one-pass channel merge once gives the same rows (a channel absent for
    a SKU is 0 either way) with one exchange instead of four.
    """
    stock = channel_stock(sheet, junk=junk, upper=False)
    st = stock.select(F.col("master_sku").alias("sku_code"), *STOCK_COLUMNS)
    out = skew.left_join(_items(items, key_fn=strip), st, "sku_code")
    stock_out = {"uniware_stock": "available_atp", "fba_stock": "fba_stock", "fbf_stock": "fbf_stock", "sjit_stock": "sjit_stock"}
    return out.select(
        "row_no",
        F.lit("").alias("updated"), "sku_code", "item_name", "size", "category", "location",
        F.lit("").alias("catalog"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("price"),
        F.lit(0.0).alias("up_price"), F.lit(0.0).alias("mrp"),
        *[F.coalesce(F.col(src), F.lit(0)).cast("bigint").alias(dst) for src, dst in stock_out.items()],
    )


def _catalog_rows(rows: DataFrame, order: str, legacy_null_text: bool = False) -> DataFrame:
    key = F.coalesce(F.col("master_sku"), F.lit("None")) if legacy_null_text else F.col("master_sku")
    cols = {
        "master_sku": ck(key),
        "launch_date": F.col("launch_date").cast("string") if "launch_date" in rows.columns else F.lit(None).cast("string"),
        "catalog_name": F.col("catalog_name").cast("string") if "catalog_name" in rows.columns else F.lit(None).cast("string"),
    }
    for c in PRICE_COLUMNS:
        cols[c] = lenient_float(F.col(c)) if c in rows.columns else F.lit(0.0)
    parsed = rows.select(*[v.alias(k) for k, v in cols.items()], F.col(order))
    return parsed.filter(F.col("master_sku").isNotNull() & (F.col("master_sku") != ""))


def catalog_updates(rows: DataFrame, order: str = "row_no", legacy_null_text: bool = False) -> DataFrame:
    """Catalogue file rows to table rows: key cleaned, prices parsed leniently
    (missing or unparsable = 0.0), blank and null keys skipped, last row per
    key in file order wins. ``legacy_null_text=True`` keeps a null key as the
    SKU 'NONE' instead of skipping it."""
    return last_per_key(_catalog_rows(rows, order, legacy_null_text), "master_sku", CATALOG_COLUMNS, order)


def sync_catalog(rows: DataFrame, target: DataFrame | None = None, order: str = "row_no",
                 legacy_null_text: bool = False) -> DataFrame:
    """Upsert catalogue file rows into the catalogue table (last write wins,
    keys not in the file are kept). The file's duplicates and the upsert are
    resolved in the same grouped aggregate: one exchange."""
    if target is None:
        return catalog_updates(rows, order, legacy_null_text)
    return upsert(target, _catalog_rows(rows, order, legacy_null_text), "master_sku", CATALOG_COLUMNS, order=order)

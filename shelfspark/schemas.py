"""Declared schemas, column vocabularies and fixed values.

The three vocabularies of one dashboard row are kept here: the published
column names, the labels used in exported / imported CSV files, and the
channel names of the wide stock sheet.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Column names of the wide stock sheet, in file order.
SHEET_COLUMNS = ["uni", "uni_stock", "fba", "fba_stock", "fbf", "fbf_stock", "sjit", "sjit_stock"]

# Banner rows above the data in the stock sheet.
SHEET_BANNER_ROWS = 3

# SKU values (compared lower-cased) that mark non-data rows in the sheet.
JUNK_SKUS = ["uni", "paste here :-"]

# Per-channel junk literals of the overlay script (compared case-sensitively).
OVERLAY_JUNK = {"uni": [], "fba": ["uni", "FBA"], "fbf": ["STOCK"], "sjit": ["STOCK"]}

# Published dashboard columns, in order.
DASHBOARD_COLUMNS = [
    "sku_code", "item_name", "size", "category", "location",
    "cost", "price", "catalog", "mrp", "up_price",
    "available_atp", "fba_stock", "fbf_stock", "sjit_stock", "updated",
]

# Labels shown for each dashboard column.
COLUMN_LABELS = {
    "sku_code": "Master SKU", "item_name": "Style ID / Parent SKU", "size": "Size",
    "category": "Category", "location": "Location", "cost": "Cost",
    "price": "Wholesale Price", "catalog": "Catalog Name", "mrp": "MRP", "up_price": "Up Price",
    "available_atp": "Uniware Stock", "fba_stock": "FBA", "fbf_stock": "FBF",
    "sjit_stock": "SJIT", "updated": "Launch Date",
}

# Columns of the CSV export, in order (up_price is not exported), then Action.
EXPORT_COLUMNS = [
    "sku_code", "item_name", "size", "category", "location",
    "cost", "price", "catalog", "mrp",
    "available_atp", "fba_stock", "fbf_stock", "sjit_stock", "updated",
]

# Columns sorted numerically by the dashboard query (others sort as lower-cased text).
NUMERIC_SORT_COLUMNS = ["id", "available_atp", "fba_stock", "sjit_stock", "fbf_stock", "cost", "price", "mrp"]

# Non-admin users see the first five columns unless a permission lists others.
DEFAULT_VISIBLE_COUNT = 5

# Declared column defaults of the stock state and the price catalogue.
STOCK_DEFAULTS = {"uniware_stock": 0, "fba_stock": 0, "fbf_stock": 0, "sjit_stock": 0}
CATALOG_DEFAULTS = {"cost": 0.0, "wholesale_price": 0.0, "up_price": 0.0, "mrp": 0.0}

# Actions understood in an action file.
ACTIONS = ["add", "replace", "delete"]

# At most this many row errors are reported by an action import.
MAX_ERROR_DETAILS = 20

# Page size limits of the item and log queries.
ITEM_PAGE_SIZE_MAX = 500
LOG_PAGE_SIZE_MAX = 200

# Positional columns of the item-selection CSV read by the legacy importer.
SELECTION_COLUMNS = [
    "Master SKU", "Style ID / Parent SKU", "Size", "Category", "Location", "Cost",
    "Wholesale Price", "Catalog Name", "Up Price", "Uniware Stock", "FBA", "FBF", "SJIT",
    "Launch Date",
]

# Text stamped into the legacy item table on import.
LEGACY_STATUS = "Active"

# ---------------------------------------------------------------------------
# Declared entity schemas
# ---------------------------------------------------------------------------

STOCK_COLUMNS = ["uniware_stock", "fba_stock", "fbf_stock", "sjit_stock"]

STOCK_UPDATE = T.StructType([
    T.StructField("master_sku", T.StringType(), False),
    T.StructField("uniware_stock", T.LongType(), False),
    T.StructField("fba_stock", T.LongType(), False),
    T.StructField("fbf_stock", T.LongType(), False),
    T.StructField("sjit_stock", T.LongType(), False),
])

CATALOG_PRICING = T.StructType([
    T.StructField("master_sku", T.StringType(), False),
    T.StructField("launch_date", T.StringType(), True),
    T.StructField("catalog_name", T.StringType(), True),
    T.StructField("cost", T.DoubleType(), True),
    T.StructField("wholesale_price", T.DoubleType(), True),
    T.StructField("up_price", T.DoubleType(), True),
    T.StructField("mrp", T.DoubleType(), True),
])

ITEM_MASTER = T.StructType([
    T.StructField("row_no", T.LongType(), True),
    T.StructField("master_sku", T.StringType(), True),
    T.StructField("style", T.StringType(), True),
    T.StructField("size", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("loc", T.StringType(), True),
])

STOCK_ITEMS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("sku_code", T.StringType(), True),
    T.StructField("item_name", T.StringType(), True),
    T.StructField("size", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("cost", T.DoubleType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("catalog", T.StringType(), True),
    T.StructField("mrp", T.DoubleType(), True),
    T.StructField("up_price", T.DoubleType(), True),
    T.StructField("available_atp", T.LongType(), True),
    T.StructField("fba_stock", T.LongType(), True),
    T.StructField("fbf_stock", T.LongType(), True),
    T.StructField("sjit_stock", T.LongType(), True),
    T.StructField("updated", T.StringType(), True),
])

LEGACY_ITEM = T.StructType([
    T.StructField("sku_code", T.StringType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("item_name", T.StringType(), True),
    T.StructField("size", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("cost", T.LongType(), True),
    T.StructField("price", T.LongType(), True),
    T.StructField("catalog", T.StringType(), True),
    T.StructField("mrp", T.LongType(), True),
    T.StructField("available_atp", T.LongType(), True),
    T.StructField("fba_stock", T.LongType(), True),
    T.StructField("fbf_stock", T.LongType(), True),
    T.StructField("sjit_stock", T.LongType(), True),
    T.StructField("updated", T.StringType(), True),
    T.StructField("import_batch", T.StringType(), True),
])

AUDIT_LOG = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("username", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("table_name", T.StringType(), True),
    T.StructField("record_id", T.StringType(), True),
    T.StructField("old_values", T.StringType(), True),
    T.StructField("new_values", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
])

IMPORT_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("filename", T.StringType(), True),
    T.StructField("imported_by", T.StringType(), True),
    T.StructField("total_rows", T.LongType(), True),
    T.StructField("new_rows", T.LongType(), True),
    T.StructField("updated_rows", T.LongType(), True),
    T.StructField("skipped_rows", T.LongType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
])

PERMISSION = T.StructType([
    T.StructField("visible", T.ArrayType(T.StringType()), True),
    T.StructField("editable", T.ArrayType(T.StringType()), True),
])

USER = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("username", T.StringType(), True),
    T.StructField("password", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("allowed_pages", T.ArrayType(T.StringType()), True),
    T.StructField("column_permissions", T.MapType(T.StringType(), PERMISSION), True),
    T.StructField("is_active", T.BooleanType(), True),
])


def all_strings(names: list[str]) -> T.StructType:
    """Schema with every column a nullable string (file inputs are read as text first)."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])

"""Dashboard and log queries: optional filters, sort, paging, KPIs, distinct
values, column visibility, export and display views.

Every query returns a lazy DataFrame; the page is cut by Spark
(``TakeOrderedAndProject``), never by collecting all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import contains_ci, dash_if_null, grouped_int, money, plain_number, non_blank, text_or_blank
from shelfspark.schemas import (COLUMN_LABELS, DASHBOARD_COLUMNS, DEFAULT_VISIBLE_COUNT, EXPORT_COLUMNS,
                                ITEM_PAGE_SIZE_MAX, LOG_PAGE_SIZE_MAX, NUMERIC_SORT_COLUMNS)


@dataclass
class PageResult:
    """One page of a query plus the plan of all matching rows (for the total)."""
    items: DataFrame
    matching: DataFrame
    page: int
    page_size: int
    source: DataFrame | None = None

    def stats(self) -> DataFrame:
        """Global KPIs over the unfiltered rows (one row)."""
        return kpis(self.source)

    def total(self) -> int:
        return self.matching.count()

    def total_pages(self, total: int | None = None) -> int:
        return page_count(self.total() if total is None else total, self.page_size)

    def envelope(self) -> dict:
        """The response a caller renders: the page's rows (at most one page,
        so bounded by the page-size limit), total, page, page size, page
        count and the global KPIs."""
        total = self.total()
        out = {"items": [r.asDict() for r in self.items.collect()], "total": total, "page": self.page,
               "page_size": self.page_size, "total_pages": page_count(total, self.page_size)}
        if self.source is not None:
            out["stats"] = self.stats().first().asDict()
        return out


def page_count(total: int, page_size: int) -> int:
    """ceil(total / size), and 1 for an empty result."""
    return (total + page_size - 1) // page_size if total else 1


def check_page(page: int, page_size: int, max_size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if page_size < 1 or page_size > max_size:
        raise ValueError(f"page_size must be between 1 and {max_size}")


def item_filters(df: DataFrame, search: str = "", status: str = "", availability: str = "",
                 category: str = "", legacy_null_text: bool = False) -> DataFrame:
    """Conjunction of the given filters; a blank parameter means no filter."""
    conds = []
    if search:
        q = search.lower()
        conds.append(contains_ci(text_or_blank("sku_code", legacy_null_text), q)
                     | contains_ci(text_or_blank("item_name", legacy_null_text), q))
    if status:
        if "status" in df.columns:
            conds.append(F.lower(text_or_blank("status", legacy_null_text)) == status.lower())
        else:
            conds.append(F.lit(False))  # the published table has no status column
    if availability:
        q = availability.lower()
        atp = F.coalesce(F.col("available_atp"), F.lit(0))
        cond = F.lower(atp.cast("string")) == q
        if q == "yes":
            cond = cond | (atp > 0)
        elif q == "no":
            cond = cond | (atp <= 0)
        conds.append(cond)
    if category:
        conds.append(contains_ci(text_or_blank("category", legacy_null_text), category))
    if not conds:
        return df
    return df.filter(reduce(lambda a, b: a & b, conds))


def sort_key(df: DataFrame, sort_by: str, numeric_cols=NUMERIC_SORT_COLUMNS, legacy_null_text: bool = False):
    """Numeric columns sort as double with null = 0, others as lower-cased text;
    an unknown column sorts nothing (id order)."""
    if sort_by in numeric_cols and sort_by in df.columns:
        return F.coalesce(F.col(sort_by).cast("double"), F.lit(0.0))
    if sort_by in numeric_cols:
        return F.lit(0.0)
    if sort_by in df.columns:
        return F.lower(text_or_blank(sort_by, legacy_null_text))
    return F.lit("")


def sort_items(df: DataFrame, sort_by: str = "id", sort_dir: str = "asc",
               numeric_cols=NUMERIC_SORT_COLUMNS, legacy_null_text: bool = False) -> list:
    """Order expressions: the key in the chosen direction, then id ascending
    (a stable sort keeps file order among ties in both directions)."""
    if not sort_by or not sort_dir:
        return [F.col("id").asc()]
    key = sort_key(df, sort_by, numeric_cols, legacy_null_text)
    key = key.desc() if sort_dir == "desc" else key.asc()
    return [key, F.col("id").asc()]


def kpis(items: DataFrame) -> DataFrame:
    """Global KPIs over all rows (before any filter); one row."""
    z = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    return items.agg(
        F.count(F.lit(1)).alias("total_skus"),
        F.sum(z("available_atp")).alias("total_stock"),
        F.sum(z("available_atp")).alias("total_available"),
        F.sum(z("fba_stock")).alias("total_fba"),
        F.sum(z("sjit_stock")).alias("total_sjit"),
        F.sum(z("fbf_stock")).alias("total_fbf"),
    ).select("total_skus", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in
                             ("total_stock", "total_available", "total_fba", "total_sjit", "total_fbf")])


def admin_stats(items: DataFrame) -> DataFrame:
    """The admin page's KPI row (same sums, other names)."""
    k = kpis(items)
    return k.select(F.col("total_skus").alias("total_items"), "total_available", "total_fba", "total_sjit", "total_fbf")


def query_items(items: DataFrame, search: str = "", status: str = "", availability: str = "",
                category: str = "", sort_by: str = "id", sort_dir: str = "asc", page: int = 1,
                page_size: int = 50, numeric_cols=NUMERIC_SORT_COLUMNS,
                legacy_null_text: bool = False) -> PageResult:
    """Filter, sort and page the dashboard. ``items`` must carry ``id``."""
    check_page(page, page_size, ITEM_PAGE_SIZE_MAX)
    matching = item_filters(items, search, status, availability, category, legacy_null_text)
    order = sort_items(matching, sort_by, sort_dir, numeric_cols, legacy_null_text)
    page_df = matching.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return PageResult(page_df, matching, page, page_size, source=items)


def keyset_page(items: DataFrame, after_id: int, page_size: int = 50) -> DataFrame:
    """Deep paging in id order without an offset scan: rows after a known id."""
    return items.filter(F.col("id") > after_id).orderBy("id").limit(page_size)


def find_items(items: DataFrame, prefix: str | None = None, keys: list[str] | None = None,
               item_id: int | None = None, non_blank_col: str | None = None) -> DataFrame:
    """Spot queries: key prefix (case-insensitive), key list, id, non-blank attribute."""
    conds = []
    if prefix is not None:
        conds.append(F.lower(F.col("sku_code")).startswith(prefix.lower()))
    if keys is not None:
        conds.append(F.col("sku_code").isin(*keys))
    if item_id is not None:
        conds.append(F.col("id") == item_id)
    if non_blank_col is not None:
        conds.append(non_blank(non_blank_col))
    return items if not conds else items.filter(reduce(lambda a, b: a & b, conds))


def lookup(df: DataFrame, key: str, value, order: str | None = None) -> DataFrame:
    """Point lookup: the first row, in ``order`` (default: id, else all columns),
    whose key equals ``value`` (at most one row)."""
    by = [order] if order else (["id"] if "id" in df.columns else df.columns)
    return df.filter(F.col(key) == value).orderBy(*by).limit(1)


def distinct_values(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """Sorted distinct non-blank values of a column (as text)."""
    v = F.col(col).cast("string")
    return df.select(v.alias(alias or col)).filter(non_blank(alias or col)).distinct().orderBy(alias or col)


def query_logs(logs: DataFrame, action: str = "", username: str = "", page: int = 1,
               page_size: int = 50, order: str | None = None) -> PageResult:
    """Audit log page: action equality (case-sensitive), user substring
    (case-insensitive), in file order (``row_no`` where the reader gave it, else id)."""
    order = order or ("row_no" if "row_no" in logs.columns else "id")
    check_page(page, page_size, LOG_PAGE_SIZE_MAX)
    conds = []
    if action:
        conds.append(F.col("action") == action)
    if username:
        conds.append(contains_ci(text_or_blank("username"), username))
    matching = logs if not conds else logs.filter(reduce(lambda a, b: a & b, conds))
    page_df = matching.orderBy(F.col(order).asc()).offset((page - 1) * page_size).limit(page_size)
    return PageResult(page_df, matching, page, page_size)


def keyset_logs(logs: DataFrame, after_id: int, page_size: int = 50, action: str = "", username: str = "") -> DataFrame:
    """Deep paging of the audit log: the next ``page_size`` entries after a
    known id, with the same optional filters (no offset scan)."""
    check_page(1, page_size, LOG_PAGE_SIZE_MAX)
    conds = [F.col("id") > after_id]
    if action:
        conds.append(F.col("action") == action)
    if username:
        conds.append(contains_ci(text_or_blank("username"), username))
    return logs.filter(reduce(lambda a, b: a & b, conds)).orderBy("id").limit(page_size)


def visible_columns(role: str, perms: dict | None = None, table: str = "item_master") -> dict:
    """Visible / editable column lists and labels for a role: admin sees all;
    others the columns their permission lists, or the first five."""
    if role == "admin":
        visible = list(DASHBOARD_COLUMNS)
        editable = list(DASHBOARD_COLUMNS)
    else:
        listed = ((perms or {}).get(table) or {}).get("visible")
        visible = [c for c in listed if c in DASHBOARD_COLUMNS] if listed else DASHBOARD_COLUMNS[:DEFAULT_VISIBLE_COUNT]
        editable = [c for c in visible if c != "sku_code"]
    return {"visible": visible, "editable": editable, "labels": dict(COLUMN_LABELS)}


def project_visible(df: DataFrame, role: str, perms: dict | None = None, keep_id: bool = True) -> DataFrame:
    """Enforce column visibility by projection (the reference only reports it)."""
    cols = visible_columns(role, perms)["visible"]
    return df.select(*(["id"] if keep_id and "id" in df.columns else []), *cols)


def export_view(items: DataFrame, labels: dict = COLUMN_LABELS) -> DataFrame:
    """The CSV export: fixed 14 columns under their labels, then a blank Action.
    ``mrp`` is exported under its label and ``up_price`` is not exported; how
    the MRP column is read back is chosen on import (``price_map``)."""
    return items.select(*[F.col(c).alias(labels.get(c, c)) for c in EXPORT_COLUMNS], F.lit("").alias("Action"))


def display_view(items: DataFrame, symbol: str = "") -> DataFrame:
    """Values as the dashboard shows them: '-' for null (blank stays blank),
    grouped stock numbers, two-decimal money for cost, price and MRP, other
    numbers as they are, in-stock flag."""
    text_cols = ["sku_code", "item_name", "size", "category", "location", "catalog", "updated"]
    return items.select(
        "id",
        *[dash_if_null(c).alias(c) for c in text_cols],
        *[money(c, symbol).alias(c) for c in ("cost", "price", "mrp")],
        plain_number("up_price").alias("up_price"),
        *[grouped_int(c).alias(c) for c in ("available_atp", "fba_stock", "fbf_stock", "sjit_stock")],
        (F.coalesce(F.col("available_atp"), F.lit(0)) > 0).alias("in_stock"),
    )


def change_flags(logs: DataFrame) -> DataFrame:
    """Whether each audit entry carries old / new values."""
    return logs.withColumns({
        "has_old": F.coalesce(non_blank("old_values"), F.lit(False)),
        "has_new": F.coalesce(non_blank("new_values"), F.lit(False)),
    })


def import_history(history: DataFrame) -> DataFrame:
    """Import history entries in file order (``row_no`` where the reader gave it, else id)."""
    return history.orderBy("row_no" if "row_no" in history.columns else "id")


def top(df: DataFrame, order, n: int) -> DataFrame:
    """First n rows in an explicit order."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)


def count_where(df: DataFrame, **conditions) -> DataFrame:
    """One row of conditional counts: name -> boolean Column."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def admin_kpis(users: DataFrame, logs: DataFrame, imports: DataFrame, day) -> DataFrame:
    """Totals the admin page shows: active users, log rows on ``day``, number
    of imports - three sources unioned as flags and summed in one aggregate."""
    a = users.select(F.coalesce(F.col("is_active"), F.lit(False)).cast("int").alias("a"),
                     F.lit(0).alias("b"), F.lit(0).alias("c"))
    b = logs.select(F.lit(0).alias("a"),
                    F.coalesce(F.to_date(F.col("timestamp")) == F.lit(day).cast("date"), F.lit(False)).cast("int").alias("b"),
                    F.lit(0).alias("c"))
    c = imports.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c"))
    return a.unionByName(b).unionByName(c).agg(
        *[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(n)
          for k, n in (("a", "active_users"), ("b", "logs_today"), ("c", "total_imports"))])


def public_users(users: DataFrame) -> DataFrame:
    """User rows without the password column."""
    return users.drop("password")


def user_visible_columns(users: DataFrame, table: str = "item_master") -> DataFrame:
    """Per user, the visible columns of a table: admin sees all, others the
    listed ones, else the first five (a nested field with a default)."""
    all_cols = F.array(*[F.lit(c) for c in DASHBOARD_COLUMNS])
    first = F.array(*[F.lit(c) for c in DASHBOARD_COLUMNS[:DEFAULT_VISIBLE_COUNT]])
    listed = F.col("column_permissions")[table]["visible"]
    visible = F.when(F.col("role") == "admin", all_cols).when(
        listed.isNotNull() & (F.size(listed) > 0), listed).otherwise(first)
    return users.select("id", "username", "role", visible.alias("visible"),
                        F.array_join(visible, ", ").alias("visible_text"))


def page_access(users: DataFrame, page: str) -> DataFrame:
    """Whether each user may open a page (listed in allowed_pages, or admin)."""
    allowed = (F.col("role") == "admin") | F.coalesce(F.array_contains("allowed_pages", page), F.lit(False))
    return users.select("id", "username", allowed.alias("allowed"))

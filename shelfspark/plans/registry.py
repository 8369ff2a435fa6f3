"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole generated tables. Names match ``plans.oracle.oracle_sql``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.scalars import ck, contains_ci, json_list, non_blank, strip
from shelfspark.operators import actions, commits, derived, paging, quality, query, stock, tables
from shelfspark.operators import dashboard as dash
from shelfspark.schemas import CATALOG_DEFAULTS, CATALOG_PRICING, ITEM_MASTER, SHEET_COLUMNS, STOCK_COLUMNS, STOCK_ITEMS, STOCK_UPDATE
from shelfspark.session import checkpoint_dir
from shelfspark.sources import entities, files
from shelfspark.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def _stock(spark, sf):
    return stock.channel_stock(fx.stock_sheet(spark, sf))


def _board(spark, sf, priced: bool = False) -> DataFrame:
    """The dashboard rows without ids (for totals, filters and views that do
    not page, sort or look up by id)."""
    items = fx.item_master(spark, sf)
    catalog = dash.sync_catalog(fx.catalog_rows(spark, sf)) if priced else None
    return dash.build_dashboard(items, _stock(spark, sf), catalog)


def _numbered(spark, sf, priced: bool = False) -> DataFrame:
    """The dashboard rows with gap-free ids in item-file order."""
    catalog = dash.sync_catalog(fx.catalog_rows(spark, sf)) if priced else None
    return dash.numbered_dashboard(fx.item_master(spark, sf), _stock(spark, sf), catalog)


def _publish(spark, sf, priced: bool = False) -> str:
    base = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}", "stock_items")
    tables.publish(_numbered(spark, sf, priced), base, sort_within="id")
    return base


_PUBLISHED: dict[tuple, str] = {}  # tables that this application has published, by input files


def _input_files(spark, sf) -> tuple:
    """Path, size and time of the files that a dashboard is made from: other files, another dashboard."""
    out = []
    for name in ("part", "lineitem"):
        fs, path = commits.file_system(spark, f"{sf.rstrip('/')}/{name}.parquet")
        found = fs.listStatus(path)
        out += [(st.getPath().toString(), st.getLen(), st.getModificationTime()) for st in found]
    return tuple(sorted(out))


def _dashboard(spark, sf, priced: bool = False) -> DataFrame:
    """The published dashboard that pages and lookups read: stored sorted by id,
    so that they scan only the columns and row groups that they need. It is
    published once for the input's files (``dashboard_publish`` times that)."""
    key = (spark.sparkContext.applicationId, _input_files(spark, sf), priced)
    if key not in _PUBLISHED:
        _PUBLISHED[key] = _publish(spark, sf, priced)
    return spark.read.parquet(*tables.current_paths(spark, _PUBLISHED[key]))


def _with_gaps(board: DataFrame) -> DataFrame:
    """Every item of the generated tables has stock; here some have none, an
    unknown or a negative one."""
    atp = F.col("available_atp")
    return board.withColumn("available_atp", F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 == 1, None)
                            .when(F.col("id") % 10 == 2, -atp).otherwise(atp).cast("bigint"))


def q_channel_stock(spark, sf):
    return _stock(spark, sf)


def q_clean_stock(spark, sf):
    return stock.clean_stock(fx.stock_sheet(spark, sf))


def q_dashboard(spark, sf):
    return _numbered(spark, sf)


def q_dashboard_priced(spark, sf):
    return _numbered(spark, sf, priced=True)


def q_dashboard_publish(spark, sf):
    """Publish the dashboard (on every call) and read the published rows."""
    return spark.read.parquet(*tables.current_paths(spark, _publish(spark, sf)))


def q_dashboard_page_range(spark, sf):
    """Rows of a range of ids of a dashboard in slices: only the slices that hold them are read."""
    base, _ = _refreshed(spark, sf)
    return tables.current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS, between=(101, 400))


def q_kpi(spark, sf):
    return query.kpis(_board(spark, sf))


def q_duplicates(spark, sf):
    items = fx.item_master(spark, sf).select(ck("master_sku").alias("master_sku"))
    return quality.duplicate_report(items, "master_sku")


def q_items_page(spark, sf):
    res = query.query_items(_dashboard(spark, sf), category="econ", sort_by="available_atp",
                            sort_dir="desc", page=2, page_size=50)
    return res.items


def q_orphan_stock(spark, sf):
    items = fx.item_master(spark, sf).select(ck("master_sku").alias("sku_code"))
    return quality.orphan_stock(_stock(spark, sf), items)


def q_catalog_last(spark, sf):
    return dash.sync_catalog(fx.catalog_rows(spark, sf))


def q_action_counts(spark, sf):
    a = fx.action_rows(spark, sf)
    return a.groupBy(F.lower(strip("action")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def q_audit_counts(spark, sf):
    logs = fx.audit_log(spark, sf)
    return (logs.filter(contains_ci("username", "user1"))
            .groupBy("action").agg(F.count(F.lit(1)).alias("n")))


def q_batch_dashboard(spark, sf):
    return dash.batch_dashboard(fx.stock_sheet(spark, sf), fx.item_master(spark, sf))


def _actions(spark, sf):
    return actions.apply_actions(fx.item_master(spark, sf), dash.sync_catalog(fx.catalog_rows(spark, sf)),
                                 fx.numbered_actions(spark, sf))


def q_actions_items(spark, sf):
    return _actions(spark, sf).items


def q_actions_catalog(spark, sf):
    return _actions(spark, sf).catalog


def q_actions_summary(spark, sf):
    rows = fx.action_rows(spark, sf).withColumn("row_no", F.lit(0))  # counts need no row numbers
    return actions.summarise(actions.classify_actions(rows))


def q_actions_errors(spark, sf):
    return actions.error_details(_actions(spark, sf).errors)


def q_actions_errors_all(spark, sf):
    return _actions(spark, sf).errors


IMPORT_TS = "2024-01-02 03:04:05"


def _import(spark, sf):
    return actions.import_items(fx.legacy_items(spark, sf), fx.selection_rows(spark, sf), IMPORT_TS)


def q_import_result(spark, sf):
    return _import(spark, sf)[0]


def q_import_summary(spark, sf):
    return _import(spark, sf)[1]


def q_catalog_sync(spark, sf):
    rows = fx.catalog_rows(spark, sf)
    old = dash.sync_catalog(rows.filter("row_no % 2 = 0"))
    return dash.sync_catalog(rows.filter("row_no % 2 <> 0"), target=old)


def _snapshots(spark, sf):
    sheet = fx.stock_sheet(spark, sf)
    return sheet.withColumn("snapshot", F.when(F.year("l_shipdate") < 1998, 1).otherwise(2))


def q_stock_upsert(spark, sf):
    sheet = _snapshots(spark, sf)
    state = stock.channel_stock(sheet.filter(F.col("snapshot") == 1))
    newest = stock.channel_stock(sheet.filter(F.col("snapshot") == 2))
    return tables.upsert(state, newest, "master_sku", STOCK_COLUMNS, unique_inputs=True)


def q_stock_snapshots(spark, sf):
    return stock.snapshot_stock(_snapshots(spark, sf), "snapshot")


def q_channel_stock_join(spark, sf):
    return stock.channel_stock(fx.stock_sheet(spark, sf), method="join")


def q_overlay_stock(spark, sf):
    items = fx.selection_rows(spark, sf).drop("n_fields")
    return stock.overlay_stock(items, fx.stock_sheet(spark, sf), fx.SHEET_ORDER,
                               stock_cols=["uniware_stock", "fba", "fbf", "sjit"])


def q_item_search(spark, sf):
    return query.query_items(_dashboard(spark, sf), search="KU-12").matching


def q_item_availability_yes(spark, sf):
    return query.query_items(_with_gaps(_dashboard(spark, sf)), availability="yes").matching


def q_item_availability_no(spark, sf):
    return query.query_items(_with_gaps(_dashboard(spark, sf)), availability="no").matching


def q_item_prefix(spark, sf):
    return query.find_items(_dashboard(spark, sf), prefix="sku-1")


def q_item_in(spark, sf):
    return query.find_items(_dashboard(spark, sf), keys=["SKU-10", "SKU-18", "SKU-400", "SKU-999999"])


def q_item_lookup(spark, sf):
    return query.lookup(_dashboard(spark, sf), "sku_code", "SKU-18")


def q_logs_by_action(spark, sf):
    return query.query_logs(fx.audit_log(spark, sf), action="CLICK", username="user1", page=1, page_size=100).items


def _refreshed(spark, sf) -> tuple[str, DataFrame]:
    """Two refreshes, each from the rows of one snapshot, on top of each other:
    the stock state keeps the SKUs that the second omits, and the second writes
    only the dashboard slices that hold a changed SKU."""
    from shelfspark.streaming.refresh import refresh_batch
    base = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}")
    tables.publish(fx.item_master(spark, sf), os.path.join(base, "item_master"), schema=ITEM_MASTER)
    for n in (1, 2):
        sheet = _snapshots(spark, sf).where(F.col("snapshot") == n).select(
            *SHEET_COLUMNS, F.lit(f"s{n}").alias("_file"), F.lit(0).alias("_block"), F.lit(n).alias("_mtime"),
            F.monotonically_increasing_id().alias("_mid"))
        refresh_batch(spark, sheet, None, base, skip=0)
    return base, tables.current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE)


def q_refresh_twice(spark, sf):
    return _refreshed(spark, sf)[1]


def q_refresh_dashboard(spark, sf):
    """The dashboard after a full and an incremental refresh."""
    base, _ = _refreshed(spark, sf)
    return tables.current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS)


def q_import_dashboard(spark, sf):
    """The dashboard after an import of the action file and then one of its own
    rows again (added at the end), both through the tables' commits."""
    from shelfspark.streaming.refresh import actions_batch
    base = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}")
    tables.publish(fx.item_master(spark, sf), os.path.join(base, "item_master"), schema=ITEM_MASTER)
    place = F.struct(*fx.ACTION_ORDER).alias("_mid")
    for n, some in enumerate((F.lit(True), F.col("l_linenumber") == 1)):
        rows = fx.action_rows(spark, sf).where(some).select("*", F.lit(f"f{n}").alias("_file"), F.lit(n).alias("_mtime"), F.lit(0).alias("_block"), place)
        actions_batch(spark, rows, f"import#{n}", base)
    return tables.current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS).select("id", "sku_code", "item_name", "size", "cost", "up_price", "catalog")


def q_load_appends(spark, sf):
    """A table loaded by two appends: ids go on in order of arrival."""
    base = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}")
    rows = fx.table(spark, sf, "part").select("p_partkey", "p_name")
    for odd in (0, 1):
        tables.load_table(rows.where(F.col("p_partkey") % 2 == odd), base, "parts", "append")
    return tables.read_table(spark, base, "parts")


def q_catalog_from_csv(spark, sf):
    """The price catalogue written as labelled CSV files and read back."""
    labels = {v: k for k, v in entities.CATALOG_LABELS.items()}
    path = os.path.join(checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    rows = fx.catalog_rows(spark, sf)
    files.write_csv(rows.select(*[F.col(c).alias(labels[c]) for c in ("master_sku", "catalog_name", "cost", "mrp")]), path)
    return entities.read_catalog(spark, path).select("master_sku", "catalog_name", "cost", "mrp")


def q_items_from_marker_file(spark, sf):
    """The item master below lines of other text, found by its header line."""
    rows = fx.item_master(spark, sf).select(F.concat_ws(",", F.trim("master_sku"), "size", "loc").alias("value"))
    path = _written_lines(spark, rows, ["Stock list,,", "Master SKU,Size,Loc"])
    return files.read_below_marker(spark, path, "Master SKU").select(
        F.col("Master SKU").alias("master_sku"), F.col("Size").alias("size"), F.col("Loc").alias("loc"))


def q_logs_from_json(spark, sf):
    """The audit log written as JSON lines and read back in file order."""
    path = os.path.join(checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    logs = fx.audit_log(spark, sf).select("id", "username", "action")
    logs.write.json(path)
    return files.read_json_array(spark, path, logs.schema, lines=True).select("id", "username", "action")


def q_logs_from_array(spark, sf):
    """The audit log written as one JSON array per file and read back by splits."""
    path = os.path.join(checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    logs = fx.audit_log(spark, sf).select("id", "username", "action")
    line = F.to_json(F.struct("*"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task, so of a file
    opened = logs.orderBy("id").select(F.concat(F.when(first, "[").otherwise(","), line).alias("value"))
    opened.write.text(path)
    return files.read_json_array(spark, path, logs.schema, split=True)


def q_item_by_id(spark, sf):
    return query.find_items(_dashboard(spark, sf), item_id=17)


def q_item_sort_text(spark, sf):
    return query.query_items(_dashboard(spark, sf), sort_by="category", sort_dir="asc", page=3, page_size=100).items


def q_item_sort_numeric(spark, sf):
    return query.query_items(_dashboard(spark, sf), sort_by="fba_stock", sort_dir="desc", page=1, page_size=200).items


def q_filters_categories(spark, sf):
    return query.distinct_values(_board(spark, sf), "category")


def q_log_actions(spark, sf):
    return query.distinct_values(fx.audit_log(spark, sf), "action")


def q_logs_page(spark, sf):
    return query.query_logs(fx.audit_log(spark, sf), username="user2", page=3, page_size=200).items


def q_audit_daily(spark, sf):
    logs = fx.audit_log(spark, sf)
    return (logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action")
            .agg(F.count(F.lit(1)).alias("n")))


def q_export_view(spark, sf):
    return query.export_view(_board(spark, sf, priced=True))


def q_visible_viewer(spark, sf):
    return query.project_visible(_dashboard(spark, sf), "viewer", None)


def q_display_view(spark, sf):
    return query.display_view(_dashboard(spark, sf, priced=True), symbol="Rs ")


def q_reconcile(spark, sf):
    """All stages in one run: one scan of the sheet, one of the items."""
    items = fx.item_master(spark, sf).select(ck("master_sku").alias("master_sku"))
    return quality.flow_totals(stock.clean_stock(fx.stock_sheet(spark, sf)), ["uni_stock", "fba_stock", "fbf_stock", "sjit_stock"],
                               stock.merge_channels, items, RECON, merged_cols=STOCK_COLUMNS)


def q_reconcile_stages(spark, sf):
    """The same totals of stages that are given one by one."""
    sheet = fx.stock_sheet(spark, sf)
    items = fx.item_master(spark, sf)
    cleaned = stock.clean_stock(sheet)
    merged = stock.channel_stock(sheet)
    dashboard = dash.build_dashboard(items, merged)
    orphans = quality.orphan_stock(merged, items.select(ck("master_sku").alias("sku_code")))
    as_stock = lambda d, cols: d.select(*[F.col(c).alias(n) for c, n in zip(cols, RECON)])
    return quality.reconcile({
        "clean": as_stock(cleaned, ["uni_stock", "fba_stock", "fbf_stock", "sjit_stock"]),
        "merged": as_stock(merged, STOCK_COLUMNS),
        "dashboard": as_stock(dashboard, ["available_atp", "fba_stock", "fbf_stock", "sjit_stock"]),
        "orphans": as_stock(orphans, STOCK_COLUMNS),
    }, RECON)


def q_row_fields(spark, sf):
    return quality.row_fields(_dashboard(spark, sf, priced=True), "id")


def q_load_table_text(spark, sf):
    return tables.as_text_table(fx.table(spark, sf, "part"))


def q_table_counts(spark, sf):
    names = ["part", "lineitem", "orders", "events"]
    counts = tables.table_counts(spark, [f"{sf.rstrip('/')}/{n}.parquet" for n in names])
    return counts.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("table_name"), "rows", "error")


def q_key_profile(spark, sf):
    items = fx.item_master(spark, sf).select(ck("master_sku").alias("master_sku"))
    return quality.key_profile(items, "master_sku")


def q_duplicate_sample(spark, sf):
    items = fx.item_master(spark, sf).withColumn("master_sku", ck("master_sku"))
    return quality.duplicate_report(items, "master_sku", sample=3)


def q_admin_stats(spark, sf):
    return query.admin_stats(_board(spark, sf))


def q_count_where(spark, sf):
    d = _board(spark, sf)
    return query.count_where(d, with_category=non_blank("category"), in_stock=F.col("available_atp") > 0)


def q_fan_out(spark, sf):
    items = fx.item_master(spark, sf).select(ck("master_sku").alias("sku_code"))
    joined = dash.build_dashboard(fx.item_master(spark, sf), _stock(spark, sf))
    return quality.fan_out(items, joined, "sku_code")


def q_next_id(spark, sf):
    return tables.next_id(_dashboard(spark, sf))


def q_channel_totals_fba(spark, sf):
    cleaned = stock.clean_stock(fx.stock_sheet(spark, sf))
    return stock.channel_totals(cleaned, "fba", "fba_stock")


def q_channel_stock_keep_rows(spark, sf):
    return stock.channel_stock(fx.stock_sheet(spark, sf), drop_when_first_null=False)


def q_channel_stock_thousands(spark, sf):
    return stock.channel_stock(fx.stock_sheet(spark, sf), thousands=True)


def q_channel_stock_last(spark, sf):
    return stock.channel_stock(fx.stock_sheet(spark, sf), duplicates="last", order=fx.SHEET_ORDER)


def q_column_totals(spark, sf):
    return quality.column_totals(_board(spark, sf), ["available_atp", "fba_stock", "fbf_stock", "sjit_stock"])


def q_top_stock(spark, sf):
    return query.top(_dashboard(spark, sf), [F.col("available_atp").desc(), F.col("id").asc()], 10)


def q_keyset_page(spark, sf):
    return query.keyset_page(_dashboard(spark, sf), after_id=1000, page_size=50)


def q_visible_custom(spark, sf):
    perms = {"item_master": {"visible": ["sku_code", "cost", "available_atp"]}}
    return query.project_visible(_dashboard(spark, sf, priced=True), "viewer", perms)


def q_legacy_status(spark, sf):
    status = F.expr("CASE WHEN cost % 30 = 0 THEN 'active ' WHEN cost % 20 = 0 THEN 'Closed' WHEN cost % 50 = 0 THEN NULL ELSE status END")
    return query.item_filters(_import(spark, sf)[0].withColumn("status", status), status="ACTIVE", search="sku-1")


def q_item_sort_text_legacy(spark, sf):
    return query.query_items(_dashboard(spark, sf), sort_by="category", sort_dir="desc", page=1, page_size=300,
                             legacy_null_text=True).items


def q_audit_windows(spark, sf):
    """The streaming audit counter's aggregation run as a batch over the log
    (the watermark has no effect on a batch plan)."""
    from shelfspark.streaming.refresh import stream_audit_counts
    counts = stream_audit_counts(fx.audit_log(spark, sf), watermark="1 hour", window="1 day", ts_col="ts")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                         F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "action", "n")


def q_sorted_page(spark, sf):
    """A deep page from the published copy in the order of a text column."""
    base = _publish(spark, sf)
    root, board = os.path.split(base)
    items = spark.read.schema(STOCK_ITEMS).parquet(*tables.current_paths(spark, base))
    paging.publish_sorted(items, root, board, "category", "desc")
    return paging.sorted_page(spark, root, board, "category", "desc", page=9, page_size=100)


def q_published_defaults(spark, sf):
    """Catalogue rows published without some declared columns: those take their defaults."""
    base = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}", "catalog_pricing")
    rows = dash.sync_catalog(fx.catalog_rows(spark, sf))
    some = rows.select("master_sku", "catalog_name", F.when(F.col("cost") > 200, F.col("cost")).alias("cost"))
    tables.publish(some, base, schema=CATALOG_PRICING, unique_key="master_sku", defaults=CATALOG_DEFAULTS)
    return tables.current(spark, base, CATALOG_PRICING)


def q_indexed_search(spark, sf):
    """The item search through a published trigram index."""
    base = _publish(spark, sf)
    root, board = os.path.split(base)
    items = spark.read.schema(STOCK_ITEMS).parquet(*tables.current_paths(spark, base))
    derived.publish_grams(items, root, board)
    return derived.indexed_search(spark, root, board, "KU-12", STOCK_ITEMS)


def q_merged_profile(spark, sf):
    """Rows, nulls and sums of a table of two loads, merged from a profile of each."""
    root = os.path.join(checkpoint_dir(spark), f"tables-{uuid.uuid4().hex}")
    sheet = fx.stock_sheet(spark, sf).select("uni", "fba", "l_orderkey")
    for odd in (0, 1):
        half = sheet.where(F.col("l_orderkey") % 2 == odd)
        path = os.path.join(root, "sheet", f"v-{uuid.uuid4().hex}")
        half.write.parquet(path)
        commits.commit(spark, root, lambda now: now._replace(tables=now.tables | {"sheet": [*now.paths("sheet"), path]}))
        derived.update_profile(spark, root, "sheet", sheet.schema)
    return derived.profile(spark, root, "sheet").select("column", "rows", "nulls", F.col("total").cast("long").alias("total"))


def _users(spark, sf):
    """Accounts of the application: roles, pages as JSON text, listed columns."""
    pages = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 7 == 1, "oops").otherwise(
        F.concat(F.lit('["dashboard", "'), F.lower("c_mktsegment"), F.lit('"]')))
    listed = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("sku_code"), F.lit("mrp"))).when(F.col("c_custkey") % 3 == 1, F.array().cast("array<string>"))
    return fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("viewer").alias("role"),
        json_list(pages).alias("allowed_pages"), (F.col("c_acctbal") > 0).alias("is_active"), F.lit("secret").alias("password"),
        F.struct(F.struct(listed.alias("visible")).alias("item_master")).alias("column_permissions"))


def q_user_page_access(spark, sf):
    return query.page_access(query.public_users(_users(spark, sf)), "machinery")


def q_user_columns(spark, sf):
    return query.user_visible_columns(_users(spark, sf)).drop("visible")


def q_admin_kpis(spark, sf):
    logs = fx.audit_log(spark, sf).withColumnRenamed("ts", "timestamp")
    return query.admin_kpis(_users(spark, sf), logs, fx.table(spark, sf, "orders"), "2024-01-02")


def q_import_history(spark, sf):
    history = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("filename"))
    return query.import_history(history)


def q_log_changes(spark, sf):
    """Which audit entries carry old and new values."""
    logs = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("props")).alias("old_values"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("new_values"))
    return query.change_flags(logs).select("id", "has_old", "has_new")


def q_kpi_difference(spark, sf):
    """The KPI row of the dashboard against that of one whose stock was lost in part."""
    board = _board(spark, sf)
    lossy = board.withColumn("fba_stock", F.when(F.col("row_no") % 10 != 0, F.col("fba_stock")))
    return quality.kpi_difference(query.kpis(board), query.kpis(lossy))


def q_update_delete(spark, sf):
    """Catalogue rows with new names for some keys, others deleted by key."""
    catalog = dash.sync_catalog(fx.catalog_rows(spark, sf)).select("master_sku", "catalog_name", "cost")
    part = fx.table(spark, sf, "part")
    names = part.where(F.col("p_partkey") % 4 == 0).select(F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("master_sku"), F.col("p_name").alias("catalog_name"))
    gone = part.where(F.col("p_partkey") % 10 == 0).select(F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("master_sku"))
    return tables.delete_matched(tables.update_matched(catalog, names, "master_sku", ["catalog_name"]), gone, "master_sku")


def q_overlay_stock_junk(spark, sf):
    """The overlay from a sheet in which junk literals stand in the SKU cells."""
    junk = {"uni": "uni", "fba": "FBA", "fbf": "STOCK", "sjit": "STOCK"}
    sheet = fx.stock_sheet(spark, sf).withColumns({c: F.when(F.col("l_linenumber") == 1 + i, j).otherwise(F.col(c)) for i, (c, j) in enumerate(junk.items())})
    items = fx.selection_rows(spark, sf).drop("n_fields").withColumn(
        "master_sku", F.when(F.col("row_no") % 5 < 4, F.col("master_sku")).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("uni", "FBA", "STOCK")]), (F.col("row_no") % 3 + 1).cast("int"))))
    return stock.overlay_stock(items, sheet, fx.SHEET_ORDER, stock_cols=["uniware_stock", "fba", "fbf", "sjit"])


def _written_lines(spark, rows, above: list[str]) -> str:
    """``rows`` (one text column, ``value``) as text files, one per task, with some lines above each."""
    path = os.path.join(checkpoint_dir(spark), f"text-{uuid.uuid4().hex}")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = F.array(*[F.lit(x) for x in above], F.col("value"))
    rows.select(F.explode(F.when(first, head).otherwise(F.array("value"))).alias("value")).write.text(path)
    return path


def q_sheet_from_csv(spark, sf):
    """The stock sheet as CSV below its banner lines, read by position with row numbers in file order."""
    cells = F.concat_ws(",", *[F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("")) for c in SHEET_COLUMNS])
    sheet = fx.stock_sheet(spark, sf, ordered=True)
    path = _written_lines(spark, sheet.select(cells.alias("value")), ["Stock,,,,,,,", "note,,,,,,,", ",".join(SHEET_COLUMNS)])
    return files.read_positional_csv(spark, path, SHEET_COLUMNS, skip=3, numbered=True).drop(*files.POSITION)


def q_split_lines(spark, sf):
    """Lines split without quotes, with the number of their cells."""
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.regexp_replace("p_type", " ", ","), F.lit('"')))
    path = _written_lines(spark, fx.table(spark, sf, "part").select(line.alias("value")), ["key,type"])
    return files.read_split_lines(spark, path, ["p_partkey", "t1", "t2"], skip=1).drop(*files.POSITION)


RECON = ["uni", "fba", "fbf", "sjit"]

QUERIES: dict[str, Query] = {
    "channel_stock": q_channel_stock,
    "clean_stock": q_clean_stock,
    "dashboard": q_dashboard,
    "dashboard_priced": q_dashboard_priced,
    "kpi": q_kpi,
    "duplicates": q_duplicates,
    "items_page": q_items_page,
    "orphan_stock": q_orphan_stock,
    "catalog_last": q_catalog_last,
    "action_counts": q_action_counts,
    "audit_counts": q_audit_counts,
    "batch_dashboard": q_batch_dashboard,
    "actions_items": q_actions_items,
    "actions_catalog": q_actions_catalog,
    "actions_summary": q_actions_summary,
    "actions_errors": q_actions_errors,
    "import_result": q_import_result,
    "import_summary": q_import_summary,
    "catalog_sync": q_catalog_sync,
    "stock_upsert": q_stock_upsert,
    "stock_snapshots": q_stock_snapshots,
    "channel_stock_join": q_channel_stock_join,
    "overlay_stock": q_overlay_stock,
    "item_search": q_item_search,
    "item_availability_yes": q_item_availability_yes,
    "item_availability_no": q_item_availability_no,
    "item_prefix": q_item_prefix,
    "item_in": q_item_in,
    "actions_errors_all": q_actions_errors_all,
    "item_lookup": q_item_lookup,
    "logs_by_action": q_logs_by_action,
    "refresh_twice": q_refresh_twice,
    "refresh_dashboard": q_refresh_dashboard,
    "import_dashboard": q_import_dashboard,
    "load_appends": q_load_appends,
    "dashboard_publish": q_dashboard_publish,
    "reconcile_stages": q_reconcile_stages,
    "indexed_search": q_indexed_search,
    "published_defaults": q_published_defaults,
    "merged_profile": q_merged_profile,
    "sorted_page": q_sorted_page,
    "user_page_access": q_user_page_access,
    "user_columns": q_user_columns,
    "admin_kpis": q_admin_kpis,
    "import_history": q_import_history,
    "log_changes": q_log_changes,
    "kpi_difference": q_kpi_difference,
    "update_delete": q_update_delete,
    "overlay_stock_junk": q_overlay_stock_junk,
    "sheet_from_csv": q_sheet_from_csv,
    "split_lines": q_split_lines,
    "dashboard_page_range": q_dashboard_page_range,
    "catalog_from_csv": q_catalog_from_csv,
    "items_from_marker_file": q_items_from_marker_file,
    "logs_from_json": q_logs_from_json,
    "logs_from_array": q_logs_from_array,
    "item_by_id": q_item_by_id,
    "item_sort_text": q_item_sort_text,
    "item_sort_numeric": q_item_sort_numeric,
    "filters_categories": q_filters_categories,
    "log_actions": q_log_actions,
    "logs_page": q_logs_page,
    "audit_daily": q_audit_daily,
    "export_view": q_export_view,
    "visible_viewer": q_visible_viewer,
    "display_view": q_display_view,
    "reconcile": q_reconcile,
    "row_fields": q_row_fields,
    "load_table_text": q_load_table_text,
    "table_counts": q_table_counts,
    "key_profile": q_key_profile,
    "duplicate_sample": q_duplicate_sample,
    "admin_stats": q_admin_stats,
    "count_where": q_count_where,
    "fan_out": q_fan_out,
    "next_id": q_next_id,
    "channel_totals_fba": q_channel_totals_fba,
    "channel_stock_keep_rows": q_channel_stock_keep_rows,
    "channel_stock_thousands": q_channel_stock_thousands,
    "column_totals": q_column_totals,
    "top_stock": q_top_stock,
    "keyset_page": q_keyset_page,
    "visible_custom": q_visible_custom,
    "legacy_status": q_legacy_status,
    "item_sort_text_legacy": q_item_sort_text_legacy,
    "audit_windows": q_audit_windows,
    "channel_stock_last": q_channel_stock_last,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)

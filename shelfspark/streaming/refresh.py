"""Structured Streaming jobs: the periodic dashboard refresh from landed
stock-sheet snapshots, the action-file import stream, and audit-log counts.

The refresh re-runs the batch operators for every micro-batch through
``foreachBatch``. Its state (the last stock per SKU, which keeps SKUs that a
newer snapshot omits) lives in a versioned table. A batch is worked out from a
snapshot of the tables and commits its own together under its name. If a table
that it read was changed meanwhile (a refresh and an import may run at once), the
commit is refused and the batch worked out anew; a retry of a batch that is
committed does nothing. Where the dashboard shows the current tables, only the
slices that hold changed SKUs are written (``operators/incremental.py``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators import dashboard as dash
from shelfspark.operators import incremental as inc
from shelfspark.operators.actions import PAYLOAD_INPUTS, apply_actions, classify_actions, summarise
from shelfspark.operators.commits import Snapshot, is_committed, redo, snapshot
from shelfspark.operators.numbered import MAX_SLICES, with_numbers, read_parts
from shelfspark.operators.stock import snapshot_stock
from shelfspark.operators.tables import assign_ids, publish_together, table_of, upsert
from shelfspark.schemas import ACTIONS, CATALOG_DEFAULTS, CATALOG_PRICING, ITEM_MASTER, SHEET_BANNER_ROWS, SHEET_COLUMNS, STOCK_COLUMNS, STOCK_DEFAULTS, STOCK_UPDATE, all_strings
from shelfspark.session import checkpoint_dir
from shelfspark.sources.entities import ACTION_LABELS
from shelfspark.sources.files import POSITION, by_file, lines_by_file, skip_leading_rows

STATE = "stock_update"
DASHBOARD = "stock_items"
ITEMS = "item_master"
CATALOG = "catalog_pricing"


def _trigger(writer, trigger: str):
    if trigger == "availableNow":
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer.trigger(processingTime=trigger)


def _checkpoint(base: str, checkpoint: str | None, name: str) -> str:
    """Below the tables' own root, so that it outlives the session."""
    return checkpoint or os.path.join(base, "_checkpoints", name)


def _stream_name(spark: SparkSession, name: str, checkpoint: str) -> str:
    """Name of a stream in the commits: the id that its checkpoint keeps over
    restarts, so a new checkpoint's first batch is not taken for a retry."""
    return f"{name}:{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or checkpoint}"


def refresh_batch(spark: SparkSession, batch: DataFrame, batch_name: str | None, base: str, items: DataFrame | None = None,
                  catalog: DataFrame | None = None, skip: int = SHEET_BANNER_ROWS) -> None:
    """Fold one micro-batch of sheet snapshot files into the stock state and
    publish it with a new dashboard, in one commit.

    Each file is one snapshot; snapshots are ordered by (modification time,
    path). Totals are taken per (snapshot, SKU) first and the newest snapshot
    wins per SKU, so two files in one batch are never added together. Items
    and catalogue are the tables' current versions unless given.
    """
    rows = skip_leading_rows(batch, skip)
    rows = rows.withColumn("_snap", F.struct(F.col("_mtime"), F.col("_file")))
    newest = _written(snapshot_stock(rows, "_snap"))
    redo(lambda: _refresh(spark, newest, batch_name, base, items, catalog))


def _written(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared checkpoint folder (a change set is read several times)."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"changes-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shown(state: Snapshot) -> dict[str, list[str]]:
    """The tables that a dashboard of a snapshot shows."""
    return {t: state.paths(t) for t in (STATE, ITEMS, CATALOG)}


def _refresh(spark: SparkSession, newest: DataFrame, batch_name: str | None, base: str, items: DataFrame | None,
             catalog: DataFrame | None) -> None:
    state = snapshot(spark, base)
    if is_committed(state, batch_name):
        return
    own = items is None and catalog is None
    old = table_of(spark, state, STATE, STOCK_UPDATE)
    reads = [STATE, DASHBOARD] + ([ITEMS] if items is None else []) + ([CATALOG] if catalog is None else [])
    shown = {DASHBOARD: _shown(state)} if own else {}
    if own and state.paths(STATE) and inc.in_slices(state, DASHBOARD) and state.made_from.get(DASHBOARD) == _shown(state):
        changes = _written(inc.changed_stock(old, newest))
        frames = {}
        if not changes.isEmpty():
            merged = upsert(old, changes, "master_sku", STOCK_COLUMNS, unique_inputs=True)
            frames = {STATE: (merged, {"schema": STOCK_UPDATE, "unique_key": "master_sku", "defaults": STOCK_DEFAULTS}),
                      DASHBOARD: inc.update_stock(spark, base, state, DASHBOARD, changes)}
    else:
        # the state and the batch's newest snapshot hold one row per SKU each
        merged = _written(upsert(old, newest, "master_sku", STOCK_COLUMNS, unique_inputs=True))
        its = items if items is not None else table_of(spark, state, ITEMS, ITEM_MASTER)
        cat = catalog if catalog is not None else table_of(spark, state, CATALOG, CATALOG_PRICING)
        if items is not None or not inc.in_slices(state, ITEMS):
            its = assign_ids(its, ["row_no"], id_col="_n").drop("row_no").withColumnRenamed("_n", "row_no")
        board = inc.whole_board(base, DASHBOARD, dash.build_dashboard(its, merged, cat), _slice_rows(state, its))
        frames = {STATE: (merged, {"schema": STOCK_UPDATE, "unique_key": "master_sku", "defaults": STOCK_DEFAULTS}), DASHBOARD: board}
    publish_together(spark, base, frames, batch_name, state, reads, shown if frames else {})


def _slice_rows(state: Snapshot, items: DataFrame) -> int:
    """Rows of a dashboard slice: those of the items' slices, if they are in slices."""
    paths = state.paths(ITEMS)
    return max(state.parts[p]["rows"] for p in paths) if inc.in_slices(state, ITEMS) else inc.slice_size(items.count())


def report_error(spark: SparkSession, base: str, batch_id: int, exc: Exception) -> None:
    """Append one error record (batch id, message, time) to ``base/refresh_errors``."""
    msg = str(exc).strip() or type(exc).__name__
    row = spark.createDataFrame([(int(batch_id), type(exc).__name__, msg)], "batch_id long, error string, message string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").json(os.path.join(base, "refresh_errors"))


def stream_refresh(spark: SparkSession, sheet_dir: str, base: str, items: DataFrame | None = None,
                   catalog: DataFrame | None = None, checkpoint: str | None = None,
                   trigger: str = "15 minutes", skip: int = SHEET_BANNER_ROWS,
                   on_error: str = "raise") -> StreamingQuery:
    """Keep the dashboard current from stock-sheet snapshot files landing in
    ``sheet_dir`` (headerless CSV, banner rows on top). Every batch reads the
    current item master and catalogue below ``base`` (so an import shows in the
    next refresh) unless fixed ones are given. ``trigger`` is a
    processing-time interval (the reference polls every 900 s),
    ``"availableNow"`` or ``"once"``.

    ``on_error="raise"`` stops the query on a failed batch; a restart retries
    it from the checkpoint (nothing is lost). ``"report"`` records the failure
    in ``base/refresh_errors`` and goes on with the next batch, as a periodic
    refresh does: the failed snapshot is skipped and the next full snapshot
    supersedes it."""
    if on_error not in ("raise", "report"):
        raise ValueError("on_error must be 'raise' or 'report'")
    src = (spark.readStream.schema(all_strings(SHEET_COLUMNS)).option("header", False)
           .option("mode", "PERMISSIVE").csv(sheet_dir)
           .select("*", F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.col("_metadata.file_modification_time").alias("_mtime")))

    where = _checkpoint(base, checkpoint, "refresh")

    def run(batch: DataFrame, batch_id: int) -> None:
        positioned = batch.withColumn("_mid", F.monotonically_increasing_id())
        try:
            refresh_batch(spark, positioned, f"{_stream_name(spark, 'refresh', where)}#{batch_id}", base, items, catalog, skip)
        except Exception as exc:
            if on_error == "raise":
                raise
            report_error(spark, base, batch_id, exc)

    writer = src.writeStream.foreachBatch(run).option("checkpointLocation", where)
    return _trigger(writer, trigger).start()


def labelled_actions(cells: DataFrame) -> DataFrame:
    """Rows of action files under the engine's names, by each file's own header
    line (its first line), whatever the order of its columns. ``cells`` has
    c0, c1, ... (bytes, as Latin-1) and the position columns; rows are ordered
    by arrival (file time, path, place). A file without the Action column, or
    without data rows, raises."""
    names = [c for c in cells.columns if c[0] == "c" and c[1:].isdigit()]
    text = by_file(cells, {c: (F.encode(c, "ISO-8859-1").cast("string"), F.col(c)) for c in names})
    return _labelled(text.select(F.array(*names).alias("_cells"), "_file", "_mtime", "_block", "_mid"))


def labelled_lines(lines: DataFrame) -> DataFrame:
    """``labelled_actions`` of text lines (``value``): as many cells are read as
    the longest header of the files has. Blank lines are dropped."""
    text = lines_by_file(lines).where(F.trim("value") != "")
    heads = text.where("_block = 0").groupBy("_file").agg(F.min_by("value", "_mid").alias("_h"))
    width = heads.agg(F.max(F.size(F.split("_h", ",")))).first()[0] or 1
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)))
    return _labelled(text.select(F.array(*[cells[f"c{i}"] for i in range(width)]).alias("_cells"), "_file", "_mtime", "_block", "_mid"))


def _labelled(rows: DataFrame) -> DataFrame:
    first = rows.where("_block = 0").groupBy("_file").agg(F.min_by("_cells", "_mid").alias("_h"))
    labels = F.transform("_h", lambda c: F.trim(F.regexp_replace(c, "^\ufeff", "")))
    first = first.select(F.col("_file").alias("_f"), labels.alias("_labels"))
    bad = first.where(~F.coalesce(F.array_contains("_labels", "Action"), F.lit(False))).select("_f").limit(1).collect()
    if bad:
        raise ValueError(f"the action file has no Action column: {bad[0][0]}")
    body = skip_leading_rows(rows, 1)
    empty = first.join(body.select("_file").distinct(), F.col("_f") == F.col("_file"), "left_anti").select("_f").limit(1).collect()
    if empty:
        raise ValueError(f"the action file has no rows: {empty[0][0]}")
    headers = [r[0] for r in first.select("_labels").distinct().limit(2).collect()]
    if len(headers) == 1:  # no row needs to meet its file's header
        body = body.withColumn("_labels", F.array(*[F.lit(x) for x in headers[0]]))
    else:
        body = body.join(first, F.col("_file") == F.col("_f"))
    cell = {name: F.get("_cells", F.array_position("_labels", label).cast("int") - 1) for label, name in ACTION_LABELS.items()}
    return body.select(*[c.alias(name) for name, c in cell.items()], "_file", "_mtime", "_block", "_mid")


def actions_batch(spark: SparkSession, batch: DataFrame, batch_name: str | None, base: str,
                  price_map: str = "parity", refresh_dashboard: bool = True) -> DataFrame:
    """Apply one micro-batch of action files to the item and catalogue tables
    (files in order of arrival, rows in file order) and return the summary.
    With ``refresh_dashboard`` the dashboard is rebuilt from the new tables and
    the current stock state; all tables switch with one commit.

    A batch that is committed already is not applied again; its summary is
    that of its rows. Where items and dashboard are in slices of the same rows
    (from the first import on), only those that hold a key of the file are
    written, and added rows come as slices at the end."""
    used = ["_mtime", *POSITION, "master_sku", "action", *PAYLOAD_INPUTS]
    numbered = assign_ids(batch.select(*[c for c in batch.columns if c in used]), ["_mtime", *POSITION], id_col="row_no")
    return redo(lambda: _import(spark, numbered, batch_name, base, price_map, refresh_dashboard))


def _import(spark: SparkSession, numbered: DataFrame, batch_name: str | None, base: str, price_map: str, refresh_dashboard: bool) -> DataFrame:
    state = snapshot(spark, base)
    if is_committed(state, batch_name):
        return summarise(classify_actions(numbered))
    cat = table_of(spark, state, CATALOG, CATALOG_PRICING)
    stock = table_of(spark, state, STATE, STOCK_UPDATE)
    reads = [ITEMS, CATALOG] + ([STATE, DASHBOARD] if refresh_dashboard else [])
    in_place = inc.in_slices(state, ITEMS) and len(state.paths(ITEMS)) < MAX_SLICES * 3 // 4
    if in_place and refresh_dashboard:
        in_place = inc.aligned(state, ITEMS, DASHBOARD) and state.made_from.get(DASHBOARD) == _shown(state)
    if in_place:
        keys = classify_actions(numbered).where(F.col("status").isin(*ACTIONS)).select(F.col("k").alias("_key")).distinct()
        new_items, old, _ = inc.changed_items(spark, base, state, ITEMS, keys,
                                              lambda rows: apply_actions(rows, cat, numbered, price_map=price_map).items)
    else:
        # items keep file order: existing rows first, then added rows in action order
        res = apply_actions(table_of(spark, state, ITEMS, ITEM_MASTER), cat, numbered, price_map=price_map)
        new_items = inc.whole_items(spark, base, ITEMS, res.items, ["src", "src_row"])
    res = apply_actions(spark.createDataFrame([], ITEM_MASTER), cat, numbered, price_map=price_map)
    catalog = _written(res.catalog)
    frames = {ITEMS: new_items, CATALOG: (catalog, {"schema": CATALOG_PRICING, "unique_key": "master_sku", "defaults": CATALOG_DEFAULTS})}
    if refresh_dashboard:
        def build(items: DataFrame) -> DataFrame:
            return dash.build_dashboard(items, stock, catalog)

        if in_place:
            frames[DASHBOARD] = inc.changed_board(spark, base, state, DASHBOARD, ITEMS, new_items, old, build)
        else:
            stored = ITEM_MASTER.fields[1:]
            items = with_numbers(read_parts(spark, new_items.paths, type(ITEM_MASTER)(stored)), new_items.paths, new_items.parts, "row_no") \
                if new_items.paths else spark.createDataFrame([], ITEM_MASTER)
            size = max((x["rows"] for x in new_items.parts.values()), default=1)
            frames[DASHBOARD] = inc.whole_board(base, DASHBOARD, build(items), size)
    publish_together(spark, base, frames, batch_name, state, reads, {DASHBOARD: _shown(state)} if refresh_dashboard else {})
    return res.summary


def stream_actions(spark: SparkSession, action_dir: str, base: str, checkpoint: str | None = None,
                   trigger: str = "availableNow", price_map: str = "parity") -> StreamingQuery:
    """Apply action files (the labelled export plus an Action column) as they land."""
    # lines are read as they are: each file's header tells its cells, each file's bytes its encoding
    src = (spark.readStream.text(action_dir)
           .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.col("_metadata.file_modification_time").alias("_mtime")))
    where = _checkpoint(base, checkpoint, "actions")

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = labelled_lines(batch.withColumn("_mid", F.monotonically_increasing_id()))
        actions_batch(spark, rows, f"{_stream_name(spark, 'actions', where)}#{batch_id}", base, price_map)

    return _trigger(src.writeStream.foreachBatch(run).option("checkpointLocation", where), trigger).start()


def start_streams(spark: SparkSession, sheet_dir: str, action_dir: str, base: str,
                  trigger: str = "15 minutes") -> tuple[StreamingQuery, StreamingQuery]:
    """The whole periodic job: sheet snapshots and action files over one set of tables."""
    return (stream_refresh(spark, sheet_dir, base, trigger=trigger), stream_actions(spark, action_dir, base, trigger=trigger))


def stream_audit_counts(logs: DataFrame, watermark: str = "1 day", window: str = "1 day",
                        ts_col: str = "timestamp") -> DataFrame:
    """Entries per action per event-time window of a growing audit log;
    entries later than the watermark are dropped from closed windows."""
    return (logs.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("window"), "action")
            .agg(F.count(F.lit(1)).alias("n")))


def refresh_once(spark: SparkSession, sheet_path: str, base: str, items: DataFrame | None = None,
                 catalog: DataFrame | None = None, skip: int = SHEET_BANNER_ROWS) -> None:
    """One batch refresh from landed sheet file(s), without a stream: the same
    fold and publish as a micro-batch, on top of the last committed state."""
    batch = (spark.read.schema(all_strings(SHEET_COLUMNS)).option("header", False).option("mode", "PERMISSIVE")
             .csv(sheet_path)
             .select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.col("_metadata.file_modification_time").alias("_mtime"),
                     F.monotonically_increasing_id().alias("_mid")))
    refresh_batch(spark, batch, None, base, items, catalog, skip)

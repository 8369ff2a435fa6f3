"""Action-file import and legacy item import, as set-based table updates.

An action file is applied in row order by the reference, one statement at a
time. Here the same final state is computed without a row loop: the valid
action rows are folded per canonical key with one grouped aggregate, and the
fold is joined onto the item and catalogue tables.

Fold per key (row numbers are 1-based positions in the file):
  D = last delete row (0 if none); R = last replace row and its item payload;
  U = last add-or-replace row and its catalogue payload.
Item rows that survive: existing rows when D = 0, plus every add after D.
A survivor takes R's payload when R is later than the row itself (existing
rows count as row 0), else keeps its own values.
Catalogue row: when U > D it carries U's payload (mrp kept from the old row
when D = 0, else 0.0); when only a delete is last there is no row; keys with
no valid action keep their old row.
Counts come from the valid action rows themselves, not from matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import sql_ident, batch_stamp, lenient_float, row_message, safe_int, strip, strip_sql
from shelfspark.operators import skew
from shelfspark.schemas import ACTIONS, LEGACY_STATUS, MAX_ERROR_DETAILS

ITEM_PAYLOAD = ["style", "size", "category", "loc"]
PAYLOAD_INPUTS = ["item_name", "size", "category", "location", "cost", "price", "catalog", "mrp", "updated"]
CATALOG_PAYLOAD = ["launch_date", "catalog_name", "cost", "wholesale_price", "up_price", "mrp"]


@dataclass
class ActionResult:
    items: DataFrame
    catalog: DataFrame
    summary: DataFrame
    errors: DataFrame


def _text(c: str) -> F.Column:
    """Stripped text of a column, '' when null (one SQL expression)."""
    return F.expr(f"coalesce({strip_sql(sql_ident(c))}, '')")


def classify_actions(actions: DataFrame, row_col: str = "row_no", legacy_null_text: bool = False) -> DataFrame:
    """Rows with a non-blank action, classified: add / replace / delete, or an
    error status (missing_sku, unknown). ``legacy_null_text=True`` reads a
    missing (null) action as the text 'None' - an unknown action - as the
    original importer does for a row shorter than its header."""
    # a payload column absent from the file reads as '' (as a missing label does)
    missing = [c for c in PAYLOAD_INPUTS if c not in actions.columns]
    if missing:
        actions = actions.withColumns({c: F.lit(None).cast("string") for c in missing})
    if legacy_null_text:
        act = F.lower(F.expr(strip_sql("coalesce(`action`, 'None')")))
    else:
        act = F.lower(_text("action"))
    sku = _text("master_sku")
    c = actions.select(F.col(row_col).alias("row_no"), act.alias("act"), sku.alias("sku"),
                       *[F.col(x) for x in actions.columns if x not in (row_col, "action", "master_sku")])
    c = c.filter(F.col("act") != "")
    status = (F.when(F.col("sku") == "", F.lit("missing_sku"))
              .when(F.col("act").isin(*ACTIONS), F.col("act")).otherwise(F.lit("unknown")))
    return c.withColumn("status", status).withColumn("k", F.upper(F.col("sku")))


ITEM_INPUTS, CATALOG_INPUTS = ["item_name", "size", "category", "location"], ["updated", "catalog", "cost", "price", "mrp"]


def _payloads(valid: DataFrame) -> DataFrame:
    """The cells as they are; they are parsed after the fold, once per key."""
    return valid.select("row_no", "k", "sku", "status", F.struct(*ITEM_INPUTS).alias("ip"), F.struct(*CATALOG_INPUTS).alias("cp"))


def _item_values() -> F.Column:
    item = {
        "style": _text("item_name"), "size": _text("size"), "category": _text("category"), "loc": _text("location"),
    }
    return F.struct(*[v.alias(n) for n, v in item.items()])


def _catalog_values(price_map: str) -> dict[str, F.Column]:
    cat = {
        "launch_date": _text("updated"), "catalog_name": _text("catalog"),
        "cost": lenient_float("cost"), "wholesale_price": lenient_float("price"),
    }
    if price_map == "parity":
        cat["up_price"] = lenient_float("mrp")  # the MRP label lands in up_price
    elif price_map == "fixed":
        cat["mrp"] = lenient_float("mrp")
    else:
        raise ValueError("price_map must be 'parity' or 'fixed'")
    return cat


def fold_actions(valid: DataFrame) -> DataFrame:
    """One row per key: D, R + item payload, U + catalogue payload."""
    is_del = F.col("status") == "delete"
    is_rep = F.col("status") == "replace"
    is_up = F.col("status").isin("add", "replace")
    return valid.groupBy("k").agg(
        F.coalesce(F.max(F.when(is_del, F.col("row_no"))), F.lit(0)).alias("D"),
        F.max(F.when(is_rep, F.col("row_no"))).alias("R"),
        F.max_by(F.col("ip"), F.when(is_rep, F.col("row_no"))).alias("R_ip"),
        F.max(F.when(is_up, F.col("row_no"))).alias("U"),
        F.max_by(F.col("cp"), F.when(is_up, F.col("row_no"))).alias("U_cp"),
    )


def apply_actions(items: DataFrame, catalog: DataFrame, actions: DataFrame, row_col: str = "row_no",
                  price_map: str = "parity", legacy_null_text: bool = False) -> ActionResult:
    """Apply an action file to the item master and the catalogue table.

    ``items``: row_no, master_sku, style, size, category, loc.
    ``catalog``: master_sku (canonical), launch_date, catalog_name, cost,
    wholesale_price, up_price, mrp.
    ``actions``: ``row_col`` (1-based file row), master_sku, item_name, size,
    category, location, cost, price, catalog, mrp, updated, action.
    The new item table carries ``src`` (0 existing, 1 added) and ``src_row``
    (row in its source) as its order.
    """
    classified = classify_actions(actions, row_col, legacy_null_text)
    written = _catalog_values(price_map)
    valid = _payloads(classified.filter(F.col("status").isin(*ACTIONS)))
    fold = fold_actions(valid).select("k", "D", "R", "U", "R_ip.*", "U_cp.*").select(
        "k", "D", "R", F.when(F.col("R").isNotNull(), _item_values()).alias("R_ip"),
        "U", F.when(F.col("U").isNotNull(), F.struct(*[v.alias(n) for n, v in written.items()])).alias("U_cp"))

    # -- items ---------------------------------------------------------------
    old = items.select(F.col("row_no").alias("src_row"), F.col("master_sku"),
                       *[F.col(c).cast("string").alias(c) for c in ITEM_PAYLOAD],
                       F.upper(strip("master_sku")).alias("k"))
    old_f = skew.left_join(old, fold.select("k", "D", "R", "R_ip"), "k")
    kept = old_f.filter(F.coalesce(F.col("D"), F.lit(0)) == 0).select(
        F.lit(0).alias("src"), "src_row", "master_sku",
        *[F.when(F.col("R").isNotNull(), F.col("R_ip")[c]).otherwise(F.col(c)).alias(c) for c in ITEM_PAYLOAD])
    adds = valid.filter(F.col("status") == "add").select("row_no", "k", "sku", "ip.*") \
        .select("row_no", "k", "sku", _item_values().alias("ip"))
    adds_f = skew.left_join(adds, fold.select("k", "D", "R", "R_ip"), "k", how="inner").filter(F.col("row_no") > F.col("D"))
    added = adds_f.select(
        F.lit(1).alias("src"), F.col("row_no").cast("bigint").alias("src_row"), F.col("sku").alias("master_sku"),
        *[F.when(F.coalesce(F.col("R"), F.lit(0)) > F.col("row_no"), F.col("R_ip")[c]).otherwise(F.col("ip")[c]).alias(c)
          for c in ITEM_PAYLOAD])
    new_items = kept.select("src", F.col("src_row").cast("bigint").alias("src_row"), "master_sku", *ITEM_PAYLOAD) \
        .unionByName(added)

    # -- catalogue -------------------------------------------------------------
    cat_old = catalog.select(F.col("master_sku").alias("k"), F.struct(*CATALOG_PAYLOAD).alias("old"))
    cf = cat_old.join(fold.select("k", "D", "U", "U_cp"), "k", "full")
    has_update = F.col("U").isNotNull() & (F.col("U") > F.coalesce(F.col("D"), F.lit(0)))
    deleted = F.coalesce(F.col("D"), F.lit(0)) > 0
    kept_from_old = F.col("old").isNotNull() & (F.coalesce(F.col("D"), F.lit(0)) == 0)
    out_cols = []
    for c in CATALOG_PAYLOAD:
        if c in ("mrp", "up_price") and c not in written:
            # not written by the action: kept while the row lives, else the default
            upd = F.when(kept_from_old, F.col("old")[c]).otherwise(F.lit(0.0))
        else:
            upd = F.col("U_cp")[c]
        out_cols.append(F.when(has_update, upd).otherwise(F.col("old")[c]).alias(c))
    new_catalog = cf.filter(has_update | (~deleted & F.col("old").isNotNull())).select(
        F.col("k").alias("master_sku"), *out_cols)

    # -- summary and errors ----------------------------------------------------------
    summary, st = summarise(classified), F.col("status")
    reason = (F.when(st == "missing_sku", F.lit("missing Master SKU, skipped."))
              .otherwise(F.format_string("unknown action '%s'.", F.col("act"))))
    errors = (classified.filter(~st.isin(*ACTIONS))
              .select(F.col("row_no").cast("bigint").alias("row_no"), "sku", st.alias("status"),
                      row_message(F.col("row_no"), F.col("sku"), reason).alias("message")))
    return ActionResult(new_items, new_catalog, summary, errors)


def summarise(classified: DataFrame) -> DataFrame:
    """Counts of the classified rows: no row numbers are needed."""
    st = F.col("status")
    return classified.agg(
        F.count_if(st.isin(*ACTIONS)).cast("bigint").alias("total"),
        F.count_if(st == "add").cast("bigint").alias("added"),
        F.count_if(st == "replace").cast("bigint").alias("replaced"),
        F.count_if(st == "delete").cast("bigint").alias("deleted"),
        F.count_if(~st.isin(*ACTIONS)).cast("bigint").alias("errors"),
    )


def error_details(errors: DataFrame, limit: int = MAX_ERROR_DETAILS) -> DataFrame:
    """The first ``limit`` errors in row order, as the import page lists them
    (``ActionResult.errors`` holds all of them)."""
    return errors.orderBy("row_no").limit(limit)


# ---------------------------------------------------------------------------
# Legacy positional import (new / updated / skipped)
# ---------------------------------------------------------------------------

LEGACY_TEXT = {"item_name": "style", "size": "size", "category": "category", "location": "location",
               "catalog": "catalog", "updated": "launch_date"}
LEGACY_INT = {"cost": "cost", "price": "wholesale_price", "mrp": "up_price", "available_atp": "uniware_stock",
              "fba_stock": "fba", "fbf_stock": "fbf", "sjit_stock": "sjit"}
LEGACY_COLUMNS = ["status", *LEGACY_TEXT, *LEGACY_INT, "import_batch"]


def selection_to_legacy(rows: DataFrame, batch_ts, row_col: str = "row_no") -> DataFrame:
    """Positional selection rows (master_sku, style, size, category, location,
    cost, wholesale_price, catalog, up_price, uniware_stock, fba, fbf, sjit,
    launch_date; ``n_fields`` = cells in the row) to legacy item rows with a
    ``valid`` flag (at least 2 cells and a non-blank SKU)."""
    n_fields = F.col("n_fields") if "n_fields" in rows.columns else F.lit(len(rows.columns))
    sku = _text("master_sku")
    text = {k: _text(v) if v in rows.columns else F.lit("") for k, v in LEGACY_TEXT.items()}
    ints = {k: safe_int(v) if v in rows.columns else F.lit(0).cast("bigint") for k, v in LEGACY_INT.items()}
    return rows.select(
        F.col(row_col).alias("row_no"), sku.alias("sku_code"),
        ((n_fields >= 2) & (sku != "")).alias("valid"),
        F.lit(LEGACY_STATUS).alias("status"),
        *[v.alias(k) for k, v in text.items()], *[v.alias(k) for k, v in ints.items()],
        batch_stamp(batch_ts).alias("import_batch"))


def import_items(target: DataFrame, rows: DataFrame, batch_ts, row_col: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """Import positional rows into the legacy item table, keyed by the stripped
    SKU (exact match). Returns (new table, one-row summary new/updated/skipped).

    Per key with m valid rows: 1 new + (m - 1) updated when the key is not in
    the target, else m updated; the last row in file order gives the values,
    and an updated key gets ``updated_at`` = the batch time.
    """
    parsed = selection_to_legacy(rows, batch_ts, row_col)
    # target rows (side 0) and valid file rows (side 1) in one grouped
    # aggregate: existence, rows per key and the last row's values together,
    # one exchange on the key
    old_stamp = F.col("updated_at").cast("string") if "updated_at" in target.columns else F.lit(None).cast("string")
    t = target.select("sku_code", *LEGACY_COLUMNS, F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("row_no"),
                      old_stamp.alias("updated_at"))
    u = parsed.filter("valid").select("sku_code", *LEGACY_COLUMNS, F.lit(1).alias("_side"), F.col("row_no").cast("bigint"),
                                      F.lit(None).cast("string").alias("updated_at"))
    grouped = t.unionByName(u).groupBy("sku_code").agg(
        F.max(F.col("_side") == 0).alias("_exists"),
        F.count_if(F.col("_side") == 1).alias("m"),
        F.max(F.when(F.col("_side") == 0, F.col("updated_at"))).alias("_old_stamp"),
        F.max_by(F.struct(*LEGACY_COLUMNS), F.struct("_side", "row_no")).alias("_v"))
    # a row is updated (and stamped) when its key existed, or when the file
    # repeats a new key (the first row inserts, the later ones update)
    was_updated = (F.col("_exists") & (F.col("m") > 0)) | (F.col("m") > 1)
    stamp = F.date_format(F.lit(batch_ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    table = grouped.select("sku_code", *[F.col("_v")[c].alias(c) for c in LEGACY_COLUMNS],
                           F.when(was_updated, stamp).otherwise(F.col("_old_stamp")).alias("updated_at"))
    is_new = ~F.col("_exists")
    outcomes = grouped.filter(F.col("m") > 0).select(
        F.when(is_new, 1).otherwise(0).alias("n"),
        F.when(is_new, F.col("m") - 1).otherwise(F.col("m")).alias("u"), F.lit(0).alias("s"))
    skips = parsed.filter(~F.col("valid")).select(F.lit(0).alias("n"), F.lit(0).alias("u"), F.lit(1).alias("s"))
    summary = outcomes.unionByName(skips).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(a)
          for c, a in (("n", "new_rows"), ("u", "updated_rows"), ("s", "skipped"))])
    return table, summary

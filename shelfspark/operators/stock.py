"""Stock sheet operators: cleaning, per-channel totals, the channel merge,
snapshot folding and the stock overlay onto an item file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import lenient_int, strip
from shelfspark.operators import skew
from shelfspark.operators.tables import packed_order
from shelfspark.schemas import JUNK_SKUS, OVERLAY_JUNK, STOCK_COLUMNS

# (channel, sku column, quantity column, published stock column)
CHANNELS = [
    ("uni", "uni", "uni_stock", "uniware_stock"),
    ("fba", "fba", "fba_stock", "fba_stock"),
    ("fbf", "fbf", "fbf_stock", "fbf_stock"),
    ("sjit", "sjit", "sjit_stock", "sjit_stock"),
]


def clean_stock(sheet: DataFrame, drop_when_first_null: bool = True, thousands: bool = False,
                upper: bool = True) -> DataFrame:
    """Clean the wide sheet row by row: SKUs stripped (and upper-cased),
    quantities parsed leniently (bad or missing = 0).

    ``drop_when_first_null`` drops the whole row when the first channel's SKU
    is null, losing the other channels' pairs on that row (parity).
    """
    df = sheet.filter(F.col("uni").isNotNull()) if drop_when_first_null else sheet
    out = {}
    for _, sku, qty, _ in CHANNELS:
        key = strip(sku)
        out[sku] = F.upper(key) if upper else key
        out[qty] = lenient_int(qty, thousands=thousands)
    return df.withColumns(out)


def _junk_filter(sku: F.Column, junk: list[str]) -> F.Column:
    return sku.isNotNull() & (sku != "") & ~F.lower(sku).isin(*junk)


def _long_form(cleaned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (sheet row, channel): channel, sku, qty (+ kept columns)."""
    pairs = F.array(*[F.struct(F.lit(ch).alias("channel"), F.col(sku).alias("sku"), F.col(qty).alias("qty"))
                      for ch, sku, qty, _ in CHANNELS])
    return cleaned.select(*keep, F.inline(pairs))


def channel_totals(sheet: DataFrame, sku_col: str, qty_col: str, junk: list[str] = JUNK_SKUS) -> DataFrame:
    """Sum of one channel's quantity per SKU after the junk filter."""
    return (sheet.select(F.col(sku_col).alias("master_sku"), F.col(qty_col))
            .filter(_junk_filter(F.col("master_sku"), junk))
            .groupBy("master_sku").agg(F.sum(qty_col).alias(qty_col)))


def channel_stock(sheet: DataFrame, junk: list[str] = JUNK_SKUS, by: list[str] | None = None,
                  method: str = "one_pass", duplicates: str = "sum", order: list[str] | None = None,
                  **clean_opts) -> DataFrame:
    """One row per SKU with the four channel totals (missing channel = 0).

    ``method="one_pass"`` (default) unpivots each sheet row into its four
    (channel, sku, qty) pairs, filters junk keys before the shuffle and sums
    all four channels in a single grouped aggregation: one hash exchange.
    ``method="join"`` is the literal form: four grouped tables combined with
    full outer joins on the SKU (kept for cross-checking).
    ``by`` adds grouping columns (e.g. a snapshot id) in front of the SKU.
    ``duplicates="last"`` keeps, per SKU and channel, the quantity of the
    last row in ``order`` instead of the sum (still one grouped aggregate).
    """
    by = list(by or [])
    if duplicates not in ("sum", "last"):
        raise ValueError("duplicates must be 'sum' or 'last'")
    if duplicates == "last" and not order:
        raise ValueError("duplicates='last' needs the row order columns")
    cleaned = clean_stock(sheet, **clean_opts)
    if duplicates == "last":
        long = _long_form(cleaned.withColumn("_ord", packed_order(sheet, order, wide=True)), [*by, "_ord"]).filter(_junk_filter(F.col("sku"), junk))
        lasts = [F.coalesce(F.max_by(F.col("qty"), F.when(F.col("channel") == ch, F.col("_ord"))), F.lit(0))
                 .cast("bigint").alias(out) for ch, _, _, out in CHANNELS]
        return long.groupBy(*by, F.col("sku").alias("master_sku")).agg(*lasts)
    if method == "join":
        merged = None
        for _, sku, qty, out in CHANNELS:
            t = (cleaned.select(*by, F.col(sku).alias("master_sku"), F.col(qty).alias(out))
                 .filter(_junk_filter(F.col("master_sku"), junk))
                 .groupBy(*by, "master_sku").agg(F.sum(out).alias(out)))
            merged = t if merged is None else merged.join(t, on=[*by, "master_sku"], how="full")
        return merged.select(*by, "master_sku", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                                 for c in STOCK_COLUMNS])
    if method != "one_pass":
        raise ValueError(f"unknown method {method!r}")
    return merge_channels(cleaned, junk, by)


def merge_channels(cleaned: DataFrame, junk: list[str] = JUNK_SKUS, by: list[str] = ()) -> DataFrame:
    """``channel_stock`` of a sheet that is cleaned already, in one pass."""
    by = list(by)
    long = _long_form(cleaned, by).filter(_junk_filter(F.col("sku"), junk))
    sums = [F.coalesce(F.sum(F.when(F.col("channel") == ch, F.col("qty"))), F.lit(0)).cast("bigint").alias(out)
            for ch, _, _, out in CHANNELS]
    return long.groupBy(*by, F.col("sku").alias("master_sku")).agg(*sums)


def latest_snapshot(rows: DataFrame, key: str, snapshot: str, cols: list[str]) -> DataFrame:
    """Per key, the values from the newest snapshot that contains the key.
    Keys absent from newer snapshots keep their last values (stale keys persist).

    ``rows`` holds one row per (key, snapshot). With a numeric snapshot id
    and numeric values each column takes its own ``max_by`` - fixed-width
    buffers, so a hash aggregate; otherwise one ``max_by`` over a struct."""
    types = dict(rows.dtypes)
    numeric = ("bigint", "int", "smallint", "tinyint", "double", "float", "date", "timestamp", "timestamp_ntz")
    if types[snapshot] in numeric and all(types[c] in numeric for c in cols):
        return rows.groupBy(key).agg(*[F.max_by(F.col(c), F.col(snapshot)).alias(c) for c in cols])
    agg = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(snapshot)).alias("_v"))
    return agg.select(key, *[F.col("_v")[c].alias(c) for c in cols])


def snapshot_stock(sheet: DataFrame, snapshot: str, junk: list[str] = JUNK_SKUS, **clean_opts) -> DataFrame:
    """Channel totals per (snapshot, SKU), then the newest snapshot per SKU.
    Two snapshot files in one batch are never added together."""
    per_snapshot = channel_stock(sheet, junk=junk, by=[snapshot], **clean_opts)
    return latest_snapshot(per_snapshot, "master_sku", snapshot, STOCK_COLUMNS)


def _overlay_long(sheet: DataFrame, order: F.Column) -> DataFrame:
    """_ord, channel, sku and qty of every channel of a sheet row, as the
    overlay script reads it: quotes and commas dropped from the quantity,
    blank = 0, unparsable = null; blank SKUs and junk literals are left out.
    The rows are unpivoted as they are and cleaned after that, so that each
    rule stands once in the plan."""
    pairs = F.array(*[F.struct(F.lit(ch).alias("channel"), F.col(sku).alias("_sku"), F.col(qty).alias("_qty")) for ch, sku, qty, _ in CHANNELS])
    raw = sheet.select(order.alias("_ord"), F.inline(pairs)).where(F.col("_sku").isNotNull())
    stripped = raw.select("_ord", "channel", strip("_sku").alias("_sku"), F.translate("_qty", '",', "").alias("_qty"))
    plain = F.when(F.col("channel") == "uni", F.col("_sku")).otherwise(F.translate("_sku", '"', ""))
    read = stripped.select("_ord", "channel", plain.alias("sku"), F.coalesce(strip("_qty"), F.lit("")).alias("_qty"))
    junk = [(F.col("channel") == ch) & F.col("sku").isin(*names) for ch, names in OVERLAY_JUNK.items() if names]
    kept = read.where((F.col("sku") != "") & ~reduce(lambda a, b: a | b, junk, F.lit(False)))
    qty = F.when(F.col("_qty") == "", F.lit(0).cast("bigint")).otherwise(F.col("_qty").try_cast("bigint"))
    return kept.select("_ord", "channel", "sku", qty.alias("qty"))


def overlay_values(sheet: DataFrame, order: list[str]) -> DataFrame:
    """Per SKU seen in any channel: the four stock values the overlay writes.

    Each channel keeps its own last value in sheet order - for the first
    channel the last row's value (0 when unparsable), for the others the last
    parsable one; a channel never seen (or never parsable) gives 0. One scan,
    one exchange: the sheet rows are unpivoted into their four pairs and a
    single grouped aggregate takes four conditional ``max_by``.
    One integral order column (e.g. ``row_no`` from the file readers), or
    several that fit into one long (``tables.packed_order``), make the buffers
    fixed-width, so it is a hash aggregate; any other order is a struct, which
    Spark aggregates by sorting (still with a partial, map-side step).
    """
    long = _overlay_long(sheet, packed_order(sheet, order, wide=True))
    outs = []
    for ch, _, _, out in CHANNELS:
        is_ch = F.col("channel") == ch
        if ch == "uni":
            v = F.max_by(F.coalesce(F.col("qty"), F.lit(0).cast("bigint")), F.when(is_ch, F.col("_ord")))
        else:
            v = F.max_by(F.col("qty"), F.when(is_ch & F.col("qty").isNotNull(), F.col("_ord")))
        outs.append(F.coalesce(v, F.lit(0)).cast("bigint").alias(out))
    return long.groupBy(F.col("sku").alias("master_sku")).agg(*outs)


def overlay_stock(items: DataFrame, sheet: DataFrame, order: list[str], sku_col: str = "master_sku",
                  stock_cols: list[str] = ("available_atp", "fba_stock", "fbf_stock", "sjit_stock")) -> DataFrame:
    """Items whose stripped SKU appears in the sheet get all four stock values
    from it (written as text, like the CSV cells they replace); other items
    keep theirs."""
    vals = overlay_values(sheet, order)
    stock_cols = list(stock_cols)
    renamed = vals.select(F.col("master_sku").alias("_key"),
                          *[F.col(src).alias(f"_new_{dst}") for src, dst in zip(STOCK_COLUMNS, stock_cols)],
                          F.lit(True).alias("_hit"))
    joined = skew.left_join(items.withColumn("_key", strip(F.col(sku_col))), renamed, "_key")
    out = []
    for c in items.columns:
        if c in stock_cols:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}").cast("string"))
                       .otherwise(F.col(c).cast("string")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)

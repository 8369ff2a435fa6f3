"""Data-quality operators: duplicate keys, key profiles, join fan-out,
control totals per stage, orphan stock, and per-row field listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.tables import duplicate_keys


def key_profile(df: DataFrame, key: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """rows, distinct keys (null counted as one value), surplus rows.
    ``approx=True`` uses a HyperLogLog++ sketch (bounded memory, one pass)
    instead of an exact distinct count."""
    distinct = F.approx_count_distinct(F.col(key), rsd) if approx else F.countDistinct(F.col(key))
    prof = df.agg(
        F.count(F.lit(1)).alias("rows"),
        (distinct + F.max(F.col(key).isNull().cast("int"))).alias("distinct_keys"),
    ).select("rows", F.coalesce(F.col("distinct_keys"), F.lit(0)).cast("bigint").alias("distinct_keys"))
    return prof.withColumn("surplus", F.col("rows") - F.col("distinct_keys"))


def duplicate_report(df: DataFrame, key: str, sample: int | None = None) -> DataFrame:
    """Keys seen more than once with their count; with ``sample`` also every
    row of the first ``sample`` such keys (in key order)."""
    dups = duplicate_keys(df, key)
    if sample is None:
        return dups
    picked = dups.orderBy(key).limit(sample).select(key, "cnt")
    return df.join(picked, key, "inner")


def fan_out(left: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys before and after a join (a fan-out shows as more
    rows after with the same keys). Both sides are unioned with a side flag
    and profiled in one aggregate (no join between the two profiles)."""
    u = (left.select(F.col(key).alias("_k"), F.lit(True).alias("_b"))
         .unionByName(joined.select(F.col(key).alias("_k"), F.lit(False).alias("_b"))))
    out = []
    for side, flag in (("before", F.col("_b")), ("after", ~F.col("_b"))):
        out.append(F.count_if(flag).cast("bigint").alias(f"{side}_rows"))
        distinct = (F.countDistinct(F.when(flag, F.col("_k")))
                    + F.coalesce(F.max(F.when(flag & F.col("_k").isNull(), 1)), F.lit(0)))
        out.append(distinct.cast("bigint").alias(f"{side}_distinct_keys"))
    return u.agg(*out)


def reconcile(stages: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Control totals: one row per stage with its row count and column sums
    (a missing column sums to null). Each stage is one global aggregate."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        sums = [F.sum(F.col(c)).cast("bigint").alias(c) if c in df.columns else F.lit(None).cast("bigint").alias(c)
                for c in cols]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *sums).select(
            F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "rows", *cols)
        out = row if out is None else out.unionByName(row)
    return out


def flow_totals(cleaned: DataFrame, clean_cols: list[str], merge, item_keys: DataFrame, cols: list[str], key: str = "master_sku",
                merged_cols: list[str] = ()) -> DataFrame:
    """Control totals of the stages clean, merged, dashboard and orphans from
    one run of the flow: the cleaned rows and the merged ones are observed on
    their way, and one full join of merged stock and item keys (one row per item
    row) gives both the dashboard's rows and the stock without an item. Same
    rows as ``reconcile`` of the four stages; the flow runs when this is called."""
    from pyspark.sql import Observation

    def totals(names):
        return [F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(n)).cast("bigint").alias(c) for n, c in zip(names, cols)]]

    seen = {"clean": Observation(f"clean-{uuid.uuid4().hex}"), "merged": Observation(f"merged-{uuid.uuid4().hex}")}
    merged = merge(cleaned.observe(seen["clean"], *totals(clean_cols))).observe(seen["merged"], *totals(merged_cols))
    joined = merged.join(item_keys.select(F.col(key), F.lit(True).alias("_item")), key, "full")
    item = F.col("_item").isNotNull()
    last = joined.agg(*[x for stage, at in (("dashboard", item), ("orphans", ~item)) for x in (
        F.count_if(at).alias(f"{stage}_rows"),
        *[F.sum(F.when(at, F.coalesce(F.col(n), F.lit(0)))).cast("bigint").alias(f"{stage}_{c}") for n, c in zip(merged_cols, cols)])]).first()
    found = {s: (o.get["rows"], *[o.get[c] for c in cols]) for s, o in seen.items()}
    found |= {s: (last[f"{s}_rows"], *[last[f"{s}_{c}"] for c in cols]) for s in ("dashboard", "orphans")}
    rows = [(i, s, *found[s]) for i, s in enumerate(("clean", "merged", "dashboard", "orphans"))]
    return cleaned.sparkSession.createDataFrame(rows, "stage_no int, stage string, rows long, " + ", ".join(f"{c} long" for c in cols))


def orphan_stock(stock: DataFrame, items: DataFrame, stock_key: str = "master_sku", item_key: str = "sku_code") -> DataFrame:
    """Stock rows whose key has no item row (dropped by the dashboard's left join).
    Item keys are de-duplicated first (map-side), so a SKU repeated in a large
    share of the item rows becomes one row before the shuffle."""
    keys = items.select(F.col(item_key).alias(stock_key)).distinct()
    return stock.join(keys, stock_key, "left_anti")


def row_fields(df: DataFrame, id_col: str, cols: list[str] | None = None) -> DataFrame:
    """Unpivot rows to (id, field, value) keeping only non-empty values."""
    cols = [c for c in (cols or df.columns) if c != id_col]
    text = df.select(F.col(id_col), *[F.col(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([id_col], cols, "field", "value")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != ""))


def kpi_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one KPI computation missing from the other, both ways (empty = agree)."""
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("only_second")))


def check_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that are missing (schema only, no job)."""
    return [c for c in required if c not in df.columns]


def check_input(df: DataFrame, required: list[str] = ()) -> None:
    """Raise before any work when required columns are missing or the input
    has no row (``isEmpty`` reads at most one row)."""
    missing = check_columns(df, list(required))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.isEmpty():
        raise ValueError("input is empty")


def column_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sum of each column over all rows (one row)."""
    return df.agg(*[F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("bigint").alias(c) for c in cols])


def observe_totals(df: DataFrame, name: str, cols: list[str]):
    """Attach control totals to a DataFrame that is written anyway: the
    totals are collected as a side effect of that write (no extra scan).
    Returns (observed DataFrame, Observation); read ``obs.get`` after the action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                          *[F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("bigint").alias(c) for c in cols])
    return observed, obs

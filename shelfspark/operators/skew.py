"""Left joins that split hot keys.

A frequent-items sketch over the key column (one mergeable aggregate, a bounded
number of counters) names the keys that hold more than a share of a partition.
Their rows get a random salt, and the matching row of the other side is
replicated once per salt, so a hot key spreads over many tasks; all other keys
are joined as they are. Null keys match nothing and go round the join. Without a
hot key the plan is the plain join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.numbered import input_bytes

SKEW_BYTES = 256 << 20   # inputs below that are joined plainly: no task of theirs can be large
MAX_HOT = 1_000          # hot keys, at most: bounds the table that is broadcast
TRACKED = 10_000         # counters of the sketch
SALTS_PER_PARTITION = 16


class Hot(NamedTuple):
    """Hot keys with their number of salts, and whether null is one."""
    salts: list[tuple[str, int]]
    null: bool

    def __bool__(self) -> bool:
        return bool(self.salts) or self.null


def hot_keys(rows: DataFrame, key: str, partitions: int | None = None, least_bytes: int | None = None) -> Hot:
    """Keys of ``rows`` that hold more than half of a partition's fair share."""
    if input_bytes(rows) < (SKEW_BYTES if least_bytes is None else least_bytes):
        return Hot([], False)
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(MAX_HOT, 2 * n)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("keyed"),
                     F.expr(f"approx_top_k(`{key}`, {k}, {max(TRACKED, 2 * k)})").alias("top")).first()
    if not found["n"]:
        return Hot([], False)
    least = found["n"] / (2 * n)
    salts = [(t["item"], min(SALTS_PER_PARTITION * n, max(2, round(SALTS_PER_PARTITION * n * t["count"] / found["n"]))))
             for t in found["top"] or [] if t["item"] is not None and t["count"] > least]
    return Hot(salts, found["n"] - found["keyed"] > least)


def _salts(rows: DataFrame, key: str, hot: Hot) -> DataFrame:
    table = rows.sparkSession.createDataFrame(hot.salts, f"`{key}` string, _salts int")
    return rows.join(F.broadcast(table), key, "left")


def left_join(left: DataFrame, right: DataFrame | list[DataFrame], key: str, hot: Hot | None = None,
              how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` (or several, one after the other) on ``key``,
    hot keys of ``left`` split. ``how`` is "left" or "inner"; the right sides
    should hold few rows per key, as those of hot keys are replicated."""
    rights = right if isinstance(right, list) else [right]
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        for r in rights:
            left = left.join(r, key, how)
        return left
    columns = [key, *[c for c in left.columns if c != key], *[c for r in rights for c in r.columns if c != key]]
    keyed = left.where(F.col(key).isNotNull())
    on = [key]
    if hot.salts:
        on = [key, "_salt"]
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")).cast("int")
        keyed = _salts(keyed, key, hot).withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("_salts")
        rights = [_salts(r, key, hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
                  for r in rights]
    for r in rights:
        keyed = keyed.join(r, on, how)
    out = keyed.select(*columns)
    if how == "left":
        absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields if f.name not in left.columns]
        out = out.unionByName(left.where(F.col(key).isNull()).select("*", *absent))
    return out

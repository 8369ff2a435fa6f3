"""Small tables kept beside a published table, made from its committed folders:
the trigram index of its texts, and the mergeable profiles of its columns. Each
names the folders that it was made from, so a stale one is never used."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.scalars import contains_ci, text_or_blank
from shelfspark.operators.commits import Snapshot, commit, snapshot
from shelfspark.operators.numbered import partitions_for
from shelfspark.operators.tables import table_of

GRAM = 3
BLOCK = 4_096            # ids of a posting list, at most
MAX_GRAMS = 6            # of a needle that are looked up; the literal test settles the rest
MAX_BLOCKS = 500         # candidate blocks that bound the scan by their ids, at most
ROW_GROUP_BYTES = 8 << 20


# -- substring search -------------------------------------------------------------

def _grams(text):
    """Distinct runs of three characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM)))))


def publish_grams(items: DataFrame, root: str, table: str, columns=("sku_code", "item_name"), id_col: str = "id",
                  legacy_null_text: bool = False) -> str:
    """Write and commit the posting lists of the lower-cased text columns of
    ``items`` (rows of the committed ``table``): per column, run of three
    characters and block of ids, the ids that hold it. Lists are bounded by the
    block, and sorted by run, so that a lookup reads few row groups."""
    spark = items.sparkSession
    state = snapshot(spark, root)
    name = f"{table}_grams"
    texts = F.array(*[F.struct(F.lit(c).alias("column"), F.lower(text_or_blank(c, legacy_null_text)).alias("text")) for c in columns])
    cells = items.select(F.col(id_col).alias("id"), F.inline(texts))
    runs = cells.select("id", "column", F.explode(_grams(F.col("text"))).alias("gram"))
    block = F.floor(F.col("id") / BLOCK).cast("long")
    lists = runs.groupBy("gram", "column", block.alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    order = ["gram", "column", "block"]
    path = os.path.join(root, name, f"v-{uuid.uuid4().hex}")
    lists.repartitionByRange(partitions_for(items), *order).sortWithinPartitions(*order) \
        .write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    _commit_beside(spark, root, state, table, name, [path])
    return name


def _commit_beside(spark: SparkSession, root: str, state: Snapshot, table: str, name: str, paths: list[str]) -> None:
    commit(spark, root, lambda now: now._replace(tables=now.tables | {name: paths}, made_from=now.made_from | {name: {table: state.paths(table)}}),
           None, state, [table])


def _is_current(state: Snapshot, table: str, name: str) -> bool:
    return bool(state.paths(name)) and state.made_from.get(name) == {table: state.paths(table)}


def candidates(spark: SparkSession, root: str, table: str, needle: str) -> DataFrame:
    """block and id of the rows in which a column holds the needle's runs (a superset of the matches)."""
    low = needle.lower()
    runs = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    runs = runs[::-(-len(runs) // MAX_GRAMS)]
    state = snapshot(spark, root)
    lists = spark.read.schema("gram string, column string, block long, ids array<long>").parquet(*state.paths(f"{table}_grams"))
    found = lists.where(F.col("gram").isin(*runs)).groupBy("column", "block").agg(F.collect_list("ids").alias("lists"))
    # a list per run, each of at most BLOCK ids
    whole = found.where(F.size("lists") == len(runs))
    ids = F.aggregate(F.slice("lists", 2, len(runs)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return whole.select("block", F.explode(ids).alias("id")).distinct()


def indexed_search(spark: SparkSession, root: str, table: str, needle: str, schema: T.StructType, columns=("sku_code", "item_name"),
                   id_col: str = "id", legacy_null_text: bool = False) -> DataFrame:
    """The rows of the committed ``table`` in which one of ``columns`` contains
    ``needle`` (case-insensitive), found through the posting lists; without a
    current index, or for a needle of fewer than three characters, by a scan."""
    state = snapshot(spark, root)
    rows = table_of(spark, state, table, schema)
    if not needle:
        return rows
    literal = reduce(lambda a, b: a | b, [contains_ci(text_or_blank(c, legacy_null_text), needle) for c in columns])
    if len(needle.lower()) < GRAM or not _is_current(state, table, f"{table}_grams"):
        return rows.where(literal)
    found = candidates(spark, root, table, needle)
    blocks = sorted(r["block"] for r in found.select("block").distinct().limit(MAX_BLOCKS + 1).collect())
    if not blocks:
        return rows.where(F.lit(False))
    if len(blocks) <= MAX_BLOCKS:  # bounds on the id reach the files; neighbouring blocks are one range
        cuts = [i for i in range(len(blocks)) if i == 0 or blocks[i] != blocks[i - 1] + 1] + [len(blocks)]
        ranges = [(blocks[a] * BLOCK, (blocks[b - 1] + 1) * BLOCK - 1) for a, b in zip(cuts, cuts[1:])]
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(id_col).between(x, y) for x, y in ranges]))
    return rows.join(found.select(F.col("id").alias(id_col)), id_col, "left_semi").where(literal).select(*schema.fieldNames())


# -- mergeable profiles -----------------------------------------------------------

PROFILE = "folder string, column string, rows long, nulls long, total decimal(38,6), low string, high string, sketch binary"


def update_profile(spark: SparkSession, root: str, table: str, schema: T.StructType, log_k: int = 14) -> int:
    """Bring the profile of ``table`` up to date: folders that it doesn't cover
    yet are read once, each gives one row per column with its counts, sum,
    bounds (as text) and a distinct-count sketch; folders that left the table
    are forgotten. Returns how many folders were read."""
    state = snapshot(spark, root)
    name, paths = f"{table}_profile", state.paths(table)
    have = {p.rpartition("#")[2]: p for p in state.made_from.get(name, {}).get("folders", [])}
    new = [p for p in paths if p not in have]
    added = []
    for folder in new:
        rows = spark.read.schema(schema).parquet(folder)
        out = None
        for f in schema.fields:
            c = F.col(f"`{f.name}`")
            total = F.sum(c.cast("decimal(28,6)")).cast("decimal(38,6)") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("decimal(38,6)")
            one = F.struct(F.lit(folder).alias("folder"), F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"),
                           (F.count(F.lit(1)) - F.count(c)).alias("nulls"), total.alias("total"), F.min(c).cast("string").alias("low"),
                           F.max(c).cast("string").alias("high"), F.hll_sketch_agg(c.cast("string"), F.lit(log_k)).alias("sketch"))
            out = [*(out or []), one]
        path = os.path.join(root, name, f"v-{uuid.uuid4().hex}")
        rows.agg(F.array(*out).alias("x")).select(F.inline("x")).write.parquet(path)  # one pass over the folder
        added.append((folder, path))
    kept = {p: have[p] for p in paths if p in have}
    kept |= {folder: f"{path}#{folder}" for folder, path in added}
    files = [kept[p].rpartition("#")[0] for p in paths]
    commit(spark, root, lambda now: now._replace(tables=now.tables | {name: files}, made_from=now.made_from | {
        name: {"folders": [kept[p] for p in paths]}}), None, state, [table, name])
    return len(new)


def profile(spark: SparkSession, root: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """column, rows, nulls, distinct_keys (estimate; null is one value), surplus
    and total of the committed table, merged from its folders' profiles; no row
    of the table is read. A profile that isn't up to date raises."""
    state = snapshot(spark, root)
    name = f"{table}_profile"
    known = [p.rpartition("#")[2] for p in state.made_from.get(name, {}).get("folders", [])]
    if known != state.paths(table) or not known:
        raise ValueError(f"{name} doesn't cover the current {table}")
    parts = spark.read.schema(PROFILE).parquet(*state.paths(name))
    if columns is not None:
        parts = parts.where(F.col("column").isin(*columns))
    merged = parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
                                         F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("d"), F.sum("total").alias("total"))
    distinct = F.col("d") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    return merged.select("column", "rows", "nulls", distinct.cast("long").alias("distinct_keys"),
                         (F.col("rows") - distinct).cast("long").alias("surplus"), "total")

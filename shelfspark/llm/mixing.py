"""Mixing sources to target weights (native).

Every row gets a hash-random key. Equal ranges of that key are the buckets of
a range sort within its source: word counts are summed per (source, bucket),
prefix sums of these few numbers tell in which bucket the budget of a source
ends, and only the rows of that one bucket are sorted to find the exact row
and word of the cut. Everything else is decided row by row by comparing the
key with the cut, so no text and no hot source is ever shuffled.

Defined cases: null text has size 0 and takes no words; null sources form one
source that comes last; a source without words has the target 0; null ids
share one key; equal rows at a cut share its words evenly (rounded down);
an empty table gives an empty mix; other columns of ``docs`` are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, stored, word_count

BUCKET_ROWS = 512  # rows that a bucket of the range sort holds on average, at most


@dataclass
class Mix:
    """``rows``: one row per document (doc_id, size, source_size, target, taken).
    ``cuts``: one row per source with its target and the place of its cut."""

    rows: DataFrame
    cuts: DataFrame


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    ident = F.col(id_col)
    return docs.select(
        ident.alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Target words of every source of ``sizes`` (source, source_size): ``share``
    of all words, by weight, none above ``max_epochs`` times its size; what is
    over is shared again by weight.

    A source is full when its limit per weight is at most the level that the
    sources with larger limits per weight still reach, so one ordered pass over
    the table of sources replaces the repeated sharing."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    t = (sizes.withColumn("place", F.row_number().over(by_name) - 1)
         .withColumn("weight", weight.cast("double"))
         .withColumn("limit", F.col("source_size") * F.lit(float(max_epochs))))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    everything = Window.partitionBy()
    t = (t.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("full_before", F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("full", F.col("limit") / F.col("weight") <= (F.col("wanted") - F.col("full_before")) / F.col("weight_left"))
         .withColumn("full_words", F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything))
         .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)))
    target = F.when(F.col("full"), F.col("limit")).otherwise(
        (F.col("wanted") - F.col("full_words")) * F.col("weight") / F.col("open_weight"))
    return t.select("source", "source_size", target.alias("target"))


def _cuts(keyed: DataFrame, weights, share, max_epochs) -> DataFrame:
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sizes = stored(sizes, "sources")
    n_rows = sizes.agg(F.sum("n_rows")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(n_rows, 1) / BUCKET_ROWS, 16))) if n_rows > BUCKET_ROWS else 1
    goal = F.round("target").cast("long")
    plan = (targets(sizes.select("source", "source_size"), weights, share, max_epochs)
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", goal - F.col("epochs") * F.col("source_size")))
    plan = stored(plan, "targets")

    bucketed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    at = F.col("before") < F.col("rest")
    cut_bucket = (sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
                  .where(at & (F.col("rest") <= F.col("before") + F.col("words")))
                  .select("s.source", "bucket", "before", "rest"))
    cut_bucket = stored(cut_bucket, "cut-buckets")

    # equal rows count as one with their words together
    near = (bucketed.alias("b").join(cut_bucket.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source"))
                                     & (F.col("b.bucket") == F.col("c.bucket")))
            .groupBy("b.source", "key", "doc_id", "size", "before", "rest").agg(F.count(F.lit(1)).alias("n")))
    running = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    near = (near.withColumn("end", F.col("before") + F.sum(F.col("n") * F.col("size")).over(running))
            .withColumn("start", F.col("end") - F.col("n") * F.col("size"))
            .where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("end"))))
    place = near.select("source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"),
                        F.floor((F.col("rest") - F.col("start")) / F.col("n")).cast("long").alias("cut_words"))
    return stored(plan.alias("p").join(place.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
                  .select("p.source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words"), "cuts")


def _extra(key: Column, ident: Column, size: Column) -> Column:
    """Words that a row adds to the whole epochs of its source."""
    row = F.struct(key, ident, size)
    cut = F.struct("cut_key", "cut_id", "cut_size")
    return (F.when(F.col("cut_key").isNull() | (size == 0), F.lit(0).cast("long"))
            .when(row < cut, size).when(row.eqNullSafe(cut), F.col("cut_words")).otherwise(F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Decide how many words of every document the mix takes."""
    keyed = stored(_keyed(docs, id_col, text_col, source_col), "mix-keys")
    cuts = _cuts(keyed, weights, share, max_epochs)
    taken = F.col("epochs") * F.col("size") + _extra(F.col("key"), F.col("doc_id"), F.col("size"))
    rows = (keyed.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
            .select("doc_id", "size", "source_size", "target", taken.alias("taken")))
    return Mix(rows, cuts)


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text with the white space before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, once for every
    epoch that takes them; the document at a source's cut comes with the words
    before the cut only. Documents without words are left out."""
    cuts = _cuts(stored(_keyed(docs, id_col, text_col, source_col), "mix-keys"), weights, share, max_epochs)
    cuts = cuts.select(*[F.col(c).alias(f"__mix_{c}") for c in cuts.columns])
    size = word_count(F.col(text_col))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    row = F.struct(key, F.col(id_col), size)
    cut = F.struct("__mix_cut_key", "__mix_cut_id", "__mix_cut_size")
    extra = (F.when(F.col("__mix_cut_key").isNull() | (size == 0), F.lit(0).cast("long"))
             .when(row < cut, size).when(row.eqNullSafe(cut), F.col("__mix_cut_words")).otherwise(F.lit(0).cast("long")))
    joined = (docs.join(cuts, docs[source_col].eqNullSafe(F.col("__mix_source")))
              .withColumn("__mix_size", size).withColumn("__mix_extra", extra).where(F.col("__mix_size") > 0))
    # words of each copy: the whole epochs, then what the cut leaves
    copies = F.filter(F.concat(F.array_repeat(F.col("__mix_size"), F.col("__mix_epochs").cast("int")), F.array("__mix_extra")),
                      lambda w: w > 0)
    exploded = joined.withColumn("__mix_words", F.explode(copies))
    text = F.when(F.col("__mix_words") == F.col("__mix_size"), F.col(text_col)).otherwise(
        first_words(F.col(text_col), F.col("__mix_words")))
    out = exploded.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3, 1, 2][cast((row_number() over (order by source asc nulls last) - 1) % 3 as int) + 1] as weight,
             row_number() over (order by source asc nulls last) as place, 2.0::double * source_size as lim from s),
l as (select *, 1.5::double * sum(source_size) over () as wanted,
             coalesce(sum(lim) over (order by lim / weight, place rows between unbounded preceding and 1 preceding), 0) as full_before,
             sum(weight) over (order by lim / weight, place rows between current row and unbounded following) as weight_left from w),
f as (select *, lim / weight <= (wanted - full_before) / weight_left as is_full from l),
t as (select source, source_size,
             case when is_full then lim
                  else (wanted - sum(case when is_full then lim else 0 end) over ()) * weight
                       / sum(case when is_full then 0 else weight end) over () end as target from f),
b as (select *, cast(round(target) as bigint) as goal from t),
r as (select d.doc_id, d.size, b.source_size, b.target, b.goal,
             sum(d.size) over (partition by d.source order by k, d.doc_id rows unbounded preceding) as upto
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (goal // source_size) * size
            + greatest(0, least(size, goal % source_size - (upto - size))) end as bigint) as taken
from r
"""

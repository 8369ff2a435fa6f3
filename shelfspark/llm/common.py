"""Helpers shared by the operators: written tables and word counting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import checkpoint_dir

# a word is a run of characters that are neither blank, tab, line feed, vertical tab, form feed nor return
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    It cuts the lineage like ``checkpoint()``, but in columns, and the planner
    then knows the true size of the table (so a broadcast is chosen by it)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them is stored itself."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, max_rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and label of about ``max_rows`` labelled documents at most
    (all, if fewer), those with small hashes of their id. The hash thins out
    both sides before the join, so few texts are shuffled."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    n = known.count()
    limit = (min(1.0, max_rows / max(n, 1)) - 0.5) * 2.0**64
    low = F.xxhash64(F.col(id_col).cast("string")) <= F.lit(limit)
    one = known.where(low).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).alias("label"))
    texts = docs.where(low & learnable & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(one, "doc_id")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their
    Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="shelfspark-"), "shelfspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._shelfspark_shipped = True


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are over: its cleaner
    does so once the driver's garbage, which refers to them, is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import tables
from shelfspark.schemas import STOCK_UPDATE


def test_upsert_last_wins_and_keeps_others(spark):
    target = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v long")
    updates = spark.createDataFrame([("B", 20, 1), ("C", 30, 2), ("B", 21, 3)], "k string, v long, o long")
    got = dict((r.k, r.v) for r in tables.upsert(target, updates, "k", ["v"], order="o").collect())
    assert got == {"A": 1, "B": 21, "C": 30}


def test_update_and_delete_matched(spark):
    target = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, v long, w string")
    upd = spark.createDataFrame([("B", 9)], "k string, v long")
    got = sorted(tuple(r) for r in tables.update_matched(target, upd, "k", ["v"]).collect())
    assert got == [("A", 1, "x"), ("B", 9, "y")]
    keys = spark.createDataFrame([("A",)], "k string")
    assert [r.k for r in tables.delete_matched(target, keys, "k").collect()] == ["B"]


def test_assign_ids_gap_free_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("o"), F.lit("x").alias("p")).repartition(7)
    out = tables.assign_ids(df, ["o"])
    rows = sorted((r.o, r.id) for r in out.collect())
    assert [i for _, i in rows] == list(range(1, 5001))


def test_publish_and_current_versions(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "stock_update")
    empty = tables.current(spark, base, STOCK_UPDATE)
    assert empty.count() == 0 and empty.schema == STOCK_UPDATE
    df = spark.createDataFrame([("A", 1, 2, 3, 4)], STOCK_UPDATE)
    tables.publish(df, base, batch_id="s#0")
    tables.publish(df.union(spark.createDataFrame([("B", 0, 0, 0, 0)], STOCK_UPDATE)), base, batch_id="s#1")
    assert tables.current(spark, base, STOCK_UPDATE).count() == 2
    # a retry of the newest batch starts from what its first attempt started from
    assert tables.state_before(spark, base, STOCK_UPDATE, "s#1").count() == 1
    assert tables.state_before(spark, base, STOCK_UPDATE, "s#2").count() == 2
    # another stream, and a single run, start from the newest commit
    assert tables.state_before(spark, base, STOCK_UPDATE, "other#1").count() == 2
    assert tables.state_before(spark, base, STOCK_UPDATE, None).count() == 2
    tables.publish(df, base, batch_id="s#1")
    assert tables.current(spark, base, STOCK_UPDATE).count() == 1
    with pytest.raises(ValueError):
        tables.publish(df.union(df), base, batch_id="s#2", unique_key="master_sku")
    assert tables.current(spark, base, STOCK_UPDATE).count() == 1  # the failed publish switched nothing


def test_half_written_versions_and_commits_do_not_count(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "stock_update")
    os.makedirs(os.path.join(base, "v-half", "_temporary"))
    with pytest.raises(ValueError):
        tables.current(spark, base, STOCK_UPDATE)  # data without a commit: not known to be empty
    assert tables.state_before(spark, base, STOCK_UPDATE, "s#0").count() == 0
    tables.publish(spark.createDataFrame([("A", 1, 2, 3, 4)], STOCK_UPDATE), base, batch_id="s#0")
    os.makedirs(os.path.join(base, "v-half2", "_temporary"))
    with open(os.path.join(tmpdir_path, "_commits", f"{9:020d}"), "w") as f:
        f.write('{"tables": {"stock_upd')  # a commit that is still being written
    assert tables.current(spark, base, STOCK_UPDATE).count() == 1
    assert tables.state_before(spark, base, STOCK_UPDATE, "s#1").count() == 1
    tables.publish(spark.createDataFrame([("A", 1, 2, 3, 4), ("B", 1, 2, 3, 4)], STOCK_UPDATE), base, batch_id="s#1")
    assert tables.current(spark, base, STOCK_UPDATE).count() == 2


def test_readers_never_see_an_empty_table(spark, tmpdir_path):
    import threading
    root = os.path.join(tmpdir_path, "root")
    base = os.path.join(root, "t")
    tables.publish(spark.range(3), base)
    paths, bad, stop = tables.current_paths(spark, base), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                if not tables.current_paths(spark, base):
                    bad.append("empty")
            except Exception as e:
                bad.append(repr(e))

    t = threading.Thread(target=read)
    t.start()
    for _ in range(40):
        tables._commit(spark, root, lambda m: m | {"t": paths}, "s#1")
    stop.set()
    t.join()
    assert not bad and len(os.listdir(os.path.join(root, "_commits"))) >= 41


def test_tables_published_together_switch_together(spark, tmpdir_path):
    tables.publish_together(spark, tmpdir_path, {"a": spark.range(1), "b": spark.range(2)})
    dup = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(ValueError):
        tables.publish_together(spark, tmpdir_path, {"a": spark.range(5), "b": (dup, {"unique_key": "id"})})
    assert tables.read_table(spark, tmpdir_path, "a").count() == 1


def test_load_table_append_replace(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "a long, b string").toDF(" Price.INR ", "na`me")
    tables.load_table(df, tmpdir_path, "t", "append")
    tables.load_table(df, tmpdir_path, "t", "append")
    out = tables.read_table(spark, tmpdir_path, "t")
    assert out.columns == ["id", "Price.INR", "name"]
    assert dict(out.dtypes)["Price.INR"] == "string"
    assert sorted(tuple(r) for r in out.collect()) == [(1, "1", "a"), (2, "1", "a")]  # ids go on
    with pytest.raises(ValueError):
        tables.load_table(df.toDF("x", "y"), tmpdir_path, "t", "append")  # other columns
    tables.load_table(df, tmpdir_path, "t", "replace")
    assert [r.id for r in tables.read_table(spark, tmpdir_path, "t").collect()] == [1]
    with pytest.raises(ValueError):
        tables.load_table(df, tmpdir_path, "t", "merge")


def test_table_counts_error_rows(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "x")
    spark.range(3).write.parquet(p)
    rows = {r.path: (r.rows, r.error is None) for r in
            tables.table_counts(spark, [p, os.path.join(tmpdir_path, "missing")]).collect()}
    assert rows[p] == (3, True)
    assert rows[os.path.join(tmpdir_path, "missing")][1] is False


def test_assign_ids_spreads_a_hot_order_value(spark):
    # a third of the rows share one order value: still gap-free, and no
    # range partition holds them all
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("o"))
    out = tables.assign_ids(df, ["o"], partitions=6)
    ids = sorted(r.id for r in out.collect())
    assert ids == list(range(1, 3001))
    ranks = {r.o: r.id for r in out.filter("o != 5").collect()}
    assert ranks[1] < ranks[2]


def test_publish_sorted_within_files(spark, tmpdir_path):
    import pyarrow.parquet as pq
    base = os.path.join(tmpdir_path, "t")
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id")).coalesce(1)
    path = tables.publish(df, base, batch_id=0, sort_within="k")
    part = [f for f in os.listdir(path) if f.endswith(".parquet")][0]
    ks = pq.read_table(os.path.join(path, part)).column("k").to_pylist()
    assert ks == sorted(ks)


def test_upsert_unique_inputs_hash_path(spark):
    import re
    target = spark.createDataFrame([("A", 1, 10), ("B", 2, 20)], "k string, v long, w long")
    updates = spark.createDataFrame([("B", 5, 50), ("C", 6, 60)], "k string, v long, w long")
    out = tables.upsert(target, updates, "k", ["v", "w"], unique_inputs=True)
    assert sorted(tuple(r) for r in out.collect()) == [("A", 1, 10), ("B", 5, 50), ("C", 6, 60)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"(\w*Aggregate)\(", plan)) == {"HashAggregate"}


def test_checkpoint_dir_guard():
    import pytest
    from shelfspark.session import checkpoint_dir

    class Ctx:
        def __init__(self, master, current=None):
            self.master, self.current, self.set_to = master, current, None

        def getCheckpointDir(self):
            return self.current or self.set_to

        def setCheckpointDir(self, d):
            self.set_to = d

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, master, conf_value=None, current=None):
            self.sparkContext, self.conf = Ctx(master, current), Conf(conf_value)

    with pytest.raises(ValueError):
        checkpoint_dir(Session("yarn"))                        # cluster without a shared folder
    assert checkpoint_dir(Session("yarn", "hdfs:///ckpt")) == "hdfs:///ckpt"
    assert checkpoint_dir(Session("yarn", current="s3a://b/c")) == "s3a://b/c"
    assert checkpoint_dir(Session("local[2]")).startswith("/")  # tests: a temporary folder

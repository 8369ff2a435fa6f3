import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import commits, dashboard, incremental, tables
from shelfspark.schemas import CATALOG_PRICING, ITEM_MASTER, SHEET_COLUMNS, STOCK_ITEMS, STOCK_UPDATE
from shelfspark.streaming import refresh


def _together(*work):
    errors = []

    def run(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors, errors


def test_overlapping_commits_lose_nothing(spark, tmpdir_path):
    """50 rounds of three writers at once: every one is in the log, on top of another."""
    for n in range(50):
        root = os.path.join(tmpdir_path, str(n))

        def add(i):
            return lambda: commits.commit(spark, root, lambda now: now._replace(tables=now.tables | {"t": now.paths("t") + [f"p{i}"]}))

        _together(*[add(i) for i in range(3)])
        state = commits.snapshot(spark, root)
        assert state.number == 3 and sorted(state.paths("t")) == ["p0", "p1", "p2"]
        assert sorted(os.listdir(os.path.join(root, "_commits"))) == [f"{i:020d}" for i in (1, 2, 3)]


def test_overlapping_loads_get_gap_free_ids(spark, tmpdir_path):
    for n in range(4):
        base = os.path.join(tmpdir_path, str(n))
        frames = [spark.range(7).select(F.lit(str(i)).alias("who"), F.col("id").cast("string").alias("x")).repartition(2) for i in range(3)]
        _together(*[(lambda f=f: tables.load_table(f, base, "t", "append")) for f in frames])
        rows = tables.read_table(spark, base, "t").collect()
        assert sorted(r.id for r in rows) == list(range(1, 22))
        assert sorted((r.who, r.x) for r in rows) == sorted((str(i), str(x)) for i in range(3) for x in range(7))
        by_id = [r.who for r in sorted(rows, key=lambda r: r.id)]
        assert all(len(set(by_id[i:i + 7])) == 1 for i in (0, 7, 14))  # each load keeps together


def test_loads_keep_file_order_and_an_append_after_a_replace_is_checked(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "in")
    spark.range(1000).select(F.format_string("r%04d", "id").alias("x")).coalesce(1).write.text(path)
    lines = spark.read.text(path)
    tables.load_table(lines, tmpdir_path, "t", "replace")
    tables.load_table(lines.limit(3), tmpdir_path, "t", "append")
    got = [(r.id, r.value) for r in tables.read_table(spark, tmpdir_path, "t").orderBy("id").collect()]
    assert got == [(i + 1, f"r{i:04d}") for i in range(1000)] + [(1001 + i, f"r{i:04d}") for i in range(3)]
    tables.load_table(lines.limit(0), tmpdir_path, "t", "append")  # no rows: nothing changes
    assert tables.read_table(spark, tmpdir_path, "t").count() == 1003


def test_a_stale_writer_is_refused(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "r")
    tables.publish_together(spark, root, {"a": spark.range(1), "b": spark.range(1)})
    state = commits.snapshot(spark, root)
    tables.publish(spark.range(5), os.path.join(root, "a"))
    with pytest.raises(commits.Conflict):
        tables.publish_together(spark, root, {"b": spark.range(9)}, None, state, ["a"])
    tables.publish_together(spark, root, {"b": spark.range(7)}, None, state, ["b"])  # b is as it was read
    assert tables.read_table(spark, root, "a").count() == 5 and tables.read_table(spark, root, "b").count() == 7
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise commits.Conflict("t")
        return "done"

    assert commits.redo(work) == "done"
    with pytest.raises(commits.Conflict):
        commits.redo(lambda: (_ for _ in ()).throw(commits.Conflict("t")), attempts=2)


def test_old_versions_are_removed_but_not_what_is_named(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "r")
    base = os.path.join(root, "t")
    for n in range(4):
        tables.publish(spark.range(n + 1), base)
    assert commits.remove_old(spark, root, keep=1, older_than_s=3600) == []  # too young
    gone = commits.remove_old(spark, root, keep=1, older_than_s=-1)
    assert len(gone) == 2 and len([d for d in os.listdir(base) if d.startswith("v-")]) == 2  # the newest, and the one before it
    assert tables.read_table(spark, root, "t").count() == 4
    tables.publish(spark.range(9), base)
    assert commits.snapshot(spark, root).number == 5


# -- dashboard by change sets -----------------------------------------------------

def _sheet(spark, rows, at):
    cells = [(k, str(v), k, str(v + 1), None, None, None, None) for k, v in rows]
    sheet = spark.createDataFrame(cells or [(None,) * 8], ", ".join(f"{c} string" for c in SHEET_COLUMNS))
    return sheet.select("*", F.lit(f"s{at}").alias("_file"), F.lit(0).cast("long").alias("_block"), F.lit(at).alias("_mtime"),
                        F.monotonically_increasing_id().alias("_mid"))


ACTION_COLS = ["master_sku", "item_name", "size", "category", "location", "cost", "price", "catalog", "mrp", "updated", "action"]


def _action_file(spark, rows, at):
    cells = [(k, f"{a}{at}.{i}", "M", "c", "L", str(i), "2", "cat", "3", "d", a) for i, (a, k) in enumerate(rows)]
    return spark.createDataFrame(cells, ", ".join(f"{c} string" for c in ACTION_COLS)).coalesce(1).select(
        "*", F.lit(f"a{at}").alias("_file"), F.lit(at).alias("_mtime"), F.lit(0).cast("long").alias("_block"), F.monotonically_increasing_id().alias("_mid"))


def _tables(spark, base):
    return [tables.current(spark, os.path.join(base, n), schema) for n, schema in
            (("item_master", ITEM_MASTER), ("stock_update", STOCK_UPDATE), ("catalog_pricing", CATALOG_PRICING))]


def _rebuilt(spark, base):
    items, stock, cat = _tables(spark, base)
    return sorted(tuple(r) for r in dashboard.build_dashboard(items, stock, cat).collect())


def _shown(spark, base):
    return sorted(tuple(r) for r in tables.current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS).collect())


def test_dashboard_by_change_sets_equals_a_rebuild(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(incremental, "SLICE_ROWS", 4)
    monkeypatch.setattr("shelfspark.operators.numbered.SLICE_ROWS", 4)
    rnd = random.Random(5)
    base = os.path.join(tmpdir_path, "t")
    skus = [f"sku-{i}" for i in range(12)]
    items = spark.createDataFrame([(10 * i, f" {skus[i % 12]}", f"st{i}", "M", "c", "L") for i in range(14)], ITEM_MASTER)
    tables.publish(items, os.path.join(base, "item_master"), schema=ITEM_MASTER)
    styles = [f"st{i}" for i in range(14)]
    refresh.actions_batch(spark, _action_file(spark, [("add", "SKU-90")], 0), "i#0", base)
    styles.append("add0.0")
    kept = []
    for n in range(1, 6):
        before = set(commits.snapshot(spark, base).paths("stock_items"))
        if n % 2:
            some = rnd.sample(skus, 2) + ["OTHER"]
            refresh.refresh_batch(spark, _sheet(spark, [(k, rnd.randint(0, 3)) for k in some], n), f"r#{n}", base, skip=0)
        else:
            key = rnd.choice(skus)
            refresh.actions_batch(spark, _action_file(spark, [("replace", "SKU-90"), ("delete", key), ("add", f"NEW-{n}"), ("add", key)], n), f"i#{n}", base)
        got = _shown(spark, base)
        assert [r[0] for r in got] == list(range(1, len(got) + 1))  # ids without gaps, in item order
        assert got == [tuple([i + 1, *r[1:]]) for i, r in enumerate(_rebuilt(spark, base))]
        if n > 1:
            kept.append(len(before & set(commits.snapshot(spark, base).paths("stock_items"))))
    assert max(kept) >= 2 and min(kept) >= 1  # slices without a changed SKU are the same folders as before
    low, high = 3, 6
    some = tables.current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS, between=(low, high))
    assert sorted(tuple(r) for r in some.collect()) == _shown(spark, base)[low - 1:high]
    assert len(some.inputFiles()) < len(commits.snapshot(spark, base).paths("stock_items"))


def test_imports_keep_order_and_a_publish_between_attempt_and_retry_stays(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "t")
    first = _action_file(spark, [("add", "A1"), ("add", "A2")], 1)
    refresh.actions_batch(spark, first, "i#0", base)
    refresh.actions_batch(spark, _action_file(spark, [("add", "B1"), ("add", "B2")], 2), "i#1", base)
    rows = [(r.row_no, r.master_sku) for r in _tables(spark, base)[0].orderBy("row_no").collect()]
    assert rows == [(1, "A1"), (2, "A2"), (3, "B1"), (4, "B2")]
    assert [r[1] for r in _shown(spark, base)] == ["A1", "A2", "B1", "B2"]
    # someone publishes items; then the last batch is retried
    more = spark.createDataFrame([(1, "MANUAL", "s", "M", "c", "L")], ITEM_MASTER)
    tables.publish(more, os.path.join(base, "item_master"), schema=ITEM_MASTER)
    again = refresh.actions_batch(spark, _action_file(spark, [("add", "B1"), ("add", "B2")], 2), "i#1", base)
    assert again.first().added == 2
    assert [r.master_sku for r in _tables(spark, base)[0].collect()] == ["MANUAL"]
    # the next refresh shows them, although the dashboard was made from other items
    refresh.refresh_batch(spark, _sheet(spark, [("MANUAL", 4)], 3), "r#0", base, skip=0)
    assert [(r[0], r[1], r[11]) for r in _shown(spark, base)] == [(1, "MANUAL", 4)]


def test_a_refresh_and_an_import_at_once(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "t")
    refresh.actions_batch(spark, _action_file(spark, [("add", "A"), ("add", "B")], 1), "i#0", base)
    _together(lambda: refresh.refresh_batch(spark, _sheet(spark, [("A", 1), ("C", 2)], 2), "r#0", base, skip=0),
              lambda: refresh.actions_batch(spark, _action_file(spark, [("add", "C"), ("delete", "B")], 3), "i#1", base))
    assert [(r[0], r[1], r[11]) for r in _shown(spark, base)] == [(1, "A", 1), (2, "C", 2)]

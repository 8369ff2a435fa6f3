import os
import time

import pytest

from pyspark.sql import functions as F

from shelfspark.operators.tables import commits, current, publish
from shelfspark.schemas import AUDIT_LOG, ITEM_MASTER, STOCK_ITEMS, STOCK_UPDATE
from shelfspark.streaming import refresh

BANNER = "Stock,,,,,,,\nnote,,,,,,,\nuni,qty,fba,qty,fbf,qty,sjit,qty\n"


def _land(d, name, body, mtime):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(BANNER + body)
    os.utime(p, (mtime, mtime))


def _cells(spark, d):
    return (spark.read.schema(refresh.all_strings([f"c{i}" for i in range(20)])).option("encoding", "ISO-8859-1").csv(d)
            .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                    F.col("_metadata.file_modification_time").alias("_mtime"), F.monotonically_increasing_id().alias("_mid")))


def _tables(spark, base, skus=("SKU-1", "SKU-2")):
    items = spark.createDataFrame([(i + 1, k, "a", "M", "c", "L") for i, k in enumerate(skus)], ITEM_MASTER)
    publish(items, os.path.join(base, "item_master"), batch_id="init", schema=ITEM_MASTER)


def test_refresh_once_twice_and_a_new_checkpoint_keep_stale_skus(spark, tmpdir_path):
    base, sheets = os.path.join(tmpdir_path, "t"), os.path.join(tmpdir_path, "s")
    os.makedirs(sheets)
    _tables(spark, base)
    one, two = os.path.join(tmpdir_path, "one.csv"), os.path.join(tmpdir_path, "two.csv")
    _land(tmpdir_path, "one.csv", "SKU-1,5,,,,,,\nSKU-2,4,,,,,,\n", time.time() - 50)
    _land(tmpdir_path, "two.csv", "SKU-1,7,,,,,,\n", time.time())
    refresh.refresh_once(spark, one, base)
    refresh.refresh_once(spark, two, base)

    def state():
        return {r.master_sku: r.uniware_stock for r in current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).collect()}
    assert state() == {"SKU-1": 7, "SKU-2": 4}
    # streams with new checkpoints start at batch 0 again, on top of the same state
    for i, body in enumerate(("SKU-3,1,,,,,,\n", "SKU-1,9,,,,,,\n")):
        d = os.path.join(sheets, str(i))
        os.makedirs(d)
        _land(d, "a.csv", body, time.time())
        refresh.stream_refresh(spark, d, base, checkpoint=os.path.join(tmpdir_path, f"ck{i}"), trigger="availableNow").awaitTermination(120)
    assert state() == {"SKU-1": 9, "SKU-2": 4, "SKU-3": 1}


def test_default_checkpoints_are_apart_and_outlive_the_session(spark, tmpdir_path):
    for name, body in (("x", "SKU-1,1,,,,,,\n"), ("y", "SKU-2,2,,,,,,\n")):
        base, sheets = os.path.join(tmpdir_path, name), os.path.join(tmpdir_path, name + "s")
        os.makedirs(sheets)
        _tables(spark, base)
        _land(sheets, "a.csv", body, time.time())
        refresh.stream_refresh(spark, sheets, base, trigger="availableNow").awaitTermination(120)
        assert os.path.isdir(os.path.join(base, "_checkpoints", "refresh"))
        assert current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).count() == 1
        refresh.stream_refresh(spark, sheets, base, trigger="availableNow").awaitTermination(120)
        assert len(commits(spark, base, last=10)) == 2  # the second run had nothing new to do


def test_action_headers_by_name_arrival_order_and_refresh_after_import(spark, tmpdir_path):
    base, adir, sheets = (os.path.join(tmpdir_path, n) for n in ("t", "a", "s"))
    os.makedirs(adir)
    os.makedirs(sheets)
    _tables(spark, base)
    now = time.time()
    files = {"z.csv": ("Action,Master SKU,Style ID / Parent SKU\nadd,SKU-3,first\nreplace,SKU-1,older\n".encode(), now - 50),
             "a.csv": ("Master SKU,Action,Style ID / Parent SKU\nSKU-1,replace,caf\xe9\n".encode("latin-1"), now - 10)}
    for name, (body, at) in files.items():
        with open(os.path.join(adir, name), "wb") as f:
            f.write(body)
        os.utime(os.path.join(adir, name), (at, at))
    refresh.stream_actions(spark, adir, base).awaitTermination(120)
    got = {r.master_sku: r.style for r in current(spark, os.path.join(base, "item_master"), ITEM_MASTER).collect()}
    assert got == {"SKU-1": "caf\xe9", "SKU-2": "a", "SKU-3": "first"}
    # the next refresh reads the items of now, so the imported one stays
    _land(sheets, "s.csv", "SKU-3,6,,,,,,\n", now)
    refresh.stream_refresh(spark, sheets, base, trigger="availableNow").awaitTermination(120)
    board = current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS)
    assert {r.sku_code: r.available_atp for r in board.collect()} == {"SKU-1": 0, "SKU-2": 0, "SKU-3": 6}


def test_action_files_without_action_column_or_rows_raise(spark, tmpdir_path):
    for name, body in (("x", "Master SKU,Size\nSKU-1,M\n"), ("y", "Master SKU,Action\n")):
        d = os.path.join(tmpdir_path, name)
        os.makedirs(d)
        with open(os.path.join(d, "f.csv"), "w") as f:
            f.write(body)
        with pytest.raises(ValueError):
            refresh.labelled_actions(_cells(spark, d))


def test_refresh_snapshots_stale_keys_and_retry(spark, tmpdir_path):
    sheets = os.path.join(tmpdir_path, "sheets")
    base = os.path.join(tmpdir_path, "tables")
    os.makedirs(sheets)
    items = spark.createDataFrame([(1, "sku-1", "a", "M", "c", "L"), (2, "SKU-2", "b", "S", "c", "L"),
                                   (3, "SKU-3", "d", "S", "c", "L")],
                                  "row_no long, master_sku string, style string, size string, category string, loc string")
    now = time.time()
    # two snapshots in one micro-batch: the newer wins, they are not added together
    _land(sheets, "snap1.csv", "SKU-1,5,,,,,,\nSKU-2,4,,,,,,\n", now - 100)
    _land(sheets, "snap2.csv", "SKU-1,7,SKU-1,1,,,,\n", now - 50)
    ckpt = os.path.join(tmpdir_path, "ckpt")
    q = refresh.stream_refresh(spark, sheets, base, items, checkpoint=ckpt, trigger="availableNow")
    q.awaitTermination(120)
    state = {r.master_sku: (r.uniware_stock, r.fba_stock) for r in
             current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).collect()}
    assert state == {"SKU-1": (7, 1), "SKU-2": (4, 0)}

    # a later snapshot without SKU-2: SKU-2 keeps its last stock
    _land(sheets, "snap3.csv", "SKU-1,2,,,,,,\nSKU-3,9,,,,,,\n", now)
    q = refresh.stream_refresh(spark, sheets, base, items, checkpoint=ckpt, trigger="availableNow")
    q.awaitTermination(120)
    board = current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS)
    got = {r.sku_code: (r.id, r.available_atp) for r in board.collect()}
    assert got == {"SKU-1": (1, 2), "SKU-2": (2, 4), "SKU-3": (3, 9)}

    newest = commits(spark, base)
    assert newest[0]["batch"].endswith("#1")
    # re-running batch 1 (a retry) gives the same state, not a double application
    batch = (spark.read.schema(refresh.all_strings(refresh.SHEET_COLUMNS)).csv(os.path.join(sheets, "snap3.csv"))
             .select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.col("_metadata.file_modification_time").alias("_mtime"))
             .withColumn("_mid", F.monotonically_increasing_id()))
    refresh.refresh_batch(spark, batch, newest[0]["batch"], base, items)
    again = {r.master_sku: r.uniware_stock for r in
             current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).collect()}
    assert again == {"SKU-1": 2, "SKU-2": 4, "SKU-3": 9}


def test_audit_counts_windowed(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"id": 1, "username": "u", "action": "LOGIN", "timestamp": "2024-01-01T10:00:00Z"}\n'
                '{"id": 2, "username": "u", "action": "LOGIN", "timestamp": "2024-01-01T11:00:00Z"}\n'
                '{"id": 3, "username": "v", "action": "EXPORT", "timestamp": "2024-01-02T09:00:00Z"}\n')
    logs = spark.readStream.schema(AUDIT_LOG).json(d)
    counts = refresh.stream_audit_counts(logs, watermark="1 hour", window="1 day")
    q = (counts.writeStream.outputMode("update").format("memory").queryName("audit_counts_test")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = {(str(r.window.start)[:10], r.action): r.n for r in spark.sql("select * from audit_counts_test").collect()}
    assert rows == {("2024-01-01", "LOGIN"): 2, ("2024-01-02", "EXPORT"): 1}


def test_action_stream_applies_once(spark, tmpdir_path):
    from shelfspark.operators.tables import current, publish
    from shelfspark.schemas import CATALOG_PRICING, ITEM_MASTER
    base = os.path.join(tmpdir_path, "tables")
    adir = os.path.join(tmpdir_path, "actions")
    os.makedirs(adir)
    items = spark.createDataFrame([(1, "SKU-1", "a", "M", "c", "L"), (2, "SKU-2", "b", "S", "c", "L")], ITEM_MASTER)
    cat = spark.createDataFrame([("SKU-1", "d", "n", 1.0, 2.0, 3.0, 4.0)], CATALOG_PRICING)
    publish(items, os.path.join(base, "item_master"), batch_id="init", schema=ITEM_MASTER)
    publish(cat, os.path.join(base, "catalog_pricing"), batch_id="init", schema=CATALOG_PRICING)
    header = ",".join(refresh.ACTION_LABELS) + "\n"
    with open(os.path.join(adir, "a1.csv"), "w") as f:
        f.write(header + "SKU-3,new,L,c,X,5,6,cat,7,0,0,0,0,2024-01-01,add\n"
                         "sku-2,,,,,,,,,,,,,,delete\n"
                         "SKU-1,ren,M,c,L,9,9,cat,8,0,0,0,0,,replace\n"
                         ",,,,,,,,,,,,,,add\n")
    q = refresh.stream_actions(spark, adir, base, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    got = {r.master_sku: r.style for r in current(spark, os.path.join(base, "item_master"), ITEM_MASTER).collect()}
    assert got == {"SKU-1": "ren", "SKU-3": "new"}
    c = {r.master_sku: (r.cost, r.up_price, r.mrp) for r in
         current(spark, os.path.join(base, "catalog_pricing"), CATALOG_PRICING).collect()}
    assert c == {"SKU-1": (9.0, 8.0, 4.0), "SKU-3": (5.0, 7.0, 0.0)}
    # replaying batch 0 gives the same tables
    batch = refresh.labelled_actions(_cells(spark, adir))
    refresh.actions_batch(spark, batch, commits(spark, base)[0]["batch"], base)
    again = {r.master_sku: r.style for r in current(spark, os.path.join(base, "item_master"), ITEM_MASTER).collect()}
    assert again == got
    # the import refreshed the dashboard (no stock state yet: stock is 0)
    board = current(spark, os.path.join(base, "stock_items"), STOCK_ITEMS)
    assert {(r.id, r.sku_code, r.item_name, r.up_price) for r in board.collect()} == {
        (1, "SKU-1", "ren", 8.0), (2, "SKU-3", "new", 7.0)}


def test_one_file_or_five_gives_batch_state(spark, tmpdir_path):
    from shelfspark.operators import stock
    from shelfspark.schemas import SHEET_COLUMNS, all_strings
    rows = [(f"SKU-{i}", str(i % 7), f"SKU-{i}", "1", "", "", "", "") for i in range(50)]
    items = spark.createDataFrame([(1, "SKU-1", "a", "M", "c", "L")],
                                  "row_no long, master_sku string, style string, size string, category string, loc string")
    states = []
    for n_files in (1, 5):
        d = os.path.join(tmpdir_path, f"s{n_files}")
        os.makedirs(d)
        per = len(rows) // n_files
        for j in range(n_files):
            _land(d, f"f{j}.csv", "".join(",".join(r) + "\n" for r in rows[j * per:(j + 1) * per]), time.time() - 10 + j)
        base = os.path.join(tmpdir_path, f"t{n_files}")
        q = refresh.stream_refresh(spark, d, base, items, checkpoint=os.path.join(tmpdir_path, f"c{n_files}"),
                                   trigger="availableNow")
        q.awaitTermination(120)
        states.append({r.master_sku: tuple(r)[1:] for r in
                       current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).collect()})
    batch = {r.master_sku: tuple(r)[1:] for r in
             stock.channel_stock(spark.createDataFrame(rows, all_strings(SHEET_COLUMNS))).collect()}
    assert states[0] == states[1] == batch


def test_failed_batch_reported_and_next_applies(spark, tmpdir_path):
    sheets = os.path.join(tmpdir_path, "sheets")
    base = os.path.join(tmpdir_path, "tables")
    os.makedirs(sheets)
    items = spark.createDataFrame([(1, "SKU-1", "a", "M", "c", "L")],
                                  "row_no long, master_sku string, style string, size string, category string, loc string")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    # overflowing totals fail the batch under ANSI arithmetic
    _land(sheets, "bad.csv", "SKU-1,9223372036854775807,,,,,,\nSKU-1,1,,,,,,\n", time.time() - 60)
    q = refresh.stream_refresh(spark, sheets, base, items, checkpoint=ckpt, trigger="availableNow", on_error="report")
    q.awaitTermination(120)
    errs = spark.read.json(os.path.join(base, "refresh_errors")).collect()
    assert len(errs) == 1 and errs[0].batch_id == 0
    _land(sheets, "good.csv", "SKU-1,3,,,,,,\n", time.time())
    q = refresh.stream_refresh(spark, sheets, base, items, checkpoint=ckpt, trigger="availableNow", on_error="report")
    q.awaitTermination(120)
    state = {r.master_sku: r.uniware_stock for r in
             current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).collect()}
    assert state == {"SKU-1": 3}


def test_audit_counts_drop_late_events(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    ck = os.path.join(tmpdir_path, "ck")

    def run(name):
        out = os.path.join(tmpdir_path, name)
        logs = spark.readStream.schema(AUDIT_LOG).json(d)
        counts = refresh.stream_audit_counts(logs, watermark="1 hour", window="1 day")
        q = (counts.writeStream.outputMode("update")
             .foreachBatch(lambda b, i: b.write.mode("append").parquet(out))
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(120)
        if not os.path.isdir(out):
            return {}
        return {(str(r.window.start)[:10], r.action): r.n for r in spark.read.parquet(out).collect()}

    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"id": 1, "username": "u", "action": "LOGIN", "timestamp": "2024-01-01T10:00:00Z"}\n'
                '{"id": 2, "username": "u", "action": "LOGIN", "timestamp": "2024-01-03T12:00:00Z"}\n')
    first = run("late_1")
    assert first == {("2024-01-01", "LOGIN"): 1, ("2024-01-03", "LOGIN"): 1}
    # the watermark is now 2024-01-03 11:00: a day-1 event arriving late is dropped,
    # an on-time day-3 event still updates its window
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('{"id": 3, "username": "v", "action": "LOGIN", "timestamp": "2024-01-01T11:00:00Z"}\n'
                '{"id": 4, "username": "v", "action": "LOGIN", "timestamp": "2024-01-03T13:00:00Z"}\n')
    second = run("late_2")
    assert second == {("2024-01-03", "LOGIN"): 2}

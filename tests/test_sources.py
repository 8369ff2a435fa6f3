import os

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.operators import stock
from shelfspark.schemas import SHEET_COLUMNS
from shelfspark.sources import files


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_positional_csv_skip_banner_bom_short_long(spark, tmpdir_path):
    text = ("\ufeffStock sheet,,,\nupdated today,,,\nuni,qty,fba,qty,fbf,qty,sjit,qty\n"
            "SKU-1,\"1,234\",SKU-2,5,,,,\n\nSKU-3,7\nSKU-4,1,SKU-5,2,SKU-6,3,SKU-7,4,extra\n")
    p = os.path.join(tmpdir_path, "sheet.csv")
    _write(p, text.encode("utf-8"))
    df = files.read_positional_csv(spark, p, SHEET_COLUMNS, skip=3, numbered=True)
    rows = [(r.row_no, r.uni, r.uni_stock, r.fba, r.sjit_stock) for r in df.orderBy("row_no").collect()]
    assert rows == [(1, "SKU-1", "1,234", "SKU-2", None), (2, "SKU-3", "7", None, None),
                    (3, "SKU-4", "1", "SKU-5", "4")]
    merged = {r.master_sku: r.uniware_stock for r in stock.channel_stock(df).collect()}
    assert merged["SKU-1"] == 0 and merged["SKU-3"] == 7


def test_skip_per_file(spark, tmpdir_path):
    for i in range(3):
        _write(os.path.join(tmpdir_path, f"s{i}.csv"), ("h1\nh2\nh3\n" + "".join(
            f"K{i}-{j},{j}\n" for j in range(5))).encode())
    df = files.read_positional_csv(spark, tmpdir_path, ["uni", "uni_stock"], skip=3)
    assert df.count() == 15
    assert df.filter("uni like 'h%'").count() == 0


def test_latin1_fallback(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "a.csv"), "Master SKU,Category\nSKU-1,Café\n".encode("latin-1"))
    _write(os.path.join(tmpdir_path, "b.csv"), "Master SKU,Category\nSKU-2,Thé\n".encode("utf-8"))
    df = files.read_text_csv(spark, tmpdir_path)
    got = {r["Master SKU"]: r["Category"] for r in df.collect()}
    assert got == {"SKU-1": "Café", "SKU-2": "Thé"}


def test_header_below_marker(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "items.csv")
    _write(p, b"Export of items\n\nMaster SKU,Size,Category\nSKU-1,M,A\nSKU-2,L,\"B, C\"\n")
    df = files.read_below_marker(spark, p, "Master SKU", numbered=True)
    got = [(r.row_no, r["Master SKU"], r.Category) for r in df.orderBy("row_no").collect()]
    assert got == [(1, "SKU-1", "A"), (2, "SKU-2", "B, C")]


def test_split_lines_without_quotes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    _write(p, b"banner\nheader\nSKU-1,\"1,234\",SKU-2,5\n\nSKU-3,7\n")
    df = files.read_split_lines(spark, p, ["uni", "uni_stock", "fba", "fba_stock"], skip=2)
    got = [(r.uni, r.uni_stock, r.fba, r._cells) for r in df.orderBy("_mid").collect()]
    assert got == [("SKU-1", '"1', '234"', 5), ("SKU-3", "7", None, 2)]


def test_read_entity_missing_is_typed_empty(spark, tmpdir_path):
    from shelfspark.schemas import AUDIT_LOG
    df = files.read_entity(spark, os.path.join(tmpdir_path, "nope.json"), AUDIT_LOG, fmt="json")
    assert df.count() == 0 and df.schema == AUDIT_LOG


def test_json_array_users(spark, tmpdir_path):
    from shelfspark.schemas import USER
    p = os.path.join(tmpdir_path, "users.json")
    _write(p, b'[{"id": 1, "username": "ana", "role": "admin", "allowed_pages": ["item_master"],'
              b' "is_active": true},'
              b' {"id": 2, "username": "raj", "role": "viewer", "allowed_pages": [],'
              b' "column_permissions": {"item_master": {"visible": ["sku_code"], "editable": []}},'
              b' "is_active": false}]')
    df = files.read_json_array(spark, p, USER)
    rows = {r.username: r for r in df.collect()}
    assert rows["raj"].column_permissions["item_master"].visible == ["sku_code"]
    assert rows["ana"].is_active is True


def test_list_tables(spark, tmpdir_path):
    spark.range(1).write.parquet(os.path.join(tmpdir_path, "t1"))
    spark.range(1).write.parquet(os.path.join(tmpdir_path, "t2"))
    assert [r.name for r in files.list_tables(spark, tmpdir_path).collect()] == ["t1", "t2"]


def test_positional_with_header_marker(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "items.csv")
    _write(p, b"junk line\nMaster SKU,Size\nSKU-1,M\n")
    df = files.read_positional_csv(spark, p, header_marker="Master SKU", numbered=True)
    assert [(r.row_no, r["Master SKU"], r.Size) for r in df.collect()] == [(1, "SKU-1", "M")]


def test_skip_when_files_share_a_partition(spark, tmpdir_path):
    for i in range(4):
        _write(os.path.join(tmpdir_path, f"p{i}.csv"), ("b1\nb2\n" + "".join(
            f"F{i}-{j},{j}\n" for j in range(3))).encode())
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        raw = spark.read.schema("uni string, uni_stock string").csv(tmpdir_path)
        assert raw.rdd.getNumPartitions() == 1  # all four files packed into one task
        df = files.read_positional_csv(spark, tmpdir_path, ["uni", "uni_stock"], skip=2, numbered=True)
        got = sorted(r.uni for r in df.collect())
        assert got == sorted(f"F{i}-{j}" for i in range(4) for j in range(3))
        # numbering follows (file, position): each file's rows are consecutive and in order
        rows = sorted((r.row_no, r.uni) for r in df.collect())
        for k in range(0, 12, 3):
            block = [u for _, u in rows[k:k + 3]]
            assert [u.split("-")[1] for u in block] == ["0", "1", "2"]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_files_with_other_headers_raise(spark, tmpdir_path):
    import pytest
    _write(os.path.join(tmpdir_path, "a.csv"), b"Master SKU,Cost\nA,1\n")
    _write(os.path.join(tmpdir_path, "b.csv"), b"Cost,Master SKU\n1,A\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_text_csv(spark, tmpdir_path).collect()


def test_marker_missing_or_headers_differ(spark, tmpdir_path):
    import pytest
    _write(os.path.join(tmpdir_path, "a.csv"), b"x\nMaster SKU,Size\nS1,M\n")
    _write(os.path.join(tmpdir_path, "b.csv"), b"nothing\nS2,L\n")
    with pytest.raises(ValueError, match="b.csv"):
        files.read_below_marker(spark, tmpdir_path, "Master SKU")
    _write(os.path.join(tmpdir_path, "b.csv"), b"Size,Master SKU\nL,S2\n")
    with pytest.raises(ValueError, match="differ"):
        files.read_below_marker(spark, tmpdir_path, "Master SKU")


def test_json_in_file_order(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "a.json"), b'[{"id": 9}, {"id": 2}, {"id": 5}]')
    df = files.read_json_array(spark, os.path.join(tmpdir_path, "a.json"), StructType().add("id", "long"))
    assert [r.id for r in df.orderBy("row_no").collect()] == [9, 2, 5]
    _write(os.path.join(tmpdir_path, "b.json"), b'{"id": 4}\n{"id": 1}\n')
    df = files.read_json_array(spark, os.path.join(tmpdir_path, "b.json"), df.select("id").schema, lines=True)
    assert [(r.row_no, r.id) for r in df.orderBy("row_no").collect()] == [(1, 4), (2, 1)]


def test_encoding_is_decided_per_file(spark, tmpdir_path):
    # the bytes of one file are all UTF-8; in the other one cell is not, so its valid-looking cells are Latin-1 too
    _write(os.path.join(tmpdir_path, "a.csv"), "Master SKU,Size\nA,é\n".encode())
    _write(os.path.join(tmpdir_path, "b.csv"), b"Master SKU,Size\nB,\xc3\xa9\nC,\xe9\n")
    want = [("A", "é"), ("B", "Ã©"), ("C", "é")]
    assert sorted((r["Master SKU"], r["Size"]) for r in files.read_text_csv(spark, tmpdir_path).collect()) == want
    marked = files.read_below_marker(spark, tmpdir_path, "Master SKU")
    assert sorted((r["Master SKU"], r["Size"]) for r in marked.collect()) == want
    split = files.read_split_lines(spark, tmpdir_path, ["k", "s"], skip=1)
    assert sorted((r.k, r.s) for r in split.collect()) == want


def test_many_files_that_are_not_utf8(spark, tmpdir_path, monkeypatch):
    for i in range(4):
        _write(os.path.join(tmpdir_path, f"{i}.csv"), b"Master SKU,Size\n%d,\xe9\n" % i if i else "Master SKU,Size\n0,é\n".encode())
    monkeypatch.setattr(files, "MANY_FILES", 1)
    rows = files.read_text_csv(spark, tmpdir_path).collect()
    assert sorted((r["Master SKU"], r["Size"]) for r in rows) == [(str(i), "é") for i in range(4)]


def test_inputs_without_rows_or_key_raise(spark, tmpdir_path):
    import pytest
    from shelfspark.sources import entities
    for name, body in (("a", b"Master SKU,Size,Action\n"), ("b", b"Size,Cost\nM,1\n")):
        p = os.path.join(tmpdir_path, name + ".csv")
        _write(p, body)
        for read in (entities.read_item_master, entities.read_catalog, entities.read_action_file):
            with pytest.raises(ValueError):
                read(spark, p)


def test_action_files_of_any_width(spark, tmpdir_path):
    from shelfspark.streaming import refresh
    wide = ",".join(f"x{i}" for i in range(90))
    _write(os.path.join(tmpdir_path, "a.csv"), f"{wide},Master SKU,Action\n\n{wide},SKU-1,add\n".encode())
    _write(os.path.join(tmpdir_path, "b.csv"), "Action,\"Master SKU\"\ndelete,\"SKU,2\"\n".encode())
    lines = spark.read.text(tmpdir_path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                                F.col("_metadata.file_modification_time").alias("_mtime"), F.monotonically_increasing_id().alias("_mid"))
    rows = refresh.labelled_lines(lines).collect()
    assert sorted((r.master_sku, r.action) for r in rows) == [("SKU,2", "delete"), ("SKU-1", "add")]


def test_json_list_held_as_text(spark):
    from shelfspark.functions.scalars import json_list
    df = spark.createDataFrame([('["a", "b"]',), ("[]",), ("oops",), (None,)], "t string")
    assert [r[0] for r in df.select(json_list("t")).collect()] == [["a", "b"], [], None, None]


def test_row_numbers_need_no_shuffle(spark, tmpdir_path):
    """Rows of a scan are numbered where they are; rows dealt out anew still by their place in the files."""
    for name, n in (("b", 70), ("a", 3), ("c", 0), ("d", 200)):
        os.makedirs(os.path.join(tmpdir_path, "in"), exist_ok=True)
        with open(os.path.join(tmpdir_path, "in", name + ".csv"), "w") as f:
            f.write("".join(f"{name}{i},x\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = files.read_positional_csv(spark, os.path.join(tmpdir_path, "in"), ["k", "v"], skip=2)
        expected = [f"{name}{i}" for name, n in (("a", 3), ("b", 70), ("d", 200)) for i in range(2, n)]
        for rows in (read, read.repartition(5, "k")):
            got = sorted((r.row_no, r.k) for r in files.add_row_numbers(rows).collect())
            assert got == list(enumerate(expected, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

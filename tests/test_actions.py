"""apply_actions (set-based fold) against a row-at-a-time simulation of the
ordered action file, on random files with many keys and case variants."""

import random
import re

import pytest

from shelfspark.operators.actions import apply_actions, error_details, import_items
from shelfspark.schemas import LEGACY_ITEM

_DEC = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")

ACT_COLS = ["row_no", "master_sku", "item_name", "size", "category", "location", "cost", "price", "catalog",
            "mrp", "updated", "action"]
ACT_SCHEMA = "row_no long, " + ", ".join(f"{c} string" for c in ACT_COLS[1:])
CAT_SCHEMA = ("master_sku string, launch_date string, catalog_name string, cost double, wholesale_price double, "
              "up_price double, mrp double")


def fnum(v):
    v = (v or "").strip()
    return float(v) if _DEC.match(v) else 0.0


def simulate(items, catalog, actions, price_map="parity"):
    items = [dict(it) for it in items]
    catalog = {k: dict(v) for k, v in catalog.items()}
    counts = {"added": 0, "replaced": 0, "deleted": 0, "errors": 0}
    errors = []
    for r in actions:
        act = (r["action"] or "").strip().lower()
        if not act:
            continue
        sku = (r["master_sku"] or "").strip()
        if not sku:
            counts["errors"] += 1
            errors.append(r["row_no"])
            continue
        k = sku.upper()
        g = lambda c: (r[c] or "").strip()
        pay = {"style": g("item_name"), "size": g("size"), "category": g("category"), "loc": g("location")}
        cpay = {"launch_date": g("updated"), "catalog_name": g("catalog"), "cost": fnum(r["cost"]),
                "wholesale_price": fnum(r["price"])}
        if price_map == "parity":
            cpay["up_price"] = fnum(r["mrp"])
        else:
            cpay["mrp"] = fnum(r["mrp"])

        def upsert_cat():
            if k in catalog:
                catalog[k].update(cpay)
            else:
                row = {"launch_date": None, "catalog_name": None, "cost": 0.0, "wholesale_price": 0.0,
                       "up_price": 0.0, "mrp": 0.0}
                row.update(cpay)
                catalog[k] = row
        if act == "add":
            items.append({"src": 1, "src_row": r["row_no"], "master_sku": sku, **pay})
            upsert_cat()
            counts["added"] += 1
        elif act == "replace":
            for it in items:
                if (it["master_sku"] or "").strip().upper() == k:
                    it.update(pay)
            upsert_cat()
            counts["replaced"] += 1
        elif act == "delete":
            items = [it for it in items if (it["master_sku"] or "").strip().upper() != k]
            catalog.pop(k, None)
            counts["deleted"] += 1
        else:
            counts["errors"] += 1
            errors.append(r["row_no"])
    return items, catalog, counts, errors


def random_case(seed, n_rows=400, n_keys=30):
    rnd = random.Random(seed)
    keys = [f"sku-{i}" for i in range(n_keys)]
    variants = lambda k: rnd.choice([k, k.upper(), f" {k} ", k.capitalize()])
    items = []
    for i in range(60):
        k = rnd.choice(keys)
        items.append({"src": 0, "src_row": i + 1, "master_sku": variants(k), "style": f"s{i}", "size": "M",
                      "category": rnd.choice(["A", "B", None]), "loc": "L"})
    catalog = {}
    for k in rnd.sample(keys, n_keys // 2):
        catalog[k.upper()] = {"launch_date": "d0", "catalog_name": "c0", "cost": 1.0, "wholesale_price": 2.0,
                              "up_price": 3.0, "mrp": float(rnd.randint(1, 9))}
    actions = []
    for i in range(n_rows):
        act = rnd.choice([" Add ", "add", "replace", "REPLACE", "delete", "", "", "merge"])
        sku = rnd.choice([variants(rnd.choice(keys)), variants(rnd.choice(keys)), "", "  "])
        actions.append({"row_no": i + 1, "master_sku": sku, "item_name": f"n{i}", "size": rnd.choice(["S", "L"]),
                        "category": rnd.choice(["A", "C"]), "location": "X", "cost": rnd.choice(["1.5", "x", ""]),
                        "price": str(i), "catalog": f"cat{i}", "mrp": rnd.choice(["9", "n/a"]),
                        "updated": "2024-01-01", "action": act})
    return items, catalog, actions


@pytest.mark.parametrize("seed,price_map", [(1, "parity"), (2, "parity"), (3, "fixed")])
def test_apply_actions_matches_sequential(spark, seed, price_map):
    items, catalog, actions = random_case(seed)
    items_df = spark.createDataFrame(
        [(it["src_row"], it["master_sku"], it["style"], it["size"], it["category"], it["loc"]) for it in items],
        "row_no long, master_sku string, style string, size string, category string, loc string")
    cat_df = spark.createDataFrame([(k, *v.values()) for k, v in catalog.items()], CAT_SCHEMA)
    act_df = spark.createDataFrame([tuple(a[c] for c in ACT_COLS) for a in actions], ACT_SCHEMA)
    res = apply_actions(items_df, cat_df, act_df, price_map=price_map)
    exp_items, exp_cat, exp_counts, exp_errors = simulate(items, catalog, actions, price_map)

    got_items = sorted((r.src, r.src_row, r.master_sku, r.style, r.size, r.category, r.loc)
                       for r in res.items.collect())
    want_items = sorted((it["src"], it["src_row"], it["master_sku"], it["style"], it["size"],
                         it["category"], it["loc"]) for it in exp_items)
    assert got_items == want_items

    got_cat = {r.master_sku: (r.launch_date, r.catalog_name, r.cost, r.wholesale_price, r.up_price, r.mrp)
               for r in res.catalog.collect()}
    want_cat = {k: (v["launch_date"], v["catalog_name"], v["cost"], v["wholesale_price"], v["up_price"], v["mrp"])
                for k, v in exp_cat.items()}
    assert got_cat == want_cat

    s = res.summary.first()
    assert (s.added, s.replaced, s.deleted, s.errors) == (
        exp_counts["added"], exp_counts["replaced"], exp_counts["deleted"], exp_counts["errors"])
    assert s.total == s.added + s.replaced + s.deleted
    assert sorted(r.row_no for r in res.errors.collect()) == exp_errors  # all of them
    assert [r.row_no for r in error_details(res.errors).collect()] == exp_errors[:20]  # as the page lists them


def test_error_messages(spark):
    act = spark.createDataFrame([
        (1, " ", "", "", "", "", "", "", "", "", "", "add"),
        (2, "SKU-1", "", "", "", "", "", "", "", "", "", "Merge"),
        (3, "SKU-1", "", "", "", "", "", "", "", "", "", ""),
    ], ACT_SCHEMA)
    items = spark.createDataFrame([], "row_no long, master_sku string, style string, size string, category string, loc string")
    cat = spark.createDataFrame([], CAT_SCHEMA)
    res = apply_actions(items, cat, act)
    msgs = [r.message for r in res.errors.collect()]
    assert msgs == ["Row 1: missing Master SKU, skipped.", "Row 2 (SKU: SKU-1): unknown action 'merge'."]


def test_import_items_counts(spark):
    target = spark.createDataFrame(
        [("A", "Active", "old", "", "", "", 1, 1, "", 1, 0, 0, 0, 0, "", "x")], LEGACY_ITEM)
    rows = spark.createDataFrame([
        (1, "A", "new-a", "12.7", 14), (2, "B", "b1", "3", 14), (3, "B", "b2", "4", 14),
        (4, " ", "skip", "1", 14), (5, "C", "short", "1", 1), (6, "a", "lower", "1", 14),
    ], "row_no long, master_sku string, style string, cost string, n_fields int")
    table, summary = import_items(target, rows, "2024-01-02 03:04:05")
    s = summary.first()
    assert (s.new_rows, s.updated_rows, s.skipped) == (2, 2, 2)
    got = {r.sku_code: (r.item_name, r.cost, r.import_batch) for r in table.collect()}
    assert got == {"A": ("new-a", 12, "20240102_030405"), "B": ("b2", 4, "20240102_030405"),
                   "a": ("lower", 1, "20240102_030405")}
    stamps = {r.sku_code: r.updated_at for r in table.collect()}
    assert stamps == {"A": "2024-01-02 03:04:05", "B": "2024-01-02 03:04:05", "a": None}


def test_cells_are_parsed_once_per_key(spark):
    """The fold keeps the cells as they are: no cell is parsed for every row of the file."""
    from shelfspark.operators.actions import _payloads
    rows = spark.createDataFrame([(1, "A", "A", "add", *"abcdefghi")], "row_no long, k string, sku string, status string, " + ", ".join(f"{c} string" for c in (
        "item_name", "size", "category", "location", "updated", "catalog", "cost", "price", "mrp")))
    got = _payloads(rows).first()
    assert tuple(got.ip) == tuple("abcd") and tuple(got.cp) == tuple("efghi")

"""DuckDB SQL that computes the same results as the registered Spark queries.

Each statement defines the entity views over the generated tables in its own
WITH clause (the only pre-registered views are the base tables), so the text
runs as one statement. Helpers below emit the SQL of the scalar rules.
"""

from __future__ import annotations


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ck(x: str) -> str:
    return f"upper({strip(x)})"


def lint(x: str) -> str:
    """Lenient integer: plain signed digits, else 0."""
    s = strip(x)
    return f"coalesce(case when regexp_full_match({s}, '[+-]?[0-9]+') then try_cast({s} as bigint) end, 0)"


def lfloat(x: str) -> str:
    """Lenient double: plain decimal notation, else 0.0."""
    s = strip(f"cast({x} as varchar)")
    pat = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"coalesce(case when regexp_full_match({s}, '{pat}') then try_cast({s} as double) end, cast(0.0 as double))"


def safe_int(x: str) -> str:
    s = strip(x)
    pat = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (f"(case when coalesce({s}, '') = '' then cast(0 as bigint) "
            f"else coalesce(try_cast(trunc(case when regexp_full_match({s}, '{pat}') then try_cast({s} as double) end) as bigint), 0) end)")


D0 = "cast(0.0 as double)"

V_ITEM_MASTER = """v_item_master as (
  select p_partkey as row_no,
    concat(case when p_partkey % 7 = 0 then '  ' else '' end,
           case when p_partkey % 5 = 0 then 'sku-' else 'SKU-' end,
           cast(p_partkey - (case when p_partkey % 20 = 19 then 1 else 0 end) as varchar)) as master_sku,
    p_name as style, p_size as size,
    case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then '' else p_type end as category,
    p_brand as loc
  from part)"""

V_STOCK_SHEET = """v_stock_sheet as (
  select l_orderkey, l_linenumber,
    case when l_orderkey % 101 = 0 then 'paste here :-' when l_orderkey % 103 = 0 then 'UNI'
         when l_linenumber = 7 then null else concat(' sku-', cast(l_partkey as varchar)) end as uni,
    case when l_orderkey % 17 = 0 then 'n/a' when l_orderkey % 19 = 0 then '1,234'
         else cast(cast(l_quantity as bigint) as varchar) end as uni_stock,
    case when l_linenumber in (1,2,7) then concat('SKU-', cast(l_partkey + 3 as varchar)) end as fba,
    cast(l_linenumber * 2 as varchar) as fba_stock,
    case when l_linenumber in (3,4) then concat('SKU-', cast(l_partkey * 2 as varchar)) else '' end as fbf,
    cast(l_linenumber * 3 as varchar) as fbf_stock,
    case when l_linenumber = 5 then concat('Sku-', cast(l_suppkey as varchar)) end as sjit,
    cast(l_linenumber as varchar) as sjit_stock,
    l_partkey, l_suppkey, l_quantity, l_shipdate
  from lineitem)"""

V_CATALOG = """v_catalog as (
  select p_partkey as row_no,
    case when p_partkey % 3 = 0 then concat('OLD-', cast(p_partkey as varchar))
         else concat('SKU-', cast(p_partkey - (p_partkey % 2) as varchar)) end as master_sku,
    concat('Catalog ', p_brand) as catalog_name,
    case when p_partkey % 23 = 0 then 'Pending' when p_partkey % 29 = 0 then '.'
         else cast(cast(p_size as bigint) * 10 as varchar) end as cost,
    p_retailprice as mrp
  from part)"""

V_ACTIONS = """v_actions as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    case when l_suppkey % 37 = 0 then ' ' else concat('SKU-', cast(l_partkey as varchar)) end as master_sku,
    concat('Style ', cast(l_suppkey as varchar)) as item_name,
    cast(l_linenumber as varchar) as size,
    l_returnflag as category, l_linestatus as location,
    cast(l_quantity as varchar) as cost, cast(l_extendedprice as varchar) as price,
    concat('Catalog ', cast(l_suppkey as varchar)) as catalog,
    case when l_linenumber = 6 then 'n/a' else cast(l_tax * 100 as varchar) end as mrp,
    strftime(l_shipdate, '%Y-%m-%d') as updated,
    case when l_linenumber = 1 then ' Add ' when l_linenumber = 2 then 'replace'
         when l_linenumber = 3 then 'DELETE' when l_linenumber = 4 then 'merge' else '' end as action
  from lineitem)"""

V_AUDIT = """v_audit as (
  select event_id as id, concat('User', cast(user_id as varchar)) as username,
    upper(event_type) as action, ts, value from events)"""


def lint_thousands(x: str) -> str:
    s = f"replace({strip(x)}, ',', '')"
    return f"coalesce(case when regexp_full_match({s}, '[+-]?[0-9]+') then try_cast({s} as bigint) end, 0)"


def _channel_stock_body(sheet: str = "v_stock_sheet", upper: bool = True, by: str = "",
                        drop_first_null: bool = True, thousands: bool = False) -> str:
    key = ck if upper else strip
    num = lint_thousands if thousands else lint
    by_sel = f"{by}, " if by else ""
    parts = []
    for ch, sku, qty in (("uni", "uni", "uni_stock"), ("fba", "fba", "fba_stock"),
                         ("fbf", "fbf", "fbf_stock"), ("sjit", "sjit", "sjit_stock")):
        parts.append(f"select {by_sel}'{ch}' as ch, {key(sku)} as sku, {num(qty)} as qty from _s")
    union = "\n    union all ".join(parts)
    where = "where uni is not null" if drop_first_null else ""
    return f"""_s as (select * from {sheet} {where}),
  _p as ({union}),
  _cs as (
    select {by_sel}sku as master_sku,
      cast(coalesce(sum(case when ch = 'uni' then qty end), 0) as bigint) as uniware_stock,
      cast(coalesce(sum(case when ch = 'fba' then qty end), 0) as bigint) as fba_stock,
      cast(coalesce(sum(case when ch = 'fbf' then qty end), 0) as bigint) as fbf_stock,
      cast(coalesce(sum(case when ch = 'sjit' then qty end), 0) as bigint) as sjit_stock
    from _p where sku is not null and sku <> '' and lower(sku) not in ('uni', 'paste here :-')
    group by {by_sel}sku)"""


ITEM = f"""_item as (
  select row_no, {ck('master_sku')} as sku_code, style as item_name, cast(size as varchar) as size,
    category, loc as location from v_item_master)"""

CATALOG_LAST = f"""_cat as (
  select master_sku, cast(null as varchar) as launch_date, catalog_name, cost,
    {D0} as wholesale_price, {D0} as up_price, mrp
  from (
    select {ck('master_sku')} as master_sku, catalog_name, {lfloat('cost')} as cost, {lfloat('mrp')} as mrp,
      row_number() over (partition by {ck('master_sku')} order by row_no desc) as _rn
    from v_catalog where {ck('master_sku')} is not null and {ck('master_sku')} <> '')
  where _rn = 1)"""


def _dashboard(priced: bool) -> str:
    if priced:
        join_cat = "left join _cat c on c.master_sku = i.sku_code"
        prices = (f"coalesce(c.cost, {D0}) as cost, coalesce(c.wholesale_price, {D0}) as price, "
                  f"coalesce(c.catalog_name, '') as catalog, coalesce(c.mrp, {D0}) as mrp, "
                  f"coalesce(c.up_price, {D0}) as up_price")
        updated = "coalesce(c.launch_date, '') as updated"
    else:
        join_cat = ""
        prices = f"{D0} as cost, {D0} as price, '' as catalog, {D0} as mrp, {D0} as up_price"
        updated = "'' as updated"
    return f"""_dash as (
  select cast(row_number() over (order by i.row_no) as bigint) as id, i.sku_code, i.item_name, i.size,
    i.category, i.location, {prices},
    coalesce(s.uniware_stock, 0) as available_atp, coalesce(s.fba_stock, 0) as fba_stock,
    coalesce(s.fbf_stock, 0) as fbf_stock, coalesce(s.sjit_stock, 0) as sjit_stock, {updated}
  from _item i left join _cs s on s.master_sku = i.sku_code {join_cat})"""


def with_views(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


DASH_COLS = ("id, sku_code, item_name, size, category, location, cost, price, catalog, mrp, up_price, "
             "available_atp, fba_stock, fbf_stock, sjit_stock, updated")

DASHBOARD_BASE = with_views(V_ITEM_MASTER, V_STOCK_SHEET, _channel_stock_body(), ITEM, _dashboard(False))
DASHBOARD_PRICED_BASE = with_views(V_ITEM_MASTER, V_STOCK_SHEET, V_CATALOG, _channel_stock_body(), ITEM,
                                   CATALOG_LAST, _dashboard(True))


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["channel_stock"] = with_views(V_STOCK_SHEET, _channel_stock_body()) + "select * from _cs"

    q["clean_stock"] = with_views(V_STOCK_SHEET) + f"""
select l_orderkey, l_linenumber,
  {ck('uni')} as uni, {lint('uni_stock')} as uni_stock, {ck('fba')} as fba, {lint('fba_stock')} as fba_stock,
  {ck('fbf')} as fbf, {lint('fbf_stock')} as fbf_stock, {ck('sjit')} as sjit, {lint('sjit_stock')} as sjit_stock,
  l_partkey, l_suppkey, l_quantity, l_shipdate
from v_stock_sheet where uni is not null"""

    q["dashboard"] = DASHBOARD_BASE + f"select {DASH_COLS} from _dash"

    q["dashboard_priced"] = DASHBOARD_PRICED_BASE + f"select {DASH_COLS} from _dash"

    q["kpi"] = DASHBOARD_BASE + """
select count(*) as total_skus, cast(sum(available_atp) as bigint) as total_stock,
  cast(sum(available_atp) as bigint) as total_available, cast(sum(fba_stock) as bigint) as total_fba,
  cast(sum(sjit_stock) as bigint) as total_sjit, cast(sum(fbf_stock) as bigint) as total_fbf
from _dash"""

    q["duplicates"] = with_views(V_ITEM_MASTER) + f"""
select {ck('master_sku')} as master_sku, count(*) as cnt from v_item_master
group by 1 having count(*) > 1"""

    q["items_page"] = DASHBOARD_BASE + f"""
select {DASH_COLS} from _dash where contains(lower(coalesce(category, '')), 'econ')
order by cast(available_atp as double) desc, id asc limit 50 offset 50"""

    q["orphan_stock"] = with_views(V_ITEM_MASTER, V_STOCK_SHEET, _channel_stock_body(), ITEM) + """
select * from _cs s where not exists (select 1 from _item i where i.sku_code = s.master_sku)"""

    q["catalog_last"] = with_views(V_CATALOG, CATALOG_LAST) + "select * from _cat"

    q["action_counts"] = with_views(V_ACTIONS) + f"""
select lower({strip('action')}) as action, count(*) as n from v_actions group by 1"""

    q["audit_counts"] = with_views(V_AUDIT) + """
select action, count(*) as n from v_audit where contains(lower(username), 'user1') group by action"""

    q["batch_dashboard"] = with_views(
        V_ITEM_MASTER, V_STOCK_SHEET, _channel_stock_body(upper=False)) + f"""
select i.row_no, '' as updated, {strip('i.master_sku')} as sku_code, i.style as item_name,
  cast(i.size as varchar) as size, i.category, i.loc as location, '' as catalog,
  {D0} as cost, {D0} as price, {D0} as up_price, {D0} as mrp,
  coalesce(s.uniware_stock, 0) as available_atp, coalesce(s.fba_stock, 0) as fba_stock,
  coalesce(s.fbf_stock, 0) as fbf_stock, coalesce(s.sjit_stock, 0) as sjit_stock
from v_item_master i left join _cs s on s.master_sku = {strip('i.master_sku')}"""

    from shelfspark.plans.oracle_more import more_sql
    q.update(more_sql())
    return q

"""Oracle SQL for the action import, legacy import, upserts, overlay, item
and log queries, views and quality reports (see ``plans.oracle``)."""

from __future__ import annotations

from shelfspark.schemas import DASHBOARD_COLUMNS
from shelfspark.plans.oracle import (CATALOG_LAST, D0, DASH_COLS, DASHBOARD_BASE, DASHBOARD_PRICED_BASE, ITEM,
                                     V_ACTIONS, V_AUDIT, V_CATALOG, V_ITEM_MASTER, V_STOCK_SHEET,
                                     _channel_stock_body, _dashboard, ck, lfloat, lint, safe_int, strip,
                                     with_views)

ACTIONS_NUMBERED = f"""_a as (
  select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as row_no, *
  from v_actions),
_c as (
  select row_no, act, sku, upper(sku) as k, item_name, size, category, location, cost, price, catalog, mrp, updated,
    case when sku = '' then 'missing_sku' when act in ('add', 'replace', 'delete') then act else 'unknown' end as status
  from (select *, lower(coalesce({strip('action')}, '')) as act, coalesce({strip('master_sku')}, '') as sku from _a)
  where act <> ''),
_v as (
  select row_no, k, sku, status,
    coalesce({strip('item_name')}, '') as style, coalesce({strip('size')}, '') as size,
    coalesce({strip('category')}, '') as category, coalesce({strip('location')}, '') as loc,
    coalesce({strip('updated')}, '') as launch_date, coalesce({strip('catalog')}, '') as catalog_name,
    {lfloat('cost')} as cost, {lfloat('price')} as wholesale_price, {lfloat('mrp')} as up_price
  from _c where status in ('add', 'replace', 'delete')),
_f as (
  select k, coalesce(max(case when status = 'delete' then row_no end), 0) as D,
    max(case when status = 'replace' then row_no end) as R,
    max(case when status in ('add', 'replace') then row_no end) as U
  from _v group by k)"""

REASON = ("case when status = 'missing_sku' then 'missing Master SKU, skipped.' "
          "else concat('unknown action ', chr(39), act, chr(39), '.') end")


def _action_sql() -> dict[str, str]:
    base = with_views(V_ITEM_MASTER, V_CATALOG, V_ACTIONS, CATALOG_LAST, ACTIONS_NUMBERED)
    q = {}
    pay = ["style", "size", "category", "loc"]
    old_cols = ", ".join(
        f"case when f.R is not null then r.{c} else cast(i.{c} as varchar) end as {c}" for c in pay)
    new_cols = ", ".join(
        f"case when coalesce(f.R, 0) > a.row_no then r.{c} else a.{c} end as {c}" for c in pay)
    q["actions_items"] = base + f"""
select 0 as src, i.row_no as src_row, i.master_sku, {old_cols}
from v_item_master i left join _f f on f.k = {ck('i.master_sku')} left join _v r on r.row_no = f.R
where coalesce(f.D, 0) = 0
union all
select 1 as src, a.row_no as src_row, a.sku as master_sku, {new_cols}
from _v a join _f f on f.k = a.k left join _v r on r.row_no = f.R
where a.status = 'add' and a.row_no > f.D"""
    has_up = "(f.U is not null and f.U > coalesce(f.D, 0))"
    kept_old = "(o.master_sku is not null and coalesce(f.D, 0) = 0)"
    cols = [f"case when {has_up} then u.{c} else o.{c} end as {c}"
            for c in ["launch_date", "catalog_name", "cost", "wholesale_price", "up_price"]]
    cols.append(f"case when {has_up} then (case when {kept_old} then o.mrp else {D0} end) else o.mrp end as mrp")
    q["actions_catalog"] = base + f"""
select coalesce(o.master_sku, f.k) as master_sku, {', '.join(cols)}
from _cat o full join _f f on f.k = o.master_sku left join _v u on u.row_no = f.U
where {has_up} or (coalesce(f.D, 0) = 0 and o.master_sku is not null)"""
    q["actions_summary"] = base + """
select cast(sum(case when status in ('add', 'replace', 'delete') then 1 else 0 end) as bigint) as total,
  cast(sum(case when status = 'add' then 1 else 0 end) as bigint) as added,
  cast(sum(case when status = 'replace' then 1 else 0 end) as bigint) as replaced,
  cast(sum(case when status = 'delete' then 1 else 0 end) as bigint) as deleted,
  cast(sum(case when status not in ('add', 'replace', 'delete') then 1 else 0 end) as bigint) as errors
from _c"""
    q["actions_errors_all"] = base + f"""
select row_no, sku, status,
  case when sku = '' then concat('Row ', cast(row_no as varchar), ': ', {REASON})
       else concat('Row ', cast(row_no as varchar), ' (SKU: ', sku, '): ', {REASON}) end as message
from _c where status not in ('add', 'replace', 'delete')"""
    q["actions_errors"] = q["actions_errors_all"] + " order by row_no limit 20"
    return q


V_SELECTION = """v_selection as (
  select p_partkey as row_no,
    concat(case when p_partkey % 7 = 0 then '  ' else '' end,
           case when p_partkey % 5 = 0 then 'sku-' else 'SKU-' end,
           cast(p_partkey - (case when p_partkey % 20 = 19 then 1 else 0 end) as varchar)) as master_sku,
    p_name as style, cast(p_size as varchar) as size,
    case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then '' else p_type end as category,
    p_brand as location, cast(p_retailprice as varchar) as cost, cast(p_size * 7 as varchar) as wholesale_price,
    concat('Catalog ', p_brand) as catalog, cast(p_size * 10 as varchar) as up_price,
    case when p_partkey % 9 = 0 then 'x' else cast(p_size as varchar) end as uniware_stock,
    cast(p_partkey % 4 as varchar) as fba, '' as fbf, cast(null as varchar) as sjit, '' as launch_date,
    case when p_partkey % 97 = 0 then 1 else 14 end as n_fields
  from part)"""

LEGACY = f"""_legacy as (
  select sku_code, status, item_name, size, category, location, cost, price, catalog, mrp,
    available_atp, fba_stock, fbf_stock, sjit_stock, updated, import_batch
  from (
    select master_sku as sku_code, 'Active' as status, 'old' as item_name, '' as size, '' as category, '' as location,
      {safe_int('cost')} as cost, cast(0 as bigint) as price, catalog_name as catalog,
      {safe_int('cast(mrp as varchar)')} as mrp, cast(0 as bigint) as available_atp, cast(0 as bigint) as fba_stock,
      cast(0 as bigint) as fbf_stock, cast(0 as bigint) as sjit_stock, '' as updated,
      '19700101_000000' as import_batch,
      row_number() over (partition by master_sku order by row_no desc) as _rn
    from v_catalog)
  where _rn = 1),
_sel as (
  select row_no, coalesce({strip('master_sku')}, '') as sku_code,
    (n_fields >= 2 and coalesce({strip('master_sku')}, '') <> '') as valid,
    'Active' as status, coalesce({strip('style')}, '') as item_name, coalesce({strip('size')}, '') as size,
    coalesce({strip('category')}, '') as category, coalesce({strip('location')}, '') as location,
    coalesce({strip('catalog')}, '') as catalog, coalesce({strip('launch_date')}, '') as updated,
    {safe_int('cost')} as cost, {safe_int('wholesale_price')} as price, {safe_int('up_price')} as mrp,
    {safe_int('uniware_stock')} as available_atp, {safe_int('fba')} as fba_stock, {safe_int('fbf')} as fbf_stock,
    {safe_int('sjit')} as sjit_stock, '20240102_030405' as import_batch
  from v_selection)"""

LEGACY_COLS = ("status, item_name, size, category, location, cost, price, catalog, mrp, available_atp, "
               "fba_stock, fbf_stock, sjit_stock, updated, import_batch")


def _import_sql() -> dict[str, str]:
    base = with_views(V_CATALOG, V_SELECTION, LEGACY)
    q = {}
    q["import_result"] = base + f"""
, _last as (
  select * from (select *, row_number() over (partition by sku_code order by row_no desc) as _rn,
                        count(*) over (partition by sku_code) as _m
                 from _sel where valid) where _rn = 1)
select sku_code, {LEGACY_COLS},
  case when _m > 1 or exists (select 1 from _legacy l where l.sku_code = s.sku_code)
       then '2024-01-02 03:04:05' end as updated_at
from _last s
union all
select sku_code, {LEGACY_COLS}, cast(null as varchar) as updated_at
from _legacy l where not exists (select 1 from _last s where s.sku_code = l.sku_code)"""
    q["import_summary"] = base + """
, _pk as (select sku_code, count(*) as m from _sel where valid group by sku_code),
_ck as (select p.m, exists (select 1 from _legacy l where l.sku_code = p.sku_code) as ex from _pk p)
select cast(coalesce(sum(case when ex then 0 else 1 end), 0) as bigint) as new_rows,
  cast(coalesce(sum(case when ex then m else m - 1 end), 0) as bigint) as updated_rows,
  (select cast(count(*) as bigint) from _sel where not valid) as skipped
from _ck"""
    return q


def _import_dashboard_sql() -> str:
    """The item rows after both imports, by what happens to each row: an item
    stays if no delete comes after it (of either file; the second file holds
    adds alone), and shows the last replace after it; the catalogue row is the
    last add or replace of either file, if no delete comes after it."""
    return with_views(V_ITEM_MASTER, V_ACTIONS) + f"""
, _n as (select 1 as file, cast(row_number() over (order by {_ACTION_KEYS}) as bigint) as row_no, * from v_actions
  union all
  select 2, cast(row_number() over (order by {_ACTION_KEYS}) as bigint), * from v_actions where l_linenumber = 1),
_e as (
  select file, row_no, upper(coalesce({strip('master_sku')}, '')) as k, lower(coalesce({strip('action')}, '')) as act,
    coalesce({strip('item_name')}, '') as item_name, coalesce({strip('size')}, '') as size, {lfloat('cost')} as cost,
    {lfloat('mrp')} as up_price, coalesce({strip('catalog')}, '') as catalog from _n),
_w as (select * from _e where k <> '' and act in ('add', 'replace', 'delete')),
_rows as (
  select 0 as file, row_no, {ck('master_sku')} as k, style as item_name, cast(size as varchar) as size from v_item_master
  union all select file, row_no, k, item_name, size from _w where act = 'add'),
_last as (
  select k, max((file, row_no)) filter (where act = 'delete') as d, max((file, row_no)) filter (where act = 'replace') as r,
    max((file, row_no)) filter (where act in ('add', 'replace')) as u from _w group by k),
_kept as (
  select i.file, i.row_no, i.k, l.u, l.d, case when l.r > (i.file, i.row_no) then r.item_name else i.item_name end as item_name,
    case when l.r > (i.file, i.row_no) then r.size else i.size end as size
  from _rows i left join _last l on l.k = i.k left join _w r on r.act = 'replace' and (r.file, r.row_no) = l.r
  where l.d is null or l.d < (i.file, i.row_no))
select cast(row_number() over (order by x.file, x.row_no) as bigint) as id, x.k as sku_code, x.item_name, x.size,
  coalesce(c.cost, {D0}) as cost, coalesce(c.up_price, {D0}) as up_price, coalesce(c.catalog, '') as catalog
from _kept x left join _w c on c.act in ('add', 'replace') and (c.file, c.row_no) = x.u and (x.d is null or x.d < x.u)"""


_ACTION_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"

OVERLAY_JUNK_SQL = {"uni": [], "fba": ["uni", "FBA"], "fbf": ["STOCK"], "sjit": ["STOCK"]}
SHEET_ORDER_DESC = "l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc"


def _overlay_sql(views=(V_STOCK_SHEET, V_SELECTION)) -> str:
    ctes = []
    for ch, sku, qty in (("uni", "uni", "uni_stock"), ("fba", "fba", "fba_stock"),
                         ("fbf", "fbf", "fbf_stock"), ("sjit", "sjit", "sjit_stock")):
        k = f"coalesce({strip(sku)}, '')"
        if ch != "uni":
            k = f"replace({k}, chr(34), '')"
        qt = f"coalesce({strip(f'replace(replace({qty}, chr(34), {chr(39)}{chr(39)}), {chr(39)},{chr(39)}, {chr(39)}{chr(39)})')}, '')"
        qv = (f"(case when {qt} = '' then cast(0 as bigint) "
              f"when regexp_full_match({qt}, '[+-]?[0-9]+') then try_cast({qt} as bigint) end)")
        cond = f"{k} <> ''" + "".join(f" and {k} <> '{j}'" for j in OVERLAY_JUNK_SQL[ch])
        ctes.append(f"""_r_{ch} as (select {k} as sku, {qv} as qty, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity from v_stock_sheet where {cond})""")
        if ch == "uni":
            pick = f"""_o_{ch} as (select sku, '{ch}' as ch, coalesce(qty, 0) as v from (
    select *, row_number() over (partition by sku order by {SHEET_ORDER_DESC}) as _rn from _r_{ch}) where _rn = 1)"""
        else:
            pick = f"""_o_{ch} as (select s.sku, '{ch}' as ch, p.v from (select distinct sku from _r_{ch}) s
    left join (select sku, qty as v from (
      select *, row_number() over (partition by sku order by {SHEET_ORDER_DESC}) as _rn
      from _r_{ch} where qty is not null) where _rn = 1) p on p.sku = s.sku)"""
        ctes.append(pick)
    union = " union all ".join(f"select sku, ch, v from _o_{c}" for c in ("uni", "fba", "fbf", "sjit"))
    vals = ", ".join(f"cast(coalesce(max(case when ch = '{c}' then v end), 0) as bigint) as {c}_v"
                     for c in ("uni", "fba", "fbf", "sjit"))
    return with_views(*views, *ctes) + f""", _vals as (select sku, {vals} from ({union}) group by sku)
select s.row_no, s.master_sku, s.style, s.size, s.category, s.location, s.cost, s.wholesale_price, s.catalog,
  s.up_price,
  case when x.sku is not null then cast(x.uni_v as varchar) else s.uniware_stock end as uniware_stock,
  case when x.sku is not null then cast(x.fba_v as varchar) else s.fba end as fba,
  case when x.sku is not null then cast(x.fbf_v as varchar) else s.fbf end as fbf,
  case when x.sku is not null then cast(x.sjit_v as varchar) else s.sjit end as sjit,
  s.launch_date
from v_selection s left join _vals x on x.sku = {strip('s.master_sku')}"""


def _dash_or(c):
    return f"coalesce(cast({c} as varchar), '-') as {c}"


def _money(c):
    return f"case when {c} is null then '-' else concat('Rs ', printf('%.2f', {c})) end as {c}"


def _plain(c):
    return (f"case when {c} is null then '-' when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) "
            f"else cast({c} as varchar) end as {c}")


def _grouped(c):
    return f"case when {c} is null then '-' else format('{{:,}}', {c}) end as {c}"


def more_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q.update(_action_sql())
    q.update(_import_sql())
    cat_split = f"""_cat_rows as (
  select {ck('master_sku')} as master_sku, cast(null as varchar) as launch_date, catalog_name, {lfloat('cost')} as cost,
    {D0} as wholesale_price, {D0} as up_price, {lfloat('mrp')} as mrp, row_no, (row_no % 2 <> 0) as is_new
  from v_catalog where {ck('master_sku')} is not null and {ck('master_sku')} <> '')"""
    q["catalog_sync"] = with_views(V_CATALOG, cat_split) + """
select master_sku, launch_date, catalog_name, cost, wholesale_price, up_price, mrp from (
  select *, row_number() over (partition by master_sku order by is_new desc, row_no desc) as _rn from _cat_rows)
where _rn = 1"""
    snap_sheet = "v_snap as (select *, case when year(l_shipdate) < 1998 then 1 else 2 end as snapshot from v_stock_sheet)"
    snap = with_views(V_STOCK_SHEET, snap_sheet, _channel_stock_body(sheet="v_snap", by="snapshot")) + """
select master_sku, uniware_stock, fba_stock, fbf_stock, sjit_stock from (
  select *, row_number() over (partition by master_sku order by snapshot desc) as _rn from _cs) where _rn = 1"""
    q["stock_upsert"] = snap
    q["refresh_twice"] = snap
    # the dashboard over the folded stock
    folded = with_views(V_ITEM_MASTER, V_STOCK_SHEET, snap_sheet, _channel_stock_body(sheet="v_snap", by="snapshot").replace("_cs as", "_per as"),
                        "_cs as (select * from (select *, row_number() over (partition by master_sku order by snapshot desc) as _rn from _per) where _rn = 1)",
                        ITEM, _dashboard(False))
    q["refresh_dashboard"] = folded + f"select {DASH_COLS} from _dash"
    q["dashboard_page_range"] = folded + f"select {DASH_COLS} from _dash where id between 101 and 400"
    q["dashboard_publish"] = DASHBOARD_BASE + f"select {DASH_COLS} from _dash"
    q["sorted_page"] = DASHBOARD_BASE + f"""select {DASH_COLS} from _dash
order by lower(coalesce(category, '')) desc, id asc limit 100 offset 800"""
    q["user_page_access"] = """select c_custkey as id, c_name as username,
  c_custkey % 50 = 0 or (c_custkey % 7 > 1 and c_mktsegment = 'MACHINERY') as allowed from customer"""
    q["user_columns"] = f"""select c_custkey as id, c_name as username, case when c_custkey % 50 = 0 then 'admin' else 'viewer' end as role,
  case when c_custkey % 50 = 0 then '{", ".join(DASHBOARD_COLUMNS)}' when c_custkey % 3 = 0 then 'sku_code, mrp'
    else '{", ".join(DASHBOARD_COLUMNS[:5])}' end as visible_text from customer"""
    q["admin_kpis"] = """select (select count(*) from customer where c_acctbal > 0) as active_users,
  (select count(*) from events where cast(ts as date) = date '2024-01-02') as logs_today, (select count(*) from orders) as total_imports"""
    q["import_history"] = "select o_orderkey as id, o_orderstatus as status, o_orderpriority as filename from orders order by o_orderkey"
    q["log_changes"] = """select event_id as id, event_id % 3 = 1 and coalesce(props, '') <> '' as has_old,
  event_id % 2 = 0 and coalesce(event_type, '') <> '' as has_new from events"""
    kpi = """select count(*) as total_skus, cast(sum(available_atp) as bigint) as total_stock, cast(sum(available_atp) as bigint) as total_available,
  cast(sum({}) as bigint) as total_fba, cast(sum(sjit_stock) as bigint) as total_sjit, cast(sum(fbf_stock) as bigint) as total_fbf"""
    q["kpi_difference"] = DASHBOARD_BASE + f""", _r as (select d.*, i.row_no from _dash d join (
    select row_no, row_number() over (order by row_no) as id from v_item_master) i using (id))
{kpi.format("fba_stock")}, 'only_first' as side from _r
union all {kpi.format("case when row_no % 10 <> 0 then fba_stock else 0 end")}, 'only_second' from _r"""
    q["update_delete"] = with_views(V_CATALOG, CATALOG_LAST) + """select c.master_sku, coalesce(p.p_name, c.catalog_name) as catalog_name, c.cost
from _cat c left join part p on p.p_partkey % 4 = 0 and c.master_sku = 'SKU-' || p.p_partkey
where not exists (select 1 from part g where g.p_partkey % 10 = 0 and c.master_sku = 'SKU-' || g.p_partkey)"""
    junk_sheet = """v_stock_sheet as (select * replace (case when l_linenumber = 1 then 'uni' else uni end as uni, case when l_linenumber = 2 then 'FBA' else fba end as fba,
    case when l_linenumber = 3 then 'STOCK' else fbf end as fbf, case when l_linenumber = 4 then 'STOCK' else sjit end as sjit) from v_plain_sheet)"""
    junk_items = """v_selection as (select * replace (case when row_no % 5 < 4 then master_sku else (['uni', 'FBA', 'STOCK'])[row_no % 3 + 1] end as master_sku) from v_plain_selection)"""
    q["overlay_stock_junk"] = _overlay_sql(
        (V_STOCK_SHEET.replace("v_stock_sheet", "v_plain_sheet"), junk_sheet, V_SELECTION.replace("v_selection", "v_plain_selection"), junk_items))
    q["sheet_from_csv"] = with_views(V_STOCK_SHEET) + """select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as row_no,
  uni, uni_stock, fba, fba_stock, nullif(fbf, '') as fbf, fbf_stock, sjit, sjit_stock from v_stock_sheet"""
    q["split_lines"] = """select cast(p_partkey as varchar) as p_partkey, '"' || split_part(p_type, ' ', 1) || case when contains(p_type, ' ') then '' else '"' end as t1,
  case when contains(p_type, ' ') then split_part(p_type, ' ', 2) || case when len(string_split(p_type, ' ')) = 2 then '"' else '' end end as t2,
  cast(1 + len(string_split(p_type, ' ')) as integer) as _cells from part"""
    q["load_appends"] = """select cast(row_number() over (order by p_partkey % 2, p_partkey) as bigint) as id,
  cast(p_partkey as varchar) as p_partkey, p_name from part"""
    q["import_dashboard"] = _import_dashboard_sql()
    q["catalog_from_csv"] = with_views(V_CATALOG) + """select master_sku, catalog_name, cost, cast(mrp as varchar) as mrp from v_catalog"""
    q["items_from_marker_file"] = with_views(V_ITEM_MASTER) + """select trim(master_sku) as master_sku, cast(size as varchar) as size, loc
from v_item_master"""
    q["logs_from_json"] = with_views(V_AUDIT) + "select id, username, action from v_audit"
    q["logs_from_array"] = with_views(V_AUDIT) + "select id, username, action, cast(row_number() over (order by id) as bigint) as row_no from v_audit"
    q["logs_by_action"] = with_views(V_AUDIT) + """select id, username, action, ts, value from v_audit
where action = 'CLICK' and contains(lower(username), 'user1') order by id limit 100"""
    q["stock_snapshots"] = snap
    q["channel_stock_join"] = with_views(V_STOCK_SHEET, _channel_stock_body()) + "select * from _cs"
    q["overlay_stock"] = _overlay_sql()
    d = DASHBOARD_BASE
    q["item_search"] = d + f"""select {DASH_COLS} from _dash
where contains(lower(coalesce(sku_code, '')), 'ku-12') or contains(lower(coalesce(item_name, '')), 'ku-12')"""
    q["published_defaults"] = with_views(V_CATALOG, CATALOG_LAST) + f"""select master_sku, cast(null as varchar) as launch_date, catalog_name,
  case when cost > 200 then cost else {D0} end as cost, {D0} as wholesale_price, {D0} as up_price, {D0} as mrp from _cat"""
    q["indexed_search"] = q["item_search"]
    q["merged_profile"] = with_views(V_STOCK_SHEET) + """select 'uni' as column, count(*) as rows, count(*) - count(uni) as nulls, cast(null as bigint) as total from v_stock_sheet
union all select 'fba', count(*), count(*) - count(fba), null from v_stock_sheet
union all select 'l_orderkey', count(*), 0, cast(sum(l_orderkey) as bigint) from v_stock_sheet"""
    gaps = """, _gaps as (select * replace (case when id % 10 = 0 then 0 when id % 10 = 1 then null
  when id % 10 = 2 then -available_atp else available_atp end as available_atp) from _dash)
"""
    q["item_availability_yes"] = d + gaps + f"""select {DASH_COLS} from _gaps
where lower(cast(coalesce(available_atp, 0) as varchar)) = 'yes' or available_atp > 0"""
    q["item_availability_no"] = d + gaps + f"""select {DASH_COLS} from _gaps
where lower(cast(coalesce(available_atp, 0) as varchar)) = 'no' or coalesce(available_atp, 0) <= 0"""
    q["item_prefix"] = d + f"select {DASH_COLS} from _dash where starts_with(lower(sku_code), 'sku-1')"
    q["item_in"] = d + f"select {DASH_COLS} from _dash where sku_code in ('SKU-10', 'SKU-18', 'SKU-400', 'SKU-999999')"
    q["item_lookup"] = d + f"select {DASH_COLS} from _dash where sku_code = 'SKU-18' order by id limit 1"
    q["item_by_id"] = d + f"select {DASH_COLS} from _dash where id = 17"
    q["item_sort_text"] = d + f"""select {DASH_COLS} from _dash
order by lower(coalesce(category, '')) asc, id asc limit 100 offset 200"""
    q["item_sort_numeric"] = d + f"""select {DASH_COLS} from _dash
order by cast(fba_stock as double) desc, id asc limit 200"""
    q["filters_categories"] = d + """select distinct category from _dash
where category is not null and category <> '' order by category"""
    q["log_actions"] = with_views(V_AUDIT) + """select distinct action from v_audit
where action is not null and action <> '' order by action"""
    q["logs_page"] = with_views(V_AUDIT) + """select id, username, action, ts, value from v_audit
where contains(lower(username), 'user2') order by id limit 200 offset 400"""
    q["audit_daily"] = with_views(V_AUDIT) + """select strftime(ts, '%Y-%m-%d') as day, action, count(*) as n
from v_audit group by 1, 2"""
    dp = DASHBOARD_PRICED_BASE
    q["export_view"] = dp + """select sku_code as "Master SKU", item_name as "Style ID / Parent SKU", size as "Size",
  category as "Category", location as "Location", cost as "Cost", price as "Wholesale Price",
  catalog as "Catalog Name", mrp as "MRP", available_atp as "Uniware Stock", fba_stock as "FBA",
  fbf_stock as "FBF", sjit_stock as "SJIT", updated as "Launch Date", '' as "Action" from _dash"""
    q["visible_viewer"] = d + "select id, sku_code, item_name, size, category, location from _dash"
    text_cols = ["sku_code", "item_name", "size", "category", "location", "catalog", "updated"]
    q["display_view"] = dp + "select id, " + ", ".join(
        [_dash_or(c) for c in text_cols] + [_money(c) for c in ("cost", "price", "mrp")] + [_plain("up_price")]
        + [_grouped(c) for c in ("available_atp", "fba_stock", "fbf_stock", "sjit_stock")]
        + ["(coalesce(available_atp, 0) > 0) as in_stock"]) + " from _dash"
    q["reconcile"] = with_views(V_ITEM_MASTER, V_STOCK_SHEET, _channel_stock_body(), ITEM, _dashboard(False)) + f"""
, _clean as (select {lint('uni_stock')} as uni, {lint('fba_stock')} as fba, {lint('fbf_stock')} as fbf,
                    {lint('sjit_stock')} as sjit from v_stock_sheet where uni is not null),
_orph as (select * from _cs s where not exists (select 1 from _item i where i.sku_code = s.master_sku))
select 0 as stage_no, 'clean' as stage, count(*) as rows, cast(sum(uni) as bigint) as uni,
  cast(sum(fba) as bigint) as fba, cast(sum(fbf) as bigint) as fbf, cast(sum(sjit) as bigint) as sjit from _clean
union all select 1, 'merged', count(*), cast(sum(uniware_stock) as bigint), cast(sum(fba_stock) as bigint),
  cast(sum(fbf_stock) as bigint), cast(sum(sjit_stock) as bigint) from _cs
union all select 2, 'dashboard', count(*), cast(sum(available_atp) as bigint), cast(sum(fba_stock) as bigint),
  cast(sum(fbf_stock) as bigint), cast(sum(sjit_stock) as bigint) from _dash
union all select 3, 'orphans', count(*), cast(sum(uniware_stock) as bigint), cast(sum(fba_stock) as bigint),
  cast(sum(fbf_stock) as bigint), cast(sum(sjit_stock) as bigint) from _orph"""
    q["reconcile_stages"] = q["reconcile"]
    fields = ["sku_code", "item_name", "size", "category", "location", "cost", "price", "catalog", "mrp",
              "up_price", "available_atp", "fba_stock", "fbf_stock", "sjit_stock", "updated"]
    unions = " union all ".join(f"select id, '{c}' as field, cast({c} as varchar) as value from _dash" for c in fields)
    q["row_fields"] = dp + f"select * from ({unions}) where value is not null and value <> ''"
    q["load_table_text"] = """select cast(p_partkey as varchar) as p_partkey, p_name, p_brand, p_type,
  cast(p_size as varchar) as p_size, cast(p_retailprice as varchar) as p_retailprice from part"""
    q["table_counts"] = """select 'part' as table_name, count(*) as rows, cast(null as varchar) as error from part
union all select 'lineitem', count(*), null from lineitem
union all select 'orders', count(*), null from orders
union all select 'events', count(*), null from events"""
    q["key_profile"] = with_views(V_ITEM_MASTER) + f"""
select count(*) as rows, cast(count(distinct {ck('master_sku')}) as bigint) as distinct_keys,
  count(*) - cast(count(distinct {ck('master_sku')}) as bigint) as surplus from v_item_master"""
    q["duplicate_sample"] = with_views(V_ITEM_MASTER) + f"""
, _d as (select {ck('master_sku')} as master_sku, count(*) as cnt from v_item_master group by 1 having count(*) > 1
         order by master_sku limit 3)
select d.master_sku, i.row_no, i.style, i.size, i.category, i.loc, d.cnt
from v_item_master i join _d d on d.master_sku = {ck('i.master_sku')}"""
    q["admin_stats"] = d + """select count(*) as total_items, cast(sum(available_atp) as bigint) as total_available,
  cast(sum(fba_stock) as bigint) as total_fba, cast(sum(sjit_stock) as bigint) as total_sjit,
  cast(sum(fbf_stock) as bigint) as total_fbf from _dash"""
    q["count_where"] = d + """select count(*) filter (where category is not null and category <> '') as with_category,
  count(*) filter (where available_atp > 0) as in_stock from _dash"""
    q["fan_out"] = with_views(V_ITEM_MASTER, V_STOCK_SHEET, _channel_stock_body(), ITEM) + """
select count(*) as before_rows, cast(count(distinct sku_code) as bigint) as before_distinct_keys,
  count(*) as after_rows, cast(count(distinct sku_code) as bigint) as after_distinct_keys from _item"""
    q["next_id"] = d + "select cast(coalesce(max(id), 0) + 1 as bigint) as next_id from _dash"
    q["channel_totals_fba"] = with_views(V_STOCK_SHEET) + f"""
select {ck('fba')} as master_sku, cast(sum({lint('fba_stock')}) as bigint) as fba_stock
from v_stock_sheet where uni is not null and {ck('fba')} is not null and {ck('fba')} <> ''
  and lower({ck('fba')}) not in ('uni', 'paste here :-')
group by 1"""
    q["channel_stock_keep_rows"] = with_views(V_STOCK_SHEET, _channel_stock_body(drop_first_null=False)) + \
        "select * from _cs"
    q["channel_stock_thousands"] = with_views(V_STOCK_SHEET, _channel_stock_body(thousands=True)) + \
        "select * from _cs"
    q["column_totals"] = d + """select cast(sum(available_atp) as bigint) as available_atp,
  cast(sum(fba_stock) as bigint) as fba_stock, cast(sum(fbf_stock) as bigint) as fbf_stock,
  cast(sum(sjit_stock) as bigint) as sjit_stock from _dash"""
    q["top_stock"] = d + f"select {DASH_COLS} from _dash order by available_atp desc, id asc limit 10"
    q["keyset_page"] = d + f"select {DASH_COLS} from _dash where id > 1000 order by id limit 50"
    q["visible_custom"] = dp + "select id, sku_code, cost, available_atp from _dash"
    q["legacy_status"] = f"""select * from (select * replace (case when cost % 30 = 0 then 'active ' when cost % 20 = 0 then 'Closed'
  when cost % 50 = 0 then null else status end as status) from ({_import_sql()["import_result"]})) as r
where (contains(lower(coalesce(sku_code, '')), 'sku-1') or contains(lower(coalesce(item_name, '')), 'sku-1'))
  and lower(coalesce(status, '')) = 'active'"""
    q["item_sort_text_legacy"] = d + f"""select {DASH_COLS} from _dash
order by lower(coalesce(category, 'None')) desc, id asc limit 300"""
    parts = []
    for ch, sku, qty in (("uni", "uni", "uni_stock"), ("fba", "fba", "fba_stock"),
                         ("fbf", "fbf", "fbf_stock"), ("sjit", "sjit", "sjit_stock")):
        parts.append(f"select '{ch}' as ch, {ck(sku)} as sku, {lint(qty)} as qty, l_orderkey, l_linenumber, "
                     f"l_partkey, l_suppkey, l_quantity from v_stock_sheet where uni is not null")
    union = " union all ".join(parts)
    q["channel_stock_last"] = with_views(V_STOCK_SHEET) + f""", _p as (select * from ({union})
  where sku is not null and sku <> '' and lower(sku) not in ('uni', 'paste here :-')),
_l as (select sku, ch, qty from (select *, row_number() over (partition by sku, ch order by {SHEET_ORDER_DESC}) as _rn
       from _p) where _rn = 1)
select sku as master_sku,
  cast(coalesce(max(case when ch = 'uni' then qty end), 0) as bigint) as uniware_stock,
  cast(coalesce(max(case when ch = 'fba' then qty end), 0) as bigint) as fba_stock,
  cast(coalesce(max(case when ch = 'fbf' then qty end), 0) as bigint) as fbf_stock,
  cast(coalesce(max(case when ch = 'sjit' then qty end), 0) as bigint) as sjit_stock
from _l group by sku"""
    q["audit_windows"] = with_views(V_AUDIT) + """select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start,
  strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d %H:%M:%S') as window_end, action, count(*) as n
from v_audit group by 1, 2, 3"""
    return q

"""Registered queries and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import extensions as X
from .operators.pull import pull
from .plans.engine import Engine
from .plans.store import shared_folder
from .session import Session
from .sources.messages import parsed
from .streaming.runner import folder_sink, start_source
from .types import ColumnType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None, args: list | None = None) -> None:
    """A pull query of the dialect over the tables; DuckDB runs the same text unless another is given."""
    QUERIES[name] = lambda spark, d: pull(text, lambda t: _table(spark, d, t), args, spark)
    ORACLE_SQL[name] = oracle or text


def _frame(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# -- scans, filters, projections (S15-S18, P1-P6, X1-X11, D13) ---------------------------------------------------------
_sql("scan_project", "select c_custkey, c_name as name, c_acctbal * 2 as doubled from customer")
_sql("pk_point_get", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7")
_sql("pk_multi_get", "select o_orderkey, o_orderstatus from orders where o_orderkey in (1, 2, 33, 100) or o_orderkey = 5")
_sql("pk_range", "select o_orderkey, o_totalprice from orders where o_orderkey between 10 and 50 and o_orderkey <> 20")
_sql("composite_pk", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey = 3 and l_linenumber >= 1")
_sql("index_scan_eq", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey = 11")
_sql("index_scan_range", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 49 and l_quantity < 50 and l_suppkey > 5")
_sql("filter_and_or_not", "select p_partkey, p_size from part where (p_size < 5 or p_size > 45) and not p_partkey = 3")
_sql("filter_xor", "select p_partkey, p_size from part where p_size > 10 xor p_partkey > 100", "select p_partkey, p_size from part where (p_size > 10) <> (p_partkey > 100)")
_sql("filter_null_3vl", "select event_id, case when event_id % 7 = 0 then null else value end as v from events where case when event_id % 7 = 0 then null else value end > 10 or event_id % 14 = 0")
_sql("filter_in_like", "select p_partkey, p_name, p_brand from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#13') or p_name like '%a_1%'")
_sql("filter_null_safe", "select event_id from events where nullif(event_id % 5, 0) <=> null", "select event_id from events where nullif(event_id % 5, 0) is not distinct from null")
_sql("wildcard", "select * from nation where n_regionkey = 1")
_sql("distinct", "select distinct o_orderstatus, o_orderpriority from orders")
_sql("prepared_arguments", "select o_orderkey, o_totalprice from orders where o_orderstatus = ? and o_totalprice > ?", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000.5", ["F", 1000.5])

# -- order and limit (O1-O3) --------------------------------------------------------------------------------------------
_sql("order_multi_nulls", "select nullif(event_id % 3, 0) as m, event_id from events order by m desc, event_id limit 200", "select nullif(event_id % 3, 0) as m, event_id from events order by m desc nulls last, event_id limit 200")
_sql("topn", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
_sql("order_expression", "select o_orderkey, o_custkey from orders order by o_custkey % 10, o_orderkey limit 100")
_sql("limit_total_order", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500")
_sql("limit_offset", "select c_custkey from customer order by c_custkey limit 20 offset 10")
_sql("limit_zero", "select c_custkey from customer limit 0")

# -- shapes beyond one table (P6-P8, U3, D13, J1, X7, X10, X12, X13, W1) ------------------------------------------------
_sql("pull_distinct_order_limit", "select distinct o_custkey from orders order by o_custkey limit 50")
_sql(
    "pull_markers_limit_offset",
    "select o_orderkey, o_totalprice * ? as x from orders where o_custkey > ? order by o_orderkey limit ? offset ?",
    "select o_orderkey, o_totalprice * 2 as x from orders where o_custkey > 3 order by o_orderkey limit 30 offset 10",
    [2, 3, 30, 10],
)
_sql(
    "pull_markers_group_by",
    "select o_custkey % ? as g, count(*) as n from orders group by o_custkey % ? having count(*) > ?",
    "select o_custkey % 7 as g, count(*) as n from orders group by o_custkey % 7 having count(*) > 1",
    [7, 7, 1],
)
_sql(
    "pull_union_order_limit",
    "select o_orderkey as k from orders union all select c_custkey from customer order by k desc, 1 limit 25 offset 5",
)
_sql("pull_derived_table", "select g, max(n) as most from (select o_custkey % 10 as g, o_orderstatus, count(*) as n from orders group by g, o_orderstatus) t group by g")
_sql(
    "pull_regexp",
    "select p_partkey, p_name regexp '^[a-m].*[0-9]$' as a, p_brand not regexp 'Brand#[1-3]' as b from part",
    "select p_partkey, regexp_matches(p_name, '^[a-m].*[0-9]$') as a, not regexp_matches(p_brand, 'Brand#[1-3]') as b from part",
)
_sql("pull_no_from", "select 1 + 2 as a, 7 div 2 as b, concat('x', 'y') as c, null as d", "select 3 as a, 3::bigint as b, 'xy' as c, null as d")
_sql(
    "pull_joins",
    "select n.n_name, count(*) as n, count(o.o_orderkey) as orders from customer c join nation n on c.c_nationkey = n.n_nationkey left join orders as o on o.o_custkey = c.c_custkey and o.o_totalprice > 1000 group by n.n_name",
)
_sql("pull_join_natural_using", "select count(*) as n from nation natural join (select n_nationkey, n_name as x from nation) t join (select c_nationkey as n_nationkey from customer) u using (n_nationkey)")
_sql(
    "pull_subqueries",
    "select o_orderkey from orders o where o_totalprice > (select avg(o_totalprice) from orders) and o_custkey in (select c_custkey from customer where c_acctbal > 0) and exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_nationkey < 20) and o_custkey <> all (select s_suppkey from supplier)",
    "select o_orderkey from orders o where o_totalprice > (select avg(o_totalprice) from orders) and o_custkey in (select c_custkey from customer where c_acctbal > 0) and exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_nationkey < 20) and o_custkey not in (select s_suppkey from supplier)",
)
_sql("pull_row_values", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) in ((1, 1), (3, 2), (7, 1)) or (l_orderkey, l_linenumber) = (5, 1)")
_sql(
    "pull_collate",
    "select p_partkey, p_brand collate utf8mb4_general_ci = 'bRAND#11' as ci, p_brand collate utf8mb4_bin = 'bRAND#11' as b from part",
    "select p_partkey, lower(p_brand) = 'brand#11' as ci, p_brand = 'bRAND#11' as b from part",
)
_sql("pull_window", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between 1 preceding and current row) as s from orders", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, (sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between 1 preceding and current row))::bigint as s from orders")
_sql("pull_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by l_returnflag, l_linestatus with rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")

# -- aggregation (A1-A5, A8-A11, A13) and unions (U1-U3) ------------------------------------------------------------------
_sql(
    "agg_sum_count",
    "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18, 4))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18, 4))) as double) as sum_price, count(*) as n, count(l_tax) as n_tax from lineitem where l_shipdate <= timestamp '2024-06-01 00:00:00' group by l_returnflag, l_linestatus",
)
_sql("agg_global", "select cast(sum(cast(l_quantity as decimal(18, 4))) as double) as total, count(*) as n from lineitem")
_sql("agg_having", "select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18, 4))) as double) as total from orders group by o_custkey having count(*) > 2")
_sql("agg_group_expr", "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by year(o_orderdate), month(o_orderdate)")
_sql("agg_group_ordinal", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
_sql("agg_group_alias", "select p_size % 5 as bucket, count(*) as n from part group by bucket")
_sql("agg_all_null_sum", "select event_type, sum(case when value < 0 then value else null end) as s, count(*) as n from events group by event_type")
_sql("agg_distinct", "select l_returnflag, count(distinct l_suppkey) as suppliers, cast(sum(distinct l_suppkey) as bigint) as total from lineitem group by l_returnflag")
_sql("agg_group_concat", "select p_size, group_concat(distinct p_brand) as brands from part group by p_size", "select p_size, string_agg(distinct p_brand, ',' order by p_brand) as brands from part group by p_size")
_sql("union_all_casts", "select c_custkey as k, c_name as name, c_acctbal as v from customer union all select s_suppkey, s_name, s_suppkey from supplier", "select c_custkey as k, c_name as name, c_acctbal as v from customer union all select s_suppkey, s_name, s_suppkey::double from supplier")
_sql("union_distinct", "select c_nationkey as n from customer union select s_nationkey from supplier")


@_frame("agg_over_union", "select nation, count(*) as n, cast(sum(cast(bal as decimal(18, 4))) as double) as total from (select c_nationkey as nation, c_acctbal as bal from customer union all select s_nationkey, s_acctbal from supplier) group by nation")
def agg_over_union(spark, d):
    both = pull("select c_nationkey as nation, c_acctbal as bal from customer union all select s_nationkey, s_acctbal from supplier", lambda t: _table(spark, d, t))
    return pull("select nation, count(*) as n, cast(sum(cast(bal as decimal(18, 4))) as double) as total from u group by nation", lambda t: both)


# -- functions (F1-F127, X5), one query per family ------------------------------------------------------------------------
_NV = "nullif(event_id % 4, 0)"
_sql(
    "fn_null_compare",
    f"select event_id, coalesce({_NV}, 9) as c, isnull({_NV}) as isn, greatest({_NV}, 2) as g, least({_NV}, 2) as l, interval(event_id % 50, 1, 10, 20, 40) as iv, ifnull({_NV}, -1) as ifn, if({_NV} = 1, 'one', 'other') as iff, strcmp(event_type, 'login') as sc, {_NV} in (1, 2) as inn from events",
    f"select event_id, coalesce({_NV}, 9) as c, case when {_NV} is null then 1 else 0 end as isn, case when {_NV} is null then null else greatest({_NV}, 2) end as g, case when {_NV} is null then null else least({_NV}, 2) end as l, case when event_id % 50 < 1 then 0 when event_id % 50 < 10 then 1 when event_id % 50 < 20 then 2 when event_id % 50 < 40 then 3 else 4 end as iv, coalesce({_NV}, -1) as ifn, case when {_NV} = 1 then 'one' else 'other' end as iff, case when event_type < 'login' then -1 when event_type > 'login' then 1 else 0 end as sc, {_NV} in (1, 2) as inn from events",
)
_sql(
    "fn_math",
    "select p_partkey, abs(10 - p_size) as a, round(acos(p_size / 100.0), 6) as ac, round(asin(p_size / 100.0), 6) as asn, round(atan(p_size), 6) as at1, round(atan2(p_size, 2), 6) as at2, ceil(p_retailprice) as ce, ceiling(p_retailprice) as ce2, floor(p_retailprice) as fl, round(cos(p_size), 6) as co, round(cot(p_size), 6) as ct, round(degrees(p_size), 6) as de, round(exp(p_size / 10.0), 4) as ex, round(ln(p_size), 6) as l0, round(log(2, p_size), 6) as lb, round(log2(p_size), 6) as l2, round(log10(p_size), 6) as l10, round(pi(), 6) as p, pow(p_size, 2) as pw, power(p_size, 2) as pw2, round(radians(p_size), 6) as ra, sign(25 - p_size) as sg, round(sin(p_size), 6) as si, round(sqrt(p_size), 6) as sq, sqrt(0 - p_size) as sqn, acos(p_size + 1) as acn, round(tan(p_size), 6) as ta, truncate(p_retailprice, 1) as tr, p_size % 7 as md, mod(p_size, 0) as md0, p_size div 3 as dv, p_size / 0 as dz from part",
    "select p_partkey, abs(10 - p_size) as a, round(acos(p_size / 100.0), 6) as ac, round(asin(p_size / 100.0), 6) as asn, round(atan(p_size), 6) as at1, round(atan2(p_size, 2), 6) as at2, ceil(p_retailprice)::bigint as ce, ceil(p_retailprice)::bigint as ce2, floor(p_retailprice)::bigint as fl, round(cos(p_size), 6) as co, round(cot(p_size), 6) as ct, round(degrees(p_size), 6) as de, round(exp(p_size / 10.0), 4) as ex, round(ln(p_size), 6) as l0, round(ln(p_size) / ln(2), 6) as lb, round(log2(p_size), 6) as l2, round(log10(p_size), 6) as l10, round(pi(), 6) as p, pow(p_size, 2) as pw, pow(p_size, 2) as pw2, round(radians(p_size), 6) as ra, sign(25 - p_size)::int as sg, round(sin(p_size), 6) as si, round(sqrt(p_size), 6) as sq, null::double as sqn, null::double as acn, round(tan(p_size), 6) as ta, trunc(p_retailprice * 10) / 10 as tr, p_size % 7 as md, null::int as md0, p_size // 3 as dv, null::double as dz from part",
)
_sql(
    "fn_string_1",
    "select p_partkey, ascii(p_name) as a, concat(p_name, '-', p_brand) as c, concat_ws('/', p_name, null, p_brand) as cw, elt(p_size % 3, 'x', 'y') as e, field(p_size % 3, 1, 2) as f, instr(p_name, 'a') as i, lcase(p_name) as lc, left(p_name, 3) as l3, right(p_name, 3) as r3, length(p_name) as len, locate('a', p_name, 2) as lo, lower(p_brand) as lw, lpad(p_name, 12, '*') as lp, rpad(p_name, 12, '*') as rp, ltrim(concat('  ', p_name)) as lt, rtrim(concat(p_name, '  ')) as rt, mid(p_name, 2, 3) as m, substring(p_name, 0, 2) as s0, substr(p_name, -3, 2) as sn, substring_index(p_name, ' ', 1) as si from part",
    "select p_partkey, ascii(p_name) as a, concat(p_name, '-', p_brand) as c, concat_ws('/', p_name, null, p_brand) as cw, case p_size % 3 when 1 then 'x' when 2 then 'y' end as e, case p_size % 3 when 1 then 1 when 2 then 2 else 0 end as f, instr(p_name, 'a') as i, lower(p_name) as lc, left(p_name, 3) as l3, right(p_name, 3) as r3, strlen(p_name) as len, case when instr(substring(p_name, 2), 'a') > 0 then instr(substring(p_name, 2), 'a') + 1 else 0 end as lo, lower(p_brand) as lw, lpad(p_name, 12, '*') as lp, rpad(p_name, 12, '*') as rp, p_name as lt, p_name as rt, substring(p_name, 2, 3) as m, '' as s0, substring(p_name, length(p_name) - 2, 2) as sn, split_part(p_name, ' ', 1) as si from part",
)
_sql(
    "fn_string_2",
    "select p_partkey, bin(p_size) as b, oct(p_size) as o, hex(p_size) as hx, hex(p_brand) as hs, unhex(hex(p_brand)) as uh, from_base64(to_base64(p_brand)) as b64, to_base64(p_brand) as tb, repeat(p_brand, 2) as rp, replace(p_name, 'a', 'bb') as rl, reverse(p_name) as rv, space(2) as sp, trim(concat(' ', p_name, ' ')) as tm, trim(both 'x' from concat('xx', p_brand, 'x')) as tx, ucase(p_name) as uc, upper(p_name) as up, bit_length(p_brand) as bl, char_length(p_name) as cl, character_length(p_name) as ccl, octet_length(p_name) as ol, find_in_set(p_size % 3, '0,1,2') as fs, ord(p_name) as od, position('B' in p_brand) as ps, conv(p_size, 10, 36) as cv, crc32(p_brand) is not null as cr from part",
    "select p_partkey, bin(p_size) as b, ltrim(format('{:o}', p_size), '') as o, upper(to_hex(p_size)) as hx, upper(hex(p_brand)) as hs, p_brand as uh, p_brand as b64, to_base64(p_brand::blob) as tb, repeat(p_brand, 2) as rp, replace(p_name, 'a', 'bb') as rl, reverse(p_name) as rv, '  ' as sp, p_name as tm, p_brand as tx, upper(p_name) as uc, upper(p_name) as up, bit_length(p_brand) as bl, length(p_name) as cl, length(p_name) as ccl, strlen(p_name) as ol, p_size % 3 + 1 as fs, ascii(p_name) as od, instr(p_brand, 'B') as ps, upper(to_base(p_size, 36)) as cv, true as cr from part",
)
_sql(
    "fn_string_3",
    "select p_partkey, insert(p_name, 2, 2, '__') as ins, insert(p_name, 99, 2, '__') as ins0, make_set(p_size % 4, 'a', 'b') as ms, export_set(p_size % 8, 'Y', 'N', '-', 4) as es, quote(p_brand) as q, quote(null) as qn, format(p_retailprice, 2) as fm, char(77, 121) as ch, convert(p_size using utf8mb4) as cu, lpad(p_name, -1, 'x') as lneg, strcmp(p_name, p_brand) as sc from part",
    "select p_partkey, concat(left(p_name, 1), '__', substring(p_name, 4)) as ins, p_name as ins0, case p_size % 4 when 0 then '' when 1 then 'a' when 2 then 'b' else 'a,b' end as ms, concat(case when p_size % 2 >= 1 then 'Y' else 'N' end, '-', case when p_size % 4 >= 2 then 'Y' else 'N' end, '-', case when p_size % 8 >= 4 then 'Y' else 'N' end, '-N') as es, concat('''', p_brand, '''') as q, 'NULL' as qn, format('{:,.2f}', p_retailprice) as fm, 'My' as ch, p_size::varchar as cu, null::varchar as lneg, case when p_name < p_brand then -1 when p_name > p_brand then 1 else 0 end as sc from part",
)
_sql(
    "fn_date",
    "select event_id, year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h, minute(ts) as mi, second(ts) as s, microsecond(ts) as us, date_format(ts, '%Y-%m-%d %H:%i:%s.%f') as df, cast(unix_timestamp(ts) as double) as ut, from_unixtime(event_id, '%Y/%m/%d %H') as fu, timestamp(ts, '01:30:00') as tp from events",
    "select event_id, year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, hour(ts)::int as h, minute(ts)::int as mi, second(ts)::int as s, (microsecond(ts) % 1000000)::int as us, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as df, epoch_us(ts) / 1000000.0::double as ut, strftime(to_timestamp(event_id)::timestamp, '%Y/%m/%d %H') as fu, ts + interval '90 minutes' as tp from events",
)
_sql(
    "fn_date_format_weeks",
    "select event_id, date_format(ts, '%D %w') as dw, date_format(ts, '%U') as u0, date_format(ts, '%v %x') as v3, week(ts, 3) as w3, week(ts) as w0, yearweek(ts, 3) as yw from events",
    """select event_id, day(ts) || case when day(ts) in (11, 12, 13) then 'th' when day(ts) % 10 = 1 then 'st' when day(ts) % 10 = 2 then 'nd' when day(ts) % 10 = 3 then 'rd' else 'th' end || ' ' || dayofweek(ts) as dw,
    strftime(ts, '%U') as u0, strftime(ts, '%V %G') as v3, strftime(ts, '%V')::int as w3, strftime(ts, '%U')::int as w0, strftime(ts, '%G%V')::int as yw from events""",
)
_sql(
    "fn_date_steps",
    "select event_id, date_add(ts, interval 3 day) as a, date_sub(ts, interval 90 minute) as b, adddate(ts, 2) as c, date_add(ts, interval 1 month) as d, ts + interval 10 second as e, extract(hour from ts) as f, timestampdiff(hour, timestamp '2024-01-01 00:00:00', ts) as g, to_days(ts) as h, dayname(ts) as i, monthname(ts) as j, dayofyear(ts) as k, quarter(ts) as l, last_day(ts) as m, datediff(ts, timestamp '2024-01-10 00:00:00') as n, makedate(2024, event_id % 300 + 1) as o, period_add(202401, event_id % 30) as p, weekday(ts) as q, str_to_date(date_format(ts, '%d.%m.%Y'), '%d.%m.%Y') as r, sec_to_time(event_id) as s, time_to_sec(date_format(ts, '%H:%i:%s')) as t from events",
    "select event_id, ts + interval 3 day as a, ts - interval 90 minute as b, ts + interval 2 day as c, ts + interval 1 month as d, ts + interval 10 second as e, hour(ts)::int as f, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000)::bigint as g, (date_diff('day', date '1970-01-01', ts::date) + 719528)::int as h, dayname(ts) as i, monthname(ts) as j, dayofyear(ts)::int as k, quarter(ts)::int as l, last_day(ts) as m, date_diff('day', date '2024-01-10', ts::date)::int as n, date '2024-01-01' + (event_id % 300)::int as o, (2024 + (event_id % 30) // 12) * 100 + (event_id % 30) % 12 + 1 as p, isodow(ts)::int - 1 as q, date_trunc('day', ts)::timestamp as r, format('{:02d}:{:02d}:{:02d}', event_id // 3600, event_id // 60 % 60, event_id % 60) as s, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as t from events",
)
_sql(
    "fn_bytes",
    "select p_partkey, hex(char(300, p_size)) as a, char(77, null, 121) as b, unhex('zz') as c, from_base64('*') as d, hex(unhex('FF41')) as e, elt(1.6, 'a', 'b') as f, format(2.5, 0) as g, format(0.125, 2) as h, format(-1234.565, 2) as i from part",
    "select p_partkey, '012C' || lpad(upper(to_hex(p_size)), 2, '0') as a, 'My' as b, null::varchar as c, null::varchar as d, 'FF41' as e, 'b' as f, '3' as g, '0.13' as h, '-1,234.57' as i from part",
)
_sql(
    "fn_json",
    """select event_id, json_extract(props, '$.k') as a, json_unquote(json_extract('{"a": {"b": "x"}}', '$.a.b')) as b, json_valid(props) as c, json_valid('{') as d, json_length('[1, 2, 3]') as e, json_keys('{"a": 1, "b": 2}') as f, json_object('k', event_id, 't', event_type) as g, json_extract('{"a": [1, "x"]}', '$.a') as h from events""",
    """select event_id, json_extract(props, '$.k')::varchar as a, 'x' as b, 1 as c, 0 as d, 3 as e, '["a","b"]' as f, '{"k":' || event_id || ',"t":"' || event_type || '"}' as g, '[1,"x"]' as h from events""",
)
_sql(
    "fn_control",
    "select event_id, case event_type when 'click' then 1 when 'view' then 2 else 0 end as a, case when value > 50 then 'big' when value > 10 then 'mid' end as b, if(value > 50, 1, 0) as c, ifnull(nullif(event_type, 'click'), 'none') as d, (value > 10) is true as e, (value > 10) is false as f, not value > 10 as g, (value > 10) is not null as h from events",
    "select event_id, case event_type when 'click' then 1 when 'view' then 2 else 0 end as a, case when value > 50 then 'big' when value > 10 then 'mid' end as b, case when value > 50 then 1 else 0 end as c, ifnull(nullif(event_type, 'click'), 'none') as d, coalesce(value > 10, false) as e, coalesce(not value > 10, false) as f, not value > 10 as g, (value > 10) is not null as h from events",
)
_sql(
    "fn_bitwise",
    "select event_id, event_id & 6 as a, event_id | 6 as o, event_id ^ 6 as x, event_id << 3 as l, event_id >> 2 as r, -event_id as n, cast(~event_id as char) as t, event_id + 1 as pl, event_id - 1 as mi, event_id * 3 as mu from events",
    "select event_id, event_id & 6 as a, event_id | 6 as o, xor(event_id, 6) as x, event_id << 3 as l, event_id >> 2 as r, -event_id as n, (18446744073709551615::hugeint - event_id)::varchar as t, event_id + 1 as pl, event_id - 1 as mi, event_id * 3 as mu from events",
)
_sql(
    "fn_cast",
    "select p_partkey, cast(p_size as char) as c, cast(p_retailprice as decimal(12, 1)) as d, cast(p_size as double) as db, cast('17' as signed) as s, cast(cast(p_partkey as char) as signed) + 1 as r from part",
    "select p_partkey, p_size::varchar as c, p_retailprice::decimal(12, 1) as d, p_size::double as db, 17::bigint as s, p_partkey + 1 as r from part",
)

# -- sources, views and sinks (S1-S14, T1-T8) -----------------------------------------------------------------------------
EVENT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("amount", T.DecimalType(18, 4))])
_LATEST = "(select user_id, event_type, max(event_id) as event_id, arg_max(cast(value as decimal(18, 4)), event_id) as amount from events group by user_id, event_type)"


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, f"{shared_folder(spark)}/tideline-engine-{uuid.uuid4().hex}", buckets=4)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").cast("decimal(18,4)").alias("amount"))


def _replayed(spark: SparkSession, d: str, views: list[tuple[str, str]], batches: int = 3, late_views: list[tuple[str, str]] = (), **options) -> Engine:
    """An engine whose source ``ev`` (latest event of each user and type) took the events in batches."""
    e, rows = _engine(spark), _rows(spark, d)
    e.create_source("ev", EVENT, ["user_id", "event_type"], **options)
    for v in views:
        e.create_view(*v)
    for b in range(batches):
        if b == 1:
            for v in late_views:
                e.create_view(*v)
        e.ingest("ev", rows.where(F.col("event_id") % batches == b), b, ["event_id"])
    return e


def _in_order(spark: SparkSession, d: str, views, late_views=(), **options) -> Engine:
    """As above, with batches in order of arrival, so that later batches update earlier rows."""
    e, rows = _engine(spark), _rows(spark, d)
    e.create_source("ev", EVENT, ["user_id", "event_type"], **options)
    for v in views:
        e.create_view(*v)
    low, high = _table(spark, d, "events").agg(F.min("event_id"), F.max("event_id")).first()
    cut = (low + high) // 2
    e.ingest("ev", rows.where(F.col("event_id") <= cut), 0, ["event_id"])
    for v in late_views:
        e.create_view(*v)
    e.ingest("ev", rows.where(F.col("event_id") > cut), 1, ["event_id"])
    return e


def _money(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


@_frame("source_upsert", f"select user_id, event_type, event_id, amount::double as amount from {_LATEST}")
def source_upsert(spark, d):
    return _money(_in_order(spark, d, []).read("ev"))


@_frame("mv_filter_incremental", f"select user_id, event_type, event_id, amount::double as amount from {_LATEST} where amount > 50")
def mv_filter(spark, d):
    return _money(_in_order(spark, d, [("v", "select * from ev where amount > 50")]).read("v"))


@_frame("mv_project_hidden_key", f"select event_type, (amount * 2)::double as twice from {_LATEST}")
def mv_project(spark, d):
    return _money(_in_order(spark, d, [("v", "select event_type, amount * 2 as twice from ev")]).read("v"))


@_frame("mv_agg_incremental", f"select event_type, sum(amount)::double as total, count(*) as n from {_LATEST} group by event_type")
def mv_agg(spark, d):
    return _money(_in_order(spark, d, [("v", "select event_type, sum(amount) as total, count(*) as n from ev group by event_type")]).read("v"))


@_frame("mv_agg_having_incremental", f"select user_id, sum(amount)::double as total from {_LATEST} group by user_id having sum(amount) > 150")
def mv_agg_having(spark, d):
    return _money(_in_order(spark, d, [("v", "select user_id, sum(amount) as total from ev group by user_id having sum(amount) > 150")]).read("v"))


@_frame("mv_cascade", f"select count(*) as users, sum(total)::double as total from (select user_id, sum(amount) as total from {_LATEST} where amount > 20 group by user_id)")
def mv_cascade(spark, d):
    views = [("a", "select * from ev where amount > 20"), ("b", "select user_id, sum(amount) as total from a group by user_id"), ("c", "select count(*) as users, sum(total) as total from b")]
    return _money(_in_order(spark, d, views).read("c"))


@_frame("mv_union_incremental", f"select user_id as k, amount::double as v from {_LATEST} where amount < 30 union all select event_id, amount::double from {_LATEST} where amount > 70")
def mv_union(spark, d):
    return _money(_in_order(spark, d, [("v", "select user_id as k, amount as v from ev where amount < 30 union all select event_id, amount from ev where amount > 70")]).read("v"))


@_frame("mv_fill_then_stream", f"select event_type, count(*) as n, sum(amount)::double as total from {_LATEST} group by event_type")
def mv_fill(spark, d):
    return _money(_in_order(spark, d, [], [("v", "select event_type, count(*) as n, sum(amount) as total from ev group by event_type")]).read("v"))


@_frame("mv_extremes_incremental", f"select event_type, min(amount)::double as lo, max(amount)::double as hi, count(distinct user_id) as users from {_LATEST} group by event_type")
def mv_extremes(spark, d):
    return _money(_in_order(spark, d, [("v", "select event_type, min(amount) as lo, max(amount) as hi, count(distinct user_id) as users from ev group by event_type")]).read("v"))


@_frame("mv_distinct_incremental", f"select distinct user_id from {_LATEST}")
def mv_distinct(spark, d):
    return _in_order(spark, d, [("v", "select distinct user_id from ev")]).read("v")


@_frame("source_transient", f"select count(*) as n from (select user_id, event_type from events group by user_id, event_type)")
def source_transient(spark, d):
    e, rows = _engine(spark), _rows(spark, d)
    e.create_source("ev", EVENT, ["user_id", "event_type"], transient=True)
    e.create_view("v", "select user_id, event_type from ev")
    e.ingest("ev", rows, 0, ["event_id"])
    e.create_view("n", "select count(*) as n from v")
    return e.read("n")


@_frame("source_ingest_filter", "select user_id, event_type, max(event_id) as event_id, arg_max(cast(value as decimal(18, 4)), event_id)::double as amount from events where value > 40 group by user_id, event_type")
def source_ingest_filter(spark, d):
    return _money(_in_order(spark, d, [], ingest_filter="amount > 40").read("ev"))


@_frame("source_exactly_once", f"select sum(amount)::double as total, count(*) as n from {_LATEST}")
def source_exactly_once(spark, d):
    e = _in_order(spark, d, [("v", "select sum(amount) as total, count(*) as n from ev")])
    for b in (0, 1):
        e.ingest("ev", _rows(spark, d), b, ["event_id"])  # batches seen before change nothing
    return _money(e.read("v"))


@_frame("source_two_replayed", "select event_id, value::double as v from events where event_id % 3 <> 2 union all select event_id, value::double from events where event_id % 3 = 2")
def source_two_replayed(spark, d):
    """A batch of one source fails after its own table took it; another source's batch comes before the replay."""
    e, rows = _engine(spark), _table(spark, d, "events").select("event_id", "value")
    shape = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    for name in ("a", "b"):
        e.create_source(name, shape, ["event_id"])
    e.create_view("v", "select event_id, value as v from a union all select event_id, value from b")
    e.ingest("a", rows.where("event_id % 3 = 0"), 0)
    whole, e._propagate = e._propagate, None  # the engine breaks after the table's commit
    try:
        e.ingest("a", rows.where("event_id % 3 = 1"), 1)
    except TypeError:
        e._propagate = whole
    e.ingest("b", rows.where("event_id % 3 = 2"), 0)
    e.ingest("a", rows.where("event_id % 3 = 1"), 1)
    return e.read("v")


def _stamped(spark, d):
    """Events with times that differ by microseconds only."""
    return _table(spark, d, "events").select("event_id", F.timestamp_micros(1700000000000000 + F.col("event_id") % 1000).alias("t"), F.col("user_id").alias("v"))


_STAMPED = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("t", T.TimestampType()), T.StructField("v", T.LongType())])


@_frame("source_timestamp_key", "select (1700000000000000 + event_id % 1000)::bigint as t, max(event_id) as event_id from events group by 1")
def source_timestamp_key(spark, d):
    e, rows = _engine(spark), _stamped(spark, d)
    e.create_source("ev", _STAMPED, ["t"])
    for b in (0, 1):
        e.ingest("ev", rows.where(F.col("event_id") % 2 == b), b, ["event_id"])
    return e.read("ev").groupBy(F.unix_micros("t").alias("t")).agg(F.max("event_id").alias("event_id"))


@_frame("mv_group_by_timestamp", "select (1700000000000000 + event_id % 1000)::bigint as t, sum(user_id)::bigint as total, min(user_id) as lo from events group by 1")
def mv_group_by_timestamp(spark, d):
    e, rows = _engine(spark), _stamped(spark, d)
    e.create_source("ev", _STAMPED, ["event_id"])
    e.create_view("s", "select t, sum(v) as total from ev group by t")
    e.create_view("m", "select t, min(v) as lo from ev group by t")
    for b in (0, 1):
        e.ingest("ev", rows.where(F.col("event_id") % 2 == b), b, ["event_id"])
    return e.read("s").join(e.read("m"), "t").select(F.unix_micros("t").alias("t"), "total", "lo")


@_frame("source_transient_extremes", f"select event_type, max(amount)::double as hi, count(distinct user_id) as users from {_LATEST} group by event_type")
def source_transient_extremes(spark, d):
    e, rows = _engine(spark), _rows(spark, d)
    e.create_source("ev", EVENT, ["user_id", "event_type"], transient=True)
    e.create_view("v", "select event_type, max(amount) as hi, count(distinct user_id) as users from ev group by event_type")
    latest = rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "amount"), "event_id").alias("x")).select("user_id", "event_type", "x.*")
    for b in (0, 1):
        e.ingest("ev", latest.where(F.col("user_id") % 2 == b), b, ["event_id"])
    return _money(e.read("v"))


@_frame("mv_average_incremental", f"select event_type, avg(amount)::double as a, round(stddev_pop(event_id), 3) as sd from {_LATEST} group by event_type")
def mv_average(spark, d):
    out = _in_order(spark, d, [("v", "select event_type, avg(amount) as a, stddev_pop(event_id) as sd from ev group by event_type")]).read("v")
    return _money(out.withColumn("sd", F.round("sd", 3)))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    ev = _table(spark, d, "events")
    value = F.to_json(F.struct(F.struct(F.col("value").alias("v"), F.array("event_type").alias("tags")).alias("a"), F.get_json_object("props", "$.k").alias("k")))
    return ev.select(
        F.to_json(F.struct("event_id")).cast("binary").alias("key"), value.cast("binary").alias("value"), F.create_map(F.lit("type"), "event_type").alias("headers"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
    )


@_frame("source_json_selectors", "select event_id, cast(value as double) as v, event_type as tag, cast(json_extract_string(props, '$.k') as bigint) as k, event_type as h, ts from events")
def source_json_selectors(spark, d):
    columns = [("event_id", "bigint", 'meta("key").event_id'), ("v", "double", "a.v"), ("tag", "varchar", "a.tags[0]"), ("k", "bigint", "k"), ("h", "varchar", 'meta("header").type'), ("ts", "timestamp(6)", 'meta("timestamp")')]
    out = parsed(_messages(spark, d), [(n, ColumnType.parse(t), s) for n, t, s in columns])
    return out.select("event_id", "v", "tag", "k", "h", F.col("ts").cast("timestamp_ntz").alias("ts"))


@_frame("source_integer_keys", "select event_id as k, user_id as v from events")
def source_integer_keys(spark, d):
    number = F.unhex(F.lpad(F.hex("event_id"), 16, "0"))
    short = F.unhex(F.lpad(F.hex("user_id"), 8, "0"))
    messages = _table(spark, d, "events").select(number.alias("key"), short.alias("value"), F.lit(None).cast("map<string,string>").alias("headers"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"))
    from .sources.codecs import decode

    return messages.select(decode(F.col("key"), "int64be").alias("k"), decode(F.col("value"), "int32be").alias("v"))


@_frame("source_retention", "select count(*) as n, min(event_id) as lo from events where event_id % 2 = 0")
def source_retention(spark, d):
    e = _engine(spark)
    e.create_source("ev", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("row_time", T.TimestampType())]), ["event_id"], retention_s=3600)
    e.ingest("ev", _table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.current_timestamp()).otherwise(F.lit("2020-01-01").cast("timestamp")).alias("row_time")), 0)
    e.reap("ev")
    return e.store("ev").rows().agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"))


_SINK_ROW = "user_id bigint, event_type string, amount decimal(18,4)"


def _sent(spark: SparkSession, path: str) -> DataFrame:
    """What a sink's readers have at last: each key's last value."""
    last = spark.read.parquet(path).groupBy("key").agg(F.max_by(F.struct("value"), "batch").alias("v")).where("v.value is not null")
    return last.select(F.from_json(F.col("v.value").cast("string"), _SINK_ROW).alias("r")).select("r.user_id", "r.event_type", F.col("r.amount").cast("double").alias("amount"))


@_frame("sink_latest_per_key", f"select user_id, event_type, amount::double as amount from {_LATEST} where amount > 10")
def sink_latest_per_key(spark, d):
    e, rows = _engine(spark), _rows(spark, d)
    path = f"{e.folder}/sink"
    e.create_source("ev", EVENT, ["user_id", "event_type"])
    keys, all_ = ["user_id", "event_type"], ["user_id", "event_type", "amount"]
    # a column goes to the key and the value, so it is selected for both
    injectors = [(f"k_{c}", f'meta("key").{c}') for c in keys] + [(c, c) for c in all_]
    e.create_sink("out", "select user_id as k_user_id, event_type as k_event_type, user_id, event_type, amount from ev where amount > 10", folder_sink(path, injectors=injectors))
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    for b, part in enumerate((rows.where(F.col("event_id") <= (low + high) // 2), rows.where(F.col("event_id") > (low + high) // 2))):
        e.ingest("ev", part, b, ["event_id"])
    return _sent(spark, path)


_SOURCE_DDL = """create source ev(user_id bigint, event_type varchar, event_id bigint, amount decimal(18, 4), primary key (user_id, event_type)) with (
  brokername = "b", topicname = "in", headerencoding = "stringbytes", keyencoding = "json", valueencoding = "json",
  columnselectors = (user_id, event_type, event_id, amount))"""
_SINK_DDL = """create sink out with (brokername = "b", topicname = "out", headerencoding = "stringbytes", keyencoding = "json", valueencoding = "json",
  injectors = (meta("key").user_id, meta("key").event_type, user_id, event_type, amount) {more}) as
  select user_id as k0, event_type as k1, user_id, event_type, amount from ev where amount > 10"""


def _session(spark: SparkSession, folder: str | None = None) -> Session:
    folder = folder or f"{shared_folder(spark)}/tideline-session-{uuid.uuid4().hex}"
    return Session(spark, folder, brokers={"b": {"path": f"{folder}/topics"}}, buckets=4)


@_frame("sink_sql", f"select user_id, event_type, amount::double as amount from {_LATEST} where amount > 10")
def sink_sql(spark, d):
    s, rows = _session(spark), _rows(spark, d)
    s.execute(_SOURCE_DDL)
    s.execute(_SINK_DDL.format(more=""))
    for b in (0, 1, 2):
        s.engine.ingest("ev", rows.where(F.col("event_id") % 3 == b), b, ["event_id"])
    last = _session(spark, s.folder)  # arrivals out of order: the table's rows are the ones that came last
    out = _sent(spark, f"{s.folder}/topics/out")
    last.engine.ingest("ev", rows, 3, ["event_id"])  # a restarted engine sends on
    return _sent(spark, f"{s.folder}/topics/out") if out.limit(1).count() else out


@_frame("sink_buffered_restart", f"select user_id, event_type, amount::double as amount from {_LATEST} where amount > 10")
def sink_buffered_restart(spark, d):
    """Five batches are held back, the engine restarts, and all that waits is sent at once."""
    s, rows = _session(spark), _rows(spark, d)
    s.execute(_SOURCE_DDL)
    s.execute(_SINK_DDL.format(more=', emitafter = "1h", maxbufferedmessages = 1000000000'))
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // 5 + 1
    for b in range(5):
        s.engine.ingest("ev", rows.where((F.col("event_id") - low) / step >= b).where((F.col("event_id") - low) / step < b + 1), b, ["event_id"])
    if s.engine.files.exists(f"{s.folder}/topics/out"):
        raise AssertionError("sent too early")
    _session(spark, s.folder).engine.emit_due(now=True)
    return _sent(spark, f"{s.folder}/topics/out")


# -- statements (D1-D13) -----------------------------------------------------------------------------------------------
def _statements(spark: SparkSession) -> Session:
    s = _session(spark)
    s.execute(_SOURCE_DDL)
    s.execute("create materialized view totals as select event_type, sum(amount) as total from ev group by event_type")
    s.execute(_SINK_DDL.format(more=""))
    s.execute("create index by_type on ev(event_type)")
    s.execute("create index by_id on ev(event_id)")
    return s


def _statement(name: str, sql: str, rows: str, *before: str) -> None:
    """A statement's rows against values that are known beforehand."""

    def run(spark, d):
        s = _statements(spark)
        for x in before:
            s.execute(x)
        return s.execute(sql)

    QUERIES[name], ORACLE_SQL[name] = run, rows


_statement("ddl_show_tables", "show tables", "select * from (values ('ev', 'source'), ('out', 'sink'), ('totals', 'materialized_view')) t(\"table\", kind)")
_statement("ddl_show_schemas", "show schemas", "select * from (values ('default'), ('other'), ('sys')) t(schema)", "use other", "use default")
_statement("ddl_show_indexes", "show indexes on ev", "select * from (values ('by_id', 'ev', 'event_id'), ('by_type', 'ev', 'event_type')) t(index, \"table\", columns)")
_statement("ddl_drop_index", "show indexes on ev", "select * from (values ('by_id', 'ev', 'event_id')) t(index, \"table\", columns)", "drop index by_type on ev")
_statement("ddl_drop", "show tables", "select * from (values ('ev', 'source')) t(\"table\", kind)", "drop sink out", "drop materialized view totals")
_statement(
    "ddl_describe",
    "describe ev",
    "select * from (values ('user_id', 'bigint', 'pri'), ('event_type', 'varchar', 'pri'), ('event_id', 'bigint', ''), ('amount', 'decimal(18, 4)', '')) t(field, type, key)",
)
_statement("ddl_system_tables", "select name, kind from sys.tables order by name", "select * from (values ('ev', 'source'), ('out', 'sink'), ('totals', 'materialized_view')) t(name, kind)")
_statement("ddl_max_rate", "select name from sys.tables where kind = 'source'", "select 'ev' as name", "source set max rate ev 100", "set max_line_width 80", "reset ddl default")


@_frame("stream_ingest", f"select event_type, count(*) as n, sum(amount)::double as total from {_LATEST} group by event_type")
def stream_ingest(spark, d):
    e = _engine(spark)
    folder = f"{e.folder}/in"
    _rows(spark, d).repartition(3).write.parquet(folder)
    e.create_source("ev", EVENT, ["user_id", "event_type"])
    e.create_view("v", "select event_type, count(*) as n, sum(amount) as total from ev group by event_type")
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 3).parquet(folder)
    start_source(e, "ev", stream, f"{e.folder}/checkpoint", seq="event_id", once=True).awaitTermination()
    return _money(e.read("v"))


# -- extensions (J1-J3, W1-W2, A7, A12, T9, X12, U4-U5, 2.11) ------------------------------------------------------------
@_frame("ext_join_inner", "select n_name, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name")
def ext_join_inner(spark, d):
    c, n, r = (_table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@_frame("ext_join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey")
def ext_join_left(spark, d):
    c, o = _table(spark, d, "customer").select("c_custkey"), _table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@_frame("ext_join_right_all", "select o_orderkey, c_name from customer right join orders on c_custkey = o_custkey")
def ext_join_right_all(spark, d):
    c, o = _table(spark, d, "customer"), _table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "right").select("o_orderkey", "c_name")


@_frame("ext_join_full_all", "select c_custkey, s_suppkey from customer full join supplier on c_custkey = s_suppkey")
def ext_join_full_all(spark, d):
    c, s = _table(spark, d, "customer"), _table(spark, d, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "full").select("c_custkey", "s_suppkey")


@_frame("ext_join_using", "select n_nationkey, n_name, count(*) as n from nation join (select c_nationkey as n_nationkey from customer) using (n_nationkey) group by n_nationkey, n_name")
def ext_join_using(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return X.join(_table(spark, d, "nation"), c, ["n_nationkey"]).groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@_frame("ext_join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 1000)")
def ext_join_semi(spark, d):
    c, o = _table(spark, d, "customer"), _table(spark, d, "orders").where("o_totalprice > 1000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@_frame("ext_join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def ext_join_anti(spark, d):
    c, o = _table(spark, d, "customer"), _table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@_frame("ext_join_range_all", "select p_partkey, b.lo from part join (select p_size as lo, p_size + 5 as hi from part) b on p_retailprice % 60 >= b.lo and p_retailprice % 60 < b.hi")
def ext_join_range_all(spark, d):
    p = _table(spark, d, "part")
    ranges = p.select(F.col("p_size").alias("lo"), (F.col("p_size") + 5).alias("hi"))
    return X.range_join(p.select("p_partkey", (F.col("p_retailprice") % 60).alias("x")), ranges, "x", "lo", "hi", 5).select("p_partkey", "lo")


@_frame("ext_join_asof", "select a.event_id, b.event_id as before_id from (select * from events where event_type = 'purchase') a asof left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and a.event_id >= b.event_id")
def ext_join_asof(spark, d):
    ev = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    clicks = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("before_id"))
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id")
    return X.asof_join(left, clicks, ["user_id"], "event_id", "before_id", ["before_id"]).select("event_id", "before_id")


@_frame(
    "ext_window_rank",
    "select o_orderkey, row_number() over w as rn, rank() over w2 as rk, dense_rank() over w2 as dr, ntile(4) over w as nt, round(percent_rank() over w2, 6) as pr, round(cume_dist() over w2, 6) as cd from orders window w as (partition by o_orderstatus order by o_totalprice, o_orderkey), w2 as (partition by o_orderstatus order by o_custkey)",
)
def ext_window_rank(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    n, k = o.count(), ["o_orderstatus", "o_custkey"]
    peers = X.running_sums(o.select(*k).repartition(n // X.BIN + 1, *k).groupBy(*k).agg(F.count(F.lit(1)).alias("same")), k[:1], k[1:], {"upto": F.col("same"), "dr": F.lit(1)}, n)
    peers = peers.select(F.col(k[0]).alias("s"), F.col(k[1]).alias("c"), (F.col("upto") - F.col("same") + 1).alias("rk"), "dr", "upto")
    rows = X.running_sums(o, k[:1], ["o_totalprice", "o_orderkey"], {"rn": F.lit(1)}, n)
    out = rows.join(peers, rows[k[0]].eqNullSafe(peers.s) & rows[k[1]].eqNullSafe(peers.c))
    # of the four tiles the first rn_all % 4 have one row more
    nt = "if(rn <= rn_all % 4 * (rn_all div 4 + 1), (rn - 1) div (rn_all div 4 + 1), (rn - 1 - rn_all % 4) div (rn_all div 4)) + 1"
    return out.selectExpr(
        "o_orderkey", "cast(rn as int) as rn", "cast(rk as int) as rk", "cast(dr as int) as dr", f"cast({nt} as int) as nt", "round(if(rn_all = 1, 0D, (rk - 1) / (rn_all - 1)), 6) as pr", "round(upto / rn_all, 6) as cd",
    )


@_frame("ext_window_lag_frame", "select o_orderkey, lag(o_orderkey) over w as lg, lead(o_orderkey, 2) over w as ld, first_value(o_orderkey) over w as fv, nth_value(o_orderkey, 2) over w as nv, sum(o_custkey) over (w rows between 2 preceding and current row)::bigint as s from orders window w as (partition by o_custkey order by o_orderkey)")
def ext_window_lag(spark, d):
    o, w = _table(spark, d, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("lg"), F.lead("o_orderkey", 2).over(w).alias("ld"), F.first("o_orderkey").over(w).alias("fv"), F.nth_value("o_orderkey", 2).over(w).alias("nv"), F.sum("o_custkey").over(w.rowsBetween(-2, 0)).alias("s"))


@_frame("ext_top_per_group", "select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 2")
def ext_top(spark, d):
    return X.top_per_group(_table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@_frame(
    "ext_agg_stats",
    "select p_size, round(avg(p_retailprice), 4) as a, min(p_retailprice) as lo, max(p_retailprice) as hi, round(var_pop(p_retailprice), 4) as vp, round(var_samp(p_retailprice), 4) as vs, round(stddev_pop(p_retailprice), 4) as sp, round(stddev_samp(p_retailprice), 4) as ss, bit_and(p_partkey) as ba, bit_or(p_partkey) as bo, bit_xor(p_partkey) as bx, string_agg(p_brand, ',' order by p_brand) as gc from part group by p_size",
)
def ext_stats(spark, d):
    g = _table(spark, d, "part").groupBy("p_size")
    r = "p_retailprice"
    return g.agg(
        F.round(F.avg(r), 4).alias("a"), F.min(r).alias("lo"), F.max(r).alias("hi"), F.round(F.var_pop(r), 4).alias("vp"), F.round(F.when(F.count(r) > 1, F.var_samp(r)), 4).alias("vs"), F.round(F.stddev_pop(r), 4).alias("sp"),
        F.round(F.when(F.count(r) > 1, F.stddev_samp(r)), 4).alias("ss"), F.bit_and("p_partkey").alias("ba"), F.bit_or("p_partkey").alias("bo"), F.bit_xor("p_partkey").alias("bx"), F.expr("listagg(p_brand, ',') within group (order by p_brand)").alias("gc"),
    )


@_frame("ext_rollup", "select l_returnflag, l_linestatus, count(*) as n, grouping(l_linestatus)::int as g from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return _table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_linestatus").cast("int").alias("g"))


@_frame("ext_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def ext_cube(spark, d):
    return _table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_frame("ext_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def ext_grouping_sets(spark, d):
    return spark.sql("select l_returnflag, l_linestatus, count(*) as n from {t} group by grouping sets ((l_returnflag), (l_linestatus), ())", t=_table(spark, d, "lineitem"))


@_frame("ext_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def ext_intersect(spark, d):
    return _table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(_table(spark, d, "supplier").select("s_nationkey"))


@_frame("ext_except", "select c_nationkey as k from customer except select s_nationkey from supplier")
def ext_except(spark, d):
    return X.null_safe_join(_table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _table(spark, d, "supplier").select("s_nationkey"), "left_anti").distinct()


@_frame("ext_intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def ext_intersect_all(spark, d):
    return _table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(_table(spark, d, "supplier").select("s_nationkey"))


@_frame("ext_except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
def ext_except_all(spark, d):
    return _table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(_table(spark, d, "supplier").select("s_nationkey"))


_SUBQUERY = "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) from orders) and o_custkey in (select c_custkey from customer where c_acctbal > 0)"


@_frame("ext_subquery", _SUBQUERY)
def ext_subquery(spark, d):
    return spark.sql(_SUBQUERY.replace("from orders", "from {o}").replace("from customer", "from {c}"), o=_table(spark, d, "orders"), c=_table(spark, d, "customer"))


@_frame("ext_tumbling", "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, count(*) as n from events group by 1, 2")
def ext_tumbling(spark, d):
    from .streaming.runner import windowed

    out = windowed(_table(spark, d, "events"), "ts", "6 hours", keys=["event_type"], aggregates=[F.count(F.lit(1)).alias("n")])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_frame("ext_sliding", "select s as start, count(*) as n from (select unnest([time_bucket(interval '3 hours', ts, timestamp '1970-01-01'), time_bucket(interval '3 hours', ts, timestamp '1970-01-01') - interval '3 hours']) as s from events) group by s")
def ext_sliding(spark, d):
    from .streaming.runner import windowed

    return windowed(_table(spark, d, "events"), "ts", "6 hours", "3 hours", aggregates=[F.count(F.lit(1)).alias("n")]).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@_frame(
    "ext_session",
    "select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as fresh from events)) group by user_id, s",
)
def ext_session(spark, d):
    from .streaming.runner import sessions

    out = sessions(_table(spark, d, "events"), "ts", "12 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@_frame("ext_udf", "select p_partkey, p_size * p_size + 1 as y from part")
def ext_udf(spark, d):
    @F.pandas_udf("bigint")
    def square_plus_one(x: pd.Series) -> pd.Series:
        return x.astype("int64") ** 2 + 1

    return _table(spark, d, "part").select("p_partkey", square_plus_one("p_size").alias("y"))


@_frame("ext_udtf_all", "select o_orderkey, p as part from orders, unnest(string_split(o_orderpriority, '-')) as t(p)")
def ext_udtf_all(spark, d):
    from pyspark.sql.functions import udtf

    @udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for p in (text or "").split("-"):
                yield (p,)

    spark.udtf.register("parts_of", Parts)
    return spark.sql("select o_orderkey, part from {o}, lateral parts_of(o_orderpriority)", o=_table(spark, d, "orders"))


@_frame("ext_salted_sums", "select o_orderstatus, sum(o_custkey)::bigint as total from orders group by o_orderstatus")
def ext_salted(spark, d):
    return X.salted_counts(_table(spark, d, "orders"), ["o_orderstatus"], [("o_custkey", "total")])


@_frame("ext_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def ext_json(spark, d):
    return _table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))

"""Domain tables (observations, sites, cells, fluxes, footprints ...) as views of the test tables.

The SQL runs unchanged in Spark and DuckDB; `{name}` stands for a test table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plumeline.sources.shared import dealt

VIEWS: dict[str, str] = {
    "fx_obs": """
select o_orderkey as obsid, o_orderdate as time, cast(o_custkey % 25 as int) as site,
       concat('s', lpad(cast(o_custkey % 25 as string), 2, '0')) as code,
       case when o_orderstatus = 'P' then 'ch4' else 'co2' end as tracer,
       cast(10 * (1 + (o_custkey % 25) % 10) as double) as height,
       o_totalprice / 1000 as obs,
       case when o_orderpriority like '1%' then cast(-10 as double) else 1 + cast(o_orderkey % 7 as double) / 2 end as err_obs,
       case when o_orderkey % 19 = 0 then null else cast(400 + o_orderkey % 11 as double) end as mix_background
from {orders}""",
    "fx_obs_ts": """
select event_id as obsid, ts as time, concat('u', lpad(cast(user_id % 25 as string), 2, '0')) as code,
       value as obs, value * 9 / 10 + cast(event_id % 13 as double) as mix_apri,
       case when event_id % 17 = 0 then cast(-10 as double) when event_id % 29 = 0 then cast(0 as double)
            else (2 + cast(event_id % 5 as double)) / 4 end as err_obs
from {events}""",
    "fx_sites": """
select n_nationkey as site, concat('s', lpad(cast(n_nationkey as string), 2, '0')) as code, n_name as name, r_name as region,
       cast(34 + (n_nationkey * 7) % 38 as double) as lat, cast(-14 + (n_nationkey * 11) % 48 as double) as lon,
       cast(100 * (n_nationkey % 9) as double) as alt,
       cast((11 + n_nationkey * 5) % 24 as int) as assim_start, cast((15 + n_nationkey * 5) % 24 as int) as assim_end
from {nation} join {region} on n_regionkey = r_regionkey""",
    "fx_cell": """
select ilat, ilon, ilat * 10 + ilon as icell, cast(33 + 5 * ilat as double) as lat_s, cast(38 + 5 * ilat as double) as lat_n,
       cast(-15 + 5 * ilon as double) as lon_w, cast(-10 + 5 * ilon as double) as lon_e,
       cast(6378100 as double) * 6378100 * radians(cast(5 as double))
         * (sin(radians(cast(38 + 5 * ilat as double))) - sin(radians(cast(33 + 5 * ilat as double)))) as area,
       cast((ilat * 7 + ilon * 3) % 5 as double) / 4 as land_fraction
from (select distinct cast(p_partkey % 8 as int) as ilat from {part}) a
cross join (select distinct cast(p_partkey % 10 as int) as ilon from {part}) b""",
    "fx_time": """
select itim, make_date(1995 + cast(floor(cast(itim as double) / 12) as int), itim % 12 + 1, 1) as t0,
       cast(day(last_day(make_date(1995 + cast(floor(cast(itim as double) / 12) as int), itim % 12 + 1, 1))) as double) * 86400 as dt
from (select distinct cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as itim from {lineitem}) t""",
    "fx_flux": """
select case when l_linestatus = 'F' then 'ch4' else 'co2' end as tracer,
       case l_returnflag when 'A' then 'fossil' when 'R' then 'fires' else 'biosphere' end as category,
       cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as itim,
       cast(l_partkey % 8 as int) as ilat, cast(l_suppkey % 10 as int) as ilon,
       sum(case when l_returnflag = 'N' then -l_extendedprice else l_extendedprice end) / 1000 as flux
from {lineitem} group by 1, 2, 3, 4, 5""",
    "fx_footprint": """
select l_orderkey as obsid, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as itim,
       cast(l_partkey % 8 as int) as ilat, cast(l_suppkey % 10 as int) as ilon, sum(l_discount * l_quantity) / 1000 as sensi
from {lineitem} group by 1, 2, 3, 4""",
    "fx_metacat_terms": """
select 'total' as meta, 'fossil' as category, cast(1 as double) as coeff
union all select 'total', 'fires', cast(1 as double)
union all select 'anthrop', 'fossil', cast(1 as double)
union all select 'anthrop', 'fires', cast(2 as double) / 5
union all select 'net', 'fossil', cast(1 as double)
union all select 'net', 'biosphere', cast(-1 as double)""",
    "fx_endpoints": """
select event_id as particle, event_id % 500 as obsid, cast(-15 as double) + cast((event_id * 37) % 500 as double) / 10 as lon,
       cast(33 as double) + cast((event_id * 53) % 400 as double) / 10 as lat, value * 10 as height, ts as time
from {events}""",
    "fx_conc": """
select cast(p_size % 6 as int) as ilev, cast(500 * (p_size % 6) as double) as height, 400 + avg(p_retailprice) / 100 as value
from {part} group by 1, 2""",
    "fx_conc4": """
select t.itime, t.time, a.ilat, cast(71 as double) / 2 + 5 * a.ilat as lat, b.ilon, -cast(25 as double) / 2 + 5 * b.ilon as lon, l.ilev,
       l.height * cast(100 + (a.ilat * 3 + b.ilon + t.itime) % 7 as double) / 100 + cast(50 * ((a.ilat + b.ilon) % 4) as double) as height,
       l.value + cast((a.ilat * 5 + b.ilon * 3 + t.itime) % 11 as double) / 10 as value
from (select time, cast(row_number() over (order by time) - 1 as int) as itime from (select distinct cast(date_trunc('day', ts) as timestamp) as time from {events}) d) t
cross join (select distinct cast(p_partkey % 8 as int) as ilat from {part}) a
cross join (select distinct cast(p_partkey % 10 as int) as ilon from {part}) b
cross join (select cast(p_size % 6 as int) as ilev, cast(500 * (p_size % 6) as double) as height, 400 + avg(p_retailprice) / 100 as value from {part} group by 1, 2) l""",
    "fx_polygons": """
select n_nationkey as polygon, 0 as ring, 0 as seq, cast(-14 + (n_nationkey * 11) % 48 as double) + -1 * (2 + n_nationkey % 5) as lon, cast(34 + (n_nationkey * 7) % 38 as double) + cast(0 * (2 + n_nationkey % 5) as double) / 2 as lat from {nation}
union all select n_nationkey as polygon, 0 as ring, 1 as seq, cast(-14 + (n_nationkey * 11) % 48 as double) + 0 * (2 + n_nationkey % 5) as lon, cast(34 + (n_nationkey * 7) % 38 as double) + cast(2 * (2 + n_nationkey % 5) as double) / 2 as lat from {nation}
union all select n_nationkey as polygon, 0 as ring, 2 as seq, cast(-14 + (n_nationkey * 11) % 48 as double) + 1 * (2 + n_nationkey % 5) as lon, cast(34 + (n_nationkey * 7) % 38 as double) + cast(0 * (2 + n_nationkey % 5) as double) / 2 as lat from {nation}
union all select n_nationkey as polygon, 0 as ring, 3 as seq, cast(-14 + (n_nationkey * 11) % 48 as double) + 0 * (2 + n_nationkey % 5) as lon, cast(34 + (n_nationkey * 7) % 38 as double) + cast(-1 * (2 + n_nationkey % 5) as double) / 2 as lat from {nation}""",
    "fx_positions": """
select c_custkey as ipos, cast(-85 as double) + cast((c_custkey * 37) % 1701 as double) / 10 as lat,
       cast(-180 as double) + cast((c_custkey * 101) % 3600 as double) / 10 as lon
from {customer}""",
}


def names_in(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the test tables of a folder."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "fx_footprint":  # its sums, and all that goes by observation after them, need no other shuffle
        tables["lineitem"] = dealt(tables["lineitem"], "l_orderkey")
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """SQL over domain tables as one statement over test tables, for DuckDB."""
    own = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names_in(sql)]
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return "WITH " + ", ".join(own + [sql[5:]])
    return (f"WITH {', '.join(own)} " if own else "") + sql

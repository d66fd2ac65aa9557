"""Registered queries of the cost models, with their SQL.

Customers are clients, orders their updates and lines the routes' inputs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cost
from ..sources.builds import many_parts, table

_ROUTES = [("full", 0, 16), ("bootstrap", 1, 32), ("chunks", 2, 64), ("hybrid", 3, 64), ("plan", 4, 40), ("patch", 5, 256)]


def _routes(spark, sf_dir):
    """Six routes for each customer, with figures from its key and balance."""
    c = many_parts(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 1 << 20).select(F.col("c_custkey").alias("client"), (F.floor(F.abs("c_acctbal")) * 40_000 + 1_000_000).cast("long").alias("size"))
    k, i = F.col("client"), F.col("pos")
    r = c.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("route"), F.lit(p).alias("pos"), F.lit(m).alias("mib")) for n, p, m in _ROUTES])).alias("r")).select("client", "size", "r.*")
    return r.select(
        "client", "route", "pos", ((k + i) % 7 != 0).alias("available"), F.floor(F.col("size") / (i + 1)).cast("long").alias("network_bytes"), ((k * (i + 3)) % 900).alias("apply_ms"), (F.col("mib").cast("long") * cost.MIB).alias("ram"),
        F.when(i == 0, 0).when(i >= 4, F.floor(F.col("size") / 4)).otherwise(F.col("size")).cast("long").alias("temp"), F.when(i >= 3, F.col("size")).otherwise(0).cast("long").alias("disk_read"), ((k + i) % 4 + 1).alias("steps"), F.lit(0).alias("build_ms"), (k % 11 == 0).alias("same"),
    )


_ROUTES_SQL = """c as (select c_custkey as client, (floor(abs(c_acctbal)) * 40000 + 1000000)::bigint as size from customer),
r as (select client, route, pos, (client + pos) % 7 <> 0 as available, floor(size / (pos + 1)::double)::bigint as network_bytes, (client * (pos + 3)) % 900 as apply_ms, mib::bigint * 1048576 as ram,
  case when pos = 0 then 0 when pos >= 4 then size // 4 else size end::bigint as temp, case when pos >= 3 then size else 0 end::bigint as disk_read, (client + pos) % 4 + 1 as steps, client % 11 = 0 as same
  from c, (values ('full', 0, 16), ('bootstrap', 1, 32), ('chunks', 2, 64), ('hybrid', 3, 64), ('plan', 4, 40), ('patch', 5, 256)) v(route, pos, mib))"""


def _scored_sql(policy: str, slow_hdd: bool, low_disk: bool, low_ram: bool) -> str:
    net, apply, ram, temp, read, _ = cost.POLICIES[policy]
    temp = max(temp, 1.0) * 20 if low_disk else temp
    hdd = "+ 5 * (temp / 1048576.0::double + disk_read / 1048576.0::double)" if slow_hdd else ""
    return f"""with {_ROUTES_SQL}, s as (select *, case when available and ram <= {128 << 20 if low_ram else 1 << 30} then round(network_bytes / 1048576.0::double * {net}::double + apply_ms * {apply}::double + ram / 1048576.0::double * {ram}::double + temp / 1048576.0::double * {temp}::double
      + disk_read / 1048576.0::double * {read}::double {hdd} + 25.0::double * greatest(steps - 1, 0), 9) else 'inf'::double end as score from r)
      select client, route, score, row_number() over (partition by client order by score, pos) = 1 and score < 'inf'::double as chosen from s"""


def route_scoring(spark, sf_dir):
    return cost.score_routes(_routes(spark, sf_dir), "balanced").select("client", "route", "score", "chosen")


def route_scoring_slow_disk(spark, sf_dir):
    """A client with a slow and nearly full disk and little memory."""
    return cost.score_routes(_routes(spark, sf_dir), "hdd_friendly", slow_hdd=True, low_disk=True, low_ram=True).select("client", "route", "score", "chosen")


def near_tie_routes(spark, sf_dir):
    return cost.near_tie(_routes(spark, sf_dir))


def client_profile_plan(spark, sf_dir):
    return cost.client_plan(_routes(spark, sf_dir), "low-memory")


def io_estimate(spark, sf_dir):
    """Suppliers' parts as routes on each kind of device."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("route")).agg(F.sum(F.col("l_quantity").cast("long") * 1_000_000).alias("read"), F.sum(F.floor(F.col("l_extendedprice")) * 1000).cast("long").alias("write"), F.sum(F.col("l_linenumber").cast("long") * 50_000).alias("download"), F.count(F.lit(1)).alias("seeks"))
    return cost.io_estimate(x.withColumn("new_size", F.col("write") * 4), spark.createDataFrame(cost.DEVICES, "device string, read_mbs double, write_mbs double, seek_ms double"))


def auto_profile(spark, sf_dir):
    """The profile that each customer's volume of orders would get."""
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.floor(F.col("o_totalprice")) * 200).cast("long").alias("size"))
    return x.select("o_custkey", cost.auto_profile(F.col("size")).alias("profile"))


def savings_estimate(spark, sf_dir):
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("item")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("full_bytes"), F.sum(F.col("o_orderkey") % 1000).alias("update_bytes"))
    return cost.savings(x, 0.08, 100_000)


def best_strategy(spark, sf_dir):
    """Per order the cheapest way to patch, with lines as candidates."""
    name = F.element_at(F.array(*[F.lit(s) for s in ("copy-old", "plan-ops", "xdelta3", "full-data", "bsdiff")]), ((F.col("l_linenumber") - 1) % 5 + 1).cast("int"))
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), name.alias("strategy"), F.floor(F.col("l_quantity") / 10).alias("bytes"))
    return cost.best_strategy(x)


def regression_compare(spark, sf_dir):
    """Metrics of suppliers in two halves of the lines."""
    x = table(spark, sf_dir, "lineitem").where("l_suppkey <= 60")
    suffix = F.when(F.col("l_suppkey") % 3 == 0, "_ms").when(F.col("l_suppkey") % 3 == 1, "_ram").otherwise("_bytes")
    of = lambda ok: x.where(ok).groupBy(F.concat(F.lit("m"), F.col("l_suppkey").cast("string"), suffix).alias("name")).agg(scalars.rounded(F.sum(F.col("l_quantity") * 1_000_000), 0).alias("value"))
    return cost.regressions(of(F.col("l_orderkey") % 2 == 0), of(F.col("l_orderkey") % 2 == 1), 0.05, ("m7_ram",))


QUERIES = {f.__name__: f for f in (route_scoring, route_scoring_slow_disk, near_tie_routes, client_profile_plan, io_estimate, auto_profile, savings_estimate, best_strategy, regression_compare)}

ORACLE_SQL = {
    "route_scoring": _scored_sql("balanced", False, False, False),
    "route_scoring_slow_disk": _scored_sql("hdd_friendly", True, True, True),
    "near_tie_routes": f"""with {_ROUTES_SQL}, m as (select *, min(network_bytes) over (partition by client) as least from r where available), k as (select *, row_number() over (partition by client order by route <> 'plan', network_bytes, pos) as k from m where network_bytes <= least + least // 50) select client, route, network_bytes from k where k = 1""",
    "client_profile_plan": f"""with {_ROUTES_SQL}, s as (select *, case when available and ram <= 134217728 then round(network_bytes * 1.0::double + apply_ms * 100.0::double + temp * 0.01::double, 6) else 'inf'::double end as score from r),
        b as (select client, min(struct_pack(score := score, pos := pos, route := route)) as b, bool_or(same) as same from s group by client) select client, case when same then 'no-op' when b.score = 'inf'::double then 'none' else b.route end as route, case when same then 0.0 else b.score end as score from b""",
    "io_estimate": """with x as (select l_suppkey::varchar as route, sum(l_quantity::bigint * 1000000)::bigint as read, sum(floor(l_extendedprice) * 1000)::bigint as write, sum(l_linenumber::bigint * 50000)::bigint as download, count(*) as seeks from lineitem group by 1)
        select route, device, round(read / 1048576.0::double / r + (write / 1048576.0::double + download / 1048576.0::double) / w + seeks * s / 1000, 9) as seconds, read + write > greatest(write * 4, 1) as dominates from x, (values ('hdd', 120.0::double, 100.0::double, 8.0::double), ('sata_ssd', 500.0, 450.0, 0.1), ('nvme', 3500.0, 2500.0, 0.02)) d(device, r, w, s)""",
    "auto_profile": "with x as (select o_custkey, sum(floor(o_totalprice) * 200)::bigint as size from orders group by 1) select o_custkey, case when size < 134217728 then 'fastcdc-16k' when size < 536870912 then 'fastcdc-64k' else 'fastcdc-128k' end as profile from x",
    "savings_estimate": """with x as (select o_orderpriority as item, sum(floor(o_totalprice))::bigint / 1073741824.0::double * 100000 * 0.08::double as f, sum(o_orderkey % 1000)::bigint / 1073741824.0::double * 100000 * 0.08::double as u from orders group by 1)
        select item, round(f, 9) as full_cost, round(u, 9) as update_cost, round(f - u, 9) as saved, round(case when f > 0 then (f - u) / f * 100 else 0 end, 6) as saved_pct from x""",
    "best_strategy": """with x as (select l_orderkey as file, (l_linenumber - 1) % 5 as rank, floor(l_quantity / 10)::bigint as bytes from lineitem), m as (select file, min(struct_pack(b := bytes, r := rank)) as m from x group by file)
        select file, case m.r when 0 then 'copy-old' when 1 then 'plan-ops' when 2 then 'xdelta3' when 3 then 'full-data' else 'bsdiff' end as strategy, m.b as bytes from m""",
    "regression_compare": """with x as (select 'm' || l_suppkey || case l_suppkey % 3 when 0 then '_ms' when 1 then '_ram' else '_bytes' end as name, round(sum(l_quantity * 1000000) filter (l_orderkey % 2 = 0), 0) as value, round(sum(l_quantity * 1000000) filter (l_orderkey % 2 = 1), 0) as base from lineitem where l_suppkey <= 60 group by 1)
        select name, round(value, 6) as value, round(base, 6) as base, case when base > 0 then round((value - base) / base, 9) end as change, case when base <= 0 then 'skipped' when name = 'm7_ram' then 'excepted'
        when (value - base) / base <= 0.05 or value - base <= case when name like '%\\_ms' escape '\\' then 250.0 when name like '%ram%' then 33554432.0 else 0.0 end then 'pass' else 'fail' end as result from x where value is not null and base is not null""",
}

"""Registered queries over version graphs, with their SQL.

Twelve versions; an edge's bytes follow from its ends, and version i has
1,000,000 + 37,000 i bytes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph
from ..sources.builds import table

N = 12
USERS = 100_000


def _bytes(pairs):
    d = F.col("dst") - F.col("src")
    return pairs.withColumn("bytes", (F.lit(40_000) + 9_000 * F.abs(d) + (F.col("src") * 7919 + F.col("dst") * 104729) % 23_000).cast("long"))


def _nodes(spark):
    return spark.range(N).select("id", (F.lit(1_000_000) + 37_000 * F.col("id")).alias("full"))


def _policies(spark):
    named = {"adjacent": graph.adjacent(spark, N), "ladder": graph.ladder(spark, N), "hub": graph.base_hub(spark, N, 0, True), "hot": graph.hot_latest(spark, N, 4), "all": graph.all_pairs(spark, N)}
    out = None
    for name, pairs in named.items():
        x = pairs.select(F.lit(name).alias("policy"), "src", "dst")
        out = x if out is None else out.unionByName(x)
    return out


def pair_generators(spark, sf_dir):
    """How many edges each policy keeps, and their reach."""
    return _policies(spark).groupBy("policy").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.abs(F.col("dst") - F.col("src"))).alias("reach"))


def ladder_pairs(spark, sf_dir):
    return graph.ladder(spark, N)


def ladder_dense(spark, sf_dir):
    return graph.ladder(spark, N, dense=True)


def edge_pool(spark, sf_dir):
    return graph.edge_pool(_policies(spark))


def traffic_expand(spark, sf_dir):
    t = graph.traffic(spark, "adjacent-heavy", N)
    return t.withColumn("probability", scalars.rounded("probability", 9))


def cheapest_path(spark, sf_dir):
    """From every version to every later one over ladder edges."""
    return graph.cheapest_paths(_bytes(graph.ladder(spark, N)), spark.range(N).select(F.col("id").alias("src")))


def explain_path(spark, sf_dir):
    return graph.explain_path(_bytes(graph.ladder(spark, N)), 1, 11)


def simulate_policy(spark, sf_dir):
    """The built-in adjacent-heavy traffic priced under each policy."""
    pol = _policies(spark)
    names = ("adjacent", "ladder", "hub", "hot", "all")
    each = lambda df: df.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("policy"))
    paths = graph.cheapest_paths(_bytes(pol), each(spark.range(N).select(F.col("id").alias("src"))), by=("policy",))
    queries = each(graph.traffic(spark, "adjacent-heavy", N))
    return graph.policy_summary(graph.simulate(queries, paths, _nodes(spark)), USERS)


def weighted_percentiles(spark, sf_dir):
    """Medians and tails of order lines' quantities weighted by their price, by return flag."""
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.floor("l_extendedprice").alias("w"))
    out = None
    for q in (0.5, 0.95, 0.99):
        p = graph.weighted_percentile(x, ["l_returnflag"], "l_quantity", "w", q).withColumn("q", F.lit(q))
        out = p if out is None else out.unionByName(p)
    return out


def hot_pairs_topk(spark, sf_dir):
    return graph.hot_pairs(graph.traffic(spark, "skip-heavy", N), 5).select("src", "dst")


def _versions(spark):
    suffix = F.when(F.col("id") % 5 == 3, "-beta").when(F.col("id") == 11, "-rc1").otherwise("")
    return spark.range(N).select(F.concat(F.lit("v"), F.floor(F.col("id") / 4).cast("string"), F.lit("."), F.col("id").cast("string"), suffix).alias("id"), F.col("id").alias("idx"))


def plan_pairs(spark, sf_dir):
    v = _versions(spark)
    shares = v.select("id", ((F.col("idx") * 5) % 7 / 100.0).alias("share"))
    pinned = spark.createDataFrame([("v0.1", "v2.11-rc1")], "src string, dst string")
    return graph.planned_pairs(v, shares, pinned, 6)


def latest_major(spark, sf_dir):
    """Documents of a source as versions whose major number is their length in thousands."""
    x = table(spark, sf_dir, "documents").select(F.col("source").alias("line"), F.col("doc_id").alias("idx"), F.concat(F.lit("v"), F.floor(F.col("n_chars") / 1000).cast("string"), F.lit(".0")).alias("id"))
    return graph.latest_major(x)


def base_choice(spark, sf_dir):
    """The base version through which adjacent-heavy traffic is cheapest: two hub edges for each update."""
    t = graph.traffic(spark, "adjacent-heavy", N).where("src <> dst").crossJoin(spark.range(N).select(F.col("id").alias("base")))  # bases are versions, a dozen
    leg = lambda a, b: F.when(a == b, 0).otherwise(F.lit(40_000) + 9_000 * F.abs(b - a) + (a * 7919 + b * 104729) % 23_000)
    return graph.base_choice(t.withColumn("bytes", leg(F.col("src"), F.col("base")) + leg(F.col("base"), F.col("dst"))))


def nearest_stable(spark, sf_dir):
    """Versions whose label is stable."""
    return _versions(spark).where(~F.lower("id").rlike("beta|alpha|rc|-"))


QUERIES = {f.__name__: f for f in (pair_generators, ladder_pairs, ladder_dense, edge_pool, traffic_expand, cheapest_path, explain_path, simulate_policy, weighted_percentiles, hot_pairs_topk, plan_pairs, latest_major, base_choice, nearest_stable)}

_LADDER = "ladder as (select distinct k * d as src, k * d + d as dst from (select (2 ** i)::bigint as d from range(0, 4) t(i)), range(0, 12) u(k) where k * d + d < 12)"
_POL = f"""{_LADDER}, pol as (select 'adjacent' as policy, i as src, i + 1 as dst from range(0, 11) t(i) union all select 'ladder', src, dst from ladder
  union all select 'hub', 0, i from range(1, 12) t(i) union all select 'hub', i, 0 from range(1, 12) t(i)
  union all (select 'hot', i, i + 1 from range(0, 11) t(i) union select 'hot', 11 - k, 11 from range(2, 5) t(k)) union all select 'all', i, j from range(0, 12) t(i), range(0, 12) u(j) where i < j)"""


def _traffic(rules: str) -> str:
    return f"""rules(pos, kind, lo, hi, age, p) as (values {rules}),
prs as (select i as src, j as dst from range(0, 12) t(i), range(0, 12) u(j) where i < j or (i = 11 and j = 11)),
hit as (select src, dst, pos, kind, p / count(*) over (partition by pos) as p from prs, rules where (kind = 'adjacent' and dst - src = 1) or (kind = 'skip_range' and dst - src between lo and hi)
  or (kind = 'old_to_latest' and dst = 11 and dst - src >= greatest(age, 1)) or (kind = 'reinstall_latest' and dst = src)),
tr as (select src, dst, sum(p) / (select sum(p) from hit) as probability, string_agg(kind, '+' order by pos) as rule from hit group by src, dst)"""


_ADJ = _traffic("(0, 'adjacent', 0, 0, 0, 0.80::double), (1, 'skip_range', 2, 4, 0, 0.15), (2, 'old_to_latest', 0, 0, 6, 0.04), (3, 'reinstall_latest', 0, 0, 0, 0.01)")
_SKIP = _traffic("(0, 'adjacent', 0, 0, 0, 0.40::double), (1, 'skip_range', 2, 8, 0, 0.40), (2, 'old_to_latest', 0, 0, 6, 0.15), (3, 'reinstall_latest', 0, 0, 0, 0.05)")
_COST = "(40000 + 9000 * abs({b} - {a}) + ({a} * 7919 + {b} * 104729) % 23000)::bigint"
_EDGE = _COST.format(a="src", b="dst")
_PATHS = f"""le as (select src, dst, {_EDGE} as w from ladder), pth as (select i as src, i as dst, 0::bigint as bytes, 0 as steps from range(0, 12) t(i) union all select p.src, e.dst, p.bytes + e.w, p.steps + 1 from pth p join le e on e.src = p.dst),
best as (select src, dst, min(struct_pack(b := bytes, s := steps)) as m from pth group by src, dst)"""

ORACLE_SQL = {
    "pair_generators": f"with {_POL} select policy, count(*) as edges, sum(abs(dst - src))::bigint as reach from pol group by policy",
    "ladder_pairs": f"with {_LADDER} select * from ladder",
    "ladder_dense": "select distinct i as src, i + d as dst from range(0, 12) t(i), (values (1), (2), (4), (8)) v(d) where i + d < 12",
    "edge_pool": f"with {_POL} select src, dst, string_agg(policy, ',' order by policy) as policies from pol group by src, dst",
    "traffic_expand": f"with {_ADJ} select src, dst, round(probability, 9) as probability, rule from tr",
    "cheapest_path": f"with recursive {_LADDER}, {_PATHS} select src, dst, m.b as bytes, m.s as steps from best",
    "explain_path": f"""with recursive {_LADDER}, le as (select src, dst, {_EDGE} as w from ladder), pth as (select 1::bigint as node, 0::bigint as bytes, 0 as steps, []::bigint[] as via union all select e.dst, p.bytes + e.w, p.steps + 1, list_append(via, e.src) from pth p join le e on e.src = p.node),
        b as (select via from pth where node = 11 order by bytes, steps limit 1), h as (select unnest(generate_series(1, len(via)))::int as hop, via from b), x as (select hop, via[hop] as src, coalesce(via[hop + 1], 11) as dst from h) select hop, src, dst, {_EDGE} as bytes from x""",
    "simulate_policy": f"""with recursive {_POL}, {_ADJ}, pe as (select policy, src, dst, {_EDGE} as w from pol),
        pth as (select distinct policy, src as s, src as d, 0::bigint as bytes, 0 as steps from pe union all select p.policy, p.s, e.dst, p.bytes + e.w, p.steps + 1 from pth p join pe e on e.policy = p.policy and e.src = p.d where p.policy <> 'hub' or p.steps < 2),
        best as (select policy, s, d, min(struct_pack(b := bytes, s := steps)) as m from pth where s <> d group by all), n as (select distinct policy from pe),
        o as (select n.policy, tr.src, tr.dst, tr.probability as p, case when tr.src <> tr.dst and m is not null then m.b else 1000000 + 37000 * tr.dst end as bytes, case when tr.src <> tr.dst and m is not null then m.s else 0 end as steps, tr.src = tr.dst or m is not null as covered
          from tr cross join n left join best on best.policy = n.policy and s = tr.src and d = tr.dst),
        v as (select policy, bytes, sum(sum(p)) over (partition by policy order by bytes) as acc, sum(sum(p)) over (partition by policy) as total from o group by policy, bytes),
        q as (select policy, min(bytes) filter (acc >= 0.5 * total - 1e-12) as median_bytes, min(bytes) filter (acc >= 0.95 * total - 1e-12) as p95_bytes, min(bytes) filter (acc >= 0.99 * total - 1e-12) as p99_bytes from v group by policy),
        a as (select policy, floor(round(sum(p * bytes) / sum(p), 6))::bigint as avg_bytes, max(bytes)::bigint as worst_bytes, round(sum(p * steps) / sum(p), 9) as avg_steps, max(steps) as max_steps, floor(round(100000 * (sum(p * bytes) / sum(p)), 3))::bigint as served_bytes, round(sum(case when covered then p else 0 end), 9) as coverage from o group by policy)
        select * from a join q using (policy)""",
    "weighted_percentiles": """with v as (select l_returnflag, l_quantity, sum(floor(l_extendedprice)) as w from lineitem group by all), c as (select *, sum(w) over (partition by l_returnflag order by l_quantity) as acc, sum(w) over (partition by l_returnflag) as total from v)
        select l_returnflag, min(l_quantity) as percentile, q::double as q from c, (values (0.5), (0.95), (0.99)) t(q) where acc >= q * total - 1e-12 group by l_returnflag, q""",
    "hot_pairs_topk": f"with {_SKIP} select src, dst from tr where dst - src > 1 order by round(probability, 12) desc, src, dst limit 5",
    "plan_pairs": """with v as (select 'v' || (i // 4) || '.' || i || case when i % 5 = 3 then '-beta' when i = 11 then '-rc1' else '' end as id, i as idx, (i * 5) % 7 / 100.0 as share from range(0, 12) t(i)),
        c as (select 0 as prio, 0.0 as r, 'v0.1' as src, 'pinned' as rule union all select 1, 0.0, id, 'previous' from v where idx = 10
          union all (select 2, 0.0, id, 'latest-stable' from v where idx < 11 and not regexp_matches(lower(id), 'beta|alpha|rc|-') order by idx desc limit 1) union all select 3, -share, id, 'top-installed' from v where idx < 11 and share > 0),
        e as (select src, min(struct_pack(prio := prio, r := r, rule := rule)) as m from c group by src), o as (select row_number() over (order by m.prio, m.r, src)::int as place, src, 'v2.11-rc1' as dst, m.rule as rule from e) select * from o where place <= 6""",
    "latest_major": """with x as (select source as line, doc_id as idx, n_chars // 1000 as major, lag(n_chars // 1000) over (partition by source order by doc_id) as before from documents)
        select line, coalesce(max(idx) filter (major > before), min(idx)) as idx from x group by line""",
    "base_choice": f"""with {_ADJ}, m as (select base, round(sum(probability * (case when src = base then 0 else {_COST.format(a='src', b='base')} end + case when base = dst then 0 else {_COST.format(a='base', b='dst')} end)) / sum(probability), 6) as mean
        from tr, range(0, 12) b(base) where src <> dst group by base) select base, mean from m order by mean, base limit 1""",
    "nearest_stable": "with v as (select 'v' || (i // 4) || '.' || i || case when i % 5 = 3 then '-beta' when i = 11 then '-rc1' else '' end as id, i as idx from range(0, 12) t(i)) select id, idx from v where not regexp_matches(lower(id), 'beta|alpha|rc|-')",
}

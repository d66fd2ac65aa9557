"""Registered queries of what happens between a store and its clients, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery, workspace
from ..sources import builds
from ..sources.builds import SQL, table
from .sessions import _requests

APPLY_RATE = 500 * 1024 * 1024 // 1000
LARGE = 300


def retry_schedule(spark, sf_dir):
    """Errors of each user as failed attempts, five to a request; high values stand for lost connections, low ones for answers that won't change."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    x = e.select("event_id", "value", ((nth - 1) % 5 + 1).alias("attempt"), (F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000 * 1000).alias("nanos"))
    status = F.when(F.col("value") > 50, F.lit(None).cast("int")).when(F.col("value") < 5, 404).otherwise(503)
    return x.select("event_id", "attempt", delivery.retry(status, F.col("attempt"), F.col("nanos")).alias("r")).select("event_id", "attempt", "r.outcome", "r.wait_ms")


def error_codes(spark, sf_dir):
    """Messages that hold a code, and some that don't."""
    codes = F.array(*[F.lit(f"{delivery.MARK}{c}") for c in (*delivery.ERROR_CODES, "NO-SUCH-CODE")])
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("fetch failed: caused by: "), F.element_at(codes, (F.col("p_partkey") % 39 + 1).cast("int")), F.lit(": "), "p_name").alias("message"))
    x = p.select("p_partkey", delivery.error_code(F.col("message")).alias("code"))
    return x.select("p_partkey", "code", delivery.error_flags(F.col("code")).alias("f")).select("p_partkey", "code", F.coalesce("f.retryable", F.lit(False)).alias("retryable"), F.coalesce("f.recoverable", F.lit(False)).alias("recoverable"))


def parsed_labels(spark, sf_dir):
    """Client states from customers' balances and segments, and platforms and engines in any case."""
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    text = F.concat(F.lit("warm-cache, "), F.when(bal > 5000, "cold-cache,").otherwise(""), F.when(bal < 2000, "low-ram , limited-disk").otherwise("previous-install"), F.when(seg == "FURNITURE", ",what").otherwise(""))
    x = table(spark, sf_dir, "customer").select("c_custkey", delivery.client_state(text).alias("s"), delivery.label(F.when(bal > 3000, "OSX").when(bal > 1000, "Win").otherwise("beos"), delivery.PLATFORMS).alias("platform"), delivery.label(seg, {"machinery": "custom", **delivery.ENGINES}, "auto").alias("engine"))
    return x.select("c_custkey", "s.*", "platform", "engine")


def name_rules(spark, sf_dir):
    """Which paths and types of parts may name an asset or an id."""
    name = F.concat("p_name", F.when(F.col("p_size") > 25, ".bin").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", delivery.asset_name_ok(name).alias("asset"), delivery.id_ok(F.replace(name, F.lit(" "), F.lit("_"))).alias("id"), delivery.id_ok(F.col("p_name")).alias("spaced"))


def negative_cache(spark, sf_dir):
    """Users' events as lookups of what isn't there: a miss is remembered for three hours."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("lookups"))
    return delivery.negative_cache(e, 3 * 3600)


def inflight_waves(spark, sf_dir):
    """Parts of a brand as groups of ranges under a budget; the largest exceed it."""
    x = table(spark, sf_dir, "part").select(F.col("p_brand").alias("stream"), F.col("p_partkey").alias("ord"), (F.col("p_size").cast("long") * 10).alias("len"))
    return delivery.inflight_waves(x, LARGE)


def request_counters(spark, sf_dir):
    """Requests and bytes by event type, hour by hour."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("at"), F.octet_length("props").cast("long").alias("bytes"))
    return delivery.counters(e)


def _batches(spark, sf_dir):
    plan = workspace.session_batches(_requests(table(spark, sf_dir, "events")).withColumn("payload", (F.col("seq") % 97).cast("string").cast("binary")), 4)
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("session", "batch").orderBy("seq")) - 1
    items = plan.select("session", F.lit("segment").alias("part"), F.col("batch").alias("id"), pos.alias("pos"), "hash", "kind", "payload")
    heads = plan.select("session").distinct().select("session", F.lit("init").alias("part"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("pos"), F.sha2(F.lit("head"), 256).alias("hash"), F.lit("inline").alias("kind"), F.lit("head" * 40).cast("binary").alias("payload"))
    return delivery.encode_batches(items.unionByName(heads))


def batch_round_trip(spark, sf_dir):
    """Sessions' replies as wire batches, decoded item by item."""
    x = delivery.decode_batches(_batches(spark, sf_dir))
    return x.select("session", "part", "id", "pos", "hash", "kind", "len_raw", F.col("payload").cast("string").alias("payload"))


def batch_rejection(spark, sf_dir):
    """Damaged batches: cut short, with another version, or with bytes behind them; none yields a whole reply."""
    b = _batches(spark, sf_dir)
    cut, n = F.substr("batch", F.lit(1), (F.length("batch") - 1)), F.length("batch")
    ways = {"cut": cut, "version": F.concat(F.substr("batch", F.lit(1), F.lit(4)), F.unhex(F.lit("63")), F.substr("batch", F.lit(6), n)), "behind": F.concat("batch", F.unhex(F.lit("00")))}
    out = None
    for name, damaged in ways.items():
        x = delivery.decode_batches(b.select("session", damaged.alias("batch"))).groupBy("session").agg(F.max(F.startswith("kind", F.lit("bad"))).alias("bad")).select(F.lit(name).alias("damage"), "session", "bad")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("damage").agg(F.count(F.lit(1)).alias("batches"), F.count_if("bad").alias("rejected"))


def _routes(spark, sf_dir):
    return delivery.collect_routes(builds.both_chunks(spark, sf_dir), {"has_previous_install": True}, APPLY_RATE, bootstrap_bytes=1_000_000)


def route_collection(spark, sf_dir):
    """Routes of a client with the old build and a cold cache; there is no plan."""
    return _routes(spark, sf_dir).drop("client")


def publish_preview(spark, sf_dir):
    from ..operators import analysis
    from .analysis import T, _signals

    return delivery.publish_preview(_routes(spark, sf_dir), analysis.detector_findings(_signals(spark, sf_dir), T))


def push_plan(spark, sf_dir):
    """New files as local objects against the old ones at the remote."""
    of = lambda b: b.select(F.sha2("content", 256).alias("oid"), F.octet_length("content").cast("long").alias("size"))
    return delivery.push_plan(of(builds.new_build(spark, sf_dir)), of(builds.old_build(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (retry_schedule, error_codes, parsed_labels, name_rules, negative_cache, inflight_waves, request_counters, batch_round_trip, batch_rejection, route_collection, publish_preview, push_plan)}

_CODES = ", ".join(f"'{c}'" for c in (*delivery.ERROR_CODES, "NO-SUCH-CODE"))
_ITEMS = """p as (select user_id as session, event_id as seq, sha256((event_id % 97)::varchar) as hash, (event_id % 97)::varchar as payload, case when row_number() over (partition by user_id, event_id % 97 order by event_id) = 1 then 'inline' else 'ref' end as kind from events),
q as (select *, ((greatest(sum(case when kind = 'inline' then 1 else 0 end) over (partition by session order by seq), 1) - 1) // 4)::bigint as id from p),
it as (select session, 'segment' as part, id, (row_number() over (partition by session, id order by seq) - 1)::int as pos, hash, kind, case when kind = 'inline' then length(payload) end::bigint as len_raw, case when kind = 'inline' then payload end as payload from q
  union all select distinct user_id, 'init', 0, 0, sha256('head'), 'inline', 160, repeat('head', 40) from events)"""
_ROUTES_SQL = f"""b as (select *, 0 as is_new from oc union all select *, 1 from nc), c as (select hash, max(len) as len, count(*) filter (is_new = 0) as n_old, count(*) filter (is_new = 1) as n_new from b group by hash),
e as (select sum(n_old * len)::bigint as o, sum(n_new * len)::bigint as n, coalesce(sum(len) filter (n_old = 0 and n_new > 0), 0)::bigint as fresh from c),
rt as (select 'full' as route, 0 as pos, true as available, n as network_bytes, 0::bigint as apply_ms, 16::bigint << 20 as ram, 0::bigint as temp, 0::bigint as disk_read, 1 as steps, 0 as build_ms from e
  union all select 'bootstrap', 1, true, 1000000, n // {APPLY_RATE}, 32::bigint << 20, n, 0, 1, 0 from e union all select 'chunks', 2, false, null, 0, 64::bigint << 20, 0, 0, 1, 0
  union all select 'hybrid', 3, true, fresh, n // {APPLY_RATE}, 64::bigint << 20, n, o, 1, 0 from e union all select 'plan', 4, false, null, 0, 40::bigint << 20, 0, 0, 1, 0)"""


def _preview_sql() -> str:
    from .analysis import _SIGNALS

    signals = _SIGNALS.replace("oc as (", "oc2 as (").replace("nc as (", "nc2 as (").replace("from oc)", "from oc2)").replace("from nc)", "from nc2)")
    return f"""with rts as (with {SQL}, {_ROUTES_SQL} select * from rt where available), fis as (with {signals} select kind, count(*) as n from fi group by kind)
        select 'route' as part, route as name, network_bytes as value from rts union all select 'finding', kind, n from fis union all (select 'recommended', route, network_bytes from rts order by network_bytes, pos limit 1)"""


ORACLE_SQL = {
    "retry_schedule": """with x as (select event_id, value, (row_number() over (partition by user_id order by event_id) - 1) % 5 + 1 as attempt, epoch_us(ts) % 1000000 * 1000 as nanos from events where event_type = 'error'),
        b as (select *, least(250 * 2 ** (attempt - 1), 8000)::bigint as base, case when value < 5 then 'fail' when attempt < 5 then 'retry' else 'give-up' end as outcome from x)
        select event_id, attempt::int as attempt, outcome, case when outcome = 'retry' then base - base // 4 + nanos % (base // 2) end as wait_ms from b""",
    "error_codes": f"""with c as (select p_partkey, [{_CODES}][p_partkey % 39 + 1] as code from part)
        select p_partkey, nullif(code, 'NO-SUCH-CODE') as code, code = 'NETWORK' as retryable, code in ('NETWORK', 'CACHE-CORRUPT-RECOVERABLE', 'PREVIOUS-ARTIFACT-MISSING', 'PREVIOUS-ARTIFACT-MISMATCH') as recoverable from c""",
    "parsed_labels": """select c_custkey, c_acctbal <= 5000 as warm_cache, c_acctbal >= 2000 as has_previous_install, c_acctbal < 2000 as low_ram, c_acctbal < 2000 as low_disk, false as slow_hdd, case when c_mktsegment = 'FURNITURE' then 'what' end as unknown,
        case when c_acctbal > 3000 then 'macos' when c_acctbal > 1000 then 'windows' end as platform, case when c_mktsegment = 'MACHINERY' then 'custom' else 'auto' end as engine from customer""",
    "name_rules": "select p_partkey, p_size <= 25 as asset, p_size <= 25 as id, false as spaced from part",
    "negative_cache": """with recursive e as (select user_id as key, floor(epoch(ts))::bigint as at_, count(*) as lookups from events group by all), o as (select *, row_number() over (partition by key order by at_) as rn from e),
        r as (select key, rn, at_, lookups, true as asked, at_ + 10800 as until from o where rn = 1 union all select o.key, o.rn, o.at_, o.lookups, o.at_ >= r.until, case when o.at_ >= r.until then o.at_ + 10800 else r.until end from r join o on o.key = r.key and o.rn = r.rn + 1)
        select key, at_ as at, lookups, asked from r""",
    "inflight_waves": f"""with recursive o as (select p_brand as stream, p_partkey as ord, p_size::bigint * 10 as len, row_number() over (partition by p_brand order by p_partkey) as rn from part),
        r as (select stream, rn, ord, len, least(len, {LARGE}) as used, 0::bigint as wave from o where rn = 1 union all select o.stream, o.rn, o.ord, o.len, case when r.used + least(o.len, {LARGE}) <= {LARGE} then r.used + least(o.len, {LARGE}) else least(o.len, {LARGE}) end,
          case when r.used + least(o.len, {LARGE}) <= {LARGE} then r.wave else r.wave + 1 end from r join o on o.stream = r.stream and o.rn = r.rn + 1) select stream, ord, len, wave from r""",
    "request_counters": """with x as (select event_type as name, floor(epoch(ts))::bigint // 3600 as at_, count(*) as n, sum(strlen(props)) as b from events group by all)
        select name, at_ as at, sum(n) over w::bigint as requests, sum(b) over w::bigint as bytes from x window w as (partition by name order by at_)""",
    "batch_round_trip": f"with {_ITEMS} select * from it",
    "batch_rejection": "select damage, count(distinct user_id) as batches, count(distinct user_id) as rejected from events, (values ('cut'), ('version'), ('behind')) d(damage) group by damage",
    "route_collection": f"with {SQL}, {_ROUTES_SQL} select * from rt",
    "publish_preview": _preview_sql(),
    "push_plan": f"with {SQL}, l as (select sha256(content) as oid, max(strlen(content)) as size from new group by 1) select oid, size, case when oid in (select sha256(content) from old) then 'skip' else 'put' end as action from l",
}

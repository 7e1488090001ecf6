"""Queries over sessions, saved sets, notes, recordings and calibrations, each with SQL for DuckDB.

They stand beside ``ridgeline.queries`` and register with it: customers,
orders and parts play sessions, events and notes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import scalars
from ridgeline.operators import catalog, metrics, selection, series
from ridgeline.operators.conditions import flagged, quality_gate
from ridgeline.plans import detect
from ridgeline.queries import CROSS, DEBOUNCE, WINDOWED, S, U, event_windows, query, r6, samples, table
from ridgeline.sources import gps


# --- event windows


@query(f"""with {S}, {CROSS}, {DEBOUNCE}, v as (select *, case when event_type = 'error' then null else value end as x from s), q as (select *, min(x) over (partition by user_id) as lo, max(x) over (partition by user_id) as hi from v)
select d.user_id, d.event_id from deb d join q on q.user_id = d.user_id and q.sample_idx between d.sample_idx - 4 and d.sample_idx + 6
group by all having avg(case when q.x is null then 1 else 0 end) <= 0.3 and not bool_or(coalesce(q.x = q.lo or q.x = q.hi, false))""")
def window_quality(spark, sf_dir):
    from ridgeline.operators.joins import window_join
    from ridgeline.queries import crossings

    d = series.debounce(crossings(spark, sf_dir), U, 6, "strength").select(*U, "event_id", F.col("sample_idx").alias("at"))
    s = samples(spark, sf_dir, "event_type").select(*U, "sample_idx", F.when(F.col("event_type") != "error", F.col("value")).alias("x"))
    near = window_join(d, flagged(s, U, ["x"], ["x"]), U, F.col("at") - 4, F.col("at") + 6, "sample_idx", 11)
    return quality_gate(near, [*U, "event_id"], 0.3, True)


@query(WINDOWED + " select user_id, event_id, string_agg(floor(value)::bigint::varchar, ',' order by sample_idx) as samples, count(*) as n from j group by 1, 2")
def segment_arrays(spark, sf_dir):
    w = event_windows(spark, sf_dir)
    long = w.select(F.col("user_id").alias("session_key"), "event_id", F.lit("cross").alias("schema_id"), (F.col("sample_idx") - F.col("at")).alias("k"), F.col("t_s").alias("t_rel"), F.floor("value").alias("y"))
    out = detect.segment_arrays(long, ["y"])
    return out.select(F.col("session_key").alias("user_id"), "event_id", F.concat_ws(",", F.col("y").cast("array<string>")).alias("samples"), F.size("y").cast("long").alias("n"))


@query(WINDOWED + " select user_id, event_id, round(sum(case when value > 60 then 0.5::double else 0.0::double end), 6) as time_above from j group by 1, 2")
def time_above(spark, sf_dir):
    return metrics.time_above(event_windows(spark, sf_dir), [*U, "event_id"], "value", 60.0, F.lit(0.5)).withColumns(r6("time_above"))


@query(f"with {S} select user_id, event_id, value from (select *, row_number() over (partition by user_id order by t_us, event_id) - 1 as n from s where event_type = 'error') where n = 2")
def nth_event(spark, sf_dir):
    s = samples(spark, sf_dir, "event_type")
    order = F.struct("t_us", "event_id")
    ev = s.select(F.col("user_id").alias("session_key"), F.col("event_type").alias("schema_id"), order.alias("trigger_time_s"), "event_id", "value")
    return catalog.nth_event(ev, "error", 2).select(F.col("session_key").alias("user_id"), "event_id", "value")


@query("select o_orderkey as event_id, o_custkey::varchar || ' | ' || o_orderkey || ' @ ' || (o_orderkey % 1000) || '.250s' as label from orders")
def event_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ev = o.select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_custkey").cast("string").alias("session_id"), (F.col("o_orderkey") % 1000 + 0.25).alias("trigger_time_s"))
    return catalog.event_labels(ev).select(F.col("event_id").cast("long").alias("event_id"), "label")


# --- sessions and saved sets


@query("""with t as (select p_brand as template_id, max(p_size % 3) as latest from part where p_size > 25 and p_brand <> 'Brand#11' group by 1)
select c_custkey as session_key, case when p_partkey is null then 'missing_note' when latest is null then 'template_missing' when p_size % 3 <> latest then 'mismatch' else 'ok' end as note_status
from customer left join part on p_partkey = c_custkey and p_size % 5 > 0 left join t on p_brand = template_id""")
def session_catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumns({"template_id": F.col("p_brand"), "template_version": F.col("p_size") % 3})
    notes = part.filter("p_size % 5 > 0").select(F.col("p_partkey").alias("session_key"), "template_id", "template_version")
    templates = part.filter("p_size > 25 and p_brand <> 'Brand#11'").select("template_id", F.col("template_version").alias("version"))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_key"))
    return catalog.session_catalog(sessions, notes, templates).select("session_key", "note_status")


@query("select o_orderpriority as entity_key, lower(o_orderpriority) as title, count(*) as n_members, count(c_custkey) as n_valid from orders left join customer on c_custkey = o_custkey and c_acctbal > 0 group by 1, 2")
def aggregation_catalog(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("entity_key"), F.lower("o_orderpriority").alias("title"), F.col("o_custkey").alias("session_key"))
    return catalog.aggregation_catalog(members, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("session_key")))


def _schemas(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value < 20")
    return e.select((F.col("user_id") % 40).alias("session_key"), F.col("event_type").alias("schema_id"), F.lit("h").alias("schema_hash"))


@query("select distinct event_type as schema_id from events where value < 20")
def schema_policy_union(spark, sf_dir):
    return catalog.schema_policy(_schemas(spark, sf_dir), "union")


@query("select event_type as schema_id from events where value < 20 group by 1 having count(distinct user_id % 40) = (select count(distinct user_id % 40) from events where value < 20)")
def schema_policy_intersection(spark, sf_dir):
    return catalog.schema_policy(_schemas(spark, sf_dir), "intersection")


@query("select c_nationkey as entity_key, c_custkey as session_key from customer where c_nationkey not in (select c_nationkey from customer where c_acctbal < -990)")
def bootstrap_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    local = c.select(F.col("c_nationkey").alias("entity_key"), F.col("c_custkey").alias("session_key"))
    return catalog.bootstrap(local.limit(0), local, c.filter("c_acctbal >= -990").select(F.col("c_custkey").alias("session_key")))


@query("""with a as (select n_nationkey as k, 'a' || n_regionkey as sensor from nation where n_nationkey % 2 = 0), b as (select s_suppkey as k, s_nationkey as n, 'b' || s_suppkey as sensor from supplier where s_acctbal > 0)
select c_custkey, coalesce(a.sensor, b.sensor, '') as sensor from customer left join a on a.k = c_nationkey left join b on b.k = c_custkey % 100 and b.n = c_nationkey""")
def event_sensor(spark, sf_dir):
    ev = table(spark, sf_dir, "customer").select("c_custkey", F.lit("x").alias("schema_id"), F.col("c_nationkey").alias("signal"), (F.col("c_custkey") % 100).alias("session_key"))
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.lit("x").alias("schema_id"), F.col("n_nationkey").alias("signal"), F.concat(F.lit("a"), F.col("n_regionkey")).alias("sensor"))
    registry = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("session_key"), F.col("s_nationkey").alias("signal"), F.concat(F.lit("b"), F.col("s_suppkey")).alias("sensor"))
    return catalog.with_sensor(ev, known, registry).select("c_custkey", "sensor")


@query("""with g as (select e, s from (values ('O'), ('F'), ('P'), ('X')) as a(e), (values ('1-URGENT'), ('5-LOW'), ('none')) as b(s))
select e as entity_key, s as sensor, count(o_orderkey) as n from g left join orders on o_orderstatus = e and o_orderpriority = s group by 1, 2""")
def series_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("entity_key"), F.col("o_orderpriority").alias("sensor"), "o_orderkey", "o_totalprice")
    out = catalog.series_grid(rows, ["O", "F", "P", "X"], ["1-URGENT", "5-LOW", "none"], "o_orderkey", "o_totalprice")
    return out.select("entity_key", "sensor", F.coalesce(F.size("points"), F.lit(0)).cast("long").alias("n"))


@query("select c_custkey as k, 'new' as note from customer where c_nationkey = 3 union all select c_custkey, c_mktsegment from customer where c_acctbal > 0 and c_nationkey <> 3")
def upsert_notes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    held = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("note"))
    return catalog.upsert(held, c.filter("c_nationkey = 3").select(F.col("c_custkey").alias("k"), F.lit("new").alias("note")), ["k"])


@query("select event_id, coalesce((props->>'k')::int, 0) as k, 7 as missing from events")
def note_fields(spark, sf_dir):
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("session_key"), F.col("props").alias("values"))
    out = catalog.project_notes(notes, [("k", "int", 0), ("absent", "int", 7)])
    return out.select(F.col("session_key").alias("event_id"), F.col("`note.k`").alias("k"), F.col("`note.absent`").alias("missing"))


@query("select event_id, concat_ws(',', case when event_type in ('error', 'view') then event_type end, 'a') as signals from events")
def restore_bookmark(spark, sf_dir):
    b = table(spark, sf_dir, "events").select("event_id", F.array("event_type", F.lit("a"), F.lit("gone")).alias("signals"), F.array(F.lit("b")).alias("event_types"))
    return catalog.restore_view(b, ["a", "error", "view"], []).select("event_id", F.concat_ws(",", "signals").alias("signals"))


@query(f"with {S}, n as (select user_id, count(*) as n from s group by 1) select user_id, user_id % 3 = 0 as drifted from n")
def bookmark_drift(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("user_id").alias("session_key"), F.col("t_s").alias("time_s"))
    b = s.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_s").alias("t_min"), F.max("time_s").alias("t_max"))
    b = b.withColumn("n_rows", F.col("n_rows") + (F.col("session_key") % 3 == 0).cast("int"))
    return catalog.drift(b, s).select(F.col("session_key").alias("user_id"), "drifted")


@query(f"with {S} select user_id, epoch_us(min(ts)) as start_us, epoch_us(min(ts)) + max((event_id % 977) * 1000) as end_us from (select *, make_timestamp(t_us) as ts from s) group by 1")
def session_bounds(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("time_s", (F.col("event_id") % 977) / 1000)
    anchors = s.groupBy(*U).agg(F.timestamp_micros(F.min("t_us")).alias("anchor"))
    out = selection.session_bounds(s, anchors, U)
    return out.select(*U, F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '5-LOW') and o_custkey % 3 <> 2")
def metric_scope(spark, sf_dir):
    kind = F.when(F.col("o_custkey") % 3 == 0, "front_shock").when(F.col("o_custkey") % 3 == 1, "rear_shock").otherwise("crank")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("schema_id"), F.col("o_orderpriority").alias("entity_key"), kind.alias("sensor"))
    return selection.in_scope(rows, "O", ["1-URGENT", "5-LOW"], ["Fork", "shock"]).select("o_orderkey")


@query("select c_custkey as k, c_acctbal as m_a, null::double as m_b from customer union all select s_suppkey, null, s_acctbal from supplier")
def metrics_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("m_a"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("m_b")), allowMissingColumns=True)


@query("select user_id, event_id, value, event_id % 11 as y from events where event_type <> 'error' and event_id % 7 > 0")
def paired_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"active_mask_qc": F.col("event_type") != "error", "y": F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 11).cast("double"))})
    return selection.paired_values(e, "value", "y", ["user_id", "event_id"])


# --- recordings


@query(f"""with {S}, a as (select user_id, min(t_us) as a, min(t_us) + 432000000000 as b from s group by 1), f as (select 'dir/' || event_type as path, min(t_us) + 86400000000 * (length(event_type) % 5) as fa, min(t_us) + 86400000000 * (length(event_type) % 5 + 2) as fb from s group by event_type),
c as (select user_id, path, least(b, fb) - greatest(a, fa) as o from a, f where least(b, fb) - greatest(a, fa) > 0)
select user_id::varchar as session_id, 'auto_match' as status, path from (select *, row_number() over (partition by user_id order by o desc, path desc) as n from c) where n = 1""")
def gps_file_choice(spark, sf_dir):
    s = samples(spark, sf_dir, "event_type")
    day = 86_400_000_000
    at = lambda us: F.timestamp_micros(us.cast("long"))
    sessions = s.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(at(F.min("t_us")).alias("start"), at(F.min("t_us") + 5 * day).alias("end"))
    shift = F.length("event_type") % 5 * day
    files = s.groupBy("event_type").agg(F.min("t_us").alias("t")).select(F.concat(F.lit("dir/"), F.col("event_type")).alias("path"), at(F.col("t") + shift).alias("fit_start"), at(F.col("t") + shift + 2 * day).alias("fit_end"))
    return gps.choose(gps.candidates(sessions, files), "largest_overlap")


def _records(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("sample_idx").alias("pos"), F.timestamp_micros("t_us").alias("timestamp"), F.col("value").alias("speed"), F.when(F.col("user_id") % 2 == 0, F.floor(F.col("value") * 1e6)).cast("double").alias("position_lat"))
    return s


@query(f"with {S} select user_id::varchar as path, min(t_us) as a, max(t_us) as b, case when user_id % 2 = 0 then 'position_lat,speed' else 'speed' end as fields from s group by user_id")
def gps_file_summary(spark, sf_dir):
    out = gps.file_summary(_records(spark, sf_dir))
    return out.select("path", F.unix_micros("fit_start").alias("a"), F.unix_micros("fit_end").alias("b"), F.concat_ws(",", "fields").alias("fields"))


@query(f"""with {S} select user_id::varchar as path, round((t_us - 1704067200000000) / 1e6, 6) as time_s, round(value, 6) as speed, case when user_id % 2 = 0 then round(floor(value * 1e6) * 180 / pow(2, 31), 8) end as lat
from (select *, row_number() over (partition by user_id, t_us order by sample_idx) as n from s) where n = 1""")
def gps_stream(spark, sf_dir):
    out = gps.stream(_records(spark, sf_dir), F.timestamp_micros(F.lit(1704067200000000)))
    return out.select("path", F.round("time_s", 6).alias("time_s"), F.round(F.col("`gps_fit_speed_dom_world [m/s]`"), 6).alias("speed"), F.round(F.col("`gps_fit_position_latitude_dom_world [deg]`"), 8).alias("lat"))


@query(f"with {S} select user_id, count(*) as n, round(min(value), 6) as min_lat, round(max(value), 6) as max_lat from (select distinct on (user_id, t_us) * from s where value is not null and t_us between 1704500000000000 and 1705500000000000) group by 1")
def gps_route_bounds(spark, sf_dir):
    s = samples(spark, sf_dir).select(*U, F.col("t_s").alias("time_s"), F.col("value").alias("lat"), F.col("value").alias("lon"))
    r = gps.route(s, "lat", "lon", U, F.lit(1704500000.0), F.lit(1705500000.0))
    n = r.groupBy(*U).agg(F.count(F.lit(1)).alias("n"))
    return gps.bounds(r, "lat", "lon", U).join(n, U).select(*U, "n", F.round("min_lat", 6).alias("min_lat"), F.round("max_lat", 6).alias("max_lat"))


@query(f"with {S}, l as (select *, lead(t_s) over (partition by user_id order by sample_idx) as nt from s) select user_id, sample_idx from l where nt > t_s and nt >= 1704500000 and t_s <= 1705000000")
def segments_in_window(spark, sf_dir):
    seg = series.route_segments(samples(spark, sf_dir), U, "t_s", "value")
    return gps.in_window(seg, "t_s", "t_s_next", 1705000000.0, 1704500000.0).select(*U, "sample_idx")


# --- scalars


@query("""select o_orderkey, round(case o_orderkey % 3 when 0 then o_custkey * 1.0 when 1 then o_custkey * 1e6 / 1e3 else o_custkey * 1e12 / 1e6 end, 6) as seconds,
epoch_us(o_orderdate) as anchor_us, round(o_custkey * 180.0 / pow(2, 31), 9) as degrees, round_even(o_custkey / 2.0, 0)::bigint as n_samples from orders""")
def scalar_conversions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind, x = F.col("o_orderkey") % 3, F.col("o_custkey").cast("double")
    raw = F.when(kind == 0, x).when(kind == 1, x * 1e6).otherwise(x * 1e12)
    most = F.when(kind == 0, 1e5).when(kind == 1, 1e9).otherwise(1e15)
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss"), F.lit("_ride.CSV"))
    return o.select(
        "o_orderkey",
        F.round(scalars.time_scale(raw, most), 6).alias("seconds"),
        F.unix_micros(scalars.filename_anchor(name)).alias("anchor_us"),
        F.round(scalars.semicircles_to_degrees(x), 9).alias("degrees"),
        scalars.samples_of(x, F.lit(2.0)).alias("n_samples"),
    )


@query("select p_partkey, round((p_size - 3) * 2.5 - 1, 6)::double as two_point, round(sqrt(25 * 25 + 80 * 80 - 2 * 25 * 80 * cos(p_size / 10.0)) - 55, 6) as crank from part")
def calibrations(spark, sf_dir):
    x = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(scalars.two_point(x, (3.0, 43.0), (-1.0, 99.0)), 6).alias("two_point"), F.round(scalars.crank_displacement(x / 10, 25.0, 80.0), 6).alias("crank"))

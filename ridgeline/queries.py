"""The library's operators as queries over the driver's tables, each with SQL for DuckDB.

Sessions are users, signals are event values: events(user_id, ts, value) gives
one ordered series per user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalars
from ridgeline.operators import joins, selection, series, stats
from ridgeline.operators.blocks import by_length

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Samples in DuckDB's terms.
S = "s as (select user_id, event_id, event_type, epoch_us(ts) as t_us, epoch_us(ts) / 1e6 as t_s, value, props, row_number() over (partition by user_id order by ts, event_id) - 1 as sample_idx from events)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", *more, F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")
    e = e.withColumn("t_s", F.col("t_us") / 1e6)
    return series.with_sample_idx(e, ["user_id"], ["t_us", "event_id"])


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


U = ["user_id"]
CROSS = """
  lagged as (select *, lag(value) over w as prev from s window w as (partition by user_id order by sample_idx)),
  grp as (select *, coalesce(count(case when value <= 20.0 and sample_idx > 0 then 1 end) over (partition by user_id order by sample_idx rows between unbounded preceding and 1 preceding), 0) as g from lagged),
  hit as (select *, row_number() over (partition by user_id, g order by sample_idx) as n from grp where prev < 40.0 and value >= 40.0),
  c as (select user_id, event_id, t_us, t_s, value, sample_idx, abs(value - prev) as strength from hit where n = 1)"""


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.threshold_crossings(samples(spark, sf_dir), U, "value", 40.0, 20.0)


@query(f"with {S}, {CROSS} select user_id, event_id, sample_idx, round(strength, 6) as strength from c")
def threshold_crossing(spark, sf_dir):
    return crossings(spark, sf_dir).select(*U, "event_id", "sample_idx", F.round("strength", 6).alias("strength"))


@query(f"""with {S}, m as (select *, value - avg(value) over (partition by user_id) as y from s), l as (select *, lag(y) over (partition by user_id order by sample_idx) as p from m)
select user_id, event_id, sample_idx, case when p < 0 and y >= 0 then 'rising' else 'falling' end as direction from l where (p < 0 and y >= 0) or (p > 0 and y <= 0)""")
def zero_crossing(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("y", F.col("value") - F.avg("value").over(Window.partitionBy(*U)))
    return series.zero_crossings(s, U, "y", direction="either").select(*U, "event_id", "sample_idx", "direction")


DEBOUNCE = """
  gaps as (select *, case when sample_idx - lag(sample_idx) over (partition by user_id order by sample_idx) < 6 then 0 else 1 end as st from c),
  clus as (select *, sum(st) over (partition by user_id order by sample_idx) as cl from gaps),
  deb as (select * from (select *, row_number() over (partition by user_id, cl order by abs(strength) desc, sample_idx) as b from clus) where b = 1)"""


@query(f"with {S}, {CROSS}, {DEBOUNCE} select user_id, event_id, sample_idx, round(strength, 6) as strength from deb")
def debounce_select(spark, sf_dir):
    return series.debounce(crossings(spark, sf_dir), U, 6, "strength").select(*U, "event_id", "sample_idx", F.round("strength", 6).alias("strength"))


@query(f"with {S}, {CROSS}, {DEBOUNCE} select user_id, count(*) as n_events, min(sample_idx) as first_idx, round(max(strength), 6) as strongest from deb group by user_id")
def flagship_event_counts(spark, sf_dir):
    d = series.debounce(crossings(spark, sf_dir), U, 6, "strength")
    return d.groupBy(*U).agg(F.count(F.lit(1)).alias("n_events"), F.min("sample_idx").alias("first_idx"), F.round(F.max("strength"), 6).alias("strongest"))


@query(f"with {S}, {CROSS} select user_id, sample_idx, row_number() over (partition by user_id order by sample_idx) - 1 as occurrence, 'cross:' || user_id || ':' || (row_number() over (partition by user_id order by sample_idx) - 1) as occurrence_id from c")
def occurrence_ids(spark, sf_dir):
    out = series.occurrences(crossings(spark, sf_dir).drop("event_id"), U, "cross")
    return out.select(*U, "sample_idx", F.col("occurrence").cast("long").alias("occurrence"), F.col("event_id").alias("occurrence_id"))


@query(f"""with {S}, l as (select *, lag(value) over w as p, lead(value) over w as q from s window w as (partition by user_id order by sample_idx))
select user_id, sample_idx, round(value, 6) as value from l where value > p and value > q""")
def local_maxima(spark, sf_dir):
    return series.local_extrema(samples(spark, sf_dir), U, "value").select(*U, "sample_idx", F.round("value", 6).alias("value"))


@query(f"""with {S}, l as (select *, lag(value) over w as p, lead(value) over w as q, lag(t_s) over w as tp, lead(t_s) over w as tq from s window w as (partition by user_id order by sample_idx))
select user_id, sample_idx, round(t_s + greatest(-1.0, least(1.0, case when p - 2 * value + q <> 0 then 0.5 * (p - q) / (p - 2 * value + q) else 0 end)) * (tq - tp) / 2, 3) as t_refined from l where value > p and value > q""")
def refined_maxima(spark, sf_dir):
    s = series.refine_extremum(samples(spark, sf_dir), U, "value", "t_s")
    return series.local_extrema(s, U, "value").select(*U, "sample_idx", F.round("t_refined", 3).alias("t_refined"))


WINDOWED = f"with {S}, {CROSS}, {DEBOUNCE}, j as (select d.user_id, d.event_id, d.sample_idx as trig, s.sample_idx, s.t_s, s.value from deb d join s on s.user_id = d.user_id and s.sample_idx between d.sample_idx - 4 and d.sample_idx + 6)"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.debounce(crossings(spark, sf_dir), U, 6, "strength").select(*U, "event_id", F.col("sample_idx").alias("at"))
    s = samples(spark, sf_dir).drop("event_id")
    return joins.window_join(d, s, U, F.col("at") - 4, F.col("at") + 6, "sample_idx", 11)


@query(WINDOWED + " select user_id, event_id, count(*) as n, round(min(value), 6) as lo, round(max(value), 6) as hi, round(max(value) - max(case when sample_idx = trig then value end), 6) as rise from j group by user_id, event_id")
def event_window_stats(spark, sf_dir):
    hit = F.max(F.when(F.col("sample_idx") == F.col("at"), F.col("value")))
    return event_windows(spark, sf_dir).groupBy(*U, "event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"), F.round(F.max("value") - hit, 6).alias("rise"))


@query(WINDOWED + """, k as (select user_id, event_id, min(case when sample_idx < trig then value end) as pre_lo, max(case when sample_idx < trig then value end) as pre_hi, max(case when sample_idx > trig then value end) as post_hi from j group by user_id, event_id)
select user_id, event_id from k where (pre_lo >= 1 and pre_hi <= 200) and (post_hi > 60 or pre_hi < 30)""")
def conditions_all_any(spark, sf_dir):
    from ridgeline.operators.conditions import Block, Test, apply_conditions

    pre = [Test("range", "value", lo=1.0, hi=200.0)]
    return apply_conditions(event_windows(spark, sf_dir), [*U, "event_id"], "at", "sample_idx", [Block(-4, 0, pre, []), Block(-4, 7, [], [Test("peak", "value", cmp=">", value=60.0, lo_idx=1, hi_idx=7), Test("peak", "value", cmp="<", value=30.0, lo_idx=-4, hi_idx=0)])]).select(*U, "event_id")


def _secondary(pick: str, lo: float, hi: float):
    order = {"forward": "x.t_s", "backward": "-x.t_s", "closest": "abs(x.t_s - d.t_s), x.t_s"}[pick]
    sql = f"""with {S}, {CROSS}, {DEBOUNCE}, x as (select user_id, t_s, value from s where value > 60),
    p as (select d.event_id, x.t_s as t, x.value, row_number() over (partition by d.event_id order by {order}) as n from deb d join x on x.user_id = d.user_id and x.t_s between d.t_s + {lo} and d.t_s + {hi})
    select d.user_id, d.event_id, round(p.t, 6) as secondary_t, round(p.t - d.t_s, 6) as delay from deb d left join p on p.event_id = d.event_id and p.n = 1"""

    def run(spark, sf_dir):
        d = series.debounce(crossings(spark, sf_dir), U, 6, "strength").select(*U, "event_id", "t_s")
        c = samples(spark, sf_dir).filter("value > 60").select(*U, F.col("t_s").alias("c_t"), F.col("value").alias("c_value"))
        out = joins.secondary_trigger(d, c, U, "event_id", "t_s", "c_t", lo, hi, "auto")
        t = F.col("secondary.c_t")
        return out.select(*U, "event_id", F.round(t, 6).alias("secondary_t"), F.round(t - F.col("t_s"), 6).alias("delay"))

    return sql, run


for _name, _args in {"secondary_trigger_forward": ("forward", 0.0, 200000.0), "secondary_trigger_backward": ("backward", -200000.0, 0.0), "secondary_trigger_auto": ("closest", -200000.0, 200000.0)}.items():
    ORACLES[_name], QUERIES[_name] = _secondary(*_args)


@query(WINDOWED + """, o as (select *, lag(value) over w as pv, lag(t_s) over w as pt from j window w as (partition by event_id order by sample_idx))
select user_id, event_id, round(avg(value), 6) as mean, round(max(value), 6) as most, round(min(value), 6) as least, round(arg_max(value, sample_idx) - arg_min(value, sample_idx), 6) as delta, round(coalesce(sum((value + pv) / 2 * (t_s - pt)), 0), 2) as integral from o group by user_id, event_id""")
def interval_stats(spark, sf_dir):
    from ridgeline.operators.metrics import interval_metrics

    out = interval_metrics(event_windows(spark, sf_dir), [*U, "event_id"], "value", "t_s", "sample_idx")
    return out.select(*U, "event_id", *[F.round(c, 2 if c == "integral" else 6).alias(c) for c in ("mean", "most", "least", "delta", "integral")])


@query(WINDOWED + " select user_id, event_id, round(max(value), 6) as peak, round(min(t_s) filter (value = m) - max(t0), 6) as peak_t from (select *, max(value) over (partition by event_id) as m, max(case when sample_idx = trig then t_s end) over (partition by event_id) as t0 from j) group by user_id, event_id")
def peak_metric(spark, sf_dir):
    from ridgeline.operators.metrics import peak_metric as peak

    w = event_windows(spark, sf_dir)
    t0 = F.max(F.when(F.col("sample_idx") == F.col("at"), F.col("t_s"))).over(Window.partitionBy("event_id"))
    out = peak(w.withColumn("t_rel", F.col("t_s") - t0), [*U, "event_id"], "value", "t_rel", "sample_idx")
    return out.select(*U, "event_id", F.round("peak", 6).alias("peak"), F.round("peak_t", 6).alias("peak_t"))


@query(f"with {S}, {CROSS}, l as (select *, lead(t_s) over (partition by user_id order by sample_idx) as nxt, lead(sample_idx) over (partition by user_id order by sample_idx) as nidx from c) select user_id, event_id, round(nxt - t_s, 6) as delta_s, nidx - sample_idx as delta_samples from l where nxt is not null")
def trigger_delta(spark, sf_dir):
    from ridgeline.operators.metrics import trigger_delta as delta

    w = Window.partitionBy(*U).orderBy("sample_idx")
    c = crossings(spark, sf_dir).withColumns({"end_s": F.lead("t_s").over(w), "end_idx": F.lead("sample_idx").over(w)}).filter("end_idx is not null")
    return c.select(*U, "event_id", F.round(delta(F.col("t_s"), F.col("end_s")), 6).alias("delta_s"), delta(F.col("sample_idx"), F.col("end_idx")).alias("delta_samples"))


H = 3_600_000_000


@query(f"""with {S}, v as (select *, (value - lag(value) over w) / (t_s - lag(t_s) over w) as vel from s window w as (partition by user_id order by sample_idx)),
a as (select *, max(case when abs(value) > 50 and abs(vel) > 0.001 then 1 else 0 end) over (partition by user_id order by t_us range between {24 * H - 1} preceding and current row) as busy from v),
b as (select *, sum(case when busy = 1 and coalesce(pb, 0) = 0 then 1 else 0 end) over (partition by user_id order by sample_idx) as blk from (select *, lag(busy) over (partition by user_id order by sample_idx) as pb from a)),
k as (select user_id, blk, min(t_us) - {6 * H} as x, max(t_us) + {6 * H} as y from b where busy = 1 group by user_id, blk),
m as (select *, sum(case when x <= top then 0 else 1 end) over (partition by user_id order by x, blk) as g from (select *, max(y) over (partition by user_id order by x, blk rows between unbounded preceding and 1 preceding) as top from k)),
i as (select user_id, min(x) as x, max(y) as y from m group by user_id, g having max(y) - min(x) >= {20 * H})
select user_id, sample_idx, exists (select 1 from i where i.user_id = s.user_id and s.t_us between i.x and i.y) as active from s""")
def activity_mask(spark, sf_dir):
    s = samples(spark, sf_dir)
    w = Window.partitionBy(*U).orderBy("sample_idx")
    s = s.withColumn("vel", (F.col("value") - F.lag("value").over(w)) / (F.col("t_s") - F.lag("t_s").over(w)))
    hour = 3600.0
    return series.activity_mask(s, U, "value", "vel", "t_us", 50.0, 0.001, 24 * hour, 6 * hour, 20 * hour).select(*U, "sample_idx", "active")


@query(f"""with {S}, z as (select user_id, count(*) over w as n, median(value) over w as m from s window w as (partition by user_id order by t_us range between {72 * H} preceding and current row))
select user_id, round(coalesce(min(case when n >= 10 then m end), any_value(f)), 6) as zero_at from z join (select user_id, arg_min(value, sample_idx) as f from s group by user_id) using (user_id) group by user_id""")
def zero_offset(spark, sf_dir):
    return series.zero_offset(samples(spark, sf_dir), U, "value", "t_us", 72 * 3600.0, 10).select(*U, F.round("offset", 6).alias("zero_at"))


@query("select l_orderkey, l_linenumber, round(greatest(0, least(1, (l_quantity - 5) / 40.0)), 6) as norm from lineitem")
def normalize_clip(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return series.normalise(t, "l_quantity", F.lit(5.0), 40.0, clip=True).select("l_orderkey", "l_linenumber", F.round("norm", 6).alias("norm"))


@query(f"with {S} select user_id, sample_idx, round(avg(value) over (partition by user_id order by sample_idx rows between 2 preceding and 2 following), 6) as smooth from s")
def moving_average(spark, sf_dir):
    return series.moving_average(samples(spark, sf_dir), U, "value", 5).select(*U, "sample_idx", F.round("smooth", 6).alias("smooth"))


@query(f"""with {S}, g as (select user_id, unnest(generate_series(1704067200, 1706659200, 21600))::double as t_s from (select distinct user_id from s)),
a as (select g.user_id, g.t_s, s.t_s as t0, s.value as y0 from g asof left join s on g.user_id = s.user_id and g.t_s >= s.t_s),
b as (select a.*, s.t_s as t1, s.value as y1 from a asof left join s on a.user_id = s.user_id and a.t_s <= s.t_s)
select user_id, t_s, round(case when t0 = t1 then y0 else y0 + (y1 - y0) * (t_s - t0) / (t1 - t0) end, 6) as value from b""")
def resample_linear(spark, sf_dir):
    s = samples(spark, sf_dir).select(*U, "t_s", "value")
    grid = s.select(*U).distinct().select(*U, F.explode(F.sequence(F.lit(1704067200), F.lit(1706659200), F.lit(21600)).cast("array<double>")).alias("t_s"))
    return joins.interp_join(grid, s, U, "t_s", "value").select(*U, "t_s", F.round("value", 6).alias("value"))


@query(f"""with {S}, g as (select user_id, unnest(generate_series(1704067200, 1706659200, 21600))::double as t_s from (select distinct user_id from s)),
a as (select g.user_id, g.t_s, s.t_s + 3600.0 as t0, s.value as y0 from g asof left join s on g.user_id = s.user_id and g.t_s >= s.t_s + 3600.0),
b as (select a.*, s.t_s + 3600.0 as t1, s.value as y1 from a asof left join s on a.user_id = s.user_id and a.t_s <= s.t_s + 3600.0)
select user_id, t_s, round(case when t0 = t1 then y0 else y0 + (y1 - y0) * (t_s - t0) / (t1 - t0) end, 6) as shifted from b""")
def time_shift(spark, sf_dir):
    s = samples(spark, sf_dir).select(*U, "t_s", "value")
    grid = s.select(*U).distinct().select(*U, F.explode(F.sequence(F.lit(1704067200), F.lit(1706659200), F.lit(21600)).cast("array<double>")).alias("t_s"))
    return joins.shift_join(grid, s, U, "t_s", "value", 3600.0, "shifted").select(*U, "t_s", F.round("shifted", 6).alias("shifted"))


@query(f"""with {S}, g as (select user_id, unnest(generate_series(1704067200, 1706659200, 86400))::double as t_s from (select distinct user_id from s))
select user_id, t_s, round(value, 6) as value from (select g.user_id, g.t_s, s.value, row_number() over (partition by g.user_id, g.t_s order by abs(s.t_s - g.t_s), s.t_s) as n from g join s using (user_id)) where n = 1""".replace("join s using (user_id)", "join s on s.user_id = g.user_id"))
def nearest_asof(spark, sf_dir):
    s = samples(spark, sf_dir).select(*U, "t_s", "value")
    grid = s.select(*U).distinct().select(*U, F.explode(F.sequence(F.lit(1704067200), F.lit(1706659200), F.lit(86400)).cast("array<double>")).alias("t_s"))
    return joins.nearest_join(grid, s, U, "t_s", "value", "near").select(*U, "t_s", F.round("near", 6).alias("value"))


SESS = """l as (select *, case when t_us - lag(t_us) over (partition by user_id order by sample_idx) <= 43200000000 then 0 else 1 end as st from s),
ss as (select user_id, seg, min(t_us) as a, max(t_us) as b, count(*) as n from (select *, sum(st) over (partition by user_id order by sample_idx)::bigint as seg from l) group by user_id, seg)"""


@query(f"""with {S}, {SESS}, f as (select (user_id + 1) % 150 as user_id, seg as file, a as fa, b as fb from ss where n > 2)
select ss.user_id, ss.seg, f.file, least(b, fb) - greatest(a, fa) as overlap from ss join f on ss.user_id = f.user_id and (least(b, fb) - greatest(a, fa) > 0 or (least(b, fb) - greatest(a, fa) = 0 and a = b))""")
def interval_overlap(spark, sf_dir):
    s = samples(spark, sf_dir)
    w = Window.partitionBy(*U).orderBy("sample_idx")
    st = F.when(F.col("t_us") - F.lag("t_us").over(w) <= 43200000000, 0).otherwise(1)
    seg = s.withColumn("st", st).withColumn("seg", F.sum("st").over(w))
    sess = seg.groupBy(*U, "seg").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.count(F.lit(1)).alias("n"))
    files = sess.filter("n > 2").select(((F.col("user_id") + 1) % 150).alias("user_id"), F.col("seg").alias("file"), F.col("a").alias("fa"), F.col("b").alias("fb"))
    return joins.overlap_join(sess.drop("n"), files, U, ("a", "b"), ("fa", "fb"), 86_400_000_000).select(*U, "seg", "file", "overlap")


GAP = "g as (select *, t_s - lag(t_s) over (partition by user_id order by sample_idx) as dt from s), gm as (select *, median(dt) over (partition by user_id) as md from g)"


@query(f"with {S}, {GAP} select user_id, sample_idx, coalesce(dt > greatest(3 * md, 3600), false) as gap, sum(case when coalesce(dt > greatest(3 * md, 3600), false) then 1 else 0 end) over (partition by user_id order by sample_idx)::bigint as segment_id from gm")
def gap_segments(spark, sf_dir):
    return series.gap_segments(samples(spark, sf_dir), U, "t_s", 3.0, 3600.0).select(*U, "sample_idx", "gap", "segment_id")


@query(f"with {S}, {GAP} select user_id, sample_idx, case when coalesce(dt > greatest(3 * md, 3600), false) then null else value end as value from gm")
def plot_breaks(spark, sf_dir):
    return series.plot_breaks(series.gap_segments(samples(spark, sf_dir), U, "t_s", 3.0, 3600.0), "gap", ["value"]).select(*U, "sample_idx", "value")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) as n from events) where n = 1")
def dedupe_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    return series.keep_first(e, ["user_id", "event_type"], "day", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(f"with {S}, h as (select *, floor(t_s / 7200) as tick from s) select user_id, sample_idx from (select *, tick - lag(tick) over (partition by user_id order by sample_idx) as d from h) where d > 0")
def strictly_increasing(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("tick", F.floor(F.col("t_s") / 7200))
    return series.strictly_increasing(s, U, "tick").select(*U, "sample_idx")


@query(f"""with {S}, h as (select *, t_s - (case when sample_idx % 7 = 5 then 100000 else 0 end) as t from s), d as (select *, t - lag(t) over (partition by user_id order by sample_idx) as dt from h),
m as (select *, median(case when dt > 0 then dt end) over (partition by user_id) as md from d)
select user_id, sample_idx, round(t + sum(case when dt < 0 then -dt + 0.5 * coalesce(md, 0) else 0 end) over (partition by user_id order by sample_idx), 3) as t_repaired from m""")
def monotonic_repair(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("t", F.col("t_s") - F.when(F.col("sample_idx") % 7 == 5, 100000).otherwise(0))
    return series.repair_monotonic(s, U, "t").select(*U, "sample_idx", F.round("t_repaired", 3).alias("t_repaired"))


@query(f"with {S}, d as (select *, t_s - lag(t_s) over (partition by user_id order by sample_idx) as dt from s) select user_id, count(*) as n, round(median(dt), 6) as dt, round(1 / median(dt), 9) as rate, round(stddev_pop(dt) / median(dt), 6) as jitter from d where dt > 0 group by user_id")
def timebase(spark, sf_dir):
    return stats.timebase(samples(spark, sf_dir), U, "t_s").select(*U, "n", F.round("dt", 6).alias("dt"), F.round("rate", 9).alias("rate"), F.round("jitter", 6).alias("jitter"))


@query(f"with {S}, l as (select *, lead(t_s) over w as nt, lead(value) over w as nv from s window w as (partition by user_id order by sample_idx)) select user_id, sample_idx, round((value + nv) / 2, 6) as segment_speed, round(nt - t_s, 6) as dur from l where nt > t_s")
def route_segments(spark, sf_dir):
    out = series.route_segments(samples(spark, sf_dir), U, "t_s", "value")
    return out.select(*U, "sample_idx", F.round("segment_speed", 6).alias("segment_speed"), F.round(F.col("t_s_next") - F.col("t_s"), 6).alias("dur"))


@query("select p_partkey, case when p_size >= 40 then 4 when p_size >= 30 then 3 when p_size >= 20 then 2 when p_size >= 10 then 1 else 0 end as speed_class from part")
def speed_bins(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.speed_class(F.col("p_size").cast("double")).alias("speed_class"))


@query("""with x as (select l_returnflag, l_quantity as x from lineitem where l_quantity >= 5), q as (select l_returnflag, count(*) as n, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as q50, quantile_cont(x, 0.75) as q75, quantile_cont(x, 0.9) as q90, quantile_cont(x, 0.95) as q95 from x group by 1)
select *, q75 - q25 as iqr, round((q75 + q25 - 2 * q50) / (q75 - q25), 6) as skew from q""")
def trimmed_quantiles(spark, sf_dir):
    return stats.trimmed_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 5.0).withColumns(r6("skew"))


@query("""with x as (select l_linestatus, l_discount as a, l_extendedprice as b from lineitem where l_discount >= 0.05), q as (select l_linestatus, count(*) as n, quantile_cont(a, [0.25, 0.5, 0.75, 0.95, 1.0]) as a, quantile_cont(b, [0.25, 0.5, 0.75, 0.95, 1.0]) as b from x group by 1)
select l_linestatus, n, round(a[1], 6) as norm_q25, round(a[2], 6) as norm_q50, round(a[3], 6) as norm_q75, round(a[4], 6) as norm_q95, round(a[5], 6) as norm_q100, round(b[1], 6) as mm_q25, round(b[2], 6) as mm_q50, round(b[3], 6) as mm_q75, round(b[4], 6) as mm_q95, round(b[5], 6) as mm_q100, round(a[3] - a[1], 6) as norm_iqr, round(b[3] - b[1], 6) as mm_iqr from q""")
def paired_quantiles(spark, sf_dir):
    out = stats.paired_quantiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_discount", "l_extendedprice")
    return out.withColumns(r6(*[c for c in out.columns if c not in ("l_linestatus", "n")]))


@query("""with v as (select event_type, value - avg(value) over (partition by event_type) as v from events)
select event_type, count(*) filter (v < 0) as rebound_n, round(avg(v) filter (v < 0), 6) as rebound_mean, round(max(abs(v)) filter (v < 0), 6) as rebound_max, round(quantile_cont(abs(v), 0.95) filter (v < 0), 6) as rebound_p95,
count(*) filter (v > 0) as compression_n, round(avg(v) filter (v > 0), 6) as compression_mean, round(max(abs(v)) filter (v > 0), 6) as compression_max, round(quantile_cont(abs(v), 0.95) filter (v > 0), 6) as compression_p95 from v group by event_type""")
def phase_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    out = stats.phase_stats(e.join(mean, "event_type").withColumn("v", F.col("value") - F.col("m")), ["event_type"], "v")
    return out.withColumns(r6(*[c for c in out.columns if c[-2:] != "_n" and c != "event_type"]))


@query("""with b as (select l_returnflag, (case when abs(l_quantity - 25) > 20 then 10 else least(floor((l_quantity - 25 + 20) / 4.0), 9) end)::int as bin from lineitem)
select l_returnflag, bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 6) as share from b group by l_returnflag, bin""")
def hist_overflow(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") - 25)
    return stats.overflow_histogram(t, ["l_returnflag"], "x", 10, 20.0).withColumns(r6("share"))


@query("""with e as (select l_shipmode, min(x) as a, max(x) as b from (select l_returnflag as l_shipmode, l_extendedprice as x from lineitem) group by 1),
b as (select l_returnflag, a, b, least(floor((l_extendedprice - a) / ((b - a) / 20)), 19)::int as bin from lineitem join e on l_returnflag = l_shipmode)
select l_returnflag, bin, round(a + bin * ((b - a) / 20), 4) as lo, round(a + (bin + 1) * ((b - a) / 20), 4) as hi, count(*) as n from b group by l_returnflag, bin, a, b""")
def hist_equal_width(spark, sf_dir):
    out = stats.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 20)
    return out.withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("with c as (select l_returnflag, l_quantity, count(*) as n from lineitem group by 1, 2) select l_returnflag, l_quantity, n, round(sum(n) over (partition by l_returnflag order by l_quantity) / sum(n) over (partition by l_returnflag), 6) as share from c")
def ecdf(spark, sf_dir):
    return stats.ecdf(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").withColumns(r6("share"))


@query("select event_type, count(value) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(median(value), 6) as median from events group by event_type")
def series_stats(spark, sf_dir):
    return stats.series_stats(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns(r6("mean", "median"))


@query("select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def ols_corr(spark, sf_dir):
    out = stats.scatter_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("r", 6).alias("r"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def event_counts(spark, sf_dir):
    return stats.event_counts(table(spark, sf_dir, "events"), U, "event_type")


@query("select o_orderkey as event_id, o_custkey as session_key, o_orderpriority, l.qty from orders join (select l_orderkey, sum(l_quantity) as qty from lineitem group by 1) l on l.l_orderkey = o_orderkey")
def viz_inner_join(spark, sf_dir):
    ev = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("session_key"), "o_orderpriority")
    mt = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.sum("l_quantity").alias("qty"))
    return joins.events_with_metrics(ev, mt, ["event_id"])


@query("select c_custkey as event_id, c_mktsegment, o.n::double as n_m, c_nationkey as n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) o on o_custkey = c_custkey")
def left_merge(spark, sf_dir):
    ev = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), "c_mktsegment", F.col("c_nationkey").alias("n"))
    mt = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("int").alias("event_id")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return joins.left_merge(ev, mt)


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return joins.orphans(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select distinct event_type from events")
def registry_union(spark, sf_dir):
    return stats.signals_by_policy(table(spark, sf_dir, "events"), "user_id", "event_type", "union")


@query("select event_type from (select distinct user_id % 40 as u, event_type from events where value < 20) group by 1 having count(*) = (select count(distinct user_id % 40) from events where value < 20)")
def registry_intersection(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value < 20").withColumn("u", F.col("user_id") % 40)
    return stats.signals_by_policy(e, "u", "event_type", "intersection")


@query("select event_type, event_id as info_event, round(value, 6) as value from (select *, row_number() over (partition by event_type order by event_id) as n from events) where n = 1")
def registry_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("info_event", F.col("event_id"))
    return stats.first_registry(e, "event_type", "event_id", ["info_event", "value"]).withColumns(r6("value"))


@query("""with explicit as (select c_custkey as k, -1 as entity from customer where c_acctbal > 9000), agg as (select c_custkey as k, c_nationkey as entity from customer where c_mktsegment = 'BUILDING')
select k, entity from explicit union all select k, entity from agg where k not in (select k from explicit)""")
def entity_expansion(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    explicit = c.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("k"), F.lit(-1).alias("entity"))
    members = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("entity"))
    from ridgeline.operators.catalog import expand_entities

    sets = members.select(F.concat(F.lit("nation "), F.col("entity")).alias("entity_key"), F.col("k").cast("string").alias("session_key"))
    chosen = explicit.select(F.col("k").cast("string").alias("entity_key"), F.lit("session").alias("entity_kind"))
    chosen = chosen.unionByName(sets.select("entity_key", F.lit("aggregation").alias("entity_kind")).distinct())
    entity = F.when(F.col("entity_kind") == "session", -1).otherwise(F.regexp_extract("entity_key", r"\d+", 0).try_cast("int"))
    return expand_entities(chosen, sets).select(F.col("session_key").cast("int").alias("k"), entity.alias("entity"))


@query("select doc_id from documents where sha256(text) not in (select sha256(text) from documents where source in ('src0', 'src1'))")
def incremental_antijoin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    from ridgeline.sources.store import unknown_files

    return unknown_files(d.withColumnRenamed("sha", "sha256"), d.filter(F.col("source").isin("src0", "src1")).select(F.col("sha").alias("sha256"))).select("doc_id")


@query("select event_id from events where list_has_any([event_type, case when value > 50 then 'high' else 'low' end], ['error', 'high'])")
def tags_overlap(spark, sf_dir):
    tags = F.array("event_type", F.when(F.col("value") > 50, "high").otherwise("low"))
    return selection.by_tags(table(spark, sf_dir, "events").withColumn("tags", tags), ["error", "high"]).select("event_id")


@query("select event_id, (props->>'k')::int as k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select p_partkey, try_cast(nullif(regexp_replace('$ ' || p_retailprice || ' ' || p_brand, '[^0-9eE+\\-.]', '', 'g'), '') as double) as cleaned from part")
def numeric_clean(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.clean_number(F.concat(F.lit("$ "), F.col("p_retailprice").cast("string"), F.lit(" "), F.col("p_brand"))).alias("cleaned"))


@query("select event_id, round((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 59) + 0.5, 3)::double as seconds from events")
def clock_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat_ws(":", *[(F.col("event_id") % n).cast("string") for n in (24, 60)], F.concat((F.col("event_id") % 59).cast("string"), F.lit(",5")))
    return e.select("event_id", F.round(scalars.clock_seconds(text), 3).alias("seconds"))


@query("select n_nationkey, case n_nationkey % 3 when 0 then 'front_shock' when 1 then 'rear_shock' else 'brake_' || lower(n_name) end as sensor from nation")
def sensor_alias(spark, sf_dir):
    raw = F.when(F.col("n_nationkey") % 3 == 0, " Fork ").when(F.col("n_nationkey") % 3 == 1, "SHOCK").otherwise(F.concat(F.lit("Brake - "), F.lower("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.sensor_id(raw).alias("sensor"))


@query("select p_partkey, round(1.5 + 0.25 * p_size - 0.01 * p_size * p_size + 0.0002 * p_size * p_size * p_size, 6)::double as poly, round(case when p_size <= 5 then 0 when p_size < 20 then (p_size - 5) * (30.0 / 15) when p_size < 40 then 30 + (p_size - 20) * (5.0 / 20) else 35 end, 6) as lut from part")
def poly_lut_transform(spark, sf_dir):
    x = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(scalars.polynomial(x, [1.5, 0.25, -0.01, 0.0002]), 6).alias("poly"), F.round(scalars.lookup(x, [(20, 30), (5, 0), (40, 35)]), 6).alias("lut"))


@query(f"with {S} select user_id, sample_idx // 8 as block, round(avg(t_s), 3) as t, round(avg(value), 6) as value from s group by 1, 2 having count(*) = 8")
def block_average(spark, sf_dir):
    return series.block_average(samples(spark, sf_dir), U, "value", "t_s", 8).withColumns({"t": F.round("t", 3), "value": F.round("value", 6)})


@query(f"with {S} select user_id, least(floor((t_s - 86400 * floor(t_s / 86400)) / 86400 * 12), 11)::int as phase_bin, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(sqrt(avg(value * value)), 6) as rms from s group by 1, 2")
def phase_bins(spark, sf_dir):
    return stats.phase_bins(samples(spark, sf_dir), U, "t_s", "value", 86400.0, 12).withColumns(r6("mean", "std", "rms"))


@query(f"with {S}, l as (select *, lag(value) over w as p, lead(value) over w as q from s window w as (partition by user_id order by sample_idx)), g as (select user_id, t_s - lag(t_s) over (partition by user_id order by t_s) as d from l where value > p and value > q) select user_id, count(d) as n, round(avg(d), 4) as mean, round(stddev_pop(d), 4) as std from g group by 1")
def cycle_periods(spark, sf_dir):
    out = stats.cycle_periods(series.local_extrema(samples(spark, sf_dir), U, "value"), U, "t_s")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(f"""with {S}, h as (select *, value % 40 as v from s), d as (select *, v - lag(v) over (partition by user_id order by sample_idx) as d from h),
k as (select *, case when d is null then 0 when abs(d - 40) <= abs(d) and abs(d - 40) <= abs(d + 40) then -1 when abs(d) <= abs(d + 40) then 0 else 1 end as k from d)
select user_id, sample_idx, round(v + 40 * sum(k) over (partition by user_id order by sample_idx), 6) as unwrapped from k""")
def unwrap(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("v", F.col("value") % 40)
    return series.unwrap(s, U, "v", 40.0).select(*U, "sample_idx", F.round("unwrapped", 6).alias("unwrapped"))


@query(f"""with {S}, h as (select *, floor(value)::bigint % 64 as v from s), d as (select *, v - lag(v) over (partition by user_id order by sample_idx) as d from h)
select user_id, sample_idx, sum(case when d <= -32 then 1 when d >= 32 then -1 else 0 end) over (partition by user_id order by sample_idx)::bigint as turns, (sum(case when d <= -32 then 1 when d >= 32 then -1 else 0 end) over (partition by user_id order by sample_idx) * 64 + v)::bigint as unwrapped from d""")
def wrap_turns(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("v", F.floor("value") % 64)
    return series.wrap_turns(s, U, "v", 64, 32).select(*U, "sample_idx", "turns", F.col("unwrapped").cast("long").alias("unwrapped"))


@query(f"""with recursive {S}, f as (select user_id, sample_idx, value as e from s where sample_idx = 0 union all
select s.user_id, s.sample_idx, case when abs(f.e - s.value) < 3.0 then f.e else 0.25 * s.value + (1 - 0.25) * f.e end from f join s on s.user_id = f.user_id and s.sample_idx = f.sample_idx + 1)
select user_id, sample_idx, floor(e + 0.5)::bigint as ema from f""")
def ema_deadband(spark, sf_dir):
    return series.ema_deadband(samples(spark, sf_dir), U, "value", 0.25, 3.0).select(*U, "sample_idx", "ema")


@query(f"with {S}, c as (select *, count(*) over (partition by user_id) as n from s), i as (select distinct user_id, ((k * (n - 1)) // 15)::bigint as sample_idx from c, unnest(range(0, 16)) as u(k) where n > 16 union select user_id, sample_idx from c where n <= 16) select user_id, sample_idx, event_id from i join s using (user_id, sample_idx)")
def downsample(spark, sf_dir):
    return series.downsample(samples(spark, sf_dir), U, 16).select(*U, "sample_idx", "event_id")


@query("select user_id, event_id, value from events where event_type <> 'error' and isfinite(value)")
def masked_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("active_mask_qc", F.col("event_type") != "error")
    return selection.masked_values(e, "value", ["user_id", "event_id"])


@query("select event_type, round(a - case when b > a then 0.03 * (b - a) else 1 end, 6) as lo, round(b + case when b > a then 0.03 * (b - a) else 1 end, 6) as hi from (select event_type, min(value) as a, max(value) as b from events group by 1)")
def y_range(spark, sf_dir):
    return selection.y_range(table(spark, sf_dir, "events"), ["value"], ["event_type"]).withColumns(r6("lo", "hi"))


@query(f"with {S} select user_id, (t_us // 86400000000)::bigint as cell, round(avg(value), 6) as mean, count(value) as n from s group by 1, 2")
def capture_average(spark, sf_dir):
    return selection.capture_average(samples(spark, sf_dir), U, "t_us", "value", 86_400_000).withColumns(r6("mean"))


@query("select distinct event_type, user_id from events where event_type <> 'error'")
def pair_options(spark, sf_dir):
    return selection.options(table(spark, sf_dir, "events"), "event_type", "user_id", without=["error"])


@query("select o_orderpriority as template_id, max(o_orderkey) as version from orders group by 1")
def latest_template(spark, sf_dir):
    return selection.latest(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("template_id"), F.col("o_orderkey").alias("version")))


@query("select coalesce(o_orderstatus, 'ok') as reason, count(*) as n from orders group by 1")
def quality_summary(spark, sf_dir):
    from ridgeline.plans.contracts import quality_summary as summary

    return summary(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("reason")))


@query(f"""with {S}, l as (select *, lead(t_s) over w as nt, lead(value) over w as nv from s window w as (partition by user_id order by sample_idx)),
c as (select *, case when (value + nv) / 2 >= 40 then 4 when (value + nv) / 2 >= 30 then 3 when (value + nv) / 2 >= 20 then 2 when (value + nv) / 2 >= 10 then 1 else 0 end as k from l where nt > t_s),
r as (select *, sum(case when k = lag_k and sample_idx = lag_i + 1 then 0 else 1 end) over (partition by user_id order by sample_idx) as run from (select *, lag(k) over w as lag_k, lag(sample_idx) over w as lag_i from c window w as (partition by user_id order by sample_idx)))
select user_id, run::bigint as run, k as speed_class, count(*) + 1 as n_points from r group by user_id, run, k""")
def colour_runs(spark, sf_dir):
    from ridgeline.sources.gps import colour_runs as runs

    s = samples(spark, sf_dir).withColumns({"lat": F.col("t_s"), "lon": F.col("value")})
    seg = series.route_segments(s, U, "t_s", "value", "lat", "lon").withColumn("ms", F.col("segment_speed") / 3.6)
    return runs(seg, "lat", "lon", "ms", U).select(*U, "run", "speed_class", F.size("points").cast("long").alias("n_points"))


@query(f"""with {S}, h as (select unnest([1, 2, 3]) as harmonic)
select user_id, harmonic::int as harmonic, round(sqrt(pow(2 * avg(value * cos(t_s * 2 * pi() / 86400 * harmonic)), 2) + pow(2 * avg(value * sin(t_s * 2 * pi() / 86400 * harmonic)), 2)), 3) as amplitude from s, h group by 1, 2""")
def harmonics(spark, sf_dir):
    from ridgeline.operators.bench import harmonics as fitted

    return fitted(samples(spark, sf_dir), U, "t_s", "value", 86400.0).select(*U, "harmonic", F.round("amplitude", 3).alias("amplitude"))


@query()
def savgol_vel_acc(spark, sf_dir):
    from ridgeline.operators import signal

    return by_length(samples(spark, sf_dir), U, lambda s, b: signal.derivatives(s, U, "value", 1.0, block=b)).select(*U, "sample_idx", F.round("vel", 6).alias("vel"), F.round("acc", 6).alias("acc"))


@query()
def butterworth(spark, sf_dir):
    from ridgeline.operators import signal

    return by_length(samples(spark, sf_dir), U, lambda s, b: signal.smoothed(s, U, "value", 10.0, 1.0, block=b)).select(*U, "sample_idx", F.round("smooth", 6).alias("smooth"))


@query()
def prominent_peaks(spark, sf_dir):
    from ridgeline.operators import signal

    return by_length(samples(spark, sf_dir), U, lambda s, b: signal.peaks(s, U, "value", "max", 3, 20.0, block=b)).select(*U, "sample_idx", F.round("strength", 6).alias("strength"))


@query()
def phased_crossing(spark, sf_dir):
    from ridgeline.operators import signal

    return by_length(samples(spark, sf_dir), U, lambda s, b: signal.phased(s, U, "value", 20.0, 60.0, direction="either", block=b)).select(*U, "sample_idx")


@query()
def capture_period(spark, sf_dir):
    from ridgeline.operators.bench import periods

    return periods(samples(spark, sf_dir).withColumn("n", F.col("sample_idx").cast("double")), U, "n", "value", 2.0, 20.0).select(*U, F.round("period_s", 5).alias("period_s"))

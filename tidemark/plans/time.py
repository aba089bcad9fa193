"""Series, survival and learning over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learning as ml
from tidemark.operators import lifetimes as li
from tidemark.operators import questions as qu
from tidemark.operators import series as se
from tidemark.operators import survival as su
from tidemark.plans.summaries import r, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day_text(c="period"):
    return F.date_format(c, "yyyy-MM-dd").alias("period")


@query("""with d as (select ts::date as d, count(*) as k from events group by 1), g as (select date_diff('day', lag(d) over (order by d), d) as gap from d),
s as (select (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000.0 as span from events)
select round(span, 6) as span_days, (select count(*) from d) as days, (select median(gap) from g) as median_gap, case when span < 3 then 'H' when (select count(*) from d) / greatest(span, 1.0) >= 0.5 then 'D' else '?' end as freq from s""")
def series_frequency_detect(spark, d):
    return se.frequency_profile(read(spark, d, "events"), "ts").select(r("span_days", 6).alias("span_days"), "days", "median_gap", "freq")


@query("select strftime(ts::date, '%Y-%m-%d') as period, round(sum(value), 4) as y, count(*) as n from events group by 1")
def series_daily(spark, d):
    return se.aggregate(read(spark, d, "events"), "ts", "D", "sum", "value").select(day_text(), r("y").alias("y"), "n")


@query("select strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as period, round(max_by(o_totalprice, (o_orderdate, o_orderkey)), 4) as y, count(*) as n from orders group by 1")
def series_weekly_last(spark, d):
    return se.aggregate(read(spark, d, "orders"), "o_orderdate", "W", "last", "o_totalprice", "o_orderkey").select(day_text(), r("y").alias("y"), "n")


@query("""with s as (select user_id, ts::date as period, avg(value) as y from events group by 1, 2), b as (select user_id, min(period) as a, max(period) as z from s group by 1),
g as (select user_id, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as period from b), f as (select g.user_id, g.period, s.y from g left join s on g.user_id = s.user_id and g.period = s.period),
n as (select *, last_value(case when y is not null then {'p': period, 'y': y} end ignore nulls) over (partition by user_id order by period rows between unbounded preceding and current row) as a,
first_value(case when y is not null then {'p': period, 'y': y} end ignore nulls) over (partition by user_id order by period rows between current row and unbounded following) as b from f)
select user_id, strftime(period, '%Y-%m-%d') as period, round(coalesce(y, a.y + (b.y - a.y) * date_diff('day', a.p, period) / date_diff('day', a.p, b.p)), 7) as y from n""")
def series_fill_interpolate(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "mean", "value", by=["user_id"])
    # Values have two decimals, so means and points between them end in 5 at four places now and then, where the order of a sum decides.
    return se.fill(made, "D", "mean", ["user_id"]).select("user_id", day_text(), r("y", 7).alias("y"))


TREND = """with s as (select event_type, ts::date as d, count(*)::double as y from events group by 1, 2), i as (select *, row_number() over (partition by event_type order by d) - 1 as i from s),
f as (select event_type, count(*) as n, regr_slope(y, i) as b, regr_intercept(y, i) as a, regr_sxx(y, i) as sxx from i group by 1), e as (select i.event_type, i.i, y - a - b * i.i as e, lag(y - a - b * i.i) over (partition by i.event_type order by i.i) as p from i join f using (event_type)),
q as (select event_type, sum(e * e) as sse, least(greatest(coalesce(sum(e * p) / nullif(sum(e * e), 0), 0), 0), 0.95) as rho from e group by 1), o as (select event_type, n, b, rho, 1.96 * sqrt(sse / (n - 2) / sxx) * sqrt((1 + rho) / (1 - rho)) as w from f join q using (event_type))"""


@query(TREND + " select event_type, n, round(b, 8) as slope, round(rho, 8) as rho, round(b - w, 8) as low, round(b + w, 8) as high, case when b - w > 0 then 'up' when b + w < 0 then 'down' else 'stable' end as direction from o")
def trend_ols(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count", by=["event_type"])
    return se.trend(made, ["event_type"]).select("event_type", "n", *[r(c, 8).alias(c) for c in ("slope", "rho", "low", "high")], "direction")


@query("""with s as (select ts::date as d, count(*)::double as y from events group by 1), l as (select d, y, avg(y) over w as level, count(y) over w as k from s window w as (order by d rows between 3 preceding and 3 following)),
m as (select *, (select min(least(y, level)) > 0 from l where k >= 3) as ratio from l where k >= 3)
select (isodow(d) - 1)::int as position, round(avg(case when ratio then y / level else y - level end), 8) as effect, count(*) as n from m group by 1""")
def seasonality_weekday(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count")
    return se.seasonality(made, "D").select("position", r("effect", 8).alias("effect"), "n")


@query("""with s as (select ts::date as d, count(*) as n from events group by 1), l as (select max(d) as d from s), t as (select median(n) as typical from (select n from s, l where s.d < l.d order by s.d desc limit 7))
select strftime(s.d, '%Y-%m-%d') as period, s.n, typical, (select count(*) from s) >= 9 and typical >= 3 and s.n < 0.5 * typical as incomplete from s join l on s.d = l.d, t""")
def incomplete_last_period(spark, d):
    events = read(spark, d, "events")
    return se.incomplete_last(events, se.aggregate(events, "ts", "D", "count"), "ts", "D").select(day_text(), "n", "typical", "incomplete")


@query("""with b as (select user_id, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as before from events)
select user_id, count(*) as rows, round(sum(greatest(before - value, 0)), 4) as consumed from b where before is not null group by 1""")
def stock_consumption(spark, d):
    used = se.stock_consumption(read(spark, d, "events"), "user_id", "ts", "value", "event_id")
    return used.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("consumed"), 4).alias("consumed"))


@query("""with s as (select ts::date as d, count(*) as y from events group by 1), ok as (select max(d) as d from s where not y > 5)
select count(*) as periods from s, ok where ok.d is null or s.d > ok.d""")
def threshold_streak(spark, d):
    return se.trailing_streak(se.aggregate(read(spark, d, "events"), "ts", "D", "count"), 5.0)


@query()
def forecast_projection(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "sum", "value", by=["event_type"])
    return se.project(se.fill(made, "D", "sum", ["event_type"]), "D", ["event_type"], 14)


SPANS = """with t as (select distinct user_id, epoch_us(ts) as t from events where event_type = 'error'), e as (select user_id, max(epoch_us(ts)) as last from events group by 1),
n as (select *, lead(t) over (partition by user_id order by t) as nx from t), s as (select user_id, (coalesce(nx, last) - t) / 86400000000.0 as days, nx is not null as event from n join e using (user_id) where coalesce(nx, last) > t)"""


def _spans(spark, d):
    return su.spans(read(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error")


@query(SPANS + " select user_id as entity, round(days, 8) as days, event from s")
def survival_spans(spark, d):
    return _spans(spark, d).select("entity", r("days", 8).alias("days"), "event")


CURVE = """, k as (select {by} days, count(*) as n, count(*) filter (event) as events from s group by all), q as (select *, sum(n) over ({part} order by days desc) as risk from k),
c as (select {by} days, risk::bigint as at_risk, events, case when max((events >= risk)::int) over w > 0 then 0.0 else exp(sum(case when events < risk then ln(1 - events / risk) else 0 end) over w) end as survival from q window w as ({part} order by days))"""


@query(SPANS + CURVE.format(by="", part="") + " select round(days, 8) as days, at_risk, events, round(survival, 8) as survival from c")
def km_curve(spark, d):
    return su.survival_curve(_spans(spark, d)).select(r("days", 8).alias("days"), "at_risk", "events", r("survival", 8).alias("survival"))


@query("with s as (select o_orderpriority, greatest(date_diff('day', o_orderdate, case when o_custkey % 5 > 0 then o_orderdate + interval (1 + o_custkey % 40) day end), 0.5)::double as days, true as event from orders where o_custkey % 5 > 0 union all select o_orderpriority, case when o_orderdate = timestamp '1999-01-01' then 0.5 else (epoch_us(timestamp '1999-01-01') - epoch_us(o_orderdate)) / 86400000000.0 end, false from orders where o_custkey % 5 = 0 and o_orderdate <= timestamp '1999-01-01')"
    + CURVE.format(by="o_orderpriority,", part="partition by o_orderpriority") + " select o_orderpriority, round(days, 6) as days, at_risk, events, round(survival, 8) as survival from c")
def km_by_group(spark, d):
    rows = _cases(spark, d)
    return su.survival_curve(rows, ["o_orderpriority"]).select("o_orderpriority", r("days", 6).alias("days"), "at_risk", "events", r("survival", 8).alias("survival"))


def _cases(spark, d):
    end = F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderdate") + F.expr("make_dt_interval(cast(1 + o_custkey % 40 as int))"))
    return su.durations(read(spark, d, "orders").withColumn("done", end.cast("timestamp_ntz")), "o_orderdate", "done", "1999-01-01 00:00:00", ["o_orderpriority"])


@query("select o_orderpriority, count(*) as rows, count(*) filter (o_custkey % 5 > 0) as finished from orders where o_custkey % 5 > 0 or o_orderdate <= timestamp '1999-01-01' group by 1")
def duration_censored(spark, d):
    return _cases(spark, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("event"), 1)).alias("finished"))


@query(SPANS + CURVE.format(by="", part="") + " select round(min(days), 8) as days from c where survival <= 0.5 + 1e-12")
def km_median(spark, d):
    return su.quantile_time(su.survival_curve(_spans(spark, d)), 0.5).select(r("days", 8).alias("days"))


@query("""with e as (select event_id, user_id, epoch_us(ts) as t, event_type = 'error' as e from events), c as (select max(t) as cut from e)
select event_id as row, exists (select 1 from e x where x.user_id = e.user_id and x.e and x.t > e.t and x.t <= e.t + 5 * 86400000000) as label,
round((e.t - (select max(x.t) from e x where x.user_id = e.user_id and x.e and x.t < e.t)) / 86400000000.0, 6) as days_since,
(select count(distinct x.t) from e x where x.user_id = e.user_id and x.e and x.t < e.t) as events_before, e.t + 5 * 86400000000 <= cut as observable from e, c""")
def failure_features(spark, d):
    out = su.event_features(read(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 5, "event_id")
    return out.select("row", "label", r("days_since", 6).alias("days_since"), "events_before", "observable")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def last_row_of_entity(spark, d):
    return su.last_row(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("""with p as (select l_suppkey as entity, avg(l_discount) as risk, sum(l_extendedprice) as cost from lineitem group by 1), s as (select entity, round(risk * cost, 4) as score from p)
select entity, score, round(sum(score) over (order by score desc, entity rows between unbounded preceding and current row) / sum(score) over (), 6) as share from s""")
def priority_pareto(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("risk"), F.sum("l_extendedprice").alias("cost"))
    rows = rows.select("l_suppkey", F.round(F.col("risk") * F.col("cost"), 4).alias("risk"), F.lit(1.0).alias("cost"))
    return su.priority(rows, "l_suppkey", "risk", "cost").select("entity", "score", r("share", 6).alias("share"))


@query("""with d as (select user_id, date_diff('day', ts::date, (select max(ts::date) from events)) as back, sum(value) as c from events group by 1, 2), w as (select user_id, 55 - back as place, coalesce(c, 0) as c from d where back < 56),
t as (select user_id, coalesce(sum(c) filter (place < 18), 0) / 18 as a, coalesce(sum(c) filter (place >= 38), 0) / 18 as b, coalesce(sum(c * c) filter (place < 18), 0) / 18 as aa, coalesce(sum(c * c) filter (place >= 38), 0) / 18 as bb from w group by 1),
s as (select *, abs(b - a) > 2 * greatest(sqrt(greatest(aa - a * a, 0) / 18 + greatest(bb - b * b, 0) / 18), 1e-12) as clear from t)
select user_id, round(a, 6) as first, round(b, 6) as last, case when clear and a >= 0 and b > 1.25 * a then 'rising' when clear and a > 0 and b < 0.75 * a then 'falling' else 'stable' end as trend from s""")
def consumption_trend(spark, d):
    told = su.consumption_trend(read(spark, d, "events"), "user_id", "ts", "value")
    return told.select(F.col("entity").alias("user_id"), r("first", 6).alias("first"), r("last", 6).alias("last"), "trend")


@query()
def depletion(spark, d):
    rows = read(spark, d, "events").withColumn("stock", F.lit(500.0) + F.col("value"))
    return su.depletion(rows, "user_id", "ts", "value", "stock", "event_id")


@query("""select 'o_custkey' as column, 0.0::double as missing_share, count(distinct o_custkey) as distinct_values, null as reason from orders
union all select 'o_orderkey', 0.0, count(distinct o_orderkey), case when count(distinct o_orderkey) = count(*) and min(o_orderkey) in (0, 1) and max(o_orderkey) - min(o_orderkey) = count(*) - 1 then 'row_number' end from orders
union all select 'o_orderstatus', 0.0, count(distinct o_orderstatus), null from orders union all select 'fixed', 0.0, 1, 'constant' union all select 'twice', 0.0, count(distinct o_totalprice), 'same_as_target' from orders
union all select 'name', 0.0, count(distinct o_orderkey), 'almost_unique' from orders union all select 'rare', round(avg((o_orderkey % 100 > 0)::int), 6), count(distinct o_orderkey) filter (o_orderkey % 100 = 0), 'almost_empty' from orders""")
def column_profile_suggest(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit("x").alias("fixed"), (F.col("o_totalprice") * 2).alias("twice"), F.concat(F.lit("n"), F.col("o_orderkey")).alias("name"), F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderkey")).alias("rare"))
    return ml.column_profile(o, "o_totalprice").withColumn("missing_share", r("missing_share", 6))


@query("""with t as (select (l_orderkey % 2)::int as y, l_returnflag as f, 'k' || (l_orderkey % 4) as leak from lineitem), m as (select max(n) / sum(n) as majority from (select count(*) as n from t group by y)),
c as (select 'f' as column, f as level, y, count(*) as n from t group by 2, 3 union all select 'leak', leak, y, count(*) from t group by 2, 3), l as (select "column", level, max(n) as best, sum(n) as rows from c group by 1, 2)
select "column", count(*) as levels, round(sum(best) / sum(rows), 6) as purity, round(any_value(majority), 6) as majority,
sum(best) / sum(rows) >= 0.995 and sum(best) / sum(rows) >= any_value(majority) + 0.02 and count(*) between 2 and 50 and sum(rows) >= 20 * count(*) as leak from l, m group by 1""")
def leakage_purity(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 2).cast("int").alias("y"), F.col("l_returnflag").alias("f"), F.concat(F.lit("k"), F.col("l_orderkey") % 4).alias("leak"))
    return ml.category_purity(rows, "y", ["f", "leak"]).withColumns({c: r(c, 6) for c in ("purity", "majority")})


def _guessed(spark, d):
    y = (F.col("l_returnflag") == "R").cast("int")
    return read(spark, d, "lineitem").select(y.alias("y"), (F.col("l_quantity") / 51).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("said"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 1_000 + F.col("l_suppkey")).alias("tie"))


@query("""with t as (select (l_returnflag = 'R')::int as y, (l_quantity > 25)::int as p from lineitem), k as (select y as c, count(*) as n, count(*) filter (y = p) as hit, (select count(*) from t b where b.p = a.y) as said from t a group by 1)
select round(sum(hit) / sum(n), 8) as accuracy, round(avg(hit / n), 8) as balanced_accuracy, round(avg(2.0 * hit / (n + said)), 8) as macro_f1 from k""")
def balanced_accuracy(spark, d):
    return ml.class_metrics(_guessed(spark, d), "y", "said").select(*[r(c, 8).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@query("""with t as (select (l_returnflag = 'R')::int as y, l_quantity / 51 as s from lineitem), k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from t)
select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1)::double * count(*) filter (y = 0)), 8) as auc from k""")
def auc(spark, d):
    return ml.rank_auc(_guessed(spark, d), "y", "p").select(r("auc", 8).alias("auc"))


@query("""with t as (select event_id, (event_type = 'error')::int as y, (event_id * 7919 % 1000003) / 1000003.0::double as p from events), b as (select *, ntile(10) over (order by p, event_id) - 1 as bin from t)
select bin::int as bin, count(*) as n, round(avg(p), 8) as mean_p, round(avg(y), 8) as rate from b group by 1""")
def calibration_table(spark, d):
    rows = read(spark, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), ((F.col("event_id") * 7919 % 1_000_003) / 1_000_003.0).alias("p"))
    return ml.reliability(rows, "y", "p", "event_id", 10).select("bin", "n", r("mean_p", 8).alias("mean_p"), r("rate", 8).alias("rate"))


@query("""with t as (select l_extendedprice as y, l_quantity * 1500 as p from lineitem), m as (select avg(y) as m from t)
select count(*) as n, round(sqrt(avg((p - y) * (p - y))), 4) as rmse, round(avg(abs(p - y)), 4) as mae, round(1 - sum((p - y) * (p - y)) / sum((y - m) * (y - m)), 8) as r2, round(avg(p - y), 4) as bias, round(avg(abs(y - m)), 4) as mae_of_mean from t, m""")
def regression_metrics(spark, d):
    rows = _guessed(spark, d).withColumn("guess", F.col("q") * 1500)
    return ml.regression_metrics(rows, "price", "guess").select("n", *[r(c, 8 if c == "r2" else 4).alias(c) for c in ("rmse", "mae", "r2", "bias", "mae_of_mean")])


@query("""with t as (select avg(abs(l_quantity * 1500 - l_extendedprice)) as mae, avg(l_quantity * 1500 - l_extendedprice) as bias, count(*) as n from lineitem)
select n, round(mae, 4) as mae, round(bias, 4) as bias, round(mae / 9000, 6) as ratio, case when n < 30 then 'info' when mae / 9000 <= 1.25 then 'well' when mae / 9000 <= 2 then 'watch' else 'alert' end as level from t""")
def returns_regression(spark, d):
    out = ml.returns_regression(_guessed(spark, d).withColumn("guess", F.col("q") * 1500), "price", "guess", 9_000.0)
    return out.select("n", r("mae").alias("mae"), r("bias").alias("bias"), r("ratio", 6).alias("ratio"), "level")


BINARY = "with t as (select (l_returnflag = 'R')::int as y, l_quantity / 51 as p, l_orderkey * 1000 + l_suppkey as tie from lineitem)"


@query(BINARY + """, g as (select p, count(*) as n, sum(y) as y from t group by 1), w as (select p, y, sum(n) over (order by p desc) as seen, sum(y) over (order by p desc) as hit from g),
a as (select sum(y * hit / seen) / sum(y) as average_precision from w)
select count(*) as n, sum(y)::bigint as positives, round(avg(-case when y = 1 then ln(least(greatest(p, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end), 8) as log_loss, round(avg((p - y) * (p - y)), 8) as brier, round(avg(y) * (1 - avg(y)), 8) as brier_of_rate,
round(any_value(average_precision), 8) as average_precision, round(sum(y) filter (p >= 0.5) / sum(y), 8) as recall, round(avg(y) filter (p >= 0.5), 8) as precision from t, a""")
def probability_metrics(spark, d):
    out = ml.probability_metrics(_guessed(spark, d), "y", "p")
    return out.select("n", "positives", *[r(c, 8).alias(c) for c in ("log_loss", "brier", "brier_of_rate", "average_precision", "recall", "precision")])


@query("""with t as (select l_returnflag as a, l_quantity / 51 as pr, 1 - l_quantity / 51 as pn, l_discount * 10 as pa from lineitem), e as (select a, 'R' as class, pr as s from t union all select a, 'N', pn from t union all select a, 'A', pa from t),
k as (select class, a = class as is_, rank() over (partition by class order by s) + (count(*) over (partition by class, s) - 1) / 2.0 as r from e)
select class, round((sum(r) filter (is_) - count(*) filter (is_) * (count(*) filter (is_) + 1) / 2.0) / (count(*) filter (is_)::double * count(*) filter (not is_)), 8) as auc from k group by 1""")
def several_class_auc(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), (F.col("l_quantity") / 51).alias("pr"), (1 - F.col("l_quantity") / 51).alias("pn"), (F.col("l_discount") * 10).alias("pa"))
    return ml.several_class_auc(rows, "a", {"R": "pr", "N": "pn", "A": "pa"}).select("class", r("auc", 8).alias("auc"))


EVENT_P = "with t as (select event_id, (event_type = 'error')::int as y, (event_id * 7919 % 1000003) / 1000003.0::double as p from events), m as (select count(*) as n, least(greatest(count(*) // 50, 2), 10) as bins, avg((p - y) * (p - y)) as brier, avg(y) * (1 - avg(y)) as of_rate, 0.05 + 0.5 / sqrt(count(*)) as tolerance, count(*) >= 200 and least(sum(y), count(*) - sum(y)) >= 20 as told from t), i as (select t.*, row_number() over (order by p, event_id) - 1 as pos, n // bins as size, n % bins as more from t, m), b as (select case when pos < more * (size + 1) then pos // (size + 1) else more + (pos - more * (size + 1)) // greatest(size, 1) end as bin, p, y from i), e as (select sum(c * abs(mp - my)) / sum(c) as ece from (select count(*) as c, avg(p) as mp, avg(y) as my from b group by bin))"


def _event_chances(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), ((F.col("event_id") * 7919 % 1_000_003) / 1_000_003.0).alias("p"))


@query(EVENT_P + " select n, bins::int as bins, round(ece, 8) as ece, round(brier, 8) as brier, round(tolerance, 8) as tolerance, case when told then ece <= tolerance end as calibrated from m, e")
def calibration_measures(spark, d):
    out = ml.calibration(_event_chances(spark, d), "y", "p", "event_id")
    return out.select("n", "bins", *[r(c, 8).alias(c) for c in ("ece", "brier", "tolerance")], "calibrated")


@query(EVENT_P + " select n, round(brier, 8) as brier, round(of_rate, 8) as brier_of_rate, round(ece, 8) as ece, round(tolerance, 8) as tolerance, case when not told then 'info' when ece > 2 * tolerance then 'alert' when ece > tolerance or brier >= of_rate then 'watch' else 'well' end as level from m, e")
def returns_probabilities(spark, d):
    out = ml.returns_probabilities(_event_chances(spark, d), "event_id", "y", "p")
    return out.select("n", *[r(c, 8).alias(c) for c in ("brier", "brier_of_rate", "ece", "tolerance")], "level")


@query("""with t as (select l_returnflag as a, case when l_quantity > 34 then 'R' when l_quantity > 17 then 'N' else 'A' end as p from lineitem), k as (select a, count(*) as n, count(*) filter (a = p) as hit from t group by 1),
m as (select sum(n)::bigint as n, sum(hit) / sum(n) as acc, avg(hit / n) as bal, max(n) / sum(n) as majority from k)
select n, round(acc, 8) as accuracy, round(bal, 8) as balanced_accuracy, round(majority, 8) as majority, case when n < 30 or bal >= 0.6 - (0.05 + 0.5 / sqrt(n)) then case when acc <= majority + 0.005 then 'watch' when n < 30 then 'info' else 'well' end when bal >= 0.6 - 2 * (0.05 + 0.5 / sqrt(n)) then 'watch' else 'alert' end as level from m""")
def returns_classes(spark, d):
    said = F.when(F.col("l_quantity") > 34, "R").when(F.col("l_quantity") > 17, "N").otherwise("A")
    out = ml.returns_classes(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), said.alias("p")), "a", "p", 0.6)
    return out.select("n", *[r(c, 8).alias(c) for c in ("accuracy", "balanced_accuracy", "majority")], "level")


@query(BINARY + """, k as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from t), a as (select count(*) as n, (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1)::double * count(*) filter (y = 0)) as auc from k)
select n, round(auc, 8) as auc, case when n >= 30 and auc < 0.7 - 2 * (0.05 + 0.5 / sqrt(n)) then 'alert' when n >= 30 and auc < 0.7 - (0.05 + 0.5 / sqrt(n)) or auc <= 0.55 then 'watch' when n < 30 then 'info' else 'well' end as level from a""")
def returns_ranking(spark, d):
    return ml.returns_ranking(_guessed(spark, d), "y", "p", 0.7).select("n", r("auc", 8).alias("auc"), "level")


@query("""with a as (select o_orderkey, o_orderpriority as p, o_clerk as c, o_orderdate < timestamp '1995-01-01' as train from (select *, 'k' || (o_custkey % 300 + year(o_orderdate) * 40) as o_clerk from orders)), e as (select o_orderkey, train, 'p' as column, p as value from a union all select o_orderkey, train, 'c', c from a),
n as (select "column", value, count(*) as n from e where not train and (e."column", e.value) not in (select ("column", value) from e where train) group by 1, 2)
select x as column, coalesce(sum(n), 0)::bigint as unseen_rows, count(n) as unseen_values from (values ('p'), ('c')) v(x) left join n on n."column" = x group by 1""")
def unseen_values(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.concat(F.lit("k"), F.col("o_custkey") % 300 + F.year("o_orderdate") * 40).alias("c"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("train"))
    return ml.unseen_values(o.where("train"), o.where("not train"), ["p", "c"])


@query()
def boosted_with_stops(spark, d):
    """Rows predicted by folds whose boosting stops early, for up to forty rounds."""
    rows = _large_orders(spark, d)
    return ml.final_fit(rows, "o_orderkey", "large", ["o_orderstatus", "o_orderpriority", "lines", "quantity"], most_rounds=40)[0].select("o_orderkey", "large", "probability")


@query()
def train_predict_regression(spark, d):
    """All rows in three folds, each predicted by a model that hasn't seen it."""
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey")).alias("row"), "l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_extendedprice")
    return ml.out_of_fold(rows, "row", "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag", "l_shipdate"], kind="regression").select("row", "l_extendedprice", "prediction")


@query()
def train_predict_binary(spark, d):
    rows = _large_orders(spark, d)
    return ml.out_of_fold(rows, "o_orderkey", "large", ["o_orderstatus", "o_orderpriority", "lines", "quantity"]).select("o_orderkey", "large", "probability")


def _large_orders(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("worth"))
    both = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "lines", "quantity", (F.col("worth") > 100_000).cast("int").alias("large"))


@query()
def permutation_importance(spark, d):
    return ml.permutation_importance(_large_orders(spark, d), "o_orderkey", "large", ["o_orderstatus", "lines", "quantity"])


@query()
def linear_reference(spark, d):
    rows = _large_orders(spark, d)
    return ml.linear_reference(rows, "o_orderkey", "large", ["o_orderstatus", "o_orderpriority", "lines", "quantity"]).select("o_orderkey", "large", "probability")


@query("""with n as (select count(*) as n from orders), t as (select o_orderkey, o_orderstatus, row_number() over (order by o_orderdate, o_orderkey) - 1 as i from orders)
select least(floor(i * 4 / n), 3)::int as part, count(*) as rows, min(o_orderkey) as first, max(o_orderkey) as last from t, n group by 1""")
def folds_by_time(spark, d):
    return ml.with_folds(read(spark, d, "orders"), "o_orderkey", 3, "time", time="o_orderdate").groupBy(F.col("_fold").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("""with c as (select o_orderstatus, count(*) as n from orders group by 1), f as (select unnest(range(5)) as fold)
select o_orderstatus, fold::int as fold, (n // 5 + case when fold between 1 and n % 5 then 1 else 0 end)::bigint as rows from c, f where n // 5 + case when fold between 1 and n % 5 then 1 else 0 end > 0""")
def folds_stratified(spark, d):
    return ml.with_folds(read(spark, d, "orders"), "o_orderkey", 5, "stratified", target="o_orderstatus").groupBy("o_orderstatus", F.col("_fold").alias("fold")).agg(F.count(F.lit(1)).alias("rows"))


@query("""with n as (select count(*)::double as n, count(distinct o_orderstatus) as k from orders) select o_orderstatus, round(any_value(n) / (any_value(k) * count(*)), 8) as weight from orders, n group by 1""")
def class_weights(spark, d):
    return ml.balanced_weights(read(spark, d, "orders"), "o_orderstatus").groupBy("o_orderstatus").agg(r(F.max("weight"), 8).alias("weight"))


@query("""with s as (select strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as period, sum(o_totalprice) as y, date_trunc('week', o_orderdate)::date as w from orders group by 1, 3), m as (select max(o_orderdate)::date as last from orders),
g as (select unnest(generate_series(min(w)::timestamp, (select max(w) from s, m where last >= w + 4)::timestamp, interval 7 day))::date as w from s)
select strftime(g.w, '%Y-%m-%d') as period, round(coalesce(y, 0), 2) as y from g left join s on s.w = g.w""")
def series_prepared(spark, d):
    ready = qu.prepare(read(spark, d, "orders"), "o_orderdate", "o_totalprice", "sum", "W")
    return ready.series.select(day_text(), r("y", 2).alias("y"))


STRENGTH = """with s as (select event_type, ts::date as d, count(*)::double as y from events group by 1, 2), l as (select event_type, d, y, row_number() over (partition by event_type order by d) - 1 as i, avg(y) over w as level, count(y) over w as k from s window w as (partition by event_type order by d rows between 3 preceding and 3 following)),
q as (select event_type, i % 7 as place, case when k >= 3 then y - level end as rest from l), p as (select *, rest - avg(rest) over (partition by event_type, place) as left_ from q)"""


@query(STRENGTH + " select event_type, count(*) as n, round(case when count(rest) >= 14 and var_pop(rest) > 0 then least(greatest(1 - var_pop(left_) / var_pop(rest), 0), 1) else 0 end, 8) as strength from p group by 1")
def seasonal_strength(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count", by=["event_type"])
    return se.seasonal_strength(made, 7, ["event_type"]).withColumn("strength", r("strength", 8))


@query(STRENGTH + ", a as (select event_type, place, avg(rest) as e from q where rest is not null group by 1, 2) select event_type, place::int as place, round(e - avg(e) over (partition by event_type), 8) as effect from a")
def season_indices(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count", by=["event_type"])
    return se.season_indices(made, 7, ["event_type"]).select("event_type", "place", r("effect", 8).alias("effect"))


CHOICE = """with s as (select event_type, ts::date as d, count(*)::double as y from events group by 1, 2), i as (select *, row_number() over (partition by event_type order by d) - 1 as i, count(*) over (partition by event_type) as n from s),
""" + ", ".join(f"""l{m} as (select *, avg(y) over w as level, count(y) over w as k from i window w as (partition by event_type order by d rows between {m // 2} preceding and {(m - 1) // 2} following)),
q{m} as (select *, i % {m} as place, case when k >= {max(2, m // 2)} then y - level end as rest from l{m}), p{m} as (select *, rest - avg(rest) over (partition by event_type, place) as left_ from q{m}),
t{m} as (select event_type, any_value(n) as n, case when count(rest) >= {2 * m} and var_pop(rest) > 0 then least(greatest(1 - var_pop(left_) / var_pop(rest), 0), 1) else 0 end as strength from p{m} group by 1),
e{m} as (select event_type, place, avg(rest) filter (i < n // 2) as e0, avg(rest) filter (i >= n // 2) as e1 from q{m} where rest is not null group by 1, 2),
c{m} as (select event_type, {m} as cycle, strength, case when n >= {4 * m} then (select corr(e0, e1) from e{m} where e{m}.event_type = t{m}.event_type) end as stability from t{m} where n >= {2 * m})""" for m in (5, 7)) + """,
b as (select * from c5 union all select * from c7)"""


@query(CHOICE + " select event_type, cycle::int as cycle, round(strength, 8) as strength, round(stability, 6) as stability from (select *, row_number() over (partition by event_type order by strength desc, cycle) as k from b) where k = 1")
def season_choice(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count", by=["event_type"])
    return se.season_choice(made, (5, 7), ["event_type"]).select("event_type", "cycle", r("strength", 8).alias("strength"), r("stability", 6).alias("stability"))


@query(STRENGTH + """, a as (select event_type, place, avg(rest) as e from q where rest is not null group by 1, 2), f as (select event_type, place, e - avg(e) over (partition by event_type) as e from a),
z as (select l.event_type, l.i, case when count(*) over (partition by l.event_type) >= 14 then l.y - coalesce(f.e, 0) else l.y end as y from l left join f on f.event_type = l.event_type and f.place = l.i % 7),
g as (select event_type, count(*) as n, regr_slope(y, i) as b, regr_intercept(y, i) as a from z group by 1) select event_type, n, round(b, 8) as slope, round(a, 6) as intercept from g""")
def trend_seasonless(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count", by=["event_type"])
    return se.seasonless_trend(made, 7, ["event_type"]).select("event_type", "n", r("slope", 8).alias("slope"), r("intercept", 6).alias("intercept"))


@query("""with s as (select event_type, ts::date as d, count(*)::double as y from events group by 1, 2), k as (select *, (row_number() over (partition by event_type order by d desc) - 1) // 7 as k, count(*) over (partition by event_type) // 7 as cycles from s),
m as (select event_type, any_value(cycles) as cycles, avg(y) filter (k = 0) as last, case when any_value(cycles) >= 2 then avg(y) filter (k = 1) end as previous from k group by 1 having any_value(cycles) >= 1)
select event_type, cycles, round(last, 6) as last, round(previous, 6) as previous, round((last - previous) / abs(previous), 6) as change from m""")
def last_whole_cycles(spark, d):
    made = se.aggregate(read(spark, d, "events"), "ts", "D", "count", by=["event_type"])
    return se.last_cycles(made, 7, ["event_type"]).select("event_type", "cycles", *[r(c, 6).alias(c) for c in ("last", "previous", "change")])


def _daily(spark, d, op="auto", value="value"):
    return qu.prepare(read(spark, d, "events"), "ts", value, op, "D", ["event_type"])


@query()
def threshold_cross(spark, d):
    return qu.threshold_crossing(_daily(spark, d, "sum"), 1_500.0)


@query()
def saturation(spark, d):
    return qu.saturation(_daily(spark, d, "max"), 400.0)


@query()
def scenario_elasticity(spark, d):
    events = read(spark, d, "events")
    return qu.scenario(qu.prepare(events, "ts", "value", "sum", "D", ["event_type"]), events.withColumn("rows", F.lit(1.0)), "ts", "rows", 0.1, "sum")


@query()
def forecast_table(spark, d):
    return qu.ask("projection", read(spark, d, "events"), date="ts", value="value", op="sum", freq="D", by=("event_type",), horizon=14)


LIFE = SPANS + CURVE.format(by="", part="") + """, tot as (select count(*) as n, sum(days) as total from s), u as (select max(days) as sup from c, tot where at_risk >= greatest(5, 0.05 * n)),
sv as (select sup, (select survival from c where days <= sup order by days desc limit 1) as s_end, coalesce((select survival from c where days <= sup / 2 order by days desc limit 1), 1.0) as s_mid from u),
rt as (select sup, s_end, greatest(case when s_end > 0 and s_mid > s_end then -ln(s_end / s_mid) / (sup / 2) else 0 end, 0.5 / total) as rate from sv, tot),
a as (select user_id as entity, max(days) as age from s where not event group by 1),
x as (select entity, age, coalesce((select survival from c where days <= least(a.age, sup) order by days desc limit 1), 1.0) * exp(-rate * greatest(a.age - sup, 0)) as s_now,
coalesce((select survival from c where days <= least(a.age + 5, sup) order by days desc limit 1), 1.0) * exp(-rate * greatest(a.age + 5 - sup, 0)) as s_then, a.age > sup as beyond from a, rt)"""


@query(LIFE + " select entity, round(age, 6) as age, round(case when s_now > 0 then 1 - s_then / s_now end, 6) as p, beyond from x")
def window_probabilities(spark, d):
    spans = _spans(spark, d)
    out = li.window_probability(li.fit(spans), li.alive(spans), 5.0)
    return out.select("entity", r("age", 6).alias("age"), r("p", 6).alias("p"), "beyond")


#: Age and chance by the curve of a group, or of all, from a curve table ``c`` and its tails.
OWN = """with ev as (select user_id, epoch_us(ts) as t, event_type from events), t as (select distinct user_id, t from ev where event_type = 'error'), e as (select user_id, max(t) as last from ev group by 1),
n as (select *, lead(t) over (partition by user_id order by t) as nx from t), s0 as (select n.user_id, 'g' || (n.user_id % 7 * (n.user_id % 7)) as g, (coalesce(nx, last) - t) / 86400000000.0 as days, nx is not null as event from n join e using (user_id) where coalesce(nx, last) > t),
own as (select g from s0 group by 1 having count(*) >= 20 and count(*) filter (event) >= 10), s as (select '' as curve, days, event from s0 union all select '=' || g, days, event from s0 join own using (g)),
k as (select curve, days, count(*) as n, count(*) filter (event) as events from s group by all), q as (select *, sum(n) over (partition by curve order by days desc) as risk from k),
c as (select curve, days, risk, case when max((events >= risk)::int) over w > 0 then 0.0 else exp(sum(case when events < risk then ln(1 - events / risk) else 0 end) over w) end as survival from q window w as (partition by curve order by days)),
tot as (select curve, count(*) as n, sum(days) as total from s group by 1), u as (select curve, coalesce(max(days) filter (risk >= greatest(5, 0.05 * n)), min(days)) as sup, any_value(total) as total from c join tot using (curve) group by 1),
rt as (select curve, sup, s_end, greatest(case when s_end > 0 and s_mid > s_end then -ln(s_end / s_mid) / (sup / 2) else 0 end, 0.5 / total) as rate from (select u.*, (select c.survival from c where c.curve = u.curve and c.days <= u.sup order by c.days desc limit 1) as s_end, coalesce((select c.survival from c where c.curve = u.curve and c.days <= u.sup / 2 order by c.days desc limit 1), 1.0) as s_mid from u)),
a as (select user_id as entity, max(days) as age, any_value(case when g in (select g from own) then '=' || g else '' end) as curve from s0 where not event group by 1),
x as (select entity, age, a.curve, coalesce((select c.survival from c where c.curve = a.curve and c.days <= least(a.age, sup) order by c.days desc limit 1), 1.0) * exp(-rate * greatest(a.age - sup, 0)) as s_now,
coalesce((select c.survival from c where c.curve = a.curve and c.days <= least(a.age + 5, sup) order by c.days desc limit 1), 1.0) * exp(-rate * greatest(a.age + 5 - sup, 0)) as s_then, a.age > sup as beyond from a join rt on a.curve = rt.curve)"""


@query(OWN + " select entity, curve, round(age, 6) as age, round(case when s_now > 0 then 1 - s_then / s_now end, 6) as p, beyond from x")
def own_or_whole_curve(spark, d):
    k = F.col("entity") % 7
    spans = _spans(spark, d).withColumn("g", F.concat(F.lit("g"), k * k))
    out = li.window_probability(li.fit(spans, by="g"), li.alive(spans, "g"), 5.0)
    return out.select("entity", "curve", r("age", 6).alias("age"), r("p", 6).alias("p"), "beyond")


@query("""with o as (select o_custkey as entity, epoch_us(o_orderdate) as t, o_orderstatus = 'F' and o_orderkey % 4 = 0 as e from orders), w as (select entity, min(t) as first, max(t) as last, epoch_us(timestamp '1992-01-01') as start from o group by 1),
x as (select distinct o.entity, o.t from o join w on o.entity = w.entity where e and o.t > start), y as (select *, lag(t) over (partition by entity order by t) as before from x),
l as (select entity, coalesce(before, start) as f, t, true as event from y join w using (entity) union all select entity, coalesce((select max(x.t) from x where x.entity = w.entity), start), last, false from w),
s as (select (t - f) / 86400000000.0 as days, event, greatest((first - f) / 86400000000.0, 0) as entry from l join w using (entity)), s1 as (select * from s where days > entry),
k as (select days, count(*) as n, count(*) filter (event) as events from s1 group by 1), q as (select *, (select count(*) from s1 where s1.entry < k.days and s1.days >= k.days) as risk from k)
select round(days, 6) as days, risk as at_risk, events, round(case when max((events >= risk and events > 0)::int) over w > 0 then 0.0 else exp(sum(case when events < risk then ln(1 - events / risk) else 0 end) over w) end, 8) as survival from q window w as (order by days)""")
def km_delayed_entry(spark, d):
    late = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 4 == 0)
    lives = su.spans_from_start(read(spark, d, "orders"), "o_custkey", "o_orderdate", late, F.lit("1992-01-01").cast("timestamp_ntz"))
    return su.survival_curve(lives, entry="entry").select(r("days", 6).alias("days"), "at_risk", "events", r("survival", 8).alias("survival"))


@query("with s as (select o_orderpriority, o_orderkey, case when o_custkey % 5 > 0 then (1 + o_custkey % 40)::double else case when o_orderdate = timestamp '1999-01-01' then 0.5 else (epoch_us(timestamp '1999-01-01') - epoch_us(o_orderdate)) / 86400000000.0 end end as days, o_custkey % 5 > 0 as event from orders where o_custkey % 5 > 0 or o_orderdate <= timestamp '1999-01-01')"
    + CURVE.format(by="o_orderpriority,", part="partition by o_orderpriority") + """, o as (select o_orderkey, o_orderpriority, days from s where not event), g as (select o_orderpriority, count(*) as finished from s where event group by 1),
x as (select o.*, finished, coalesce((select min(c.survival) from c where c.o_orderpriority = o.o_orderpriority and c.days <= o.days), 1.0) as s_now, coalesce((select min(c.survival) from c where c.o_orderpriority = o.o_orderpriority and c.days <= o.days + 30), 1.0) as s_then, (select count(*) from s where s.event and s.o_orderpriority = o.o_orderpriority and s.days <= o.days) as done from o left join g on g.o_orderpriority = o.o_orderpriority)
select o_orderkey, round(days, 6) as days, round(done / finished, 6) as exceeded, round(case when s_now > 0 then 1 - s_then / s_now end, 6) as p from x""")
def open_cases(spark, d):
    end = F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderdate") + F.expr("make_dt_interval(cast(1 + o_custkey % 40 as int))"))
    cases = su.durations(read(spark, d, "orders").withColumn("done", end.cast("timestamp_ntz")), "o_orderdate", "done", "1999-01-01 00:00:00", ["o_orderpriority", "o_orderkey"])
    return su.open_cases(cases, "o_orderpriority", 30.0).select("o_orderkey", r("days", 6).alias("days"), r("exceeded", 6).alias("exceeded"), r("p", 6).alias("p"))


@query()
def useful_life(spark, d):
    return li.useful_life(_spans(spark, d), 5.0)[1]


@query(LIFE + " select count(*) as entities, round(sum(1 - s_then / s_now), 4) as expected, count(*) filter (1 - s_then / s_now >= 0.3) as risky, count(*) filter (1 - s_then / s_now >= 0.5) as high_risk, round(max(1 - s_then / s_now), 6) as p_most, case when count(*) filter (1 - s_then / s_now >= 0.5) > 0 then 'alert' when count(*) filter (1 - s_then / s_now >= 0.3) > 0 then 'watch' else 'info' end as urgency from x")
def failure_summary(spark, d):
    out = li.failure_summary(li.useful_life(_spans(spark, d), 5.0)[1])
    return out.select("entities", r("expected").alias("expected"), "risky", "high_risk", r("p_most", 6).alias("p_most"), "urgency")


@query()
def future_windows(spark, d):
    return li.future_windows(li.useful_life(_spans(spark, d), 5.0)[1], F.lit("2024-01-31").cast("date"))


@query()
def failure_model(spark, d):
    return li.failure_model(read(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 5, "event_id", ["value"])[0]


@query()
def classification_question(spark, d):
    return qu.ask("classification", _large_orders(spark, d), row="o_orderkey", target="large", columns=("o_orderdate", "lines", "quantity"))

"""Anomalies, statistics, alarms and memory over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import anomalies as an
from tidemark.operators import state as st
from tidemark.operators.indicators import Indicator, duplicate_count, missing_profile
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


@query("""with t as (select count(*) as n, count(*) filter (not (l_quantity < 45)) as a, count(*) filter (not (l_discount <= 0.09)) as b from lineitem)
select 'small orders' as rule, a as rows, round(a * 100.0 / n, 6) as percent, case when a > 0.02 * n then 'high' else 'medium' end as severity from t where a > 0
union all select 'low discount', b, round(b * 100.0 / n, 6), case when b > 0.02 * n then 'high' else 'medium' end from t where b > 0""")
def anom_rules(spark, d):
    out = an.rule_breaks(read(spark, d, "lineitem"), {"small orders": F.col("l_quantity") < 45, "low discount": F.col("l_discount") <= 0.09, "positive": F.col("l_quantity") > 0})
    return out.withColumn("percent", r("percent", 6))


@query("""with t as (select count(*) as n, count(*) filter (l_shipdate < o_orderdate) as k from lineitem join orders on l_orderkey = o_orderkey)
select 'o_orderdate > l_shipdate' as rule, k as rows, round(k * 100.0 / n, 6) as percent, case when k > 0.02 * n then 'high' else 'medium' end as severity from t where k > 0""")
def anom_temporal_order(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return an.date_order_breaks(both, [("o_orderdate", "l_shipdate")]).withColumn("percent", r("percent", 6))


ODD_VALUE = "case when event_id % 97 = 0 then value * 40 else value end"
SEVERITY = "case when abs(z) >= 9 then 'extreme' when abs(z) >= 6 then 'high' when abs(z) >= 3.9000000000000004 then 'medium' else 'low' end"


def _odd(spark, d):
    return read(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 97 == 0, F.col("value") * 40).otherwise(F.col("value")).alias("v"))


@query(f"""with e as (select event_id, {ODD_VALUE} as v from events), m as (select median(v) as m from e), s as (select m, median(abs(v - m)) as mad from e, m group by m),
z as (select event_id, 0.6745 * (v - m) / mad as z from e, s) select event_id, round(z, 6) as z, {SEVERITY} as severity from z where abs(z) > 3""")
def anom_robust_global(spark, d):
    return an.robust_outliers(_odd(spark, d), "v").select("event_id", r("z", 6).alias("z"), "severity")


@query(f"""with e as (select event_id, event_type, {ODD_VALUE} as v from events), m as (select event_type, median(v) as m, count(*) as n from e group by 1),
s as (select event_type, m, n, median(abs(v - m)) as mad from e join m using (event_type) group by 1, 2, 3), z as (select event_id, 0.6745 * (v - m) / mad as z from e join s using (event_type) where n >= 5 and mad > 0)
select event_id, round(z, 6) as z, {SEVERITY} as severity from z where abs(z) > 3""")
def anom_segmented(spark, d):
    return an.segmented_outliers(_odd(spark, d), "v", "event_type").select("event_id", r("z", 6).alias("z"), "severity")


@query(f"""with e as (select event_type, {ODD_VALUE} as v from events), n as (select count(*)::double as n from e),
wm as (select median(v) as m from e), w as (select median(abs(v - m)) / abs(m) as whole from e, wm group by m),
m as (select event_type, median(v) as m, count(*) as c from e group by 1), s as (select event_type, m, c, median(abs(v - m)) as mad from e join m using (event_type) group by 1, 2, 3)
select 'event_type' as segment, round(sum(c) / any_value(n.n), 6) as coverage, round(1 - (sum(c * mad / abs(m)) / sum(c)) / any_value(whole), 6) as reduction from s, n, w""")
def segment_spread(spark, d):
    return an.segment_spread(_odd(spark, d), "v", ["event_type", "event_id"]).select("segment", r("coverage", 6).alias("coverage"), r("reduction", 6).alias("reduction"))


@query("""select 'a' as column, count(*) filter (l_partkey % 17 = 0) as missing, round(count(*) filter (l_partkey % 17 = 0) * 100.0 / count(*), 6) as percent, case when count(*) filter (l_partkey % 17 = 0) > 0.15 * count(*) then 'high' else 'medium' end as severity from lineitem
union all select 'b', count(*) filter (l_partkey % 4 = 0), round(count(*) filter (l_partkey % 4 = 0) * 100.0 / count(*), 6), case when count(*) filter (l_partkey % 4 = 0) > 0.15 * count(*) then 'high' else 'medium' end from lineitem""")
def anom_nulls(spark, d):
    k = F.col("l_partkey")
    rows = read(spark, d, "lineitem").select(F.when(k % 17 != 0, k).alias("a"), F.when(k % 4 != 0, k).alias("b"), k.alias("c"))
    return an.missing_anomalies(rows, ["a", "b", "c"]).withColumn("percent", r("percent", 6))


@query("""select 'x' as column, count(*) filter (o_custkey % 3 = 0) as missing, round(count(*) filter (o_custkey % 3 = 0) * 100.0 / count(*), 6) as percent from orders""")
def missing_cells(spark, d):
    rows = read(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 != 0, 1).alias("x"))
    return missing_profile(rows, ["x"]).withColumn("percent", r("percent", 6))


@query("""with g as (select count(*) - 1 as k from lineitem group by l_orderkey, l_linenumber), t as (select sum(k)::bigint as duplicates, (select count(*) from lineitem) as n from g)
select duplicates, round(duplicates * 100.0 / n, 6) as percent, case when duplicates > 0.02 * n then 'high' else 'medium' end as severity from t where duplicates > 0""")
def anom_duplicates(spark, d):
    return an.duplicate_anomaly(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")).withColumn("percent", r("percent", 6))


@query("select sum(k)::bigint as duplicates from (select count(*) - 1 as k from lineitem group by l_partkey, l_suppkey)")
def exact_duplicates(spark, d):
    return duplicate_count(read(spark, d, "lineitem").select("l_partkey", "l_suppkey"))


@query("""with x as (select avg(l_quantity) as x from lineitem), s as (select 10.0::double as mean, 4.0::double as var, 6 as n)
select 'l_quantity' as column, round(0.3 * x + 0.7 * mean, 6) as mean, round(0.3 * (x - mean) * (x - mean) + 0.7 * var, 6) as var, (n + 1)::bigint as n from x, s""")
def baseline_update(spark, d):
    state = spark.createDataFrame([("l_quantity", 10.0, 4.0, 6)], "column string, mean double, var double, n long")
    out = an.update_baseline(state, read(spark, d, "lineitem"), ["l_quantity"])
    return out.select("column", r("mean", 6).alias("mean"), r("var", 6).alias("var"), "n")


@query("""select 'l_quantity' as column, round(avg(l_quantity), 6) as x, 10.0::double as mean from lineitem having abs(avg(l_quantity) - 10) > 6""")
def anom_baseline_drift(spark, d):
    state = spark.createDataFrame([("l_quantity", 10.0, 4.0, 6), ("l_tax", 0.04, 4.0, 6)], "column string, mean double, var double, n long")
    return an.baseline_drift(state, read(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select("column", r("x", 6).alias("x"), "mean")


@query()
def anom_multivariate(spark, d):
    return an.multivariate_outliers(read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")), "o_orderkey", ["c_acctbal", "o_totalprice"])


@query("""with e as (select event_id, value as a, user_id::double as b from events), ra as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as y from e)
select 'value' as a, 'user_id' as b, count(*) as n, round(corr(x, y), 8) as r from ra""")
def spearman_pairs(spark, d):
    return an.spearman_pairs(read(spark, d, "events"), "event_id", ["value", "user_id"]).select("a", "b", "n", r("r", 8).alias("r"))


@query("""with m as (select 'price' as c, l_orderkey * 1000 + l_suppkey as k from lineitem where l_extendedprice > 50000 group by 2 union all select 'quantity', l_orderkey * 1000 + l_suppkey from lineitem where l_quantity >= 49 group by 2
union all select 'tax', l_orderkey * 1000 + l_suppkey from lineitem where l_tax >= 0.08 group by 2), n as (select c, count(*) as n from m group by 1)
select x.c as a, y.c as b, p.n as n_a, q.n as n_b, count(*) as both, round(count(*) * t.n / (p.n * q.n), 6) as lift from (select count(*)::double as n from lineitem) t, m x join m y on x.k = y.k and x.c < y.c join n p on p.c = x.c join n q on q.c = y.c group by 1, 2, 3, 4, t.n""")
def cooccurrence_counts(spark, d):
    rows = read(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 1000 + F.col("l_suppkey"))
    marks = None
    for name, test in (("price", "l_extendedprice > 50000"), ("quantity", "l_quantity >= 49"), ("tax", "l_tax >= 0.08")):
        one = rows.where(test).select(F.lit(name).alias("column"), "row")
        marks = one if marks is None else marks.unionByName(one)
    return an.cooccurrence(marks, rows.count()).withColumn("lift", r("lift", 6))


@query("""with e as (select epoch_us(ts) as t, event_id, case when event_id % 2 = 0 then value + 30 * (epoch_us(ts) > (select (min(epoch_us(ts)) + max(epoch_us(ts))) / 2 from events))::int else value end as x from events),
k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rk, row_number() over (order by t, event_id) as i, count(*) over () as n from e),
u as (select i, x, n, 2 * sum(rk) over (order by i) - i * (n + 1) as u from k), b as (select i as k, u, n from u order by abs(u) desc, i limit 1)
select n, k, round(u, 4) as u, round(least(1.0, 2 * exp(-6 * u * u / (n::double * n * n + n::double * n))), 8) as p, round((select median(x) from u where i <= b.k), 6) as before, round((select median(x) from u where i > b.k), 6) as after from b where n >= 20 and k >= 0.1 * n and n - k >= 0.1 * n""")
def pettitt_shift(spark, d):
    rows = read(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value")
    mid = rows.agg(((F.min("t") + F.max("t")) / 2).alias("mid"))
    x = F.when(F.col("event_id") % 2 == 0, F.col("value") + 30 * (F.col("t") > F.col("mid")).cast("int")).otherwise(F.col("value"))
    out = an.regime_shift(rows.join(F.broadcast(mid)).withColumn("x", x), "t", "x", "event_id")
    return out.select("n", F.col("k").cast("long").alias("k"), r("u", 4).alias("u"), r("p", 8).alias("p"), r("before", 6).alias("before"), r("after", 6).alias("after"))


@query("""select l_orderkey * 1000 + l_suppkey as row, l_extendedprice as value from lineitem where l_extendedprice > 20000 order by l_extendedprice desc, 1 limit 5""")
def alarm_rows(spark, d):
    rows = read(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 1000 + F.col("l_suppkey"))
    return st.alarm_rows(rows, "l_extendedprice", ">", 20_000, "id")


@query("""select 'busy' as name, max(n)::double as value, max(n) > 10 as fires from (select user_id, count(*) as n from events group by 1)
union all select 'mean', round(avg(value), 6), avg(value) < 0 from events union all select 'rows', count(*) filter (value >= 50)::double, count(*) filter (value >= 50) > 0 from events
union all select 'errors', count(*)::double, count(*) >= 1 from events where event_type = 'error'""")
def alarm_frequency(spark, d):
    from tidemark.operators.filters import Condition

    alarms = [st.Alarm("busy", "frequency", ">", 10, "user_id"), st.Alarm("mean", "mean", "<", 0, "value"), st.Alarm("rows", "rows", ">=", 50, "value"), st.Alarm("errors", "indicator", ">=", 1, indicator=Indicator("n", "count", "event_id"), conditions=(Condition("event_type", "in", ("error",)),))]
    return st.alarm_values(read(spark, d, "events"), alarms).withColumn("value", r("value", 6))


@query("""with h as (select event_type as identity, ts::date as day, count(*) as rows, bool_or(extract(day from ts) = 10 and event_type < 'd') as resolved from events group by 1, 2),
s as (select identity, max(day) filter (resolved) as solved from h group by 1)
select identity, count(*) as times, count(*) filter (solved is null or day > solved) as streak, sum(rows)::bigint as impact, bool_or(solved is not null and day > solved) as reappeared from h join s using (identity) group by 1""")
def memory_streaks(spark, d):
    e = read(spark, d, "events")
    history = e.groupBy(F.col("event_type").alias("identity"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.max((F.day("ts") == 10) & (F.col("event_type") < "d")).alias("resolved"))
    return st.streaks(history)


@query("select event_type as identity, count(*) as rows from events where event_type <> 'error' group by 1")
def false_positives_dropped(spark, d):
    found = read(spark, d, "events").groupBy(F.col("event_type").alias("identity")).agg(F.count(F.lit(1)).alias("rows"))
    return st.without_false_positives(found, spark.createDataFrame([("error",)], "identity string"))


@query()
def content_signature(spark, d):
    return st.content_signature(read(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("select o_orderkey, o_totalprice, case when o_orderkey % 2 = 0 then o_totalprice * 2 end as \"Prediction\" from orders")
def publish_predictions(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("p"))
    return st.publish(o, p, "o_orderkey", {"p": "Prediction"})

"""Columns made, converted and picked, alarms and marks over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import minutes_since_midnight
from tidemark.functions.formula import calculated_column
from tidemark.operators import cleaning as cl
from tidemark.operators import filters as flt
from tidemark.operators import learning as ml
from tidemark.operators import questions as qu
from tidemark.operators import state as st
from tidemark.plans.summaries import r, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _with(df, formulas: dict[str, str]):
    for name, formula in formulas.items():
        df = calculated_column(df, name, formula)
    return df


def _sums(df, *columns: str):
    """Sums by flag, to four places, and how many cells are known."""
    made = [F.round(F.sum(c), 4).alias(c) for c in columns] + [F.count(c).alias(f"{c}_n") for c in columns]
    return df.groupBy("l_returnflag").agg(*made)


@query("""select l_returnflag, round(sum(-l_discount + (+l_tax)), 4) as net, round(sum(case when not l_quantity > 25 then 1 else 0 end), 4)::double as small, count(*) as net_n, count(*) as small_n from lineitem group by 1""")
def formula_unary(spark, d):
    made = _with(read(spark, d, "lineitem"), {"net": "-[l_discount] + (+[l_tax])", "small": "SI(not ([l_quantity] > 25), 1.0, 0.0)"})
    return _sums(made, "net", "small")


@query("""select l_returnflag, round(sum(l_quantity + l_tax + l_discount), 4) as total, round(sum((l_quantity + l_tax) / 2), 4) as mean, round(sum(round(l_extendedprice / 9.7::double, 1)), 4) as near, round(sum(abs(l_discount - 0.05::double)), 4) as off,
count(*) as total_n, count(*) as mean_n, count(*) as near_n, count(*) as off_n from lineitem group by 1""")
def formula_row_functions(spark, d):
    made = {"total": "SUMA([l_quantity], [l_tax], [l_discount])", "mean": "PROMEDIO([l_quantity], [l_tax])", "near": "REDONDEAR([l_extendedprice] / 9.7, 1)", "off": "ABS([l_discount] - 0.05)"}
    return _sums(_with(read(spark, d, "lineitem"), made), *made)


@query("""with t as (select *, case when l_orderkey % 7 > 0 then l_quantity end as x from lineitem)
select l_returnflag, sum(case when x is null then 1.0 else 0.0 end)::double as missing, sum(least(greatest(coalesce(x, 0), 10), 40)) as held, (sum(x::int) * 2)::double as twice, round(sum(abs(round(-l_extendedprice / 9.7::double, 1))), 4) as near, sum(case when x is not null then x else 0 end) as known,
count(*) as missing_n, count(*) as held_n, count(x) as twice_n, count(*) as near_n, count(*) as known_n from t group by 1""")
def formula_methods(spark, d):
    rows = read(spark, d, "lineitem").withColumn("x", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_quantity")))
    made = {"missing": "SI([x].isna(), 1.0, 0.0)", "held": "[x].fillna(0.0).clip(10, 40)", "twice": "[x].astype('int') * 2", "near": "(-[l_extendedprice] / 9.7).round(1).abs()", "known": "SI([x].notna(), [x], 0.0)"}
    out = _sums(_with(rows, made), *made)
    return out.withColumn("twice", F.col("twice").cast("double"))


@query("select event_type, round(sum(hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0), 3) as minutes, count(*) as n from events group by 1")
def minutes_of_day(spark, d):
    at = read(spark, d, "events").withColumn("m", minutes_since_midnight(F.col("ts")))
    return at.groupBy("event_type").agg(F.round(F.sum("m"), 3).alias("minutes"), F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice from orders where o_custkey = 7")
def filter_entity(spark, d):
    return flt.pick_entity(read(spark, d, "orders"), "o_custkey", " 7.0 ").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (0, 4, 8, 99, 700)")
def filter_rows_picked(spark, d):
    """Rows chosen by their numbers in a grid, which count from 1."""
    return flt.pick_rows(read(spark, d, "orders"), "o_orderkey", (1, 5, 9, 100, 701)).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 250000")
def filter_anomaly_kind(spark, d):
    o = read(spark, d, "orders")
    dear = o.where("o_totalprice > 250000").select(F.lit("dear").alias("kind"), "o_orderkey")
    other = o.where("o_orderkey % 500 = 0").select(F.lit("other").alias("kind"), "o_orderkey")
    return flt.anomalous_rows(o, dear.unionByName(other), "o_orderkey", "dear").select("o_orderkey", "o_totalprice")


@query("select p_partkey, translate(p_brand, '#1', '') as p_brand from part")
def characters_removed(spark, d):
    return cl.remove_characters(read(spark, d, "part"), "p_brand", "#1").select("p_partkey", "p_brand")


@query("select l_returnflag, sum(l_quantity) as amount, count(*) as amount_n, count(*) filter (l_orderkey % 50 > 0) as converted from lineitem group by 1")
def numbers_converted(spark, d):
    """Amounts with a unit become numbers as a whole; where some cells tell no number, only those that do are rewritten."""
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" kg"))
    rows = read(spark, d, "lineitem").select("l_returnflag", text.alias("amount"), F.when(F.col("l_orderkey") % 50 > 0, text).otherwise("unsaid").alias("mixed"))
    both = cl.convert_numbers(cl.convert_numbers(rows, "amount"), "mixed")
    return both.groupBy("l_returnflag").agg(F.sum("amount").alias("amount"), F.count("amount").alias("amount_n"), F.count(F.col("mixed").try_cast("double")).alias("converted"))


NOW = "select count(*) filter (o_totalprice > 100) as big, count(*) filter (o_totalprice >= 400000) as dear, avg(o_totalprice) as mean, (select max(n) from (select count(*) as n from orders{where} group by o_orderpriority)) as often from orders{where}"


@query(f"""with n as ({NOW.format(where="")}), b as ({NOW.format(where=" where o_orderdate < timestamp '1996-01-01' and o_totalprice < 400000")}),
t as (select 'big' as name, n.big::double as value, n.big > 0 as now, b.big > 0 as was from n, b union all select 'dear', n.dear, n.dear > 0, b.dear > 0 from n, b union all select 'mean', n.mean, n.mean > 1e12, b.mean > 1e12 from n, b union all select 'often', n.often, n.often > 200, b.often > 200 from n, b)
select name, round(value, 4) as value, now as fires from t where now and not coalesce(was, false)""")
def alarms_newly_firing(spark, d):
    """Alarms over all orders that didn't fire over the lesser ones of earlier years."""
    o = read(spark, d, "orders")
    alarms = [st.Alarm("big", "rows", ">", 100, "o_totalprice"), st.Alarm("dear", "rows", ">=", 400_000, "o_totalprice"), st.Alarm("mean", "mean", ">", 1e12, "o_totalprice"), st.Alarm("often", "frequency", ">", 200, "o_orderpriority")]
    return st.newly_firing(st.alarm_values(o, alarms), st.alarm_values(o.where("o_orderdate < timestamp_ntz '1996-01-01' and o_totalprice < 400000"), alarms)).withColumn("value", r("value", 4))


@query("select o_orderkey as row, o_totalprice as actual, 150000.0::double as predicted, abs(o_totalprice - 150000) as error from orders order by error desc, row limit 50")
def errors_to_review(spark, d):
    said = read(spark, d, "orders").withColumn("said", F.lit(150_000.0))
    return ml.review_list(said, "o_orderkey", "o_totalprice", "said")


@query("""with o as (select o_orderkey as row, o_orderstatus = 'F' as actual, o_totalprice > 250000 as said, abs(o_totalprice - 250000) / 250000 as confidence from orders)
select row, actual, said, round(confidence, 8) as confidence from o where actual <> said order by o.confidence desc, row limit 50""")
def mistakes_to_review(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("finished"), (F.col("o_totalprice") > 250_000).alias("said"), (F.abs(F.col("o_totalprice") - 250_000) / 250_000).alias("sure"))
    return ml.confident_mistakes(o, "o_orderkey", "finished", "said", "sure").withColumn("confidence", r("confidence", 8))


HISTORY = "h as (select event_type as identity, ts::date as day, count(*) as rows from events group by 1, 2)"


@query(f"with {HISTORY} select identity, strftime(day, '%Y-%m-%d') as day, rows, identity = 'error' and day = (select max(day) from h where identity = 'error') as resolved from h")
def marked_resolved(spark, d):
    history = read(spark, d, "events").groupBy(F.col("event_type").alias("identity"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows")).withColumn("resolved", F.lit(False))
    return st.mark(history, "error").select("identity", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", "resolved")


@query("""with n as (select count(*) as n, least(5000, greatest(count(*) // 3, 2)) as most from events), m as (select count(*) as n, least(5000, greatest(count(*) // 3, 2)) as most from orders),
c as (select 'events' as t, 0 as grade, 'event_id' as c, count(distinct event_id) as d from events union all select 'events', 0, 'user_id', count(distinct user_id) from events union all select 'events', 1, 'event_type', count(distinct event_type) from events union all select 'events', 1, 'props', count(distinct props) from events
union all select 'orders', 0, 'o_orderkey', count(distinct o_orderkey) from orders union all select 'orders', 0, 'o_custkey', count(distinct o_custkey) from orders union all select 'orders', 1, 'o_orderstatus', count(distinct o_orderstatus) from orders union all select 'orders', 1, 'o_orderpriority', count(distinct o_orderpriority) from orders),
e as (select t, arg_min(c, (grade, c)) as c from c where d between 2 and (case t when 'events' then (select most from n) else (select most from m) end) group by t)
select t as "table", 'entity' as setting, c as "column" from e union all select 'events', 'date', 'ts' union all select 'events', 'value', 'value' union all select 'orders', 'date', 'o_orderdate' union all select 'orders', 'value', 'o_totalprice'
union all select 'events', 'event', 'event_type' where not exists (select 1 from e where t = 'events' and c = 'event_type')""")
def suggested_settings(spark, d):
    """Which columns a question over a table would begin with."""
    told = [(t, s, c) for t in ("events", "orders") for s, c in qu.suggested_settings(read(spark, d, t)).items()]
    return spark.createDataFrame(told, "table string, setting string, column string")

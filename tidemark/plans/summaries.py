"""Filters, formulas, indicators, frequencies and charts over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.formula import calculated_column
from tidemark.operators import filters as flt
from tidemark.operators import indicators as ind
from tidemark.operators.filters import Condition
from tidemark.operators.indicators import Chart, Indicator


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n=4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("""select 'total' as name, round(sum(l_extendedprice), 2) as value from lineitem
union all select 'mean', round(avg(l_quantity), 2) from lineitem union all select 'median', round(median(l_extendedprice), 2) from lineitem
union all select 'least', round(min(l_discount), 2) from lineitem union all select 'most', round(max(l_tax), 2) from lineitem
union all select 'rows', count(l_orderkey)::double from lineitem union all select 'parts', count(distinct l_partkey)::double from lineitem""")
def kpi_basic(spark, d):
    k = [Indicator("total", "sum", "l_extendedprice"), Indicator("mean", "mean", "l_quantity"), Indicator("median", "median", "l_extendedprice"), Indicator("least", "min", "l_discount"), Indicator("most", "max", "l_tax"), Indicator("rows", "count", "l_orderkey"), Indicator("parts", "distinct", "l_partkey")]
    return ind.compute(read(spark, d, "lineitem"), k).select("name", r("value", 2).alias("value"))


@query("""select 'discount rate' as name, round(sum(l_discount) / sum(l_quantity), 8) as value from lineitem
union all select 'tax per row', round(sum(l_tax) / count(l_tax), 8) from lineitem""")
def kpi_ratio(spark, d):
    k = [Indicator("discount rate", "ratio", "l_discount", "l_quantity"), Indicator("tax per row", "formula", formula="[l_tax].sum() / [l_tax].count()")]
    return ind.compute(read(spark, d, "lineitem"), k).select("name", r("value", 8).alias("value"))


@query("""with f as (select * from orders where o_orderstatus in ('F', 'O') and o_totalprice > 1000), m as (select max(o_orderdate) as last from f)
select 'recent' as name, round(sum(o_totalprice), 2) as value from f, m where o_orderdate > last - interval 90 day""")
def kpi_filtered_trailing_window(spark, d):
    k = Indicator("recent", "sum", "o_totalprice", conditions=(Condition("o_orderstatus", "in", ("F", "O")), Condition("o_totalprice", ">", (1000,))), date="o_orderdate", days=90)
    return ind.compute(read(spark, d, "orders"), [k]).select("name", r("value", 2).alias("value"))


@query("""with s as (select epoch_us(o_orderdate) as t, o_totalprice as v from orders), m as (select (min(t) + max(t)) / 2 as mid from s),
h as (select sum(v) filter (t <= mid) as a, sum(v) filter (t > mid) as b from s, m)
select round(a, 2) as first, round(b, 2) as second, round((b - a) / abs(a) * 100, 6) as change from h""")
def kpi_variation_halves(spark, d):
    return ind.halves_change(read(spark, d, "orders"), "o_totalprice", "o_orderdate").select(r("first", 2).alias("first"), r("second", 2).alias("second"), r("change", 6).alias("change"))


@query("""with s as (select epoch_us(o_orderdate) as t, o_totalprice as v from orders), m as (select min(t) as lo, max(t) as hi from s)
select least(floor((t - lo) / (hi - lo) * 12), 11)::int as slice, round(sum(v), 2) as value from s, m group by 1""")
def kpi_sparkline_12(spark, d):
    return ind.sparkline(read(spark, d, "orders"), "o_totalprice", "o_orderdate").select("slice", r("value", 2).alias("value"))


@query("""with c as (select l_quantity as v, count(*) as n from lineitem group by 1), m as (select v from c order by n desc, v limit 1)
select round(avg(l_quantity), 6) as mean, median(l_quantity) as median, (select v from m) as mode, round(stddev_samp(l_quantity), 6) as std, count(l_quantity) as n from lineitem""")
def metrics_describe(spark, d):
    return ind.describe(read(spark, d, "lineitem"), "l_quantity").select(r("mean", 6).alias("mean"), "median", "mode", r("std", 6).alias("std"), "n")


@query("""with q as (select c_mktsegment, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.5) as median, quantile_cont(c_acctbal, 0.75) as q3 from customer group by 1),
f as (select *, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence from q)
select c_mktsegment, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, min(c_acctbal) filter (c_acctbal between low_fence and high_fence) as low_whisker,
max(c_acctbal) filter (c_acctbal between low_fence and high_fence) as high_whisker, count(*) filter (c_acctbal not between low_fence and high_fence) as outliers
from customer join f using (c_mktsegment) group by c_mktsegment, q1, median, q3""")
def boxplot_tukey(spark, d):
    out = ind.box_plot(read(spark, d, "customer"), "c_acctbal", ["c_mktsegment"])
    return out.select("c_mktsegment", r("q1").alias("q1"), r("median").alias("median"), r("q3").alias("q3"), "low_whisker", "high_whisker", "outliers")


@query("""with t as (select case when c_custkey % 17 = 0 then null else c_mktsegment end as v from customer), c as (select coalesce(v, '(vacíos)') as value, count(*) as n from t group by 1)
select 'seg' as column, value, n, round(n * 100.0 / sum(n) over (), 6) as percent, row_number() over (order by n desc, value)::int as place from c""")
def freq_single(spark, d):
    seg = F.when(F.col("c_custkey") % 17 == 0, None).otherwise(F.col("c_mktsegment"))
    return ind.frequencies(read(spark, d, "customer").select(seg.alias("seg")), ["seg"]).select("column", "value", "n", r("percent", 6).alias("percent"), "place")


@query("""with u as (select 'o_orderpriority' as c, o_orderpriority as v from orders union all select 'o_orderstatus', o_orderstatus from orders),
g as (select c, v, count(*) as n from u group by 1, 2)
select c as column, v as value, n, round(n * 100.0 / sum(n) over (partition by c), 6) as percent, row_number() over (partition by c order by n desc, v)::int as place from g""")
def freq_multi_unpivot(spark, d):
    return ind.frequencies(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select("column", "value", "n", r("percent", 6).alias("percent"), "place")


@query("""with g as (select l_partkey::varchar as value, count(*) as n from lineitem group by 1), p as (select *, row_number() over (order by n desc, value)::int as place from g)
select value, n, place from p where place <= 10""")
def freq_top10(spark, d):
    return ind.frequencies(read(spark, d, "lineitem"), ["l_partkey"], 10).select("value", "n", "place")


@query("select count(distinct v) as distinct_values from (select o_orderstatus as v from orders union all select o_orderpriority from orders)")
def distinct_union(spark, d):
    return ind.fields_in_text(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select coalesce(l_returnflag, '(sin dato)') as category, round(sum(l_extendedprice), 2) as value from lineitem group by 1")
def chart_by_category(spark, d):
    return ind.by_category(read(spark, d, "lineitem"), "l_returnflag", "sum", "l_extendedprice").select("category", r("value", 2).alias("value"))


@query("""with g as (select p_brand as category, sum(p_retailprice) as value from part group by 1), p as (select *, row_number() over (order by value desc, category) as k from g)
select case when k <= 5 then category else 'Otros' end as category, least(k, 6)::int as place, round(sum(value), 2) as value, count(*) as n_categories from p group by 1, 2""")
def chart_top_n_others(spark, d):
    return ind.top_with_others(ind.by_category(read(spark, d, "part"), "p_brand", "sum", "p_retailprice"), 5).select("category", F.col("place").cast("int").alias("place"), r("value", 2).alias("value"), "n_categories")


@query("""with g as (select date_trunc('day', ts)::date as p, count(*) as n from events where event_type = 'error' and extract(hour from ts) = 3 group by 1),
c as (select unnest(generate_series((select min(p) from g)::timestamp, (select max(p) from g)::timestamp, interval 1 day))::date as p)
select strftime(c.p, '%Y-%m-%d') as period, coalesce(n, 0)::double as value from c left join g on c.p = g.p""")
def chart_period_daily_gapfill(spark, d):
    rows = read(spark, d, "events").where("event_type = 'error' and hour(ts) = 3")
    return ind.by_period(rows, "ts", "day").select(F.date_format("period", "yyyy-MM-dd").alias("period"), "value")


@query("""select strftime(o_orderdate::date + ((7 - isodow(o_orderdate))::int), '%Y-%m-%d') as period, round(sum(o_totalprice), 2) as value from orders group by 1""")
def chart_period_weekly(spark, d):
    out = ind.by_period(read(spark, d, "orders"), "o_orderdate", "week", "sum", "o_totalprice").where("value <> 0")
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), r("value", 2).alias("value"))


@query("""with m as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem), b as (select unnest(range(20))::int as bin),
c as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from lineitem, m group by 1)
select b.bin, round(lo + b.bin * ((hi - lo) / 20), 4) as low, round(lo + (b.bin + 1) * ((hi - lo) / 20), 4) as high, coalesce(n, 0) as n from b cross join m left join c on b.bin = c.bin""")
def hist_equal_width_20(spark, d):
    return ind.histogram(read(spark, d, "lineitem"), "l_extendedprice").select("bin", r("low").alias("low"), r("high").alias("high"), "n")


@query("""with m as (select min(l_quantity) as a, max(l_quantity) as b, min(l_extendedprice) as c, max(l_extendedprice) as e from lineitem)
select least(floor((l_quantity - a) / (b - a) * 120), 119)::int as bin_x, least(floor((l_extendedprice - c) / (e - c) * 120), 119)::int as bin_y, count(*) as n from lineitem, m group by 1, 2""")
def density_2d(spark, d):
    return ind.density(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("""with m as (select date_trunc('day', min(ts)) as o from events) select floor((epoch_us(ts) - epoch_us(o)) / 86400000000)::int as bin, count(*) as n from events, m group by 1""")
def timeline_hist(spark, d):
    return ind.time_histogram(read(spark, d, "events"), "ts", 86_400)


@query("""select a, b, round(r, 8) as r from (
select 'l_quantity' as a, 'l_extendedprice' as b, corr(l_quantity, l_extendedprice) as r from lineitem union all
select 'l_quantity', 'l_discount', corr(l_quantity, l_discount) from lineitem union all
select 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) from lineitem)""")
def corr_matrix(spark, d):
    return ind.correlation_matrix(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r("r", 8).alias("r"))


@query("""select count(*) as n, round(avg(x), 6) as mean_days, round(min(x), 6) as min_days, round(max(x), 6) as max_days, count(*) filter (x < 0) as negative
from (select (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 as x from lineitem join orders on l_orderkey = o_orderkey)""")
def duration_summary(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = ind.duration_summary(both, "o_orderdate", "l_shipdate")
    return out.select("n", r("mean_days", 6).alias("mean_days"), r("min_days", 6).alias("min_days"), r("max_days", 6).alias("max_days"), "negative")


@query("""with g as (select event_type as k, sum(value) as v from events group by 1), p as (select *, row_number() over (order by v desc, k) as i from g)
select 'donut' as mode, k as label, round(v, 4) as value from p""")
def chart_donut_spec(spark, d):
    return ind.chart_data(read(spark, d, "events"), Chart("donut", "event_type", "value", "sum")).select("mode", "label", r("value").alias("value"))


@query("""with g as (select date_trunc('day', ts) as p, count(*)::double as v from events group by 1)
select strftime((select p from g order by v desc, p limit 1), '%Y-%m-%d') as period, max(v) as value, count(*) >= 5 and median(v) > 0 and max(v) > 1.6 * median(v) as is_peak from g""")
def chart_peak(spark, d):
    out = ind.peak(ind.by_period(read(spark, d, "events"), "ts", "day"))
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "value", "is_peak")


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def filter_text_in(spark, d):
    return flt.apply_conditions(read(spark, d, "orders"), [Condition("o_orderpriority", "in", ("1-URGENT", "5-LOW"))]).select("o_orderkey")


@query("select o_orderkey from (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderstatus end as s from orders) where s is null or s not in ('F')")
def filter_not_in_keeps_nulls(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderstatus")).alias("s"))
    return flt.apply_conditions(rows, [Condition("s", "not_in", ("F",))]).select("o_orderkey")


@query("select c_custkey from (select c_custkey, case when c_custkey % 5 = 0 then 'x' || c_acctbal else c_acctbal::varchar end as t from customer) where try_cast(t as double) >= 500")
def filter_numeric_coerce(spark, d):
    t = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), F.col("c_acctbal").cast("string"))).otherwise(F.col("c_acctbal").cast("string"))
    return flt.apply_conditions(read(spark, d, "customer").select("c_custkey", t.alias("t")), [Condition("t", ">=", (500,))]).select("c_custkey")


@query("select c_custkey from (select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '  ' else c_name end as t from customer) where t is null or trim(t) = ''")
def filter_blank(spark, d):
    t = F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 3 == 1, "  ").otherwise(F.col("c_name"))
    return flt.apply_conditions(read(spark, d, "customer").select("c_custkey", t.alias("t")), [Condition("t", "blank")]).select("c_custkey")


@query("select event_id from events where ts between (select min(ts) + interval 5 day from events) and (select min(ts) + interval 9 day from events)")
def filter_time_range(spark, d):
    rows = read(spark, d, "events")
    first = rows.agg(F.min("ts").alias("t")).first()["t"]
    from datetime import timedelta

    return flt.time_range(rows, "ts", str(first + timedelta(days=5)), str(first + timedelta(days=9))).select("event_id")


@query("select o_orderkey from orders where o_orderdate < date '1996-01-01'")
def filter_cut_off(spark, d):
    return flt.cut_off(read(spark, d, "orders"), "o_orderdate", "1995-12-31").select("o_orderkey")


@query("select c_custkey from (select c_custkey, case when c_custkey % 9 = 0 then null else c_mktsegment end as s from customer) where s in ('BUILDING') or s is null")
def filter_picker(spark, d):
    s = F.when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_mktsegment"))
    return flt.pick_values(read(spark, d, "customer").select("c_custkey", s.alias("s")), "s", ["BUILDING", flt.EMPTY_LABEL]).select("c_custkey")


@query("select event_id from events where lower(event_type) = 'error'")
def filter_event_mask(spark, d):
    rows = read(spark, d, "events")
    return rows.where(flt.event_mask(rows, "event_type", "error")).select("event_id")


def _formula(spark, d, formula, keep=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), order=None, n=6):
    x = F.col("x").cast("double")
    return calculated_column(read(spark, d, "lineitem"), "x", formula, order).select(*keep, (F.round(x, n) if n else x).alias("x"))


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"select {KEYS}, l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity as x from lineitem")
def formula_arith(spark, d):
    return _formula(spark, d, "[l_extendedprice] × (1 - [l_discount]) * (1 + [l_tax]) ÷ [l_quantity]", n=None)


@query(f"select {KEYS}, round(case when l_quantity > 25 and l_discount < 0.05 then least(l_quantity, l_tax * 100) else greatest(l_quantity, l_linenumber) end, 6) as x from lineitem")
def formula_if_minmax(spark, d):
    return _formula(spark, d, "SI([l_quantity] > 25 and [l_discount] < 0.05, MINIMO([l_quantity], [l_tax] * 100), MAXIMO([l_quantity], [l_linenumber]))")


@query(f"select {KEYS}, round(l_extendedprice / (select sum(l_extendedprice) from lineitem) * 1000 + (select median(l_quantity) from lineitem) - (select avg(l_tax) from lineitem), 6) as x from lineitem")
def formula_broadcast_agg(spark, d):
    return _formula(spark, d, "[l_extendedprice] / [l_extendedprice].sum() * 1000 + [l_quantity].median() - [l_tax].mean()")


CUMULATIVE = "select o_orderkey, round(sum(o_totalprice) over (order by o_orderkey), 2) as total, round(o_totalprice - lag(o_totalprice) over (order by o_orderkey), 2) as step from orders"


@query(CUMULATIVE)
def formula_cumulative(spark, d):
    rows = calculated_column(calculated_column(read(spark, d, "orders"), "total", "[o_totalprice].cumsum()", ["o_orderkey"]), "step", "[o_totalprice].diff()", ["o_orderkey"])
    return rows.select("o_orderkey", r("total", 2).alias("total"), r("step", 2).alias("step"))


@query(CUMULATIVE)
def formula_cumulative_whole(spark, d):
    """The same query under its earlier name."""
    return formula_cumulative(spark, d)


@query(f"""select {KEYS}, floor(l_extendedprice / 7) + ((l_quantity - 25) - 4 * floor((l_quantity - 25) / 4)) as x from lineitem""")
def formula_floor_mod_round(spark, d):
    return _formula(spark, d, "[l_extendedprice] // 7 + ([l_quantity] - 25) % 4")


@query("""select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day, (isodow(o_orderdate) - 1)::int as weekday, dayofyear(o_orderdate)::int as day_of_year,
floor(epoch_us(o_orderdate) / 86400000000)::bigint as days_since_epoch, hour(o_orderdate)::int as hour from orders""")
def calendar_features(spark, d):
    return read(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in dates.calendar_features(F.col("o_orderdate")).items()])


@query("select o_orderkey, o_totalprice / 37000.5 as uf, o_totalprice * 37000.5 as clp from orders")
def currency_convert(spark, d):
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 37000.5).alias("uf"), (F.col("o_totalprice") * 37000.5).alias("clp"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as parsed from orders where o_orderkey % 4 <> 3 union all select o_orderkey, null from orders where o_orderkey % 4 = 3""")
def dates_mixed_parse(spark, d):
    t = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format(t, "dd/MM/yyyy")).when(k == 1, F.date_format(t, "dd-MM-yyyy")).when(k == 2, F.date_format(t, "yyyy-MM-dd")).otherwise("no date")
    rows = read(spark, d, "orders").select("o_orderkey", written.alias("t"))
    order = dates.detect_order(rows, "t").order
    return rows.select("o_orderkey", F.date_format(dates.parse_dates(F.col("t"), order), "yyyy-MM-dd").alias("parsed"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then round(c_acctbal, 1) when c_custkey % 3 = 1 then c_custkey + 0.5 else null end as x from customer""")
def local_numbers(spark, d):
    k = F.col("c_custkey") % 3
    t = F.when(k == 0, F.format_number(F.round("c_acctbal", 1), 1)).when(k == 1, F.concat(F.col("c_custkey").cast("string"), F.lit(",5"))).otherwise("?")
    swapped = F.translate(t, ",.", ";,")
    written = F.when(k == 0, F.replace(swapped, F.lit(";"), F.lit("."))).otherwise(t)
    return read(spark, d, "customer").select("c_custkey", text.local_number(F.when((k == 0) & ~written.contains(","), F.concat(written, F.lit(","))).otherwise(written)).alias("x"))


@query("""select 'customer' as src, c_custkey as k, c_acctbal as v from customer union all select 'supplier', s_suppkey, s_acctbal from supplier""")
def sheet_union(spark, d):
    from tidemark.operators.relational import union_same_columns

    a = read(spark, d, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = read(spark, d, "supplier").select(F.col("s_acctbal").alias("v"), F.lit("supplier").alias("src"), F.col("s_suppkey").alias("k"))
    return union_same_columns(a, b)


@query("select count(*) as rows from lineitem")
def parquet_rows(spark, d):
    return read(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("rows"))

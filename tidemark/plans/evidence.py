"""Findings seen together, milestones, profiles, and tables prepared for learning, over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import findings as fi
from tidemark.operators import prepared as pr
from tidemark.operators import state as st
from tidemark.operators.filters import anomalous_rows
from tidemark.operators.relational import Edge
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


# Findings of three detectors over the orders: grave prices by row, odd statuses by row, and a column with too many of one value.
FOUND = """with o as (select *, case when o_totalprice > 400000 then 'high' when o_totalprice > 300000 then 'medium' when o_totalprice > 250000 then 'low' end as grade from orders),
f as (select 'outlier' as kind, ['o_totalprice'] as columns, o_orderkey as row, grade as severity, 1::bigint as affected, 'price of ' || o_orderkey as text from o where grade is not null
union all select 'rule', ['o_orderstatus', 'o_orderdate'], o_orderkey, 'medium', 1, 'status of ' || o_orderkey from orders where o_orderkey % 500 = 0
union all select 'nulls', ['o_custkey'], null, 'high', count(*), 'customers' from orders where o_custkey % 10 = 0)"""


def _found(spark, d):
    o = read(spark, d, "orders")
    price = F.when(F.col("o_totalprice") > 400_000, "high").when(F.col("o_totalprice") > 300_000, "medium").when(F.col("o_totalprice") > 250_000, "low")
    one = lambda kind, columns, severity, text: (F.lit(kind).alias("kind"), F.array(*map(F.lit, columns)).alias("columns"), F.col("o_orderkey").alias("row"), severity.alias("severity"), F.lit(1).cast("long").alias("affected"), F.concat(F.lit(text), F.col("o_orderkey")).alias("text"))
    outliers = o.withColumn("_s", price).where("_s is not null").select(*one("outlier", ["o_totalprice"], F.col("_s"), "price of "))
    rules = o.where("o_orderkey % 500 = 0").select(*one("rule", ["o_orderstatus", "o_orderdate"], F.lit("medium"), "status of "))
    nulls = o.where("o_custkey % 10 = 0").agg(F.count(F.lit(1)).alias("affected")).select(F.lit("nulls").alias("kind"), F.array(F.lit("o_custkey")).alias("columns"), F.lit(None).cast("long").alias("row"), F.lit("high").alias("severity"), "affected", F.lit("customers").alias("text"))
    return outliers.unionByName(rules).unionByName(nulls)


@query(FOUND + " select kind, count(*) as findings, sum(affected)::bigint as affected from f group by 1")
def findings_by_kind(spark, d):
    return fi.load_by_kind(_found(spark, d))


@query(FOUND + ', c as (select unnest(columns) as "column", affected from f), g as (select "column", count(*) as findings, sum(affected)::bigint as affected from c group by 1) select *, row_number() over (order by affected desc, "column" desc) = 1 as most from g')
def findings_by_column(spark, d):
    return fi.load_by_column(_found(spark, d))


@query(FOUND + " select kind as \"table\", count(*) filter (severity in ('extreme', 'high')) as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, count(*) as findings from f group by 1")
def findings_by_table(spark, d):
    return fi.by_table(_found(spark, d).withColumn("table", F.col("kind")))


GRADE = "case severity when 'extreme' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"


@query(FOUND + f""", g as (select *, {GRADE} as grade from f), w as (select *, row_number() over (partition by kind, columns[1] order by grade desc, row desc) as k, sum(affected) over (partition by kind, columns[1]) as a, count(*) over (partition by kind, columns[1]) as n from g where row is not null)
select kind, columns[1] as "column", row, severity, a::bigint as affected, n as findings, grade from w where k = 1 union all select kind, columns[1], row, severity, affected, 1, grade from g where row is null""")
def findings_worst(spark, d):
    return fi.worst_by_column(_found(spark, d)).select("kind", F.col("columns")[0].alias("column"), "row", "severity", "affected", "findings", "grade")


@query(FOUND + f""", g as (select *, {GRADE} as grade from f), od as (select *, row_number() over (partition by kind, columns order by grade desc, affected desc, text) as k from g) select kind, row, severity, affected, grade from od where k = 1 order by grade desc, affected desc, kind limit 3""")
def findings_top(spark, d):
    return fi.top_findings(_found(spark, d)).select("kind", "row", "severity", "affected", "grade")


@query(FOUND + " select case kind when 'outlier' then 0 when 'rule' then 1 else 2 end as place, kind, array_to_string(list_sort(list(distinct columns[1])), ',') as columns, count(*) as findings from f group by 1, 2")
def findings_grouped(spark, d):
    return fi.group_by_kind(_found(spark, d), ("outlier", "rule")).withColumn("columns", F.array_join("columns", ","))


@query(FOUND + " select kind, epoch_us(median(o_orderdate))::bigint as micros from (select distinct kind, row from f where row is not null) join orders on row = o_orderkey group by 1")
def findings_dated(spark, d):
    return fi.dated(_found(spark, d), read(spark, d, "orders"), "o_orderkey", "o_orderdate", ["kind"]).select("kind", F.unix_micros("date").alias("micros"))


@query(FOUND + """, own as (select distinct row, unnest(columns) as own from f where row is not null), m as (select median(o_totalprice) as m from orders), s as (select m, median(abs(o_totalprice - m)) as mad from orders, m group by m),
p as (select o_orderpriority as v, count(*) * 1.0 / (select count(o_orderpriority) from orders) as share from orders where o_orderpriority is not null group by 1),
t as (select o_orderstatus as v, count(*) * 1.0 / (select count(o_orderstatus) from orders) as share from orders where o_orderstatus is not null group by 1)
select distinct row, 'o_totalprice' as "column", round(0.6745 * abs(o_totalprice - m) / mad, 6) as strength from own join orders on row = o_orderkey, s where own <> 'o_totalprice' and 0.6745 * abs(o_totalprice - m) / mad >= 2
union select distinct row, 'o_orderpriority', round(1 - share, 6) from own join orders on row = o_orderkey join p on v = o_orderpriority where share <= 0.05
union select distinct row, 'o_orderstatus', round(1 - share, 6) from own join orders on row = o_orderkey join t on v = o_orderstatus where own <> 'o_orderstatus' and share <= 0.05""")
def coincident_oddities(spark, d):
    odd = _found(spark, d).where("row is not null").select("row", F.explode("columns").alias("column"))
    found = fi.coincidences(read(spark, d, "orders"), odd, "o_orderkey", ["o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate"])
    return found.select("row", "column", r("strength", 6).alias("strength"))


@query("select count(*) as rows, 5 as columns, 3 as numeric, 'o_orderdate' as date_column, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') as first_date, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as last_date from orders")
def table_overview(spark, d):
    return fi.overview(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"))


@query("select max(o_orderdate)::date as last, date_diff('day', max(o_orderdate)::date, date '2002-01-01')::int as age, date_diff('day', max(o_orderdate)::date, date '2002-01-01') > 45 as stale from orders")
def stale_data(spark, d):
    return fi.stale(read(spark, d, "orders"), ["o_orderdate"], "2002-01-01")


@query("""select 'Total o_totalprice' as name, round(sum(o_totalprice), 2) as value from orders union all select 'Mean o_totalprice', round(avg(o_totalprice), 2) from orders
union all select 'o_totalprice / o_orderkey', round(sum(o_totalprice) / sum(o_orderkey), 2) from orders union all select 'Rows', count(*) from orders union all select 'Values of o_orderstatus', count(distinct o_orderstatus) from orders""")
def kpi_suggested(spark, d):
    from tidemark.operators.indicators import compute

    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return compute(o, fi.suggested_indicators(o)).withColumn("value", r("value", 2))


CONTAGION = """with c as (select distinct c_custkey as k from customer where c_acctbal < -900), o as (select o_orderkey as k from orders where o_custkey in (select k from c)), l as (select distinct l_orderkey * 1000000 + l_suppkey as k from lineitem where l_orderkey in (select k from o))"""


@query(CONTAGION + " select * from (select 'lineitem' as \"table\", count(*) as rows from l union all select 'orders', count(distinct k) from o) where rows > 0")
def contagion_index(spark, d):
    tables = {"customer": read(spark, d, "customer"), "orders": read(spark, d, "orders"), "lineitem": read(spark, d, "lineitem").withColumn("line", F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey"))}
    edges = [Edge("orders", "o_custkey", "customer", "c_custkey"), Edge("lineitem", "l_orderkey", "orders", "o_orderkey")]
    return fi.contagion_index(tables, "customer", tables["customer"].where("c_acctbal < -900"), edges, {"orders": "o_orderkey", "lineitem": "line"})


HISTORY = """with h as (select event_type as key, ts::date as "at", round(avg(value) / 100, 6) as improvement, case when count(*) % 3 = 0 then 'low' when count(*) % 3 = 1 then 'medium' else 'high' end as confidence from events group by 1, 2),
b as (select *, lag(improvement) over w as before, lag(confidence) over w as confidence_before from h window w as (partition by key order by "at")), k(c, v) as (values ('low', 0), ('medium', 1), ('high', 2))"""


def _runs(spark, d):
    made = read(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("at")).agg(r(F.avg("value") / 100, 6).alias("improvement"), F.count(F.lit(1)).alias("_n"))
    return made.withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("_n") % 3 + 1).cast("int"))).drop("_n")


@query(HISTORY + """ select key, strftime("at", '%Y-%m-%d') as "at", improvement, before, confidence, confidence_before, coalesce(abs(improvement - before) >= 0.02, false) as changed, coalesce(x.v < y.v, false) as less_sure from b left join k x on x.c = confidence left join k y on y.c = confidence_before""")
def analysis_history(spark, d):
    return fi.compare_runs(_runs(spark, d), 0.02).withColumn("at", F.date_format("at", "yyyy-MM-dd"))


@query(HISTORY + """, t as (select key, "at" as d, row_number() over (partition by key order by "at" desc) as k from h) select key, count(*) as kept, strftime(min(d), '%Y-%m-%d') as oldest from (select * from t where k <= 10 order by d desc, key limit 200) group by 1""")
def analysis_history_trimmed(spark, d):
    return fi.trimmed_history(_runs(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("kept"), F.date_format(F.min("at"), "yyyy-MM-dd").alias("oldest"))


MARKS = """with m as (select 'ship' as milestone, l_orderkey * 1000000 + l_suppkey as row, l_shipdate::timestamp as date from lineitem where l_shipdate is not null
union all select 'order', o_orderkey, o_orderdate::timestamp from orders where o_orderdate is not null)"""


def _marks(spark, d):
    ships = fi.milestones(read(spark, d, "lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey")).alias("id"), F.col("l_shipdate").alias("ship")), "id", ["ship"])
    return ships.unionByName(fi.milestones(read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("order")), "o_orderkey", ["order"]))


@query(MARKS + " select milestone, count(*) as n, epoch_us(min(date)) as first, epoch_us(max(date)) as last from m group by 1")
def milestone_series(spark, d):
    return _marks(spark, d).groupBy("milestone").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("date").cast("timestamp")).alias("first"), F.unix_micros(F.max("date").cast("timestamp")).alias("last"))


@query(MARKS + ' select milestone, row, row_number() over (order by date, milestone, row) as "rank" from m')
def milestone_ranks(spark, d):
    return fi.milestone_ranks(_marks(spark, d)).select("milestone", "row", "rank")


@query("""select l_orderkey * 1000000 + l_suppkey as row, round((epoch_us(l_shipdate::timestamp) - epoch_us(o_orderdate::timestamp)) / 86400000000.0, 6) as days, l_shipdate < o_orderdate as wrong from lineitem join orders on l_orderkey = o_orderkey where l_shipdate is not null and o_orderdate is not null""")
def gantt_intervals(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("id", F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey"))
    return fi.intervals(both, "id", "o_orderdate", "l_shipdate").select("row", r("days", 6).alias("days"), "wrong")


@query("select date_diff('day', o_orderdate::date, l_shipdate::date)::int as days, count(*) as rows from lineitem join orders on l_orderkey = o_orderkey where l_shipdate is not null and o_orderdate is not null group by 1")
def chart_day_differences(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return fi.chart_day_differences(both, "o_orderdate", "l_shipdate")


@query("select case when o_custkey % 7 = 0 then 'missing' else 'complete' end as part, count(*) as rows from orders group by 1")
def chart_complete(spark, d):
    return fi.chart_complete(read(spark, d, "orders").withColumn("x", F.when(F.col("o_custkey") % 7 != 0, 1)), "x")


@query("select o_orderkey as id, round(case when o_custkey % 7 = 0 then (select avg(o_totalprice) from orders where o_custkey % 7 <> 0) else o_totalprice end, 4) as y from orders where o_orderdate is not null")
def chart_filled_by_mean(spark, d):
    o = read(spark, d, "orders").withColumn("x", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice"))).withColumn("at", F.col("o_orderkey"))
    return fi.chart_series(o, "at", "x").select(F.col("date").alias("id"), r("y").alias("y"))


@query("""select o.o_orderkey, c.c_acctbal as balance, c.c_mktsegment as segment, n.n_name as nation from orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey""")
def combine_parents(spark, d):
    tables = {
        "orders": read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id")),
        "customer": read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment", F.col("c_nationkey").alias("nation_id")),
        "nation": read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name"),
    }
    out = pr.combine_with_parents("orders", tables, pr.infer_parents(tables))
    return out.select("o_orderkey", F.col("`customer.c_acctbal`").alias("balance"), F.col("`customer.c_mktsegment`").alias("segment"), F.col("`nation.n_name`").alias("nation"))


@query("""with g as (select l_suppkey, count(*) as n, sum(l_quantity) as s, avg(l_quantity) as a from lineitem group by 1) select s_suppkey, coalesce(n, 0) as lines__count, round(s, 2) as total, round(a, 8) as mean from supplier left join g on s_suppkey = l_suppkey""")
def explicit_1n(spark, d):
    out = pr.explicit_resume(read(spark, d, "supplier"), read(spark, d, "lineitem"), "lines", "s_suppkey", "l_suppkey", ["l_quantity"])
    return out.select("s_suppkey", "lines__count", r("lines__l_quantity__sum", 2).alias("total"), r("lines__l_quantity__mean", 8).alias("mean"))


PAIR = """with b as (select o_orderkey, o_custkey, o_orderdate, o_orderkey % 4 = 0 as test from orders), g as (select b.o_orderkey, count(h.o_orderkey) as n, sum(h.o_totalprice) as s from b left join orders h on h.o_custkey = b.o_custkey and h.o_orderdate < b.o_orderdate group by 1)
select b.o_orderkey, test, c_acctbal as balance, n as earlier, round(s, 2) as spent from b join g using (o_orderkey) left join customer on c_custkey = b.o_custkey"""


@query(PAIR)
def train_test_prepared(spark, d):
    """Both tables get the customer's balance and what the customer had ordered strictly before; the training table is no source of the test table."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").alias("target"))
    tables = {"train": o.where("o_orderkey % 4 <> 0"), "test": o.where("o_orderkey % 4 = 0"), "customer": read(spark, d, "customer").select("c_custkey", "c_acctbal"), "past": read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")}
    links = [pr.Link("train", "o_custkey", "customer", "c_custkey"), pr.Link("past", "o_custkey", "train", "o_custkey")]
    pair = pr.prepare_pair(tables, "train", "test", "target", links, "o_orderkey")
    out = [df.select("o_orderkey", F.lit(test).alias("test"), F.col("`customer.c_acctbal`").alias("balance"), F.col("`past.count`").alias("earlier"), F.round(F.col("`past.o_totalprice.sum`"), 2).alias("spent")) for df, test in ((pair.train, False), (pair.test, True))]
    return out[0].unionByName(out[1])


@query("""select o_orderkey, round(round_even(o_totalprice / 37.5, 2), 2) as uf, round(round_even(o_totalprice * 37.5, 0), 0) as clp from orders""")
def currency_columns(spark, d):
    out = st.currency_columns(read(spark, d, "orders"), ["o_totalprice"], lambda: 37.5)
    return out.select("o_orderkey", F.col("o_totalprice_UF").alias("uf"), F.col("o_totalprice_CLP").alias("clp"))


@query("select o_orderkey, case when o_orderkey % 1000 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 1500 = 0 then null else o_totalprice end as o_totalprice from orders")
def cells_edited(spark, d):
    o = read(spark, d, "orders")
    status = o.where("o_orderkey % 1000 = 0").select(F.col("o_orderkey").alias("row"), F.lit("o_orderstatus").alias("column"), F.lit("X").alias("value"))
    price = o.where("o_orderkey % 1500 = 0").select(F.col("o_orderkey").alias("row"), F.lit("o_totalprice").alias("column"), F.lit("").alias("value"))
    return st.edit_cells(o, "o_orderkey", status.unionByName(price)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""select o_orderkey from orders where o_orderstatus in ('F', 'O') and o_totalprice > 1000 and o_orderpriority = (select min(o_orderpriority) from orders) and o_orderdate between timestamp '1996-01-01' and timestamp '1999-12-31'""")
def filter_combined(spark, d):
    from tidemark.operators.filters import BaseFilter, Condition

    o = read(spark, d, "orders")
    first = o.agg(F.min("o_orderpriority")).first()[0]
    chosen = BaseFilter(conditions=(Condition("o_orderstatus", "in", ("F", "O")), Condition("o_totalprice", ">", (1000,))), chart=("o_orderpriority", (first,)), times=("o_orderdate", "1996-01-01", "1999-12-31"))
    return chosen.apply(o, "o_orderkey").select("o_orderkey")


@query("select 'sum' as name, round(sum(l_quantity), 2) as value from lineitem union all select 'ratio', round(sum(l_extendedprice) / sum(l_quantity), 2) from lineitem union all select 'product', round(sum(l_tax) * sum(l_discount), 2) from lineitem union all select 'both', round(sum(l_quantity) + sum(l_extendedprice) / sum(l_quantity), 2) from lineitem")
def report_blocks(spark, d):
    from tidemark.operators.indicators import report_blocks as blocks

    made = [("sum", "sum", "l_quantity", None), ("ratio", "ratio", "l_extendedprice", "l_quantity"), ("product", "product", "l_tax", "l_discount")]
    return blocks(read(spark, d, "lineitem"), made, [("both", "sum", "+", "ratio")]).withColumn("value", r("value", 2))


@query("select count(*) as n from (select distinct o_orderkey from orders where o_totalprice > 250000 or o_orderkey % 500 = 0)")
def anomalous_row_set(spark, d):
    named = _found(spark, d).where("row is not null").select("kind", F.col("row").alias("o_orderkey"))
    return anomalous_rows(read(spark, d, "orders"), named, "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query()
def sample_exact(spark, d):
    """Exactly a thousand rows (all, if fewer), the same on every run."""
    return st.sample_rows(read(spark, d, "orders"), "o_orderkey", 1_000).select("o_orderkey", "o_totalprice")

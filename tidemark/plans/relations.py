"""Related tables, cleaning and lineage over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning as cl
from tidemark.operators import lineage as lin
from tidemark.operators import relational as rel
from tidemark.operators.relational import Edge
from tidemark.plans.summaries import r, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

EDGES = [Edge("lineitem", "l_orderkey", "orders", "o_orderkey"), Edge("orders", "o_custkey", "customer", "c_custkey"), Edge("customer", "c_nationkey", "nation", "n_nationkey"), Edge("nation", "n_regionkey", "region", "r_regionkey"), Edge("lineitem", "l_suppkey", "supplier", "s_suppkey")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select o_orderkey, c_mktsegment as segment, c_acctbal as balance from orders left join customer on o_custkey = c_custkey")
def join_m1_enrich(spark, d):
    out = rel.enrich(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment", "c_acctbal"], "c")
    return out.select("o_orderkey", F.col("`c.c_mktsegment`").alias("segment"), F.col("`c.c_acctbal`").alias("balance"))


@query("""with g as (select o_custkey, count(*) as n, sum(o_totalprice) as s, avg(o_totalprice) as a, min(o_totalprice) as lo, max(o_totalprice) as hi, count(distinct o_orderpriority) as k from orders group by 1)
select c_custkey, coalesce(n, 0) as n, round(s, 2) as total, round(a, 8) as mean, lo, hi, k as priorities from customer left join g on c_custkey = o_custkey""")
def join_1n_total_resume(spark, d):
    out = rel.resume(read(spark, d, "customer"), read(spark, d, "orders"), "c_custkey", "o_custkey", ["o_totalprice"], ["o_orderpriority"], "o")
    c = lambda k: F.col(f"`o.{k}`")
    return out.select("c_custkey", c("count").alias("n"), F.round(c("o_totalprice.sum"), 2).alias("total"), F.round(c("o_totalprice.mean"), 8).alias("mean"), c("o_totalprice.min").alias("lo"), c("o_totalprice.max").alias("hi"), c("o_orderpriority.distinct").alias("priorities"))


def _prior(spark, d, **more):
    orders = read(spark, d, "orders")
    return rel.prior_resume(orders.select("o_orderkey", "o_custkey", "o_orderdate"), orders.select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"), "o_custkey", "o_custkey", "o_orderdate", "o_orderdate", "o_orderkey", ["o_totalprice"], prefix="p", **more)


@query("""select a.o_orderkey, count(b.o_orderkey) as n, round(sum(b.o_totalprice), 2) as total, round(avg(b.o_totalprice), 8) as mean, min(b.o_totalprice) as lo, max(b.o_totalprice) as hi
from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate group by 1""")
def asof_prior_resume(spark, d):
    c = lambda k: F.col(f"`p.{k}`")
    return _prior(spark, d).select("o_orderkey", c("count").alias("n"), F.round(c("o_totalprice.sum"), 2).alias("total"), F.round(c("o_totalprice.mean"), 8).alias("mean"), c("o_totalprice.min").alias("lo"), c("o_totalprice.max").alias("hi"))


@query("""select a.o_orderkey, round((epoch_us(any_value(a.o_orderdate)) - max(epoch_us(b.o_orderdate))) / 86400000000.0, 6) as days
from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate group by 1""")
def asof_recency(spark, d):
    return _prior(spark, d).select("o_orderkey", F.round(F.col("`p.days_since`"), 6).alias("days"))


@query("""select a.o_orderkey, count(b.o_orderkey) filter (b.o_orderdate >= a.o_orderdate - interval 30 day) as n30, count(b.o_orderkey) as n365, round(sum(b.o_totalprice), 2) as total365
from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate and b.o_orderdate >= a.o_orderdate - interval 365 day group by 1""")
def asof_trailing_windows(spark, d):
    out = _prior(spark, d, windows=(30, 365))
    return out.select("o_orderkey", F.col("`p.count_30d`").alias("n30"), F.col("`p.count_365d`").alias("n365"), F.round(F.col("`p.o_totalprice.sum_365d`"), 2).alias("total365"))


@query("""select a.o_orderkey, max_by(b.o_orderpriority, (epoch_us(b.o_orderdate), b.o_orderpriority)) as last_priority
from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate group by 1""")
def asof_last_category(spark, d):
    return _prior(spark, d, categories=["o_orderpriority"]).select("o_orderkey", F.col("`p.o_orderpriority.last`").alias("last_priority"))


def _tables(spark, d, *names):
    return {n: read(spark, d, n) for n in names}


@query("""select o_orderkey, c_mktsegment as segment, n_name as nation, r_name as region from orders left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def multi_hop_enrich(spark, d):
    out = rel.enrich_chain(_tables(spark, d, "orders", "customer", "nation", "region"), "orders", EDGES, {"customer": ["c_mktsegment"], "nation": ["n_name"], "region": ["r_name"]})
    return out.select("o_orderkey", F.col("`customer.c_mktsegment`").alias("segment"), F.col("`customer.nation.n_name`").alias("nation"), F.col("`customer.nation.region.r_name`").alias("region"))


@query("""with a as (select distinct c_custkey::varchar as v from customer), b as (select distinct o_custkey::varchar as v from orders)
select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from a join b using (v)) as common, round((select count(*) from a join b using (v)) / least((select count(*) from a), (select count(*) from b))::double, 6) as overlap""")
def value_overlap(spark, d):
    return rel.value_overlap(read(spark, d, "customer"), "c_custkey", read(spark, d, "orders"), "o_custkey").withColumn("overlap", r("overlap", 6))


@query("""with c as (select o_custkey::varchar as v, count(*) as c from orders where o_custkey::varchar not in ('', '0', '-1', 'na', 'n/a', 'nan', 'none', 'null', 'sin dato', 's/d', '-', '999', '9999') group by 1),
t as (select sum(c)::bigint as n, count(*) as dd, max(c) as m from c), u as (select case when m > 1 then n - m else n end as n, case when m > 1 then dd - 1 else dd end as distinct_values from t)
select n, distinct_values, n >= 3 and distinct_values >= 0.95 * n as is_key from u""")
def key_cardinality(spark, d):
    return rel.key_profile(read(spark, d, "orders"), "o_custkey")


@query("select count(*) as n, count(*) filter (o_orderkey is null) as unmatched from lineitem left join orders on l_orderkey = o_orderkey and o_orderstatus = 'F'")
def unmatched_keys(spark, d):
    return rel.unmatched(read(spark, d, "lineitem"), "l_orderkey", read(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


@query("""with k as (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'), c as (select c_custkey from customer join k on c_nationkey = n_nationkey),
o as (select o_orderkey from orders join c on o_custkey = c_custkey), l as (select 1 from lineitem join o on l_orderkey = o_orderkey)
select 1 as level, 'nation' as table, 'region' as parent, (select count(*) from k) as rows union all select 2, 'customer', 'nation', (select count(*) from c)
union all select 3, 'orders', 'customer', (select count(*) from o) union all select 4, 'lineitem', 'orders', (select count(*) from l)""")
def contagion_bfs(spark, d):
    t = _tables(spark, d, "region", "nation", "customer", "orders", "lineitem")
    return rel.contagion(t, "region", t["region"].where("r_name = 'ASIA'"), EDGES[:4])


@query("""with a as (select o_custkey from orders where o_totalprice > 400000), g as (select o_custkey as c_custkey, count(*) as n_rows from a group by 1 order by n_rows desc, c_custkey limit 3)
select c_custkey, c_name, n_rows from g join customer using (c_custkey)""")
def crossings_top3(spark, d):
    return rel.top_crossings(read(spark, d, "orders").where("o_totalprice > 400000"), "o_custkey", read(spark, d, "customer"), "c_custkey", "c_name")


@query()
def relations_inferred(spark, d):
    return lin.infer_relations(_tables(spark, d, "region", "nation", "customer", "orders", "supplier"))


@query()
def lineage_tree(spark, d):
    return lin.lineage(_tables(spark, d, "region", "nation", "customer", "orders", "lineitem", "supplier"), EDGES, "customer", "c_custkey", 7)


DUP_GROUPS = """with g as (select l_partkey % 50 as a, l_linenumber as b, l_returnflag as c, min(l_orderkey * 1000000 + l_suppkey) as f, count(*) as n from lineitem group by 1, 2, 3 having count(*) > 1)
select l_orderkey * 1000000 + l_suppkey as row, f as group_first from lineitem join g on l_partkey % 50 = a and l_linenumber = b and l_returnflag = c"""


@query(DUP_GROUPS)
def dup_groups(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey")).alias("id"), (F.col("l_partkey") % 50).alias("a"), F.col("l_linenumber").alias("b"), F.col("l_returnflag").alias("c"))
    return cl.duplicate_groups(rows, "id", ["a", "b", "c"])


@query(DUP_GROUPS)
def dup_groups_whole(spark, d):
    """The same query under its earlier name."""
    return dup_groups(spark, d)


@query("select min(doc_id) as doc_id, lang from documents group by text, lang")
def dedupe_keep_first(spark, d):
    return cl.drop_duplicates_keep_first(read(spark, d, "documents"), "doc_id", ["text", "lang"]).select("doc_id", "lang")


@query("""select 'name' as column, c_custkey as row, case when c_custkey % 4 = 0 then ' ' || c_name else c_name || chr(160) end as value, c_name as suggested from customer where c_custkey % 4 in (0, 1)""")
def trim_findings(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit(" "), F.col("c_name"))).when(k == 1, F.concat(F.col("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
    return cl.space_findings(read(spark, d, "customer").select("c_custkey", name.alias("name")), "c_custkey", ["name"])


VARIANTS = "case when c_custkey % 11 = 0 then lower(c_mktsegment) when c_custkey % 11 = 1 then left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2)) else c_mktsegment end"


def _segments(spark, d):
    k, s = F.col("c_custkey") % 11, F.col("c_mktsegment")
    v = F.when(k == 0, F.lower(s)).when(k == 1, F.concat(F.substring(s, 1, 1), F.lower(F.expr("substring(c_mktsegment, 2)")))).otherwise(s)
    return read(spark, d, "customer").select("c_custkey", v.alias("segment"))


RANKED = """g as (select v, count(*) as n, lower(v) as k from {0} group by v), p as (select *, row_number() over (partition by k order by n desc, case when v = upper(v) or v = lower(v) then 1 else 0 end, v) as i from g),
b as (select k, v as canonical from p where i = 1)"""


@query(f"with s as (select {VARIANTS} as v from customer), {RANKED.format('s')} select 'segment' as column, v as value, canonical, n from g join b using (k) where v <> canonical")
def format_variants(spark, d):
    return cl.format_variants(_segments(spark, d), ["segment"])


@query(f"with s as (select c_custkey, {VARIANTS} as v from customer), {RANKED.format('s')} select c_custkey, canonical as segment from s join b on lower(v) = k")
def apply_format(spark, d):
    rows = _segments(spark, d)
    return cl.apply_variants(rows, "segment", cl.format_variants(rows, ["segment"]))


@query("""with s as (select 'nation' as t, case when n_nationkey % 2 = 0 then n_name else lower(n_name) end as v from nation union all select 'region', lower(r_name) from region union all select 'again', upper(n_name) from nation),
g as (select v, count(*) as n, lower(v) as k from s group by v), p as (select *, row_number() over (partition by k order by n desc, case when v = upper(v) or v = lower(v) then 1 else 0 end, v) as i from g), b as (select k, v as canonical from p where i = 1)
select t as table, v as value, canonical, count(*) as n from s join b on lower(v) = k where v <> canonical group by 1, 2, 3""")
def cross_table_variants(spark, d):
    n = read(spark, d, "nation")
    a = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("v"))
    return cl.cross_table_variants({"nation": (a, "v"), "region": (read(spark, d, "region").select(F.lower("r_name").alias("v")), "v"), "again": (n.select(F.upper("n_name").alias("v")), "v")})


@query("""select 'text' as column, m as mark, count(*) as n from (select unnest(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s\\x{85}\\x{A0}\\x20.,\\-_''"()/:;@]')) as m from documents) group by 2""")
def special_chars(spark, d):
    return cl.special_characters(read(spark, d, "documents"), ["text"])


@query("""with t as (select p_partkey as row, case when p_partkey % 5 = 0 then p_size::varchar || ' kg' when p_partkey % 5 = 1 then 'treinta y cinco' when p_partkey % 5 = 2 then p_size::varchar || ',5' else p_size::varchar end as value, p_size, p_partkey % 5 as k from part)
select row, value, case when k = 0 then p_size::double when k = 1 then 35.0 else p_size + 0.5 end::double as number from t where k < 3""")
def numbers_as_text(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(s, F.lit(" kg"))).when(k == 1, "treinta y cinco").when(k == 2, F.concat(s, F.lit(",5"))).otherwise(s)
    return cl.numbers_as_text(read(spark, d, "part").select("p_partkey", t.alias("size")), "p_partkey", "size")


@query("""select 'c_name' as column, count(*) filter (c_custkey % 6 = 1) as changed from customer union all select 'c_acctbal', count(*) filter (c_custkey % 10 = 3 and c_custkey % 6 <> 0) from customer
union all select '(rows removed)', count(*) filter (c_custkey % 6 = 0) from customer""")
def change_summary(spark, d):
    before = read(spark, d, "customer")
    after = before.where("c_custkey % 6 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 6 == 1, "new").otherwise(F.col("c_name"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, None).otherwise(F.col("c_acctbal")))
    return cl.change_summary(before, after, "c_custkey", ["c_name", "c_acctbal"])


@query("select a.o_orderkey, a.o_totalprice as predicted, b.o_totalprice as actual from orders a join orders b on a.o_orderkey = b.o_orderkey and b.o_orderstatus = 'F'")
def pair_predicted_actual(spark, d):
    o = read(spark, d, "orders")
    return rel.pair_by_id(o.select("o_orderkey", F.col("o_totalprice").alias("predicted")), o.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("actual")), "o_orderkey")

"""Named queries over the driver's tables and the SQL that DuckDB runs for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import trailing_window
from tidemark.operators.indicators import by_category
from tidemark.operators.relational import enrich, prior_resume
from tidemark.plans import columns, discovery, evidence, relations, summaries, time
from tidemark.plans.summaries import read

MODULES = (summaries, relations, discovery, time, evidence, columns)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last year with their customers' segment and what those had ordered before, totalled by segment."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    known = enrich(orders, customer, "o_custkey", "c_custkey", ["c_mktsegment"], "customer").withColumnRenamed("customer.c_mktsegment", "segment")
    before = prior_resume(known, orders, "o_custkey", "o_custkey", "o_orderdate", "o_orderdate", "o_orderkey", ["o_totalprice"])
    recent = trailing_window(before, "o_orderdate", 365).withColumn("earlier", F.coalesce(F.col("`prior.o_totalprice.sum`"), F.lit(0.0)))
    return by_category(recent, "segment", "sum", "earlier")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}

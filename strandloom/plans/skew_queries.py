"""Core queries on hot keys and intervals over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.hotkeys import entry_totals, top_read_per_node
from strandloom.operators.intervals import periods_and_gaps
from strandloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_read_per_node(table(spark, d, "read_paths")).select("store", "node", "read_id")


def p1_entry_totals(spark: SparkSession, d: str) -> DataFrame:
    return entry_totals(table(spark, d, "read_paths").distinct())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "thread_nodes").where("node <> 0"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_entry_totals, p3_found)}


# a row is a path; of several paths of a read the one with most entries of the node counts
_ENTRIES = "r as (select *, row_number() over () row_no from (select distinct * from read_paths)), e as (select store, read_id, row_no, abs(unnest(path)) node from r), n as (select store, node, read_id, row_no, count(*) entries from e where node <> 0 and store is not null and read_id is not null group by all)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_ENTRIES} select store, node, read_id from n qualify row_number() over (partition by store, node order by entries desc, read_id) = 1",
        "p1_entry_totals": f"with {_ENTRIES} select store, node, cast(sum(entries) as bigint) entries, count(*) reads from n group by all",
        "p3_found": """with v as (select thread_id, node, start_pos s, end_pos e from thread_nodes where node is not null and node <> 0 and start_pos is not null and end_pos > start_pos),
            f as (select *, case when s <= max(e) over (partition by thread_id, node order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end fresh from v),
            g as (select *, sum(fresh) over (partition by thread_id, node order by s, e rows unbounded preceding) grp from f),
            p as (select thread_id, node, min(s) from_pos, max(e) to_pos from g group by thread_id, node, grp)
            select thread_id, node, 'period' span_kind, from_pos, to_pos from p
            union all select * from (select thread_id, node, 'gap', to_pos, lead(from_pos) over (partition by thread_id, node order by from_pos) n from p) where n is not null""",
    }

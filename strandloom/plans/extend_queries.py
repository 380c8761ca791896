"""Queries on extension through the graph and on match lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import extend as E
from strandloom.operators import mapping as M
from strandloom.operators import partition as P
from strandloom.operators import traversal as T
from strandloom.operators.graph import Graph
from strandloom.plans.contig_queries import _votes
from strandloom.plans.graph_queries import _EV, _LINES, _STEP, _thin
from strandloom.plans.mapping_queries import _PM, S50, seeds
from strandloom.plans.views import NODES, THREADS, nodes, paths, reads, threads
from strandloom.session import persisted

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string")))


@query()
def reads_pathed_extended(spark, d):
    """Paths of all reads by extension of their matches through the links of threads."""
    g = Graph(nodes(spark, d), _thin(spark, d))
    out = E.path_reads_extended(seeds(spark, d), reads(spark, d), g, 31)
    return out.select("store", "read_id", "path_offset", _text("path").alias("path"))


@query()
def paths_bridged(spark, d):
    g = Graph(nodes(spark, d), _thin(spark, d))
    return E.bridge_paths(paths(spark, d).select("store", "read_id", "path"), g, 2, 4000).select("store", "read_id", _text("path").alias("path"))


@query(f"""{S50}, {_PM}, o as (select *, row_number() over (partition by store, read_id order by read_position, size, node, node_position) ord from pm), f as (select store, read_id, node, min(ord) a from o group by all),
 tu as (select o.store, o.read_id, min(ord) turn from o join f on f.store = o.store and f.read_id = o.read_id and f.node = -o.node and f.a < o.ord group by 1, 2) select o.store, o.read_id, node, node_position, read_position, size from o left join tu using (store, read_id) where turn is null or ord < turn""")
def turnarounds_truncated(spark, d):
    return E.truncate_turnarounds(M.perfect_matches(seeds(spark, d, limit=50), 31, 35))


_POP = f"""with {THREADS}, t as (select thread_id, idx, node from th union all select -thread_id, -idx, -node from th), o as (select thread_id, node, min(idx) i from t group by all), n as (select node, count(*) n from o group by node),
 ah as (select a.thread_id, a.node, b.node other, b.i j from o a join o b using (thread_id) where b.i > a.i and abs(a.node) <> abs(b.node)), of as (select node, other, n from (select node, other, count(*) c from ah group by all) join n using (node) where c > 0.5 * n),
 ne as (select thread_id, node, n, arg_min(other, j) other from ah join of using (node, other) group by all), go as (select node, other from ne group by node, other, n having count(*) > 0.6 * n), bs as (select node, min(other) other from go group by node having count(*) = 1)"""


@query(f"{_POP} select node, other from bs")
def popular_next(spark, d):
    return E.popular_next(threads(spark, d), 0.5, 0.6)


@query(f"""{_POP.replace('with ', 'with recursive ', 1)}, {NODES}, {_EV},
 mu as (select a.node, a.other from bs a join bs b on b.node = -a.other and b.other = -a.node),
 ms as (select node, other nx from mu union select -other, -node from mu),
 en as (select node, count(*) n, min(nx) nx from ms group by node), {_STEP}, {_LINES.format(sp='sp', ev='ev')}
 select line, cast(place as integer) place, node from ln""")
def nodes_grouped(spark, d):
    return E.group_nodes(nodes(spark, d), persisted(E.popular_next(threads(spark, d), 0.5, 0.6), "best"))


@query()
def tangles_walked(spark, d):
    t = nodes(spark, d)
    members = persisted(T.tangles(t, _thin(spark, d), t.where("length(seq) >= 260")), "tangles")
    ends = members.where("role = 'frontier'").select((-F.col("node")).alias("node"))
    walks = P.stride(persisted(P.next_winners(_votes(spark, d), 2, 0.5), "winners"), ends, 8)
    return E.end_to_end(members, walks).select("tangle", "from_node", "to_node", _text("path").alias("path"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

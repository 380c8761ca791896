"""Queries on read threads, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import threads as R
from strandloom.plans.views import NODES, THREADS, UNIQUE, nodes, threads, unique_threads
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


W = f"with {THREADS}"
U = f"with {UNIQUE}"
_NT = "nt as (select distinct abs(node) node, thread_id from th)"
_RN = "rn as (select *, row_number() over (partition by thread_id order by idx) - 1 place from th)"


@query(f"""{W}
 select -node source, nx dest, cast(ns - end_pos as integer) dist, thread_id, cast(o as integer) ordinal from (select *, lead(node) over w nx, lead(start_pos) over w ns, row_number() over w - 1 o from th window w as (partition by thread_id order by idx)) where nx is not null""")
def thread_links(spark, d):
    return R.thread_links(threads(spark, d))


@query(f"{U} select thread_id, cast(row_number() over (partition by thread_id order by idx) - 1 as integer) idx, node from ut")
def thread_dedup_nodes(spark, d):
    return R.renumber(R.drop_repeated(threads(spark, d))).select("thread_id", "idx", "node")


@query(f"""{U}, k as (select * from ut qualify count(*) over (partition by thread_id) >= 3)
 select -node source, nx dest, cast(ns - end_pos as integer) dist, thread_id, cast(o as integer) ordinal from (select *, lead(node) over w nx, lead(start_pos) over w ns, row_number() over w - 1 o from k window w as (partition by thread_id order by idx)) where nx is not null""")
def threads_graph(spark, d):
    return R.threads_graph(threads(spark, d), True, 3)[0]


@query(f"{W} select thread_id, arg_min(node, idx) start_node, -arg_max(node, idx) end_node, count(*) - 1 link_count from th group by thread_id")
def thread_info(spark, d):
    return R.thread_info(threads(spark, d))


@query(f"""{W}, {NODES}, s as (select thread_id, idx, node, length(seq) size, cast(coalesce(start_pos - lag(end_pos) over w, 0) as bigint) gap, row_number() over w - 1 place from th join nd on node_id = abs(node) window w as (partition by thread_id order by idx)),
  p as (select *, sum(gap) over w2 + coalesce(sum(size) over (partition by thread_id order by place rows between unbounded preceding and 1 preceding), 0) s0 from s window w2 as (partition by thread_id order by place rows unbounded preceding))
  select thread_id, cast(place as integer) place, node, cast(s0 as bigint) start_pos, cast(s0 + size as bigint) end_pos from p""")
def thread_positions(spark, d):
    return R.thread_positions(threads(spark, d), nodes(spark, d))


@query(f"""{W}, {NODES}, s as (select thread_id, idx, node, length(seq) size, cast(coalesce(lag(start_pos) over w - end_pos, 0) as bigint) gap, row_number() over w - 1 place from th join nd on node_id = abs(node) window w as (partition by thread_id order by idx desc)),
  p as (select *, sum(gap) over w2 + coalesce(sum(size) over (partition by thread_id order by place rows between unbounded preceding and 1 preceding), 0) s0 from s window w2 as (partition by thread_id order by place rows unbounded preceding))
  select -thread_id thread_id, cast(place as integer) place, -node node, cast(s0 as bigint) start_pos, cast(s0 + size as bigint) end_pos from p""")
def thread_positions_reversed(spark, d):
    return R.thread_positions(threads(spark, d), nodes(spark, d), reverse=True)


@query(f"{W} select thread_id, idx, node, lag(node) over w prev_node, lead(node) over w next_node from th window w as (partition by thread_id order by idx)")
def thread_neighbours(spark, d):
    return R.neighbours_in_thread(threads(spark, d))


_AT = "a as (select thread_id, min(idx) \"at\", arg_min(node, idx) seen from th where abs(node) = 7 group by thread_id)"


@query(f"{W}, {_AT} select thread_id, case when seen > 0 then node else -node end node from th join a using (thread_id) where idx <> \"at\" and ((seen > 0 and idx > \"at\") or (seen < 0 and idx < \"at\"))")
def nodes_after_in_thread(spark, d):
    return R.nodes_after(threads(spark, d), 7)


@query(f"{W}, {_AT} select thread_id, case when seen > 0 then node else -node end node from th join a using (thread_id) where idx <> \"at\" and ((seen > 0 and idx < \"at\") or (seen < 0 and idx > \"at\"))")
def nodes_before_in_thread(spark, d):
    return R.nodes_after(threads(spark, d), 7, before=True)


@query(f"{W} select distinct abs(node) node, cast(sign(node) as bigint) * thread_id thread_id from th")
def node_threads(spark, d):
    return R.node_threads(threads(spark, d), oriented=True)


@query(f"{W} select abs(node) node, thread_id, cast(row_number() over (partition by thread_id order by idx) as integer) \"position\" from th")
def node_threadpositions(spark, d):
    return R.node_threadpositions(threads(spark, d))


@query(f"{W}, {_NT} select a.node, b.node other, count(*) shared_threads from nt a join nt b using (thread_id) group by all")
def node_thread_neighbours(spark, d):
    return R.node_thread_neighbours(threads(spark, d))


@query(f"""{W},
 nt as (select distinct abs(node) node, cast(sign(node) as bigint) * thread_id thread_id from th)
 select a.node, b.node other, count(*) shared_threads from nt a join nt b using (thread_id) where a.node < b.node group by all""")
def shared_threads(spark, d):
    return R.shared_threads(threads(spark, d))


@query(f"""{W}, {_NT},
 sh as (select a.node, b.node other from nt a join nt b using (thread_id) where a.node <> b.node group by all having count(*) > 2),
 sp as (select a.thread_id, a.node, count(*) n from nt a join nt b using (thread_id) join sh on sh.node = a.node and sh.other = b.node group by all)
 select nt.thread_id, nt.node from nt left join sp using (thread_id, node) where coalesce(n, 0) <= 1""")
def support_popping(spark, d):
    return R.support_popping_list(threads(spark, d), 1, 2)


@query(f"{W}, {_NT} select thread_id, node from nt where node in (select node from nt group by node having count(*) > 30)")
def repeat_popping(spark, d):
    return R.thread_count_popping_list(threads(spark, d), most=30)


@query(f"{W}, {_NT} select thread_id, node from nt where node in (select node from nt group by node having count(*) < 2)")
def lowmap_popping(spark, d):
    return R.thread_count_popping_list(threads(spark, d), least=2)


@query(f"""{W}, {_NT},
 k as (select * from th where abs(node) not in (select node from nt group by node having count(*) > 30)),
 r as (select *, row_number() over (partition by thread_id order by idx) - 1 i, count(*) over (partition by thread_id) n from k)
 select thread_id, cast(i as integer) idx, node from r where n >= 2""")
def popped_threads(spark, d):
    t = threads(spark, d)
    return R.pop(t, R.thread_count_popping_list(t, most=30)).select("thread_id", "idx", "node")


@query(f"""with recursive {UNIQUE}, nu as materialized (select distinct abs(node) node, thread_id from ut), pa as materialized (select a.node, a.thread_id t1, b.thread_id t2 from nu a join nu b using (node) where a.thread_id <> b.thread_id), cl as materialized (select t1, t2 from pa group by all having count(*) >= 2),
 ed as materialized (select node, t1, t2 from pa join cl using (t1, t2)),
 cc as (select node, thread_id t, thread_id root from nu union select cc.node, ed.t2, cc.root from cc join ed on ed.node = cc.node and ed.t1 = cc.t),
 g as (select node, t thread_id, min(root) c from cc group by all),
 z as (select node, c, count(*) n from g group by all),
 rk as (select node, c, n, row_number() over (partition by node order by n desc) r, count(*) over (partition by node, n) ties from z), tw as (select node, max(n) filter (r = 1) n1, coalesce(max(n) filter (r = 2), 0) n2, max(c) filter (r = 1) c1 from rk group by node)
 select g.thread_id, g.node from g join tw using (node) where n2 > 0.5 * n1 or c <> c1""")
def clustering_popping(spark, d):
    return R.clustering_popping_list(unique_threads(spark, d), 2, 0.5)


@query(f"{W} select thread_id, array_to_string(list_sort(list(distinct node)), ',') nodes from th group by thread_id")
def thread_nodesets(spark, d):
    return R.thread_nodesets(threads(spark, d)).select("thread_id", F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string"))).alias("nodes"))


@query(f"""{W}, {NODES}, v as (select thread_id, sum(case when node > 0 then 1 else -1 end) vote, min(start_pos) lo, max(end_pos) hi from th where abs(node) in (select node_id from nd where length(seq) >= 300) group by thread_id)
  select case when vote > 0 then thread_id else -thread_id end thread_id, abs(node) node, cast(case when vote > 0 then start_pos - lo else hi - end_pos end as integer) start_pos, cast(case when vote > 0 then end_pos - lo else hi - start_pos end as integer) end_pos
  from th join v using (thread_id) where abs(node) in (select node_id from nd where length(seq) >= 300) and vote <> 0 and (node > 0) = (vote > 0)""")
def subset_positions(spark, d):
    return R.subset_positions(threads(spark, d), nodes(spark, d).where("length(seq) >= 300").select(F.col("node_id").alias("node")))


@query(f"""{W}, {_RN}
 select least(abs(a.node), abs(b.node)) node, greatest(abs(a.node), abs(b.node)) other, count(*) times from rn a join rn b on a.thread_id = b.thread_id and b.place between a.place + 1 and a.place + 3 where abs(a.node) <> abs(b.node) group by 1, 2""")
def node_proximity_r3(spark, d):
    return R.proximity(threads(spark, d), 3)


@query(f"""{W}, {_RN}, bt as (select thread_id, 1 way, place, node, start_pos, end_pos from rn union all select thread_id, -1, -place, -node, -end_pos, -start_pos from rn),
  pr as (select a.thread_id, a.way, a.place, a.node, a.end_pos, b.node other, b.place j, b.start_pos s from bt a join bt b on a.thread_id = b.thread_id and a.way = b.way and b.place > a.place and abs(a.node) <> abs(b.node)),
  ok as (select node, other from pr group by all having count(distinct thread_id) >= 3), ne as (select pr.*, row_number() over (partition by thread_id, way, place order by j) k from pr join ok using (node, other)),
  fn as (select node, other, list_sort(list(s - end_pos)) l from ne where k <= 2 group by all) select node, other, cast(l[len(l) // 2 + 1] as integer) dist, len(l) times from fn where len(l) >= 2""")
def closest_reliable(spark, d):
    return R.closest_reliable(threads(spark, d), 2, 3)


_OVERLAP = """nu as (select distinct abs(node) node, thread_id from ut), pr as (select a.thread_id t1, b.thread_id t2 from nu a join nu b using (node) where a.thread_id < b.thread_id group by all having count(*) >= 2),
 pl as (select thread_id, node, row_number() over (partition by thread_id order by idx) - 1 i, count(*) over (partition by thread_id) s from ut),
 sh as (select pr.t1, pr.t2, a.i, a.s s1, b.s s2, a.node <> b.node turned, case when a.node <> b.node then b.s - 1 - b.i else b.i end k from pr join pl a on a.thread_id = pr.t1 join pl b on b.thread_id = pr.t2 and abs(b.node) = abs(a.node)),
 sp as (select *, i - lag(i) over w di, k - lag(k) over w dk from sh window w as (partition by t1, t2 order by i)),
 ov as (select t1, t2, bool_and(turned) alt, bool_or(turned) ant, min(dk) ord, max(least(di, dk)) hole, min(i) b1, any_value(s1) - 1 - max(i) h1, min(k) b2, any_value(s2) - 1 - max(k) h2 from sp group by t1, t2)"""


@query(f"""{U}, {_OVERLAP} select t1, t2, case when alt <> ant or coalesce(ord, 1) < 0 or coalesce(hole, 0) > 11 then 'invalid' when (b1 > 10 and b2 > 10) or (h1 > 10 and h2 > 10) then 'invalid'
 when b1 <= 10 and b2 <= 10 and h1 <= 10 and h2 <= 10 then 'complete_' || t when b1 <= 10 and h1 <= 10 then 't1_in_' || t when b2 <= 10 and h2 <= 10 then t || '_in_t1' when b1 > 10 and h2 > 10 then 't1_' || t else t || '_t1' end class from (select *, case when ant then 'rt2' else 't2' end t from ov)""")
def thread_overlap_class(spark, d):
    t = persisted(unique_threads(spark, d), "ut")
    nt = R.node_threads(t)
    pairs = nt.select(F.col("thread_id").alias("t1"), "node").join(nt.select(F.col("thread_id").alias("t2"), "node"), "node").where("t1 < t2").groupBy("t1", "t2").count().where("count >= 2")
    return R.overlap_class(t, pairs)


def _core_sql(rounds: int) -> str:
    """The pruning written out ``rounds`` times, as materialised steps; more than any of the tables needs."""
    steps = ["k0 as materialized (select * from th)"]
    for i in range(rounds):
        steps.append(f"m{i} as materialized (select * from k{i} where abs(node) in (select abs(node) from k{i} group by 1 having count(distinct thread_id) >= 2))")
        steps.append(f"k{i + 1} as materialized (select * from m{i} where thread_id in (select thread_id from m{i} group by 1 having count(*) - 1 > 3))")
    return f"{W}, {', '.join(steps)} select thread_id, cast(row_number() over (partition by thread_id order by idx) - 1 as integer) idx, node from k{rounds}"


@query(_core_sql(12))
def reduced_graph_fixpoint(spark, d):
    return R.reduced(threads(spark, d), 3, 2).select("thread_id", "idx", "node")


@query(f"{W}, {NODES} select thread_id, cast(row_number() over (partition by thread_id order by idx) - 1 as integer) idx, node from th where abs(node) in (select node_id from nd where length(seq) >= 200)")
def threads_restricted(spark, d):
    return R.restricted(threads(spark, d), nodes(spark, d).where("length(seq) >= 200").select(F.col("node_id").alias("node"))).select("thread_id", "idx", "node")


@query(f"{W} select thread_id, idx, node from th where thread_id not in (select thread_id from th where end_pos <= start_pos)")
def threads_removed(spark, d):
    t = threads(spark, d)
    return R.remove_threads(t, t.where("end_pos <= start_pos").select((-F.col("thread_id")).alias("thread_id"))).select("thread_id", "idx", "node")


@query(f"""{W}, a as (select * from th where thread_id % 2 = 1 or idx % 2 = 0), b as (select * from th where idx % 3 <> 1), h as (select distinct thread_id, abs(node) n from a), g as (select thread_id from h group by 1 having count(*) >= 3),
  f as (select b.* from b where thread_id in (select thread_id from g) and not exists (select 1 from h where h.thread_id = b.thread_id and h.n = abs(b.node)) and not exists (select 1 from a where a.thread_id = b.thread_id and b.start_pos < a.end_pos and b.end_pos > a.start_pos)),
  u as (select thread_id, node, start_pos, end_pos from a union all select thread_id, node, start_pos, end_pos from f) select thread_id, node, start_pos, end_pos, cast(row_number() over (partition by thread_id order by start_pos, end_pos, node) - 1 as integer) idx from u""")
def threads_merged(spark, d):
    t = threads(spark, d)
    return R.merge(t.where("thread_id % 2 = 1 or idx % 2 = 0"), t.where("idx % 3 <> 1"), 3)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

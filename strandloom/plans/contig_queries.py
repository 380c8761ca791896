"""Queries on classes, orders, cleaning and construction, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.seq import kmers
from strandloom.operators import contig as C
from strandloom.operators import kmer_counts as K
from strandloom.operators import mapping as M
from strandloom.operators import partition as P
from strandloom.operators.graph import Graph, canonical_repeats
from strandloom.plans.graph_queries import _BUB, _DEG, _LINES, _PAR, _REP, _SPELT, _STEP, _THIN, _TIPS, TH, _thin, links
from strandloom.plans.kmer_queries import _BOTH
from strandloom.plans.mapping_queries import _VOTES
from strandloom.plans.views import NODES, PATHS, READS, THREADS, kmers_sql, nodes, paths, reads, threads, unique_threads
from strandloom.session import persisted, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _size_class(spark, d):
    """Starting classes by size of node: 1 short, 2 middle, 3 long, 0 for collapsed repeats."""
    size = F.length("seq")
    repeats = table(spark, d, "repeat_nodes").select("node_id", F.lit(True).alias("rep"))
    t = nodes(spark, d).join(repeats, "node_id", "left")
    return t.select(F.col("node_id").alias("node"), F.when(F.col("rep"), 0).when(size < 200, 1).when(size < 300, 2).otherwise(3).cast("long").alias("class"))


_NC = f"""with {THREADS}, {NODES},
 nc as (select node_id node, cast(case when node_id in (select node_id from repeat_nodes) then 0 when length(seq) < 200 then 1 when length(seq) < 300 then 2 else 3 end as bigint) class from nd)"""
_PQ = """pq0 as (select thread_id, class, i - lag(i, {p1}) over (partition by thread_id, class order by i) span from (select thread_id, abs(th.node) node, row_number() over (partition by thread_id order by idx) - 1 i from th) t join nc using (node) where class <> 0),
 pq as (select distinct thread_id, class from pq0 where span < {q})"""
_TC = """tn as (select thread_id, coalesce(class, 0) class, count(*) n from (select thread_id, abs(node) node from th) t left join nc using (node) group by all),
 hf as (select thread_id, sum(n) al, max(n) filter (class <> 0) bn, arg_max(class, n * 10 - class) filter (class <> 0) bc from tn group by thread_id),
 rn as (select thread_id, count(*) k, min(class) o from pq group by thread_id),
 tc as (select thread_id, cast(coalesce(case when 2 * bn > al then bc when k = 1 then o else 0 end, 0) as bigint) class from hf left join rn using (thread_id))"""


@query(f"{_NC}, {_PQ.format(p1=2, q=5)} select thread_id, class from pq")
def p_in_q(spark, d):
    return P.p_in_q(threads(spark, d), _size_class(spark, d), 3, 5)


@query(f"{_NC}, {_PQ.format(p1=2, q=5)}, {_TC} select thread_id, class from tc")
def thread_classes(spark, d):
    return P.thread_classes(threads(spark, d), _size_class(spark, d), 3, 5)


@query(f"{_NC}, {_PQ.format(p1=2, q=5)} select thread_id, min(class) class_a, max(class) class_b from pq group by thread_id having count(*) = 2")
def class_bridges(spark, d):
    return P.class_bridges(threads(spark, d), _size_class(spark, d), 3, 5)


@query(f"""{_NC}, {_PQ.format(p1=2, q=5)}, {_TC}, nt as (select distinct abs(node) node, thread_id from th),
 v as (select node, class, count(*) v from nt join tc using (thread_id) where class <> 0 group by all),
 b as (select * from v qualify row_number() over (partition by node order by v desc, class) = 1),
 n as (select node, count(*) n from nt group by node)
 select node, cast(case when b.v >= 2 and b.v >= 0.6 * n then b.class else 0 end as bigint) class from n left join b using (node)""")
def node_classes(spark, d):
    t = threads(spark, d)
    return P.node_classes(t, P.thread_classes(t, _size_class(spark, d), 3, 5))


@query(f"""{_NC}, {_PQ.format(p1=2, q=5)}, {_TC},
 c as (select thread_id, count(*) places, cast(count(*) filter (coalesce(class, 0) <> 0) as bigint) classified from (select thread_id, abs(node) node from th) t left join nc using (node) group by thread_id)
 select c.* from c join tc using (thread_id) where tc.class = 0 and places >= 3 and classified < ceil(0.9 * places)""")
def unclassified_threads(spark, d):
    t, nc = threads(spark, d), _size_class(spark, d)
    return P.unclassified_threads(t, nc, P.thread_classes(t, nc, 3, 5), 3, 0.9)


def _propagated_sql(rounds: int) -> str:
    """Classes handed on between threads and nodes, ``rounds`` times written out as materialised steps; more than any of the tables needs."""
    steps = [f"{THREADS}", "ut as materialized (select * from th qualify count(*) over (partition by thread_id, abs(node)) = 1)", "up as materialized (select thread_id, abs(node) node, row_number() over (partition by thread_id order by idx) - 1 i from ut)", f"{NODES}", "nt as materialized (select distinct abs(node) node, thread_id from ut)", "nn as materialized (select node, count(*) n from nt group by node)"]
    steps.append("n0 as materialized (select node_id node, cast(case when node_id in (select node_id from repeat_nodes) then 0 when length(seq) >= 300 then 3 else 0 end as bigint) class from nd)")
    for r in range(rounds):
        steps.append(f"q{r} as materialized (select distinct thread_id, class from (select thread_id, class, i - lag(i, 1) over (partition by thread_id, class order by i) span from up join n{r} using (node) where class <> 0) where span < 4)")
        steps.append(f"t{r} as materialized (select thread_id, coalesce(class, 0) class, count(*) n from up left join n{r} using (node) group by all)")
        steps.append(f"c{r} as materialized (select thread_id, coalesce(case when 2 * bn > al then bc when k = 1 then o else 0 end, 0) class from (select thread_id, sum(n) al, max(n) filter (class <> 0) bn, arg_max(class, n * 10 - class) filter (class <> 0) bc from t{r} group by thread_id) left join (select thread_id, count(*) k, min(class) o from q{r} group by thread_id) using (thread_id))")
        steps.append(f"v{r} as materialized (select * from (select node, class, count(*) v from nt join c{r} using (thread_id) where class <> 0 group by all) qualify row_number() over (partition by node order by v desc, class) = 1)")
        steps.append(f"n{r + 1} as materialized (select coalesce(a.node, b.node) node, cast(case when coalesce(a.class, 0) <> 0 then a.class when v >= 2 and v >= 0.6 * n then b.class else 0 end as bigint) class from n{r} a full join (select nn.node, n, v, class from nn left join v{r} using (node)) b on a.node = b.node)")
    return f"with {', '.join(steps)} select node, class from n{rounds}"


@query(_propagated_sql(10))
def partition_propagated(spark, d):
    start = _size_class(spark, d).withColumn("class", F.when(F.col("class") == 3, 3).otherwise(0).cast("long"))
    return P.propagate(persisted(unique_threads(spark, d), "ut"), start, 2, 0.6, 2, 4)


def _cluster_sql(rounds: int) -> str:
    """The cluster grown ``rounds`` times, as materialised steps; more than any of the tables needs."""
    steps = [THREADS, NODES, "tp as materialized (select thread_id, abs(node) node, row_number() over (partition by thread_id order by idx) - 1 i from th)", "nt as materialized (select distinct node, thread_id from tp)", "nn as materialized (select node, count(*) n from nt group by node)", "c0 as materialized (select node_id node from nd where length(seq) >= 300)"]
    for r in range(rounds):
        steps.append(f"h{r} as materialized (select distinct thread_id from (select thread_id, i - lag(i, 2) over (partition by thread_id order by i) span from tp where node in (select node from c{r})) where span < 5)")
        steps.append(f"c{r + 1} as materialized (select node from c{r} union select node from (select node, count(*) v from nt where thread_id in (select thread_id from h{r}) group by node) join nn using (node) where v >= 2 and v >= 0.6 * n)")
    return f"with {', '.join(steps)} select node from c{rounds}"


@query(_cluster_sql(12))
def cluster_grown(spark, d):
    start = nodes(spark, d).where(F.length("seq") >= 300).select(F.col("node_id").alias("node"))
    return P.grow_cluster(persisted(threads(spark, d), "th"), start)


def _coords(spark, d):
    """One order per thread, of the nodes it holds once."""
    return unique_threads(spark, d).select(F.col("thread_id").alias("order_id"), "node", F.col("start_pos").cast("long").alias("coord"))


_CO = f"with {THREADS}, ut as (select * from th qualify count(*) over (partition by thread_id, abs(node)) = 1), co as (select thread_id order_id, node, cast(start_pos as bigint) coord from ut)"


@query(f"{_CO} select order_id, abs(node) node, coord, cast(row_number() over (partition by order_id order by coord, abs(node)) * sign(node) as bigint) pos from co")
def order_rank(spark, d):
    return P.local_order(_coords(spark, d))


@query(f"""{_CO},
 n as (select thread_id, count(*) n from ut group by 1),
 h as (select order_id, thread_id, count(*) placed from ut join (select distinct order_id, abs(node) k from co) c on abs(ut.node) = k group by all)
 select order_id, thread_id, placed, round(placed / n, 6) happiness from h join n using (thread_id)""")
def thread_happiness(spark, d):
    t = unique_threads(spark, d)
    return P.happiness(t, _coords(spark, d)).withColumn("happiness", F.round("happiness", 6))


@query(f"""{_CO}, s as (select c.order_id, ut.thread_id, c.coord kc, case when ut.node = c.node then start_pos else end_pos end ks, case when ut.node = c.node then 1 else -1 end turn from ut join co c on abs(ut.node) = abs(c.node)),
 o as (select order_id, turn * ut.node node, case when turn = 1 then kc + start_pos - ks else kc + ks - end_pos end coord from s join ut using (thread_id)),
 f as (select * from o where not exists (select 1 from co where co.order_id = o.order_id and abs(co.node) = abs(o.node))), g as (select order_id, node, list_sort(list(coord)) l from f group by all)
 select order_id, node, cast(l[len(l) // 2 + 1] as bigint) coord, len(l) links from g where len(l) >= 2""")
def nodes_placed(spark, d):
    return P.place_nodes(unique_threads(spark, d), _coords(spark, d), 2)


@query(f"""{_CO},
 n as (select distinct order_id, abs(node) n from co),
 z as (select order_id, count(*) z from n group by 1),
 j as (select a.order_id a, b.order_id b, count(*) shared from n a join n b using (n) where a.order_id < b.order_id group by all having count(*) >= 2)
 select a, b, shared, round(shared / least(x.z, y.z), 6) share from j join z x on x.order_id = a join z y on y.order_id = b""")
def shared_order_nodes(spark, d):
    return P.shared_order_nodes(_coords(spark, d), 2).withColumn("share", F.round("share", 6))


@query()
def orders_grown(spark, d):
    """Every thread's order, grown over threads most of whose nodes it holds."""
    t = persisted(unique_threads(spark, d), "ut")
    return P.grow_orders(t, _coords(spark, d), 2, 0.6)


@query()
def orders_merged(spark, d):
    t = persisted(unique_threads(spark, d), "ut")
    return P.merge_orders(t, _coords(spark, d), links(spark, d), more_than=4, whole=0.9, window=12)


@query(f"""{_CO}, lk0 as (select -node source, nx dest from (select node, lead(node) over (partition by thread_id order by idx) nx from th) where nx is not null), st as (select distinct -source node, dest nx from lk0 union select distinct -dest, source from lk0),
 o as (select order_id, node, row_number() over w pl, count(*) over (partition by order_id) n, lead(node) over w nx from co window w as (partition by order_id order by coord, abs(node))),
 j as (select o.order_id, o.pl, st.node is null fails from o left join st on st.node = o.node and st.nx = o.nx where o.pl <= o.n - 2),
 k as (select *, sum(case when fails then 1 else 0 end) over w f, count(*) over w c from j window w as (partition by order_id order by pl rows between current row and 5 following)) select distinct order_id from k where fails and c = 6 and f >= 1.2""")
def mixed_orders(spark, d):
    return P.mixed_orders(_coords(spark, d), links(spark, d), 6, 0.2, tail=2)


def _classes(spark, d):
    t = threads(spark, d)
    nc = _size_class(spark, d)
    return t, nc, P.thread_classes(t, nc, 3, 5)


@query(f"{_NC}, ch as (select node from nc where class = 2), sw as (select node from nc where node in (select node from ch)) select distinct thread_id from th where abs(node) in (select node from sw)")
def threads_to_evaluate(spark, d):
    """Threads to be classified again when the nodes of class 2 get class 5."""
    t, nc, _ = _classes(spark, d)
    _, changed = P.switch_classes(nc, nc.where("class = 2").select("node", F.lit(5).cast("long").alias("class")), "node")
    return P.to_evaluate(t, changed)


@query(f"""{_NC}, t0 as (select thread_id, row_number() over (partition by thread_id order by idx) - 1 i, node, count(*) over (partition by thread_id) n from th), od as (select distinct sign(node) * thread_id tid, abs(node) node from th),
 sd as (select cast(sign(tid) as bigint) * node node, abs(tid) other from od union all select cast(-sign(tid) as bigint) * node, -abs(tid) from od),
 mt as (select t0.thread_id, i, other, row_number() over (partition by t0.thread_id, other order by i) - 1 b from t0 join sd using (node) where other <> t0.thread_id), gd as (select thread_id, i, count(*) filter (b >= 2) g from mt group by all),
 la as (select t0.thread_id, t0.i, coalesce(g, 0) < 2 u from t0 left join gd using (thread_id, i) where t0.i > n // 2), fl as (select thread_id from (select *, u and lag(u) over (partition by thread_id order by i) two from la) where two)
 select distinct thread_id from th where thread_id not in (select thread_id from fl)""")
def supported_threads(spark, d):
    t = threads(spark, d)
    return P.supported_threads(t, t.select("thread_id").distinct(), 2)


@query(f"{_NC}, fr as (select min(thread_id) t from th) select node, cast(case when class = 0 and node in (select abs(node) from th, fr where thread_id = t) then 4 else class end as bigint) class from nc")
def class_from_thread(spark, d):
    t, nc, _ = _classes(spark, d)
    first = t.agg(F.min("thread_id")).first()[0]
    return P.new_class_from_thread(t, nc, P.new_partition(t)[1], first)[0]


@query()
def order_from_class(spark, d):
    t, nc, tc = _classes(spark, d)
    return P.order_from_class(t, nc, persisted(tc, "tc"), 3, 7)


def _votes(spark, d):
    w = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    s = paths(spark, d).where("size(path) > 1").select(F.explode(w).alias("s")).select("s.a", "s.b").where("a <> 0 and b <> 0")
    both = s.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct((-F.col("b")).alias("node"), (-F.col("a")).alias("other")))).alias("s")).select("s.*")
    return both.groupBy("node", "other").agg(F.count("*").alias("votes"))


_WIN = f"""with recursive {PATHS}, {_VOTES},
 wt as (select node, sum(votes) t from vt group by node),
 wn as (select node, other from vt join wt using (node) where t >= 2 and votes >= 0.75 * t qualify row_number() over (partition by node order by votes desc, other) = 1)"""


@query(f"{_WIN} select node, other from wn")
def stride_votes(spark, d):
    return P.next_winners(_votes(spark, d))


@query(f"""{_WIN},
 w as (select node, [node] p, 0 i from wn union all select w.node, list_append(p, wn.other), i + 1 from w join wn on wn.node = p[-1] where i < 6 and not list_contains(p, wn.other))
 select node, array_to_string(p[2:], ',') path from w qualify row_number() over (partition by node order by i desc) = 1""")
def strides(spark, d):
    w = persisted(P.next_winners(_votes(spark, d)), "winners")
    return P.stride(w, w.select("node"), 6).select("node", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


_TRI = """tr0 as (select unnest(path[:-3]) a, unnest(path[2:-2]) m, unnest(path[3:]) b from ph where len(path) > 2),
 tr as (select abs(m) node, case when m > 0 then a else -b end prev, case when m > 0 then b else -a end nxt, count(*) votes from tr0 where a <> 0 and m <> 0 and b <> 0 group by all)"""


@query(f"with {PATHS}, {_TRI} select node, prev, nxt as next, votes from tr")
def repeat_votes(spark, d):
    return C.path_triples(paths(spark, d))


@query(f"with {PATHS}, {_TRI} select node, prev, nxt as next, votes, cast(rn as integer) rank from (select *, row_number() over (partition by node order by votes desc, prev, nxt) rn from tr) where rn <= 3")
def through_ranking(spark, d):
    return C.through_ranking(C.path_triples(paths(spark, d)))


_SOLVE = """vr as (select tr.*, rp.degree from tr join rp on rp.node_id = tr.node), bp as (select * from vr qualify row_number() over (partition by node, prev order by votes desc, nxt) = 1), bn as (select * from vr qualify row_number() over (partition by node, nxt order by votes desc, prev) = 1),
 pq as (select bp.* from bp join bn using (node, prev, nxt)),
 gs as (select vr.node, any_value(vr.degree) degree, count(pq.node) k, min(pq.votes) low, coalesce(max(vr.votes) filter (pq.node is null), 0) rest from vr left join pq on pq.node = vr.node and pq.prev = vr.prev and pq.nxt = vr.nxt group by vr.node)"""


@query(f"{TH}, {_REP.format(m=6)}, {PATHS}, {_TRI}, {_SOLVE} select node, prev, nxt as next, votes from pq where node in (select node from gs where k = degree and low >= 2 and rest <= least(3, ceil(low / 5.0)))")
def repeats_solved(spark, d):
    reps = canonical_repeats(nodes(spark, d), _thin(spark, d), 6)
    return C.solve_repeats(C.path_triples(paths(spark, d)), reps, 2, 3, 5.0)


_SIDES = "sd as (select r.node_id node, 'next' side, nx other from st join rp r on st.node = r.node_id union all select r.node_id, 'prev', -nx from st join rp r on st.node = -r.node_id)"
_PV = """on0 as (select store, (read_id + 1) // 2 pair, n, count(*) c from (select distinct store, read_id, abs(unnest(path)) n from ph) where n <> 0 group by all),
 pv as (select a.node, a.other prev, b.other nxt, cast(sum(x.c * y.c) as bigint) votes from sd a join sd b on a.node = b.node and a.side = 'prev' and b.side = 'next' and a.other <> b.other join on0 x on x.n = abs(a.other) join on0 y on y.n = abs(b.other) and y.store = x.store and y.pair = x.pair group by all)"""
_CLEAR = """pi as (select node, prev, count(*) c, max(votes) best, coalesce(max(votes) filter (rn = 2), 0) sec, max(nxt) filter (rn = 1) nxt from (select *, row_number() over (partition by node, prev order by votes desc, nxt) rn from pv) group by all),
 po as (select node, nxt, max(votes) best, coalesce(max(votes) filter (rn = 2), 0) sec from (select *, row_number() over (partition by node, nxt order by votes desc, prev) rn from pv) group by all),
 oi as (select pi.node from pi join rp on rp.node_id = pi.node group by pi.node having bool_and(best >= {s} and sec <= {n} and sec * {r} <= best) and count(*) = any_value(degree)),
 oo as (select po.node from po join rp on rp.node_id = po.node group by po.node having bool_and(best >= {s} and sec <= {n} and sec * {r} <= best) and count(*) = any_value(degree))"""


@query(f"{TH}, {_REP.format(m=6)}, {PATHS}, {_SIDES}, {_PV} select node, prev, nxt as next, votes from pv")
def paired_repeat_votes(spark, d):
    k = _thin(spark, d)
    return C.paired_votes(k, canonical_repeats(nodes(spark, d), k, 6), paths(spark, d))


@query(f"{TH}, {_REP.format(m=6)}, {PATHS}, {_SIDES}, {_PV}, {_CLEAR.format(s=1, n=30, r=1)} select node, prev, nxt as next, best votes from pi where node in (select node from oi) and node in (select node from oo)")
def repeats_solved_by_pairs(spark, d):
    k = _thin(spark, d)
    reps = persisted(canonical_repeats(nodes(spark, d), k, 6), "repeats")
    return C.clear_ways(C.paired_votes(k, reps, paths(spark, d)), reps, 1, 30, 1.0)


_TV = """tw as (select thread_id, idx, node, lead(node) over w a1, lead(node, 2) over w a2, lag(node) over w b1, lag(node, 2) over w b2 from th window w as (partition by thread_id order by idx)),
 tu as (select thread_id, idx, node prev, a1 x1, a2 x2 from tw where a1 is not null union all select thread_id, idx, -node, -b1, -b2 from tw where b1 is not null),
 tf as (select * from tu qualify row_number() over (partition by thread_id, prev order by idx) = 1), ta as (select s.node, s.other prev, case when x1 = s.node then x2 else x1 end t from sd s join tf on tf.prev = s.other where side = 'prev')"""


@query(f"""{TH}, {_REP.format(m=2)}, {_SIDES}, {_TV}, tn as (select ta.node, prev, coalesce(k.other, 0) nxt, count(*) votes from ta left join sd k on k.side = 'next' and k.node = ta.node and k.other = ta.t group by all),
 tb as (select *, sum(votes) over (partition by node, prev) al from tn qualify row_number() over (partition by node, prev order by votes desc, nxt desc) = 1), tc as (select node, prev, nxt, votes from tb where nxt <> 0 and votes > 0 and votes / 1.0 >= al - votes)
 select node, prev, nxt as next, votes from tc where node in (select node from tc group by node having count(*) = 2 and count(distinct nxt) = 2)""")
def repeats_solved_by_threads(spark, d):
    t, k = nodes(spark, d), _thin(spark, d)
    kcis = t.select("node_id", F.lit(1.0).alias("kci"))
    return C.solve_repeats_by_threads(k, canonical_repeats(t, k, 2), threads(spark, d), kcis, 1.5, 0, 1.0)


@query(f"{TH}, {_REP.format(m=6)}, {_SIDES}, {_TV} select ta.node, prev, coalesce(k.other, 0) as next, count(*) votes from ta left join sd k on k.side = 'next' and k.node = ta.node and k.other = ta.t group by all")
def thread_repeat_votes(spark, d):
    k = _thin(spark, d)
    return C.thread_votes(k, canonical_repeats(nodes(spark, d), k, 6), threads(spark, d))


_NPC = "pc as (select n node_id, count(*) reads from (select distinct store, read_id, abs(unnest(path)) n from ph) where n <> 0 group by n)"


@query(f"with {PATHS}, {_NPC} select node_id, reads from pc")
def node_path_counts(spark, d):
    return C.node_path_counts(paths(spark, d))


@query(f"""{TH}, {PATHS}, {_NPC}, {_PAR}, {_BUB}
 select bb.node_id from bb join nd using (node_id) left join pc a on a.node_id = bb.node_id left join pc b on b.node_id = abs(bb.parallel) where length(seq) <= 400 and coalesce(a.reads, 0) <= 60 and coalesce(b.reads, 0) >= 4 and coalesce(b.reads, 0) >= 1.1 * coalesce(a.reads, 0)""")
def bubbles_to_pop(spark, d):
    return C.bubbles_to_pop(Graph(nodes(spark, d), _thin(spark, d)), paths(spark, d), 400, 4, 60, 1.1)


@query(f"""{TH}, {PATHS}, {_VOTES}, {_TIPS},
 x as (select node_id, coalesce(opv, -onx) node, case when opv is not null then node_id else -node_id end aye from tp join dg using (node_id) join nd using (node_id) where length(seq) <= 1000),
 g as (select node_id, coalesce(sum(votes) filter (other = aye), 0) ayes, coalesce(sum(votes) filter (other <> aye), 0) nays from x join vt using (node) group by node_id)
 select node_id from g where ayes <= 3 and ayes * 2 <= nays and nays >= 2""")
def tips_to_clip(spark, d):
    return C.tips_to_clip(Graph(nodes(spark, d), _thin(spark, d)), _votes(spark, d), 1000, 2, 3, 2)


@query(f"""{_BOTH},
 t as (select node_id, g.n g, coalesce(ri.n, 0) r from nk join nd using (node_id) join g using (kmer) left join ri using (kmer) where length(nd.seq) <= 300)
 select node_id from t group by node_id having max(r) <= 2 or max(r) filter (g = 1) <= 2""")
def low_coverage_nodes(spark, d):
    t = nodes(spark, d)
    return C.low_coverage_nodes(t, K.count_kmers(t, 31), K.count_kmers(reads(spark, d), 31), 300, 2, 31)


@query(f"with recursive {_THIN}{_DEG} select node_id from dg join nd using (node_id) where fn + bn = 0 and length(seq) < 300")
def small_unconnected(spark, d):
    return C.small_unconnected(Graph(nodes(spark, d), _thin(spark, d)), 300)


@query(f"""{TH},
 ed as (select abs(source) a, abs(dest) b from tm),
 cc as (select node_id a, node_id root from nd union select ed.b, cc.root from cc join ed on ed.a = cc.a),
 c as (select a node_id, min(root) c from cc group by a),
 z as (select c, count(*) n, max(length(seq)) t, sum(length(seq)) s from c join nd using (node_id) group by c)
 select node_id from c where c in (select c from z where n < 2 or t < 300 or s < 600)""")
def small_components(spark, d):
    return C.small_components(Graph(nodes(spark, d), _thin(spark, d)), 2, 300, 600)


_FREE = "fe as (select node from (select node_id node from nd union all select -node_id from nd) where node not in (select node from st))"


@query(f"""{TH}, {PATHS}, {_FREE}, e0 as (select store, (read_id + 1) // 2 pair, 0 half, unnest(range(len(path))) place, unnest(path) node from ph where read_id % 2 = 1 union all select store, (read_id + 1) // 2, 1, unnest(range(len(path))), unnest(list_transform(list_reverse(path), lambda x: -x)) from ph where read_id % 2 = 0),
 oi as (select store, pair, 'o' kind, node, half * 1000000 + place wh from e0 where node <> 0 and node in (select node from fe) union all select store, pair, 'i', node, half * 1000000 + place from e0 where node <> 0 and -node in (select node from fe)),
 g as (select store, pair, min(node) filter (kind = 'o') ol, max(node) filter (kind = 'o') oh, min(wh) filter (kind = 'o') oa, min(node) filter (kind = 'i') il, max(node) filter (kind = 'i') ih, min(wh) filter (kind = 'i') ia from oi group by all)
 select ol a, il b, count(*) pairs from g where ol = oh and il = ih and oa <= ia group by all having count(*) >= 2""")
def tip_connections(spark, d):
    return C.tip_connections(Graph(nodes(spark, d), _thin(spark, d)), paths(spark, d), 2)


@query(f"""{TH}, {PATHS}, {_FREE}, pf as (select fe.node, case when list_position(path, fe.node) > 0 then path[list_position(path, fe.node) + 1:] else (list_transform(list_reverse(path), lambda x: -x))[list_position(list_transform(list_reverse(path), lambda x: -x), fe.node) + 1:] end p from ph join fe on list_position(path, fe.node) > 0 or list_position(path, -fe.node) > 0),
 vt0 as (select node, (list_filter(p, lambda x: x <> 0))[1] other from pf),
 ed0 as (select node a, -other b from vt0 where other is not null group by all having count(*) > 1),
 ed as (select a, b from ed0 union select b, a from ed0),
 cc as (select a id, a root from ed union select ed.b, cc.root from cc join ed on ed.a = cc.id) select min(root) grp, id node from cc group by id""")
def reconnection_groups(spark, d):
    return C.reconnection_groups(Graph(nodes(spark, d), _thin(spark, d)), paths(spark, d), 1)


@query(f"""with {NODES}, bo as (select node_id, seq from nd where length(seq) >= 15 union all select -node_id, reverse(translate(seq, 'ACGT', 'TGCA')) from nd where length(seq) >= 15),
 t as (select node_id, right(seq, 126) tl, unnest(range(15, cast(least(126, length(seq)) as bigint) + 1)) o from bo),
 tl as (select -node_id source, right(tl, o) tl, left(right(tl, o), 15) k, o from t)
 select source, b.node_id dest, cast(max(o) as integer) overlap from tl join bo b on tl.k = left(b.seq, 15) where abs(source) <> abs(b.node_id) and source < b.node_id and left(b.seq, o) = tl.tl group by 1, 2""")
def exact_end_overlaps(spark, d):
    return C.exact_end_overlaps(nodes(spark, d))


_EEO = """bq as (select node_id, seq from nd where length(seq) >= 15 union all select -node_id, reverse(translate(seq, 'ACGT', 'TGCA')) from nd where length(seq) >= 15),
 tq as (select node_id, right(seq, 126) tl, unnest(range(15, cast(least(126, length(seq)) as bigint) + 1)) o from bq),
 ts as (select -node_id source, right(tl, o) tl, left(right(tl, o), 15) k, o from tq),
 ee as (select distinct source, b.node_id dest from ts join bq b on ts.k = left(b.seq, 15) where abs(source) <> abs(b.node_id) and source < b.node_id and left(b.seq, o) = ts.tl)"""


@query(f"""{TH}, {_FREE}, {_EEO}, gp as (select cast(source as varchar) || ',' || cast(dest as varchar) grp, least(-source, -dest) a, greatest(-source, -dest) b from ee), g2 as (select gp.* from gp join fe x on x.node = a join fe y on y.node = b),
 lo as (select distinct grp from (select grp, row_number() over (partition by n order by grp) rn from (select grp, unnest([abs(a), abs(b)]) n from g2)) where rn > 1),
 jo as (select a, b, case when a < 0 then reverse(translate(x.seq, 'ACGT', 'TGCA')) else x.seq end s1, case when b > 0 then reverse(translate(y.seq, 'ACGT', 'TGCA')) else y.seq end s2 from g2 join nd x on x.node_id = abs(a) join nd y on y.node_id = abs(b) where grp not in (select grp from lo)),
 sz as (select a, b, min(o) overlap from (select *, unnest(range(15, 127)) o from jo) where o <= length(s1) and o <= length(s2) and right(s1, o) = left(s2, o) group by a, b)
 select a, b, cast(overlap as integer) overlap, row_number() over (order by a, b) + (select max(node_id) from nd) new_id from sz""")
def ends_patched(spark, d):
    g = Graph(nodes(spark, d), _thin(spark, d))
    o = persisted(C.exact_end_overlaps(g.nodes).select(F.col("source").alias("a"), F.col("dest").alias("b")), "overlaps")
    groups = o.select(F.concat_ws(",", "a", "b").alias("grp"), F.explode(F.array(-F.col("a"), -F.col("b"))).alias("node"))
    return C.patch_groups(g, groups)[1]


_EXT = f"""{_PAR}, pk as (select node, count(*) c from pr group by node), ap as (select f.node, f.nx fwn from en f join en b on b.node = -f.node and b.n >= 2 join nd on nd.node_id = abs(f.node) where f.n = 1 and length(nd.seq) <= 400),
 aw as (select ap.node, -st.nx prev, fwn from ap join st on st.node = -ap.node), ab as (select aw.node from aw join en on en.node = aw.prev left join pk on pk.node = aw.prev where en.n > 1 or coalesce(pk.c, 0) > 1)"""


@query(f"{TH}, {_EXT} select node, prev, fwn as next from aw where node not in (select node from ab)")
def ways_to_repeats(spark, d):
    return C.ways_to_repeats(Graph(nodes(spark, d), _thin(spark, d)), 400)


@query()
def extended_to_repeats(spark, d):
    g = C.extend_to_repeats(Graph(nodes(spark, d), _thin(spark, d)), 400)
    return g.nodes.select("node_id", F.length("seq").alias("size"))


_AR = f"""{_BOTH}, kc as (select node_id, pos, g.n g, coalesce(ri.n, 0) n from nk join g using (kmer) left join ri using (kmer)),
 aw as (select *, case when lag(pos) over w = pos - 1 then lag(g) over w end g0, case when lag(pos) over w = pos - 1 then lag(n) over w end n0, case when lead(pos) over w = pos + 1 then lead(g) over w end g1, case when lead(pos) over w = pos + 1 then lead(n) over w end n1 from kc window w as (partition by node_id order by pos)),
 ai as (select *, pos - row_number() over (partition by node_id order by pos) isl from aw where g = 1 and n between 2 and 40),
 ag as (select node_id, isl, min(pos) f, max(pos) l, count(*) k, arg_min(g0 is null or (g0 <> 1 and n0 * 10 >= n * 15), pos) a, arg_max(g1 is null or (g1 <> 1 and n1 * 10 >= n * 15), pos) b from ai group by node_id, isl), ar as (select node_id, f, l, k from ag where a and b)"""


def _anchor_runs(spark, d):
    t = nodes(spark, d)
    graph, counted = K.count_kmers(t, 31), K.count_kmers(reads(spark, d), 31)
    at = kmers(t, 31, ["node_id"]).join(graph.select("code", F.col("n").alias("g")), "code").join(counted, "code", "left").na.fill(0, ["n"]).select("node_id", "pos", "g", "n")
    return C.anchor_runs(at, 2, 40)


@query(f'{_AR} select node_id, f as "first", l as "last", k kmers from ar')
def anchor_runs(spark, d):
    return _anchor_runs(spark, d)


@query(f"""{_AR}, an as (select node_id, f, substr(seq, f + 1, l - f + 31) s, row_number() over (order by node_id, f) r from ar join nd using (node_id)), ac as (select node_id, f, length(s) z, case when s <= reverse(translate(s, 'ACGT', 'TGCA')) then r else -r end a from an)
 select -lag(a) over w source, a dest, cast(f - lag(f) over w - lag(z) over w as integer) dist from ac window w as (partition by node_id order by f) qualify lag(a) over w is not null""")
def anchor_links(spark, d):
    return C.anchor_graph(nodes(spark, d), _anchor_runs(spark, d), 31)[0].links


_DBG = """km as (select kmer, row_number() over (order by kmer) node_id from (select distinct kmer from {kmers})), bo as (select node_id node, kmer s from km union all select -node_id, reverse(translate(kmer, 'ACGT', 'TGCA')) from km),
 tm as (select -a.node source, b.node dest, -30 dist from bo a join bo b on substr(a.s, 2) = left(b.s, 30)),
 st as (select distinct -source node, dest nx from tm),
 en as (select node, count(*) n, min(nx) nx from st group by node),
 ev as (select node from bo),
 nd as (select node_id, kmer seq from km)"""
_UNITIGS = f"{_STEP}, {_LINES.format(sp='sp', ev='ev')}, {_SPELT.format(links='tm')} select md5(least(seq, reverse(translate(seq, 'ACGT', 'TGCA')))) digest, length(seq) size from ls"


@query(f"with recursive nd0 as (select node_id, upper(seq) seq from (select * from nodes union all select * from repeat_nodes) where status = 'Active'), {kmers_sql('nk', 'nd0', 'node_id', 31)}, {_DBG.format(kmers='nk')}, {_UNITIGS}")
def dbg_unitigs(spark, d):
    g = C.de_bruijn(K.counts_from(nodes(spark, d), 31).select("code"), 31)
    return g.nodes.select(C.canonical_digest(F.col("seq")).alias("digest"), F.length("seq").alias("size"))


@query()
def tips_clipped(spark, d):
    g = C.clip_tips(Graph(nodes(spark, d), _thin(spark, d)), 250)
    return g.nodes.select("node_id", F.length("seq").alias("size"))


@query(f"with recursive {READS}, {kmers_sql('rk', 'rd', 'read_id', 31)}, r2 as (select kmer from rk group by kmer having count(*) >= 2), {_DBG.format(kmers='r2')}, {_UNITIGS}")
def dbg_unitigs_of_reads(spark, d):
    """The graph of the k-mers that reads hold twice or more."""
    g = C.de_bruijn(K.counts_from(reads(spark, d), 31, 2).select("code"), 31)
    return g.nodes.select(C.canonical_digest(F.col("seq")).alias("digest"), F.length("seq").alias("size"))


def _edit_ways(spark, d):
    """One queued expansion per node that passages cross in two ways or more, in order of the node."""
    t = C.path_triples(paths(spark, d)).where("votes >= 2")
    return t.select(F.col("node").alias("op_id"), "node", "prev", "next")


@query(f"""with recursive {PATHS}, {_TRI}, iv as (select node op, unnest([node, -node, -prev, nxt]) item from tr where votes >= 2), io as (select op, list(distinct item) items, row_number() over (order by op) rn from iv group by op),
 wk as (select cast(0 as bigint) i, cast([] as bigint[]) taken, cast(null as bigint) op, false ok union all select wk.i + 1, case when list_has_any(io.items, taken) then taken else list_concat(taken, io.items) end, io.op, not list_has_any(io.items, taken) from wk join io on io.rn = wk.i + 1) select op op_id from wk where ok""")
def edits_accepted(spark, d):
    return C.accepted_edits(C.expansion_items(persisted(_edit_ways(spark, d), "ways")))


@query()
def edits_applied(spark, d):
    k = _thin(spark, d)
    g = Graph(nodes(spark, d), k)
    ways = persisted(_edit_ways(spark, d), "ways")
    gone_nodes = nodes(spark, d).where(F.length("seq") < 60).select((-F.col("node_id")).alias("op_id"), "node_id")
    gone_links = k.where("dist < -100").select((-F.xxhash64("source", "dest").bitwiseAND(F.lit((1 << 40) - 1)) - (1 << 41)).alias("op_id"), "source", "dest")
    link_items = gone_links.select("op_id", F.lit("link_deletion").alias("kind"), F.explode(F.array("source", "dest")).alias("item"))
    ops = C.expansion_items(ways).unionByName(C.deletion_items(gone_nodes, k)).unionByName(link_items)
    out = C.apply_edits(g, ways, gone_links, gone_nodes, persisted(C.accepted_edits(ops), "accepted"))
    return out.nodes.select("node_id", F.length("seq").alias("size"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

"""Queries on the distance graph, and their SQL.

The graph's links join consecutive nodes of read threads; the thinned graph keeps pairs linked by at least two threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import graph as G
from strandloom.operators import traversal as T
from strandloom.operators.threads import thread_links
from strandloom.plans.views import NODES, READS, THREADS, kmers_sql, nodes, threads
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


def links(spark: SparkSession, d: str) -> DataFrame:
    """All thread links (parallel ones stay): (source, dest, dist)."""
    return thread_links(threads(spark, d)).select("source", "dest", "dist")


def thin_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ends linked at least twice, once each with their smallest distance; a hot node counts by its pairs, as its links are aggregated first."""
    m = G.link_summary(links(spark, d)).where("link_count >= 2 and source <= dest and abs(source) <> abs(dest)")
    return m.select("source", "dest", F.col("min_dist").alias("dist"))


def _thin(spark: SparkSession, d: str) -> DataFrame:
    return persisted(thin_links(spark, d), "thin")


_LINKS = f"""{THREADS}, lk as (select -node source, nx dest, cast(ns - end_pos as integer) dist from (select *, lead(node) over w nx, lead(start_pos) over w ns from th window w as (partition by thread_id order by idx)) where nx is not null),
 mi as (select source, dest, dist from lk union all select dest, source, dist from lk where source <> dest)"""
L = f"with recursive {_LINKS}"
_THIN = f"""{_LINKS},
 tl as (select source, dest, min(dist) dist from mi group by source, dest having count(*) >= 2 and source <= dest and abs(source) <> abs(dest)),
 tm as (select source, dest, dist from tl union all select dest, source, dist from tl where source <> dest),
 st as (select distinct -source node, dest nx from tm),
 en as (select node, count(*) n, min(nx) nx from st group by node), {NODES}"""
_DEG = ", dg as (select node_id, coalesce(f.n, 0) fn, coalesce(b.n, 0) bn, case when f.n = 1 then f.nx end onx, case when b.n = 1 then -b.nx end opv from nd left join en f on f.node = node_id left join en b on b.node = -node_id)"
TH = f"with recursive {_THIN}{_DEG}"


@query(f"{L} select source, dest, dist from mi")
def links_mirrored(spark, d):
    return G.mirrored(links(spark, d))


@query(f"{L}, s as (select * from mi where not (source > 0 and dest < 0 and dist > 2000)) select * from s where not exists (select 1 from s m where m.source = s.dest and m.dest = s.source)")
def is_sane_violations(spark, d):
    return G.is_sane(G.mirrored(links(spark, d)).where("not (source > 0 and dest < 0 and dist > 2000)"))


@query(f"{L} select source, dest, count(*) link_count, min(dist) min_dist from mi group by source, dest")
def link_count_and_min_distance(spark, d):
    return G.link_summary(links(spark, d))


@query(f"{L} select -source node, dest next_node, dist from mi")
def next_nodes(spark, d):
    return G.next_nodes(links(spark, d))


@query(f"{L}, {NODES}, sm as (select node_id from nd where length(seq) < 120) select source, dest, dist from lk where abs(source) not in (select node_id from sm) and abs(dest) not in (select node_id from sm)")
def nodes_removed(spark, d):
    g = G.Graph(nodes(spark, d), links(spark, d))
    return g.remove_nodes(nodes(spark, d).where("length(seq) < 120")).links


@query(f"{L}, g as (select distinct source, dest from mi where dist < 0) select source, dest, dist from lk where not exists (select 1 from g where g.source = lk.source and g.dest = lk.dest)")
def links_removed(spark, d):
    t = links(spark, d)
    return G.Graph(nodes(spark, d), t).remove_links(t.where("dist < 0")).links


@query(f"{L}, g as (select distinct source, dest, dist from mi where dist < 0) select source, dest, dist from lk where not exists (select 1 from g where g.source = lk.source and g.dest = lk.dest and g.dist = lk.dist)")
def exact_links_removed(spark, d):
    t = links(spark, d)
    return G.Graph(nodes(spark, d), t).remove_links(t.where("dist < 0"), exact=True).links


@query(f"{L} select source, dest, cast(count(*) as bigint) n from (select source, dest from lk union all select source, dest from lk where dist > 0) group by all")
def links_copied(spark, d):
    t = links(spark, d)
    return G.Graph(nodes(spark, d), t).add_links(t.where("dist > 0")).links.groupBy("source", "dest").agg(F.count("*").alias("n"))


@query(f"""{L},
 s as (select distinct -source node, dest nx from mi),
 a as (select node start, nx node from s),
 b as (select distinct a.start, s.nx node from a join s using (node)),
 c as (select distinct b.start, s.nx node from b join s using (node))
 select start, node from a union select start, node from b union select start, node from c""")
def fw_reached_r3(spark, d):
    t = links(spark, d)
    return G.fw_reached(t, G.next_nodes(t).select("node").distinct(), 3)


@query(f"""{L}, r as (select -source node, dest other, dist, row_number() over (partition by source, dest order by dist) rn, count(*) over (partition by source, dest) n from mi)
 select node, other, cast(trunc(case when any_value(n) % 2 = 1 then max(dist) filter (rn = n // 2 + 1) else (max(dist) filter (rn = n // 2) + max(dist) filter (rn = n // 2 + 1)) / 2.0 end) as integer) dist, any_value(n) link_count from r where n >= 2 group by node, other""")
def fw_neighbours_by_distance(spark, d):
    return G.fw_neighbours_by_distance(links(spark, d), 2)


@query(f"{L} select distinct abs(unnest([source, dest])) node_id from lk")
def connected_nodes(spark, d):
    return G.connected_nodes(links(spark, d))


@query(f"{TH} select node_id, bn prev_count, fn next_count, opv only_prev, onx only_next from dg")
def node_degrees(spark, d):
    return G.degrees(nodes(spark, d), _thin(spark, d))


_TIPS = "tp as (select node_id from (select node_id, coalesce(-onx, opv) t from dg where fn + bn = 1) x join en on en.node = x.t where en.n > 1)"
_PAR = """ns as (select f.node, f.s nexts, list_sort(list_transform(b.s, lambda x: -x)) prevs from (select node, list_sort(list(nx)) s from st group by node) f join (select node, list(nx) s from st group by node) b on b.node = -f.node),
 pr as (select a.node, b.node parallel from ns a join ns b on a.nexts = b.nexts and a.prevs = b.prevs and a.node <> b.node)"""
_BUB = "bb as (select p.node node_id, p.parallel from (select node, count(*) n, min(parallel) parallel from pr where node > 0 group by node having count(*) = 1) p join dg on dg.node_id = p.node and fn = 1 and bn = 1 join en a on a.node = opv and a.n = 2 join en b on b.node = -onx and b.n = 2)"
_REP = "rp as (select node_id, fn degree from dg where fn = bn and fn between 2 and {m} and not exists (select 1 from st where abs(st.node) = node_id and abs(nx) = node_id) and not exists (select 1 from st join en on en.node = -st.nx where st.node in (node_id, -node_id) and en.n > 1) and (select count(distinct abs(nx)) from st where st.node in (node_id, -node_id)) = 2 * fn)"


@query(f"{TH}, {_TIPS} select node_id from tp")
def tips(spark, d):
    return G.tips(nodes(spark, d), _thin(spark, d))


@query(f"{TH}, {_PAR} select node, parallel from pr")
def parallels(spark, d):
    return G.parallels(nodes(spark, d), _thin(spark, d))


@query(f"{TH}, {_PAR}, {_BUB} select node_id, parallel from bb")
def bubbles(spark, d):
    return G.bubble_sides(nodes(spark, d), _thin(spark, d))


@query(f"{TH}, {_REP.format(m=6)} select node_id, degree from rp")
def canonical_repeats(spark, d):
    return G.canonical_repeats(nodes(spark, d), _thin(spark, d), 6)


@query(f"{L}, s as (select distinct abs(source) a, abs(dest) b from mi) select a node_id from s group by a having bool_or(a = b) and bool_or(a <> b)")
def self_loops(spark, d):
    return G.self_loops(nodes(spark, d), links(spark, d))


@query(f"""{TH},
 k as (select case when fn > 1 then 'N' else cast(fn as varchar) end f, case when bn > 1 then 'N' else cast(bn as varchar) end b from dg)
 select least(f, b) || '-' || greatest(f, b) connectivity, count(*) nodes from k group by 1""")
def connectivity_classes(spark, d):
    return G.connectivity(nodes(spark, d), _thin(spark, d))


@query(f"""with {NODES},
 r as (select length(seq) s, sum(length(seq)) over (order by length(seq) desc, node_id) c, sum(length(seq)) over () t from nd)
 select p point, max(s) nsize from r, (select unnest([25, 50, 75]) p) where c >= floor(t * p / 100) group by p""")
def nstats_n50(spark, d):
    return G.nstats(nodes(spark, d).select(F.length("seq").alias("size")))


def _kci(spark, d):
    from strandloom.plans.kmer_queries import kci_upper_median

    return kci_upper_median(spark, d)


_KCI = f"""{kmers_sql('nk', 'nd', 'node_id', 31)}, {READS}, {kmers_sql('rk', 'rd', 'store, read_id', 31)}, g as (select kmer, count(*) n from nk group by kmer), rc0 as (select kmer, least(count(*), 65535) n from rk group by kmer),
 ku as (select node_id, coalesce(rc0.n, 0) n from nk join g using (kmer) left join rc0 using (kmer) where g.n = 1), km as (select node_id, count(*) c, (list_sort(list(n)))[cast(floor(count(*) / 2) as integer) + 1] m from ku group by node_id),
 kk as (select node_id, case when c > 10 then round(m / 8.0, 6) else -1.0 end kci from nd left join km using (node_id))"""


@query(f"""{TH}, {_TIPS}, {_PAR}, {_BUB}, {_REP.format(m=10)}, {_KCI}, z as (select case when kci is null or kci = -1 then 'None' when kci < 0.5 then '<0.5' when kci <= 1.5 then '~1' when kci <= 2.5 then '~2' when kci <= 3.5 then '~3' else '>3.5' end bin, length(seq) size, node_id in (select node_id from tp) t, node_id in (select node_id from rp) r, node_id in (select node_id from bb) b from nd join kk using (node_id))
 select coalesce(bin, 'All') bin, count(*) nodes, cast(sum(size) as bigint) bp, count(*) filter (t) tips, count(*) filter (r) repeats, count(*) filter (b) bubble_sides from z group by rollup(bin)""")
def stats_by_kci(spark, d):
    return G.stats_by_kci(nodes(spark, d), _thin(spark, d), persisted(_kci(spark, d), "kci"))


@query(f"""{TH}, {_TIPS}, {_PAR}, {_BUB}, {_REP.format(m=10)},
 z as (select case when length(seq) < 220 then 's' else 'l' end bin, length(seq) size, node_id in (select node_id from tp) t, node_id in (select node_id from rp) r, node_id in (select node_id from bb) b from nd)
 select coalesce(bin, 'All') bin, count(*) nodes, cast(sum(size) as bigint) bp, count(*) filter (t) tips, count(*) filter (r) repeats, count(*) filter (b) bubble_sides from z group by rollup(bin)""")
def stats_by_size_rollup(spark, d):
    t = nodes(spark, d)
    fake = t.select("node_id", F.when(F.length("seq") < 220, 0.1).otherwise(1.0).alias("kci"))
    out = G.stats_by_kci(t, _thin(spark, d), fake)
    return out.withColumn("bin", F.when(F.col("bin") == "<0.5", "s").when(F.col("bin") == "~1", "l").otherwise(F.col("bin")))


_REACH = "re as (select a.nx s, a.nx n from st a union all select b.node s, b.nx n from st b)"


@query(f"""{TH},
 h2 as (select node s, nx n from st union select a.node, b.nx from st a join st b on b.node = a.nx),
 sb as (select a.node, a.nx b, c.nx c from st a join st c using (node) where a.nx <> c.nx)
 select distinct node, c next_node from sb where exists (select 1 from h2 where s = b and n = c) and not exists (select 1 from h2 where s = c and n = b)""")
def transitive_links(spark, d):
    return G.transitive_links(_thin(spark, d), 2)


@query(f"""{TH},
 ed as (select abs(source) a, abs(dest) b from tm),
 cc as (select node_id a, node_id root from nd where true union select ed.b, cc.root from cc join ed on ed.a = cc.a)
 select a node_id, min(root) component from cc group by a""")
def components(spark, d):
    return T.connected_components(nodes(spark, d), _thin(spark, d))


_STEP = "sp as (select a.node, a.nx from en a join en b on b.node = -a.nx and b.nx = -a.node where a.n = 1 and b.n = 1 and abs(a.node) <> abs(a.nx))"


@query(f"""{TH}, {_STEP},
 ed as (select abs(node) a, abs(nx) b from sp),
 cc as (select node_id a, node_id root from nd union select ed.b, cc.root from cc join ed on ed.a = cc.a),
 g as (select a, min(root) line from cc group by a)
 select line, count(*) node_count, cast(sum(length(seq)) as bigint) total_size from g join nd on nd.node_id = g.a group by line""")
def unitig_lines(spark, d):
    t = nodes(spark, d)
    return T.line_table(T.lines(t, _thin(spark, d)), t)


# chains of the steps in {sp} over the oriented nodes in {ev}: (line, place, node); a closed chain begins with its smallest node
_LINES = """wk as (select node root, node, 0 place from {ev} where node not in (select nx from {sp}) union all select wk.root, s.nx, wk.place + 1 from wk join {sp} s on s.node = wk.node),
 co as (select node from {ev} where node not in (select node from wk)), cy as (select node s, node n from co union select cy.s, p.nx from cy join {sp} p on p.node = cy.n), ch as (select s from cy group by s having s = min(abs(n))),
 w2 as (select s root, s node, 0 place from ch union all select w2.root, p.nx, w2.place + 1 from w2 join {sp} p on p.node = w2.node where p.nx <> w2.root),
 al as (select * from wk union all select * from w2), nm as (select root, arg_min(node, abs(node) * 2 + case when node > 0 then 0 else 1 end) line from al group by root having line > 0),
 ln as (select line, place, node from al join nm using (root))"""
_EV = "ev as (select node_id node from nd union all select -node_id from nd)"
_SPELT = """lp as (select a.line, a.place, case when a.node < 0 then reverse(translate(nd.seq, 'ACGT', 'TGCA')) else nd.seq end seq, coalesce(l.dist, 0) dist from ln a join nd on nd.node_id = abs(a.node) left join ln b on b.line = a.line and b.place = a.place - 1 left join (select source, dest, min(dist) dist from {links} group by all) l on l.source = -b.node and l.dest = a.node),
 ls as (select line, string_agg(repeat('N', greatest(dist, 0)) || substr(seq, greatest(-dist, 0) + 1), '' order by place) seq, count(*) n from lp group by line)"""


@query(f"""{TH}, {_STEP}, {_EV}, {_LINES.format(sp='sp', ev='ev')}, {_SPELT.format(links='tm')},
 cn as (select line, n, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) seq from ls)
 select node_id, length(seq) size, md5(seq) digest from nd where node_id not in (select abs(node) from ln join ls using (line) where n > 1) union all select line, length(seq), md5(seq) from cn where n > 1""")
def unitigs_joined(spark, d):
    g, _ = T.join_unitigs(G.Graph(nodes(spark, d), _thin(spark, d)))
    return g.nodes.select("node_id", F.length("seq").alias("size"), F.md5("seq").alias("digest"))


@query(f"{TH}, {_STEP}, {_EV}, {_LINES.format(sp='sp', ev='ev')}, {_SPELT.format(links='tm')} select line path_id, length(seq) size, md5(seq) digest from ls")
def line_sequences(spark, d):
    t, k = nodes(spark, d), _thin(spark, d)
    return T.path_sequences(T.lines(t, k).select(F.col("line").alias("path_id"), "place", "node"), t, k).select("path_id", F.length("seq").alias("size"), F.md5("seq").alias("digest"))


@query(f"""{TH}, pf as (select s.node f, e.nx t from st s join st e on e.node = s.nx where s.node <> e.nx),
 ld as (select -source node, dest nx, min(dist) dist, any_value(length(seq)) sz from tm join nd on nd.node_id = abs(dest) group by 1, 2),
 pairs as (select distinct f, t from pf where f > 0),
 w as (select f, t, f cur, cast([] as bigint[]) p, cast(0 as bigint) size, false done from pairs
   union all select w.f, w.t, ld.nx, case when ld.nx = w.t then w.p else list_append(w.p, ld.nx) end, w.size + ld.dist + case when ld.nx = w.t then 0 else ld.sz end, ld.nx = w.t
   from w join ld on ld.node = w.cur where not w.done and (ld.nx = w.t or (len(w.p) < 2 and not list_contains(w.p, ld.nx) and ld.nx <> w.f)) and (ld.nx = w.t or w.size + ld.dist + ld.sz <= 4000))
 select f from_node, t to_node, array_to_string(p, ',') path, size from w where done and size <= 4000""")
def paths_between(spark, d):
    k = _thin(spark, d)
    s = G.next_nodes(k).select("node", "next_node").distinct()
    pairs = s.select(F.col("node").alias("from_node"), F.col("next_node").alias("mid")).join(s.select(F.col("node").alias("mid"), F.col("next_node").alias("to_node")), "mid").where("from_node > 0 and from_node <> to_node").select("from_node", "to_node").distinct()
    out = T.paths_between(nodes(spark, d), k, pairs, 2, 4000)
    return out.select("from_node", "to_node", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"), "size")


_ANCHOR = "an as (select node_id from nd where length(seq) >= 260)"


@query(f"""{TH}, {_ANCHOR}, ve as (select case when abs(source) in (select node_id from an) then abs(source) * 4 + case when source > 0 then 1 else 2 end else abs(source) * 4 end a, case when abs(dest) in (select node_id from an) then abs(dest) * 4 + case when dest > 0 then 1 else 2 end else abs(dest) * 4 end b from tm),
 vs as (select node_id * 4 a from nd where node_id not in (select node_id from an) union select a from ve), cc as (select a, a root from vs union select ve.b, cc.root from cc join ve on ve.a = cc.a), g as (select a, min(root) c from cc group by a),
 nm as (select c, min(a) // 4 tangle from g where a % 4 = 0 group by c), o as (select c, a // 4 n, min(a % 4) kind, count(*) seen from g group by 1, 2)
 select tangle, case when kind = 0 or seen = 2 then 'internal' else 'frontier' end "role", case when kind = 2 and seen = 1 then -n else n end node from o join nm using (c)""")
def tangle_members(spark, d):
    t = nodes(spark, d)
    return T.tangles(t, _thin(spark, d), t.where("length(seq) >= 260"))


@query()
def tangle_classes(spark, d):
    t, k = nodes(spark, d), _thin(spark, d)
    return T.classify_tangles(t, k, persisted(T.tangles(t, k, t.where("length(seq) >= 260")), "tangles")).groupBy("class").agg(F.count("*").alias("tangles"))


@query(f"""{TH},
 vv as (select node_id node, seq from nd union all select -node_id, reverse(translate(seq, 'ACGT', 'TGCA')) from nd),
 nc as (select -source node, count(*) n from tm group by 1)
 select v.node, length(v.seq) size, v.seq, coalesce(b.n, 0) prev_count, coalesce(f.n, 0) next_count from vv v left join nc f on f.node = v.node left join nc b on b.node = -v.node where f.n is not null or b.n is not null""")
def node_views(spark, d):
    return G.node_views(nodes(spark, d), _thin(spark, d), both=True, include_disconnected=False)


@query(f"with {NODES} select node_id, seq from nd where length(seq) between 200 and 400")
def nodes_selected_by_size(spark, d):
    return nodes(spark, d).where(F.length("seq").between(200, 400))


@query(f"""with {NODES},
 b as (select n.node_id, n.node_name, nd.seq from nodes n join nd using (node_id) where n.node_name is not null qualify row_number() over (partition by node_name order by n.node_id) = 1)
 select node_name list_id, 0 place, -node_id node from b""")
def oldnames_resolved(spark, d):
    from strandloom.session import table

    w = Window.partitionBy("name").orderBy("node_id")
    names = table(spark, d, "nodes").where("status = 'Active' and node_name is not null").select(F.col("node_name").alias("name"), "node_id").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    lists = names.select(F.col("name").alias("list_id"), F.concat("name", F.lit("-")).alias("names"))
    return G.oldnames_to_nodes(lists, names)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

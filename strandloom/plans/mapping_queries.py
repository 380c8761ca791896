"""Queries on read mapping and linkage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import linkage as L
from strandloom.operators import mapping as M
from strandloom.operators.seeding import frequency_seeds
from strandloom.plans.graph_queries import TH, _thin, links
from strandloom.plans.graph_queries import L as LINKS_SQL
from strandloom.plans.kmer_queries import seeds_sql
from strandloom.plans.views import NODES, PATHS, READS, nodes, paths, reads
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


def seeds(spark, d, kind: str | None = None, limit: int = 200):
    """Seeds on graph k-mers occurring fewer than ``limit`` times: 200 for mapping, 50 where the long-read recruiter matches exactly."""
    r = reads(spark, d)
    return frequency_seeds(r if kind is None else r.where(F.col("kind") == kind), nodes(spark, d), 31, limit)


S, S50 = seeds_sql(200), seeds_sql(50)
_BLK = """bk0 as (select *, read_pos - lag(read_pos) over w dr, node_pos - lag(node_pos) over w dn from sd window w as (partition by store, read_id, node order by read_pos, node_pos)),
 bk1 as (select *, sum(case when dr is null or dr > 500 or dn > 500 or dn <= 0 or dr <= 0 or abs(dn - dr) > 60 then 1 else 0 end) over (partition by store, read_id, node order by read_pos, node_pos rows unbounded preceding) c from bk0),
 bk as (select store, read_id, node, min(read_pos) q_start, max(read_pos) + 31 q_end, min(node_pos) n_start, max(node_pos) + 31 n_end, count(*) score from bk1 group by store, read_id, node, c having count(*) >= 2)"""
_PM = """pm0 as (select *, node_pos - read_pos dg, read_pos - row_number() over (partition by store, read_id, node, node_pos - read_pos order by read_pos) isl from sd),
 pm1 as (select store, read_id, node, dg, isl, min(read_pos) read_position, min(node_pos) node_position, cast(count(*) + 30 as integer) size from pm0 group by all),
 pm2 as (select *, max(size) over (partition by store, read_id, read_position) top from pm1), pm3 as (select *, sum(case when size = top then 1 else 0 end) over (partition by store, read_id, read_position) tops from pm2),
 pm as (select store, read_id, node, node_position, read_position, size from pm3 where size = top and tops = 1 and size >= 35)"""


@query(f"{S} select store, read_id, node, cast(least(count(*), 255) as bigint) hits from sd group by all having count(*) >= 5")
def candidate_counts(spark, d):
    return M.candidate_counts(seeds(spark, d), 5)


@query(f"""{S},
 uq as (select kmer from nk group by kmer having count(*) = 1),
 x as (select rk.store, rk.read_id, rk.pos, case when rk.is_fw = nk.is_fw then nk.node_id else -nk.node_id end node from rk join nk using (kmer) where kmer in (select kmer from uq))
 select store, read_id, abs(node) node, min(pos) first_pos, max(pos) + 30 last_pos, count(*) unique_matches, node < 0 rev from x group by store, read_id, x.node""")
def read_mappings(spark, d):
    return M.read_mappings(seeds(spark, d, limit=2), 31)


@query(f"{S}, {_BLK} select store, read_id, node, q_start, q_end, n_start, n_end, score from bk")
def chain_blocks(spark, d):
    return M.alignment_blocks(seeds(spark, d), 31)


@query(f"""{S}, {_BLK}
 select store, read_id, node, q_start, q_end, n_start, n_end, score from bk where not exists (select 1 from bk o where o.store = bk.store and o.read_id = bk.read_id and o.q_start <= bk.q_start and o.q_end >= bk.q_end and o.score > bk.score)""")
def shadowed_filter(spark, d):
    return M.drop_shadowed(persisted(M.alignment_blocks(seeds(spark, d), 31), "blocks"))


@query(f"{S}, {_BLK} select store, read_id, node, q_start, q_end, n_start, n_end, score from bk where n_end - n_start >= 60 and 100.0 * score / (n_end - n_start) >= 50")
def size_id_filter(spark, d):
    return M.filter_by_size_and_id(M.alignment_blocks(seeds(spark, d), 31), 60, 50)


_OG = """og0 as (select *, abs(node) u, q_start - n_start o1, q_end - n_end o2, least(q_start - n_start, q_end - n_end) - 200 lo, greatest(q_start - n_start, q_end - n_end) + 200 hi from {blocks}),
 og1 as (select *, max(hi) over (partition by store, read_id, u order by lo, hi, q_start, n_start, node rows between unbounded preceding and 1 preceding) reach from og0),
 og2 as (select *, sum(case when reach is null or lo >= reach then 1 else 0 end) over (partition by store, read_id, u order by lo, hi, q_start, n_start, node rows unbounded preceding) grp from og1),
 og3 as (select store, read_id, u, grp, min(lo) glo, max(hi) ghi, sum(score) gs, (list_sort(list([cast(q_start as bigint), q_end, n_start, node])))[1][4] fn from og2 group by store, read_id, u, grp),
 og4 as (select * from og3 qualify 2 * gs >= max(gs) over (partition by store, read_id, u)),
 og as (select o.store, o.read_id, cast(sign(fn) as bigint) * o.u node, (list_sort(list([n_start, q_start])))[1][2] q_start, (list_sort(list([n_end, -q_start, q_end])))[-1][3] q_end, min(n_start) n_start, max(n_end) n_end, cast(sum(score) as bigint) score
   from og0 o join og4 g on o.store = g.store and o.read_id = g.read_id and o.u = g.u and o1 >= glo and o2 <= ghi group by o.store, o.read_id, o.u, g.grp, fn)"""


@query(f"{S}, {_BLK}, {_OG.format(blocks='bk')} select store, read_id, node, q_start, q_end, n_start, n_end, score from og")
def offset_groups(spark, d):
    return M.offset_groups(M.alignment_blocks(seeds(spark, d), 31))


_SHADOW = "not exists (select 1 from {t} o where o.store = t.store and o.read_id = t.read_id and o.q_start <= t.q_start and o.q_end >= t.q_end and o.score > t.score)"


@query(f"{S}, {_BLK}, bs as (select * from bk t where {_SHADOW.format(t='bk')}), {_OG.format(blocks='bs')} select store, read_id, node, q_start, q_end, n_start, n_end, score from og t where {_SHADOW.format(t='og')}")
def mappings_improved(spark, d):
    return M.improve_mappings(persisted(M.alignment_blocks(seeds(spark, d), 31), "blocks"))


@query()
def best_nodes(spark, d):
    return M.best_nodes(persisted(seeds(spark, d), "seeds"), _read_sizes(spark, d), 31)


def _read_sizes(spark, d):
    return reads(spark, d).select("store", "read_id", F.length("seq").alias("size"))


@query(f"{S50}, {_PM} select * from pm")
def perfect_mappings(spark, d):
    return M.perfect_matches(seeds(spark, d, limit=50), 31, 35)


@query(f"{S50}, {_PM} select pm.store, pm.read_id, -node node, node_position, cast(length(rd.seq) - read_position - size as integer) read_position, size from pm join rd using (store, read_id)")
def perfect_mappings_reversed(spark, d):
    return M.reverse_matches(M.perfect_matches(seeds(spark, d, limit=50), 31, 35), _read_sizes(spark, d))


@query(f"""{S50}, {_PM}, o as (select *, row_number() over w i, lag(node) over w bn, lag(node_position) over w bp from pm window w as (partition by store, read_id order by read_position, size, node, node_position))
 select store, read_id, node, node_position, read_position, size from o where not exists (select 1 from o a where a.store = o.store and a.read_id = o.read_id and a.i between o.i + 1 and o.i + 5 and a.node = o.bn and a.node <> o.node and a.node_position > o.bp)""")
def sandwiches_cleaned(spark, d):
    return M.clean_sandwiches(M.perfect_matches(seeds(spark, d, limit=50), 31, 35))


@query(f"{S50}, {_PM} select node, store, read_id from pm where size >= 40 group by all having count(*) >= 1")
def recruit_reads(spark, d):
    return M.recruited(M.perfect_matches(seeds(spark, d, limit=50), 31, 35), 40, 1)


_VB = """vo as (select *, row_number() over (partition by store, read_id order by read_position, size, node, node_position) - 1 ord from pm),
 vb as (select store, read_id, node, cast(min(ord) as integer) first, cast(max(ord) as integer) last, count(*) matches, cast(sum(size) as bigint) bp from vo group by store, read_id, node having max(ord) - min(ord) + 1 = count(*))"""


@query(f'{S50}, {_PM}, {_VB} select store, read_id, node, first as "first", last as "last", matches, bp from vb')
def valid_blocks(spark, d):
    return M.valid_blocks(M.perfect_matches(seeds(spark, d, limit=50), 31, 35), 1)


@query(f"""{S50}, {_PM}, {_VB},
 st as (select store, read_id, node, arg_min(read_position - node_position, read_position * 100000 + size) s from pm group by all)
 select vb.store, vb.read_id thread_id, cast(row_number() over (partition by vb.store, vb.read_id order by first) - 1 as integer) idx, vb.node, cast(s as integer) start_pos, cast(s + length(nd.seq) as integer) end_pos from vb join st using (store, read_id, node) join nd on nd.node_id = abs(vb.node)""")
def simple_threads(spark, d):
    return M.simple_threads(M.perfect_matches(seeds(spark, d, limit=50), 31, 35), nodes(spark, d).select("node_id", F.length("seq").alias("size")), 1)


@query(f"""{S50}, {_PM}, o as (select *, lag(node) over (partition by store, read_id order by read_position, size, node, node_position) b from pm), k as (select * from o where b is null or b <> node)
 select store, read_id, cast(arg_min(read_position - node_position, read_position) as integer) path_offset, string_agg(cast(node as varchar), ',' order by read_position, size, node, node_position) path from k group by store, read_id""")
def reads_pathed(spark, d):
    out = M.path_reads(M.perfect_matches(seeds(spark, d, limit=50), 31, 35))
    return out.select("store", "read_id", "path_offset", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


P = f"with {PATHS}"


@query(f"{P}, e as (select store, read_id, unnest(path) n from ph) select distinct store, abs(n) node, cast(sign(n) as bigint) * read_id read_id from e where n <> 0")
def paths_in_node(spark, d):
    return M.paths_in_node(paths(spark, d))


@query(f"""{P}, w as (select distinct x node from (select unnest(path) x from ph) where x <> 0), b as (select *, list_transform(list_reverse(path), lambda x: -x) back from ph),
 j as (select distinct store, read_id, w.node, path, back from b, (select unnest(b.path) y) u join w on abs(w.node) = abs(u.y))
 select store, node, read_id, array_to_string(case when list_position(path, node) > 0 then path[list_position(path, node) + 1:] else back[list_position(back, node) + 1:] end, ',') path from j where list_position(path, node) > 0 or list_position(back, node) > 0""")
def all_paths_fw(spark, d):
    p = paths(spark, d)
    wanted = p.select(F.explode("path").alias("node")).where("node <> 0").distinct()
    out = M.all_paths_fw(p, wanted)
    return out.select("store", "node", "read_id", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


_VOTES = """sv as (select unnest(path[:-2]) a, unnest(path[2:]) b from ph where len(path) > 1),
 bo as (select a node, b other from sv where a <> 0 and b <> 0 union all select -b, -a from sv where a <> 0 and b <> 0),
 vt as (select node, other, count(*) votes from bo group by all)"""


@query(f"{P}, {_VOTES} select node, other, votes from vt qualify row_number() over (partition by node order by votes desc, other) = 1 and votes > 10")
def immediate_neighbours(spark, d):
    return M.immediate_neighbours(paths(spark, d))


_RPOS = "rp as (select rk.store, rk.read_id, abs(x) node, x < 0 rev, min(p) node_pos from (select store, read_id, node x, case when node > 0 then node_pos else length(nd.seq) - 31 - node_pos end p from sd join nd on nd.node_id = abs(node)) rk group by all)"


@query(f"""{S}, {_RPOS},
 j as (select a.node, a.rev r1, a.node_pos p1, b.node_pos p2 from rp a join rp b on a.node = b.node and a.rev <> b.rev and a.read_id % 2 = 1 and b.read_id = a.read_id + 1 and b.store = a.store),
 f as (select case when r1 then p2 else p1 end fw, case when r1 then p1 else p2 end bw from j)
 select case when bw >= fw then 'FR' else 'RF' end orientation, cast(abs(bw - fw) as integer) d, count(*) pairs from f where abs(bw - fw) < 70000 group by all""")
def insert_size_distribution(spark, d):
    t = nodes(spark, d).select(F.col("node_id"), F.length("seq").alias("size"))
    s = seeds(spark, d).join(t, F.abs("node") == F.col("node_id"))
    at = F.when(F.col("node") > 0, F.col("node_pos")).otherwise(F.col("size") - 31 - F.col("node_pos"))
    m = s.groupBy("store", "read_id", "node").agg(F.min(at).alias("node_pos")).select("store", "read_id", F.abs("node").alias("node"), (F.col("node") < 0).alias("rev"), "node_pos")
    return M.insert_sizes(m)


_TN = f"""{P}, {READS},
 en as (select distinct store, read_id, abs(n) node from (select store, read_id, unnest(path) n from ph) where n <> 0),
 tn as (select tag, node, count(*) reads from en join rd using (store, read_id) where tag > 0 group by all)"""


def _tag_nodes(spark, d):
    return L.tag_node_reads(paths(spark, d), reads(spark, d))


@query(f"{_TN} select node, tag from tn where reads > 1")
def node_tags(spark, d):
    return L.node_tags(_tag_nodes(spark, d), 1)


_TNB = """tk as (select tag from tn group by tag having sum(reads) >= 2 and count(*) < 500),
 tt as (select * from tn where tag in (select tag from tk) and node in (select node_id from nd where length(seq) >= 200)),
 sh as (select a.node, b.node other, sum(a.reads) s from tt a join tt b using (tag) group by all),
 ow as (select node, sum(reads) o from tt group by node),
 nb as (select node, other, s / o score from sh join ow using (node) where s / o >= 0.3)"""


@query(f"{_TN}, {NODES}, {_TNB} select node, other, round(score, 6) score from nb")
def tag_neighbours(spark, d):
    return L.tag_neighbours(_tag_nodes(spark, d), 0.3, large=L.select_by_size(nodes(spark, d), 200)).withColumn("score", F.round("score", 6))


@query(f"{_TN}, {NODES}, nt as (select node node_id, count(*) tags from tn group by node) select node_id from nd left join nt using (node_id) where length(seq) between 150 and 400 and coalesce(tags, 0) between 1 and 40")
def nodes_selected_by_tags(spark, d):
    return L.select_by_tags(nodes(spark, d), L.node_tags(_tag_nodes(spark, d)), 150, 400, 1, 40)


@query(f"with {NODES} select node_id from nd where length(seq) >= 250")
def nodes_selected(spark, d):
    return L.select_by_size(nodes(spark, d), 250)


_FN = """fr as (select -source node, dest other, dist, row_number() over (partition by source, dest order by dist) rn, count(*) over (partition by source, dest) n from mi),
 fn as (select node, other, cast(trunc(case when any_value(n) % 2 = 1 then max(dist) filter (rn = n // 2 + 1) else (max(dist) filter (rn = n // 2) + max(dist) filter (rn = n // 2 + 1)) / 2.0 end) as integer) dist from fr where n >= {least} group by node, other),
 sl as (select node_id from nd where length(seq) >= 250), fs as (select * from fn where abs(node) in (select node_id from sl) and abs(other) in (select node_id from sl))"""


@query(f"""{LINKS_SQL}, {NODES}, {_FN.format(least=2)},
 ls as (select *, lead(other) over (partition by node order by dist, other) nx from fn),
 lc as (select -source o, dest t, count(*) c from mi group by all)
 select abs(node) node_id from ls left join lc on o = other and t = nx group by 1 having bool_and(nx is null or coalesce(c, 0) >= 1)""")
def linear_anchors(spark, d):
    return L.linear_anchors(links(spark, d), 2, 1)


@query(f"""{LINKS_SQL}, {NODES}, {_FN.format(least=2)},
 be as (select -node s, other d, dist from fs qualify row_number() over (partition by node order by dist, other) = 1)
 select least(s, d) source, greatest(s, d) dest, min(dist) dist from be group by 1, 2""")
def nextselected_linkage(spark, d):
    return L.nextselected_linkage(links(spark, d), L.select_by_size(nodes(spark, d), 250), 2)


@query(f"""{TH},
 sl as (select node_id from nd where length(seq) >= 250),
 h1 as (select node s, nx n from st where abs(node) in (select node_id from sl)),
 h2 as (select distinct s, st.nx n from h1 join st on st.node = n where abs(n) not in (select node_id from sl)),
 f as (select * from h1 union select * from h2)
 select distinct least(-s, n) source, greatest(-s, n) dest, 0 dist from f where abs(n) in (select node_id from sl)""")
def topology_linkage_r2(spark, d):
    return L.topology_linkage(_thin(spark, d), L.select_by_size(nodes(spark, d), 250), 2)


_MAPPED = "mp as (select store, read_id, node, count(*) c from sd group by all), mb as (select store, read_id, node from mp qualify row_number() over (partition by store, read_id order by c desc, node) = 1)"


def _mapped(spark, d):
    n = M.candidate_counts(seeds(spark, d), 1, 1 << 30)
    return n.groupBy("store", "read_id").agg(F.max(F.struct("hits", (-F.col("node")).alias("m"))).alias("b")).select("store", "read_id", (-F.col("b.m")).alias("node"))


@query(f"""{S}, {_MAPPED}, j as (select -a.node s, -b.node d from mb a join mb b on a.read_id % 2 = 1 and b.read_id = a.read_id + 1 and b.store = a.store where abs(a.node) <> abs(b.node)),
 v as (select case when abs(s) < abs(d) then s else d end source, case when abs(s) < abs(d) then d else s end dest, count(*) votes from j group by all) select * from v qualify votes >= 2 and max(votes) over (partition by abs(source), abs(dest)) <= 5 * votes""")
def paired_linkage(spark, d):
    return L.paired_linkage(_mapped(spark, d), 2)


@query(f"""{P},
 e as (select store, read_id, node, min(i) i from (select store, read_id, unnest(path) node, unnest(range(len(path))) i from ph) where node <> 0 group by all),
 j as (select distinct store, read_id, least(-a.node, b.node) source, greatest(-a.node, b.node) dest from e a join e b using (store, read_id) where a.i < b.i)
 select source, dest, count(*) reads from j group by all having count(*) >= 3""")
def shared_read_paths(spark, d):
    return L.shared_read_paths(paths(spark, d), 3)


_SL = seeds_sql(200).replace("{", "{{").replace("}", "}}").replace("join nd on nd.node_id = ix.node)", "join nd on nd.node_id = ix.node where rk.store in (select store from rd where kind = '{kind}'))")
_ML = f"""bs as (select * from bk t where {_SHADOW.format(t='bk')}), {_OG.format(blocks='bs')}, im as (select * from og t where {_SHADOW.format(t='og')})"""
_LINKS = """mh as (select *, q_start - max(q_end) over (partition by store, read_id, node order by q_start, q_end rows between unbounded preceding and 1 preceding) hole from {maps}),
 mg as (select *, sum(case when hole is null or hole >= 500 then 1 else 0 end) over (partition by store, read_id, node order by q_start, q_end rows unbounded preceding) grp from mh),
 mm as (select store, read_id, node, min(q_start) qs, max(q_end) qe, min(n_start) ns, max(n_end) ne from mg group by store, read_id, node, grp),
 gm as (select m.* from mm m join nd on nd.node_id = abs(m.node) join rd using (store, read_id) where ne - ns >= 0.7 * length(nd.seq) or qs <= 1000 or qe >= length(rd.seq) - 1000)"""
_JOINED = "select -a.node source, b.node dest, cast(b.qs - a.qe as integer) dist, a.store, a.read_id from gm a join gm b on a.store = b.store and a.read_id = b.read_id and (b.qs > a.qs or (b.qs = a.qs and b.qe > a.qe)) and abs(a.node) <> abs(b.node)"
_NB05 = _TNB.replace("in (select tag from tk) and node in (select node_id from nd where length(seq) >= 200)", "in (select tag from tk)").replace(">= 0.3", ">= 0.05")
_ENTN = _TN.removeprefix("with ").replace(f", {READS}", "")


@query(f"{_SL.format(kind='long')}, {_BLK}, {_ML}, {_LINKS.format(maps='im')} {_JOINED}")
def longreads_multilinkage(spark, d):
    n = nodes(spark, d).select("node_id", F.length("seq").alias("size"))
    blocks = persisted(M.alignment_blocks(seeds(spark, d, "long"), 31), "blocks")
    return L.mappings_multilinkage(M.improve_mappings(blocks), n, _read_sizes(spark, d))


@query(f"""{_SL.format(kind='long')}, {_ENTN}, {_NB05}, {_BLK}, {_ML}, bh as (select store, read_id, abs(node) node, sum(score) hits from im group by all),
 hs as (select a.store, a.read_id, a.node, sum(nb.score * b.hits) sc from bh a join bh b on a.store = b.store and a.read_id = b.read_id join nb on nb.node = a.node and nb.other = b.node group by all),
 be as (select * from hs qualify row_number() over (partition by store, read_id order by sc desc, node) = 1),
 ok as (select distinct be.store, be.read_id, nb.other n from be join nb on nb.node = be.node union select store, read_id, node from be), kp as (select im.* from im join ok on ok.store = im.store and ok.read_id = im.read_id and ok.n = abs(im.node)), {_LINKS.format(maps='kp')} {_JOINED}""")
def long10x_multilinkage(spark, d):
    n = nodes(spark, d).select("node_id", F.length("seq").alias("size"))
    blocks = persisted(M.improve_mappings(persisted(M.alignment_blocks(seeds(spark, d, "long"), 31), "blocks")), "blocks")
    return L.long10x_multilinkage(blocks, persisted(L.tag_neighbours(_tag_nodes(spark, d), 0.05), "near"), n, _read_sizes(spark, d))


@query(f"""{_SL.format(kind='linked')}, {_ENTN}, {_NB05}, mh as (select store, read_id, node, count(*) h, min(node_pos) p from sd group by all), mb as (select * from mh qualify row_number() over (partition by store, read_id order by h desc, node, p desc) = 1),
 j as (select -a.node s, -b.node d, -(a.p + b.p) dist from mb a join mb b on a.store = b.store and a.read_id % 2 = 1 and b.read_id = a.read_id + 1 where abs(a.node) <> abs(b.node)), k as (select s, d, dist, count(*) c from j join nb on nb.node = abs(s) and nb.other = abs(d) group by all)
 select s source, d dest, cast(arg_max(dist, c * 10000000 - dist) as integer) dist, cast(sum(c) as bigint) pairs from k group by all""")
def paired10x_multilinkage(spark, d):
    s = seeds(spark, d, "linked")
    m = s.groupBy("store", "read_id", "node").agg(F.count("*").alias("hits"), F.min("node_pos").alias("node_pos"))
    one = m.groupBy("store", "read_id").agg(F.max(F.struct("hits", (-F.col("node")).alias("m"), "node_pos")).alias("b")).select("store", "read_id", (-F.col("b.m")).alias("node"), F.col("b.node_pos").alias("node_pos"))
    return L.paired10x_multilinkage(one, L.tag_neighbours(_tag_nodes(spark, d), 0.05))


@query(f"""{_SL.format(kind='long')}, {_ENTN}, {_NB05}, c0 as (select store, read_id, node, least(count(*), 255) h from sd group by all), bh as (select store, read_id, abs(node) node, sum(h) hits from c0 group by store, read_id, abs(node)),
 hs as (select a.store, a.read_id, a.node, sum(nb.score * b.hits) sc from bh a join bh b on a.store = b.store and a.read_id = b.read_id join nb on nb.node = a.node and nb.other = b.node group by all)
 select store, read_id, node, round(sc, 6) score, row_number() over (partition by store, read_id order by sc desc, node) = 1 best from hs""")
def haplotype_scores(spark, d):
    hits = M.candidate_counts(seeds(spark, d, "long"), 1).groupBy("store", "read_id", F.abs("node").alias("node")).agg(F.sum("hits").alias("hits"))
    return L.haplotype_scores(hits, L.tag_neighbours(_tag_nodes(spark, d), 0.05)).withColumn("score", F.round("score", 6))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

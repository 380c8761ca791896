"""Queries on sequences, k-mer counters and indexes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.functions.kmers import canonical, rc, unpack
from strandloom.operators import kmer_counts as K
from strandloom.operators.seeding import frequency_seeds
from strandloom.plans.views import NODES, PATHS, READS, kmers_sql, nodes, paths, reads
from strandloom.session import table
from strandloom.sources.fastx import store_summary as store_summary_of

Q: dict = {}
SQL: dict[str, str] = {}
STORES = ["lg00a", "lk00a", "lk00b", "pe00a", "pe00b", "pe00c"]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _named(df: DataFrame, k: int = 31) -> DataFrame:
    return df.withColumn("kmer", unpack(F.col("code"), k)).drop("code")


_N31 = f"with {NODES}, {kmers_sql('nk', 'nd', 'node_id', 31)}"
_R31 = f"{READS}, {kmers_sql('rk', 'rd', 'store, read_id, tag', 31)}"
_BOTH = f"""{_N31}, {_R31},
 g as (select kmer, count(*) n from nk group by kmer),
 rc0 as (select kmer, least(count(*), 65535) n from rk group by kmer),
 ri as (select g.kmer, coalesce(rc0.n, 0) n from g left join rc0 using (kmer))"""


@query(f"with {NODES} select node_id, reverse(translate(seq, 'ACGT', 'TGCA')) rc_seq, seq <= reverse(translate(seq, 'ACGT', 'TGCA')) is_canonical from nd")
def rc_sequences(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d)
    return t.select("node_id", rc(F.col("seq")).alias("rc_seq"), S.is_canonical(F.col("seq")).alias("is_canonical"))


@query(f"with {NODES}, {kmers_sql('nk', 'nd', 'node_id', 15)} select node_id, pos, kmer, is_fw from nk")
def kmer_explode_k15(spark: SparkSession, d: str) -> DataFrame:
    return _named(S.kmers(nodes(spark, d), 15, ["node_id"]), 15)


@query(f"with {READS}, {kmers_sql('rk', 'rd', 'store, read_id', 63)} select kmer, count(*) n from rk group by kmer having count(*) >= 2")
def kmer_counts_k63(spark: SparkSession, d: str) -> DataFrame:
    return S.long_kmers(reads(spark, d), 63, []).groupBy("kmer").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"{_N31}, b as (select unnest(['A', 'C', 'G', 'T']) b), u as (select distinct kmer from nk) select kmer, substr(kmer, 2) || b fw, b || substr(kmer, 1, 30) bw from u, b")
def kmer_neighbours(spark: SparkSession, d: str) -> DataFrame:
    u = _named(S.kmers(nodes(spark, d), 31, [], spots=False).distinct())
    zipped = F.arrays_zip(S.kmer_fw_neighbours(F.col("kmer")).alias("fw"), S.kmer_bw_neighbours(F.col("kmer")).alias("bw"))
    return u.select("kmer", F.inline(zipped))


@query(
    f"""with {READS}, l as (select store, read_id, unnest(range(length(seq))) pos, unnest(string_split(seq, '')) c from rd),
 k as (select *, lag(c) over w b1, lag(c, 2) over w b2 from l window w as (partition by store, read_id order by pos))
 select store, read_id, string_agg(c, '' order by pos) seq from k where b2 is null or c <> b1 or c <> b2 group by store, read_id"""
)
def homopolymers_compressed(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("store", "read_id", S.compress_homopolymers(F.col("seq"), 2).alias("seq"))


@query(f"with {PATHS} select store, read_id, array_to_string(list_transform(list_reverse(path), lambda x: -x), ',') back, array_to_string(path[2:4], ',') inner_part from ph")
def paths_reversed_and_sliced(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return paths(spark, d).select("store", "read_id", joined(S.reverse_path(F.col("path"))).alias("back"), joined(S.vec_slice(F.col("path"), 1, 4)).alias("inner_part"))


@query(f"{_N31} select kmer, count(*) n from nk group by kmer")
def graph_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.count_kmers(nodes(spark, d), 31))


@query(f"{_BOTH} select kmer, n from ri")
def read_counts_of_graph_kmers(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.count_indexed(K.count_kmers(nodes(spark, d), 31), reads(spark, d), 31))


@query(f"""with {NODES},
 half as (select * from nd where length(seq) >= 240), {kmers_sql('hk', 'half', 'node_id', 31)}, {kmers_sql('nk', 'nd', 'node_id', 31)},
 i as (select distinct kmer from hk),
 g as (select kmer, count(*) n from nk group by kmer)
 select i.kmer, coalesce(n, 0) n from i left join g using (kmer)""")
def graph_counts_updated(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d)
    index = K.count_kmers(t.where("length(seq) >= 240"), 31)
    return _named(K.recount(index, t, 31)[0])


@query(f"{_N31}, {_R31}, i as (select distinct kmer from nk), c as (select kmer, " + ", ".join(f"count(*) filter (store = '{s}') {s}" for s in STORES) + " from rk group by kmer) select i.kmer, " + ", ".join(f"least(coalesce({s}, 0), 65535) {s}" for s in STORES) + " from i left join c using (kmer)")
def multicount_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.multicount(K.count_kmers(nodes(spark, d), 31), reads(spark, d), "store", STORES, 31))


@query(f"{_BOTH} select node_id, pos, coalesce(n, 0) n from nk left join ri using (kmer)")
def kmer_projected_counts(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d)
    return K.project(t, "node_id", K.count_kmers(reads(spark, d), 31), 31)


@query(f"""{_BOTH}, u as (select node_id, ri.n from nk join g using (kmer) join ri using (kmer) where g.n = 1),
  m as (select node_id, count(*) c, (list_sort(list(n)))[cast(floor(count(*) / 2) as integer) + 1] m from u group by node_id)
  select node_id, coalesce(c, 0) unique_kmers, case when c > 10 then round(m / 8.0, 6) else -1.0 end kci from nd left join m using (node_id)""")
def kci_upper_median(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d)
    graph, counted = K.count_kmers(t, 31), K.count_kmers(reads(spark, d), 31)
    return K.kci(t, "node_id", graph, counted, 8.0, 31).withColumn("kci", F.round("kci", 6))


@query(f"""{_BOTH},
 h as (select least(ri.n, 60) freq, count(*) kmers from ri join g using (kmer) where g.n = 1 group by 1)
 select cast(r.freq as bigint) freq, coalesce(kmers, 0) kmers from (select unnest(range(61)) freq) r left join h using (freq)""")
def kmer_spectrum_unique(spark: SparkSession, d: str) -> DataFrame:
    graph = K.count_kmers(nodes(spark, d), 31)
    return K.spectrum(K.count_indexed(graph, reads(spark, d), 31), 60, graph, unique=True)


@query(f"with {READS}, {kmers_sql('rk', 'rd', 'read_id', 21)} select kmer, count(*) n from rk group by kmer having count(*) between 3 and 40")
def kmers_of_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.counts_from(reads(spark, d), 21, 3, 40), 21)


@query(f"with {_R31} select kmer, count(distinct tag) n from rk where tag > 0 group by kmer having count(distinct tag) >= 2")
def tag_kmers_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.tag_kmers(reads(spark, d), 31, 2, by_tag=True))


@query(f"with {READS} select tag, cast(floor(count(*) / 2) as bigint) pairs from rd where tag > 0 group by tag")
def tag_readcount(spark: SparkSession, d: str) -> DataFrame:
    return K.tag_readcount(reads(spark, d))


@query(f"with {READS}, p as (select tag, cast(floor(count(*) / 2) as bigint) pairs from rd where tag > 0 group by tag) select cast(least(pairs, 10000) as bigint) pairs, count(*) tags from p group by 1")
def tag_occupancy_hist(spark: SparkSession, d: str) -> DataFrame:
    return K.tag_occupancy(reads(spark, d))


@query("select store, kind, count(*) reads, cast(sum(coalesce(length(seq), 0)) as bigint) bp, cast(min(coalesce(length(seq), 0)) as integer) shortest, cast(max(coalesce(length(seq), 0)) as integer) longest, count(distinct tag) filter (tag > 0) tags from (select distinct * from fastq_reads) group by store, kind")
def store_summary(spark: SparkSession, d: str) -> DataFrame:
    return store_summary_of(table(spark, d, "fastq_reads").distinct())


@query(f"with {READS} select store, read_id, tag from rd where tag = 65537")
def tag_reads(spark: SparkSession, d: str) -> DataFrame:
    return K.tag_reads(reads(spark, d), 65537)


@query(f"""{_BOTH}, a as (select kmer, count(*) filter (store like 'pe%') p, count(*) filter (store like 'lk%') l from rk group by kmer),
  u as (select node_id, coalesce(a.p, 0) p, coalesce(a.l, 0) l from nk join g using (kmer) left join a using (kmer) where g.n <= 1),
  s as (select node_id, (case when min(p) >= 1 then '1' else '0' end) || (case when min(l) >= 1 then '1' else '0' end) pattern from u group by node_id)
  select node_id, coalesce(pattern, '') pattern from nd left join s using (node_id)""")
def count_pattern(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d)
    kind = F.when(F.col("store").startswith("pe"), "p").when(F.col("store").startswith("lk"), "l")
    graph = K.count_kmers(t, 31)
    values = K.multicount(graph, reads(spark, d).withColumn("of", kind).where("of is not null"), "of", ["p", "l"], 31)
    return K.count_pattern(t, "node_id", graph, values, ["p", "l"], 31, 1, 1)


_INDEX = "select kmer, node_id node, cast((pos + 1) * (case when is_fw then 1 else -1 end) as integer) kmer_offset from nk"


@query(f"{_N31} {_INDEX} where kmer in (select kmer from nk group by kmer having count(*) < 4)")
def kmer_freq_filtered_index(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.frequency_index(nodes(spark, d), 31, 4))


@query(f"with {NODES}, {kmers_sql('nk', 'nd', 'node_id', 13)} {_INDEX} where kmer in (select kmer from nk group by kmer having count(*) < 50)")
def saturated_index_k13(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.frequency_index(nodes(spark, d), 13, 50), 13)


@query(f"{_N31} {_INDEX} where kmer in (select kmer from known_kmers)")
def kmer_whitelist_index(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.functions.kmers import pack

    white = table(spark, d, "known_kmers").select(pack(canonical(F.col("kmer"))).alias("code"))
    return _named(K.whitelist_index(nodes(spark, d), 31, white))


@query(f"{_N31} {_INDEX} where kmer in (select kmer from nk group by kmer having count(*) = 1)")
def kmer_unique_index(spark: SparkSession, d: str) -> DataFrame:
    return _named(K.unique_index(nodes(spark, d), 31))


@query(f"""{_N31},
 u as (select kmer from nk group by kmer having count(*) = 1),
 t as (select node_id, count(*) total_kmers, count(u.kmer) unique_kmers from nk left join u using (kmer) group by node_id)
 select node_id node, coalesce(total_kmers, 0) total_kmers, coalesce(unique_kmers, 0) unique_kmers, coalesce(unique_kmers, 0) = 0 unmappable from nd left join t using (node_id)""")
def unique_kmer_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.unique_stats(nodes(spark, d), 31)


def seeds_sql(limit: int) -> str:
    """Hits of reads on graph k-mers that occur fewer than ``limit`` times, as ``sd``."""
    return f"""{_N31}, {_R31}, rare as (select kmer from nk group by kmer having count(*) < {limit}), ix as ({_INDEX} where kmer in (select kmer from rare)),
  sd as (select rk.store, rk.read_id, rk.pos read_pos, case when rk.is_fw = (kmer_offset > 0) then node else -node end node,
    cast(case when rk.is_fw = (kmer_offset > 0) then abs(kmer_offset) - 1 else length(nd.seq) - abs(kmer_offset) - 31 + 1 end as integer) node_pos
    from rk join ix using (kmer) join nd on nd.node_id = ix.node)"""


@query(f"{seeds_sql(200)} select store, read_id, read_pos, node, node_pos from sd")
def seed_matches(spark: SparkSession, d: str) -> DataFrame:
    return frequency_seeds(reads(spark, d), nodes(spark, d), 31, 200)


@query(f"{_BOTH}, w as (select ri.kmer from ri join g using (kmer) where g.n = 1 and ri.n between 2 and 40) {_INDEX} where kmer in (select kmer from w)")
def anchor_index(spark: SparkSession, d: str) -> DataFrame:
    t = nodes(spark, d)
    return _named(K.anchor_index(t, K.count_kmers(t, 31), K.count_kmers(reads(spark, d), 31), 31, 2, 40))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.kmers import clean_kmer, pack, unpack
from strandloom.llm import heavy, mixing, packing, residue, runs, seen, termfreq
from strandloom.session import persisted, table


def _keyed_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kmer_index").select(clean_kmer(F.col("kmer")).alias("key"), F.col("rec_no").alias("ord"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "known_kmers").select(clean_kmer(F.col("kmer")).alias("key"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(_keyed_records(spark, d), _known(spark, d)).select(F.col("ord").alias("rec_no"))


def p2_probe_report(spark: SparkSession, d: str) -> DataFrame:
    return seen.probe_report(_keyed_records(spark, d), _known(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    reads = runs.text_runs(table(spark, d, "fastq_reads"), least=8)
    paths = runs.list_runs(table(spark, d, "read_paths"), least=2)
    columns = ["store", "read_id", "first_at", "last_at", "run_count"]
    return reads.select(F.lit("fastq_reads").alias("src"), *columns).unionAll(paths.select(F.lit("read_paths").alias("src"), *columns))


def p4_collapsed_paths(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "read_paths"))


def p4_event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of one kind per user, names alike but for case, blanks and signs being one kind; without a name an event is unreadable."""
    kind = F.nullif(F.regexp_replace(F.lower("event_type"), "[^a-z0-9]", ""), F.lit(""))
    return runs.event_runs(table(spark, d, "events"), "user_id", "ts", kind, tie="event_id")


def _counted_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with a k-mer (as number) and a count above 0; rows delivered twice are one record."""
    t = table(spark, d, "kmer_index").where("kmer_count > 0")
    return t.select("rec_no", pack(clean_kmer(F.col("kmer"))).alias("term"), F.col("node").alias("owner"), F.col("kmer_count").alias("amount")).where("term is not null").distinct()


def _frequencies(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    pairs = persisted(termfreq.owner_pairs(_counted_records(spark, d)), "pairs")
    owners = pairs.where("owner is not null").select("owner").distinct().count()
    return termfreq.term_frequencies(pairs), owners


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    marked = termfreq.mark_terms(*_frequencies(spark, d))
    return marked.where("mark is not null").select(unpack(F.col("term")).alias("kmer"), "mark")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    marked = termfreq.mark_terms(*_frequencies(spark, d))
    return marked.select(unpack(F.col("term")).alias("kmer"), F.col("occurrences").alias("total"), F.col("presence").alias("spread"), "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.top_items(_counted_records(spark, d), 30, "term").select(unpack(F.col("item")).alias("kmer"))


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    return heavy.approximate_top(_counted_records(spark, d), 30, "term").select(unpack(F.col("item")).alias("kmer"), "at_least", "at_most")


def _limits(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The kinds of containers, a fixed handful."""
    return [(r.container, r.capacity_tokens) for r in table(spark, d, "pack_limits").where("container is not null and capacity_tokens > 0").orderBy("container").collect()]


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.document_sizes(table(spark, d, "documents")), _limits(spark, d))


def p7_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d), _limits(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_share_report(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.plan_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.share_report(persisted(mixing.draw_mixture(plan), "mixture"), plan)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.with_residue(table(spark, d, "documents"))


def p9_residue_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their share of residue by kind; kinds empty for clean ones."""
    found = residue.text_residue(table(spark, d, "documents"))
    return found.groupBy("kinds").agg(F.count("*").alias("docs"), F.sum("residue_letters").alias("residue_letters"), F.sum("letters").alias("letters"))


_CLEAN = "upper(trim(kmer, ' ' || chr(9) || chr(13)))"
_KMERS = f"""r as (select distinct rec_no, kmer, node, kmer_count from kmer_index),
k as (select rec_no, node, kmer_count, {_CLEAN} u from r),
c as (select rec_no, node, kmer_count, least(u, reverse(translate(u, 'ACGT', 'TGCA'))) kmer from k where regexp_full_match(u, '[ACGT]{{31}}'))"""
_TOTALS = f"""{_KMERS},
v as (select * from c where kmer_count > 0),
f as (select kmer, cast(sum(kmer_count) as bigint) total, count(distinct node) spread from v group by kmer),
m as (select kmer, total, spread, case when total = 1 then 'rare' when spread >= 3 and 100 * spread >= (select count(distinct node) from v) then 'common' end mark from f)"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_probe_report, p4_found, p4_collapsed_paths, p4_event_runs, p5_found, p5_frequencies, p6_found, p6_bounds, p7_packed, p7_fill_report, p8_mixture, p8_share_report, p9_found, p9_residue_report)}


def _runs_sql(source: str, least: int) -> str:
    # a run breaks where the symbol changes or more than one blank lies before it
    return f"""select store, read_id, cast(min(pos) as integer) first_at, cast(max(pos) as integer) last_at, cast(count(*) as integer) run_count from (
      select *, sum(fresh) over (partition by store, read_id order by pos) g from (
        select *, case when symbol = lag(symbol) over w and pos - lag(pos) over w <= 2 then 0 else 1 end fresh from ({source}) window w as (partition by store, read_id order by pos)))
    group by store, read_id, g having count(*) >= {least}"""


_LETTERS = "select store, read_id, pos, symbol from (select store, read_id, unnest(range(length(seq))) pos, upper(unnest(string_split(seq, ''))) symbol from (select distinct * from fastq_reads) where length(seq) > 0) where symbol in ('A', 'C', 'G', 'T')"
_ENTRIES = "select store, read_id, pos, symbol from (select store, read_id, unnest(range(len(path))) pos, unnest(path) symbol from (select distinct * from read_paths)) where symbol <> 0"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""with {_KMERS}, o as (select kmer, min(rec_no) rec_no from c group by kmer)
            select c.rec_no from c join o using (kmer) where c.rec_no > o.rec_no or kmer in (select kmer from known_kmers)""",
        "p2_probe_report": f"""with {_KMERS}, b as (select min(rec_no) lo, cast(ceil((max(rec_no) - min(rec_no) + 1) / 4) as bigint) width from kmer_index),
            x as (select rec_no, kmer, (rec_no - lo) // width batch from c, b), o as (select kmer, min(rec_no) rec_no from c group by kmer),
            n as (select batch, count(distinct rec_no) records, count(distinct kmer) probed from x group by batch),
            w as (select (rec_no - lo) // width batch, count(*) fresh from o, b where kmer not in (select kmer from known_kmers) group by 1)
            select cast(batch as integer) batch, records, probed, coalesce(fresh, 0) fresh, probed - coalesce(fresh, 0) hash_hits, probed - coalesce(fresh, 0) verified_hits,
              cast(0 as double) hash_only_error_rate, cast(0 as bigint) wrong_answers, cast(0 as double) error_rate from n left join w using (batch)""",
        "p4_event_runs": """with e as (select distinct user_id, ts, event_id, nullif(regexp_replace(lower(event_type), '[^a-z0-9]', '', 'g'), '') kind from events where user_id is not null and ts is not null),
            p as (select *, row_number() over (partition by user_id order by ts, event_id, kind) pos from e), v as (select * from p where kind is not null),
            f as (select *, case when kind = lag(kind) over w and pos - lag(pos) over w <= 2 then 0 else 1 end fresh from v window w as (partition by user_id order by pos)),
            g as (select *, sum(fresh) over (partition by user_id order by pos) grp from f)
            select cast(user_id as varchar) user_id, kind event, min(ts) first_ts, max(ts) last_ts, count(*) run_count, date_diff('microseconds', min(ts), max(ts)) duration_us from g group by user_id, kind, grp having count(*) >= 2""",
        "p4_found": f"select 'fastq_reads' src, * from ({_runs_sql(_LETTERS, 8)}) union all select 'read_paths' src, * from ({_runs_sql(_ENTRIES, 2)})",
        "p4_collapsed_paths": f"select s.store, s.read_id, s.first_at, p.path[s.first_at + 1] symbol, s.run_count, cast(s.last_at - s.first_at + 1 as integer) extent from ({_runs_sql(_ENTRIES, 1)}) s join (select distinct * from read_paths) p using (store, read_id)",
        "p5_found": f"with {_TOTALS} select kmer, mark from m where mark is not null",
        "p5_frequencies": f"with {_TOTALS} select kmer, total, spread, mark from m",
        "p6_found": f"with {_TOTALS} select kmer from m order by total desc, kmer limit 30",
    }

"""Command line: ``python -m strandloom.cli make|view|compare|count ...``."""

from __future__ import annotations

import argparse

from strandloom.operators.kmer_counts import count_kmers
from strandloom.session import build_session
from strandloom.sources import fastx


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="command", required=True)
    make = sub.add_parser("make", help="FASTQ files to a read store")
    make.add_argument("--kind", choices=("paired", "linked", "long"), required=True)
    make.add_argument("--name", required=True)
    make.add_argument("-1", dest="first", required=True)
    make.add_argument("-2", dest="second")
    make.add_argument("--min-size", type=int, default=0)
    make.add_argument("--max-size", type=int, default=0, help="0: the largest of the first reads")
    make.add_argument("--layout", choices=("raw", "UCDavis"), default="raw")
    make.add_argument("-o", "--out", required=True)
    view = sub.add_parser("view", help="what a read store holds")
    view.add_argument("store")
    compare = sub.add_parser("compare", help="tag occupancy of linked stores")
    compare.add_argument("stores", nargs="+")
    compare.add_argument("-o", "--out", required=True)
    count = sub.add_parser("count", help="k-mer counts of a store")
    count.add_argument("store")
    count.add_argument("-k", type=int, default=31)
    count.add_argument("-o", "--out", required=True)
    a = p.parse_args(argv)
    spark = build_session()
    if a.command == "make":
        first = fastx.read_fastq(spark, a.first)
        if a.kind == "long":
            reads = fastx.long_store(first, a.name, a.min_size)
        else:
            size = a.max_size or fastx.detected_read_size(first)
            second = fastx.read_fastq(spark, a.second)
            reads = fastx.paired_store(first, second, a.name, a.min_size, size) if a.kind == "paired" else fastx.linked_store(first, second, a.name, a.layout, size)
        reads.write.parquet(a.out)
    elif a.command == "view":
        for r in fastx.store_summary(spark.read.parquet(a.store)).collect():  # one row per store
            print(f"{r.store} ({r.kind}): {r.reads} reads, {r.bp} bp, {r.shortest} to {r.longest} bp, {r.tags} tags")
    elif a.command == "compare":
        reads = spark.read.parquet(*a.stores)
        fastx.tag_comparison(reads, sorted(r.store for r in reads.select("store").distinct().collect())).write.csv(a.out, header=True)
    else:
        count_kmers(spark.read.parquet(a.store), a.k).write.parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

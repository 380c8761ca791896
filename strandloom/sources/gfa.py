"""GFA1, GFA2 and BCALM sources, and GFA sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.kmers import canonical
from strandloom.operators.graph import Graph
from strandloom.session import numbered, numbered_records
from strandloom.sources.fastx import read_fasta


def _stored(named: DataFrame) -> DataFrame:
    """(name, node_id, seq, sign) from (ord, name, seq): stored canonically, sign -1 where that reversed it."""
    kept = canonical(F.col("seq"))
    ids = numbered(named.select("ord", "name", "seq"), "rank", "ord").select((F.col("rank") + 1).alias("node_id"), "name", "seq")
    return ids.select("name", "node_id", kept.alias("stored"), F.when(F.col("seq") == kept, 1).otherwise(-1).alias("sign"))


def _signed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, dest, dist) from (from_name, from_plus, to_name, to_plus, dist): leaving a + sequence uses its negative end."""
    a = nodes.select(F.col("name").alias("from_name"), (F.col("node_id") * F.col("sign")).alias("a"))
    b = nodes.select(F.col("name").alias("to_name"), (F.col("node_id") * F.col("sign")).alias("b"))
    j = edges.join(a, "from_name").join(b, "to_name")
    return j.select(F.when(F.col("from_plus"), -F.col("a")).otherwise(F.col("a")).alias("source"), F.when(F.col("to_plus"), F.col("b")).otherwise(-F.col("b")).alias("dest"), F.col("dist").cast("int").alias("dist"))


def read_gfa(spark: SparkSession, path: str, fasta: str | None = None) -> tuple[Graph, DataFrame]:
    """Graph and (name, node_id) of a GFA file, by its header version 1 (also without a header) or 2.

    Sequences stand in the S lines or, for ``*``, in the FASTA of the same name (or ``fasta``). An
    unsupported suffix, or a sequence whose length differs from what is stated, raises.
    """
    stem, dot, suffix = path.rpartition(".")
    if suffix not in ("gfa", "gfa2"):
        raise ValueError(f"not a .gfa or .gfa2 file: {path}")
    lines = numbered_records(spark, path, "ord").select("ord", F.split("value", "\t").alias("f"))
    head = lines.where("f[0] = 'H'").select(F.array_join("f", "\t").alias("h")).first()
    two = head is not None and "VN:Z:2.0" in head.h
    s = lines.where("f[0] = 'S'").select("ord", F.col("f")[1].alias("name"), F.col("f")[3 if two else 2].alias("seq"), F.array_join("f", "\t").alias("all"))
    length = F.regexp_extract("all", r"LN:i:(\d+)", 1)
    s = s.withColumn("stated", F.split("all", "\t")[2].cast("int") if two else F.when(length != "", length.cast("int")))
    gap = (F.col("seq") == "*") & ~F.col("all").contains("UR:Z:") & F.col("stated").isNotNull() if not two else F.lit(False)
    gaps = s.where(gap).select("name", "stated")
    real = s.where(~gap)
    if not real.where("seq = '*'").isEmpty():
        named = read_fasta(spark, fasta or f"{stem}.fasta").select("name", F.col("seq").alias("from_fasta"))
        real = real.join(named, "name", "left").withColumn("seq", F.when(F.col("seq") == "*", F.coalesce("from_fasta", F.raise_error(F.concat(F.lit("no sequence for "), F.col("name"))).cast("string"))).otherwise(F.col("seq")))
    checked = F.when(F.col("stated").isNull() | (F.length("seq") == F.col("stated")), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("length differs: "), F.col("name"))).cast("string"))
    nodes = _stored(real.select("ord", "name", checked.alias("seq")))
    edges = _gfa2_edges(lines) if two else _gfa1_edges(lines, gaps)
    links = _signed(edges, nodes)
    if not two:  # a link delivered in both directions is one
        turn = F.col("source") > F.col("dest")
        links = links.select(F.when(turn, F.col("dest")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("dest")).alias("dest"), "dist").dropDuplicates(["source", "dest"])
    return Graph(nodes.select("node_id", F.col("stored").alias("seq")), links), nodes.select("name", (F.col("node_id") * F.col("sign")).alias("node_id"))


def _gfa1_edges(lines: DataFrame, gaps: DataFrame) -> DataFrame:
    l_ = lines.where("f[0] = 'L'").select(F.col("f")[1].alias("a"), (F.col("f")[2] == "+").alias("ap"), F.col("f")[3].alias("b"), (F.col("f")[4] == "+").alias("bp"), F.regexp_extract(F.col("f")[5], r"^(\d+)M", 1).alias("m"))
    g = gaps.select(F.col("name").alias("gap"), "stated")
    into = l_.join(g, F.col("b") == F.col("gap")).select("gap", "stated", F.col("a").alias("from_name"), F.col("ap").alias("from_plus"), F.col("bp").alias("through"))
    out = l_.join(g.select("gap"), F.col("a") == F.col("gap")).select("gap", F.col("b").alias("to_name"), F.col("bp").alias("to_plus"), F.col("ap").alias("through"))
    over = into.join(out, ["gap", "through"]).select("from_name", "from_plus", "to_name", "to_plus", F.col("stated").alias("dist"))
    plain = l_.join(g, F.col("a") == F.col("gap"), "left_anti").join(g, F.col("b") == F.col("gap"), "left_anti")
    direct = plain.select(F.col("a").alias("from_name"), F.col("ap").alias("from_plus"), F.col("b").alias("to_name"), F.col("bp").alias("to_plus"), (-F.coalesce(F.when(F.col("m") != "", F.col("m").cast("int")), F.lit(0))).alias("dist"))
    return direct.unionByName(over)


def _gfa2_edges(lines: DataFrame) -> DataFrame:
    """E lines overlap by what they cover of the first sequence, G lines leave a gap; a ``$`` behind a coordinate is allowed."""
    side = lambda i: F.expr(f"substring(f[{i}], 1, length(f[{i}]) - 1)")
    plus = lambda i: F.col("f")[i].endswith("+")
    number = lambda i: F.regexp_replace(F.col("f")[i], r"\$", "").cast("int")
    e = lines.where("f[0] = 'E'").select(side(2).alias("from_name"), plus(2).alias("from_plus"), side(3).alias("to_name"), plus(3).alias("to_plus"), (number(4) - number(5)).alias("dist"))
    g = lines.where("f[0] = 'G'").select(side(2).alias("from_name"), plus(2).alias("from_plus"), side(3).alias("to_name"), plus(3).alias("to_plus"), number(4).alias("dist"))
    return e.unionByName(g)


def read_bcalm(spark: SparkSession, path: str, k: int) -> tuple[Graph, DataFrame]:
    """Graph and (name, node_id) of compacted unitigs with ``L:+:n:-`` fields in their headers; k must be odd."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    t = read_fasta(spark, path)
    nodes = _stored(t.select(F.col("record_id").alias("ord"), "name", "seq"))
    links = t.select("name", F.explode(F.expr(r"regexp_extract_all(comment, 'L:([+-]:[0-9]+:[+-])', 1)")).alias("l")).select("name", F.split("l", ":").alias("p"))
    edges = links.select(F.col("name").alias("from_name"), (F.col("p")[0] == "+").alias("from_plus"), F.col("p")[1].alias("to_name"), (F.col("p")[2] == "+").alias("to_plus"), F.lit(1 - k).alias("dist"))
    signed = _signed(edges, nodes)
    turn = F.col("source") > F.col("dest")
    one = signed.select(F.when(turn, F.col("dest")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("dest")).alias("dest"), "dist").distinct()
    return Graph(nodes.select("node_id", F.col("stored").alias("seq")), one), nodes.select("name", (F.col("node_id") * F.col("sign")).alias("node_id"))


def _text(parts: list[DataFrame], path: str) -> None:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    out.write.text(path)


def _kept(graph: Graph, selected: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if selected is None:
        return graph.nodes, graph.links
    s = selected.select("node_id").distinct()
    touching = graph.links.join(s, (F.abs("source") == F.col("node_id")) | (F.abs("dest") == F.col("node_id")), "left_semi")
    return graph.nodes.join(s, "node_id", "left_semi"), touching


_NAME = lambda c: F.concat(F.lit("seq"), F.abs(c).cast("string"))


def write_gfa1(spark: SparkSession, graph: Graph, path: str, selected: DataFrame | None = None, depths: DataFrame | None = None) -> None:
    """K1: H, S and L lines with sequences, as a folder of parts; a positive distance becomes a gap sequence and two L lines."""
    nodes, links = _kept(graph, selected)
    n = nodes.join(depths.select("node_id", "depth"), "node_id", "left") if depths is not None else nodes.withColumn("depth", F.lit(None))
    s = n.select(F.concat_ws("\t", F.lit("S"), _NAME("node_id"), "seq", F.concat(F.lit("LN:i:"), F.length("seq")), F.concat(F.lit("DP:f:"), F.col("depth"))).alias("value"))
    a, b = F.when(F.col("source") > 0, "-").otherwise("+"), F.when(F.col("dest") > 0, "+").otherwise("-")
    near = links.where("dist <= 0").select(F.concat_ws("\t", F.lit("L"), _NAME("source"), a, _NAME("dest"), b, F.concat((-F.col("dist")).cast("string"), F.lit("M"))).alias("value"))
    gap = F.concat_ws("_", F.lit("gap"), F.col("source").cast("string"), F.col("dest").cast("string"), F.col("dist").cast("string"))
    far = links.where("dist > 0").withColumn("gap", gap).distinct()
    filler = far.select(F.concat_ws("\t", F.lit("S"), "gap", F.lit("*"), F.concat(F.lit("LN:i:"), F.col("dist"))).alias("value"))
    two = F.explode(F.array(F.concat_ws("\t", F.lit("L"), _NAME("source"), a, "gap", F.lit("+"), F.lit("0M")), F.concat_ws("\t", F.lit("L"), "gap", F.lit("+"), _NAME("dest"), b, F.lit("0M"))))
    _text([spark.createDataFrame([("H\tVN:Z:1.0",)], "value string"), s, filler, near, far.select(two.alias("value"))], path)


def write_gfa2(spark: SparkSession, graph: Graph, path: str, selected: DataFrame | None = None) -> None:
    """K2: H, S, E (overlaps) and G (gaps) lines, as a folder of parts; coordinates lie within the sequences."""
    nodes, links = _kept(graph, selected)
    s = nodes.select(F.concat_ws("\t", F.lit("S"), _NAME("node_id"), F.length("seq").cast("string"), "seq").alias("value"))
    sizes = lambda end, p: nodes.select(F.col("node_id").alias(f"{p}_id"), F.length("seq").alias(f"{p}_size"))
    t = links.join(sizes("source", "s"), F.abs("source") == F.col("s_id")).join(sizes("dest", "d"), F.abs("dest") == F.col("d_id"))
    a = F.concat(_NAME("source"), F.when(F.col("source") > 0, "-").otherwise("+"))
    b = F.concat(_NAME("dest"), F.when(F.col("dest") > 0, "+").otherwise("-"))
    o = -F.col("dist")
    e = t.where("dist <= 0").select(F.concat_ws("\t", F.lit("E"), F.lit("*"), a, b, (F.col("s_size") - o).cast("string"), F.concat(F.col("s_size").cast("string"), F.lit("$")), F.lit("0"), o.cast("string"), F.concat(o.cast("string"), F.lit("M"))).alias("value"))
    g = t.where("dist > 0").select(F.concat_ws("\t", F.lit("G"), F.lit("*"), a, b, F.col("dist").cast("string"), F.lit("*")).alias("value"))
    _text([spark.createDataFrame([("H\tVN:Z:2.0",)], "value string"), s, e, g], path)

"""A mixture of sources at target shares, by iterative proportional fitting.

Texts fall into cells of source, language and topic. The token weights of the cells
are raked to the three marginals in turn: sources to their target shares, languages
and topics to the shares they have in the usable texts; no cell's weight per token
passes its source's cap on repeats. The weight is the expected number of copies of each
text in the cell. Copies are drawn by these probabilities as a balanced sample: two texts
at a time trade probability so that the tokens expected of the source stay as they are,
with odds that leave each text's chance unchanged, until the chances are 0 or 1. So a source's tokens differ from
those expected by one text at most in every group, and no copy is changed afterwards.

Topics come from a small model trained here: centroids over hashed token counts, weighted
by document frequencies over all texts. Texts are tokenized once; what is kept of them is their size and counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import DEFAULT_VOCABULARY, encoding
from strandloom.session import persisted

GROUP_SIZE = 1 << 17
FEATURES = 1024
#: Rows the centroids of the topic model are fitted on at most; all else covers every text.
SAMPLE_ROWS = 4096
_CHUNK = 2048


def _packed(tokens: list[int]) -> bytes:
    """The features of a text: their numbers, then their counts, as 16-bit numbers."""
    counts = np.bincount(np.asarray(tokens, dtype=np.int64) % FEATURES, minlength=FEATURES)
    at = np.flatnonzero(counts)
    return np.concatenate([at, np.minimum(counts[at], 65535)]).astype(np.uint16).tobytes()


def _vectors(packed: list[bytes], inverse: np.ndarray | None = None) -> np.ndarray:
    """One row of unit length per text: logarithms of counts, weighted by inverse document frequencies."""
    parts = [np.frombuffer(p, np.uint16) for p in packed]
    half = np.array([len(p) // 2 for p in parts], dtype=np.int64)
    rows = np.zeros((len(parts), FEATURES))
    if half.sum():
        at = np.concatenate([p[: len(p) // 2] for p in parts])
        rows[np.repeat(np.arange(len(parts)), half), at] = np.log1p(np.concatenate([p[len(p) // 2 :] for p in parts]).astype(np.float64))
    if inverse is not None:
        rows *= inverse
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_topics(packed: list[bytes], inverse: np.ndarray, topics: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a sample; spherical k-means from evenly spaced rows."""
    if not packed:
        return np.zeros((1, FEATURES))
    rows = _vectors(packed, inverse)
    centroids = rows[np.linspace(0, len(rows) - 1, min(topics, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(axis=1)
        for k in range(len(centroids)):
            if (nearest == k).any():
                mean = rows[nearest == k].sum(axis=0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


_KEPT = ("doc_id", "source", "lang", "text_key")


def _tokenized(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes, features = [], []
            for text in batch.column("text").to_pylist():
                tokens = encode(text) if text else []
                sizes.append(len(tokens))
                features.append(_packed(tokens))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(sizes, pa.int64()), pa.array(features, pa.binary())], names=[*_KEPT, "n_tokens", "features"])

    return run


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a split hold each feature."""
    held = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for p in batch.column("features").to_pylist():
            held[np.frombuffer(p, np.uint16)[: len(p) // 4]] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES, dtype=np.int32)), pa.array(held)], names=["feature", "n"])


def _with_topics(inverse: np.ndarray, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                topic = (_vectors(part.column("features").to_pylist(), inverse) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*_KEPT, "n_tokens")), pa.array(topic.astype(np.int32))], names=[*_KEPT, "n_tokens", "topic"])

    return run


def plain_source(column: str) -> F.Column:
    """A source name however spelt: lower case, without blanks around it, ``_`` for any other sign."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[^a-z0-9]+", "_")


def sized_texts(documents: DataFrame, sources: list[str], topics: int = 8, vocabulary: str = DEFAULT_VOCABULARY, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per distinct text of the named sources: (doc_id, source, lang, topic, n_tokens), kept in the shared folder.

    Equal texts are one text, held by the smallest id. Null or empty texts and rows of
    other or null sources are left out; a null or unknown language is ``und``.
    """
    rows = documents.select(F.col("doc_id").cast("long"), plain_source("source").alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("source").isin(sources) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    keyed = rows.withColumn("text_key", F.sha2("text", 256)).select(*_KEPT, "text")
    counted = persisted(keyed.mapInArrow(_tokenized(vocabulary), "doc_id long, source string, lang string, text_key string, n_tokens long, features binary"), "counted")
    n = counted.count()
    frequency = np.zeros(FEATURES)
    for r in counted.select("features").mapInArrow(_presence, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # one row per feature
        frequency[r.feature] = r.n
    inverse = np.log((1 + n) / (1 + frequency))
    # a sample in order of a hash: of twice the size by its upper bits, then cut
    mixed = F.xxhash64("doc_id")
    share = min(1.0, 2 * sample_rows / max(1, n))
    sample = counted.where(F.pmod(mixed, F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).orderBy(mixed, "doc_id").limit(sample_rows).select("features")
    centroids = fit_topics([bytes(r.features) for r in sample.collect()], inverse, topics)
    sized = counted.mapInArrow(_with_topics(inverse, centroids), "doc_id long, source string, lang string, text_key string, n_tokens long, topic int")
    one = sized.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "lang", "topic", "n_tokens")).alias("t")).select("t.*")
    return persisted(one, "mix")


def rake(cells: list[tuple[str, str, int, float]], shares: dict[str, float], caps: dict[str, int], total: float | None = None, rounds: int = 200) -> tuple[dict[tuple, float], float]:
    """Expected copies per cell (source, language, topic), and the size of the mixture.

    ``cells`` have (source, language, topic, tokens). Without ``total`` the size is the
    largest at which every source with a share above 0 can reach it.
    """
    held: dict[str, float] = {}
    for s, _, _, n in cells:
        held[s] = held.get(s, 0.0) + n
    reachable = [caps[s] * held.get(s, 0.0) / share for s, share in shares.items() if share > 0]
    if total is None:
        total = min(reachable, default=0.0)
    size = np.array([n for *_, n in cells], dtype=float)
    cap = np.array([caps[s] for s, *_ in cells], dtype=float)
    weight = np.minimum(cap, np.array([shares[s] * total / held[s] for s, *_ in cells])) if len(cells) else size
    groups = []
    for axis in (1, 2, 0):  # sources last: their shares are the ones asked for
        labels = [c[axis] for c in cells]
        for label in dict.fromkeys(labels):
            at = np.array([x == label for x in labels])
            goal = shares[label] * total if axis == 0 else total * size[at].sum() / max(size.sum(), 1.0)
            groups.append((at, goal))
    for _ in range(rounds):
        before = weight.copy()
        for at, goal in groups:
            free = at.copy()
            while free.any():  # weights that reach their cap leave the rest to the others
                now, fixed = (weight[free] * size[free]).sum(), (weight[at & ~free] * size[at & ~free]).sum()
                if now <= 0:
                    break
                scaled = weight[free] * max(0.0, goal - fixed) / now
                weight[free] = np.minimum(cap[free], scaled)
                over = scaled > cap[free]
                if not over.any():
                    break
                free[np.flatnonzero(free)[over]] = False
        if np.abs(weight - before).max(initial=0.0) < 1e-9:
            break
    return {tuple(c[:3]): float(w) for c, w in zip(cells, weight)}, float(total)


def _chance(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number of [0, 1) for each id, the same whenever a task is repeated."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt % (1 << 32))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def balanced_draw(expected: np.ndarray, size: np.ndarray, ids: np.ndarray, salt: int = 1) -> np.ndarray:
    """Copies of each text: ``expected`` on average, with the expected sum of sizes but for one text.

    Neighbours trade first, so texts of one cell should stand together.
    """
    copies = np.floor(expected + 1e-9).astype(np.int64)
    chance = np.clip(expected - copies, 0.0, 1.0)
    open_ = np.flatnonzero(chance > 1e-9)
    p, s, luck = chance[open_].tolist(), size[open_].astype(float).tolist(), _chance(ids[open_], salt).tolist()
    a = -1
    for b in range(len(p)):
        if a < 0:
            a = b
            continue
        up, down = min((1 - p[a]) / s[b], p[b] / s[a]), min(p[a] / s[b], (1 - p[b]) / s[a])
        step = up if luck[b] * (up + down) < down else -down
        p[a] += step * s[b]
        p[b] -= step * s[a]
        if not 1e-9 < p[a] < 1 - 1e-9:
            a = b if 1e-9 < p[b] < 1 - 1e-9 else -1
    if a >= 0:
        p[a] = float(_chance(ids[open_[a : a + 1]], -salt)[0] < p[a])
    copies[open_] += np.rint(p).astype(np.int64)
    return copies


def _drawn(weights: dict[tuple, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("source", "ascending"), ("lang", "ascending"), ("topic", "ascending"), ("n_tokens", "ascending"), ("doc_id", "ascending")])
        source, lang, topic = (rows.column(c).to_pylist() for c in ("source", "lang", "topic"))
        expected = np.array([weights.get((s, x, t), 0.0) for s, x, t in zip(source, lang, topic)])
        copies = np.zeros(len(expected), np.int64)
        size, ids = rows.column("n_tokens").to_numpy(), rows.column("doc_id").to_numpy()
        name = np.array(source)
        for i, s in enumerate(dict.fromkeys(source)):
            at = np.flatnonzero(name == s)
            copies[at] = balanced_draw(expected[at], size[at], ids[at], i + 1)
        kept = np.flatnonzero(copies)
        out = rows.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([out.column(c).combine_chunks() for c in ("doc_id", "source", "lang", "topic", "n_tokens")] + [pa.array(copies[kept].astype(np.int32))], names=["doc_id", "source_name", "lang", "topic", "n_tokens", "copies"])

    return run


@dataclass
class MixturePlan:
    """Sized texts, the tokens, largest text and weight of each cell, and the size of the mixture."""

    texts: DataFrame
    cells: list[tuple[str, str, int, float, int]]
    shares: dict[str, float]
    caps: dict[str, int]
    weights: dict[tuple, float]
    total: float


def plan_mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, topics: int = 8, vocabulary: str = DEFAULT_VOCABULARY, sample_rows: int = SAMPLE_ROWS) -> MixturePlan:
    """Sizes the texts and rakes the cells; parameters and odd cases as in :func:`mixture`."""
    shares, caps = _targets(targets, documents)
    texts = sized_texts(documents, list(shares), topics, vocabulary, sample_rows)
    found = texts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("top")).orderBy("source", "lang", "topic").collect()  # one row per cell
    cells = [(r.source, r.lang, r.topic, float(r.n), r.top) for r in found]
    present = {c[0] for c in cells}
    known = sum(shares[s] for s in present)
    weights, size = rake([c[:4] for c in cells], {s: shares[s] / known for s in present} if known else {}, caps, total)
    return MixturePlan(texts, cells, shares, caps, weights, size)


def draw_mixture(plan: MixturePlan, group_size: int = GROUP_SIZE) -> DataFrame:
    """The texts of a planned mixture, drawn in groups of about ``group_size`` by hash of the id."""
    groups = max(1, -(-plan.texts.count() // group_size))
    placed = plan.texts.repartitionById(groups, F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    return placed.mapInArrow(_drawn(plan.weights), "doc_id long, source_name string, lang string, topic int, n_tokens long, copies int")


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, topics: int = 8, vocabulary: str = DEFAULT_VOCABULARY, group_size: int = GROUP_SIZE) -> DataFrame:
    """The texts of the mixture: (doc_id, source_name, lang, topic, n_tokens, copies), copies >= 1.

    ``targets`` has source_name, target_share and max_repeats: one row per source, read by
    the driver. Targets with a null name, or a share or cap not above 0, take no part; shares are
    scaled to sum 1. If a source with a share holds no text, or ``total`` exceeds what the
    caps allow, the shares reached differ from the targets: see :func:`share_report`. Without
    texts or targets the result is empty.
    """
    return draw_mixture(plan_mixture(documents, targets, total, topics, vocabulary), group_size)


def _targets(targets: DataFrame, documents: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    rows = targets.select(plain_source("source_name").alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0 and max_repeats > 0").orderBy("s").collect()
    whole = sum(r.target_share for r in rows) or 1.0
    return {r.s: r.target_share / whole for r in rows}, {r.s: r.max_repeats for r in rows}


def share_report(mixed: DataFrame, plan: MixturePlan) -> DataFrame:
    """All three marginals: (margin, name, target_share, expected_share, actual_share, tokens, texts, most_copies, reachable, one_text_share).

    ``margin`` is ``source``, ``language`` or ``topic``. Targets of languages and topics are their shares in the usable
    texts; ``expected_share`` is what raking gave them, ``actual_share`` what was drawn. A target is ``reachable`` if all
    copies that the caps allow hold its tokens; ``one_text_share`` is what the largest text makes of the mixture: a
    share cannot be met more finely. Labels of which nothing was drawn have zeros.
    """
    every = sum(c[3] for c in plan.cells) or 1.0
    rows: dict[tuple[str, str], list[float]] = {("source", s): [share, 0.0, 0.0, 0.0] for s, share in plan.shares.items()}
    for s, lang, topic, n, top in plan.cells:
        for margin, name in (("source", s), ("language", lang), ("topic", str(topic))):
            r = rows.setdefault((margin, name), [0.0, 0.0, 0.0, 0.0])
            if margin != "source":
                r[0] += n / every
            r[1] += plan.weights[(s, lang, topic)] * n
            r[2] += plan.caps[s] * n
            r[3] = max(r[3], float(top))
    size = max(plan.total, 1.0)
    planned = [(m, n, share, expected / size, room >= share * plan.total - 0.5 and room > 0, top / size) for (m, n), (share, expected, room, top) in rows.items()]
    labels = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(c).cast("string").alias("name")) for m, c in (("source", "source_name"), ("language", "lang"), ("topic", "topic")))))
    drawn = mixed.select(labels.alias("l"), "n_tokens", "copies").groupBy("l.margin", "l.name").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    whole = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    named = mixed.sparkSession.createDataFrame(planned, "margin string, name string, target_share double, expected_share double, reachable boolean, one_text_share double").join(drawn, ["margin", "name"], "left").na.fill(0, ["tokens", "texts", "most_copies"])
    return named.select("margin", "name", "target_share", "expected_share", (F.col("tokens") / F.lit(float(max(whole, 1)))).alias("actual_share"), "tokens", "texts", "most_copies", "reachable", "one_text_share")

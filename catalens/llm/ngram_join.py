"""Jaccard join of documents on word n-grams, and the groups that its links form.

All n-grams stand in one global order, rare ones first. Two sets can only reach the threshold if they
share an n-gram within the first few of each, their prefixes, so only such pairs are looked at. The
order is cut into fragments of equal weight, and a set into segments, one per fragment. A pair's
overlaps are counted segment by segment and summed; the sum decides. Prefixes are a third longer than
they must be: similar sets then share several n-grams of theirs, and only sets that share so many with
others are ever cut into segments.

The order comes first from a sketch: document frequencies in counters of fixed number, counted over all
documents. It only steers which n-grams are rare, never what is found. The sets that remain are ordered
anew by the exact frequencies of their n-grams.

Documents with equal sets are one node. Links inside a group need not all be found, so a few rounds
first link every node with one leader that shares most of its prefix, a number of pairs that grows with
the nodes however many copies a text has. Then every pair of nodes that share a prefix n-gram, are in
different groups and share enough of their prefixes is counted. Near copies below the threshold would
meet in as many pairs as the square of their number; parities of their sets (1024 bins) keep nearly all
of these pairs from becoming rows, and can never hide a pair that reaches the threshold. No group is
expanded into its pairs; links within a group are not all listed.

Words are what stands between ASCII white space, with A-Z in lower case. A text with fewer words than n
is one n-gram. Null texts and texts without words have an empty set and no links. Null ids: the row is
linked like others, has a null id in the result, and a group's id is the smallest that is not null.
Repeated rows each get a row. An empty table gives no rows. Columns but id and text are not read. Sets
and n-grams are told apart by 64-bit hashes (58 bits within a pair).
"""

from __future__ import annotations

import sys
import types
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.columns import NOT_SPACE, fresh
from catalens.llm.components import connected, written
from catalens.shipping import ship_by_value
from catalens.sources.shared import shared_folder

ship_by_value(__name__)

_LEVEL_SHIFT = 58
# Parities of a set are kept in so many whole numbers.
_MARKS = 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _word_hashes() -> _WordHashes:
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    return kept.setdefault("word hashes", _WordHashes())


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all (the finaliser of a known generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(n, len(w))
    h = np.full(len(w) - take + 1, take, np.uint64)
    for k in range(take):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - take + 1 + k]
    return np.unique(_mixed(h))


def _least(n, t: Fraction):
    """Least whole number that is not below ``t * n``."""
    return -(-n * t.numerator // t.denominator)


def prefix_length(n, t: Fraction):
    """Length of a prefix: a third more than what must hold one n-gram of every similar set.

    With the longer prefix a similar set must share several, which few other sets do.
    """
    return np.minimum(n, -(-4 * (n - _least(n, t) + 1) // 3))


def shared_at_least(n: int, t: Fraction) -> int:
    """So many n-grams of its prefix a set of n must share with the prefix of any similar set.

    Two sets of n and m need an overlap of t / (1 + t) * (n + m). What they share beyond both prefixes
    is no more than the rest of the set whose prefix ends first.
    """
    m = np.arange(_least(n, t), n * t.denominator // t.numerator + 1)
    overlap = -(-(n + m) * t.numerator // (t.numerator + t.denominator))
    rest = np.maximum(n - prefix_length(n, t), m - prefix_length(m, t))
    return max(1, int((overlap - rest).min()))


def sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Level of each counter: how often the mean its n-grams occur, in powers of two."""
    width, parts = 1 << bits, min(512, 1 << bits)
    schema = pa.schema([("part", pa.int32()), ("slot", pa.int32()), ("counts", pa.binary())])
    columns = "part int, slot int, counts binary"

    def count(batches):
        counts = np.zeros(width, np.uint64)
        hashes = _word_hashes()
        for batch in batches:
            found, held = [], 0
            for text in batch.column(0):
                grams = ngrams(text.as_py(), n, hashes)
                found.append(grams >> np.uint64(64 - bits))
                held += len(grams)
                if held > 1 << 20:
                    counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=width).astype(np.uint64)
                    found, held = [], 0
            if found:
                counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=width).astype(np.uint64)
        rows = np.minimum(counts, (1 << 32) - 1).astype("<u4").reshape(parts, -1)
        task = TaskContext.get()
        slot = task.partitionId() % 16 if task else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([slot] * parts, pa.int32()),
             pa.array([r.tobytes() for r in rows], pa.binary())],
            schema=schema,
        )

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        # Counters of a task have four bytes each, sums eight.
        total = np.zeros(width // parts, np.uint64)
        for counts in group["counts"]:
            total += np.frombuffer(counts.as_py(), "<u4" if len(key) > 1 else "<u8")
        slot = key[1].as_py() if len(key) > 1 else 0
        return pa.table(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([slot], pa.int32()),
             pa.array([total.astype("<u8").tobytes()])],
            schema=schema,
        )

    # In two steps, so that no group gets a row from every task of a large job. The driver reads the sum
    # of the counters, whose size does not depend on the data.
    summed = (
        docs.select("text").mapInArrow(count, columns)
        .groupBy("part", "slot").applyInArrow(add, columns)
        .groupBy("part").applyInArrow(add, columns).select("part", "counts").collect()
    )
    if not summed:
        return np.zeros(width, np.uint8)
    totals = np.concatenate([np.frombuffer(r["counts"], "<u8") for r in sorted(summed)])
    ratio = totals / max(totals.mean(), 1.0)
    return np.clip(np.floor(np.log2(np.maximum(ratio, 1.0))), 0, 63).astype(np.uint8)


def ordered(grams: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """N-grams as numbers in the global order: level first, then hash."""
    level = levels[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    # The upper bits of the hash, which chose the counter, make room for the level.
    return np.unique((level << np.uint64(_LEVEL_SHIFT)) | (grams & np.uint64((1 << _LEVEL_SHIFT) - 1)))


def _profiles(n: int, threshold: Fraction, levels: np.ndarray, bits: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
         ("need", pa.int32()), ("rest", pa.int32()), ("keys", pa.list_(pa.int64()))]
    )

    def run(batches):
        hashes, needs = _word_hashes(), {}
        seen: set[int] = set()  # copies within a task give their n-grams once
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, nodes, need, rest, keys = [], [], [], [], []
                if len(seen) > 1 << 20:
                    seen.clear()
                for text in part.column(2):
                    grams = ngrams(text.as_py(), n, hashes)
                    order = ordered(grams, levels, bits)
                    sizes.append(len(grams))
                    digest = xxhash.xxh3_64_digest(order.tobytes())
                    node = int.from_bytes(digest, signed=True) if len(grams) else None
                    nodes.append(node)
                    size = len(order)
                    if size not in needs:
                        needs[size] = shared_at_least(size, threshold) if size else 0
                    need.append(needs[size])
                    first = int(prefix_length(size, threshold)) if size else 0
                    rest.append(size - first)
                    keys.append(order[: 0 if node in seen else first].view(np.int64))
                    seen.add(node)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()),
                     pa.array(nodes, pa.int64()), pa.array(need, pa.int32()), pa.array(rest, pa.int32()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def pivots(levels: np.ndarray, fragments: int) -> np.ndarray:
    """Where the global order is cut: within the lowest level, where nearly all n-grams are."""
    rare = np.linspace(0, 1 << _LEVEL_SHIFT, fragments, endpoint=False)[1:].astype(np.uint64)
    return rare if fragments > 1 else rare[:0]


def parities(order: np.ndarray) -> np.ndarray:
    """For each of 64 * _MARKS bins whether an odd number of n-grams falls into it, as whole numbers.

    Every n-gram that only one of two sets has turns one bin, so the sets differ in at least as many
    n-grams as their parities in bins.
    """
    odd = np.bincount((order % np.uint64(64 * _MARKS)).astype(np.int64), minlength=64 * _MARKS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _segments(n: int, levels: np.ndarray, bits: int, cuts: np.ndarray):
    schema = pa.schema(
        [("node", pa.int64()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64())),
         ("marks", pa.list_(pa.int64()))]
    )

    def run(batches):
        hashes = _word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                nodes, fragments, grams, marks = [], [], [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1)):
                    order = ordered(ngrams(text.as_py(), n, hashes), levels, bits)
                    mark = parities(order)  # with the first segment only
                    for k, segment in enumerate(np.split(order, np.searchsorted(order, cuts))):
                        if len(segment):
                            nodes.append(node)
                            fragments.append(k)
                            grams.append(segment.view(np.int64))
                            marks.append(mark)
                            mark = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()),
                     pa.array(grams, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def _enough(inter, a, b, t: Fraction):
    """Jaccard threshold in whole numbers."""
    return t.denominator * inter >= t.numerator * (a + b - inter)


def _counted(pairs: DataFrame, segments: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b, na, nb) that reach the threshold, from partial overlaps by fragment."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    return (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("part"))
        .groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("inter"))
        .filter(_enough(F.col("inter"), F.col("na"), F.col("nb"), t))
        .select("a", "b")
    )


def _leader_pairs(keys: DataFrame, comps: DataFrame, seed: int, t: Fraction) -> DataFrame:
    """For every node the leader in another group that most of its prefix n-grams name.

    Per n-gram there are two leaders: the first node in an order that changes with the seed, and the
    first one of another group than that.
    """
    placed = keys.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Copies with few n-grams of their own lead first: they are near to most others.
    own = F.bin(F.col("n") - F.col("common") + 1)
    me = F.struct(
        F.length(own).alias("own"), F.xxhash64("node", F.lit(seed)).alias("o"), "node", "n",
        "comp", F.col("common").alias("v"),
    )
    one = placed.groupBy("key").agg(
        F.min(me).alias("one"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    both = placed.join(one.filter("lo <> hi").select("key", "one"), "key")
    two = (
        both.filter(F.col("comp") != F.col("one.comp")).groupBy("key").agg(F.min(me).alias("two"))
    )
    led = both.join(two, "key").withColumn(
        "leader", F.when(F.col("comp") == F.col("one.comp"), F.col("two")).otherwise(F.col("one"))
    )
    votes = led.groupBy(
        "node", "n", F.col("common").alias("v"), F.col("leader.node").alias("to"),
        F.col("leader.n").alias("nto"), F.col("leader.v").alias("vto"),
    ).count()
    near = votes.filter(_enough(F.least("v", "vto"), F.col("n"), F.col("nto"), t))
    best = near.groupBy("node", "n").agg(
        F.max(F.struct("count", "to", "nto")).alias("best")
    )
    return best.select(
        F.col("node").alias("a"), F.col("best.to").alias("b"), F.col("n").alias("na"),
        F.col("best.nto").alias("nb"),
    )


def _alike(t: Fraction):
    """Whether the parities of two sets a and b let their Jaccard similarity reach the threshold.

    Sets of na and nb n-grams reach it if they differ in (1 - t) / (1 + t) * (na + nb) at most.
    """
    differ = sum(
        (F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(_MARKS)), start=F.lit(0)
    )
    size = (F.col("na") + F.col("nb")) * (t.denominator - t.numerator)
    return differ * (t.denominator + t.numerator) <= size


def _cross_pairs(keys: DataFrame, comps: DataFrame, marks: DataFrame, t: Fraction) -> DataFrame:
    """All pairs of nodes in different groups whose shared prefix n-grams suffice.

    Beyond their prefixes two sets share at most what is left of the one whose prefix ends first. Sets
    that share n-grams with many but are like none of them are told apart by their parities, within
    the join: a pair becomes a row only if its parities leave it a chance.
    """
    placed = keys.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Groups meet first, so that a group's own members never do.
    kinds = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = kinds.filter("lo <> hi").select("key")
    bits = [f"m{k}" for k in range(_MARKS)]
    marked = placed.join(mixed, "key").join(
        marks.select("node", *[F.get("marks", F.lit(k)).alias(m) for k, m in enumerate(bits)]), "node"
    )
    groups = marked.groupBy("key", "comp").agg(
        F.min("n").alias("n"), F.max("common").alias("v"), F.count("*").alias("members"),
        *[F.min(m).alias(m) for m in bits],
    )

    def side(table: DataFrame, x: str, **more: str) -> DataFrame:
        named = {"comp": f"c{x}", "n": f"n{x}", **{old: f"{new}{x}" for old, new in more.items()}}
        own = [F.col(m).alias(f"{x}{k}") for k, m in enumerate(bits)]
        return table.select("key", *[F.col(old).alias(new) for old, new in named.items()], *own)

    # Not even the sets with most n-grams in common with any could overlap enough.
    able = _enough(F.least("va", "vb"), F.col("na"), F.col("nb"), t)
    one, other = (side(groups, x, v="v", members="s") for x in "ab")
    # The parities of one set are those of a group of one. The smaller group of two is spread first.
    chance = (F.col("sa") > 1) | (F.col("sb") > 1) | _alike(t)
    smaller = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("ca") < F.col("cb")))
    met = one.join(other, "key").filter(smaller & able & chance).select("key", "ca", "cb")
    left, right = (
        side(marked.withColumn("id", F.col("node")), x, id="id", rest="r", common="v") for x in "ab"
    )
    pairs = (
        met.join(left, ["key", "ca"]).join(right, ["key", "cb"])
        .filter(_enough(F.least("va", "vb"), F.col("na"), F.col("nb"), t) & _alike(t))
        # A pair may have met either way round.
        .select(
            F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"),
            *[
                F.when((F.col("ida") < F.col("idb")) == (x == "a"), F.col(f"{f}a")).otherwise(F.col(f"{f}b")).alias(f"{f}{x}")
                for f in "nr" for x in "ab"
            ],
        )
        .groupBy("a", "b", "na", "nb", "ra", "rb").count()
    )
    most = F.col("count") + F.greatest("ra", "rb")
    return pairs.filter(_enough(most, F.col("na"), F.col("nb"), t)).select("a", "b", "na", "nb")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows (key, node, ...) whose n-gram another node has as well."""
    w = Window.partitionBy("key")
    ends = keys.withColumns({"lo": F.min("node").over(w), "hi": F.max("node").over(w)})
    return ends.filter("lo <> hi").drop("lo", "hi")


def _rare_prefixes(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, common: prefixes in the order of exact frequencies among the nodes of the segments.

    common: n-grams of the node that any other has, which bounds its overlap with each.

    An edit makes n-grams that no other set has. They come first, so a copy with many edits has
    a prefix that is all its own and meets no other.
    """
    grams = segments.select("node", F.explode("grams").alias("key"))
    often = grams.withColumn("df", F.count("*").over(Window.partitionBy("key"))).filter("df > 1")
    mine = Window.partitionBy("node")
    placed = often.join(nodes, "node").withColumns(
        {
            "common": F.count("*").over(mine).cast("int"),
            "rank": F.row_number().over(mine.orderBy("df", "key")),
        }
    )
    return placed.filter("n - common + rank <= n - rest").select("key", "node", "common")


def _likely(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node and the columns of ``nodes`` (n, rest) of the nodes that share enough of their prefix to have a similar set."""
    rows = shared.select("key", "node").distinct()
    counts = rows.groupBy("node").count().join(nodes, "node").filter("count >= need")
    return rows.join(counts.drop("need", "count"), "node")


def ngram_groups(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: Fraction = Fraction(4, 5),
    doc_id: str = "doc_id",
    text: str = "text",
    fragments: int = 4,
    sketch_bits: int = 20,
    leader_rounds: int = 2,
) -> DataFrame:
    """doc_id, text_key, n_shingles, group and component_id per document.

    component_id: smallest doc_id that links reach, the document's own included. group: null for a
    document without words, else a number that all its copies and linked documents share.
    """
    folder = shared_folder(docs.sparkSession, "ngram-join")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
        F.col(text).alias("text"),
    )
    levels = sketch(rows, n, sketch_bits)
    profiles = written(
        rows.mapInArrow(
            _profiles(n, threshold, levels, sketch_bits),
            "doc_id long, text_key long, n long, node long, need int, rest int, keys array<long>",
        ),
        f"{folder}/profiles",
    )
    # Prefix n-grams that different nodes share; twice, as nodes without a chance take theirs along.
    nodes = profiles.filter("node IS NOT NULL").select("node", "n", "need", "rest").distinct()
    each = profiles.select(F.explode("keys").alias("key"), "node")
    shared = written(_shared(each), f"{folder}/shared")
    likely = written(_likely(shared, nodes), f"{folder}/likely")
    near = written(_likely(_shared(likely), nodes), f"{folder}/near")
    # One text per node that shares any.
    chosen = (
        profiles.select("node", "doc_id", "text_key")
        .join(near.select("node").distinct(), "node", "left_semi")
        .groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("r"))
        .select("node", "r.text_key", "r.doc_id")
    )
    same = (rows["text_key"] == chosen["text_key"]) & rows["doc_id"].eqNullSafe(chosen["doc_id"])
    sets = rows.join(chosen, same).select("node", "text")
    parts = sets.mapInArrow(
        _segments(n, levels, sketch_bits, pivots(levels, fragments)),
        "node long, fragment int, grams array<long>, marks array<long>",
    )
    if not profiles.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        parts = parts.dropDuplicates(["node", "fragment"])  # equal rows give equal segments
    segments = written(parts, f"{folder}/segments")
    marks = segments.filter("marks IS NOT NULL").select("node", "marks").dropDuplicates(["node"])
    rare = written(_rare_prefixes(segments, nodes), f"{folder}/rare")
    common = nodes.join(rare.select("node", "common").distinct(), "node")
    keys = written(_likely(_shared(rare), common), f"{folder}/keys")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    comps = docs.sparkSession.createDataFrame([], "node long, comp long")
    for k in range(leader_rounds + 1):
        last = k == leader_rounds
        pairs = _cross_pairs(keys, comps, marks, threshold) if last else _leader_pairs(keys, comps, k, threshold)
        found = written(_counted(pairs, segments, threshold), f"{folder}/links-{k}")
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = written(connected(links), f"{folder}/groups-{k}")
    grouped = profiles.select("doc_id", "text_key", "n", "node").join(comps, "node", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("group")
    )
    smallest = (
        grouped.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    )
    # A document without words has no group and is alone.
    joined = grouped.join(smallest, "group", "left")
    return joined.select(
        "doc_id", "text_key", "n_shingles", "group",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def one_per_group(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (null last).

    Options are those of :func:`ngram_groups`. Documents without words all stay. Of rows that are equal
    in id and text one stays.
    """
    groups = written(
        ngram_groups(docs, doc_id=doc_id, text=text, **options)
        .filter("group IS NOT NULL")
        .select("group", "doc_id", "text_key"),
        shared_folder(docs.sparkSession, "ngram-groups"),
    )
    key, twin, id_, text_key = fresh(docs, "key", "twin", "kept_id", "kept_text")
    first = groups.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("f")
    )
    chosen = first.select(
        F.coalesce("f.doc_id", F.lit(0)).alias(id_), "f.null", F.col("f.text_key").alias(text_key)
    ).select(id_, F.xxhash64("null", text_key).alias(text_key))
    worded = F.coalesce(F.col(text).rlike(NOT_SPACE), F.lit(False))
    number = F.col(doc_id).cast("long")
    rows = docs.filter(worded).withColumns(
        {
            key: F.coalesce(number, F.lit(0)),
            twin: F.xxhash64(number.isNull(), F.xxhash64(text)),
        }
    )
    kept = rows.join(
        chosen, (rows[key] == chosen[id_]) & (rows[twin] == chosen[text_key])
    ).drop(id_, text_key)
    if not groups.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, twin])
    return kept.drop(key, twin).unionByName(docs.filter(~worded))

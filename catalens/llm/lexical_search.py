"""Ranked lexical search of items in documents by two trees.

A document's score for an item is the sum, over the item's distinct terms, of a term's weight times the
document's value of the term (integers; see :func:`weight` and :func:`values`). Documents are read a
batch at a time; parting a batch along coordinates of wide spread puts like documents side by
side, and nodes of 8, 64, 512 of them hold the greatest value of every term. Items form a tree in the
same way, whose nodes hold the terms of all their items. The weights of a node's terms times a document
node's greatest values bound the score of every pair below the two. A pair of nodes whose bound is less
than the weakest k-th score of the node's items is left with all that is below it; the others are split
on both sides. What remains is scored with integers, best bound first. The answer is exact.

The items are dealt to blocks of about ``block_terms`` terms. For each block the documents are read
once, in parallel, for the terms that the block asks for, and what they hold of them is written below
``spark.checkpoint.dir``. A search of about ``floor_rows`` of these rows, picked by a hash of the id,
gives scores that the k-th of an item surely reaches; tasks start from them, so that few rows besides
the answer leave a task. Nothing but the answers is shuffled. The driver holds the terms of one block,
how many documents hold each, and one score per item.

Terms are :data:`TERM` with A-Z lower-cased. Null and empty texts have none and count nowhere. Rows
without document id count in the statistics and are in no answer; repeated rows are documents of their
own. Items without id take no part; rows with the same item id are one item with the terms of all.
Equal scores go by ascending document id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.columns import lower_ascii, text_or_empty
from catalens.shipping import ship_by_value
from catalens.sources.shared import shared_folder

ship_by_value(__name__)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same for UTF-8: what parts terms becomes a blank, A-Z small letters.
_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

_VECTORS = "doc_id long, n long, terms array<int>, times array<int>"
_FOUND = "item_id long, doc_id long, score long"
_FAN = 8
_CELLS = 1 << 23


def terms_of(text: Column) -> Column:
    """Array of the terms of a text."""
    return F.filter(F.split(lower_ascii(text), _BETWEEN), lambda w: w != "")


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of the documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def values(times: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Values of terms that occur ``times`` in documents of ``n`` terms."""
    m = 100 - 50 + (50 * n * documents) // length
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def _vectors(vocabulary: dict[bytes, int]):
    """Documents with the terms of the vocabulary that they hold."""
    number = vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, terms, times, ends = [], [], [], [], [0]
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.translate(_BYTES).split()
                if words:
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    kept.append(k)
                    sizes.append(len(words))
                    terms.extend(held)
                    times.extend(held.values())
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32())) for c in (terms, times)]
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            names = ["doc_id", "n", "terms", "times"]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=names)

    return run


def halved(points: np.ndarray, leaf: int = _FAN) -> np.ndarray:
    """Order of the columns of a matrix in which like ones are neighbours."""
    if points.shape[1] <= leaf:
        return np.arange(points.shape[1])
    if len(points) > 64:  # rows of widest spread
        points = points[np.argpartition(points.var(1), -64)[-64:]]
    out, open_ = [], [np.arange(points.shape[1])]
    while open_:
        part = open_.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        here = points[:, part]
        widest = here[here.var(1).argmax()]
        part = part[np.argsort(widest, kind="stable")]
        # Cut at the mean, in whole leaves, with an eighth on either side at least.
        leaves = -(-len(part) // leaf)
        cut = round(int((widest <= widest.mean()).sum()) / leaf)
        cut = min(max(cut, 1, leaves // 8), leaves - max(1, leaves // 8)) * leaf
        open_ += [part[cut:], part[:cut]]
    return np.concatenate(out)


@dataclass
class _Node:
    terms: np.ndarray
    low: int
    """Items from ``low`` to ``high`` in the order of the tree."""
    high: int
    below: list


def item_tree(items: list[np.ndarray]) -> tuple[_Node, np.ndarray]:
    """Root over items (term numbers each), and their order."""
    common, shared = np.unique(np.concatenate(items), return_counts=True)
    common = np.sort(common[np.argsort(-shared, kind="stable")[:256]])
    holds = np.array([np.isin(common, t) for t in items], np.float32).T
    order = halved(holds)
    level = [_Node(np.sort(items[i]), at, at + 1, []) for at, i in enumerate(order)]
    while len(level) > 1:
        groups = [level[k : k + _FAN] for k in range(0, len(level), _FAN)]
        level = [
            _Node(np.unique(np.concatenate([n.terms for n in g])), g[0].low, g[-1].high, g) for g in groups
        ]
    return level[0], order


class Search:
    """The k best documents of each item among those given so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int, floors: np.ndarray):
        self.root, self.order = item_tree(items)
        self.weights, self.k = weights, k
        self.least = np.maximum(floors[self.order], 1)  # only scores above 0 count
        nothing = np.zeros(0, np.int64)
        self.best = [(nothing, nothing)] * len(items)
        self.row = np.full(len(weights), -1)
        self.pairs = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, value: np.ndarray) -> None:
        """Documents by their ids and numbers of terms; terms and values one after another."""
        owner = np.repeat(np.arange(len(ids)), sizes)
        self.live, row = np.unique(terms, return_inverse=True)
        exact = np.zeros((len(self.live), len(ids)), np.int64)
        exact[row, owner] = value
        order = halved((exact * self.weights[self.live][:, None]).astype(np.float32))
        self.ids, self.levels = ids[order], [exact[:, order]]
        while self.levels[-1].shape[1] > _FAN:
            last = self.levels[-1]
            tops = np.maximum.reduceat(last, np.arange(0, last.shape[1], _FAN), axis=1)
            self.levels.append(tops.astype(np.float64))
        self.row[self.live] = np.arange(len(self.live))
        top = len(self.levels) - 1
        self._visit(self.root, top, np.arange(self.levels[top].shape[1]))
        self.row[self.live] = -1

    def _rows(self, node: _Node) -> np.ndarray:
        rows = self.row[node.terms]
        return rows[rows >= 0]

    def _bounds(self, node: _Node, rows: np.ndarray, level: int, cells: np.ndarray) -> tuple:
        """Cells that may hold an answer of the node's items, and their bounds."""
        bound = self.weights[self.live[rows]].astype(np.float64) @ self.levels[level][np.ix_(rows, cells)]
        bound = bound * (1 + 1e-9) + 1  # above any rounding
        stay = bound >= self.least[node.low : node.high].min()
        return cells[stay], bound[stay]

    def _below(self, level: int, cells: np.ndarray) -> np.ndarray:
        cells = (cells[:, None] * _FAN + np.arange(_FAN)).ravel()
        return cells[cells < self.levels[level].shape[1]]

    def _visit(self, node: _Node, level: int, cells: np.ndarray) -> None:
        rows = self._rows(node)
        if not len(rows):
            return
        if level:
            cells, bound = self._bounds(node, rows, level, cells)
            if not len(cells):
                return
        if node.below:
            if level > 1:
                level, cells = level - 1, self._below(level - 1, cells)
            for child in node.below:
                self._visit(child, level, cells)
            return
        while level > 1:
            level -= 1
            cells, bound = self._bounds(node, rows, level, self._below(level, cells))
        if not level:
            self._score(node.low, rows, cells)
            return
        best_first = np.argsort(-bound, kind="stable")
        cells, bound = cells[best_first], bound[best_first]
        at, step = 0, _FAN
        while at < len(cells) and bound[at] >= self.least[node.low]:
            self._score(node.low, rows, self._below(0, cells[at : at + step]))
            at, step = at + step, step * 2

    def _score(self, item: int, rows: np.ndarray, docs: np.ndarray) -> None:
        self.pairs += len(docs)
        score = self.weights[self.live[rows]] @ self.levels[0][np.ix_(rows, docs)]
        good = score >= self.least[item]
        if not good.any():
            return
        scores = np.concatenate([self.best[item][0], score[good]])
        ids = np.concatenate([self.best[item][1], self.ids[docs[good]]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.best[item] = scores[first], ids[first]
        if len(first) == self.k:
            self.least[item] = max(self.least[item], scores[first[-1]])


def _search(items: list, ids: np.ndarray, weights: np.ndarray, totals: tuple, k: int, floors: np.ndarray, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, weights, k, floors)
        for batch in batches:
            docs, n = (batch.column(i).to_numpy() for i in (0, 1))
            ends = batch.column(2).offsets.to_numpy()
            terms, times = (batch.column(i).values.to_numpy() for i in (2, 3))
            held = np.diff(ends)
            at = 0
            while at < len(docs):
                # As many documents as keep the matrix of a batch small.
                stop = min(at + rows, len(docs))
                columns = np.minimum(ends[at + 1 : stop + 1] - ends[at], len(weights))
                fits = np.arange(1, stop - at + 1) * columns <= _CELLS
                stop = at + max(1, int(fits.sum()))
                part = slice(ends[at], ends[stop])
                size = np.repeat(n[at:stop], held[at:stop])
                value = values(times[part].astype(np.int64), size, *totals)
                search.add(docs[at:stop], held[at:stop], terms[part], value)
                at = stop
        found = [(np.full(len(s), ids[i]), d, s) for i, (s, d) in zip(search.order, search.best)]
        columns = [np.concatenate(c) for c in zip(*found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(
    items: DataFrame,
    docs: DataFrame,
    *,
    k: int = 50,
    item_id: str = "item_id",
    doc_id: str = "doc_id",
    text: str = "text",
    block_terms: int = 500_000,
    floor_rows: int = 20_000,
    batch_rows: int = 1024,
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    asked = (
        items.select(F.col(item_id).cast("long").alias("item_id"), terms_of(text_or_empty(text)).alias("terms"))
        .filter(F.col("item_id").isNotNull())
        .select("item_id", F.explode("terms").alias("term"))
        .distinct()
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    blocks = max(1, math.ceil(asked.count() / block_terms))
    out = spark.createDataFrame([], f"{_FOUND}, rank int")
    for block in range(blocks):
        held = (
            asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
            .groupBy("item_id").agg(F.collect_list("term").alias("terms")).orderBy("item_id").toArrow()
        )
        if not held.num_rows:
            continue
        names, term = np.unique(held["terms"].combine_chunks().values.to_numpy(zero_copy_only=False), return_inverse=True)
        ends = held["terms"].combine_chunks().offsets.to_numpy()
        found = _block(texts, held["item_id"].to_numpy(), np.split(term, ends[1:-1]), names, k, floor_rows, batch_rows)
        out = out.unionByName(found) if found is not None else out
    return out.select("item_id", "rank", "doc_id", "score")


def _block(
    texts: DataFrame, ids: np.ndarray, items: list[np.ndarray], names: np.ndarray, k: int, floor_rows: int, batch_rows: int
) -> DataFrame | None:
    spark, folder = texts.sparkSession, shared_folder(texts.sparkSession, "lexical-vectors")
    vocabulary = {name.encode(): i for i, name in enumerate(names)}
    texts.mapInArrow(_vectors(vocabulary), _VECTORS).write.mode("overwrite").parquet(folder)
    vectors = spark.read.schema(_VECTORS).parquet(folder)
    documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    holding = np.zeros(len(names), np.int64)
    holding[counts["term"].to_numpy()] = counts["count"].to_numpy()
    weights = np.array([weight(documents, df) for df in holding.tolist()])
    named = vectors.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))

    def answers(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        run = _search(items, ids, weights, (documents, length), k, floors, batch_rows)
        return _ranked(rows.mapInArrow(run, _FOUND), k)

    floors = np.zeros(len(ids), np.int64)
    if documents > 4 * floor_rows:
        some = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(documents)) < floor_rows)
        last = answers(some, floors).filter(F.col("rank") == k).select("item_id", "score").toArrow()
        floors[np.searchsorted(ids, last["item_id"].to_numpy())] = last["score"].to_numpy()
    return answers(named, floors)

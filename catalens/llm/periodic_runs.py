"""Periodic runs of words, found on a grammar made by recompression.

A run is a stretch of words with smallest period q, at least ``max(least, exponent * q)`` words long,
that no neighbouring word extends. A word is dropped if a run holds it after its first q words.

Texts are put one after another, with a separator of its own between two, and shortened in rounds:
equal neighbours become one symbol with a count, then pairs of neighbours become symbols, chosen by a
bit per symbol so that equal passages are shortened alike. The levels are a run-length grammar. How far
two places agree is read from it by climbing while both stand at equal symbols and stepping down where
they differ, a whole count of equal symbols at a time, for many pairs of places at once.

A run with period q has a stretch of at least (exponent - 1) * q places that equal the place q further,
so one of them is on the grid of that width; the places on the grids of all periods are n log n
candidates, and the grammar gives the exact ends of those whose words agree.

Every text is work of its own: nothing is shuffled, and a task holds one arrow batch and the grammar of
``batch_words`` words, or of one text if that is longer (some 100 bytes a word). Null text counts as
empty; texts without words have no runs. Null ids are allowed and repeated rows are rows of their own.
Ties for the greatest exponent go to the smallest start, then period. An empty table gives no rows.
Columns but id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.shipping import ship_by_value

ship_by_value(__name__)

_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_OUT = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])
SCHEMA = (
    "doc_id long, runs array<struct<start:long,length:long,period:long>>,"
    " strongest struct<start:long,length:long,period:long>, collapsed string"
)


# Places whose extensions are looked up at once.
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Grammar:
    """All levels one after another. Neighbours stand side by side; every symbol but the top has a parent."""

    symbol: np.ndarray
    size: np.ndarray
    """Words that a symbol stands for."""
    parent: np.ndarray
    first: np.ndarray
    """First and last child; -1 for words."""
    last: np.ndarray
    counted: np.ndarray
    """Whether the parent is a count of equal symbols."""


def _counts(symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """First places of stretches of equal symbols, and their symbols: a new one per symbol and count."""
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    n = np.diff(np.append(first, len(symbols)))
    out = symbols[first]
    many = n > 1
    if many.any():
        _, named = np.unique(out[many] << 32 | n[many], return_inverse=True)
        out[many] = fresh + named
    return first, out


def _pairs(symbols: np.ndarray, fresh: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """First places of pairs and of what stays single, and their symbols."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bit = (mixed >> np.uint64(43)) & np.uint64(1)
    left = np.flatnonzero((bit[:-1] == 0) & (bit[1:] == 1))
    out = symbols.copy()
    if len(left):
        _, named = np.unique(symbols[left] << 32 | symbols[left + 1], return_inverse=True)
        out[left] = fresh + named
    single = np.ones(len(symbols), bool)
    single[left + 1] = False
    first = np.flatnonzero(single)
    return first, out[first]


def recompress(words: np.ndarray) -> Grammar:
    """Grammar of a sequence of numbers from 0 on."""
    symbols = words.astype(np.int64)
    size = np.ones(len(symbols), np.int64)
    levels = [(symbols, size, np.full(len(symbols), -1), np.full(len(symbols), -1))]
    parents, counted = [], []
    base, fresh, turn = 0, int(symbols.max()) + 1, 0
    while len(symbols) > 1:
        by_count = turn % 2 == 0
        first, out = _counts(symbols, fresh) if by_count else _pairs(symbols, fresh, turn)
        turn += 1
        if len(first) == len(symbols):
            continue
        above = base + len(symbols)
        ends = np.append(first[1:], len(symbols))
        parents.append(above + np.repeat(np.arange(len(first)), ends - first))
        counted.append(np.full(len(symbols), by_count))
        size = np.add.reduceat(size, first)
        levels.append((out, size, base + first, base + ends - 1))
        symbols, base, fresh = out, above, max(fresh, int(out.max()) + 1)
    parents.append(np.full(len(symbols), -1))
    counted.append(np.zeros(len(symbols), bool))
    held = [np.concatenate(column).astype(np.int32) for column in zip(*levels)]
    return Grammar(held[0], held[1], np.concatenate(parents).astype(np.int32), *held[2:], np.concatenate(counted))


def agree(grammar: Grammar, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from x on equal those from y on, or up to x and y where not ``forward``.

    The sequence must begin and end with words that occur once, and x differ from y.
    """
    g, edge, far = grammar, *((grammar.first, grammar.last) if forward else (grammar.last, grammar.first))
    out = np.zeros(len(x), np.int64)
    open_, x, y = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
    while len(open_):
        equal = g.symbol[x] == g.symbol[y]
        px, py = g.parent[x], g.parent[y]
        climb = equal & (px >= 0)
        climb &= (edge[px] == x) & (edge[py] == y) & (g.symbol[px] == g.symbol[py])
        step = equal & ~climb
        if step.any():
            left = np.ones(len(x), np.int64)
            many = step & g.counted[x]
            left[many] = 1 + np.minimum(abs(far[px[many]] - x[many]), abs(far[py[many]] - y[many]))
            out[open_[step]] += left[step] * g.size[x[step]]
            move = np.where(step, left if forward else -left, 0)
        else:
            move = 0
        lower_x, lower_y = edge[x], edge[y]
        x, y = (
            np.where(equal, np.where(climb, px, x + move), lower_x),
            np.where(equal, np.where(climb, py, y + move), lower_y),
        )
        going = x >= 0
        open_, x, y = open_[going], x[going], y[going]
    return out


def _candidates(words: np.ndarray, most: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places on the grids of the periods up to ``most`` where a run may lie, and the periods."""
    places, periods, held = [], [], 0
    for q in range(1, most + 1):
        at = words[: len(words) - q : (exponent - 1) * q] == words[q :: (exponent - 1) * q]
        at = np.flatnonzero(at) * ((exponent - 1) * q)
        if q > 1 and len(at):  # the stretch has three places or more: a neighbour agrees too
            at = at[(words[at + 1] == words[at + 1 + q]) | (words[at - 1] == words[at - 1 + q])]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held and (held >= _CHUNK or q == most):
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0


def _distinct(found: np.ndarray) -> np.ndarray:
    """Stretches with their smallest period: a multiple of the period gives the same stretch."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def find_runs(texts: list[np.ndarray], least: int = 6, exponent: int = 4) -> list[np.ndarray]:
    """Per text, a sequence of numbers: rows (start, length, period) by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    apart = int(max((t.max() for t in texts if len(t)), default=0)) + 1
    parts = [np.array([apart])]
    for k, t in enumerate(texts):
        parts += [t, np.array([apart + 1 + k])]
    words = np.concatenate(parts).astype(np.int64)
    begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    found, grammar = np.zeros((0, 3), np.int64), None
    for at, q in _candidates(words, int(lengths.max(initial=0)) // exponent, exponent):
        grammar = grammar or recompress(words)
        ahead = agree(grammar, at, at + q, True)
        behind = agree(grammar, at - 1, at + q - 1, False)
        long = ahead + behind + q >= np.maximum(least, exponent * q)
        stretches = np.stack([at - behind, ahead + behind + q, q], 1)[long]
        found = _distinct(np.concatenate([found, stretches]))
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = np.searchsorted(begin, found[:, 0], "right") - 1
    found[:, 0] -= begin[owner]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts))))


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period."""
    best = None
    for start, length, q in runs.tolist():
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    return best


Change = Callable[[int | None, list[bytes]], list[bytes]]


def _rows(ids: list, texts: list[list[bytes]], least: int, exponent: int) -> pa.RecordBatch:
    numbers: dict = defaultdict(count().__next__)
    coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]
    found = find_runs(coded, least, exponent)
    named = [[dict(zip(_RUN.names, r)) for r in runs.tolist()] for runs in found]
    best = [strongest(runs) for runs in found]
    kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, found)], pa.binary())
    columns = [ids, named, [top and dict(zip(_RUN.names, top)) for top in best], kept.cast(pa.string())]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT
    )


def periodic_runs(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 6,
    exponent: int = 4,
    batch_words: int = 1 << 17,
    change: Change | None = None,
) -> DataFrame:
    """Per document all runs by start, then period, the strongest run, and the text without repeats.

    ``exponent`` (3 or more) and ``least`` (greater than it) bound the runs from below. ``change``
    turns the words of a document, given its id, into those that are searched.
    """
    if exponent < 3 or least <= exponent:
        raise ValueError("exponent must be 3 or more, and least greater than it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # Splitting bytes parts words at blanks, tabs and line ends only.
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if change:
                texts = [change(i, t) for i, t in zip(ids, texts)]
            # Texts of like length together: periods are tried up to a part of the longest.
            group: list[int] = []
            held = 0
            for k in sorted(range(len(ids)), key=lambda k: -len(texts[k])):
                if group and held + len(texts[k]) > batch_words:
                    yield _rows([ids[j] for j in group], [texts[j] for j in group], least, exponent)
                    group, held = [], 0
                group.append(k)
                held += len(texts[k])
            if group:
                yield _rows([ids[j] for j in group], [texts[j] for j in group], least, exponent)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)

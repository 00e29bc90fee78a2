"""Packing of token sequences under several limits at once.

Vector bin packing: a sequence has room for tokens, for segments and for loss-bearing tokens. The next
example for an open sequence is the one whose demand has the greatest dot product with the room that
is left, both as shares of the limits, among those that fit. Where none fits, an example may be cut to
fill the rest. A sequence that stays short is cut into powers of two, which need no padding.

Examples are dealt to groups of bounded size by a hash of their own values, so that a group fits a
task, an uneven source spreads, and a task that runs again packs the same sequences. Within a group
rows are ordered by their values; equal rows are interchangeable.

Null text counts as empty: one piece with the end id alone. Null or repeated document ids are packed
like others, a row for each. An empty table gives no rows. Columns but id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.tokenizing import encoder
from catalens.shipping import ship_by_value

ship_by_value(__name__)


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


@dataclass(frozen=True)
class Placed:
    """``length`` tokens of an example from ``start`` on, at ``offset`` of sequence ``bin``."""

    item: int
    start: int
    length: int
    bin: int
    offset: int


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Sequences of whole examples. Each example must fit an empty sequence."""
    return [[item for item, _, _ in held] for held in _fill(tokens, loss, limits, cut=False)]


def place_cut(lengths: np.ndarray, limits: Limits) -> list[Placed]:
    """Pieces of examples whose every token but the first of a piece bears loss.

    All sequences hold ``limits.tokens`` or a power of two, unless the segments run out.
    """
    out = []
    bins = 0
    for held in _fill(lengths, np.maximum(lengths - 1, 0), limits, cut=True):
        rest = sum(n for _, _, n in held)
        room = rest if rest == limits.tokens else 1 << (rest.bit_length() - 1)
        at = 0
        for item, start, n in held:
            while n:
                take = min(n, room - at)
                out.append(Placed(item, start, take, bins, at))
                start, n, at, rest = start + take, n - take, at + take, rest - take
                if at == room and rest:
                    bins, at, room = bins + 1, 0, 1 << (rest.bit_length() - 1)
        bins += 1
    return out


def _fill(tokens, loss, limits: Limits, cut: bool) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, tokens)."""
    # Examples with equal demand are one class; its members are taken in the given order.
    demand, member = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    waiting: list[list[tuple[int, int]]] = [[] for _ in demand]
    for item in range(len(tokens) - 1, -1, -1):
        waiting[member[item]].append((item, 0))
    if cut:  # what is left of a cut example needs a class of its own length
        index = {int(t): k for k, (t, _) in enumerate(demand)}
        missing = [t for t in range(1, limits.tokens) if t not in index]
        demand = np.concatenate([demand, [[t, t - 1] for t in missing]]) if missing else demand
        waiting += [[] for _ in missing]
        index |= {t: len(index) + k for k, t in enumerate(missing)}
    alive = np.array([bool(w) for w in waiting])
    share_t, share_l = demand[:, 0] / limits.tokens, demand[:, 1] / limits.loss
    left = len(tokens)
    while left:
        held: list[tuple[int, int, int]] = []
        room_t, room_s, room_l = limits.tokens, limits.segments, limits.loss
        while left and room_t and room_s:
            fits = alive & (demand[:, 0] <= room_t) & (demand[:, 1] <= room_l)
            gain = (
                share_t * (room_t / limits.tokens)
                + share_l * (room_l / limits.loss)
                + (room_s / limits.segments) / limits.segments
            )
            gain[~fits] = -1
            k = int(gain.argmax())
            if fits[k]:
                item, start = waiting[k].pop()
                n, bears = int(demand[k, 0]), int(demand[k, 1])
            elif cut and room_l >= room_t - 1:
                # The shortest that is too long: what is left of it stays small.
                k = int(np.where(alive, demand[:, 0], np.iinfo(np.int64).max).argmin())
                item, start = waiting[k].pop()
                n, bears = room_t, room_t - 1
                rest = index[int(demand[k, 0]) - n]
                waiting[rest].append((item, start + n))
                alive[rest], left = True, left + 1
            else:
                break
            alive[k] = bool(waiting[k])
            left -= 1
            held.append((item, start, n))
            room_t, room_s, room_l = room_t - n, room_s - 1, room_l - bears
        if not held:
            raise ValueError("an example does not fit an empty sequence")
        yield held


PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long"
)
_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _pieces(tokenizer: str, size: int, end_id: int, width: str):
    """Rows of a document: its full sequences, and the ids of what is left."""
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        + [("ids", pa.binary())]
    )

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                n = len(ids)
                for at in range(0, n, size):
                    piece = ids[at : at + size]
                    kept = None if len(piece) == size else piece.astype(width).tobytes()
                    rows.append((doc_id, at, len(piece), _crc(piece), n, kept))
                if len(rows) >= 20_000:
                    yield _table(rows, schema)
                    rows = []
            yield _table(rows, schema)

    return run


def _packed(limits: Limits, groups: int, width: str):
    schema = pa.schema(
        [
            (n, pa.int64())
            for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        ]
    )

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        number = key[0].as_py()
        group = group.sort_by(
            [("length", "descending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending"),
             ("doc_id", "ascending"), ("start", "ascending")]
        )
        whole = group.filter(pa.compute.is_null(group["ids"]))
        cut = group.filter(pa.compute.is_valid(group["ids"]))
        made = whole.num_rows
        rows = [
            (d, s, n, c, t, number + k * groups, 0)
            for k, (d, s, n, c, t) in enumerate(
                zip(*(whole[x].to_pylist() for x in schema.names[:5]))
            )
        ]
        docs, starts, total = (cut[x].to_pylist() for x in ("doc_id", "start", "doc_tokens"))
        crcs, held = cut["ids_crc32"].to_pylist(), cut["ids"]
        lengths = np.asarray(cut["length"].to_numpy(), np.int64)
        for p in place_cut(lengths, limits) if len(lengths) else ():
            crc = crcs[p.item]
            if p.length < lengths[p.item]:
                ids = np.frombuffer(held[p.item].as_py(), width)[p.start : p.start + p.length]
                crc = _crc(ids)
            rows.append(
                (docs[p.item], starts[p.item] + p.start, p.length, crc, total[p.item],
                 number + (made + p.bin) * groups, p.offset)
            )
        return pa.Table.from_batches([_table(rows, schema)])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limits: Limits = Limits(),
    end_id: int = 0,
    rows_per_group: int = 4000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: file of a tokenizer that every executor can open. A document's ids are those of its
    text and then ``end_id``; each is in exactly one piece. ``rows_per_group`` bounds what one task
    packs at a time: the number of groups follows from the number of documents.
    """
    import json

    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id]
    width = "<u2" if max(ids) < 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, -(-rows.count() // rows_per_group))
    cut = rows.mapInArrow(_pieces(tokenizer, limits.tokens, end_id, width), _CUT)
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups))
    return cut.groupBy(group.alias("group")).applyInArrow(_packed(limits, groups, width), PIECE)

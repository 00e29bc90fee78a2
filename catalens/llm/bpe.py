"""BPE encoding that encodes a chunk of text once, however many documents hold it.

A rolling hash over the characters cuts texts into chunks, so that the same passage gets the same cuts
wherever it stands. Chunks that two different texts hold are encoded at one of their places; all other
text is encoded where it stands, from one shared chunk to the next. Text encoded in parts can differ at
the joins, so the ids of a part count only between its first and last *seam*, a place where the
pre-tokenizer must split whatever stands around it. What is left at the joins is put together and
encoded anew, over as many parts as it takes to reach the next seam on either side; from there on the
ids agree with those of the whole text.

Equal texts are encoded once. Null text counts as empty: no ids. Null or repeated document ids get a
row for each row of the input. An empty table gives no rows. Columns but id and text are not read.

The shared chunks' ids travel to the texts that hold them, so these are the only ids that Spark shuffles;
the parts' ids are written once below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm.columns import text_or_empty
from catalens.llm.tokenizing import encoder
from catalens.shipping import ship_by_value
from catalens.sources.shared import shared_folder

ship_by_value(__name__)

#: A white-space character behind another character: every byte-level pre-tokenizer token that
#: holds the one ends there, and the next begins with the white space.
_SEAM = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")


@dataclass(frozen=True)
class Chunking:
    """Chunks end where the hash of the last ``window`` characters has ``bits`` zero bits."""

    bits: int = 10
    window: int = 16
    least: int = 256
    most: int = 8192


def _gear(n: int = 1 << 12) -> np.ndarray:
    """A fixed number for each character, by its lowest bits: the multiplier of a known generator."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(6364136223846793005)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(1442695040888963407) >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def cuts(text: str, c: Chunking) -> list[int]:
    """Ends of the chunks of a text, the last one included."""
    n = len(text)
    if n <= c.least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 4095]
    width = 1
    while width < c.window:  # the sum over a window doubles
        later = h.copy()
        later[width:] += h[:-width] << np.uint32(width)
        h, width = later, 2 * width
    out, last = [], 0
    # The upper bits depend on the whole window.
    for end in (np.flatnonzero(h >> np.uint32(32 - c.bits) == 0) + 1).tolist():
        while end - last > c.most:
            last += c.most
            out.append(last)
        if end - last >= c.least and n - end >= c.least:
            out.append(end)
            last = end
    while n - last > c.most:
        last += c.most
        out.append(last)
    return [*out, n]


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def seams(text: str) -> tuple[int, int]:
    """First and last seam of a text; (-1, -1) without any."""
    first = _SEAM.search(text)
    if not first:
        return -1, -1
    last = max(text.rfind(" "), text.rfind("\n"))
    while not _SEAM.match(text, last):
        last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
    return first.start(), last


_PART = pa.struct([("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string())])


def encode_part(text: str, encode, width: str) -> dict:
    """Ids between the first and last seam, and the text on either side; without seam, all is head."""
    first, last = seams(text)
    if first < 0:
        return {"head": text, "ids": None, "tail": ""}
    ids = encode(text[first:last]).astype(width).tobytes()
    return {"head": text[:first], "ids": ids, "tail": text[last:]}


def join_parts(parts: list[dict], encode, width: str) -> np.ndarray:
    """Ids of the whole text: each join is encoded anew from seam to seam."""
    out, open_text = [], ""
    for part in parts:
        open_text += part["head"]
        if part["ids"] is not None:
            if open_text:
                out.append(encode(open_text))
            out.append(np.frombuffer(part["ids"], width).astype(np.uint32))
            open_text = part["tail"]
    if open_text:
        out.append(encode(open_text))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _chunks(c: Chunking):
    """A row per chunk of each text: the text's key, the chunk's place and digest."""
    schema = pa.schema(
        [("key", pa.binary()), ("start", pa.int32()), ("size", pa.int32()), ("chunk", pa.binary())]
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, starts, sizes, digests = [], [], [], []
                part = batch.slice(at, 500)
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text, start = text.as_py(), 0
                    for end in cuts(text, c):
                        keys.append(key)
                        starts.append(start)
                        sizes.append(end - start)
                        digests.append(_digest(text[start:end]))
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip((keys, starts, sizes, digests), schema)],
                    schema=schema,
                )

    return run


_ENCODED = (
    "key binary, whole boolean, n_tokens long, ids_sha256 binary, decoded_sha256 binary,"
    " n int, part struct<head: string, ids: binary, tail: string>, chunk binary"
)
_ENCODED_SCHEMA = pa.schema(
    [
        ("key", pa.binary()), ("whole", pa.bool_()), ("n_tokens", pa.int64()),
        ("ids_sha256", pa.binary()), ("decoded_sha256", pa.binary()), ("n", pa.int32()),
        ("part", _PART), ("chunk", pa.binary()),
    ]
)


class _Digests:
    """Digests of ids and of the text they decode to."""

    def __init__(self, tokenizer: str):
        self.coder = encoder(tokenizer)
        self.decimal = self.coder.decimal
        self.width = "<u2" if self.coder.size <= 1 << 16 else "<u4"

    def of(self, ids: np.ndarray, common: bool) -> tuple[int, bytes, bytes]:
        plain = ids.tolist()
        line = ",".join([self.decimal[i] for i in plain])
        text = self.coder.decode(ids, common)
        return (
            len(plain),
            hashlib.sha256(line.encode()).digest(),
            hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(),
        )


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema
    )


def _encoded(tokenizer: str):
    """For a text without shared chunks its digests; else its own parts, references to shared chunks,
    and the shared chunks that are to be encoded here."""

    def run(batches):
        digests = _Digests(tokenizer)
        encode, width = digests.coder.encode, digests.width
        for batch in batches:
            rows, held = [], 0
            for key, text, shared in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            ):
                text = text.as_py()
                if not shared:
                    n, ids, decoded = digests.of(encode(text), digests.coder._common(text))
                    rows.append({"key": key, "whole": True, "n_tokens": n, "ids_sha256": ids,
                                 "decoded_sha256": decoded})
                else:
                    at = n = 0
                    for s in sorted(shared, key=lambda s: s["start"]):
                        if s["start"] > at:
                            part = encode_part(text[at : s["start"]], encode, width)
                            held += len(part["ids"] or b"")
                            rows.append({"key": key, "whole": False, "n": n, "part": part})
                            n += 1
                        at = s["start"] + s["size"]
                        rows.append({"key": key, "whole": False, "n": n, "chunk": s["chunk"]})
                        n += 1
                        if s["here"]:
                            part = encode_part(text[s["start"] : at], encode, width)
                            rows.append({"whole": False, "part": part, "chunk": s["chunk"]})
                    if at < len(text):
                        part = encode_part(text[at:], encode, width)
                        held += len(part["ids"] or b"")
                        rows.append({"key": key, "whole": False, "n": n, "part": part})
                if len(rows) > 2000 or held > 8 << 20:
                    yield _rows(rows, _ENCODED_SCHEMA)
                    rows, held = [], 0
            yield _rows(rows, _ENCODED_SCHEMA)

    return run


_DIGESTS = "key binary, n_tokens long, ids_sha256 binary, decoded_sha256 binary"


def _joined(tokenizer: str):
    schema = pa.schema([_ENCODED_SCHEMA.field(n) for n in ("key", "n_tokens", "ids_sha256", "decoded_sha256")])

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        digests = _Digests(tokenizer)
        parts = group.sort_by("n")["part"].to_pylist()
        ids = join_parts(parts, digests.coder.encode, digests.width)
        n, a, b = digests.of(ids, False)
        return pa.Table.from_batches(
            [_rows([{"key": key[0].as_py(), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}], schema)]
        )

    return run


def shared_chunks(texts: DataFrame, c: Chunking) -> DataFrame:
    """Per text (key) the chunks that other texts hold as well: start, size, chunk, here.

    here: this place is the one at which the chunk is encoded. ``texts``: key, text, keys unique.
    """
    found = texts.mapInArrow(_chunks(c), "key binary, start int, size int, chunk binary")
    place = F.struct("key", "start")
    repeated = found.groupBy("chunk").agg(F.count("*").alias("n"), F.min(place).alias("owner"))
    repeated = repeated.filter("n > 1").select("chunk", "owner")
    return (
        found.join(repeated, "chunk")
        .groupBy("key")
        .agg(
            F.collect_list(
                F.struct("start", "size", "chunk", (place == F.col("owner")).alias("here"))
            ).alias("shared")
        )
    )


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    chunking: Chunking = Chunking(),
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per document.

    ``tokenizer``: file of a byte-level BPE tokenizer that every executor can open.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")
    ).withColumn("key", F.unhex(F.md5("text")))
    # One text per key; copies are combined before the shuffle.
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    shared = shared_chunks(texts, chunking)
    folder = shared_folder(spark, "bpe")
    (
        texts.join(shared, "key", "left").select("key", "text", "shared")
        .mapInArrow(_encoded(tokenizer), _ENCODED)
        .write.mode("overwrite").parquet(folder)
    )
    encoded = spark.read.schema(_ENCODED).parquet(folder)
    whole = encoded.filter("whole").select("key", "n_tokens", "ids_sha256", "decoded_sha256")
    parts = encoded.filter("not whole")
    chunks = parts.filter("key is null").select("chunk", "part")
    own = parts.filter("key is not null and chunk is null").select("key", "n", "part")
    lent = parts.filter("key is not null and chunk is not null").select("key", "n", "chunk")
    joined = (
        own.unionByName(lent.join(chunks, "chunk").select("key", "n", "part"))
        .groupBy("key").applyInArrow(_joined(tokenizer), _DIGESTS)
    )
    return (
        rows.select("doc_id", "key").join(whole.unionByName(joined), "key")
        .select(
            "doc_id", "n_tokens",
            *(F.lower(F.hex(c)).alias(c) for c in ("ids_sha256", "decoded_sha256")),
        )
    )

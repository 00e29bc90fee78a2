"""Toxic documents by a convolutional classifier on hashed words.

A word's vector is the sum of rows of a hashed table: two for the word itself, one for each of its
beginnings, one for its end; words that only meet in one row still differ. Filters of several widths slide over the words of a whole text; the greatest answer of
each filter goes through a linear layer. As only the greatest answers pass, gradients touch few rows.
Rows of fewer than ``min_texts`` texts, and those that training never touched, are zero: unknown words
say nothing.

Words are runs of letters in lower case. A text's language is guessed from its own frequent words, and
each language gets the threshold that errs least on labelled rows kept from training; languages with
few such rows share one. A score is the logistic function of the distance from that threshold.

The model is fitted on the whole texts of all labelled rows. They are dealt by hash to blocks of about
``block_rows`` rows and ``block_chars`` characters, kept as word numbers below ``spark.checkpoint.dir``. In
an epoch each block goes on alone from the common network, in numpy; the changes are then averaged, those of
a row of the table over the blocks that changed it. The driver sees the network, never texts; texts per row
and errors per threshold are counted over all blocks, on Spark. One block is plain training.
All documents are scored where they lie, without a shuffle; a task holds one arrow batch and the
answers of some ``_PIECE`` words, however long a text is.

Null text counts as empty; empty texts get a score like any other. Labels other than 0 and 1 are left
out; without rows of both classes every score is 0.5 less a little, so that nothing is called toxic.
Null or repeated ids: a row for each row of the input; labels belong to all rows with their id. An
empty table gives no rows. Columns but id and text are not read.
"""

from __future__ import annotations

import copy
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.components import shuffles_removed, written
from catalens.shipping import ship_by_value
from catalens.sources.shared import shared_folder

ship_by_value(__name__)

_WORD = re.compile(r"[^\W\d_]+")
_ROWS = 1 << 18
_PAD = _ROWS  # a row of zeros after the hashed ones
_BEGINNINGS = (3, 4, 5, 6, 7)
_WIDTHS = (1, 2, 3)
_REACH = max(_WIDTHS) - 1
_KINDS = len(_BEGINNINGS) + 3  # rows of a word
_PIECE = 1 << 15
_MEMO = 1 << 19

# Frequent words of which the other languages here have none.
_LANGUAGES = {
    "en": "the of and to is that with was for it",
    "de": "der die und das nicht mit ist zu von ein",
    "fr": "le les des est et pas dans sur pour par",
    "es": "el los las y del por con se lo su",
}
_OWNER = {word: k for k, words in enumerate(_LANGUAGES.values()) for word in words.split()}
N_LANGUAGES = len(_LANGUAGES) + 1


# Checksums go on from the letter that tells kinds apart.
_WHOLE, _BEGINS, _ENDS = [zlib.crc32(b) for b in (b"0", b"1")], zlib.crc32(b"^"), zlib.crc32(b"$")


def _steps() -> np.ndarray:
    """How a checksum's last byte turns the rest when a byte is added, as zlib does it."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _steps()


def _checksums(cuts: list[bytes], width: int, start: int) -> list[np.ndarray]:
    """Checksums after each of ``width`` bytes of every string, that many or more of which it has."""
    letters = np.array(cuts, f"S{width}").view(np.uint8).reshape(-1, width)
    crc, out = np.full(len(cuts), ~start & 0xFFFFFFFF, np.uint32), []
    for k in range(width):
        crc = _STEPS[(crc ^ letters[:, k]) & 0xFF] ^ crc >> 8
        out.append(~crc)
    return out


def _features(words: list[str]) -> np.ndarray:
    """Rows of words: two of its own, and one per beginning and for its end."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.full((len(words), _KINDS), _PAD, np.int32)
    for k, kind in enumerate(_WHOLE):
        rows[:, k] = np.fromiter((zlib.crc32(b, kind) for b in coded), np.uint32, len(words)) % _ROWS
    begun = _checksums([b[: _BEGINNINGS[-1]] for b in coded], _BEGINNINGS[-1], _BEGINS)
    for k, n in enumerate(_BEGINNINGS):
        rows[:, 2 + k] = np.where(sizes > n, begun[n - 1] % _ROWS, _PAD)
    ended = _checksums([b[-4:] for b in coded], 4, _ENDS)[-1]
    rows[:, -1] = np.where(sizes > 4, ended % _ROWS, _PAD)
    # Where characters take several bytes, cuts are between characters.
    for i in np.flatnonzero(sizes != np.fromiter(map(len, coded), np.int64, len(words))).tolist():
        word = words[i]
        cuts = [(word[:n], _BEGINS) if len(word) > n else None for n in _BEGINNINGS]
        cuts.append((word[-4:], _ENDS) if len(word) > 4 else None)
        rows[i, 2:] = [
            zlib.crc32(cut[0].encode("utf-8", "surrogatepass"), cut[1]) % _ROWS if cut else _PAD for cut in cuts
        ]
    return rows


class Words(dict):
    """Words met so far with their numbers; number 0 stands for no word."""

    def __init__(self):
        self[""] = 0
        self.owners = array("b", [N_LANGUAGES - 1])

    def rows(self, first: int = 0) -> np.ndarray:
        """Rows of the words from number ``first`` on."""
        words = list(itertools.islice(self, max(first, 1), None))  # in the order of their numbers
        parts = [words[at : at + _PIECE] for at in range(0, len(words), _PIECE)]
        none = np.full((0 if first else 1, _KINDS), _PAD, np.int32)
        return np.concatenate([none, *map(_features, parts)])

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.owners.append(_OWNER.get(word, N_LANGUAGES - 1))
        return number

    def numbers(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def language(self, text: np.ndarray, owners: np.ndarray) -> int:
        """Number of the language whose frequent words a text has most of; the last for none."""
        votes = np.bincount(owners[text], minlength=N_LANGUAGES)[:-1]
        return int(votes.argmax()) if votes.any() else N_LANGUAGES - 1


@dataclass
class Model:
    table: np.ndarray
    """Hashed table: rows + 1 x dimensions, the last row zero."""
    filters: list[np.ndarray]
    """Per width: width x dimensions x filters."""
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: np.ndarray
    """Per language, on the output."""
    spread: float


def _vectors(model: Model, rows: np.ndarray) -> np.ndarray:
    return model.table[rows].sum(1)


def _answers(filters: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Answers of the filters at each place that has ``_REACH`` further ones."""
    places = len(vectors) - _REACH
    out = []
    for width, f in zip(_WIDTHS, filters):
        answer = vectors[:places] @ f[0]
        for j in range(1, width):
            answer += vectors[j : places + j] @ f[j]
        out.append(answer)
    return np.concatenate(out, axis=1)


def _padded(text: np.ndarray) -> np.ndarray:
    """A text with no-words after it, so that it has one place more than words."""
    return np.concatenate([text, np.zeros(_REACH + 1, np.int32)])


def outputs(model: Model, texts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Output of the network per text, given the vectors of the words' numbers."""
    tops = np.full((len(texts), len(model.bias)), -np.inf, np.float32)

    def pool(parts: list[tuple[int, np.ndarray]]) -> None:
        sizes = np.array([len(words) for _, words in parts])
        ends = np.cumsum(sizes)
        words = np.concatenate([words for _, words in parts] + [np.zeros(_REACH, np.int32)])
        answers = _answers(model.filters, vectors[words])
        for r in range(_REACH):  # windows that would reach into the next part
            answers[ends - 1 - r] = -np.inf
        best = np.maximum.reduceat(answers, ends - sizes, axis=0)
        for (text, _), top in zip(parts, best):
            np.maximum(tops[text], top, out=tops[text])

    parts, held = [], 0
    for k, text in enumerate(texts):
        words = _padded(text)
        for at in range(0, len(text) + 1, _PIECE):
            parts.append((k, words[at : at + _PIECE + _REACH]))
            held += len(parts[-1][1])
            if held >= _PIECE:
                pool(parts)
                parts, held = [], 0
    if parts:
        pool(parts)
    return np.maximum(tops + model.bias, 0) @ model.out + model.shift


def _added(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct targets and the sums of their rows."""
    order = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
    return to[order[first]], np.add.reduceat(values[order], first, axis=0)


class Training:
    """The network while it learns: steps of descent whose rates follow the squares of the gradients so far."""

    def __init__(self, dim: int, filters: int, seed: int):
        random = np.random.default_rng(seed)
        table = random.normal(0, 0.05, (_ROWS + 1, dim)).astype(np.float32)
        table[_PAD] = 0
        n_out = filters * len(_WIDTHS)
        self.model = Model(
            table,
            [random.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters)).astype(np.float32) for w in _WIDTHS],
            np.zeros(n_out, np.float32), np.abs(random.normal(0, 0.3, n_out)).astype(np.float32), 0.0,
            np.zeros(N_LANGUAGES), 1.0,
        )
        self.seen = [np.full(p.shape, 1e-4, np.float32) for p in self.dense()]
        self.seen_rows = np.full(_ROWS + 1, 1e-4, np.float32)
        self.seen_shift = 1e-4
        self.touched = np.zeros(_ROWS + 1, bool)

    def dense(self) -> list[np.ndarray]:
        return [*self.model.filters, self.model.bias, self.model.out]

    def epoch(
        self, texts: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, importance: np.ndarray,
        random: np.random.Generator, rate: float = 0.1, batch: int = 32,
    ) -> np.ndarray:
        """One pass over padded texts. Which rows of the table it changed."""
        model, dim, filters = self.model, self.model.table.shape[1], self.model.filters[0].shape[2]
        changed = np.zeros(_ROWS + 1, bool)
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            words = np.concatenate([texts[i] for i in some])
            sizes = np.array([len(texts[i]) for i in some])
            starts = np.cumsum(sizes) - sizes
            # Some words are left out each time, so that no single one is relied on.
            words = np.where(random.random(len(words)) < 0.2, 0, words)
            distinct, place = np.unique(words, return_inverse=True)
            vectors = _vectors(model, rows[distinct])
            top, best = _tops(model, vectors, place, starts, sizes)
            pooled = best + model.bias
            hidden = np.maximum(pooled, 0)
            chance = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift, -30, 30)))
            error = ((chance - labels[some]) * importance[labels[some]] / len(some)).astype(np.float32)
            back = error[:, None] * model.out * (pooled > 0)
            grads = [np.zeros_like(f) for f in model.filters]
            to_words, amounts = [], []
            for w, width in enumerate(_WIDTHS):
                mine = slice(w * filters, (w + 1) * filters)
                for j in range(width):
                    grads[w][j] = np.einsum("nf,nfd->df", back[:, mine], vectors[place[top[:, mine] + j]])
                    to_words.append(words[top[:, mine] + j].ravel())
                    amounts.append((back[:, mine, None] * model.filters[w][j].T).reshape(-1, dim))
            grads += [back.sum(0), error @ hidden]
            which, amount = _added(np.concatenate(amounts), np.concatenate(to_words))
            kinds = rows.shape[1]
            which, amount = _added(np.repeat(amount, kinds, axis=0), rows[which].ravel())
            for p, g, s in zip(self.dense(), grads, self.seen):
                s += g * g
                p -= rate * g / np.sqrt(s)
            self.seen_shift += float(error.sum()) ** 2
            model.shift -= rate * float(error.sum()) / self.seen_shift**0.5
            self.seen_rows[which] += (amount * amount).mean(1)
            model.table[which] -= rate * amount / np.sqrt(self.seen_rows[which])[:, None]
            changed[which] |= (amount != 0).any(1)
            model.table[_PAD] = 0
        changed[_PAD] = False
        self.touched |= changed
        return changed

    def state(self) -> list[np.ndarray]:
        """What an epoch changes, first what belongs to rows of the table."""
        shifts = np.array([self.model.shift, self.seen_shift])
        return [self.model.table, self.seen_rows, *self.dense(), *self.seen, shifts]

    def changes(self, before: list[np.ndarray], changed: np.ndarray) -> np.ndarray:
        """The changes since ``before``, which rows of the table changed, and 1 for the block, in a row."""
        out = np.empty(sum(b.size for b in before) + len(changed) + 1, np.float32)
        at = 0
        for a, b in zip(self.state(), before):
            out[at : at + a.size] = (a - b).ravel()
            at += a.size
        out[at:-1], out[-1] = changed, 1
        return out

    def add(self, sums: np.ndarray) -> None:
        """Take the mean of the changes of all blocks."""
        n, sums = sums[-1], sums[:-1]
        times = sums[-(_ROWS + 1) :]
        at = 0
        for k, p in enumerate(self.state()):
            change = sums[at : at + p.size].reshape(p.shape)
            at += p.size
            if k < 2:
                change = change / np.maximum(times, 1).reshape(-1, *[1] * (p.ndim - 1))
                p += change.astype(np.float32)
            elif p.dtype == np.float32:
                p += (change / n).astype(np.float32)
            else:
                self.model.shift += float(change[0] / n)
                self.seen_shift += float(change[1] / n)
        self.touched |= times > 0

    def finished(self) -> Model:
        self.model.table[~self.touched] = 0
        return self.model


def _tops(
    model: Model, vectors: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per text and filter the place of the greatest answer and that answer, some ``_PIECE`` words at a time."""
    top = np.zeros((len(starts), len(model.bias)), np.int64)
    best = np.full(top.shape, -np.inf, np.float32)
    for at in range(0, len(place), _PIECE):
        piece = vectors[place[at : at + _PIECE + _REACH]]
        missing = min(_PIECE, len(place) - at) + _REACH - len(piece)
        piece = np.concatenate([piece, np.zeros((missing, piece.shape[1]), np.float32)])
        answers = _answers(model.filters, piece)
        for k in range(int(np.searchsorted(starts, at, "right")) - 1, len(starts)):
            if starts[k] >= at + _PIECE:
                break
            first, last = max(starts[k] - at, 0), starts[k] + sizes[k] - _REACH - at
            mine = answers[first:last]
            if last <= first or not len(mine):
                continue
            here = mine.argmax(0)
            value = mine[here, np.arange(len(here))]
            better = value > best[k]
            top[k], best[k] = np.where(better, at + first + here, top[k]), np.where(better, value, best[k])
    return top, best


def _texts_of_rows(texts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """In how many texts each row of the table occurs."""
    in_texts = np.zeros(_ROWS + 1, np.int64)
    for text in texts:
        in_texts[np.unique(rows[np.unique(text)])] += 1
    return in_texts


def _importance(n: int, toxic: int) -> np.ndarray:
    """By label, so that both classes weigh the same."""
    return np.array([0.5 * n / (n - toxic), 0.5 * n / toxic], np.float32)


def _train(
    texts: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, dim: int, filters: int, epochs: int,
    min_texts: int, seed: int,
) -> Model:
    # Rows of too few texts stay zero: they could only be learned by heart.
    rows = np.where(_texts_of_rows(texts, rows)[rows] >= min_texts, rows, _PAD)
    training = Training(dim, filters, seed)
    padded, importance = [_padded(t) for t in texts], _importance(len(labels), int(labels.sum()))
    for k in range(epochs):
        training.epoch(padded, rows, labels, importance, np.random.default_rng([seed, k, 0]))
    return training.finished()


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among those that leave the fewest rows of either class wrong."""
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
    wrong = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    loss = missed + wrong
    cut = max(np.flatnonzero(loss <= loss.min() + 1e-12), key=lambda k: gap[k])
    return float(edges[cut] + edges[cut + 1]) / 2


def _kept(labels: np.ndarray, every: int, block: int) -> np.ndarray:
    """Which rows calibrate; blocks begin to count at different rows, so that small ones give some together."""
    part = np.zeros(len(labels), bool)
    for y in (0, 1):
        part[np.flatnonzero(labels == y)[every - 1 - block % every :: every]] = True
    return part


def fit(
    texts: list[str | None], labels: np.ndarray, *, dim: int = 8, filters: int = 8, epochs: int = 8,
    min_texts: int = 3, kept_back: int = 4, least: int = 20, seed: int = 11,
) -> Model | None:
    """Network and thresholds of texts at hand; None without both classes. See :func:`fit_all` for tables.

    Every ``kept_back``-th row of a class calibrates. A language with fewer than ``least`` of them of
    either class has the threshold of all rows.
    """
    part = _kept(labels, kept_back, 0)
    if len(np.unique(labels[~part])) < 2:
        return None
    words = Words()
    texts = [words.numbers(t) for t in texts]
    rows, owners = words.rows(), np.array(words.owners)
    train = np.flatnonzero(~part)
    model = _train([texts[i] for i in train], rows, labels[train], dim, filters, epochs, min_texts, seed)
    check = np.flatnonzero(part) if len(np.unique(labels[part])) == 2 else train
    given, y = outputs(model, [texts[i] for i in check], _vectors(model, rows)), labels[check]
    spoken = np.array([words.language(texts[i], owners) for i in check])
    model.thresholds[:] = _threshold(given, y)
    for lang in range(N_LANGUAGES):
        mine = spoken == lang
        if min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= least:
            model.thresholds[lang] = _threshold(given[mine], y[mine])
    model.spread = max(float(np.std(given)) / 2, 1e-6)
    return model


class Scorer:
    """Scores of texts, with the vectors of the words met so far."""

    def __init__(self, model: Model | None):
        self.model, self.words = model, Words()
        self.vectors = np.zeros((0, 0), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """From 0 to 1, 0.5 at the threshold of a text's language."""
        if self.model is None or not texts:
            return np.full(len(texts), np.nextafter(0.5, 0))
        if len(self.words) > _MEMO:
            self.__init__(self.model)
        held = [self.words.numbers(t) for t in texts]
        new = _vectors(self.model, self.words.rows(len(self.vectors)))
        self.vectors = np.concatenate([self.vectors, new]) if len(self.vectors) else new
        owners = np.array(self.words.owners)
        far = outputs(self.model, held, self.vectors)
        far = far - self.model.thresholds[[self.words.language(t, owners) for t in held]]
        return 1 / (1 + np.exp(-np.clip(far / self.model.spread, -500, 500)))


_PACKED = (
    "block long, words binary, texts binary, sizes binary, labels binary, spoken binary, "
    "n_train long, train_toxic long, n_check long, check_toxic long"
)
# Pieces of a sum over blocks, and the most tasks that sum.
_PARTS, _TASKS = 64, 128


def _packed(kept_back: int):
    """Rows of a block -> one row: its words' rows of the table, its texts as numbers, those to learn from first."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        given = zip(*(table[c].to_pylist() for c in ("hash", "doc_id", "label", "text")))
        given = sorted((h, i, y, t or "") for h, i, y, t in given)
        labels = np.array([g[2] for g in given], np.int64)
        part = _kept(labels, kept_back, key[0].as_py())
        order = np.argsort(part, kind="stable")
        words = Words()
        texts = [words.numbers(given[i][3]) for i in order]
        owners = np.array(words.owners)
        spoken = np.array([words.language(t, owners) for t in texts], np.int64)
        columns = [
            words.rows(), np.concatenate([_padded(t) for t in texts]),
            np.array([len(t) + _REACH + 1 for t in texts]), labels[order], spoken,
        ]
        sums = [(~part).sum(), labels[~part].sum(), part.sum(), labels[part].sum()]
        names = [f.split()[0] for f in _PACKED.split(", ")]
        return pa.table(dict(zip(names, [[key[0].as_py()], *[[x.tobytes()] for x in columns], *[[int(x)] for x in sums]])))

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """block, rows of the words, padded texts, labels, languages, number of rows to learn from."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
            texts = np.split(get("texts", np.int32), np.cumsum(get("sizes", np.int64))[:-1])
            block, n_train = (batch.column(name)[k].as_py() for name in ("block", "n_train"))
            rows = get("words", np.int32).reshape(-1, _KINDS)
            yield block, rows, texts, get("labels", np.int64), get("spoken", np.int64), n_train


def _summed(blocks: DataFrame, of_block) -> np.ndarray:
    """Sum of ``of_block(*block)``, a vector of any fixed length, over all blocks.

    A bounded number of tasks add up their blocks, and Spark the pieces of their sums. The driver reads the sum,
    whose size does not depend on the data.
    """
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _unpacked(batches):
            found = of_block(*block).astype(np.float32, copy=False)
            if total is None:
                total = found
            else:
                total += found
        if total is not None:
            pieces = [p.tobytes() for p in np.array_split(total, _PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(pieces, pa.binary())], schema=schema)

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), np.float32).astype(float) for p in group["sums"])
        return pa.table([[key[0].as_py()], [total.astype(np.float32).tobytes()]], schema=schema)

    columns = "part int, sums binary"
    with shuffles_removed(blocks.sparkSession):  # else those of all epochs would lie on disk at once
        rows = blocks.coalesce(_TASKS).mapInArrow(run, columns).groupBy("part").applyInArrow(add, columns).collect()
    blocks.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(rows)]).astype(float)


def _thresholds(judged: DataFrame, least: int) -> np.ndarray:
    """Per language the threshold as :func:`_threshold` has it, over rows (lang, given, label) of both classes.

    Sorted by range; tasks count errors from where the ranges before theirs end.
    """
    spark = judged.sparkSession
    everyone = judged.withColumn("lang", F.explode(F.array(F.lit(-1), F.col("lang"))))
    counts = [F.count_if(F.col("label") == y).alias(f"n{y}") for y in (0, 1)]
    folder = shared_folder(spark, "toxicity-judged")
    (
        everyone.groupBy("lang", "given").agg(*counts).repartitionByRange("lang", "given")
        .withColumn("range", F.spark_partition_id()).write.parquet(folder)
    )
    ranged = spark.read.schema("lang int, given double, n0 long, n1 long, range int").parquet(folder)
    ends = ranged.groupBy("lang", "range").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("given").alias("low"), F.max("given").alias("high")
    ).orderBy("lang", "range").collect()
    langs: dict[int, list] = {}
    for r in ends:
        langs.setdefault(r["lang"], []).append(r)
    langs = {k: rs for k, rs in langs.items() if k < 0 or min(sum(r[f"n{y}"] for r in rs) for y in (0, 1)) >= least}
    begun = []
    for lang, rs in langs.items():
        all0, all1 = (max(sum(r[n] for r in rs), 1) for n in ("n0", "n1"))
        before0 = before1 = 0
        for k, r in enumerate(rs):
            after = rs[k + 1]["low"] if k + 1 < len(rs) else r["high"] + 1
            begun.append((lang, r["range"], all0, all1, before0, before1, after))
            before0, before1 = before0 + r["n0"], before1 + r["n1"]
    columns = "lang int, range int, all0 long, all1 long, before0 long, before1 long, after double"
    w = Window.partitionBy("lang", "range").orderBy("given")
    cuts = ranged.join(F.broadcast(spark.createDataFrame(begun, columns)), ["lang", "range"]).select(
        "lang", "given", F.coalesce(F.lead("given").over(w), "after").alias("next"),
        # Shares missed and wrong, times all0 * all1.
        (
            (F.col("before1") + F.sum("n1").over(w)) * F.col("all0")
            + (F.col("all0") - F.col("before0") - F.sum("n0").over(w)) * F.col("all1")
        ).alias("loss"),
    )
    good = F.struct(-F.col("loss"), F.col("next") - F.col("given"), -F.col("given"))
    best = cuts.groupBy("lang").agg(F.max_by(F.struct("given", "next", "loss"), good).alias("b")).collect()
    found = {}
    for r in best:
        low, high, loss = r["b"]
        rs = langs[r["lang"]]
        all0, all1 = (max(sum(x[n] for x in rs), 1) for n in ("n0", "n1"))
        first = rs[0]["low"]
        # The cut below all rows misses none and has all of the other class wrong.
        if (all0 * all1, -1.0) <= (loss, low - high):
            low, high = first - 1, first
        found[r["lang"]] = (low + high) / 2
    return np.array([found.get(k, found[-1]) for k in range(N_LANGUAGES)])


def fit_all(
    labelled: DataFrame, *, block_rows: int, block_chars: int, dim: int = 8, filters: int = 8, epochs: int = 8,
    min_texts: int = 3, kept_back: int = 4, least: int = 20, seed: int = 11,
) -> Model | None:
    """As :func:`fit`, from all rows (doc_id, label, text) of a table that is read twice."""
    spark = labelled.sparkSession
    n, chars = labelled.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return None
    count = max(-(-n // block_rows), -(-chars // block_chars))
    folder = shared_folder(spark, "toxicity-blocks")
    dealt = labelled.select("*", F.xxhash64("doc_id").alias("hash")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(count))
    )
    blocks = written(dealt.repartition(count, "block").groupBy("block").applyInArrow(_packed(kept_back), _PACKED), folder)
    sums = blocks.agg(*[F.sum(c) for c in ("n_train", "train_toxic", "n_check", "check_toxic")]).first()
    n_train, toxic, n_check, check_toxic = sums
    if not 0 < toxic < n_train:
        return None

    def counted(block, rows, texts, labels, spoken, n_train):
        return _texts_of_rows([t[: len(t) - _REACH - 1] for t in texts[:n_train]], rows)

    often = _summed(blocks, counted) >= min_texts
    importance = _importance(n_train, toxic)
    training = Training(dim, filters, seed)
    for k in range(epochs):
        common = spark.sparkContext.broadcast(training)

        def learned(block, rows, texts, labels, spoken, n_train, k=k, common=common):
            mine = copy.deepcopy(common.value)
            if not n_train:
                return np.zeros_like(mine.changes(mine.state(), mine.touched))
            rows = np.where(often[rows], rows, _PAD)
            random = np.random.default_rng([seed, k, block])
            changed = mine.epoch(texts[:n_train], rows, labels[:n_train], importance, random)
            return mine.changes(common.value.state(), changed)

        training.add(_summed(blocks, learned))
        common.destroy()  # its copies on all disks
    model = training.finished()
    alone = 0 < check_toxic < n_check

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, texts, labels, spoken, n_train in _unpacked(batches):
            mine = slice(n_train, None) if alone else slice(n_train)
            if len(labels[mine]):
                given = outputs(model, [t[: len(t) - _REACH - 1] for t in texts[mine]], _vectors(model, rows))
                columns = [pa.array(spoken[mine], pa.int32()), pa.array(given, pa.float64()), pa.array(labels[mine], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "given", "label"])

    folder = shared_folder(spark, "toxicity-outputs")
    columns = "lang int, given double, label int"
    blocks.mapInArrow(judge, columns).write.parquet(folder)
    judged = spark.read.schema(columns).parquet(folder)
    model.thresholds[:] = _thresholds(judged, least)
    model.spread = max(judged.agg(F.stddev_pop("given")).first()[0] / 2, 1e-6)
    return model


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> tuple[list[str | None], np.ndarray]:
    """Some texts and labels, to try :func:`fit` on by hand; :func:`classify_toxic` learns from all rows."""
    n = labels.count()
    # A hash keeps somewhat more than are wanted, so that no more than these are sorted.
    share = min(1.0, 1.2 * max_rows / max(n, 1))
    few = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    by_hash = [F.xxhash64("doc_id"), "doc_id", "label", "text"]
    rows = docs.join(few, "doc_id").select("doc_id", "label", "text").orderBy(*by_hash).limit(max_rows)
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(*by_hash))  # of max_rows rows at most
    got = rows.withColumn("chars", so_far).filter(F.col("chars") <= max_chars).select("label", "text").toArrow()
    return got["text"].to_pylist(), got["label"].to_numpy().astype(np.int64)


def classify_toxic(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    block_rows: int = 2_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """doc_id, score and predicted (1 from a score of 0.5 on) per document.

    ``learn``: condition on column ``doc_id`` of the rows whose labels may be used.
    ``block_rows``, ``block_chars``: about so many labelled rows and characters meet in a block.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
        .distinct()
    )
    folder = shared_folder(docs.sparkSession, "toxicity-labelled")
    # Labels grow with the documents: they are never broadcast.
    labelled = written(rows.join(known.hint("merge"), "doc_id").select("doc_id", "label", "text"), folder)
    model = fit_all(labelled, block_rows=block_rows, block_chars=block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

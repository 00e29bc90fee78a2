"""Line runs that repeat across and within documents; later copies are deleted.

A document is a sequence of line ids. Prefix doubling ranks its suffixes: the rank of a place at level k
stands for the 2**k lines from there on, and comes from the ranks of level k - 1 at the place and 2**(k-1)
lines further. A rank is the first place in the collection with these lines, since only equality and the
first place matter. Places whose lines stand nowhere else leave the table at each level.

A repeated run counts if it holds at least ``min_words`` words. All suffixes with a common prefix of so
many words form an LCP interval; its prefix, the shortest one with enough words, is compared by two ranks
that overlap. The same is done with the shortest runs that end at a line. Together these windows cover
exactly the lines of all maximal repeated runs with enough words, so a line goes if it lies in a window
that stands at an earlier place as well. The first copy of every run stays.

Places are ordered by document id (null first), then by a hash of the text, then by line. Rows that are
equal in id and text are one document: both rows come back with the same lines. Lines are what stands
between line feeds; an empty line has no words and goes only as part of a run. Null text stays null. A
document may lose all its lines and then has empty text. Other columns stay as they are; added ones whose
names clash get a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.llm.columns import fresh, let, split_words
from catalens.llm.components import written
from catalens.sources.shared import shared_folder

_DOC = ("id", "twin")
_NULL_ID = -(1 << 63)


def _named(places: DataFrame, *by: str) -> DataFrame:
    """Places that share ``by`` with another one, and their rank: the first such place.

    Counted per task before the shuffle; the join back can be split where a key is hot.
    """
    at = F.struct(*_DOC, "line")
    first = (
        places.groupBy(*by).agg(F.count("*").alias("n"), F.min(at).alias("rank"))
        .filter("n > 1").drop("n")
    )
    return places.join(first, list(by)).drop(*by)


def line_places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, twin, line, words and content of every line; equal rows give equal lines."""
    lines = (
        docs.filter(F.col(text).isNotNull())
        .select(*document_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
        .select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    )
    return lines.select(
        *_DOC, "line",
        F.size(split_words(F.col("content"))).alias("words"),
        F.unhex(F.md5("content")).alias("content"),
    )


def document_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return (
        F.coalesce(doc_id.cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.xxhash64(text, doc_id.isNull()).alias("twin"),
    )


def _doubled(level: DataFrame, step: int) -> DataFrame:
    """Places of the next level: rank here and rank ``step`` lines further."""
    ahead = Window.partitionBy(*_DOC).orderBy("line").rangeBetween(step, step)
    return (
        level.select(*_DOC, "line", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b"))
        .filter("b IS NOT NULL")
    )


def run_windows(repeated: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of enough words that begin (kind 0) or end (kind 1) at each line.

    ``repeated``: lines that stand elsewhere as well; a run does not cross a line that does not.
    """
    doc = Window.partitionBy(*_DOC).orderBy("line")
    block = Window.partitionBy(*_DOC, "block")
    so_far = block.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        repeated.withColumn("block", F.col("line") - F.row_number().over(doc))
        .withColumn("upto", F.sum("words").over(so_far))
        .withColumn("before", F.col("upto") - F.col("words"))
    )
    begins = block.orderBy("before").rangeBetween(0, min_words - 1)
    ends = block.orderBy("upto").rangeBetween(1 - min_words, 0)
    # Words of the run from this line on, and of the run up to this line.
    both = (
        summed.withColumn("last", F.max("line").over(begins))
        .withColumn("last_upto", F.max("upto").over(begins))
        .withColumn("start", F.min("line").over(ends))
        .withColumn("start_before", F.min("before").over(ends))
    )
    runs = F.array(
        F.when(
            F.col("last_upto") - F.col("before") >= min_words,
            F.struct(F.lit(0).alias("kind"), F.col("line").alias("from"),
                     (F.col("last") - F.col("line") + 1).alias("size")),
        ),
        F.when(
            F.col("upto") - F.col("start_before") >= min_words,
            F.struct(F.lit(1).alias("kind"), F.col("start").alias("from"),
                     (F.col("line") - F.col("start") + 1).alias("size")),
        ),
    )
    return both.select(*_DOC, F.explode(F.array_compact(runs)).alias("run")).select(
        *_DOC, "run.kind", F.col("run.from").alias("line"), "run.size",
        (F.length(F.bin("run.size")) - 1).alias("level"),
    )


def repeated_runs(docs: DataFrame, *, min_words: int, doc_id: str, text: str) -> DataFrame:
    """id, twin, kind, line, size: windows of later copies. They may overlap."""
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark, "line-dedup")
    repeated = _named(line_places(docs, doc_id, text), "content")
    # Lines that only an equal row repeats stay here; they have no earlier place and never go.
    level = written(repeated.dropDuplicates([*_DOC, "line"]), f"{folder}/level-0")
    windows = written(run_windows(level.select(*_DOC, "line", "words"), min_words), f"{folder}/windows")
    top = windows.agg(F.max("level")).first()[0]
    if top is None:
        return windows.select(*_DOC, "kind", "line", "size")
    levels = [level.select(*_DOC, "line", "rank")]
    for k in range(top):
        level = written(_named(_doubled(levels[-1], 1 << k), "a", "b"), f"{folder}/level-{k + 1}")
        levels.append(level)
    # A window of one line is its line; a longer one is two overlapping ranks of its level.
    single = windows.filter("size = 1").join(levels[0], [*_DOC, "line"]).withColumn("other", F.col("rank"))
    found = single.select(*_DOC, "kind", "line", "size", "rank", "other")
    if top:
        ranks = None
        for k, each in enumerate(levels):
            each = each.select(*_DOC, "line", "rank", F.lit(k).alias("level"))
            ranks = each if ranks is None else ranks.unionByName(each)
        far = F.col("line") + F.col("size") - F.pow(F.lit(2), F.col("level"))
        several = (
            windows.filter("size > 1").withColumn("far", far.cast("int"))
            .join(ranks, [*_DOC, "level", "line"])
            .join(
                ranks.select(*_DOC, "level", F.col("line").alias("far"), F.col("rank").alias("other")),
                [*_DOC, "level", "far"],
            )
        )
        found = found.unionByName(several.select(*_DOC, "kind", "line", "size", "rank", "other"))
    first = found.groupBy("kind", "size", "rank", "other").agg(F.min(F.struct(*_DOC, "line")).alias("first"))
    return (
        found.join(first, ["kind", "size", "rank", "other"])
        .filter(F.struct(*_DOC, "line") > F.col("first"))
        .select(*_DOC, "kind", "line", "size")
    )


def _lines_of(runs: Column) -> Column:
    """Numbers of the lines that windows of one kind cover, each once.

    The ends of such windows ascend with their starts, so each adds what lies behind the one before.
    """


    def of(ordered: Column) -> Column:
        def added(w: Column, j: Column) -> Column:
            last = F.get(ordered, j - 1)
            begin = F.greatest(w["line"], F.coalesce(last["line"] + last["size"], F.lit(0)))
            end = w["line"] + w["size"]
            return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(
                F.array().cast("array<int>")
            )

        return F.flatten(F.transform(ordered, added))

    return let(F.array_sort(runs), of)


def dedup_lines(
    docs: DataFrame, *, min_words: int = 50, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``; and n_lines, n_deleted.

    A run counts from ``min_words`` words on. Null text has no lines and loses none.
    """
    id_, twin, gone = fresh(docs, "id", "twin", "gone")
    n_lines, n_deleted = fresh(docs, "n_lines", "n_deleted")
    covered = (_lines_of(_of_kind(kind)) for kind in (0, 1))
    runs = (
        repeated_runs(docs, min_words=min_words, doc_id=doc_id, text=text)
        .groupBy(*_DOC)
        .agg(F.collect_list(F.struct("kind", "line", "size")).alias("runs"))
        .select(
            F.col("id").alias(id_), F.col("twin").alias(twin),
            F.array_distinct(F.concat(*covered)).alias(gone),
        )
    )
    key = document_key(F.col(doc_id), F.col(text))
    joined = docs.withColumns({id_: key[0], twin: key[1]}).join(runs, [id_, twin], "left")
    left = let(
        F.split(text, "\n", -1),
        lambda x: F.array_join(
            F.transform(
                F.array_except(
                    F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)
                ),
                lambda i: F.get(x, i),
            ),
            "\n",
        ),
    )
    count = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1
    return (
        joined.withColumn(n_lines, F.coalesce(count, F.lit(0)).cast("long"))
        .withColumn(n_deleted, F.coalesce(F.array_size(gone), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left))
        .drop(id_, twin, gone)
    )


def _of_kind(kind: int) -> Column:
    return F.transform(
        F.filter("runs", lambda r: r["kind"] == kind), lambda r: F.struct(r["line"], r["size"])
    )

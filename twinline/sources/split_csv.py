"""CSV with line breaks inside quotes, read by as many tasks as its size asks for.

Spark can cut a file of lines into splits, but not one whose records hold line breaks: a
split cannot tell by itself if it begins inside of quotes. So lines are read twice. First
each split says in which state it ends, for either state it can begin in: between records or
inside of quotes. The states of a file's splits follow from each other. Then each split
cuts its lines into records from the right state on; what begins in one split and ends in
another is put together, and every record is parsed by Spark's own CSV parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinline.session import ship, written

OUTSIDE, INSIDE = 0, 1
# A record, the end of one, the beginning of one, and a whole split inside of one.
RECORD, HEAD, TAIL, THROUGH = 0, 1, 2, 3

# To the end of a field from inside its quotes. A backslash keeps the character after it from
# being a quote; after the closing quote the field goes on to the next comma.
CLOSED = re.compile(r'(?:[^"\\]|\\.)*+"[^,]*+', re.DOTALL)


def state_after(line: str, state: int) -> int:
    """Whether the end of a line lies inside of quotes, if its beginning does or doesn't."""
    if '"' not in line:
        return state
    at = 0
    if state == INSIDE:
        closed = CLOSED.match(line)
        if closed is None:
            return INSIDE
        at = closed.end() + 1
    while at < len(line):
        if line[at] == '"':
            closed = CLOSED.match(line, at + 1)
            if closed is None:
                return INSIDE
            at = closed.end() + 1
        else:
            comma = line.find(",", at)
            at = len(line) if comma < 0 else comma + 1
    return OUTSIDE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, value)``: lines in their order within each split; a split's number is its first byte."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for file, split, value in zip(*columns):
            yield (file, split), value or ""


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, the states it ends in."""
    ends: dict[tuple[int, int], list[int]] = {}
    for split, value in _splits(batches):
        states = ends.setdefault(split, [OUTSIDE, INSIDE])
        for begun in (OUTSIDE, INSIDE):
            states[begun] = state_after(value, states[begun])
    rows = [(*split, *states) for split, states in ends.items()]
    yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("file", "split", "if_outside", "if_inside"))})


def begun_inside(lines: DataFrame) -> set[tuple[int, int]]:
    """The splits that begin inside of quotes.

    A split has some 16 bytes here, so these are a few MB for a hundred TB.
    """
    ends = lines.mapInArrow(_ends, "file long, split long, if_outside long, if_inside long")
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("if_outside", "if_inside")).over(order)
    state = F.aggregate(
        before, F.lit(OUTSIDE).cast("long"), lambda s, e: F.when(s == OUTSIDE, e["if_outside"]).otherwise(e["if_inside"])
    )
    inside = ends.select("file", "split", state.alias("state")).filter(F.col("state") == INSIDE)
    return {(r["file"], r["split"]) for r in inside.select("file", "split").toLocalIterator()}


def records(spark: SparkSession, path: str) -> DataFrame:
    """The text of each record that isn't empty, without the first one of each file."""
    ship(spark)
    lines = _lines(spark, path)
    inside = spark.sparkContext.broadcast(begun_inside(lines))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun, held, out = None, OUTSIDE, False, [], []

        def put(kind: int) -> None:
            out.append((*current, kind, "\n".join(held)))
            held.clear()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(
                {n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("file", pa.int64()), ("split", pa.int64()), ("kind", pa.int32()), ("value", pa.string())))}
            )
            out.clear()
            return made

        for split, value in _splits(batches):
            if split != current:
                if held:
                    put(THROUGH if begun else TAIL)
                current, begun = split, split in inside.value
                state = INSIDE if begun else OUTSIDE
                first = split[1] == 0
            held.append(value)
            state = state_after(value, state)
            if state == OUTSIDE:
                if first:
                    first = False
                    held.clear()  # the header
                else:
                    put(HEAD if begun else RECORD)
                begun = False
            if len(out) >= 4096:
                yield rows()
        if held:
            put(THROUGH if begun else TAIL)
        yield rows()

    pieces = lines.mapInArrow(cut, "file long, split long, kind int, value string")
    whole = pieces.filter(F.col("kind") == RECORD).select("value")
    # What begins in one split and ends in another: a row or two for each split.
    parts = written(pieces.filter(F.col("kind") != RECORD), "parts")
    number = F.count_if(F.col("kind") == TAIL).over(Window.partitionBy("file").orderBy("split", "kind"))
    ordered = F.sort_array(F.collect_list(F.struct("split", "kind", "value")))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(ordered.alias("parts"))
    # Number 0 is the end of a header that takes several splits.
    joined = joined.filter("number > 0").select(F.array_join(F.col("parts.value"), "\n").alias("value"))
    # In a file of lines that end in CR LF, breaks inside of quotes are read as LF, too.
    ends = F.when(F.endswith("value", F.lit("\r")), F.replace(F.rtrim("value", F.lit("\r")), F.lit("\r\n"), F.lit("\n")))
    return whole.union(joined).select(F.coalesce(ends, "value").alias("value")).filter("value <> ''")


def read_split_csv(spark: SparkSession, path: str, schema: StructType, corrupt: str) -> DataFrame:
    """The table that Spark's whole-file CSV reader gives for files with a header, in many tasks."""
    options = {"columnNameOfCorruptRecord": corrupt, "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return records(spark, path).select(parsed.alias("row")).select("row.*")

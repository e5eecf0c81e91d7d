"""Shared folder, written intermediates and grouped Arrow streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/")  # with its scheme, for readers other than Spark's


def _delete(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder goes with the cluster's scratch space
        pass


class Scratch:
    """Intermediates written as Parquet into the shared folder: they cut lineage and survive lost executors.

    A table is dropped once what was made of it is written. What a returned DataFrame still reads stays
    until ``clean`` or until the folder's owner clears it, as with any checkpoint.
    """

    roots: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` reads from here."""
        df._scratch = self
        return df


def clean(spark: SparkSession) -> None:
    """Deletes the intermediates of all queries so far; their DataFrames can't be read again."""
    while Scratch.roots:
        _delete(spark, Scratch.roots.pop())


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def hide(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``keep`` as they are and all other columns packed into one, and what unpacks them in place.

    Whatever those are named, they can't clash with an operator's own columns. ``back(out, *more)``
    gives the columns of df and then ``more``; a column of df of one of these names is replaced.
    """
    names = df.columns
    rest = [n for n in names if n not in keep]
    packed = "packed" + uuid.uuid4().hex[:8]
    columns = quoted([n for n in names if n in keep]) + ([F.struct(*quoted(rest)).alias(packed)] if rest else [])

    def back(out: DataFrame, *more: str, without: tuple[str, ...] = ()) -> DataFrame:
        stay = [n for n in names if n not in more and n not in without]
        return out.select(*[F.col(packed).getField(n).alias(n) if n in rest else F.col(n) for n in stay], *more)

    return df.select(*columns), back


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table | None], schema: T.StructType | str, spread: int | None = None) -> DataFrame:
    """``fn`` on the rows of each ``key`` (a non-null long); many small groups share one Python stream.

    The groups must be bounded by how their key is made: one group at a time is in memory.
    """
    spread = spread or partitions(df.sparkSession)
    dealt = df.repartition(spread, F.col(key)).sortWithinPartitions(key)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            lo, n = 0, len(keys)
            while lo < n:
                if at is not None and keys[lo] != at:
                    out = fn(pa.Table.from_batches(held))
                    held, at = [], None
                    if out is not None and out.num_rows:
                        yield from out.to_batches()
                hi = lo + int((keys[lo:] != keys[lo]).argmax()) if keys[-1] != keys[lo] else n
                held.append(batch.slice(lo, hi - lo))
                at, lo = keys[lo], hi
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return dealt.mapInArrow(stream, schema)


def map_runs(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table | None], schema: T.StructType | str) -> DataFrame:
    """``fn`` on tables of many whole groups of ``key`` (a non-null long), in its order; a table is a batch and what began before it."""
    dealt = df.repartition(partitions(df.sparkSession), F.col(key)).sortWithinPartitions(key)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            last = len(keys) - int((keys[::-1] != keys[-1]).argmax()) if keys[0] != keys[-1] else 0
            if last or (held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[0]):
                out = fn(pa.Table.from_batches([*held, batch.slice(0, last)]))
                if out is not None and out.num_rows:
                    yield from out.to_batches()
                held = []
            held.append(batch.slice(last))
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return dealt.mapInArrow(stream, schema)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    return column.to_pylist()


def n_words(text: Column) -> Column:
    """Number of words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

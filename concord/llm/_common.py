"""What the corpus operators share: the shared folder, written tables, Arrow passes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Runs of anything but these six ASCII characters are words in every contract.
WORD_SEPARATORS = " \t\n\r\x0b\x0c"


#: Rows of a written table that are sent to every task at most; beyond it they are joined.
SENT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="concord-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/concord-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts the lineage and outlives any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few(table: DataFrame, sent: int = SENT_ROWS) -> DataFrame:
    """A written table that every task gets if it has few enough rows; a larger one is joined by dealing out both sides."""
    return F.broadcast(table) if table.count() <= sent else table


def columns(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns named, so that others of df cannot clash; those that df lacks are null strings."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[df[f"`{have[w.lower()]}`"].alias(w) if w.lower() in have else F.lit(None).cast("string").alias(w) for w in wanted])


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, finish: bool = False) -> DataFrame:
    """mapInArrow with state for each task: make() gives the function for each batch.

    With finish, that function is called once more with None at the end and may
    return a last batch.
    """
    out = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (got := step(batch)) is not None and got.num_rows:
                yield got.cast(arrow) if got.schema != arrow else got
        if finish and (got := step(None)) is not None and got.num_rows:
            yield got.cast(arrow) if got.schema != arrow else got
        del step
        give_back()

    return df.mapInArrow(run, out)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batch_of(**named) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in named.values()], names=list(named))


def slices(texts: list, most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` characters, so that work on a batch takes bounded memory."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)

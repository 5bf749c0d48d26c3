"""Shared pieces: reading tables, cutting lineage in the shared folder, memory-bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast a counted side up to this many rows and bytes; beyond either the same join runs as a shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Arrow batches handed to Python are cut again to about this many text bytes.
SLICE_BYTES = 1 << 20

LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of ``sf_dir``, read by Spark so that any store Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone; all other characters stay."""
    return F.translate(text, UPPER, UPPER.lower())


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tonemill-"))
    return _own_dir[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.settled_at = path
    return read


def discard(*frames: DataFrame) -> None:
    """Delete what ``settle`` wrote for ``frames``, once all that was made of them is settled itself."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Steps after which a second reading might deal rows to other partitions.
_UNSTABLE = ("Join", "Aggregate", "Repartition", "RebalancePartitions", "Sort", "Window", "Sample", "Limit", "Deduplicate", "Distinct")


def rereadable(df: DataFrame, name: str) -> DataFrame:
    """``df`` if each reading gives the same rows in the same partitions (scans, filters, projections, unions); else settled."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return settle(df, name) if any(line.lstrip(" :+-").startswith(_UNSTABLE) for line in plan.splitlines()) else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``limit`` rows and BROADCAST_BYTES bytes, else as it is (the join then
    shuffles). Give it settled frames: what it counts is read again by the join."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 32 * F.greatest(F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)), F.lit(0))
    row = df.limit(limit + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if row[0] <= limit and (row[1] or 0) <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str, keep: list[str] | None = None) -> str:
    """``name``, with underscores added until no column of ``df`` (of ``keep``, if given) bears it (Spark compares without case)."""
    taken = {c.lower() for c in (df.columns if keep is None else keep)}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with the session's Arrow batches cut to at most ``rows`` rows: long texts would fill a worker otherwise."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def sliced(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose column ``text`` holds about ``limit`` bytes each, one row at least."""
    n, start, held = batch.num_rows, 0, 0
    column = batch.column(text)
    if column.nbytes <= limit:
        if n:
            yield batch
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, size in enumerate(lengths):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start, n - start)


def release_memory() -> None:
    """Give memory that is free within this process back to the system: idle workers stay beside a JVM that needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """``run`` (batches -> batches), which gives its free memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def map_text(df: DataFrame, text_col: str, added: dict[str, T.DataType], make: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from one text column in Arrow batches.

    ``make`` runs once in each Python worker and gives a function from a list of texts (null as None) to one
    list for each column of ``added``. ``keep``: the columns that stay (all); the text itself is only carried
    back if it is among them.
    """
    keep = list(df.columns) if keep is None else keep
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("\x00text"))
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(k, v) for k, v in added.items()]])
    width = len(keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        work = make()
        for whole in batches:
            for batch in sliced(whole, width):
                columns = work(batch.column(width).to_pylist())
                arrays = [batch.column(i) for i in range(width)]
                arrays += [pa.array(v, type=out_schema.field(width + i).type) for i, v in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)

    return bounded_batches(source).mapInArrow(trimmed(run), schema)

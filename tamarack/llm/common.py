"""Plumbing the training-data operators share: whole-text UDFs, written tables, checked broadcasts and free names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tamarack.session import ship_package

#: Input bytes of an Arrow batch that become Python objects at a time (a single longer value is taken alone).
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch, where the session still has Spark's default: a batch lies in memory twice, in the JVM and in Python.
BATCH_BYTES, BATCH_CONF, BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows up to which a table of keys is broadcast (8 to 40 bytes each); larger ones are joined by a shuffle.
BROADCAST_KEYS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``).

    Only a local session without one gets a folder of its own; executors of a cluster could not read that.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tamarack-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once.

    The table goes when the application ends, or with ``removed``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarack-{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def removed(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        if (path := getattr(table, "written_path", None)) is not None:
            where, files = _files(table.sparkSession, path)
            files.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def checked_broadcast(small: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``small`` (a written table) marked for broadcast if it has ``most`` rows or fewer, else as it is: Spark then shuffles both sides."""
    return F.broadcast(small) if small.count() <= most else small


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches of whole texts small."""
    ship_package(spark)
    if spark.conf.get(BATCH_CONF, None) in (None, BATCH_DEFAULT):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


_KEPT: dict[tuple, object] = {}
_USED: set[tuple] = set()


def kept(key: tuple, build: Callable[[], object]) -> object:
    """``build()``, made once in a process; a Python worker lets go of it when a task of ``text_udf`` begins that does not ask for it."""
    _USED.add(key)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def _begun(make: Callable) -> Callable:
    """``make()``, after which the worker holds only the tables that it asked for."""
    _USED.clear()
    work = make()
    for key in [k for k in _KEPT if k not in _USED]:
        del _KEPT[key]
    return work


def text_udf(spark: SparkSession, make: Callable[[], Callable[[list], dict]], schema: str) -> Callable[..., Column]:
    """An Arrow UDF over whole columns of values.

    ``make()`` runs once in each Python worker task and returns ``batch(lists...) -> {field: list}``.
    Batches are worked on in slices, so that few values are Python objects at a time.
    The UDF is marked nondeterministic so that Catalyst evaluates it once per row
    instead of copying it into every filter and projection above it.
    """
    prepare(spark)
    fields = StructType.fromDDL(schema)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = _begun(make)
        for columns in batches:
            n, size = len(columns[0]), sum(c.nbytes for c in columns)
            rows = max(1, n * SLICE_BYTES // size) if size > SLICE_BYTES else max(n, 1)
            for at in range(0, max(n, 1), rows):
                out = work(*(c.slice(at, rows).to_pylist() for c in columns))
                yield pa.StructArray.from_arrays([pa.array(out[name], type=kind) for name, kind in kinds], names=[name for name, _ in kinds])
        pa.default_memory_pool().release_unused()  # the worker serves other tasks later

    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((b,) for b in batches)

    from collections.abc import Iterator as It

    run.__annotations__ = {"batches": It[tuple[pa.Array, ...]], "return": It[pa.Array]}
    run_one.__annotations__ = {"batches": It[pa.Array], "return": It[pa.Array]}
    one = F.arrow_udf(run_one, returnType=fields).asNondeterministic()
    many = F.arrow_udf(run, returnType=fields).asNondeterministic()
    return lambda *cols: one(*cols) if len(cols) == 1 else many(*cols)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet (compared as Spark does, without case): ``wanted``, or with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def added(df: DataFrame, wanted: str, column: Column) -> DataFrame:
    """``df`` with ``column`` as its last one; it never replaces a column: a taken name gets underscores in front."""
    return df.select("*", column.alias(free_name(df, wanted)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

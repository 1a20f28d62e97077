"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs on this machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='paragrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def python_values(a: pa.Array) -> list:
    """What ``to_pylist`` gives, with lists of structs taken column by column instead of value by value."""
    if pa.types.is_list(a.type):
        at = a.offsets.to_pylist()
        inner = python_values(a.values.slice(at[0], at[-1] - at[0]))
        made = [inner[i - at[0] : k - at[0]] for i, k in zip(at, at[1:])]
    elif pa.types.is_struct(a.type) and a.type.num_fields:
        names = [f.name for f in a.type]
        made = [dict(zip(names, values)) for values in zip(*map(python_values, a.flatten()))]
    else:
        return a.to_pylist()
    return [x if there else None for x, there in zip(made, a.is_valid().to_pylist())] if a.null_count else made


def map_rows(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str, most: int = 5000) -> DataFrame:
    """The rows that a function gives for each row's values, as Arrow batches of about ``most`` rows; lists of tuples stand for arrays of structs."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for values in zip(*(python_values(c) for c in batch.slice(at, 100).columns)):
                    rows += f(*values)
                    if len(rows) >= most:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame as Parquet in the shared folder, read back: its lineage ends there, and lost executors don't make it anew."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def as_dealt(spark: SparkSession) -> Iterator[None]:
    """What is planned within joins rows where they lie if they were dealt by one of the columns of the join, and moves them no second time."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written frame that nothing reads any more."""
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

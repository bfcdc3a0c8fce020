"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.io import spread

#: Rows that a Python step turns into Python objects at once; bounds a worker's memory.
STEP = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, only a session whose driver and executors are one process
    has another: one below its warehouse, which becomes its setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. A lost executor loses none of it. The files go when the session's process
    ends, or before by release()."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, where = _at(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more, and let Spark drop the shuffle files of plans that are done."""
    for df in tables:
        store, where = _at(df.sparkSession, df._scratch)
        store.delete(where, True)
    drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done."""
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name, like the one given, that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]], step: int = STEP) -> DataFrame:
    """mapInArrow over columns as lists, step rows at once. make() runs once in each task and gives the function of a step."""
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in target], schema=target)

    return spread(df).mapInArrow(run, schema)


def with_columns(df: DataFrame, inputs: list[str], schema: str, make: Callable[[], Callable[[dict], dict]], step: int = STEP) -> DataFrame:
    """df with the columns of schema, made of its inputs as map_columns does; one of a name that df has takes its place. All others pass by untouched."""
    made = T.StructType.fromDDL(schema)
    target = T.StructType([*(x for x in df.schema if x.name not in made.names), *made])
    new = to_arrow_schema(made)
    kept = [i for i, n in enumerate(df.columns) if n not in made.names]
    where = {n: df.columns.index(n) for n in inputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = f({n: part.column(i).to_pylist() for n, i in where.items()})
                arrays = [*(part.column(i) for i in kept), *(pa.array(out[x.name], type=x.type) for x in new)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(part.schema.names[i] for i in kept), *new.names])

    return spread(df).mapInArrow(run, target).select(*[F.col(f"`{n}`") for n in df.columns], *[F.col(f"`{n}`") for n in made.names if n not in df.columns])


def bucket_count(spark: SparkSession) -> int:
    """Buckets that rows of one key are dealt into: a few for each shuffle partition, whose number is set to fit the data."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Gapless row numbers from 0 within each key, in no task that holds a whole key: rows of a key are hashed into buckets, numbered there,
    and moved up by the sizes of the buckets before. df is read twice, so it should be a table. order: columns that tell rows apart; equal rows get
    different numbers. Keys must not be null."""
    spark = df.sparkSession
    b = "__bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(bucket_count(spark))).cast("int"))
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.partitionBy(F.lit(0)).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    number = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order))
    return dealt.withColumn("__rn", number).join(starts, [*keys, b]).withColumn(out, F.col("__start") + F.col("__rn") - 1).drop(b, "__rn", "__start")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of an id as text, modulo m; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(m)).cast("int")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() parts at just these characters, and bytes.lower() lowers A-Z alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()

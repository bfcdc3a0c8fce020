"""Readers and writers of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions (one small file), for steps that work hard on each row. Partitions are never merged, and what
    comes from a shuffle stays as it is: asking for its partitions would run the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """strict: a malformed line fails the query; else it is dropped. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Each line as a map of its keys, which tells an absent key from a null one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", "map<string,string>").alias("record"))


def aliased(records: DataFrame, aliases: dict[str, str], record: str = "record") -> DataFrame:
    """records (maps) with each name as a column: its own value if the record has that key, null or not, else that of its alias."""
    r = F.col(record)
    return records.withColumns({n: F.when(F.map_contains_key(r, F.lit(n)), F.try_element_at(r, F.lit(n))).otherwise(F.try_element_at(r, F.lit(o))) for n, o in aliases.items()})


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Files of a path or pattern, sorted, through the path's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(x.getPath().toString() for x in found)


def must_exist(spark: SparkSession, path: str, what: str = "source") -> str:
    """The path, or FileNotFoundError before anything is planned."""
    if not files_of(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")
    return path


def sources(spark: SparkSession, paths: list[str], schema: StructType | str | None = None) -> DataFrame:
    """All rows of all paths and patterns. Each one's format follows from its first file; a pattern that matches nothing is skipped."""
    if not paths:
        raise ValueError("no source paths")
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = None
    for p in paths:
        found = files_of(spark, p)
        if not found:
            if not set("*?[]") & set(p):
                raise FileNotFoundError(p)
            continue
        part = (reader.parquet if found[0].lower().endswith(".parquet") else reader.json)(*found)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], schema or StructType([])) if out is None else out


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order; all for None."""
    return df if n is None else df.orderBy(*order).limit(n)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nulls are written."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_branches(df: DataFrame, branches: dict[str, tuple[str | None, list[str]]], skip_empty: tuple[str, ...] = ()) -> list[str]:
    """Several outputs of one result: path -> (filter, columns). df is kept (spilling to disk), so it is worked out once. Paths in skip_empty are written
    only if they have rows. Gives the paths written."""
    df = df.persist()
    done = []
    try:
        for path, (where, columns) in branches.items():
            part = (df.where(where) if where else df).select(*columns)
            if path not in skip_empty or not part.isEmpty():
                write_jsonl(part, path)
                done.append(path)
    finally:
        df.unpersist()
    return done


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def counted(df: DataFrame, **conditions: str) -> tuple[DataFrame, Observation]:
    """df with counters that fill while it runs: rows, and those of each condition."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()]), seen

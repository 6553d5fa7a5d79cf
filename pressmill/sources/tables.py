"""Tables in Parquet, snapshots of them, and append-only registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def stored(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table of a path (articles, if no schema is given), which may not be there yet."""
    schema = schema or schemas.articles()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def snapshot(tables: dict[str, DataFrame], path: str, stamp: str) -> DataFrame:
    """Writes all tables as compressed JSON under path/stamp, and returns how many rows each has."""
    counts = None
    for name, table in tables.items():
        table.write.option("compression", "gzip").json(f"{path}/{stamp}/{name}")
        n = table.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionAll(n)
    return counts


def restore(spark: SparkSession, path: str, stamp: str, schemas: dict) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{stamp}/{name}") for name, schema in schemas.items()}


def same_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tables whose row counts differ between two snapshots."""
    return left.join(right.withColumnRenamed("n", "m"), "table", "full").where(~F.col("n").eqNullSafe(F.col("m")))


def register(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON-lines register; a single object or an empty file is as good as an array."""
    return spark.read.schema(schema).json(path)


def enter(rows: DataFrame, path: str) -> None:
    """Appends rows to a register of JSON lines."""
    rows.write.mode("append").json(path)


def note(lines: DataFrame, path: str) -> None:
    """Appends lines of text, such as rows of a Markdown table: lines has one string column."""
    lines.write.mode("append").text(path)


def as_list(value, of: str):
    """A JSON value as an array: one that is no array is its only element, none is empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    listed = F.when(F.startswith(text, F.lit("[")), text).when(text == "", F.lit("[]")).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(listed, f"array<{of}>")


def emptied(spark: SparkSession, path: str, schema) -> None:
    """A table without rows: what is numbered begins at one again."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the SQL files in a folder, in order of their names."""
    files = spark.read.option("pathGlobFilter", "*.sql").text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text")).orderBy("name")


def next_number(rows: DataFrame) -> DataFrame:
    return rows.agg((F.count("*") + 1).alias("next_number"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(name) of each snapshot under a path, the latest first; names begin with their time."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = [(x.getPath().getName(),) for x in found if x.isDirectory()]
    return spark.createDataFrame(names, "name string").orderBy(F.desc("name"))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return snapshots(spark, path).agg(F.max("name").alias("name"))

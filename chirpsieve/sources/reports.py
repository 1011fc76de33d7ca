"""Benchmark reports (JSON with a `benchmarks` array of named timings) as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """fixture, name, nsamps, real_ms, cpu_ms of each entry named fixture/name/nsamps; names without a slash are left out."""
    schema = "benchmarks array<struct<name:string,real_time:double,cpu_time:double,time_unit:string>>"
    b = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("benchmarks").alias("b")).select("b.*").where(F.col("name").contains("/"))
    part = F.split("name", "/")
    unit = F.when(F.col("time_unit") == "s", 1e3).when(F.col("time_unit") == "us", 1e-3).when(F.col("time_unit") == "ns", 1e-6).otherwise(1.0)
    return b.select(part[0].alias("fixture"), part[1].alias("name"), F.try_element_at(part, F.lit(3)).try_cast("int").alias("nsamps"), (F.col("real_time") * unit).alias("real_ms"), (F.col("cpu_time") * unit).alias("cpu_ms")).distinct()


def series(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """benchmark_name, n, cpu_ms, benchmark_type of each entry named fixture/BM_two_words_type/n; of one benchmark only, if named.

    The third word is the type (seq, par), null where there is none; n is a
    number, null where it isn't one. The distinct benchmark_name are the groups.
    """
    words = F.split(F.regexp_replace("name", "^BM_", ""), "_")
    out = benchmarks(spark, path).select(F.array_join(F.slice(words, 1, 2), "_").alias("benchmark_name"), F.col("nsamps").cast("long").alias("n"), "cpu_ms", F.get(words, F.lit(2)).alias("benchmark_type"))
    return out if name is None else out.where(F.col("benchmark_name") == name)

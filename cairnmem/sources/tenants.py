"""Tenants: one database of tables each, in the session's catalog; and SQL over a tenant's tables."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "tenant_"


def database(tenant: str) -> str:
    """The name of a tenant's database; letters, digits and underscores only."""
    if not re.fullmatch(r"[A-Za-z0-9_]{1,64}", tenant):
        raise ValueError(f"not a tenant's name: {tenant!r}")
    return PREFIX + tenant.lower()


def create(spark: SparkSession, tenant: str) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database(tenant)}")
    return database(tenant)


def tenants(spark: SparkSession) -> list[str]:
    """All tenants, sorted."""
    return sorted(d.name.removeprefix(PREFIX) for d in spark.catalog.listDatabases() if d.name.startswith(PREFIX))


def save(df: DataFrame, tenant: str, table: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Write rows to a tenant's table, by default as further rows."""
    name = f"{create(df.sparkSession, tenant)}.{table}"
    df.write.mode(mode).format("parquet").partitionBy(*partition_by).saveAsTable(name)


def load(spark: SparkSession, tenant: str, table: str) -> DataFrame:
    return spark.table(f"{database(tenant)}.{table}")


def query(spark: SparkSession, tables: dict[str, DataFrame], statement: str, args: dict | None = None) -> DataFrame:
    """Any Spark SQL over some tables, with named parameters (:name)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=args or {})


def usage(spark: SparkSession, table: str = "memories") -> DataFrame:
    """Rows of one table of every tenant that has it."""
    out = spark.createDataFrame([], "tenant string, n_rows bigint")
    for tenant in tenants(spark):
        if spark.catalog.tableExists(f"{database(tenant)}.{table}"):
            out = out.unionByName(load(spark, tenant, table).agg(F.count("*").alias("n_rows")).select(F.lit(tenant).alias("tenant"), "n_rows"))
    return out

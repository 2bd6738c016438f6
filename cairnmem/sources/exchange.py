"""Export, import, snapshots, encryption, and text embedders.

Everything is read and written by Spark's own readers and writers, in parallel and into folders.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORTED = ("memories", "entities", "edges", "memory_entities", "conflicts", "patterns", "triggers")
VECTOR_DIM = 64


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Write tables as JSON folders; tombstoned memories and edges stay behind."""
    for name, df in tables.items():
        if "consolidation_status" in df.columns:
            df = df.where("consolidation_status <> 'tombstoned'")
        if "tombstoned" in df.columns:
            df = df.where("not tombstoned")
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, schema: str, existing: DataFrame, key: list[str], merge: bool = False) -> DataFrame:
    """existing with the imported rows whose key it lacks; a table with rows is refused unless merged."""
    if not merge and existing.limit(1).count():
        raise ValueError("the table has rows: import with merge=True")
    return merge_new(existing, spark.read.schema(schema).json(path), key)


def merge_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing with the incoming rows whose key it lacks, one for each key."""
    new = incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new.select(existing.columns))


def to_jsonl(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Both tables as lines of JSON with a ``type`` each; one line an edge."""
    def line(kind: str, df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns)).alias("value"))

    return line("memory", memories).unionByName(line("edge", edges.dropDuplicates(["src", "dst", "rel_type"])))


def from_jsonl(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of one type; lines that are not JSON of it are left out."""
    parsed = lines.select(F.from_json("value", f"type string, {schema}", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where(F.col("r.type") == kind).select("r.*").drop("type")


def snapshot(tables: dict[str, DataFrame], path: str, version: int) -> DataFrame:
    """Write a version of all tables, each in a folder of its own, and return the manifest: rows and a
    checksum of each, that does not depend on their order."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/v{version}/{name}")
        one = checksum(df).withColumn("table", F.lit(name)).withColumn("version", F.lit(version))
        manifest = one if manifest is None else manifest.unionByName(one)
    return manifest


def checksum(df: DataFrame) -> DataFrame:
    """n_rows and a checksum that any order of rows gives."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
    return df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), F.sha2(F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("checksum"))


def encrypted(text: Column, key: bytes) -> Column:
    """AES-256-GCM of a text with a 32-byte key, base64."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.base64(F.aes_encrypt(text, F.lit(key), F.lit("GCM")))


def decrypted(data: Column, key: bytes) -> Column:
    """The text again; null where key or data are wrong."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.try_aes_decrypt(F.unbase64(data), F.lit(key), F.lit("GCM")).cast("string")


def hash_embedding(text: Column, dim: int = VECTOR_DIM) -> Column:
    """A vector of word hashes at length 1, in SQL functions: for tests, and where no model is at hand."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}0-9]+"), lambda w: F.length(w) > 0)
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = lambda at: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda c: _once(norm(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c))
    return _once(at, lambda a: _once(counts(a), scaled))


def _once(value: Column, of) -> Column:
    """of(value), with the value computed once for all places where ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def embedder(encode_factory):
    """A column function from a factory of an object with ``encode(texts)``; it is built once a worker."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode_factory()
        for texts in batches:
            yield pd.Series(list(np.asarray(model.encode(texts.fillna("").tolist()), dtype=float)))

    return embed


def quota_of(databases: DataFrame, quotas: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """Each database with its quotas, or the defaults where it has none."""
    j = databases.join(quotas, "name", "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def import_jsonl(lines: DataFrame, schema: str, existing: DataFrame, embed: Column | None = None) -> DataFrame:
    """Memories from lines of JSON, to append: with ids of their own, made of the old id and the text, and with
    ``embed`` of the text where one is given; those that are there already are left out."""
    rows = from_jsonl(lines, "memory", schema).where("rid is not null")
    rows = rows.withColumn("rid", F.concat(F.lit("i-"), F.substring(F.sha2(F.concat_ws("\x1f", "rid", "text"), 256), 1, 32)))
    rows = rows if embed is None else rows.withColumn("embedding", embed)
    return rows.dropDuplicates(["rid"]).join(existing.select("rid"), "rid", "left_anti")


def export_control(databases: DataFrame, tokens: DataFrame, path: str) -> None:
    """Write databases (name, ...) and those tokens (token_hash, revoked, ...) that are not revoked."""
    databases.write.mode("overwrite").json(f"{path}/databases")
    tokens.where("not revoked").write.mode("overwrite").json(f"{path}/tokens")


def import_control(databases: DataFrame, tokens: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """databases and tokens with what an export adds: databases by name, tokens by hash; nothing is replaced."""
    spark = databases.sparkSession
    new_databases = spark.read.schema(databases.schema).json(f"{path}/databases")
    new_tokens = spark.read.schema(tokens.schema).json(f"{path}/tokens")
    return merge_new(databases, new_databases, ["name"]), merge_new(tokens, new_tokens, ["token_hash"])

"""Synthetic memories of any number, the same for a seed: for tests and load."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.schema import DAY

# What synthetic sentences are made of.
TOPICS = ("work", "health", "family", "travel", "music", "food", "finance", "learning")
ENTITIES = ("Sarah", "Mike", "Priya", "Acme Corp", "FAISS", "Tokyo", "Luna", "Redis")
VERBS = ("talked about", "planned", "worried about", "enjoyed", "finished", "postponed", "remembered", "discovered")


def _pick(values: tuple[str, ...], seed: int, salt: int) -> Column:
    at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))).cast("int")
    return F.get(F.array(*map(F.lit, values)), at)


def _unit(seed: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1e6


def life(spark: SparkSession, n: int, now: float, days: int = 540, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n memories of the last days: hashes of the row's number, so any task makes its own rows."""
    entity, topic = _pick(ENTITIES, seed, 1), _pick(TOPICS, seed, 2)
    text = F.concat_ws(" ", entity, _pick(VERBS, seed, 3), topic, F.concat(F.lit("no. "), F.col("id").cast("string")))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(
        F.col("id").alias("seq"), F.format_string("life-%012d", "id").alias("rid"), text.alias("text"), entity.alias("entity"), topic.alias("domain"),
        F.when(_unit(seed, 4) < 0.7, "episodic").when(_unit(seed, 4) < 0.9, "semantic").otherwise("procedural").alias("type"),
        _unit(seed, 5).alias("importance"), (_unit(seed, 6) * 2 - 1).alias("valence"), (F.lit(now) - F.floor(_unit(seed, 7) * days) * DAY).alias("created_at"),
    )

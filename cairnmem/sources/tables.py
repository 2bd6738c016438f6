"""The logical tables, as views of the relational test tables.

Each is one projection (and the joins it needs), so filters and column pruning reach the files.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.schema import DAY

NOW = 1706745600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """A timestamp without zone as seconds since 1970, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories from events; those with a vector of the same number have an embedding."""
    e, v = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    n = F.col("event_id")
    kind = F.when(n % 10 == 0, "procedural").when(n % 10 <= 3, "semantic").otherwise("episodic")
    status = F.when(n % 23 == 0, "tombstoned").when(n % 19 == 0, "consolidated").otherwise("active")
    created = seconds(F.col("ts"))
    return e.join(v, e.event_id == v.vec_id, "left").select(
        n.alias("seq"),
        F.concat(F.lit("m"), n).alias("rid"),
        kind.alias("type"),
        F.concat("event_type", F.lit(" by user "), "user_id").alias("text"),
        created.alias("created_at"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("importance"),
        ((n * 7919 % 2001 - 1000) / F.lit(1000.0)).alias("valence"),
        (F.lit(604800.0) * (1 + n % 4)).alias("half_life"),
        F.least(created + (n % 5) * DAY, F.lit(NOW)).alias("last_access"),
        (n % 7).alias("access_count"),
        status.alias("consolidation_status"),
        F.when(n % 11 == 0, "cold").otherwise("hot").alias("storage_tier"),
        F.col("props").alias("metadata"),
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("namespace"),
        (F.lit(0.5) + (n % 6) / F.lit(10.0)).alias("certainty"),
        F.col("event_type").alias("domain"),
        F.when(n % 3 == 0, "user").when(n % 3 == 1, "inference").otherwise("system").alias("source"),
        F.concat(F.lit("customer"), "user_id").alias("entity"),
        F.concat(F.lit("s"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have an embedding and that a default scan sees."""
    return memories(spark, sf_dir).where("embedding is not null")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts of customer-ordered-part edges, in the order of (at, nth)."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("customer"), "o_custkey").alias("src"),
        F.concat(F.lit("part"), "l_partkey").alias("dst"),
        F.lit("ordered").alias("rel_type"),
        F.col("l_quantity").alias("weight"),
        seconds(F.col("l_shipdate")).alias("at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"),
    )


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who and what is located where."""
    def edge(df: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        ends = (F.concat(F.lit(a), F.col(b).cast("string")) for a, b in (src, dst))
        return df.select(*(e.alias(n) for e, n in zip(ends, ("src", "dst"), strict=True)), F.lit("located_in").alias("rel_type"), F.lit(1.0).alias("weight"))

    return (
        edge(table(spark, sf_dir, "customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"))
        .unionByName(edge(table(spark, sf_dir, "supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey")))
        .unionByName(edge(table(spark, sf_dir, "nation"), ("nation", "n_nationkey"), ("region", "n_regionkey")))
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of suppliers on whether a part was supplied well, from lineitem."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    begin = seconds(F.col("l_shipdate"))
    supplier = F.concat(F.when(F.col("l_suppkey") % 10 == 0, "system.").otherwise(""), F.lit("supplier"), "l_suppkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.concat(F.lit("part"), "l_partkey").alias("src"),
        F.lit("supplied_ok").alias("rel_type"),
        F.col("o_orderstatus").alias("dst"),
        F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("polarity"),
        F.when(F.col("l_linenumber") == 3, "reported").when(F.col("l_linenumber") == 5, "hypothetical").otherwise("asserted").alias("modality"),
        F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("namespace"),
        F.when(F.col("l_linenumber") != 6, begin).alias("valid_from"),
        F.when(F.col("l_linenumber") < 6, begin + 30 * DAY).alias("valid_to"),
        supplier.alias("extractor"),
        F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "medium").otherwise("high").alias("confidence_band"),
        F.concat(F.lit("m"), "l_orderkey").alias("source_memory_rid"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations."""
    return table(spark, sf_dir, "conversations")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on memories, from events: ordered by (hlc, op_id), several on each target."""
    n = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "error", "forget").when(F.col("event_type") == "click", "update").otherwise("record")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("op"), F.lpad(n.cast("string"), 12, "0")).alias("op_id"),
        kind.alias("op_type"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("hlc"),
        F.concat(F.lit("m"), n % 997).alias("target_rid"),
        F.concat(F.lit("device"), F.col("user_id") % 3).alias("origin_actor"),
        F.col("value").alias("importance"),
        F.col("props").alias("payload"),
    )


# Names by which other sources know some entities.
ALIASES = (("widget maker", "part1", "n1"), ("ring maker", "part2", "n2"), ("Status F", "F", "*"), ("Status O", "O", "*"))

# Fixed values: (relation, namespace, several objects allowed, severity when a time is missing).
POLICIES = (("supplied_ok", "*", False, "medium"), ("supplied_ok", "n3", True, "medium"), ("ordered", "*", True, "low"))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, canonical_name string, namespace string")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "rel_type string, namespace string, overlap_allowed boolean, missing_time_severity string")

"""The operation log: pages, idempotent application, folding into state, keeping the newest.

State is a fold whose result does not depend on the order of arrival: memories are added once,
registers keep what the largest (hlc, op_id) wrote, and a tombstone wins over everything.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of time in which lags are counted.
LAG_BUCKETS = 4096


def position(hlc: str = "hlc", op_id: str = "op_id") -> Column:
    return F.struct(hlc, op_id)


def since(log: DataFrame, hlc: int | None, op_id: str | None, exclude_actor: str | None = None, limit: int = 1000) -> DataFrame:
    """Operations strictly after a cursor, in order, without those of one actor; at most 10,000."""
    if hlc is not None:
        log = log.where((F.col("hlc") > hlc) | ((F.col("hlc") == hlc) & (F.col("op_id") > (op_id or ""))))
    if exclude_actor is not None:
        log = log.where(F.col("origin_actor") != exclude_actor)
    return log.orderBy("hlc", "op_id").limit(max(1, min(limit, 10_000)))


def last_position(log: DataFrame, by: str | None = None) -> DataFrame:
    """The largest (hlc, op_id), of each actor or of all."""
    last = F.max(position()).alias("p")
    grouped = log.groupBy(by).agg(last) if by else log.agg(last)
    return grouped.select(*([by] if by else []), "p.hlc", "p.op_id")


def apply(log: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with what is new of some operations, and how many were applied and skipped."""
    once = incoming.dropDuplicates(["op_id"])
    new = once.join(log.select("op_id"), "op_id", "left_anti")
    counts = incoming.agg(F.count("*").alias("received")).crossJoin(new.agg(F.count("*").alias("applied")))
    return log.unionByName(new.select(log.columns)), counts.select("applied", (F.col("received") - F.col("applied")).alias("skipped"))


def fold(log: DataFrame) -> DataFrame:
    """The state of each target: importance written last, how often, by whom last, and whether it lives.

    All parts are maxima and counts over distinct operations, so partial results combine in any order.
    """
    ops = log.dropDuplicates(["op_id"])
    write = F.col("op_type") != "forget"
    return ops.groupBy("target_rid").agg(
        F.max_by("importance", F.when(write, position())).alias("importance"),
        F.max_by("origin_actor", F.when(write, position())).alias("last_writer"),
        F.count_if(write).alias("n_writes"),
        F.max("hlc").alias("last_hlc"),
        F.max(F.col("op_type") == "forget").alias("tombstoned"),
    )


def unseen(log: DataFrame, other: DataFrame) -> DataFrame:
    """Operations that another log lacks."""
    return log.join(other.select("op_id"), "op_id", "left_anti")


def newest(log: DataFrame, keep: int) -> DataFrame:
    """The newest operations, as a sort with a limit."""
    return log.orderBy(F.desc("hlc"), F.desc("op_id")).limit(keep)


def lag(log: DataFrame, peers: DataFrame) -> DataFrame:
    """Of each peer (peer, hlc, op_id) with any: how many operations it has yet to see.

    Positions are cut into buckets of time: later buckets are counted, and only a peer's own is compared.
    """
    low, high = log.agg(F.min("hlc"), F.max("hlc")).first()
    if low is None:
        return peers.select("peer", F.lit(0).cast("long").alias("behind")).where("behind > 0")
    width = (high - low) // LAG_BUCKETS + 1
    bucket = F.greatest(F.lit(-1), F.least(F.lit(LAG_BUCKETS + 1), F.floor((F.col("hlc") - low) / width))).cast("long").alias("bucket")
    ops = log.select("hlc", "op_id", bucket)
    every = log.sparkSession.range(-1, LAG_BUCKETS + 2).withColumnRenamed("id", "bucket")
    counts = every.join(ops.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left")
    # A window over LAG_BUCKETS rows, whatever the log.
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later"))
    marks = peers.select("peer", F.col("hlc").alias("at_hlc"), F.col("op_id").alias("at_op"), bucket)
    after = (F.col("hlc") > F.col("at_hlc")) | ((F.col("hlc") == F.col("at_hlc")) & (F.col("op_id") > F.col("at_op")))
    same = marks.join(ops, "bucket").where(after).groupBy("peer").agg(F.count("*").alias("same"))
    behind = marks.join(counts, "bucket").join(same, "peer", "left")
    return behind.select("peer", (F.col("later") + F.coalesce("same", F.lit(0))).alias("behind")).where("behind > 0")


def backfill_embeddings(memories: DataFrame, embed: Column) -> DataFrame:
    """memories with an embedding computed where there is none."""
    return memories.withColumn("embedding", F.coalesce(F.col("embedding"), embed))


def advance(marks: DataFrame, seen: DataFrame, by: tuple[str, ...] = ("peer", "db")) -> DataFrame:
    """Watermarks (peer, db, hlc, op_id) after some positions of the same form: the largest of each, so that none
    goes back, in whatever order reports come."""
    both = marks.select(*by, "hlc", "op_id").unionByName(seen.select(*by, "hlc", "op_id"))
    return both.groupBy(*by).agg(F.max(position()).alias("p")).select(*by, "p.hlc", "p.op_id")


def after_marks(log: DataFrame, marks: DataFrame, db: str = "db") -> DataFrame:
    """(peer, db, op_id, hlc) of what each peer has yet to pull: an equi join on the database."""
    at = marks.select("peer", db, F.col("hlc").alias("_hlc"), F.col("op_id").alias("_op"))
    new = (F.col("hlc") > F.col("_hlc")) | ((F.col("hlc") == F.col("_hlc")) & (F.col("op_id") > F.col("_op")))
    return log.join(at, db).where(new).select("peer", db, "op_id", "hlc")


def union_members(*replicas: DataFrame) -> DataFrame:
    """Members (cluster, member) of consolidations as all replicas have them: a union of sets."""
    out = replicas[0].select("cluster", "member")
    for r in replicas[1:]:
        out = out.unionByName(r.select("cluster", "member"))
    return out.distinct()

"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked where their group key is equal (by default: equal texts).  Linked documents
start in shards by hash.  In every round each group looks at where its members are, and members move
to the shard that holds most of them, light groups first and only as far as that shard's quota of
bytes has room.  Rounds end when nothing moves, or after ``MAX_ROUNDS``: where nearly all bytes are
linked there is little room, and each round moves little.  One pass then places all groups that are
still split.  The heavy ones go to the shards with most room; the others lie on a line of bytes, which
the shards' free quotas cut, and those that a cut goes through are placed like heavy ones.  A group
stays whole if a shard has room for it but for the size of the largest document; else it fills the
shard with most room and goes on with the next.  Documents without links fill what the quotas leave,
in one pass.

The rounds run on one row per group and shard, so a group of any size weighs a few rows.  Members of
a group that no shard holds whole are dealt to its shards by a running sum of bytes.  Running sums are
computed in three levels (rows of a block, blocks of a partition, partitions), so no window holds a whole
shard or group; joins on the group key are of two plain exchanges, which adaptive execution may split,
or with a broadcast of the groups that are placed one by one, at most ``HEAVY`` + 1 a shard.

Nulls and ties: a null text has size 1 and is linked with empty texts.  doc_id is only carried along:
it may be null or repeated.  Ties are broken by a hash of group and shard.  An empty table gives an
empty result.  Other columns are ignored.  A very long text is only hashed and measured, and never moved.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmem.llm.staging import Stage, partitions

MAX_ROUNDS = 24
#: A split group of more than this part of a shard is placed by itself.
HEAVY = 64
#: Rows of a block of the running sums.
_BLOCK_BITS = 13


def running_sum(df: DataFrame, value: Column, by: tuple[str, ...], name: str) -> DataFrame:
    """df, which has a unique ``row`` from monotonically_increasing_id, with the sum of ``value`` over
    the rows before each, within ``by``."""
    df = df.withColumn("_v", value.cast("long")).withColumn("_p", F.shiftright("row", 33))
    df = df.withColumn("_b", F.shiftright(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), _BLOCK_BITS))

    def before(*keys: str, order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
        return F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = df.groupBy(*by, "_p", "_b").agg(F.sum("_v").alias("_v"))
    parts = blocks.groupBy(*by, "_p").agg(F.sum("_v").alias("_v"))
    parts = parts.withColumn("_of_part", before(*by, order="_p")).drop("_v")
    blocks = blocks.withColumn("_of_block", before(*by, "_p", order="_b")).drop("_v").join(parts, [*by, "_p"])
    out = df.withColumn("_in_block", before(*by, "_p", "_b", order="row")).join(blocks, [*by, "_p", "_b"])
    return out.withColumn(name, F.col("_in_block") + F.col("_of_block") + F.col("_of_part")).drop(
        "_v", "_p", "_b", "_in_block", "_of_block", "_of_part"
    )


def _round(state: DataFrame, capacity: float, shards: int, blocks: int) -> DataFrame:
    """state (group, size, shard, n) after one round, and in ``moved`` how many rows came in."""
    spark = state.sparkSession
    loads = state.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load"))
    room = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(loads), "shard", "left")
    room = room.select("shard", F.greatest(F.lit(0.0), F.lit(capacity) - F.coalesce("load", F.lit(0))).alias("room"))
    # At most one row a shard: broadcast.
    seen = state.join(F.broadcast(room), "shard")
    best = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard", "room")
    targets = seen.where("room >= size").groupBy("group").agg(F.max(best).alias("to"))
    movers = state.join(targets, "group").where(
        "shard != to.shard and (n < to.n or n = to.n and xxhash64(group, shard) < to.tie)"
    )
    # In order of what the group weighs at its target; of like weight, by hash.  Blocks of that order
    # are summed first.
    weight = F.floor(F.log2(F.col("to.n") * F.col("size") + 1)).cast("int")
    movers = movers.withColumn("block", weight * blocks + F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int"))
    movers = movers.withColumn("target", F.col("to.shard"))
    sums = movers.groupBy("target", "block").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"))
    earlier = Window.partitionBy("target").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).drop("bytes")
    within = Window.partitionBy("target", "block").orderBy("group", "shard").rowsBetween(Window.unboundedPreceding, -1)
    moved = (
        movers.withColumn("within", F.coalesce(F.sum(F.col("n") * F.col("size")).over(within), F.lit(0)))
        .join(sums, ["target", "block"])
        .withColumn("k", F.floor((F.col("to.room") - F.col("earlier") - F.col("within")) / F.col("size")))
        .withColumn("k", F.least("n", F.greatest(F.lit(0), "k")).cast("long"))
        .where("k > 0")
        .select("group", "size", "shard", "target", "k")
    )
    zero = F.lit(0).cast("long").alias("moved")
    return (
        state.select("group", "size", "shard", "n", zero)
        .unionByName(moved.select("group", "size", "shard", (-F.col("k")).alias("n"), zero))
        .unionByName(moved.select("group", "size", F.col("target").alias("shard"), F.col("k").alias("n"), F.col("k").alias("moved")))
        .groupBy("group", "size", "shard")
        .agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"))
        .where("n > 0")
    )


def _settle(state: DataFrame, stage: Stage, capacity: float, shards: int, largest: int) -> tuple[DataFrame, list[tuple]]:
    """(group, shard) of the groups that lie whole in a shard, with split ones brought together; and
    (group, start, stop, shard) of those that were placed one by one, by bytes of the group."""
    weight = F.sum(F.col("n") * F.col("size")).alias("weight")
    groups = stage.write(state.groupBy("group").agg(weight, F.min("shard").alias("shard"), F.max("shard").alias("last")), "spread")
    whole, split = groups.where("shard = last").select("group", "shard", "weight"), groups.where("shard < last").drop("shard", "last")
    room = [capacity] * shards

    def fill(some: DataFrame) -> None:
        for r in some.groupBy("shard").agg(F.sum("weight").alias("load")).collect():
            room[r["shard"]] -= r["load"]

    pieces: list[tuple] = []

    def place(some: DataFrame) -> None:
        for r in some.orderBy(F.desc("weight"), "group").collect():
            at = 0.0
            while at < r["weight"]:
                s = max(range(shards), key=room.__getitem__)
                left = r["weight"] - at
                took = left if left <= room[s] + largest or room[s] <= 0 else room[s]
                last = took == left
                pieces.append((r["group"], at, float("inf") if last else at + took, s))
                room[s] -= took
                at = r["weight"] if last else at + took

    fill(whole)
    heavy = F.col("weight") * HEAVY > capacity
    place(split.where(heavy))
    light = stage.write(split.where(~heavy).withColumn("row", F.monotonically_increasing_id()), "light")
    free = [max(0.0, r) for r in room]
    cuts = [sum(free[: s + 1]) for s in range(shards - 1)]
    begins = sum(((F.col("at") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    ends = sum(((F.col("at") + F.col("weight") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    line = running_sum(light, F.col("weight"), (), "at").select("group", "weight", begins.alias("shard"), ends.alias("last"))
    line = stage.write(line, "line-of-groups")
    within = line.where("shard = last").select("group", "shard", "weight")
    fill(within)
    place(line.where("shard < last"))
    return whole.unionByName(within).select("group", "shard"), pieces


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every document.

    ``group`` replaces the text as what links documents; it must not be null.
    """
    stage = Stage(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text if group is None else group.cast("string"), 256).substr(1, 32).alias("group"),
    )
    thin = stage.write(thin.withColumn("row", F.monotonically_increasing_id()), "documents")
    many = stage.write(thin.groupBy("group").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    marked = stage.write(thin.join(many, "group", "left"), "marked")
    linked, alone = marked.where("members is not null"), marked.where("members is null")

    total, largest = (x or 0 for x in thin.agg(F.sum("size"), F.max("size")).first())
    capacity = total / shards
    first = F.pmod(F.xxhash64("group", "row"), F.lit(shards)).cast("int").alias("shard")
    # Members of a group of other than equal texts may differ in size; a row stands for each size.
    state = stage.write(
        linked.groupBy("group", "size", first).agg(F.count("*").alias("n")).withColumn("moved", F.lit(0).cast("long")), "round"
    )
    blocks = 4 * partitions(docs.sparkSession)
    for _ in range(MAX_ROUNDS):
        before = state
        state = stage.write(_round(before.drop("moved"), capacity, shards, blocks), "round")
        stage.drop(before)
        if not state.agg(F.sum("moved")).first()[0]:
            break

    columns = ("row", "doc_id", "size", "text_crc32", "shard")
    homes, pieces = _settle(state, stage, capacity, shards, largest)
    placed = linked.join(homes, "group").select(*columns)
    if pieces:
        # The members of a group that was placed by itself lie on a line of its bytes.
        values = ", ".join(f"('{g}', {a!r}D, double('{b}'), {s})" for g, a, b, s in pieces)
        held = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(group, start, stop, shard)")
        own = linked.join(F.broadcast(held.select("group").distinct()), "group", "left_semi")
        lying = stage.write(running_sum(own, F.col("size"), ("group",), "at"), "pieces")
        middle = F.col("at") + F.col("size") / 2
        lying = lying.join(F.broadcast(held), "group").where((middle >= F.col("start")) & (middle < F.col("stop")))
        placed = placed.unionByName(lying.select(*columns))
    placed = stage.write(placed, "linked")

    # The others lie on a line of bytes, which the shards' free quotas cut; the largest first, so that
    # the smaller ones even out what a cut through a large one leaves.
    loads = {r["shard"]: r["load"] for r in placed.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    parts = [placed]
    mean = alone.agg(F.avg("size")).first()[0] or 0
    bounds = [float("inf"), 4 * mean, mean / 4, 0]
    for below, least in zip(bounds, bounds[1:], strict=False):
        some = alone.where((F.col("size") >= F.lit(least)) & (F.col("size") < F.lit(below)))
        free = [max(0.0, capacity - loads.get(s, 0)) for s in range(shards)]
        line = some.agg(F.sum("size")).first()[0] or 0
        scale = line / sum(free) if sum(free) else 0
        cuts = [scale * sum(free[: s + 1]) for s in range(shards - 1)]
        middle = F.col("at") + F.col("size") / 2
        where = sum(((middle > F.lit(c)).cast("int") for c in cuts), F.lit(0))
        lying = stage.write(running_sum(some, F.col("size"), (), "at").withColumn("shard", where).select(*columns), "line")
        for r in lying.groupBy("shard").agg(F.sum("size").alias("load")).collect():
            loads[r["shard"]] = loads.get(r["shard"], 0) + r["load"]
        parts.append(lying)
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    out = stage.write(parts[0], "shards")
    return running_sum(out, F.lit(1), ("shard",), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

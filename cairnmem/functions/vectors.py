"""Vectors as array columns, and pairs of similar vectors by blocks."""

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(v: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either has no length."""
    # One division, and no test of the length before it, which would compute the length again.
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def cosine_with(a: Column, v: Sequence[float]) -> Column:
    """Cosine similarity with a constant vector, whose length is divided out once, not in every row."""
    length = math.sqrt(sum(float(x) ** 2 for x in v))
    if not length:
        return F.when(a.isNotNull(), 0.0)
    return F.coalesce(F.try_divide(dot(a, literal([x / length for x in v])), norm(a)), F.when(a.isNotNull(), 0.0))


def normalised(a: Column) -> Column:
    """The vector at length 1; unchanged if it has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a)


def blend(a: Column, b: Column, of_a: float) -> Column:
    """of_a parts of a and the rest of b."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * of_a + y.cast("double") * (1.0 - of_a))


def mean_vector(df: DataFrame, by: Sequence[str], vector: str, name: str = "mean") -> DataFrame:
    """The mean vector of each group, by position, so that partial sums combine before the shuffle."""
    places = df.select(*by, F.posexplode(vector).alias("_at", "_x"))
    means = places.groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    listed = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_v"))
    return listed.select(*by, F.transform("_v", lambda s: s["_m"]).alias(name))


def similar_pairs(
    df: DataFrame, id_col: str, vector_col: str, threshold: float, block_rows: int = 4096, within: tuple[str, float] | None = None
) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs a < b with at least the given cosine similarity; exact.

    Rows are dealt to blocks of about ``block_rows`` rows by hash; each pair of blocks is one matrix
    product in one task, and no task holds more than two blocks.  ``within`` names a column and how far
    apart its values may be: then rows are cut into buckets of that width first, and blocks are paired within
    a bucket and with those of the next only, so the work is that of the pairs in reach.  Without it, it is that
    of all pairs, as an exact answer needs.  Null vectors and null places are skipped.
    """
    at, reach = (F.col(within[0]).cast("double"), within[1]) if within else (F.lit(0.0), 1.0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), at.alias("at"))
    rows = rows.where("v is not null and at is not null").withColumn("b", F.floor(F.col("at") / reach))
    blocks = rows.groupBy("b").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    n_of = {d: blocks.select((F.col("b") - d).alias("b"), F.col("n").alias(f"n{d}".replace("-", "_"))) for d in (0, 1, -1)}
    dealt = rows.join(n_of[0], "b").join(n_of[1], "b", "left").join(n_of[-1], "b", "left")
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("id"), F.col("n0")).cast("int"))

    def tasks(n: str, i: Column, j: Column) -> Column:
        """Tasks (bucket of i, i, bucket of j, j) with each block of a bucket."""
        every = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        b = F.col("b") - 1 if n == "n_1" else F.col("b")
        return F.transform(every, lambda o: F.struct(b.alias("b1"), i(o).alias("i"), (b + int(n != "n0")).alias("b2"), j(o).alias("j")))

    k = F.col("k")
    own = F.concat(
        tasks("n0", lambda o: F.least(k, o), lambda o: F.greatest(k, o)), tasks("n1", lambda o: k, lambda o: o), tasks("n_1", lambda o: o, lambda o: k)
    )
    pairs = dealt.select("id", "v", "at", "b", "k", F.explode(own).alias("t")).select("id", "v", "at", "b", "k", "t.*")
    kind = dict(rows.dtypes)["id"]

    def product(table: pa.Table) -> pa.Table:
        ids, v, where = np.array(table["id"].to_pylist()), np.array(table["v"].to_pylist(), dtype=np.float64), table["at"].to_numpy()
        length = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        b1, i, b2, j = (table[c][0].as_py() for c in ("b1", "i", "b2", "j"))
        place = list(zip(table["b"].to_pylist(), table["k"].to_pylist(), strict=True))
        left, right = (np.flatnonzero([p == own for p in place]) for own in ((b1, i), (b2, j)))
        s = v[left] @ v[right].T
        near = s >= threshold
        if within:
            near &= np.abs(where[left][:, None] - where[right][None, :]) <= reach
        a, b = np.nonzero(near)
        one, two = ids[left[a]], ids[right[b]]
        keep = one < two if (b1, i) == (b2, j) else np.ones(len(one), bool)
        low, high = np.where(one < two, one, two)[keep], np.where(one < two, two, one)[keep]
        return pa.table({"id_a": low.tolist(), "id_b": high.tolist(), "similarity": s[a, b][keep]}).cast(schema)

    schema = pa.schema([("id_a", pa.int64() if kind == "bigint" else pa.string()), ("id_b", pa.int64() if kind == "bigint" else pa.string()), ("similarity", pa.float64())])
    return pairs.groupBy("b1", "i", "b2", "j").applyInArrow(product, f"id_a {kind}, id_b {kind}, similarity double")

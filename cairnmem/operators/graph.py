"""The entity graph: edges by last writer, entities, neighbours, chains, names in texts."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmem.runtime import cut

KEY = ("src", "dst", "rel_type")


def last_edges(log: DataFrame, order: tuple[str, ...] = ("at", "nth")) -> DataFrame:
    """One edge a key, with the weight written last; reduced before the shuffle."""
    return log.groupBy(*KEY).agg(F.max_by("weight", F.struct(*order)).alias("weight"), F.max(order[0]).alias(order[0]))


def relate(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (src, dst, rel_type, weight, at, nth) with new ones, of each key the one written last, and the entities
    (name, entity_type) at their ends: the most telling type that any relation gives a name."""
    all_ = edges.unionByName(new.select(edges.columns))
    ends = all_.select(F.explode(F.array("src", "dst")).alias("name"), "rel_type").distinct()
    typed = ends.select("name", entity_type(F.col("name"), F.col("rel_type")).alias("entity_type"))
    # Any type before unknown; of several the first by name.
    best = F.min(F.struct((F.col("entity_type") == "unknown").alias("u"), "entity_type")).alias("t")
    return last_edges(all_), typed.groupBy("name").agg(best).select("name", "t.entity_type")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: entity, other, weight."""
    there = edges.select(F.col("src").alias("entity"), F.col("dst").alias("other"), "rel_type", "weight")
    return there.unionByName(edges.select(F.col("dst").alias("entity"), F.col("src").alias("other"), "rel_type", "weight"))


def edges_of(edges: DataFrame, entity: str) -> DataFrame:
    """Edges that an entity is an end of."""
    return edges.where((F.col("src") == entity) | (F.col("dst") == entity))


def entities(edges: DataFrame, at: str = "at") -> DataFrame:
    """Entities as the edges show them: mentions, first and last seen."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"), at)
    return ends.groupBy("name").agg(F.count("*").alias("mention_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


# Words that name technology, and relations that only people have.
TECH_WORDS = ("api", "database", "server", "python", "rust", "spark", "redis", "docker", "kubernetes", "linux")
PEOPLE_RELATIONS = ("works_at", "lives_in", "married_to", "parent_of", "knows", "manages", "reports_to")
ORG_WORDS = ("inc", "corp", "ltd", "company", "university", "bank")


def entity_type(name: Column, relation: Column | None = None) -> Column:
    """person, tech, organization, event_source or unknown, by words, shape and relation."""
    words = F.split(F.lower(name), "[^\\p{L}0-9]+")
    out = (
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, TECH_WORDS))) & ~name.contains(" "), "tech")
        .when(F.arrays_overlap(words, F.array(*map(F.lit, ORG_WORDS))), "organization")
        .when(name.rlike("^[A-Z][A-Z0-9]{1,7}$"), "tech")
    )
    if relation is not None:
        out = out.when(relation.isin(*PEOPLE_RELATIONS), "person")
    return out.when(name.rlike("^[A-Z][a-z]+( [A-Z][a-z]+){0,2}$"), "person").otherwise("unknown")


def search_entities(found: DataFrame, pattern: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name holds a pattern, in any case; the most mentioned first."""
    out = found.where(F.lower("name").contains(pattern.lower()))
    out = out if kind is None else out.where(F.col("entity_type") == kind)
    return out.orderBy(F.desc("mention_count"), "name").limit(limit)


def hubs(edges: DataFrame, least: int = 5) -> DataFrame:
    """Entities with at least so many different neighbours."""
    degree = both_ways(edges).groupBy("entity").agg(F.countDistinct("other").alias("degree"))
    return degree.where(F.col("degree") >= least)


def proximity(edges: DataFrame, links: DataFrame, seeds: list[str], hops: int = 2) -> DataFrame:
    """(rid, graph_proximity) of memories linked (rid, entity) with what is near the seeds: the best,
    over the ways there, of 1 / (1 + hops)."""
    near = edges.sparkSession.createDataFrame([(s, 0) for s in seeds], "entity string, hops int")
    if hops:
        # Both directions once, and each hop from what the one before reached first: no hop repeats another's work.
        ways = cut(both_ways(edges).select("entity", "other"))
        step = near
        for h in range(1, hops + 1):
            step = step.select("entity").join(ways, "entity").select(F.col("other").alias("entity")).distinct()
            step = step.join(near.select("entity"), "entity", "left_anti").withColumn("hops", F.lit(h))
            step = cut(step) if h < hops else step
            near = near.unionByName(step)
    return links.join(near, "entity").groupBy("rid").agg((1.0 / (1.0 + F.min("hops"))).alias("graph_proximity"))


def chain(start: DataFrame, *steps: DataFrame) -> DataFrame:
    """Paths: the (a, b) of the first frame, each next frame (x, y) joined where x is the last end."""
    out = start.select(F.col("a").alias("e0"), F.col("b").alias("e1"))
    for i, s in enumerate(steps, 1):
        out = out.join(s.select(F.col("a").alias(f"e{i}"), F.col("b").alias(f"e{i + 1}")), f"e{i}")
    return out


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, entity, depth) along edges, the shortest way to each, up to a depth; cycles end there.

    Each depth is checkpointed, so the plan does not grow with the depth.
    """
    seen = seeds.select(F.col("entity").alias("seed"), "entity", F.lit(0).alias("depth"))
    step = seen
    for d in range(1, depth + 1):
        step = step.join(edges.select(F.col("src").alias("entity"), "dst"), "entity").select("seed", F.col("dst").alias("entity"), F.lit(d).alias("depth")).distinct()
        step = cut(step.join(seen, ["seed", "entity"], "left_anti"))
        if not step.limit(1).count():
            break
        seen = seen.unionByName(step)
    return seen


def link_by_name(texts: DataFrame, names: DataFrame, id_col: str = "rid", text_col: str = "text") -> DataFrame:
    """(id, name) where a text holds a name as whole words, in any case.

    An equi join on the name's words in sequence, not a search for every name in every text: texts are
    cut into the word runs of the lengths that names have.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}0-9]+"), lambda w: F.length(w) > 0)
    named = names.select("name", words(F.col("name")).alias("w")).select("name", F.size("w").alias("n"), F.array_join("w", " ").alias("run")).where("n > 0")
    lengths = sorted(r["n"] for r in named.select("n").distinct().collect())
    cut = texts.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    runs = None
    for n in lengths:
        own = cut.where(F.size("w") >= n).select("id", F.explode(F.array_distinct(_runs(n))).alias("run"))
        runs = own if runs is None else runs.unionByName(own)
    if runs is None:
        return texts.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("name")).where("false")
    return runs.join(named, "run").select("id", "name").distinct()


def _runs(n: int) -> Column:
    """All runs of n words of the array w."""
    return F.expr(f"transform(sequence(1, size(w) - {n} + 1), i -> array_join(slice(w, i, {n}), ' '))")


def seeds_of(query: str, names: DataFrame) -> list[str]:
    """Entities (name) that a query names as whole words, in any case; as few as the query has words."""
    words = [w for w in re.split(r"[^\w]+", query.lower()) if w]
    runs = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    plain = F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_]+", " "))
    return sorted(r["name"] for r in names.where(plain.isin(sorted(runs))).select("name").distinct().collect()) if runs else []


def overlapping(sets: DataFrame, by: str, member: str) -> DataFrame:
    """(a, b, n) of groups that have n members in common: an equi join on the member."""
    one = sets.select(F.col(by).alias("a"), F.col(member).alias("m")).distinct()
    two = one.select(F.col("a").alias("b"), "m")
    return one.join(two, "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))

"""Transitive queries over dependency and call edges, safe on cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.operators.facts import Facts, impact_units
from quarrymap.sources.storage import stored


#: Rounds in which a knot is looked for (what is found sooner than all of it is one, too), how many are, and the least worth it.
KNOT_ROUNDS, MOST_KNOTS, LEAST_KNOT = 16, 4, 16
#: Pairs that a task writes out at a time, about.
TASK_PAIRS = 1 << 19


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of all pairs with a path.

    Large sets of nodes that all reach one another (knots) are taken as one node each, which saves the cube of their size;
    of what is left, and of the knots, paths are doubled (``_doubled``). The pairs between members of knots are written out
    last, those of one knot by many tasks.
    """
    pairs = stored(edges.select("src", "dst").distinct())
    knots = _knots(pairs)
    if knots is None:
        return _doubled(pairs)
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    member = stored(ids.join(knots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    src, dst = (member.select(F.col("id").alias(c), F.col("root").alias(f"_{c}")) for c in ("src", "dst"))
    reach = _doubled(stored(pairs.join(src, "src", "left").join(dst, "dst", "left").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()))
    ahead = stored(src.join(reach.toDF("_src", "_dst"), "_src").select("src", "_dst"))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = ahead.groupBy("_dst").agg(F.count("*").alias("n")).join(dst.groupBy("_dst").agg(F.count("*").alias("m")), "_dst")
    each = stored(each.select("_dst", F.least(F.ceil(F.col("n") * F.col("m") / TASK_PAIRS), F.lit(4 * parts), "n").alias("turns")))
    ahead = ahead.join(each, "_dst").select("src", "_dst", F.pmod(F.xxhash64("src"), "turns").alias("turn")).repartition(parts, "_dst", "turn")
    ends = dst.join(each, "_dst").select("dst", "_dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"))
    bare = reach.filter("src IS NULL OR dst IS NULL").toDF("_src", "_dst").join(src, "_src", "left").join(dst, "_dst", "left")  # a null is an end, but leads nowhere
    return ahead.join(ends, ["_dst", "turn"]).select("src", "dst").union(bare.select("src", "dst"))


def _knots(pairs: DataFrame) -> DataFrame | None:
    """id, root: sets of LEAST_KNOT nodes and more that all reach one another, each around its node with the most edges; None where none is found."""
    found: DataFrame | None = None
    for _ in range(MOST_KNOTS):
        free = pairs if found is None else pairs.join(found.select(F.col("id").alias("src")), "src", "left_anti")
        into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
        through = stored(free.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")).join(into, "id"))
        if through.count() < LEAST_KNOT:
            break
        most = stored(through.orderBy(F.desc(F.least("i", "o")), "id").limit(1).select("id"))
        ahead = reachable(pairs, most, KNOT_ROUNDS)
        both = reachable(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), most, KNOT_ROUNDS).join(ahead, "id", "left_semi")
        knot = stored(both.crossJoin(most.select(F.col("id").alias("root"))))
        if knot.count() < LEAST_KNOT:
            break
        found = knot if found is None else found.union(knot.join(found, "id", "left_anti"))
    return found


def _doubled(known: DataFrame) -> DataFrame:
    """src, dst of all pairs with a path in a stored table of edges. Paths double each round, so rounds grow with the log of the longest path.

    Each round joins only what is new with all that is known, and is kept as a table in the shared folder.
    """
    new = known
    while not new.isEmpty():
        ahead = new.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        behind = known.join(new.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        found, seen = ahead.union(behind).distinct(), known.toDF("_src", "_dst")
        new = stored(found.join(seen, found["src"].eqNullSafe(seen["_src"]) & found["dst"].eqNullSafe(seen["_dst"]), "left_anti"))
        known = known.union(new)
    return known


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """id of the seeds and all that can be reached from them along src -> dst, in at most so many rounds where a number is given.

    The edges are dealt out by src once and kept on the executors' disks, so a round moves ids only; what is lost with an
    executor is made again.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.select("src", "dst").repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    try:
        edges.count()  # for a plan to see how the edges are dealt out they have to be there
        seen = stored(seeds.select("id").distinct())
        frontier = seen
        while rounds != 0 and not frontier.isEmpty():
            step = edges.join(frontier, edges.src == frontier.id, "left_semi").select(F.col("dst").alias("id")).distinct()
            frontier = stored(step.join(seen, "id", "left_anti"))
            seen = seen.union(frontier)
            rounds = None if rounds is None else rounds - 1
    finally:
        edges.unpersist()
    return seen


def impact_transitive(facts: Facts, paths: Sequence[str]) -> DataFrame:
    """unit_id of the units that own a changed file or depend, over any number of steps, on one that does."""
    backward = facts["deps"].select(F.col("to_unit_id").alias("src"), F.col("from_unit_id").alias("dst"))
    return reachable(backward, impact_units(facts, paths).select(F.col("unit_id").alias("id"))).select(F.col("id").alias("unit_id"))


def impact_symbols(facts: Facts, paths: Sequence[str]) -> DataFrame:
    """symbol_id of the symbols of affected units and of their direct and indirect callers and subtypes."""
    units = impact_units(facts, paths)
    seeds = facts["symbols"].join(units, "unit_id", "left_semi").select("id")
    calls = facts["call_edges"].select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    types = facts["type_relations"].select(F.col("to_type_id").alias("src"), F.col("from_type_id").alias("dst"))
    return reachable(calls.union(types), seeds).select(F.col("id").alias("symbol_id"))


def expanded_calls(facts: Facts) -> DataFrame:
    """caller_id, callee_id: calls, and for a call of an interface also the types that implement what it calls."""
    calls = facts["call_edges"]
    impl = facts["type_relations"].filter("kind = 'implements'").select("from_type_id", F.col("to_type_id").alias("callee_id")).distinct()
    through = calls.filter("dispatch = 'interface'").join(impl, "callee_id").select("caller_id", F.col("from_type_id").alias("callee_id"))
    return calls.select("caller_id", "callee_id").union(through).distinct()


def impact_with_intent(facts: Facts, intent_tags: DataFrame, paths: Sequence[str], intent: str) -> DataFrame:
    """unit_id, intent of the units in transitive impact that are tagged with the intent."""
    tagged = intent_tags.filter((F.col("intent") == intent) & (F.col("target_kind") == "unit")).select(F.col("target_id").alias("unit_id"), "intent").distinct()
    return impact_transitive(facts, paths).join(tagged, "unit_id")

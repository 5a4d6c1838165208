"""Graph operators on nodes (id, label, ...) and edges (source_id, target_id, relation, weight)."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attributes as A


def requires(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, needs: REQUIRES edges with both ends in the graph, each once."""
    pairs = edges.where("relation = 'REQUIRES'").select(F.col("source_id").alias("id"), F.col("target_id").alias("needs"))
    ids = nodes.select("id")
    return pairs.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "needs"), "needs", "left_semi").select("id", "needs")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbers of direct prerequisites and of dependents of every node."""
    pairs = requires(edges, nodes)
    a = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_prerequisites"))
    b = pairs.groupBy(F.col("needs").alias("id")).agg(F.count(F.lit(1)).alias("n_dependents"))
    return nodes.select("id").join(a, "id", "left").join(b, "id", "left").na.fill(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="paideia-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _saved(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(pairs: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """id, needs, depth: all direct and indirect prerequisites with their least depth; cycles end.

    ``start`` (id) limits the nodes whose prerequisites are wanted. The frontier is joined to the
    edges level by level, each level is written once, and what is known already is not followed again. Without ``start``
    the result has a row for every node and prerequisite, which is the size of the question.
    """
    first = pairs if start is None else pairs.join(start, "id", "left_semi")
    frontier = _saved(first.distinct().withColumn("depth", F.lit(1)))
    levels = [frontier]
    step = pairs.select(F.col("id").alias("needs"), F.col("needs").alias("onward"))
    while not frontier.isEmpty():
        reached = frontier.join(step, "needs").select("id", F.col("onward").alias("needs")).distinct()
        found = reduce(DataFrame.unionByName, levels)
        frontier = _saved(reached.join(found, ["id", "needs"], "left_anti").withColumn("depth", F.lit(len(levels) + 1)))
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def neighbours(edges: DataFrame) -> DataFrame:
    """id, neighbour, direction, relation: what a node's edges lead to, seen from both ends."""
    is_requires = F.col("relation") == "REQUIRES"
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour"), F.when(is_requires, "parent").otherwise("out").alias("direction"), "relation")
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour"), F.when(is_requires, "child").otherwise("in").alias("direction"), "relation")
    return out.unionAll(back)


#: Directions that a walk to parents or to children takes.
WALKS = {"parents": ("parent", "in"), "children": ("child", "out"), "both": ("parent", "child", "in", "out")}


def relatives(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """A row for each edge met on the way out from ``start``; every node is expanded once. ``nearest_first`` has their order."""
    steps = neighbours(edges).where(F.col("direction").isin(*WALKS[direction]))
    if relations is not None:
        steps = steps.where(F.col("relation").isin(*relations)) if relations else steps.limit(0)
    ends = nodes.select(F.col("id").alias("neighbour"), "label", "kind")
    steps = steps.join(ends, "neighbour")
    frontier = nodes.where(F.col("id") == start).select("id")
    seen, out = frontier, None
    for level in range(1, depth + 1):
        met = steps.join(frontier, "id", "left_semi").select(F.col("id").alias("from_id"), F.col("neighbour").alias("id"), "label", "kind", "direction", "relation").withColumn("depth", F.lit(level))
        out = met if out is None else out.unionByName(met)
        frontier = met.select("id").distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(frontier)
    return out


def nearest_first() -> list[Column]:
    return [F.col("depth"), F.col("direction"), F.col("label"), F.col("id"), F.col("from_id"), F.col("relation")]


def _by_labels(labels: Column, ways: Column) -> Column:
    """Sorts as ``labels`` with each of them repeated ``ways`` times would, without repeating them.

    Runs of equal labels (label, count) sort by label; of equal ones, the shorter run is first unless a higher label follows it.
    """

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(x.alias("label"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(acc) > 0) & last["label"].eqNullSafe(x), longer).otherwise(F.concat(acc, F.array(F.struct(x.alias("label"), F.lit(1).cast("long").alias("n")))))

    runs = F.aggregate(labels, F.array().cast("array<struct<label:string,n:bigint>>"), add)

    def key(r, i):
        up = F.coalesce(F.try_element_at(runs, i + 2)["label"] > r["label"], F.lit(False))
        return F.struct(r["label"].alias("label"), up.alias("up"), (r["n"] * F.when(up, -ways).otherwise(ways)).alias("n"))

    return F.transform(runs, key)


def first_principles(nodes: DataFrame, edges: DataFrame, target: str, max_paths: int = 3, every_way: bool = False) -> DataFrame:
    """Paths from a node without prerequisites to ``target``, shortest first; a cycle ends a path with its repeated node.

    Parallel edges make one path; with ``every_way`` its length and minutes count once for each way through them.
    """
    n = F.count(F.lit(1)) if every_way else F.lit(1).cast("long")
    pairs = _saved(requires(edges, nodes).groupBy("id", "needs").agg(n.alias("n")))
    paths = nodes.where(F.col("id") == target).groupBy("id").agg(n.alias("ways")).select(F.array("id").alias("path"), "ways", F.lit(False).alias("done"))
    step = pairs.select(F.col("id").alias("head"), "needs", "n")
    complete = None
    while True:
        grown = paths.withColumn("head", F.col("path")[0]).join(step, "head", "left")
        ended = grown.where(F.col("needs").isNull() | F.col("done")).select("path", "ways").distinct()
        complete = ended if complete is None else complete.unionByName(ended)
        onward = grown.where(F.col("needs").isNotNull() & ~F.col("done"))
        paths = _saved(onward.select(F.concat(F.array("needs"), "path").alias("path"), (F.col("ways") * F.col("n")).alias("ways"), F.array_contains("path", F.col("needs")).alias("done")))
        if paths.isEmpty():
            break
    numbered = complete.select(F.array_join("path", ">").alias("nodes"), "ways", F.posexplode("path").alias("at", "id"))
    minutes = A.or_default(F.col("minutes").cast("double"), 15.0).cast("int")
    facts = numbered.join(nodes.select("id", "label", minutes.alias("minutes")), "id")
    rows = facts.groupBy("nodes", "ways").agg(F.sum("ways").alias("length"), F.sum(F.col("minutes") * F.col("ways")).alias("minutes"), F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
    rank = F.row_number().over(Window.orderBy("length", "minutes", _by_labels(F.col("labels"), F.col("ways")), "nodes"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max(1, max_paths)).select("rank", "nodes", "length", "minutes")


def learning_path(view: DataFrame, edges: DataFrame, target: str, max_steps: int | None = None, include_review: bool = False) -> DataFrame:
    """The unmastered prerequisites of ``target`` and itself, prerequisites first.

    Order: longest way from a node without open prerequisites, then difficulty, label, id.
    """
    pairs = requires(edges, view)
    needed = closure(pairs, view.where(F.col("id") == target).select("id")).select(F.col("needs").alias("id"))
    wanted = needed.unionByName(view.where(F.col("id") == target).select("id")).distinct()
    limit = F.lit(1.0) if include_review else F.col("threshold")
    kept = _saved(view.join(wanted, "id", "left_semi").where(F.col("mastery") < limit))
    own = _saved(pairs.join(kept.select("id"), "id", "left_semi").join(kept.select(F.col("id").alias("needs")), "needs", "left_semi").where("id <> needs"))
    # Longest ways grow by one edge a round, only from nodes that the round before raised; a cycle stops at the number of nodes.
    levels = raised = _saved(kept.select("id", F.lit(0).alias("level")))
    for _ in range(max(1, kept.count())):
        up = own.join(raised.withColumnRenamed("id", "needs"), "needs").groupBy("id").agg((F.max("level") + 1).alias("up"))
        after = _saved(levels.join(up, "id", "left").select("id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.col("up") > F.col("level")).alias("raised")))
        levels, raised = after.select("id", "level"), after.where("raised").select("id", "level")
        if raised.isEmpty():
            break
    at = F.row_number().over(Window.orderBy("level", "difficulty", "label", "id"))
    steps = kept.join(levels, "id").withColumn("step", at).withColumn("minutes", F.greatest(F.lit(3), F.col("minutes")))
    return steps if max_steps is None else steps.where(F.col("step") <= max_steps)


def sessions(steps: DataFrame, session_minutes: int = 35) -> DataFrame:
    """step, session: greedy packing; a session ends when the next step would exceed its minutes."""
    rows = steps.agg(F.array_sort(F.collect_list(F.struct("step", "minutes"))).alias("s"))  # one path is one plan

    def put(acc, x):
        over = (acc["n"] > 0) & (acc["total"] + x["minutes"] > session_minutes)
        number = acc["session"] + F.when(over, 1).otherwise(0)
        total = F.when(over, x["minutes"]).otherwise(acc["total"] + x["minutes"])
        made = F.struct(x["step"].alias("step"), number.cast("int").alias("session"))
        return F.struct(number.cast("int").alias("session"), total.cast("int").alias("total"), (acc["n"] + 1).cast("int").alias("n"), F.concat(acc["made"], F.array(made)).alias("made"))

    zero = F.struct(F.lit(0).alias("session"), F.lit(0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<struct<step:int,session:int>>").alias("made"))
    return rows.select(F.inline(F.aggregate("s", zero, put)["made"]))


def session_totals(steps: DataFrame, session_minutes: int = 35) -> DataFrame:
    """session, minutes, n_steps of the plan that ``sessions`` makes."""
    placed = sessions(steps, session_minutes).join(steps.select("step", "minutes"), "step")
    return placed.groupBy("session").agg(F.sum("minutes").alias("minutes"), F.count(F.lit(1)).alias("n_steps"))


def path_packet(steps: DataFrame, session_minutes: int = 25) -> DataFrame:
    """One row: total_minutes, steps and sessions of one learning path, each in order."""
    step = F.struct("step", "id", "label", "kind", "mastery", "threshold", F.col("minutes").alias("estimated_minutes"), "difficulty")
    placed = steps.join(sessions(steps, session_minutes), "step").withColumn("s", step)
    own = F.sort_array(F.collect_list("s"))
    each = placed.groupBy("session").agg(F.sum("minutes").cast("int").alias("estimated_minutes"), own.alias("steps"))
    inside = each.agg(F.sort_array(F.collect_list(F.struct(F.col("session").alias("ordinal"), "estimated_minutes", "steps"))).alias("sessions"))
    whole = steps.withColumn("s", step).agg(F.coalesce(F.sum("minutes"), F.lit(0)).cast("int").alias("total_minutes"), own.alias("steps"))
    return whole.join(inside)  # one row each

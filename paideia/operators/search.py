"""Search over nodes and exercises."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attributes as A
from ..functions import labels as L
from . import graph
from .learner import with_attributes

#: What a match in each field counts (fixed values).
FIELDS = {"id": 1.25, "label": 1.18, "aliases": 1.12, "description": 1.0, "extended_description": 0.95, "properties": 0.82, "sources": 0.72}
EXACT = {"id": 1.0, "label": 0.98, "aliases": 0.96}
LEAST = 0.18


#: Columns that a node may have besides id, label and kind, and what stands for one that a table lacks.
OPTIONAL = {"description": "string", "extended_description": "string", "aliases": "array<string>", "properties": "map<string,string>", "sources": "array<struct<doc_id:string,chunk_id:string,title:string,source_path:string,page_start:int,page_end:int,quote:string>>"}


def completed(nodes: DataFrame) -> DataFrame:
    """Nodes with their derived attributes and all optional columns; a missing text is empty, a missing list or map has no items."""
    rows = nodes.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in nodes.columns})
    empty = {"description": F.lit(""), "extended_description": F.coalesce(F.try_element_at("properties", F.lit("extended_description")), F.lit("")), "aliases": F.array(), "properties": F.create_map(), "sources": F.array()}
    return with_attributes(rows).withColumns({c: F.coalesce(F.col(c).cast(t), empty[c].cast(t)) for c, t in OPTIONAL.items()})


def haystacks(nodes: DataFrame) -> DataFrame:
    """id, label, kind and the normalised text of each field; columns that nodes lack are empty fields."""
    rows = completed(nodes)
    free = F.map_values(F.map_filter("properties", lambda k, v: k != "extended_description"))
    numbers = [F.col(c).cast("string") for c in ("difficulty", "threshold", "minutes", "exam_relevance", "is_threshold")]
    told = lambda n: F.transform("sources", lambda s: F.coalesce(s[n], F.lit("")))
    fields = {f: F.col(f) for f in ("id", "label", "description", "extended_description")}
    fields["aliases"] = F.array_join("aliases", " ")
    fields["properties"] = F.concat_ws(" ", "extended_description", *numbers, free)
    fields["sources"] = F.concat_ws(" ", told("quote"), told("title"))
    return rows.select("id", "label", "kind", *[L.normalize_text(fields[f]).alias(f"h_{f}") for f in FIELDS], F.transform("aliases", L.normalize_text).alias("each_alias"))


def _plain(query: Column, hay: Column) -> Column:
    """The score without the fuzzy part: equal, contained, or shared words."""
    words = F.array_distinct(L.tokens(query))
    share = F.size(F.array_intersect(words, F.array_distinct(L.tokens(hay)))) / F.greatest(F.lit(1), F.size(words))
    return F.when((query == "") | (hay == ""), 0.0).when(query == hay, 1.0).when(hay.contains(query), 0.78).otherwise(0.72 * share)


def search(nodes: DataFrame, query: str, limit: int | None = 8, kinds: list[str] | None = None, least: float = LEAST, fuzzy: bool = True) -> DataFrame:
    """id, label, score, matched (fields): the best nodes first.

    The fuzzy ratio runs in Python only on fields that are neither equal nor contained and whose shared words
    score below what the ratio could reach.
    """
    rows = haystacks(nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds)))
    q = L.normalize_text(F.lit(query))
    rows = rows.withColumn("q", q).where("q <> ''")
    score = {f: _plain(F.col("q"), F.col(f"h_{f}")) for f in FIELDS}
    rows = rows.withColumns({f"s_{f}": c for f, c in score.items()})
    if fuzzy:
        rows = _with_ratio(rows)
    weighted = {f: F.least(F.lit(1.0), F.col(f"s_{f}") * w) for f, w in FIELDS.items()}
    equal = {f: F.array_contains("each_alias", F.col("q")) if f == "aliases" else F.col("q") == F.col(f"h_{f}") for f in EXACT}
    boosted = {f: F.when(equal[f], F.greatest(c, F.lit(EXACT[f]))).otherwise(c) if f in EXACT else c for f, c in weighted.items()}
    rows = rows.withColumns({f"w_{f}": c for f, c in boosted.items()}).withColumn("best", F.greatest(*[F.col(f"w_{f}") for f in FIELDS]))
    bar = F.greatest(F.lit(0.25), F.col("best") - 0.08)
    matched = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"w_{f}") >= bar, F.lit(f)) for f in FIELDS]))), ",")
    found = rows.where(F.col("best") >= least).select("id", "label", F.round("best", 4).alias("score"), matched.alias("matched"))
    ordered = found.orderBy(F.desc("score"), "label", "id")
    return ordered if limit is None else ordered.limit(limit)


def _with_ratio(rows: DataFrame) -> DataFrame:
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in FIELDS:
                hays, scores = frame[f"h_{f}"], frame[f"s_{f}"].to_numpy(copy=True)
                for i, (q, hay) in enumerate(zip(frame["q"], hays)):
                    cut = hay[: max(40, 4 * len(q))]
                    if hay and scores[i] < 0.55 * 2 * min(len(q), len(cut)) / (len(q) + len(cut)):
                        scores[i] = max(scores[i], 0.55 * SequenceMatcher(None, q, cut).ratio())
                frame[f"s_{f}"] = scores
            yield frame[columns]

    return rows.mapInPandas(run, rows.schema)


def resolve(nodes: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """id, tier: the node of that id, or else of that label or alias, or else (``fuzzy``) the best search hit; no row when there is none."""
    q = L.normalize_text(F.lit(query))
    named = L.normalize_text(F.col("label")) == q
    if "aliases" in nodes.columns:
        named = named | F.coalesce(F.exists("aliases", lambda a: L.normalize_text(a) == q), F.lit(False))
    tier = F.when(F.col("id") == query, 1).when(named, 2)
    found = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    if fuzzy:
        found = found.unionByName(search(nodes, query, limit=1).select("id", F.lit(3).alias("tier")))
    return found.orderBy("tier", "id").limit(1)


#: Fields of a packet that are always there.
IDENTITY = ("id", "label", "kind")


def node_packets(nodes: DataFrame, states: DataFrame | None = None, learner_id: int | None = None, sources: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Nodes as tutors read them: texts, aliases, standard properties, sources, and one learner's state where ``states`` are given.

    ``fields`` chooses columns; identity stays, and names that a packet doesn't have are ignored.
    """
    rows = completed(nodes)
    standard = ("difficulty", "threshold", "minutes", "exam_relevance", "is_threshold")
    properties = F.struct(F.col("difficulty"), F.col("threshold").alias("mastery_threshold"), F.col("minutes").alias("estimated_minutes"), "exam_relevance", F.coalesce("is_threshold", F.lit(False)).alias("is_threshold_concept"), F.map_filter("properties", lambda k, v: ~k.isin(*standard)).alias("other"))
    out = [*IDENTITY, "description", "extended_description", "aliases", properties.alias("properties")] + (["sources"] if sources else [])
    if states is not None:
        own = states.where(F.col("learner_id") == learner_id).select(F.col("node_id").alias("id"), F.struct(*[c for c in states.columns if c not in ("learner_id", "node_id")]).alias("s"))
        rows = rows.join(own, "id", "left")
        part = lambda n, kind, default: F.coalesce(F.col(f"s.{n}"), F.lit(default)).cast(kind).alias(n) if n in states.columns else F.lit(default).cast(kind).alias(n)
        mastery = F.coalesce(F.col("s.mastery"), F.lit(0.0))
        numbers = [part("confidence", "double", 0.0), *[part(n, "int", 0) for n in ("attempts", "correct_attempts", "streak")]]
        at = F.col("s.reviewed_at") + F.make_dt_interval(F.col("s.interval_days")) if {"reviewed_at", "interval_days"} <= set(states.columns) else F.lit(None).cast("timestamp")
        mistakes = F.coalesce("s.mistakes", F.array().cast("array<string>")) if "mistakes" in states.columns else F.array().cast("array<string>")
        state = F.struct(F.col("id").alias("node_id"), mastery.alias("mastery"), *numbers, A.mastery_status(mastery, F.col("threshold")).alias("status"), F.col("s.gap_type").alias("gap_type"), mistakes.alias("common_mistakes"), part("last_at", "timestamp", None).alias("last_attempt_at"), at.alias("next_review_at"), "threshold")
        out.append(state.alias("learner_state"))
    packets = rows.select(*out)
    return packets if fields is None else packets.select(*dict.fromkeys([*IDENTITY, *(f for f in fields if f in packets.columns)]))


def edge_packets(edges: DataFrame) -> DataFrame:
    """Edges without their sources."""
    column = lambda n, kind: F.col(n) if n in edges.columns else F.lit(None).cast(kind).alias(n)
    return edges.select("source_id", "target_id", F.col("relation").alias("relation_type"), column("weight", "double"), column("evidence", "string"))


def source_refs(nodes: DataFrame) -> DataFrame:
    """node_id, node_label, pos and the parts of each source of each node."""
    return completed(nodes).select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.posexplode("sources").alias("pos", "s")).select("node_id", "node_label", "pos", "s.*")


def source_quotes(refs: DataFrame, limit: int = 8) -> DataFrame:
    """place and the first ``limit`` distinct quotes (by document, chunk and text) of sources (rank of the node, pos, quote ...)."""
    told = refs.where("quote <> ''").withColumn("o", F.struct("rank", "pos", "node_id"))
    key = [F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_id", F.lit("")), F.col("quote")]
    rest = [c for c in refs.columns if c not in ("rank", "pos")]
    first = told.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*rest), "o").alias("r"), F.min("o").alias("o")).orderBy("o").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("o")).alias("place"), "r.*")


def get_node(nodes: DataFrame, edges: DataFrame, query: str, states: DataFrame | None = None, learner_id: int | None = None, fields: list[str] | None = None, relatives: bool = False, sources: bool = True) -> DataFrame:
    """One row: query, found, node (a packet), relatives (edges around it, in order, or null), matches (the five best hits, or null when found)."""
    hit = resolve(nodes, query)
    packets = node_packets(nodes, states, learner_id, sources, fields)
    packet = packets.join(F.broadcast(hit.select("id")), "id", "left_semi")  # one id
    one = packet.agg(F.first(F.struct(*packets.columns)).alias("node"))
    best = search(nodes, query, limit=5).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "label", "id", "score", "matched"))).alias("m"))
    matches = F.transform("m", lambda m: F.struct(m["id"].alias("node_id"), m["score"].alias("score"), m["matched"].alias("matched_fields")))
    out = one.join(best.select(matches.alias("matches")))  # one row each
    if relatives:
        around = graph.neighbours(edges).join(F.broadcast(hit.select("id")), "id", "left_semi").join(nodes.select(F.col("id").alias("neighbour"), "label", "kind"), "neighbour")
        each = F.sort_array(F.collect_list(F.struct("direction", "label", F.col("neighbour").alias("node_id"), "kind", "relation")))
        out = out.join(around.agg(each.alias("relatives")))
    else:
        out = out.withColumn("relatives", F.lit(None).cast("array<string>"))
    found = F.col("node").isNotNull()
    return out.select(F.lit(query).alias("query"), found.alias("found"), "node", F.when(found, F.col("relatives")).alias("relatives"), F.when(~found, F.col("matches")).alias("matches"))


def context_retrieve(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 8, depth: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a teaching context is made of: the matches (rank, id, label, score, matched), the nodes around them
    (place, id, label, kind, direction, relation, depth, match, role: each node once, by its first edge), and quotes.

    All matches are expanded together, one join a level; a role's list are its rows in order.
    """
    hits = search(nodes, query, limit=limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "label", "id")))
    hits = graph._saved(hits)
    steps = graph.neighbours(edges).join(nodes.select(F.col("id").alias("neighbour"), "label", "kind"), "neighbour")
    frontier = hits.select("rank", "id")
    seen, met = frontier, None
    for level in range(1, depth + 1):
        reached = steps.join(frontier, "id").select("rank", F.col("id").alias("from_id"), F.col("neighbour").alias("id"), "label", "kind", "direction", "relation").withColumn("depth", F.lit(level))
        met = reached if met is None else met.unionByName(reached)
        frontier = reached.select("rank", "id").distinct().join(seen, ["rank", "id"], "left_anti")
        seen = seen.unionByName(frontier)
    told = roles(met if met is not None else steps.limit(0).select(F.lit(0).alias("rank"), F.col("id").alias("from_id"), F.col("neighbour").alias("id"), "label", "kind", "direction", "relation", F.lit(0).alias("depth")))
    order = F.struct("rank", "depth", "direction", "label", "id", "relation")
    # A node is listed once among all, and once in each role that one of its edges gives it.
    listed = told.withColumn("o", order).withColumn("role", F.explode(F.array_compact(F.array(F.lit("supporting"), "role"))))
    first = listed.groupBy("role", "id").agg(F.min("o").alias("o"), F.min_by(F.struct("label", "kind", "direction", "relation", "depth", F.col("rank").alias("match")), "o").alias("r"))
    place = F.row_number().over(Window.partitionBy("role").orderBy("o"))
    around = first.select("role", place.alias("place"), "id", "r.*")
    quotes = source_quotes(source_refs(nodes).join(hits.select(F.col("id").alias("node_id"), "rank"), "node_id"), limit)
    return hits, around, quotes


def required_packets(exercises: DataFrame, packets: DataFrame) -> DataFrame:
    """exercise_id, place and the packet's columns of the nodes that each exercise requires, in their order; unknown ones are left out."""
    needs = exercises.select("exercise_id", F.posexplode("required").alias("place", "id"))
    return needs.join(packets, "id").select("exercise_id", "place", *packets.columns)


def get_exercise(exercises: DataFrame, exercise_id: str, nodes: DataFrame | None = None, states: DataFrame | None = None, learner_id: int | None = None, solution: bool = False) -> DataFrame:
    """One row: exercise_id, found, exercise (without its solution unless asked for), required_nodes (packets in order; null without ``nodes``)."""
    shown = [c for c in exercises.columns if solution or c != "solution"]
    own = exercises.where(F.col("exercise_id") == exercise_id)
    one = own.agg(F.first(F.struct(*shown)).alias("exercise"))
    if nodes is None:
        out = one.withColumn("required_nodes", F.lit(None).cast("array<string>"))
    else:
        packets = node_packets(nodes, states, learner_id)
        each = F.struct("place", F.struct(*packets.columns).alias("node"))
        needed = required_packets(own, packets).agg(F.transform(F.array_sort(F.collect_list(each), lambda a, b: a["place"] - b["place"]), lambda x: x["node"]).alias("required_nodes"))
        out = one.join(needed)  # one row each
    found = F.col("exercise").isNotNull()
    return out.select(F.lit(exercise_id).alias("exercise_id"), found.alias("found"), "exercise", F.when(found, F.col("required_nodes")).alias("required_nodes"))


def roles(relatives: DataFrame) -> DataFrame:
    """The part that a relative plays in a teaching context."""
    role = (
        F.when((F.col("relation") == "REQUIRES") & (F.col("direction") == "parent"), "prerequisite")
        .when((F.col("relation") == "HAS_FORMULA") | (F.col("kind") == "formula"), "formula")
        .when((F.col("relation") == "USED_IN_PROBLEM_TYPE") | (F.col("kind") == "problem_type"), "problem_type")
        .when(F.col("relation") == "RELATED_TO", "related")
    )
    return relatives.withColumn("role", role)


def difficulty_matches(difficulty: Column, wanted: str | float | None) -> Column:
    if wanted is None:
        return F.lit(True)
    if not isinstance(wanted, str):
        return F.abs(difficulty - float(wanted)) <= 0.20
    bands = {"easy": difficulty <= 0.45, "medium": difficulty.between(0.30, 0.75), "hard": difficulty >= 0.60}
    return bands.get(wanted.lower(), F.lit(True))


def new_concepts(exercises: DataFrame, view: DataFrame) -> DataFrame:
    """exercise_id, new_concepts: required nodes below their threshold; unknown ones don't count."""
    low = view.where(F.col("mastery") < F.col("threshold")).select(F.col("id").alias("need"))
    needs = exercises.select("exercise_id", F.explode("required").alias("need"))
    counted = needs.join(low, "need").groupBy("exercise_id").agg(F.count(F.lit(1)).alias("n"))
    return exercises.select("exercise_id").join(counted, "exercise_id", "left").select("exercise_id", F.coalesce("n", F.lit(0)).cast("long").alias("new_concepts"))


def search_exercises(exercises: DataFrame, view: DataFrame, query: str | None = None, targets: list[str] | None = None, difficulty: str | float | None = None, max_new: int | None = 1, priority: str | None = "course", ladder: str | None = None, limit: int | None = 5) -> DataFrame:
    """exercise_id, difficulty, new_concepts, score: the best exercises first."""
    rows = exercises.where(difficulty_matches(F.col("difficulty"), difficulty))
    if targets:
        rows = rows.where(F.arrays_overlap("required", F.array(*map(F.lit, targets))))
    if ladder:
        rows = rows.where(F.col("ladder") == ladder)
    rows = rows.join(new_concepts(exercises, view), "exercise_id")
    if max_new is not None:
        rows = rows.where(F.col("new_concepts") <= max_new)
    score = F.lit(0.0)
    if query:
        own = [c for c in ("statement", "problem_type", "ladder", "source_path", "required", "trap_flags") if c in exercises.columns]
        hay = L.normalize_text(F.concat_ws(" ", *own))
        q = L.normalize_text(F.lit(query))
        words = F.array_distinct(L.tokens(q))
        share = F.size(F.array_intersect(words, F.array_distinct(L.tokens(hay)))) / F.greatest(F.lit(1), F.size(words))
        score = F.when(hay.contains(q), 0.5).otherwise(0.35 * share)
    if targets:
        score = score + 0.45
    if priority:
        score = score + F.when(F.col("priority") == priority, 0.20).otherwise(0.0)
    score = score + F.greatest(F.lit(0.0), 1 - F.col("difficulty")) * 0.10 - F.greatest(F.lit(0), F.col("steps") - 1) * 0.02
    ranked = rows.select("exercise_id", "difficulty", "new_concepts", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "difficulty", "exercise_id")
    return ranked if limit is None else ranked.limit(limit)

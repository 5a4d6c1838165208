"""The engine's commands: files in, JSON on standard output or files out.

``python -m paideia.commands <command> --argument value ...``; each command is a function with the same arguments.
"""

from __future__ import annotations

import inspect
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assessment, chunking, graph, learner, markdown, resolution, search
from .plans import context
from .sources import files

COMMANDS: dict = {}


def command(name: str):
    def register(f):
        COMMANDS[name] = f
        return f

    return register


def csv(text: str | None) -> list[str] | None:
    """The items of a comma-separated argument."""
    return [t for t in map(str.strip, text.split(",")) if t] if text else None


def say(packet) -> None:
    print(json.dumps(packet, indent=2, ensure_ascii=False, default=str))


def _graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return files.read_graph(spark, path)


def _states(spark: SparkSession, path: str | None, learner_id: str | None) -> tuple[DataFrame, str]:
    """States of a profile file, and whose they are: the learner asked for, or the file's."""
    rows = files.read_profile(spark, path or "/nonexistent-profile")
    own = rows.select("learner_id").first() if learner_id is None else None
    return rows, learner_id if own is None else own.learner_id


def _learner(learner_id):
    return "default" if learner_id is None else learner_id


# Corpus to graph


@command("chunk")
def chunk(spark, documents: str, out: str, max_chars: int = 3500, overlap: int = 300):
    files.write_lines(chunking.chunk_documents(files.read_documents(spark, documents), max_chars, overlap), out)


@command("prompt")
def prompt(spark, chunks: str, out: str):
    files.write_lines(chunking.prompts(files.read_chunks(spark, chunks)), out)


@command("demo-extract")
def demo_extract(spark, chunks: str, out: str):
    found = chunking.extract_by_rules(files.read_chunks(spark, chunks))
    none = F.array().cast("array<string>")
    files.write_extractions(found.withColumns({n: none for n in ("prerequisites", "related", "problem_types", "aliases")}), out)


@command("fuse")
def fuse(spark, extractions: str, out: str):
    fields = F.col("c.*")
    rows = files.read_extractions(spark, extractions).select("chunk_id", F.posexplode("concepts").alias("pos", "c")).select("chunk_id", "pos", fields)
    fused = graph._saved(resolution.fuse_concepts(rows))
    files.write_extractions(fused.drop("group_size"), out)
    files.print_json(resolution.fusion_report(fused).withColumn("method", F.lit("lexical")))


@command("build")
def build(spark, chunks: str, extractions: str, out: str):
    own, found = files.read_chunks(spark, chunks), files.read_extractions(spark, extractions)
    nodes, edges, report = resolution.build_with_report(own, found)
    missing = [r.chunk_id for r in resolution.without_chunk(own, found).orderBy("chunk_id").limit(context.MOST).collect()]
    files.export_graph(nodes, edges, out, {"stats": report.first().asDict(), "extractions_without_chunk": missing})


@command("summarize")
def summarize(spark, graph_path: str):
    nodes, edges = _graph(spark, graph_path)
    files.print_json(resolution.summarize(nodes, edges).orderBy("what", "name"))


@command("parse")
def parse(spark, path: str, out: str, backend: str = "marker"):
    _parse(files.read_sources(spark, path, backend), out)


@command("parse-markdown")
def parse_markdown(spark, path: str, out: str, title: str | None = None):
    rows = files.read_sources(spark, path, "text")
    _parse(rows if title is None else rows.withColumn("title", F.lit(title)), out)


def _parse(rows: DataFrame, out: str) -> None:
    docs = graph._saved(rows.withColumn("doc_id", markdown.L.doc_id(F.col("title"))))
    sections, formulas, chunks = (graph._saved(x) for x in markdown.parse_markdown(docs))
    files.write_parsed(markdown.parsed_documents(docs, sections, formulas, chunks), f"{out}/parsed")
    files.write_chunks(chunks, f"{out}/chunks")
    files.write_chunks(markdown.graph_shaped(chunks), f"{out}/graph_chunks")
    say({"documents": docs.count(), "sections": sections.count(), "formulas": formulas.count(), "chunks": chunks.count()})


# Learner


@command("update")
def update(spark, profile: str, node_id: str, correct: bool, out: str | None = None, learner_id: str = "default", quality: int | None = None, mistake: str | None = None, mode: str = "bkt", threshold: float = 0.8):
    body = {"node_id": node_id, "correct": correct, "quality": quality, "mistake": mistake}
    nodes = spark.createDataFrame([(node_id, node_id, "concept", threshold)], "id string, label string, kind string, threshold_given double").withColumn("is_threshold", F.lit(False))
    _assess(spark, nodes, profile, out or profile, learner_id, {"node_evaluations": [{k: v for k, v in body.items() if v is not None}]}, mode)


@command("recommend")
def recommend(spark, graph_path: str, profile: str | None = None, learner_id: str | None = None, max_results: int = 10):
    found = _zpd(spark, graph_path, profile, learner_id, max_results, "exam_sprint")
    say({"ability_level": found["ability"], "ready": found["ready"], "blocked": found["blocked"]})


@command("path")
def path(spark, graph_path: str, target: str, profile: str | None = None, learner_id: str | None = None, session_minutes: int = 35, include_review: bool = False, max_steps: int | None = None):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id)
    view = learner.overlay(nodes, states, _learner(who))
    say(context._rows(graph.path_packet(graph.learning_path(view, edges, target, max_steps, include_review), session_minutes))[0] if nodes.where(F.col("id") == target).count() else None)


@command("due")
def due(spark, graph_path: str, profile: str, learner_id: str | None = None, max_results: int = 10):
    nodes, _ = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id)
    files.print_json(learner.due_list(nodes, states, _learner(who), F.current_timestamp(), max_results))


@command("mirror")
def mirror(spark, graph_path: str, profile: str | None = None, learner_id: str | None = None):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id)
    files.print_json(learner.mirror(nodes, edges, states, _learner(who)).orderBy("difficulty", "label", "id"))


# Tutor


@command("node")
def node(spark, graph_path: str, query: str, profile: str | None = None, learner_id: str | None = None, fields: str | None = None, include_relatives: bool = False, no_sources: bool = False):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id) if profile else (None, None)
    files.print_json(search.get_node(nodes, edges, query, states, who, csv(fields), include_relatives, not no_sources))


@command("relatives")
def relatives(spark, graph_path: str, node: str, depth: int = 1, direction: str = "both", relation_types: str | None = None):
    nodes, edges = _graph(spark, graph_path)
    hit = search.resolve(nodes, node).first()
    if hit is None:
        return say({"query": node, "found": False, "relatives": []})
    rows = graph.relatives(nodes, edges, hit.id, depth, direction, csv(relation_types))
    files.print_json(rows.orderBy(*graph.nearest_first()))


@command("first-principles")
def first_principles(spark, graph_path: str, node: str, max_paths: int = 3):
    nodes, edges = _graph(spark, graph_path)
    hit = search.resolve(nodes, node).first()
    if hit is None:
        return say({"query": node, "found": False, "paths": []})
    files.print_json(graph.first_principles(nodes, edges, hit.id, max_paths).orderBy("rank"))


@command("retrieve")
def retrieve(spark, graph_path: str, query: str, profile: str | None = None, learner_id: str | None = None, intent: str = "teach", limit: int = 8):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id) if profile else (None, None)
    say(context.retrieve(nodes, edges, query, states, who, intent, limit))


def _zpd(spark, graph_path, profile, learner_id, max_results, mode):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id)
    return context.proximal_dev(nodes, edges, states, _learner(who), max_results, mode)


@command("zpd")
def zpd(spark, graph_path: str, profile: str | None = None, learner_id: str | None = None, max_results: int = 10, mode: str = "exam_sprint"):
    say(_zpd(spark, graph_path, profile, learner_id, max_results, mode))


@command("goal-path")
def goal_path(spark, graph_path: str, profile: str | None = None, learner_id: str | None = None, goal: str | None = None, mode: str = "exam_sprint", max_steps: int = 12, session_minutes: int = 25):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id)
    say(context.learning_path(nodes, edges, states, _learner(who), goal, mode, max_steps, session_minutes))


@command("exercise-search")
def exercise_search(spark, exercises: str, graph_path: str, profile: str | None = None, learner_id: str | None = None, query: str | None = None, targets: str | None = None, difficulty: float | None = None, max_new: int = 1, priority: str = "course", ladder: str | None = None, limit: int = 5):
    nodes, _ = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id)
    wanted = [t if (hit := search.resolve(nodes, t).first()) is None else hit.id for t in csv(targets) or []]
    rows = files.read_exercises(spark, exercises)
    found = search.search_exercises(rows, learner.overlay(nodes, states, _learner(who)), query, wanted, difficulty, max_new, priority, ladder, limit)
    files.print_json(found.join(files.without_solution(rows).drop("difficulty"), "exercise_id").orderBy(F.desc("score"), "difficulty", "exercise_id"))


@command("exercise-get")
def exercise_get(spark, exercises: str, exercise_id: str, graph_path: str | None = None, profile: str | None = None, learner_id: str | None = None, include_solution: bool = False):
    nodes = _graph(spark, graph_path)[0] if graph_path else None
    states, who = _states(spark, profile, learner_id) if profile else (None, None)
    files.print_json(search.get_exercise(files.read_exercises(spark, exercises), exercise_id, nodes, states, who, include_solution))


@command("record-attempt")
def record_attempt(spark, attempts: str, json_text: str | None = None, json_file: str | None = None):
    body = json.dumps(files.json_argument(json_text, json_file), ensure_ascii=False)
    files.print_json(files.record_attempts(spark.createDataFrame([(body,)], "body string"), attempts).select("body", "attempt_id"))


@command("attempts")
def attempts(spark, attempts: str, limit: int | None = None):
    files.print_json(files.read_attempts(spark, attempts, limit).select("attempt_id", "timestamp", "body"))


@command("update-learner")
def update_learner(spark, graph_path: str, profile: str, out: str | None = None, learner_id: str = "default", json_text: str | None = None, json_file: str | None = None, mode: str = "bkt"):
    nodes, _ = _graph(spark, graph_path)
    _assess(spark, nodes, profile, out or profile, learner_id, files.json_argument(json_text, json_file), mode)


def _assess(spark, nodes, profile, out, learner_id, body, mode):
    states, who = _states(spark, profile, None)
    who = who or learner_id
    rows = [(who, i, json.dumps(e)) for i, e in enumerate(body.get("node_evaluations", []))]
    evaluations = spark.createDataFrame(rows, "learner_id string, seq long, body string").withColumn("at", F.current_timestamp())
    updates = graph._saved(assessment.apply_assessments(states, evaluations, nodes, mode))
    after = graph._saved(assessment.states_after(states, updates))
    files.write_profile(after, out)
    level = learner.abilities(after.where(F.col("learner_id") == who)).first()
    shown = updates.drop("state").orderBy("seq")
    say({"learner_id": who, "exercise_id": body.get("exercise_id") or body.get("item_id"), "session_id": body.get("session_id"), "mode": mode, "updates": context._rows(shown), "overall_ability": 0.0 if level is None else level.ability})


@command("memory-get")
def memory_get(spark, memory: str, learner_id: str = "default"):
    own = files.read_memories(spark, memory).where(F.col("learner_id") == learner_id).first()
    say(files.merge_memory(files.fresh_memory(), json.loads(own.body) if own else {}))


@command("memory-update")
def memory_update(spark, memory: str, learner_id: str = "default", json_text: str | None = None, json_file: str | None = None):
    body = json.dumps(files.json_argument(json_text, json_file))
    files.update_memories(spark, memory, spark.createDataFrame([(learner_id, 0, body)], "learner_id string, seq long, body string"))
    memory_get(spark, memory, learner_id)


@command("pack-context")
def pack_context(spark, graph_path: str, profile: str | None = None, learner_id: str | None = None, memory: str | None = None, exercises: str | None = None, exercise_id: str | None = None, target: str | None = None, query: str | None = None, mode: str = "guided_exercise", tokens: int = 3000):
    nodes, edges = _graph(spark, graph_path)
    states, who = _states(spark, profile, learner_id) if profile else (None, None)
    own = files.read_memories(spark, memory).where(F.col("learner_id") == _learner(who)).first() if memory else None
    known = files.read_exercises(spark, exercises) if exercises else None
    say(context.pack(nodes, edges, states, who, query, mode, tokens, target, known, exercise_id, json.loads(own.body) if own else None))


def _value(text: str, kind: str):
    if kind.startswith("bool"):
        return text.lower() in ("1", "true", "yes")
    return int(text) if kind.startswith("int") else float(text) if kind.startswith("float") else text


def arguments(f, given: list[str]) -> dict:
    """``--name value`` pairs as the function's arguments; a flag alone is true."""
    kinds = {n: str(p.annotation) for n, p in inspect.signature(f).parameters.items() if n != "spark"}
    out, at = {}, 0
    while at < len(given):
        name = given[at].removeprefix("--").replace("-", "_").replace("graph", "graph_path").replace("graph_path_path", "graph_path")
        if not given[at].startswith("--") or name not in kinds:
            raise SystemExit(f"unknown argument {given[at]}; there are {', '.join('--' + k.replace('_', '-') for k in kinds)}")
        alone = at + 1 == len(given) or given[at + 1].startswith("--")
        out[name] = True if alone else _value(given[at + 1], kinds[name])
        at += 1 if alone else 2
    return out


def main(argv: list[str]) -> None:
    if not argv or argv[0] not in COMMANDS:
        raise SystemExit(f"commands: {', '.join(COMMANDS)}")
    f = COMMANDS[argv[0]]
    given = arguments(f, argv[1:])
    spark = SparkSession.builder.appName("paideia").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    f(spark, **given)


if __name__ == "__main__":
    main(sys.argv[1:])

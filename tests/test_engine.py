import itertools
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from paideia.functions import labels as L
from paideia.operators import assessment, chunking, graph, learner, markdown, resolution, search
from paideia.plans import context
from paideia.plans import queries as Q
from paideia.plans.adapters import adapter
from paideia.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    def one(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cursor = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert plain([r.asDict() for r in df.collect()], columns) == plain(want, columns)
    assert want or name in ("resolve_node",)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def packed(text, most=3500, overlap=300):
    chunks, current = [], ""
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        joined = f"{current}\n\n{p}" if current else p
        if len(joined) <= most:
            current = joined
            continue
        if current:
            chunks.append(current)
        current = p
        while len(current) > most:
            chunks.append(current[:most])
            current = current[most - overlap :]
    return chunks + [current] if current else chunks


def test_chunks(spark):
    texts = ["", "one", "a" * 600 + "\n\n" + "b" * 450 + "\n\ntail", "x" * 1900, "p\n\n\n\nq " * 90, " \n\n "]
    docs = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    got = {}
    for r in chunking.chunk_documents(docs, 500, 100).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: packed(t, 500, 100) for i, t in enumerate(texts) if packed(t, 500, 100)}
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs, 400)


def test_markdown(spark):
    text = "lost preamble\n# A\nalpha\n```\n# not a heading\n```\n## B\nbeta $E = m c^2$ end\n### C\n$$ x + y = z $$\n# D\ndelta"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "no headings")], "doc_id long, text string")
    sections = markdown.heading_sections(docs)
    rows = markdown.with_parents(sections).orderBy("ordinal").collect()
    assert [r.title for r in rows] == ["A", "B", "C", "D"] and [r.level for r in rows] == [1, 2, 3, 1]
    assert [r.parent_id for r in rows] == [None, rows[0].section_id, rows[1].section_id, None]
    assert "preamble" not in "".join(r.text for r in rows) and "# not a heading" in rows[0].text
    found = markdown.detect_formulas(docs)
    assert [(r.kind, r.text) for r in found.orderBy("start_char").collect()] == [("inline_math", "E = m c^2"), ("display_math", "x + y = z")]
    assert {r.section_id for r in markdown.assign_formulas(found, sections).collect()} == {rows[1].section_id, rows[2].section_id}
    thin = markdown.thinned(sections, 50).collect()
    assert len(thin) == 1 and thin[0].merged_titles == ["B", "C", "D"]


def observations(spark, answers):
    start = datetime(2024, 1, 1)
    rows = [(0, "n", ok, start + timedelta(hours=i), i, q, None if ok else "slip") for i, (ok, q) in enumerate(answers)]
    return spark.createDataFrame(rows, "learner_id long, node_id string, correct boolean, ts timestamp, event_id long, quality int, mistake string")


def test_fold(spark):
    r = learner.trace(observations(spark, [(False, 1)])).first()
    assert r.gap_type == "fundamental_gap" and r.mistakes == ["slip"] and abs(r.mastery - (0.1 * 0.1 / (0.1 * 0.1 + 0.9 * 0.75) * 0.8 + 0.2)) < 1e-12
    r = learner.trace(observations(spark, [(True, 4), (True, 4), (True, 4), (False, 1), (True, 5)])).first()
    assert (r.repetitions, r.interval_days, r.streak, r.attempts, r.correct_attempts) == (1, 1, 1, 5, 4)
    r = learner.trace(observations(spark, [(True, 4), (True, 4), (True, 4)])).first()
    assert r.interval_days == 15 and r.gap_type == "mastered"  # 6 days times an ease of 2.5
    r = learner.trace(observations(spark, [(True, None)])).first()
    assert not r.reviewed and r.interval_days == 0 and abs(r.linear - 0.15) < 1e-12


def small_graph(spark):
    names = [("a", "vectors"), ("b", "force"), ("c", "second law"), ("d", "inclined plane"), ("x", "loop one"), ("y", "loop two")]
    nodes = spark.createDataFrame([(i, lab, "concept", 0.3, False, 15, 0.5) for i, lab in names], "id string, label string, kind string, difficulty_given double, is_threshold boolean, minutes int, exam_relevance double")
    pairs = [("d", "c"), ("c", "b"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("d", "gone")]
    return nodes, spark.createDataFrame([(s, t, "REQUIRES") for s, t in pairs], "source_id string, target_id string, relation string")


def test_graph(spark):
    nodes, edges = small_graph(spark)
    close = {(r.id, r.needs): r.depth for r in graph.closure(graph.requires(edges, nodes)).collect()}
    assert close[("d", "a")] == 2 and close[("x", "x")] == 2 and ("d", "gone") not in close
    paths = graph.first_principles(nodes, edges, "d").orderBy("rank").collect()
    assert [r.nodes for r in paths] == ["a>c>d", "a>b>c>d"]
    assert [r.nodes for r in graph.first_principles(nodes, edges, "x").collect()] == ["x>y>x"]
    states = learner.trace(observations(spark, [(True, 5)] * 6)).withColumn("node_id", F.lit("a"))
    view = learner.overlay(nodes, states, 0)
    steps = graph.learning_path(view, edges, "d")
    assert [r.id for r in steps.orderBy("step").collect()] == ["b", "c", "d"]
    assert [r.session for r in graph.sessions(steps, 35).orderBy("step").collect()] == [0, 0, 1]
    found = {r.id: r for r in learner.readiness(nodes, edges, states, 0).collect()}
    assert found["b"].bucket == "zpd" and found["c"].unmet == "force" and found["x"].bucket == "blocked" and "a" not in found
    assert graph.relatives(nodes, edges, "c", 1, "parents").count() == 2 and graph.relatives(nodes, edges, "c", relations=[]).count() == 0
    packet = context.pack(nodes, edges, states, 0, "second law", tokens=250)
    assert packet["retrieval"]["matched_nodes"][0]["node_id"] == "c" and packet["trimmed_to_budget"] and packet["allowed_actions"] == context.ACTIONS["guided_exercise"]
    assert [r["node_id"] for r in context.retrieve(nodes, edges, "second law", limit=1)["prerequisites"]] == ["b", "a"] or len(context.retrieve(nodes, edges, "second law", limit=1)["prerequisites"]) == 2
    zpd = context.proximal_dev(nodes, edges, states, 0)
    assert [c["node_id"] for c in zpd["ready"]] == ["b"] and zpd["mastered_count"] == 1 and zpd["total_trackable"] == 6 and zpd["blocked"][0]["blocking_prerequisites"]
    path = context.learning_path(nodes, edges, states, 0, "inclined plane")
    assert path["chosen_reason"] == "explicit_goal" and [x["id"] for x in path["path"]["steps"]] == ["b", "c", "d"] and path["path"]["total_minutes"] == 45 and [x["ordinal"] for x in path["path"]["sessions"]] == [0, 1, 2]
    assert context.learning_path(nodes, edges, states, 0)["path"]["target"]["node_id"] == "b"
    assert context.learning_path(nodes.limit(0), edges, states, 0)["reason"] == "no_goal_and_no_zpd_candidate" and context.learning_path(nodes, edges, states, 0, "?!")["reason"] == "target_not_found"


def test_first_principles_of_a_deep_graph(spark):
    ids = [f"n{k:02d}" for k in range(67)]
    nodes = spark.createDataFrame([(i, i, 1) for i in ids], "id string, label string, minutes int")
    edges = spark.createDataFrame([(b, a, "REQUIRES") for a, b in zip(ids, ids[1:])], "source_id string, target_id string, relation string")
    assert [(r.nodes, r.length) for r in graph.first_principles(nodes, edges, ids[-1]).collect()] == [(">".join(ids), 67)]


@pytest.mark.parametrize("copies", [1, 2])
def test_first_principles_counts_parallel_edges_as_its_sql_does(spark, tmp_path, copies):
    # n3 requires n1 by two edges, and is the cheapest way: its path was second here, where the SQL counts it twice and last.
    table = spark.range(200).selectExpr("id AS p_partkey", "concat('part ', lpad(id, 3, '0')) AS p_name", "'TIN' AS p_type", "CAST(IF(id = 3, 1, 20) AS INT) AS p_size")
    table.crossJoin(spark.range(copies).select()).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    wanted = db.execute(Q.ORACLES["first_principles"]).fetchall()
    assert sorted(map(tuple, Q.QUERIES["first_principles"](spark, str(tmp_path)).collect())) == sorted(wanted)


def test_ways_sort_as_repeated_labels(spark):
    lists = [(list(x), w) for w in (1, 2, 3) for n in (1, 2, 3, 4) for x in itertools.product("abc", repeat=n)]
    rows = spark.createDataFrame(lists, "labels array<string>, ways long")
    got = [(r.labels, r.ways) for r in rows.orderBy(graph._by_labels(F.col("labels"), F.col("ways"))).collect()]
    repeated = [[x for x in labels for _ in range(ways)] for labels, ways in got]
    assert repeated == sorted(repeated) and len(got) == len(lists)


def test_resolution(spark):
    labels = spark.createDataFrame([("The Force",), ("force field",), ("moto",), ("moto armonico",), ("ab",), ("a b c d e f g h",), ("h g f e d c b a x",), ("λ",)], "label string")
    norms = [r.n for r in labels.select(L.normalize_label(F.col("label")).alias("n")).collect()]
    assert norms[0] == "force" and norms[-1] == ""
    pairs = resolution.lexical_pairs(labels.select(L.normalize_label(F.col("label")).alias("norm")))
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert {("force", "force field"), ("moto", "moto armonico")} <= set(got) and got[("force", "force field")] == 0.86
    roots = {r.node: r.root for r in resolution.components(pairs).collect()}
    assert roots["moto armonico"] == "moto" and roots["force field"] == "force"
    ordered = spark.createDataFrame([("concept", 1, "Newton", ["Seconda legge"]), ("concept", 2, "Newton's law", []), ("concept", 3, "Seconda legge", []), ("concept", 4, "Energy", [])], "kind string, seq long, label string, aliases array<string>")
    assert [r.canonical for r in resolution.resolve_in_order(ordered).orderBy("seq").collect()] == ["Newton", "Newton", "Newton", "Energy"]
    raw = spark.createDataFrame([("c1", 'noise [{"name": " Newton ", "formulas": ["F = m a", ""], "confidence": 0}, {"description": "nameless"}] end')], "chunk_id string, output string")
    c = chunking.parse_extractions(raw).first().concepts
    assert len(c) == 1 and c[0].name == "Newton" and c[0].formulas == ["F = m a"] and c[0].confidence == 0.7


def test_search(spark):
    nodes, _ = small_graph(spark)
    assert search.search(nodes, "second law").first().id == "c" and search.search(nodes, " ").count() == 0
    assert search.search(nodes, "secnd lw").first().id == "c"
    assert search.resolve(nodes, "d").first().tier == 1 and search.resolve(nodes, "Second  LAW").first().tier == 2
    named = nodes.withColumn("aliases", F.when(F.col("id") == "a", F.array(F.lit("Arrows"))))
    assert tuple(search.resolve(named, "arrows").first()) == ("a", 2) and search.resolve(named, "zzzz", fuzzy=False).count() == 0
    edges = small_graph(spark)[1]
    one = search.get_node(named, edges, "arrows", relatives=True, fields=["aliases", "no such"]).first()
    assert one.found and set(one.node.asDict()) == {"id", "label", "kind", "aliases"} and {r.node_id for r in one.relatives} == {"b", "c"} and one.matches is None
    none = search.get_node(named, edges, "?!").first()
    assert not none.found and none.node is None and none.matches == [] and none.relatives is None
    exercises = spark.createDataFrame([("e1", "push a block", ["c", "gone", "a"], 0.3, 1, "it moves")], "exercise_id string, statement string, required array<string>, difficulty double, steps int, solution string")
    got = search.get_exercise(exercises, "e1", nodes).first()
    assert got.found and "solution" not in got.exercise.asDict() and [n.id for n in got.required_nodes] == ["c", "a"]
    assert search.get_exercise(exercises, "e1", nodes, solution=True).first().exercise.solution == "it moves" and not search.get_exercise(exercises, "x", nodes).first().found


def test_files(spark, tmp_path):
    line = '{"chunk_id": "c", "concepts": [{"name": "%s"}, {"name": ""}]}'
    (tmp_path / "x.jsonl").write_text("\n".join([line % "old", line % "new"]))
    rows = files.read_extractions(spark, str(tmp_path / "x.jsonl")).collect()
    assert len(rows) == 1 and [c.name for c in rows[0].concepts] == ["new"]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "A", "kind": "concept"}], "edges": [{"source_id": "a", "target_id": "a", "relation_type": "REQUIRES"}]}')
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == edges.count() == 1
    for i, body in enumerate(('{"b": 1, "a": "x", "mistake": "sign"}', '{"mistakes": ["units ", "sign", ""], "timestamp": "2020-01-01"}', '{"attempt_id": "own", "self_reported_difficulty": "algebra"}')):
        log = files.record_attempts(spark.createDataFrame([(body,)], "body string"), str(tmp_path / "log"))
        assert i == 2 or log.first().attempt_id.startswith("attempt:")
    assert [r.attempt_id == "own" for r in files.read_attempts(spark, str(tmp_path / "log"), 2).collect()] == [False, True]
    assert [r.mistake for r in files.recent_mistakes(files.read_attempts(spark, str(tmp_path / "log"))).orderBy("place").collect()] == ["sign", "units", "algebra"]
    assert files.read_attempts(spark, str(tmp_path / "none")).count() == files.read_exercises(spark, str(tmp_path / "none")).count() == files.read_profile(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "e.jsonl").write_text('{"id": "x", "steps": 0, "concepts": ["a"], "solution": "s"}')
    e = files.read_exercises(spark, str(tmp_path / "e.jsonl")).first()
    assert (e.exercise_id, e.steps, e.difficulty, e.required, e.solution_available, e.ladder) == ("x", 1, 0.3, ["a"], True, "direct_formula")
    files.write_exercises(files.read_exercises(spark, str(tmp_path / "e.jsonl")), str(tmp_path / "e2"))
    assert files.read_exercises(spark, str(tmp_path / "e2")).first() == e
    assert files.json_argument('{"a": 1}') == {"a": 1} and files.json_argument() == {}
    with pytest.raises(ValueError):
        files.pdf_backend("no such")
    assert files.pdf_backend("plain")(b"x") == "x"
    memory = files.merge_memory(files.fresh_memory(), {"metadata": None, "recent_notes": list(range(26)), "learning_style": {"avoid": ["x"]}, "new": 1})
    assert "metadata" not in memory and len(memory["recent_notes"]) == 25 and memory["learning_style"] == {"prefers": [], "avoid": ["x"]} and memory["new"] == 1
    (tmp_path / "d.md").write_text("# T\n\nx")
    assert files.read_texts(spark, str(tmp_path / "d.md")).first().text == "# T\n\nx"
    patches = spark.createDataFrame([(1, 1, '{"a": [1]}'), (1, 2, '{"a": [2]}')], "learner_id long, seq long, body string")
    assert '"a": [1, 2]' in files.merge_memories(spark.createDataFrame([(1, None)], "learner_id long, body string"), patches).first().body


def test_stream(spark, tmp_path):
    from paideia.streaming.mastery import mastery_stream

    obs = adapter(spark, SF, "observations").select("learner_id", "node_id", "correct", F.col("ts").cast("timestamp").alias("ts"), "event_id", "quality")
    obs.write.parquet(str(tmp_path / "in"))
    stream = mastery_stream(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("mastery").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.learner_id, r.node_id): r.mastery for r in learner.trace(adapter(spark, SF, "observations")).collect()}
    got = {(r.learner_id, r.node_id): r.mastery for r in spark.sql("SELECT * FROM mastery").collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_assessment(spark):
    nodes, _ = small_graph(spark)
    bodies = [
        ('{"node_id": "a", "correct": true, "quality": 4}', True), ('{"node": " Force ", "is_correct": 0, "mistake": "sign"}', False), ('{"node_id": "a", "correct": null, "score": 1}', False),
        ('{"node_id": "a", "correct": "false"}', True), ('{"node_id": "zz", "score": 0.6}', True), ('{"node_id": "a", "quality": 2}', False), ('{"node_id": "a"}', False), ('{"node_id": "", "correct": true}', None), ("broken", None),
    ]
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(0, i, at, b) for i, (b, _) in enumerate(bodies)], "learner_id long, seq long, at timestamp, body string")
    got = {r.seq: r[1] for r in rows.select("seq", assessment.is_correct(F.col("body"))).collect()}
    assert all(got[i] == v for i, (_, v) in enumerate(bodies) if v is not None)
    states = learner.trace(observations(spark, [(True, 4)]).withColumn("node_id", F.lit("a")))
    updates = assessment.apply_assessments(states, rows, nodes)
    found = {r.seq: r for r in updates.collect()}
    assert sorted(found) == list(range(7)) and found[1].node_id == "b" and found[1].label == "force" and found[4].node_id == "zz"
    answers = [(True, 4), (True, 4), (False, None), (True, None), (False, 2), (False, None)]
    want = learner.trace(observations(spark, answers)).first()
    after = {r.node_id: r for r in assessment.states_after(states, updates).collect()}
    assert set(after) == {"a", "b", "zz"} and abs(after["a"].mastery - want.mastery) < 1e-12 and after["a"].attempts == 6 and after["a"].interval_days == want.interval_days
    assert after["b"].mistakes == ["sign"] and found[0].previous_attempts == 1 and found[0].next_review_at == at + timedelta(days=6)
    linear = {r.seq: r for r in assessment.apply_assessments(states, rows, nodes, "linear").collect()}
    assert abs(linear[4].new_mastery - 0.15) < 1e-12 and linear[1].new_mastery == 0.0
    with pytest.raises(ValueError):
        assessment.apply_assessments(states, rows, nodes, "other")


def test_fusion(spark):
    schema = "chunk_id string, pos int, name string, description string, bloom_level string, confidence double, evidence string, prerequisites array<string>, related array<string>, formulas array<string>, problem_types array<string>, aliases array<string>"
    rows = [
        ("c1", 0, "Newton's second law", "short", None, 0.4, "e0", ["Force"], [], ["F = m a"], [], []), ("c1", 1, "the second law of Newton", "a longer text", None, 0.7, "e1", ["force", "mass"], None, [], ["dynamics"], ["law 2"]),
        ("c1", 2, "entropy", "", None, 0.5, "e2", [], [], [], [], ["Entropy", "entropy"]), ("c2", 0, "newton second law", "other chunk", None, 0.1, "e3", [], [], [], [], []), ("c2", 1, "?!", None, None, None, None, None, None, None, None, None), ("c2", 2, "?!", None, None, None, None, None, None, None, None, None),
    ]
    concepts = spark.createDataFrame(rows, schema)
    got = {(r.chunk_id, r.pos): r for r in resolution.fuse_concepts(concepts).collect()}
    assert sorted(got) == [("c1", 0), ("c1", 2), ("c2", 0), ("c2", 1), ("c2", 2)]
    one = got["c1", 0]
    assert (one.name, one.confidence, one.evidence, one.group_size) == ("the second law of Newton", 0.7, "e1", 2)
    assert (one.prerequisites, one.aliases, one.formulas, one.problem_types) == (["Force", "mass"], ["Newton's second law", "law 2"], ["F = m a"], ["dynamics"])
    assert got["c1", 2].aliases == ["Entropy", "entropy"] and got["c2", 1].aliases is None
    report = resolution.fusion_report(resolution.fuse_concepts(concepts)).first()
    assert tuple(report) == (6, 5, 1, 2)
    links = spark.createDataFrame([("c1", 0, 2)], "chunk_id string, a int, b int")
    assert {(r.chunk_id, r.pos): r.group_size for r in resolution.fuse_concepts(concepts, links=links).collect()}[("c1", 0)] == 2
    assert tuple(resolution.fusion_report(resolution.fuse_concepts(concepts.limit(0))).first()) == (0, 0, 0, 0)
    assert [r.chunk_id for r in resolution.without_chunk(spark.createDataFrame([("c1",)], "chunk_id string"), concepts).collect()] == ["c2"]


def test_parser_chunks(spark):
    para = "some words of a paragraph. " * 20
    text = f"lost $a = b + c$\n# A\n{para}\n\nmiddle $E = m c^2$ end.\n\n{para}\n# B\n{para}\n\n{para * 5}\n\nend"
    docs = spark.createDataFrame([(1, "T", text), (2, "U", "only text\n\n\n\nmore text"), (3, "V", " "), (4, "W", None)], "doc_id long, title string, text string")
    sections, formulas, chunks = markdown.parse_markdown(docs)
    rows = chunks.orderBy("doc_id", "ordinal").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert [r.kind for r in own[:3]] == ["formula_context", "formula_context", "section"] and own[0].text.startswith("lost") and "E = m c^2" in own[1].text
    assert [r.text for r in own[-2:]] == [para.strip(), (para * 5).strip()] and [r.kind for r in own[-2:]] == ["paragraph", "section"]  # the short end goes
    assert all(a.next_chunk_id == b.chunk_id and b.previous_chunk_id == a.chunk_id for a, b in zip(own, own[1:])) and own[0].previous_chunk_id is None
    assert [(r.text, r.start_char, r.end_char) for r in rows if r.doc_id == 2] == [("only text\n\nmore text", 0, 20)]
    shaped = markdown.graph_shaped(chunks).where("doc_id = 1").orderBy("ordinal").first()
    assert shaped.metadata.parser_kind == "formula_context" and shaped.title == "T — A" and len(shaped.metadata.formula_ids) == 1
    counts = {r.doc_id: tuple(r.metadata) for r in markdown.parsed_documents(docs, sections, formulas, chunks).collect()}
    assert counts == {1: (2, 2, len(own)), 2: (1, 0, 1), 3: (0, 0, 0), 4: (0, 0, 0)}
    piece = spark.createDataFrame([("abcdefghij",)], "t string").select(markdown.without_spans(F.col("t"), F.expr("array(struct(11 AS a, 13 AS b), struct(12 AS a, 15 AS b))"), F.lit(10)).alias("t"))
    assert piece.first().t == "a\n\nfghij"


def test_build_with_provenance(spark):
    chunks = spark.createDataFrame([("c1", "d", "Book", "text one", 0), ("c2", "d", "", "text two", 1)], "chunk_id string, doc_id string, title string, text string, ordinal int")
    concept = {"name": "Newton's law", "description": "long text", "prerequisites": ["Force"], "related": [], "formulas": ["F = m a"], "problem_types": [], "bloom_level": "apply", "confidence": 0.5, "evidence": "quote one", "aliases": ["Seconda legge"]}
    again = concept | {"name": "Seconda legge", "description": "", "prerequisites": ["force"], "confidence": 0.9, "evidence": "quote two", "bloom_level": "", "aliases": []}
    found = spark.createDataFrame([("c1", [concept]), ("c2", [again]), ("gone", [concept])], f"chunk_id string, concepts array<{files.CONCEPT}>")
    nodes, edges, report = resolution.build_with_report(chunks, found)
    by = {(r.kind, r.label): r for r in nodes.collect()}
    law = by["concept", "Newton's law"]
    assert law.aliases == ["Seconda legge"] and law.properties == {"bloom_level": "apply", "confidence": "0.9"} and [x.quote for x in law.sources] == ["quote one", "quote two"] and law.description == "long text"
    needs = {r.relation: r for r in edges.where(F.col("source_id") == law.node_id).collect()}
    assert needs["REQUIRES"].weight == 0.9 and needs["REQUIRES"].evidence == "quote one" and len(needs["REQUIRES"].sources) == 2 and needs["REQUIRES"].target_id == by["concept", "Force"].node_id
    assert tuple(report.first()) == (2, 2, len(by), edges.count(), 1)


def test_embedding_links(spark):
    rows = spark.createDataFrame([("c", 0, "one", ""), ("c", 1, "two", ""), ("c", 2, "one more", ""), ("d", 0, "two", "")], "chunk_id string, pos int, name string, description string")
    vectors = {"one": [1.0, 0.0], "two": [0.99, 0.1]}
    links = resolution.embedding_links(rows, lambda texts: [vectors.get(t.split(":")[0]) for t in texts])
    assert {(r.chunk_id, min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} == {("c", 0, 1), ("c", 0, 2)}


def test_commands(spark, tmp_path, capsys):
    from paideia import commands

    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "vectors", "kind": "concept", "properties": {"difficulty": 0.2}, "sources": [{"doc_id": "d", "chunk_id": "c", "title": "t", "quote": "an arrow"}]}, {"id": "b", "label": "force", "kind": "concept"}], "edges": [{"source_id": "b", "target_id": "a", "relation_type": "REQUIRES"}]}')
    g, profile = str(tmp_path / "g.json"), str(tmp_path / "p")
    run = lambda name, *given: (commands.COMMANDS[name](spark, **commands.arguments(commands.COMMANDS[name], list(given))), capsys.readouterr().out)[1]
    assert len(commands.COMMANDS) == 27 and '"found":true' in run("node", "--graph", g, "--query", "vectors", "--fields", "id, sources")
    assert '"an arrow"' in run("retrieve", "--graph", g, "--query", "vectors")
    out = run("update-learner", "--graph", g, "--profile", profile, "--json-text", '{"node_evaluations": [{"node": "vectors", "correct": true, "quality": 5}]}')
    assert '"node_id": "a"' in out and '"mastered"' not in out
    assert '"ready": [' in run("zpd", "--graph", g, "--profile", profile) and '"id":"a"' in run("mirror", "--graph", g, "--profile", profile)
    assert '"top_zpd_candidate"' in run("goal-path", "--graph", g, "--profile", profile)
    (tmp_path / "d.md").write_text("# Title\n\n" + "words of a text. " * 40)
    assert '"sections": 1' in run("parse-markdown", "--path", str(tmp_path / "d.md"), "--out", str(tmp_path / "parsed"))
    files.write_chunks(spark.read.json(str(tmp_path / "parsed/graph_chunks")), str(tmp_path / "again"))
    assert files.read_chunks(spark, str(tmp_path / "again")).count() == 1
    run("memory-update", "--memory", str(tmp_path / "m"), "--json-text", '{"recent_notes": ["x"]}')
    assert '"x"' in run("memory-update", "--memory", str(tmp_path / "m"), "--json-text", '{"recent_notes": ["y"]}')
    with pytest.raises(SystemExit):
        commands.arguments(commands.COMMANDS["zpd"], ["--nothing", "1"])

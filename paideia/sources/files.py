"""Readers and writers: JSON lines, graphs, profiles, attempts, memory, text and Markdown files."""

from __future__ import annotations

import hashlib
import json
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import _saved

DOCUMENTS = "doc_id string, title string, text string, source_path string, metadata map<string,string>"
CHUNKS = "chunk_id string, doc_id string, title string, text string, ordinal int, source_path string, page_start int, page_end int, metadata map<string,string>"
CONCEPT = "struct<name:string,description:string,prerequisites:array<string>,related:array<string>,formulas:array<string>,problem_types:array<string>,bloom_level:string,confidence:double,evidence:string,aliases:array<string>>"
REF = "struct<doc_id:string,chunk_id:string,title:string,source_path:string,page_start:int,page_end:int,quote:string>"
NODE = f"struct<id:string,label:string,kind:string,description:string,aliases:array<string>,properties:map<string,string>,sources:array<{REF}>>"
EDGE = f"struct<source_id:string,target_id:string,relation_type:string,weight:double,evidence:string,sources:array<{REF}>>"
EXERCISES = "exercise_id string, id string, statement string, source_path string, source_doc_id string, doc_id string, page int, required_node_ids array<string>, concepts array<string>, problem_type string, difficulty double, number_of_steps int, steps int, algebra_load double, has_trap boolean, trap_flags array<string>, exercise_ladder_level string, solution_available boolean, solution string, source_priority string, metadata map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _lines_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a file or folder; no rows where there is none."""
    return spark.read.schema(schema).json(path, mode="FAILFAST") if exists(spark, path) else spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; malformed lines fail the query."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, DOCUMENTS)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, CHUNKS)


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, concepts, place; of lines with one chunk id the last counts, at the place of the first; nameless concepts go."""
    rows = read_lines(spark, path, f"chunk_id string, concepts array<{CONCEPT}>")
    placed = rows.withColumn("seq", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    last = placed.groupBy("chunk_id").agg(F.max_by("concepts", "seq").alias("concepts"), F.min("seq").alias("place"))
    return last.withColumn("concepts", F.filter("concepts", lambda c: F.coalesce(c["name"], F.lit("")) != ""))


def write_extractions(concepts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line for each chunk of concepts (chunk_id, pos and a concept's fields), in order."""
    fields = [c for c in concepts.columns if c not in ("chunk_id", "pos")]
    each = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("c"))), lambda a, b: a["pos"] - b["pos"])
    write_lines(concepts.groupBy("chunk_id").agg(F.transform(each, lambda x: x["c"]).alias("concepts")), path, mode)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph in one JSON document, with sources and properties; of nodes with one id the last counts.

    Properties that the engine knows become columns: difficulty_given, is_threshold, minutes, exam_relevance.
    """
    doc = spark.read.schema(f"nodes array<{NODE}>, edges array<{EDGE}>").json(path, multiLine=True, mode="FAILFAST")
    placed = doc.select(F.posexplode("nodes").alias("at", "n")).groupBy("n.id").agg(F.max_by("n", "at").alias("n")).select("n.*")
    known = lambda *names: F.coalesce(*[F.try_element_at("properties", F.lit(n)) for n in names])
    nodes = placed.withColumns(
        {
            "difficulty_given": known("difficulty").try_cast("double"),
            "threshold_given": known("mastery_threshold").try_cast("double"),
            "is_threshold": F.coalesce(known("is_threshold_concept").try_cast("boolean"), F.lit(False)) | F.coalesce(known("threshold_concept").try_cast("boolean"), F.lit(False)),
            "minutes": known("estimated_minutes").try_cast("int"),
            "exam_relevance": known("exam_relevance").try_cast("double"),
        }
    )
    edges = doc.select(F.inline("edges")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return nodes, edges.withColumn("relation", F.col("relation_type"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (by kind and label) and edges as two tables below ``path``."""
    nodes.orderBy("kind", "label").write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, metadata: dict | None = None) -> None:
    """One JSON document of the graph at a local ``path``, nodes by kind and label; rows pass the driver one by one."""
    known = [c for c in ("id", "node_id", "label", "kind", "description", "aliases", "properties", "sources") if c in nodes.columns]
    shaped = nodes.orderBy("kind", "label").select(F.to_json(F.struct(*[F.col(c).alias("id" if c == "node_id" else c) for c in known])).alias("j"))
    own = [c for c in ("source_id", "target_id", "weight", "evidence", "sources") if c in edges.columns]
    lines = edges.select(F.to_json(F.struct(*own, F.col("relation").alias("relation_type"))).alias("j"))
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"metadata": ' + json.dumps({"schema": "paideia.graph.v1", **(metadata or {})}, ensure_ascii=False) + ', "nodes": [')
        out.writelines((",\n" if i else "\n") + r.j for i, r in enumerate(shaped.toLocalIterator()))
        out.write('],\n"edges": [')
        out.writelines((",\n" if i else "\n") + r.j for i, r in enumerate(lines.toLocalIterator()))
        out.write("]}\n")


STATE = "struct<mastery:double,confidence:double,attempts:int,correct_attempts:int,streak:int,last_attempt_at:string,gap_type:string,common_mistakes:array<string>,easiness_factor:double,interval_days:int,repetitions:int,next_review_at:string>"


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """States of profiles (one JSON document each): learner_id, node_id, the fold's state, last_at, mistakes; none where the file is missing."""
    schema = f"learner_id string, node_states map<string,{STATE}>"
    doc = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST") if exists(spark, path) else spark.createDataFrame([], schema)
    each = doc.select("learner_id", F.explode("node_states").alias("node_id", "s"))
    zero = lambda n, kind="int", default=0: F.coalesce(f"s.{n}", F.lit(default)).cast(kind).alias(n)
    return each.select(
        "learner_id", "node_id", zero("mastery", "double", 0.0), zero("mastery", "double", 0.0).alias("linear"), "s.gap_type", zero("attempts"), zero("correct_attempts"), zero("streak"),
        zero("easiness_factor", "double", 2.5).alias("easiness"), zero("interval_days"), zero("repetitions"), F.col("s.next_review_at").isNotNull().alias("reviewed"), F.try_to_timestamp("s.last_attempt_at").alias("last_at"), (F.try_to_timestamp("s.next_review_at") - F.make_dt_interval(F.coalesce("s.interval_days", F.lit(0)))).alias("reviewed_at"),
        F.coalesce("s.common_mistakes", F.array().cast("array<string>")).alias("mistakes"), zero("confidence", "double", 0.0),
    )


def write_profile(states: DataFrame, path: str) -> None:
    """A JSON line for each learner, node states inside; one learner's states are one document."""
    next_at = F.col("reviewed_at") + F.make_dt_interval(F.col("interval_days"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    state = F.struct("mastery", "confidence", "attempts", "correct_attempts", "streak", iso(F.col("last_at")).alias("last_attempt_at"), "gap_type", F.col("mistakes").alias("common_mistakes"), F.col("easiness").alias("easiness_factor"), "interval_days", "repetitions", iso(next_at).alias("next_review_at"))
    weight = F.greatest(F.lit(0.05), F.col("mastery"))
    each = states.groupBy("learner_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", state.alias("s")))).alias("node_states"), (F.sum(F.col("mastery") * weight) / F.sum(weight)).alias("overall_ability"))
    each.write.mode("overwrite").json(path)


def write_states(states: DataFrame, path: str) -> None:
    states.write.mode("overwrite").parquet(path)


def read_exercises(spark: SparkSession, path: str) -> DataFrame:
    """Exercises with their aliases and defaults; a zero difficulty, load or number of steps means the default; none where the file is missing."""
    rows = _lines_or_none(spark, path, EXERCISES)
    none = F.array().cast("array<string>")
    least = lambda c, default: F.coalesce(F.nullif(c, F.lit(0).cast("double")), F.lit(default))
    return rows.select(
        F.coalesce("exercise_id", "id").alias("exercise_id"), F.coalesce("statement", F.lit("")).alias("statement"), "source_path", F.coalesce("source_doc_id", "doc_id").alias("source_doc_id"), "page",
        F.coalesce("required_node_ids", "concepts", none).alias("required"), "problem_type", least(F.col("difficulty"), 0.3).alias("difficulty"), F.coalesce(F.nullif(F.coalesce("number_of_steps", "steps"), F.lit(0)), F.lit(1)).alias("steps"),
        least(F.col("algebra_load"), 0.2).alias("algebra_load"), F.coalesce("has_trap", F.lit(False)).alias("has_trap"), F.coalesce("trap_flags", none).alias("trap_flags"), F.coalesce("exercise_ladder_level", F.lit("direct_formula")).alias("ladder"),
        F.coalesce("source_priority", F.lit("course")).alias("priority"), "solution", F.coalesce("solution_available", F.coalesce("solution", F.lit("")) != "").alias("solution_available"), "metadata",
    )


def write_exercises(exercises: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines that ``read_exercises`` reads, solutions included."""
    names = {"required": "required_node_ids", "steps": "number_of_steps", "ladder": "exercise_ladder_level", "priority": "source_priority"}
    write_lines(exercises.withColumnsRenamed(names), path, mode)


def without_solution(exercises: DataFrame) -> DataFrame:
    return exercises.drop("solution")


@F.pandas_udf(T.StringType())
def attempt_id(body: pd.Series) -> pd.Series:
    """Ids from the sorted JSON of attempts; Spark's own JSON has other separators, and so another hash."""
    text = body.map(lambda b: json.dumps(json.loads(b), sort_keys=True, ensure_ascii=False))
    return text.map(lambda t: "attempt:" + hashlib.sha1(t.encode()).hexdigest()[:16])


ATTEMPTS = "attempt_id string, timestamp string, body string, logged_at timestamp, place long"


def record_attempts(attempts: DataFrame, path: str) -> DataFrame:
    """Appends attempts (body: JSON text; maybe timestamp) to the log at ``path`` and returns them as stored.

    What the body says wins over the schema tag and the time that are given here; an id that it lacks is made of all of it.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    given = F.coalesce(F.col("timestamp"), now) if "timestamp" in attempts.columns else now
    own = lambda key: F.get_json_object("body", f"$.{key}")
    # A body that lacks them gets schema and time in front; no key stands twice.
    inner = F.nullif(F.trim(F.regexp_replace("body", r"^\s*\{|\}\s*$", "")), F.lit(""))
    schema = F.when(own("schema").isNull(), F.lit('"schema":"paideia.attempt.v1"'))
    time = F.when(own("timestamp").isNull(), F.concat(F.lit('"timestamp":"'), given, F.lit('"')))
    rows = attempts.withColumn("whole", F.concat(F.lit("{"), F.concat_ws(",", schema, time, inner), F.lit("}")))
    rows = rows.select(F.coalesce(own("attempt_id"), attempt_id("whole")).alias("attempt_id"), F.get_json_object("whole", "$.timestamp").alias("timestamp"), F.col("whole").alias("body"), F.current_timestamp().alias("logged_at"), F.monotonically_increasing_id().alias("place"))
    stored = _saved(rows)  # one time and one place for what is written and what is returned
    stored.write.mode("append").json(path)
    return stored


def read_attempts(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The log, or its ``last`` attempts in the order of the log; none where there is no log."""
    rows = _lines_or_none(spark, path, ATTEMPTS)
    order = [F.col(c) for c in ("logged_at", "place", "attempt_id")]
    return rows.orderBy(*order) if last is None else rows.orderBy(*[c.desc() for c in order]).limit(last).orderBy(*order)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path), text of Markdown and text files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return rows.where(F.col("doc_id").rlike(r"(?i)\.(md|markdown|txt)$"))


def read_pdfs(spark: SparkSession, path: str, backend) -> DataFrame:
    """doc_id (path), text of PDF files by ``backend``, a function from bytes to Markdown or its name; it runs where the files are read."""
    convert = pdf_backend(backend) if isinstance(backend, str) else backend

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["path"], "text": [convert(c) for c in frame["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, text string")


def _by_marker(content: bytes) -> str:
    from marker.converters.pdf import PdfConverter
    from marker.models import create_model_dict

    if not _models:
        _models.append(PdfConverter(artifact_dict=create_model_dict()))  # once for each worker
    return _in_file(content, lambda name: _models[0](name).markdown)


def _by_pymupdf(content: bytes) -> str:
    from pymupdf4llm import to_markdown

    return _in_file(content, to_markdown)


def _by_poppler(content: bytes) -> str:
    import subprocess

    return subprocess.run(["pdftotext", "-layout", "-nopgbrk", "-", "-"], input=content, check=True, capture_output=True).stdout.decode()


def _in_file(content: bytes, convert) -> str:
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # only this task reads it
        f.write(content)
        f.flush()
        return convert(f.name)


_models: list = []
#: PDF backends by name; what they need is imported when they are first used.
BACKENDS = {"marker": _by_marker, "pymupdf4llm": _by_pymupdf, "pymupdf": _by_pymupdf, "pdftotext": _by_poppler, "poppler": _by_poppler, "text": bytes.decode, "markdown": bytes.decode, "plain": bytes.decode}


def pdf_backend(name: str):
    if name not in BACKENDS:
        raise ValueError(f"unknown PDF backend {name}: it is one of {', '.join(BACKENDS)}")
    return BACKENDS[name]


def read_sources(spark: SparkSession, path: str, backend="marker") -> DataFrame:
    """title (the file's name without suffix), source_path, text of files: Markdown and text as they are, others by the PDF backend.

    ``path`` is one file or a folder.
    """
    plain = r"(?i)\.(md|markdown|txt)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    texts = files.where(F.col("path").rlike(plain))
    parts = []
    if not texts.isEmpty():
        parts.append(read_texts(spark, path))
    if not files.where(~F.col("path").rlike(plain)).isEmpty():
        parts.append(read_pdfs(spark, path, backend).where(~F.col("doc_id").rlike(plain)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], "doc_id string, text string")
    name = F.regexp_extract("doc_id", "([^/]*)$", 1)
    return rows.select(F.url_decode(F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")).alias("title"), F.col("doc_id").alias("source_path"), "text")


def write_parsed(parsed: DataFrame, path: str) -> None:
    """A JSON line for each parsed document (``markdown.parsed_documents``)."""
    parsed.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of parser chunks, or of chunks in the graph's shape (``markdown.graph_shaped``)."""
    chunks.write.mode("overwrite").json(path, ignoreNullFields=False)


def print_json(rows: DataFrame, out=None) -> None:
    """One JSON object a line on standard output; rows pass the driver one by one."""
    for row in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator():
        print(row.j, file=out or sys.stdout)


def json_argument(text: str | None = None, path: str | None = None) -> dict:
    """A JSON object from a file, or else from a text, or else an empty one."""
    if path:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    return json.loads(text) if text else {}


def fresh_memory() -> dict:
    return {"schema": "learner_memory.v1", "learning_style": {"prefers": [], "avoid": []}, "current_constraints": {}, "recurring_difficulties": [], "recent_notes": [], "session_summaries": [], "metadata": {}}


#: Items that a list of a memory keeps.
KEPT = 25


def _joined(old: list, new: list) -> list:
    """What is new goes behind; the last ``KEPT`` items stay. Items of any kind are told apart by their JSON."""
    by_text = {json.dumps(x, sort_keys=True): x for x in reversed([*new])}
    have = {json.dumps(x, sort_keys=True) for x in old}
    later = [by_text[t] for t in dict.fromkeys(json.dumps(x, sort_keys=True) for x in new) if t not in have]
    return (list(old) + later)[-KEPT:]


def merge_memory(memory: dict, patch: dict) -> dict:
    """The memory after a patch: null takes a key away, objects merge, lists gain what they lack, all else replaces."""
    rules = {(dict, dict): merge_memory, (list, list): _joined}
    gone = {k for k, v in patch.items() if v is None}
    changed = {k: rules.get((type(memory.get(k)), type(v)), lambda old, new: new)(memory.get(k), v) for k, v in patch.items() if k not in gone}
    return {k: v for k, v in memory.items() if k not in gone} | changed


def merge_memories(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """learner_id, body: each learner's memory (JSON text) with its patches (body, seq) applied in order."""
    ordered = patches.groupBy("learner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda p: p["body"]).alias("patches"))

    @F.pandas_udf(T.StringType())
    def apply(body: pd.Series, each: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(body, each):
            memory = merge_memory(fresh_memory(), json.loads(text) if text else {})
            for patch in own if own is not None else ():
                memory = merge_memory(memory, json.loads(patch))
            out.append(json.dumps(memory, sort_keys=True, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return memories.join(ordered, "learner_id", "full").select("learner_id", apply("body", "patches").alias("body"))


MEMORY = "learner_id string, body string, created_at timestamp, updated_at timestamp"


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """learner_id, body, created_at, updated_at of stored memories; none where there is no file."""
    return _lines_or_none(spark, path, MEMORY)


def update_memories(spark: SparkSession, path: str, patches: DataFrame) -> DataFrame:
    """Applies patches (learner_id, seq, body) to the memories at ``path``, writes them to a new folder beside it and swaps; returns them."""
    old = read_memories(spark, path)
    times = old.select("learner_id", "created_at")
    merged = merge_memories(old.select("learner_id", "body"), patches).join(times, "learner_id", "left")
    now = F.current_timestamp()
    new = merged.select("learner_id", "body", F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"))
    new.write.mode("overwrite").json(f"{path}.new")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = at.getFileSystem(conf)
    fs.delete(at, True)
    fs.rename(fresh, at)
    return read_memories(spark, path)


#: Where an attempt tells of mistakes: a text or a list of texts.
MISTAKE_KEYS = ("mistake", "mistakes", "self_reported_difficulty")


def mistakes_of(body):
    """The mistakes that an attempt (JSON text) tells of, in order."""
    none = F.array().cast("array<string>")

    def told(key: str):
        value = F.get_json_object(body, f"$.{key}")
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{key}", "variant"))
        items = F.filter(F.transform(F.from_json(value, "array<string>"), lambda t: F.trim(t)), lambda t: t != "")
        return F.when(kind == "STRING", F.when(value != "", F.array(value)).otherwise(none)).when(kind.startswith("ARRAY"), items).otherwise(none)

    return F.concat(*[F.coalesce(told(k), none) for k in MISTAKE_KEYS])


def recent_mistakes(attempts: DataFrame, limit: int = 8) -> DataFrame:
    """place, mistake: distinct mistakes of attempts (logged_at, place, body) in the order of first mention, the last ``limit`` of them."""
    each = attempts.select(F.struct("logged_at", "place").alias("at"), F.posexplode(mistakes_of(F.col("body"))).alias("pos", "mistake")).withColumn("o", F.struct("at", "pos"))
    last = each.groupBy("mistake").agg(F.min("o").alias("o")).orderBy(F.desc("o"), "mistake").limit(limit)
    return last.select(F.row_number().over(Window.orderBy("o", "mistake")).alias("place"), "mistake")

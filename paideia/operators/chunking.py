"""Text chunking, rule extraction and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L


def chunk_documents(docs: DataFrame, max_chars: int = 3500, overlap: int = 300) -> DataFrame:
    """chunk_id, doc_id, title, ordinal, text of documents (doc_id, title, text): whole paragraphs packed up to
    ``max_chars``; a longer paragraph is sliced with ``overlap``, and packing goes on from its last slice."""
    if max_chars < 500 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be at least 500 and overlap below it")
    stride = max_chars - overlap
    paragraphs = F.filter(F.transform(F.split("text", "\n\n"), L.stripped), lambda p: p != "")

    def pack(acc, p):
        cur = acc["cur"]
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        fits = F.length(joined) <= max_chars
        closed = F.when(cur == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        slices = F.greatest(F.lit(0), F.ceil((F.length(p) - max_chars) / F.lit(stride)).cast("int"))  # full ones before the last
        cut = F.when(slices > 0, F.transform(F.sequence(F.lit(0), slices - 1), lambda i: F.substring(p, i * stride + 1, F.lit(max_chars)))).otherwise(F.array().cast("array<string>"))
        rest = F.substring(p, slices * stride + 1, F.lit(max_chars))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(closed, cut)).alias("done"), F.when(fits, joined).otherwise(rest).alias("cur"))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    packed = F.aggregate(paragraphs, zero, pack, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    rows = docs.select("doc_id", "title", F.posexplode(packed).alias("ordinal", "text"))
    digest = L.short_hash(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string"), F.lit(":"), F.substring("text", 1, 200)), 12)
    chunk_id = F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"), F.lit(":"), F.lpad(F.col("ordinal").cast("string"), 5, "0"), F.lit(":"), digest)
    return rows.select(chunk_id.alias("chunk_id"), "doc_id", "title", "ordinal", "text")


def retitled(chunks: DataFrame, suffix: str) -> DataFrame:
    return chunks.withColumn("title", F.concat("title", F.lit(f" — {suffix}")))


def linked(chunks: DataFrame) -> DataFrame:
    """Chunks with the ids of the one before and after in their document."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks.withColumn("previous_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


#: Patterns, concept names and formulas of the demonstration extractor (fixed values).
RULES = (
    (r"newton|seconda legge|second law|f\s*=\s*m\s*a", "Seconda legge di Newton", ("F = m a",)),
    (r"energia cinetica|kinetic energy|1/2\s*m\s*v", "Energia cinetica", ("K = 1/2 m v^2",)),
    (r"quantit[aà] di moto|momentum|p\s*=\s*m\s*v", "Quantità di moto", ("p = m v",)),
    (r"moto armonico|oscillator|pendolo|pendulum", "Oscillazioni", ()),
    (r"gravitazione|gravitation|g\s*m\s*m", "Gravitazione", ()),
)


def extract_by_rules(chunks: DataFrame, rules=RULES) -> DataFrame:
    """A concept for each rule whose pattern a chunk matches, in the order of the rules; no join and no UDF."""
    lower = F.lower("text")
    hits = [
        F.when(lower.rlike(pattern), F.struct(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.array(*map(F.lit, formulas)).cast("array<string>").alias("formulas")))
        for i, (pattern, name, formulas) in enumerate(rules)
    ]
    found = chunks.select("chunk_id", "title", "text", F.inline(F.array_compact(F.array(*hits))))
    description = F.concat(F.lit("Concept detected from source chunk '"), "title", F.lit("'."))
    return found.select("chunk_id", "pos", "name", description.alias("description"), "formulas", F.lit("understand").alias("bloom_level"), F.lit(0.4).alias("confidence"), F.substring("text", 1, 240).alias("evidence"))


SYSTEM_PROMPT = "You extract a source-grounded knowledge graph from course text. Answer with valid JSON only."
PROMPT = "List the key concepts of this passage as a JSON array of objects with name, description, prerequisites, related, formulas, problem_types, bloom_level, confidence, evidence and aliases.\n\nSource title: {title}\nChunk id: {chunk_id}\n\nText:\n{text}"


def prompts(chunks: DataFrame, template: str = PROMPT, system: str = SYSTEM_PROMPT, max_chars: int = 4500) -> DataFrame:
    """chunk_id, system, prompt: the input of an external extraction model; the text is cut to ``max_chars``."""
    head, rest = template.split("{title}")
    middle, rest = rest.split("{chunk_id}")
    before, after = rest.split("{text}")
    text = F.concat(F.lit(head), "title", F.lit(middle), "chunk_id", F.lit(before), F.substring("text", 1, max_chars), F.lit(after))
    return chunks.select("chunk_id", F.lit(system).alias("system"), L.stripped(text).alias("prompt"))


def parse_extractions(raw: DataFrame) -> DataFrame:
    """chunk_id, concepts from model output (chunk_id, output): the outermost JSON array; nameless concepts go.

    Output without an array fails the query.
    """
    kind = "array<struct<name:string,description:string,prerequisites:array<string>,related:array<string>,formulas:array<string>,problem_types:array<string>,bloom_level:string,confidence:double,evidence:string,aliases:array<string>>>"
    body = F.regexp_extract("output", r"(?s)\[.*\]", 0)
    parsed = F.from_json(F.when(body == "", F.raise_error(F.lit("no JSON array in output"))).otherwise(body), kind)

    def coerced(c):
        clean = lambda n: F.filter(F.transform(F.coalesce(c[n], F.array().cast("array<string>")), L.stripped), lambda x: x != "")
        plain = lambda n, d: F.coalesce(F.nullif(L.stripped(c[n]), F.lit("")), F.lit(d))
        return F.struct(
            L.stripped(c["name"]).alias("name"), plain("description", "").alias("description"), *[clean(n).alias(n) for n in ("prerequisites", "related", "formulas", "problem_types", "aliases")],
            plain("bloom_level", "understand").alias("bloom_level"), F.coalesce(F.nullif(c["confidence"], F.lit(0.0)), F.lit(0.7)).alias("confidence"), F.nullif(L.stripped(c["evidence"]), F.lit("")).alias("evidence"),
        )

    return raw.select("chunk_id", F.filter(F.transform(parsed, coerced), lambda c: c["name"].isNotNull() & (c["name"] != "")).alias("concepts"))

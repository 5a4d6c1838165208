"""Sections and formulas of Markdown documents (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from .chunking import linked

#: Characters around a formula, of a chunk at most, and of a remainder at least.
AROUND, MOST, LEAST = 900, 2600, 180


def plain_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def heading_sections(docs: DataFrame) -> DataFrame:
    """section_id, doc_id, ordinal, level, title, text, start_char, end_char: from each heading outside code fences to the next.

    Text before the first heading is in no section. Newlines of any kind count as one "\\n".
    """
    lines = docs.select("doc_id", plain_newlines(F.col("text")).alias("text")).select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    w = Window.partitionBy("doc_id").orderBy("line")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.when(L.stripped(F.col("s")).startswith("```"), 1).otherwise(0)
    placed = lines.withColumn("start_char", F.coalesce(F.sum(F.length("s") + 1).over(before), F.lit(0)).cast("int")).withColumn("fences", F.sum(fence).over(upto))
    heads = placed.where((F.col("fences") % 2 == 0) & F.col("s").rlike(r"^#{1,6}\s+.+$"))
    heads = heads.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("end_char", F.coalesce(F.lead("start_char").over(w), F.length("text")))
    title = L.sanitize_title(F.regexp_extract("s", r"^#{1,6}\s+(.+)$", 1))
    body = L.stripped(F.expr("substring(text, start_char + length(s) + 2, greatest(0, end_char - start_char - length(s) - 1))"))
    sections = heads.select("doc_id", "ordinal", F.length(F.regexp_extract("s", "^(#{1,6})", 1)).alias("level"), title.alias("title"), body.alias("text"), "start_char", "end_char")
    return sections.withColumn("section_id", _section_id())


def _section_id() -> Column:
    digest = L.short_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), "title"), 10)
    return F.concat(F.lit("section:"), F.col("doc_id").cast("string"), F.lit(":"), F.lpad(F.col("ordinal").cast("string"), 5, "0"), F.lit(":"), digest)


def with_parents(sections: DataFrame) -> DataFrame:
    """Sections with parent_id: the nearest earlier section of a lower level."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.last(F.when(F.col("level") == k, F.struct("ordinal", "section_id")), ignorenulls=True).over(w).alias(f"_l{k}") for k in range(1, 7)]
    rows = sections.select("*", *latest)
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 7)])
    return rows.withColumn("parent_id", parent["section_id"]).drop(*[f"_l{k}" for k in range(1, 7)])


def thinned(sections: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Sections of fewer than ``min_tokens`` join the one before, under a heading of their own; the first never joins."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    keep = (L.token_estimate(F.col("text")) >= min_tokens) | (F.row_number().over(w) == 1)
    rows = sections.withColumn("_keep", keep).withColumn("_group", F.sum(F.col("_keep").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("_keep"), F.col("text")).otherwise(F.regexp_replace(F.concat(F.lit("\n\n## "), "title", F.lit("\n"), "text"), r"\s+$", ""))
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", part.alias("text"), F.when(~F.col("_keep"), F.col("title")).alias("merged"))))
    firsts = [F.min_by(c, "ordinal").alias(c) for c in ("section_id", "title", "level", "start_char", "parent_id") if c in sections.columns]
    out = rows.groupBy("doc_id", "_group").agg(F.min("ordinal").alias("ordinal"), *firsts, F.max("end_char").alias("end_char"), pieces.alias("p"))
    return out.withColumn("text", L.stripped(F.array_join("p.text", ""))).withColumn("merged_titles", F.array_compact("p.merged")).drop("p", "_group")


def paragraph_sections(docs: DataFrame, max_tokens: int = 500) -> DataFrame:
    """For documents without headings: sections of paragraphs packed while their estimates stay within ``max_tokens``.

    A section starts at the blank line before its first paragraph and is as long as its own text.
    """

    def pack(acc, piece):
        p = L.stripped(piece)
        n, blank = L.token_estimate(p), p == ""
        full = ~blank & (acc["cur"] != "") & (acc["n"] + n > max_tokens)
        fresh = full | (acc["cur"] == "")
        one = F.struct(acc["start"].alias("start"), acc["cur"].alias("text"), acc["first"].alias("first"))
        kept = lambda old, new, joined: F.when(blank, old).when(fresh, new).otherwise(joined)
        return F.struct(
            (acc["at"] + F.length(piece) + 2).cast("int").alias("at"),
            F.when(full, F.concat(acc["done"], F.array(one))).otherwise(acc["done"]).alias("done"),
            kept(acc["cur"], p, F.concat(acc["cur"], F.lit("\n\n"), p)).alias("cur"),
            kept(acc["first"], p, acc["first"]).alias("first"),
            kept(acc["start"], F.greatest(F.lit(0), acc["at"] - 2), acc["start"]).cast("int").alias("start"),
            F.when(blank, acc["n"]).when(full, n).otherwise(acc["n"] + n).cast("int").alias("n"),
        )

    part = "struct<start:int,text:string,first:string>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{part}>").alias("done"), F.lit("").alias("cur"), F.lit("").alias("first"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    last = lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["cur"].alias("text"), a["first"].alias("first")))))
    rows = docs.select("doc_id", F.posexplode(F.aggregate(F.split(plain_newlines(F.col("text")), "\n\n"), zero, pack, last)).alias("ordinal", "s"))
    title = L.sanitize_title(F.substring("s.first", 1, 80))
    rows = rows.select("doc_id", "ordinal", F.lit(1).alias("level"), title.alias("title"), "s.text", F.col("s.start").alias("start_char"), (F.col("s.start") + F.length("s.text")).alias("end_char"))
    return rows.withColumn("section_id", _section_id())


def sections_of(docs: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Sections of documents: by headings, thinned, or by paragraphs where a document has no heading outside code; blank ones have none."""
    headed = with_parents(heading_sections(docs))
    plain = docs.join(headed.select("doc_id").distinct(), "doc_id", "left_anti")
    by_heading = thinned(headed, min_tokens)
    by_paragraph = paragraph_sections(plain).withColumn("parent_id", F.lit(None).cast("string")).withColumn("merged_titles", F.array().cast("array<string>"))
    return by_heading.unionByName(by_paragraph)


# What encloses formulas, what a formula line has, and what a formula looks like.
_DISPLAY = (("display_math", r"\$\$(.+?)\$\$"), ("display_math", r"\\\[(.+?)\\\]"), ("equation_env", r"\\begin\{(?:equation|align|gather|multline)\*?\}(.+?)\\end\{(?:equation|align|gather|multline)\*?\}"))
_INLINE = r"(?<!\$)\$(?!\$)(.{3,120}?)(?<!\$)\$(?!\$)"
_LINE = r"(?im)^\s*(?:[A-Za-zΑ-ωàèéìòùÀÈÉÌÒÙ][\wΑ-ωàèéìòùÀÈÉÌÒÙ_()\s,.'-]{0,80})?(?:=|≈|≃|≤|≥|\+\s*C|\bproporzionale\b|\bproportional\b)[^\n]{2,160}$"
_OPERATOR, _SYMBOL = r"[=≈≃≤≥+\-/^_]", r"[A-Za-zΑ-ω\\]"


def formulas_of(doc_id, text: str) -> list[dict]:
    """Formulas of one text by place; displays win over inline ones and those over lines; equal texts count once."""
    covered = bytearray(len(text))
    rows = []
    tiers = [[(kind, re.compile(p, re.S), 1) for kind, p in _DISPLAY], [("inline_math", re.compile(_INLINE, re.S), 1)], [("formula_line", re.compile(_LINE), 0)]]
    for tier, patterns in enumerate(tiers):
        for kind, pattern, group in patterns:
            for m in pattern.finditer(text):
                body = re.sub(r"\s+", " ", m[group]).strip().strip("` ")
                if tier and any(covered[m.start() : m.end()]):
                    continue
                if not body or tier and not (len(body) >= 3 and re.search(_OPERATOR, body) and re.search(_SYMBOL, body)):
                    continue
                covered[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                rows.append({"doc_id": doc_id, "kind": kind, "text": body, "start_char": m.start(), "end_char": m.end()})
    unique: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: r["start_char"]):
        unique.setdefault(re.sub(r"\s+", "", r["text"].lower()), r)
    for r in unique.values():
        name = f"{doc_id}:{r['start_char']}:{r['text']}"
        r["formula_id"] = f"formula:{doc_id}:{hashlib.sha1(name.encode()).hexdigest()[:12]}"
    return list(unique.values())


def detect_formulas(docs: DataFrame) -> DataFrame:
    """formula_id, doc_id, kind, text, start_char, end_char; Python, as places of matches are needed."""
    columns = ["formula_id", "doc_id", "kind", "text", "start_char", "end_char"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([f for d, t in zip(frame["doc_id"], frame["text"]) if t for f in formulas_of(d, t)], columns=columns)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"formula_id string, doc_id {key}, kind string, text string, start_char int, end_char int")


def assign_formulas(formulas: DataFrame, sections: DataFrame) -> DataFrame:
    """formula_id, section_id: the deepest, latest section around a formula's start, or else the nearest one."""
    f = formulas.select("doc_id", "formula_id", F.col("start_char").alias("at"))
    s = sections.select("doc_id", "section_id", "level", F.col("start_char").alias("a"), F.col("end_char").alias("b"))
    pairs = f.join(s, "doc_id").withColumn("holds", (F.col("a") <= F.col("at")) & (F.col("at") <= F.col("b")))
    inside = F.max(F.when(F.col("holds"), F.struct("level", "a", "section_id")))
    near = F.min(F.struct(F.abs(F.col("a") - F.col("at")), "a", "section_id"))
    return pairs.groupBy("doc_id", "formula_id").agg(F.coalesce(inside["section_id"], near["section_id"]).alias("section_id"))


def formula_contexts(docs: DataFrame, formulas: DataFrame, assigned: DataFrame, around: int = AROUND, most: int = MOST) -> DataFrame:
    """formula_id, doc_id, section_id, at (the formula's start), text, start_char, end_char: each formula with its context.

    The context is widened to the next blank line or end of a sentence on either side, where there is one; what is
    longer than ``most`` characters is cut around the formula.
    """
    texts = docs.select("doc_id", plain_newlines(F.col("text")).alias("t"))
    rows = formulas.select("doc_id", "formula_id", F.col("start_char").alias("at"), "end_char").join(texts, "doc_id").join(assigned.select("formula_id", "section_id"), "formula_id")
    rows = rows.withColumn("a", F.greatest(F.lit(0), F.col("at") - around)).withColumn("b", F.least(F.length("t"), F.col("end_char") + around))
    head, tail = F.expr("reverse(substring(t, 1, a))"), F.expr("substring(t, b + 1)")
    back = F.least(*[F.when(F.instr(head, m) > 0, F.instr(head, m) - 1) for m in ("\n\n", " .")])
    on = F.least(*[F.when(F.instr(tail, m) > 0, F.instr(tail, m) + 1) for m in ("\n\n", ". ")])
    rows = rows.withColumn("a", F.col("a") - F.coalesce(back, F.lit(0))).withColumn("b", F.col("b") + F.coalesce(on, F.lit(0)))
    rows = rows.withColumn("whole", L.stripped(F.expr("substring(t, a + 1, b - a)")))
    long, skipped = F.length("whole") > most, F.greatest(F.lit(0), F.col("at") - F.col("a") - most // 2)
    rows = rows.withColumn("skipped", F.when(long, skipped).otherwise(0))
    rows = rows.withColumn("text", F.when(long, L.stripped(F.expr(f"substring(whole, skipped + 1, {most})"))).otherwise(F.col("whole")))
    start = F.col("a") + F.col("skipped")
    return rows.select("formula_id", "doc_id", "section_id", "at", "text", start.alias("start_char"), F.when(long, start + F.length("text")).otherwise(F.col("b")).alias("end_char"))


def without_spans(text: Column, spans: Column, start: Column) -> Column:
    """The text between the spans (sorted structs a, b; places counted from ``start`` before), joined by blank lines."""

    def cut(acc, s):
        a, b = F.greatest(F.lit(0), s["a"] - start), F.greatest(F.lit(0), s["b"] - start)
        part = F.when(a > acc["at"], text.substr(acc["at"] + 1, a - acc["at"])).otherwise("")
        return F.struct(F.greatest(acc["at"], b).cast("int").alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda acc: F.concat(acc["parts"], F.array(text.substr(acc["at"] + 1, F.length(text))))
    return F.array_join(F.filter(F.transform(F.aggregate(spans, zero, cut, rest), L.stripped), lambda p: p != ""), "\n\n")


def packed_paragraphs(text: Column, most: int = MOST, least: int = LEAST) -> Column:
    """Paragraphs packed up to ``most`` characters; longer ones stay whole; a last piece below ``least`` goes unless it is the only one."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), L.stripped), lambda p: p != "")

    def pack(acc, p):
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        fits = F.length(joined) <= most
        closed = F.when(fits | (acc["cur"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        return F.struct(closed.alias("done"), F.when(fits, joined).otherwise(p).alias("cur"))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    stays = lambda a: (a["cur"] != "") & ((F.length(a["cur"]) >= least) | (F.size(a["done"]) == 0))
    return F.aggregate(paragraphs, zero, pack, lambda a: F.when(stays(a), F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


CHUNK_PART = "struct<text:string,kind:string,formula_ids:array<string>,start_char:int,end_char:int,formula_text:string,formula_kind:string>"


def parser_chunks(docs: DataFrame, sections: DataFrame, formulas: DataFrame, around: int = AROUND, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Chunks of documents (doc_id, title, text, maybe source_path) around their formulas, linked in order.

    A section with formulas has one chunk for each, then what is left of it without them, if that is ``least`` characters
    or more; a section without any is packed by paragraphs. Formula places count from the document's start, a section's
    text from after its heading; the spans that go are the formula's places less the section's start, as they stand.
    """
    contexts = formula_contexts(docs, formulas, assign_formulas(formulas, sections), around, most)
    facts = formulas.select("formula_id", F.col("text").alias("formula_text"), F.col("kind").alias("formula_kind"), F.col("end_char").alias("formula_end"))
    one = F.struct(F.col("at").alias("a"), F.col("formula_end").alias("b"), "formula_id", "formula_text", "formula_kind", "text", "start_char", "end_char")
    # A section's formulas come from one document.
    held = contexts.join(facts, "formula_id").groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(one)).alias("f"))
    rows = sections.join(held, ["doc_id", "section_id"], "left")
    alone = F.col("f").isNull()
    rest = F.when(alone, F.col("text")).otherwise(without_spans(F.col("text"), F.col("f"), F.col("start_char")))
    pieces = F.when(alone | (F.length("rest") >= least), packed_paragraphs(F.col("rest"), most, least)).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    part = lambda *c: F.struct(*c).cast(CHUNK_PART)
    own = F.transform("f", lambda f: part(f["text"], F.lit("formula_context"), F.array(f["formula_id"]), f["start_char"], f["end_char"], f["formula_text"], f["formula_kind"]))
    kind = lambda p: F.when(alone & (F.length(p) < most), "paragraph").otherwise("section")
    others = F.transform("pieces", lambda p: part(p, kind(p), F.array().cast("array<string>"), F.col("start_char"), F.col("end_char"), none, none))
    parts = F.concat(F.coalesce(own, F.array().cast(f"array<{CHUNK_PART}>")), others)
    rows = rows.withColumn("rest", rest).withColumn("pieces", pieces).select("doc_id", "section_id", F.col("ordinal").alias("section"), F.col("title").alias("heading"), F.posexplode(parts).alias("i", "c"))
    path = F.col("source_path") if "source_path" in docs.columns else none
    rows = rows.join(docs.select("doc_id", F.col("title"), path.alias("source_path")), "doc_id")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "i")) - 1
    rows = rows.withColumn("ordinal", ordinal).select("doc_id", F.concat("title", F.lit(" — "), "heading").alias("title"), "ordinal", "section_id", "source_path", "c.*")
    digest = L.short_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.substring("text", 1, 200)), 12)
    chunk_id = F.concat(F.lit("pchunk:"), F.col("doc_id").cast("string"), F.lit(":"), F.lpad(F.col("ordinal").cast("string"), 5, "0"), F.lit(":"), digest)
    return linked(rows.withColumn("chunk_id", chunk_id))


def graph_shaped(chunks: DataFrame) -> DataFrame:
    """Parser chunks in the shape of the graph's source chunks: what only the parser knows goes into ``metadata``."""
    meta = F.struct(F.col("kind").alias("parser_kind"), "section_id", "formula_ids", "previous_chunk_id", "next_chunk_id", "start_char", "end_char", "formula_text", "formula_kind")
    page = F.lit(None).cast("int")
    return chunks.select("chunk_id", "doc_id", "title", "text", "ordinal", "source_path", page.alias("page_start"), page.alias("page_end"), meta.alias("metadata"))


def parse_markdown(docs: DataFrame, chunker=parser_chunks) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, formulas and chunks of documents (title, text, maybe doc_id and source_path); ``chunker`` may be another function."""
    if "doc_id" not in docs.columns:
        docs = docs.withColumn("doc_id", L.doc_id(F.col("title")))
    docs = docs.withColumn("text", plain_newlines(F.coalesce("text", F.lit(""))))
    sections, formulas = sections_of(docs), detect_formulas(docs)
    return sections, formulas, chunker(docs, sections, formulas)


def parsed_documents(docs: DataFrame, sections: DataFrame, formulas: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row per document with its sections, formulas and chunks inside, and their numbers; one document is one row, as it is one export."""
    rows = docs
    for name, part, order in (("sections", sections, "ordinal"), ("formulas", formulas, "start_char"), ("chunks", chunks, "ordinal")):
        each = F.struct(F.col(order).alias("_at"), F.struct(*[c for c in part.columns if c != "doc_id"]).alias("v"))
        inside = part.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["v"]).alias(name))
        rows = rows.join(inside, "doc_id", "left")
    numbers = F.struct(*[F.coalesce(F.size(n), F.lit(0)).alias(f"{n[:-1]}_count") for n in ("sections", "formulas", "chunks")])
    return rows.withColumn("metadata", numbers)

"""Entity resolution: similar labels, components, merges, graph build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from .graph import _saved

THRESHOLD = 0.86


def lexical_pairs(labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity for distinct normal forms (column ``norm``) that are similar; a < b.

    No nested loop: equal token sets meet on the set, containment on one trigram of the shorter form, and
    larger token sets on their rarest tokens (a similar pair shares one of the first n - ceil(t n) + 1).
    """
    n = _saved(labels.select("norm").where("norm <> ''").distinct().withColumn("tokens", F.array_sort(F.array_distinct(L.tokens(F.col("norm"))))))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("norm") - 2)), lambda i: F.substring(F.col("norm"), i, F.lit(3)))
    all_grams = n.select(F.col("norm").alias("long"), F.explode(F.array_distinct(grams)).alias("g"))
    # Of a form's trigrams, the rarest one is looked up.
    freq = all_grams.groupBy("g").count()
    least = all_grams.join(freq, "g").groupBy(F.col("long").alias("short")).agg(F.min_by("g", F.struct("count", "g")).alias("g"))
    contained = least.where(F.length("short") >= 3).join(all_grams, "g").where(F.col("long").contains(F.col("short")) & (F.col("long") != F.col("short"))).select("short", "long")
    # Forms of one or two characters: every form is asked by the one- and two-character strings that it has.
    small = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.length("norm")), lambda i, k=k: F.substring(F.col("norm"), i, F.lit(k))) for k in (1, 2)]))
    bits = n.select(F.col("norm").alias("long"), F.explode(F.array_distinct(small)).alias("short"))
    tiny = bits.join(n.where(F.length("norm") < 3).select(F.col("norm").alias("short")), "short").where("short <> long").select("short", "long")
    sets = n.select(F.col("norm").alias("short"), "tokens").join(n.select(F.col("norm").alias("long"), "tokens"), "tokens").where(F.col("short") < F.col("long")).select("short", "long")
    ranked = n.select("norm", "tokens", F.explode("tokens").alias("token"))
    rare = ranked.join(ranked.groupBy("token").count(), "token").groupBy("norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "token"))), lambda x: x["token"]).alias("order"))
    size = F.size("order")
    prefix = rare.select("norm", F.explode(F.slice("order", F.lit(1), (size - F.ceil(size * threshold) + 1).cast("int"))).alias("token"))
    overlap = prefix.select(F.col("norm").alias("short"), "token").join(prefix.select(F.col("norm").alias("long"), "token"), "token").where(F.col("short") < F.col("long")).select("short", "long")
    met = contained.unionByName(tiny).unionByName(sets).unionByName(overlap).select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    return met.withColumn("similarity", L.lexical_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold)


#: Vectors of a block, and rows of it that are compared at once.
VECTORS, ROWS_AT_ONCE = 8192, 512


def cosine_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """a, b, cosine of vectors (id, vector) at or above ``threshold``.

    Vectors are dealt to blocks of about VECTORS by hash of their id; each pair of blocks is one task, which holds
    ROWS_AT_ONCE x VECTORS cosines at a time. All pairs are compared, as the question is exact.
    """
    import numpy as np
    import pandas as pd

    if blocks is None:
        blocks = max(1, -(-vectors.count() // VECTORS))
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = rows.select(F.col("id").alias("i"), F.col("vector").alias("v"), F.lit(0).alias("side"), F.explode(F.expr(f"transform(sequence(own, {blocks - 1}), x -> own * {blocks} + x)")).alias("cell"))
    right = rows.select(F.col("id").alias("i"), F.col("vector").alias("v"), F.lit(1).alias("side"), F.explode(F.expr(f"transform(sequence(0, own), x -> x * {blocks} + own)")).alias("cell"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for s in (0, 1):
            part = pdf[pdf["side"] == s]
            m = np.array(part["v"].tolist(), float).reshape(len(part), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            sides.append((part["i"].to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))
        (x, a), (y, b) = sides
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        cell = int(pdf["cell"].iloc[0])
        found = []
        for k in range(0, len(x), ROWS_AT_ONCE):
            c = a[k : k + ROWS_AT_ONCE] @ b.T
            i, j = np.nonzero(c >= threshold)
            p, q = x[k : k + ROWS_AT_ONCE][i], y[j]
            keep = p < q if cell // blocks == cell % blocks else p != q
            found.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "cosine": c[i, j][keep]}))
        return pd.concat(found)

    return left.unionAll(right).groupBy("cell").applyInPandas(compare, "a long, b long, cosine double")


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that each node of the pairs is connected with."""
    edges = _saved(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = _saved(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("r"))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))  # roots of roots: halves the way
        after = _saved(labels.join(near, "node").withColumn("root", F.least("root", "r")).join(hop, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        if after.exceptAll(labels).isEmpty():
            return after
        labels = after


def embedding_links(concepts: DataFrame, embed, threshold: float = 0.85, lexical: float = THRESHOLD) -> DataFrame:
    """chunk_id, a, b: positions of a chunk's similar concepts, by their vectors where both have one, else by their names.

    ``embed`` is a function from texts ("name: description") to vectors; None stands for a text that has none. It runs
    where the concepts are. One chunk's concepts are compared in one task.
    """
    import numpy as np
    import pandas as pd

    def vectors(frames):
        for frame in frames:
            found = embed([f"{n}: {d or ''}" for n, d in zip(frame["name"], frame["description"])])
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "pos": frame["pos"], "norm": frame["norm"], "vector": [None if v is None else list(map(float, v)) for v in found]})

    rows = concepts.select("chunk_id", "pos", "name", "description", L.normalize_label(F.col("name")).alias("norm"))
    each = _saved(rows.mapInPandas(vectors, "chunk_id string, pos int, norm string, vector array<double>"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["vector"].tolist(), float).reshape(len(pdf), -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        i, j = np.nonzero(np.triu(m @ m.T >= threshold, 1))
        pos = pdf["pos"].to_numpy()
        return pd.DataFrame({"chunk_id": pdf["chunk_id"].iloc[0], "a": pos[i], "b": pos[j]})

    by_vector = each.where("vector IS NOT NULL").groupBy("chunk_id").applyInPandas(near, "chunk_id string, a int, b int")
    pairs = lexical_pairs(each, lexical).select("a", "b")
    same = each.where("norm <> ''").select(F.col("norm").alias("a"), F.col("norm").alias("b")).distinct()
    x = each.select("chunk_id", F.col("norm").alias("a"), F.col("pos").alias("p"), F.col("vector").isNotNull().alias("has_a"))
    y = each.select("chunk_id", F.col("norm").alias("b"), F.col("pos").alias("q"), F.col("vector").isNotNull().alias("has_b"))
    by_name = pairs.unionAll(same).join(x, "a").join(y, ["chunk_id", "b"]).where("p <> q AND NOT (has_a AND has_b)").select("chunk_id", F.col("p").alias("a"), F.col("q").alias("b"))
    return by_vector.unionByName(by_name)


def fuse_concepts(concepts: DataFrame, threshold: float = THRESHOLD, links: DataFrame | None = None) -> DataFrame:
    """Concepts (chunk_id, pos, name, description, confidence, evidence and arrays) with similar ones of a chunk made one.

    A group keeps the concept of the longest description (the first of equal ones), its largest confidence, and
    the union of prerequisites, related, formulas, problem_types and aliases, first mentions first, without
    regard to case. Groups are the components of lexically similar names; ``links`` (chunk_id, a, b: positions),
    such as pairs of similar embeddings, are used instead where given. One group is one chunk's concepts at most.
    """
    rows = _saved(concepts.withColumn("norm", L.normalize_label(F.col("name"))).withColumn("key", F.concat("chunk_id", F.lit(":"), F.lpad(F.col("pos").cast("string"), 10, "0"))))
    if links is None:
        near = lexical_pairs(rows, threshold).select("a", "b")
        same = rows.where("norm <> ''").select(F.col("norm").alias("a"), F.col("norm").alias("b")).distinct()
        x = rows.select("chunk_id", F.col("norm").alias("a"), F.col("key").alias("x"))
        y = rows.select("chunk_id", F.col("norm").alias("b"), F.col("key").alias("y"))
        pairs = near.unionAll(same).join(x, "a").join(y, ["chunk_id", "b"]).where("x <> y").select("x", "y").distinct()
    else:
        at = rows.select("chunk_id", "pos", "key")
        pairs = links.join(at.withColumnsRenamed({"pos": "a", "key": "x"}), ["chunk_id", "a"]).join(at.withColumnsRenamed({"pos": "b", "key": "y"}), ["chunk_id", "b"]).select("x", "y")
    joined = rows.join(components(pairs, "x", "y").withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lists = ("prerequisites", "related", "formulas", "problem_types", "aliases")
    whole = F.array_sort(F.collect_list(F.struct("pos", "name", *lists)))
    best = F.max_by(F.struct("name", "description", "bloom_level", "evidence"), F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("pos")))
    grouped = joined.groupBy("chunk_id", "root").agg(F.min("pos").alias("pos"), best.alias("best"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).cast("int").alias("group_size"), whole.alias("w"))
    none = F.array().cast("array<string>")

    def united(values: Column, but: Column | None) -> Column:
        trimmed = F.filter(F.transform(values, L.stripped), lambda t: (t != "") & (F.lit(True) if but is None else t != but))
        lower = F.transform(trimmed, F.lower)
        return F.filter(trimmed, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)

    flat = lambda name: F.flatten(F.transform("w", lambda c: F.coalesce(c[name], none)))
    named = F.flatten(F.transform("w", lambda c: F.concat(F.array(c["name"]), F.coalesce(c["aliases"], none))))
    own = F.col("best.name")
    merged = {"prerequisites": united(flat("prerequisites"), own), "related": united(flat("related"), own), "formulas": united(flat("formulas"), None), "problem_types": united(flat("problem_types"), None), "aliases": united(named, own)}
    # A concept alone stays as it came.
    alone = F.col("group_size") == 1
    out = [F.when(alone, F.get("w", F.lit(0))[n]).otherwise(merged[n]).alias(n) for n in lists]
    return grouped.select("chunk_id", "pos", "best.*", "confidence", *out, "group_size")


def fusion_report(fused: DataFrame) -> DataFrame:
    """One row: concepts in and out, groups merged, and concepts in them."""
    several = F.col("group_size") > 1
    return fused.agg(
        F.coalesce(F.sum("group_size"), F.lit(0)).alias("input_count"), F.count(F.lit(1)).alias("output_count"), F.count_if(several).alias("groups_merged"), F.coalesce(F.sum(F.when(several, F.col("group_size"))), F.lit(0)).alias("concepts_merged")
    )


def _in_order(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """``key`` and the distinct values of its rows, in the order of their first place; repeated ones go before rows meet."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("_o"))
    each = F.array_sort(F.collect_list(F.struct("_o", value)))
    return first.groupBy(*key).agg(F.transform(each, lambda x: x[value]).alias(value))


def merge_nodes(events: DataFrame) -> DataFrame:
    """One node for each node_id of upsert events (node_id, kind, seq, label, description, source, and maybe aliases and
    properties): the first label, the longest description (the first of equal ones), distinct further labels and aliases
    and distinct sources in order, and of each property the last value that isn't empty (the first event's may be)."""
    none = F.array().cast("array<string>")
    aliases = F.coalesce(F.col("aliases"), none) if "aliases" in events.columns else none
    out = events.groupBy("node_id", "kind").agg(F.min_by("label", "seq").alias("label"), F.min_by("description", F.when(F.col("description").isNotNull(), F.struct(-F.length("description"), "seq"))).alias("description"), F.min("seq").alias("_first"))
    named = events.select("node_id", "seq", F.posexplode(F.concat(F.array("label"), aliases)).alias("j", "names")).withColumn("o", F.struct("seq", "j"))
    out = out.join(_in_order(named, ["node_id"], "names", "o"), "node_id").join(_in_order(events.withColumnRenamed("source", "sources"), ["node_id"], "sources", "seq"), "node_id", "left")
    out = out.withColumn("aliases", F.array_except("names", F.array("label"))).drop("names")
    if "properties" in events.columns:
        each = events.select("node_id", "seq", F.explode("properties").alias("k", "v"))
        filled = F.when(F.coalesce("v", F.lit("")) != "", F.col("seq"))
        last = each.groupBy("node_id", "k").agg(F.coalesce(F.max_by("v", filled), F.min_by("v", "seq")).alias("v"), F.max(filled).isNotNull().alias("full"), F.min("seq").alias("s"))
        kept = last.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("k", "v", "full", "s"))).alias("p"))
        held = lambda e: e["full"] | (e["s"] == F.col("_first"))
        entries = F.transform(F.filter("p", held), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
        out = out.join(kept, "node_id", "left").withColumn("properties", F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))).drop("p")
    return out.drop("_first")


def merge_edges(events: DataFrame) -> DataFrame:
    """One edge for each (source_id, target_id, relation): largest weight, first evidence that isn't empty, number of
    events, and, where the events have a ``source``, distinct sources in order."""
    key = ["source_id", "target_id", "relation"]
    evidence = F.min_by("evidence", F.when(F.coalesce(F.col("evidence"), F.lit("")) != "", F.col("seq")))
    out = events.groupBy(*key).agg(F.max("weight").alias("weight"), evidence.alias("evidence"), F.count(F.lit(1)).alias("n_events"))
    if "source" not in events.columns:
        return out
    return out.join(_in_order(events.withColumnRenamed("source", "sources"), key, "sources", "seq"), key, "left")


def resolve_in_order(labels: DataFrame, threshold: float = THRESHOLD, pairs=lexical_pairs) -> DataFrame:
    """kind, seq, label, canonical, matched: each label (kind, seq, label, aliases; distinct by kind, ``seq`` of any type that has an order) takes the best match
    among earlier ones of its kind (aliases count as labels once seen), or stands for itself.

    Only labels that a chain of similar forms, or of labels and their aliases, connects can matter to each other: such a
    component of one kind is worked through in order in one task, with the similarities that ``pairs`` (norms, threshold ->
    a, b, similarity) found before; components spread.
    """
    import pandas as pd

    form = lambda x: F.struct(x.alias("label"), L.normalize_label(x).alias("norm"))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    rows = _saved(labels.select("kind", "seq", "label", L.normalize_label(F.col("label")).alias("norm"), F.transform(aliases, form).alias("also")))
    norms = rows.select("norm").unionAll(rows.select(F.explode("also.norm").alias("norm")))
    near = _saved(pairs(norms, threshold).select("a", "b", "similarity"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    around = both.groupBy(F.col("a").alias("norm")).agg(F.map_from_entries(F.collect_list(F.struct("b", "similarity"))).alias("near"))
    # Labels without a normal form match nothing; each of them, by itself, may have aliases.
    own = F.when(F.col("norm") == "", F.concat(F.lit("\0"), "label")).otherwise(F.col("norm"))
    other = lambda x: F.when(x["norm"] == "", F.concat(F.lit("\0"), x["label"])).otherwise(x["norm"])
    tied = rows.select(own.alias("a"), F.explode(F.transform("also", other)).alias("b")).where("a <> b")
    roots = components(near.select("a", "b").unionByName(tied)).withColumnRenamed("node", "own")
    rows = rows.withColumn("own", own).join(roots, "own", "left").withColumn("root", F.coalesce("root", "own")).join(around, "norm", "left").drop("own")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, str] = {}  # label -> canonical label
        first: dict[str, tuple[int, str]] = {}  # normal form -> place and canonical label of its first label
        out = []

        def register(label: str, norm: str, canonical: str) -> None:
            if label not in known:
                known[label] = canonical
                if norm:
                    first.setdefault(norm, (len(known), canonical))

        for r in pdf.sort_values("place").itertuples():
            canonical, matched = known.get(r.label), False
            if canonical is None:
                near = {r.norm: 1.0} | dict(r.near if r.near is not None else ()) if r.norm else {}
                scored = [(s, -first[n][0], first[n][1]) for n, s in near.items() if n in first and s >= threshold]
                matched = bool(scored)
                canonical = max(scored)[2] if scored else r.label
            register(r.label, r.norm, canonical)
            for alias in r.also:
                register(alias["label"], alias["norm"], canonical)
            out.append((r.kind, r.label, canonical, matched))
        return pd.DataFrame(out, columns=["kind", "label", "canonical", "matched"])

    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("kind", "root").orderBy("seq")))
    found = placed.drop("seq").groupBy("kind", "root").applyInPandas(run, "kind string, label string, canonical string, matched boolean")
    return labels.select("kind", "seq", "label").join(found, ["kind", "label"]).select("kind", "seq", "label", "canonical", "matched")


REF = "struct<doc_id:string,chunk_id:string,title:string,source_path:string,page_start:int,page_end:int,quote:string>"
#: Lists of a concept: what their items are, and how the concept is related to them.
PARTS = (("prerequisites", "concept", "REQUIRES"), ("related", "concept", "RELATED_TO"), ("formulas", "formula", "HAS_FORMULA"), ("problem_types", "problem_type", "USED_IN_PROBLEM_TYPE"))


def upsert_events(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """What a build says about nodes, in order: kind, label, description, aliases, properties, source, order; and what an
    event's node is related to: relation, weight, evidence, owner (a label)."""
    have = set(chunks.columns)
    page = lambda n: (F.col(n) if n in have else F.lit(None)).cast("int").alias(n)
    path = (F.col("source_path") if "source_path" in have else F.lit(None)).cast("string").alias("source_path")
    own = chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "title", F.col("text").alias("body"), F.col("ordinal").alias("at"), path, page("page_start"), page("page_end"))
    rows = extractions.select("chunk_id", "concepts").join(own, "chunk_id").withColumn("name", F.coalesce(F.nullif("title", F.lit("")), "chunk_id"))
    ref = lambda quote: F.struct("doc_id", "chunk_id", "title", "source_path", "page_start", "page_end", quote.cast("string").alias("quote")).cast(REF)
    none, nothing, text = F.array().cast("array<string>"), F.lit(None).cast("string"), lambda c: c.cast("string")
    order = lambda i, tier, p: F.struct("chunk_id", i.cast("int").alias("i"), F.lit(tier).alias("tier"), p.cast("int").alias("p"))

    def event(rows, kind, label, description, aliases, properties, quote, place, relation, owner):
        weight, evidence = (F.col("c.confidence"), F.col("c.evidence")) if relation else (F.lit(None).cast("double"), nothing)
        relation = F.lit(relation).cast("string")
        return rows.select(F.lit(kind).alias("kind"), label.alias("label"), description.alias("description"), aliases.alias("aliases"), properties.cast("map<string,string>").alias("properties"), ref(quote).alias("source"), place.alias("order"), relation.alias("relation"), weight.alias("weight"), evidence.alias("evidence"), owner.alias("owner"))

    about = F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("chunk_id"), F.col("chunk_id"), F.lit("ordinal"), text(F.col("at")))
    events = event(rows, "source_chunk", F.col("name"), F.substring("body", 1, 500), none, about, nothing, order(F.lit(-1), 0, F.lit(0)), None, nothing)
    each = rows.select("*", F.posexplode("concepts").alias("i", "c")).where("trim(coalesce(c.name, '')) <> ''")
    kept = F.create_map(F.lit("bloom_level"), F.col("c.bloom_level"), F.lit("confidence"), text(F.col("c.confidence")))
    quote = F.col("c.evidence")
    events = events.unionByName(event(each, "concept", F.col("c.name"), F.col("c.description"), F.coalesce("c.aliases", none), kept, quote, order(F.col("i"), 0, F.lit(0)), "MENTIONED_IN", F.col("name")))
    for tier, (field, kind, relation) in enumerate(PARTS, 1):
        item = each.select("*", F.posexplode(f"c.{field}").alias("p", "item"))
        events = events.unionByName(event(item, kind, F.col("item"), F.lit(""), none, F.lit(None), quote, order(F.col("i"), tier, F.col("p")), relation, F.col("c.name")))
    return events.withColumn("label", L.stripped(F.col("label"))).withColumn("owner", L.stripped(F.col("owner"))).where("label <> ''")


def build_graph(chunks: DataFrame, extractions: DataFrame, threshold: float = THRESHOLD, deduper=resolve_in_order) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted concepts (chunk_id, concepts), with provenance; chunks without any are left out.

    ``deduper`` says which label stands for which: a function of distinct labels (kind, seq, label, aliases) and the
    threshold that returns kind, label, canonical.
    """
    nodes, edges, _ = build_with_report(chunks, extractions, threshold, deduper)
    return nodes, edges


def build_with_report(chunks: DataFrame, extractions: DataFrame, threshold: float = THRESHOLD, deduper=resolve_in_order) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``build_graph``, with one row of counters: chunks and concepts seen, nodes and edges created, duplicates merged."""
    events = _saved(upsert_events(chunks, extractions))
    # An order for all events of a kind: a node's and an edge's parts are taken by it.
    first = events.groupBy("kind", "label").agg(F.min("order").alias("seq"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"))
    names = _saved(deduper(first.select("kind", "seq", "label", "aliases"), threshold))
    placed = events.withColumnRenamed("order", "seq").join(names.select("kind", "label", "canonical"), ["kind", "label"]).withColumn("node_id", L.node_id(F.col("kind"), F.col("canonical")))
    placed = _saved(placed)
    nodes = _saved(_merged(placed))
    owners = names.select(F.col("kind").alias("owner_kind"), F.col("label").alias("owner"), L.node_id(F.col("kind"), F.col("canonical")).alias("owner_id"))
    related = placed.where("relation IS NOT NULL").withColumn("owner_kind", F.when(F.col("relation") == "MENTIONED_IN", "source_chunk").otherwise("concept"))
    related = related.join(owners, ["owner_kind", "owner"])
    outward = F.col("relation") != "MENTIONED_IN"
    ends = [F.when(outward, F.col("owner_id")).otherwise(F.col("node_id")).alias("source_id"), F.when(outward, F.col("node_id")).otherwise(F.col("owner_id")).alias("target_id")]
    edges = _saved(merge_edges(related.select(*ends, "relation", "weight", "evidence", "seq", "source")))
    merged = names.agg(F.count_if("matched").alias("n")) if "matched" in names.columns else names.agg(F.count_if(F.col("canonical") != F.col("label")).alias("n"))
    seen = events.agg(F.count_if(F.col("kind") == "source_chunk").alias("chunks_seen"), F.count_if(F.col("relation") == "MENTIONED_IN").alias("concepts_seen"))
    report = seen.join(nodes.agg(F.count(F.lit(1)).alias("nodes_created"))).join(edges.agg(F.count(F.lit(1)).alias("edges_created"))).join(merged.withColumnRenamed("n", "duplicate_nodes_merged"))
    return nodes, edges, report  # the report joins single rows


def _merged(placed: DataFrame) -> DataFrame:
    """Nodes of resolved events: the canonical label is the node's own."""
    nodes = merge_nodes(placed.select("node_id", "kind", "seq", "label", "description", "aliases", "properties", "source"))
    names = placed.select("node_id", "canonical").distinct().groupBy("node_id").agg(F.min("canonical").alias("canonical"))
    whole = nodes.join(names, "node_id").withColumn("aliases", F.array_except(F.concat(F.array("label"), "aliases"), F.array("canonical")))
    return whole.withColumn("label", F.col("canonical")).drop("canonical")


def without_chunk(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """chunk_id of extractions whose chunk is unknown; the build leaves them out."""
    return extractions.select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti")


def summarize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: numbers of nodes by kind and of edges by relation."""
    a = nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "name", "n")
    b = edges.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "name", "n")
    return a.unionAll(b)

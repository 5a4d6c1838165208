"""The domain's tables, derived from the driver's, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "nodes": """
        SELECT p_partkey AS k, concat('n', CAST(p_partkey AS STRING)) AS id,
               CASE WHEN p_partkey % 10 < 7 THEN 'concept' WHEN p_partkey % 10 < 9 THEN 'formula' ELSE 'problem_type' END AS kind,
               CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', p_type) WHEN 2 THEN concat(p_type, ' of the ', p_name) ELSE concat(p_type, ' ', p_name) END AS label,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) END AS difficulty_given,
               p_size % 6 = 0 AS is_threshold, CAST(p_size % 25 AS INT) AS minutes, CAST(p_partkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS exam_relevance
        FROM {part}""",
    "edges": """
        SELECT concat('n', CAST(p_partkey AS STRING)) AS source_id, concat('n', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)) AS target_id, 'REQUIRES' AS relation FROM {part} WHERE p_partkey >= 2
        UNION ALL SELECT concat('n', CAST(p_partkey AS STRING)), concat('n', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)), 'REQUIRES' FROM {part} WHERE p_partkey >= 3 AND p_partkey % 3 = 0
        UNION ALL SELECT concat('n', CAST(p_partkey AS STRING)), concat('n', CAST(p_partkey + 7 - p_partkey % 10 AS STRING)), 'HAS_FORMULA' FROM {part} WHERE p_partkey % 10 < 7
        UNION ALL SELECT concat('n', CAST(p_partkey AS STRING)), concat('n', CAST(p_partkey + 9 - p_partkey % 10 AS STRING)), 'USED_IN_PROBLEM_TYPE' FROM {part} WHERE p_partkey % 10 < 7""",
    "related": """
        SELECT concat('n', CAST(a.l_partkey AS STRING)) AS source_id, concat('n', CAST(b.l_partkey AS STRING)) AS target_id, 'RELATED_TO' AS relation,
               CAST(1 AS DOUBLE) - CAST(a.l_discount AS DOUBLE) AS weight, CASE WHEN a.l_returnflag = 'N' THEN '' ELSE concat('order ', CAST(a.l_orderkey AS STRING)) END AS evidence,
               CAST(a.l_orderkey * 100 + a.l_linenumber * 10 + b.l_linenumber AS BIGINT) AS seq
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey""",
    "observations": """
        SELECT CAST(user_id AS BIGINT) AS learner_id, concat('n', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS STRING)) AS node_id, event_type <> 'error' AS correct,
               ts, CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(CAST(floor(abs(value)) AS BIGINT) % 6 AS INT) END AS quality, CASE WHEN event_type = 'error' THEN concat('mistake ', regexp_extract(props, '([0-9]+)', 1)) END AS mistake
        FROM {events}""",
    "docs": "SELECT doc_id, source AS title, replace(coalesce(text, ''), chr(10), concat(chr(10), chr(10))) AS text FROM {documents}",
    "raw_docs": "SELECT doc_id, source AS title, coalesce(text, '') AS text FROM {documents}",
    "page_parts": """
        SELECT CAST(floor(page_id / 5) AS BIGINT) AS doc_id, page_id, concat(substr('######', 1, CAST(1 + page_id % 3 AS INT)), ' ', regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), chr(10), chr(10),
               regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[#`]', ' ', 'g'), chr(10),
               CASE WHEN page_id % 2 = 0 THEN concat('```', chr(10), '# no heading', chr(10), '```', chr(10), '#### Note ', CAST(page_id AS STRING), chr(10), chr(10), 'A short remark on page ', CAST(page_id AS STRING), '.', chr(10)) ELSE '' END) AS part
        FROM {pages}""",
    "points": "SELECT CAST(floor(page_id / 5) AS BIGINT) AS doc_id, concat('f', CAST(page_id AS STRING)) AS formula_id, CAST(page_id * 7919 % 6000 AS INT) AS start_char FROM {pages}",
    "concepts": """
        SELECT concat('c', CAST(CAST(floor(k / 200) AS BIGINT) AS STRING)) AS chunk_id, CAST(k % 200 AS INT) AS pos, label AS name, concat(label, ' ', id) AS description, id AS alias, exam_relevance AS confidence FROM nodes""",
    "exercises": """
        SELECT concat('e', CAST(item_id AS STRING)) AS exercise_id, text AS statement, item_id,
               concat('n', CAST(item_id % 20 AS STRING)) AS need1, concat('n', CAST(3 * item_id % 20 AS STRING)) AS need2, CAST(item_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS difficulty,
               CAST(1 + item_id % 4 AS INT) AS steps, CASE item_id % 3 WHEN 0 THEN 'intro' WHEN 1 THEN 'core' ELSE 'exam' END AS ladder, CASE WHEN item_id % 2 = 0 THEN 'course' ELSE 'book' END AS priority
        FROM {benchmark}""",
    "attempts": "SELECT conv_id, turn, CAST(conv_id AS BIGINT) * 1000 + turn AS seq, text FROM {conversations} WHERE role = 'user'",
}
TABLES = ("part", "lineitem", "events", "documents", "pages", "benchmark", "conversations", "embeddings")


def adapter(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A derived table; ``stream`` reads its source as a stream."""
    text = SQL[name].replace(", 'g')", ")")  # Spark replaces all matches anyway
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if stream:
        used = {t: spark.readStream.schema(df.schema).option("pathGlobFilter", f"{t}.parquet").parquet(sf_dir) for t, df in used.items()}
    if name == "concepts":
        text, used = text.replace("FROM nodes", "FROM {nodes}"), {"nodes": adapter(spark, sf_dir, "nodes")}
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """The adapters as CTEs for DuckDB."""
    return ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names)

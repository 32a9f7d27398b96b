"""Input views derived from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.skew import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
#: Tables whose rows hold texts or become texts of a view, much longer than the rows: a few scan partitions would hold all the work.
SPREAD = {"documents", "customer", "supplier", "part", "events"}


def _lines(*parts: str) -> str:
    """SQL for a text of several lines; each part is an SQL string expression."""
    return " || chr(10) || ".join(parts)


_RANKED_AT = """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS event_time, 'b' || event_id AS bundle_id, {pos} AS pos,
  'p' || (user_id + {pos}) % 150 AS path,
  CASE (user_id + {pos}) % 6 WHEN 0 THEN 'code/handler' WHEN 1 THEN 'code/model' WHEN 2 THEN 'code' WHEN 3 THEN 'doc/readme'
    WHEN 4 THEN 'config/build' ELSE 'test' END AS kind,
  (CAST(floor(value) AS BIGINT) * 7 + {pos} * 13) % 98 / 100.0E0 AS embedding_score
FROM events WHERE event_type = 'view'"""

VIEWS = {
    "v_files": """
SELECT 'main' AS repo, doc_id, text AS content,
  CASE doc_id % 10
    WHEN 0 THEN 'docs/adr/note_' || doc_id || '.md'
    WHEN 1 THEN source || '/d' || doc_id || '/README.md'
    WHEN 2 THEN 'contracts/c' || doc_id || '.md'
    WHEN 3 THEN source || '/api/h' || doc_id || '.py'
    WHEN 4 THEN source || '/models/m' || doc_id || '.ts'
    WHEN 5 THEN source || '/utils/u' || doc_id || '.js'
    WHEN 6 THEN 'tests/test_h' || (doc_id - 3) || '.py'
    WHEN 7 THEN source || '/conf/x' || doc_id || '.json'
    WHEN 8 THEN source || '/core/k' || doc_id || '.py'
    ELSE source || '/w' || doc_id || '.spec.ts' END AS path
FROM documents""",
    "v_tasks": "SELECT item_id AS task_id, 'main' AS repo, text AS task FROM benchmark",
    "v_chunks": """
SELECT vec_id, 'main' AS repo, 'f' || CAST(floor(vec_id / 5) AS BIGINT) || '.py' AS path, vec_id % 5 AS chunk_index,
  CASE label % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'doc' WHEN 2 THEN 'test' ELSE 'config' END AS kind,
  CASE WHEN label < 5 THEN 'repo' ELSE 'registry' END AS namespace,
  CASE WHEN label % 2 = 0 THEN 'chunk' ELSE 'summary' END AS record_type,
  label, 'h' || vec_id AS content_hash, embedding AS vector
FROM embeddings""",
    # A later state of the same index: label 7 removed, label 3 edited, a further chunk for each of label 5.
    "v_chunks_new": """
SELECT repo, path, chunk_index, CASE WHEN label = 3 THEN content_hash || 'x' ELSE content_hash END AS content_hash,
  'text ' || vec_id AS embed_text
FROM v_chunks WHERE label <> 7
UNION ALL
SELECT repo, path, chunk_index + 5, content_hash || 'n', 'new text ' || vec_id FROM v_chunks WHERE label = 5""",
    "v_feedback": """
SELECT 'main' AS repo, event_id AS seq, CAST(ts AS TIMESTAMP) AS event_time,
  CASE event_type WHEN 'view' THEN 'bundle_emitted' WHEN 'signup' THEN 'self_report'
    WHEN 'error' THEN 'git_edit' ELSE 'tool_use' END AS event_type,
  CASE event_type WHEN 'view' THEN 'b' || event_id
    ELSE 'b' || CAST(max(CASE WHEN event_type = 'view' THEN event_id END)
      OVER (PARTITION BY user_id ORDER BY event_id) AS STRING) END AS bundle_id,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'p' || (user_id + event_id % 4) % 150 END AS path,
  CASE event_type WHEN 'purchase' THEN 'Edit' WHEN 'click' THEN 'Read' WHEN 'error' THEN 'Edit' END AS action,
  CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'informed_edit' WHEN 1 THEN 'informed_context'
    WHEN 2 THEN 'noise' ELSE 'bogus' END END AS relevance
FROM events""",
    "v_ranked": " UNION ALL ".join(f"SELECT 'main' AS repo, r.* FROM ({_RANKED_AT.format(pos=p)}) r" for p in (0, 1, 2)),
    "v_telemetry": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS event_time, event_type AS op,
  CASE WHEN event_type = 'purchase' THEN 'index_build' ELSE 'protocol_op' END AS event_type,
  'task' || user_id AS task_id, 'repo' || user_id % 12 AS repo_hash,
  CASE WHEN event_id % 3 = 0 THEN 'mcp' ELSE 'cli' END AS surface,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'E' || event_id % 5 END AS error_type,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS duration_ms,
  CAST(length(props) AS BIGINT) AS output_bytes,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 3) AS BIGINT) END AS embed_ms
FROM events""",
    "v_edges": """
SELECT 'main' AS repo, 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders
UNION ALL SELECT 'main', 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'main', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'main', 'n' || n_nationkey, 'r' || n_regionkey FROM nation""",
    "v_experiments": """
SELECT o_orderkey AS seq, 's' || o_custkey AS session_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS lane,
  CAST(o_orderkey % 100 AS DECIMAL(18,2)) AS cost_before,
  CAST(CAST(o_orderkey % 100 AS DECIMAL(18,2)) + CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS cost_after
FROM orders""",
    "v_diff": """
SELECT l_orderkey AS session_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'tests/t' || l_partkey || '.py' WHEN 1 THEN 'docs/d' || l_partkey || '.md'
    WHEN 2 THEN 'conf/c' || l_partkey || '.yaml' WHEN 3 THEN 'src/s' || l_partkey || '.ts'
    ELSE 'bin/b' || l_partkey || '.sh' END AS path,
  CASE WHEN l_returnflag = 'A' THEN '??' ELSE ' M' END AS status,
  CAST(l_quantity AS BIGINT) AS lines_added,
  CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_partkey % 20 END AS lines_deleted
FROM lineitem""",
    "v_transcript": """
SELECT conv_id, turn, role, text,
  CASE WHEN role = 'assistant' THEN CASE length(text) % 4 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Read'
    WHEN 2 THEN 'validate_plan' ELSE 'Write' END END AS tool_name
FROM conversations""",
    "v_payload": """
SELECT event_id AS seq, CAST(floor(event_id / 50) AS BIGINT) AS batch_id,
  CASE event_id % 10
    WHEN 0 THEN '{bad' WHEN 1 THEN '[1]'
    WHEN 2 THEN '{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"beta","build_id":"b","n":' || event_id || '}'
    WHEN 3 THEN '{"schema_version":1,"query":"q","event_type":"x","event_time":"t","install_id":"i","channel":"stable","build_id":"b"}'
    WHEN 4 THEN '{"event_type":"x","event_time":"t","install_id":"i","channel":"stable","build_id":"b"}'
    WHEN 5 THEN '{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"stable","build_id":"b","op":null}'
    WHEN 6 THEN '{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"canary","build_id":"b","dogfood":true,"traceback":"tb"}'
    WHEN 7 THEN '{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"canary","build_id":"b","traceback":"tb"}'
    ELSE '{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"stable","build_id":"b","duration_ms":' || event_id || '}'
  END AS raw,
  CASE event_id % 10 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_object' WHEN 2 THEN 'bad_channel' WHEN 3 THEN 'forbidden_key:query'
    WHEN 4 THEN 'missing_schema_version' WHEN 5 THEN 'bad_op' WHEN 7 THEN 'forbidden_key:traceback' END AS expected_reason
FROM events""",
    "v_branches": """
SELECT c_custkey AS seq, 'repo' || c_nationkey AS repo, c_name AS branch, 'sha' || c_custkey % 400 AS sha,
  c_custkey % 60 AS age_days, c_custkey % 5 AS commits_ahead, c_mktsegment = 'BUILDING' AS merged,
  c_custkey % 450 AS changed_files
FROM customer""",
    # A source tree written from the tables: Python modules from customers, tests from suppliers, contracts from nations,
    # agent notes from regions, scripts from parts. What it imports and states follows from the keys.
    "v_source": f"""
SELECT 'main' AS repo, 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path,
  {_lines(
      "'\"\"\"Segment ' || c_mktsegment || '.\"\"\"'",
      "'from .c' || (c_custkey + 1) || ' import run as nxt'",
      "'from pkg' || ((c_nationkey + 1) % 25) || ' import c' || (c_custkey + 2)",
      "'import pkg' || c_nationkey || '.c' || greatest(c_custkey - 1, 0) || ' as prev'",
      "''", "''",
      "'# INVARIANT: balance of ' || c_name || ' stays above zero'",
      "'class C' || c_custkey || ':'",
      "'    def run(self):'",
      "'        return ' || c_custkey",
      "''", "''",
      "'def main():'",
      "'    return C' || c_custkey || '().run()'", "''")} AS content
FROM customer
UNION ALL
SELECT 'main', 'tests/test_c' || s_suppkey || '.py',
  {_lines(
      "'from pkg' || s_nationkey || '.c' || s_suppkey || ' import main'",
      "''", "'def test_main():'", "'    assert main()'", "''")}
FROM supplier
UNION ALL
SELECT 'main', 'contracts/n' || n_nationkey || '.md',
  {_lines(
      "'---'", "'applies_to:'", "'  - pkg' || n_nationkey || '/*'",
      "'severity: ' || CASE n_nationkey % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'Guided' ELSE 'unknown' END",
      "'validated_by:'", "'  - ' || chr(34) || 'tests/test_c' || n_nationkey || '.py' || chr(34)", "'---'",
      "'# Contract ' || n_name", "''", "'Terms of ' || n_name || '.'", "''",
      "'## Invariants:'", "'- balance of ' || n_name || ' is settled'", "'  every day'", "'- names are unique'", "''",
      "'## Notes'", "'- not a rule'", "'### Do not'", "'1. drop ' || n_name", "''")}
FROM nation
UNION ALL
SELECT 'main', 'docs/r' || r_regionkey || '/AGENTS.md', 'Notes for ' || r_name || ' agents.' FROM region
UNION ALL
SELECT 'main', 'web/b' || p_size || '/p' || p_partkey || '.ts',
  {_lines(
      "'// See contract: contracts/n' || (p_partkey % 30) || '.md'",
      "'import {{ a }} from ' || chr(39) || './p' || (p_partkey + 1) || chr(39)",
      "'import b from ' || chr(39) || '../b' || p_size || '/p' || (p_partkey + 2) || chr(39)",
      "'export const p = require(' || chr(39) || './p' || p_partkey || chr(39) || ')'", "''")}
FROM part""".replace("{{", "{").replace("}}", "}"),
    # A vector score for each file against one task.
    "v_emb": """
SELECT item_id AS task_id, 'main' AS repo, path, ((doc_id * 37) % 100) / 100.0E0 - 0.1E0 AS score
FROM v_files JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark)""",
    # Threshold settings by layer, some under unknown kinds or without a number.
    "v_layers": """
SELECT source, key, CASE WHEN max(p_partkey) % 7 = 0 THEN 'oops' ELSE CAST(max(p_partkey) % 90 / 100.0E0 AS STRING) END AS q_value,
  CAST(min(p_partkey) % 9 / 100.0E0 AS STRING) AS t_value
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'file' WHEN 2 THEN 'learned' ELSE 'env' END AS source,
  CASE p_size % 9 WHEN 0 THEN 'code' WHEN 1 THEN 'doc' WHEN 2 THEN 'CONFIG' WHEN 3 THEN 'test' WHEN 4 THEN 'code/handler'
    WHEN 5 THEN 'doc/readme' WHEN 6 THEN 'bogus' WHEN 7 THEN '_default' ELSE 'bogus/x' END AS key FROM part) t
GROUP BY source, key""",
    # One task per nation, about its own package, and the change set it made: the nation's modules.
    "v_work": """
SELECT n_nationkey AS task_id, 'main' AS repo,
  'keep pkg' || n_nationkey || ' balance of ' || n_name || ' settled and names unique by contract' AS task FROM nation""",
    "v_changes": """
SELECT c_nationkey AS task_id, c_custkey AS pos, 'main' AS repo, 'pkg' || c_nationkey || '/c' || c_custkey || '.py' AS path
FROM customer""",
}


def _needed(sql: str) -> list[str]:
    found: list[str] = []
    for name in re.findall(r"\bv_[a-z_]+\b", sql):
        if name in VIEWS and name not in found:
            found = [n for n in _needed(VIEWS[name]) if n not in found] + found if VIEWS[name] else found
            if name not in found:
                found.append(name)
    ordered: list[str] = []
    for name in found:
        for dep in [*_needed(VIEWS[name]), name]:
            if dep not in ordered:
                ordered.append(dep)
    return ordered


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names."""
    names = _needed(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``; tables that are or become texts are spread when they come as a few scan partitions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = with_views(f"SELECT * FROM {name}")
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            rows = table(spark, sf_dir, t)
            (spread(rows) if t in SPREAD else rows).createOrReplaceTempView(t)
    return spark.sql(sql)

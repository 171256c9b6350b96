"""The relations that the operators take, derived from the shared test tables.

VIEWS holds one SQL text for each, in the dialect that Spark and DuckDB share, so a
query and its check start from the same rows and differ in everything after that.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # numeric candidates: three spellings of an item, five forms of a value, units in two orders, scores from 0 to 6
    "candidates": """
SELECT concat('p', cast(l_orderkey % 2003 AS string)) AS paper_index, cast(1 + l_partkey % 2 AS int) AS question_index, 1 AS round_index,
  concat('m', cast(l_suppkey % 7 AS string)) AS model,
  CASE WHEN l_linenumber = 6 AND l_orderkey % 5 = 0 THEN 'ilegal' WHEN l_returnflag = 'R' THEN 'Forest_smoldering' WHEN l_returnflag = 'A' THEN 'forest  Smouldering' ELSE 'Forest_flaming_None' END AS item,
  CASE cast(l_orderkey % 9 AS int) WHEN 0 THEN concat(cast(10 + cast(l_quantity AS int) % 3 AS string), ' to ', cast(20 + cast(l_quantity AS int) % 2 AS string))
    WHEN 1 THEN concat(cast(10 + cast(l_quantity AS int) % 3 AS string), '.25') WHEN 2 THEN concat(cast(10 + cast(l_quantity AS int) % 3 AS string), ' ± 0.4')
    WHEN 3 THEN CASE WHEN l_linenumber % 3 = 0 THEN 'not provided' WHEN l_linenumber % 3 = 1 THEN '999999' ELSE 'about 11' END
    WHEN 4 THEN concat('1', cast(cast(l_quantity AS int) % 3 AS string), '.75 kg') ELSE cast(10 + cast(l_quantity AS int) % 3 AS string) END AS value,
  CASE WHEN l_orderkey % 9 = 4 THEN 'N/A' WHEN l_linestatus = 'O' THEN 'mg m-2 h-1' ELSE 'h-1 mg m-2' END AS unit,
  CASE WHEN l_linenumber = 5 AND l_orderkey % 3 = 0 THEN ' None ' ELSE concat('Table ', cast(l_linenumber AS string)) END AS evidence,
  CASE WHEN l_linenumber = 7 THEN 'high' ELSE cast(cast(round(l_discount * 1000) AS int) AS string) END AS confidence_lv,
  CASE WHEN l_orderkey % 50 = 7 THEN NULL ELSE cast(round(l_discount * 100) AS int) % 7 END AS cross_score,
  CASE WHEN l_partkey % 3 = 0 THEN 'field' ELSE '' END AS experimental,
  concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS candidate_id, l_orderkey * 10 + l_linenumber AS seq
FROM lineitem""",
    # text, period and coordinate answers
    "text_answers": """
SELECT concat('p', cast(o_custkey % 499 AS string)) AS paper_index, 1 AS question_index, concat('m', cast(o_orderkey % 7 AS string)) AS model, o_orderkey AS seq,
  CASE cast(o_custkey % 3 AS int) WHEN 0 THEN 'Study_location' WHEN 1 THEN 'Study_period' ELSE 'Longitude' END AS item,
  CASE cast(o_custkey % 3 AS int)
    WHEN 0 THEN CASE cast(o_orderkey % 6 AS int) WHEN 0 THEN 'Lake Erken (Sweden)' WHEN 1 THEN 'Erken, the lake' WHEN 2 THEN 'Uppsala/Erken' WHEN 3 THEN 'n/a' WHEN 4 THEN 'Erken, Uppsala' ELSE NULL END
    WHEN 1 THEN CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN '2011' WHEN 1 THEN '2011-03' WHEN 2 THEN '2011-03-14' WHEN 3 THEN 'not provided' ELSE '2010' END
    ELSE CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN '119.5' WHEN 1 THEN '119.50' WHEN 2 THEN '120.25' WHEN 3 THEN '119.75' ELSE '' END END AS value
FROM orders""",
    # votes of four other models on each candidate's evidence
    "votes": """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS candidate_id, concat('m', cast(l_suppkey % 7 AS string)) AS input_model, concat('m', cast((l_suppkey + s.k) % 7 AS string)) AS output_model,
  CASE WHEN (l_orderkey + s.k) % 11 = 0 THEN -1 ELSE cast((l_orderkey + l_linenumber + s.k) % 2 AS int) END AS existing_flag,
  CASE WHEN (l_partkey + s.k) % 13 = 0 THEN ' ' ELSE 'quoted' END AS direct_quote, concat('v', cast(l_partkey % 4 AS string)) AS verification_fingerprint
FROM lineitem CROSS JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey < 6) s
WHERE (l_orderkey + 3 * s.k) % 5 <> 0""",
    # a run's attempts
    "attempts": """
SELECT cast(event_id AS string) AS attempt_id, concat('t', cast(user_id % 40 AS string)) AS task_id, concat('h', cast(event_id % 997 AS string)) AS request_hash, user_id,
  CASE event_type WHEN 'purchase' THEN 'received' WHEN 'view' THEN 'received' WHEN 'click' THEN 'dispatched' WHEN 'signup' THEN 'reserved' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'imported' END ELSE 'rejected' END AS status,
  event_id % 1000 AS reserved_tokens, cast((event_id % 100) * 0.25 AS double) AS reserved_cost, event_id % 700 AS actual_tokens, CASE WHEN event_id % 400 = 0 THEN NULL ELSE cast((event_id % 80) * 0.25 AS double) END AS actual_cost, event_id AS created_at
FROM events""",
    # events of requests, many of which their attempt's state refuses
    "request_events": """
SELECT concat('a', cast(user_id AS string), '-', cast(cast(floor(event_id / 200) AS int) % 7 AS string)) AS attempt_id, event_id, ts AS told_at,
  CASE event_type WHEN 'signup' THEN 'reserve' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'reserve' ELSE 'dispatch' END WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'dispatch' ELSE 'receive' END
    WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'reject' ELSE 'fail' END ELSE CASE WHEN event_id % 4 = 0 THEN 'recover' WHEN event_id % 4 = 1 THEN 'release' WHEN event_id % 4 = 2 THEN 'hold' ELSE NULL END END AS kind
FROM events""",
    # published records and a reference set for them
    "predicted": """
SELECT 'numeric' AS kind, concat('p', cast(l_orderkey % 2003 AS string)) AS paper_uid, 1 AS question, CASE WHEN l_linenumber % 2 = 0 THEN 'CH4_flux' ELSE 'CO2 fluxes' END AS item, '00_full' AS variant, 1 AS round,
  CASE WHEN l_suppkey % 20 = 0 THEN '' ELSE concat('e', cast(l_partkey % 3 AS string)) END AS experiment_id, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE 'mg m-2 h-1' END AS unit,
  CASE WHEN l_suppkey % 23 = 0 THEN 'unknown' ELSE cast(10 + cast(l_quantity AS int) % 4 AS string) END AS value, CASE WHEN l_linenumber = 3 AND l_orderkey % 4 = 0 THEN 'not_reported' WHEN l_linenumber = 7 THEN 'below_consensus' ELSE 'value' END AS status
FROM lineitem""",
    "gold": """
SELECT 'numeric' AS kind, concat('p', cast(o_orderkey % 4001 AS string)) AS paper_uid, 1 AS question, CASE WHEN o_custkey % 2 = 0 THEN 'CH4 flux' ELSE 'co2 flux' END AS item, '00_full' AS variant, 1 AS round,
  concat('e', cast(o_custkey % 3 AS string)) AS experiment_id, CASE WHEN o_custkey % 2 = 0 THEN 'h-1 mg m-2' ELSE 'mg m-2 h-1' END AS unit, cast(10 + o_orderkey % 4 AS string) AS value,
  CASE WHEN o_orderkey % 10 = 0 THEN 'not_reported' WHEN o_orderkey % 31 = 0 THEN 'unclear' ELSE 'value' END AS status
FROM orders""",
    # texts without an ending heading, with one, and with a contents list and two
    "papers": r"""
SELECT doc_id, lang, source, text, CASE cast(doc_id % 3 AS int) WHEN 0 THEN concat('# Introduction', chr(10), text) WHEN 1 THEN concat('# Introduction', chr(10), text, chr(10), '## References', chr(10), '1. ', source)
    ELSE concat('Contents', chr(10), '[References]', chr(10), '# Introduction', chr(10), text, chr(10), '**Acknowledgements**', chr(10), 'thanks', chr(10), '参 考 文 献', chr(10), '1. ', source) END AS paper FROM documents""",
}


def used(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived relation over the tables of a folder; the scan reads only the columns that its query takes."""
    sql = VIEWS[name]
    for t in used(sql):
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{folder}/{t}.parquet") for t in used(VIEWS[name])})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_views(sql: str) -> str:
    """A check's SQL with the views that it names in front of it."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    given = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    return sql if not names else f"WITH {given}, {sql.strip()[5:]}" if sql.strip()[:5].upper() == "WITH " else f"WITH {given} {sql.strip()}"

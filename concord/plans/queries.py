"""Every operator as a named query over the shared test tables, with SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.functions import body, ids, jsonx, markdown, numeric, secrets, text, vectors
from concord.functions.columns import computed
from concord.operators import answers, consensus, evaluation, ledger, lifecycle, numeric_votes, report, retrieval, run_state, running, scope, snapshot, text_votes, verification
from concord.plans.views import table, view, with_views
from concord.sources import ledger_log, shared

MODELS = [f"m{k}" for k in range(7)]
#: Short quotes that go out at once.
BRIEF_QUOTES = 2000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


# --- numbers -----------------------------------------------------------------------------------------------------

#: The checks' own reading of the forms that `candidates` has.
SQL_NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?"
SQL_NORM = rf"""
trimmed AS (
  SELECT *, trim(value) AS v, regexp_extract(trim(value), '^({SQL_NUMBER}) to ({SQL_NUMBER})$', 1) AS lo, regexp_extract(trim(value), '^({SQL_NUMBER}) to ({SQL_NUMBER})$', 2) AS hi, regexp_extract(value, '{SQL_NUMBER}') AS one FROM candidates
), numbers AS (
  SELECT *, CASE WHEN lower(v) IN ('', '[]', 'not provided', 'not specified', 'na', 'n/a', 'nan', 'none') THEN NULL WHEN lo <> '' THEN lo || '-' || hi WHEN one <> '' THEN one END AS scalar_value,
    CASE WHEN lower(trim(unit)) IN ('', '[]', 'not provided', 'not specified', 'na', 'n/a', 'nan', 'none') THEN '' ELSE array_to_string(list_sort(list_distinct(string_split(trim(unit), ' '))), ' ') END AS explicit_unit,
    CASE WHEN lo <> '' THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(replace(lower(value), one, ''), '[a-z%/][a-z0-9%/^-]*'))), ' ') END AS inline_unit,
    regexp_replace(trim(replace(item, '_', ' ')), ' +', ' ', 'g') AS item_norm
  FROM trimmed
), norm AS (
  SELECT *, CASE WHEN scalar_value IS NULL THEN '' WHEN explicit_unit <> '' THEN explicit_unit ELSE inline_unit END AS unit_norm, scalar_value IS NOT NULL AND explicit_unit <> '' AS unit_is_explicit,
    CASE WHEN explicit_unit <> '' THEN scalar_value || ' ' || explicit_unit WHEN inline_unit <> '' THEN scalar_value || ' ' || inline_unit ELSE scalar_value END AS normalized_value,
    array_to_string(list_transform(string_split(regexp_replace(lower(item_norm), ' (none|mixed)$', ''), ' '), lambda t: CASE WHEN t = 'smouldering' THEN 'smoldering' WHEN t = 'flamming' THEN 'flaming' WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END), '') AS item_key,
    coalesce(try_cast(confidence_lv AS double), 1.0) AS conf, scalar_value IS NOT NULL AND lower(scalar_value) NOT IN ('999999', '-1', 'na', 'n/a', 'nan', 'none', '') AS valid
  FROM numbers
)"""
SQL_TALLY = rf"""{SQL_NORM}, kept AS (SELECT * FROM norm WHERE item <> 'ilegal'),
shown AS (
  SELECT paper_index, question_index, item_key, item_norm AS item FROM (SELECT *, row_number() OVER (PARTITION BY paper_index, question_index, item_key ORDER BY n DESC, item_norm) AS r FROM (SELECT paper_index, question_index, item_key, item_norm, count(*) AS n FROM kept GROUP BY ALL)) WHERE r = 1
), tally AS (
  SELECT k.paper_index, k.question_index, s.item, k.normalized_value, min(k.scalar_value) AS scalar_value, coalesce(min(nullif(k.unit_norm, '')), '') AS unit, bool_or(k.unit_is_explicit) AS unit_is_explicit, count(*) AS count, sum(k.conf) AS confidence_sum, string_agg(DISTINCT k.model, ',' ORDER BY k.model) AS models
  FROM kept k JOIN shown s USING (paper_index, question_index, item_key) WHERE k.valid GROUP BY k.paper_index, k.question_index, k.item_key, s.item, k.normalized_value
)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "candidates")


@query(f"WITH {SQL_TALLY} SELECT * FROM tally")
def numeric_vote_tally(spark, folder):
    return numeric_votes.tally(candidates(spark, folder))


def _winner_sql(order: str) -> str:
    return f"""WITH {SQL_TALLY} SELECT paper_index, question_index, item, CASE WHEN unit_is_explicit THEN scalar_value ELSE normalized_value END AS ensemble_value, unit, unit_is_explicit, count AS vote_count, models
FROM (SELECT *, row_number() OVER (PARTITION BY paper_index, question_index, item ORDER BY {order}, normalized_value DESC) AS r FROM tally) WHERE r = 1"""


@query(_winner_sql("count DESC, confidence_sum DESC"))
def numeric_winner_by_votes(spark, folder):
    return numeric_votes.winners(numeric_vote_tally(spark, folder))


@query(_winner_sql("confidence_sum DESC, count DESC"))
def numeric_winner_by_confidence(spark, folder):
    return numeric_votes.winners(numeric_vote_tally(spark, folder), "confidence", "votes")


SQL_MODE = "mode AS (SELECT paper_index, count(*) AS n_values, count(*) FILTER (length(split_part(scalar_value, '.', 2)) >= 2) AS n_long, avg(CASE WHEN length(split_part(scalar_value, '.', 2)) >= 2 THEN 1.0 ELSE 0.0 END) >= 0.5 AS decimals_majority FROM norm WHERE valid GROUP BY paper_index)"


@query(f"WITH {SQL_NORM}, {SQL_MODE} SELECT * FROM mode")
def decimal_majority_papers(spark, folder):
    return numeric_votes.decimal_majority(candidates(spark, folder))


SQL_POOL = """pool AS (SELECT paper_index, question_index, normalized_value, sum(count)::BIGINT AS vote_count, array_to_string(list_sort(list_distinct(flatten(list(string_split(models, ','))))), ',') AS models, min(item) AS item, coalesce(min(nullif(unit, '')), '') AS unit, bool_or(unit_is_explicit) AS unit_is_explicit, min(scalar_value) AS scalar_value FROM tally GROUP BY ALL)"""


@query(f"WITH {SQL_TALLY}, {SQL_POOL} SELECT paper_index, question_index, item, CASE WHEN unit_is_explicit THEN scalar_value ELSE normalized_value END AS ensemble_value, unit, unit_is_explicit, vote_count, models FROM pool")
def pooled_candidates(spark, folder):
    return numeric_votes.pooled(numeric_vote_tally(spark, folder))


@query(
    f"""WITH {SQL_TALLY}, {SQL_MODE}, long AS (SELECT paper_index FROM mode WHERE decimals_majority),
best AS (SELECT *, row_number() OVER (PARTITION BY paper_index, question_index, item ORDER BY count DESC, confidence_sum DESC, normalized_value DESC) AS r FROM tally WHERE paper_index NOT IN (SELECT paper_index FROM long)), {SQL_POOL.replace("FROM tally", "FROM tally WHERE paper_index IN (SELECT paper_index FROM long)")}
SELECT paper_index, question_index, item, CASE WHEN unit_is_explicit THEN scalar_value ELSE normalized_value END AS ensemble_value, unit, unit_is_explicit, count AS vote_count, models FROM best WHERE r = 1
UNION ALL SELECT paper_index, question_index, item, CASE WHEN unit_is_explicit THEN scalar_value ELSE normalized_value END, unit, unit_is_explicit, vote_count, models FROM pool"""
)
def numeric_ensemble(spark, folder):
    return numeric_votes.ensemble(candidates(spark, folder))


@query(f"WITH {SQL_TALLY} SELECT paper_index, question_index, item_key AS item_equiv, item FROM shown")
def representative_item_mode(spark, folder):
    return numeric_votes.item_names(candidates(spark, folder))


SQL_OPTIONS = f"""{SQL_NORM}, kept AS (SELECT * FROM norm WHERE item <> 'ilegal'),
named AS (SELECT paper_index, item_key, item_norm AS item FROM (SELECT *, row_number() OVER (PARTITION BY paper_index, item_key ORDER BY n DESC, item_norm) AS r FROM (SELECT paper_index, item_key, item_norm, count(*) AS n FROM kept GROUP BY ALL)) WHERE r = 1),
boxes AS (SELECT paper_index, item_key, normalized_value AS value_norm, count(*) AS count, sum(conf) AS confidence_sum, string_agg(DISTINCT model, ',' ORDER BY model) AS models, array_to_string(list_sort(list_distinct(list(v)))[1:5], ', ') AS raw_samples FROM kept WHERE valid GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_index, item_key ORDER BY count DESC, confidence_sum DESC, value_norm) AS rank_by_votes, row_number() OVER (PARTITION BY paper_index, item_key ORDER BY confidence_sum DESC, count DESC, value_norm) AS rank_by_conf,
  row_number() OVER (PARTITION BY paper_index, item_key ORDER BY count DESC, confidence_sum DESC, value_norm DESC) AS best, sum(count) OVER g AS c, sum(confidence_sum) OVER g AS s, max(count) OVER g AS mc, max(confidence_sum) OVER g AS ms FROM boxes WINDOW g AS (PARTITION BY paper_index, item_key)),
options AS (SELECT paper_index, item, value_norm, count, confidence_sum, models, raw_samples, round(count / c, 9) AS vote_share, round(confidence_sum / CASE WHEN s = 0 THEN 1 ELSE s END, 9) AS conf_share, rank_by_votes::INT AS rank_by_votes, rank_by_conf::INT AS rank_by_conf, count = mc AS is_winner_by_votes, confidence_sum = ms AS is_winner_by_conf, best = 1 AS is_winner FROM ranked JOIN named USING (paper_index, item_key))"""


def _shares(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("vote_share", "conf_share")})


@query(f"WITH {SQL_OPTIONS} SELECT * FROM options")
def value_options_summary(spark, folder):
    return _shares(numeric_votes.value_options(candidates(spark, folder)))


@query(f"WITH {SQL_OPTIONS} SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY paper_index, item ORDER BY is_winner DESC, rank_by_votes) <= 2")
def value_options_topk(spark, folder):
    return _shares(numeric_votes.value_options(candidates(spark, folder), topk=2))


@query(f"""WITH {SQL_NORM} SELECT paper_index, normalized_value AS value_norm, count(DISTINCT model) AS vote_count, sum(conf) AS confidence_sum, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT item_norm, ',' ORDER BY item_norm) AS items, string_agg(model || ' -> ' || item_norm, '; ' ORDER BY seq, model || ' -> ' || item_norm) AS source FROM norm WHERE valid GROUP BY ALL""")
def value_majorities_by_numeric(spark, folder):
    return numeric_votes.majorities(candidates(spark, folder), "seq")


@query(f"WITH {SQL_NORM} SELECT item_key, string_agg(DISTINCT item, '|' ORDER BY item) AS spellings, count(*) AS n FROM norm GROUP BY item_key")
def item_equivalence_groups(spark, folder):
    return candidates(spark, folder).groupBy(text.item_key("item").alias("item_key")).agg(text.joined_distinct(F.col("item"), "|").alias("spellings"), F.count("*").alias("n"))


@query(f"WITH {SQL_NORM} SELECT explicit_unit AS unit_norm, count(DISTINCT unit) AS spellings, count(*) AS n FROM norm GROUP BY ALL")
def unit_canonical_groups(spark, folder):
    return candidates(spark, folder).groupBy(numeric.explicit_unit("unit").alias("unit_norm")).agg(F.count_distinct("unit").alias("spellings"), F.count("*").alias("n"))


@query("SELECT model, sum(coalesce(try_cast(confidence_lv AS double), 1.0)) AS confidence_sum, count(*) FILTER (try_cast(confidence_lv AS double) IS NULL) AS coerced FROM candidates GROUP BY model")
def confidence_coercion(spark, folder):
    bad = F.col("confidence_lv").rlike(r"^[+-]?\d+(\.\d+)?$")
    return candidates(spark, folder).groupBy("model").agg(F.sum(numeric.confidence("confidence_lv")).alias("confidence_sum"), F.count_if(~bad).alias("coerced"))


@query(f"WITH {SQL_NORM} SELECT CASE WHEN scalar_value IS NULL THEN 'unread' WHEN valid THEN 'valid' ELSE 'meaningless' END AS state, count(*) AS n FROM norm GROUP BY ALL")
def meaningless_filter(spark, folder):
    state = F.when(F.col("scalar_value").isNull(), "unread").when(numeric.is_meaningless("scalar_value"), "meaningless").otherwise("valid")
    return numeric.with_number(candidates(spark, folder).select("value"), "value").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


# --- consensus ---------------------------------------------------------------------------------------------------

SQL_GATE = rf"""{SQL_NORM}, chosen AS (
  SELECT paper_index, question_index, item_key, unit_norm AS unit, trim(experimental) AS experimental, normalized_value, scalar_value, trim(item) AS item, unit_is_explicit, model, candidate_id
  FROM norm WHERE valid AND cross_score >= 2 AND lower(trim(evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null')
), boxes AS (
  SELECT paper_index, question_index, item_key, unit, experimental, normalized_value, min(item) AS item, min(scalar_value) AS scalar_value, bool_or(unit_is_explicit) AS unit_is_explicit, count(DISTINCT model) AS count, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT candidate_id, '|' ORDER BY candidate_id) AS support_candidate_ids
  FROM chosen GROUP BY ALL
), most AS (SELECT *, max(count) OVER (PARTITION BY paper_index, question_index, item_key, unit, experimental) AS mx FROM boxes),
ties AS (SELECT *, sum(CASE WHEN count = mx THEN 1 ELSE 0 END) OVER (PARTITION BY paper_index, question_index, item_key, unit, experimental) AS at_max FROM most),
gated AS (SELECT *, CASE WHEN at_max > 1 AND count = mx THEN 'tied_mode' WHEN count <> mx THEN 'not_mode' WHEN mx < 3 THEN 'below_consensus_threshold' ELSE 'accepted' END AS gate_reason FROM ties)"""


def _gated(spark, folder) -> DataFrame:
    return consensus.confirm(candidates(spark, folder), MODELS, verification=2, least=3)


@query(f"WITH {SQL_GATE} SELECT paper_index, question_index, item_key, unit, experimental, normalized_value, item, scalar_value, unit_is_explicit, count, models, support_candidate_ids, gate_reason, gate_reason = 'accepted' AS accepted, round(count / 7, 9) AS fraction FROM gated")
def dual_threshold_consensus(spark, folder):
    return _gated(spark, folder).withColumn("fraction", F.round("fraction", 9)).drop("n_models", "consensus_threshold", "verification_threshold", "aggregation_mode")


@query(f"WITH {SQL_GATE} SELECT paper_index, question_index, item, scalar_value AS ensemble_value, unit, unit_is_explicit, count AS vote_count, models, experimental, support_candidate_ids, 'dual_threshold' AS method FROM gated WHERE gate_reason = 'accepted'")
def consensus_accepted_only(spark, folder):
    return consensus.accepted(_gated(spark, folder))


@query(f"WITH {SQL_GATE} SELECT gate_reason, count(*) AS n FROM gated GROUP BY gate_reason")
def consensus_gate_histogram(spark, folder):
    return _gated(spark, folder).groupBy("gate_reason").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN t IS NULL THEN '00_full' ELSE 'MiniCrossNN0' || t END AS variant, count(*) AS n FROM candidates JOIN (VALUES (NULL), (1), (2), (5)) AS x(t) ON t IS NULL OR cross_score >= t GROUP BY ALL")
def threshold_variants(spark, folder):
    return consensus.variants(candidates(spark, folder), [1, 2, 5]).groupBy("variant").agg(F.count("*").alias("n"))


@query("SELECT model, count(*) AS n FROM candidates WHERE model NOT IN ('m0', 'm1', 'm2', 'm3', 'm4') AND lower(trim(evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null') GROUP BY model")
def outside_pool(spark, folder):
    return consensus.outside_pool(candidates(spark, folder), MODELS[:5]).groupBy("model").agg(F.count("*").alias("n"))


# --- text, periods and coordinates -------------------------------------------------------------------------------

SQL_STOP = "['" + "', '".join(text.vocab.STOPWORDS) + "']"
SQL_TEXT = rf"""raw AS (SELECT *, CASE WHEN value IS NULL OR lower(trim(value)) IN ('', '-', '--', 'na', 'n/a', 'n.a.', 'nan', 'nat', 'none', 'null', 'nil', 'not provided', 'not specified') THEN NULL ELSE trim(value) END AS v FROM text_answers),
words AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(v), '\([^)]*\)|/', ' ', 'g'), '[^a-z0-9-]+'), lambda t: t <> '') AS w FROM raw),
norm AS (SELECT *, CASE WHEN v IS NULL THEN '' WHEN item = 'Study_location' THEN array_to_string(list_sort(CASE WHEN len(list_filter(w, lambda t: NOT list_contains({SQL_STOP}, t))) > 0 THEN list_filter(w, lambda t: NOT list_contains({SQL_STOP}, t)) ELSE w END), ' ') WHEN item = 'Study_period' THEN v ELSE rtrim(rtrim(v, '0'), '.') END AS normalized_value FROM words),
boxes AS (SELECT paper_index, question_index, item, normalized_value, count(*) AS count FROM norm GROUP BY ALL),
totals AS (SELECT *, sum(count) OVER g AS n, sum(CASE WHEN normalized_value = '' THEN count ELSE 0 END) OVER g AS empty FROM boxes WINDOW g AS (PARTITION BY paper_index, question_index, item))"""


def _texts(spark, folder, kind: str | None = None) -> DataFrame:
    df = view(spark, folder, "text_answers")
    return df if kind is None else df.filter(text.item_kind("item") == kind)


@query(f"""WITH {SQL_TEXT}, best AS (SELECT *, row_number() OVER (PARTITION BY paper_index, question_index, item ORDER BY count DESC, normalized_value = '', normalized_value) AS r FROM totals WHERE item = 'Study_location')
SELECT paper_index, question_index, item, CASE WHEN 2 * empty > n OR normalized_value = '' THEN NULL ELSE normalized_value END AS ensemble_value, CASE WHEN 2 * empty > n THEN empty ELSE count END::BIGINT AS support, CASE WHEN 2 * empty > n THEN 'majority_empty' ELSE 'text:vote' END AS method, n::BIGINT AS n_models FROM best WHERE r = 1""")
def text_vote(spark, folder):
    return text_votes.vote(text_votes.tally(text_votes.prepared(_texts(spark, folder, "text"), kinds=("text",))))


@query(f"WITH {SQL_TEXT} SELECT paper_index, question_index, item, normalized_value, count, round(count / n, 9) AS fraction FROM totals WHERE item = 'Study_location'")
def text_fraction(spark, folder):
    return text_votes.tally(text_votes.prepared(_texts(spark, folder, "text"), kinds=("text",))).withColumn("fraction", F.round("fraction", 9))


@query(f"WITH {SQL_TEXT} SELECT DISTINCT paper_index, question_index, item, empty::BIGINT AS support, n::BIGINT AS n_models FROM totals WHERE item = 'Study_location' AND 2 * empty > n")
def empty_majority(spark, folder):
    return text_vote(spark, folder).filter("method = 'majority_empty'").select("paper_index", "question_index", "item", "support", "n_models")


@query(f"""WITH {SQL_TEXT}, best AS (SELECT *, row_number() OVER (PARTITION BY paper_index, question_index, item ORDER BY normalized_value = '', count DESC, length(normalized_value) DESC, normalized_value) AS r FROM totals WHERE item = 'Study_period')
SELECT paper_index, question_index, item, CASE WHEN 2 * empty > n OR normalized_value = '' THEN NULL ELSE normalized_value END AS ensemble_value, CASE WHEN 2 * empty > n THEN empty WHEN normalized_value = '' THEN 0 ELSE count END::BIGINT AS support, CASE WHEN 2 * empty > n THEN 'majority_empty' WHEN normalized_value = '' THEN 'period:no_valid' ELSE 'period:vote' END AS method, n::BIGINT AS n_models FROM best WHERE r = 1""")
def period_vote(spark, folder):
    return text_votes.period_vote(text_votes.prepared(_texts(spark, folder, "period"), kinds=("period",)))


@query(f"""WITH {SQL_TEXT}, coords AS (SELECT *, try_cast(nullif(normalized_value, '') AS double) AS x FROM totals WHERE item = 'Longitude'),
middle AS (SELECT *, median(x) OVER (PARTITION BY paper_index, question_index, item) AS m FROM coords),
best AS (SELECT *, row_number() OVER (PARTITION BY paper_index, question_index, item ORDER BY x IS NULL, count DESC, abs(x - m), x) AS r FROM middle)
SELECT paper_index, question_index, item, CASE WHEN 2 * empty > n OR x IS NULL THEN NULL ELSE printf('%.2f', x) END AS ensemble_value, CASE WHEN 2 * empty > n OR x IS NULL THEN empty ELSE count END::BIGINT AS support, CASE WHEN 2 * empty > n THEN 'majority_empty' ELSE 'coord:interval_vote' END || '+coord_round2' AS method, n::BIGINT AS n_models FROM best WHERE r = 1""")
def coord_precision_merge(spark, folder):
    return text_votes.coord_vote(text_votes.tally(text_votes.prepared(_texts(spark, folder, "coord"), kinds=("coord",))))


# --- tasks and answers -------------------------------------------------------------------------------------------


def _grid(spark, folder) -> DataFrame:
    papers = candidates(spark, folder).select("paper_index").distinct()
    models = spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"))
    questions = spark.range(1, 3).select(F.col("id").cast("int").alias("question_index"))
    return answers.task_grid(papers, models, questions)


SQL_GRID = "grid AS (SELECT paper_index, model, question_index FROM (SELECT DISTINCT paper_index FROM candidates), (SELECT DISTINCT model FROM candidates), (SELECT DISTINCT question_index FROM candidates))"
KEYS = ("paper_index", "model", "question_index")


@query(f"WITH {SQL_GRID} SELECT * FROM grid")
def task_grid(spark, folder):
    return _grid(spark, folder)


@query(f"WITH {SQL_GRID} SELECT * FROM grid EXCEPT SELECT paper_index, model, question_index FROM candidates")
def missing_tasks_anti(spark, folder):
    return answers.missing(_grid(spark, folder), candidates(spark, folder), KEYS)


@query("SELECT candidate_id, paper_index, model FROM candidates WHERE model = 'm6' OR question_index = 2")
def unexpected_rows_anti(spark, folder):
    expected = _grid(spark, folder).filter("model <> 'm6' and question_index = 1")
    return answers.unexpected(expected, candidates(spark, folder), KEYS).select("candidate_id", "paper_index", "model")


@query("SELECT paper_index, question_index, model, item, value, min(candidate_id) AS candidate_id FROM candidates GROUP BY ALL")
def composite_dedupe(spark, folder):
    keys = ("paper_index", "question_index", "model", "item", "value")
    return answers.first_of(candidates(spark, folder).select(*keys, "candidate_id"), *keys)


@query("""SELECT candidate_id, CASE WHEN trim(item) IN ('', 'ilegal', 'invalid_syntax') THEN 'item' WHEN try_cast(confidence_lv AS double) IS NULL OR try_cast(confidence_lv AS double) NOT BETWEEN -1 AND 100 THEN 'confidence'
  WHEN lower(trim(value)) NOT IN ('', '999999', 'none', 'nan', 'null', 'n/a', 'na', 'not provided', 'not specified', '[]') AND lower(trim(unit)) IN ('', '999999', 'none', 'nan', 'null', 'n/a', 'na', 'not provided', 'not specified', '[]') THEN 'no_unit'
  WHEN lower(trim(value)) NOT IN ('', '999999', 'none', 'nan', 'null', 'n/a', 'na', 'not provided', 'not specified', '[]') AND experimental = '' THEN 'no_experimental' END AS rule FROM candidates WHERE rule IS NOT NULL""")
def answer_validation_violations(spark, folder):
    return answers.violations(candidates(spark, folder), "numeric", require_unit=True, require_experimental=True).select("candidate_id", "rule")


#: Forms of a reply, with K for a number; the check holds what each must be read as, or that it can't be.
REPLIES = [
    "Here it is: {k: {'value': K, evidence: 'seen',},",
    '{"a, }": {"value": "x,]yK", "evidence": "{"}}',
    "{k: {value: 0xK, evidence: +K}}",
    "{k: {value: .5, evidence: 'K.'}, true: {value: -K, evidence: null}}",
    "{k: {value: 'line \\\non K', evidence: \"it's // no comment\"}}",
    '{"k": {"value": "K", "evidence": "/* \\u00e9 */"}}',
    "{/* {K} */ $k_1: {value: 'it\\'s \\x41 K', evidence: \"\\\"\"}, // the end\n}",
    "{k: {value: K",
    "{k: {value: K evidence: 'no comma'}}",
    "{k: {value: [K, 2,], evidence: K}, k: {value: 'again', evidence: Infinity}}",
]


@query("""WITH r AS (SELECT event_id, event_id % 10 AS f, CAST(json_extract(props, '$.k') AS BIGINT) AS n, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL)
SELECT event_id, 'k' AS item, k AS value, 'seen' AS evidence FROM r WHERE f = 0 UNION ALL SELECT event_id, 'a, }', 'x,]y' || k, '{' FROM r WHERE f = 1
UNION ALL SELECT event_id, 'k', CAST(n // 10 * 16 + n % 10 AS VARCHAR), k FROM r WHERE f = 2 UNION ALL SELECT event_id, 'k', '0.5', k || '.' FROM r WHERE f = 3 UNION ALL SELECT event_id, 'true', CAST(-n AS VARCHAR), NULL FROM r WHERE f = 3
UNION ALL SELECT event_id, 'k', 'line on ' || k, 'it''s // no comment' FROM r WHERE f = 4 UNION ALL SELECT event_id, 'k', k, '/* é */' FROM r WHERE f = 5
UNION ALL SELECT event_id, '$k_1', 'it''s A ' || k, '"' FROM r WHERE f = 6 UNION ALL SELECT event_id, 'k', 'again', 'Infinity' FROM r WHERE f = 9""")
def json_reply_explode(spark, folder):
    form = F.get(F.array(*map(F.lit, REPLIES)), (F.col("event_id") % len(REPLIES)).cast("int"))
    rows = table(spark, folder, "events").select("event_id", F.replace(form, F.lit("K"), F.get_json_object("props", "$.k")).alias("reply"))
    return jsonx.answer_rows(rows).select("event_id", "item", "value", "evidence")


@query("SELECT l_linenumber AS line, regexp_extract(l_shipdate::VARCHAR, '^([0-9]{4})', 1) AS year, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("line"), F.year("l_shipdate").cast("string").alias("year"))
    return rows.groupBy("line", "year").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT model, 'left' AS side, count(*) AS n FROM candidates WHERE cross_score IS NULL GROUP BY model")
def row_difference(spark, folder):
    rows = candidates(spark, folder).select("candidate_id", "model", "cross_score")
    return answers.same_rows(rows, rows.filter("cross_score is not null")).groupBy("model", "side").agg(F.count("*").alias("n"))


# --- verification ------------------------------------------------------------------------------------------------


@query("SELECT c.candidate_id, m.model AS output_model FROM candidates c JOIN (SELECT DISTINCT model FROM candidates) m ON m.model <> c.model WHERE lower(trim(c.evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null')")
def verifier_fanout(spark, folder):
    return verification.fan_out(candidates(spark, folder), MODELS).select("candidate_id", "output_model")


SQL_VOTES = "good AS (SELECT * FROM votes WHERE input_model <> output_model AND existing_flag IN (0, 1) AND (existing_flag = 0 OR trim(direct_quote) <> '')), flags AS (SELECT candidate_id, input_model AS model, output_model, max(existing_flag) AS flag FROM good GROUP BY ALL)"


@query(f"WITH {SQL_VOTES}, sums AS (SELECT candidate_id, model, sum(flag)::DOUBLE AS cross_score FROM flags GROUP BY ALL) SELECT c.candidate_id, c.model, s.cross_score FROM candidates c LEFT JOIN sums s USING (candidate_id, model)")
def cross_score(spark, folder):
    return verification.cross_scores(candidates(spark, folder).select("candidate_id", "model"), view(spark, folder, "votes"), MODELS, pivot=False)


@query(f"WITH {SQL_VOTES}, sums AS (SELECT candidate_id, model, sum(flag)::DOUBLE AS cross_score, " + ", ".join(f"max(flag) FILTER (output_model = '{m}')::DOUBLE AS flag_{m}" for m in MODELS) + " FROM flags GROUP BY ALL) SELECT c.candidate_id, c.model, s.* EXCLUDE (candidate_id, model) FROM candidates c LEFT JOIN sums s USING (candidate_id, model)")
def cross_score_pivot(spark, folder):
    return verification.cross_scores(candidates(spark, folder).select("candidate_id", "model"), view(spark, folder, "votes"), MODELS)


@query(f"WITH {SQL_VOTES}, asked AS (SELECT c.candidate_id, c.model, m.model AS output_model FROM candidates c JOIN (SELECT DISTINCT model FROM candidates) m ON m.model <> c.model WHERE lower(trim(c.evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null')) SELECT candidate_id, model, output_model FROM asked ANTI JOIN good USING (candidate_id, output_model)")
def coverage_violations(spark, folder):
    return verification.missing_votes(candidates(spark, folder), view(spark, folder, "votes"), MODELS)


@query("SELECT verification_fingerprint, count(*) AS n FROM votes WHERE (verification_fingerprint = 'v0' AND output_model <> 'm3') OR (verification_fingerprint = 'v1' AND output_model = 'm3') GROUP BY ALL")
def current_votes(spark, folder):
    signatures = spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("output_model"), F.when(F.col("id") == 3, "v1").otherwise("v0").alias("verification_fingerprint"))
    return verification.current(view(spark, folder, "votes"), signatures).groupBy("verification_fingerprint").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_VOTES}, asked AS (SELECT DISTINCT c.candidate_id, m.model AS output_model FROM candidates c JOIN (SELECT DISTINCT model FROM candidates) m ON m.model <> c.model WHERE lower(trim(c.evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null')),
cast_ AS (SELECT candidate_id, output_model, max(CASE WHEN existing_flag IN (0, 1) THEN existing_flag END) AS flag, count(*) FILTER (existing_flag = -1) AS errors, 1 AS was FROM votes GROUP BY ALL), both_ AS (SELECT a.candidate_id IS NOT NULL AS asked, c.* FROM asked a FULL JOIN cast_ c ON a.candidate_id = c.candidate_id AND a.output_model = c.output_model)
SELECT (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) FROM candidates WHERE lower(trim(evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null')) AS eligible, count(*) FILTER (asked) AS expected, count(*) FILTER (asked AND flag IS NOT NULL) AS seen, count(*) FILTER (asked AND flag = 1) AS found, count(*) FILTER (asked AND flag IS NULL AND errors > 0) AS errors, count(*) FILTER (asked AND was IS NULL) AS missing, count(*) FILTER (NOT asked) AS unexpected FROM both_""")
def verification_accounting(spark, folder):
    return report.verification_accounting(candidates(spark, folder), view(spark, folder, "votes"), MODELS)


# --- retrieval ---------------------------------------------------------------------------------------------------


def _chunks(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("label").alias("paper"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query("""WITH e AS (SELECT label AS paper, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.paper, a.vec_id AS evidence_id, b.vec_id AS chunk_id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.paper = b.paper AND a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id)
SELECT paper, evidence_id, chunk_id, round(s, 6) AS max_similarity FROM s QUALIFY row_number() OVER (PARTITION BY paper, evidence_id ORDER BY s DESC, chunk_id) = 1""")
def nearest_chunk(spark, folder):
    rows = _chunks(spark, folder)
    evidence = rows.filter("chunk_id % 20 = 0").select("paper", F.col("chunk_id").alias("evidence_id"), "vector")
    return retrieval.nearest_chunk(evidence, rows, others=True).withColumn("max_similarity", F.round("max_similarity", 6))


@query("SELECT label AS paper, vec_id AS chunk_id, string_agg(concat('c', vec_id), chr(10) || chr(10)) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM embeddings")
def neighbour_context(spark, folder):
    rows = _chunks(spark, folder).withColumn("chunk", F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
    return retrieval.neighbours(rows, 1).select("paper", "chunk_id", "context")


@query("SELECT vec_id, len(embedding) AS size, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, true AS is_valid FROM embeddings")
def vector_validity(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("size"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), vectors.is_valid(F.col("embedding"), 64).alias("is_valid"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents), b AS (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS q FROM benchmark) SELECT item_id, count(doc_id) AS n_documents FROM b LEFT JOIN d ON contains(t, q) GROUP BY item_id""")
def quote_in_context(spark, folder):
    quotes = table(spark, folder, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("q"))
    # a quote's first eight words find the places that can hold it, so a text is compared with few quotes
    starts = lambda c: F.slice(F.split(c, " "), 1, 8)
    docs = table(spark, folder, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("t"))
    split = computed(docs.select("doc_id", "t"), words=F.split("t", " ")).withColumn("places", F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("words") - 1)))
    runs = split.select("doc_id", F.explode(F.array_distinct(F.transform("places", lambda i: F.xxhash64(F.array_join(F.slice("words", i, 6), " "))))).alias("seed"))
    # a quote of fewer words may begin and end within words, so it has no seed and is looked for in every text
    brief = F.coalesce(F.size(F.split("q", " ")), F.lit(0)) < 8
    asked = quotes.filter(~brief).withColumn("seed", F.xxhash64(F.array_join(F.slice(starts(F.col("q")), 2, 6), " ")))
    near = runs.join(asked, "seed").select("doc_id", "item_id", "q").distinct()
    hits = near.join(docs, "doc_id").filter(F.contains("t", F.col("q"))).select("item_id")
    short = quotes.filter(brief)
    blocks = -(-short.count() // BRIEF_QUOTES)
    for k in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("item_id", "q"), F.lit(blocks)) == k)
        hits = hits.unionAll(docs.join(F.broadcast(block), F.contains("t", F.col("q"))).select("item_id"))
    found = hits.groupBy("item_id").agg(F.count("*").alias("n"))
    return quotes.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


@query()
def chunk_documents(spark, folder):
    return markdown.chunks(table(spark, folder, "documents").select("doc_id", "text")).drop("start")


@query(r"""SELECT doc_id, true AS whole, true AS in_order, true AS fits, true AS as_written FROM papers WHERE regexp_replace(paper, '\s', '', 'g') <> ''""")
def markdown_chunks(spark, folder):
    """Papers in chunks by the table function: whether a paper's chunks hold all its words, follow one another, keep the size and are what stands at their place."""
    rows = view(spark, folder, "papers").select("doc_id", "paper")
    found = markdown.chunks(rows, "paper", fences=True, headings=True).withColumn("stop", F.col("start") + F.length("chunk"))
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "start", "stop", "chunk"))).alias("c"))
    told = found.join(rows.withColumnRenamed("paper", "own"), "doc_id")
    right = F.forall("c", lambda x: F.substr("own", x["start"].cast("int") + 1, F.length(x["chunk"])) == x["chunk"])
    # what stands between a chunk and the next one, before the first and behind the last is white space
    gaps = F.transform(F.sequence(F.lit(0), F.size("c")), lambda n: F.struct(F.coalesce(F.get("c.stop", n - 1), F.lit(0)).alias("a"), F.coalesce(F.get("c.start", n), F.length("own")).alias("b")))
    blank = F.forall(gaps, lambda g: (g["b"] <= g["a"]) | F.substr("own", g["a"].cast("int") + 1, (g["b"] - g["a"]).cast("int")).rlike(r"(?U)^[\s\x1c-\x1f]*$"))
    follow = F.col("c.chunk_id") == F.sequence(F.lit(0), F.size("c") - 1)
    return told.select("doc_id", blank.alias("whole"), follow.alias("in_order"), F.forall("c", lambda x: F.length(x["chunk"]) <= 2048).alias("fits"), right.alias("as_written"))


SQL_BODY = "CASE WHEN doc_id % 3 = 0 THEN paper WHEN doc_id % 3 = 1 THEN concat('# Introduction', chr(10), text, chr(10)) ELSE concat('Contents', chr(10), '[References]', chr(10), '# Introduction', chr(10), text, chr(10)) END"


@query(f"SELECT doc_id, {SQL_BODY} AS body FROM papers")
def body_truncation(spark, folder):
    return view(spark, folder, "papers").select("doc_id", body.body("paper").alias("body"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '[\x00-\x1F\x7F]', '', 'g'), '<.*?>', '', 'g') AS text FROM pages")
def html_strip(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.without_tags("html").alias("text"))


@query("SELECT sum(length(p.paper))::BIGINT AS chars, sum(length(p.text))::BIGINT AS body_chars, count(*) AS n FROM papers p")
def body_characters(spark, folder):
    return view(spark, folder, "papers").agg(F.sum(F.char_length("paper")).alias("chars"), F.sum(F.char_length("text")).alias("body_chars"), F.count("*").alias("n"))


SQL_TOKENS = r"len(regexp_extract_all({}, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\r\f\x0B]'))"


@query(f"WITH b AS (SELECT paper, {SQL_BODY} AS body FROM papers), s AS (SELECT length(paper) AS chars, length(body) AS body_chars, {SQL_TOKENS.format('paper')} AS tokens, {SQL_TOKENS.format('body')} AS body_tokens FROM b) SELECT sum(chars)::BIGINT AS chars, sum(body_chars)::BIGINT AS body_chars, sum(tokens)::BIGINT AS tokens, sum(body_tokens)::BIGINT AS body_tokens, round(sum(body_tokens) / sum(tokens), 9) AS kept_ratio FROM s")
def token_audit(spark, folder):
    return report.token_audit(view(spark, folder, "papers").withColumn("body", body.body("paper")), "paper", "body").withColumn("kept_ratio", F.round("kept_ratio", 9))


# --- report ------------------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_NORM}, last AS (SELECT paper_index, item_key AS item, model, normalized_value AS value FROM norm QUALIFY row_number() OVER (PARTITION BY paper_index, item_key, model ORDER BY seq DESC, normalized_value DESC NULLS LAST) = 1) SELECT paper_index, item, count(*) AS n_models, count(DISTINCT coalesce(value, '')) AS n_values, count(DISTINCT coalesce(value, '')) > 1 AS disagree FROM last GROUP BY ALL""")
def disagreement(spark, folder):
    rows = numeric.with_value_unit(candidates(spark, folder)).withColumn("item", text.item_key("item"))
    return report.disagreement(rows, "seq")


@query(f"""WITH {SQL_NORM}, r AS (SELECT candidate_id, paper_index, item_key AS item, model, scalar_value, try_cast(scalar_value AS double) AS x FROM norm WHERE scalar_value IS NOT NULL),
m AS (SELECT paper_index, item, list_sort(list(x))[len(list(x)) // 2 + 1] AS upper_median FROM r WHERE x IS NOT NULL GROUP BY ALL), g AS (SELECT paper_index, item FROM r GROUP BY ALL HAVING count(DISTINCT model) >= 2)
SELECT candidate_id, upper_median, 'outlier' AS warning FROM r JOIN m USING (paper_index, item) JOIN g USING (paper_index, item) WHERE abs(x - upper_median) > 100 * greatest(abs(upper_median), 1e-12) UNION ALL SELECT candidate_id, NULL, 'range' FROM r WHERE x IS NULL""")
def outlier_screen(spark, folder):
    rows = numeric.with_value_unit(candidates(spark, folder)).withColumn("item", text.item_key("item")).select("candidate_id", "paper_index", "item", "model", "scalar_value")
    return report.outliers(rows).select("candidate_id", "upper_median", "warning")


@query("""SELECT t AS threshold, count(*) AS eligible, count(*) FILTER (cross_score >= t) AS passed, count(*) FILTER (cross_score IS NULL) AS incomplete, round(count(*) FILTER (cross_score >= t) / count(*), 9) AS pass_rate, round((count(*) FILTER (cross_score >= t) + count(*) FILTER (cross_score IS NULL)) / count(*), 9) AS possible_upper_rate
FROM candidates, (VALUES (1), (2), (3), (4), (5), (6)) AS x(t) WHERE lower(trim(evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null') GROUP BY t""")
def threshold_pass_rates(spark, folder):
    out = report.threshold_pass_rates(candidates(spark, folder), [1, 2, 3, 4, 5, 6])
    return out.withColumns({c: F.round(c, 9) for c in ("pass_rate", "possible_upper_rate")})


@query(f"""WITH {SQL_GRID}, s AS (SELECT paper_index, model, question_index, count(*) FILTER (status = 'succeeded') AS ok, count(*) FILTER (status = 'invalid') AS bad, count(*) FILTER (status = 'failed') AS err FROM (SELECT *, CASE WHEN item = 'ilegal' THEN 'invalid' WHEN cross_score IS NULL THEN 'running' WHEN cross_score = 6 THEN 'failed' ELSE 'succeeded' END AS status FROM candidates) GROUP BY ALL)
SELECT CASE WHEN ok > 0 THEN 'answered' WHEN bad > 0 THEN 'invalid' WHEN err > 0 THEN 'failed' WHEN ok IS NOT NULL THEN 'pending' ELSE 'not_begun' END AS outcome, count(*) AS n FROM grid LEFT JOIN s USING (paper_index, model, question_index) GROUP BY ALL""")
def extraction_coverage(spark, folder):
    status = F.when(F.col("item") == "ilegal", "invalid").when(F.col("cross_score").isNull(), "running").when(F.col("cross_score") == 6, "failed").otherwise("succeeded")
    return report.extraction_coverage(_grid(spark, folder), candidates(spark, folder).withColumn("status", status), list(KEYS))


@query(f"WITH {SQL_NORM} SELECT paper_index, item_key AS item, count(DISTINCT nullif(unit_norm, '')) AS n_units FROM norm GROUP BY ALL HAVING count(DISTINCT nullif(unit_norm, '')) > 1")
def unit_warnings(spark, folder):
    return report.unit_warnings(numeric.with_value_unit(candidates(spark, folder)).withColumn("item", text.item_key("item")))


@query("SELECT cross_score, count(*) AS n FROM candidates WHERE lower(trim(evidence)) NOT IN ('', 'nan', 'na', 'n/a', 'none', 'null') GROUP BY ALL")
def score_histogram(spark, folder):
    return report.score_histogram(candidates(spark, folder))


@query(f"WITH {SQL_GATE} SELECT gate_reason AS result_kind, count(*) AS n FROM gated GROUP BY ALL")
def result_kinds(spark, folder):
    return report.result_kinds(_gated(spark, folder))


@query("SELECT CASE WHEN vec_id % 9 = 0 THEN 'missing' WHEN vec_id % 7 = 0 THEN 'stale' ELSE 'valid' END AS state, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_states(spark, folder):
    rows = table(spark, folder, "embeddings")
    expected = rows.select("vec_id", F.lit("f").alias("expected_fingerprint"))
    found = rows.filter("vec_id % 9 <> 0").select("vec_id", F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 7 == 0, "old").otherwise("f").alias("fingerprint"))
    return report.vector_states(expected, found, ["vec_id"], 64)


# --- evaluation --------------------------------------------------------------------------------------------------

#: The rules of judging one after another: what each record says, what is known of each key, which contexts are consumed, and each verdict.
SQL_EVAL = """prep AS (
  SELECT side, paper_uid, question, replace(replace(lower(item), '_', ' '), ' ', '') AS k0, variant, round, experiment_id, status, value, unit,
    CASE WHEN status <> 'value' THEN NULL WHEN try_cast(value AS double) IS NULL THEN 'malformed_value' WHEN unit IS NULL OR unit = '' THEN 'no_unit' WHEN experiment_id = '' THEN 'no_experiment' END AS why
  FROM (SELECT 'g' AS side, * FROM gold UNION ALL SELECT 'p', * FROM predicted)
), rows_ AS (SELECT *, CASE WHEN k0 = 'co2fluxes' THEN 'co2fluxe' ELSE k0 END AS item_key, value || ' ' || array_to_string(list_sort(string_split(unit, ' ')), ' ') AS said FROM prep
), asserted AS (SELECT DISTINCT side, paper_uid, question, item_key, variant, round, experiment_id, said FROM rows_ WHERE status = 'value' AND why IS NULL
), agreed AS (SELECT DISTINCT paper_uid, question, item_key, variant, round, experiment_id FROM asserted g JOIN asserted p USING (paper_uid, question, item_key, variant, round, experiment_id, said) WHERE g.side = 'g' AND p.side = 'p'
), k AS (
  SELECT paper_uid, question, item_key, variant, round, experiment_id,
    count(*) FILTER (side = 'g' AND status = 'value' AND why IS NULL) AS gold_values, count(*) FILTER (side = 'g' AND status = 'not_reported') AS gold_absent, count(*) FILTER (side = 'g' AND status NOT IN ('value', 'not_reported')) AS gold_diagnostic,
    count(*) FILTER (side = 'p' AND status = 'value' AND why IS NULL) AS pred_values, count(*) FILTER (side = 'p' AND status = 'not_reported') AS pred_absent, count(*) FILTER (side = 'p' AND status NOT IN ('value', 'not_reported')) AS pred_diagnostic,
    count(*) FILTER (side = 'g' AND why = 'malformed_value') AS gold_bad
  FROM rows_ GROUP BY ALL
), ctx AS (SELECT paper_uid, question, item_key, variant, round, count(*) AS near, count(*) FILTER (why = 'malformed_value') AS bad FROM rows_ WHERE side = 'p' GROUP BY ALL
), v AS (
  SELECT k.*, CASE WHEN gold_values = 0 THEN NULL WHEN pred_values > 0 AND a.paper_uid IS NOT NULL THEN 'match' WHEN pred_values > 0 THEN 'value_mismatch' WHEN pred_absent + pred_diagnostic > 0 OR coalesce(bad, 0) > 0 THEN 'reference_value_not_published'
    WHEN near > 0 THEN 'prediction_not_comparable' ELSE 'no_comparable_prediction' END AS value_,
    CASE WHEN gold_absent = 0 THEN NULL WHEN pred_absent > 0 THEN 'absence_confirmed' WHEN pred_values > 0 THEN 'value_where_none_is_reported' WHEN pred_diagnostic > 0 THEN 'absence_against_diagnostic' ELSE 'absence_unmatched' END AS absence_
  FROM k LEFT JOIN ctx USING (paper_uid, question, item_key, variant, round) LEFT JOIN agreed a USING (paper_uid, question, item_key, variant, round, experiment_id)
), consumed AS (SELECT DISTINCT paper_uid, question, item_key, variant, round FROM v WHERE value_ IN ('match', 'value_mismatch', 'reference_value_not_published') OR absence_ IS NOT NULL
), wrong AS (SELECT paper_uid, question, item_key, variant, round, experiment_id, 'uncovered_prediction' AS alone_ FROM v ANTI JOIN consumed USING (paper_uid, question, item_key, variant, round) WHERE pred_values > 0 AND gold_values = 0
), judged AS (
  SELECT paper_uid, question, item_key, variant, round, experiment_id, gold_values, gold_absent, gold_diagnostic, pred_values, pred_absent, pred_diagnostic,
    coalesce(nullif(concat_ws('+', value_, absence_, alone_, CASE WHEN gold_diagnostic + gold_bad > 0 THEN 'unresolved_reference' END), ''), 'not_judged') AS reason,
    CASE WHEN value_ = 'match' THEN 1 ELSE 0 END AS tp,
    CASE WHEN value_ = 'value_mismatch' THEN pred_values ELSE 0 END + CASE WHEN absence_ = 'value_where_none_is_reported' THEN pred_values ELSE 0 END + CASE WHEN alone_ IS NOT NULL THEN pred_values ELSE 0 END AS fp,
    CASE WHEN value_ IN ('value_mismatch', 'reference_value_not_published') THEN gold_values ELSE 0 END AS fn, CASE WHEN absence_ = 'absence_confirmed' THEN 1 ELSE 0 END AS tn,
    CASE WHEN value_ IN ('prediction_not_comparable', 'no_comparable_prediction') THEN gold_values ELSE 0 END + CASE WHEN absence_ IN ('absence_against_diagnostic', 'absence_unmatched') THEN gold_absent ELSE 0 END + gold_diagnostic + gold_bad AS unmatched
  FROM v LEFT JOIN wrong USING (paper_uid, question, item_key, variant, round, experiment_id)
)"""


def _judged(spark, folder) -> DataFrame:
    gold = view(spark, folder, "gold").withColumn("item", F.when(F.col("item") == "co2 flux", "CO2 fluxes").otherwise(F.col("item")))
    return evaluation.cases(gold, view(spark, folder, "predicted"))


def _eval_sql(rest: str) -> str:
    return "WITH " + SQL_EVAL.replace("FROM (SELECT 'g' AS side, * FROM gold", "FROM (SELECT 'g' AS side, * REPLACE (CASE WHEN item = 'co2 flux' THEN 'CO2 fluxes' ELSE item END AS item) FROM gold") + " " + rest


@query(_eval_sql("SELECT paper_uid, question, item_key, variant, round, experiment_id, gold_values, gold_absent, gold_diagnostic, pred_values, pred_absent, pred_diagnostic, reason, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, unmatched::BIGINT AS unmatched FROM judged"))
def evaluation_cases(spark, folder):
    return _judged(spark, folder)


@query(_eval_sql("SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(unmatched)::BIGINT AS unmatched, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 9) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 9) AS recall FROM judged"))
def evaluation_confusion(spark, folder):
    return evaluation.metrics(_judged(spark, folder)).select("tp", "fp", "fn", "tn", "unmatched", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(_eval_sql("SELECT reason, count(*) AS n FROM judged GROUP BY reason"))
def evaluation_reasons(spark, folder):
    return _judged(spark, folder).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT p.paper_uid, p.experiment_id, count(*) AS n FROM predicted p ANTI JOIN gold g ON g.paper_uid = p.paper_uid AND g.experiment_id = p.experiment_id GROUP BY ALL""")
def uncovered_predictions(spark, folder):
    key = lambda df: df.withColumns({"item_key": F.lit("k")})
    return evaluation.uncovered(key(view(spark, folder, "gold")), key(view(spark, folder, "predicted"))).groupBy("paper_uid", "experiment_id").agg(F.count("*").alias("n"))


@query("SELECT kind, CASE WHEN status <> 'value' THEN 'comparable' WHEN try_cast(value AS double) IS NULL THEN 'malformed_value' WHEN unit IS NULL THEN 'no_unit' WHEN experiment_id = '' THEN 'no_experiment' ELSE 'comparable' END AS reason, count(*) AS n FROM predicted GROUP BY ALL")
def uncomparable_records(spark, folder):
    return evaluation.excluded(view(spark, folder, "predicted")).withColumn("kind", F.lit("numeric"))


@query("""WITH p AS (SELECT l_orderkey AS k, list(DISTINCT cast(l_quantity AS int) % 5) AS a, list(DISTINCT l_linenumber % 5) AS b FROM lineitem GROUP BY l_orderkey) SELECT list_has_any(a, b) AS overlap, count(*) AS n FROM p GROUP BY ALL""")
def candidate_set_overlap(spark, folder):
    sets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("int") % 5).alias("a"), F.collect_set(F.col("l_linenumber") % 5).alias("b"))
    return sets.groupBy(F.arrays_overlap("a", "b").alias("overlap")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_GATE}, r AS (SELECT paper_index, item_key, normalized_value, unnest(string_split(support_candidate_ids, '|')) AS candidate_id FROM gated WHERE gate_reason = 'accepted') SELECT r.candidate_id, r.item_key, c.model FROM r JOIN candidates c USING (candidate_id)")
def support_candidates(spark, folder):
    found = _gated(spark, folder).filter("accepted").select("item_key", "support_candidate_ids")
    return evaluation.support(found, candidates(spark, folder).select("candidate_id", "model")).select("candidate_id", "item_key", "model")


@query("""SELECT source, count(*) FILTER (n_chars < 1000 AND quality = 0) AS tp, count(*) FILTER (n_chars < 1000 AND quality = 1) AS fp, count(*) FILTER (n_chars >= 1000 AND quality = 0) AS fn, count(*) FILTER (n_chars >= 1000 AND quality = 1) AS tn, 0::BIGINT AS unmatched, round(count(*) FILTER (n_chars < 1000 AND quality = 0) / nullif(count(*) FILTER (n_chars < 1000), 0), 9) AS precision, round(count(*) FILTER (n_chars < 1000 AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 9) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def labelled_precision_recall(spark, folder):
    both = table(spark, folder, "documents").select("doc_id", "source", (F.col("n_chars") < 1000).alias("said")).join(table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("is")), "doc_id")
    one = lambda c: c.cast("int")
    judged = both.select("source", one(F.col("said") & F.col("is")).alias("tp"), one(F.col("said") & ~F.col("is")).alias("fp"), one(~F.col("said") & F.col("is")).alias("fn"), one(~F.col("said") & ~F.col("is")).alias("tn"), F.lit(0).alias("unmatched"))
    return evaluation.metrics(judged, "source").drop("f1").withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


# --- ledger ------------------------------------------------------------------------------------------------------


@query("SELECT status, count(*) AS n FROM attempts GROUP BY status")
def status_counts(spark, folder):
    return ledger.status_counts(view(spark, folder, "attempts"))


@query("""SELECT count(*) FILTER (status IN ('received', 'dispatched', 'unknown')) AS calls, sum(CASE WHEN status = 'received' THEN actual_tokens ELSE 0 END)::BIGINT AS known_tokens, sum(CASE WHEN status IN ('reserved', 'dispatched', 'unknown') THEN reserved_tokens ELSE 0 END)::BIGINT AS held_tokens,
coalesce(sum(CASE WHEN status = 'received' THEN actual_cost END), 0.0) AS known_cost, coalesce(sum(CASE WHEN status IN ('reserved', 'dispatched', 'unknown') THEN reserved_cost END), 0.0) AS held_cost, count(*) FILTER ((status = 'received' AND actual_cost IS NULL) OR status IN ('dispatched', 'unknown')) AS open_costs, NULL::DOUBLE AS total_cost FROM attempts WHERE status <> 'imported'""")
def budget_totals(spark, folder):
    return ledger.budget_totals(view(spark, folder, "attempts"))


@query("""WITH r AS (SELECT user_id, created_at, sum(actual_tokens) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM attempts) SELECT user_id, min(created_at) AS created_at, arg_min(running, created_at) AS running FROM r WHERE running > 5000 GROUP BY user_id""")
def first_cap_breach(spark, folder):
    return ledger.first_breach(view(spark, folder, "attempts").select("user_id", "created_at", "actual_tokens"), 5000, "actual_tokens", "created_at", "user_id").select("user_id", "created_at", "running")


@query("""WITH r AS (SELECT created_at AS place, CASE WHEN status IN ('received', 'dispatched', 'unknown', 'reserved') THEN 1 ELSE 0 END AS calls, CASE WHEN status = 'received' THEN actual_tokens WHEN status IN ('reserved', 'dispatched', 'unknown') THEN reserved_tokens ELSE 0 END AS tokens,
  coalesce(CASE WHEN status = 'received' THEN actual_cost WHEN status IN ('reserved', 'dispatched', 'unknown') THEN reserved_cost END, 0) AS cost FROM attempts),
s AS (SELECT place, sum(calls) OVER w AS calls, sum(tokens) OVER w AS tokens, sum(cost) OVER w AS cost FROM r WINDOW w AS (ORDER BY place ROWS UNBOUNDED PRECEDING)), l AS (SELECT count(*) // 3 AS n FROM attempts)
SELECT 'calls' AS limit_name, min(place) AS place, CAST(min(calls) AS DOUBLE) AS running FROM s, l WHERE calls > n HAVING count(*) > 0
UNION ALL SELECT 'tokens', min(place), CAST(min(tokens) AS DOUBLE) FROM s, l WHERE tokens > 200 * n HAVING count(*) > 0 UNION ALL SELECT 'cost', min(place), min(cost) FROM s, l WHERE cost > 25 * n HAVING count(*) > 0""")
def run_cap_breach(spark, folder):
    """All attempts as those of one run, whose limits go with their number; the last of them is kept."""
    attempts = view(spark, folder, "attempts")
    n = attempts.count() // 3
    return running.run_breaches(attempts, "created_at", calls=n, tokens=200 * n, cost=25.0 * n)


@query("SELECT task_id, request_hash, count(*) AS attempts FROM attempts GROUP BY ALL HAVING count(*) >= 3")
def attempt_ceiling(spark, folder):
    return ledger.over_ceiling(view(spark, folder, "attempts"))


@query("""WITH f AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT s.user_id, s.event_id FROM events s LEFT JOIN f USING (user_id) WHERE s.event_type = 'view' AND (f.e IS NULL OR s.event_id > f.e)""")
def open_intervals(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return ledger.open_intervals(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), "user_id").drop("event_type")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_stage(spark, folder):
    return ledger.latest(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def event_tail(spark, folder):
    from concord.streaming import events

    return events.tail(table(spark, folder, "events").select("event_id", "user_id", "event_type"), 500)


RUN_EVENTS = """SELECT user_id AS run_id, event_id, CASE event_type WHEN 'signup' THEN 'INIT' WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'PREFLIGHT' WHEN 1 THEN 'SMOKE' ELSE 'BATCH' END
WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'INPUT_READY' WHEN 1 THEN 'HUMAN_GATE_SMOKE' ELSE 'FINAL_QC' END WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'PAUSED' ELSE 'HUMAN_GATE' END
ELSE CASE event_id % 20 WHEN 0 THEN 'FATAL_ERROR' WHEN 1 THEN 'DONE' WHEN 2 THEN 'ARCHIVE' WHEN 3 THEN 'RECOVERABLE_ERROR' ELSE 'INIT' END END AS state FROM events"""
#: Each run's changes one after another; a refused one leaves the state as it is.
RUN_FOLD = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS k FROM ({RUN_EVENTS})),
main AS (SELECT ['INIT', 'PREFLIGHT', 'INPUT_READY', 'SMOKE', 'HUMAN_GATE_SMOKE', 'BATCH', 'FINAL_QC', 'ARCHIVE', 'DONE'] AS m, ['PAUSED', 'RECOVERABLE_ERROR', 'HUMAN_GATE'] AS i),
f AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS asked, CAST(NULL AS VARCHAR) AS previous, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS back, true AS ok FROM s
UNION ALL SELECT run_id, k, event_id, asked, state, CASE WHEN ok THEN asked ELSE state END, CASE WHEN NOT ok THEN back WHEN NOT list_contains(i, asked) THEN NULL WHEN list_contains(i, state) THEN back ELSE state END, ok
FROM (SELECT f.run_id, s.k, s.event_id, s.state AS asked, f.state, f.back, m, i, CASE WHEN f.state IS NULL THEN s.state = 'INIT' WHEN list_contains(i, f.state) THEN list_contains(i, s.state) OR s.state = f.back WHEN f.state IN ('DONE', 'FATAL_ERROR') THEN false
  ELSE list_contains(i, s.state) OR s.state = 'FATAL_ERROR' OR coalesce(list_position(m, s.state) = list_position(m, f.state) + 1, false) END AS ok FROM f JOIN s ON s.run_id = f.run_id AND s.k = f.k + 1, main))"""


def run_events(spark, folder):
    return spark.sql(RUN_EVENTS.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))


@query(f"{RUN_FOLD} SELECT run_id, event_id, asked AS state, previous FROM f WHERE NOT ok")
def state_transition_violations(spark, folder):
    return run_state.refused(run_events(spark, folder))


@query(f"{RUN_FOLD} SELECT run_id, arg_max(state, k) AS state, arg_max(coalesce(back, '-'), k) AS resume_state, count(*) FILTER (NOT ok) AS refused FROM f GROUP BY run_id")
def run_standing(spark, folder):
    return run_state.standing(run_events(spark, folder)).withColumn("resume_state", F.coalesce("resume_state", F.lit("-")))


@query("""WITH r AS (SELECT attempt_id, min((told_at, event_id)) AS r FROM request_events WHERE kind = 'reserve' GROUP BY attempt_id),
d AS (SELECT e.attempt_id, arg_min(kind, (told_at, event_id)) AS kind, min((told_at, event_id)) AS d, min(told_at) AS dispatched_at FROM request_events e JOIN r USING (attempt_id) WHERE kind IN ('dispatch', 'reject', 'recover') AND (told_at, event_id) > r GROUP BY e.attempt_id),
x AS (SELECT d.attempt_id, d.dispatched_at, d.dispatched_at + INTERVAL 6 HOUR AS due_at, min(told_at) FILTER ((told_at, event_id) > d) AS answered_at FROM d LEFT JOIN request_events e ON e.attempt_id = d.attempt_id AND e.kind IN ('receive', 'fail', 'reject', 'recover') WHERE d.kind = 'dispatch' GROUP BY ALL)
SELECT attempt_id, strftime(dispatched_at, '%Y-%m-%d %H:%M:%S') AS dispatched_at, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS due_at, answered_at IS NULL AS unanswered FROM x WHERE (answered_at IS NULL OR answered_at > due_at) AND due_at < (SELECT max(told_at) FROM request_events)""")
def overdue_attempts(spark, folder):
    late = run_state.overdue(view(spark, folder, "request_events"), "6 hours")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return late.select("attempt_id", shown("dispatched_at"), shown("due_at"), F.col("answered_at").isNull().alias("unanswered"))


@query("SELECT request_hash, min(created_at) AS created_at FROM attempts WHERE status = 'received' GROUP BY request_hash")
def first_response_per_hash(spark, folder):
    return ledger.first_responses(view(spark, folder, "attempts").select("request_hash", "status", "created_at", "attempt_id")).select("request_hash", "created_at")


@query("SELECT base_url, model, min(price) AS price FROM (SELECT concat('https://h', s_nationkey) AS base_url, concat('m', s_suppkey % 7) AS model, s_acctbal AS price FROM supplier) GROUP BY ALL HAVING count(*) = 1")
def quote_match_unique(spark, folder):
    quotes = table(spark, folder, "supplier").select(F.concat(F.lit("https://h"), F.col("s_nationkey").cast("string")).alias("base_url"), F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string")).alias("model"), F.col("s_acctbal").alias("price"))
    return ledger.unique_quotes(quotes, quotes.select("base_url", "model").distinct())


@query("SELECT status, task_id, count(*) AS n FROM (SELECT task_id, CASE status WHEN 'dispatched' THEN 'unknown' WHEN 'reserved' THEN 'rejected' ELSE status END AS status FROM attempts) GROUP BY ALL")
def crash_recovery(spark, folder):
    return ledger.recovered(view(spark, folder, "attempts")).groupBy("status", "task_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT task_id, request_hash FROM attempts WHERE status IN ('reserved', 'dispatched')")
def live_requests(spark, folder):
    return ledger.live(view(spark, folder, "attempts"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'unknown' WHEN event_id % 5 = 0 THEN 'retry' WHEN event_id % 5 = 1 THEN 'stop' ELSE 'unknown' END AS class FROM events")
def retry_classes(spark, folder):
    code = F.when(F.col("event_id") % 5 == 0, 429).when(F.col("event_id") % 5 == 1, 401).otherwise(500)
    status = F.when(F.col("event_type") == "error", "rejected").otherwise("received")
    return table(spark, folder, "events").select("event_id", ledger.retry_class(status, code).alias("class"))


@query("SELECT user_id, event_id, value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS value_delta FROM events")
def budget_deltas(spark, folder):
    return ledger.deltas(table(spark, folder, "events").select("user_id", "event_id", "value"), "value", order="event_id", by="user_id").select("user_id", "event_id", "value_delta")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes, concat('p', left(sha256(text), 32)) AS paper_uid FROM documents")
def document_digests(spark, folder):
    digest = F.sha2("text", 256)
    return table(spark, folder, "documents").select("doc_id", digest.alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.concat(F.lit("p"), F.left(digest, F.lit(32))).alias("paper_uid"))


@query("SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn)::VARCHAR IS NOT NULL AS told, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def message_arrays(spark, folder):
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.col("m").isNotNull().alias("told"), F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


#: Texts as they are, and with a secret of each form behind them.
SECRET_FORMS = ["", " https://ghp_tok@host/x", " access_token=abc123, then", " client_secret: xyz; and", " secret_key = q1 total_tokens: 7", " /x?refresh_token=abc&key=k1#end Key: temperature", ' Authorization: BEARER "no" bearer ab.c"d', " https://u:p@host/?api-key=1&Password=2"]


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') || ['', ' https://ghp_tok@host/x', ' access_token=abc123, then', ' client_secret: xyz; and', ' secret_key = q1 total_tokens: 7', ' /x?refresh_token=abc&key=k1#end Key: temperature', ' Authorization: BEARER "no" bearer ab.c"d', ' https://u:p@host/?api-key=1&Password=2'][1 + doc_id % 8] AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(https?://)[^/\s@]+@', '\1[REDACTED]@', 'g'), '(bearer\s+)[^\s"'']+', '\1[REDACTED]', 'gi') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([?&](?:access[-_]?token|api[-_]?key|client[-_]?secret|key|password|refresh[-_]?token|secret|secret[-_]?key|token)=)[^&#\s]+', '\1[REDACTED]', 'gi'), '((?:access[-_]?token|api[-_]?key|client[-_]?secret|password|refresh[-_]?token|secret|secret[-_]?key)\s*[:=]\s*)[^\s,;]+', '\1[REDACTED]', 'gi') AS t FROM a)
SELECT doc_id, md5(t) AS digest, contains(t, '[REDACTED]') AS redacted FROM b""")
def redaction(spark, folder):
    form = F.get(F.array(*map(F.lit, SECRET_FORMS)), (F.col("doc_id") % len(SECRET_FORMS)).cast("int"))
    told = table(spark, folder, "documents").select("doc_id", secrets.redact(F.concat(F.coalesce("text", F.lit("")), form)).alias("t"))
    return told.select("doc_id", F.md5("t").alias("digest"), F.contains("t", F.lit("[REDACTED]")).alias("redacted"))


@query()
def fingerprint_ids(spark, folder):
    rows = candidates(spark, folder)
    return rows.select("seq", ids.candidate_id(rows).alias("candidate_id"))


@query("SELECT event_type, count(DISTINCT event_id % 997) AS n FROM events GROUP BY event_type")
def event_stream_dedup(spark, folder):
    """The batch twin of the stream's first row of each key; tests run the stream itself."""
    rows = table(spark, folder, "events").select("event_type", (F.col("event_id") % 997).alias("k"))
    return rows.dropDuplicates(["event_type", "k"]).groupBy("event_type").agg(F.count("*").alias("n"))


# --- lifecycle and scope -----------------------------------------------------------------------------------------

SQL_STEP = """CASE WHEN b['state'] = 'reserve' AND a['state'] = 'none' THEN 'reserved' WHEN b['state'] = 'dispatch' AND a['state'] = 'reserved' THEN 'dispatched' WHEN b['state'] = 'receive' AND a['state'] IN ('dispatched', 'unknown') THEN 'received'
WHEN b['state'] = 'reject' AND a['state'] IN ('reserved', 'dispatched') THEN 'rejected' WHEN b['state'] = 'fail' AND a['state'] = 'dispatched' THEN 'unknown' WHEN b['state'] = 'recover' AND a['state'] = 'reserved' THEN 'rejected'
WHEN b['state'] = 'recover' AND a['state'] = 'dispatched' THEN 'unknown' WHEN b['state'] = 'release' AND a['state'] = 'unknown' THEN 'rejected' WHEN b['state'] = 'hold' AND a['state'] = 'unknown' THEN 'unknown' END"""


@query(f"""WITH l AS (SELECT attempt_id, list_prepend({{'state': 'none', 'refused': 0::BIGINT}}, list({{'state': kind, 'refused': 0::BIGINT}} ORDER BY event_id)) AS steps FROM request_events GROUP BY attempt_id),
e AS (SELECT attempt_id, list_reduce(steps, lambda a, b: {{'state': coalesce({SQL_STEP}, a['state']), 'refused': a['refused'] + CASE WHEN ({SQL_STEP}) IS NULL THEN 1 ELSE 0 END}}) AS last FROM l) SELECT attempt_id, last['state'] AS state, last['refused'] AS refused FROM e""")
def attempt_states(spark, folder):
    return lifecycle.states(view(spark, folder, "request_events"))


@query("""WITH u AS (SELECT task_id, request_hash, count(*) FILTER (status IN ('reserved', 'dispatched', 'unknown', 'received', 'imported')) AS live, count(*) AS n FROM attempts GROUP BY ALL), a AS (SELECT event_id, concat('t', user_id % 41) AS task_id, concat('h', event_id % 991) AS request_hash FROM events)
SELECT event_id, CASE WHEN live > 0 THEN 'live' WHEN n >= 3 THEN 'ceiling' ELSE 'free' END AS verdict FROM a LEFT JOIN u USING (task_id, request_hash)""")
def request_admission(spark, folder):
    named = lambda sign, c, n: F.concat(F.lit(sign), (F.col(c) % n).cast("string"))
    asked = table(spark, folder, "events").select("event_id", named("t", "user_id", 41).alias("task_id"), named("h", "event_id", 991).alias("request_hash"))
    return lifecycle.admitted(asked, view(spark, folder, "attempts")).select("event_id", "verdict")


@query("SELECT attempt_id, actual_tokens - reserved_tokens AS more_tokens FROM attempts WHERE status = 'received' AND (actual_tokens > reserved_tokens OR actual_cost > reserved_cost)")
def reservation_overshoots(spark, folder):
    return lifecycle.overshoots(view(spark, folder, "attempts")).select("attempt_id", (F.col("actual_tokens") - F.col("reserved_tokens")).alias("more_tokens"))


@query("SELECT paper_index, count(*) AS n FROM candidates WHERE round_index IN (1, 3) AND paper_index IN (SELECT concat('p', s_suppkey) FROM supplier) GROUP BY paper_index")
def scoped_candidates(spark, folder):
    papers = table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("paper_index"))
    return scope.of_rounds(scope.of_papers(candidates(spark, folder), papers), [1, 3]).groupBy("paper_index").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT concat('c', user_id % 9) AS context, max(event_id) AS b FROM events WHERE event_type = 'signup' AND event_id < 500 GROUP BY ALL), t AS (SELECT DISTINCT concat('t', user_id % 40) AS task_id, concat('c', user_id % 40 % 7) AS context FROM events),
x AS (SELECT t.context, event_id FROM events JOIN t ON t.task_id = concat('t', user_id % 40) WHERE event_type = 'click') SELECT s.context, count(x.event_id) AS n FROM s LEFT JOIN x ON x.context = s.context AND x.event_id >= s.b GROUP BY s.context""")
def context_cache_use(spark, folder):
    named = lambda sign, c: F.concat(F.lit(sign), c.cast("string"))
    rows = table(spark, folder, "events").select("event_id", "event_type", "user_id", named("t", F.col("user_id") % 40).alias("task_id"))
    tasks = rows.select("task_id", named("c", F.col("user_id") % 40 % 7).alias("context"))
    starts = rows.filter("event_type = 'signup' and event_id < 500").select(named("c", F.col("user_id") % 9).alias("context"), "event_id")
    return scope.used_in_context(rows.filter("event_type = 'click'"), tasks, starts)


@query("SELECT concat('model', s_nationkey) AS shown, count(*) AS n FROM supplier GROUP BY ALL HAVING count(*) > 1")
def display_name_collisions(spark, folder):
    models = table(spark, folder, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Model").otherwise("model"), F.col("s_nationkey").cast("string")).alias("model"))
    return scope.display_collisions(models)


# --- ledger log and frozen inputs --------------------------------------------------------------------------------


@query("""WITH ends AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END, event_id) AS status FROM events WHERE user_id % 3 <> 0 GROUP BY user_id),
refused AS (SELECT concat('t', cast(user_id AS VARCHAR)) AS task_id, 'another identity' AS refused FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 0) UNION ALL SELECT concat('x', cast(user_id AS VARCHAR)), 'unknown task' FROM ends WHERE user_id % 7 = 0)
SELECT coalesce(p.task_id, r.task_id) AS task_id, p.stage, p.status, r.refused FROM (SELECT DISTINCT concat('t', cast(e.user_id AS VARCHAR)) AS task_id, 'examiner' AS stage, coalesce(n.status, 'planned') AS status FROM events e LEFT JOIN ends n USING (user_id)) p FULL JOIN refused r ON p.task_id = r.task_id""")
def ledger_log_tasks(spark, folder):
    """Users as tasks in a shared log: planned, partly planned again under another stage, ended; states and refusals are read back."""
    events, path = table(spark, folder, "events"), shared.new_path(spark, "ledger-log")
    name = F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id")
    users = events.select("user_id").distinct()
    ledger_log.put_tasks(users.select(name, F.lit("examiner").alias("stage"), F.lit("{}").alias("payload")), path)
    ledger_log.put_tasks(users.filter("user_id % 5 = 0").select(name, F.lit("cross").alias("stage"), F.lit("{}").alias("payload")), path)
    status = F.max_by(F.when(F.col("event_type") == "error", "failed").otherwise("succeeded"), "event_id")
    ends = events.filter("user_id % 3 <> 0").groupBy("user_id").agg(status.alias("status")).withColumns({"artifacts": F.lit("[]"), "error": F.lit(None).cast("string")})
    strangers = ends.filter("user_id % 7 = 0").select(F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("task_id"), "status", "artifacts", "error")
    ledger_log.finish_tasks(ends.select(name, "status", "artifacts", "error").unionByName(strangers), path)
    log = ledger_log.read(spark, path)
    refused = ledger_log.refusals(log).select(F.col("key").alias("task_id"), F.col("reason").alias("refused"))
    return ledger_log.tasks(log).select("task_id", "stage", "status").join(refused, "task_id", "full_outer")


SQL_FILES = "files AS (SELECT concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', cast(doc_id AS VARCHAR)) AS path, sha256(text) AS sha256, doc_id FROM documents)"


def _files(spark, folder) -> DataFrame:
    """Documents as files below their source and language."""
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return table(spark, folder, "documents").select(F.concat_ws("/", none("source"), none("lang"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")


@query(f"""WITH {SQL_FILES}, above AS (SELECT '' AS folder, * FROM files UNION ALL SELECT string_split(path, '/')[1], * FROM files UNION ALL SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], * FROM files),
parts AS (SELECT folder, left(sha256(path), 3) AS part, count(*) AS n, sha256(string_agg(sha256(path) || ':' || coalesce(sha256, '') || chr(10), '' ORDER BY sha256(path), sha256)) AS digest FROM above GROUP BY ALL)
SELECT folder, sum(n)::BIGINT AS n_files, sha256(string_agg(part || ':' || digest || chr(10), '' ORDER BY part)) AS digest FROM parts GROUP BY folder""")
def folder_digests(spark, folder):
    return snapshot.folders(snapshot.parts(_files(spark, folder)))


@query(f"""WITH {SQL_FILES}, now AS (SELECT path, CASE WHEN doc_id % 89 = 3 THEN 'other' ELSE sha256 END AS sha256 FROM files WHERE doc_id % 97 <> 5 UNION ALL SELECT 'new/' || path, sha256 FROM files WHERE doc_id % 101 = 7)
SELECT coalesce(f.path, n.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM files f FULL JOIN now n ON f.path = n.path WHERE f.path IS NULL OR n.path IS NULL OR f.sha256 IS DISTINCT FROM n.sha256""")
def snapshot_difference(spark, folder):
    """All documents as a frozen tree against a state in which some are gone, some differ and some are new."""
    files = _files(spark, folder)
    now = files.filter("doc_id % 97 <> 5").withColumn("sha256", F.when(F.col("doc_id") % 89 == 3, "other").otherwise(F.col("sha256")))
    new = files.filter("doc_id % 101 = 7").withColumn("path", F.concat(F.lit("new/"), "path"))
    return snapshot.difference(files.select("path", "sha256"), now.unionByName(new).select("path", "sha256"))


@query("""WITH done AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0)
SELECT 'missing_task' AS check, cast(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0
UNION ALL SELECT 'unproven_task', cast(doc_id AS VARCHAR) FROM done WHERE doc_id % 17 = 0
UNION ALL SELECT 'changed_artifact', cast(doc_id AS VARCHAR) FROM documents WHERE doc_id % 17 <> 0 AND ((doc_id % 19 = 0 AND text IS NOT NULL) OR coalesce(strlen(text), 0) = 0)
UNION ALL SELECT 'missing_stage', 'ensemble'""")
def final_check(spark, folder):
    """A document's answer as a task with a receipt for its text; some failed, some have no receipt, some texts were changed."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("task_id"), "text")
    tasks = docs.filter("doc_id % 11 <> 0").select("task_id", F.lit("composite").alias("stage"), F.when(F.col("doc_id") % 13 == 0, "failed").otherwise("succeeded").alias("status"))
    receipts = docs.filter("doc_id % 17 <> 0").select("task_id", F.col("task_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    now = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    files = docs.select(F.col("task_id").alias("path"), F.sha2(now, 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    return snapshot.final_check(docs, tasks, receipts, files, ("composite", "ensemble"))

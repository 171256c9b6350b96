"""From tasks and replies to a composite of candidates: grids, validation, coverage and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.functions import ids, text, vocab
from concord.functions.columns import computed

#: Models, questions or rounds of a study at most.
LISTED = 10_000
TASK = ("paper_index", "question_index", "model", "round_index")
COMPOSITE = ("paper_index", "question_index", "round_index", "model", "item", "value", "evidence", "confidence_lv", "request_fingerprint", "paper_fingerprint", "candidate_id")


def task_grid(papers: DataFrame, models: DataFrame, questions: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """Every paper, model and question (and round): the dimensions are lists of a study, and the grid is its plan of work.

    Models, questions and rounds are a study's settings, so a list of more than LISTED is an error.
    """
    for listed in (models, questions) if rounds is None else (models, questions, rounds):
        if listed.limit(LISTED + 1).count() > LISTED:
            raise ValueError(f"a grid takes at most {LISTED} models, questions and rounds each")
        papers = papers.crossJoin(F.broadcast(listed))
    return papers


def with_task_id(grid: DataFrame) -> DataFrame:
    fields = [F.col(c).cast("string").alias(c) for c in sorted(c for c in grid.columns if c in TASK)]
    return grid.withColumn("task_id", ids.json_digest(F.struct(*fields)))


def missing(expected: DataFrame, found: DataFrame, keys: tuple[str, ...] = TASK) -> DataFrame:
    """Expected keys that nothing has."""
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def unexpected(expected: DataFrame, found: DataFrame, keys: tuple[str, ...] = TASK) -> DataFrame:
    """Rows whose key nobody expects."""
    return found.join(expected.select(*keys).distinct(), list(keys), "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, each as often as it has it more; none if both hold the same."""
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def violations(df: DataFrame, kind: str | None = None, items: list[str] | None = None, allowed: list[str] | None = None, require_unit: bool = False, require_experimental: bool = False) -> DataFrame:
    """Answers that break a rule, with the first rule that each breaks; none means that the answers are valid."""
    lower = lambda c: F.lower(text.strip(F.col(c).cast("string")))
    confidence = F.col("confidence_lv").cast("string").try_cast("double")
    present = ~text.is_missing("value", vocab.MISSING_ANSWER)
    number = F.col("value").cast("string").try_cast("double")
    rules: list[tuple[str, Column]] = [
        ("item", F.col("item").isNull() | text.strip(F.col("item").cast("string")).isin(*vocab.BAD_ITEMS)),
        ("confidence", confidence.isNull() | F.isnan(confidence) | (confidence < -1) | (confidence > 100)),
        ("scalar", F.coalesce(text.strip(F.col("value").cast("string")).rlike(r"(?s)^[\[{].*[\]}]$"), F.lit(False)) & (lower("value") != "[]")),
    ]
    if kind == "numeric":
        rules.append(("finite", F.coalesce(lower("value").isin("true", "false") | F.isnan(number) & ~lower("value").isin("nan") | (F.abs(number) == float("inf")), F.lit(False))))
    if items:
        rules.append(("unexpected_item", ~F.col("item").isin(*items)))
    if allowed:
        rules.append(("not_allowed", present & ~lower("value").isin(*[str(x).strip().lower() for x in allowed])))
    if require_unit:
        rules.append(("no_unit", present & (text.is_missing("unit", vocab.MISSING_ANSWER) if "unit" in df.columns else F.lit(True))))
    if require_experimental:
        rules.append(("no_experimental", present & (text.is_missing("experimental", vocab.MISSING_ANSWER) if "experimental" in df.columns else F.lit(True))))
    rule = F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules])
    return computed(df, rule=rule).filter("rule is not null")


def must_be_empty(rows: DataFrame, what: str, shown: int = 5) -> None:
    """Raises if there is any row; at most `shown` of them come to the driver."""
    found = rows.take(shown)
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))


def require_columns(df: DataFrame, columns: tuple[str, ...] = COMPOSITE) -> DataFrame:
    gone = sorted(set(columns) - set(df.columns))
    if gone:
        raise ValueError(f"missing columns: {gone}")
    return df


def compose(expected: DataFrame, answers: DataFrame, salvaged: DataFrame | None = None) -> DataFrame:
    """The answers of expected tasks, those salvaged from kept replies where a task has none, one row a candidate_id.

    Rows of one candidate_id agree in all fields of their identity; the least by the others stays.
    """
    rows = answers.join(expected.select(*TASK).distinct(), list(TASK), "left_semi")
    if salvaged is not None:
        more = salvaged.join(expected.select(*TASK).distinct(), list(TASK), "left_semi").join(rows.select(*TASK).distinct(), list(TASK), "left_anti")
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumn("candidate_id", ids.candidate_id(rows))
    return first_of(rows, "candidate_id")


def first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the least of its rows as a whole, whatever their order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(rows.columns)


def duplicates(papers: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have."""
    return papers.groupBy(key).count().filter("count > 1")


def incremental(todo: DataFrame, done: DataFrame, *fingerprints: str) -> DataFrame:
    """Work whose fingerprints no earlier output has."""
    return todo.join(done.select(*fingerprints).distinct(), list(fingerprints), "left_anti")


def prefixed_without(df: DataFrame, *prefixes: str) -> DataFrame:
    """df without columns derived by an earlier pass, so that a pass can be repeated."""
    return df.select([c for c in df.columns if not any(c.startswith(p) for p in prefixes)])


def questions(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Question rules as rows, numbered from 1; ids must be unique and kinds known."""
    seen = [r["id"] for r in rules]
    if len(seen) != len(set(seen)):
        raise ValueError("question ids must be unique")
    if bad := [r["id"] for r in rules if r.get("kind", "text") not in ("text", "numeric")]:
        raise ValueError(f"unknown kind of question: {bad}")
    schema = "question_index int, id string, prompt string, kind string, items array<string>, allowed_values array<string>, require_unit boolean, require_experimental boolean, emission_type string"
    rows = [(k, r["id"], r.get("prompt", ""), r.get("kind", "text"), list(r.get("items", [])), [str(x) for x in r.get("allowed_values", [])], bool(r.get("require_unit")), bool(r.get("require_experimental")), r.get("emission_type")) for k, r in enumerate(rules, 1)]
    return spark.createDataFrame(rows, schema)

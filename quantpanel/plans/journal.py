"""Analytics over ledgers and the journal of all runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantpanel.operators.panel import fingerprint

MAX_WINS, MAX_LOSSES = 10, 15
#: Credential shapes, in this order; with three groups the first two stay.
SECRETS = [
    (r"\bsk-(?:ant-)?[A-Za-z0-9_\-]{12,}", "<redacted>"),
    (r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{12,}", "<redacted>"),
    (r"\bxox[abprs]-[A-Za-z0-9-]{12,}", "<redacted>"),
    (r"\bAKIA[0-9A-Z]{12,}", "<redacted>"),
    (r"\bey[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", "<redacted>"),
    (r"(?i)\b(bearer)(\s+)([A-Za-z0-9._\-]{8,})", "$1$2<redacted>"),
    (r"(?i)\b(api[_-]?key|apikey|access[_-]?token|auth[_-]?token|token|secret|password|passwd|authorization)(\"?\s*[:=]\s*\"?)((?!bearer\b)[^\s\"',]+)", "$1$2<redacted>"),
]


def merge_ledgers(old: DataFrame, new: DataFrame, sequence: str | None = None) -> DataFrame:
    """By research date the newest row wins; rows without a date all stay.

    Newer is: in `new`; then, within one ledger, the larger `sequence` (the order in which rows were written). Rows that
    are equal in that too, or all where there is no such column, are told apart by their other columns, so the result
    doesn't depend on how they are dealt.
    """
    both = old.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1)))
    dated = both.where(F.col("research_date").isNotNull())
    rest = [F.to_json(F.struct(*(F.col(f"`{c}`") for c in old.columns))).desc()]
    last = F.row_number().over(Window.partitionBy("research_date").orderBy(F.col("load").desc(), *([F.col(sequence).desc_nulls_last()] if sequence else []), *rest))
    return dated.withColumn("n", last).where("n = 1").drop("n").unionByName(both.where(F.col("research_date").isNull())).drop("load")


def archive(entries: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Entries (run_id, note, first_archived, last_archived) after `runs` (run_id) were archived: note and first time stay."""
    marked = runs.select("run_id", F.lit(now).alias("stamp"))
    joined = entries.join(marked, "run_id", "full_outer")
    return joined.select("run_id", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("first_archived", "stamp").alias("first_archived"), F.coalesce("stamp", "last_archived").alias("last_archived"))


def run_ids(settings: DataFrame, ignored: Sequence[str], version: Column) -> DataFrame:
    """(run, run_id) from (run, key, value): a hash of the settings that mean something and the data version."""
    meant = settings.where(~F.col("key").isin(list(ignored)))
    return meant.groupBy("run").agg(F.sha2(F.concat(F.to_json(F.sort_array(F.collect_list(F.struct("key", "value")))), F.max(version)), 256).alias("run_id"))


def config_conflicts(left: DataFrame, right: DataFrame, ignored: Sequence[str]) -> DataFrame:
    """(key, left_value, right_value) that differ between two runs' (key, value)."""
    a, b = left.select("key", F.col("value").alias("left_value")), right.select("key", F.col("value").alias("right_value"))
    return a.join(b, "key", "full_outer").where(~F.col("key").isin(list(ignored)) & ~F.col("left_value").eqNullSafe(F.col("right_value")))


def reason_class(reason: Column) -> Column:
    return F.regexp_replace(reason, r"-?\d+(?:\.\d+)?", "#")


def evidence_context(columns: Sequence[str]) -> Column:
    """What makes two results comparable, as one hash."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def lessons(ledger: DataFrame) -> DataFrame:
    """One row an expression and context: repeats, the latest occurrence, when the last one closed (unknown if one is), failure modes."""
    known = ledger.where(F.col("label").isin("PASS", "FAIL"))
    order = F.struct("research_date", "run_id")
    modes = F.flatten(F.collect_set(F.when(F.col("label") == "FAIL", F.transform("reasons", reason_class))))
    return known.groupBy("expression_hash", "context", (F.col("label") == "PASS").alias("won")).agg(
        F.count(F.lit(1)).alias("n_seen"), F.max_by("candidate_id", order).alias("formula"), F.max_by("oos_value", order).alias("oos_value"), F.max("research_date").alias("research_date"), F.max_by("run_id", order).alias("run_id"),
        F.when(F.count("oos_end") == F.count(F.lit(1)), F.max("oos_end")).alias("oos_end"), F.sort_array(F.array_distinct(modes)).alias("modes"),
    )


def top_wins(table: DataFrame, most: int = MAX_WINS) -> DataFrame:
    return table.where("won").orderBy(F.col("research_date").desc(), F.col("formula").desc()).limit(most)


def top_losses(table: DataFrame, most: int = MAX_LOSSES) -> DataFrame:
    return table.where("NOT won").orderBy(F.col("n_seen").desc(), "formula").limit(most)


def as_of(table: DataFrame, date: Column | str) -> DataFrame:
    """Lessons that were closed by the date; an unknown close date never is."""
    return table.where(F.col("oos_end") <= F.lit(date).cast("date"))


LESSON = ("expression_hash", "context", "won")


def lesson_history(ledger: DataFrame) -> DataFrame:
    """Each lesson as it stood from one day to the next: (LESSON, known_from, known_to, n_seen, formula, oos_value).

    A result is known from the day on which its window has closed, one without such a day never. The states of a lesson are
    a running window over its results in that order; of those of one day the last holds. So what any number of dates may
    know is a lookup by interval, and no date is joined with all results before it.
    """
    known = ledger.where(F.col("label").isin("PASS", "FAIL") & F.col("oos_end").isNotNull()).withColumn("won", F.col("label") == "PASS")
    whole = Window.partitionBy(*LESSON)
    order = whole.orderBy("oos_end", "research_date", "run_id")
    newest = F.max_by(F.struct("candidate_id", "oos_value"), F.struct("research_date", "run_id")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    states = known.select(*LESSON, F.col("oos_end").alias("known_from"), F.row_number().over(order).alias("n_seen"), newest.alias("newest"), F.lead("oos_end").over(order).alias("known_to"))
    return states.where(~F.col("known_from").eqNullSafe(F.col("known_to"))).select(*LESSON, "known_from", "known_to", "n_seen", F.col("newest.candidate_id").alias("formula"), F.col("newest.oos_value").alias("oos_value"))


def known_lessons(history: DataFrame, date: Column | str) -> DataFrame:
    """The lessons of lesson_history as they stood on the date; known_to itself belongs to the next state."""
    at = F.lit(date).cast("date")
    return history.where((F.col("known_from") <= at) & (F.col("known_to").isNull() | (F.col("known_to") > at)))


def failure_modes(ledger: DataFrame) -> DataFrame:
    exploded = ledger.where("label = 'FAIL'").select(F.explode("reasons").alias("reason")).select(reason_class(F.col("reason")).alias("mode"))
    return exploded.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def operator_usage(ledger: DataFrame) -> DataFrame:
    """(op, won, lost): in how many winning and losing formulas an operator stands."""
    ops = ledger.select("label", F.explode(F.array_distinct("ops")).alias("op"))
    return ops.groupBy("op").agg(F.count_if(F.col("label") == "PASS").alias("won"), F.count_if(F.col("label") != "PASS").alias("lost"))


def header(ledger: DataFrame) -> DataFrame:
    """Runs, rows, passes, rate and span."""
    n = F.count(F.lit(1))
    passed = F.count_if(F.col("label") == "PASS")
    return ledger.agg(F.count_distinct("run_id").alias("n_runs"), n.alias("n_factors"), passed.alias("n_passed"), F.try_divide(passed.cast("double"), n).alias("pass_rate"), F.min("research_date").alias("first_date"), F.max("research_date").alias("last_date"))


def run_listing(ledger: DataFrame) -> DataFrame:
    return ledger.select("run_id", "research_date", "candidate_id", "label", "is_value", "oos_value").orderBy("run_id", "research_date")


def clipped(text: Column, width: int = 80) -> Column:
    """One line of at most `width` characters, with ... where something is missing, fit for a cell of a table."""
    flat = F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(width - 3))), F.lit("...")))


def shown(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.format_string("%.4f", value))


def run_tables(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The tables of all runs: one row a result, (run_id, place, research_date, verdict, is_shown, oos_shown, formula, mechanism).

    place counts a run's results from 1 in the order of their dates. A run of `entries` without results has no row here.
    """
    order = Window.partitionBy("run_id").orderBy("research_date", "candidate_id")
    rows = ledger.join(entries.select("run_id"), "run_id", "left_semi")
    return rows.select("run_id", F.row_number().over(order).alias("place"), "research_date", F.coalesce("label", F.lit("?")).alias("verdict"), shown(F.col("is_value")).alias("is_shown"), shown(F.col("oos_value")).alias("oos_shown"), F.col("candidate_id").alias("formula"), clipped(F.col("mechanism")).alias("mechanism"))


def run_heads(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """What stands above each run's table: (run_id, note, archived, objective, result), runs without results too."""
    counts = run_counts(ledger).join(ledger.groupBy("run_id").agg(F.max("objective").alias("objective")), "run_id")
    archived = F.when(F.col("first_archived").eqNullSafe(F.col("last_archived")), F.coalesce("first_archived", F.lit("?"))).otherwise(F.concat(F.coalesce("first_archived", F.lit("?")), F.lit(" (refreshed "), F.coalesce("last_archived", F.lit("?")), F.lit(")")))
    result = F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" factor(s), "), F.coalesce("passed", F.lit(0)).cast("string"), F.lit(" PASS"))
    return entries.join(counts, "run_id", "left").select("run_id", F.trim(F.regexp_replace(F.coalesce("note", F.lit("")), r"\s+", " ")).alias("note"), archived.alias("archived"), F.coalesce("objective", F.lit("?")).alias("objective"), result.alias("result"))


def run_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "PASS").alias("passed"), F.count_if(F.col("label") == "FAIL").alias("failed"), F.count_if(F.col("label") == "NUMERICAL_REJECT").alias("rejected"))


def corpus_fingerprint(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fingerprint(ledger, columns)


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select(F.col("version").alias("old")).crossJoin(new.select(F.col("version").alias("new"))).select((F.col("old") != F.col("new")).alias("stale"))  # one row each


def differences(left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "research_date") -> DataFrame:
    """(key, column names that differ) between two result sets; NaN equals NaN."""
    a, b = left.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("in_a")), right.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("in_b"))
    joined = a.join(b, key, "full_outer")
    missing = F.when(F.col("in_a").isNull(), "missing left").when(F.col("in_b").isNull(), "missing right")
    unequal = F.array_compact(F.array(missing, *(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns)))
    return joined.select(key, unequal.alias("unequal")).where(F.size("unequal") > 0)


def usage_totals(usage: DataFrame) -> DataFrame:
    """Token counts by run under either of their names; null where none was reported."""
    spent = usage.withColumns({"input": F.coalesce("input_tokens", "prompt_tokens"), "output": F.coalesce("output_tokens", "completion_tokens")})
    return spent.groupBy("run_id").agg(F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"))


def redact(text: Column, live: Sequence[str] = (), home: str | None = None) -> Column:
    """Credential shapes masked; `live` are exact secret values to mask first, `home` a folder that becomes ~."""
    for value in live:
        text = F.replace(text, F.lit(value), F.lit("<redacted>"))
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    if home and len(home) >= 4:  # a shorter one stands in every path
        for spelling in dict.fromkeys((home, home.replace("\\", "/"))):
            text = F.regexp_replace(text, "(?i)" + re.sub(r"([^A-Za-z0-9])", r"\\\1", spelling), "~")
    return text


def redacted(value: Column, kind: T.DataType, **options) -> Column:
    """A value of any type with all strings in it redacted, but for the keys of maps."""
    if isinstance(kind, T.StringType):
        return redact(value, **options)
    if isinstance(kind, T.ArrayType) and has_text(kind.elementType):
        return F.transform(value, lambda v: redacted(v, kind.elementType, **options))
    if isinstance(kind, T.MapType) and has_text(kind.valueType):
        return F.transform_values(value, lambda _, v: redacted(v, kind.valueType, **options))
    if isinstance(kind, T.StructType) and has_text(kind):
        return F.when(value.isNotNull(), F.struct(*(redacted(value.getField(f.name), f.dataType, **options).alias(f.name) for f in kind)))
    return value


def has_text(kind: T.DataType) -> bool:
    inner = {T.ArrayType: ("elementType",), T.MapType: ("valueType",)}.get(type(kind), ())
    below = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [getattr(kind, n) for n in inner]
    return isinstance(kind, T.StringType) or any(map(has_text, below))


def redact_all(df: DataFrame, **options) -> DataFrame:
    """Every string of every column redacted, however deep it stands in structs, arrays and maps."""
    made = {f.name: redacted(F.col(f"`{f.name}`"), f.dataType, **options) for f in df.schema if has_text(f.dataType)}
    return df.withColumns(made) if made else df

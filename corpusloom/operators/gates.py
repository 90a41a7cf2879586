"""Data-quality gates as plans: each returns the problems it finds, none if the data may pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WAITING, PASS, FAIL = "WAITING", "PASS", "FAIL"


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold, in order; one that is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def verdict(n_inputs: Column, n_problems: Column) -> Column:
    """WAITING without inputs, else PASS or FAIL."""
    return F.when(F.coalesce(n_inputs, F.lit(0)) == 0, WAITING).when(n_problems > 0, FAIL).otherwise(PASS)


def first_errors(rows: DataFrame, split: str, line: str, checks: dict[str, Column]) -> DataFrame:
    """split, line, problem: the first row of each split that fails a check, and the first check it fails."""
    bad = rows.select(split, line, F.get(problems(checks), F.lit(0)).alias("problem")).filter("problem is not null")
    return bad.groupBy(split).agg(F.min(F.struct(line, "problem")).alias("m")).select(split, f"m.{line}", "m.problem")


def manifest_problems(listed: DataFrame, found: DataFrame, key: str = "path", values=("bytes", "sha256")) -> DataFrame:
    """key, problem: listed twice, missing, unlisted, or another value than listed. null values are equal."""
    n = listed.groupBy(key).agg(F.count("*").alias("_n"), *(F.min(v).alias(v) for v in values))
    there = found.select(key, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    x = n.join(there, key, "full_outer")
    both = F.col("_n").isNotNull() & F.col("_there").isNotNull()
    faults = F.array_compact(
        F.array(
            F.when(F.col("_n") > 1, "listed_twice"),
            F.when(F.col("_there").isNull(), "missing"),
            F.when(F.col("_n").isNull(), "unlisted"),
            *(F.when(both & ~F.col(v).eqNullSafe(F.col(f"_{v}")), f"{v}_differs") for v in values),
        )
    )
    return x.select(key, F.explode(faults).alias("problem"))


def exclusion_problems(policy: DataFrame, rows: DataFrame, limit: int, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """key, problem: a policy (key, tokens) must exclude just the rows of more than `limit` tokens, each with its count."""
    listed = policy.groupBy(key).agg(F.count("*").alias("_n"), F.min(tokens).alias("_said"))
    x = rows.select(key, F.col(tokens).alias("_is")).join(listed, key, "full_outer")
    fault = (
        F.when(F.col("_n") > 1, "excluded_twice")
        .when(F.col("_is").isNull(), "unknown_row")
        .when(F.col("_n").isNull() & (F.col("_is") > limit), "not_excluded")
        .when(F.col("_n").isNotNull() & (F.col("_is") <= limit), "within_limit")
        .when(F.col("_n").isNotNull() & ~F.col("_said").eqNullSafe(F.col("_is")), "count_differs")
    )
    return x.select(key, fault.alias("problem")).filter("problem is not null")


def nested_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """outer, inner: paths of which one lies under the other, by a join on ancestors; equal ones are one."""
    all_ = paths.select(F.regexp_replace(path, "/+$", "").alias("inner")).distinct()
    parts = F.split("inner", "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    up = all_.select("inner", F.explode(F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("outer"))
    return up.join(all_.select(F.col("inner").alias("outer")), "outer").select("outer", "inner")


def over_budget(counts: DataFrame, total: DataFrame, budgets: dict[str, float], group: str, counter: str = "counter", n: str = "n") -> DataFrame:
    """group, counter, per_mille of the counters above their budget; total holds n_rows by group."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv)), F.col(counter))
    x = counts.join(total, group).withColumn("per_mille", F.col(n) * 1000 / F.col("n_rows"))
    return x.filter(F.col("per_mille") > limit).select(group, counter, "per_mille")


def blank_fields(text: Column) -> Column:
    """Names of the fields of a two-column Markdown table that have no value."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\|[ \t]*([^|\n]*[^|\s])[ \t]*\|[ \t]*\|[ \t]*$"), F.lit(1))


def evidence_problems(expected: DataFrame, evidence: DataFrame, key: str = "role") -> DataFrame:
    """key, problem: evidence (key, rows, predictions, stage, checkpoint) that is missing, unasked for, or differs from the
    rows, the stage or the checkpoint expected of it; as many predictions as rows must be there."""
    faults = manifest_problems(expected, evidence, key, ("rows", "stage", "checkpoint"))
    short = evidence.filter(~F.col("predictions").eqNullSafe(F.col("rows"))).select(key, F.lit("predictions_differ").alias("problem"))
    return faults.unionByName(short)


def checksum_problems(records: DataFrame, found: DataFrame, key: str, referred: str, said: str, sha256: str = "sha256") -> DataFrame:
    """key, problem: records whose `referred` artifact is not there, or has another checksum than `said`."""
    there = found.select(F.col(key).alias("_key"), F.col(sha256).alias("_sha256"))
    x = records.join(there, F.col(referred) == F.col("_key"), "left")
    fault = F.when(F.col("_key").isNull(), "artifact_missing").when(~F.col(said).eqNullSafe(F.col("_sha256")), "checksum_differs")
    return x.select(key, fault.alias("problem")).filter("problem is not null")


def cohort_problems(cohorts: DataFrame, rows: DataFrame, fixed: DataFrame, limit: int, roles: tuple[str, ...], key: str = "row_id") -> DataFrame:
    """role, key, problem: each role's cohort (role, key) must be the rows but the fixed ones and those of more than `limit`
    tokens, so that the roles' cohorts are equal too."""
    out = fixed.select(F.col(key).alias("_fixed")).distinct()
    open_ = rows.filter(F.col("tokens") <= limit).join(out, F.col(key) == F.col("_fixed"), "left_anti").select(key)
    wanted = open_.select(F.explode(F.array(*map(F.lit, roles))).alias("role"), key)
    is_ = cohorts.select("role", key).distinct()
    extra = is_.join(wanted, ["role", key], "left_anti").withColumn("problem", F.lit("excluded_row_used"))
    return extra.unionByName(wanted.join(is_, ["role", key], "left_anti").withColumn("problem", F.lit("eligible_row_missing")))

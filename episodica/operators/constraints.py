"""What a metadata table must hold: keys, references, ranges and unique rows, as a report of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MODES, SPLITS

#: Columns that no row may lack. A record without a reward is quarantined, never stored with a zero.
REQUIRED = ("trajectory_id", "tenant_id", "domain", "task_id", "split", "actor_model", "actor_mode", "harness_version", "reward", "success", "steps_used", "content_sha256")
CONTENT_KEY = ("tenant_id", "domain", "content_sha256")


def row_checks(columns: list[str]) -> dict[str, Column]:
    """Rule to whether a row breaks it, for the rules that a row alone can break."""
    checks = {f"not_null:{c}": F.col(c).isNull() for c in REQUIRED if c in columns}
    return checks | {"one_of:split": ~F.col("split").isin(*SPLITS), "one_of:actor_mode": ~F.col("actor_mode").isin(*MODES), "not_negative:steps_used": F.col("steps_used") < 0}


def violations(rows: DataFrame, tenants: DataFrame, domains: DataFrame) -> DataFrame:
    """(rule, trajectory_id) for each broken rule of each row.

    tenants (tenant_id) and domains (domain) are what rows may refer to. A null breaks not_null alone, as in SQL. Rows that share a
    content key, or a trajectory_id, break a unique rule each.
    """
    broken = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in row_checks(rows.columns).items()]))
    alone = rows.select(F.explode(broken).alias("rule"), "trajectory_id")

    def without(held: DataFrame, column: str) -> DataFrame:
        named = rows.filter(F.col(column).isNotNull()).select("trajectory_id", column)
        return named.join(held.select(column).distinct(), column, "left_anti").select(F.lit(f"refers:{column}").alias("rule"), "trajectory_id")

    def repeated(key: tuple[str, ...], rule: str) -> DataFrame:
        whole = rows.dropna(subset=list(key))
        several = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"own_{c}") for c in key])
        on = [F.col(c) == F.col(f"own_{c}") for c in key]
        return whole.join(several, on, "left_semi").select(F.lit(rule).alias("rule"), "trajectory_id")

    return alone.unionByName(without(tenants, "tenant_id")).unionByName(without(domains, "domain")).unionByName(repeated(CONTENT_KEY, "unique:content")).unionByName(repeated(("trajectory_id",), "unique:trajectory_id"))

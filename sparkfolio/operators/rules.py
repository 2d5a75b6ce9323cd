"""Rule checks: findings of rows, first failing rule, and splits by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule: name, severity (block or warn), test of a row that breaks it.
Rule = tuple[str, str, Column]


def findings(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """A row for each rule that a row breaks: the keys, ``rule`` and ``severity``. Unknown counts as kept."""
    found = F.array(*[F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, test in rules])
    return df.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")).select(*keys, "_f.rule", "_f.severity")


def first_broken(rules: list[Rule]) -> Column:
    """The name of the first rule that a row breaks, null if none."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, _, test in rules])


def by_severity(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return found.where("severity = 'block'"), found.where("severity = 'warn'")


def admitted(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with ``problems``."""
    problems = F.filter(F.array(*[F.when(test, F.lit(name)) for name, _, test in rules]), lambda x: x.isNotNull())
    marked = df.withColumn("problems", problems)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)

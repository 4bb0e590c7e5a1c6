"""Evaluation of a rule set: one shared edge join, all rules as lazy plans, budgets checked, results united."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.model import DIAGNOSTIC, FINDING, SEVERITIES, FactError, FactModel, Limits, edge_facts, validate
from factloom.plans.rules import Rule, finish
from factloom.session import cut


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(f: FactModel, rules: Iterable[Rule], limits: Limits | None = Limits(), checked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings, diagnostics) of all rules over all projects.

    Of several rules the relations and the edge join are worked out once and written. With checked, integrity and budgets are checked first and any breach raises a FactError; checks are separate small
    aggregates, so no later projection can prune them away.
    """
    rules = sorted(rules, key=lambda r: r.rule_id)
    if len({r.rule_id for r in rules}) < len(rules):
        raise FactError("rule.config.duplicate-rule")
    if len(rules) > 1:
        f = f.written()
    if checked:
        validate(f, limits)
    edges = edge_facts(f) if len(rules) == 1 else cut(edge_facts(f))
    for r in rules:
        r.precheck(f, edges)
    spark = f.project.sparkSession
    findings = _union([finish(r, r.findings(f, edges), f) for r in rules], spark.createDataFrame([], FINDING))
    extra = [d for r in rules if (d := r.diagnostics(f, edges)) is not None]
    diagnostics = _union(extra, spark.createDataFrame([], DIAGNOSTIC)).distinct()
    if checked and limits and limits.max_findings is not None:
        over = findings.groupBy("project_id").count().where(F.col("count") > limits.max_findings)
        if not over.isEmpty():
            raise FactError("rule.limit.findings")
    return findings, diagnostics


def severity_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in zip(SEVERITIES, range(len(SEVERITIES))) for x in kv)), c)


def exit_code(findings: DataFrame, diagnostics: DataFrame, fail_on: str = "high") -> int:
    """70 if there is any diagnostic, else 2 if a finding is at least as severe as fail_on, else 0."""
    if not diagnostics.isEmpty():
        return 70
    worst = findings.agg(F.max(severity_rank("severity"))).first()[0]
    return 2 if worst is not None and worst >= SEVERITIES.index(fail_on) else 0

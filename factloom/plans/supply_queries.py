"""Queries that run each operator of the fact model over the order tables, with the same in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.functions.selectors import package_matches
from factloom.plans import graph
from factloom.plans.engine import evaluate, severity_rank
from factloom.plans.model import FactModel, JoinedModel, Limits, component_facts, edge_facts, violations
from factloom.plans.rules import AnnotationRule, BoundaryRule, ComplexityRule, ControllerRule, CycleRule, ForbiddenRule, LayerRule, PackageRule, Policy, Requirement, Rule
from factloom.session import kept
from factloom.sources.supply import FUNDED, supply_facts, whole_facts

Query = Callable[[SparkSession, str], DataFrame]
Facts = Callable[[SparkSession, str], FactModel]
REGIONS = ("africa", "america", "asia", "europe", "middle_east")
LAYERS = tuple((r, (f"trade.{r}.**",)) for r in REGIONS)
EVEN = tuple(tuple(f"trade.{r}.n{n}" for n in range(0, 25, 2)) for r in REGIONS)
BOUNDARIES = (("america", EVEN[1]), ("asia", EVEN[2]))

RULES: dict[str, Rule] = {
    "policy_denied": PackageRule(policies=(Policy("trade.asia.**", denied=("trade.europe.**",)),)),
    "policy_all": PackageRule(policies=(Policy("trade.asia.**", ("trade.africa.**", "trade.asia.**"), ("trade.europe.**",)),)),
    "layer_all": LayerRule(layers=LAYERS), "layer_reverse": LayerRule(layers=LAYERS, allow_skipping=True),
    "component_cycle": CycleRule(scope="component"), "package_cycle": CycleRule(scope="package"), "module_cycle": CycleRule(scope="module"),
    "controller_repository": ControllerRule(), "module_boundary": BoundaryRule(boundaries=BOUNDARIES),
    "forbidden_package": ForbiddenRule(selectors=("package:trade.middle_east.**",)),
    "forbidden_type": ForbiddenRule(selectors=("type:trade.africa.n10.S38", "type:trade.asia.n7.S94")),
    "forbidden_coordinate_ga": ForbiddenRule(selectors=("maven:Brand#14:MEDIUM",)), "forbidden_coordinate_gav": ForbiddenRule(selectors=("maven:Brand#16:LARGE:3",)),
    "forbidden_first_match": ForbiddenRule(selectors=("package:trade.**", "maven:Brand#14:MEDIUM", "maven:Brand#16:LARGE:3", "package:trade.asia.**")),
    "complexity_function": ComplexityRule(function=7), "complexity_type": ComplexityRule(type=600), "complexity_module": ComplexityRule(module=1),
    "complexity_all": ComplexityRule(function=7, type=600, module=1),
    "required_annotation": AnnotationRule(requirements=(Requirement(FUNDED, ("type",), ("class",), ("trade.**",)),)),
}
DIAGNOSED = {"module_boundary_missing": "module_boundary", "forbidden_unresolved_diag": "forbidden_coordinate_gav", "annotation_unresolved": "required_annotation"}


#: The order tables are one project; at every scale they are over the default budgets.
BUDGETS = Limits(1_000_000_000, 10_000_000_000, 10_000_000_000)


def _run(spark: SparkSession, d: str, rules: list[Rule], facts: Facts) -> tuple[DataFrame, DataFrame]:
    # rule sets are checked like those of a user; of single rules the integrity is checked by queries of its own
    return evaluate(facts(spark, d), rules, BUDGETS, checked=len(rules) > 1)


def flat(findings: DataFrame) -> DataFrame:
    return findings.select("id", "fingerprint", "rule_id", "severity", "subject_id", "message", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.col("location.path").alias("location_path"), F.col("location.start_line").alias("location_line"), F.array_join(F.array_sort(F.transform(F.map_entries("extensions"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";").alias("extensions"))


def _findings(name: str, facts: Facts) -> Query:
    return lambda spark, d: flat(_run(spark, d, [RULES[name]], facts)[0])


def _diagnostics(name: str, facts: Facts) -> Query:
    return lambda spark, d: _run(spark, d, [RULES[DIAGNOSED[name]]], facts)[1].select("code", "subject_id", "message")


ALL = ("policy_all", "layer_all", "component_cycle", "controller_repository", "module_boundary", "forbidden_first_match", "complexity_all", "required_annotation")


def rule_set_findings(spark: SparkSession, d: str, facts: Facts = supply_facts) -> DataFrame:
    """All eight rules at once, per rule and severity; the bag union of their findings."""
    return _run(spark, d, [RULES[n] for n in ALL], facts)[0].groupBy("rule_id", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("id").alias("n_ids"))


def rule_set_diagnostics(spark: SparkSession, d: str, facts: Facts = supply_facts) -> DataFrame:
    return _run(spark, d, [RULES[n] for n in ALL], facts)[1].groupBy("code").agg(F.count("*").alias("n_diagnostics"))


def severity_gate(spark: SparkSession, d: str, facts: Facts = supply_facts) -> DataFrame:
    """Findings at least as severe as high, per rule; the worst rank decides the exit status."""
    f = _run(spark, d, [RULES[n] for n in ALL], facts)[0]
    return f.withColumn("rank", severity_rank("severity")).where("rank >= 3").groupBy("rule_id").agg(F.max("rank").cast("long").alias("worst"), F.count("*").alias("n_blocking"))


def _facts(fn: Callable[[FactModel], DataFrame], facts: Facts = supply_facts) -> Query:
    return lambda spark, d: fn(facts(spark, d))


def _types(f: FactModel) -> DataFrame:
    return component_facts(f).where("component_kind = 'type'")


def _selector(pattern: str) -> Query:
    return _facts(lambda f: _types(f).where(package_matches(pattern, F.col("package"))).select("qualified_name", "package"))


def _layers(f: FactModel) -> DataFrame:
    return _types(f).select("qualified_name", F.get(RULES["layer_all"].layer(F.col("package")), 0).cast("long").alias("layer"))


def _broken(f: FactModel) -> FactModel:
    """A copy with errors planted: suppliers of every seventh hash lost, module evidence lost, one component twice."""
    from dataclasses import replace

    lost = F.substring("id", -1, 1).isin("0", "7")
    comp = f.component.where((F.col("kind") != "type") | ~lost)
    return replace(f, component=comp.unionByName(comp.where("kind = 'type'")), evidence=f.evidence.where((F.col("kind") != "reference") | ~lost), artifact=f.artifact.where((F.col("kind") != "module") | (F.col("name") != "asia")))


def integrity(f: FactModel) -> DataFrame:
    return violations(_broken(f)).groupBy("code").agg(F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_subjects"))


def budget(f: FactModel) -> DataFrame:
    return violations(f, Limits(max_nodes=50, max_edges=5)).select("code", "subject_id")


def self_loops(f: FactModel) -> DataFrame:
    return f.dependency.where("source_id = target_id").select(F.col("id").alias("dependency_id"), "source_id")


def cycle_members(f: FactModel) -> DataFrame:
    if isinstance(f, JoinedModel):
        rows = kept(f.links.rows.select("source_key", "target_key"))
        on = f.links.named(graph.cyclic_nodes(f.links.graph(rows))).select("scc", F.col("component_id").alias("node"))
        return on.groupBy("scc").agg(F.collect_set("node").alias("nodes")).select(F.array_min("nodes").alias("scc"), F.explode("nodes").alias("node"))
    inside = graph.cyclic_edges(f.dependency.select("project_id", "source_id", "target_id"))
    return inside.select("scc", F.col("source_id").alias("node")).distinct()


def _on_edges(facts: Facts) -> dict[str, Query]:
    """The queries that read dependencies."""
    edge_cols = ("source_qualified_name", "target_qualified_name", "source_package", "target_package", "module_path", "coordinate")
    edgeless = ("complexity_", "required_annotation", "annotation_")
    out: dict[str, Query] = {n: _findings(n, facts) for n in RULES} | {n: _diagnostics(n, facts) for n in DIAGNOSED}
    out = {n: q for n, q in out.items() if not n.startswith(edgeless)}
    return out | {
        **{f.__name__: functools.partial(f, facts=facts) for f in (rule_set_findings, rule_set_diagnostics, severity_gate)},
        "edge_fold": _facts(lambda f: f.dependency.select("id", "source_id", "target_id", "kind", F.array_join("evidence_ids", ",").alias("evidence_ids")), facts),
        "edge_facts": _facts(lambda f: edge_facts(f).select("dependency_id", *edge_cols), facts),
        "out_neighbours": _facts(lambda f: graph.outgoing(f.dependency).select("node", F.array_join("neighbours", ",").alias("neighbours")), facts),
        "in_degree": _facts(lambda f: graph.incoming(f.dependency).select("node", F.size("neighbours").cast("long").alias("n_sources")), facts),
        "integrity_violations": _facts(integrity, facts), "budget_check": _facts(budget, facts),
        "self_loops": _facts(self_loops, facts), "cycle_members": _facts(cycle_members, facts),
    }


def queries() -> dict[str, Query]:
    """whole_NAME is NAME over all edges; NAME itself has SQL, which holds the sampled binding."""
    out = _on_edges(supply_facts) | {f"whole_{n}": q for n, q in _on_edges(whole_facts).items()}
    out |= {n: _findings(n, supply_facts) for n in RULES if n not in out} | {n: _diagnostics(n, supply_facts) for n in DIAGNOSED if n not in out}
    return out | {
        "stable_id_component": _facts(lambda f: f.component.select("id", "qualified_name", "kind")),
        "selector_exact": _selector("trade.middle_east.n9"), "selector_children": _selector("trade.asia.*"), "selector_subtree": _selector("trade.africa.**"),
        "layer_assignment": _facts(_layers),
        "metric_values": _facts(lambda f: f.metric.select("scope_id", "key", ident.decimal_text("value").alias("value"))),
    }


# ---- the same in SQL

_BASE = """
WITH RECURSIVE reg AS (SELECT r_regionkey, lower(replace(r_name, ' ', '-')) AS mpath, lower(replace(r_name, ' ', '_')) AS rn FROM region),
art AS (SELECT *, 'supply:' || mpath AS mname, 'artifact_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'artifact', 'sql', mpath, 'supply:' || mpath)) AS aid FROM reg),
place AS (SELECT n_nationkey, n_regionkey, art.* FROM nation JOIN art ON n_regionkey = r_regionkey),
lib AS (SELECT coord, p_size, 'artifact_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'artifact', 'sql', '.', coord)) AS aid, 'component_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'component', 'sql', '.', coord)) AS cid
  FROM (SELECT DISTINCT p_brand || ':' || p_type || ':' || p_size AS coord, p_size FROM part)),
sup0 AS (SELECT s_suppkey, s_acctbal, n_nationkey, r_regionkey, aid, mpath, mname, 'trade.' || rn || '.n' || n_nationkey AS pkg, mpath || '/S' || s_suppkey AS path FROM supplier JOIN place ON s_nationkey = n_nationkey),
sup AS (SELECT *, pkg || '.S' || s_suppkey AS qn, 'component_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'component', 'sql', path, pkg || '.S' || s_suppkey)) AS cid,
  'evidence_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'evidence', 'sql', path, pkg || '.S' || s_suppkey || '|declaration')) AS decl FROM sup0),
ord AS (SELECT o_orderkey, 'orders/' || o_orderkey AS path, 'orders#o' || o_orderkey AS qn, 'component_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'component', 'sql', 'orders/' || o_orderkey, 'orders#o' || o_orderkey)) AS cid,
  'evidence_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'evidence', 'sql', 'orders/' || o_orderkey, 'orders#o' || o_orderkey || '|complexity')) AS mev
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey),
li AS (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nxt,
  'evidence_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'evidence', 'sql', 'orders/' || l_orderkey, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d')))) AS ev FROM lineitem),
raw AS (SELECT s.cid AS src, t.cid AS tgt, s.path, ev FROM li JOIN sup s ON l_suppkey = s.s_suppkey JOIN sup t ON nxt = t.s_suppkey WHERE l_discount >= 0.095 AND l_returnflag = 'R' AND l_quantity >= 45
  UNION ALL SELECT s.cid, lib.cid, s.path, ev FROM li JOIN sup s ON l_suppkey = s.s_suppkey JOIN part ON l_partkey = p_partkey JOIN lib ON lib.coord = p_brand || ':' || p_type || ':' || part.p_size WHERE l_quantity >= 50 AND l_discount >= 0.095),
dep AS (SELECT src, tgt, 'dependency_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'dependency', 'sql', path, src || '|depends-on|' || tgt)) AS id, list_sort(list(DISTINCT ev)) AS evs FROM raw GROUP BY src, tgt, path),
comp AS (SELECT cid, aid, 'type' AS kind, qn, pkg, s_suppkey, r_regionkey, n_nationkey, mpath, CAST(NULL AS VARCHAR) AS coord, CAST(NULL AS INT) AS p_size, decl, s_acctbal FROM sup
  UNION ALL SELECT cid, aid, 'module', coord, NULL, NULL, NULL, NULL, '.', coord, p_size, NULL, NULL FROM lib),
edge AS (SELECT dep.*, s.qn AS sqn, t.qn AS tqn, s.pkg AS spkg, t.pkg AS tpkg, s.s_suppkey AS sk, t.s_suppkey AS tk, s.r_regionkey AS sr, t.r_regionkey AS tr, s.n_nationkey AS sn, t.n_nationkey AS tn, s.aid AS said, t.aid AS taid, t.mpath, t.coord, t.p_size,
  concat_ws('|', src, 'depends-on', tgt, dep.id) AS parts FROM dep JOIN comp s ON src = s.cid JOIN comp t ON tgt = t.cid),
evs AS (SELECT DISTINCT ev, 'orders/' || l_orderkey AS path, l_linenumber AS line FROM li UNION ALL SELECT decl, path, 1 FROM sup UNION ALL SELECT mev, path, 1 FROM ord
  UNION ALL SELECT 'evidence_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'evidence', 'sql', mpath, mname || '|complexity')), mpath, 1 FROM art),
met AS (SELECT cid, mev, 'function' AS scope, n FROM ord JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
  UNION ALL SELECT cid, decl, 'type', coalesce(n, 0) FROM sup LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
  UNION ALL SELECT art.aid, 'evidence_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'evidence', 'sql', mpath, mname || '|complexity')), 'module', coalesce(n, 0) FROM art LEFT JOIN (SELECT aid, count(*) AS n FROM lineitem JOIN sup ON l_suppkey = s_suppkey GROUP BY 1) x ON art.aid = x.aid)
"""


def _finding_sql(rule: Rule, drafts: str, extra: str = "") -> str:
    """drafts: subject_id, evs, violation, parts, message, ext."""
    r = rule.rule_id
    return f"""{_BASE}{extra}, d AS ({drafts}), f AS (SELECT *, sha256(concat_ws(chr(10), '{r}', '0.1.0', 'supply', violation, parts)) AS fp FROM d)
SELECT 'finding_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'finding', 'sql', path, '{r}|' || fp)) AS id, fp AS fingerprint, '{r}' AS rule_id, '{rule.severity}' AS severity, subject_id, message, array_to_string(evs, ',') AS evidence_ids, path AS location_path, CAST(line AS INT) AS location_line, ext AS extensions
FROM f JOIN evs ON evs.ev = f.evs[1]"""


def _edge_sql(rule: Rule, violation: str, message: str, cond: str) -> str:
    return _finding_sql(rule, f"SELECT id AS subject_id, evs, {violation} AS violation, parts, {message} AS message, '{rule.namespace}.violation=' || {violation} AS ext FROM edge WHERE {cond}")


def _cycle_sql(scope: str) -> str:
    cols = {"component": ("src", "tgt", "sqn", ""), "package": ("spkg", "tpkg", "spkg", "WHERE spkg <> tpkg"), "module": ("said", "taid", "mname", "JOIN art ON art.aid = said WHERE said <> taid")}[scope]
    extra = f""", q AS (SELECT {cols[0]} AS a, {cols[1]} AS b, {cols[2]} AS label, edge.id, evs FROM edge {cols[3]}),
reach AS (SELECT DISTINCT a, b FROM q UNION SELECT reach.a, q.b FROM reach JOIN q ON reach.b = q.a),
scc AS (SELECT x.a AS node, min(x.b) AS low FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
ins AS (SELECT s.low, q.* FROM q JOIN scc s ON q.a = s.node JOIN scc t ON q.b = t.node AND s.low = t.low)"""
    drafts = f"""SELECT min(id) AS subject_id, list_sort(list_distinct(flatten(list(evs)))) AS evs, 'cycle-{scope}' AS violation,
array_to_string(list_sort(list(DISTINCT a)), '|') || '|' || array_to_string(list_sort(list(DISTINCT id)), '|') AS parts,
'Dependency cycle detected in {scope} scope: ' || (SELECT string_agg(label, ', ' ORDER BY a) FROM (SELECT DISTINCT a, label FROM ins i2 WHERE i2.low = ins.low)) AS message, 'arch.graph-scope={scope}' AS ext FROM ins GROUP BY low"""
    return _finding_sql(RULES[f"{scope}_cycle"], drafts, extra)


def _complexity_sql(name: str) -> str:
    r: ComplexityRule = RULES[name]
    most = "CASE scope " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in (("function", r.function), ("type", r.type), ("module", r.module)) if v is not None) + " END"
    return _finding_sql(r, f"""SELECT cid AS subject_id, [mev] AS evs, 'complexity-threshold-' || scope AS violation, concat_ws('|', scope, cid, n, {most}) AS parts,
'Cyclomatic complexity ' || n || ' exceeds ' || scope || ' threshold ' || {most} AS message, 'arch.metric=complexity.cyclomatic;arch.threshold=' || {most} AS ext FROM met WHERE n > {most}""")


def _layer_sql(name: str) -> str:
    rule: LayerRule = RULES[name]
    v = "CASE WHEN tr < sr THEN 'reverse-layer-dependency' WHEN tr > sr + 1 THEN 'skipped-layer-dependency' END"
    names = "['" + "','".join(REGIONS) + "']"
    cond = "tr < sr" if rule.allow_skipping else "(tr < sr OR tr > sr + 1)"
    return _edge_sql(rule, v, f"'Layer ' || {names}[sr + 1] || ' must not depend on layer ' || {names}[tr + 1]", cond)


def oracle_sql() -> dict[str, str]:
    denied = "tpkg LIKE 'trade.europe.%'"
    unlisted = "NOT (tpkg LIKE 'trade.africa.%' OR tpkg LIKE 'trade.asia.%')"
    text = "'Package dependency from ' || spkg || ' to ' || tpkg || "
    first = "CASE WHEN coord LIKE 'Brand#14:MEDIUM:%' THEN 'maven:Brand#14:MEDIUM' WHEN coord = 'Brand#16:LARGE:3' THEN 'maven:Brand#16:LARGE:3' WHEN tpkg LIKE 'trade.%' THEN 'package:trade.**' END"
    forbidden = lambda n, sel, cond: _edge_sql(RULES[n], "'forbidden-component'", f"'Dependency targets forbidden component selector ' || {sel}", cond)
    boundary = "said <> taid AND tpkg IS NOT NULL"
    out = {
        "policy_denied": _edge_sql(RULES["policy_denied"], "'denied-package-dependency'", text + "' is denied'", f"spkg <> tpkg AND spkg LIKE 'trade.asia.%' AND {denied}"),
        "policy_all": _edge_sql(RULES["policy_all"], f"CASE WHEN {denied} THEN 'denied-package-dependency' ELSE 'unlisted-package-dependency' END", text + f"CASE WHEN {denied} THEN ' is denied' ELSE ' is not allowed' END", f"spkg <> tpkg AND spkg LIKE 'trade.asia.%' AND ({denied} OR {unlisted})"),
        "layer_all": _layer_sql("layer_all"), "layer_reverse": _layer_sql("layer_reverse"),
        **{f"{s}_cycle": _cycle_sql(s) for s in ("component", "package", "module")},
        "controller_repository": _edge_sql(RULES["controller_repository"], "'controller-repository-access'", "'Spring Controller ' || sqn || ' must not directly access Repository ' || tqn", "sk % 3 = 0 AND tk % 4 = 1"),
        "module_boundary": _edge_sql(RULES["module_boundary"], "'internal-module-access'", "'Cross-module dependency targets internal package ' || tpkg", f"{boundary} AND tr IN (1, 2) AND tn % 2 = 1"),
        "forbidden_package": forbidden("forbidden_package", "'package:trade.middle_east.**'", "tpkg LIKE 'trade.middle_east.%'"),
        "forbidden_type": forbidden("forbidden_type", "'type:' || tqn", "tqn IN ('trade.africa.n10.S38', 'trade.asia.n7.S94')"),
        "forbidden_coordinate_ga": forbidden("forbidden_coordinate_ga", "'maven:Brand#14:MEDIUM'", "coord LIKE 'Brand#14:MEDIUM:%'"),
        "forbidden_coordinate_gav": forbidden("forbidden_coordinate_gav", "'maven:Brand#16:LARGE:3'", "coord = 'Brand#16:LARGE:3'"),
        "forbidden_first_match": forbidden("forbidden_first_match", first, f"{first} IS NOT NULL"),
        **{n: _complexity_sql(n) for n in ("complexity_function", "complexity_type", "complexity_module", "complexity_all")},
        "required_annotation": _finding_sql(RULES["required_annotation"], f"SELECT cid AS subject_id, [decl] AS evs, 'required-annotation' AS violation, cid || '|{FUNDED}' AS parts, 'Component ' || qn || ' requires annotation {FUNDED}' AS message, 'arch.required-annotation={FUNDED}' AS ext FROM sup WHERE s_suppkey % 17 <> 3 AND s_acctbal < 5000"),
        "module_boundary_missing": f"{_BASE} SELECT DISTINCT 'rule.module-boundary.missing' AS code, taid AS subject_id, 'target Maven module has no public API boundary configuration' AS message FROM edge WHERE {boundary} AND tr NOT IN (1, 2)",
        "forbidden_unresolved_diag": f"{_BASE} SELECT DISTINCT 'rule.maven-version.unresolved' AS code, taid AS subject_id, 'target Maven version could not be resolved for a version-specific selector' AS message FROM edge WHERE coord <> 'Brand#16:LARGE:3' AND p_size % 10 = 0",
        "annotation_unresolved": f"{_BASE} SELECT DISTINCT 'rule.annotation.unresolved' AS code, cid AS subject_id, 'required annotation could not be evaluated because annotation resolution is incomplete' AS message FROM sup WHERE s_suppkey % 17 = 3",
        "edge_fold": f"{_BASE} SELECT id, src AS source_id, tgt AS target_id, 'depends-on' AS kind, array_to_string(evs, ',') AS evidence_ids FROM dep",
        "edge_facts": f"{_BASE} SELECT id AS dependency_id, sqn AS source_qualified_name, tqn AS target_qualified_name, spkg AS source_package, tpkg AS target_package, mpath AS module_path, coord AS coordinate FROM edge",
        "out_neighbours": f"{_BASE} SELECT src AS node, array_to_string(list_sort(list(DISTINCT tgt)), ',') AS neighbours FROM dep GROUP BY src",
        "in_degree": f"{_BASE} SELECT tgt AS node, count(DISTINCT src) AS n_sources FROM dep GROUP BY tgt",
        "stable_id_component": f"{_BASE} SELECT cid AS id, qn AS qualified_name, kind FROM comp UNION ALL SELECT cid, qn, 'function' FROM ord",
        "selector_exact": f"{_BASE} SELECT qn AS qualified_name, pkg AS package FROM sup WHERE pkg = 'trade.middle_east.n9'",
        "selector_children": f"{_BASE} SELECT qn AS qualified_name, pkg AS package FROM sup WHERE starts_with(pkg, 'trade.asia.') AND instr(substr(pkg, 12), '.') = 0",
        "selector_subtree": f"{_BASE} SELECT qn AS qualified_name, pkg AS package FROM sup WHERE pkg = 'trade.africa' OR starts_with(pkg, 'trade.africa.')",
        "layer_assignment": f"{_BASE} SELECT qn AS qualified_name, CAST(r_regionkey AS BIGINT) AS layer FROM sup",
        "self_loops": f"{_BASE} SELECT id AS dependency_id, src AS source_id FROM dep WHERE src = tgt",
        "cycle_members": f"{_BASE}, reach AS (SELECT DISTINCT src AS a, tgt AS b FROM dep UNION SELECT reach.a, dep.tgt FROM reach JOIN dep ON reach.b = dep.src) SELECT min(x.b) AS scc, x.a AS node FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
        "metric_values": f"{_BASE} SELECT cid AS scope_id, 'complexity.cyclomatic' AS key, CAST(n AS VARCHAR) AS value FROM met",
        "budget_check": f"{_BASE}, pid AS (SELECT 'project_' || sha256(concat_ws(chr(10), '0.1.0', 'supply', 'project', 'sql', '.', 'supply')) AS p) SELECT 'rule.limit.nodes' AS code, p AS subject_id FROM pid WHERE (SELECT count(*) FROM comp) + (SELECT count(*) FROM ord) > 50 UNION ALL SELECT 'rule.limit.edges', p FROM pid WHERE (SELECT count(*) FROM dep) > 5",
    }
    every = " UNION ALL ".join(f"SELECT id, rule_id, severity FROM ({out[n]})" for n in ALL)
    out["rule_set_findings"] = f"SELECT rule_id, severity, count(*) AS n_findings, count(DISTINCT id) AS n_ids FROM ({every}) GROUP BY 1, 2"
    out["severity_gate"] = f"SELECT rule_id, CAST(max(CASE severity WHEN 'critical' THEN 4 ELSE 3 END) AS BIGINT) AS worst, count(*) AS n_blocking FROM ({every}) WHERE severity IN ('high', 'critical') GROUP BY 1"
    first_diag = out["forbidden_unresolved_diag"].replace("coord <> 'Brand#16:LARGE:3'", "coord <> 'Brand#16:LARGE:3' AND coord NOT LIKE 'Brand#14:MEDIUM:%'")
    diags = " UNION ".join(f"SELECT code, subject_id FROM ({q})" for q in (out["module_boundary_missing"], out["annotation_unresolved"], first_diag))
    out["rule_set_diagnostics"] = f"SELECT code, count(*) AS n_diagnostics FROM ({diags}) GROUP BY 1"
    return out

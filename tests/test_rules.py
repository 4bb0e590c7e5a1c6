"""The eight rules, integrity checks and graphs on small fact models."""

import random
from dataclasses import replace

import pytest
from facts import key, model
from pyspark.sql import functions as F

from factloom.plans import graph
from factloom.plans.engine import evaluate, exit_code
from factloom.plans.model import FactError, Limits, violations
from factloom.plans.rules import CONTROLLERS, REPOSITORY, AnnotationRule, BoundaryRule, ComplexityRule, ControllerRule, CycleRule, ForbiddenRule, LayerRule, PackageRule, Policy, Requirement


def run(f, *rules, limits=Limits()):
    a, b = evaluate(f, rules, limits)
    return a.collect(), b.collect()


def test_allow_and_deny(spark):
    nodes = [("Source", "com.app.api", "app"), ("Direct", "com.target.one", "app"), ("Nested", "com.target.one.deep", "app"), ("Denied", "com.forbidden", "app"), ("Bare", None, "app")]
    f = model(spark, nodes, [("a", "Source", "Direct"), ("b", "Source", "Nested"), ("c", "Source", "Denied"), ("d", "Source", "Bare"), ("e", "Source", "Source")])
    got, _ = run(f, PackageRule(policies=(Policy("com.app.**", ("com.target.*",), ("com.forbidden",)),)))
    assert sorted(r.message.split(" to ")[1] for r in got) == ["com.forbidden is denied", "com.target.one.deep is not allowed"]
    assert all(r.location.start_line == 7 and r.severity == "high" for r in got)


def test_layers_strict_skipping_and_overlap(spark):
    f = model(spark, [("Api", "com.app.api", "m"), ("Service", "com.app.service", "m"), ("Data", "com.app.data", "m")], [("a", "Api", "Service"), ("b", "Api", "Data"), ("c", "Data", "Api")])
    layers = tuple((n, (f"com.app.{n}",)) for n in ("api", "service", "data"))
    assert len(run(f, LayerRule(layers=layers))[0]) == 2
    assert [r.message for r in run(f, LayerRule(layers=layers, allow_skipping=True))[0]] == ["Layer data must not depend on layer api"]
    with pytest.raises(FactError, match="rule.config.layer-overlap"):
        run(f, LayerRule(layers=(("one", ("com.app.**",)), ("two", ("com.app.api",)))))


def test_cycles_in_three_scopes(spark):
    nodes = [(n, f"com.{n.lower()}", f"module-{n.lower()}") for n in ("A", "B", "C", "Self", "D", "E")]
    links = [("ab", "A", "B"), ("bc", "B", "C"), ("ca", "C", "A"), ("ss", "Self", "Self"), ("de", "D", "E")]
    f = model(spark, nodes, links)
    by = {s: run(f, CycleRule(scope=s))[0] for s in ("component", "package", "module")}
    assert {s: len(v) for s, v in by.items()} == {"component": 2, "package": 1, "module": 1}
    big = max(by["component"], key=lambda r: len(r.evidence_ids))
    assert len(big.evidence_ids) == 3 and big.subject_id == min(key("dependency", x) for x in ("ab", "bc", "ca"))
    assert by["package"][0].message == "Dependency cycle detected in package scope: com.a, com.b, com.c"


def test_controller_repository(spark):
    nodes = [("C", "w", "m", [CONTROLLERS[1]]), ("S", "s", "m"), ("R", "d", "m", [REPOSITORY]), ("X", "w", "m", ["other.Controller"])]
    f = model(spark, nodes, [("a", "C", "R"), ("b", "C", "S"), ("c", "S", "R"), ("d", "X", "R")])
    got, _ = run(f, ControllerRule())
    assert [r.subject_id for r in got] == [key("dependency", "a")] and got[0].rule_id == "spring.controller-repository-access"


def test_boundaries(spark):
    nodes = [("App", "com.app", "app"), ("Api", "com.orders.api", "orders"), ("Internal", "com.orders.impl", "orders"), ("Unknown", "com.x", "other"), ("Bare", None, "other")]
    f = model(spark, nodes, [(t, "App", t) for t in ("Api", "Internal", "Unknown", "Bare")] + [("App2", "App", "Unknown")])
    got, diag = run(f, BoundaryRule(boundaries=(("orders", ("com.orders.api.**",)), ("app", ("com.app",)))))
    assert [r.message for r in got] == ["Cross-module dependency targets internal package com.orders.impl"]
    assert [(d.code, d.subject_id) for d in diag] == [("rule.module-boundary.missing", key("artifact", "other"))]
    assert exit_code(*evaluate(f, [BoundaryRule(boundaries=(("orders", ("com.orders.api.**",)),))])) == 70


def test_forbidden(spark):
    coords = {"danger": {"maven.coordinate": ["org.bad:danger:2"]}, "legacy": {"maven.coordinate": ["org.bad:legacy:1.4.0"]}, "none": {"maven.coordinate-unresolved": ["true"]}, "maybe": {"maven.coordinate": ["org.bad:maybe"], "maven.version-unresolved": ["true"]}}
    nodes = [("S", "a", "src"), ("T", "com.bad", "t")] + [(m.title(), "z", m) for m in coords]
    f = model(spark, nodes, [(m, "S", m.title()) for m in coords] + [("t", "S", "T")], modules=coords)
    rule = ForbiddenRule(selectors=("type:com.bad.T", "package:com.bad", "maven:org.bad:danger", "maven:org.bad:legacy:1.4.0", "maven:org.bad:maybe:9.9.9"))
    got, diag = run(f, rule)
    assert sorted(r.message.rsplit(" ", 1)[1] for r in got) == ["maven:org.bad:danger", "maven:org.bad:legacy:1.4.0", "package:com.bad"]
    assert sorted(d.code for d in diag) == ["rule.maven-coordinate.unresolved", "rule.maven-version.unresolved"]


def test_complexity(spark):
    nodes = [("Exact", "a", "m", [], "complete", "function", "method"), ("High", "a", "m", [], "complete", "function", "method"), ("TypeHigh", "a", "m")]
    f = model(spark, nodes, [], [("Exact", "5"), ("TypeHigh", "6"), ("High", "6"), ("m", "7")])
    got, _ = run(f, ComplexityRule(function=5, type=5, module=6))
    assert sorted(r.message for r in got) == ["Cyclomatic complexity 6 exceeds function threshold 5", "Cyclomatic complexity 6 exceeds type threshold 5", "Cyclomatic complexity 7 exceeds module threshold 6"]
    assert {r.severity for r in got} == {"medium"} and len(run(f, ComplexityRule(module=6))[0]) == 1


def test_required_annotation(spark):
    nodes = [("Has", "a", "m", ["x.Y"]), ("Missing", "a", "m"), ("Unknown", "a", "m", ["x.Y"], "incomplete"), ("Other", "b", "m"), ("Method", "a", "m", [], "complete", "function", "method")]
    reqs = (Requirement("x.Y", ("type",), ("class",), ("a",)), Requirement("x.Z", ("function",)))
    got, diag = run(model(spark, nodes, []), AnnotationRule(requirements=reqs))
    assert {r.subject_id for r in got} == {key("component", "Missing"), key("component", "Method")}
    assert [(d.code, d.subject_id) for d in diag] == [("rule.annotation.unresolved", key("component", "Unknown"))]


def test_permutation_gives_identical_findings(spark):
    nodes = [("A", "com.a", "ma"), ("B", "com.b", "mb")]
    f = model(spark, nodes, [("ab", "A", "B"), ("ba", "B", "A")])
    rules = [CycleRule(), PackageRule(policies=(Policy("com.a", denied=("com.b",)),))]
    shuffled = replace(f, **{k: v.orderBy(F.rand(3)).repartition(3) for k, v in vars(f).items()})
    assert sorted(map(str, run(f, *rules)[0])) == sorted(map(str, run(shuffled, *rules[::-1])[0]))


def test_budgets_and_duplicate_rules(spark):
    f = model(spark, [("A", "a", "m"), ("B", "b", "m"), ("C", "c", "m")], [("x", "A", "B"), ("y", "A", "C")])
    rule = PackageRule(policies=(Policy("a", denied=("b", "c")),))
    for limits, code in ((Limits(3, 2, 1), "rule.limit.findings"), (Limits(2, 2, 9), "rule.limit.nodes"), (Limits(3, 1, 9), "rule.limit.edges")):
        with pytest.raises(FactError, match=code):
            run(f, rule, limits=limits)
    with pytest.raises(FactError, match="rule.config.duplicate-rule"):
        run(f, rule, rule)


def test_integrity(spark):
    f = model(spark, [("A", "a", "m"), ("B", ["b", "c"], "m")], [("x", "A", "B"), ("y", "A", "Nowhere")])
    f = replace(f, evidence=f.evidence.where(F.col("id") != key("evidence", "x")), component=f.component.unionByName(f.component.where("name = 'A'")), artifact=f.artifact.limit(0))
    codes = {r.code for r in violations(f).collect()}
    assert codes == {"rule.input.duplicate-component", "rule.input.dangling-component", "rule.input.dangling-dependency", "rule.input.missing-evidence", "rule.input.missing-package"}


def test_empty_model(spark):
    got, diag = run(model(spark, [], []), PackageRule(policies=(Policy("a", denied=("b",)),)), CycleRule(), ComplexityRule(type=1))
    assert got == [] and diag == []


@pytest.mark.parametrize("seed", range(5))
def test_components_against_reachability(seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(20)]
    nodes = {x for p in pairs for x in p}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    assert graph.tarjan(pairs) == want


def test_bad_parameters():
    for make in (
        lambda: PackageRule(policies=(Policy("com..example", denied=("a",)),)), lambda: PackageRule(policies=(Policy("a", denied=("b",)),) * 2), lambda: PackageRule(policies=(Policy("a"),)),
        lambda: LayerRule(layers=(("a", ("x",)),)), lambda: ComplexityRule(), lambda: ComplexityRule(type=0), lambda: CycleRule(scope="x"), lambda: ControllerRule(severity="info"), lambda: ForbiddenRule(selectors=("x:y",)),
    ):
        with pytest.raises(FactError, match="config.value.invalid"):
            make()


@pytest.mark.parametrize("seed", range(2))
def test_large_graphs_are_coloured_to_the_same_components(spark, seed):
    from factloom.plans import graph

    rnd = random.Random(seed)
    pairs = {(p, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for p in ("p", "q") for _ in range(45 if p == "p" else 70)} | {("r", "a", "a"), ("r", "a", "b")}
    edges = spark.createDataFrame(sorted(pairs), "project_id string, source_id string, target_id string")
    want = {(p, n, s) for p in ("p", "q", "r") for n, s in graph.tarjan([(a, b) for x, a, b in sorted(pairs) if x == p]).items()}
    for most in (0, 50, 1000):
        assert {tuple(r) for r in graph.scc(edges, most).collect()} == want

"""Rule documents, JSON reports, identities, selectors, names and the atomic writer."""

import json

import pytest
from facts import key, model
from pyspark.sql import functions as F

from factloom import cli
from factloom.functions import ident, selectors
from factloom.operators import names
from factloom.plans import engine, ruleset
from factloom.plans.model import FactError
from factloom.plans.rules import CycleRule
from factloom.sources import reports

ALL = """
version: 0.1.0
project: {identity: team/app, name: app}
failOn: critical
limits: {maxFiles: 1234, maxDurationSeconds: 45, maxOutputBytes: 4096}
rules:
  - {id: arch.illegal-package-dependency, parameters: {policies: [{source: a.**, deniedTargets: [b]}]}}
  - {id: arch.layered-architecture, severity: low, parameters: {layers: [{name: x, packages: [x]}, {name: y, packages: [y.*]}], allowLayerSkipping: true}}
  - {id: arch.dependency-cycle, parameters: {scope: module}}
  - {id: spring.controller-repository-access}
  - {id: arch.internal-module-access, parameters: {boundaries: [{modulePath: m, publicPackages: [p]}]}}
  - {id: arch.forbidden-component, parameters: {selectors: [{type: a.B}, {package: a}, {maven: "g:a:1"}]}}
  - {id: arch.complexity-threshold, parameters: {functionThreshold: 10}}
  - {id: arch.required-annotation, parameters: {requirements: [{annotation: x.Y, componentKinds: [type]}]}}
"""


def test_all_rules_document():
    pytest.importorskip("yaml")
    r = ruleset.parse(ALL.encode())
    assert len(r.rules) == 8 and r.fail_on == "critical" and r.limits["maxFiles"] == 1234 and r.limits["maxDepth"] == 32
    assert {x.severity for x in r.rules} == {"high", "low", "medium"}


@pytest.mark.parametrize("change, code", [
    (("failOn: critical", "failOn: info"), "config.schema.invalid"), (("maxFiles: 1234", "maxDepth: 3"), "config.schema.invalid"), (("maxFiles: 1234", "extra: 1"), "config.schema.invalid"),
    (("scope: module", "scope: x"), "config.schema.invalid"), (("arch.dependency-cycle", "arch.nothing"), "config.schema.invalid"), (("source: a.**", "source: invalid package"), "config.value.invalid"),
    (("failOn: critical", "failOn: high\nfailOn: low"), "config.yaml.invalid"), (("failOn: critical", "failOn: &a critical"), "config.yaml.reference"), (("failOn: critical", "failOn: !x critical"), "config.yaml.reference"),
    (("rules:", "---\nrules:"), "config.yaml.invalid"), (("version: 0.1.0", "version: 0.2.0"), "config.schema.invalid"), (("severity: low", "severity: info"), "config.schema.invalid"), (("arch.dependency-cycle, parameters: {scope: module}", "arch.complexity-threshold, parameters: {typeThreshold: 3}"), "rule.config.duplicate-rule"),
])
def test_rejected_documents(change, code):
    pytest.importorskip("yaml")
    assert change[0] in ALL
    with pytest.raises(FactError) as e:
        ruleset.parse(ALL.replace(*change).encode())
    assert e.value.code == code


def test_encoding_and_size():
    pytest.importorskip("yaml")
    for raw, code in ((b"\xc3\x28", "config.encoding.invalid"), (b" ", "config.yaml.empty"), (b"a" * ((1 << 20) + 1), "config.limit.bytes")):
        with pytest.raises(FactError, match=code):
            ruleset.parse(raw)


def test_command_line(tmp_path, capsys):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(ALL)
    assert cli.main(["validate-rules", str(tmp_path / "r.yaml")]) == 0 and "rules=8" in capsys.readouterr().out
    assert cli.main(["validate-rules", str(tmp_path / "none")]) == 64 and cli.main(["validate-rules"]) == 64 and cli.main(["--version"]) == 0


def report(spark):
    f = model(spark, [("A", "com.a", "m"), ("B", "com.b", "m")], [("ab", "A", "B"), ("ba", "B", "A")], [("A", "3")])
    findings, _ = engine.evaluate(f, [CycleRule()])
    return f, reports.to_json(f, findings)


def test_report_is_canonical_and_valid(spark):
    f, out = report(spark)
    body = out.first().body
    doc = json.loads(body)
    assert list(doc) == sorted(doc) and [x["id"] for x in doc["components"]] == sorted(x["id"] for x in doc["components"])
    assert body == json.dumps(doc, separators=(",", ":"), ensure_ascii=False) and doc["metrics"][0]["value"] == 3
    assert reports.problems(out, "project_id").first().reasons == []
    again = reports.read(out).select("r.components").first()[0]
    assert {c.id for c in again} == {key("component", "A"), key("component", "B")}


BROKEN = [
    (lambda d: d.pop("project"), "required"), (lambda d: d.update(schemaVersion="1.0.0"), "const"), (lambda d: d["artifacts"][0].update(kind="java-class"), "enum"),
    (lambda d: d["evidences"][0]["location"].update(startLine=10, endLine=9), "end"), (lambda d: d["project"].update(localCheckout="x"), "additional properties"),
    (lambda d: d["components"][0]["extensions"].update(modifiers=["x"]), "pattern"), (lambda d: d["project"].update(id="project_not-a-sha256"), "regex pattern"),
    (lambda d: d["components"][0].update(artifactId=key("artifact", "gone")), "unknown artifact"), (lambda d: d["project"].update(repositoryPath="C:/Users/x"), "regex pattern"),
    (lambda d: d["findings"][0].update(subjectId="x"), "unknown subject"), (lambda d: d["components"].append(d["components"][0]), "duplicate id"), (lambda d: d["dependencies"][0].update(evidenceIds=[]), "unknown evidence"),
]


def test_broken_reports_are_named(spark):
    whole = report(spark)[1].first().body
    rows = []
    for k, (change, _) in enumerate(BROKEN):
        doc = json.loads(whole)
        change(doc)
        rows.append((k, json.dumps(doc)))
    rows += [(100, "{"), (101, None), (102, whole)]
    got = {r.key: r.reasons for r in reports.problems(spark.createDataFrame(rows, "k long, body string"), "k").collect()}
    assert got[100] == got[101] == ["not readable"] and got[102] == []
    for k, (_, reason) in enumerate(BROKEN):
        assert reason in got[k], (reason, got[k])


def test_atomic_writer(tmp_path):
    p = tmp_path / "r.json"
    reports.write_atomic(p, b"one")
    reports.write_atomic(p, b"two")
    assert p.read_bytes() == b"two" and [x.name for x in tmp_path.iterdir()] == ["r.json"]
    link = tmp_path / "l.json"
    link.symlink_to(p)
    for where, limit, code in ((link, 99, "report.write.failed"), (tmp_path / "no" / "r", 99, "report.write.failed"), (p, 1, "report.limit.bytes")):
        with pytest.raises(FactError, match=code):
            reports.write_atomic(where, b"three", limit)
    assert p.read_bytes() == b"two"


def test_identities(spark):
    df = spark.createDataFrame([("src/./a", "e\u0301"), ("a\\b", "x"), ("../a", "x"), ("/a", "x"), ("C:/a", "x"), ("a//b", "x"), (".", "x"), ("", "x"), (None, None)], "p string, t string")
    assert [r[0] for r in df.select(ident.norm_path("p")).collect()] == ["src/a", "a/b", None, None, None, None, ".", None, None]
    assert df.select(ident.nfc("t")).first()[0] == "\u00e9"
    m = spark.createDataFrame([({"b.x": ["2", "1"], "a.y": ["z"]},), ({"plain": ["1"]},), ({"a.b": []},), ({"a.b": ["1", "1"]},), ({},)], "m map<string,array<string>>")
    got = [r[0] for r in m.select(ident.canonical_extensions("m")).collect()]
    assert list(got[0].items()) == [("a.y", ["z"]), ("b.x", ["1", "2"])] and got[1:] == [None, None, None, {}]
    d = spark.createDataFrame([("5.0000",), ("1.2500",), ("100",), (None,)], "d string").select(ident.decimal_text(F.col("d").cast("decimal(20,4)")))
    assert [r[0] for r in d.collect()] == ["5", "1.25", "100", None]


def test_selectors(spark):
    df = spark.createDataFrame([("com.a",), ("com.a.b",), ("com.a.b.c",), ("com.ab",), ("<default>",), ("公司.架构.规则",), (None,)], "p string")
    hits = lambda s: [r[0] for r in df.where(selectors.package_matches(s, F.col("p"))).collect()]
    assert hits("com.a") == ["com.a"] and hits("com.a.*") == ["com.a.b"] and hits("com.a.**") == ["com.a", "com.a.b", "com.a.b.c"]
    assert hits("<default>") == ["<default>"] and hits("公司.架构.**") == ["公司.架构.规则"]
    for bad in ("com..example", "", "*", "a.*.b", "1a"):
        with pytest.raises(ValueError):
            selectors.check_package(bad)


def test_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "_n long, k string").withColumnRenamed("_n", "i")
    keep, drop = names.unique_or_drop(df, ["k"])
    assert [r.i for r in keep.collect()] == [3] and sorted(r.i for r in drop.collect()) == [1, 2, 4, 5]
    refs = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["q"]), (3, [None, "a"])], "ref long, candidates array<string>")
    known = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B2")], "name string, target string")
    assert sorted(map(tuple, names.resolve_ranked(refs, known).collect())) == [(1, "B", 1), (3, "A", 1)]
    assert sorted(map(tuple, names.resolve_unique(refs, known).collect())) == [(3, "A")]

"""POM dependency edges against plain Python on the whole small table."""

import re

import brute

from factloom.queries import queries


def _rows(spark, sf):
    return [r.asDict(recursive=True) for r in spark.read.parquet(f"{sf}/raw_poms.parquet").collect()]


def test_dependency_edges_match_brute_force(spark, sf):
    newest, keys = {}, set()
    for r in _rows(spark, sf):
        props = dict(r["pom_properties"] or {})
        parent = {k: brute.full(r[c]) for k, c in (("parent.groupId", "parent_group_id"), ("parent.artifactId", "parent_artifact_id"), ("parent.version", "parent_version"))}
        own = props | {k: v for k, v in parent.items() if v}
        g, a = brute.resolve(brute.full(r["group_id"]) or parent["parent.groupId"], own), brute.resolve(r["artifact_id"], own)
        if not g or not a:
            continue
        keys.add(f"{g}:{a}")
        if (at := (r["scanned_at"], r["pom_id"])) >= newest.get(f"{g}:{a}", ((at[0], -1), None, None))[0]:
            newest[f"{g}:{a}"] = (at, r, props | {"project.groupId": g, "pom.groupId": g, "project.artifactId": a, "pom.artifactId": a})
    want: dict = {}
    for key, (_, r, props) in newest.items():
        for d in r["dependencies"] or []:
            scope = brute.resolve(d["dep_scope"], props) or "compile"
            g, a = brute.resolve(d["group_id"], props), brute.resolve(d["artifact_id"], props)
            if scope != "test" and g and a:
                e = want.setdefault((key, f"{g}:{a}"), (set(), set()))
                e[0].add(scope)
                e[1].add(d["line_no"])
    got = {(r.source_key, r.target_key): (set(r.scopes.split(",")), r.n_lines, r.internal) for r in queries()["maven_edges"](spark, sf).collect()}
    assert got == {k: (s, len(n), k[1] in keys) for k, (s, n) in want.items()} and want
    assert all(re.fullmatch(r"[^:]+:[^:]+", k[0]) for k in want)


def test_unresolved_dependencies_have_a_code(spark, sf):
    assert {r.code for r in queries()["maven_unresolved"](spark, sf).collect()} <= {"maven.dependency.unresolved"}

"""Small fact models: types with packages and modules, links between them, and what rules read from extensions."""

import hashlib

from factloom.plans.model import ARTIFACT, COMPONENT, DEPENDENCY, EVIDENCE, METRIC, PROJECT, FactModel


def key(kind, name):
    return f"{kind}_" + hashlib.sha256(name.encode()).hexdigest()


def loc(path, line=1):
    return (path, line, 1, line, 10)


def model(spark, nodes, links, metrics=(), modules=None, project="p"):
    """nodes: (name, package, module[, annotations, resolution, kind, declaration]); links: (name, source, target); metrics: (scope, value)."""
    pid = key("project", project)
    modules = modules or {}
    names = sorted({n[2] for n in nodes})
    arts, comps, evs = [], [], []
    for m in names:
        arts.append((pid, key("artifact", m), "module", m, "java", m, f"id:{m}", modules.get(m, {})))
        evs.append((pid, key("evidence", f"mod {m}"), "metric", "m", loc(f"{m}/pom.xml"), {}))
    for name, pkg, mod, *rest in nodes:
        marks, resolution, kind, declared = [*rest, *([], "complete", "type", "class")[len(rest):]]
        ext = {**({"java.annotations": marks} if marks else {}), "java.annotation-resolution": [resolution], "java.declaration-kind": [declared], "arch.declaration-evidence-id": [key("evidence", f"decl {name}")]}
        if pkg is not None:
            ext["java.package"] = [pkg] if isinstance(pkg, str) else pkg
        qn = name if pkg in (None, "<default>") else f"{pkg}.{name}" if isinstance(pkg, str) else name
        comps.append((pid, key("component", name), key("artifact", mod), kind, name, "java", qn, loc(f"{mod}/src/{name}.java"), ext))
        evs.append((pid, key("evidence", f"decl {name}"), "declaration", "d", loc(f"{mod}/src/{name}.java"), {}))
    deps = []
    for name, s, t in links:
        evs.append((pid, key("evidence", name), "reference", "r", loc(f"src/{name}.java", 7), {}))
        deps.append((pid, key("dependency", name), key("component", s), key("component", t), "depends-on", [key("evidence", name)], {}))
    from decimal import Decimal

    mets = []
    for scope, v in metrics:
        kind = "artifact" if scope in names else "component"
        ev = f"mod {scope}" if kind == "artifact" else f"decl {scope}"
        mets.append((pid, key("metric", scope), key(kind, scope), "complexity.cyclomatic", Decimal(v), "count", {"arch.evidence-id": [key("evidence", ev)]}))
    make = spark.createDataFrame
    return FactModel(
        make([(pid, project, project, "java", ".", {})], PROJECT), make(arts, ARTIFACT), make(comps, COMPONENT), make(deps, DEPENDENCY), make(evs, EVIDENCE), make(mets, METRIC),
    )

"""Rule documents: one YAML mapping of closed shape, bound to rule objects. Nothing in it can run code or refer elsewhere."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from factloom.plans.model import SEVERITIES, FactError, Limits
from factloom.plans.rules import AnnotationRule, BoundaryRule, ComplexityRule, ControllerRule, CycleRule, ForbiddenRule, LayerRule, PackageRule, Policy, Requirement, Rule

MAX_BYTES = 1 << 20
#: Limits of a rule document with their ranges and defaults.
LIMITS = {
    "maxFiles": (1, 10_000, 10_000), "maxFileBytes": (1, 104_857_600, 2_097_152), "maxTotalBytes": (1, 104_857_600, 104_857_600), "maxDepth": (4, 256, 32),
    "maxNodes": (1, 100_000, 100_000), "maxEdges": (1, 1_000_000, 1_000_000), "maxFindings": (1, 10_000, 10_000), "maxDurationSeconds": (1, 3_600, 300), "maxOutputBytes": (1_024, 104_857_600, 52_428_800),
}


@dataclass(frozen=True)
class RuleSet:
    identity: str
    name: str
    rules: tuple[Rule, ...]
    fail_on: str = "high"
    limits: dict[str, int] = field(default_factory=dict)

    def budgets(self) -> Limits:
        return Limits(self.limits["maxNodes"], self.limits["maxEdges"], self.limits["maxFindings"])


def _bad(what: str) -> FactError:
    return FactError("config.schema.invalid", what)


def _closed(x: Any, required: set[str], optional: set[str], where: str) -> dict:
    if not isinstance(x, dict) or not required <= set(x) <= required | optional:
        raise _bad(where)
    return x


def _text(x: Any, where: str) -> str:
    if not isinstance(x, str) or not x.strip():
        raise _bad(where)
    return x


def _texts(x: Any, where: str, least: int = 1) -> tuple[str, ...]:
    if not isinstance(x, list) or len(x) < least:
        raise _bad(where)
    return tuple(_text(v, where) for v in x)


def _count(x: Any, low: int, high: int, where: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or not low <= x <= high:
        raise _bad(where)
    return x


def _parameters(name: str, p: dict, common: dict) -> Rule:
    if name == "illegal-package-dependency":
        rows = _closed(p, {"policies"}, set(), name)["policies"]
        return PackageRule(policies=tuple(Policy(_text(r["source"], "source"), _texts(r.get("allowedTargets", []), "targets", 0), _texts(r.get("deniedTargets", []), "targets", 0)) for x in (rows or [None]) for r in [_closed(x, {"source"}, {"allowedTargets", "deniedTargets"}, "policy")]), **common)
    if name == "layered-architecture":
        _closed(p, {"layers"}, {"allowLayerSkipping"}, name)
        skip = p.get("allowLayerSkipping", False)
        if not isinstance(skip, bool) or not isinstance(p["layers"], list):
            raise _bad("layers")
        return LayerRule(layers=tuple((_text(x["name"], "layer"), _texts(x["packages"], "packages")) for y in p["layers"] for x in [_closed(y, {"name", "packages"}, set(), "layer")]), allow_skipping=skip, **common)
    if name == "dependency-cycle":
        scope = _closed(p, {"scope"}, set(), name)["scope"]
        if scope not in ("component", "package", "module"):
            raise _bad("scope")
        return CycleRule(scope=scope, **common)
    if name == "controller-repository-access":
        _closed(p, set(), set(), name)
        return ControllerRule(**common)
    if name == "internal-module-access":
        rows = _closed(p, {"boundaries"}, set(), name)["boundaries"]
        return BoundaryRule(boundaries=tuple((_text(x["modulePath"], "modulePath"), _texts(x["publicPackages"], "packages")) for y in (rows or [None]) for x in [_closed(y, {"modulePath", "publicPackages"}, set(), "boundary")]), **common)
    if name == "forbidden-component":
        rows = _closed(p, {"selectors"}, set(), name)["selectors"]
        out = []
        for x in rows or [None]:
            if not isinstance(x, dict) or len(x) != 1 or not set(x) <= {"type", "package", "maven"}:
                raise _bad("selector")
            out += [f"{k}:{_text(v, k)}" for k, v in x.items()]
        return ForbiddenRule(selectors=tuple(out), **common)
    if name == "complexity-threshold":
        keys = ("functionThreshold", "typeThreshold", "moduleThreshold")
        _closed(p, set(), set(keys), name)
        return ComplexityRule(**{k[:-9]: _count(p[k], 1, 2**31 - 1, k) for k in keys if k in p}, **common)
    if name == "required-annotation":
        rows = _closed(p, {"requirements"}, set(), name)["requirements"]
        return AnnotationRule(requirements=tuple(Requirement(_text(x["annotation"], "annotation"), _texts(x["componentKinds"], "kinds"), _texts(x.get("declarationKinds", []), "kinds", 0), _texts(x.get("packages", []), "packages", 0)) for y in (rows or [None]) for x in [_closed(y, {"annotation", "componentKinds"}, {"declarationKinds", "packages"}, "requirement")]), **common)
    raise _bad(f"rule {name}")


def bind(doc: Any) -> RuleSet:
    """A parsed document as a rule set; a FactError (config.schema.invalid or config.value.invalid) tells what is wrong."""
    _closed(doc, {"version", "project", "rules"}, {"failOn", "limits"}, "root")
    if doc["version"] != "0.1.0":
        raise _bad("version")
    project = _closed(doc["project"], {"identity", "name"}, set(), "project")
    fail_on = doc.get("failOn", "high")
    if fail_on not in SEVERITIES[1:]:
        raise _bad("failOn")
    given = _closed(doc.get("limits", {}), set(), set(LIMITS), "limits")
    limits = {k: _count(given.get(k, d), lo, hi, k) for k, (lo, hi, d) in LIMITS.items()}
    if limits["maxTotalBytes"] < limits["maxFileBytes"]:
        raise FactError("config.value.invalid", "maxTotalBytes")
    if not isinstance(doc["rules"], list) or not 1 <= len(doc["rules"]) <= 8:
        raise _bad("rules")
    rules = []
    for r in doc["rules"]:
        _closed(r, {"id"}, {"severity", "parameters"}, "rule")
        space, _, name = _text(r["id"], "id").rpartition(".")
        if not re.fullmatch(r"[a-z][a-z0-9]*", space) or (name == "controller-repository-access") != (space == "spring"):
            raise _bad(f"rule {r['id']}")
        common: dict[str, Any] = {"namespace": space}
        if "severity" in r:
            if r["severity"] not in SEVERITIES[1:]:
                raise _bad("severity")
            common["severity"] = r["severity"]
        rules.append(_parameters(name, r.get("parameters") or {}, common))
    if len({r.rule_id for r in rules}) < len(rules):
        raise FactError("rule.config.duplicate-rule")
    return RuleSet(_text(project["identity"], "identity"), _text(project["name"], "name"), tuple(sorted(rules, key=lambda r: r.rule_id)), fail_on, limits)


def parse(raw: bytes) -> RuleSet:
    """A YAML document of 1 byte to 1 MiB in UTF-8, without anchors, aliases, tags, repeated keys or further documents."""
    try:
        import yaml
    except ImportError as e:  # the reader is optional; bind() takes parsed documents
        raise FactError("config.read.failed", "no YAML reader is installed") from e
    if len(raw) > MAX_BYTES:
        raise FactError("config.limit.bytes")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise FactError("config.encoding.invalid") from e
    if not text.strip():
        raise FactError("config.yaml.empty")
    try:
        for t in yaml.scan(text):
            if isinstance(t, (yaml.AnchorToken, yaml.AliasToken, yaml.TagToken)):
                raise FactError("config.yaml.reference")
        nodes = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise FactError("config.yaml.invalid") from e
    if len(nodes) != 1:
        raise FactError("config.yaml.invalid", "one document")

    def plain(node: Any) -> Any:
        if isinstance(node, yaml.MappingNode):
            keys = [k.value for k, _ in node.value]
            if len(set(map(str, keys))) < len(keys):
                raise FactError("config.yaml.invalid", "repeated key")
            return {k: plain(v) for k, (_, v) in zip(keys, node.value)}
        if isinstance(node, yaml.SequenceNode):
            return [plain(x) for x in node.value]
        return yaml.SafeLoader("").construct_object(node) if node.tag.rsplit(":", 1)[-1] in ("int", "bool", "null") else node.value

    return bind(plain(nodes[0]))


def load(path: str | Path) -> RuleSet:
    p = Path(path)
    if p.is_symlink() or not p.is_file():
        raise FactError("config.path.invalid")
    return parse(p.read_bytes())

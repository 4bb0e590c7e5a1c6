"""The eight rules. Each compiles its parameters to expressions over the shared edge facts, or over components and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.functions.selectors import any_package, check_package, coordinate_matches, package_matches
from factloom.plans import graph
from factloom.plans.model import SEVERITIES, FactError, FactModel, JoinedModel, component_facts
from factloom.session import kept, sent

#: Default namespace of rule ids and of the extension keys on findings; a rule document may use another.
NAMESPACE = "arch"
RULE_VERSION = "0.1.0"
#: The framework's annotations.
CONTROLLERS = ("org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController")
REPOSITORY = "org.springframework.stereotype.Repository"


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise FactError("config.value.invalid", what)


def _unique(xs, what: str) -> None:
    xs = list(xs)
    _need(len(set(xs)) == len(xs), f"{what} must be unique")


def _packages(*groups) -> None:
    for g in groups:
        for p in g:
            try:
                check_package(p)
            except ValueError as e:
                raise FactError("config.value.invalid", str(e)) from e


@dataclass(frozen=True)
class Policy:
    source: str
    allowed: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    severity: str = "high"
    name: str = field(default="", init=False)
    namespace: str = NAMESPACE

    @property
    def rule_id(self) -> str:
        return f"{self.namespace}.{self.name}"

    def __post_init__(self) -> None:
        _need(self.severity in SEVERITIES[1:], f"severity {self.severity}")
        self.check()

    def check(self) -> None: ...

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        raise NotImplementedError

    def diagnostics(self, f: FactModel, edges: DataFrame) -> DataFrame | None:
        return None

    def precheck(self, f: FactModel, edges: DataFrame) -> None: ...

    def _edge(self, rows: DataFrame, violation: Column, message: Column) -> DataFrame:
        """M1: the draft of a finding on an edge; drafts become findings in finish()."""
        parts = F.concat_ws("|", "source_id", "dependency_kind", "target_id", "dependency_id")
        rows = rows.withColumn("_v", violation).where(F.col("_v").isNotNull())
        return rows.select(
            "project_id", F.col("dependency_id").alias("subject_id"), "evidence_ids", F.col("_v").alias("violation"), parts.alias("parts"), message.alias("message"),
            F.create_map(F.lit(f"{self.namespace}.violation"), F.array("_v")).alias("extensions"), *(["location"] if "location" in rows.columns else []),
        )


@dataclass(frozen=True)
class PackageRule(Rule):
    policies: tuple[Policy, ...] = ()
    name = "illegal-package-dependency"

    def check(self) -> None:
        _need(bool(self.policies), "policies")
        _unique((p.source for p in self.policies), "policy sources")
        for p in self.policies:
            _packages((p.source,), p.allowed, p.denied)
            _need(bool(p.allowed or p.denied), "a policy needs targets")

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        s, t = F.col("source_package"), F.col("target_package")
        denied = unlisted = F.lit(False)
        for p in self.policies:
            here = package_matches(p.source, s)
            denied = denied | (here & any_package(p.denied, t))
            if p.allowed:
                unlisted = unlisted | (here & ~any_package(p.allowed, t))
        v = F.when(s != t, F.when(denied, "denied-package-dependency").when(unlisted, "unlisted-package-dependency"))
        end = F.when(denied, "is denied").otherwise("is not allowed")
        return self._edge(edges.where("source_package <> target_package"), v, F.concat(F.lit("Package dependency from "), s, F.lit(" to "), t, F.lit(" "), end))


@dataclass(frozen=True)
class LayerRule(Rule):
    layers: tuple[tuple[str, tuple[str, ...]], ...] = ()
    allow_skipping: bool = False
    name = "layered-architecture"

    def check(self) -> None:
        _need(len(self.layers) >= 2, "at least two layers")
        _unique((n for n, _ in self.layers), "layer names")
        _unique((p for _, ps in self.layers for p in ps), "layer selectors")
        for _, ps in self.layers:
            _need(bool(ps), "a layer needs packages")
            _packages(ps)

    def layer(self, package: Column) -> Column:
        """Indexes of the layers that match."""
        return F.filter(F.array(*(F.when(any_package(ps, package), i) for i, (_, ps) in enumerate(self.layers))), lambda x: x.isNotNull())

    def precheck(self, f: FactModel, edges: DataFrame) -> None:
        twice = lambda c: F.size(self.layer(F.col(c))) > 1
        # an edge has the packages of two components: where no component has two layers, the edges need not be worked out
        if component_facts(f).where(twice("package")).isEmpty():
            return
        if not edges.where(twice("source_package") | twice("target_package")).isEmpty():
            raise FactError("rule.config.layer-overlap")

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        rows = edges.where("source_package is not null and target_package is not null").withColumn("_s", F.get(self.layer(F.col("source_package")), 0)).withColumn("_t", F.get(self.layer(F.col("target_package")), 0))
        v = F.when(F.col("_t") < F.col("_s"), "reverse-layer-dependency")
        if not self.allow_skipping:
            v = v.when(F.col("_t") > F.col("_s") + 1, "skipped-layer-dependency")
        names = F.array(*(F.lit(n) for n, _ in self.layers))
        return self._edge(rows, v, F.concat(F.lit("Layer "), F.get(names, F.col("_s")), F.lit(" must not depend on layer "), F.get(names, F.col("_t"))))


@dataclass(frozen=True)
class CycleRule(Rule):
    scope: str = "component"
    name = "dependency-cycle"

    def check(self) -> None:
        _need(self.scope in ("component", "package", "module"), "scope")

    def quotient(self, f: FactModel, edges: DataFrame) -> DataFrame:
        """Edges between the scope's nodes; folding drops edges within a node, but keeps parallel ones."""
        place = ["location"] if "location" in edges.columns else []
        if self.scope == "component":
            return edges.select("project_id", "source_id", "target_id", "dependency_id", "evidence_ids", *place, F.col("source_qualified_name").alias("label"))
        col = {"package": "package", "module": "artifact_id"}[self.scope]
        rows = edges.select("project_id", F.col(f"source_{col}").alias("source_id"), F.col(f"target_{col}").alias("target_id"), "dependency_id", "evidence_ids", *place).where("source_id <> target_id")
        if self.scope == "package":
            return rows.withColumn("label", F.col("source_id"))
        names = f.artifact.select("project_id", F.col("id").alias("source_id"), F.col("qualified_name").alias("label"))
        return rows.join(names, ["project_id", "source_id"])

    def _inside(self, f: JoinedModel) -> DataFrame:
        """The edges on cycles, a row for each evidence, brought together per cycle by their keys; ids are made there."""
        rows = kept(f.links.rows)
        on = kept(graph.cyclic_nodes(f.links.graph(rows)))
        n = on.count()
        for c in ("source_key", "target_key"):
            rows = rows.join(sent(on.select(F.col("node").alias(c), F.col("scc").alias(f"_{c}")), n), c)
        rows = rows.where("_source_key = _target_key").withColumnRenamed("_source_key", "scc").drop("_target_key").repartition("scc")
        return f.links.dress(rows).select("project_id", "scc", "source_id", F.col("source_qualified_name").alias("label"), "dependency_id", F.array("evidence_id").alias("evidence_ids"), "location")

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        if self.scope == "component" and isinstance(f, JoinedModel):
            inside = self._inside(f)
        else:
            inside = graph.cyclic_edges(self.quotient(f, edges))
        # every node of a cycle is the source of one of its edges
        nodes = F.array_sort(F.collect_set(F.struct(F.col("source_id"), F.col("label"))))
        # finish() takes the place of the smallest evidence, which is that of its edge
        place = [F.min(F.struct(F.array_min("evidence_ids").alias("e"), "location")).alias("first")] if "location" in inside.columns else []
        per = inside.groupBy("project_id", "scc").agg(
            nodes.alias("nodes"), F.array_sort(F.collect_set("dependency_id")).alias("deps"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_ids")))).alias("evidence_ids"), *place,
        )
        ids = F.array_sort(F.array_distinct(F.transform("nodes", lambda x: x["source_id"])))
        labels = F.array_distinct(F.transform("nodes", lambda x: x["label"]))
        return per.select(
            "project_id", F.get("deps", 0).alias("subject_id"), "evidence_ids", F.lit(f"cycle-{self.scope}").alias("violation"),
            F.concat_ws("|", F.array_join(ids, "|"), F.array_join("deps", "|")).alias("parts"),
            F.concat(F.lit(f"Dependency cycle detected in {self.scope} scope: "), F.array_join(labels, ", ")).alias("message"),
            F.create_map(F.lit(f"{self.namespace}.graph-scope"), F.array(F.lit(self.scope))).alias("extensions"), *(["first.location"] if place else []),
        )


@dataclass(frozen=True)
class ControllerRule(Rule):
    namespace: str = "spring"
    controllers: tuple[str, ...] = CONTROLLERS
    repository: str = REPOSITORY
    name = "controller-repository-access"

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        edges = edges.where("source_component_kind = 'type' and target_component_kind = 'type'")
        hit = F.arrays_overlap("source_annotations", F.array(*map(F.lit, self.controllers))) & F.array_contains("target_annotations", self.repository)
        message = F.concat(F.lit("Spring Controller "), "source_qualified_name", F.lit(" must not directly access Repository "), "target_qualified_name")
        return self._edge(edges, F.when(hit, self.name), message)


@dataclass(frozen=True)
class BoundaryRule(Rule):
    boundaries: tuple[tuple[str, tuple[str, ...]], ...] = ()
    name = "internal-module-access"

    def check(self) -> None:
        _need(bool(self.boundaries), "boundaries")
        _unique((m for m, _ in self.boundaries), "module paths")
        for _, ps in self.boundaries:
            _need(bool(ps), "public packages")
            _packages(ps)

    def _rows(self, edges: DataFrame) -> DataFrame:
        public = known = F.lit(False)
        for m, ps in self.boundaries:
            here = F.col("module_path") == m
            known, public = known | here, public | (here & any_package(ps, F.col("target_package")))
        rows = edges.where("source_artifact_id <> target_artifact_id and target_package is not null")
        return rows.withColumn("_known", known).withColumn("_public", public)

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        v = F.when(F.col("_known") & ~F.col("_public"), self.name)
        return self._edge(self._rows(edges), v, F.concat(F.lit("Cross-module dependency targets internal package "), F.col("target_package")))

    def diagnostics(self, f: FactModel, edges: DataFrame) -> DataFrame:
        return self._rows(edges).where("not _known").select("project_id", F.lit("rule.module-boundary.missing").alias("code"), F.col("target_artifact_id").alias("subject_id"), F.lit("target Maven module has no public API boundary configuration").alias("message"))


@dataclass(frozen=True)
class ForbiddenRule(Rule):
    selectors: tuple[str, ...] = ()  # maven:<g:a[:v]>, package:<selector>, type:<name>
    name = "forbidden-component"

    def check(self) -> None:
        _need(bool(self.selectors), "selectors")
        _unique(self.selectors, "selectors")
        for s in self.selectors:
            kind, _, x = s.partition(":")
            _need(kind in ("maven", "package", "type") and bool(x), s)
            if kind == "package":
                _packages((x,))
            _need(kind != "maven" or (x.count(":") in (1, 2) and all(p.strip() for p in x.split(":"))), s)

    def matched(self) -> Column:
        """The first selector, in canonical order, that the target matches."""
        out = None
        for s in sorted(self.selectors):
            kind, _, x = s.partition(":")
            hit = {"maven": lambda: coordinate_matches(x, F.col("coordinate")), "package": lambda: package_matches(x, F.col("target_package")), "type": lambda: F.col("target_qualified_name") == x}[kind]()
            out = F.when(hit, s) if out is None else out.when(hit, s)
        return out

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        rows = edges.withColumn("_m", self.matched())
        return self._edge(rows, F.when(F.col("_m").isNotNull(), self.name), F.concat(F.lit("Dependency targets forbidden component selector "), F.col("_m")))

    def diagnostics(self, f: FactModel, edges: DataFrame) -> DataFrame:
        maven = [s for s in self.selectors if s.startswith("maven:")]
        full = any(s.count(":") == 3 for s in maven)
        code = F.when(F.lit(bool(maven)) & F.col("coordinate_unresolved"), "rule.maven-coordinate.unresolved").when(F.lit(full) & F.col("version_unresolved"), "rule.maven-version.unresolved")
        text = F.when(F.col("code") == "rule.maven-coordinate.unresolved", "target Maven coordinate could not be resolved deterministically").otherwise("target Maven version could not be resolved for a version-specific selector")
        return edges.where(self.matched().isNull()).withColumn("code", code).where("code is not null").select("project_id", "code", F.col("target_artifact_id").alias("subject_id"), text.alias("message"))


@dataclass(frozen=True)
class ComplexityRule(Rule):
    severity: str = "medium"
    function: int | None = None
    type: int | None = None
    module: int | None = None
    name = "complexity-threshold"

    def check(self) -> None:
        given = [x for x in (self.function, self.type, self.module) if x is not None]
        _need(bool(given) and min(given) >= 1, "thresholds")

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        comp = f.component.select("project_id", F.col("id").alias("scope_id"), F.col("kind").alias("_kind"))
        art = f.artifact.select("project_id", F.col("id").alias("scope_id"), F.lit("module").alias("_module"))
        m = f.metric.where("key = 'complexity.cyclomatic'").join(comp, ["project_id", "scope_id"], "left").join(art, ["project_id", "scope_id"], "left")
        scope = F.when(F.col("_kind").isin("function", "type"), F.col("_kind")).when(F.col("_kind").isNull(), F.col("_module"))
        most = F.when(F.col("scope") == "function", self.function).when(F.col("scope") == "type", self.type).when(F.col("scope") == "module", self.module).cast("int")
        rows = m.withColumn("scope", scope).withColumn("most", most).where(F.col("value") > F.col("most")).withColumn("text", ident.decimal_text("value"))
        evidence = F.flatten(F.transform(F.filter(F.map_entries("extensions"), lambda e: e["key"].endswith(".evidence-id")), lambda e: e["value"]))
        return rows.select(
            "project_id", F.col("scope_id").alias("subject_id"), evidence.alias("evidence_ids"), F.concat(F.lit("complexity-threshold-"), "scope").alias("violation"),
            F.concat_ws("|", "scope", "scope_id", "text", "most").alias("parts"),
            F.concat(F.lit("Cyclomatic complexity "), "text", F.lit(" exceeds "), "scope", F.lit(" threshold "), "most").alias("message"),
            F.create_map(F.lit(f"{self.namespace}.metric"), F.array("key"), F.lit(f"{self.namespace}.threshold"), F.array(F.col("most").cast("string"))).alias("extensions"),
        )


@dataclass(frozen=True)
class Requirement:
    annotation: str
    kinds: tuple[str, ...]
    declarations: tuple[str, ...] = ()
    packages: tuple[str, ...] = ()


@dataclass(frozen=True)
class AnnotationRule(Rule):
    severity: str = "medium"
    requirements: tuple[Requirement, ...] = ()
    name = "required-annotation"

    def check(self) -> None:
        _need(bool(self.requirements), "requirements")
        _unique(self.requirements, "requirements")
        for r in self.requirements:
            _need("." in r.annotation and bool(r.kinds) and set(r.kinds) <= {"type", "function"}, r.annotation)
            _packages(r.packages)

    def _rows(self, f: FactModel) -> DataFrame:
        """Components with each requirement that applies; the requirements are an array in the plan, so there is no join."""
        def one(r: Requirement) -> Column:
            ok = F.col("component_kind").isin(*r.kinds)
            if r.declarations:
                ok = ok & F.coalesce(F.col("declaration_kind").isin(*r.declarations), F.lit(False))
            if r.packages:
                ok = ok & any_package(r.packages, F.col("package"))
            return F.when(ok, r.annotation)

        return component_facts(f).select("*", F.explode(F.array_compact(F.array(*map(one, self.requirements)))).alias("required"))

    def findings(self, f: FactModel, edges: DataFrame) -> DataFrame:
        rows = self._rows(f).where(F.col("resolved") & ~F.array_contains("annotations", F.col("required")))
        return rows.select(
            "project_id", F.col("id").alias("subject_id"), F.array("declaration_evidence_id").alias("evidence_ids"), F.lit(self.name).alias("violation"),
            F.concat_ws("|", "id", "required").alias("parts"), F.concat(F.lit("Component "), "qualified_name", F.lit(" requires annotation "), "required").alias("message"),
            F.create_map(F.lit(f"{self.namespace}.required-annotation"), F.array("required")).alias("extensions"),
        )

    def diagnostics(self, f: FactModel, edges: DataFrame) -> DataFrame:
        return self._rows(f).where("not resolved").select("project_id", F.lit("rule.annotation.unresolved").alias("code"), F.col("id").alias("subject_id"), F.lit("required annotation could not be evaluated because annotation resolution is incomplete").alias("message"))


def finish(rule: Rule, drafts: DataFrame, f: FactModel) -> DataFrame:
    """Drafts to findings: sorted distinct evidence, the first one's location, fingerprint and id."""
    d = drafts.withColumn("evidence_ids", F.array_sort(F.array_distinct("evidence_ids"))).withColumn("_e", F.get("evidence_ids", 0))
    if "location" not in d.columns:
        d = d.join(f.evidence.select("project_id", F.col("id").alias("_e"), "location"), ["project_id", "_e"], "left")
    d = d.join(f.project.select("project_id", "identity", "language"), "project_id")
    print_ = ident.fingerprint(F.lit(rule.rule_id), F.lit(RULE_VERSION), "identity", "violation", "parts")
    d = d.withColumn("fingerprint", print_)
    name = F.concat(F.lit(rule.rule_id + "|"), F.col("fingerprint"))
    return d.select(
        "project_id", ident.stable_id("finding", "identity", "language", F.col("location.path"), name).alias("id"), "fingerprint", F.lit(rule.rule_id).alias("rule_id"), F.lit(RULE_VERSION).alias("rule_version"),
        F.lit(rule.severity).alias("severity"), "subject_id", "message", "location", "evidence_ids", "extensions",
    )

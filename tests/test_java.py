"""Java folders to facts: discovery with its guards and limits, the declaration scanner, name resolution, complexity and edges."""

import os

import pytest

from factloom.plans.model import FactError, violations
from factloom.sources import discovery, javafacts
from factloom.sources.javasource import Unreadable, declared

SERVICE = """package shop.core;
import shop.data.Store; import shop.util.*; import other.Marker;
@Marker public class Service extends Base<Item> implements Runner {
  private final Store store = new Store();
  @Deprecated public int run(final java.util.List<? super Item> xs, Item t[], String... more) {
    if (xs == null || more.length > 1 && t != null) { for (Item i : t) { } }
    Runnable r = new Runnable() { public void run() { while (true) { break; } } };
    do { } while (false);
    switch (more.length) { case 1, 2: break; case 3: default: }
    return xs.isEmpty() ? Inner.class.hashCode() : store.size();
  }
  <Item> void generic(Item x) { class Local { void lost() { if (true) { } } } }
  static class Inner { Inner() throws Failure { } @Missing void odd() { } }
  enum Kind implements Runner { A, B { void f() { try { } catch (Failure e) { } } }; }
}
"""
FILES = {
    "pom.xml": "<project/>", "data/pom.xml": "<project/>",
    "src/main/java/shop/core/Service.java": SERVICE,
    "src/main/java/shop/core/Base.java": "package shop.core; abstract class Base<T> { abstract void f(); }",
    "src/main/java/shop/core/Runner.java": "package shop.core; interface Runner { }",
    "src/main/java/shop/util/Item.java": "package shop.util; public record Item(int n) { Item { if (n < 0) throw new IllegalArgumentException(); } }",
    "src/main/java/shop/util/Failure.java": "package shop.util; @javax.annotation.Generated(\"x\") public class Failure extends Exception { void g() { if (true) { } } }",
    "data/src/main/java/shop/data/Store.java": "package shop.data; public class Store { int size() { return shop.util.Item.class.getModifiers(); } }",
    "src/main/java/twice/A.java": "package twice; class A { }", "src/main/java/twice/B.java": "package twice; class A { } class C { }",
    "src/main/java/bad/Open.java": "class Open {", "src/main/java/build/In.java": "package build; class In { }",
    "target/src/main/java/x/Skipped.java": "class Skipped { }", "nopom/src/main/java/x/Dropped.java": "class Dropped { }", "src/test/java/T.java": "class T { }",
}


@pytest.fixture()
def repo(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/main/java/bad/Latin.java").write_bytes(b"class Latin { String s = \"\xe9\"; }")
    os.symlink(tmp_path / "src/main/java/bad/Open.java", tmp_path / "src/main/java/bad/Link.java")
    os.mkfifo(tmp_path / "src/main/java/bad/Pipe.java")
    return tmp_path


def test_discovery(repo):
    got = discovery.discover(str(repo))
    assert {(p, m) for p, m, _ in got.files} == {(p, "data" if p.startswith("data") else ".") for p in FILES if "/java/" in p and not p.startswith(("target", "nopom", "src/test"))} | {("src/main/java/bad/Latin.java", ".")}
    assert [(c, p) for c, p, *_ in got.diagnostics] == [("java.path.special-file", "src/main/java/bad/Pipe.java"), ("java.path.symlink", "src/main/java/bad/Link.java")]
    assert got.poms == ["data/pom.xml", "pom.xml"]


@pytest.mark.parametrize("limits,code", [({"max_files": 3}, "files"), ({"max_file_bytes": 20}, "file-bytes"), ({"max_depth": 3}, "depth"), ({"max_file_bytes": 1200, "max_total_bytes": 1200}, "total-bytes")])
def test_limits_fail_the_scan(repo, limits, code):
    with pytest.raises(FactError) as e:
        discovery.discover(str(repo), discovery.ScanLimits(**limits))
    assert e.value.code == f"java.limit.{code}"


def test_bad_roots(repo, tmp_path):
    os.symlink(repo / "src", repo / "to-src")
    for root, code in ((repo / "to-src", "java.path.root-symlink"), (repo / "pom.xml", "java.path.invalid-root"), (repo / "none", "java.path.invalid-root")):
        with pytest.raises(FactError) as e:
            discovery.discover(str(root))
        assert e.value.code == code


def test_facts_of_a_folder(spark, repo):
    found = discovery.discover(str(repo))
    paths = spark.createDataFrame([("p", p, m) for p, m, _ in found.files], "project_id string, path string, module_path string")
    files, unread = discovery.read_texts(spark, str(repo), paths)
    assert [(r.code, r.path) for r in unread.collect()] == [("java.encoding.invalid", "src/main/java/bad/Latin.java")]
    model, diagnostics = javafacts.facts(files, spark.createDataFrame([("p", "shop", "Shop")], "project_id string, identity string, name string"))
    assert violations(model).count() == 0
    comps = {r.qualified_name: r for r in model.component.collect()}
    service = "shop.core.Service"
    assert {n for n in comps if n.startswith(service)} == {
        service, f"{service}#run(java.util.List<?superItem>,Item[],String...)", f"{service}#run()", f"{service}#generic(Item)", f"{service}.Inner", f"{service}.Inner#<init>()", f"{service}.Inner#odd()", f"{service}.Kind", f"{service}.Kind#f()"}
    assert "twice.A" not in comps and "twice.C" in comps and "build.In" in comps
    assert comps[service].extensions["java.annotations"] == ["other.Marker"] and comps[service].extensions["java.modifiers"] == ["public"]
    assert comps[f"{service}.Inner#odd()"].extensions["java.annotation-resolution"] == ["incomplete"]
    assert comps["shop.util.Failure"].extensions["java.generated"] == ["true"]
    ids = {r.id: n for n, r in comps.items()} | {r.id: r.qualified_name for r in model.artifact.collect()}
    value = {ids[r.scope_id]: int(r.value) for r in model.metric.collect()}
    run = f"{service}#run(java.util.List<?superItem>,Item[],String...)"
    assert (value[run], value[f"{service}#run()"], value[f"{service}#generic(Item)"], value[f"{service}.Kind#f()"]) == (9, 2, 1, 2)
    assert value[service] == 12 and value["shop.core.Runner"] == 0 and "shop.util.Failure" not in value
    assert value["shop:data"] == 1 and value["shop:."] == 12 + 2 + 2 + 1
    # names are tried below what encloses a type, not below the type itself, so Inner is not found from Service
    edges = {(ids[r.source_id], r.kind, ids[r.target_id]) for r in model.dependency.collect()}
    assert edges == {
        (service, "extends", "shop.core.Base"), (service, "implements", "shop.core.Runner"), (service, "depends-on", "shop.data.Store"), (service, "depends-on", "shop.util.Item"),
        (f"{service}.Inner", "depends-on", "shop.util.Failure"), (f"{service}.Kind", "implements", "shop.core.Runner"), (f"{service}.Kind", "depends-on", "shop.util.Failure"), ("shop.data.Store", "depends-on", "shop.util.Item")}
    assert sorted((r.code, r.path.split("/")[-1], r.line) for r in diagnostics.collect()) == [
        ("java.annotation.unresolved", "Service.java", 13), ("java.syntax.invalid", "Open.java", 1), ("java.type.duplicate", "A.java", 1), ("java.type.duplicate", "B.java", 1)]


def test_empty_tables_give_an_empty_model(spark):
    files = spark.createDataFrame([("p", "a", ".", None)], "project_id string, path string, module_path string, text string")
    model, diagnostics = javafacts.facts(files, spark.createDataFrame([("p", "i", "n")], "project_id string, identity string, name string"))
    assert model.component.count() == model.metric.count() == diagnostics.count() == 0


@pytest.mark.parametrize("text", ["class A", "class A { int f( { } }", "class A { ) }", "class { }", "import a", "int x;", 'class A { String s = "x; }', "class A { int }", "class A { enum E { A B } }", "package a"])
def test_what_cannot_be_read_is_said(text):
    with pytest.raises(Unreadable):
        declared(text)


POMS = {
    "pom.xml": "<project xmlns='http://maven.apache.org/POM/4.0.0'>\n<groupId>org.shop</groupId><artifactId>root</artifactId><version>1.0</version>\n<properties><lib.version>2.5</lib.version><x>parent</x></properties></project>",
    "a/pom.xml": "<project>\n<parent><groupId>org.shop</groupId><artifactId>root</artifactId><version>1.0</version></parent>\n<artifactId>a</artifactId><properties><x>own</x></properties>\n<dependencies>\n"
    "<dependency><groupId>${project.groupId}</groupId><artifactId>b</artifactId><version>${project.version}</version></dependency>\n"
    "<dependency><groupId>ext</groupId><artifactId>lib-${x}</artifactId><version>${lib.version}</version><scope>runtime</scope></dependency>\n"
    "<dependency><groupId>junit</groupId><artifactId>junit</artifactId><scope>test</scope></dependency>\n<dependency><groupId>${none}</groupId><artifactId>q</artifactId></dependency>\n</dependencies></project>",
    "b/pom.xml": "<project><parent><groupId>org.shop</groupId><artifactId>root</artifactId><version>1.0</version><relativePath>../../x/pom.xml</relativePath></parent><artifactId>b</artifactId></project>",
    "c/pom.xml": "<!DOCTYPE project [<!ENTITY e 'x'>]><project><groupId>g</groupId><artifactId>&e;</artifactId></project>",
    "a/src/main/java/p/A.java": "package p; class A { }", "b/src/main/java/p/B.java": "package p; class B { }", "c/src/main/java/p/C.java": "package p; class C { }",
}


def test_scan_with_poms(spark, tmp_path):
    from factloom.sources.scan import scan

    for path, text in POMS.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    model, diagnostics = scan(spark, str(tmp_path), "shop", "Shop")
    assert violations(model).count() == 0
    arts = {r.qualified_name: r.extensions for r in model.artifact.collect()}
    assert arts["shop:a"]["maven.coordinate"] == ["org.shop:a:1.0"] and arts["shop:c"]["maven.coordinate-unresolved"] == ["true"]
    assert arts["ext:lib-own:2.5"]["maven.external"] == ["true"] and len(arts) == 4
    ids = {r.id: r.qualified_name for r in model.component.collect()}
    edges = {(ids[r.source_id], ids[r.target_id], r.extensions["maven.scope"][0], len(r.evidence_ids)) for r in model.dependency.collect()}
    assert edges == {("org.shop:a:1.0", "org.shop:b:1.0", "compile", 1), ("org.shop:a:1.0", "ext:lib-own:2.5", "runtime", 1)}
    lines = {r.location.start_line for r in model.evidence.where("kind = 'configuration'").collect()}
    assert lines == {5, 6}
    assert sorted((r.code, r.path, r.line) for r in diagnostics.collect()) == [("maven.dependency.unresolved", "a/pom.xml", 8), ("maven.parent.outside-root", "b/pom.xml", 1), ("maven.pom.invalid", "c/pom.xml", 1)]


@pytest.mark.parametrize("text", ["", "<project>", "<!DOCTYPE project><project/>", "<project>&x;</project>", "<a/><b/>"])
def test_unsafe_poms_are_refused(text):
    from factloom.sources.mavenfacts import read_pom

    assert read_pom(text) is None

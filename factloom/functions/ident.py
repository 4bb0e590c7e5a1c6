"""Content-addressed identities and the canonical forms of texts, paths, numbers and extension maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of the fact model; part of every identity.
SCHEMA_VERSION = "0.1.0"
NAMESPACED = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9_-]*)+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c: Column | str) -> Column:
    """Unicode NFC. Spark has no such function, so texts that are not ASCII go through Python."""
    c = _col(c)

    from factloom.functions.unicode import compose

    return F.when(c.rlike(r"\A[\x00-\x7F]*\z"), c).otherwise(compose(c))


def has_control(c: Column | str) -> Column:
    return _col(c).rlike(r"\p{Cc}")


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts, joined by line feeds; null if a part is null."""
    cs = [_col(p) for p in parts]
    return F.sha2(F.concat(*(x for i, c in enumerate(cs) for x in ((F.lit("\n"), c) if i else (c,)))), 256)


def stable_id(kind: str, identity: Column | str, language: Column | str, path: Column | str, name: Column | str) -> Column:
    """kind_<hash> of schema version, project identity, kind, language, repository path and qualified name."""
    return F.concat(F.lit(f"{kind}_"), fingerprint(F.lit(SCHEMA_VERSION), identity, F.lit(kind), F.lower(_col(language)), path, name))


def norm_path(c: Column | str) -> Column:
    """A relative repository path with forward slashes and without `.`; null for an absolute, empty or climbing one."""
    p = F.replace(_col(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: x != ".")
    bad = (p == "") | p.startswith("/") | p.rlike("^[A-Za-z]:") | has_control(p) | F.exists(parts, lambda x: (x == "") | (x == ".."))
    return F.when(~bad, F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/")))


def decimal_text(c: Column | str) -> Column:
    """A decimal without needless zeros."""
    t = _col(c).cast("string")
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def canonical_extensions(c: Column | str) -> Column:
    """An extension map with sorted keys and values; null if a key is not namespaced, or values are empty or repeated."""
    e = F.array_sort(F.transform(F.map_entries(_col(c)), lambda x: F.struct(x["key"].alias("key"), F.array_sort(x["value"]).alias("value"))))
    ok = F.forall(e, lambda x: x["key"].rlike(NAMESPACED) & (F.size(x["value"]) > 0) & (F.size(F.array_distinct(x["value"])) == F.size(x["value"])))
    return F.when(ok, F.map_from_entries(e))


def coordinate(group: Column | str, artifact: Column | str, version: Column | str) -> Column:
    """group:artifact[:version]; concat_ws leaves out a null version."""
    return F.when(_col(group).isNotNull() & _col(artifact).isNotNull(), F.concat_ws(":", _col(group), _col(artifact), _col(version)))


def last_segment(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)

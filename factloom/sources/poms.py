"""POM rows: property interpolation, inherited coordinates, and the parent-child links between projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, filled

#: Fixed value of the model: a value is interpolated in at most so many passes, of which the last must find nothing to replace.
MAX_PASSES = 16
PLACEHOLDER = r"\$\{([^}]+)\}"


def interpolate(value: Column, properties: Column) -> Column:
    """The trimmed value with ${name} replaced from the map until none is left; null if a name is missing or replacing does not end."""
    return _replaced(filled(value), properties)


def _replaced(value: Column, properties: Column) -> Column:
    """interpolate() of a value that is trimmed already."""
    names = lambda v: F.array_distinct(F.regexp_extract_all(v, F.lit(PLACEHOLDER), F.lit(1)))

    def once(v: Column, _pass: Column) -> Column:
        step = F.aggregate(names(v), v, lambda acc, n: F.replace(acc, F.concat(F.lit("${"), n, F.lit("}")), F.try_element_at(properties, n)))
        return F.when(v.isNull() | ~v.contains("${"), v).otherwise(step)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_PASSES - 1)), value, once, lambda d: filled(F.when(F.size(names(d)) == 0, d)))
    # most values hold no placeholder: they never reach the interpreted passes
    return F.when(value.contains("${"), done).otherwise(value)


def coordinates(poms: DataFrame) -> DataFrame:
    """Adds pom_key, parent_key and resolved_version to raw POM rows; each is null if a part of it does not resolve.

    Only a POM's own properties count, and parent.groupId, parent.artifactId and parent.version of its parent element. A blank
    group is inherited from the parent element.
    """
    # trimmed and resolved values are columns of their own, so that no expression works them out twice
    parts = ("group_id", "artifact_id", "pom_version", "parent_group_id", "parent_artifact_id", "parent_version")
    df = poms.withColumns({f"_{c}": filled(c) for c in parts})
    own = F.map_entries(F.coalesce("pom_properties", F.create_map().cast("map<string,string>")))
    given = F.filter(F.array(*(F.struct(F.lit(f"parent.{k}").alias("key"), F.col(c).alias("value")) for k, c in (("groupId", "_parent_group_id"), ("artifactId", "_parent_artifact_id"), ("version", "_parent_version")))), lambda e: e["value"].isNotNull())
    kept = F.filter(own, lambda e: ~F.exists(given, lambda g: g["key"] == e["key"]))
    # the map is built only for rows that have something to replace
    asked = F.concat_ws(" ", *(f"_{c}" for c in parts)).contains("${")
    df = df.withColumn("_props", F.when(asked, F.map_from_entries(F.concat(kept, given))))
    wanted = {
        "_g": F.coalesce("_group_id", "_parent_group_id"), "_a": F.col("_artifact_id"), "_v": F.coalesce("_pom_version", "_parent_version"),
        "_pg": F.col("_parent_group_id"), "_pa": F.col("_parent_artifact_id"),
    }
    df = df.withColumns({c: _replaced(v, F.col("_props")) for c, v in wanted.items()})
    join = lambda g, a: F.when(F.col(g).isNotNull() & F.col(a).isNotNull(), F.concat(g, F.lit(":"), a))
    df = df.withColumns({"pom_key": join("_g", "_a"), "parent_key": join("_pg", "_pa"), "resolved_version": F.col("_v")})
    return df.drop("_props", *wanted, *(f"_{c}" for c in parts))


def latest_links(poms: DataFrame) -> DataFrame:
    """pom_key, parent_key: one row per resolvable project, of the latest scan (ties: the largest parent key, so the result is defined)."""
    return (
        coordinates(poms).where(F.col("pom_key").isNotNull())
        .groupBy("pom_key").agg(F.max(F.struct("scanned_at", "parent_key")).alias("m"))
        .select("pom_key", F.col("m.parent_key").alias("parent_key"))
    )


def _last_scans(poms: DataFrame) -> DataFrame:
    """pom_key, repository_path, dependencies, pom_properties of each project's latest scan (ties: the largest pom_id), written once."""
    best = coordinates(poms).where(F.col("pom_key").isNotNull())
    last = best.groupBy("pom_key").agg(F.max_by(F.struct("repository_path", "dependencies", "pom_properties"), F.struct("scanned_at", "pom_id")).alias("_m"))
    return cut(last.select("pom_key", "_m.*"))


def _dependencies(last: DataFrame) -> DataFrame:
    """Direct dependencies of the scans of _last_scans(), with group, artifact and scope resolved; test scope left out.

    A blank or unresolvable scope counts as compile. project.* and pom.* stand for the project's own coordinates.
    """
    props = F.map_from_entries(F.concat(
        F.filter(F.map_entries(F.coalesce("pom_properties", F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin("project.groupId", "pom.groupId", "project.artifactId", "pom.artifactId")),
        F.array(*(F.struct(F.lit(f"{p}.{n}Id").alias("key"), F.split("pom_key", ":")[i].alias("value")) for p in ("project", "pom") for i, n in enumerate(("group", "artifact")))).cast("array<struct<key:string,value:string>>"),
    ))
    rows = last.select("pom_key", "repository_path", props.alias("_p"), F.explode("dependencies").alias("d"))
    scope = F.coalesce(interpolate(F.col("d.dep_scope"), F.col("_p")), F.lit("compile"))
    return rows.select(
        F.col("pom_key").alias("source_key"), "repository_path", F.col("d.line_no").alias("line_no"), scope.alias("scope"),
        interpolate(F.col("d.group_id"), F.col("_p")).alias("group"), interpolate(F.col("d.artifact_id"), F.col("_p")).alias("artifact"),
    ).where("scope <> 'test'")


def dependency_edges(poms: DataFrame) -> DataFrame:
    """source_key, target_key, internal, scopes (sorted), n_lines: folded dependencies between projects and libraries.

    internal tells that the target is a project of the table; others are external libraries.
    """
    last = _last_scans(poms)
    known = last.select(F.col("pom_key").alias("target_key"), F.lit(True).alias("_in"))
    rows = _dependencies(last).where("group is not null and artifact is not null").withColumn("target_key", F.concat("group", F.lit(":"), "artifact"))
    return (
        rows.groupBy("source_key", "target_key").agg(F.array_sort(F.collect_set("scope")).alias("scopes"), F.countDistinct("line_no").alias("n_lines"))
        .join(known, "target_key", "left").withColumn("internal", F.coalesce("_in", F.lit(False))).drop("_in")
    )


def unresolved_dependencies(poms: DataFrame) -> DataFrame:
    """code, file_path, line_no of direct dependencies whose group or artifact does not resolve."""
    rows = _dependencies(_last_scans(poms)).where("group is null or artifact is null")
    return rows.select(F.lit("maven.dependency.unresolved").alias("code"), F.col("repository_path").alias("file_path"), "line_no").distinct()

"""Queries that run the scalar operators, POM operators and canonical forms over the domain tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.operators import names
from factloom.session import table
from factloom.sources import discovery, javafacts, poms

Query = Callable[[SparkSession, str], DataFrame]


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", ident.norm_path("repository_path").alias("norm_path")).distinct()


def nfc_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(ident.nfc("text"), 256).alias("nfc_hash"), ident.has_control(F.col("text")).alias("has_control"))


def extension_canonical(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform(F.map_entries(ident.canonical_extensions("extensions")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return table(spark, d, "projects").select("project_id", text.alias("extensions"))


def decimal_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ident.decimal_text(F.col("p_retailprice").cast("decimal(18,4)")).alias("price"))


def fingerprint_project(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "projects")
    return p.select("project_id", ident.fingerprint("project_identity", "project_name").alias("fingerprint"), ident.stable_id("project", "project_identity", F.coalesce("prog_lang", F.lit("java")), F.lit("."), "project_identity").alias("stable_id"))


def maven_coordinate(spark: SparkSession, d: str) -> DataFrame:
    """group:artifact[:version] of each POM row; the version is inherited and resolved like the group."""
    p = poms.coordinates(table(spark, d, "raw_poms")).where("pom_key is not null")
    return p.select("pom_id", F.concat_ws(":", "pom_key", "resolved_version").alias("coordinate")).distinct()


def maven_edges(spark: SparkSession, d: str) -> DataFrame:
    return poms.dependency_edges(table(spark, d, "raw_poms")).select("source_key", "target_key", "internal", F.array_join("scopes", ",").alias("scopes"), "n_lines")


def maven_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return poms.unresolved_dependencies(table(spark, d, "raw_poms"))


def pom_parent_join(spark: SparkSession, d: str) -> DataFrame:
    """Each project with its parent, and whether the parent is a project of the table."""
    links = poms.latest_links(table(spark, d, "raw_poms"))
    up = links.select(F.col("pom_key").alias("parent_key"), F.lit(True).alias("_there"))
    return links.join(up, "parent_key", "left").select("pom_key", "parent_key", F.coalesce("_there", F.lit(False)).alias("parent_known"))


def duplicate_names_dropped(spark: SparkSession, d: str) -> DataFrame:
    return names.unique_or_drop(table(spark, d, "part"), ["p_name", "p_brand"])[0].select("p_partkey", "p_name", "p_brand")


def duplicate_names_reported(spark: SparkSession, d: str) -> DataFrame:
    return names.unique_or_drop(table(spark, d, "part"), ["p_name", "p_brand"])[1].select("p_partkey")


def name_resolution_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Customers' segments and nations resolved to the first of several candidates that is known."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    refs = c.select(F.col("c_custkey").alias("ref"), F.array(F.concat("c_mktsegment", F.lit("."), "n_name"), F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string")), F.col("n_name")).alias("candidates"))
    known = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), "n_nationkey").alias("target"))
    return names.resolve_ranked(refs, known).select("ref", "target", F.col("rank").cast("long").alias("rank"))


def wildcard_unique_match(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.array((F.col("s_nationkey") % 20).cast("string"), F.concat(F.lit("x"), "s_suppkey")).alias("candidates"))
    known = table(spark, d, "nation").select((F.col("n_nationkey") % 20).cast("string").alias("name"), F.col("n_name").alias("target"))
    return names.resolve_unique(refs, known)


def module_argmin_location(spark: SparkSession, d: str) -> DataFrame:
    """The first location of each project's findings by path, line and column; a default where there is none."""
    loc = F.struct(F.col("loc.file_path").alias("path"), F.col("loc.start_line").alias("line"), F.col("loc.start_column").alias("col"))
    m = table(spark, d, "finding_snapshots").groupBy("project_id").agg(F.min(F.when(F.col("loc").isNotNull(), loc)).alias("m"))
    return m.select("project_id", F.coalesce("m.path", F.lit("pom.xml")).alias("path"), F.coalesce("m.line", F.lit(1)).cast("long").alias("line"), F.coalesce("m.col", F.lit(1)).cast("long").alias("col"))


def diagnostics_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_diagnostics").select("diag_code", "file_path", "message").distinct()


def module_of_path(spark: SparkSession, d: str) -> DataFrame:
    """S3: the module of a Java file is what stands before src/main/java, if that folder has a POM; others are dropped."""
    files = table(spark, d, "source_files")
    f = files.select("project_id", ident.norm_path("repository_path").alias("path"))
    scanned = table(spark, d, "raw_poms").select("project_id", ident.norm_path("repository_path").alias("path"))
    told = files.where("module_path is not null").select("project_id", F.concat("module_path", F.lit("/pom.xml")).alias("path"))  # the delivery found a POM there
    return discovery.attributed(f, f.unionByName(scanned).unionByName(told))


def scan_budgets(spark: SparkSession, d: str) -> DataFrame:
    """S5: per project what a scan's budgets count: files, bytes, the largest file and the greatest depth."""
    return discovery.budgets(table(spark, d, "source_files").dropDuplicates(["file_id"]))


def scan_budgets_broken(spark: SparkSession, d: str) -> DataFrame:
    """S5: the budgets of each project that a scan with small limits would break."""
    return discovery.over_budget(discovery.budgets(table(spark, d, "source_files").dropDuplicates(["file_id"])), discovery.ScanLimits(20, 4_000, 20_000, 6))


def _java_files(spark: SparkSession, d: str) -> DataFrame:
    """project_id, path, module_path, text of the latest delivery of each Java file."""
    f = table(spark, d, "source_files").select("project_id", ident.norm_path("repository_path").alias("path"), "file_text", "discovered_at", "file_id").where("path like '%.java' and file_text is not null and project_id is not null")
    last = f.groupBy("project_id", "path").agg(F.max_by("file_text", F.struct("discovered_at", "file_id")).alias("text"))
    module = F.regexp_extract("path", r"^(.*?)/src/main/java/", 1)
    return last.withColumn("module_path", F.when(module == "", ".").otherwise(module))


def _java(spark: SparkSession, d: str):
    who = table(spark, d, "projects").select("project_id", F.col("project_identity").alias("identity"), F.col("project_name").alias("name"))
    return javafacts.facts(_java_files(spark, d), who)


def java_complexity(spark: SparkSession, d: str) -> DataFrame:
    """A3: the cyclomatic complexity of each callable of each Java file."""
    units = javafacts.parsed(_java_files(spark, d)).select("project_id", "path", F.inline("types"))
    calls = units.select("project_id", "path", F.col("qualified").alias("owner"), F.inline("callables"))
    return calls.select("project_id", "path", F.concat("owner", F.lit("#"), "signature").alias("callable"), F.col("complexity").cast("long").alias("complexity"))


def java_components(spark: SparkSession, d: str) -> DataFrame:
    """S7: types and callables of the Java files, with their resolved annotations."""
    c = _java(spark, d)[0].component
    return c.select("project_id", "id", "kind", "qualified_name", F.array_join(F.try_element_at("extensions", F.lit("java.annotations")), ",").alias("annotations"))


def java_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """A1, J12: edges between the types of a project."""
    return _java(spark, d)[0].dependency.select("project_id", "id", "source_id", "target_id", "kind", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def java_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A3 to A5: complexity of callables, types and modules."""
    return _java(spark, d)[0].metric.select("project_id", "scope_id", "key", ident.decimal_text("value").alias("value"))


def java_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _java(spark, d)[1]


_SP = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def _full(c: str) -> str:
    return f"nullif({_trim(c)}, '')"


#: Replacing goes on in a recursive query, as SQL has no loop.
POM_SQL = f"""
WITH RECURSIVE raw AS (SELECT DISTINCT pom_id, {_full("group_id")} AS g, {_full("artifact_id")} AS a, {_full("pom_version")} AS v, {_full("parent_group_id")} AS pg, {_full("parent_artifact_id")} AS pa, {_full("parent_version")} AS pv, pom_properties AS props, dependencies, scanned_at FROM raw_poms),
prop AS (SELECT DISTINCT pom_id, scanned_at, unnest(map_keys(props)) AS k, unnest(map_values(props)) AS v FROM raw),
allprop AS (SELECT pom_id, k, v FROM prop WHERE k NOT IN ('parent.groupId', 'parent.artifactId', 'parent.version')
  UNION SELECT prop.pom_id, k, prop.v FROM prop JOIN raw USING (pom_id) WHERE (k = 'parent.groupId' AND pg IS NULL) OR (k = 'parent.artifactId' AND pa IS NULL) OR (k = 'parent.version' AND pv IS NULL)
  UNION SELECT pom_id, 'parent.groupId', pg FROM raw WHERE pg IS NOT NULL UNION SELECT pom_id, 'parent.artifactId', pa FROM raw WHERE pa IS NOT NULL UNION SELECT pom_id, 'parent.version', pv FROM raw WHERE pv IS NOT NULL),
want AS (SELECT pom_id, 'g' AS what, coalesce(g, pg) AS t FROM raw UNION SELECT pom_id, 'a', a FROM raw UNION SELECT pom_id, 'pg', pg FROM raw UNION SELECT pom_id, 'pa', pa FROM raw UNION SELECT pom_id, 'v', coalesce(v, pv) FROM raw),
step AS (SELECT pom_id, what, t, 0 AS n FROM want WHERE t IS NOT NULL
  UNION ALL SELECT step.pom_id, what, replace(t, '${{' || regexp_extract(t, '\\$\\{{([^}}]+)\\}}', 1) || '}}', allprop.v), n + 1 FROM step JOIN allprop ON allprop.pom_id = step.pom_id AND allprop.k = regexp_extract(t, '\\$\\{{([^}}]+)\\}}', 1)
  WHERE n < 40 AND regexp_matches(t, '\\$\\{{[^}}]+\\}}')),
done AS (SELECT pom_id, what, {_full("t")} AS t FROM step WHERE NOT regexp_matches(t, '\\$\\{{[^}}]+\\}}')),
res AS (SELECT raw.pom_id, raw.scanned_at, raw.dependencies, g.t || ':' || a.t AS pom_key, pg.t || ':' || pa.t AS parent_key, v.t AS version FROM raw
  LEFT JOIN done g ON g.pom_id = raw.pom_id AND g.what = 'g' LEFT JOIN done a ON a.pom_id = raw.pom_id AND a.what = 'a' LEFT JOIN done pg ON pg.pom_id = raw.pom_id AND pg.what = 'pg'
  LEFT JOIN done pa ON pa.pom_id = raw.pom_id AND pa.what = 'pa' LEFT JOIN done v ON v.pom_id = raw.pom_id AND v.what = 'v'),
link AS (SELECT pom_key, parent_key FROM (SELECT *, row_number() OVER (PARTITION BY pom_key ORDER BY scanned_at DESC NULLS LAST, parent_key DESC NULLS LAST) AS rn FROM res WHERE pom_key IS NOT NULL) WHERE rn = 1),
up AS (SELECT link.pom_key, p.pom_key AS parent FROM link LEFT JOIN link p ON link.parent_key = p.pom_key),
"""
P1_SQL = POM_SQL + """
walk AS (SELECT pom_key, parent, pom_key AS root_key, 0 AS node_depth, pom_key AS node_path FROM up WHERE parent IS NULL
  UNION ALL SELECT up.pom_key, up.parent, root_key, node_depth + 1, node_path || ' > ' || up.pom_key FROM walk JOIN up ON up.parent = walk.pom_key),
ahead AS (SELECT up.pom_key AS k, up.pom_key AS here FROM up WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.pom_key = up.pom_key)
  UNION SELECT k, up.parent FROM ahead JOIN up ON up.pom_key = ahead.here),
ring AS (SELECT DISTINCT k FROM ahead JOIN up ON up.pom_key = ahead.here AND up.parent = ahead.k)
SELECT pom_key, root_key, CAST(node_depth AS BIGINT) AS node_depth, node_path FROM walk
UNION ALL SELECT ahead.k, '', -1, string_agg(DISTINCT ahead.here, '|' ORDER BY ahead.here) FROM ahead JOIN ring ON ring.k = ahead.here GROUP BY ahead.k
"""
P2_SQL = f"""
WITH rows AS (SELECT snapshot_no, lower({_trim("finding_id")}) AS finding_id, lower({_trim("severity")}) AS sev, lower({_trim("fingerprint")}) AS fp, loaded_at FROM finding_snapshots),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, finding_id ORDER BY loaded_at DESC) AS rn FROM rows WHERE finding_id <> '') WHERE rn = 1),
nums AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM last)),
now_ AS (SELECT n.snapshot_no, finding_id, sev, fp FROM nums n JOIN last l USING (snapshot_no) WHERE prev IS NOT NULL),
old AS (SELECT n.snapshot_no, finding_id, sev, fp FROM nums n JOIN last l ON l.snapshot_no = n.prev),
found AS (SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.finding_id, o.finding_id) AS finding_id,
  CASE WHEN o.finding_id IS NULL THEN 'added' WHEN n.finding_id IS NULL THEN 'removed' WHEN n.sev IS DISTINCT FROM o.sev OR n.fp IS DISTINCT FROM o.fp THEN 'changed' END AS change_kind
  FROM now_ n FULL JOIN old o ON n.snapshot_no = o.snapshot_no AND n.finding_id = o.finding_id)
"""


_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{2}):(\d{2})(?:\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
_PART = lambda i: f"regexp_extract(t, '{_ISO}', {i})"
_WHEN = f"""CASE WHEN regexp_matches(t, '^\\d{{10}}$|^\\d{{13}}$') THEN epoch_ms(CAST(left(t, 10) AS BIGINT) * 1000)
  WHEN regexp_matches(t, '{_ISO}') THEN try_cast({_PART(1)} || '-' || {_PART(2)} || '-' || {_PART(3)} || ' ' || {_PART(4)} || ':' || {_PART(5)} || ':' || {_PART(6)} AS TIMESTAMP)
    - to_minutes(CASE WHEN {_PART(7)} IN ('', 'Z') THEN 0 ELSE CAST(left({_PART(7)}, 1) || '1' AS INT) * (CAST(substr({_PART(7)}, 2, 2) AS INT) * 60 + CAST(right({_PART(7)}, 2) AS INT)) END) END"""
P4_SQL = f"""
WITH k AS (SELECT *, replace(lower(regexp_replace(ext_key, '{_SP}+', '', 'g')), '_', '-') AS nk FROM extension_keys),
v AS (SELECT entity_id, k.ext_key, value_type, {_full("ext_value")} AS t, ext_value, loaded_at FROM extension_values e JOIN k ON e.entity_kind = k.entity_kind AND replace(lower(regexp_replace(e.ext_key, '{_SP}+', '', 'g')), '_', '-') = nk WHERE entity_id IS NOT NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, ext_key ORDER BY loaded_at DESC NULLS LAST, ext_value DESC NULLS LAST) AS rn FROM v WHERE value_type <> 'string_list') WHERE rn = 1),
item AS (SELECT entity_id, ext_key, unnest(CASE WHEN starts_with(t, '[') THEN from_json(t, '["VARCHAR"]') ELSE [t] END) AS i FROM v WHERE value_type = 'string_list'),
cell AS (SELECT entity_id, ext_key, CASE value_type WHEN 'string' THEN t
  WHEN 'int' THEN CASE WHEN regexp_matches(t, '^[+-]?(\\d+|\\d{{1,3}}(,\\d{{3}})+)(\\.0+)?$') THEN CAST(CAST(split_part(replace(t, ',', ''), '.', 1) AS HUGEINT) AS VARCHAR) END
  WHEN 'decimal' THEN CASE WHEN regexp_matches(t, '^[+-]?\\d+([.,]\\d+)?([eE][+-]?\\d{{1,3}})?$') THEN regexp_replace(regexp_replace(CAST(CAST(replace(t, ',', '.') AS DECIMAL(38,12)) AS VARCHAR), '0+$', ''), '\\.$', '') END
  WHEN 'boolean' THEN CASE WHEN lower(t) IN ('true', 't', 'yes', 'y', '1', 'on') THEN 'true' WHEN lower(t) IN ('false', 'f', 'no', 'n', '0', 'off') THEN 'false' END
  WHEN 'date' THEN strftime(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d'), CASE WHEN length(t) = 8 THEN try_strptime(t, '%Y%m%d') END, try_strptime(t, '%d %b %Y'), CASE WHEN contains(t, ':') THEN {_WHEN} END), '%Y-%m-%d')
  WHEN 'timestamp' THEN strftime({_WHEN}, '%Y-%m-%dT%H:%M:%SZ') END AS cell_value FROM last)
SELECT * FROM cell WHERE cell_value IS NOT NULL
UNION ALL SELECT entity_id, ext_key, array_to_string(list_sort(list(DISTINCT {_trim("i")})), '|') FROM item WHERE {_full("i")} IS NOT NULL GROUP BY 1, 2
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        path_normalize, nfc_text, extension_canonical, decimal_canonical, fingerprint_project, maven_coordinate, maven_edges, maven_unresolved, pom_parent_join, duplicate_names_dropped,
        duplicate_names_reported, name_resolution_ranked, wildcard_unique_match, module_argmin_location, diagnostics_distinct, module_of_path, scan_budgets, scan_budgets_broken, java_complexity, java_components, java_dependencies, java_metrics, java_diagnostics)}


def oracle_sql() -> dict[str, str]:
    norm = "replace(repository_path, '\\', '/')"
    parts = f"list_filter(string_split({norm}, '/'), lambda x: x <> '.')"
    path = f"CASE WHEN {norm} = '' OR starts_with({norm}, '/') OR regexp_matches({norm}, '^[A-Za-z]:') OR regexp_matches({norm}, '[\\x00-\\x1f\\x7f-\\x9f]') OR len(list_filter({parts}, lambda x: x = '' OR x = '..')) > 0 THEN NULL WHEN len({parts}) = 0 THEN '.' ELSE array_to_string({parts}, '/') END"
    return {
        "p1_found": P1_SQL, "p2_found": P2_SQL + "SELECT * FROM found WHERE change_kind IS NOT NULL",
        "p2_summary": P2_SQL + "SELECT snapshot_no, change_kind, count(*) AS n_changes FROM found WHERE change_kind IS NOT NULL GROUP BY 1, 2",
        "p1_descendants": P1_SQL.rsplit("SELECT pom_key, root_key, CAST", 1)[0] + ", anc AS (SELECT pom_key AS d, parent AS a, 1 AS distance FROM up WHERE parent IS NOT NULL AND EXISTS (SELECT 1 FROM walk WHERE walk.pom_key = up.pom_key) UNION ALL SELECT d, up.parent, distance + 1 FROM anc JOIN up ON up.pom_key = anc.a WHERE up.parent IS NOT NULL) SELECT a AS ancestor_key, d AS descendant_key, CAST(distance AS BIGINT) AS distance FROM anc",
        "path_normalize": f"SELECT DISTINCT file_id, {path} AS norm_path FROM source_files",
        "nfc_text": "SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_hash, regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x9f]') AS has_control FROM documents WHERE text IS NOT NULL",
        "extension_canonical": "SELECT project_id, array_to_string(list_transform(list_sort(map_keys(extensions)), lambda k: k || '=' || array_to_string(list_sort(extensions[k]), ',')), ';') AS extensions FROM projects",
        "decimal_canonical": "SELECT p_partkey, regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,4)) AS VARCHAR), '\\.?0+$', '') AS price FROM part",
        "fingerprint_project": "SELECT project_id, sha256(project_identity || chr(10) || project_name) AS fingerprint, 'project_' || sha256(concat_ws(chr(10), '0.1.0', project_identity, 'project', lower(coalesce(prog_lang, 'java')), '.', project_identity)) AS stable_id FROM projects",
        "maven_coordinate": POM_SQL + "fin AS (SELECT 1) SELECT DISTINCT pom_id, concat_ws(':', pom_key, version) AS coordinate FROM res WHERE pom_key IS NOT NULL",
        "p4_found": P4_SQL,
        "pom_parent_join": POM_SQL + "fin AS (SELECT 1) SELECT link.pom_key, link.parent_key, up.parent IS NOT NULL AS parent_known FROM link JOIN up USING (pom_key)",
        "duplicate_names_dropped": "SELECT p_partkey, p_name, p_brand FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) WHERE n = 1",
        "duplicate_names_reported": "SELECT p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) WHERE n > 1",
        "name_resolution_ranked": """WITH refs AS (SELECT c_custkey AS ref, unnest([c_mktsegment || '.' || n_name, 'NATION_' || (c_custkey % 40), n_name]) AS name, unnest([0, 1, 2]) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT ref, arg_min('nation:' || n_nationkey, rank) AS target, CAST(min(rank) AS BIGINT) AS rank FROM refs JOIN nation ON n_name = name GROUP BY ref""",
        "wildcard_unique_match": """WITH refs AS (SELECT s_suppkey AS ref, unnest([CAST(s_nationkey % 20 AS VARCHAR), 'x' || s_suppkey]) AS name FROM supplier)
SELECT ref, min(n_name) AS target FROM refs JOIN nation ON CAST(n_nationkey % 20 AS VARCHAR) = name GROUP BY ref HAVING count(DISTINCT n_name) = 1""",
        "module_argmin_location": "SELECT project_id, coalesce(m.p, 'pom.xml') AS path, CAST(coalesce(m.l, 1) AS BIGINT) AS line, CAST(coalesce(m.c, 1) AS BIGINT) AS col FROM (SELECT project_id, min({'p': loc.file_path, 'l': loc.start_line, 'c': loc.start_column}) FILTER (loc IS NOT NULL) AS m FROM finding_snapshots GROUP BY 1)",
        "diagnostics_distinct": "SELECT DISTINCT diag_code, file_path, message FROM parse_diagnostics",
        "module_of_path": f"""WITH f AS (SELECT DISTINCT project_id, {path} AS path FROM source_files), m AS (SELECT *, CASE WHEN starts_with(path, 'src/main/java/') THEN '.' ELSE regexp_extract(path, '^(.*?)/src/main/java/', 1) END AS module_path FROM f WHERE ends_with(path, '.java')),
at AS (SELECT project_id, CASE WHEN path = 'pom.xml' THEN '.' ELSE regexp_replace(path, '/pom.xml$', '') END AS module_path FROM (SELECT project_id, path FROM f UNION SELECT project_id, replace(repository_path, '\\', '/') FROM raw_poms UNION SELECT project_id, module_path || '/pom.xml' FROM source_files) WHERE path = 'pom.xml' OR path LIKE '%/pom.xml')
SELECT * FROM m WHERE module_path <> '' AND EXISTS (SELECT 1 FROM at WHERE at.project_id = m.project_id AND at.module_path = m.module_path)""",
        "scan_budgets_broken": f"""WITH b AS (SELECT project_id, count(*) AS n, sum(byte_size) AS s, max(byte_size) AS l, max(len(string_split({path}, '/'))) AS d FROM (SELECT DISTINCT ON (file_id) * FROM source_files) GROUP BY 1)
SELECT project_id, 'java.limit.files' AS code FROM b WHERE n > 20 UNION ALL SELECT project_id, 'java.limit.total-bytes' FROM b WHERE s > 20000 UNION ALL SELECT project_id, 'java.limit.file-bytes' FROM b WHERE l > 4000 UNION ALL SELECT project_id, 'java.limit.depth' FROM b WHERE d > 6""",
        "scan_budgets": f"SELECT project_id, count(*) AS n_files, CAST(sum(byte_size) AS BIGINT) AS n_bytes, max(byte_size) AS largest, max(len(string_split({path}, '/'))) AS depth FROM (SELECT DISTINCT ON (file_id) * FROM source_files) GROUP BY 1",
    }

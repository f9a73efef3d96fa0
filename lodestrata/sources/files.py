"""File trees as tables, and the formats that repositories describe themselves in.

Formats with a reader in Spark use it; the others are small functions per row inside Arrow batches, with an error column
instead of a failed job.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import strict_json, strip

#: Folders that hold no source of a project's own, and the size beyond which files are left out.
SKIPPED = ("node_modules", "target", "dist", "build", ".git", "__pycache__", ".venv", "vendor")
LARGEST = 2_000_000


def repository_files(spark: SparkSession, root: str, pattern: str = "*", largest: int = LARGEST) -> DataFrame:
    """repo-relative path, name, size and decoded content of files below `root` whose name fits the glob.

    The name filter and the size limit reach the file listing; bytes that aren't UTF-8 are replaced. Files in skipped
    folders are left out. Paths keep their order only if sorted by the caller.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where(F.col("length") <= largest)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base), "")
    kept = raw.select(path.alias("path"), F.col("length").alias("size"), "content")
    skipped = "(^|/)(" + "|".join(re.escape(s) for s in SKIPPED) + ")/"
    return kept.where(~F.col("path").rlike(skipped)).select("path", F.substring_index("path", "/", -1).alias("name"), "size", decoded(F.col("content")).alias("content"))


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """UTF-8 text of bytes, what isn't valid being replaced."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


_COMMENT = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


@F.pandas_udf(T.StringType())
def without_json_comments(text: pd.Series) -> pd.Series:
    """JSON text without comments and trailing commas; strings stay as they are."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        bare = _COMMENT.sub(lambda m: m.group() if m.group()[0] == '"' else " ", t)
        return _TRAILING.sub(lambda m: m.group(1) or "", bare)

    return text.map(one)


def json_with_comments(text: Column) -> Column:
    """Variant of a JSON text that may hold comments and trailing commas; null if it is broken."""
    return strict_json(without_json_comments(text))


@F.pandas_udf(T.StringType())
def toml_as_json(text: pd.Series) -> pd.Series:
    """TOML as JSON text; null if it is broken."""
    import tomllib

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(tomllib.loads(t), default=str)
        except tomllib.TOMLDecodeError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def yaml_as_json(text: pd.Series) -> pd.Series:
    """The first YAML document as JSON text where it is a mapping; null if it isn't or is broken.

    Needs PyYAML on the executors; without it every row is null. Documents with anchors that refer to themselves and
    other values JSON can't hold are null as well.
    """
    try:
        import yaml
    except ImportError:
        return text.map(lambda _: None)

    def one(t: str | None) -> str | None:
        try:
            value = next(iter(yaml.safe_load_all(t or "")), None)
            return json.dumps({str(k): v for k, v in value.items()}, default=str) if isinstance(value, dict) else None
        except (yaml.YAMLError, ValueError, TypeError):
            return None

    return text.map(one)


def safe_xml(text: Column, schema: str, options: dict | None = None) -> Column:
    """XML by schema; texts with a document type or an entity declaration are refused and give null."""
    harmless = ~F.upper(text).rlike("<!(DOCTYPE|ENTITY)")
    return F.from_xml(F.when(harmless, text), schema, options or {})


def go_requires(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, module, version, indirect of the require lines of go.mod files, in blocks or alone; lines need line_no and line."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = strip(F.regexp_replace("line", "\\s*//(?!\\s*indirect).*$", ""))
    mark = F.when(text.rlike(r"^require\s*\("), True).when(text == ")", False).when(text.rlike(r"^\w+\s*\("), False)
    inside = lines.withColumn("_in", F.coalesce(F.last(mark, ignorenulls=True).over(order), F.lit(False)))
    spec = r"^(?:require\s+)?([\w./~-]+\.[\w./~-]*|[\w./~-]+/[\w./~-]+)\s+(v\S+)"
    hit = inside.where((F.col("_in") | text.rlike(r"^require\s+[^(]")) & text.rlike(spec))
    return hit.select(*keys, F.regexp_extract(text, spec, 1).alias("module"), F.regexp_extract(text, spec, 2).alias("version"), text.contains("// indirect").alias("indirect"))


def python_requirements(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, version of requirements lines; comments, options and blank lines are left out, only == pins a version."""
    text = strip(F.regexp_replace("line", r"\s*#.*$", ""))
    spec = r"^([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:==\s*([\w.*+!-]+))?"
    hit = lines.where(text.rlike(r"^[A-Za-z0-9]"))
    return hit.select(*keys, F.lower(F.regexp_replace(F.regexp_extract(text, spec, 1), "[-_.]+", "-")).alias("name"), F.nullif(F.regexp_extract(text, spec, 2), F.lit("")).alias("version"))


def maven_dependencies(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, package group, name and version of the dependency elements of pom files, and the line each starts on."""
    block = F.regexp_extract_all(text, F.lit(r"(?s)<dependency>.*?</dependency>"), F.lit(0))
    one = files.select(*keys, F.col(text).alias("_t"), F.explode(block).alias("d"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("d", f"<{name}>([^<]*)</{name}>", 1)), F.lit(""))
    line = F.expr("size(split(substr(_t, 1, instr(_t, d)), '\n'))")
    return one.select(*keys, tag("groupId").alias("package_group"), tag("artifactId").alias("name"), tag("version").alias("version"), line.alias("line_no"))


def environment_settings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value of KEY=VALUE lines, quotes around the value taken off; comments are left out."""
    spec = r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$"
    hit = lines.where(F.col("line").rlike(spec))
    return hit.select(*keys, F.regexp_extract("line", spec, 1).alias("name"), F.regexp_replace(F.regexp_extract("line", spec, 2), "^([\"'])(.*)\\1$", "$2").alias("value"))


def npm_lock_edges(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, src, dst of a lock file's packages (paths under node_modules): each dependency resolves to the nearest one above.

    The candidates of a dependency are one per level of its package's path, joined by equality and ranked by depth.
    """
    package = "map<string,struct<version:string,dependencies:map<string,string>>>"
    packages = F.from_json(text, f"packages {package}")["packages"]
    nodes = files.select(*keys, F.explode(packages).alias("src", "p"))
    wanted = nodes.select(*keys, "src", F.explode(F.map_keys("p.dependencies")).alias("name"))
    levels = F.split(F.col("src"), "/?node_modules/")
    bases = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.array_join(F.slice(levels, F.lit(1), n), "/node_modules/"))
    tried = wanted.select(*keys, "src", "name", F.posexplode(bases).alias("depth", "base")).withColumn(
        "dst", F.regexp_replace(F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), F.concat(F.lit("node_modules/"), "name")), "^/", "")
    )
    known = nodes.select(*keys, F.col("src").alias("dst"))
    hits = tried.join(known, [*keys, "dst"]).groupBy(*keys, "src", "name").agg(F.max_by("dst", "depth").alias("dst"))
    return wanted.join(hits, [*keys, "src", "name"], "left").select(*keys, "src", "name", "dst")


def bill_of_materials(files: DataFrame, keys: list[str], text: str, depth: int = 4) -> DataFrame:
    """keys, ref, name, version, purl, licences of a CycloneDX file's components, nested ones to the given depth."""
    doc = strict_json(F.col(text))
    level = files.select(*keys, F.explode(F.try_variant_get(doc, "$.components", "array<variant>")).alias("c"))
    found = None
    field = lambda n: F.try_variant_get("c", f"$.{n}", "string").alias(n)
    for _ in range(depth):
        rows = level.select(*keys, F.try_variant_get("c", '$["bom-ref"]', "string").alias("ref"), field("name"), field("version"), field("purl"), F.to_json(F.try_variant_get("c", "$.licenses", "variant")).alias("licences"))
        found = rows if found is None else found.unionByName(rows)
        level = level.select(*keys, F.explode(F.try_variant_get("c", "$.components", "array<variant>")).alias("c"))
    return found


def coverage_report(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, filename, line_rate of a Cobertura report's classes."""
    harmless = ~F.upper(F.col(text)).rlike("<!ENTITY")
    one = files.where(harmless).select(*keys, F.explode(F.regexp_extract_all(text, F.lit(r"<class\b[^>]*>"), F.lit(0))).alias("c"))
    attribute = lambda n: F.regexp_extract("c", f'\\b{n}="([^"]*)"', 1)
    return one.select(*keys, attribute("filename").alias("filename"), attribute("line-rate").try_cast("double").alias("line_rate"))


def ownership_rules(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule_no, pattern as a regular expression, owners of the rules of an ownership file, in their order."""
    text = strip(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    parts = F.split(text, r"\s+")
    hit = lines.where(text != "").select(*keys, F.col("line_no").alias("rule_no"), F.get(parts, 0).alias("p"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("owners"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("p", "^/", ""), r"([.+()\[\]{}^$|])", r"\\$1"), r"\*\*/?", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    anchored = F.when(F.col("p").startswith("/") | F.regexp_replace("p", "/$", "").contains("/"), F.lit("^")).otherwise(F.lit("(^|.*/)"))
    return hit.select(*keys, "rule_no", F.concat(anchored, F.regexp_replace(body, "/$", "/.*"), F.lit("($|/.*)")).alias("pattern"), "owners")


def owned(paths: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """path and the owners of the last rule that matches it; a project's rules are few and compile to one CASE."""
    case = None
    for pattern, owners in reversed(rules):
        value = F.array(*[F.lit(o) for o in owners]) if owners else F.array().cast("array<string>")
        case = F.when(F.col("path").rlike(pattern), value) if case is None else case.when(F.col("path").rlike(pattern), value)
    return paths.select("path", (case if case is not None else F.lit(None).cast("array<string>")).alias("owners"))


def typed_facts(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    """Facts of the wanted types; types are folders, so the others are never opened."""
    facts = spark.read.parquet(folder)
    return facts.where(F.col("type").isin(list(types))) if types else facts

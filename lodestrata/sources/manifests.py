"""Dependencies that manifests and lock files state, in one shape: one reader a format, chosen by the file's name.

Readers are column expressions (variants and Spark's XML functions); a text that can't be read gives a row with a problem
instead of a failed job, and a manifest of a format without a reader gives one too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import strict_json
from lodestrata.sources.files import json_with_comments

#: Formats by the end of the file's path, in lower case.
FORMATS = [
    ("package.json", r"(^|/)package\.json$"), ("nuget-lock", r"(^|/)packages\.lock\.json$"), ("nuget-assets", r"(^|/)project\.assets\.json$"), ("csproj", r"\.(cs|fs|vb)proj$"),
    ("central-versions", r"(^|/)directory\.packages\.props$"), ("global.json", r"(^|/)global\.json$"), ("tsconfig", r"(^|/)tsconfig[\w.-]*\.json$"), ("pom", r"(^|/)pom\.xml$"),
]
#: Manifests that are known but not read.
UNREAD = r"(^|/)(build\.gradle(\.kts)?|gemfile|cargo\.toml|composer\.json|mix\.exs|package\.swift|setup\.py|pipfile|conanfile\.txt)$"
ROW = "struct<name:string,version:string,scope:string,parent:string>"


def format_of(path: Column) -> Column:
    low, case = F.lower(path), None
    for name, pattern in FORMATS:
        case = F.when(low.rlike(pattern), name) if case is None else case.when(low.rlike(pattern), name)
    return case.when(low.rlike(UNREAD), "unread")


def _row(name: Column, version: Column, scope: Column, parent: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(name.cast("string").alias("name"), version.cast("string").alias("version"), scope.cast("string").alias("scope"), (none if parent is None else parent.cast("string")).alias("parent"))


def _all(*arrays: Column) -> Column:
    empty = F.array().cast(f"array<{ROW}>")
    return F.flatten(F.array(*[F.coalesce(a.cast(f"array<{ROW}>"), empty) for a in arrays]))


def _map(v: Column, path: str, kind: str = "map<string,string>") -> Column:
    return F.map_entries(F.try_variant_get(v, path, kind))


def _scoped(scope: str):
    return lambda e: _row(e["key"], e["value"], F.lit(scope))


def package_json(text: Column) -> Column:
    """Entries of the dependency maps of a package.json, the scope being the map they stand in."""
    v = strict_json(text)
    scopes = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    return F.when(v.isNotNull(), _all(*[F.transform(_map(v, f"$.{s}"), _scoped(s)) for s in scopes]))


def nuget_lock(text: Column) -> Column:
    """Packages of a NuGet lock file and what each depends on; the scope is the target framework, the parent the package that asks."""
    v = strict_json(text)
    frameworks = _map(v, "$.dependencies", "map<string,map<string,variant>>")

    def of_framework(f: Column) -> Column:
        def of_package(p: Column) -> Column:
            own = F.array(_row(p["key"], F.try_variant_get(p["value"], "$.resolved", "string"), f["key"]))
            below = F.transform(F.map_entries(F.try_variant_get(p["value"], "$.dependencies", "map<string,string>")), lambda d: _row(d["key"], d["value"], f["key"], p["key"]))
            return _all(own, below)

        return F.flatten(F.transform(F.map_entries(f["value"]), of_package))

    return F.when(v.isNotNull(), _all(F.flatten(F.transform(frameworks, of_framework))))


def nuget_assets(text: Column) -> Column:
    """The same from a project.assets.json, whose packages are named name/version."""
    v = strict_json(text)
    targets = _map(v, "$.targets", "map<string,map<string,variant>>")

    def of_target(f: Column) -> Column:
        def of_package(p: Column) -> Column:
            name, version = F.substring_index(p["key"], "/", 1), F.substring_index(p["key"], "/", -1)
            below = F.transform(F.map_entries(F.try_variant_get(p["value"], "$.dependencies", "map<string,string>")), lambda d: _row(d["key"], d["value"], f["key"], name))
            return _all(F.array(_row(name, version, f["key"])), below)

        return F.flatten(F.transform(F.map_entries(f["value"]), of_package))

    return F.when(v.isNotNull(), _all(F.flatten(F.transform(targets, of_target))))


_REFERENCE = "array<struct<_Include:string,_Update:string,_Version:string,Version:string,_PrivateAssets:string>>"


def _xml(text: Column, schema: str) -> Column:
    """A text as XML below <Project>; null where it is broken or declares entities."""
    safe = F.when(~F.coalesce(text, F.lit("")).rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"), text)
    return F.from_xml(safe, schema, {"rowTag": "Project", "mode": "PERMISSIVE"})


def csproj(text: Column) -> Column:
    """Package and project references of a .NET project file; a version may be an attribute, an element or missing (central)."""
    x = _xml(text, f"ItemGroup array<struct<PackageReference:{_REFERENCE},ProjectReference:array<struct<_Include:string>>>>")
    packages = F.flatten(F.transform(x["ItemGroup"], lambda g: F.coalesce(g["PackageReference"], F.array().cast(_REFERENCE))))
    projects = F.flatten(F.transform(x["ItemGroup"], lambda g: F.coalesce(g["ProjectReference"], F.array().cast("array<struct<_Include:string>>"))))
    private = lambda p: F.when(F.lower(p["_PrivateAssets"]) == "all", "private").otherwise("direct")
    return F.when(text.contains("<Project"), _all(F.transform(packages, lambda p: _row(F.coalesce(p["_Include"], p["_Update"]), F.coalesce(p["_Version"], p["Version"]), private(p))), F.transform(projects, lambda p: _row(p["_Include"], F.lit(None), F.lit("project")))))


def central_versions(text: Column) -> Column:
    x = _xml(text, "ItemGroup array<struct<PackageVersion:array<struct<_Include:string,_Version:string>>>>")
    return F.when(text.contains("<Project"), _all(F.flatten(F.transform(x["ItemGroup"], lambda g: F.transform(g["PackageVersion"], lambda p: _row(p["_Include"], p["_Version"], F.lit("central")))))))


def global_json(text: Column) -> Column:
    v = json_with_comments(text)
    sdk = F.try_variant_get(v, "$.sdk.version", "string")
    return F.when(v.isNotNull(), _all(F.when(sdk.isNotNull(), F.array(_row(F.lit("sdk"), sdk, F.lit("sdk")))), F.transform(_map(v, '$["msbuild-sdks"]'), lambda e: _row(e["key"], e["value"], F.lit("msbuild-sdk")))))


def tsconfig(text: Column) -> Column:
    """Path aliases (name the pattern, version the first target) and referenced projects of a TypeScript configuration."""
    v = json_with_comments(text)
    aliases = F.transform(_map(v, "$.compilerOptions.paths", "map<string,array<string>>"), lambda e: _row(e["key"], F.get(e["value"], 0), F.lit("alias")))
    references = F.transform(F.try_variant_get(v, "$.references", "array<struct<path string>>"), lambda r: _row(r["path"], F.lit(None), F.lit("project")))
    extends = F.try_variant_get(v, "$.extends", "string")
    return F.when(v.isNotNull(), _all(aliases, references, F.when(extends.isNotNull(), F.array(_row(extends, F.lit(None), F.lit("extends"))))))


def pom(text: Column) -> Column:
    """Dependencies of a Maven project, named group:artifact."""
    safe = F.when(~F.coalesce(text, F.lit("")).rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"), text)
    x = F.from_xml(safe, "dependencies struct<dependency:array<struct<groupId:string,artifactId:string,version:string,scope:string>>>", {"rowTag": "project"})
    return F.when(text.contains("<project"), _all(F.transform(x["dependencies"]["dependency"], lambda d: _row(F.concat_ws(":", d["groupId"], d["artifactId"]), d["version"], F.coalesce(d["scope"], F.lit("compile"))))))


READERS = {"package.json": package_json, "nuget-lock": nuget_lock, "nuget-assets": nuget_assets, "csproj": csproj, "central-versions": central_versions, "global.json": global_json, "tsconfig": tsconfig, "pom": pom}


def dependencies(files: DataFrame) -> DataFrame:
    """repo, path, format, name, version, scope, parent and problem of all manifests among files (repo, path, content).

    Files that are no manifest give nothing. A manifest that can't be read, or has no reader, gives one row with a
    `problem` and no name; one without dependencies gives none. Null content counts as unreadable. One pass, no shuffle.
    """
    named = files.select("repo", "path", "content", format_of(F.col("path")).alias("format")).where("format is not null")
    read = reduce(lambda case, f: case.when(F.col("format") == f, READERS[f](F.col("content"))), list(READERS)[1:], F.when(F.col("format") == "package.json", package_json(F.col("content"))))
    problem = F.when(F.col("format") == "unread", "no reader").when(F.col("rows").isNull(), "unreadable")
    none = F.array(F.lit(None).cast(ROW))
    each = named.withColumn("rows", read).withColumn("problem", problem).withColumn("r", F.explode(F.when(F.col("problem").isNotNull(), none).otherwise(F.col("rows"))))
    return each.where("problem is not null or r.name is not null").select("repo", "path", "format", "r.name", "r.version", "r.scope", "r.parent", "problem")


def with_central_versions(found: DataFrame) -> DataFrame:
    """References without a version get the one the repository states centrally; names compare without case.

    Where several central files name a package, the greatest path wins (the one deepest down a chain of folders).
    """
    central = found.where("scope = 'central'").groupBy("repo", F.lower("name").alias("_name")).agg(F.max_by("version", "path").alias("_central"))
    joined = found.withColumn("_name", F.lower("name")).join(central, ["repo", "_name"], "left")
    return joined.withColumn("version", F.coalesce("version", "_central")).drop("_name", "_central")


def dependency_edges(found: DataFrame) -> DataFrame:
    """(repo, path, scope, src, src_version, dst, dst_version): lock entries joined to the entries they ask for, by framework.

    An entry that the lock doesn't hold gives an edge with a null dst_version.
    """
    key = ["repo", "path", "scope"]
    locked = found.where("parent is null and name is not null and format like 'nuget-%'").select(*key, F.lower("name").alias("_n"), "version")
    asked = found.where("parent is not null").select(*key, F.col("parent").alias("src"), F.col("name").alias("dst"))
    at = lambda side: locked.select(*key, F.col("_n").alias(f"_{side}"), F.col("version").alias(f"{side}_version"))
    both = asked.withColumns({"_src": F.lower("src"), "_dst": F.lower("dst")}).join(at("src"), [*key, "_src"], "left").join(at("dst"), [*key, "_dst"], "left")
    return both.select(*key, "src", "src_version", "dst", "dst_version")


def packages_of_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports (project, name and further columns) with `package`: one of their own project first, else one of any project.

    Names compare as given. Several packages of a name give the first by their own name.
    """
    own = packages.where("name is not null").groupBy("project", F.col("name").alias("_n")).agg(F.min("node").alias("_own"))
    any_ = packages.where("name is not null").groupBy(F.col("name").alias("_n")).agg(F.min("node").alias("_any"))
    joined = imports.withColumn("_n", F.col("name")).join(own, ["project", "_n"], "left").join(any_, "_n", "left")
    return joined.withColumn("package", F.coalesce("_own", "_any")).drop("_n", "_own", "_any")

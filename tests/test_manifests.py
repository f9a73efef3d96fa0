"""Manifests: each format, broken ones, central versions, lock edges and packages of imports."""

import json

import pytest

from lodestrata.sources import manifests as M

FILES = {
    "a/package.json": json.dumps({"name": "x", "dependencies": {"left": "^1.0"}, "devDependencies": {"jest": "29"}}),
    "a/packages.lock.json": json.dumps({"version": 1, "dependencies": {"net8.0": {"Core": {"type": "Direct", "resolved": "2.1.0", "dependencies": {"Util": "1.0", "Gone": "3.0"}}, "Util": {"type": "Transitive", "resolved": "1.4.0"}}}}),
    "b/obj/project.assets.json": json.dumps({"targets": {"net8.0": {"Core/2.1.0": {"type": "package", "dependencies": {"Util": "1.0"}}, "Util/1.0.0": {"type": "package"}}}}),
    "b/b.csproj": '<Project Sdk="x"><ItemGroup><PackageReference Include="Core" /><PackageReference Include="Own" Version="9" PrivateAssets="all" /><ProjectReference Include="../a/a.csproj" /></ItemGroup><ItemGroup><PackageReference Include="El"><Version>7</Version></PackageReference></ItemGroup></Project>',
    "Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="core" Version="2.1.0" /></ItemGroup></Project>',
    "global.json": '{"sdk": {"version": "8.0.100"}, "msbuild-sdks": {"Q": "1"}} // c',
    "tsconfig.json": '{"extends": "./base.json", /* c */ "compilerOptions": {"paths": {"@/*": ["src/*"]}}, "references": [{"path": "../core"}],}',
    "pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>",
    "x/package.json": "{broken", "y/pom.xml": '<!DOCTYPE a [<!ENTITY e "x">]><project/>', "Cargo.toml": "[dependencies]", "z/package.json": None, "src/a.py": "import os", "w/package.json": "{}",
}


@pytest.fixture(scope="module")
def found(spark):
    return M.dependencies(spark.createDataFrame([("r", p, c) for p, c in FILES.items()], "repo string, path string, content string")).cache()


def test_formats(found):
    rows = {(r.path, r.name, r.version, r.scope, r.parent) for r in found.where("problem is null").collect()}
    assert rows == {
        ("a/package.json", "left", "^1.0", "dependencies", None), ("a/package.json", "jest", "29", "devDependencies", None),
        ("a/packages.lock.json", "Core", "2.1.0", "net8.0", None), ("a/packages.lock.json", "Util", "1.4.0", "net8.0", None), ("a/packages.lock.json", "Util", "1.0", "net8.0", "Core"), ("a/packages.lock.json", "Gone", "3.0", "net8.0", "Core"),
        ("b/obj/project.assets.json", "Core", "2.1.0", "net8.0", None), ("b/obj/project.assets.json", "Util", "1.0.0", "net8.0", None), ("b/obj/project.assets.json", "Util", "1.0", "net8.0", "Core"),
        ("b/b.csproj", "Core", None, "direct", None), ("b/b.csproj", "Own", "9", "private", None), ("b/b.csproj", "El", "7", "direct", None), ("b/b.csproj", "../a/a.csproj", None, "project", None),
        ("Directory.Packages.props", "core", "2.1.0", "central", None), ("global.json", "sdk", "8.0.100", "sdk", None), ("global.json", "Q", "1", "msbuild-sdk", None),
        ("tsconfig.json", "@/*", "src/*", "alias", None), ("tsconfig.json", "../core", None, "project", None), ("tsconfig.json", "./base.json", None, "extends", None),
        ("pom.xml", "g:a", "1", "compile", None), ("pom.xml", "g:t", None, "test", None),
    }


def test_problems(found):
    assert {(r.path, r.problem) for r in found.where("problem is not null").collect()} >= {("x/package.json", "unreadable"), ("Cargo.toml", "no reader"), ("z/package.json", "unreadable")}


def test_central_versions_and_edges(found):
    versions = {(r.path, r.name): r.version for r in M.with_central_versions(found).where("path = 'b/b.csproj'").collect()}
    assert versions["b/b.csproj", "Core"] == "2.1.0" and versions["b/b.csproj", "Own"] == "9"
    edges = {(r.path, r.src, r.src_version, r.dst, r.dst_version) for r in M.dependency_edges(found).collect()}
    assert edges == {("a/packages.lock.json", "Core", "2.1.0", "Util", "1.4.0"), ("a/packages.lock.json", "Core", "2.1.0", "Gone", None), ("b/obj/project.assets.json", "Core", "2.1.0", "Util", "1.0.0")}


def test_packages_of_imports(spark):
    imports = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3), (None, "a", 4), ("p", None, 5)], "project string, name string, node int")
    packages = spark.createDataFrame([("p", "a", "p:a"), ("q", "a", "q:a"), ("q", "a", "q:a"), ("z", "b", "z:b"), ("z", None, "z")], "project string, name string, node string")
    got = {r.node: r.package for r in M.packages_of_imports(imports, packages).collect()}
    assert got == {1: "p:a", 2: "z:b", 3: "q:a", 4: "p:a", 5: None}


def test_empty(spark):
    none = M.dependencies(spark.createDataFrame([], "repo string, path string, content string"))
    assert none.count() == 0 and M.dependency_edges(none).count() == 0

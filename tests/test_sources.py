"""File sources, formats and sinks on small trees."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import files as S
from lodestrata.sources import sinks as K
from lodestrata.sources.lines import evidence, excerpt_hash, lines


@pytest.fixture()
def tree(tmp_path):
    for path, text in {"a/x.py": "x = 1\r\ny = 2\n", "a/node_modules/y.py": "z", "b.py": "é\n", "c.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text.encode("latin-1") if path == "b.py" else text.encode())
    (tmp_path / "big.py").write_text("#" * 500)
    return tmp_path


def test_tree_scan(spark, tree):
    rows = {r.path: r for r in S.repository_files(spark, str(tree), "*.py", largest=100).collect()}
    assert set(rows) == {"a/x.py", "b.py"} and rows["b.py"].content == "�\n" and rows["a/x.py"].size == 13


def test_lines_and_hashes(spark):
    df = spark.createDataFrame([(1, "a\r\nb\nc"), (2, ""), (3, None)], "id int, t string")
    assert [(r.id, r.line_no, r.line) for r in lines(df, ["id"], "t").orderBy("id", "line_no").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]
    import hashlib

    got = df.where("id = 1").select(excerpt_hash(F.col("t"), F.lit(2), F.lit(3)).alias("h"), evidence(F.lit("r"), F.lit("p"), F.col("t"), F.lit(3), F.lit(1), "d").alias("e")).first()
    assert got.h == "sha256:" + hashlib.sha256(b"b\nc").hexdigest() and (got.e.start, got.e.end) == (3, 3)


def column(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("v")).first().v


def test_structured_texts(spark):
    assert column(spark, '{"a": "// no", /* x */ "b": [1, 2,], // y\n}', lambda c: F.to_json(S.json_with_comments(c))) == '{"a":"// no","b":[1,2]}'
    assert column(spark, "{", S.json_with_comments) is None
    assert json.loads(column(spark, '[project]\nname = "x"\n', S.toml_as_json)) == {"project": {"name": "x"}} and column(spark, "= 1", S.toml_as_json) is None
    assert column(spark, "<a><b>1</b></a>", lambda c: S.safe_xml(c, "b int")).b == 1
    assert column(spark, "<!DOCTYPE a><a><b>1</b></a>", lambda c: S.safe_xml(c, "b int")) is None


def line_rows(spark, text):
    return lines(spark.createDataFrame([("f", text)], "f string, t string"), ["f"], "t")


def test_line_formats(spark):
    mod = "module x\n\nrequire (\n\ta.io/b v1.2.3 // indirect\n\tc.io/d v2.0.0\n)\nrequire e.io/f v0.1.0\nreplace (\n\tg.io/h v1.0.0 => ../h\n)\n"
    assert {(r.module, r.version, r.indirect) for r in S.go_requires(line_rows(spark, mod), ["f"]).collect()} == {("a.io/b", "v1.2.3", True), ("c.io/d", "v2.0.0", False), ("e.io/f", "v0.1.0", False)}
    req = "# c\nDjango_x==4.2 # pinned\nrequests>=2\n-r other.txt\npkg[extra]==1.0\n"
    assert {(r.name, r.version) for r in S.python_requirements(line_rows(spark, req), ["f"]).collect()} == {("django-x", "4.2"), ("requests", None), ("pkg", "1.0")}
    env = "A=1\nexport B='x y'\n# C=2\n"
    assert {(r.name, r.value) for r in S.environment_settings(line_rows(spark, env), ["f"]).collect()} == {("A", "1"), ("B", "x y")}
    rules = S.ownership_rules(line_rows(spark, "* @all\n/src/ @core # x\n*.md @docs\n"), ["f"]).orderBy("rule_no").collect()
    got = S.owned(spark.createDataFrame([("src/a.py",), ("src/b.md",), ("x/c.py",)], "path string"), [(r.pattern, r.owners) for r in rules]).collect()
    assert {r.path: r.owners for r in got} == {"src/a.py": ["@core"], "src/b.md": ["@docs"], "x/c.py": ["@all"]}


def test_document_formats(spark):
    one = lambda t: spark.createDataFrame([("f", t)], "f string, t string")
    pom = "<p>\n<dependency>\n<groupId>g</groupId><artifactId>a</artifactId>\n</dependency>\n</p>"
    (r,) = S.maven_dependencies(one(pom), ["f"], "t").collect()
    assert (r.package_group, r.name, r.version, r.line_no) == ("g", "a", None, 2)
    lock = {"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1", "dependencies": {"b": "1", "c": "1"}}, "node_modules/b": {"version": "1"}, "node_modules/a/node_modules/b": {"version": "2"}}}
    assert {(r.src, r.name, r.dst) for r in S.npm_lock_edges(one(json.dumps(lock)), ["f"], "t").collect()} == {("", "a", "node_modules/a"), ("node_modules/a", "b", "node_modules/a/node_modules/b"), ("node_modules/a", "c", None)}
    bom = {"components": [{"bom-ref": "1", "name": "a", "components": [{"bom-ref": "2", "name": "b"}]}]}
    assert {(r.ref, r.name) for r in S.bill_of_materials(one(json.dumps(bom)), ["f"], "t").collect()} == {("1", "a"), ("2", "b")}
    report = '<coverage><class name="x" filename="a/b.py" line-rate="0.5"/><class line-rate="1" filename="c.py"></class></coverage>'
    assert {(r.filename, r.line_rate) for r in S.coverage_report(one(report), ["f"], "t").collect()} == {("a/b.py", 0.5), ("c.py", 1.0)}


def test_sinks(spark, tmp_path):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "type string, v int")
    K.write_facts(facts, str(tmp_path / "facts"))
    K.write_facts(facts.where("type = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "facts"))
    assert {(r.type, r.v) for r in S.typed_facts(spark, str(tmp_path / "facts"), "a", "b").collect()} == {("a", 9), ("b", 2)}
    K.write_artifacts(spark.createDataFrame([("verified", "Flow", "x")], "status string, kind string, name string"), str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb")).where("status = 'verified'").count() == 1
    K.write_report(facts, str(tmp_path / "r"))
    table = lambda **x: spark.createDataFrame(list(x.items()), "path string, hash string")
    got = K.three_way(table(new="1", ours="2", theirs="2", same="1"), table(ours="1", theirs="9", gone="1", kept="5", same="1"), table(ours="1", theirs="1", gone="1", kept="1")).collect()
    assert {r.path: r.action for r in got} == {"new": "write", "ours": "write", "theirs": "propose", "gone": "remove", "kept": "keep", "same": "same"}
    assert [r.path for r in K.stale(table(a="1", b="1"), table(a="1")).collect()] == ["b"]
    assert [r.path for r in K.colliding_paths(spark.createDataFrame([("a",), ("a",), ("b",)], "path string")).collect()] == ["a"]
    assert K.manifest(spark.createDataFrame([("p", "x")], "path string, content string")).first().hash.startswith("2d711642")

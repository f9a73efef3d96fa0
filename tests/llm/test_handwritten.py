"""Machine-made files: each reason, and files that only talk about it."""

import pytest

from lodestrata.llm import handwritten as H

BODY = "import logging\n\n\ndef f(a, b):\n    # a comment\n    if a > b:\n        return {'x': [1, 2]}\n    return None\n"
MIN = "!function(){" + "".join(f"function a{i}(b,c){{return b>{i}?c(b):c[{i}]}};var d{i}={{m:{i},r:!0}};" for i in range(40)) + "}();"
CASES = [
    ("# Code generated by wiregenc v1.2. DO NOT EDIT.\n" + BODY, "python", "a/b.py", ["generated"]),
    ("#!/usr/bin/env python3\n# This file was produced by x build 3; changes will be lost on the next build.\n" + BODY, "python", "a/b.py", ["generated"]),
    ("// <auto-generated>\n// Autogenerated by x Compiler (1.2)\n// </auto-generated>\nclass A { }", "csharp", "A.cs", ["generated"]),
    (BODY, "python", "x/build/generated/sources/a.py", ["generated"]),
    ('{\n "lockfileVersion": 3,\n "packages": {"node_modules/a": {"version": "1"}}\n}', "json", "package-lock-x.json", ["generated"]),
    ("# hashy v6.21.8 - a small library for x\n# https://code.example/hashy\n# (c) hashy maintainers\n" + BODY, "python", "src/util/a.py", ["vendored"]),
    (BODY, "python", "src/third_party/hashy/a.py", ["vendored"]),
    (MIN, "javascript", "assets/a.js", ["minified"]),
    ("TABLE = [\n" + "    -1.03401, 1.45154, 2.60986, -1.13553,\n" * 60 + "]\n", "python", "a.py", ["data"]),
    ("BLOB = (\n" + '    "ZmPNJjj/fHxq28ydDfT4r64Xxp7U7AuyTVPvKxnL+AwgvNv8xAuyGf7aurH4Q7DgJmTWdLGVYmVL"\n' * 30 + ")\n", "python", "a.py", ["data"]),
    ("# DO NOT EDIT UNLESS YOU ARE SURE THAT YOU KNOW WHAT YOU ARE DOING\n" + BODY, "python", "src/vendor/a.py", []),
    (BODY.replace("a comment", "the report this module has generated is mailed; do not edit it by hand"), "python", "src/generator/a.py", []),
    ('s = "@generated by x"\n' + BODY, "python", "a.py", []),
    ("BANNER = '{{{ (" + "some words of prose " * 60 + "'\n" + BODY, "python", "a.py", []),
    ("", "python", "a.py", []),
]


@pytest.mark.parametrize("text, language, path, want", CASES)
def test_reasons(text, language, path, want):
    assert (H.classes(text, language, path) if text else []) == want


def test_files(spark):
    rows = [(1, CASES[0][0]), (1, CASES[0][0]), (2, BODY), (3, None), (None, MIN), (4, "")]
    df = spark.createDataFrame([(i, "p", False, "a.py", None, c, "clash") for i, c in rows], "file_id bigint, project string, is_test boolean, relative string, language string, content string, reason string")
    assert [(r.file_id, r.reason) for r in H.machine_files(df).collect()] == [(1, "generated")]
    assert H.machine_files(df.where("false")).count() == 0


def test_canonical_formatting():
    lines = H.canonical("if(a){for(i=0;i<3;i++){b( 1 );}}c;")
    assert lines == [(0, "if(a){"), (1, "for(i=0;i<3;i++){"), (2, "b(1);"), (2, "}"), (1, "}c;")] or [t for _, t in lines] == ["if(a){", "for(i=0;i<3;i++){", "b(1);", "}", "}c;"]
    assert H.canonical_blocks("a\n  b; c\n\nd\n") == [(0, "a"), (1, "b"), (1, "c"), (0, "d")]
    assert H.Layout("if (a) {\n  b(1);\n}\n", "java").kept == 1.0 and H.Layout(MIN, "javascript").expansion > 50


def test_whole_text_is_evidence():
    licence = "".join(f"// line {i} of a long licence header\n" for i in range(60))
    assert H.classes(licence + "// Code generated by protoc-gen-go. DO NOT EDIT.\npackage a\n", "go", "a.go") == ["generated"]
    assert H.classes('{\n "name": "' + "x" * 9_000 + '",\n "lockfileVersion": 3\n}', "json", "deps.json") == ["generated"]
    assert H.classes(licence + "// hashy v6.21.8 - a small library\n// https://code.example/hashy\nvar a;\n", "javascript", "a.js") == ["vendored"]

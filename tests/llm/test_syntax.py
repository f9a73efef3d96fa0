"""Syntax: the recogniser against brute force, dialects on good and broken files."""

import ast
import itertools

import pytest

from lodestrata.llm import syntax as X
from lodestrata.llm.gll import Grammar, Unbalanced


def test_recogniser_on_ambiguous_and_left_recursive_grammar():
    g = Grammar("S = S S | 'a' | 'b' S 'b' | \n")
    def member(t):
        if t in ("", "a"):
            return True
        if len(t) > 1 and t[0] == t[-1] == "b" and member(t[1:-1]):
            return True
        return any(member(t[:i]) and member(t[i:]) for i in range(1, len(t)))

    for n in range(7):
        for t in map("".join, itertools.product("ab", repeat=n)):
            text = t.replace("a", g.code("a")).replace("b", g.code("b"))
            assert g.accepts("S", text) == member(t), t


def test_folding():
    g = Grammar("S = (:S) S | \n")
    assert g.accepts("S", g.folded_text(list("(())()")))
    for bad in ("(", ")", "(]", "([)]"):
        with pytest.raises(Unbalanced):
            g.folded_text(list(bad))


GOOD = {
    "java": ["package a.b;\nimport java.util.*;\n@A(x = {1, 2})\npublic class C<T extends D & E> extends F implements G {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  C(int... a) throws X { super(); }\n  <R> R f(final T t) { for (var i : xs) { if (a < b && c > d) continue; else g(h -> h.i(), this::j); }\n    try (var r = open()) { return switch (x) { case 1, 2 -> y; default -> { yield z; } }; } catch (A | B e) { throw e; } finally { } }\n  enum E { A(1), B { void f() {} }; int v; }\n  record P(int x) { }\n}\n"],
    "csharp": ["using System;\nnamespace A.B\n{\n  [Serializable]\n  public class C<T> : D, IE where T : class, new()\n  {\n    public int X { get; private set; } = 3;\n    string Y => $\"a {X} b\";\n    public async Task<T?> F(int a = 1, params string[] b)\n    {\n      var q = from x in xs where x > 1 orderby x select new { x, y = x ?? 2 };\n      if (o is string s && s.Length > 2 || p is not null) return await G(x => x!.Y?[0] ?? 1);\n      var d = new Dictionary<string, int> { [\"a\"] = 1 };\n      using var z = H(out var w);\n      return y switch { 1 => a, > 2 and < 5 => b, _ => throw new E() };\n    }\n  }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T) F(ctx context.Context, a ...int) (int, error) {\n\tif v, err := g(); err != nil {\n\t\treturn 0, fmt.Errorf(\"x: %w\", err)\n\t} else if v > 1 {\n\t\tdefer h()\n\t}\n\tfor i, x := range xs {\n\t\tch <- map[string][]int{\"a\": {1, 2}}[x]\n\t}\n\tswitch y := z.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\treturn 1, nil\n}\n"],
    "javascript": ["import a, { b as c } from 'd'\nexport default class E extends F {\n  static x = 1\n  #p\n  async *g({ h, ...i }, [j] = []) { yield* k; }\n  get l() { return this.#p?.m ?? n }\n}\nconst f = async (x) => ({ ...y, [z]: 1, w() {} })\nif (a)\n  b()\nelse\n  c()\nfor (const q of r) { s: while (1) break s }\nlet t = `a ${b + `c`} d`, u = v / w / x, re = /a[/]b/g\nx\n  .then(y => y)\n", "const A = () => <div className=\"a\" {...b}>hi {c && <B d={1} />}</div>;\n"],
    "typescript": ["export interface A<T = any> extends B { readonly x?: string; [k: string]: unknown; f(a: number): void }\ntype C = { [K in keyof A]: A[K] } | 'x' | (typeof y)[number];\nenum D { E = 1, F }\nabstract class G<T> implements H { constructor(private readonly a: string, public b?: number) { super() } }\nfunction i(this: X, a?: string, ...r: number[]): a is string { return (a as any)!.b satisfies C }\nlet m: Map<string, Array<number>> = new Map();\ndeclare module 'x' { export const y: string }\n"],
    "tsx": ["export const C = ({ id }: { id: string }) => (\n  <section className=\"a\">\n    <h2>it's {id}</h2>\n    <></>\n  </section>\n);\n"],
    "python": ["#!/usr/bin/env python3\nfrom __future__ import annotations\n@d(1)\nasync def f(a, /, b: int = 1, *c, d=2, **e) -> x:\n    async with g() as h, i:\n        return [j async for j in k if l]\n\nclass A(B, metaclass=C):\n    x: int = 1\n    def m(self): return (yield)\n\nif (n := 10) > 5: pass\nelif a: b\nelse:\n    match x:\n        case {'a': 1, **r} | [1, *_] if z: ...\n        case A(b=1) as c:\n            pass\ntry:\n    x = f\"{a!r:>{w}}\" 'b'\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del a[1:2, ::3]\nprint(*a, sep='')\n", "print 'old', x\nexec code in ns\nraise E, 'm'\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', "3"],
    "yaml": ["# c\na:\n  b: [1, {c: d}]\n  e: |\n    text: with: colons\n     more\n  f: 'it''s'\nlist:\n- x: 1\n  y: 2\n-\n  - z\n- plain text\n  goes on\nk: \"two\n  lines\"\n---\nother: *ref\n", "%YAML 1.2\n---\n- &a x\n- *a\n- !t {}\n", "a: http://x.y:80/z # c\n"],
}
BAD = {
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { a + b; } }", "class A { void f() { List<B> c d; } }", "class A { void f() { if (x { } } }", "class A { String s = \"a; }", "class A {\n<<<<<<< HEAD\n int a;\n=======\n int b;\n>>>>>>> x\n}", "import logging\n", "class A { \0 }"],
    "csharp": ["class A { void F() { x( } }", "namespace A { class B { int f() { return 1 } } }", "def f():\n    pass\n"],
    "go": ["package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n\tif x = nil {\n\t}\n}\n", "package a\nfunc f( {\n}\n", "package a\nsee the chat of yesterday\n"],
    "javascript": ["function f( { }", "const a = ;", "interface Row { id: string }", "let x: number = 1;", "let s = 'abc\n;", "export async function f() {\n  return 1;\n"],
    "typescript": ["let a: = 1;", "interface A {\n  id string;\n}\n", "class A { x() { }", "import logging\nfrom a import b\n"],
    "tsx": ["const A = () => <div><b></div>;", "const A = () => <div>;"],
    "python": ["\tx = 1\n", "if a:\n    b\n\tc\n", "x = 098\n", 'x = f"a b!r}"\n', 'x = f"{a"\n', "def f(:\n    pass\n", "if x\n    y\n", "def f():\npass\n", "  x = 1\ny = 2\n z = 3\n", "x = 'abc\n", "<<<<<<< HEAD\nx = 1\n", "else:\n    x\n", "try:\n    x\ny\n", "x = (1,\n"],
    "json": ['{"a": 1,}x', '{"a": 1,}', '{"a" 1}', '{"a": 1}{"b": 2}', "{'a': 1}", '{"a": 01}', ""[:0] + "[1, 2"],
    "yaml": ["a: b: c\n", "a:\n\tb: 1\n", "a: 'x\n", "a:\n  b: 1\n c: 2\n", "a: 1\nplain\n", "a: [1, 2\n", "a: 1\n<<<<<<< HEAD\nb: 1\n"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert X.parses(text, language) is True
    assert X.parses(text.replace("\n", "\r\n"), language) is True


@pytest.mark.parametrize("language, text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert X.parses(text, language) is False


def test_python_agrees_with_the_compiler_on_this_library():
    import pathlib

    import lodestrata

    for path in pathlib.Path(lodestrata.__file__).parent.rglob("*.py"):
        text = path.read_text()
        ast.parse(text)
        if not text.strip():
            continue
        assert X.parses(text, "python"), path
        for cut in (len(text) // 3, len(text) // 2):
            try:
                ast.parse(text[:cut])
                valid = True
            except SyntaxError:
                valid = False
            assert X.parses(text[:cut], "python") == valid, (path, cut)


def test_no_case():
    assert X.parses("a b c", "properties") is None and X.parses("", "java") is None and X.parses("x", None) is None


def test_files(spark):
    rows = [(1, "p", "a.py", None, "x = (\n"), (2, "p", "a.py", "python", "x = 1\n"), (3, "p", "b.json", "json", None), (4, None, "c.json", "json", ""), (1, "p", "a.py", None, "x = (\n"), (None, "p", "d.py", "python", "(")]
    df = spark.createDataFrame([(*r, True) for r in rows], "file_id bigint, project string, relative string, language string, content string, valid boolean")
    checked = X.checked_files(df)
    assert {r.file_id: r.valid for r in checked.collect()} == {1: False, 2: True, 3: None, 4: None}
    (rate,) = X.invalid_rates(checked).collect()
    assert (rate.project, rate.language, rate.n_files, rate.n_invalid, rate.invalid_rate) == ("p", "python", 2, 1, 0.5)
    assert X.checked_files(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [3, 16, 17, 33, 200])
def test_comma_behind_the_last_item_at_any_length(n):
    pairs = ", ".join(f'"k{i}": {[i, [i], {}, True][i % 4]}'.replace("True", "true") for i in range(n))
    assert X.parses(f"{{{pairs}}}", "json") and not X.parses(f"{{{pairs},}}", "json")
    calls = ", ".join(f"f{'(' * (i % 5)}{')' * (i % 5)}" if i % 5 == 1 else str(i) if i % 2 else f'"{i}"' for i in range(n))
    assert X.parses(f"class A {{ Object o = g({calls}); }}", "java") and not X.parses(f"class A {{ Object o = g({calls},); }}", "java")
    assert X.parses(f"x = g({calls},)\n", "python")


def test_long_list_with_commas_inside_items():
    items = ", ".join(f"new Pair<A, B>({i}, f{i}.g(){'.h()' * (i % 7)})" for i in range(9_000))
    assert X.parses(f"class A {{ Object[] o = {{{items}}}; }}", "java")


@pytest.mark.parametrize("line", ["f(k=1, 2)", "f(**k, *a)", "def f(a=1, b): pass", "1 = x", "x = yield = 2", "x := 1", "f(a for a in b, c)", "(a, 1) = x", "for 1 in x: pass", "f() = 1", "del f()", "lambda a=1, b: 0"])
def test_python_order_and_targets(line):
    with pytest.raises(SyntaxError):
        compile(line, "x", "exec")
    assert X.parses(line + "\n", "python") is False


GOOD_LINES = ["f(*a, b, k=1, *c, **d)", "def f(a, b=1, /, c=2, *, d, e=3, **g): pass", "(x := 1)", "(a, [b, *c]) = x", "for a.b, c[0] in x: pass", "f().x = 1", "del a, (b, c[1])", "with (open(a) as b, c as d.e): pass", "a[b:=1, ::2]", "x = *a, b", "{**a, 'b': 1}", "x: int = 1", "a[1:2, *b] = 3", "if x: pass\nelse: y"]


@pytest.mark.parametrize("line", GOOD_LINES)
def test_python_forms_that_are_valid(line):
    compile(line, "x", "exec")
    assert X.parses(line + "\n", "python") is True


def test_nothing_depends_on_length_or_depth():
    many = "[" + ",".join('{"id": %d, "k%d": [%s]}' % (i, i, ",".join(f"[{j}]" for j in range(i % 7))) for i in range(20_000)) + "]"
    assert X.parses(many, "json") and X.parses(many[:-1] + ",]", "json") is False
    assert X.parses("[" * 100_000 + "]" * 100_000, "json") and X.parses("class A { int x = " + "(" * 30_000 + "1" + ")" * 30_000 + "; }", "java")
    assert X.parses("f(lambda a, b: 0, " + ", ".join(f"a{i} + g(b)[{i}]" for i in range(2_000)) + ")\n", "python")
    assert X.parses("a: [\n" + "".join(f"  x{i},\n" for i in range(20_000)) + "]\n", "yaml") and X.parses("a: '\n" + "  x\n" * 20_000 + "  '\n", "yaml")
    assert X.parses("a:\n" + "".join(f"- n{i}: {{b: {i}, c: [1, 2]}}\n  d: 'x'\n" for i in range(5_000)), "yaml")
    assert X.parses("const A = () => (" + "<div>" * 2_000 + "x" + "</div>" * 2_000 + ");", "tsx")


@pytest.mark.parametrize("text, valid", [("a:\n-\tx\n b: [\n", False), ("a:\n-\tx\n- y\n", True), ("a: - b\n", False), ("a: b\n  - c\n", True), ("? a\n: b\n", True), ("- - a\n  - b\n- c: 1\n  d: 2\n", True), ("a: 1\n b: 2\n", False), ("- a\nb: 1\n", False), ("a:\n  - b\n c: 1\n", False), ("--- |\n text: [\n...\n---\na: 1\n", True), ("a: {b: [c, d}\n", False), ('"k": v\n\'l\': w\n', True)])
def test_yaml_blocks(text, valid):
    assert X.parses(text, "yaml") is valid

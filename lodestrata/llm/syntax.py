"""Source files that do not parse: every dialect of a file's language is tried by generalised LL."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import grammars
from lodestrata.llm.gll import Grammar, Unbalanced
from lodestrata.llm.lexing import language_of

Tokens = list[str]
_BAD = "\x00"

# --- tokens ---

_WORD = r"[^\W\d]\w*"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[A-Za-z]{0,3}"
_LINE_COMMENT, _BLOCK_COMMENT = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*\*/"
_C_STRING, _C_CHAR = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|x[0-9a-fA-F]+|U[0-9a-fA-F]{8}|[0-7]{1,3}|.))'"
_JS_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+>])|(?<=[=(,:;!&|?{}\[+>] )|(?<=return )|(?<=case )|(?<=typeof ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"

_LEX = {
    "java": rf'{_LINE_COMMENT}|{_BLOCK_COMMENT}|"""(?:[^"\\]|\\.|"(?!""))*"""|{_C_STRING}|{_C_CHAR}|{_NUM}|[\w$]+|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|[+\-*/%&|^=!<]=|>=|<<|\S',
    "csharp": rf'{_LINE_COMMENT}|{_BLOCK_COMMENT}|(?m:^[ \t]*#[^\n]*)|\$*"""(?:[^"]|"(?!""))*"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$"(?:[^"\\\n{{}}]|\\.|\{{\{{|\}}\}}|\{{(?:[^{{}}"\n]|"(?:[^"\\\n]|\\.)*")*\}})*"|{_C_STRING}|{_C_CHAR}|{_NUM}|@?{_WORD}|\.\.|->|=>|::|\+\+|--|&&|\|\||\?\?=|\?\?|\?\.(?!\d)|<<=|[+\-*/%&|^=!<]=|>=|<<|\S',
    "go": rf"{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_C_STRING}|`[^`]*`|{_C_CHAR}|{_NUM}|{_WORD}|\n|\.\.\.|<-|:=|\+\+|--|&&|\|\||<<=|>>=|&\^=|&\^|[+\-*/%&|^=!<>]=|<<|>>|\S",
    "script": rf"{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_JS_REGEX}|{_C_STRING}|'(?:[^'\\\n]|\\(?:.|\n))*'|`(?:[^`\\]|\\(?:.|\n))*`|{_NUM}|[\w$]+|\n|\.\.\.|=>|\?\.(?!\d)|\*\*=|\*\*|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|===|!==|<<=|[+\-*/%&|^=!<]=|>=|<<|\S",
    "python": rf'#[^\n]*|(?:[fFtT][rR]?|[rR][fFtT])"(?!"")(?:[^"\\\n{{]|\\.|\{{\{{|\{{(?:[^{{}}"\n]|"[^"\n]*"|\{{[^{{}}\n]*\}})*\}})*"|[rRbBuUfFtT]{{0,2}}(?:"""(?:[^"\\]|\\(?:.|\n)|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\(?:.|\n)|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\(?:.|\n))*"|\'(?:[^\'\\\n]|\\(?:.|\n))*\')|{_NUM}|{_WORD}|\\\r?\n|\n[ \t\f]*|\.\.\.|->|:=|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|<>|[+\-*/%&|^=!<>@]=|\S',
    "json": rf'{_LINE_COMMENT}|{_BLOCK_COMMENT}|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}))*"|(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z_$][\w$]*|\S',
}
_LEXER = {k: re.compile(v) for k, v in _LEX.items()}
_START = re.compile(r"[^\W\d]|[$_@]")


class Lexicon:
    """Token text to token class of one grammar; names fall to n, numbers to 0 and so on by their first character."""

    def __init__(self, grammar: Grammar):
        self.known = {text: code for text, code in grammar.codes.items() if len(text) > 1 or not text.isalpha()}
        for ch in "()[]{}.,;:?@=+-*/%<>!~&|^#":
            self.known[ch] = ch
        self.name, self.string, self.char, self.template, self.regex, self.jsx = (grammar.code(c) for c in "nsctrj")
        self.end = len(self.known)

    def of(self, text: str) -> str:
        code = self.known.get(text)
        if code is not None:
            return code
        first = text[0]
        if first in "\"'`":
            return self.quoted(text)
        if first.isdigit() or (first == "." and len(text) > 1 and text[1].isdigit()):
            return "0"
        if _START.match(first):
            code = self.quoted(text) if text[-1] in "\"'" and len(text) > 1 else self.name
            if code == self.name and len(self.known) < 50_000:
                self.known[text] = code
            return code
        if first == "/" and len(text) > 1:
            return self.regex
        return _BAD

    def quoted(self, text: str) -> str:
        if len(text) < 2:
            return _BAD
        return self.template if text[0] == "`" and self.template else self.string


#: Tokens that go on with what a closing brace or a line ended, and the rules whose content is a sequence of parts.
_GOES_ON = {
    "java": "else catch finally while instanceof implements ++ -> :: == != && ||",
    "csharp": "else catch finally while is as switch with when where ?. ?? == != && || =>",
    "script": "else catch finally while from as satisfies instanceof in of ?. ?? == === != !== && || => extends implements",
    "go": "",
}
_LISTS = {
    "java": {"Stmts": "Stmts", "Top": "Top", "Body": "Body"},
    "csharp": {"Stmts": "Stmts", "Top": "Top", "Members": "Members"},
    "script": {"Stmts": "Stmts", "Top": "Top", "Block": "Stmts"},
    "go": {"Stmts": "Stmts", "Top": "Top"},
    "python": {f"{rule}{v}": f"{rule}{v}" for rule in ("File", "Block") for v in "23"},
    "yaml": {"Map": "Map", "Seq": "Seq"},
}
_SOURCE = {"java": grammars.JAVA, "csharp": grammars.CSHARP, "go": grammars.GO, "script": grammars.SCRIPT, "javascript": grammars.JAVASCRIPT, "python": grammars.PYTHON, "json": grammars.JSON, "yaml": grammars.YAML}


@lru_cache(maxsize=16)
def _grammar(name: str) -> tuple[Grammar, Lexicon]:
    kind = "script" if name == "javascript" else name
    if kind == "python":
        on = "elif else except finally"
    elif kind in _GOES_ON:
        on = " ".join([_GOES_ON[kind], *(".,;)?:=+-*/%<>&|^!" if kind != "go" else "")])
    else:
        on = ""
    grammar = Grammar(_SOURCE[name], _LISTS.get(kind), on, lines=kind in ("python", "yaml"))
    return grammar, Lexicon(grammar)


# --- brace languages ---


def _classes(texts: list[str], lexicon: Lexicon) -> Tokens:
    get, of = lexicon.known.get, lexicon.of
    return [get(t) or of(t) for t in texts if not t.startswith(("//", "/*"))]


def _java(text: str) -> bool:
    grammar, lexicon = _grammar("java")
    tokens = _classes(_LEXER["java"].findall(text), lexicon)
    return _BAD not in tokens and grammar.accepts("Top", grammar.folded_text(tokens))


def _csharp(text: str) -> bool:
    grammar, lexicon = _grammar("csharp")
    texts = [t for t in _LEXER["csharp"].findall(text) if not t.lstrip(" \t").startswith("#")]
    tokens = [lexicon.string if t[0] in "$@" and t[-1] == '"' and len(t) > 2 else c for t, c in ((t, lexicon.known.get(t) or lexicon.of(t)) for t in texts if not t.startswith(("//", "/*")))]
    return _BAD not in tokens and grammar.accepts("Top", grammar.folded_text(tokens))


def _go(text: str) -> bool:
    """A line's last token gets a semicolon behind it if it is a name, a literal, a closing bracket or a word that can end a statement."""
    grammar, lexicon = _grammar("go")
    ends = {lexicon.name, "0", lexicon.string, lexicon.char, ")", "]", "}", *(grammar.code(w) for w in ("break", "continue", "fallthrough", "return", "++", "--"))}
    known, of, tokens = lexicon.known.get, lexicon.of, []
    for t in _LEXER["go"].findall(text + "\n"):
        if t == "\n":
            if tokens and tokens[-1] in ends:
                tokens.append(";")
        elif not t.startswith("//"):
            if not t.startswith("/*"):
                tokens.append(lexicon.string if t[0] == "`" and len(t) > 1 else known(t) or of(t))
            elif "\n" in t and tokens and tokens[-1] in ends:
                tokens.append(";")
    return _BAD not in tokens and grammar.accepts("Top", grammar.folded_text(tokens))


class _NotParsed(Exception):
    pass


_TAG_NAME = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?")
_TAG_ATTRIBUTE = re.compile(r"\s*(?:([A-Za-z_$][\w$:.-]*)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(\{)))?|(\{))")


def _braces_end(text: str, at: int) -> int:
    """Place behind the brace that closes the one at `at`; strings and comments don't count."""
    depth = 0
    for m in re.compile(rf"{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_C_STRING}|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[{{}}]", re.S).finditer(text, at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if not depth:
                return m.end()
    raise _NotParsed


class _Unclosed(_NotParsed):
    """A markup element that the text ends in."""


_SPACE, _CLOSING = re.compile(r"\s*"), re.compile(r"</\s*([\w$.:-]*)\s*>")


def _tag_end(text: str, at: int, typed: bool) -> tuple[str | None, int]:
    """(name of the element opened at `at`, null if it closes itself; place behind the tag); braces are recognised on the way."""
    m = _TAG_NAME.match(text, at + 1)
    name, i = m.group(1) or "", m.end()
    while name:
        a = _TAG_ATTRIBUTE.match(text, i)
        if not a:
            break
        i = a.end()
        if a.group(2) or a.group(3):
            end = _braces_end(text, i - 1)
            inside = text[i : end - 1].strip()
            inside = inside[3:] if a.group(3) and inside.startswith("...") else inside
            if not _script(_without_markup(inside, typed), typed, "Es"):
                raise _NotParsed
            i = end
    i = _SPACE.match(text, i).end()
    if text.startswith("/>", i) and name:
        return None, i + 2
    if not text.startswith(">", i):
        raise _NotParsed
    return name, i + 1


def _element_end(text: str, at: int, typed: bool) -> int:
    """Place behind the markup element that starts at `at`; elements within it are kept on a stack."""
    name, i = _tag_end(text, at, typed)
    opened = [] if name is None else [name]
    while opened:
        if i >= len(text):
            raise _Unclosed
        if text[i] == "{":
            end = _braces_end(text, i)
            inside = re.sub(rf"{_BLOCK_COMMENT}|{_LINE_COMMENT}", "", text[i + 1 : end - 1]).strip()
            if inside and not _script(_without_markup(inside, typed), typed, "Es"):
                raise _NotParsed
            i = end
        elif text[i] == "<":
            if closing := _CLOSING.match(text, i):
                if closing.group(1) != opened.pop():
                    raise _NotParsed
                i = closing.end()
            else:
                name, i = _tag_end(text, i, typed)
                opened += [] if name is None else [name]
        elif text[i] in ">}":
            raise _NotParsed
        else:
            i = _TEXT_RUN.match(text, i).end()
    return i


_TEXT_RUN = re.compile(r"[^<>{}]+")
_MARKUP_AT = re.compile(r"(?:[=(,:?&|\[{>;}]|\breturn|\bdefault|^)\s*(<(?=[A-Za-z>]))", re.M)
_TRIVIA = re.compile(rf"{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_C_STRING}|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)


def _without_markup(text: str, typed: bool) -> str:
    """Markup elements replaced by one name each."""
    if "</" not in text and "/>" not in text:
        return text
    blank = _TRIVIA.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out, last = [], 0
    for m in _MARKUP_AT.finditer(blank):
        if m.start(1) < last:
            continue
        try:
            end = _element_end(text, m.start(1), typed)
        except _Unclosed:
            raise
        except _NotParsed:
            continue  # no markup, or broken: the grammar decides
        out += [text[last : m.start(1)], " markup_ "]
        last = end
    return "".join([*out, text[last:]])


def _template_parts(text: str) -> list[str]:
    """Expressions inside the ${} of a template literal."""
    parts, i = [], 0
    while (i := text.find("${", i)) >= 0:
        end = _braces_end(text, i + 1)
        parts.append(text[i + 2 : end - 1])
        i = end
    return parts


def _script(text: str, typed: bool, rule: str = "Top") -> bool:
    """JavaScript and TypeScript; line breaks become semicolons where a statement may end and the next token can't go on."""
    grammar, lexicon = _grammar("script" if typed else "javascript")
    code = grammar.code
    get, of, name = lexicon.known.get, lexicon.of, lexicon.name
    heads = {code(w) for w in ("if", "for", "while", "with")}
    ends = {name, "0", lexicon.string, lexicon.template, lexicon.regex, ")", "]", "}", *(code(w) for w in ("true", "false", "null", "this", "super", "break", "continue", "return", "debugger", "++", "--", "any"))}
    ends |= {code(w) for w in ("of", "from", "get", "set", "type", "async", "target", "global", "as", "void")} | ({"!"} if typed else set())
    goes_on = {".", ",", ";", ":", "?", "=", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^", ")", "]", "}", "(", "[", lexicon.template}
    goes_on |= {code(w) for w in ("?.", "**", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "=>", "in", "instanceof", "else", "catch", "finally", "+=", "-=", "*=", "/=")}
    tokens: Tokens = []
    opened: list[tuple[str, int]] = []
    head_close = -1
    pending = False
    for t in _LEXER["script"].findall(text):
        if t == "\n" or (t.startswith("/*") and "\n" in t):
            pending = True
            continue
        if t.startswith(("//", "/*")):
            continue
        c = get(t) or of(t)
        if c == lexicon.template and "${" in t and not all(_script(p.strip(), typed, "Es") for p in _template_parts(t)):
            return False
        if pending:
            inside = opened[-1][0] if opened else "{"
            if inside == "{" and tokens and tokens[-1] in ends and (c not in goes_on or (c == code("else") and tokens[-1] != "}")) and head_close != len(tokens) - 1 and not (tokens[-1] == "}" and c in (code("while"), code("from"))):
                tokens.append(";")
            pending = False
        if c in ("(", "[", "{"):
            opened.append((c, len(tokens)))
        elif c in (")", "]", "}") and opened:
            _, start = opened.pop()
            if c == ")" and start and (tokens[start - 1] in heads or (tokens[start - 1] == code("await") and start > 1 and tokens[start - 2] in heads)):
                head_close = len(tokens)
        tokens.append(c)
    if rule == "Top" and tokens and tokens[-1] in ends and tokens[-1] != "}":
        tokens.append(";")
    return _BAD not in tokens and grammar.accepts(rule, grammar.folded_text(tokens))


def _plain_templates(text: str, typed: bool) -> str:
    """The text with the expressions of its template literals recognised and cut to ${0}; needed where literals nest."""
    out, i, last = [], 0, 0
    skip = re.compile(rf"{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_C_STRING}|'(?:[^'\\\n]|\\.)*'|`", re.S)
    while m := skip.search(text, i):
        i = m.end()
        if m.group() != "`":
            continue
        while i < len(text) and text[i] != "`":
            if text.startswith("${", i):
                depth, j = 1, i + 2
                while j < len(text) and depth:
                    if text[j] == "`":
                        j = _template_end(text, j)
                        continue
                    depth += (text[j] == "{") - (text[j] == "}")
                    j += 1
                if depth or not _script(_plain_templates(text[i + 2 : j - 1], typed).strip(), typed, "Es"):
                    raise _NotParsed
                out += [text[last:i], "${0}"]
                i = last = j
            else:
                i += 2 if text[i] == "\\" else 1
        i += 1
    return "".join([*out, text[last:]])


def _template_end(text: str, at: int) -> int:
    """Place behind the template literal that starts at `at`."""
    i = at + 1
    while i < len(text) and text[i] != "`":
        if text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 2 if text[i] == "\\" else 1
    return i + 1


_NESTED_TEMPLATE = re.compile(r"\$\{[^{}`]*`")


def _scripted(typed: bool, markup: bool) -> Callable[[str], bool]:
    def parse(text: str) -> bool:
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        if _NESTED_TEMPLATE.search(text):
            text = _plain_templates(text, typed)
        return _script(_without_markup(text, typed) if markup else text, typed)

    return parse


# --- Python ---

_OLD_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*[lL]?$")


@lru_cache(maxsize=100_000)
def _fields_closed(literal: str) -> bool:
    """Whether the replacement fields of a formatted string literal are closed and not empty."""
    depth, i, size, opened = 0, 0, len(literal), -1
    while i < size:
        ch = literal[i]
        if not depth and ch in "{}" and literal[i + 1 : i + 2] == ch:
            i += 2
            continue
        if ch == "{":
            depth += 1
            opened = i
        elif ch == "}":
            depth -= 1
            if depth < 0 or not literal[opened + 1 : i].strip():
                return False
        i += 1
    return not depth


def _python(text: str) -> bool:
    """Logical lines end in ¶, what is indented stands between ⟨ and ⟩; both dialects run together on the result."""
    grammar, lexicon = _grammar("python")
    get, of = lexicon.known.get, lexicon.of
    tokens: Tokens = []
    indents = [(0, 0)]
    fresh, depth, new = True, 0, True
    text = text.replace("\r\n", "\n").replace("\r", "\n") + "\n"
    pad = text[: len(text) - len(text.lstrip(" \t\f"))]
    for t in _LEXER["python"].findall(text):
        first = t[0]
        if first == "\n":
            if depth:
                continue
            if not fresh:
                tokens.append("¶")
                fresh = True
            pad = t[1:]
            continue
        if first in "#\\" and (first == "#" or t[-1] == "\n"):
            continue
        if fresh:
            fresh = False
            pad = pad[pad.rfind("\f") + 1 :]
            indent = len(pad.expandtabs(8)), len(pad)  # tabs must mean the same whatever their width
            if indent[0] > indents[-1][0] and indent[1] > indents[-1][1]:
                tokens.append("⟨")
                indents.append(indent)
            else:
                while indent[0] < indents[-1][0]:
                    tokens.append("⟩")
                    indents.pop()
                if indent != indents[-1]:
                    return False
        if t[-1] in "\"'" and len(t) > 1:
            c = lexicon.string
            if (first in "fFtT" or t[1] in "fFtT") and first not in "\"'" and ("{" in t or "}" in t) and not _fields_closed(t):
                return False
        else:
            c = get(t) or of(t)
        if c == _BAD:
            return False
        if c == "0" and first == "0" and _OLD_OCTAL.match(t):
            new = False
            if set(t) & set("89"):
                return False
        elif t == "<>":
            new = False
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        tokens.append(c)
    if not fresh or depth:
        return False
    tokens += ["⟩"] * (len(indents) - 1)
    return grammar.accepts(("File3", "File2") if new else "File2", grammar.folded_text(tokens))


# --- JSON and YAML ---


def _json(text: str) -> bool:
    """JSON with or without comments: one grammar, comments are dropped before it."""
    grammar, lexicon = _grammar("json")
    known = lexicon.known
    tokens = []
    for t in _LEXER["json"].findall(text):
        if t.startswith(("//", "/*")):
            continue
        c = lexicon.string if t[0] == '"' and len(t) > 1 else "0" if t[0].isdigit() else known.get(t) if t in known and t not in ";?=+*/%<>!~&|^#@.()" else _BAD
        tokens.append(c)
    return _BAD not in tokens and grammar.accepts("Top", grammar.folded_text(tokens))


_YAML_TOKEN = re.compile(
    r'(?P<s>"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\')|(?P<x>(?:(?<=\s)|^)#[^\n]*)|(?P<p>[&!][^\s,\[\]{}]*)|(?P<v>\*[^\s,\[\]{}]+)|(?P<d>(?:(?<=\s)|^)-(?=\s|$))|(?P<q>(?:(?<=\s)|^)\?(?=\s|$))|(?P<k>:(?=[\s,\[\]{}]|$)|(?<=["\'\]}]):)|(?P<b>[\[\]{},])|(?P<a>[^\s#,\[\]{}:&*!|>\'"%@`-](?:[^\s,\[\]{}:]|:(?![\s,\[\]{}]|$)| +(?![#\s])(?=[^\s,\[\]{}:])| +(?=:(?!\s|$)))*|-(?=\S)(?:[^\s,\[\]{}:]|:(?!\s|$)| +(?!#))*|:(?=\S)[^\s,\[\]{}]*)|(?P<e>\S)',
    re.S,
)
_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\\n]|\\.)*+\"[ \t]*+|'(?:[^'\n]|'')*+'[ \t]*+|(?:[^\s#\"'\[\]{}&*!|>%@`,?:-]|[?:-](?=\S))(?:[^#:\n]|(?<=\S)#|:(?=[^\s]))*+|\*[^\s:]+[ \t]*+)?:(?:[ \t]++|$)")
_YAML_PROPS = re.compile(r"(?:[&!][^\s,\[\]{}]*(?:[ \t]++|$))++")
_YAML_QUOTED = {'"': re.compile(r'"(?:[^"\\]|\\.)*+"', re.S), "'": re.compile(r"'(?:[^']|'')*+'")}
_BLOCK_HEAD = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)(?:[ \t]+#.*)?$")
_REMARK = re.compile(r"(?:[ \t]+#.*|[ \t]*)$")
_IN_PLAIN = re.compile(r":(?:\s|$)")
_AFTER_SPACE = re.compile(r"(?<=\s)#")


class _YamlLexer:
    """Turns indentation and scalars of YAML into tokens, in one pass; raises _NotParsed where no token fits."""

    def __init__(self, text: str, grammar: Grammar):
        self.text, self.tokens, self.columns = text, [], []
        self.code = {c: grammar.code(c) for c in "asdkbm"}
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def end(self, i: int) -> int:
        return (self.starts[i + 1] - 1) if i + 1 < len(self.starts) else len(self.text)

    def column(self, i: int) -> int:
        """Indentation of line i, -1 if it is blank."""
        line = self.text[self.starts[i] : self.end(i)]
        bare = line.lstrip(" ")
        return len(line) - len(bare) if bare.strip() else -1

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def place(self, column: int) -> None:
        """Opens or closes blocks so that an entry can stand at `column`."""
        columns = self.columns
        if not columns or column > columns[-1]:
            columns.append(column)
            self.tokens.append("⟨")
            return
        while columns and columns[-1] > column:
            columns.pop()
            self.tokens.append("⟩")
        if not columns or columns[-1] != column:
            raise _NotParsed

    def run(self) -> Tokens:
        text, tokens, code = self.text, self.tokens, self.code
        i, plain, started = 0, None, False  # plain: a scalar may go on in lines deeper than this
        while i < len(self.starts):
            start, end = self.starts[i], self.end(i)
            at = start
            while at < end and text[at] == " ":
                at += 1
            body = text[at:end].strip()
            i += 1
            if not body or body[0] == "#":
                continue
            if at == start and text.startswith(("---", "..."), start) and (start + 3 >= end or text[start + 3] in " \t"):
                tokens += ["⟩"] * len(self.columns)
                self.columns, plain, started = [], None, True
                tokens.append(code["m"])
                at = start + 3
                while at < end and text[at] in " \t":
                    at += 1
                if text[start] == "-" and at < end and text[at] != "#":
                    if props := _YAML_PROPS.match(text, at, end):
                        tokens.append("&")
                        at = props.end()
                    if at < end:
                        i, _ = self.value(at, end, i, -1)
                    tokens.append("¶")
                continue
            if not started and body[0] == "%":
                continue
            started = True
            if text[at] == "\t":
                raise _NotParsed
            if plain is not None and at - start > plain and not _YAML_KEY.match(text, at, end):
                continue
            plain = None
            i, plain = self.entries(start, at, end, i)
            tokens.append("¶")
        return [*tokens, *("⟩" for _ in self.columns)]

    def entries(self, start: int, at: int, end: int, i: int) -> tuple[int, int | None]:
        """Dashes, keys and the value of one line; (next line, owner's column of a plain scalar that may go on)."""
        text, tokens, code = self.text, self.tokens, self.code
        owner = None
        while True:
            column = at - start
            rest = text[at : at + 2]
            if rest[0] in "-?" and (at + 1 >= end or rest[1] in " \t"):
                self.place(column)
                tokens.append(code["d"] if rest[0] == "-" else "?")
                owner, tabbed = column, False
                at += 1
                while at < end and text[at] in " \t":
                    tabbed |= text[at] == "\t"
                    at += 1
                if at >= end or text[at] == "#":
                    return i, None
                if tabbed and (_YAML_KEY.match(text, at, end) or (text[at] == "-" and text[at + 1 : at + 2] in (" ", "\t"))):
                    raise _NotParsed
                continue
            props = _YAML_PROPS.match(text, at, end)
            behind = props.end() if props else at
            key = _YAML_KEY.match(text, behind, end)
            if key:
                self.place(column)
                if props:
                    tokens.append("&")
                tokens += self.key(key.group()) + [code["k"]]
                owner, at = column, key.end()
                if props := _YAML_PROPS.match(text, at, end):
                    tokens.append("&")
                    at = props.end()
                if at >= end or text[at] == "#":
                    return i, None
                if text[at] in "-?" and text[at + 1 : at + 2] in (" ", "\t", "\n", ""):
                    raise _NotParsed
                return self.value(at, end, i, owner)
            if owner is None:
                self.place(column)  # a scalar or flow collection that stands alone
                owner = self.columns[-2] if len(self.columns) > 1 else -1
            if props:
                tokens.append("&")
                at = behind
                if at >= end or text[at] == "#":
                    return i, None
            return self.value(at, end, i, owner)

    def key(self, raw: str) -> Tokens:
        name = raw.rstrip(" \t")[:-1].rstrip(" \t")
        return [] if not name else ["*"] if name[0] == "*" else [self.code["s" if name[0] in "\"'" else "a"]]

    def value(self, at: int, end: int, i: int, owner: int) -> tuple[int, int | None]:
        text, tokens, code, ch = self.text, self.tokens, self.code, self.text[at]
        if ch in "|>":
            if not _BLOCK_HEAD.match(text[at:end].rstrip()):
                raise _NotParsed
            while i < len(self.starts) and (self.column(i) > owner or self.column(i) < 0):
                if owner < 0 and text.startswith(("---", "..."), self.starts[i]):
                    break
                i += 1
            tokens.append(code["b"])
            return i, None
        if ch in "\"'":
            m = _YAML_QUOTED[ch].match(text, at)
            if not m:
                raise _NotParsed
            tokens.append(code["s"])
            return self.behind(m.end(), i, owner), None
        if ch in "[{":
            return self.behind(self.flow(at, owner), i, owner), None
        if ch in "@`%]},":
            raise _NotParsed
        if ch == "*":
            if not re.match(r"\*\S+(?:\s+#.*)?$", text[at:end].rstrip()):
                raise _NotParsed
            tokens.append("*")
            return i, None
        remark = _AFTER_SPACE.search(text, at, end)
        if _IN_PLAIN.search(text, at, remark.start() if remark else end):
            raise _NotParsed
        tokens.append(code["a"])
        return i, owner

    def behind(self, at: int, i: int, owner: int) -> int:
        """Next line after a value that ends at `at`, which may be lines further down; only a remark or the colon of a key follows."""
        last = self.line_of(at)
        for k in range(i, last + 1):
            column = self.column(k)
            if 0 <= column <= owner and self.text[self.starts[k] + column] not in "]}":
                raise _NotParsed
        rest = self.text[at : self.end(last)]
        if not _REMARK.match(rest):
            raise _NotParsed
        return last + 1

    def flow(self, at: int, owner: int) -> int:
        text, tokens, code, depth, last = self.text, self.tokens, self.code, 0, None
        for m in _YAML_TOKEN.finditer(text, at):
            kind = m.lastgroup
            if kind == "x":
                continue
            if kind == "e":
                raise _NotParsed
            if kind == "a" and last is not None and "\n" in text[last : m.start()]:
                continue  # a plain scalar that goes on in the next line
            last = m.end() if kind == "a" else None
            tokens.append({"s": code["s"], "a": code["a"], "d": code["a"], "q": "?", "k": code["k"], "v": "*", "p": "&"}.get(kind) or m.group())
            if kind == "b":
                depth += (m.group() in "[{") - (m.group() in "]}")
                if not depth:
                    return m.end()
        raise _NotParsed


def _yaml(text: str) -> bool:
    grammar, _ = _grammar("yaml")
    tokens = _YamlLexer(text.replace("\r\n", "\n").replace("\r", "\n"), grammar).run()
    return grammar.accepts("Top", grammar.folded_text(tokens))


# --- dialects ---

#: How a language's dialects are read; a file is fine if one of them takes it. Dialects of one token stream run together
#: in one grammar; markup in scripts is another token stream and is tried only where a text has any.
DIALECTS: dict[str, list[Callable[[str], bool]]] = {
    "java": [_java],
    "csharp": [_csharp],
    "go": [_go],
    "javascript": [_scripted(False, False), _scripted(False, True)],
    "typescript": [_scripted(True, False)],
    "tsx": [_scripted(True, True), _scripted(True, False)],
    "python": [_python],
    "json": [_json],
    "yaml": [_yaml],
}


def parses(text: str, language: str | None) -> bool | None:
    """Whether a text is valid in a dialect of its language; null for languages without a grammar and for blank texts.

    Null too for scripts whose template literals or markup nest deeper than the interpreter's stack allows.
    """
    dialects = DIALECTS.get(language or "")
    if not dialects or not text.strip():
        return None
    if "\0" in text:
        return False
    text = text.removeprefix("\ufeff")
    if len(dialects) > 1 and "</" not in text and "/>" not in text:
        dialects = dialects[:1]
    too_deep = False
    for parse in dialects:
        try:
            if parse(text):
                return True
        except (Unbalanced, _NotParsed):
            continue
        except RecursionError:
            too_deep = True
    return None if too_deep else False


@F.pandas_udf(T.BooleanType())
def valid_syntax(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([parses(c, lang) if c else None for c, lang in zip(content, language)], dtype="object")


def checked_files(files: DataFrame) -> DataFrame:
    """file_id, project, language, valid; null for files without content or grammar. Repeated rows count once."""
    language = language_of()
    whole = files.where("file_id is not null").select("file_id", "project", language.alias("language"), valid_syntax("content", language).alias("valid"))
    return whole.groupBy("file_id").agg(F.min("project").alias("project"), F.min("language").alias("language"), F.min("valid").alias("valid"))


def invalid_rates(checked: DataFrame) -> DataFrame:
    """Per project and language: files that could be checked, invalid ones and their share."""
    judged = checked.where("valid is not null")
    return judged.groupBy("project", "language").agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_rate")
    )

"""Configuration formats read into key paths with the offsets of their values; broken files give what can be read."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

FORMATS = ("yaml", "json", "properties", "toml", "ini", "env", "xml")


@dataclass(frozen=True, eq=False)
class Node:
    """A key (or the 0-based place in a list) below its parent."""

    parent: Node | None
    key: str | int

    def path(self) -> tuple[str | int, ...]:
        found, at = [], self
        while at is not None and at.key != "":
            found.append(at.key)
            at = at.parent
        return tuple(reversed(found))

    def names(self, n: int) -> list[str]:
        """The last n keys, places in lists left out, the innermost last."""
        found: list[str] = []
        at: Node | None = self
        while at is not None and len(found) < n:
            if isinstance(at.key, str) and at.key:
                found.append(at.key)
            at = at.parent
        return found[::-1]


@dataclass(frozen=True)
class Pair:
    node: Node
    value: str
    spans: tuple[tuple[int, int], ...]


_A = re.A
_FLOW = {
    "json": re.compile(r'(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|"(?P<s>(?:[^"\\\n]|\\.)*)"|(?P<b>[{}\[\],:])|(?P<p>[^\s{}\[\],:"]+)', _A | re.S),
    "yaml": re.compile(r"""(?P<c>(?<!\S)\#[^\n]*)|"(?P<s>(?:[^"\\]|\\.)*)"|'(?P<t>(?:[^']|'')*)'|(?P<b>[{}\[\],]|:(?=[\s,\[\]{}"']|$))|(?P<p>[^\s,\[\]{}"'](?:[^\s,\[\]{}:]|:(?![\s,\[\]{}]|$)|[ \t]+(?![\s\#,\[\]{}:]))*)""", _A | re.S | re.X),
    "toml": re.compile(r"""(?P<c>\#[^\n]*)|"(?P<s>(?:[^"\\\n]|\\.)*)"|'(?P<t>[^'\n]*)'|(?P<b>[{}\[\],=])|(?P<p>[^\s,\[\]{}="']+)""", _A | re.X),
}


def _flow(s: str, at: int, root: Node, form: str, out: list[Pair], whole: bool) -> int:
    """Reads brackets, keys and values from `at`; returns where they close. `whole` texts are read to their end."""
    frames: list[list] = []  # node of the collection, is a mapping, key seen, colon seen, place

    def node() -> Node:
        if not frames:
            return root
        owner, mapping, key, colon, place = frames[-1]
        return Node(owner, key if mapping and colon else "" if mapping else place)

    for m in _FLOW[form].finditer(s, at):
        kind = m.lastgroup
        if kind == "c":
            continue
        if kind != "b":
            if frames and frames[-1][1] and not frames[-1][3]:
                frames[-1][2] = m.group(kind)
            else:
                out.append(Pair(node(), m.group(kind), (m.span(kind),)))
                if not frames and not whole:
                    return m.end()
            continue
        ch = m.group()
        if ch in "{[":
            frames.append([node(), ch == "{", "", False, 0])
        elif ch in "}]":
            if frames:
                frames.pop()
            if not frames and not whole:
                return m.end()
        elif frames and ch == ",":
            frames[-1][2:] = ["", False, frames[-1][4] + 1]
        elif frames and ch in ":=":
            frames[-1][3] = True
    return len(s)


def _end_of_line(s: str, at: int) -> int:
    end = s.find("\n", at)
    return len(s) if end < 0 else end


_YAML_KEY = re.compile(r"""(?P<key>"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|[^\s"'#\[\]{},&*!|>%@`][^\n]*?|[*][^\s:]+):(?=[ \t\r\n]|\Z)[ \t]*""", _A)
_YAML_PROPS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)+", _A)
_YAML_QUOTED = {'"': re.compile(r'"((?:[^"\\]|\\.)*)"', _A | re.S), "'": re.compile(r"'((?:[^']|'')*)'", _A | re.S)}
_CUT = re.compile(r"(?<=[ \t])#[^\n]*", _A)


def _yaml(s: str, out: list[Pair]) -> None:
    stack: list[tuple[int, str, Node]] = []  # column, k or -, node
    places: Counter = Counter()
    top = Node(None, "")
    pos = 0
    while pos < len(s):
        end = _end_of_line(s, pos)
        at = pos
        while at < end and s[at] == " ":
            at += 1
        start, pos = pos, end + 1
        if at == end or s[at] in "#\r\n%":
            continue
        if at == start and s[at : at + 3] in ("---", "...") and s[at + 3 : at + 4] in ("", " ", "\t", "\r", "\n"):
            stack = []
            at += 3
            while at < end and s[at] in " \t":
                at += 1
            if at >= end:
                continue
        owner = -1
        while True:
            column = at - start
            if s[at] == "-" and (at + 1 >= end or s[at + 1] in " \t\r"):
                while stack and (stack[-1][0] > column or (stack[-1][0] == column and stack[-1][1] == "-")):
                    stack.pop()
                parent = stack[-1][2] if stack else top
                stack.append((column, "-", Node(parent, places[parent])))
                places[parent] += 1
                owner, at = column, at + 1
                while at < end and s[at] in " \t":
                    at += 1
                if at >= end or s[at] in "\r#":
                    break
                continue
            if props := _YAML_PROPS.match(s, at, end):
                at = props.end()
                if at >= end:
                    break
            key = _YAML_KEY.match(s, at, end)
            if key and not _CUT.search(key["key"]):
                while stack and stack[-1][0] >= column:
                    stack.pop()
                stack.append((column, "k", Node(stack[-1][2] if stack else top, key["key"].rstrip(" \t").strip("\"'"))))
                owner, at = column, key.end()
                if props := _YAML_PROPS.match(s, at, end):
                    at = props.end()
            if at < end and s[at] not in "#\r":
                pos = _yaml_value(s, at, end, owner, stack[-1][2] if stack else top, out)
            break


def _yaml_value(s: str, at: int, end: int, owner: int, node: Node, out: list[Pair]) -> int:
    """Reads the value that starts at `at`; returns where the next line to read begins."""
    ch = s[at]
    if ch in "|>":
        spans, pos = [], end + 1
        while pos < len(s):
            stop = _end_of_line(s, pos)
            line = s[pos:stop]
            text = line.strip(" \t\r")
            if text and len(line) - len(line.lstrip(" ")) <= owner:
                break
            if text:
                first = pos + line.index(text)
                spans.append((first, first + len(text)))
            pos = stop + 1
        for a, b in spans:
            out.append(Pair(node, s[a:b], ((a, b),)))
        return pos
    if ch in "\"'" and (m := _YAML_QUOTED[ch].match(s, at)):
        out.append(Pair(node, m.group(1), (m.span(1),)))
        return _end_of_line(s, m.end()) + 1
    if ch in "{[":
        close = _flow(s, at, node, "yaml", out, False)
        return _end_of_line(s, close) + 1
    if ch != "*":
        cut = _CUT.search(s, at, end)
        stop = cut.start() if cut else end
        value = s[at:stop].rstrip(" \t\r")
        out.append(Pair(node, value, ((at, at + len(value)),)))
    return end + 1


_PROPERTY = re.compile(r"[ \t\f]*(?P<key>(?:[^\s#!:=\\]|\\[^\n])(?:[^\s:=\\]|\\[^\n])*)(?:[ \t\f]*[:=][ \t\f]*|[ \t\f]+|(?=\r?$))", _A)
_ASSIGN = re.compile(r"[ \t]*(?:export[ \t]+)?(?P<key>\"[^\"\n]*\"|'[^'\n]*'|[^\s#;=\[\"'][^\n=:]*+)[=:][ \t]*", _A)
_SECTION = re.compile(r"[ \t]*\[{1,2}(?P<name>[^\]\n]+)\]{1,2}[ \t]*(?:[#;][^\n]*)?\r?$", _A)


def _unquoted(s: str, at: int, end: int) -> tuple[int, int]:
    """The value between `at` and `end` without its quotes, or without a remark behind it."""
    while end > at and s[end - 1] in " \t\r":
        end -= 1
    if end - at > 1 and s[at] in "\"'" and (close := s.find(s[at], at + 1, end)) > 0:
        return at + 1, close
    cut = _CUT.search(s, at, end)
    end = cut.start() if cut else end
    while end > at and s[end - 1] in " \t":
        end -= 1
    return at, end


def _properties(s: str, out: list[Pair]) -> None:
    top, pos = Node(None, ""), 0
    while pos < len(s):
        end = _end_of_line(s, pos)
        m = _PROPERTY.match(s, pos, end)
        at, pos = (m.end() if m else end), end + 1
        if not m:
            continue
        node = top
        for part in re.sub(r"\\(.)", r"\1", m["key"]).split("."):
            node = Node(node, part)
        pieces = []
        while True:
            line = s[at:end].rstrip("\r")
            goes_on = (len(line) - len(line.rstrip("\\"))) % 2 == 1
            if not goes_on:
                pieces.append(_unquoted(s, at, end) if not pieces else (at, at + len(line.rstrip(" \t"))))
                break
            pieces.append((at, at + len(line) - 1))
            if pos >= len(s):
                break
            at, end = pos, _end_of_line(s, pos)
            while at < end and s[at] in " \t\f":
                at += 1
            pos = end + 1
        spans = tuple((a, b) for a, b in pieces if b > a)
        if spans:
            out.append(Pair(node, "".join(s[a:b] for a, b in spans), spans))


def _sections(s: str, form: str, out: list[Pair]) -> None:
    """Lines `key = value` below `[section]` heads: INI, environment files and TOML."""
    top = here = Node(None, "")
    pos = 0
    while pos < len(s):
        end = _end_of_line(s, pos)
        line, pos = pos, end + 1
        if m := _SECTION.match(s, line, end):
            here = top
            for part in m["name"].strip().split("."):
                here = Node(here, part.strip("\"' "))
            continue
        m = _ASSIGN.match(s, line, end)
        if not m:
            continue
        node = here
        for part in m["key"].strip(" \t\"'").split("."):
            node = Node(node, part.strip("\"' "))
        at = m.end()
        if form == "toml" and s[at : at + 3] in ('"""', "'''"):
            close = s.find(s[at : at + 3], at + 3)
            close = len(s) if close < 0 else close
            out.append(Pair(node, s[at + 3 : close].strip(), ((at + 3, close),)))
            pos = _end_of_line(s, close) + 1
        elif form == "toml" and s[at : at + 1] in ("{", "["):
            pos = _end_of_line(s, _flow(s, at, node, "toml", out, False)) + 1
        else:
            a, b = _unquoted(s, at, end)
            if b > a:
                out.append(Pair(node, s[a:b], ((a, b),)))


_XML = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[\w:.-]+)(?P<attributes>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>|(?P<text>[^<]+)", _A | re.S)
_XML_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", _A)


def _xml(s: str, out: list[Pair]) -> None:
    here = Node(None, "")
    for m in _XML.finditer(s):
        if m["tag"] and m["close"]:
            here = here.parent or here
        elif m["tag"]:
            node = Node(here, m["tag"])
            for a in _XML_ATTRIBUTE.finditer(s, *m.span("attributes")):
                group = 2 if a.group(2) is not None else 3
                out.append(Pair(Node(node, a.group(1)), a.group(group), (a.span(group),)))
            if not m["empty"]:
                here = node
        elif (group := "text" if m["text"] else "data" if m["data"] else "") and (body := m[group].strip()):
            at = m.start(group) + m[group].index(body)
            out.append(Pair(here, body, ((at, at + len(body)),)))


def key_paths(s: str, form: str | None) -> list[Pair]:
    """(node, value, spans) of each value of a configuration text; a value joined over lines has a span per line."""
    out: list[Pair] = []
    if form == "yaml":
        _yaml(s, out)
    elif form == "json":
        _flow(s, 0, Node(None, ""), "json", out, True)
    elif form == "properties":
        _properties(s, out)
    elif form in ("toml", "ini", "env"):
        _sections(s, form, out)
    elif form == "xml":
        _xml(s, out)
    return out


_NAMED_BY, _VALUE_OF = {"name", "key", "id", "variable", "field"}, {"value", "val", "default", "content", "secret"}


def named_pairs(pairs: list[Pair]) -> list[tuple[list[str], Pair]]:
    """Each pair with the keys that name it: its own last two, or the name beside it in `{name: X, value: Y}`."""
    beside: dict[Node, str] = {}
    for p in pairs:
        if p.node.parent is not None and str(p.node.key).lower() in _NAMED_BY:
            beside.setdefault(p.node.parent, p.value)
    found = []
    for p in pairs:
        named = beside.get(p.node.parent) if p.node.parent is not None and str(p.node.key).lower() in _VALUE_OF else None
        found.append(([named] if named else p.node.names(2), p))
    return found

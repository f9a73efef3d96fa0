"""Source files that weren't written by hand: generated, minified, third-party copies, data saved as code."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.lexing import comment_lines, language_of, trivia_pattern

#: What tools write into the head of what they generate.
_MARKER = re.compile(
    r"(?i)^(?:@generated\b|<auto-?generated\b|auto-?generated by\b|code generated by\b.*do not edit|this (?:file|code|module|class) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created) by\b"
    r"|generated by (?:the )?[\w.-]+(?: (?:compiler|v?\d)|\. do not|, do not| - do not)|.*changes will be lost (?:on|when|if)\b|.*\bgenerated (?:file|code)\b.*do not (?:edit|modify)|.*do not (?:edit|modify).*\bgenerated (?:file|code)\b)"
)
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.g(?:\.i)?\.cs|\.gen\.\w+|\.generated\.\w+|\.designer\.cs|_generated\.\w+)$")
_GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:generated(?:[-_](?:sources|src|code))?|__generated__|autogen|gen)/")
_LOCK_NAME = re.compile(r"(?i)(?:^|/)(?:package-lock[\w.-]*\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|poetry\.lock|cargo\.lock|gemfile\.lock|go\.sum|packages\.lock\.json|project\.assets\.json|[\w.-]+\.lock(?:\.(?:json|ya?ml))?)$")
_STRUCTURE = re.compile(r"[{}();]")
_LOCK_TEXT = re.compile(r'"lockfileVersion"\s*:|^lockfileVersion:|"packages"\s*:\s*\{\s*"node_modules/|^# yarn lockfile|"libraries"\s*:.*"sha512"|"contentHash"\s*:', re.M)
_VENDOR_PATH = re.compile(r"(?i)(?:^|/)(?:vendor|vendors|third[-_]?party|external|extern|libs|node_modules|bower_components|site-packages)/(?:@[^/]+/)?[^/]+/")
_MINIFIED_NAME = re.compile(r"(?i)[.-]min\.(?:js|css|mjs)$")
#: name and version at the head of a library's file: "lib v1.2.3 - ...", "lib v2.0 | MIT"
_BANNER = re.compile(r"^(?:\* )?(?P<name>@?[A-Za-z][\w./-]{1,40}) v?\d+\.\d+(?:\.\d+)*(?:[-+][\w.]+)?(?=\s*(?:[-|,(]|$))")
_ORIGIN = re.compile(r"(?i)https?://|\(c\)|copyright|licen[sc]e|\|")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)")
_BLOB = re.compile(r"^[A-Za-z0-9+/=_\\x-]{16,}$")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_CODE = ("python", "java", "csharp", "javascript", "typescript", "tsx", "go")


def canonical(code: str) -> list[tuple[int, str]]:
    """(depth, text without blanks) of each line as a formatter would write it: one statement a line, a break at each brace."""
    lines: list[tuple[int, str]] = []
    depth = parens = start = 0

    def close(end: int, at: int) -> None:
        body = "".join(code[start:end].split())
        if body:
            lines.append((at, body))

    for m in _STRUCTURE.finditer(code):
        ch = m.group()
        if ch == "(":
            parens += 1
        elif ch == ")":
            parens = max(0, parens - 1)
        elif ch == "{":
            close(m.end(), depth)
            start, depth, parens = m.end(), depth + 1, 0
        elif ch == "}":
            close(m.start(), depth)
            start, depth, parens = m.start(), max(0, depth - 1), 0
        elif not parens:
            close(m.end(), depth)
            start = m.end()
    close(len(code), depth)
    return lines


def canonical_blocks(code: str) -> list[tuple[int, str]]:
    """The same for languages of indentation: lines split at ; with the depth of their indentation."""
    lines: list[tuple[int, str]] = []
    columns = [0]
    for line in code.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        column = len(line) - len(line.lstrip())
        while len(columns) > 1 and columns[-1] > column:
            columns.pop()
        if column > columns[-1]:
            columns.append(column)
        lines += [(len(columns) - 1, "".join(part.split())) for part in bare.split(";") if part.strip()]
    return lines


class Layout:
    """A lexed file against its own canonical formatting; literals are counted."""

    def __init__(self, text: str, language: str | None):
        self.head: list[str] = []
        self.blob = self.literal = 0
        started = False
        last = 0

        def token(m: re.Match) -> str:
            nonlocal started, last
            body = m.group()
            started = started or bool(text[last : m.start()].strip())
            last = m.end()
            doc = m.lastgroup == "s" and language == "python" and body.startswith(('"""', "'''"))
            if m.lastgroup == "c" or (doc and not started):
                if not started:
                    self.head += comment_lines(body)
                return ""
            started = True
            inside = body.strip("\"'`")
            self.literal += len(inside)
            if len(inside) >= 16 and _BLOB.match(inside):
                self.blob += len(inside)
            return '"'

        code = trivia_pattern(language).sub(token, text)
        numbers = _NUMBER.findall(code)
        self.n_numbers, digits = len(numbers), sum(map(len, numbers))
        self.lines = [line for line in code.split("\n") if line.strip()]
        self.n_lines = len(self.lines)
        self.dense = sum(map(len, map(str.strip, self.lines)))
        self.emitted = canonical_blocks(code) if language in ("python", "yaml") else canonical(code)
        self.blanks = sum(line.count(" ") + line.count("\t") for line in self.lines)
        bare = len(code) - sum(code.count(c) for c in " \t\r\n,")
        self.data = digits + self.blob
        self.bare = bare + self.blob

    @property
    def expansion(self) -> float:
        """Lines of the canonical formatting for each line of the original."""
        return len(self.emitted) / max(1, self.n_lines)

    @property
    def kept(self) -> float:
        """Share of the original lines that stand in the canonical formatting as they are."""
        own = Counter("".join(line.split()) for line in self.lines)
        return sum((own & Counter(text for _, text in self.emitted)).values()) / max(1, self.n_lines)

    def uniform(self, shapes: int) -> bool:
        """Whether all canonical lines, with names and numbers masked, have at most so many shapes; stops at the first too many."""
        seen = set()
        for depth, line in self.emitted:
            seen.add((depth, _NUMBER.sub("0", _WORD.sub("a", line))))
            if len(seen) > shapes:
                return False
        return True


def reasons(text: str, language: str | None, relative: str) -> list[tuple[str, str]]:
    """(class, evidence) of a file that isn't hand-written: layout, literals, the head comment or the file's place."""
    found = []
    layout = Layout(text, language)
    head = [line.strip() for line in layout.head if line.strip()]
    if any(_MARKER.match(line) for line in head):
        found.append(("generated", "head"))
    elif language in ("json", "yaml", None) and _LOCK_TEXT.search(text):
        found.append(("generated", "content"))
    elif language in _CODE and layout.n_lines >= 40 and layout.data < 0.5 * layout.bare and layout.uniform(max(2, layout.n_lines // 25)):
        found.append(("generated", "layout"))
    elif _GENERATED_NAME.search(relative) or _GENERATED_PATH.search(relative) or _LOCK_NAME.search(relative):
        found.append(("generated", "place"))
    if any(_BANNER.match(line) for line in head) and any(_ORIGIN.search(line) for line in head):
        found.append(("vendored", "head"))
    elif _VENDOR_PATH.search(relative):
        found.append(("vendored", "place"))
    if language in ("javascript", "typescript", "tsx", "java", "csharp", None):
        crowded = layout.dense / max(1, layout.n_lines) > 200 and layout.blanks < 0.08 * layout.dense
        if layout.expansion > 5 and crowded and layout.kept < 0.5:
            found.append(("minified", "layout"))
        elif _MINIFIED_NAME.search(relative) and layout.expansion > 3:
            found.append(("minified", "place"))
    if language in _CODE and layout.data >= 400 and layout.data >= 0.6 * layout.bare:
        found.append(("data", "literals"))
    return found


def classes(text: str, language: str | None, relative: str) -> list[str]:
    return [kind for kind, _ in reasons(text, language, relative)]


_REASONS = T.ArrayType(T.StructType([T.StructField("reason", T.StringType()), T.StructField("evidence", T.StringType())]))


@F.pandas_udf(_REASONS)
def file_reasons(content: pd.Series, language: pd.Series, relative: pd.Series) -> pd.Series:
    return pd.Series([[{"reason": k, "evidence": e} for k, e in reasons(c, lang, r or "")] if c else [] for c, lang, r in zip(content, language, relative)])


def machine_files(files: DataFrame) -> DataFrame:
    """(file_id, project, is_test, reason, evidence) for each reason a file isn't hand-written; repeated rows count once.

    Null or empty content and null ids give nothing. One scan, only findings are shuffled.
    """
    whole = files.where("file_id is not null and content is not null")
    found = whole.select("file_id", "project", "is_test", F.explode(file_reasons("content", language_of(), "relative")).alias("why"))
    return found.select("file_id", "project", "is_test", "why.reason", "why.evidence").distinct()

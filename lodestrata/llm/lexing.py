"""Small per-row helpers on source text: language by suffix, comments, strings and numbers."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file name's suffix.
SUFFIX_LANGUAGE = {
    "py": "python", "java": "java", "cs": "csharp", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "tsx", "go": "go", "yml": "yaml", "yaml": "yaml", "json": "json", "properties": "properties",
}


def language_of(language: str = "language", relative: str = "relative") -> Column:
    """The declared language in lower case, or the one of the suffix where it is null or blank; unknown suffixes give null."""
    suffix = F.lower(F.regexp_extract(F.coalesce(F.col(relative), F.lit("")), r"\.([A-Za-z]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    return F.coalesce(F.nullif(F.lower(F.trim(F.col(language))), F.lit("")), F.try_element_at(known, suffix))


_STRING = {
    "python": r'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'',
    "go": r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.)+\'',
    "csharp": r'\$?@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'',
    "java": r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'',
    "script": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`',
    "yaml": r'"(?:[^"\\]|\\.)*"|(?<![^\s:\[{,-])\'(?:[^\']|\'\')*\'',
    "json": r'"(?:[^"\\\n]|\\.)*"',
    "properties": r"(?!)",
}
_COMMENT = {
    "python": r"#[^\n]*",
    "yaml": r"(?:(?<=\s)|(?<![^\n]))#[^\n]*",
    "properties": r"^[ \t]*[#!][^\n]*",
    "json": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
    "code": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
}


def _family(language: str | None) -> tuple[str, str]:
    if language in ("javascript", "typescript", "tsx"):
        return "script", "code"
    if language in ("go", "csharp", "java"):
        return language, "code"
    if language in ("python", "yaml", "properties", "json"):
        return language, language
    return "script", "code"


@lru_cache(maxsize=32)
def trivia_pattern(language: str | None) -> re.Pattern:
    """Matches comments (group c) and strings (group s) of a language."""
    strings, comments = _family(language)
    return re.compile(f"(?P<c>{_COMMENT[comments]})|(?P<s>{_STRING[strings]})", re.S | re.M)


_DOCSTRING = re.compile(r"""[rRuUbB]?("{3}|'{3})""")


def comments(text: str, language: str | None) -> list[tuple[int, str]]:
    """Offset and raw text of each comment; Python's triple-quoted strings that open a line count as comments."""
    found = []
    for m in trivia_pattern(language).finditer(text):
        if m.lastgroup == "c":
            if m.start() == 0 and text.startswith("#!"):
                continue
            found.append((m.start(), m.group()))
        elif language == "python" and m.group().startswith(('"""', "'''")):
            line = text.rfind("\n", 0, m.start()) + 1
            if not text[line : m.start()].strip():
                found.append((m.start(), m.group()))
    return found


_MARKS = re.compile(r'^[ \t]*(?:/\*+!?|\*+/|\*+|//+!?|#+!?|"""|\'\'\'|<!--|--)?[ \t]*|[ \t]*(?:\*+/|"""|\'\'\'|-->)?[ \t]*$')


def comment_lines(raw: str) -> list[str]:
    """A comment's lines without their comment marks."""
    return [_MARKS.sub("", line) for line in raw.replace("\r", "").split("\n")]

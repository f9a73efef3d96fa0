"""Credentials written out in source code and configuration, and their redaction in place.

All offsets are byte offsets: a text is worked on as its UTF-8 bytes, seen as one character a byte, and redactions are
spliced into these bytes. Configuration is read into key paths with the spans of its values; code gives its literals with
the names they are bound to.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.keypaths import FORMATS, Pair, key_paths, named_pairs
from lodestrata.llm.lexing import language_of

# --- value shapes ---

#: Shapes that are a credential wherever they stand.
TOKEN_SHAPES = re.compile(
    r"(?a)(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{16,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[\w-]{6,}\.eyJ[\w-]{4,}\.[\w-]{10,})(?![A-Za-z0-9])"
    r"|https?://hooks\.[\w.-]+/services/(?:[\w-]{6,}/){1,3}[\w-]{8,}"
)
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

_PLACEHOLDER = re.compile(
    r"""(?aix)^(?:
      <.*> | \[.*\] | \{\{.*\}\} | \$\{.*\}? | \$\(.*\) | \$[A-Z_]\w* | %\(?\w+\)?[s%]? | \#\{.*\} | @.*@
    | (.)\1{2,} | [*x.\-_?#]{3,}
    | (?:change|replace|insert|update|set|put|your|enter|add|fill|use|choose|todo|fixme|tbd|redacted|removed|masked|hidden|none|null|nil|true|false|undefined|unset|empty|blank|default)(?:[-_ ]?(?:me|it|here|this|in|out|your|value|token|key|password|secret|api|by|your[-_ ].*))*
    | (?:my|your|the|a|some|any|test|dummy|fake|mock|sample|example|demo|placeholder)?[-_ ]?(?:password|passwd|secret|token|key|api[-_]?key|value|placeholder|dummy|fake|sample|example|test)[-_ ]?(?:here|value|goes[-_ ]here|123)?
    | not[-_ ].* | .*(?:not[-_]?real|example|placeholder|dummy|changeme|redacted|your[-_]).* 
    )$"""
)
_REFERENCE = re.compile(
    r"""(?aix)^(?:
      (?:vault|env|ssm|sm|secretsmanager|keyvault|kms|op|sops|file|ref|secret|config|gcp|aws|azure)(?::|://).*
    | arn:.* | projects/.*/secrets/.* | (?:secret|kv|secrets)/[\w./-]+ | /?[a-z]+(?:/[a-z][\w.-]*)+ | [a-z]+(?:\.[a-z_]\w*){1,6}
    )$"""
)
_ENV_NAME = re.compile(r"^[A-Z][A-Z]+(?:_[A-Z]+)*$")
_DIGEST = re.compile(r"^(?:sha\d+|md5)[-:=]", re.I | re.A)
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)


def real_value(v: str) -> bool:
    """Whether a value of a sensitive name looks real: no placeholder, reference, label, digest or id, and not a plain word."""
    v = (v if v.isascii() else v.encode("latin-1", "replace").decode("utf-8", "replace")).strip()
    if len(v) < 6 or " " in v or "\t" in v or _PLACEHOLDER.match(v) or _ENV_NAME.match(v) or _DIGEST.match(v) or _UUID.match(v):
        return False
    if "${" in v or "{{" in v or v.startswith(("%(", "$(")) or "EXAMPLE" in v:
        return False
    digits, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    if _REFERENCE.match(v) and not (digits and upper):
        return False
    marks = any(c in "!?@#$%^&*_+=/.~-" for c in v)
    turns = sum(a.islower() != b.islower() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())
    return digits and (lower or upper or len(v) >= 8) or (lower and upper and turns >= 4 and len(v) >= 10) or (marks and lower and upper and turns >= 2 and len(v) >= 8)


# --- key names ---

_SENSITIVE = re.compile(
    r"(?:^|_)(?:password|passwd|passphrase|passcode|pwd|pass|pw|secret|secrets|token|apikey|api_key|access_key|auth_key|signing_key|secret_key|private_key|encryption_key|shared_key"
    r"|account_key|license_key|master_key|deploy_key|session_key|credential|credentials|client_secret|webhook_secret|bearer|jwt|authorization)(?:_(?:value|str|string|raw|plain|prod|dev|old|new|default|\d+))*\d*$"
)


@lru_cache(maxsize=100_000)
def sensitive(name: str) -> bool:
    """Whether a key path's last part, or its last two together, name a credential: `dbPassword`, `app.signing.key`; not `passwordLabel`."""
    parts = [p for p in re.split(r"[./\[\]:]+", name.strip("\"'` ")) if p]
    snakes = [re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[-\s]+", "_", p).lower() for p in parts]
    return bool(snakes) and bool(_SENSITIVE.search(snakes[-1]) or _SENSITIVE.search("_".join(snakes[-2:])))


# --- private keys ---

_PIECE = re.compile(r"(?:\\[nr])*(?P<line>(?:[^\\\n]|\\(?![nr]))+)", re.A)
#: a line of a key body, with what code puts around it: comment marks, quotes, joints between literals
_KEY_LINE = re.compile(r"[ \t\r\"'`,;()@$|>]*(?:(?://+|#+|\*+)[ \t]+)?(?:\+(?:[ \t]+|(?=[\"'`])))?[\"'`]?(?P<body>[A-Za-z0-9+/=]*+)(?:[\"'`][ \t\r]*[+,;)\\]*)?[ \t\r\\]*(?P<rest>.*)", re.A)
_KEY_HEADER = re.compile(r"[\s\"'`]*[A-Za-z][A-Za-z-]*: ", re.A)
_KEYISH = re.compile(r"(?:\\[nrt]|[\s\"'`,;()\\|>#*@$]|[A-Za-z][A-Za-z-]*+: [^\n\\]*|[A-Za-z0-9+/=.]++)*+", re.A)
_KEY_CHARS = re.compile(r"\\[nrt]|(?<![A-Za-z0-9+/=])(?:/{2,}|\++)(?=[\s\"'`])|(?P<key>[A-Za-z0-9+/=.])", re.A)


def _unclosed_key(s: str, at: int, stop: int) -> int:
    """End of a key body that has no END line: full lines, then one shorter line."""
    end, longest = at, 0
    for m in _PIECE.finditer(s, at, stop):
        line = _KEY_LINE.fullmatch(m["line"])
        if _KEY_HEADER.match(m["line"]) or not m["line"].strip(" \t\r\"'`+,;()#*/"):
            continue
        body = line["body"] if line else ""
        if not body:
            break
        behind = s[m.start("line") + line.end("body") : m.start("line") + line.end("body") + 1]
        closes = not line["rest"] or behind in ("\"", "'", "`")
        odd = any(c in "0123456789+/=" for c in body) or m.end() >= len(s.rstrip())
        if len(body) >= 20 and (closes or longest == 0):
            end, longest = m.start("line") + line.end("body"), max(longest, len(body))
            if line["rest"].strip(" \t\r\"'`+,;()"):
                break
        elif longest and len(body) < longest and closes and (odd or behind in ("\"", "'", "`")):
            end = m.start("line") + line.end("body")
            break
        else:
            if not longest and closes and m.end() >= len(s.rstrip()):
                end = m.start("line") + line.end("body")
            break
    return end


def _key_blocks(s: str) -> list[tuple[int, int, str]]:
    """Private keys, each with its END line if it has one."""
    begins = list(KEY_BLOCK.finditer(s))
    ends = [m.span() for m in _KEY_END.finditer(s)] if begins else []
    spans, e = [], 0
    for i, m in enumerate(begins):
        stop = begins[i + 1].start() if i + 1 < len(begins) else len(s)
        while e < len(ends) and ends[e][0] < m.end():
            e += 1
        if e < len(ends) and ends[e][0] < stop and _KEYISH.fullmatch(s, m.end(), ends[e][0]):
            spans.append((m.start(), ends[e][1], "private-key"))
        else:
            spans.append((m.start(), _unclosed_key(s, m.end(), stop), "private-key"))
    return spans


def _without_key(block: str) -> str:
    """A private key with its markers renamed and every character of its body replaced."""
    begin = KEY_BLOCK.match(block).end()
    close = _KEY_END.search(block, begin)
    end = close.start() if close else len(block)
    body = _KEY_CHARS.sub(lambda m: "x" if m["key"] else m.group(), block[begin:end])
    return block[:begin].replace("PRIVATE KEY", "REMOVED KEY") + body + block[end:].replace("PRIVATE KEY", "REMOVED KEY")


# --- values in code ---

_NAME = r"(?<![\w$.-])[A-Za-z_$][\w$.-]*"
_LITERAL = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
#: name = "value", name: Type = "value", name := "value", "name": "value", ["name"] = "value", name("value")
_ASSIGNED = re.compile(rf"(?a)(?P<name>{_NAME})[\"'`]?\]?\s*(?::\s*[\w<>\[\]?]+\s*)?(?::=|=>|=(?!=)|:)\s*[frbuFRBU@$]*(?P<value>{_LITERAL})")
#: a call with a name and a value: getenv("NAME", "value"), Set("Authorization", "value")
_PASSED = re.compile(rf"(?a)\(\s*[\"'`](?P<name>[A-Za-z_][\w.-]*)[\"'`]\s*,\s*(?P<value>{_LITERAL})")
#: a value that stands in for a missing one: env.NAME || "value", getenv("NAME") ?? "value", .orElse("value")
_FALLBACK = re.compile(rf"(?a)(?P<name>(?<![\w$.-])[A-Za-z_$][\w$.-]*)[\"'`]?[)\]]*\s*(?:\|\||\?\?|\bor\b|\.(?:orElse|OrElse|getOrElse|GetValueOrDefault|unwrap_or)\()\s*(?P<value>{_LITERAL})")
_JOINED = re.compile(r"(?a)\"((?:[^\"\\\n]|\\.)*)\"\s*\+\s*\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'\s*\+\s*'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`\s*\+\s*`([^`\n]*)`")
_URL_LOGIN = re.compile(r"(?a)(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'<>]*:(?P<value>[^\s/@\"'<>]+)@")
_CONNECTION = re.compile(r"(?ai)[;?&\"'`]\s*(?:password|passwd|pwd|accountkey|sharedaccesskey|sharedsecret|secret|access_token|api_key|token)=(?P<value>[^;\"'\s&`,)]+)")
_HEADER = re.compile(r"(?ai)\b(?P<kind>basic|bearer|token|apikey)\s+(?P<value>[A-Za-z0-9+/=._~-]{8,})")
_SHELL_LOGIN = re.compile(r"(?a)(?:\s-u|\s--user)[ =]+[\"']?[^\s:\"']+:(?P<value>[^\s\"'@]+)")
_SAID = re.compile(
    r"(?ai)(?<![A-Za-z])(?P<name>password|passwd|passphrase|pwd|pw|secret|token|api[ _-]?key|access[ _-]?key|signing[ _-]?key|smtp[ _-]pass|pass|credential)s?(?: (?:for|of|in|on|at) [\w.-]{1,40})?\s*"
    r"(?:is|was|:|=|->|=>|set to|now|used to be)\s*[\"'`]?(?P<value>[^\s\"'`,;()]+)"
)
_COMMENT = re.compile(r"(?am)(?://|#|/\*|^\s*\*|<!--|--\s)[^\n]*")


def _basic(v: str) -> bool:
    try:
        login = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return ":" in login and real_value(login.split(":", 1)[1])


#: Words and marks near which a credential may stand; a line without any of them holds none.
ANCHORS = (
    "passw", "passphrase", "passcode", "pwd", "pass", "pw", "secret", "token", "apikey", "api_key", "api-key", "api key", "access_key", "access-key", "accesskey", "access key",
    "auth_key", "auth-key", "authkey", "signing_key", "signing-key", "signingkey", "signing key", "private_key", "private-key", "privatekey", "private key", "encryption_key",
    "encryption-key", "encryptionkey", "shared_key", "shared-key", "sharedkey", "account_key", "account-key", "accountkey", "license_key", "license-key", "licensekey",
    "master_key", "master-key", "masterkey", "deploy_key", "deploy-key", "deploykey", "session_key", "session-key", "sessionkey", "credential", "bearer", "basic ", "jwt",
    "authorization", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "xox", "k_live_", "k_test_", "sg.", "aiza", "npm_", "hf_", "eyj", "hooks.",
    "://", " -u ", "--user",
)


def _suspect_lines(s: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that hold an anchor, each once, found by plain search."""
    low, lines = s.lower(), {}
    for anchor in ANCHORS:
        at = low.find(anchor)
        while at >= 0:
            start, end = s.rfind("\n", 0, at) + 1, s.find("\n", at)
            end = len(s) if end < 0 else end
            lines[start] = end
            at = low.find(anchor, end)
    return sorted(lines.items())


def _line_spans(s: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """Credentials in the line s[a:b]; a literal may be joined with one on the next line."""
    spans: list[tuple[int, int, str]] = []
    for m in TOKEN_SHAPES.finditer(s, a, b):
        if "EXAMPLE" not in m.group() and len(set(m.group())) > 6:
            spans.append((m.start(), m.end(), "token"))
    if "+" in s[a:b]:
        more = s.find("\n", b + 1)
        for m in _JOINED.finditer(s, a, len(s) if more < 0 else more):
            if m.start() >= b:
                break
            i = next(i for i in (1, 3, 5) if m.group(i) is not None)
            whole = m.group(i) + m.group(i + 1)
            hit = TOKEN_SHAPES.search(whole)
            if hit and "EXAMPLE" not in hit.group():
                spans.append((m.start(i), m.end(i + 1), "split-token"))
            elif (named := _ASSIGNED.search(s, a, m.end(i) + 1)) and sensitive(named["name"]) and real_value(whole):
                spans.append((m.start(i), m.end(i + 1), "split-value"))
    for pattern, kind in ((_URL_LOGIN, "url-login"), (_SHELL_LOGIN, "shell-login"), (_CONNECTION, "connection")):
        spans += [(*m.span("value"), kind) for m in pattern.finditer(s, a, b) if real_value(m["value"])]
    for m in _HEADER.finditer(s, a, b):
        if (m["kind"].lower() == "basic" and _basic(m["value"])) or (m["kind"].lower() != "basic" and len(m["value"]) >= 16 and real_value(m["value"])):
            spans.append((*m.span("value"), "header"))
    for pattern in (_ASSIGNED, _PASSED, _FALLBACK):
        for m in pattern.finditer(s, a, b):
            if sensitive(m["name"]) and real_value(m["value"][1:-1]):
                spans.append((m.start("value") + 1, m.end("value") - 1, "value"))
    for c in _COMMENT.finditer(s, a, b):
        for m in _SAID.finditer(s, c.start(), c.end()):
            value = m["value"].rstrip(".")
            if real_value(value):
                spans.append((m.start("value"), m.start("value") + len(value), "comment"))
    return spans


def _config_spans(pairs: list[Pair]) -> list[tuple[int, int, str]]:
    """Whole values of sensitive key paths; the rest of a value that goes on over lines is marked as such."""
    spans = []
    for names, pair in named_pairs(pairs):
        if real_value(pair.value) and sensitive(".".join(n.replace(".", "_") if len(names) > 1 else n for n in names)):
            spans += [(a, b, "config-value" if i == 0 else "config-more") for i, (a, b) in enumerate(pair.spans)]
    return spans


def _view(text: str) -> str:
    """The UTF-8 bytes of a text as a string of one character a byte."""
    return text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")


def _spans(s: str, form: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential in a byte view, sorted and without overlaps: keys, then key paths, then lines."""
    pairs = key_paths(s, form) if form in FORMATS else []
    config = _config_spans(pairs)
    values = sorted(span for p in pairs for span in p.spans)
    starts = [a for a, _ in values]
    lines = []
    for a, b in _suspect_lines(s):
        for x, y, kind in _line_spans(s, a, b):
            i = bisect_right(starts, x) - 1
            inside = i >= 0 and y <= values[i][1]
            lines.append((x, y, f"config-{kind}" if inside and kind != "value" else kind))
    kept: list[tuple[int, int, str]] = []
    for group in (_key_blocks(s), config, lines):
        fresh: list[tuple[int, int, str]] = []
        kept.sort()
        begun = [k[0] for k in kept]
        for a, b, kind in sorted(group, key=lambda x: (x[0], -x[1])):
            i = bisect_right(begun, a) - 1
            free = (i < 0 or kept[i][1] <= a) and (i + 1 >= len(kept) or kept[i + 1][0] >= b)
            if free and (not fresh or a >= fresh[-1][1]):
                fresh.append((a, b, kind))
        kept += fresh
    return sorted(kept)


def credentials(text: str, form: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential in a text, by bytes of its UTF-8 form, sorted and without overlaps.

    `form` is a language or a configuration format; a value that is cut over lines has a span per line.
    """
    return _spans(_view(text), form)


def redact(text: str, form: str | None) -> str:
    """The text with each credential spliced out of its bytes: quotes, line breaks, joints and the offsets of all else stay.

    The filler is a plain word of the same number of bytes, valid wherever the value was; a second pass finds nothing.
    """
    s, out, last = _view(text), [], 0
    for a, b, kind in _spans(s, form):
        value = s[a:b]
        if kind == "private-key":
            value = _without_key(value)
        elif "split" in kind:
            value = re.sub(r"[^\"'`+\s]", "x", value)
        else:
            value = re.sub(r"[^\r\n]", "x", value)
        out += [s[last:a], value]
        last = b
    if not out:
        return text
    done = "".join([*out, s[last:]])
    return done if text.isascii() else done.encode("latin-1").decode("utf-8", "surrogatepass")


# --- Spark ---

_HIT = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType())]))
#: Configuration formats by file name, for files without a known language.
_FORM_NAMES = {"toml": r"\.toml$", "ini": r"\.(?:ini|cfg|conf)$", "env": r"(?:^|/)\.env(?:\.[\w.-]+)?$|\.env$", "xml": r"\.(?:xml|config|csproj|props)$"}


def form_of() -> Column:
    """The language of a file, else the configuration format its name shows, else null."""
    name = F.lower(F.coalesce("relative", F.lit("")))
    return F.coalesce(language_of(), *[F.when(name.rlike(p), F.lit(f)) for f, p in _FORM_NAMES.items()])


def _found_lines(text: str, form: str | None) -> list:
    s = _view(text)
    return [{"line_no": s.count("\n", 0, a) + 1, "kind": kind} for a, _, kind in _spans(s, form) if kind != "config-more"]


@F.pandas_udf(_HIT)
def credential_lines(content: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([_found_lines(t, f) if t else [] for t, f in zip(content, form)])


@F.pandas_udf(T.StringType())
def redacted(content: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([redact(t, f) if t else t for t, f in zip(content, form)])


def credential_findings(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind), one row per line and kind; lines are 1-based and end at \\n.

    Null and empty content and null ids give nothing; repeated rows count once. One scan; only findings are shuffled.
    """
    hits = files.where("file_id is not null and content is not null").select("file_id", F.explode(credential_lines("content", form_of())).alias("h"))
    return hits.select("file_id", "h.line_no", "h.kind").distinct()


def redacted_files(files: DataFrame) -> DataFrame:
    """All rows with `content` redacted; null content stays null."""
    return files.withColumn("content", redacted("content", form_of()))

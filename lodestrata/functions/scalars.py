"""Scalar functions of the evidence model as column expressions; null in gives null out unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import slug, strict_json, strip


def url_host(value: Column) -> Column:
    """Bare lower-case host of a route or URL: scheme, path and port cut off; bare hosts work too, null gives ''."""
    text = F.coalesce(value, F.lit(""))
    rest = F.regexp_replace(text, "^[^:]*?://", "")
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(rest)
    return F.lower(F.trim(F.regexp_replace(F.substring_index(rest, "/", 1), ":[^:]*$", "")))


def duration_ms(value: Column) -> Column:
    """Milliseconds of '250ms', '3s' or '2m'; anything else gives null."""
    number = F.try_to_number(F.regexp_extract(value, r"^\s*(\d{1,12})\s*(?:ms|s|m)\s*$", 1), F.lit("999999999999")).cast("bigint")
    unit = F.regexp_extract(value, r"^\s*\d+\s*(ms|s|m)\s*$", 1)
    return number * F.when(unit == "ms", 1).when(unit == "s", 1000).when(unit == "m", 60_000)


def fqn(package: Column, type_name: Column, member: Column) -> Column:
    """package.Type#member; blank packages and null members are left out."""
    base = F.when(F.coalesce(package, F.lit("")) == "", type_name).otherwise(F.concat_ws(".", package, type_name))
    return F.when(member.isNull(), base).otherwise(F.concat_ws("#", base, member))


def member_of(symbol: Column) -> Column:
    """What stands behind the last # of a symbol, else the symbol; blank or null gives 'x'."""
    return F.coalesce(F.nullif(F.substring_index(symbol, "#", -1), F.lit("")), F.when(F.coalesce(symbol, F.lit("")) == "", F.lit("x")), F.lit(""))


def first_url(args: Column) -> Column:
    """The first argument that looks like a URL or path; null if there is none."""
    return F.get(F.filter(args, lambda a: a.startswith("http://") | a.startswith("https://") | a.startswith("/")), 0)


def log_level(method: Column) -> Column:
    """Lower-case level of a log call's method, `LogError` and `error` giving the same."""
    return F.lower(F.regexp_replace(method, "(?i)^log", ""))


def artifact_filename(name: Column) -> Column:
    return F.concat(slug(name), F.lit(".yaml"))


def normal_path(path: Column) -> Column:
    """A route with every {name} as {}, braces within braces included, and no slash at its end; the root stays '/'."""
    opened = F.size(F.split(path, r"\{")) - 1
    # the innermost pairs become a mark, as often as there are braces at all
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), path, lambda p, _: F.regexp_replace(p, r"\{[^{}]*\}", "\u0001"))
    plain = F.regexp_replace(F.regexp_replace(folded, "\u0001", "{}"), "/+$", "")
    return F.when(path.isNotNull(), F.coalesce(F.nullif(plain, F.lit("")), F.lit("/")))


def major_version(version: Column) -> Column:
    """Leading whole number of a version, a v in front allowed; null if there is none."""
    return F.regexp_extract(F.trim(version), r"^[vV]*(\d{1,9})(?:\.|$)", 1).try_cast("int")


def environment_of(path: Column) -> Column:
    """Environment in a manifest's file name, `application-prod.yml` giving prod; null if there is none."""
    return F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), r"^[^-]*-(.+)\.[^.]*$", 1), F.lit(""))


def relaxed_key(key: Column) -> Column:
    """A configuration key for relaxed binding: lower case without hyphens and underscores."""
    return F.lower(F.translate(key, "-_", ""))


def is_kill_switch(name: Column) -> Column:
    return F.lower(name).rlike("kill|disable|emergency")


def looks_like_cron(text: Column) -> Column:
    """Five to seven fields of digits, names and the marks cron knows."""
    fields = F.split(F.trim(text), r"\s+")
    return F.size(fields).between(5, 7) & F.forall(fields, lambda f: f.rlike(r"^[0-9A-Za-z*/,?#LW-]+$"))


#: Severities from the worst, and how other schemes name them.
SEVERITIES = ["critical", "high", "medium", "low"]
SEVERITY_ALIASES = {
    "sev1": "critical", "sev2": "high", "sev3": "medium", "sev4": "low", "p1": "critical", "p2": "high", "p3": "medium", "p4": "low", "s1": "critical", "s2": "high", "s3": "medium", "s4": "low",
    "blocker": "critical", "major": "high", "minor": "medium", "trivial": "low", "1": "critical", "2": "high", "3": "medium", "4": "low",
}
TIER_FLOOR = {"tier0": "critical", "tier1": "high", "tier2": "medium", "tier3": "low"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_severity(token: Column) -> Column:
    """A token of any severity scheme on the canonical scale; null if it isn't known."""
    t = F.lower(F.trim(token))
    return F.when(t.isin(SEVERITIES), t).otherwise(_lookup(SEVERITY_ALIASES, t))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; unknown and null severities come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)).cast("int") - 1, F.lit(len(SEVERITIES)))


def floored_severity(declared: Column, tier: Column) -> Column:
    """A severity raised to the floor of its service's tier, never lowered; unknown tiers change nothing."""
    floor = _lookup(TIER_FLOOR, tier)
    return F.when(floor.isNull() | (severity_rank(declared) <= severity_rank(floor)), declared).otherwise(floor)


def corroborated(base: Column, n: Column) -> Column:
    """Confidence of a signal with n pieces of evidence: 0.03 for each beyond the first, 0.06 at most, 0.95 in all."""
    bonus = F.least(F.lit(0.06), F.lit(0.03) * F.greatest(F.lit(0), n - 1))
    return F.round(F.least(F.lit(0.95), base + bonus), 3)


def blast_severity(flows: Column, data_loss: Column, contained: Column) -> Column:
    """medium or high from breadth, data loss and containment."""
    score = F.when(data_loss, 3).otherwise(0) + F.when(contained, 1).otherwise(3) + F.least(F.lit(2), F.greatest(F.lit(1), flows) - 1)
    return F.when(score >= 3, "high").otherwise("medium")


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.6, "C").when(score >= 0.4, "D").otherwise("F")


#: Name parts of datastore engines and brokers; the first that fits wins, so generic ones stand last.
DATASTORES = [
    ("postgres", ["postgres", "postgresql", "pgsql", "pgbouncer"]), ("cockroach", ["cockroach", "crdb"]), ("mysql", ["mysql", "mariadb", "aurora-mysql"]), ("oracle", ["oracle", "ojdbc"]),
    ("mssql", ["mssql", "sqlserver", "sql-server"]), ("db2", ["db2"]), ("mongodb", ["mongodb", "mongo", "mongoose", "documentdb"]),
    ("redis", ["redis", "ioredis", "go-redis", "lettuce", "jedis", "elasticache", "valkey"]), ("cassandra", ["cassandra", "scylla", "datastax"]), ("dynamodb", ["dynamodb", "dynamo"]),
    ("elasticsearch", ["elasticsearch", "opensearch"]), ("couchbase", ["couchbase"]), ("neo4j", ["neo4j"]), ("sqlite", ["sqlite"]), ("spanner", ["spanner"]), ("bigtable", ["bigtable"]),
    ("sql", ["jdbc", "sql", "rdbms"]), ("database", ["db"]),
]
BROKERS = [
    ("kafka", ["kafka", "kafkajs", "sarama", "confluent", "msk"]), ("rabbitmq", ["rabbit", "rabbitmq", "amqp", "amqplib"]), ("activemq", ["activemq", "artemis"]),
    ("servicebus", ["servicebus", "azure-servicebus"]), ("eventhub", ["eventhub", "event-hub"]), ("pulsar", ["pulsar"]), ("nats", ["nats"]), ("sqs", ["sqs"]), ("sns", ["sns"]),
    ("pubsub", ["pubsub"]), ("jms", ["jms"]), ("ibm-mq", ["ibmmq", "ibm-mq"]), ("message-queue", ["mq"]),
]
TRACING = ["sleuth", "micrometer-tracing", "opentelemetry", "otel", "zipkin", "brave", "jaeger"]


def classified(name: Column, catalog: list[tuple[str, list[str]]]) -> Column:
    """First entry of an ordered catalog whose hint occurs in the name, as one CASE expression; null if none does."""
    low, case = F.lower(name), None
    for label, hints in catalog:
        hit = low.rlike("|".join(h.replace(".", r"\.") for h in hints))
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case


def signature_hits(text: Column, patterns: list[str], words: list[str], low: Column) -> Column:
    """Whether any pattern of a concern occurs, regardless of case.

    A text without any of the concern's words (`low` is the text in lower case) can't match and isn't searched.
    """
    near = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(near, text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))).otherwise(F.when(text.isNotNull(), F.lit(False)))


#: What shows that a resiliency mechanism is in place, by concern.
SIGNATURES = {
    "circuit-breaker": [r"@CircuitBreaker\b", r"\bCircuitBreaker(?:Async)?\s*\(", r"\.CircuitBreaker(?:Async)?\b", r"resilience4j\.circuitbreaker"],
    "fallback": [r"\bfallback(?:Method|Factory)?\s*=", r"@Recover\b", r"\.(?:with)?Fallback(?:Async)?\s*\("],
    "timeout": [r"@TimeLimiter\b", r"\bTimeout(?:Async)?\s*\(", r"\b(?:connect|read|response)Timeout\b", r"resilience4j\.timelimiter", r"\btimeout\s*=\s*(?!0(?![.\d])|none\b|null\b|false\b)\S"],
    "retry": [r"@Retry\b", r"\bWaitAndRetry\w*\s*\(", r"\bRetry(?:Async)?\s*\("],
    "bulkhead": [r"@Bulkhead\b", r"\bThreadPoolBulkhead\b", r"\bBulkhead(?:Async)?\s*\(", r"\.Bulkhead(?:Async)?\b", r"resilience4j\.(?:thread-pool-)?bulkhead"],
    "rate-limit": [r"@RateLimiter\b", r"resilience4j\.ratelimiter", r"\bRateLimiter\s*\(", r"\.RateLimit(?:Async)?\b", r"\bAddRateLimiter\b"],
    "idempotency": [r"\bidempotenc(?:y|e)[-_]?key\b", r"@Idempotent\b", r"\bIdempotencyKey\b", r"\bdedupe[-_]?key\b"],
    "scheduled": [r"@Scheduled\b", r"@DisallowConcurrentExecution\b", r"@(?:shared_task|periodic_task|task)\b", r"@app\.on_event\b", r"@\w*scheduler\.scheduled_job\b", r"\bBackgroundScheduler\b", r"@repeat_every\b"],
    "backpressure": [
        r"\.onBackpressure(?:Buffer|Drop|Latest|Error)\s*\(", r"\.limitRate\s*\(", r"\bBackpressureStrategy\.", r"\bOverflowStrategy\.", r"\bnew\s+ArrayBlockingQueue\b",
        r"\bnew\s+LinkedBlocking(?:Queue|Deque)\s*(?:<[^>]*>)?\s*\(\s*\w", r"\bChannel\.CreateBounded\b", r"\bBoundedChannelOptions\b", r"\bmake\s*\(\s*chan\b[^,)]*,\s*\w", r"\bhighWaterMark\s*[:=]",
    ],
    "load-shed": [r"\btryAcquire\s*\(", r"\bConcurrencyLimit(?:er)?\b", r"\bRejectionStatusCode\b", r"\blimit_(?:req|conn)\b"],
    "dead-letter": [r"@RetryableTopic\b", r"@DltHandler\b", r"\bDeadLetterPublishingRecoverer\b", r"\bx-dead-letter-(?:exchange|routing-key)\b", r"\b(?:enable[-_]?dlq|auto[-_]?bind[-_]?dlq|dlq[-_]?name)\b", r"\bSendToDlq\b", r"\bredrive[-_]?policy\b"],
}

#: Words of which every match of a concern holds one, in lower case.
SIGNATURE_WORDS = {
    "circuit-breaker": ["circuitbreaker"],
    "fallback": ["fallback", "@recover"],
    "timeout": ["timelimiter", "timeout"],
    "retry": ["retry"],
    "bulkhead": ["bulkhead"],
    "rate-limit": ["ratelimit"],
    "idempotency": ["idempoten", "dedupe"],
    "scheduled": ["scheduled", "disallowconcurrentexecution", "@shared_task", "@periodic_task", "@task", "@app.on_event", "backgroundscheduler", "@repeat_every"],
    "backpressure": ["onbackpressure", "limitrate", "backpressurestrategy", "overflowstrategy", "arrayblockingqueue", "linkedblocking", "createbounded", "boundedchanneloptions", "chan", "highwatermark"],
    "load-shed": ["tryacquire", "concurrencylimit", "rejectionstatuscode", "limit_req", "limit_conn"],
    "dead-letter": ["retryabletopic", "dlthandler", "deadletterpublishing", "dead-letter", "dlq", "redrive"],
}

#: Content that must not stand in a runbook.
DANGEROUS = {
    "shell-pipe-to-network": r"(?i)\b(curl|wget)\b[^|\n]*\|\s*(bash|sh)\b",
    "rm-rf": r"(?i)\brm\s+-rf?\b",
    "disable-tls": r"(?i)(verify\s*=\s*false|insecure[- ]?skip[- ]?tls|trust[- ]?all|sslverify\s*=\s*false|disable\w*\s*ssl)",
    "disable-auth": r"(?i)(permitall\s*\(\)|disable\w*auth|anonymous\s+admin)",
    "dynamic-eval": r"(?i)\b(eval|exec)\s*\(",
}
#: Words that show which class of personal data code handles.
DATA_CLASSES = {
    "pci": r"(?i)\bcard[_-]?(?:number|holder)\b|\bcredit[_-]?card\b|\bcvv\b|\bcvc\b|\bpan\b",
    "pii": r"(?i)\bemail\b|\bssn\b|\bsocial[_-]?security\b|\bpassport\b|\bdate[_-]?of[_-]?birth\b|\bdob\b|\bphone[_-]?number\b|\btax[_-]?id\b",
}


def named_hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur in a text, in their order."""
    named = [F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]
    return F.array_compact(F.array(*named))


def histogram_bound(ms: Column) -> Column:
    """A threshold in milliseconds as a histogram's bound in seconds: 800 gives 0.8."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%f", ms.cast("double") / 1000), "0+$", ""), r"\.$", "")


def extension_group(path: Column) -> Column:
    """Lower-case extension of a path with its dot, else the file's name."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 1, F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise(name)


def without_login(url: Column) -> Column:
    """A URL without user and password."""
    return F.regexp_replace(url, "://[^/@\\s]*@", "://")


def table_cell(text: Column) -> Column:
    """Text for one cell of a Markdown table: pipes escaped, line breaks as blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"[\r\n]+", " ")


def defanged(text: Column) -> Column:
    """Text whose code fences no longer fence: a blank behind each backtick of a run of three."""
    return F.regexp_replace(text, "```", "` ` ` ")


def package_name(ecosystem: Column, name: Column) -> Column:
    """A package's name as its ecosystem compares it: pypi folds case and [-_.] runs, nuget and npm fold case."""
    pypi = F.lower(F.regexp_replace(name, "[-_.]+", "-"))
    return F.when(ecosystem == "pypi", pypi).when(ecosystem.isin("nuget", "npm"), F.lower(name)).otherwise(name)


def normal_relative(path: Column) -> Column:
    """A relative path with '.' and '..' folded; null where it would leave its root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("out"))
    step = lambda acc, p: F.when(
        p == "..", F.struct(F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0))).alias("path"), (acc["out"] | (F.size(acc["path"]) == 0)).alias("out"))
    ).otherwise(F.struct(F.concat(acc["path"], F.array(p)).alias("path"), acc["out"].alias("out")))
    folded = F.aggregate(parts, start, step)
    return F.when(~folded["out"], F.array_join(folded["path"], "/"))


def purl_parts(node: Column) -> Column:
    """Struct (ecosystem, name, version) of `package:ecosystem:name@version` or `pkg:...`; missing parts are null."""
    rest = F.regexp_replace(node, "^(?:package|pkg):", "")
    return F.struct(
        F.nullif(F.regexp_extract(rest, "^([^:/]+)[:/]", 1), F.lit("")).alias("ecosystem"),
        F.nullif(F.regexp_extract(rest, "^[^:/]+[:/](.+?)(?:@[^@]*)?$", 1), F.lit("")).alias("name"),
        F.nullif(F.regexp_extract(rest, ".@([^@?]+)[^@]*$", 1), F.lit("")).alias("version"),
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 16 hex digits of the SHA-256 over the parts joined by NUL."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))


def reply_verdict(reply: Column) -> Column:
    """supported, unsupported, contradicted or indeterminate from the first word of a reply's first line with text.

    Marks of lists, quotes and emphasis before it don't count; negations and prose are indeterminate, never supported.
    """
    line = F.trim(F.regexp_extract(strip(reply), r"^([^\n]*)", 1))
    t = F.lower(F.regexp_replace(line, r"^[*_#>\-\u2022\u00b7 \t]+", ""))
    verdict = F.when(t.startswith("contradicted"), "contradicted").when(t.startswith("unsupported"), "unsupported").when(t.startswith("supported"), "supported")
    return F.coalesce(verdict, F.lit("indeterminate"))


def json_object(raw: Column) -> Column:
    """The JSON object in a reply as a variant: the whole text, a fenced block, or the widest braces; null if none parses."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    widest = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    tries = [strict_json(F.when(F.trim(c).startswith("{"), c)) for c in (raw, fenced, widest)]
    return F.coalesce(*tries)


def owner_and_name(spec: Column) -> Column:
    """owner/name of a repository given as such, as a web address or as a git address; null for anything else."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.trim(spec), r"\.git/?$|/$", ""), r"^(?:https?://[^/]+/|git@[^:]+:|ssh://git@[^/]+/)?([\w.-]+/[\w.-]+)$", 1), F.lit(""))


def burn_thresholds(target: Column) -> Column:
    """Struct (budget, fast, slow): the error budget of a target in percent and the factors 14.4 and 6 on it."""
    budget = 1 - target / 100
    return F.struct(budget.alias("budget"), (budget * 14.4).alias("fast"), (budget * 6.0).alias("slow"))


#: Language of a file name's suffix.
SUFFIX_LANGUAGE = {
    "py": "python", "java": "java", "cs": "csharp", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "tsx", "go": "go", "yml": "yaml", "yaml": "yaml", "json": "json", "properties": "properties",
}


def known_language(language: Column, path: Column) -> Column:
    """The declared language, or the one of the path's suffix where none is declared."""
    return F.coalesce(language, _lookup(SUFFIX_LANGUAGE, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))))


def interpolated(value: Column, variables: Column) -> Column:
    """A text with each ((name)) replaced by its entry in a map; names without an entry stay as they are."""
    entries = F.filter(F.map_entries(variables), lambda e: e["value"].isNotNull())
    filled = F.aggregate(entries, value, lambda text, e: F.replace(text, F.concat(F.lit("(("), e["key"], F.lit("))")), e["value"]))
    return F.when(variables.isNull(), value).otherwise(filled)


def interpolated_value(value: Column, variables: Column) -> Column:
    """The same as a variant: a text that is one placeholder only takes the entry's own type (`variables` maps to JSON texts)."""
    name = F.regexp_extract(F.trim(value), r"^\(\(([^()]+)\)\)$", 1)
    own = F.try_parse_json(F.try_element_at(variables, F.nullif(name, F.lit(""))))
    plain = F.transform_values(variables, lambda _, v: F.coalesce(F.try_variant_get(F.try_parse_json(v), "$", "string"), v))
    text = F.regexp_replace(F.to_json(F.array(interpolated(value, plain))), r"^\[|\]$", "")
    return F.coalesce(own, F.try_parse_json(text))


def canonical_json(text: Column) -> Column:
    """JSON with its keys in order and without blanks, so that equal documents are equal texts; null if it is broken."""
    return F.to_json(strict_json(text))


def path_mapping(pattern: Column, target: Column, spec: Column) -> Column:
    """An import under an alias pattern with one * as its target, the part that * stands for put in; null if it doesn't fit."""
    before, after = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    middle = F.substring(spec, F.length(before) + 1, F.length(spec) - F.length(before) - F.length(after))
    starred = F.when(spec.startswith(before) & spec.endswith(after) & (F.length(spec) >= F.length(before) + F.length(after)), F.replace(target, F.lit("*"), middle))
    return F.when(F.instr(pattern, "*") > 0, starred).when(pattern == spec, target)


def artifact_tier(evidence: Column) -> Column:
    """`llm` if any piece of evidence (array of structs with source_tier) comes from a model, else `ast`."""
    return F.when(F.exists(F.coalesce(evidence, F.array()), lambda e: F.coalesce(e["source_tier"] == "llm", F.lit(False))), "llm").otherwise("ast")


def first_evidence(evidence: Column) -> Column:
    """path:line of the first piece of evidence (array of structs with path and start), the path alone without a line, else ''."""
    one = F.get(evidence, 0)
    return F.coalesce(F.concat_ws(":", one["path"], one["start"].cast("string")), F.lit(""))


def version_policy(breaking: Column, base: Column, current: Column) -> Column:
    """Struct (breaking, major_bumped, ok): breaking changes need a higher major version; versions that can't be read pass."""
    a, b = major_version(base), major_version(current)
    bumped = F.coalesce(b > a, F.lit(False))
    return F.struct(breaking.alias("breaking"), bumped.alias("major_bumped"), ((breaking == 0) | bumped | a.isNull() | b.isNull()).alias("ok"))


def readiness(rows: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """key, passed, score, grade and gaps (names of the checks that fail) from one boolean column a check; null is a failure."""
    ok = {c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in checks}
    passed = reduce(lambda a, b: a + b, [f.cast("int") for f in ok.values()])
    score = F.round(F.col("passed") / len(checks), 2)
    gaps = F.concat_ws(",", *[F.when(~f, F.lit(c)) for c, f in ok.items()])
    return rows.select(key, passed.alias("passed"), gaps.alias("gaps")).select(key, "passed", score.alias("score"), grade(score).alias("grade"), "gaps")


def dig(document: Column, path: list[str], any_case: bool = False) -> Column:
    """Text at a path of keys below a variant; null where a key is missing. In any case, the first key that fits counts."""
    here = document
    for key in path:
        if any_case:
            entries = F.map_entries(F.try_variant_get(here, "$", "map<string,variant>"))
            here = F.get(F.filter(entries, _named(key)), 0)["value"]
        else:
            here = F.try_variant_get(here, f'$["{key}"]', "variant")
    return F.try_variant_get(here, "$", "string")


def _named(key: str):
    return lambda e: F.lower(e["key"]) == key.lower()

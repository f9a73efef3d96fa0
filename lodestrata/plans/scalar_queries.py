"""Scans, scalar functions and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions.text import slug, strict_json
from lodestrata.plans.registering import Register
from lodestrata.sources.lines import evidence, excerpt_hash, lines
from lodestrata.sources.tables import table

register = Register()
QUERIES, ORACLE = register.queries, register.oracle

SLUG = r"coalesce(nullif(lower(trim(regexp_replace(regexp_replace({0}, '([A-Z])', '-\1', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'x')"
#: Distinct files; repeated rows have the same content.
LANGUAGE = "coalesce(language, case lower(regexp_extract(relative, '\\.([A-Za-z]+)$', 1)) when 'py' then 'python' when 'java' then 'java' when 'cs' then 'csharp' when 'js' then 'javascript' when 'mjs' then 'javascript' when 'cjs' then 'javascript' when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'tsx' when 'go' then 'go' when 'yml' then 'yaml' when 'yaml' then 'yaml' when 'json' then 'json' when 'properties' then 'properties' end)"
FILES = f"(select distinct file_id, project, relative, {LANGUAGE} as language, is_test, content from source_files where content is not null)"
LINES = f"(select file_id, project, relative, language, cast(i as int) line_no, regexp_replace(ls[i], '\\r?\\n$', '') line from (select *, regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+') ls from {FILES}), unnest(range(1, len(ls) + 1)) r(i))"
HOST = "lower(trim(regexp_replace(split_part(case when instr(coalesce({0}, ''), '://') > 0 then substr({0}, instr({0}, '://') + 3) else coalesce({0}, '') end, '/', 1), ':[^:]*$', '')))"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file once, without moving its content: of a file that came again (with a later scan) the first row stays.

    Only ids and times are shuffled to find the files that came again; they are few, so the join that drops their later
    rows needs no exchange of the contents.
    """
    raw = table(spark, folder, "source_files")
    again = raw.groupBy("file_id").agg(F.count("*").alias("n"), F.min("scanned_at").alias("first_scan")).where("n > 1").select(F.col("file_id").alias("again_id"), "first_scan")
    once = raw.join(again, F.col("file_id") == F.col("again_id"), "left").where("first_scan is null or scanned_at = first_scan")
    return once.where("content is not null").select("file_id", "project", "relative", S.known_language(F.col("language"), F.col("relative")).alias("language"), "is_test", "content")


def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines(files(spark, folder), ["file_id", "project", "relative", "language"], "content")


@register("SRC-01_files", "select distinct file_id, relative, size_bytes from source_files where size_bytes <= 2000000 and not regexp_matches(relative, '(^|/)(node_modules|target|dist|build)/') and regexp_matches(relative, '[^/]*\\.(py|java)$')")
def src_01(spark, folder):
    """File selection by name pattern, skipped directories and size, on the file table (folders: sources.files)."""
    f = table(spark, folder, "source_files")
    skipped = F.col("relative").rlike("(^|/)(node_modules|target|dist|build)/")
    return f.where((F.col("size_bytes") <= 2_000_000) & ~skipped & F.col("relative").rlike(r"[^/]*\.(py|java)$")).select("file_id", "relative", "size_bytes").distinct()


@register("SRC-02_lines", f"select file_id, count(*) n_lines, max(length(line)) longest from {LINES} group by file_id")
def src_02(spark, folder):
    return file_lines(spark, folder).groupBy("file_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


@register("SRC-03_excerpt_hash", f"select file_id, 'sha256:' || sha256(array_to_string(regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+')[2:], '')) excerpt_hash from {FILES}")
def src_03(spark, folder):
    return files(spark, folder).select("file_id", excerpt_hash(F.col("content"), F.lit(2), F.lit(2**31 - 1)).alias("excerpt_hash"))


@register("SRC-04_evidence", f"select file_id, project repo, relative path, 5 as start_line, 5 as end_line, 'sha256:' || sha256(array_to_string(regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+')[5:5], '')) excerpt_hash from {FILES}")
def src_04(spark, folder):
    e = evidence(F.col("project"), F.col("relative"), F.col("content"), F.lit(5), F.lit(3), "lines")
    one = files(spark, folder).select("file_id", e.alias("e"))
    return one.select("file_id", "e.repo", "e.path", F.col("e.start").alias("start_line"), F.col("e.end").alias("end_line"), "e.excerpt_hash")


@register("SRC-06_corrupt_records", "select flow_id, captured_at, json_valid(spec_json) valid from flows where spec_json is not null group by all")
def src_06(spark, folder):
    """Texts that should be JSON, with those that aren't kept as error rows."""
    f = table(spark, folder, "flows").where("spec_json is not null")
    return f.select("flow_id", "captured_at", strict_json(F.col("spec_json")).isNotNull().alias("valid")).distinct()


@register("SRC-07_json_documents", f"select file_id, json_extract_string(content, '$.name') as app, cast(json_array_length(content, '$.clients') as int) n_clients from {FILES} where language = 'json' and json_valid(content)")
def src_07(spark, folder):
    docs = files(spark, folder).where("language = 'json'").withColumn("v", strict_json(F.col("content"))).where("v is not null")
    return docs.select("file_id", F.try_variant_get("v", "$.name", "string").alias("app"), F.size(F.try_variant_get("v", "$.clients", "array<variant>")).alias("n_clients"))


@register("SCL-01_slug", f"select distinct alert_ref, {SLUG.format('alert_ref')} as slug from runbook_proposals where alert_ref is not null")
def scl_01(spark, folder):
    return table(spark, folder, "runbook_proposals").where("alert_ref is not null").select("alert_ref", slug(F.col("alert_ref")).alias("slug")).distinct()


URL = r"(?:[a-z]+://)[^\s\"'']+"


@register("SCL-02_url_host", rf"select distinct url, {HOST.format('url')} as host from (select unnest(regexp_extract_all(line, '[a-z]+://[^\s\"'']+')) url from {LINES})")
def scl_02(spark, folder):
    urls = file_lines(spark, folder).select(F.explode(F.regexp_extract_all("line", F.lit(r"[a-z]+://[^\s\"']+"), F.lit(0))).alias("url"))
    return urls.select("url", S.url_host(F.col("url")).alias("host")).distinct()


@register("SCL-03_duration", rf"select distinct value, try_cast(regexp_extract(value, '^\s*(\d+)\s*(ms|s|m)\s*$', 1) as bigint) * case regexp_extract(value, '^\s*(\d+)\s*(ms|s|m)\s*$', 2) when 'ms' then 1 when 's' then 1000 when 'm' then 60000 end as ms from (select regexp_extract(line, '^\s*timeout:\s*(.*)$', 1) as value from {LINES} where language = 'yaml' and regexp_matches(line, '^\s*timeout:'))")
def scl_03(spark, folder):
    t = file_lines(spark, folder).where((F.col("language") == "yaml") & F.col("line").rlike(r"^\s*timeout:")).select(F.regexp_extract("line", r"^\s*timeout:\s*(.*)$", 1).alias("value"))
    return t.select("value", S.duration_ms(F.col("value")).alias("ms")).distinct()


STEPS = "(select flow_id, service, name as flow, captured_at, cast(i as int) pos, steps[i] s from flows, unnest(range(1, len(steps) + 1)) r(i) where steps[i] is not null)"


def flow_steps(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "flows").select("flow_id", "service", F.col("name").alias("flow"), "captured_at", F.posexplode("steps").alias("at", "s"))
    return f.where("s is not null").select("flow_id", "service", "flow", "captured_at", (F.col("at") + 1).alias("pos"), "s")


@register("SCL-04_symbols", f"select distinct s.symbol as symbol, regexp_replace(s.symbol, '^.*#', '') as member, regexp_replace(s.symbol, '#.*$', '') as owner, case when contains(s.symbol, '#') then s.symbol else s.symbol || '#x' end as full_name from {STEPS} where s.symbol is not null and s.symbol <> ''")
def scl_04(spark, folder):
    """Parts of symbols, and the full name put together again from package, type and member."""
    t = flow_steps(spark, folder).select(F.col("s.symbol").alias("symbol")).where("symbol is not null and symbol <> ''").distinct()
    owner, member = F.substring_index("symbol", "#", 1), F.when(F.contains("symbol", F.lit("#")), F.substring_index("symbol", "#", -1)).otherwise("x")
    package, kind = F.regexp_extract(owner, r"^(.*)\.[^.]*$", 1), F.substring_index(owner, ".", -1)
    return t.select("symbol", S.member_of(F.col("symbol")).alias("member"), owner.alias("owner"), S.fqn(package, kind, member).alias("full_name"))


@register("SCL-05_dig", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k') as k_any_case, json_extract_string(props, '$.a.b') as missing from events")
def scl_05(spark, folder):
    """Nested keys, as they are written and in any case."""
    v = F.try_parse_json("props")
    return table(spark, folder, "events").select("event_id", S.dig(v, ["k"]).alias("k"), S.dig(v, ["K"], any_case=True).alias("k_any_case"), S.dig(v, ["A", "b"], any_case=True).alias("missing"))


@register("SCL-06_find_line", f"select file_id, min(line_no) as line_no from {LINES} where contains(line, 'return') and line_no > 3 group by 1")
def scl_06(spark, folder):
    return file_lines(spark, folder).where(F.col("line").contains("return") & (F.col("line_no") > 3)).groupBy("file_id").agg(F.min("line_no").alias("line_no"))


@register("SCL-07_first_url", rf"select file_id, line_no, list_filter(list_transform(regexp_extract_all(line, '\"([^\"]*)\"', 1), lambda a: a), lambda a: starts_with(a, 'http://') or starts_with(a, 'https://') or starts_with(a, '/'))[1] as url from {LINES} where regexp_matches(line, '\.(get|send|SendAsync)\(')")
def scl_07(spark, folder):
    calls = file_lines(spark, folder).where(F.col("line").rlike(r"\.(get|send|SendAsync)\("))
    return calls.select("file_id", "line_no", S.first_url(F.regexp_extract_all("line", F.lit('"([^"]*)"'), F.lit(1))).alias("url"))


@register("SCL-08_log_level", rf"select level, count(*) n from (select lower(regexp_replace(m, '(?i)^log', '')) as level from (select regexp_extract(line, '\b_?log(?:ger)?\.([A-Za-z]+)\(', 1) m from {LINES}) where m <> '') group by 1")
def scl_08(spark, folder):
    m = file_lines(spark, folder).select(F.regexp_extract("line", r"\b_?log(?:ger)?\.([A-Za-z]+)\(", 1).alias("m")).where("m <> ''")
    return m.select(S.log_level(F.col("m")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@register("SCL-09_filename", f"select distinct kind, name, {SLUG.format('name')} || '.yaml' as filename from artifacts where name is not null")
def scl_09(spark, folder):
    return table(spark, folder, "artifacts").where("name is not null").select("kind", "name", S.artifact_filename(F.col("name")).alias("filename")).distinct()


@register("SCL-10_normal_path", r"select distinct path, coalesce(nullif(regexp_replace(replace(regexp_replace(regexp_replace(path, '\{[^{}]*\}', chr(1), 'g'), '\{[^{}]*\}', chr(1), 'g'), chr(1), '{}'), '/+$', ''), ''), '/') as normal from (select flow_trigger.path || '/{a{' || name || '}}/' as path from flows where flow_trigger.path is not null)")
def scl_10(spark, folder):
    p = table(spark, folder, "flows").select(F.concat("flow_trigger.path", F.lit("/{a{"), "name", F.lit("}}/")).alias("path")).where("path is not null")
    return p.select("path", S.normal_path(F.col("path")).alias("normal")).distinct()


@register("SCL-11_major", r"select distinct version, try_cast(nullif(regexp_extract(trim(version), '^[vV]*(\d+)(?:\.|$)', 1), '') as int) as major from package_licenses where version is not null")
def scl_11(spark, folder):
    return table(spark, folder, "package_licenses").where("version is not null").select("version", S.major_version(F.col("version")).alias("major")).distinct()


@register("SCL-12_environment", f"select file_id, nullif(regexp_extract(regexp_extract(relative, '[^/]*$'), '^[^-]*-(.+)\\.[^.]*$', 1), '') as environment from {FILES} where language in ('yaml', 'json', 'properties')")
def scl_12(spark, folder):
    f = files(spark, folder).where(F.col("language").isin("yaml", "json", "properties"))
    return f.select("file_id", S.environment_of(F.col("relative")).alias("environment"))


@register("SCL-16_relaxed_key", rf"select lower(translate(k, '-_', '')) as key, count(*) n from (select regexp_extract(line, '^([A-Za-z][\w.-]*)[ ]*[:=]', 1) k from {LINES} where language = 'properties') where k <> '' group by 1")
def scl_16(spark, folder):
    k = file_lines(spark, folder).where("language = 'properties'").select(F.regexp_extract("line", r"^([A-Za-z][\w.-]*)[ ]*[:=]", 1).alias("k")).where("k <> ''")
    return k.groupBy(S.relaxed_key(F.col("k")).alias("key")).agg(F.count("*").alias("n"))


@register("SCL-17_enabled", rf"select file_id, bool_or(case when regexp_matches(line, '^\s*enabled:\s*true\b') then true when regexp_matches(line, '^\s*enabled:\s*false\b') then false end) as enabled from {LINES} where language = 'yaml' group by 1")
def scl_17(spark, folder):
    """true, false or unknown, by whether a configuration says so."""
    line = F.col("line")
    said = F.when(line.rlike(r"^\s*enabled:\s*true\b"), True).when(line.rlike(r"^\s*enabled:\s*false\b"), False)
    return file_lines(spark, folder).where("language = 'yaml'").groupBy("file_id").agg(F.bool_or(said).alias("enabled"))


_SEV = "case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' end"
#: the token in one of the schemes, by the order's key
_TOKEN = "case o_orderkey % 4 when 0 then 'SEV' when 1 then 'P' when 2 then ' s' else '' end || left(o_orderpriority, 1)"
_NAMED = "case lower(trim(t)) when 'sev1' then 'critical' when 'sev2' then 'high' when 'sev3' then 'medium' when 'sev4' then 'low' when 'p1' then 'critical' when 'p2' then 'high' when 'p3' then 'medium' when 'p4' then 'low' when 's1' then 'critical' when 's2' then 'high' when 's3' then 'medium' when 's4' then 'low' when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' end"
_RANK = "case {0} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"


@register("SCL-18_severity", f"select o_orderkey, {_NAMED} as severity, cast({_RANK.format(_NAMED)} as int) as severity_rank from (select o_orderkey, {_TOKEN} as t from orders)")
def scl_18(spark, folder):
    """Tokens of four schemes on the canonical scale; what no scheme has is null and ranks last."""
    scheme = F.element_at(F.array(*[F.lit(x) for x in ("SEV", "P", " s", "")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    severity = S.canonical_severity(F.concat(scheme, F.substring("o_orderpriority", 1, 1)))
    return table(spark, folder, "orders").select("o_orderkey", severity.alias("severity"), S.severity_rank(severity).alias("severity_rank"))


_TIER = "case c_mktsegment when 'BUILDING' then 'tier0' when 'AUTOMOBILE' then 'tier1' when 'MACHINERY' then 'tier2' when 'FURNITURE' then 'tier3' end"
_FLOOR = f"case {_TIER} when 'tier0' then 'critical' when 'tier1' then 'high' when 'tier2' then 'medium' when 'tier3' then 'low' end"


@register("SCL-19_floor", f"select severity, count(*) n from (select case when floor_ is null or {_RANK.format('sev')} <= {_RANK.format('floor_')} then sev else floor_ end as severity from (select {_SEV} sev, {_FLOOR} floor_ from orders join customer on o_custkey = c_custkey)) group by 1")
def scl_19(spark, folder):
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "tier0").when(F.col("c_mktsegment") == "AUTOMOBILE", "tier1").when(F.col("c_mktsegment") == "MACHINERY", "tier2").when(F.col("c_mktsegment") == "FURNITURE", "tier3")
    joined = table(spark, folder, "orders").select("o_custkey", "o_orderpriority").join(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(S.floored_severity(S.canonical_severity(F.substring("o_orderpriority", 1, 1)), tier).alias("severity")).agg(F.count("*").alias("n"))


@register("SCL-20_confidence", "select l_orderkey, count(*) n, round(least(0.95, 0.8 + least(0.06, 0.03 * greatest(0, count(*) - 1))), 3)::double as confidence from lineitem group by 1")
def scl_20(spark, folder):
    n = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.withColumn("confidence", S.corroborated(F.lit(0.8), F.col("n")))


@register("SCL-21_blast", f"select flow_id, n, loss, contained, case when (case when loss then 3 else 0 end) + (case when contained then 1 else 3 end) + least(2, greatest(1, n) - 1) >= 3 then 'high' else 'medium' end as severity from (select flow_id, count(*) n, bool_or(len(list_filter(s.failureModes, lambda m: m.dataLossRisk)) > 0) is true as loss, bool_or(len(list_filter(s.failureModes, lambda m: m.mode = 'circuit-open')) > 0) is true as contained from {STEPS} group by 1)")
def scl_21(spark, folder):
    modes = F.col("s.failureModes")
    per = flow_steps(spark, folder).groupBy("flow_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or(F.exists(modes, lambda m: F.coalesce(m["dataLossRisk"], F.lit(False)))), F.lit(False)).alias("loss"),
        F.coalesce(F.bool_or(F.exists(modes, lambda m: F.coalesce(m["mode"] == "circuit-open", F.lit(False)))), F.lit(False)).alias("contained"),
    )
    return per.withColumn("severity", S.blast_severity(F.col("n"), F.col("loss"), F.col("contained")))


@register("SCL-22_grade", "select artifact_id, case when c >= 0.9 then 'A' when c >= 0.75 then 'B' when c >= 0.6 then 'C' when c >= 0.4 then 'D' else 'F' end as grade from (select artifact_id, max(confidence) c from artifacts where confidence is not null group by 1)")
def scl_22(spark, folder):
    a = table(spark, folder, "artifacts").where("confidence is not null").groupBy("artifact_id").agg(F.max("confidence").alias("c"))
    return a.select("artifact_id", S.grade(F.col("c")).alias("grade"))


def _case(catalog) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({{0}}), '{'|'.join(h)}') then '{n}'" for n, h in catalog) + " end"


@register("SCL-24_engines", rf"select engine, broker, count(*) n from (select {_case(S.DATASTORES).format('u')} as engine, {_case(S.BROKERS).format('u')} as broker from (select unnest(regexp_extract_all(line, '[a-z]+://[^\s\"'']+')) u from {LINES})) group by all")
def scl_24(spark, folder):
    u = file_lines(spark, folder).select(F.explode(F.regexp_extract_all("line", F.lit(r"[a-z]+://[^\s\"']+"), F.lit(0))).alias("u"))
    return u.select(S.classified(F.col("u"), S.DATASTORES).alias("engine"), S.classified(F.col("u"), S.BROKERS).alias("broker")).groupBy("engine", "broker").agg(F.count("*").alias("n"))


_STACK_ORDER = ["java", "csharp", "python", "go", "typescript", "tsx", "javascript"]


@register("SCL-25_stack", "select project, language as stack from (select project, language, row_number() over (partition by project order by list_position(['java','csharp','python','go','typescript','tsx','javascript'], language)) r from (select distinct project, language from source_files where language in ('java','csharp','python','go','typescript','tsx','javascript'))) where r = 1")
def scl_25(spark, folder):
    """The stack of each project: the first of an ordered catalog that occurs in it."""
    order = F.array_position(F.array(*[F.lit(s) for s in _STACK_ORDER]), F.col("language"))
    f = table(spark, folder, "source_files").where(F.col("language").isin(_STACK_ORDER) & F.col("project").isNotNull())
    return f.groupBy("project").agg(F.min_by("language", order).alias("stack"))


#: The concerns' patterns as the comparison sees them; a timeout that is switched off (0, none, null, false) is cut out first.
_ON = r"regexp_replace(content, '(?i)\btimeout\s*=\s*(?:0(?:[^.\d]|$)|(?:none|null|false)\b)', ' ', 'g')"
_SHOWN = {
    "circuit-breaker": r"@CircuitBreaker\b|\bCircuitBreaker(?:Async)?\s*\(|\.CircuitBreaker(?:Async)?\b|resilience4j\.circuitbreaker",
    "fallback": r"\bfallback(?:Method|Factory)?\s*=|@Recover\b|\.(?:with)?Fallback(?:Async)?\s*\(",
    "timeout": r"@TimeLimiter\b|\bTimeout(?:Async)?\s*\(|\b(?:connect|read|response)Timeout\b|resilience4j\.timelimiter|\btimeout\s*=\s*\S",
    "retry": r"@Retry\b|\bWaitAndRetry\w*\s*\(|\bRetry(?:Async)?\s*\(",
    "bulkhead": r"@Bulkhead\b|\bThreadPoolBulkhead\b|\bBulkhead(?:Async)?\s*\(|\.Bulkhead(?:Async)?\b|resilience4j\.(?:thread-pool-)?bulkhead",
    "rate-limit": r"@RateLimiter\b|resilience4j\.ratelimiter|\bRateLimiter\s*\(|\.RateLimit(?:Async)?\b|\bAddRateLimiter\b",
    "idempotency": r"\bidempotenc(?:y|e)[-_]?key\b|@Idempotent\b|\bIdempotencyKey\b|\bdedupe[-_]?key\b",
    "scheduled": r"@Scheduled\b|@DisallowConcurrentExecution\b|@(?:shared_task|periodic_task|task)\b|@app\.on_event\b|@\w*scheduler\.scheduled_job\b|\bBackgroundScheduler\b|@repeat_every\b",
    "backpressure": r"\.onBackpressure(?:Buffer|Drop|Latest|Error)\s*\(|\.limitRate\s*\(|\bBackpressureStrategy\.|\bOverflowStrategy\.|\bnew\s+ArrayBlockingQueue\b|\bnew\s+LinkedBlocking(?:Queue|Deque)\s*(?:<[^>]*>)?\s*\(\s*\w|\bChannel\.CreateBounded\b|\bBoundedChannelOptions\b|\bmake\s*\(\s*chan\b[^,)]*,\s*\w|\bhighWaterMark\s*[:=]",
    "load-shed": r"\btryAcquire\s*\(|\bConcurrencyLimit(?:er)?\b|\bRejectionStatusCode\b|\blimit_(?:req|conn)\b",
    "dead-letter": r"@RetryableTopic\b|@DltHandler\b|\bDeadLetterPublishingRecoverer\b|\bx-dead-letter-(?:exchange|routing-key)\b|\b(?:enable[-_]?dlq|auto[-_]?bind[-_]?dlq|dlq[-_]?name)\b|\bSendToDlq\b|\bredrive[-_]?policy\b",
}


def _fires() -> str:
    return ", ".join(f"count(*) filter (regexp_matches({_ON if c == 'timeout' else 'content'}, '(?i){p}')) as \"{c}\"" for c, p in _SHOWN.items())


@register("SCL-26_signatures", f"select language, {_fires()} from {FILES} group by 1")
def scl_26(spark, folder):
    """How many files show each resiliency mechanism, by language; texts without a concern's words aren't searched for it."""
    f = files(spark, folder).withColumn("low", F.lower("content"))
    counts = [F.count_if(S.signature_hits(F.col("content"), p, S.SIGNATURE_WORDS[c], F.col("low"))).alias(c) for c, p in S.SIGNATURES.items()]
    return f.groupBy("language").agg(*counts)


@register("SCL-27_unquoted", rf"select file_id, line_no, regexp_replace(v, '^[\"'']|[\"'']$', '', 'g') as value from (select file_id, line_no, regexp_extract(line, '^\s*[\w-]+:\s+(\S.*)$', 1) v from {LINES} where language = 'yaml') where v <> ''")
def scl_27(spark, folder):
    v = file_lines(spark, folder).where("language = 'yaml'").select("file_id", "line_no", F.regexp_extract("line", r"^\s*[\w-]+:\s+(\S.*)$", 1).alias("v")).where("v <> ''")
    return v.select("file_id", "line_no", F.regexp_replace("v", "^[\"']|[\"']$", "").alias("value"))


@register("SCL-28_bound", "select distinct l_quantity, regexp_replace(regexp_replace(printf('%f', l_quantity * 25 / 1000), '0+$', ''), '\\.$', '') as bound from lineitem")
def scl_28(spark, folder):
    q = table(spark, folder, "lineitem").select("l_quantity").distinct()
    return q.select("l_quantity", S.histogram_bound(F.col("l_quantity") * 25).alias("bound"))


@register("SCL-29_extension", f"select extension, count(*) n from (select case when instr(regexp_extract(relative, '[^/]*$'), '.') > 1 then '.' || lower(regexp_extract(relative, '[^.]*$')) else regexp_extract(relative, '[^/]*$') end as extension from {FILES}) group by 1")
def scl_29(spark, folder):
    return files(spark, folder).groupBy(S.extension_group(F.col("relative")).alias("extension")).agg(F.count("*").alias("n"))


@register("SCL-31_no_login", rf"select distinct regexp_replace(url, '://[^/@\s]*@', '://') as url from (select unnest(regexp_extract_all(line, '[a-z]+://[^\s\"'']+')) url from {LINES})")
def scl_31(spark, folder):
    urls = file_lines(spark, folder).select(F.explode(F.regexp_extract_all("line", F.lit(r"[a-z]+://[^\s\"']+"), F.lit(0))).alias("url"))
    return urls.select(S.without_login(F.col("url")).alias("url")).distinct()


@register("SCL-32_cells", r"select doc_id, md5(regexp_replace(regexp_replace(text, '\|', '\\|', 'g'), '[\r\n]+', ' ', 'g')) as cell from documents")
def scl_32(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(S.table_cell(F.col("text"))).alias("cell"))


@register("SCL-33_defanged", "select doc_id, md5(replace(text, '```', '` ` ` ')) as safe from documents where contains(text, '```')")
def scl_33(spark, folder):
    return table(spark, folder, "documents").where(F.col("text").contains("```")).select("doc_id", F.md5(S.defanged(F.col("text"))).alias("safe"))


@register("SCL-34_package_name", "select distinct ecosystem, name, case when ecosystem = 'pypi' then lower(regexp_replace(name, '[-_.]+', '-', 'g')) when ecosystem in ('nuget', 'npm') then lower(name) else name end as normal from package_licenses where name is not null")
def scl_34(spark, folder):
    return table(spark, folder, "package_licenses").where("name is not null").select("ecosystem", "name", S.package_name(F.col("ecosystem"), F.col("name")).alias("normal")).distinct()


@register("SCL-36_purl", "select distinct node, regexp_extract(node, '^package:([^:/]+)[:/]', 1) as ecosystem, regexp_extract(node, '^package:[^:/]+[:/](.+?)(?:@[^@]*)?$', 1) as name, nullif(regexp_extract(node, '.@([^@?]+)[^@]*$', 1), '') as version from package_licenses where node is not null")
def scl_36(spark, folder):
    p = table(spark, folder, "package_licenses").where("node is not null").select("node", S.purl_parts(F.col("node")).alias("p")).distinct()
    return p.select("node", "p.ecosystem", "p.name", "p.version")


@register("SCL-38_stable_id", "select distinct project, relative, 'file:' || left(sha256(project || chr(0) || relative), 16) as id from source_files where project is not null and relative is not null")
def scl_38(spark, folder):
    f = table(spark, folder, "source_files").where("project is not null and relative is not null").select("project", "relative").distinct()
    return f.select("project", "relative", S.stable_id("file", F.col("project"), F.col("relative")).alias("id"))


@register("SCL-43_burn", "select slo, 1 - slo / 100 as budget, (1 - slo / 100) * 14.4 as fast, (1 - slo / 100) * 6.0 as slow from (select distinct 90 + (l_quantity / 5.5) as slo from lineitem)")
def scl_43(spark, folder):
    t = table(spark, folder, "lineitem").select((90 + F.col("l_quantity") / 5.5).alias("slo")).distinct()
    return t.select("slo", S.burn_thresholds(F.col("slo")).alias("b")).select("slo", "b.*")


# --- predicates ---


@register("FLT-02_excluded", f"select file_id from {FILES} where not regexp_matches(relative, '(^|/)tests/') and not regexp_matches(relative, '^modules/.*')")
def flt_02(spark, folder):
    """Files outside a list of exclusion globs."""
    return files(spark, folder).where(~F.col("relative").rlike("(^|/)tests/|^modules/.*")).select("file_id")


_CLASS_SQL = {k: v.replace("'", "''") for k, v in S.DATA_CLASSES.items()}


@register("FLT-04_data_classes", f"select language, count(*) filter (regexp_matches(line, '{_CLASS_SQL['pci']}')) as pci, count(*) filter (regexp_matches(line, '{_CLASS_SQL['pii']}')) as pii from {LINES} group by 1")
def flt_04(spark, folder):
    """Lines that show each class of personal data, by language."""
    hits = S.named_hits(F.col("line"), S.DATA_CLASSES)
    return file_lines(spark, folder).groupBy("language").agg(*[F.count_if(F.array_contains(hits, c)).alias(c) for c in S.DATA_CLASSES])


_DANGER_SQL = ", ".join("count(*) filter (regexp_matches(content, '" + p + "')) as \"" + n + "\"" for n, p in S.DANGEROUS.items())


@register("FLT-05_dangerous", f"select language, count(*) n_files, {_DANGER_SQL} from {FILES} group by 1")
def flt_05(spark, folder):
    """Files with content that must not stand in a runbook, by language."""
    hits = S.named_hits(F.col("content"), S.DANGEROUS)
    return files(spark, folder).groupBy("language").agg(F.count("*").alias("n_files"), *[F.count_if(F.array_contains(hits, c)).alias(c) for c in S.DANGEROUS])


@register("FLT-10_contained", f"select source_root, count(*) n, count(*) filter (starts_with(relative, source_root || '/')) as n_inside from (select distinct file_id, relative, source_root from source_files where source_root is not null) group by 1")
def flt_10(spark, folder):
    """Whether files lie below their source root."""
    f = table(spark, folder, "source_files").where("source_root is not null").select("file_id", "relative", "source_root").distinct()
    inside = F.startswith(F.col("relative"), F.concat("source_root", F.lit("/")))
    return f.groupBy("source_root").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


@register("FLT-12_name_shape", "select distinct name, regexp_matches(name, '^[a-z][a-z0-9-]{2,40}$') as fits from artifacts where name is not null")
def flt_12(spark, folder):
    return table(spark, folder, "artifacts").where("name is not null").select("name", F.col("name").rlike("^[a-z][a-z0-9-]{2,40}$").alias("fits")).distinct()


@register("FLT-13_whole_token", "select doc_id from documents where service is not null and regexp_matches(text, '(^|[^A-Za-z0-9_-])' || service || '([^A-Za-z0-9_-]|$)')")
def flt_13(spark, folder):
    """Documents that name their own service as a whole word."""
    d = table(spark, folder, "documents").where("service is not null")
    return d.where(F.regexp_like("text", F.concat(F.lit("(^|[^A-Za-z0-9_-])"), "service", F.lit("([^A-Za-z0-9_-]|$)")))).select("doc_id")


@register("FLT-14_dynamic_imports", rf"select file_id, line_no from {LINES} where regexp_matches(line, '\b(importlib\.import_module|__import__|require|import)\s*\(')")
def flt_14(spark, folder):
    return file_lines(spark, folder).where(F.col("line").rlike(r"\b(importlib\.import_module|__import__|require|import)\s*\(")).select("file_id", "line_no")


@register("FLT-15_disabled", rf"select project, count(*) n_toggles, count(*) filter (regexp_matches(line, '(?i)\benabled\s*[:=]\s*[''\"]?false\b')) as n_disabled from {LINES} where regexp_matches(line, '(?i)\benabled\s*[:=]') group by 1")
def flt_15(spark, folder):
    """Lines that set `enabled`, and those that switch it off."""
    line = F.col("line")
    toggles = file_lines(spark, folder).where(line.rlike(r"(?i)\benabled\s*[:=]"))
    return toggles.groupBy("project").agg(F.count("*").alias("n_toggles"), F.count_if(line.rlike(r"(?i)\benabled\s*[:=]\s*['\"]?false\b")).alias("n_disabled"))

"""Facts read from source files, and roll-ups, checks and joins built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions.text import slug
from lodestrata.operators.graphs import coupling, downgraded
from lodestrata.operators.joins import sole_or_exact
from lodestrata.operators.windows import global_rank
from lodestrata.plans.registering import Register
from lodestrata.plans.relation_queries import _DELIVERED, _DOWN_SQL, ARTS, CALLS, REFS, SINKS, artifacts, calls, delivered, dependency_graph, refs, sinks
from lodestrata.plans.scalar_queries import FILES, LINES, SLUG, STEPS, file_lines, files, flow_steps
from lodestrata.sources.manifests import packages_of_imports
from lodestrata.sources.tables import table

register = Register()
QUERIES, ORACLE = register.queries, register.oracle

#: How each language writes the facts that a line shows, with the fact's subject in the first group.
FACTS = [
    ("rest.endpoint", "java", r"@(?:Post|Get|Put|Delete|Request)Mapping\(\"([^\"]*)\""),
    ("rest.endpoint", "csharp", r"\[(?:Http(?:Get|Post|Put|Delete|Patch)|Route)\(\"([^\"]*)\""),
    ("rest.endpoint", "python", r"^\s*@\w+\.(?:get|post|put|delete|patch|route)\([\x22\x27]([^\x22\x27]*)"),
    ("rest.endpoint", "javascript", r"\b(?:app|router|server)\.(?:get|post|put|delete|patch)\([\x22\x27\x60]([^\x22\x27\x60]*)"),
    ("rest.endpoint", "typescript", r"\b(?:app|router|server)\.(?:get|post|put|delete|patch)\([\x22\x27\x60]([^\x22\x27\x60]*)"),
    ("rest.endpoint", "go", r"\.(?:HandleFunc|Handle|GET|POST|PUT|DELETE)\(\"([^\"]*)\""),
    ("http.egress", "java", r"\b\w+\.(?:send|exchange|getForObject|getForEntity|postForObject|postForEntity)\(\"([^\"]*)\""),
    ("http.egress", "csharp", r"\b\w+\.(?:Send|Get|GetString|Post|PostAsJson|Put|Delete)Async\(\"([^\"]*)\""),
    ("http.egress", "python", r"\b(?:client|session|requests|httpx)\.(?:get|post|put|delete|patch|request)\(f?\"([^\"]*)\""),
    ("http.egress", "javascript", r"\b(?:(?:client|axios|http)\.(?:get|post|put|delete|patch)|fetch)\([\x22\x27\x60]([^\x22\x27\x60]*)"),
    ("http.egress", "typescript", r"\b(?:(?:client|axios|http)\.(?:get|post|put|delete|patch)|fetch)\([\x22\x27\x60]([^\x22\x27\x60]*)"),
    ("http.egress", "tsx", r"\b(?:(?:client|axios|http)\.(?:get|post|put|delete|patch)|fetch)\([\x22\x27\x60]([^\x22\x27\x60]*)"),
    ("http.egress", "go", r"\b(?:http|client)\.(?:Get|Post|Head)\(\"([^\"]*)\""),
    ("resiliency.circuitbreaker", "java", r"@CircuitBreaker\(\s*name\s*=\s*\"([^\"]*)\""),
    ("resiliency.circuitbreaker", "csharp", r"\.(CircuitBreaker(?:Async)?)\("),
    ("resiliency.fallback", "java", r"fallbackMethod\s*=\s*\"([^\"]*)\""),
    ("messaging.consumer", "java", r"@(?:KafkaListener|RabbitListener|JmsListener|SqsListener)\((.*)\)"),
    ("messaging.publish", "java", r"\b\w*[Tt]emplate\.(?:send|convertAndSend)\(\"([^\"]*)\""),
    ("job.scheduled", "java", r"@Scheduled\((.*)\)"),
    ("job.scheduled", "python", r"^\s*@(\w*scheduler\.scheduled_job|shared_task|periodic_task|repeat_every)\b"),
    ("annotation", "java", r"^\s*@(\w+)"),
    ("attribute", "csharp", r"^\s*\[(\w+)[\](]"),
    ("decorator", "python", r"^\s*@([\w.]+)"),
    ("log.statement", "java", r"\blog(?:ger)?\.(trace|debug|info|warn|error)\("),
    ("log.statement", "csharp", r"\b_log(?:ger)?\.(Log\w+)\("),
    ("log.statement", "python", r"\blog(?:ger)?\.(debug|info|warning|error|exception|critical)\("),
    ("log.statement", "go", r"\blog\.(Print\w*|Fatal\w*)\("),
    ("db.repository", "java", r"private final (\w+Repository) "),
    ("type", "java", r"^\s*public (?:final )?class (\w+)"),
    ("type", "csharp", r"^\s*public (?:sealed )?class (\w+)"),
    ("type", "python", r"^class (\w+)"),
    ("function", "go", r"^func (\w+)\("),
    ("function", "python", r"^\s*def (\w+)\("),
]
_FACT_SQL = " union all ".join(f"select '{t}' as type, file_id, project, language, line_no, regexp_extract(line, '{p}', 1) as subject from {LINES} where language = '{lang}' and regexp_matches(line, '{p}')" for t, lang, p in FACTS)
FACT_ROWS = f"({_FACT_SQL})"


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """type, file_id, project, language, line_no, subject: one pass over the lines, the patterns of a language side by side."""
    hits = [F.when((F.col("language") == lang) & F.col("line").rlike(p), F.struct(F.lit(t).alias("type"), F.regexp_extract("line", p, 1).alias("subject"))) for t, lang, p in FACTS]
    each = file_lines(spark, folder).select("file_id", "project", "language", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return each.select("f.type", "file_id", "project", "language", "line_no", "f.subject")


@register("FLT-01_facts_of_type", f"select file_id, line_no, subject from {FACT_ROWS} where type in ('rest.endpoint', 'db.repository')")
def flt_01(spark, folder):
    return facts(spark, folder).where(F.col("type").isin("rest.endpoint", "db.repository")).select("file_id", "line_no", "subject")


_LOGGER, _LOGLIKE = r"\b(log|logger|_log|LOG)\.(Log)?(info|warn|warning|error|debug|Information|Warning|Error|Printf)\(", r"(?i)\b\w*log\w*\.\w+\("


@register("FLT-03_log_calls", f"select language, count(*) filter (regexp_matches(line, '{_LOGGER}')) n_logger, count(*) filter (regexp_matches(line, '{_LOGLIKE}')) n_loglike from {LINES} group by 1")
def flt_03(spark, folder):
    """Log calls by both predicates: a receiver that is a logger, and one whose name only holds the word."""
    line = F.col("line")
    return file_lines(spark, folder).groupBy("language").agg(F.count_if(line.rlike(_LOGGER)).alias("n_logger"), F.count_if(line.rlike(_LOGLIKE)).alias("n_loglike"))


@register("FLT-11_alertable", rf"select file_id, line_no from {LINES} where regexp_matches(line, '\b_?log(?:ger)?\.(?:Log)?(?:warn|warning|error|Warning|Error)\(')")
def flt_11(spark, folder):
    return file_lines(spark, folder).where(F.col("line").rlike(r"\b_?log(?:ger)?\.(?:Log)?(?:warn|warning|error|Warning|Error)\(")).select("file_id", "line_no")


@register("FLT-17_evidence_shape", "select node_id, snapshot_no, delivery_no, path is not null and excerpt_hash is not null and starts_with(excerpt_hash, 'sha256:') as file_backed from atlas_snapshots where node_id is not null group by all")
def flt_17(spark, folder):
    """Whether a node's evidence has what file-backed evidence needs."""
    a = table(spark, folder, "atlas_snapshots").where("node_id is not null")
    shape = F.col("path").isNotNull() & F.col("excerpt_hash").isNotNull() & F.coalesce(F.col("excerpt_hash").startswith("sha256:"), F.lit(False))
    return a.select("node_id", "snapshot_no", "delivery_no", shape.alias("file_backed")).distinct()


@register("DRV-01_facts", f"select type, language, count(*) n, count(distinct file_id) n_files from {FACT_ROWS} group by 1, 2")
def drv_01(spark, folder):
    return facts(spark, folder).groupBy("type", "language").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


_SWALLOW = rf"(select file_id, line_no, lead(line, 1) over w l1, lead(line, 2) over w l2, line from {LINES} where language in ('java', 'csharp', 'python') window w as (partition by file_id order by line_no))"


@register("DRV-03_swallowed", rf"select file_id, line_no from {_SWALLOW} where regexp_matches(line, '^\s*(\}} )?(catch|except)\b') and (regexp_matches(coalesce(l1, ''), '\blog\.|_log\.') or regexp_matches(coalesce(l2, ''), '\blog\.|_log\.')) and not regexp_matches(coalesce(l2, ''), '\b(throw|raise)\b')")
def drv_03(spark, folder):
    """Handlers that log and don't raise in the line behind."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    t = file_lines(spark, folder).where(F.col("language").isin("java", "csharp", "python")).select("file_id", "line_no", "line", F.lead("line", 1, "").over(w).alias("l1"), F.lead("line", 2, "").over(w).alias("l2"))
    logs = F.col("l1").rlike(r"\blog\.|_log\.") | F.col("l2").rlike(r"\blog\.|_log\.")
    return t.where(F.col("line").rlike(r"^\s*(\} )?(catch|except)\b") & logs & ~F.col("l2").rlike(r"\b(throw|raise)\b")).select("file_id", "line_no")


@register("DRV-12_config_properties", rf"select file_id, line_no, regexp_extract(line, '^([\w.-]+)\s*[=:]\s*(.*)$', 1) as key, regexp_extract(line, '^([\w.-]+)\s*[=:]\s*(.*)$', 2) as value from {LINES} where language = 'properties' and regexp_matches(line, '^[\w.-]+\s*[=:]')")
def drv_12(spark, folder):
    spec = r"^([\w.-]+)\s*[=:]\s*(.*)$"
    p = file_lines(spark, folder).where((F.col("language") == "properties") & F.col("line").rlike(r"^[\w.-]+\s*[=:]"))
    return p.select("file_id", "line_no", F.regexp_extract("line", spec, 1).alias("key"), F.regexp_extract("line", spec, 2).alias("value"))


@register("DRV-19_imports", rf"select file_id, line_no, case when regexp_matches(line, '^import [^;]*from ') then regexp_extract(line, 'from \"([^\"]*)\"', 1) when language = 'java' then regexp_extract(line, '^import ([\w.*]+);', 1) when language = 'csharp' then regexp_extract(line, '^using ([\w.]+);', 1) when regexp_matches(line, '^from ') then regexp_extract(line, '^from (\S+) import', 1) else regexp_extract(line, '^import ([\w.]+)', 1) end as symbol from {LINES} where regexp_matches(line, '^(import|from|using) [^(]')")
def drv_19(spark, folder):
    """What each import statement names, by language."""
    line, lang = F.col("line"), F.col("language")
    pick = lambda p: F.regexp_extract("line", p, 1)
    symbol = (
        F.when(line.rlike(r"^import [^;]*from "), pick(r'from "([^"]*)"')).when(lang == "java", pick(r"^import ([\w.*]+);")).when(lang == "csharp", pick(r"^using ([\w.]+);")).when(line.rlike("^from "), pick(r"^from (\S+) import")).otherwise(pick(r"^import ([\w.]+)"))
    )
    return file_lines(spark, folder).where(line.rlike(r"^(import|from|using) [^(]")).select("file_id", "line_no", symbol.alias("symbol"))


@register("JN-05_endpoint_handlers", f"""with e as (select file_id, line_no, subject from {FACT_ROWS} where type = 'rest.endpoint'), m as (select file_id, line_no, regexp_extract(line, 'public [\\w<>\\[\\], ]+ (\\w+)\\(', 1) as handler from {LINES} where language = 'java' and regexp_matches(line, 'public [\\w<>\\[\\], ]+ (\\w+)\\('))
select e.file_id, e.line_no, e.subject, m.handler from e join m on e.file_id = m.file_id and m.line_no = e.line_no + 1""")
def jn_05(spark, folder):
    """Endpoints with the method that follows their annotation."""
    e = facts(spark, folder).where("type = 'rest.endpoint'").select("file_id", "line_no", "subject")
    spec = r"public [\w<>\[\], ]+ (\w+)\("
    m = file_lines(spark, folder).where("language = 'java'").select("file_id", (F.col("line_no") - 1).alias("line_no"), F.regexp_extract("line", spec, 1).alias("handler")).where("handler <> ''")
    return e.join(m, ["file_id", "line_no"])


@register("JN-09_typed_binding", f"select s.service, s.target, case when a.kind is null then 'unknown' else a.kind end as kind from (select distinct service, target from {SINKS}) s left join (select service, name, arg_max(kind, (recorded_at, artifact_id, kind)) kind from {ARTS} group by 1, 2) a on s.service = a.service and s.target = a.name")
def jn_09(spark, folder):
    """Sinks with the kind the registry gives their target, the one recorded last."""
    kinds = artifacts(spark, folder).groupBy("service", F.col("name").alias("target")).agg(F.max_by("kind", F.struct("recorded_at", "artifact_id", "kind")).alias("kind"))
    return sinks(spark, folder).select("service", "target").distinct().join(kinds, ["service", "target"], "left").fillna("unknown", ["kind"])


@register("JN-17_change_consumers", f"select c.dst as provider, c.src as consumer from {CALLS} c join (select dst from {CALLS} group by 1 having count(distinct src) >= 3) p using (dst)")
def jn_17(spark, folder):
    """Consumers of the providers that many call: who a change of theirs reaches."""
    c = calls(spark, folder)
    many = c.groupBy("dst").agg(F.count_distinct("src").alias("n")).where("n >= 3").select("dst")
    return c.join(many, "dst", "left_semi").select(F.col("dst").alias("provider"), F.col("src").alias("consumer"))


@register("JN-19_node_risk", f"select s.target, max(m.mode) as worst_mode, bool_or(coalesce(m.dataLossRisk, false)) as data_loss from (select distinct service, flow, target from {SINKS}) s join (select service, flow, unnest(s.failureModes) m from {STEPS}) x on s.service = x.service and s.flow = x.flow where m is not null group by 1")
def jn_19(spark, folder):
    """Targets with the worst that can happen in the flows that reach them."""
    modes = flow_steps(spark, folder).select("service", "flow", F.explode("s.failureModes").alias("m")).where("m is not null")
    per = modes.groupBy("service", "flow").agg(F.max("m.mode").alias("mode"), F.bool_or(F.coalesce("m.dataLossRisk", F.lit(False))).alias("loss"))
    return sinks(spark, folder).select("service", "flow", "target").distinct().join(per, ["service", "flow"]).groupBy("target").agg(F.max("mode").alias("worst_mode"), F.bool_or("loss").alias("data_loss"))


@register("JN-24_relative_imports", rf"""with i as (select distinct project, regexp_replace(relative, '/[^/]*$', '') as dir, regexp_extract(line, 'from \"\./([^\"]*)\"', 1) as name from {LINES} where regexp_matches(line, 'from \"\./')),
c as (select i.*, e.ext, e.r, i.dir || '/' || i.name || e.ext as path from i, (values ('.ts', 1), ('.tsx', 2), ('.js', 3)) e(ext, r)),
f as (select distinct project, relative as path from source_files)
select i.project, i.dir, i.name, arg_min(f.path, c.r) as resolved from i left join c on i.project = c.project and i.dir = c.dir and i.name = c.name left join f on c.project = f.project and c.path = f.path group by 1, 2, 3""")
def jn_24(spark, folder):
    """Relative imports to the first candidate file in order of extension, null if none is there."""
    i = file_lines(spark, folder).where(F.col("line").rlike(r'from "\./')).select("project", F.regexp_replace("relative", "/[^/]*$", "").alias("dir"), F.regexp_extract("line", r'from "\./([^"]*)"', 1).alias("name")).distinct()
    tried = i.select("*", F.posexplode(F.array(*[F.concat("dir", F.lit("/"), "name", F.lit(e)) for e in (".ts", ".tsx", ".js")])).alias("r", "path"))
    there = table(spark, folder, "source_files").select("project", F.col("relative").alias("path")).distinct()
    hits = tried.join(there, ["project", "path"]).groupBy("project", "dir", "name").agg(F.min_by("path", "r").alias("resolved"))
    return i.join(hits, ["project", "dir", "name"], "left")


@register("JN-29_lines_in_range", rf"select t.file_id, t.line_no as type_line, count(l.line_no) as n_logs from (select file_id, line_no, lead(line_no, 1, 1000000) over (partition by file_id order by line_no) as until from {FACT_ROWS} where type = 'type') t left join (select file_id, line_no from {LINES} where regexp_matches(line, '\blog\.')) l on t.file_id = l.file_id and l.line_no >= t.line_no and l.line_no < t.until group by 1, 2")
def jn_29(spark, folder):
    """Log lines within the range of each type: counts run along one sort instead of a range join."""
    is_type = reduce(lambda a, b: a | b, [(F.col("language") == lang) & F.col("line").rlike(p) for t, lang, p in FACTS if t == "type"])
    w = Window.partitionBy("file_id").orderBy("line_no")
    marked = file_lines(spark, folder).select("file_id", "line_no", F.when(is_type, F.col("line_no")).alias("t"), F.col("line").rlike(r"\blog\.").alias("is_log"))
    within = marked.withColumn("type_line", F.last("t", ignorenulls=True).over(w)).where("type_line is not null")
    return within.groupBy("file_id", "type_line").agg(F.count_if("is_log").alias("n_logs"))


@register("JN-30_covered", "select distinct service from flows where service in (select service from narratives)")
def jn_30(spark, folder):
    return table(spark, folder, "flows").select("service").distinct().join(table(spark, folder, "narratives").select("service").distinct(), "service", "left_semi")


@register("AGG-14_version_policy", f"""with r as (select distinct snapshot_no n, project, node_id, node_type, version from {_DELIVERED.replace(' where path is not null', '')} where project is not null and node_id is not null),
v as (select n, project, max(version) as version from r group by 1, 2),
x as (select a.n + 1 as n, a.project, count(*) filter (b.node_id is null) as breaking from (select distinct n, project, node_id from r where node_type = 'endpoint') a left join (select distinct n, project, node_id from r) b on b.n = a.n + 1 and b.project = a.project and b.node_id = a.node_id where a.n < (select max(n) from r) group by 1, 2),
m as (select x.*, try_cast(nullif(regexp_extract(trim(w.version), '^[vV]*(\\d+)(?:\\.|$)', 1), '') as int) as was, try_cast(nullif(regexp_extract(trim(c.version), '^[vV]*(\\d+)(?:\\.|$)', 1), '') as int) as now from x left join v w on w.project = x.project and w.n = x.n - 1 left join v c on c.project = x.project and c.n = x.n)
select n as snapshot_no, project, breaking, coalesce(now > was, false) as major_bumped, breaking = 0 or coalesce(now > was, false) or was is null or now is null as ok from m""")
def agg_14(spark, folder):
    """Per project and snapshot: endpoints that vanished since the one before, and whether the major version rose for it.

    A version that can't be read passes; the version of a project is the greatest of its packages.
    """
    r = delivered(spark, folder).where("project is not null and node_id is not null").select(F.col("snapshot_no").alias("n"), "project", "node_id", "node_type", "version").distinct()
    last = r.agg(F.max("n")).first()[0]
    v = r.groupBy("n", "project").agg(F.max("version").alias("version"))
    before = r.where("node_type = 'endpoint'").select((F.col("n") + 1).alias("n"), "project", "node_id").distinct().where(F.col("n") <= F.lit(last))
    now = r.select("n", "project", "node_id").distinct().withColumn("there", F.lit(True))
    x = before.join(now, ["n", "project", "node_id"], "left").groupBy("n", "project").agg(F.count_if(F.col("there").isNull()).alias("breaking"))
    x = x.join(v.withColumnRenamed("version", "now"), ["n", "project"], "left").join(v.select((F.col("n") + 1).alias("n"), "project", F.col("version").alias("was")), ["n", "project"], "left")
    return x.select(F.col("n").alias("snapshot_no"), "project", S.version_policy(F.col("breaking"), F.col("was"), F.col("now")).alias("p")).select("snapshot_no", "project", "p.*")


@register("AGG-16_tech_stack", f"select f.project, f.language as main_language, coalesce(p.ecosystem, f.language) as ecosystem from (select project, language from (select project, language, row_number() over (partition by project order by count(*) desc, language) r from {FILES} where language is not null group by 1, 2) where r = 1) f left join (select project, max(ecosystem) ecosystem from package_licenses group by 1) p using (project) where f.project is not null")
def agg_16(spark, folder):
    """Main language of each project and the ecosystem of its packages, the language standing in where there are none."""
    n = files(spark, folder).where("language is not null and project is not null").groupBy("project", "language").agg(F.count("*").alias("n"))
    main = n.groupBy("project").agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("main_language"))
    eco = table(spark, folder, "package_licenses").groupBy("project").agg(F.max("ecosystem").alias("e"))
    return main.join(eco, "project", "left").select("project", "main_language", F.coalesce("e", "main_language").alias("ecosystem"))


@register("AGG-18_config_sources", f"select project, array_to_string(list_sort(list(distinct regexp_extract(relative, '[^/]*$'))), ',') as names from {FILES} where language in ('yaml', 'json', 'properties') and project is not null group by 1")
def agg_18(spark, folder):
    f = files(spark, folder).where(F.col("language").isin("yaml", "json", "properties") & F.col("project").isNotNull())
    return f.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("relative", "/", -1))), ",").alias("names"))


@register("AGG-19_interfaces", f"select project, count(*) n, count(*) filter (type = 'rest.endpoint') as provided, count(*) filter (type = 'http.egress') as used from {FACT_ROWS} where type in ('rest.endpoint', 'http.egress') group by 1")
def agg_19(spark, folder):
    f = facts(spark, folder).where(F.col("type").isin("rest.endpoint", "http.egress"))
    return f.groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "rest.endpoint").alias("provided"), F.count_if(F.col("type") == "http.egress").alias("used"))


@register("AGG-30_pattern_on_anchors", f"select kind, count(*) n, count(*) filter (regexp_matches(name, '^(merge|split)-')) as k from {REFS} group by 1")
def agg_30(spark, folder):
    """On how many of the anchors a drafted pattern fires."""
    return refs(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("name").rlike("^(merge|split)-")).alias("k"))


@register("AGG-32_brief", f"select service, count(*) n, count(distinct kind) n_kinds, array_to_string((list_sort(list(distinct kind || '/' || name)))[1:20], ',') as allowed from {ARTS} where service is not null group by 1")
def agg_32(spark, folder):
    """What a narrative of a service may cite; twenty references fill the brief, so no more of a service reach one task."""
    a = artifacts(spark, folder).where("service is not null")
    named = a.select("service", F.concat_ws("/", "kind", "name").alias("ref")).distinct()
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("service").orderBy("ref"))).where("r <= 20")
    allowed = first.groupBy("service").agg(F.array_join(F.array_sort(F.collect_list("ref")), ",").alias("allowed"))
    return a.groupBy("service").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("n_kinds")).join(allowed, "service")


@register("WIN-02_rank", "select artifact_id, kind, name, row_number() over (order by case kind when 'Alert' then 0 when 'Flow' then 1 else 2 end, kind, name, artifact_id, recorded_at) as place from (select distinct artifact_id, kind, name, recorded_at from artifacts)")
def win_02(spark, folder):
    """All findings by rank, type and title."""
    a = table(spark, folder, "artifacts").select("artifact_id", "kind", "name", "recorded_at").distinct()
    rank = F.when(F.col("kind") == "Alert", 0).when(F.col("kind") == "Flow", 1).otherwise(2)
    return global_rank(a, [rank, F.asc_nulls_last("kind"), F.asc_nulls_last("name"), F.col("artifact_id"), F.asc_nulls_last("recorded_at")]).select("artifact_id", "kind", "name", "place")


@register("WIN-06_notable_libraries", "select project, name from (select project, name, row_number() over (partition by project order by min(record_id), name) r from package_licenses where name is not null group by 1, 2) where r <= 20")
def win_06(spark, folder):
    p = table(spark, folder, "package_licenses").where("name is not null").groupBy("project", "name").agg(F.min("record_id").alias("first"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy("first", "name"))).where("r <= 20").select("project", "name")


@register("WIN-12_log_counts", "select event_type, regexp_extract(props, '\"k\": *(\\d+)', 1) as pattern, time_bucket(interval '5 minutes', ts) as start_at, count(*) n from events where ts is not null and props is not null group by 1, 2, 3")
def win_12(spark, folder):
    """Events by type, pattern and five minutes."""
    e = table(spark, folder, "events").where("ts is not null and props is not null").withColumn("pattern", F.regexp_extract("props", '"k": *(\\d+)', 1))
    return e.groupBy("event_type", "pattern", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select("event_type", "pattern", F.col("w.start").alias("start_at"), "n")


@register("SET-02_file_drift", f"""with h as (select snapshot_no n, path, max(excerpt_hash) h from {_DELIVERED} group by 1, 2), b as (select distinct n from h where n > (select min(n) from h))
select n as snapshot_no, path, case when was is null then 'added' when now is null then 'removed' else 'changed' end as change from (
  select b.n, k.path, p.h was, c.h now from b join (select distinct path from h) k on true left join h p on p.n = b.n - 1 and p.path = k.path left join h c on c.n = b.n and c.path = k.path) where was is distinct from now""")
def set_02(spark, folder):
    """File sets of each snapshot and the one before, by path and content."""
    a = delivered(spark, folder).where("path is not null").groupBy("snapshot_no", "path").agg(F.max("excerpt_hash").alias("h"))
    both = F.array(F.struct(F.col("snapshot_no").alias("n"), F.lit(True).alias("now")), F.struct((F.col("snapshot_no") + 1).alias("n"), F.lit(False).alias("now")))
    p = a.select("path", "h", F.explode(both).alias("x")).groupBy("x.n", "path").agg(F.max(F.when(F.col("x.now"), F.col("h"))).alias("now"), F.max(F.when(~F.col("x.now"), F.col("h"))).alias("was"))
    ends = a.agg(F.min("snapshot_no").alias("low"), F.max("snapshot_no").alias("high")).first()
    p = p.where(~F.col("was").eqNullSafe(F.col("now")) & (F.col("n") > ends["low"]) & (F.col("n") <= ends["high"]))
    return p.select(F.col("n").alias("snapshot_no"), "path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


@register("SET-04_unexpected", "select narrative_id, r from (select distinct narrative_id, unnest(unknown_refs) r from narratives) except select narrative_id, r from (select distinct narrative_id, unnest(cited_refs) r from narratives)")
def set_04(spark, folder):
    n = table(spark, folder, "narratives")
    unknown = n.select("narrative_id", F.explode("unknown_refs").alias("r"))
    return unknown.subtract(n.select("narrative_id", F.explode("cited_refs").alias("r")))


@register("SET-08_union", "select snapshot_no, delivery_no, node_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(licenses, []), coalesce(owners, [])))), ',') as both from atlas_snapshots where node_id is not null group by all")
def set_08(spark, folder):
    a = table(spark, folder, "atlas_snapshots").where("node_id is not null")
    none = F.array().cast("array<string>")
    return a.select("snapshot_no", "delivery_no", "node_id", F.array_join(F.array_sort(F.array_union(F.coalesce("licenses", none), F.coalesce("owners", none))), ",").alias("both")).distinct()


@register("VAL-01_structure", "select flow_id, captured_at, concat_ws(',', case when flow_trigger is null or flow_trigger.type is null then 'trigger' end, case when steps is null or len(steps) = 0 then 'steps' end, case when name is null then 'name' end) as missing from flows where spec_json is null group by all")
def val_01(spark, folder):
    """Required fields that a flow lacks."""
    f = table(spark, folder, "flows").where("spec_json is null")
    missing = F.concat_ws(",", F.when(F.col("flow_trigger.type").isNull(), "trigger"), F.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, "steps"), F.when(F.col("name").isNull(), "name"))
    return f.select("flow_id", "captured_at", missing.alias("missing")).distinct()


@register("VAL-04_cross_refs", f"select r.service, r.flow, array_to_string(list_sort(list(r.kind || '/' || r.name)), ',') as dangling from {REFS} r anti join (select distinct kind, name from {ARTS}) a on r.kind = a.kind and r.name = a.name group by 1, 2")
def val_04(spark, folder):
    """Flows with cross references that no service's registry knows."""
    known = artifacts(spark, folder).select("kind", "name").distinct()
    return refs(spark, folder).join(known, ["kind", "name"], "left_anti").groupBy("service", "flow").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "kind", "name"))), ",").alias("dangling"))


@register("VAL-15_grounded", f"select narrative_id, bool_and(known) as grounded from (select n.narrative_id, a.k is not null as known from (select distinct narrative_id, service, unnest(cited_refs) r from narratives) n left join (select distinct service, kind || '/' || name as k from {ARTS}) a on n.service = a.service and n.r = a.k) group by 1")
def val_15(spark, folder):
    """Whether all that a narrative says it cites is registered."""
    known = artifacts(spark, folder).select("service", F.concat_ws("/", "kind", "name").alias("r")).distinct().withColumn("k", F.lit(True))
    n = table(spark, folder, "narratives").select("narrative_id", "service", F.explode("cited_refs").alias("r")).distinct()
    return n.join(known, ["service", "r"], "left").groupBy("narrative_id").agg(F.bool_and(F.col("k").isNotNull()).alias("grounded"))


@register("JN-02_sole_when_unknown", f"""with c as (select service, name, count(*) over (partition by service) n from (select distinct service, name from {ARTS} where kind = 'ResiliencyPattern')),
f as (select service, name as flow, bool_and(flow_trigger is null) as blind from flows where service is not null group by 1, 2)
select f.service, f.flow, case when bool_or(c.name = f.flow) then f.flow when max(n) = 1 and f.blind then max(c.name) end as matched from f left join c on f.service = c.service group by f.service, f.flow, f.blind""")
def jn_02(spark, folder):
    """As JN-01, but the only candidate counts just where nothing else is known of the flow."""
    candidates = artifacts(spark, folder).where("kind = 'ResiliencyPattern'").select("service", "name").distinct()
    left = table(spark, folder, "flows").where("service is not null").groupBy("service", F.col("name").alias("flow")).agg(F.bool_and(F.col("flow_trigger").isNull()).alias("blind")).withColumn("row_id", F.xxhash64("service", "flow"))
    return sole_or_exact(left, candidates, ["service"], F.col("name") == F.col("flow"), F.col("blind")).select("service", "flow", "matched")


@register("JN-04_last_failure", f"select s.target, max(x.mode) as mode from (select distinct service, flow, target from {SINKS} where type = 'kafka') s join (select service, flow, arg_max(m.mode, (flow_id, pos)) as mode from (select service, flow, flow_id, pos, unnest(s.failureModes) m from {STEPS}) where m is not null and m.surfacedAs = 'logged-and-swallowed' and len(m.mode) > 0 group by 1, 2 having count(distinct (flow_id, pos)) = count(*)) x on s.service = x.service and s.flow = x.flow group by 1")
def jn_04(spark, folder):
    """Channels with the last swallowed failure of the flows that publish to them, where it is the only one of its step."""
    m = flow_steps(spark, folder).select("service", "flow", "flow_id", "pos", F.explode("s.failureModes").alias("m")).where("m is not null and m.surfacedAs = 'logged-and-swallowed' and length(m.mode) > 0")
    place = F.struct("flow_id", "pos")
    last = m.groupBy("service", "flow").agg(F.max_by("m.mode", place).alias("mode"), F.count_distinct(place).alias("d"), F.count("*").alias("n")).where("d = n")
    s = sinks(spark, folder).where("type = 'kafka'").select("service", "flow", "target").distinct()
    return s.join(last, ["service", "flow"]).groupBy("target").agg(F.max("mode").alias("mode"))


@register("AGG-10_gap_validation", f"""with p as (select distinct proposal_id, service, result, {SLUG.format("regexp_replace(trim(alert_ref), '^Alert/', '')")} k from runbook_proposals where trim(alert_ref) <> ''),
j as (select p.*, a.name is not null known from p left join (select distinct service, name from {ARTS} where kind = 'Alert') a on p.service = a.service and p.k = a.name)
select service, count(*) proposed, count(*) filter (result = 'routed') as kept, count(*) filter (known) as grounded, round(count(*) filter (known and result = 'routed')::double / nullif(count(*) filter (result = 'routed'), 0), 4) as kept_precision from j group by 1""")
def agg_10(spark, folder):
    """Per service, proposals, those kept, those whose alert is registered, and the share of kept ones that are."""
    p = table(spark, folder, "runbook_proposals").where("trim(alert_ref) <> ''").select("proposal_id", "service", "result", slug(F.regexp_replace(F.trim("alert_ref"), "^Alert/", "")).alias("name")).distinct()
    known = artifacts(spark, folder).where("kind = 'Alert'").select("service", "name").distinct().withColumn("k", F.lit(True))
    j = p.join(known, ["service", "name"], "left").withColumns({"known": F.col("k").isNotNull(), "kept": F.coalesce(F.col("result") == "routed", F.lit(False))})
    return j.groupBy("service").agg(
        F.count("*").alias("proposed"), F.count_if("kept").alias("kept"), F.count_if("known").alias("grounded"),
        F.round(F.try_divide(F.count_if(F.col("known") & F.col("kept")), F.count_if("kept")), 4).alias("kept_precision"),
    )


@register("AGG-17_security_posture", rf"select project, bool_or(regexp_matches(line, '(?i)authorization')) as sends_credentials, bool_or(regexp_matches(line, '(?i)getenv|environ|process\.env')) as reads_environment, bool_or(regexp_matches(line, 'https://')) as uses_tls from {LINES} where project is not null group by 1")
def agg_17(spark, folder):
    line = F.col("line")
    return file_lines(spark, folder).where("project is not null").groupBy("project").agg(
        F.bool_or(line.rlike("(?i)authorization")).alias("sends_credentials"), F.bool_or(line.rlike(r"(?i)getenv|environ|process\.env")).alias("reads_environment"), F.bool_or(line.contains("https://")).alias("uses_tls")
    )


@register("AGG-20_grouping", "select regexp_extract(service, '-([a-z]+)', 1) as space, count(distinct service) n, array_to_string(list_sort(list(distinct service)), ',') as services from flows where service is not null group by 1")
def agg_20(spark, folder):
    f = table(spark, folder, "flows").where("service is not null")
    return f.groupBy(F.regexp_extract("service", "-([a-z]+)", 1).alias("space")).agg(F.count_distinct("service").alias("n"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"))


@register("WIN-07_coupling_rank", f"""with e as (select distinct src, dst from {CALLS} where src <> dst), n as (select src node, 0 a, 1 e from e union all select dst, 1, 0 from e), c as (select node, sum(a) ca, sum(e) ce from n group by 1)
select node, row_number() over (order by ca desc, ce desc, node) as place from c""")
def win_07(spark, folder):
    """All nodes by what depends on them, then by what they depend on."""
    return global_rank(coupling(calls(spark, folder)), [F.desc("afferent"), F.desc("efferent"), F.col("node")]).select("node", "place")


@register("SCL-14_kill_switch", "select distinct kind, name, regexp_matches(lower(name), 'kill|disable|emergency') as stops from artifacts where name is not null")
def scl_14(spark, folder):
    a = table(spark, folder, "artifacts").where("name is not null").select("kind", "name").distinct()
    return a.select("kind", "name", S.is_kill_switch(F.col("name")).alias("stops"))


# --- flows built from code, manifests and versions ---

_BUILT = f"(select f.*, last_value(case when type = 'rest.endpoint' then line_no end ignore nulls) over (partition by file_id order by line_no, type desc, subject rows between unbounded preceding and current row) as start from {FACT_ROWS} f where type in ('rest.endpoint', 'http.egress', 'db.repository', 'messaging.publish', 'log.statement'))"


@register("DRV-02_flows", f"select file_id, start as endpoint_line, line_no, 's' || row_number() over (partition by file_id, start order by line_no, type, subject) as step, type, subject from {_BUILT} where start is not null and type <> 'rest.endpoint'")
def drv_02(spark, folder):
    """Flows from code: what follows an endpoint up to the next one, as numbered steps (calls, stores, messages, logs)."""
    kinds = ("rest.endpoint", "http.egress", "db.repository", "messaging.publish", "log.statement")
    f = facts(spark, folder).where(F.col("type").isin(*kinds))
    so_far = Window.partitionBy("file_id").orderBy("line_no", F.desc("type"), "subject").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("type") == "rest.endpoint", F.col("line_no")), ignorenulls=True).over(so_far)
    steps = f.withColumn("endpoint_line", start).where("endpoint_line is not null and type <> 'rest.endpoint'")
    n = F.row_number().over(Window.partitionBy("file_id", "endpoint_line").orderBy("line_no", "type", "subject"))
    return steps.select("file_id", "endpoint_line", "line_no", F.concat(F.lit("s"), n).alias("step"), "type", "subject")


@register("JN-03_publishers", """with c as (select service, name, count(*) over (partition by service) n from (select distinct service, name from artifacts where kind = 'Messaging' and name is not null)),
f as (select distinct service, name as flow from flows where service is not null and coalesce(len(steps), 0) >= 0)
select f.service, f.flow, case when bool_or(c.name = f.flow) then f.flow when max(n) = 1 then max(c.name) end as matched from f left join c on f.service = c.service group by 1, 2""")
def jn_03(spark, folder):
    """Flow to publisher: same name first, else the service's only one, whatever else is known of the flow (JN-02 differs)."""
    candidates = artifacts(spark, folder).where("kind = 'Messaging'").select("service", "name").distinct()
    left = table(spark, folder, "flows").where("service is not null").select("service", F.col("name").alias("flow")).distinct().withColumn("row_id", F.xxhash64("service", "flow"))
    return sole_or_exact(left, candidates, ["service"], F.col("name") == F.col("flow")).select("service", "flow", "matched")


@register("JN-25_import_packages", rf"""with i as (select distinct project, regexp_extract(line, '\b(?:copyright|library|lib|import|from|using|require)\b[^A-Za-z]*([a-z]+[a-z0-9-]*)', 1) as name from {LINES} where regexp_matches(line, '^(import|from|using|#|//|/?\*)')),
p as (select distinct project, regexp_extract(name, '^[a-z]+') as name, node from package_licenses where name is not null and node is not null),
own as (select project, name, min(node) o from p group by 1, 2), every as (select name, min(node) a from p group by 1)
select i.project, i.name, coalesce(o, a) as package from i left join own on own.project = i.project and own.name = i.name left join every on every.name = i.name where i.name <> ''""")
def jn_25(spark, folder):
    """Names that imports and head comments mention to packages: one of the same project first, else one of any."""
    spec = r"\b(?:copyright|library|lib|import|from|using|require)\b[^A-Za-z]*([a-z]+[a-z0-9-]*)"
    i = file_lines(spark, folder).where(F.col("line").rlike(r"^(import|from|using|#|//|/?\*)")).select("project", F.regexp_extract("line", spec, 1).alias("name")).where("name <> ''").distinct()
    p = table(spark, folder, "package_licenses").where("name is not null and node is not null").select("project", F.regexp_extract("name", "^[a-z]+", 0).alias("name"), "node")
    return packages_of_imports(i, p)


_PROVEN = ("timeout", "base-url", "password", "enabled", "token")


@register("JN-33_manifest_checks", f"""select project, proof, min(place).relative as proven_by, min(place).line_no as line_no from (select project, k as proof, struct_pack(relative := relative, line_no := line_no) as place
  from {LINES} l join (values {', '.join(f"('{c}')" for c in _PROVEN)}) c(k) on contains(l.line, c.k) where language in ('yaml', 'properties', 'json') and project is not null and relative is not null) group by 1, 2""")
def jn_33(spark, folder):
    """Checks of a project that any of its configuration files proves, with the first line that does."""
    named = F.array_compact(F.array(*[F.when(F.col("line").contains(c), F.lit(c)) for c in _PROVEN]))
    c = file_lines(spark, folder).where(F.col("language").isin("yaml", "properties", "json") & F.col("project").isNotNull() & F.col("relative").isNotNull())
    each = c.select("project", "relative", "line_no", F.explode(named).alias("proof"))
    return each.groupBy("project", "proof").agg(F.min(F.struct("relative", "line_no")).alias("at")).select("project", "proof", F.col("at.relative").alias("proven_by"), "at.line_no")


@register("SET-05_newly_required", f"""with r as (select distinct flow_id, captured_at, kind || '/' || name as ref from (select flow_id, captured_at, unnest(s.refs) x from {STEPS}) t, lateral (select t.x.kind as kind, t.x.name as name, t.x.relation as relation) where kind is not null and name is not null and relation = 'depends-on'),
v as (select flow_id, min(captured_at) a, max(captured_at) b from flows where captured_at is not null and coalesce(len(steps), 0) >= 0 group by 1 having min(captured_at) < max(captured_at))
select n.flow_id, n.ref from (select r.flow_id, ref from r join v on r.flow_id = v.flow_id and r.captured_at = v.b) n anti join (select r.flow_id, ref from r join v on r.flow_id = v.flow_id and r.captured_at = v.a) o on n.flow_id = o.flow_id and n.ref = o.ref""")
def set_05(spark, folder):
    """What the latest version of a flow requires that its first one did not."""
    r = flow_steps(spark, folder).select("flow_id", "captured_at", F.explode("s.refs").alias("x")).where("x.kind is not null and x.name is not null and x.relation = 'depends-on'").select("flow_id", "captured_at", F.concat_ws("/", "x.kind", "x.name").alias("ref")).distinct()
    v = table(spark, folder, "flows").where("captured_at is not null").groupBy("flow_id").agg(F.min("captured_at").alias("a"), F.max("captured_at").alias("b")).where("a < b")
    at = r.join(v, "flow_id")
    return at.where("captured_at = b").select("flow_id", "ref").subtract(at.where("captured_at = a").select("flow_id", "ref"))


@register("GRF-05_reasons", _DOWN_SQL + """ select d.node, min(e.dst) as reason from (select distinct node from down) d join e on e.src = d.node where e.dst not in (select node from n where verified) or e.dst in (select node from down) group by 1""")
def grf_05(spark, folder):
    """Each downgraded flow with the first reference (by name) that isn't verified or was downgraded itself."""
    nodes, edges = dependency_graph(spark, folder)
    fallen = downgraded(nodes, edges)
    sound = nodes.where("verified").select("node").distinct().join(fallen, "node", "left_anti").select(F.col("node").alias("dst"))
    return edges.join(fallen.select(F.col("node").alias("src")), "src", "left_semi").join(sound, "dst", "left_anti").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("reason"))


@register("SCL-37_path_mapping", "select distinct relative, case when starts_with(relative, 'modules/') and ends_with(relative, '.java') then 'src/' || substr(relative, 9, length(relative) - 13) || '/main' end as target from source_files where relative is not null")
def scl_37(spark, folder):
    """Paths under an alias with one *, as its target."""
    f = table(spark, folder, "source_files").where("relative is not null").select("relative").distinct()
    return f.select("relative", S.path_mapping(F.lit("modules/*.java"), F.lit("src/*/main"), F.col("relative")).alias("target"))


@register("SCL-13_interpolated", "select distinct service, kind, name, replace(replace('((kind))/((name)) of ((service)), ((unknown))', '((kind))', kind), '((name))', name) as text from artifacts where service is null and kind is not null and name is not null union select distinct service, kind, name, replace(replace(replace('((kind))/((name)) of ((service)), ((unknown))', '((kind))', kind), '((name))', name), '((service))', service) from artifacts where service is not null and kind is not null and name is not null")
def scl_13(spark, folder):
    """A template with placeholders filled from a row; unknown ones and ones without a value stay."""
    a = table(spark, folder, "artifacts").where("kind is not null and name is not null").select("service", "kind", "name").distinct()
    variables = F.create_map(*[x for c in ("kind", "name", "service") for x in (F.lit(c), F.col(c))])
    return a.select("service", "kind", "name", S.interpolated(F.lit("((kind))/((name)) of ((service)), ((unknown))"), variables).alias("text"))


@register("SCL-30_first_evidence", "select distinct node_id, snapshot_no, delivery_no, case when path is null then coalesce(cast(changes as varchar), '') else concat_ws(':', path, changes) end as at from atlas_snapshots where node_id is not null")
def scl_30(spark, folder):
    a = table(spark, folder, "atlas_snapshots").where("node_id is not null")
    evidence = F.array(F.struct("path", F.col("changes").alias("start")))
    return a.select("node_id", "snapshot_no", "delivery_no", S.first_evidence(evidence).alias("at")).distinct()


@register("SCL-39_canonical_json")
def scl_39(spark, folder):
    """Specs as canonical JSON: equal documents are equal texts."""
    f = table(spark, folder, "flows").where("spec_json is not null")
    return f.select("flow_id", "captured_at", F.md5(S.canonical_json(F.col("spec_json"))).alias("digest")).distinct()

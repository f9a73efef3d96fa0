"""Joins, aggregates, set operations, windows and graphs over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions.text import slug
from lodestrata.operators import graphs, joins, windows
from lodestrata.operators.provenance import provenance_errors
from lodestrata.plans.registering import Register
from lodestrata.plans.scalar_queries import FILES, HOST, LINES, SLUG, STEPS, file_lines, files, flow_steps
from lodestrata.session import cut_lineage
from lodestrata.sources.lines import excerpt_hash
from lodestrata.sources.tables import table

register = Register()
QUERIES, ORACLE = register.queries, register.oracle

# --- relations that several queries start from ---

SINKS = "(select distinct service, name as flow, sinks[i].type as type, sinks[i].target as target from flows, unnest(range(1, len(sinks) + 1)) r(i) where sinks[i] is not null and sinks[i].target is not null)"
REFS = f"(select distinct flow_id, service, flow, r.kind as kind, r.name as name, r.relation as relation from (select *, unnest(s.refs) r from {STEPS}) where r is not null and r.kind is not null and r.name is not null)"
ARTS = "(select distinct service, kind, name, status, recorded_at, retired_at, artifact_id, confidence from artifacts where name is not null and kind is not null)"
#: services that publish a topic call for every service that shares the sink: a graph of services
CALLS = f"(select distinct 'app:' || app as src, 'app:' || dst as dst from (select file_id, max(case when regexp_matches(line, '^  name: ') then trim(substr(line, 9)) end) app from {LINES} where language = 'yaml' group by 1) a join (select file_id, regexp_extract(line, 'base-url: http://([a-z-]+)\\.', 1) dst from {LINES} where language = 'yaml' and contains(line, 'base-url: http')) b using (file_id) where app is not null and dst <> '')"


def sinks(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "flows").select("service", F.col("name").alias("flow"), F.explode("sinks").alias("s"))
    return s.where("s is not null and s.target is not null").select("service", "flow", "s.type", "s.target").distinct()


def refs(spark: SparkSession, folder: str) -> DataFrame:
    r = flow_steps(spark, folder).select("flow_id", "service", "flow", F.explode("s.refs").alias("r"))
    return r.where("r is not null and r.kind is not null and r.name is not null").select("flow_id", "service", "flow", "r.kind", "r.name", "r.relation").distinct()


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "artifacts").where("name is not null and kind is not null")
    return a.select("service", "kind", "name", "status", "recorded_at", "retired_at", "artifact_id", "confidence").distinct()


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from the application a configuration names to the hosts its clients call."""
    y = file_lines(spark, folder).where("language = 'yaml'")
    app = y.where(F.col("line").startswith("  name: ")).groupBy("file_id").agg(F.max(F.trim(F.substring("line", 9, 200))).alias("app"))
    dst = y.where(F.col("line").contains("base-url: http")).select("file_id", F.regexp_extract("line", r"base-url: http://([a-z-]+)\.", 1).alias("dst")).where("dst <> ''")
    return app.join(dst, "file_id").select(F.concat(F.lit("app:"), "app").alias("src"), F.concat(F.lit("app:"), "dst").alias("dst")).distinct()


# --- joins ---


@register("JN-01_sole_or_exact", f"""with c as (select service, name, count(*) over (partition by service) n from (select distinct service, name from artifacts where kind = 'Fallback' and name is not null)),
f as (select distinct service, name as flow from flows where service is not null)
select f.service, f.flow, case when bool_or(c.name = f.flow) then f.flow when max(n) = 1 then max(c.name) end as matched from f left join c on f.service = c.service group by 1, 2""")
def jn_01(spark, folder):
    """Flow to fallback: same name first, else the service's only one (the same rule serves breakers, stores and publishers)."""
    candidates = artifacts(spark, folder).where("kind = 'Fallback'").select("service", "name").distinct()
    left = table(spark, folder, "flows").where("service is not null").select("service", F.col("name").alias("flow")).distinct().withColumn("row_id", F.xxhash64("service", "flow"))
    return joins.sole_or_exact(left, candidates, ["service"], F.col("name") == F.col("flow")).select("service", "flow", "matched")


@register("JN-06_enclosing", rf"""with l as (select file_id, line_no, line from {LINES} where language = 'python'),
d as (select *, case when regexp_matches(line, '^\s*def \w+') then regexp_extract(line, '^\s*def (\w+)', 1) end as def_name from l)
select file_id, line_no, last_value(def_name ignore nulls) over (partition by file_id order by line_no rows between unbounded preceding and current row) as enclosing from d qualify contains(line, 'log.')""")
def jn_06(spark, folder):
    """Log calls with the function they stand in."""
    py = file_lines(spark, folder).where("language = 'python'")
    starts = py.select("file_id", "line_no", F.regexp_extract("line", r"^\s*def (\w+)", 1).alias("name")).where("name <> ''")
    points = py.where(F.col("line").contains("log.")).select("file_id", "line_no", (F.col("line_no").cast("bigint")).alias("point_id"))
    return joins.enclosing(points, starts, ["file_id"], "line_no", "name").select("file_id", "line_no", "enclosing")


_DETECTED = rf"(select distinct 'POST' as method, regexp_extract(line, '@PostMapping\(\"([^\"]*)\"', 1) as path from {LINES} where contains(line, '@PostMapping('))"
_DECLARED = "(select distinct flow_trigger.method as method, flow_trigger.path as path from flows where flow_trigger.method is not null and flow_trigger.path is not null)"


@register("JN-07_documented", f"select coalesce(a.method, b.method) as method, coalesce(a.path, b.path) as path, case when b.path is null then 'undocumented' when a.path is null then 'spec-only' else 'documented' end as state from {_DETECTED} a full join {_DECLARED} b on a.method = b.method and a.path = b.path")
def jn_07(spark, folder):
    """Endpoints found in code against those that flows declare."""
    found = file_lines(spark, folder).where(F.col("line").contains("@PostMapping(")).select(F.lit("POST").alias("method"), F.regexp_extract("line", r'@PostMapping\("([^"]*)"', 1).alias("path")).distinct().withColumn("here", F.lit(True))
    declared = table(spark, folder, "flows").where("flow_trigger.method is not null and flow_trigger.path is not null").select("flow_trigger.method", "flow_trigger.path").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("there").isNull(), "undocumented").when(F.col("here").isNull(), "spec-only").otherwise("documented")
    return found.join(declared, ["method", "path"], "full").select("method", "path", state.alias("state"))


def _ops(side: str) -> str:
    return f"(select flow_trigger.path as path, list_sort(list_distinct(list(flow_trigger.method))) as methods from flows where flow_trigger.path is not null and flow_trigger.method is not null and captured_at {side} timestamp '2024-09-01' group by 1)"


@register("JN-08_contract_change", f"select path, array_to_string(case when a.methods is null then b.methods else list_filter(b.methods, lambda m: not list_contains(a.methods, m)) end, ',') as new_methods, case when a.methods is null then 'added' when b.methods is null then 'removed' when len(list_filter(a.methods, lambda m: not list_contains(b.methods, m))) > 0 then 'narrowed' when a.methods <> b.methods then 'widened' else 'same' end as change from {_ops('<')} a full join {_ops('>=')} b using (path)")
def jn_08(spark, folder):
    """Operations of a path before and after a date: removed, added, narrowed or widened."""
    f = table(spark, folder, "flows").where("flow_trigger.path is not null and flow_trigger.method is not null")
    cut = F.lit("2024-09-01").cast("timestamp_ntz")
    ops = lambda when, name: f.where(when).groupBy(F.col("flow_trigger.path").alias("path")).agg(F.array_sort(F.collect_set("flow_trigger.method")).alias(name))
    both = ops(F.col("captured_at") < cut, "a").join(ops(F.col("captured_at") >= cut, "b"), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(F.array_except("a", "b")) > 0, "narrowed").when(F.col("a") != F.col("b"), "widened").otherwise("same")
    fresh = F.when(F.col("a").isNull(), F.col("b")).otherwise(F.array_except("b", "a"))
    return both.select("path", F.array_join(fresh, ",").alias("new_methods"), change.alias("change"))


@register("JN-10_host_owner", f"select host, arg_max(project, (file_id, line_no)) as owner, count(distinct project) n_projects from (select project, file_id, line_no, {HOST.format('u')} as host from (select project, file_id, line_no, unnest(regexp_extract_all(line, '[a-z]+://[^\\s\"'']+')) u from {LINES})) where host <> '' group by 1")
def jn_10(spark, folder):
    """Owner of each host: where several claim it, the one whose claim comes last by file and line."""
    u = file_lines(spark, folder).select("project", "file_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"[a-z]+://[^\s\"']+"), F.lit(0))).alias("u"))
    return u.select("project", "file_id", "line_no", S.url_host(F.col("u")).alias("host")).where("host <> ''").groupBy("host").agg(F.max_by("project", F.struct("file_id", "line_no")).alias("owner"), F.count_distinct("project").alias("n_projects"))


@register("JN-11_calls", f"select src, dst from {CALLS} where src <> dst")
def jn_11(spark, folder):
    return calls(spark, folder).where("src <> dst")


@register("JN-12_unresolved_calls", f"select distinct src, dst from {CALLS} where dst not in (select src from {CALLS})")
def jn_12(spark, folder):
    """Calls to hosts that no configuration names as its application."""
    c = calls(spark, folder)
    return c.join(c.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


@register("JN-13_topics", f"select a.target as topic, a.service as producer, b.service as consumer from (select distinct service, target from {SINKS} where type = 'kafka') a join (select distinct service, target from {SINKS} where type = 'cache') b using (target) where a.service <> b.service")
def jn_13(spark, folder):
    """Producers and consumers of the same channel."""
    s = sinks(spark, folder)
    a = s.where("type = 'kafka'").select(F.col("target").alias("topic"), F.col("service").alias("producer")).distinct()
    b = s.where("type = 'cache'").select(F.col("target").alias("topic"), F.col("service").alias("consumer")).distinct()
    return a.join(b, "topic").where("producer <> consumer")


@register("JN-14_internal_libraries", "select distinct project, name from package_licenses where regexp_matches(name, '^(hashlet|quickbus)-.*$') or regexp_matches(name, '^.*-quota.*$')")
def jn_14(spark, folder):
    """Packages under an allowlist of globs: the globs become one pattern, so no pair of rows is compared."""
    return table(spark, folder, "package_licenses").where(F.col("name").rlike("^(hashlet|quickbus)-.*$|^.*-quota.*$")).select("project", "name").distinct()


@register("JN-15_co_tenancy", f"select type, target, count(distinct service) n_services, array_to_string(list_sort(list(distinct service)), ',') as services from {SINKS} group by 1, 2 having count(distinct service) >= 2")
def jn_15(spark, folder):
    """Resources that several services share."""
    return sinks(spark, folder).groupBy("type", "target").agg(F.collect_set("service").alias("s")).where("size(s) >= 2").select("type", "target", F.size("s").cast("bigint").alias("n_services"), F.array_join(F.array_sort("s"), ",").alias("services"))


@register("JN-16_impacted_flows", f"select a.service, a.name as resource, s.flow from (select distinct service, name from {ARTS} where kind = 'Dependency') a join {SINKS} s on a.service = s.service and {SLUG.format('a.name')} = {SLUG.format('s.target')} group by all union select s.service, d.name, s.flow from {SINKS} s join (select service, max(name) as name from (select distinct service, name from {ARTS} where kind = 'Dependency') group by 1 having count(*) = 1) d using (service) where s.type = 'db'")
def jn_16(spark, folder):
    """Flows that hit a resource: by name, or as any store sink where the service has one dependency only."""
    deps = artifacts(spark, folder).where("kind = 'Dependency'").select("service", "name").distinct()
    s = sinks(spark, folder)
    named = deps.withColumn("k", slug(F.col("name"))).join(s.withColumn("k", slug(F.col("target"))), ["service", "k"]).select("service", F.col("name").alias("resource"), "flow")
    sole = deps.groupBy("service").agg(F.count("*").alias("n"), F.max("name").alias("resource")).where("n = 1")
    kind = s.where("type = 'db'").join(sole, "service").select("service", "resource", "flow")
    return named.unionByName(kind).distinct()


@register("JN-18_path_hits", r"select distinct p.path, u.url from (select distinct regexp_replace(flow_trigger.path, '/[^/]+$', '/{}') as path from flows where flow_trigger.path is not null) p join (select distinct flow_trigger.path as url from flows where flow_trigger.path is not null) u on len(string_split(p.path, '/')) = len(string_split(u.url, '/')) and regexp_replace(u.url, '/[^/]+$', '') = regexp_replace(p.path, '/[^/]+$', '')")
def jn_18(spark, folder):
    """Changed path templates against the paths in use."""
    # both sides of both joins start from the distinct paths, so they are read from the flows once
    paths = cut_lineage(table(spark, folder, "flows").where("flow_trigger.path is not null").select(F.col("flow_trigger.path").alias("url")).distinct())
    return joins.path_template_match(paths.select(F.regexp_replace("url", "/[^/]+$", "/{}").alias("path")), paths)


@register("JN-20_failure_by_sink", "select flow_id, captured_at, cast(i as int) pos, steps[i].name as step, sinks[i].target as target from (select distinct flow_id, captured_at, steps, sinks from flows where len(steps) = len(sinks)), unnest(range(1, len(steps) + 1)) r(i) where steps[i] is not null and sinks[i] is not null")
def jn_20(spark, folder):
    """Steps joined to sinks by place, where a flow has as many of either."""
    f = table(spark, folder, "flows").where("size(steps) = size(sinks) and size(steps) > 0").select("flow_id", "captured_at", "steps", "sinks").distinct()
    one = f.select("flow_id", "captured_at", F.posexplode(F.arrays_zip("steps", "sinks")).alias("at", "z")).where("z.steps is not null and z.sinks is not null")
    return one.select("flow_id", "captured_at", (F.col("at") + 1).alias("pos"), F.col("z.steps.name").alias("step"), F.col("z.sinks.target").alias("target"))


@register("JN-21_dangling_refs", f"select r.* from {REFS} r anti join {ARTS} a on r.service = a.service and r.kind = a.kind and r.name = a.name")
def jn_21(spark, folder):
    return refs(spark, folder).join(artifacts(spark, folder).select("service", "kind", "name").distinct(), ["service", "kind", "name"], "left_anti").select("flow_id", "service", "flow", "kind", "name", "relation")


@register("JN-22_claims_by_tier", f"select kind, name, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'needs-review') as in_review from {ARTS} group by 1, 2 having count(distinct status) > 1")
def jn_22(spark, folder):
    """Artifacts that stand in both tiers."""
    return artifacts(spark, folder).groupBy("kind", "name").agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "needs-review").alias("in_review"), F.count_distinct("status").alias("n")).where("n > 1").drop("n")


_PACKAGES = rf"(select distinct regexp_extract(line, '^package ([\w.]+);', 1) as pkg from {LINES} where language = 'java' and regexp_matches(line, '^package [\w.]+;'))"


@register("JN-23_longest_prefix", f"""with s as (select distinct flow_trigger.entrypoint as symbol from flows where flow_trigger.entrypoint is not null), p as (select pkg from {_PACKAGES} union select 'com')
select symbol, arg_max(pkg, length(pkg)) as resolved from s left join p on symbol = pkg or starts_with(symbol, pkg || '.') group by 1""")
def jn_23(spark, folder):
    """Entry points to the longest package that holds them."""
    symbols = table(spark, folder, "flows").select(F.col("flow_trigger.entrypoint").alias("symbol")).where("symbol is not null").distinct()
    packages = file_lines(spark, folder).where("language = 'java'").select(F.regexp_extract("line", r"^package ([\w.]+);", 1).alias("pkg")).where("pkg <> ''").distinct().union(spark.range(1).select(F.lit("com")))
    return joins.longest_prefix(symbols, "symbol", packages, "pkg")


_TAILS = "(select distinct regexp_replace(relative, '^[^/]*/', '') as path from source_files where relative is not null)"


@register("JN-26_suffix", f"select a.path, max(f.relative) as relative from {_TAILS} a join (select distinct relative from source_files where relative is not null) f on regexp_extract(a.path, '[^/]*$') = regexp_extract(f.relative, '[^/]*$') and (f.relative = a.path or ends_with(f.relative, '/' || a.path)) group by 1 having count(*) = 1")
def jn_26(spark, folder):
    """Report paths without their root to files, by base name and then by suffix; only where exactly one fits."""
    base = lambda c: F.substring_index(c, "/", -1)
    f = table(spark, folder, "source_files").where("relative is not null").select("relative").distinct().withColumn("b", base("relative"))
    a = f.select(F.regexp_replace("relative", "^[^/]*/", "").alias("path")).distinct().withColumn("b", base("path"))
    fits = (F.col("relative") == F.col("path")) | F.endswith(F.col("relative"), F.concat(F.lit("/"), "path"))
    return a.join(f, "b").where(fits).groupBy("path").agg(F.max("relative").alias("relative"), F.count("*").alias("n")).where("n = 1").drop("n")


@register("JN-27_last_rule", "select file_id, arg_max(owner, prio) as owner from (select distinct file_id, relative from source_files where relative is not null) f join (values (1, '', 'team-all'), (2, 'modules/', 'team-modules'), (3, 'tests/', 'team-tests')) r(prio, part, owner) on starts_with(relative, part) or contains(relative, '/' || part) group by 1")
def jn_27(spark, folder):
    """Ownership rules, the last that matches wins: ordered rules compile to one CASE, last first."""
    f = table(spark, folder, "source_files").where("relative is not null").select("file_id", "relative").distinct()
    hit = lambda part: F.col("relative").startswith(part) | F.col("relative").contains("/" + part)
    return f.select("file_id", F.when(hit("tests/"), "team-tests").when(hit("modules/"), "team-modules").otherwise("team-all").alias("owner"))


@register("JN-28_line_runs", rf"""with l as (select file_id, line_no, trim(line) t, lead(trim(line)) over (partition by file_id order by line_no) t2 from {LINES}),
r as (select file_id, line_no, md5(t || chr(10) || t2) as run from l where t <> '' and t2 <> ''), c as (select run, count(*) n_places, count(distinct file_id) n_files from r group by 1)
select r.file_id, r.line_no, r.run, c.n_places, c.n_files from r join c using (run) where r.file_id % 20 = 0""")
def jn_28(spark, folder):
    """Each two-line run of every twentieth file (the stated query set) with its class and how often that stands in all files."""
    return joins.line_run_classes(files(spark, folder), F.col("file_id") % 20 == 0)


@register("JN-31_alert_refs", f"select distinct proposal_id, a.name is not null as known from (select distinct proposal_id, service, {SLUG.format(chr(39).join(['regexp_replace(trim(alert_ref), ', '^Alert/', ', ', '', ')']))} k from runbook_proposals where trim(alert_ref) <> '') p left join (select distinct service, name from {ARTS} where kind = 'Alert') a on p.service = a.service and p.k = a.name")
def jn_31(spark, folder):
    """Whether a proposal's alert is registered at all."""
    p = table(spark, folder, "runbook_proposals").where("trim(alert_ref) <> ''").select("proposal_id", "service", slug(F.regexp_replace(F.trim("alert_ref"), "^Alert/", "")).alias("name")).distinct()
    a = artifacts(spark, folder).where("kind = 'Alert'").select("service", "name").distinct().withColumn("known", F.lit(True))
    return p.join(a, ["service", "name"], "left").select("proposal_id", F.coalesce("known", F.lit(False)).alias("known")).distinct()


@register("JN-34_latest_verdict", "select service, alert_ref, result, drafted_at from (select distinct service, alert_ref, result, drafted_at, proposal_id from runbook_proposals where alert_ref is not null) qualify row_number() over (partition by service, alert_ref order by drafted_at desc, proposal_id desc) = 1")
def jn_34(spark, folder):
    """The latest outcome per alert."""
    p = table(spark, folder, "runbook_proposals").where("alert_ref is not null").select("service", "alert_ref", "result", "drafted_at", "proposal_id").distinct()
    return p.groupBy("service", "alert_ref").agg(F.max_by(F.struct("result", "drafted_at"), F.struct("drafted_at", "proposal_id")).alias("v")).select("service", "alert_ref", "v.result", "v.drafted_at")


@register("JN-35_central_version", "select record_id, coalesce(version, c) as version from (select distinct record_id, ecosystem, name, version from package_licenses) left join (select ecosystem, name, max(version) c from package_licenses group by 1, 2) using (ecosystem, name)")
def jn_35(spark, folder):
    """A record's version, else its package's central one."""
    p = table(spark, folder, "package_licenses")
    central = p.groupBy("ecosystem", "name").agg(F.max("version").alias("c"))
    return p.select("record_id", "ecosystem", "name", "version").distinct().join(central, ["ecosystem", "name"], "left").select("record_id", F.coalesce("version", "c").alias("version"))


# --- aggregates ---


@register("AGG-01_version_skew", "select ecosystem, regexp_extract(name, '^[a-z]+') as library, count(distinct version) n_versions, count(distinct project) n_projects, array_to_string(list_sort(list(distinct version)), ',') as versions from package_licenses where version is not null group by 1, 2 having count(distinct version) >= 2 and count(distinct project) >= 2")
def agg_01(spark, folder):
    """Library families that projects pin at different versions."""
    p = table(spark, folder, "package_licenses").where("version is not null").groupBy("ecosystem", F.regexp_extract("name", "^[a-z]+", 0).alias("library")).agg(F.collect_set("version").alias("v"), F.count_distinct("project").alias("n_projects"))
    return p.where("size(v) >= 2 and n_projects >= 2").select("ecosystem", "library", F.size("v").cast("bigint").alias("n_versions"), "n_projects", F.array_join(F.array_sort("v"), ",").alias("versions"))


_LOG = rf"(select project, lower(regexp_replace(regexp_extract(line, '\b_?log(?:ger)?\.([A-Za-z]+)\(', 1), '(?i)^log', '')) as level, regexp_matches(line, '\{{|%[sv]') as parameterized from {LINES} where regexp_matches(line, '\b_?log(?:ger)?\.([A-Za-z]+)\('))"


def _log_calls(spark: SparkSession, folder: str) -> DataFrame:
    m = file_lines(spark, folder).withColumn("m", F.regexp_extract("line", r"\b_?log(?:ger)?\.([A-Za-z]+)\(", 1)).where("m <> ''")
    return m.select("project", S.log_level(F.col("m")).alias("level"), F.col("line").rlike(r"\{|%[sv]").alias("parameterized"))


@register("AGG-02_log_levels", f"select project, count(*) filter (level = 'info' or level = 'information') as info, count(*) filter (level like 'warn%') as warn, count(*) filter (parameterized) as parameterized, count(*) n from {_LOG} group by 1")
def agg_02(spark, folder):
    level = F.col("level")
    return _log_calls(spark, folder).groupBy("project").agg(F.count_if(level.isin("info", "information")).alias("info"), F.count_if(level.startswith("warn")).alias("warn"), F.count_if("parameterized").alias("parameterized"), F.count("*").alias("n"))


@register("AGG-03_log_quality", f"select project, round(count(*) filter (parameterized)::double / count(*), 4) as placeholder_ratio, case when count(*) filter (level like 'warn%') > 0.5 * count(*) then 'noisy' else 'calm' end as signal from {_LOG} group by 1")
def agg_03(spark, folder):
    n, warn = F.count("*"), F.count_if(F.col("level").startswith("warn"))
    return _log_calls(spark, folder).groupBy("project").agg(F.round(F.try_divide(F.count_if("parameterized"), n), 4).alias("placeholder_ratio"), F.when(warn > 0.5 * n, "noisy").otherwise("calm").alias("signal"))


_KINDS = {"Fallback": "fallback-defined", "ResiliencyPattern": "circuit-breaker-on-egress", "SloSli": "slo-target-defined", "Dashboard": "metrics-exposed", "Dependency": "dependencies-known", "ScheduledJob": "jobs-known"}
_READY_SQL = f"""with a as (select service, {", ".join(f"bool_or(kind = '{k}') as \"{c}\"" for k, c in _KINDS.items())},
  bool_or(kind = 'Alert' and status = 'verified' and contains(name, 'burn')) as "burn-rate-alert", bool_or(kind = 'Alert' and status = 'verified') as "alert-for-top-flow", bool_or(kind = 'Runbook' and status = 'verified') as "runbook-for-top-flow"
  from {ARTS} where service is not null group by 1),
f as (select service, bool_or(slo_ref is not null) as "flow-with-slo", not bool_or(len(list_filter(coalesce(steps, []), lambda s: len(list_filter(coalesce(s.failureModes, []), lambda m: m.surfacedAs = 'logged-and-swallowed')) > 0)) > 0) as "no-swallowed-failure" from flows where service is not null group by 1),
j as (select a.*, coalesce("flow-with-slo", false) as "flow-with-slo", coalesce("no-swallowed-failure", false) as "no-swallowed-failure" from a left join f using (service))
select service, passed, round(passed / 11.0, 2)::double as score, case when round(passed / 11.0, 2) >= 0.9 then 'A' when round(passed / 11.0, 2) >= 0.75 then 'B' when round(passed / 11.0, 2) >= 0.6 then 'C' when round(passed / 11.0, 2) >= 0.4 then 'D' else 'F' end as grade, gaps
from (select service, {{0}} as passed, concat_ws(',', {{1}}) as gaps from j)"""
_ALL_CHECKS = [*_KINDS.values(), "burn-rate-alert", "alert-for-top-flow", "runbook-for-top-flow", "flow-with-slo", "no-swallowed-failure"]


@register("AGG-04_readiness", _READY_SQL.format(" + ".join(f'cast(coalesce("{c}", false) as int)' for c in _ALL_CHECKS), ", ".join(f"case when not coalesce(\"{c}\", false) then '{c}' end" for c in _ALL_CHECKS)))
def agg_04(spark, folder):
    """Eleven readiness checks of a service: score, grade and gaps. Alerts and runbooks count only where they are verified."""
    kind, verified = F.col("kind"), F.coalesce(F.col("status") == "verified", F.lit(False))
    flags = {c: F.bool_or(kind == k) for k, c in _KINDS.items()}
    flags |= {"burn-rate-alert": F.bool_or((kind == "Alert") & verified & F.col("name").contains("burn")), "alert-for-top-flow": F.bool_or((kind == "Alert") & verified), "runbook-for-top-flow": F.bool_or((kind == "Runbook") & verified)}
    a = artifacts(spark, folder).where("service is not null").groupBy("service").agg(*[f.alias(c) for c, f in flags.items()])
    swallowed = F.exists("steps", lambda s: F.coalesce(F.exists(s["failureModes"], lambda m: F.coalesce(m["surfacedAs"] == "logged-and-swallowed", F.lit(False))), F.lit(False)))
    f = table(spark, folder, "flows").where("service is not null").groupBy("service").agg(F.bool_or(F.col("slo_ref").isNotNull()).alias("flow-with-slo"), (~F.bool_or(F.coalesce(swallowed, F.lit(False)))).alias("no-swallowed-failure"))
    return S.readiness(a.join(f, "service", "left"), "service", _ALL_CHECKS)


@register("AGG-05_blast_radius", f"select type, target, count(distinct service || '/' || flow) n_flows from {SINKS} group by 1, 2")
def agg_05(spark, folder):
    return sinks(spark, folder).groupBy("type", "target").agg(F.count_distinct(F.concat_ws("/", "service", "flow")).alias("n_flows"))


@register("AGG-06_coverage", f"""with u as (select f.relative, f.ext from (select distinct relative, lower(regexp_extract(relative, '[^.]*$')) ext from source_files where relative is not null) f anti join (select distinct path from atlas_snapshots where path is not null) a on f.relative = a.path)
select ext, n, array_to_string(samples, ',') as samples from (select ext, count(*) n, (list(relative order by relative))[1:3] as samples from u group by 1) order by n desc, ext limit 25""")
def agg_06(spark, folder):
    """Uncovered files by extension, the 25 largest groups with three samples each (the report's size)."""
    f = table(spark, folder, "source_files").where("relative is not null").select("relative").distinct()
    covered = table(spark, folder, "atlas_snapshots").where("path is not null").select(F.col("path").alias("relative")).distinct()
    u = f.join(covered, "relative", "left_anti").withColumn("ext", F.lower(F.substring_index("relative", ".", -1)))
    ranked = u.withColumn("r", F.row_number().over(Window.partitionBy("ext").orderBy("relative")))
    samples = ranked.where("r <= 3").groupBy("ext").agg(F.array_join(F.array_sort(F.collect_list("relative")), ",").alias("samples"))
    return u.groupBy("ext").agg(F.count("*").alias("n")).join(samples, "ext").select("ext", "n", "samples").orderBy(F.desc("n"), "ext").limit(25)


@register("AGG-07_by_status", f"select kind, coalesce(status, '-') as status, count(*) n from {ARTS} group by 1, 2")
def agg_07(spark, folder):
    return artifacts(spark, folder).groupBy("kind", F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"))


@register("AGG-08_coupling", f"""with e as (select distinct src, dst from {CALLS} where src <> dst), n as (select src node, 0 a, 1 e from e union all select dst, 1, 0 from e)
select node, sum(a) afferent, sum(e) efferent, round(sum(e)::double / (sum(a) + sum(e)), 6) as instability from n group by 1""")
def agg_08(spark, folder):
    return graphs.coupling(calls(spark, folder))


@register("AGG-09_scorecard", """with p as (select distinct narrative_id, unnest(cited_refs) r from narratives where cited_refs is not null),
t as (select distinct narrative_id, unnest(regexp_extract_all(body, '\\b[A-Z][A-Za-z0-9]+/[A-Za-z0-9](?:[\\w.-]*[A-Za-z0-9])?')) r from narratives where body is not null),
j as (select coalesce(p.narrative_id, t.narrative_id) id, p.r is not null a, t.r is not null b, split_part(coalesce(p.r, t.r), '/', 1) kind from p full join t on p.narrative_id = t.narrative_id and p.r = t.r)
select kind, count(*) filter (a and b) matched, count(*) filter (b and not a) missed, count(*) filter (a and not b) unexpected, round(count(*) filter (a and b)::double / nullif(count(*) filter (a), 0), 4) as prec, round(count(*) filter (a and b)::double / nullif(count(*) filter (b), 0), 4) as recall from j group by 1""")
def agg_09(spark, folder):
    """What the tool wrote down as cited against what the prose cites, by kind."""
    n = table(spark, folder, "narratives")
    p = n.select("narrative_id", F.explode("cited_refs").alias("r")).distinct().withColumn("a", F.lit(True))
    cited = F.regexp_extract_all("body", F.lit(r"\b[A-Z][A-Za-z0-9]+/[A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?"), F.lit(0))
    t = n.where("body is not null").select("narrative_id", F.explode(cited).alias("r")).distinct().withColumn("b", F.lit(True))
    j = p.join(t, ["narrative_id", "r"], "full").fillna(False, ["a", "b"]).withColumn("kind", F.substring_index("r", "/", 1))
    hit = F.count_if(F.col("a") & F.col("b"))
    return j.groupBy("kind").agg(
        hit.alias("matched"), F.count_if(F.col("b") & ~F.col("a")).alias("missed"), F.count_if(F.col("a") & ~F.col("b")).alias("unexpected"),
        F.round(F.try_divide(hit, F.count_if("a")), 4).alias("prec"), F.round(F.try_divide(hit, F.count_if("b")), 4).alias("recall"),
    )


@register("AGG-11_budget", rf"""with b as (select project, max(try_cast(regexp_extract(line, 'timeout-ms\s*[=:]\s*(\d+)\s*$', 1) as bigint)) as budget from {LINES} where language = 'properties' and project is not null and regexp_matches(line, 'timeout-ms\s*[=:]\s*\d+\s*$') group by 1),
t as (select project, file_id, line_no, try_cast(regexp_extract(line, 'timeout: (\d+)(ms|s)$', 1) as bigint) * case regexp_extract(line, 'timeout: (\d+)(ms|s)$', 2) when 's' then 1000 else 1 end as ms from {LINES} where language = 'yaml' and regexp_matches(line, 'timeout: \d+(ms|s)$'))
select t.project, file_id, line_no, ms, budget from t join b using (project) where ms > budget""")
def agg_11(spark, folder):
    """Client timeouts beyond the project's budget, the largest of the limits it states."""
    lines_ = file_lines(spark, folder)
    limit = F.try_to_number(F.regexp_extract("line", r"timeout-ms\s*[=:]\s*(\d{1,12})\s*$", 1), F.lit("999999999999")).cast("bigint")
    budget = lines_.where("language = 'properties' and project is not null").select("project", limit.alias("ms")).where("ms is not null").groupBy("project").agg(F.max("ms").alias("budget"))
    t = lines_.where("language = 'yaml'").select("project", "file_id", "line_no", S.duration_ms(F.regexp_extract("line", r"timeout: (\d+(?:ms|s))$", 1)).alias("ms")).where("ms is not null")
    return t.join(budget, "project").where("ms > budget").select("project", "file_id", "line_no", "ms", "budget")


_CLASSES = " union all ".join(f"select '{c}' as class, project, relative, line_no from {LINES} where regexp_matches(line, '{p}')" for c, p in (("pci", r"(?i)\bcard[_-]?(?:number|holder)\b|\bcredit[_-]?card\b|\bcvv\b|\bcvc\b|\bpan\b"), ("pii", r"(?i)\bemail\b|\bssn\b|\bsocial[_-]?security\b|\bpassport\b|\bdate[_-]?of[_-]?birth\b|\bdob\b|\bphone[_-]?number\b|\btax[_-]?id\b")))
_TIMED = f"select 'internal' as class, project, relative, line_no from {LINES} where regexp_matches(line, '(?i)\\b(account|invoice|payment)s?\\b')"


@register("AGG-12_first_hit", f"select class, project, relative, line_no from (select class, project, relative, line_no, row_number() over (partition by class, project order by relative, line_no) r from ({_CLASSES} union all {_TIMED})) where r = 1")
def agg_12(spark, folder):
    """First line of a project for each data class, in order of file and line; business words make the class `internal`."""
    classes = S.DATA_CLASSES | {"internal": r"(?i)\b(account|invoice|payment)s?\b"}
    each = file_lines(spark, folder).select("project", "relative", "line_no", F.explode(S.named_hits(F.col("line"), classes)).alias("class"))
    return each.groupBy("class", "project").agg(F.min(F.struct("relative", "line_no")).alias("at")).select("class", "project", "at.relative", "at.line_no")


@register("AGG-13_prefer_known", "select ecosystem, name, status from package_licenses qualify row_number() over (partition by ecosystem, name order by status is null, record_id, imported_at) = 1")
def agg_13(spark, folder):
    """One record per package, one with a status before one without."""
    p = table(spark, folder, "package_licenses")
    return p.groupBy("ecosystem", "name").agg(F.min_by(F.struct("status"), F.struct(F.col("status").isNull(), "record_id", "imported_at")).alias("v")).select("ecosystem", "name", "v.status")


@register("AGG-15_architecture", f"select project, count(distinct dir) n_dirs, array_to_string(list_sort(list(distinct language)), ',') as languages from (select project, language, regexp_replace(relative, '/[^/]*$', '') dir from {FILES}) where project is not null group by 1")
def agg_15(spark, folder):
    f = files(spark, folder).where("project is not null").withColumn("dir", F.regexp_replace("relative", "/[^/]*$", ""))
    return f.groupBy("project").agg(F.count_distinct("dir").alias("n_dirs"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@register("AGG-21_edge_first", f"select service, kind, name, arg_min(relation, flow_id) as relation, min(flow_id) as flow_id from (select service, kind, name, relation, flow_id, row_number() over (partition by service, kind, name order by flow_id, relation) r from {REFS}) where r = 1 group by 1, 2, 3")
def agg_21(spark, folder):
    """Edges without repeats, the first one winning."""
    return refs(spark, folder).groupBy("service", "kind", "name").agg(F.min(F.struct("flow_id", "relation")).alias("v")).select("service", "kind", "name", "v.relation", "v.flow_id")


@register("AGG-22_evidence_merge", "select node_id, array_to_string(list_sort(list(distinct path || '#' || excerpt_hash)), ';') as evidence from atlas_snapshots where node_id is not null and path is not null and excerpt_hash is not null group by 1")
def agg_22(spark, folder):
    a = table(spark, folder, "atlas_snapshots").where("node_id is not null and path is not null and excerpt_hash is not null")
    return a.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("#", "path", "excerpt_hash"))), ";").alias("evidence"))


@register("AGG-23_node_merge", "select node_id, array_to_string(list_sort(list_distinct(flatten(list(owners)))), ',') as owners, arg_min(version, (snapshot_no, delivery_no)) filter (version is not null) as version from atlas_snapshots where node_id is not null group by 1")
def agg_23(spark, folder):
    """Nodes merged over all deliveries: owners united, the first known version kept."""
    a = table(spark, folder, "atlas_snapshots").where("node_id is not null")
    owners = F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners"))))
    known = F.min_by("version", F.when(F.col("version").isNotNull(), F.struct("snapshot_no", "delivery_no")))
    return a.groupBy("node_id").agg(F.array_join(owners, ",").alias("owners"), known.alias("version"))


@register("AGG-24_edge_or", f"select service, kind, bool_or(name not in (select name from {ARTS})) as unresolved, count(*) n from {REFS} group by 1, 2")
def agg_24(spark, folder):
    known = artifacts(spark, folder).select("name").distinct().withColumn("k", F.lit(True))
    return refs(spark, folder).join(known, "name", "left").groupBy("service", "kind").agg(F.bool_or(F.col("k").isNull()).alias("unresolved"), F.count("*").alias("n"))


@register("AGG-25_licence_inventory", "select node, source, array_to_string(licenses, ',') as licenses from package_licenses where node is not null and licenses is not null qualify row_number() over (partition by node order by source <> 'source-import', imported_at, record_id) = 1")
def agg_25(spark, folder):
    """One licence record per node, an imported one first."""
    p = table(spark, folder, "package_licenses").where("node is not null and licenses is not null")
    best = F.min_by(F.struct("source", "licenses"), F.struct(F.col("source") != "source-import", "imported_at", "record_id"))
    return p.groupBy("node").agg(best.alias("v")).select("node", "v.source", F.array_join("v.licenses", ",").alias("licenses"))


@register("AGG-26_group_edges", "select c.c_nationkey as src, s.s_nationkey as dst, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer c on o_custkey = c_custkey join supplier s on l_suppkey = s_suppkey group by 1, 2")
def agg_26(spark, folder):
    """Trade between nations as weighted edges: the fact table is reduced by order and supplier before it meets the dimensions."""
    lines_ = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    who = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines_.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("n").alias("n"))


@register("AGG-27_changes", "select path, max(changes) as changes, count(distinct snapshot_no) n_snapshots from atlas_snapshots where path is not null group by 1")
def agg_27(spark, folder):
    return table(spark, folder, "atlas_snapshots").where("path is not null").groupBy("path").agg(F.max("changes").alias("changes"), F.count_distinct("snapshot_no").alias("n_snapshots"))


@register("AGG-28_tree_digest", f"""select project, sha256(string_agg(b || ':' || d, ';' order by b)) as digest from (
  select project, left(md5(relative), 2) b, sha256(string_agg(relative || ':' || md5(content), ';' order by relative)) as d from {FILES} where project is not null and relative is not null group by 1, 2) group by 1""")
def agg_28(spark, folder):
    """Digest of a project's tree: its sorted paths and their content by 256 buckets of paths, then over the buckets.

    No task holds all paths of a large project, only those of a bucket.
    """
    f = files(spark, folder).where("project is not null and relative is not null").select("project", F.substring(F.md5("relative"), 1, 2).alias("b"), "relative", F.md5("content").alias("h"))
    joined = lambda parts: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(":", x[parts[0]], x[parts[1]])), ";")
    buckets = f.groupBy("project", "b").agg(F.sha2(joined(("relative", "h")), 256).alias("d"))
    return buckets.groupBy("project").agg(F.sha2(joined(("b", "d")), 256).alias("digest"))


@register("AGG-29_tally", "select alert_ref, count(*) filter (result = 'routed') as confirmed, count(*) filter (result = 'refuted') as refuted from (select distinct proposal_id, alert_ref, result from runbook_proposals where alert_ref is not null) group by 1 having count(*) filter (result = 'routed') >= 2 and count(*) filter (result = 'refuted') = 0")
def agg_29(spark, folder):
    p = table(spark, folder, "runbook_proposals").where("alert_ref is not null").select("proposal_id", "alert_ref", "result").distinct()
    return p.groupBy("alert_ref").agg(F.count_if(F.col("result") == "routed").alias("confirmed"), F.count_if(F.col("result") == "refuted").alias("refuted")).where("confirmed >= 2 and refuted = 0")


@register("AGG-33_catalog", "select service, array_to_string(list_sort(list(distinct flow_trigger.path)), ',') as paths from flows where flow_trigger.path is not null group by 1")
def agg_33(spark, folder):
    f = table(spark, folder, "flows").where("flow_trigger.path is not null")
    return f.groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("flow_trigger.path")), ",").alias("paths"))


# --- windows and ranking ---


@register("WIN-01_noise_budget", "select artifact_id, place, case when place <= 25 then 'kept' else 'capped' end as result from (select artifact_id, cast(row_number() over (partition by service order by confidence desc nulls last, artifact_id, recorded_at) as int) place from (select distinct artifact_id, service, confidence, recorded_at from artifacts))")
def win_01(spark, folder):
    a = table(spark, folder, "artifacts").select("artifact_id", "service", "confidence", "recorded_at").distinct()
    return windows.ranked_budget(a, ["service"], [F.col("confidence").desc_nulls_last(), F.col("artifact_id"), F.col("recorded_at")], 25).select("artifact_id", "place", "result")


@register("WIN-03_step_numbers", f"select flow_id, captured_at, pos, 's' || row_number() over (partition by flow_id, captured_at order by pos) as label from (select distinct flow_id, captured_at, pos from {STEPS})")
def win_03(spark, folder):
    s = flow_steps(spark, folder).select("flow_id", "captured_at", "pos").distinct()
    n = F.row_number().over(Window.partitionBy("flow_id", "captured_at").orderBy("pos"))
    return s.select("flow_id", "captured_at", "pos", F.concat(F.lit("s"), n).alias("label"))


@register("WIN-04_unique_names", f"select artifact_id, name || case when r > 1 then '-' || r else '' end as unique_name from (select artifact_id, name, row_number() over (partition by kind, name order by artifact_id) r from (select distinct artifact_id, kind, name from {ARTS}))")
def win_04(spark, folder):
    a = artifacts(spark, folder).select("artifact_id", "kind", "name").distinct()
    r = F.row_number().over(Window.partitionBy("kind", "name").orderBy("artifact_id"))
    return a.select("artifact_id", F.concat("name", F.when(r > 1, F.concat(F.lit("-"), r)).otherwise("")).alias("unique_name"))


@register("WIN-05_base_first", "select file_id, cast(row_number() over (partition by project order by env is not null, relative, file_id) as int) as place from (select distinct file_id, project, relative, nullif(regexp_extract(regexp_extract(relative, '[^/]*$'), '^[^-]*-(.+)\\.[^.]*$', 1), '') env from source_files where language = 'yaml' and project is not null)")
def win_05(spark, folder):
    f = table(spark, folder, "source_files").where("language = 'yaml' and project is not null").select("file_id", "project", "relative").distinct()
    env = S.environment_of(F.col("relative"))
    return f.select("file_id", F.row_number().over(Window.partitionBy("project").orderBy(env.isNotNull(), "relative", "file_id")).alias("place"))


@register("WIN-08_last_five", "select service, flow_id from (select service, flow_id, row_number() over (partition by service order by c desc, flow_id desc) r from (select service, flow_id, max(captured_at) c from flows group by 1, 2)) where r <= 5")
def win_08(spark, folder):
    """The last five flows of a service (the tracker's size)."""
    f = table(spark, folder, "flows").groupBy("service", "flow_id").agg(F.max("captured_at").alias("c"))
    return f.withColumn("r", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("c"), F.desc("flow_id")))).where("r <= 5").select("service", "flow_id")


_BURN = "avg(case when event_type = 'error' then 1.0 else 0.0 end) over (partition by k order by ts range between interval {0} preceding and current row)"
_BURN_SQL = f"select event_id, b1 > 14.4 * 0.025 and b2 > 14.4 * 0.025 as fast, b3 > 6.0 * 0.025 and b4 > 6.0 * 0.025 as slow from (select event_id, {_BURN.format('1 hour')} b1, {_BURN.format('5 minutes')} b2, {_BURN.format('6 hours')} b3, {_BURN.format('30 minutes')} b4 from (select *, user_id as k from events where ts is not null))"


@register("WIN-09_burn_rates", _BURN_SQL)
def win_09(spark, folder):
    e = table(spark, folder, "events").withColumn("k", F.col("user_id"))
    return windows.burn_rates(e, ["k"], "ts", F.col("event_type") == "error", 0.025).select("event_id", "fast", "slow")


@register("WIN-10_error_windows", "select k, w as start_at, n, errors from (select user_id as k, time_bucket(interval '5 minutes', ts) w, count(*) n, count(*) filter (event_type = 'error') errors from events where ts is not null group by 1, 2) where errors > 0")
def win_10(spark, folder):
    e = table(spark, folder, "events").where("ts is not null").withColumn("k", F.col("user_id"))
    per = e.groupBy("k", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return per.where("errors > 0").select("k", F.col("w.start").alias("start_at"), "n", "errors")


@register("WIN-11_red", "select event_type, time_bucket(interval '1 day', ts) as day, count(*) n, sum(cast(round(value * 100) as bigint)) as hundredths, quantile_disc(cast(round(value * 100) as bigint), 0.95) as p95 from events where ts is not null group by 1, 2")
def win_11(spark, folder):
    """Rate, total and 95th percentile by type and day, in hundredths so that sums don't depend on their order."""
    e = table(spark, folder, "events").where("ts is not null").withColumn("v", F.round(F.col("value") * 100).cast("bigint"))
    per = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("v").alias("hundredths"), F.expr("percentile_disc(0.95) within group (order by v)").cast("bigint").alias("p95"))
    return per.select("event_type", F.col("w.start").alias("day"), "n", "hundredths", "p95")


# --- set operations, validation, graphs ---


@register("SET-01_drift", f"""with b as (select service, kind, name, coalesce(max(status), '-') s from {ARTS} where recorded_at < timestamp '2024-10-01' and (retired_at is null or retired_at >= timestamp '2024-10-01') group by 1, 2, 3),
h as (select service, kind, name, coalesce(max(status), '-') s from {ARTS} where recorded_at < timestamp '2025-02-01' and (retired_at is null or retired_at >= timestamp '2025-02-01') group by 1, 2, 3)
select service, kind, name, case when b.s is null then 'added' when h.s is null then 'removed' else 'changed' end as change from b full join h using (service, kind, name) where b.s is distinct from h.s""")
def set_01(spark, folder):
    """Registry at one time against the registry at a later one."""
    a = artifacts(spark, folder)

    def at(day: str, name: str) -> DataFrame:
        t = F.lit(day).cast("timestamp_ntz")
        return a.where((F.col("recorded_at") < t) & (F.col("retired_at").isNull() | (F.col("retired_at") >= t))).groupBy("service", "kind", "name").agg(F.coalesce(F.max("status"), F.lit("-")).alias(name))

    both = at("2024-10-01", "b").join(at("2025-02-01", "h"), ["service", "kind", "name"], "full").where(~F.col("b").eqNullSafe(F.col("h")))
    return both.select("service", "kind", "name", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("changed").alias("change"))


@register("SET-03_never_emitted", f"select distinct s.service, k.kind from (select distinct service from {ARTS}) s join (select distinct kind from {ARTS}) k on true where not exists (select 1 from {ARTS} a where a.service = s.service and a.kind = k.kind)")
def set_03(spark, folder):
    """Kinds that a service never emits: the few kinds are held as one array, no rows are paired."""
    a = artifacts(spark, folder)
    kinds = a.groupBy().agg(F.array_sort(F.collect_set("kind")).alias("all_kinds"))
    per = a.groupBy("service").agg(F.collect_set("kind").alias("own")).withColumn("one", F.lit(1))
    return per.join(F.broadcast(kinds.withColumn("one", F.lit(1))), "one").select("service", F.explode(F.array_except("all_kinds", "own")).alias("kind"))


@register("SET-06_pending", "select distinct service from flows where service not in (select service from narratives where service is not null and grounded = false)")
def set_06(spark, folder):
    """Services planned but not done."""
    return table(spark, folder, "flows").select("service").distinct().join(table(spark, folder, "narratives").where("grounded = false").select("service").distinct(), "service", "left_anti")


_DELIVERED = "(select a.* from atlas_snapshots a join (select snapshot_no, max(delivery_no) d from atlas_snapshots group by 1) l on a.snapshot_no = l.snapshot_no and a.delivery_no = l.d where path is not null)"


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the valid (highest) delivery of every snapshot; the list of deliveries is one row a snapshot."""
    a = table(spark, folder, "atlas_snapshots")
    last = a.groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no"))
    return a.join(last, ["snapshot_no", "delivery_no"], "left_semi")


@register("SET-07_three_way", f"""with h as (select snapshot_no n, path, max(excerpt_hash) h from {_DELIVERED} group by 1, 2), b as (select distinct n from h where n + 2 <= (select max(n) from h)),
p as (select b.n, k.path, m.h m, d.h d, s.h s from b join (select distinct path from h) k on true left join h m on m.n = b.n and m.path = k.path left join h d on d.n = b.n + 1 and d.path = k.path left join h s on s.n = b.n + 2 and s.path = k.path)
select n as snapshot_no, path, case when s is null and d = m then 'removed' when s is null then 'kept' when d is null or d is not distinct from m then 'written' when d = s then 'same' else 'proposed' end as action from p where not (s is null and d is null)""")
def set_07(spark, folder):
    """Merge of what is staged, what stands at the destination and what was written last, for each three snapshots in turn.

    Every row speaks as the last-written of its own snapshot, as destination of the one before and as staged of the one
    before that; one aggregate brings the three together.
    """
    a = delivered(spark, folder).where("path is not null").groupBy("snapshot_no", "path").agg(F.max("excerpt_hash").alias("h"))
    roles = F.array(*[F.struct((F.col("snapshot_no") - k).cast("int").alias("n"), F.lit(r).alias("role")) for k, r in enumerate("mds")])
    h = lambda role: F.max(F.when(F.col("role") == role, F.col("h"))).alias(role)
    p = a.select("path", "h", F.explode(roles).alias("x")).select("path", "h", "x.*").groupBy("n", "path").agg(h("m"), h("d"), h("s")).where("s is not null or d is not null")
    ends = a.agg(F.min("snapshot_no").alias("low"), (F.max("snapshot_no") - 2).alias("high")).first()
    action = (
        F.when(F.col("s").isNull() & (F.col("d") == F.col("m")), "removed").when(F.col("s").isNull(), "kept").when(F.col("d").isNull() | F.col("d").eqNullSafe(F.col("m")), "written").when(F.col("d") == F.col("s"), "same").otherwise("proposed")
    )
    return p.where(F.col("n").between(ends["low"], ends["high"])).select(F.col("n").alias("snapshot_no"), "path", action.alias("action"))


#: Evidence written down for a range of each file; every tenth has a hash of other lines, every tenth a path outside, every tenth a range beyond the end.
_EV = f"""(select file_id, project as repo, case when file_id % 10 = 4 then '../' || relative else relative end as path, relative, content,
  cast(1 + file_id % 7 as int) as s, cast(case when file_id % 10 = 5 then 1000000 else 1 + file_id % 7 + file_id % 5 end as int) as e, regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+') as ls from {FILES} where project is not null and relative is not null)"""


@register("VAL-03_provenance", f"""select file_id, case when file_id % 10 = 4 then 'path escapes its root' when e > len(ls) then 'lines out of bounds'
  when 'sha256:' || sha256(array_to_string(ls[s:e], '')) <> 'sha256:' || sha256(array_to_string(case when file_id % 10 = 3 then ls[s + 1:e + 1] else ls[s:e] end, '')) then 'hash mismatch' end as error from {_EV}""")
def val_03(spark, folder):
    """Evidence checked against its file: path within its root and there, range within bounds, the lines' hash unchanged."""
    f = files(spark, folder).where("project is not null and relative is not null")
    start, end, kind = (1 + F.col("file_id") % 7).cast("int"), (1 + F.col("file_id") % 7 + F.col("file_id") % 5).cast("int"), F.col("file_id") % 10
    moved = F.when(kind == 3, 1).otherwise(0)
    told = f.select(
        "file_id", F.col("project").alias("repo"), F.when(kind == 4, F.concat(F.lit("../"), "relative")).otherwise(F.col("relative")).alias("path"),
        start.alias("start"), F.when(kind == 5, 1_000_000).otherwise(end).alias("end"), excerpt_hash(F.col("content"), start + moved, F.when(kind == 5, 1_000_000).otherwise(end) + moved).alias("excerpt_hash"),
    )
    return provenance_errors(told, f.select(F.col("project").alias("repo"), F.col("relative").alias("path"), "content")).select("file_id", "error")


_KEY = "service || '/' || {0} || '/' || {1}"
_DEP_NODES = f"(select {_KEY.format('kind', 'name')} node, bool_and(coalesce(status, '') = 'verified') verified from {ARTS} group by 1 union all select distinct service || '/Flow/' || flow, true from {REFS} where service || '/Flow/' || flow not in (select {_KEY.format('kind', 'name')} from {ARTS}))"
_DEP_EDGES = f"(select distinct service || '/Flow/' || flow src, {_KEY.format('kind', 'name')} dst from {REFS} where relation in ('depends-on', 'implements'))"


_DOWN_SQL = f"""with recursive n as (select node, bool_and(verified) verified from {_DEP_NODES} group by 1), e as {_DEP_EDGES},
down(node) as (select e.src from e join n on n.node = e.src and n.verified where e.dst not in (select node from n where verified)
union select e.src from e join down on e.dst = down.node join n on n.node = e.src and n.verified)"""


def dependency_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Artifacts and flows as nodes with whether they are verified, and what flows depend on as edges."""
    key = lambda kind, name: F.concat_ws("/", "service", kind, name)
    r, a = cut_lineage(refs(spark, folder)), artifacts(spark, folder)  # nodes and edges both start from it
    stated = a.groupBy(key("kind", "name").alias("node")).agg(F.bool_and(F.coalesce("status", F.lit("")) == "verified").alias("verified"))
    silent = r.select(key(F.lit("Flow"), "flow").alias("node")).distinct().join(stated, "node", "left_anti").withColumn("verified", F.lit(True))
    edges = r.where("relation in ('depends-on', 'implements')").select(key(F.lit("Flow"), "flow").alias("src"), key("kind", "name").alias("dst")).distinct()
    return stated.unionByName(silent), edges


@register("VAL-05_downgrades", _DOWN_SQL + " select distinct node from down")
def val_05(spark, folder):
    """Verified flows that rest on something that isn't verified, to a fixpoint."""
    return graphs.downgraded(*dependency_graph(spark, folder))


@register("VAL-14_integrity", f"select 'dangling' as problem, src as item, count(*) n from {CALLS} e where not exists (select 1 from {CALLS} n where n.src = e.dst) group by 2 union all select 'repeated', node_id, count(*) from (select distinct snapshot_no, node_id, node_type, name, project, path, version from {_DELIVERED.replace(' where path is not null', '')} where node_id is not null) group by snapshot_no, node_id having count(*) > 1")
def val_14(spark, folder):
    """What breaks a graph: nodes with an edge to no node, and ids that stand for more than one node of a snapshot."""
    c = calls(spark, folder)
    dangling = c.join(c.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").groupBy(F.col("src").alias("item")).agg(F.count("*").alias("n"))
    nodes = delivered(spark, folder).where("node_id is not null").select("snapshot_no", "node_id", "node_type", "name", "project", "path", "version").distinct()
    repeated = nodes.groupBy("snapshot_no", "node_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node_id").alias("item"), "n")
    return dangling.select(F.lit("dangling").alias("problem"), "item", "n").unionByName(repeated.select(F.lit("repeated").alias("problem"), "item", "n"))


_SEEDS = f"(select distinct dst node from {CALLS} where dst not in (select src from {CALLS}))"


@register("GRF-01_reach", f"""with recursive e as (select * from {CALLS}), r(node, hops) as (select node, 0 from {_SEEDS} union select e.src, hops + 1 from r join e on e.dst = r.node where hops < 3)
select node, min(hops) as hops from r group by 1 having min(hops) > 0""")
def grf_01(spark, folder):
    """What reaches an application that calls nothing itself within three calls."""
    c = calls(spark, folder)
    return graphs.reach(c.join(c.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").select(F.col("dst").alias("node")).distinct(), c, 3)


_BULK = "(select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_quantity >= 40 and a.l_partkey <> b.l_partkey)"


@register("GRF-03_components", f"""with recursive e as (select * from {_BULK}), r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on r.b = e.src),
m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a where x.a <> x.b) select a as node, least(min(b), a) as component from m group by 1""")
def grf_03(spark, folder):
    """Parts that follow one another in circles, behind bulk lines of orders: a graph that grows with the orders."""
    lines_ = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ahead = lines_.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = lines_.where("l_quantity >= 40").join(ahead, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")
    return graphs.components(edges)


@register("GRF-04_clusters", f"select target, case when count(distinct service) = 1 then min(service) else 'shared' end as cluster from {SINKS} group by 1")
def grf_04(spark, folder):
    s = sinks(spark, folder).groupBy("target").agg(F.count_distinct("service").alias("n"), F.min("service").alias("one"))
    return s.select("target", F.when(F.col("n") == 1, F.col("one")).otherwise("shared").alias("cluster"))

"""Queries of the general training-data problems 3, 6 and 7, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import nested, references, snapshots
from lodestrata.sources.tables import table


def _all_references(spark: SparkSession, folder: str) -> DataFrame:
    return references.narrative_and_runbook_references(table(spark, folder, "narratives"), table(spark, folder, "runbook_proposals"))


def p3_orphans(spark: SparkSession, folder: str) -> DataFrame:
    intervals = references.registry_intervals(table(spark, folder, "artifacts"))
    return references.orphan_references(_all_references(spark, folder), intervals)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_orphans(spark, folder).select("src", "rec_id", F.concat_ws("/", "kind", "slug").alias("ref")).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    intervals = references.registry_intervals(table(spark, folder, "artifacts"))
    return references.orphan_report(_all_references(spark, folder), intervals)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.flow_children(table(spark, folder, "flows"))
    return rows.where("child in ('step', 'mode', 'sink')").select("flow_id", "child", "pos", "sub_pos")


def _flow_table(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """One of the flows' child tables, by schema path, with labels as text."""
    flows = nested.uniform_flows(nested.latest_flows(table(spark, folder, "flows")))
    nodes = nested.dewey_nodes(flows, ["flow_id"], ["steps", "sinks"])
    rows = nested.flat_tables(nodes, ["flow_id"], flows, ["steps", "sinks"])[path]
    text = lambda c: F.concat_ws(".", F.col(c).cast("array<string>")).alias(c)
    return rows.select("flow_id", text("label"), text("parent_label"), *[c for c in rows.columns if c not in ("flow_id", "label", "parent_label")])


def p6_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The failure-mode table with its link to the step it belongs to."""
    return _flow_table(spark, folder, "steps.failureModes")


def p6_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The step table; its rows belong to the flow itself."""
    return _flow_table(spark, folder, "steps")


def p6_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The reference table with its link to the step it belongs to."""
    return _flow_table(spark, folder, "steps.refs")


def p6_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """The sink table; its rows belong to the flow itself."""
    return _flow_table(spark, folder, "sinks")


def p7_changes(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshots.atlas_changes(table(spark, folder, "atlas_snapshots"))
    return changes.withColumn("changed_fields", F.concat_ws(",", "changed_fields"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.atlas_changes(table(spark, folder, "atlas_snapshots")).select("snapshot_no", "node_id", "change_kind")


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.change_counts(snapshots.atlas_changes(table(spark, folder, "atlas_snapshots")), "snapshot_no")


QUERIES = {q.__name__: q for q in (p3_found, p3_report, p6_found, p6_modes, p6_steps, p6_refs, p6_sinks, p7_found, p7_changes, p7_counts)}

_SLUG = r"coalesce(nullif(lower(trim(regexp_replace(regexp_replace({0}, '([A-Z])', '-\1', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'x')"

_REFS = rf"""
with cited as (
  select 'narratives' src, narrative_id rec_id, service, checked_at at_, unnest(regexp_extract_all(coalesce(body, ''), '\b[A-Z][A-Za-z0-9]+/[A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?')) r
  from narratives
  union all
  select 'runbook_proposals', proposal_id, service, drafted_at,
    unnest(regexp_extract_all(concat_ws(' ; ', array_to_string(symptoms, ' ; '), array_to_string(diagnosis, ' ; '), array_to_string(remediation, ' ; '), escalation), '\b[A-Z][A-Za-z0-9]+/[A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?'))
  from runbook_proposals
), named as (
  select src, rec_id, service, at_, regexp_extract(r, '^[^/]*') kind, regexp_replace(r, '^[^/]*/', '') name from cited
  union all
  select 'runbook_proposals', proposal_id, service, drafted_at, 'Alert', regexp_replace(trim(alert_ref), '^Alert/', '') from runbook_proposals
  union all
  select 'runbook_proposals', proposal_id, service, drafted_at, 'Flow', regexp_replace(trim(related_flow), '^Flow/', '') from runbook_proposals
), every as (
  select distinct src, cast(rec_id as bigint) rec_id, service, kind, {_SLUG.format("name")} slug, at_ from named
  where name <> '' and kind in (select kind from artifacts where service is not null and name is not null and recorded_at is not null)
), refs as (
  select * from every where at_ is not null and service is not null
), arts as (
  select distinct service, kind, {_SLUG.format("name")} slug, recorded_at f, retired_at t from artifacts where recorded_at is not null
), orphans as (
  select r.*, case when min(a.f) is null then 'missing' when min(a.f) <= at_ then 'deleted' else 'late' end finding
  from refs r left join arts a on r.service = a.service and r.kind = a.kind and r.slug = a.slug
  group by r.src, r.rec_id, r.service, r.kind, r.slug, r.at_
  having count(*) filter (a.f <= at_ and (a.t is null or at_ < a.t)) = 0
)"""

_SNAPS = """
with last_ as (select snapshot_no, max(delivery_no) d from atlas_snapshots group by 1),
steps as (select snapshot_no, d, lag(snapshot_no) over (order by snapshot_no) prev from last_),
rows_ as (
  select distinct s.snapshot_no, prev, node_id, trim(name) n, trim(path) p, trim(version) v,
    list_sort(list_distinct(coalesce(licenses, []))) l, list_sort(list_distinct(coalesce(owners, []))) o, round(coverage, 3) c
  from atlas_snapshots a join steps s on a.snapshot_no = s.snapshot_no and a.delivery_no = s.d where node_id is not null
),
pairs as (
  select coalesce(b.snapshot_no, x.snapshot_no) snapshot_no, coalesce(a.node_id, b.node_id) node_id,
    a.node_id is not null was, b.node_id is not null is_,
    concat_ws(',', case when a.n is distinct from b.n then 'name' end, case when a.p is distinct from b.p then 'path' end,
      case when a.v is distinct from b.v then 'version' end, case when a.l is distinct from b.l then 'licenses' end,
      case when a.o is distinct from b.o then 'owners' end, case when a.c is distinct from b.c then 'coverage' end) fields
  from rows_ b full join (rows_ r join (select snapshot_no nxt, prev prv from steps where prev is not null) t on r.snapshot_no = t.prv) a
    on b.prev = a.prv and b.node_id = a.node_id
  left join steps x on x.prev = a.snapshot_no
  where (b.snapshot_no is null or b.prev is not null)
),
changes as (
  select snapshot_no, node_id, case when not was then 'added' when not is_ then 'removed' when fields <> '' then 'changed' end change_kind,
    case when was and is_ then fields else '' end changed_fields
  from pairs where not was or not is_ or fields <> ''
)"""

_JSON_ARRAY = "(case json_type({0}) when 'ARRAY' then {0} when 'OBJECT' then json_array({0}) when 'VARCHAR' then case json_type(try_cast(json_extract_string({0}, '$') as json)) when 'ARRAY' then try_cast(json_extract_string({0}, '$') as json) when 'OBJECT' then json_array(try_cast(json_extract_string({0}, '$') as json)) end end)"

_FLOWS = f"""
with latest as (
  select * from flows where flow_id is not null qualify row_number() over (partition by flow_id order by captured_at desc nulls last, ingested_at desc nulls last) = 1
), docs as (
  select flow_id, case when steps is null and sinks is null then (case when json_valid(spec_json) then spec_json::json end) else to_json({{'steps': steps, 'sinks': sinks}}) end j from latest
), specs as (
  select flow_id, coalesce(case when json_type(j, '$.spec') = 'OBJECT' then json_extract(j, '$.spec') end, j) j from docs
), arrays as (
  select flow_id, {_JSON_ARRAY.format("json_extract(j, '$.steps')")} st, {_JSON_ARRAY.format("json_extract(j, '$.sinks')")} si from specs
), steps as (
  select flow_id, e.i pos, json_extract(st, '$[' || (e.i - 1) || ']') s from arrays, unnest(range(1, json_array_length(st)::bigint + 1)) e(i)
), modes as (
  select flow_id, pos, {_JSON_ARRAY.format("coalesce(case when json_type(s, '$.failureModes') <> 'NULL' then json_extract(s, '$.failureModes') end, json_extract(s, '$.failure_modes'))")} m from steps
)
"""
_FOUND = """select flow_id, 'step' child, cast(pos as int) pos, cast(0 as int) sub_pos from steps where json_type(s) <> 'NULL'
union all
select flow_id, 'mode', cast(pos as int), cast(e.i as int) from modes, unnest(range(1, json_array_length(m)::bigint + 1)) e(i) where json_type(m, '$[' || (e.i - 1) || ']') <> 'NULL'
union all
select flow_id, 'sink', cast(e.i as int), cast(0 as int) from arrays, unnest(range(1, json_array_length(si)::bigint + 1)) e(i) where json_type(si, '$[' || (e.i - 1) || ']') <> 'NULL'
"""
_TEXT = "json_extract_string({0}, '$.{1}')"
#: the array below a step at place x, its element at place y
_P6_MODES = _FLOWS + f"""select flow_id, '1.' || pos || '.5.' || i as label, '1.' || pos as parent_label, case json_type(x) when 'VARCHAR' then json_extract_string(x, '$') else {_TEXT.format('x', 'mode')} end as mode,
  coalesce({_TEXT.format('x', 'surfacedAs')}, {_TEXT.format('x', 'surfaced_as')}) as "surfacedAs", try_cast({_TEXT.format('x', 'dataLossRisk')} as boolean) as "dataLossRisk"
from (select flow_id, pos, e.i as i, json_extract(m, '$[' || (e.i - 1) || ']') x from modes, unnest(range(1, json_array_length(m)::bigint + 1)) e(i)) where json_type(x) <> 'NULL'"""
_P6_STEPS = _FLOWS + f"select flow_id, '1.' || pos as label, '' as parent_label, {', '.join(f'{_TEXT.format(chr(115), n)} as {n}' for n in ('id', 'name', 'kind', 'symbol'))} from steps where json_type(s) <> 'NULL'"
_P6_REFS = _FLOWS + f"""select flow_id, '1.' || pos || '.6.' || i as label, '1.' || pos as parent_label, {', '.join(f"{_TEXT.format('x', n)} as {n}" for n in ('kind', 'name', 'relation'))}
from (select flow_id, pos, e.i as i, json_extract(r, '$[' || (e.i - 1) || ']') x from (select flow_id, pos, {_JSON_ARRAY.format("json_extract(s, '$.refs')")} r from steps), unnest(range(1, json_array_length(r)::bigint + 1)) e(i)) where json_type(x) <> 'NULL'"""
_P6_SINKS = _FLOWS + f"""select flow_id, '2.' || i as label, '' as parent_label, {_TEXT.format('x', 'type')} as type, {_TEXT.format('x', 'target')} as target
from (select flow_id, e.i as i, json_extract(si, '$[' || (e.i - 1) || ']') x from arrays, unnest(range(1, json_array_length(si)::bigint + 1)) e(i)) where json_type(x) <> 'NULL'"""

ORACLE = {
    "p3_found": _REFS + " select distinct src, rec_id, kind || '/' || slug ref from orphans",
    "p3_report": _REFS
    + """ select src, month, coalesce(n_refs, 0) n_refs, coalesce(n_orphans, 0) n_orphans, coalesce(n_missing, 0) n_missing, coalesce(n_deleted, 0) n_deleted, coalesce(n_late, 0) n_late, n_unplaced
    from (select src, date_trunc('month', at_) as month, count(*) filter (at_ is not null and service is not null) n_refs, count(*) filter (at_ is null or service is null) n_unplaced from every group by all) t
    left join (select src as s2, date_trunc('month', at_) as m2, count(*) n_orphans, count(*) filter (finding = 'missing') n_missing,
      count(*) filter (finding = 'deleted') n_deleted, count(*) filter (finding = 'late') n_late from orphans group by all) o on src = s2 and month = m2""",
    "p6_found": _FLOWS + _FOUND,
    "p6_modes": _P6_MODES,
    "p6_steps": _P6_STEPS,
    "p6_refs": _P6_REFS,
    "p6_sinks": _P6_SINKS,
    "p7_found": _SNAPS + " select snapshot_no, node_id, change_kind from changes",
    "p7_changes": _SNAPS + " select * from changes",
    "p7_counts": _SNAPS
    + " select snapshot_no, count(*) filter (change_kind = 'added') n_added, count(*) filter (change_kind = 'removed') n_removed, count(*) filter (change_kind = 'changed') n_changed from changes group by 1",
}

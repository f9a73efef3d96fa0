"""The queries on steps, sinks, refs and triggers of flows, over the latest row of every flow, also where its spec is text.

They are written over the nested columns in their modules; here, Spark and SQL alike, they get flows in one shape, old
versions and repeated deliveries left out (but for those that compare versions).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators.nested import latest_flows, whole_flows
from lodestrata.plans import fact_queries, relation_queries, scalar_queries
from lodestrata.plans.problem_queries import _JSON_ARRAY
from lodestrata.sources.tables import Shaped

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _items(array: str, made: str) -> str:
    """SQL: the elements x of a JSON array as `made`; null elements stay null."""
    return f"list_transform(cast({_JSON_ARRAY.format(array)} as json[]), lambda x: case when json_type(x) <> 'NULL' then {made} end)"


def _fields(x: str, *names: str) -> str:
    return ", ".join(f"'{n}': json_extract_string({x}, '$.{n}')" for n in names)


_MODES = "coalesce(case when json_type(x, '$.failureModes') <> 'NULL' then json_extract(x, '$.failureModes') end, json_extract(x, '$.failure_modes'))"
_MODE = "{'mode': case json_type(x) when 'VARCHAR' then json_extract_string(x, '$') else json_extract_string(x, '$.mode') end, 'surfacedAs': coalesce(json_extract_string(x, '$.surfacedAs'), json_extract_string(x, '$.surfaced_as')), 'dataLossRisk': try_cast(json_extract_string(x, '$.dataLossRisk') as boolean)}"
_STEP = f"{{{_fields('x', 'id', 'name', 'kind', 'symbol')}, 'failureModes': {_items(_MODES, _MODE)}, 'refs': {_items("json_extract(x, '$.refs')", f"{{{_fields('x', 'kind', 'name', 'relation')}}}")}}}"
_SINK = f"{{{_fields('x', 'type', 'target')}}}"

FLOWS = f"""flows as (
  select * exclude (j) replace (
    coalesce(steps, {_items("json_extract(j, '$.steps')", _STEP)}) as steps, coalesce(sinks, {_items("json_extract(j, '$.sinks')", _SINK)}) as sinks,
    coalesce(flow_trigger, case when json_type(j, '$.trigger') = 'OBJECT' then {{{_fields("json_extract(j, '$.trigger')", "type", "method", "path", "entrypoint")}}} end) as flow_trigger, null::varchar as spec_json)
  from (select * exclude (d), coalesce(case when json_type(d, '$.spec') = 'OBJECT' then json_extract(d, '$.spec') end, d) j
    from (select *, case when steps is null and sinks is null and json_valid(spec_json) then spec_json::json end d from {{rows}}))
)"""
_LATEST = "(select * from main.flows where flow_id is not null qualify row_number() over (partition by flow_id order by captured_at desc nulls last, ingested_at desc nulls last) = 1)"
#: These compare versions of flows, so they see all rows.
_VERSIONS = {"JN-08_contract_change", "SET-05_newly_required"}


def _over_whole_flows(query: Callable, versions: bool) -> Callable:
    def whole(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, Shaped(folder, flows=whole_flows if versions else lambda flows: whole_flows(latest_flows(flows))))

    return whole


for _module in (scalar_queries, relation_queries, fact_queries):
    for _name, _sql in _module.ORACLE.items():
        if re.search(r"\bflows\b", _sql) and re.search(r"\b(steps|sinks|flow_trigger)\b", _sql):
            _shaped = FLOWS.replace("{rows}", "main.flows" if _name in _VERSIONS else _LATEST)
            QUERIES[_name] = _over_whole_flows(_module.QUERIES[_name], _name in _VERSIONS)
            _begins = re.match(r"with (recursive )?", _sql)
            ORACLE[_name] = f"{_begins.group()}{_shaped}, {_sql[_begins.end() :]}" if _begins else f"with {_shaped} {_sql}"

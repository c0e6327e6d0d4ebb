"""Queries of problem 6: attribute rows of newborns as a wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import eav
from marlstone.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    listed = eav.fields(table(spark, d, "eav_field_spec"))
    return eav.found(eav.compacted_cells(table(spark, d, "newborn_nbu_2021"), listed))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    listed = eav.fields(table(spark, d, "eav_field_spec"))
    rows = table(spark, d, "newborn_nbu_2021")
    return eav.wide(rows, eav.compacted_cells(rows, listed), table(spark, d, "patient_record"), listed)


QUERIES = {f.__name__: f for f in (p6_found, p6_wide)}

_CELLS = r"""
with spec as (select distinct field_name, value_type, lower(unit) as unit from eav_field_spec),
r as (
  select trim(key) as record_key, s.field_name, s.value_type, s.unit, trim(field_value) as v, lower(trim(field_value)) as lv, loaded_at, row_id
  from newborn_nbu_2021 e join spec s on replace(replace(lower(trim(e.field_name)), ' ', '_'), '-', '_') = s.field_name
  where trim(key) <> ''),
t as (
  select *, lv is null or lv in ('', 'none', 'null', 'na', 'n/a', 'nan') as is_missing,
    case when unit is not null and ends_with(lv, unit) then trim(left(lv, len(lv) - len(unit))) else lv end as num,
    case when regexp_full_match(v, '\d{4}-\d\d-\d\d') then v || ' 00:00:00'
         when regexp_full_match(v, '\d{4}-\d\d-\d\d \d\d:\d\d') then v || ':00'
         when regexp_full_match(v, '\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d') then replace(v, 'T', ' ') end as ts
  from r),
c as (
  select *, case when is_missing then null
    when value_type = 'int' then case when regexp_full_match(num, '[+-]?[0-9]+') then cast(try_cast(num as int) as varchar) end
    when value_type = 'double' then case when regexp_full_match(num, '[+-]?[0-9]+([.,][0-9]+)?') then cast(try_cast(replace(num, ',', '.') as double) as varchar) end
    when value_type = 'boolean' then case when lv in ('true', '1', 'yes', 'y', 't') then 'true' when lv in ('false', '0', 'no', 'n', 'f') then 'false' end
    when value_type = 'sex' then case when lv in ('m', 'male') then 'male' when lv in ('f', 'female') then 'female' end
    when value_type = 'timestamp' then cast(try_cast(ts as timestamp) as varchar)
    else v end as reading
  from t),
cell as (
  select record_key, field_name,
    arg_max(case when is_missing then 'missing' when reading is null then 'unreadable' else 'readable' end, struct_pack(l := coalesce(loaded_at, timestamp '0001-01-01'), r := row_id)) as state,
    arg_max(coalesce(reading, chr(0)), struct_pack(l := coalesce(loaded_at, timestamp '0001-01-01'), r := row_id)) as reading,
    min(reading) as least, max(reading) as most
  from c group by all)
"""
# Fields of the form, by type, for the SQL of the wide table.
_TYPED = {
    "int": ["age_days"],
    "grams": ["birth_weight", "weight_now"],
    "double": ["capillary_refill", "gestational_age", "heart_rate", "oxygen_saturation", "respiratory_rate", "temparature"],
    "varchar": ["care_setting", "sex", "triage_category"],
    "timestamp": ["admission_date_time"],
    "boolean": [
        "ampicillin", "antibiotics", "apnoea", "bulging_fontanelle", "central_cyanosis", "convulsions", "cpap", "crackles",
        "difficulty_breathing", "difficulty_feeding", "feeds", "floppy", "fluids", "gentamicin", "grunting", "indrawing",
        "irritable", "maternal_infection", "oxygen", "penicillin", "prom",
    ],
}


def _column(name: str, kind: str) -> str:
    value = f"max(case when field_name = '{name}' and reading <> chr(0) then reading end)"
    if kind == "grams":
        return f"round(cast({value} as double) * 1000, 1) as {name}"
    return f"cast({value} as {kind}) as {name}"


_COLUMNS = ",\n    ".join(_column(n, kind) for kind, names in _TYPED.items() for n in names)
_STATUS = "struct_pack(name := '{0}', status := case when {0} then 'present' when not {0} then 'absent' else 'not assessed' end)"

SQL = {
    "p6_found": _CELLS
    + """
select record_key, field_name, 'unreadable' as kind from cell where state = 'unreadable'
union all select record_key, field_name, 'conflict' from cell where least <> most
""",
    "p6_wide": _CELLS
    + f""",
w as (select record_key,
    {_COLUMNS}
  from cell group by record_key),
p as (select trim(record_key) as record_key, arg_max(patient_id, struct_pack(i := ingested_at, p := patient_id)) as patient_id
      from patient_record where patient_id is not null group by 1)
select k.record_key, p.patient_id, w.* exclude (record_key), [{_STATUS.format("maternal_infection")}, {_STATUS.format("prom")}] as maternal_risk_factors
from (select distinct trim(key) as record_key from newborn_nbu_2021 where trim(key) <> '') k
left join w using (record_key) left join p using (record_key)
""",
}

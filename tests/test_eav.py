import datetime as dt
import random

import pytest

from marlstone.operators import eav

SPEC = [
    ("age_days", "int", None, "to_int", None), ("birth_weight", "double", "kg", "kg_to_g", None), ("sex", "sex", None, "sex_norm", None),
    ("prom", "boolean", None, "bool_truthy", "maternal_risk_factors"), ("admitted", "timestamp", None, "parse_datetime", None),
    ("ward", "string", None, "identity", None),
]
SCHEMA = "row_id bigint, key string, field_name string, field_value string, context string, loaded_at timestamp_ntz, extra string"


@pytest.fixture(scope="module")
def listed(spark):
    return eav.fields(spark.createDataFrame(SPEC, "field_name string, value_type string, unit string, transform_name string, family string"))


def rows(spark, values):
    day = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, k, f, v, None, None if h is None else day + dt.timedelta(hours=h), "x") for i, (k, f, v, h) in enumerate(values)], SCHEMA)


def found(spark, listed, values):
    return {(r.record_key, r.field_name, r.kind) for r in eav.found(eav.compacted_cells(rows(spark, values), listed)).collect()}


def test_last_row_decides_and_conflicts_compare_values(spark, listed):
    got = found(spark, listed, [
        ("1", "AGE days", "3", 1), (" 1 ", "age-days", "x", 2),  # unreadable at last
        ("2", "age_days", "x", 1), ("2", "age_days", "4", 2),
        ("3", "birth_weight", "1,20", 1), ("3", "birth_weight", "1.2 KG", 2),  # the same value
        ("4", "birth_weight", "1.2", 1), ("4", "birth_weight", "1.3", 2),
        ("5", "sex", "M", 1), ("5", "sex", "male", 2), ("6", "prom", "NA", 1), ("6", "prom", "maybe", 0),
    ])
    assert got == {("1", "age_days", "unreadable"), ("4", "birth_weight", "conflict")}


def test_ties_of_time_go_to_the_larger_row_and_null_time_is_first(spark, listed):
    assert found(spark, listed, [("1", "age_days", "x", 1), ("1", "age_days", "3", 1)]) == set()
    assert found(spark, listed, [("1", "age_days", "3", 1), ("1", "age_days", "x", None)]) == set()


def test_readings_of_numbers_and_times(spark, listed):
    bad = ["29.", "1.2.3", "1 2", "--", "5 lb", "18O"]
    assert found(spark, listed, [(str(i), "birth_weight", v, 1) for i, v in enumerate(bad)]) == {(str(i), "birth_weight", "unreadable") for i in range(len(bad))}
    good = ["2025-01-08", "2025-01-08 21:57", "2025-01-08T21:57:00", "2025-01-08 21:57:00"]
    assert found(spark, listed, [(str(i), "admitted", v, 1) for i, v in enumerate(good)]) == set()
    ill = ["2025-13-09", "2025-02-30", "2025-01-08T21:57", "2025-01-08 25:10:00", "20250108"]
    assert len(found(spark, listed, [(str(i), "admitted", v, 1) for i, v in enumerate(ill)])) == len(ill)


def test_unlisted_fields_null_keys_and_repeated_rows_change_nothing(spark, listed):
    values = [("1", "age_days", "3", 1), ("1", "other", "x", 2), (None, "age_days", "x", 1), ("1", None, "x", 1), ("1", "ward", None, 1)]
    assert found(spark, listed, values + values) == set()


def test_wide_rows(spark, listed):
    table = rows(spark, [("1", "birth_weight", "1.2kg", 1), ("1", "prom", "yes", 1), ("2", "prom", "no", 1), ("3", "prom", "NA", 1), ("4", "other", "x", 1)])
    people = spark.createDataFrame(
        [("1", None, dt.datetime(2025, 1, 2)), ("1", "p1", dt.datetime(2025, 1, 1)), ("9", "p9", dt.datetime(2025, 1, 1))], "record_key string, patient_id string, ingested_at timestamp_ntz"
    )
    out = {r.record_key: r for r in eav.wide(table, eav.compacted_cells(table, listed), people, listed).collect()}
    assert set(out) == {"1", "2", "3", "4"}
    assert out["1"].birth_weight == 1200.0 and out["1"].patient_id == "p1"
    status = {k: r.maternal_risk_factors[0].status if r.maternal_risk_factors else None for k, r in out.items()}
    assert (status["1"], status["2"], status["3"]) == ("present", "absent", "not assessed")


def test_later_batches_merge_into_a_compacted_run(spark, listed):
    rng = random.Random(7)
    values = [(str(rng.randrange(8)), rng.choice(["age_days", "ward", "sex"]), rng.choice(["1", "2", "x", "m", "NA"]), rng.randrange(90)) for _ in range(300)]
    table = rows(spark, values)
    whole = {(r.record_key, r.field, r.cell.reading, r.cell.state, r.least, r.most) for r in eav.compacted_cells(table, listed).collect()}
    early = eav.as_run(eav.compact(eav.deltas(table.where("row_id < 150"), listed)))
    both = early.unionByName(eav.deltas(table.where("row_id >= 150"), listed))
    assert {(r.record_key, r.field, r.cell.reading, r.cell.state, r.least, r.most) for r in eav.compact(both).collect()} == whole


def test_empty_table(spark, listed):
    empty = rows(spark, [("1", "age_days", "1", 1)]).where("false")
    cells = eav.compacted_cells(empty, listed)
    assert eav.found(cells).count() == 0
    people = spark.createDataFrame([], "record_key string, patient_id string, ingested_at timestamp_ntz")
    assert eav.wide(empty, cells, people, listed).count() == 0

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import eav
from marlstone.operators import evaluation as V
from marlstone.operators import filters as P
from marlstone.operators import grounding as G
from marlstone.operators import metrics as M
from marlstone.operators import workflow as W
from marlstone.sources import charts, documents, generated

QUESTIONS = "query_id string, provenance string, expected string, observed string, had_recommendation boolean, disclaimer boolean"
CITED = "query_id string, position int, chunk_id string, page int, section string"


def run(spark, questions, runs, gold, cited, told):
    frames = [
        spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(runs, "query_id string, item_id string, rank int"), spark.createDataFrame(gold, "query_id string, item_id string"),
        spark.createDataFrame(cited, CITED), spark.createDataFrame(told, "query_id string, chunk_id string, page int, section string"),
    ]
    return {(r.part, r["name"]): (r.n, r.value, r.passed) for r in V.report(*frames).collect()}


def test_report_counts_by_the_rules(spark):
    questions = [
        ("a", "curated", "well_supported", "well_supported", False, True), ("b", "curated", "no_guideline_expected", "no_guideline", True, True),
        ("c", None, None, "missing_info", False, False), ("d", "generated", "missing_info_expected", "missing_info", False, True),
    ]
    runs = [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("gone", "x", 1)]
    cited = [("a", 1, "x", 5, "1.2.3"), ("a", 2, "x", 99, "9"), ("a", 3, "y", 1, "4")]
    told = [("a", "x", 6, "1.2"), ("a", "y", 3, "4"), ("d", "z", 1, None)]
    got = run(spark, questions, runs, [("a", "x"), ("a", "z"), ("d", "z"), ("gone", "x")], cited, told)
    assert got["retrieval", "precision_at_8"] == (2, 0.25, False) and got["retrieval", "recall_at_24"] == (2, 0.25, False) and got["retrieval", "recall_at_5"][2] is None
    assert got["citation", "locus_accuracy"] == (3, 0.333333, None)
    assert got["outcome", "well_supported"] == (1, 1.0, None) and got["outcome", "no_guideline_expected"] == (1, 0.0, False) and got["outcome", "missing_info_expected"][1] == 1.0
    assert got["provenance", "curated"] == (2, 0.5, None) and got["provenance", "none"] == (1, 0.0, None)
    assert got["safety", "scope_violations"] == (4, 1.0, False) and got["safety", "disclaimer_rate"] == (4, 0.75, False)


def test_empty_run_has_no_violation(spark):
    got = run(spark, [], [], [], [], [])
    assert got["safety", "scope_violations"] == (0, 0.0, True) and got["safety", "disclaimer_rate"] == (0, 1.0, True) and got["citation", "locus_accuracy"] == (0, None, None)


def test_drafts_propose_what_enough_answers_cite(spark):
    cited = spark.createDataFrame([("f", "q1", "x"), ("f", "q1", "x"), ("f", "q2", "x"), ("f", "q2", "y"), (None, "q3", "x"), ("f", "q4", "gone")], "area string, query_id string, item_id string")
    passages = spark.createDataFrame([("x", "a  " * 200), ("y", None)], "item_id string, text string")
    got = {r.item_id: r for r in M.reference_drafts(cited, passages, 0.5).collect()}
    assert set(got) == {"x", "y"} and got["x"].include and not got["y"].include and got["x"].answered == 3 and len(got["x"].excerpt) == 240


def test_tuned_choice_and_core_rows(spark):
    rows = spark.createDataFrame([(q, w, 0.5 + 0.1 * (w == 2) - 0.2 * (w == 3), "okapi") for q in range(20) for w in (1, 2, 3)], "query_id int, weight int, m double, scorer string")
    got = M.tuned(rows, "weight", "m", F.when(F.col("query_id") < 10, "tune").otherwise("heldout"), 1).first()
    assert (got.weight, got.score, got.n, got.delta, got.p) == (2, 0.6, 10, 0.1, 0.0)
    assert M.tuned(rows.where("false"), "weight", "m", F.lit("tune"), 1).count() == 0
    assert M.core_rows(rows).count() == 60 and M.core_rows(rows, "other").count() == 0


def test_replay_refuses_what_a_state_does_not_allow(spark):
    log = spark.createDataFrame([("x", 3, "close"), ("x", 1, "open"), ("x", 2, "open"), ("y", 1, "close"), (None, 1, "open"), ("z", 1, None)], "id string, at int, action string")
    out = W.replayed(log, [("new", "open", "open"), ("open", "close", "closed")], "new", "id", ["at"], "action")
    got = [(r.id, r.at, r.before, r.after, r.accepted) for r in out.orderBy("id", "at").collect()]
    assert got == [("x", 1, "new", "open", True), ("x", 2, "open", "open", False), ("x", 3, "open", "closed", True), ("y", 1, "new", "new", False), ("z", 1, "new", "new", False)]
    ended = {r.id: (r.state, r.n_accepted, r.n_refused, r.valid_to) for r in W.validity(out, "id", "at", ["at"], ["closed"]).collect()}
    assert ended == {"x": ("closed", 2, 1, 3), "y": ("new", 0, 1, None), "z": ("new", 0, 1, None)}
    assert W.replayed(log.where("false"), [], "new", "id", ["at"], "action").count() == 0


def test_batches_go_on_shrink_or_start_anew(spark):
    day = dt.datetime(2025, 1, 1)
    results = spark.createDataFrame([(r, day + dt.timedelta(days=i)) for i, r in enumerate(["old", "begun", "f1", "f2", "f3"])], "result_id string, created_at timestamp_ntz")
    rounds = spark.createDataFrame([("old", "p"), ("old", "q"), ("old", "s"), ("begun", "p"), ("begun", "p")], "result_id string, rater_id string")
    batches = spark.createDataFrame([("p", 1, 1, "old"), ("p", 1, 2, "f3"), ("q", 1, 1, "old"), ("t", 1, 1, "f1")], "rater_id string, batch_no int, position int, result_id string")
    raters = spark.createDataFrame([("p",), ("q",), ("p",)], "rater_id string")
    plan = lambda b: sorted(tuple(r) for r in W.batch_plan(results, rounds, b, raters, size=2).collect())
    assert plan(batches) == [("p", "batch", 1, "f3"), ("q", "in_progress", 1, "begun")]
    archived = batches.unionByName(spark.createDataFrame([("p", 1, 3, "gone")], batches.schema))
    assert plan(archived)[:2] == [("p", "batch", 1, "f3"), ("p", "batch", 2, "f2")]
    # f1 is in another's batch, so f2 and f3 are picked first for one without a batch, the oldest shown first.
    none = batches.where("rater_id = 't'")
    assert plan(none)[:2] == [("p", "new", 1, "f2"), ("p", "new", 2, "f3")]


def test_batch_guard_takes_whole_batches(spark):
    kind = ", ".join(f"{c} string" for c in ("dataset_id", *P.ATTESTED))
    told = spark.createDataFrame([("d", *["known"] * 9), ("t", *["known"] * 8, "todo later")], kind)
    rows = [("s", "syn"), ("d", "de"), ("d", "de"), ("t", "de"), ("m", "syn"), ("m", "de"), ("n", None)]
    kept, batches = P.guarded(spark.createDataFrame(rows, "dataset_id string, dataset_provenance string"), told, "syn", "de")
    assert {r.dataset_id: r.reason for r in batches.collect()} == {"s": "synthetic", "d": "attested", "t": "attestation_missing", "m": "provenance_unknown", "n": "provenance_unknown"}
    assert sorted(r.dataset_id for r in kept.collect()) == ["d", "d", "s"]


def test_nested_record_leaves_out_what_was_not_assessed(spark):
    spec = spark.createDataFrame([
        ("age_days", "encounter.day_of_life", None, "int"), ("admission", "encounter.admitted_at", None, "timestamp"), ("hr", "vitals.0.heart_rate_bpm", None, "double"),
        ("sex", "sex", None, "sex"), ("cpap", "interventions", "interventions", "boolean"), ("feeds", "interventions", "interventions", "boolean"),
    ], "field_name string, target string, family string, value_type string")
    rows = [("k1", 3, dt.datetime(2025, 3, 10, 5), 120.0, "male", False, None), ("k2", None, None, None, None, None, None)]
    wide = spark.createDataFrame(rows, "record_key string, age_days int, admission timestamp_ntz, hr double, sex string, cpap boolean, feeds boolean")
    one, two = eav.nested(wide, spec, {"record_id": "r-{key}", "schema_version": "1"}, {"note": "none", "sex": "unused"}).orderBy("record_key").collect()
    assert one.record_id == "r-k1" and one.encounter.day_of_life == 3 and one.vitals[0].heart_rate_bpm == 120.0 and one.vitals[0].recorded_at == rows[0][2]
    assert [(i.name, i.present) for i in one.interventions] == [("cpap", False)] and one.date_of_birth == dt.date(2025, 3, 7) and one.note == "none"
    assert two.vitals == [] and two.interventions == [] and two.encounter is None and two.date_of_birth is None and two.sex is None


def test_spans_and_corrections_on_quotes(spark):
    frame = spark.createDataFrame([("give  5 mg daily", "5 mg", 100), (None, "x", 0), ("abc", "", 0)], "text string, quote string, at int")
    span = lambda a, b: G.verified_span(a, b, F.col("at"), F.col("text"), F.col("quote"))
    got = frame.select(span(F.lit(106), F.lit(110)).alias("right"), span(F.lit(105), F.lit(109)).alias("off"), span(F.lit(90), F.lit(94)).alias("out")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, False), (False, False, False)]
    fixes = F.array(*[F.struct(F.lit(c).alias("correction_id"), F.lit(t).alias("corrected")) for c, t in (("a", "mg daily"), ("b", "give"), ("c", ""))])
    on = frame.select(G.corrections_on(fixes, F.col("text"), F.col("quote")).alias("c")).collect()
    assert [[x.correction_id for x in r.c] for r in on] == [["a"], [], []]


def test_rules_in_order_and_null_conditions(spark):
    frame = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    rule = P.first_rule([(F.col("v") > 3, "big"), (F.col("v") > 0, "some")], "none")
    assert [r[0] for r in frame.select(rule).collect()] == ["some", "big", "none"]


def test_charts_hold_points_in_order_and_generated_records_repeat(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0, 1.0), ("a", 1.0, None), ("b", 1.0, 0.5)], "series string, x double, y double")
    charts.write_lines(rows, str(tmp_path / "c"), "t", "x", "y")
    assert [tuple(r) for r in charts.read_lines(spark, str(tmp_path / "c")).collect()] == [("a", 1.0, None), ("b", 1.0, 0.5), ("b", 2.0, 1.0)]
    one, two = (sorted(map(tuple, generated.records(spark, 40, seed=5, sparse=0.5).collect())) for _ in range(2))
    assert one == two and 50 < len(one) < 150 and generated.records(spark, 0).count() == 0


def test_parser_failures_are_told(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(b"\xff")
    row = documents.parsed_files(spark, str(tmp_path), lambda b: [b.decode()], "*.bin").first()
    assert row.page_no == 0 and row.text is None and "UnicodeDecodeError" in row.error
    assert documents.laid_out_files(spark, str(tmp_path), lambda b: iter([b.decode()]), "*.bin").count() == 0
    with pytest.raises(documents.Incomplete):
        documents.attested([{"concept": "a", "field": "TODO"}], ["concept", "field"], "concept")


def test_the_harness_report_counts_gold_and_builds_none_but_of_the_runs(spark, tmp_path):
    from marlstone.plans import evaluation_queries as Q

    section = lambda i: "Neonatal / Fever" if i % 2 else "Neonatal / Feeding"
    chunks = [(f"c{i:03}", section(i), str(i % 5), i, f"fever cough w{i % 7} " * 2) for i in range(120)]
    chunks += [chunks[0], ("bare", None, None, None, "fever")]
    spark.createDataFrame(chunks, "chunk_id string, section_path string, section_number string, page_start int, text string").write.parquet(f"{tmp_path}/chunk.parquet")
    asked = [(f"q{i:02}", "p", "well_supported_expected", True, f"fever w{i % 7}", a) for i, a in enumerate(["fever", "Feeding", None, "neonatal", "none such"] * 4)]
    # One question of two areas, whose chunks count once.
    asked += [("q00", "p", "well_supported_expected", True, "fever w0", "NEONATAL")]
    spark.createDataFrame(asked, "question_id string, provenance string, expected_outcome string, in_fixed_testset boolean, text string, area string").write.parquet(f"{tmp_path}/eval_question.parquet")
    c, runs = Q._answers(spark, str(tmp_path))
    gold, sizes = Q._gold(spark, str(tmp_path), c, runs)
    want = {(q[0], k[0]) for q in asked for k in chunks if q[5] and k[1] and q[5].lower() in k[1].lower()}
    got = {(r.query_id, r.item_id) for r in gold.collect()}
    assert got == want & {(r.query_id, r.item_id) for r in runs.collect()} and 0 < len(got) < len(want)
    assert {r.query_id: r.n_gold for r in sizes.collect()} == {q: sum(1 for w in want if w[0] == q) for q in {w[0] for w in want}}
    report = {r.name: r for r in Q.agg5_harness_report(spark, str(tmp_path)).collect()}
    assert report["locus_accuracy"].n == len(want) and report["recall_at_24"].n == len({w[0] for w in want})

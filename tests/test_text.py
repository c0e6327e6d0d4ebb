from pyspark.sql import functions as F

from marlstone.functions import lines as L
from marlstone.functions import text as X


def one(spark, expression, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(expression.alias("out")).first().out


def test_analyzer_keeps_compounds_numbers_and_drops_stopwords(spark):
    text = "The dose of Amoxicillin-X is 5 mg/kg, not a 10"
    assert one(spark, X.analyze(F.col("t")), t=text) == ["dose", "amoxicillin-x", "5", "mg/kg", "10"]


def test_empty_text_has_no_tokens(spark):
    assert one(spark, X.analyze(F.col("t")), t="") == []


def test_abbreviations_expand_in_order_after_every_match(spark):
    out = one(spark, X.expand_abbreviations(F.col("t")), t="HR and hr in NBU")
    assert out == "HR (heart rate) and hr (heart rate) in NBU (newborn unit)"


def test_topic_needs_half_of_its_words(spark):
    words = X.strings("oxygen", "given")
    assert one(spark, X.topic_applies(F.lit("oxygen therapy"), words))
    assert not one(spark, X.topic_applies(F.lit("seizure control"), words))
    assert not one(spark, X.topic_applies(F.lit("of the"), words))


def test_verbatim_ignores_kind_of_white_space_only(spark):
    assert one(spark, X.contains_verbatim(F.lit("a  b"), F.lit("x a\nb y")))
    assert not one(spark, X.contains_verbatim(F.lit("a c"), F.lit("a b c")))
    assert not one(spark, X.contains_verbatim(F.lit("  "), F.lit("a b")))


def test_rendering_rounds_half_up_to_steps(spark):
    assert one(spark, X.render(F.lit(2.375), step=0.25, decimals=2)) == "2.50"
    assert one(spark, X.render(F.lit(4000.0), scale=0.001)) == "4.0"
    assert one(spark, X.render(F.lit(2350.0), scale=0.001, unit="kg")) == "2.35 kg"


def test_corrections_in_scope(spark):
    assert one(spark, X.in_scope(F.lit("less than 5 mg"), F.lit("more than 5 mg")))
    assert not one(spark, X.in_scope(F.lit("less than 5 mg"), F.lit("less than 6 mg")))
    assert one(spark, X.ocr_alike(F.lit("1.V"), F.lit("I.V")))


def test_segments_from_bare_fenced_and_broken_json(spark):
    body = '[{"type":"claim","text":"x","citation_ids":["c1"],"quote":"q"},{"type":"other","text":"y"}]'
    assert len(one(spark, X.parse_segments(F.lit(body)))) == 1
    assert len(one(spark, X.parse_segments(F.lit(f"```json\n{body}\n```")))) == 1
    assert not one(spark, X.parse_segments(F.lit("no json")))


def test_natural_lists(spark):
    assert [one(spark, X.join_natural(X.strings(*w))) for w in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b and c"]


def test_sequence_ratio_is_null_for_null(spark):
    frame = spark.createDataFrame([("abcd", "abcd"), ("abcd", None)], "a string, b string")
    assert [r.r for r in frame.select(X.sequence_ratio("a", "b").alias("r")).collect()] == [1.0, None]


def test_line_keys_ignore_digits_case_and_blanks(spark):
    keys = [one(spark, L.line_key(F.lit(t))) for t in ("Page 12  of 5\r", " page 3 OF 777 ")]
    assert keys[0] == keys[1] == "page 0 of 0"


def test_word_count_of_null_blank_and_odd_blanks(spark):
    frame = spark.createDataFrame([(None,), ("",), (" \t",), ("a b\tc\n",)], "t string")
    assert [r.n for r in frame.select(L.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 0, 3]


def test_accented_lines_and_chunks_are_judged(spark, tmp_path):
    from marlstone.plans import registry

    lines = [("a", "Temp below 36 \u2265 x"), ("b", "plain infant"), ("c", "M\u00e4rz I"), ("d", None)]
    spark.createDataFrame(lines, "line_id string, text string").write.parquet(str(tmp_path / "text_line.parquet"))
    texts = [("a", "Ein gro\u00dfes Beispiel"), ("b", "y" * 30 + " gro\u00dfe Nacht\nund Tag"), ("c", None)]
    spark.createDataFrame(texts, "chunk_id string, text string").write.parquet(str(tmp_path / "chunk.parquet"))
    got = {r.line_id: (r.broad, r.narrow, r.alike) for r in registry.queries()["txt17_correction_scope"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == (True, True, True)
    words = {(r.chunk_id, r.box_no): r.text for r in registry.queries()["chk24_completed_words"](spark, str(tmp_path)).collect()}
    assert words == {("a", 0): "Ein gro\u00dfes Beispiel", ("b", 0): "y" * 30 + " gro\u00dfe Nacht", ("b", 1): "Nacht\nund Tag"}

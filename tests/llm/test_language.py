import os

import pytest
from pyspark.sql import functions as F

from marlstone.llm import language as L

EN = ["The nurse checks the temperature of the newborn every hour. She calls the doctor when the child is cold and does not feed well.", "Parents who see fast breathing return to the ward with the child and bring the chart of the last visit."]
FR = ["L'infirmière vérifie la température du nouveau-né toutes les heures. Elle appelle le médecin quand l'enfant est froid et ne tète pas.", "Les parents qui voient une respiration rapide reviennent dans la salle avec l'enfant et la feuille de la dernière visite."]
DE = ["Die Schwester prüft die Temperatur des Neugeborenen jede Stunde. Sie ruft den Arzt, wenn das Kind kalt ist und nicht gut trinkt.", "Eltern, die eine schnelle Atmung sehen, kommen mit dem Kind zurück auf die Station und bringen den Bogen mit."]
SCHEMA = "doc_id bigint, text string, lang string, confidence double"


@pytest.fixture(scope="module")
def ranks():
    return L.train([("en", t) for t in EN * 3] + [("fr", t) for t in FR * 3] + [("de", t) for t in DE * 3] + [("en", FR[0])])


def found(spark, ranks, rows):
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, (t, g) in enumerate(rows)], SCHEMA)
    return {(r.doc_id, r.kind, r.lang) for r in L.found(docs, L.languages(L.segments(docs, ranks))).collect()}


def test_labels_missing_wrong_and_right(spark, ranks):
    rows = [(EN[0], None), (FR[0], "und"), (DE[0], "en-GB"), (EN[1], "English"), (FR[1], "fra"), (DE[1], "unknown"), (None, None), ("", "en"), ("12 | 13\n14", None), (EN[0].upper(), "EN"), ("Elle verifie la temperature du nouveau-ne et appelle le medecin.", "")]
    assert found(spark, ranks, rows) == {(0, "missing", "en"), (1, "missing", "fr"), (2, "wrong", "de"), (5, "missing", "de"), (10, "missing", "fr")}


def test_mixed_text_has_a_row_per_language(spark, ranks):
    mixed = EN[0] + " " + EN[1] + "\n" + FR[0]
    assert found(spark, ranks, [(mixed, "en"), (mixed, "fr"), (EN[0] + " Merci bien, madame.", "en")]) == {(0, "mixed", "en"), (0, "mixed", "fr"), (1, "mixed", "en"), (1, "mixed", "fr"), (1, "wrong", "en")}


def test_segments_cover_the_text_in_order_with_confidence(spark, ranks):
    docs = spark.createDataFrame([(1, EN[0] + "\n" + DE[0] + "\n" + EN[1], None, 0.1)], SCHEMA)
    got = L.segments(docs, ranks).orderBy("segment_no").collect()
    assert [r.lang for r in got] == ["en", "de", "en"] and all(0.5 < r.confidence <= 1 for r in got)


def test_distance_is_least_for_the_own_language(ranks):
    far, _ = L.distances([L.plain(t[0]) for t in (EN, FR, DE)], ranks)
    assert [L.LANGUAGES[k] for k in far.argmin(axis=1)] == ["en", "fr", "de"]


def test_empty_and_very_long(spark, ranks):
    docs = spark.createDataFrame([], SCHEMA)
    assert L.languages(L.segments(docs, ranks)).count() == 0
    long = spark.createDataFrame([(1, (EN[0] + "\n") * 3000, "en", 0.1)], SCHEMA)
    assert L.languages(L.segments(long, ranks)).first().lang == "en"


HELD_OUT = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(HELD_OUT), reason="no test tables here")
def test_accuracy_on_labelled_rows_outside_the_sample(spark):
    docs = spark.read.parquet(HELD_OUT).withColumn("code", L.label_code(F.col("lang")))
    even = docs.where("doc_id % 2 = 0")
    ranks = L.train(L.labelled_sample(even, 60))
    odd = docs.where("doc_id % 2 = 1 and code in ('en', 'fr', 'es', 'pt', 'de', 'sw')").select("doc_id", "text", F.col("code").alias("label"))
    got = L.languages(L.segments(odd, ranks)).join(odd, "doc_id")
    # Up to a tenth of the labels is wrong by design.
    assert got.where("lang = label").count() >= 0.88 * got.count()


def test_a_language_without_profile_is_unknown_and_makes_no_case(spark, ranks):
    foreign = "Zdrowko wszczyna gwizdek przez krzywy mrok, gdzie szczygly chrzaszcza czekaja juz dlugo wsrod trzcin."
    docs = spark.createDataFrame([(1, foreign, "en", 0.1), (2, EN[0], None, 0.1), (3, None, "en", 0.1), (4, "12 | 3", "en", 0.1)], SCHEMA)
    detected = {r.doc_id: r for r in L.languages(L.segments(docs, ranks), docs).collect()}
    assert detected[1].lang == L.UNKNOWN and detected[2].lang == "en"
    assert detected[3].lang is None and detected[4].lang is None and detected[3].confidence == 0.0 and detected[3].also == []
    assert {(r.doc_id, r.kind) for r in L.found(docs, L.languages(L.segments(docs, ranks))).collect()} == {(2, "missing")}


def test_the_longest_text_of_an_id_counts(spark, ranks):
    docs = spark.createDataFrame([(1, EN[0], None, 0.1), (1, FR[0] + " " + FR[1], None, 0.1), (1, EN[0], None, 0.1)], SCHEMA)
    got = L.chosen(L.segments(docs, ranks)).collect()
    assert {r.lang for r in got} == {"fr"} and len({r.segment_no for r in got}) == len(got)

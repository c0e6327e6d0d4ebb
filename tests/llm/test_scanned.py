import datetime as dt

import pytest

from marlstone.llm import scanned as S

LINES = "line_id bigint, document_version_id string, source string, page_no int, line_no int, text string, from_ocr boolean, confidence double, bbox_top double, bbox_bottom double, kind string, words string"
VERSIONS = "document_version_id string, title string, effective_date date, ingested_at timestamp_ntz, kind string"
BODY = [
    "The nurse must record the temperature of every newborn before the", "infant leaves the labour ward and the respiratory rate is checked by",
    "the nurse again, well before it is known to the ward for safety.", "Record the temperature and the respiratory rate of every infant",
]


def document(name, changes=None, base=0, pages=2, source=None):
    """Pages with a header, four body lines and a page number; changes: (page, line) -> text."""
    rows = []
    for p in range(1, pages + 1):
        lines = [("Handbook of newborn care", 30.0, 8.0), *[(t, 100.0 + 20 * i, 9.5) for i, t in enumerate(BODY)], (f"Page {p} of {pages}", 805.0, 8.0)]
        for n, (text, top, height) in enumerate(lines, 1):
            text = (changes or {}).get((p, n), text)
            rows.append((base + 100 * p + n, name, source or name, p, n, text, None, None, top, top + height, "x", "y"))
    return rows


def scan(spark, rows):
    titles = sorted({r[1] for r in rows if r[1]})
    versions = [(t, "Handbook of newborn care", None, dt.datetime(2025, 1, 1), "z") for t in titles]
    return S.Scan(spark.createDataFrame(rows, LINES), spark.createDataFrame(versions, VERSIONS))


@pytest.fixture(scope="module")
def case(spark):
    rows = []
    for k in range(6):
        rows += document(f"d{k}", base=10_000 * k)
    spoiled = {
        (1, 1): "Handb0ok of newborn care", (1, 2): "The nurse must record the ternperature of every newb0rn before the",
        (1, 3): "infant leaves the labour ward and the respira-", (1, 4): "tory rate of the in­", (1, 5): "fant is checked, well-", (2, 2): "known to the nurse and to the new",
        (2, 3): "born infant of 2l days in the labour ward", (2, 4): "", (2, 5): None,
    }
    rows += document("spoiled", spoiled, base=90_000)
    rows += [rows[0], rows[-1]]
    return scan(spark, rows)


def of(scan_, kind):
    return {r.line_id for r in scan_.found().collect() if r.kind == kind and r.line_id >= 90_000}


def test_furniture(case):
    assert of(case, "running_header") == {90_101, 90_201}
    assert of(case, "page_number") == {90_106, 90_206}


def test_cut_words_but_not_compounds(case):
    assert {90_103, 90_104} <= of(case, "hyphen_break") and 90_105 not in of(case, "hyphen_break")


def test_misread_lines(case):
    assert of(case, "misread") == {90_102, 90_203}


def test_clean_documents_have_furniture_only(case):
    assert {r.kind for r in case.found().collect() if r.line_id < 90_000} == {"running_header", "page_number"}


def test_paragraphs_are_repaired_and_continuous(case):
    text = " ".join(r.text for r in case.paragraphs().where("document_version_id = 'spoiled'").orderBy("page_no", "line_no").collect())
    assert "temperature of every newborn" in text and "respiratory rate of the infant" in text and "Page" not in text and "Handb" not in text


def test_site_lines_are_neither_furniture_nor_misread(spark):
    rows = []
    for k in range(4):
        rows += document(f"d{k}", {(1, 5): "Send this page to a co1league today"}, base=10_000 * k, source="one")
    got = scan(spark, rows)
    marked = {r.line_id for r in got.found().collect()}
    assert not any(10_000 * k + 105 in marked for k in range(4))


def test_empty_and_null_rows(spark):
    rows = document("d0")
    nulls = [(None, None, None, None, None, None, None, None, None, None, None, None), (7, "d0", None, 1, 99, None, None, None, None, None, None, None)]
    got = scan(spark, rows + nulls)
    assert got.found().where("line_id is null").count() == 0
    empty = S.Scan(spark.createDataFrame([], LINES), spark.createDataFrame([], VERSIONS))
    assert empty.found().count() == 0 and empty.paragraphs().count() == 0


def test_weighted_distance():
    assert S.weighted_distance("ternperature", "temperature") == S.CONFUSED_COST
    assert S.weighted_distance("abc", "abd") == 1.0
    assert S.weighted_distance("", "ab") == 2.0


def test_distance_beyond_the_band_is_large_and_long_words_are_quick():
    assert S.weighted_distance("a" * 5, "a" * 40) > 1.5
    assert S.weighted_distance("x" * 3000 + "rn", "x" * 3000 + "m") == S.CONFUSED_COST


def lines_of(spark, texts, ocr=None, confidence=None):
    rows = [(i, f"d{i // 4}", f"s{i // 4}", 1, i % 4, t, ocr, confidence, 100.0 + 20 * (i % 4), 109.5 + 20 * (i % 4), "x", "y") for i, t in enumerate(texts)]
    return scan(spark, rows)


def test_words_longer_than_any_key_of_deletions_are_read(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosispneumonoultra"
    spoiled = long.replace("micro", "micor", 1)[:-4] + "u1tra"
    texts = [f"the word {long} is known here well" for _ in range(40)] + [f"the word {spoiled.replace('micor', 'micro')} is known here", f"the word {long[:20]}x{long[20:]} is known here", "z" * 5000 + " stays as it is here"]
    got = lines_of(spark, texts)
    assert {r.line_id for r in got.found().where("kind = 'misread'").collect()} == {40, 41}


def test_words_of_two_letters_need_a_figure_to_be_misread(spark):
    texts = ["the care of the newborn in the ward is on time to day"] * 30 + ["the care 0f the newborn in the ward", "the care is 0n time to the day", "the care if the newborn ot ward to day", "the ward is 0n the care t0 the day"]
    got = lines_of(spark, texts)
    assert {r.line_id for r in got.found().where("kind = 'misread'").collect()} == {30, 31, 33}


def test_words_of_doubtful_lines_count_less(spark):
    rows = [(True, 0.5), (True, None), (False, None), (None, None), (None, 0.9), (True, 7.0), (True, -1.0), (True, 0.01)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ocr boolean, c double")
    got = [r.t for r in frame.select("i", S.trust(S.F.col("ocr"), S.F.col("c")).alias("t")).orderBy("i").collect()]
    assert got == [50, 80, 100, 100, 90, 80, 80, 25]


def test_part_of_a_known_compound_is_no_number(spark):
    texts = ["the dose of tomavex-b12 in the ward is known"] * 30 + ["of tomavex- the dose b12 is known well here", "the child of 2l days is in the ward here"]
    got = lines_of(spark, texts)
    assert {r.line_id for r in got.found().where("kind = 'misread'").collect()} == {31}

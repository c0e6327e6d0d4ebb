from pyspark.sql import functions as F

from marlstone.operators import chunking as C
from marlstone.operators import documents as D

TEXT = """Preface that belongs to no section.

1 Care
Short words before the table stand here.

| field | limit |
|---|---|
| weight | >= 1500 g |

1.1 count the breaths in full. Then wait. Count them again now.

More prose behind the step.

| a | b |
|---|---|
| 1 | 2 |

2 Criteria for discharge
| limit | note |
|---|---|
| weight >= 1500 g | daily |
"""


def rows_of(spark, texts, profile="clinical_protocol", **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id bigint, text string, document string, section_no int")
    return sorted(D.chunked(docs, "id", "text", F.lit(profile), **kw).collect(), key=lambda r: (r.document, r.ordinal))


def test_document_becomes_chunks_with_parents_tables_and_criteria(spark):
    got = rows_of(spark, [TEXT], cap=8)
    kinds = [(r.chunk_type, r.parent_ordinal, r.section_path) for r in got]
    assert kinds == [
        ("prose", None, "Care"), ("table", 0, "Care"), ("protocol_step", 0, "Care"), ("protocol_step", 0, "Care"),
        ("prose", 0, "Care"), ("table", 2, "Care"), ("criteria", None, "Criteria for discharge"),
    ]
    assert got[1].text.startswith("Care\n\n| field") and got[6].criteria[0].field == "weight" and got[6].criteria[0].value == 1500.0
    assert got[2].split_group_id == got[3].split_group_id is not None and got[0].split_group_id is None
    for r in got:
        plain = r.text.removeprefix(f"{r.heading}\n\n")
        assert TEXT[r.char_start : r.char_end] == plain
    assert got[0].embedding_text == "Care\n\n" + got[0].text and got[4].page_start == got[4].page_end == 1


def test_prose_windows_overlap_within_a_run_only(spark):
    words = "\n\n".join(" ".join(f"w{k}x{i}" for i in range(10)) for k in range(5))
    got = rows_of(spark, [words], most=20)
    assert [r.token_count for r in got] == [20, 23, 13]
    assert got[1].text.startswith("w1x7 w1x8 w1x9\n\nw2x0") and got[1].char_start == words.index("w2x0") - len("w1x7 w1x8 w1x9") - 2
    assert [r.parent_ordinal for r in got] == [None, 0, 0] and got[0].section_path is None


def test_grade_clauses_need_their_mark(spark):
    text = "1.1 strong recommendation to feed early and often\n\n1.2 another clause without"
    assert [r.chunk_type for r in rows_of(spark, [text], "grade_recommendations")] == ["recommendation", "prose"]
    assert [r.chunk_type for r in rows_of(spark, [text], "narrative")] == ["prose"]


def test_empty_null_and_heading_only_texts_have_no_chunk(spark):
    assert rows_of(spark, [None, "", " \n\n ", "1 Heading"]) == []
    docs = spark.createDataFrame([], "id bigint, text string")
    assert D.chunked(docs, "id", "text", F.lit("narrative")).count() == 0


def test_very_long_text_and_repeated_texts(spark):
    long = "\n\n".join(f"paragraph number {i} of a long text" for i in range(800))
    got = rows_of(spark, [long, long])
    assert {r.document for r in got} == {0, 1} and sum(r.token_count for r in got if r.document == 0) >= 800 * 7


BLOCKS = "document string, block_no int, kind string, level int, text string, page_no int, char_start int, char_end int, origin string, confidence double, profile string"


def placed(rows):
    at, out = 0, []
    for i, (kind, level, text, page, origin, conf) in enumerate(rows):
        out.append(("d", i, kind, level, text, page, at, at + len(text or ""), origin, conf, "clinical_protocol"))
        at += len(text or "") + 2
    return out


def test_layout_blocks_carry_provenance(spark):
    rows = placed([
        ("text", None, "before any heading", 1, "text_layer", 1.0), ("heading", 1, "Feeding", 1, "text_layer", 1.0), ("heading", 2, "Early feeds", 1, "text_layer", 1.0),
        ("text", None, "1.1 give 5 ml by tube", 1, "ocr", 0.7), ("text", None, "prose in print", 1, "text_layer", 1.0), ("text", None, "prose from a scan", 2, "ocr", 0.6),
        ("table", None, "a: 1", 2, "text_layer", 1.0), ("flowchart", None, "x -> y", 2, "text_layer", None), ("heading", 1, "Criteria", 3, "text_layer", 1.0), ("table", None, "weight >= 2 kg", 3, "text_layer", 1.0),
    ])
    got = sorted(D.chunked_blocks(spark.createDataFrame(rows, BLOCKS)).collect(), key=lambda r: r.ordinal)
    assert [(r.chunk_type, r.section_path, r.parent_ordinal) for r in got] == [
        ("prose", None, None), ("protocol_step", "Feeding › Early feeds", None), ("prose", "Feeding › Early feeds", 1), ("table", "Feeding › Early feeds", 1),
        ("flowchart", "Feeding › Early feeds", 1), ("criteria", "Criteria", None),
    ]
    assert got[1].review_status == "pending" and got[1].min_confidence == 0.7 and got[2].review_status is None
    assert got[2].origins == ["ocr", "text_layer"] and (got[2].page_start, got[2].page_end) == (1, 2) and got[2].min_confidence == 0.6
    assert got[5].criteria[0].unit == "kg"


def test_covered_pairs_count_once_across_bins(spark):
    w = spark.createDataFrame([("d", 1, 0, 50), ("d", 2, 45, 120), ("e", 3, 0, 10)], "document string, w int, w_start int, w_end int")
    b = spark.createDataFrame([("d", "a", 0, 46), ("d", "b", 46, 100), ("d", "c", 119, 130), ("e", "z", 10, 20)], "document string, b string, b_start int, b_end int")
    got = sorted((r.w, r.b) for r in C.covered(w, b, 10).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")]


ELEMENTS = "document string, element_no bigint, kind string, text string, font_size double, is_bold boolean"


def levels(spark, rows):
    frame = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], ELEMENTS)
    return [(r.kind, r.text, r.level) for r in sorted(C.heading_levels(frame).collect(), key=lambda r: r.element_no)]


def test_levels_by_number_structure_and_false_headings(spark):
    got = levels(spark, [
        ("heading", "Cover", None, None), ("heading", "1.2 Breathing", None, None), ("heading", "Oxygen", None, None), ("text", "Body text.", 10.0, False),
        ("heading", "The nurse who", None, None), ("text", "stands by helps.", 10.0, False), ("heading", "small print", 8.0, False), ("heading", "Small but bold", 8.0, True),
        ("caption", "Table 1.1 Doses", 10.0, False), ("heading", "3 Last", None, None), ("text", "Table 1.1 (continued)", 10.0, False),
    ])
    assert got == [
        ("heading", "Cover", 1), ("heading", "1.2 Breathing", 2), ("heading", "Oxygen", 3), ("text", "Body text.", None), ("text", "The nurse who stands by helps.", None),
        ("text", "small print", None), ("heading", "Small but bold", 3), ("heading", "Table 1.1 Doses", 3), ("heading", "3 Last", 1),
    ]


def test_levels_by_sizes_and_letter_parts(spark):
    rows = [("heading", "A. Outside", 20.0, True), ("heading", "1. First", 20.1, True), ("heading", "1.1 Deeper", 14.0, True), ("heading", "1.2 Deeper", 14.0, True), ("heading", "B. Inside", 20.0, True), ("heading", "2. Second", 20.0, True)]
    assert [r[2] for r in levels(spark, rows)] == [1, 2, 3, 3, 1, 2]
    assert C.heading_levels(spark.createDataFrame([], ELEMENTS)).count() == 0


def test_furniture_by_options_patterns_and_position(spark):
    rows = []
    for p in range(1, 5):
        rows += [("d", "s", p, 10 * p, f"Handbook {p}", 20.0, 30.0, False), ("d", "s", p, 10 * p + 1, f"Section {p} title", 40.0, 52.0, True), ("d", "s", p, 10 * p + 2, f"{p}", 820.0, 830.0, False), ("d", "s", p, 10 * p + 3, "body", 300.0, 310.0, False)]
    rows += [("d", "s", 1, 90, "Printed on Monday", 825.0, 835.0, False), ("d", "s", 2, 91, "give 5 mg", 20.0, 30.0, False), ("e", None, 1, 92, "alone", 20.0, 30.0, False)]
    lines = spark.createDataFrame(rows, "document string, source string, page_no int, line_id bigint, text string, top double, bottom double, is_heading boolean")
    options = spark.createDataFrame([("s", 0.08, 0.5, 3)], "source string, margin_zone double, repeat_ratio double, min_pages int")
    got = {r.line_id: r.reason for r in C.margin_boilerplate(lines, options, {"s": ["^printed on"]}).collect()}
    assert got == {**{10 * p: "repeated" for p in range(1, 5)}, **{10 * p + 1: "running_header" for p in range(1, 5)}, **{10 * p + 2: "repeated" for p in range(1, 5)}, 90: "pattern"}
    assert C.margin_boilerplate(lines.where("false"), options, {}).count() == 0


def test_tables_without_header_or_rows(spark):
    kind = "table_id int, row int, col int, row_span int, col_span int, text string, is_header boolean"
    cells = spark.createDataFrame([(1, 0, 0, 1, 1, "a|b", False), (1, 0, 1, 1, 1, "", False), (1, 1, 0, 1, 2, "both", False), (2, 0, 0, 1, 1, "only head", True)], kind)
    got = {(r.table_id, r.part_no): r.text for r in C.rendered_tables(cells, 100).collect()}
    assert got == {(1, 0): "Column 1: a/b\n\nColumn 1: both\n  Column 2: both"}
    assert len([k for k in ((r.table_id, r.part_no) for r in C.rendered_tables(cells, 3).collect())]) == 2


def test_parts_and_titles_take_headings_under_them():
    nest = lambda *rows: C.nested_levels([r[0] for r in rows], [r[1:] == ("part",) for r in rows], [r[1:] == ("title",) for r in rows])
    assert nest((1, "part"), (1,), (2,), (1, "part"), (1,)) == [1, 2, 3, 1, 2]
    # Members set smaller than the part stay; a heading of a higher rank ends the part.
    assert nest((2, "part"), (3,), (3,), (1,), (2,)) == [2, 3, 3, 1, 2]
    # A title holds the parts behind it until a plain heading of its rank.
    assert nest((2, "title"), (2, "part"), (3,), (2, "part"), (1,), (2, "part")) == [2, 3, 4, 3, 1, 2]
    # A title below an open part belongs to it, one at its rank ends it.
    assert nest((1, "part"), (2, "title"), (2, "part")) == [1, 2, 2] and nest((2, "part"), (2, "title"), (2, "part")) == [2, 2, 3]
    assert nest() == []

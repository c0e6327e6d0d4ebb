import random

from pyspark.sql import functions as F

from marlstone.operators import chunking as C


def test_sections_nest_by_depth_and_close_at_the_next(spark):
    text = "intro\n1 First\nbody\n1.1 Inner\n2. Second\nend"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, text string")
    got = [(r.number, r.path, text[r.char_start : r.char_end]) for r in C.sections(docs, "id", "text").orderBy("section_no").collect()]
    assert got == [("1", "First", "1 First\nbody\n"), ("1.1", "First › Inner", "1.1 Inner\n"), ("2", "Second", "2. Second\nend")]


def test_markdown_sections(spark):
    docs = spark.createDataFrame([("a", "# One\n## 1.2 Two\n# Three")], "id string, text string")
    got = [(r.number, r.heading, r.path) for r in C.sections(docs, "id", "text", markdown=True).orderBy("section_no").collect()]
    assert got == [(None, "One", "One"), ("1.2", "Two", "One › Two"), (None, "Three", "Three")]


def test_packing_is_greedy_and_keeps_order(spark):
    rng = random.Random(3)
    parts = [" ".join("w" * rng.randrange(1, 40)) for _ in range(60)]
    got = spark.range(1).select(C.packed(F.array(*[F.lit(p) for p in parts]), 50).alias("p")).first().p
    want, open_, n = [], [], 0
    for p in parts:
        k = len(p.split())
        if open_ and n + k > 50:
            want.append(open_)
            open_, n = [], 0
        open_.append(p)
        n += k
    assert got == [*want, open_]


def test_windows_overlap_by_the_tail_of_the_last(spark):
    docs = spark.createDataFrame([(1, ["a b c d e f g h i j", "k l m n o", "p q"]), (2, [])], "id bigint, ps array<string>")
    got = C.prose_windows(docs, "id", F.col("ps"), most=10, overlap=0.15).orderBy("window_no").collect()
    assert [(r.n_words, r.n_overlap) for r in got] == [(10, 0), (7, 2)] and got[1].text.startswith("i j\n\n")


def test_tables_and_criteria(spark):
    assert spark.range(1).select(C.is_table(F.lit("| a | b |\n|---|---|\n| 1 | 2 |")).alias("x")).first().x
    assert not spark.range(1).select(C.is_table(F.lit("plain\ntext")).alias("x")).first().x
    found = spark.range(1).select(C.criteria(F.lit("rate >= 60 bpm, temp < 36.5")).alias("x")).first().x
    assert [(c.field, c.operator, c.value, c.unit) for c in found] == [("rate", ">=", 60.0, "bpm"), ("temp", "<", 36.5, None)]


def test_lineage_prefers_identical_text_then_containment(spark):
    old = spark.createDataFrame([("d", "o1", 0, "alpha beta gamma"), ("d", "o2", 1, "delta epsilon zeta eta"), ("d", "o3", 2, "nothing alike here")], "document string, chunk_id string, ordinal int, text string")
    new = spark.createDataFrame([("d", "n1", 0, "alpha  beta gamma"), ("d", "n2", 1, "delta epsilon zeta theta"), ("d", "n3", 2, "delta")], "document string, chunk_id string, ordinal int, text string")
    words = F.array_distinct(F.split("text", r"\s+"))
    got = {(r.old_id, r.new_id, r.score) for r in C.lineage(old, new, words).collect()}
    assert got == {("o1", "n1", 1.0), ("o2", "n2", 0.75)}


def test_gold_is_remapped(spark):
    gold = spark.createDataFrame([("q", ["a", "b", "c"]), ("e", [])], "query_id string, gold array<string>")
    links = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5)], "old_id string, new_id string, score double")
    again = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert {r.query_id: r.gold for r in C.remapped(gold, links, again).collect()} == {"q": ["c", "x", "y"], "e": []}


def test_corrections_must_fit_once(spark):
    texts = spark.createDataFrame([("a", "one two two"), ("b", "x")], "doc_id string, text string")
    fixes = spark.createDataFrame([("a", "1", "one", "1", False), ("a", "2", "two", "2", False), ("a", "3", "two", "2", True)], "doc_id string, correction_id string, original string, corrected string, every boolean")
    got = {r.doc_id: (r.text, r.applied, r.failed) for r in C.apply_corrections(texts, fixes).collect()}
    assert got == {"a": ("1 2 2", ["1", "3"], ["2"]), "b": ("x", [], [])}


def test_every_block_must_be_in_one_chunk_of_the_superseded_version(spark, tmp_path):
    from marlstone.plans import registry

    chunks = [("o1", "v1", "head\n\none\n\ntwo"), ("o2", "v1", "head\n\nother"), ("n1", "v2", "head\n\ntwo"), ("n2", "v2", "head\n\nnew")]
    spark.createDataFrame(chunks, "chunk_id string, document_version_id string, text string").write.parquet(str(tmp_path / "chunk.parquet"))
    versions = [("v1", None), ("v2", "v1")]
    spark.createDataFrame(versions, "document_version_id string, supersedes_id string").write.parquet(str(tmp_path / "document_version.parquet"))
    rows = registry.queries()["chk14_carried_over"](spark, str(tmp_path)).collect()
    assert {r.chunk_id: r.confirmed_id for r in rows} == {"n1": "o1", "n2": None}

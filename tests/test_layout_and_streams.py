import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import layout as L
from marlstone.sources import documents as D
from marlstone.streaming import limiter


def test_boxes_of_a_grid(spark):
    lines = [(0, y, 30, y) for y in (0, 10, 20)] + [(x, 0, x, 20) for x in (0, 15, 30)]
    rules = spark.createDataFrame([("p", *map(float, r)) for r in lines] + [("q", 0.0, 0.0, 9.0, 0.0)], "page_id string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.x0, r.top, r.x1, r.bottom) for r in L.boxes(rules).where("page_id = 'p'").orderBy("box_no").collect()]
    assert got == [(0, 0, 15, 10), (15, 0, 30, 10), (0, 10, 15, 20), (15, 10, 30, 20)]
    assert L.boxes(rules.where("page_id = 'q'")).count() == 0


def test_edges_chain_and_take_the_nearest_label(spark):
    shapes = [("box", "A", 0, 0, 50, 20), ("box", "B", 0, 100, 50, 120), ("box", "C", 200, 100, 250, 120), ("line", "1", 25, 22, 25, 60), ("line", "2", 25, 60, 25, 98),
              ("line", "3", 52, 10, 225, 10), ("line", "4", 225, 10, 225, 99), ("line", "5", 300, 300, 310, 310), ("label", "Yes", 30, 60, 40, 70), ("label", "No", 230, 50, 240, 60)]
    frame = spark.createDataFrame([("p", k, i, *map(float, r)) for k, i, *r in shapes], "page_id string, kind string, id string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.source, r.target, r.label) for r in L.flow_edges(frame).collect()} == {("A", "B", "Yes"), ("A", "C", "No")}


def test_words_cut_by_a_box_are_completed():
    assert L.complete_words("spiratory ra", "the respiratory rate is") == "respiratory rate"
    assert L.complete_words("x", "") == "x" and L.complete_words("", "abc") == ""


def test_stream_folds_like_the_batch_over_two_files(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("k", t(0), True), ("k", t(10), True), ("j", t(5), True), (None, t(1), True)]
    more = [("k", t(899), True), ("k", t(900), True), ("k", t(901), False), ("k", t(902), True)]
    schema = "u string, at timestamp, f boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(more, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = limiter.drained(limiter.limited(stream, "u", "at", "f", 2, 900), str(tmp_path), "out")
    got = [(r.k, r["count"], r.blocked) for r in out.orderBy("k", "t").collect()]
    assert len(got) == 6 and got[0] == ("j", 1, False) and [g[1] for g in got if g[0] == "k"][-1] == 1


def test_window_counts_over_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1, h, m), "x") for h in range(4) for m in (0, 30)]
    spark.createDataFrame(rows, "at timestamp, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, kind string").parquet(f"{tmp_path}/in")
    out = limiter.drained(limiter.counts(stream, "at", "kind"), str(tmp_path), "out")
    assert out.agg(F.sum("n")).first()[0] <= 8


def test_files_that_do_not_parse_give_page_zero(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one|two")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    got = {(r.path.rsplit("/", 1)[1], r.page_no, r.text) for r in D.parsed_files(spark, str(tmp_path), lambda b: b.decode().split("|"), "*.bin").collect()}
    assert got == {("a.bin", 1, "one"), ("a.bin", 2, "two"), ("b.bin", 0, None)}


def test_encoder_loads_once_and_takes_nulls(spark):
    encode = D.encoder(lambda: lambda texts: [[float(len(t))] for t in texts])
    frame = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r.v for r in frame.select(encode("t").alias("v")).collect()] == [[3.0], [0.0]]


def test_settings_fail_closed():
    entry = {"id": "a", "by": "x"}
    assert D.attested([entry], ["id", "by"], "id") == [entry]
    for bad in ([{"id": "a", "by": " "}], [{"id": "a", "by": "TODO x"}], [{"id": "a"}], [entry, entry]):
        with pytest.raises(D.Incomplete):
            D.attested(bad, ["id", "by"], "id")


def test_a_large_flowchart_in_time_that_grows_with_its_shapes():
    # Boxes in rows of a hundred, each with a connector down that has an arrowhead and a label; a frame around them all; compared pair
    # by pair, they took over a minute.
    rows = [("box", "frame", -1000.0, -1000.0, 21000.0, -990.0)]
    for i in range(8000):
        x, y = 200.0 * (i % 100), 100.0 * (i // 100)
        rows.append(("box", str(i), x, y, x + 100, y + 40))
        if i < 7900:
            rows += [("line", f"{i}a", x + 50, y + 43, x + 50, y + 70), ("line", f"{i}b", x + 50, y + 70, x + 50, y + 98)]
            rows += [("head", f"{i}h", x + 50, y + 99, 0.0, 0.0), ("label", f"l{i}", x + 58, y + 70, 0.0, 0.0)]
    began = time.process_time()
    got = L._edges(("p",), pd.DataFrame(rows, columns=["kind", "id", "x0", "y0", "x1", "y1"]))
    assert time.process_time() - began < 20
    assert {(r.source, r.target, r.label, r.verified) for r in got.itertuples()} == {(str(i), str(i + 100), f"l{i}", True) for i in range(7900)}

"""Readers, writers and streams on small files, with a restart."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from affinis import sources, streaming
from affinis.operators import clustering, sketches
from affinis.sources import sinks


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().split("\n")[:-1]]


def test_json_and_csv_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"business_id": "b", "user_id": "u", "stars": 4.5, "text": "x", "date": "2018-01-02", "more": 1}\n')
    assert tuple(sources.json_lines(spark, str(tmp_path / "r.json"), sources.REVIEW).first()) == ("b", "u", 4.5, "x", "2018-01-02")
    (tmp_path / "p.csv").write_text("user_id,business_id\nu1,b1\n")
    assert [tuple(r) for r in sources.headered_csv(spark, str(tmp_path / "p.csv")).collect()] == [("u1", "b1")]
    (tmp_path / "bad.json").write_text("not json\n")
    with pytest.raises(Exception):
        sources.json_lines(spark, str(tmp_path / "bad.json"), sources.REVIEW).collect()
    (tmp_path / "stop").write_text("the\n a \n\nthe\n")
    assert {r.word for r in sources.word_list(spark, str(tmp_path / "stop")).collect()} == {"the", "a"}


def test_models_are_read_as_they_were_written(spark, tmp_path):
    model = spark.createDataFrame([("a", "b", 0.5)], sources.ITEM_MODEL)
    sinks.json_lines(model, str(tmp_path / "m"))
    assert sources.json_lines(spark, str(tmp_path / "m"), sources.ITEM_MODEL).collect() == model.collect()
    profiles = spark.createDataFrame([("u", "user", [1, 2]), ("b", "business", [3])], sources.PROFILE)
    sinks.profiles(profiles, str(tmp_path / "p"))
    assert sorted(sources.json_lines(spark, str(tmp_path / "p"), sources.PROFILE).select("id", "type", "vector").collect()) == sorted(profiles.collect())
    sinks.csv(model, str(tmp_path / "c"))
    assert sources.headered_csv(spark, str(tmp_path / "c"), sources.ITEM_MODEL).collect() == model.collect()


def test_text_reports(spark, tmp_path):
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "items array<string>")
    sinks.itemset_report(sets, sets.where(F.size("items") == 2), str(tmp_path / "i"))
    assert lines(tmp_path / "i") == ["Candidates:", "('a'),('b')", "", "('a', 'b')", "", "Frequent Itemsets:", "('a', 'b')", ""]
    sinks.edge_values(spark.createDataFrame([(1, 2, 1.0), (1, 3, 4.5)], "u long, v long, value double"), str(tmp_path / "e"))
    assert lines(tmp_path / "e") == ["('1', '3'), 4.5", "('1', '2'), 1.0"]
    sinks.lines(spark.createDataFrame([(["a", "b"],)], "members array<string>"), str(tmp_path / "l"))
    assert lines(tmp_path / "l") == ["'a', 'b'"]
    assert json.loads(sinks.report(n=spark.createDataFrame([(1,)], "x long"))) == {"n": [{"x": 1}]}


def test_bloom_flags_keep_the_input_order(spark, tmp_path):
    (tmp_path / "probe").write_text("\n".join(["in1", "zzz-not-there", "in2", ""]) + "\n")
    built = sketches.bloom_build(spark.createDataFrame([("in1",), ("in2",)], "s string"), "s")
    probes = sources.numbered(spark.read.text(str(tmp_path / "probe"))).withColumnRenamed("value", "s")
    sinks.flags(sketches.bloom_flags(probes, "s", built, "row"), str(tmp_path / "out"))
    assert lines(tmp_path / "out") == ["1", "0", "1", "0"]


def test_bfr_takes_the_files_of_a_folder_in_order(spark, tmp_path):
    folder = tmp_path / "points"
    folder.mkdir()
    for n in (1, 0):
        (folder / f"data{n}.txt").write_text("".join(f"p{n}-{k},{10.0 * (k % 2) + k / 100},{k % 3}\n" for k in range(20 + n)))
    assigned, report = clustering.bfr_folder(spark, str(folder), 2)
    assert assigned.select("id").distinct().count() == 41
    seen = [r.nof_point_discard + r.nof_point_compression + r.nof_point_retained for r in report.orderBy("round_id").collect()]
    assert seen == [20, 41]
    sinks.clusters(assigned, report, str(tmp_path / "out"))
    assert len(lines(tmp_path / "out" / "clusters")) == 41 and lines(tmp_path / "out" / "rounds")[0].startswith("round_id,")


def events(spark, folder, number, rows):
    spark.createDataFrame(rows, "key long, tag string, ts timestamp").coalesce(1).write.parquet(f"{folder}/in{number}")
    for f in glob.glob(f"{folder}/in{number}/part-*"):
        (folder / "stream").mkdir(exist_ok=True)
        __import__("shutil").move(f, folder / "stream" / f"{number}.parquet")


def test_windows_are_appended_and_go_on_after_a_restart(spark, tmp_path):
    t = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    schema = "key long, tag string, ts timestamp"
    for number, rows in enumerate([[(1, "a", t(1)), (2, "a", t(2)), (1, "b", t(3))], [(3, "a", t(4)), (4, "c", t(45))]]):
        events(spark, tmp_path, number, rows)
        found = sources.keyword_stream(sources.file_stream(spark, str(tmp_path / "stream"), schema, "*.parquet"), "tag", ["A", "b", "c"])
        counts = streaming.stream_distinct(found, "key", True)
        streaming.append_csv(counts, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    last = {r.start: int(r.n) for r in got.orderBy("batch").collect()}
    assert got.select("batch").distinct().count() == 2
    assert sorted(last.values()) == [1, 1, 1, 3, 3, 3]


def test_the_reservoir_is_kept_over_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema, seen = "key long, tag string, ts timestamp", []
    when = __import__("datetime").datetime(2024, 1, 1)
    for number in range(2):
        events(spark, tmp_path, number, [(k, f"t{k % 3}", when) for k in range(number * 50, number * 50 + 50)])
        sample = streaming.reservoir_stream(sources.file_stream(spark, str(tmp_path / "stream"), schema, "*.parquet"), "key", 10)
        writer = sample.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.append(sorted((r.key, r.tag, r.n) for r in b.collect())))
        streaming.started(writer, str(tmp_path / "checkpoint")).awaitTermination()
    for upto, got in zip((50, 100), [s for s in seen if s], strict=True):
        want = sorted(range(upto), key=lambda k: ((k * 7919 + 104729) % 149399, k))[:10]
        assert [k for k, _, _ in got] == sorted(want)
        assert all(n == sum(x % 3 == k % 3 for x in want) and t == f"t{k % 3}" for k, t, n in got)

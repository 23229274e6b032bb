import json
import os
import time
from datetime import UTC, datetime, timedelta

from glyphtrail.functions import lexicon as L
from glyphtrail.sources import files
from glyphtrail.sources import tables as S
from glyphtrail.streaming import ingest

from .conftest import SF


def test_sheet_round_trip(spark, tmp_path):
    schema = "key string, sentence string, label string"
    rows = [("a", 'He said "no",\nthen left', "x;y"), ("b", "é, ü", None)]
    files.write_sheet(spark.createDataFrame([(*r, 1) for r in rows], schema + ", extra int"), str(tmp_path / "s"), ["key", "sentence", "label"])
    back = files.read_sheet(spark, str(tmp_path / "s"), schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_sheet_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿key,sentence\nk1,\"two\nlines\"\n", encoding="utf-8")
    got = files.read_sheet(spark, str(tmp_path / "b.csv"), "key string, sentence string").collect()
    assert [tuple(r) for r in got] == [("k1", "two\nlines")]


def test_json_dir(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"key": f"k{i}", "sims": {"a": i / 2}}, indent=1))
    (tmp_path / "note.txt").write_text("no")
    got = files.json_dir(spark, str(tmp_path), "key string, sims map<string,double>")
    assert sorted((r.key, r.sims["a"]) for r in got.collect()) == [("k0", 0.0), ("k1", 0.5), ("k2", 1.0)]


def test_checkpoint_appends_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "ck")
    rows = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "key string, v int")
    assert files.append_checkpoint(rows("a", "b", "a"), path, "key") == 2
    assert files.append_checkpoint(rows("b", "c"), path, "key") == 1
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    assert [r.key for r in files.missing(rows("c", "d"), spark.read.parquet(path), "key").collect()] == ["d"]


def test_history(spark, tmp_path):
    path, start = str(tmp_path / "h"), datetime(2024, 5, 1, 12, tzinfo=UTC)
    trace = {"model": "m", "question": "What now?", "pretraining": {"matched_spans": [{"words": 5}, {"words": 7}]}}
    ids = [files.save_history(spark, path, trace, start + timedelta(milliseconds=i)) for i in range(3)]
    assert [r.id for r in files.list_history(spark, path).collect()] == ids[::-1]
    got = files.load_history(spark, path, ids[1])
    assert (got["slug"], got["n_spans"], got["longest"], got["trace"]) == ("what-now", 2, 7, trace)
    assert files.delete_history(spark, path, ids[1]) and not files.delete_history(spark, path, ids[1])
    assert files.load_history(spark, path, ids[1]) is None and files.list_history(spark, path).count() == 2


def test_capped_scan_and_digests(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "t"))
    df, used, there = files.capped_scan(spark, str(tmp_path / "t"), 2)
    assert (used, there) == (2, 4) and 0 < df.count() < 100
    assert files.capped_scan(spark, str(tmp_path / "t"), None)[0].count() == 100
    assert files.file_digests(spark, f"{tmp_path}/t/*.parquet").count() == 4


def test_shard_of_part_files_is_read_whole(spark, tmp_path):
    from glyphtrail.plans import REGISTRY

    S.table(spark, SF, "documents").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda d: REGISTRY["shard_cap_scan"][0](spark, d).collect()
    assert rows(str(tmp_path)) == rows(SF)
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    df, used, there = files.capped_scan(spark, [str(tmp_path / "b"), str(tmp_path / "a")], 1)
    assert (df.count(), used, there) == (7, 1, 2)


def test_pairs_separator(spark):
    turns = spark.createDataFrame([(1, t, "assistant", f"w{t}") for t in range(3)] + [(2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = S.preference_pairs(turns).collect()
    assert [(r.conv_id, r.chosen_text, r.rejected_text) for r in got] == [(1, "w0\\nw2", "w1")]


def test_stream_drops_repeats(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    answer = lambda k, t: json.dumps({"key": k, "model": "m", "stage": "sft", "question": "q", "answer": "of the and the", "generated_at": t})
    for i, k in enumerate(["a", "b", "a"]):
        (source / f"{i}.json").write_text(answer(k, f"2024-01-01T0{i}:00:00Z"))
        os.utime(source / f"{i}.json", (time.time() + i, time.time() + i))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        q = ingest.write_once(ingest.flagged(ingest.new_answers(ingest.answer_stream(spark, str(source))), L.DEMO), out, check)
        q.awaitTermination(120)
        (source / "9.json").write_text(answer("b", "2024-01-01T03:00:00Z"))
    got = spark.read.parquet(out).collect()
    assert sorted(r.key for r in got) == ["a", "b"]
    assert got[0].categories == ["disclaimer", "empathy_opener"] and got[0].n_words == 4


def test_stream_windows_equal_batch(spark, tmp_path):
    events = S.table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((str(r.window_start), r.event_type, r.n, r.max_value) for r in df.collect())
    assert rows(spark.table("windows")) == rows(ingest.tumbling(events))

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairgauge import fix, sources, streaming
from pairgauge.functions import xml
from pairgauge.operators import formats
from pairgauge.streaming.logs import snapshot


def test_xml_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.dita").write_text("<t>é</t>", encoding="utf-8")
    (tmp_path / "a" / "b" / "y.dita").write_bytes(b"<t>\xff</t>")
    (tmp_path / "a" / "z.txt").write_text("no")
    got = {r.path: (r.raw, r.n_bytes) for r in sources.xml_files(spark, str(tmp_path / "a")).collect()}
    assert got == {"x.dita": ("<t>é</t>", 9), "b/y.dita": ("<t>�</t>", 8)}


def test_json_block_and_shards(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"id": "a", "n": 1}]))
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [{"id": "b", "n": 2}]}))
    got = sources.documents_with_rows(spark, [str(tmp_path / "list.json"), str(tmp_path / "rows.json")], "id string, n int").select("id", "n")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "refs.txt").write_text("intro\n### one\nun\ndeux\n\n### two\n x \n### one\nneuf\n")
    assert {r.id: r.fr for r in sources.block_text(spark, str(tmp_path / "refs.txt")).collect()} == {"one": "neuf", "two": "x"}
    (tmp_path / "test_outputs.jsonl").write_text('{"id":"a"}\n\n{"id":"b"}\n')
    s = sources.shards(spark, str(tmp_path / "*_outputs.jsonl"), "id string")
    assert sorted((r.id, r.split) for r in s.collect()) == [("a", "test"), ("b", "test")]
    out = str(tmp_path / "out")
    nested = spark.createDataFrame([(1, (2, [(3, 4)]), {"z": 1, "y": 2})], "b int, a struct<q:int,p:array<struct<n:int,m:int>>>, c map<string,int>")
    sources.write_jsonl(nested, out, sort=True)
    assert spark.read.text(out).first().value == '{"a":{"p":[{"m":4,"n":3}],"q":2},"b":1,"c":{"y":2,"z":1}}'
    assert sources.content_manifest(spark, out).filter("n_bytes > 0").count() == 1
    assert sources.first_existing("NONE", str(tmp_path / "no"), str(tmp_path), environment={}) == str(tmp_path)


def test_appends_documents_and_shards(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.createDataFrame([(0, "a"), (1, "b")], "shard int, id string")
    sources.append_rows(rows, log)
    sources.append_rows(rows.limit(1), log)
    assert sorted(map(tuple, sources.jsonl(spark, log, "id string, shard int").collect())) == [("a", 0), ("a", 0), ("b", 1)]
    stream = spark.readStream.schema("id string, shard int").json(log)
    for _ in range(2):  # what was appended is not appended again
        sources.append_stream(stream, str(tmp_path / "copy"), str(tmp_path / "check")).awaitTermination()
    assert sources.jsonl(spark, str(tmp_path / "copy"), "id string, shard int").count() == 3
    sources.write_json_document(rows, str(tmp_path / "doc"))
    assert sources.documents_with_rows(spark, str(tmp_path / "doc"), "shard int, id string").count() == 2
    with pytest.raises(ValueError, match="more than 1 rows"):
        sources.write_json_document(rows, str(tmp_path / "doc"), most=1)
    sources.write_shards(rows, str(tmp_path / "shards"))
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {"shard=0", "shard=1"}


def test_files_to_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.dita").write_text("<t>a : b</t>", encoding="utf-8")
    (tmp_path / "in" / "b.dita").write_text("<t>a", encoding="utf-8")
    files = sources.xml_files(spark, str(tmp_path / "in"), revision="r7")
    assert {r.revision for r in files.collect()} == {"r7"}
    sources.transform_files(files, xml.fix_aligned(F.col("raw")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub" / "a.dita").read_text(encoding="utf-8") == "<t>a\u00a0: b</t>"
    assert (tmp_path / "out" / "b.dita").read_text(encoding="utf-8") == "<t>a" and not list(tmp_path.glob("out/**/*.part"))
    assert fix.main([str(tmp_path / "in" / "sub" / "a.dita"), str(tmp_path / "one")]) == 0 and fix.main(["x"]) == 2
    assert (tmp_path / "one").read_text(encoding="utf-8") == "<t>a\u00a0: b</t>"
    p = subprocess.run([sys.executable, "-m", "pairgauge.fix", "--simple"], input="<t>c ! d</t>".encode(), capture_output=True, cwd=Path(__file__).parents[1])
    assert p.stdout.decode() == "<t>c\u00a0! d</t>"


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"run": {"seed": 5, "cap": 1.5}, "note": "x"}))
    defaults = {"run": {"seed": 1, "cap": 0.5, "dry": False}, "names": ["a"]}
    assert sources.settings(defaults) == {"run.seed": 1, "run.cap": 0.5, "run.dry": False, "names": ["a"]}
    got = sources.settings(defaults, str(tmp_path / "c.json"), {"PAIRGAUGE_RUN_SEED": "7", "PAIRGAUGE_RUN_DRY": "on"}, arguments=["--run.cap", "2", "--names=b,c"])
    assert got == {"run.seed": 7, "run.cap": 2.0, "run.dry": True, "names": ["b", "c"], "note": "x"}
    spark.conf.set("pairgauge.run.seed", "9")
    assert sources.settings(defaults, environment={"PAIRGAUGE_RUN_SEED": "7"}, spark=spark)["run.seed"] == 9
    spark.conf.unset("pairgauge.run.seed")
    for bad in (["--run.seed"], ["--run.seed", "x"], ["--other", "1"], ["run.seed"]):
        with pytest.raises(ValueError):
            sources.settings(defaults, arguments=bad)
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"run": {"seed": 3}}))
    assert sources.settings(defaults, str(tmp_path / "c.yaml"))["run.seed"] == 3


def test_validator(spark, tmp_path):
    tool = tmp_path / "tool.py"
    tool.write_text("import sys\nt = sys.stdin.read()\nn = t.count('bad')\nfor _ in range(n): print('x:1: validity error : bad', file=sys.stderr)\nsys.exit(3 if n or not t else 0)\n")
    docs = spark.createDataFrame([(1, "<t/>"), (2, "<t>bad bad</t>"), (3, None)], "id int, hyp string")
    check = xml.validator((sys.executable, str(tool)))
    got = {r.id: (r.v.ok, r.v.n_errors) for r in docs.select("id", check(F.col("hyp")).alias("v")).collect()}
    assert got == {1: (True, 0), 2: (False, 2), 3: (False, 1)}
    lost = xml.validator(("no-such-command",), catalog=str(tmp_path / "none"))
    assert {(r.v.ok, r.v.n_errors, r.v.message[:15]) for r in docs.select(lost(F.col("hyp")).alias("v")).collect()} == {(False, 1, "missing catalog")}
    pairs = docs.filter("id < 3").withColumn("src", F.col("hyp")).withColumn("errors", check(F.col("hyp"))["n_errors"])
    assert {r.id: (r.dtd_valid, r.reasons) for r in formats.score_format(pairs, dtd_errors="errors").collect()} == {1: (True, []), 2: (False, ["dtd_invalid"])}


def _log(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_budget_fires_once(spark, tmp_path):
    for k in range(3):
        _log(tmp_path / "log", f"{k}.json", [{"stage": "a", "rate": 1.0, "seconds": 3600.0}, {"stage": "b", "rate": 1.0, "seconds": 10.0}])
    events = spark.readStream.schema("stage string, rate double, seconds double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    q = streaming.budget_alerts(events, "stage", 2.0).writeStream.format("memory").queryName("alerts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("alerts").collect()] == [("a", 2.0)]


def test_idle_states_are_dropped(spark, tmp_path):
    """A stage that is heard of again after the idle time starts anew."""
    # a state is dropped by the batch after the one whose time passes its end
    for k, day in enumerate(("2024-01-01", "2024-06-01", "2024-06-02", "2024-06-03")):
        _log(tmp_path / "log", f"{k}.json", [{"stage": "abca"[k], "rate": 1.0, "seconds": 7200.0, "ts": f"{day}T00:00:00Z"}])
        os.utime(tmp_path / "log" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    events = spark.readStream.schema("stage string, rate double, seconds double, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    q = streaming.budget_alerts(events, "stage", 2.0, ts="ts").writeStream.format("memory").queryName("idle").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("idle").collect())) == [("a", 2.0), ("a", 2.0), ("b", 2.0), ("c", 2.0)]


def test_tail_replay_windows_and_snapshot(spark, tmp_path):
    _log(tmp_path / "log", "0.json", [{"event": "s", "t": "1704067200.0", "step": 1, "value": 1.0}, {"event": "s", "t": "2024-01-01T00:30:00Z", "step": 2, "value": 2.0}])
    _log(tmp_path / "log", "1.json", [{"event": "s", "t": "2024-01-01T00:31:00", "step": 2, "value": 5.0}, {"event": "d", "t": "2024-01-01T01:00:00Z", "step": 3, "value": 3.0}])
    log = streaming.tail(spark, str(tmp_path / "log"))
    q = streaming.replay(log).writeStream.format("memory").queryName("replayed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    # the last row of a step that was told twice
    assert sorted((r.step, r.value) for r in spark.table("replayed").collect()) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    again = spark.createDataFrame([(1, 5, 0.0), (1, 7, 2.0), (1, 7, 1.0)], "step long, ts long, value double")
    assert tuple(streaming.replay(again, order=("ts", "value")).first()) == (1, 7, 2.0)
    q = snapshot(streaming.progress(streaming.tail(spark, str(tmp_path / "log")), "event", F.col("value") > 1), str(tmp_path / "snap"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "snap")).collect())) == [("d", 1, 1), ("s", 3, 2)]


def test_scan_stops_at_target(spark, tmp_path):
    for k in range(3):
        _log(tmp_path / "log", f"{k}.json", [{"run": "r", "hit": i % 2 == 0, "place": 4 * k + i} for i in range(4)])
    events = spark.readStream.schema("run string, hit boolean, place long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    q = streaming.scan_progress(events, "run", "hit", 3).writeStream.format("memory").queryName("scan").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.table("scan").orderBy("scanned").collect()] == [(4, 2, False), (5, 3, True), (5, 3, True)]
    batch = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 5.0), ("g", 3, 5.0)], "g string, step long, m double")
    assert tuple(streaming.best_so_far(batch, "g", "m").first()) == ("g", 2, 5.0)

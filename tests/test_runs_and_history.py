"""Streams of frames with tokens, and edit logs replayed."""

import random

import duckdb
import pytest

from brakta.operators import history
from brakta.streaming import runs

FRAMES = "page long, token long, kind string, payload string, at long, seq long"


def plain_runs(frames):
    out = {}
    for page, token, kind, payload, _, _ in sorted(frames, key=lambda f: f[4:]):
        run, dropped = out.setdefault(page, [runs.Run(None), 0])
        out[page][1] = dropped + (not run.take(token, kind, payload))
    return {(p, r.token, r.frames, r.stage, r.result, r.error, d) for p, (r, d) in out.items()}


def test_a_run_ends_when_a_later_one_begins():
    run = runs.Run(None)
    assert run.take(1, "ocr_started", None) and run.take(1, "done", "first") and not run.take(1, "late", None)
    assert run.take(3, "ocr_started", None) and not run.take(2, "done", "old") and run.result == "first"
    assert run.take(3, "error", "broken") and (run.stage, run.result, run.error) == ("error", "first", "broken")
    assert run.take(4, "ocr_started", None) and run.error is None
    assert run.take(5, "cancel", None) and run.stage == "idle" and not run.take(4, "done", "late") and run.result == "first"


def test_a_restart_goes_on_with_the_state(spark, tmp_path):
    rng = random.Random(3)
    frames = [(rng.randrange(5), i // 40 + rng.randrange(3), rng.choice(["ocr_started", "ocr_done", "detection_started", "done", "error", "cancel"]), f"p{i}", i, i) for i in range(400)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: spark.readStream.schema(FRAMES).parquet(src)
    for part in (frames[:150], frames[150:151], frames[151:]):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(src)
        runs.write_latest(spark, stream(), out, state)
    runs.write_latest(spark, stream(), out, state)  # nothing new
    changes = spark.read.parquet(out)
    got = {(r.page, r.token, r.frames, r.stage, r.result, r.error, r.dropped) for r in runs.now(changes).collect()}
    assert got == plain_runs(frames)
    assert changes.groupBy("page", "version").count().filter("count > 1").count() == 0


def plain_history(log, limit):
    out, pages = set(), {}
    for page, version, kind, _ in sorted(log, key=lambda e: (str(e[0]), e[3], e[1])):
        p = pages.setdefault(page, {"shown": None, "undo": [], "redo": []})
        before = p["shown"]
        if kind == "edit":
            p["undo"] = [*p["undo"], before][-limit:]
            p["redo"], p["shown"] = [], version
        elif kind == "undo" and p["undo"]:
            p["redo"].append(before)
            p["shown"] = p["undo"].pop()
        elif kind == "redo" and p["redo"]:
            p["undo"].append(before)
            p["shown"] = p["redo"].pop()
        out.add((page, version, kind, p["shown"], before, bool(p["undo"]), bool(p["redo"])))
    return out


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_histories_are_replayed_in_order(spark, limit):
    rng = random.Random(limit)
    log = [(rng.choice([1, 2, 3, None]), i, rng.choice(["edit", "edit", "undo", "undo", "redo", "other", None]), rng.randrange(50)) for i in range(600)]
    log += [(9, 1000 + i, "edit", i) for i in range(150)] + [(9, 2000 + i, "undo", 200 + i) for i in range(120)] + [(9, 3000 + i, "redo", 400 + i) for i in range(110)]
    df = spark.createDataFrame(log, "page long, version long, kind string, at long").repartition(5)
    got = {tuple(r) for r in history.versions(df, "page", ["at"], "kind", "version", limit).collect()}
    assert got == plain_history(log, limit)
    con = duckdb.connect()
    con.execute("CREATE TABLE log (page BIGINT, version BIGINT, kind VARCHAR, moment BIGINT)")
    con.executemany("INSERT INTO log VALUES (?, ?, ?, ?)", [e for e in log if e[0] is not None])
    assert set(con.sql(history.sql("log", "page", "moment", limit)).fetchall()) == {r for r in got if r[0] is not None}
    assert history.versions(df.limit(0), "page", ["at"], "kind", "version").collect() == []

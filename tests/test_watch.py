"""Ends, silence and death of runs: one go, many batches and a restart against a plain fold."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

from millrace.streaming import watch

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(events, idle, dead):
    """Reports (run, kind, seq, seconds, made_up) of events (run, seq, kind, seconds)."""
    end, out = max(e[3] for e in events), []
    for run in {e[0] for e in events}:
        state = None
        own = sorted((e for e in events if e[0] == run), key=lambda e: (e[3], e[1]))
        for _, seq, kind, at in [*own, (run, None, None, end)]:
            told = False
            if state and not state["closed"]:
                if seq is None and at <= state["last"]:
                    continue
                if at - state["last"] > idle:
                    out.append((run, "idle", state["seq"], state["last"] + idle, True))
                if at - state["last"] > dead:
                    out.append((run, "failed", state["seq"], state["last"] + dead, True))
                    state |= {"closed": True, "last": state["last"] + dead}
            if seq is None or (state and state["closed"] and at - state["last"] <= dead):
                continue
            state = {"seq": seq, "last": at, "closed": kind in ("done", "failed")}
            if state["closed"]:
                out.append((run, kind, seq, at, told))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    events, at = [], 0
    for seq in range(240):
        at += rng.choice([0, 1, 1, 2, 30])
        run = rng.randrange(6)
        kind = rng.choice(["note", "note", "file_complete", "done" if rng.random() < 0.3 else "note", "failed" if rng.random() < 0.1 else "note"])
        events.append((run, seq, kind, at))
        if kind == "done" and rng.random() < 0.5:
            events.append((run, seq + 1000, "done", at + 1))  # an end that is told again
            at += 1
    return events


def write(folder, name, events):
    with open(os.path.join(folder, name), "w") as f:
        for run, seq, kind, at in events:
            f.write(json.dumps({"run_id": run, "seq": seq, "kind": kind, "stage": "x", "ts": (START + timedelta(seconds=at)).isoformat()}) + "\n")
        f.write("{broken\n" + json.dumps({"run_id": 1, "seq": 5}) + "\n")


def reports(spark, out):
    rows = spark.read.parquet(out).collect()
    return sorted((r["run_id"], r["kind"], r["seq"], round((r["at"].replace(tzinfo=timezone.utc) - START).total_seconds()), r["made_up"]) for r in rows)


def test_batches_and_restart(spark, tmp_path):
    events = made(5)
    want = plain(events, 40, 150)
    assert {k for _, k, *_ in want} == {"idle", "failed", "done"} and any(r[4] and r[1] == "failed" for r in want)
    for way in ("one", "many"):
        inbox = tmp_path / way / "inbox"
        inbox.mkdir(parents=True)
        where = [str(tmp_path / way / x) for x in ("out", "checkpoint")]
        size = len(events) if way == "one" else 50
        for k in range(0, len(events), size):
            write(inbox, f"{k:04}.json", events[k : k + size])
            if way == "one" or k in (100, 200):  # stops and goes on from its checkpoint
                watch.watch_files(spark, str(inbox), *where, 40, 150)
        watch.watch_files(spark, str(inbox), *where, 40, 150)
        assert reports(spark, where[0]) == want, way

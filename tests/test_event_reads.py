"""Event streams read in pieces against the fold of whole reads, with growing streams and restarts."""

import random

import pytest

from millrace.streaming import progress, reads


def lines(stream, n, seed):
    rng = random.Random(seed)
    kinds = ["data: {}\n", "data:{}\r\n", ": {}\n", "data:  \n", "event: x{}\n", "\n", " data: é日{} \n", "data: {}"]
    return "".join(rng.choice(kinds[:-1]).format(f"{stream}-{k}") for k in range(n)) + rng.choice(kinds)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_growing_streams_equal_the_batch_fold(spark, tmp_path, size):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()
    rng = random.Random(size)
    whole = {f"s{k}": lines(k, 25 if size > 1 else 6, k).encode() for k in range(4)}
    whole["s4"] = b""
    (inbox / "_temporary").write_bytes(b"data: no\n")
    at = dict.fromkeys(whole, 0)
    for last in (False, False, True):
        for s, data in whole.items():
            to = len(data) if last else rng.randint(at[s], len(data))  # also within a character
            with open(inbox / s, "ab") as f:
                f.write(data[at[s] : to])
            at[s] = to
        reads.read_once(spark, str(inbox), out, checkpoint, size)
    reads.read_once(spark, str(inbox), out, checkpoint, size)  # nothing has come
    found = sorted((r["stream"], r["n"], r["json"]) for r in spark.read.parquet(out).collect())
    rows = [(s, 0, data.decode()) for s, data in whole.items()]
    want = progress.events_of_reads(spark.createDataFrame(rows, "stream string, at int, read string"), "stream", "at", "read")
    assert found == sorted(map(tuple, want.collect()))
    assert len(found) > 5


def test_ranges_of_tasks(monkeypatch):
    monkeypatch.setattr(reads, "TASK", 10)
    tasks = [p.ranges for p in reads.EventReader("/x", 3).partitions({"a": 4}, {"a": 9, "b": 0, "c": 26})]
    assert tasks == [[("a", 4, 9), ("c", 0, 5)], [("c", 5, 15)], [("c", 15, 25)], [("c", 25, 26)]]

"""Queries do the whole job: every row and whole texts, against brute force on small tables."""

from urllib.parse import quote

import pytest

from millrace.plans import QUERIES, by_order, standins

#: Ids of every remainder; words that tell texts apart only stand far from their beginning.
TEXTS = {k: "Same start é* ~ " * 40 + " ".join(f"w{k % m} W{k % m}" for m in (2, 3, 4, 7)) + f"  tail{k}" for k in range(1, 13)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, t, "en" if k % 2 else "de", "s", len(t)) for k, t in TEXTS.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    return top


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_leave_one_out_takes_all_documents_and_whole_texts(spark, folder):
    found = {(r["query_id"], r["entry_id"]): r["jaccard"] for r in QUERIES["j22_leave_one_out"](spark, folder).collect()}
    words = {k: set(t.split(" ")) for k, t in TEXTS.items()}
    assert found == {(a, b): pytest.approx(similarity(words[a], words[b])) for a in words for b in words if a != b and a % 2 == b % 2}


def test_error_text_takes_all_events(spark, tmp_path):
    ids = [1, 17, 1999, 2000, 2001, 5000, 123456]
    events = [(k, 7, "error") for k in ids] + [(3000, 7, "view")]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["a06_error_text"](spark, str(tmp_path)).collect()
    assert [r["run_id"] for r in found] == [7]
    message = {k % 16: m for k, m in enumerate(standins.MESSAGES)}
    assert found[0]["text"] == "\n".join(message[k % 16].replace("''", "'") for k in ids)


def test_percent_encoding_takes_whole_texts(spark, folder):
    found = {r["doc_id"]: r["encoded"] for r in QUERIES["f25_percent_encoding"](spark, folder).collect()}
    assert found == {k: quote(t, safe="-_.~") for k, t in TEXTS.items()}


def test_jaccard_takes_whole_texts(spark, folder):
    found = {r["doc_id"]: r["jaccard"] for r in QUERIES["f12_jaccard"](spark, folder).collect()}
    assert found == {k: pytest.approx(similarity(set(t.split(" ")), set(t.lower().split(" ")))) for k, t in TEXTS.items()}


def test_scenarios_are_not_picked_by_id(spark, tmp_path):
    docs = [(0, "x", "en", "a", 1), (2, "x", "en", "a", 1), (4, "x", "en", "b", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["archive"]: r["root"] for r in QUERIES["src17_common_root"](spark, str(tmp_path)).collect()} == {"a": None, "b": "node_modules"}
    assert {r["project"]: r["manager"] for r in QUERIES["src24_package_manager"](spark, str(tmp_path)).collect()} == {"a": "pip", "b": "go modules"}


def test_retry_ceiling_is_found_in_the_log(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    start = ["StartParsing", "ParseComplete", "ScaffoldComplete"]
    runs = {5: [*start, *["ChunkRetry"] * 4], 2: [*start, *["ChunkRetry"] * 3], 7: ["Reset", *start, *["ChunkRetry"] * 5]}
    log = spark.createDataFrame([(n, k, e) for n, events in runs.items() for k, e in enumerate(events)], "run_id bigint, seq int, event string")
    monkeypatch.setattr(by_order, "_state_log", lambda t: log)
    assert {r["run_id"]: r["rejected"] for r in QUERIES["i06_retry_ceiling"](spark, str(tmp_path)).collect()} == {5: 1, 7: 3}

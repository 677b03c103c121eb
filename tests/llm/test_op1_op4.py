import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelkit.llm import op4_tool_calls as op4
from panelkit.llm.op1_revisits import canonical_url, plain_headers, resolve_revisits
from panelkit.llm.op4_tool_calls import link_tool_calls

T0 = datetime(2024, 1, 1)
RECORD = "record_id long, url string, ts timestamp, type string, headers map<string,string>, status string"


def rec(i, url, minute, kind, headers=None):
    return (i, url, None if minute is None else T0 + timedelta(minutes=minute), kind, headers, "x")


def test_canonical_url(spark):
    cases = {"HTTP://www.Example.com:80/a/?b=2&a=1&utm_source=x#top": "example.com/a?a=1&b=2",
             "https://u:p@example.com": "example.com/", "http://example.com?ref=z": "example.com/",
             "https://example.com:8443/x//": "example.com:8443/x", "mailto:a@b": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_revisits(spark):
    a = "https://a.org/x?utm_source=feed"
    rows = [
        rec(1, "http://a.org/x", 0, "response", {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}),
        rec(2, a, 5, "revisit", {"etag": 'W/"1"', "Content-Type": "none", "X": "newer", "Date": "d", "N": None}),
        rec(3, a, 6, "response", {"ETag": '"2"', "Last-Modified": "m"}),
        rec(4, a, 7, "revisit", {"ETag": '"1"'}),
        rec(5, a, 8, "revisit", {"Last-Modified": "m"}),
        rec(6, a, 9, "revisit", None),
        rec(7, "http://b.org", 1, "revisit", {"ETag": '"1"'}),
        rec(8, None, 1, "revisit", {}), rec(9, a, None, "revisit", {}), rec(10, a, 3, "metadata", {}),
        # ties: at one time the lesser id is the earlier
        rec(11, "http://c.org/", 1, "response", {"ETag": "p"}), rec(12, "http://c.org/", 1, "revisit", {"ETag": "p"}),
        rec(13, "http://c.org/", 1, "response", {"ETag": "q"}),
    ]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert set(got) == {2, 4, 5, 6, 7, 8, 9, 12}
    assert (got[2].response_id, got[2].status, got[2].validator) == (1, "resolved", "etag")
    assert got[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "x": "newer", "date": "d"}
    assert (got[4].response_id, got[4].status) == (3, "mismatch") and got[4].headers == {"etag": '"1"'}
    assert (got[5].status, got[5].validator) == ("resolved", "last-modified")
    assert (got[6].status, got[6].validator, got[6].headers) == ("resolved", "none", {"etag": '"2"', "last-modified": "m"})
    assert all(got[k].status == "no_response" and got[k].response_id is None for k in (7, 8, 9))
    assert (got[12].response_id, got[12].status) == (11, "resolved")
    assert resolve_revisits(spark.createDataFrame([], RECORD)).collect() == []


def test_of_equal_header_names_the_last_holds(spark):
    row = spark.sql("SELECT map('A', '1', 'b', null, 'a ', '2', 'B', '3') AS h").select(plain_headers(F.col("h")).alias("h")).first()
    assert row.h == {"a": "2", "b": "3"}


def test_a_frequent_url_over_several_ranges(spark):
    rows = [rec(i, "http://hot.org/", i, "response" if i % 7 == 3 else "revisit", {}) for i in range(400)]
    found = resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    for r in found:
        before = [j for j in range(r.record_id) if j % 7 == 3]
        assert r.response_id == (before[-1] if before else None)
    assert len(found) == sum(i % 7 != 3 for i in range(400))


CALL = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, status string"
RESULT = "conv_id long, call_id string, turn long, content string, level int"


def call(i, turn, after=None, name="lookup", arguments='{"key": "k"}', conv=1):
    return (conv, i, turn, name, arguments, after, "x")


def test_tool_calls(spark):
    calls = [
        call("a", 5, ["b", "c"]), call("b", 3), call("c", 1, ["b", "b"]), call("a", 9, None), call("d", 2, ["e"]), call("e", 4, ["d"]),
        call("f", 6, ["d"]), call("g", 7, ["nowhere"]), call("h", 8, arguments="{not json"), call("i", 8, name="other"),
        call("j", 8, arguments='{"exact": true}'), call("k", 8, arguments='{"key": 1}'), call("l", 8, arguments='{"key": "x", "more": 1}'),
        call("m", 8, name="search", arguments='{ "query": "q\\u00e9\\"\\n", "limit": 3 }'), call("n", 8, arguments="[1]"),
        call("z", 1, conv=2), call(None, 1, conv=2), call("q", 1, conv=None), call("o", 8, arguments=None),
    ]
    results = [(1, "a", 6, "late", 1), (1, "a", 5, "first", 1), (1, "b", 4, None, 1), (1, "c", 2, "C", 1), (1, "m", 9, "", 1),
               (1, "lone", 3, "x", 1), (2, None, 1, "y", 1)]
    rows = link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), op4.SCHEMAS).collect()
    got = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert len(rows) == len(calls) + 1
    state = {k[1]: (r.status, r.level) for k, r in got.items() if k[0] == 1 and k[2] != 9}
    assert state == {"b": ("ok", 0), "c": ("ok", 1), "a": ("ok", 2), "d": ("cycle", None), "e": ("cycle", None), "f": ("cycle", None),
                     "g": ("unknown_call", None), "h": ("bad_json", 0), "i": ("unknown_tool", 0), "j": ("bad_arguments", 0),
                     "k": ("bad_arguments", 0), "l": ("bad_arguments", 0), "m": ("ok", 0), "n": ("bad_arguments", 0),
                     "o": ("bad_json", 0), "lone": ("orphan", None)}
    assert got[1, "a", 9].status == "duplicate"
    place = {r.call_id: r.position for r in rows if r.conv_id == 1 and r.status == "ok"}
    assert place["b"] < place["c"] < place["a"]
    assert sorted(r.position for r in rows if r.conv_id == 1) == list(range(sum(r.conv_id == 1 for r in rows)))
    for r in rows:
        parsed = json.loads(r.json)
        assert r.json == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "a", 5].json) == {"arguments": {"key": "k"}, "id": "a", "name": "lookup", "result": "first"}
    assert json.loads(got[1, "m", 8].json)["arguments"] == {"limit": 3, "query": 'qé"\n'}
    assert json.loads(got[1, "m", 8].json)["result"] == "" and "result" not in json.loads(got[1, "b", 3].json)
    assert got[2, None, 1].status == "no_result" and got[2, "z", 1].status == "no_result"


def test_no_calls(spark):
    none = spark.createDataFrame([], CALL)
    assert link_tool_calls(none, spark.createDataFrame([], RESULT), op4.SCHEMAS).collect() == []
    assert [r.status for r in link_tool_calls(none, spark.createDataFrame([(1, "a", 1, "x", 0)], RESULT), op4.SCHEMAS).collect()] == ["orphan"]


def test_positions_of_one_long_conversation(spark, monkeypatch):
    # a conversation with most of all calls, in chains and fans; ranges far shorter than it
    monkeypatch.setattr(op4, "RANGE_TURNS", 7)
    monkeypatch.setattr(op4, "RANGE_LEVELS", 5)
    after = {k: [f"c{k - 1}"] if k % 40 else [] for k in range(160)} | {k: [f"c{k % 30}"] for k in range(160, 260)} | {260: ["c260"]}
    rows = [call(f"c{k}", 1000 - k if k >= 160 else k, on) for k, on in after.items()] + [call("c0", 3, conv=2)]
    calls = spark.createDataFrame(rows, CALL)
    results = spark.createDataFrame([], RESULT)
    found = [r for r in link_tool_calls(calls, results, {"lookup": {"key": ("string", True)}}).collect() if r.conv_id == 1]

    def level(k):
        return 1 + max((level(int(x[1:])) for x in after[k]), default=-1)

    want = sorted(((level(k) if k != 260 else 1 << 31, 1000 - k if k >= 160 else k, f"c{k}") for k in after))
    assert [r.call_id for r in sorted(found, key=lambda r: r.position)] == [c for _, _, c in want]
    assert sorted(r.position for r in found) == list(range(len(after)))


def test_sources_without_rows(spark):
    from panelkit.llm.op1_revisits import page_records
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert resolve_revisits(page_records(pages)).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert link_tool_calls(*op4.conversation_calls(turns), op4.SCHEMAS).collect() == []


def test_very_long_arguments_and_results(spark):
    long = "é\"\\ " * 300_000
    calls = spark.createDataFrame([call("a", 1, arguments=json.dumps({"key": long}))], CALL)
    results = spark.createDataFrame([(1, "a", 2, long, 0)], RESULT)
    r = link_tool_calls(calls, results, {"lookup": {"key": ("string", True)}}).first()
    assert r.status == "ok" and json.loads(r.json) == {"arguments": {"key": long}, "id": "a", "name": "lookup", "result": long}

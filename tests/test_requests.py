"""Request bodies, policies, summaries."""

import json

import pytest
from pyspark.sql import functions as F

from redactlake.functions.scan import ScanOptions
from redactlake.operators import metrics, requests
from redactlake.operators.policies import apply_policies
from redactlake.sources.policies import parse_policies, read_policies


def body(*messages, **more):
    return json.dumps({**more, "messages": list(messages)})


def user(content):
    return {"role": "user", "content": content}


def run(spark, text, detectors=("EMAIL",), whitelist=None):
    df = spark.createDataFrame([(1, text)], "request_id int, body string")
    masked = requests.mask_bodies(df, options=ScanOptions(detectors, whitelist)).persist()
    summary = requests.summarize(masked).first()
    scans = masked.first()["scans"]
    return {s["path"]: s["anonymised_text"] for s in scans}, summary


def test_kinds(spark):
    bodies = {
        "": "empty",
        "{}": "json",
        ' {"a": 1} \n': "json",
        "null": "json",
        "[1]": "text",
        "5": "text",
        "{} x": "text",
        "{}, {}": "text",
        "{bad": "text",
        'x {"a": 1}': "text",
        '{"a": 1}]': "text",
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {r["body"]: r["kind"] for r in requests.triage(df).collect()} == bodies


def test_raw_text(spark):
    found, summary = run(spark, "Kontakt: raw@example.de und b@example.de (kein JSON)")
    assert found == {"body": "Kontakt: [EMAIL_1] und [EMAIL_2] (kein JSON)"}
    assert not summary["is_json"] and summary["pii_types"] == ["EMAIL", "EMAIL"]


def test_user_messages_only(spark):
    found, summary = run(
        spark,
        body(
            user("Termin mit pia@hof.example am Montag"),
            {"role": "assistant", "content": "leitung@hof.example"},
            user("sonst ruft jan@hof.example an"),
            system="Hilfe gibt dienst@hof.example",
        ),
    )
    assert found == {"messages[0].content": "Termin mit [EMAIL_1] am Montag", "messages[2].content": "sonst ruft [EMAIL_1] an"}
    assert summary["is_json"] and summary["pii_found"] == 2
    assert summary["placeholders"] == ["[EMAIL_1]"] and summary["pii_types"] == ["EMAIL"]


def test_tool_results(spark):
    blocks = [
        {"type": "tool_result", "tool_use_id": "x", "content": "3 Zeilen, eine von lea@hof.example"},
        {"type": "tool_result", "content": [{"type": "other", "text": "b@example.com"}, "c@example.com", {"text": 5}]},
        {"type": "text", "text": "d@example.com"},
        {"type": "image", "text": "e@example.com"},
    ]
    found, _ = run(spark, body(user(blocks)))
    assert found == {
        "messages[0].content[0].content": "3 Zeilen, eine von [EMAIL_1]",
        "messages[0].content[1].content[0].text": "[EMAIL_1]",
        "messages[0].content[2].text": "[EMAIL_1]",
    }


def test_tool_inputs_at_any_depth(spark):
    deep = {"leaf": "deep@example.com"}
    for _ in range(14):
        deep = {"next": deep, "list": ["no@example.com", {"in": "list@example.com"}]}
    found, _ = run(spark, body(user([{"type": "tool_use", "input": {"a.b": "a@example.com", "n": 5, "o": deep}}])))
    start = "messages[0].content[0].input"
    assert found == {f'{start}["a.b"]': "[EMAIL_1]", f"{start}.o" + ".next" * 14 + ".leaf": "[EMAIL_1]"}


def test_string_that_looks_like_blocks(spark):
    found, _ = run(spark, body(user('[{"type": "text", "text": "a@example.com"}]')))
    assert found == {"messages[0].content": '[{"type": "text", "text": "[EMAIL_1]"}]'}


def test_whitelist_and_counts(spark):
    found, summary = run(spark, body(user("Von presse@hof.example kopiert an max@hof.example")), whitelist=("presse@hof.example",))
    assert found == {"messages[0].content": "Von presse@hof.example kopiert an [EMAIL_1]"} and summary["pii_found"] == 1
    _, summary = run(spark, body(user("max@hof.example, mobil 0152 8817345")), detectors=("EMAIL", "PHONE"))
    assert summary["pii_found"] == 2


def test_dry_run_scans_everything_and_changes_nothing(spark):
    text = body(user("a@example.com"), {"role": "assistant", "content": "b@example.com"}, system="c@example.com")
    df = spark.createDataFrame([(1, text)], "request_id int, body string")
    summary = requests.summarize(requests.dry_run(df)).first()
    assert summary["pii_found"] == 3 and not summary["is_json"] and summary["masked_bytes"] == 0


def test_quarantine(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xc3\xbc"),), (bytearray(b"bad \xc3("),)], "body binary")
    rows = requests.quarantine(df).collect()
    assert [(r["body"], r["quarantined"]) for r in rows] == [("ok ü", False), ("<binary>", True)]


def test_effective_lists(spark):
    df = spark.createDataFrame(
        [(["IBAN"], [" A ", "b"], ["EMAIL"], ["a", "B", "c"]), ([], None, ["EMAIL"], None), (None, None, None, None)],
        "detectors array<string>, whitelist array<string>, default_detectors array<string>, default_whitelist array<string>",
    )
    rows = requests.effective_lists(df).select("effective_detectors", "effective_whitelist").collect()
    assert [tuple(r) for r in rows] == [(["IBAN"], ["a", "B", "c"]), (["EMAIL"], []), ([], [])]


POLICY = {"type": "chat", "port": 9880, "upstream": "u", "settings": {"detectors": ["EMAIL", "PHONE"], "whitelist": ["w"]}}


@pytest.mark.parametrize(
    "text, wanted",
    [
        (json.dumps({"api_port": 9090, "proxies": [POLICY]}), [(True, 9880, ["EMAIL", "PHONE"])]),
        (json.dumps([POLICY, POLICY]), [(True, 9880, ["EMAIL", "PHONE"])] * 2),
        ('{"api_port": 8080, "proxies": []}', [(True, 8080, [])]),
        (None, [(True, 8080, [])]),
        ("{not valid json", [(False, None, [])]),
    ],
)
def test_policies(spark, text, wanted):
    rows = parse_policies(spark.createDataFrame([(text,)], "json string")).collect()
    assert [(r["valid"], r["port"], r["detectors"]) for r in rows] == wanted


def test_policy_file(spark, tmp_path):
    (tmp_path / "policies.json").write_text(json.dumps({"api_port": 9090, "proxies": [POLICY]}, indent=2))
    row = read_policies(spark, str(tmp_path)).first()
    assert (row["api_port"], row["port"], row["whitelist"], row["dry_run"]) == (9090, 9880, ["w"], False)


def test_policies_apply_per_port(spark):
    text = body(user("a@example.com B-AB 1234"))
    calls = spark.createDataFrame([(i, 9000 + i, text) for i in range(4)], "request_id int, port int, body string")
    policies = spark.createDataFrame(
        [(9000, ["EMAIL"], [], False), (9001, ["EMAIL"], ["EXAMPLE"], False), (9002, [], [], True)],
        "port int, detectors array<string>, whitelist array<string>, dry_run boolean",
    )
    found = {r["request_id"]: r["pii_types"] for r in requests.summarize(apply_policies(calls, policies)).collect()}
    assert found == {0: ["EMAIL"], 1: [], 2: ["EMAIL", "LICENSE_PLATE"], 3: ["EMAIL", "LICENSE_PLATE"]}


def test_counters(spark):
    df = spark.createDataFrame(
        [(1, 3, ["EMAIL", "IBAN"], 7), (2, 0, [], 0), (3, 2, ["EMAIL", "EMAIL"], 1)],
        "request_id int, pii_found bigint, pii_types array<string>, masked_bytes bigint",
    )
    assert tuple(metrics.totals(df).first()) == (3, 5, 8)
    assert {tuple(r) for r in metrics.by_type(df).collect()} == {("EMAIL", 3), ("IBAN", 1)}
    lines = [r["value"] for r in metrics.exposition(df, "x").orderBy("line_no").collect()]
    assert lines == [
        "# TYPE x_requests_total counter",
        "x_requests_total 3",
        "# TYPE x_pii_findings_total counter",
        "x_pii_findings_total 5",
        "# TYPE x_masked_bytes_total counter",
        "x_masked_bytes_total 8",
        'x_pii_type_total{type="EMAIL"} 3',
        'x_pii_type_total{type="IBAN"} 1',
    ]
    empty = [r["value"] for r in metrics.exposition(df.where("false"), "x").orderBy("line_no").collect()]
    assert empty[1::2] == ["x_requests_total 0", "x_pii_findings_total 0", "x_masked_bytes_total 0"]
    assert df.select(F.count("*")).first()[0] == 3


def test_several_policies_for_a_port(spark):
    calls = spark.createDataFrame([(1, 5, "a@b.de"), (2, 6, "a@b.de")], "request_id int, port int, body string")
    policies = spark.createDataFrame(
        [(5, 2, ["PHONE"], [], False), (5, 1, ["EMAIL"], [], False), (None, 1, [], [], True)],
        "port int, policy_no int, detectors array<string>, whitelist array<string>, dry_run boolean",
    )
    found = requests.summarize(apply_policies(calls, policies, order=("policy_no",))).collect()
    assert sorted((r["request_id"], r["pii_found"]) for r in found) == [(1, 1), (2, 1)]


def test_bodies_with_repeated_keys_and_refused_ones(spark):
    deep = '{"a":' * 1200 + "1" + "}" * 1200
    rows = [(1, '{"messages": [], "messages": [{"role": "user", "content": "a@b.de"}]}'), (2, deep), (3, '{"a": 1} x')]
    masked = requests.mask_bodies(spark.createDataFrame(rows, "request_id int, body string")).collect()
    assert {r["request_id"]: r["kind"] for r in masked}[1] == "json" and {r["request_id"]: r["kind"] for r in masked}[3] == "text"
    assert {r["request_id"]: [s["anonymised_text"] for s in r["scans"]] for r in masked}[1] == ["[EMAIL_1]"]
    assert {r["request_id"]: r["kind"] for r in masked}[2] in ("reject", "text")


def test_listed_api_keys(spark):
    from redactlake.sources.policies import api_keys

    document = '{"api_keys": [{"id": "1", "name": "n", "hash": "abc"}, {"id": "2", "hash": ""}, 5]}'
    rows = api_keys(spark.createDataFrame([(document,), ("[]",), (None,)], "json string")).collect()
    assert [tuple(r) for r in rows] == [("1", "n", "abc")]

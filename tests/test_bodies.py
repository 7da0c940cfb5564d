"""Whole masked bodies, their vault, and putting the texts back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from redactlake.functions.bodies import rewritten_body
from redactlake.functions.json_text import quoted, replace_strings
from redactlake.functions.scan import ScanOptions
from redactlake.operators import requests
from redactlake.operators.restore import restore_bodies

MAIL = "post {0} an wer{0}@stelle.example und noch wer{0}@stelle.example"


def test_strings_are_replaced_by_path(spark):
    text = r'{ "a" : "x", "b":[ "x" , {"c":"x","a.b":"x"},"x"],"a\u002eb":{"b":"x"}, "n":1.50, "t":"\/\"x"}'
    paths = {'a': '"1"', 'b[0]': '"2"', 'b[1].c': '"3"', 'b[1]["a.b"]': '"4"', '["a.b"].b': '"5"', "zz": '"6"'}
    row = spark.createDataFrame([(text, paths)], "json string, paths map<string,string>")
    got = row.select(replace_strings(F.col("json"), F.col("paths"))).first()[0]
    assert got == r'{ "a" : "1", "b":[ "2" , {"c":"3","a.b":"4"},"x"],"a\u002eb":{"b":"5"}, "n":1.50, "t":"\/\"x"}'


def test_quoted(spark):
    texts = ["", "plain", 'a"b\\c', "Zeile\n\tund \u0007 \u2028 ü 漢 🙂", "</script>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quoted(F.col("t")).alias("q")).collect()
    assert all(json.loads(r.q) == r.t for r in rows)


def masked_by_hand(body, found):
    """What masking must do to a parsed body: ``found`` maps a text to its masked form."""

    def inside(value):
        if isinstance(value, str):
            return found(value)
        return {k: inside(v) for k, v in value.items()} if isinstance(value, dict) else value

    def block(b):
        if not isinstance(b, dict):
            return b
        kind, b = b.get("type"), dict(b)
        if kind == "text" and isinstance(b.get("text"), str):
            b["text"] = found(b["text"])
        if kind == "tool_use" and isinstance(b.get("input"), dict):
            b["input"] = inside(b["input"])
        if kind == "tool_result":
            if isinstance(b.get("content"), str):
                b["content"] = found(b["content"])
            elif isinstance(b.get("content"), list):
                b["content"] = [
                    {**p, "text": found(p["text"])} if isinstance(p, dict) and isinstance(p.get("text"), str) else p
                    for p in b["content"]
                ]
        return b

    out = dict(body)
    for n, message in enumerate(body.get("messages", [])):
        if isinstance(message, dict) and message.get("role") == "user":
            content = message.get("content")
            if isinstance(content, str):
                content = found(content)
            elif isinstance(content, list):
                content = [block(b) for b in content]
            out["messages"] = [*out["messages"][:n], {**message, "content": content}, *out["messages"][n + 1 :]]
    return out


def plain_mask(text):
    """Texts here hold one address each, twice."""
    words = text.split(" ")
    return " ".join("[EMAIL_1]" if "@" in w else w for w in words)


def random_bodies():
    draw = random.Random(17)
    serial = iter(range(10_000))
    keys = ["a", "b c", "x.y", "x", "y", "ü", 'q"t', "[0]", "messages[0]", "", "text", "content"]

    def text():
        return draw.choice([MAIL.format(next(serial)), "nichts", "", 'sagt "so" \\ und\n\tüber 漢 🙂 ' + MAIL.format(next(serial))])

    def value(depth):
        kind = draw.randrange(7) if depth else draw.randrange(5)
        if kind < 2:
            return text()
        if kind < 5:
            return draw.choice([1, 1.5, True, None, -3])
        if kind == 5:
            return [value(depth - 1) for _ in range(draw.randrange(3))]
        return {draw.choice(keys): value(depth - 1) for _ in range(draw.randrange(5))}

    def block():
        kind = draw.choice(["text", "tool_use", "tool_result", "image", None])
        return draw.choice(
            [
                {"type": kind, "text": text(), "input": value(4), "content": value(2)},
                {"content": [{"type": "other", "text": text()}, text(), {"text": 5}], "type": kind},
                {"type": kind, "input": {"deep": {"er": {"and": {"more": {"of": {"it": value(3)}}}}}, "list": [text()]}},
                text(),
            ]
        )

    for _ in range(60):
        messages = [
            {"content": draw.choice([text(), [block() for _ in range(draw.randrange(4))]]), "role": draw.choice(["user", "user", "assistant"])}
            for _ in range(draw.randrange(4))
        ]
        body = {"system": text(), "messages[0]": {"content": text()}, "messages": messages, "n": value(2)}
        yield body, json.dumps(body, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 2]))


@pytest.fixture(scope="module")
def masked(spark):
    bodies = list(random_bodies())
    df = spark.createDataFrame([(n, raw) for n, (_, raw) in enumerate(bodies)], "request_id int, body string")
    whole = requests.whole_masked_bodies(df, options=ScanOptions(("EMAIL",))).persist()
    return bodies, whole


def test_random_bodies_are_masked_in_place(masked):
    bodies, whole = masked
    for row in whole.collect():
        parsed, raw = bodies[row.request_id]
        assert row.kind == "json"
        assert json.loads(row.masked_body) == masked_by_hand(parsed, plain_mask)
        if not any("[EMAIL_1]" in s.anonymised_text for s in row.scans):
            assert row.masked_body == raw


def test_random_bodies_are_restored(masked):
    bodies, whole = masked
    vault = requests.body_vault(whole)
    for row in restore_bodies(whole.select("request_id", "masked_body"), vault).collect():
        parsed, raw = bodies[row.request_id]
        assert json.loads(row.restored_body) == parsed
    assert vault.count() == requests.request_findings(whole).select("request_id", "path", "text").distinct().count()


def whole_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, body string")
    return requests.whole_masked_bodies(df, options=ScanOptions(("EMAIL",)))


def test_other_kinds(spark):
    deep = '{"a":' * 1200 + "1" + "}" * 1200
    texts = ["", None, "Text an eins@stelle.example", '["zwei@stelle.example"]', "null", '{"a": "drei@stelle.example"}', deep, "{kaputt vier@stelle.example"]
    rows = {r.request_id: r for r in whole_of(spark, *texts).collect()}
    assert [rows[n].kind for n in range(6)] == ["empty", "empty", "text", "text", "json", "json"] and rows[7].kind == "text"
    assert rows[6].masked_body == (None if rows[6].kind == "reject" else deep)
    got = [rows[n].masked_body for n in (0, 1, 2, 3, 4, 5, 7)]
    assert got == ["", None, "Text an [EMAIL_1]", '["[EMAIL_1]"]', "null", texts[5], "{kaputt [EMAIL_1]"]


def test_a_refused_body_is_not_sent_on(spark):
    row = spark.sql("select '{\"a\": 1}' as body, 'reject' as kind, parse_json(null) as document, cast(array() as array<struct<path:string,text:string>>) as texts")
    assert row.select(rewritten_body(*[F.col(c) for c in ("body", "kind", "document", "texts")])).first()[0] is None


def test_values_that_do_not_count_are_left_out(spark):
    text = '{"messages": [{"role": "user", "content": "eins@stelle.example"}], "messages": [{"content": "zwei@stelle.example", "role": "user"}]}'
    row = whole_of(spark, text).first()
    assert json.loads(row.masked_body) == {"messages": [{"content": "[EMAIL_1]", "role": "user"}]} and "eins" not in row.masked_body
    quiet = whole_of(spark, '{"x": "eins@stelle.example", "x": 1, "messages": []}').first().masked_body
    assert json.loads(quiet) == {"x": 1, "messages": []}


def test_restoring_needs_request_and_path(spark):
    body = json.dumps({"messages": [{"role": "user", "content": MAIL.format(1)}, {"role": "user", "content": MAIL.format(2)}]})
    raw = "[" + json.dumps(MAIL.format(3)) + "]"
    whole = whole_of(spark, body, body.replace("wer", "sie"), raw, "ohne").persist()
    vault = requests.body_vault(whole)
    assert {(r.request_id, r.path, r.placeholder) for r in vault.collect()} == {
        (n, f"messages[{m}].content", "[EMAIL_1]") for n in (0, 1) for m in (0, 1)
    } | {(2, "body", "[EMAIL_1]")}
    got = {r.request_id: r.restored_body for r in restore_bodies(whole.select("request_id", "masked_body"), vault).collect()}
    assert got == {0: body, 1: body.replace("wer", "sie"), 2: raw, 3: "ohne"}
    part = vault.where("path <> 'messages[1].content'")
    got = {r.request_id: r.restored_body for r in restore_bodies(whole.select("request_id", "masked_body"), part).collect()}
    assert json.loads(got[0])["messages"][0]["content"] == MAIL.format(1)
    assert json.loads(got[0])["messages"][1]["content"] == plain_mask(MAIL.format(2))


def test_findings_of_requests(spark):
    whole = whole_of(spark, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "ü an eins@stelle.example"}]}]}')
    rows = [tuple(r) for r in requests.request_findings(whole).select("request_id", "path", "pii_type", "start", "end", "text").collect()]
    assert rows == [(0, "messages[0].content[0].text", "EMAIL", 6, 25, "eins@stelle.example")]

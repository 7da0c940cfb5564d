"""White list, overlaps, placeholders, masking and restoring."""

import random

from pyspark.sql import functions as F

from redactlake.fixed_values import PII_TYPES, PRIORITY
from redactlake.functions import spans
from redactlake.functions.detectors import CANDIDATE
from redactlake.functions.scan import ScanOptions
from redactlake.operators import scans
from redactlake.operators.restore import restore
from redactlake.plans import planted


def masked(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "scan_id int, text string")
    row = scans.scan_texts(df, options=ScanOptions(**options)).first()
    return row["anonymised_text"], row["findings"]


def test_repeated_text_shares_a_placeholder(spark):
    text, found = masked(spark, "info@example.de und info@example.de")
    assert text == "[EMAIL_1] und [EMAIL_1]" and len(found) == 2


def test_counters_per_type(spark):
    assert masked(spark, "a@example.com und b@example.com")[0] == "[EMAIL_1] und [EMAIL_2]"


def test_selected_detectors(spark):
    text = "Miete auf AT611904300234573201, Fragen an 0152 8817345"
    assert masked(spark, text, detectors=["iban"])[0] == "Miete auf [IBAN_1], Fragen an 0152 8817345"
    assert masked(spark, text, detectors=["NAME"])[0] == text
    assert masked(spark, text, detectors=[" IBAN"])[0] == text


def test_whitelist(spark):
    text = "Öffentlich ist presse@hof.example, privat max@hof.example."
    found = masked(spark, text, detectors=["EMAIL"], whitelist=[" PRESSE@hof.example ", ""])
    assert found[0] == "Öffentlich ist presse@hof.example, privat [EMAIL_1]."


def test_whitelisted_winner_lets_another_candidate_surface(spark):
    text = "https://x.example.com/?token=me@host.example.org/path"
    assert [f["pii_type"] for f in masked(spark, text)[1]] == ["URL_SECRET"]
    # the token is in the longer candidate only, so the e-mail inside it comes out
    assert [(f["pii_type"], f["text"]) for f in masked(spark, text, whitelist=["org/path"])[1]] == [
        ("EMAIL", "me@host.example.org")
    ]
    assert masked(spark, text, whitelist=["me@host"])[1] == []


def test_whitelist_table_and_many_tokens(spark):
    texts = spark.createDataFrame([(1, "a", "x@b.de y@c.de"), (2, "b", "x@b.de"), (3, None, "x@b.de")], "scan_id int, team string, text string")
    tokens = spark.createDataFrame([("a", " X@B.de "), ("a", ""), ("a", None), *[("b", f"t{i}") for i in range(10_000)]], "team string, token string")
    listed = scans.with_whitelist(texts, tokens, "team")
    found = scans.explode_findings(scans.scan_texts(listed, options=ScanOptions(whitelist="whitelist"))).collect()
    assert sorted((f["scan_id"], f["text"]) for f in found) == [(1, "y@c.de"), (2, "x@b.de"), (3, "x@b.de")]


def test_restore_from_incomplete_repeated_and_unordered_vaults(spark):
    redacted = spark.createDataFrame([(1, "[EMAIL_1] [EMAIL_2] [EMAIL_10] [PHONE_1]")], "scan_id int, anonymised_text string")

    def back(*entries):
        vault = spark.createDataFrame([(1, *e) for e in entries], "scan_id int, placeholder string, text string")
        return restore(redacted, vault).first()["restored_text"]

    assert back(("[EMAIL_2]", "b")) == "[EMAIL_1] b [EMAIL_10] [PHONE_1]"
    assert back(("[EMAIL_10]", "j"), ("[EMAIL_1]", "a"), ("[EMAIL_1]", "a"), ("[PHONE_1]", "p")) == "a [EMAIL_2] j p"
    assert back(("[EMAIL_2]", "b"), ("[EMAIL_1]", "z"), ("[EMAIL_1]", "a"), ("none", "q")) == "a b [EMAIL_10] [PHONE_1]"


def test_address_and_mail(spark):
    text = "Paket bitte zum Lindenhof Str. 7B, 54321 Übersee; Fragen an lager@versand.example.net"
    found, spans_found = masked(spark, text)
    assert [f["pii_type"] for f in spans_found] == ["ADDRESS", "EMAIL"] and found.endswith("; Fragen an [EMAIL_1]")


def test_licence_with_all_detectors_is_a_personal_id(spark):
    assert [f["pii_type"] for f in masked(spark, "Führerschein B951204XY")[1]] == ["PERSONAL_ID"]


def test_nothing_found(spark):
    assert masked(spark, "Kein PII hier.") == ("Kein PII hier.", [])
    assert masked(spark, "") == ("", [])
    assert masked(spark, None)[0] is None


def test_marks_in_the_text(spark):
    text, found = masked(spark, "\x01\x01a@b.de\x01 und \x01 c@d.com")
    assert text == "\x01\x01[EMAIL_1]\x01 und \x01 [EMAIL_2]"
    assert [f["start"] for f in found] == [2, 16]


def overlap_winners(candidates):
    """Recursive: the last place goes to the newcomer if it is apart or beats the one that holds it."""
    ordered = sorted(candidates, key=lambda c: (c["start"], -c["prio"], c["start"] - c["end"]))
    rank = lambda c: (c["prio"], c["end"] - c["start"])

    def place(left, kept):
        while left:
            (newcomer, *left), holder = left, kept[-1] if kept else None
            if holder is None or newcomer["start"] >= holder["end"]:
                kept = [*kept, newcomer]
            else:
                kept = [*kept[:-1], max(holder, newcomer, key=rank)]
        return kept

    return place(ordered, [])


def sequential_placeholders(found):
    counters, seen, out = {}, {}, []
    for f in found:
        if f["text"] not in seen:
            counters[f["pii_type"]] = counters.get(f["pii_type"], 0) + 1
            seen[f["text"]] = f"[{f['pii_type']}_{counters[f['pii_type']]}]"
        out.append(seen[f["text"]])
    return out


def test_spans_equal_a_sequential_run(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(120):
        some = []
        for _ in range(rng.choice([0, 1, 2, 5, 12, 40, 700])):
            start = rng.randrange(60 if rng.random() < 0.5 else 3000)
            kind = rng.choice(PII_TYPES)
            end = start + rng.randrange(1, 25)
            text = f"t{rng.randrange(30)}"
            some.append((kind, start, end, text, 1.0, None, PRIORITY[kind], PII_TYPES.index(kind)))
        cases.append((len(cases), some))
    df = spark.createDataFrame(cases, f"id int, c array<{CANDIDATE}>")
    out = df.withColumn("r", spans.resolve_overlaps(F.col("c"))).withColumn("p", spans.assign_placeholders(F.col("r")))
    for row in out.collect():
        wanted = overlap_winners(row["c"])
        assert [tuple(c) for c in row["r"]] == [tuple(c) for c in wanted]
        assert [f["placeholder"] for f in row["p"]] == sequential_placeholders(wanted)


def test_equal_text_of_two_types(spark):
    rows = [("EMAIL", 0, 1, "x", 1.0, None, 4, 2), ("PHONE", 5, 6, "x", 1.0, None, 3, 3), ("PHONE", 8, 9, "y", 1.0, None, 3, 3)]
    df = spark.createDataFrame([(rows,)], f"c array<{CANDIDATE}>")
    found = df.select(spans.assign_placeholders(F.col("c")).alias("p")).first()["p"]
    assert [f["placeholder"] for f in found] == ["[EMAIL_1]", "[EMAIL_1]", "[PHONE_1]"]


def test_one_text_with_very_many_findings(spark):
    text = " ".join(f"u{i % 3000}@example.com" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "scan_id int, text string")
    scanned = scans.scan_texts(df, options=ScanOptions(detectors=["EMAIL"])).persist()
    row = scanned.first()
    assert len(row["findings"]) == 5000
    assert row["findings"][4999]["placeholder"] == f"[EMAIL_{4999 % 3000 + 1}]"
    back = restore(scanned.select("scan_id", "anonymised_text"), scans.placeholder_map(scanned)).first()
    assert back["restored_text"] == text


def test_invariants_on_the_corpus(spark, sf_dir):
    corpus = planted.corpus(spark, sf_dir)
    scanned = scans.scan_texts(corpus).persist()
    rows = scanned.collect()
    for row in rows:
        raw, at = row["text"].encode(), 0
        for f in row["findings"]:
            assert f["start"] >= at and raw[f["start"] : f["end"]].decode() == f["text"]
            at = f["end"]
    back = restore(scanned.select("scan_id", "anonymised_text"), scans.placeholder_map(scanned))
    assert {r["scan_id"]: r["restored_text"] for r in back.collect()} == {r["scan_id"]: r["text"] for r in rows}
    other = scans.scan_texts(corpus.repartition(1)).select("scan_id", "anonymised_text")
    assert sorted(map(tuple, other.collect())) == sorted((r["scan_id"], r["anonymised_text"]) for r in rows)


def test_restore_leaves_unknown_placeholders(spark):
    redacted = spark.createDataFrame([(1, "[EMAIL_1] [EMAIL_2]\x01[X_1]")], "scan_id int, anonymised_text string")
    mapping = spark.createDataFrame([(1, "[EMAIL_1]", "a@b.de")], "scan_id int, placeholder string, text string")
    assert restore(redacted, mapping).first()["restored_text"] == "a@b.de [EMAIL_2]\x01[X_1]"


def test_restore_looks_behind_brackets_only(spark):
    odd = ["[[EMAIL_1]]", "[EMAIL_1", "[EMAIL_12345678901]x", "]EMAIL_1][", "[EMAIL_1][EMAIL_1]\n", "\x01[EMAIL_2][", "[email_1]", "[EMAIL_01]"]
    masked = spark.createDataFrame(list(enumerate(odd)), "scan_id int, anonymised_text string")
    vault = spark.createDataFrame([(i, "[EMAIL_1]", "a[@]b") for i in range(len(odd))], "scan_id int, placeholder string, text string")
    back = restore(masked, vault)
    assert [r.restored_text for r in back.orderBy("scan_id").collect()] == [
        "[a[@]b]", "[EMAIL_1", "[EMAIL_12345678901]x", "]EMAIL_1][", "a[@]ba[@]b\n", "\x01[EMAIL_2][", "[email_1]", "a[@]b",
    ]
    assert "(?<=" not in back._jdf.queryExecution().toString()

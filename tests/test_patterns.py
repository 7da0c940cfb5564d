"""The restated patterns find what the plain RE2 ones find, on random texts made of awkward parts."""

import random

import duckdb

from pyspark.sql import functions as F

from checks import oracle
from redactlake.functions import hits
from redactlake.functions.arrays import bind
from redactlake.functions.detectors import _runs, candidates_of
from redactlake.functions.patterns import RUN_TYPES
from redactlake.operators.scans import candidates

PARTS = {
    "ADDRESS": (
        ["Haupt", "straße", "Str", "str", "Weg", "-", "--", " ", "  ", "\t", ".", "12", "5", "a", "/", ",", "10115", "8001"]
        + ["Berlin", "Im", "Am", "In der", "in  der", "x", "ß", "ẞ", "ſ", "K", "Ä", "berg", "tal", "thal", "Bad", "\n", "\x0b"]
    ),
    "EMAIL": ["a", "B", "_", ".", "%", "+", "-", "@", "b.de", ".com", "x.y", "ſ", "K", "é", " ", "..", "%%%%%%%%%", "9", "c.d_"],
    "PHONE": ["0", "1", "+49", "0049", " ", "(", ")", "(0)", "-", "/", "030", "+", "123", "4567", "89", "\n", "x"],
    "CREDIT_CARD": ["4", "1111", "11111", "111111", "1234567", " ", "-", "x", "4111 1111 1111 1111", "0"],
    "IBAN": ["DE", "89", "3704", "0044", "0532", "0130", "00", " ", "X", "_", "ä", "NO", "93", "8601", "1117", "947", "a", "DE89370400440532013000", "NO9386011117947"],
    "LICENSE_PLATE": ["B", "Ö", "MÜN", "-", " ", "AB", "1", "234", "0", "E", "H", "x", "ä", "_", "9"],
    "TAX_ID": ["8", "6", "095", "742", "719", " ", "_", "x", "ä", "0"],
    "PERSONAL_ID": ["A", "B1", "C22990047", "9", "ä", "_", " ", "x", "12345678"],
    "SOCIAL_SECURITY": ["65180675B003", "12 345678 X 123", "12", "65", "180675", "B", "X", "003", "123", " ", "  ", "x", "ä", "_", "0"],
    "VAT_ID": ["DE123456789", "DE 123 456 789", "DE", "de", " ", "123", "456", "789", "12345678", "9", "x", "ä", "_"],
    "KVNR": ["T123456780", "T", "A", "123456780", "000000002", "12345678", "9", "ä", "_", " ", "t"],
    "DRIVER_LICENSE": ["Führerschein: B951204XY", "B951204XY", "Führerschein", "FS-Nr. ", "licence ", "B951204XY", "B", "951204", "XY", "1", " ", "ü" * 90, "_", "x"],
    "SECRET": ["token: ", "api_key", "passwd", "=", ":", " ", '"', "abcdefgh", "12345678", "1234567890abcdefgh", "_", "eyJ", ".", "-", "AKIA", "ABCDEFGH", "ä", "ſecret"],
    "URL_SECRET": ["?", "&", "key", "token", "=", "a", "b1", "#", " ", "ä", " ", "\x85", "x"],
}

ADDRESS_SKELETONS = [
    "{p}{p}{n}{p}straße 5, 10115 Berlin{p}{n}",
    "{n}{p}{n}{p} Weg 12{p}{p} 8001 Bad{p}{n}",
    "{p}{n}-{n}{p}tal. 7{p}a{p}/{p}3, 79279 Ort{p}",
    "{n}--{n}weg 1 10115 Wien {n}",
]


def texts(pii_type, rng, n):
    parts = PARTS[pii_type]
    for _ in range(n):
        if pii_type == "ADDRESS" and rng.random() < 0.8:
            out = "".join(
                piece if not piece.startswith("{") else rng.choice(parts if piece == "{p}" else ["Haupt", "Ab", "x", "Im", "ßa", "bergstraße"])
                for piece in split_skeleton(rng.choice(ADDRESS_SKELETONS))
            )
            yield out
        else:
            yield "".join(rng.choice(parts) for _ in range(rng.randrange(1, 22)))


def split_skeleton(skeleton):
    out, rest = [], skeleton
    while rest:
        if rest[0] == "{":
            out.append(rest[:3])
            rest = rest[3:]
        else:
            cut = rest.find("{") if "{" in rest else len(rest)
            out.append(rest[:cut])
            rest = rest[cut:]
    return out


def test_same_matches_as_the_plain_patterns(spark):
    rng = random.Random(11)
    for pii_type in PARTS:
        rows = list(enumerate(texts(pii_type, rng, 4000)))
        df = spark.createDataFrame(rows, "scan_id int, text string").repartition(4)
        mine = candidates(df, detectors=[pii_type]).select("scan_id", "start", "end", "text", "confidence", "rule_id")
        con = duckdb.connect()
        con.execute("create table corpus(scan_id int, text varchar)")
        con.register("rows", df.toPandas())
        con.execute("insert into corpus select scan_id, text from rows")
        ctes = oracle.candidate_ctes(types=[pii_type])
        theirs = con.execute(f'with {ctes} select scan_id, start, "end", text, confidence, rule_id from cand').fetchall()
        left, right = set(map(tuple, mine.collect())), set(theirs)
        by_id = dict(rows)
        assert left == right, [(by_id[r[0]], r) for r in sorted(left ^ right, key=str)[:4]]
        assert len(left) > 10, pii_type


def test_long_runs_take_linear_time(spark):
    """Texts on which plain backtracking would take hours."""
    n = 200_000
    nasty = [
        "a." * n + " @",
        "%2F" * n + "@",
        "x-" * n + " 5 @ 8001 ",
        "Hauptstraße 5" + " " * n + "x 5, 10115 Berlin",
        "eyJ-" * n + "AKIA",
        "token" + " " * n + "=1234567890123456",
        "9" * n + "@" + "DE" * n,
    ]
    df = spark.createDataFrame(list(enumerate(nasty)), "scan_id int, text string").repartition(4)
    assert candidates(df).where("pii_type = 'ADDRESS'").count() == 0


FILLERS = ["", " ", "\n", " und dann; ", ". Kurz gesagt ", "\x03", "\x03A\x03", "\x01", "é", "@", "ein Wort ohne alles, ja " * 3, "🙂" * 9, "(", "-"]


def test_texts_cut_down_give_the_same_matches(spark, monkeypatch):
    """Cut down to what can have a part in a match, texts give what they give when they are searched whole."""
    rng = random.Random(12)
    rows = [(0, None), (1, ""), (2, "4"), (3, "\x03"), (4, "\x0312\x03")]
    for pii_type in PARTS:
        awkward = list(texts(pii_type, rng, 900))
        rows += [(len(rows) + i, rng.choice(FILLERS).join(rng.choices(awkward, k=rng.randrange(1, 6)))) for i in range(500)]
    df = spark.createDataFrame(rows, "scan_id int, text string").repartition(4).persist()
    for types in (None, ["ADDRESS"], ["EMAIL"], RUN_TYPES[:3], RUN_TYPES[3:]):
        found = {}
        for least in (0, 1 << 30):
            monkeypatch.setattr(hits, "SHORT_BYTES", least)
            found[least] = sorted(map(str, df.select("scan_id", candidates_of(F.col("text"), types).alias("found")).collect()))
        assert found[0] == found[1 << 30], types
    df.unpersist()


def test_long_texts_are_cut_down(spark):
    """Only runs and the characters at their ends are left to be searched by ten detectors."""
    prose = "Ein Satz ohne alles, und noch einer. " * 3000
    df = spark.createDataFrame([(f"{prose}Ruf an: 0171 1234567! {prose}",), (prose,)], "text string")
    short, none = [r[0] for r in df.select(_runs(F.col("text"))).collect()]
    assert "0171 1234567!" in short and len(short) < 60 and none is None


def test_bound_values_are_used_without_an_array_around_the_result(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    bound = bind(F.col("t"), lambda a: bind(F.length(a), lambda n: F.struct(F.concat(a, a).alias("twice"), n.alias("n"), a.isNull().alias("none"))))
    picked = rows.select(bound.alias("b")).select("b.*")
    assert [tuple(r) for r in picked.collect()] == [("abab", 2, False), (None, None, True)]
    # an element taken out of an array of results costs a walk through the type of the whole expression for every row
    plan = rows.select(bound.alias("b"))._jdf.queryExecution().analyzed().toString()
    assert "transform(array(" not in plan


def test_one_match_has_the_place_that_it_has_among_several(spark):
    rows = spark.createDataFrame([("äx7y",), ("7",), ("7y 7ü",), ("ab",), ("",), (None,)], "t string")
    search = hits.Search(F.col("t"), "7", F.lit(True))
    rows_of_hits = rows.select(hits.hits_of_all([search])[0].alias("h"))
    got = [[tuple(h) for h in r.h] for r in rows_of_hits.collect()]
    one = [(3, 4, "7", "x", "y")]
    assert got == [one, [(0, 1, "7", "", "")], [(0, 1, "7", "", "y"), (3, 4, "7", " ", "ü")], [], [], []]
    # a search with one match isn't folded
    assert " = 3)" in rows_of_hits._jdf.queryExecution().analyzed().toString()

"""Inputs derived from the given tables.

The tables hold few or none of most data types, so every document and every conversation turn gets sentences computed
from its key. The expressions are plain SQL that means the same in Spark and in the engine used for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactlake.operators.scans import spread

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string), {width}, '0')"


def _letter(expr: str) -> str:
    return f"substr('{LETTERS}', cast(({expr}) % 26 as int) + 1, 1)"


def _iban(k: str) -> str:
    account = _digits(f"({k} * 1000003 + 37040044) % 1000000000000000000", 18)
    rest = f"cast(cast(concat({account}, '131400') as decimal(38, 0)) % 97 as int)"
    # every fifth one gets a wrong check number
    check = _digits(f"98 - {rest} - case when {k} % 5 = 0 then 1 else 0 end", 2)
    return f"concat('DE', {check}, {account})"


def _hash(k: str) -> str:
    return f"md5(cast({k} as string))"


def _card(k: str) -> str:
    return (
        f"concat('4', {_digits(f'{k} % 1000', 3)}, ' ', {_digits(f'({k} * 7) % 10000', 4)}, ' ',"
        f" {_digits(f'({k} * 13) % 10000', 4)}, ' ', {_digits(f'({k} * 31) % 10000', 4)})"
    )


def sentence(k: str) -> str:
    """SQL for a text that depends on the integer expression ``k``."""
    k = f"({k} % 1000000007)"
    email = f"concat('kontakt.', {k}, '@firma', {k} % 7, '.example.de')"
    code = f"concat({_letter(k)}, {_digits(f'({k} * 9176) % 1000000', 6)}, {_letter(f'{k} + 3')}, {_letter(f'{k} * 5')})"
    cases = [
        f"concat('Schreib an ', {email}, ' oder ', {email}, ' und a', {k} % 3, '@b.example.com.')",
        f"concat('Ruf an: 0171 ', {_digits(f'({k} * 7919) % 10000000', 7)}, ', Büro +49 (0) 30-', "
        f"{_digits(f'({k} * 31) % 1000000', 6)}, ' oder +', {_digits(f'{k} + 490301234', 12)}, '.')",
        f"concat('Karte ', {_card(k)}, ', auch ', replace({_card(f'{k} * 3')}, ' ', ''), '.')",
        f"concat('Überweise auf ', {_iban(k)}, ' bitte.')",
        f"concat('Konto ', {_iban(k)}, ' UND MEHR, dann ', {_iban(f'({k} + 1)')}, '.')",
        f"concat('IdNr: ', {_digits(f'10 + {k} % 90', 2)}, ' ', {_digits(f'({k} * 37) % 1000', 3)}, ' ', "
        f"{_digits(f'({k} * 101) % 1000', 3)}, ' ', {_digits(f'({k} * 17) % 1000', 3)}, ' im Bescheid')",
        f"concat('SVN ', {_digits(f'{k} % 100', 2)}, ' ', {_digits(f'({k} * 577) % 1000000', 6)}, ' ', {_letter(k)}, "
        f"' ', {_digits(f'({k} * 3) % 1000', 3)}, '; KVNR ', {_letter(k)}, {_digits(f'({k} * 524287) % 1000000000', 9)})",
        f"concat('USt-IdNr. DE ', {_digits(f'{k} % 1000', 3)}, ' ', {_digits(f'({k} * 11) % 1000', 3)}, ' 007, Pass ä', "
        f"{_letter(k)}, {_digits(f'({k} * 99991) % 100000000', 8)})",
        f"concat('Wagen ', case when {k} % 2 = 0 then 'ÖHR' else 'MÜN' end, '-', {_letter(k)}, ' ', {k} % 9000 + 1, "
        f"'E und B ', {_letter(k)}, 'X ', {k} % 900 + 10)",
        f"concat('Führerscheinnummer: ', 'ab ', 'KX', {_digits(f'({k} * 9176) % 1000000', 6)}, 'Q', {k} % 10, ' und ', {code}, '.')",
        f"concat('Fahrerlaubnis ', repeat('ü', cast(80 + {k} % 40 as int)), ' BCD', {_digits(f'({k} * 13) % 1000000', 6)}, 'X1 ab')",
        f"concat('Lieferung an Lindenhof Str. ', {k} % 99 + 1, 'B, ', {_digits(f'54000 + {k} % 999', 5)}, "
        f"' Übersee, Rückfragen per Mail an ', {email})",
        f"concat('kim Bahnhofstrasse ', {k} % 50 + 1, ' / 3, 8001 Zürich; Mariahilfer - Straße ', {k} % 70 + 1, "
        f"' , 1070 Wien-Neubau')",
        f"concat('key=AKIA', upper(substr({_hash(k)}, 1, 16)), ' ghp_', substr(concat({_hash(k)}, {_hash(k)}), 1, 36), "
        f"' password: \"', substr({_hash(k)}, 1, 20), '\"')",
        f"concat('https://h', {k} % 9, '.example.com/p?id=', {k}, '&token=', substr({_hash(k)}, 1, 12), '&x=1#t und ?KEY=AKIA', "
        f"upper(substr({_hash(k)}, 3, 16)), ' ?auth=me@host', {k} % 5, '.example.org')",
        f"concat('Nichts zu sehen in Zeile ', {k})",
    ]
    whens = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return f"case cast(({k}) % {len(cases)} as int) {whens} end"


CORPUS_TEXT = f"concat(text, chr(10), {sentence('doc_id')}, ' ', {sentence('(doc_id * 7 + 3)')})"
REQUEST_ID = "conv_id * 1000 + turn"
TURN_TEXT = f"concat(text, ' ', {sentence('(conv_id * 31 + turn)')})"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with planted sentences: scan_id, text."""
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.selectExpr("doc_id as scan_id", f"{CORPUS_TEXT} as text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation turns with planted sentences: request_id, conv_id, turn, role, text."""
    conversations = spread(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return conversations.selectExpr(
        f"{REQUEST_ID} as request_id", "conv_id", "turn", "role", f"{TURN_TEXT} as text"
    )


def _quoted(text: str) -> str:
    """JSON string literal of a text without control characters other than line breaks and tabs."""
    out = f"replace({text}, chr(92), concat(chr(92), chr(92)))"
    for char, escape in ((34, 34), (10, 110), (13, 114), (9, 116)):
        out = f"replace({out}, chr({char}), concat(chr(92), chr({escape})))"
    return f"concat(chr(34), {out}, chr(34))"


# JSON strings that a body is put together from
BODY_PARTS = [
    f"{_quoted('text')} as said",
    f"{_quoted(sentence('(request_id + 1)'))} as extra",
    f"{_quoted(sentence('(request_id + 2)'))} as more",
]


def layouts(masked: list[list[str]], said: str, extra: str, more: str) -> list[str]:
    """A request body in each of eleven layouts. ``masked[i]``: what stands in layout i where texts are masked; the other expressions stand
    where nothing is."""
    system = '{"system": "Contact support@example.com", "messages": ['
    opening = f"concat('{system}', '{{\"role\": \"assistant\", \"content\": \"ask boss@example.com\"}}, "

    def message(content: str) -> str:
        return f"{opening}{{\"role\": \"', role, '\", \"content\": ', {content}, '}}]}}')"

    m = masked
    return [
        message(m[0][0]),
        message(f"concat('[{{\"type\": \"text\", \"text\": ', {m[1][0]}, '}}, {{\"type\": \"image\", \"text\": ', {extra}, '}}]')"),
        message(f"concat('[{{\"type\": \"tool_result\", \"tool_use_id\": \"x\", \"content\": ', {m[2][0]}, '}}]')"),
        message(
            f"concat('[{{\"type\": \"tool_result\", \"content\": [{{\"type\": \"text\", \"text\": ', {m[3][0]}, '}}, "
            f"{{\"type\": \"other\", \"text\": ', {m[3][1]}, '}}, \"plain\"]}}]')"
        ),
        message(
            f"concat('[{{\"type\": \"tool_use\", \"input\": {{\"a\": ', {m[4][0]}, ', \"b\": {{\"c\": ', {m[4][1]}, ', \"d\": [', {more}, "
            f"'], \"e\": {{\"f\": {{\"g\": ', {m[4][2]}, '}}}}}}, \"n\": 5}}}}]')"
        ),
        "text",
        f"concat('[', {said}, ']')",
        "''",
        # a string that looks like a list of blocks
        message(m[8][0]),
        f"concat('{{\"messages\": ', {said}, ', ', text)",
        # a repeated key
        f"concat('{{\"model\": \"a\", \"model\": \"b\", \"messages\": [{{\"role\": \"user\", \"content\": ', {m[10][0]}, '}}]}}')",
    ]


def by_layout(cases: list[str]) -> str:
    whens = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return f"case cast(request_id % {len(cases)} as int) {whens} end"


LISTED = "concat(chr(34), '[{', substr(said, 2, length(said) - 2), '}]', chr(34))"
_PLAIN = [["said", "extra", "more"]] * 8 + [[LISTED]] + [["said"]] * 2
BODY = by_layout(layouts(_PLAIN, "said", "extra", "more"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies: request_id, conv_id, body."""
    rows = turns(spark, sf_dir).selectExpr("*", *BODY_PARTS)
    return rows.selectExpr("request_id", "conv_id", f"{BODY} as body")

import random

import pytest

EXTRA = "head string, digest string, score double, row string, part int, edge string, key bigint, rest string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "h", "d", 0.5, "r", 1, "e", 2, "x")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns that operators might use names of."""

    def frame(rows):
        return spark.createDataFrame([document(*row) for row in rows], SCHEMA)

    return frame


@pytest.fixture(scope="session")
def prose():
    """Some 150 invented texts with exact and near copies, shared passages and very short ones."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 7))) for _ in range(300)]
    passage = " ".join(draw.choices(vocabulary, k=90))
    texts = []
    for i in range(150):
        words = draw.choices(vocabulary, k=draw.randrange(1, 200))
        if i % 6 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 5 == 2 and texts:
            words = draw.choice(texts[: 1 + i // 2]).split(" ")
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


@pytest.fixture(scope="session")
def awkward(prose):
    """Rows (doc_id, text, lang, source) with nulls, repeated rows, ids with two texts, empty and long texts."""
    rows = [(i, text, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4]) for i, text in enumerate(prose)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \t\n", "de", "b"), (None, "no id here at all", "en", "a")]
    rows += [rows[3], rows[3], (7, "another text of the same id " * 30, "en", "b"), (203, "Ünï 漢字 🙂 " * 40, "fr", "a")]
    rows += [(204, rows[9][1].upper(), "en", "a"), (None, None, None, None), (205, "long " * 30_000 + rows[9][1], "en", "z")]
    return rows


@pytest.fixture(scope="session")
def empty(make):
    return make([])

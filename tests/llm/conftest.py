import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHING = "key long, chunk int, fp long, first long, at long, piece string, held_out boolean, shard int, component long, _copy long, removed string, mark long, place int"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def prose(seed, words=60, vocabulary=400):
    r = random.Random(seed)
    base = random.Random(99)
    names = ["".join(base.choice("abcdefghijklmnop") for _ in range(base.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(words))


def rows_of(texts):
    out = []
    for i, item in enumerate(texts):
        key, text = item if isinstance(item, tuple) else (i, item)
        out.append((key, text, "en", "s", len(text or ""), *[None] * 13))
    return out


ODD = [
    prose(1), prose(1), None, "", " \n\t ", "a", "ünï cödé 漢字 🙂 <|im_end|>", prose(2) + "\n" + prose(3) + "\n\n" + prose(2), prose(4, 20_000), "x" * 5000, "the the the " * 300,
    (3, ""), (3, ""), (None, prose(5)), (None, None), (70, prose(1)), "1234 5678 !!", "a\x00b \x85 c",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    return spark.createDataFrame(rows_of(ODD), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts):
        return spark.createDataFrame(rows_of(texts), COLUMNS).repartition(3)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    from dualview.llm.registry import vocabulary

    return vocabulary()

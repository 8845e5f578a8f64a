import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, ids long, block int, word string, label int"


def make_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, blanks, ties, repeated rows, copies, shared passages, odd characters and one very long text."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghiKLMé日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = say(30), say(120)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "Two Words"), (7, "a▁b  c\x00   é"), (7, "a▁b  c\x00   é"), (8, "x" * 300), (9, "x" * 300), (None, base), (10, base), (11, base + " more"), (12, base.upper())]
    out += [(20 + i, f"{say(r.randint(0, 40))}\n{passage} {say(r.randint(0, 40))}") for i in range(25)]
    out += [(60 + i, base.replace(" ", "  ", i)) for i in range(5)]
    out += [(80, say(3000)), (81, "WORD! & | 12 " * 50)]
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    sources = ["b", None, "a", "c", "b"]
    rows = [(i, t, None, sources[k % 5], None, 5, "k", 7, 1, "w", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

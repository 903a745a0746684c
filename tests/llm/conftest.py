import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, key long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with further columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, x, "en", "s", len(x or ""), "x", None, 1) for i, x in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts with all the odd cases: null, empty, repeated rows, null ids, ties, a long one."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Ünïcode", "ſ", "ＡＢ", "İx"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(i, text(rng.randrange(1, 90))) for i in range(40)]
    rows += [(100 + i, f"{text(20)} {passage} {text(15)}") for i in range(6)]
    rows += [(200, passage), (201, passage), (201, passage), (202, None), (203, ""), (204, " \t\n"), (None, text(50)), (None, text(50)), (205, "one"), (206, "one two three")]
    near = text(200).split()
    for i in range(12):
        own = list(near)
        own[i * 3] = f"new{i}"
        rows.append((300 + i, " ".join(own)))
    rows.append((400, f"{text(4000)} {'z' * 5000} {passage}\n{'z' * 5000}"))
    rows.append((401, " ".join(["same"] * 400)))
    return rows

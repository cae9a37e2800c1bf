import os
import random

os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")]
)

import pytest  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def made_texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empty, short, long and odd texts."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("aeiou lnrst".replace(" ", "")) for _ in range(rnd.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    base, passage = prose(150), prose(25)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rnd.randint(5, 120))) for i in range(20)]
    rows += [(30 + i, base) for i in range(4)]
    for i in range(6):
        words = base.split()
        words[rnd.randrange(len(words))] = "changed"
        rows.append((40 + i, " ".join(words)))
    rows += [(50 + i, f"{prose(10)}\n{passage}\n{prose(8)}") for i in range(4)]
    rows += [
        (60, None), (61, ""), (62, "   \n\t "), (63, "One"), (64, "two words"), (65, "é ü   日本語 don't <|endoftext|>  x"),
        (66, prose(6000)), (67, "same line here\n" * 40), (67, "same line here\n" * 40), (None, base), (None, prose(30)), (68, "a" * 300),
        (69, base + "é"), (70, "é" * 40 + base[:80]),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts with extra columns whose names the operators use inside."""
    names = "grp tkey slice kept n_words doc set_id n_tokens shard items"
    data = [(i, t, *range(10)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names.split())).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")

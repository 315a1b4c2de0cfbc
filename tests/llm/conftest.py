import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact and near copies, shared passages, nulls, empty, long and repeated rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(800)]

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, rows = words(60), []
    for k in range(160):
        text = words(rng.randint(5, 220))
        if k % 5 == 0:
            text = f"{words(40)} {passage}\n{words(30)}"
        if k % 7 == 3 and rows:
            text = rng.choice(rows)[1] or ""
        if k % 11 == 5 and rows and rows[-1][1] and len(rows[-1][1].split()) > 80:
            near = rows[-1][1].split(" ")
            near[len(near) // 2] = "edited"
            text = " ".join(near)
        rows.append((k, text, ["en", "fr", "de", None][k % 4], f"src{k % 3}" if k % 13 else None, len(text)))
    base = words(120).split(" ")
    for k in range(160, 230):  # a large group of near copies of one text
        near = list(base)
        near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append((k, " ".join(near), "en", "src0", 0))
    rows += [(300, None, "en", "src0", 0), (301, "", "en", "src0", 0), (302, "a" * 3000, "en", "src1", 3000), (303, "ab" * 700, "en", "src1", 1400), (304, words(4000), "en", "src0", 0)]
    rows += [(305, None, None, None, None), rows[3], rows[3], (None, rows[8][1], "en", "src0", 0), (306, "one two three", "en", "src2", 13), (307, "one two three", "en", "src2", 13)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(4).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

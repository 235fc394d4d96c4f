import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed: int = 5) -> list[tuple]:
    """Some of everything: two languages, copies, near copies, shared passages, nulls, empty and long texts, repeated rows, a hot source."""
    rng = random.Random(seed)
    words = {"en": [f"{a}{b}" for a in ("th", "wh", "st", "br") for b in ("ing", "er", "is", "ould", "ank")], "fr": [f"{a}{b}" for a in ("é", "qu", "l", "ch") for b in ("eau", "oix", "ienne", "ère", "ait")]}

    def text(lang: str, n: int) -> str:
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    passage = text("en", 120)
    base = [text("en", 150) for _ in range(3)]
    rows: list[tuple] = []

    def add(body, lang="en"):
        i = len(rows)
        rows.append((i, body, lang, "hot" if i % 3 == 0 else f"s{i % 5}", None if body is None else len(body)))

    for k in range(12):
        add(text("en", rng.randint(3, 90)))
        add(text("fr", rng.randint(3, 90)), "fr")
        if k % 3 == 0:
            add(base[0])
        if k % 2 == 0:
            near = base[1].split()
            for _ in range(3):
                near[rng.randrange(len(near))] = "changed"
            add(" ".join(near))
        if k % 4 == 0:
            add(text("fr", 30) + " " + passage + " " + text("fr", 20), "fr")
    for odd in (None, "", "   \n", "12 345 !!", "one two", "a", "é" * 900, "ab" * 700, text("en", 4000), "tab\tnl\n\x0b x 　 y\x1cz"):
        add(odd)
    rows.append(rows[2])  # a repeated row
    rows.append((len(rows), base[0], None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators also use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    for name in ("score", "lang_pred", "rank", "key", "g", "passes", "last", "ratio", "node", "size", "_text", "_h", "_begins"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

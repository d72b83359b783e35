import random

import pytest

COMMON = "the of and to in is that for it was on are as with be at this have from or by not".split()


def prose(rng: random.Random, n: int) -> str:
    """Sentences of invented words and function words."""
    words = [rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "so", "te"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages, repeats, short, empty, odd and long texts."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 80, 120, 150, 200, 300, 90, 110)]
    passage = prose(rng, 50)
    texts = list(base)
    texts += [base[0], base[0].upper(), base[0].replace(" ", "  "), base[2], base[2]]
    for b in (base[3], base[4], base[5]):
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = "changed" + str(rng.randrange(1000))
            texts.append(" ".join(v))
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    texts += [" ".join(["again and again"] * 30), "one two three four five six seven eight nine ten " * 12]
    texts += [None, "", " \t\n", "word", "two words", "two words", "ÄÖ ü\u2028x \u00a0y", "# * $ % | <x> " * 30, prose(rng, 30) * 3]
    texts += [prose(rng, 5000), "x" * 5000, "\n".join(["same line here"] * 9)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def items(corpus):
    rng = random.Random(6)
    inside = corpus[4][1].split()[20:40]
    return [(1, prose(rng, 30)), (2, " ".join(inside)), (3, "two words"), (4, None), (5, ""), (6, prose(rng, 5)), (7, " ".join(inside[:13])), (None, " ".join(corpus[5][1].split()[:13])), (2, prose(rng, 14))]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns that clash with the operators' own."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), i, "k", 1.5) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, uid double").repartition(3)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def nulls(spark, docs):
    """Nulls everywhere, and repeated rows."""
    rows = [(None,) * len(docs.schema)] * 2 + [(None, "some text here", None, None, None, None, None, None)] * 2 + [(5, None, None, None, None, None, None, None), (5, "other text", None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, docs.schema)

import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names an operator might use itself.
CLASHING = ", ids array<int>, cls string, kept string, n_words string, g int, _row int, _t int, component_id int, sig int, key int, pool int, host int, declared int, rule int"


def words(rnd, n, pool):
    return " ".join(rnd.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): copies, edited copies, empty, null, short, long, junk, repeated rows."""
    rnd = random.Random(5)
    pool = ["the", "of", "and"] + ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    texts = [words(rnd, rnd.randint(5, 120), pool) for _ in range(60)]
    for i in range(40):  # near copies of various closeness
        w = texts[i % 12].split(" ")
        for _ in range(rnd.randint(0, max(1, len(w) // 12))):
            w[rnd.randrange(len(w))] = rnd.choice(pool)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[1], None, "", " \n\t ", "one", "one two", "ONE two", "one two three", "a\n\na\nb\na", words(rnd, 30_000, pool), "x" * 50_000, "line one here\n" * 40]
    rows = [(i, t, rnd.choice(["en", "de", "fr", "es", None, "xx"]), f"src{rnd.randint(0, 2)}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "a text without an id", "en", "src1", 20), (None, texts[0], None, None, None), (7, "another text under a known id", "en", "src0", 1)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same with extra columns of clashing names."""
    names = [c.split() for c in CLASHING.strip(", ").replace("array<int>", "array<int>").split(", ")]
    out = docs
    for n, t in names:
        out = out.selectExpr("*", f"cast(null as {t}) as {n}")
    return out

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, `row` int, keep_id string, _block int, shard string, key string, n int"


def _row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None, 7, False, 1, "x", 3, "y", "k", 5)


@pytest.fixture(scope="session")
def corpus():
    """Plain rows (doc_id, text, lang, source): copies, near copies, repeats and odd cases."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [prose(rng.randint(20, 160)) for _ in range(24)]
    passage = prose(40)
    texts = list(base)
    for i in range(8):  # near copies, each with a word or two changed
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for i in range(30):  # many variants of one long text
        words = base[9].split() * 2
        words[3 + i] = f"variant{i}"
        texts.append(" ".join(words))
    texts += base[3:6] + [base[3]] * 3
    texts += [prose(12) + " " + passage + " " + prose(12) for _ in range(6)]
    texts += [None, None, "", " \n\t ", "ab", "one two three", "one two three", "ha " * 200, "x" * 700, "12 34 - 56", "äöü ß €uro 漢字 " * 20]
    texts.append(prose(6000))  # long
    sources = ["s0", "s0", "s1", "s2", None]
    rows = [(i * 3 % 1009, t, ["en", "fr", None][i % 3], sources[i % 5]) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([_row(*r) for r in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark, corpus):
    """Repeated rows, one doc_id with two texts, rows without doc_id."""
    rows = [*corpus[:4], corpus[0], corpus[0], (corpus[1][0], "another text " * 30, "en", "s0"), (None, corpus[2][1], "en", None), (None, None, None, None), (None, "lone words here " * 9, "fr", "s1")]
    return spark.createDataFrame([_row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

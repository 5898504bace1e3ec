import random

import pytest

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Texts with every awkward case: null, empty, blanks, symbols, repeats, ties, long and unsplit texts."""
    rng = random.Random(7)
    texts = [None, "", " ", "\n\n", "a", "Ünïcode ÄÖ 東京 🙂", "one two three four", "<|endoftext|> x <|endoftext|>", "a \n b  c\t\td", "it's we're I'LL"]
    texts += [sentence(rng, n) for n in (5, 12, 40, 200)] * 2
    texts += [sentence(rng, 3000), "word " * 500, "x" * 9000, "é" * 4000, "ab1" * 3000 + "   \n" * 900 + "!?" * 2000, "line one\nline two\nline one\n\nline one"]
    return [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The awkward texts with null and repeated ids, and columns named like those that operators make."""
    rows = [(i, t, "en", f"s{n}", n, n, n, "x") for n, (i, t) in enumerate(awkward)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, n_words long, _text string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

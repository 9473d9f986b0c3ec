"""Small documents with every odd case, shared by the tests of the subpackage."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n, vocabulary=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n))


def documents(spark, texts, ids=None):
    """A documents table with extra columns whose names clash with what operators return."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src", len(t or ""), "x", 1, 2.0) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "chunk string, component_id int, score double")


def odd_texts():
    shared = prose(1, 60)
    return [None, "", "   \n\t ", "one", shared, shared, prose(2, 20) + " " + shared + "\n" + prose(3, 10), prose(4, 200),
            prose(4, 200).replace(" ", "  \n"), "é à ü " * 30, "é à ü " * 30, " nbsp em " + shared, "x" * 5000,
            prose(5, 4000), prose(5, 1000), "the the the " * 40, "A b C " * 3]

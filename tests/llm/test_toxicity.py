import numpy as np
from cases import documents, odd_texts, prose
from rosterkit.llm.toxicity import WINDOW, fit_toxicity, score_toxicity, train, within_bytes

BAD = ["zugrotten", "blaffnik", "morpelschwein"]


def labelled(n=400):
    texts, toxic = [], []
    for i in range(n):
        words = prose(i, 40 + i % 200).split()
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for k in range(3):
                words.insert((i * 7 + 13 * k) % len(words), BAD[(i // 4 + k) % 3])
        texts.append(" ".join(words))
    return texts, toxic


def test_learns_words_and_their_misspellings(spark):
    texts, toxic = labelled()
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(toxic)] + [(5, 1, None, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    model = fit_toxicity(docs, labels)
    new = [prose(5000 + i, 300) + (f" {BAD[i % 3]}s, {BAD[(i + 1) % 3][:-1]} " if i % 2 else " ") + prose(i, 300) for i in range(60)]
    rows = score_toxicity(documents(spark, new + odd_texts()), model).select("row.doc_id", "toxic_score").orderBy("doc_id").collect()
    scores = np.array([r.toxic_score for r in rows])
    assert ((scores >= 0) & (scores <= 1)).all()
    assert (scores[1:60:2] >= 0.5).mean() > 0.9
    assert (scores[0:60:2] < 0.5).mean() > 0.9
    assert scores[60] == scores[61] < 0.5  # null and empty


def test_without_labels_of_both_classes(spark):
    docs = documents(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert {r.toxic_score for r in rows} == {0.5} or all(r.toxic_score <= 0.5 for r in rows)
    assert score_toxicity(documents(spark, []), train([], np.zeros(0))).count() == 0
    assert train(["a", "b"], np.ones(2, dtype=int)).scores(["a"])[0] > 0.9


def test_score_is_that_of_the_worst_window(spark):
    texts, toxic = labelled(120)
    model = train(texts, np.array(toxic))
    new = [t for t in odd_texts() if t and t.split()] + [prose(i, 30) + f" {BAD[i % 3]}x " + prose(i, 9) for i in range(20)]
    words = [[w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).split(" ") if w] for t in new]  # words of letters, digits and all beyond ASCII
    windows = [[" ".join(w[i:i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] for w in words]
    rows = score_toxicity(documents(spark, new * 2), model).collect()
    got = sorted((r.row.doc_id, r.toxic_score) for r in rows)
    want = [max(model.scores(w)) for w in windows]
    assert np.allclose([s for _, s in got], want * 2, atol=1e-6)


def test_sample_takes_texts_of_all_lengths_within_a_total():
    class Row:
        def __init__(self, size):
            self.size = size

    rows = [Row(s) for s in (5, 90, None, 10, 4, 1)]
    assert [r.size for r in within_bytes(rows, 20)] == [5, None, 10, 4, 1]

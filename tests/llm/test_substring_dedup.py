import re
from collections import Counter

from cases import documents, odd_texts, prose
from rosterkit.llm.substring_dedup import remove_repeats


def brute_force(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, window):
    rows = remove_repeats(documents(spark, texts).repartition(4), window).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows)
    assert got == [(i, *x) for i, x in enumerate(brute_force(texts, window))]


def test_odd_texts_as_brute_force(spark):
    for window in (35, 6):
        check(spark, odd_texts(), window)


def test_few_words_repeat_everywhere(spark):
    check(spark, [prose(i, 80, ["a", "b"]).replace("1", "") for i in range(40)], 5)


def test_empty_table_and_null_ids(spark):
    assert remove_repeats(documents(spark, [])).count() == 0
    text = prose(9, 50)
    rows = remove_repeats(documents(spark, [text, text, "x"], [None, 7, 7])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (False, 50), (True, 50)]

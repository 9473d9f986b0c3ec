import re

import numpy as np
from cases import documents, odd_texts, prose
from pyspark.sql import functions as F
from rosterkit.llm.decontamination import find_leaks, hit_words, item_pieces
from rosterkit.llm.fm_index import FMIndex


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(texts, items, size):
    out = []
    for text in texts:
        words, hit, named = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            for window in {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))} if own else ():
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i:i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        named.add(str(item_id))
        out.append((len(words), len(hit), sorted(named - {"None"})))
    return out


def check(spark, texts, items, size, block_bytes=1 << 20):
    benchmark = spark.createDataFrame([(*x, "en") for x in items], "item_id long, text string, row string")
    found = find_leaks(documents(spark, texts).repartition(3), benchmark, size, clean=True, block_bytes=block_bytes)
    rows = found.select("row.*", "n_words", hit_words("spans").alias("n_hit"), "items", "clean_text").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == brute_force(texts, items, size)
    for r in rows:
        assert (r.clean_text == r.text) if not r.n_hit else len(words_of(r.clean_text)) == r.n_words - r.n_hit


def test_odd_texts_as_brute_force(spark):
    texts = odd_texts() + ["Zum THE the, the-the; THE the! the the the the.", prose(4, 200).upper()]
    items = [(1, prose(4, 25)), (2, prose(1, 60)), (2, prose(1, 60)), (10, "one"), (11, ""), (12, None), (13, "the " * 12),
             (None, prose(5, 30)), (14, "é à ü é à"), (15, prose(5, 14)), (16, "nbsp em")]
    check(spark, texts, items, 10)
    check(spark, texts, items, 4, block_bytes=200)


def test_pieces_of_a_long_item_have_its_windows():
    for most in (1, 30, 200, 10_000):
        for text in (prose(3, 150), "Ab-cD " * 40, "x" * 500, "é à-ü, " * 30, "one two"):
            def windows(t, n=5):
                w = words_of(t)
                return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
            pieces = item_pieces(text, 5, most)
            assert set().union(*map(windows, pieces)) == windows(text)
            assert all(len(p) <= max(most, max(len(" ".join(w)) for w in windows(text)) + 40) for p in pieces)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")], 10)
    check(spark, ["a b"], [], 10)


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    for kinds in (3, 40):
        runs = [rng.integers(1, kinds, rng.integers(1, 90)) for _ in range(60)]
        text = np.concatenate([np.append(r, 0) for r in runs])
        index = FMIndex(text, kinds)
        phrases = np.array([text[i:i + 3] for i in range(len(text) - 3) if 0 not in text[i:i + 3]] + [[1, 1, 1]])
        found, low, high = index.search(phrases)
        places = {int(f): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high)}
        for k, phrase in enumerate(phrases):
            real = [i for i in range(len(text) - 2) if (text[i:i + 3] == phrase).all()]
            assert places.get(k, []) == real

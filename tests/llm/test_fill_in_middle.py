import hashlib
import re
import time

import numpy as np
from cases import documents, odd_texts, prose
from pyspark.sql import functions as F
from rosterkit.llm.fill_in_middle import CodePoints, fill_in_middle, restored


def expected(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, texts, ids=None, **options):
    ids = list(range(len(texts))) if ids is None else ids
    rows = fill_in_middle(documents(spark, texts, ids).repartition(3), **options)
    rows = rows.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted([(r.row.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in rows], key=repr)
    assert got == sorted([(i, expected(i, t, options.get("seed", 1))) for i, t in zip(ids, texts)], key=repr)
    assert sorted(r.back for r in rows) == sorted(t or "" for t in texts)
    assert all(r.row.lang == "en" and r.row.component_id == 1 for r in rows)
    return rows


def test_odd_texts_match_the_plain_rule(spark):
    marks = ["a <P> b", "<S>", "x<M>", "<", "<P", "P>", "ends with <", "<S<M", ">a", "\U0001f600", "a\U0001f600é中b" * 9, "\x00a\x00", "é"]
    rows = check(spark, odd_texts() + marks)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    check(spark, odd_texts(), seed=7)


def test_repeated_and_null_ids(spark):
    rows = check(spark, [prose(1, 30)] * 3 + ["é b", None, "x y z"], [5, 5, 6, None, None, None])
    assert len({r.output for r in rows if r.row.doc_id == 5}) == 1


def test_many_short_texts_and_borders_at_marks(spark):
    rng = np.random.default_rng(3)
    parts = ["<", "P", "S", ">", "M", "é", "\U0001f600", "ab", " ", "\n", "7"]
    check(spark, ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)])


def test_given_cuts_are_code_points(spark):
    docs = documents(spark, ["aé\U0001f600bc", "abc", None, "中" * 5]).withColumn("a", F.lit(3)).withColumn(
        "b", F.when(F.col("doc_id") == 1, 99).otherwise(1))
    rows = sorted(fill_in_middle(docs, percent=100, spm_percent=0, cuts=("a", "b")).collect(), key=lambda r: r.row.doc_id)
    assert [r.output for r in rows] == ["<P>a<S>bc<M>é\U0001f600", "<P>abc<S><M>", "", "<P>中<S>中中<M>中中"]
    assert [(r.prefix_chars, r.middle_chars) for r in rows] == [(1, 2), (3, 0), (None, None), (1, 2)]


def test_index_converts_both_ways():
    text = "".join(np.random.default_rng(5).choice(list("abé中\U0001f600"), 5000))
    index = CodePoints(np.frombuffer(text.encode(), dtype=np.uint8))
    ends = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    assert (index.of_bytes(ends) == np.arange(len(ends))).all()
    assert (index.to_bytes(np.arange(len(ends))) == ends).all()
    assert len(CodePoints(np.frombuffer(b"plain ascii", dtype=np.uint8)).places) == 0


def test_time_grows_with_the_length_of_one_text(spark):
    took = []
    for n in (1_000_000, 2_000_000):
        docs = documents(spark, ["wörd one, " * (n // 10)], [11]).select("doc_id", "text")
        fill_in_middle(docs).count()
        start = time.perf_counter()
        assert fill_in_middle(docs).select(F.char_length("output")).first()[0] >= n - 10
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 0.5


def test_empty_table(spark):
    assert check(spark, []) == []

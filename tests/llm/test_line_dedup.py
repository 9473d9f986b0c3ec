import time
from collections import Counter, defaultdict

from cases import documents, odd_texts, prose
from rosterkit.llm.line_dedup import drop_recurring_lines


def run(spark, texts, ids=None):
    rows = drop_recurring_lines(documents(spark, texts, ids).repartition(3)).collect()
    assert all(r.row.lang == "en" and r.row.component_id == 1 for r in rows)
    return rows


def letters(seed, n):
    return "".join(c for c in prose(seed, n) if not c.isdigit())


def tag(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def brute_force(texts, least=5):
    """Kept texts: every template of every line against all texts; ids differ."""
    import re

    def parse(line):
        plain = re.findall(r"[^\x20\x09-\x0D]+", line)
        masked = ["<*>" if re.search("[0-9]", t) else t for t in plain]
        return tuple(masked if 2 * masked.count("<*>") <= len(masked) else plain)

    lines = [(d, i, parse(line)) for d, t in enumerate(texts) if t is not None for i, line in enumerate(t.split("\n"))]
    leaf = {(d, i): (len(w), w[:2]) for d, i, w in lines if len(w) >= 3}
    sizes = Counter(leaf.values())
    forms = defaultdict(set)
    for d, i, w in lines:
        if (d, i) in leaf:
            forms[leaf[d, i]].add(w)
    counts = Counter((leaf[d, i], p, t) for d, i, w in lines if (d, i) in leaf for p, t in enumerate(w) if t != "<*>")
    seen, signs = defaultdict(set), defaultdict(list)
    for d, i, w in lines:
        if not w:
            continue
        made = [("whole", w)]
        at = leaf.get((d, i))
        if at and sizes[at] >= least and len(forms[at]) > 1:
            for bound in (least, max(least, sizes[at] / 10)):
                fixed = tuple((p, t) for p, t in enumerate(w) if t != "<*>" and counts[at, p, t] >= bound)
                if 3 * len(fixed) >= 2 * len(w):
                    made.append((at, fixed))
        for sign in made:
            seen[sign].add(texts[d])
            signs[d, i].append(sign)
    gone = {at for at, found in signs.items() if any(len(seen[s]) >= least for s in found)}
    return [None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


def check(spark, texts):
    rows = sorted(run(spark, texts), key=lambda r: r.row.doc_id)
    kept = brute_force(texts)
    assert [r.kept_text for r in rows] == kept and [r.row.text for r in rows] == texts
    return rows, kept


def test_drops_templates_and_keeps_the_rest(spark):
    own = [letters(i, 40) + "\n" + letters(1000 + i, 40) for i in range(30)]
    fixed = "all rights reserved"
    logged = [f"request {i} served for user {i * 7} in {i} ms by host alpha" for i in range(30)]
    named = [f"this page was last changed by {letters(50 + i, 1)} and is kept under the usual terms" for i in range(30)]
    texts = [f"{a}\n{fixed}\n{b}\n\n{c}" for a, b, c in zip(own, logged, named)]
    rows = sorted(run(spark, texts), key=lambda r: r.row.doc_id)
    assert [r.kept_text for r in rows] == [a + "\n" for a in own]
    assert {(r.n_lines, r.n_dropped) for r in rows} == {(6, 3)}


def test_short_templates_and_fields_at_any_place(spark):
    def name(i):
        return "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7)) + "o"

    texts = []
    for i in range(40):
        lines = [f"Posted by {name(i)} in Travel", f"From the {name(i)} desk of {name(i + 1)} with many kind regards to all",
                 f"Signed by {name(i % 6)} on behalf of {['Sales', 'Support'][i % 2]}", letters(i, 25), letters(3000 + i, 3)]
        texts.append("\n".join(lines))
    rows, kept = check(spark, texts)
    assert [k.count("\n") for k in kept] == [1] * 40 and {r.n_dropped for r in rows} == {3}


def test_random_mixtures_match_brute_force(spark):
    import random

    rng = random.Random(8)
    words = ["aa", "bb", "cc", "dd", "ee", "7", "x9"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    check(spark, texts + texts[:40] + [None, ""])


def test_copies_and_rare_lines_stay(spark):
    copy = letters(1, 50) + "\n" + letters(2, 50)
    texts = [copy] * 9 + [letters(i, 30) + "\nseen in few documents" for i in range(4)]
    assert all(r.kept_text == r.row.text and r.n_dropped == 0 for r in run(spark, texts))


def test_rows_of_numbers_are_no_template(spark):
    texts = [f"{letters(i, 20)}\n{i} {i * 3} {i * 7} total {i + 1}" for i in range(20)]
    assert [r.n_dropped for r in run(spark, texts)] == [0] * 20


def test_odd_texts(spark):
    texts = odd_texts()
    rows = sorted(run(spark, texts), key=lambda r: r.row.doc_id)
    assert [r.kept_text for r in rows] == texts
    assert rows[0].n_lines == 0 and rows[1].n_lines == 1
    assert run(spark, []) == []
    rows = run(spark, ["x y\nsame line here"] * 6 + [None], [None] * 3 + [4] * 3 + [None])
    assert len(rows) == 7


def test_equal_rows_have_the_templates_of_one(spark):
    texts = [f"{letters(i, 20)}\nposted by {tag(i * 37)} in travel and more" for i in range(12)]
    rows = run(spark, texts * 2, list(range(12)) * 2)
    assert {r.n_dropped for r in rows} == {1} and len(rows) == 24


def test_short_pages_with_long_boilerplate_lose_it(spark):
    block = "\n".join(letters(900 + i, 30) for i in range(4))
    pages = [f"{block}\n{letters(i, 6)}" for i in range(8)]
    copies = [letters(500, 20) + "\n" + letters(501, 20)] * 6
    rows = sorted(run(spark, pages + pages[:1] + copies + [block]), key=lambda r: r.row.doc_id)
    own = [letters(i, 6) for i in range(8)]
    assert [r.kept_text for r in rows] == own + own[:1] + copies + [""]
    assert [r.n_dropped for r in rows] == [4] * 9 + [0] * 6 + [4]


def test_time_grows_with_the_lines_of_a_text(spark):
    took = []
    for n in (40_000, 80_000):
        texts = ["\n".join([f"own {tag(i)} {tag(5 * i + d)} of{tag(d)}" for i in range(n)] + ["one line in common"]) for d in range(5)]
        start = time.perf_counter()
        assert [r.n_dropped for r in drop_recurring_lines(documents(spark, texts)).select("n_dropped").collect()] == [1] * 5
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 1

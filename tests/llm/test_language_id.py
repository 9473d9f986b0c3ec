import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from rosterkit.llm.language_id import BUCKETS, declared_language, domain_of, host_of, identify_languages, page_text, suffix_of

LETTERS = {"en": "the and ing tion with for that this".split(), "de": "der die und sch keit für über nicht".split()}


def speech(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(LETTERS[lang]) for _ in range(n))


def corpus(spark):
    rows = [(i, speech(lang, i), lang, "s") for i, lang in enumerate(["en", "de"] * 40)] + [(900, None, "en", "s"), (901, "x", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")


def page(lang, text):
    return f'<html lang="{lang}"><head><script>var the = "and";</script></head><body><nav>menu</nav><p>{text}</p></body></html>'


def test_text_decides_and_the_rest_breaks_ties(spark):
    pages = [(i, f"https://a{i % 4}.one.de/x", page("de-DE", speech("de", i)), "x") for i in range(40)]
    pages += [(100 + i, f"https://b{i % 4}.two.com/x", page("en", speech("en", i)), "x") for i in range(40)]
    pages += [(200, "https://b1.two.com/", page("de", speech("en", 5, 60)), "x"),  # text against the declaration
              (201, "https://a1.one.de/", page("", "12 34"), "x"), (202, "https://b1.two.com/", page("", ""), "x"),
              (203, None, page("en", ""), "x"), (204, None, page("de", "zz"), "x"), (205, "no address", None, "x"),
              (205, "no address", None, "x"), (None, "https://new.one.de:80/", "", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, lang string")
    rows = identify_languages(table, corpus(spark)).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    assert all(got[i].lang == "de" for i in range(40)) and all(got[100 + i].lang == "en" for i in range(40))
    assert got[200].lang == "en" and got[200].declared == "de"
    assert (got[201].lang, got[202].lang, got[203].lang, got[204].lang, got[None].lang) == ("de", "en", "en", "de", "de")
    assert all(0 < r.probability <= 1 for r in rows) and 0.4 < got[205].probability


def test_empty_tables(spark):
    schema = "page_id long, url string, html string"
    assert identify_languages(spark.createDataFrame([], schema), corpus(spark)).count() == 0
    rows = identify_languages(spark.createDataFrame([(1, "http://a.b/", "x")], schema), corpus(spark).limit(0)).collect()
    assert [(r.lang, r.host) for r in rows] == [(None, "a.b")]


def test_page_text():
    assert page_text("<!-- a --><style>b</style>c&amp;<b>d</b>").split() == ["c&", "d"]
    assert page_text(None) == ""


def test_page_text_of_open_and_nested_markup():
    def plain(markup):
        markup = re.sub(r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>", " ", markup)
        return re.sub(r"(?s)<[^>]*>", " ", markup)

    rng = random.Random(3)
    parts = ["<script", "<script>", "</script >", "<STYLE a=b>", "</style>", "<nav", "</nav>", "<!--", "-->", "<", ">", "a", " ", "<scripts>", "<p>", "--", "\n"]
    for _ in range(3000):
        markup = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert page_text(markup) == plain(markup)


@pytest.mark.parametrize("piece", ["<", "<script ", "<!--", "<html ", "<meta content-language ", "<nav></nav", "a<b "])
def test_time_grows_with_the_length_of_markup(spark, piece):
    took = []
    for size in (1_000_000, 2_000_000):
        markup = piece * (size // len(piece))
        start = time.perf_counter()
        page_text(markup)
        spark.createDataFrame([(markup,)], "html string").select(declared_language(F.col("html"))).collect()
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 1


def test_declarations_hosts_and_addresses(spark):
    cases = {'<html x><HTML class="a" lang = "DE-at">': "de", "<html><meta http-equiv=content-language content=fr>": "fr", "<html lang=x>": "",
             "<meta content=en><meta name=content-language content='es-MX'>": "es", "<htmlx lang=en>": "", "lang=en": "", None: ""}
    rows = spark.createDataFrame([(c,) for c in cases], "h string").select("h", declared_language(F.col("h")).alias("d")).collect()
    assert {r.h: r.d for r in rows} == cases
    hosts = {"http://1.2.3.4/x": ("1.2.3.4", "1.2.3.4", ""), "https://u@a.b.De:8/": ("a.b.de", "b.de", "de"), "x": (None, None, ""), None: (None, None, "")}
    host = host_of(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in hosts], "u string").select("u", host.alias("h"), domain_of(host).alias("d"), suffix_of(host).alias("s")).collect()
    assert {r.u: (r.h, r.d, r.s) for r in rows} == hosts


def brute_force(pages, docs):
    """Every step in plain Python: page_id -> (language, probability)."""
    def grams(text):
        raw = b" " + text.encode() + b"  "
        data = [ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 32 for b in raw]
        found = [data[i:i + 3] for i in range(len(data) - 2)]
        return [((x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF) >> 18 for x, y, z in found if (x, y) != (32, 32) != (y, z)]

    langs = sorted({lang for _, text, lang, _ in docs if lang and text is not None})
    counts = {lang: [0.1] * BUCKETS for lang in langs}
    for _, text, lang, _ in docs:
        if lang and text is not None:
            for g in grams(text):
                counts[lang][g] += 1
    logs = counts
    total = {lang: sum(c) for lang, c in counts.items()}
    seen = []
    for page_id, url, markup, _ in pages:
        found = grams(page_text(markup))
        weight = min(1.0, 150 / max(len(found), 1))
        like = [weight * sum(math.log(logs[lang][g] / total[lang]) for g in found) for lang in langs]
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = m[1].lower() if m else None
        domain = ".".join(host.split(".")[-2:]) if host else None
        suffix = host.split(".")[-1] if host else ""
        d = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""", markup or "")
        top = max(like)
        says = [math.exp(x - top) for x in like]
        says = [x / sum(says) for x in says]
        seen.append((page_id, like, says, host, domain, suffix, d[1].lower() if d else ""))

    def sums(rows):
        return [sum(r[2][k] for r in rows) for k in range(len(langs))]

    every = sums(seen)
    shares = [(x + 1) / (len(seen) + len(langs)) for x in every]
    out = []
    for row in seen:
        prior = shares
        for at, weight in ((4, 8.0), (3, 4.0)):
            known = [max(0.0, a - b) for a, b in zip(sums([r for r in seen if r[at] == row[at]]), row[2])] if row[at] else [0.0] * len(langs)
            prior = [(c + weight * p) / (sum(known) + weight) for c, p in zip(known, prior)]
        score = []
        for k in range(len(langs)):
            x = row[1][k] + math.log(prior[k])
            for at in (6, 5):
                kinds = {r[at] for r in seen}
                mine = sum(r[2][k] for r in seen if r[at] == row[at])
                x += math.log((mine + 1) / (every[k] + len(kinds)))
            score.append(x)
        top = max(score)
        parts = [math.exp(x - top) for x in score]
        out.append((row[0], langs[score.index(top)], max(parts) / sum(parts)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, speech(lang, i, 15), lang, "s") for i, lang in enumerate(["en", "de"] * 10)] + [(900, None, "en", "s"), (901, "x", None, "s")]
    pages = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        url = rng.choice([None, "odd", f"https://h{i % 3}.one.de/x", f"http://h{i % 2}.two.com/", f"ftp://x{i}.com"])
        pages.append((i, url, rng.choice([page(rng.choice(["de", "en", "", "fr-CA"]), speech(lang, i, rng.randrange(0, 9))), None, "", "über <b>die</b>"]), "x"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string, lang string").repartition(3)
    got = {r.page_id: (r.lang, r.probability) for r in identify_languages(table, spark.createDataFrame(docs, "doc_id long, text string, lang string, host string")).collect()}
    for page_id, lang, probability in brute_force(pages, docs):
        assert got[page_id][0] == lang and got[page_id][1] == pytest.approx(probability, rel=1e-3)

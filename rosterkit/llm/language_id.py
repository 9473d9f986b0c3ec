"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page are fused by Bayes' rule: the text, by byte-trigram likelihoods learnt from all
documents with a language; the language declared in the markup; the address suffix; and a prior of the page's host.  The
last three are learnt without labels, by grouped aggregation of what the texts of all pages say: how often pages of a
language declare each tag and carry each suffix, and how the languages share a host, smoothed towards its domain and that
towards all pages.  A page's own text is taken out of its host's and domain's counts before they judge it.

The trigram table has a fixed size and is broadcast; counts of hosts are joined, never collected, and combine before the
shuffle, so a host with a third of all pages is one row of sums.

Defined results: null or empty markup has no text evidence; an unknown or missing declaration is a value of its own; a
null or odd address has no host and meets the prior of all pages; a numeric address has no suffix; of equally probable
languages the first by name is taken; equal rows are judged alike; extra columns are ignored; without any labelled
document the language is null; markup of any length takes time in proportion.
"""

from __future__ import annotations

import bisect
import html as html_module
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterkit.llm.words import LOWER, NOT_ALPHANUMERIC
from rosterkit.operators.joins import join_small
from rosterkit.session import stage

BUCKETS = 1 << 14
TEXT_TRIGRAMS = 150  # a text of more trigrams counts as this many: they are not independent
HOST_WEIGHT, DOMAIN_WEIGHT = 4.0, 8.0
_OPENING = re.compile(r"(?i)<!--|<(script|style|nav)\b")
_TO_LETTERS = np.where(NOT_ALPHANUMERIC[LOWER] | ((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)), 0x20, LOWER).astype(np.uint8)


def _without_boilerplate(markup: str) -> str:
    """Markup with a blank for each comment, script, style and navigation that is closed; one scan, whatever is open."""
    closings: dict[str, list[tuple[int, int]]] = {}
    out, done, at, comments = [], 0, 0, True
    while found := _OPENING.search(markup, at):
        name, at = (found[1] or "").lower(), found.end()
        if name:
            if name not in closings:
                closings[name] = [m.span() for m in re.finditer(rf"(?i)</{name}\s*>", markup)]
            place = bisect.bisect_left(closings[name], (at, 0))
            stop = closings[name][place][1] if place < len(closings[name]) else -1
        else:
            stop = markup.find("-->", at) + 3 if comments else 2
            comments = stop > 2
            stop = stop if comments else -1
        if stop >= 0:
            out += [markup[done:found.start()], " "]
            done = at = stop
    return "".join(out) + markup[done:]


def _without_tags(markup: str) -> str:
    """Markup with a blank for everything from a ``<`` to the next ``>``."""
    out, done = [], 0
    while (start := markup.find("<", done)) >= 0 and (stop := markup.find(">", start)) >= 0:
        out += [markup[done:start], " "]
        done = stop + 1
    return "".join(out) + markup[done:]


def page_text(markup: str | None) -> str:
    """What a reader sees: no scripts, styles, navigation, comments or tags."""
    return html_module.unescape(_without_tags(_without_boilerplate(markup or "")))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts in one row, and where each text's start (letters and gaps only)."""
    # Three gaps lie between two texts, so a trigram across them holds two gaps and does not count.
    raw = [b" " + x.encode("utf-8", "surrogatepass") + b"  " for x in texts]
    data = _TO_LETTERS[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.uint32)
    gap = data == 0x20
    keep = ~(gap[:-2] & gap[1:-1]) & ~(gap[1:-1] & gap[2:])
    codes = ((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    places = np.flatnonzero(keep)
    return codes[places].astype(np.int64), np.searchsorted(places, begin)


def _slices(texts: list[str], most: int = 2 << 20):
    start, size = 0, 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def train_trigrams(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of the documents and log p(bucket | language), from all of them."""
    def count(batches):
        sums = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                codes, first = trigrams(texts[a:b])
                lang = np.array(langs[a:b], dtype=object)
                for name in set(langs[a:b]):
                    of = np.repeat(lang == name, np.diff(first))
                    sums[name] = sums.get(name, 0) + np.bincount(codes[of], minlength=BUCKETS)
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()),
                                              pa.array(counts[used], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    rows = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows})
    counts = np.full((len(langs), BUCKETS), 0.1)
    for r in rows:
        counts[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``page_id, host, domain, suffix, declared, loglik`` with the tempered log-likelihood of the text under each language."""
    shared = pages.sparkSession.sparkContext.broadcast(logs)

    def score(batches):
        for batch in batches:
            markups = batch.column(2).to_pylist()
            out = []
            for a, b in _slices([x or "" for x in markups]):
                codes, first = trigrams([page_text(x) for x in markups[a:b]])
                sizes = np.diff(first)
                sums = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(row[codes], dtype=np.float64)])[first]) for row in shared.value])
                out.extend((sums * np.minimum(1, TEXT_TRIGRAMS / np.maximum(sizes, 1))).T.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))],
                                             names=["page_id", "place", "loglik"])

    place = F.struct(host_of(F.col("url")).alias("host"), domain_of(host_of(F.col("url"))).alias("domain"),
                     suffix_of(host_of(F.col("url"))).alias("suffix"), declared_language(F.col("html")).alias("declared"))
    given = pages.select("page_id", place.alias("place"), F.col("html").cast("string").alias("html"))
    schema = T.StructType([given.schema["page_id"], given.schema["place"], T.StructField("loglik", T.ArrayType(T.DoubleType()))])
    return given.mapInArrow(score, schema).select("page_id", "place.*", "loglik")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _is_address(host: Column) -> Column:
    return host.rlike(r"^[0-9.]+$|[\[\]]")


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a numeric address is its own domain."""
    return F.when(_is_address(host), host).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(host.isNull() | _is_address(host), "").otherwise(F.substring_index(host, ".", -1))


def declared_language(markup: Column) -> Column:
    """Primary subtag of the root element's language, or of the language meta field; empty without one."""
    text = F.coalesce(markup.cast("string"), F.lit(""))
    value = r"""\s*=\s*["']?\s*([a-z]{2,3})\b"""

    def tags(name: str, needed: str) -> Column:
        """The tags of a name, each up to its end, that hold something."""
        every = F.split(text, rf"(?i)<{name}\b", -1)
        return F.filter(F.transform(F.slice(every, 2, F.size(every)), lambda t: F.substring_index(t, ">", 1)), lambda t: t.rlike(needed))

    root = F.regexp_extract(F.get(tags("html", rf"(?i)\blang{value}"), F.lit(0)), rf"(?i)\blang{value}", 1)
    fields = tags("meta", "(?i)content-language")
    after = F.transform(fields, lambda t: F.get(F.split(t, "(?i)content-language", 2), F.lit(1)))
    meta = F.regexp_extract(F.get(F.filter(after, lambda t: t.rlike(f"(?i)content{value}")), F.lit(0)), f"(?i)content{value}", 1)
    return F.lower(F.when(F.coalesce(root, F.lit("")) != "", root).otherwise(F.coalesce(meta, F.lit(""))))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


def _sums(n: int) -> list[Column]:
    return [F.sum(F.get("says", F.lit(i))).alias(f"s{i}") for i in range(n)]


def _vector(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def _likelihoods(evidence: DataFrame, column: str, n: int) -> DataFrame:
    """``column, <column>_log``: log p(value | language), values smoothed by one page of each language."""
    by_value = stage(evidence.groupBy(column).agg(*_sums(n)).select(column, _vector(n).alias("v")), "values")
    total = by_value.agg(F.count("*").alias("kinds"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    totals = F.array(*[F.lit(float(total[f"s{i}"] or 0.0)) for i in range(n)])
    logs = F.transform("v", lambda x, i: F.log((x + 1.0) / (F.get(totals, i) + float(total.kinds))))
    return by_value.select(column, logs.alias(f"{column}_log"))


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, host`` of every page."""
    langs, logs = train_trigrams(docs)
    n = len(langs)
    if not n:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("string").alias("text_lang"), declared_language(F.col("html")).alias("declared"),
                            host_of(F.col("url")).alias("host"))
    evidence = stage(text_evidence(pages, langs, logs).withColumn("says", _softmax(F.col("loglik"))), "evidence")
    overall = evidence.agg(*_sums(n), F.count("*").alias("n")).first()
    shares = F.array(*[F.lit(((overall[f"s{i}"] or 0.0) + 1.0) / (overall.n + n)) for i in range(n)])
    hosts = stage(evidence.filter("host IS NOT NULL").groupBy("host").agg(*_sums(n)).select("host", _vector(n).alias("host_sum")), "hosts")
    domains = stage(evidence.filter("domain IS NOT NULL").groupBy("domain").agg(*_sums(n)).select("domain", _vector(n).alias("domain_sum")), "domains")
    # A host, or the pages without one, may hold a third of all rows: sums are broadcast if they are small, else salted.
    salt = ["page_id", "loglik"]
    joined = join_small(join_small(evidence, hosts, ["host"], "left", salt), domains, ["domain"], "left", salt)
    for column in ("declared", "suffix"):
        joined = join_small(joined, stage(_likelihoods(evidence, column, n), column), [column], salt_by=salt)

    def others(total: str) -> Column:
        return F.when(F.col(total).isNotNull(), F.zip_with(total, "says", lambda a, b: F.greatest(a - b, F.lit(0.0)))).otherwise(
            F.array_repeat(F.lit(0.0), n))

    def smoothed(counts: Column, prior: Column, weight: float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, prior, lambda c, p: (c + weight * p) / (total + weight))

    placed = joined.withColumn("domain_prior", smoothed(others("domain_sum"), shares, DOMAIN_WEIGHT))
    placed = placed.withColumn("host_prior", smoothed(others("host_sum"), F.col("domain_prior"), HOST_WEIGHT))
    fused = F.transform("loglik", lambda x, i: x + F.log(F.get("host_prior", i)) + F.get("declared_log", i) + F.get("suffix_log", i))
    names = F.array(*[F.lit(x) for x in langs])
    posterior = placed.withColumn("posterior", _softmax(fused))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    by_text = F.array_position("says", F.array_max("says")).cast("int") - 1
    return posterior.select("page_id", F.get(names, best).alias("lang"), F.array_max("posterior").alias("probability"),
                            F.get(names, by_text).alias("text_lang"), "declared", "host")

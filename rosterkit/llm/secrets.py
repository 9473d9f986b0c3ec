"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

All of it is DataFrame expressions.  Patterns find assigned values, access keys and long hex strings.  What they find in
the documents are labelled random strings; other long tokens, without a mix of letters and digits, are labelled ordinary
identifiers.  Both classes give transition counts from character to character over all documents, so a model is a table of
bounded size (``len(ALPHABET)`` squared), whatever the number of labelled tokens.  Every long token of every whole text
that no pattern covers is then scored by the mean log-likelihood ratio of its transitions, and reported if random strings
explain it better.

Only summed counts leave the executors.  Texts are never shuffled.  Positions and overlaps come from running sums, largest
ends and least starts by doubling steps, so a text with n spans takes n log n.

Defined results: a null text is empty; positions count code points; spans of one kind never overlap; a token that a
pattern touches is left to the pattern; equal rows give equal results; extra columns are ignored; without labelled random
strings the random model is uniform; a text or token of any length takes time in proportion (but for that logarithm).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base spans, the least length of their deciding group, and their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# End of fixed values.

ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
TOKEN_LEAST = 20
TRAIN_LEAST = 8
PRIOR = 5.0  # weight of a class's character frequencies in each transition row
RATIO_GAP = 0.75  # nats a transition that the random model must win by
_CODES = 128
_SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _running(values: Column, merge, neutral) -> Column:
    """Each element merged with all before it, by doubling steps: n log n for any length."""
    def doubled(found, step):
        return F.transform(found, lambda x, i: merge(x, F.coalesce(F.get(found, (i - F.pow(F.lit(2.0), step)).cast("int")), F.lit(neutral))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, values, doubled)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """``array<struct<start, kind, end, hit>>`` of the leftmost non-overlapping matches whose ``group`` is long enough.

    Splitting at the pattern gives what lies between the matches, so positions are running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern if group else f"({pattern})"), F.lit(0))
    between = F.split(text, pattern, -1)
    deciding = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    reach = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.char_length(gap) + F.char_length(hit))
    ends = _running(reach, lambda x, before: x + before, 0)
    spans = F.filter(F.transform(F.arrays_zip(ends.alias("end"), found.alias("hit"), deciding.alias("value")), lambda p: F.struct(
        (p["end"] - F.char_length(p["hit"])).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"),
        F.when(F.char_length(p["value"]) >= least, p["hit"]).alias("hit"))), lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and then kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, group=2, least=ASSIGN_LEAST),
                                 _spans(text, ACCESS, 1, least=ACCESS_LEAST), _spans(text, HEX, 2)))


def _codes_of(token: Column) -> Column:
    """Code numbers of a token's characters, which are ASCII."""
    return F.transform(F.split(token, "(?!^)"), F.ascii)


def _steps(codes: Column) -> Column:
    """``first * 128 + second`` of each pair of neighbours."""
    n = F.size(codes) - 1
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * _CODES + b)


def _transitions(tokens: DataFrame) -> DataFrame:
    """``label, first, second, n`` of the rows ``label, token``; characters as code numbers.

    Tokens recur, so each distinct one is taken apart once and counts as often as it occurs.
    """
    distinct = tokens.filter(F.char_length("token") >= 2).groupBy("label", "token").agg(F.count("*").alias("n"))
    return (distinct.select("label", "n", F.explode(_steps(_codes_of(F.col("token")))).alias("step"))
            .groupBy("label", "step").agg(F.sum("n").alias("n"))
            .select("label", F.floor(F.col("step") / _CODES).cast("int").alias("first"), (F.col("step") % _CODES).alias("second"), "n"))


def labelled_tokens(docs: DataFrame) -> DataFrame:
    """``label, token``: pattern values are ``random``; long tokens elsewhere are ``ordinary`` if all words or all digits.

    A token outside the patterns that mixes letters and digits may be a secret, so it teaches neither class.
    """
    text = F.col("text")
    # A value's own alphabet is wider than a token's: parts of it are taken.
    values = F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(f"({ACCESS})"), F.lit(0)),
                      F.regexp_extract_all(text, F.lit(f"({HEX})"), F.lit(0)))
    token = "[" + "A-Za-z0-9+/_=-" + "]{%d,}" % TRAIN_LEAST
    rest = F.regexp_replace(text, "|".join((ASSIGN, ACCESS, HEX)), " ")
    labelled = F.concat(
        F.transform(F.filter(values, lambda v: F.char_length(v) >= TRAIN_LEAST),
                    lambda v: F.struct(F.lit("random").alias("label"), F.regexp_replace(v, r"\.", "").alias("token"))),
        F.transform(F.filter(F.regexp_extract_all(rest, F.lit(f"({token})"), F.lit(0)),
                             lambda v: ~(v.rlike("[0-9]") & v.rlike("[A-Za-z]"))),
                    lambda v: F.struct(F.lit("ordinary").alias("label"), v.alias("token"))))
    return docs.select(F.explode(labelled).alias("x")).select("x.label", "x.token")


def train_ratios(docs: DataFrame) -> list[float]:
    """log p(next | character) under random strings minus under ordinary identifiers, by ``first * 128 + second``."""
    # At most 128 * 128 sums of each class, whatever the number of labelled tokens.
    counts = {(r.label, r["first"], r["second"]): r.n for r in _transitions(labelled_tokens(docs)).collect()}
    codes, labels = [ord(c) for c in ALPHABET], ("random", "ordinary")
    alone = {label: {b: sum(counts.get((label, a, b), 0) for a in codes) + 0.5 for b in codes} for label in labels}
    ratios = [0.0] * (_CODES * _CODES)
    for a in codes:
        total = {label: sum(counts.get((label, a, b), 0) for b in codes) for label in labels}
        for b in codes:
            log = [math.log((counts.get((label, a, b), 0) + PRIOR * alone[label][b] / sum(alone[label].values()))
                            / (total[label] + PRIOR)) for label in labels]
            ratios[a * _CODES + b] = log[0] - log[1]
    return ratios


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    ratio = F.aggregate(F.transform(_steps(_codes_of(token)), lambda step: F.get(table, step)), F.lit(0.0), lambda total, x: total + x)
    return ratio / (F.char_length(token) - 1)


def find_secrets(docs: DataFrame, least: int = TOKEN_LEAST, gap: float = RATIO_GAP) -> DataFrame:
    """``doc_id, base, added`` of every row: arrays of ``start, kind, end`` (``kind`` numbers KINDS), sorted."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratios = train_ratios(docs)
    token = "[A-Za-z0-9+/_=-]{%d,}" % least
    text, least_start = F.col("text"), (1 << 31) - 1
    placed = docs.select("doc_id", "text", base_spans(text).alias("base"), _spans(text, token, KINDS.index("markov")).alias("tokens"))
    # In the order of their starts a token is clear of the patterns if no span before it ends and none after it starts within.
    every = placed.select("doc_id", "base", "tokens", F.when((F.size("base") > 0) & (F.size("tokens") > 0), F.array_sort(F.concat("base", "tokens"))).alias("every"))
    pattern = lambda s: s["kind"] < KINDS.index("markov")
    ends = F.transform("every", lambda s: F.when(pattern(s), s["end"]).otherwise(0))
    starts = F.reverse(F.transform("every", lambda s: F.when(pattern(s), s["start"]).otherwise(least_start)))
    reach = every.select("doc_id", "base", "tokens", "every", _running(ends, F.greatest, 0).alias("before"),
                         F.reverse(_running(starts, F.least, least_start)).alias("after"))
    clear = F.filter(F.arrays_zip("every", "before", "after"), lambda x: ~pattern(x["every"]) & (x["before"] <= x["every"]["start"])
                     & (x["after"] >= x["every"]["end"]))
    free = F.when(F.col("every").isNull(), F.col("tokens")).otherwise(F.transform(clear, lambda x: x["every"]))
    added = F.filter(free, lambda t: mean_ratio(t["hit"], ratios) >= gap)
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return reach.select("doc_id", bare("base").alias("base"), bare(added).alias("added"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")

"""License scans by ordered signature rules.

All of it is DataFrame expressions.  A text becomes its words, lower-cased, with a blank of its own on both sides of each.
The keywords of all rules that occur in the text decide which rules are tried at all, so a text without any costs one
look at its words.  Each tried rule marks its matches in the text, and the marked words give their places.

Detections overlap: a notice holds a name, a license text holds a notice.  They are resolved by order and containment: a
detection goes if one of the same or an earlier priority covers it (of equal ones the earlier rule stays).  In the order of
their starts that is a comparison with the largest end so far, which is spread over the sorted detections by doubling
steps, so a text with n detections takes n log n, whatever it holds.  Base phrases are never suppressed.

The rules are a constant of the plan, bounded by their table.  Texts are read once and never shuffled.

Defined results: a null text has no words; one rule's matches do not overlap in one text, the leftmost comes first; ties
are resolved by the order of the rules; equal rows give equal results; an empty table gives no rows; extra columns pass
through ``row`` untouched.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterkit.llm.license_rules import Rule, all_rules

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\u0001", "\u0002"  # never part of a word
_LEVELS = 4
_RULE = "struct<number:int,priority:int,label:string,weight:double,base:boolean,others:array<string>,expression:string>"
_SPAN = "struct<start:int,minus:int,priority:int,number:int,label:string,weight:double,base:boolean>"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text of ASCII characters takes the short way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def spaced_words(text: Column) -> Column:
    """The words of a lower-cased text, two blanks apart, without blanks at the ends."""
    return F.trim(F.regexp_replace(text, _APART, "  "))


def rule_table(rules: list[Rule]) -> list[dict]:
    """Rules by their first keyword."""
    grouped: dict[str, list[dict]] = {}
    for number, rule in enumerate(rules):
        first, *others = rule.keywords
        grouped.setdefault(first, []).append({
            "number": number, "priority": rule.priority, "label": rule.label, "weight": rule.weight, "base": rule.base,
            "others": others, "expression": rule.expression})
    return [{"first": first, "rules": found} for first, found in sorted(grouped.items())]


def _tried(found: Column, rules: list[Rule]) -> Column:
    """The rules all of whose keywords are among those found."""
    table = F.from_json(F.lit(json.dumps(rule_table(rules))), f"array<struct<first:string,rules:array<{_RULE}>>>")
    near = F.flatten(F.transform(F.filter(table, lambda g: F.array_contains(found, g["first"])), lambda g: g["rules"]))
    return F.filter(near, lambda r: F.size(F.array_except(r["others"], found)) == 0)


def _places(text: Column, rule: Column) -> Column:
    """The matches of one rule as spans of words (``minus`` is the negative end, exclusive)."""
    marked = F.regexp_replace(text, rule["expression"], F.lit(f" {_OPEN}$1{_CLOSE} "))
    words = F.split(F.trim(marked), "  ")

    def at(mark, shift):
        return F.filter(F.transform(words, lambda w, i: F.when(mark(w), i + shift)), lambda i: i.isNotNull())

    starts = at(lambda w: w.startswith(_OPEN), 0)
    ends = at(lambda w: w.endswith(_CLOSE), 1)
    return F.when(marked.contains(_OPEN), F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.struct(
        p["a"].cast("int").alias("start"), (-p["b"]).cast("int").alias("minus"), rule["priority"].alias("priority"),
        rule["number"].alias("number"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
    ))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _covered_ends(spans: Column) -> Column:
    """For each span the largest ends, by priority or an earlier one, of itself and all before it."""
    own = F.transform(spans, lambda s: F.struct(*[F.when(s["priority"] <= k, -s["minus"]).otherwise(-1).alias(f"e{k}") for k in range(_LEVELS)]))

    def doubled(ends, step):
        def larger(x, i):
            back = F.get(ends, (i - F.pow(F.lit(2.0), step)).cast("int"))
            return F.struct(*[F.greatest(x[f"e{k}"], F.coalesce(back[f"e{k}"], F.lit(-1))).alias(f"e{k}") for k in range(_LEVELS)])

        return F.transform(ends, larger)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(spans), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, own, doubled)


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns, by default all, as a struct), ``n_words`` and ``spans`` of every row.

    ``spans`` are the detections that stand, by start: ``start, end`` (words, the end exclusive), ``label, weight, priority,
    base, number`` of the rule.
    """
    rules = all_rules() if rules is None else rules
    keywords = F.from_json(F.lit(json.dumps(sorted({k for r in rules for k in r.keywords}))), "array<string>")
    kept = docs.columns if keep is None else keep
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Each step is used more than once by the next, so the optimizer keeps it as a column of its own.
    words = given.select("row", spaced_words(lowered(F.col("text"))).alias("words"))
    split = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", "  "))
    split = words.select("row", "words", split.alias("list"))
    firsts = F.from_json(F.lit(json.dumps([g["first"] for g in rule_table(rules)])), "array<string>")
    found = F.when(F.arrays_overlap("list", firsts), F.array_intersect(keywords, F.col("list")))
    gated = split.select("row", F.size("list").cast("long").alias("n_words"), found.alias("found"),
                         F.concat(F.lit(" "), "words", F.lit(" ")).alias("text"))
    tried = gated.select("row", "n_words", "text", F.when(F.col("found").isNotNull(), _tried(F.col("found"), rules)).alias("tried"))
    every = F.array_sort(F.flatten(F.transform("tried", lambda r: _places(F.col("text"), r))))
    placed = tried.select("row", "n_words", F.when(F.size("tried") > 0, every).otherwise(F.array().cast(f"array<{_SPAN}>")).alias("every"))
    reached = placed.select("row", "n_words", "every", F.when(F.size("every") > 0, _covered_ends(F.col("every"))).alias("reach"))

    def stands(span, i):
        before = F.get(F.col("reach"), (i - 1).cast("int"))
        reach = F.coalesce(F.get(F.array(*[before[f"e{k}"] for k in range(_LEVELS)]), span["priority"]), F.lit(-1))
        return span["base"] | (reach < -span["minus"])

    spans = F.transform(F.filter("every", stands), lambda s: F.struct(
        s["start"].alias("start"), (-s["minus"]).alias("end"), s["label"].alias("label"), s["weight"].alias("weight"),
        s["priority"].alias("priority"), s["base"].alias("base"), s["number"].alias("number")))
    return reached.select("row", "n_words", spans.alias("spans"))


def labels_of(spans: Column) -> Column:
    """Distinct labels of spans, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

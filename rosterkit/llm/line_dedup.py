"""Line dedup by a log-template tree of fixed depth.

All of it is DataFrame expressions.  A line is parsed by its token count and its leading tokens, where a token with a
digit is a variable field (unless most are); that is its leaf.  Within the leaf a token is part of the template if enough
lines of the leaf have it at the same position; the others are variable fields, too.  Two templates are tried: one with
the tokens of ``MIN_DOCS`` lines, and a more general one with those of a tenth of the leaf's lines, for fields whose values
recur themselves.  A template needs ``CONSTANT_SHARE`` constant tokens.

A line is dropped if its text (digits aside) or a template of it is found in ``MIN_DOCS`` different texts.  Copies of one
text count once: lines that recur through copies alone stay for near-duplicate detection to judge.

Counts combine before the shuffle.  Keys that hold more than a thousandth of all rows are fewer than a thousand, so their
side of a join is broadcast and no task gathers their rows.  Only lines of leaves that vary are taken apart into tokens.
The texts move twice, as lines: to the numbers of those lines, and to the numbers of the dropped ones.

Defined results: null stays null and empty stays empty; lines without tokens stay; equal rows are one document; a null id
is a document of its own text; a text of any number of lines takes time in proportion; extra columns pass through
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterkit.session import stage

LEADING = 2
MIN_DOCS = 5
LEAST_TOKENS = 3          # shorter lines have no room for a variable field
CONSTANT_SHARE = (2, 3)   # at least two thirds of a template's tokens
GENERAL_SHARE = 10        # the general template keeps the tokens of a tenth of a leaf's lines
HEAVY_KEYS = 1000
FIELD = "<*>"
_FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def _tokens(line: Column) -> Column:
    """Tokens between ASCII white space; each with a digit is a variable field.

    Where fields outnumber the constant tokens no template is left to speak of, and the tokens stay as they are.
    """
    def split(text):
        return F.array_remove(F.split(text, " "), "")

    line = F.when(line.rlike(r"[\t\x0B\f\r]"), F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    masked = split(F.regexp_replace(line, _FIELD, FIELD))
    fields = F.size(masked) - F.size(F.array_remove(masked, FIELD))
    general = F.when(2 * fields <= F.size(masked), masked).otherwise(split(line))
    return F.when(line.rlike("[0-9]"), general).otherwise(split(line))  # most lines have no digit


def _lines(texts: DataFrame) -> DataFrame:
    """``key, line, whole, leaf``: every line with tokens, by hashes; short lines have no leaf.

    The outer form of explode keeps the optimizer from splitting every text once more to see whether it has lines.
    """
    lines = texts.select("key", F.posexplode_outer("lines").alias("line", "content")).filter(F.col("content").rlike(r"\S"))
    parsed = lines.select("key", "line", _tokens(F.col("content")).alias("tokens"))
    n = F.size("tokens")
    leaf = F.when(n >= LEAST_TOKENS, F.xxhash64(F.lit(0), n, F.slice("tokens", 1, LEADING)))
    return parsed.select("key", "line", F.xxhash64(F.lit(1), n, "tokens").alias("whole"), leaf.alias("leaf"))


def _prefix(key: Column) -> Column:
    """The half of a text's hash that its documents' keys begin with."""
    return F.shiftright(key, 32)


def _meet(rows: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` with those of ``table`` (``on`` and the number ``n`` of rows with it): keys with many rows are broadcast."""
    most = max(total // HEAVY_KEYS, HEAVY_KEYS)
    heavy = table.filter(F.col("n") > most)  # fewer than HEAVY_KEYS, whatever the size of the input
    many = rows.join(F.broadcast(heavy), on)
    few = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(table.filter(F.col("n") <= most).hint("merge"), on)
    return many.unionByName(few)


def _often(rows: DataFrame, on: str, least: int) -> DataFrame:
    return rows.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _recurring(rows: DataFrame, min_docs: int, total: int) -> DataFrame:
    """``key, line`` of the rows ``key, line, sign`` whose sign is found in enough different texts."""
    often = stage(_often(rows, "sign", min_docs), "often")
    kept = stage(_meet(rows, often, "sign", total), "often-lines")
    texts = kept.select("sign", _prefix(F.col("key")).alias("text")).distinct().groupBy("sign").agg(F.count("*").alias("texts"))
    wide = stage(often.join(texts.filter(F.col("texts") >= min_docs), "sign").select("sign", "n"), "recurring")
    return _meet(kept.select("key", "line", "sign"), wide, "sign", total).select("key", "line")


def _templates(texts: DataFrame, lines: DataFrame, min_docs: int, total: int) -> DataFrame:
    """``key, line, sign``: up to two templates of every line in a leaf that has different lines."""
    leaves = lines.filter("leaf IS NOT NULL").groupBy("leaf").agg(
        F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).filter((F.col("n") >= min_docs) & (F.col("a") != F.col("b")))
    leaves = stage(leaves.select("leaf", "n"), "leaves")
    varied = _meet(lines.filter("leaf IS NOT NULL").select("key", "line", "leaf"), leaves, "leaf", total).select("key", "line", "leaf")
    # Equal rows share a key: a line of theirs is wanted once, and their tokens are a set.
    wanted = varied.groupBy("key").agg(F.collect_set(F.struct("line", "leaf")).alias("wanted"))
    found = texts.join(wanted.hint("merge"), "key").select("key", F.explode(F.transform(
        "wanted", lambda w: F.struct(w["line"].alias("line"), w["leaf"].alias("leaf"), F.get(F.col("lines"), w["line"]).alias("content")))).alias("x"))
    tokens = found.select("key", "x.line", "x.leaf", _tokens(F.col("x.content")).alias("tokens"))
    placed = tokens.select("key", "line", "leaf", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token"))
    placed = stage(placed.filter(F.col("token") != FIELD).select(
        "key", "line", "leaf", "size", F.xxhash64("leaf", "place", "token").alias("token")), "leaf-tokens")
    counts = placed.groupBy("token").agg(F.count("*").alias("n"), F.first("leaf").alias("leaf")).filter(F.col("n") >= min_docs)
    general = GENERAL_SHARE * F.col("n") >= F.col("lines")
    constants = stage(counts.join(leaves.withColumnRenamed("n", "lines"), "leaf").select("token", "n", general.alias("general")), "constants")
    found = _meet(placed, constants, "token", placed.count()).groupBy("key", "line", "size", "leaf").agg(
        F.array_sort(F.collect_set("token")).alias("close"), F.array_sort(F.collect_set(F.when(F.col("general"), F.col("token")))).alias("general"))

    def sign(tokens):
        enough = CONSTANT_SHARE[1] * F.size(tokens) >= CONSTANT_SHARE[0] * F.col("size")
        return F.when(enough, F.xxhash64("leaf", tokens))

    signs = F.array_distinct(F.array_compact(F.array(sign("close"), sign("general"))))
    return stage(found.select("key", "line", F.explode(signs).alias("sign")), "templates")


def recurring_lines(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key, drop`` for texts ``key, lines``: the numbers of the lines that recur in enough different texts."""
    lines = stage(_lines(texts), "lines")
    total = lines.count()
    exact = _recurring(lines.select("key", "line", F.col("whole").alias("sign")), min_docs, total)
    similar = _recurring(_templates(texts, lines, min_docs, total), min_docs, total)
    return exact.unionByName(similar).groupBy("key").agg(F.collect_set("line").alias("drop"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (the document), ``n_lines, n_dropped, kept_text`` of every row."""
    # The key of a document begins with half the hash of its text, so lines tell texts apart by it.
    text, doc_id = F.col("text").cast("string"), F.col("doc_id")
    key = _prefix(F.xxhash64(text)) * F.lit(1 << 32) + F.xxhash64(doc_id, text).bitwiseAND(F.lit((1 << 32) - 1))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    # Texts travel as lines, which give them back: no expression after the join splits a text again.
    keyed = docs.select(F.struct(*rest).alias("rest"), key.alias("key"), F.split(text, "\n", -1).alias("lines"))
    found = recurring_lines(keyed.select("key", "lines"), min_docs)
    # ``found`` grows with the documents, so the plan is the same for a table small enough to broadcast it.
    joined = keyed.join(found.hint("merge"), "key", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    whole = F.array_join("lines", "\n")
    row = F.struct(*[whole.alias(c) if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select(row.alias("row"), F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                         F.size("drop").cast("long").alias("n_dropped"), F.when(F.size("drop") == 0, whole).otherwise(kept).alias("kept_text"))

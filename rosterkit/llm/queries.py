"""The registered queries of the subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterkit.llm import (ann, decontamination, fill_in_middle, language_id, license_rules, license_scan, line_dedup,
                           lm_scoring, packing, secrets, simhash, substring_dedup, toxicity, vector_codes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text, learnt from the labelled rows of four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = F.col("toxic_score")
    return toxicity.score_toxicity(docs, model, ["doc_id"]).select(
        "row.doc_id", F.coalesce(toxicity.fold_of(F.col("row.doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from text, markup, address suffix and host; text model from all documents."""
    return language_id.identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text by patterns and by Markov models."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base, added = F.col("base"), F.col("added")
    numbers = [F.size(F.filter(base, lambda s: s["kind"] == secrets.KINDS.index("assign"))).cast("long").alias("n_assign"),
               F.size(F.filter(base, lambda s: s["kind"] == secrets.KINDS.index("access"))).cast("long").alias("n_access"),
               F.size(F.filter(base, lambda s: s["kind"] == secrets.KINDS.index("hex"))).cast("long").alias("n_hex")]
    return found.select("doc_id", *numbers, F.sha2(secrets.written(base), 256).alias("base_sha256"),
                        secrets.written(F.array_sort(F.concat(base, added))).alias("spans"),
                        F.size(added).cast("long").alias("n_markov"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of 4-word-shingle fingerprints within 4 bits."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows removed."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 2048 tokens."""
    rows = packing.pack_documents(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequence_length")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates dropped from every document."""
    rows = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text by unigrams and by the backoff automaton."""
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 10-word window of a benchmark item."""
    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                       table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words("spans")
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as four entries of fitted codebooks, with its error and that of its label."""
    coded, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), vector_codes.written(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut into prefix, middle and suffix, and rebuilt from the output."""
    rows = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return rows.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(text, 256).alias("restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every whole text by ordered signature rules."""
    rows = license_scan.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    rows = rows.select("row.doc_id", "n_words", "spans", base.alias("base"))
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    weights = F.transform("spans", lambda s: s["weight"])
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                       F.array_max(starts).alias("last_word"), license_scan.labels_of(F.col("base")).alias("base_labels"),
                       license_scan.labels_of(F.col("spans")).alias("labels"),
                       F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_secrets": op3_secrets,
    "op4_simhash": op4_simhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_ann": op8_ann,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_license_scan": op13_license_scan,
}

def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round as one comparison of all parts with all entries."""
    steps = [f"""
        kept AS (
            SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), spread AS (
            SELECT r, vec_id, len(v) // {parts} AS width, unnest(v) AS x, unnest(range(len(v))) AS place FROM kept
        ), cells AS (
            SELECT r, place // width AS part, place % width AS position, floor(1024 * x::DOUBLE)::BIGINT AS x FROM spread
        ), book0 AS (
            SELECT part, r - 1 AS entry, position, x AS y FROM cells WHERE r <= {entries}
        )"""]
    for i in range(rounds + 1):
        steps.append(f"""
        far{i} AS (
            SELECT r, part, entry, sum((x - y) * (x - y)) AS far FROM cells JOIN book{i} USING (part, position) GROUP BY ALL
        ), near{i} AS (
            SELECT r, part, min((far, entry)) AS best FROM (SELECT r, part, far::BIGINT AS far, entry FROM far{i}) GROUP BY ALL
        )""")
        if i < rounds:
            steps.append(f"""
        mean{i} AS (
            SELECT part, best[2] AS entry, position, sum(x)::BIGINT AS total, count(*) AS n FROM cells JOIN near{i} USING (r, part) GROUP BY ALL
        ), book{i + 1} AS (
            SELECT part, entry, position, coalesce(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END, y) AS y
            FROM book{i} LEFT JOIN mean{i} USING (part, entry, position)
        )""")
    return "WITH " + ",".join(steps) + f""",
        coded AS (
            SELECT r, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
            FROM near{rounds} GROUP BY r
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, position)) FROM book{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (r)
    """


def _license_scan_sql() -> str:
    """All rules on all texts that hold their first keyword, resolved by a comparison of all detections of a text."""
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    rules = ",".join(f"({n}, {r.priority}, {quoted(r.label)}, {r.weight}, {r.base}, {quoted(' ' + r.keywords[0] + ' ')}, {quoted(r.expression)})"
                     for n, r in enumerate(license_rules.all_rules()))
    return rf"""
        WITH rules(number, priority, label, weight, base, first, expression) AS (VALUES {rules}), spaced AS (
            SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') || ' ' AS w FROM documents
        ), marked AS (
            SELECT doc_id, rules.*, string_split(trim(regexp_replace(w, expression, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), ' '), '  ') AS m
            FROM spaced JOIN rules ON contains(w, first)
        ), found AS (
            SELECT doc_id, number, priority, label, weight, base, unnest(starts) AS s, unnest(ends) AS e FROM (
                SELECT *, list_filter(range(len(m)), lambda i: starts_with(m[i + 1], chr(1))) AS starts,
                       list_filter(range(len(m)), lambda i: ends_with(m[i + 1], chr(2))) AS ends FROM marked)
        ), standing AS (
            SELECT * FROM found d WHERE base OR NOT EXISTS (
                SELECT 1 FROM found c WHERE c.doc_id = d.doc_id AND c.priority <= d.priority AND c.s <= d.s AND c.e >= d.e
                AND (c.s < d.s OR c.e > d.e OR c.priority < d.priority OR c.number < d.number))
        ), totals AS (
            SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight)::DOUBLE AS score, count(*) AS n_spans
            FROM standing GROUP BY doc_id
        )
        SELECT doc_id, CASE WHEN trim(w) = '' THEN 0 ELSE len(string_split(trim(w, ' '), '  ')) END::BIGINT AS n_words,
               coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score,
               coalesce(n_spans, 0)::BIGINT AS n_spans
        FROM spaced LEFT JOIN totals USING (doc_id)
    """


ORACLES = {
    "op13_license_scan": _license_scan_sql(),
    "op11_vector_codes": _vector_codes_sql(),
    "op5_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), windows AS (
            SELECT doc_id, p, hash(list_slice(w, p, p + 34)) AS h
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM words)
        ), repeated AS (
            SELECT doc_id, p FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
        ), covered AS (
            SELECT doc_id, list(DISTINCT q) AS gone
            FROM (SELECT doc_id, unnest(generate_series(p, p + 34)) AS q FROM repeated) GROUP BY doc_id
        ), placed AS (
            SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS q FROM words
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS text FROM placed
            WHERE (doc_id, q) NOT IN (SELECT doc_id, unnest(gone) FROM covered) GROUP BY doc_id
        )
        SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op7_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
        ), lines AS (
            SELECT doc_id, text, unnest(lines) AS content, unnest(range(len(lines))) AS line FROM split
        ), parsed AS (
            SELECT doc_id, text, line, content, CASE WHEN 2 * len(list_filter(m, lambda x: x = '<*>')) <= len(m) THEN m ELSE t END AS w
            FROM (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
                  FROM (SELECT *, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS t FROM lines))
        ), leaves AS (
            SELECT len(w) AS n, w[1:2] AS lead, count(*) AS n_lines FROM parsed WHERE len(w) >= 3
            GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT w) > 1
        ), tokens AS (
            SELECT doc_id, line, text, n, lead, n_lines, unnest(w) AS token, unnest(range(n)) AS i
            FROM parsed JOIN leaves ON n = len(w) AND lead = w[1:2]
        ), constant AS (
            SELECT n, lead, i, token, count(*) AS c FROM tokens WHERE token <> '<*>' GROUP BY ALL HAVING count(*) >= 5
        ), templates AS (
            SELECT doc_id, line, n, lead, any_value(text) AS text, list((i, token) ORDER BY i) AS close,
                   coalesce(list((i, token) ORDER BY i) FILTER (10 * c >= n_lines), []) AS general
            FROM tokens JOIN constant USING (n, lead, i, token) GROUP BY doc_id, line, n, lead
        ), signs AS (
            SELECT doc_id, line, text, len(w) AS n, [] AS lead, hash(w) AS sign FROM parsed WHERE len(w) > 0
            UNION ALL SELECT doc_id, line, text, n, lead, hash(close) FROM templates WHERE 3 * len(close) >= 2 * n
            UNION ALL SELECT doc_id, line, text, n, lead, hash(general) FROM templates WHERE 3 * len(general) >= 2 * n
        ), recurring AS (
            SELECT n, lead, sign FROM signs GROUP BY ALL HAVING count(DISTINCT text) >= 5
        ), dropped AS (
            SELECT DISTINCT doc_id, line FROM signs JOIN recurring USING (n, lead, sign)
        ), judged AS (
            SELECT doc_id, count(*) AS n_lines, count(dropped.line) AS n,
                   string_agg(content, chr(10) ORDER BY lines.line) FILTER (dropped.line IS NULL) AS kept
            FROM lines LEFT JOIN dropped USING (doc_id, line) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_dropped,
               sha256(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS kept_sha256
        FROM documents LEFT JOIN judged USING (doc_id)
    """,
    "op10_decontamination": r"""
        WITH lowered AS (
            SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), words AS (
            SELECT kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
        ), phrases AS (
            SELECT DISTINCT id, n, hash(list_slice(w, p, p + n - 1)) AS h
            FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
                  FROM (SELECT id, w, least(len(w), 10) AS n FROM words WHERE kind = 1 AND len(w) > 0))
        ), windows AS (
            SELECT id, n, p, hash(list_slice(w, p, p + n - 1)) AS h
            FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
                  FROM words CROSS JOIN (SELECT DISTINCT n FROM phrases) WHERE kind = 0)
        ), found AS (
            SELECT windows.id AS doc_id, p, n, phrases.id AS item_id FROM windows JOIN phrases USING (n, h)
        ), hits AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY doc_id
        )
        SELECT words.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits ON words.id = hits.doc_id LEFT JOIN items ON words.id = items.doc_id WHERE kind = 0
    """,
    "op12_fill_in_middle": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS d,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
        ), numbers AS (
            SELECT doc_id, text, u, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
                   ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM drawn
        ), cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                        THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
        ), parts AS (
            SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}

import math
import re
import zlib
from collections import Counter

import pytest
from cases import documents, odd_texts, prose
from rosterkit.llm.lm_scoring import START_CLASS, score_texts


def brute_force(texts):
    """The same model written out with dictionaries of strings."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip(["<s>", *tokens[i]], tokens[i]))
    total, kinds = sum(words.values()), len(words)
    below = lambda w: (words[w] + 0.5) / (total + 0.5 * (kinds + 1))
    count = lambda h: len(train) if h == "<s>" else words[h]
    group = lambda h: START_CLASS if h == "<s>" else int(2 * math.log2(words[h] + 1))
    triples = Counter(x for i in train for x in zip(["<s>", *tokens[i]], tokens[i], tokens[i][1:]))
    in_group, kinds_in = Counter(), Counter()
    for (*history, _), n in [*pairs.items(), *triples.items()]:
        if len(history) == 1 or pairs[tuple(history)] >= 2:
            at = len(history), group(history[0]) if len(history) == 1 else int(2 * math.log2(pairs[tuple(history)] + 1))
            in_group[at] += n
            kinds_in[at] += 1

    def fail_of(at):
        return kinds_in[at] / (in_group[at] + kinds_in[at]) if in_group[at] else 1.0

    def walk(text):
        """Read a text and carry the state; a state is a tuple of words, () is the root."""
        total_weight, failures, state = 0.0, 0, ("<s>",)
        for w in text:
            chain, at = [], state
            while True:
                chain.append(at)
                if not at or (pairs if len(at) == 1 else triples)[(*at, w)]:
                    break
                at = at[1:]
            p = below(w)
            for h in ([(state[-1],)] if state else []) + ([state] if len(state) == 2 else []):
                if len(h) == 1:
                    fail, arc, n = fail_of((1, group(h[0]))), pairs[h[0], w], count(h[0])
                else:
                    fail, arc, n = fail_of((2, int(2 * math.log2(pairs[h] + 1)))), triples[(*h, w)], pairs[h]
                p = fail * p + ((1 - fail) * arc / n if arc else 0.0)
            total_weight += math.log10(p)
            failures += len(chain) - 1
            state = (state[-1], w) if state and pairs[state[-1], w] >= 2 else (w,)
        return total_weight, failures

    return [(zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(words[w] > 0 for w in t), total,
             sum(math.log10(below(w)) for w in t), *walk(t))
            for i, t in enumerate(tokens)]


def test_odd_texts_as_brute_force(spark):
    texts = odd_texts() + [prose(i, 50) for i in range(30)] + [prose(i % 5, 70 + i) for i in range(20)]
    rows = score_texts(documents(spark, texts).repartition(3)).orderBy("doc_id").collect()
    for row, (held, n, known, total, base, score, failures) in zip(rows, brute_force(texts), strict=True):
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held, n, known, total)
        assert row.base_score == pytest.approx(base)
        assert row.score == pytest.approx(score) and row.n_backoff == failures


def test_held_out_copies_score_above_the_unigrams(spark):
    texts = [prose(i % 7, 60) for i in range(60)]
    rows = score_texts(documents(spark, texts)).filter("held_out").collect()
    assert rows and all(r.score > r.base_score + 20 for r in rows)


def test_empty_table_and_null_ids(spark):
    assert score_texts(documents(spark, [])).count() == 0
    rows = score_texts(documents(spark, [None, "a b"], [None, None])).collect()
    assert sorted((r.n_tokens, r.held_out, r.train_tokens) for r in rows) == [(1, False, 4), (3, False, 4)]


def test_packed_keys_come_back():
    import numpy as np
    from rosterkit.llm.chunks import pack_sorted, unpack_sorted

    rng = np.random.default_rng(0)
    for keys in (rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.zeros(0, np.uint64), np.array([(1 << 64) - 1], np.uint64)):
        keys = np.unique(keys)
        assert (unpack_sorted(pack_sorted(keys)) == keys).all()

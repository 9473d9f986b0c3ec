import re

import numpy as np
import pytest
import xxhash
from cases import documents, odd_texts, prose
from rosterkit.llm import simhash
from rosterkit.llm.simhash import near_duplicates


def fingerprint(text, size=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


def test_odd_texts_as_brute_force(spark):
    texts = odd_texts() + [prose(50, 300) + f" end {i}" for i in range(40)]
    prints = [fingerprint(t) for t in texts]
    rows = near_duplicates(documents(spark, texts).repartition(3)).orderBy("doc_id").collect()
    assert [r.fp % 2 ** 64 for r in rows] == prints
    assert [r.component_id for r in rows] == components(list(range(len(texts))), prints)


@pytest.mark.parametrize("hot", [100_000, 40])
def test_links_of_planted_distances(spark, monkeypatch, hot):
    """With a low bound the family's slots and some more are hot and go by midpoints."""
    monkeypatch.setattr(simhash, "HOT_SLOT", hot)
    rng = np.random.default_rng(3)
    prints = []
    for base in rng.integers(0, 2 ** 63, 120, dtype=np.uint64).tolist():
        prints.append(base)
        for distance in (1, 2, 3, 4, 4, 4, 5, 6):
            bits = rng.choice(64, distance, replace=False)
            prints.append(base ^ sum(1 << int(b) for b in bits))
    prints = list(dict.fromkeys(prints))
    family = rng.integers(0, 2 ** 63, dtype=np.uint64).item()
    prints += list(dict.fromkeys(family ^ (i * 0x10001) for i in range(1, 600)))
    own = spark.createDataFrame([(i, p - 2 ** 64 if p >= 2 ** 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    for distance in (4, 3, 2):
        got = {r.fp % 2 ** 64: r.component_id for r in simhash.fingerprint_components(own, distance).collect()}
        assert [got[p] for p in prints] == components(list(range(len(prints))), prints, distance)


def test_empty_table_and_null_ids(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    rows = near_duplicates(documents(spark, ["a b c d e", "a b c d e", None, None], [None, 7, None, None])).collect()
    assert sorted(str(r.component_id) for r in rows) == ["7", "7", "None", "None"]

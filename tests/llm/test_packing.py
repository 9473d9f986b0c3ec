import random
import zlib

import numpy as np
import pytest
from cases import documents, odd_texts
from rosterkit.llm import packing
from rosterkit.llm.packing import LocalSearch, PieceTokenizer, best_fit, default_tokenizer, pack, pack_documents, pack_lengths

ODD = ["it's 'tis don't IT'S rock'n'roll", "a.b,c!d?'s x'llama !'s", "café café Kİ ẞ", "x y z\u0085w",
       "3.14 1,000 #tag @me $5 100%", "<|endoftext|> <|startoftext|>", "日本語 क्ष \U0001f600\U0001f600", "≠ ≮ a\x00b\x1fc",
       "don''t '' ' 're", "ÅB Ç.d"]


def test_pieces_give_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    rng = random.Random(5)
    alphabet = "ab'Z9.,! \né́K- <|"
    texts = [t or "" for t in odd_texts()] + ODD + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]
    ids, first = PieceTokenizer(default_tokenizer()).encode(texts)
    for text, a, b in zip(texts, first[:-1], first[1:]):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids + [0], repr(text)


@pytest.mark.parametrize("group", [16_384, 40])
def test_every_token_is_packed_once(spark, monkeypatch, group):
    monkeypatch.setattr(packing.pack, "__defaults__", (2048, group))
    texts = odd_texts() + [" ".join(["word"] * random.Random(i).randrange(1, 3000)) for i in range(200)]
    rows = pack_documents(documents(spark, texts).repartition(3), default_tokenizer(), with_ids=True).collect()
    ids, first = PieceTokenizer(default_tokenizer()).encode(texts)
    for doc, (a, b) in enumerate(zip(first[:-1], first[1:])):
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert np.concatenate([r.ids for r in mine]).tolist() == ids[a:b].tolist()
        assert [r.start for r in mine] == [2048 * k for k in range(len(mine))] and [r.piece for r in mine] == list(range(len(mine)))
        assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in mine)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.sequence_length for r in parts} == {at}
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + (2 if group > 1000 else 4)


def test_empty_table_and_null_ids(spark):
    assert pack_documents(documents(spark, []), default_tokenizer()).count() == 0
    rows = pack_documents(documents(spark, [None, "", "a"], [None, 3, 3]), default_tokenizer()).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("3", 1), ("3", 2), ("None", 1)]


def next_fit(lengths, limit):
    bins, used, left = [], -1, 0
    for size in lengths.tolist():
        if size > left:
            used, left = used + 1, limit
        bins.append(used)
        left -= size
    return np.array(bins)


def test_local_search_saves_bins():
    rng = np.random.default_rng(0)
    before = after = least = 0
    for round_number in range(60):
        cuts = np.sort(rng.integers(1, 200, (40, 3)), axis=1)
        lengths = np.diff(np.concatenate([np.zeros((40, 1), int), cuts, np.full((40, 1), 200)], axis=1), axis=1).ravel()
        lengths = rng.permutation(lengths[lengths > 0])
        start = next_fit(lengths, 200) if round_number % 2 else best_fit(lengths, 200)
        search = LocalSearch(lengths, start, 200)
        end = search.run()
        fill = np.bincount(end, weights=lengths)
        assert fill.max() <= 200 and np.array_equal(fill, search.fill[:len(fill)])
        assert (fill ** 2).sum() >= (np.bincount(start, weights=lengths) ** 2).sum()
        before, after, least = before + len(np.unique(start)), after + len(np.unique(end)), least + 40
    assert least <= after < before - 100
    assert len(pack_lengths(np.zeros(0, dtype=np.int64), 100)) == 0


def test_added_tokens_are_those_of_the_unmodified_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    rng = random.Random(6)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "é", "'s", "it'", " ", "\n", "Word", "9", "<|endoftext", "\u0301"]
    texts = ["end of one <|endoftext|> start <|startoftext|> x", "<|endoftext|>", "<|endoftext|><|startoftext|>", "", None, *ODD]
    texts += ["".join(rng.choice(pool) for _ in range(30)) for _ in range(300)]
    rows = pack_documents(documents(spark, texts).repartition(3), default_tokenizer(), with_ids=True).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {
        i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


def improves(a, b, limit):
    """True if one or two lengths of ``a`` for none, one or two of ``b`` (not two for two) raise the sum of squared fills."""
    some = lambda bin: [(), *[(x,) for x in bin], *[(x, y) for k, x in enumerate(bin) for y in bin[k + 1:]]]
    for out in some(a)[1:]:
        for back in some(b):
            gain = sum(out) - sum(back)
            if (len(out), len(back)) not in ((2, 0), (2, 2)) and 0 < gain <= limit - sum(b) and sum(b) + gain > sum(a):
                return True
    return False


def test_search_ends_when_no_underfull_bin_can_be_improved():
    """It looked at the 16 emptiest bins only."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(400, 1101, 300), rng.integers(30, 1101, 200), rng.integers(1, 2048, 300), rng.integers(5, 12, 300) * 100):
        bins = LocalSearch(lengths, next_fit(lengths, 2048), 2048).run()
        packed = [lengths[bins == b].tolist() for b in np.unique(bins)]
        assert sorted(sum(packed, [])) == sorted(lengths.tolist()) and max(map(sum, packed)) <= 2048
        if len(packed) > -(-int(lengths.sum()) // 2048):
            assert not any(improves(a, b, 2048) for a in packed for b in packed if a is not b and sum(b) < 2048)


def test_nearly_full_bins_of_all_groups_are_pooled(spark):
    """Bins of 99 % were left as they were in their group, so some small pieces had a bin of their own."""
    pieces = spark.createDataFrame([(i, 2030 if i % 2 else 18) for i in range(400)], "doc_id long, length long")
    found = pack(pieces, 2048, 100).collect()
    assert sorted(r.doc_id for r in found) == list(range(400)) and len({r.sequence_id for r in found}) == 200


def test_repacking_takes_no_more_bins():
    rng = np.random.default_rng(0)
    cuts = np.sort(rng.integers(1, 200, (40, 3)), axis=1)
    lengths = np.diff(np.concatenate([np.zeros((40, 1), int), cuts, np.full((40, 1), 200)], axis=1), axis=1).ravel()
    packed, lengths = np.repeat(np.arange(40), 4)[lengths > 0], lengths[lengths > 0]
    assert best_fit(lengths, 200).max() >= 40  # without a search it needs more than it has
    assert len(np.unique(pack_lengths(lengths, 200, packed))) == 40

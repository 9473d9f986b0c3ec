"""Best-fit packing of tokenised documents by swap-based local search.

Token ids come from a public tokenizer file; equal word pieces of a block are tokenised once.  Documents longer than a
sequence are cut, all others stay whole.  Pieces that fill a sequence are done; the rest is dealt to groups of bounded
size, each packed best-fit decreasing and then improved: documents of every underfull bin, the emptiest first, move to other
underfull bins, or are exchanged one-for-one, two-for-one or one-for-two with smaller ones there, as long as the squared fill
rises and a bin can be saved.  All bins that are not full are pooled over all groups and packed once more, best-fit or from
the bins they are, whichever are fewer.

Defined results: a null text is empty and has the end token only; equal rows are packed each; a null id is kept; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterkit.llm.rows import with_text_columns
from rosterkit.llm.words import SPACES, Slab, _edges
from rosterkit.session import stage

LIMIT = 2048
END_ID = 0
GROUP_PIECES = 16_384
_CACHED_PIECES = 400_000
_PIECE = "piece int, start long, length long, ids_crc32 long"

# Classes of bytes: white space, ASCII letters and digits, other ASCII, apostrophe, parts of other characters.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[:0x80] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[SPACES] = 0
_KIND[ord("'")] = 3


def _pieces_of(block: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, cut further between an ASCII letter or digit and ASCII punctuation.

    The tokenizer always cuts there too (but not behind an apostrophe), so pieces can be tokenised one by one.
    """
    starts, ends = _edges(separators[block])
    kind = _KIND[block]
    left, right = kind[:-1], kind[1:]
    cut = np.flatnonzero(((left == 1) & ((right == 2) | (right == 3))) | ((left == 2) & (right == 1))) + 1
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


class PieceTokenizer:
    """Token ids of whole texts; remembers pieces up to a bounded number.

    With ``added``, texts are cut at the vocabulary's added tokens first, as the tokenizer does by default; else these are
    spelt like other text.
    """

    _shared: dict[str, PieceTokenizer] = {}

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # of pieces: "<|ENDOFTEXT|>" is no token, however it is lowered
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        longest = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.forget()

    @classmethod
    def of(cls, path: str) -> PieceTokenizer:
        if path not in cls._shared:
            cls._shared[path] = cls(path, added=True)
        return cls._shared[path]

    def forget(self):
        self.known: dict[int, int] = {}
        self.ids = [np.array([i], dtype=np.uint32).tobytes() for i in (END_ID, *self.added.values())]  # bytes take half of what small arrays do

    def _tokenise(self, pieces: list[str]) -> list[list[int]]:
        plain = [x.isascii() and x.isalpha() for x in pieces]
        encode = self.tokenizer.model.tokenize
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(pieces, plain) if not p], add_special_tokens=False))
        return [[t.id for t in encode(x)] if p else next(rest).ids for x, p in zip(pieces, plain)]

    def _parts(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
        """The texts between added tokens, and which of ``ids`` follows each: 0, the end, behind the last of a text."""
        parts, follows, place = [], [], {t: i for i, t in enumerate(self.added, 1)}
        for text in texts:
            cut = self.cuts.split(text) if self.cuts and text else [text]
            parts += cut[::2]
            follows += [*[place[t] for t in cut[1::2]], 0]
        return parts, np.array(follows, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one row, the end id behind each text, and where each text starts in it."""
        parts, follows = self._parts(texts)
        slab = Slab(parts, lower=True, runs=_pieces_of)
        distinct, example, place = np.unique(slab.hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.known) + len(keys) > _CACHED_PIECES:
            self.forget()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        raw, starts, ends = slab.data.tobytes(), slab.starts, slab.ends
        made = self._tokenise([raw[starts[e]:ends[e]].decode("utf-8", "surrogatepass") for e in example[new].tolist()] if new else [])
        for i, ids in zip(new, made):
            self.known[keys[i]] = len(self.ids)
            self.ids.append(np.array(ids, dtype=np.uint32).tobytes())
        entries = [self.ids[self.known[h]] for h in keys] + self.ids[:len(self.added) + 1]
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        offsets, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(entries), dtype=np.uint32)
        which = np.insert(place, slab.first[1:], len(keys) + follows)
        count = sizes[which]
        stops = np.cumsum(count)
        ids = flat[np.repeat(offsets[which] - (stops - count), count) + np.arange(int(stops[-1]) if len(stops) else 0)]
        marks = (slab.first[1:] + np.arange(len(parts)))[follows == 0]
        return ids, np.concatenate([[0], stops[marks]])


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """``row`` (the document without its text) and its pieces of at most ``limit`` tokens: ``piece, start, length, ids_crc32`` (and ``ids``)."""
    def cut(texts):
        ids, first = PieceTokenizer.of(tokenizer).encode(texts)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            parts = []
            for number, at in enumerate(range(a, b, limit)):
                part = ids[at:min(b, at + limit)].astype("<u4")
                parts.append({"piece": number, "start": at - a, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes())}
                             | ({"ids": part.astype(np.int64)} if with_ids else {}))
            out.append(parts)
        kind = [pa.field("piece", pa.int32()), *[pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32")]]
        kind += [pa.field("ids", pa.list_(pa.int64()))] if with_ids else []
        return [pa.array(out, pa.list_(pa.struct(kind)))]

    fields = _PIECE.replace(" ", ":").replace(",:", ",") + (",ids:array<long>" if with_ids else "")
    cut_up = with_text_columns(docs, f"pieces array<struct<{fields}>>", cut, most=2 << 20,
                               keep=[c for c in docs.columns if c != "text"])
    return cut_up.select("row", F.explode("pieces").alias("p")).select("row", "p.*")


def best_fit(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Bin of each length: longest first, each to the fullest bin that has room."""
    bins = np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    room, used = 0, 0  # bit r of room: a bin with r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                room &= ~(1 << left)
        else:
            left, b, used = limit, used, used + 1
        bins[i] = b
        if left > size:
            free[left - size].append(b)
            room |= 1 << (left - size)
    return bins


class LocalSearch:
    """Empties bins by moves and exchanges that raise the sum of squared fills.

    Equal lengths are alike.  What an underfull bin could give for something longer (nothing, one document or two) is kept by
    size and by what would rest in the bin, so a look-up covers all of them, however many bins there are.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, limit: int):
        self.lengths, self.bins, self.limit = lengths, bins.copy(), limit
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.docs: list[dict[int, list[int]]] = [{} for _ in self.fill]  # of each length
        for i, (size, b) in enumerate(zip(lengths.tolist(), bins.tolist())):
            self.docs[b].setdefault(size, []).append(i)
        self.givers: list[dict[tuple[int, int], dict[int, None]]] = [{}, {}, {}]  # (rest, size): bins; none, one or two documents
        self.sizes = [[0] * (limit + 1) for _ in self.givers]  # rest: bits of the sizes

    def _offers(self, b: int):
        mine = sorted(self.docs[b])
        fill = int(self.fill[b])
        yield 0, (fill, 0)
        for k, x in enumerate(mine):
            yield 1, (fill - x, x)
            for y in mine[k + (len(self.docs[b][x]) < 2):]:
                yield 2, (fill - x - y, x + y)

    def _enter(self, b: int):
        if 0 < self.fill[b] < self.limit:
            for kind, at in self._offers(b):
                self.givers[kind].setdefault(at, {})[b] = None
                self.sizes[kind][at[0]] |= 1 << at[1]

    def _leave(self, b: int):
        if 0 < self.fill[b] < self.limit:
            for kind, at in self._offers(b):
                held = self.givers[kind].get(at)  # two pairs may have one sum
                if held and held.pop(b, 0) is None and not held:
                    del self.givers[kind][at]
                    self.sizes[kind][at[0]] ^= 1 << at[1]

    def _best(self, kind: int, size: int, own: int) -> tuple[int, int] | None:
        """The largest gain for ``size`` out of a bin of fill ``own`` that has room and raises the squared fill, as (rest, size).

        Of equal gains that of the fullest bin.
        """
        least, found, below, sizes = self.limit + 1, None, (1 << size) - 1, self.sizes[kind]
        for rest in range(self.limit - size, max(0, own - size + 1) - 1, -1):
            held = sizes[rest] & below
            if held:
                low = (held & -held).bit_length() - 1
                if low < least:
                    least, found = low, (rest, low)
                    if kind == 0:
                        break
        return found

    def _shift(self, size: int, a: int, b: int):
        """One document of a length from bin ``a`` to bin ``b``."""
        doc = self.docs[a][size].pop()
        if not self.docs[a][size]:
            del self.docs[a][size]
        self.docs[b].setdefault(size, []).append(doc)
        self.fill[a] -= size
        self.fill[b] += size
        self.bins[doc] = b

    def _exchange(self, b: int, out: tuple[int, ...], kind: int, at: tuple[int, int]):
        there = next(iter(self.givers[kind][at]))
        self._leave(there)
        back = () if kind == 0 else (at[1],)
        if kind == 2:
            has = self.docs[there]
            first = next(x for x in sorted(has) if at[1] - x in has and (2 * x != at[1] or len(has[x]) > 1))
            back = (first, at[1] - first)
        for size in out:
            self._shift(size, b, there)
        for size in back:
            self._shift(size, there, b)
        self._enter(there)

    def _step(self, b: int) -> bool:
        """Take some tokens out of bin ``b``, which offers nothing now: the largest gain of one kind, the simplest kind first."""
        own, mine = int(self.fill[b]), sorted(self.docs[b], reverse=True)
        ones = [(x,) for x in mine]
        twos = {x + y: (x, y) for k, x in enumerate(mine) for y in mine[k + (len(self.docs[b][x]) < 2):]}
        for kind, groups in ((0, ones), (1, [*ones, *twos.values()]), (2, ones)):
            for group in groups:
                at = self._best(kind, sum(group), own) if sum(group) <= self.limit else None
                if at:
                    self._exchange(b, group, kind, at)
                    return True
        return False

    def run(self) -> np.ndarray:
        """Shift tokens out of every underfull bin, the emptiest first, until that helps none or no bin can be saved.

        Every step raises the sum of squared fills, so the search ends.
        """
        least, left = -(-int(self.lengths.sum()) // self.limit), int((self.fill > 0).sum())
        moved = left > least
        if moved:
            for b in range(len(self.fill)):
                self._enter(b)
        while moved:
            moved = False
            used = np.flatnonzero((self.fill > 0) & (self.fill < self.limit))
            for b in used[np.argsort(self.fill[used], kind="stable")].tolist():
                if not 0 < self.fill[b] < self.limit:
                    continue
                self._leave(b)
                while left > least and self.fill[b] and self._step(b):
                    moved = True
                    left -= not self.fill[b]
                self._enter(b)
        return self.bins


def pack_lengths(lengths: np.ndarray, limit: int, packed: np.ndarray | None = None) -> np.ndarray:
    """Bin of each length; never more bins than ``packed``, where the lengths are already, has."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    bins = best_fit(lengths, limit)
    if packed is not None and packed.max() < bins.max():
        bins = packed
    return LocalSearch(lengths, bins, limit).run()


def pack(pieces: DataFrame, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The staged ``pieces`` (with ``length``) and ``sequence_id, offset, sequence_length`` of each.

    Pieces need no key: each travels with its columns.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    names = pieces.columns

    def packed(number):
        def run(key, table):
            lengths = table.column("length").to_numpy().astype(np.int64)
            packed = np.unique(table.column("packed").to_numpy(), return_inverse=True)[1] if number > 1 and len(table) else None
            bins = pack_lengths(lengths, limit, packed)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
            table = table.take(pa.array(order))
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            base = (number << 56) + (key[0].as_py() << 24)
            return pa.Table.from_arrays(
                [*[table.column(n) for n in names], pa.array(base + bins[order], pa.int64()),
                 pa.array(before - np.maximum.accumulate(np.where(first, before, 0)), pa.int64()),
                 pa.array(fill[bins[order]], pa.int64())], names=[*names, "sequence_id", "offset", "sequence_length"])
        return run

    def grouped(df, number, label, together):
        groups = max(1, -(-df.count() // group_pieces))
        dealt = df.withColumn("dealt", F.pmod(F.xxhash64(together), F.lit(groups)).cast("long"))
        return stage(dealt.groupBy("dealt").applyInArrow(
            packed(number), f"{schema}, sequence_id long, `offset` long, sequence_length long"), label)

    whole = pieces.filter(F.col("length") >= limit).select(
        "*", (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("sequence_length"))
    first = grouped(pieces.filter(F.col("length") < limit), 1, "packed", F.monotonically_increasing_id())
    loose = F.col("sequence_length") < limit
    pooled = stage(first.filter(loose).select(*names, F.col("sequence_id").alias("packed")), "loose")
    second = grouped(pooled, 2, "repacked", F.col("packed"))
    return whole.unionByName(first.filter(~loose)).unionByName(second)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``), ``sequence_id, offset, sequence_length``."""
    pieces = token_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                          tokenizer, limit, with_ids)
    pieces = pieces.select("row.doc_id", *[c for c in pieces.columns if c != "row"])
    return pack(stage(pieces, "pieces"), limit)


def default_tokenizer() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

"""Byte-level BPE encoding and decoding in numpy.

Pre-tokens (matches of the split pattern) of a batch are made distinct, bucketed by
length and laid out as padded matrices of token ids. In each round every row merges
its leftmost minimum-rank pair; pairs are looked up in an open-addressing hash table
and the rows are compacted by one column. Rows without a mergeable pair leave the
matrix. Pre-tokens longer than ``LONG`` bytes keep a heap of pairs over a linked list
instead, popping the leftmost minimum rank, so that an enormous run of letters does not
cost a pass over the row for every merge.

Null text encodes as empty text; an empty text has no ids; repeated rows are encoded
each. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.llm.chunks import slices

LONG = 512
STEM_AND_TAIL = r"(?s)^(?P<stem>.*[A-Za-z])(?P<tail>[!-/:-@\[-`{-~]*)$"
#: Distinct pre-tokens a worker keeps; a bound on memory, not on what is encoded.
CACHE = 300_000
EMPTY = np.int64(-1)
HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, by open addressing with linear probing."""

    def __init__(self, left, right, merged):
        key = (np.asarray(left, np.int64) << 20) | np.asarray(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(len(key) * 2 + 16))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(key))
        at = self._slot(key)
        while len(todo):
            free = self.keys[at[todo]] == EMPTY
            slots, first = np.unique(at[todo[free]], return_index=True)
            winners = todo[free][first]
            self.keys[slots] = key[winners]
            self.values[slots] = np.asarray(merged, np.int32)[winners]
            placed = self.keys[at[todo]] == key[todo]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key):
        return ((key.astype(np.uint64) * HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Merged ids, -1 where the pair does not merge (or a side is padding, -1)."""
        key = (left.astype(np.int64) << 20) | right.astype(np.int64)
        flat = key.ravel()
        at = self._slot(flat)
        seen = self.keys[at]
        out = np.where(seen == flat, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((seen != flat) & (seen != EMPTY))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == flat[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (seen != EMPTY)
            open_, at = open_[on], at[on]
        out[(left.ravel() < 0) | (right.ravel() < 0)] = -1
        return out.reshape(key.shape)


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = map(np.array, zip(*pairs, strict=True)) if pairs else ([], [], [])
        self.pairs = PairTable(left, right, merged)
        self.known: dict[tuple[int, int], int] = {}
        self.cache: dict[str, bytes] = {}  # int32 ids of a pre-token

    def _matrix(self, rows: list[bytes]) -> list[bytes]:
        """Ids of byte strings of like length: one padded matrix, one merge per row and round."""
        width = max(map(len, rows))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        out: list = [None] * len(rows)
        live = np.arange(len(rows))
        top = np.int32(2**31 - 1)
        merged = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 0), -1, np.int32)
        while len(live):
            rank = np.where(merged < 0, top, merged)
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(live), np.int64)
            value = rank[np.arange(len(live)), best] if rank.shape[1] else np.full(len(live), top)
            done = value == top
            if done.any():
                ended = ids[done]
                real = ended >= 0
                data, edges = ended[real].tobytes(), (np.cumsum(real.sum(1)) * 4).tolist()
                for row, a, b in zip(live[done].tolist(), [0, *edges], edges, strict=False):
                    out[row] = data[a:b]
            on = ~done
            live, best, value, ids = live[on], best[on], value[on], ids[on]
            if not len(live):
                break
            # compaction: drop column best+1 of every row, write the merged id at best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[np.arange(len(live)), best] = value
            keep = int((ids >= 0).any(0).sum()) if ids.shape[1] > 1 else 1
            ids = ids[:, :keep]
            # only the pairs beside the merge have changed; the others shift with their row
            pairs = merged[on]
            columns = np.arange(max(keep - 1, 0))
            kept = np.where(columns <= best[:, None], pairs[:, : keep - 1], pairs[:, 1:keep]) if pairs.shape[1] >= keep else np.where(columns <= best[:, None], pairs[:, : keep - 1], np.pad(pairs[:, 1:], ((0, 0), (0, 1)), constant_values=-1)[:, : keep - 1])
            rows_ = np.arange(len(live))
            for side in (best - 1, best):
                ok = (side >= 0) & (side < keep - 1)
                r, s = rows_[ok], side[ok]
                kept[r, s] = self.pairs.find(ids[r, s], ids[r, s + 1])
            merged = kept
        return out

    def _long(self, row: bytes) -> np.ndarray:
        """One long byte string: a heap of (rank, place) over a linked list of ids, so that a merge costs no pass over the row."""
        ids = self.byte_ids[np.frombuffer(row, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        at = np.flatnonzero(ranks >= 0)
        heap = list(zip(ranks[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        pair_ranks, values = ranks.tolist() + [-1], ids.tolist()
        after, before = list(range(1, len(values) + 1)), list(range(-1, len(values) - 1))
        end = len(values)
        while heap:
            rank, i = heapq.heappop(heap)
            if pair_ranks[i] != rank:
                continue  # one of its ids has been merged meanwhile
            j = after[i]
            values[i], values[j], pair_ranks[j] = rank, -1, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0:
                    found = self._one(values[left], values[right]) if right < end else -1
                    pair_ranks[left] = found
                    if found >= 0:
                        heapq.heappush(heap, (found, left))
        out = np.array(values, np.int32)
        return out[out >= 0]

    def _one(self, left: int, right: int) -> int:
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = int(self.pairs.find(np.array([left]), np.array([right]))[0])
        return found

    def encode_pieces(self, pieces: list[str]) -> None:
        """Put the ids of distinct new pre-tokens into the cache."""
        coded = [p.encode("utf-8") for p in pieces]
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate(coded):
            if len(b) > LONG:
                self.cache[pieces[k]] = self._long(b).tobytes()
            else:
                buckets.setdefault(max(1, len(b) - 1).bit_length() if len(b) > 8 else -len(b), []).append(k)
        for members in buckets.values():
            for start in range(0, len(members), 16_384):
                part = members[start : start + 16_384]
                for k, ids in zip(part, self._matrix([coded[k] for k in part]), strict=True):
                    self.cache[pieces[k]] = ids

    def learn(self, pieces: set[str]) -> None:
        fresh = [p for p in pieces if p not in self.cache]
        if fresh:
            self.encode_pieces(fresh)

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of strings whose pre-tokens are the same alone as in their text."""
        cache = self.cache
        cache[""] = b""
        fresh = [u for u in units if u not in cache]
        self.learn({u for u in fresh if u[u[0] == " " :].isalpha()})  # a pre-token as it is
        fresh = {u: self.split(u) for u in fresh if u not in cache}
        self.learn({p for pieces in fresh.values() for p in pieces})
        for unit, pieces in fresh.items():
            if len(pieces) != 1:
                self.cache[unit] = b"".join([self.cache[p] for p in pieces])
        return [self.cache[u] for u in units]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends): text i has ids[ends[i-1]:ends[i]].

        Texts are cut before every space into units, which Arrow makes distinct. A cut is
        safe unless white space meets white space there; texts with such a place are split
        as a whole.
        """
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.known.clear()
        lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, segments = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = pc.binary_length(segments).to_numpy(zero_copy_only=False)
        trimmed = lambda kernel: pc.binary_length(kernel(segments)).to_numpy(zero_copy_only=False)
        blank = sizes == 0
        opens, closes = blank | (trimmed(pc.utf8_ltrim_whitespace) < sizes), blank | (trimmed(pc.utf8_rtrim_whitespace) < sizes)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        meets = np.zeros(len(codes), bool)
        meets[1:] = closes[codes[:-1]] & opens[codes[1:]] & ~first[1:] & ~(first[:-1] & blank[codes[:-1]])
        whole = np.logical_or.reduceat(meets, offsets[:-1])
        # punctuation after an ASCII letter starts a pre-token, so units share the ids of their stems
        halves = pc.extract_regex(segments, STEM_AND_TAIL)
        stems = pc.if_else(halves.is_valid(), halves.field("stem"), segments).dictionary_encode()
        tails = pc.fill_null(halves.field("tail"), "").dictionary_encode()
        stem_of, tail_of = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (stems, tails))
        kinds = stem_of[codes] * 2 + ~first
        live = ~np.repeat(whole, np.diff(offsets))
        used = np.flatnonzero(np.bincount(kinds[live], minlength=2 * len(stems.dictionary)))
        names, ends = stems.dictionary.to_pylist(), tails.dictionary.to_pylist()
        parts = self._units([" " * (k & 1) + names[k >> 1] for k in used.tolist()])
        place = np.zeros(2 * len(names), np.int64)
        place[used] = np.arange(len(used))
        last = len(parts) + np.arange(len(ends))
        parts += self._units(ends)
        odd = np.flatnonzero(whole).tolist()
        text_at = len(parts) + np.arange(len(odd))
        for i in odd:
            pieces = self.split(texts[i].as_py())
            self.learn(set(pieces))
            parts.append(b"".join(map(self.cache.__getitem__, pieces)))
        # a unit's stem and tail; of a text split as a whole, one entry
        entries = np.full((len(codes), 2), -1)
        entries[live, 0], entries[live, 1] = place[kinds[live]], last[tail_of[codes[live]]]
        entries[offsets[:-1][odd], 0] = text_at
        entries = entries.ravel()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(parts), np.int32)
        counts = np.where(entries >= 0, sizes[entries], 0)
        stops = np.cumsum(counts)
        flat = ids[np.repeat(starts[entries] - (stops - counts), counts) + np.arange(stops[-1])]
        return flat, stops[offsets[1:] * 2 - 1]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(all bytes, ends): the tokens' bytes gathered from one table."""
        sizes = self.token_sizes[ids]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.token_starts[ids] - stops[:-1], sizes) + np.arange(stops[-1])
        return self.token_bytes[at].tobytes(), stops[ends]


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """array<int> of token ids of each text; null text gives an empty array."""

    @F.arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        own = codec(rank_file, pattern)
        done = [own.encode(part) for part in slices(texts)]
        ids = np.concatenate([np.zeros(0, np.int32), *(d[0] for d in done)])
        sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(d[1], prepend=0) for d in done)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(ids))

    return bpe_encode(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The bytes the ids stand for; null ids give empty bytes."""

    @F.arrow_udf("binary")
    def bpe_decode(rows: pa.Array) -> pa.Array:
        own = codec(rank_file, pattern)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        out, ends = own.decode(rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(out)])

    return bpe_decode(ids)

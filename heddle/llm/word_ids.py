"""Token ids by a tokenizer file of the ``tokenizers`` library, packed as little-endian uint32.

The tokenizer of the packing operators folds case, drops white space and its pieces never
cross it, so a text's ids are those of its chunks in order. The distinct chunks of a part
of about 2 MB are tokenised once: punctuation after an ASCII letter starts a piece of its
own, so chunks share the ids of their stems; stems of letters alone are tokenised many to
a call and cut apart at the tokens that end words. Stems stay in Arrow and numpy arrays
bounded in bytes; when they are full, those in the fewest parts go.
Chunks that may hold a special token's string are tokenised by themselves, as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.llm.chunks import coded, slices

#: Bytes of stems and ids a worker keeps; a bound on memory, not on what is tokenised.
CACHE_BYTES, ENTRY_BYTES = 16 << 20, 20
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
JOINED = 500
PART_BYTES = 2_000_000


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[starts[i]:starts[i] + sizes[i]] for every i, joined, and where each begins, with the end."""
    stops = np.concatenate(([0], np.cumsum(sizes)))
    return data[np.repeat(starts - stops[:-1], sizes) + np.arange(stops[-1])], stops


def strings(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(stops) - 1, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(data))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the places of large strings without nulls."""
    _, places, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def halves(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Stems and tails: the ASCII punctuation after the last letter a-z is a chunk's tail if nothing else is there."""
    data, places = raw(chunks)
    before, begins = raw(pc.ascii_rtrim(chunks, characters=PUNCTUATION))
    sizes, kept = np.diff(places), np.diff(begins)
    last = np.zeros(len(chunks), np.uint8)
    last[kept > 0] = before[begins[1:][kept > 0] - 1]
    kept = np.where((last >= ord("a")) & (last <= ord("z")) & ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False), kept, sizes)
    return strings(*runs(data, places[:-1], kept)), strings(*runs(data, places[:-1] + kept, sizes - kept))


class Words:
    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.merges = Tokenizer(self.tokenizer.model)  # for words that normalising and splitting leave as they are
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stems = pa.array([""], pa.large_string())
        self.ids, self.starts, self.sizes, self.parts = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _each(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        codes = [np.array(code.ids, "<u4") for code in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return codes, [np.array([len(c) for c in codes], np.int64)]

    def learn(self, pieces: list[str]) -> None:
        """Add pieces that are not known yet."""
        letters = [p.isalpha() for p in pieces]
        ascii_ = [own and p.isascii() and p.islower() for p, own in zip(pieces, letters, strict=True)]
        odd = [p for p, own in zip(pieces, letters, strict=True) if not own]
        names, (ids, sizes) = odd, self._each(odd)
        for tokenizer, words in (
            (self.merges, [p for p, plain in zip(pieces, ascii_, strict=True) if plain]),
            (self.tokenizer, [p for p, own, plain in zip(pieces, letters, ascii_, strict=True) if own and not plain]),
        ):
            groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
            for group, code in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                own = np.array(code.ids, "<u4")
                ends = np.flatnonzero(self.ends_word[own]) + 1
                if len(ends) == len(group):
                    ids.append(own)
                    sizes.append(np.diff(ends, prepend=0))
                else:  # folding has made marks out of a letter, which only adds words
                    more = self._each(group)
                    ids += more[0]
                    sizes += more[1]
            names += words
        fresh = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(fresh) - fresh])
        self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, fresh])
        self.stems = pa.concat_arrays([self.stems, pa.array(names, pa.large_string())])
        self.parts = np.concatenate([self.parts, np.zeros(len(names), np.int64)])

    def held(self) -> int:
        return self.stems.nbytes + self.ids.nbytes + ENTRY_BYTES * len(self.stems)

    def forget(self) -> None:
        """Keep at most half of the stems, those of the most parts; their counts are halved, so that old ones can go."""
        least = np.partition(self.parts, len(self.parts) // 2)[len(self.parts) // 2]
        keep = self.parts > least
        keep[0] = True  # the empty tail
        self.stems = self.stems.filter(pa.array(keep))
        self.ids, stops = runs(self.ids, self.starts[keep], self.sizes[keep])
        self.starts, self.sizes, self.parts = stops[:-1], self.sizes[keep], self.parts[keep] // 2

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """The place of every piece among the stems, which learn those that are new."""
        found = pc.fill_null(pc.index_in(pieces, value_set=self.stems), -1).to_numpy().copy()
        new = np.flatnonzero(found < 0)
        if len(new):
            known, fresh = len(self.stems), pieces.take(pa.array(new))
            self.learn(fresh.unique().to_pylist())
            found[new] = known + pc.index_in(fresh, value_set=self.stems.slice(known)).to_numpy()
        self.parts[found] += 1
        return found

    def pack(self, texts: pa.Array, end: int | None) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        codes, ends, chunks = coded(pc.if_else(special, texts, pc.ascii_lower(texts)))
        stems, tails = (own.dictionary_encode() for own in halves(chunks))
        if self.held() > CACHE_BYTES:
            self.forget()
        found = self.rows(pa.concat_arrays([stems.dictionary, tails.dictionary]))
        own = [found[stems.indices.to_numpy()], found[len(stems.dictionary) :][tails.indices.to_numpy()]]
        entries = np.stack(own, 1).ravel()
        ids, stops = runs(self.ids, self.starts[entries], self.sizes[entries])
        begins, sizes = stops[:-1:2], np.diff(stops[::2])
        flat, stops = runs(ids, begins[codes], sizes[codes])
        data, tail = flat.tobytes(), b"" if end is None else np.array([end], "<u4").tobytes()
        edges = (np.concatenate(([0], stops[ends])) * 4).tolist()
        return [data[a:b] + tail for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def words_of(tokenizer_file: str) -> Words:
    return Words(tokenizer_file)


def pack(texts: pa.Array, tokenizer_file: str, end: int | None) -> list[bytes]:
    own = words_of(tokenizer_file)
    rows = [row for part in slices(texts, PART_BYTES) for row in own.pack(part, end)]
    pa.default_memory_pool().release_unused()
    return rows


def packed_ids(text: Column, tokenizer_file: str, end: int | None) -> Column:
    """Binary: the text's ids, then ``end``; null text counts as empty."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(pack(texts, tokenizer_file, end), pa.binary())

    return ids(text)

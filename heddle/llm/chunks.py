"""White-space chunks of texts as dictionary codes, made by Arrow's kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[pa.Array]:
    """The array in parts of about ``limit`` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, ends, dictionary): text i holds codes[ends[i-1]:ends[i]]; chunks are ``[^\\x20\\x09-\\x0D]+``.

    Null and empty texts have no chunks.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(encoded.dictionary), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # leading and trailing white space leave empty strings
        held = real[codes]
        before = np.concatenate(([0], np.cumsum(held)))
        codes, offsets = codes[held], before[offsets]
    return codes, offsets[1:], encoded.dictionary

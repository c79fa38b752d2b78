"""Words of whole texts in bounded pieces: maximal runs of bytes other than blanks and U+0009 to U+000D."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x09-\x0d ]")


def text_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """An Arrow string column as binary (null counts as empty), with the byte offsets of its rows."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    return texts, np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy())))


def word_chunks(data: bytes, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``size`` bytes each; no word is cut."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + size)
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        if words:
            yield words
        at = end

"""Words of Arrow batches of texts, for operators that look at a text's words in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time: more only where one text has more.
GROUP_BYTES = 4 << 20


class Codes(dict):
    """Numbers words from 0 on, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def groups(batches: Iterator[pa.RecordBatch], text: str, budget: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows with about `budget` bytes of text, and their texts as UTF-8; null is the empty text."""
    for batch in batches:
        raw = pc.fill_null(batch[text].cast(pa.binary()), b"")
        ends, start = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + budget, "right")))
            yield batch.slice(start, stop - start), raw.slice(start, stop - start).to_pylist()
            start = stop


def split_words(raw: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text: these six bytes are what bytes.split() splits at."""
    return raw.split()


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal for equal words, and the place at which each text begins (and the last ends)."""
    codes, out = Codes(), []
    for words in texts:
        out += map(codes.__getitem__, words)
    return np.array(out, np.int64), np.concatenate([[0], np.cumsum([len(w) for w in texts], dtype=np.int64)]).astype(np.int64)

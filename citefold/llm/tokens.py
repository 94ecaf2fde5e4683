"""Token ids of whole texts, exactly as the tokenizers library gives them, one library call per distinct piece.

Both vocabularies in use split a text before merging, and no merge crosses from a visible character to white space
after it, nor from an ASCII letter to the stop or comma after it. A text is therefore cut where ASCII white space follows
a character that is surely not white space, and before such punctuation; equal pieces are encoded once. Places where the neighbourhood might be Unicode white space are left uncut, which
only makes a longer piece.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from citefold.llm.batches import WHITE, byte_class, text_bytes

# Bytes after which a cut is not certain: white space and separators themselves, and the last two bytes of
# multi-byte white space (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_UNSURE_LAST = byte_class(lambda i: i <= 0x20 or i == 0x7F)
_UNSURE_BEFORE = byte_class(lambda i: i in (0xC2, 0x9A, 0x80, 0x81))
_PUNCTUATION = byte_class(lambda i: chr(i) in ".,;:!?")
_LETTER = byte_class(lambda i: i < 0x80 and chr(i).isalpha())
MEMORY = 400_000  # pieces a worker remembers; others are encoded in each slice anew, with the same result


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a piece begins: every row start, and each place where a cut changes no token."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = WHITE[data]
    cut[1:] &= ~_UNSURE_LAST[data[:-1]]
    cut[0] = True
    cut[2:] &= ~((data[1:-1] >= 0x80) & _UNSURE_BEFORE[data[:-2]])
    cut[1:] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes slices of texts; remembers the ids of the first ``MEMORY`` distinct pieces it meets."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.places: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.edges = np.zeros(1, np.int64)  # ids of piece i: ids[edges[i]:edges[i + 1]]

    def _library(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        ends = []
        for at in range(0, len(pieces), 10_000):
            for done in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces[at:at + 10_000]],
                                                         add_special_tokens=False):
                ids += done.ids
                ends.append(len(ids))
        return ids, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end as uint32, bounds of the rows)."""
        data, offsets = text_bytes(texts)
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        edges = np.r_[starts, len(data)].astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                     [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = flat.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        known = len(self.places)
        place = np.fromiter((self.places.get(p, -1) for p in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        new_ids, new_ends = self._library([distinct[i] for i in missing.tolist()])
        place[missing] = known + np.arange(len(missing))
        table = np.concatenate([self.ids, np.array(new_ids, np.uint32)])
        bounds = np.concatenate([self.edges, self.edges[-1] + np.array(new_ends, np.int64)])
        keep = min(len(missing), MEMORY - known)
        if keep > 0:
            self.places.update((distinct[i], known + k) for k, i in enumerate(missing[:keep].tolist()))
            self.edges = bounds[:known + keep + 1].copy()
            self.ids = table[:self.edges[-1]].copy()
        row = place[codes]
        first, counts = bounds[row], bounds[row + 1] - bounds[row]
        ends = np.cumsum(counts)
        ids = table[np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]))]
        return ids, np.r_[0, ends][np.searchsorted(starts, offsets)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task with the pieces it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    return Encoder(path)

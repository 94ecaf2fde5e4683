"""BPE encoding and decoding with forced boundaries, for vocabularies whose words end in a suffix and drop white space.

A token that covers two neighbouring bytes holds that byte pair. Pairs that occur inside no vocabulary token are
therefore certain token boundaries, whatever stands around them: no chain of merges crosses them. ``Bpe`` marks all such
pairs in a 256 x 256 table. A text is cut twice by it:

1. the raw text, at forced pairs where a word surely ends (beside white space; a change between ASCII letters, digits
   and signs), so that normalisation and word splitting see each fragment alone and equal fragments are encoded once;
2. each normalised word, at every forced pair. Only the last fragment of a word carries the end-of-word suffix.

Fragments are encoded independently and their ids are concatenated.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from tokenizers import Tokenizer, models, pre_tokenizers

from citefold.llm.batches import LOWER, WHITE, byte_class, slices, text_bytes

MEMORY = 300_000  # fragments of raw text that a worker remembers; when full it starts anew, with the same result

_LETTER = byte_class(lambda i: i < 0x80 and chr(i).isalpha())
_DIGIT = byte_class(lambda i: 0x30 <= i <= 0x39)
_SIGN = byte_class(lambda i: i < 0x80) & ~_LETTER & ~_DIGIT & ~WHITE


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves; the others take the code points from 256 on, in order.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Bpe:
    """A word-ended byte-level BPE vocabulary from a tokenizers file, with its forced boundaries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        byte_level = pre_tokenizers.ByteLevel.alphabet()
        letters = byte_letters()
        if model["type"] != "BPE" or not self.suffix or set(byte_level) != set(letters) or spec["decoder"] is not None \
                or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("forced boundaries need a byte-level BPE vocabulary with word ends and no decoder")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        missing = [c for c in letters if c not in vocabulary or c + self.suffix not in vocabulary]
        if missing:
            raise ValueError("some byte has no token")
        self.last = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=self.suffix))
        self.inner = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be plain strings of the raw text")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.inside = self._pairs(vocabulary, letters)
        self.letters, self.to_letters = letters, {b: c for c, b in letters.items()}
        self.raw_cut = self._raw_cuts()
        names = {i: t for t, i in {**vocabulary, **self.specials}.items()}
        shown = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.cumsum([0, *map(len, shown)])
        self.known: dict[bytes, bytes] = {}

    def _pairs(self, vocabulary, letters) -> np.ndarray:
        """[a, b]: whether some token holds byte b right after byte a."""
        inside = np.zeros((256, 256), bool)
        for token in vocabulary:
            body = np.fromiter((letters[c] for c in token.removesuffix(self.suffix)), np.uint8)
            inside[body[:-1], body[1:]] = True
        return inside

    def _raw_cuts(self) -> np.ndarray:
        """[a, b]: forced pairs of raw bytes between which a word surely ends; refused where one is not forced.

        Before white space always. Between two ASCII bytes of different kinds, and after or before a digit: not after an
        apostrophe, which may begin a contraction, nor beside a sign that a special token holds.
        """
        held = np.zeros(256, bool)
        held[list("".join(self.specials).encode())] = True
        held &= _SIGN
        self.odd = held | byte_class(lambda i: i >= 0x80 or chr(i) == "'")  # bytes that plain fragments do not hold
        kinds = [_LETTER, _DIGIT, _SIGN]
        ends = np.zeros((256, 256), bool)
        for x in kinds:
            for y in kinds:
                if x is not y or x is _DIGIT:
                    ends |= x[:, None] & y[None, :]
        ends[ord("'")] = False
        ends[held] = False
        ends[:, held] = False
        ends |= ~WHITE[:, None] & WHITE[None, :]
        if (ends & self.inside[LOWER][:, LOWER]).any():
            raise ValueError("a token of this vocabulary spans words")
        return ends

    def raw_fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes without white space, starts of the fragments in them, fragments before each text, whether a fragment is plain).

        A plain fragment is ASCII of one kind and may be read in lower case at once; all others keep their bytes.
        """
        cut = np.ones(len(data), bool)
        white = WHITE[data]
        cut[1:] = self.raw_cut.ravel()[data[:-1].astype(np.int32) * 256 + data[1:]] | white[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        cut &= ~white
        upto = np.r_[0, np.cumsum(~white)]
        firsts = np.flatnonzero(cut)
        starts, kept = upto[firsts], data[~white]
        if not len(starts):
            return kept, starts, np.zeros(len(offsets), np.int64), np.zeros(0, bool)
        plain = ~np.logical_or.reduceat(self.odd[kept], starts)
        lower = np.repeat(plain, np.diff(np.r_[starts, len(kept)]))
        return np.where(lower, LOWER[kept], kept), starts, np.searchsorted(firsts, offsets), plain

    def _split(self, fragment: str) -> list[bytes | int]:
        """Words and special ids of a fragment of raw text, by the normaliser and word pattern of the file."""
        items: list[bytes | int] = []
        at = 0
        for found in [*(self.special.finditer(fragment) if self.special else ()), None]:
            text = fragment[at:found.start() if found else len(fragment)]
            if text:
                text = self.tokenizer.normalizer.normalize_str(text)
                items += [bytes(map(self.letters.__getitem__, w)) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            if found:
                items.append(self.specials[found.group()])
                at = found.end()
        return items

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of normalised words: each is cut at its forced pairs, and the fragments are encoded independently."""
        body = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.zeros(len(body) + 1, bool)
        cut[1:-1] = ~self.inside[body[:-1], body[1:]]
        cut[ends] = True
        stops = np.flatnonzero(cut)
        last = np.isin(stops, ends, assume_unique=True)
        pieces, at, data = [], 0, body.tobytes()
        for stop, end in zip(stops.tolist(), last.tolist()):
            pieces.append((data[at:stop], end))
            at = stop
        ids: dict[tuple[bytes, bool], bytes] = {}
        for end, model in ((True, self.last), (False, self.inner)):
            asked = list({p for p in pieces if p[1] == end})
            shown = [p.decode("latin-1").translate(self.to_letters) for p, _ in asked]
            for k in range(0, len(asked), 10_000):
                ids.update(zip(asked[k:k + 10_000], (np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(
                    shown[k:k + 10_000], add_special_tokens=False))))
        place = np.searchsorted(stops, ends)
        out, at = [], 0
        for stop in place.tolist():
            out.append(ids[pieces[at]] if stop == at else b"".join([ids[p] for p in pieces[at:stop + 1]]))
            at = stop + 1
        return out

    def fragments(self, raw: list[bytes], plain: list[bool]) -> list[bytes]:
        """Ids of distinct fragments of raw text."""
        words: dict[bytes, int] = {}
        items = []
        for fragment, simple in zip(raw, plain):
            if simple:
                own = [fragment]
            else:
                own = self._split(fragment.decode("utf-8"))
            items.append([i if isinstance(i, int) else words.setdefault(i, -1 - len(words)) for i in own])
        ids = self._words(list(words)) if words else []
        return [ids[-1 - own[0]] if len(own) == 1 and own[0] < 0 else
                b"".join([ids[-1 - i] if i < 0 else np.uint32(i).tobytes() for i in own]) for own in items]

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """(ids of all texts end to end as little-endian 32-bit integers, bounds of the texts in ids); null is empty."""
        data, offsets = text_bytes(texts)
        body, starts, bounds, plain = self.raw_fragments(data, offsets)
        if not len(starts):
            return b"", np.zeros(len(offsets), np.int64)
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.r_[starts, len(body)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
        coded = flat.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        simple = np.zeros(len(distinct), bool)
        simple[codes] = plain
        own = [self.known.get(raw) for raw in distinct]
        fresh = [i for i, ids in enumerate(own) if ids is None]
        made = self.fragments([distinct[i] for i in fresh], simple[fresh].tolist())
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
        for i, ids in zip(fresh, made):
            own[i] = ids
            if len(self.known) < MEMORY:
                self.known[distinct[i]] = ids
        ends = np.cumsum((np.fromiter(map(len, own), np.int64, len(own)) // 4)[codes])
        return b"".join(np.array(own, object)[codes].tolist()), np.r_[0, ends][bounds]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the tokens' names with a space after each; ids beyond the vocabulary have none and are left out."""
        ids = ids[ids < len(self.shown_at) - 1].astype(np.int64)
        ids = ids[self.shown_at[ids + 1] - self.shown_at[ids] > 1]
        sizes = self.shown_at[ids + 1] - self.shown_at[ids]
        ends = np.cumsum(sizes)
        return self.shown[np.repeat(self.shown_at[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Bpe:
    """One vocabulary per Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    return Bpe(path)


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``column``, with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    The ids are those of the tokenizers library without special tokens added, truncation and padding; the strings of
    special tokens in a text get their ids, as they do there. A null or empty text has no ids; rows are kept one by one,
    repeated ones too; other columns pass through, and those named ``n_tokens`` or ``ids`` are replaced.
    """
    kept = [c for c in docs.columns if c not in (column, "n_tokens", "ids")]
    source = docs.select(*kept, docs[column].cast("string").alias("text")) if "text" not in kept else docs.select(
        *kept, docs[column].cast("string").alias("_text_of_row"))
    name = source.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, name):
            ids, bounds = bpe.encode(batch.column(name))
            body = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [
                None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(bounds)), body],
                                             [*kept, "n_tokens", "ids"])

    schema = StructType([source.schema[c] for c in kept]).add("n_tokens", "long").add("ids", "binary")
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` with ``decoded``: the names of the tokens of ``ids``, one space between them.

    That is what the library's decode gives with special tokens kept, as these vocabularies have no decoder. Null ids
    decode to null and no ids to an empty text. A column named ``decoded`` is replaced.
    """
    source = encoded.select(*[c for c in encoded.columns if c != "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, "ids"):
            texts = [None if i is None else bpe.decode(np.frombuffer(i, "<u4"))[:-1].tobytes()
                     for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                             [*batch.schema.names, "decoded"])

    return source.mapInArrow(run, StructType(list(source.schema)).add("decoded", "string"))

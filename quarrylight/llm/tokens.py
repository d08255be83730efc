"""Token ids of whole texts by a public byte-level BPE vocabulary.

The library's merges work inside one piece of its split pattern at a time, so the ids of a text are those of its pieces
in a row. Pieces repeat far more than texts do: the texts of plain Latin script in an Arrow batch are cut into segments between
places that surely end a piece, Arrow finds the distinct ones, and only those not met before are split by the pattern, go to
the library's model (in the byte alphabet of byte-level BPE) and enter a bounded table. Any other text goes to the library
whole, and so does a text that holds the string of an added token: the library makes it that token's id. So do all texts
where the vocabulary's file states another normalizer, splitting or kind of model than this way stands for.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
#: Segments and ids that are kept from batch to batch, in Arrow's own buffers.
CACHE_BYTES = 24 << 20
#: Ranges whose letters, digits and white space have been settled for long: Latin and general punctuation.
PLAIN = ((0x0000, 0x024F), (0x2010, 0x2027), (0x2030, 0x205E))


def _class(test) -> str:
    chars = [c for lo, hi in PLAIN for c in range(lo, hi + 1) if test(chr(c))]
    return "".join(f"\\U{c:08x}" for c in chars)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = "\\t-\\r \\x85\\xa0"
    split = (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )
    other = "[^" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in PLAIN) + "]"
    return re.compile(split), re.compile(other)


#: Kinds of bytes. OTHER are those outside ASCII; LATIN1 is the first byte of U+0080 to U+00BF, where NEL and NBSP are.
LETTER, DIGIT, MARK, QUOTE, SPACE, BREAK, OTHER, LATIN1 = range(8)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = [LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(128)]
_KIND[ord("'")], _KIND[ord(" ")], _KIND[0x09:0x0E], _KIND[0xC2] = QUOTE, SPACE, BREAK, LATIN1
#: Neighbours between which a piece always ends: a change of kind, but not after a quote, which takes the letters of 's or 're.
_ENDS = np.zeros((8, 8), bool)
_ENDS[LETTER, [DIGIT, MARK, QUOTE, SPACE, BREAK]] = _ENDS[DIGIT, [LETTER, MARK, QUOTE, SPACE, BREAK]] = True
_ENDS[MARK, [LETTER, DIGIT, SPACE, BREAK]] = _ENDS[QUOTE, [DIGIT, SPACE, BREAK]] = True
#: What a space before it belongs to: all but white space.
_TAKES_SPACE = np.ones(8, bool)
_TAKES_SPACE[[SPACE, BREAK, LATIN1]] = False


def segment_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments of plain texts start, and the end. raw: the texts' bytes in a row, text i at offsets[i]:offsets[i + 1].

    Not every piece's end is found, but what is found is one, whatever stands on the other side of it: the pieces of a text
    are those of its segments.
    """
    kind = _KIND[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = _ENDS.ravel()[(kind[:-1] << 3) | kind[1:]]
    led = (kind[:-1] == SPACE) & _TAKES_SPACE[kind[1:]]
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    led[borders - 1] = False  # a text's last space goes with the white space before it
    cut[:-2] |= led
    cut[offsets] = True
    return np.flatnonzero(cut)


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as a visible character: itself if it is one, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def splits_by_bytes(library: Tokenizer) -> bool:
    """Whether a tokenizer is plain byte-level BPE: no normalizer, the usual pattern without a leading space, merges only."""
    stated = json.loads(library.to_str())
    first, bpe = stated["pre_tokenizer"] or {}, stated["model"]
    own = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return (
        stated["normalizer"] is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        and bpe["type"] == "BPE" and not any(bpe.get(k) for k in own) and not stated.get("truncation") and not stated.get("padding")
    )


def binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Stretches of `data` from each offset to the next."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data])


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Segments met are kept with their ids up to CACHE_BYTES; a full table gives
    way to the segments of the batch at hand."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.split, self.other = _patterns()
        self.by_piece = splits_by_bytes(self.library)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.met = self.met_ids = pa.array([], pa.large_binary())

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        return self.by_piece and (text.isascii() or not self.other.search(text)) and not any(a in text for a in self.added)

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; null counts as empty."""
        return bytes(self.batch(pa.array([text], pa.string()))[0])

    def batch(self, texts: pa.Array) -> list[bytes | memoryview]:
        """The ids of each text of a batch; null counts as empty."""
        out: list[bytes | memoryview] = [b""] * len(texts)
        by_piece = np.zeros(len(texts), bool)
        for i, scalar in enumerate(texts):
            if text := scalar.as_py():
                by_piece[i] = self.plain(text)
                if not by_piece[i]:
                    out[i] = self.whole(text)
        rows = np.flatnonzero(by_piece)
        if len(rows):
            for i, ids in zip(rows, self._by_segment(texts.take(pa.array(rows)).cast(pa.large_binary())), strict=True):
                out[i] = ids
        return out

    def _by_segment(self, texts: pa.Array) -> list[memoryview]:
        offsets, data = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8), texts.buffers()[2]
        data, offsets = data.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
        starts = segment_starts(np.frombuffer(data, np.uint8), offsets)
        segments = binary(starts, data).dictionary_encode()
        places = pc.index_in(segments.dictionary, value_set=self.met).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(places < 0)
        places[new] = len(self.met) + np.arange(len(new))
        fresh = segments.dictionary.take(pa.array(new))
        met, met_ids = pa.concat_arrays([self.met, fresh]), pa.concat_arrays([self.met_ids, self._new_ids(fresh)])
        found = met_ids.take(pa.array(places[segments.indices.to_numpy()]))
        if met.nbytes + met_ids.nbytes > CACHE_BYTES:
            met, met_ids = segments.dictionary, met_ids.take(pa.array(places))
        self.met, self.met_ids = met, met_ids
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[np.searchsorted(starts, offsets)].tolist()
        flat = memoryview(found.buffers()[2])
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _new_ids(self, segments: pa.Array) -> pa.Array:
        """The ids of segments, from the library's model."""
        ids: list[int] = []
        ends = [0]
        for segment in segments.cast(pa.large_string()).to_pylist():
            for piece in self.split.findall(segment):
                symbols = piece.encode().decode("latin-1").translate(self.alphabet)
                ids += [t.id for t in self.model.tokenize(symbols)]
            ends.append(4 * len(ids))
        return binary(np.array(ends), pa.py_buffer(np.array(ids, "<u4")))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

"""SentencePiece encoding and decoding of whole texts with a merge-type (BPE) model.

A merge-type encoding has one last token for each prefix of a text: the only token t that ends there and whose pair with the
last token u of the prefix before it is compatible, that is, merging the characters of u and t together ends in u and t again.
So a table of last tokens is filled from left to right: an automaton over all pieces gives the tokens that end at a place,
the pair test (kept for pairs met before) picks one, and ids are recovered backwards from the end.

Texts are cut where no piece reaches over (`segment_pattern`). Segments repeat far more than texts do, and the ids of those met lately are kept. A character that no
piece holds stands alone, as its UTF-8 bytes' tokens. Decoding is the library's, on the ids.

Defined results: null text is empty, and an empty text has no ids and decodes to the empty string; repeated rows and null ids are
kept as they are; an empty table gives no rows; extra columns are ignored, whatever their names. A model that this method
does not cover (unigram, a normalizer that changes texts, user-defined or unused pieces, no byte tokens) is refused.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tokens import tokenizer_path
from quarrylight.llm.words import chunks, tidy
from quarrylight.tables import bounded_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments and pairs whose results are kept, twice as many at most; longer segments are not kept.
KEPT_SEGMENTS, KEPT_PAIRS, KEPT_CHARS = 250_000, 1_000_000, 48
#: Bytes of text that are encoded into one batch.
TOGETHER = 1 << 20


class Recent(dict):
    """Keeps what has been computed: a full table becomes the old one, from which values in use come back."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old[key] if key in self.old else self.compute(key)
        self[key] = value
        return value


def segment_pattern(joined: set[tuple[str, str]]) -> str:
    """Segments of a text with U+2581 for spaces. joined: characters that some piece holds next to each other.

    Cuts are before U+2581 after another character, and between a letter or digit and another kind of character, either way
    round, but none where a piece holds both neighbours; a segment that reaches over such a place goes on to the next U+2581.
    """
    if any(a != SPACE and b == SPACE for a, b in joined):
        return ".+"
    after: dict[tuple[bool, str], list[str]] = {}
    for a, b in sorted(joined):
        kinds = [c.isalnum() or c == "_" for c in (a, b)]
        if kinds[0] != kinds[1] and a != SPACE:
            after.setdefault((kinds[0], a), []).append(b)
    on = {}
    for kind in (True, False):
        found = {a: re.escape("".join(bs)) for (k, a), bs in after.items() if k == kind}
        on[kind] = rf"(?=[{''.join(found.values())}])(?:" + "|".join(f"(?<={re.escape(a)})[{bs}]" for a, bs in found.items()) + ")" if found else "(?!)"
    return rf"{SPACE}*(?:\w+(?:(?:{on[True]})[^{SPACE}]*)?|[^\w{SPACE}]+(?:(?:{on[False]})[^{SPACE}]*)?)|{SPACE}+"


class History(NamedTuple):
    """A text's merges by themselves: the rank of each (infinite: no more), its first and last part before and after them,
    and whether one part is left."""

    ranks: list[float]
    firsts: list[str]
    lasts: list[str]
    whole: bool


class Model:
    """A merge-type model's pieces and what has been found out about pairs of them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = proto.SentencePiece
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        odd = {p.type for p in proto.pieces} & {kinds.USER_DEFINED, kinds.UNUSED}
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
        if trainer.model_type != trainer.BPE or odd or not plain or len(of_byte) < 256 or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is not a merge-type model with byte tokens whose normalizer keeps texts as they are")
        self.library = SentencePieceProcessor(model_file=path)
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.text = {i: piece for piece, (_, i) in self.pieces.items()}
        self.of_byte = [of_byte[b] for b in range(256)]
        self.segments = re.compile(segment_pattern({pair for piece in self.pieces for pair in zip(piece, piece[1:])}), re.DOTALL)
        self.histories: dict[int, History] = {}
        self.fits: list[dict[int, bool]] = []  # for each token, whether it can follow the tokens met so far
        self.met = 0
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.pieces.items():
            self.fits.append({})
            self.automaton.add_word(piece, (len(piece), i, self.fits[-1]))
        self.automaton.make_automaton()
        self.kept = Recent(self.encode, KEPT_SEGMENTS)

    def history(self, token: int) -> History:
        if token not in self.histories:
            self.histories[token] = self.merges(self.text[token])
        return self.histories[token]

    def merges(self, text: str) -> History:
        """The model's merges by themselves: the best-scored neighbours first, the leftmost of equal ones."""
        parts, none = list(text), (math.inf, -1)
        ranks, firsts, lasts = [], [parts[0]], [parts[-1]]
        while True:
            rank, i = min((self.pieces.get(a + b, none)[0], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else none
            if rank == math.inf:
                return History([*ranks, math.inf], firsts, lasts, len(parts) == 1)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ranks.append(rank)
            firsts.append(parts[0])
            lasts.append(parts[-1])

    def compatible(self, before: int, after: int) -> bool:
        """Whether token `after` can follow `before` (-1: a text's start, or a character of no piece): merging both texts together
        must do what merging each by itself does. Both go on by their own merges, the best first, and at each step the neighbours
        across the border must not be the best."""
        right = self.history(after)
        if before < 0 or not right.whole:
            return right.whole
        left, i, j = self.history(before), 0, 0
        while True:
            across = self.pieces.get(left.lasts[i] + right.firsts[j], (math.inf, -1))[0]
            ours, theirs = left.ranks[i], right.ranks[j]
            if ours == across == theirs == math.inf:
                return True
            if ours <= across and ours <= theirs:
                i += 1
            elif across <= theirs:
                return False
            else:
                j += 1

    def learned(self, before: int, after: int, known: dict[int, bool]) -> bool:
        if self.met >= KEPT_PAIRS:
            for fit in self.fits:
                fit.clear()
            self.met = 0
        self.met += 1
        known[before] = self.compatible(before, after)
        return known[before]

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix, from the empty one on; -1: none, or a character of no piece."""
        last, settled = [-1] * (len(text) + 1), -1
        for end, (length, token, known) in self.automaton.iter(text):
            if end != settled:  # by a longer token
                before = last[end + 1 - length]
                fit = known.get(before)
                if fit is None:
                    fit = self.learned(before, token, known)
                if fit:
                    last[end + 1], settled = token, end
        return last

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian integers: its table of last tokens, read backwards from the end."""
        last, at, back = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            if token < 0:
                back += [self.of_byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                back.append(token)
                at -= len(self.text[token])
        return struct.pack(f"<{len(back)}i", *back[::-1])

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, "<i4")
        written = SPACE + text.replace(" ", SPACE)
        kept = self.kept
        found = [kept[s] if len(s) <= KEPT_CHARS else self.encode(s) for s in self.segments.findall(written)]
        return np.frombuffer(b"".join(found), "<i4")


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: every whole text's ids by the model at `path`, and what these decode to."""
    path = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in chunks(batch, 1, TOGETHER):
                ids = [m.ids(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = [m.library.decode(x.tolist()) if len(x) else "" for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(run), "doc_id bigint, ids array<int>, decoded string")

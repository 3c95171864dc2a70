"""SentencePiece encoding and decoding of take transcripts by weighted transducers.

Three parts are compiled from a model: the normaliser (dummy prefix, spaces as ``▁``), the pieces, and byte fallback
for characters without a piece. For a model of merges, weights are on pairs of neighbouring pieces: 0 if the merges
of the two pieces' text give just these two, infinite otherwise. A path through the input is then finite for exactly one
sequence, the one the merges give, and the shortest path in the tropical semiring is the encoding. As no finite path
is longer than another, the search follows the longest pieces first and stops at the first path that reaches the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm.common import others, small_batches

SPACE = "▁"
#: Distinct words whose paths a worker remembers; the memory is emptied when full.
REMEMBERED = 120_000


class Pieces:
    """The compiled transducers of one model (merges with byte fallback); one per Python worker."""

    def __init__(self, model: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.ids = {self.text[i]: i for i in range(n) if i not in special and i not in self.of_byte}
        self.score = {self.text[i]: sp.get_score(i) for i in self.ids.values()}
        self.unknown = sp.unk_id()
        self.silent = special
        self.longest = max(map(len, self.ids), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on after a space are not supported")
        self.prefix = sp.normalize("a") != "a"
        self.plain = sp.normalize("  ﬁ　é ") == self.prefix * SPACE + f"{SPACE * 2}ﬁ　é{SPACE}"
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        # How long a piece can be that begins with these one or two characters.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            for k in (1, 2):
                if len(p) >= k:
                    self.reach[p[:k]] = max(self.reach.get(p[:k], 0), len(p))
        # What a piece decodes to by itself; bytes of longer characters do not.
        self.plain_text: list[str | None] = [t.replace(SPACE, " ") for t in self.text]
        for i in range(n):
            if i in special:
                self.plain_text[i] = " ⁇ " if i == self.unknown else ""
            elif i in self.of_byte:
                self.plain_text[i] = chr(self.of_byte[i]) if self.of_byte[i] < 128 else None

    def normal(self, text: str) -> str:
        """The normaliser: as the model has it; plain ones (spaces only) without a call."""
        if not self.plain:
            return self.sp.normalize(text)
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def merged(self, text: str) -> list[str]:
        """The merges themselves on a short text: the best pair first, leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the arc from piece ``left`` to piece ``right`` has a finite weight (left -1: at a start)."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            want = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
            known = self.pairs[key] = self.merged("".join(want)) == want
        return known

    def path(self, word: str) -> list[int]:
        """Shortest path over one word, whose inner boundaries no piece crosses."""
        ids, reach, pairs = self.ids, self.reach, self.pairs
        out: list[int] = []
        at, n = 0, len(word)
        left = -1  # the piece before
        trail: list[tuple[int, int, int]] = []  # start, length and number of the pieces of the run so far
        dead: set[tuple[int, int]] = set()
        length = -1
        while at < n:
            if length < 0:
                most = reach.get(word[at : at + 2]) or reach.get(word[at], 0)
                length = min(most, n - at)
                if not most or word[at] not in ids:
                    out += [i for _, _, i in trail]
                    raw = word[at].encode("utf-8", "surrogatepass")
                    out += [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown]
                    at += 1
                    trail, left, length = [], -1, -1
                    dead.clear()
                    continue
            while length > 0:
                piece = ids.get(word[at : at + length])
                if piece is not None:
                    fits = pairs.get(left << 32 | piece)
                    if fits is None:
                        fits = self.follows(left, piece)
                    if fits and not (dead and (at + length, piece) in dead):
                        break
                length -= 1
            if length > 0:
                trail.append((at, length, piece))
                at, left, length = at + length, piece, -1
            elif trail:  # no finite path goes on from here: back by one piece
                dead.add((at, left))
                at, length, _ = trail.pop()
                length -= 1
                left = trail[-1][2] if trail else -1
            else:
                raise ValueError(f"no path over {word[:40]!r}")
        return out + [i for _, _, i in trail]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not (self.plain and self.prefix):
            out: list[int] = []
            for part in split_words(self.normal(text)):
                out += self._known(part, part)
            return out
        # Every word but those after several spaces has one space mark before it.
        words, out, marks = self.words, [], 0
        for part in text.replace(SPACE, " ").split(" "):
            marks += 1
            if not part:
                continue
            if marks == 1:
                got = words.get(part)
                out += self._known(part, SPACE + part) if got is None else got
            else:
                out += self.path(SPACE * marks + part)
            marks = 0
        if marks:
            out += self.path(SPACE * marks)
        return out

    def _known(self, key: str, part: str) -> list[int]:
        got = self.words.get(key)
        if got is None:
            got = self.path(part)
            if len(part) <= 64:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[key] = got
        return got

    def decode(self, ids: list[int]) -> str:
        plain = self.plain_text
        try:
            text = "".join([plain[i] for i in ids])
        except TypeError:  # bytes of longer characters
            parts = [bytes([self.of_byte[i]]) if i in self.of_byte else plain[i].encode("utf-8", "surrogatepass") for i in ids]
            text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def split_words(text: str) -> Iterator[str]:
    """Cut before each space mark that follows something else: no piece crosses such a place."""
    parts = text.split(SPACE)
    if parts[0]:
        yield parts[0]
    marks = 0
    for part in parts[1:]:
        marks += 1
        if part:
            yield SPACE * marks + part
            marks = 0
    if marks:
        yield SPACE * marks


@lru_cache(maxsize=4)
def compiled(model: str) -> Pieces:
    return Pieces(model)


def encode_takes(takes: DataFrame, model: str) -> DataFrame:
    """``takes`` with ``piece_ids`` (array<int>) and ``n_pieces`` of each whole text.

    ``takes``: text and any further columns, which pass through (unless named like a result). ``model``: path of a
    SentencePiece file that every executor can read. Null and empty texts have no pieces. Control pieces spelled out
    in a text are ordinary text.
    """
    made = ["piece_ids", "n_pieces"]

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = compiled(model)
        for texts in batches:
            yield pd.Series([pieces.encode(t) for t in texts], dtype=object)

    out = small_batches(takes).select("text", *others(takes, ["text"], made), encoded("text").alias("piece_ids"))
    return out.withColumn("n_pieces", F.size("piece_ids").cast("bigint"))


def decode_takes(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (piece_ids and any further columns) with ``decoded``, the text behind the pieces; null ids give ''.

    Ids outside the model raise an error; bytes that are no UTF-8 become U+FFFD.
    """

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = compiled(model)
        for rows in batches:
            yield pd.Series([pieces.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return small_batches(encoded).select("piece_ids", *others(encoded, ["piece_ids"], ["decoded"]), decoded("piece_ids").alias("decoded"))

"""Packing token ids of takes into rows of one length: best-fit-decreasing, nothing cut away.

Takes longer than a row are split into full rows and a rest. Per shard (a bounded stretch of a partition) the pieces
go, longest first, into the open row whose room fits best; a segment tree over the possible rooms finds it. What comes
out per row are its ids, the cumulative lengths of its segments and positions that start anew with every segment.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm.common import small_batches

#: Tokens packed together in one go; bounds a task's memory whatever its partition holds.
SHARD_TOKENS = 4_000_000


class Rooms:
    """Segment tree over room sizes 0..length: how many open rows have each room, smallest room of at least a size."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = room + self.leaves
        while at:
            self.open[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, its room) of the best fit, removed; of equal rooms the row opened last."""
        at = size + self.leaves
        if not self.open[at]:
            # Up until a right sibling has open rows, then down to its leftmost.
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            self.open[at] -= 1
            at >>= 1
        return row, room


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece positions, best-fit-decreasing; ``sizes`` between 1 and ``length``, ties in their order."""
    rooms, rows = Rooms(length), []
    for piece in np.argsort(-sizes, kind="stable"):
        size = int(sizes[piece])
        found = rooms.take(size)
        if found is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append(int(piece))
        rooms.add(room - size, row)
    return rows


# Fixed value: how byte-pair vocabularies of this kind cut a text before merging.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _byte_pairs(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("takes", pat_str=PRE_SPLIT, mergeable_ranks=merges, special_tokens={})


def byte_pair_ids(ranks: str) -> Callable[[], Callable[[list[str]], list]]:
    """Makes, in a task, the byte-pair encoding of texts; ``ranks``: a file of tokens and ranks that every executor can read."""

    def start():
        encoding = _byte_pairs(ranks)
        return lambda texts: map(encoding.encode_ordinary, texts)

    return start


PACKED = "row_no bigint, token_ids array<int>, cu_lens array<int>, positions binary, take_ids array<bigint>, starts array<bigint>"


def pack_takes(tokens: DataFrame, length: int = 2048, ids_of: Callable[[], Callable[[list[str]], list]] | None = None) -> DataFrame:
    """Packed rows of the ``token_ids`` (array<int>) of every take.

    With ``ids_of`` the takes have ``text`` instead: it makes, once per task, a function from texts to their ids, so that ids
    are packed in the task that makes them and never travel. Null texts have no ids.

    Returns ``row_no``; ``token_ids`` with at most ``length`` ids, not padded; ``cu_lens``, the cumulative segment lengths from
    0; ``positions``, as little-endian int32 bytes, 0, 1, … anew in each segment; ``take_ids`` and ``starts``, each segment's take and its first
    token's place there, by which :func:`unpacked` gives every take back. ``tokens``: take_id, token_ids; extra columns
    are ignored. Takes with null or no ids need no room and are in no row; null ids inside an array are an error. Null
    take_ids are packed as they are. Repeated rows are packed each. Rows keep the tokens of one partition together, so nothing
    is shuffled; numbers are unique, not consecutive.
    """
    if length < 1:
        raise ValueError("a row holds at least one token")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        ids: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0
        encode = ids_of() if ids_of else None
        for batch in batches:
            tokens_of = batch["token_ids"] if encode is None else encode([t or "" for t in batch["text"]])
            for take_id, token_ids in zip(batch["take_id"], tokens_of):
                if token_ids is None or len(token_ids) == 0:
                    continue
                ids.append(None if pd.isna(take_id) else int(take_id))
                arrays.append(np.array(token_ids, np.int32))
                held += len(arrays[-1])
                if held >= SHARD_TOKENS:
                    yield from rows_of(ids, arrays, number)
                    number += 1 << 24
                    ids, arrays, held = [], [], 0
        if arrays:
            yield from rows_of(ids, arrays, number)

    def rows_of(ids, arrays, number) -> Iterator[pd.DataFrame]:
        piece_of, start_of, sizes = [], [], []
        for k, array in enumerate(arrays):
            for start in range(0, len(array), length):
                piece_of.append(k)
                start_of.append(start)
                sizes.append(min(length, len(array) - start))
        sizes, steps = np.array(sizes), np.arange(length)
        rows = best_fit(sizes, length)
        for at in range(0, len(rows), 512):
            out = []
            for k, row in enumerate(rows[at : at + 512], at):
                parts = [arrays[piece_of[p]][start_of[p] : start_of[p] + sizes[p]] for p in row]
                lens = sizes[row]
                ends = np.cumsum(lens)
                # Positions run on from 0 and fall back by what lies before each segment.
                positions = steps[: ends[-1]] - np.repeat(ends - lens, lens) if len(row) > 1 else steps[: ends[-1]]
                out.append((
                    number + k, parts[0] if len(row) == 1 else np.concatenate(parts), np.concatenate([[0], ends]).astype(np.int32), positions.astype("<i4").tobytes(),
                    [ids[piece_of[p]] for p in row], [start_of[p] for p in row],
                ))
            yield pd.DataFrame(out, columns=["row_no", "token_ids", "cu_lens", "positions", "take_ids", "starts"])

    return small_batches(tokens).select(F.col("take_id").cast("bigint").alias("take_id"), "text" if ids_of else "token_ids").mapInPandas(pack, PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """``take_id``, ``start``, ``token_ids``: the segments of all rows, from which takes are joined together again."""
    number = F.sequence(F.lit(0), F.size("take_ids") - 1)
    segment = F.transform(number, lambda k: F.struct(
        F.get("take_ids", k).alias("take_id"), F.get("starts", k).alias("start"),
        F.slice("token_ids", F.get("cu_lens", k) + 1, F.get("cu_lens", k + 1) - F.get("cu_lens", k)).alias("token_ids"),
    ))
    return packed.select(F.explode(segment).alias("s")).select("s.*")


def id_matrices(packed: DataFrame, length: int = 2048, pad_id: int = 0, rows: int = 1024) -> DataFrame:
    """``first_row``, ``n_rows``, ``ids`` (binary): padded matrices of ``rows`` by ``length`` little-endian int32, with
    ``cu_lens`` and ``row_nos`` of their rows; what a training reader maps into memory."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def flush() -> pd.DataFrame:
            matrix = np.full((len(held), length), pad_id, "<i4")
            for k, row in enumerate(held):
                matrix[k, : len(row.token_ids)] = row.token_ids
            return pd.DataFrame({
                "first_row": [held[0].row_no], "n_rows": [len(held)], "ids": [matrix.tobytes()],
                "cu_lens": [[list(map(int, r.cu_lens)) for r in held]], "row_nos": [[r.row_no for r in held]],
            })

        for batch in batches:
            for row in batch.itertuples(index=False):
                held.append(row)
                if len(held) == rows:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return packed.select("row_no", "token_ids", "cu_lens").mapInPandas(matrices, "first_row bigint, n_rows int, ids binary, cu_lens array<array<int>>, row_nos array<bigint>")


def write_matrices(packed: DataFrame, path: str, length: int = 2048, pad_id: int = 0) -> None:
    """Write :func:`id_matrices` as Parquet, one file per task, into a folder that all executors share."""
    id_matrices(packed, length, pad_id).write.parquet(path)

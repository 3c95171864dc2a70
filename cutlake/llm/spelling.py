"""Spelling variants among the words of take transcripts: which word a rarer word is most likely meant to be.

A word's letters, each with the number of its earlier occurrences, are the set bits of a binary vector. Words that
one inserted, deleted or replaced letter sets apart differ in at most two bits, so the vectors are partitioned into
parts and every choice of all parts but two is enumerated: near words agree on the letters of one choice at least
(PartEnum signatures). An edit also leaves the first or the second half of the shorter word as it is, so a
signature carries that half; words meet by equi-join on signatures and are verified by their edit distance.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.functions.staging import settle
from cutlake.llm.common import small_batches

#: A word of a transcript: Latin letters and their accented forms.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words a task counts before it passes its counts on, and words it signs at once.
HELD, SIGNED = 200_000, 5_000
#: Parts of the vectors at first, and for words of signatures that more than CROWD words share.
PARTS, CROWD = (4, 8, 16), 4096
MISSED = 2


def slipped(word: str, start: int, every: int) -> str:
    """``word`` without one letter if its checksum, begun with ``start``, is a multiple of ``every``."""
    h = zlib.crc32(word.encode("utf-8"), start)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def take_words(takes: DataFrame, least_count: int = 3, least_length: int = 5, slip_every: int | None = None) -> DataFrame:
    """The words of all whole transcripts with their occurrences: word, n.

    ``takes``: take_id, text; further columns are not read. Words are runs of Latin letters, A-Z in lower case, of
    ``least_length`` code points or more and at least ``least_count`` occurrences. Null and empty texts have none,
    repeated rows count again, no takes give no words. ``slip_every`` plants slips for measuring: about one in so many
    words of a take loses a letter, chosen by the checksum of ``take_id:word`` (a null take_id counts as '').
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for take_id, text in zip(batch["take_id"], batch["text"]):
                # bytes.lower() changes A-Z only.
                words = RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if slip_every:
                    start = zlib.crc32(f"{take_id}:".encode())
                    for word, n in Counter(words).items():
                        held[slipped(word, start, slip_every)] += n
                else:
                    held.update(words)
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    rows = small_batches(takes).select(F.coalesce(F.col("take_id").cast("string"), F.lit("")).alias("take_id"), "text")
    counted = rows.mapInPandas(run, "word string, n bigint").where(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def signatures(words: list[str], parts: int, rank: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the word, side, key) of every signature. Side 0 is for partners at least as long, side 1 for shorter ones.

    ``rank`` numbers letters by frequency; letters are dealt to parts in that order, so that parts are about equally full.
    """
    sums = np.zeros((len(words), parts), np.uint64)
    code: dict[tuple[str, int], tuple[int, int]] = {}
    with np.errstate(over="ignore"):
        for i, word in enumerate(words):
            own: list[int] = [0] * parts
            seen: dict[str, int] = {}
            for letter in word:
                k = seen[letter] = seen.get(letter, -1) + 1
                at = code.get((letter, k))
                if at is None:
                    at = code[letter, k] = ((rank.get(letter, 0) + k) % parts, xxhash.xxh64_intdigest(f"{letter}{k}"))
                own[at[0]] += at[1]
            sums[i] = [s & 0xFFFFFFFFFFFFFFFF for s in own]
        halves = []
        for side in (0, 1):
            for suffix in (0, 1):
                keys = []
                for word in words:
                    size = len(word) - side  # of the shorter word
                    half = size // 2
                    keys.append(xxhash.xxh64_intdigest(f"{size}{suffix}{word[len(word) - (size - half):] if suffix else word[:half]}"))
                halves.append((side, np.array(keys, np.uint64)))
        places, sides, out = [], [], []
        for number, chosen in enumerate(itertools.combinations(range(parts), parts - MISSED)):
            mixed = np.full(len(words), number, np.uint64)
            for part in chosen:
                mixed = (mixed ^ sums[:, part]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            for side, half in halves:
                places.append(np.arange(len(words)))
                sides.append(np.full(len(words), side, np.int8))
                out.append((mixed ^ half) * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(places), np.concatenate(sides), np.concatenate(out).view(np.int64)


def _signer(parts: int, rank: dict[str, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SIGNED):
                words = batch["word"].iloc[at : at + SIGNED].to_numpy()
                place, side, key = signatures(words.tolist(), parts, rank)
                yield pd.DataFrame({"key": key, "side": side, "word": words[place]})

    return run


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of different words (``word``, ``other``, both orders) that one inserted, deleted or replaced code point sets apart.

    ``words``: distinct, not null ``word`` s. Words of a signature that more than CROWD words share do not meet there:
    all such words are signed again with finer parts, where each of their pairs meets as well, the last time whatever
    the size. Words made of the same letters share signatures but are never near, so they only cost comparisons.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    # One row per letter of RUN, fewer than 120.
    rank = {r.letter: i for i, r in enumerate(letters.orderBy(F.desc("n"), "letter").collect())}
    found, left = None, words.select("word")
    for parts in PARTS:
        last = parts == PARTS[-1]
        signed = settle(left.mapInPandas(_signer(parts, rank), "key bigint, side tinyint, word string"))
        if not last:
            crowded = settle(signed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"))
            last = crowded.isEmpty()
        meeting = signed if last else signed.join(crowded, "key", "left_anti")
        a, b = meeting.where("side = 0").select("key", "word"), meeting.select("key", "side", F.col("word").alias("other"))
        near = a.join(b, "key").where((F.col("side") == 1) | (F.col("word") < F.col("other")))
        near = near.where(F.levenshtein("word", "other", 1) == 1).select("word", "other")
        found = near if found is None else found.unionByName(near)
        if last:
            break
        left = settle(signed.join(crowded, "key", "left_semi").select("word").distinct())
    found = settle(found.distinct())
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Every word with the form it is a variant of: word, n, n_near, form, form_n, root.

    ``words``: word, n (see :func:`take_words`), each word once; null words are left out. ``n_near`` counts the words
    that one code point sets apart. ``form`` is the near word with the largest n, ties the first in code-point order, if
    that is at least ``ratio`` (2 or more) times the word's own n, else null; ``form_n`` its n. ``root`` is where the
    forms lead to, the word itself if it has none: every step at least doubles n, so there are no circles and the rounds of pointer
    doubling grow with the logarithm of a chain that is itself a logarithm of the largest n. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains may not end")
    words = settle(words.where(F.col("word").isNotNull()).select("word", "n"))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # A frequent word has as many near words as its length and the alphabet allow.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    near = near_words(words).join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
    )
    formed = settle(formed)
    steps = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = settle(steps.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        steps = moved.select("word", "root")
        if moved.where("__moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

"""Near-duplicate takes by SimHash: a self-join of a binary trie over the fingerprints.

Two fingerprints within ``MAX_BITS`` bits agree exactly on one of three blocks of their bits (pigeonhole), so three
tries are kept, each with another block on top; below a shared block, node pairs are walked down together, the bits
in which they differ are added up, and a pair of nodes goes as soon as it exceeds the budget. Nodes with many
fingerprints are opened in Spark, eight bits at a time, into pairs of their children; what is small enough is walked
inside tasks. Copies share a fingerprint and are one leaf, so a group of copies never makes pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType, LongType, StructType

from cutlake.functions.staging import settle
from cutlake.llm.common import others, small_batches
from cutlake.llm.windows import node_of, tokens_of, words_of

#: Bits of the topmost block that a node pair must share; the tries start at these bits.
TOP, STARTS = 21, (0, 22, 43)
#: Fingerprints below one pair of nodes that a task walks; larger pairs are opened further in Spark.
WALK = 1024
STEP = 8


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint (as signed) of the word shingles of ``text``, A-Z in lower case; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint(shingle: int):
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return of


def _turned(value: Column, by: int) -> Column:
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value


def _masks(bits: int, budget: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= budget]


def trie_links(values: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (``a``, ``b``) that connect distinct ``value`` s (bigint) within ``max_bits`` (at most 2) differing bits.

    Not every pair comes out: inside a task, values that hang together are linked to their smallest one only, which
    keeps every connected group whole. Null values take no part; an empty table has no links.
    """
    if not 0 <= max_bits <= len(STARTS) - 1:
        raise ValueError("three tries find at most two differing bits")
    distinct = values.where(F.col("value").isNotNull()).select("value").distinct()
    tops = F.array(*[F.struct(F.lit(t).alias("trie"), _turned(F.col("value"), s).alias("bits")) for t, s in enumerate(STARTS)])
    members = distinct.select(F.explode(tops).alias("r")).select("r.trie", "r.bits")
    top = F.shiftrightunsigned(F.col("bits"), 64 - TOP)
    members = settle(members.select("trie", top.alias("a"), top.alias("b"), F.lit(0).alias("side"), "bits"))
    depth, links = TOP, None
    pair = ["trie", "a", "b"]
    while True:
        sizes = members.groupBy(*pair).agg(F.count("*").alias("n"), F.sum("side").alias("n1"))
        sizes = sizes.where(F.when(F.col("a") == F.col("b"), F.col("n") > 1).otherwise((F.col("n1") > 0) & (F.col("n1") < F.col("n"))))
        sizes = settle(sizes)
        small = members.join(sizes.where(F.col("n") <= WALK), pair, "left_semi")
        found = _walk(small, depth, max_bits)
        links = found if links is None else links.unionByName(found)
        large = sizes.where(F.col("n") > WALK)
        if depth >= 64 or large.isEmpty():
            return links
        members = settle(_open(members.join(large, pair, "left_semi"), depth, max_bits))
        depth = min(64, depth + STEP)


def _open(members: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """The members of large node pairs, dealt to the pairs of their nodes' children within the budget."""
    step = min(STEP, 64 - depth)
    child = F.shiftrightunsigned(F.col("bits"), 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1)).cast("bigint")
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    masks = F.lit(None).cast("array<bigint>")
    for e in range(max_bits + 1):
        masks = F.when(spent == e, F.array(*[F.lit(m).cast("bigint") for m in _masks(step, max_bits - e)])).otherwise(masks)
    rows = members.select("*", child.alias("c"), F.explode(masks).alias("m"))
    mate = F.col("c").bitwiseXOR(F.col("m"))
    alone = F.col("a") == F.col("b")
    first = F.when(alone, F.least("c", mate)).when(F.col("side") == 0, F.col("c")).otherwise(mate)
    second = F.when(alone, F.greatest("c", mate)).when(F.col("side") == 0, mate).otherwise(F.col("c"))
    side = F.when(alone, (F.col("c") > mate).cast("int")).otherwise(F.col("side"))
    down = lambda node, c: F.shiftleft(F.col(node), step).bitwiseOR(c)
    return rows.select("trie", down("a", first).alias("a"), down("b", second).alias("b"), side.alias("side"), "bits")


def _walk(members: DataFrame, depth: int, max_bits: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(batch) == 0:
                continue
            key = batch[["trie", "a", "b"]].to_numpy()
            last = len(batch) - 1
            cut = int(np.argmax((key == key[last]).all(axis=1)))  # the last pair may go on in the next batch
            rest = batch.iloc[cut:]
            yield from _slices(batch.iloc[:cut], depth, max_bits)
        if rest is not None and len(rest):
            yield from _slices(rest, depth, max_bits)

    keys = ["trie", "a", "b"]
    ordered = members.select(*keys, "side", "bits").repartition(*keys).sortWithinPartitions(*keys, "side", "bits")
    return ordered.mapInPandas(run, "a bigint, b bigint")


def _slices(rows: pd.DataFrame, depth: int, max_bits: int) -> Iterator[pd.DataFrame]:
    """Walk whole node pairs, a few thousand fingerprints at a time so that the open pairs stay bounded."""
    if len(rows) < 2:
        return
    trie, a, b, side = (rows[c].to_numpy() for c in ("trie", "a", "b", "side"))
    new = np.flatnonzero(np.r_[True, (trie[1:] != trie[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    ends = np.r_[new[1:], len(rows)]
    load = np.cumsum((ends - new) ** 2)
    bits = rows["bits"].to_numpy().view(np.uint64)
    lo = 0
    while lo < len(new):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + (1 << 21), side="right")))
        s, e = new[lo], ends[hi - 1]
        i, j = walk_pairs(bits[s:e], side[s:e], new[lo:hi] - s, ends[lo:hi] - s, a[new[lo:hi]], b[new[lo:hi]], depth, max_bits)
        if len(i):
            value = turn_back(bits[s:e], trie[s:e])
            yield spanning(value[i], value[j])
        lo = hi


def turn_back(bits: np.ndarray, trie: np.ndarray) -> np.ndarray:
    """The fingerprints (signed) behind the turned ones."""
    by = np.array(STARTS, np.uint64)[trie]
    back = np.where(by == 0, bits, (bits >> by) | (bits << ((np.uint64(64) - by) % np.uint64(64))))
    return back.view(np.int64)


def walk_pairs(bits, side, starts, ends, a, b, depth: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the budget, over node pairs [start, end) whose members are sorted by side, then bits.

    The open node pairs are arrays of ranges; one level of the trie is one pass over them.
    """
    ones = np.concatenate([[0], np.cumsum(side)])
    middle = ends - (ones[ends] - ones[starts])
    same = a == b
    al, ah = starts, np.where(same, ends, middle)
    bl, bh = np.where(same, starts, middle), ends
    spent = np.bitwise_count((a ^ b).astype(np.uint64)).astype(np.int64)
    out_i, out_j = [], []
    for level in range(depth, 65):
        self_pair = al == bl
        keep = ~(self_pair & (ah - al < 2)) & (ah > al) & (bh > bl) & (spent <= max_bits)
        leaf = keep & ~self_pair & (((ah - al) == 1) & ((bh - bl) == 1) | (level == 64))
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
            out_i.append(i[near])
            out_j.append(j[near])
        keep &= ~leaf
        if level == 64 or not keep.any():
            break
        al, ah, bl, bh, spent, self_pair = (x[keep] for x in (al, ah, bl, bh, spent, self_pair))
        set_here = np.concatenate([[0], np.cumsum(((bits >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64))])
        am, bm = ah - (set_here[ah] - set_here[al]), bh - (set_here[bh] - set_here[bl])
        cross = ~self_pair
        al, ah, bl, bh, spent = (
            np.concatenate(x)
            for x in (
                (al, am, al, am[cross]), (am, ah, am, ah[cross]),
                (bl, bm, bm, bl[cross]), (bm, bh, bh, bm[cross]),
                (spent, spent, spent + 1, spent[cross] + 1),
            )
        )
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def spanning(left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """The same connected groups with one link per value, to the smallest value of its group."""
    values, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = at[: len(left)], at[len(left) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(values))
    return pd.DataFrame({"a": values[linked], "b": values[label[linked]]})


def connected(links: DataFrame) -> DataFrame:
    """``value`` → ``root`` (the smallest value of its group) for every value of the links (``a``, ``b``).

    Rounds of large and small stars: each value passes its neighbours to the smallest it knows, until nothing
    changes; rounds grow with the logarithm of the longest chain. Every round is a written table.
    """
    edges = settle(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: larger neighbours of each value go to the smallest value around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # Small star: smaller neighbours of each value go to the smallest of them, and so does the value.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("value")).distinct()
    return edges.select(F.col("a").alias("value"), F.col("b").alias("root")).unionByName(roots.select("value", F.col("value").alias("root")))


def _grouped(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each distinct fingerprint (``value``) with the smallest take_id that has it and the ``root`` of its group."""
    nodes = settle(prints.groupBy(F.col("fingerprint").alias("value")).agg(F.min("take_id").alias("first_id")))
    roots = connected(links_of(nodes))
    return settle(nodes.join(roots, "value", "left").select("value", "first_id", F.coalesce("root", "value").alias("root")))


def near_takes(takes: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Every take's ``fingerprint`` (bigint) and ``component_id``, the smallest take_id reachable over near takes.

    ``takes``: take_id, text, and any further columns, which pass through (unless named like a result); texts are not
    returned. Takes are near if the SimHash of their word shingles differs in at most ``max_bits`` bits. Null and
    empty texts have fingerprint 0 and are near each other. Repeated rows come out each, in one group. A null take_id
    takes part but names no group; a group of null ids only has a null ``component_id``. No takes: no rows.
    """
    made = ["fingerprint", "component_id"]
    rest = others(takes, ["take_id", "text"], made)
    rows = settle(small_batches(takes).select("take_id", *rest, _fingerprint(shingle)("text").alias("fingerprint")))
    grouped = _grouped(rows, lambda nodes: trie_links(nodes, max_bits))
    firsts = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_value = grouped.join(firsts, "root").select(F.col("value").alias("fingerprint"), "component_id")
    return rows.join(of_value, "fingerprint").select("take_id", *rest, *made)


def first_takes(takes: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The takes without near duplicates: of each group (see :func:`near_takes`) the row with the smallest take_id.

    Null ids come after all others. Of rows that repeat the id and the fingerprint, the one with the smallest text
    stays. Further columns pass through.
    """
    rest = others(takes, ["take_id", "text"], ["fingerprint"])
    rows = settle(small_batches(takes).select("take_id", "text", *rest, _fingerprint(shingle)("text").alias("fingerprint")))
    return _first_rows(rows, rest, _grouped(rows, lambda nodes: trie_links(nodes, max_bits)))


def _first_rows(rows: DataFrame, rest: list[str], grouped: DataFrame) -> DataFrame:
    first = F.struct(F.col("first_id"), F.col("value"))
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("value"))
    kept = grouped.groupBy("root").agg(F.min_by(first, order).alias("f"))
    # The join and the grouping after it share one shuffle of the texts.
    key = lambda take_id: _key_of(take_id).alias("__key")
    kept = kept.select(key("f.first_id"), F.col("f.value").alias("fingerprint"))
    row = F.struct("text", *rest)
    same = ["__key", "fingerprint"]
    keyed = rows.select("*", key("take_id")).join(kept, same, "left_semi")
    one = keyed.groupBy(*same).agg(F.first("take_id").alias("take_id"), F.min_by(row, F.struct(F.col("text").isNull(), F.col("text"))).alias("r"))
    return one.select("take_id", "r.*")


#: Min-hashes of a text, and of one band: two texts of Jaccard similarity 0.8 share a band of four with probability 0.9998.
HASHES, BAND = 64, 4
BANDS = HASHES // BAND
#: Texts of a key that all meet each other on their texts, and texts of a tile of a crowded key, whose sketches meet first.
FEW, TILE = 8, 512
#: Of a text of a crowded key, so many others are looked at before all that are left.
MOST = 2
#: Texts of a block; where pairs are many, the texts of two blocks travel once for all their pairs.
BLOCK = 32
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (HASHES, 1), dtype=np.uint64)
SKETCH = StructType().add("fingerprint", LongType()).add("sketch", BinaryType())


def shingles_of(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, in order; of all words where there are fewer."""
    words = words_of(text)
    return np.unique(tokens_of(words, min(shingle, len(words)) or 1))


def sketch_of(shingles: np.ndarray) -> bytes:
    """16 bits of each min-hash of a set; nothing for an empty one."""
    if not len(shingles):
        return b""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = (shingles[None, at : at + 4096] ^ _SEEDS) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * (_SEEDS | np.uint64(1))
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    # The lowest min-hashes have zeros on top: the bits are mixed once more.
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2").tobytes()


def _sketch(shingle: int):
    @F.pandas_udf(SKETCH)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(node_of(words_of(t))[0], sketch_of(shingles_of(t, shingle))) for t in texts]
            yield pd.DataFrame(rows, columns=["fingerprint", "sketch"])

    return of


def band_keys() -> Column:
    """One key for each band of ``sketch``."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 2 * BAND * k + 1, 2 * BAND)) for k in range(BANDS)])


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, its = None, None
        for batch in batches:
            near = []
            for b, text, other in batch[["b", "text", "other_text"]].itertuples(index=False):
                if b != last:
                    last, its = b, shingles_of(other, shingle)
                mine = shingles_of(text, shingle)
                both = len(np.intersect1d(mine, its, assume_unique=True))
                near.append(both >= similarity * (len(mine) + len(its) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "near": near})

    return run


def _key_of(take_id: str) -> Column:
    """One key for ids and null alike."""
    return F.coalesce(F.concat(F.lit("="), F.col(take_id).cast("string")), F.lit("null"))


def similar_links(rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints of texts whose shingle sets have at least this Jaccard similarity.

    ``rows``: take_id, fingerprint (equal for texts equal word by word), sketch, text; ``nodes``: each fingerprint as value with its
    first_id. Up to ``FEW`` texts of a band's key meet each other, more of them the first one. Texts of a crowded key that these links do
    not connect all meet by their sketches: first each the ``MOST`` alike of other groups, then whoever is still in another group.
    Sketches only name the pairs: every one is confirmed on its texts, which are fetched for these pairs alone.
    """
    sketches = rows.groupBy(F.col("fingerprint").alias("a")).agg(F.first("sketch").alias("sketch")).where(F.length("sketch") > 0)
    sketches = settle(sketches)
    keyed = sketches.select("a", F.explode(band_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = settle(keyed.join(sizes, "key"))
    few = met.where(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list("a")).alias("all"))
    few = few.select("all", F.explode("all").alias("b")).select(F.explode(F.filter("all", lambda x: x > F.col("b"))).alias("a"), "b")
    crowded = met.where(F.col("n") > FEW)
    done = settle(few.unionByName(crowded.where(F.col("a") != F.col("b")).select("a", "b")).distinct())
    near = _confirmed(done, rows, nodes, shingle, similarity)
    if crowded.isEmpty():
        return near
    # Equal min-hashes of two texts just similar enough are five standard deviations above this.
    least = int(HASHES * similarity - 5 * np.sqrt(HASHES * similarity * (1 - similarity)))
    for most in (MOST, None):
        pairs = settle(_foreign(crowded, sketches, connected(near), least, most).join(done, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        near = near.unionByName(_confirmed(pairs, rows, nodes, shingle, similarity))
        done = done.unionByName(pairs)
    return near


def _foreign(crowded: DataFrame, sketches: DataFrame, roots: DataFrame, least: int, most: int | None) -> DataFrame:
    """Pairs (``a`` > ``b``) of one key in different groups whose sketches have ``least`` equal min-hashes; of a text the ``most`` alike, or all.

    A key's texts are dealt to tiles, and every two tiles meet as one row, so that no task holds more of a key than that.
    """
    members = crowded.select("key", "a", "n").join(roots.withColumnRenamed("value", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    members = settle(members)
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    members = members.join(mixed, "key").join(sketches, "a")
    tiles = F.ceil(F.col("n") / TILE)
    members = members.withColumn("tile", F.pmod(F.xxhash64("a"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
    cell = [F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")]
    cells = members.groupBy("key", *cell).agg(F.collect_list(F.struct("a", "root", "tile", "sketch")).alias("members"))
    return cells.select("i", "j", "members").mapInPandas(_alike(least, most), "a bigint, b bigint").distinct()


def _alike(least: int, most: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, members in batch[["i", "j", "members"]].itertuples(index=False):
                a, root, tile = (np.array([m[c] for m in members], np.int64) for c in ("a", "root", "tile"))
                sketch = np.frombuffer(b"".join(m["sketch"] for m in members), "<u2").reshape(-1, HASHES)
                pairs = []
                for n in range(len(a)):
                    meets = root != root[n]
                    if i != j:
                        meets &= tile != tile[n]
                    with_ = np.flatnonzero(meets if most else meets & (a < a[n]))
                    equal = (sketch[with_] == sketch[n]).sum(axis=1)
                    with_, equal = with_[equal >= least], equal[equal >= least]
                    if most:
                        with_ = with_[np.lexsort((a[with_], -equal))][:most]
                    pairs.append(np.stack([np.maximum(a[n], a[with_]), np.minimum(a[n], a[with_])], axis=1))
                yield pd.DataFrame(np.concatenate(pairs), columns=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose texts are similar: each is compared, whatever its sketches say."""
    pairs = settle(pairs)
    needed = pairs.select(F.col("a").alias("value")).unionByName(pairs.select(F.col("b").alias("value"))).distinct()
    # Of the rows of one fingerprint the first is wanted only, so copies never meet in one task.
    first = needed.join(nodes, "value").select(F.col("value").alias("fingerprint"), _key_of("first_id").alias("__key"))
    texts = rows.select("fingerprint", _key_of("take_id").alias("__key"), "text").join(first, ["fingerprint", "__key"], "left_semi")
    texts = settle(texts.groupBy(F.col("fingerprint").alias("a")).agg(F.first("text").alias("text")))
    n_texts = texts.count()
    if pairs.count() > BLOCK * n_texts:
        return settle(_in_blocks(pairs, texts, -(-n_texts // BLOCK)).mapInPandas(_similar_in_blocks(shingle, similarity), "a bigint, b bigint"))
    there = texts.select(F.col("a").alias("b"), F.col("text").alias("other_text"))
    read = pairs.select("a", "b").join(texts, "a").join(there, "b").select("a", "b", "text", "other_text").mapInPandas(_similar(shingle, similarity), "a bigint, b bigint, near boolean")
    return settle(read.where("near").select("a", "b"))


def _in_blocks(pairs: DataFrame, texts: DataFrame, blocks: int) -> DataFrame:
    """One row for every two blocks that have pairs: these (``pairs``), and the texts they need (``texts``)."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    met = pairs.select("a", "b", F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"))
    grouped = met.groupBy("i", "j").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    needed = met.select("i", "j", F.explode(F.array("a", "b")).alias("a")).distinct().join(texts, "a")
    return grouped.join(needed.groupBy("i", "j").agg(F.collect_list(F.struct("a", "text")).alias("texts")), ["i", "j"])


def _similar_in_blocks(shingle: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pairs, texts in batch[["pairs", "texts"]].itertuples(index=False):
                sets, near = {t["a"]: shingles_of(t["text"], shingle) for t in texts}, []
                for a, b in ((p["a"], p["b"]) for p in pairs):
                    mine, its = sets[a], sets[b]
                    # Sets of too different sizes can't be similar.
                    if min(len(mine), len(its)) < similarity * max(len(mine), len(its)):
                        continue
                    both = len(np.intersect1d(mine, its, assume_unique=True))
                    if both >= similarity * (len(mine) + len(its) - both):
                        near.append((a, b))
                yield pd.DataFrame(near, columns=["a", "b"])

    return run


def first_similar_takes(takes: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The takes without near duplicates: of each group the row with the smallest take_id, as :func:`first_takes`.

    Takes are near if their sets of ``shingle``-word shingles (A-Z in lower case) have at least this Jaccard ``similarity``; groups are
    connected over near takes. Null and empty texts are near each other; a take_id may be null or repeated, further columns pass
    through (unless named like a result), and no takes give no rows.
    """
    rest = others(takes, ["take_id", "text"], ["fingerprint", "sketch"])
    rows = small_batches(takes).select("take_id", "text", *rest, _sketch(shingle)("text").alias("__s"))
    rows = settle(rows.select("take_id", "text", *rest, "__s.fingerprint", "__s.sketch"))
    grouped = _grouped(rows, lambda nodes: similar_links(rows, nodes, shingle, similarity))
    return _first_rows(rows.drop("sketch"), rest, grouped)

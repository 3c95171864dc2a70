"""Which wording sets a source of takes apart: term frequencies of each source against the other sources of its language.

Terms are counted as 64-bit digests. Counting passes shuffle digests and numbers only; the smallest and the largest
string behind each kept digest show whether two terms share it, and such digests are split by the strings and
counted again. The text of a term is joined back to the few rows that are returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.staging import settle
from cutlake.llm.common import SMALL_ROWS, attach, small_batches

#: Added counts, the unit of p, and the pseudo-count's weight: p = 1 + UNIT * (count + PRIOR) // (N + PRIOR * V).
PRIOR, UNIT = 2, 1_000_000_000
#: Terms a task holds before it passes its counts on, and pairs of sources it scores at once.
HELD, PAIRS = 500_000, 1 << 20
#: Rows of terms a task scores together, besides those of one term.
ROWS, TERM = 200_000, ["lang_no", "digest", "variant"]
#: Up to so many kept digests (16 bytes each) are broadcast to the counting tasks, beyond it they meet by shuffle.
SMALL_DIGESTS = 2_000_000
#: A term is a run of ASCII letters and of anything beyond ASCII; A-Z count as a-z, all other bytes separate.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def digests_of(terms: list[bytes], bits: int = 64) -> np.ndarray:
    found = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
    return (found >> np.uint64(64 - bits)).view(np.int64)


def _counted(rows: DataFrame, keys: list[str], bits: int, *wanted: str) -> DataFrame:
    """Terms per ``keys`` (integers) by digest, as far as one task has combined them, with what is ``wanted``: n, docs, term.

    ``n`` are occurrences, ``docs`` takes; ``term`` is the string itself.
    """

    def counted(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pd.DataFrame]:
        for key, (n, docs) in held.items():
            terms = list(n or docs)
            out = {k: np.full(len(terms), v, np.int64) for k, v in zip(keys, key)} | {"digest": digests_of(terms, bits)}
            for name in wanted:
                if name == "term":
                    out[name] = [t.decode("utf-8", "surrogatepass") for t in terms]
                else:
                    of = n if name == "n" else docs
                    out[name] = np.fromiter(map(of.__getitem__, terms), np.int64, len(terms))
            yield pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for batch in batches:
            of = zip(*[batch[k] for k in keys]) if keys else iter(lambda: (), None)
            for key, text in zip(of, batch["text"]):
                terms = terms_of(text)
                if not terms:
                    continue
                n, docs = held.setdefault(key, (Counter(), Counter()))
                before = len(n) or len(docs)
                if "n" in wanted:
                    n.update(terms)
                if "docs" in wanted or "n" not in wanted:
                    docs.update(set(terms))
                size += (len(n) or len(docs)) - before
                if size >= HELD:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    kind = {"n": "bigint", "docs": "bigint", "term": "string"}
    schema = ", ".join([*[f"{k} bigint" for k in keys], "digest bigint", *[f"{w} {kind[w]}" for w in wanted]])
    return small_batches(rows).select(*keys, "text").mapInPandas(run, schema)


def _among(rows: DataFrame, kept: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(kept) if few else kept, on, "left_semi")


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """p of a term: exact for any counts, as the product is taken in decimals."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, (total + PRIOR * vocabulary).cast("decimal(19,0)")).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _exact_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For two sources of a language (``a`` < ``b``): what the terms that both use add to the sum that takes each as the other's unused term."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        key = rows[TERM].to_numpy()
        cut = int(np.argmax((key == key[-1]).all(axis=1)))  # the last term may go on in the next batch
        held = [rows.iloc[cut:]]
        yield from _scored(rows.iloc[:cut])
    if held:
        yield from _scored(pd.concat(held, ignore_index=True))


def _scored(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(rows) < 2:
        return
    code, p, p0 = (rows[c].to_numpy(np.int64) for c in ("code", "p", "p0"))
    key = rows[TERM].to_numpy()
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    size = np.diff(np.r_[start, len(rows)])
    lang = key[start, 0]
    for k in np.unique(size[size > 1]):
        for lang_no in np.unique(lang[size == k]):
            places = start[(size == k) & (lang == lang_no)][:, None]
            step = max(1, PAIRS // len(places))
            for i, j in ((i, j) for i in range(k - 1) for j in range(i + 1, k, step)):
                b = (places + np.arange(j, min(k, j + step))).ravel()
                a = np.repeat(places[:, 0] + i, len(b) // len(places))
                value = _exact_distance(p[a], p[b]) - _exact_distance(p[a], p0[b]) - _exact_distance(p0[a], p[b]) + _exact_distance(p0[a], p0[b])
                pairs, at = np.unique(code[a] << 32 | code[b], return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, at, value)
                yield pd.DataFrame({"lang_no": lang_no, "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "value": total})


def source_divergence(takes: DataFrame, least_takes: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """How the wording of each source of takes differs from the other sources of its language, and by which terms.

    ``takes``: source_name, language, text; further columns, whatever their names, are not read. Null texts, languages
    and sources count as ''. A language keeps the terms (runs of ASCII letters, A-Z in lower case, and of characters
    beyond ASCII) that at least ``least_takes`` of its takes have. With V of them and N occurrences of them in a source,
    a term's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares differ by
    f = floor((p - q)^2 / (p + q)).

    Returns language, source_name, part, item, value, rank. Part ``pair``: each other source of the language as item,
    the sum of f over all kept terms as value. Part ``term``: the ``top`` kept terms that the source uses more than its
    language does, by f. Ranks follow falling values, ties the item in UTF-8 order. Repeated rows are takes of their own;
    a source without terms has its pairs; no takes, no rows. Long texts are read whole, one at a time. ``bits`` is the
    width of the digests; terms that share one are told apart by their strings, so results do not depend on it.

    The pairs of sources are the result itself, so work grows with their number times the kept terms; a term's row
    is scored against the sources that use it, all others come from the sources' histograms of shares.
    """
    rows = takes.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("language", "source_name", "text")])
    groups = settle(rows.select("language", "source_name").distinct())
    langs = groups.select("language").distinct().withColumn("lang_no", F.row_number().over(Window.orderBy("language")))
    # Sources of one language, languages of all: as many rows as the result has groups.
    code = F.row_number().over(Window.partitionBy("language").orderBy("source_name"))
    groups = settle(groups.withColumn("code", code).join(langs, "language"))

    numbered = attach(rows, groups, ["language", "source_name"], F.length("text"))
    named, counts, known = _kept_counts(numbered.select("lang_no", "code", "text"), least_takes, bits)
    counts = settle(counts)
    sums = counts.groupBy("lang_no", "code").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    stats = groups.join(sums, ["lang_no", "code"], "left").join(known, "lang_no", "left").fillna(0, ["total", "used", "vocabulary"])
    whole = F.sum("total").over(Window.partitionBy("lang_no"))
    some = F.col("vocabulary") > 0
    stats = stats.withColumns({"lang_total": whole, "p0": F.when(some, share(F.lit(0), F.col("total"), F.when(some, F.col("vocabulary"))))})
    stats = settle(stats)

    used = attach(counts, stats.select("lang_no", "code", "total", "lang_total", "vocabulary", "p0"), ["lang_no", "code"], F.col("digest"))
    used = used.select(*TERM, "code", "n", "lang_total", "vocabulary", "p0", share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"))
    # One shuffle, by term: the sum over its sources and the pairs of its sources both read it.
    used = used.repartition(*TERM).sortWithinPartitions(*TERM, "code").withColumn("lang_n", F.sum("n").over(Window.partitionBy(*TERM)))
    out = _pairs(used, stats).unionByName(_terms(used, stats, named, top))
    return out.select("language", "source_name", "part", "item", "value", "rank")


def _kept_counts(rows: DataFrame, least_takes: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of kept terms (digest, variant, term), their counts per source, and the size of each language's vocabulary."""
    docs = _counted(rows, ["lang_no"], bits, "docs").groupBy("lang_no", "digest").agg(F.sum("docs").alias("docs"))
    kept = settle(docs.where(F.col("docs") >= least_takes).select("lang_no", "digest"))
    digests = kept.select("digest").distinct()
    few = kept.count() <= SMALL_DIGESTS
    strings = _among(_counted(rows, [], bits, "term"), digests, ["digest"], few).distinct()
    names = settle(strings.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("other")))
    of_source = lambda *wanted: _among(_counted(rows, ["lang_no", "code"], bits, *wanted), kept, ["lang_no", "digest"], few)
    by = ["lang_no", "code", "digest", "variant"]
    split = names.where(F.col("term") != F.col("other")).select("digest")
    named = names.where(F.col("term") == F.col("other")).select("digest", F.lit(0).alias("variant"), "term")
    if split.isEmpty():
        kept = kept.withColumn("variant", F.lit(0))
        counts = of_source("n").withColumn("variant", F.lit(0)).groupBy(*by).agg(F.sum("n").alias("n"))
    else:
        split = settle(split)
        several = split.count() <= SMALL_ROWS
        exact = of_source("n", "docs", "term").join(F.broadcast(split) if several else split, "digest", "left_semi")
        exact = settle(exact.groupBy("lang_no", "code", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        # The strings of one digest: as many as meet in it by chance.
        number = F.row_number().over(Window.partitionBy("digest").orderBy("term"))
        apart = settle(exact.select("digest", "term").distinct().withColumn("variant", number))
        exact = exact.join(apart, ["digest", "term"])
        again = exact.groupBy("lang_no", "digest", "variant").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_takes)
        again = again.select("lang_no", "digest", "variant")
        single = of_source("n").join(F.broadcast(split) if several else split, "digest", "left_anti").withColumn("variant", F.lit(0))
        counts = single.groupBy(*by).agg(F.sum("n").alias("n"))
        counts = counts.unionByName(exact.join(again, ["lang_no", "digest", "variant"], "left_semi").select(*by, "n"))
        kept = kept.join(split, "digest", "left_anti").withColumn("variant", F.lit(0)).unionByName(again)
        named = named.unionByName(apart.select("digest", "variant", "term"))
    return named, counts, kept.groupBy("lang_no").agg(F.count("*").alias("vocabulary"))


def _pairs(used: DataFrame, stats: DataFrame) -> DataFrame:
    both = used.select("lang_no", "digest", "variant", "code", "p", "p0").mapInPandas(_shared_terms, "lang_no bigint, a bigint, b bigint, value bigint")
    both = both.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("both"))
    both = both.unionByName(both.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    # What the terms of one source give against each other source's unused term.
    shares = used.groupBy("lang_no", F.col("code").alias("a"), "p").agg(F.count("*").alias("terms"))
    other = stats.select("lang_no", F.col("code").alias("b"), F.col("p0").alias("q"))
    alone = shares.join(other, "lang_no").where(F.col("a") != F.col("b"))
    alone = settle(alone.groupBy("lang_no", "a", "b").agg(F.sum(F.col("terms") * distance(F.col("p"), F.col("q"))).alias("alone")))
    back = alone.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("back"))
    mine = stats.select("lang_no", F.col("code").alias("a"), "language", "source_name", "vocabulary", F.col("used").alias("used_a"), F.col("p0").alias("p0_a"))
    theirs = stats.select("lang_no", F.col("code").alias("b"), F.col("source_name").alias("item"), F.col("used").alias("used_b"), F.col("p0").alias("p0_b"))
    on = ["lang_no", "a", "b"]
    out = mine.join(theirs, "lang_no").where(F.col("a") != F.col("b")).join(both, on, "left").join(alone, on, "left").join(back, on, "left")
    unused = (F.col("vocabulary") - F.col("used_a") - F.col("used_b")) * distance(F.col("p0_a"), F.col("p0_b"))
    value = sum((F.coalesce(c, F.lit(0)) for c in (F.col("both"), F.col("alone"), F.col("back"))), F.coalesce(unused, F.lit(0)))
    out = out.select("language", "source_name", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))
    rank = F.row_number().over(Window.partitionBy("language", "source_name").orderBy(F.desc("value"), "item"))
    return out.withColumn("rank", rank)


def _terms(used: DataFrame, stats: DataFrame, named: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    more = used.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang_no", "code", "digest", "variant", distance(F.col("p"), F.col("q")).alias("value"))
    best = F.rank().over(Window.partitionBy("lang_no", "code").orderBy(F.desc("value")))
    first = settle(more.withColumn("__r", best).where(F.col("__r") <= top).drop("__r"))
    # Names go to the chosen terms, ties at the last rank included, so nothing but these texts moves.
    out = named.join(F.broadcast(first) if first.count() <= SMALL_ROWS else first, ["digest", "variant"])
    rank = F.row_number().over(Window.partitionBy("lang_no", "code").orderBy(F.desc("value"), "term"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= top)
    out = attach(out, stats.select("lang_no", "code", "language", "source_name"), ["lang_no", "code"], F.col("digest"))
    return out.select("language", "source_name", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

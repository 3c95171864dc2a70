"""Mixing, near takes, repeated passages, packing, search, pieces and the pipeline against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from cutlake.llm import mixing, near_takes, packing, pieces, search, windows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# ------------------------------------------------------------------ mixing


def test_mix_follows_targets_and_is_nested(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * rng.randint(0, 30))) for i in range(1500)]
    rows += [(5, "tiny", "one two"), (5, "tiny", "one two"), (None, "tiny", None)]
    takes = spark.createDataFrame(rows, "take_id bigint, source_name string, text string").selectExpr("*", "'x' as size", "2 as hash")
    out = mixing.mix_takes(takes).collect()
    assert len(out) == len(rows)
    total, by = sum(r.size for r in out), {}
    for r in out:
        s = by.setdefault(r.source_name, [0, r.source_size, r.target, 0])
        s[0] += r.size
        s[3] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(s[0] == s[1] and s[2] <= 3 * s[1] for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - total) < 1e-6 * total
    assert all(abs(s[3] - s[2]) <= 30 for s in by.values())
    assert by["tiny"][2] == 12.0  # weight 1 of 2 words: stopped at three times
    again = {(r.take_id, r.source_name, r.taken) for r in mixing.mix_takes(takes.repartition(7)).collect()}
    assert again == {(r.take_id, r.source_name, r.taken) for r in out}
    half = {(r.take_id, r.source_name): r.taken for r in mixing.mix_takes(takes, budget=0.5).collect()}
    assert all(r.taken >= half[r.take_id, r.source_name] for r in out if r.source_name != "tiny")
    assert mixing.mix_takes(takes.limit(0)).count() == 0
    assert mixing.repeated_takes(takes).count() == sum(r.taken // r.size for r in out if r.size)


def test_mix_with_given_weights(spark):
    takes = spark.createDataFrame([(i, "ab"[i % 2], "w w w") for i in range(400)], "take_id bigint, source_name string, text string")
    weights = spark.createDataFrame([("a", 1.0)], "source_name string, weight double")
    out = mixing.mix_takes(takes, weights).groupBy("source_name").sum("taken").collect()
    assert dict(map(tuple, out)) == {"a": 1200, "b": 0}


# -------------------------------------------------------------- near takes


def plain_simhash(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, bits):
    """value → smallest value reachable, all pairs compared."""
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(sorted(parent), 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in parent}


def test_fingerprints_and_groups(spark):
    rng = random.Random(4)
    base = [rng.choice(["Alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 50)) for _ in range(400)]
    rows = [(10 + i, " ".join(base[: 100 + i])) for i in range(60)] + [(1, ""), (2, None), (3, " \n"), (None, "only a"), (4, "two WORDS"), (5, "two words"), (5, "two words")]
    takes = spark.createDataFrame(rows, "take_id bigint, text string").selectExpr("*", "'y' as fingerprint", "7 as value")
    out = near_takes.near_takes(takes).collect()
    assert len(out) == len(rows) and all(r.value == 7 for r in out)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in out:
        assert r.fingerprint & (1 << 64) - 1 == plain_simhash(texts[r.take_id])
    root = groups_of({r.fingerprint for r in out}, 2)
    least = {}
    for r in out:
        if r.take_id is not None:
            least[root[r.fingerprint]] = min(r.take_id, least.get(root[r.fingerprint], r.take_id))
    assert all(r.component_id == least.get(root[r.fingerprint]) for r in out)
    kept = [r.take_id for r in near_takes.first_takes(takes).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(least.values())) and kept.count(None) == 1
    assert near_takes.near_takes(takes.limit(0)).count() == 0 and near_takes.first_takes(takes.limit(0)).count() == 0


@pytest.mark.parametrize("walk", [4, 1024])
def test_trie_links_connect_what_brute_force_connects(spark, monkeypatch, walk):
    monkeypatch.setattr(near_takes, "WALK", walk)
    rng = random.Random(6)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(8):
            v = centre
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randint(0, 63)
            values.add(v)
    values = [v - (1 << 64) if v >> 63 else v for v in values] + [0, 1, -1, None, 0]
    frame = spark.createDataFrame([(v,) for v in values], "value bigint")
    links = near_takes.trie_links(frame)
    roots = {r.value: r.root for r in near_takes.connected(links).collect()}
    want = groups_of({v for v in values if v is not None}, 2)
    alone = {v for v, r in want.items() if list(want.values()).count(r) == 1}
    assert roots == {v: r for v, r in want.items() if v not in alone}
    assert near_takes.trie_links(frame, 0).count() == 0


def test_long_chains_are_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a bigint, b bigint")
    roots = {r.value: r.root for r in near_takes.connected(links).collect()}
    assert roots == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_near_duplicates_of_the_pipeline_are_those_of_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, sets = [], {}
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(6):  # from light edits to texts that are no near copies
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 20)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text), "s"))
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(root.values()))
    assert 40 < len(set(root.values())) < len(rows) - 40


# ------------------------------------------------------- repeated passages


def test_compact_windows_cover_every_subsequence_once():
    rng = random.Random(8)
    for _ in range(60):
        values = np.array([rng.randint(0, 9) for _ in range(rng.randint(0, 40))], np.uint64)
        least = rng.randint(1, 6)
        found = windows.compact_windows(values, least)
        for i in range(len(values)):
            for j in range(i + least - 1, len(values)):
                centre = i + int(values[i : j + 1].argmin())
                assert [c for lo, c, hi in found if lo <= i <= c <= j <= hi] == [centre]


def test_planted_passages_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    passage, near = text(60), text(90)
    changed = near[:45] + [word()] + near[46:]
    rows = [
        (1, text(100) + passage + text(30)), (2, text(20) + passage + text(200)), (3, passage), (4, text(300)), (5, text(40) + near + text(10)),
        (6, changed + text(50)), (7, text(10) + passage[:30] + text(80)),
    ]
    rows = [(i, " ".join(w)) for i, w in rows] + [(8, rows[3][1] and " ".join(rows[3][1])), (9, ""), (None, None), (10, "Licensed under the MIT License.")]
    out = windows.repeated_passages(spark.createDataFrame(rows, "take_id bigint, text string").selectExpr("*", "1 as node")).collect()
    assert {r.take_id for r in out} == {1, 2, 3, 4, 5, 6, 8}
    found = {r.take_id: r for r in out}
    assert abs(found[1].first_word - 100) <= 1 and abs(found[1].n_words - 60) <= 2 and abs(found[2].first_word - 20) <= 1
    assert found[8].similarity == 1.0 and found[8].n_words == 300 and found[5].n_words >= 85
    assert windows.repeated_passages(spark.createDataFrame([], "take_id bigint, text string")).count() == 0


def planted(rng, trials, make):
    """``trials`` rows of two texts each around what ``make`` gives, and texts that hold only a part of it; ids of the pairs."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    rows, pairs = [], []
    for _ in range(trials):
        one, two, part, n = make(text, word)
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + k, " ".join(text(rng.randint(10, 60)) + own + text(rng.randint(10, 60)))) for k, own in enumerate([one, two] + [part] * n)]
    return rows, pairs


def linked(spark, rows):
    out = windows.repeated_passages(spark.createDataFrame(rows, "take_id bigint, text string")).collect()
    words = {i: t.split() for i, t in rows}
    for r in out:  # whatever is reported stands
        mine, its = words[r.take_id][r.first_word : r.first_word + r.n_words], words[r.with_take_id][r.with_first_word : r.with_first_word + r.with_n_words]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (mine, its))
        assert len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8 and len(mine) >= 50 <= len(its) and len(mine) == r.n_words
    return {(r.take_id, r.with_take_id) for r in out} | {(r.with_take_id, r.take_id) for r in out}


def test_exact_passages_behind_frequent_lines_are_found(spark):
    rng = random.Random(31)
    for length in (15, 30):

        def make(text, word):
            passage, at = text(60), rng.randint(0, 60 - length)
            return passage, passage, passage[at : at + length], 25

        rows, pairs = planted(rng, 30, make)
        assert set(pairs) <= linked(spark, rows)


@pytest.mark.parametrize("length, at", [(50, 25), (60, 20), (55, 27), (52, 3)])
def test_near_passages_at_the_threshold_are_found(spark, length, at):
    rng = random.Random(length)

    def make(text, word):
        passage = text(length)
        return passage, passage[:at] + [word()] + passage[at + 1 :], [], 0

    rows, pairs = planted(rng, 200, make)
    found = linked(spark, rows)
    assert sum(p in found for p in pairs) >= 196


def test_near_passages_behind_texts_with_a_part_of_them_are_found(spark, monkeypatch):
    rng = random.Random(57)

    def make(text, word):
        passage = text(50)
        return passage, passage[:48] + [word()] + passage[49:], passage[:40], 25

    rows, pairs = planted(rng, 12, make)
    for crowd in (64, 3):
        monkeypatch.setattr(windows, "CROWD", crowd)
        assert set(pairs) <= linked(spark, rows)


def test_covered_places_meet_the_texts_elected_later(spark):
    # The second text is similar to the first and to the third, these two are not to each other.
    rows = spark.createDataFrame([(n, 0, f"t{n}", "") for n in (10, 20, 30)], "node bigint, twin bigint, node_id string, text string")
    members = spark.createDataFrame([(n, 7, 25) for n in (10, 20, 30)], "node bigint, signature bigint, at int")

    def verify(batches):
        for batch in batches:
            yield pd.DataFrame(
                [(r.node, 0, r.other, 0, 20, 14, 20, 14, 1.0) for r in batch.itertuples() if {r.node, r.other} in ({10, 20}, {20, 30})],
                columns=["node", "twin", "other", "other_twin", "first", "words", "other_first", "other_words", "similarity"],
            )

    found = windows._by_rounds(members, rows, spark.createDataFrame([], windows.PASSAGE), verify, 5, 46, 0.8)
    assert {frozenset((r.node, r.other)) for r in found.collect()} == {frozenset((10, 20)), frozenset((20, 30))}


def test_two_passages_of_a_pair_are_both_found():
    rng = np.random.default_rng(59)
    token = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    one, two = token(60), token(60)
    shared = [token(13) for _ in range(20)]
    a, b = (np.concatenate([one, *[np.r_[token(3), s] for s in shared], token(3), two]) for _ in range(2))
    places = np.array([[-1, at, at, at] for at in (30, len(a) - 30)], np.int64)
    found = windows.common_passages(a, b, places, 46, 1, 0.8)
    assert any(s <= 30 < e for s, e, *_ in found) and any(s <= len(a) - 30 < e for s, e, *_ in found)


def test_repetitive_passages_are_found(spark):
    rng = random.Random(58)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(k, " ".join([word() for _ in range(40)] + ["buy", "it", "now"] * 20 + [word() for _ in range(30)])) for k in range(3)]
    assert len({pair for pair in linked(spark, rows) if pair[0] < pair[1]}) >= 2


# ----------------------------------------------------------------- packing


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(10)
    for _ in range(60):
        length = rng.randint(1, 40)
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(1, 60))])
        rooms, want = [], []
        for p in sorted(range(len(sizes)), key=lambda p: -sizes[p]):
            fit = [r for r in range(len(rooms)) if rooms[r] >= sizes[p]]
            if fit:
                smallest = min(rooms[r] for r in fit)
            else:
                rooms.append(length)
                smallest = length
            r = next(r for r in range(len(rooms)) if rooms[r] == smallest)
            rooms[r] -= sizes[p]
            want.append(rooms[r])
        rows = packing.best_fit(sizes, length)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
        assert all(sum(sizes[p] for p in row) <= length for row in rows)
        assert sorted(length - sum(sizes[p] for p in row) for row in rows) == sorted(rooms)


def test_packed_rows_give_every_take_back(spark):
    rng = random.Random(11)
    rows = [(i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 5, 16, 40]))]) for i in range(200)] + [(None, [1, 2]), (300, None), (301, [3] * 16), (301, [3] * 16)]
    tokens = spark.createDataFrame(rows, "take_id bigint, token_ids array<int>").selectExpr("*", "1 as starts").repartition(3)
    packed = packing.pack_takes(tokens, 16).cache()
    for r in packed.collect():
        lens = np.diff(r.cu_lens)
        assert len(r.token_ids) == r.cu_lens[-1] <= 16 and r.cu_lens[0] == 0 and len(r.take_ids) == len(lens) and (lens > 0).all()
        assert np.frombuffer(r.positions, "<i4").tolist() == [p for n in lens for p in range(n)]
    assert packed.select("row_no").distinct().count() == packed.count()
    back = {}
    for r in sorted(packing.unpacked(packed).collect(), key=lambda r: r.start):
        back.setdefault(r.take_id, []).extend(r.token_ids)
    want = {i: t for i, t in rows if t} | {301: [3] * 32}
    assert back == want
    sheets = packing.id_matrices(packed, 16, pad_id=-1).collect()
    cells = np.concatenate([np.frombuffer(s.ids, "<i4").reshape(-1, 16) for s in sheets])
    assert (cells >= 0).sum() == sum(map(len, want.values()))
    assert packing.pack_takes(tokens.limit(0)).count() == 0


# ------------------------------------------------------------------ search


def plain_top(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((max(1 - 2**63, min(2**63 - 1, -sum(int(a) * int(b) for a, b in zip(v, w)))), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("high", [3, 300, 2**31])
def test_search_is_exact(spark, high):
    rng = random.Random(12)
    rows = [(i, [float(rng.randint(-high, high)) for _ in range(20)]) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(600, [])]
    extra = [(None, [1.0]), (700, None), (701, [1.0, None])]
    vectors = spark.createDataFrame(rows + extra, "vec_id bigint, values array<double>").selectExpr("*", "1 as score").repartition(3)
    queries = vectors.where("vec_id % 50 = 0")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search.top_vectors(vectors, queries).collect())
    assert got == plain_top(rows, [(i, v) for i, v in rows if i % 50 == 0], 5)
    assert search.top_vectors(vectors.limit(0), queries.limit(0)).count() == 0
    few = search.top_vectors(vectors.where("vec_id in (1, 2)"), vectors.where("vec_id = 1")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(1, 1, 2)]


def test_scaled_vectors(spark):
    frame = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([None],), (None,), ([float("inf")],), ([],)], "v array<float>")
    assert [r[0] for r in frame.select(search.scaled("v")).collect()] == [[128.0, -1.0], None, None, None, None, []]


# ------------------------------------------------------------------ pieces


def test_paths_are_the_models_own_encoding():
    compiled = pieces.compiled(MODEL)
    rng = random.Random(13)
    vocabulary = [t.replace(pieces.SPACE, " ") for t in compiled.ids]
    for k in range(4000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))) if k % 2 else "".join(rng.choice("abcest  \n▁é世\U0001f642\x00а<>/") for _ in range(rng.randint(0, 40)))
        ids = compiled.encode(text)
        assert ids == compiled.sp.encode(text) and compiled.decode(ids) == compiled.sp.decode(ids)
    long = "ab" * 50_000 + " " * 1000 + "é" * 1000
    assert compiled.encode(long) == compiled.sp.encode(long)


def test_encoded_takes_come_back(spark):
    rows = [(1, "Two words\tand\nlines \U0001f642"), (2, ""), (3, None), (None, "<s> </s>"), (1, "x"), (1, "x")]
    takes = spark.createDataFrame(rows, "take_id bigint, text string").selectExpr("*", "'a' as n_pieces", "'b' as decoded")
    out = pieces.decode_takes(pieces.encode_takes(takes, MODEL), MODEL)
    assert all(r.decoded == (r.text or "") and r.n_pieces == len(r.piece_ids) for r in out.collect())
    assert out.count() == len(rows) and pieces.encode_takes(takes.limit(0), MODEL).count() == 0


def test_texts_are_packed_as_their_ids(spark):
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    takes = spark.createDataFrame([(1, "Two words and lines \U0001f642"), (2, ""), (3, None), (None, "<|endoftext|>"), (4, "word " * 30)], "take_id bigint, text string")
    packed = packing.pack_takes(takes, 8, packing.byte_pair_ids(ranks))
    back = {}
    for r in sorted(packing.unpacked(packed).collect(), key=lambda r: r.start):
        back.setdefault(r.take_id, []).extend(r.token_ids)
    encoding = packing._byte_pairs(ranks)
    assert {i: encoding.decode(t) for i, t in back.items()} == {r.take_id: r.text for r in takes.collect() if r.text}
    assert all(np.frombuffer(r.positions, "<i4").tolist() == [p for n in np.diff(r.cu_lens) for p in range(n)] for r in packed.collect())


# ---------------------------------------------------------------- pipeline


def edited(rng, text, words, times):
    out = text.split()
    for _ in range(times):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def similar_groups(texts, shingle=5, similarity=0.8):
    """Root of each id's group, by all pairs of shingle sets."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        k = min(shingle, len(words)) or 1
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(texts, 2):
        both = len(sets[i] & sets[j])
        if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    return {i: find(i) for i in texts}


def test_similar_takes_against_all_pairs(spark):
    rng = random.Random(16)
    words = [f"w{n}" for n in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 150))) for _ in range(60)]
    rows = {i: t for i, t in enumerate(base)}
    for i in range(60, 300):
        rows[i] = edited(rng, rows[rng.randrange(i)], words, rng.choice([0, 1, 1, 2, 3, 6]))
    rows |= {400: "", 401: None, 402: " \n", 403: "one", 404: "One", 405: "long " * 30_000, 406: "long " * 30_001, 407: "a b c d", 408: "A B C D"}
    takes = spark.createDataFrame(list(rows.items()), "take_id bigint, text string").selectExpr("*", "'x' as sketch", "'y' as a", "1 as fingerprint", "'z' as tag")
    groups, least = similar_groups(rows), {}
    for i, r in groups.items():
        least[r] = min(i, least.get(r, i))
    got = near_takes.first_similar_takes(takes)
    assert sorted(r.take_id for r in got.collect()) == sorted(least.values()) and {"tag", "a"} <= set(got.columns)
    again = takes.unionByName(takes.where("take_id < 40")).unionByName(takes.where("take_id = 3").selectExpr("cast(null as bigint) as take_id", "text", "sketch", "a", "fingerprint", "tag"))
    assert sorted(r.take_id for r in near_takes.first_similar_takes(again).collect()) == sorted(least.values())
    assert near_takes.first_similar_takes(takes.limit(0)).count() == 0


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline
    from cutlake.llm import host_rules, pii

    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(55, 120)))
        rows.append((i, text + (" mail a.b@c.org now" if i % 5 == 0 else ""), "en", f"s{i % 3}" if i % 11 else None, len(text)))
    rows += [(200 + i, rows[i][1], "en", "s1", 1) for i in range(20)] + [(230 + i, edited(rng, rows[40 + i][1], words, 1 + i % 4), "en", "s2", 1) for i in range(20)] + [(300, "short", "en", "s0", 5), (301, None, None, None, None), (None, rows[9][1], "de", "s2", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as take_id", "'z' as kept", "2 as record")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = docs
    seen = []
    for name, function in corpus_pipeline.STAGES:
        before = stage
        stage = function(spark, stage, str(tmp_path)).cache()
        seen.append(stage)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert stage.columns == before.columns, name
    kept, first, masked, mixed, coded = seen
    want = {r[0] for r in rows if host_rules.measure(r[1])[0] >= 50 and host_rules.measure(r[1])[4] * 2 <= host_rules.measure(r[1])[0]}
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
    held = {r.doc_id: r.text for r in kept.collect()}
    groups = similar_groups(held)
    least = {}
    for i, root in groups.items():
        if i is not None:
            least[root] = min(i, least.get(root, i))
    assert sorted(r.doc_id for r in first.collect()) == sorted(least.values()) and len(least) < len(held) - 25
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert all("@" not in t for t in texts.values()) and all(len(texts[i]) == n for i, n in masked.select("doc_id", "n_chars").collect())
    for r in first.collect():
        plain, hidden = pii.find_spans(r.text)
        assert texts[r.doc_id] == pii.mask(r.text, {k: plain[k] + hidden[k] for k in pii.KINDS})
    taken = {r.take_id: r.taken // r.size for r in mixing.mix_takes(masked.selectExpr("doc_id as take_id", "source as source_name", "text")).collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: n for i, n in taken.items() if n}
    assert coded.count() == mixed.count() and coded.where("not round_trip").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, coded.collect()))
    assert all(f(spark, docs.limit(0), "").count() == 0 for _, f in corpus_pipeline.STAGES)

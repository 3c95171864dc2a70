"""Source divergence, byte pairs and spelling variants against brute force and the tokenizer's own library."""

import base64
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cutlake.llm import byte_pairs, divergence, spelling
from cutlake.llm.queries import BYTE_PAIRS

# ------------------------------------------------------------- divergence


def plain_divergence(rows, least, top):
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top}
    return out


@pytest.mark.parametrize("bits", [64, 5])
def test_divergence_against_a_plain_version(spark, bits):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "été", "漢字", "d", "ee", "Fff", "ÀÉ", "zeta"] + [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(20)]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "S3", None, "s4"])
        words = rng.choices(vocabulary, weights=range(1, 31) if source == "s1" else range(30, 0, -1), k=rng.randint(0, 12))
        rows.append((lang, source, rng.choice([" ", "-1_", "\n"]).join(words)))
    rows += [("de", "s1", None), ("de", "s2", ""), ("de", "s2", "only once"), ("it", "s9", "alone"), ("en", "s2", "hot " * 5000)]
    rows += [("en", "s1", "gamma GAMMA")] * 40
    takes = spark.createDataFrame(rows, "language string, source_name string, text string").selectExpr("*", "'x' as term", "1 as digest", "2 as n", "'y' as Lang_no")
    out = {(r.language, r.source_name, r.part, r.item, r.value, r["rank"]) for r in divergence.source_divergence(takes, 4, 3, bits).collect()}
    assert out == plain_divergence(rows, 4, 3)
    assert divergence.source_divergence(takes.limit(0)).count() == 0


def test_pairs_are_the_same_in_small_portions(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = pd.DataFrame([(1, d, 0, c, int(rng.integers(1, 10**9)), 7 + c) for d in range(40) for c in sorted(rng.choice(9, rng.integers(1, 9), False))], columns=[*divergence.TERM, "code", "p", "p0"])

    def totals(batches):
        found = pd.concat(list(divergence._shared_terms(iter(batches))))
        return found.groupby(["lang_no", "a", "b"])["value"].sum().to_dict()

    whole = totals([rows])
    monkeypatch.setattr(divergence, "ROWS", 11)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    assert totals([rows.iloc[i : i + 3] for i in range(0, len(rows), 3)]) == whole


# ------------------------------------------------------------- byte pairs


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(BYTE_PAIRS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_equal_the_library_and_come_back(spark, library):
    pattern, encoding = library
    rng = random.Random(4)
    letters = "aabcdeeinrst  ér漢字😀01'#.\n\t  ́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    texts += [None, "", " ", "  \n", "<|endoftext|>", "don't we'll", "a" * 5000, "ab" * 300 + "漢" * 500, "x" * 40_000, "\x00\x7f", "word " * 20_000]
    takes = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "take_id bigint, text string").selectExpr("*", "7 as Packed_ids", "'x' as decoded", "'y' as doc", "text as said")
    coded = byte_pairs.encode_takes(takes, BYTE_PAIRS, pattern)
    out = byte_pairs.decode_takes(coded, BYTE_PAIRS, pattern).collect()
    assert sorted(r.take_id for r in out) == list(range(2 * len(texts)))
    for r in out:
        text = r.said or ""
        assert np.frombuffer(r.packed_ids, "<u4").tolist() == encoding.encode_ordinary(text), text[:80]
        assert r.n_tokens == len(r.packed_ids) // 4 and bytes(r.decoded) == text.encode() and r.doc == "y"
    assert byte_pairs.encode_takes(takes.limit(0), BYTE_PAIRS, pattern).count() == 0
    nothing = spark.createDataFrame([(1, None)], "take_id bigint, packed_ids binary")
    assert [bytes(r.decoded) for r in byte_pairs.decode_takes(nothing, BYTE_PAIRS, pattern).collect()] == [b""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        unknown = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "take_id bigint, packed_ids binary")
        byte_pairs.decode_takes(unknown, BYTE_PAIRS, pattern).collect()


def test_both_recursive_queries_give_the_library_s_ids(library, monkeypatch):
    pattern, encoding = library
    pairs = byte_pairs.BytePairs(BYTE_PAIRS, pattern)
    rng = random.Random(5)
    words = {w for _ in range(3000) for w in pairs.pattern.findall("".join(rng.choice("aaabcdeinot é漢0#'") for _ in range(rng.randint(2, 30))))}
    words = sorted(words)
    expected = [np.array(encoding.encode_ordinary(w), "<i4").tobytes() for w in words]
    assert pairs.encode(words) == expected
    monkeypatch.setattr(byte_pairs, "LONG", 0)
    assert pairs.encode(words) == expected


def test_words_are_forgotten_between_portions(library, monkeypatch):
    import pandas as pd

    pattern, encoding = library
    monkeypatch.setattr(byte_pairs, "NEW_WORDS", 3)
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 5)
    texts = [f"unusualword{i % 7} again{i % 3}" for i in range(40)]
    batches = [pd.DataFrame({"text": texts[i : i + 4], "said": texts[i : i + 4]}) for i in range(0, 40, 4)]
    out = pd.concat(list(byte_pairs._encoder(BYTE_PAIRS, pattern)(iter(batches))))
    assert [np.frombuffer(p, "<u4").tolist() for p in out.packed_ids] == [encoding.encode_ordinary(t) for t in out.said]
    assert sorted(out.said) == sorted(texts)


# --------------------------------------------------------------- spelling


def edits(word, alphabet):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in alphabet)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in alphabet)


def plain_forms(n):
    alphabet = sorted({c for w in n for c in w})
    near = {w: {e for e in edits(w, alphabet) if e in n and e != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n}


def test_words_and_planted_slips(spark):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(rng.choice(["Scene", "scène", "×cutaway", "take", "TAKES", "naïveté", "light2dark", "Éclair", "éclair"]) for _ in range(30))) for i in range(200)]
    rows += [(1, None), (2, ""), (3, "lonely"), (3, "lonely"), (4, "long" * 20_000)] + [(5, "same words words words words")] * 3
    takes = spark.createDataFrame(rows, "take_id bigint, text string").selectExpr("*", "'x' as word", "1 as n")
    for every in (None, 7):
        n = Counter()
        for take_id, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if take_id is None else take_id}:{word}".encode())
                n[word[: h % len(word)] + word[h % len(word) + 1 :] if every and h % every == 0 else word] += 1
        want = {(w, c) for w, c in n.items() if len(w) >= 5 and c >= 3}
        assert {(r.word, r.n) for r in spelling.take_words(takes, slip_every=every).collect()} == want
    assert spelling.take_words(takes.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 3])
def test_forms_against_a_plain_version(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(300)} | {"take" * 30, "take" * 30 + "s", "a", "", "ab", "ba"}
    words |= {"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(100)}
    words |= {w[:3] + w[4:] for w in list(words)[:100]}
    n = {w: 3 * 2 ** rng.randint(0, 8) + rng.randint(0, 2) for w in words}
    table = spark.createDataFrame([*n.items(), (None, 5)], "word string, n bigint").selectExpr("*", "'x' as other", "1 as root")
    out = spelling.spelling_forms(table).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == plain_forms(n) and len(out) == len(n)
    assert spelling.spelling_forms(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_forms(table, ratio=1)

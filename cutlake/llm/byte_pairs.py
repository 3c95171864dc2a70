"""Byte-level BPE encoding and decoding of take transcripts by recursive queries, one database per task.

A task keeps two tables: the tokens of the vocabulary and the merges, all pairs of tokens whose bytes together are
a token. Words wait as rows (word, position, token); each step of a recursive query joins neighbouring rows with the
merges and contracts the leftmost pair of the lowest rank of every word, until no word has a pair left. Long words take
all occurrences of their lowest pair at once, up to the first that would bring up a lower pair. Decoding joins
positions with token bytes and aggregates them in order.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cutlake.llm.common import others, small_batches

#: A task encodes its waiting words when so many are new or so many characters wait, and forgets all words beyond REMEMBERED.
NEW_WORDS, WAITING_CHARS, REMEMBERED = 100_000, 1 << 24, 700_000
#: Tokens a task decodes at once (a longer text by itself); words longer than LONG bytes take many pairs a step.
DECODED, LONG = 1 << 20, 96

#: Letters of all words in one order, so that neighbours are found without parting the rows by word.
START = """
with letters as (
  select w, pos, b.id as tok
  from (
    select w, (before_ + i)::int as pos, bytes[i:i] as letter
    from (
      select w, bytes, sum(octet_length(bytes)) over (order by w rows unbounded preceding) - octet_length(bytes) as before_,
        unnest(generate_series(1, octet_length(bytes))) as i
      from fresh
    )
  ) s join single b on b.bytes = letter
), pairs as (
  select w, pos, tok, case when lead(w) over near = w then lead(tok) over near end as nxt from letters window near as (order by pos)
)
select w, pos, tok, m from pairs left join merges on a = tok and b = nxt
"""

#: k: rank of the pair a row opens, then its position: no two rows have the same, and the smallest k of a word is the leftmost pair
#: of the lowest rank.
STEP = f"""
with recursive state(w, pos, tok, k, done) as (
  select w, pos, tok, (m::bigint << 32) + pos, false from ({START})
  union all
  select w, pos, new_tok, case when is_new then (m::bigint << 32) + pos else k end, least_k is null
  from (
    select w, pos, k, least_k, is_pair or coalesce(before_pair, false) as is_new,
      case when is_pair then (least_k >> 32)::int else tok end as new_tok,
      case when is_pair then tok_2 when before_pair then (least_k >> 32)::int end as nxt
    from (
      select s.w, pos, tok, k, least_k, coalesce(k = least_k, false) as is_pair, k_1 = least_k as before_pair, k_0 = least_k as gone,
        case when w_2 = s.w then tok_2 end as tok_2
      from (
        select w, pos, tok, k, lag(k) over near as k_0, lead(k) over near as k_1, lead(tok, 2) over near as tok_2, lead(w, 2) over near as w_2
        from state where not done window near as (order by pos)
      ) s join (select w, min(k) as least_k from state where not done group by w) l on l.w = s.w
    ) where gone is not true
  ) left join merges on is_new and a = new_tok and b = nxt
)
select w, tok from state where done order by w, pos
"""

#: r: lowest rank of a word. Of overlapping occurrences every other one is taken; ``stop`` is the first that brings up a lower pair.
LONG_STEP = f"""
with recursive state(w, pos, tok, m, done) as (
  select w, pos, tok, m, false from ({START})
  union all
  select w, pos, new_tok, g.m, r is null
  from (
    select w, pos, r, new_tok, lead(new_tok) over (partition by w order by pos) as nxt
    from (
      select w, pos, r, coalesce(taken and pos <= stop, false) as now, case when now then r else tok end as new_tok,
        coalesce(lag(taken) over near and lag(pos) over near <= stop, false) as gone
      from (
        select c.*, min(case when taken and (x.m < r or y.m < r) then pos else 2147483647 end) over (partition by w) as stop
        from (
          select *, case when lag(taken, 2) over near then r else lag(tok) over near end as tok_0
          from (
            select *, coalesce(hit and (count(*) over (partition by w, run order by pos)) % 2 = (case when first_hit then 1 else 0 end), false) as taken
            from (
              select *, first_value(hit) over (partition by w, run order by pos) as first_hit
              from (
                select *, coalesce(m = r, false) as hit, sum(case when m = r then 0 else 1 end) over near as run
                from (
                  select w, pos, tok, m, min(m) over (partition by w) as r, lead(tok, 2) over near as tok_2 from state where not done
                  window near as (partition by w order by pos)
                ) window near as (partition by w order by pos)
              )
            )
          ) window near as (partition by w order by pos)
        ) c left join merges x on taken and x.a = tok_0 and x.b = r left join merges y on taken and y.a = r and y.b = tok_2
      ) window near as (partition by w order by pos)
    ) where not gone
  ) f left join merges g on g.a = new_tok and g.b = nxt
)
select w, tok from state where done order by w, pos
"""

DECODE = "select doc, string_agg(chars, '' order by pos) as decoded from held join tokens using (id) group by doc"


class BytePairs:
    """One vocabulary as tables of a database in memory; one per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(ranks_path, "rb") as lines:
            rows = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]
        self.db = duckdb.connect(config={"threads": 1})
        self.db.execute("set temp_directory = ''")
        self.db.execute("set preserve_insertion_order = false")
        chars = pa.array([t.decode("latin-1") for t, _ in rows])
        self.run("create table tokens as select id, bytes, chars from given", given=pa.table({"id": pa.array([r for _, r in rows], pa.int32()), "bytes": pa.array([t for t, _ in rows], pa.binary()), "chars": chars}))
        self.db.execute("create table single as select id, bytes from tokens where octet_length(bytes) = 1")
        self.db.execute("""
            create table merges as select l.id as a, r.id as b, s.id as m
            from (select id, bytes, unnest(generate_series(1, octet_length(bytes) - 1)) as cut from tokens) s
            join tokens l on l.bytes = s.bytes[1:cut] join tokens r on r.bytes = s.bytes[cut + 1:]""")
        self.whole = {t: np.int32(r).tobytes() for t, r in rows}
        self.ids = {r for _, r in rows}
        self.forget()

    def forget(self) -> None:
        """Words this worker has met, each with its number, and the ids of those that are encoded, by number."""
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.codes: list[bytes] = []

    def run(self, sql: str, **tables: pa.Table):
        for name, table in tables.items():
            self.db.register(name, table)
        out = self.db.sql(sql)
        out = out.to_arrow_table() if out is not None else None
        for name in tables:
            self.db.unregister(name)
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; a word that is a token is that token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [self.whole.get(r, b"") for r in raw]
        for sql, fits in ((STEP, lambda r: len(r) <= LONG), (LONG_STEP, lambda r: len(r) > LONG)):
            open_ = [i for i, r in enumerate(raw) if r and not out[i] and fits(r)]
            if not open_:
                continue
            fresh = pa.table({"w": pa.array(open_, pa.int32()), "bytes": pa.array([raw[i] for i in open_], pa.binary())})
            got = self.run(sql, fresh=fresh)
            w, tok = (got.column(c).to_numpy() for c in ("w", "tok"))
            tok, ends = tok.astype("<i4").tobytes(), np.flatnonzero(np.r_[w[1:] != w[:-1], True]) + 1
            starts = np.r_[0, ends[:-1]]
            for i, s, e in zip(w[starts].tolist(), (4 * starts).tolist(), (4 * ends).tolist()):
                out[i] = tok[s:e]
        return out

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes behind each text's ids; ids outside the vocabulary are an error."""
        sizes = [len(p) // 4 for p in packed]
        ids = np.frombuffer(b"".join(packed), "<i4")
        held = pa.table({"doc": pa.array(np.repeat(np.arange(len(packed), dtype=np.int32), sizes)), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "id": pa.array(ids)})
        if unknown := set(np.unique(ids).tolist()) - self.ids:
            raise ValueError(f"ids outside the vocabulary: {sorted(unknown)[:5]}")
        got = self.run(DECODE, held=held)
        out = [b""] * len(packed)
        for doc, text in zip(got.column("doc").to_pylist(), got.column("decoded").to_pylist()):
            out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=4)
def compiled(ranks_path: str, pattern: str) -> BytePairs:
    return BytePairs(ranks_path, pattern)


def _encoder(ranks_path: str, pattern: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = compiled(ranks_path, pattern)
        if len(bpe.codes) < len(bpe.number):
            bpe.forget()  # a task ended before its words were encoded
        waiting: list[tuple[pd.DataFrame, list[np.ndarray]]] = []
        chars = 0

        def flush() -> Iterator[pd.DataFrame]:
            codes = bpe.codes
            codes.extend(bpe.encode(list(islice(bpe.number, len(codes), None))))
            for rows, texts in waiting:
                packed = [b"".join([codes[i] for i in t.tolist()]) for t in texts]
                yield rows.assign(packed_ids=packed, n_tokens=[len(p) // 4 for p in packed])
            if len(codes) > REMEMBERED:
                bpe.forget()

        for batch in batches:
            texts = []
            for text in batch.pop("text"):
                text = text or ""
                chars += len(text)
                words = bpe.pattern.findall(text)
                texts.append(np.fromiter(map(bpe.number.__getitem__, words), np.int32, len(words)))
            waiting.append((batch, texts))
            if len(bpe.number) - len(bpe.codes) >= NEW_WORDS or chars >= WAITING_CHARS:
                yield from flush()
                waiting, chars = [], 0
        yield from flush()

    return run


def encode_takes(takes: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The token ids of each whole text: ``packed_ids`` (binary, little-endian 32-bit integers) and ``n_tokens``.

    ``takes``: text and any further columns, which pass through (unless named like a result); texts are not returned. ``ranks_path``: a file of
    base64 tokens and their ranks, which every executor can read; ``pattern``: what counts as a word of its own, each
    match encoded separately. Special tokens spelled out in a text are ordinary text. Null and empty texts have no
    tokens; repeated rows come out each; no takes, no rows. Texts may be of any length: a worker encodes a word once while
    it remembers it, and memory grows with the longest single word only.
    """
    rest = others(takes, ["text"], ["packed_ids", "n_tokens"])
    rows = small_batches(takes).select("text", *rest)
    schema = StructType([*rows.drop("text").schema.fields, StructField("packed_ids", BinaryType()), StructField("n_tokens", LongType())])
    return rows.mapInPandas(_encoder(ranks_path, pattern), schema)


def decode_takes(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (packed_ids and any further columns) with ``decoded``, the bytes behind the ids; null ids give no bytes.

    Ids outside the vocabulary raise an error. Further columns pass through unless named ``decoded``.
    """
    rest = others(encoded, ["packed_ids"], ["decoded"])
    rows = small_batches(encoded).select("packed_ids", *rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = compiled(ranks_path, pattern)
        for batch in batches:
            packed = [p or b"" for p in batch["packed_ids"]]
            decoded, lo = [], 0
            while lo < len(packed):
                hi, size = lo + 1, len(packed[lo])
                while hi < len(packed) and size + len(packed[hi]) <= 4 * DECODED:
                    size += len(packed[hi])
                    hi += 1
                decoded += bpe.decode(packed[lo:hi])
                lo = hi
            yield batch.assign(decoded=decoded)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))

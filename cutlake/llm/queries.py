"""The queries of this subpackage: each maps the given tables to an operator's interface and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm import byte_pairs, divergence, host_rules, html_text, licences, mixing, near_takes, packing, pieces, pii, search, spelling, windows

#: Tokenizer files are a parameter of the cluster; this is where the test box has them.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PAIRS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def as_takes(documents: DataFrame) -> DataFrame:
    """A document stands for a take's transcript; its source for the source the take came from."""
    return documents.select(F.col("doc_id").alias("take_id"), F.col("source").alias("source_name"), "text")


def takes_of(spark: SparkSession, path: str) -> DataFrame:
    return as_takes(table(spark, path, "documents"))


MIX_SQL = """
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15)) as bigint) as h
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as w from d group by source
), l as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
  from s window o as (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, case when w * level >= source_size * 3 then source_size * 3e0
    else w * max(level) filter (where w * level < source_size * 3) over () end as target from l
), c as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as rounds,
    sum(size) over (partition by d.source order by h) as upto, coalesce(sum(size) over (partition by d.source order by h range between unbounded preceding and 1 preceding), 0) as before_
  from d join t on d.source is not distinct from t.source
), n as (select *, target - rounds * source_size as need from c)
select doc_id, size, source_size, target, cast(size * (rounds + case when need <= 0 then 0 when upto <= need then 1
  when before_ < need and upto - need < need - before_ then 1 else 0 end) as bigint) as taken from n
"""


@query("op1_mixed_takes", MIX_SQL)
def op1(spark, path):
    mixed = mixing.mix_takes(takes_of(spark, path))
    return mixed.select(F.col("take_id").alias("doc_id"), "size", "source_size", "target", "taken")


QUALITY_SQL = """
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d),
g as (select r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] as gram from (select r, ws, unnest(generate_series(1, len(ws) - 2)) as i from w)),
rep as (select r, count(distinct i + k) as n from (select r, i, count(*) over (partition by r, gram) as c from g) q cross join (values (0), (1), (2)) v(k) where c > 1 group by r),
ln as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(text, chr(10))) as line from d) q
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
m as (
  select d.r, d.doc_id, d.source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(ln.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d join w using (r) left join rep using (r) left join ln using (r)
), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols > n_words as failed from m),
h as (select source, count(*) as n, sum(cast(failed as bigint)) as f from b group by source),
p as (select avg(f / n) as m, avg((f / n) * (f / n)) as m2, avg(1 / n) as inv from h),
k as (select m, case when m2 - m * m - m * (1 - m) * inv > 1e-12 then least(1e4, greatest(1e0, m * (1 - m) / (m2 - m * m - m * (1 - m) * inv) - 1)) else 1e4 end as k from p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (h.f + k.m * k.k) / (h.n + k.k) <= 75e-2 as kept
from b join h on b.source is not distinct from h.source cross join k
"""


@query("op2_repeated_passages")
def op2(spark, path):
    found = windows.repeated_passages(takes_of(spark, path))
    return found.withColumnsRenamed({"take_id": "doc_id", "with_take_id": "with_doc_id"})


@query("op3_licence_statements")
def op3(spark, path):
    return licences.licence_statements(takes_of(spark, path).select("take_id", "text")).withColumnRenamed("take_id", "doc_id")


@query("op4_judged_takes", QUALITY_SQL)
def op4(spark, path):
    judged = host_rules.judge_takes(takes_of(spark, path))
    return judged.select(F.col("take_id").alias("doc_id"), *host_rules.MEASURES, "base_failed", "kept")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op5_page_texts")
def op5(spark, path):
    return html_text.page_texts(table(spark, path, "pages")).select("page_id", "url", "text", "n_chars")


@query("op6_personal_spans")
def op6(spark, path):
    found = pii.personal_spans(takes_of(spark, path))
    base = F.filter("spans", lambda s: ~s["hidden"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        F.col("take_id").alias("doc_id"), *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_hidden"),
    )


@query("op7_packed_tokens")
def op7(spark, path):
    packed = packing.pack_takes(takes_of(spark, path).select("take_id", "text"), ids_of=packing.byte_pair_ids(BYTE_PAIRS))
    return packed.withColumnRenamed("take_ids", "doc_ids")


SEARCH_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s) t where rank <= 5
"""


@query("op8_top_vectors", SEARCH_SQL)
def op8(spark, path):
    vectors = table(spark, path, "embeddings").select("vec_id", search.scaled("embedding").alias("values"))
    return search.top_vectors(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op9_near_takes")
def op9(spark, path):
    near = near_takes.near_takes(takes_of(spark, path))
    return near.select(F.col("take_id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_take_pieces")
def op10(spark, path):
    coded = pieces.encode_takes(takes_of(spark, path).select("take_id", "text"), PIECE_MODEL)
    back = pieces.decode_takes(coded.select("take_id", "piece_ids", "n_pieces"), PIECE_MODEL)
    return back.select(F.col("take_id").alias("doc_id"), "n_pieces", "piece_ids", F.col("decoded").alias("text"))


SPELLING_SQL = """
with recursive crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
  from (select unnest(generate_series(0::bigint, 255)) as i)
), runs as (
  select doc_id, word, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as word from documents
  ) group by all
), hashed as (
  select word, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(generate_series(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from (select word, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || word)) as x from runs) cross join crc
), w as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) else word end as word, n from hashed
  ) where length(word) >= 5 group by word having sum(n) >= 3
), cut as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(generate_series(1, length(word))) as i from w)),
near as (
  select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word from cut c join w on c.rest = w.word
  union select w.word, c.word from cut c join w on c.rest = w.word
), best as (
  select near.word, count(*) as n_near, min_by(other, (-o.n, other)) as other, max(o.n) as other_n from near join w o on o.word = near.other group by near.word
), f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n
  from w left join best using (word)
), walk(word, at_) as (select word, word from f union all select walk.word, f.form from walk join f on f.word = walk.at_ where f.form is not null)
select f.word, n, n_near, form, form_n, at_ as root from f join walk on walk.word = f.word where at_ in (select word from f where form is null)
"""


@query("op11_spelling_forms", SPELLING_SQL)
def op11(spark, path):
    return spelling.spelling_forms(spelling.take_words(takes_of(spark, path), least_count=3, least_length=5, slip_every=97))


@query("op12_byte_pairs")
def op12(spark, path):
    import public_tokenizers

    coded = byte_pairs.encode_takes(takes_of(spark, path).select("take_id", "text"), BYTE_PAIRS, public_tokenizers.PATTERN)
    back = byte_pairs.decode_takes(coded.select("take_id", "n_tokens", "packed_ids"), BYTE_PAIRS, public_tokenizers.PATTERN)
    return back.select(F.col("take_id").alias("doc_id"), "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


DIVERGENCE_SQL = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
t as (select r, lang, source, unnest(ts) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= 10),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by lang),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
s as (select lang, source, v, coalesce(n, 0) as total from g left join v using (lang) left join (select lang, source, sum(n) as n from c group by all) using (lang, source)),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + cast(1000000000 * (coalesce(c.n, 0) + 2)::hugeint // (s.total + 2 * v)::hugeint as bigint) as p
  from s join k using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + cast(1000000000 * (n + 2)::hugeint // (total + 2 * v)::hugeint as bigint) as q
  from (select lang, term, sum(n) as n from c group by all) join (select lang, any_value(v) as v, sum(total) as total from s group by lang) using (lang)),
f as (select p.lang, p.source, o.source as item, cast(sum((p.p - o.p) * (p.p - o.p) // (p.p + o.p)) as bigint) as value
  from p join p o on p.lang = o.lang and p.term = o.term and p.source <> o.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (from pairs union all from terms))
where part = 'pair' or rank <= 10
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark, path):
    takes = table(spark, path, "documents").select(F.col("source").alias("source_name"), F.col("lang").alias("language"), "text")
    return divergence.source_divergence(takes).withColumnsRenamed({"language": "lang", "source_name": "source"})


@query("pipeline")
def pipeline(spark, path):
    import corpus_pipeline

    return corpus_pipeline.run(spark, path)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)

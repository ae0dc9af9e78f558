"""The thin queries over the operators: fixed inputs, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table
from . import bpe, chat, fim, langid, mixing, mpeg, ngram_join, pii, quality, search, secrets, toxicity, wavelet

#: Key of the pseudonyms in op10. A deployment passes its own to pii.pseudonymize().
PSEUDONYM_KEY = "corpusloom public test key"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = langid.train(docs)
    return langid.predict(docs, net).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select * from values (-7L, 1L, 'user', '</s>[INST] ok [/INST]'), (-7L, 2L, 'assistant', '</s>[INST] ok [/INST]') as t (conv_id, turn, role, text)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_windows(turns))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_labels(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.probe_media(materialize(mpeg.encode_media(read_table(spark, sf_dir, "documents")), "media"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(read_table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(read_table(spark, sf_dir, "documents")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_language, op3_chat, op4_mix, op5_secrets, op6_ngram_join, op7_quality, op8_media, op9_tokens, op10_pii, op11_fim, op12_search, op13_toxicity)
}

_MIX = r"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
m as (select *, length(text) / greatest(size, 1) - 1 as mean from d),
k as (select doc_id, source, size, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 0.5) / 4503599627370496.0) / coalesce(greatest(0.25, 1 - greatest(4 - mean, mean - 8, 0.0) / 8), 0.25) as key from m),
s as (select source, sum(size) as n, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from k group by source),
c as (select a.source, a.n, a.w, ((select 1.5 * sum(n) from s) - coalesce(sum(2 * b.n) filter (2 * b.n / b.w < 2 * a.n / a.w), 0)) / sum(b.w) filter (2 * b.n / b.w >= 2 * a.n / a.w) as level from s a, s b group by all),
l as (select level from c where level * w <= 2 * n order by 2 * n / w limit 1),
t as (select source, n as source_size, least((2 * n)::double, (l.level * w)::double) as target from s, l),
b as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as base from t),
f as (select k.doc_id, k.size, b.source_size, b.target, b.base, sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and current row) - k.size / 2 <= b.target - b.base * b.source_size as near
  from k join b on k.source is not distinct from b.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target, (least(2, base + near::int) * size)::bigint as taken from f
"""

_CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7::bigint, 1::bigint, 'user', '</s>[INST] ok [/INST]'), (-7::bigint, 2::bigint, 'assistant', '</s>[INST] ok [/INST]'))),
p as (select *, row_number() over w as pos from t window w as (partition by conv_id order by turn, role, text)),
q as (select *, pos = 1 and role = 'system' as sys, length(regexp_replace(text, '([<\[])(\\*)(\|(?:im_start|im_end|endoftext|startoftext|system|user|assistant|end)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) + length(role) + 24 as size from p),
o as (select *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 as own from q),
r as (select *, case when sys then 0 else own end as tok, greatest(768 - coalesce(sum(own) filter (sys) over (partition by conv_id), 0), 192) as span from o),
a as (select *, sum(tok) over (partition by conv_id order by pos rows between unbounded preceding and current row) - tok as start from r),
b as (select *, dense_rank() over (partition by conv_id order by start // span) as win from a),
c as (select *, min(start) over (partition by conv_id order by win range between 1 following and 1 following) as nxt from b),
g as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256, max(win) as n_windows,
  sum(size)::bigint + coalesce(sum(size) filter (not sys and nxt - start <= 192), 0)::bigint + (max(win) - 1) * coalesce(sum(size) filter (sys), 0)::bigint as formatted_chars from c group by conv_id)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars::bigint as formatted_chars, n_windows from g
"""

_FIM = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
m as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in [0, 1, 2, 3]] as r from d),
n as (select *, len(u)::bigint as n from m),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as c1, greatest(r[1] % (n + 1), r[2] % (n + 1)) as c2,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(u[1:c1], '') as pre, array_to_string(u[c1 + 1:c2], '') as mid, array_to_string(u[c2 + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

_SEARCH = r"""
with w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
p as (select doc_id, term, count(*) as tf from w group by all),
d as (select doc_id, sum(tf)::bigint as n from p group by all),
s as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d),
f as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from p, s group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
r as (select item_id, p.doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
  from q join p using (term) join f using (term) join d on d.doc_id = p.doc_id, s group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 10
"""

#: The other operators fit models, use a library's vocabulary, or write a binary format: no SQL says what they return.
ORACLE_SQL: dict[str, str] = {"op3_chat": _CHAT, "op4_mix": _MIX, "op11_fim": _FIM, "op12_search": _SEARCH}

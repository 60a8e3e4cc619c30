"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, fingerprints, lexical, ngram_join, packing, quality, secrets, sharding, topk, urlfilter, warc
from .common import ship, table


OTHER = "I would rather not say."


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_versions(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.ngram_jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each conversation against its own copy with another last answer, so that pairs share prefixes
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    copies = turns.join(last, "conv_id", "left").withColumn("text", F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), OTHER).otherwise(F.col("text"))).drop("last")
    both = turns.withColumn("conv_id", F.col("conv_id") * 2).unionByName(copies.withColumn("conv_id", F.col("conv_id") * 2 + 1))
    done = chat.preference_format(chat.pair_conversations(both))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    mask = lambda c: F.expr(f"array_join(transform({c}, m -> concat_ws(':', m.start, m.end)), ',')").alias(c)
    return done.select("pair_id", "shared_turns", sha("prompt"), sha("chosen"), sha("rejected"), mask("chosen_mask"), mask("rejected_mask"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_fingerprints, op2_secrets, op3_quality, op4_bpe, op5_packing, op6_urlfilter, op7_ngram_join, op8_chat, op9_warc, op10_topk,
    op11_sharding, op12_lexical, op13_fim,
)}

_URL = r"""
with u as (select page_id, coalesce(url, '') u from pages),
r as (select page_id, case when strpos(u, '://') > 0 then substr(u, strpos(u, '://') + 3) else '' end rest from u),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from r),
rules(kind, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (select page_id, arg_max(rh || rp, length(rh || rp)) "rule", arg_max(kind, length(rh || rp)) ruled from p join rules
    on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
d as (select p.*, "rule", ruled from p left join best using (page_id)),
h as (select *, case when regexp_full_match(nm, '[0-9.]+|\[.*') then nm when array_to_string(string_split(nm, '.')[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in')
        then array_to_string(string_split(nm, '.')[-2:], '.') else string_split(nm, '.')[-1] end suffix
    from (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') nm, count(ruled)::double n, count(*) filter (ruled = 'allow')::double good from d group by host)),
h2 as (select *, array_to_string(string_split(nm, '.')[-1 - len(string_split(suffix, '.')):], '.') "domain" from h),
dom as (select suffix, "domain", sum(n) n, sum(good) good from h2 group by all),
suf as (select suffix, sum(n) n, sum(good) good from dom group by all),
root as (select (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) m from suf),
s1 as (select suf.*, m from suf, root),
ks as (select case when c < 2 or w is null or w = 0 or rho <= 0 then 1000.0 else least(greatest(1 / least(rho, 1.0) - 1, 1.0), 1000.0) end k from (
    select *, case when w - v > 0 then (s - v) / (w - v) else 0 end rho from (select sum(n * (good / n - m) ** 2) s, sum(m * (1 - m)) v, count(*) c, sum(n * m * (1 - m)) w from s1 where n > 0))),
s2 as (select suffix, (good + k * m) / (n + k) m from s1, ks),
d1 as (select dom.*, m from dom join s2 using (suffix)),
kd as (select case when c < 2 or w is null or w = 0 or rho <= 0 then 1000.0 else least(greatest(1 / least(rho, 1.0) - 1, 1.0), 1000.0) end k from (
    select *, case when w - v > 0 then (s - v) / (w - v) else 0 end rho from (select sum(n * (good / n - m) ** 2) s, sum(m * (1 - m)) v, count(*) c, sum(n * m * (1 - m)) w from d1 where n > 0))),
d2 as (select "domain", (good + k * m) / (n + k) m from d1, kd),
h3 as (select h2.*, m from h2 join d2 using ("domain")),
kh as (select case when c < 2 or w is null or w = 0 or rho <= 0 then 1000.0 else least(greatest(1 / least(rho, 1.0) - 1, 1.0), 1000.0) end k from (
    select *, case when w - v > 0 then (s - v) / (w - v) else 0 end rho from (select sum(n * (good / n - m) ** 2) s, sum(m * (1 - m)) v, count(*) c, sum(n * m * (1 - m)) w from h3 where n > 0))),
h4 as (select host, (good + k * m) / (n + k) rate, n, k from h3, kh),
h5 as (select host, round(rate - 1.0 * sqrt(rate * (1 - rate) / (n + k + 1)), 9) bound from h4)
select page_id, host, path, "rule", coalesce(ruled, case when bound >= 0.3 then 'allow' else 'block' end) verdict from d join h5 using (host)
"""

_CHAT = r"""
with l as (select conv_id, max(turn) "last" from conversations where role = 'assistant' group by 1),
b as (select conv_id * 2 conv_id, turn, "role", text from conversations union all
    select conv_id * 2 + 1, turn, "role", case when "role" = 'assistant' and turn = "last" then 'I would rather not say.' else text end from conversations left join l using (conv_id)),
t as (select conv_id, conv_id // 2 pair_id, conv_id % 2 side, coalesce(role, '') "role", coalesce(text, '') text,
    row_number() over (partition by conv_id order by turn, "role", text) pos from b where conv_id is not null),
n as (select pair_id, max(pos) filter (side = 0) nc, max(pos) filter (side = 1) nr from t group by 1),
m as (select a.pair_id, min(a.pos) pos from t a left join t b on b.pair_id = a.pair_id and b.pos = a.pos and b.side <> a.side
    where b.pos is null or a."role" <> b."role" or a.text <> b.text group by 1),
k as (select n.pair_id, coalesce(m.pos - 1, nc) shared from n left join m using (pair_id)),
p as (select t.*, shared, '<|im_start|>' || "role" || chr(10) || text || '<|im_end|>' || chr(10) body from t join k using (pair_id)),
q as (select *, sum(length(body)) over (partition by conv_id order by pos) - length(body) at0 from p where pos > shared),
x as (select pair_id, coalesce(string_agg(body, '' order by pos) filter (side = 0), '') c, coalesce(string_agg(body, '' order by pos) filter (side = 1), '') r,
    coalesce(string_agg((at0 + 12 + length("role") + 1) || ':' || (at0 + length(body) - 1), ',' order by pos) filter (side = 0 and "role" = 'assistant'), '') cm,
    coalesce(string_agg((at0 + 12 + length("role") + 1) || ':' || (at0 + length(body) - 1), ',' order by pos) filter (side = 1 and "role" = 'assistant'), '') rm
    from q group by 1),
y as (select pair_id, string_agg(body, '' order by pos) pr from p where side = 0 and pos <= shared group by 1)
select k.pair_id, shared::int shared_turns, sha256(coalesce(pr, '')) prompt_sha256, sha256(coalesce(c, '')) chosen_sha256, sha256(coalesce(r, '')) rejected_sha256,
    coalesce(cm, '') chosen_mask, coalesce(rm, '') rejected_mask from k left join x using (pair_id) left join y using (pair_id)
"""

_WARC = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html) payload_bytes, sha1(html) payload_digest from p),
w as (select *, max(page_id) over (partition by payload_digest, payload_bytes) top from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end record_type,
    case when payload_bytes >= 1000 and page_id <> top then top end refers_to from w
"""

_TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
select query_id, "rank"::int "rank", vec_id, score from r where "rank" <= 20
"""

_JOIN = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r(v, c) as (select doc_id, doc_id from documents union select u.b, r.c from r join u on u.a = r.v)
select doc_id, coalesce(n, 0) n_shingles, min(c) component_id from documents d left join n using (doc_id) join r on r.v = d.doc_id group by all
"""

#: the shards; crc32 over the UTF-8 bytes of the code points, with its table made by the rule
_SHARDS = r"""
with t as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc),
b as (select doc_id, source, coalesce(text, '') text, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda ch: case when ch = '' then []
    when unicode(ch) < 128 then [unicode(ch)] when unicode(ch) < 2048 then [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]
    when unicode(ch) < 65536 then [224 + (unicode(ch) >> 12), 128 + ((unicode(ch) >> 6) & 63), 128 + (unicode(ch) & 63)]
    else [240 + (unicode(ch) >> 18), 128 + ((unicode(ch) >> 12) & 63), 128 + ((unicode(ch) >> 6) & 63), 128 + (unicode(ch) & 63)] end)) bytes from documents),
d as (select doc_id, source, strlen(text)::bigint + 1 size, xor(list_reduce(list_prepend(4294967295, bytes::bigint[]), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)::bigint text_crc32 from b, t),
h as (select *, ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '') || ':' || size || ':' || text_crc32), 1, 15))::bigint mixed,
    ('0x' || substr(sha256('42:' || coalesce(source, '')), 1, 13))::bigint::double / 4503599627370496.0 u from d),
r as (select *, (row_number() over (partition by source order by mixed, doc_id) - 1 + u) / count(*) over (partition by source) share from h),
p as (select *, row_number() over (order by share, source nulls first) - 1 pos, count(*) over () n from r),
s as (select *, ((16 * pos + 15) // n)::int shard from p)
select doc_id, size, text_crc32, 'rows' law, shard, (pos - (shard * n) // 16)::bigint slot, null::int grown_shard from s
"""

_LEXICAL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
f as (select doc_id, term, count(*)::bigint tf from t group by all),
l as (select doc_id, count(*)::bigint n from t group by 1),
s as (select count(*)::bigint nd, sum(n)::bigint nt from l),
m as (select doc_id, 25 + (75 * n * nd) // nt m from l, s),
w as (select term, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)::double))::bigint w from f, s group by term, nd),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
g as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join w using (term) join f using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int "rank" from g where score > 0)
select item_id, "rank", doc_id, score from r where "rank" <= 10
"""

_FIM = r"""
with t as (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u, sha256('42:' || doc_id) h from documents),
n as (select *, len(u)::bigint n, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2, ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from n),
p as (select *, array_to_string(u[1:a], '') p, case when b > a then array_to_string(u[a + 1:b], '') else '' end m, case when n > b then array_to_string(u[b + 1:n], '') else '' end s from c)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(text) restored_sha256 from p
"""

ORACLES = {
    "op7_ngram_join": _JOIN, "op6_urlfilter": _URL, "op8_chat": _CHAT, "op9_warc": _WARC, "op10_topk": _TOPK,
    "op11_sharding": _SHARDS, "op12_lexical": _LEXICAL, "op13_fim": _FIM,
}

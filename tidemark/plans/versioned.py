"""Registered queries over tables that are merged into, version after version."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import learning
from tidemark.plans.catalog import c, documents, lineitem, query
from tidemark.sources.io import scratch, table
from tidemark.sources.versions import VersionedTable, yields


@query("""select l_suppkey source, count(*) total, count(*) filter (l_quantity >= 40) hq, floor(count(*) filter (l_quantity >= 40) * 100.0 / count(*))::int quality, max(l_shipdate) last_seen from lineitem group by 1""")
def ups4_table(s, d):
    t = VersionedTable(s, scratch(s, "yields"), "source", "source long, total long, hq long, quality int, last_seen timestamp_ntz", buckets=16)
    for when in ("l_shipdate < timestamp_ntz'1998-01-01'", "l_shipdate >= timestamp_ntz'1998-01-01' and l_suppkey % 10 < 3", "l_shipdate >= timestamp_ntz'1998-01-01' and l_suppkey % 10 >= 3", "l_shipdate is null"):
        finds = lineitem(s, d).filter(when).groupBy(c("l_suppkey").alias("source"))
        t.merge(finds.agg(F.count("*").alias("total"), F.count_if(c("l_quantity") >= 40).alias("hq"), F.max("l_shipdate").alias("last_seen")), yields)
    return t.read()


def _mined(odd: int) -> str:
    status = """case when df_neg >= 2 and df_neg / (df_pos + df_neg) >= 0.15 then 'deprecated' when df_pos >= 3 and df_neg / (df_pos + df_neg) <= 0.05 and contrast >= 2.0 then 'active'
        when df_pos >= 3 and df_neg / (df_pos + df_neg) <= 0.05 and contrast >= 1.5 then 'validated' when df_pos >= 2 and contrast >= 0.5 and df_neg / (df_pos + df_neg) < 0.10 then 'candidate' else 'observed' end"""
    return f"""f{odd} as (select p, unnest(list_distinct(list_filter(w, lambda x: length(x) >= 3))) "value" from t where odd = {odd}), z{odd} as (select count(*) filter (p) np, greatest(1, count(*) filter (not p)) nn from t where odd = {odd}),
        k{odd} as (select "value", count(*) filter (p) df_pos, count(*) filter (not p) df_neg from f{odd} group by 1 having count(*) filter (p) >= 2),
        c{odd} as (select *, round_even(log2((df_pos + 0.5) / (np - df_pos + 0.5)) - log2((df_neg + 0.5) / (nn - df_neg + 0.5)), 3) contrast from k{odd}, z{odd}),
        m{odd} as (select "value", 'learned' category, {status} status, round_even(least(1.0, df_pos / 5) * 0.4 + df_pos / greatest(df_pos + df_neg, 1) * 0.4 + greatest(0.0, least(1.0, contrast / 4)) * 0.2, 3)::double confidence,
            contrast::double contrast, df_pos support, df_neg negatives from c{odd} where contrast >= 0.2),
        x{odd} as (select u."value", count(*) n from (select doc_id, unnest(list_sort(list_distinct(list_filter(w, lambda x: length(x) >= 3)))[1:15]) "value" from t where odd = {odd} and toxic = 1) u group by 1)"""


def _rejected(before: str, n: str) -> str:
    return f"""select coalesce(b."value", n."value") "value", case when b."value" is null then 'negative_spam' else category end category, case when b."value" is null then 'active' else status end status,
        case when b."value" is null then greatest(0.0, 0.1 - 0.15 * (n - 1)) else greatest(0.0, confidence - 0.15 * coalesce(n, 0)) end::double confidence,
        case when b."value" is null then -2.5 - 1.0 * (n - 1) else contrast - 1.0 * coalesce(n, 0) end::double contrast, coalesce(support, 0) support, case when b."value" is null then n else negatives + coalesce(n, 0) end negatives
        from {before} b full join {n} n on b."value" = n."value" """


@query(f"""with t as (select doc_id, doc_id % 2 odd, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 2 and not regexp_full_match(t, '[0-9]+')) w, quality = 1 p, toxic from documents join labels using (doc_id)),
    {_mined(0)}, {_mined(1)}, a0 as ({_rejected('m0', 'x0')}),
    u1 as (select coalesce(n."value", b."value") "value", case when n."value" is null then b.category else n.category end category, case when n."value" is null then b.status else n.status end status, case when n."value" is null then b.confidence else n.confidence end confidence,
        case when n."value" is null then b.contrast else n.contrast end contrast, case when n."value" is null then b.support else n.support end support, case when n."value" is null then b.negatives else n.negatives end negatives
        from a0 b full join m1 n on b."value" = n."value"),
    a1 as ({_rejected('u1', 'x1')})
    select "value", round(confidence, 6) confidence, round(contrast, 6) contrast, support, negatives, status, case when category = 'negative_spam' or contrast < -1 then 'negative' when status = 'candidate' then 'candidate' else 'active' end part
    from a1 where status in ('active', 'validated', 'candidate')""")
def lm14_cycle(s, d):
    model = VersionedTable(s, scratch(s, "model"), "value", learning.MODEL, buckets=16)
    docs = documents(s, d).join(table(s, d, "labels"), "doc_id").withColumn("positive", c("quality") == 1)
    for number in (1, 2):
        part = docs.filter(c("doc_id") % 2 == number - 1)
        used = learning.cycle(model, number, part, part.filter("toxic = 1"), T.tokens(c("text")), "doc_id")
    return used.select("value", F.round("confidence", 6).alias("confidence"), F.round("contrast", 6).alias("contrast"), "support", "negatives", "status", "part")

"""Ranked lexical search: document-sharded postings with integer impacts, term at a time.

Runs of documents, as the scan's tasks read them, become shards: the shard's distinct terms and,
in CSR form, the documents and counts of each term. Once the corpus counts are known, a second
pass replaces counts by integer impacts, so that a query only adds weight * impact. Queries are
packed into blocks, and every shard meets every block where the shard lies: no posting is
shuffled. A task adds up one query at a time in a dense array over the shard's documents, keeps
the best k with all ties at the border, merges them over its shards, and two windows merge the
tasks' lists. Nothing depends on a term's or a document's frequency but the length of one list.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import LARGE_ROWS, materialize, text_slices

#: a term: ASCII letters and digits and all beyond ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 10
#: bytes of text of a shard; a longer text is a shard by itself
SHARD_BYTES = 4 << 20
#: terms of the queries of a block (a longer query is a block by itself), and of the blocks that are broadcast at once (some 40 bytes each)
BLOCK_TERMS, ROUND_TERMS = 100_000, 1_000_000
#: parts into which the tasks' lists of a query are merged first
MERGE_PARTS = 64
#: stands for a null id, so that it comes last in ties
NO_ID = 2**63 - 1

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32

_SHARD = "ids binary, lengths binary, n_docs long, n_terms long, terms array<string>, df array<int>, docs binary, tf binary"
_ARROW = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("docs", pa.binary()), ("tf", pa.binary())])


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, lower-cased, and the number of the text of each."""
    held = _IN_TERM[raw]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a term never runs on into the next text
    begins[first] = held[first]
    at = np.flatnonzero(begins)
    data = _LOWERED[raw[held]]
    bounds = np.append(np.cumsum(held, dtype=np.int64)[at] - 1, len(data))
    texts = np.searchsorted(offsets, at, "right") - 1
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]), texts


def _shard(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> dict:
    terms, texts = _terms(raw, offsets)
    lengths = np.bincount(texts, minlength=len(ids)).astype(np.int64)
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(codes * len(ids) + texts, return_counts=True)
    df = np.bincount(pairs // len(ids), minlength=len(coded.dictionary)).astype(np.int32)
    return {
        "ids": ids.tobytes(), "lengths": lengths.tobytes(), "n_docs": int((lengths > 0).sum()), "n_terms": len(texts), "terms": coded.dictionary.cast(pa.string()), "df": df,
        "docs": (pairs % len(ids)).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(),
    }


def _postings(shard_bytes: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in text_slices(batch.column(1), shard_bytes):
                s = _shard(ids[lo:hi], raw, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([s[f.name]], f.type) for f in _ARROW], schema=_ARROW)

    return run


def _with_impacts(n_docs: int, n_terms: int):
    def run(batches):
        for batch in batches:
            tf_at = batch.schema.get_field_index("tf")
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths, docs, tf = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in (("lengths", np.int64), ("docs", np.int32), ("tf", np.int32)))
                if 75 * n_docs * int(lengths.max(initial=0)) < 2**63:
                    m = 25 + 75 * lengths * n_docs // max(n_terms, 1)
                else:  # exact beyond 64 bits as well
                    m = np.array([25 + 75 * x * n_docs // n_terms for x in lengths.tolist()], np.int64)
                tf = tf.astype(np.int64)
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
                yield row.set_column(tf_at, "impacts", pa.array([impacts.astype(np.int32).tobytes()], pa.binary()))

    return run


class Index(NamedTuple):
    """Shards with impacts, and the corpus counts: documents with a term, and all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every whole text. Null and empty texts and those without a term are in no list and no count.

    Repeated rows are documents of their own; null ids come last in ties (2**63 - 1 stands for
    them, which no id may be). An empty table gives an empty index. Extra columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.col(f"`{text_col}`"))
    postings = materialize(rows.mapInArrow(_postings(shard_bytes), _SHARD), "postings", LARGE_ROWS)
    counts = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    shards = postings.mapInArrow(_with_impacts(counts.d, counts.t), _SHARD.replace("tf binary", "impacts binary"))
    return Index(materialize(shards, "impacts", LARGE_ROWS), counts.d, counts.t)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, equal scores by id: all that tie at the border are compared."""
    if len(scores) > k:
        border = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        able = scores >= border
        scores, ids = scores[able], ids[able]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searched(k: int):
    def run(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, docs, impacts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("ids", np.int64), ("docs", np.int32), ("impacts", np.int32)))
                ends = np.cumsum(batch.column("df")[i].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                block = batch.column("block")[i].values
                query, term, weight = (block.field(x) for x in range(3))
                rows = pc.index_in(term, value_set=batch.column("terms")[i].values)
                known = rows.is_valid().to_numpy(zero_copy_only=False)
                if not known.any():
                    continue
                query, weight, rows = query.to_numpy()[known], weight.to_numpy()[known], rows.drop_null().to_numpy()
                order = np.argsort(query, kind="stable")
                query, weight, rows = query[order], weight[order], rows[order]
                cuts = np.flatnonzero(np.diff(query, prepend=query[0] - 1, append=query[-1] + 1))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    sums = np.zeros(len(ids), np.int64)
                    for r, w in zip(rows[lo:hi], weight[lo:hi], strict=True):
                        at = slice(ends[r - 1] if r else 0, ends[r])
                        sums[docs[at]] += w * impacts[at]
                    hit = np.flatnonzero(sums > 0)
                    scores, names = sums[hit], ids[hit]
                    if (q := int(query[lo])) in found:
                        scores, names = np.concatenate([found[q][0], scores]), np.concatenate([found[q][1], names])
                    found[q] = _best(scores, names, k)
        for q, (scores, names) in found.items():
            yield pa.record_batch([pa.array([q] * len(scores), pa.int64()), pa.array(names), pa.array(scores)], names=["query", "doc_id", "score"])

    return run


def query_terms(items: DataFrame, text: str) -> DataFrame:
    """(query, term, times) of items numbered by ``query``."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return items.select("query", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 0)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id_col, rank, doc_id, score): each item's k best documents with a score above 0, ties to the smaller id.

    Items without a term that the corpus holds (null and empty texts too) get no row; items of
    one id are queries of their own. Documents with repeated ids are ranked one by one. Extra
    columns are ignored, an empty table on either side gives an empty result.
    """
    items = materialize(items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("item_text")), "items")
    asked = materialize(query_terms(items, "item_text"), "asked")
    # of the corpus frequencies, only those of terms that are asked for are summed
    held = index.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").cast("long").alias("df"))
    wanted = asked.select("term").distinct()
    df = held.join(broadcast(wanted) if asked.count() <= ROUND_TERMS else wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").select("query", "term", (weight * F.col("times")).alias("weight"))
    sizes = weighed.groupBy("query").agg(F.count("*").alias("n"))
    # queries in order, cut into blocks and rounds by the running count of their terms
    so_far = F.sum("n").over(Window.partitionBy("part").orderBy("query"))
    sizes = sizes.withColumn("part", F.shiftright("query", 33)).withColumn("block", F.floor(so_far / BLOCK_TERMS))
    blocks = weighed.join(sizes.select("query", "part", "block"), "query").groupBy("part", "block").agg(F.collect_list(F.struct("query", "term", "weight")).alias("block_terms"))
    blocks = materialize(blocks.select(F.monotonically_increasing_id().alias("id"), F.size("block_terms").alias("n"), F.col("block_terms").alias("block")), "blocks")
    rounds = [[]]
    room = 0
    for b in blocks.select("id", "n").orderBy("id").toLocalIterator():
        if rounds[-1] and room + b.n > ROUND_TERMS:
            rounds.append([])
            room = 0
        rounds[-1].append(b.id)
        room += b.n
    lists = None
    for ids in rounds:
        # a bounded number of blocks at once, in one row of the join for each shard and block
        few = broadcast(blocks.filter(F.col("id").between(ids[0], ids[-1]) if ids else F.lit(False)).select("block"))
        part = index.shards.crossJoin(few).select("ids", "terms", "df", "docs", "impacts", "block").mapInArrow(_searched(k), "query long, doc_id long, score long")
        lists = part if lists is None else lists.unionAll(part)
    best = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("score"), "doc_id"))
    lists = materialize(lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))), "lists")
    lists = lists.withColumn("rank", best).filter(F.col("rank") <= k)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    lists = lists.withColumn("rank", best).filter(F.col("rank") <= k)
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return lists.join(items.select("query", id_col), "query").select(id_col, "rank", doc_id.alias("doc_id"), "score")

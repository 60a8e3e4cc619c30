"""Exact Jaccard self-join of documents on word n-grams, and the groups its links make.

Method: rare-first prefix filtering. Every text's distinct shingles are ordered by a corpus
frequency sketch (rarest first); only the first n - ceil(t*n) + 1 of them are posted. Two sets
with Jaccard >= t share a posted shingle, whatever the order, so the sketch decides the cost
and never the result. Shared postings pass a length filter and a positional filter, then the
suffix filter: both sets are cut at the same 63 pivots, and their overlap is at most the sum of
the smaller parts. Each surviving pair of distinct sets is verified once, on the full sets.

Copies (equal sets) are one class from the start; classes are keyed by the digest of their set.
A posting list is compared in rounds. A round draws about ``HUBS`` hubs from each list, by a
hash of the class, so that lists of one group of near copies draw the same ones; hubs are
compared with the whole list and leave it. Members that land in one component need no further
comparison, so a group of g near copies takes about g comparisons a hub, not g * g. Lists that
still hold several components go on with more hubs, until none does: no link between components
is lost. A list no longer than its hubs is compared in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import BROADCAST_IDS, by_ids, free_name, materialize, text_slices
from .components import components
from .shingles import mix, shingle_sets

SLICE_BYTES = 1 << 20
SKETCH_BITS = 22
SKETCH_BLOCKS = 128
BINS = 64
#: hubs of a list in the first round, and by how much each round takes more
HUBS = 8
MORE_HUBS = 16
#: keys of some 45 bytes that ``keep_first`` may broadcast
BROADCAST_KEYS = 200_000


def _digests(sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
    """Size and 128-bit digest of each set, the digest in two halves."""
    n = [len(s) for s in sets]
    d1 = [int(np.add.reduce(mix(s), dtype=np.uint64).astype(np.int64)) for s in sets]
    d2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(77))).astype(np.int64)) if len(s) else 0 for s in sets]
    return n, d1, d2


def _scan(width: int, bits: int):
    """Per document: set size and digest; per task: the frequency sketch in blocks."""
    names = ["id", "key", "n", "d1", "d2", "block", "part", "counts"]

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        mask = np.uint64((1 << bits) - 1)
        seed = 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
                sets = shingle_sets(data, offsets, width)
                every = np.concatenate(sets)
                np.add.at(counts, (every & mask).astype(np.int64), np.uint32(1))
                seed = (seed * 31 + len(data)) % 65536
                n, d1, d2 = _digests(sets)
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.record_batch([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *none], names=names)
        step = (1 << bits) // SKETCH_BLOCKS
        packed = [zlib.compress(counts[i * step : (i + 1) * step].tobytes(), 1) for i in range(SKETCH_BLOCKS)]
        none = [pa.nulls(SKETCH_BLOCKS, t) for t in (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.record_batch([*none, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([seed % 64] * SKETCH_BLOCKS, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def _add_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketch blocks of one group, one at a time; counts stop at the type's largest."""
    total = None
    for batch in batches:
        for blob in batch.column("counts"):
            got = np.frombuffer(zlib.decompress(blob.as_py()), np.uint32).astype(np.uint64)
            total = got if total is None else total + got
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _prefixes(width: int, num: int, den: int, sketch: Broadcast):
    """Per document: set size and digest, the parts between the pivots, and the rarest shingles in order."""

    def run(batches):
        freq = sketch.value
        mask = np.uint64(len(freq) - 1)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(data, offsets, width)
                n, d1, d2 = _digests(sets)
                parts = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.uint32).tobytes() for s in sets]
                first = []
                for s in sets:
                    k = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    first.append(s[np.lexsort((s, freq[(s & mask).astype(np.int64)]))[:k]].view(np.int64))
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0)[lo:hi], pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))],
                    names=["id", "n", "d1", "d2", "parts", "tokens"],
                )

    return run


def _room(num: int, den: int):
    """The suffix filter: keep pairs whose parts leave room for the overlap that a link needs."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BINS) for c in ("parts_a", "parts_b"))
            room = np.minimum(a, b).sum(1, dtype=np.int64)
            total = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
            keep = room * (num + den) >= num * total
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                sets = shingle_sets(data, offsets, width)
                n, d1, d2 = _digests(sets)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                full = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.record_batch([pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), full], names=["n", "d1", "d2", "full"])

    return run


def _frequencies(scanned: DataFrame, bits: int) -> np.ndarray:
    """The sketch of the whole corpus: the tasks' blocks, summed in two steps."""
    blocks = scanned.filter("block is not null").select("block", "part", "counts")
    first = blocks.groupBy("block", "part").applyInArrow(_add_blocks, "block int, counts binary")
    freq = np.zeros(1 << bits, np.uint32)
    step = len(freq) // SKETCH_BLOCKS
    for block, counts in first.groupBy("block").applyInArrow(_add_blocks, "block int, counts binary").collect():
        freq[block * step : (block + 1) * step] = np.frombuffer(zlib.decompress(counts), np.uint32)
    return freq


def jaccard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """(id, key, n_shingles, class_id, group_id, component_id) of every row; see ``ngram_jaccard_groups``.

    ``key`` is the MD5 of the text, so (id, key) tells rows of a repeated id apart. ``group_id``
    is the same for linked rows and for no others; null where the set is empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text).alias("key"), text.alias("text"))
    scanned = rows.mapInArrow(_scan(width, sketch_bits), "id long, key string, n int, d1 long, d2 long, block int, part int, counts binary")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "scan")
    sketch = spark.sparkContext.broadcast(_frequencies(scanned, sketch_bits))

    sizes = scanned.filter("block is null").select("row", "id", "key", "n", "d1", "d2")
    classes = sizes.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("cls"), F.min("id").alias("class_id"))
    classes = materialize(classes, "classes")
    members = materialize(sizes.join(classes, ["d1", "d2", "n"], "left").select("id", "key", "n", "cls", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id")), "members")

    prefixes = rows.select("id", "text").mapInArrow(_prefixes(width, num, den, sketch), "id long, n int, d1 long, d2 long, parts binary, tokens array<long>")
    chosen = classes.select("d1", "d2", "n", "cls", F.col("class_id").alias("chosen"))
    prefixes = materialize(prefixes.join(chosen, ["d1", "d2", "n"]).filter("id <=> chosen").select("cls", "n", "parts", "tokens"), "prefixes")
    posted = prefixes.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("g"), F.min("n").alias("low")).filter("g > 1")
    # the best partner of a posting is the smallest set that the length filter admits
    viable = f"n - pos >= {num} * (n + greatest(low, ceil({num} * n / {den}))) / {num + den}"
    post = materialize(posted.join(shared, "token").filter(viable).select("token", "cls", "n", "pos").dropDuplicates(["token", "cls"]), "postings")
    some = materialize(prefixes.select("cls", "parts").join(post.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "parts")

    fits = f"""least(a.n, b.n) * {den} >= {num} * greatest(a.n, b.n)
        and least(a.n - a.pos, b.n - b.pos) * {num + den} >= {num} * (a.n + b.n)"""

    def verify(pairs: DataFrame) -> DataFrame:
        named = lambda side: some.select(F.col("cls").alias(side), F.col("parts").alias(f"parts_{side}"))
        near = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "parts_a", "parts_b")
        near = materialize(near.mapInArrow(_room(num, den), "a long, b long"), "near")
        ends = classes.join(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), "cls", "left_semi")
        ends = materialize(ends, "ends")
        n, named_ends = ends.agg(F.count("*"), F.count("class_id")).first()
        ids = ends.filter("class_id is not null").select(F.col("class_id").alias("id")).distinct()
        texts = rows.select("id", "text").join(broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi").select("text")
        if named_ends < n:
            texts = texts.unionByName(rows.filter("id is null").select("text"))
        full = texts.mapInArrow(_full_sets(width), "n int, d1 long, d2 long, full array<long>")
        full = full.join(ends.select("d1", "d2", "n", "cls"), ["d1", "d2", "n"]).select("cls", "full")
        full = materialize(full, "sets")
        if full.count() > n:  # a row of the same id and set comes again
            full = full.dropDuplicates(["cls"])
        side = lambda x: full.select(F.col("cls").alias(x), F.col("full").alias(f"full_{x}"))
        both = near.join(side("a"), "a").join(side("b"), "b")
        return both.filter(f"size(array_intersect(full_a, full_b)) * {num + den}L >= {num}L * (size(full_a) + size(full_b))").select("a", "b")

    none = spark.createDataFrame([], "a long, b long")
    links, judged, label, hubs, turn = none, none, None, HUBS, 0
    while True:
        tagged = post.withColumn("comp", F.col("cls")) if label is None else post.join(label, post.cls == label.vertex, "left").select(*post.columns, F.coalesce("component", "cls").alias("comp"))
        lists = tagged.groupBy("token").agg(F.count("*").alias("g"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
        hub = F.expr(f"pmod(xxhash64(cls, {turn}), 1000000000) / 1e9D * g < {hubs}")
        live = materialize(tagged.join(lists, "token").select("token", "cls", "n", "pos", "comp", hub.alias("hub")), "live")
        if live.isEmpty():
            break
        a, b = live.alias("a"), live.filter("hub").alias("b")
        met = a.join(b, F.expr(f"a.token = b.token and a.comp <> b.comp and (not a.hub or a.cls < b.cls) and {fits}"))
        pairs = met.select(F.expr("least(a.cls, b.cls)").alias("a"), F.expr("greatest(a.cls, b.cls)").alias("b")).distinct()
        pairs = materialize(pairs.join(judged, ["a", "b"], "left_anti"), "pairs")
        judged = judged.unionByName(pairs)
        links = materialize(links.unionByName(verify(pairs)), "links")
        label = components(links)
        post = live.filter("not hub").select("token", "cls", "n", "pos")
        hubs, turn = hubs * MORE_HUBS, turn + 1

    if label is None:
        return members.select("id", "key", F.col("n").cast("long").alias("n_shingles"), "class_id", F.col("cls").alias("group_id"), F.col("class_id").alias("component_id"))
    named = classes.select("cls", "class_id").join(label, classes.cls == label.vertex)
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = materialize(named.select("cls", "component").join(least, "component"), "named")
    out = members.join(named, "cls", "left")
    own = F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id"))
    return out.select("id", "key", F.col("n").cast("long").alias("n_shingles"), "class_id", F.coalesce("component", "cls").alias("group_id"), own.alias("component_id"))


def ngram_jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """(id, n_shingles, class_id, component_id): groups of documents linked at Jaccard >= num/den.

    ``class_id`` is the least id with the same shingle set, ``component_id`` the least id
    reachable by links. Null and empty texts, and texts without words, have an empty set and
    are linked with nothing; a text of fewer than ``width`` words has one shingle; long texts
    are taken whole. Ties in frequency are in order of the shingles' hashes. Repeated ids: rows
    are linked by their own texts, so two rows of one id may lie in two groups. Rows with a null
    id are linked like others; the id of a group of such rows alone is null. An empty table
    gives an empty result. Extra columns are ignored, whatever their names. The sketch that is
    collected and broadcast has a fixed size (4 * 2**sketch_bits bytes).
    """
    return jaccard_rows(docs, id_col, text_col, width, num, den, sketch_bits).select("id", "n_shingles", "class_id", "component_id")


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``rows``, which come from ``jaccard_rows`` over ``docs``.

    The row with the least id stays (null last, then by the text's MD5). Of rows with the same
    id and text one stays, whichever. Rows of ``docs`` that are in no group all stay. Columns
    come back as they are.
    """
    columns, key = docs.columns, free_name(docs, "row_key")
    named = lambda i, k: F.concat_ws(":", F.coalesce(i.cast("long").cast("string"), F.lit("")), k)
    keyed = docs.withColumn(key, named(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = rows.filter("group_id is not null").select("group_id", F.struct(F.col("id").isNull().alias("late"), "id", "key").alias("row"))
    several = rows.groupBy("group_id").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first <> last").select("group_id", "first")
    gone = rows.join(several, "group_id").filter("row <> first").select(named(F.col("row.id"), F.col("row.key")).alias(key)).distinct()
    keyed = by_ids(keyed, materialize(gone, "gone"), key, "left_anti", BROADCAST_KEYS)
    again = rows.groupBy(named(F.col("row.id"), F.col("row.key")).alias(key)).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    again = materialize(again, "again")
    if not again.isEmpty():
        twice = by_ids(keyed, again, key, "left_semi", BROADCAST_KEYS).dropDuplicates([key])
        keyed = by_ids(keyed, again, key, "left_anti", BROADCAST_KEYS).unionByName(twice)
    return keyed.select(*[f"`{c}`" for c in columns])

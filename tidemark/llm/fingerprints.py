"""Invertible Bloom lookup fingerprints of documents, built and peeled with SQL functions only.

A text's items are the 64-bit digests of its distinct non-empty lines (paragraphs). The
fingerprint has 3 tables of 8 cells; each item goes to one cell of each table, and a cell
keeps a count, the xor of its items and the xor of their check digests. Subtracting two
fingerprints cell by cell leaves the items that only one version has; peeling then removes
cells that hold a single item until nothing is left. Where peeling gets stuck the pair is
retried with eight times the cells: its items are dealt by further digest bits to eight
sketches, each peeled by itself, and so on until every item has been recovered. Each retry
is a row of its own, so a long text is many small rows and never one large task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 12
MAX_LEVELS = 15


def _cell(x: str, j: str) -> str:
    return f"(shiftrightunsigned({x}, 3 * cast({j} div 8 as int)) & 7) = {j} % 8"


def items(text: str) -> str:
    """Distinct digests of the non-empty lines of a text."""
    return f"array_distinct(transform(filter(split({text}, '\\n', -1), p -> p <> ''), p -> xxhash64(p)))"


def sketch(arr: str) -> str:
    return f"""transform(sequence(0, 23), j -> aggregate(filter({arr}, x -> {_cell("x", "j")}),
        named_struct('c', 0, 'k', 0L, 'h', 0L),
        (s, x) -> named_struct('c', s.c + 1, 'k', s.k ^ x, 'h', s.h ^ xxhash64(x))))"""


def show(cells: str) -> str:
    """A sketch as text: cells joined by ';', each count:key:check in hex, empty where nothing is."""
    return f"concat_ws(';', transform({cells}, c -> if(c.c = 0, '', concat_ws(':', c.c, lower(hex(c.k)), lower(hex(c.h))))))"


def subtract(p: str, q: str) -> str:
    return f"zip_with({p}, {q}, (p, q) -> named_struct('c', p.c - q.c, 'k', p.k ^ q.k, 'h', p.h ^ q.h))"


def peel(cells: str) -> str:
    """struct(cells, a, b): what is left, and the items only the first or only the second has."""
    pure = "array_distinct(transform(filter(s.cells, c -> abs(c.c) = 1 and c.h = xxhash64(c.k)), c -> named_struct('d', c.c, 'k', c.k)))"
    take = f"""transform(s.cells, (c, j) -> aggregate(filter(p, q -> {_cell("q.k", "j")}), c,
        (t, q) -> named_struct('c', t.c - q.d, 'k', t.k ^ q.k, 'h', t.h ^ xxhash64(q.k))))"""
    step = f"""transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', {take},
        'a', concat(s.a, transform(filter(p, q -> q.d = 1), q -> q.k)),
        'b', concat(s.b, transform(filter(p, q -> q.d = -1), q -> q.k)))))[0]"""
    return f"""aggregate(sequence(1, {ROUNDS}),
        named_struct('cells', {cells}, 'a', cast(array() as array<bigint>), 'b', cast(array() as array<bigint>)),
        (s, r) -> {step})"""


def _solved(col: str) -> str:
    return f"forall({col}.cells, c -> c.c = 0 and c.k = 0 and c.h = 0)"


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; a null text counts as empty. Equal texts have equal ones."""
    return docs.withColumn("fingerprint", F.expr(show(sketch(items(f"coalesce(`{text_col}`, '')")))))


def differences(pairs: DataFrame) -> DataFrame:
    """Recover what differs between two item arrays: (key, only_a, only_b, levels) per row of (key, xs, ys).

    ``xs`` and ``ys`` are arrays of distinct longs. Level 1 peels the plain fingerprints; each
    further level has eight times the cells. Distinct digests end up in different sketches
    by level 15 at the latest; items that are equal in all of those bits are set apart with
    array_except, so the result is always whole.
    """
    out, todo = None, pairs.select("key", "xs", "ys")
    for level in range(1, MAX_LEVELS + 2):
        if level > 1:
            part = f"x -> (shiftrightunsigned(x, {10 + 3 * level}) & 7) = sub" if level <= MAX_LEVELS else "x -> true"
            split = todo.withColumn("sub", F.explode(F.expr("sequence(0, 7)" if level <= MAX_LEVELS else "array(0)")))
            todo = split.select("key", F.expr(f"filter(xs, {part})").alias("xs"), F.expr(f"filter(ys, {part})").alias("ys")).filter("size(xs) + size(ys) > 0")
        if level > MAX_LEVELS:
            done = todo.select("key", F.expr("size(array_except(xs, ys))").alias("only_a"), F.expr("size(array_except(ys, xs))").alias("only_b"), F.lit(level).alias("level"))
            return _summed(out.unionByName(done))
        peeled = todo.withColumn("s", F.expr(peel(subtract(sketch("xs"), sketch("ys")))))
        got = peeled.select("key", "xs", "ys", F.expr(_solved("s")).alias("ok"), F.expr("size(s.a)").alias("only_a"), F.expr("size(s.b)").alias("only_b"))
        got = materialize(got.withColumns({c: F.expr(f"if(ok, null, {c})") for c in ("xs", "ys")}), f"peel{level}")
        done = got.filter("ok").select("key", "only_a", "only_b", F.lit(level).alias("level"))
        out = done if out is None else out.unionByName(done)
        todo = got.filter("not ok").select("key", "xs", "ys")
        if todo.isEmpty():
            break
    return _summed(out)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"), F.max("level").alias("levels"))


#: text in one range of ids, about, and ranges that the first step tells apart
RANGE_BYTES, COARSE = 16 << 20, 1024


def _below(array: str, column: str) -> str:
    return f"size(filter({array}, c_ -> c_ <= {column}))"


def _cuts(quantiles: str) -> str:
    """Sorted distinct cuts of some quantiles; an id that fills a range or more is cut off behind as well, so that it is a range by itself."""
    again = f"filter({quantiles}, (x, i) -> i > 0 and x = {quantiles}[i - 1] and x < {(1 << 63) - 1}L)"
    return f"array_sort(array_distinct(concat({quantiles}, transform({again}, x -> x + 1L))))"


#: ranges whose cuts or heads may be broadcast (some 50 bytes each)
BROADCAST_RANGES = 500_000


def _ranges(keys: DataFrame, buckets: int, n: int):
    """A function that gives rows with (doc_id, h) their ``range``, a struct that orders ranges of about equal counts; null ids first.

    Quantiles of all ids give coarse ranges, quantiles within each of them fine ones, which are
    looked up in a small table, and a range that one id (or null) overfills is cut by the hash of
    its texts. Neither the plan nor a task's state grows with the number of ranges.
    """
    coarse = min(buckets, COARSE)
    fine, least = -(-buckets // coarse), max(1, -(-n // buckets))
    small = F.broadcast if buckets <= BROADCAST_RANGES else lambda df: df
    quantiles = lambda k: F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10000, 10 * k)) if k > 1 else F.lit(None).cast("array<bigint>")
    cuts = materialize(keys.agg(F.count("*"), quantiles(coarse).alias("q")).select(F.expr(f"coalesce({_cuts('q')}, cast(array() as array<bigint>))").alias("coarse_cuts")), "cuts")
    first = lambda rows: rows.crossJoin(F.broadcast(cuts)).withColumn("a", F.expr(f"if(doc_id is null, -1, {_below('coarse_cuts', 'doc_id')})")).drop("coarse_cuts")
    inner = None if fine == 1 else materialize(first(keys).groupBy("a").agg(quantiles(fine).alias("q")).select("a", F.expr(_cuts("q")).alias("fine_cuts")), "cuts")

    def second(rows: DataFrame) -> DataFrame:
        if inner is None:
            return first(rows).withColumn("b", F.lit(0))
        return first(rows).join(small(inner), "a").withColumn("b", F.expr(f"coalesce({_below('fine_cuts', 'doc_id')}, 0)")).drop("fine_cuts")

    many = second(keys).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    many = many.filter((F.col("n") > 4 * least) & F.col("low").eqNullSafe(F.col("high"))).select("a", "b", F.ceil(F.col("n") / least).cast("double").alias("k"))
    many = materialize(many, "cuts")

    def third(rows: DataFrame) -> DataFrame:
        columns = rows.columns
        part = F.when(F.col("k").isNull(), 0).otherwise(F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * F.col("k"))).cast("long")
        return second(rows).join(small(many), ["a", "b"], "left").select(*columns, F.struct("a", "b", part.alias("c")).alias("range"))

    return third


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each document beside the next one by ascending id; the last gets the first.

    Null texts read as empty; null ids come first; equal ids are ordered by a hash of the text,
    then by the text. Rows are dealt to about ``buckets`` ranges of equal counts (by default one
    for each ``RANGE_BYTES`` of text), so that no task holds the whole order, nor all rows of one
    id, but for equal rows. A copy of each range's first row goes to the end of the range before
    it. An empty table gives an empty result; a lone row is its own successor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    keys = materialize(rows.select("doc_id", "h", F.octet_length("text").alias("size")), "ids")
    size = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if not size.n:
        return rows.select("doc_id", "text", F.lit("").alias("next_text")).limit(0)
    buckets = max(-(-size.bytes // RANGE_BYTES), 16) if buckets is None else buckets
    ranged = _ranges(keys.select("doc_id", "h"), buckets, size.n)
    # the first row of each range goes behind the range before, that of the first range behind the last
    heads = ranged(keys.select("doc_id", "h")).groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))  # a row for each range
    heads = materialize(heads.select(before.alias("range"), F.col("head.doc_id").alias("low"), F.col("head.h").alias("low_h")), "heads")
    few = F.broadcast(heads) if buckets <= BROADCAST_RANGES else heads
    firsts = rows.join(few, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h"))).groupBy("range").agg(F.min("text").alias("text"))
    extra = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("h"), "range", F.lit(1).alias("extra"))
    every = ranged(rows).withColumn("extra", F.lit(0)).unionByName(extra)
    own = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "h", "text")
    return every.withColumn("next_text", F.lead("text").over(own)).filter("extra = 0").select("doc_id", "text", "next_text")


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint every text, its edited version and their likeness (the contract of the query).

    The edited text has its last floor(n/2) code points replaced by the first as many of the
    next document. Likeness is 1 - |difference| / (items of both), 1 where neither has any;
    the differences are those that peeling recovers. Every row gives one row, whatever it
    holds; extra columns are ignored.
    """
    rows = with_next_text(docs, id_col, text_col, buckets)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.expr(items("text")).alias("own"), F.expr(items("edited")).alias("new"), F.expr(items("next_text")).alias("next"),
    )
    base = materialize(rows, "items")
    pairs = base.select(F.expr("stack(2, key * 2, own, new, key * 2 + 1, own, next) as (key, xs, ys)"))
    found = differences(pairs)
    found = found.groupBy(F.expr("key div 2").alias("key")).agg(
        *[F.max(F.when(F.col("key") % 2 == i, F.col(c))).alias(f"{c}_{i}") for i in (0, 1) for c in ("only_a", "only_b", "levels")]
    )
    near = lambda i, other: F.expr(f"if(size(own) + size({other}) = 0, 1D, 1D - (coalesce(only_a_{i}, 0) + coalesce(only_b_{i}, 0)) / cast(size(own) + size({other}) as double))")
    return base.join(found, "key", "left").select(
        "doc_id", "n_chars", "edited_sha256", F.expr(show(sketch("own"))).alias("fingerprint"), F.expr(show(sketch("new"))).alias("edited_fingerprint"),
        near(0, "new").alias("near_edited"), near(1, "next").alias("near_next"),
        F.coalesce("only_a_0", F.lit(0)).alias("removed"), F.coalesce("only_b_0", F.lit(0)).alias("added"), F.coalesce("levels_0", F.lit(1)).alias("levels"),
    )

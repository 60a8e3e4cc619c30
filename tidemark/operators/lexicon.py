"""Lexicon terms in texts: all terms found in one pass over each text, by an automaton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.io import bound_batches

#: terms of one automaton; a larger lexicon takes a pass for each so many
TERMS = 200_000
#: texts whose hits a worker holds as Python objects
TEXTS = 128
HIT = "array<struct<position:int,category:string,term:string,weight:int,n:bigint>>"


def normalised(lexicon: DataFrame, normalize) -> DataFrame:
    """``lexicon`` (position, category, term, weight) with ``norm``, the form that is looked for; empty and null forms are left out."""
    return lexicon.select("position", "category", "term", "weight", normalize(F.lower("term")).alias("norm")).filter("norm <> ''")


def _finder(terms):
    few = TEXTS

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        # one entry for each form, with all terms that have it
        found = ahocorasick.Automaton()
        for i, (*_, norm) in enumerate(terms.value):
            found.add_word(norm, [*found.get(norm, []), i])
        if len(found):
            found.make_automaton()
        values = terms.value
        kinds = {"position": pa.int32(), "category": pa.string(), "term": pa.string(), "weight": pa.int32()}
        lexicon = pa.StructArray.from_arrays([pa.array([x[k] for x in values], kind) for k, kind in enumerate(kinds.values())], list(kinds))
        for whole in batches:
            # hits are Python objects for a few texts at a time only, and leave as arrays
            for at in range(0, whole.num_rows, few):
                batch = whole.slice(at, few)
                which, times, upto = [], [], [0]
                for text in batch.column(batch.num_columns - 1):
                    counts, ends = {}, {}
                    for end, same in found.iter(text.as_py() or "") if len(found) else ():
                        norm = values[same[0]][-1]
                        # occurrences of one term do not overlap
                        if end - len(norm) >= ends.get(norm, -1):
                            ends[norm] = end
                            for i in same:
                                counts[i] = counts.get(i, 0) + 1
                    # the terms come sorted
                    which += (order := sorted(counts))
                    times += [counts[i] for i in order]
                    upto.append(len(which))
                hits = lexicon.take(pa.array(which, pa.int64())).flatten()
                rows = pa.StructArray.from_arrays([*hits, pa.array(times, pa.int64())], [*kinds, "n"])
                yield pa.record_batch([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows)], names=[*batch.schema.names[:-1], "hits"])

    return run


def term_hits(df: DataFrame, text: str, lexicon: DataFrame, normalize, keep: tuple[str, ...]) -> DataFrame:
    """TX1, JN12: the ``keep`` columns and ``hits``: the lexicon's terms that occur in the normalised text, in its order, with counts.

    ``lexicon`` has position (unique), category, term and weight. Terms match as substrings; a
    term's occurrences do not overlap. Null and empty texts have no hit. A term of two
    categories counts in both. Each text is read once for every ``TERMS`` terms.
    """
    terms = normalised(lexicon, normalize)
    n = terms.count()
    rows = df.select(*keep, normalize(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("hits_text"))
    bound_batches(df.sparkSession)
    passes = max(1, -(-n // TERMS))
    for part in range(passes):
        # at most TERMS rows
        own = terms.filter(F.pmod(F.xxhash64("position"), F.lit(passes)) == part)
        some = sorted(tuple(r) for r in own.select("position", "category", "term", "weight", "norm").collect())
        shared = df.sparkSession.sparkContext.broadcast(some)
        # the text comes back only where another pass reads it
        back = [f for f in rows.schema if f.name != "hits_text" or part < passes - 1]
        types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in back), f"hits {HIT}"])
        rows = rows.select(*[f.name for f in back], F.col("hits_text").alias("hits_copy")).mapInArrow(_finder(shared), types).withColumnRenamed("hits", f"hits_{part}")
    parts = [f"hits_{part}" for part in range(passes)]
    return rows.select(*keep, (F.col("hits_0") if passes == 1 else F.array_sort(F.concat(*parts))).alias("hits"))


def categories(hits: Column) -> Column:
    """TX1: map of category to its terms that were found, in the lexicon's order."""
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["category"])))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.transform(F.filter(hits, lambda x: x["category"] == k), lambda x: x["term"]))))


def weighted(hits: Column) -> Column:
    """TX2: sum of the weights of the categories that were found, each once by its largest weight."""
    names = F.array_distinct(F.transform(hits, lambda x: x["category"]))
    most = F.transform(names, lambda k: F.array_max(F.transform(F.filter(hits, lambda x: x["category"] == k), lambda x: x["weight"])))
    return F.aggregate(most, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def shares(hits: DataFrame, channel: str) -> DataFrame:
    """TX3: (channel, term, n, share): how often each term occurs in a channel's texts, and its part of the channel's hits.

    ``hits`` has the channel and the column of ``term_hits``. Terms that a channel never has get no row.
    """
    n = hits.select(channel, F.explode("hits").alias("x")).groupBy(channel, F.col("x.term").alias("term")).agg(F.sum("x.n").alias("n"))
    # a channel has at most a row for each term
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(channel)))

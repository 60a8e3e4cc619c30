"""Intake of seeds and entities: probes, marks, merges, resolution and search mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import key_forms


def listed(rows: DataFrame, name: str, blacklist: DataFrame, entry: str, how: str = "left_semi") -> DataFrame:
    """SRC3: ``rows`` whose name is on the blacklist (``left_anti``: is not): by itself, by its last path segment, or as the end of an entry's path.

    Both sides are brought to lower-case keys and joined on these; no row meets the whole list.
    """
    keys = blacklist.select(F.explode(key_forms(F.col(entry))).alias("_k")).filter("_k is not null").distinct()
    forms = key_forms(F.col(name))
    marked = rows.withColumns({"_a": forms[0], "_b": F.element_at(forms, -1)})
    for side in ("_a", "_b"):
        marked = marked.join(keys.withColumnRenamed("_k", f"{side}_hit"), F.col(side) == F.col(f"{side}_hit"), "left")
    hit = F.col("_a_hit").isNotNull() | F.col("_b_hit").isNotNull()
    return marked.filter(hit if how == "left_semi" else ~hit).select(*rows.columns)


def next_seeds(seeds: DataFrame, processed: str, order: list[str], k: int) -> DataFrame:
    """SRC5: the oldest unprocessed seeds; an unknown mark counts as unprocessed."""
    return seeds.filter(~F.coalesce(F.col(processed), F.lit(False))).orderBy(*order).limit(k)


def tokens_in(rows: DataFrame, key: str, tokens: Column, lexicon: DataFrame, term: str) -> DataFrame:
    """JN13, SET3: (key, n, terms): each row's distinct tokens that are terms, by an equi-join; rows without any are left out."""
    exploded = rows.select(key, F.explode(F.array_distinct(tokens)).alias(term))
    hits = exploded.join(lexicon.select(term).distinct(), term)
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(term)).alias("terms"))


def first_spellings(words: DataFrame, word: str, order: list[str]) -> DataFrame:
    """SET2: each word once without regard to case, in its first spelling."""
    ranked = words.filter(F.col(word).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(F.lower(F.trim(F.col(word)))).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def marks(seen: DataFrame, messages: DataFrame, key: str, number: str, ts: str, as_of: str, ttl_days: int = 30) -> DataFrame:
    """ST2: (key, mark, marked_at): the highest message number, which only grows while the old mark is no older than ``ttl_days``."""
    live = seen.filter(F.col("marked_at") >= F.expr(f"timestamp_ntz'{as_of}' - interval {ttl_days} days")).select(key, "mark", "marked_at")
    new = messages.groupBy(key).agg(F.max(number).alias("mark"), F.max(ts).alias("marked_at"))
    return live.unionByName(new).groupBy(key).agg(F.max("mark").alias("mark"), F.max("marked_at").alias("marked_at"))


def yields(known: DataFrame, found: DataFrame, gain: float = 0.02) -> DataFrame:
    """LM12: ``known`` (value, confidence, discoveries) after each row of ``found`` that names a value: one more, and ``gain`` of confidence up to 1."""
    n = found.groupBy("value").agg(F.count("*").alias("_n"))
    j, hits = known.join(n, "value", "left"), F.coalesce("_n", F.lit(0))
    return j.select("value", F.least(F.lit(1.0), F.col("confidence") + hits * gain).alias("confidence"), (F.col("discoveries") + hits).alias("discoveries"))


def query_mix(active: DataFrame, candidates: DataFrame, fallback: DataFrame, count: int, seed: int, exploit: float = 0.8) -> DataFrame:
    """LM13: (query, strategy) of ``count`` queries at most: active phrases for the exploiting share, candidates up to the whole, then fallbacks.

    Inputs have a column ``query`` of at most four words each; they are drawn by a seeded hash,
    and a query comes once, by the first strategy that has it. Each list is cut to ``count`` rows
    before they are put together.
    """
    plan = [("exploit", active, int(count * exploit)), ("explore", candidates, count), ("fallback", fallback, count)]
    short = F.size(F.split(F.col("query"), " ")) <= 4
    drawn, out = F.xxhash64("query", F.lit(seed)), None
    for place, (name, df, most) in enumerate(plan):
        clean = df.select(F.trim("query").alias("query")).filter(F.col("query") != "").filter(short | F.lit(name == "fallback")).distinct()
        rows = (clean if out is None else clean.join(out, "query", "left_anti")).orderBy(drawn, "query").limit(most)
        rows = rows.select("query", F.lit(name).alias("strategy"), F.lit(place).alias("_p"))
        out = rows if out is None else out.unionByName(rows).orderBy("_p", F.xxhash64("query", F.lit(seed)), "query").limit(most)
    return out.drop("_p")


def search_queries(seeds: DataFrame, seed: str, order: list[str], templates: dict[str, list[str]], otherwise: list[str], platform: str, limit: int | None = 50) -> DataFrame:
    """STR19: (platform, seed, query) of the first ``limit`` queries of a platform, by the seeds' order and then the templates'.

    Seeds count once without regard to case, in their first spelling; nulls do not count. ``{seed}`` in a template
    is the seed, ``{joined}`` the seed without spaces. ``otherwise`` serves platforms without templates.
    No limit gives all.
    """
    forms = templates.get(platform.lower().strip(), otherwise)
    made = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{joined}"), F.replace(F.col(seed), F.lit(" "), F.lit(""))), F.lit("{seed}"), F.col(seed)) for t in forms])
    rows = first_spellings(seeds, seed, order).select(*order, F.col(seed).alias("seed"), F.posexplode(made).alias("_i", "query"))
    rows = rows.select(F.lit(platform).alias("platform"), "seed", "query", *order, "_i")
    rows = rows.orderBy(*order, "_i").limit(limit) if limit is not None else rows
    return rows.select("platform", "seed", "query")


def checkpoints(log: DataFrame, keys: list[str], kind: str, fields: list[str], order: list[str]) -> DataFrame:
    """ST12: (keys, fields, status, number of the last change) of each search: its last saved state, ``reset`` if a reset came after.

    ``log`` has rows of ``kind`` ``save`` (fields and status) and ``reset``; the last by ``order``, which must be
    unique in a key, counts. A reset of a search that was never saved does nothing; after a reset the next save goes on.
    Partial maxima are taken before the shuffle, so a hot key sends a row from each task.
    """
    at = F.struct(*order)
    saved = F.max(F.when(F.col(kind) == "save", F.struct(at.alias("at"), F.struct(*fields, "status").alias("state"))))
    last = log.groupBy(*keys).agg(saved.alias("_s"), F.max(F.when(F.col(kind) == "reset", at)).alias("_r")).filter("_s is not null")
    reset = F.coalesce(F.col("_r") > F.col("_s.at"), F.lit(False))
    return last.select(*keys, *[F.col(f"_s.state.{f}").alias(f) for f in fields], F.when(reset, "reset").otherwise(F.col("_s.state.status")).alias("status"), F.when(reset, F.col("_r")).otherwise(F.col("_s.at")).alias("changed"))


def resume_point(saved: DataFrame, fresh: dict[str, Column]) -> DataFrame:
    """ST12: where a search goes on: its saved fields while it is in progress, else those of a new search."""
    live = F.col("status") == "in_progress"
    return saved.withColumns({f: F.when(live, F.col(f)).otherwise(v) for f, v in fresh.items()})


def ensure_vertices(vertices: DataFrame, found: DataFrame) -> DataFrame:
    """GR8: vertices (canonical_id, name, platform, url) with the found ones merged in.

    A found row is a known vertex if it has its canonical id, or its name and platform; then it
    only fills a missing url. Others are added, one for each canonical id.
    """
    f = found.filter(F.col("canonical_id").isNotNull()).groupBy("canonical_id").agg(F.min(F.struct("name", "platform", "url")).alias("x")).select("canonical_id", "x.*")
    by_name = vertices.groupBy("name", "platform").agg(F.min("canonical_id").alias("known"))
    known = vertices.select(F.col("canonical_id").alias("own")).distinct()
    f = f.join(known, f.canonical_id == known.own, "left").join(by_name, ["name", "platform"], "left").withColumn("at", F.coalesce("own", "known"))
    urls = f.filter("at is not null").groupBy("at").agg(F.min("url").alias("new_url"))
    merged = vertices.join(urls, vertices.canonical_id == urls["at"], "left").select("canonical_id", "name", "platform", F.coalesce("url", "new_url").alias("url"))
    return merged.unionByName(f.filter("at is null").select("canonical_id", "name", "platform", "url"))


def sync_edges(edges: DataFrame, legacy: DataFrame) -> DataFrame:
    """GR10: ``edges`` (source, target, relation, confidence, occurrences) and those of ``legacy`` that it lacks, with full confidence, once each."""
    key = ["source", "target", "relation"]
    new = legacy.select(*key).distinct().join(edges.select(*key), key, "left_anti")
    return edges.select(*key, "confidence", "occurrences").unionByName(new.select(*key, F.lit(100).alias("confidence"), F.lit(1).cast("long").alias("occurrences")))


def claim_order(rows: DataFrame, k: int) -> DataFrame:
    """TK11: the next ``k`` deliveries: priority, score, latest commercial or intent signal, fewest attempts, oldest campaign, then id."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in zip(("P0", "P1", "P2", "P3", "P4"), range(5), strict=True) for x in p]), F.coalesce("lead_priority", "priority", F.lit("P3"))), F.lit(5))
    seen = F.coalesce("commercial_last_seen", "intent_detected_at")
    return rows.orderBy(rank, F.desc(F.coalesce("lead_score", "score", F.lit(25))), F.desc_nulls_last(seen), "attempts", "created_at", "id").limit(k)


def expansion_candidates(rows: DataFrame, as_of: str, depth: int, k: int) -> DataFrame:
    """FLT12: the next ``k`` vertices to expand: not rejected, no invitation or administrator, described as there, not too
    deep, not looked at for three days, and worth it by score, tier, category or intent; best score first, then tier, then
    those never looked at, then the longest unseen, then id.
    """
    # fixed values: prefixes, descriptions and bounds
    name, about, last = F.col("name"), F.col("about"), F.col("last_scan")
    known = (F.col("status") != "rejected") & ~name.startswith("invite_") & ~name.startswith("admin_")
    there = about.isNull() | ~(about.startswith("Blacklisted entity") | about.startswith("Entity does not exist"))
    fresh = (F.col("depth").isNull() | (F.col("depth") < depth)) & (last.isNull() | (last < F.expr(f"timestamp_ntz'{as_of}' - interval 3 days")))
    category = F.coalesce(F.col("category") != "unknown", F.lit(False))
    worth = (F.coalesce("score", F.lit(0)) >= 40) | F.coalesce(F.col("tier").isin("A", "B", "C"), F.lit(False)) | category | F.coalesce(F.col("intent") >= 35, F.lit(False))
    rank = F.when(F.col("tier") == "A", 1).when(F.col("tier") == "B", 2).when(F.col("tier") == "C", 3).otherwise(4)
    return rows.filter(known & there & fresh & worth).orderBy(F.desc(F.coalesce("score", F.lit(0))), rank, F.asc_nulls_first(last), "id").limit(k)


def mined_contacts(found: DataFrame, key: str, confidence: str, reason: str, channel: str, snippet: str, order: list[str], most: int = 3) -> DataFrame:
    """AG22: (key, confidence, reasons, channels, snippets) of every contact: its sum, its reasons, how many channels, and the first ``most`` snippets."""
    from tidemark.operators.mining import first_rows

    sums = found.groupBy(key).agg(F.sum(confidence).alias("confidence"), F.array_sort(F.collect_set(reason)).alias("reasons"), F.countDistinct(channel).alias("channels"))
    return sums.join(first_rows(found, key, order, snippet, most).withColumnRenamed("first", "snippets"), key)

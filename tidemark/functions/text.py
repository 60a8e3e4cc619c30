"""Text operators as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: code points that the normalisers drop or unify
MARKS = "[ً-ْٰـ]"
ALEFS, YAAS = "أإآٱ", "ىئ"
ALEF, YAA, TAA, HAA = "ا", "ي", "ة", "ه"
ARABIC, LATIN = "[؀-ۿ]", "[A-Za-z]"


def normalize_arabic(c: Column, final_haa: bool = False) -> Column:
    """STR1: drop marks and elongation, unify alefs and yaas, collapse white space."""
    c = F.translate(F.regexp_replace(c, MARKS, ""), ALEFS + YAAS, ALEF * len(ALEFS) + YAA * len(YAAS))
    if final_haa:
        c = F.translate(c, TAA, HAA)
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_for_mining(c: Column) -> Column:
    """STR2: the miner's own normaliser: fewer alefs and yaas, white space stays."""
    return F.translate(F.regexp_replace(c, MARKS, ""), "أإآى", ALEF * 3 + YAA)


def script_ratio(c: Column) -> Column:
    """STR3: Arabic letters over Arabic and Latin letters, 3 places; 0 without letters."""
    a, b = F.regexp_count(c, F.lit(ARABIC)), F.regexp_count(c, F.lit(LATIN))
    return F.when(a + b > 0, F.bround(a / (a + b), 3)).otherwise(F.lit(0.0))


def word_count_of(c: Column, word: str) -> Column:
    """STR5: whole-word count; a border is anything but Latin letters, digits, underscore, Arabic."""
    return F.regexp_count(F.lower(c), F.lit(_whole_word(word)))


def has_word(c: Column, word: str) -> Column:
    """STR5: whether the whole word occurs; looks no further than its first place, and only where its letters occur at all."""
    lower = F.lower(c)
    return lower.contains(word.lower()) & lower.rlike(_whole_word(word))


def _whole_word(word: str) -> str:
    # the word comes first: a border that did would be tried at every character
    edge, w = "A-Za-z0-9_؀-ۿ", rf"\Q{word.lower()}\E"
    return rf"{w}(?![{edge}])(?<![{edge}]{w})"


def substring_count(c: Column, term: str) -> Column:
    """STR6: non-overlapping occurrences."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def clean_for_mining(c: Column) -> Column:
    """STR7: strip URLs, handles, phone numbers, and punctuation but for ``. , - : /``."""
    for pattern, by in ((r"https?://\S+", " "), (r"@\w+", " "), (r"\+?\d[\d\s-]{7,}\d", " "), (r"(?U)[^\w\s.,\-:/]", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """STR8: lower-case tokens of two characters and more, without stop words and pure digits."""
    kept = lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$") & (~t.isin(*stopwords) if stopwords else F.lit(True))
    return F.filter(F.split(F.lower(c), r"\s+"), kept)


def human_number(c: Column) -> Column:
    """STR9: ``1.2K``, ``3M``, ``1,234`` as a number; anything else is 0."""
    clean = F.upper(F.replace(F.trim(c), F.lit(","), F.lit("")))
    number = F.expr("1D") * F.regexp_extract(clean, r"^([0-9]*\.?[0-9]+)[KM]?$", 1).try_cast("double")
    unit = F.when(clean.endswith("K"), 1000).when(clean.endswith("M"), 1000000).otherwise(1)
    return F.coalesce((number * unit).cast("long"), F.lit(0).cast("long"))


def canonical_handle(c: Column) -> Column:
    """STR12: a handle without link prefix, query and ``@``, in lower case."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://)?(www\.)?[a-z0-9-]+\.[a-z]+/(s/)?", "")
    return F.regexp_replace(F.regexp_replace(c, r"[?#/].*$", ""), "^@", "")


def link_hosts(c: Column) -> Column:
    """TX18: hosts of all links, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"https?://([a-z0-9.-]+)"), F.lit(1))


def links(html: Column) -> Column:
    """SRC8: link targets of a page, in order; repeats stay."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def symbols(c: Column, prefixes: tuple[str, ...]) -> Column:
    """TX17: tickers of 3 to 10 letters (slash removed) with a known prefix, each once."""
    found = F.regexp_extract_all(F.replace(F.upper(c), F.lit("/"), F.lit("")), F.lit(r"\b([A-Z]{3,10})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: F.substring(s, 1, 3).isin(*prefixes)))


def message_errors(c: Column, longest: int = 4096) -> Column:
    """STR20: what is wrong with a message, as an array of names."""
    bare = F.trim(F.regexp_replace(c, r"https?://\S+", ""))
    checks = {"empty": F.trim(F.coalesce(c, F.lit(""))) == "", "too_long": F.length(c) > longest, "placeholder": c.rlike(r"\{[A-Za-z_]+\}"), "bad_url": c.rlike(r"https?://(\s|$)"), "links_only": (c.rlike("https?://")) & (bare == "")}
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]))


def matched_terms(c: Column, terms: list[str], normalize=normalize_arabic) -> Column:
    """TX1: the lexicon's terms (in its order and spelling) that occur as substrings of the normalised text."""
    norm = F.lower(normalize(c))
    return F.array_compact(F.array(*[F.when(norm.contains(t.lower()), F.lit(t)) for t in terms]))


def error_kind(c: Column) -> Column:
    """XT7: the kind of a failure by its message."""
    return F.when(c.ilike("%flood%") & ~c.ilike("%privacy%"), "flood").when(c.ilike("%privacy%"), "privacy").when(c.ilike("%not occupied%"), "missing").otherwise("other")


def invalid_handle(c: Column) -> Column:
    """XT9: a handle with anything but ASCII letters, digits and underscores, or shorter than four."""
    return (F.length(c) < 4) | c.rlike("[^A-Za-z0-9_]")


def clip(c: Column, most: int) -> Column:
    """STR15: the first ``most`` characters of a text whose runs of white space are one space each; a null is empty."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", ""), 1, most)


def json_list(c: Column) -> Column:
    """JS2: the elements of a JSON array, or of a JSON string that holds one, as texts; nested values stay JSON, nulls stay null.

    Anything else, a null and broken JSON among them, is an empty list.
    """
    outer = F.try_parse_json(c)
    held = F.try_parse_json(F.try_variant_get(outer, "$", "string"))
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    items = F.when(is_list(outer), F.try_variant_get(outer, "$", "array<variant>")).when(is_list(held), F.try_variant_get(held, "$", "array<variant>"))
    return F.coalesce(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def json_merge(a: Column, b: Column) -> Column:
    """JS3: two JSON objects' fields, the second's first; values keep their types, nested ones are not merged. What is no object counts as empty."""
    none = F.create_map().cast("map<string,variant>")
    fields = lambda j: F.coalesce(F.try_variant_get(F.try_parse_json(j), "$", "map<string,variant>"), none)
    x, y = fields(a), fields(b)
    return F.to_json(F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y))

"""Names, links and search words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ALEF, normalize_arabic

ARTICLE = ALEF + "ل"


def clean_handle(c: Column) -> Column:
    """STR14: a handle without leading ``@`` and ``/``, closing punctuation and edge underscores; null unless 3 to 35 characters stay.

    Underscores go only while more than three characters are left.
    """
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "^@+", ""), "^/+", "")
    c = F.regexp_replace(c, r"""[.,;:)!?*~`"'/\\]+$""", "")
    c = F.regexp_replace(F.regexp_replace(c, "(?<=.{3})_+$", ""), "^_+(?=.{3})", "")
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(c).between(3, 35), c)


def listed_once(items: Column, drop: str = "bot") -> Column:
    """TX15: items in order, each once by its lower-case form, the first spelling staying; those ending in ``drop`` go."""
    kept = F.filter(items, lambda x: ~F.lower(x).endswith(drop))
    lower = F.transform(kept, lambda x: F.lower(x))
    return F.filter(kept, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def query_variants(c: Column, most: int = 5) -> Column:
    """STR18: a keyword's search variants, each once, in fixed order, ``most`` at most: itself, normalised, with a
    final haa, without the article on words longer than three, with it on the first word, and with a word of its field."""
    word = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    bare = F.array_join(F.transform(F.split(word, " "), lambda w: F.when(w.startswith(ARTICLE) & (F.length(w) > 3), F.substring(w, 3, 1000)).otherwise(w)), " ")
    first = F.split(word, " ")[0]
    added = F.when(~first.startswith(ARTICLE) & (F.length(first) > 2) & first.rlike("[؀-ۿ]"), F.concat(F.lit(ARTICLE), word))
    # fixed values: words of the field
    field = (
        F.when(word.contains("ذهب") | F.lower(word).contains("gold"), F.concat(word, F.lit(" XAUUSD"))).when(word.contains("فوركس"), F.concat(word, F.lit(" Forex")))
        .when(word.contains("توصيات"), F.concat(word, F.lit(" VIP"))).when(F.lower(word).rlike("smc|ict"), F.concat(word, F.lit(" تحليل")))
    )
    every = F.array(word, normalize_arabic(word), normalize_arabic(word, final_haa=True), bare, added, field)
    return F.when(word != "", F.slice(F.array_distinct(F.array_compact(every)), 1, most)).otherwise(F.array().cast("array<string>"))


def canonical_identity(platform: Column, identifier: Column) -> Column:
    """STR13: ``platform:name`` in lower case from a handle or link, without scheme, query and edge slashes; empty where no name stays.

    A messenger's name keeps its path; a video site's ends at the first slash; of a page site it is the group, the last part
    under ``pages``, else the first part; a web page is its host without ``www.`` and its path, whose case stays. Other
    platforms' identifiers are only trimmed. A null platform or identifier gives an empty text.
    """
    kind, raw = F.lower(F.trim(F.coalesce(platform, F.lit("")))), F.trim(F.coalesce(identifier, F.lit("")))

    def bare(hosts: str) -> Column:
        return F.regexp_replace(F.regexp_replace(raw, rf"(?i)^https?://{hosts}/", ""), r"(?s)\?.*$", "")

    unsigned = lambda x: F.regexp_replace(x, "^@+", "")
    unslashed = lambda x: F.regexp_replace(x, "^/+|/+$", "")
    page = unslashed(bare(r"(?:www\.|m\.)?facebook\.com"))
    parts = F.split(page, "/")
    page = F.when(page.startswith("groups/"), F.get(parts, F.lit(1))).when(page.startswith("pages/"), F.element_at(parts, -1)).otherwise(F.get(parts, F.lit(0)))
    site = F.regexp_replace(raw, "^https?://", "")
    host, path = F.lower(F.regexp_extract(site, "^[^/?#]*", 0)), F.regexp_extract(site, "^[^/?#]*([^?#;]*)", 1)
    name = (
        F.when(kind == "telegram", F.lower(F.trim(unslashed(unsigned(bare(r"(?:www\.)?(?:t\.me|telegram\.me)"))))))
        .when(kind == "tiktok", F.lower(F.trim(F.split(unsigned(bare(r"(?:www\.)?tiktok\.com")), "/")[0]))).when(kind == "facebook", F.lower(page))
        .when(kind == "web", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))).otherwise(F.lower(raw))
    )
    return F.when(name != "", F.concat(kind, F.lit(":"), name)).otherwise("")


def redirect_target(c: Column, host: str, parameter: str = "u", prefix: str = "a1") -> Column:
    """STR21: the url that a redirect page of ``host`` carries in base64; any other url, and one that does not decode, stays."""
    raw = F.regexp_extract(c, rf"[?&]{parameter}={prefix}([A-Za-z0-9+/_-]+)", 1)
    padded = F.rpad(F.translate(raw, "-_", "+/"), F.ceil(F.length(raw) / 4).cast("int") * 4, F.lit("="))
    return F.when(c.contains(host) & (raw != ""), F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), c)).otherwise(c)


def job_payload(c: Column) -> Column:
    """JS4: struct (id, payload) of a job: an envelope's fields, an old job's own object, or a raw string as its id."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    inner = F.get_json_object(c, "$.payload")
    return F.struct(
        F.when(is_object, F.coalesce(F.get_json_object(c, "$.id"), F.get_json_object(c, "$.channel"))).otherwise(F.trim(c)).alias("id"),
        F.when(is_object, F.coalesce(inner, c)).alias("payload"),
    )


def key_forms(c: Column) -> Column:
    """SRC3: the lower-case forms under which a name or link may be listed: as it is, and its last path segment."""
    lower = F.lower(F.trim(c))
    return F.array_distinct(F.array(lower, F.trim(F.element_at(F.split(lower, "/"), -1))))

"""Web pages: elements picked out of HTML by a scanner with a stack, previews of channels and profiles made of them."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import human_number
from tidemark.sources.io import bound_batches


class Pick(NamedTuple):
    """An element to pick: tag, the attribute that must have (as ``class``: contain) the value, and an attribute to return."""

    field: str
    tag: str
    attribute: str | None = None
    value: str | None = None
    take: str | None = None


# fixed values: marks of the preview pages
PREVIEW = (
    Pick("title", "meta", "property", "og:title", "content"),
    Pick("about", "meta", "property", "og:description", "content"),
    Pick("info", "div", "class", "tgme_channel_info"),
    Pick("extra", "div", "class", "tgme_page_extra"),
    Pick("counter", "div", "class", "tgme_channel_info_counter"),
    Pick("count", "span", "class", "counter_value"),
    Pick("kind", "span", "class", "counter_type"),
    Pick("post", "div", "class", "tgme_widget_message", "data-post"),
    Pick("text", "div", "class", "tgme_widget_message_text"),
    Pick("at", "time", None, None, "datetime"),
    Pick("views", "span", "class", "tgme_widget_message_views"),
)
# fixed values: marks of profile pages and sites
PROFILE = (
    Pick("og_title", "meta", "property", "og:title", "content"),
    Pick("og_about", "meta", "property", "og:description", "content"),
    Pick("about", "meta", "name", "description", "content"),
    Pick("title", "title"),
    Pick("link", "a", None, None, "href"),
)
# fixed values: tags without an end tag
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())

#: pages whose elements a worker holds as Python objects
PAGES = 32

FOUND = "array<struct<field: string, text: string, taken: string, last: int>>"


def _scanner(picks: tuple[Pick, ...], ended: bool):
    """The worker's code; all of it is inside, so that workers need no module of this package."""
    wanted: dict[str, list[tuple]] = {}
    for p in picks:
        wanted.setdefault(p.tag, []).append(tuple(p))
    void, few = VOID, PAGES
    # every branch ends at the end of the page if it is not closed, so nothing is read twice
    tag = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:(>)|\Z))""", re.S)
    attribute = re.compile(r"""([^\s=>"'/][^\s=>/]*+)\s*+(?:=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"']\S*+)))?""")
    raw_end = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}
    found = pa.list_(pa.struct([("field", pa.string()), ("text", pa.string()), ("taken", pa.string()), ("last", pa.int32())]))
    reference = re.compile(r"&(#[0-9]++|#[xX][0-9A-Fa-f]++|[A-Za-z][A-Za-z0-9]*+);")

    def one(m: re.Match) -> str:
        return entities.unescape(m[0]) if m[1].startswith("#") or m[1] + ";" in html5 else m[0]

    decoded = (lambda text: reference.sub(one, text)) if ended else entities.unescape

    def attributes(source: str) -> dict[str, str]:
        return {m[1].lower(): decoded(m[2] or m[3] or m[4] or "") for m in attribute.finditer(source)}

    def scan(page: str) -> list[dict]:
        out, parts, stack, opened, at = [], [], [], Counter(), 0

        def close(picked):
            for i in picked:
                out[i]["text"] = "".join(parts[out[i]["text"] :])
                out[i]["last"] = len(out) - 1

        while at < len(page):
            m = tag.search(page, at)
            if m is None or m.start() > at:
                parts.append(decoded(page[at : m.start() if m else len(page)]))
            if m is None:
                break
            at = m.end()
            if m[4] is None:
                continue
            name = m[2].lower()
            if m[1]:
                # an end tag closes what is open inside of it too; one of an element that is not open is nothing
                while opened[name]:
                    top, picked = stack.pop()
                    opened[top] -= 1
                    close(picked)
                    if top == name:
                        break
                continue
            picked = []
            if name in wanted:
                has = attributes(m[3])
                for field, _, key, value, take in wanted[name]:
                    own = has.get(key, "") if key else None
                    if key is None or (key in has and (value in own.split() if key == "class" else own == value)):
                        picked.append(len(out))
                        out.append({"field": field, "text": len(parts), "taken": has.get(take) if take else None, "last": 0})
            if name in void or m[3].rstrip().endswith("/"):
                close(picked)
            elif name in raw_end:
                end = raw_end[name].search(page, at)
                close(picked)
                at = end.start() if end else len(page)
            else:
                stack.append((name, picked))
                opened[name] += 1
        while stack:
            close(stack.pop()[1])
        return out

    def run(pages: pa.Array) -> pa.Array:
        # a batch's elements are Python objects for a few pages at a time only
        done = [pa.array([scan(p.as_py() or "") for p in pages.slice(at, few)], found) for at in range(0, len(pages), few)]
        return pa.concat_arrays(done) if done else pa.array([], found)

    return run


def elements(page: Column, picks: tuple[Pick, ...], ended: bool = False) -> Column:
    """SRC8-SRC10: the picked elements of a page in the order of their start tags, one array.

    Each has its field, its text with that of all elements inside (entities decoded, comments,
    scripts and styles left out), the taken attribute (null without it), and the index of the
    last picked element inside of it. An end tag closes all that is open inside of its element;
    one without an open element, and anything after a quote or tag that never ends, is no
    element. Elements that are open at the end close there. Of a repeated attribute the last
    counts. Null and empty pages have none. Time grows with the page; a picked element inside
    another picked one repeats its text. Entities are decoded as parsers do, some of them without
    their semicolon too; with ``ended`` only those that have it, so one that was cut off stays.
    Workers get batches of 16 MB, where the session has Spark's default.
    """
    bound_batches(SparkSession.active())
    return F.arrow_udf(_scanner(tuple(picks), ended), FOUND)(page)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _of(found: Column, field: str) -> Column:
    return F.filter(found, lambda x: x["field"] == field)


def _inside(found: Column, field: str, of: str) -> Column:
    """For each ``of`` element: the elements from it to the last one inside."""
    at = F.transform(found, lambda x, i: F.struct(x["field"].alias("field"), i.alias("i"), x["last"].alias("last")))
    return F.transform(F.filter(at, lambda x: x["field"] == of), lambda o: F.slice(found, o["i"] + 1, o["last"] - o["i"] + 1))


def _first(found: Column, field: str, part: str) -> Column:
    return F.get(_of(found, field), F.lit(0))[part]


def _ascii_digits(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def counter(c: Column) -> Column:
    """A counter's value: ``1.2K``, ``3M`` or whole digits with commas; null for anything else."""
    clean = F.upper(_strip(c))
    scaled = F.regexp_extract(clean, r"^\s*(\d+\.?\d*|\.\d+)\s*[KM]$", 1).try_cast("double") * F.when(clean.endswith("K"), 1000).otherwise(1000000)
    return F.coalesce(scaled.cast("long"), F.regexp_replace(clean, ",", "").try_cast("long"))


def preview(found: Column, name: Column) -> Column:
    """SRC9: struct (exists, is_channel, is_group, title, description, member_count, avg_views) of a preview page.

    ``found`` has the elements of ``PREVIEW``. A page without a title, or with the placeholder
    for ``name``, and without a description does not exist: false, empty and 0. So does one
    whose title or description tag has no content. Members come from the last counter of members
    or subscribers that is a number; digits before one of these words in the extra line go
    first, and ``members`` there makes a group. Views count if above 0.
    """
    title, about = _first(found, "title", "taken"), _first(found, "about", "taken")
    broken = ((F.size(_of(found, "title")) > 0) & title.isNull()) | ((F.size(_of(found, "about")) > 0) & about.isNull())
    title, about = F.coalesce(title, F.lit("")), F.coalesce(about, F.lit(""))
    nameless = (title == "") | title.eqNullSafe(F.concat(F.lit("Telegram: Contact @"), name))
    exists = ~broken & ~(nameless & (about == ""))
    channel = exists & F.exists(found, lambda x: x["field"].isin("info", "extra"))

    blocks = _inside(found, "counter", "counter")
    counts = F.transform(blocks, lambda b: F.when(F.lower(_first(b, "kind", "text")).rlike("subscriber|member"), counter(_first(b, "count", "text"))))
    members = F.element_at(F.concat(F.array(F.lit(0).cast("long")), F.array_compact(counts)), -1)
    extra = F.lower(_strip(_first(found, "extra", "text")))
    for word in ("members", "subscribers"):
        digits = F.regexp_replace(_ascii_digits(F.substring_index(extra, word, 1)), r"\D", "")
        members = F.when(extra.contains(word), F.coalesce(digits.try_cast("long"), members)).otherwise(members)
    views = F.filter(F.transform(_of(found, "views"), lambda x: human_number(_strip(x["text"]))), lambda n: n > 0)
    mean = F.when(F.size(views) > 0, F.floor(F.aggregate(views, F.lit(0).cast("long"), lambda a, n: a + n) / F.size(views))).otherwise(0)
    zero = lambda x: F.when(channel, x).otherwise(0).cast("long")
    return F.struct(
        exists.alias("exists"), channel.alias("is_channel"), (channel & F.coalesce(extra.contains("members"), F.lit(False))).alias("is_group"),
        F.when(exists, title).otherwise("").alias("title"), F.when(exists, about).otherwise("").alias("description"), zero(members).alias("member_count"), zero(mean).alias("avg_views"),
    )


def posts(df: DataFrame, keys: list[str], found: str) -> DataFrame:
    """SRC9: one row (keys, message_id, text, at, views) for each message of a preview page.

    The number is what follows the last slash of the message's mark; messages without one, or
    with 0, or without a readable time are left out. Text, time and views are the first inside of
    the message; a missing text is empty, missing or unreadable views are 0.
    """
    block = F.explode(_inside(F.col(found), "post", "post")).alias("_b")
    b = F.col("_b")
    number = F.element_at(F.split(_first(b, "post", "taken"), "/"), -1).try_cast("long")
    rows = df.select(*keys, block).select(
        *keys, number.alias("message_id"), F.coalesce(_strip(_first(b, "text", "text")), F.lit("")).alias("text"),
        F.try_to_timestamp(_first(b, "at", "taken")).alias("at"), F.coalesce(human_number(_strip(_first(b, "views", "text"))), F.lit(0)).alias("views"),
    )
    return rows.filter("message_id <> 0 and at is not null")


def profile(found: Column, name: Column, by_title: bool = False) -> Column:
    """SRC8, SRC10: struct (title, description, links) of a profile, or of a site with ``by_title``.

    ``found`` has the elements of ``PROFILE``. A profile's title is its ``og:title``, a site's
    the title element; ``name`` where there is none, and for a site where it is empty. The
    description is ``og:description``, else the plain one, else empty. Links are all targets in order.
    """
    content = lambda field: F.coalesce(_first(found, field, "taken"), F.lit(""))
    if by_title:
        title = F.coalesce(F.nullif(_strip(_first(found, "title", "text")), F.lit("")), name)
    else:
        title = F.when(F.size(_of(found, "og_title")) > 0, _strip(content("og_title"))).otherwise(name)
    about = F.when(F.size(_of(found, "og_about")) > 0, content("og_about")).otherwise(content("about"))
    links = F.array_compact(F.transform(_of(found, "link"), lambda x: x["taken"]))
    return F.struct(title.alias("title"), _strip(about).alias("description"), links.alias("links"))

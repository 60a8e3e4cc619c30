"""Fill-in-the-middle transformation by escaped marker injection, with SQL functions only.

The text's units (a word with the white space before it, or white space alone) get a delimiter
appended by one ``regexp_replace``. The delimiter is a control character that is escaped in the
text first, so that counting it counts the units and ``substring_index`` cuts after any unit.
The parts lose their delimiters, are unescaped and put together around the three markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: a unit; ``*+`` never gives back what it took, so a long run of white space is read once
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: neither is white space, and escaping makes characters of a word into such characters only
MARK, ESCAPE = "\x01", "\x02"
#: prefix, suffix, middle
MARKERS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80


def _swap(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def _escaped(x: Column) -> Column:
    return _swap(_swap(x, ESCAPE, ESCAPE + "0"), MARK, ESCAPE + "1")


def _plain(x: Column) -> Column:
    """A part without its delimiters, as it was before escaping."""
    return _swap(_swap(_swap(x, MARK, ""), ESCAPE + "1", MARK), ESCAPE + "0", ESCAPE)


def _cut(x: str, count: str) -> Column:
    return F.expr(f"substring_index(`{x}`, '\\u{ord(MARK):04x}', cast({count} as int))")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` with fim_n (units), fim_form, fim_prefix, fim_middle, fim_suffix and fim_output.

    The sha256 of ``seed:id`` gives the two cuts and the form, so a row is treated alike wherever
    it is; a null id hashes as an empty one. ``plain`` rows (by chance, empty and null texts,
    texts that hold a marker) keep their text as output and have null parts. Texts are cut whole,
    however long. Repeated rows come back as often; an empty table stays empty. Other columns
    stay, but for those of the six names.
    """
    text, marked, head, cuts, sha = (free_name(docs, f"fim_{x}") for x in ("text", "marked", "head", "cuts", "sha"))
    part = lambda k: F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long")
    p, s, m = (F.lit(x) for x in markers)
    rows = docs.withColumns({text: F.coalesce(F.col(f"`{text_col}`"), F.lit("")), sha: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)})
    rows = rows.withColumn(marked, F.regexp_replace(_escaped(F.col(text)), UNIT, "$0" + MARK))
    rows = rows.withColumn("fim_n", (F.length(marked) - F.length(_swap(F.col(marked), MARK, ""))).cast("long"))
    a, b = part(0) % (F.col("fim_n") + 1), part(1) % (F.col("fim_n") + 1)
    rows = rows.withColumn(cuts, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    held = F.contains(F.col(text), p) | F.contains(F.col(text), s) | F.contains(F.col(text), m)
    rows = rows.withColumn("fim_form", F.when((F.col(text) == "") | held | (part(2) % 100 >= fim_percent), "plain").when(part(3) % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumn(head, _cut(marked, f"{cuts}.b"))
    cut = lambda x: F.when(F.col("fim_form") != "plain", _plain(x))
    rows = rows.withColumns({
        "fim_prefix": cut(_cut(marked, f"{cuts}.a")),
        # the first b units have b - 1 delimiters between them, so the last b - a of them lie right of the a-th
        "fim_middle": cut(_cut(head, f"{cuts}.a - {cuts}.b")),
        "fim_suffix": cut(_cut(marked, f"{cuts}.b - fim_n - 1")),
    })
    psm = F.concat(p, "fim_prefix", s, "fim_suffix", m, "fim_middle")
    spm = F.concat(s, "fim_suffix", p, "fim_prefix", m, "fim_middle")
    rows = rows.withColumn("fim_output", F.when(F.col("fim_form") == "plain", F.col(text)).when(F.col("fim_form") == "psm", psm).otherwise(spm))
    return rows.drop(text, marked, head, cuts, sha)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``transform`` made ``output`` from.

    An output that is not plain holds each marker once: the parts hold none, and no marker can
    begin within another. A plain output is its text; nulls give null.
    """
    p, s, m = markers
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    middle = after(output, m)
    psm = F.concat(after(before(output, s), p), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, after(before(output, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: units, form, lengths of the parts, sha256 of the output and of the text rebuilt from it."""
    rows = transform(docs.select("doc_id", "text"))
    sha = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return rows.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.length("fim_prefix").cast("long").alias("prefix_chars"), F.length("fim_middle").cast("long").alias("middle_chars"),
        sha(F.col("fim_output")).alias("output_sha256"), sha(restore(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"),
    )

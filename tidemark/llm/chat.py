"""Preference formatting with DataFrame functions only.

A pair's chosen and rejected conversations share a prefix of turns. The longest such prefix
is rendered once as the prompt; what follows in each is rendered as its completion, with the
character spans of the trained role's contents as loss mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '\\n', t.text, '{CLOSE}\\n')), '')"


def _mask(turns: str, trained: str) -> str:
    """array<struct<start, end>>: where the trained role's contents and their end marks stand."""
    head = f"length(concat('{OPEN}', t.role, '\\n'))"
    body = f"length(concat(t.text, '{CLOSE}'))"
    return f"""aggregate({turns}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
        (s, t) -> named_struct('at', s.at + {head} + {body} + 1,
            'out', if(t.role = '{trained}', array_append(s.out, named_struct('start', s.at + {head}, 'end', s.at + {head} + {body})), s.out)),
        s -> s.out)"""


def preference_format(pairs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Format (pair_id, chosen, rejected), two arrays of struct(role, text), one row each.

    Adds ``shared_turns``, ``prompt``, ``chosen``/``rejected`` as completions and
    ``chosen_mask``/``rejected_mask``. Turns are equal if role and text are (null: empty).
    A null conversation counts as one without turns; a pair without common turns has an
    empty prompt; where one conversation is the other's prefix its completion is empty.
    """
    clean = lambda c: f"transform(coalesce({c}, array()), t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))"
    df = pairs.select("pair_id", F.expr(clean("chosen")).alias("c"), F.expr(clean("rejected")).alias("r"))
    df = df.withColumn("differ", F.expr("array_position(zip_with(c, r, (x, y) -> x is not null and y is not null and x = y), false)"))
    df = df.withColumn("shared_turns", F.expr("cast(if(differ = 0, size(c), differ - 1) as int)"))
    rest = lambda c: f"slice({c}, shared_turns + 1, greatest(size({c}), 1))"
    return df.select(
        "pair_id", "shared_turns", F.expr(_rendered("slice(c, 1, shared_turns)")).alias("prompt"),
        F.expr(_rendered(rest("c"))).alias("chosen"), F.expr(_rendered(rest("r"))).alias("rejected"),
        F.expr(_mask(rest("c"), trained)).alias("chosen_mask"), F.expr(_mask(rest("r"), trained)).alias("rejected_mask"),
    )


def pair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pair conversation 2i (chosen) with 2i + 1 (rejected): (pair_id, chosen, rejected).

    Turns are ordered by number, then role and text; rows with a null conversation are left
    out, repeated rows are repeated turns. A side without rows is null. Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t")).filter("conv is not null")
    side = lambda k: F.expr(f"nullif(transform(array_sort(collect_list(case when pmod(conv, 2) = {k} then t end)), t -> named_struct('role', t.role, 'text', t.text)), array())")
    return rows.groupBy(F.expr("(conv - pmod(conv, 2)) div 2").alias("pair_id")).agg(side(0).alias("chosen"), side(1).alias("rejected"))

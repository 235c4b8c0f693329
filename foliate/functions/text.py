"""Text, hash and regex helpers shared by the operators. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every Unicode white space character (``trim`` alone takes only blanks)."""
    return F.btrim(col(c), F.lit(K.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def java(pattern: str) -> str:
    """Shared pattern text as Java regex: case folding over all letters, not only ASCII."""
    return pattern.replace("(?i)", "(?iu)", 1)


def matches(c: Column | str, pattern: str) -> Column:
    return F.rlike(col(c), F.lit(java(pattern)))


def holds_any(name: str, literals: Sequence[str]) -> Column:
    """Byte search of a column for any of the literals, much cheaper than a pattern.

    Written as one SQL expression: hundreds of single Column calls would slow down building a query.
    """
    quoted = [literal.replace("'", "\\'") for literal in literals]
    return F.expr(" OR ".join(f"contains(`{name}`, '{q}')" for q in quoted))


def at_line(pattern: str, ignore_case: bool = False) -> str:
    """Anchor a pattern at line starts; only ``\\n`` ends a line."""
    return f"(?{'iu' if ignore_case else ''}md)^(?:{pattern})"


def find_all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(java(pattern)), F.lit(0))


def words(c: Column | str) -> Column:
    """Lower-cased words; a word is a run of letters, digits and underscores."""
    return find_all(F.lower(col(c)), f"(?:[a-z0-9_]++|[{K.WORD}])++")


# The first branch of each takes the usual characters by two range tests; the second is complete.
_TOKEN = rf"(?:[!-~\x{{a1}}-\x{{167f}}]++|[^{K.WS}])++"
_GAP = rf"(?: ++|[{K.WS}])++"


def has_more_tokens(c: Column | str, n: int) -> Column:
    """More than ``n`` white-space separated tokens; stops reading at token ``n`` + 1."""
    return F.rlike(col(c), F.lit(rf"\A(?:{_GAP})?+(?:{_TOKEN}{_GAP}){{{n}}}[^{K.WS}]"))


def word_profile(c: Column | str) -> Column:
    """``struct<total, unique, top>`` of the words: sort, then one pass over the runs of equal words."""
    zero = {"run": 0, "top": 0, "unique": 0, "total": 0}
    start = F.struct(F.lit(None).cast("string").alias("last"), *[F.lit(v).alias(k) for k, v in zero.items()])

    def step(acc: Column, word: Column) -> Column:
        same = acc["last"].eqNullSafe(word)
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            word.alias("last"),
            run.alias("run"),
            F.greatest(acc["top"], run).alias("top"),
            F.when(same, acc["unique"]).otherwise(acc["unique"] + 1).alias("unique"),
            (acc["total"] + 1).alias("total"),
        )

    return F.aggregate(F.sort_array(words(c)), start, step)


def sha(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def short_hash(c: Column | str) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(sha(c), 1, 16)


def block_id(kind: Column | str, number: Column, hint: Column | None = None) -> Column:
    """``blk_<first 3 letters>_<number, at least 4 digits>_<12 hex digits>``.

    ``format_string`` pads without cutting numbers of five digits and more, ``lpad`` would cut.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    number = number.cast("bigint")
    seed = F.concat(kind, F.lit(":"), number.cast("string"), F.lit(":"), hint if hint is not None else F.lit(""))
    return F.format_string("blk_%s_%04d_%s", F.substring(kind, 1, 3), number, F.substring(sha(seed), 1, 12))


def run_of(text: Column) -> Column:
    """One plain run."""
    return F.array(
        F.struct(
            text.alias("text"),
            F.lit(False).alias("bold"),
            F.lit(False).alias("italic"),
            F.lit(False).alias("underline"),
            F.lit(False).alias("strike"),
            F.lit(None).cast("string").alias("font_name"),
            F.lit(None).cast("double").alias("font_size"),
            F.lit(None).cast("string").alias("color"),
            F.lit(None).cast("string").alias("highlight"),
        )
    )


def runs_text(runs: Column) -> Column:
    """Text of an ``array<struct<text, …>>``."""
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def quoted_list(items: Column) -> Column:
    """``['a', 'b']``, as list values are written inside messages."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, K.HIGH).when(confidence >= 0.7, K.MEDIUM).otherwise(K.LOW)


def first_of(pairs: Sequence[tuple[Column, Column | str]], otherwise: Column | None = None) -> Column:
    """Ordered ``when`` chain; stays one expression, so later tests run only where earlier fail."""
    chain = None
    for condition, value in pairs:
        value = F.lit(value) if not isinstance(value, Column) else value
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def present(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Array of the values whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(value)) for condition, value in pairs]))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    A filter on a projected column is pushed below the projection by copying its expression, so a
    chain of regular expressions would run again for the filter. Filters are not pushed through a
    generator; one row of one struct costs next to nothing.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

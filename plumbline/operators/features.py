"""Heuristic features of tokens, fit on a corpus: syntax, place, frequency and context, as windows over one dealing of the texts."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import dealt, kept

KEYWORDS = sorted(keyword.kwlist)
# Token classes by their signs.
OPERATORS = "+ - * / = == != < > <= >= && || ! & | ^".split()
BRACKETS, OPENING = "( ) [ ] { }".split(), "( [ {".split()
PUNCTUATION = ", ; : . ?".split()
SPECIAL = "!@#$%^&*()_+-=[]{}|;:,.<>?"

NUMERIC = r"^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN]))$"
QUOTED = r"""(?s)^(".*"|'.*'|"|')$"""
WORDLIKE = r"^[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*$"

#: Names of the features beside the one-hot ones.
NAMES = (
    "is_keyword is_operator is_bracket is_punctuation is_numeric is_string length has_special "
    "relative log_start log_end line_start in_line indent after_equals freq_rank log_freq near_length before_bracket after_dot before_equals in_def wordlike nesting"
).split()


def is_numeric(token: Column) -> Column:
    return token.rlike(NUMERIC)


def is_quoted(token: Column) -> Column:
    return token.rlike(QUOTED)


def has_special(token: Column) -> Column:
    return F.translate(token, SPECIAL, "") != token


def wordlike(token: Column) -> Column:
    return token.rlike(WORDLIKE) & ~token.isin(KEYWORDS) & ~is_numeric(token)


def indent(token: Column) -> Column:
    """Leading blanks (a tab counts four) by 20, 1 at most."""
    lead = F.regexp_extract(token, "^[ \t]*", 0)
    return F.least((F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit(""))))) / 20, F.lit(1.0))


def log_scaled(value: Column, scale: Column | float) -> Column:
    """ln(value + 1) by scale, 1 at most."""
    return F.least(F.log(value + 1) / scale, F.lit(1.0))


def fit(tokens: DataFrame, top: int, key: str = "problem_id", pos: str = "pos", token: str = "token") -> tuple[DataFrame, DataFrame, list[str]]:
    """(token, n, rank), (log_scale) and the `top` commonest tokens of the corpus.

    The scale is ln(1 + the 95th percentile of places, from 1), taken from counts by place.
    The ranks are a written table: tokens are counted once for all that asks for them.
    """
    from plumbline.operators.tokens import frequency_ranks

    ranks = kept(tokens.sparkSession, frequency_ranks(tokens, token), "ranks")
    places = tokens.groupBy(pos).agg(F.count("*").alias("_n"))
    scale = places.agg(F.log(F.percentile(F.col(pos) + 1, F.lit(0.95), F.col("_n")) + 1).alias("log_scale"))
    common = [r[0] for r in ranks.orderBy(F.desc("n"), token).limit(top).collect()]  # `top` rows
    return ranks, scale, common


#: Tokens so frequent that their ranks go to all tasks; of a corpus of 209 M tokens a ninth is none of them.
FREQUENT = 20_000

#: What a token's signs tell, as bits of one number: the features of that name, and what its neighbours ask for.
FLAGS = "is_keyword is_operator is_bracket is_punctuation is_numeric is_string has_special wordlike opening dot equals plain_equals opens closes definition".split()
OWN = ("_flags", "_length", "_breaks", "_tail", "_indent", "_top")


def _bare(t: Column) -> Column:
    return F.trim(t, F.lit(" \t\n\r\f\x0b"))


def _own(t: Column, common: list[str], definition: str) -> list[Column]:
    """OWN of a token: its flags, signs, line breaks, signs behind the last break, indentation, and its place (from 1) among the common ones."""
    bare, breaks = _bare(t), F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    tests = (
        bare.isin(KEYWORDS),
        bare.isin(OPERATORS),
        bare.isin(BRACKETS),
        bare.isin(PUNCTUATION),
        is_numeric(bare),
        is_quoted(bare),
        has_special(t),
        wordlike(bare),
        bare.isin(OPENING),
        bare == ".",
        bare == "=",
        t == "=",
        t.isin("(", "[", "{"),
        t.isin(")", "]", "}"),
        bare == definition,
    )
    flags = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))
    tail = F.when(breaks > 0, F.length(F.element_at(F.split(t, "\n", -1), -1))).otherwise(F.length(t))
    made = (flags, F.length(t), F.coalesce(breaks, F.lit(0)), tail, indent(t), F.array_position(F.array(*map(F.lit, common)).cast("array<string>"), t))
    return [c.alias(name) for c, name in zip(made, OWN, strict=True)]


def _has(flags: Column | str, name: str) -> Column:
    flags = F.col(flags) if isinstance(flags, str) else flags
    return flags.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def _ranked(d: DataFrame, ranks: DataFrame, common: list[str], definition: str, key: str, pos: str, token: str) -> DataFrame:
    """key, pos, _n, _rank and OWN of each token.

    What a token's signs tell is worked out once for each that the ranks know.
    The FREQUENT most frequent tokens are looked up in a table of that many
    rows, and their rows aren't exchanged; of any other there is less than a
    FREQUENT-th of all rows, so that no key is hot where the rest is joined.
    """
    known = lambda r: r.select(F.col(token).alias("_token"), F.col("n").alias("_n"), F.col("rank").alias("_rank"), *_own(F.col(token), common, definition))
    most = F.broadcast(known(ranks.orderBy(F.desc("n"), token).limit(FREQUENT)))
    same = F.col(token) == F.col("_token")
    hot = d.join(most, same).select(key, pos, "_n", "_rank", *OWN)
    rest = d.join(most, same, "left_anti").join(known(ranks), same, "left")
    new = _own(F.col(token), common, definition)  # of tokens that the ranks don't know
    return hot.union(rest.select(key, pos, "_n", "_rank", *[F.coalesce(F.col(name), c).alias(name) for name, c in zip(OWN, new, strict=True)]))


def extract(tokens: DataFrame, ranks: DataFrame, scale: DataFrame, common: list[str], definition: str = "def", key: str = "problem_id", pos: str = "pos", token: str = "token", parts: int | None = None) -> DataFrame:
    """key, pos and a column for each of NAMES and each common token (top_0, top_1, ...), as doubles.

    Ranks, and all that a token's signs tell, are looked up for bare tokens;
    numbers are dealt by key (into `parts`, if given), and all that is wide
    stays there: sums by key need no other exchange. A line's sums are
    differences of the text's, so that rows are sorted by place once, and once
    by line for the lines' widths. A token that the ranks don't know has rank 0
    and frequency 1.
    """
    order = Window.partitionBy(key).orderBy(pos)
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    ranked = _ranked(tokens.select(key, pos, token), ranks, common, definition, key, pos, token)
    d = ranked.repartition(key) if parts is None else dealt(ranked, parts, key)
    d = d.withColumns(
        {
            "_total": F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "_before": F.lag("_length").over(order),
            "_after": F.lead("_length").over(order),
            "_left": F.lag("_flags").over(order),
            "_right": F.lead("_flags").over(order),
            "_first": F.coalesce(F.lag("_breaks").over(order), F.lit(1)) > 0,
            "_carried": F.coalesce(F.lag("_tail").over(order), F.lit(0)),  # of a token with a break, what stands after the break
            "_line": total("_breaks"),
            "_start": total("_length"),
            "_equals": total(F.when(_has("_flags", "plain_equals"), 1).otherwise(0)),
            "_s": F.sum(F.when(_has("_flags", "opens"), 1).when(_has("_flags", "closes"), -1).otherwise(0)).over(upto),
            "_row": F.row_number().over(order),
        }
    )
    at_first = lambda c: F.max(F.when(F.col("_first"), F.col(c))).over(upto)  # of sums that never fall
    d = d.withColumns(
        {
            "_in_line": F.col("_start") - at_first("_start") + F.when(F.col("_line") > 0, F.last(F.when(F.col("_first"), F.when(F.col(pos) > 0, F.col("_carried")).otherwise(0)), True).over(upto)).otherwise(0),
            "_equals": F.col("_equals") > at_first("_equals"),
            "_def": F.col("_row") - F.max(F.when(_has("_flags", "definition"), F.col("_row"))).over(earlier) <= 10,
            "_nest": F.lag("_s").over(order) - F.least(F.lit(0), F.min("_s").over(earlier)),
        }
    )
    d = d.withColumn("_width", F.sum("_length").over(Window.partitionBy(key, "_line")))
    d = d.crossJoin(F.broadcast(scale))  # one row
    alone = F.col("_before").isNull() | F.col("_after").isNull()
    near = F.when(F.col("_total") == 1, 0.0).otherwise((F.coalesce("_before", F.lit(0)) + F.coalesce("_after", F.lit(0))) / F.when(alone, 1).otherwise(2))
    made = {
        **{name: yes(_has("_flags", name)) for name in ("is_keyword", "is_operator", "is_bracket", "is_punctuation", "is_numeric", "is_string", "has_special", "wordlike")},
        "length": F.least(F.col("_length") / 20, F.lit(1.0)),
        "relative": F.col(pos) / F.greatest(F.col("_total") - 1, F.lit(1)),
        "log_start": log_scaled(F.col(pos) + 1, F.col("log_scale")),
        "log_end": log_scaled(F.col("_total") - F.col(pos), F.col("log_scale")),
        "line_start": yes(F.col("_first")),
        "in_line": F.col("_in_line") / F.greatest(F.col("_width"), F.lit(1)),
        "indent": F.col("_indent"),
        "after_equals": yes(F.col("_equals")),
        "freq_rank": F.coalesce("_rank", F.lit(0.0)),
        "log_freq": F.log(F.coalesce("_n", F.lit(1))) / 10,
        "near_length": F.least(near / 20, F.lit(1.0)),
        "before_bracket": yes(_has("_right", "opening")),
        "after_dot": yes(_has("_left", "dot")),
        "before_equals": yes(_has("_right", "equals")),
        "in_def": yes(F.col("_def")),
        "nesting": F.coalesce("_nest", F.lit(0)) / 10,
    }
    hot = [(F.col("_top") == i + 1).cast("double").alias(f"top_{i}") for i in range(len(common))]
    return d.select(key, pos, *[made[n].alias(n) for n in NAMES], *hot)

"""Text for reports, names and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 2) -> Column:
    """A number with so many digits after the point."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(fixed(F.round(100 * share, digits), digits), F.lit("%"))


def renamed(name: Column, names: dict[str, str]) -> Column:
    """The display name of a name; the name itself, if it has none."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def by_dataset(dataset: Column, rules: dict[str, Column], otherwise: Column) -> Column:
    """The rule of the row's dataset."""
    return reduce(lambda c, rule: F.when(dataset == rule[0], rule[1]).otherwise(c), reversed(rules.items()), otherwise)


def path_safe(name: Column) -> Column:
    """Runs of signs other than letters, digits, _, . and - as one _."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def latex_escaped(s: Column) -> Column:
    return F.regexp_replace(s, "([#_%&])", r"\\$1")


def camel(name: Column) -> Column:
    """snake_case as CamelCase."""
    return F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def tagged(answer: Column, tag: Column) -> Column:
    """What stands between <tag> and the next </tag>, without line breaks at its ends; null if the tag isn't there or isn't ended."""
    open_, close = F.concat(F.lit("<"), tag, F.lit(">")), F.concat(F.lit("</"), tag, F.lit(">"))
    parts = F.split(F.replace(answer, open_, F.lit("\x00")), "\x00", 2)
    inner = F.split(F.replace(F.get(parts, F.lit(1)), close, F.lit("\x00")), "\x00", 2)
    return F.when(F.size(inner) == 2, F.regexp_replace(F.get(inner, F.lit(0)), r"^\n+|\n+$", ""))


# The signs by which byte-level tokenizers show white space.
BYTE_MARKS = {"\u0120": " ", "\u010a": "\n", "\u0109": "\t"}


def token_text(token: Column) -> Column:
    """A byte-level token with its marks for white space as the white space itself."""
    return F.translate(token, "".join(BYTE_MARKS), "".join(BYTE_MARKS.values()))


def left_stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def right_stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def stripped(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")

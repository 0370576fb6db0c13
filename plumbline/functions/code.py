"""Functions of source text that need a parser or a line scanner, in Arrow batches."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_QUOTE = re.compile(r"""\s*[rRuUbB]?(\"\"\"|'''|"|')""")
_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(")


def body_of(source: str, which: str | int = 0) -> str | None:
    """The body of a function, by name or by its place, without its docstring; None if there is none or the text doesn't parse."""
    try:
        found = [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    except (SyntaxError, ValueError):
        return None
    found.sort(key=lambda n: n.lineno)
    named = [n for n in found if n.name == which] if isinstance(which, str) else found[which : which + 1]
    if not named:
        return None
    body = named[0].body
    if isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    lines = source.splitlines()
    return "\n".join(lines[body[0].lineno - 1 : body[-1].end_lineno]) if body else ""


def _docstring_end(lines: list[str], i: int, end: int) -> int:
    """The line after the docstring that begins the lines i to end; i if there is none."""
    at = next((k for k in range(i, end) if lines[k].strip()), end)
    found = _QUOTE.match(lines[at]) if at < end else None
    if not found:
        return i
    quote = found[1]
    if len(quote) == 1:
        return at + 1 if lines[at].rstrip().endswith(quote) and len(lines[at].strip()) > 1 else i
    if quote in lines[at][found.end() :]:
        return at + 1
    return next((k + 1 for k in range(at + 1, end) if quote in lines[k]), i)


def elide(source: str, keep: frozenset[str] = frozenset()) -> str:
    """The source with the bodies of functions that aren't in `keep` as three dots.

    A body is what is indented deeper than its def, up to the last such line
    that isn't blank; a docstring at its beginning stays. Bodies of nested functions go with the outer one. A
    signature may run over several lines; a function without a body below it
    stays as it is.
    """
    lines, out, i = source.split("\n"), [], 0
    while i < len(lines):
        out.append(lines[i])
        found = _DEF.match(lines[i])
        i += 1
        if not found:
            continue
        depth, open_ = len(found[1]), lines[i - 1]
        while open_.count("(") + open_.count("[") > open_.count(")") + open_.count("]") and i < len(lines):
            out.append(lines[i])
            open_ += lines[i]
            i += 1
        if found[2] in keep:
            continue
        end, j = i, i
        while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > depth):
            j += 1
            if lines[j - 1].strip():
                end = j
        if end > i:
            first = next(line for line in lines[i:end] if line.strip())
            told = _docstring_end(lines, i, end)
            out += lines[i:told]
            if not any(line.strip() for line in lines[told:end]):
                i = end
                continue
            out.append(first[: len(first) - len(first.lstrip())] + "...")
            i = end
    return "\n".join(out)


def elide_parsed(source: str, keep: frozenset[str] = frozenset()) -> str:
    """The source with whole bodies, docstrings too, of functions that aren't in `keep` as three dots, found by Python's parser; a text that it refuses goes through `elide`.

    Bodies of nested functions go with the outer one; a body on its def's line
    stays as it is.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return elide(source, keep)
    lines, gone = source.split("\n"), []

    def look(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) and child.name not in keep:
                first = child.body[0]
                begin = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
                if begin > child.lineno and not lines[begin - 1][: first.col_offset].strip():
                    gone.append((begin - 1, child.end_lineno, first.col_offset))
                    continue
            look(child)

    look(tree)
    for begin, end, indent in sorted(gone, reverse=True):
        lines[begin:end] = [" " * indent + "..."]
    return "\n".join(lines)


@F.pandas_udf(StringType())
def bodies(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else body_of(s))


def body(source: Column, which: str | int) -> Column:
    """The body of the function of that name or place, without its docstring; null if there is none or the text doesn't parse."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else body_of(x, which))

    return run(source)


def elided(source: Column, keep: list[str] | None = None, parser: bool = False) -> Column:
    """The source without bodies, by its indentation (docstrings stay) or by Python's parser (they go)."""
    names, run_one = frozenset(keep or ()), elide_parsed if parser else elide

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else run_one(x, names))

    return run(source)


_NAMED = re.compile(r"\b(?:def|class)\s+([A-Za-z_]\w*)\s*\(")
#: How many of the last functions keep their bodies, one after the other, until a source fits.
KEPT_LAST = (64, 32, 16, 8)
SEPARATOR = "\n... ELIDED ...\n"


def fewer_bodies(source: str, budget: int) -> str:
    """The source with the bodies of as many of its last functions as fit in the budget (of KEPT_LAST), or of the fewest; as it is, if it fits."""
    if len(source) <= budget:
        return source
    names = _NAMED.findall(source)
    text = source
    for k in KEPT_LAST:
        text = elide(source, frozenset(names[-k:]))
        if len(text) <= budget:
            break
    return text


def shortened(source: Column, budget: int, head: float = 0.2) -> Column:
    """The source within a budget of signs: fewer and fewer functions keep their bodies, and if that isn't enough, the middle goes.

    Of what is left, a share `head` is the beginning and the rest the end; the
    two stand around SEPARATOR and have two signs fewer than would fit.
    """

    @F.pandas_udf(StringType())
    def fewer(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fewer_bodies(x, budget))

    room = budget - len(SEPARATOR) - 2
    first = int(room * head)
    text = F.when(F.length(source) <= budget, source).otherwise(fewer(source))
    return F.transform(F.array(text), lambda t: F.when(F.length(t) <= budget, t).otherwise(F.concat(F.substring(t, 1, first), F.lit(SEPARATOR), F.right(t, F.lit(room - first)))))[0]


def last_fence(text: Column) -> Column:
    """What stands between the last two fence marks, without the first one's line, whatever that holds; null if there are fewer marks or no line break between."""
    parts = F.split(text, "```", -1)
    inside = F.get(parts, F.size(parts) - 2)
    return F.when((F.size(parts) >= 3) & F.contains(inside, F.lit("\n")), F.regexp_replace(inside, r"^[^\n]*\n", ""))


def comment_stats(text: Column) -> Column:
    """struct(lines, comments, share): lines that aren't blank, those that begin with #, and their share."""
    shown = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s+", "") != "")
    comments = F.filter(shown, lambda x: F.regexp_replace(x, r"^\s+", "").startswith("#"))
    return F.struct(F.size(shown).alias("lines"), F.size(comments).alias("comments"), F.try_divide(F.size(comments).cast("double"), F.size(shown).cast("double")).alias("share"))


def parsed_list(text: Column) -> Column:
    """A JSON list of numbers, each kept in [0, 1]; null if the text is none."""
    return F.transform(F.from_json(text, "array<double>"), lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0))))


def fitted_list(values: Column, n: Column, fill: float) -> Column:
    """The list cut or filled up to n values."""
    return F.slice(F.concat(F.coalesce(values, F.array().cast("array<double>")), F.array_repeat(F.lit(fill), n)), F.lit(1), n)


def list_reason(values: Column, n: Column, text: Column | None = None) -> Column:
    """Why a parsed list doesn't fit n values; null if it does.

    With the text that was parsed, SyntaxOnAst stands for a text that is no
    literal at all (unbalanced brackets or no value), and ValueErrorOnAst for a
    list or word that holds something else than literals.
    """
    out = F.when(values.isNull(), "NotAList").when(F.size(values) < n, "TooFewVals").when(F.size(values) > n, "TooManyVals")
    if text is None:
        return out
    bare = F.trim(text)
    count = lambda s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))
    syntax = (bare == "") | (count("[") != count("]")) | (count("(") != count(")")) | bare.rlike(r"^\s*[A-Za-z_]\w*\s+\w") | bare.rlike(r",\s*,")
    named = bare.rlike(r"[A-Za-z_]\w*") & ~bare.rlike(r"""^\s*(True|False|None|".*"|'.*'|[-+0-9.eE,\s\[\]]*)\s*$""")
    return F.when(values.isNull() & syntax, "SyntaxOnAst").when(values.isNull() & named, "ValueErrorOnAst").otherwise(out)

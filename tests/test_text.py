from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import code, expr
from plumbline.operators import tokens

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_elide():
    source = "def a(x):\n    return 1\n\n\ndef b(\n    y,\n):\n    def inner():\n        pass\n    return 2\n\nz = 3"
    assert code.elide(source) == "def a(x):\n    ...\n\n\ndef b(\n    y,\n):\n    ...\n\nz = 3"
    assert code.elide(source, frozenset(["a"])).startswith("def a(x):\n    return 1\n")
    assert code.elide("def bar():") == "def bar():"


def test_body():
    source = "class A:\n    def f(self):\n        '''doc'''\n        return 1\n\ndef g():\n    return 2\n"
    assert code.body_of(source, "f") == "        return 1"
    assert code.body_of(source, 1) == "    return 2"
    assert code.body_of("def (", 0) is None and code.body_of("x = 1") is None


def test_truncated(spark):
    df = spark.createDataFrame([("a" * 50 + "b" * 50,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(expr.truncated(F.col("t"), 25)).collect()]
    assert got[0] == "aaaa\n...\n" + "b" * 16 and got[1:] == ["short", None]


def test_parsed_list(spark):
    df = spark.createDataFrame([("[0.5, 2, -1]",), ("no",), (None,)], "t string")
    got = df.select(code.parsed_list(F.col("t")).alias("v"), code.list_reason(code.parsed_list(F.col("t")), F.lit(4)).alias("r")).collect()
    assert got[0].v == [0.5, 1.0, 0.0] and got[0].r == "TooFewVals" and got[1].r == "NotAList"


piece = st.text(st.sampled_from("a\n("), min_size=1, max_size=3)


@quick
@given(st.lists(piece, min_size=1, max_size=12))
def test_line_ids_match_a_loop(spark, pieces):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pieces)], "problem_id long, pos long, token string")
    got = [r.line_id for r in tokens.line_ids(df).orderBy("pos").collect()]
    starts = {i + 1 for i, t in enumerate(pieces) if t.endswith("\n")} | {i for i, t in enumerate(pieces) if "\n" in t and not t.endswith("\n")}
    assert got == [sum(1 for s in starts if 0 < s <= i) for i in range(len(pieces))]


@quick
@given(st.lists(st.sampled_from(["(", ")", "[", "}", "x"]), min_size=1, max_size=15))
def test_nesting_matches_a_loop(spark, pieces):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pieces)], "problem_id long, pos long, token string")
    got = [r.level for r in tokens.nesting(df).orderBy("pos").collect()]
    level, expected = 0, []
    for t in pieces:
        expected.append(level)
        level = max(0, level + (t in tokens.OPEN) - (t in tokens.CLOSE))
    assert got == expected


def test_shortened_is_the_plain_loop(spark):
    functions = [f"def f{i}(x):\n    '''doc {i}'''\n    y = x + {i}\n    return y * {i}\n" for i in range(90)]
    whole = "\n".join(functions)
    separator = "\n... ELIDED ...\n"

    def plain(text, budget):
        """Fewer and fewer of the last functions keep their bodies; then the middle goes."""
        k, names = 64, [f"f{i}" for i in range(text.count("def f"))]
        while len(text) > budget and k > 4:
            names = names[-k:]
            text = code.elide(text, frozenset(names))
            k //= 2
        if len(text) > budget:
            room = budget - len(separator) - 2
            text = text[: int(room * 0.2)] + separator + text[len(text) - (room - int(room * 0.2)) :]
        return text

    for budget in (10, 60, 500, 3000, 4500, 5500, 6000, 9000):
        if budget <= len(separator) + 2:
            continue
        df = spark.createDataFrame([(whole,), ("\n".join(functions[:9]),), ("x" * 7000,), ("",), (None,)], "s string")
        got = [r[0] for r in df.select(code.shortened(F.col("s"), budget)).collect()]
        assert got == [plain(whole, budget), plain("\n".join(functions[:9]), budget), plain("x" * 7000, budget), "", None]
        assert all(len(x) <= budget for x in got if x is not None)


def test_elide_parsed():
    source = "def a(x):\n    return 1\n\n\ndef b(\n    y,\n):\n    def inner():\n        pass\n    return 2\n\nz = 3"
    assert code.elide_parsed(source) == code.elide(source)
    assert code.elide_parsed(source, frozenset(["b"])) == "def a(x):\n    ...\n\n\ndef b(\n    y,\n):\n    def inner():\n        ...\n    return 2\n\nz = 3"
    told = "class A:\n    def f(self):\n        '''doc'''\n        # said\n        return 1\n\n    def g(self): return 2\n\nasync def h():\n    @w\n    def k():\n        pass\n"
    assert code.elide_parsed(told) == "class A:\n    def f(self):\n        ...\n\n    def g(self): return 2\n\nasync def h():\n    ...\n"
    assert code.elide_parsed("def f(:\n    x\n") == code.elide("def f(:\n    x\n")
    assert code.elide_parsed("") == "" and code.elide_parsed("x = 'def f():'") == "x = 'def f():'"


def test_bodies_by_name(spark):
    df = spark.createDataFrame([("def f():\n    'doc'\n    return 1\n\ndef g():\n    return 2\n",), ("def (",), (None,)], "s string")
    assert [r[0] for r in df.select(code.body(F.col("s"), "g")).collect()] == ["    return 2", None, None]
    assert [r[0] for r in df.select(code.elided(F.col("s"), ["g"], parser=True)).collect()] == ["def f():\n    ...\n\ndef g():\n    return 2\n", "def (", None]

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plumbline.operators import diff


def table_of_lengths(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


def is_a_way(a, b, runs):
    """Runs are equal on both sides, in order, and don't go on on both sides."""
    i = j = 0
    for p, q, n in runs:
        assert n > 0 and p >= i and q >= j and list(a[p : p + n]) == list(b[q : q + n])
        assert not (i and p == i and q == j)
        i, j = p + n, q + n
    return i <= len(a) and j <= len(b)


def edited(rng, base, fresh):
    out = []
    for x in base:
        kind = rng.random()
        if kind < 0.1:
            continue
        out += [x] if kind < 0.8 else [next(fresh)] if kind < 0.9 else [x, next(fresh)]
    return out


def test_common_runs_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for size in [0, 1, 2, 5, 9, 17, 40]:
        for letters in ["a", "ab", "abcdefgh"]:
            for _ in range(12):
                a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(size + 1))) for _ in range(2))
                runs = diff.common_runs(a, b)
                assert is_a_way(a, b, runs) and sum(n for *_, n in runs) == table_of_lengths(a, b)


def test_longest_chain():
    rng = random.Random(2)
    for _ in range(60):
        places = rng.sample(range(40), rng.randrange(0, 30))
        chain = diff.longest_chain(places)
        assert [places[k] for k in chain] == sorted(places[k] for k in chain)
        best = [1] * len(places)
        for i in range(len(places)):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
        assert len(chain) == max(best, default=0)


PAIRS = "k string, a array<string>, b array<string>"


def found(spark, pairs, exact=diff.EXACT, rule="subsequence"):
    df = spark.createDataFrame([(f"k{i}", a, b) for i, (a, b) in enumerate(pairs)], PAIRS)
    return {r.k: [tuple(x) for x in r.runs] for r in diff.with_runs(df, "k", "a", "b", rule, exact).collect()}


@pytest.mark.parametrize("exact", [diff.EXACT, 0])
def test_equals_difflib_where_lines_are_unique(spark, exact):
    rng, fresh = random.Random(3), iter(f"new {i}" for i in range(10**6))
    pairs = []
    for _ in range(12):
        base = [f"line {i}" for i in range(rng.randrange(0, 60))]
        pairs.append((base, edited(rng, base, fresh)))
    got = found(spark, pairs, exact)
    for i, (a, b) in enumerate(pairs):
        assert got[f"k{i}"] == [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def anchored(a, b):
    """Anchors are what stands once on either side, in the longest chain; between them a longest common subsequence."""
    places = sorted((i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1)
    best = [(1, -1)] * len(places)
    for i in range(len(places)):
        best[i] = max([(1, -1), *((best[j][0] + 1, j) for j in range(i) if places[j][1] < places[i][1])], key=lambda x: x[0])
    total = max((x[0] for x in best), default=0)
    return total


@pytest.mark.parametrize("seed", range(3))
def test_with_anchors_nothing_is_left_out(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(10):
        base = [rng.choice([f"u{rng.randrange(200)}", "x", "y", "z"]) for _ in range(60)]
        pairs.append((base, edited(rng, base, iter(rng.choice("xyzw") + str(i % 7) for i in range(10**4)))))
    pairs += [([], []), (["x"], []), ([], ["x"]), (["x"] * 30, ["x"] * 20), (["p", "q"], ["q", "p"]), (None, ["x"]), (["x", None], [None])]
    got = found(spark, pairs, exact=0)
    for i, (a, b) in enumerate(pairs):
        runs = got[f"k{i}"]
        a, b = a or [], b or []
        assert is_a_way(a, b, runs)
        kept = sum(n for *_, n in runs)
        assert anchored(a, b) <= kept <= table_of_lengths(a, b)
        ends = [(0, 0), *((p + n, q + n) for p, q, n in runs)], [*((p, q) for p, q, _ in runs), (len(a), len(b))]
        for (i1, j1), (i2, j2) in zip(*ends, strict=True):
            assert not set(a[i1:i2]) & set(b[j1:j2]), "what both sides have between two runs would make the chain longer"


def test_blocks_rule_is_difflib(spark):
    rng = random.Random(6)
    pairs = [([rng.choice("abcdef") for _ in range(30)], [rng.choice("abcdef") for _ in range(300)]) for _ in range(6)]
    got = found(spark, pairs, rule="blocks")
    want = lambda a, b: [(m.a, m.b, m.size) for m in SequenceMatcher(None, *([hash(x) for x in s] for s in (a, b))).get_matching_blocks() if m.size]
    assert [got[f"k{i}"] for i in range(6)] == [[x for x in want(a, b)] for a, b in pairs]


def steps(spark, a, b):
    df = diff.with_runs(spark.createDataFrame([("k", a, b)], PAIRS), "k", "a", "b")
    return df.withColumn("ops", diff.opcodes(F.col("runs"), F.size("a"), F.size("b")))


def test_large_pairs_lose_nothing(spark, tmp_path):
    """An element that stands once on either side, but in another order, doesn't keep the others of a large pair apart."""
    from plumbline.plans import reports

    a, b = ["once", *["x", "y"] * 1100], [*["x", "y"] * 1100, "once"]
    assert len(a) * len(b) > diff.EXACT
    assert found(spark, [(a, b), (a[:21], b[-21:])]) == {"k0": [(1, 0, 2200)], "k1": [(1, 0, 20)]}
    texts = [(i, "\n".join(x)) for i, x in enumerate([a, b, ["none"]])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.n, r.changed_a, r.changed_b) for r in reports.df_closer(spark, str(tmp_path)).collect()]
    assert rows == [(0, 2201, 1, 2201)]


def test_runs_do_not_depend_on_what_is_held():
    rng = random.Random(9)
    for letters in (3, 40, 2000):
        a, b = ([rng.randrange(letters) for _ in range(n)] for n in (150, 1100))
        runs = diff.common_runs(a, b)
        assert is_a_way(a, b, runs) and sum(n for *_, n in runs) == table_of_lengths(a, b)
        assert all(diff.common_runs(a, b, held, masks) == runs for held in (0, diff.HELD) for masks in (0, 500, diff.MASKS))


def test_opcodes_and_token_rows(spark):
    df = steps(spark, ["the", "red", "cat"], ["the", "big", "cat", "sat"]).withColumn("p", F.array(F.lit(-1.0), F.lit(-2.0), F.lit(None)))
    assert [tuple(o) for o in df.first().ops] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]
    rows = [(r.token, r.equal, r.old_idx, r.new_idx, r.logprob, r.closed) for r in diff.token_rows(df, ["k"], "a", "b", logprobs="p", closed=["the"]).collect()]
    assert rows == [("the", True, 0, 0, -1.0, True), ("red", False, 1, None, -2.0, False), ("big", False, None, 1, None, False), ("cat", True, 2, 2, None, False), ("sat", False, None, 3, None, False)]


def test_kept_marks_every_change(spark):
    base = "the green lamp stood by the window all winter".split()
    pairs, plain, marked = [], [], []
    for i in range(len(base)):
        ones = [int(k != i) for k in range(len(base))]
        pairs += [(base, [*base[:i], "zebra", *base[i + 1 :]]), (base, [*base[:i], "zebra", *base[i:]])]
        plain += [ones, [1] * len(base)]
        marked += [ones, ones]
    pairs += [([], ["a"]), (["a"], [])]
    df = diff.with_runs(spark.createDataFrame([(f"{i:03}", a, b) for i, (a, b) in enumerate(pairs)], PAIRS), "k", "a", "b")
    ops = diff.opcodes(F.col("runs"), F.size("a"), F.size("b"))
    rows = df.withColumn("ops", ops).select("k", diff.kept(F.col("ops"), False).alias("x"), diff.kept(F.col("ops")).alias("y")).orderBy("k").collect()
    assert [r.x for r in rows] == [*plain, [], [0]] and [r.y for r in rows] == [*marked, [], [0]]


def test_line_edits(spark):
    lines = [f"step_{i} = {i}" for i in range(6)]
    none = {"rewrites": [0.0] * 6, "deletes": [0.0] * 6, "insert_before": [0.0] * 7}
    at = lambda name, *places: none | {name: [float(k in places) for k in range(len(none[name]))]}
    cases = [
        ([line.replace(" ", "  ") for line in lines], none),
        ([*lines[:2], "other", *lines[3:]], at("rewrites", 2)),
        ([*lines[:4], lines[5]], at("deletes", 4)),
        ([*lines[:3], "new", "newer", *lines[3:]], at("insert_before", 3)),
        ([*lines[:3], "# said", "", *lines[3:]], at("insert_before", 3)),
        ([*lines[:3], "# said", *lines[3:]], none),
        (["before", *lines], at("insert_before", 0)),
        ([*lines, "behind"], at("insert_before", 6)),
        ([*lines, "", " "], none),
        (["one", "two", *lines[1:]], at("rewrites", 0) | {"insert_before": at("insert_before", 1)["insert_before"]}),
        (lines[:2], at("deletes", 2, 3, 4, 5)),
    ]
    df = spark.createDataFrame([(f"{i:02}", "\n\n" + "\n".join(lines) + "\n", "\n".join(b)) for i, (b, _) in enumerate(cases)] + [("90", "", "x"), ("91", "# a\nb", "b")], "k string, a string, b string")
    df = df.select("k", diff.squeezed(diff.lines(F.col("a"))).alias("a"), diff.squeezed(diff.lines(F.col("b"))).alias("b"))
    df = diff.with_runs(df, "k", "a", "b").withColumn("ops", diff.opcodes(F.col("runs"), F.size("a"), F.size("b")))
    got = [r.e.asDict() for r in df.select("k", diff.line_edit(F.col("ops"), F.col("a"), F.col("b")).alias("e")).orderBy("k").collect()]
    assert got == [want for _, want in cases] + [{"rewrites": [], "deletes": [], "insert_before": [1.0]}, {"rewrites": [0.0, 0.0], "deletes": [0.0, 0.0], "insert_before": [0.0, 0.0, 0.0]}]


def test_sign_distance(spark):
    pairs = [("", ""), ("", "four"), ("four", ""), ("river", "riverbed"), ("tin can", "tin canoe"), ("same text", "same text"), ("a b", None), ("stone lamp", "stones lamb"), ("x" * 5, "y" * 3)]
    got = {r.k: (r.ratio, r.distance) for r in diff.sign_distance(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, a string, b string"), "k", "a", "b").collect()}
    assert got[0] == (1.0, 0) and got[1] == got[2] == (0.0, 4) and got[3] == (10 / 13, 3) and got[5] == (1.0, 0) and got[6] == (None, None) and got[8] == (0.0, 5)
    assert got[4] == (14 / 16, 2) and got[7] == (2 * 9 / 21, 2)


def test_large_stretches_are_dealt_out(spark):
    """Whether a stretch is counted in the pair's row or by itself, the sums are the same."""
    pairs = [("stone lamp", "stones lamb"), ("tin can", "tin canoe"), ("", "four"), ("x" * 5, "y" * 3), ("a b", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, a string, b string")
    got = [sorted(map(tuple, diff.sign_distance(df, "k", "a", "b", exact=n).collect())) for n in (1, 12, diff.EXACT)]
    assert got[0] == got[1] == got[2] and got[0][0] == (0, 2 * 9 / 21, 2.0) and got[0][4] == (4, None, None)


def test_pieces_are_taken_before_pairs_are_dealt(spark, sf):
    """However often the pairs are read, a document's pieces are found below the dealing."""
    from plumbline.plans import catalog

    plan = catalog.df_char_distance(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    found = [i for i, line in enumerate(plan) if "regexp_extract_all" in line]
    assert found and all("RepartitionByExpression" in plan[i - 1] for i in found)


def test_words_are_counted_as_their_runs_say():
    rng = random.Random(4)
    for _ in range(4000):
        letters = rng.choice(["ab", "abcd", "abcdefghij ", "x"])
        x, y = ("".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice((3, 9, 40))))) for _ in "ab")
        y = rng.choice([y, x[: len(x) // 2] + y, y + x[len(x) // 2 :]])
        assert diff._counts(x, y) == diff._run_counts(x, y)


def test_texts_are_dealt_once_a_side(spark, sf):
    """Beside the two sides only stretches that are too large for a row are dealt, and no piece of a text is unfolded."""
    from plumbline.plans import catalog

    plan = catalog.df_char_distance(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and plan.count("Generate ") == 1 and plan.count("Join ") == 1
    sides = catalog._neighbours(spark, sf, diff.pieces)
    assert sides.schema["base"].dataType.simpleString() == "struct<text:string,sizes:array<int>>"

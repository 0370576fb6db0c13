import pytest
from pyspark.sql import functions as F

from plumbline.functions import code, text
from plumbline.operators import calibration, candidates, checks, features, folds
from plumbline.sources import tables


def test_running_sums_are_the_plain_ones(spark):
    import random

    rng = random.Random(1)
    values = [rng.choice([0.0, 1.0, 0.5, 0.999999, rng.random(), rng.random() ** 9, 1 - rng.random() ** 9]) for _ in range(400)]
    df = spark.createDataFrame([(i % 3, v, i % 2) for i, v in enumerate(values)], "k long, p double, y long")
    small = calibration.scores(df, ["k"])
    for r in calibration.running(small, ["k"], ["n"]).collect():
        same = [v for i, v in enumerate(values) if i % 3 == r.k]
        assert (r.before_n, r.all_n) == (sum(v < r.p for v in same), len(same))


def test_equal_counts_rank_only_divided_probabilities(spark):
    rows = [(i, 0.5 if i % 3 else i / 1000, i % 2) for i in range(101)] + [(200 + i, 0.9, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, p double, y long").withColumn("k", F.lit("a"))
    got = {r.bin: (r.n, round(r.conf, 9), round(r.acc, 9)) for r in calibration.equal_count_bins(df, ["k"], ["id"], 10).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    size, more = divmod(len(rows), 10)
    at = 0
    for b in range(10):
        part = ordered[at : at + size + (b < more)]
        at += len(part)
        assert got[b + 1] == (len(part), round(sum(r[1] for r in part) / len(part), 9), round(sum(r[2] for r in part) / len(part), 9))


def test_sample_is_exact(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 50 == 0, 1).otherwise(0))
    key = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    got = folds.sample(df, F.lit(0.37), key, ["g"]).withColumn("k", key).groupBy("g").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    ranked = df.withColumn("k", key).toPandas().sort_values("k")
    for r in got.collect():
        mine = ranked[ranked.g == r.g]
        assert r.n == int(0.37 * len(mine)) and r.k == mine.k.iloc[r.n - 1]


def test_checks(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", None, 0), ("a", float("nan"), 2), ("a", 1.5, 0)], "k string, p double, y int")
    assert [tuple(r) for r in checks.domain_report(df, ["k"]).collect()] == [("a", 4, 2, 1, 1)]
    assert checks.checked(df.where("p = 0.5")).count() == 1
    with pytest.raises(Exception, match="not in its domain"):
        checks.checked(df).collect()
    ok, bad = checks.accepted_and_rejected(df, [("no number", F.col("p").isNull()), ("too large", F.col("p") > 1)])
    assert ok.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no number", "too large", "too large"]  # NaN is larger than all numbers


def test_zipped_is_strict(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i long, a string"), spark.createDataFrame([(1, "p"), (2, "q")], "i long, b string")
    assert sorted(tuple(r) for r in tables.zipped(a, b, ["i"]).collect()) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(Exception, match="differ in their rows"):
        tables.zipped(a, b.where("i = 1"), ["i"]).collect()


def test_keep_chances_of_a_place_that_is_never_kept(spark):
    df = spark.createDataFrame([("d", 1, 1, 1), ("d", 1, 2, 0), ("d", 2, 1, 0), ("d", 2, 2, 0)], "d string, q long, at long, y long")
    got = {(r.i, r.j): (r.p_ij, r.p_i_given_j) for r in candidates.keep_chances(df, ["d"], "q", "at", "y").collect()}
    assert got == {(1, 1): (0.5, 1.0), (1, 2): (0.0, 0.0), (2, 1): (0.0, 0.0), (2, 2): (0.0, 0.0)}


def test_dev_sample_and_synthetic(spark):
    made = tables.synthetic_predictions(spark, 2000)
    assert made.where("p < 0 or p >= 1 or y not in (0, 1)").count() == 0 and 0.4 < made.agg(F.avg("p")).first()[0] < 0.6
    part = tables.dev_sample(made, "problem_id", 0.2)
    assert 300 < part.count() < 500 and part.exceptAll(tables.dev_sample(made, "problem_id", 0.3)).count() == 0


def test_features_of_a_line(spark):
    toks = ["def", " ", "f", "(", "x", ")", ":", "\n    ", "y", "=", "'s'", "\n", "3.5"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "problem_id long, pos long, token string")
    rows = sorted(features.extract(df, *features.fit(df, 2)).collect(), key=lambda r: r.pos)
    one = lambda name: [r.pos for r in rows if r[name] == 1.0]
    assert one("is_keyword") == [0] and one("is_bracket") == [3, 5] and one("is_numeric") == [12] and one("is_string") == [10]
    assert one("line_start") == [0, 8, 12] and one("after_equals") == [10, 11] and one("before_equals") == [8] and one("before_bracket") == [2]
    assert [round(r.nesting * 10) for r in rows] == [0, 0, 0, 0, 1, 1] + [0] * 7
    assert rows[8].in_line == 4 / (1 + 1 + 3 + 1)  # four blanks of the break before it; the line's own tokens are six signs long
    assert one("in_def") == list(range(1, 11)) and one("wordlike") == [2, 4, 8]


def test_last_fence_follows_the_last_two_marks(spark):
    cases = {"```py title\na\n```": "a\n", "``` \nb\n``` end": "b\n", "```\na\n``` x\n```": "", "one ``` only": None, "```py```": None, "```\na\n```\nb\nc```": "b\nc"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.f for r in df.select("t", code.last_fence(F.col("t")).alias("f")).collect()} == cases


def test_elided_functions_keep_their_docstring():
    source = 'def f(a):\n    """What it does.\n\n    More."""\n    x = 1\n    return x\n\n\ndef g():\n    \'one line\'\n    return 2\n\n\ndef h():\n    """Only told."""\n'
    assert code.elide(source) == 'def f(a):\n    """What it does.\n\n    More."""\n    ...\n\n\ndef g():\n    \'one line\'\n    ...\n\n\ndef h():\n    """Only told."""\n'


def test_list_reasons(spark):
    cases = {"[0.1, 0.2]": None, "[0.1]": "TooFewVals", "[1,2,3]": "TooManyVals", "[0.1, 0.2": "SyntaxOnAst", "": "SyntaxOnAst", "[a, b]": "ValueErrorOnAst", "7": "NotAList"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", code.list_reason(code.parsed_list(F.col("t")), F.lit(2), F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def test_text(spark):
    df = spark.createDataFrame([("<a>\nx\n</a> <a>y</a>", "a"), ("<a>never ended", "a"), (None, "a")], "t string, g string")
    assert [r[0] for r in df.select(text.tagged(F.col("t"), F.col("g"))).collect()] == ["x", None, None]
    assert df.select(text.camel(F.lit("snake_case_name"))).first()[0] == "SnakeCaseName"


def test_newton_by_groups_and_by_steps(spark, monkeypatch):
    from plumbline.operators import rescale

    df = spark.createDataFrame([(k, (i % 20 + 0.5) / 20, int(i * 7 % 20 < i % 20 + k)) for i in range(200) for k in range(2)], "k long, p double, y long")
    for keys in (["k"], []):
        at_once = {tuple(r[k] for k in keys): (r.a, r.b) for r in rescale.platt(df, keys).collect()}
        monkeypatch.setattr(rescale, "MOST_SUMS", 3)
        by_steps = {tuple(r[k] for k in keys): (r.a, r.b) for r in rescale.platt(df, keys).collect()}
        monkeypatch.undo()
        assert at_once.keys() == by_steps.keys() and all(at_once[k] == pytest.approx(by_steps[k], abs=1e-9) for k in at_once)


def test_keep_chances_in_parts_are_the_plain_ones(spark):
    import random

    rng = random.Random(4)
    rows = [("d", p, at, rng.randrange(2)) for p in range(6) for at in rng.sample(range(40), rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "d string, problem int, place int, kept int")
    key = lambda df: sorted((r.i, r.j, r.p_i, r.p_j, r.p_ij, r.p_i_given_j) for r in df.collect())
    whole = key(candidates.keep_chances(df, ["d"], "problem", "place", "kept"))
    assert key(candidates.keep_chances(df, ["d"], "problem", "place", "kept", part=7)) == whole
    kept = {(p, at): k for _, p, at, k in rows}
    both = {(i, j) for (p, i) in kept for (q, j) in kept if p == q}
    assert len(whole) == len(both)
    for i, j, _, p_j, p_ij, given in whole:
        assert p_ij * 6 == sum(kept[p, i] * kept[p, j] for p in range(6) if (p, i) in kept and (p, j) in kept)
        assert given == (p_ij / p_j if p_j else 0)


def test_mean_to_six_digits_is_exact(spark):
    """A tie at the seventh digit goes up, however the addends' last bits fall."""
    from plumbline.plans import reports

    df = spark.createDataFrame([(p,) for p in [0.870355, 0.954398, 0.702866, 0.199071]], "p double").coalesce(1)
    assert df.agg(reports._mean_6().alias("m")).first().m == 0.681673

import pytest
from pyspark.sql import functions as F

from plumbline.operators import candidates, folds, ledger, probe, rollup
from plumbline.sources import tables


def test_materialize_makes_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.materialize(spark, str(tmp_path), {"b": 1, "a": [2]}, make).count() == 3
    assert made == [1]
    assert tables.config_key({"a": [2], "b": 1}) == tables.config_key({"b": 1, "a": [2]})


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c/*.csv", "a long, b string").count() == 2
    tables.write_parquet(df, f"{tmp_path}/p")
    assert tables.read_parquet(spark, f"{tmp_path}/p").count() == 2
    assert tables.read_parquet(spark, f"{tmp_path}/none") is None


def test_union_needs_parts():
    with pytest.raises(ValueError):
        tables.tagged_union({})


def test_flat(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("b.c")).alias("a")).alias("x"))
    assert tables.flat(df).columns == ["x__a__b.c"]


def test_ledger_keeps_rows(spark):
    df = ledger.with_ledger(spark.range(3))
    df = ledger.annotate(df, "odd", F.col("id") % 2 == 1, meta_d=F.col("id"))
    df = ledger.tag(ledger.annotate(df, "null", F.lit(None).cast("boolean")), "seen", s=F.lit("x"))
    rows = df.orderBy("id").collect()
    assert len(rows) == 3 and [f.name for f in rows[0].failed] == ["odd", "null"] and rows[1].passed[0].meta_d == 1.0
    assert df.where(ledger.passed_all()).count() == 0 and rows[0].tags[0].s == "x"


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0)], "problem long, adder string, d double")
    assert [tuple(r) for r in candidates.leave_one_out(df, "problem", "adder", "d").collect()] == [("a", 1, 2.0, 1)]


def test_uncovered_tokens_get_the_problem_mean(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "problem_id long, line_id long")
    line = spark.createDataFrame([(1, 1, 0.4)], "problem_id long, line_id long, line_p double")
    assert sorted((r.problem_id, r.line_id, r.line_p) for r in rollup.to_tokens(t, line).collect()) == [(1, 1, 0.4), (1, 2, 0.4), (2, 1, None)]


def test_splits_cover(spark):
    df = folds.splits(folds.by_hash(spark.range(100), "id", 5), 5)
    assert df.where("split = 'test'").count() == 100 and df.count() == 500


def test_shifted(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "k long, pos long, embedding array<double>")
    assert sorted(r.embedding for r in probe.shifted(df, "k", "pos").collect()) == [[1.0, 0.0], [2.0, 1.0]]


def test_a_fuller_result_is_cut_down(spark, tmp_path):
    folder = str(tmp_path)
    never = lambda: pytest.fail("made anew")
    full, dev = {"data": "d", "dev": False}, {"data": "d", "dev": True}
    cut = lambda df: tables.dev_sample(df, "id", 0.3)
    assert tables.materialize(spark, folder, full, lambda: spark.range(1000)).count() == 1000
    small = tables.materialize(spark, folder, dev, never, [({"data": "other"}, cut), (full, cut)])
    assert 200 < small.count() < 400 and tables.derived_from(spark, folder, dev) == tables.config_key(full)
    assert tables.derived_from(spark, folder, full) is None
    again = tables.materialize(spark, folder, dev, never, [(full, lambda df: df)])
    assert sorted(again.collect()) == sorted(small.collect())
    made = tables.materialize(spark, folder, {"data": "new"}, lambda: spark.range(5), [({"data": "none"}, cut)])
    assert made.count() == 5 and tables.derived_from(spark, folder, {"data": "new"}) is None


def test_of_two_writers_one_gives_the_table(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2)

    def write(n):
        def make():
            both.wait(60)
            return spark.range(n)

        return tables.materialize(spark, str(tmp_path), {"x": 1}, make).count()

    with ThreadPoolExecutor(2) as pool:
        got = set(pool.map(write, (10, 20)))
    assert len(got) == 1 and got < {10, 20} or got in ({10}, {20})
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".draft") and not p.name.endswith(".crc")]


def test_lookups_give_one_row_each(spark):
    asked = spark.createDataFrame([(1, "a b"), (2, "A B"), (3, "none"), (4, None), (5, "a b")], "seq int, name string")
    known = spark.createDataFrame([("A B", 7), ("A B", 5), ("a  b", 1), ("A  B", 2)], "key string, value int")
    clean = lambda k: F.lower(F.regexp_replace(k, " +", " "))
    got = sorted((r.seq, r.value, r.how) for r in tables.looked_up(asked, known, "name", "key", "value", clean).collect())
    assert got == [(1, 1, "cleaned"), (2, 5, "exact"), (3, None, "none"), (4, None, "none"), (5, 1, "cleaned")]


def test_typed_and_synthetic_problems(spark):
    assert tuple(tables.literal_problem(spark, "lit-1", "blue", "red", False).first()) == ("lit-1", "blue", "red", False)
    rows = tables.synthetic_predictions(spark, 1000).collect()
    assert len(rows) == 1000 and all(0 <= r.p < 1 and r.y in (0, 1) for r in rows) and 0.4 < sum(r.p for r in rows) / 1000 < 0.6


def test_tags_on_some_rows(spark):
    df = ledger.tag(ledger.with_ledger(spark.range(4)), "odd", d=F.col("id"), when=F.col("id") % 2 == 1)
    df = ledger.tag(df, F.concat(F.lit("t"), F.col("id")), when=F.when(F.col("id") > 2, True))
    assert sorted(map(tuple, ledger.tag_counts(df, "id").collect())) == [("odd", 2, 2, 2.0), ("t3", 1, 1, None)]

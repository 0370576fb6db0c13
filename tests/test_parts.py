"""Large inputs are dealt into parts of a fixed size, small ones are left to Spark."""

from pyspark.sql import functions as F

from plumbline import session
from plumbline.plans import views


def partitions(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_parts_grow_with_the_files(spark, sf, monkeypatch):
    docs = session.table(spark, sf, "documents")
    assert session.parts(docs) is None
    monkeypatch.setattr(session, "LARGE", 1)
    assert session.parts(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "PART", 10_000)
    assert session.parts(docs) > 4
    small = {n: sorted(map(tuple, getattr(views, n)(spark, sf).select("problem_id", c).collect())) for n, c in (("pred", "p"),)}
    assert partitions(views.pred(spark, sf)) > 8 and partitions(views.words(spark, sf, dealt=True)) > 4
    monkeypatch.undo()
    assert sorted(map(tuple, views.pred(spark, sf).select("problem_id", "p").collect())) == small["pred"]


def test_pairs_of_one_file_are_dealt(spark, sf):
    """Lines of a single file's documents are compared in several tasks, and split before they are dealt."""
    from plumbline.plans import catalog

    pairs = catalog._neighbours(spark, sf, lambda text: F.split(text, "\n"))
    assert partitions(pairs) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plan = catalog._line_steps(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    split = [i for i, line in enumerate(plan) if "split(" in line]
    assert split and all("RepartitionByExpression" in plan[i - 1] for i in split)


def test_closer_compares_flags(spark, sf):
    """No line's text is unfolded to tell which document is closer."""
    from plumbline.plans import reports

    assert "old_idx" not in reports._closer(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_reach_their_tokens_without_a_join(spark):
    """Tokens see their line's probability, else the problem's mean, in the parts that they are dealt into once."""
    from plumbline.operators import rollup

    tokens = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 0), (None, 0, 0), (1, None, 3)], "problem_id int, line_id int, pos int")
    lines = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.6), (3, 0, 0.9)], "problem_id int, line_id int, line_p double")
    made = rollup.to_tokens(tokens, lines, parts=7)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, [(1, 0, 0, 0.2), (1, 1, 1, 0.6), (1, 2, 2, 0.4), (2, 0, 0, None), (None, 0, 0, None), (1, None, 3, 0.4)]))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_are_looked_up_before_tokens_get_wide(spark, sf):
    """Joins on tokens lie below all windows over a text, which then need no exchange."""
    from plumbline.plans import reports

    plan = reports.ml_features(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join" in line and "_token" in line]
    texts = [i for i, line in enumerate(plan) if "Window" in line and "problem_id" in line]
    assert joins and texts and max(texts) < min(joins)


def test_texts_are_taken_apart_once(spark, sf):
    """Scans read tokens that are found already, and three windows serve all features: two by place, one by line."""
    from plumbline.plans import reports

    plan = reports.ml_features(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("regexp_extract_all(text" in line for line in plan)
    windows = [line for line in plan if "Window [" in line and "problem_id" in line]
    assert len(windows) == 3 and not any("token#" in line for line in windows)


def test_features_of_tokens_that_the_ranks_do_not_know(spark):
    """Only rank, frequency and the common tokens go with the corpus."""
    from plumbline.operators import features

    toks = ["def", " ", "f", "(", "x", ")", ":", "\n    ", "y", "=", "'s'", "\n", "3.5", ".", "Zoë", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "problem_id long, pos long, token string")
    other = spark.createDataFrame([(2, 0, "x"), (2, 1, "none")], df.schema)
    scale = features.fit(df, 0)[1]
    names = ["pos", *(n for n in features.NAMES if n not in ("freq_rank", "log_freq"))]
    own, new = (sorted(map(tuple, features.extract(df, features.fit(c, 0)[0], scale, []).select(names).collect())) for c in (df, other))
    assert len(own) == len(toks) and own == new
    got = features.extract(df, features.fit(other, 0)[0], scale, []).where("pos <> 4").agg(F.max("freq_rank"), F.max("log_freq")).first()
    assert tuple(got) == (0.0, 0.0)

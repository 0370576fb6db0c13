import random
from statistics import mean, median

from plumbline.operators import dataset_stats, factors

PROBLEMS = "dataset string, base string, fix string, ok boolean, passed boolean, patched boolean, adder string, tokens int, changed int"


def test_problem_stats(spark):
    rows = [
        ("a", "x = 1\n# said", "x = 2", False, True, True, "ground_truth_1", 4, 1),
        ("a", "y\n\n\nz", "# a\n# b\ny", None, True, False, "solver", 10, 5),
        ("a", "q", "q", True, True, True, None, 3, 0),
        ("b", "w", None, False, False, True, "solver", 0, 0),
        ("b", "", "", True, None, None, None, 0, 0),
    ]
    got = {r.dataset: r for r in dataset_stats.problem_stats(spark.createDataFrame(rows, PROBLEMS)).collect()}
    a, b, all_ = got["a"], got["b"], got["TOTAL"]
    assert (a.problems, a.solves, a.fails, a.pass_at_1, a.pass_all, a.pass_all_solved, a.patched, a.pass_not_gt, a.patched_gt, a.patched_non_gt) == (3, 1, 1, 0.5, 3, 1, 2, 1, 1, 1)
    assert (a.base_comments_mean, a.fix_comments_median, a.base_lines_mean, a.fix_lines_mean, a.tokens_median) == (1 / 3, 0.0, 4 / 3, 1.0, 4.0)
    assert (a.changed_mean, a.changed_gt_mean, a.changed_non_gt_mean, a.changed_share_median) == (3.0, 1.0, 5.0, 0.375)
    assert (b.pass_all, b.tokens_mean, b.pass_at_1) == (0, None, 0.5) and all_.problems == 5 and all_.pass_at_1 == 0.5
    none = dataset_stats.problem_stats(spark.createDataFrame([], PROBLEMS)).collect()
    assert [r.problems for r in none] in ([], [0])


def test_adder_stats(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(25), rng.choice("abcd"), rng.random() < 0.6, float(rng.randrange(50))) for _ in range(120)]
    got = {r.adder: r for r in dataset_stats.adder_stats(spark.createDataFrame(rows, "problem_id int, adder string, passed boolean, distance double")).collect()}
    best = {}
    for p, a, ok, d in rows:
        if ok:
            best.setdefault(p, {})[a] = min(d, best.get(p, {}).get(a, d))
    for adder in "abcd":
        mine = [r for r in rows if r[1] == adder]
        first = [p for p, x in best.items() if min((d, a) for a, d in x.items())[1] == adder]
        grown = sum(sorted(best[p].values())[1] - best[p][adder] for p in first if len(best[p]) > 1)
        r = got[adder]
        assert (r.passed, r.failed) == (sum(x[2] for x in mine), sum(not x[2] for x in mine))
        assert (r.chosen, r.unique, r.added) == (len(first), sum(len(best[p]) == 1 for p in first), grown)
        assert (r.distance_mean, r.distance_median) == (mean(x[3] for x in mine), median(x[3] for x in mine))


def test_wide(spark):
    df = spark.createDataFrame([("t", "line", 1.0), ("t", "line", 3.0), ("t", "token", 5.0), ("u", "other", 1.0)], "technique string, level string, x double")
    got = sorted(map(tuple, factors.wide(df, ["technique"], "level", ["line", "token"], ["x"]).collect()))
    assert got == [("t", 2.0, 5.0), ("u", None, None)]

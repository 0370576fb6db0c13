"""More queries: ledgers in sequence, flow trees, spreads, levels, bins by given edges, stripped texts, wider tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from plumbline.functions import expr, text
from plumbline.operators import calibration, candidates, factors, ledger, rollup
from plumbline.plans import views
from plumbline.plans.catalog import _METRICS, query
from plumbline.plans.views import EVENTS, TOK
from plumbline.session import table
from plumbline.sources import tables

# --- ledgers ---


def _checked(spark, sf):
    """Documents that a first filter looks up in the labels, with two more filters and tags."""
    known = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = ledger.with_ledger(table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(known, "doc_id", "left"))
    d = ledger.annotate(d, "is_not_none", F.col("quality").isNotNull())
    d = ledger.annotate(d, "is_not_success", F.col("quality") != 1, meta_d=F.col("quality"))
    d = ledger.annotate(d, "long_enough", F.col("n_chars") >= 300, meta_d=F.col("n_chars"))
    d = ledger.tag(d, "chars", d=F.col("n_chars"))
    return ledger.tag(d, "chars", d=F.col("n_chars") / 2, when=F.col("lang") != "en")


_CHECKED = """l AS (SELECT doc_id, MAX(quality) AS quality FROM labels GROUP BY 1), d AS (SELECT doc_id, lang, n_chars, COALESCE(quality IS NOT NULL, FALSE) AS a, COALESCE(quality <> 1, FALSE) AS b, COALESCE(n_chars >= 300, FALSE) AS c FROM documents LEFT JOIN l USING (doc_id)),
s AS (SELECT *, list_filter([CASE WHEN a THEN 'is_not_none' END, CASE WHEN b THEN 'is_not_success' END, CASE WHEN c THEN 'long_enough' END], lambda x: x IS NOT NULL) AS p, list_filter([CASE WHEN NOT a THEN 'is_not_none' END, CASE WHEN NOT b THEN 'is_not_success' END, CASE WHEN NOT c THEN 'long_enough' END], lambda x: x IS NOT NULL) AS f FROM d)"""


@query(f"""WITH {_CHECKED} SELECT doc_id, array_to_string(list_concat(list_transform(p, lambda x: x || '+'), list_transform(f, lambda x: x || '-')), ' ') AS sequence, len(p) AS n_passed, len(f) AS n_failed, f[1] AS first_failed,
ROUND(n_chars + CASE WHEN lang <> 'en' THEN n_chars / CAST(2 AS DOUBLE) ELSE 0 END, 6) AS chars FROM s""")
def flt_sequence(spark, sf):
    s = _checked(spark, sf).select("doc_id", ledger.sequence().alias("q"), ledger.summary().alias("s"), ledger.tag_values("chars").alias("v"))
    shown = F.array_join(F.transform("q", lambda x: F.concat(x["name"], F.when(x["passed"], "+").otherwise("-"))), " ")
    return s.select("doc_id", shown.alias("sequence"), F.col("s.n_passed").cast("long").alias("n_passed"), F.col("s.n_failed").cast("long").alias("n_failed"), F.get("s.failed", F.lit(0)).alias("first_failed"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("chars"))


@query(f"""WITH {_CHECKED} SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (len(f) = 0) AS base, COUNT(*) FILTER (NOT a) AS none, COUNT(*) FILTER (a AND NOT b) AS already_success FROM s GROUP BY 1""")
def src_base_solves(spark, sf):
    d = _checked(spark, sf)
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(ledger.passed_all()).alias("base"), F.count_if(ledger.did_fail("is_not_none")).alias("none"), F.count_if(ledger.did_pass("is_not_none") & ledger.did_fail("is_not_success")).alias("already_success"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, seq, name || CASE WHEN passed THEN '+' ELSE '-' END AS s FROM ev WHERE seq <= 3),
p AS (SELECT path, seq, COUNT(*) AS n FROM (SELECT a.user_id, a.seq, string_agg(b.s, ' > ' ORDER BY b.seq) AS path FROM s a JOIN s b ON a.user_id = b.user_id AND b.seq <= a.seq GROUP BY 1, 2) p GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN seq > 1 THEN array_to_string(string_split(path, ' > ')[:-2], ' > ') END AS parent FROM p)
SELECT c.path, c.n, c.parent, ROW_NUMBER() OVER (PARTITION BY c.parent ORDER BY c.n DESC, c.path) AS place, ROUND(c.n / CAST(COALESCE(u.n, SUM(c.n) OVER (PARTITION BY c.parent)) AS DOUBLE), 6) AS share FROM c LEFT JOIN p u ON u.path = c.parent""")
def so_flow_children(spark, sf):
    step = F.concat("name", F.when(F.col("passed"), "+").otherwise("-"))
    found = ledger.children(ledger.flow(views.ledger(spark, sf), "user_id", step, depth=3))
    return found.withColumn("place", F.col("place").cast("long"))


# --- statistics ---


@query("""SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(o_totalprice), 6) AS mean, ROUND(QUANTILE_CONT(o_totalprice, 0.5), 6) AS median, ROUND(STDDEV_POP(o_totalprice), 6) AS std, ROUND(QUANTILE_CONT(o_totalprice, 0.75), 6) AS p75, ROUND(QUANTILE_CONT(o_totalprice, 0.9), 6) AS p90, ROUND(MAX(o_totalprice) - MIN(o_totalprice), 6) AS range FROM orders GROUP BY 1""")
def ag_percentile_stats(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(*factors.percentile_stats(F.col("o_totalprice")))


@query(f"""WITH {TOK}, l AS (SELECT dataset, problem_id, line_id, COUNT(*) AS n, SUM(y) AS p FROM tok GROUP BY 1, 2, 3), q AS (SELECT dataset, problem_id, SUM(n) AS n, SUM(p) AS p, COUNT(*) AS l, COUNT(*) FILTER (p = n) AS q FROM l GROUP BY 1, 2)
SELECT COALESCE(dataset, 'ALL') AS dataset, COUNT(*) AS problems, CAST(SUM(n) AS BIGINT) AS tokens, CAST(SUM(p) AS BIGINT) AS positive, CAST(SUM(l) AS BIGINT) AS lines, CAST(SUM(q) AS BIGINT) AS positive_lines, COUNT(*) FILTER (l = q) AS "right" FROM q GROUP BY ROLLUP (dataset)""")
def ag_positive_counts(spark, sf):
    found = rollup.positive_counts(views.pred(spark, sf), ["dataset"])
    return found.withColumn("dataset", F.coalesce("dataset", F.lit("ALL")))


_MEDIANS = "SELECT p_brand AS level, COUNT(p_retailprice) AS n, QUANTILE_CONT(p_retailprice, 0.5) AS median FROM part GROUP BY 1"


@query(f"""WITH m AS ({_MEDIANS}), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY median DESC, level) AS hi, ROW_NUMBER() OVER (ORDER BY median, level) AS lo FROM m)
SELECT 'largest' AS side, level, n, ROUND(median, 6) AS median, hi AS place FROM r WHERE hi <= 3 UNION ALL SELECT 'smallest', level, n, ROUND(median, 6), lo FROM r WHERE lo <= 3""")
def so_top_levels(spark, sf):
    part = table(spark, sf, "part")
    both = {side: factors.levels_by_median(part, "p_brand", "p_retailprice", 3, side == "largest") for side in ("largest", "smallest")}
    return tables.tagged_union(both, "side").withColumn("place", F.col("place").cast("long"))


@query("""WITH u AS (SELECT user_id, event_type, AVG(value) AS x FROM events GROUP BY 1, 2) SELECT event_type AS metric, COUNT(*) AS n, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_POP(x), 6) AS std FROM u GROUP BY 1""")
def se_ragged_metrics(spark, sf):
    one = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    maps = one.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "x"))).alias("m"))
    return factors.spread_of_maps(maps, "m")


# --- bins, heat maps ---

_EDGES = [0.0, 0.1, 0.35, 0.9, 1.0]
_EDGE_BIN = "CASE WHEN p >= 0.9 THEN 3 WHEN p >= CAST(0.35 AS DOUBLE) THEN 2 WHEN p >= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END"


@query(f"""WITH {TOK}, b AS (SELECT dataset, {_EDGE_BIN} AS bin, COUNT(*) AS n, AVG(p) AS conf, AVG(CAST(y AS DOUBLE)) AS acc FROM tok GROUP BY 1, 2) SELECT dataset, CAST(bin AS BIGINT) AS bin, n, ROUND(conf, 6) AS conf, ROUND(acc, 6) AS acc, ROUND(ABS(conf - acc), 6) AS gap FROM b""")
def ca_custom_bins(spark, sf):
    return calibration.bins(views.pred(spark, sf), ["dataset"], _EDGES).select("dataset", "bin", "n", "conf", "acc", "gap")


@query(f"""WITH {TOK}, b AS (SELECT dataset, {_EDGE_BIN} AS bin, AVG(p) AS conf, AVG(CAST(y AS DOUBLE)) AS acc FROM tok GROUP BY 1, 2)
SELECT dataset, COUNT(*) AS bins, ROUND(AVG(acc), 6) AS mean_accuracy, ROUND(AVG(acc * (1 - acc)), 6) AS mean_variance, ROUND(MAX(ABS(conf - acc)), 6) AS largest_gap FROM b GROUP BY 1""")
def ca_bin_summary(spark, sf):
    return calibration.bin_summary(calibration.bins(views.pred(spark, sf), ["dataset"], _EDGES), ["dataset"])


_JOINT = """k AS (SELECT problem_id, line_id, MIN(y) AS y FROM tok GROUP BY 1, 2), n AS (SELECT CAST(COUNT(DISTINCT problem_id) AS DOUBLE) AS n FROM k),
m AS (SELECT line_id, SUM(y) / MAX(n) AS m FROM k CROSS JOIN n GROUP BY 1), j AS (SELECT a.line_id AS i, b.line_id AS j, SUM(a.y * b.y) / MAX(n) AS joint FROM k a JOIN k b ON a.problem_id = b.problem_id CROSS JOIN n GROUP BY 1, 2),
c AS (SELECT i, j, CASE WHEN m = 0 THEN 0 ELSE joint / m END AS x FROM j JOIN m ON m.line_id = j)"""


@query(f"WITH {TOK}, {_JOINT} SELECT i, {', '.join(f'ROUND(AVG(CASE WHEN j = {k} THEN x END), 6) AS given_{k}' for k in range(1, 8))} FROM c GROUP BY 1")
def rp_keep_heatmap(spark, sf):
    k = views.pred(spark, sf).groupBy("problem_id", "line_id").agg(F.min("y").alias("y"))
    chances = candidates.keep_chances(k.withColumn("all", F.lit(1)), ["all"], "problem_id", "line_id", "y")
    wide = factors.wide(chances.withColumn("j", F.concat(F.lit("given_"), "j")), ["i"], "j", [f"given_{k}" for k in range(1, 8)], ["p_i_given_j"])
    return wide.toDF("i", *[f"given_{k}" for k in range(1, 8)])


@query(f"""WITH {TOK}, s AS (SELECT gen_model AS g, p, y FROM tok), {_METRICS}, ll AS (SELECT g, -AVG(y * LN(GREATEST(1e-15, LEAST(p, CAST(1 AS DOUBLE) - 1e-15))) + (1 - y) * LN(1 - GREATEST(1e-15, LEAST(p, CAST(1 AS DOUBLE) - 1e-15)))) AS x FROM s GROUP BY 1),
cu AS (SELECT g, SUM(pos) OVER (PARTITION BY g ORDER BY p DESC) AS tp, SUM(n) OVER (PARTITION BY g ORDER BY p DESC) AS pp, SUM(pos) OVER (PARTITION BY g) AS ap FROM r), f1 AS (SELECT g, MAX(2 * tp / CAST(pp + ap AS DOUBLE)) AS x FROM cu GROUP BY 1)
SELECT m.g AS gen_model, n, ROUND(brier, 6) AS brier, ROUND(ece, 6) AS ece, ROUND(auc, 6) AS auc, ROUND(ll.x, 6) AS log_loss, ROUND(f1.x, 6) AS best_f1 FROM m JOIN e ON e.g = m.g JOIN a ON a.g = m.g JOIN ll ON ll.g = m.g JOIN f1 ON f1.g = m.g""")
def ca_model_summary(spark, sf):
    return calibration.model_summary(views.pred(spark, sf), ["gen_model"])


@query(f"""WITH {TOK}, q AS (SELECT problem_id, MIN(p) AS least, CASE WHEN MIN(p) <= 0 THEN 0 ELSE EXP(AVG(LN(p))) END AS gmean, AVG(p) AS mean, MIN(y) AS y FROM tok GROUP BY 1),
w AS (SELECT o_orderkey AS problem_id, least, gmean, mean, COALESCE(y, 0) AS y FROM orders LEFT JOIN q ON o_orderkey = problem_id),
u AS (SELECT 'min' AS estimator, COALESCE(least, 0) AS p, y, least IS NULL AS failed FROM w UNION ALL SELECT 'gmean', COALESCE(gmean, 0), y, gmean IS NULL FROM w UNION ALL SELECT 'mean', COALESCE(mean, 0), y, mean IS NULL FROM w)
SELECT estimator, COUNT(*) AS problems, COUNT(*) FILTER (failed) AS failed, ROUND(AVG(p), 6) AS mean, ROUND(AVG((p - y) * (p - y)), 6) AS brier FROM u GROUP BY 1""")
def ca_all_correct(spark, sf):
    problems = table(spark, sf, "orders").select(F.col("o_orderkey").alias("problem_id"))
    found = rollup.all_correct(problems, views.pred(spark, sf), "problem_id")
    return found.groupBy("estimator").agg(F.count("*").alias("problems"), F.count_if("failed").alias("failed"), F.avg("p").alias("mean"), expr.brier(F.col("p"), F.col("y")).alias("brier"))


# --- texts, wider tables ---


@query(r"""WITH t AS (SELECT conv_id, turn, chr(9) || '  ' || text || ' ' || chr(10) AS s FROM conversations)
SELECT conv_id, turn, LENGTH(regexp_replace(s, '^\s+', '')) AS l, LENGTH(regexp_replace(s, '\s+$', '')) AS r, md5(regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')) AS both, len(string_split(s, chr(10))) AS lines, md5(array_to_string(list_transform(string_split(s, '. '), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), '|')) AS joined FROM t""")
def sc_strip(spark, sf):
    s = F.concat(F.lit("\t  "), "text", F.lit(" \n"))
    md5 = lambda c: F.md5(c.cast("binary"))
    parts = F.array_join(F.transform(F.split("s", r"\. ", -1), text.stripped), "|")
    return table(spark, sf, "conversations").select("conv_id", "turn", s.alias("s")).select(
        "conv_id", "turn", F.length(text.left_stripped(F.col("s"))).cast("long").alias("l"), F.length(text.right_stripped(F.col("s"))).cast("long").alias("r"), md5(text.stripped(F.col("s"))).alias("both"), F.size(expr.lines(F.col("s"))).cast("long").alias("lines"), md5(parts).alias("joined")
    )


@query(r"""WITH t AS (SELECT doc_id, string_split(replace(replace(text, chr(10), chr(266)), ' ', ' ' || chr(288)), ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(t) AS tokens, md5(array_to_string(list_transform(t, lambda x: replace(replace(x, chr(288), ' '), chr(266), chr(10))), '')) AS text FROM t""")
def sc_byte_tokens(spark, sf):
    marked = F.replace(F.replace("text", F.lit("\n"), F.lit("\u010a")), F.lit(" "), F.lit(" \u0120"))
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split(marked, " ", -1).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join(F.transform("t", text.token_text), "").cast("binary")).alias("text"))


@query("SELECT CAST(NULL AS BIGINT) AS fix_id, doc_id, lang, CAST(n_chars AS DOUBLE) AS n_chars, CAST(NULL AS VARCHAR) AS fix, source FROM documents")
def prj_widened(spark, sf):
    wide = StructType([StructField("fix_id", LongType()), StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("n_chars", DoubleType()), StructField("fix", StringType())])
    return tables.widened(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), wide)


@query("""SELECT doc_id, len(w) AS n, list_min(list_transform(w[2:4], lambda x: LENGTH(x))) AS least, ROUND(list_avg(list_transform(w[2:4], lambda x: LENGTH(x))), 6) AS mean, list_contains(w, 'the') AS has, array_to_string(list_concat(w[1:3], list_transform(range(GREATEST(3 - len(w), 0)), lambda i: '-')), ' ') AS padded FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL) d""")
def sc_array_slices(spark, sf):
    w = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", " ", -1).alias("w"))
    part = F.transform(F.slice("w", 2, 3), lambda x: F.length(x))
    mean = F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.size(part))
    padded = F.concat(F.slice("w", 1, 3), F.array_repeat(F.lit("-"), F.greatest(3 - F.size("w"), F.lit(0))))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_min(part).cast("long").alias("least"), mean.alias("mean"), F.array_contains("w", "the").alias("has"), F.array_join(padded, " ").alias("padded"))


@query("""SELECT event_id, json_extract_string(j, '$.kind') AS kind, CAST(json_extract_string(j, '$.value') AS DOUBLE) AS value, json_extract_string(j, '$.k') AS k FROM (SELECT event_id, to_json({'kind': event_type, 'value': ROUND(value, 4), 'k': json_extract_string(props, '$.k')}) AS j FROM events) e""")
def sc_json_meta(spark, sf):
    made = F.to_json(F.struct(F.col("event_type").alias("kind"), F.round("value", 4).alias("value"), F.get_json_object("props", "$.k").alias("k")))
    back = F.from_json(made, "kind string, value double, k string")
    return table(spark, sf, "events").select("event_id", back.alias("j")).select("event_id", "j.kind", "j.value", "j.k")

"""Queries of the numbered operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.additive_ann import nearest
from plumbline.llm.html import extract
from plumbline.llm.mixing import mix
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.order_minhash import order_fingerprints
from plumbline.llm.packing import pack_best_fit, pack_in_order
from plumbline.llm.spelling import variants
from plumbline.llm.substring import remove_repeated_spans
from plumbline.llm.suffix_lm import score_corpus
from plumbline.llm.toxicity import fit, score
from plumbline.llm.vector_codes import compress
from plumbline.llm.warc import archived
from plumbline.session import table


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def op1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_fingerprints(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), most=4096)


def op6_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), span=3)


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), entropy=0.95).select("doc_id", "source", "_tokens", "_weight", "_epoch", "_block", "_order")


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), rows=fold("id", 4) != 2)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    return score_corpus(docs, learn=~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_in_order(table(spark, sf_dir, "documents"), most=4096)


def op11_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, table(spark, sf_dir, "documents"))


def op13_integer_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark, table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_text_density": op1_text_density,
    "op2_additive_quantisation": op2_additive_quantisation,
    "op3_order_minhash": op3_order_minhash,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sentence_span_dedup": op6_sentence_span_dedup,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_compression_toxicity": op8_compression_toxicity,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_order_preserving_packing": op10_order_preserving_packing,
    "op11_seekable_warc": op11_seekable_warc,
    "op12_spelling_neighbourhood": op12_spelling_neighbourhood,
    "op13_integer_codebooks": op13_integer_codebooks,
}

#: Sets of shingles as text, links by their common shingles, and components by recursion.
_NEAR_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, UNNEST(range(1, GREATEST(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * m >= 85 * (x.n + y.n - m)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x, MIN(y) AS y FROM r GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, m.y AS component_id, COALESCE(d.doc_id = m.y, FALSE) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

_WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS n, sha256(COALESCE(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 AND page_id > MIN(page_id) OVER (PARTITION BY d) THEN MIN(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, first AS refers_to FROM f"""

_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"[: len(_ACCENTED)]

#: crc32 from its polynomial; near words share a string with at most one letter deleted, and have the distance 1 (worked out on one byte a letter).
_SPELLING_SQL = f"""WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
u AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, UNNEST(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS u FROM documents),
l AS (SELECT id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u, COUNT(*) AS n FROM u GROUP BY 1, 2),
h AS (SELECT u, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || u, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM l, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(u, 1, h % length(u)) || substr(u, h % length(u) + 2) ELSE u END AS word, n FROM h),
v AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n, translate(word, '{_ACCENTED}', '{_ONE_BYTE}') AS k FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING SUM(n) >= 5),
d AS (SELECT word, n, k, UNNEST(list_distinct(list_prepend(k, list_transform(range(length(k)), lambda i: substr(k, 1, i) || substr(k, i + 2))))) AS s FROM v),
e AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.s = b.s AND a.word <> b.word WHERE levenshtein(a.k, b.k) = 1),
g AS (SELECT word, n, COUNT(*) AS n_near, arg_max(near, (near_n, -rank)) AS best, MAX(near_n) AS best_n FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY near) AS rank FROM e) GROUP BY 1, 2),
f AS (SELECT v.word, v.n, COALESCE(g.n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN g USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL"""


def _codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Vectors of parts x width components."""
    far = " + ".join(f"(p.x[{i}] - c.x[{i}]) * (p.x[{i}] - c.x[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"(SUM(p.x[{i}]) - ((SUM(p.x[{i}]) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*)" for i in range(1, width + 1))
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT p.vec_id, p.row, p.label, p.part, MIN({{'d': {far}, 'e': c.entry}}) AS m FROM p JOIN c{k} c ON p.part = c.part GROUP BY ALL)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT a.part, a.m.e AS entry, [{mean}] AS x FROM a{k} a JOIN p ON p.row = a.row AND p.part = a.part GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS (SELECT c.part, c.entry, CAST(COALESCE(m.x, c.x) AS BIGINT[]) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)")
    return f"""WITH v AS (SELECT vec_id, label, ROW_NUMBER() OVER (ORDER BY vec_id, embedding) AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {parts * width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, row, part, e[part * {width} + 1:part * {width} + {width}] AS x FROM v, range({parts}) t(part)),
c0 AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),
{", ".join(steps)},
s AS (SELECT vec_id, row, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(SUM(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
k AS (SELECT sha256(string_agg(y, ',' ORDER BY part, entry, i)) AS sha FROM (SELECT part, entry, UNNEST(range({width})) AS i, UNNEST(x) AS y FROM c{rounds}))
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM s, k"""


ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": _NEAR_SQL,
    "op11_seekable_warc": _WARC_SQL,
    "op12_spelling_neighbourhood": _SPELLING_SQL,
    "op13_integer_codebooks": _codes_sql(),
}

import random

import pytest
from conftest import prose

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.mixing import mix


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2], name
    assert kept[2] < kept[1] and kept[4] == kept[3]  # near-duplicates go; mixing leaves no document out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == kept[-1]


def test_mixing_and_packing_keep_the_order_of_the_mixture(spark, tmp_path):
    rng = random.Random(8)
    # later documents are longer, so that files differ in size
    rows = [(i, prose(rng, 2 + i // 20), "en", "big" if i < 600 else f"s{i % 4}", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    mixed = corpus_pipeline.mixing(spark, docs, "")
    assert mixed.columns == docs.columns
    want = [r.doc_id for r in sorted(mix(docs, repetition=1.5, cover=True).select("doc_id", "_order").collect(), key=lambda r: (r._order, r.doc_id))]
    got = [r.doc_id for r in mixed.collect()]
    assert got == want and len(want) > 900 and not any(a == b for a, b in zip(want, want[1:], strict=False))

    # files in this order, whose sizes rise: a reader that goes by size would turn them round
    at = {}
    for place, i in enumerate(want):
        at.setdefault(i, []).append(place)
    text = {r[0]: r[1] for r in rows}
    order = sorted(range(900), key=lambda i: at[i][0])
    sizes = [20, 40, 80, 160, 600]
    for k, size in enumerate(sizes):
        part = [(i, text[i], "en", "s", 1) for i in order[sum(sizes[:k]) : sum(sizes[: k + 1])]]
        spark.createDataFrame(part, docs.schema).coalesce(1).write.parquet(str(tmp_path / "one"))
        (made,) = (tmp_path / "one").glob("*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"part-{k:05}.parquet")
        (tmp_path / "one").rename(tmp_path / f"old{k}")
    read = spark.read.schema(docs.schema).parquet(str(tmp_path / "all"))
    pieces = corpus_pipeline.packing(spark, read, "").where("start = 0").select("doc_id", "sequence_id", "offset").collect()
    assert [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))] == order


def test_stages_take_odd_rows_and_any_columns(spark, sf, tmp_path):
    """Null and empty texts, null and repeated ids, a long text, columns with names that operators use inside; and an empty table."""
    rng = random.Random(12)
    base = prose(rng, 30)
    texts = [None, "", " \n", base, base, base.replace("the", "a thing"), "w" * 30_000 + " " + prose(rng, 200), prose(rng, 40), "Two words", prose(rng, 25)]
    rows = [(None if i == 9 else min(i, 7), t, "en", None if i == 5 else f"s{i % 2}", None, i, f"x{i}", i * 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_removed` int, `_order` string, `extra_0` int")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), docs.schema)
            kept = [tuple(r) for r in now.collect()]
            own = {r[5:] for r in rows}
            assert {r[5:] for r in kept} <= own and len(kept) <= 2 * table.count(), name
        now.coalesce(1).write.parquet(str(tmp_path / f"t{table.count()}"))
        last = corpus_pipeline.packing(spark, spark.read.schema(docs.schema).parquet(str(tmp_path / f"t{table.count()}")), sf)
        pieces = last.collect()
        assert {r.doc_id for r in pieces} == {r[0] for r in kept} and bool(pieces) == bool(kept)


def test_packing_goes_by_the_number_of_files(spark, tmp_path):
    for part, i in ((99_999, 1), (100_000, 2), (8, 0)):
        spark.createDataFrame([(i, f"text {i}")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
        (made,) = (tmp_path / "one").glob("*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"part-{part:05}-x.parquet")
        (tmp_path / "one").rename(tmp_path / f"old{i}")
    read = spark.read.parquet(str(tmp_path / "all"))
    pieces = corpus_pipeline.packing(spark, read, "").where("start = 0").select("doc_id", "sequence_id", "offset").collect()
    assert [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))] == [0, 1, 2]

import random

import numpy as np
import pyarrow as pa
from conftest import prose
from pyspark.sql import functions as F

from plumbline.llm.toxicity import Toxicity, _words, fit, score, train, without_toxic
from plumbline.llm.words import word_hashes

BAD = "scoundrel blockhead nincompoop rotter".split()


def sample(rng, n):
    texts, labels = [], []
    for i in range(n):
        t = prose(rng).split()
        bad = i % 4 == 0
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(BAD))
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_held_out_accuracy():
    rng = random.Random(1)
    model = train(pa.array(sample(rng, 200)[0]), sample(random.Random(1), 200)[1])
    texts, labels = sample(rng, 200)
    found = model.scores(pa.array(texts)) >= 0.3
    assert (found == labels).mean() > 0.97


def test_slices_have_their_own_words():
    texts = pa.array(["a b", "c d e", "", "f a"])
    for i in range(4):
        names, codes, offsets = _words(texts.slice(i))
        assert [[names[c].decode() for c in codes[a:b] if names[c]] for a, b in zip(offsets, offsets[1:])] == [t.split() for t in texts.to_pylist()[i:]]
        assert word_hashes(texts.slice(i))[0].tolist() == word_hashes(pa.array(texts.to_pylist()[i:]))[0].tolist()


def test_no_labels():
    assert train(pa.array(["a"]), np.array([0])).scores(pa.array(["x", None])).tolist() == [0, 0]
    assert Toxicity().scores(pa.array(["x"])).tolist() == [0]


def test_tables(spark, make_docs, odd_docs):
    texts, labels = sample(random.Random(3), 120)
    docs = make_docs(texts)
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    model = fit(docs, marks, rows=F.col("id") % 3 != 0)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert sum((got[i] >= 0.3) == labels[i] for i in got) > 115
    assert without_toxic(docs, model).columns == docs.columns
    odd = score(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    kept = without_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() <= 10
    assert score(odd_docs.limit(0), model).count() == 0
    assert fit(docs, marks.limit(0)).prior == 0


def test_gains_are_differences_of_compressed_lengths():
    """Each window compressed alone, by the plain interface, with each of the two dictionaries."""
    import zstandard as z

    from plumbline.llm.toxicity import FRAME, LEVEL

    texts, labels = sample(random.Random(3), 120)
    model = train(pa.array(texts), labels)
    assert model.toxic != model.ordinary and all(w.encode() in model.toxic for w in BAD)
    names = sorted({w for t in texts[:20] for w in t.lower().split()} | set(BAD))
    options = z.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    size = lambda d, w: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=options).compress(FRAME + w.encode() + FRAME))
    want = [size(model.ordinary, w) - size(model.toxic, w) for w in names]
    assert model.gains([w.encode() for w in names]).tolist() == want
    assert min(g for w, g in zip(names, want) if w in BAD) > max(g for w, g in zip(names, want) if w not in BAD) - 3


def test_few_texts_serve_for_both():
    model = train(pa.array(["a bad text", "a good one", "fine"]), np.array([1, 0, 0]))
    assert 0 < model.scores(pa.array(["a bad text"]))[0] < 1
    assert train(pa.array(["x"]), np.array([1]), 0.4).scores(pa.array(["x", None])).tolist() == [0.4, 0.4]

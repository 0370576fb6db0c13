import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from plumbline.llm.order_minhash import SLOTS, TUPLE, fingerprints, kmer_hashes, likeness, order_fingerprints


def test_edits_and_likeness(spark, make_docs):
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(300)]
    texts[10] = texts[11] = texts[250]
    texts[20] = " ".join(reversed(texts[21].split()))
    got = order_fingerprints(make_docs(texts)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(300))
    for i, r in enumerate(got):
        t, after = texts[i], texts[(i + 1) % 300]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert got[10].fingerprint == got[11].fingerprint == got[250].fingerprint and got[10].near_next == 1
    assert sum(r.near_edited > r.near_next for r in got) > 280
    assert got[20].near_next < 0.2  # the same words in another order
    assert len({r.fingerprint for r in got}) == 298


def test_odd_rows(spark, odd_docs):
    got = order_fingerprints(odd_docs).collect()
    assert len(got) == 10 and Counter(r.doc_id for r in got)[5] == 2
    empty = {r.doc_id: r for r in got}[8]
    assert empty.n_chars == 0 and set(empty.fingerprint) == {"-"}
    assert {r.doc_id: r for r in got}[7].near_next == 1.0  # null and empty texts are alike
    assert order_fingerprints(odd_docs.limit(0)).count() == 0
    one = order_fingerprints(odd_docs.where("doc_id = 2")).first()
    assert one.near_next == 1.0


def _hash(*values):
    """Spark's xxhash64 of some columns: each is hashed with the hash of those before it as seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, Int) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    pass


def plain_fingerprint(text, k=2, slots=SLOTS, size=TUPLE):
    """Each slot from all k-mers of the text, by the definition."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return None
    kmers = [_hash(*words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [_hash(" ".join(words), Int(len(words)))]
    seen, ranges = Counter(), {}
    for pos, h in enumerate(kmers):
        seen[h] += 1
        u = _hash(h, Int(seen[h]))
        part = u % (slots * size)
        ranges[part] = min(ranges.get(part, (u, pos, h)), (u, pos, h))
    out = []
    for slot in range(slots):
        order = sorted(ranges, key=lambda p: ((p - slot * size) % (slots * size) if p >= slot * size else p + slots * size))
        taken = sorted(ranges[order[i % len(order)]][1:] for i in range(size))
        value = 42
        for _, h in taken:
            value = _hash(value, h)
        out.append(value % (1 << 16))
    return out


def test_fingerprints_are_the_plain_ones(spark):
    rng = random.Random(3)
    texts = ["", "one", "one two", "a a a a a a a", " b  a\tb a", *(prose(rng, n) for n in (1, 2, 3, 8, 40, 200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "_id int, _text string").repartition(2, "_id")
    got = {r._id: r._fp for r in fingerprints(rows, ["_id"]).collect()}
    assert [got.get(i) for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("sentences", [6, 12, 60])
def test_moved_sentences_tell_in_texts_of_any_length(spark, sentences):
    """The same word pairs but for the seams, in another order: MinHash of the pairs would see next to no difference."""
    rng = random.Random(sentences)
    rows = []
    for k in range(20):
        parts = [prose(rng, 1, 8) for _ in range(sentences)]
        rows += [(k, 0, " ".join(parts)), (k, 1, " ".join(reversed(parts))), (k, 2, " ".join([*parts[:-1], prose(rng, 1, 8)]))]
    df = spark.createDataFrame(rows, "_id int, _side int, _text string").repartition(3, "_id")
    pairs = df.select("_id", "_side", F.array_distinct(kmer_hashes(F.col("_text"), 2)).alias("k")).collect()
    sets = {(r._id, r._side): set(r.k) for r in pairs}
    alike = [len(sets[k, 0] & sets[k, 1]) / len(sets[k, 0] | sets[k, 1]) for k in range(20)]
    marks = fingerprints(df, ["_id", "_side"]).groupBy("_id").pivot("_side", [0, 1, 2]).agg(F.first("_fp"))
    found = [(r.moved, r.edited) for r in marks.select(likeness(F.col("0"), F.col("1")).alias("moved"), likeness(F.col("0"), F.col("2")).alias("edited")).collect()]
    moved, edited = (sum(x) / len(found) for x in zip(*found, strict=True))
    assert sum(alike) / 20 > 0.6 and moved < 0.55 * sum(alike) / 20 and moved < edited

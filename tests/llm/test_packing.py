import random
import zlib

import numpy as np
import pytest
from conftest import prose

from plumbline.llm.packing import CapacityTree, best_fit_decreasing, cut_windows, pack_best_fit, pack_in_order
from plumbline.llm.tokens import default_path, encoder


def reference_ids(text):
    return [*encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["Don't  I'LL go.\nNow", "ΣΊΣΥΦΟΣ ς ﬁ é́ x y\x1cz\x85w", "ẞß İ <|endoftext|>!!", "", None, " a1b22 %%%...", "Ünïcödé ÀÉ×÷ 漢字かな"])
def test_encoder_is_the_tokenizer(text):
    import pyarrow as pa

    ids, offsets = encoder(default_path()).encode(pa.array([text, "x"]), 2)
    assert ids[: offsets[1]].tolist() == reference_ids(text)


def test_best_fit_is_the_textbook_one():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    rooms, expected = [], np.zeros(400, int)
    for at in np.argsort(-lengths, kind="stable"):
        fits = [(r, -i) for i, r in enumerate(rooms) if r >= lengths[at]]
        if fits:
            best = min(r for r, _ in fits)
            i = [k for k, r in enumerate(rooms) if r == best][0]
        else:
            i, _ = len(rooms), rooms.append(100)
        rooms[i] -= lengths[at]
        expected[at] = i
    got = best_fit_decreasing(lengths, 100)
    assert np.bincount(got, weights=lengths).max() <= 100
    assert sorted(np.bincount(got, weights=lengths)) == sorted(np.bincount(expected, weights=lengths))


def test_capacity_tree():
    tree = CapacityTree(10)
    assert tree.pop(1) is None
    tree.push(4, 0), tree.push(9, 1)
    assert tree.pop(5) == (1, 9) and tree.pop(5) is None and tree.pop(4) == (0, 4)


def test_windows_cost_least():
    rng = random.Random(8)
    for _ in range(60):
        points = [0]
        while len(points) < 14:
            points.append(points[-1] + rng.randrange(1, 9))
        costs = [rng.choice([0, 1, 3]) for _ in points]
        costs[0] = costs[-1] = 0
        price = lambda w: 0 if w & (w - 1) == 0 or w == 20 else 20 - w
        best = [0] + [None] * 13
        for j in range(1, 14):
            best[j] = min(best[i] + price(points[j] - points[i]) + costs[j] for i in range(j) if points[j] - points[i] <= 20)
        cuts = cut_windows(np.array(points), np.array(costs), 20)
        assert cuts[0] == 0 and cuts[-1] == points[-1]
        assert sum(price(b - a) + costs[points.index(b)] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_in_order_is_a_round_trip(spark, make_docs):
    rng = random.Random(5)
    texts = {i: prose(rng, rng.choice([1, 5, 60])) for i in range(60)} | {70: None, 71: ""}
    rows = pack_in_order(make_docs(texts).coalesce(2), most=256, block_tokens=5000).collect()
    sequences = {}
    for i, t in texts.items():
        ids, place = reference_ids(t), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[place : place + r.length], "<u4").tobytes())
            place += r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert place == len(ids)
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
        padding += 0 if end & (end - 1) == 0 else 256 - end
    assert padding < 0.1 * sum(n for p in sequences.values() for _, n in p)


def test_best_fit_is_a_round_trip(spark, make_docs):
    rng = random.Random(6)
    texts = {i: prose(rng, rng.choice([1, 4, 50])) for i in range(50)} | {70: None}
    rows = pack_best_fit(make_docs(texts).coalesce(2), most=200, pad=9).collect()
    parts = {}
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == 200 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert all(x == 9 for x in r.input_ids[r.n_tokens :])
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert r.position_ids[a:b] == list(range(b - a))
            parts.setdefault(r.doc_ids[k], {})[r.starts[k]] = r.input_ids[a:b]
    for i, t in texts.items():
        assert [x for _, p in sorted(parts[i].items()) for x in p] == reference_ids(t)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_odd_rows(spark, odd_docs):
    rows = pack_in_order(odd_docs).collect()
    whole = sum(r.length for r in rows)
    assert whole == sum(len(reference_ids(r.text)) for r in odd_docs.collect())
    assert sum(r.n_tokens for r in pack_best_fit(odd_docs).collect()) == whole
    assert pack_in_order(odd_docs.limit(0)).count() == 0 and pack_best_fit(odd_docs.limit(0)).count() == 0

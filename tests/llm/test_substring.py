import random
import re

from conftest import prose

from plumbline.llm.substring import remove_repeated_spans


def brute(texts, span=3, least_words=12):
    """Sentences by a plain loop, for texts without very long sentences."""
    split = {i: [m.group() for m in re.finditer(r"\S[^\n]*?(?:[.!?][\"')\]]?(?=\s|$)|(?=\n|$))\s*", t)] for i, t in texts.items()}
    words = {i: [s.lower().split() for s in ss] for i, ss in split.items()}
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        for k in range(len(words[i]) - span + 1):
            key = tuple(w for s in words[i][k : k + span] for w in s)
            if len(key) < least_words:
                continue
            if first.setdefault(key, (i, k)) != (i, k):
                gone[i] |= set(range(k, k + span))
    return {i: "".join(s for k, s in enumerate(split[i]) if k not in gone[i]) for i in texts}


def test_same_as_a_loop(spark, make_docs):
    rng = random.Random(3)
    passage = prose(rng, 6, 6)
    texts = {}
    for i in range(80):
        t = [prose(rng, 3, 6), prose(rng, 4, 6)]
        if i % 5 == 0:
            t.insert(1, passage if i % 10 else passage.upper().replace(" ", "  "))
        texts[i] = rng.choice([" ", "\n"]).join(t)
    texts[90] = "\n".join([passage] * 3)
    got = {r.doc_id: r.text for r in remove_repeated_spans(make_docs(texts), most_words=1000).collect()}
    assert got == brute(texts)
    assert got[0] == texts[0] and passage not in got[5] and got[1] == texts[1]


def test_long_sentences_are_cut_alike(spark, make_docs):
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    texts = {1: prose(rng, 3) + " " + passage + ".", 2: prose(rng, 5) + " Here " + passage + "."}
    got = {r.doc_id: r for r in remove_repeated_spans(make_docs(texts)).collect()}
    assert got[1].text == texts[1] and len(got[2].text) < len(texts[2]) - 0.7 * len(passage)


def test_odd_rows(spark, odd_docs):
    got = remove_repeated_spans(odd_docs)
    assert got.columns == [*odd_docs.columns, "_sentences", "_removed"]
    rows = got.collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(rows) == 10 and texts[7] == [None] and texts[8] == [""] and texts[9] == [" \n\t "]
    assert texts[5][0] == texts[5][1] != "" and texts[12] == [""] and texts[None] == texts[5][:1]
    assert remove_repeated_spans(odd_docs.limit(0)).count() == 0


def brute_runs(texts, size=50):
    """Words by a plain loop, for texts without repeated sentences: a word goes if a run of `size` around it came before."""
    first, out = {}, {}
    for i in sorted(texts):
        words = texts[i].split()
        gone = set()
        for k in range(len(words) - size + 1):
            key = tuple(w.lower() for w in words[k : k + size])
            j, at = first.setdefault(key, (i, k))
            if j != i or k - at >= size:
                gone |= set(range(k, k + size))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def test_passages_inside_sentences_go_whole(spark, make_docs):
    rng = random.Random(6)
    plain = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]  # noqa: E731  no sentence ends
    texts, passages = {}, {}
    for i in range(0, 200, 2):
        passages[i] = passage = plain(rng.randrange(51, 100))
        for k in (i, i + 1):
            host = plain(rng.randrange(0, 300))
            at = rng.randrange(len(host) + 1)
            texts[k] = " ".join([*host[:at], *passage, *host[at:]])
    texts[300] = " ".join([*plain(9), *passages[0], *plain(5), *passages[0], *plain(9)])
    repeated = plain(70)
    texts[301] = " ".join([*plain(9), *repeated, *plain(5), *repeated, *plain(9)])
    texts[302] = "la " * 300
    rows = remove_repeated_spans(make_docs(texts), least_words=10**6, run_words=50).collect()
    got = {r.doc_id: r.text.split() for r in rows}
    assert got == brute_runs(texts)
    assert all(got[i] == texts[i].split() and not set(p) & set(got[i + 1]) for i, p in passages.items())
    assert got[302] == ["la"] * 50 and {r.doc_id: r._removed > 0 for r in rows} == {i: got[i] != t.split() for i, t in texts.items()}
    default = {r.doc_id: set(r.text.split()) for r in remove_repeated_spans(make_docs(texts)).collect()}
    assert not any(set(p) & default[i + 1] for i, p in passages.items())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine.", 4, "r")], "doc_id long, text string, _removed int, _runs string")
    out = remove_repeated_spans(df)
    assert out.columns == ["doc_id", "text", "_removed_in", "_runs", "_sentences", "_removed"]
    assert tuple(out.first()) == (1, "One two three. Four five six. Seven eight nine.", 4, "r", 3, 0)

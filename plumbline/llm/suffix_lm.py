"""A probabilistic suffix tree over words: variable-length contexts, kept by a divergence test."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch
from plumbline.llm.words import mix, slices, word_hashes

#: Words of a context at most.
DEPTH = 4
#: Parts of all tokens. A word under HEAD is looked up by a join, and there are at most 1 / HEAD others; a context
#: must make up CONTEXT or more, and a next word after it JOINT or more, so a level has at most 1 / CONTEXT and 1 / JOINT.
HEAD, CONTEXT, JOINT = 1e-7, 2e-6, 2e-7
#: Log-likelihood (nats) that a context must gain over its suffix on all training tokens to be kept.
CUTOFF = 4.0
#: What of each next word's count goes to the words that its context hasn't. Like the cutoff, chosen on held-back training documents (see README).
DISCOUNT = 1.0
#: The same for contexts of one word that make up less than CONTEXT: most of them have few next words, each of them once.
RARE_DISCOUNT = 0.7

_END = np.uint64(0x1D8E4E27C47D124F)
_STEP = np.uint64(0xA24BAED4963EE407)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by the end, and n + 1 offsets."""
    hashes, offsets = word_hashes(texts)
    return np.insert(hashes, offsets[1:], _END), offsets + np.arange(len(offsets))


def _grams(tokens: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each context length from 1: the context and the run of words that ends at each token, as ids; 0 where the text is too short.

    The first word of a text follows the end.
    """
    ends = offsets[1:] - 1
    run = mix(tokens)
    for _ in range(depth):
        context = np.empty_like(run)
        context[1:] = run[:-1]
        first = offsets[:-1]
        context[first] = mix(np.array([_END]))[0] if _ == 0 else 0
        run = np.where(context == 0, np.uint64(0), mix(context * _STEP + tokens))
        yield context, run
        run = run.copy()
        run[ends] = 0  # no context reaches over the end


def _inside(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the ascending table, and where."""
    if not len(table):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


class _Table:
    """Ascending hashes, found by their first bits: a few steps for each value, however many there are."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = max(len(table), 2).bit_length()
        self.shift = np.uint64(64 - bits)
        self.starts = np.append(np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(table)).astype(np.int32)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each value is in the table, and where."""
        bucket = (values >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        held = np.zeros(len(values), dtype=bool)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here, sought = self.table[at[open_]], values[open_]
            held[open_[here == sought]] = True
            open_ = open_[here < sought]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return held, np.minimum(at, max(len(self.table) - 1, 0))


class _Counter:
    """Sums counts of keys (rows of one or two columns), merging now and then."""

    def __init__(self, most: int = 1_000_000):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.most = 0, most

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(self._merged([(*columns, np.ones(len(columns[0]), np.int64))]))
        self.size += len(self.held[-1][0])
        if self.size > self.most:
            self.held = [self._merged(self.held)]
            self.size = len(self.held[0][0])
            self.most = max(self.most, 2 * self.size)

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        *keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys[0] if len(keys) == 1 else keys[0] * _STEP + keys[1])  # equal rows side by side
        keys, counts = [k[order] for k in keys], counts[order]
        if not len(counts):
            return (*keys, counts)
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        return (*(k[new] for k in keys), np.add.reduceat(counts, new))

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = self._merged(self.held)
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].view(np.int64)) for c in columns], names=names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counter()
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                counts.add(_tokens(part.column("text"))[0])
        yield from counts.rows(["x", "n"])


def _count_next(shared, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, below, words = shared.value  # contexts of this length, runs of words that may be extended, next words
        contexts, nexts = _Table(contexts), _Table(words if depth == 1 else below)
        counts = _Counter()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    tokens, offsets = _tokens(part.column("text"))
                    shorter = mix(tokens)
                    for level, (context, grams) in enumerate(_grams(tokens, offsets, depth), 1):
                        if level == depth:
                            at = np.flatnonzero(contexts.find(context)[0])
                            at = at[nexts.find(tokens[at] if depth == 1 else shorter[at])[0]]
                            counts.add(context[at], tokens[at])
                        shorter = grams
            yield from counts.rows(["c", "x", "n"])

    return run


@dataclass
class Level:
    """Contexts of one length, ascending, and the runs of a context and a next word, ascending."""

    contexts: np.ndarray
    back: np.ndarray  # log10 of what a word that the context hasn't gets of its chance after the suffix
    runs: np.ndarray
    chance: np.ndarray  # log10


@dataclass
class SuffixTree:
    total: int
    distinct: int
    words: np.ndarray  # ascending
    counts: np.ndarray
    levels: list[Level] = field(default_factory=list)
    rare: float = 0.0  # a word of a smaller count is a context that score() learns
    cutoff: float = CUTOFF
    rare_discount: float = RARE_DISCOUNT

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 chance of words with these counts when no context is known."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def tables(self) -> list[_Table]:
        """For looking up words, and contexts and runs of each length."""
        return [_Table(t) for t in [self.words, *(t for level in self.levels for t in (level.contexts, level.runs))]]

    def chances(self, tokens: np.ndarray, offsets: np.ndarray, tables: list[_Table] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each token: log10 of its chance without context; of its chance after the longest kept suffix; whether the word itself is at hand; where. Where it isn't, its chance without context is missing from both."""
        words, *tables = tables or self.tables()
        known, at = words.find(tokens)
        base = np.where(known, self.root(self.counts[at] if len(self.counts) else np.zeros(len(tokens))), 0.0)
        levels, held = [], np.arange(len(tokens))
        for (context, runs), level, contexts, nexts in zip(_grams(tokens, offsets, len(self.levels)), self.levels, tables[::2], tables[1::2], strict=True):
            found, c = contexts.find(context[held])  # a context is kept only if its suffix is
            held, c = held[found], c[found]
            levels.append((level, held, c, *nexts.find(runs[held])))
        out, open_ = np.zeros(len(tokens)), np.ones(len(tokens), dtype=bool)
        for level, held, c, told, r in reversed(levels):
            still = open_[held]
            told = told & still
            out[held[told]] += level.chance[r[told]]
            open_[held[told]] = False
            less = still & ~told
            out[held[less]] += level.back[c[less]]
        out[open_] += base[open_]
        return base, out, known, at


def _build(word_counts: tuple[np.ndarray, np.ndarray], total: int, distinct: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cutoff: float, discount: float, rare: float, rare_discount: float) -> SuffixTree:
    """The tree from the frequent (context, next word, count) of each length."""
    tree = SuffixTree(total, distinct, *word_counts, rare=rare, cutoff=cutoff, rare_discount=rare_discount)
    with np.errstate(over="ignore"):
        root = lambda x: tree.root(tree.counts[_inside(x, tree.words)[1]])
        ids = mix(tree.words)
        order = np.argsort(ids)
        known = (ids[order], np.zeros(len(ids), np.uint64), tree.counts[order].astype(float))  # contexts of this length, ascending, with their suffixes and counts
        drafts = []
        for depth, (c, x, n) in enumerate(found, 1):
            runs = mix(c * _STEP + x)
            place = np.searchsorted(known[0], c)
            suffix, count = known[1][place], known[2][place]
            shorter = mix(x) if depth == 1 else mix(suffix * _STEP + x)  # the run without its first word
            # chance of the next word after the suffix, as the drafts give it
            parent = root(x)
            if depth > 1:
                up = drafts[-1]
                told, r = _inside(shorter, up["runs"])
                held, k = _inside(suffix, up["contexts"])
                parent = np.where(told, up["chance"][r], np.where(held, up["back"][k], 0) + up["parent_of"](suffix, x))
            group, member = np.unique(c, return_inverse=True)
            first = np.searchsorted(np.sort(member), np.arange(len(group)))
            of_group = count[np.argsort(member, kind="stable")][first] if len(group) else np.zeros(0)
            mass = np.bincount(member, weights=n - discount, minlength=len(group)) / np.maximum(of_group, 1)
            above = np.bincount(member, weights=10.0**parent, minlength=len(group))
            back = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - above, 1e-12))
            chance = np.log10((n - discount) / np.maximum(count, 1))
            gain = np.bincount(member, weights=n * (chance - parent), minlength=len(group)) + np.maximum(of_group - np.bincount(member, weights=n, minlength=len(group)), 0) * back
            order = np.argsort(runs)
            draft = {"contexts": group, "back": back, "runs": runs[order], "chance": chance[order], "context_of": c[order], "gain": gain * np.log(10), "suffix": known[1][np.searchsorted(known[0], group)]}
            previous = drafts[-1] if drafts else None

            def parent_of(suffix: np.ndarray, x: np.ndarray, previous=previous, draft=draft) -> np.ndarray:
                """Chance of x after the suffix of the context `suffix` of this length."""
                if previous is None:
                    return root(x)
                held, k = _inside(suffix, draft["contexts"])
                shorter = np.where(held, draft["suffix"][k], np.uint64(0))
                told, r = _inside(mix(shorter * _STEP + x), previous["runs"])
                inside, j = _inside(shorter, previous["contexts"])
                return np.where(told & inside, previous["chance"][r], np.where(inside, previous["back"][j], 0) + previous["parent_of"](shorter, x))

            draft["parent_of"] = parent_of
            drafts.append(draft)
            known = (runs[order], shorter[order], n[order].astype(float))
    keep = np.zeros(0, np.uint64)
    kept: list[np.ndarray] = []
    for draft in reversed(drafts):  # a context whose extension is kept is kept too
        stays = (draft["gain"] >= cutoff) | np.isin(draft["contexts"], keep)
        kept.append(stays)
        keep = np.unique(draft["suffix"][stays])
    for draft, stays in zip(drafts, reversed(kept), strict=True):
        told = np.isin(draft["context_of"], draft["contexts"][stays])
        tree.levels.append(Level(draft["contexts"][stays], draft["back"][stays], draft["runs"][told], draft["chance"][told]))
    return tree


def fit(train: DataFrame, scratch: Scratch, depth: int = DEPTH, head: float = HEAD, context: float = CONTEXT, joint: float = JOINT, cutoff: float = CUTOFF, discount: float = DISCOUNT, rare_discount: float = RARE_DISCOUNT, text_col: str = "text") -> tuple[SuffixTree, DataFrame]:
    """The tree and the counts (x, n) of all words of all texts of train.

    Words are 64-bit hashes. Counts of words, and for each context length of the
    next words, are taken over all texts: pre-aggregated in each task, then
    summed by key. A longer context is only counted where it can be frequent,
    since its suffix is. What comes to the driver is bounded by 1 / head words,
    and 1 / joint next words for each length. A context stays if the
    log-likelihood that it gains over its suffix reaches the cutoff, or if a
    longer one that ends with it stays. Rarer contexts of one word never come to
    the driver: score() learns them where their occurrences meet.
    """
    spark = train.sparkSession
    texts = train.select(F.col(text_col).alias("text"))
    words = scratch.keep(texts.mapInArrow(_count_words, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def to_driver(df: DataFrame, *names: str) -> list[np.ndarray]:
        table = df.select(*names).toArrow()
        return [table.column(c).to_numpy().astype(np.int64) for c in names]

    x, n = to_driver(words.where(F.col("n") >= head * total), "x", "n")
    order = np.argsort(x.view(np.uint64))
    top = (x.view(np.uint64)[order], n[order])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        contexts = np.sort(mix(top[0][top[1] >= max(2.0, context * total)]))
        nexts, below = top[0][top[1] >= joint * total], np.zeros(0, np.uint64)
        for level in range(1, depth + 1):
            if not len(contexts):
                break
            shared = spark.sparkContext.broadcast((contexts, below, nexts))
            counted = texts.mapInArrow(_count_next(shared, level), "c long, x long, n long").groupBy("c", "x").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, joint * total))
            c, x, n = to_driver(counted, "c", "x", "n")
            c, x = c.view(np.uint64), x.view(np.uint64)
            found.append((c, x, n))
            runs = mix(c * _STEP + x)
            below = np.sort(runs)
            contexts = np.sort(runs[(n >= max(2.0, context * total)) & (x != _END)])
        return _build(top, total, distinct, found, cutoff, discount, max(2.0, context * total), rare_discount), words


def _score(shared) -> Callable:
    """Rows (id, text, learn) -> for each row its sums, and a row for each occurrence of a word that the tree hasn't, as a word (own) or as a context: x, with what comes next if that is at hand (its place among the tree's words, its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: SuffixTree = shared.value
        tables = tree.tables()
        base_row = TaskContext.get().partitionId() << 33
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    tokens, offsets = _tokens(part.column("text"))
                    base, score, known, at = tree.chances(tokens, offsets, tables)
                    counts = np.where(known, tree.counts[at] if len(tree.counts) else 0, 0)
                    sums = lambda v: np.add.reduceat(v, offsets[:-1])  # noqa: E731,B023  each text has its end
                    rows = base_row + np.arange(part.num_rows)
                    follows = np.append(known[1:], False)
                    follows[offsets[1:] - 1] = False
                    apart = np.flatnonzero(~known | (follows & (counts < tree.rare)))
                    after = np.minimum(apart + 1, len(tokens) - 1)
                    alone = ~follows[apart]
                    doc = np.searchsorted(offsets, apart, side="right") - 1
                    n, m = len(rows), len(apart)
                    first = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(m, kind)])  # noqa: E731,B023
                    then = lambda values, kind, mask=None: pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind, mask=mask)])  # noqa: E731,B023
                    learn = part.column("learn").to_numpy(zero_copy_only=False)
                    columns = {
                        "row": pa.array(np.concatenate([rows, rows[doc]])),
                        "id": first(part.column("id"), pa.int64()),
                        "n": first(np.diff(offsets), pa.int64()),
                        "known": first(sums(known.astype(np.int64)), pa.int64()),
                        "base": first(sums(base), pa.float64()),
                        "score": first(sums(score), pa.float64()),
                        "x": then(tokens[apart].view(np.int64), pa.int64()),
                        "own": then(~known[apart], pa.bool_()),
                        "learn": then(learn[doc].astype(bool), pa.bool_()),
                        "next": then(at[after].astype(np.int32), pa.int32(), alone),
                        "m": then(counts[after], pa.int64(), alone),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                    base_row += n

    return run


def _apart(occurrences: DataFrame, tree: SuffixTree) -> DataFrame:
    """For each row of docs, what its rare words and rare contexts add: more (to both scores), gained (to score), also (known words).

    All occurrences of a word meet in one task; a word that could be many there
    is in the tree. A rare context deals out anew what the frequent words have
    together, by counts less the discount, which goes to their base chances;
    words that the tree hasn't keep theirs, so that all sum to one.
    """
    of_word, of_pair = Window.partitionBy("x"), Window.partitionBy("x", "next")
    denominator = tree.total + 0.5 * (tree.distinct + 1)
    together = float(np.sum(10.0 ** tree.root(tree.counts))) if len(tree.counts) else 0.0
    told = F.col("learn") & F.col("next").isNotNull()
    base = (F.col("m") + 0.5) / F.lit(denominator)
    left = F.lit(tree.rare_discount) * F.col("types") / F.col("of_context")
    chance = F.when(F.col("of_pair") > 0, F.lit(together) * (F.col("of_pair") - tree.rare_discount) / F.col("of_context")).otherwise(0.0) + left * base
    found = (
        occurrences.repartition("x")
        .withColumn("of_pair", F.sum(told.cast("long")).over(of_pair))
        .withColumn("count", F.sum(F.col("learn").cast("long")).over(of_word))
        .withColumn("of_context", F.sum(told.cast("long")).over(of_word))
        .withColumn("types", F.sum(F.when(told, 1 / F.col("of_pair"))).over(of_word))
        .withColumn("gained", F.when(F.col("next").isNotNull() & (F.col("of_context") > 0), F.log10(chance / base)))
        .withColumn("gain", F.sum(F.when(told, F.col("gained") * float(np.log(10)))).over(of_word))
    )
    return found.groupBy("row").agg(
        F.sum(F.when(F.col("own"), F.log10((F.col("count") + 0.5) / F.lit(denominator)))).alias("more"),
        F.sum(F.when(F.col("gain") >= tree.cutoff, F.col("gained"))).alias("gained"),
        F.sum((F.col("own") & (F.col("count") > 0)).cast("long")).alias("also"),
    )


def score(docs: DataFrame, tree: SuffixTree, learn: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    docs holds the texts that the tree learnt from, marked by `learn` (null: not),
    and any others. Tokens are the text's words (runs of bytes other than 0x20
    and 0x09-0x0D, A-Z as a-z) and its end. base_score sums log10 of each token's
    smoothed share of the training tokens. score sums log10 of its chance after
    the longest kept context: a next word that the context has keeps its count
    less the discount; what that leaves goes to the other words as the context's
    suffix has them, down to the base. The chances after any context sum to one.

    Frequent words and their contexts are scored where the text is. Every other
    word of the training texts is a context too, if it passes the test: only its
    occurrences are shuffled, each with the place of its next word. That table
    grows with the input; the tree's size does not. Null and empty texts have
    their end only. Null ids stay null; repeated rows are scored each; an empty
    table gives no rows; other columns play no part. A word that is rare in the
    training texts but makes up much of the others makes one task large.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    schema = "row long, id long, n long, known long, base double, score double, x long, own boolean, learn boolean, next int, m long"
    made = scratch.keep(rows.mapInArrow(_score(shared), schema), "scores")
    apart = _apart(made.where("x is not null").select("row", "x", "own", "learn", "next", "m"), tree)
    more = F.coalesce("more", F.lit(0.0))
    return (
        made.where("x is null")
        .select("row", "id", "n", "known", "base", "score")
        .join(apart.hint("merge"), "row", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
            F.lit(tree.total).cast("long").alias("train_tokens"),
            (F.col("base") + more).alias("base_score"),
            (F.col("score") + more + F.coalesce("gained", F.lit(0.0))).alias("score"),
        )
    )


def score_corpus(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on the rows of docs that `learn` marks, and score all."""
    scratch = Scratch(docs.sparkSession, "suffix-lm")
    tree, _ = fit(docs.where(learn), scratch, text_col=text_col, **options)
    return score(docs, tree, learn, scratch, id_col, text_col)

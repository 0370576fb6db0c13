"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

#: Codebooks, codewords of each, and codes that a search keeps while it encodes a vector.
BOOKS, WORDS, BEAM = 16, 256, 8
#: Vectors that codebooks are trained on at most (those with the smallest hashes of their ids).
SAMPLE = 20_000
#: Vectors of a candidate block, queries of a query block, and candidates of a query in each PART of a block that are multiplied out at least.
BLOCK, QUERIES, SHORTLIST, PART = 65_536, 4096, 300, 8192
#: How many times the scores' mean error a candidate may lie below the best ones and still be multiplied out.
MARGIN = 4
#: Components of a candidate block at most.
COMPONENTS = 1 << 22


@dataclass
class Codebooks:
    """books[m, w] is a full-dimensional vector; a vector is encoded as the sum of one codeword of each book."""

    books: np.ndarray

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of the rows of x: book by book, the `beam` best sums so far are extended by every codeword."""
        n, m = len(x), len(self.books)
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        left = x[:, None, :].astype(np.float32)  # what the codes so far leave over
        for book in self.books:
            size = (book**2).sum(axis=1)
            # |left - word|^2 less |left|^2 of the best: only differences count
            cost = (left**2).sum(axis=2)[:, :, None] + size[None, None, :] - 2 * left @ book.T
            width, flat = min(beam, cost.shape[1] * cost.shape[2]), cost.reshape(n, -1)
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            at, word = np.divmod(best, len(book))
            rows = np.arange(n)[:, None]
            left = left[rows, at] - book[word]
            codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.uint8)], axis=2)
        error = (left**2).sum(axis=2)
        assert codes.shape[2] == m
        return codes[np.arange(n), error.argmin(axis=1)]


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, beam: int = 4, seed: int = 7) -> Codebooks:
    """Residual codebooks by k-means, then all books together by least squares on beam-search codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    left, made = x.copy(), []
    for _ in range(books):
        centres = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1)[None] - 2 * left @ centres.T).argmin(axis=1)
            counts = np.bincount(near, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, left)
            full = counts > 0
            centres[full] = sums[full] / counts[full, None]
            centres[~full] = left[rng.choice(len(left), (~full).sum())]
        near = ((centres**2).sum(axis=1)[None] - 2 * left @ centres.T).argmin(axis=1)
        left = left - centres[near]
        made.append(centres)
    out = Codebooks(np.stack(made))
    for _ in range(2):
        codes = np.concatenate([out.encode(x[i : i + 2048], beam) for i in range(0, len(x), 2048)]).astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), dtype=np.float32)
        right = np.zeros((books * words, x.shape[1]), dtype=np.float32)
        for a in range(books):
            np.add.at(right, codes[:, a], x)
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1)
        gram[np.diag_indices(len(gram))] += 0.1
        right += 0.1 * out.books.reshape(len(right), -1)  # towards what they were: rare words stay put
        out = Codebooks(np.linalg.solve(gram, right).reshape(books, words, -1).astype(np.float32))
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, however large or small their components are."""
    top = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny)
    return top * np.linalg.norm(x / top[:, None], axis=1)


def _encode(books: Codebooks) -> Callable:
    """Codes of the vectors' directions, what scales their sum to the vector's length, and the length of what they leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                length = _lengths(x)
                x = x / length[:, None]
                codes = books.encode(x)
                made = books.decode(codes.astype(np.int64)).astype(np.float64)
                stretch = 1 / np.maximum(np.linalg.norm(made, axis=1), 1e-12)
                slack = np.linalg.norm(x - made * stretch[:, None], axis=1)
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(stretch * length), pa.array(slack * length), part.column("v")]
                yield pa.RecordBatch.from_arrays([part.column("c"), part.column("id"), *columns], names=["c", "id", "codes", "stretch", "slack", "v"])

    return run


def _scan(books: Codebooks, shortlist: int, keep: int) -> Callable:
    """A block of queries against a block of codes: for each query the `keep` candidates of the block with the largest inner products, ties by id.

    Of each part of the block the `shortlist` candidates with the largest scores
    of the query's lookup tables are multiplied out. Their errors tell how far
    scores go astray for this query; whatever may reach the best products within
    MARGIN times that, by what its own codes leave over, is multiplied out too.
    """

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        block = block.sort_values("c", kind="stable")
        names, ids = block["c"].to_numpy(), block["id"].to_numpy()
        codes = np.frombuffer(b"".join(block["codes"]), dtype=np.uint8).reshape(len(ids), -1).T.astype(np.int64)
        stretch, slack = block["stretch"].to_numpy(), block["slack"].to_numpy()
        y = np.ascontiguousarray(np.stack(block["v"].to_numpy()).astype(np.float64).T)
        asked = queries["q"].to_numpy()
        x = np.stack(queries["v"].to_numpy()).astype(np.float64)
        out = []
        for a in range(0, len(x), 128):
            some = np.ascontiguousarray(x[a : a + 128].T)
            length = _lengths(x[a : a + 128])
            tables = books.books @ (some / length).astype(np.float32)  # of each book and codeword with each query's direction
            every = np.arange(len(length))

            def products(at: np.ndarray, q: np.ndarray) -> np.ndarray:
                """Component by component in their order, as a loop over them adds."""
                total = np.zeros(len(at))
                for left, right in zip(y, some, strict=True):
                    total += left[at] * right[q]
                return total

            def best(found: tuple, at: np.ndarray, q: np.ndarray) -> tuple:
                """(query, candidate, product): of those found and the new ones the `keep` best of each query."""
                q, at, score = (np.concatenate(both) for both in zip(found, (q, at, products(at, q)), strict=True))
                order = np.lexsort((ids[at], -score, q))
                q, at, score = q[order], at[order], score[order]
                first = np.searchsorted(q, q)
                top = np.arange(len(q)) - first < keep
                return q[top], at[top], score[top]

            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in range(0, len(ids), PART):
                part = codes[:, b : b + PART]
                score = tables[0][part[0]]
                for m in range(1, len(tables)):
                    score += tables[m][part[m]]
                score = score * stretch[b : b + PART, None]  # by the stored length
                take = min(shortlist, len(score))
                top = np.argpartition(-score, take - 1, axis=0)[:take]
                at, q = top.ravel() + b, np.tile(every, take)
                found = best(found, at, q)
                if take == len(score):
                    continue
                with np.errstate(all="ignore"):
                    wrong = (products(at, q) / length[q] - score[top, every].ravel()) / np.maximum(slack[at], 1e-12 * stretch[at])
                    spread = np.sqrt(np.nanmean(wrong.reshape(take, -1) ** 2, axis=0))
                    full = np.bincount(found[0], minlength=len(every)) == keep
                    floor = np.full(len(every), -np.inf)
                    np.minimum.at(low := np.full(len(every), np.inf), found[0], found[2])
                    floor[full] = low[full] / length[full]
                    near = score + MARGIN * spread * np.maximum(slack[b : b + PART, None], 1e-6 * np.abs(stretch[b : b + PART, None])) >= floor
                near[top, every] = False
                rows, q = np.nonzero(near)
                for i in range(0, len(rows), 1 << 20):
                    found = best(found, rows[i : i + (1 << 20)] + b, q[i : i + (1 << 20)])
            out.append(pd.DataFrame({"q": asked[a + found[0]], "c": names[found[1]], "id": ids[found[1]], "score": found[2]}))
        return pd.concat(out)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector that is neither zero nor holds null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, books: int = BOOKS, words: int = WORDS, sample: int = SAMPLE, shortlist: int = SHORTLIST, block: int = BLOCK, queries_block: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors that is_query (a column of `id`) marks, the k rows with the largest inner products that the search found, itself left out.

    Rows with the same vector are one candidate, with its k + 1 smallest ids
    (more can't be among any k). Codebooks are trained on the directions of a
    bounded sample of the vectors; the directions of all vectors are encoded by
    beam search and stored as codes with a length and with what the codes leave
    over. Each block of queries meets each block of codes in a task: the scores
    of its lookup tables tell which candidates are multiplied out (see _scan),
    and these are ranked by the inner product in double precision, ties by the
    smaller id. Where codes tell vectors apart badly, more are multiplied out,
    all of a part if need be.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; of rows that share an id and a vector one counts,
    and an id with several vectors is found under its best. Vectors must have
    one length. An empty table gives no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable(vectors, id_col, vector_col).distinct()
    members = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = scratch.keep(members.withColumn("c", F.min("id").over(Window.partitionBy("v"))).select("c", "id", "v"), "members")
    # two vectors may share their smallest id only if that id has several: the class then is named by vector too
    classes = members.where("id = c").select(F.xxhash64("c", "v").alias("c"), "id", "v")
    members = members.select(F.xxhash64("c", "v").alias("c"), "id")
    classes = scratch.keep(classes, "classes")
    n = classes.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema).withColumnsRenamed({"vec_id": id_col})
    learn = np.stack([np.array(r.v) for r in classes.orderBy(F.xxhash64("c"), "c").limit(sample).select("v").collect()])
    made = train(learn / _lengths(learn)[:, None], books, words)
    codes = scratch.keep(classes.mapInArrow(_encode(made), "c long, id long, codes binary, stretch double, slack double, v array<double>"), "codes")

    queries = scratch.keep(rows.where(is_query).select(F.xxhash64("id", "v").alias("q"), F.col("id").alias("query_id"), "v"), "queries")
    asked = queries.count()
    c_blocks = math.ceil(n / max(1, min(block, COMPONENTS // learn.shape[1])))
    # few large blocks of queries copy the codes least; but there are tasks for all partitions if there are queries for them
    wanted = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / max(1, c_blocks))
    q_blocks = max(math.ceil(asked / queries_block), min(math.ceil(asked / 256), wanted))
    part = lambda c, m: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(max(1, m))).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(max(1, m) - 1)))
    left = queries.select("q", "v", part("q", q_blocks).alias("i")).select("*", all_of(c_blocks).alias("j"))
    right = codes.select("*", part("c", c_blocks).alias("j")).select("*", all_of(q_blocks).alias("i"))
    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_scan(made, shortlist, k + 1), "q long, c long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    short = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).join(queries.select("q", "query_id"), "q").select("query_id", "c", "score")
    found = short.join(members, "c").where("id != query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")

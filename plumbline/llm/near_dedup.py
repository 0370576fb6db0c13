"""MinHash near-duplicates by an LSH forest, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import components
from plumbline.llm.scratch import Scratch
from plumbline.llm.words import distinct_sorted, mix, shingles, slices, word_hashes

#: Signature orders of the forest, and hash values that each order sorts by.
TREES, DEPTH = 20, 8
#: Chance, at the threshold itself, that no order has a pair in one region.
MISS = 1e-4
#: Documents of a candidate group that one task compares at a time.
BLOCK = 128
#: A candidate group of more documents than this is a crowded region, whose documents are first compared by longer common prefixes.
CROWD = 1024


def least_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, miss: float = MISS) -> int:
    """The longest common prefix to ask of candidates so that pairs at the threshold are missed with chance `miss` at most."""
    fit = [k for k in range(1, depth + 1) if (1 - similarity**k) ** trees <= miss]
    return max(fit, default=1)


def signatures(values: np.ndarray, offsets: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A row of n 16-bit MinHash values for each document (documents without shingles: zeros)."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 2**32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(offsets) - 1, n), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32)
        held, starts = np.empty_like(x), offsets[:-1][full]
        for i in range(n):
            np.multiply(x, a[i], out=held)
            np.add(held, b[i], out=held)
            least = np.minimum.reduceat(held, starts)
            out[full, i] = (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _features(width: int, trees: int, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    sets, bounds = distinct_sorted(*shingles(*word_hashes(part.column("text")), width))
                    counts = np.diff(bounds)
                    full = np.flatnonzero(counts)
                    halves = [np.zeros(len(counts), np.uint64) for _ in range(2)]
                    if len(full):
                        for k, half in enumerate(halves):
                            half[full] = mix(np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1))), bounds[:-1][full]) + counts[full].astype(np.uint64))
                    none = counts == 0
                    rows = signatures(sets, bounds, trees * depth).astype(">u2")  # big-endian, so that bytes sort as numbers
                    sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * trees * depth), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(counts), *(pa.array(h.view(np.int64), mask=none) for h in halves), sig],
                        names=["id", "n", "h1", "h2", "sig"],
                    )

    return run


def _neighbours(depth: int, least: int) -> Callable:
    """Sorted (tree, key, id) rows -> an edge (kind 0) to the next row, with the length of their common prefix, if that is `least` or more; and each partition's first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, first = TaskContext.get().partitionId(), None, None

        def row(kind: int, tree: int, key: bytes, doc: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([doc]), pa.array([pid]), pa.array([tree]), pa.array([key], pa.binary())], names=["kind", "a", "b", "tree", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=">u2").reshape(-1, depth)
            if last is not None:
                tree, ids, keys = np.concatenate([[last[0]], tree]), np.concatenate([[last[1]], ids]), np.vstack([last[2], keys])
            else:
                first = (int(tree[0]), keys[0].tobytes(), int(ids[0]))
            common = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (common >= least) & (ids[1:] != ids[:-1]))
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(ids[at + 1]), pa.array(ids[at]), pa.array(common[at].astype(np.int64)), pa.nulls(n, pa.binary())], names=["kind", "a", "b", "tree", "key"])
            last = (tree[-1], ids[-1], keys[-1:])
        if last is not None:
            yield row(1, *first)
            yield row(2, int(last[0]), last[2].tobytes(), int(last[1]))

    return run


def _forest_edges(reps: DataFrame, scratch: Scratch, trees: int, depth: int, least: int) -> DataFrame:
    """Candidate links (a, b, common): neighbours in any of the sorted signature orders whose longest common prefix is `least` or more.

    The rows are range-partitioned by their whole key and id, so a crowded
    region is split between tasks like any other run of rows. Where two
    partitions meet, the driver links the last row of one with the first of the
    next: two rows for each partition.
    """
    width = 2 * depth
    rows = reps.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig").select(
        "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("key"), "id"
    )
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = scratch.keep(ordered.mapInArrow(_neighbours(depth, least), "kind long, a long, b long, tree long, key binary"), "neighbours")
    ends = sorted((r.b, r.kind, r.tree, bytes(r.key), r.a) for r in found.where("kind > 0").collect())
    joints = [(x[4], y[4], _common(x[3], y[3])) for x, y in zip(ends, ends[1:], strict=False) if x[1] == 2 and y[1] == 1 and x[2] == y[2] and x[4] != y[4]]
    joints = [j for j in joints if j[2] >= least]
    edges = found.where("kind = 0").select("a", "b", F.col("tree").alias("common"))
    return edges.union(reps.sparkSession.createDataFrame(joints, "a long, b long, common long")) if joints else edges


def _common(x: bytes, y: bytes) -> int:
    """Values of two bytes each that two keys have in common at their beginning."""
    return next((i for i in range(len(x) // 2) if x[2 * i : 2 * i + 2] != y[2 * i : 2 * i + 2]), len(x) // 2)


def _regions(edges: DataFrame, scratch: Scratch, least: int, depth: int, crowd: int) -> DataFrame:
    """(id, c, region): the candidate group of each document, and the part of it that is compared first, each region at its own depth.

    A group are all documents that links with a common prefix of `least` or
    more join. In a group of more than `crowd` documents only links from a
    prefix half way down count for the regions, and then from the whole key, so
    that chains of unlike documents fall apart; what has no link left is a
    region of its own. Links between regions are looked for by _across.
    """
    joined = lambda links: scratch.keep(components(links.select("a", "b"), scratch).select(F.col("node").alias("id"), F.col("root").alias("c")), "groups")
    groups = joined(edges)
    regions = groups.select("id", F.col("c").alias("region"))
    for at in sorted({(least + depth + 1) // 2, depth} - {least}):
        crowded = regions.groupBy("region").count().where(F.col("count") > crowd).select("region")
        if not crowded.take(1):
            break
        inside = scratch.keep(regions.join(crowded, "region", "left_semi"), "crowded")
        edges = scratch.keep(edges.where(F.col("common") >= at).join(inside.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi"), "deeper")
        deeper = joined(edges).withColumnRenamed("c", "deeper")
        parts = inside.join(deeper.hint("merge"), "id", "left").select("id", F.coalesce("deeper", "id").alias("region"))
        regions = scratch.keep(regions.join(crowded, "region", "left_anti").select("id", "region").union(parts), "regions")
    return groups.join(regions.hint("merge"), "id")


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component, where sets with 100 * intersection >= percent * union are linked.

    A search from each unreached set in turn, always against all sets that are
    still unreached, so sets that are found need no comparison among each other.
    """
    root = list(range(len(sets)))
    sizes = np.array([len(s) for s in sets])
    left = np.arange(1, len(sets))
    for begin in range(len(sets)):
        if root[begin] != begin or not len(left):
            continue
        left = left[left != begin]
        front = [begin]
        while front and len(left):
            x = sets[front.pop()]
            fits = left[(100 * sizes[left] >= percent * len(x)) & (100 * len(x) >= percent * sizes[left])]
            if not len(fits):
                continue
            values = np.concatenate([sets[i] for i in fits])
            at = np.minimum(np.searchsorted(x, values), len(x) - 1)
            common = np.add.reduceat((x[at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[fits])[:-1]]))
            met = fits[100 * common >= percent * (len(x) + sizes[fits] - common)]
            for i in met.tolist():
                root[i] = begin
            front += met.tolist()
            left = np.setdiff1d(left, met, assume_unique=True)
    return root


def _confirm(width: int, percent: int) -> Callable:
    """Rows (id, text) sorted by (c, i, j) -> (id, the smallest id of its component within its (c, i, j))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def flush() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, dtype=np.int64), kind="stable").tolist()
            root = linked([sets[i] for i in order], percent)
            links = [(ids[order[k]], ids[order[r]]) for k, r in enumerate(root)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    values, bounds = distinct_sorted(*shingles(*word_hashes(part.column("text")), width))
                    keys = zip(*(part.column(k).to_pylist() for k in ("c", "i", "j")), strict=True)
                    for n, (at, doc) in enumerate(zip(keys, part.column("id").to_pylist(), strict=True)):
                        if at != key:
                            if len(ids) > 1:
                                yield flush()
                            key, ids, sets = at, [], []
                        ids.append(doc)
                        sets.append(values[bounds[n] : bounds[n + 1]])
        if len(ids) > 1:
            yield flush()

    return run


def _compare(tasks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) within each task (c, i, j) of the rows (id, c, i, j)."""
    rows = texts.join(tasks.hint("merge"), "id").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "id")
    return rows.select("c", "i", "j", "id", "text").mapInArrow(_confirm(width, percent), "a long, b long").where("a != b")


#: Counters of shingles by which crowded groups order theirs: only how well it works hangs on their number.
COUNTERS = 1 << 20


def _shingle_sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sorted(*shingles(*word_hashes(part.column("text")), width))


def _counters(texts: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle, by the last bits of its hash: COUNTERS numbers, summed by tasks and then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    total += np.bincount((_shingle_sets(part, width)[0] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sums = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out


def _first_shingles(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, at, token): of each document, its set put in the order of rising counts, the first shingles; of two linked documents these have one in common.

    A link needs percent * (n + m) / (100 + percent) common shingles, thus at
    least percent * n / 100 of the larger set, which can't all come behind the
    first n - that + 1.
    """
    counts = texts.sparkSession.sparkContext.broadcast(_counters(texts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    values, bounds = _shingle_sets(part, width)
                    often = counts.value[(values & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                    order = np.lexsort((values, often, owner))
                    n = np.diff(bounds)[owner]
                    at = np.arange(len(values)) - bounds[:-1][owner]
                    first = at < n - (-(-percent * n // 100)) + 1
                    ids = part.column("id").to_numpy(zero_copy_only=False)
                    columns = [ids[owner[first]], n[first], at[first], values[order][first].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "n", "at", "token"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, at long, token long")


def _star(width: int, percent: int) -> Callable:
    """Rows (id, text) sorted by (c, i, j), those of c itself first -> the links between c and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, found = None, [], []
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    values, bounds = _shingle_sets(part, width)
                    keys = zip(*(part.column(k).to_pylist() for k in ("c", "i", "j", "id")), strict=True)
                    for n, (c, i, j, doc) in enumerate(keys):
                        mine = values[bounds[n] : bounds[n + 1]]
                        if (c, i) != key:
                            key, centre = (c, i), []
                        if j == 0:
                            centre.append(mine)
                        elif any(linked([x, mine], percent)[1] == 0 for x in centre if len(x) and len(mine)):
                            found.append((doc, c))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["a", "b"])
                        found = []

    return run


def _across(crowd: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int, block: int) -> DataFrame:
    """All links (a, b) between documents of a group that lie in different parts; crowd: (id, c, root, rest), texts: theirs.

    Of two parts one at least is not the group's largest (rest). Pairs come
    from common first shingles, with the bounds that sizes and places set on
    what two sets can have in common: the smaller set is asked with fewer
    shingles (percent * 2 n / (100 + percent) would have to come behind them).
    So documents that share a template but not their rare shingles never meet.
    Each pair is compared on its full sets, in tasks of `block` partners at most.
    """
    rows = scratch.keep(_first_shingles(texts, width, percent).join(crowd.withColumnsRenamed({"c": "group"}).hint("merge"), "id"), "first-shingles")
    need = lambda n: F.ceil(n * percent / (100 + percent))
    small = rows.where(F.col("at") <= F.col("n") - need(2 * F.col("n"))).select("group", "token", *[F.col(c).alias(f"s_{c}") for c in ("id", "n", "at", "root", "rest")])
    large = rows.select("group", "token", *[F.col(c).alias(f"l_{c}") for c in ("id", "n", "at", "root", "rest")])
    both = need(F.col("s_n") + F.col("l_n"))
    fits = (
        (F.struct("s_n", "s_id") < F.struct("l_n", "l_id"))
        & (F.col("s_root") != F.col("l_root"))
        & (100 * F.col("s_n") >= percent * F.col("l_n"))
        & (F.col("s_n") - F.col("s_at") >= both)
        & (F.col("l_n") - F.col("l_at") >= both)
    )
    met = [x.join(y.hint("merge"), ["group", "token"]).where(fits) for x, y in ((small.where("s_rest"), large), (small.where("not s_rest"), large.where("l_rest")))]
    own = F.col("s_rest") & (~F.col("l_rest") | (F.col("s_id") < F.col("l_id")))
    pairs = met[0].union(met[1]).select(F.when(own, F.col("s_id")).otherwise(F.col("l_id")).alias("c"), F.when(own, F.col("l_id")).otherwise(F.col("s_id")).alias("id")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    many = pairs.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = pairs.join(many.hint("merge"), "c").select("id", "c", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("i"), F.lit(1).alias("j"))
    centres = many.select(F.col("c").alias("id"), "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"))
    tasks = texts.select("id", "text").join(dealt.union(centres).hint("merge"), "id").repartition("c", "i").sortWithinPartitions("c", "i", "j", "id")
    return tasks.select("c", "i", "j", "id", "text").mapInArrow(_star(width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z as
    a-z; a document's set are its distinct runs of `width` words, or all its
    words if it has fewer. Documents are linked if 100 * intersection >=
    percent * union; component_id is the smallest id that links reach, and kept
    marks the rows that have that id.

    1. Equal sets are collapsed into their smallest id by a hash of the set.
    2. The forest: `trees` orders, each sorting documents by `depth` MinHash
       values; neighbours whose common prefix has `least_depth` values or more
       are candidates, and the components of all candidates are groups. A pair
       at the threshold is missed with chance MISS, in a group of any size. A
       group of more than `crowd` documents is taken apart into regions by
       longer prefixes.
    3. Each region is compared on its full sets in one task; one of more than
       `block` documents is dealt into blocks that all hold its smallest one.
    4. In a group of more than `block` documents the links between the parts
       that step 3 gives are found by common rare shingles (_across), which
       misses none. No cap drops a comparison.

    Null and empty texts have no set: n_shingles 0, linked with nothing. A null
    id is linked with nothing either (component_id null, kept false). Repeated
    rows each give a row. An empty table gives no rows. Other columns of docs,
    whatever their names, play no part.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    least = least_depth(percent / 100, trees, depth)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = scratch.keep(texts.mapInArrow(_features(width, trees, depth), "id long, n long, h1 long, h2 long, sig binary"), "features")
    reps = scratch.keep(features.where("h1 is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("sig").alias("sig")), "classes")

    edges = _forest_edges(reps.select("id", "sig"), scratch, trees, depth, least)
    groups = scratch.keep(_regions(edges, scratch, least, depth, crowd), "candidates")
    sizes = groups.groupBy("region").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n"))
    members = groups.join(sizes.hint("merge"), "region").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).where("n > 1")
    # the smallest id of a region stands in all its blocks
    tasks = members.select("id", F.col("region").alias("c"), F.explode(F.when(F.col("id") == F.col("region"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("i"))).alias("i"), F.lit(0).alias("j"))
    large = scratch.keep(groups.groupBy("c").count().where(F.col("count") > block).select("c"), "large")
    some_large = bool(large.take(1))
    wanted = texts.where("id is not null")
    if some_large:  # the texts of large groups are read again
        crowded = scratch.keep(groups.join(large, "c", "left_semi").select("id", "c"), "crowd")
        in_crowd = crowded.select("id", F.lit(True).alias("crowded"))
        wanted = wanted.join(groups.select("id").distinct().hint("merge"), "id", "left_semi").join(in_crowd.hint("merge"), "id", "left")
        wanted = scratch.keep(wanted, "texts")
    links = scratch.keep(_compare(tasks, wanted.select("id", "text"), width, percent), "links")
    if some_large:
        part = components(links.join(crowded.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi"), scratch)
        part = scratch.keep(crowded.join(part.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id")), "parts")
        most = part.groupBy("c", "root").count().groupBy("c").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        spread = part.join(most, "c").select("id", "c", "root", (F.col("root") != F.col("main")).alias("rest"))
        links = scratch.keep(links.union(_across(spread, wanted.where("crowded"), scratch, width, percent, block)), "links")
    roots = components(links, scratch).select(F.col("node").alias("id"), "root")
    classes = reps.select("h1", "h2", "id").join(roots.hint("merge"), "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("root"))
    return (
        features.select("id", "n", "h1", "h2")
        .join(classes.hint("merge"), ["h1", "h2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
            (F.col("id").isNotNull() & (F.col("id") == F.coalesce("root", "id"))).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The rows of docs without those whose text has a near-duplicate under a smaller id (see near_duplicates).

    Rows without an id or without words are all kept. Of rows that share both
    the id and a set, all stay or none does. Columns may have any names.
    """
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, percent, **options)
    gone = found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("gone")).distinct()
    kept = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`").cast("long") == F.col("g.gone"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])

"""Order MinHash fingerprints, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, slots of a fingerprint, and k-mers of a slot's tuple.
K, SLOTS, TUPLE = 2, 64, 2
#: Documents of an order bucket and of a task, and order buckets at most.
BUCKET_ROWS, TASK_ROWS, MOST_BUCKETS = 128, 1000, 1 << 16

_SPACE = r"[\x20\x09-\x0D]+"


def kmer_hashes(text: Column, k: int) -> Column:
    """Hashes of the runs of k words of a text in their order; of fewer words (but one at least) all are the only run."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    few = lambda w: F.transform(F.array(F.array_join(w, " ")), lambda t: F.xxhash64(t, F.size(w)))
    any_number = lambda w: F.when(F.size(w) >= k, runs(w)).when(F.size(w) > 0, few(w)).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(words), any_number), 0)  # the text is split once


def bucket_of(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most the key, by bisection."""
    if not splits:
        return F.lit(0)
    table = F.expr("array(" + ",".join(f"{s}L" if s > -(2**63) else "bigint(-9223372036854775808)" for s in splits) + ")")
    steps = F.sequence(F.lit(1), F.lit(len(splits).bit_length()))
    middle = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    step = lambda a, _: F.when(
        a["lo"] >= a["hi"], a
    ).otherwise(F.when(F.get(table, middle(a)) <= key, F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle(a).alias("hi"))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")), step, lambda a: a["lo"])


def fingerprints(rows: DataFrame, keys: list[str], k: int = K, slots: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """(keys, _fp) of rows (keys, _text) that have words; _fp has an int for each slot.

    rows must be dealt out by keys[0]; no row moves from its task. Each k-mer of
    a text gets the number of its occurrence there. A hash of both puts it in
    one of slots x size ranges of one random order; each range keeps the k-mer
    of its least hash. A slot takes the k-mers of the first `size` ranges from
    its own on that have one, round about: its own in a long text, and in a
    short one those of its neighbours too, so that a slot always has `size`
    k-mers (of a text of fewer, all of them, the first again). They are hashed as
    a tuple in the order in which they stand in the text.
    """
    kmers = rows.select(*keys, F.posexplode(kmer_hashes(F.col("_text"), k)).alias("_pos", "_h"))
    same = Window.partitionBy(F.xxhash64(*keys, "_h"), *keys, "_h").orderBy("_pos")
    numbered = kmers.withColumn("_n", F.row_number().over(same)).select(*keys, "_pos", "_h", F.xxhash64("_h", "_n").alias("_u"))
    parts = numbered.withColumn("_part", F.pmod("_u", F.lit(slots * size)).cast("int")).groupBy(*keys, "_part").agg(F.min_by("_pos", "_u").alias("_pos"), F.min_by("_h", "_u").alias("_h"))
    # which ranges have a k-mer, as bits of a few longs: how many lie before a slot's own is a count of bits
    lanes = range(-(-slots * size // 64))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("_part") / 64) == w, F.expr("shiftleft(1L, _part % 64)"))), F.lit(0)).cast("long").alias(f"_bits{w}") for w in lanes]
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_pos", "_h"))).alias("_filled"), *bits)
    below = lambda k: F.when(k <= 0, F.lit(0).cast("long")).when(k >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1)

    def tuple_of(slot: Column) -> Column:
        first = sum((F.bit_count(F.col(f"_bits{w}").bitwiseAND(below(slot * size - 64 * w))) for w in lanes[1:]), F.bit_count(F.col("_bits0").bitwiseAND(below(slot * size))))
        taken = F.array(*[F.get("_filled", F.pmod(first + i, F.size("_filled"))) for i in range(size)])
        in_order = F.array_sort(F.transform(taken, lambda x: F.struct(x["_pos"], x["_h"])))
        return F.aggregate(in_order, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x["_h"]))

    slot_hash = lambda s: F.pmod(tuple_of(s), F.lit(1 << 16)).cast("int")
    return whole.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), slot_hash).alias("_fp"))


def likeness(a: Column, b: Column) -> Column:
    """The part of the slots used by either fingerprint in which both are alike; 1 if both are empty."""
    alike = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    used = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(used == 0, 1.0).otherwise(alike / used)


def in_hex(fingerprint: Column) -> Column:
    """Four signs for each slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.when(x.isNull(), "----").otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))), "")


def order_fingerprints(docs: DataFrame, k: int = K, slots: int = SLOTS, size: int = TUPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The Order MinHash of every text, of an edit of it, and how like they are.

    doc_id; n_chars (code points); edited_sha256 (of the edited text: the last
    floor(n_chars / 2) code points give way to the first as many, or all, of the
    next document by ascending id, after the last of the first);
    fingerprint, edited_fingerprint; near_edited and near_next (likeness to the
    edited text's and to the next document's fingerprint).

    Ranges of ids, cut at quantiles that one pass over the ids finds (at most
    MOST_BUCKETS of them), are dealt to tasks; the first document of each range
    also goes to the range before, so one shuffle of the texts serves the next
    document, the occurrence numbers and all minima. The rest happens within
    rows' own tasks.

    Null texts are empty; texts without words have a fingerprint of empty slots
    only. A null id comes before all others. Of rows that share an id the lesser
    text comes first. An empty table gives no rows; other columns of docs play
    no part.
    """
    spark = docs.sparkSession
    least = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("_key"), F.col(id_col).isNotNull().alias("_known"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n, low = rows.agg(F.count("*"), F.min("_key")).first()
    buckets = min(MOST_BUCKETS, math.ceil(n / BUCKET_ROWS))
    points = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("_key", points, 10 * buckets)).first()[0] if points else []
    splits = sorted({x for x in found if x > low})
    bucket = F.coalesce(bucket_of(F.col("_key"), splits), F.lit(0))
    first_of = F.get(F.expr("array(" + ",".join("bigint(%d)" % s for s in ([low or 0] + splits)) + ")"), F.col("_bucket"))
    before = F.pmod(F.col("_bucket") - 1, F.lit(len(splits) + 1))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("b"), F.lit(True).alias("guest"))
    placed = rows.withColumn("_bucket", bucket).withColumn("_to", F.explode(F.when(F.col("_key") == first_of, F.array(own, guest)).otherwise(F.array(own))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_ROWS))
    dealt = placed.select(F.coalesce("_to.b", F.lit(0)).alias("_bucket"), F.col("_to.guest").alias("_guest"), "_key", "_known", "_text").repartition(tasks, "_bucket")

    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", "_known", "_text")
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring(F.lead("_text").over(order), F.lit(1), half))
    ranked = dealt.select("_bucket", "_guest", F.when(F.col("_known"), F.col("_key")).alias("_id"), "_text", F.row_number().over(order).alias("_row"), edited.alias("_edited"))

    both = F.when(F.col("_guest"), F.array(F.struct(F.lit(0).alias("side"), F.col("_text").alias("text")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("text")))
    )
    sides = ranked.select("_bucket", "_row", F.explode(both).alias("_s")).select("_bucket", "_row", F.col("_s.side").alias("_side"), F.col("_s.text").alias("_text"))
    marks = fingerprints(sides, ["_bucket", "_row", "_side"], k, slots, size)
    marks = marks.groupBy("_bucket", "_row").agg(F.first(F.when(F.col("_side") == 0, F.col("_fp")), ignorenulls=True).alias("_own"), F.first(F.when(F.col("_side") == 1, F.col("_fp")), ignorenulls=True).alias("_new"))
    facts = ranked.select("_bucket", "_row", "_guest", "_id", F.length("_text").cast("long").alias("n_chars"), F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"))
    none = F.array_repeat(F.lit(None).cast("int"), slots)
    out = facts.join(marks, ["_bucket", "_row"], "left").withColumns({"_own": F.coalesce("_own", none), "_new": F.coalesce("_new", none)})
    out = out.withColumn("_next", F.lead("_own").over(Window.partitionBy("_bucket").orderBy("_row"))).where(~F.col("_guest"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        in_hex(F.col("_own")).alias("fingerprint"),
        in_hex(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )

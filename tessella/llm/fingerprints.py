"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Words are runs of anything but white space, A-Z lower-cased. Each shingle of five words (the whole sequence, if it is
shorter) has one 64-bit hash; its leading bits choose one of `BINS` bins and each bin keeps its least hash. Sentinels,
one a bin, make the sorted hashes hold exactly one first element for every bin, which is the sentinel where the bin is
empty. Optimal densification: an empty bin tries other bins in an order that depends on the bin only until one is
filled; after `PROBES` tries it takes the filled bin with the least hash of (bin, filled bin), which is the same draw.
The lowest eight bits of a hash of each bin's value are packed, eight bins to a 64-bit number, written as hexadecimal.

Likeness is the share of equal bins, corrected for chance equality: (m - c) / (1 - c) with c = 2**-8, within 0..1.
A text without words, or null, has an empty fingerprint; it is like another empty one (1) and unlike any other (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.runtime import shuffle_partitions

WORDS, BINS = 5, 256
CHANCE = 2.0**-8
PROBES = 12
SALT = 0x5BD1E995
BUCKETS_PER_PARTITION = 8
NO_KEY = -(1 << 63)


def probe(bin_: int, attempt: int) -> int:
    """The bin that an empty bin tries at an attempt: the leading bits of a multiplicative mix."""
    x = (bin_ * 0x9E3779B97F4A7C15 + attempt * 0xC2B2AE3D27D4EB4F + SALT) & (1 << 64) - 1
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 29) * 0x94D049BB133111EB & (1 << 64) - 1
    return (x ^ x >> 32) % BINS


def word_hashes(text: Column) -> Column:
    """Hash of every word of the text."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lower, "[\\x09-\\x0D\\x20]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """df with the packed fingerprint of column `text` as array<long> column `name`; empty where there are no words."""
    shift, low = 64 - (BINS.bit_length() - 1), -(BINS // 2)
    w, s, v, f = (f"__{c}_{name}" for c in "wsvf")
    df = df.withColumn(w, word_hashes(F.coalesce(F.col(text), F.lit(""))))
    at = lambda k: F.get(F.col(w), k)
    whole = F.array(F.xxhash64(F.col(w)))
    runs = F.transform(F.slice(F.col(w), 1, F.greatest(F.size(w) - (words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i + k) for k in range(1, words)]))
    hashed = F.when(F.size(w) >= words, runs).otherwise(whole)
    # The greatest value of each bin: present in every bin, and first only in an empty one.
    sentinels = F.lit([((b + 1) << shift) - 1 for b in range(low, -low)])
    df = df.withColumn(s, F.sort_array(F.concat(hashed, sentinels)))
    bin_of = lambda x: F.shiftright(x, shift)
    firsts = F.filter(F.col(s), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1))))
    last = (1 << shift) - 1
    df = df.withColumn(v, F.transform(firsts, lambda x: F.when(x.bitwiseAND(last) != last, x)))
    pairs = F.filter(F.transform(F.col(v), lambda x, j: F.when(x.isNotNull(), F.struct(j.alias("j"), x.alias("x")))), lambda p: p.isNotNull())
    df = df.withColumn(f, pairs)
    drawn = lambda i: F.array_min(F.transform(F.col(f), lambda p: F.struct(F.xxhash64(i, p["j"], F.lit(SALT)).alias("h"), p["x"].alias("x"))))["x"]
    tries = [F.lit([probe(b, k) for b in range(BINS)]) for k in range(PROBES)]
    dense = F.transform(F.col(v), lambda x, i: F.coalesce(x, *[F.get(F.col(v), F.get(t, i)) for t in tries], drawn(i)))
    # A second use keeps the optimizer from evaluating these columns anew inside each lambda.
    df = df.withColumn(s, F.when(F.size(f) > 0, dense))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda j: F.aggregate(F.slice(F.col(s), j * 8 + 1, F.lit(8)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(F.xxhash64(x).bitwiseAND(255))))
    return df.withColumn(name, F.when((F.size(w) > 0) & (F.size(s) == BINS), packed).otherwise(F.array().cast("array<long>"))).drop(w, s, v, f)


def as_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    ones = 0x0101010101010101

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 4))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    different = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda c, x: c + x)
    corrected = (1 - different / F.lit(BINS) - CHANCE) / (1 - CHANCE)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.least(F.greatest(corrected, F.lit(0.0)), F.lit(1.0)))


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below the key, by a coarse and a fine count."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[step - 1 :: step]), lambda b: b < key))
    fine = F.size(F.filter(F.slice(F.lit(bounds), coarse * step + 1, F.lit(step)), lambda b: b < key))
    return F.coalesce(coarse * step + fine, F.lit(0))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows in buckets (__b) of consecutive keys; the rows with a bucket's least key also visit the bucket before it as
    guests (__guest = 1), the first bucket's the last. The bounds are quantiles of the key, as many as the session's
    partitions ask for."""
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession)
    k = F.coalesce(F.col(key), F.lit(NO_KEY))
    bounds = df.agg(F.percentile_approx(k, [i / buckets for i in range(1, buckets)], 100_000)).first()[0] or []
    df = df.withColumn("__b", bucket_of(k, sorted(set(bounds))))
    firsts = dict(df.select("__b", k.alias("k")).groupBy("__b").agg(F.min("k")).collect())  # one row a bucket
    if not firsts:
        return df.withColumn("__guest", F.lit(0))
    order = sorted(firsts)
    at = lambda of: F.get(F.lit([of.get(b, -1) for b in range(order[-1] + 1)]), F.col("__b"))
    home = F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest"))
    visit = F.struct(at({b: order[i - 1] for i, b in enumerate(order)}).cast("int").alias("b"), F.lit(1).alias("guest"))
    places = F.when(k == at(firsts), F.array(home, visit)).otherwise(F.array(home))
    return df.withColumn("__v", F.explode(places)).withColumn("__b", F.col("__v.b")).withColumn("__guest", F.col("__v.guest")).drop("__v")


def with_next(buckets: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Each row of dealt() with the given columns of the row that follows by key (after the last: the first).
    Null keys come first; ties go by the columns."""
    w = Window.partitionBy("__b").orderBy("__guest", F.col(key).asc_nulls_first(), *[F.col(c) for c in columns])
    return buckets.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("__guest = 0").drop("__b", "__guest")


def edited(text: Column, after: Column) -> Column:
    """The last quarter (rounded down) of the text's code points replaced by as many first ones of the other text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    pairs = with_next(with_fingerprint(rows, "text", "fp"), "doc_id", ("text", "fp"))
    both = with_fingerprint(pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))), "edited", "edited_fp")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

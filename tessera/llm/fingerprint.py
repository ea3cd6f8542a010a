"""Document fingerprints (operator 9), in DataFrame functions only.

One-permutation MinHash of a text's ``WIDTH``-word shingles: every shingle is hashed once,
the sorted distinct hashes fall into ``BINS`` equal ranges, and the least of each range
counts.  Optimal densification: an empty bin takes the value of a filled bin that a hash of
the two bins chooses at random.  Of each value the lowest ``BITS`` bits are kept, eight bins
packed in one 64-bit word.  Two fingerprints agree in a bin by chance with probability
2 ** -BITS, so the likeness is (agreeing share - 2 ** -BITS) / (1 - 2 ** -BITS), not below 0.

A text of fewer words has its whole sequence as the one shingle; a NULL text, an empty one
and one without words have the fingerprint of no bins ('' as a string).  Two of these have
likeness 1, one of them and another text likeness 0.  Words are runs of characters other
than ASCII white space.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WIDTH = 128, 8, 5
_PER_WORD = 64 // BITS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Sorted 64-bit hashes (copies kept) of the text's shingles; no words: an empty array."""
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    words = F.transform(F.array_remove(F.split(blank, " "), ""), lambda w: F.xxhash64(w))

    def of(w: Column) -> Column:
        # get() is NULL behind the last word, and a NULL leaves a hash as it is
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(runs))

    return let(words, of)


def fingerprint(text: Column, bins: int = BINS, width: int = WIDTH) -> Column:
    """array<bigint> of bins / 8 packed words; empty for a text without words."""
    shift = 64 - (bins - 1).bit_length()
    low = (1 << BITS) - 1

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, shift)                   # -bins/2 ... bins/2 - 1, in order of h

    def pack(least: Column) -> Column:
        filled = F.transform(least, bin_of)

        def dense(values: Column) -> Column:
            # values: (bin, lowest bits) of all bins in order of bin
            return F.transform(F.sequence(F.lit(0), F.lit(bins - _PER_WORD), F.lit(_PER_WORD)), lambda at: F.aggregate(
                F.slice(values, at + 1, _PER_WORD), F.lit(0).cast("long"),
                lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.bitwiseAND(F.lit(low)))))

        def fill(known: Column) -> Column:
            empty = F.array_except(F.sequence(F.lit(-(bins // 2)).cast("long"), F.lit(bins // 2 - 1).cast("long")), known)
            donated = F.transform(empty, lambda k: F.shiftleft(k, BITS).bitwiseOR(
                F.array_min(F.transform(least, lambda h: F.xxhash64(k, bin_of(h)).bitwiseAND(F.lit(~low))
                                        .bitwiseOR(h.bitwiseAND(F.lit(low))))).bitwiseAND(F.lit(low))))
            own = F.transform(least, lambda h: F.shiftleft(bin_of(h), BITS).bitwiseOR(h.bitwiseAND(F.lit(low))))
            return let(F.sort_array(F.concat(own, donated)), dense)

        return let(filled, fill)

    def of(hashes: Column) -> Column:
        least = F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(let(least, pack))

    return let(shingle_hashes(text, width), of)


def as_text(packed: Column) -> Column:
    """Fingerprint as a string of hexadecimal digits, two for each bin."""
    return F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), "")


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness of the two texts' shingle sets, from 0 to 1."""
    ones = int("01" * 8, 16)

    def differing(x: Column, y: Column) -> Column:
        # bins (bytes) in which the words differ: the lowest bit of a byte gathers its eight
        def gather(v: Column) -> Column:
            v = let(v, lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 4)))
            v = let(v, lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 2)))
            return let(v, lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 1)))
        return F.bit_count(gather(x.bitwiseXOR(y)).bitwiseAND(F.lit(ones)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, v: acc + v)
    agree = F.lit(1.0) - unequal / F.lit(float(bins))
    chance = 2.0 ** -BITS
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest((agree - chance) / (1 - chance), F.lit(0.0))))


def with_next(docs: DataFrame, order: str, value: str, derived: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """``docs`` (``order``, ``value``) with the ``derived`` columns and ``next_<column>``: those
    of the next row in ascending ``order`` (ties by ``value``, NULL first), of the first row
    for the last.

    Rows are cut into ranges of ``order`` at quantiles; the first rows of each range are
    also dealt to the range before it, so a window within ranges sees every successor and
    no task sees more than a range."""
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(order), F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")

    def bucket(k: Column) -> Column:
        # number of cuts below k, by halving
        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            return F.when(acc["lo"] >= acc["hi"], acc) \
                .when(F.element_at(bounds, mid + 1) < k, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))) \
                .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step)["lo"]

    placed = docs.select(order, value, key.alias("__key"), bucket(key).alias("__bucket"))
    firsts = docs.select(key.alias("k")).select("k", bucket(F.col("k")).alias("b")).groupBy("b").agg(F.min("k").alias("k")).collect()
    firsts = sorted((r["b"], r["k"]) for r in firsts)               # at most one per range
    before = {k: (firsts[i - 1][0], i == 0) for i, (_, k) in enumerate(firsts)}
    guests = spark.createDataFrame([(k, b, last) for k, (b, last) in before.items()], "__key long, __to int, __wrap boolean")
    home = placed.withColumns({"__guest": F.lit(False), "__wrap": F.lit(False)})
    lent = placed.join(F.broadcast(guests), "__key").select(
        order, value, "__key", F.col("__to").alias("__bucket"), F.lit(True).alias("__guest"), "__wrap")
    window = Window.partitionBy("__bucket").orderBy("__wrap", "__guest", "__key", value)
    return (home.unionByName(lent).withColumns(derived)
            .select("*", *[F.lead(v).over(window).alias(f"next_{v}") for v in (value, *derived)])
            .filter("not __guest").drop("__key", "__bucket", "__guest", "__wrap"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) per row of ``docs``: the edited text has its last floor(n_chars / 2) code
    points replaced by as many of the next document's first (or all it has)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(own, "doc_id", "text", {"print": fingerprint(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = pairs.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    both = both.withColumn("edited_print", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))

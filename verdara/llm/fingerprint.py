"""Homomorphic multiset fingerprints of texts.

A text is the multiset of its paragraphs (what stands between line ends).  Each paragraph is
hashed to a wide vector of 32-bit lanes and a text's fingerprint is the sum of the vectors modulo
2^32, so the order of paragraphs does not matter and paragraphs are added to or taken out of a
fingerprint by adding or subtracting their vectors, without the rest of the text.

The vector has three parts.  COUNT: one lane with the number of clauses.  EXACT lanes: a full
hash of the paragraph, for equality.  LIKE lanes: for every clause of the paragraph (what stands
between the marks ``.!?;:|`` and line ends) the bits of its hash, so that lane sums hold signed
sums 2 * lane - COUNT, whose cosine estimates the cosine of the two clause multisets whatever
their size.

Defined results: NULL text: the empty text.  Equal texts have equal fingerprints and likeness 1;
so have two texts of equal paragraphs in another order.  Two texts without clauses are alike only
if their fingerprints are equal.  The order of documents is ascending key, NULL keys first, equal
keys by text; repeated rows follow one another.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LIKE = 16, 128
MASK = (1 << 32) - 1
_PAIR = (1 << 32) + 1
#: Rows of one range of keys.
ROWS_PER_RANGE = 20_000
#: Quantiles that are taken as literals, and ranges whose keys may be broadcast.
CUTS, SMALL = 1024, 100_000


def _add(state: Column, more: Column) -> Column:
    return F.zip_with(state, more, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _exact(text: Column) -> Column:
    """EXACT lanes: two 64-bit hashes of each paragraph, stretched to 16 lanes of 32 bits."""
    seeds = F.transform(F.split(text, "\n", -1), lambda p: F.struct(
        F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b")))
    return _let(seeds, lambda own: F.transform(
        F.sequence(F.lit(0), F.lit(EXACT - 1)), lambda i: F.aggregate(
            own, F.lit(0).cast("long"),
            lambda s, p: s + F.xxhash64(i, p["a"], p["b"]).bitwiseAND(F.lit(MASK)),
            lambda s: s.bitwiseAND(F.lit(MASK)))))


def _clauses(text: Column) -> Column:
    """Clauses without the blanks around them; empty ones do not count."""
    parts = F.transform(F.split(text, r"[.!?;:|\n]", -1), F.trim)
    return F.filter(parts, lambda c: c != "")


def _like(clauses: Column) -> Column:
    """LIKE lanes.  Two lanes share one 64-bit sum: bits i and i + 32 of the hash go to its two
    halves, which cannot overflow into each other before 2^32 clauses."""
    def pairs(seed: int) -> Column:
        hashes = F.transform(clauses, lambda c: F.xxhash64(F.lit(seed), c))
        return _let(hashes, lambda own: F.transform(
            F.sequence(F.lit(0), F.lit(31)), lambda i: F.aggregate(
                own, F.lit(0).cast("long"), lambda s, h: s + F.call_function(
                    "shiftrightunsigned", h, i).bitwiseAND(F.lit(_PAIR)))))

    both = F.concat(*[pairs(2 + n) for n in range(LIKE // 64)])
    return F.flatten(F.transform(both, lambda p: F.array(
        p.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(p, 32))))


def lanes(text: Column) -> Column:
    """Array of 1 + EXACT + LIKE lanes."""
    return _let(_clauses(text), lambda c: F.concat(
        F.array(F.size(c).cast("long")), _exact(text), _like(c)))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _add(a, b)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def as_text(fingerprint: Column) -> Column:
    """Hexadecimal digits, eight for every lane."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the signed lane sums; 1 exactly for equal fingerprints."""
    def signed(f: Column) -> Column:
        return F.transform(F.slice(f, 2 + EXACT, LIKE),
                           lambda x: (2 * x - f[0]).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def cosine(x: Column, y: Column) -> Column:
        return _let(F.sqrt(dot(x, x) * dot(y, y)),
                    lambda n: F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0)))

    found = _let(signed(a), lambda x: _let(signed(b), lambda y: cosine(x, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def _ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """Add _range, in the order of the keys, with about ROWS_PER_RANGE rows each.

    At most CUTS quantiles are taken; beyond them each interval is cut evenly by key.
    """
    n = rows.count()
    # several ranges for each shuffle partition, so that their hashes spread evenly
    parts = max(1, -(-n // ROWS_PER_RANGE),
                4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = min(parts, CUTS)
    cuts = rows.agg(F.percentile_approx(
        "_key", [i / level for i in range(level + 1)], 10 * level + 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    if len(cuts) < 2:
        return rows.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(0)
                               .cast("long")), 2
    inner = -(-parts // level)
    at = F.greatest(F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]),
                                    lambda c: c <= F.col("_key"))), F.lit(1))
    edges = F.array(*[F.lit(c) for c in cuts])
    low, high = F.element_at(edges, at), F.element_at(edges, at + 1)
    step = F.greatest(F.lit(0), F.least(F.lit(inner - 1), F.floor(
        (F.col("_key") - low).cast("double") / (high - low) * inner)))
    ranged = rows.withColumn("_range", F.when(F.col("_key").isNull(), F.lit(-1)).otherwise(
        at * inner + (step if inner > 1 else F.lit(0))).cast("long"))
    return ranged, parts + 2


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _text, _next, _print, _next_print): every row with text and fingerprint of the next
    row by (key, text); the row after the last is the first.

    Rows are cut into ranges of keys.  Each range also gets a copy of the first row of the next
    one, so a window lead inside the range finds every next row.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    ranged, parts = _ranges(rows)
    least = ranged.groupBy("_range").agg(F.min("_key").alias("_least"))
    small = F.broadcast(least) if parts <= SMALL else least
    heads = (ranged.join(small, "_range").where(F.col("_key").eqNullSafe(F.col("_least")))
             .groupBy("_range").agg(F.min("_text").alias("_head")))
    # one row per range
    ring = Window.partitionBy(F.lit(0)).orderBy("_range")
    following = heads.select("_range", F.coalesce(
        F.lead("_head").over(ring), F.first("_head").over(ring)).alias("_text"))
    rows = ranged.select("_range", F.lit(0).alias("_copy"), "_key", "_text").unionByName(
        following.select("_range", F.lit(1).alias("_copy"),
                         F.lit(None).cast(ranged.schema["_key"].dataType).alias("_key"), "_text"))
    order = Window.partitionBy("_range").orderBy("_copy", F.col("_key").asc_nulls_first(), "_text")
    return (rows.withColumn("_next", F.lead("_text").over(order))
            .withColumn("_print", lanes(F.col("_text")))
            .withColumn("_next_print", F.lead("_print").over(order))
            .where("_copy = 0").drop("_copy", "_range"))


def edited_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, whose last half of characters gives way
    to as many first ones of the next text.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half),
                      F.substring(F.col("_next"), F.lit(1), half))
    rows = (with_next(docs, key, text)
            .select("_key", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_print",
                    "_next_print")
            .withColumn("_edited_print", lanes(F.col("_edited"))))
    return rows.select(F.col("_key").alias(key), "n_chars",
                       F.sha2("_edited", 256).alias("edited_sha256"),
                       as_text(F.col("_print")).alias("fingerprint"),
                       as_text(F.col("_edited_print")).alias("edited_fingerprint"),
                       likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
                       likeness(F.col("_print"), F.col("_next_print")).alias("near_next"))

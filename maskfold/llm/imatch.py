"""Document fingerprints by I-Match with many randomised lexica.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies in a band. A text's distinct lexicon
terms are sorted and hashed: once for the whole lexicon, and for random subsets of it. Subset (i, l) keeps a term if
its hash under seed i starts with l zero bits, so for every length of a text there are subsets that keep one to
`keep` of its terms; these react to part of a change only, and their hashes are compared one by one. A subset that
keeps more terms says nothing a copy of the whole does not say and is left out.

All of it is DataFrame functions: two counts over the corpus, one shuffle of the texts.
"""
from __future__ import annotations

from dataclasses import dataclass
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise
from maskfold.plans.ordering import bind, running

from . import text as T


@dataclass(frozen=True)
class Band:
    """`low` and `high` bound ln(N / df) of a lexicon term; a text with fewer than `enough` lexicon terms is hashed
    over all its terms. `seeds` random orders of the lexicon, subsets with up to `keep` terms of a text."""

    low: float = 4.6  # at most one document in 100
    high: float = 8.0  # at least one in 3,000
    enough: int = 8
    seeds: int = 24
    keep: int = 3


#: a lexicon has at most (mean distinct terms of a document) * exp(high) terms, whatever the size of the corpus;
#: above this many it is joined by a shuffle instead of a broadcast
BROADCAST_TERMS = 4_000_000


def _words(t: Column) -> Column:
    return F.array_distinct(T.words(t))


def lexicon(docs: DataFrame, band: Band = Band(), text: str = "text") -> DataFrame:
    """(term): 64-bit hashes of the terms of the band, from the document frequencies of all rows."""
    n = docs.count()
    terms = docs.select(F.explode(_words(F.col(text))).alias("w")).groupBy(F.xxhash64("w").alias("term")).agg(F.count("*").alias("df"))
    return terms.where((F.col("df") >= n * exp(-band.high)) & (F.col("df") <= n * exp(-band.low))).select("term")


def hashes(terms: Column, band: Band = Band()) -> Column:
    """The fingerprint as a sorted array of distinct integers, from the distinct term hashes of a text; empty for none."""
    whole = F.hash(F.sort_array(terms))

    def of(seed: Column) -> Column:
        ranks = F.sort_array(F.transform(terms, lambda t: F.shiftrightunsigned(F.xxhash64(t, seed), 1)))

        def subsets(first: Column) -> Column:
            found = []
            for n in range(1, band.keep + 1):
                # the subset of the n smallest is one of a lexicon if a power of two parts the n-th from the next
                here, after = F.get(first, F.lit(n - 1)), F.get(first, F.lit(n))
                bits = lambda y: F.length(F.bin(y))
                parted = here.isNotNull() & (after.isNull() | (bits(here) < bits(after)))
                found.append(F.when(parted, F.hash(seed, F.slice(first, 1, n))))
            return F.array(*found)

        return bind(F.slice(ranks, 1, band.keep + 1), subsets)

    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(band.seeds)), of))
    parts = F.concat(F.array(whole), F.array_compact(parts))
    return F.when(F.size(terms) > 0, F.array_sort(F.array_distinct(parts))).otherwise(F.array().cast("array<int>"))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes by all hashes of both, 0 to 1; 1 if both are empty."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def as_text(a: Column) -> Column:
    """Eight hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _pairs(keys: DataFrame) -> DataFrame:
    """(k, h, z, next_k, next_h, kind, copies, half) from the distinct (k, h, z, copies, n_chars): each row and the row
    that follows in descending order. Repeated rows follow each other: `kind` 1 is a row followed by its own copy."""
    placed = materialise(running(keys, [F.col("z"), F.bitwise_not(F.col("k")), F.col("h")], pos="at"), "places")
    n = placed.count()
    after = placed.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.when(F.col("at") == 1, n).otherwise(F.col("at") - 1).alias("at"))
    half = F.floor(F.col("n_chars") / 2).cast("int").alias("half")
    each = placed.join(after, "at").select("k", "h", "z", "next_k", "next_h", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("copies"), half)
    own = placed.where("copies > 1").select("k", "h", "z", F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.lit(1).alias("kind"), (F.col("copies") - 1).alias("copies"), half)
    return each.unionAll(own)


def fingerprints(docs: DataFrame, band: Band = Band(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_chars, edited_sha256, `own` and `edited` (arrays, see `hashes`), near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document's, in descending order of the integer key, null last, ties by a hash of the text; the first
    follows the last. Null text is empty; a text without words has an empty fingerprint, and two of these have likeness 1.
    Repeated rows follow each other. Texts of any length are read whole, in one row of one task. Equal texts have equal
    fingerprints. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)[key]
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lex = materialise(lexicon(docs, band), "lexicon")
    if lex.count() <= BROADCAST_TERMS:
        lex = F.broadcast(lex)
    # a row is known by its key (0 for null) and a hash of its text that a null key changes
    z = F.col("key").isNull()
    docs = docs.select(F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("k"), F.xxhash64("text", z).alias("h"), z.alias("z"), "text")
    # one row per key and text, brought together by the only shuffle of whole texts; all joins below reuse it
    base = docs.groupBy("k", "h").agg(F.first("text").alias("text"))
    keys = docs.select("k", "h", "z", F.length("text").cast("long").alias("n_chars"))
    keys = keys.groupBy("k", "h").agg(F.count("*").alias("copies"), F.first("z").alias("z"), F.first("n_chars").alias("n_chars"))
    pairs = materialise(_pairs(keys), "pairs")

    heads = pairs.join(base.withColumnsRenamed({"k": "next_k", "h": "next_h"}), ["next_k", "next_h"])
    heads = heads.select("k", "h", "kind", "half", F.expr("left(text, half)").alias("head"))
    both = base.join(heads, ["k", "h"]).select(
        "k", "h", "kind", F.length("text").cast("long").alias("n_chars"), F.col("text").alias("own"),
        F.concat(F.expr("left(text, length(text) - half)"), F.col("head")).alias("edited"),
    )

    # the lexicon terms of a row's texts, tagged by text: 0 its own, 1 edited, 2 edited by its own copy
    texts = [F.struct((F.col("kind") + 1).alias("side"), F.col("edited").alias("t"))]
    first = F.struct(F.lit(0).alias("side"), F.col("own").alias("t"))
    words = both.select("k", "h", F.inline(F.when(F.col("kind") == 0, F.array(first, *texts)).otherwise(F.array(*texts))))
    words = words.select("k", "h", "side", F.explode(_words(F.col("t"))).alias("w")).select("k", "h", "side", F.xxhash64("w").alias("term"))
    found = words.join(lex, "term").groupBy("k", "h").agg(
        *[F.collect_list(F.when(F.col("side") == s, F.col("term"))).alias(f"in{s}") for s in range(3)]
    )

    def terms(inside: Column, t: Column) -> Column:
        return F.when(F.size(inside) >= band.enough, inside).otherwise(F.transform(_words(t), lambda w: F.xxhash64(w)))

    out = both.join(found, ["k", "h"], "left").select(
        "k", "h", "kind", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("in0"), F.col("own")).alias("own"),
        terms(F.when(F.col("kind") == 0, F.col("in1")).otherwise(F.col("in2")), F.col("edited")).alias("edited"),
    )
    done = materialise(out.withColumns({c: hashes(F.col(c), band) for c in ("own", "edited")}), "fingerprints")

    other = done.where("kind = 0").select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("own").alias("next"))
    after = pairs.join(other, ["next_k", "next_h"]).select("k", "h", "kind", "z", "copies", "next")
    return done.join(after, ["k", "h", "kind"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.when(~F.col("z"), F.col("k")).cast(kind).alias(key), "n_chars", "edited_sha256", "own", "edited",
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )

"""Find secrets: three fixed patterns, and strings whose sliding-window entropy is that of random keys.

The entropy of a window of `window` characters is kept up while it moves over a candidate string: the
counts of the entering and of the leaving character change by one, and so does the running sum of
c * log2(c). Each character class (hex, base64) has a threshold of its own, and allow-listed
strings (identifiers, digests written as such, placeholders) are suppressed.
"""
from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskfold.plans.ordering import bind

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

#: a candidate has a digit and a letter; the look-ahead keeps plain words out before any counting
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS = 2.9
BASE64_BITS = 3.75
#: a word, an abbreviation or a number, as they stand between the slashes of a path
_PART = r"(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})"
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(?:^|[-_/+=])(?:(?:example|placeholder|changeme|dummy|sample)(?:[-_/+=]|$)|your[-_])",
    r"^[0-9_=+/-]*[A-Za-z]?[0-9_=+/-]*$",
    r"(?i)abcdefgh|0123456789|qwertyui",
    rf"^(?:/+{_PART}(?:[-_=]{_PART})*)+[-_=/]*$",
    r"^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]+$",
)

SPAN = "struct<start:bigint,kind:int,end:bigint>"


def scan(values: Column, op, zero: int, block: int = 256) -> Column:
    """Running `op` over an array of whole numbers, blocks first and then their heads, so that growing a result array
    costs `block` steps a value and not the length of the array."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(zero).cast("bigint").alias("at"), none.alias("out"))

    def grow(a: Column, x: Column) -> Column:
        return bind(op(a["at"], x), lambda v: F.struct(v.alias("at"), F.concat(a["out"], F.array(v)).alias("out")))

    def head(a: Column, part: Column) -> Column:
        return F.struct(op(a["at"], F.element_at(part, -1)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def over(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / block).cast("int") - 1), lambda b: F.slice(x, b * block + 1, F.lit(block)))
        local = F.transform(blocks, lambda b: F.aggregate(b, start, grow, lambda a: a["out"]))
        return bind(local, lambda parts: F.flatten(F.zip_with(
            parts, F.aggregate(parts, start, head, lambda a: a["out"]), lambda p, h: F.transform(p, lambda v: op(h, v)))))

    return bind(values, lambda x: F.when(F.size(x) > 0, over(x)).otherwise(none))


def _found(text: Column, pattern: str, groups: int, kind: int, ok, quick: Column) -> Column:
    """Spans of all leftmost non-overlapping matches that satisfy `ok(match, last group)`.

    The text before each match is taken with it, so positions are sums of lengths in code points.
    """
    around = f"\\G(?s:(.*?))({pattern})"  # \\G: a failed search must not start again further on
    gaps = F.regexp_extract_all(text, F.lit(around), F.lit(1))
    hits = F.regexp_extract_all(text, F.lit(around), F.lit(2))
    last = F.regexp_extract_all(text, F.lit(around), F.lit(2 + groups)) if groups else hits
    zipped = F.arrays_zip(gaps.alias("g"), hits.alias("m"), last.alias("v"))
    item = lambda z: F.struct((F.length(z["g"]) + F.length(z["m"])).cast("long").alias("step"), F.length(z["m"]).cast("long").alias("n"), ok(z["m"], z["v"]).alias("ok"))

    def placed(items: Column) -> Column:
        ends = scan(F.transform(items, lambda x: x["step"]), lambda a, b: a + b, 0)
        span = lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["ok"].alias("ok"))
        good = F.filter(F.zip_with(items, ends, span), lambda s: s["ok"])
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    spans = bind(F.transform(zipped, item), placed)
    return F.when(quick, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def max_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any `window` neighbouring characters of `s`; of all of `s` if shorter."""
    f = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    table = F.array(*[F.lit(x) for x in f])

    def fold(chars: Column) -> Column:
        alphabet = F.array_distinct(chars)
        codes = bind(alphabet, lambda al: F.transform(chars, lambda c: F.array_position(al, c).cast("int") - 1))
        zero = bind(alphabet, lambda al: F.transform(al, lambda _: F.lit(0)))
        start = F.struct(zero.alias("c"), F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(1e18).alias("best"))

        def over(x: Column) -> Column:
            def step(a: Column, new: Column) -> Column:
                old = F.get(x, a["i"] - window)  # null while the window fills

                def moved(c: Column) -> Column:
                    gone = F.coalesce((F.lit(1) - (old == new).cast("int")), F.lit(0))  # the same one out and in changes nothing
                    n_new, n_old = F.get(c, new), F.coalesce(F.get(c, old), F.lit(0))
                    full = old.isNotNull() & (gone == 0)
                    s = F.when(full, a["s"]).otherwise(
                        a["s"] + F.get(table, n_new + 1) - F.get(table, n_new)
                        + F.when(gone == 1, F.get(table, n_old - 1) - F.get(table, n_old)).otherwise(0.0)
                    )
                    counts = F.when(full, c).otherwise(
                        F.transform(c, lambda n, k: n + (k == new).cast("int") - F.when((gone == 1) & (k == old), 1).otherwise(0))
                    )
                    filled = (a["i"] + 1 >= window) | (a["i"] + 1 == F.size(x))
                    return bind(s, lambda t: F.struct(
                        counts.alias("c"), (a["i"] + 1).alias("i"), t.alias("s"),
                        F.when(filled, F.least(a["best"], t)).otherwise(a["best"]).alias("best"),
                    ))

                return bind(a["c"], moved)

            return F.aggregate(x, start, step)["best"]

        return bind(codes, over)

    n = F.least(F.length(s), F.lit(window)).cast("double")
    best = bind(F.split(s, ""), fold)
    return F.log2(n) - best / n


def _suspicious(s: Column, window: int, hex_bits: float, base64_bits: float, allow: Sequence[str]) -> Column:
    allowed = F.lit(False)
    for p in allow:
        allowed = allowed | s.rlike(p)
    h = F.when(s.rlike("^[0-9a-fA-F]+$"), hex_bits).otherwise(base64_bits)
    return F.when(allowed, False).otherwise(max_entropy(s, window) >= h)


def find(
    docs: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    base64_bits: float = BASE64_BITS,
    allow: Sequence[str] = ALLOW,
    out: str = "spans",
) -> DataFrame:
    """Add `out`: spans (start, kind, end) in code points, end exclusive, by start and then kind; `kind` counts in KINDS.

    Matches of a fixed pattern always stay; an entropy span is added where it overlaps none of them.
    Null and empty texts have no spans. Rows and other columns stay as they are, but a column called `out` is replaced; repeated
    rows are scanned each for itself, an empty table gives no rows. Texts of any length are scanned whole, in time about linear in the spans.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    longer = lambda k: lambda m, v: F.length(v) >= k
    has = lambda p: t.rlike(p)
    assign = _found(t, ASSIGN, 2, 0, longer(8), has(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    access = _found(t, ACCESS, 0, 1, longer(16), t.contains("AKIA"))
    hexes = _found(t, "[0-9a-f]{32,}", 0, 2, longer(32), has("[0-9a-f]{32}"))
    odd = _found(t, CANDIDATE, 0, 3, lambda m, v: _suspicious(m, window, hex_bits, base64_bits, allow), has(CANDIDATE))

    def merged(base: Column, more: Column) -> Column:
        # along the text, a base span speaks up at its start and an entropy span asks at its end how far base spans reach
        said = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["start"].alias("start"), b["end"].alias("end")))
        asked = F.transform(more, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("base"), x["start"].alias("start"), x["end"].alias("end")))

        def free(events: Column) -> Column:
            reach = scan(F.transform(events, lambda e: F.when(e["base"] == 1, e["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
            both = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), lambda z: (z["e"]["base"] == 0) & (z["r"] <= z["e"]["start"]))
            return F.transform(both, lambda z: F.struct(z["e"]["start"].alias("start"), F.lit(3).alias("kind"), z["e"]["end"].alias("end")))

        kept = F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(bind(F.sort_array(F.concat(said, asked)), free))
        return F.sort_array(F.concat(base, kept))

    return docs.withColumn(out, bind(F.concat(assign, access, hexes), lambda base: bind(odd, lambda more: merged(base, more))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The same rows and columns with every found span replaced by `mark`; overlapping spans become one.

    Texts without a span are left as they are, null stays null.
    """
    from .text import free_name

    name = free_name(docs, "secret_spans")
    found = find(docs, text, out=name, **options)
    t = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(t, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        fresh = F.concat(a["parts"], F.array(gap, F.lit(mark)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], fresh).otherwise(a["parts"]).alias("parts"))

    done = F.aggregate(F.col(name), start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    return found.withColumn(text, F.when(F.size(name) > 0, done).otherwise(t)).drop(name)


def text_of_spans(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

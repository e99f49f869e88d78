"""Character-pair similarity and small array edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dirwise.functions.values import col, text


def grams(c: Column | str, n: int = 2) -> Column:
    """Distinct substrings of length ``n``."""
    s = text(c)
    return F.when(
        F.length(s) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared pairs over all pairs; 1 for equal texts, 0 below three characters."""
    a, b = text(a), text(b)
    x, y = grams(a), grams(b)
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return (
        F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0))
        .when((F.length(a) < 3) | (F.length(b) < 3), F.lit(0.0))
        .otherwise(shared / union)
    )


def dice(a: Column | str, b: Column | str) -> Column:
    """Twice the shared pairs over both counts; 1 for equal texts, 0 for an empty one."""
    a, b = F.trim(F.lower(text(a))), F.trim(F.lower(text(b)))
    return dice_of(a, b, grams(a), grams(b))


def dice_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """``dice`` of two trimmed lower-case texts whose pairs are x and y."""
    both = F.size(x) + F.size(y)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0))
        .otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(both, F.lit(1)))
    )


def bits_of(pairs: Column | str, words: int = 4) -> Column:
    """Struct of a set's size ``n`` and its signature: a bit of 64 x ``words`` for each member, by its hash."""
    at = F.transform(pairs, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * words)).cast("int"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x % 64)
    none = F.struct(*[F.lit(0).cast("bigint").alias(f"w{w}") for w in range(words)])
    word = lambda s, x, w: F.when((x / 64).cast("int") == w, s[f"w{w}"].bitwiseOR(bit(x))).otherwise(s[f"w{w}"]).alias(f"w{w}")
    return F.aggregate(at, none, lambda s, x: F.struct(*[word(s, x, w) for w in range(words)]), lambda s: F.struct(F.size(pairs).alias("n"), *[s[f"w{w}"].alias(f"w{w}") for w in range(words)]))


def may_reach(a: Column, b: Column, least: Column, words: int = 4) -> Column:
    """By their ``bits_of`` two texts may have a Dice value of ``least``, or one be part of the other; false is certain."""
    # sets differ in at least as many members as their signatures in bits
    apart = [F.bit_count(a[f"w{w}"].bitwiseXOR(b[f"w{w}"])) for w in range(words)]
    alike = sum(apart[1:], apart[0]) <= (a["n"] + b["n"]) * (1 - least) + 1e-6
    both = [a[f"w{w}"].bitwiseAND(b[f"w{w}"]) for w in range(words)]
    inside = lambda s: sum([(both[w] == s[f"w{w}"]).cast("int") for w in range(1, words)], (both[0] == s["w0"]).cast("int")) == words
    return alike | inside(a) | inside(b)


def pair_key(a: Column | str, b: Column | str, sep: str = "::") -> Column:
    return F.array_join(F.array_sort(F.array(col(a), col(b))), sep)


def edit_tags(tags: Column | str, add=(), remove=()) -> Column:
    """Tags without the removed ones, then the added ones that are missing; order kept."""
    base = F.coalesce(col(tags), F.array().cast("array<string>"))
    drop = F.array(*[F.lit(t) for t in remove]).cast("array<string>")
    more = F.array(*[F.lit(t) if isinstance(t, str) else t for t in add]).cast("array<string>")
    kept = F.filter(base, lambda t: ~F.array_contains(drop, t))
    return F.array_distinct(F.concat(kept, F.filter(more, lambda t: t.isNotNull())))


def text_list(c: Column | str) -> Column:
    """Array from a JSON array text, else from a comma list; empties dropped."""
    s = text(c)
    parsed = F.when(s.rlike(r"^\s*\["), F.from_json(s, "array<string>"))
    plain = F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(parsed, plain)

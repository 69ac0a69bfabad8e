"""Column functions: words, similarities, distances, arithmetic hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

# The hash family's prime, and the signs that count as blanks in the narrow and the wide word rule.
PRIME = 149399
NARROW, WIDE = r"[(\[,.!?:;\])]", r"[{}+=~*%#$@(\-/\[,.!?&:;\]0-9)\"]"


def words(text, signs: str = NARROW):
    """The words of lower-cased text, signs taken as blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), signs, " "), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def jaccard(common, a, b):
    return common / (a + b - common)


def euclidean(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mahalanobis(v, n, total, squares):
    """Diagonal: dimensions without variance don't count."""
    mean = F.transform(total, lambda s: s / n)
    var = F.zip_with(squares, mean, lambda q, m: F.greatest(q / n - m * m, F.lit(0.0)))
    off = F.zip_with(v, mean, lambda x, m: (x - m) * (x - m))
    return F.sqrt(F.aggregate(F.zip_with(off, var, lambda d, s: F.coalesce(F.try_divide(d, s), F.lit(0.0))), F.lit(0.0), lambda t, x: t + x))


def residue(text, prime: int = PRIME):
    """The UTF-8 bytes of text read as one number, modulo prime; 0 for an empty text."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(hexes) - 1, F.lit(1)), F.lit(2)), lambda i: i < F.length(hexes))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: (a * 256 + F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("long")) % prime)


def hashes(x, a_range: range, b_range: range, modulus, prime: int = PRIME):
    """((a x + b) mod prime) mod modulus for all a and b."""
    return F.array(*(((x * a + b) % prime) % modulus for a in a_range for b in b_range))


def trailing_zeros(x):
    """Of a number's binary digits; 1 for 0, which has the single digit 0."""
    return F.when(x == 0, 1).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def to_second(ts):
    return F.date_trunc("second", ts)

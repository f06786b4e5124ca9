"""Scalar functions on sequences and counts, as column expressions."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
LETTERS = string.ascii_lowercase + string.ascii_uppercase
#: Each letter's base when prose is mined as a dense sequence: letters are dealt to the four bases in turn.
DENSE = "".join(BASES[i % 4] for i in range(26)) * 2


def normalize(text: Column) -> Column:
    """Upper-case bases; everything that is no base, N, colour digit or dot becomes N."""
    return F.regexp_replace(F.translate(text, "acgtn", "ACGTN"), "[^ACGTN0123.]", "N")


def dense(text: Column) -> Column:
    """Prose as bases: letters map to bases, other characters stay and break runs."""
    return F.translate(text, LETTERS, DENSE)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def strand_join(seq: Column) -> Column:
    return F.concat(seq, F.lit("-"), reverse_complement(seq))


def color_code(seq: Column) -> Column:
    """A digit for each pair of neighbouring bases (0 equal, up to 3), a dot where one is no base; short texts are empty.

    What is in colours already (after a first character that may be an adaptor) stays as it is; a mixture of colours and
    bases is an error."""
    chars = F.split(seq, "")
    place = lambda c: F.position(c, F.lit(BASES)) - 1
    digit = lambda a, b: F.when((place(a) >= 0) & (place(b) >= 0), place(a).bitwiseXOR(place(b)).cast("string")).otherwise(".")
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), digit)
    mixed = ~F.regexp_like(seq, F.lit("^[ACGTN]*$"))
    coded = F.when(F.length(seq) < 2, "").when(mixed, F.raise_error(F.lit("a sequence mixes colours and bases"))).otherwise(F.array_join(pairs, ""))
    return F.when(F.regexp_like(seq, F.lit("^.[0-3.]+$")), seq).otherwise(coded)


def library_name(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def entropy_term(freq: Column) -> Column:
    return (freq + 1) * F.log2(freq + 1)


def smoothed_entropy(total: Column, terms: Column, samples: int) -> Column:
    """Entropy in bits of add-one smoothed counts over `samples` samples, absent ones included."""
    mass = total + samples
    return F.log2(mass.cast("double")) - terms / mass


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series eight places on, less the product in between."""
    x = x.cast("double")
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share: the place of the first pair that differs. For short strings."""
    short = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), short), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1)))
    first = F.array_position(same, F.lit(False))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(first == 0, short).otherwise(first - 1)


def mismatch_list(a: Column, b: Column) -> Column:
    """(place, character of b) for each place where strings of equal length differ, as an array; null if lengths differ."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    placed = F.transform(pairs, lambda x, i: F.struct(i.alias("pos"), x["a"].alias("a"), x["b"].alias("b")))
    other = F.filter(placed, lambda x: x["a"] != x["b"])
    return F.when(F.length(a) == F.length(b), F.transform(other, lambda x: F.struct(x["pos"], x["b"].alias("char"))))


def mismatches(a: Column, b: Column) -> Column:
    """mismatch_list() as text: 'place character' joined by blanks."""
    return F.array_join(F.transform(mismatch_list(a, b), lambda x: F.concat(x["pos"].cast("string"), F.lit(" "), x["char"])), " ")


def bit_length(n: Column) -> Column:
    """Binary digits of a non-negative integer; one for 0."""
    return F.length(F.bin(n))


def floor_log2(n: Column) -> Column:
    return F.when(n < 1, 0).otherwise(bit_length(n) - 1)


def ceil_log2(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(bit_length(n - 1))


def next_multiple(n: Column, of: int) -> Column:
    """The least multiple that is strictly greater."""
    return (F.floor(n / of) + 1) * of


def trimmed(text: Column, n: int) -> Column:
    """A pattern without n characters on either side; empty if nothing is left."""
    return F.when(F.length(text) <= 2 * n, "").otherwise(F.substring(text, F.lit(n + 1), F.length(text) - 2 * n))

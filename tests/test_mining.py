"""Mining against a naive walk over all substrings, and properties that any input must show."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from motifmill.functions.sequences import color_code, lgamma, normalize, reverse_complement
from motifmill.operators.mining import MiningOptions, deep_nodes, merged, mine, nodes, parse_rows, row_text

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def naive(sequences, fmin, depth):
    freq, left = Counter(), defaultdict(Counter)
    for sample, seq in sequences:
        for strand in (seq, seq[::-1].translate(COMPLEMENT)):
            for i in range(len(strand)):
                for k in range(1, depth + 1):
                    path = strand[i : i + k]
                    if len(path) < k or set(path) - set("ACGT"):
                        break
                    freq[sample, path] += 1
                    left[sample, path][strand[i - 1] if i and strand[i - 1] in "ACGT" else ""] += 1
    out = {}
    for key, n in freq.items():
        if n >= fmin:
            seen = left[key]
            bases = [b for b in seen if b]
            out[key] = (n, "0" if not bases else bases[0] if len(seen) == 1 else "N")
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample string, seq string")


def as_dict(df):
    return {(r["sample"], r["path"]): (r["freq"], r["left_char"]) for r in df.collect()}


CASES = [
    [("a", "ACGTACGT"), ("b", "ACGT")],
    [("a", "ANCG"), ("a", "AAAA"), ("b", ""), ("b", "TTTTN-ACACAC")],
    [("a", "ACGT" * 5), ("a", "GATTACA"), ("c", "NNN"), ("b", "GATTACA")],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("fmin", [1, 2])
def test_nodes_equal_naive_walk(spark, rows, fmin):
    assert as_dict(nodes(frame(spark, rows), fmin, 4)) == naive(rows, fmin, 4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text("ACGTN", max_size=25)), min_size=1, max_size=5))
def test_nodes_on_any_sequences(spark, rows):
    found = as_dict(nodes(frame(spark, rows), 1, 3))
    assert found == naive(rows, 1, 3)
    for (sample, path), (n, _) in found.items():
        assert found[sample, path[::-1].translate(COMPLEMENT)][0] == n


def test_prefix_and_deep_nodes(spark):
    rows = CASES[2]
    whole = as_dict(nodes(frame(spark, rows), 2, 30))
    part = as_dict(nodes(frame(spark, rows), 2, 30, "AC"))
    assert part == {k: v for k, v in whole.items() if k[1].startswith("AC") or k[1] == "A"}


@pytest.mark.parametrize("fmin", [1, 3])
def test_deep_nodes_have_no_depth_bound(spark, fmin):
    rnd = random.Random(5)
    rows = [(rnd.choice(["s1", "s2", "s3"]), "".join(rnd.choice("ACGTN") for _ in range(rnd.choice([0, 5, 40])))) for _ in range(20)] + [("s1", "ACGTACGTAA" * 4)] * 3 + [("s4", "")]
    assert as_dict(deep_nodes(frame(spark, rows), fmin)) == naive(rows, fmin, 50)
    assert deep_nodes(frame(spark, rows).limit(0), fmin).count() == 0


def test_entropy_counts_absent_samples(spark):
    found = nodes(frame(spark, CASES[0]), 1, 2)
    for samples in (2, 5):
        row = merged(found, samples).where("path = 'A'").first()
        n = [r["freq"] for r in found.where("path = 'A'").collect()]
        mass = samples + sum(n)
        assert row["entropy"] == pytest.approx(math.log2(mass) - sum((f + 1) * math.log2(f + 1) for f in n) / mass)


def test_text_rows_round_trip(spark):
    mined = mine(frame(spark, CASES[2]), MiningOptions(fmin=1, depth=6, pmin=1))
    again = parse_rows(row_text(mined))
    want = {(r["path"], f["sample"], f["freq"]) for r in mined.collect() for f in r["freqs"]}
    assert {(r["path"], r["sample"], r["freq"]) for r in again.collect()} == want


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("acgXnT.7",)], "t string").select(normalize(F.col("t")).alias("n")).select("n", reverse_complement(F.col("n")).alias("r")).first()
    assert row["n"] == "ACGNNT.N" and row["r"] == "N.ANNCGT"
    colors = {r["t"]: r["c"] for r in spark.createDataFrame([("A",), ("AC",), ("ACGN",), ("TTA",)], "t string").select("t", color_code(F.col("t")).alias("c")).collect()}
    assert colors == {"A": "", "AC": "1", "ACGN": "13.", "TTA": "03"}
    got = spark.range(1, 400, 7).select("id", lgamma(F.col("id")).alias("g")).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["id"]), abs=1e-8) for r in got)

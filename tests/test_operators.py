"""Readers, text operators, matrices' edge cases, alignment and the streaming counts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from motifmill.functions import sequences
from motifmill.operators import alignment, intervals, matrices, mining, ranks, suffixes
from motifmill.operators.ordering import as_of, with_last, with_running
from motifmill.sources import readers
from motifmill.streaming import incremental


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 a->b\nACGTN\nacg\n>r2\nTT\n>r3 empty\n")
    assert {tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("r1", "ACGTNacg"), ("r2", "TT"), ("r3", "")}
    assert {tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fa"), skip=1, limit=1).collect()} == {("r2", "TT")}
    (tmp_path / "a.qual").write_text(">r1\nIIIII\nJJJ\n>r2\nKK\n>r3\n\n")
    got = readers.read_fasta_quality(spark, str(tmp_path / "a.fa"), str(tmp_path / "a.qual"))
    assert {tuple(r) for r in got.collect()} == {("r1", "ACGTNacg", "IIIIIJJJ"), ("r2", "TT", "KK"), ("r3", "", "")}
    (tmp_path / "a.fq").write_text("@q1 x\nACGT\n+\n@III\n@q2\nGG\n+\nII\n")
    assert {tuple(r) for r in readers.read_fastq(spark, str(tmp_path / "a.fq")).collect()} == {("q1", "ACGT", "@III"), ("q2", "GG", "II")}
    assert {tuple(r) for r in readers.read_fastq(spark, str(tmp_path / "a.fq"), limit=1).collect()} == {("q1", "ACGT", "@III")}
    (tmp_path / "reads").write_text("ACGT\nIIII\nGG\nJJ\n")
    assert [tuple(r) for r in readers.read_reads(spark, str(tmp_path / "reads"), str(tmp_path / "reads")).orderBy("nth").collect()] == [(0, "ACGT", "IIII"), (1, "GG", "JJ")]
    assert [tuple(r) for r in readers.read_reads(spark, str(tmp_path / "reads"), skip=2).orderBy("nth").collect()] == [(2, "GG", None), (3, "JJ", None)]
    with pytest.raises(Exception, match="title"):
        readers.read_reads(spark, str(tmp_path / "a.fa")).collect()
    (tmp_path / "map").write_text("0\n0\n1\n")
    assert {tuple(r) for r in readers.read_run_map(spark, str(tmp_path / "map")).collect()} == {(0, 0), (1, 0), (2, 1)}
    (tmp_path / "pats").write_text("00000012ACGT\n\nxxxxxxxxGG\n")
    assert {tuple(r) for r in readers.read_patterns(spark, str(tmp_path / "pats"), weight_width=8).collect()} == {("ACGT", 12), ("GG", 1)}
    (tmp_path / "pats").write_text("7\tAC GT\n\tTT\n")
    assert {tuple(r) for r in readers.read_patterns(spark, str(tmp_path / "pats"), tab=True).collect()} == {("AC GT", 7), ("TT", 1)}
    assert {tuple(r) for r in readers.read_patterns(spark, str(tmp_path / "map")).collect()} == {("0", 1), ("1", 1)}
    (tmp_path / "lines").write_text("ACG\n\nTTT\n")
    assert [r["seq"] for r in readers.read_lines(spark, str(tmp_path / "lines"), lower=True).collect()] == ["acg", "ttt"]
    (tmp_path / "zero").write_bytes(b"ab\0c\0")
    assert [r["seq"] for r in readers.read_null_separated(spark, str(tmp_path / "zero")).collect()] == ["ab", "c"]
    (tmp_path / "names").write_text("one\tx\n\ntwo\n")
    assert [r["name"] for r in readers.read_samples(spark, str(tmp_path / "names")).collect()] == ["one", "two"]
    (tmp_path / "names").write_text("one\none\n")
    with pytest.raises(ValueError):
        readers.read_samples(spark, str(tmp_path / "names"))
    (tmp_path / "fixed").write_text("# number=2 length=3 file=x\nab\ndef")
    assert {tuple(r) for r in readers.read_fixed_width_patterns(spark, str(tmp_path / "fixed")).collect()} == {(0, "ab\n"), (1, "def")}


def test_records_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "in" / "a").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "in" / "b").write_text("\n".join(lines[3000:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.records(spark, str(tmp_path / "in")).orderBy("nth").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["nth"], r["value"]) for r in got] == list(enumerate(lines))


def test_mined_rows_with_odd_names(spark):
    lines = ["ACG run.1:5 x:y:7", "AC 1.25 a:3", "A b:z", "T 0.5"]
    got = mining.parse_rows(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert {tuple(r) for r in got} == {("ACG", None, "run.1", 5), ("ACG", None, "x:y", 7), ("AC", 1.25, "a", 3), ("A", None, "b", None)}


def test_mined_rows_are_written_in_post_order(spark, tmp_path):
    rows = [("A", 1, 4, 0.5, [("s", 4)]), ("AC", 1, 3, 0.25, [("s", 3)]), ("C", 1, 2, 0.125, [("s", 2)])]
    mined = spark.createDataFrame(rows, "path string, n_samples long, total_freq long, entropy double, freqs array<struct<sample:string,freq:long>>")
    mining.write_rows(mined, str(tmp_path / "rows"), gzip=True)
    assert all(x.endswith(".gz") for x in os.listdir(tmp_path / "rows") if x.startswith("part"))
    assert [r["value"].split()[0] for r in spark.read.text(str(tmp_path / "rows")).collect()] == ["AC", "A", "C"]


def test_colours_pass_through_and_do_not_mix(spark):
    df = spark.createDataFrame([("ACGT",), ("A0123.",), ("012",), ("N",), ("ANA",)], "s string")
    assert [r[0] for r in df.select(sequences.color_code(F.col("s"))).collect()] == ["131", "A0123.", "012", "", ".."]
    with pytest.raises(Exception, match="mixes"):
        spark.createDataFrame([("A1C",)], "s string").select(sequences.color_code(F.col("s"))).collect()


def test_mismatches_may_be_blanks(spark):
    df = spark.createDataFrame([("abcd", "x y "), ("ab", "ab"), ("", ""), ("a", "ab")], "a string, b string")
    got = df.select(F.size(sequences.mismatch_list(F.col("a"), F.col("b"))).alias("n"), sequences.mismatches(F.col("a"), F.col("b")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(4, "0 x 1   2 y 3  "), (0, ""), (0, ""), (None, None)]


def sample_texts():
    rnd = random.Random(9)
    long = "".join(rnd.choice("ab") for _ in range(90))
    return [(1, "banana"), (2, "a" * 50), (3, long), (4, long), (5, long[:-1] + "c"), (6, ""), (7, "banana"), (8, "x" + long), (9, None), (10, "é日\U0010ffff a\x00"), (7, "banana$")]


def test_patterns_stand_between_their_bounds(spark):
    texts = sample_texts()
    patterns = ["a", "ab", "an", "zz", "ab", "a" * 50, "a" * 51, texts[2][1], texts[2][1][3:70], "é日", "\U0010ffff", "日\U0010ffff", "a\x00", "", "$"]
    df, pats = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(x,) for x in [*patterns, None]], "pattern string")
    found = suffixes.find(df, pats, ["k"])
    want = sorted((x, k, i) for x in set(patterns) if x for k, t in texts if t for i in range(len(t)) if t.startswith(x, i))
    assert sorted(tuple(r) for r in found.occurrences().collect()) == want
    assert {r["pattern"]: r["n"] for r in found.bounds.collect()} == {x: sum(w[0] == x for w in want) for x in set(patterns) if x}
    assert suffixes.find(df, pats.limit(0), ["k"]).occurrences().count() == 0
    assert suffixes.find(df.limit(0), pats, ["k"]).occurrences().count() == 0


@pytest.mark.parametrize("gram", [4, 32])
def test_suffix_order_and_prefixes_equal_sorting(spark, gram, monkeypatch):
    monkeypatch.setattr(suffixes, "SPAN", 16)
    texts = sample_texts()
    order, named = suffixes.named_order(spark.createDataFrame(texts, "k int, text string"), ["k"], gram, common=True)
    got = sorted((r["sa_rank"], r["k"], r["pos"], r["before"], r["lcp"]) for r in suffixes.with_keys(suffixes.common_prefixes(order, named, gram), named, ["k"]).collect())
    whole = sorted(((k, t) for k, t in texts if t is not None))
    want = sorted((t[i:], n, k, i, t[i - 1] if i else "") for n, (k, t) in enumerate(whole) for i in range(len(t) + 1))
    assert [x[1:4] for x in got] == [x[2:] for x in want] and [x[0] for x in got] == list(range(len(want)))
    assert [x[4] for x in got] == [len(os.path.commonprefix([want[n - 1][0], want[n][0]])) if n else 0 for n in range(len(want))]
    none = suffixes.named_order(spark.createDataFrame([], "k int, text string"), ["k"], gram, common=True)
    assert suffixes.common_prefixes(*none, gram).count() == 0


@pytest.mark.parametrize("gram", [4, 32])
def test_merged_suffix_orders_equal_the_whole(spark, gram):
    texts = [(k, t) for k, t in sample_texts() if t is not None]
    texts += [(100, "ab" * 60), (101, "ab" * 45), (102, ""), (103, texts[0][1])]
    frame = spark.createDataFrame(sorted(texts), "k int, text string")
    keys = sorted(k for k, _ in texts)
    low, high = keys[len(keys) // 3], keys[2 * len(keys) // 3]
    order, named = suffixes.named_order(frame.where(F.col("k") < low), ["k"], gram)
    for part in (frame.where(F.col("k").between(low, high)), frame.limit(0), frame.where(F.col("k") > high)):
        order, named = suffixes.merged_order(order, named, part, ["k"], gram)
    whole, all_named = suffixes.named_order(frame, ["k"], gram)
    seen = lambda o, n: sorted(tuple(r) for r in suffixes.with_keys(o.select("sa_rank", "tid", "g", "pos", "before"), n, ["k"]).collect())
    assert seen(order, named) == seen(whole, all_named)
    first, first_named = suffixes.merged_order(*suffixes.named_order(frame.limit(0), ["k"], gram), frame, ["k"], gram)
    assert seen(first, first_named) == seen(whole, all_named)


@pytest.mark.parametrize("after", [False, True])
def test_as_of_finds_the_nearest_row(spark, after):
    rnd = random.Random(6)
    keys = sorted(rnd.sample(range(1000), 60))
    asked = [(i, rnd.randrange(-5, 1005)) for i in range(300)] + [(999, None)]
    rows = spark.createDataFrame([(k, f"v{k}") for k in keys] + [(None, "x")], "key long, value string")
    got = as_of(spark.createDataFrame(asked, "name int, key long").repartition(3), rows, "key", ["value"], after)
    near = lambda q: None if q is None else next((f"v{k}" for k in (keys if after else keys[::-1]) if (k >= q if after else k <= q)), None)
    assert {(r["name"], r["key"], r["found"] and r["found"]["value"]) for r in got.collect()} == {(i, q, near(q)) for i, q in asked}
    assert as_of(spark.createDataFrame(asked, "name int, key long"), rows.limit(0), "key", ["value"], after).where("found is null").count() == len(asked)


def test_random_draws_follow_the_weights(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 10), ("c", 30), ("d", 60)], "name string, w long")
    got = [r["name"] for r in ranks.random_draws(rows, ["name"], "w", 4000, 7).collect()]
    assert len(got) == 4000 and "a" not in got
    assert all(abs(got.count(x) / 4000 - share) < 0.03 for x, share in (("b", 0.1), ("c", 0.3), ("d", 0.6)))
    again = [tuple(r) for r in ranks.random_draws(rows.repartition(3), ["name"], "w", 50, 7).orderBy("draw").collect()]
    assert again == [tuple(r) for r in ranks.random_draws(rows, ["name"], "w", 50, 7).orderBy("draw").collect()]
    assert again != [tuple(r) for r in ranks.random_draws(rows, ["name"], "w", 50, 8).orderBy("draw").collect()]
    assert ranks.random_draws(rows.limit(0), ["name"], "w", 50, 7).count() == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_rectangle_counts_equal_loops(spark, fan):
    rnd = random.Random(7)
    symbols = [rnd.choice("abcdé") for _ in range(333)]
    sides = [(i, rnd.randrange(-9, 340), rnd.randrange(-9, 340), rnd.choice("abcdef"), rnd.choice("abcdef")) for i in range(120)] + [(500, None, 4, "a", "b"), (501, 0, 400, "a", "z\u00ff")]
    placed = spark.createDataFrame(list(enumerate(symbols)), "pos long, c string").repartition(3)
    got = {r["name"]: r["n"] for r in ranks.rectangle_counts(placed, "c", spark.createDataFrame(sides, "name int, low int, high int, least string, most string"), fan).collect()}
    assert got == {i: 0 if lo is None else sum(lo <= p <= hi and a <= c <= b for p, c in enumerate(symbols)) for i, lo, hi, a, b in sides}


def branching_strings(texts):
    """{string: (occurrences, texts)} of those that go on in two ways, each text's end being one."""
    seen = {}
    for k, t in texts:
        for i in range(len(t or "") + 1) if t is not None else ():
            for j in range(i, len(t) + 1):
                seen.setdefault(t[i:j], []).append((k, t[j : j + 1] or ("end", k)))
    return {x: (len(v), len({k for k, _ in v})) for x, v in seen.items() if len({n for _, n in v}) > 1}


@pytest.mark.parametrize("size", [None, 5, 40])
def test_prefix_intervals_are_the_branching_strings(spark, size):
    rnd = random.Random(11)
    texts = [(i, "".join(rnd.choice("ab$") for _ in range(rnd.choice([0, 3, 30])))) for i in range(8)] + [(8, "a" * 40), (9, "a" * 40), (10, "ab" * 15), (11, None)]
    order, named = suffixes.named_order(spark.createDataFrame(texts, "k int, text string"), ["k"], common=True)
    rows = suffixes.common_prefixes(order, named).select("sa_rank", "lcp", F.col("tid").alias("doc"), "tid", "pos")
    by = {r["tid"]: r["text"] for r in named.collect()}
    got = {by[r["tid"]][r["pos"] : r["pos"] + r["depth"]]: r for r in intervals.nodes(rows, size).collect()}
    want = branching_strings(texts)
    assert {x: (r["last"] - r["first"] + 1, r["n_docs"]) for x, r in got.items()} == want
    assert all(r["up_depth"] == max((j for j in range(len(x)) if x[:j] in want), default=None) for x, r in got.items())


def test_document_graph(spark):
    texts = [(1, "ab$"), (2, "ab"), (3, "xyc"), (4, "xyd"), (5, "abab"), (6, None), (7, "")]
    df = spark.createDataFrame(texts, "path int, text string")
    nodes, edges = intervals.document_graph(df, ["path"], 4)
    want = {x: n for x, n in branching_strings(texts).items() if x}
    kept = {x: n for x, n in want.items() if not (above := [x[:j] for j in range(1, len(x)) if x[:j] in want]) or want[above[-1]][0] > 4}
    assert {r["path"]: (r["n_suffixes"], r["n_docs"]) for r in nodes.collect()} == kept and {"ab", "b", "xy"} <= set(kept)
    assert {tuple(r) for r in edges.collect()} == {(x, k) for x in kept for k, t in texts if t and x in t}
    assert intervals.document_graph(df.limit(0), ["path"], 4)[0].count() == 0


def test_last_values_over_many_ranges(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, None, None, i])) for i in range(400)]
    got = with_last(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k"], {"last": F.col("v")}).orderBy("k").collect()
    now = None
    for (i, v), r in zip(rows, got):
        now = v if v is not None else now
        assert (r["k"], r["last"]) == (i, now)


def test_strain_texts(spark):
    df = spark.createDataFrame([(2, "c - g"), (1, "A c _"), (0, ">title"), (3, "t t t")], "at int, line string")
    got = {r["strain"]: r["text"] for r in readers.strain_texts(df, ["at"], "line").collect()}
    assert got == {0: "ACT", 1: "CT", 2: "GT"}


def test_strain_texts_over_many_ranges(spark, monkeypatch):
    rnd, kept = random.Random(2), []
    monkeypatch.setattr(readers, "stored", lambda df, what, keep=readers.stored: kept.append(keep(df, what)) or kept[-1])
    rows = [(i, " ".join(rnd.choice("acgß-") for _ in range(rnd.randint(1, 4)))) for i in range(300)]
    df = spark.createDataFrame(rows, "at int, line string").repartition(5)
    want = ["".join(line[2 * k] for _, line in rows if len(line) > 2 * k).replace("-", "") for k in range(4)]
    out = readers.strain_texts(df, ["at"], "line", 7)
    assert {(r["strain"], r["chunk"]): r["text"] for r in out.collect()} == {(k, c // 7): t[c : c + 7].upper() for k, t in enumerate(want) for c in range(0, len(t), 7)}
    assert kept[0].count() < 300  # pieces of ranges, not rows of one character


def test_running_sums_over_many_ranges(spark):
    rows = [(i, i % 3) for i in random.Random(1).sample(range(500), 500)]
    got = with_running(spark.createDataFrame(rows, "k int, v int").repartition(7), ["k"], "pos", {"s": F.col("v")}).orderBy("k").collect()
    total = 0
    for i, r in enumerate(got):
        total += r["v"]
        assert (r["pos"], r["s"]) == (i, total)
    assert with_running(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def test_matrices_equal_pair_loops(spark):
    rnd = random.Random(3)
    rows = [(i, s, rnd.randint(1, 9)) for i in range(40) for s in "abcd" if rnd.random() < 0.6]
    df = spark.createDataFrame(rows, "row_id int, sample string, freq int")
    dims = spark.createDataFrame([(s,) for s in "abcd"], "sample string")
    got = {(r["max_entropy"], r["s"], r["t"]): r for r in matrices.pair_matrices(df, matrices.row_entropy(df, 4), [0.95, 1.0], dims).collect()}
    by = {}
    for i, s, f in rows:
        by.setdefault(i, {})[s] = f
    for s in "abcd":
        for t in "abcd":
            if s <= t:
                assert got[1.0, s, t]["cnt"] == sum(s in v and t in v for v in by.values())
                if s < t:
                    want = sum((v.get(s, 0) ** 0.5 - v.get(t, 0) ** 0.5) ** 2 for v in by.values())
                    assert got[1.0, s, t]["sqrt_d"] == pytest.approx(want)
                assert got[0.95, s, t]["cnt"] <= got[1.0, s, t]["cnt"]
    assert matrices.thresholds_by_step(0.25) == [0.0, 0.25, 0.5, 0.75, 1.0]
    run_map = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "run int, sample string")
    runs = spark.createDataFrame([(7, 0, 5), (7, 1, 2), (7, 2, 1)], "row_id int, run int, freq int")
    assert {tuple(r) for r in matrices.to_samples(runs, run_map, 2).collect()} == {(7, "a", 2)}


def test_write_matrices_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", "a", 1, 0.0, 0.0, 0.0), (1.0, "a", "b", 1, 2.5, 0.5, 0.25), (1.0, "b", "b", 2, 0.0, 0.0, 0.0)], "max_entropy double, s string, t string, cnt long, log_d double, sqrt_d double, lgamma_d double")
    rows = spark.createDataFrame([(1.0, 3)], "max_entropy double, n_rows long")
    matrices.write_matrices(df, rows, str(tmp_path), "x")
    assert set(os.listdir(tmp_path)) == {"count.x", "log.x", "sqrt.x", "lgamma.x"}
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "log.x")).collect()]
    assert lines == ["Matrix for <max_entropy>=<1.000000> was computed from 3 substrings: ", " 0.000000 2.500000", " 0.000000 0.000000"]
    with pytest.raises(Exception):
        matrices.write_matrices(df, rows, str(tmp_path), "x")


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", "ab"), ("same", "same"), ("abc", "")])
def test_edit_operations_rebuild_the_target(a, b):
    ops, i, j, made = alignment.operations(a, b), 0, 0, []
    for o in ops:
        if o in "MX":
            made.append(b[j])
            assert (a[i] == b[j]) == (o == "M")
            i, j = i + 1, j + 1
        elif o == "D":
            i += 1
        else:
            made.append(b[j])
            j += 1
    assert "".join(made) == b and i == len(a)
    assert sum(int(n) for n in __import__("re").findall(r"\d+", alignment.cigar(ops))) == len(ops)


def test_edit_operations_keep_few_rows():
    rnd = random.Random(1)
    for n in (0, 3, 14, 200):
        a = "".join(rnd.choice("abc") for _ in range(n))
        b = "".join(c if rnd.random() > 0.3 else rnd.choice("abc") for c in a)[n // 5 :] + "ab" * (n % 4)
        cost = [list(range(len(b) + 1))]
        for i, x in enumerate(a):
            cost.append([i + 1])
            for j, y in enumerate(b):
                cost[-1].append(min(cost[i][j] + (x != y), cost[i][j + 1] + 1, cost[-1][j] + 1))
        ops = alignment.operations(a, b)
        assert sum(o != "M" for o in ops) == cost[-1][-1]
        i, j = len(a), len(b)
        for o in reversed(ops):  # diagonally first, then from a, then from b
            ways = [i and j and cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == cost[i][j], i and cost[i - 1][j] + 1 == cost[i][j]]
            assert o in ("MX" if ways[0] else "D" if ways[1] else "I")
            i, j = i - (o != "I"), j - (o != "D")
    long = "".join(rnd.choice("abcd") for _ in range(5000))
    assert alignment.cigar(alignment.operations(long, long[:2500] + "x" + long[2500:])) == "2500M1I2500M"


def test_edit_scripts():
    assert [alignment.script(a, b, alignment.operations(a, b)) for a, b in (("ACGT", "ACGT"), ("ACGT", "AGGT"), ("ACGT", "AGT"), ("AGT", "ACGT"))] == ["", "1 C", "1 c", "1 D"]


def test_edit_script_costs_the_distance(spark):
    from motifmill.jobs.catalogue import QUERIES

    for r in QUERIES["edit_script"](spark, "/root/testdata/sf0.001").collect():
        assert sum(o != "M" for o in r["ops"]) == r["distance"]


def test_select_next_and_greedy(spark):
    rows = spark.createDataFrame([(i, int(i in (2, 5))) for i in range(8)], "k int, b int")
    got = {r["pos"]: r["next"] for r in ranks.select_next(ranks.bit_ranks(rows, ["k"], F.col("b"))).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 5, 4: 5, 5: 5, 6: None, 7: None}
    assert {r["pos"]: r["next"] for r in ranks.select_next(ranks.bit_ranks(rows, ["k"], F.col("b")), 0).collect()}[2] == 3


def test_running_numbers_keep_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i, i) for i in range(9)], "k int, __part int, __n int")
    got = with_running(rows, ["k"], "pos").orderBy("k").collect()
    assert [(r["__part"], r["__n"], r["pos"]) for r in got] == [(i, i, i) for i in range(9)]


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = [("a", "ACGTACG"), ("b", "GATTACA"), ("a", "TTTT")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "sample string, seq string").write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("sample string, seq string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), 3).awaitTermination()
    got = {(r["sample"], r["path"]): r["freq"] for r in incremental.current(spark, str(tmp_path / "out"), 2).collect()}
    want = {(r["sample"], r["path"]): r["freq"] for r in mining.nodes(spark.createDataFrame(rows, "sample string, seq string"), 2, 3).collect()}
    assert got == want


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

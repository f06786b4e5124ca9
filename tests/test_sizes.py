"""What shows only on larger tables: totals beyond 32 bits, rows on a threshold, joins whose sides grow."""

import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from motifmill.jobs.oracle import BUCKETS
from motifmill.operators import alignment, intervals, matrices, mining, ordering, ranks, suffixes, text
from motifmill.operators.ordering import stored
from motifmill.sources import formats


def test_systematic_positions_beyond_32_bits(spark):
    weights = [0, 900_000_000, 3, 1_100_000_000, 1 << 40, 1]
    rows = spark.createDataFrame(list(enumerate(weights)), "doc_id long, weight long")
    total, upto, want = sum(weights), 0, []
    for k, w in enumerate(weights):
        want += [(d, k) for d in range(100) if 200 * upto < (2 * d + 1) * total <= 200 * (upto + w)]
        upto += w
    for rest in (rows, rows.where("doc_id < 4")):  # sums beyond and below 2^31, where twice the sum is not
        got = sorted(tuple(r) for r in ranks.systematic_positions(rest, ["doc_id"], "weight", 100).collect())
        assert len(got) == 100
        assert got == want or rest is not rows
    assert ranks.systematic_positions(rows.where("weight = 0"), ["doc_id"], "weight", 100).count() == 0


def test_even_rows_fall_on_the_threshold_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("create table events as select f as user_id, 's' || e as event_type from range(1, 200) t(f), range(5) u(e), range(200) v(i) where i < f")
    want = dict(con.sql(f"WITH {BUCKETS} SELECT row_id, max_entropy FROM bucketed").fetchall())
    rows = spark.createDataFrame([(f, f"s{e}", f) for f in range(1, 200) for e in range(5)], "row_id long, sample string, freq long")
    got = matrices.row_entropy(rows, 5).select("row_id", matrices.bucket(F.col("entropy"), [0.9, 0.97, 0.98, 0.99, 0.995, 1.0]).alias("b"))
    assert {r["row_id"]: r["b"] for r in got.collect()} == want
    one = matrices.row_entropy(rows.where("sample = 's0'"), 1).first()
    assert math.isnan(one["entropy"])


def test_found_places_are_not_gathered_on_the_driver(spark):
    texts = spark.createDataFrame([(k, "the cat sat on the mat " * 400) for k in range(4)], "k long, text string")
    found = suffixes.find(texts, spark.createDataFrame([("the",), ("at",)], "pattern string"), ["k"])
    got = found.occurrences()
    assert "BroadcastHashJoin [sa_rank" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.groupBy("pattern").count().orderBy("pattern").collect() == [("at", 4 * 1200), ("the", 4 * 800)]
    assert found.order.count() <= 4 * 2000 + 4  # of 4 * 9201 suffixes those that begin with a pattern


def test_long_patterns_among_near_misses(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(n)) for n in (31, 32, 33, 40, 64, 65, 97, 130)]
    mixed = [p[:k] + q for p in parts for q in parts for k in (20, 32, 40, 64, 96)]
    rows = [(k, "".join(rng.choice(parts + mixed) for _ in range(8)) + "é\U0010ffff") for k in range(12)]
    pats = parts + mixed + ["é", "a", "b\U0010ffff", "é\U0010ffff", parts[7] + parts[6]]
    found = suffixes.find(spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame([(p,) for p in pats], "pattern string"), ["k"])
    want = sorted((p, k, i) for p in set(pats) for k, t in rows for i in range(len(t)) if t.startswith(p, i))
    assert sorted(tuple(r) for r in found.occurrences().collect()) == want
    assert {r["pattern"]: r["n"] for r in found.bounds.where("n > 0").collect()} == Counter(p for p, _, _ in want)


def test_patterns_of_whole_grams_before_anything(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    pats = [word(n) for n in (32, 64, 96, 256)]
    pats += [pats[1] + word(32), pats[3][:32] + word(9)]
    after = ["", "q" * 70, "\0", "\U0010ffff", "\U0010ffffq", word(50)]
    rows = list(enumerate(before + p + a for before in ("", "xyz") for p in pats for a in after))
    want = sorted((p, k, i) for p in pats for k, t in rows for i in range(len(t)) if t.startswith(p, i))
    texts = spark.createDataFrame(rows, "k long, text string")
    for some in (pats, pats[:1], pats[5:]):  # with ends of patterns among the suffixes that are sorted, with one, without any
        found = suffixes.find(texts, spark.createDataFrame([(p,) for p in some], "pattern string"), ["k"])
        assert sorted(tuple(r) for r in found.occurrences().collect()) == [w for w in want if w[0] in some]


def test_equal_runs_are_ordered_once(spark, monkeypatch):
    seen = []
    whole = intervals.suffix_rows
    monkeypatch.setattr(intervals, "suffix_rows", lambda texts, *a, **k: seen.append(texts.count()) or whole(texts, *a, **k))
    docs = [("x", "ACGTNACGTNGGACTNACGTN" * 50), ("y", "ACNACNTTNT" * 3), ("y", "ACGT"), (None, "ACG"), ("z", "AC")]
    got = mining.deep_nodes(spark.createDataFrame(docs, "sample string, seq string"), 3)
    turn = str.maketrans("ACGT", "TGCA")
    want, left = Counter(), {}
    for sample, text in docs:
        for run in [r for part in text.split("N") if part and sample for r in (part, part[::-1].translate(turn))]:
            for i in range(len(run)):
                for j in range(i + 1, len(run) + 1):
                    want[sample, run[i:j]] += 1
                    left.setdefault((sample, run[i:j]), set()).add(run[i - 1] if i else "0")
    want = {(*k, n, "".join(left[k]) if len(left[k]) == 1 else "N") for k, n in want.items() if n >= 3}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert seen == [3 + 9 + 2]  # of some 430 runs and their complements


def test_documents_of_nodes_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for k in range(30)] + [(7, None), (8, "abab")]
    nodes_, edges = intervals.document_graph(spark.createDataFrame(texts, "k long, text string"), ["k"], 10)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [sa_rank" not in plan
    found = {r["path"]: r["n_docs"] for r in nodes_.collect()}
    want = sorted((p, k) for p in found for k, t in texts if t and p in t)
    assert sorted(tuple(r) for r in edges.collect()) == want
    assert len(want) == sum(found.values())


def test_short_pairs_together_equal_single_ones(monkeypatch):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pairs = [(word(rng.randrange(30)), word(rng.randrange(30))) for _ in range(300)]
    odd = [(None, "a"), ("a", None), ("", ""), ("a\0", "\0a"), ("a\0\0", "a"), ("", "\0"), ("é\U0010ffff", "\ud800é"), (word(200), word(150)), ("a", word(9000))]
    single = alignment.operations
    want = [None if None in p else single(*p) for p in pairs + odd]
    monkeypatch.setattr(alignment, "operations", lambda a, b: single(a, b) if len(a) * len(b) > 20_000 else pytest.fail("a short pair by itself"))
    monkeypatch.setattr(alignment, "CELLS", 20_000)
    assert alignment.all_operations(*map(list, zip(*pairs, *odd[:8], strict=True))) == want[:308]
    monkeypatch.setattr(alignment, "operations", single)
    assert alignment.all_operations(*map(list, zip(*pairs, *odd, strict=True))) == want
    assert alignment.all_operations([], []) == []


def test_fixed_width_writer_holds_bytes_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(formats, "FILE_ROWS", 100_000)
    writer = formats.FixedWidthWriter({"path": str(tmp_path), "length": "18"}, False)
    tracemalloc.start()
    done = writer.write(Row(f"{k:018d}") for k in range(250_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # a file has 1.8 million bytes
    writer.commit([done])
    lines = [p.read_bytes().split(b"\n", 1) for p in sorted(tmp_path.iterdir())]
    assert [head for head, _ in lines] == [b"# number=%d length=18" % n for n in (100_000, 100_000, 50_000)]
    assert b"".join(body for _, body in lines) == b"".join(b"%018d" % k for k in range(250_000))


def test_later_rounds_take_only_what_they_ask_for(spark, monkeypatch):
    seen, met = [], []
    groups, asked_for = suffixes.in_groups, suffixes._asked_for
    monkeypatch.setattr(suffixes, "in_groups", lambda df, *a, **k: seen.append(df.columns) or groups(df, *a, **k))
    monkeypatch.setattr(suffixes, "_asked_for", lambda known, asked: met.append((known.count(), asked_for(known, asked).count(), asked.count())) or asked_for(known, asked))
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé日\U0010ffff") for _ in range(n))
    long = word(300)
    texts = [(k, word(400)) for k in range(30)] + [(30, long), (31, word(3) + long + "a"), (32, ""), (33, None)]
    order, named = suffixes.named_order(spark.createDataFrame(texts, "k int, text string"), ["k"], kept=[])
    got = suffixes.with_keys(order.select("tid", "g", "sa_rank"), named, ["k"]).orderBy("sa_rank").select("k", "pos").collect()
    want = sorted((t[i:], k, i) for k, t in texts if t is not None for i in range(len(t) + 1))
    assert [tuple(r) for r in got] == [w[1:] for w in want]
    assert set(seen[0]) == {"g", "tid", "gram"}  # nothing else is carried
    assert len(met) == 2  # after 128 characters, and after 256
    assert all(asked <= some < asked + 100 < known for known, some, asked in met)


def test_merging_sorts_on_only_where_new_suffixes_are(spark, monkeypatch):
    seen = []
    groups = suffixes.in_groups
    monkeypatch.setattr(suffixes, "in_groups", lambda df, *a, **k: seen.append(df) or groups(df, *a, **k))
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    old, both = word(300), word(50)
    texts = [(0, old), (1, "x" + old + "é"), (2, both), (3, "y" + both), (4, old[9:]), (5, ""), (6, "z" + both), (7, both)]
    frame = spark.createDataFrame(texts, "k int, text string")
    order, named = suffixes.named_order(frame.where("k < 6"), ["k"], kept=[])
    del seen[:]
    order, named = suffixes.merged_order(order.select("g", "sa_rank"), named, frame.where("k >= 6"), ["k"], kept=["before"])
    got = suffixes.with_keys(order.select("tid", "g", "sa_rank", "before"), named, ["k"]).orderBy("sa_rank").select("k", "pos", "before").collect()
    want = sorted((t[i:], k, i, t[i - 1] if i else "") for k, t in texts for i in range(len(t) + 1))
    assert [tuple(r) for r in got] == [w[1:] for w in want]
    assert [df.count() for df in seen] == [len(want), 4 * 19]  # 19 suffixes of each copy have 32 characters or more


def test_own_orders_are_made_where_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CUT", 60)
    rng = random.Random(8)
    texts = [(k, "".join(rng.choice("ab\x00é\U0010ffff") for _ in range(rng.choice([0, 1, 5, 30, 200])))) for k in range(40)] + [(3, "aaaa"), (50, "a" * 130), (51, "ab" * 70), (52, None)]
    got = suffixes.own_orders(spark.createDataFrame(texts, "k long, text string").repartition(3), ["k"])
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(k, i, n) for k, t in texts if t is not None for n, i in enumerate(sorted(range(len(t) + 1), key=lambda i: t[i:]))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_runs_go_on_over_blocks_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(text, "RANKS", 4, raising=False)
    rng = random.Random(4)
    for n in (0, 1, 4, 5, 203):
        column = [rng.choice(["", "a", "a", "a", "b"]) for _ in range(n)]
        rows = spark.createDataFrame(list(enumerate(column)), "sa_rank long, before string")
        got = text.bwt_runs(rows)
        assert dict(got.collect()) == Counter(c for k, c in enumerate(column) if c and (not k or column[k - 1] != c))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" in plan  # only the ranks at blocks' ends are joined


def test_corners_are_counted_by_the_order_alone(spark, monkeypatch):
    seen = []
    running = ranks.with_running
    monkeypatch.setattr(ranks, "with_running", lambda df, order, *a, **k: seen.append((df.count(), len(a) > 1 or bool(k))) or running(df, order, *a, **k))
    rng = random.Random(6)
    symbols = [rng.randrange(9) for _ in range(500)]
    sides = [(i, *(rng.randrange(500) for _ in range(2)), *(rng.randrange(9) for _ in range(2))) for i in range(5)]
    placed = spark.createDataFrame(list(enumerate(symbols)), "pos long, c long")
    got = dict(ranks.rectangle_counts(placed, "c", spark.createDataFrame(sides, "name int, low int, high int, least int, most int")).collect())
    assert got == {i: sum(lo <= p <= hi and a <= c <= b for p, c in enumerate(symbols)) for i, lo, hi, a, b in sides}
    assert not any(sums for _, sums in seen)  # no second shuffle for sums over all rows
    assert seen[1][0] == seen[0][0] - 4 * 500  # which the corners alone are numbered for


def test_places_are_not_sent_to_all(spark):
    symbols = "aabbbacaabb"
    placed = stored(spark.createDataFrame(list(enumerate(symbols)), "pos long, c string"), "sequence")
    bits = stored(ranks.bit_ranks(placed.select(F.col("pos").alias("at"), "c"), ["at"], F.col("c") == "b").select("pos", "bit", "rank1"), "bits")
    held = stored(ranks.symbol_ranks(placed.select(F.col("pos").alias("at"), "c"), ["at"], "c").select("pos", "c", "sym_rank"), "symbols")
    runs = ranks.run_lengths(placed, "c")
    for got in (runs, ranks.select_next(bits), ranks.value_before(bits), ranks.symbol_next(held, "c")):
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in runs.orderBy("run").collect()] == [(1, "a", 0, 2), (2, "b", 2, 3), (3, "a", 5, 1), (4, "c", 6, 1), (5, "a", 7, 2), (6, "b", 9, 2)]
    assert [r["next"] for r in ranks.select_next(bits).orderBy("pos").collect()] == [2, 2, 2, 3, 4, 9, 9, 9, 9, 9, 10]


def test_common_prefixes_and_nodes_are_not_sent_to_all(spark, monkeypatch):
    joined = set()

    def seen(df):
        joined.update(re.findall(r"BroadcastHashJoin \[(?:cast\()?(\w+)#", df._jdf.queryExecution().executedPlan().toString()))
        return df

    for module in (suffixes, intervals, ordering):
        monkeypatch.setattr(module, "stored", lambda df, what, whole=module.stored: whole(seen(df), what))
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    long = word(500)
    texts = [(k, word(50)) for k in range(9)] + [(9, long), (10, "c" + long), (11, long[20:] + "d")]
    frame = spark.createDataFrame(texts, "k long, text string")
    got = seen(suffixes.common_prefixes(*suffixes.named_order(frame, ["k"], common=True)).select("sa_rank", "lcp"))
    order = sorted((t[i:], k) for k, t in texts for i in range(len(t) + 1))
    shared = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [r["lcp"] for r in got.orderBy("sa_rank").collect()] == [0, *(shared(a[0], b[0]) for a, b in zip(order, order[1:]))]
    found, edges = map(seen, intervals.document_graph(frame, ["k"], 5))
    assert edges.count() == sum(r["n_docs"] for r in found.collect())
    assert joined <= {"part", "word", "__part"}  # a row for a partition or for 64 bits of a field

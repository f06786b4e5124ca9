"""Periodic runs, url rules and hard negatives against brute force and on odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.llm import hard_negatives, periodic_runs, queries, url_rules

from .test_dedup import odd_docs


def brute_runs(x, least=6, periods=4):
    """(start, end, smallest period) by trying every period at every place."""
    n, out = len(x), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for least, periods in ((6, 4), (1, 3), (20, 5)):
        for _ in range(150):
            seqs = []
            for _ in range(rnd.randint(1, 5)):
                letters = rnd.choice([1, 2, 3, 50])
                own = [rnd.randrange(letters) for _ in range(rnd.choice([0, 1, 5, 30, 120]))]
                unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 25))]
                seqs.append(own + (unit * 12)[: rnd.randint(0, 12 * len(unit))])
            ends = np.cumsum([len(s) for s in seqs])
            got = periodic_runs.runs_of(np.array(sum(seqs, []), np.int64), np.repeat(ends, [len(s) for s in seqs]), least, periods)
            want = [(s + e - len(x), t + e - len(x), q) for x, e in zip(seqs, ends.tolist()) for s, t, q in brute_runs(x, least, periods)]
            assert list(map(tuple, got.tolist())) == sorted(want)


def test_transform_is_an_exact_correlation():
    rnd = np.random.default_rng(3)
    for block in (1, 2, 8, 64):
        x = rnd.integers(0, 3, 20 * block).astype(np.uint64)
        x[4 * block : 5 * block] = x[5 * block + block // 2 : 6 * block + block // 2]
        padded = np.concatenate((x, np.zeros(4 * block, np.uint64)))
        squares = np.concatenate((np.zeros(1, np.uint64), np.cumsum(padded * padded)))
        starts = np.arange(0, 17 * block, block)
        d, which = periodic_runs.zero_mismatches(padded, squares, starts, block)
        want = {(t, k) for k, s in enumerate(starts.tolist()) for t in range(block, 2 * block) if (x[s : s + block] == x[s + t : s + t + block]).all()}
        assert set(zip(d.tolist(), which.tolist())) == want
    long = np.zeros(60_000, np.int64)  # one word again and again: one run, not one for each multiple
    assert periodic_runs.runs_of(long, np.full(60_000, 60_000)).tolist() == [[0, 60_000, 1]]


def contract_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [(s, e - s, q) for s, e, q in brute_runs(words)]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = (None,) * 4
    if runs:
        s, m, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = (s, m, q, 1000 * m // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("ab c D é 日本 x\x0by".split(" ")) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "x " * 500), (None, "a b " * 20), (1003, "x " * 500), (1004, "Ab ab " * 9 + "\x1c\x85 " * 8), (1005, "word " * 4000 + "end " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((contract_row(i, t) for i, t in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 20


def test_periodic_runs_on_odd_tables(spark):
    docs, rows = odd_docs(spark)
    docs = docs.withColumn("runs", F.lit(1)).withColumn("BEST", F.lit("b"))
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == [*docs.columns, "n_words", "_runs", "_best", "collapsed"]
    assert got.count() == len(rows) and periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, np.int64), np.full(9, 9), periods=2)


def judged(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), h + p, v))
    return host, path, best and best[1], best[2] if best else default


RULE = "host string, path string, verdict string"


def test_url_rules_equal_brute_force(spark):
    rnd = random.Random(3)
    labels, parts = ["a", "b", "com", "x-y", "é", ""], ["/", "/en", "/en/", "/enx", "/é/", "", "/en/a/b"]
    host = lambda k: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, k)))
    rules = list({(h, p): (h, p, rnd.choice(("allow", "block"))) for h, p in ((host(3), rnd.choice(parts)) for _ in range(120))}.values())
    urls = [f"{rnd.choice(('http', 'HTTPS', ''))}://{host(5).upper() if rnd.random() < 0.3 else host(5)}{rnd.choice(parts)}{rnd.choice(('', 'q/r', '?x=/en/', '#://a/en', '\n/en'))}" for _ in range(800)]
    urls += [None, "", "no scheme", "://", "http://", "x://y://com/en/", "http://com" + "/en" * 20_000, "http://" + "a." * 5_000 + "com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h"), (3, urls[3], "h")], "page_id long, url string, HOST string")
    for some in (rules, [], [("", "", "block")], [("com", None, "block"), ("COM", "", "allow"), (None, "/en/", "block")]):
        got = url_rules.judge_urls(pages, spark.createDataFrame(some, RULE))
        assert got.columns == ["page_id", "url", "HOST", "_host", "path", "rule", "verdict"]
        merged = {}
        for h, p, v in some:  # the block counts
            k = ((h or "").lower(), p or "")
            merged[k] = max(merged.get(k, ""), v)
        flat = [(h, p, v) for (h, p), v in merged.items()]
        rows = got.collect()
        assert len(rows) == len(urls) + 2
        for r in rows:
            assert (r["_host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], flat)
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, RULE)).count() == 0


def test_url_rules_where_ranges_split_nested_rules(spark):
    """Many keys below one rule: the rule is open where later ranges begin."""
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('http://h', id % 7, '.com/en/', lpad(id, 6, '0')) as url")
    rules = [("com", "/en/", "block"), ("com", "/en/" + "0" * 30, "allow"), ("h3.com", "/en/01", "allow"), ("com", "/en/015", "allow")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = url_rules.judge_urls(pages, spark.createDataFrame(rules, RULE)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 20_000
    assert all((r["rule"], r["verdict"]) == judged(r["url"], rules)[2:] for r in got)


def brute_negatives(rows, positives=5, negatives=10):
    fine = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in fine:
        if a % 100:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))  # noqa: B023, E731
        same = sorted((-score(v), i) for i, lab, v in fine if lab == la and i != a)[:positives]
        other = sorted((-score(v), i) for i, lab, v in fine if lab != la and i != a)
        for s, i in same:
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate([(t, j) for t, j in other if 30 * -s <= 100 * -t <= 90 * -s][:negatives])]
    return sorted(out)


def test_four_russians_scores_are_exact():
    rnd = np.random.default_rng(2)
    for dims in (1, 7, 8, 20):
        for most in (1, 300, hard_negatives.LARGEST - 1):
            a, x = rnd.integers(-most, most + 1, (70, dims)), rnd.integers(-most, most + 1, (50, dims))
            x[0], x[1] = most, -most
            planes = hard_negatives.packed_planes(x)
            for step, got in hard_negatives.scored(a, planes):
                assert (got == x @ a[step].T).all()


def test_hard_negatives_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=12).round(2).tolist(), int(rnd.integers(0, 3))) for i in range(700)]
    rows += [(2000 + i, rows[5][1], i % 3) for i in range(40)]  # ties
    rows += [(900, None, 1), (901, [float("nan")] * 12, 1), (902, [None, 1.0], 1), (903, [1.0] * 12, None), (None, [1.0] * 12, 1), (1000, [float("inf")] * 12, 0), (1100, [0.0] * 12, 0), (1200, [], 1), (1201, [1.0, 2.0], 1), (1300, [-3e38] * 12, 1)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("k")).withColumn("score", F.lit(1))
    want = brute_negatives([(r["vec_id"], r["embedding"], r["label"]) for r in made.collect() if r["vec_id"] != 1300])
    for small in ({}, {"anchors_in_block": 3, "slice_rows": 100}):
        got = hard_negatives.hard_negatives(made.repartition(3), F.col("vec_id") % 100 == 0, F.col("label"), **small)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 100
    assert hard_negatives.hard_negatives(made.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    twice = hard_negatives.hard_negatives(made.where("vec_id < 300").unionByName(made.where("vec_id = 100")), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    once = hard_negatives.hard_negatives(made.where("vec_id < 300"), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    own = lambda rows: sorted(tuple(r)[1:] for r in rows if r["anchor_id"] == 100)
    assert own(twice) == sorted(own(once) * 2)

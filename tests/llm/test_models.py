"""Tokenising, packing, language models, quality and toxicity: round trips, brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motifmill.llm import bpe, ngram_filter, packing, quality, queries, toxicity

from ..conftest import DATA
from .test_dedup import odd_docs

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rnd = random.Random(1)
    made = ["", " ", "a  b", "x\n y", "aaaaaaaaa", "a" * 3000, "it's we'll 'tis 's", "\x1c a\x85b c 　 d", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>", "12 345 ½ ² ٣", "日本語 テスト", "🙂🙂", "ΑΣ ΣΑΣ", "İ I", "é ́x"]
    return made + ["".join(rnd.choice("ab '.\n\t1É<|") for _ in range(rnd.randint(1, 30))) for _ in range(500)]


def split(flat, counts):
    ends = np.cumsum(counts)
    return [flat[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_byte_bpe_equals_the_library():
    texts, library = odd_texts(), Tokenizer.from_file(BYTE)
    got = split(*bpe.encode_texts(bpe.vocabulary(BYTE), pa.array(texts)))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_word_bpe_equals_the_library():
    texts, library = odd_texts(), Tokenizer.from_file(WORD)
    got = split(*packing.word_coder(WORD).ids(pa.array(texts)))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_round_trip_of_odd_documents(spark):
    docs, rows = odd_docs(spark)
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    assert bpe.encode(docs.limit(0), BYTE).count() == 0


def brute_cost(ends, sentences, size):
    """(least cost, what a cut costs at each place) by looking at all windows."""
    step, places = max(1, size // (2 * packing.LONG)), sorted({0, *ends, *sentences})
    inner = {x for a, b in zip(places, places[1:]) if b - a > max(2 * step, size // packing.LONG) for x in range(a + step, b, step)}
    at = sorted({*places, *inner})
    price = {x: 0 if x in ends else packing.SENTENCE_CUT if x in sentences else packing.INNER_CUT for x in at}
    cost = {0: 0}
    for j, x in enumerate(at[1:], 1):
        ways = [cost[y] + size + (0 if (x - y) & (x - y - 1) == 0 else size - (x - y)) for y in at[:j] if x - y <= size and y in cost]
        if ways:
            cost[x] = min(ways) + price[x]
    return cost[at[-1]], price


@pytest.mark.parametrize("size", [16, 512])
def test_cuts_are_optimal(size):
    rnd = random.Random(2)
    for _ in range(200 if size == 16 else 20):
        ends = np.cumsum([rnd.randint(1, size // 2) for _ in range(rnd.randint(1, 12))])
        sentences = np.unique([rnd.randint(1, int(ends[-1])) for _ in range(5)])
        cuts = packing.best_cuts(ends, sentences, size)
        best, price = brute_cost(set(ends.tolist()), set(sentences.tolist()), size)
        assert sum(size + (0 if (b - a) & (b - a - 1) == 0 else size - (b - a)) + price[b] for a, b in zip(cuts, cuts[1:])) == best
        assert cuts[0] == 0 and cuts[-1] == ends[-1] and max(np.diff(cuts)) <= size
    assert packing.best_cuts(np.array([5000]), np.zeros(0, np.int64), 2048)[-1] == 5000


def test_packing_covers_every_id_once(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark)[0].select("doc_id", "text").where("doc_id > 2").withColumn("doc_id", F.col("doc_id") + 10_000).dropDuplicates(["doc_id"]))
    library, pieces = Tokenizer.from_file(WORD), packing.pack(docs, WORD).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_doc = dict(list(pieces.sort_values("start").groupby("doc_id")))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert own.start.tolist() == np.concatenate(([0], np.cumsum(own.length)[:-1])).astype(int).tolist()
        assert set(own.doc_tokens) == {len(ids)}
    padding, short = 0, 0
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        n = int(seq.length.sum())
        assert n <= 2048 and seq.offset.tolist() == np.concatenate(([0], np.cumsum(seq.length)[:-1])).astype(int).tolist()
        padding += 0 if n & (n - 1) == 0 else 2048 - n
        short += n < 64
    parts, ids = docs.rdd.getNumPartitions(), int(pieces.length.sum())
    assert pieces.sequence_id.nunique() <= 1.02 * ids / 2048 + parts and short <= parts
    assert padding <= 0.01 * ids + 2048 * parts
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_ngram_scores_beat_the_base_on_held_out_text(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rest = ngram_filter.remainder()
    model = ngram_filter.train(docs, rest != 2)
    got = ngram_filter.score(docs, model).toPandas()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.n_words) == (n, v)
    held = []
    for r in got.itertuples():
        own = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(own), sum(counts[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        if zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            held.append((r.score, r.base_score))
    assert sum(s for s, _ in held) > 0.95 * sum(b for _, b in held)
    assert all(s < 0 for s, _ in held)


def test_ngram_model_on_odd_and_empty_tables(spark):
    docs, rows = odd_docs(spark)
    rest = ngram_filter.remainder()
    got = ngram_filter.score(docs, ngram_filter.train(docs, rest != 2)).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    none = docs.limit(0)
    assert ngram_filter.score(none, ngram_filter.train(none, rest != 2)).count() == 0


def test_op6_finds_its_weights_on_all_training_texts(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 3]
    rnd = random.Random(15)
    docs = spark.createDataFrame([(i, " ".join(f"left{k} right{k}" for k in rnd.choices(range(50), k=20))) for i in ids], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_log_frequency_bloom(spark, str(tmp_path)).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    # every other word follows from the one before it: some 2 digits of about 2 are saved there
    assert got["score"] - got["base"] >= 0.6 * got["n"]


def test_quantised_counts_are_lower_levels(spark):
    text = "a b " * 37 + "c d"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = ngram_filter.train(docs, F.lit(True))
    code, doc, token, before = ngram_filter.tokens(pa.array([text]))
    two, three, inner = ngram_filter.ngram_keys(code, doc, token, before)
    _, level = model.lookup(code, np.concatenate((two, three[inner])))
    count = ngram_filter.FLOOR[level]
    assert count[1] == 32 and count[0] == 1 and count[len(two) - 1] == 1 and count[len(two) + 1] == 32
    assert (ngram_filter.FLOOR[1:] <= ngram_filter.CEILING[1:]).all() and (ngram_filter.CEILING[1:-1] == ngram_filter.FLOOR[2:] - 1).all()


def test_ngram_scores_equal_exact_counts_and_add_up_to_one(spark):
    rnd = random.Random(21)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.randint(2, 12)]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_filter.train(docs, F.lit(True))
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        ids = [*t.split(), "END"]
        one.update(ids)
        two.update(zip(["START", *ids], ids))
        three.update(zip(["START", *ids], ids, ids[1:]))
    low = lambda c: max((x for x in ngram_filter.LEVELS.tolist() if x <= c), default=0)
    high = lambda c: int(ngram_filter.CEILING[np.searchsorted(ngram_filter.LEVELS, c, side="right")])
    kind = lambda c: 0 if not c else min(1 + int(math.log2(c)), ngram_filter.CLASSES - 1)

    def prob(word, last, before_last):
        base = (one[word] + 1) / (model.n_tokens + model.n_words + 1)
        c = len(texts) if last == "START" else one[last]
        p, w = (min(low(two[last, word]), c) / c if c else 0), model.two[kind(c)]
        mixed = w * p + (1 - w) * base
        wide = high(two[before_last, last]) if before_last else 0
        p, w = (min(low(three[before_last, last, word]), wide) / wide if wide else 0), model.three[kind(wide)]
        return w * p + (1 - w) * mixed

    got = {r["doc_id"]: r["score"] for r in ngram_filter.score(docs, model).collect()}
    for i, t in enumerate(texts):
        ids = ["START", *t.split(), "END"]
        want = sum(math.log10(prob(w, ids[k], ids[k - 1] if k else None)) for k, w in enumerate(ids[1:]))
        assert got[i] == pytest.approx(want, rel=1e-9)
    for a in [None, "START", *vocabulary]:
        for b in vocabulary:
            assert sum(prob(w, b, a) for w in [*vocabulary, "END"]) <= 1 + 1e-9


def test_kneser_ney_sums_to_one_and_separates(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    _, log_prob = quality.train(docs.select("text"))
    assert np.allclose((10.0 ** log_prob.astype(float)).reshape(-1, quality.ALPHABET).sum(1), 1, atol=1e-4)
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.97
    assert got[got.quality == 0].keep.mean() <= 0.2
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_kneser_ney_equals_brute_force(spark):
    rnd = random.Random(23)
    texts = ["abab, abc.", "Aab ba 12", "cab", "", *("".join(rnd.choice("abc d.") for _ in range(40)) for _ in range(8))]
    table, log_prob = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    size, order = quality.ALPHABET, quality.ORDER
    codes = [(quality.BREAK,) * (order - 1) + tuple(int(table[ord(c)]) for c in t) + (quality.BREAK,) for t in texts]
    counts = {order: Counter(c[i : i + order] for c in codes for i in range(len(c) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # continuations
    cuts, totals, left = {}, {}, {}
    for n, own in counts.items():
        k = [max(1, sum(v == i for v in own.values())) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        cuts[n] = [0, *(min(max(d, 0.1), top) for d, top in ((1 - 2 * y * k[1] / k[0], 0.95), (2 - 3 * y * k[2] / k[1], 1.9), (3 - 4 * y * k[3] / k[2], 2.9)))]
        totals[n], left[n] = Counter(), Counter()
        for g, v in own.items():
            totals[n][g[:-1]] += v
            left[n][g[:-1]] += cuts[n][min(v, 3)]

    def prob(g):
        n = len(g)
        if not n:
            return 1 / size
        total, v = totals[n][g[:-1]], counts[n][g]
        return (v - cuts[n][min(v, 3)] + left[n][g[:-1]] * prob(g[1:])) / total if total else prob(g[1:])

    some = [*counts[order], *(tuple(rnd.choice(list(g)) if rnd.random() < 0.8 else rnd.randrange(size) for _ in g) for g in counts[order] for _ in range(3))]
    for g in some:
        at = 0
        for c in g:
            at = at * size + c
        assert 10 ** float(log_prob[at]) == pytest.approx(prob(g), rel=1e-5)


def test_quality_on_odd_and_empty_tables(spark):
    docs, rows = odd_docs(spark)
    labels = spark.createDataFrame([(6, 1), (4, 1), (None, 1), (9, 0), (7, None)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == len(rows)
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == len(rows)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs.select("doc_id", "text").join(labels.where(toxicity.held_out()), "doc_id"), model).toPandas()
    hit = got.score >= toxicity.CUT
    assert (hit & (got.toxic == 1)).sum() >= 0.85 * (got.toxic == 1).sum()
    assert (hit & (got.toxic == 0)).sum() <= 0.01 * (got.toxic == 0).sum()


def test_toxicity_on_odd_and_empty_tables(spark):
    docs, rows = odd_docs(spark)
    labels = spark.createDataFrame([(6, 1), (4, 0), (None, 1), (9, None), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "_score"]
    assert scored.where("_score between 0 and 1").count() == len(rows)
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.keep_clean(docs, none).count() == len(rows)


def test_label_model_finds_accuracies_and_mends_wrong_labels():
    rnd = np.random.default_rng(3)
    truth = rnd.random(4000) < 0.2
    accuracy = np.array([0.95, 0.8, 0.7, 0.55])
    votes = np.where(rnd.random((4000, 4)) < accuracy, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes = np.concatenate((votes, votes[:, [1]]), 1).astype(np.int8)  # a voter that repeats another
    for wrong in (0.03, 0.2):
        given = np.where(rnd.random(4000) < wrong, ~truth, truth).astype(int)
        post, prob, corr = toxicity.label_model(votes, given)
        assert ((post > 0.5) != truth).mean() < 0.5 * (given != truth).mean()
        assert np.allclose(prob[1][:4, 2], accuracy, atol=0.1)
        assert corr[1, 4] > 0.99


def test_wrong_toxicity_labels_are_mended(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    wrong = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("x"))) % 10 == 0
    mixed = labels.where(~toxicity.held_out()).withColumn("truth", F.col("toxic")).withColumn("toxic", F.when(wrong, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    # the truth rides along as the text's weight
    truth = {r["text"]: r["truth"] for r in docs.join(mixed, "doc_id").select("text", "truth").collect()}
    kept = toxicity.training_rows(docs, mixed)
    _, x = toxicity.learned_votes(kept)
    post, _, _ = toxicity.label_model(x["votes"], x["label"])
    given = [r["label"] for r in kept.select("label").collect()]
    assert given == x["label"].tolist()
    right = np.array([truth[r["text"]] for r in kept.select("text").collect()])
    assert ((post > 0.5) != right).mean() < 0.5 * (x["label"] != right).mean()


def test_label_model_keeps_both_classes_where_voters_agree():
    rnd = np.random.default_rng(4)
    truth = rnd.random(5000) < 0.12
    strong = np.where(truth[:, None] & (rnd.random((5000, 16)) < 0.8), 1, np.where(truth, 0, -1)[:, None])
    idle = np.full((5000, 24), -1)  # voters whose lexicon is empty
    post, _, _ = toxicity.label_model(np.concatenate((strong, idle), 1).astype(np.int8), truth.astype(int))
    assert ((post > 0.5) == truth).mean() > 0.999


def test_quality_leaves_toxic_texts_to_the_toxicity_stage(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    model = toxicity.train(good, labels.where(~toxicity.held_out()))
    left = toxicity.keep_clean(good, model).join(labels, "doc_id").select("toxic").toPandas().toxic
    told = good.join(labels, "doc_id").select("toxic").toPandas().toxic
    assert left.sum() <= 0.1 * told.sum() and (left == 0).sum() >= 0.99 * (told == 0).sum()


def test_no_labelled_text_is_lost(spark):
    rows = [(i, f"word{i}" if i % 2 else f"word{i} more") for i in range(100)] + [(200, None), (201, ""), (202, "the same text here and on"), (203, "the same text here and on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i, _ in rows], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got = toxicity.training_rows(docs, labels).collect()
    assert len(got) == len(rows)
    assert sum(r["weight"] == 1 for r in got if (r["text"] or "").startswith("word")) == 100
    assert [r["weight"] for r in got if (r["text"] or "").startswith("the same")] == [0.5, 0.5]


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.stored(stage(spark, rows, f"{DATA}/sf0.01"), name)
        assert rows.columns == docs.columns
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    assert 400 < rows.count() < 1000
    good = labels.where("quality = 1 and toxic = 0").join(rows, "doc_id", "left_semi").count()
    assert good >= 0.85 * labels.where("quality = 1 and toxic = 0").count()
    assert labels.where("toxic = 1").join(rows, "doc_id", "left_semi").count() <= 0.25 * labels.where("toxic = 1").count()
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.01").select("doc_id").distinct().count() == rows.count()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, rows = odd_docs(spark)
    labels = spark.createDataFrame([(6, 1, 0), (4, 1, 1), (None, 1, 0), (9, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for name, some, told in (("odd", docs, labels), ("empty", docs.limit(0), labels.limit(0)), ("unlabelled", docs, labels.limit(0))):
        folder = f"{tmp_path}/{name}"
        some.write.parquet(f"{folder}/documents.parquet")
        told.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        ids = {r["doc_id"] for r in got}
        assert ids <= {i for i, _ in rows} and (len(ids) >= 3 or name != "unlabelled") and (not ids or name != "empty")
        for i in ids - {None, 2}:
            own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
            assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]

"""Near-duplicates, repeated strings and paragraphs, and vectors against brute force and on odd inputs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers

from motifmill.llm import bpe, hnsw, paragraph_minhash, quality, simhash, spotsigs, suffix_dedup, toxicity
from motifmill.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, kept string, spans int, ROOT int, score string, perplexity double"


def odd_docs(spark):
    words = "the quick brown fox jumps over the lazy dog and runs to the hills".split()
    long = " ".join(random.Random(5).choice(words) + str(i % 97) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, long), (7, long), (7, long), (8, "é" * 120), (9, "é" * 120 + "x"), (None, long), (10, "\U0001f642   a\x00b"), (2, "same id, other text " * 9)]
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", 2, 3, "s", 0.5) for i, t in rows], SCHEMA), rows


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(rnd.randint(400, 600), rnd.randint(400, 600)) for _ in range(150)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b").collect()}
    linked = [(a, b) for a, b in edges if a != b]
    assert got == union(linked, {x for e in linked for x in e})
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_on_odd_documents(spark):
    docs, rows = odd_docs(spark)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    prints = {(i, t): brute_fingerprint(t) for i, t in rows}
    by_text = {(i, brute_fingerprint(t)) for i, t in rows}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == by_text
    nodes = set(prints.values())
    roots = union([(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 2], nodes)
    for r in got:
        same = [i for (i, _), p in prints.items() if roots[p] == roots[int(r["fingerprint"], 16)] and i is not None]
        assert r["component_id"] == (min(same) if same else None)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["root"]: r["component_id"] for r in got if r["component_id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(groups.values())
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_ball_links_reach_what_pairs_reach(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(6)} | set(base)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = union([(a, b) for a in signed for b in signed if a < b and apart(a, b) <= 2], signed)
    assert {n: got.get(n, n) for n in signed} == want


def brute_removal(rows, length=50):
    first = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - length + 1):
                w = t[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1 if d is not None else 0):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1, 5, suffix_dedup.CROWD])
def test_repeated_bytes_on_planted_texts(spark, crowd):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [text(rnd.randint(40, 90)) for _ in range(6)]
    rows = [(rnd.randint(0, 25), text(rnd.randint(0, 80)) + rnd.choice(passages) + text(5) + rnd.choice(passages)) for _ in range(40)]
    rows += [(50, "ab" * 60), (51, "ab" * 60), (52, "x" + "ab" * 100), (53, None), (54, ""), (None, passages[0] * 2), (3, rows[5][1]), (60, rows[5][1]), (60, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.without_repeats(docs, crowd=crowd).collect()
    have = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str)
    assert have == brute_removal([(d, (t or "").encode()) for d, t in rows])


def test_repeated_bytes_on_odd_documents(spark):
    docs, rows = odd_docs(spark)
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == [*docs.columns, "_kept", "n_bytes", "n_removed", "_spans"]
    assert got.count() == len(rows)
    again = suffix_dedup.texts_without_repeats(docs)
    assert again.columns == docs.columns
    out = again.collect()
    assert {r["text"] for r in out if r["doc_id"] == 7} == {""} and sum(r["text"] is None for r in out) == 1
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in out)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n, divided", [(24, False), (120, True)])
def test_common_passages_are_sorted_again_only_where_keys_are_divided(spark, n, divided):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = text(120)
    rows = [(i, text(60) + common + text(60)) for i in range(n)]
    docs = suffix_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    anchors = suffix_dedup.repeated_anchors(docs)
    assert anchors.agg({"n": "max"}).first()[0] == n
    found = suffix_dedup.contexts(docs, suffix_dedup.anchor_filter(anchors, 1, 5))
    assert found.agg({"parts": "max"}).first()[0] == (suffix_dedup.PARTS if divided else 1)
    left = suffix_dedup.collapsed(found).where("ctx is not null").count()
    assert (left > 0) == divided


def test_deep_shallow_sort_orders_and_groups():
    rnd = random.Random(3)
    for _ in range(200):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 20))]
        data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        group = np.array([rnd.randint(0, 2) for _ in strings])
        order, new = suffix_dedup.deep_shallow_sort(data, np.cumsum(sizes) - sizes, sizes, group, rnd.choice([0, 8, 24]))
        have = [(group[i], strings[i]) for i in order]
        assert have == sorted(zip(group, strings))
        assert new.tolist() == [k == 0 or have[k] != have[k - 1] for k in range(len(have))]


def test_paragraphs_find_planted_passages(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(5, 9))).capitalize() + "."
    prose = lambda n: " ".join(sentence() for _ in range(n))
    line = prose(6)
    near = line.replace(line.split()[1], "changed", 1)
    inset = prose(14)
    rows = [(1, f"{prose(5)}\n{line}\n{prose(3)}"), (2, f"{line}\n{prose(4)}"), (3, f"{prose(2)}\n{near}"), (4, prose(8)), (5, f"{prose(3)} {inset} {prose(3)}"), (6, f"{prose(4)} {inset} {prose(2)}"), (7, None), (8, "")]
    got = paragraph_minhash.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append(r)
    lines = [c for c in classes.values() if {(x["doc_id"], x["kind"]) for x in c} >= {(1, "line"), (2, "line")}]
    assert len(lines) == 1 and (3, "line") in {(x["doc_id"], x["kind"]) for x in lines[0]}
    assert {x["doc_id"] for r in classes.values() for x in r} == {1, 2, 3, 5, 6}
    assert sum(r["size"] for r in got if r["doc_id"] == 6 and not r["kept"]) >= 50
    assert all(sum(x["kept"] for x in c) == 1 and all(x["class_size"] == len(c) for x in c) for c in classes.values())
    docs, _ = odd_docs(spark)
    assert {r["doc_id"] for r in paragraph_minhash.repeated_paragraphs(docs).collect()} >= {6, 7}
    assert paragraph_minhash.repeated_paragraphs(docs.limit(0)).count() == 0


def test_blocks_hold_all_words_of_their_line():
    rnd = random.Random(13)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 9) + rnd.choice(["", "", "", "", ".", '."', "!)"]) * rnd.randint(0, 1)
    made = [" ".join(word() if k % 2 else word().strip('.")!') for _ in range(rnd.randint(1, 200))) for k in range(300)]
    made += ["a " * 500, "", "\n\n", "x", "\n".join(made[:20])]
    code, doc, at, to, kind, _, _, _ = paragraph_minhash._paragraphs(pa.array(made))
    covered = np.zeros(len(code) + 1, int)
    for a, b in zip(at[kind == 1].tolist(), to[kind == 1].tolist()):
        assert 5 <= b - a < 24 + 5
        covered[a:b] += 1
    for a, b in zip(at[kind == 0].tolist(), to[kind == 0].tolist()):
        assert b - a < 29 or covered[a:b].all()  # a block that is its whole line is there as the line


def test_passages_without_stops_and_short_lines_are_found(spark):
    rnd = random.Random(14)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    inset, menu = words(90), words(5)
    quoted = " ".join(f'"{words(8)}."' for _ in range(10))
    rows = [(1, f"{words(41)} {inset} {words(33)}"), (2, f"{words(70)} {inset} {words(50)}"), (3, f"{menu}\n{words(30)}\nthe end"), (4, f"{words(20)}\n{menu}\nThe End"), (5, f"{words(37)}. {quoted} {words(30)}"), (6, f"{words(18)}. {quoted} {words(44)}")]
    got = paragraph_minhash.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = lambda d, k: sum(r["size"] for r in got if (r["doc_id"], r["kind"]) == (d, k))
    assert all(size(d, "block") >= 40 for d in (1, 2, 5, 6))
    assert all(sorted(r["size"] for r in got if r["doc_id"] == d) == [2, 5] for d in (3, 4))


def test_variants_of_a_line_are_linked_to_their_original(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    lines = [" ".join(words), *(" ".join([*words[: (at := 4 + k % 50)], f"changed{k}", *words[at + 1 :]]) for k in range(400))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = [r for r in paragraph_minhash.repeated_paragraphs(docs).collect() if r["kind"] == "line"]
    # a variant is found if it shares a band with the original: all but one in a hundred at 0.8
    code, _, at, to, kind, _, _, _ = paragraph_minhash._paragraphs(pa.array(lines))
    keys = paragraph_minhash._band_keys(code, at[kind == 0], to[kind == 0], kind[kind == 0], paragraph_minhash.bands_for())
    near = {0} | set(np.flatnonzero((keys == keys[0]).any(1)).tolist())
    assert len(near) >= 390
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert near <= set(classes) and len({classes[d] for d in near}) == 1


def test_pairs_that_share_a_template_are_found(spark):
    rnd = random.Random(16)
    words = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    template, lines = words(48), []
    for _ in range(150):
        own = [*template, *words(12)]
        lines += [" ".join(own), " ".join([*own[:-2], *words(2)])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in paragraph_minhash.repeated_paragraphs(docs).where("kind = 'line'").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, lines)]
    alike = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) == 150
    code, _, at, to, kind, _, _, _ = paragraph_minhash._paragraphs(pa.array(lines))
    keys = paragraph_minhash._band_keys(code, at[kind == 0], to[kind == 0], kind[kind == 0], paragraph_minhash.bands_for())
    promised = [(i, j) for i, j in alike if (keys[i] == keys[j]).any()]
    assert len(promised) >= 0.98 * len(alike)
    assert all(got.get(i) is not None and got.get(i) == got.get(j) for i, j in promised)


@pytest.mark.parametrize("block", [40, 1 << 17])
def test_crowded_buckets_are_joined_wholly(spark, block):
    rnd = random.Random(12)
    sets, crowded = {}, []
    for band in range(6):
        base = [rnd.getrandbits(40) for _ in range(30)]
        for k in range(40):
            unit = band * 100 + k
            sets[unit] = [*rnd.sample(base, rnd.randint(24, 30)), *(rnd.getrandbits(40) for _ in range(rnd.randint(0, 2)))]
            crowded.append((band, unit, unit))
    links = paragraph_minhash.crowded_links(spark.createDataFrame(crowded, "band long, unit long, comp long"), spark.createDataFrame(list(sets.items()), "unit long, shingles array<long>"), block_shingles=block)
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9
    want = union([(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and alike(sets[a], sets[b])], sets)
    assert len(set(want.values())) > 6
    got = union([(r["a"], r["b"]) for r in links.collect()], sets)
    assert got == want


def test_bands_are_tuned_for_recall():
    bands = paragraph_minhash.bands_for(0.8, 2, 0.99)
    assert 1 - (1 - 0.8**2) ** bands >= 0.99 > 1 - (1 - 0.8**2) ** (bands - 1)


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(300, 16))
    near = np.concatenate([base[:20] + rnd.normal(scale=0.05, size=(20, 16)) for _ in range(12)])
    x = np.concatenate((base, near, base[:5])).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (0, rows[0][1])]
    got = hnsw.near_duplicate_vectors(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>"), shard_rows=200).collect()
    assert len(got) == len(rows) + len(odd)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    roots = union(zip(*(e.tolist() for e in np.nonzero(links)), strict=True), range(len(x)))
    copies = (x == x[0]).all(1)
    found = want = 0
    for r in got:
        if r["vec_id"] < 900:
            found += r["n_links"]
            want += int(links[r["vec_id"]].sum()) - 1 + bool(links[r["vec_id"]][copies].any())
            assert r["component_id"] == roots[r["vec_id"]]
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    want += int(links[0].sum())
    found_extra = [r for r in got if r["vec_id"] == 0]
    assert len(found_extra) == 2
    assert found >= 0.9 * want
    alone = {r["vec_id"]: r for r in got if 900 <= r["vec_id"] < 906}
    assert all(r["n_links"] == 0 and r["component_id"] == i for i, r in alone.items())
    assert {r["component_id"] for r in got if r["vec_id"] in (906, 907)} == {906}
    assert hnsw.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall_against_brute_force():
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph(x, np.arange(3000))
    ids, _ = graph.search(x[:200].astype(np.float32), 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) >= 0.9


def test_spotsigs(spark):
    docs, rows = odd_docs(spark)
    got = spotsigs.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**18)), r[1] or ""))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert any(r["doc_id"] == i and r["n_chars"] == len(t) and r["edited"] == edited for r in got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] != 2}
    assert prints[6] == prints[7] == prints[None] and prints[1] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    pairs = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(docs).collect() if r["doc_id"] not in (None, 2)}
    assert pairs[7] == 6 and pairs[4] == 4
    assert spotsigs.edited_likeness(docs.limit(0)).count() == 0


def brute_signatures(text):
    """Chains of content words after common words, or single words, as sets of strings."""
    words = [w.strip(spotsigs.EDGES) for w in text.lower().split()]
    common = set(spotsigs.COMMON_WORDS)
    made = set()
    for k, w in enumerate(words):
        after = [x for x in words[k + 1 :] if x and x not in common][: spotsigs.CHAIN]
        if w in common and len(after) == spotsigs.CHAIN:
            made.add((w, *after))
    return made or {(w or raw,) for w, raw in zip(words, text.lower().split())}


def test_spotsigs_likeness_equals_brute_force(spark):
    rnd = random.Random(22)
    words = [*spotsigs.COMMON_WORDS[:15], "Fox,", "dog", "«Haus»", "étude", "river.", "stone", "cloud", "--", "x1"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 20, 60, 300]))) for _ in range(40)] + ["the fox", "fox dog stone"]
    texts[7] = texts[6]
    got = {r["doc_id"]: r for r in spotsigs.edited_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def alike(a, b):
        a, b = brute_signatures(a), brute_signatures(b)
        if not a and not b:
            return 1.0
        return len(a & b) / len(a | b)

    for i, t in enumerate(texts):
        following = texts[i - 1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert len(got[i]["fingerprint"]) == 8 * len(brute_signatures(t))
        assert got[i]["near_edited"] == pytest.approx(alike(t, edited)) and got[i]["near_next"] == pytest.approx(alike(t, following))
    assert got[7]["near_next"] == 1 and got[6]["fingerprint"] == got[7]["fingerprint"]
    groups = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    assert groups == union(links, range(len(texts)))


def test_names_that_operators_use_inside_may_be_columns(spark):
    names = ["__id", "__tag", "id_", "tag_", "_id_", "nth", "root", "kept", "_kept", "n_bytes", "spans", "_spans", "decoded", "__lang", "perplexity", "perplexity_bound", "threshold", "score", "key", "part", "row"]
    long = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(i, t, "en", *(f"{n}{i}" for n in names)) for i, t in enumerate([long, long, "short", None, "", long])]
    docs = spark.createDataFrame([*rows, rows[1]], ", ".join(["doc_id long", "text string", "lang string", *(f"`{n}` string" for n in names)]))
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    left = suffix_dedup.texts_without_repeats(docs)
    assert left.columns == docs.columns and {r["doc_id"]: r["__id"] for r in left.collect()} == {r[0]: r[3] for r in rows}
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() <= 7
    other = docs.withColumnRenamed("doc_id", "me").withColumnRenamed("lang", "tongue")
    assert quality.classify(other, labels.withColumnRenamed("doc_id", "me"), id_col="me", lang_col="tongue").count() == 7
    clean = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    assert clean.columns == docs.columns
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs, path).withColumn("decoded", F.lit("mine"))
    assert {r["decoded"] for r in bpe.decode(coded, path).collect()} == {"mine"}

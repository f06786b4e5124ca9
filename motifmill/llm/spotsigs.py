"""SpotSigs fingerprints: chains of content words that follow common words.

Each occurrence of a common word is an anchor; it and the next content words make a signature. The set of a text's
signatures is its fingerprint. Sets are compared by Jaccard, pruned by their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, steps, stored, texts, word_ids
from .components import connected_components

# Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind um und uns von war wie wir zu zum zur über "
    "au aux avec ce ces cette dans de du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "al como con cuando del desde donde el ella ellos era esta este esto fue hay las lo los más mi muy no nos o para pero por porque se sin sobre su sus también te todo una uno y ya"
).split()

CHAIN = 3
#: Characters that are cut off a word's ends.
EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "«»“”„’‘…¿¡–—"


def signature_sets(text: pa.Array, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(text of each signature, signature as unsigned 32 bits), sorted and without repeats.

    A text without a chain takes its single words instead, one without words but with characters a hash of itself;
    the empty text has no signatures. Equal texts have equal sets."""
    doc, words, index = word_ids(pc.utf8_lower(text), pc.utf8_split_whitespace)
    bare = pc.utf8_trim(words, characters=EDGES)
    digest = xxhash.xxh64_intdigest
    code = np.fromiter((digest(w or raw) for w, raw in zip(bare.to_pylist(), words.to_pylist(), strict=True)), np.uint64, len(words))
    common = pc.is_in(bare, value_set=pa.array(COMMON_WORDS)).to_numpy(zero_copy_only=False)
    content = ~common & pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    anchors, follows = np.flatnonzero(common[index]), np.flatnonzero(content[index])
    first = np.searchsorted(follows, anchors)
    whole = first + chain <= len(follows)
    anchors, first = anchors[whole], first[whole]
    same = doc[follows[first + chain - 1]] == doc[anchors] if len(anchors) else np.zeros(0, bool)
    anchors, first = anchors[same], first[same]
    made = code[index[anchors]]
    with np.errstate(over="ignore"):
        for k in range(chain):
            made = mix64(made * np.uint64(31) + code[index[follows[first + k]]])
    of = doc[anchors].astype(np.uint64)
    chained = np.zeros(len(text), bool)
    chained[doc[anchors]] = True
    single = ~chained[doc]
    of, made = np.concatenate((of, doc[single].astype(np.uint64))), np.concatenate((made, mix64(code[index[single]])))
    worded = np.zeros(len(text), bool)
    worded[doc] = True
    blank = [k for k in np.flatnonzero(~worded).tolist() if text[k].as_py()]
    of = np.concatenate((of, np.array(blank, np.uint64)))
    made = np.concatenate((made, np.array([digest(text[k].as_py()) for k in blank], np.uint64)))
    keys = np.unique((of << np.uint64(32)) | (made >> np.uint64(32)))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The Jaccard similarity of a's and b's k-th sets for k < n.

    Pairs are partitioned by the length class of their larger set (classes double), and a class's pairs are compared
    together by the signatures they share. Only an empty set rules out all likeness; two of them are alike (1)."""
    size_a, size_b = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    class_ = np.log2(np.maximum(large, 1)).astype(np.int64)
    out = np.where(large == 0, 1.0, 0.0)
    for k in np.unique(class_[small > 0]).tolist():
        in_class = class_ == k
        keys = [(x[0][own].astype(np.uint64) << np.uint64(32)) | x[1][own] for x in (a, b) for own in [in_class[x[0]]]]
        shared = np.bincount((np.intersect1d(*keys, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=n)
        out[in_class] = (shared / np.maximum(size_a + size_b - shared, 1))[in_class]
    return np.where(large == 0, 1.0, out)


def as_text(sets: tuple[np.ndarray, np.ndarray], n: int) -> list[str]:
    """Each set as eight hex digits a signature, rising."""
    ends = np.searchsorted(sets[0], np.arange(n + 1)) * 4
    raw = sets[1].astype(">u4").tobytes()
    return [raw[a:b].hex() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, fingerprint): one row per row of docs; null text counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            sets = signature_sets(texts(batch, text_col), chain)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(as_text(sets, batch.num_rows), pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key, by binary search in nested conditions."""
    if not bounds:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key <= bounds[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(bounds))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    A text's last third (rounded down, in code points) is replaced by the beginning of the next document's text, in
    descending order of ids, after the last the first. Null text counts as empty; rows with equal ids follow each other
    by text; rows with a null id come last. The only row of a table is its own next. Rows are dealt out by ranges of
    ids; each range also gets the first row of the next one, so texts are shuffled once and nothing is gathered."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0] or []
    bucket = _bucket(F.col("key"), sorted(set(cuts)))
    rows = rows.withColumn("bucket", bucket)
    # a row for each bucket: bounded by the number of partitions
    heads = sorted(map(tuple, rows.groupBy("bucket").agg(F.max("key")).collect()))
    if heads:
        after = [(head, heads[i + 1][0], False) for i, (_, head) in enumerate(heads[:-1])] + [(heads[-1][1], heads[0][0], True)]
        guard = F.broadcast(spark.createDataFrame(after, "head long, target int, wrap boolean"))
        guards = rows.join(guard, F.col("key") == F.col("head")).groupBy("target").agg(F.min("text").alias("text"), F.min("key").alias("key"))
        guards = guards.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "key", "text", F.col("target").alias("bucket"), F.lit(True).alias("guard"))
        rows = rows.withColumn("guard", F.lit(False)).unionByName(guards)
    else:
        rows = rows.withColumn("guard", F.lit(False))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guard", F.desc("key"), "text").drop("key")
    names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in steps(batches, "text"):
            block = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = block.slice(block.num_rows - 1)
            n = block.num_rows - 1
            if not n:
                continue
            text = texts(block)
            own = text.to_pylist()
            cut = [len(a) - len(a) // 3 for a in own[:-1]]
            edited = pa.array([a[:c] + b[: len(a) - c] for a, b, c in zip(own, own[1:], cut)], pa.string())
            sets, changed = signature_sets(text, chain), signature_sets(edited, chain)
            follow = sets[0] > 0
            here = sets[0] < n
            sets_next = sets[0][follow] - 1, sets[1][follow]
            sets = sets[0][here], sets[1][here]
            columns = [block.column("id").slice(0, n), pa.array([len(a) for a in own[:-1]], pa.int64()), edited, pa.array(as_text(sets, n), pa.string()), pa.array(as_text(changed, n), pa.string()), pa.array(likeness(sets, changed, n)), pa.array(likeness(sets, sets_next, n))]
            made = pa.RecordBatch.from_arrays(columns, names)
            yield made.filter(pc.invert(block.column("guard").slice(0, n)))

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """(id, fingerprint, component_id): groups of rows whose signature sets chain up at Jaccard >= threshold.

    Equal sets collapse first. Sets are dealt out by length class (classes grow by 1/threshold, so a set only meets its
    own and the next class) and by their rarest signatures: at Jaccard t two sets of n share one of their n - ceil(t n) + 1
    rarest. Colliding pairs are verified exactly. Texts without signatures link to each other."""
    prints = stored(fingerprints(docs, id_col, text_col, chain), "spotsigs")
    sets = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    sets = stored(sets.select("least", "fingerprint", F.xxhash64("fingerprint").alias("fp"), (F.length("fingerprint") / 8).cast("int").alias("n")), "spotsigs-sets")
    signature = F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.substring("fingerprint", k * 8 - 7, F.lit(8))))
    exploded = sets.where("n > 0").select("fp", "n", signature.alias("sig"))
    often = exploded.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = exploded.join(often, "sig").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    probes = ranked.select("fp", "n", F.explode(F.slice("sigs", F.lit(1), prefix.cast("int"))["sig"]).alias("sig"), level.alias("level"))
    left = probes.select(F.col("fp").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    pairs = left.join(probes, ["sig", "level"]).where("(na < n or na = n and a < fp) and na >= n * %r - 1e-9" % threshold).select("a", F.col("fp").alias("b")).distinct()
    pieces = sets.select("fp", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.substring("fingerprint", k * 8 - 7, F.lit(8))).alias("s"))
    both = pairs.join(pieces.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(pieces.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.where(shared >= (F.size("sa") + F.size("sb") - shared) * threshold - 1e-9).select("a", "b")
    roots = connected_components(links, "a", "b", "spotsigs-links")
    rooted = sets.join(roots, sets.fp == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")

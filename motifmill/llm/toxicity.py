"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Lexicons (words and word beginnings that toxic training texts favour) are mined by distributed counts. Voters are
thresholds on how often a lexicon or a pattern hits a text; a text's voters use the lexicon that is mined without the text
and its near copies (their share is taken from the counts), so that no vote rests on the text's own label. An EM label
model starts from the given labels, held to be often wrong, estimates each voter's accuracy by class and the voters'
correlations given the class, then the given labels' accuracy too; a logistic regression is trained on the posterior labels."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix64, starts_of, steps, stored, texts, word_ids
from .spotsigs import EDGES

#: Labelled rows that are learned from at most (those of least hash), and the size of the lexicon.
TRAIN_ROWS, LEXICON = 24_000, 300
#: Lengths of word beginnings in the lexicon; 0 stands for whole words.
KINDS = (0, 4, 5, 6, 7)
#: A lexicon entry is in the toxic texts this many times as often (as a logarithm) and in so many groups of them; its hits, of
#: each group MOST_HITS at most, add up to so many.
LEAST_ODDS, LEAST_GROUPS, LEAST_HITS, MOST_HITS = 1.2, 2, 3, 4
TIERS = (3.0, 1.2)
THRESHOLDS = (1, 2, 3, 5)
CUT = 0.3
#: How much a text counts for its likelier class while rates are estimated.
SURE = 0.98
#: How often given labels are thought to be wrong at first, and how much a voter's rates lean on those in all texts.
WRONG, SMOOTH = 0.2, 0.3
#: The power of the posterior odds that the classifier is trained on: what is undecided weighs little either way.
SHARPER = 3
#: Texts by label.
CELLS = ("toxic", "other")
PATTERNS = 4


def _words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    doc, words, index = word_ids(pc.utf8_lower(text), pc.utf8_split_whitespace)
    return doc, pc.utf8_trim(words, characters=EDGES), index


def _starts(bare: pa.Array, kind: int) -> pa.Array:
    """Of each word its first `kind` letters (null if it is shorter), or for 0 the word."""
    if not kind:
        return pc.if_else(pc.greater(pc.utf8_length(bare), 1), bare, pa.scalar(None, pa.string()))
    return pc.if_else(pc.greater_equal(pc.utf8_length(bare), kind), pc.utf8_slice_codeunits(bare, 0, kind), pa.scalar(None, pa.string()))


def with_groups(docs: DataFrame, label: str) -> DataFrame:
    """(text, label, grp): near copies mostly share a group, the least hash of their three-word shingles; a text of fewer
    words has the group of its equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            text = texts(batch)
            doc, bare, index = _words(text)
            code = np.array([xxhash.xxh64_intdigest(w) for w in bare.to_pylist()], np.uint64)
            with np.errstate(over="ignore"):
                shingle = mix64(mix64(mix64(code[index[:-2]]) + code[index[1:-1]]) + code[index[2:]]) if len(index) > 2 else np.zeros(0, np.uint64)
            inside = doc[:-2] == doc[2:] if len(doc) > 2 else np.zeros(0, bool)
            group = np.full(batch.num_rows, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(group, doc[:-2][inside], shingle[inside])
            for k in np.flatnonzero(starts_of(doc, batch.num_rows)[1:] - starts_of(doc, batch.num_rows)[:-1] < 3).tolist():
                group[k] = xxhash.xxh64_intdigest(text[k].as_py(), 1)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column(label), pa.array(group.view(np.int64))], ["text", "label", "grp"])

    return docs.select("text", label).mapInArrow(run, "text string, label int, grp long")


def feature_counts(train: DataFrame) -> DataFrame:
    """(kind, feature, toxic, other, groups): the weighted hits of a word or word beginning in toxic and other texts, MOST_HITS at
    most of each, and the weight of the toxic texts that have it. train: text, label, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            doc, bare, index = _words(texts(batch))
            cell = (batch.column("label").to_numpy(zero_copy_only=False) != 1).astype(np.int64)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for kind in KINDS:
                coded = _starts(bare, kind).dictionary_encode()
                of_word = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                got = of_word[index]
                keep, n = got >= 0, len(coded.dictionary)
                pairs, hits = np.unique(doc[keep].astype(np.int64) * max(1, n) + got[keep], return_counts=True)
                of, feature = pairs // max(1, n), pairs % max(1, n)
                hits, toxic = weight[of] * np.minimum(hits, MOST_HITS), cell[of] == 0
                sums = [np.bincount(feature, weights=w, minlength=n).astype(np.float64) for w in (hits * toxic, hits * ~toxic, weight[of] * toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), coded.dictionary, *map(pa.array, sums)], ["kind", "feature", *CELLS, "groups"])

    made = train.select("text", "label", "weight").mapInArrow(run, f"kind int, feature string, {', '.join(f'{c} double' for c in (*CELLS, 'groups'))}")
    return made.groupBy("kind", "feature").agg(*(F.sum(c).alias(c) for c in (*CELLS, "groups")))


class ToxicityModel:
    """A mined lexicon and the classifier's weights; small, and bounded by LEXICON."""

    def __init__(self, entries: list[tuple[int, str, float]]) -> None:
        self.entries = entries
        self.by_kind = {k: [(f, i) for i, (kind, f, _) in enumerate(entries) if kind == k] for k in KINDS}
        self.groups = [[i for i, (kind, _, s) in enumerate(entries) if kind == k and low <= s < high] for k in KINDS for low, high in ((TIERS[0], np.inf), (TIERS[1], TIERS[0]))]
        self.weights = np.zeros(0)
        self.scale = np.zeros(0)

    def counts(self, text: pa.Array) -> np.ndarray:
        """Hits of each entry, then words, exclamation marks, capitals and digits, for each text."""
        doc, bare, index = _words(text)
        n, width = len(text), len(self.entries)
        out = np.zeros((n, width + PATTERNS), np.float32)
        for kind, own in self.by_kind.items():
            if own:
                place = pc.index_in(_starts(bare, kind), value_set=pa.array([f for f, _ in own]), skip_nulls=True)
                to = np.append(np.array([i for _, i in own]), -1)[place.fill_null(-1).to_numpy(zero_copy_only=False)][index]
                hit = to >= 0
                out[:, :width] += np.bincount(doc[hit].astype(np.int64) * width + to[hit], minlength=n * width).reshape(n, width)
        out[:, width] = np.diff(starts_of(doc, n))
        for k, pattern in enumerate(("!", "[A-ZÀ-Þ]", "[0-9]")):
            out[:, width + 1 + k] = pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
        return out

    def grouped(self, counts: np.ndarray) -> np.ndarray:
        return np.stack([counts[:, g].sum(1) if g else np.zeros(len(counts)) for g in self.groups], 1)

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """+1 toxic, -1 not, 0 abstains: a voter for each lexicon group and threshold, for each tier whatever the kind of entry
        (languages differ in which kind tells), and for each pattern."""
        group, words = self.grouped(counts), np.maximum(counts[:, -PATTERNS], 1)
        group = np.concatenate([group] + [group[:, k :: len(TIERS)].max(1, keepdims=True) for k in range(len(TIERS))], 1)
        made = [np.where(group[:, [g]] >= t, 1, np.where(group[:, [g]] == 0, -1, 0)) for g in range(group.shape[1]) for t in THRESHOLDS]
        rate = counts[:, 1 - PATTERNS :] / words[:, None]
        made += [np.where(rate[:, [k]] > high, 1, np.where(rate[:, [k]] < low, -1, 0)) for k, (low, high) in enumerate(((0.01, 0.3), (0.05, 2.0), (0.05, 1.0)))]
        return np.concatenate(made, 1).astype(np.int8)

    def features(self, counts: np.ndarray) -> np.ndarray:
        group, words = self.grouped(counts), np.maximum(counts[:, [-PATTERNS]], 1)
        steps_ = [(group >= t).astype(np.float64) for t in THRESHOLDS]
        return np.concatenate([np.ones((len(counts), 1)), np.log1p(counts[:, :-PATTERNS]), np.log1p(group), np.sqrt(group / words), *steps_, np.log1p(counts[:, 1 - PATTERNS :] / words), np.log1p(words)], 1)

    def score(self, text: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(text))
        return 1 / (1 + np.exp(-np.clip((self.features(self.counts(text)) / self.scale) @ self.weights, -40, 40)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 8, joint: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, each voter's vote probabilities by class, the voters' correlations given the class).

    votes: -1, 0, 1. The given labels are one more witness: it starts from them, for `rounds` rounds they are thought to be
    wrong as often as WRONG, so that many voters overrule them; then for `joint` rounds their rates of error are estimated
    like the voters'. Rates are estimated from texts counted to their likelier class (SURE of them): soft counts would blur
    the classes round by round. A voter's rates in a class lean on its rates in all texts by SMOOTH texts for each voter, so
    that the few texts of a small class don't make silence impossible for it. A voter counts for less the more it is
    correlated with others within a class, so that many thresholds on one lexicon aren't many witnesses."""
    post = np.where(given == 1, SURE, 1 - SURE)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(np.float64)
    lean = SMOOTH * votes.shape[1]
    prior = lean * onehot.mean(0) + 0.01
    for nth in range(rounds + joint):
        sure = np.where(post > 0.5, SURE, 1 - SURE)
        share = np.stack((1 - sure, sure))
        prob = (np.einsum("cn,nvk->cvk", share, onehot) + prior) / (share.sum(1)[:, None, None] + lean + 0.03)
        rest = votes - share.T @ np.einsum("cvk,k->cv", prob, np.array([-1.0, 0, 1]))
        rest -= rest.mean(0)
        dev = np.maximum(rest.std(0), 1e-3)
        corr = np.clip((rest / dev).T @ (rest / dev) / len(rest), -1, 1)
        weight = 1 / np.maximum(1, np.abs(corr).sum(1))
        odds = np.log(share[1].mean() / share[0].mean()) + np.einsum("nvk,vk,v->n", onehot, np.log(prob[1]) - np.log(prob[0]), weight)
        # how often 1 is given, by class
        says = np.array([WRONG, 1 - WRONG]) if nth < rounds else (share @ given + 0.5) / (share.sum(1) + 1)
        odds += np.where(given == 1, np.log(says[1] / says[0]), np.log((1 - says[1]) / (1 - says[0])))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return post, prob, corr


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(scale, weights) of a ridge-penalised logistic regression on soft labels of weighted rows, by Newton's method."""
    scale = np.maximum(np.sqrt((x**2).mean(0)), 1e-3)
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (target - p)) - penalty * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return scale, w


def lexicon(counts: DataFrame, totals: dict[str, float], without: str = "") -> list[tuple[int, str, float]]:
    """The LEXICON entries (kind, feature, log odds) that toxic texts favour most.

    without: the label ("toxic", "other") of a group of texts that has the entry and is left out."""
    less = {c: float(c == without) for c in CELLS}
    toxic, other = (max(totals[c] - less[c], 0.0) for c in CELLS)
    # how often the text has the entry is not known: of a toxic one as much as can be is taken away, of another one as little
    t, o = F.greatest(F.col("toxic") - MOST_HITS * less["toxic"], F.lit(0.0)), F.greatest(F.col("other") - less["other"], F.lit(0.0))
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((o + 0.5) / (other + 1))
    enough = (F.col("groups") >= LEAST_GROUPS - 1e-6) & (t >= max(LEAST_HITS, toxic // 400) - 1e-6)
    best = counts.where(enough).select("kind", "feature", t.alias("t"), odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return [(r["kind"], r["feature"], r["odds"]) for r in best.orderBy(F.desc(F.round(F.col("t") * F.col("odds"), 9)), "kind", "feature").limit(LEXICON).collect()]


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, weight): the labelled texts to learn from, at most `rows` ids, those of least hash.

    Every text of such an id is there, short and repeated ones too. Texts of a group (near copies, mostly) share one
    unit of weight."""
    chosen = labels.where(f"`{id_col}` is not null and `{label_col}` in (0, 1)").groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts_ = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    grouped = stored(with_groups(texts_, "label"), "toxicity-groups")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("n"))
    return stored(grouped.join(sizes, "grp").select("text", "label", (1 / F.col("n")).alias("weight")), "toxicity")


def learned_votes(kept: DataFrame) -> tuple[ToxicityModel, dict[str, np.ndarray]] | None:
    """(a model with its lexicon but no weights yet, each row's label, weight, counts and votes) of training_rows()."""
    cell = F.when(F.col("label") == 1, "toxic").otherwise("other")
    totals = {c: 0.0 for c in CELLS} | {r["cell"]: r["w"] for r in kept.groupBy(cell.alias("cell")).agg(F.sum("weight").alias("w")).collect()}
    if not totals["toxic"] or not totals["other"]:
        return None
    counts = stored(feature_counts(kept).where(f"groups >= {LEAST_GROUPS} - 1e-6"), "toxicity-features")
    model = ToxicityModel(lexicon(counts, totals))
    voters = [ToxicityModel(lexicon(counts, totals, c)) for c in CELLS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            text, label = texts(batch), batch.column("label").to_numpy()
            got = model.counts(text).astype("<f4")
            votes = np.where((label == 1)[:, None], *(v.votes(v.counts(text)) for v in voters))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), *(pa.array([row.tobytes() for row in x], pa.binary()) for x in (got, votes))], ["label", "weight", "counts", "votes"])

    # bounded by TRAIN_ROWS and LEXICON
    got = kept.mapInArrow(count, "label int, weight double, counts binary, votes binary").toArrow()
    matrix = lambda c, kind: np.frombuffer(b"".join(got[c].to_pylist()), kind).reshape(len(got), -1)
    return model, {"label": got["label"].to_numpy(), "weight": got["weight"].to_numpy(), "counts": matrix("counts", "<f4"), "votes": matrix("votes", np.int8)}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns from labels (id, label) of 0 and 1: at most `rows` labelled ids (those of least hash).

    The bound makes the labelled ids small enough to broadcast, so that texts are not shuffled. Of an id's labels the
    largest holds; null ids, other labels and ids without a text are left out, null texts count as empty. Without any
    toxic text, or without any other one, the model scores 0."""
    got = learned_votes(training_rows(docs, labels, label_col, id_col, text_col, rows))
    if got is None:
        return ToxicityModel([])
    model, x = got
    posterior, _, _ = label_model(x["votes"], x["label"])
    model.scale, model.weights = fit_linear(model.features(x["counts"]), 1 / (1 + (1 / np.clip(posterior, 1e-9, 1 - 1e-9) - 1) ** SHARPER), x["weight"])
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs (all columns) plus the score, from 0 to 1; null and empty texts are scored like others (no hits), repeated rows
    and null ids too. Where a column has the score's name already, the score gets a leading underscore. No shuffle."""
    out = fresh(docs, out_col)
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: ToxicityModel = pickle.loads(sent.value)
        for batch in steps(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine.score(texts(batch, text_col)))], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row's id is kept from learning; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, that score below the cut; null and empty texts, null ids and repeats are no exception."""
    scored = score(docs, model, text_col)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < cut).select(*[f"`{c}`" for c in docs.columns])

"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard of bounded size.

Equal vectors collapse first. Every distinct vector meets every shard: each two shards are looked at once, the vectors of
one querying the graph of the other, and a link counts for both its ends. Queries are streamed past a shard's graph; a graph
is sent once for each SLICE shards' worth of queries, so that copies of graphs are a small part of what is sent. Blocks of
queries walk a graph in step; the beam is widened until audits pass (on planted neighbours, and on each block against
brute force), queries whose whole beam is similar are scanned exactly, and every link is verified in double precision.
A task hands on a spanning forest of its links, so dense groups do not send all their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored
from .components import connected_components

THRESHOLD = 0.95
#: Vectors in a shard, about; links of a node (twice as many on the ground level); beams of building and searching.
SHARD_ROWS, LINKS, BUILD_BEAM, SEARCH_BEAM, WIDEST_BEAM = 16_384, 16, 40, 24, 192
#: Queries that walk together, of which AUDITED are held against brute force, and the recall they must reach.
BLOCK, AUDITED, RECALL = 512, 24, 0.99
#: Neighbours that are planted at the threshold to find a graph's first beam.
PLANTED = 256
#: So many shards' worth of queries are streamed past one copy of a graph.
SLICE = 8


class Graph:
    """A navigable small world of unit vectors, built in batches."""

    def __init__(self, x: np.ndarray, seeds: np.ndarray) -> None:
        """x: vectors of norm one in rows; seeds: numbers that decide the nodes' levels."""
        self.x = x.astype(np.float32)
        n = len(x)
        chance = (mix64(seeds.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.level = np.minimum((-np.log(np.maximum(chance, 1e-12)) / np.log(LINKS)).astype(np.int64), 4)
        self.links = [np.full((n, 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(int(self.level.max(initial=0)) + 1)]
        self.top: int | None = None
        self.beam = 0
        order = np.argsort(-self.level, kind="stable")  # the upper levels first
        at = 0
        while at < n:
            batch = order[at : at + max(32, min(at, BLOCK))]
            self._insert(batch)
            at += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        own = self.x[batch]
        inner = own @ own.T
        np.fill_diagonal(inner, -2)
        entry = None if self.top is None else np.full(len(batch), self.top)
        for level in range(len(self.links) - 1, -1, -1):
            here = np.flatnonzero(self.level[batch] >= level)
            near_ids, near = np.full((len(batch), 0), -1), np.full((len(batch), 0), -2.0, np.float32)
            if entry is not None and self.level[self.top] >= level:
                near_ids, near = self.walk(own, entry, level, BUILD_BEAM if len(here) else 1)
                entry = near_ids[:, 0]
            if not len(here):
                continue
            k = min(LINKS, len(here) - 1)
            if k > 0:
                sims = inner[np.ix_(here, here)]
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                near_ids = np.concatenate((near_ids[here], batch[here][best]), 1)
                near = np.concatenate((near[here], np.take_along_axis(sims, best, 1)), 1)
            else:
                near_ids, near = near_ids[here], near[here]
            chosen = self._diverse(near_ids, near, LINKS)
            self.links[level][batch[here], : chosen.shape[1]] = chosen
            self._link_back(level, batch[here], chosen)
        if self.top is None:
            self.top = int(batch[np.argmax(self.level[batch])])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest ones that are nearer to the row than to one chosen before; then others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = ids.shape
        vectors = self.x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
        for j in range(width):
            closest = np.where(taken[:, :j], between[:, j, :j], -2).max(1, initial=-2)
            taken[:, j] = (ids[:, j] >= 0) & (count < most) & (closest < sims[:, j])
            count += taken[:, j]
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(np.where(rank == 2, -1, ids), best, 1).astype(np.int32)

    def _link_back(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        counts, own = np.diff(np.append(first, len(target))), target[first]
        for at in range(0, len(own), BLOCK):
            some = slice(at, at + BLOCK)
            old, wide = self.links[level][own[some]], int(counts[some].max())
            new = np.full((len(old), wide), -1, np.int32)
            nth = np.arange(first[some][0], first[some][-1] + counts[some][-1])
            row = np.repeat(np.arange(len(old)), counts[some])
            new[row, nth - first[some][row]] = source[nth]
            both = np.concatenate((old, new), 1)
            repeat = (new[:, :, None] == old[:, None, :]).any(2) & (new >= 0)
            both[:, old.shape[1] :][repeat] = -1
            sims = np.einsum("rd,rcd->rc", self.x[own[some]], self.x[np.maximum(both, 0)])
            sims[both < 0] = -2
            self.links[level][own[some]] = self._diverse(both, sims, old.shape[1])

    def walk(self, q: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found on a level by all queries in step: (ids, similarities), nearest first, -1 for none."""
        n = len(q)
        ids, sims, done = np.full((n, beam), -1), np.full((n, beam), -2.0, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", q, self.x[entry])
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            open_ = np.where((ids[active] >= 0) & ~done[active], sims[active], -3)
            pick = open_.argmax(1)
            active, pick = active[open_[np.arange(len(active)), pick] > -3], pick[open_[np.arange(len(active)), pick] > -3]
            if not len(active):
                break
            done[active, pick] = True
            near = self.links[level][ids[active, pick]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            seen[np.repeat(active, near.shape[1])[fresh.reshape(-1)], near[fresh]] = True
            found = np.matmul(self.x[np.maximum(near, 0)], q[active][:, :, None])[:, :, 0]
            found[~fresh] = -2
            worth = (found > sims[active, -1][:, None]).any(1)
            rows = active[worth]
            if len(rows):
                all_sims = np.concatenate((sims[rows], found[worth]), 1)
                all_ids = np.concatenate((ids[rows], np.where(fresh[worth], near[worth], -1)), 1)
                all_done = np.concatenate((done[rows], np.zeros(near[worth].shape, bool)), 1)
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[rows], sims[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(q), self.top)
        for level in range(int(self.level[self.top]), 0, -1):
            entry = self.walk(q, entry, level, 1)[0][:, 0]
        return self.walk(q, entry, 0, beam)

    def planted_beam(self, low: float) -> int:
        """The first beam with which nodes are found from places whose similarity to them is just at the threshold.

        Shards may hold no link to the queries at all; planted neighbours audit the graph all the same."""
        own = np.unique(np.linspace(0, len(self.x) - 1, min(PLANTED, len(self.x))).astype(int))
        x, rnd = self.x[own].astype(np.float64), np.random.default_rng(len(self.x))
        aside = rnd.normal(size=x.shape)
        aside -= (aside * x).sum(1)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-9)[:, None]
        at = low + (1 - low) / 20
        q = (at * x + np.sqrt(1 - at * at) * aside).astype(np.float32)
        beam = SEARCH_BEAM
        while beam < WIDEST_BEAM:
            ids, sims = self.search(q, beam)
            if ((ids == own[:, None]).any(1) | (sims >= low).all(1)).mean() >= RECALL:
                break
            beam *= 2
        return beam

    def similar(self, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all found pairs at or just below the threshold; see the module's words on beams and audits."""
        low = threshold - 1e-4
        audited = np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int)
        true = self.x @ q[audited].T >= low
        beam = self.beam = self.beam or self.planted_beam(low)
        while True:
            ids, sims = self.search(q, beam)
            hit = (sims >= low) & (ids >= 0)
            full = hit.all(1)
            found = sum(len(np.intersect1d(ids[a][hit[a]], np.flatnonzero(true[:, k]))) for k, a in enumerate(audited) if not full[a])
            wanted = int(true[:, ~full[audited]].sum())
            if found >= RECALL * wanted:
                break
            beam *= 2
            if beam > WIDEST_BEAM:
                full = np.ones(len(q), bool)
                break
        row, col = np.nonzero(hit & ~full[:, None])
        rows, nodes = [row], [ids[row, col]]
        exact = np.flatnonzero(full)
        for at in range(0, len(exact), 64):
            r, c = np.nonzero(q[exact[at : at + 64]] @ self.x.T >= low)
            rows.append(exact[at : at + 64][r])
            nodes.append(c)
        return np.concatenate(rows), np.concatenate(nodes)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) with the components of the edges a-b, by least labels and pointer jumping."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = code[: len(a)], code[len(a) :], np.arange(len(names))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        for end in (u, v):
            np.minimum.at(new, root[end], least)
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == root).all():
            return names, names[root]
        root = new


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def distinct_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, key) of every row, (key, n, dim, v) of the usable distinct vectors); key is null for unusable ones.

    Copies meet by their bytes' hashes and are merged by a partial aggregate before the shuffle."""
    v = F.col(vec_col)
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = F.transform(v, lambda x: x + F.lit(0.0).cast("float"))  # -0.0 becomes 0.0
    rows = table.select(F.col(id_col).alias("id"), F.when(F.coalesce(usable, F.lit(False)), clean).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.size("v"))))
    return rows.select("id", "key"), rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("v").alias("v")).withColumn("dim", F.size("v"))


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of the table.

    Null or empty vectors, zero ones and those with null, infinite or NaN components link with nothing; vectors of
    different lengths do not link. n_links counts other rows linked directly (copies included), component_id is the
    least id reachable, kept marks it. A null id never names a component unless all of its ids are null."""
    every, usable = distinct_vectors(table, id_col, vec_col)
    every, points = stored(every, "vectors"), stored(usable.select("key", "n", "dim", "v"), "points")
    total = points.count()
    shards = max(1, -(-total // shard_rows))
    if total:
        found = stored(_links(points, total, shards, shard_rows, threshold), "vector-links")
        counts = found.where("root is null").groupBy("key").agg(F.sum("n").alias("linked"))
        roots = connected_components(found.where("root is not null"), "key", "root", "vector-components")
        named = points.select("key", "n").join(counts, "key", "left").join(roots, points.key == roots.node, "left")
        named = named.select("key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    else:
        named = points.select("key", F.col("n").alias("n_links"), F.col("key").alias("root"))
    joined = stored(every.where("key is not null").join(named, "key"), "vector-classes")
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = joined.join(least, "root").select("id", "n_links", "component_id")
    alone = every.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(points: DataFrame, total: int, shards: int, shard_rows: int, threshold: float) -> DataFrame:
    """(key, root, n): rows with root are edges that span a task's links, rows without it counts of linked rows."""
    kinds = "shard int, idx int, key long, n long, dim int, v array<float>, level int, links array<array<int>>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        for dim in np.unique(table["dim"].to_numpy()).tolist():
            part = table.filter(pa.array(table["dim"].to_numpy() == dim)).combine_chunks()
            x = _vectors(part["v"].combine_chunks()).astype(np.float64)
            graph = Graph(x / np.linalg.norm(x, axis=1)[:, None], part["key"].to_numpy().view(np.uint64))
            links = [[graph.links[level][i].tolist() for level in range(int(graph.level[i]) + 1)] for i in range(len(x))]
            n = len(x)
            columns = [part["shard"].combine_chunks(), pa.array(np.arange(n, dtype=np.int32)), *(part[c].combine_chunks() for c in ("key", "n", "dim", "v")), pa.array(graph.level.astype(np.int32)), pa.array(links, pa.list_(pa.list_(pa.int32())))]
            made = pa.RecordBatch.from_arrays(columns, ["shard", "idx", "key", "n", "dim", "v", "level", "links"])
            for at in range(0, n, 2048):
                yield made.slice(at, 2048)

    spark = points.sparkSession
    home = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("int")
    split = points.withColumn("shard", home).select("shard", "key", "n", "dim", "v").repartitionById(shards, F.col("shard"))
    nodes = stored(split.mapInArrow(build, kinds), "hnsw")
    # as many slices as keep copies of graphs rare, but work for all cores
    slices = max(1, -(-total // (SLICE * shard_rows)), min(-(-2 * spark.sparkContext.defaultParallelism // shards), total // (4 * BLOCK)))
    slice_of = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(slices)).cast("int")
    none = F.lit(None).cast("array<array<int>>")
    sent = nodes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("own", F.lit(True)).withColumn("kind", F.lit(0))
    # shards in a ring: each asks itself and the half of the others that follows it
    step = F.explode(F.sequence(F.lit(0), F.lit(shards // 2)))
    asked = nodes.withColumn("slice", slice_of).withColumn("step", step)
    if shards % 2 == 0:
        asked = asked.where((F.col("step") < shards // 2) | (F.col("shard") < shards // 2))
    asked = asked.withColumn("shard", (F.col("shard") + F.col("step")) % shards).withColumn("own", F.col("step") == 0).drop("step").withColumn("kind", F.lit(1)).withColumn("links", none)
    both = sent.unionByName(asked).withColumn("at", F.col("shard") * slices + F.col("slice")).repartitionById(shards * slices, F.col("at")).sortWithinPartitions("kind", "dim", "own", "idx")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes_: list[pa.Table] = []
        graphs: dict[int, tuple[Graph, np.ndarray, np.ndarray, np.ndarray]] | None = None
        back: dict[int, np.ndarray] = {}  # rows linked to each node from other shards
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == 0).any():
                nodes_.append(pa.Table.from_batches([batch.filter(pa.array(kind == 0))]))
            ask = batch.filter(pa.array(kind == 1))
            if not ask.num_rows:
                continue
            if graphs is None:
                graphs = _graphs(nodes_)
                nodes_.clear()
            for dim in np.unique(ask.column("dim").to_numpy()).tolist():
                if dim not in graphs:
                    continue
                graph, raw, keys, weights = graphs[dim]
                part = ask.filter(pa.array(ask.column("dim").to_numpy() == dim))
                q, own = _vectors(part.column("v")).astype(np.float64), part.column("key").to_numpy()
                rows, foreign = part.column("n").to_numpy(), ~part.column("own").to_numpy(zero_copy_only=False)
                q /= np.linalg.norm(q, axis=1)[:, None]
                for at in range(0, len(q), BLOCK):
                    block = q[at : at + BLOCK]
                    row, node = graph.similar(block.astype(np.float32), threshold)
                    cosine = np.einsum("pd,pd->p", block[row], raw[node])
                    good = (cosine >= threshold) & (own[at + row] != keys[node])
                    row, node = row[good], node[good]
                    if len(row):
                        sums = np.bincount(row, weights=weights[node], minlength=len(block)).astype(np.int64)
                        some = np.flatnonzero(sums)
                        yield pa.RecordBatch.from_arrays([pa.array(own[at : at + BLOCK][some]), pa.nulls(len(some), pa.int64()), pa.array(sums[some])], ["key", "root", "n"])
                        far = foreign[at + row]
                        back[dim] = back.get(dim, 0) + np.bincount(node[far], weights=rows[at + row[far]], minlength=len(keys)).astype(np.int64)
                        edges.append(spanning(own[at + row], keys[node]))
        for dim, sums in back.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(graphs[dim][2][some]), pa.nulls(len(some), pa.int64()), pa.array(sums[some])], ["key", "root", "n"])
        if edges:
            vertex, root = spanning(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(root), pa.array(np.zeros(len(vertex), np.int64))], ["key", "root", "n"])

    return both.select("kind", "idx", "own", "key", "n", "dim", "v", "level", "links").mapInArrow(search, "key long, root long, n long")


def _graphs(tables: list[pa.Table]) -> dict[int, tuple[Graph, np.ndarray, np.ndarray, np.ndarray]]:
    """Each dimension's graph as it was built, unit vectors in double precision, keys and numbers of copies."""
    made = {}
    if not tables:
        return made
    table = pa.concat_tables(tables).combine_chunks()
    for dim in np.unique(table["dim"].to_numpy()).tolist():
        part = table.filter(pa.array(table["dim"].to_numpy() == dim)).sort_by("idx").combine_chunks()
        x = _vectors(part["v"].combine_chunks()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        graph = Graph.__new__(Graph)
        graph.x, graph.level = x.astype(np.float32), part["level"].to_numpy().astype(np.int64)
        lists = part["links"].combine_chunks()
        per_node = lists.value_lengths().to_numpy()
        each = lists.flatten()
        values, sizes = each.flatten().to_numpy(), each.value_lengths().to_numpy()
        begin, first = np.cumsum(sizes) - sizes, np.cumsum(per_node) - per_node
        graph.links = []
        for level in range(int(graph.level.max()) + 1):
            width = 2 * LINKS if level == 0 else LINKS
            here = np.flatnonzero(per_node > level)
            table_ = np.full((len(x), width), -1, np.int32)
            table_[here] = values[begin[first[here] + level][:, None] + np.arange(width)]
            graph.links.append(table_)
        graph.top, graph.beam = int(np.argmax(graph.level)), 0
        made[dim] = (graph, x, part["key"].to_numpy(), part["n"].to_numpy())
    return made

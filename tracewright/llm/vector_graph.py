"""Near-duplicate vectors by a robust-pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import components, written
from tracewright.operators.vectors import dot

#: Linked from this cosine on.
COSINE = 0.9
#: Vectors aimed at in a shard, shards that hold each vector, and the most shards there are.
SHARD, OVERLAP, MOST_SHARDS = 1_000, 3, 4_096
#: Expected number of vectors that the shards' centres are fitted on, chosen by a hash of the id.
CENTRE_ROWS, CENTRE_ROUNDS = 20_000, 6
#: A shard beyond this many vectors is split by centres of its own, fitted on about SPLIT_ROWS of its vectors, at most
#: SPLIT of them, and so on; DEALT of its vectors are assigned at a time.
MOST_IN_SHARD, SPLIT_ROWS, SPLIT, DEALT, STUCK = 3_000, 2_048, 32, 20_000, 8
#: Vectors this close to the same centre are linked: their angle is at most twice theirs to it.
SURE = float(np.cos(np.arccos(COSINE) / 2)) + 1e-8
#: Neighbours from other regions are searched through if they are at least this close: two links reach no further.
WAY = 0.62
#: Nearest vectors that pruning chooses from, neighbours that it keeps, and its slack.
CANDIDATES, DEGREE, SLACK = 48, 20, 1.2
#: Best nodes that a greedy search holds, at first and at most; it widens while all that it holds are within range, and
#: nodes with more in range are compared with their whole region.
BEAM, WIDEST = 24, 96
#: Vectors in a block of the exact count.
BLOCK = 1_024


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square of a large or tiny component is lost."""
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on the sample."""
    draw = np.random.default_rng(11)
    centres = sample[draw.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(CENTRE_ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centres)
    return centres


def robust_prune(cosines: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """Neighbours of each vector of a shard, given all its cosines: the nearest first, each dropped if a kept one is
    closer to it by the slack than the vector itself; links back are added."""
    n = len(cosines)
    ranked = np.argsort(-cosines, axis=1, kind="stable")[:, : candidates + 1]
    kept = np.full((n, degree), -1)
    filled = np.zeros(n, int)
    own = np.arange(n)
    for c in ranked.T:
        far = 1 - cosines[own, c]
        close = (slack * (1 - cosines[np.maximum(kept, 0), c[:, None]]) <= far[:, None]) & (kept >= 0)
        take = (c != own) & (filled < degree) & ~close.any(axis=1)
        kept[own[take], filled[take]] = c[take]
        filled[take] += 1
    back: list[list[int]] = [[] for _ in range(n)]
    for a in range(n):
        for b in kept[a, : filled[a]].tolist():
            back[b].append(a)
    return [np.union1d(kept[a, : filled[a]], np.array(back[a][: 2 * degree], int)).astype(int) for a in range(n)]


def _joined(unit: np.ndarray, queries: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Of all links of the rows ``queries`` with any row, by exact cosines in blocks, those that join parts not joined
    before. ``label`` names each row's part and is kept up to date."""
    out = []
    for k in range(0, len(queries), BLOCK):
        block = queries[k : k + BLOCK]
        for q, row in zip(block.tolist(), unit[block] @ unit.T >= COSINE, strict=True):
            at = np.flatnonzero(row)
            at = at[label[at] != label[q]]
            if len(at):
                parts, first = np.unique(label[at], return_index=True)
                out += [(q, int(x)) for x in at[first]]
                label[np.isin(label, parts)] = label[q]
    return out


def _build(group: pa.Table) -> pa.Table:
    """A shard's graph: ``id, neighbours``, those of them within WAY, and in ``links`` links that join all that links within the shard join."""
    ids, unit = np.asarray(group.column("id")), _unit(_matrix(group.column("vec")))
    order = np.argsort(ids)
    ids, unit = ids[order], unit[order]
    cosines = unit @ unit.T
    near = robust_prune(cosines)
    links: list[list[int]] = [[] for _ in ids]
    for a, b in _joined(unit, np.arange(len(ids)), np.arange(len(ids))):
        links[a].append(int(ids[b]))
    way = [ids[x[cosines[i, x] >= WAY]] for i, x in enumerate(near)]
    return pa.table({"id": pa.array(ids), "neighbours": pa.array([ids[x] for x in near], pa.list_(pa.int64())), "way": pa.array(way, pa.list_(pa.int64())), "links": pa.array(links, pa.list_(pa.int64()))})


def greedy_search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, medoid: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` nodes for each query row of ``vectors`` and their cosines, all queries stepping together.

    ``graph`` holds each node's neighbours, -1 where there are fewer. A query starts at the medoid and at itself and
    expands its best node that is not expanded until it has none."""
    q = len(queries)
    nodes, cosines, done = np.full((q, beam), -1), np.full((q, beam), -np.inf), np.zeros((q, beam), bool)
    nodes[:, 0], nodes[:, 1] = medoid, queries
    cosines[:, 0], cosines[:, 1] = vectors[queries] @ vectors[medoid], 1.0
    cosines[queries == medoid, 0] = -np.inf
    nodes[queries == medoid, 0] = -1
    rows = np.arange(q)
    while len(rows):
        best = np.where(done[rows] | (nodes[rows] < 0), -np.inf, cosines[rows]).argmax(axis=1)
        live = ~done[rows, best] & (nodes[rows, best] >= 0)
        rows, best = rows[live], best[live]
        if not len(rows):
            break
        done[rows, best] = True
        new = graph[nodes[rows, best]]
        worth = np.einsum("qrd,qd->qr", vectors[np.maximum(new, 0)], vectors[queries[rows]])
        known = (new[:, :, None] == nodes[rows][:, None, :]).any(axis=2)
        worth[(new < 0) | known] = -np.inf
        all_nodes = np.concatenate([nodes[rows], new], axis=1)
        all_cosines = np.concatenate([cosines[rows], worth], axis=1)
        all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], axis=1)
        keep = np.argsort(-all_cosines, axis=1, kind="stable")[:, :beam]
        nodes[rows] = np.where(np.isfinite(np.take_along_axis(all_cosines, keep, 1)), np.take_along_axis(all_nodes, keep, 1), -1)
        cosines[rows], done[rows] = np.take_along_axis(all_cosines, keep, 1), np.take_along_axis(all_done, keep, 1)
    return nodes, cosines


def _search(group: pa.Table) -> pa.Table:
    """Links ``a, b`` that searches for a region's own vectors find among them and their neighbours elsewhere."""
    ids, unit = np.asarray(group.column("id")), _unit(_matrix(group.column("vec")))
    ids, first = np.unique(ids, return_index=True)
    unit = unit[first]
    lists = group.column("neighbours").to_pylist()
    own = np.array([lists[i] is not None for i in first])
    graph_lists: list[set[int]] = [set() for _ in ids]
    for k, i in enumerate(first):
        if lists[i]:
            at = np.searchsorted(ids, lists[i])
            for j, x in zip(at.tolist(), lists[i], strict=True):
                if j < len(ids) and ids[j] == x and j != k:
                    graph_lists[k].add(j)
                    if not own[j]:
                        graph_lists[j].add(k)
    width = min(4 * DEGREE, max([1, *map(len, graph_lists)]))
    graph = np.full((len(ids), width), -1)
    for k, near in enumerate(graph_lists):
        near = sorted(near, key=lambda j, k=k: (-float(unit[k] @ unit[j]), j))[:width] if len(near) > width else sorted(near)
        graph[k, : len(near)] = near
    queries = np.flatnonzero(own)
    centre = unit[own].mean(axis=0)
    medoid = int(queries[(unit[own] @ centre).argmax()])
    beam, out = BEAM, []
    while len(queries):
        nodes, cosines = greedy_search(unit, graph, queries, medoid, beam)
        within = (cosines >= COSINE) & (nodes >= 0)
        full = within.all(axis=1)
        at, k = np.nonzero(within & ~full[:, None])
        out.append((ids[queries[at]], ids[nodes[at, k]]))
        queries, beam = queries[full], 2 * beam
        if beam > WIDEST:
            pairs = np.array(_joined(unit, queries, np.arange(len(ids))), int).reshape(-1, 2)
            out.append((ids[pairs[:, 0]], ids[pairs[:, 1]]))
            break
    a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
    apart = a != b
    return pa.table({"a": pa.array(a[apart], pa.int64()), "b": pa.array(b[apart], pa.int64())})


def _count(group: pa.Table) -> pa.Table:
    """For two blocks of each component in the group (or one, with itself): links ``id, n`` by exact cosines."""
    component, ids, weight = (np.asarray(group.column(c)) for c in ("component", "id", "weight"))
    left, right = np.asarray(group.column("in_left")), np.asarray(group.column("in_right"))
    unit = _unit(_matrix(group.column("vec")))
    order = np.argsort(component, kind="stable")
    out_ids, out_n = [], []
    for part in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        a, b = part[left[part]], part[right[part]]
        linked = (unit[a] @ unit[b].T) >= COSINE
        same = ids[a][:, None] == ids[b][None, :]
        out_ids.append(ids[a])
        out_n.append(((linked & ~same) * weight[b][None, :]).sum(axis=1))
        if not (left[part] & right[part]).all():
            out_ids.append(ids[b])
            out_n.append((linked * weight[a][:, None]).sum(axis=0))
    return pa.table({"id": pa.array(np.concatenate(out_ids), pa.int64()), "n": pa.array(np.concatenate(out_n), pa.int64())})


def _fitted(group: pa.Table) -> pa.Table:
    """Centres of one shard, from a sample of it."""
    unit = _unit(_matrix(group.column("vec")))[np.argsort(np.asarray(group.column("id")))]
    k = min(SPLIT, max(2, -(-group.column("held")[0].as_py() // SHARD)))
    return pa.table({"shard": group.column("shard")[:1], "centres": pa.array([_centres(unit, k).tolist()], pa.list_(pa.list_(pa.float64())))})


def _dealt(group: pa.Table, fitted: pa.Table) -> pa.Table:
    """Vectors of one shard with the parts of it that they go to: the nearest OVERLAP in the home shard, else the nearest.

    Centres that are equally near are told apart by the id, so that a shard of equal directions is split as well."""
    ids, at_home = np.asarray(group.column("id")), np.asarray(group.column("at_home"))
    centres = np.asarray(fitted.column("centres")[0].as_py())
    cosines = np.round(_unit(_matrix(group.column("vec"))) @ centres.T, 9)
    mixed = (ids[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(centres) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((mixed, -cosines), axis=1)[:, :OVERLAP]
    rank = np.broadcast_to(np.arange(order.shape[1]), order.shape)
    row, column = np.nonzero((rank == 0) | at_home[:, None])
    return pa.table({"id": pa.array(ids[row]), "vec": group.column("vec").take(pa.array(row)), "shard": group.column("shard").take(pa.array(row)), "part": pa.array(order[row, column], pa.int64()), "at_home": pa.array(at_home[row] & (column == 0)), "sure": pa.array(cosines[row, order[row, column]] >= SURE)})


def _split(spread: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``spread(id, vec, shard, at_home)`` with every shard of more than MOST_IN_SHARD vectors split by similarity, and
    links ``a, b`` that the centres prove, so that no dense shard falls apart.

    What a level fits and assigns is bounded for each task, however large a shard; a vector's copies grow by two a level.
    There are as many levels as it takes; STUCK of them that leave the largest shard as it is end them with a warning."""
    whole, proved, largest, stuck = None, [], None, 0
    while True:
        sizes = spread.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
        big = written(sizes.where(F.col("held") > MOST_IN_SHARD))
        held = big.agg(F.max("held")).first()[0]
        if held is None:
            break
        stuck = stuck + 1 if held == largest else 0
        if stuck == STUCK:
            warnings.warn(f"a shard of {held} vectors cannot be split", stacklevel=2)
            break
        largest = held
        rows = spread.join(big, "shard").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("held") / DEALT)))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(float(SPLIT_ROWS << 30)) / F.col("held"))
        fitted = written(sample.groupBy("shard").applyInArrow(_fitted, "shard bigint, centres array<array<double>>"))
        fitted = fitted.join(big, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("held") / DEALT) - 1)))
        dealt = rows.select("id", "vec", "shard", "at_home", "salt").groupBy("shard", "salt").cogroup(fitted.select("shard", "salt", "centres").groupBy("shard", "salt"))
        parts = dealt.applyInArrow(_dealt, "id bigint, vec array<double>, shard bigint, part bigint, at_home boolean, sure boolean").withColumn("shard", F.xxhash64("shard", "part"))
        done = spread.join(big, "shard", "left_anti").select("id", "vec", "shard", "at_home")
        whole = done if whole is None else whole.unionByName(done)
        parts = written(parts.select("id", "vec", "shard", "at_home", "sure"))
        sure = parts.where("sure").select("shard", "id")
        first = sure.groupBy("shard").agg(F.min("id").alias("a"))
        proved.append(written(sure.join(first, "shard").where("id <> a").select("a", F.col("id").alias("b"))))
        spread = parts.drop("sure")
    return (spread if whole is None else written(whole.unionByName(spread))), proved


def _summed(group: pa.Table) -> pa.Table:
    """A block's centre, the greatest angle to it, and its weight."""
    unit = _unit(_matrix(group.column("vec")))
    centre = unit.mean(axis=0)
    length = np.linalg.norm(centre)
    centre = centre / length if length > 1e-9 else unit[0]
    angle = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
    return pa.table({"component": group.column("component")[:1], "block": group.column("block")[:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "angle": pa.array([angle]), "weight": pa.array([int(np.asarray(group.column("weight")).sum())], pa.int64())})


def _counted(members: DataFrame, n: int) -> DataFrame:
    """Links ``id, n`` of each of ``members(component, id, vec, weight, home)`` with other members of its component, exactly.

    A component of up to BLOCK vectors is multiplied out. A larger one is cut into blocks of one region each; two blocks
    whose centres and widest angles show that all or none of their vectors link are not multiplied out."""
    counted = "id bigint, n bigint"
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("held")))
    members = members.join(sizes, "component")
    small = members.where(F.col("held") <= BLOCK).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(max(1, n // 500)).cast("long")))
    out = small.withColumns({"in_left": F.lit(True), "in_right": F.lit(True)}).groupBy("bucket").applyInArrow(_count, counted)
    if sizes.where(F.col("held") > BLOCK).isEmpty():
        return out
    large = members.where(F.col("held") > BLOCK).drop("held")
    homes = large.groupBy("component", "home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    large = large.join(homes, ["component", "home"]).withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))))
    large = written(large.select("component", "block", "id", "vec", "weight"))
    blocks = written(large.groupBy("component", "block").applyInArrow(_summed, "component bigint, block bigint, centre array<double>, angle double, weight bigint"))
    other = blocks.select("component", *(F.col(c).alias(f"o_{c}") for c in ("block", "centre", "angle", "weight")))
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("centre"), F.col("o_centre")))))
    width, most = F.col("angle") + F.col("o_angle"), float(np.arccos(COSINE))
    pairs = blocks.join(other, "component").where(F.col("block") <= F.col("o_block")).withColumn("between", between).where(F.col("between") - width <= most + 1e-6)
    pairs = written(pairs.select("component", "block", "o_block", "weight", "o_weight", (F.col("between") + width <= most - 1e-6).alias("all")))
    sure = pairs.where("all")
    sure = sure.select("component", "block", F.col("o_weight").alias("n")).unionByName(sure.where("block <> o_block").select("component", F.col("o_block").alias("block"), F.col("weight").alias("n")))
    sure = sure.groupBy("component", "block").agg(F.sum("n").alias("n"))
    # A block's own weight is in the sum if it is sure of itself; a vector does not link with itself.
    own = pairs.where("all and block = o_block").select("component", "block", F.lit(1).alias("own"))
    plain = large.join(sure, ["component", "block"]).join(own, ["component", "block"], "left").select("id", (F.col("n") - F.when(F.col("own").isNotNull(), F.col("weight")).otherwise(0)).alias("n"))
    unsure = pairs.where("not all").select("component", F.col("block").alias("x"), F.col("o_block").alias("y"))
    sides = unsure.select("component", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    met = large.join(sides, ["component", "block"]).withColumns({"in_left": F.col("block") == F.col("x"), "in_right": F.col("block") == F.col("y")})
    return out.unionByName(plain).unionByName(met.groupBy("component", "x", "y").applyInArrow(_count, counted))


def _usable(vec):
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors link when their cosine, in double precision, is at least 0.9. ``n_links`` counts the other rows that a vector
    links with, ``component_id`` is the smallest id that links reach, and the vector of that id is kept.

    Equal vectors are one node with a weight. Nodes go to the shards of their nearest centres, and a shard that is too large
    is split by centres of its own until none is; in each shard a
    robust-pruned graph is built, and a node's neighbour lists are united over its shards. Each region (the nodes of one
    home shard and their neighbours elsewhere) is searched greedily from its medoid for each of its nodes, widening
    while all that a search holds are within range; a node with more in range than the widest search holds is compared
    with its whole region, so no group is too large for the range. What links within a shard join is joined by exact
    cosines as well. Components of the links found are then counted exactly, block by block, so ``n_links`` misses a
    link only if neither shards nor searches join two groups by a link.

    Vectors of different lengths do not link; each length is linked on its own, one after the other, so a table should have few
    lengths. Null, empty and zero vectors and those with a null or non-finite component link with nothing. A null id
    gives a null component and is kept. Rows of equal ids count as rows. Labels and other columns are ignored. No rows give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("vec", F.when(_usable(F.col("vec")) & F.col("vec_id").isNotNull(), F.col("vec")))
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("length", F.size("vec"))
    nodes = written(nodes)
    lengths = nodes.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    many = [r["length"] for r in lengths.where("n > 1").orderBy("length").collect()]
    result = nodes.where(~F.col("length").isin(many)).select("vec", (F.col("weight") - 1).alias("n_links"), F.col("id").alias("component_id"))
    for length in many:
        result = result.unionByName(_linked(nodes.where(F.col("length") == length).drop("length")))
    out = rows.join(result, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _linked(nodes: DataFrame) -> DataFrame:
    """``vec, n_links, component_id`` of ``nodes(vec, id, weight)`` of one length."""
    n = nodes.count()
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    sample = nodes.where(draw < CENTRE_ROWS / n).select("id", "vec").toArrow()
    sample = sample if sample.num_rows else nodes.orderBy("id").limit(1).select("id", "vec").toArrow()
    base = _unit(_matrix(sample.column("vec")))[np.argsort(np.asarray(sample.column("id")))]
    centres = nodes.sparkSession.sparkContext.broadcast(_centres(base, min(MOST_SHARDS, -(-n // SHARD))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _unit(_matrix(batch.column(1))) @ centres.value.T
                order = np.argsort(-cosines, axis=1, kind="stable")[:, :OVERLAP]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["id", "vec", "shards"])

    placed = nodes.select("id", "vec").mapInArrow(assign, "id bigint, vec array<double>, shards array<bigint>")
    spread = written(placed.select("id", "vec", F.posexplode("shards").alias("k", "shard")).select("id", "vec", "shard", (F.col("k") == 0).alias("at_home")))
    spread, proved = _split(spread)
    built = spread.groupBy("shard").applyInArrow(_build, "id bigint, neighbours array<bigint>, way array<bigint>, links array<bigint>")
    graph = written(built.groupBy("id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("neighbours", "way", "links"))))

    # Regions: the vectors of a home shard, and their close neighbours elsewhere.
    own = written(spread.where("at_home").select("id", "vec", F.col("shard").alias("home")).join(graph.drop("links"), "id"))
    beyond = own.select("home", F.explode("way").alias("id")).distinct().join(own.select("home", "id"), ["home", "id"], "left_anti")
    beyond = beyond.join(nodes.select("id", "vec"), "id").select("id", "vec", "home", F.lit(None).cast("array<bigint>").alias("neighbours"))
    found = own.select(beyond.columns).unionByName(beyond).groupBy("home").applyInArrow(_search, "a bigint, b bigint")
    found = found.unionByName(graph.select(F.col("id").alias("a"), F.explode("links").alias("b")))
    for links in proved:
        found = found.unionByName(links)
    edges = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = written(components(edges))
    members = linked.join(own.select("id", "vec", "home"), "id").join(nodes.select("id", "weight"), "id")
    counted = _counted(members, n).groupBy("id").agg(F.sum("n").alias("n"))
    result = nodes.select("id", "vec", "weight").join(counted, "id", "left").join(linked, "id", "left")
    return written(result.select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")))


def audit_recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50) -> float:
    """Links found over links there are, for the vectors whose id is divisible by ``every``, against brute force in blocks."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(_usable(F.col("vec")))
    queries = rows.where(F.col("vec_id") % every == 0).toArrow()
    if not queries.num_rows:
        return 1.0
    ids, unit = np.asarray(queries.column("vec_id")), _unit(_matrix(queries.column("vec")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += (unit @ _unit(_matrix(batch.column(1))).T >= COSINE).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["vec_id", "n"])

    there = rows.mapInArrow(count, "vec_id bigint, n bigint").groupBy("vec_id").agg((F.sum("n") - 1).alias("there"))
    both = there.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n_links", "there")), F.sum("there")).first()
    return 1.0 if not both[1] else both[0] / both[1]


def op7_vector_links(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

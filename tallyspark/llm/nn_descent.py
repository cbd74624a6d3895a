"""Embedding near-duplicates by NN-descent (Dong et al. 2011).

A neighbour graph starts from cells of random hyperplanes and is refined by
joining the neighbours of each vector with each other, until few lists
change. Lists that are full of links are enlarged to their whole component,
compared in blocks. Recall is audited against brute force for a stated set of
vectors; where it falls short, the search runs again with more cells and
longer lists, and what all searches found counts. If that falls short too, all
vectors are compared in blocks. Every link is verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import ceil_div, cut, written
from tallyspark.llm.components import components

THRESHOLD = 0.95
NEIGHBOURS = 10
TREES = 6
#: Least chance that two vectors at the threshold share a first cell: those that are alone with each other meet only there.
MEETING = 0.995
#: Vectors of a cell at the start, and of a piece of a large cell or component: what one task compares.
CELL = 512
#: Less similar vectors are no neighbours: they lead nowhere near the threshold.
FLOOR = 0.6
MAX_ROUNDS = 8
#: Rounds end when less than this share of the links in the lists is new.
MIN_NEW = 0.001
#: Vectors whose links are counted by brute force, by a hash of their class.
AUDITED = 1024
MIN_RECALL = 0.95
MAX_SEARCHES = 3
_EDGES = "u long, v long, sim double"


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (`c`, `dim`, `vec`, `first`, `n`), and all rows (`vec_id`, `vec`).

    `vec` is the packed 64-bit components, null where the embedding is null,
    zero, or holds a null or non-finite component. Copies are one class, so
    they are never compared with each other.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                None if v is None else (np.array(v, "<f8") + 0.0).tobytes()  # -0.0 is 0.0
                for v in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, e).alias("embedding"))
    rows = written(rows.mapInArrow(pack, "vec_id long, vec binary"), "vectors")
    classes = (
        rows.where("vec is not null")
        .groupBy("vec")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .select(
            F.monotonically_increasing_id().alias("c"), F.expr("octet_length(vec) div 8").alias("dim"), "vec", "first", "n"
        )
    )
    return written(classes, "vector-classes"), rows


def _unit(vecs) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(ids: np.ndarray, unit: np.ndarray, k: int, floor: float) -> list[tuple]:
    """(u, v, sim) of the `k` nearest others of each vector, at `floor` or above."""
    sims = unit @ unit.T
    sims[ids[:, None] == ids[None, :]] = -2
    if len(ids) > k + 1:
        best = np.argpartition(-sims, k, axis=1)[:, :k]
    else:
        best = np.tile(np.arange(len(ids)), (len(ids), 1))
    at = np.arange(len(ids))[:, None]
    near = sims[at, best] >= floor
    u = np.broadcast_to(at, best.shape)[near]
    v = best[near]
    return ids[u], ids[v], sims[u, v]


def _frame(parts: list[tuple]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64), "sim": np.array([], float)})
    u, v, s = (np.concatenate(x) for x in zip(*parts))
    frame = pd.DataFrame({"u": u, "v": v, "sim": s})
    return frame.drop_duplicates(["u", "v"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The `k` most similar neighbours of each vector."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def cell_bits(n: int) -> int:
    """Hyperplanes of a tree, so that a cell has about `CELL` of `n` vectors."""
    return max(0, math.ceil(math.log2(max(1, n) / CELL)))


def trees_needed(n: int, threshold: float) -> int:
    """Trees in which two vectors at the threshold share a cell with a chance of `MEETING`; more for more vectors."""
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** cell_bits(n)
    return 1 if same >= MEETING else math.ceil(math.log(1 - MEETING) / math.log(1 - same))


def first_lists(classes: DataFrame, n: int, k: int, trees: int, floor: float, seed: int) -> DataFrame:
    """Neighbour lists from cells: vectors on the same side of the same random hyperplanes.

    A cell of more than twice `CELL` vectors is dealt out at random into pieces.
    """
    bits = cell_bits(n)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, dims, vecs = (x.to_pylist() for x in batch.columns)
            out: dict[str, list] = {"tree": [], "cell": [], "c": []}
            for dim in set(dims):
                some = [i for i, d in enumerate(dims) if d == dim]
                planes = np.random.default_rng([seed, dim]).standard_normal((dim, trees * bits))
                x = _unit([vecs[i] for i in some])
                side = (x @ planes > 0).reshape(len(some), trees, bits)
                code = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                for t in range(trees):
                    out["tree"] += [t] * len(some)
                    out["cell"] += [f"{dim}:{x}" for x in code[:, t]]
                    out["c"] += [c[i] for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["tree"], pa.int32()), pa.array(out["cell"], pa.string()), pa.array(out["c"], pa.int64())],
                ["tree", "cell", "c"],
            )

    coded = written(classes.select("c", "dim", "vec").mapInArrow(cells, "tree int, cell string, c long"), "vector-cells")
    sizes = written(coded.groupBy("tree", "cell").agg(F.count("*").alias("n")), "vector-cell-sizes")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * CELL)))
    dealt = coded.join(sizes, ["tree", "cell"]).withColumn("piece", F.pmod(F.xxhash64("c", "tree"), pieces))

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        return _frame([_nearest(frame["c"].to_numpy(), _unit(frame["vec"].tolist()), k, floor)])

    placed = dealt.join(classes.select("c", "vec"), "c")
    return _best(placed.groupBy("tree", "cell", "piece").applyInPandas(near, _EDGES), k)


def refined(lists: DataFrame, classes: DataFrame, k: int, floor: float, turn: int) -> DataFrame:
    """The lists after the neighbours of each vector have been joined with each other.

    A vector's own neighbours and up to `k` of those that name it meet. Which
    ones changes with each round; lists that stay full are enlarged later.
    """
    by_chance = Window.partitionBy("w").orderBy(F.xxhash64("w", "x", F.lit(turn)), "x")
    named = lists.select(F.col("v").alias("w"), F.col("u").alias("x"))
    named = named.withColumn("rank", F.row_number().over(by_chance)).where(F.col("rank") <= k).drop("rank")
    own = lists.select(F.col("u").alias("w"), F.col("v").alias("x"))
    met = own.union(named).distinct()
    met = met.union(met.select("w", F.col("w").alias("x")).distinct())
    met = met.join(classes.select(F.col("c").alias("x"), "vec"), "x")
    calls = max(16, ceil_div(lists.count(), 5000))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        w = frame["w"].to_numpy()
        order = np.argsort(w, kind="stable")
        unit, ids, w = _unit(frame["vec"].tolist())[order] if len(frame) else None, frame["x"].to_numpy()[order], w[order]
        edges = np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w))
        return _frame([_nearest(ids[a:b], unit[a:b], k, floor) for a, b in zip(edges, edges[1:]) if b - a > 1])

    # Vectors of one dimension only ever meet, for their cells are of one dimension.
    met = met.withColumn("call", F.struct(F.pmod(F.xxhash64("w"), F.lit(calls)), F.octet_length("vec")))
    return _best(lists.union(met.groupBy("call").applyInPandas(join, _EDGES)), k)


def neighbour_lists(classes: DataFrame, n: int, k: int, trees: int, floor: float, seed: int) -> DataFrame:
    """NN-descent until fewer than `MIN_NEW` of the entries are new."""
    lists = cut(first_lists(classes, n, k, trees, floor, seed))
    for turn in range(MAX_ROUNDS):
        after = cut(refined(lists, classes, k, floor, turn))
        new = after.join(lists, ["u", "v"], "left_anti").count()
        lists = after
        if new <= MIN_NEW * after.count():
            break
    return lists


def block_pairs(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Components (`c`, `component`) dealt out into pieces of about `CELL` vectors, a group (`p`, `q`) for every pair of pieces."""
    sizes = written(members.groupBy("component").agg(F.count("*").alias("m")), "vector-component-sizes")
    return (
        members.join(sizes, "component")
        .withColumn("pieces", F.ceil(F.col("m") / CELL).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        .join(classes.select("c", "vec", "n"), "c")
        .select("component", "p", "q", "own", "c", "vec", "n")
    )


def enlarged(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(`c`, `linked`, `others`): vectors and classes linked to each member, for whole components (`c`, `component`).

    Every pair of pieces is compared by a task of its own; only sums leave it.
    """
    dealt = block_pairs(classes, members)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        unit, n, own = _unit(frame["vec"].tolist()), frame["n"].to_numpy(), frame["own"].to_numpy()
        links = unit @ unit.T >= threshold
        if frame["p"].iloc[0] != frame["q"].iloc[0]:
            links &= own[:, None] != own[None, :]
        np.fill_diagonal(links, False)
        return pd.DataFrame({"c": frame["c"], "linked": links @ n, "others": links.sum(axis=1)})

    sums = dealt.groupBy("component", "p", "q").applyInPandas(count, "c long, linked long, others long")
    return sums.groupBy("c").agg(F.sum("linked").alias("linked"), F.sum("others").alias("others"))


def search(
    classes: DataFrame, threshold: float, n: int, k: int, trees: int, floor: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Links (`u`, `v`) in both directions, and the classes (`node`) whose lists are full of links."""
    lists = neighbour_lists(classes, n, k, trees, floor, seed)
    links = lists.where(F.col("sim") >= threshold)
    both = cut(links.select("u", "v").union(links.select("v", "u")).distinct())
    full = links.groupBy("u").agg(F.count("*").alias("m")).where(F.col("m") >= k).select(F.col("u").alias("node"))
    return both, cut(full)


def linked_classes(classes: DataFrame, both: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(`c`, `linked`, `others`, `component`) of the classes that have links, `component` as a class.

    `linked` counts vectors, `others` classes: copies once.
    """
    groups = cut(components(both.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    saturated = groups.join(full, "node").select("component").distinct()
    large = cut(groups.join(saturated, "component", "left_semi").select(F.col("node").alias("c"), "component"))
    counted = both.join(large.select(F.col("c").alias("u")), "u", "left_anti").join(
        classes.select(F.col("c").alias("v"), "n"), "v"
    )
    counted = counted.groupBy(F.col("u").alias("c")).agg(F.sum("n").alias("linked"), F.count("*").alias("others"))
    counted = counted.union(enlarged(classes, large, threshold))
    return cut(counted.join(groups.withColumnRenamed("node", "c"), "c"))


def compared_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """`linked_classes` by comparing all classes of a dimension in blocks: exact, and quadratic in their number.

    A block gives counts, and a star for each of its components instead of all
    links.
    """
    members = cut(classes.select("c", F.col("dim").cast("long").alias("component")))
    counted = cut(enlarged(classes, members, threshold).where("others > 0"))
    some = members.join(counted.select("c"), "c", "left_semi")

    def stars(frame: pd.DataFrame) -> pd.DataFrame:
        unit, ids = _unit(frame["vec"].tolist()), frame["c"].to_numpy()
        links = unit @ unit.T >= threshold
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label, np.where(links, label[None, :], len(ids)).min(axis=1))
            if (low == label).all():
                break
            label = low
        return pd.DataFrame({"a": ids, "b": ids[label]})

    pairs = block_pairs(classes, some).groupBy("component", "p", "q").applyInPandas(stars, "a long, b long")
    groups = components(pairs.where("a <> b"))
    return cut(counted.join(groups.withColumnRenamed("node", "c"), "c"))


def audited_recall(
    classes: DataFrame, linked: DataFrame, threshold: float, most: int = AUDITED, few: int = NEIGHBOURS
) -> tuple[float, float]:
    """Mean share of its links that a class got, for at most `most` classes, by brute force against all vectors.

    Every audited class that has links weighs the same and copies count once,
    so that a large group hides no small one. The second figure is that of the
    classes with at most `few` links.
    """
    asked = classes.orderBy(F.xxhash64("c"), "c").limit(most).select("c", "dim", "vec").collect()
    by_dim: dict[int, list] = {}
    for r in asked:
        by_dim.setdefault(r["dim"], []).append((r["c"], bytes(r["vec"])))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, some in frame.groupby("dim"):
                if dim not in by_dim:
                    continue
                ids = np.array([c for c, _ in by_dim[dim]])
                hit = _unit([v for _, v in by_dim[dim]]) @ _unit(some["vec"].tolist()).T >= threshold
                hit &= ids[:, None] != some["c"].to_numpy()[None, :]
                yield pd.DataFrame({"c": ids, "actual": hit.sum(axis=1)})

    actual = classes.select("c", "dim", "vec").mapInPandas(count, "c long, actual long")
    actual = actual.groupBy("c").agg(F.sum("actual").alias("actual")).where("actual > 0")
    share = F.coalesce("others", F.lit(0)) / F.col("actual")
    row = actual.join(linked, "c", "left").agg(F.avg(share), F.avg(F.when(F.col("actual") <= few, share))).first()
    return tuple(1.0 if x is None else x for x in row)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    trees: int = TREES,
    floor: float = FLOOR,
    seed: int = 42,
    report: dict | None = None,
) -> DataFrame:
    """(`vec_id`, `n_links`, `component_id`, `kept`) for every row of `vectors` (`vec_id`, `embedding`).

    Vectors with a cosine of at least `threshold` are linked. Embeddings that
    are null, empty, zero, or hold null or non-finite components link with
    nothing, vectors of different length not with each other. Rows that
    repeat are linked vectors with a row each. A null `vec_id` is never a
    component's id unless it is alone. An empty table gives an empty result;
    other columns are ignored. `report` receives the audited recall. No result
    is returned below `MIN_RECALL`: after `MAX_SEARCHES` all vectors are compared.
    """
    classes, rows = vector_classes(vectors)
    n = classes.count()
    trees = max(trees, trees_needed(n, threshold))
    both = full = None
    for turn in range(MAX_SEARCHES):
        found = search(classes, threshold, n, neighbours << turn, trees << turn, floor, seed + turn)
        # Every link was verified: what an earlier search found stays.
        both = found[0] if both is None else cut(both.union(found[0]).distinct())
        full = found[1] if full is None else cut(full.union(found[1]).distinct())
        linked = linked_classes(classes, both, full, threshold)
        recall, recall_few = audited_recall(classes, linked, threshold)
        if min(recall, recall_few) >= MIN_RECALL:
            break
    else:
        linked = compared_classes(classes, threshold)
        recall, recall_few = audited_recall(classes, linked, threshold)
    if report is not None:
        report |= {"recall": recall, "recall_few": recall_few, "searches": turn + 1}
    found = classes.join(linked, "c", "left").select(
        "vec", "first", F.coalesce("component", "c").alias("component"),
        (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    found = written(found, "vector-links")
    # Cut, so that both sides of the join are dealt out anew and Spark splits a large component.
    ids = cut(found.groupBy("component").agg(F.min("first").alias("component_id")))
    known = found.join(ids, "component").select(F.col("vec").alias("_vec"), "n_links", "component_id")
    out = rows.join(known, rows["vec"] == known["_vec"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node of the graph, with the smallest ids of its members. Each node starts with the nearest of
the few it meets in runs of vectors sorted by random hyperplanes. Then, in rounds, tables are joined: each node
gathers its new and old neighbours and those that have it as a neighbour, these are compared with one another, and
each keeps the nearest it has met; a round that changes little is the last. A query is a node: its search starts
from its own neighbours, and in rounds of joins expands the nearest nodes not yet expanded, along edges both ways.
Comparisons are made in blocks of nodes, whose number grows with the table; lists are as long as their parameters.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length isn't
the most frequent one. Similarity is the cosine in double precision of the original vectors; ties go to the smaller
id. Rows that repeat an id are searched once for each distinct vector. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Neighbours of a node; new and reverse ones joined in a round; rounds; vectors in a starting run, and such orders.
NEIGHBOURS, SAMPLE, ROUNDS, RUN, ORDERS = 24, 14, 7, 96, 4
#: Nodes in a block; nodes a query expands in a round; rounds of search; nodes a query keeps.
BLOCK, EXPAND, SEARCH_ROUNDS, BEAM = 2048, 64, 6, 384
#: The build ends when fewer than this share of all list entries are new.
SETTLED = 0.01


def _unit(column) -> np.ndarray:
    """A binary column of vectors as rows of length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    body = b"".join(column.to_pylist())
    m = np.frombuffer(body, dtype=np.float32).reshape(len(column), -1).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _scaled(v: np.ndarray) -> np.ndarray:
    """A vector times the power of two that brings its largest component near one: no angle changes, and nothing overflows."""
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def nodes(df: DataFrame, key: str, vector: str, spare: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: id and vec (bytes) of the nodes, and node, member, at most ``spare`` members of each, smallest first."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("member"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("member IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)")
    size = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    rows = rows.where(F.size("v") == (size["k"] if size else 0))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("member"))).where(F.col("n") <= spare)
    first = materialize(first, "members")
    heads = first.where("n = 1").select(F.col("member").alias("id"), "v")

    def pack(batches):
        for b in batches:
            vecs = [_scaled(np.array(x, dtype=np.float64)).astype(np.float32).tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vecs, pa.binary())], ["id", "vec"])

    # An id that repeats with several vectors stays one node.
    table = materialize(heads.groupBy("id").agg(F.first("v").alias("v")).mapInArrow(pack, "id long, vec binary"), "nodes")
    again = Window.partitionBy("v")
    members = first.withColumn("node", F.min("member").over(again)).select("node", "member").distinct()
    return table, materialize(members, "members")


def _starts(table: DataFrame, dims: int) -> DataFrame:
    """Proposals from runs of nodes that stand together when sorted by the sides of random hyperplanes."""
    out = None
    for order in range(ORDERS):
        planes = np.random.default_rng(order).normal(size=(dims, 62))

        def sides(batches, planes=planes):
            for b in batches:
                if b.num_rows:
                    bits = _unit(b.column("vec")) @ planes > 0
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits @ (np.int64(1) << np.arange(61, -1, -1)))], ["id", "vec", "side"])

        def runs(batches):
            ids, vecs = [], []
            for b in batches:
                ids += b.column("id").to_pylist()
                vecs += b.column("vec").to_pylist()
                while len(ids) >= 2 * RUN:
                    yield _nearest(ids[:RUN], vecs[:RUN])
                    del ids[:RUN], vecs[:RUN]
            if len(ids) > 1:
                yield _nearest(ids, vecs)

        sorted_ = table.mapInArrow(sides, "id long, vec binary, side long").repartitionByRange("side", "id").sortWithinPartitions("side", "id")
        one = sorted_.mapInArrow(runs, "id long, other long, sim double")
        out = one if out is None else out.union(one)
    return out


def _nearest(ids: list[int], vecs: list[bytes]) -> pa.RecordBatch:
    m = _unit(pa.array(vecs, pa.binary()))
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    k = min(NEIGHBOURS, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    own = np.array(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)), pa.array(own[best].ravel()), pa.array(np.take_along_axis(sims, best, 1).ravel())], ["id", "other", "sim"])


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block")


def _merge(proposals: DataFrame, graph: DataFrame | None, blocks: int) -> DataFrame:
    """The nearest distinct neighbours of each node: id, other, sim, fresh (not in the graph before)."""
    rows = proposals.select(_block("id", blocks), "id", "other", "sim", F.lit(True).alias("fresh"))
    if graph is not None:
        rows = rows.union(graph.select(_block("id", blocks), "id", "other", "sim", F.lit(False)))

    def keep(t: pa.Table) -> pa.Table:
        ids, other, sim, fresh = (t.column(c).to_numpy() for c in ("id", "other", "sim", "fresh"))
        order = np.lexsort((fresh, other, ids))  # of what was met again, the entry that the graph has
        ids, other, sim, fresh = ids[order], other[order], sim[order], fresh[order]
        one = np.ones(len(ids), dtype=bool)
        one[1:] = (ids[1:] != ids[:-1]) | (other[1:] != other[:-1])
        ids, other, sim, fresh = ids[one], other[one], sim[one], fresh[one]
        order = np.lexsort((other, -sim, ids))
        ids, other, sim, fresh = ids[order], other[order], sim[order], fresh[order]
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rank = np.arange(len(ids)) - np.repeat(start, np.diff(np.concatenate([start, [len(ids)]])))
        top = rank < NEIGHBOURS
        return pa.table({"id": ids[top], "other": other[top], "sim": sim[top], "fresh": fresh[top]})

    return rows.groupBy("block").applyInArrow(keep, "id long, other long, sim double, fresh boolean")


def _local_join(graph: DataFrame, table: DataFrame, blocks: int, turn: int) -> DataFrame:
    """Proposals of one round: neighbours of a node, compared with one another."""
    both = graph.select("id", "other", "fresh").union(graph.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh"))
    both = both.groupBy("id", "other").agg(F.max("fresh").alias("fresh"))
    # A bounded choice of each node's partners, another in each round; hubs have very many.
    pick = Window.partitionBy("id", "fresh").orderBy(F.xxhash64("other", F.lit(turn)))
    some = both.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= 2 * SAMPLE).select("id", "other", "fresh")
    met = some.join(table.select(F.col("id").alias("other"), "vec"), "other").select(_block("id", blocks), "id", "other", "fresh", "vec")

    def compare(t: pa.Table) -> pa.Table:
        ids, other, fresh = (t.column(c).to_numpy() for c in ("id", "other", "fresh"))
        order = np.lexsort((~fresh, ids))  # fresh ones first
        ids, other, fresh = ids[order], other[order], fresh[order]
        unit = _unit(t.column("vec"))[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
        one, two, sims = [], [], []
        for a, b in zip(cut[:-1], cut[1:]):
            new = int(fresh[a:b].sum())
            if not new or b - a < 2:
                continue
            s = unit[a : a + new] @ unit[a:b].T
            s[np.arange(new), np.arange(new)] = -2
            k = min(6, b - a - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]  # for each fresh one the nearest of all
            one.append(np.repeat(other[a : a + new], k))
            two.append(other[a:b][near].ravel())
            sims.append(np.take_along_axis(s, near, 1).ravel())
            if b - a > new:  # and for each old one the nearest fresh ones
                s = s[:, new:].T
                k = min(4, new)
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                one.append(np.repeat(other[a + new : b], k))
                two.append(other[a : a + new][near].ravel())
                sims.append(np.take_along_axis(s, near, 1).ravel())
        if not one:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        one, two, sims = np.concatenate(one), np.concatenate(two), np.concatenate(sims)
        order = np.lexsort((two, one))
        one, two, sims = one[order], two[order], sims[order]
        first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        return pa.table({"id": one[first], "other": two[first], "sim": sims[first]})

    return met.groupBy("block").applyInArrow(compare, "id long, other long, sim double")


def build(table: DataFrame, blocks: int, dims: int) -> DataFrame:
    """The neighbour graph of ``table`` (id, vec): id, other, sim."""
    graph = materialize(_merge(_starts(table, dims), None, blocks), "graph")
    entries = graph.count()
    for turn in range(ROUNDS):
        graph = materialize(_merge(_local_join(graph, table, blocks, turn), graph, blocks), "graph")
        gc.collect()
        table.sparkSession.sparkContext._jvm.System.gc()  # lets the cleaner remove the last round's shuffle files
        if graph.where("fresh").count() < SETTLED * entries:
            break
    return graph.select("id", "other", "sim")


def _edges(graph: DataFrame) -> DataFrame:
    """id and to: neighbours both ways, of the reverse ones the nearest."""
    back = graph.select(F.col("other").alias("id"), F.col("id").alias("other"), "sim")
    back = back.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(F.col("n") <= NEIGHBOURS)
    return graph.select("id", "other").union(back.select("id", "other")).distinct()


def search(graph: DataFrame, table: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """query, other, sim: what each query (column ``query``, a node) keeps after greedy search."""
    edges = materialize(_edges(graph), "links")
    target = materialize(queries.join(table, queries["query"] == table["id"]).select("query", F.col("vec").alias("target")), "targets")
    # kept: what a query has met, with its similarity; done: whether it has been expanded.
    kept = materialize(queries.join(graph, queries["query"] == graph["id"]).select("query", "other", "sim", F.lit(False).alias("done")), "kept")
    first = Window.partitionBy("query").orderBy(F.desc("sim"), "other")
    for _ in range(SEARCH_ROUNDS):
        ranked = kept.withColumn("n", F.row_number().over(first)).where(F.col("n") <= BEAM)
        front = ranked.where("NOT done").withColumn("k", F.row_number().over(first)).where(F.col("k") <= EXPAND)
        front = materialize(front.select("query", "other"), "front")
        met = front.join(edges.select(F.col("id").alias("other"), F.col("other").alias("cand")), "other").select("query", "cand").where("query <> cand").distinct()
        met = met.join(kept.select("query", F.col("other").alias("cand")), ["query", "cand"], "left_anti")
        met = met.join(table.select(F.col("id").alias("cand"), "vec"), "cand").join(target, "query")

        def measure(batches):
            for b in batches:
                if b.num_rows:
                    sims = (_unit(b.column("vec")) * _unit(b.column("target"))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("query"), b.column("cand"), pa.array(sims)], ["query", "other", "sim"])

        new = met.select("query", "cand", "vec", "target").mapInArrow(measure, "query long, other long, sim double").withColumn("done", F.lit(False))
        was = kept.join(front.withColumn("f", F.lit(True)), ["query", "other"], "left").select("query", "other", "sim", (F.col("done") | F.coalesce(F.col("f"), F.lit(False))).alias("done"))
        kept = materialize(was.union(new), "kept")
        gc.collect()
        table.sparkSession.sparkContext._jvm.System.gc()
    return kept.withColumn("n", F.row_number().over(first)).where(F.col("n") <= BEAM).select("query", "other", "sim")


def nearest(df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    table, members = nodes(df, key, vector, k + 1)
    head = table.select(F.length("vec").alias("b")).first()
    dims, blocks = (head["b"] // 4 if head else 1), max(8, math.ceil(table.count() / BLOCK))
    graph = build(table, blocks, dims)
    # Every row is asked for, but a node is searched once: its members share what it finds.
    rows = df.select(F.col(f"`{key}`").cast("long").alias("q"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("q") % every == 0)
    asked = materialize(rows.join(materialize(members.join(df.select(F.col(f"`{key}`").cast("long").alias("node"), F.col(f"`{vector}`").cast("array<double>").alias("v")), "node").select("node", "v").distinct(), "nodesof"), "v").select("q", "node").distinct(), "asked")
    found = search(graph, table, asked.select(F.col("node").alias("query")).distinct(), blocks)
    found = found.union(asked.select(F.col("node").alias("query"), F.col("node").alias("other"), F.lit(1.0)).distinct())
    # Exact measure on the original vectors, in double precision; then members, and the first k of each query.
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "other"))).where(F.col("n") <= 4 * k + 1)
    origin = df.select(F.col(f"`{key}`").cast("long").alias("o"), F.col(f"`{vector}`").cast("array<double>").alias("w")).dropDuplicates(["o"])
    best = best.join(origin.select(F.col("o").alias("other"), F.col("w").alias("wo")), "other").join(origin.select(F.col("o").alias("query"), F.col("w").alias("wq")), "query")
    # Powers of two change no digit of the measure, but keep the sums of very large and very small components in range.
    near_one = lambda c: f"transform({c}, x -> x * pow(2D, -greatest(-1000D, floor(log2(array_max(transform({c}, y -> abs(y))))))))"
    best = best.withColumns({c: F.expr(near_one(c)) for c in ("wo", "wq")})
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    best = best.select("query", "other", F.expr(f"{dot('wo', 'wq')} / (sqrt({dot('wo', 'wo')}) * sqrt({dot('wq', 'wq')}))").alias("score"))
    full = asked.join(best, asked["node"] == best["query"]).select("q", "other", "score").join(members.withColumnRenamed("node", "other"), "other").where("q <> member")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "member")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")

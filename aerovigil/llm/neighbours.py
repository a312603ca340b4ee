"""Approximate nearest neighbours by cosine: a neighbour graph built by NN-descent, searched greedily.

Index. Equal vectors are one node, which keeps its smallest ids (as many as a result can name), so copies of one vector cost one
node. Every node starts with ``degree`` random neighbours. In each round a node's neighbours, and the nodes that name it, meet at
the node (neighbours of neighbours): a join brings their vectors, an exchange brings them together, and every member keeps its
best new partners among the others if they beat its worst neighbour. Only neighbours that are new since the last round are
tried again: ``sample`` of each node's own, all compared at that node, and as many of those that name it, chosen by hash.
Building ends when few neighbours change. Each node is then linked both ways.

Search. A query keeps its ``beam`` best nodes. Each round expands all nodes of the beam that are not yet expanded: they are
joined with the graph, the distinct nodes found are scored beside their vectors, block by block, and what beats the beam's worst
goes back to the query. It ends when no beam changes. All nodes of the beam that rounding could place among the best are scored
again in double precision on the original vectors.

Vectors travel as unit vectors in single precision and are compared by squared distance in double precision, so that near copies
are told apart down to distances of about 1e-6.

All rounds are Spark joins and exchanges; what a task holds is bounded by batches. Degree, sample and beam are search effort, no
caps on results.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of another length
than the most frequent one and rows without an id; rows alike in id and vector count once; a query never finds its own id; equal
scores are ordered by id; fewer candidates than asked give fewer rows; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovigil.session import discard, durable

DEGREE, SAMPLE, PARTNERS = 24, 12, 6
ROUNDS = 7              #: Most rounds of NN-descent.
SETTLED = 0.05          #: Share of changed neighbours at which building ends.
BEAM = 300
BLOCK = 1024            #: Nodes whose vectors stand together in the search.
ROUNDING = 1e-6         #: More than single precision can change a distance of unit vectors.
UNKNOWN, ANY = -4.0, -5.0  #: Score of a neighbour not yet compared; what every score beats. Scores are from -2 to 0.

_LIST = "u long, v array<int>, s array<float>, fresh array<boolean>, code binary"
_NAMES = ["u", "v", "s", "fresh", "code"]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, regrouped so that no key spans two."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = held.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


def _lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(values, kind))


def merge(lists: DataFrame, most: int) -> DataFrame:
    """The ``most`` best distinct v of each u over all its rows; equal (u, v) are fresh only if all are, and keep the best score.

    ``code``, the packed vector of u, comes from any row that has it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "u"):
            v, size = _flat(part.column("v"))
            s, fresh = _flat(part.column("s"))[0], _flat(part.column("fresh"))[0]
            row = part.column("u").to_numpy()
            u = np.repeat(row, size)
            known = np.flatnonzero(part.column("code").is_valid().to_numpy(zero_copy_only=False))
            code = dict(zip(row[known].tolist(), part.column("code").take(pa.array(known)).to_pylist()))
            order = np.lexsort((fresh, v, u))
            u, v, s, fresh = u[order], v[order], s[order], fresh[order]
            one = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))) if len(u) else np.empty(0, np.int64)
            u, v, fresh = u[one], v[one], fresh[one]
            s = np.maximum.reduceat(s, one) if len(one) else s
            order = np.lexsort((v, -s, u))
            u, v, s, fresh = u[order], v[order], s[order], fresh[order]
            first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(u)))
            keep = np.arange(len(u)) - np.repeat(first, size) < most
            size = np.minimum(size, most)
            yield pa.RecordBatch.from_arrays([pa.array(u[first]), _lists(v[keep], size, pa.int32()), _lists(s[keep], size, pa.float32()),
                                              _lists(fresh[keep], size, pa.bool_()), pa.array([code.get(x) for x in u[first].tolist()], pa.binary())], _NAMES)

    return lists.repartition("u").sortWithinPartitions("u").mapInArrow(run, _LIST)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Unit vectors in single precision."""
    unit = vectors / np.abs(vectors).max(1, keepdims=True)  # squares neither overflow nor vanish
    return [x.tobytes() for x in (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)]


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Matrix of packed vectors in double precision."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32)
    return raw.reshape(len(column), -1).astype(float) if len(column) else np.empty((0, 0))


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus half the squared distances of two matrices' rows: for unit vectors the cosine less 1, without its rounding."""
    return a @ b.T - (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None]) / 2


def nodes(rows: DataFrame, vec_id: str, vector: str, most_ids: int) -> tuple[DataFrame, int]:
    """(node, ids, vec, code): distinct valid vectors, numbered from 0, with their smallest ids; and how many there are."""
    clean = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    clean = clean.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    usual = clean.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = usual["n"] if usual else 0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            values = _flat(batch.column("vec"))[0].reshape(-1, dim) + 0.0
            keys = np.ascontiguousarray(values).view(np.dtype((np.void, 8 * dim))).ravel()
            order = np.lexsort((ids,))
            _, back = np.unique(keys[order], return_inverse=True)
            by = np.argsort(back, kind="stable")
            first = np.searchsorted(back[by], np.arange(back.max() + 1))
            own = [np.unique(ids[order][g])[:most_ids] for g in np.split(by, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([keys[order][by[f]].tobytes() for f in first], pa.binary()), pa.array(own, pa.list_(pa.int64()))],
                                             ["key", "ids"])

    some = clean.filter(F.size("vec") == dim).mapInArrow(fold, "key binary, ids array<long>")
    # At most ``most_ids`` ids per batch and vector reach the list.
    some = some.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most_ids).alias("ids"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n)), batch.column("key"), batch.column("ids")],
                                             ["task", "at", "key", "ids"])
            at += n

    cut = durable(some.mapInArrow(number, "task int, at long, key binary, ids array<long>"))
    held = {r["task"]: r["n"] for r in cut.groupBy("task").agg((F.max("at") + 1).alias("n")).collect()}  # a row per task
    base, total = {}, 0
    for task in sorted(held):
        base[task], total = total, total + held[task]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.array([base[t] for t in batch.column("task").to_pylist()], np.int64) + batch.column("at").to_numpy()
            vec = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.float64).reshape(-1, dim) if batch.num_rows else np.empty((0, dim))
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("ids"), pa.array(list(vec), pa.list_(pa.float64())),
                                              pa.array(packed(vec) if len(vec) else [], pa.binary())], ["node", "ids", "vec", "code"])

    return durable(cut.mapInArrow(finish, "node long, ids array<long>, vec array<double>, code binary")), total


def _dice(u: np.ndarray, v: np.ndarray, round_: int) -> np.ndarray:
    """A hash of two nodes that changes with the round."""
    code = (u * 0x9E3779B1 + v.astype(np.int64) * 0x85EBCA77 + round_ * 0xC2B2AE3D) & 0x7FFFFFFF
    return code * 0x27D4EB2F % 0x7FFFFFFF


def _place(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Place of each row among those with equal keys; ``order`` sorts the rows by the keys first."""
    place, n = np.empty(len(order), np.int64), len(order)
    other = np.zeros(max(0, n - 1), bool)
    for key in keys:
        other |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(np.concatenate(([True], other))) if n else np.empty(0, np.int64)
    place[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return place


def _meetings(graph: DataFrame, sample: int, round_: int) -> tuple[DataFrame, DataFrame]:
    """(centre, member, fresh): who meets where this round; and the graph with the tried neighbours no longer fresh.

    A centre's own chosen neighbours all meet there, so each neighbour marked as tried has been compared; of the nodes that name
    the centre at most ``sample`` fresh and as many others come, by hash.
    """
    def chosen(fresh: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of each u, at most ``sample`` fresh and as many other neighbours, by hash."""
        return _place(np.lexsort((_dice(u, v, round_), ~fresh, u)), u, fresh) < sample

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = _flat(batch.column("v"))
            fresh = _flat(batch.column("fresh"))[0].astype(bool)
            u = np.repeat(batch.column("u").to_numpy(), size)
            if len(u):
                use = chosen(fresh, u, v)
                u, v, fresh = u[use], v[use].astype(np.int64), fresh[use]
                own = np.arange(2 * len(u)) < len(u)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, v))), pa.array(np.concatenate((v, u))), pa.array(np.concatenate((fresh, fresh))),
                                                  pa.array(own)], ["centre", "member", "fresh", "own"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "centre"):
            c, m = part.column("centre").to_numpy(), part.column("member").to_numpy()
            fresh, own = (part.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("fresh", "own"))
            once = _place(np.lexsort((~own, ~fresh, m, c)), c, m) == 0
            c, m, fresh, own = c[once], m[once], fresh[once], own[once]
            use = _place(np.lexsort((_dice(c, m, round_), own, fresh, c)), c, fresh, own) < sample
            use &= np.isin(c, c[fresh])  # without a fresh member nothing is new
            yield pa.RecordBatch.from_arrays([pa.array(c[use]), pa.array(m[use]), pa.array(fresh[use])], ["centre", "member", "fresh"])

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = _flat(batch.column("v"))
            fresh = _flat(batch.column("fresh"))[0].astype(bool)
            u = np.repeat(batch.column("u").to_numpy(), size)
            if len(u):
                fresh = fresh & ~chosen(fresh, u, v)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), batch.column("s"), _lists(fresh, size, pa.bool_()), batch.column("code")], _NAMES)

    met = graph.mapInArrow(pairs, "centre long, member long, fresh boolean, own boolean")
    met = met.repartition("centre").sortWithinPartitions("centre").mapInArrow(cut, "centre long, member long, fresh boolean")
    return met, graph.mapInArrow(tried, _LIST)


def _local_join(meetings: DataFrame, codes: DataFrame, partners: int) -> DataFrame:
    """For every member, its best partners among those it meets, if they beat its worst neighbour."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "centre"):
            centre, member = part.column("centre").to_numpy(), part.column("member").to_numpy()
            fresh, worst = part.column("fresh").to_numpy(zero_copy_only=False).astype(bool), part.column("worst").to_numpy()
            vectors = unpacked(part.column("code"))
            bounds = np.append(np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1]))), len(centre))
            us, vs, ss, ns = [], [], [], []
            for a, b in zip(bounds, bounds[1:]):
                new, old = a + np.flatnonzero(fresh[a:b]), a + np.flatnonzero(~fresh[a:b])
                every = np.concatenate((new, old))
                score = closeness(vectors[new], vectors[every])
                score[member[new][:, None] == member[every][None]] = -9
                for rows, cols, grid in ((new, every, score), (old, new, score[:, len(new):].T)):
                    k = min(partners, grid.shape[1])
                    if not len(rows) or not k:
                        continue
                    best = np.argpartition(-grid, k - 1, axis=1)[:, :k]
                    s = np.take_along_axis(grid, best, axis=1)
                    ok = s > np.maximum(worst[rows][:, None], ANY)
                    n = ok.sum(1)
                    some = n > 0
                    us.append(member[rows][some])
                    ns.append(n[some])
                    vs.append(member[cols][best][ok])
                    ss.append(s[ok])
            if us:
                size, s = np.concatenate(ns), np.concatenate(ss)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), _lists(np.concatenate(vs), size, pa.int32()), _lists(s, size, pa.float32()),
                                                  _lists(np.ones(len(s), bool), size, pa.bool_()), pa.nulls(len(size), pa.binary())], _NAMES)

    met = meetings.join(codes, meetings.member == codes.node).select("centre", "member", "fresh", "worst", "code")
    return met.repartition("centre").sortWithinPartitions("centre").mapInArrow(run, _LIST)


def build(points: DataFrame, total: int, degree: int = DEGREE, sample: int = SAMPLE, partners: int = PARTNERS,
          rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(u, v, s, fresh): the neighbour graph after NN-descent."""
    if total <= 2 * degree:  # so few nodes that everyone may know everyone
        start = F.sequence(F.lit(0), F.lit(max(0, total - 1)))
        start = F.filter(start, lambda x: x != F.col("node"))
    else:
        start = F.transform(F.sequence(F.lit(0), F.lit(degree - 1)), lambda j: F.pmod(F.xxhash64(F.col("node"), j), F.lit(total)).cast("int"))
        start = F.filter(F.array_distinct(start), lambda x: x != F.col("node"))
    graph = points.select(F.col("node").alias("u"), start.alias("v"), "code")
    graph = durable(graph.select("u", "v", F.transform("v", lambda x: F.lit(UNKNOWN).cast("float")).alias("s"), F.transform("v", lambda x: F.lit(True)).alias("fresh"), "code"))
    most = 2 * degree if total <= 2 * degree else degree
    for k in range(rounds):
        meetings, tried = _meetings(graph, sample, k)
        known = graph.select(F.col("u").alias("node"), "code", F.when(F.size("v") < degree, ANY).otherwise(F.array_min("s")).cast("float").alias("worst"))
        before, graph = graph, durable(merge(tried.unionByName(_local_join(meetings, known, partners)), most))
        discard(before)
        changed = graph.agg(F.coalesce(F.sum(F.size(F.filter("fresh", lambda x: x))), F.lit(0))).first()[0]
        if changed <= settled * degree * total:
            break
    return graph


def both_ways(graph: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(node, near): neighbours of each node in either direction."""
    one = graph.select("u", F.explode(F.arrays_zip("v", "s")).alias("e")).select("u", "e.v", "e.s")
    back = one.select(F.col("v").cast("long").alias("u"), F.array(F.col("u").cast("int")).alias("v"), F.array("s").alias("s"), F.array(F.lit(False)).alias("fresh"),
                      F.lit(None).cast("binary").alias("code"))
    return merge(graph.drop("code").withColumn("code", F.lit(None).cast("binary")).unionByName(back), 2 * degree).select(F.col("u").alias("node"), F.col("v").alias("near"))


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """(q, node): of each query's final beam, the nodes that can be among its ``k`` best. ``queries``: (q, code, starts), with distinct q."""
    beam = max(beam, k)
    links = durable(both_ways(graph, degree))
    blocks = points.select(F.col("node"), F.col("code").alias("vector"), F.floor(F.col("node") / BLOCK).alias("block"))

    def first(rows: DataFrame) -> DataFrame:
        known = F.transform("starts", lambda x: F.when(x == F.col("q"), 0.0).otherwise(UNKNOWN).cast("float"))
        return rows.select(F.col("q").alias("u"), F.col("starts").alias("v"), known.alias("s"),
                           F.transform("starts", lambda x: F.lit(True)).alias("fresh"), "code")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's distinct found nodes, a row per block."""
        for part in _groups(batches, "q"):
            v, size = _flat(part.column("near"))
            row = np.repeat(np.arange(part.num_rows), size)
            q = part.column("q").to_numpy()
            row = np.searchsorted(q, q)[row]  # the first row of each query
            order = np.lexsort((v, row))
            row, v = row[order], v[order]
            new = np.ones(len(v), bool)
            new[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
            row, v = row[new], v[new]
            block = v.astype(np.int64) // BLOCK
            head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))) if len(v) else np.empty(0, np.int64)
            at = pa.array(row[head])
            yield pa.RecordBatch.from_arrays([pa.array(block[head]), *(part.column(c).take(at) for c in ("q", "least", "code")),
                                              _lists(v, np.diff(np.append(head, len(v))), pa.int32())], ["block", "q", "least", "code", "v"])

    def score(asked: pa.Table, here: pa.Table) -> pa.Table:
        here = here.sort_by("node")
        near, node = unpacked(here.column("vector")), here.column("node").to_numpy()
        half = np.einsum("ij,ij->i", near, near) / 2
        us, vs, ss, ns = [], [], [], []
        for part in asked.to_batches(max_chunksize=256):
            v, size = _flat(part.column("v"))
            owner = np.repeat(np.arange(part.num_rows), size)
            at = np.searchsorted(node, v)
            q = unpacked(part.column("code"))
            s = np.einsum("ij,ij->i", near[at], q[owner]) - half[at] - (np.einsum("ij,ij->i", q, q) / 2)[owner]
            ok = s > part.column("least").to_numpy()[owner]
            n = np.bincount(owner[ok], minlength=part.num_rows)
            us.append(part.column("q").to_numpy()[n > 0])
            ns.append(n[n > 0])
            vs.append(v[ok])
            ss.append(s[ok])
        if not us:
            us, ns, vs, ss = ([np.empty(0, t)] for t in (np.int64, np.int64, np.int32, np.float32))
        u, n, v, s = map(np.concatenate, (us, ns, vs, ss))
        return pa.Table.from_arrays([pa.array(u), _lists(v, n, pa.int32()), _lists(s, n, pa.float32()),
                                     _lists(np.ones(len(v), bool), n, pa.bool_()), pa.nulls(len(n), pa.binary())], _NAMES)

    now = durable(first(queries))
    while now.filter(F.exists("fresh", lambda x: x)).limit(1).count():
        least = F.when(F.size("v") < beam, ANY).otherwise(F.array_min("s")).cast("float")
        open_ = now.select(F.col("u").alias("q"), least.alias("least"), "code", F.explode(F.expr("filter(v, (x, i) -> fresh[i])")).alias("node"))
        open_ = open_.withColumn("node", F.col("node").cast("long"))
        found = open_.join(links, "node").select("q", "least", "code", "near").repartition("q").sortWithinPartitions("q")
        found = found.mapInArrow(spread, "block long, q long, least float, code binary, v array<int>")
        found = found.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(score, _LIST)
        done = now.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
        before, now = now, durable(merge(done.unionByName(found), beam))
        discard(before)
    discard(links)
    far = F.transform("s", lambda x: F.sqrt(F.greatest(F.lit(0.0), -2 * x.cast("double"))))  # ascending, as the beam is by score
    best = now.select(F.col("u").alias("q"), F.explode(F.arrays_zip("v", far.alias("far"))).alias("e"),
                      F.coalesce(F.get(far, F.lit(k - 1)), F.lit(9.0)).alias("limit"))
    best = best.select("q", F.col("e.v").cast("long").alias("node"), F.col("e.far").alias("far"), "limit")
    return best.filter(F.col("far") <= F.col("limit") + ROUNDING).select("q", "node")


def nearest(rows: DataFrame, asked: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE,
            sample: int = SAMPLE, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other ids found for each row of ``asked``, a part of ``rows``."""
    points, total = nodes(rows, vec_id, vector, k + 1)
    graph = build(points, total, degree, sample)
    mine, _ = nodes(asked, vec_id, vector, 1)  # distinct query vectors; all their ids follow below
    mine = mine.select("vec", "code")
    here = points.select(F.col("node").alias("q"), "vec")
    queries = durable(mine.join(here, "vec").select("q", "code", F.array(F.col("q").cast("int")).alias("starts")))
    found = search(graph, points, queries, k + 1, beam, degree)  # one of them is the query's own node
    scored = found.join(points.select(F.col("node").alias("q"), F.col("vec").alias("a")), "q").join(points.select("node", "ids", F.col("vec").alias("b")), "node")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (_flat(batch.column(c))[0].reshape(n, -1) for c in ("a", "b"))
            a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))  # squares neither overflow nor vanish
            value = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(value)], ["q", "ids", "score"])

    scored = scored.select("q", "ids", "a", "b").mapInArrow(cosine, "q long, ids array<long>, score double")
    # The k + 1 best ids of a node answer every query with that vector: at most one of them is the query itself.
    each = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    top = each.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("best"))
    ids = asked.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vec")).filter("query_id is not null and vec is not null").distinct()
    ids = ids.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).join(here, "vec").select("query_id", "q")
    out = ids.join(top, "q").select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.far")).alias("score"))

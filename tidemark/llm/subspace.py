"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine at least c lie within squared distance 2 - 2c. After an orthogonal
rotation the coordinates are split into ``BLOCKS`` blocks; some block then holds at most its
proportional share of that distance. Each block is joined on its own, within a range of the
root of that share. A pair found in a block is dropped if an earlier block holds it too, and is
otherwise confirmed on whole vectors in double precision, so every link is counted exactly once.
Pairs never leave a task: it returns link counts by vector and a star for each connected part.

How vectors meet, both ways exact:

* Dense groups. Heads are chosen where a bounded sample is dense; vectors within half of the
  link angle of a head form its ball. Any two of a ball are linked by the triangle inequality and
  are never compared: its members get their counts from its total weight, so a third of all rows
  in one group costs one pass. Other vectors visit a ball only within the link angle of it.
* All others are joined block by block in the cells of pivots, sub-vectors drawn from the same
  sample. A vector stays in its nearest pivot's cell and visits those of lower number whose
  bisecting plane is within the range: a partner beyond the plane is at least that far away.

The sample steers only where vectors meet; results do not depend on it. Equal vectors are one node
with a weight. Cells of many vectors are cut into chunks of at most ``CHUNK`` rows and
``CHUNK_BYTES``, compared chunk by chunk, so a task holds two chunks at most. Vectors spread evenly
over all directions are within range of most planes: no exact method prunes there, and the join
costs a constant share of all pairs, by matrix products on one block each.

Edge cases: null or empty vectors, zero vectors, and vectors with null, NaN or infinite
components link with nothing and are their own component; vectors of different lengths never
link; rows repeating an id are separate vectors; vectors that tie for a head or a pivot take the
first; null ids form no component id unless alone; an empty table gives an empty result. Vectors
of any length are held whole. Extra columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.runtime import shuffle_width, stash, temporary

BLOCKS = 4
#: Rows of a chunk, and the bytes of its vectors in double precision.
CHUNK, CHUNK_BYTES = 8192, 32 << 20
TILE = 1024
#: Vectors of a cell that are aimed at, and the most pivots of a block.
CELL, PIVOTS = 16_384, 256
#: The sample that heads and pivots come from, in vectors and bytes; heads stand where it holds
#: ``DENSE`` vectors or more.
SAMPLE, SAMPLE_BYTES, DENSE, HEADS = 4096, 32 << 20, 4, 512
_SIGNS = np.where(np.random.default_rng(11).random(1 << 14) < 0.5, -1.0, 1.0)


def _unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows to length 1; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotate(x: np.ndarray) -> np.ndarray:
    """Random signs, then a Walsh-Hadamard transform, twice; row by row the same in any batch."""
    width = 1 << max(2, (x.shape[1] - 1).bit_length())
    signs = np.resize(_SIGNS, width)
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for turn in range(2):
        out *= np.roll(signs, turn)
        step = 1
        while step < width:
            out = out.reshape(len(x), -1, 2, step)
            out = np.concatenate([out[:, :, :1] + out[:, :, 1:], out[:, :, :1] - out[:, :, 1:]], axis=2).reshape(len(x), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, array) -> (id, dim, vec): the components' bytes, null if it can't link.

    Single precision where it holds the values exactly, else double; -0.0 and 0.0 are one value.
    """
    for batch in batches:
        dims, out = [], []
        for v in batch.column(1):
            raw = None
            if v.is_valid and len(v) and v.values.null_count == 0:
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(a).all() and a.any():
                    with np.errstate(over="ignore"):
                        short = a.astype(np.float32)
                    raw = ((short if (short == a).all() else a) + 0.0).tobytes()
            out.append(raw)
            dims.append(len(v) if raw else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim))
    wide = np.array([len(r) == 8 * dim for r in raw], bool)
    for some, kind in ((wide, np.float64), (~wide, np.float32)):
        if some.any():
            out[some] = np.frombuffer(b"".join(raw[i] for i in np.flatnonzero(some)), kind).reshape(-1, dim)
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, rotated unit vectors) of each length in a batch."""
    raw, dims = batch.column("vec").to_pylist(), batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, rotate(_unit_vectors(_matrix([raw[r] for r in rows], d)))


class Budget:
    """Shares of the squared distance by block of a rotated vector of ``width`` coordinates."""

    def __init__(self, cosine: float, width: int):
        self.blocks = min(BLOCKS, width)
        self.size = width // self.blocks
        self.most = (2 - 2 * cosine) / self.blocks * (1 + 1e-9) + 1e-12
        self.radius = np.sqrt(self.most) * (1 + 1e-9) + 1e-12

    def part(self, turned: np.ndarray, block: int) -> np.ndarray:
        return turned[:, block * self.size : (block + 1) * self.size]


class Layout:
    """Where vectors of one length meet: balls first, then the cells of each block.

    Places are numbered from ``start``: the balls, then block by block the cells.
    """

    def __init__(self, cosine: float, sample: np.ndarray, count: int, start: int):
        self.budget = Budget(cosine, sample.shape[1])
        angle = np.arccos(np.clip(cosine, -1, 1))
        half = angle / 2 - 1e-7
        self.inside, self.reach = np.cos(half) if half > 0 else 2.0, np.cos(min(np.pi, angle + max(half, 0) + 1e-7))
        self.heads = self._dense(sample)
        pivots = min(PIVOTS, max(1, count // CELL), len(sample))
        near = (sample @ self.heads.T >= self.inside).any(axis=1) if len(self.heads) else np.zeros(len(sample), bool)
        rest = sample[~near] if (~near).any() else sample
        self.pivots = [self.budget.part(rest[: min(pivots, len(rest))], b) for b in range(self.budget.blocks)]
        self.start = start
        self.places = len(self.heads) + sum(len(p) for p in self.pivots)

    def _dense(self, sample: np.ndarray) -> np.ndarray:
        """Sample vectors with most others around them, none within reach of another's ball."""
        counts = np.concatenate([(sample[k : k + 512] @ sample.T >= self.inside).sum(axis=1) for k in range(0, len(sample), 512)])
        heads: list[int] = []
        for i in np.argsort(-counts, kind="stable").tolist():
            if counts[i] < DENSE or len(heads) == HEADS:
                break
            if not heads or (sample[heads] @ sample[i]).max() < self.inside:
                heads.append(i)
        return sample[heads]

    def block_of(self, place: int) -> int:
        """-1 for a ball."""
        at = place - self.start - len(self.heads)
        for b, p in enumerate(self.pivots):
            if at < len(p):
                return b if at >= 0 else -1
            at -= len(p)
        raise ValueError(place)

    def balls(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ball of each vector or -1, and the vectors' cosines with all heads."""
        if not len(self.heads):
            return np.full(len(x), -1), np.empty((len(x), 0))
        cosines = x @ self.heads.T
        best = cosines.argmax(axis=1)
        return np.where(cosines[np.arange(len(x)), best] >= self.inside, best, -1), cosines

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, role) of all stays (role 0) and visits (role 1)."""
        ball, cosines = self.balls(x)
        found = [(np.flatnonzero(ball >= 0), ball[ball >= 0], 0)]
        # Of two balls, members of the later one visit the earlier.
        i, h = np.nonzero(cosines >= self.reach)
        ok = (ball[i] < 0) | (h < ball[i])
        found.append((i[ok], h[ok], 1))
        free, at = np.flatnonzero(ball < 0), len(self.heads)
        for b, pivots in enumerate(self.pivots):
            sub = self.budget.part(x[free], b)
            square = (sub * sub).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * sub @ pivots.T
            home = square.argmin(axis=1)
            apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
            visit = square - square[np.arange(len(sub)), home][:, None] <= 2 * self.budget.radius * apart[home] + 1e-9
            i, c = np.nonzero(visit & (np.arange(len(pivots))[None, :] < home[:, None]))
            found += [(free, home + at, 0), (free[i], c + at, 1)]
            at += len(pivots)
        role = np.concatenate([np.full(len(i), r, np.int32) for i, _, r in found])
        return np.concatenate([i for i, _, _ in found]), np.concatenate([p for _, p, _ in found]) + self.start, role


def _count(layouts: dict[int, Layout]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in _by_length(batch):
                _, place, role = layouts[d].assign(x)
                key, n = np.unique(place * 2 + role, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array((key & 1).astype(np.int32)), pa.array(n.astype(np.int64))], ["place", "role", "n"])

    return run


def _members(layouts: dict[int, Layout]) -> Callable:
    """(node, weight, dim, vec) -> (node, weight, ball) of those in a ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch):
                ball = layouts[d].balls(x)[0]
                take = pa.array(rows[ball >= 0])
                yield pa.RecordBatch.from_arrays([batch.column("node").take(take), batch.column("weight").take(take), pa.array(ball[ball >= 0] + layouts[d].start)], ["node", "weight", "ball"])

    return run


def _deal(layouts: dict[int, Layout], chunks: np.ndarray) -> Callable:
    """(node, weight, dim, vec) -> (unit, role, node, weight, dim, vec).

    ``chunks`` has the chunks of those who stay and of visitors by place. A unit is a chunk of
    those who stay (role 0) against another chunk (role 1); a chunk meets itself in the unit that
    names it twice, where the first visitors come along. Those of a ball meet visitors only.
    """
    balls = np.zeros(len(chunks), bool)
    for x in layouts.values():
        balls[x.start : x.start + len(x.heads)] = True

    def units(node: np.ndarray, row: np.ndarray, place: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, ...]:
        mix = (node[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        own, guests, ball, stays = chunks[place, 0], chunks[place, 1], balls[place], role == 0
        mine = (mix % np.maximum(1, np.where(stays, own, guests)).astype(np.uint64)).astype(np.int64)
        n = np.where(stays, np.where(ball, guests, own + np.maximum(0, guests - 1)), own)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, place, stays, ball, mine, own = (np.repeat(a, n) for a in (row, place, stays, ball, mine, own))
        # Of a cell: chunk k of those who stay, or beyond them a chunk of visitors.
        pair = stays & ~ball & (k < own)
        first = np.where(pair, np.minimum(mine, k), np.where(stays, mine, k))
        guest = np.where(stays, np.where(ball, k, k - own + 1), mine)
        second = np.where(pair, np.maximum(mine, k), np.where(~ball & (guest == 0), first, own + guest))
        return (place << 40) | (first << 20) | second, np.where(stays & ~(pair & (k < mine)), 0, 1), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                node = batch.column("node").to_numpy()
                for d, rows, x in _by_length(batch):
                    row, place, role = layouts[d].assign(x)
                    unit, role, row = units(node, rows[row], place, role)
                    for k in range(0, len(row), 8192):
                        take = pa.array(row[k : k + 8192])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(unit[k : k + 8192]), pa.array(role[k : k + 8192].astype(np.int32)), *[batch.column(c).take(take) for c in ("node", "weight", "dim", "vec")]],
                            ["unit", "role", "node", "weight", "dim", "vec"],
                        )

    return run


class Links:
    """Link counts and connected parts of the rows of a unit, fed pair by pair."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.links, self.label = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        np.add.at(self.links, u, self.weight[v])
        np.add.at(self.links, v, self.weight[u])
        label = self.label
        while True:
            a, b = label[u], label[v]
            if not (more := a != b).any():
                return
            u, v, a, b = u[more], v[more], a[more], b[more]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up


def _meet(cosine: float, budget: Budget, block: int, itself: bool, x: np.ndarray, turned: np.ndarray, role: np.ndarray, out: Links) -> None:
    """Feeds the links of a unit to ``out``: inside a block, or on whole vectors for a ball (-1)."""
    near = turned if block < 0 else budget.part(turned, block)
    order = np.argsort(near[:, 0], kind="stable")
    own, other = order[role[order] == 0], order[role[order] == 1]
    most = 2 - 2 * cosine if block < 0 else budget.most
    radius = np.sqrt(max(0.0, most)) * (1 + 1e-9) + 1e-9
    first = near[:, 0]
    # Squared distances come out of one product of rows that carry their own squares.
    square = (near * near).sum(axis=1)
    left = np.concatenate([-2 * near, square[:, None], np.ones((len(near), 1))], axis=1).astype(np.float32)
    right = np.concatenate([near, np.ones((len(near), 1)), square[:, None]], axis=1).astype(np.float32)

    def tile(a: np.ndarray, b: np.ndarray, same: bool) -> None:
        gap = left[a] @ right[b].T
        if gap.min(initial=np.inf) > most + 1e-4:
            return
        s, t = np.nonzero(gap <= most + 1e-4)
        if same:
            s, t = s[s < t], t[s < t]
        for k in range(0, len(s), 20_000):
            u, v = a[s[k : k + 20_000]], b[t[k : k + 20_000]]
            if block >= 0:
                delta = turned[u] - turned[v]
                held = (delta * delta).reshape(len(u), budget.blocks, -1).sum(axis=2) <= budget.most
                ok = (held.argmax(axis=1) == block) & held[:, block]
                u, v = u[ok], v[ok]
            ok = (x[u] * x[v]).sum(axis=1) >= cosine
            out.add(u[ok], v[ok])

    for i in range(0, len(own), TILE):
        a = own[i : i + TILE]
        if itself and block >= 0:
            for j in range(i, len(own), TILE):
                if first[own[j]] > first[a[-1]] + radius:
                    break
                tile(a, own[j : j + TILE], i == j)
        lo, hi = np.searchsorted(first[other], [first[a[0]] - radius, first[a[-1]] + radius])
        for j in range(int(lo), int(hi), TILE):
            tile(a, other[j : min(j + TILE, int(hi))], False)


def _join(cosine: float, layouts: dict[int, Layout]) -> Callable:
    """Sorted unit rows -> (node, links, grp): link weights seen, and the least node of its part."""

    def one(unit: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(parts)
        role, node = table.column("role").to_numpy(), table.column("node").to_numpy()
        d = table.column("dim")[0].as_py()
        block, itself = layouts[d].block_of(unit >> 40), (unit >> 20) & 0xFFFFF == unit & 0xFFFFF
        if (role == 0).all() and (not itself or block < 0) or (role == 1).all():
            return None
        x = _unit_vectors(_matrix(table.column("vec").to_pylist(), d))
        out = Links(table.column("weight").to_numpy())
        _meet(cosine, layouts[d].budget, block, itself, x, rotate(x), role, out)
        some = out.links > 0
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, out.label, node)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(out.links[some]), pa.array(least[out.label][some])], ["node", "links", "grp"]) if some.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []
        for batch in batches:
            names = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if names[s] != unit:
                    if parts and (out := one(unit, parts)):
                        yield out
                    unit, parts = int(names[s]), []
                parts.append(batch.slice(s, e - s))
        if parts and (out := one(unit, parts)):
            yield out

    return run


def layouts_of(nodes: DataFrame, cosine: float) -> dict[int, Layout]:
    """A layout for each length of vectors, from the sample of least hashes.

    The driver holds at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``, and a count for each length.
    """
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(counts, default=1))))
    drawn = nodes.select("dim", "vec").orderBy(F.xxhash64("vec")).limit(most).toArrow()
    out, start = {}, 0
    dims = drawn.column("dim").to_numpy()
    raw = drawn.column("vec").to_pylist()
    for d in sorted(counts):
        mine = [raw[i] for i in np.flatnonzero(dims == d)]
        # A length that the sample misses has one cell, around no vector in particular.
        sample = rotate(_unit_vectors(_matrix(mine, d) if mine else np.ones((1, d))))
        out[d] = Layout(cosine, sample, counts[d], start)
        start += out[d].places
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    with temporary(spark):
        rows = stash(vectors.select(vec_id, embedding).mapInArrow(_vectors, f"vec_id {id_type}, dim int, vec binary"), "vectors")
        nodes = rows.where("vec is not null").groupBy("dim", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
        nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
        layouts = layouts_of(nodes, cosine)
        met = stash(_met(nodes, cosine, layouts), "vector-links")
        groups = components(met.select("node"), met.select(F.col("node").alias("a"), F.col("grp").alias("b")))
        links = met.groupBy("node").agg(F.sum("links").alias("links")).join(groups, "node")
        full = nodes.join(links, "node", "left").select("dim", "vec", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("grp", "node").alias("grp"))
        smallest = full.groupBy("grp").agg(F.min("least").alias("component_id"))
        full = stash(full.join(smallest, "grp").select("dim", "vec", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-groups")
        out = rows.join(full, ["dim", "vec"], "left").withColumn("component_id", F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
        return stash(out, "vector-result", lasting=True)


def dealt(nodes: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """(unit, role, node, weight, dim, vec): every vector in all units where it stays or visits."""
    counts = nodes.select("dim", "vec").mapInArrow(_count(layouts), "place bigint, role int, n bigint").groupBy("place", "role").agg(F.sum("n").alias("n"))
    chunks = np.zeros((max((x.start + x.places for x in layouts.values()), default=0), 2), np.int64)
    held = {x.start + k: max(1, min(CHUNK, CHUNK_BYTES // (8 * d))) for d, x in layouts.items() for k in range(x.places)}
    for r in counts.collect():  # two for each place, of which heads and pivots make a bounded number
        chunks[r["place"], r["role"]] = -(-r["n"] // held[r["place"]])
    return nodes.select("node", "weight", "dim", "vec").mapInArrow(_deal(layouts, chunks), "unit bigint, role int, node bigint, weight bigint, dim int, vec binary")


def _met(nodes: DataFrame, cosine: float, layouts: dict[int, Layout]) -> DataFrame:
    """(node, links, grp): the links of balls by their totals, all others by comparing."""
    units = dealt(nodes, layouts).repartition(shuffle_width(nodes.sparkSession), "unit").sortWithinPartitions("unit")
    found = units.mapInArrow(_join(cosine, layouts), "node bigint, links bigint, grp bigint")
    members = stash(nodes.select("node", "weight", "dim", "vec").mapInArrow(_members(layouts), "node bigint, weight bigint, ball bigint"), "vector-balls")
    totals = members.groupBy("ball").agg(F.sum("weight").alias("total"), F.min("node").alias("grp"))
    # At most HEADS balls for each length.
    inside = members.join(F.broadcast(totals), "ball").select("node", (F.col("total") - F.col("weight")).alias("links"), "grp")
    return found.unionByName(inside.where("links > 0"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The contract over all pairs.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r AS (
  SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l
), c AS (
  SELECT x, y FROM r UNION SELECT c.x, r.y FROM c JOIN r ON r.x = c.y
), m AS (SELECT x, min(y) AS y FROM c GROUP BY x), k AS (SELECT x, count(*) AS n FROM r GROUP BY x)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.y, vec_id)) AS component_id, vec_id <= coalesce(m.y, vec_id) AS kept
FROM v LEFT JOIN m ON m.x = vec_id LEFT JOIN k ON k.x = vec_id
"""

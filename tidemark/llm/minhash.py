"""MinHash near-duplicate detection with tensored banding.

A table key joins one sub-key of a first collection with one of a second, so ``SIDE`` sub-keys on
each side make ``SIDE``^2 tables out of 2 * SIDE * ROWS minhash functions, about a square root
of what separate tables need. Two documents at similarity 0.8 share no key with probability
1.3e-6 (both sides share a sub-key each with probability 1 - 0.488^20). The second half of a key is joined inside the bucket of the first, so a document
sends ``SIDE`` rows, not ``SIDE``^2.

Documents with equal shingle sets are one node. In each bucket of a key all members point to its
first one (never to each other), and links are confirmed on full sets:

1. each node is compared with the head it shares most keys with, twice; links merge nodes;
2. groups that share a key and are not linked are then compared exhaustively, in blocks of their
   members, so no link between groups is lost. Inside a merged group
   further links change nothing and are not sought.

Edge cases: null or empty texts and texts without words have an empty set, link with nothing and
are their own component; a text with fewer words than a shingle is one shingle; rows repeating an
id are separate rows of equal sets when their texts agree; a null id is never a component's id
unless no member has one; an empty table gives an empty result; texts of any length are shingled
whole, one at a time, and compared by their whole sets. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.runtime import sheltered, shuffle_width, small_batches, stash, temporary

SIDE, ROWS = 20, 3
BLOCK = 256
#: Cells of a set's grid: elements counted by hash, an upper bound of any intersection; 255 is
#: that many or more and proves nothing.
CELLS = 64
#: Numbers of at most so many rows or nodes are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Grids of at most so many nodes (64 bytes each) are broadcast.
BROADCAST_GRIDS = 300_000
#: Unit lists of at most so many rows (about 60 bytes each) are broadcast.
BROADCAST_ROWS = 250_000
MEMO_WORDS = 150_000

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, hashes: _Hashes) -> np.ndarray:
    """The document's set: sorted distinct 64-bit hashes of its shingles of ``size`` words.

    bytes.lower and bytes.split know ASCII only: letters A-Z, and \\x20 and \\x09-\\x0D as spaces.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < size:
        return _mix(np.array([(h * _PLACE[:n]).sum() + np.uint64(n)], np.uint64))
    total = h[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        total = total + h[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(_mix(total))


def signature(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sub-keys of both sides: 64 bits on the first. The second is compared only within a bucket of
    the first, where 8 bits tell most apart; chance agreements are candidates like any other."""
    least = np.empty(len(_FLIP), np.uint64)
    for k in range(0, len(items), 2048):
        part = ((items[None, k : k + 2048] ^ _FLIP[:, None]) * _MULTIPLY[:, None]).min(axis=1)
        least = part if k == 0 else np.minimum(least, part)
    sub = least.reshape(2 * SIDE, ROWS)
    keys = sub[:, 0] * _PLACE[0]
    for r in range(1, ROWS):
        keys = keys + sub[:, r] * _PLACE[r]
    keys = _mix(keys + np.arange(2 * SIDE, dtype=np.uint64))
    return keys[:SIDE], keys[SIDE:].astype(np.uint8)


def _sketch(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, n, same, firsts, seconds, grid, items): same is a digest of the set."""
    from hashlib import md5

    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                rows = []
                for x in batch.column(1):
                    s = shingles(x.as_py(), size, hashes)
                    raw = s.tobytes()
                    a, b = signature(s) if len(s) else (np.empty(0, np.int64), np.empty(0, np.uint8))
                    grid = np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).clip(max=255).astype(np.uint8)
                    rows.append((len(s), md5(raw).digest(), a.astype(np.uint64).view(np.int64), b.tobytes(), grid.tobytes(), raw))
                n, same, a, b, grid, raw = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.binary()), pa.array(grid, pa.binary()), pa.array(raw, pa.binary())],
                    ["doc_id", "n", "same", "firsts", "seconds", "grid", "items"],
                )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type}, n bigint, same binary, firsts array<bigint>, seconds binary, grid binary, items binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted batches as tables that end where a key ends; a key of many rows comes in parts.

    With each table comes whether its first key goes on from the table before.
    """
    held: list[pa.RecordBatch] = []
    count, goes_on = 0, False

    def cut(last: bool) -> tuple[pa.Table | None, list, bool]:
        table = pa.Table.from_batches(held)
        cols = [table.column(k).to_numpy() for k in keys]
        if last or table.num_rows == 0:
            return table, [], False
        differs = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        if len(differs) == 0:
            return table, [], True
        end = int(differs[-1]) + 1
        return table.slice(0, end), table.slice(end).to_batches(), False

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table, held, more = cut(False)
            yield table, goes_on
            goes_on, count = more, sum(b.num_rows for b in held)
    if count:
        yield cut(True)[0], goes_on


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (first, node, seconds) sorted by first and node: (node, head) of the tables.

    Within a bucket of the first side, members that agree on a second sub-key share a table.
    Tables that share members are taken together; the head is the first of all of them. A bucket
    too large for one part streams through, each table with the first of its members as its head;
    what is kept between parts is one head for each second sub-key, at most SIDE * 256.
    """
    open_key: int | None = None
    open_heads: np.ndarray | None = None
    for table, goes_on in _grouped(batches, ["first"], 50_000):
        first, node = table.column("first").to_numpy(), table.column("node").to_numpy()
        n = len(first)
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        last_open = len(starts) - 1
        keep = sizes[group] > 1
        if goes_on and open_key == first[0]:
            keep[: sizes[0]] = True
        # The last bucket may go on in the next part.
        keep[starts[last_open] :] = True
        index = np.flatnonzero(keep)
        seconds = np.frombuffer(b"".join(table.column("seconds").take(pa.array(index)).to_pylist()), np.uint8).reshape(len(index), SIDE)
        sub = (np.arange(SIDE, dtype=np.int64) << 8)[None, :] | seconds.astype(np.int64)
        key = ((group[index].astype(np.int64) << 32)[:, None] | sub).ravel()
        owner = np.repeat(node[index], SIDE)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        head = owner[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        unique, heads = key[begins], owner[begins]
        if goes_on and open_key == first[0] and open_heads is not None:
            own = (key >> 32) == 0
            known = open_heads[key[own] & 0xFFFFFFFF]
            head[own] = np.where(known >= 0, known, head[own])
            mine = (unique >> 32) == 0
            known = open_heads[unique[mine] & 0xFFFFFFFF]
            heads[mine] = np.where(known >= 0, known, heads[mine])
            carried = open_heads
        else:
            carried = None
        mine = (unique >> 32) == last_open
        if not (last_open == 0 and carried is not None):
            carried = np.full(SIDE << 8, -1, np.int64)
        carried[unique[mine] & 0xFFFFFFFF] = heads[mine]
        open_key, open_heads = int(first[-1]), carried
        whole = np.ones(len(starts), bool)
        whole[last_open] = False
        whole[0] &= not goes_on
        together = whole[key >> 32]
        head = np.where(together, _together(head, owner, key >> 32, begins), head)
        real = owner != head
        if real.any():
            pair = np.unique(np.stack([owner[real], head[real]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["node", "head"])


def _together(head: np.ndarray, owner: np.ndarray, bucket: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Least node that an entry's owner is joined with through the tables of its bucket."""
    first, table = np.flatnonzero(begins), np.cumsum(begins) - 1
    member = np.unique(np.stack([bucket, owner], axis=1), axis=0, return_inverse=True)[1].ravel()
    label = head
    while True:
        own = np.full(len(member), np.iinfo(np.int64).max)
        np.minimum.at(own, member, label)
        new = np.minimum.reduceat(own[member], first)[table]
        if (new == label).all():
            return label
        label = new


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (unit, role, node, grp, items) sorted by unit and role: confirmed links.

    Role 0 rows of a unit, at most a few hundred, are held in an inverted index; each row of the
    unit, role 0 or 1, is compared with all of them that are in other groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        unit, index = None, None
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            units, roles, nodes, groups, items = batch.columns
            for u, role, node, group, raw in zip(units.to_pylist(), roles.to_pylist(), nodes.to_pylist(), groups.to_pylist(), items, strict=True):
                if u != unit:
                    unit, held, index = u, [], None
                    if found:
                        yield _links(found)
                        found = {}
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    for other, g, t in held:
                        if g != group and (min(g, group), max(g, group)) not in found and _similar(s, t, percent):
                            found[min(g, group), max(g, group)] = (node, other)
                    held.append((node, group, s))
                    index = None
                    continue
                if index is None:
                    values = np.concatenate([t for _, _, t in held])
                    owners = np.repeat(np.arange(len(held)), [len(t) for _, _, t in held])
                    order = np.argsort(values, kind="stable")
                    index = values[order], owners[order], np.array([len(t) for _, _, t in held])
                values, owners, sizes = index
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                hit = hi > lo
                lo, hi = lo[hit], hi[hit]
                n = hi - lo
                spots = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
                both = np.bincount(owners[spots], minlength=len(held)) if len(n) else np.zeros(len(held), np.int64)
                for k in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)):
                    other, g, _ = held[k]
                    if g != group:
                        found.setdefault((min(g, group), max(g, group)), (node, other))
        if found:
            yield _links(found)

    return run


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _links(found: dict) -> pa.RecordBatch:
    a, b = zip(*found.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_units(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (unit, role, node, grp, items) -> links (a, b); units are small, so they spread evenly."""
    width = shuffle_width(rows.sparkSession)
    return rows.repartition(width, "unit").sortWithinPartitions("unit", "role").select("unit", "role", "node", "grp", "items").mapInArrow(_confirm(percent), "a bigint, b bigint")


def _unit(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def near_duplicates(docs: DataFrame, size: int, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document."""
    small_batches(docs.sparkSession)
    with temporary(docs.sparkSession):
        rows = stash(_sketch(docs, doc_id, text, size).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
        sets = rows.groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
        # Documents without words stay single.
        sets = stash(sets.where(F.col("same") != F.unhex(F.md5(F.lit("")))), "minhash-sets")
        grouped = _merge(rows, sets, percent)
        least = sets.join(grouped, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        smallest = least.groupBy("grp").agg(F.min("least").alias("component_id"))
        by_set = least.join(smallest, "grp").select("same", "component_id")
        out = rows.select("doc_id", "n", "same").join(by_set, "same", "left")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
        return stash(out, "minhash-result", lasting=True)


def _merge(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, grp) for the nodes that share a key with others."""
    spark = rows.sparkSession
    count = sets.count()
    nodes = rows.join(_small(sets.select(F.col("node").alias("row")), count), "row", "left_semi")
    buckets = nodes.select(F.col("row").alias("node"), F.explode("firsts").alias("first"), "seconds")
    width = max(shuffle_width(spark), count * SIDE // 1_000_000)
    heads = buckets.select("first", "node", "seconds").repartition(width, "first").sortWithinPartitions("first", "node").mapInArrow(_heads, "node bigint, head bigint")
    edges = heads.groupBy("node", "head").agg(F.count(F.lit(1)).alias("keys"))
    edges = stash(edges, "minhash-edges")
    active = stash(edges.select("node").union(edges.select("head")).distinct(), "minhash-nodes")
    active = stash(rows.select(F.col("row").alias("node"), "n", "grid").join(_small(active, active.count()), "node"), "minhash-active")
    edges = stash(_possible(edges, active, percent), "minhash-heads")
    active = active.drop("grid")
    items = rows.select(F.col("row").alias("node"), "items")
    group = active.withColumn("grp", F.col("node"))

    links = None
    tested = None
    for _ in range(2):
        left = edges if tested is None else edges.join(tested, ["node", "head"], "left_anti")
        left = _open(left, group).where("may")
        pick = stash(left.groupBy("node").agg(F.max_by("head", F.struct("keys", -F.col("head"))).alias("head")), "minhash-picked")
        tested = pick if tested is None else tested.unionByName(pick)
        found = stash(_in_units(_star_rows(pick, items), percent), "minhash-links")
        links = found if links is None else links.unionByName(found)
        group = _sized(active, components(active, links))
    left = stash(_open(edges, group), "minhash-open")
    found = stash(_in_units(_block_rows(left, tested, group, items, percent), percent), "minhash-links")
    return components(active, links.unionByName(found))


def _possible(edges: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """``edges`` with ``may``: false if the grids prove that the sets are not similar enough.

    An intersection holds at most the smaller count of each cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for c in (3, 4))
            both = np.minimum(a, b).sum(axis=1)
            may = 100 * both >= percent * (a.sum(axis=1) + b.sum(axis=1) - both)
            may |= ((a == 255) | (b == 255)).any(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(may)], ["node", "head", "keys", "may"])

    grids = active.select("node", "grid")
    grids = F.broadcast(grids) if active.count() <= BROADCAST_GRIDS else grids
    pairs = edges.join(grids, "node").join(grids.select(F.col("node").alias("head"), F.col("grid").alias("hgrid")), "head")
    return pairs.select("node", "head", "keys", "grid", "hgrid").mapInArrow(run, "node bigint, head bigint, keys bigint, may boolean")


def _small(nodes: DataFrame, count: int) -> DataFrame:
    """Node numbers, marked to be broadcast if there are few."""
    return F.broadcast(nodes) if count <= BROADCAST_NODES else nodes


def _sized(active: DataFrame, group: DataFrame) -> DataFrame:
    return stash(active.join(group, "node"), "minhash-groups")


def _open(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Edges whose ends are in different groups, with both groups and set sizes."""
    a = group.select("node", F.col("grp").alias("g"), "n")
    b = group.select(F.col("node").alias("head"), F.col("grp").alias("hg"), F.col("n").alias("hn"))
    return edges.join(a, "node").join(b, "head").where("g <> hg")


def _with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Adds the nodes' sets. A list of up to BROADCAST_ROWS rows goes to where the sets are."""
    rows = stash(rows, "minhash-units")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return items.join(rows, "node").select("unit", "role", "node", "grp", "items")


def _star_rows(pick: DataFrame, items: DataFrame) -> DataFrame:
    """Units of up to BLOCK nodes and the head they picked."""
    many = pick.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.expr("pmod(hash(node), parts)")
    members = pick.join(many, "head").select(_unit("head", part).alias("unit"), F.lit(1).alias("role"), "node")
    hubs = many.select("head", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    hubs = hubs.select(_unit("head", "part").alias("unit"), F.lit(0).alias("role"), F.col("head").alias("node"))
    return _with_items(members.unionByName(hubs).withColumn("grp", F.col("node")), items)


def _block_rows(left: DataFrame, tested: DataFrame, group: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Units that compare groups which meet under a head: with the largest of them (role 1) and
    with each other, the members of the smaller ones (role 0).

    Which groups meet is collected by head and then by the largest group, so that the many heads
    of one cluster lead to the same units. Two groups whose sets differ too much in size, and two
    single nodes already compared or ruled out by their grids, are left out.
    """
    sizes = group.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    meet = left.select("head", F.col("g").alias("grp")).union(left.select("head", "hg")).distinct().join(sizes, "grp")
    largest = meet.groupBy("head").agg(F.max(F.struct("size", "grp")).alias("top"), F.count(F.lit(1)).alias("groups"), F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    largest = largest.where((F.col("groups") > 2) | (100 * F.col("hi") >= percent * F.col("lo")))
    done = left.where("not may").select("head").union(left.join(tested, ["node", "head"]).select("head")).distinct().withColumn("done", F.lit(True))
    largest = largest.join(done, "head", "left").where(~(F.col("done").isNotNull() & (F.col("groups") == 2) & (F.col("top.size") == 1)))
    pairs = meet.join(largest.select("head", "top"), "head").where(F.col("grp") != F.col("top.grp")).select(F.col("top.grp").alias("hub"), "grp").distinct()
    members = group.select("grp", "node")
    outer = pairs.join(members, "grp").select("hub", "grp", "node")
    inner = pairs.select("hub").distinct().join(members.withColumnRenamed("grp", "hub"), "hub").select("hub", F.col("hub").alias("grp"), "node")
    sizes = outer.groupBy("hub").agg(F.count(F.lit(1)).alias("o")).join(inner.groupBy("hub").agg(F.count(F.lit(1)).alias("i")), "hub")
    sizes = sizes.select("hub", F.ceil(F.col("o") / BLOCK).cast("int").alias("no"), F.ceil((F.col("o") + F.col("i")) / BLOCK).cast("int").alias("nb"))
    outer, inner = outer.join(sizes, "hub"), inner.join(sizes, "hub")
    mine = F.expr("pmod(hash(node), no)")
    block = F.expr("pmod(hash(node, 1), nb)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = outer.withColumn("c", mine).withColumn("b", every("nb")).select(_unit("hub", "c", "b").alias("unit"), F.lit(0).alias("role"), "node", "grp")
    rest = outer.unionByName(inner).withColumn("b", block).withColumn("c", every("no")).select(_unit("hub", "c", "b").alias("unit"), F.lit(1).alias("role"), "node", "grp")
    return _with_items(held.unionByName(rest), items)


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of its smallest id, null last, the first.

    Rows are numbered in a written copy, so repeated and null ids are told apart. All columns are
    carried, whatever their names.
    """
    docs, back = sheltered(docs, but=(doc_id, text))
    held = stash(docs.withColumn("_row", F.monotonically_increasing_id()), "minhash-docs", lasting=True)
    with temporary(docs.sparkSession):
        found = near_duplicates(held, size, percent, "_row", text).select(F.col("doc_id").alias("_row"), "component_id")
        ranked = held.select("_row", F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"), "_row").alias("rank"))
        first = found.join(ranked, "_row").groupBy("component_id").agg(F.min("rank")["_row"].alias("_row"), F.count(F.lit(1)).alias("n"))
        # Only groups of several rows lose any, so what is joined with the texts is the rows that go.
        many = first.where("n > 1").select("component_id", F.col("_row").alias("stays"))
        gone = stash(found.join(many, "component_id").where("_row <> stays").select("_row"), "minhash-dropped", lasting=True)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    return back(held.join(gone, "_row", "left_anti").select(*docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=2)


_COMPONENTS = """r AS (
  SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l
), c AS (
  SELECT x, y FROM r UNION SELECT c.x, r.y FROM c JOIN r ON r.x = c.y
)"""

#: The contract without any hashing: all pairs that share a shingle.
OP4_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), {_COMPONENTS}, m AS (SELECT x, min(y) AS y FROM c GROUP BY x)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id, s.doc_id <= coalesce(m.y, s.doc_id) AS kept
FROM s LEFT JOIN m ON m.x = s.doc_id
"""

"""Repeated-passage removal by longest factors in suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Suffixes are put
in the order of their bytes, ties by position. The previous and next smaller positions of a suffix
in that order are its best earlier matches, so its longest previous factor reaches ``LENGTH``
exactly if the suffix before it in the run that shares ``LENGTH`` bytes stands earlier, and its
longest next factor if the one after it does. Here either counts: the first copy goes too.

The order is never built over all bytes at once. Every string of ``LENGTH`` bytes has one anchor,
the leftmost least hash among its substrings of ``GRAM`` bytes, and equal strings have it at the
same offset, so suffixes need ordering only among those of the same anchor hash:

1. anchors, about one in 70 bytes, are counted by hash; most are unique and end there;
2. the strings of an anchor are settled together where its whole context occurs again (two
   hashes of 64 bits that share nothing, over the same bytes), or no other context has its hash;
3. where contexts differ, one of each is cut into its suffixes and these are put in suffix order
   by prefix doubling over their bytes: groups of up to ``GROUP`` contexts side by side in a
   task; of larger ones the strings are counted by anchor and two such hashes.

Nothing of unbounded size is gathered by key: counts are pre-aggregated and written, and joins on
hot hashes have plain tables on both sides, so that Spark can split them. Copies of a text share
one key, so steps after the first see them once.

Edge cases: null is the empty text; texts under ``LENGTH`` bytes lose nothing and match nothing;
very long texts are read in overlapping pieces; repeated rows are copies of each other and go
entirely when long enough; an empty table gives an empty result; columns other than the text are
carried unless an output is named alike, and then replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.runtime import sheltered, shuffle_width, small_batches, stash, temporary

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
PIECE = 1 << 19
#: Contexts of one anchor hash beyond this number are counted by content instead of side by side.
GROUP = 4096
#: Keys of at most so many texts are broadcast (12 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 4 * PIECE), _powers(_UNBASE, 4 * PIECE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; differences give the hash of any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * _DOWN[start]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts at [starts, ends) of one buffer: (first, last, at, gram, context).

    The strings whose anchor is at ``at`` start at first..last; ``gram`` is the anchor's hash and
    ``context`` the hash of all those strings' bytes.
    """
    prefix = _prefix(data)
    i = np.arange(len(data) - GRAM + 1)
    grams = _mix(_hash(prefix, i, i + GRAM))
    order = (grams >> np.uint64(24) << np.uint64(24)) | i.astype(np.uint64)
    least = (_least(order, SPAN) & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = ends - starts >= LENGTH
    starts, counts = starts[ok], (ends - starts - LENGTH + 1)[ok]
    first_of = np.cumsum(counts) - counts
    p = np.repeat(starts - first_of, counts) + np.arange(counts.sum())
    at = least[p]
    begins = np.ones(len(p), bool)
    begins[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    heads = np.flatnonzero(begins)
    first, last, at = p[heads], p[np.concatenate([heads[1:], [len(p)]]) - 1] if len(p) else p, at[heads]
    raw = data.tobytes()
    spans = zip(first.tolist(), (last + LENGTH).tolist(), strict=True)
    context = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in spans), np.uint64, len(first))
    context = _mix(context + (at - first).astype(np.uint64) * np.uint64(977) + (last - first).astype(np.uint64))
    return first, last, at, grams[at], context


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, rows, offsets in the row's text) of at most about PIECE bytes each.

    A longer text comes in pieces that overlap, each string of it starting in one of them.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    offs: list[int] = []
    size = 0

    def out():
        lens = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(lens)
        return np.frombuffer(b"".join(parts), np.uint8), ends - lens, ends, np.array(rows, np.int64), np.array(offs, np.int64)

    for r, x in enumerate(batch.column(column)):
        raw = (x.as_buffer() or b"") if x.is_valid else b""
        raw = bytes(raw)
        for off in range(0, max(1, len(raw)), PIECE):
            piece = raw[off : off + PIECE + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > PIECE and parts:
                yield out()
                parts, rows, offs, size = [], [], [], 0
            parts.append(piece)
            rows.append(r)
            offs.append(off)
            size += len(piece)
    if parts:
        yield out()


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, text) -> (gram, context, x, y, place); place packs the anchor and its strings."""
    for batch in batches:
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for data, starts, ends, rows, offs in _pieces(batch, 2):
            first, last, at, gram, context = anchors(data, starts, ends)
            k = np.searchsorted(starts, first, "right") - 1
            place = ((at - starts[k] + offs[k]) << 16) | ((at - first) << 8) | (at - last)
            r = rows[k]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(x[r]), pa.array(y[r]), pa.array(place)], ["gram", "context", "x", "y", "place"])


def _first_last(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = place >> 16
    return at - ((place >> 8) & 255), at - (place & 255)


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, text, reps) -> (gram, n, big, x, y, place, bytes): the strings' bytes of each anchor."""
    for batch in batches:
        for x, y, text, reps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            raw = bytes(text.as_buffer() or b"")
            items = reps.values.flatten()
            place = items[3].to_numpy()
            first, last = _first_last(place)
            cut = [raw[i : j + LENGTH] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            n = len(cut)
            yield pa.RecordBatch.from_arrays(
                [items[0], items[1], items[2], pa.array([x] * n, pa.int64()), pa.array([y] * n, pa.int64()), items[3], pa.array(cut, pa.binary())],
                ["gram", "n", "big", "x", "y", "place", "bytes"],
            )


def _starts(place: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some contexts laid end to end: (context, start in the buffer, start in the text)."""
    counts = lens - LENGTH + 1
    owner = np.repeat(np.arange(len(lens)), counts)
    inner = np.arange(counts.sum()) - (np.cumsum(counts) - counts)[owner]
    return owner, (np.cumsum(lens) - lens)[owner] + inner, _first_last(place)[0][owner] + inner


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of every suffix of ``data`` by its first ``length`` bytes; equal ones share a rank.

    Prefix doubling from words of eight bytes; beyond the end stand zeros.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(len(data) + length, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | padded[k : k + len(rank)]
    width = 8
    while True:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        if width == length:
            return rank[: len(data)]
        step = min(width, length - width)
        rank = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        width += step


def long_factors(group: np.ndarray, rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous and the longest next factor of each suffix is a whole string.

    In suffix order, ties by position, the suffix before is the previous smaller position of its
    run, and the suffix after is the next larger one.
    """
    order = np.lexsort((position, rank, group))
    same = (group[order][1:] == group[order][:-1]) & (rank[order][1:] == rank[order][:-1])
    previous, following = np.zeros(len(order), bool), np.zeros(len(order), bool)
    previous[order[1:][same]] = True
    following[order[:-1][same]] = True
    return previous, following


def _match_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram -> (x, y, place) of the strings of single contexts with a match."""
    from tidemark.llm.minhash import _grouped

    for table, _ in _grouped(batches, ["gram"], 2 * GROUP):
        gram, place = table.column("gram").to_numpy(), table.column("place").to_numpy()
        raw = table.column("bytes").to_pylist()
        owner, at, start = _starts(place, np.array([len(b) for b in raw], np.int64))
        rank = suffix_ranks(np.frombuffer(b"".join(raw), np.uint8), LENGTH)[at]
        previous, following = long_factors(gram[owner], rank, at)
        found = np.flatnonzero((previous | following) & (table.column("n").to_numpy()[owner] == 1))
        yield _runs(table, owner[found], start[found])


def _runs(table: pa.Table, owner: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Sorted string starts as ranges, packed like places; a range holds at most 256 starts."""
    if len(owner) == 0:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["x", "y", "place"])
    begins = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
    heads = np.flatnonzero(begins)
    tails = np.concatenate([heads[1:], [len(owner)]]) - 1
    who = owner[heads]
    place = (start[tails] << 16) | ((start[tails] - start[heads]) << 8)
    return pa.RecordBatch.from_arrays([table.column("x").take(pa.array(who)).combine_chunks(), table.column("y").take(pa.array(who)).combine_chunks(), pa.array(place)], ["x", "y", "place"])


def _emit_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of large groups -> (gram, content, check, n, x, y, place), a row for each string.

    ``content`` and ``check`` are hashes of the string that share nothing.
    """
    for whole in batches:
        for k in range(0, whole.num_rows, GROUP):
            batch = whole.slice(k, GROUP)
            raw = batch.column("bytes").to_pylist()
            owner, at, start = _starts(batch.column("place").to_numpy(), np.array([len(b) for b in raw], np.int64))
            data = b"".join(raw)
            content = _mix(_hash(_prefix(np.frombuffer(data, np.uint8)), at, at + LENGTH))
            check = np.fromiter((xxh3_64_intdigest(data[i : i + LENGTH]) for i in at.tolist()), np.uint64, len(at))
            take = lambda c: batch.column(c).take(pa.array(owner))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [take("gram"), pa.array(content.view(np.int64)), pa.array(check.view(np.int64)), take("n"), take("x"), take("y"), pa.array(start << 16)],
                ["gram", "content", "check", "n", "x", "y", "place"],
            )


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["x", "y", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                raw = bytes(text.as_buffer() or b"")
                first, last = _first_last(places.values.to_numpy())
                order = np.argsort(first, kind="stable")
                first, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
                opens = np.concatenate([[True], first[1:] > end[:-1]])
                heads = np.flatnonzero(opens)
                a, b = first[heads], end[np.concatenate([heads[1:], [len(end)]]) - 1]
                kept = b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                rows.append((int((b - a).sum()), len(a), sha256(kept).hexdigest(), *([kept] * with_text)))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]], names)

    return run


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row (x, y, text) for each of the keys."""
    small = keys.count() <= BROADCAST_TEXTS
    some = texts.join(F.broadcast(keys) if small else keys, ["x", "y"], "left_semi")
    return some.groupBy("x", "y").agg(F.first("text").alias("text"))


def repeats(texts: DataFrame) -> DataFrame:
    """(x, y, text) -> (x, y, places): all strings of LENGTH bytes that also start elsewhere."""
    with temporary(texts.sparkSession):
        anchored = texts.select("x", "y", "text").mapInArrow(_emit_anchors, "gram bigint, context bigint, x bigint, y bigint, place bigint")
        anchored = stash(anchored, "repeat-all")
        grams = anchored.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
        grams = stash(grams.where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "repeat-grams")
        again = stash(anchored.join(grams, "gram"), "repeat-anchors")
        settled = again.where("not mixed").select("x", "y", "place")
        mixed = again.where("mixed")
        kinds = mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "place")).alias("rep"))
        kinds = stash(kinds.select("gram", "context", "n", "rep.*"), "repeat-contexts")
        whole = mixed.join(kinds.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi").select("x", "y", "place")
        big = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > GROUP)
        big = stash(big.select("gram", F.lit(True).alias("big")), "repeat-large")
        reps = kinds.join(big, "gram", "left").withColumn("big", F.coalesce("big", F.lit(False)))
        reps = stash(reps.groupBy("x", "y").agg(F.collect_list(F.struct("gram", "n", "big", "place")).alias("reps")), "repeat-reps")
        cut = _only(texts, reps.select("x", "y")).join(reps, ["x", "y"]).select("x", "y", "text", "reps")
        cut = stash(cut.mapInArrow(_emit_contexts, "gram bigint, n bigint, big boolean, x bigint, y bigint, place bigint, bytes binary"), "repeat-bytes")
        width = shuffle_width(texts.sparkSession)
        small = cut.where("not big").repartition(width, "gram").sortWithinPartitions("gram").mapInArrow(_match_groups, "x bigint, y bigint, place bigint")
        strings = cut.where("big").mapInArrow(_emit_strings, "gram bigint, content bigint, check bigint, n bigint, x bigint, y bigint, place bigint")
        often = stash(strings.groupBy("gram", "content", "check").count().where("count > 1").select("gram", "content", "check"), "repeat-often")
        large = strings.where("n = 1").join(often, ["gram", "content", "check"], "left_semi").select("x", "y", "place")
        found = settled.unionByName(whole).unionByName(small).unionByName(large)
        return stash(found.groupBy("x", "y").agg(F.collect_set("place").alias("places")), "repeat-places", lasting=True)


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    ``kept_text`` in bytes (a cut may fall inside a code point)."""
    small_batches(docs.sparkSession)
    outputs = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    body = F.coalesce(F.col(text), F.lit(""))
    docs, back = sheltered(docs, "x", "y", "places", but=(text,))
    keyed = docs.withColumns({"x": F.xxhash64(body), "y": F.crc32(body.cast("binary"))})
    texts = keyed.select("x", "y", body.alias("text"))
    marks = repeats(texts)
    schema = "x bigint, y bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text binary" * with_text
    done = _only(texts, marks.select("x", "y")).join(marks, ["x", "y"]).select("x", "y", "text", "places").mapInArrow(_cut(with_text), schema)
    kept = [c for c in docs.columns if c not in (*outputs, text)]
    plain = keyed.select(*kept, "x", "y", F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("_sha"), *([body.cast("binary").alias("_text")] * with_text))
    return back(plain.join(done, ["x", "y"], "left").select(
        *kept, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), *([F.coalesce("kept_text", "_text").alias("kept_text")] * with_text),
    ))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""The prefix trie of conversations by truncation peeling over sorted paths.

A conversation is a path: sixteen bytes of a digest for each turn.  Sorted by path, the members
of a trie node are neighbours.  A task takes a range of the sorted paths and descends from the
deepest turn to the root: at each depth the conversations that end there join the nodes that
survived from below, the last turn is stripped, and neighbours that are now equal are merged.
All figures of a node follow from its children in that one descent.  Only nodes that hold the
first or the last row of a range may go on in a neighbouring range; they leave as chains, at most
two a range, and the same descent over the chains of ``FAN`` neighbouring ranges finishes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybrook.session import materialize

#: Conversations of one family share their first turns; at most ``SHARED - 1`` of them.
FAMILY, SHARED = 100, 6
#: Bytes of a turn in a path, ranges whose chains one task finishes, bytes of ids in one piece.
STEP, FAN, PIECE = 16, 64, 8192
_NONE, _SPLIT = hashlib.sha256(b"").hexdigest(), "?"

_CHAIN = "part int, path binary, chars array<long>, base int, n array<long>, low array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"
_NODE = "low_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_id long, own_key binary, parent_key binary"
_PIECE = "piece_key binary, piece_first long, piece_ids string"
_OUT = pa.schema([
    ("part", pa.int32()), ("path", pa.binary()), ("chars", pa.list_(pa.int64())), ("base", pa.int32()),
    *((name, pa.list_(pa.int64())) for name in ("n", "low", "children", "leaves", "saved")), ("ends", pa.list_(pa.string())),
    *((name, pa.int64()) for name in ("low_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()),
    ("parent_id", pa.int64()), ("own_key", pa.binary()), ("parent_key", pa.binary()),
    ("piece_key", pa.binary()), ("piece_first", pa.int64()), ("piece_ids", pa.string())])


def _batch(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[field.name], field.type) if field.name in columns else pa.nulls(size, field.type) for field in _OUT], schema=_OUT)


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[:STEP * depth]).digest()[:STEP]


def _shared_turns(paths: list[bytes]) -> np.ndarray:
    """Turns that each path has in common with the one before it; -1 for the first."""
    out = np.full(len(paths), -1, np.int64)
    for i in range(1, len(paths)):
        a, b = paths[i - 1], paths[i]
        size = min(len(a), len(b))
        if a[:size] == b[:size]:
            out[i] = size // STEP
            continue
        x, y = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
        out[i] = int((x != y).argmax()) // STEP
    return out


class _Range:
    """Rows of one range in path order, and what is known at each depth: entries of conversations or of chains."""

    def __init__(self, rows: pa.Table):
        self.paths = rows.column("path").to_pylist()
        self.size = len(self.paths)
        chars = rows.column("chars").combine_chunks()
        offsets = chars.offsets.to_numpy()
        self.char_at, self.char_values = offsets[:-1], np.asarray(chars.values)
        self.shared = _shared_turns(self.paths)
        length = np.array([len(path) // STEP for path in self.paths], np.int64)
        self.length = length
        if "n" in rows.column_names:
            base = rows.column("base").to_numpy().astype(np.int64)
            many = length - base
            self.row = np.repeat(np.arange(self.size), many)
            self.depth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(base, many) + 1
            self.own = np.stack([np.asarray(rows.column(name).combine_chunks().flatten()) for name in ("n", "low", "children", "leaves", "saved")])
            self.ends, self.ids = rows.column("ends").combine_chunks().flatten().to_pylist(), None
        else:
            self.row, self.depth = np.arange(self.size), length
            self.ids = rows.column("conv_id").to_numpy()
            zero = np.zeros(self.size, np.int64)
            self.own = np.stack([zero + 1, self.ids, zero, zero, zero])
            self.ends = None
        order = np.argsort(self.depth, kind="stable")
        self.row, self.depth, self.own = self.row[order], self.depth[order], self.own[:, order]
        if self.ends is not None:
            self.ends = [self.ends[i] for i in order]

    def entries(self, depth: int) -> slice:
        return slice(*np.searchsorted(self.depth, [depth, depth + 1]))

    def chars_of(self, rows: np.ndarray, depth: int) -> np.ndarray:
        return self.char_values[self.char_at[rows] + depth - 1] if depth else np.zeros(len(rows), np.int64)


def _digest(part: _Range, rows: np.ndarray, whole: bool, pieces: list) -> str:
    """The digest of the ids that end at a node; where the run may go on in another range, its pieces are kept instead."""
    ids = part.ids[rows]
    if whole or (rows[0] > 0 and rows[-1] < part.size - 1):
        return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
    path, at = part.paths[rows[0]], 0
    key = _key(path, len(path) // STEP)
    step = PIECE // 20
    for at in range(0, len(ids), step):
        some = ids[at:at + step].tolist()
        pieces.append((key, some[0], ",".join(map(str, some))))
    return _SPLIT


def _peel(part: _Range, number: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Closed nodes of a range, its chains, and the pieces of runs at its edges.  ``whole``: there is no other range."""
    last_row, pieces = part.size - 1, []
    chains: dict[int, list] = {0: [], last_row: []}
    first = last = np.zeros(0, np.int64)        # rows that the surviving nodes begin and end with
    live = np.zeros((5, 0), np.int64)           # n, smallest id, children, leaves, saved of closed survivors
    closed, names = np.zeros(0, bool), []
    for depth in range(int(part.length.max()), -1, -1):
        own = part.entries(depth)
        rows = part.row[own]
        spot = np.concatenate([rows, first])
        order = np.argsort(spot, kind="stable")
        spot, end = spot[order], np.concatenate([rows, last])[order]
        born = np.concatenate([np.zeros(len(rows), bool), np.ones(len(first), bool)])[order]
        counts = closed.astype(np.int64)
        lows = np.where(closed, live[1], np.iinfo(np.int64).max)
        values = np.concatenate([part.own[:, own], np.stack([live[0] * counts, lows, counts, live[3] * counts, live[4] * counts])], axis=1)[:, order]
        fresh = part.shared[spot] < depth
        fresh[1:] &= spot[1:] != spot[:-1]
        starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        n, children, leaves, saved = (np.add.reduceat(values[k], starts) for k in (0, 2, 3, 4))
        low = np.minimum.reduceat(values[1], starts)
        begin, finish = spot[starts], np.maximum.reduceat(end, starts)
        shut = np.ones(len(starts), bool) if whole else (begin > 0) & (finish < last_row)
        # digests of the ids that end here
        ends: list[str | None] = [None] * len(starts)
        owner = group[np.flatnonzero(~born)]
        if part.ends is None:
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(owner)], strict=False):
                ends[owner[a]] = _digest(part, rows[a:b], whole, pieces)
        else:
            for place, end_of in zip(owner, part.ends[own], strict=True):
                ends[place] = ends[place] or end_of
        # nodes of the depth below now know their parents
        if len(first):
            at = np.empty(len(first), np.int64)
            at[order[born] - len(rows)] = group[born]
            yield from _nodes(part, depth + 1, first, live, closed, names, low[at], shut[at], begin[at])
        live = np.stack([n, low, children, np.where(shut & (children == 0), 1, leaves), saved + np.where(shut, (n - 1) * part.chars_of(begin, depth), 0)])
        first, last, closed, names = begin, finish, shut, ends
        for place in np.flatnonzero(~shut):
            edge = 0 if begin[place] == 0 else last_row
            chains[edge].append((int(n[place]), int(low[place]), int(children[place]), int(leaves[place]), int(saved[place]), ends[place]))
    yield from _nodes(part, 0, first, live, closed, names, None, closed, first)
    for edge, kept in chains.items():
        if kept:
            kept.reverse()
            columns = list(zip(*kept, strict=True))
            path, length = part.paths[edge], int(part.length[edge])
            low = int(part.char_at[edge])
            yield _batch(part=[number], path=[path], chars=[part.char_values[low:low + length].tolist()], base=[length - len(kept)],
                         n=[columns[0]], low=[columns[1]], children=[columns[2]], leaves=[columns[3]], saved=[columns[4]], ends=[columns[5]])
    for at in range(0, len(pieces), 1024):
        key, head, ids = zip(*pieces[at:at + 1024], strict=True)
        yield _batch(piece_key=key, piece_first=head, piece_ids=ids)


def _nodes(part, depth, first, live, closed, names, parent_low, parent_shut, parent_row) -> Iterator[pa.RecordBatch]:
    """Rows of the closed nodes of one depth; a parent that is still open is named by its key."""
    take = np.flatnonzero(closed)
    keys: dict[int, bytes] = {}

    def key(row: int, at: int) -> bytes:
        if row not in keys:
            keys[row] = _key(part.paths[row], at)
        return keys[row]
    for low in range(0, len(take), 8192):
        some = take[low:low + 8192]
        if depth:
            known = parent_shut[some]
            parent_id = pa.array(parent_low[some], pa.int64(), mask=~known)
            parent_key = [None if ok else key(int(row), depth - 1) for ok, row in zip(known, parent_row[some], strict=True)]
        else:
            parent_id, parent_key = [None] * len(some), [None] * len(some)
        ends = [names[i] or _NONE for i in some]
        # a node that was open before may be the parent that an earlier round named, or have its digest in pieces
        own = [_key(part.paths[row], depth) if part.ends is not None else None for row in first[some]]
        yield _batch(low_id=live[1][some], depth=np.full(len(some), depth), n_convs=live[0][some], n_children=live[2][some], n_leaves=live[3][some],
                     saved_tokens=live[4][some], ends_sha256=ends, parent_id=parent_id, own_key=own, parent_key=parent_key)


def _peel_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    kept = [batch for batch in batches if batch.num_rows]
    if kept:
        yield from _peel(_Range(pa.Table.from_batches(kept)), TaskContext.get().partitionId(), False)


def _peel_chains(whole: bool):
    def peel(key: tuple[pa.Scalar, ...], chains: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_peel(_Range(chains.sort_by("path")), key[0].as_py(), whole), _OUT)
    return peel


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined pieces of each key; pieces arrive in order and only the running digest is held."""
    current, running, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("piece_key").to_pylist(), batch.column("piece_ids").to_pylist(), strict=True):
            if key != current:
                if current is not None:
                    done.append((current, running.hexdigest()))
                current, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if current is not None:
        done.append((current, running.hexdigest()))
    if done:
        keys, shas = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas)], names=["ends_key", "whole_sha"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path, chars)`` of every conversation after its first turns were taken from its family's first one.

    Rows without a conversation id are left out.  Turns are ordered by ``turn``, null first; equal
    turns by a digest of role and text; repeated rows are repeated turns.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    c = F.col("conv_id").cast("long")
    rows = conversations.where(c.isNotNull()).select(c.alias("conv_id"), (c - c % FAMILY).alias("family"), turn.alias("one"))
    whole = rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, SHARED - 1))).over(Window.partitionBy("family"))
    own = whole.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0)))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    joined = F.concat(F.slice("head", F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    own = own.select("conv_id", joined.alias("turns"))
    return own.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.chars").alias("chars"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` per trie node.

    A node is a distinct sequence of first turns; ``conv_id`` is its smallest member.  Null roles
    and texts are empty.  A conversation without turns ends at the root; an empty table has no nodes.
    The digest of a node's ids is one running hash; only where a group of equal conversations spans
    ranges its packed ids pass through one task, eight kilobytes a row, and are never held together.
    """
    schema = ", ".join((_CHAIN, _NODE, _PIECE))
    paths = materialize(rebuilt(conversations), "paths")
    ranges = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    done = found = materialize(ranges.mapInArrow(_peel_range, schema), "trie")
    while (most := done.where("path is not null").agg(F.max("part")).first()[0]) is not None:
        chains = done.where("path is not null").select(*(field.split()[0] for field in _CHAIN.split(", ")))
        grouped = chains.groupBy((F.col("part") / FAN).cast("int"))
        done = materialize(grouped.applyInArrow(_peel_chains(most < FAN), schema), "trie")
        found = found.unionByName(done)
    fields = [field.split()[0] for field in _NODE.split(", ")]
    nodes = found.where("low_id is not null").select(*fields)
    pieces = found.where("piece_key is not null").select("piece_key", "piece_first", "piece_ids")
    pieces = pieces.repartition("piece_key").sortWithinPartitions("piece_key", "piece_first")
    shas = materialize(pieces.mapInArrow(_hash_pieces, "ends_key binary, whole_sha string"), "digests")
    split = nodes.where(F.col("ends_sha256") == _SPLIT).join(shas, F.col("own_key") == F.col("ends_key"))
    every = nodes.where(F.col("ends_sha256") != _SPLIT).unionByName(split.withColumn("ends_sha256", F.col("whole_sha")).select(*fields))
    opened = nodes.where("own_key is not null").select(F.col("own_key").alias("named"), F.col("low_id").alias("named_id"))
    settled = every.where("parent_key is null").withColumn("named_id", F.lit(None).cast("long"))
    later = every.where("parent_key is not null").join(opened, F.col("parent_key") == F.col("named")).select(*fields, "named_id")
    return settled.unionByName(later).select(
        F.col("low_id").alias("conv_id"), "depth", F.coalesce("parent_id", "named_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends_sha256")

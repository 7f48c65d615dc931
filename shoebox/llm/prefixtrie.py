"""Prefix trie of conversations in node tables under minimal perfect hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import compute_partitions, cut_lineage, pinned
from .textpack import mix

#: Rows of paths a task holds at a time; a longer conversation is taken in pieces.
RUN_ROWS = 1 << 18
#: Conversation numbers hashed into one row before a node's digest is taken.
CHUNK_IDS = 1 << 14
#: Parents with more than this share of all nodes as children are joined by broadcast, so at most as many.
HOT_PARENTS = 1 << 16
#: What a node's smallest member tells of it.
OWNED = ("conv_id", "depth", "n_convs", "n_children", "up_hi", "up_lo")


class NodeTable:
    """A minimal perfect hash of distinct 128-bit digests: each has its own slot in 0..n-1.

    Level by level, digests alone at their place keep it and the others go on
    to the next level; the slot is the number of kept places before it. Every
    slot stores its digest, so a digest that is not in the table is told (-1)
    and two digests can never share a slot.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.hi, self.lo = np.zeros(len(hi), np.uint64), np.zeros(len(lo), np.uint64)
        left, before = np.arange(len(hi)), 0
        while len(left):
            places = 2 * len(left) + 1
            at = self._place(hi[left], lo[left], len(self.levels), places)
            alone = np.bincount(at, minlength=places) == 1
            rank = np.cumsum(alone) - 1 + before
            self.levels.append((np.where(alone, rank, -1), places))
            kept = alone[at]
            slot = rank[at[kept]]
            self.hi[slot], self.lo[slot] = hi[left[kept]], lo[left[kept]]
            before += int(kept.sum())
            left = left[~kept]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, places: int) -> np.ndarray:
        salt = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        salted = (hi + salt) ^ (lo * np.uint64(0xD6E8FEB86659FD93))
        return (mix(salted.copy()) % np.uint64(places)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (rank, places) in enumerate(self.levels):
            found = rank[self._place(hi[left], lo[left], level, places)]
            out[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        known = out >= 0
        known[known] = (self.hi[out[known]] == hi[known]) & (self.lo[out[known]] == lo[known])
        return np.where(known, out, -1)


def subtree_sums(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Adds every slot's values to its ancestors', deepest slots first (in place; parent -1: none)."""
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, edges) if len(order) else []:
        for v in values:
            np.add.at(v, parent[level], v[level])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {
        name: np.asarray(batch[name].fill_null(-1) if batch[name].null_count else batch[name])
        for name in batch.schema.names
    }


def _unsigned(column: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(column, np.int64).view(np.uint64)


def opening_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over from another one."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(6)).cast("int")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Each conversation as the opening of its hundred's first one and its own turns after that.

    Rows conv_id, kind, turn, body, chars, h: kind 0 stands for the
    conversation itself, 1 for a turn taken over, 2 for an own turn, of which
    the first h don't count. ``body`` is the SHA-256 of role and text, by
    which turns of equal number are ordered.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = cut_lineage(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
            F.unhex(F.sha2(whole.cast("binary"), 256)).alias("body"), F.char_length(text).cast("bigint").alias("chars"),
        ),
        "turns",
    )
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "body")
    # Cut to five rows a conversation before the shuffle.
    firsts = turns.where("conv_id % 100 = 0").withColumn("place", F.row_number().over(place)).where("place <= 5")
    openings = firsts.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("place").cast("bigint").alias("turn"), "body", "chars"))).alias("opening")
    )
    each = (
        turns.select("conv_id").distinct().withColumn("base", F.expr("conv_id - conv_id % 100"))
        .join(openings, "base", "left").withColumn("h", opening_length(F.col("conv_id")))
    )
    taken = each.select("conv_id", "h", F.explode(F.slice("opening", F.lit(1), F.col("h"))).alias("t"))
    zero = F.lit(0).cast("bigint")
    return (
        each.select(
            "conv_id", F.lit(0).alias("kind"), zero.alias("turn"), F.lit(None).cast("binary").alias("body"), zero.alias("chars"), "h"
        )
        .union(taken.select("conv_id", F.lit(1), "t.turn", "t.body", "t.chars", "h"))
        .union(turns.select("conv_id", F.lit(2), "turn", "body", "chars", opening_length(F.col("conv_id"))))
    )


def _running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums up to each row since the last row marked first (or since the start)."""
    total = np.cumsum(values, dtype=values.dtype)
    start = np.flatnonzero(first)
    since = np.zeros(len(values), values.dtype)
    since[start] = total[start] - values[start]
    return total - since[np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))]


class _Walk:
    """Goes through sorted rows batch by batch and keeps sums of the conversation it is in."""

    def __init__(self, conv: int | None = None, own: int = 0, depth: int = 0, hi: int = 0, lo: int = 0):
        self.conv, self.sums = conv, [np.int64(own), np.int64(depth), np.uint64(hi), np.uint64(lo)]

    def step(self, c: dict[str, np.ndarray], bodies: np.ndarray) -> tuple[np.ndarray, ...]:
        """(counts, depth, digest lanes, what the row adds to them)"""
        conv = c["conv_id"]
        first = np.r_[conv[0] != self.conv, conv[1:] != conv[:-1]]
        goes_on = ~np.logical_or.accumulate(first)

        def through(at: int, values: np.ndarray) -> np.ndarray:
            total = _running(values, first)
            total[goes_on] += self.sums[at]
            self.sums[at] = total[-1]
            return total

        own = through(0, (c["kind"] == 2).astype(np.int64))
        counts = (c["kind"] == 1) | ((c["kind"] == 2) & (own > c["h"]))
        depth = through(1, counts.astype(np.int64))
        place = depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        parts = [np.where(counts, mix(bodies[:, k] ^ (place + np.uint64(k + 1))), np.uint64(0)) for k in (0, 1)]
        lanes = [through(2 + k, parts[k]) for k in (0, 1)]
        self.conv = int(conv[-1])
        return counts, depth, lanes, parts


def _bodies(column: pa.Array) -> np.ndarray:
    """Two 64-bit lanes of each row's digest; zero where there is none."""
    out = np.zeros((len(column), 2), np.uint64)
    there = np.asarray(column.is_valid())
    raw = b"".join(v[:16] for v in column.drop_null().to_pylist())
    out[there] = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return out


def _walked(rows: DataFrame, begun: dict[int, tuple] | None) -> list[Row]:
    """One row per partition: its first and last conversation, and the walk's sums at its end.

    Without ``begun``, the walk starts from nothing everywhere; ``taken`` and
    ``mine`` are the rows of kinds 1 and 2 that the last conversation has here.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = first = pid = None
        kinds = np.zeros(3, np.int64)
        h = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, bodies = _columns(batch.drop_columns(["body"])), _bodies(batch["body"])
            if state is None:
                pid, first = int(c["pid"][0]), int(c["conv_id"][0])
                state = _Walk(*(begun or {}).get(pid, ()))
                kinds[:] = 0
            last = c["conv_id"] == c["conv_id"][-1]
            if not last.all() or c["conv_id"][-1] != state.conv:
                kinds[:] = 0
            kinds += np.bincount(c["kind"][last], minlength=3)
            h = int(c["h"][-1])
            state.step(c, bodies)
        if state is not None:
            own, depth, hi, lo = (int(np.asarray(v).view(np.int64)) for v in state.sums)
            values = (pid, first, state.conv, int(kinds[1]), int(kinds[2]), h, hi, lo)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names)

    names = ["pid", "first", "conv", "taken", "mine", "h", "hi", "lo"]
    return rows.mapInArrow(walk, ", ".join(f"{n} long" for n in names)).orderBy("pid").collect()


def paths(conversations: DataFrame) -> DataFrame:
    """One row per conversation and depth: conv_id, depth, hi, lo (the prefix), up_hi, up_lo, chars, pid.

    A prefix's digest is the sum, over its turns, of hashes of turn and place
    in 2 x 64 bits, so it can be added up across partitions: rows are sorted
    by conversation over many partitions, and what a conversation has before
    a partition is carried in by one row per partition. pid is the partition.
    """
    order = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("body")]
    lined = pinned(cut_lineage(rebuilt_turns(conversations), "rebuilt").orderBy(*order))
    rows = lined.withColumn("pid", F.shiftright(F.monotonically_increasing_id(), 33))

    # Own turns first, since depths depend on them, and digests on depths.
    begun: dict[int, tuple] = {}
    conv, own, depth = None, 0, 0
    for s in _walked(rows, None):
        begun[s.pid] = (conv, own, depth, 0, 0)
        had, at = (own, depth) if s.first == s.conv == conv else (0, 0)
        own = had + s.mine
        depth = at + s.taken + max(0, own - max(had, s.h))
        conv = s.conv
    hi = lo = 0
    for s in _walked(rows, begun):
        before = begun[s.pid]
        begun[s.pid] = (*before[:3], hi, lo)
        more = s.first == s.conv == before[0]
        hi, lo = ((v + (w if more else 0)) % 2**64 for v, w in ((s.hi, hi), (s.lo, lo)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _columns(batch.drop_columns(["body"]))
            if state is None:
                state = _Walk(*begun[int(c["pid"][0])])
            counts, depths, lanes, parts = state.step(c, _bodies(batch["body"]))
            keep = counts | (c["kind"] == 0)
            digests = [v[keep].view(np.int64) for v in (*lanes, *(a - b for a, b in zip(lanes, parts)))]
            columns = [c["conv_id"][keep], depths[keep], *digests, c["chars"][keep], c["pid"][keep]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names)

    names = ["conv_id", "depth", "hi", "lo", "up_hi", "up_lo", "chars", "pid"]
    return cut_lineage(rows.mapInArrow(spell, ", ".join(f"{n} long" for n in names)), "paths")


def prefix_nodes(walked: DataFrame) -> DataFrame:
    """Distinct prefixes with their smallest member, its partition, members, children and length of the last turn."""
    # All depths but the root's are above 0, so equal sums at two depths would show.
    nodes = walked.groupBy("hi", "lo").agg(
        F.min(F.struct("conv_id", "pid")).alias("own"), F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "up_hi", "up_lo", "chars")],
        F.min(F.struct("depth", "up_hi", "up_lo", "chars")).alias("least"),
        F.max(F.struct("depth", "up_hi", "up_lo", "chars")).alias("most"),
    )
    nodes = cut_lineage(nodes.select("hi", "lo", "own.*", "n_convs", "depth", "up_hi", "up_lo", "chars", (F.col("least") != F.col("most")).alias("torn")), "nodes")
    if not nodes.where("torn").isEmpty():
        raise ArithmeticError("two prefixes share a digest of 128 bits")
    children = nodes.where("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    joined = nodes.join(children, ["hi", "lo"], "left")
    return cut_lineage(joined.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))).drop("torn"), "nodes")


def _run_sums(c: dict[str, np.ndarray], leaves_in: int, saved_in: int) -> pa.RecordBatch | None:
    """Subtree sums of the nodes on some conversations' paths, of what these conversations own.

    Rows go down by conversation and depth. The first conversation's deepest
    row also takes what lies below it in other runs.
    """
    conv, own = c["conv_id"], c["n_convs"] > 0
    start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    useful = np.logical_or.reduceat(own, start)
    useful[0] |= bool(leaves_in or saved_in)
    keep = np.repeat(useful, np.diff(np.r_[start, len(conv)]))
    if not keep.any():
        return None
    first = useful[0]
    c = {k: v[keep] for k, v in c.items()}
    conv, own = c["conv_id"], c["n_convs"] > 0
    hi, lo, up_hi, up_lo = (np.ascontiguousarray(c[k]).view(np.uint64) for k in ("hi", "lo", "up_hi", "up_lo"))
    order = np.lexsort((lo, hi))
    fresh = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])]
    one = order[fresh]
    table = NodeTable(hi[one], lo[one])
    slot = table.slots(hi, lo)
    at = np.zeros(len(one), np.int64)
    at[slot] = np.arange(len(slot))
    depth = c["depth"][at]
    parent = np.where(depth > 0, table.slots(up_hi[at], up_lo[at]), -1)
    leaves, saved = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    leaves[slot[own]] = c["n_children"][own] == 0
    saved[slot[own]] = (c["n_convs"][own] - 1) * c["chars"][own]
    if first:
        leaves[slot[0]] += leaves_in
        saved[slot[0]] += saved_in
    subtree_sums(parent, depth, leaves, saved)
    # A node's parent has the same smallest member if that one's next row is its own too.
    above = np.r_[own[1:] & (conv[1:] == conv[:-1]), False]
    owner = np.zeros(len(one), bool)
    owner[slot[own]] = True
    from_own = lambda values: _by_slot(len(one), slot[own], values[own])
    shown = np.flatnonzero(owner | (leaves != 0) | (saved != 0))
    columns = {"hi": table.hi.view(np.int64), "lo": table.lo.view(np.int64), "leaves": leaves, "saved": saved}
    columns |= {k: from_own(c[k]) for k in OWNED}
    columns["up_conv"] = from_own(np.where(above, conv, 0))
    hidden = {k: ~owner for k in OWNED}
    hidden["up_conv"] = ~(_by_slot(len(one), slot[own], above[own].astype(np.int64)) > 0)
    arrays = [pa.array(v[shown], pa.int64(), mask=hidden[k][shown] if k in hidden else None) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _by_slot(n: int, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[slots] = values
    return out


def subtree_totals(walked: DataFrame, nodes: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every node with the leaves and saved tokens of its subtree.

    A node belongs to its smallest member. Shards are runs of conversations:
    each has the whole paths of its own, a node table for their prefixes, and
    sums up what its conversations own along the parents' slots. A node's
    totals are then the sums of its parts over all shards, so a prefix of most
    conversations meets as one row per shard. A conversation cut at the edge
    of a partition, or longer than a run, is summed on its own from its end
    up, with what lies below carried over; copies own nothing and fall out.
    """
    edges = walked.groupBy("pid").agg(F.min("conv_id").alias("conv_id")).select("conv_id").distinct()
    # At most one conversation per partition goes on from the one before.
    cut = (
        nodes.join(F.broadcast(edges), "conv_id")
        .groupBy("conv_id", "pid")
        .agg(F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        .collect()
    )
    owned: dict[int, list[tuple[int, int, int]]] = {}
    for r in cut:
        owned.setdefault(r.conv_id, []).append((r.pid, r.leaves, r.saved))

    def below(conv: int, pid: int) -> tuple[int, int]:
        later = [(a, b) for p, a, b in owned.get(conv, ()) if p > pid]
        return sum(a for a, _ in later), sum(b for _, b in later)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        pid = None
        carry = (0, 0)

        def take(rows: dict[str, np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal carry
            part = {k: v[:upto] for k, v in rows.items()}
            conv = part["conv_id"]
            last = conv == conv[-1]
            # A conversation that does not begin here is summed alone.
            alone = part["depth"][-1] > 0 and not last.all()
            pieces = [part] if not alone else [{k: v[~last] for k, v in part.items()}, {k: v[last] for k, v in part.items()}]
            for piece in pieces:
                if (found := _run_sums(piece, *carry)) is not None:
                    yield found
                carry = (0, 0)

        def settle(done: bool) -> Iterator[pa.RecordBatch]:
            """Sums whole conversations; the one still open stays, unless it fills a run."""
            nonlocal held, carry
            conv = held["conv_id"]
            n = len(conv)
            if done:
                yield from take(held, n)
                held = None
                return
            open_from = int(np.searchsorted(-conv, -conv[-1]))
            if open_from:
                yield from take(held, open_from)
                held = {k: v[open_from:] for k, v in held.items()}
            elif n > run_rows:
                # One conversation: all but its last row, whose path row may still follow.
                part = {k: v[: n - 1] for k, v in held.items()}
                own = part["n_convs"] > 0
                deeper = (
                    carry[0] + int((part["n_children"][own] == 0).sum()),
                    carry[1] + int(((part["n_convs"][own] - 1) * part["chars"][own]).sum()),
                )
                if (found := _run_sums(part, *carry)) is not None:
                    yield found
                carry = deeper
                held = {k: v[n - 1 :] for k, v in held.items()}

        for batch in batches:
            c = _columns(batch)
            for p in np.unique(c["pid"]):
                mine = {k: v[c["pid"] == p] for k, v in c.items()}
                if p != pid:
                    if held is not None:
                        yield from settle(True)
                    pid, carry = p, below(int(mine["conv_id"][0]), int(p))
                held = mine if held is None else {k: np.r_[held[k], mine[k]] for k in mine}
                # Of a node's row and its path's row at the same place only the former is kept.
                again = np.r_[False, (held["conv_id"][1:] == held["conv_id"][:-1]) & (held["depth"][1:] == held["depth"][:-1])]
                held = {k: v[~again] for k, v in held.items()}
                if len(held["conv_id"]) > run_rows:
                    yield from settle(False)
        if held is not None:
            yield from settle(True)

    zero = F.lit(-1).cast("bigint")
    place = ["pid", "conv_id", "depth", "hi", "lo", "up_hi", "up_lo", "chars"]
    both = nodes.select(*place, "n_convs", "n_children").union(walked.select(*place, zero, zero))
    tasks = compute_partitions(walked.sparkSession)
    lined = both.repartition(tasks, "pid").sortWithinPartitions("pid", F.desc("conv_id"), F.desc("depth"), F.desc("n_convs"))
    schema = ", ".join(f"{n} long" for n in ("hi", "lo", "leaves", "saved", *OWNED, "up_conv"))
    parts = lined.mapInArrow(sums, schema)
    return parts.groupBy("hi", "lo").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        *[F.max(c).alias(c) for c in (*OWNED, "up_conv")],
    )


def end_hashes(walked: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the prefixes that whole conversations equal.

    Numbers are sorted over all tasks and written in pieces of up to
    ``CHUNK_IDS``; the digest of a prefix, which by definition runs through
    its numbers in order, is taken over few pieces as they stream by.
    """
    last = F.max_by(F.struct("hi", "lo"), "depth").alias("end")
    ends = cut_lineage(walked.groupBy("conv_id").agg(last).select("end.*", "conv_id"), "ends")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, conv = (np.asarray(batch[k]) for k in ("hi", "lo", "conv_id"))
            if not len(hi):
                continue
            start = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            start = np.unique(np.r_[start, np.arange(0, len(hi), CHUNK_IDS)])
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(start, np.r_[start[1:], len(hi)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[start]), pa.array(lo[start]), pa.array(conv[start]), pa.array(text)], ["hi", "lo", "conv_id", "ids"]
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for hi, lo, ids in zip(*(batch[k].to_pylist() for k in ("hi", "lo", "ids"))):
                if (hi, lo) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (hi, lo), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _hash_batch(out)
        if key is not None:
            yield _hash_batch([(*key, digest.hexdigest())])

    chunks = ends.orderBy("hi", "lo", "conv_id").mapInArrow(pieces, "hi long, lo long, conv_id long, ids string")
    tasks = compute_partitions(walked.sparkSession)
    lined = chunks.repartition(tasks, "hi", "lo").sortWithinPartitions("hi", "lo", "conv_id")
    return lined.mapInArrow(digests, "hi long, lo long, ends_sha256 string")


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["hi", "lo", "ends_sha256"])


def prefix_trie(conversations: DataFrame, *, run_rows: int = RUN_ROWS) -> DataFrame:
    """All distinct openings of the rebuilt conversations as nodes of a trie.

    conversations: conv_id, turn, role, text; other columns are ignored,
    whatever their names. Returns one row per node: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Rows without conv_id are left out; null roles and texts are
    empty; turns run by number, null first, those of equal number by the
    SHA-256 of role and text; repeated rows are turns of their own. Very long
    texts are hashed where they lie, and conversations of any length are
    spread over tasks. An empty table has no nodes.

    Two different prefixes would need equal sums of 128 bits to be taken for
    one: the chance is below 1e-14 for 10^12 prefixes, and a clash between
    different depths, lengths or parents raises.
    """
    walked = paths(conversations)
    nodes = prefix_nodes(walked)
    done = cut_lineage(subtree_totals(walked, nodes, run_rows), "totals")
    # At most HOT_PARENTS parents have more than this many children.
    most = max(done.count() // HOT_PARENTS, 1)
    top = done.where("depth > 0 AND up_conv IS NULL")
    parents = done.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("found"), "n_children")
    hot = parents.where(F.col("n_children") > most).drop("n_children")
    asked = top.join(F.broadcast(hot), ["up_hi", "up_lo"], "left")
    rest = asked.where("found IS NULL").drop("found").join(
        parents.where(F.col("n_children").between(1, most)).drop("n_children"), ["up_hi", "up_lo"]
    )
    clear = done.where("depth = 0 OR up_conv IS NOT NULL").withColumn("found", F.col("up_conv"))
    told = asked.where("found IS NOT NULL").unionByName(rest).unionByName(clear)
    none = hashlib.sha256(b"").hexdigest()
    return told.join(end_hashes(walked), ["hi", "lo"], "left").select(
        "conv_id", "depth", F.col("found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )

"""Jaccard join of documents on word n-grams, by T-occurrence search.

A document's set holds the hashes of its distinct ``shingle``-word runs (ASCII
upper case folded; with fewer words the whole sequence is its one member).
Documents link when |x & y| * den >= num * |x | y|; components are reported.

Method.  Two sets that link share at least T = ceil(J * |x|) members, so the
partners of x are the ids that occur T times or more in the inverted lists of
x's members.  DivideSkip: the L longest lists are set aside, the short ones
are merged and ids with T - L occurrences or more kept, and these are probed
in the long lists by binary search.

Plan.
1. Equal sets become one node (a class); further work is on nodes.
2. Lossless blocking: sets that link differ in at most d members, d fixed by
   their size class.  Cut into d + 1 parts by hash, some part is equal in
   both.  Equal parts give star edges to the least node, and the components
   of these edges are the groups in which inverted lists are built.  Parts
   are reduced to one entry in each slice before the shuffle, and stars hold
   one edge per entry, never pairs.
   With J below ``SPARSE`` the parts get so small that a passage many
   documents share would fill some alone and join them all.  There, sets go
   on only if a share J of their members occurs in another set (no other can
   link; members are compared by 32 bits within their bucket, which can only
   let more sets through), and are grouped by their rare parts: cut twice as
   fine, sets that link share at least d + 2 of 2 (d + 1) parts, so the rarest
   part they share is among the d + 1 rarest of both.  What many sets share is
   not, and joins nobody.
3. T-occurrence search inside each group.  A document already in the group's
   largest component needs no search of its own: every pair that could still
   matter has a member outside it, and all of those search the whole group.
   So a group of near copies costs a search per outsider, not per pair.
4. Groups above ``block_members`` members or ``block_nodes`` nodes are cut
   into blocks.  Blocks are
   searched inside; then a few pivots of the group's largest component search
   all blocks, and then every node still outside it searches the blocks that hold
   one of its rare parts, as in 2: what the whole group shares sends nobody
   anywhere.  A task holds a block's lists, and the searches pass by them.

Defined cases.  Null and empty texts, and texts without words, have an empty
set and link with nothing.  Null ids sort before all ids and come back as
null.  Repeated rows are documents with equal sets.  An empty table gives an
empty result; further columns are ignored.  Set members are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C
from inspectkit.llm import graph

SHINGLE, NUM, DEN = 3, 90, 100
BLOCK_MEMBERS, BLOCK_NODES = 4_000_000, 8192
SLICE = 1 << 20
PIVOTS = 8
SPARSE, LEAVES = 0.85, 5
MERGED = 64  # lists merged or probed at a time
FLUSH = 1 << 18


def members(raw: np.ndarray, offsets: np.ndarray, shingle: int):
    """Sets of consecutive texts: (members sorted within each text, first)."""
    _, _, h, first = A.words(raw, offsets, lower=True)
    n, row = np.diff(first), A.row_of(first)
    runs = A.windows(h, shingle)
    left = first[1:][row] - np.arange(len(h))
    at = np.flatnonzero(left[: len(runs)] >= shingle)
    value, owner = [runs[at]], [row[at]]
    for size in range(1, shingle):
        short = np.flatnonzero(n == size)
        if len(short):
            value.append(A.mix(A.windows(h, size)[first[:-1][short]] + np.uint64(size)))
            owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def nodes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name per set: equal sets, equal name."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(value ^ np.uint64(0x5851F42D4C957F2D)))])
    return A.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def size_classes(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower bounds, parts): sets that link are in the same or in neighbouring
    classes; sets whose larger one is in a class differ in parts - 1 members
    at most."""
    bounds = [1]
    while bounds[-1] <= largest * den // num + 1:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * den // num)))
    bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * den // num)))
    b = np.array(bounds, np.int64)
    return b[:-1], 2 * (b[1:] - 1) * (den - num) // (den + num) + 1


def signatures(value: np.ndarray, first: np.ndarray, num: int, den: int):
    """(signature, row) of all parts of all sets, in their own size class and
    as the smaller partner in the next.  Empty parts count only for sets with
    too few others."""
    size = np.diff(first)
    row = A.row_of(first)
    bounds, parts = size_classes(num, den, int(size.max()) if len(size) else 1)
    own = np.searchsorted(bounds, np.maximum(size, 1), side="right") - 1
    scrambled = A.mix(value)
    out = []
    for step in (0, 1):
        kind = own + step
        k = np.where(size > 0, parts[kind], 0)
        base = np.concatenate([[0], np.cumsum(k)])
        slot = base[row] + ((value >> np.uint64(11)) % np.maximum(k[row], 1).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, scrambled)
        filled = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(size)), k)
        some = np.bincount(owner, filled > 0, minlength=len(size)).astype(np.int64)
        emit = np.flatnonzero((filled > 0) | (some < k)[owner])
        place = emit - base[owner[emit]]
        name = A.mix(sums[emit] + (kind[owner[emit]].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        out.append((A.mix(name + filled[emit].astype(np.uint64)), owner[emit]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def rests(value: np.ndarray, first: np.ndarray, num: int, den: int, leaves: int = LEAVES):
    """(signature, row) of all parts without one of their sections: with d // 2 + 1 parts, one
    differs in at most one member, so some rest is equal.  A filter by itself; the plan uses ``fine_parts``."""
    size, row = np.diff(first), A.row_of(first)
    bounds, parts = size_classes(num, den, int(size.max()) if len(size) else 1)
    own = np.searchsorted(bounds, np.maximum(size, 1), side="right") - 1
    scrambled, out = A.mix(value), []
    for step in (0, 1):
        kind = own + step
        k = np.where(size > 0, (parts[kind] - 1) // 2 + 1, 0)
        base = np.concatenate([[0], np.cumsum(k)])
        cell = ((value >> np.uint64(11)) % np.maximum(k[row] * leaves, 1).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(base[-1] * leaves, np.uint64)
        np.add.at(sums, base[row] * leaves + cell, scrambled)
        sums = sums.reshape(-1, leaves)
        rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        owner = np.repeat(np.arange(len(size)), k)
        place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        label = (kind[owner].astype(np.uint64) << np.uint64(40)) + (place << np.uint64(4))
        out.append((A.mix(A.mix(rest) + label[:, None] + np.arange(leaves, dtype=np.uint64)[None, :]).ravel(), np.repeat(owner, leaves)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def fine_parts(value: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """(key, row, size class, kept) of all parts of all sets, cut twice as fine as ``signatures``
    does: of 2 (d + 1) parts two sets that link differ in d at most, so they share d + 2,
    and one of these is among the d + 1 (``kept``) rarest of either, in any order of all keys."""
    size, row = np.diff(first), A.row_of(first)
    bounds, parts = size_classes(num, den, int(size.max()) if len(size) else 1)
    own = np.searchsorted(bounds, np.maximum(size, 1), side="right") - 1
    scrambled, out = A.mix(value), []
    for step in (0, 1):
        kind = own + step
        k = np.where(size > 0, 2 * parts[kind], 0)
        base = np.concatenate([[0], np.cumsum(k)])
        slot = base[row] + ((value >> np.uint64(11)) % np.maximum(k[row], 1).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, scrambled)
        owner = np.repeat(np.arange(len(size)), k)
        place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        label = (kind[owner].astype(np.uint64) << np.uint64(32)) + place
        out.append((A.mix(A.mix(sums + np.uint64(1)) ^ label), owner, kind[owner], parts[kind[owner]]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


class Lists:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        # what a step no longer needs goes before the next: a block has millions of postings
        self.size = np.array([len(s) for s in sets])
        value = np.concatenate(sets)
        order = np.argsort(value, kind="stable")
        value = value[order]
        self.ids = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]
        del order
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        self.value = value[new]
        del value
        self.start = np.append(np.flatnonzero(new), len(new))
        #: (list, id) of every posting as one sorted number, for binary probes
        self.posting = np.cumsum(new, dtype=np.int64)
        self.posting -= 1
        self.posting *= len(sets)
        self.posting += self.ids

    def linked(self, x: np.ndarray, open_: np.ndarray, num: int, den: int) -> np.ndarray:
        """Ids among ``open_`` (a mask) whose set links with x."""
        at = np.searchsorted(self.value, x)
        hit = at < len(self.value)
        hit[hit] = self.value[at[hit]] == x[hit]
        lists = at[hit]
        need = max(1, -(-len(x) * num // den))
        if len(lists) < need:
            return np.empty(0, np.int64)
        length = self.start[lists + 1] - self.start[lists]
        lists = lists[np.argsort(length, kind="stable")]
        length = np.sort(length)
        # merging a posting is far cheaper than probing for one
        n_long = int(min(need - 1, need / (np.log2(length[-1] + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        count = self.start[short + 1] - self.start[short]
        counts = np.zeros(len(self.size), np.int64)
        for a in range(0, len(short), MERGED):
            c = count[a : a + MERGED]
            counts += np.bincount(self.ids[np.repeat(self.start[short[a : a + MERGED]], c) + A.spans(c)], minlength=len(counts))
        ids = np.flatnonzero((counts >= max(1, need - n_long)) & open_)
        times = counts[ids]
        keep = (times >= need - n_long) & (self.size[ids] * den >= num * len(x)) & (len(x) * den >= num * self.size[ids])
        ids, times = ids[keep], times[keep]
        if n_long and len(ids):
            for a in range(0, n_long, MERGED):
                probe = (long[a : a + MERGED, None] * len(self.size) + ids[None, :]).ravel()
                at = np.searchsorted(self.posting, probe)
                found = (at < len(self.posting)) & (self.posting[np.minimum(at, len(self.posting) - 1)] == probe)
                times = times + found.reshape(-1, len(ids)).sum(0)
        return ids[times * den >= num * (len(x) + self.size[ids] - times)]


def group_components(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component of each set of a group (the number of one of its members)."""
    lists, n = Lists(sets), len(sets)
    label = np.arange(n)
    searched = np.zeros(n, bool)
    todo = np.array([int(lists.size.argmax())])
    while len(todo):
        # what a pass leaves outside the component that is largest at its end
        # and has not searched yet is searched in a later pass
        for x in todo:
            largest = np.bincount(label).argmax() if searched.any() else -1
            if label[x] == largest:
                continue
            searched[x] = True
            found = lists.linked(sets[x], label != label[x], num, den)
            if len(found):
                label[np.isin(label, label[found])] = label[x]
        todo = np.flatnonzero(~searched & (label != np.bincount(label, minlength=n).argmax()))
    return label


def _scan(shingle: int):
    def run(batches):
        for doc, ver, raw, offsets in C.text_batches(batches, SLICE):
            value, first = members(raw, offsets, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(ver), pa.array(np.diff(first).astype(np.int64)), pa.array(nodes(value, first))], names=["doc_id", "ver", "n", "node"])

    return run


def _reduced_parts(parts, buckets: int) -> pa.RecordBatch:
    """One entry per part hash of a slice; the others as edges to its least node."""
    key, node = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = node[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(node != head)
    pairs = np.unique(np.stack([node[other], head[other]]), axis=1) if len(other) else np.empty((2, 0), np.int64)
    one = np.flatnonzero(new)
    return A.packed(
        np.concatenate([(key[one] >> np.uint64(9)) % np.uint64(buckets), A.mix(pairs[0].view(np.uint64)) % np.uint64(buckets)]).astype(np.int64),
        key=np.concatenate([key[one], np.zeros(pairs.shape[1], np.uint64)]),
        node=np.concatenate([node[one], pairs[0]]), peer=np.concatenate([node[one], pairs[1]]),
    )


def _flushed(found, buckets: int):
    parts, held = [], 0
    for key, node in found:
        parts.append((key, node))
        held += len(key)
        if held >= FLUSH:
            yield _reduced_parts(parts, buckets)
            parts, held = [], 0
    if held:
        yield _reduced_parts(parts, buckets)


def _parts(shingle: int, num: int, den: int, buckets: int):
    def found(batches):
        for doc, ver, raw, offsets in C.text_batches(batches, SLICE):
            value, first = members(raw, offsets, shingle)
            key, row = signatures(value, first, num, den)
            yield key, nodes(value, first)[row]

    return lambda batches: _flushed(found(batches), buckets)


_MEMBER = {"key": np.uint32, "node": np.int64, "state": np.uint8}
#: Of a member in a slice: held by one set, the first of several, a count of those known to be shared.
ONE, FIRST = 0, 1


def _members_of(shingle: int, buckets: int):
    """Members by bucket, one entry each in a slice, and what the slice knows."""

    def reduced(parts):
        value, node = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((node, value))
        value, node = value[order], node[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])  # equal sets count once
        value, node = value[new], node[new]
        opens = np.ones(len(value), bool)
        opens[1:] = value[1:] != value[:-1]
        group = np.cumsum(opens) - 1
        several = np.bincount(group)[group] > 1
        one = np.flatnonzero(opens)
        state = np.where(several[one], FIRST, ONE).astype(np.uint8)
        known, times = np.unique(node[several], return_counts=True)
        # counts of 200 at most an entry, so they fit the state
        full = np.repeat(known, times // 200 + 1)
        rest = np.full(len(full), 200)
        rest[np.cumsum(times // 200 + 1) - 1] = times % 200
        dest = np.concatenate([(value[one] >> np.uint64(32)) % np.uint64(buckets), A.mix(full.view(np.uint64)) % np.uint64(buckets)])
        return A.packed(
            dest.astype(np.int64), key=np.concatenate([value[one].astype(np.uint32), np.zeros(len(full), np.uint32)]),
            node=np.concatenate([node[one], full]), state=np.concatenate([state, (rest + 2).astype(np.uint8)]))

    def run(batches):
        parts, held = [], 0
        for doc, ver, raw, offsets in C.text_batches(batches, SLICE):
            value, first = members(raw, offsets, shingle)
            parts.append((value, np.repeat(nodes(value, first), np.diff(first))))
            held += len(value)
            if held >= FLUSH:
                yield reduced(parts)
                parts, held = [], 0
        if held:
            yield reduced(parts)

    return run


def _shared_members(buckets: int):
    """(dest, node, n): members of a node that occur in another set, by bucket."""

    def run(batches):
        e = A.gathered(batches, **_MEMBER)
        known = e["state"] >= 2
        node, n = [e["node"][known]], [e["state"][known].astype(np.int64) - 2]
        key, one, owner = e["key"][~known], e["state"][~known] == ONE, e["node"][~known]
        if len(key):
            order = np.argsort(key, kind="stable")
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            group = np.cumsum(new) - 1
            weight = np.bincount(group, np.where(one[order], 1, 2))
            found = order[(weight[group] > 1) & one[order]]
            node.append(owner[found])
            n.append(np.ones(len(found), np.int64))
        node, n = np.concatenate(node), np.concatenate(n)
        order = np.argsort(node, kind="stable")
        node, n = node[order], n[order]
        at = np.flatnonzero(np.diff(node, prepend=node[0] - 1 if len(node) else 0)) if len(node) else np.empty(0, np.int64)
        total = np.add.reduceat(n, at) if len(at) else n
        node = node[at]
        yield A.packed((A.mix(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), node=node, n=total)

    return run


def _summed(batches):
    e = A.gathered(batches, node=np.int64, n=np.int64)
    node, at = np.unique(e["node"], return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(at, e["n"], minlength=len(node)).astype(np.int64))], names=["node", "shared"])


def _stars(batches):
    e = A.gathered(batches, key=np.uint64, node=np.int64, peer=np.int64)
    decided = e["node"] != e["peer"]
    pairs = [np.stack([e["node"][decided], e["peer"][decided]])]
    key, node = e["key"][~decided], e["node"][~decided]
    if len(key):
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = node[np.flatnonzero(new)][np.cumsum(new) - 1]
        pairs.append(np.stack([node, head])[:, node != head])
    u, v = np.unique(np.concatenate(pairs, axis=1), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _set_rows(shingle: int, *keys: str):
    """(keys..., node, members) of the nodes' representatives."""

    def run(batches):
        for b in batches:
            raw, offsets = A.bytes_of(b.column(b.schema.get_field_index("text")))
            want = b.column(b.schema.get_field_index("node")).to_numpy()
            for x, y in A.slices(offsets, SLICE):
                value, first = members(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], shingle)
                same = nodes(value, first) == want[x:y]
                out = [b.column(b.schema.get_field_index(c)).slice(x, y - x) for c in (*keys, "node")]
                rows = pa.RecordBatch.from_arrays([*out, A.binary(value, np.diff(first))], names=[*keys, "node", "members"])
                yield rows.filter(pa.array(same))

    return run


def _sets(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """(nodes in order, their sets), where the table has them."""
    node, at = np.unique(table["node"].to_numpy(), return_index=True)
    sets = [s for b in table.to_batches() for s in _views(b)]
    return node, [sets[i] for i in at]


def _inside(num: int, den: int):
    def run(batches):
        for t in C.runs(batches, ("grp", "blk")):
            node, sets = _sets(t)
            label = group_components(sets, num, den)
            g, b = t["grp"][0], t["blk"][0]
            yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(node), pa.int64()), pa.array([b.as_py()] * len(node), pa.int64()), pa.array(node), pa.array(node[label])], names=["grp", "blk", "node", "comp"])
            t = sets = None  # not held while the next block is read

    return run


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    raw, offsets = A.bytes_of(batch.column(batch.schema.get_field_index("members")))
    return [raw[x:y].view(np.uint64) for x, y in zip(offsets[:-1], offsets[1:])]


def _across(num: int, den: int):
    """Searches of nodes (query = 1) in one block; edges between components.
    A block's index comes first and is held, its searches pass by."""

    def run(batches):
        block, held, lists = None, [], None
        for (grp, blk, query), piece in C.pieces(batches, ("grp", "blk", "query")):
            if (grp, blk) != block:
                block, held, lists = (grp, blk), [], None
            if query == 0:
                held.append(piece)
                continue
            if not held and lists is None:
                continue
            if lists is None:
                comp = np.concatenate([h.column(h.schema.get_field_index("comp")).to_numpy() for h in held])
                lists, held = Lists([s for h in held for s in _views(h)]), []
            found = set()
            for c, s in zip(piece.column(piece.schema.get_field_index("comp")).to_numpy(), _views(piece)):
                for d in np.unique(comp[lists.linked(s, comp != c, num, den)]):
                    found.add((int(c), int(d)))
            if found:
                yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in sorted(found)], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


_PART = {"key": np.uint64, "node": np.int64, "kind": np.int32, "kept": np.int32}
#: ``n``: the sets that have a part, or less the number of a set's parts that no other has (no key then).
_RANKED = _PART | {"n": np.int64}


def _keys(num: int, den: int, buckets: int):
    """The fine parts of the sets, named within their group, by bucket."""

    def run(batches):
        for b in batches:
            raw, offsets = A.bytes_of(b.column(b.schema.get_field_index("members")))
            grp, node = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("grp", "node"))
            for x, y in A.slices(offsets, SLICE):
                value, first = raw[offsets[x] : offsets[y]].view(np.uint64), (offsets[x : y + 1] - offsets[x]) // 8
                key, row, kind, kept = fine_parts(value, first, num, den)
                key = A.mix(key ^ A.mix(grp[x:y].view(np.uint64))[row])
                yield A.packed(((key >> np.uint64(9)) % np.uint64(buckets)).astype(np.int64), key=key, node=node[x:y][row], kind=kind.astype(np.int32), kept=kept.astype(np.int32))

    return run


def _held_by(buckets: int):
    """By node: its parts that other sets have too, with the number of sets, and how
    many of its parts nobody else has."""

    def run(batches):
        e = A.gathered(batches, **_PART)
        order = np.argsort(e["key"], kind="stable")
        e = {c: v[order] for c, v in e.items()}
        new = np.ones(len(order), bool)
        new[1:] = e["key"][1:] != e["key"][:-1]
        n = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(order) else np.empty(0, np.int64)
        many, one = n > 1, np.flatnonzero(n == 1)
        one = one[np.lexsort((e["kind"][one], e["node"][one]))]
        opens = np.ones(len(one), bool)
        opens[1:] = (e["node"][one][1:] != e["node"][one][:-1]) | (e["kind"][one][1:] != e["kind"][one][:-1])
        at = np.flatnonzero(opens)
        out = {c: np.concatenate([v[many], v[one[at]]]) for c, v in e.items()}
        out["n"] = np.concatenate([n[many], -np.diff(np.append(at, len(one)))])
        yield A.packed((A.mix(out["node"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), **out)

    return run


def _rarest(batches):
    """(node, key): of each set and size class the parts that fewest sets have, as many as
    ``kept`` says; those that no other set has come first and lead nowhere."""
    e = A.gathered(batches, **_RANKED)
    order = np.lexsort((e["key"], e["n"], e["kind"], e["node"]))
    e = {c: v[order] for c, v in e.items()}
    new = np.ones(len(order), bool)
    new[1:] = (e["node"][1:] != e["node"][:-1]) | (e["kind"][1:] != e["kind"][:-1])
    group = np.cumsum(new) - 1
    alone = e["n"] < 0
    many = np.flatnonzero(~alone)
    if len(order):
        left = e["kept"][new] - np.bincount(group, np.where(alone, -e["n"], 0)).astype(np.int64)
        opens = np.concatenate([[0], np.cumsum(np.bincount(group, ~alone).astype(np.int64))])[:-1]
        many = many[np.arange(len(many)) - opens[group[many]] < left[group[many]]]
    yield pa.RecordBatch.from_arrays([pa.array(e["node"][many]), pa.array(e["key"][many].view(np.int64))], names=["node", "key"])


def _rare_stars(buckets: int):
    """The rarest parts of the sets as ``_parts`` gives all: one entry per part, the others as edges."""

    def run(batches):
        for b in _rarest(batches):
            if b.num_rows:
                yield _reduced_parts([(b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy())], buckets)

    return run


def _ranked(sets: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """The fine parts of sets (grp, node, members), with the number of the group's sets that have them, by node."""
    found = sets.mapInArrow(_keys(num, den, tasks), A.packed_schema(*_PART)).repartitionById(tasks, "dest")
    return found.mapInArrow(_held_by(tasks), A.packed_schema(*_RANKED)).repartitionById(tasks, "dest")


def _rare_keys(sets: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """(grp, blk, node, key): of each set and size class the parts that fewest
    sets of the group have, as many as suffice to meet every set it links with;
    without those that no other set has."""
    keys = C.saved(_ranked(sets, tasks, num, den).mapInArrow(_rarest, "node long, key long"), "keys")
    return C.saved(sets.select("grp", "blk", "node").join(keys, "node").select("grp", "blk", "node", "key"), "rare-keys")


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    roots = graph.components(edges).select(F.col("node").alias("comp"), "root")
    return labels.join(roots, "comp", "left").select("grp", "blk", "node", F.coalesce("root", "comp").alias("comp"))


def _routes(chosen: DataFrame, keys: DataFrame) -> DataFrame:
    """(grp, blk, node): the blocks that hold a key of a chosen node."""
    own = chosen.select("grp", "node").join(keys.select("grp", "node", "key"), ["grp", "node"])
    return own.join(keys.select("grp", "blk", "key").distinct(), ["grp", "key"]).select("grp", "blk", "node").distinct()


def _between_blocks(sets: DataFrame, labels: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """Links across the blocks of large groups: pivots first, then outsiders."""
    blocks = labels.select("grp", "blk").distinct()
    keys = _rare_keys(sets, tasks, num, den)
    for pivots_only in (True, False):
        sizes = labels.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"))
        leader = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("leader"))
        marked = labels.join(leader, "grp")
        if pivots_only:
            order = F.row_number().over(Window.partitionBy("grp").orderBy("node"))
            chosen = marked.where("comp = leader").withColumn("k", order).where(F.col("k") <= PIVOTS)
        else:
            chosen = marked.where("comp <> leader")
        asks = chosen.select("grp", "node", "comp")
        if pivots_only:
            asks = asks.join(blocks, "grp")
        else:  # to the blocks that hold one of its keys
            asks = asks.join(_routes(chosen, keys), ["grp", "node"])
        asks = asks.join(sets.select("grp", "node", "members"), ["grp", "node"]).select("grp", "blk", F.lit(1).alias("query"), "comp", "members")
        index = sets.join(labels.select("node", "comp"), "node").select("grp", "blk", F.lit(0).alias("query"), "comp", "members")
        rows = index.union(asks).repartition(tasks, "grp", "blk").sortWithinPartitions("grp", "blk", "query")
        labels = C.saved(_relabel(labels, rows.mapInArrow(_across(num, den), "u long, v long")), "labels")
    return labels


def _representatives(ids: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """The text of each wanted node, once: rows that share an id are told apart
    by version, and of a repeated row one is taken."""
    found = ids.join(wanted, ["doc_id", "ver"])
    if not repeated:
        return found
    return found.where("copies = 1").union(found.where("copies > 1").dropDuplicates(["node"]))


def version(text: Column) -> Column:
    """All 64 hash bits of a text, null as empty: one id may be that of many rows."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, block_members: int = BLOCK_MEMBERS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    found = decisions(docs, shingle, num, den, block_members, block_nodes)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep_id")).otherwise(F.col("doc_id")).alias("component_id"))


def decisions(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, block_members: int = BLOCK_MEMBERS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, ver, n, and (rep_id, rep_ver), the
    least (doc_id, ver) of its component (null, and no component, if n is 0)."""
    spark: SparkSession = docs.sparkSession
    docs = C.texts(docs).select("doc_id", version(F.col("text")).alias("ver"), "text")
    _, size = C.measure(docs)
    tasks = C.partitions(spark, size)
    with C.shuffle_cleanup(spark):
        rows = C.saved(docs.mapInArrow(_scan(shingle), "doc_id long, ver long, n long, node long"), "sets")
        copies = rows.where("n > 0").groupBy("node", "doc_id", "ver", "n").agg(F.count(F.lit(1)).alias("copies"))
        classes = C.saved(copies.groupBy("node", "n").agg(F.min(F.struct("doc_id", "ver", "copies")).alias("rep")), "classes")
        repeated = not classes.where("rep.copies > 1").isEmpty()
        ids = docs.select(F.coalesce("doc_id", F.lit(int(A.NULL_ID))).alias("doc_id"), "ver", "text")
        stored = None
        if num < SPARSE * den:
            found = docs.mapInArrow(_members_of(shingle, 2 * tasks), A.packed_schema(*_MEMBER)).repartitionById(2 * tasks, "dest")
            found = found.mapInArrow(_shared_members(tasks), A.packed_schema("node", "n")).repartitionById(tasks, "dest")
            shared = C.saved(found.mapInArrow(_summed, "node long, shared long"), "shared")
            # equal sets in several slices share all members; more sets is safe
            able = C.saved(classes.join(shared, "node").where(F.col("shared") * den >= F.col("n") * num), "able")
            able = able.select("node", "rep.*")
            # few texts are able, and only those meet the join
            own = C.KeyBitmap(C.saved(able.select(F.xxhash64("doc_id", "ver").alias("key")).distinct(), "able-keys"))
            texts = own.mark(ids, F.xxhash64("doc_id", "ver")).where("__open").drop("__open")
            stored = _representatives(texts, able, repeated).select("node", "text").mapInArrow(_set_rows(shingle), "node long, members binary")
            stored = C.saved(stored, "able-sets")
            stars = _ranked(stored.withColumn("grp", F.lit(0).cast("long")), tasks, num, den)
            stars = stars.mapInArrow(_rare_stars(tasks), A.packed_schema("key", "node", "peer"))
        else:
            stars = docs.mapInArrow(_parts(shingle, num, den, tasks), A.packed_schema("key", "node", "peer"))
        stars = stars.repartitionById(tasks, "dest").mapInArrow(_stars, "u long, v long")
        groups = C.saved(graph.components(stars).toDF("node", "grp"), "groups")

        placed = groups.join(classes, "node")
        need = F.greatest(F.sum("n") / F.lit(block_members), F.count(F.lit(1)) / F.lit(block_nodes))
        cut = placed.groupBy("grp").agg(F.ceil(need).alias("blocks"))
        placed = placed.join(cut, "grp").select("grp", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("blk"), "node", "rep", "blocks")
        many = placed.where("blocks > 1").select("grp").distinct()
        if stored is None:
            wanted = placed.select("grp", "blk", "node", "rep.*")
            sets = _representatives(ids, wanted, repeated).select("grp", "blk", "node", "text").mapInArrow(_set_rows(shingle, "grp", "blk"), "grp long, blk long, node long, members binary")
        else:
            sets = stored.join(placed.select("grp", "blk", "node"), "node").select("grp", "blk", "node", "members")
        sets = sets.repartition(tasks, "grp", "blk").sortWithinPartitions("grp", "blk")
        inside = "grp long, blk long, node long, comp long"
        if not many.isEmpty():
            sets = C.saved(sets.dropDuplicates(["node"]), "set-rows")
            labels = C.saved(sets.repartition(tasks, "grp", "blk").sortWithinPartitions("grp", "blk").mapInArrow(_inside(num, den), inside), "labels")
            some = labels.join(many, "grp", "left_semi")
            some = _between_blocks(sets.join(many, "grp", "left_semi"), some, tasks, num, den)
            labels = some.union(labels.join(many, "grp", "left_anti"))
        else:
            labels = C.saved(sets.mapInArrow(_inside(num, den), inside), "labels")
    rooted = classes.join(labels.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = rooted.groupBy("comp").agg(F.min("rep").alias("least"))
    of_node = rooted.join(least, "comp").select("node", "least")
    null_id = F.lit(int(A.NULL_ID))
    return rows.join(of_node, "node", "left").select(
        F.nullif("doc_id", null_id).alias("doc_id"), "ver", "n",
        F.nullif(F.col("least.doc_id"), null_id).alias("rep_id"), F.col("least.ver").alias("rep_ver"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(C.load(spark, sf_dir, "documents"))

"""Passages that repeat across documents: compact windows over min-hashed shingles.

A text is the sequence of its five-word shingles.  Under one hash function, the compact window
of position c is the longest stretch in which c has the smallest hash; all stretches inside it that
contain c share that minimum.  The windows are the nodes of the Cartesian tree of the hashes, and
only those wide enough to hold a passage matter: about 2n / width of n positions.  Two windows with
equal minima, laid over each other at c, overlap in all passages that they may share.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.llm.setup import join_ids
from tutelage.llm.words import each_block, mix
from tutelage.session import discard, stored

WORDS = 5
MIN_WORDS = 50     # of a passage
HASHES = 4         # a passage pair at 0.8 shares no minimum with probability 0.0016
#: A window is one number: c, then how far it reaches before and after c, in so many bits each.
REACH_BITS = 12
SLOT_BITS = 16     # a slot for the first bits of a mark, of 31; one more, the last, is for no mark (-1)
PAIRS = 1 << 17    # meetings of open windows and others of their groups, by a mark, that are looked at at a time
ROWS = 1 << 10     # pairs of sequences that are compared at a time
TURNS = 1 << 8     # open windows whose marks are searched at a time


def wide_nodes(values: np.ndarray, width: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian tree's nodes whose stretch l..r has at least ``width`` places.

    ``values`` are those of one text, or of many with text d at first[d] to first[d + 1].  Of equal
    values the left one is the smaller.  A node is wide exactly when it is the minimum of
    some ``width`` places, so sliding minima find the nodes; the nearest smaller places
    of a wide node are wide themselves, so the bounds come from the wide nodes alone.
    """
    n = len(values)
    first = np.array([0, n]) if first is None else first
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    # rank by value, then place: no ties, and minima of ranks are minima of values
    where = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[where] = np.arange(n)
    size = -(-n // width) * width
    padded = np.full(size, n, np.int64)
    padded[:n] = rank
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    inside = np.repeat(first[1:], np.diff(first))[:n - width + 1] >= np.arange(width, n + 1)
    wide = np.zeros(n, bool)
    wide[where[least[inside]]] = True
    nodes = np.flatnonzero(wide)
    # the ends of texts are smaller than everything
    edges = np.unique(first)
    place = np.concatenate([nodes, edges])
    is_edge = np.concatenate([np.zeros(len(nodes), bool), np.ones(len(edges), bool)])
    by = np.lexsort((~is_edge, place))
    place, is_edge = place[by], is_edge[by]
    order = np.where(is_edge, -1, rank[np.minimum(place, n - 1)]).tolist()
    left, right = [0] * len(order), [0] * len(order)
    stack: list[int] = []
    for k, value in enumerate(order):
        while stack and order[stack[-1]] > value:
            right[stack.pop()] = k
        if value < 0:
            stack = [k]
            continue
        left[k] = stack[-1]
        stack.append(k)
    before = np.where(is_edge, place, place + 1)
    node = ~is_edge
    return nodes, before[np.array(left)][node], place[np.array(right)][node] - 1


def run_ends(c: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Which of the ascending nodes are not inside a run of one shingle; ``again`` marks places that
    repeat the one before.  A stretch from inside a run holds the same set of shingles as the stretch
    from the run's first place, which is a node too; the last node lines up what follows the run."""
    inner = again[c]
    inner[:-1] &= again[c[1:]] & (c[1:] == c[:-1] + 1)
    inner[-1:] = False
    return ~inner


def _windows(min_words: int):
    width = min_words - WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, texts in each_block(batch, "text"):
                shingles, first = texts.shingles(WORDS)
                again = np.zeros(len(shingles), bool)
                again[1:] = shingles[1:] == shingles[:-1]
                again[first[:-1][np.diff(first) > 0]] = False
                rows, keys, places = [], [], []
                for f in range(HASHES):
                    nodes = wide_nodes(mix(shingles + np.uint64(1000003 * (f + 1))), width, first)
                    ends = run_ends(nodes[0], again)
                    c, low, high = (x[ends] for x in nodes)
                    d = np.searchsorted(first, c, "right") - 1
                    before, after = np.minimum(c - low, width - 1), np.minimum(high - c, width - 1)
                    rows.append(at + d)
                    keys.append(mix(shingles[c] + np.uint64(f)).view(np.int64))
                    places.append(((c - first[d]) << 2 * REACH_BITS) | (before << REACH_BITS) | after)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys)),
                     pa.array(np.concatenate(places))], ["doc_id", "key", "place"])

    return run


def _c(place: Column) -> Column:
    return F.shiftright(place, 2 * REACH_BITS)


def _before(place: Column) -> Column:
    return F.shiftright(place, REACH_BITS).bitwiseAND(F.lit((1 << REACH_BITS) - 1))


def _after(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << REACH_BITS) - 1))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, last, texts in each_block(batch, "text"):
            shingles, first = texts.shingles(WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, last - at),
                 pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(
                     (shingles & np.uint64(0x7FFFFFFF)).astype(np.int32)))],
                ["doc_id", "sequence"])


def common_passages(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start in a, end, start in b, end, similarity) of passages that a and b have in common.

    A passage of b is a union of stretches of ``width`` shingles so many of which occur in a
    that the similarity may be reached; with the part of a that its shingles span, the Jaccard
    similarity of the two shingle sets has to reach it.  Shingles are joined only along one
    alignment (place in a minus place in b, give or take ``width``), and what fails as one
    passage is tried in the parts between its gaps.  Ends are exclusive.
    """
    a, b = a.tolist(), b.tolist()
    n = len(a)
    if n == 0 or len(b) < width:
        return []
    places: dict[int, list[int]] = {}
    for place, value in enumerate(a):
        places.setdefault(value, []).append(place)
    known = [places.get(value) for value in b]
    free = [x is not None for x in known]       # shingles of b that no alignment has used
    need = int(np.ceil(2 * similarity / (1 + similarity) * width - 1e-9))
    out = []
    begin = 0
    while True:
        # the first stretches that share enough, as far as they lie at most their width apart
        inside, good, last = sum(free[begin:begin + width]), None, 0
        for start in range(begin, len(b) - width + 1):
            if inside >= need:
                good, last = start if good is None else good, start
            elif good is not None and start - last >= width:
                break
            if start + width < len(b):
                inside += free[start + width] - free[start]
        if good is None:
            return out
        begin, end = good, last + width
        hit = [k for k in range(begin, end) if free[k]]
        head = bisect_left(hit, begin + width)
        offsets = np.array([x - k for k in hit[:head] for x in known[k]])
        offsets.sort()
        beyond = np.searchsorted(offsets, offsets + width // 4, "right")
        most = int(np.argmax(beyond - np.arange(len(offsets))))
        offset = int(offsets[(most + beyond[most]) // 2])
        own, other = [], []
        for k in hit:
            place = known[k][0] if len(known[k]) == 1 else _nearest(known[k], k + offset)
            if abs(place - k - offset) <= width:
                own.append(k)
                other.append(place)
                free[k] = False
        free[hit[0]] = False
        out += _parts(a, b, own, other, need, similarity)


def _nearest(places: list[int], wanted: int) -> int:
    """The one of the ascending places nearest to the wanted one, the lower of two as near."""
    above = bisect_left(places, wanted)
    if above == 0 or (above < len(places) and places[above] - wanted < wanted - places[above - 1]):
        return places[above]
    return places[above - 1]


def _parts(a: list[int], b: list[int], hit: list[int], places: list[int], need: int,
           similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The aligned shingles as one passage if that is similar enough, else the parts between
    their widest gaps, down to the fewest shingles a passage can share."""
    out, todo = [], [(0, len(hit))]
    while todo:
        low, high = todo.pop()
        if high - low < need:
            continue
        own, other = hit[low:high], places[low:high]
        a_start, a_end, start, end = min(other), max(other) + 1, own[0], own[-1] + 1
        left, right = set(a[a_start:a_end]), set(b[start:end])
        shared = len(left & right)
        like = shared / (len(left) + len(right) - shared)
        if like >= similarity:
            out.append((a_start, a_end, start, end, like))
            continue
        gaps = [max(v - u, abs(y - x)) for u, v, x, y in zip(own, own[1:], other, other[1:])]
        widest = max(gaps)
        if widest > 1:
            cuts = [low, *(low + k for k, gap in enumerate(gaps, 1) if gap >= max(2, widest // 2)), high]
            todo += list(zip(cuts, cuts[1:]))
    return sorted(out, key=lambda p: p[2])


def may_share(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Which pairs of sequences, given one after the other, have a stretch of ``width`` in b that
    shares with a as much as ``common_passages`` needs to begin a passage; all others have none."""
    need = int(np.ceil(2 * similarity / (1 + similarity) * width - 1e-9))
    known = np.sort(np.repeat(np.arange(len(a_size)), a_size) << 32 | a)
    row = np.repeat(np.arange(len(b_size)), b_size)
    wanted = row << 32 | b
    if not len(known) or len(b) < width:
        return np.zeros(len(b_size), bool)
    found = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
    total = np.concatenate([[0], np.cumsum(found)])
    good = (total[width:] - total[:-width] >= need) & (row[width - 1:] == row[:len(row) - width + 1])
    out = np.zeros(len(b_size), bool)
    out[row[np.flatnonzero(good)]] = True
    return out


def _verify(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            found = []
            parts = [batch.column(c) for c in ("a_part", "b_part")]
            flats = [p.flatten().to_numpy() for p in parts]
            sizes = [p.value_lengths().to_numpy().astype(np.int64) for p in parts]
            edges = [np.concatenate([[0], np.cumsum(size)]) for size in sizes]
            names = {c: batch.column(c).to_pylist() for c in ("a_doc", "b_doc", "a_from", "b_from")}
            for k in np.flatnonzero(may_share(flats[0], sizes[0], flats[1], sizes[1], width, similarity)).tolist():
                a, b = (flat[e[k]:e[k + 1]] for flat, e in zip(flats, edges))
                for x, y, u, v, like in common_passages(a, b, width, similarity):
                    low, high = names["a_from"][k], names["b_from"][k]
                    found.append((names["b_doc"][k], high + u, high + v + WORDS - 1, names["a_doc"][k], low + x,
                                  low + y + WORDS - 1, like))
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64())],
                    ["doc_id", "start_word", "end_word", "like_id", "like_start", "like_end", "similarity"])

    return run


def _around(width: int, similarity: float) -> int:
    """So many shingles before and after c hold all stretches of ``width`` around c and their like."""
    return int(np.ceil(width / similarity))


def _beside(width: int, missing: int) -> tuple[np.ndarray, int]:
    """Places on one side of c, and how many of them at least, on one of the sides, are shared by a
    stretch of ``width`` around c that does not share ``missing``: it reaches half its width there."""
    half = width // 2
    far = np.arange(max(half - 2 * missing, 0), half + 1)
    return far, max(len(far) - missing, 1)


def _second_look(width: int, similarity: float):
    """Pairs of alike windows in groups that the first centre left open; rows come by group.

    An open window is linked with all other open ones that are like it, which form its cluster, and
    with one of each other cluster, which becomes one with its own.  The settled ones are linked by
    their centre, so they are one cluster.  A window is compared only with windows
    that share enough marks with it beside c, and then enough around c; others cannot be like it.
    They meet by the rarest marks, so a phrase that all windows of a group share makes no pairs.
    """
    side = _around(width, similarity)
    need = int(np.ceil(2 * similarity / (1 + similarity) * width - 1e-9))
    far, enough = _beside(width, width - need)

    beside = np.concatenate([side - far, side + far])

    def index(places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marks, rows), by mark, of the rarest marks beside c, so many of each side that one of them
        is shared wherever enough of that side are."""
        marks = places[:, beside].reshape(-1, len(far))
        marks = np.where(marks >= 0, np.repeat(group, 2)[:, None] << 32 | marks, np.int64(-1))
        _, which, many = np.unique(marks, return_inverse=True, return_counts=True)
        often = np.where(marks >= 0, many[which.reshape(marks.shape)], len(marks) * len(far) + 1)
        order = np.argsort(often, axis=1, kind="stable")
        spare = (marks >= 0).sum(axis=1) - enough
        line, rank = np.nonzero(np.arange(len(far)) <= spare[:, None])
        marks, row = marks[line, order[line, rank]], line // 2
        order = np.lexsort((row, marks))
        marks, row = marks[order], row[order]
        fresh = np.ones(len(marks), bool)
        fresh[1:] = (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])
        return marks[fresh], row[fresh]

    def candidates(places: np.ndarray, group: np.ndarray, doc: np.ndarray, is_open: np.ndarray, cluster: np.ndarray
                   ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pivots, others) that may share enough marks beside c, for the open rows in order that are
        in no cluster when their turn comes; about ``PAIRS`` meetings at a time."""
        marks, row = index(places, group)
        if not len(marks):
            return
        marks, where, many = np.unique(marks, return_index=True, return_counts=True)
        turns = np.flatnonzero(is_open)
        for at in range(0, len(turns), TURNS):
            now = turns[at:at + TURNS]
            now = now[cluster[now] < 0]
            if not len(now):
                continue
            own = np.sort(places[now], axis=1)
            mine, column = np.nonzero((own >= 0) & np.concatenate([np.ones((len(now), 1), bool), own[:, 1:] != own[:, :-1]], axis=1))
            own = group[now][mine] << 32 | own[mine, column]
            found = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
            known = np.flatnonzero(marks[found] == own)
            mine, begin, times = mine[known], where[found[known]], many[found[known]]
            meetings = np.concatenate([[0], np.cumsum(times)])
            last = np.searchsorted(mine, np.arange(len(now)), "right")
            k = 0
            while k < len(now):
                low = last[k - 1] if k else 0
                upto = max(int(np.searchsorted(meetings[last], meetings[low] + PAIRS, "right")), k + 1)
                part = np.arange(low, last[upto - 1])
                k = upto
                part = part[cluster[now[mine[part]]] < 0]
                if not len(part):
                    continue
                t = times[part]
                hit = row[np.repeat(begin[part] - np.cumsum(t) + t, t) + np.arange(t.sum())]
                met = np.unique(np.repeat(mine[part], t) * len(doc) + hit)
                pivots, others = now[met // len(doc)], met % len(doc)
                apart = doc[others] != doc[pivots]
                yield pivots[apart], others[apart]

    def near(places: np.ndarray, pivot: int, others: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Those of ``others`` with so many marks of the pivot beside c, and in a stretch around c, that
        they may be like it; those with the most marks at the pivot's places first."""
        own = places[pivot] >> 31 - SLOT_BITS
        seen[own] = True
        seen[-1] = False
        shared = seen[places[others[:, None], beside] >> 31 - SLOT_BITS].reshape(-1, 2, len(far)).sum(axis=2, dtype=np.int8)
        others = others[(shared >= enough).any(axis=1)]
        around = places[others, side - width + 1:side + width]
        inside = seen[around >> 31 - SLOT_BITS].view(np.int8)
        seen[own] = False
        some = np.flatnonzero(inside.sum(axis=1, dtype=np.int16) >= need)
        total = np.zeros((len(some), 2 * width), np.int16)
        np.cumsum(inside[some], axis=1, dtype=np.int16, out=total[:, 1:])
        some = some[(total[:, width:] - total[:, :-width] >= need).any(axis=1)]
        same = (around[some] == places[pivot, side - width + 1:side + width]).sum(axis=1)
        return others[some[np.argsort(-same, kind="stable")]]

    def alike(places: np.ndarray, pivot: int, other: int) -> bool:
        a, b = places[pivot], places[other]
        same = (a == b) & (a >= 0)
        before, after = same[:side + 1][::-1], same[side:]
        run = (side + 1 if before.all() else int(before.argmin())) + (side + 1 if after.all() else int(after.argmin())) - 1
        return run >= width or bool(common_passages(a[a >= 0], b[b >= 0], width, similarity))

    def linked(places: np.ndarray, group: np.ndarray, doc: np.ndarray, is_open: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, int]]:
        cluster = np.where(is_open, -1, len(doc) + group)   # a pivot each; the settled ones of a group are one
        members: dict[int, list[int]] = {}                  # the open ones
        for pivots, others in candidates(places, group, doc, is_open, cluster):
            starts = np.flatnonzero(np.diff(pivots, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], len(pivots)]):
                pivot = int(pivots[start])
                if cluster[pivot] >= 0:
                    continue
                joined, fresh, rest, many = {pivot}, [], others[start:end], 32
                while len(rest):
                    for other in near(places, pivot, rest[:many], seen).tolist():
                        # the first of each cluster that is like the pivot
                        kind = int(cluster[other])
                        if kind not in joined and alike(places, pivot, other):
                            yield pivot, other
                            if kind < 0:
                                fresh.append(other)
                            else:
                                joined.add(kind)
                    rest = rest[many:]
                    if len(rest) and len(joined) > 1:
                        rest = rest[~np.isin(cluster[rest], list(joined))]
                    many *= 4
                to = max(joined)
                for kind in joined - {to}:
                    members.setdefault(to, []).extend(members.pop(kind, []))
                members.setdefault(to, []).extend([pivot, *fresh])
                cluster[members[to] if len(joined) > 1 else [pivot, *fresh]] = to

    def pairs(table: pa.Table, seen: np.ndarray) -> pa.RecordBatch | None:
        key, doc, c, settled = (table.column(x).to_numpy() for x in ("key", "doc_id", "c", "settled"))
        around = table.column("around").combine_chunks()
        size, values = around.value_lengths().to_numpy(), around.flatten().to_numpy()
        row = np.repeat(np.arange(len(key)), size)
        column = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(side - np.minimum(c, side), size)
        places = np.full((len(key), 2 * side + 1), -1, np.int32)
        places[row, column] = values
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        order = np.lexsort((c, doc, group))
        found = list(linked(places[order], group, doc[order], ~settled[order], seen))
        if not found:
            return None
        a, b = order[np.array(found)].T
        a, b = np.where(doc[a] < doc[b], a, b), np.where(doc[a] < doc[b], b, a)
        ends = [np.maximum(c[x] + y, 0) for x in (a, b) for y in (-side, side)]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[a]), pa.array(doc[b]), *map(pa.array, ends)],
            ["a_doc", "b_doc", "a_low", "a_high", "b_low", "b_high"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if kept and (cut or kept[-1].column("key")[0].as_py() != key[0]):
                yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
                kept = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            kept.append(batch.slice(cut))
        if kept:
            yield pa.Table.from_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << SLOT_BITS) + 1, bool)
        for group in groups(batches):
            out = pairs(group, seen)
            if out is not None:
                yield out

    return run


def _compared(over: DataFrame, sequences: DataFrame, width: int, similarity: float) -> DataFrame:
    """Passages of each pair of documents in what their windows cover."""
    compared = stored(over.groupBy("a_doc", "b_doc").agg(
        *(F.min(f"{x}_low").alias(f"{x}_low") for x in "ab"), *(F.max(f"{x}_high").alias(f"{x}_high") for x in "ab")),
        "regions")
    wanted = stored(compared.select(F.col("a_doc").alias("doc_id")).union(compared.select("b_doc")).distinct(), "wanted")
    sequences = join_ids(sequences, wanted, "left_semi")
    for x in "ba":
        part = F.slice("sequence", (F.col(f"{x}_from") + 1).cast("int"),
                       (F.col(f"{x}_high") - F.col(f"{x}_from") + 1 + width).cast("int"))
        compared = (
            compared.withColumn(f"{x}_from", F.greatest(F.col(f"{x}_low") - width, F.lit(0)))
            .join(sequences.withColumnRenamed("doc_id", f"{x}_doc"), f"{x}_doc")
            .withColumn(f"{x}_part", part).drop("sequence"))
    compared = compared.select("a_doc", "b_doc", "a_from", "b_from", "a_part", "b_part")
    return stored(compared.mapInArrow(
        _verify(width, similarity), "doc_id long, start_word long, end_word long, like_id long, like_start long, "
        "like_end long, similarity double").distinct(), "found")


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = 0.8,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: doc_id, start_word, end_word, like_id, like_start, like_end,
    similarity.

    Words start_word to end_word (exclusive) of document ``doc_id`` repeat words of ``like_id``, the
    smallest id among the windows it met: a passage that many documents share gives a row for
    each of them and that one, not for every two.  Passages are stretches of at least ``min_words``
    words, given from their first to their last shared shingle, and the Jaccard similarity of their five-word shingle sets is at least ``similarity``;
    passages found over several windows are one row.  An exact repetition shares the minimum
    under every hash and is always found; an edited one may be missed when its edits hit
    all four minima.

    Repetitions inside one document are not reported.  Shorter, null and empty texts have no
    passages; a null id takes part in nothing; rows that repeat an id count as one document.
    Other columns are not used.

    A run of one shingle has the windows of its first and last place only.  Windows whose minimum
    occurs once in the corpus are dropped by a count that carries only the key.  Of the others, groups that agree in the minimum are stars around their smallest window.
    Where a group has members that no passage shared with it covers, its windows with equal
    surroundings become one, and an open one is linked with one of each cluster that is like it.  The
    stretches that a pair of documents may share are merged and only that part of both sequences is
    compared, by 31 bits of each shingle's hash.  No rows give no rows.
    """
    width = min_words - WORDS + 1
    if width >= 1 << REACH_BITS:
        raise ValueError(f"passages of {min_words} words or more cannot be told apart")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    windows = stored(own.mapInArrow(_windows(min_words), "doc_id long, key long, place long"), "windows", compression="zstd")
    shared = windows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(
        "low < high").select("key")
    placed = stored(windows.join(shared, "key", "left_semi"), "placed", compression="zstd")
    discard(windows)
    centre = placed.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("m"), F.count("*").alias("n"))
    members = placed.join(centre, "key")
    wanted = stored(placed.select("doc_id").distinct(), "wanted")
    sequences = stored(
        join_ids(own, wanted, "left_semi").mapInArrow(
            _sequences, "doc_id long, sequence array<int>"), "sequences")
    # what both windows cover, as seen from their common minimum
    own_c, centre_c = _c(F.col("place")), _c(F.col("m.place"))
    before = F.least(_before(F.col("place")), _before(F.col("m.place")))
    after = F.least(_after(F.col("place")), _after(F.col("m.place")))
    over = members.where("doc_id <> m.doc_id").where(before + after + 1 >= width).select(
        F.col("m.doc_id").alias("a_doc"), F.col("doc_id").alias("b_doc"),
        (centre_c - before).alias("a_low"), (centre_c + after).alias("a_high"),
        (own_c - before).alias("b_low"), (own_c + after).alias("b_high"))
    found = _compared(over, sequences, width, similarity)
    # members that no passage shared with their centre covers
    spans = found.groupBy("doc_id", "like_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    settled = F.coalesce(F.exists("spans", lambda s: (s["start_word"] <= F.col("c")) & (
        F.col("c") + WORDS <= s["end_word"])), F.lit(False))
    others = stored(
        members.where("n > 2 and not (doc_id = m.doc_id and place = m.place)").select(
            "key", "doc_id", _c(F.col("place")).alias("c"), F.col("m.doc_id").alias("like_id"))
        .join(spans, ["doc_id", "like_id"], "left").select("key", "doc_id", "c", settled.alias("settled")),
        "others", compression="zstd")
    discard(placed)
    side = _around(width, similarity)
    low = F.greatest(F.col("c") - side, F.lit(0))
    around = F.slice("sequence", (low + 1).cast("int"), (F.col("c") - low + side + 1).cast("int"))
    again = others.groupBy("key").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("settled").alias("all")).where(
        "low < high and not all").select("key")
    left = stored(others.join(again, "key", "left_semi").join(sequences, "doc_id").select(
        "key", "doc_id", "c", "settled", F.xxhash64(around, F.col("c") - low).alias("mark")), "open", compression="zstd")
    discard(others)
    # windows with equal surroundings have the smallest as centre; the others are linked with it
    kinds = stored(left.groupBy("key", "mark").agg(
        F.min(F.struct("doc_id", "c")).alias("m"), F.min("settled").alias("settled")), "kinds", compression="zstd")
    same = left.where("not settled").join(kinds.select("key", "mark", "m"), ["key", "mark"]).where("doc_id <> m.doc_id").select(
        F.col("m.doc_id").alias("a_doc"), F.col("doc_id").alias("b_doc"),
        *(x.alias(name) for x, name in (
            (F.greatest(F.col("m.c") - side, F.lit(0)), "a_low"), (F.col("m.c") + side, "a_high"),
            (F.greatest(F.col("c") - side, F.lit(0)), "b_low"), (F.col("c") + side, "b_high"))))
    several = kinds.groupBy("key").agg(
        F.min("m.doc_id").alias("low"), F.max("m.doc_id").alias("high"), F.min("settled").alias("all")).where(
        "low < high and not all").select("key")
    alike = kinds.join(several, "key", "left_semi").select("key", "m.doc_id", "m.c", "settled").join(
        sequences, "doc_id").select("key", "doc_id", "c", "settled", around.alias("around")).repartition(
        "key").sortWithinPartitions("key").mapInArrow(
            _second_look(width, similarity), "a_doc long, b_doc long, a_low long, a_high long, b_low long, b_high long")
    return _merged(found.union(_compared(same.union(alike), sequences, width, similarity)).distinct())


def _merged(found: DataFrame) -> DataFrame:
    """Passages of the same two documents that overlap in both as one; they are bounded by the texts."""
    spans = found.groupBy("doc_id", "like_id").agg(F.sort_array(F.collect_set(F.struct(
        "start_word", "end_word", "like_start", "like_end", "similarity"))).alias("all"))
    kind = "array<struct<start_word:bigint,end_word:bigint,like_start:bigint,like_end:bigint,similarity:double>>"
    joined = F.aggregate(
        "all", F.array().cast(kind),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start_word"] < F.element_at(done, -1)["end_word"])
            & (s["like_start"] < F.element_at(done, -1)["like_end"])
            & (F.element_at(done, -1)["like_start"] < s["like_end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start_word"].alias("start_word"),
                F.greatest(F.element_at(done, -1)["end_word"], s["end_word"]).alias("end_word"),
                F.least(F.element_at(done, -1)["like_start"], s["like_start"]).alias("like_start"),
                F.greatest(F.element_at(done, -1)["like_end"], s["like_end"]).alias("like_end"),
                F.least(F.element_at(done, -1)["similarity"], s["similarity"]).alias("similarity"))))
        ).otherwise(F.concat(done, F.array(s))))
    return spans.select("doc_id", "like_id", F.explode(F.when(F.size("all") > 1, joined).otherwise(F.col("all"))).alias("p")).select(
        "doc_id", "p.start_word", "p.end_word", "like_id", "p.like_start", "p.like_end", "p.similarity")

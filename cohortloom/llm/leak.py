"""Held-out passages inside a corpus (problem 7).

Only letters and digits count, folded and in lower case. An item of L letters must stand there by half, and the half
may have suffered one edit in six letters, its error budget. The item is cut into pieces so short that each half holds
more whole pieces than its budget has edits; by the pigeonhole principle ``need`` of them at least stay unaltered, close
to one diagonal. Exact hits are counted in bands of diagonals and the pairs that reach their ``need`` are verified:
blocks of the item are looked for beside the hits with Myers' bit-parallel distance, runs of blocks found are grown
letter by letter to passages, and the best two say how much of the item stands there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codepoints as cp
from cohortloom.llm.letters import letters, steps, window_hashes
from cohortloom.store import materialize

#: Letters of a block that is verified at once, for items that are mostly Han and for others.
BLOCK = (8, 16)
#: Letters of a piece, in the same order.
PIECE = (3, 4)
#: Letters to one edit where half of the item stands in one passage; in two, of a quarter each, twice as many.
LETTERS_PER_EDIT = 6
#: Edits of a verified passage, as a share of its letters.
PASSAGE_EDITS = 0.22
#: Edits that a block bears, as a share of its letters: more than a passage, as edits do not lie evenly.
BLOCK_EDITS = 0.3
#: Unaltered letters of both passages, as a share of the item, from which it counts: half, of which one in twenty may be altered.
LEAST_COVER = 0.475
#: Blocks between a block and the nearest exact hit.
REACH = 1
#: Letters of benchmark items that are sent to the tasks at once.
ITEM_LETTERS = 4_000_000
#: Letters of documents worked on at once, letters among which hits are counted at once, and width of a half band of diagonals as a power of two.
STEP_LETTERS, COUNTED, BAND = 250_000, 16_000, 2
#: Places of candidates looked at at once.
PLACES = 2_000_000

FOUND = "doc_id long, item_id long, cover double, passages int"


class Items:
    """Pieces and blocks of all items of a set, as sorted arrays. Items shorter than a block are one piece each."""

    def __init__(self, ids: np.ndarray, cps: np.ndarray, off: np.ndarray):
        self.ids, self.cps, self.off = ids, cps, off
        self.length = np.diff(off)
        han = cp.row_counts(cp.is_han()[cps], off)
        self.kind = np.where(2 * han > self.length, 0, 1)
        self.size = np.array(BLOCK)[self.kind]
        self.short = self.length < self.size
        self.piece = np.where(self.short, self.length, np.array(PIECE)[self.kind])
        whole = lambda part, per: (part - self.piece + 1) // np.maximum(1, self.piece) - part // per
        least = np.minimum(whole(self.length // 2, LETTERS_PER_EDIT), whole(self.length // 4, 2 * LETTERS_PER_EDIT))
        self.need = np.where(self.short, 1, np.maximum(1, least))
        self.longest = int(self.length.max()) if len(ids) else 0
        self.tables = []
        for q in np.unique(self.piece[self.length > 0]):
            own = np.flatnonzero((self.piece == q) & (self.length > 0))
            count = self.length[own] // q
            who = np.repeat(own, count)
            at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * q
            h = window_hashes(cps, int(q))[off[who] + at]
            order = np.argsort(h, kind="stable")
            h = h[order]
            distinct, first = np.unique(h, return_index=True)
            sieve = np.zeros(1 << 22, bool)
            sieve[distinct >> np.uint64(42)] = True
            both = np.repeat(np.arange(len(distinct)), np.diff(np.append(first, len(h)))) * len(ids) + who[order]  # ascending: equal hashes keep the order of items
            held = np.zeros(1 << 22, bool)
            held[both & len(held) - 1] = True
            self.tables.append((int(q), distinct, np.append(first, len(h)), who[order], at[order], sieve, both, held))

    def pieces(self, cps: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each table (positions of text that hold some piece of it, numbers of those pieces)."""
        out = []
        inner = np.ones(len(cps) + 1, np.int64)
        for q, distinct, _, _, _, sieve, _, _ in self.tables:
            x = window_hashes(cps, q)
            p = np.flatnonzero(sieve[x >> np.uint64(42)])
            k = np.searchsorted(distinct, x[p])
            same = distinct[np.minimum(k, len(distinct) - 1)] == x[p]
            p, k = p[same], k[same]
            inner[:] = 0
            inner[off[1:-1]] = 1  # a window may not reach over the end of its document
            ends = np.cumsum(inner)
            inside = ends[p] == ends[p + q - 1]
            out.append((p[inside], k[inside]))
        return out

    def bands(self, table: int, p: np.ndarray, k: np.ndarray, span: int) -> np.ndarray:
        """Sorted numbers item * span + band of the hits of pieces ``k`` at positions ``p``, in 32 bits where they fit."""
        first, who, at = self.tables[table][2:5]
        kind = np.int32 if len(self.ids) * span + len(at) < 2**31 else np.int64
        lo, n = first[k], first[k + 1] - first[k]
        end = np.cumsum(n)
        j = np.repeat((lo - end + n).astype(kind), n)
        j += np.arange(len(j), dtype=kind)
        key = np.repeat(p.astype(kind), n)
        key += (self.longest - at).astype(kind)[j]
        key >>= BAND
        key += (who * span).astype(kind)[j]
        key.sort()
        return key

    def of(self, table: int, k: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, offset in item) of the hits of pieces ``k`` in the one item given for each."""
        at, both, held = self.tables[table][4], *self.tables[table][6:]
        key = k * len(self.ids) + item
        row = np.flatnonzero(held[key & len(held) - 1])
        lo, hi = np.searchsorted(both, key[row], "left"), np.searchsorted(both, key[row], "right")
        n = hi - lo
        end = np.cumsum(n)
        return np.repeat(row, n), at[np.repeat(lo - end + n, n) + np.arange(end[-1] if len(end) else 0)]


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of each pattern row to any substring of its text row, column after that substring).

    Patterns have 8, 16, 32 or 64 symbols. The bit-parallel recurrence runs for all rows at once, one text column at a
    time. Text may be padded with symbols that occur in no pattern. Of equal distances the first column counts.
    """
    size = pattern.shape[1]
    kind = np.dtype(f"<u{size // 8}")
    one, top = kind.type(1), kind.type(1 << (size - 1))
    pv, mv = np.full(len(pattern), np.iinfo(kind).max, kind), np.zeros(len(pattern), kind)
    score = np.full(len(pattern), size, np.int16)
    best, end = score.copy(), np.zeros(len(pattern), np.int16)
    columns = np.ascontiguousarray(text.T)
    for j in range(text.shape[1]):
        eq = np.packbits(pattern == columns[j][:, None], axis=1, bitorder="little").view(kind)[:, 0]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += (ph & top) > 0
        score -= (mh & top) > 0
        ph, mh = ph << one, mh << one  # a match may begin anywhere in the text
        pv, mv = mh | ~(xv | ph), ph & xv
        less = score < best
        best[less] = score[less]
        end[less] = j + 1
    return best, end


def _candidates(items: Items, cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows (document, item, offset in item, offset in document): all hits of the pairs that may hold the needed pieces within one band.

    Bands are 2 << BAND diagonals wide and overlap by half, so a passage may drift by 1 << BAND letters. Hits are counted
    in stretches of text that overlap by two items, so that every passage lies in one stretch whole and memory is bounded.
    """
    n_items = len(items.ids)
    lap = 2 * items.longest
    span = (COUNTED + lap + items.longest + (4 << BAND)) >> BAND
    place = items.pieces(cps, off)
    pairs = []
    for t, (p, k) in enumerate(place):
        begins = np.arange(0, len(cps), COUNTED)
        for begin, a, z in zip(begins, np.searchsorted(p, begins), np.searchsorted(p, begins + COUNTED + lap)):
            key = items.bands(t, p[a:z] - begin, k[a:z], span)
            if not len(key):
                continue
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[head], np.diff(np.append(head, len(key)))
            both = n.copy()
            both[:-1] += np.where(key[1:] == key[:-1] + 1, n[1:], 0)
            enough = both >= items.need.min()
            good, both = key[enough].astype(np.int64), both[enough]
            good = good[both >= items.need[good // span]]
            if not len(good):
                continue
            item, low = good // span, (good % span << BAND) - items.longest + begin
            d0 = np.searchsorted(off[1:], np.maximum(low, 0), "right")  # the documents that these diagonals pass
            d1 = np.searchsorted(off[1:], np.minimum(low + items.length[item] + (2 << BAND), len(cps) - 1), "right")
            for more in range(int((d1 - d0).max()) + 1):
                pairs.append(((d0 + more) * n_items + item)[d0 + more <= d1])
    if not pairs:
        return np.zeros((4, 0), np.int64)
    pairs = np.unique(np.concatenate(pairs))
    doc, item = np.divmod(pairs, n_items)
    out = []
    for t, (p, k) in enumerate(place):
        own = items.piece[item] == items.tables[t][0]
        first, n = np.searchsorted(p, off[doc[own]]), np.diff(np.searchsorted(p, np.stack([off[doc[own]], off[doc[own] + 1]])), axis=0)[0]
        cuts = np.searchsorted(np.cumsum(n), np.arange(PLACES, int(n.sum()), PLACES))
        for part in np.split(np.arange(len(n)), cuts):
            m = n[part]
            j = np.repeat(first[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
            d, i = np.repeat(doc[own][part], m), np.repeat(item[own][part], m)
            row, at = items.of(t, k[j], i)
            out.append(np.stack([d[row], i[row], at, p[j[row]] - off[d[row]]]))
    return np.concatenate(out, 1)


def _groups(key: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal columns."""
    return np.cumsum(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))[: key.shape[1]]) - 1


def _grow(items: Items, cps: np.ndarray, lo: np.ndarray, hi: np.ndarray, i: np.ndarray, a: np.ndarray, p: np.ndarray, step: int, size: int) -> np.ndarray:
    """Letters that a passage goes on from item offset ``a`` and text position ``p``: the prefix that wins most, one for an equal letter and minus three for another."""
    j = np.arange(size) * step
    x, y = a[:, None] + j, p[:, None] + j
    inside = (x >= 0) & (x < items.length[i][:, None]) & (y >= lo[:, None]) & (y < hi[:, None])
    same = inside & (items.cps[np.clip(items.off[i][:, None] + x, 0, len(items.cps) - 1)] == cps[np.clip(y, 0, len(cps) - 1)])
    won = np.cumsum(np.where(same, 1, -3), axis=1)
    best = won.argmax(1)
    return np.where(won[np.arange(len(a)), best] > 0, best + 1, 0)


def _passages(items: Items, kind: int, cps: np.ndarray, off: np.ndarray, hits: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows (document, item, begin, end) of the passages found in the bands with ``least[item]`` hits, for one kind of item."""
    size, stride = BLOCK[kind], BLOCK[kind] // 2
    slack = size // 4
    found = []
    span = items.longest + 1
    for phase in (0, 1):  # two ladders of bands, shifted by half a band
        d, i, a, p = hits
        band = ((p - a >> BAND) + phase >> 1) + items.longest
        if not len(d):
            continue
        order = np.argsort(((d * len(items.ids) + i) * (int(band.max()) + 1) + band) * span + a)
        d, i, a, p, band = d[order], i[order], a[order], p[order], band[order]
        group = _groups(np.stack([d, i, band]))
        many = np.bincount(group)[group] >= least[i]
        if phase:  # a band whose hits lie in one half is part of a band of the first ladder
            upper = np.bincount(group, (p - a >> BAND) & 1)
            many &= ((upper > 0) & (upper < np.bincount(group)))[group]
        d, i, a, p, group = d[many], i[many], a[many], p[many], group[many]
        if not len(d):
            continue
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
        n, cd, ci = len(head), d[head], i[head]
        blocks = (items.length[ci] - size) // stride + 1
        who = np.repeat(np.arange(n), blocks)
        b = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        k = np.searchsorted(group * span + a, who * span + b * stride)
        after, before = np.minimum(k, len(a) - 1), np.maximum(k - 1, 0)
        far = lambda x: np.where(group[x] == who, np.abs(a[x] - b * stride), span)  # noqa: B023, E731
        near = np.where(far(after) <= far(before), after, before)
        start = off[cd[who]] + b * stride + (p - a)[near] - slack
        lo, hi = off[cd[who]], off[cd[who] + 1]
        touch = (start + size + 2 * slack > lo) & (start < hi) & (far(near) <= REACH * size)
        cost, stop = np.full(len(who), size, np.int16), np.zeros(len(who), np.int64)
        window = np.arange(size + 2 * slack)
        pattern_at = items.off[ci[who]] + b * stride
        for part in np.array_split(np.flatnonzero(touch), max(1, touch.sum() // 20_000)):
            if len(part):
                x = start[part][:, None] + window
                text = np.where((x >= lo[part][:, None]) & (x < hi[part][:, None]), cps[np.clip(x, 0, len(cps) - 1)], np.uint32(0))
                cost[part], end = myers(items.cps[pattern_at[part][:, None] + np.arange(size)], text)
                stop[part] = start[part] + end
        most = int(blocks.max())
        ok, costs = np.zeros((n, most + 2), bool), np.zeros((n, most + 2), np.int64)
        ok[who, b + 1], costs[who, b + 1] = cost <= int(size * BLOCK_EDITS), cost
        gap = ok[:, :-3] & ok[:, 3:] if ok.shape[1] > 3 else np.zeros((n, 0), bool)
        ok[:, 1:-2] |= gap  # a spoilt stretch of half a block between two found ones is part of the passage
        ok[:, 2:-1] |= gap
        edge = np.diff(ok.astype(np.int8), axis=1)
        c0, b0 = np.nonzero(edge == 1)
        c1, b1 = np.nonzero(edge == -1)
        total = np.cumsum(costs, axis=1)
        edits = (total[c0, b1] - total[c0, b0]) / (b1 - b0) * ((b1 - b0 + 1) / 2)  # blocks overlap by half
        begin, end = b0 * stride, (b1 - 1) * stride + size
        fine = edits <= (end - begin) * PASSAGE_EDITS
        c0, b0, b1, begin, end, edits = c0[fine], b0[fine], b1[fine], begin[fine], end[fine], edits[fine]
        if not len(c0):
            continue
        home = np.cumsum(blocks) - blocks
        w, z = home[c0] + b0, home[c0] + b1 - 1
        lo, hi, i = off[cd[c0]], off[cd[c0] + 1], ci[c0]
        right = _grow(items, cps, lo, hi, i, end, stop[z], 1, size)
        x = start[w][:, None] + window[::-1]  # the first block backwards, for where it begins
        text = np.where((x >= lo[:, None]) & (x < hi[:, None]), cps[np.clip(x, 0, len(cps) - 1)], np.uint32(0))
        _, back = myers(items.cps[pattern_at[w][:, None] + np.arange(size)[::-1]], text)
        left = _grow(items, cps, lo, hi, i, begin - 1, start[w] + size + 2 * slack - back - 1, -1, size)
        found.append(np.stack([cd[c0], i, begin - left, end + right, np.rint(edits).astype(np.int64)]))
    return np.concatenate(found, 1) if found else np.zeros((5, 0), np.int64)


def _cover(items: Items, runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, unaltered letters, passages) from the best passage of each pair and the one that adds most to it."""
    order = np.lexsort((runs[2], runs[2] - runs[3], runs[1], runs[0]))
    doc, item, b, e, edits = runs[:, order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))[: len(doc)]
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    hb, he = b[head][group], e[head][group]
    shared = np.maximum(0, np.minimum(e, he) - np.maximum(b, hb))
    adds = np.where(new, 0, e - b - shared)
    adds = np.where(adds >= items.size[item] // 2, adds - edits * adds // np.maximum(1, e - b), 0)
    more = np.maximum.reduceat(adds, head) if len(head) else np.zeros(0, np.int64)
    return doc[head], item[head], (e - b - edits)[head] + more, 1 + (more > 0)


def _search(items: Items, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_items = len(items.ids)
    for batch in it:
        ids = np.asarray(batch.column("doc_id"))
        for first, texts in steps(batch.column("text"), STEP_LETTERS):
            cps, off = letters(texts)
            hits = _candidates(items, cps, off)
            short = items.short[hits[1]]
            out = []
            if short.any():
                d, i = np.divmod(np.unique(hits[0][short] * n_items + hits[1][short]), n_items)
                out.append((d, i, items.length[i], np.ones(len(d), np.int64)))
            for kind in (0, 1):
                own = hits[:, (items.kind[hits[1]] == kind) & ~short]
                if own.shape[1]:
                    d, i, held, _ = _cover(items, _passages(items, kind, cps, off, own, items.need))
                    half = held >= items.length[i] // 4 - items.size[i]  # half of what must stand there, less what the ends may hide
                    strong = d[half] * n_items + i[half]
                    own = own[:, np.isin(own[0] * n_items + own[1], strong)]
                    out.append(_cover(items, _passages(items, kind, cps, off, own, np.full(n_items, 1 + kind))))
            if out:
                doc, item, held, passages = (np.concatenate(x) for x in zip(*out))
                good = held >= LEAST_COVER * items.length[item]
                cover = np.minimum(1.0, held / items.length[item])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[first + doc[good]]), "item_id": pa.array(items.ids[item[good]]), "cover": pa.array(cover[good]), "passages": pa.array(passages[good].astype(np.int32))})


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cover, passages): documents that hold an item, whole or in part and perhaps slightly altered.

    ``cover``: share of the item's letters and digits that stand unaltered in its best one or two passages. A pair is
    searched for wherever one passage holds half of the item with at most one edit in six letters, or two hold a quarter
    each with at most one in twelve; beside such a passage the second may be as short as half a block. Null and blank
    texts hold nothing; an item shorter than a block counts only where it stands whole and unaltered; repeated document
    ids are joined by their best cover.

    The items are a stated query set; a set of ITEM_LETTERS letters at most is sent to the tasks at once. A larger
    benchmark is taken set after set, each with a job of its own whose broadcast is destroyed before the next.
    Documents are read where they lie, without a shuffle, and only what was found is grouped.
    """
    texts = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    sets = max(1, -(-total // ITEM_LETTERS))
    spark = documents.sparkSession
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(sets):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k).orderBy("item_id", "text").collect()  # a bounded block
        if not rows:
            continue
        cps, off = letters(pa.array([r.text for r in rows], pa.string()))
        sent = spark.sparkContext.broadcast((np.array([r.item_id for r in rows]), cps, off))

        def search(it, sent=sent):
            yield from _search(Items(*sent.value), it)

        part = docs.mapInArrow(search, FOUND)
        if sets > 1:
            part = materialize(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], FOUND)
    return out.groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"), F.max("passages").alias("passages"))

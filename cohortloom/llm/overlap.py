"""Same or near-same texts across splits (problem 1).

Evaluation forms are put into shards of bounded size and of neighbouring lengths, each with a compressed full-text
index. Training forms of lengths that allow a partner stream through backward search against one shard after the other.
A training form within ``k`` edits of an evaluation form holds at least one of its ``k + 1`` equal pieces unchanged, so
every piece is searched, each hit is grown to a maximal match, and the matches of a pair are merged to spans and counts.
Pairs whose lengths and offsets allow the edits are measured where they are found, and counted for the evaluation form:
the pairs themselves are never written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codepoints as cp
from cohortloom.functions.readable import readable
from cohortloom.llm.fmindex import FmIndex
from cohortloom.llm.fold import fold_compare
from cohortloom.operators.joins import spread_join
from cohortloom.store import materialize

#: One edit for each so many characters of the longer form.
LENGTH_PER_EDIT = 10
#: Code points of evaluation forms in one shard, and of training forms in one partition.
SHARD_CHARS, BLOCK_CHARS = 2_000_000, 2_000_000
#: Hits that one step of a search holds in memory, and code points of training forms in a step.
STEP_HITS, STEP_CHARS = 1_000_000, 250_000
#: Length classes to a factor of e.
CLASSES = 20

LINKS = "eval_form string, n_links long, edits int, train_form string, matched int, spans int"


def clean_split(c: Column) -> Column:
    """``train``, ``valid`` or ``test`` in lower case without outer spaces; ``validation`` is ``valid``."""
    s = F.lower(F.trim(c))
    return F.when(s == "validation", F.lit("valid")).otherwise(s)


def split_forms(df: DataFrame, text: str, split: str) -> DataFrame:
    """(text, form, train, held): each distinct readable text with its form and the sides it is on.

    Null and unreadable texts are on neither side. Copies meet before the shuffle, so a text that holds a third of
    all rows arrives as one row per task.
    """
    s = clean_split(F.col(split))
    sides = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.max(F.coalesce(s == "train", F.lit(False))).alias("train"), F.max(F.coalesce(s.isin("valid", "test"), F.lit(False))).alias("held"))
    return sides.where(readable(F.col("text"))).withColumn("form", fold_compare(F.col("text"))).where(F.col("form") != "")


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    cps, off, _ = cp.explode(rows.column("form"))
    length = np.diff(off)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "shortest": pa.array([int(length.min())], pa.int32()), "longest": pa.array([int(length.max())], pa.int32()), "data": pa.array([FmIndex.build(cps, off).save()], pa.binary())})


def _pieces(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the equal pieces of each form: one more than the edits any partner allows."""
    edits = length // (LENGTH_PER_EDIT - 1)  # the longest partner is longer by as many as it allows edits
    count = edits + 1
    row = np.repeat(np.arange(len(length)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, j * length[row] // count[row], (j + 1) * length[row] // count[row]


def _grow(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, end: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How far equal symbols go from positions ``i`` and ``j`` in one direction."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = i[live] + step * n[live], j[live] + step * n[live]
        inside = (x != end[live]) & (y != limit[live])
        live, x, y = live[inside], x[inside], y[inside]
        live = live[a[x] == b[y]]
        n[live] += 1
    return n


def distances(a: np.ndarray, a0: np.ndarray, n: np.ndarray, b: np.ndarray, b0: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Edit distance of ``a[a0 : a0 + n]`` and ``b[b0 : b0 + m]`` for each pair; ``k + 1`` where it is above ``k``.

    The band of 2 k + 1 diagonals is worked through row by row for all pairs of one ``k`` at once; pairs that cannot come
    back below ``k`` are dropped on the way.
    """
    out = k + 1
    for e in np.unique(k):
        who = np.flatnonzero((k == e) & (np.abs(n - m) <= e))
        far, width = int(e) + 1, np.arange(2 * int(e) + 1)
        d = np.broadcast_to(np.where(width >= e, width - e, far), (len(who), len(width))).astype(np.int32)
        row = 0
        while len(who):
            ended = np.flatnonzero(n[who] == row)
            out[who[ended]] = np.minimum(far, d[ended, (m - n)[who[ended]] + e])
            live = (n[who] > row) & (d.min(1) <= e)
            if not live.all():
                who, d = who[live], d[live]
            if not len(who):
                break
            row += 1
            j = row + width - e
            y = np.clip(b0[who][:, None] + j - 1, 0, len(b) - 1)
            t = d + (a[a0[who] + row - 1][:, None] != b[y])
            t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
            t = np.where(j < 1, far, t)
            if row <= e:
                t[:, e - row] = row
            d = np.minimum(np.minimum.accumulate(t - width, axis=1) + width, far)
            d[(j < 0) | (j > m[who][:, None])] = far
    return out


class _Links:
    """What one task has found for the evaluation forms of a shard."""

    def __init__(self, index: FmIndex):
        self.index = index
        self.size = np.diff(index.starts) - 1
        self.count = np.zeros(len(self.size), np.int64)
        self.best: dict[int, tuple[int, str, int, int]] = {}

    def search(self, train: pa.Array) -> None:
        index = self.index
        cps, off, _ = cp.explode(train)
        sym = index.symbols(cps)
        length = np.diff(off)
        row, begin, end = _pieces(length)
        lo, hi = index.search(sym, off[row] + begin, off[row] + end)
        hits = np.bincount(row, hi - lo, len(length)).astype(np.int64)
        some = np.flatnonzero(hits)
        cuts = np.searchsorted(np.cumsum(hits[some]), np.arange(STEP_HITS, int(hits.sum()), STEP_HITS))
        for part in np.split(some, np.unique(cuts)):  # whole training forms, so that a pair's matches stay together
            if len(part):
                pieces = np.flatnonzero(np.isin(row, part) & (hi > lo))
                self._measure(train, sym, off, row, begin, pieces, lo, hi)

    def _measure(self, train, sym, off, row, begin, pieces, lo, hi) -> None:
        index, starts, text = self.index, self.index.starts, self.index.text
        length = np.diff(off)
        n = (hi - lo)[pieces]
        hit = np.repeat(pieces, n)
        pos = index.locate(np.repeat(lo[pieces], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        doc = np.searchsorted(starts, pos, "right") - 1
        r, at = row[hit], pos - starts[doc]
        allowed = np.maximum(length[r], self.size[doc]) // LENGTH_PER_EDIT
        fits = (np.abs(length[r] - self.size[doc]) <= allowed) & (np.abs(begin[hit] - at) <= allowed)
        hit, pos, doc, r = hit[fits], pos[fits], doc[fits], r[fits]
        if not len(r):
            return
        i, j = off[r] + begin[hit], pos
        left = _grow(sym, text, i - 1, j - 1, off[r] - 1, starts[doc] - 1, -1)
        right = _grow(sym, text, i, j, off[r + 1], starts[doc + 1] - 1, 1)
        r, doc, a, b, _ = np.unique(np.stack([r, doc, i - left - off[r], i + right - off[r], j - i]), axis=1)  # pieces of one maximal match give it again
        pair = np.append(True, (r[1:] != r[:-1]) | (doc[1:] != doc[:-1]))
        group = np.cumsum(pair) - 1
        base = group * (int(length.max()) + 1)  # merge spans: what each adds beyond those before it
        reach = np.maximum.accumulate(b + base)
        before = np.append(0, reach[:-1])
        matched, spans = np.bincount(group, np.maximum(0, b + base - np.maximum(a + base, before))).astype(np.int64), np.bincount(group)
        r, doc = r[pair], doc[pair]
        n, m = length[r], self.size[doc]
        k = np.maximum(n, m) // LENGTH_PER_EDIT
        edits = np.where((matched == n) & (n == m) & (spans == 1), 0, k + 1)
        rest = np.flatnonzero((edits > 0) & (k > 0))
        for some in np.array_split(rest, max(1, int((2 * k[rest] + 1).sum()) // 4_000_000)):
            edits[some] = distances(sym, off[r[some]], n[some], text, starts[doc[some]], m[some], k[some])
        good = np.flatnonzero(edits <= k)
        if not len(good):
            return
        r, doc, edits, matched, spans = r[good], doc[good], edits[good], matched[good], spans[good]
        self.count += np.bincount(doc, minlength=len(self.count))
        order = np.empty(len(train), np.int64)
        order[np.asarray(pc.sort_indices(train))] = np.arange(len(train))
        first = np.lexsort((order[r], edits, doc))
        first = first[np.append(True, doc[first][1:] != doc[first][:-1])]
        for x, form in zip(first, train.take(pa.array(r[first])).to_pylist()):  # one for each evaluation form
            new = (int(edits[x]), form, int(matched[x]), int(spans[x]))
            old = self.best.get(int(doc[x]))
            if old is None or new < old:
                self.best[int(doc[x])] = new

    def rows(self) -> pa.RecordBatch:
        index = self.index
        docs = np.array(sorted(self.best), np.int64)
        size = self.size[docs]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        symbols = index.text[np.repeat(index.starts[docs], size) + inner].astype(np.int64)
        forms = cp.implode(index.alphabet[symbols - 2].astype(np.uint32), np.append(0, np.cumsum(size))).cast(pa.string())
        best = [self.best[x] for x in docs.tolist()]
        column = lambda i, t: pa.array([x[i] for x in best], t)
        return pa.RecordBatch.from_arrays([forms, pa.array(self.count[docs]), column(0, pa.int32()), column(1, pa.string()), column(2, pa.int32()), column(3, pa.int32())], [f.split()[0] for f in LINKS.split(", ")])


def _shards(held: DataFrame) -> Column:
    """The shard of an evaluation form: length classes one after the other, as many to a shard as it holds; a class that fills more is cut by a hash."""
    sizes = held.groupBy("class").agg(F.sum("length").alias("n")).orderBy("class").collect()  # CLASSES to a factor of e: a few hundred rows
    where, shard, room = {}, -1, 0
    for r in sizes:
        parts = -(-r.n // SHARD_CHARS)
        if parts > 1 or r.n > room:
            first, shard, room = shard + 1, shard + parts, SHARD_CHARS * parts - r.n if parts == 1 else 0
        else:
            first, room = shard, room - r.n
        where[r["class"]] = (first, parts)
    pair = lambda i: F.element_at(F.create_map(*[F.lit(x) for c, v in where.items() for x in (c, v[i])]), F.col("class"))
    return (pair(0) + F.pmod(F.xxhash64("form"), pair(1))).cast("int")


def near_links(forms: DataFrame) -> DataFrame:
    """(eval_form, n_links, edits, train_form, matched, spans), one row per evaluation form that has a near-same training form.

    ``forms``: (form, train, held), one row per distinct form. Two forms are near-same if inserting, deleting or
    replacing at most one character in ten of the longer makes one the other; equal forms have 0 edits. ``n_links``
    counts the training forms that are; ``train_form`` is the nearest, the smallest of equals, with its edits, matched
    length and number of spans. No link is lost, none is written as a pair. Empty inputs give an empty result.

    The shards are a stated query set: each, of bounded size, is sent to the tasks in turn, and training forms are
    searched where they lie, those of the lengths that allow a partner. Nothing but the result is shuffled.
    """
    spark = forms.sparkSession
    sized = forms.withColumn("length", F.length("form")).withColumn("class", F.floor(F.log("length") * CLASSES).cast("int"))
    held = materialize(sized.where("held AND length > 0").select("form", "length", "class"))
    if held.isEmpty():
        return spark.createDataFrame([], LINKS)
    index = materialize(held.withColumn("shard", _shards(held)).groupBy("shard").applyInArrow(_build, "shard int, shortest int, longest int, data binary"))
    train = sized.where("train").select("form", "length")
    out = None
    shards = index.select("shard", "shortest", "longest").orderBy("shard").collect()  # three numbers a shard
    for s in shards:
        sent = spark.sparkContext.broadcast(index.where(F.col("shard") == s.shard).select("data").first()[0])

        def run(it, sent=sent):
            from cohortloom.llm.letters import steps

            found = None
            for batch in it:
                for _, part in steps(batch.column("form"), STEP_CHARS):
                    found = found or _Links(FmIndex.load(sent.value))
                    found.search(part)
            if found is not None and found.best:
                yield found.rows()

        low, high = s.shortest - s.longest // (LENGTH_PER_EDIT - 1) - 1, s.longest + s.longest // (LENGTH_PER_EDIT - 1) + 1
        part = materialize(train.where(F.col("length").between(low, high)).select("form").mapInArrow(run, LINKS))
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("edits", "train_form", "matched", "spans")).alias("b")
    return out.groupBy("eval_form").agg(F.sum("n_links").alias("n_links"), best).select("eval_form", "n_links", "b.*")


def overlaps(df: DataFrame, text: str = "raw_text", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(texts, links): the distinct texts with form and sides, and the links of the evaluation forms to training forms."""
    spark = df.sparkSession
    texts = materialize(split_forms(df, text, split))
    chars = texts.agg(F.sum(F.length("form"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-chars // BLOCK_CHARS))
    forms = texts.groupBy("form").agg(F.max("train").alias("train"), F.max("held").alias("held"))
    return texts, materialize(near_links(materialize(forms.repartition(parts, "form"))))


def _key(c: str) -> Column:
    return F.unhex(F.md5(F.col(c)))


def members(df: DataFrame, key: str, texts: DataFrame, links: DataFrame, text: str = "raw_text", split: str = "split") -> DataFrame:
    """(key, form) of the evaluation records whose form has a link; distinct. Rows of a hot text are spread."""
    leaked = texts.where("held").join(links.select(F.col("eval_form").alias("form")), "form", "left_semi").select(_key("text").alias("_t"), "form")
    held = df.where(clean_split(F.col(split)).isin("valid", "test") & F.col(text).isNotNull()).select(key, _key(text).alias("_t"))
    return spread_join(held, leaked, ["_t"], [key]).select(key, "form").distinct()


def overlapping(df: DataFrame, key: str, text: str = "raw_text", split: str = "split") -> DataFrame:
    """Distinct keys of evaluation records for which some training record has the same or a near-same text."""
    texts, links = overlaps(df, text, split)
    return members(df, key, texts, links, text, split).select(key).distinct()


def report(df: DataFrame, links: DataFrame, texts: DataFrame, by: list[str], text: str = "raw_text", split: str = "split") -> DataFrame:
    """Evaluation rows per clean split and ``by``: how many there are, overlap, and overlap with an equal form."""
    known = texts.where("held").join(links.select(F.col("eval_form").alias("form"), "edits"), "form").select(_key("text").alias("_t"), "edits")
    held = df.withColumn("clean_split", clean_split(F.col(split))).where(F.col("clean_split").isin("valid", "test"))
    rows = held.groupBy("clean_split", *by, _key(text).alias("_t")).agg(F.count(F.lit(1)).alias("n")).join(known, "_t", "left")
    return rows.groupBy("clean_split", *by).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("edits").isNotNull(), F.col("n"))), F.lit(0)).alias("n_overlap"),
        F.coalesce(F.sum(F.when(F.col("edits") == 0, F.col("n"))), F.lit(0)).alias("n_exact"),
    )

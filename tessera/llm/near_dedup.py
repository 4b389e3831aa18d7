"""Near-duplicate groups by ProbMinHash of weighted word shingles, banding and verification.

A shingle is five consecutive words; its weight is how often the document has it. Element d of weight w sends a
Poisson process of rate w, drawn from the hash of d alone, to m registers; a register keeps the element that arrives
first, so two documents agree in a register with the chance of their probability Jaccard similarity
J = sum over common d of 1 / sum over e of max(a(e)/a(d), b(e)/b(d)), which is the Jaccard similarity where no shingle
repeats. A process stops as soon as its next arrival is later than every register of its document (early
termination).

Candidates share a band of registers. Documents with equal shingles and weights are one class from the start. In
every bucket, each class meets the bucket's hub (the member whose hash with the band is least); J is computed from
the texts, and pairs of at least ``least`` are links. Connected classes are one group. In a bucket that then still
holds several groups, the members outside its largest group meet all its members in cells whose number of members and
shingles is bounded (a larger text has a block by itself): an inverted index of the cell's shingles bounds J of every
two members of different groups, J is computed where the bound allows a link, and such links
leave the cell as pairs of groups. So no link between candidates is lost, no pair is tried within a group, members of the largest group
do not meet each other, and no list of pairs is made. No bucket is capped; a larger one has more cells.

Defined results. Words are [^\\x20\\x09-\\x0D]+; a text of one to four words is one shingle; a text without words (null,
empty, blank) is a group by itself. One row per input row; the group's name is its smallest doc_id (nulls last).
Rows that repeat are in one group. ``keep_first`` lets one row of each group through, also where rows of one id
repeat or differ (then the row of the smallest key). Rows are told apart by 128 bits of id and text. An empty table
gives an empty result. Further columns are ignored by the groups and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import rolling as R

SHINGLE, LEAST = 5, 0.8
BANDS, BAND = 20, 5
#: Members of a mixed bucket on either side of a cell, and their shingles, on average.
CELL, CELL_SHINGLES = 512, 1 << 18


def shingles(row: np.ndarray, h: np.ndarray, rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash, weight."""
    n = np.bincount(row, minlength=rows)
    short = (n > 0) & (n < size)
    total = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for j in range(size):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + len(total)]
    same = row[: len(total)] == row[size - 1 : size - 1 + len(total)] if len(total) else np.zeros(0, bool)
    r, g = row[: len(total)][same], R.mix(total[same])
    if short.any():  # all words of a short text are one shingle
        at = np.cumsum(n) - n
        few = np.flatnonzero(short)
        whole = [R.mix(np.array([sum(int(x) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, x in enumerate(h[at[i] : at[i] + n[i]])) + int(n[i]) & (1 << 64) - 1], np.uint64))[0] for i in few]
        r, g = np.r_[r, few], np.r_[g, np.array(whole, np.uint64)]
    key = R.mix(g ^ R.mix(r.astype(np.uint64) + np.uint64(77)))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.r_[first, len(key)])
    return r[order][first], g[order][first], weight


def registers(row: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int, m: int) -> np.ndarray:
    """The element that arrives first in each of m registers of each row."""
    best, who = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    n = np.bincount(row, minlength=rows)
    lone = n[row] == 1
    who.reshape(rows, m)[row[lone]] = h[lone][:, None]
    row, h, w = row[~lone], h[~lone], w[~lone].astype(np.float64)
    x, draw = np.zeros(len(row)), 0
    while len(row):
        draw += 1
        u = R.mix(h + np.uint64(0xA24BAED4963EE407 * draw & (1 << 64) - 1))
        x = x - np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / w
        slot = row * m + (((R.mix(u) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        sooner = np.flatnonzero(x < best[slot])
        np.minimum.at(best, slot[sooner], x[sooner])
        won = sooner[best[slot[sooner]] == x[sooner]]
        who[slot[won]] = h[won]
        open_rows = np.unique(row) if draw > 4 else np.arange(rows)
        last = np.full(rows, -np.inf)
        last[open_rows] = best.reshape(rows, m)[open_rows].max(axis=1)
        go = x < last[row]
        row, h, w, x = row[go], h[go], w[go], x[go]
    return who.reshape(rows, m)


def _sign(bands: int, band: int, size: int):
    m = bands * band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key")
            for first, end, data, offsets in R.blocks(b.column("text")):
                rows = end - first
                row, _, _, h = R.row_words(data, offsets)
                r, g, w = shingles(row, h, rows, size)
                who = registers(r, g, w, rows, m).reshape(rows, bands, band)
                buckets = np.zeros((rows, bands), np.uint64)
                for j in range(band):
                    buckets = R.mix(buckets * np.uint64(0x9E3779B97F4A7C15) + who[:, :, j])
                sums = np.zeros((2, rows), np.uint64)
                for i, k in enumerate((0x8CB92BA72F3D8DD7, 0x9FB21C651E98DF25)):
                    np.add.at(sums[i], r, R.mix(g * np.uint64(k) + w.astype(np.uint64)))
                count = np.bincount(r, minlength=rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * bands, pa.int32()), pa.array(buckets.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.slice(first, end - first), pa.array(count, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["key", "n", "s1", "s2", "buckets"])

    return run


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sets of (hash, weight), both sorted by hash."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    if x.max() == 1 and y.max() == 1:
        return len(common) / (len(x) + len(y) - len(common))
    rest_a, rest_b = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    # sum over common e of max(x(e)/x(d), y(e)/y(d)), by the order of the ratios x/y
    ratio = x[i] / y[j]
    order = np.argsort(ratio)
    p, q, r = x[i][order], y[j][order], ratio[order]
    kinds, start = np.unique(r, return_index=True)
    below_q, above_p = np.r_[0, np.cumsum(q)], p.sum() - np.r_[0, np.cumsum(p)]
    cut = np.r_[start[1:], len(r)][np.searchsorted(kinds, r)]
    return float((1 / ((above_p[cut] + rest_a) / p + (below_q[cut] + rest_b) / q)).sum())


def _weights(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    row, _, _, h = R.row_words(data, np.array([0, len(data)]))
    _, g, w = shingles(row, h, 1, size)
    order = np.argsort(g)
    return g[order], w[order]


def _verify(least: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            keep = []
            for t, u in zip(b.column("text_a").cast(pa.large_binary()), b.column("text_b").cast(pa.large_binary()), strict=True):
                t, u = t.as_py(), u.as_py()
                if u not in known:  # hubs come in a row
                    known = {u: _weights(u, size)}
                keep.append(jaccard(_weights(t, size), known[u]) >= least)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """One row (key, text) for each of the keys. Rows of one key are one document."""
    keys = C.written(keys.distinct(), "near-keys")
    return C.written(C.semi(texts, keys, "key").dropDuplicates(["key"]), "near-texts")


def links(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """Pairs (a, b) of keys whose texts reach the similarity."""
    pairs = C.written(pairs.distinct(), "near-pairs")
    some = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), texts)
    a = pairs.join(some.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
    both = a.join(some.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")
    found = C.written(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least, size), "a binary, b binary"), "near-links")
    C.removed(some)
    return found


class _Parts:
    """Union-find over the groups of one cell, numbered from 0."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while (y := self.up[x]) != x:
            self.up[x] = self.up[y]
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


def _cell(least: float, size: int):
    def run(t: pa.Table) -> pa.Table:
        # a block of members outside the largest group (left) and a block of all members (right); of a bucket that is
        # one cell, every row is right and some are left too
        t = t.sort_by("key")
        left, on_right = t.column("left").to_numpy(), t.column("right").to_numpy()
        groups = t.column("root").combine_chunks().dictionary_encode()
        roots, names = groups.indices.to_numpy(), groups.dictionary.to_pylist()
        sets = [_weights(x.as_py() or b"", size) for x in t.column("text").cast(pa.large_binary())]
        share = [w / max(w.sum(), 1) for _, w in sets]
        right, both, place = np.flatnonzero(on_right), left & on_right, np.arange(len(left))
        out, parts = [], _Parts(int(roots.max()) + 1)
        if len(right):
            owner = np.repeat(right, [len(sets[i][0]) for i in right])
            order = np.argsort(every := np.concatenate([sets[i][0] for i in right]), kind="stable")
            every, owner, part = every[order], owner[order], np.concatenate([share[i] for i in right])[order]
            for x in np.flatnonzero(left):
                lo, hi = np.searchsorted(every, sets[x][0], "left"), np.searchsorted(every, sets[x][0], "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                # J is at most the common elements' share in either document
                mine = np.bincount(owner[at], np.repeat(share[x], n), len(sets))
                theirs = np.bincount(owner[at], part[at], len(sets))
                near = (np.minimum(mine, theirs) >= least - 1e-9) & (roots != roots[x]) & on_right & (~both | (place > x) if both[x] else True)
                for y in np.flatnonzero(near):
                    if parts.top(roots[x]) != parts.top(roots[y]) and jaccard(sets[x], sets[y]) >= least:
                        parts.join(roots[x], roots[y])
                        out.append((names[roots[x]], names[roots[y]]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def mixed_links(members: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """Pairs (a, b) of groups (root) that a link joins within the buckets of members (band, bucket, key, root, n: shingles)."""
    groups = C.written(members.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")), "near-mixed-groups")
    whole = groups.groupBy("band", "bucket").agg(F.max_by(F.struct("root", "c", "n"), F.struct("c", "root")).alias("l"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    blocks = lambda c, n: F.greatest(F.ceil(c / CELL), F.ceil(n / CELL_SHINGLES)).cast("int")
    whole = C.written(whole.select("band", "bucket", F.col("l.root").alias("largest"), blocks(F.col("c") - F.col("l.c"), F.col("n") - F.col("l.n")).alias("down"), blocks(F.col("c"), F.col("n")).alias("across")), "near-mixed")
    some = _texts_of(members.select("key"), texts)
    placed = members.select("band", "bucket", "key", "root").join(whole, ["band", "bucket"])
    number = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = (F.col("down") == 1) & (F.col("across") == 1)
    rows = placed.withColumn("v", number("across")).withColumn("u", F.explode(every("down"))).withColumn("left", one & (F.col("root") != F.col("largest"))).withColumn("right", F.lit(True))
    others = placed.where((F.col("root") != F.col("largest")) & ~one).withColumn("u", number("down")).withColumn("v", F.explode(every("across"))).withColumn("left", F.lit(True)).withColumn("right", F.lit(False))
    columns = ["band", "bucket", "u", "v", "key", "root", "left", "right"]
    placed = C.written(rows.select(*columns).unionByName(others.select(*columns)), "near-placed")
    cells = placed.join(some, "key").groupBy("band", "bucket", "u", "v")
    found = C.written(cells.applyInArrow(_cell(least, size), "a binary, b binary").distinct(), "near-links")
    C.removed(some, placed, whole, groups)
    return found


def ends(chains: DataFrame) -> DataFrame:
    """key, root of keys that each point to a smaller one (key, root): the end of each key's chain, by pointer jumping."""
    while True:
        far = chains.select(F.col("key").alias("root"), F.col("root").alias("jump"))
        step = C.written(chains.join(far, "root", "left").select("key", F.coalesce("jump", "root").alias("root"), F.col("jump").isNotNull().alias("moved")), "chains")
        chains = step.select("key", "root")
        if not step.where("moved").limit(1).count():
            return chains


def components(edges: DataFrame) -> DataFrame:
    """key, root: the smallest key of each connected part, for all its other keys.

    In a round each key takes its smallest neighbour, if that is smaller, and chains of keys are followed to their ends.
    Edges are then drawn between the ends: most fall within one part and are gone, so that later rounds read few."""
    between = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left, steps = C.written(edges.where("a != b").select(*between("a", "b")).distinct(), "edges"), []
    while left.limit(1).count():
        # written, so that a hot end's joins can be split
        step = ends(C.written(left.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("root")), "smallest"))
        steps.append(step)
        low = left.join(step.withColumnsRenamed({"key": "b", "root": "end_b"}), "b")
        both = low.join(step.withColumnsRenamed({"key": "a", "root": "end_a"}), "a", "left").withColumn("end_a", F.coalesce("end_a", "a"))
        left = C.written(both.where("end_a != end_b").select(*between("end_a", "end_b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("b").alias("key"), F.col("a").alias("root"))
    return steps[0] if len(steps) == 1 else ends(reduce(DataFrame.unionByName, steps))


def roots(docs: DataFrame, least: float, size: int, bands: int, band: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, root of each row of docs, written."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text")).withColumn("key", C.row_key("doc_id", "text"))
    texts = rows.select("key", "text")
    C.small_batches(docs.sparkSession)
    signed = C.written(texts.mapInArrow(_sign(bands, band, size), "key binary, n long, s1 long, s2 long, buckets array<long>"), "signed")
    full = signed.where("n > 0")
    # documents with equal weighted shingles are one class; its smallest key stands for it
    same = C.written(full.groupBy("s1", "s2").agg(F.min(F.struct("key", "n", "buckets")).alias("one"), F.count(F.lit(1)).alias("c")), "same")
    members = full.join(same.where("c > 1").select("s1", "s2", F.col("one.key").alias("root")), ["s1", "s2"]).where("key != root").select("key", "root")
    members = C.written(members.distinct(), "near-members")
    placed = same.select(F.col("one.key").alias("key"), F.col("one.n").alias("n"), F.posexplode("one.buckets").alias("band", "bucket"))
    shared = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("key", "band").alias("h"), "key")).alias("hub")).where("c > 1")
    shared = C.written(shared, "near-shared")  # written, as the next ones, so that a hot bucket's join can be split
    inside = C.written(placed.join(shared.select("band", "bucket", F.col("hub.key").alias("hub")), ["band", "bucket"]), "buckets")
    pairs = inside.where("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    found = links(pairs, texts, least, size)
    group = components(found)
    # buckets that still hold several groups
    now = C.written(inside.select("band", "bucket", "key", "n").join(group, "key", "left").withColumn("root", F.coalesce("root", "key")), "near-rooted")
    mixed = C.written(now.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "bucket"), "near-mixed-buckets")
    now = C.written(now.join(mixed, ["band", "bucket"]), "mixed")
    later = mixed_links(now, texts, least, size)
    # a class's other keys point to its smallest, that to its group's, that to the smallest of the groups joined later
    group = ends(reduce(DataFrame.unionByName, [members, group, components(later)]))
    # a row without words is its own group, also where rows repeat
    out = C.written(rows.select("doc_id", "key").join(group, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root")), "roots")
    C.removed(signed, same, inside, now)
    return out


def near_groups(docs: DataFrame, least: float = LEAST, size: int = SHINGLE, bands: int = BANDS, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept for each row of docs."""
    ids = roots(docs, least, size, bands, band, id_col, text_col)
    names = C.written(ids.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-names")
    return ids.join(names, "root").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame, least: float = LEAST, size: int = SHINGLE, bands: int = BANDS, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, all columns unchanged: the one of the smallest id (nulls last), then key."""
    ids = roots(docs, least, size, bands, band, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key"))
    many = C.written(ids.groupBy("root").agg(first.alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", F.col("f.key").alias("first")), "near-first")
    some = C.written(ids.join(many, "root").select("doc_id", "key", (F.col("key") == F.col("first")).alias("stays")), "near-many")
    rows = some.groupBy(F.col("doc_id").alias("_i"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("c"), F.bool_or("stays").alias("_once"))
    gone = rows.where("c > 1 or not _once").select("_i", "_k", "_once")
    return C.without(docs, gone, id_col, C.row_key(F.col(id_col).cast("long"), C.text_or_empty(text_col)))

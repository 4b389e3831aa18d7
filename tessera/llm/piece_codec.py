"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model at hand is a BPE model, whose result is not the path of the best sum of scores. But a BPE segmentation is
the one path through the lattice of pieces on which every two neighbours are stable: encoding the two alone gives the
same two back. So the lattice has weight 0 for a stable pair and minus infinity otherwise, and the path of the
greatest sum is the library's segmentation.

Giant documents are cut into chunks anywhere. The states at a cut are the pieces that end at it or lie across it. Each
chunk yields its transfer matrix from the states at its start to those at its end; matrices are combined
associatively in the max-plus semiring, which fixes the state at every cut; then each chunk is traced back by itself.
Runs of the space mark share one score in the model, so they are left single in the lattice and joined afterwards,
sixteen at a time from the left, as the library does. Characters outside the vocabulary become their bytes.

Other documents are cut before each word's space mark, which no piece crosses, and distinct words are encoded once by
the library. Tests compare both ways with the library on whole texts.

Defined results. Null text counts as empty and has no pieces. One row per input row, repeated rows included; giants are
told apart by 128 bits of id and text. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .units import UnitEncoder, slices, text_blocks

SPACE = "▁"
#: Characters from which a document is giant, and of a chunk.
GIANT, CHUNK = 50_000, 8_192
UNKNOWN = -1
#: Cached units and known pairs of a worker; beyond them a cache starts anew.
MOST_UNITS, MOST_PAIRS = 400_000, 500_000


def cut_units(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units start at a space mark that follows another character, and at each text's start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = points == ord(SPACE)
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    opens = offsets[:-1][np.diff(offsets) > 0]
    start[opens] = True
    begin = np.flatnonzero(start)
    return begin, np.r_[begin[1:], n]


def marked(text: str) -> str:
    """The text as the model sees it: a mark before it and in place of each space."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {sp.id_to_piece(i): i for i in plain}
        self.space = names[SPACE]
        self.runs = {len(p): i for p, i in names.items() if not p.strip(SPACE)}
        self.ids = {p: i for p, i in names.items() if p.strip(SPACE) or p == SPACE}
        if any(SPACE in p[1:] for p in self.ids) or any(c not in names for p in names for c in p):
            raise ValueError("pieces with inner space marks, or of unknown characters, are not handled")
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.heads = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.piece = {i: p for p, i in self.ids.items()}
        self._stable: dict[tuple[int, int], bool] = {}
        self.units = UnitEncoder(cut_units, self._encode_units, MOST_UNITS)

    # --- whole documents -------------------------------------------------------------------------------------

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.lib.encode([u[1:].replace(SPACE, " ") if u[0] == SPACE else u for u in units], num_threads=1)
        # a unit that is one mark stands for an empty rest, which the library leaves out
        found = [self._lone(u) if not f else f for u, f in zip(units, found, strict=True)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.int32, int(count.sum())), count

    def _lone(self, unit: str) -> list[int]:
        return [self.space] if unit == SPACE else []

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in text_blocks(texts):
            ids, bounds = self.units.ids([marked(t) for t in texts[a:b]])
            out += [ids[bounds[i] : bounds[i + 1]] for i in range(b - a)]
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1)

    # --- the lattice -----------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a few characters."""
        parts = list(text)
        while True:
            best = max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stable(self, a: int, b: int) -> bool:
        if a == UNKNOWN or b == UNKNOWN:
            return True
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) > MOST_PAIRS:
                self._stable.clear()
            p, q = self.piece[a], self.piece[b]
            known = self._stable[a, b] = self.merge(p + q) == [p, q]
        return known

    def at(self, text: str, s: int) -> list[tuple[int, int]]:
        """Pieces that start at s: end and id."""
        out = []
        for e in range(s + 1, min(len(text), s + self.longest) + 1):
            p = text[s:e]
            if p not in self.heads:
                break
            if p in self.ids and (e == s + 1 or self.merge_ok(p)):
                out.append((e, self.ids[p]))
        return out or [(s + 1, UNKNOWN)]

    def merge_ok(self, p: str) -> bool:
        """Whether the piece comes out of its own characters."""
        key = (self.ids[p], -2)
        if key not in self._stable:
            self._stable[key] = self.merge(p) == [p]
        return self._stable[key]

    def states(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """Pieces that end at ``at`` or lie across it: start, end, id."""
        return [(s, e, i) for s in range(max(0, at - self.longest), at) for e, i in self.at(text, s) if e >= at]

    def forward(self, text: str, a: int, z: int, starts: dict[tuple[int, int, int], int]) -> dict[tuple[int, int, int], int]:
        """Bits of the start states from which each state at z can be reached; a state is (start, end, id)."""
        ends: dict[int, list[tuple[int, int]]] = {}
        final: dict[tuple[int, int, int], int] = {}
        for (s, e, i), bits in starts.items():
            if e >= z:
                final[s, e, i] = final.get((s, e, i), 0) | bits
            else:
                ends.setdefault(e, []).append((i, bits))
        for s in range(a, z):
            before = ends.pop(s, None)
            if not before:
                continue
            for e, i in self.at(text, s):
                bits = 0
                for j, had in before:
                    if self.stable(j, i):
                        bits |= had
                if bits:
                    if e >= z:
                        final[s, e, i] = final.get((s, e, i), 0) | bits
                    else:
                        ends.setdefault(e, []).append((i, bits))
        return final

    def transfer(self, text: str, a: int, z: int) -> np.ndarray:
        """Max-plus matrix from the states at a to those at z; at the text's start the only state is the start."""
        before = self.states(text, a) if a else [(-1, 0, UNKNOWN)]
        after = self.states(text, z)
        reach = self.forward(text, a, z, {s: 1 << k for k, s in enumerate(before)})
        out = np.full((len(before), len(after)), -np.inf, np.float32)
        for k, s in enumerate(after):
            bits = reach.get(s, 0)
            out[[b for b in range(len(before)) if bits >> b & 1], k] = 0
        return out

    def trace(self, text: str, a: int, z: int, first: int, last: int) -> list[int]:
        """Ids of the pieces that start in [a, z), between the states numbered first and last."""
        s0 = (self.states(text, a) if a else [(-1, 0, UNKNOWN)])[first]
        goal = self.states(text, z)[last]
        if goal[0] < a:
            return []
        # a state here is (id, start, the state before it): paths share their beginnings
        ends: dict[int, list[tuple]] = {s0[1]: [(s0[2], s0[0], None)]}
        end: tuple | None = None
        for s in range(a, z):
            before = ends.pop(s, None)
            for e, i in self.at(text, s) if before else ():
                for old in before:
                    if self.stable(old[0], i):
                        if (s, e, i) == goal:
                            end = (i, s, old)
                        elif e < z:
                            ends.setdefault(e, []).append((i, s, old))
                        break
        path, at = [], goal[1]
        while end[2] is not None:
            path.append((end[0], text[end[1] : at]))
            at, end = end[1], end[2]
        out: list[int] = []
        for i, p in reversed(path):
            out += [i] if i != UNKNOWN else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def join_runs(self, ids: np.ndarray) -> np.ndarray:
        """Runs of single space marks become the model's runs, the longest first from the left."""
        mark = np.r_[0, (ids == self.space).astype(np.int8), 0]
        edge = np.diff(mark)
        out, at, most = [], 0, max(self.runs)
        for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if z - a > 1:
                out += [ids[at:a], [self.runs[most]] * ((z - a) // most), [self.runs[(z - a) % most]] if (z - a) % most else []]
                at = z
        return np.concatenate([*[np.asarray(x, np.int32) for x in out], ids[at:]])


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> PieceCodec:
    """One codec for all tasks of a worker."""
    return PieceCodec(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the associative step of the scan."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves."""
    if len(matrices) == 1:
        return matrices
    half = len(matrices) // 2
    left, right = scan(matrices[:half]), scan(matrices[half:])
    return left + [combine(left[-1], m) for m in right]


# --- DataFrame ---------------------------------------------------------------------------------------------------

CHUNKS = "key binary, k int, text string, a int, z int"
#: Chunks of a task, as each takes about a tenth of a second.
CHUNKS_A_TASK = 32


def _chunks(size: int, around: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = marked(text)
                cuts = [*range(0, max(len(t) - size // 2, 1), size), len(t)]
                lo = [max(0, c - around) for c in cuts[:-1]]
                part = [t[x : z + around] for x, z in zip(lo, cuts[1:], strict=True)]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(part), pa.array([c - x for c, x in zip(cuts[:-1], lo, strict=True)], pa.int32()), pa.array([c - x for c, x in zip(cuts[1:], lo, strict=True)], pa.int32())], ["key", "k", "text", "a", "z"])

    return run


def _transfers(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            found = [codec.transfer(t, a, z) for t, a, z in zip(*(b.column(c).to_pylist() for c in ("text", "a", "z")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], ["key", "k", "rows", "matrix"])

    return run


def _states(t: pa.Table) -> pa.Table:
    """The state at every cut of one document."""
    t = t.sort_by("k")
    matrices = [np.frombuffer(m, np.float32).reshape(r, -1) for m, r in zip(t.column("matrix").to_pylist(), t.column("rows").to_pylist(), strict=True)]
    prefix = scan(matrices)
    last = [int(prefix[-1][0].argmax())]
    for k in range(len(matrices) - 1, 0, -1):  # the best way into the state that follows
        last.append(int((prefix[k - 1][0] + matrices[k][:, last[-1]]).argmax()))
    last.reverse()
    return pa.table({"key": t.column("key"), "k": t.column("k"), "first": pa.array([0, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})


def _traces(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("text", "a", "z", "first", "last")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array([codec.trace(*r) for r in rows], pa.list_(pa.int32()))], ["key", "k", "ids"])

    return run


def _gather(model: str):
    def run(t: pa.Table) -> pa.Table:
        codec = codec_of(model)
        t = t.sort_by("k")
        ids = codec.join_runs(t.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        return pa.table({"key": t.column("key")[:1], "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return run


def _encode(model: str, giant: bool, full: bool):
    names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"] + ["ids", "decoded"] * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for whole in batches:
            for b in slices(whole):
                part = b.column("text").to_pylist()
                ids = [np.array(x, np.int32) for x in b.column("ids").to_pylist()] if giant else codec.encode_batch(part)
                decoded = codec.decode_batch([x.tolist() for x in ids])
                # a space mark inside a text is encoded as a space
                same = [d == t.replace(SPACE, " ") for d, t in zip(decoded, part, strict=True)]
                cols = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()), pa.array(same)]
                if full:
                    cols += [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def giant_ids(rows: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """key, ids of each document in rows (key, text), by the max-plus scan. Chunks are few bytes but much work, so
    their tasks are counted by chunks."""
    around = codec_of(model).longest
    size = rows.agg(F.coalesce(F.sum(F.ceil((F.length("text") + 1) / chunk)), F.lit(0))).first()[0]
    tasks = max(1, -(-int(size) // CHUNKS_A_TASK))
    chunks = C.written(rows.mapInArrow(_chunks(chunk, around), CHUNKS).repartition(tasks, "key", "k"), "piece-chunks")
    matrices = C.written(chunks.mapInArrow(_transfers(model), "key binary, k int, rows int, matrix binary"), "piece-transfers")
    states = matrices.groupBy("key").applyInArrow(_states, "key binary, k int, first int, last int")
    traced = chunks.join(states, ["key", "k"]).repartition(tasks, "key", "k").mapInArrow(_traces(model), "key binary, k int, ids array<int>")
    return traced.groupBy("key").applyInArrow(_gather(model), "key binary, ids array<int>")


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip (decoding gives the text back); with ``full`` also ids and decoded."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"))
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * full
    usual = rows.where(F.length("text") <= giant).mapInArrow(_encode(model, False, full), schema)
    large = C.written(rows.where(F.length("text") > giant).withColumn("key", C.row_key("doc_id", "text")), "giants")
    if not large.limit(1).count():
        return usual
    ids = giant_ids(large.select("key", "text").dropDuplicates(["key"]), model, chunk)
    return usual.unionByName(large.join(ids, "key").select("doc_id", "text", "ids").mapInArrow(_encode(model, True, full), schema))

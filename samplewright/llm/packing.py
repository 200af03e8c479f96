"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens, served in quanta of `quantum`
tokens. A source's k-th quantum is due at (2k + 1) / weight; serving quanta in
order of their due times is the fixed point of a deficit round-robin, in which a
source that got less than its share of a window carries the deficit into the
next one and never lags or leads by more than a quantum. That order has a closed
form (how many quanta of every other source are due earlier), so any task can
place any document without state from other tasks: deficits carry across windows
and partitions at no cost. By default the weights are the sources' own sizes, so
all queues run dry together and every window holds the corpus's proportions. With
`schedules` (the curriculum of the mixing operator) the proportions change over
time: a quantum is due when the integral of its source's schedule has reached it, so
early windows hold more of the sources that fade out. Due times are floating point;
the order they give is total (ties go by source, then by number), and counts are
corrected to it, so places are exact for any number of tokens.

Quanta fill windows exactly. What is left (less than a quantum per source) is
laid end to end; a last part short of a window is split into sequences whose
lengths are powers of two, so nothing is padded.

Token ids are written once to the shared folder and read in place: no text or
token is shuffled, and a source's size does not matter to any task.

Cases: null or empty text gives the end token alone; null sources form one
queue; repeated rows are packed each; an empty table gives no rows; other
columns are ignored. Sources may number some thousands: each task looks through all
of them for each quantum.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .mixing import areas
from .tokens import END_OF_TEXT, default_path, encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_TOKENS = "doc_id long, source string, part int, start long, n long, ids binary"


def _tokenize(docs: DataFrame, text: str, source: str, doc_id: str, path: str) -> DataFrame:
    """Rows with ids; `start` counts the tokens of the same source before it in the same task."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, done = encoder(path), TaskContext.get().partitionId(), {}
        kind = np.uint16 if enc.size <= 2**16 else np.uint32
        for batch in batches:
            sources, rows = batch.column(2).to_pylist(), []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(enc.array(value.as_py()), np.uint32(END_OF_TEXT)).astype(kind)
                start = done.get(sources[i], 0)
                done[sources[i]] = start + len(ids)
                rows.append((start, len(ids), ids.tobytes()))
            if rows:
                start, n, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sources, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "start", "n", "ids"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    return map_arrow(rows, encode, _TOKENS)


class Schedule:
    """A piecewise linear weight over time: share(t) of its integral is done by time t; time(u) is when share u is done. Both rise."""

    def __init__(self, knots: Sequence[tuple[float, float]]):
        self.at, self.weight = (np.array(x, dtype=np.float64) for x in zip(*knots, strict=True))
        self.done = np.array(areas(knots)) / areas(knots)[-1]
        self.slope = np.diff(self.weight) / np.diff(self.at)
        self.total = areas(knots)[-1]

    def time(self, u: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(self.done, u, "right") - 1, 0, len(self.slope) - 1)
        w, slope, z = self.weight[i], self.slope[i], (u - self.done[i]) * self.total
        flat = np.abs(slope) < 1e-12
        root = np.where(flat, z / np.where(w > 0, w, 1), (np.sqrt(np.maximum(0.0, w * w + 2 * slope * z)) - w) / np.where(flat, 1, slope))
        return np.clip(self.at[i] + root, self.at[i], self.at[i + 1])

    def share(self, t: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(self.at, t, "right") - 1, 0, len(self.slope) - 1)
        x = np.clip(t - self.at[i], 0, self.at[i + 1] - self.at[i])
        return self.done[i] + x * (self.weight[i] + self.slope[i] * x / 2) / self.total


class Layout:
    """Places source positions in sequences. Every place is given once."""

    def __init__(self, totals: Sequence[int], quantum: int, window: int, weights: Sequence[int] | None = None, schedules: Sequence[Sequence[tuple[float, float]]] | None = None):
        if window % quantum:
            raise ValueError("the window must be a multiple of the quantum")
        if weights and schedules:
            raise ValueError("give weights or schedules")
        self.quantum, self.window = quantum, window
        self.quanta = [t // quantum for t in totals]
        self.weights = [float(w) for w in (weights or self.quanta)]
        self.schedules = [Schedule(schedules[i % len(schedules)]) for i in range(len(totals))] if schedules else None
        served = quantum * sum(self.quanta)
        self.tail = [served]
        for t in totals:
            self.tail.append(self.tail[-1] + t % quantum)
        self.total = sum(totals)
        self.full = self.total // window
        rest, at = self.total % window, self.full * window
        self.cuts = [at]  # starts of the last, power-of-two sequences, and the end
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                self.cuts.append(at)

    def due(self, s: int, k: np.ndarray) -> np.ndarray:
        """When quanta k of source s are due: never earlier for a larger k."""
        at = (2 * k + 1) / (2 * self.weights[s])
        return self.schedules[s].time(at) if self.schedules else at

    def rank(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Quanta served before quantum k of source s: those due earlier, or as early and of an earlier source."""
        out, times = np.array(k, dtype=np.int64), np.zeros(len(k))
        for own in np.unique(s):
            times[s == own] = self.due(int(own), k[s == own])
        for other, n in enumerate(self.quanta):
            if not n:
                continue
            earlier = lambda j: (self.due(other, j) < times) | ((self.due(other, j) == times) & (other < s))  # noqa: B023, E731
            share = self.schedules[other].share(times) if self.schedules else times
            count = np.clip(np.ceil(share * self.weights[other] - 0.5), 0, n).astype(np.int64)
            while True:  # rounding may have put it off by one or so
                move = ((count < n) & earlier(np.minimum(count, n - 1))).astype(np.int64) - ((count > 0) & ~earlier(np.maximum(count - 1, 0)))
                if not move.any():
                    break
                count += move
            out += np.where(s == other, 0, count)
        return out

    def pieces(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """For spans [a, b) on the lines of sources s: (span, start in it, length, sequence, offset)."""
        Q, quanta = self.quantum, np.array(self.quanta, dtype=np.int64)
        last = np.minimum((b - 1) // Q, quanta[s])
        first = np.minimum(a // Q, quanta[s])
        reps = last - first + 1
        span = np.repeat(np.arange(len(a)), reps)
        k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + first[span]
        src, tail = s[span], k >= quanta[s[span]]
        lo = np.maximum(a[span], k * Q)
        hi = np.minimum(b[span], np.where(tail, np.iinfo(np.int64).max, (k + 1) * Q))
        place = np.array(self.tail[:-1], dtype=np.int64)[src] + (lo - k * Q)
        in_quanta = ~tail
        if in_quanta.any():
            place[in_quanta] = Q * self.rank(src[in_quanta], k[in_quanta]) + (lo - k * Q)[in_quanta]
        n = hi - lo
        # Split at window ends (tails only) and at the last sequences.
        edges = np.array(self.cuts, dtype=np.int64)
        inner = np.concatenate([np.arange((self.tail[0] // self.window) * self.window, self.full * self.window + 1, self.window), edges[1:]])
        lo_e, hi_e = np.searchsorted(inner, place, "right"), np.searchsorted(inner, place + n, "left")
        more = hi_e - lo_e
        at = np.repeat(np.arange(len(place)), more + 1)
        step = np.arange(len(at)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        begin = np.where(step == 0, place[at], inner[np.minimum(lo_e[at] + step - 1, len(inner) - 1)])
        end = np.where(step == more[at], (place + n)[at], inner[np.minimum(lo_e[at] + step, len(inner) - 1)])
        span, start = span[at], (lo - a[span])[at] + begin - place[at]
        late = begin >= edges[0]
        row = np.where(late, np.searchsorted(edges, begin, "right") - 1, 0)
        seq = np.where(late, self.full + row, begin // self.window)
        offset = np.where(late, begin - edges[np.minimum(row, len(edges) - 1)], begin % self.window)
        length = end - begin
        if len(span):  # join pieces that follow each other in one sequence
            new = np.ones(len(span), dtype=bool)
            new[1:] = (span[1:] != span[:-1]) | (seq[1:] != seq[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
            at = np.flatnonzero(new)
            length = np.add.reduceat(length, at)
            span, start, seq, offset = span[at], start[at], seq[at], offset[at]
        return span, start, length, seq, offset


def pack(
    docs: DataFrame,
    window: int = 2048,
    quantum: int = 256,
    weights: dict[str | None, int] | None = None,
    schedules: Sequence[Sequence[tuple[float, float]]] | None = None,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    `weights` (positive integers, by source) set target proportions; a source
    that runs dry leaves its share to the others. `schedules` go to sources in order
    of their names, null last, repeating. The per-source totals collected to the
    driver are one number per source.
    """
    path = path or default_path()
    tokens = cut(_tokenize(docs, text, source, doc_id, path), "tokens")
    sums = cut(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-sums")
    base = sums.select(
        F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    totals = sorted(((r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    names = [x for x, _ in totals]
    layout = Layout([n for _, n in totals], quantum, window, [weights[x] for x in names] if weights else None, schedules)
    number = {x: i for i, x in enumerate(names)}
    rows = tokens.join(base, tokens["source"].eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).select("doc_id", "source", (F.col("base") + F.col("start")).alias("start"), "n", "ids")

    def place(batches):
        import pyarrow as pa

        kind = np.uint16 if encoder(path).size <= 2**16 else np.uint32
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, src, start, n = (part.column(i).to_pylist() for i in range(4))
                a, n = np.array(start, dtype=np.int64), np.array(n, dtype=np.int64)
                span, begin, length, seq, offset = layout.pieces(np.array([number[x] for x in src]), a, a + n)
                ids = [np.frombuffer(x.as_buffer(), dtype=kind).astype("<u4") for x in part.column(4)]
                crc = [zlib.crc32(ids[i][p : p + m]) for i, p, m in zip(span, begin, length, strict=True)]
                out = [[doc[i] for i in span], begin, length, crc, n[span], seq, offset]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out], pa.array([src[i] for i in span], pa.string())], [x.split()[0] for x in PIECE.split(", ")])

    return map_arrow(rows, place, PIECE)

"""Document fingerprints from prefix polynomial hashes.

H[i] = sum over j < i of c[j] * base^j modulo the prime 2^31 - 1, for two bases.
Any two spans are compared through four prefix values, and the longest common
extension of two positions is found by binary search over span equality.

A fingerprint is a short string made of
- the text's length and whole hash: equal texts have equal fingerprints;
- prefix hashes at up to 64 marks, at multiples of a power of two, by which the
  longest common prefix of two fingerprinted texts is found by binary search;
- a sketch: the least hash of the text's 24-character spans (each one subtraction
  of prefix values) in each of 128 classes.
The likeness of two fingerprints is the larger of the common prefix's share of
the longer text and the Dice share of spans that the sketches estimate.

Cases: null text counts as empty; empty texts are alike (1) and unlike any other
(0); texts shorter than a span are one span; texts of any length are hashed in
blocks with a carried prefix; repeated rows give repeated results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003, 1_299_721_127)
SPAN, CLASSES, MARKS, BLOCK = 24, 128, 64, 1 << 18
#: A span's class is the leading bits of its hash.
_SHIFT = np.uint64(64 - CLASSES.bit_length() + 1)
_CELLS, _BELOW, _NONE = np.arange(CLASSES, dtype=np.uint64) << _SHIFT, (np.uint64(1) << _SHIFT) - np.uint64(1), np.uint64(2**64 - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for x below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = np.minimum(x, x - PRIME)  # below the prime the difference wraps around and is the larger one
    return np.minimum(x, x - PRIME)


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, int(PRIME)))
        m = min(done, n - done)
        out[done : done + m] = _mod(out[:m] * step)
        done += m
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)


class Prefixes:
    """Prefix arrays of one text: constant-time span equality, logarithmic common extensions."""

    def __init__(self, text: str):
        self.points = code_points(text)
        self.sums = []
        for base in BASES:
            terms = _mod(self.points * powers(base, max(1, len(self.points)))[: len(self.points)])
            self.sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), _mod(np.cumsum(terms))]))

    def __len__(self) -> int:
        return len(self.points)

    def span(self, which: int, i: int, j: int) -> int:
        return (int(self.sums[which][j]) - int(self.sums[which][i])) % int(PRIME)

    def same(self, i: int, other: Prefixes, k: int, n: int) -> bool:
        """Whether n characters from i here equal n from k there."""
        p = int(PRIME)
        return all(self.span(w, i, i + n) * pow(b, k, p) % p == other.span(w, k, k + n) * pow(b, i, p) % p for w, b in enumerate(BASES))

    def extension(self, i: int, other: Prefixes, k: int) -> int:
        """Length of the longest common extension from i here and k there."""
        lo, hi = 0, min(len(self) - i, len(other) - k)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(i, other, k, mid) else (lo, mid - 1)
        return lo


@lru_cache(maxsize=1)
def _inverse_powers() -> list[np.ndarray]:
    return [powers(pow(b, -1, int(PRIME)), BLOCK + SPAN) for b in BASES]


def _stride(n: int) -> int:
    return 1 << max(0, -(-n // MARKS) - 1).bit_length() if n > MARKS else 1


def fingerprint(text: str | None) -> str:
    """Length, whole hash, prefix marks and sketch, as hex fields."""
    text = text or ""
    n = len(text)
    stride, least, marks = _stride(n), np.full(CLASSES, _NONE, dtype=np.uint64), ""
    carried = [0, 0]
    for at in range(0, n, BLOCK):
        points = code_points(text[at : at + BLOCK + SPAN - 1])
        new = min(BLOCK, n - at)
        local = []
        for base in BASES:
            terms = _mod(points * powers(base, BLOCK + SPAN)[: len(points)])
            local.append(np.concatenate([np.zeros(1, dtype=np.uint64), _mod(np.cumsum(terms))]))
        spans = max(1 if at == 0 else 0, len(points) - SPAN + 1)
        if spans:
            width = min(SPAN, len(points))
            h = np.zeros(spans, dtype=np.uint64)
            for sums, inverse in zip(local, _inverse_powers(), strict=True):
                h = (h << np.uint64(31)) | _mod(_mod(sums[width : width + spans] + PRIME - sums[:spans]) * inverse[:spans])
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(30)
            h.sort()
            at_cell = np.minimum(np.searchsorted(h, _CELLS), len(h) - 1)
            head = h[at_cell]  # the least hash of each class, or one of another class
            np.minimum(least, np.where(head >> _SHIFT == _CELLS >> _SHIFT, head & _BELOW, _NONE), out=least)
        first = -(-(at + 1) // stride) * stride
        where = np.arange(first, at + new + 1, stride) - at
        scale = [pow(b, at, int(PRIME)) for b in BASES]
        high, low = (_mod(np.uint64(carried[w]) + _mod(local[w][where] * np.uint64(scale[w]))) for w in (0, 1))
        marks += (high << np.uint64(31) | low).astype(">u8").tobytes().hex()
        carried = [(carried[w] + int(local[w][new]) * scale[w]) % int(PRIME) for w in (0, 1)]
    whole = f"{n:x}.{carried[0] << 31 | carried[1]:016x}"
    sketch = np.where(least == _NONE, 0, 1 + least % np.uint64(65535)).astype(">u2").tobytes().hex()
    return f"{whole}.{stride:x}.{marks}.{sketch}"


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints."""
    if a == b:
        return 1.0
    (na, _, sa, ma, ka), (nb, _, sb, mb, kb) = a.split("."), b.split(".")
    na, nb, sa, sb = (int(x, 16) for x in (na, nb, sa, sb))
    if not na or not nb:
        return 0.0
    stride = max(sa, sb)
    mark = lambda m, s, i: m[16 * (i * stride // s - 1) : 16 * (i * stride // s)]
    lo, hi = 0, min(na, nb) // stride
    while lo < hi:  # longest common prefix, in marks
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mark(ma, sa, mid) == mark(mb, sb, mid) else (lo, mid - 1)
    prefix = lo * stride / max(na, nb)
    x, y = (np.frombuffer(bytes.fromhex(k), dtype=">u2") for k in (ka, kb))
    used, same = int(((x != 0) | (y != 0)).sum()), int(((x == y) & (x != 0)).sum())
    jaccard = same / used if used else 0.0
    return float(min(1.0, max(prefix, 2 * jaccard / (1 + jaccard))))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


LEAST = -(2**63)
#: Quantiles come to the driver and go to every task: 8 bytes each.
MOST_RANGES = 1 << 20
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bytes: int = 1 << 26) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The next document is that of the next smaller doc_id (after the last, the
    first; rows with one doc_id in text order). Ids are cut into ranges by
    quantiles, one for every `range_bytes` of input or shuffle partition; a range's
    first row is also sent to the range before it, so each row meets its successor
    within one sorted partition. Texts are shuffled once. Rows with one id (or
    none) are in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(spread(spark), min(MOST_RANGES, -(-size // range_bytes)) if size < 2**60 else 0)  # a larger size means that it is not known
    ids = rows.select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"))
    quantiles = ids.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] if parts > 1 else []
    bounds = np.array(sorted(set(quantiles or [])), dtype=np.int64)
    tops = {r["range"]: r["top"] for r in map_arrow(ids, _place_ids(bounds), "range int, top long").groupBy("range").agg(F.max("top").alias("top")).collect()}
    order = sorted(tops)  # range 0 has the largest ids
    before = {tops[r]: p for p, r in zip([*order[-1:], *order[:-1]], order, strict=True)}
    ranged = map_arrow(rows, _place_rows(bounds, before), "doc_id long, text string, range int, guest int")
    ranged = ranged.repartitionByRange(max(1, len(tops)), "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        import hashlib

        import pyarrow as pa

        def result(now, following, known):
            doc, body = now
            changed = edited(body, following)
            mine, theirs = known
            other = fingerprint(changed)
            return doc, len(body), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mine, other, likeness(mine, other), likeness(mine, theirs)

        held, own, spent, at = None, None, False, None
        for batch in batches:
            out = []
            for doc, body, place, guest in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, body, place, guest = doc.as_py(), body.as_py(), place.as_py(), guest.as_py()
                if place != at:
                    held, spent, at = None, False, place
                if spent:
                    continue  # only the first guest follows the last row
                mark = fingerprint(body)
                if held is not None:
                    out.append(result(held, body, (own, mark)))
                held, own, spent = (doc, body), mark, bool(guest)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    return map_arrow(ranged, run, _OUT)


def _range_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of bounds above each id."""
    return (len(bounds) - np.searchsorted(bounds, ids, "right")).astype(np.int32)


def _place_ids(bounds: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            where, back = np.unique(_range_of(ids, bounds), return_inverse=True)
            top = np.full(len(where), LEAST, dtype=np.int64)
            np.maximum.at(top, back, ids)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(top, pa.int64())], ["range", "top"])

    return run


def _place_rows(bounds: np.ndarray, before: dict[int, int]):
    """Adds range and guest; the rows of a range's largest id also go, as guests, to the range before it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).fill_null(LEAST).to_numpy()
            guests = [(i, before[x]) for i, x in enumerate(ids.tolist()) if x in before]
            own = [*batch.columns, pa.array(_range_of(ids, bounds), pa.int32()), pa.array(np.zeros(len(ids), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "text", "range", "guest"])
            if guests:
                at = pa.array([i for i, _ in guests], pa.int64())
                more = [*(c.take(at) for c in batch.columns), pa.array([p for _, p in guests], pa.int32()), pa.array([1] * len(guests), pa.int32())]
                yield pa.RecordBatch.from_arrays(more, ["doc_id", "text", "range", "guest"])

    return run

"""Language identification by string kernels.

A text is the set of its blended spectrum: all runs of 1 to `orders` characters
of its letters (lower-cased, other characters as one blank), hashed into `width`
slots. The kernel of two texts is their common slots over the geometric mean of
their slot counts. Nyström landmarks turn kernel values into features, on which
one ridge regression per language (one versus rest) is fitted. Texts are scored
in batches: one product with the landmarks' slots, one with the weights.

Training uses a bounded sample: of each language about `train_rows` / number of
languages labelled rows (all, if it has fewer), those with the least hashes of id and
text; rows equal in both count once, and no more than 4 * `train_rows` are taken in
all. What reaches the driver is their slot sets (`width` bits each), not their texts,
and one row count per language. Every text is predicted from all its characters.

Cases: null text, or text without a letter, gives `und` with score 0; so do all
texts if there is no labelled row; rows with null labels are not learned from;
texts of any length are read in blocks; repeated rows are predicted alike; an
empty table gives no rows; other columns, with any names, are ignored by `identify`
and kept by `known_language`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

UNKNOWN = "und"
#: Least kernel value with the nearest landmark of a text in a known language. Of 22,000 texts of the test tables the
#: lowest had 0.28 (its score, too low in mixed texts, does not tell); other scripts had up to 0.05, keyboard runs 0.20,
#: Lorem ipsum 0.26 and Polish 0.30, so languages alike in their letters stay.
MIN_NEAREST = 0.22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 for anything else."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def spectrum(text: str | None, orders: int, width: int, block: int = 1 << 20) -> np.ndarray | None:
    """Sorted slots of the text's n-grams; None if it has no letter."""
    if not text:
        return None
    present, shift, any_letter = np.zeros(width, dtype=bool), np.uint64(64 - width.bit_length() + 1), False
    for at in range(0, len(text), block):
        points = np.frombuffer(text[max(0, at - orders + 1) : at + block].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = _letters()[points]
        blank = points == 32
        any_letter |= not blank.all()
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        points = points[keep].astype(np.uint64)
        h = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, orders + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            present[((h * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)] = True
    return np.flatnonzero(present).astype(np.int32) if any_letter else None


class KernelModel:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, orders: int, width: int):
        self.languages, self.landmarks, self.weights, self.orders, self.width = languages, landmarks, weights, orders, width

    @staticmethod
    def kernel(slots: list[np.ndarray], landmarks: np.ndarray, width: int) -> np.ndarray:
        x = np.zeros((len(slots), width), dtype=np.float32)
        for i, s in enumerate(slots):
            x[i, s] = 1
        sizes = np.array([max(1, len(s)) for s in slots], dtype=np.float32)
        return x @ landmarks.T / np.sqrt(sizes)[:, None]

    @classmethod
    def fit(cls, slots: list[np.ndarray], labels: list[str], landmarks: int, ridge: float, orders: int, width: int) -> KernelModel:
        languages = sorted(set(labels))
        # Landmarks: languages in turn, in sample order.
        by = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
        turns = [by[x][k] for k in range(max(map(len, by.values()), default=0)) for x in languages if k < len(by[x])][:landmarks]
        marks = np.zeros((len(turns), width), dtype=np.float32)
        for r, i in enumerate(turns):
            marks[r, slots[i]] = 1 / np.sqrt(max(1, len(slots[i])))
        k = cls.kernel([slots[i] for i in turns], marks, width).astype(np.float64)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.vstack([cls.kernel(slots[a : a + 512], marks, width) for a in range(0, len(slots), 512)]).astype(np.float64) @ root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.array([[1.0 if lab == x else -1.0 for x in languages] for lab in labels])
        # Classes count alike however many rows they have.
        w = np.array([1 / len(by[lab]) for lab in labels]) * len(labels) / len(languages)
        fit = np.linalg.solve((phi * w[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * w[:, None]).T @ y)
        return cls(languages, marks, np.vstack([root @ fit[:-1], fit[-1:]]).astype(np.float32), orders, width)

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and kernel values with the nearest landmark."""
        langs, scores, nearest = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores, nearest
        for at in range(0, len(texts), batch):
            slots = [(i, s) for i, t in enumerate(texts[at : at + batch], at) if (s := spectrum(t, self.orders, self.width)) is not None]
            if not slots:
                continue
            k = self.kernel([s for _, s in slots], self.landmarks, self.width)
            f = k @ self.weights[:-1] + self.weights[-1]
            for (i, _), b, row, near in zip(slots, f.argmax(axis=1), f, k.max(axis=1), strict=True):
                langs[i], scores[i], nearest[i] = self.languages[b], float(min(1.0, max(0.0, (row[b] + 1) / 2))), float(near)
        return langs, scores, nearest


def train(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    train_rows: int = 3000,
    landmarks: int = 240,
    ridge: float = 1.0,
    orders: int = 3,
    width: int = 1 << 14,
) -> KernelModel:
    """Fit on a sample of the rows with a label and a letter in the text."""
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).cast("string").alias("id")).filter("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    sizes = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    quota = -(-train_rows // max(1, len(sizes)))
    # A share of the hashes that holds 1.5 times the quota: few languages fall short of it, and the rest is cut below.
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.5 * quota / n))]) if sizes else None
    if sizes:
        rows = rows.filter(F.shiftrightunsigned("h", 1) < shares[F.col("lang")] * F.lit(float(2**63)))
    rows = rows.groupBy("lang", "h").agg(F.first("text").alias("text")).select("h", "lang", "text").limit(4 * train_rows)

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            found = [spectrum(v.as_py(), orders, width) for v in batch.column(2)]
            keep = [i for i, s in enumerate(found) if s is not None]
            bits = []
            for i in keep:
                flags = np.zeros(width, dtype=np.uint8)
                flags[found[i]] = 1
                bits.append(np.packbits(flags).tobytes())
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(bits, pa.binary())], ["h", "lang", "bits"])

    found: dict[str, list] = {}
    for r in map_arrow(rows, slots, "h long, lang string, bits binary").collect():
        found.setdefault(r["lang"], []).append((r["h"] >> 1 & 2**63 - 1, bytes(r["bits"])))
    sample = sorted((h, x, bits) for x, own in found.items() for h, bits in sorted(own)[:quota])
    if not sample:
        return KernelModel([], np.zeros((0, width)), np.zeros((1, 0)), orders, width)
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8))).astype(np.int32) for _, _, b in sample]
    return KernelModel.fit(sets, [x for _, x, _ in sample], landmarks, ridge, orders, width)


def identify(docs: DataFrame, model: KernelModel, keep: list[str | Column], text: str = "text") -> DataFrame:
    """docs' columns `keep`, then lang_pred, score and nearest (the kernel value with the nearest landmark)."""
    base = docs.select(*keep, F.col(text).alias("the whole text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x width floats: bounded by the parameters
    schema = base.drop("the whole text").schema.add("lang_pred", "string").add("score", "double").add("nearest", "double")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score, nearest = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(nearest, pa.float64())], schema.names)

    return map_arrow(base, run, schema)


def known_language(docs: DataFrame, model: KernelModel | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_nearest: float = MIN_NEAREST) -> DataFrame:
    """docs without the rows whose language cannot be told; same columns.

    These have no letter in the text, or are as unlike any landmark as other
    languages are: a kernel value below min_nearest. A model without
    languages (no labelled row) tells nothing of a text: then a letter is enough.
    """
    model = model or train(docs, text, lang, doc_id)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names)
    at = docs.columns.index(text)
    if model.languages:
        out = identify(plain, model, list(names), f"c{at}").filter((F.col("lang_pred") != UNKNOWN) & (F.col("nearest") >= min_nearest))
    else:
        out = map_arrow(plain, _lettered(at), plain.schema)
    return out.select(*[F.col(k).alias(c) for k, c in names.items()])


def _lettered(at: int):
    """Arrow batches without the rows whose column `at` has no letter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([any(c.isalpha() for c in x or "") for x in batch.column(at).to_pylist()], pa.bool_()))

    return run

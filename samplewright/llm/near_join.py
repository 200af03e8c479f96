"""Near-duplicate join on word n-grams: MinHash LSH forest, then exact Jaccard.

Texts are lower-cased and split at white space; a text is the set of its runs of
`words` words (all its words, if fewer). Texts with equal sets are one class and
go on as one representative. Each representative has a MinHash signature of
`depth` values in each of `trees` prefix tries. A signature is one sortable number,
the leading bits of which are its prefixes, so a trie is the signatures in order and
a node of it (the texts that share a prefix) is a run of them.

All tries are sorted at once, by ranges of (tree, signature, text), which no crowded
prefix can make uneven; texts without company at the shortest prefix leave there.
Then matched prefixes are shortened: every text starts at full depth in every tree
and shortens one prefix by one value at a time, the longest first, until the chance
that it meets a text at the threshold, 1 - product over trees of
(1 - threshold^length), reaches `recall`. Prefixes whose next node is crowded (over
`block` texts) come last, by its size: in a crowded place (a passage that unlike
texts share) the other trees are shortened further instead. A node that any member
has come to is open and links all its members, so a pair is met with the chance that
either of the two has reached.

The links' connected components hold every candidate pair, and each component is
compared exactly: members are dealt to blocks, and every pair of blocks is one unit
of work that computes set intersections as matrix products and returns one row per
member. No pairs are emitted and no group, however large, meets in one task.

A block holds up to `block` texts and about `hashes` hashes, so tasks are bounded
for long texts too. A component of more than one block is compared whole or by its
open nodes, whichever takes fewer comparisons: n * n, or the sum of squares of the
nodes. Unlike texts that only chain (shared passages) thus cost what their
nodes cost, and true groups of near copies are not compared once per tree. By
nodes, a pair counts in the first tree in which it shares one.

Cases: null text counts as empty; empty texts are one class of copies; texts of
fewer words than `words` match only texts with the same words in order; repeated
rows count as copies; an empty table gives no rows; other columns, with any names,
are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, spread
from .components import components

#: Members of a block, and hashes in their sets; a task compares at most two blocks, or two texts that hold more.
BLOCK = 128
HASHES = 1 << 19
#: Texts whose sets are returned to Spark at once.
SLICE = 512
#: Shortest prefix, and the bits of a signature's number for each value after it. Other values that share such a
#: number by chance only add candidates.
SHORT, BITS = 3, 6
#: What a row is compared in: a whole component (tree -1) or an open node of a tree, dealt to `blocks`.
_UNITS = "array<struct<tree: int, grp: bigint, blocks: int>>"
_FEATURES = "doc_id long, text_key long, row long, digest binary, size long, keys array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their word runs. Words are hashed from all their bytes at once, in blocks of words."""

    def __init__(self, words: int, block: int = 1 << 16):
        self.words, self.block = words, block
        rng = np.random.default_rng(7)
        self.bytes = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = rng.integers(0, 2**62, words, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
        self.powers = np.ones(1, dtype=np.uint64)

    def _hashes(self, words: list[str]) -> np.ndarray:
        raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.flatnonzero(raw == 10) + 1
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        if sizes.max() > len(self.powers):
            self.powers = np.cumprod(np.full(2 * int(sizes.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        place = np.arange(len(raw)) - np.repeat(starts, sizes)
        return _mix(np.add.reduceat(self.bytes[raw] * self.powers[place], starts))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.concatenate([self._hashes(words[at : at + self.block]) for at in range(0, len(words), self.block)])
        n = min(self.words, len(h))
        runs = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            runs += h[i : len(h) - n + 1 + i] * self.places[i]
        runs = np.sort(_mix(runs))
        return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]


def shorten(counts: dict[int, list[int]], trees: int, depth: int, threshold: float, recall: float, crowd: int) -> list[int]:
    """Prefix length in each tree for one text.

    counts: tree -> texts in its nodes of length SHORT, SHORT + 1, ... depth, itself
    included; a text is alone in the trees left out. Nodes of up to `crowd` texts are
    alike, so that whom a text meets by chance has no say in how far it looks.
    """
    gain = [-math.log1p(-min(threshold**n, 1 - 1e-12)) for n in range(depth + 1)]
    wanted = -math.log1p(-recall) if recall < 1 else math.inf
    lengths, have = [depth] * trees, gain[depth] * trees
    crowded = lambda t, n: (counts[t][n - SHORT] // (crowd + 1)).bit_length() if t in counts else 0
    steps = [(crowded(t, depth - 1), 1 - depth, t) for t in range(trees) if depth > SHORT]
    heapq.heapify(steps)
    while steps and have < wanted:
        t = heapq.heappop(steps)[2]
        lengths[t] -= 1
        have += gain[lengths[t]] - gain[lengths[t] + 1]
        if lengths[t] > SHORT:
            heapq.heappush(steps, (crowded(t, lengths[t] - 1), 1 - lengths[t], t))
    return lengths


def _signer(trees: int, depth: int, seed: int = 1):
    """Sets of hashes -> one number per tree: the hash of the first SHORT minima, then BITS of each other one's."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, (trees * depth, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, (trees * depth, 1), dtype=np.uint32)
    salt = _mix(np.arange(1, trees + 1, dtype=np.uint64))
    places = rng.integers(0, 2**62, (SHORT, 1), dtype=np.uint64) * np.uint64(4) + np.uint64(1)
    work = np.empty((trees * depth, 512), dtype=np.uint32)

    def keys(h: np.ndarray) -> np.ndarray:
        least = np.full(trees * depth, np.iinfo(np.uint32).max, dtype=np.uint32)
        h = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), work.shape[1]):
            part = work[:, : len(h) - at]
            np.multiply(h[at : at + work.shape[1]], a, out=part)
            part += b
            np.minimum(least, part.min(axis=1), out=least)
        columns = _mix(least.reshape(trees, depth).T.astype(np.uint64) + salt)
        out, rest = _mix((columns[:SHORT] * places).sum(axis=0)), BITS * (depth - SHORT)
        out = out >> np.uint64(rest)
        for column in columns[SHORT:]:
            out = out << np.uint64(BITS) | column >> np.uint64(64 - BITS)
        return out.view(np.int64)

    return keys


def _features(docs: DataFrame, text: str, doc_id: str, words: int, trees: int, depth: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        shingle, keys, row = Shingler(words), _signer(trees, depth), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for value in batch.column(2):
                h = shingle(value.as_py())
                out.append((row, xxhash.xxh3_128_digest(h.tobytes()), len(h), keys(h) if len(h) else []))
                row += 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_key", "row", "digest", "size", "keys"])

    body = F.coalesce(F.col(text), F.lit(""))
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text")), run, _FEATURES)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """rep, text, digest, ... -> rep, ..., hashes: sets of rows whose text has the wanted digest."""
    schema = f"rep long, copies long, nodes array<long>, units {_UNITS}, hashes binary"

    def run(batches):
        import pyarrow as pa
        import xxhash

        shingle = Shingler(words)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            keep, sets = [], []
            for i, (value, want) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                h = shingle(value.as_py()).tobytes()
                if xxhash.xxh3_128_digest(h) == want.as_py():
                    keep.append(i)
                    sets.append(h)
            cols = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(2, 6)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], ["rep", "copies", "nodes", "units", "hashes"])

    return map_arrow(texts.select("text", "digest", "rep", "copies", "nodes", "units"), run, schema)


def overlaps(sets: list[np.ndarray], dense_from: int = 24, width: int = 4096) -> np.ndarray:
    """Matrix of exact intersection sizes of sets of hashes."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float64)
    common = counts[ids] >= dense_from
    column = np.cumsum(counts >= dense_from) - 1
    cols, rows = column[ids[common]], owner[common]
    by = np.argsort(cols, kind="stable")
    cols, rows = cols[by], rows[by]
    for at in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        lo, hi = np.searchsorted(cols, [at, at + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[rows[lo:hi], cols[lo:hi] - at] = 1
        out += part @ part.T
    rare = (counts[ids] >= 2) & ~common
    by = np.argsort(ids[rare], kind="stable")
    key, who = ids[rare][by], owner[rare][by]
    for gap in range(1, dense_from):
        same = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(same):
            break
        flat = np.bincount(who[same] * n + who[same + gap], minlength=n * n).reshape(n, n)
        out += flat + flat.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard >= threshold; the diagonal is false."""
    both, sizes = overlaps(sets), np.array([len(x) for x in sets])
    out = both * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _compare(threshold: float):
    def run(key, table):
        import pyarrow as pa

        tree, _, i, j = (x.as_py() for x in key)
        rep, first = np.unique(table.column("rep").to_numpy(), return_index=True)
        copies, block = table.column("copies").to_numpy()[first], table.column("block").to_numpy()[first]
        hashes = table.column("hashes")
        link = similar([np.frombuffer(hashes[int(p)].as_buffer(), dtype=np.uint64) for p in first], threshold)
        if i != j:
            link &= block[:, None] != block[None, :]
        if tree > 0:  # pairs that share a node of an earlier tree are counted there
            nodes = np.stack(table.column("nodes").to_numpy()[first])
            for t in range(tree):
                link &= (nodes[:, None, t] != nodes[None, :, t]) | (nodes[:, None, t] == 0)
        root = np.arange(len(rep))
        while True:  # least linked row, until it settles
            best = np.minimum(root, np.where(link, root[None, :], len(rep)).min(axis=1))
            best = best[best]
            if (best == root).all():
                break
            root = best
        return pa.table({"rep": rep, "links": (link @ copies).astype(np.int64), "root": rep[root], "whole": np.repeat(tree < 0 and table.column("blocks")[0].as_py() == 1, len(rep))})

    return run


def _blocks(block: int, hashes: int) -> Column:
    """Number of blocks for n texts whose sets hold `weight` hashes: never more than texts."""
    return F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("weight") / hashes))).cast("int").alias("blocks")


def _matched(reps: DataFrame, depth: int) -> DataFrame:
    """(rep, tree, key) in the order of the tries, without the rows that share no prefix with another row.

    Partitions are ranges of (tree, key, rep). The first and last node of each may
    go on in the next one, so their rows stay whether or not they have company here.
    """
    shift = np.uint64(BITS * (depth - SHORT))
    rows = reps.select("rep", F.posexplode("keys").alias("tree", "key"))
    by = ("tree", F.shiftrightunsigned("key", 1), "key", "rep")  # numbers as unsigned ones
    rows = rows.repartitionByRange(spread(reps.sparkSession), *by).sortWithinPartitions(*by)

    def run(batches):
        import pyarrow as pa

        held = None  # rows of the last node so far: it may go on in the next batch
        first = True
        for batch in batches:
            part = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            tree, key = part.column("tree").to_numpy(), part.column("key").to_numpy().view(np.uint64) >> shift
            starts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])])) if len(tree) else np.zeros(0, int)
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(tree)))
            keep = sizes > 1
            keep[0] |= first
            keep[-1] = False
            if len(starts) > 1:
                first = False
                yield from part.filter(pa.array(np.repeat(keep, sizes))).to_batches()
            held = part.slice(int(starts[-1])).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return cut(map_arrow(rows, run, rows.schema), "matched")


def _open_nodes(matched: DataFrame, trees: int, depth: int, threshold: float, recall: float, crowd: int) -> DataFrame:
    """(rep, tree, node, head): each text's shortest open node of each tree, if it shares it with another text, and the node's least text."""
    levels = F.explode(F.sequence(F.lit(SHORT), F.lit(depth))).alias("len")
    rows = matched.select("rep", "tree", "key", levels)
    prefix = F.expr(f"shiftrightunsigned(key, {BITS} * ({depth} - len))")
    rows = rows.select("rep", "tree", "len", F.xxhash64("tree", "len", prefix).alias("node"))
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).filter("n > 1")
    rows = cut(rows.join(cut(shared, "shared"), "node"), "nodes")
    texts = rows.groupBy("rep").agg(F.collect_list(F.struct("tree", "len", "node", "n")).alias("at"))  # at most trees * lengths entries

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for at in batch.column(0).to_pylist():
                counts, names = {}, {}
                for x in at:
                    counts.setdefault(x["tree"], [1] * (depth - SHORT + 1))[x["len"] - SHORT] = x["n"]
                    names[x["tree"], x["len"]] = x["node"]
                found = shorten(counts, trees, depth, threshold, recall, crowd)
                out += {names[at] for at in enumerate(found) if at in names}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])

    opened = cut(map_arrow(texts.select("at"), run, "node long").distinct(), "opened")
    rows = rows.join(opened, "node", "left_semi").groupBy("rep", "tree").agg(F.min(F.struct("len", "node", "head")).alias("top"))
    return cut(rows.select("rep", "tree", "top.node", "top.head"), "open-nodes")


def _by_nodes(members: DataFrame, nodes: DataFrame, trees: int, block: int, hashes: int) -> DataFrame:
    """(rep, units, nodes): the open nodes of members of those components of several blocks that they make cheaper to compare."""
    large = members.filter("blocks > 1").select("rep", "comp", "size", "n")
    shared = nodes.join(large, "rep")
    groups = cut(shared.groupBy("comp", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.first("n").alias("whole")).filter("n > 1"), "groups")
    square = F.col("n").cast("double") * F.col("n")
    cheaper = groups.groupBy("comp").agg(F.sum(square).alias("cost"), F.first("whole").cast("double").alias("whole")).filter("cost < whole * whole").select("comp")
    units = shared.select("rep", "tree", "node").join(cut(groups.join(cheaper, "comp").select("node", _blocks(block, hashes)), "node-blocks"), "node")
    units = units.groupBy("rep").agg(F.collect_list(F.struct("tree", F.col("node").alias("grp"), "blocks")).alias("units"))
    by_tree = F.map_from_entries(F.transform("units", lambda x: F.struct(x["tree"], x["grp"])))
    return units.withColumn("nodes", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(by_tree[t], F.lit(0))))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    trees: int = 20,
    depth: int = 6,
    recall: float = 0.9999,
    text: str = "text",
    doc_id: str = "doc_id",
    block: int = BLOCK,
    hashes: int = HASHES,
) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, copies_id, copies, links, kept.

    class_id: least doc_id of the connected component of similar documents.
    copies_id: least doc_id among texts with the same n-grams; copies: their number.
    links: other documents at or above the threshold, copies included.
    kept: true for one row per component, one with doc_id = class_id.
    Joins to a class or component are shuffle joins by its number, whose
    partitions adaptive execution splits where one class is large.
    """
    rows = cut(_features(docs, text, doc_id, words, trees, depth), "features")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "row", "doc_id", "text_key", "size", "keys")
    reps = rows.groupBy("digest").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("copies"))
    reps = cut(reps.select("digest", "copies", F.col("top.row").alias("rep"), F.col("top.doc_id").alias("first_id"), "top.text_key", "top.size", "top.keys"), "reps")

    nodes = _open_nodes(_matched(reps, depth), trees, depth, threshold, recall, block)
    clusters = components(nodes.select("rep", "head"))
    members = reps.join(clusters, F.col("rep") == F.col("node")).select("rep", "first_id", "text_key", "digest", "copies", "size", F.col("component").alias("comp"))
    members = cut(members, "members")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    members = cut(members.join(cut(sizes.select("comp", "n", _blocks(block, hashes)), "sizes"), "comp"), "placed")
    whole = F.array(F.struct(F.lit(-1).alias("tree"), F.col("comp").alias("grp"), "blocks"))
    members = cut(members.join(_by_nodes(members, nodes, trees, block, hashes), "rep", "left").withColumn("units", F.coalesce("units", whole)), "units")
    texts = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.col(text).alias("text")).withColumn("own_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Sorted and merged at every size: a table of members that may be broadcast in one run would make costs differ.
    texts = texts.join(members.hint("merge"), F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_key") == F.col("text_key")))
    units = _sets(texts, words).select("rep", "copies", "hashes", "nodes", F.explode("units").alias("unit")).select("rep", "copies", "hashes", "nodes", "unit.*")
    units = units.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    found = cut(units.groupBy("tree", "grp", "i", "j").applyInArrow(_compare(threshold), "rep long, links long, root long, whole boolean"), "found")

    merged = components(found.filter("not whole and rep <> root").select("rep", "root"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    reps = reps.select("digest", "copies", "rep", "first_id").join(counts, "rep", "left").join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    reps = cut(reps.select("digest", "copies", "rep", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "root", "rep").alias("root")), "reps-done")
    top = F.min(F.struct(F.coalesce("first_id", F.lit(2**63 - 1)).alias("o"), "rep", "first_id"))
    classes = reps.groupBy("root").agg(top.alias("top")).select("root", F.col("top.rep").alias("class_rep"), F.col("top.first_id").alias("class_id"))
    reps = cut(reps.join(cut(classes, "classes"), "root"), "reps-classed")
    out = rows.select("doc_id", "text_key", "row", "digest").join(reps, "digest")
    return out.select(
        "doc_id",
        "text_key",
        "class_id",
        F.col("first_id").alias("copies_id"),
        "copies",
        (F.col("links") + F.col("copies") - 1).alias("links"),
        (F.col("row") == F.col("class_rep")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw) -> DataFrame:
    """docs with one document of each class of near duplicates; same columns."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    at = {c: k for k, c in names.items()}
    kept = near_duplicates(docs, text=text, doc_id=doc_id, **kw).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    tagged = docs.toDF(*names).withColumn("own_key", F.xxhash64(F.coalesce(at[text], F.lit(""))))
    same = F.col(at[doc_id]).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    out = tagged.join(cut(kept, "kept").hint("merge"), same, "left_semi")
    if not docs.groupBy(doc_id).count().filter("count > 1").isEmpty():  # only then can one key stand for several rows
        out = out.dropDuplicates([at[doc_id], "own_key"])
    return out.select(*[F.col(k).alias(c) for k, c in names.items()])

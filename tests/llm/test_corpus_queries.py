"""Registered corpus queries against SQL where it can express them, and against brute force where not."""

import hashlib
import zlib

import numpy as np
import pytest
from oracle import compare, connect

from samplewright.llm import oracles, packing, queries


@pytest.fixture(scope="module")
def docs(sf_dir):
    return connect(sf_dir).sql("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").df().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), oracles.ORACLES[name]) == ""


def test_exact_dedup_goes_through_the_index(spark, sf_dir, monkeypatch):
    """The second half of the documents is anti-joined with the first one's entries."""
    from samplewright.llm import exact_dedup

    plans, unseen = [], exact_dedup.DigestIndex.unseen

    def noted(self, digests):
        out = unseen(self, digests)
        plans.append((out._jdf.queryExecution().executedPlan().toString(), digests.count(), out.count()))
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", noted)
    queries.op10_exact_dedup(spark, sf_dir)
    assert len(plans) == 2 and "LeftAnti" in plans[1][0] and "SortMergeJoin" in plans[1][0]
    assert 0 < plans[1][2] < plans[1][1]  # some of its texts were known


def test_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and len([q for q in queries.QUERIES if q.startswith("op")]) == 10


def test_fingerprints(spark, sf_dir, docs):
    got = queries.op1_fingerprints(spark, sf_dir).toPandas().set_index("doc_id")
    order = sorted(docs.index, reverse=True)
    assert sorted(got.index) == sorted(docs.index)
    for k, i in enumerate(order):
        text, following = docs.text[i], docs.text[order[(k + 1) % len(order)]]
        c = len(text) // 3
        changed = text[: len(text) - c] + following[:c]
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(changed.encode()).hexdigest()
    by_text = docs.assign(f=got.fingerprint).groupby("text").f.nunique()
    assert by_text.max() == 1 and got.fingerprint.nunique() == docs.text.nunique()
    assert got.near_edited.min() > 0.5 and got.near_next[docs.text.nunique() and got.near_next < 1].median() < 0.1


def jaccard_classes(docs):
    sets = {}
    for i, t in docs.text.items():
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    ids = list(sets)
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x == y or (both and both >= 0.8 * (len(x) + len(y) - both)):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, links


def test_near_join(spark, sf_dir, docs):
    got = queries.op4_near_join(spark, sf_dir).toPandas().set_index("doc_id")
    classes, links = jaccard_classes(docs)
    assert got.class_id.to_dict() == classes and got.links.to_dict() == links
    assert got.kept.sum() == len(set(classes.values()))


def test_language(spark, sf_dir, docs):
    got = queries.op7_language(spark, sf_dir).toPandas().set_index("doc_id")
    assert got.held_out.to_dict() == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.index}
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97 and got.score.between(0, 1).all()


def check_packing(pieces, ids):
    cover = {i: np.zeros(len(v), int) for i, v in ids.items()}
    for r in pieces.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        cover[r.doc_id][r.start : r.start + r.length] += 1
    assert all((c == 1).all() for c in cover.values())
    rows = pieces.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    sizes = rows.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes)  # nothing is padded


def reference_ids(docs):
    from tokenizers import Tokenizer

    from samplewright.llm.tokens import default_path

    t = Tokenizer.from_file(default_path())
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, x in docs.text.items()}


def test_packing(spark, sf_dir, docs):
    pieces = queries.op8_packing(spark, sf_dir).toPandas()
    check_packing(pieces, reference_ids(docs))
    # Every full window holds the corpus's proportions, to a quantum and the last tails.
    share = pieces.groupby("source").length.sum() / pieces.length.sum()
    early = pieces[pieces.sequence_id < pieces.sequence_id.max() // 2]
    assert (early.groupby("source").length.sum() / early.length.sum() - share).abs().max() < 0.01


@pytest.mark.parametrize("weights", [None, [3, 1, 2]])
def test_round_robin_is_fair_at_every_quantum(weights):
    totals = [900, 500, 130]
    layout = packing.Layout(totals, 8, 64, weights)
    w = layout.weights
    served = sorted((int(layout.rank(np.array([s]), np.array([k]))[0]), s) for s in range(3) for k in range(layout.quanta[s]))
    assert [r for r, _ in served] == list(range(sum(layout.quanta)))
    got = [0, 0, 0]
    for n, (_, s) in enumerate(served, 1):
        got[s] += 1
        if all(g < q for g, q in zip(got, layout.quanta, strict=True)):
            assert all(abs(g - n * x / sum(w)) <= 1.5 for g, x in zip(got, w, strict=True))


def test_scheduled_quanta_come_when_the_curriculum_has_them():
    from samplewright.llm.mixing import FADE_IN, FADE_OUT

    totals = [90_000, 50_000, 13_000]
    layout = packing.Layout(totals, 8, 64, schedules=(FADE_OUT, FADE_IN, ((0.0, 0.0), (1.0, 2.0))))
    s = np.repeat(np.arange(3), layout.quanta)
    k = np.concatenate([np.arange(n) for n in layout.quanta])
    rank = layout.rank(s, k)
    assert sorted(rank) == list(range(len(s)))
    at = np.concatenate([layout.due(i, np.arange(n)) for i, n in enumerate(layout.quanta)])
    assert (np.diff(at[np.argsort(rank)]) >= 0).all()
    early = np.bincount(s[rank < len(s) // 10], minlength=3) / np.array(layout.quanta)
    late = np.bincount(s[rank >= len(s) * 9 // 10], minlength=3) / np.array(layout.quanta)
    assert early[0] > 1.2 * late[0] and late[1] > 1.5 * early[1] and late[2] > 4 * early[2]


def test_places_are_exact_for_trillions_of_tokens():
    """25 T tokens: ranks of neighbouring quanta are those of exact fractions."""
    from fractions import Fraction

    totals = [11_000_000_000_007, 9_000_000_000_011, 5_000_000_000_003]
    layout = packing.Layout(totals, 256, 2048)
    rng = np.random.default_rng(0)
    s, k = np.repeat(np.arange(3), 40), np.concatenate([rng.integers(0, n, 40) for n in layout.quanta])
    got = layout.rank(s, k)
    n = layout.quanta
    for i, (a, j) in enumerate(zip(s, k, strict=True)):
        due = Fraction(2 * int(j) + 1, 2 * n[a])
        want = int(j) + sum(min(n[o], max(0, -((1 - 2 * due * n[o]) // 2))) for o in range(3) if o != a)
        assert abs(got[i] - want) <= 2  # ties in floating point are ordered by source
    order = np.lexsort((s, [float(layout.due(int(a), np.array([j]))[0]) for a, j in zip(s, k, strict=True)]))
    assert (np.diff(got[order]) > 0).all()


def test_token_counts(spark, sf_dir, docs):
    from samplewright.llm import token_counts

    lengths = np.array([len(v) - 1 for v in reference_ids(docs).values()])
    sums = queries.op9_token_counts(spark, sf_dir)
    got = sums.toPandas().set_index("length")
    assert got.docs.sum() == len(lengths) and set(got.index) == set(lengths)
    for limit in list(got.index[::25]):
        assert got.truncated_total[limit] == np.minimum(lengths, limit).sum() and got.docs_over[limit] == (lengths > limit).sum()
        assert abs(got["quantile"][limit] - (lengths <= limit).mean()) < 1e-12
    r = token_counts.at_limit(sums, 777).first()
    assert (r["docs_over"], r["truncated_total"]) == ((lengths > 777).sum(), np.minimum(lengths, 777).sum())


def test_pipeline(spark, sf_dir, docs, tmp_path):
    import corpus_pipeline as cp

    seen, now = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, now, sf_dir)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.toPandas()
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["language"].doc_id) == {i for i, t in docs.text.items() if t and any(c.isalpha() for c in t)}
    want = {}
    for i in sorted(seen["language"].doc_id):
        want[docs.text[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = i
    assert sorted(seen["exact_dedup"].doc_id) == sorted(want.values())
    classes, _ = jaccard_classes(docs.loc[sorted(want.values())])
    assert sorted(seen["near_dedup"].doc_id) == sorted(set(classes.values()))
    mixed = seen["mixing"]
    assert set(mixed.doc_id) <= set(classes.values()) and mixed.doc_id.value_counts().max() <= 3
    rows = seen["packing"]
    totals = rows.groupby("source").length.sum()
    early, late = (x.groupby("source").length.sum() / totals for x in (rows[rows.sequence_id < rows.sequence_id.max() // 4], rows[rows.sequence_id > rows.sequence_id.max() * 3 // 4]))
    names = sorted(totals.index)  # the first of three sources fades out, the others in: windows keep the curriculum
    assert all((early[x] > late[x]) == (i % 3 == 0) for i, x in enumerate(names))
    count = mixed.doc_id.value_counts()
    ids = reference_ids(docs.loc[sorted(count.index)])
    assert rows.length.sum() == sum(len(ids[i]) * n for i, n in count.items())

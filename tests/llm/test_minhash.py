"""MinHash near-dedup against all pairs."""

import random
import re

import numpy as np
import pandas as pd

from tidemark.llm import graph, minhash


def brute_set(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, percent=85, width=3):
    """doc_id -> (size, component); rows without doc_id left out."""
    sets = [(i, brute_set(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {(i, len(s)): root(i) for i, s in sets}


def fixture():
    rng = random.Random(11)
    words = [f"w{k}é" for k in range(400)]
    base = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 9, 30, 80, 300, 300)]
    rows = []
    for text in base:
        for _ in range(9):
            made = list(text)
            for _ in range(rng.randrange(0, max(1, len(text) // 25))):
                made[rng.randrange(len(made))] = rng.choice(words)
            rows.append(" ".join(made))
    for n in range(60):  # near copies of one text that differ from each other about the threshold
        made = list(base[7])
        for _ in range(rng.randrange(2, 8)):
            made[rng.randrange(len(made))] = f"own{n}"
        rows.append("\t".join(made).upper())
    rows += [None, "", " \n", "same", "SAME ", "x " * 30_000]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_components_are_those_of_all_pairs(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0], (None, "x y z")]], "doc_id bigint, text string, component_id int")
    got = minhash.near_duplicates(docs, 85, 3).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_five_words_and_four_fifths(spark):
    rows = fixture()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == brute(rows, 80, 5)


def test_bands_for_the_threshold():
    for percent in (50, 80, 85, 95, 100):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent) <= 1e-6


def crowd(seed=9):
    """Versions of one text that are no links, and two, not the most typical, that link with each other alone."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for n in range(400):
        made = list(base)
        few = n in (150, 250)
        for k in rng.sample(range(2, 58, 4), 5) if few else rng.sample(range(64, 396, 4), 8):
            made[k] = f"own{n}x{k}"
        rows.append((n, " ".join(made)))
    return rows


def test_links_within_a_crowded_bucket_are_found(spark):
    rows = crowd()
    want = brute(rows)
    assert len(set(want.values())) < len(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85, 3).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == want


def test_a_document_is_placed_once_a_round_and_only_likely_pairs_shuffle_sets(spark, monkeypatch):
    counts = {}
    real = minhash.materialize

    def counted(session, df, tag):
        out = real(session, df, tag)
        counts.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    rows = crowd()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85, 3).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == brute(rows)
    assert max(counts["placed"]) <= len(rows)
    assert counts["pairs"][1] < counts["pairs"][0] / 2  # of the star's pairs, those that bitmaps pass


def versions(count, own, seed=3):
    """Copies of one text with up to 14 words changed: into words of their own, or into one other word at each place."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for n in range(count):
        made = list(base)
        for k in rng.sample(range(1, 150, 4), rng.randrange(15)):
            made[k] = f"own{n}x{k}" if own else f"other{k}"
        rows.append((n, " ".join(made)))
    return rows


def compared(spark, monkeypatch, rows):
    """What near_duplicates returns, the rows that went into comparisons by bitmaps, and how many rows each tag had."""
    sizes, counts = [], {}
    across, write = minhash._across, minhash.materialize

    def counted(*args):
        out = across(*args)
        plan = out._jdf.queryExecution().analyzed().children().head()
        sizes.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(out._jdf.sparkSession(), plan).count())
        return out

    def written(session, df, tag):
        out = write(session, df, tag)
        counts[tag] = counts.get(tag, 0) + out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(minhash, "_across", counted)
        m.setattr(minhash, "materialize", written)
        m.setattr(minhash, "MEMBERS", 32)
        m.setattr(minhash, "CROWD", 16, raising=False)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85, 3).collect()
    return {(r.doc_id, r.n_shingles): r.component_id for r in got}, sum(sizes), counts


def test_compared_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    small, large = versions(150, own=True), versions(450, own=True)
    got, few, _ = compared(spark, monkeypatch, small)
    assert got == brute(small) and len(set(got.values())) > 50
    got, many, counts = compared(spark, monkeypatch, large)
    assert got == brute(large) and counts["unsettled"] > 3000
    assert many <= 4 * max(few, 450)


def test_members_without_rare_shingles_are_compared_with_all(spark, monkeypatch):
    rows = versions(200, own=False)
    got, _, counts = compared(spark, monkeypatch, rows)
    assert got == brute(rows) and len(set(got.values())) > 20
    assert counts["left"] > 0 and counts["likely"] > 0


def test_sets_that_are_linked_share_one_of_the_rarest():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(-(2**63), 2**63, 400))
    common, counts = base[::2], rng.integers(2, 90, len(base[::2]))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(330, 400)], rng.integers(-(2**63), 2**63, rng.integers(0, 30))])) for _ in range(80)]
    found = [minhash.rarest(h, common, counts, 85) for h in sets]
    links = 0
    for b in range(80):
        for a in range(b):
            s = len(np.intersect1d(sets[a], sets[b]))
            if 100 * s >= 85 * (len(sets[a]) + len(sets[b]) - s):
                links += 1
                assert len(np.intersect1d(found[a], found[b]))
    assert links > 20 and max(map(len, found)) < 80
    assert minhash.rarest(base, common[:0], counts[:0], 100).tolist() == base[:1].tolist()


def test_star_pairs_passed_by_bitmaps_miss_no_link(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(360, 600)], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(60)]
    top = 2**63 - 60
    rows = [(top + k, len(h), h.view(np.int64).tolist(), minhash.bitmap(h).view(np.int64).tolist()) for k, h in enumerate(sets)]
    table = spark.createDataFrame(rows, "doc_id bigint, n_set bigint, hashes array<bigint>, bits array<bigint>")
    pairs = [(top + a, top + b, top + (a if (a + b) % 2 else b)) for b in range(60) for a in range(b)]
    near = minhash.passed(spark.createDataFrame(pairs, "a bigint, b bigint, centre bigint"), table, 85)
    centre = {(a, b): c for a, b, c in pairs}
    assert len(set(map(len, (r[3] for r in rows)))) > 1
    assert all(r.b == centre[min(r.a, r.b), max(r.a, r.b)] for r in near.collect())
    links = {(min(r.u, r.v) - top, max(r.u, r.v) - top) for r in minhash.confirm(near, table, 85).collect()}
    common = lambda a, b: len(np.intersect1d(a, b))
    want = {(a, b) for b in range(60) for a in range(b) if 100 * (s := common(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - s)}
    assert links == want and 0 < len(want) < near.count() < len(pairs)


def test_pairs_by_bitmaps_miss_no_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    sets = []
    for k in range(120):
        h = np.concatenate([rng.permutation(base)[: 600 - rng.integers(0, 60)], rng.integers(0, 2**63, rng.integers(0, 50), dtype=np.uint64)])
        sets.append(np.sort(h))
    part = pd.DataFrame({"doc_id": range(120), "part": range(120), "largest": 0, "n_set": list(map(len, sets)), "mine": 0, "i": 0, "j": 0})
    part["bits"] = [minhash.bitmap(h).view(np.int64) for h in sets]
    near = lambda a, b: 100 * (s := len(np.intersect1d(a, b))) >= 85 * (len(a) + len(b) - s)
    want = {(a, b) for b in range(120) for a in range(b) if near(sets[a], sets[b])}
    got = minhash.likely_pairs(part, 85, 10**6)
    assert want <= set(zip(got.a, got.b, strict=True)) and 0 < len(want) < 7000 and not got.more.any()
    part["part"] = [0] * 60 + [1] * 60
    few = minhash.likely_pairs(part, 85, 2)
    assert few.more.any() and few.groupby("b").size().max() <= 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(docs, 85, 3).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    for n in (3, 40, 400, 4000):
        pool = np.unique(rng.integers(0, 2**63, n * 2, dtype=np.uint64))[: n + n // 5]
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[-n:])
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = (minhash.signature(a) == minhash.signature(b)).mean()
        assert abs(est - real) < (0.5 if n < 10 else 0.2)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300)]
    got = dict(graph.connected_components(spark, spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}


def test_dropping_keeps_one_row_of_each_component(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away into the dark wood again " * 3
    rows = [(5, text, "a", True), (3, text + "x", "b", False), (9, "something else entirely that stands alone here", "c", True)]
    rows += [(9, "something else entirely that stands alone here", "c", True), (None, text, "d", True), (11, None, "e", None), (12, "", "e", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, may boolean")
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.kept) for r in out.collect()) == [(3, "b"), (9, "c"), (11, "e"), (12, "e")]
    assert minhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_without(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "id as may", "id as listed")
    ids = spark.range(0, 500, 7).withColumnRenamed("id", "doc_id")
    got = minhash.without(docs, ids)
    assert sorted(r.doc_id for r in got.collect()) == [k for k in range(500) if k % 7] and got.columns == docs.columns
    assert minhash.without(docs, ids.where("false")).count() == 500

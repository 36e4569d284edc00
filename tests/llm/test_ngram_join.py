import random
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import ngram_join as op
from millrace.llm.components import connected_components


def brute(rows, p=85, q=100, n=4):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    index = defaultdict(list)
    for d, own in sets.items():
        for e, both in Counter(e for g in own for e in index[g]).items():
            if q * both >= p * (len(own) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                group[b] = a
        for g in own:
            index[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed, groups=150):
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 4, 8, 9, 10, 12, 15, 20, 25, 30, 60, 100]))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                i = rnd.randrange(len(w) + 1)
                if rnd.random() < 0.4:
                    w[i:i] = [f"z{rnd.randrange(99)}"]
                elif i < len(w):
                    w[i] = f"y{rnd.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def run(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in op.jaccard_components(df).collect()}


def test_equals_brute_force(spark):
    rows = near_copies(1) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a B"), (5005, "Äx b c d"), (5006, "äx b c d"), (5007, "w " * 3000)]
    assert run(spark, rows) == brute(rows)


def test_chains_are_found_across_hubs(spark):
    base = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(12):  # each differs from the next by little, the ends by much
        w = list(base)
        w[: 3 * k] = [f"n{i}" for i in range(3 * k)]
        rows.append((100 - k, " ".join(w)))
    want = brute(rows)
    assert run(spark, rows, 3) == want and len({c for _, c in want.values()}) == 1


def test_null_ids_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b c d e")], "doc_id long, text string").withColumnRenamed("doc_id", "k")
    got = sorted(((r.k, r.n_shingles, r.component_id) for r in op.jaccard_components(df, id_col="k").collect()), key=str)
    assert got == [(7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 2, None)]
    assert op.jaccard_components(df.limit(0), id_col="k").count() == 0


def test_a_sketch_never_rejects_a_link():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        s = op.mix(rnd.integers(0, 1 << 60, 300).astype("u8"))
        t = np.concatenate([s[rnd.random(300) < 0.97], op.mix(rnd.integers(0, 1 << 60, 5).astype("u8"))])
        d = len(np.setxor1d(s, t))
        x, y = (np.frombuffer(op.sketch(np.unique(v)), "u8") for v in (s, t))
        assert np.bitwise_count(x ^ y).sum() <= d


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 200)] + [(rnd.randrange(500, 560), rnd.randrange(500, 560)) for _ in range(50)]
    group = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in group.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_sketches_of_long_sets_refuse_unlike_ones():
    rnd = np.random.default_rng(2)
    for size, other in ((1000, 1300), (3000, 3000), (4000, 4200), (20_000, 17_000)):
        s, t = (np.unique(rnd.integers(0, 1 << 62, n).astype("u8")) for n in (size, other))
        batch = [[1], [2], [len(s)], [len(t)], [op.sketch(s)], [op.sketch(t)]]
        made = op.pa.RecordBatch.from_arrays([op.pa.array(x) for x in batch], names=["a", "b", "na", "nb", "x", "y"])
        assert sum(b.num_rows for b in op._sift(80, 100)(iter([made]))) == 0
        near = np.unique(np.append(s[: int(size * 0.93)], t[: size // 20]))  # partners may have sketches of two widths
        d, words = len(np.setxor1d(s, near)), [np.frombuffer(op.sketch(v), "u8")[None, :] for v in (s, near)]
        assert op._differ(*words)[0, 0] <= d


def test_long_texts_with_a_common_passage_make_no_pairs_to_verify(spark, monkeypatch):
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join([f"w{i}x{rnd.randrange(10**6)}" for _ in range(3000)] + passage)) for i in range(40)]
    rows += [(100 + i, " ".join(rows[0][1].split()[: 3200 + 5 * i])) for i in range(3)]
    stored, near = op.stored, []

    def kept(df, name):
        out = stored(df, name)
        if name == "ngram-near":
            near.append(out)
        return out

    monkeypatch.setattr(op, "stored", kept)
    got = run(spark, rows)
    assert got == brute(rows) and sum(df.count() for df in near) <= 6


def test_neighbourhoods_do_not_run_together_along_chains(spark, monkeypatch):
    rnd = random.Random(5)
    parts = [" ".join(f"q{i}x{rnd.randrange(10**6)}" for _ in range(20)) for i in range(90)]
    rows = [(i, " ".join(parts[i : i + 10])) for i in range(80)]  # each overlaps with its neighbours and is like none
    across, areas = op.pairs_across, []

    def kept(nodes, p, q):
        areas.extend(r["count"] for r in nodes.groupBy("area").count().collect())
        return across(nodes, p, q)

    monkeypatch.setattr(op, "pairs_across", kept)
    assert run(spark, rows) == brute(rows) and areas and max(areas) < 40


def test_copies_of_texts_and_of_keys_are_not_written(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(100 * c + i, " ".join(f"w{i}x{j}" for j in range(200 + (i == c)))) for c in range(12) for i in range(20)]
    rows += [(5000 + i, " ".join(f"z{rnd.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    stored, met = op.stored, []

    def kept(df, name):
        out = stored(df, name)
        if name == "ngram-met":
            met.append(out.filter(out.kind != op.DOCUMENT).count())
        return out

    monkeypatch.setattr(op, "stored", kept)
    assert run(spark, rows, 12) == brute(rows) and sum(met) < 30 * len(rows)
    met.clear()
    assert run(spark, [(d, t) for d, t in rows if d % 100 != d // 100], 12) and sum(met) == 0


def test_members_of_batches_are_under_the_least_node_of_their_key(spark):
    rows = near_copies(7, 60)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert run(spark, rows, 3) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

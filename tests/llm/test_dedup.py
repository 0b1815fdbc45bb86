"""Line, substring and near dedup, quality rules and sharding against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import xxhash

import corpus_pipeline
from ledgerlake.llm import components, lines, quality, sharding, simhash, substrings
from ledgerlake.llm.oracles import ORACLES
from ledgerlake.llm.queries import QUERIES

from .conftest import ROWS, pairs

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def _oracle(spark, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted, found = duckdb.sql(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    order = sorted(wanted.columns)
    pd.testing.assert_frame_equal(found[order].sort_values(order).reset_index(drop=True), wanted[order].sort_values(order).reset_index(drop=True), check_dtype=False)


def test_queries_equal_sql(spark):
    for name in ORACLES:
        _oracle(spark, name)


def _line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_lines_of_odd_rows(odd, empty):
    found = Counter((r.doc_id, r.text, r.n_lines_, r.n_dropped, r.n_words) for r in lines.drop_frequent(odd, min_docs=2).collect())
    seen = Counter(k for _, t in pairs(odd) for k in {_line_key(x) for x in t.split("\n")} if k)
    wanted = Counter()
    for i, t in pairs(odd):
        parts = t.split("\n")
        stay = [x for x in parts if seen[_line_key(x)] < 2]
        wanted[(i, "\n".join(stay), len(parts), len(parts) - len(stay), 1)] += 1
    assert found == wanted
    assert lines.drop_frequent(empty).count() == 0


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(3, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(bytes([i]), 1) for i in range(batch + 1)], "line binary, docs long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(bytes(r.line)[0] for r in runs.frequent().collect()) == [0, 1, 2]


def _without_windows(documents, size):
    first = {}
    for i, t in documents:
        w = words(t)
        for p in range(len(w) - size + 1 if i is not None else 0):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    for i, t in documents:
        w = words(t)
        gone = {p + j for p in range(len(w) - size + 1) if i is not None and first[tuple(w[p : p + size])] < i for j in range(size)}
        yield i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)


def _check_factors(df, window):
    """Factors are copies of a smaller doc_id's words, in order, apart, and cover what duplicate windows cover."""
    texts = {}
    for i, t in pairs(df):
        texts.setdefault(i, []).append(t.split())
    factors = sorted((r.doc_id, r.start, r.words, r.source_id, r.source_start) for r in substrings.factors(df, window).collect())
    covered = Counter()
    for doc_id, start, n, source_id, source_start in factors:
        assert source_id < doc_id and n > 0
        ours = [w[start : start + n] for w in texts[doc_id]]
        assert any(w[source_start : source_start + n] in ours for w in texts[source_id])
        covered[doc_id] += n
    removed = Counter()
    for i, _, n, _ in _without_windows(pairs(df), window):
        removed[i] += n
    return factors, covered == +removed


def test_factors_of_documents(spark, odd):
    assert _check_factors(odd, 50)[1]
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, base), (2, other), (3, base[20:160] + ["x"] + base[100:300] + other[50:130]), (4, base[:40] + other[:200] + base[399:]), (5, base[10:390])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found, same = _check_factors(df, 50)
    assert same
    assert [f for f in found if f[0] in (3, 4)] == [(3, 0, 140, 1, 20), (3, 141, 200, 1, 100), (3, 341, 80, 2, 50), (4, 40, 200, 2, 0)]
    assert [f for f in found if f[0] == 5] == [(5, 0, 380, 1, 10)]
    assert substrings.factors(df.limit(0), 50).count() == 0


def test_greedy_parse():
    column = lambda *x: np.array(x, np.int64)
    # Two matches that go on in one source, one that reaches farther from the middle, one that lies inside.
    assert substrings.parsed(column(0, 30, 60, 70), column(50, 60, 100, 20), column(1, 1, 2, 3), column(5, 35, 0, 9)) == [(0, 90, 1, 5), (90, 70, 2, 30)]
    assert substrings.parsed(column(0, 200), column(50, 50), column(1, 1), column(0, 500)) == [(0, 50, 1, 0), (200, 50, 1, 500)]
    assert substrings.parsed(*[column()] * 4) == []


def test_substrings_of_odd_rows(odd, empty):
    found = Counter((r.doc_id, r.n_words_, r.n_removed, r.text) for r in substrings.removed(odd).collect())
    assert found == Counter(_without_windows(pairs(odd), 50))
    assert substrings.removed(empty).count() == 0


def test_substrings_of_random_texts(spark):
    rng = np.random.default_rng(6)
    pool = [" ".join(rng.choice(list("abc"), rng.integers(20, 90))) for _ in range(12)]
    documents = [(i, " ".join(rng.choice(pool, rng.integers(1, 4)))) for i in range(60)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    for window in (12, 25):
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.removed(df, window).collect()) == Counter(_without_windows(documents, window))


def test_whole_texts_stay_where_nothing_is_removed(odd):
    kept = {r.doc_id: r.text for r in substrings.removed(odd, whole=True).where("n_removed = 0 AND doc_id IN (3, 12)").collect()}
    assert kept == {3: "  \n\t \n", 12: dict(ROWS)[12]}


def _fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}).encode() for x in words(text)]
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _components(documents, radius):
    prints = [_fingerprint(t) for _, t in documents]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(documents, group):
        least[g].append(i)
    ids = {g: min((i for i in v if i is not None), default=None) for g, v in least.items()}
    return Counter((i, p, ids[g]) for (i, _), p, g in zip(documents, prints, group))


def test_simhash_groups(odd, sample, empty):
    for df, radius in ((odd, 4), (sample.limit(120), 24)):
        documents = pairs(df)
        found = Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(df, 4, radius).collect())
        assert found == _components(documents, radius)
    assert simhash.near_duplicates(empty).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(7)
    points = rng.integers(0, 2**63, 3000).astype(np.uint64)
    points = np.unique(np.concatenate([points, points[:900] ^ np.uint64(0b1011), points[:500] ^ np.uint64(1 << 40)]))
    tree = simhash.Tree(points[::3], 100, rng)
    met = set()
    for _, rows, owned in tree.route(points, 4):
        root = simhash._joined(points[rows], owned, 4)
        met |= {(min(a, b), max(a, b)) for a, b in zip(rows.tolist(), rows[root].tolist()) if a != b}
    group = np.arange(len(points))
    for a, b in met:
        group[group == max(group[a], group[b])] = min(group[a], group[b])
    for a in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 4)
        assert len(set(group[near].tolist())) == 1
    assert tree.leaves > 8


def test_components_of_long_paths(spark):
    edges = [(i + 1, i) for i in range(40)] + [(101, 100), (102, 100), (103, 102), (50, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {50: 0, 101: 100, 102: 100, 103: 100}


def test_similar_texts_leave_one(spark, odd, empty):
    rng = np.random.default_rng(8)
    base = [f"v{i}" for i in rng.integers(0, 5000, 400)]
    light, heavy = list(base), list(base)
    for p in (20, 150, 300):
        light[p] = "changed"
    for p in range(0, 400, 8):
        heavy[p] = f"other{p}"
    rows = [(3, " ".join(base)), (1, " ".join(light)), (2, " ".join(heavy)), (4, " ".join(base)), (4, " ".join(base))] + [(10 + i, " ".join(f"u{x}" for x in rng.integers(0, 9000, 300))) for i in range(30)]
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [1, 2, *range(10, 40)]
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns and sorted(r.doc_id for r in stay.where("doc_id IN (1, 2, 3, 4, 5)").collect()) == [1, 2, 3, 4]
    assert simhash.one_of_each(empty).count() == 0


def test_heads_are_held_to_the_coarse_limit_only(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(40):  # pairs that differ in 55 of the 256 bits of the head, and in 155 of all 1024
        bits = rng.integers(0, 2, 1024).astype(np.uint8)
        other = bits.copy()
        other[np.concatenate([rng.choice(256, 55, replace=False), 256 + rng.choice(768, 100, replace=False)])] ^= 1
        rows += [(len(rows) + i, np.packbits(b, bitorder="little").tobytes()) for i, b in enumerate((bits, other))]
    found = {(r.a, r.b) for r in simhash.wide_links(spark.createDataFrame(rows, "node long, print binary")).collect()}
    assert len(found & {(i + 1, i) for i in range(0, 80, 2)}) >= 36


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _similar_groups(texts):
    """Group of each text by brute force: five-word Jaccard similarity of 0.8 or more, and chains of such."""
    sets, group = [_shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return group


def test_shingles_decide_what_is_similar(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = []
    for changes in range(4, 15):  # similarity 0.9 to 0.6
        for _ in range(8):
            base = [f"w{x}" for x in rng.integers(0, 1 << 40, 240)]
            other = list(base)
            for p in 5 + 16 * rng.choice(14, changes, replace=False):
                other[p] = "changed"
            texts += [" ".join(base), " ".join(other)]
    texts += [" ".join(f"s{n}x{i}" for i in range(n + 4)) for n in range(1, 12)]  # n shingles
    texts += [" ".join(f"s{n}x{i}" for i in range(n + 5)) for n in range(1, 12)]  # and one more
    base = [f"h{x}" for x in range(200)]  # a group of which every row has many partners, near and far
    texts += [" ".join(f"e{rng.integers(1 << 40)}" if rng.random() < 0.015 else w for w in base) for _ in range(60)]
    wanted = _similar_groups(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tries in (1, 4):
        monkeypatch.setattr(simhash, "TRIES", tries)
        found = {r.doc_id: r.component for r in simhash.similar_groups(rows).collect()}
        joined, first = defaultdict(set), defaultdict(set)
        for i, g in enumerate(wanted):
            joined[g].add(i), first[found[i]].add(i)
        assert sorted(map(sorted, joined.values())) == sorted(map(sorted, first.values()))


def test_hot_keys_do_not_cost_their_square(monkeypatch):
    rng = np.random.default_rng(13)
    n, rows, apart = 3000, 0, simhash._apart

    def counted(x, y):
        nonlocal rows
        rows += len(x)
        return apart(x, y)

    monkeypatch.setattr(simhash, "_apart", counted)
    flips = rng.integers(0, 2**63, (8, n, simhash.WORDS)).astype(np.uint64)
    points = rng.integers(0, 2**63, (1, simhash.WORDS)).astype(np.uint64) ^ np.bitwise_and.reduce(flips[:4])  # 6 % of the bits
    points = np.concatenate([points, flips[4, :5]])  # and five unrelated rows
    keys, nodes = np.zeros(n + 5, np.int64), np.arange(n + 5)
    assert simhash._touching(keys, np.ascontiguousarray(points[:, : simhash.HEAD])).tolist() == list(range(n))
    a, b, more = simhash._proposed(keys, points, nodes, nodes, [None] * (n + 5), 4)
    assert len(a) == 4 * n - 10 and len(more) == n - 5 and set(a.tolist()) | set(b.tolist()) == set(range(n))
    assert len(simhash._proposed(keys, points, nodes, np.minimum(nodes // n, 1) * nodes, [None] * (n + 5), 4)[0]) == 0  # all are of a label
    assert rows < 40 * n


def test_trees_bring_together_all_rows_with_a_near_piece():
    rng = np.random.default_rng(14)
    points = rng.integers(0, 2**63, (900, simhash.WORDS)).astype(np.uint64)
    points = np.concatenate([points, points[:400] ^ np.bitwise_and.reduce(rng.integers(0, 2**63, (3, 400, simhash.WORDS)).astype(np.uint64))])
    pieces, met = simhash.pieces_for(200_000)[:3], Counter()
    for piece in pieces:
        values = next(simhash._values(points, [piece]))
        assert values.tolist() == [sum(int(p[b // 64]) >> int(b % 64) & 1 and 1 << i for i, b in enumerate(piece)) for p in points]
        tree = simhash.Tree(values[::3], 40, rng)
        for _, rows, owned in tree.route(values, simhash.RADIUS):
            rows, owned = rows[order := np.argsort(values[rows], kind="stable")], owned[order]
            distinct, first = np.unique(values[rows], return_index=True)
            pairs = [np.stack(x) for x in simhash._near(distinct, owned[first], simhash.RADIUS)]
            balls = simhash.Balls(values[rows], np.concatenate(pairs, axis=1), rows)
            for i, begin, end in zip(rows, balls.begin, balls.end):
                ball = rows[balls.rows[begin:end]].tolist()
                assert ball == sorted(set(ball))
                met |= Counter((int(i), j) for j in ball)
        near = np.bitwise_count(values[:, None] ^ values) <= simhash.RADIUS
        assert tree.leaves > 8 and set(met) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))
        met.clear()


def test_near_dedup_joins_fingerprints_by_trees(spark, monkeypatch):
    """The pipeline's stage, with many shards a tree, against brute force."""
    rng = np.random.default_rng(15)
    texts = [" ".join(f"n{x}" for x in rng.integers(0, 1 << 40, 120)) for _ in range(300)]
    for text in texts[:60]:
        words = text.split()
        for p in rng.choice(120, rng.integers(1, 5), replace=False):
            words[p] = "other"
        texts.append(" ".join(words))
    trees, made = [], simhash.Tree.__init__
    monkeypatch.setattr(simhash.Tree, "__init__", lambda tree, *args: (made(tree, *args), trees.append(tree))[0])
    monkeypatch.setattr(simhash, "SHARD", 32)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    first = {}
    for i, g in enumerate(_similar_groups(texts)):
        first.setdefault(g, i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert len(trees) > 1 and all(tree.leaves > 4 for tree in trees)


def test_wide_fingerprints_follow_jaccard():
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(600)]
    for changes in (5, 30):
        other = list(base)
        for p in rng.choice(600, changes, replace=False):
            other[p] = f"c{p}"
        a, b = ({" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        j = len(a & b) / len(a | b)
        x, y = (np.frombuffer(p, np.uint64) for p in simhash.wide_fingerprints_of([" ".join(base).encode(), " ".join(other).encode()], 5, simhash.WORDS))
        assert abs(np.bitwise_count(x ^ y).sum() / 1024 - np.arccos(2 * j / (1 + j)) / np.pi) < 0.05


def test_names_that_operators_use_may_be_taken(spark):
    names = ["__doc", "__th", "text_hash", "hit_doc", "hit_hash", "first_doc", "first_hash", "factors", "owner_id", "drop_lines"]
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "aab"]
    df = spark.createDataFrame([(i, t, *range(10)) for i, t in enumerate(texts)], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    for out, n in ((lines.drop_frequent(df, min_docs=2), 3), (simhash.one_of_each(df), 2), (substrings.removed(df), 3), (quality.cascade(df), 3)):
        assert out.columns[:12] == df.columns and out.count() == n and set(out.select(*names).distinct().collect()) == {tuple(range(10))}


def test_quality_of_odd_rows(odd, empty):
    judged = quality.judge(odd, measures=("n_words", "n_dup_lines"), columns=["doc_id", "n_words", "kept"])
    assert judged.columns == ["doc_id", "n_words", "kept", "n_words_", "n_dup_lines", "base_failed", "kept_"]
    rows = {r.doc_id: r for r in judged.collect()}
    assert rows[1].n_words_ == 0 and rows[1].base_failed and not rows[11].kept_ and rows[6].kept_ and rows[9].n_dup_lines == 1
    assert quality.cascade(odd).columns == odd.columns and quality.cascade(empty).count() == 0


def test_order_of_rules_changes_nothing(sample):
    forward = {r.doc_id: r.kept for r in quality.judge(sample, columns=["doc_id"]).collect()}
    backward = {r.doc_id: r.kept for r in quality.judge(sample, quality.RULES[::-1], columns=["doc_id"]).collect()}
    assert forward == backward and set(forward.values()) == {True, False}


def test_rules_are_ordered_by_rejection_per_cost():
    found = quality.ordered(quality.RULES[:3], {"too few words": (2.0, 0.1), "repeated windows": (1.0, 0.9)})
    assert [r.name for r in found] == ["repeated windows", "too few words", "symbols"]


def test_shards_are_near_equal(sample, odd, empty):
    rows = sharding.shard(sample, 8).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(rows) == sample.count() and sizes.max() <= 1.02 * sizes.mean() and sizes.min() >= 0.98 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert sharding.shard(odd, 3).count() == odd.count() and sharding.shard(empty, 3).count() == 0


def test_query_columns_of_shards(spark):
    rows = QUERIES["op2_sharding"](spark, SF).toPandas()
    texts = dict(pairs(spark.read.parquet(f"{SF}/documents.parquet")))
    assert len(rows) == len(texts) and set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    for r in rows.itertuples():
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and 0 <= r.shard < 40
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_rebalancing_moves_little():
    rng = np.random.default_rng(10)
    weight = {s: int(w) for s, w in enumerate(rng.pareto(2, 2000) * 1000)}
    first = sharding.rebalanced(sharding.first_map(2000, 10), weight, 10)
    grown = sharding.rebalanced(first, weight, 11)
    moved = sum(weight[s] for s in first if first[s] != grown[s])
    assert moved < 1.3 * sum(weight.values()) / 11
    loads = Counter()
    for s, shard in grown.items():
        loads[shard] += weight[s]
    assert max(loads.values()) < 1.01 * sum(weight.values()) / 11
    shrunk = sharding.rebalanced(first, weight, 9)
    assert set(shrunk.values()) == set(range(9)) and all(first[s] == shrunk[s] for s in first if first[s] < 9 and weight[s] == 0)



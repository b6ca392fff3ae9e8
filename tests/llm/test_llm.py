"""The operators for training data against brute force and public libraries."""

from __future__ import annotations

import base64
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgrid.llm import clusters, garbled, mixing, percentiles, tokens, topn


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_top_n_with_hot_group_ties_and_nulls(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), "m", rng.choice([None, float("nan"), 0.0, -0.0, 1.0, rng.random()]), f"h{rng.randint(0, 300)}") for _ in range(1500)] + [("one", "m", 1.0, "h"), ("one", "m", 1.0, "h"), ("x", "m", 1.0, None)]
    by = defaultdict(list)
    for g, m, s, h in data:
        if g is not None and h is not None and s is not None and not math.isnan(s):
            by[g, m].append((-s, h))
    want = [(*k, i + 1, h) for k, v in by.items() for i, (_, h) in enumerate(sorted(v)[:5])]
    df = spark.createDataFrame(data, "g string, m string, s double, h string").repartition(7).withColumn("t", F.lit(1))
    assert rows(topn.top_n(df, ["g", "m"], "s", "h", 5)) == sorted(want, key=repr)
    assert rows(topn.top_n(df.limit(0), ["g"], "s", "h", 5)) == []


def test_groups_with_one_hash_stay_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"g0": ["a", "a", "b", "b"], "s": [0.0, 1.0, 0.0, 2.0], "t": ["x", "y", "x", "y"], "h": [7, 7, 7, 7]})
    halves = [batch.slice(0, 1), batch.slice(1, 2), batch.slice(3, 1)]
    assert sum((b.column("t").to_pylist() for b in topn._cut(1, ["h", "g0"])(iter(halves))), []) == ["x", "x"]
    with_runs = [b.append_column("run", pa.array([0] * b.num_rows)) for b in halves]
    got = [r for b in topn._merge(1, ["g0"])(iter(with_runs)) for r in zip(*b.to_pydict().values())]
    assert got == [("a", 1, "x"), ("b", 1, "x")]


def _with(df, *names):
    """Extra columns with names that operators use themselves."""
    return df.withColumns({n: F.lit("extra") for n in names if n not in df.columns})


def test_extra_columns_with_clashing_names(spark):
    df = _with(spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), (None, 3.0, "z")], "grp string, score double, id string"), "g0", "s", "t", "h", "run", "rank_no", "r", "value", "n", "q", "part")
    assert rows(topn.top_n(df, ["grp"], "score", "id", 1)) == [("a", 1, "y")]
    state = percentiles.counts(df, ["grp"], "score")
    assert rows(percentiles.percentiles(state, ["grp"], [0.5])) == rows(spark.createDataFrame([("a", 2, 0.5, 1.5), (None, 1, 0.5, 3.0)], "grp string, n long, q double, value double"))
    f = _with(spark.createDataFrame([("r", f"h{i}", 0.1, 0.1, 1.0) for i in range(6)], "repo_id string, hash string, pagerank double, hub_score double, utility_score double"), "computed_at", "item", "n", "x", "y", "z", "group_id", "degree", "probes")
    assert len({r.group_id for r in clusters.membership(f).collect()}) == 1
    probes = _with(spark.createDataFrame([(1, "r", "h1"), (2, "r", "h2"), (3, "r", "gone"), (4, None, None)], "probe_id int, repo_id string, hash string"), "item", "n", "probes")
    assert rows(clusters.probes_together(f, probes)) == [(1, 2)]
    docs = _with(spark.createDataFrame([(1, "größe"), (2, ""), (3, None), (4, "x\ufffd" * 3)], "doc_id long, text string"), "k", "ids", "key", "kind", "restored", "id", "item", "n", "line")
    assert {r.doc_id: len(r.ids) for r in tokens.encode(docs).collect()} | {1: 0, 4: 0} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert rows(garbled.find(docs)) == [(4,)] and rows(garbled.find(docs, restored=True)) == [(4, "lost", "x\ufffd" * 3)]
    t = _with(spark.createDataFrame([(1, "s", 5), (1, "s", 5), (None, "s", 1), (2, None, 3)], "doc_id long, source string, n_tokens long"), "place", "bucket", "rest", "rounds", "below", "available")
    goal = _with(spark.createDataFrame([("s", 1.0, 1)], "source string, target_weight double, max_repeats int"), "n", "t", "total", "budget", "available")
    used, shares = mixing.mix(t, goal)
    assert rows(used) == sorted([(1, "s", 5, 1), (1, "s", 5, 1), (None, "s", 1, 1)], key=repr) and shares.first().share == 1.0


def test_very_long_texts(spark):
    long = ("größe und straße " * 20_000) + "x" * 100_000 + "é" * 50_000
    bad = long.encode().decode("cp1252", "replace")
    known = garbled.Knowledge([garbled.Step("cp1252", "utf-8")], {}, frozenset("öße"), {}, frozenset({"\ufffd"}))
    df = spark.createDataFrame([(1, long), (2, bad)], "doc_id long, text string")
    assert rows(garbled.find(df, known)) == [(2,)]
    assert tokens.count(df.where("doc_id = 1"), ["doc_id"]).first().n_tokens == len(tokens.encode(df.where("doc_id = 1")).first().ids) > 50_000


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        tree, got = topn.LoserTree([list(r) for r in runs]), []
        while tree.top >= 0 and tree.head(tree.top) is not None:
            got.append(tree.pop())
        assert got == sorted(x for r in runs for x in r)


def test_percentiles_merge_to_those_of_all(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a"] * 4 + ["b", None]), rng.choice([None, -1.0, float("nan"), 2.0, 2.0, rng.uniform(-9, 9)])) for _ in range(900)]
    df = spark.createDataFrame(data, "g string, v double")
    values = defaultdict(list)
    for g, v in data:
        if v is not None and not math.isnan(v) and v != -1:
            values[g].append(v)
    parts = [percentiles.counts(df.where(c), ["g"], "v") for c in ("v < 0", "v >= 0")]
    state = parts[0].unionByName(parts[1])
    got = {(r.g, r.q): (r.n, r.value) for r in percentiles.percentiles(percentiles.merge(state, ["g"]), ["g"], [0.0, 0.5, 0.9, 1.0]).collect()}
    assert len(got) == 4 * len(values)
    for (g, q), (n, v) in got.items():
        assert n == len(values[g]) and v == pytest.approx(np.quantile(values[g], q))
    every = percentiles.percentiles(percentiles.merge(state, []), [], [0.5]).first()
    assert every.value == pytest.approx(np.median(sum(values.values(), [])))
    assert rows(percentiles.percentiles(state.limit(0), ["g"], [0.5])) == []


def test_percentiles_broadcast_nothing(spark):
    state = spark.range(2000).selectExpr("concat('g', id % 700) AS g", "id * 0.5 AS value", "1L AS n")
    for group in (["g"], []):
        found = percentiles.percentiles(percentiles.merge(state, group), group, [0.25, 0.5])
        assert found.count() == 2 * (700 if group else 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tokens_equal_public_library(spark):
    import tiktoken

    with open(f"{tokens.FOLDER}/{tokens.VOCABULARY}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "　", "\x1c", "\xa0", "a", "Zeta", "42", ".", "'s", "é", "日本", "<|endoftext|>", "─" * 60, "ab" * 200]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", None, "x" * 50_000, "=" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("k", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (other.encode_ordinary(t) if t else [])
    counted = {r.doc_id: r.n_tokens for r in tokens.count(df, ["doc_id"]).collect()}
    assert all(counted[i] == len(got[i]) for i in got)
    e = tokens.Encoder.load()
    for t in ("banana bandana " * 20).split() + ["aaaaaaaaaaaaaaaaaaaaaaaa"]:
        assert e.merge_short(t.encode()) == e.merge_long(t.encode())


def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["big"] * 6 + ["mid", "mid", "small", "other", None]), rng.choice([0, rng.randint(1, 500)])) for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, source string, n_tokens long").cache()
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.4, 5)], "source string, target_weight double, max_repeats int")
    used, shares = mixing.mix(df, targets)
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.repeats <= caps[r.source] for r in used.collect())
    got = {r.source: r for r in shares.collect()}
    longest = 500
    for s in caps:
        assert 0 <= got[s].budget - got[s].tokens <= longest
        assert got[s].share == pytest.approx(got[s].target_weight, abs=0.01)
    assert got["none"].tokens == 0
    used, shares = mixing.mix(df.limit(0), targets)
    assert rows(used) == [] and all(r.tokens == 0 for r in shares.collect())


def test_mix_of_many_sources_and_a_given_total(spark):
    rng = random.Random(15)
    sources = [f"s{i}" for i in range(300)]
    data = [(i, rng.choice(sources), rng.randint(1, 9)) for i in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, source string, n_tokens long").cache()
    targets = spark.createDataFrame([(s, 1.0, 2) for s in sources] + [("s0", 0.5, 9), (None, 1.0, 1), ("s1", 1.0, None), ("zero", 0.0, 1)], "source string, target_weight double, max_repeats int")
    _, shares = mixing.mix(df, targets, total=9000)
    got = {r.source: r for r in shares.collect()}
    assert got.keys() == set(sources) and {r.total for r in got.values()} == {9000}
    assert all(0 <= r.budget - r.tokens <= 9 and r.budget <= r.available * r.max_repeats for r in got.values())


def test_clusters_follow_the_space(spark):
    rng = np.random.default_rng(6)
    middles, data = [(-4.0, -4.0, 0.5), (-2.6, -4.0, 0.5), (-4.0, -2.5, 2.0)], []
    for g, m in enumerate(middles):
        for i in range((900, 150, 80)[g]):
            d = rng.normal(size=3)
            x = np.array(m) + d / np.linalg.norm(d) * 0.44 * rng.random() ** (1 / 3) * (0.3 if g == 2 else 1)
            data.append(("r", f"{g}-{i}", float(10 ** x[0] - 1e-6), float(10 ** x[1] - 1e-6), float(5 * x[2])))
    data += [("r", "far", 0.5, 0.5, 20.0), ("r", "null", None, 0.5, 1.0), ("r", "nan", float("nan"), 0.5, 1.0)]
    df = spark.createDataFrame(data, "repo_id string, hash string, pagerank double, hub_score double, utility_score double").withColumn("computed_at", F.lit(1))
    got = {r.hash: r.group_id for r in clusters.membership(df.unionByName(df.limit(50))).collect()}
    assert "null" not in got and "nan" not in got and len(got) == len(data) - 2
    groups = {g: {got[h] for h in got if h.startswith(f"{g}-")} for g in range(3)}
    big = [max(v - {None}, key=lambda x: sum(got[h] == x for h in got)) for v in groups.values()]
    assert len(set(big)) == 3
    assert sum(got[h] == big[int(h[0])] for h in got if h[0] in "012" and "-" in h) > 0.97 * len(got)
    every = {r.hash: r.group_id for r in clusters.membership(df, clusters.Grid(least_degree=1)).collect()}
    assert None not in every.values() and got["far"] is None  # a record alone is a group only where asked
    summary = clusters.summary(df).collect()
    assert {r.group_id for r in summary} >= set(big) and all(1 <= len(r.typical) <= 3 for r in summary)
    assert rows(clusters.membership(df.limit(0))) == []


def test_neighbouring_cells_are_told_by_similarity():
    d = np.array([[x, y, z] for x in range(-4, 5) for y in range(-4, 5) for z in range(-4, 5)])
    grid = clusters.Grid()
    near = (d**2).sum(1) <= grid.reach**2
    assert ((grid.jaccard(d) >= grid.least_similarity - 1e-12) == near).all()


def test_no_link_is_lost_and_bands_find_most(spark):
    rng = np.random.default_rng(16)
    places = np.unique(rng.integers(-12, 12, size=(900, 3)), axis=0)
    items = spark.createDataFrame([(int(i), 1) for i in clusters._pack(places)], "item long, n long").cache()
    far = ((places[:, None, :] - places[None]) ** 2).sum(2)
    ids = clusters._pack(places)
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.where((far <= 4) & (far > 0)))}
    grid = clusters.Grid()
    exact = [(r.a, r.b) for r in clusters.links(items, grid).collect()]
    assert len(exact) == len(set(exact)) and set(exact) == want
    by_bands = {(r.a, r.b) for r in clusters.links(items, clusters.Grid(exact=False)).collect()}
    assert by_bands <= want and len(by_bands) > 0.9 * len(want)


def _corpus():
    rng = random.Random(7)
    words = ["größe", "über", "für", "können", "mädchen", "straße", "natürlich", "später", "the", "of", "house", "garden"]
    russian = ["или", "что", "как", "это", "для", "между", "когда"]
    line = lambda w: "A line of text that begins alike: " + " ".join(rng.choice(w) for _ in range(8)) + "."
    clean = ["\n".join(line(words) for _ in range(5)) for _ in range(60)] + ["\n".join(line(russian) for _ in range(5)) for _ in range(60)]
    return clean


def test_garbled_found_and_restored(spark):
    clean = _corpus()
    bad = {}
    for k, (wrong, right) in enumerate([("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8")]):
        for j in range(4):
            bad[1000 + 10 * k + j] = (clean[5 * k + j], clean[5 * k + j].encode(right).decode(wrong, "replace"))
    for j in range(6):
        bad[2000 + j] = (clean[70 + j], clean[70 + j].encode("cp1251").decode("cp1252"))
    bad[3000] = (clean[30], clean[30].replace("ü", "�", 1) if "ü" in clean[30] else "x�")
    data = [(i, t) for i, t in enumerate(clean)] + [(i, g) for i, (_, g) in bad.items()] + [(5000, None), (5001, ""), (5002, "We quote \\verb|Ã©| only: größe"), (5003, "ascii")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("k", F.lit(0))
    rows_ = garbled.find(df, restored=True).collect()
    got = {r.doc_id: r.restored for r in rows_}
    assert got.keys() == bad.keys() == {r.doc_id for r in garbled.find(df).collect()}
    assert {r.doc_id for r in rows_ if r.kind == "lost"} == {3000}
    assert got[3000] == bad[3000][0] or "ü" not in bad[3000][0]  # from the line of its copy
    whole = [i for i in bad if i < 2000]
    assert sum(got[i] == bad[i][0] for i in whole) >= len(whole) - 1
    assert rows(garbled.find(df.limit(0))) == []


def test_mappings_that_no_encoding_explains_are_learned(spark):
    clean = _corpus()
    odd = str.maketrans({"ö": "Ⴆ", "ü": "Ⴇ", "ß": "Ⴈ", "ä": "Ⴉ"})
    bad = {1000 + i: clean[i].translate(odd) for i in range(8)}
    unseen = clean[20].replace("natürlich", "Ⴇberall", 1) if "natürlich" in clean[20] else "Ⴇber"
    data = list(enumerate(clean)) + list(bad.items()) + [(2000, unseen)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    known = garbled.learn(df)
    assert {"Ⴆ": "ö", "Ⴇ": "ü"}.items() <= known.mappings.items()
    got = {r.doc_id: r.restored for r in garbled.find(df, restored=True).collect()}
    assert got.keys() == bad.keys() | {2000} and all(got[i] == clean[i - 1000] for i in bad)


def test_characters_that_stand_for_many_are_losses(spark):
    clean = _corpus()
    data = list(enumerate(clean)) + [(1000 + i, clean[i].translate(str.maketrans(dict.fromkeys("öüßä", "Ⴟ")))) for i in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert garbled.learn(df).lost == {"Ⴟ", "\ufffd"}
    got = {r.doc_id: (r.kind, r.restored) for r in garbled.find(df, restored=True).collect()}
    assert got == {1000 + i: ("lost", clean[i]) for i in range(10)}


def test_patch_needs_runs_that_correspond():
    lost = frozenset("\ufffd")
    assert garbled.patch("a\ufffdb é", "\ufffd\x00é", "ö\x00é", lost) == "aöb é"
    assert garbled.patch("a\ufffdb é", "\ufffd\x00é", "ö\x00è", lost) == "a\ufffdb é"
    assert garbled.patch("a\ufffdb", "\ufffd", "ö\x00è", lost) == "a\ufffdb"


def test_explain_tells_steps():
    assert garbled.Step("cp1252", "utf-8") in garbled.explain("Ã©", "é")
    assert garbled.Step("cp1252", "utf-8") in garbled.explain("ÃƒÂ©", "é")
    assert garbled.Step("cp1252", "cp1251") in garbled.explain("èëè", "или")
    assert not garbled.explain("é", "ä")

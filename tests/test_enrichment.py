import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.operators import gsea, ora, sets as st, similarity as sim
from setloom.operators.sampling import draw_subsets, overlaps_at_least, seeded


def running_extremes(aw, hits):
    """Full running sum over all features."""
    n, k = len(aw), len(hits)
    total = aw[hits].sum()
    step = np.full(n, -1.0 / (n - k))
    step[hits] = aw[hits] / total if total > 0 else 1.0 / k
    run = np.concatenate([[0], np.cumsum(step)])
    mx, mn = round(run.max(), 12), round(run.min(), 12)
    return mx if mx > -mn else mn if -mn > mx else 0.0


def test_random_scores_equal_the_running_sum():
    rng = np.random.default_rng(0)
    for n, k in ((10, 1), (40, 7), (60, 55)):
        w = np.sort(np.abs(rng.normal(size=n)))[::-1].copy()
        picks = draw_subsets(rng, n, k, 30)
        assert (np.diff(picks, axis=1) > 0).all() if k > 1 else True
        want = [running_extremes(w, p) for p in picks]
        assert gsea.random_scores(w, picks) == pytest.approx(want, abs=1e-9)
    zero = gsea.random_scores(np.zeros(10), np.array([[0, 1], [8, 9]]))
    assert zero == pytest.approx([1.0, -1.0])


def test_subsets_are_uniform():
    picks = draw_subsets(seeded("a"), 7, 3, 30000)
    share = np.bincount(picks.ravel(), minlength=7) / 30000
    assert share == pytest.approx([3 / 7] * 7, abs=0.015)
    assert (draw_subsets(seeded("a"), 7, 3, 50) == draw_subsets(seeded("a"), 7, 3, 50)).all()
    assert draw_subsets(seeded("b"), 9, 8, 20).shape == (20, 8)


@pytest.fixture(scope="module")
def ranking(spark):
    rng = np.random.default_rng(2)
    n = 300
    w = rng.normal(size=n)
    weights = spark.createDataFrame([("S", f"f{i:03d}", float(v)) for i, v in enumerate(w)], "study_id string, feature_id string, weight double").cache()
    members = {"top": np.argsort(-w)[:25], "low": np.argsort(w)[:30], "any": rng.choice(n, 25, replace=False)}
    sets = spark.createDataFrame([("S", i, name, f"f{m:03d}") for i, (name, ms) in enumerate(members.items()) for m in ms],
                                 "study_id string, set_ord int, set_name string, member string").cache()
    return w, members, weights, sets


def test_scores_and_leading_edges(ranking):
    w, members, weights, sets = ranking
    order = np.argsort(-w, kind="stable")
    place = {int(f): r for r, f in enumerate(order)}
    for hot in (None, 20):
        got = {r["set_name"]: r for r in gsea.enrichment_scores(gsea.rank_features(weights, hot), sets, 20, hot_rows=hot).collect()}
        for name, ms in members.items():
            hits = np.sort([place[int(m)] for m in ms])
            assert got[name]["es"] == pytest.approx(running_extremes(np.abs(w[order]), hits), abs=1e-9)
    assert got["top"]["leading_edge"] == [f"f{m:03d}" for m in members["top"]]
    assert got["low"]["leading_edge"] == [f"f{m:03d}" for m in members["low"]]


def test_permutation_table(ranking):
    w, members, weights, sets = ranking
    a = {r["set_name"]: r for r in gsea.run_enrichment(weights, sets, 20, 400).collect()}
    b = {r["set_name"]: r for r in gsea.run_enrichment(weights.repartition(7), sets.repartition(3), 20, 400).collect()}
    assert {k: (v["p_value"], v["nes"]) for k, v in a.items()} == {k: (v["p_value"], v["nes"]) for k, v in b.items()}
    assert a["top"]["p_value"] < 0.02 and a["low"]["p_value"] < 0.02 and a["any"]["p_value"] > 0.02
    assert a["top"]["nes"] > 1 and a["low"]["nes"] < -1 and a["low"]["signed_q_value"] < 0


def test_null_of_a_set_that_holds_most_of_the_ranking():
    """Nearly full sets draw their complement; the null of complements mirrors that of their sets."""
    rng = np.random.default_rng(4)
    w = np.abs(rng.normal(size=400))
    for k in (380, 396):
        picks = draw_subsets(seeded("x", k), 400, k, 300)
        assert picks.shape == (300, k) and all(len(set(p)) == k for p in picks.tolist())
        assert (np.diff(picks, axis=1) > 0).all()
        full = [set(rng.choice(400, k, replace=False).tolist()) for _ in range(300)]
        plain = np.array([running_extremes(w, sorted(f)) for f in full])
        assert np.mean(gsea.random_scores(w, picks)) == pytest.approx(plain.mean(), abs=0.12)


def test_results_do_not_depend_on_the_blocks(ranking, monkeypatch):
    w, members, weights, sets = ranking
    rows = []
    for hits in (50_000, 1):
        monkeypatch.setattr(gsea, "HITS_A_JOB", hits)
        rows.append(sorted(map(str, gsea.run_enrichment(weights, sets, 20, 600).collect())))
    assert rows[0] == rows[1]


def test_overlap_draws_follow_the_law():
    for n, m, k, x in ((50, 10, 20, 5), (50, 45, 40, 36), (10**10, 5 * 10**9, 1000, 500), (7, 7, 3, 3)):
        got = overlaps_at_least(seeded(n, m, k), n, m, k, x, 20_000) / 20_000
        if n < 100:
            total = math.comb(n, k)
            want = sum(math.comb(m, v) * math.comb(n - m, k - v) for v in range(x, min(m, k) + 1)) / total
        else:
            want = 0.5126
        assert got == pytest.approx(want, abs=0.015)


def test_empirical_p_follows_the_hypergeometric(spark):
    rng = np.random.default_rng(8)
    rows = [("S", f"set{s}", f"m{m}") for s in range(8) for m in rng.choice(120, 20, replace=False)]
    sets = spark.createDataFrame(rows, "study_id string, set_name string, member string")
    query = spark.createDataFrame([("S", f"m{m}") for m in range(0, 60)] + [("S", "elsewhere")], "study_id string, member string")
    out = ora.run_ora(sets, query, draws=4000).collect()
    assert len(out) == 8
    for r in out:
        p = r["p_hyper"]
        assert r["p_empirical"] == pytest.approx(p, abs=4 * np.sqrt(p * (1 - p) / 4000) + 0.001)
        assert r["significant"] == (r["p_empirical_adj"] <= 0.05)


def test_a_query_outside_the_universe_gives_null_rows(spark):
    sets = spark.createDataFrame([("S", "a", " x "), ("S", "a", "x"), ("S", "b", "y"), ("S", "c", "")], "study_id string, set_name string, member string")
    query = spark.createDataFrame([("S", "zzz")], "study_id string, member string")
    rows = ora.run_ora(sets, query, draws=10).collect()
    assert len(rows) == 2 and all(r["K"] == 0 and r["p_hyper"] is None and r["p_empirical"] is None and r["significant"] is False for r in rows)


def test_pair_counts_in_blocks(spark):
    rng = np.random.default_rng(6)
    left = [(f"a{i}", f"m{m}") for i in range(12) for m in rng.choice(40, 9, replace=False)] + [("hub", f"m{m}") for m in range(40)]
    right = [(f"b{i}", f"m{m}") for i in range(5) for m in rng.choice(40, 15, replace=False)]
    l = spark.createDataFrame([("S", *r) for r in left], "study_id string, id string, member string")
    r = spark.createDataFrame([("S", *x) for x in right], "study_id string, id string, member string")

    def brute(x, y, ok):
        out = {}
        for i, m in x:
            for j, n in y:
                if m == n and ok(i, j):
                    out[i, j] = out.get((i, j), 0) + 1
        return out

    for size in ({}, {"ids_per_block": 3, "rows_per_bucket": 20}):
        got = {(x["a"], x["b"]): x["n"] for x in st.pair_counts(l, r, **size).collect()}
        assert got == brute(left, right, lambda i, j: True)
        got = {(x["a"], x["b"]): x["n"] for x in st.pair_counts(l, **size).collect()}
        assert got == brute(left, left, lambda i, j: i < j)


def test_specific_sets_count_repeats_but_not_twice_for_frequency(spark):
    rows = [("S", "a", "x"), ("S", "a", "x"), ("S", "a", "y"), ("S", "b", "y"), ("S", "b", "z")]
    sets = spark.createDataFrame(rows, "study_id string, set_name string, member string")
    kept = [tuple(r) for r in st.retain_specific(sets, 0.5, 1).select("set_name", "member").collect()]
    assert kept == [("a", "x"), ("a", "x")]


def test_helper_selection_without_leading_edges(spark):
    df = spark.createDataFrame([("S", "a", 0.01, []), ("S", "b", 0.02, []), ("S", "c", 0.5, ["x"]), ("S", "d", float("nan"), ["x"])],
                               "study_id string, set_name string, q_value double, leading_edge array<string>")
    rows = sim.select_helpers(df, use_elbow=False).collect()
    assert {r["set_name"]: r["connectivity"] for r in rows} == {"a": None, "b": None}
    assert sim.select_helpers(df.where("q_value > 0.3")).count() == 0


def test_zero_overlap_sets_stay_in_the_adjustment(spark):
    """A set the helper misses is tested like an overlap of one, and may win."""
    assoc = spark.createDataFrame([(f"e{i}", f"g{i}") for i in range(40)], "GHid string, symbol string")
    edges = spark.createDataFrame([("S", "h", "e0")], "study_id string, helper string, member string")
    groups = [(1, "big", i) for i in range(20)] + [(2, "small", i) for i in range(30, 34)] + [(3, "twin", i) for i in range(34, 38)]
    gs = spark.createDataFrame([(o, n, f"g{m}") for o, n, m in groups], "set_ord int, set_name string, member string")
    helpers = spark.createDataFrame([("S", "h"), ("S", "none")], "study_id string, helper string")
    rows = {r["helper"]: r for r in ora.annotate_top1(helpers, edges, assoc, gs, min_size=2, alpha=0.2).collect()}
    assert rows["h"]["top_q"] == pytest.approx(0.15) and rows["h"]["top_hallmark"] == "small"
    assert rows["none"]["top_hallmark"] == "no significant HALLMARK annotation"


def test_disambiguation_matrix_has_every_pair(ranking):
    _, _, weights, sets = ranking
    chosen = sets.select("study_id", "set_name", "set_ord").distinct()
    m = gsea.disambiguation_matrix(weights, sets, chosen, permutations=100)
    rows = {(r["set_name"], r["removed_set"]): r["q_value"] for r in m.collect()}
    assert len(rows) == 9 and all(rows[x, x] == 1.0 for x in ("top", "low", "any")) and rows["top", "low"] < 1
    out = gsea.disambiguate(m, chosen).collect()
    assert len(out) == 3


def test_splitting_reaches_exact_small_tails(spark):
    """Tails of every 4-subset of 24 ranks, enumerated; the least is one in 10 626."""
    import itertools

    import numpy as np

    from setloom.operators import gsea, splitting

    w = np.sort(np.random.default_rng(5).exponential(1.0, 24))[::-1]
    every = gsea.random_scores(w, np.array(list(itertools.combinations(range(24), 4))))
    values = np.unique(every[every > 0])
    targets = np.concatenate([values[[-1, -2, -10]], np.quantile(values, [0.5, 0.9]), np.unique(every[every < 0])[[0, 1, -1]]])
    wanted = spark.createDataFrame([("s", 4, float(t)) for t in targets], "study_id string, size long, es double")
    vectors = spark.createDataFrame([("s", w.tolist())], "study_id string, _w array<double>")
    got = splitting.rare_tails(wanted, vectors).collect()
    assert len(got) == len(set(targets))
    for r in got:
        exact = (every >= r.es).mean() if r.es > 0 else (every <= r.es).mean()
        error = np.sqrt(max(-np.log2(exact), 1.0) / (splitting.RUNS * splitting.PARTICLES))
        assert abs(r.tail_p / exact - 1) < 6 * error, (r.es, r.tail_p, exact)
    again = splitting.rare_tails(wanted.repartition(7), vectors).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_enrichment_has_no_floor(spark):
    from setloom.operators import gsea

    weights = spark.createDataFrame([("s", f"f{i}", float(300 - i)) for i in range(600)], "study_id string, feature_id string, weight double")
    top = [("s", "top", f"f{i}") for i in range(40)] + [("s", "spread", f"f{i}") for i in range(0, 600, 15)]
    sets = spark.createDataFrame(top, "study_id string, set_name string, member string")
    p = {r.set_name: r.p_value for r in gsea.run_enrichment(weights, sets, 10, permutations=500).collect()}
    floor = {r.set_name: r.p_value for r in gsea.run_enrichment(weights, sets, 10, permutations=500, rare=0).collect()}
    assert 0 < p["top"] < 1e-12 and floor["top"] > 1e-3 and p["spread"] == floor["spread"] > 0.01


def test_pair_counts_unfold_members_of_few_sets(spark):
    # One id a block: copies for the blocks would be 4000 x 2000 rows, the pairs of the members are 2000.
    chain = [("s", f"i{k % 2000:04}", f"m{m}") for m in range(2000) for k in (m, m + 1)]
    df = spark.createDataFrame(chain, "study_id string, id string, member string")
    got = {(x["a"], x["b"]): x["n"] for x in st.pair_counts(df, ids_per_block=1).collect()}
    assert got == {tuple(sorted((f"i{m:04}", f"i{(m + 1) % 2000:04}"))): 1 for m in range(2000)}
    # A hub goes to the blocks, the others unfold; both add up.
    rows = [("s", f"i{k:02}", "hub") for k in range(40)] + [("s", f"i{k:02}", f"m{k // 2}") for k in range(40)]
    df = spark.createDataFrame(rows, "study_id string, id string, member string")
    got = {(x["a"], x["b"]): x["n"] for x in st.pair_counts(df, ids_per_block=4).collect()}
    assert got == {(f"i{a:02}", f"i{b:02}"): 1 + (a // 2 == b // 2) for b in range(40) for a in range(b)}


def test_large_subsets_move_on_one_level():
    """Exchanges with positions outside never collide, so a large subset mixes within the proposals of one level."""
    from setloom.operators import splitting

    rng = seeded("mix")
    picks = draw_subsets(rng, 20_000, 6_000, 9)
    before = picks.copy()
    splitting._exchange(rng, picks, np.zeros(9), -1.0, 20_000, lambda p: np.zeros(len(p)), 3_000)
    assert (np.diff(picks, axis=1) > 0).all() and picks.min() >= 0 and picks.max() < 20_000
    kept = np.mean([len(np.intersect1d(a, b)) / 6_000 for a, b in zip(before, picks, strict=True)])
    assert kept < 0.6


def test_long_jobs_are_not_merged_by_their_bytes(ranking):
    from setloom.operators import gsea

    _, _, weights, sets = ranking
    ranked = gsea.rank_features(weights)
    scores = gsea.enrichment_scores(ranked, sets, 20, leading_edge=False)
    lanes = gsea._lanes(scores, 20_000)
    jobs = [(j["_chunk"], tuple(s["size"] for s in j["_sizes"])) for r in lanes.collect() for j in r["_jobs"]]
    assert lanes.count() == 80
    assert len(jobs) == len(set(jobs)) == 80
    null = gsea.permutation_null(scores.select("study_id", "set_name", "size", "N", "es"), ranked, 20_000)
    assert "REPARTITION_BY_NUM" in null._jdf.queryExecution().toString()


def test_equal_derived_sets_are_tested_once(spark, ranking, monkeypatch):
    """Sets without a common member keep all of theirs: they are tested once, and count in the adjustment as often as they stand."""
    _, _, weights, sets = ranking
    held = {"a": set(range(0, 40)), "b": set(range(20, 60)), "c": set(range(100, 140)), "d": set(range(130, 170))}
    held = {name: {f"f{m:03d}" for m in ms} for name, ms in held.items()}
    wide = spark.createDataFrame([("S", i, name, m) for i, (name, ms) in enumerate(held.items()) for m in sorted(ms)], sets.schema)
    chosen = wide.select("study_id", "set_name", "set_ord").distinct()
    every = [("S", f"{x}|{y}", m) for x in held for y in held if x != y for m in held[x] - held[y]]
    plain = gsea.run_enrichment(weights, spark.createDataFrame(every, "study_id string, set_name string, member string"), 10, 200)
    want = {tuple(r["set_name"].split("|")): r["q_value"] for r in plain.collect()}
    seen = []
    scores = gsea.enrichment_scores

    def counted(ranked, derived, *rest, **named):
        seen.append(derived.select("set_name").distinct().count())
        return scores(ranked, derived, *rest, **named)

    monkeypatch.setattr(gsea, "enrichment_scores", counted)
    rows = gsea.disambiguation_matrix(weights, wide, chosen, 10, 200).collect()
    got = {(r["set_name"], r["removed_set"]): r["q_value"] for r in rows}
    pairs = {(x, y) for x in held for y in held if x != y and held[x] & held[y]}
    assert len(rows) == len(got) == 16 and seen == [8] and len(pairs) == 4
    assert {k: q for k, q in got.items() if k in want} == pytest.approx(want) and all(q == 1.0 for k, q in got.items() if k not in want)


def test_corrected_activity_meets_only_significant_sets(spark, monkeypatch):
    """Pairs are formed inside a sample, between sets significant there; pairs of all sets are not counted."""
    from setloom.operators import activity, sets as set_ops

    def refuse(*_, **__):
        raise AssertionError("pairs of all sets")

    monkeypatch.setattr(set_ops, "pair_counts", refuse)
    rng = np.random.default_rng(3)
    values = rng.normal(size=(60, 4))
    values[:30, 0] += 4
    cells = [("S", f"f{f:02}", f"s{s}", float(values[f, s] + 20)) for f in range(60) for s in range(4)]
    counts = spark.createDataFrame(cells, "study_id string, feature_id string, sample_id string, value double")
    samples = spark.createDataFrame([("S", f"s{s}") for s in range(4)], "study_id string, sample_id string")
    held = {"strong": range(0, 30), "shadow": [*range(0, 12), *range(40, 52)], "rest": range(30, 60)}
    sets = spark.createDataFrame([("S", n, f"f{m:02}") for n, ms in held.items() for m in ms], "study_id string, set_name string, member string")
    plain = {(r["set_name"], r["sample_id"]): r["nes"] for r in activity.set_activity(counts, samples, sets, 10).collect()}
    rows = activity.pleiotropy_corrected(counts, samples, sets, 10, regulator_p=0.2, min_shared=5).collect()
    got = {(r["set_name"], r["sample_id"]): r["nes"] for r in rows}
    assert len(rows) == 12 and got.keys() == plain.keys()
    assert got["shadow", "s0"] < plain["shadow", "s0"] and got["rest", "s0"] == pytest.approx(plain["rest", "s0"])


def test_genes_of_helpers_are_dealt_by_the_rows_they_unfold_into(spark):
    """Few members unfold into many genes: the tasks that tell them apart go by the rows, not by the bytes of the members."""
    edges = spark.createDataFrame([("s:1", f"h{i}", f"m{j}") for i in range(40) for j in range(3)], "study_id string, helper string, member string")
    assoc = spark.createDataFrame([(f"m{j}", f"g{(j * 30 + k) % 70}") for j in range(3) for k in range(50)], "GHid string, symbol string")
    genes = ora.members_to_genes(edges, assoc, rows_per_task=500)
    assert genes.rdd.getNumPartitions() == 12  # 40 helpers x 3 members x 50 genes
    got = [tuple(r) for r in genes.collect()]
    want = {("s:1", f"h{i}", f"g{(j * 30 + k) % 70}") for i in range(40) for j in range(3) for k in range(50)}
    assert len(got) == len(want) and set(got) == want


def test_top_annotation_keeps_odd_names_apart(spark):
    helpers = spark.createDataFrame([("a:", "b"), ("a", ":b"), ("", "a:b")], "study_id string, helper string")
    edges = spark.createDataFrame([("a:", "b", "m1"), ("a", ":b", "m2"), ("", "a:b", "m1")], "study_id string, helper string, member string")
    assoc = spark.createDataFrame([("m1", f"g{k}") for k in range(4)] + [("m2", f"g{k}") for k in range(4, 20)], "GHid string, symbol string")
    sets = spark.createDataFrame([(1, "low", f"g{k}") for k in range(4)] + [(2, "high", f"g{k}") for k in range(12, 20)],
                                 "set_ord long, set_name string, member string")
    got = {(r["study_id"], r["helper"]): r["top_hallmark"] for r in ora.annotate_top1(helpers, edges, assoc, sets, min_size=2, alpha=0.9).collect()}
    assert got == {("a:", "b"): "low", ("", "a:b"): "low", ("a", ":b"): "high"}


def test_cosine_pairs_move_one_row_an_id_and_member(spark):
    """Pairs unfold where they are counted, and nothing is joined to them: 30 sets of 300 members are 435 pairs 300 times."""
    rows = [("S", f"s{k:02}" if k else "s", f"m{m}") for k in range(30) for m in range(300) if k < 20 or m % 3]
    frame = spark.createDataFrame(rows + rows[:50], "study_id string, set_name string, member string")
    pairs = sim.cosine_pairs(frame)
    held = {}
    for _, name, member in rows:
        held.setdefault(name, set()).add(member)
    want = {(a, b): round(len(held[a] & held[b]) / math.sqrt(len(held[a]) * len(held[b])), 9) for a in held for b in held if a < b}
    assert {(r["from"], r["to"]): round(r["similarity"], 9) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Generate explode(_bs")]
    assert "Join" not in top and "Repartition" not in top

import numpy as np
from pyspark.sql import functions as F

from setloom.operators import intervals as iv


def frame(spark, rows):
    return spark.createDataFrame([(c, int(s), int(e), i, i) for i, (c, s, e) in enumerate(rows)],
                                 "chrom string, start long, end long, id long, ord long")


def random_rows(rng, n, longest):
    out = []
    for _ in range(n):
        s = int(rng.integers(0, 20000))
        length = int(rng.choice([1, 2, 63, 64, 65, 500, 4097, longest]))
        out.append((rng.choice(["1", "1", "1", "2"]), s, s + length - 1))
    return out


def brute(a, b):
    return {(i, j) for i, (c, s, e) in enumerate(a) for j, (d, t, f) in enumerate(b) if c == d and s <= f and t <= e and s <= e and t <= f}


def test_overlap_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = random_rows(rng, 150, 300000), random_rows(rng, 120, 20)
    a += [("1", 64, 127), ("1", 128, 128), ("1", 10, 9)]
    b += [("1", 127, 127), ("1", 128, 200), ("1", 0, 63)]
    got = [(r["a_id"], r["b_id"]) for r in iv.overlap_join(frame(spark, a), frame(spark, b)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(a, b)


def test_first_and_excluded(spark):
    rng = np.random.default_rng(4)
    a, b = random_rows(rng, 80, 9000), random_rows(rng, 40, 100)
    pairs = brute(a, b)
    first = {r["id"]: r["mapped_id"] for r in iv.first_overlap(frame(spark, a), frame(spark, b)).collect()}
    assert first == {i: min(j for x, j in pairs if x == i) for i in {x for x, _ in pairs}}
    kept = {r["id"] for r in iv.exclude_overlaps(frame(spark, a), frame(spark, b), 25).collect()}
    wide = [(c, max(0, s - 25), e + 25) for c, s, e in b]
    assert kept == set(range(len(a))) - {i for i, _ in brute(a, wide)}


def test_no_exon_keeps_every_row(spark):
    a = frame(spark, [("1", 1, 10), ("2", 5, 9)])
    assert iv.exclude_overlaps(a, a.limit(0)).count() == 2


def test_zero_based_variant_table_moves_every_row(spark):
    ids = spark.createDataFrame([("rs1",), ("rs2",), ("rs9",)], "rsid string")
    table = spark.createDataFrame([("rs1", "1", 0), ("rs2", "X", 7), ("rs3", "1", 3)], "rsid string, chrom string, pos long")
    got = {r["id"]: r["start"] for r in iv.lookup_variants(ids, table).collect()}
    assert got == {"rs1": 1, "rs2": 8}
    got = iv.lookup_variants(ids, table.where("pos > 0")).collect()
    assert [(r["id"], r["start"]) for r in got] == [("rs2", 7)]


def test_union_length(spark):
    x = spark.createDataFrame([("g", "1", 1, 10), ("g", "1", 5, 12), ("g", "1", 2, 3), ("g", "1", 20, 20), ("g", "2", 1, 5), ("h", "1", 3, 3), ("h", "1", 4, 6)],
                              "gene_id string, chrom string, start long, end long")
    assert {r["gene_id"]: r["length"] for r in iv.union_length(x, ["gene_id"]).collect()} == {"g": 12 + 1 + 5, "h": 4}


def test_read_counting_strands(spark):
    reads = spark.createDataFrame([("s", 1, "1", 5, 9, "+"), ("s", 2, "1", 5, 9, "-"), ("s", 3, "1", 90, 99, "+"), ("s", 4, "1", 19, 21, "+")],
                                  "sample_id string, read_id long, chrom string, start long, end long, strand string")
    feats = spark.createDataFrame([("1", 1, 20, "f", "+"), ("1", 21, 40, "g", "+")], "chrom string, start long, end long, feature_id string, strand string")
    for stranded, want in ((0, {"f": 2}), (1, {"f": 1}), (2, {"f": 1})):
        counts, status = iv.count_reads(reads, feats, stranded)
        assert {r["feature_id"]: r["value"] for r in counts.collect()} == want
        assert sum(r["reads"] for r in status.collect()) == 4


def test_counts_without_pairs(spark):
    import random

    from setloom.operators import intervals as iv

    random.seed(7)
    kinds = "chrom string, start long, end long, id long"
    rows = [(random.choice(["a", "b", None]), s, s + random.choice([-3, 0, 0, 5, 300]), k)
            for k, s in enumerate(random.randrange(400) for _ in range(300))]
    others = [(random.choice(["a", "b", "c"]), s, s + random.choice([-1, 0, 2, 90]), k)
              for k, s in enumerate(random.randrange(400) for _ in range(200))]
    a, b = spark.createDataFrame(rows + rows[:5], kinds), spark.createDataFrame(others, kinds)
    want = {}
    for chrom, s, e, k in rows + rows[:5]:
        if s <= e:
            want[chrom, k] = want.get((chrom, k), 0) + sum(c == chrom and s <= y and x <= e for c, x, y, _ in others if x <= y)
    assert {(r.chrom, r.id): r.n for r in iv.count_overlaps(a, b).collect() if r.chrom} == {k: v for k, v in want.items() if k[0]}
    assert {(r.chrom, r.id) for r in iv.overlapping_ids(a, b).collect()} == {k for k, v in want.items() if v and k[0]}
    assert iv.count_overlaps(a.limit(0), b).count() == 0


def test_one_crowded_locus_is_linear(spark):
    """Forty thousand intervals over each other are 1.6 billion pairs; their counts come from one scan."""
    from pyspark.sql import functions as F

    from setloom.operators import intervals as iv

    x = spark.range(40_000).select(F.lit("c").alias("chrom"), (F.col("id") % 100).alias("start"), (F.col("id") % 100 + 1000).alias("end"), "id")
    counted = iv.count_overlaps(x, x)
    assert counted.agg(F.min("n"), F.max("n"), F.count("n")).first() == (40_000, 40_000, 40_000)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_overlap_forms_no_pairs(spark, monkeypatch):
    import random

    def refuse(*_, **__):
        raise AssertionError("pairs")

    monkeypatch.setattr(iv, "overlap_join", refuse)
    random.seed(4)

    def rows(n, long):
        starts = [random.randrange(-500, 4000) for _ in range(n)]
        return [(random.choice("xy"), s, s + random.choice([-1, 0, 1, 5, random.randrange(long)])) for s in starts]

    a = [(c, s, e, i) for i, (c, s, e) in enumerate(rows(150, 300))]
    b = [(c, s, e, i, (i * 37) % 101) for i, (c, s, e) in enumerate(rows(101, 3000))]
    got = iv.first_overlap(spark.createDataFrame(a + a[:5], "chrom string, start long, end long, id long"),
                           spark.createDataFrame(b, "chrom string, start long, end long, id long, ord long"))
    want = {}
    for c, s, e, i in a:
        hits = [(o, j) for d, x, y, j, o in b if c == d and s <= e and x <= y and s <= y and x <= e]
        if hits:
            want[i] = min(hits)[1]
    found = got.collect()
    assert len(found) == len(want) and {r["id"]: r["mapped_id"] for r in found} == want


def _pairs_of(df):
    return sorted((r["input_id"], r["annotation_id"]) for r in df.collect())


def test_mapped_points_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    a, b = random_rows(rng, 300, 20), random_rows(rng, 150, 9000) + [("1", 10, 9), ("1", 700, 700)]
    a = [(c, s, s) for c, s, _ in a[:280]] + a[280:] + [("1", 700, 700)] * 5 + [("2", -4, -4)]
    want = sorted(brute(a, b))
    points, known = frame(spark, a), frame(spark, b)
    assert _pairs_of(iv.map_points(points, known)) == want
    lists = {r["input_id"]: r["annotation_ids"] for r in iv.annotations_by_point(points, known).collect()}
    assert lists == {i: [y for x, y in want if x == i] for i in {x for x, _ in want}}
    # Inputs and intervals of several rows: a pair comes once.
    twice = _pairs_of(iv.map_points(points.unionAll(points.selectExpr("chrom", "start + 1", "end + 1", "id", "ord")), known.unionAll(known)))
    more = brute([(c, s + 1, e + 1) for c, s, e in a], b)
    assert twice == sorted(set(want) | more)
    joined = iv.annotations_by_point(points, known.unionAll(known), sep=",").collect()
    assert {r["input_id"]: r["annotation_ids"] for r in joined} == {k: ",".join(map(str, v)) for k, v in lists.items()}


def test_pairs_of_copies_are_not_moved(spark):
    """400 inputs and 400 intervals at one place: 160 000 pairs, of which no exchange may carry any."""
    x = spark.range(400).selectExpr("'1' AS chrom", "5L AS start", "5L AS end", "id")
    for mapped, rows in ((iv.map_points(x, x), 160_000), (iv.annotations_by_point(x, x, sep=","), 400)):
        assert mapped.count() == rows
        plan = mapped._jdf.queryExecution().optimizedPlan().toString()
        top = plan[:plan.index("Join")]
        assert "Aggregate" not in top and "Distinct" not in top


def test_rows_of_one_interval_meet_as_one(spark):
    """Rows that share their interval unfold after the join; no pair is lost or doubled, whatever the payload."""
    a, b = [("1", 5, 90)] * 7 + [("1", 80, 80), ("2", 1, 1), ("1", 9, 8)], [("1", 60, 70)] * 5 + [("1", 85, 400)] * 3 + [("2", 1, 1)] * 2
    joined = iv.overlap_join(frame(spark, a), frame(spark, b).unionAll(frame(spark, b)))
    got = sorted((r["a_id"], r["b_id"]) for r in joined.collect())
    assert got == sorted([*brute(a, b), *brute(a, b)])
    assert joined.columns == ["chrom", "a_start", "a_end", "a_id", "a_ord", "b_start", "b_end", "b_id", "b_ord"]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_b_rows") < plan.index("explode(_a_rows") < plan.index("Join")

"""Set collections in long form: (study_id, set_ord, set_name, member[, member_ord])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["study_id", "set_name"]

# Members of up to twice as many sets always unfold into their pairs.
UNFOLD = 8


def clean_sets(sets: DataFrame) -> DataFrame:
    """Trimmed, non-empty, distinct members; sets left without a member vanish."""
    member = F.trim(F.col("member").cast("string"))
    return sets.select(*KEY, member.alias("member")).where(F.coalesce("member", F.lit("")) != "").distinct()


def set_order(sets: DataFrame) -> DataFrame:
    """Input position of each set name."""
    return sets.groupBy(*KEY).agg(F.min("set_ord").alias("set_ord"))


def universe(sets: DataFrame) -> DataFrame:
    return sets.select("study_id", "member").distinct()


def member_frequency(sets: DataFrame) -> DataFrame:
    """Share of the sets of a study that contain a member, on distinct pairs."""
    pairs = sets.select(*KEY, "member").distinct()
    total = pairs.groupBy("study_id").agg(F.count_distinct("set_name").alias("_total"))
    per = pairs.groupBy("study_id", "member").agg(F.count(F.lit(1)).alias("n_sets"))
    return per.join(total, "study_id").select(
        "study_id", "member", "n_sets", (F.col("n_sets") / F.col("_total")).alias("frequency"))


def retain_specific(sets: DataFrame, max_share: float = 0.05, min_size: int = 10) -> DataFrame:
    """Members in at most ``max_share`` of the sets; then sets with more than ``min_size`` rows left.

    The remaining size counts repeated members, as the rows themselves do.
    """
    rare = member_frequency(sets).where(F.col("frequency") <= max_share).select("study_id", "member")
    kept = sets.join(rare, ["study_id", "member"], "left_semi")
    big = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_size).select(*KEY)
    return kept.join(big, KEY, "left_semi")


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy(*KEY).agg(F.count_distinct("member").alias("size"))


def intersect_members(sets: DataFrame, query: DataFrame) -> DataFrame:
    """Set rows whose member is in the query of the same study."""
    return sets.join(query.select("study_id", "member"), ["study_id", "member"], "left_semi")


def difference(x: DataFrame, y: DataFrame) -> DataFrame:
    """Members of x that y lacks."""
    return x.join(y.select("study_id", "member"), ["study_id", "member"], "left_anti")


def append_members(*queries: DataFrame) -> DataFrame:
    out = queries[0]
    for q in queries[1:]:
        out = out.unionByName(q)
    return out.distinct()


def overlap_ratio(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def detection_by_set(sets: DataFrame, rates: DataFrame) -> DataFrame:
    """Mean detection rate of the members that occur in the matrix, 0 if none does.

    ``rates``: study_id, feature_id, rate. Repeated members count as often as listed.
    """
    r = rates.select("study_id", F.col("feature_id").alias("member"), "rate")
    return sets.join(r, ["study_id", "member"], "left").groupBy(*KEY).agg(
        F.coalesce(F.avg("rate"), F.lit(0.0)).alias("set_detection_rate"))


def pair_counts(
    left: DataFrame,
    right: DataFrame | None = None,
    ids_per_block: int = 256,
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Shared members of every (left id, right id) pair that shares any.

    Inputs: (study_id, id, member), distinct. A member of few sets unfolds into its pairs. The rest go to blocks: ids are
    hashed into blocks and members into buckets; each (block, block, bucket) cell is one small matrix product, so a
    member that sits in very many sets never unfolds, and one huge set is spread over its member buckets. A member
    unfolds where that makes no more rows than its copies for the blocks would be, which grow with the number of ids. What
    is moved for it is one row of each of its ids with the list of partners, not a row of each pair.
    Without ``right`` the pairs are unordered, a < b.
    """
    mirrored = right is None

    def strings(df: DataFrame) -> DataFrame:
        return df.select("study_id", F.col("id").cast("string").alias("id"), F.col("member").cast("string").alias("member"))

    def lists(df: DataFrame, tag: str) -> DataFrame:
        """The ids of each member; the one shuffle of the rows, which all that follows shares."""
        return strings(df).where("study_id IS NOT NULL AND member IS NOT NULL").groupBy("study_id", "member").agg(
            F.sort_array(F.collect_list("id")).alias(f"_{tag}_ids"))

    def shape(df: DataFrame, tag: str) -> DataFrame:
        # count by id first: partial counts, and the block number needs only the number of ids
        per = df.select("study_id", F.explode(f"_{tag}_ids").alias("id")).groupBy("study_id", "id").agg(F.count(F.lit(1)).alias("_c"))
        return per.groupBy("study_id").agg(
            F.ceil(F.count(F.lit(1)) / ids_per_block).cast("int").alias("_blocks"), F.sum("_c").alias("_rows"))

    left_lists = lists(left, "l")
    if mirrored:
        plan = shape(left_lists, "l").select("study_id", F.col("_blocks").alias("_l_blocks"), F.col("_blocks").alias("_r_blocks"),
                                             (F.col("_rows") * 2).alias("_rows"))
        met = left_lists.withColumn("_r_ids", F.col("_l_ids"))
    else:
        right_lists = lists(right, "r")
        of_left = shape(left_lists, "l").select("study_id", F.col("_blocks").alias("_l_blocks"), F.col("_rows").alias("_l_rows"))
        of_right = shape(right_lists, "r").select("study_id", F.col("_blocks").alias("_r_blocks"), F.col("_rows").alias("_r_rows"))
        plan = of_left.join(of_right, "study_id").select(
            "study_id", "_l_blocks", "_r_blocks", (F.col("_l_rows") + F.col("_r_rows")).alias("_rows"))
        met = left_lists.join(right_lists, ["study_id", "member"])
    plan = plan.withColumn("_buckets", F.ceil(F.col("_rows") / rows_per_bucket).cast("int")).drop("_rows")
    lh, rh = F.size("_l_ids").cast("long"), F.size("_r_ids").cast("long")
    copies = lh * F.greatest("_r_blocks", F.lit(UNFOLD)) + rh * F.greatest("_l_blocks", F.lit(UNFOLD))
    met = met.join(plan, "study_id").withColumn("_few", lh * rh <= copies)

    # An id travels once with all its partners at a member; the pairs unfold where they are counted.
    few = met.where("_few").select("study_id", "_r_ids", F.posexplode("_l_ids").alias("_at", "a"))
    partners = F.slice("_r_ids", F.col("_at") + 2, F.size("_r_ids")) if mirrored else F.col("_r_ids")
    few = few.select("study_id", "a", partners.alias("_bs"), F.lit(1).cast("long").alias("n")).where(F.size("_bs") > 0)

    def side(ids: str) -> DataFrame:
        rows = met.where(~F.col("_few"))
        return rows.select("study_id", "member", "_l_blocks", "_r_blocks", "_buckets", F.explode(ids).alias("id"))

    def place(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.col(f"_{mine}_blocks")).cast("int")
        bucket = F.pmod(F.xxhash64("member"), F.col("_buckets")).cast("int")
        lo, hi = F.lit(0), F.col(f"_{theirs}_blocks") - 1
        if mirrored and mine == "l":
            lo = own
        if mirrored and mine == "r":
            hi = own
        return df.select(
            "study_id", bucket.alias("_bucket"), own.alias(f"_{mine}b"),
            F.explode(F.sequence(lo, hi)).alias(f"_{theirs}b"), "id", "member")

    cell = ["study_id", "_bucket", "_lb", "_rb"]
    lp, rp = place(side("_l_ids"), "l", "r"), place(side("_r_ids"), "r", "l").select(*cell, "id", "member")
    # New names on the right: a table may be grouped against itself.
    rcell = [f"r{c}" for c in cell]
    rp = rp.toDF(*rcell, "id", "member")

    def multiply(key, a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"study_id": [], "a": [], "b": [], "n": []}).astype(
                {"study_id": str, "a": str, "b": str, "n": "int64"})
        ai, an = pd.factorize(a["id"], sort=True)
        bi, bn = pd.factorize(b["id"], sort=True)
        members = pd.Index(a["member"]).intersection(b["member"]).unique()
        am, bm = members.get_indexer(a["member"]), members.get_indexer(b["member"])
        total = np.zeros((len(an), len(bn)), dtype=np.float64)
        step = 4096
        for lo in range(0, len(members), step):
            width = min(step, len(members) - lo)
            x = np.zeros((len(an), width), dtype=np.float32)
            y = np.zeros((len(bn), width), dtype=np.float32)
            in_a = (am >= lo) & (am < lo + width)
            in_b = (bm >= lo) & (bm < lo + width)
            x[ai[in_a], am[in_a] - lo] = 1
            y[bi[in_b], bm[in_b] - lo] = 1
            total += x @ y.T
        r, c = np.nonzero(total)
        out = pd.DataFrame({"a": np.asarray(an)[r], "b": np.asarray(bn)[c], "n": total[r, c].astype("int64")})
        if mirrored:
            if key[2] == key[3]:
                out = out[out["a"] < out["b"]]
            else:
                swap = out["a"] > out["b"]
                out.loc[swap, ["a", "b"]] = out.loc[swap, ["b", "a"]].to_numpy()
        out.insert(0, "study_id", str(key[0]))
        return out

    schema = "study_id string, a string, b string, n long"
    partial = lp.groupBy(*cell).cogroup(rp.groupBy(*rcell)).applyInPandas(multiply, schema)
    # Few bytes that unfold into many pairs: dealt over all tasks by the left id, and counted there.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.select("study_id", "a", F.array("b").alias("_bs"), "n").unionAll(few).repartition(tasks, "study_id", "a")
    return dealt.select("study_id", "a", F.explode("_bs").alias("b"), "n").groupBy("study_id", "a", "b").agg(F.sum("n").alias("n"))

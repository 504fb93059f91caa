"""Interval joins on closed intervals ``(chrom, start, end)``.

Each interval belongs to the level whose bins are at least as wide as it is long, so it
touches at most two bins there. A pair meets at the larger of the two levels: one side is
at home on it, the other side visits it. An interval is therefore copied at most twice per
level, however long it is, and no pair is produced twice because it is kept only in the
bin that holds the larger of the two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import range_scan

# Bin widths 64, 512, 4096, ... (64 * 8^level); eleven levels reach beyond 6e10.
LEVELS = 11
_WIDTHS = [64 * 8**i for i in range(LEVELS)]


def _level(start: Column, end: Column) -> Column:
    length = end - start + 1
    out = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        out = F.when(length <= _WIDTHS[i], i).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in _WIDTHS]), level + 1)


def _spread(side: DataFrame, tag: str, other_levels: Column) -> DataFrame:
    """One row per (level, bin) where the interval can meet the other side."""
    s, e, home = F.col(f"{tag}_start"), F.col(f"{tag}_end"), F.col(f"{tag}_level")
    levelled = side.withColumn("_others", other_levels).withColumn(
        "_level",
        F.explode(
            F.array_union(F.array(home), F.filter("_others", lambda x: x > home))
        ),
    ).drop("_others")
    w = _width(F.col("_level"))
    return levelled.withColumn("_bin", F.explode(F.sequence(F.floor(s / w), F.floor(e / w)))).withColumn(
        f"{tag}_bin_start", F.col("_bin") * w)


def _side(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """Distinct intervals with the payloads of all rows that have them."""
    named = df.select(
        *keys,
        F.col("start").cast("long").alias(f"{tag}_start"),
        F.col("end").cast("long").alias(f"{tag}_end"),
        F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in (*keys, "start", "end")]).alias("_row"),
    ).where(F.col(f"{tag}_start") <= F.col(f"{tag}_end"))
    places = named.groupBy(*keys, f"{tag}_start", f"{tag}_end").agg(F.collect_list("_row").alias(f"_{tag}_rows"))
    return places.withColumn(f"{tag}_level", _level(F.col(f"{tag}_start"), F.col(f"{tag}_end")))


def overlap_join(
    a: DataFrame, b: DataFrame, keys: list[str] | None = None, tags: tuple[str, str] = ("a", "b")
) -> DataFrame:
    """All overlapping pairs. Payload columns come back prefixed with the two tags.

    The equi-join key is (keys, level, bin, channel); a crowded bin is split at run time by the
    adaptive skew-join rule. Rows with start > end never match. Rows with one interval travel and meet
    as one row, and unfold into their pairs after the join.
    """
    keys = keys or ["chrom"]
    ta, tb = tags
    payloads = [[f"{t}_{c}" for c in df.columns if c not in (*keys, "start", "end")] for df, t in ((a, ta), (b, tb))]
    left, right = _side(a, ta, keys), _side(b, tb, keys)
    # At most LEVELS values each: the scalar sub-queries are bounded by a constant.
    levels_a = left.agg(F.collect_set(f"{ta}_level")).scalar()
    levels_b = right.agg(F.collect_set(f"{tb}_level")).scalar()
    la = _spread(left, ta, levels_b)
    lb = _spread(right, tb, levels_a).drop(f"{tb}_bin_start")
    # Two visitors never need to meet. Channel 1 holds the left rows at home, channel 2 the
    # left visitors; right rows at home are in both, right visitors only in the first.
    home_a, home_b = F.col(f"{ta}_level") == F.col("_level"), F.col(f"{tb}_level") == F.col("_level")
    la = la.withColumn("_channel", F.when(home_a, 1).otherwise(2))
    both, one = F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))
    lb = lb.withColumn("_channel", F.explode(F.when(home_b, both).otherwise(one)))
    joined = la.join(lb, [*keys, "_level", "_bin", "_channel"])
    later = F.greatest(f"{ta}_start", f"{tb}_start")
    # A common bin cannot end before the later start, so the pair belongs to this bin unless
    # the later start lies before it.
    once = later >= F.col(f"{ta}_bin_start")
    touch = (F.col(f"{ta}_start") <= F.col(f"{tb}_end")) & (F.col(f"{tb}_start") <= F.col(f"{ta}_end"))
    met = joined.where(touch & once)
    for tag in tags:
        met = met.withColumn(f"_{tag}", F.explode(f"_{tag}_rows"))
    return met.select(*keys, *[c for tag, more in zip(tags, payloads, strict=True) for c in (
        f"{tag}_start", f"{tag}_end", *[F.col(f"_{tag}.{m}") for m in more])])


def count_overlaps(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, id, n``: how many intervals of ``b`` overlap each id of ``a`` (needs ``id``; rows of one id add up).

    No pair is formed: the overlaps of [s, e] are the starts up to e less the ends before s, both from one ordered scan over
    starts, ends and questions. A crowded locus costs its rows, not their product. Rows with start > end never match;
    ids without a valid interval are left out.
    """
    keys = keys or ["chrom"]
    valid = F.col("start").cast("long") <= F.col("end").cast("long")
    zero = F.lit(0).cast("long")

    def marks(side: DataFrame, at: str, turn: int, starts, ends, name) -> DataFrame:
        return side.select(*keys, F.col(at).cast("long").alias("_x"), F.lit(turn).alias("_turn"), name.alias("id"),
                           starts.alias("_starts"), ends.alias("_ends"))

    mine, theirs, count = a.where(valid), b.where(valid), F.count(F.lit(1)).alias("_c")
    none = F.lit(None).cast(a.schema["id"].dataType)
    # Equal starts and equal ends are one mark each. At one coordinate: lower questions, starts, ends, upper questions.
    every = marks(mine, "start", 0, zero, zero, F.col("id")).unionAll(
        marks(theirs.groupBy(*keys, "start").agg(count), "start", 1, F.col("_c"), zero, none)).unionAll(
        marks(theirs.groupBy(*keys, "end").agg(count), "end", 2, zero, F.col("_c"), none)).unionAll(
        marks(mine, "end", 3, zero, zero, F.col("id")))
    asked = range_scan(every, keys, ["_x", "_turn", "id"], ["_starts", "_ends"]).where(F.col("_turn").isin(0, 3)).select(
        *keys, "id", F.when(F.col("_turn") == 3, F.col("_starts")).otherwise(-F.col("_ends")).alias("_v"))
    return asked.groupBy(*keys, "id").agg(F.sum("_v").alias("n"))


def overlapping_ids(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, id`` of ``a`` that overlap at least one interval of ``b``, without forming pairs."""
    return count_overlaps(a, b, keys).where("n > 0").drop("n")


def saf_overlaps(enhancers: DataFrame, annotation: DataFrame) -> DataFrame:
    """All overlapping pairs of two SAF tables (GeneID, Chr, Start, End) with both sides' columns."""

    def norm(df: DataFrame) -> DataFrame:
        missing = {"Chr", "Start", "End", "GeneID"} - set(df.columns)
        if missing:
            raise ValueError(f"SAF table is missing columns: {sorted(missing)}")
        return df.select(
            F.col("Chr").alias("chrom"), F.col("Start").cast("long").alias("start"),
            F.col("End").cast("long").alias("end"), F.col("GeneID").alias("id"),
        )

    j = overlap_join(norm(enhancers), norm(annotation))
    return j.select(
        F.col("a_id").alias("EnhancerID"), F.col("b_id").alias("GeneHancerID"),
        F.col("chrom").alias("EnhancerChr"), F.col("a_start").alias("EnhancerStart"),
        F.col("a_end").alias("EnhancerEnd"), F.col("chrom").alias("GeneHancerChr"),
        F.col("b_start").alias("GeneHancerStart"), F.col("b_end").alias("GeneHancerEnd"),
    )


# Blocks of 1, 4, 16, ... coordinates; aligned blocks up to 4^17 cover any locus.
_BLOCKS = [4**i for i in range(18)]


def _holding(x: Column, longest: Column) -> Column:
    """The aligned blocks that hold a coordinate, one per level whose blocks are not longer than ``longest``."""
    every = F.array(*[F.struct(F.lit(i).alias("l"), F.floor(x / w).cast("long").alias("n")) for i, w in enumerate(_BLOCKS)])
    return F.filter(every, lambda b: F.pow(F.lit(4.0), b["l"]) <= longest)


def _tagged(numbers: Column, level: int) -> Column:
    return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("l"), n.alias("n")))


def _covering(start: Column, end: Column) -> Column:
    """The fewest aligned blocks that together are [start, end]: at most six per level, the largest inside, small ones at the ends."""
    none = F.array().cast("array<bigint>")
    parts = []
    for i, w in enumerate(_BLOCKS):
        low, high = F.ceil(start / w).cast("long"), (F.floor((end + 1) / w) - 1).cast("long")
        whole = F.when(low <= high, F.sequence(low, high)).otherwise(none)
        if i + 1 < len(_BLOCKS):
            up = _BLOCKS[i + 1]
            left = F.ceil(start / up).cast("long") * 4
            right = F.floor((end + 1) / up).cast("long") * 4
            ends = F.concat(F.when(low < left, F.sequence(low, left - 1)).otherwise(none),
                            F.when(right <= high, F.sequence(right, high)).otherwise(none))
            whole = F.when(left < right, ends).otherwise(whole)
        parts.append(_tagged(whole, i))
    return F.concat(*parts)


def first_overlap(loci: DataFrame, annotation: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each locus with the first annotation row (smallest ``ord``, then ``id``) it overlaps; others drop out.

    Needs ``id`` on both sides and ``ord`` on the annotation. No pair is formed: what overlaps [s, e] starts inside of it or
    holds s. For both, one side is cut into aligned blocks, the other looks up the blocks that hold its coordinate, and the
    first row of each block is known beforehand. Equal places are asked once.
    """
    keys = keys or ["chrom"]
    at = [*keys, "start", "end"]

    def long_ends(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *more).where("start <= end")

    named = long_ends(loci, "id").distinct()
    asked = named.select(*at).distinct()
    known = long_ends(annotation, "id", "ord").groupBy(*at).agg(F.min(F.struct("ord", "id")).alias("_first"))
    length = F.coalesce(F.max(F.col("end") - F.col("start") + 1), F.lit(0))
    of_asked, of_known = asked.agg(length).scalar(), known.agg(length).scalar()
    s, e = F.col("start"), F.col("end")

    def blocks(df: DataFrame, starts_inside: Column, holds_start: Column, *rest: str) -> DataFrame:
        inside = F.transform(starts_inside, lambda b: F.struct(F.lit(0).alias("k"), b["l"].alias("l"), b["n"].alias("n")))
        holds = F.transform(holds_start, lambda b: F.struct(F.lit(1).alias("k"), b["l"].alias("l"), b["n"].alias("n")))
        return df.select(*keys, *rest, F.explode(F.concat(inside, holds)).alias("_b")).select(
            *keys, *rest, F.col("_b.k").alias("_kind"), F.col("_b.l").alias("_level"), F.col("_b.n").alias("_block"))

    block = [*keys, "_kind", "_level", "_block"]
    answers = blocks(known.withColumn("_longest", of_asked), _holding(s, F.col("_longest")), _covering(s, e), "_first").groupBy(
        *block).agg(F.min("_first").alias("_first"))
    questions = blocks(asked.withColumn("_longest", of_known), _covering(s, e), _holding(s, F.col("_longest")), "start", "end")
    found = questions.join(answers, block).groupBy(*at).agg(F.min("_first").alias("_first"))
    return named.join(found, at).select(*keys, "id", "start", "end", F.col("_first.id").alias("mapped_id"))


def exclude_overlaps(
    annotation: DataFrame, exons: DataFrame, extend_bp: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """Annotation rows that touch no exon widened by ``extend_bp`` (floored at 0)."""
    keys = keys or ["chrom"]
    wide = exons.select(
        *keys,
        F.greatest(F.lit(0), F.col("start") - extend_bp).alias("start"),
        (F.col("end") + extend_bp).alias("end"),
    )
    slim = annotation.select(*keys, "start", "end", "id")
    hit = overlapping_ids(slim, wide, keys)
    return annotation.join(hit, [*keys, "id"], "left_anti")


def filter_annotation(
    annotation: DataFrame,
    exons: DataFrame | None,
    extend_bp: int = 0,
    drop_promoters: bool = True,
    type_col: str = "regulatory_element_type",
) -> DataFrame:
    """Exon anti-join, then the case-insensitive promoter filter."""
    out = annotation
    if drop_promoters:
        out = out.where(~F.coalesce(F.col(type_col), F.lit("")).rlike("(?i)promoter"))
    if exons is not None:
        out = exclude_overlaps(out, exons, extend_bp)
    return out


# Neighbouring places that share one row of annotation.
TILE = 64


def _lists_of_points(points: DataFrame, annotation: DataFrame, keys: list[str], sep: str | None) -> DataFrame:
    """``keys, input_id, annotation_ids`` of inputs with one place each: sorted, or joined by ``sep``. No pair is moved.

    Distinct places are numbered in order, so an interval covers a run of numbers. Intervals travel to the tiles of
    ``TILE`` numbers that their run touches, once with all that share it; each place then picks its own from its tile.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    held = points.groupBy(*keys, "start").agg(F.collect_list("id").alias("_inputs"))
    known = annotation.where("start <= end")
    runs = known.select(*keys, "start", "end").distinct()
    # At one coordinate: starts (places before them), places, ends (places up to them).
    marks = runs.select(*keys, F.col("start").alias("_x"), F.lit(0).alias("_turn"), "start", "end", zero.alias("_n")).unionAll(
        points.select(*keys, F.col("start").alias("_x")).distinct().select(
            *keys, "_x", F.lit(1).alias("_turn"), none.alias("start"), none.alias("end"), F.lit(1).cast("long").alias("_n"))).unionAll(
        runs.select(*keys, F.col("end").alias("_x"), F.lit(2).alias("_turn"), "start", "end", zero.alias("_n")))
    ranked = range_scan(marks, keys, ["_x", "_turn", "start", "end"], ["_n"])
    places = ranked.where("_turn = 1").select(*keys, F.col("_x").alias("start"), (F.col("_n") - 1).alias("_at"))
    covered = ranked.where("_turn <> 1").groupBy(*keys, "start", "end").agg(
        F.max(F.when(F.col("_turn") == 0, F.col("_n"))).alias("_lo"),
        F.max(F.when(F.col("_turn") == 2, F.col("_n") - 1)).alias("_hi")).where("_lo <= _hi")
    tile = F.explode(F.sequence(F.floor(F.col("_lo") / TILE), F.floor(F.col("_hi") / TILE)))
    tiles = known.join(covered, [*keys, "start", "end"]).groupBy(*keys, "_lo", "_hi").agg(
        F.collect_list("id").alias("_ids")).withColumn("_tile", tile).groupBy(*keys, "_tile").agg(
        F.collect_list(F.struct("_lo", "_hi", "_ids")).alias("_known"))
    # Few bytes that unfold into many: dealt over all tasks, as adaptive merging goes by the bytes.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = held.join(places, [*keys, "start"]).withColumn("_tile", F.floor(F.col("_at") / TILE)).repartition(tasks, *keys, "_tile")
    mine = F.filter("_known", lambda k: (k["_lo"] <= F.col("_at")) & (F.col("_at") <= k["_hi"]))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(mine, lambda k: k["_ids"]))))
    # A list of at most one list: each is made once, and places without an interval drop out.
    found = asked.join(tiles, [*keys, "_tile"]).select(
        *keys, "_inputs", F.explode(F.filter(F.array(ids), lambda v: F.size(v) > 0)).alias("annotation_ids"))
    if sep is not None:
        found = found.withColumn("annotation_ids", F.array_join("annotation_ids", sep))
    return found.select(*keys, F.explode("_inputs").alias("input_id"), "annotation_ids")


def _points_and_rest(points: DataFrame, annotation: DataFrame, keys: list[str]):
    """Inputs with one place of one coordinate, the other inputs (None: there are none), and the annotation."""
    extra = [k for k in keys if k != "chrom"]

    def slim(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "id")

    points, annotation = slim(points), slim(annotation)
    many = points.groupBy(*extra, "id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    plain = F.col("id").isNotNull() & (F.col("start") == F.col("end"))
    if annotation.where("id IS NULL").head(1):
        return None, points, annotation
    repeated = bool(many.head(1))
    single = points.join(many, [*extra, "id"], "left_anti").select(*points.columns) if repeated else points
    rest = None
    if repeated or points.where(~F.coalesce(plain, F.lit(False))).head(1):
        rest = single.where(~F.coalesce(plain, F.lit(False)))
        rest = rest.unionAll(points.join(many, [*extra, "id"], "left_semi").select(*points.columns)) if repeated else rest
    return single.where(plain), rest, annotation


def _mapped_pairs(points: DataFrame, annotation: DataFrame, keys: list[str]) -> DataFrame:
    extra = [k for k in keys if k != "chrom"]
    hits = overlap_join(points, annotation, keys)
    return hits.select(*extra, F.col("a_id").alias("input_id"), F.col("b_id").alias("annotation_id")).distinct()


def map_points(points: DataFrame, annotation: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct (input_id, annotation id) pairs of inputs lying on annotation intervals.

    Inputs of one coordinate each unfold the list of their place, so their pairs are never moved nor compared; only the
    pairs of inputs with several rows or a longer range are made distinct.
    """
    keys = keys or ["chrom"]
    extra = [k for k in keys if k != "chrom"]
    single, rest, known = _points_and_rest(points, annotation, keys)
    if single is None:
        return _mapped_pairs(rest, known, keys)
    pairs = _lists_of_points(single, known, keys, None).select(
        *extra, "input_id", F.explode("annotation_ids").alias("annotation_id"))
    return pairs if rest is None else pairs.unionAll(_mapped_pairs(rest, known, keys))


def annotations_by_point(
    points: DataFrame, annotation: DataFrame, keys: list[str] | None = None, sep: str | None = None
) -> DataFrame:
    """One row per input with its sorted annotation ids, as ``mapping_by_input`` of ``map_points`` gives them.

    The list of a place is made once, whatever the number of inputs there; with ``sep`` it is a text.
    """
    keys = keys or ["chrom"]
    extra = [k for k in keys if k != "chrom"]
    single, rest, known = _points_and_rest(points, annotation, keys)
    out = None if single is None else _lists_of_points(single, known, keys, sep).select(*extra, "input_id", "annotation_ids")
    if rest is None:
        return out
    other = mapping_by_input(_mapped_pairs(rest, known, keys), extra)
    if sep is not None:
        other = other.withColumn("annotation_ids", F.array_join("annotation_ids", sep))
    return other if out is None else out.unionAll(other)


def mapping_by_input(mapping: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per input with its sorted annotation ids."""
    keys = keys or []
    return mapping.groupBy(*keys, "input_id").agg(
        F.array_sort(F.collect_list("annotation_id")).alias("annotation_ids"))


def lookup_variants(rsids: DataFrame, variants: DataFrame) -> DataFrame:
    """rsID -> position through a variant table (rsid, chrom, pos).

    If any matched position is 0 the table is taken as 0-based and every row moves up by one.
    """
    hit = rsids.select(F.col("rsid")).distinct().join(variants, "rsid").select(
        "rsid", "chrom", F.col("pos").cast("long").alias("pos"))
    shift = hit.agg(F.coalesce(F.max((F.col("pos") == 0).cast("int")), F.lit(0))).scalar()
    return hit.withColumn("_shift", shift).select(
        "rsid", "chrom", (F.col("pos") + F.col("_shift")).alias("start"),
        (F.col("pos") + F.col("_shift")).alias("end"),
        F.col("rsid").alias("id"),
    ).where(F.col("start").isNotNull())


def union_length(exons: DataFrame, keys: list[str]) -> DataFrame:
    """Covered length of each feature: where its depth leaves zero is subtracted, where it comes back to zero is added.

    Keys usually are (gene_id); a feature on two chromosomes is counted on both. The depth is one ordered scan over starts
    and ends, so that a feature may have any share of the intervals. Rows with start > end cover nothing.
    """
    at = [*keys, "chrom"]
    valid = exons.where(F.col("start") <= F.col("end"))
    marks = valid.select(*at, F.explode(F.array(
        F.struct(F.col("start").cast("long").alias("x"), F.lit(1).cast("long").alias("d")),
        F.struct((F.col("end") + 1).cast("long").alias("x"), F.lit(-1).cast("long").alias("d")))).alias("m"))
    steps = marks.groupBy(*at, F.col("m.x").alias("_x")).agg(F.sum("m.d").alias("_d")).where("_d <> 0")
    depth = range_scan(steps.withColumn("_depth", F.col("_d")), at, ["_x"], ["_depth"])
    edge = F.when(F.col("_depth") == 0, F.col("_x")).when(F.col("_depth") == F.col("_d"), -F.col("_x")).otherwise(0)
    return depth.groupBy(*keys).agg(F.sum(edge).alias("length"))


def count_reads(
    reads: DataFrame, features: DataFrame, stranded: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Reads per (sample, feature) and the assignment status table.

    ``reads``: sample_id, read_id, chrom, start, end, strand; ``features``: chrom, start,
    end, feature_id, strand. A read counts only if it meets exactly one feature.
    ``stranded`` 0 ignores the strand, 1 wants the same strand, 2 the opposite one.
    """
    hits = overlap_join(reads, features, ["chrom"], ("r", "f"))
    if stranded == 1:
        hits = hits.where(F.col("r_strand") == F.col("f_strand"))
    elif stranded == 2:
        hits = hits.where(F.col("r_strand") != F.col("f_strand"))
    per_read = hits.groupBy("r_sample_id", "r_read_id").agg(
        F.min("f_feature_id").alias("feature_id"), F.max("f_feature_id").alias("_last")
    ).select(
        F.col("r_sample_id").alias("sample_id"), F.col("r_read_id").alias("read_id"), "feature_id",
        (F.col("feature_id") == F.col("_last")).alias("_single"),
    )
    counts = per_read.where("_single").groupBy("sample_id", "feature_id").agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    # Every read carries one status; reads without a hit are the difference to the total.
    total = reads.select("sample_id", "read_id").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("_all"))
    met = per_read.groupBy("sample_id").agg(
        F.count_if("_single").alias("_one"), F.count_if(~F.col("_single")).alias("_many"))
    wide = total.join(met, "sample_id", "left").select(
        "sample_id",
        F.coalesce("_one", F.lit(0)).alias("Assigned"),
        F.coalesce("_many", F.lit(0)).alias("Unassigned_Ambiguity"),
        (F.col("_all") - F.coalesce("_one", F.lit(0)) - F.coalesce("_many", F.lit(0))).alias("Unassigned_NoFeatures"),
    )
    status = wide.unpivot(
        ["sample_id"], ["Assigned", "Unassigned_Ambiguity", "Unassigned_NoFeatures"], "status", "reads")
    return counts, status

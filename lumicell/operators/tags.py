"""Antibody, hashtag and guide counts: codes and names, correction of molecules, normalisation, calls, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import poisson_tail, ratio
from .reads import hamming_neighbours

# codes and names


def decode_bases(code: Column, length: int) -> Column:
    """Sequence of a 2-bit code."""
    base = lambda i: F.substring(F.lit("ACGT"), F.shiftrightunsigned(code, 2 * (length - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return F.concat(*[base(i) for i in range(length)])


def fill_unknown(sequence: Column) -> Column:
    """The four sequences that one with exactly one letter besides A, C, G and T can be; null for others."""
    bad = F.regexp_replace(sequence, "[ACGT]", "")
    return F.when(F.length(bad) == 1, F.array(*[F.regexp_replace(sequence, "[^ACGT]", b) for b in "ACGT"]))


def translate(codes: DataFrame, table: DataFrame) -> DataFrame:
    """Codes by a translation table (code, other); those it lacks stay, with translated false."""
    x = codes.join(table.select("code", "other"), "code", "left")
    return x.withColumn("translated", F.col("other").isNotNull()).withColumn("other", F.coalesce("other", "code"))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTN", "TGCAN"))


def feature_kind(name: Column) -> Column:
    """hashtag, isotype or antibody by the words of a feature's name."""
    n = F.lower(name)
    hashtag = n.contains("hashtag") | n.startswith("hto") | F.array_contains(F.split(n, "_"), "hto")
    isotype = n.contains("isotype") | (n.contains("igg") & n.contains("ctrl")) | n.contains("negctr") | n.contains("neg_ctr") | n.contains("negative control")
    return F.when(hashtag, "hashtag").when(isotype, "isotype").otherwise("antibody")


# fixed values: words that name guides without a target
_NO_TARGET_WORDS = ("non-targeting", "nontargeting", "non_targeting", "negative_control", "neg_ctrl", "nt_", "scramble", "ntc")
_NO_TARGETS = ("", "non-targeting", "nontargeting", "non_targeting", "nt", "ntc", "nan", "none", "control", "negative", "na")


def guide_kind(name: Column, target: Column) -> Column:
    """safe-targeting, non-targeting or targeting by a guide's name and target."""
    s = F.lower(F.concat_ws(" ", name, target))
    safe = s.contains("safe") & s.contains("target")
    named = F.lit(False)
    for word in _NO_TARGET_WORDS:
        named = named | s.contains(word)
    return F.when(safe, "safe-targeting").when(named | F.lower(F.trim(F.coalesce(target, F.lit("")))).isin(*_NO_TARGETS), "non-targeting").otherwise("targeting")


def window_before(sequence: Column, anchors: str, length: int) -> Column:
    """The `length` letters before the first place of an anchor that has as many before it; anchors, apart by |, are tried in turn."""
    found = [F.when(F.instr(sequence, a) > length, F.substring(sequence, F.instr(sequence, a) - length, F.lit(length))) for a in anchors.split("|")]
    return F.coalesce(*found)


def window_at(sequence: Column, offset: int, length: int) -> Column:
    return F.when(F.length(sequence) >= offset + length, F.substring(sequence, offset + 1, length))


def offset_shares(reads: DataFrame, panel: DataFrame, offsets: range) -> DataFrame:
    """Share of reads (sequence) whose letters at an offset are a panel sequence of the panel's most common length."""
    lengths = panel.groupBy(F.length("sequence").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    length = lengths.orderBy(F.desc("n"), "l").first()["l"]
    known = F.broadcast(panel.where(F.length("sequence") == length).select(F.col("sequence").alias("w")).distinct())
    x = reads.select(F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), window_at(F.col("sequence"), o, length).alias("w")) for o in offsets])).alias("x")).select("x.*")
    return x.join(known.withColumn("hit", F.lit(1.0)), "w", "left").groupBy("offset").agg((F.sum(F.coalesce("hit", F.lit(0.0))) / F.count(F.lit(1))).alias("share"))


def unmatched_class(sequence: Column, panel: list[str]) -> Column:
    """low_complexity (one letter in four fifths), shifted (a panel sequence moved by one place) or other."""
    most = F.greatest(*[F.length(sequence) - F.length(F.replace(sequence, F.lit(b))) for b in "ACGTN"])
    shifted = F.lit(False)
    for p in panel:
        n = F.least(F.lit(len(p)), F.length(sequence))
        part = lambda s, a, b: F.substring(s, a, b)
        shifted = shifted | (part(sequence, F.lit(2), n - 1) == part(F.lit(p), F.lit(1), n - 1)) | (part(sequence, F.lit(1), n - 1) == part(F.lit(p), F.lit(2), n - 1))
    return F.when(most >= 0.8 * F.length(sequence), "low_complexity").when(shifted, "shifted").otherwise("other")


def correct_molecules(molecules: DataFrame, length: int) -> DataFrame:
    """(grp, umi, reads) with the umi each moves to: of its group's codes one base away and itself that with most reads, ties to the larger code."""
    x = molecules.select("grp", "umi", "reads")
    near = x.select("grp", F.col("umi").alias("own"), F.explode(hamming_neighbours(F.col("umi"), length)).alias("umi")).join(x, ["grp", "umi"])
    best = near.groupBy("grp", F.col("own").alias("umi")).agg(F.max(F.struct("reads", F.col("umi").alias("target"))).alias("b"))
    out = x.join(best, ["grp", "umi"], "left")
    better = (F.col("b.reads") > F.col("reads")) | ((F.col("b.reads") == F.col("reads")) & (F.col("b.target") > F.col("umi")))
    return out.select("grp", "umi", "reads", F.when(better, F.col("b.target")).otherwise(F.col("umi")).alias("target"))


# normalisation and calls


def clr(counts: DataFrame, n_features: int) -> DataFrame:
    """Centred log ratio of (cell, feature, n): log1p of counts over the cell's geometric mean of 1 + count; absent features stay 0."""
    mean = F.exp(F.sum(F.log1p("n")).over(Window.partitionBy("cell")) / n_features)
    return counts.select("cell", "feature", F.log1p(F.col("n") / mean).alias("clr"))


def empty_droplets(totals: DataFrame, min_total: int = 1, max_quantile: float = 0.99) -> DataFrame:
    """Uncalled cells of (cell, total, called) that can serve as background: between min_total and the upper quantile of
    the uncalled, but not over the called cells' lowest twentieth; all candidates if there are fewer than 50."""
    candidate = ~F.col("called") & (F.col("total") >= min_total)
    t = totals.agg(
        F.count_if(candidate).alias("n"), F.expr(f"percentile(case when not called and total >= {min_total} then total end, {max_quantile})").alias("hi"), F.expr("percentile(case when called then total end, 0.05)").alias("lo")
    )
    x = totals.where(candidate).join(F.broadcast(t))
    return x.where((F.col("n") < 50) | (F.col("total") <= F.least("hi", "lo"))).select("cell", "total")


def background_z(cells: DataFrame, empties: DataFrame, counts: DataFrame, pseudo: float = 10.0) -> DataFrame:
    """(cell, feature, z) of all cells and features: log counts against the background droplets' mean and deviation."""
    low = F.log(F.lit(pseudo))
    n = empties.agg(F.count(F.lit(1)).alias("n"))
    v = F.log(F.col("n") + pseudo) - low
    features = counts.select("feature").distinct()
    s = counts.join(empties.select("cell"), "cell", "left_semi").groupBy("feature").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("e")) / (F.col("e") - 1))
    back = features.join(s, "feature", "left").fillna(0.0).join(F.broadcast(n.withColumnRenamed("n", "e")))
    back = back.select("feature", (F.col("s1") / F.col("e") + low).alias("mu"), F.when(F.col("e") > 1, F.when(sd > 1e-9, sd).otherwise(1.0)).otherwise(1.0).alias("sd"))
    listed = back.agg(F.collect_list(F.struct("feature", "mu", "sd")).alias("_f"))  # one row: features are a panel
    x = cells.select("cell").join(F.broadcast(listed)).select("cell", F.inline("_f")).join(counts, ["cell", "feature"], "left")
    return x.select("cell", "feature", ((F.log(F.coalesce("n", F.lit(0)) + pseudo) - F.col("mu")) / F.col("sd")).alias("z"))


def hashed_drops(cells: DataFrame, counts: DataFrame, ambient: DataFrame, confident_min: float = 2.0, doublet_min: float = 2.0, n_mads: float = 3.0, pseudo: float = 5.0) -> DataFrame:
    """Calls of cells from hashtag counts (cell, tag, n) and the tags' ambient counts (tag, n).

    Counts are taken over the ambient share.  A doublet's second tag stands out
    of the median of the others, by doublet_min and by n_mads deviations over
    the cells' median; a confident cell's first tag stands out of the second.
    """
    tags = ambient.agg(F.sum(F.col("n") + 1e-9).alias("all"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("tag", F.col("n").alias("a"))).alias("_t"))  # one row: tags are a panel
    x = cells.select("cell").join(F.broadcast(tags)).select("cell", "all", "k", F.inline("_t")).join(counts, ["cell", "tag"], "left")
    adj = F.coalesce("n", F.lit(0)) / ((F.col("a") + 1e-9) / F.col("all") * F.col("k"))
    x = x.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct((-F.round(adj, 9)).alias("v"), "tag"))).alias("o"))
    at = lambda i: F.coalesce(-F.get("o", F.lit(i))["v"], F.lit(0.0))
    rest = F.transform(F.slice("o", 3, 100_000), lambda s: -s["v"])
    m = F.size(rest)
    half = lambda i: F.get(rest, i.cast("int"))
    median = F.when(m == 0, 0.0).otherwise((half(F.floor((m - 1) / 2)) + half(F.floor(m / 2))) / 2)  # sorted already
    x = x.select("cell", F.get("o", F.lit(0))["tag"].alias("tag"), F.log2((at(0) + pseudo) / (at(1) + pseudo)).alias("lfc_top"), F.log2((at(1) + pseudo) / (median + pseudo)).alias("lfc_second"))

    def spread(df: DataFrame, c: str) -> DataFrame:
        md = df.agg(F.median(c).alias("_md"))
        return F.broadcast(df.join(F.broadcast(md)).agg(F.max("_md").alias(f"{c}_md"), (1.4826 * F.median(F.abs(F.col(c) - F.col("_md")))).alias(f"{c}_mad")))

    x = x.join(spread(x, "lfc_second"))
    x = x.withColumn("doublet", (F.col("lfc_second") > F.col("lfc_second_md") + n_mads * F.col("lfc_second_mad")) & (F.col("lfc_second") >= doublet_min))
    x = x.join(spread(x.where("not doublet"), "lfc_top"))
    confident = (F.col("lfc_top") >= confident_min) & (F.col("lfc_top") >= F.coalesce("lfc_top_md", F.lit(0.0)) - n_mads * F.coalesce("lfc_top_mad", F.lit(0.0)))
    return x.select("cell", F.when(F.col("doublet"), "doublet").when(confident, F.col("tag")).otherwise("negative").alias("call"), "lfc_top", "lfc_second")


def ambient_profile(totals: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """Shares (guide, p) of ambient counts (guide, n), `pseudo` added to each."""
    t = totals.agg((F.sum("n") + F.count(F.lit(1)) * pseudo).alias("t"))
    return totals.join(F.broadcast(t)).select("guide", ((F.col("n") + pseudo) / F.col("t")).alias("p"))


def ambient_load(totals: DataFrame, q: float = 0.95) -> DataFrame:
    """One row: the quantile of empty droplets' totals (total), 0 without any."""
    return totals.agg(F.coalesce(F.expr(f"percentile(total, {q})"), F.lit(0.0)).alias("load"))


def call_guides(counts: DataFrame, profile: DataFrame, load: float = 0.0, min_umis: int = 3, alpha: float = 0.001, min_share: float = 0.05, top: int = 2) -> DataFrame:
    """Guides of each cell (cell, guide, n) over what ambient molecules explain: a Poisson test for each.

    A cell's ambient load is what its guides beyond the `top` largest show, the
    tested one left out, over their share of the profile, and at least `load`.
    """
    order = Window.partitionBy("cell").orderBy(F.desc("n"), "guide")
    cell = Window.partitionBy("cell")
    x = counts.join(F.broadcast(profile), "guide").withColumn("rest", F.row_number().over(order) > top)
    own, own_p = F.when(F.col("rest"), F.col("n")).otherwise(0.0), F.when(F.col("rest"), F.col("p")).otherwise(0.0)
    x = x.withColumns({"tot": F.sum("n").over(cell), "umis": F.sum(own).over(cell) - own, "share": F.sum(own_p).over(cell) - own_p})
    mean = F.greatest(F.lit(1e-12), F.greatest(F.lit(float(load)), F.when(F.col("share") > 0.05, F.col("umis") / F.col("share")).otherwise(0.0)) * F.col("p"))
    x = x.join(F.broadcast(profile.agg(F.count(F.lit(1)).alias("_g"))))
    tested = x.where((F.col("n") >= min_umis) & (F.col("n") >= min_share * F.col("tot")))
    return tested.where(poisson_tail(F.col("n").cast("double"), mean) < alpha / F.col("_g")).select("cell", "guide", "n")


def guide_labels(cells: DataFrame, called: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """n_guides, guide_ids and targets (sorted, apart by |) and class of every cell."""
    x = called.join(F.broadcast(targets), "guide", "left") if targets is not None else called.withColumn("target", F.lit(None).cast("string"))
    x = x.groupBy("cell").agg(F.count(F.lit(1)).alias("n_guides"), F.concat_ws("|", F.transform(F.sort_array(F.collect_list("guide")), lambda g: g.cast("string"))).alias("guide_ids"), F.concat_ws("|", F.sort_array(F.collect_set("target"))).alias("target"))
    x = cells.select("cell").join(x, "cell", "left").fillna(0, ["n_guides"]).fillna("", ["guide_ids", "target"])
    return x.withColumn("class", F.when(F.col("n_guides") == 0, "unassigned").when(F.col("n_guides") == 1, "single").otherwise("multiple"))


def agreement(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: cells, single calls of both, and recall, precision and F1 of equal single calls."""
    x = ours.select("cell", F.col("class").alias("c"), F.col("guide_ids").alias("g")).join(reference.select("cell", F.col("class").alias("rc"), F.col("guide_ids").alias("rg")), "cell")
    a, b = F.col("c") == "single", F.col("rc") == "single"
    x = x.agg(F.count(F.lit(1)).alias("cells"), F.count_if(b).alias("ref_single"), F.count_if(a).alias("ours_single"), F.count_if(a & b & (F.col("g") == F.col("rg"))).alias("_same"))
    recall, precision = F.col("_same") / F.greatest(F.lit(1), F.col("ref_single")), F.col("_same") / F.greatest(F.lit(1), F.col("ours_single"))
    x = x.withColumns({"recall_single": recall, "precision_single": precision}).drop("_same")
    return x.withColumn("f1_single", F.coalesce(ratio(2 * F.col("recall_single") * F.col("precision_single"), F.col("recall_single") + F.col("precision_single")), F.lit(0.0)))


def knockdown(labels: DataFrame, targets: DataFrame, counts: DataFrame, controls: DataFrame, min_cells: int = 5) -> DataFrame:
    """1 - mean of the target gene in a guide's single cells over its mean in control cells.

    targets is (guide_ids, gene); guides with fewer than min_cells cells, or whose
    target the controls don't express, have no row.
    """
    few = counts.join(F.broadcast(targets.select("gene").distinct()), "gene", "left_semi")
    n = controls.agg(F.count(F.lit(1)).alias("n"))
    base = few.join(controls.select("cell"), "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("s")).join(F.broadcast(n)).select("gene", (F.col("s") / F.col("n")).alias("control"))
    single = labels.where(F.col("class") == "single").select("cell", "guide_ids").join(F.broadcast(targets), "guide_ids")
    x = single.join(few, ["cell", "gene"], "left").groupBy("guide_ids", "gene").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.coalesce("value", F.lit(0.0))).alias("m"))
    return x.where(F.col("cells") >= min_cells).join(base.where("control > 0"), "gene").select("guide_ids", "gene", "cells", (1 - F.col("m") / F.col("control")).alias("knockdown"))


def distribute_uniform(molecules: DataFrame, classes: DataFrame) -> DataFrame:
    """(cell, gene, value) of molecules (cell, class, n) shared equally among their class's genes (class, genes)."""
    x = molecules.where("n > 0").join(classes.where(F.size("genes") > 0), "class").select("cell", F.explode("genes").alias("gene"), (F.col("n") / F.size("genes")).alias("v"))
    return x.groupBy("cell", "gene").agg(F.sum("v").alias("value"))

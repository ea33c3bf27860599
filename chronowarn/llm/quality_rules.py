"""Document statistics and robust multivariate outliers per language and source.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronowarn.llm.shared import whole_row, written

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
PSEUDO_WORDS = 50       # added to every ratio's denominator, so short texts lean to the middle
DIMENSIONS = ("v_length", "v_symbols", "v_lines", "v_repeats", "v_variety")
#: standard deviation that each statistic is given at least: differences below it mean nothing
FLOOR = (0.08, 0.35, 0.06, 0.03, 0.06)
SHARE = 0.75            # share of a group that the determinant is minimised over
STEPS = 8               # concentration steps
MIN_GROUP = 60          # rows below which a group joins the next wider one
CUTOFF = 6.0            # Mahalanobis distance beyond which a document is rejected
BINS = 32               # bins to a doubling of the squared distance when the nearest rows are cut off


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_distinct (all long).

    Words lie between white space (ASCII).  n_repeat_words counts the words inside any 5-word window that occurs
    twice or more; windows are compared by 64-bit hashes of their words' 64-bit hashes.  Null text has no words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    out = docs.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    stripped = text
    for c in SYMBOLS:
        stripped = F.replace(stripped, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = out.select(
        *docs.columns, F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(stripped)).cast("long").alias("n_symbols"),
        lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    windows = F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(WINDOW)])))
    out = out.select(
        *docs.columns, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct"), windows.alias("_windows"))
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_covered(F.col("_windows")))
    return out.withColumn("n_repeat_words", repeats.cast("long")).drop("_windows")


def _covered(windows: Column) -> Column:
    """Words under windows whose hash occurs more than once: sort by hash, keep equal neighbours, join their spans."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def equal_neighbours(s):
        return F.filter(F.transform(s, lambda x, k: F.when(
            (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["p"]).otherwise(-1)), lambda p: p >= 0)

    places = F.array_sort(F.get(F.transform(F.array(ordered), equal_neighbours), F.lit(0)))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def vectors(measured: DataFrame) -> DataFrame:
    """Add the transformed statistics: smoothed ratios on log or share scales."""
    n = F.col("n_words") + PSEUDO_WORDS
    return measured.withColumns({
        "v_length": F.log((F.col("word_chars") + 5 * PSEUDO_WORDS) / n),
        "v_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "v_lines": F.col("n_dup_lines") / (F.col("n_lines") + 10.0),
        "v_repeats": F.col("n_repeat_words") / n,
        "v_variety": F.log((F.col("n_distinct") + 0.8 * PSEUDO_WORDS) / n) / F.log(n + 3.0),
    })


def _grouped(v: DataFrame) -> DataFrame:
    """Give every row its group: (language, source), or the language's or the corpus's pool of sparse groups."""
    own = v.select(*v.columns, F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))).alias("_fine"),
                   F.to_json(F.struct(F.col("lang").cast("string").alias("lang"))).alias("_wide"))
    fine = own.groupBy("_fine", "_wide").agg(F.count(F.lit(1)).alias("_n"))
    fine = fine.withColumn("_g", F.when(F.col("_n") >= MIN_GROUP, F.col("_fine")))
    wide = fine.where("_g is null").groupBy("_wide").agg(F.sum("_n").alias("_pool"))
    named = fine.join(wide, "_wide", "left").select("_fine", F.coalesce("_g", F.when(F.col("_pool") >= MIN_GROUP, F.col("_wide")), F.lit("*")).alias("_group"))
    return own.join(named, "_fine").drop("_fine", "_wide")


def _matrix(prefix: str) -> list[tuple[int, int, str]]:
    return [(i, j, f"{prefix}{i}{j}") for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def _distance(df: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution through the factor l_ij."""
    for i, name in enumerate(DIMENSIONS):
        rest = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(DIMENSIONS))), F.col("y0") * F.col("y0"))
    return df.withColumn("d2", total).drop(*[f"y{i}" for i in range(len(DIMENSIONS))])


def _factor(df: DataFrame) -> DataFrame:
    """Cholesky factor l_ij of the covariance c_ij, in column arithmetic."""
    for j in range(len(DIMENSIONS)):
        own = F.col(f"c{j}{j}")
        for k in range(j):
            own = own - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(own, F.lit(FLOOR[j] ** 2 / 100))))
        for i in range(j + 1, len(DIMENSIONS)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return df


def _estimate(binned: DataFrame, share: float) -> DataFrame:
    """Mean and factor per group over the lowest bins that hold ``share`` of its rows.

    Moments are partial sums per (group, bin) around fixed origins, so a hot group never meets in one task.
    """
    shifted = {name: F.col(name) - o for name, o in zip(DIMENSIONS, ORIGIN)}
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(shifted[a]).alias(f"s{i}") for i, a in enumerate(DIMENSIONS)]
    sums += [F.sum(shifted[DIMENSIONS[i]] * shifted[DIMENSIONS[j]]).alias(q) for i, j, q in _matrix("q")]
    bins = binned.groupBy("_group", "_bin").agg(*sums)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = bins.withColumn("_before", before).withColumn("_all", F.sum("n").over(Window.partitionBy("_group")))
    chosen = chosen.where(F.col("_before") < F.ceil(share * F.col("_all")))
    total = chosen.groupBy("_group").agg(F.max("_all").alias("group_rows"), *[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(len(DIMENSIONS))], *[q for *_, q in _matrix("q")]]])
    moments = total.select(
        "_group", "group_rows", *[(F.col(f"s{i}") / F.col("n") + o).alias(f"m{i}") for i, o in enumerate(ORIGIN)],
        *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n") + (FLOOR[i] ** 2 if i == j else 0.0)).alias(c) for i, j, c in _matrix("c")])
    return _factor(moments).drop(*[c for *_, c in _matrix("c")])


#: near the middle of each statistic, so that sums of squares keep their digits
ORIGIN = (1.6, 0.0, 0.0, 0.0, 0.0)


def estimates(v: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant mean and factor per group of ``v`` (with _group and the statistics).

    Deterministic start: the ``SHARE`` of rows nearest to the group's middle, each statistic measured from its
    median bin in units of ``FLOOR``; then concentration steps, each taking the rows nearest under the last
    estimate.  A step never raises the determinant but for the width of a bin.  The floors are added to the
    variances, so constant statistics leave the matrix regular.
    """
    grain = F.lit(4.0)
    middle = None
    for name, floor in zip(DIMENSIONS, FLOOR):
        counts = v.groupBy("_group", F.round(F.col(name) / floor * grain).alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("_group")
        counts = counts.withColumn("_upto", F.sum("n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("n").over(w))
        one = counts.where(2 * F.col("_upto") >= F.col("_all")).groupBy("_group").agg((F.min("_bin") * floor / grain).alias(f"_mid_{name}"))
        middle = one if middle is None else middle.join(one, "_group")
    near = v.join(middle, "_group")
    d2 = sum((((F.col(n) - F.col(f"_mid_{n}")) / f) ** 2 for n, f in zip(DIMENSIONS, FLOOR)), F.lit(0.0))
    fit = written(_estimate(near.withColumn("_bin", _bin(d2)), SHARE), "mcd")
    for _ in range(STEPS):
        fit = written(_estimate(_distance(v.join(fit, "_group")).withColumn("_bin", _bin(F.col("d2"))), SHARE), "mcd")
    return fit


def _bin(d2: Column) -> Column:
    return F.floor(BINS * F.log2(d2 + 1e-3)).cast("int")


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed, distance (double) and kept.

    base_failed: fewer than ten words, or over a fifth of the words in repeated windows.  Base failures neither
    shape the estimates nor are measured by them.  kept: not base_failed and a distance of ``CUTOFF`` at most.
    Groups are (language, source), nulls as values of their own; those of under ``MIN_GROUP`` rows pool by language,
    then over the corpus; a pool still under ``MIN_GROUP`` rows rejects nothing (distance null).
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    v = vectors(measured.withColumn("base_failed", base))
    sound = written(_grouped(v.where("not base_failed").select("lang", "source", *DIMENSIONS)).select("_group", "lang", "source", *DIMENSIONS), "vectors")
    fit = estimates(sound).where(F.col("group_rows") >= MIN_GROUP)
    names = sound.select("lang", "source", "_group").distinct().withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # a row per language and source: its size is known once written, so Spark sends it to the rows while it is small
    fit = written(names.join(fit, "_group").drop("_group", "group_rows"), "fits")
    joined = v.join(fit, v.lang.eqNullSafe(fit["_lang"]) & v.source.eqNullSafe(fit["_source"]), "left")
    out = _distance(joined).withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).select(
        *measured.columns, "base_failed", "distance", "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Verdicts for every row of ``docs`` (doc_id, text, lang, source): counts, base_failed, distance, kept.

    The counts are written once without texts; estimates and verdicts read that table.  Null text fails (no words);
    null language or source is a value of its own; repeated rows get equal verdicts; empty input gives no rows;
    extra columns are ignored.
    """
    counts = written(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "counts")
    return judge(counts)


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as they were."""
    packed = docs.select(whole_row(docs), "doc_id", "text", "lang", "source")
    counts = written(measure(packed).drop("text", "doc_id"), "counts")
    return judge(counts).where("kept").select("_row.*")

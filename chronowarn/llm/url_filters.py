"""URL verdicts from host and path rules and from two character language models.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronowarn.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the base list
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 5            # longest window: four characters of context and the next one
ALPHABET = 128.0     # size of the even distribution below the shortest context
OPEN, CLOSE = "\x02", "\x03"
CLASSES = ("allow", "block")
HELD = 5             # one example in so many sets the threshold and is not counted in the models


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case, and the path behind it; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Add rule and rule_verdict: the longest rule whose host is the host or a parent of it and whose path starts the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _windows(df: DataFrame) -> DataFrame:
    """One row per position of a url: its window of ``ORDER`` characters, the last being the one to predict."""
    chars = F.concat(F.array_repeat(F.lit(OPEN), ORDER - 1), F.regexp_extract_all(F.col("url"), F.lit("(?s)."), F.lit(0)), F.array(F.lit(CLOSE)))
    df = df.withColumn("_chars", chars)
    grams = F.transform(F.sequence(F.lit(0), F.size("_chars") - ORDER), lambda i: F.concat(*[F.get("_chars", i + j) for j in range(ORDER)]))
    return df.withColumn("gram", F.explode(grams)).drop("_chars")


def _suffixes(gram: Column, longest: int) -> Column:
    return F.array(*[F.right(gram, F.lit(k)) for k in range(1, longest + 1)])


def models(grams: DataFrame) -> DataFrame:
    """Counts of both models per string of up to ``ORDER`` characters.

    ``grams`` has (gram, allow, block): how often each window occurs in URLs of either class.  Returns (s, n_allow,
    n_block, f_allow, f_block, t_allow, t_block): occurrences of ``s`` as a run, and of what follows ``s`` how much
    and how many kinds.  The strings of every length come from one pass over the distinct windows.
    """
    runs = grams.select(F.explode(_suffixes(F.col("gram"), ORDER)).alias("s"), *CLASSES).groupBy("s").agg(
        *[F.sum(c).alias(f"n_{c}") for c in CLASSES])
    runs = written(runs, "runs")
    after = runs.groupBy(F.expr("left(s, char_length(s) - 1)").alias("s")).agg(
        *[F.sum(f"n_{c}").alias(f"f_{c}") for c in CLASSES], *[F.count_if(F.col(f"n_{c}") > 0).alias(f"t_{c}") for c in CLASSES])
    both = runs.join(after, "s", "full_outer")
    return both.na.fill(0)


def gram_scores(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, difference): log P_allow - log P_block of each window's last character given the four before it.

    Variable order: the estimate starts even over ``ALPHABET`` and is refined by every context length that the
    model has seen, P = (n + t * P_shorter) / (f + t), with n the run, f what followed the context and t its kinds.
    """
    asked = grams.select("gram", F.posexplode(F.concat(
        _suffixes(F.col("gram"), ORDER), F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.expr("left(gram, 4)").substr(F.lit(ORDER + 1) - k, k - 1)))).alias("role", "s"))
    found = asked.where(F.col("role") != ORDER).join(model, "s")     # the empty context, which all grams share, is one row
    top = model.where("s = ''").agg(*[F.max(f"{v}_{c}").alias(f"{v}_{c}0") for c in CLASSES for v in "ft"])
    at = []
    for c in CLASSES:
        for k in range(ORDER):
            at.append(F.max(F.when(F.col("role") == k, F.col(f"n_{c}"))).alias(f"n_{c}{k}"))
            at += [F.max(F.when(F.col("role") == ORDER + k, F.col(f"{v}_{c}"))).alias(f"{v}_{c}{k}") for v in "ft" if k]
    wide = grams.select("gram").join(found.groupBy("gram").agg(*at), "gram", "left").join(F.broadcast(top)).na.fill(0)
    for c in CLASSES:
        wide = wide.withColumn(f"p_{c}", F.lit(1 / ALPHABET))
        for k in range(ORDER):
            f, t, n = (F.col(f"{v}_{c}{k}") for v in "ftn")
            wide = wide.withColumn(f"p_{c}", F.when(f > 0, (n + t * F.col(f"p_{c}")) / (f + t)).otherwise(F.col(f"p_{c}")))
    return wide.select("gram", (F.log(f"p_{CLASSES[0]}") - F.log(f"p_{CLASSES[1]}")).alias("difference"))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, verdict, score and threshold.

    URLs that a rule decides are the accepted and rejected examples of two smoothed character models of variable
    order; every further URL is judged by its log-likelihood difference per character.  One example in ``HELD``, by a
    checksum of the URL, is kept out of the models, so that its score is that of a URL they have not seen; a class of
    which either part would be empty keeps all in both.  The threshold lies between the means of the kept out examples
    of the classes, in proportion to their spreads: where a normal error is equally likely on either side.  Each
    distinct URL counts once in the models and is scored once, whatever its number of rows.

    Null url: empty host and path, no rule, allow, null score.  Without examples of both classes nothing can be told
    apart: score null, allow.  Repeated rows get equal verdicts; empty input gives no rows; extra columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    # short rows that each make hundreds: dealt to all tasks before the windows are made, by another key than distinct's
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = pages.where("url is not null").select("url").distinct().repartition(tasks, F.xxhash64("url", F.lit(1)))
    host, path = host_and_path(F.col("url"))
    urls = apply_rules(distinct.withColumns({"host": host, "path": path}), rules).select("url", "rule_verdict", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HELD)).alias("_part"))
    urls = written(urls.withColumn("uid", F.monotonically_increasing_id()), "urls")
    parts = urls.agg(*[F.count_if((F.col("rule_verdict") == c) & (F.col("_part") == 0)).alias(f"_held_{c}") for c in CLASSES],
                     *[F.count_if((F.col("rule_verdict") == c) & (F.col("_part") != 0)).alias(f"_taught_{c}") for c in CLASSES])
    held, taught = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in CLASSES:
        mine, whole = F.col("rule_verdict") == c, (F.col(f"_held_{c}") == 0) | (F.col(f"_taught_{c}") == 0)
        held = F.when(mine & (whole | (F.col("_part") == 0)), c).otherwise(held)
        taught = F.when(mine & (whole | (F.col("_part") != 0)), c).otherwise(taught)
    urls = urls.join(F.broadcast(parts)).select("uid", "url", held.alias("held"), taught.alias("taught"))  # one row
    seen = written(_windows(urls).groupBy("uid", "held", "taught", "gram").agg(F.count(F.lit(1)).alias("n")), "windows")
    grams = written(seen.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("taught") == c, F.col("n"))), F.lit(0)).alias(c) for c in CLASSES]), "grams")
    scores = written(gram_scores(grams, models(grams.where("allow > 0 or block > 0"))), "gram-scores")
    scored = seen.join(scores, "gram").groupBy("uid", "held").agg((F.sum(F.col("n") * F.col("difference")) / F.sum("n")).alias("score"))
    scored = written(scored, "url-scores")

    told = scored.agg(*[e for c in CLASSES for e in (
        F.avg(F.when(F.col("held") == c, F.col("score"))).alias(f"mean_{c}"), F.stddev_pop(F.when(F.col("held") == c, F.col("score"))).alias(f"sd_{c}"))])
    spread = F.col("sd_allow") + F.col("sd_block")
    threshold = told.select(F.when(spread > 0, (F.col("mean_allow") * F.col("sd_block") + F.col("mean_block") * F.col("sd_allow")) / spread).otherwise(
        (F.col("mean_allow") + F.col("mean_block")) / 2).alias("threshold"))
    judged = urls.select("uid", "url").join(scored.select("uid", "score"), "uid").drop("uid").join(F.broadcast(threshold)).withColumn("score", F.when(F.col("threshold").isNotNull(), F.round("score", 9)))  # one row
    out = apply_rules(pages.withColumns({"host": host, "path": path}), rules).join(judged, "url", "left")
    passes = F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", passes).alias("verdict"), "score", "threshold")

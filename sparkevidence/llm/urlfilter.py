"""URL filter by rules and, where none fits, by the ratio of two character language models.

The rules split the URLs into accepted, rejected and open ones. Accepted and rejected URLs teach a
variable-order Markov model each (orders 0 to ``ORDER``, interpolated by the number of different
continuations a context has had, down to a uniform share), counted over all of them but those kept
for calibration (three sixteenths, by the URL's md5). The score of a URL is the sum of the log
ratios of its characters and its end, over their number. The calibration URLs give the mean and
spread of the scores of both kinds; the threshold stands between the means in proportion to the
spreads. URLs at or above it are allowed.

All steps are DataFrame operations. The counts of the highest order are summed over all URLs once;
lower orders are sums of those. A URL's characters meet the model in a join on the gram, salted,
since every URL holds a few equal grams. Sums are of whole millionths, so their order is no matter.

Defined results: a null or empty URL has empty host and path, fits no rule and is scored by its end
alone; rows with equal URLs get equal results and each give a row; with no accepted or no rejected
URL (or none left for calibration) there is nothing to tell them apart and open URLs are allowed;
an empty table gives no rows. Only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

ORDER = 4
ALPHABET = 256
SALTS = 32
CALIBRATION = ("0", "1", "2")
START, END = "\u0002", "\u0003"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        at = (host == self.host) | host.endswith("." + self.host)
        return at & path.startswith(self.path)


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), A_TO_Z, A_TO_Z.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows with url and their host, path, and the longest fitting rule (a short list of rules)."""
    host, path = host_and_path(F.col("url"))
    with_parts = urls.withColumns({"host": host, "path": path})
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.name))
    first = [
        F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("ruled")))
        for r in longest_first
    ]
    none = F.lit(None).cast("struct<rule:string,ruled:string>")
    return with_parts.withColumn("r", F.coalesce(*first, none)).select(
        *with_parts.columns, F.col("r.rule").alias("rule"), F.col("r.ruled").alias("ruled")
    )


def _grams(urls: DataFrame, *columns) -> DataFrame:
    """A row for each character and the end of each URL: it and the ORDER characters before."""
    padded = F.concat(F.lit(START * ORDER), F.col("url"), F.lit(END))
    each = F.explode(F.sequence(F.lit(1), F.length("url") + 1)).alias("i")
    rows = urls.select(*columns, padded.alias("padded"), each)
    return rows.withColumn("gram", F.expr(f"substring(padded, i, {ORDER + 1})")).drop("padded")


def log_ratios(urls: DataFrame) -> DataFrame:
    """(gram, ratio) for every gram of the URLs (url, n, ruled, fold): log ratio in millionths."""
    taught = ~F.col("fold").isin(*CALIBRATION)
    counts = stored(
        _grams(urls, "n", "ruled", "fold")
        .groupBy("gram")
        .agg(
            F.sum(F.when(taught & (F.col("ruled") == "allow"), F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(taught & (F.col("ruled") == "block"), F.col("n")).otherwise(0)).alias("r"),
        )
    )
    shares = None
    for k in range(ORDER + 1):
        # a context has at most as many rows as there are characters
        same = Window.partitionBy("context")
        level = (
            counts.groupBy(F.substring("gram", -(k + 1), k + 1).alias("own"))
            .agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
            .withColumn("context", F.expr(f"substring(own, 1, {k})"))
        )
        columns = ["own"]
        if shares is None:
            level = level.withColumns({"lower_a": F.lit(1 / ALPHABET), "lower_r": F.lit(1 / ALPHABET)})
        else:
            level = level.withColumn("shorter", F.substring("own", -k, k)).join(
                shares.withColumnRenamed("own", "shorter").hint("shuffle_merge"), "shorter"
            )
        for x in ("a", "r"):
            total, kinds = F.sum(x).over(same), F.sum((F.col(x) > 0).cast("long")).over(same)
            share = F.when(total > 0, (F.col(x) + kinds * F.col(f"lower_{x}")) / (total + kinds))
            columns.append(F.coalesce(share, f"lower_{x}").alias(f"next_{x}"))
        shares = level.select(*columns).withColumnsRenamed({"next_a": "lower_a", "next_r": "lower_r"})
    ratio = F.round((F.log("lower_a") - F.log("lower_r")) * 1e6).cast("long")
    return stored(shares.select(F.col("own").alias("gram"), ratio.alias("ratio")))


def url_scores(urls: DataFrame) -> DataFrame:
    """(url_key, url_more, score) of the distinct URLs; the score is in millionths for a character."""
    ratios = log_ratios(urls)
    keys = (F.xxhash64("url").alias("url_key"), F.xxhash64(F.lit(1), "url").alias("url_more"))
    salt = F.pmod(F.xxhash64("url_key", "i"), F.lit(SALTS)).alias("salt")
    model = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return (
        _grams(urls, *keys)
        .select("url_key", "url_more", "gram", salt)
        .join(model.hint("shuffle_merge"), ["gram", "salt"])
        .groupBy("url_key", "url_more")
        .agg((F.sum("ratio") / F.count("*")).alias("score"))
    )


def _threshold(urls: DataFrame) -> float:
    """Between the mean scores of the calibration URLs of both kinds; below all without them."""
    kinds = {
        row.ruled: row
        for row in urls.where(F.col("fold").isin(*CALIBRATION) & F.col("ruled").isNotNull())
        .groupBy("ruled")
        .agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"),
            (F.sum(F.col("score") * F.col("score") * F.col("n")) / F.sum("n")).alias("square"),
        )
        .collect()
    }
    taught = {r.ruled for r in urls.where(~F.col("fold").isin(*CALIBRATION)).select("ruled").distinct().collect()}
    if not {"allow", "block"} <= taught & set(kinds):
        return float("-inf")
    spread = {k: max(r.square - r.mean**2, 0.0) ** 0.5 for k, r in kinds.items()}
    total = spread["allow"] + spread["block"]
    good, bad = kinds["allow"].mean, kinds["block"].mean
    if total == 0:
        return (good + bad) / 2
    return (good * spread["block"] + bad * spread["allow"]) / total


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url)."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    distinct = rows.groupBy("url").agg(F.count("*").alias("n"))
    known = stored(
        judged(distinct, rules)
        .withColumn("fold", F.substring(F.md5(F.encode("url", "utf-8")), 1, 1))
        .withColumn("url_key", F.xxhash64("url"))
        .withColumn("url_more", F.xxhash64(F.lit(1), "url"))
    )
    scored = stored(
        known.select("url_key", "url_more", "n", "rule", "ruled", "fold").join(
            url_scores(known).hint("shuffle_merge"), ["url_key", "url_more"]
        )
    )
    own = F.when(F.col("score") >= _threshold(scored), "allow").otherwise("block")
    verdicts = scored.select("url_key", "url_more", "score", F.coalesce("ruled", own).alias("verdict"))
    return (
        judged(rows, rules)
        .withColumn("url_key", F.xxhash64("url"))
        .withColumn("url_more", F.xxhash64(F.lit(1), "url"))
        .join(verdicts.hint("shuffle_merge"), ["url_key", "url_more"])
        .select("page_id", "host", "path", "rule", "verdict", (F.col("score") / 1e6).alias("score"))
    )

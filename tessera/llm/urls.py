"""URL filters by a character language-model ratio, with DataFrame functions only.

Rules label what they fit. Two smoothed variable-order Markov models, of accepted and of rejected URLs, score the rest: each
order interpolates its counts with the next lower order's probability. The difference of a URL's two log likelihoods is
a sum over its substrings of up to `ORDER` + 1 characters: a substring adds, as an n-gram, what its order changes, and, as a
context, what its order costs when the next character was never seen after it. So a model is one table of weights, in `BUCKETS` hashed
rows at most, whatever the corpus; scoring is one join with that table and one sum.

Every distinct labelled URL counts: three quarters, by hash, for the models, the other quarter for the threshold, which is
the one, on a grid, that errs least on these. Substrings that hash to one row share the mean of their weights, by how often they were
counted, so rare ones do not bend common ones. Weights are in whole millionths, so sums do not depend on order.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is judged by its text (null:
empty, score 0); with no labelled URLs of a kind every other URL is allowed; repeated rows get equal verdicts; input columns
named as the output are replaced; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, put, table, written

ORDER = 4
BUCKETS = 1 << 17
#: Weight of the lower order's probability, in counts.
ALPHA = 1.0
#: Characters that the order below zero spreads over.
ALPHABET = 256.0
SCALE = 1_000_000
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _substrings(url: Column) -> Column:
    """All substrings of up to ORDER + 1 characters of the padded URL."""
    padded = F.concat(F.lit(START), url, F.lit(END))
    n = F.char_length(padded)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDER + 1), n - i + 1)), lambda k: F.substring(padded, i, k))))


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")


def _dealt(urls: DataFrame) -> DataFrame:
    """A file of URLs is small for what is made of it. (Their substrings are exploded as if there could be none, else Spark makes them before this too, to drop such rows.)"""
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")


def fit(urls: DataFrame) -> DataFrame:
    """(bucket, weight) from (url, accepted): at most BUCKETS rows."""
    n = F.char_length("gram")
    yes, no = (F.sum(F.when(F.col("accepted") == v, 1.0).otherwise(0.0)) for v in (True, False))
    grams = _dealt(urls).select("accepted", F.explode_outer(_substrings(F.col("url"))).alias("gram")).where(F.col("gram") != START)  # the start itself is not predicted
    counts = grams.groupBy("gram").agg(yes.alias("a"), no.alias("r")).select("gram", "a", "r", F.substring("gram", F.lit(1), n - 1).alias("context"))
    total = counts.groupBy("context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
    counts = written(counts.join(total, "context"), "url-counts")

    def smoothed(have: str, total: str, lower: Column) -> Column:
        return (F.col(have) + ALPHA * lower) / (F.col(total) + ALPHA)

    base = F.lit(1 / ALPHABET)
    escape = F.log((F.col("nr") + ALPHA) / (F.col("na") + ALPHA))  # what a context costs whose next character is new to it
    times = (F.col("a") + F.col("r")).cast("long").alias("n")
    level = written(counts.where(n == 1).select("gram", times, smoothed("a", "na", base).alias("pa"), smoothed("r", "nr", base).alias("pr"), escape.alias("escape")), "url-level")
    # the empty context costs every character the same, which is left out of all scores and thresholds
    weights = level.select("gram", (F.log(F.col("pa") / F.col("pr")) - F.col("escape")).alias("w"), "n", F.col("n").alias("share"))
    for k in range(2, ORDER + 2):
        below = level.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        here = counts.where(n == k).withColumn("shorter", F.substring("gram", F.lit(2), F.lit(k))).join(below, "shorter")
        here = here.select("gram", "context", times, (F.col("na") + F.col("nr")).cast("long").alias("after"), smoothed("a", "na", F.col("qa")).alias("pa"), smoothed("r", "nr", F.col("qr")).alias("pr"), "qa", "qr", escape.alias("escape"))
        level = written(here, "url-level")
        gain = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("qa") / F.col("qr")) - F.col("escape")
        # a context has its share as a substring, but for the start, which is none
        own = F.when(F.col("context") == START, F.col("after")).otherwise(F.lit(0))
        weights = weights.union(level.select("gram", gain, "n", "n")).union(level.select("context", "escape", "after", own).distinct())
    whole = F.round(F.col("w") * SCALE).cast("long")
    return weights.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.round(F.sum(whole * F.col("n")) / F.sum("share")).cast("long").alias("weight"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score) for distinct non-null URLs: log likelihood difference a character, less a constant that all URLs share."""
    grams = _dealt(urls).select("url", F.transform(_substrings(F.col("url")), _bucket).alias("b")).select("url", F.explode_outer("b").alias("bucket"))
    # at most BUCKETS rows of 12 bytes: a bound that does not depend on the data
    known = grams.join(F.broadcast(model), "bucket", "left").groupBy("url").agg(F.sum("weight").alias("sum"))
    return known.select("url", (F.coalesce("sum", F.lit(0)) / SCALE / (F.char_length("url") + 1)).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """The grid point under which rejecting errs least, by the mean of both kinds' error rates; of equals the least. `scored`: (accepted, score)."""
    cell = F.least(F.lit(500), F.greatest(F.lit(-500), F.floor(F.col("score") * 100))).alias("cell")
    cells = scored.groupBy(cell).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).orderBy("cell").collect()  # 1001 rows at most
    accepted, rejected = sum(c.a for c in cells), sum(c.r for c in cells)
    if not accepted or not rejected:
        return None
    best, at, a, r = rejected * accepted, cells[0].cell, 0, 0
    for c in cells:
        a, r = a + c.a, r + c.r
        if (now := a * rejected + (rejected - r) * accepted) < best:
            best, at = now, c.cell + 1
    return at / 100


def url_filter(pages: DataFrame, url: str = "url", out: str = "judged", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`pages` with a struct column `out`: host, path, rule, score (null where a rule fits) and verdict."""
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    name, verdict = fitting(host_of(text), path_of(text), rules)
    urls = written(pages.select(text.alias("url")).distinct().select("url", verdict.alias("verdict")), "urls")
    labelled = urls.where("verdict is not null").select("url", (F.col("verdict") == "allow").alias("accepted"))
    held = F.pmod(F.xxhash64(F.lit("held out"), "url"), F.lit(4)) == 0
    model = written(fit(labelled.where(~held)), "url-model")
    limit = threshold(score(labelled.where(held), model).join(labelled, "url").select("accepted", "score"))
    url_, score_ = fresh(pages, "scored_url", "scored")
    own = score(urls.where("verdict is null"), model).select(F.col("url").alias(url_), F.col("score").alias(score_))
    judged = pages.join(own, text == F.col(url_), "left")
    decided = F.coalesce(verdict, F.when(F.col(score_) < F.lit(limit if limit is not None else float("-inf")), "block").otherwise("allow"))
    fields = F.struct(host_of(text).alias("host"), path_of(text).alias("path"), name.alias("rule"), F.col(score_).alias("score"), decided.alias("verdict"))
    return put(judged, out, fields).drop(url_, score_)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE_SQL: dict[str, str] = {}

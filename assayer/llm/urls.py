"""URL filters by association rules.

Stated rules judge the urls they fit.  These urls are the labelled examples: every
url is a set of tokens, one of each kind at most, and Spark's FP-growth mines the
token combinations that go with a verdict.  Rules are pruned by support, confidence
and by shorter rules that say the same at no less confidence.  A rule is filed under
its rarest token; a url looks up its own tokens and keeps the rules whose tokens it
all has.  Urls are judged once per different token set.

Defined results
  NULL url or one without ``://``   empty host and path, judged like any other url
  a url that no rule fits           verdict of the strongest mined rule (confidence, then support,
                                    then fewer tokens, then block), ``allow`` if there is none
  nothing to learn from             ``allow`` where no stated rule fits
  repeated rows, very long urls     each row by itself; a url never has more than seven tokens
  empty table                       no rows
Built from DataFrame functions and Spark's own FP-growth only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import stored

#: The stated rules: verdict, host and path.
STATED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
          ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = STATED) -> Column:
    """The longest rule that fits, as ``(rule, verdict)``; NULL if none does."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases)


def tokens(host: Column, path: Column) -> Column:
    """One token of each kind that the url has; runs of digits count as one figure."""
    plain = F.regexp_replace(path, "[0-9]+", "0")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    named = {
        "tld": F.try_element_at(labels, F.lit(-1)),
        "domain": F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")),
        "host": F.when(F.size(labels) >= 3, host),
        "first": F.when(F.size(labels) >= 3, F.element_at(labels, 1)),
        "dir": F.when(F.size(parts) >= 2, F.element_at(parts, 1)),
        "page": F.try_element_at(parts, F.lit(-1)),
        "depth": F.size(parts).cast("string"),
    }
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(k + "="), v)) for k, v in named.items()]))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``antecedent, verdict, confidence, support`` from ``tokens, verdict``."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = stored(
        model.associationRules.where(F.col("consequent")[0].startswith("verdict="))
        .where(~F.exists("antecedent", lambda x: x.startswith("verdict=")))
        .select(F.array_sort("antecedent").alias("antecedent"),
                F.substring(F.col("consequent")[0], 9, 1000).alias("verdict"), "confidence", "support"), "url-rules")
    # A longer rule goes if a part of it says the same with no less confidence.
    shorter = rules.select(F.explode("antecedent").alias("token"), F.col("antecedent").alias("part"),
                           F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    longer = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    redundant = longer.join(shorter, "token").where(
        (F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence"))
        & (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return rules.join(redundant.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")


def match(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, learned`` of the different token sets that some rule fits."""
    posted = patterns.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
    numbered = rules.withColumn("token", F.explode("antecedent")).join(posted, "token")
    index = numbered.groupBy("antecedent", "verdict", "confidence", "support").agg(
        F.min_by("token", F.struct("urls", "token")).alias("token"))
    found = (patterns.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
             .where(F.size(F.array_except("antecedent", "tokens")) == 0))
    strength = F.struct("confidence", "support", -F.size("antecedent"), "verdict")
    return found.groupBy("tokens").agg(F.max_by("verdict", strength).alias("learned"))


def judge(pages: DataFrame, stated: Sequence[tuple[str, str]] = STATED, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    urls = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("known", stated_rule(F.col("host"), F.col("path"), stated))
            .withColumn("tokens", tokens(F.col("host"), F.col("path"))))
    labelled = urls.where(F.col("known").isNotNull()).select("tokens", F.col("known.verdict").alias("verdict"))
    rules = mine(labelled, min_support, min_confidence)
    patterns = urls.where(F.col("known").isNull()).select("tokens").distinct()
    learned = stored(match(patterns, rules), "url-verdicts")
    return urls.join(learned, "tokens", "left").select(
        "page_id", "host", "path", F.col("known.rule").alias("rule"),
        F.coalesce("known.verdict", "learned", F.lit("allow")).alias("verdict"))

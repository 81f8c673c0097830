"""URL filtering: fixed prefix rules, and association rules over URL tokens mined from labels by FP-growth.

Tokens are the host's labels, each with its place from the end, path segments by place, the file ending, query names and the fragment. FP-growth (Spark's) mines
the sets of at most ``LENGTH`` tokens that occur with the label ``block`` in at least ``SUPPORT`` of the labelled pages with it; rules whose confidence is at least
``CONFIDENCE``, also at the lower end of its 95 % Wilson interval, whose lift exceeds 1 by ``LIFT`` and which no shorter rule at least as sure contains are kept. A kept rule is filed in an inverted index under its
rarest token; a page looks its tokens up there and a rule fits if the page has all of its tokens. The surest rule that fits blocks the page, and pages
that none fits are allowed.

FP-growth finds frequent sets of any length, up to 2**k of k tokens that go together. Where a labelled page has more than ``WIDE`` frequent tokens, the sets of at most LENGTH are
counted level by level instead, which gives the same rules. The index is broadcast below ``SMALL`` rules and joined by shuffle beyond.

Labels are of documents; ``shown_labels`` gives each page the label of the document whose number its path has first.

Defined results: a null url, or one without ``://``, has empty host and path and no tokens and is allowed; pages without a label aren't learned from; of several
labels of a page the greatest counts; repeated pages are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.llm import common as C

SUPPORT, LEAST_ROWS = 0.005, 8
CONFIDENCE, LIFT = 0.5, 0.2
LENGTH, WIDE = 3, 14
SMALL = 10_000
BLOCK = "label=block"
#: (verdict, host and path): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # a longer rule overrides
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def tokens(pages: DataFrame) -> DataFrame:
    """Adds items: the distinct tokens of host, path and what follows."""
    labels = F.reverse(F.filter(F.split("host", r"\."), lambda x: x != ""))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    items = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
        F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), x)),
        F.array(F.concat(F.lit("ending="), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))),
        F.when(F.coalesce("url", F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        names,
    )
    return pages.withColumn("items", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(items, lambda x: x != "ending="))))


def _grown(baskets: DataFrame, n: int, least: int, length: int) -> DataFrame:
    """antecedent, shown, hits by FP-growth; baskets: items, bad."""
    from pyspark.ml.fpm import FPGrowth

    label = F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=CONFIDENCE).fit(baskets.select(F.concat("items", label).alias("items")).where("size(items) > 0"))
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCK).where(F.size("antecedent") <= length)
    hits = F.round(F.col("support") * n).cast("long")
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.round(hits / F.col("confidence")).cast("long").alias("shown"), hits.alias("hits"))


def _levels(baskets: DataFrame, least: int, length: int) -> DataFrame:
    """antecedent, shown, hits of all sets of 1 to length tokens, counted where they stand."""
    sets, out = F.transform("items", lambda x: F.array(x)), None
    for k in range(1, length + 1):
        if k > 1:  # each set of the level before with each token after its last one
            sets = F.flatten(F.transform(sets, lambda s: F.transform(F.filter("items", lambda y: y > F.element_at(s, -1)), lambda y: F.concat(s, F.array(y)))))
        found = baskets.select(F.explode(sets).alias("antecedent"), "bad").groupBy("antecedent").agg(F.count("*").alias("shown"), F.count_if("bad").alias("hits")).where(F.col("hits") >= least)
        out = found if out is None else out.unionByName(found)
    return out


def mine(labelled: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """labelled: items, bad (boolean). Rules: key (rarest token), antecedent, confidence, support."""
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "key string, antecedent array<string>, confidence double, support double")
    labelled = C.stored(labelled.select(F.monotonically_increasing_id().alias("row"), "items", "bad"), "labelled")
    n, bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    least = max(math.ceil(SUPPORT * (bad or 0)), LEAST_ROWS)
    if not bad or least > bad:
        return none
    tokens_ = labelled.select("row", "bad", F.explode("items").alias("token"))
    single = C.stored(tokens_.groupBy("token").agg(F.count("*").alias("freq"), F.count_if("bad").alias("hits")).where(F.col("hits") >= least).drop("hits"), "tokens")
    frequent = tokens_.join(single.select("token"), "token").groupBy("row", "bad").agg(F.array_sort(F.collect_set("token")).alias("items"))
    baskets = C.stored(frequent.select("items", "bad"), "baskets")
    most = baskets.agg(F.max(F.size("items"))).first()[0] or 0
    if not most:
        return none
    rules = _grown(baskets, n, least, length) if most <= wide else _levels(baskets, least, length)
    z, p, shown = 1.96, F.col("hits") / F.col("shown"), F.col("shown")
    lower = (p + z * z / (2 * shown) - z * F.sqrt(p * (1 - p) / shown + z * z / (4 * shown * shown))) / (1 + z * z / shown)
    rules = rules.where((lower >= CONFIDENCE) & (p >= (1 + LIFT) * F.lit(bad / n))).select("antecedent", p.alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"))
    rules = C.stored(rules, "rules")
    # a rule is idle if a part of it is a rule at least as sure
    parts = rules.select("antecedent", "confidence", F.explode(_parts(length)).alias("part")).where("size(part) > 0 and size(part) < size(antecedent)")
    surer = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    idle = parts.join(surer, "part").where("sure >= confidence").select("antecedent").distinct()
    kept = rules.join(idle, "antecedent", "left_anti")
    key = kept.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return C.stored(kept.join(key, "antecedent").select("key", "antecedent", "confidence", "support"), "index")


def _parts(length: int) -> Column:
    """All subsets of a rule's tokens, of which it has at most length."""

    def subset(mask: int) -> Column:
        return F.filter("antecedent", lambda x, i: F.lit(mask).bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)

    return F.array(*map(subset, range(1, 1 << length)))


def shown_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad of the pages whose path has a number that is the doc_id of a labelled document (labels: doc_id, bad)."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("_shown"))
    return shown.join(labels.select(F.col("doc_id").cast("long").alias("_shown"), "bad"), "_shown").select("page_id", "bad")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url), labels (page_id, bad boolean): page_id, host, path, rule, verdict, confidence, matched."""
    base = C.stored(tokens(ruled(pages.select("page_id", "url"), rules)).select("page_id", "host", "path", "rule", "rule_verdict", "items"), "pages")
    bad = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    index = mine(base.join(bad, "page_id").select("items", "bad"))
    n = index.count()
    filed = F.broadcast(index) if n <= SMALL else index
    looked = base.where("rule is null").select("page_id", "items", F.explode("items").alias("key")).join(filed, "key").where("size(array_except(antecedent, items)) = 0")
    best = looked.groupBy("page_id").agg(F.max(F.struct("confidence", "antecedent")).alias("best"))
    out = base.join(best, "page_id", "left")
    method = F.when(F.col("best").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.col("best.confidence").alias("confidence"), F.array_join("best.antecedent", " ").alias("matched"))

"""URL filters: given rules by host and path, and mined association rules for the rest.

FP-growth mines combinations of URL tokens, together with the label, from labelled pages. Combinations whose confidence,
support and lift reach given bounds become block rules. Tokens that the same labelled pages have, as the query keys of one
template, are one class: any combination of them says what one of them says, so a class is mined as one token and a rule asks
for any token of each of its classes. That is exactly what all combinations of single tokens would match, without two to the
power of a class's tokens of them. Rules are matched by an inverted index: a rule stands under the tokens of its rarest class,
so a URL meets only rules that it shares one of these with, and is then tested for all of a rule's classes.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SEP = "\x01"
BLOCK_ITEM = "label=block"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments with runs of digits as #, query keys, whether there is a fragment."""
    tag = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    out = F.concat(
        tag("s:", F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        tag("h:", F.split(host_of(url), r"\.")),
        tag("p:", F.split(F.regexp_replace(path_of(url), r"[0-9]+", "#"), "/")),
        tag("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        F.when(url.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(F.coalesce(out, F.array().cast("array<string>"))))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule (verdict, host, path) that fits, or null; of equal ones the last by name."""
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    fits = [none] + [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def _times(n: Column) -> list[Column]:
    """Two columns that repeat a row n times, without an array of n."""
    return [F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 4_096))).alias("many"), F.explode(F.sequence(F.lit(1), F.least(F.lit(4_096), n - 4_096 * F.col("many")))).alias("some")]


def classes(sets: DataFrame, min_count: int) -> DataFrame:
    """(item, class, n) of each token that min_count rows have, from (items, n): the class is the least token of the same rows."""
    x = sets.select("n", F.explode("items").alias("item"), F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(7), "items").alias("h2"))
    x = x.groupBy("item").agg(F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).where(F.col("n") >= min_count)
    return x.select("item", F.min("item").over(Window.partitionBy("n", "h1", "h2")).alias("class"), "n")


def mine(labelled: DataFrame, min_support: float = 0.0, min_confidence: float = 0.6, min_lift: float = 1.5, min_count: int = 20) -> DataFrame:
    """(key, items, any_of, confidence, support): block rules from rows of (items, block).

    A combination is frequent that min_count rows have, however many rows there are, or min_support of all rows where that is
    more. Frequent tokens, which the driver holds, number at most all tokens of all rows over min_count. items are the least
    tokens of a rule's classes, any_of the tokens of each of them; a rule has a row for each token, key, of the class that
    fewest rows have. No labelled rows give no rules.

    FP-growth has no bound on the combinations of different classes; k that nearly always come together, but not quite, are two
    to the power of k combinations.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "key string, items array<string>, any_of array<array<string>>, confidence double, support double")
    sets = written(labelled.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("b")), "labelled-sets")
    total, blocked = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not total or not blocked:
        return none
    of = written(classes(sets, min_count), "token-classes")
    mapped = sets.select("items", "n", "b", F.explode("items").alias("item")).join(of.select("item", "class"), "item").groupBy("items", "n", "b").agg(F.collect_set("class").alias("classes"))
    with_label = F.concat("classes", F.array(F.lit(BLOCK_ITEM)))
    x = mapped.select(F.explode(F.array(F.struct(F.col("b").alias("n"), with_label.alias("items")), F.struct((F.col("n") - F.col("b")).alias("n"), F.col("classes").alias("items")))).alias("x")).select("x.*").where(F.col("n") > 0)
    many, some = _times(F.col("n"))
    x = x.select("n", "items", many).select("items", some).select("items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # FPGrowth takes its share of the rows that it gets: those of no frequent token are none of them
    kept = mapped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not kept:
        return none
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support * total, min_count) / kept), minConfidence=min_confidence, numPartitions=parts).fit(x).freqItemsets
    mined = mined.withColumn("set", F.array_join(F.array_sort(F.array_remove("items", BLOCK_ITEM)), _SEP)).withColumn("with", F.array_contains("items", BLOCK_ITEM))
    # antecedent and antecedent-with-label meet under the antecedent's key: one aggregation instead of a self join
    rules = mined.groupBy("set").agg(F.max(F.when(F.col("with"), F.col("freq"))).alias("hits"), F.max(F.when(~F.col("with"), F.col("freq"))).alias("freq")).where(F.col("set") != "")
    rules = rules.withColumn("confidence", F.col("hits") / F.col("freq")).where((F.col("hits") >= min_count) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * blocked / total))
    rules = rules.select("set", F.split("set", _SEP).alias("items"), "confidence", (F.col("hits") / total).alias("support"))
    groups = of.groupBy("class").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("item")).alias("tokens"))  # tokens of one URL at most
    x = rules.select("*", F.explode("items").alias("class")).join(groups, "class").groupBy("set").agg(
        F.min(F.struct("n", "class", "tokens"))["tokens"].alias("keys"), F.first("items").alias("items"), F.collect_list("tokens").alias("any_of"), F.max("confidence").alias("confidence"), F.max("support").alias("support"),
    )
    return x.select(F.explode("keys").alias("key"), "items", "any_of", "confidence", "support")


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set, confidence): the best rule of each token set that one matches."""
    x = sets.select("set", F.split("set", _SEP).alias("tokens")).select("*", F.explode("tokens").alias("key")).join(rules, "key")
    return x.where(F.forall("any_of", lambda c: F.arrays_overlap(c, F.col("tokens")))).groupBy("set").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", **bounds) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every row of pages.

    verdict is that of the longest given rule, else block where a mined rule matches, else allow; confidence is the mined
    rule's, or null. Labels are joined by id; a page of quality 0 or toxic 1 is a block example, a label with both null none.
    bounds are those of mine(): by default 20 pages make a combination, of confidence 0.6 and lift 1.5 or more.
    A url that is null or has no :// has an empty host and path. Urls of any length are taken whole, with as many tokens as they
    have. Repeated rows stay repeated; other columns are not looked at; an empty table gives no rows.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens")).withColumn("set", F.array_join("tokens", _SEP))
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("block"))
    mined = mine(p.join(known, "page_id").select(F.col("tokens").alias("items"), "block"), **bounds)
    # as a table of its own both sides of the join below are plain exchanges, which Spark can split where a host is very common
    hit = written(fired(p.select("set").distinct(), mined).select(F.col("set").alias("f_set"), "confidence"), "fired-rules")
    x = p.join(hit, F.col("set") == F.col("f_set"), "left").withColumn("given", by_rules(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("given")["verdict"], F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return x.select("page_id", "host", "path", F.col("given")["rule"].alias("rule"), verdict.alias("verdict"), "confidence")

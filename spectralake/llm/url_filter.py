"""URL filter: fixed rules first, then association rules mined by Spark's FP-growth.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null url or one without
``://`` has both empty. A fixed rule (verdict, ``host/path``) fits its host and all
subdomains when the url's path starts with the rule's path; the longest rule wins.

Urls that a fixed rule decides are the labelled transactions: the tokens of the url and
the verdict. FP-growth finds frequent token sets; those that occur with one verdict in a
share of at least ``CONFIDENCE`` are rules, unless a part of them is one already. A rule
is indexed under its rarest token. Tokens that occur in the same urls are one item for
FP-growth, and its rules are spelled out for each of them: that is exact, as a rule with
two of them says no more than the rule with one. Any other url takes the verdict of the matching rule
of highest confidence, then support, then fewest tokens, then text; without one it is
allowed. With labels given by the caller (url, verdict), those are mined instead.

Tokens: labels of the host with their place from the end, segments of the path (digits
count as ``#``), and names of query parameters. Repeated rows get the same verdict each;
other columns are ignored; an empty table gives no rows.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from spectralake.llm.tables import bounded
from spectralake.storage import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The fixed rules: verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT = 0.002       # share of the labelled urls that hold a token set
CONFIDENCE = 0.9
LONGEST = 3           # tokens of a rule


def parts(url):
    """(host, path) expressions of an url."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.regexp_extract(whole, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fixed(host, path, rules=RULES):
    """The longest fitting rule as struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url, host, path):
    """The distinct tokens of an url."""
    labels = F.filter(F.reverse(F.split(host, "\\.")), lambda x: x != "")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    return F.array_distinct(F.concat(hosts, F.transform(segments, lambda x: F.concat(F.lit("p="), x)),
                                     F.transform(names, lambda x: F.concat(F.lit("q="), x))))


def mine(labelled, support=SUPPORT, confidence=CONFIDENCE, longest=LONGEST):
    """Rules (tokens, verdict, support, confidence) from (tokens, verdict) rows, pruned."""
    labelled = save(labelled)
    total = labelled.count()
    schema = "tokens array<string>, verdict string, support double, confidence double"
    if not total:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(2, int(support * total))
    numbered = save(labelled.withColumn("id", F.monotonically_increasing_id()))
    spread = numbered.select("id", "verdict", F.explode("tokens").alias("token"))
    urls = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    often = spread.groupBy("token").agg(F.count("*").alias("count"), *urls).where(F.col("count") >= least)
    same = save(often.groupBy("count", "x1", "x2").agg(F.min("token").alias("item"), F.collect_list("token").alias("members")).select("item", "members"))
    kept = spread.join(bounded(same.select(F.col("item").alias("token")), 96), "token")
    items = kept.groupBy("id", "verdict").agg(F.collect_set("token").alias("tokens"))
    items = items.select(F.concat("tokens", F.array(F.concat(F.lit("v="), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=least / total).fit(items).freqItemsets
    sets = save(sets.select(F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("v=")))).alias("tokens"),
                            F.filter("items", lambda x: F.startswith(x, F.lit("v="))).alias("v"), "freq").where(
        (F.size("tokens") > 0) & (F.size("tokens") <= longest)))
    alone = sets.where(F.size("v") == 0).select("tokens", F.col("freq").alias("whole"))
    rules = sets.where(F.size("v") == 1).select("tokens", F.substring(F.col("v")[0], 3, 1 << 20).alias("verdict"), "freq").join(alone, "tokens")
    rules = rules.select("tokens", "verdict", (F.col("freq") / total).alias("support"), (F.col("freq") / F.col("whole")).alias("confidence"))
    rules = save(rules.where(F.col("confidence") >= confidence))
    # a rule that holds a shorter one of the same verdict and no lower confidence says nothing new
    smaller = rules.select(F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("tokens").alias("part"))
    inner = rules.withColumn("part", F.explode(F.flatten(F.array(
        F.transform("tokens", lambda t: F.array(t)), F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))))))
    inner = inner.where(F.size("part") < F.size("tokens")).join(smaller, "part").where(
        (F.col("verdict") == F.col("v")) & (F.col("confidence") <= F.col("c"))).select("tokens", "verdict").distinct()
    rules = rules.join(inner, ["tokens", "verdict"], "left_anti").select("*", F.explode("tokens").alias("item"))
    rules = rules.join(bounded(same, 1024), "item").groupBy("tokens", "verdict", "support", "confidence").agg(F.collect_list("members").alias("members"))
    every = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda all_, some: F.flatten(
        F.transform(all_, lambda one: F.transform(some, lambda t: F.concat(one, F.array(t))))))
    return rules.select(F.explode(every).alias("tokens"), "verdict", "support", "confidence").withColumn("tokens", F.array_sort("tokens"))


def matched(rows, rules):
    """The best rule's verdict and tokens for each distinct url of ``rows`` (url, tokens)."""
    # one entry per rule: its token that the fewest rules hold
    spread = rules.select("*", F.explode("tokens").alias("token"))
    uses = spread.groupBy("token").count()
    entry = spread.join(uses, "token").groupBy("tokens", "verdict", "support", "confidence").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    entry = save(entry.withColumnRenamed("tokens", "needed"))
    met = rows.select("url", "tokens", F.explode("tokens").alias("token")).join(bounded(entry, 512), "token")
    met = met.where(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), F.size("needed"), F.array_join("needed", " "), "verdict"))
    return met.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("mined"))


def judge(pages, labels=None, rules=RULES, support=SUPPORT, confidence=CONFIDENCE):
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = save(rows.withColumn("fixed", fixed(F.col("host"), F.col("path"), rules)))
    words = tokens(F.col("url"), F.col("host"), F.col("path"))
    if labels is None:
        known = rows.where("fixed is not null").select(words.alias("tokens"), F.col("fixed.verdict").alias("verdict"))
    else:
        known = labels.where("url is not null and verdict is not null").select(tokens(F.col("url"), *parts(F.col("url"))).alias("tokens"), "verdict")
    open_ = rows.where("fixed is null and url is not null").select("url", words.alias("tokens")).distinct()
    mined = save(matched(open_, mine(known, support, confidence)))
    return rows.join(bounded(mined, 512), "url", "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "mined", F.lit("allow")).alias("verdict"))

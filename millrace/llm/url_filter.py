"""URL filtering by configured rules and by mined association rules.  JVM-only: DataFrame functions and the
built-in FP-growth; no Python runs on executors.

A URL is cut into tokens (host labels, path words with digits folded, extension, query keys).  FP-growth over the
labelled URLs mines token combinations that imply the label "block"; rules below a confidence or support
threshold, and rules that a more general rule already covers at no less confidence, are pruned.  So that long URLs
don't give all subsets of their tokens, tokens of the same URLs are one item (each of them matches), tokens that imply
the label by themselves are rules at once, and URLs that still have more than twelve items (`MOST_TOKENS`, a parameter
of fitting) are mined level by level for the combinations that can be left after pruning: every token has to shut out a
URL of another label.  Nothing is left out; all rules are counted over all labelled URLs.  Matching uses an
inverted index: every rule is posted under each of its tokens, a page's tokens fetch postings, and a rule fires
when all its tokens were hit.  Pages that share a token set are matched once, so a host that owns a third of all
pages costs no more than a small one.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens and the verdict
``allow``; repeated pages are judged one by one; empty tables give empty results; a null or unmatched label is
ignored; columns other than the named ones are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABEL = "label=block"
#: Items of a labelled URL up to which FP-growth mines it; longer ones are mined level by level.
MOST_TOKENS = 12
RULE = "rule_id long, tokens array<string>"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL; digits are folded so that running numbers don't make tokens of their own."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.filter(F.split(F.regexp_replace(ascii_lower(path), r"[0-9]+", "0"), r"[/._-]+"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    return F.array_distinct(F.concat(labels, F.transform(words, lambda x: F.concat(F.lit("p:"), x)), keys))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting configured rule and its verdict (null without one).

    A rule ``host/path`` fits its host and every subdomain if the URL's path starts with the rule's path.  Of
    rules of equal length the one with the longer host wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].find("/"), r[0])):
        at = text.find("/")
        own, prefix = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def mining_items(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """What mining sees of the labelled URLs (row, tokens, block): items (row, block, token, b, other), and the tokens
    that an item stands for (token, alike).

    Tokens that occur in exactly the same URLs can't be told apart by any rule, so the least stands for all; what is in
    fewer than `least` URLs to be blocked isn't in a rule.  b and other: how many URLs of either label have the item.
    """
    each = labelled.select("row", "block", F.explode(F.array_distinct("tokens")).alias("token"))
    same = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("b"), F.expr("bit_xor(row)").alias("x"), F.expr("bit_xor(xxhash64(row, 7L))").alias("y"))
    named = same.filter(F.col("b") >= least).groupBy("n", "b", "x", "y").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("alike"))
    named = stored(named.select("token", "alike", "b", (F.col("n") - F.col("b")).alias("other")), "url-items")
    return each.join(named.drop("alike"), "token"), named


def counted(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """rules (rule_id, tokens) with b and other, the rows of either label that have all their tokens.  rows: set_id, tokens, block."""
    fired = fired_rules(rows.select("set_id", "tokens"), rules.select("rule_id", "tokens", F.lit(0.0).alias("confidence")))
    n = fired.join(rows.select("set_id", "block"), "set_id").groupBy("rule_id").agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("other"))
    return rules.select("rule_id", "tokens").join(n, "rule_id")


def level_by_level(rows: DataFrame, long: DataFrame, single: DataFrame, others: int, least: int) -> DataFrame:
    """Combinations (rule_id, tokens) of two and more items that occur in a long row and can stay as rules.

    If the URLs of another label that have all of a combination are the same without one of its tokens, the combination
    without it is as confident, and so is any larger one without it.  So each token has to shut one out: a
    combination grows only from such ones, and only while it has such URLs left.  single: token, b, other of all items.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], RULE)
    ours = long.select(F.explode("tokens").alias("token")).distinct()
    level = single.join(ours, "token").filter((F.col("other") > 0) & (F.col("other") < others)).select(F.array("token").alias("tokens"), "other")
    size = 1
    while True:
        level = stored(level, "url-level")
        head = F.slice("tokens", 1, size - 1)
        x, y = level.select(head.alias("head"), F.col("tokens")[size - 1].alias("x")), level.select(head.alias("head"), F.col("tokens")[size - 1].alias("y"))
        made = x.join(y, "head").filter("x < y").select(F.concat("head", F.array("x", "y")).alias("tokens"))
        made = stored(made.select(F.xxhash64("tokens").alias("rule_id"), "tokens"), "url-level")
        met = fired_rules(long.select("set_id", "tokens"), made.withColumn("confidence", F.lit(0.0))).select("rule_id").distinct()
        size += 1
        seen = stored(counted(made.join(met, "rule_id", "left_semi"), rows).filter(F.col("b") >= least), "url-level")
        # all combinations without one token have to be there, with more URLs of another label
        without = seen.select("rule_id", "other", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens"))
        smaller = level.select("tokens", F.col("other").alias("before"))
        free = without.join(smaller, "tokens").filter("other < before").groupBy("rule_id").agg(F.count("*").alias("n")).filter(F.col("n") == size)
        kept = stored(seen.join(free, "rule_id", "left_semi"), "url-level")
        if not kept.limit(1).count():
            return found
        found = found.union(kept.select("rule_id", "tokens"))
        level = kept.filter("other > 0").select("tokens", "other")


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, min_count: int = 5, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Association rules ``tokens -> block``: columns rule_id, tokens, confidence, support, alike (for each of the
    tokens all that occur in the same labelled URLs).

    labelled: columns tokens (array<string>), block (boolean).  min_count keeps tiny inputs from giving rules that
    rest on one or two URLs; URLs of more than most_tokens items aren't mined by FP-growth (see `level_by_level`).
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col("block").isNotNull() & (F.size("tokens") > 0))
    numbered = stored(usable.select(F.xxhash64(F.monotonically_increasing_id()).alias("row"), "tokens", "block"), "url-labels")
    n, others = numbered.agg(F.count("*"), F.count_if(~F.col("block"))).first()
    if not n:
        return spark.createDataFrame([], f"{RULE}, confidence double, support double, alike array<array<string>>")
    least = max(1, ceil(max(min_support * n, min_count) - 1e-9))
    items, named = mining_items(numbered, least)
    # what every URL of another label has, or none, adds nothing to other tokens
    telling = items.filter((F.col("other") > 0) & (F.col("other") < others))
    rows = stored(telling.groupBy("row", "block").agg(F.sort_array(F.collect_list("token")).alias("tokens")).withColumnRenamed("row", "set_id"), "url-rows")
    short, long = rows.filter(F.size("tokens") <= most_tokens), rows.filter(F.size("tokens") > most_tokens)
    rules = named.select(F.xxhash64(F.array("token")).alias("rule_id"), F.array("token").alias("tokens"))
    if (m := short.count()) >= least:
        labels = F.when(F.col("block"), F.array_append("tokens", F.lit(LABEL))).otherwise(F.col("tokens"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m, minConfidence=min_confidence).fit(short.select(labels.alias("items")))
        mined = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == LABEL)).select(F.array_sort("antecedent").alias("tokens"))
        rules = rules.union(mined.select(F.xxhash64("tokens").alias("rule_id"), "tokens"))
    if long.limit(1).count():
        rules = rules.union(level_by_level(rows, long, named, others, least))
    several = counted(stored(rules.filter(F.size("tokens") > 1).dropDuplicates(["rule_id"]), "url-rules"), rows)
    single = named.select(F.xxhash64(F.array("token")).alias("rule_id"), F.array("token").alias("tokens"), "b", "other")
    confidence = F.col("b") / (F.col("b") + F.col("other"))
    rules = single.union(several.select(single.columns)).filter((F.col("b") >= least) & (confidence >= min_confidence))
    rules = stored(rules.select("rule_id", "tokens", confidence.alias("confidence"), (F.col("b") / n).alias("support")), "url-rules")
    # a rule goes when a rule of some of its tokens is as confident: the inverted index finds the rules inside it
    inside = fired_rules(rules.select(F.col("rule_id").alias("set_id"), "tokens"), rules)
    own = rules.select(F.col("rule_id").alias("set_id"), F.col("confidence").alias("c"), F.size("tokens").alias("size"))
    covered = inside.join(own, "set_id").filter("need < size AND confidence >= c").select(F.col("set_id").alias("rule_id")).distinct()
    kept = rules.join(covered, "rule_id", "left_anti")
    alike = kept.select("rule_id", F.posexplode("tokens").alias("at", "token")).join(named.select("token", "alike"), "token")
    alike = alike.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alike"))), lambda x: x["alike"]).alias("alike"))
    return kept.join(alike, "rule_id").select("rule_id", "tokens", "confidence", "support", "alike")


def fired_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """set_id, rule_id, need (tokens of the rule), confidence of all rules whose tokens a set has, by inverted index.

    Where rules have `alike`, one of the tokens there is enough for each of a rule's tokens.
    """
    places = F.col("alike") if "alike" in rules.columns else F.transform("tokens", lambda x: F.array(x))
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("need"), F.posexplode(places).alias("at", "token"))
    index = index.withColumn("token", F.explode("token"))
    hits = token_sets.select("set_id", F.explode("tokens").alias("token")).join(index, "token").drop("token")
    if "alike" in rules.columns:
        hits = hits.distinct()
    return hits.groupBy("set_id", "rule_id", "need", "confidence").agg(F.count("*").alias("n")).filter("n = need").drop("n")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Which token sets a mined rule matches, by inverted index: columns set_id, rule_id, confidence (one best row a set).

    token_sets: set_id, tokens (distinct token sets).
    """
    best = fired_rules(token_sets, rules).groupBy("set_id").agg(F.max(F.struct("confidence", F.col("rule_id"))).alias("b"))
    return best.select("set_id", F.col("b.rule_id").alias("rule_id"), F.col("b.confidence").alias("confidence"))


def filter_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", **mining
) -> DataFrame:
    """Judge every URL.

    labelled: columns `url`, `block` (boolean).  Result: `id_col`, host, path, rule, verdict, mined_rule (the id of
    the mined rule that matched, if any) and confidence.  A configured rule overrules the mined ones.
    """
    lh, lp = host_path(F.col("url"))
    mined = mine_rules(labelled.select(url_tokens(lh, lp, F.col("url")).alias("tokens"), "block"), **mining)
    host, path = host_path(F.col(url_col))
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.col(url_col).alias("_url"))
    base = base.withColumn("_tokens", F.array_sort(url_tokens(F.col("host"), F.col("path"), F.col("_url"))))
    base = base.withColumn("_set", F.xxhash64("_tokens", F.size("_tokens")))
    sets = base.groupBy(F.col("_set").alias("set_id"), F.col("_tokens").alias("tokens")).agg(F.count("*").alias("_n"))
    best = match_rules(sets, mined).withColumnRenamed("rule_id", "mined_rule")
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    judged = base.join(best, base["_set"] == best["set_id"], "left")
    return judged.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "mined_rule", "confidence",
    )

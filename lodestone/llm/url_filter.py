"""URL filtering: fixed host-and-path rules, and association rules mined from labelled URLs.

A URL's items are its host's labels, its path's segments and its query's keys.  Spark's FP-growth mines combinations of
items that occur with the class item of blocked examples; rules pruned by support and confidence, and by any shorter
rule that already covers them, go into an inverted index from item to rules.  A URL is blocked if all items of a rule
are its own: its items are joined with the index, and matches counted against the rule's size.

FP-growth sees an example's rarest items only, as it would else make every subset of a path of hundreds of segments.  Where
that leaves items out, its rules are counted again on whole examples, and the rules it can't know are sought for each URL's
own items, the most promising sets first, until one is found or none is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.store import broadcast_if_small, table

#: (verdict, rule): a host, with its subdomains, and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The class item of blocked examples; no URL's item begins so.
BLOCKED = "=block"
#: Index entries are broadcast up to this many.
BROADCAST_ENTRIES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # (A-Z in lower case), then up to ? #; both empty without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        host, slash, path = r.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _items() -> Column:
    """Items of columns url, host and path."""
    query = F.regexp_replace(F.regexp_extract("url", r"(?s)^.*?://[^?#]*\?([^#]*)", 1), r"=[^&]*", "")
    some = lambda s, sep, mark: F.transform(F.array_remove(F.split(s, sep), ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(some(F.col("host"), r"[.:@]", "h:"), some(F.col("path"), "/", "p:"), some(F.coalesce(query, F.lit("")), "&", "q:")))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.range(0).select("id", F.lit(0).alias("size"), F.lit("").alias("part"), F.lit("").alias("item"))


@dataclass(frozen=True)
class Mined:
    """index: (id, size, part, item) of rules.  If examples had more parts than were mined: `held`, (row, blocked, part, cut) of all
    their parts that make no rule alone, cut being those left out; and `members`, (part, item).  A rule has `least` blocked examples."""

    index: DataFrame
    held: DataFrame | None = None
    members: DataFrame | None = None
    least: int = 1


def mine_rules(examples: DataFrame, min_support: float, min_count: int, min_confidence: float, max_items: int = 16) -> Mined:
    """(items, blocked) examples -> the inverted index of the rules that say block.

    A rule's items and the class must occur together in min_count examples and in min_support of them.  Items that occur
    in just the same examples are one part of a rule, which any of them fills; an item that makes a rule alone is in no
    longer one; and an example is mined by its max_items rarest parts, so that the combinations stay bounded for paths of any length.
    Rules are true of whole examples; those that are missed, search_rules() finds: they hold a part left out of one of their examples.
    """
    spark = examples.sparkSession
    n = examples.count()
    if not n:
        return Mined(_nothing(spark))
    least = max(min_count, math.ceil(min_support * n), 1)
    keyed = table(examples.withColumn("row", F.monotonically_increasing_id()))
    flat = keyed.select("row", "blocked", F.explode("items").alias("item"))
    mark = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    counted = flat.groupBy("item").agg(F.count("*").alias("times"), F.count_if("blocked").alias("bad"), mark(1).alias("s1"), mark(2).alias("s2")).where(f"bad >= {least}")
    counted = table(counted)
    kin = ["times", "bad", "s1", "s2"]
    parts = table(counted.groupBy(*kin).agg(F.min("item").alias("part")))
    members = counted.join(parts, kin).select("part", "item")
    counted = parts.select(F.col("part").alias("item"), "times", "bad")
    single = counted.where(f"bad >= {min_confidence} * times")
    rest = counted.where(f"bad < {min_confidence} * times").select("item", "times")
    held = flat.select("row", "item").join(broadcast_if_small(rest), "item").groupBy("row").agg(F.expr("transform(array_sort(collect_list(struct(times, item))), x -> x.item)").alias("parts"))
    held = table(keyed.select("row", "blocked").join(held, "row"))
    items = F.slice("parts", 1, int(max_items))
    baskets = held.select(F.when(F.col("blocked"), F.array_append(items, BLOCKED)).otherwise(items).alias("items"))
    whole = held.where(F.size("parts") > int(max_items)).isEmpty()
    all_parts = None if whole else table(held.select("row", "blocked", F.posexplode("parts").alias("i", "part")).select("row", "blocked", "part", (F.col("i") >= int(max_items)).alias("cut")))
    alone = single.select(F.array("item").alias("items"))
    if rest.isEmpty():
        found = alone
    else:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=min_confidence).fit(baskets)
        rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED))).select(F.array_sort("antecedent").alias("items"))
        found = alone.unionByName(_needed(rules if whole else _true(rules, all_parts, min_confidence)))
    index = found.select(F.xxhash64("items").alias("id"), F.size("items").alias("size"), F.explode("items").alias("part"))
    return Mined(table(index.join(members, "part").select("id", "size", "part", "item")), all_parts, members, least)


def _true(rules: DataFrame, held: DataFrame, min_confidence: float) -> DataFrame:
    """The (items) that keep their confidence when counted on whole examples."""
    rules = table(rules.withColumn("id", F.monotonically_increasing_id()))
    fit = rules.select("id", F.size("items").alias("size"), F.explode("items").alias("part")).join(held, "part").groupBy("id", "size", "row", "blocked").agg(F.count("*").alias("n")).where("n = size")
    return rules.join(fit.groupBy("id").agg(F.count_if("blocked").alias("bad"), F.count("*").alias("times")).where(f"bad >= {min_confidence} * times"), "id").select("items")


def _needed(rules: DataFrame) -> DataFrame:
    """The (items) of which no part with one item less is a rule itself, as such a part matches wherever they do."""
    rules = table(rules.withColumn("id", F.xxhash64("items")))
    parts = rules.select("id", F.explode(F.transform("items", lambda x: F.xxhash64(F.array_remove("items", x)))).alias("part"))
    covered = parts.join(rules.select(F.col("id").alias("part")), "part", "left_semi").select("id").distinct()
    return rules.join(covered, "id", "left_anti").select("items")


def match_rules(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The distinct url of (url, host, path) rows whose items fill all parts of some rule."""
    index = broadcast_if_small(index, BROADCAST_ENTRIES)
    once = urls.select("url", "host", "path").distinct()
    found = once.select("url", F.explode(_items()).alias("item")).join(index, "item")
    found = found.select("url", "id", "size", "part").distinct()
    return found.groupBy("url", "id").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n = size").select("url").distinct()


def search_rules(urls: DataFrame, mined: Mined, min_confidence: float, width: int = 4) -> DataFrame:
    """The distinct url of (url, host, path) rows that fill all parts of a rule which mine_rules() may have missed.

    A search for each set of parts that URLs have, over its subsets, each made once: a subset's children add one of the parts that stand
    behind its last one, best first.  A missed rule holds a part cut from an example that it fits, so subsets begin with such
    parts, and go no further where no example with cut parts, or too few blocked ones, fit.  Parts that tell no examples apart are left out, and so
    is a subset if too many allowed examples have all that may be added.  Each round takes the `width` most promising subsets of each
    set, twice as many as the round before; all others wait in a table.
    """
    held = mined.held
    once = urls.select("url", "host", "path").distinct()
    cuts = held.where("cut").select("part").distinct().withColumn("early", F.lit(0))
    parts = mined.members.join(held.select("part").distinct(), "part", "left_semi")
    own = once.select("url", F.explode(_items()).alias("item")).join(parts, "item").select("url", "part").distinct().join(cuts, "part", "left")
    own = own.groupBy("url").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("early", F.lit(1)).alias("late"), "part"))).alias("all"))
    own = table(own.where("all[0].late = 0").withColumn("p", F.xxhash64("all")))
    behind = lambda parts: F.expr(f"transform(slice({parts}, i + 2, size({parts})), x -> x.part)").alias("tail")
    sets = own.select("p", "all").dropDuplicates(["p"]).select("p", "all", F.posexplode("all").alias("i", "x")).where("x.late = 0 and i + 1 < size(all)")
    nodes = table(sets.select("p", F.array("x.part").alias("parts"), behind("all"), F.lit(0.0).alias("score")))
    marked = held.join(held.where("cut").select("row").distinct().withColumn("long", F.lit(True)), "row", "left").select("row", "blocked", "part", F.coalesce("long", F.lit(False)).alias("long"))
    marked, won = table(marked), table(nodes.where("false").select("p"))
    order = Window.partitionBy("p").orderBy(F.desc("score"), "parts")
    while not nodes.isEmpty():
        ranked = nodes.withColumn("place", F.row_number().over(order))
        picked = table(ranked.where(f"place <= {width}").drop("place").withColumn("node", F.monotonically_increasing_id()))
        waiting = ranked.where(f"place > {width}").drop("place")
        fit = picked.select("node", F.size("parts").alias("size"), F.explode("parts").alias("part")).join(marked, "part")
        fit = table(fit.groupBy("node", "size", "row", "blocked", "long").agg(F.count("*").alias("n")).where("n = size").select("node", "row", "blocked", "long"))
        total = fit.groupBy("node").agg(F.count_if("blocked").alias("all_bad"), F.count("*").alias("all_times"))
        pairs = table(fit.join(picked.select("node", F.explode("tail").alias("part")), "node").join(marked.select("row", "part"), ["row", "part"]))
        more = pairs.groupBy("node", "part").agg(F.count_if("blocked").alias("bad"), F.count("*").alias("times"), F.count_if("long").alias("longs"))
        more = table(more.where(f"bad >= {mined.least} and longs > 0").join(total, "node").where("times < all_times").join(picked.select("node", "p", "parts"), "node"))
        won = table(won.unionByName(more.where(f"bad >= {min_confidence} * times").select("p")).distinct())
        kin = more.groupBy("node", "p", "parts", "all_bad").agg(F.array_sort(F.collect_list(F.struct((-F.col("bad") / F.col("times")).alias("worse"), "part"))).alias("kids"))
        stuck = pairs.where("not blocked").join(more.select("node", "part"), ["node", "part"]).groupBy("node", "row").agg(F.count("*").alias("n"))
        stuck = stuck.join(kin.select("node", F.size("kids").alias("size")), "node").where("n = size").groupBy("node").agg(F.count("*").alias("stuck"))
        kin = kin.join(stuck, "node", "left").where(f"all_bad >= {min_confidence} * (all_bad + coalesce(stuck, 0))")
        new = kin.select("p", "parts", "kids", F.posexplode("kids").alias("i", "x")).where("i + 1 < size(kids)")
        new = new.select("p", F.array_append("parts", F.col("x.part")).alias("parts"), behind("kids"), (-F.col("x.worse")).alias("score"))
        nodes, width = table(waiting.unionByName(new).join(won, "p", "left_anti")), 2 * width
    return own.join(won, "p", "left_semi").select("url")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame | None = None,
    *,
    rules=RULES,
    min_support: float = 0.002,
    min_count: int = 10,
    min_confidence: float = 0.9,
    max_items: int = 16,
) -> DataFrame:
    """page_id, host, path, rule and verdict (block or allow) of every row of `pages` (page_id, url; others are ignored).

    The longest fixed rule decides; where none fits, a mined rule blocks, and all else is allowed.  Examples are the pages
    that a fixed rule decides, with its verdict, and of the others those that `labels` (doc_id, quality, toxic) have
    under their page_id: quality 0 or toxic 1 is a blocked example.  A page with several labels is blocked if any says so.
    Without rules and labels nothing is mined.  A null url or one without :// has an empty host and path and is allowed.
    Repeated rows are judged alike; `rules` is a short list.  max_items says what FP-growth mines, and doesn't change results.
    """
    host, path = host_and_path()
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(rules)
    judged = pages.withColumns({"rule": rule, "verdict": verdict})
    settled = judged.where("rule is not null or url is null")
    others = judged.where("rule is null and url is not null")
    examples = judged.where("rule is not null").select(_items().alias("items"), (F.col("verdict") == "block").alias("blocked"))
    if labels is not None:
        bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
        known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("blocked"))
        examples = examples.unionByName(others.join(known, "page_id").select(_items().alias("items"), "blocked"))
    mined = mine_rules(examples, min_support, min_count, min_confidence, max_items)
    found = table(match_rules(others, mined.index))
    if mined.held is not None:
        found = table(found.unionByName(search_rules(others.join(found, "url", "left_anti"), mined, min_confidence)))
    blocked = broadcast_if_small(found.withColumn("mined", F.lit("block")))
    out = others.join(blocked, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit("allow")).alias("verdict"))
    return settled.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")).unionByName(out)

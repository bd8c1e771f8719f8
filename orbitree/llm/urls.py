"""URL filters (operator 12): rules and host lists in Bloom filter cascades.

A rule names a host and the start of a path; it fits urls of the host and its subdomains. The keys
a url could match are its host's suffixes joined with its path's beginnings, in the lengths that
occur in the list. Those of the whole corpus are the universe of a cascade, which then judges
each url's keys exactly, longest first, without a join with the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitree.llm.cascade import build_cascade
from orbitree.llm.shared import materialize

# The rules of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Words that give a host away where they make up a part of its name between dots and hyphens.
HOST_WORDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "jackpot", "malware", "phishing", "pills", "poker", "porn", "replica", "slots", "spam", "viagra", "warez", "xxx")
#: Characters of a host name at most (as in DNS); longer ones aren't listed by their words.
HOST_CHARS = 253
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ://, A-Z lower-cased; path up to ? or #; null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def listed_by_words(pages: DataFrame, words: tuple[str, ...] = HOST_WORDS) -> DataFrame:
    """(host): hosts of the pages with a listed word as a part of their name, from the label that holds
    the last such word on (www.spam-farm.example.com lists spam-farm.example.com)."""
    host = split_url(F.col("url"))[0]
    pattern = r"(?:^|\.)((?:[^.]*-)?(?:" + "|".join(words) + r")(?:-[^.]*)?(?:\.[^.]*)*)$"
    names = pages.select(host.alias("host")).where((F.length("host") <= HOST_CHARS) & (F.col("host") != "")).distinct()
    return names.select(F.regexp_extract("host", pattern, 1).alias("host")).where("host != ''").distinct()


def _keys(listed: DataFrame) -> Column:
    """All keys that a url (names, path) can have in a list, longest first; of one length, those of the longer
    host first. Their shape is that of the list: host suffixes of its numbers of labels, path beginnings of its lengths."""
    most = listed.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    names, lengths = F.col("names"), F.array(*(F.lit(n) for n in sorted(most["lengths"], reverse=True)))
    labels = F.sequence(F.least(F.size(names), F.lit(most["labels"])), F.lit(1), F.lit(-1))
    hosts = F.transform(labels, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(names, F.size(names) - n + 1, n), ".").alias("host")))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda n: F.struct((-F.length(h["host"]) - n).alias("rank"), (-h["n"]).alias("labels"), F.concat(h["host"], F.substring(F.col("path"), F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def _best(rows: DataFrame, urls: DataFrame, listed: DataFrame, name: str, block_words: int) -> DataFrame:
    """Adds ``name``: the longest listed key (host, path) of each url, null if there is none."""
    if listed.isEmpty():
        return rows.withColumn(name, F.lit(None).cast("string"))
    keys = _keys(listed)
    candidates = urls.select(F.explode(keys).alias("key")).distinct()
    marked = listed.select(F.concat("host", "path").alias("key")).distinct().withColumn("listed", F.lit(True))
    universe = materialize(candidates.join(marked, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "universe")
    judged = build_cascade(universe, block_words).listed(rows.withColumn(name, keys), name)
    return judged.withColumn(name, F.get(name, F.lit(0)))


def judge_urls(pages: DataFrame, rules: DataFrame, hosts: DataFrame, block_words: int = 1 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every page.

    ``rules`` (host, path, verdict allow or block): the longest that fits decides; of two of one length the
    one of the longer host, of one rule with both verdicts block. Otherwise a page is blocked if
    its host or a parent of it is in ``hosts`` (host), which ``listed`` says, and allowed if not. Rules and
    hosts with a null or an empty host are left out, a null path is empty. A null url or one
    without :// has an empty host and path, so that nothing fits. Repeated pages are judged each;
    an empty table gives no rows; other columns are ignored."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("names", F.split("host", r"\."))
    urls = rows.where("host != ''").select("names", "path")
    rules = materialize(rules.where("host != '' and verdict in ('allow', 'block')").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"), "rules")
    lists = materialize(hosts.where("host != ''").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.lit("").alias("path")).distinct(), "hosts")
    blocking = rules.where("verdict = 'block'").select("host", "path")
    allowing = rules.where("verdict = 'allow'").join(blocking, ["host", "path"], "left_anti").select("host", "path")
    for name, listed in (("allowed", allowing), ("blocked", blocking), ("list_key", lists)):
        rows = _best(rows, urls, listed, name, block_words)
    labels = lambda key: F.size(F.split(F.regexp_extract(key, r"^[^/]*", 0), r"\."))
    rank = lambda key: F.struct(F.coalesce(F.length(key), F.lit(-1)), F.coalesce(labels(key), F.lit(0)))
    block = rank(F.col("blocked")) > rank(F.col("allowed"))
    rule = F.when(block, F.col("blocked")).otherwise(F.col("allowed"))
    inlist = F.col("list_key").isNotNull()
    verdict = F.when(rule.isNotNull(), F.when(block, "block").otherwise("allow")).when(inlist, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), inlist.alias("listed"))


def url_sql(rules: tuple[tuple[str, str, str], ...] = RULES, words: tuple[str, ...] = HOST_WORDS) -> str:
    """The same in SQL: rules and hosts are compared one by one."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH p AS (SELECT ROW_NUMBER() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
u AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES {listed}),
names AS (SELECT DISTINCT host FROM u WHERE host != '' AND length(host) <= {HOST_CHARS}),
bad AS (SELECT DISTINCT regexp_extract(host, '(?:^|\\.)((?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?(?:\\.[^.]*)*)$', 1) AS bhost FROM names),
inlist AS (SELECT DISTINCT host FROM u JOIN bad ON bhost != '' AND (host = bhost OR ends_with(host, '.' || bhost))),
fit AS (SELECT row, rhost || rpath AS rule, rverdict, ROW_NUMBER() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, u.host, path, rule, COALESCE(rverdict, CASE WHEN inlist.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, inlist.host IS NOT NULL AS listed
FROM u LEFT JOIN fit ON fit.row = u.row AND k = 1 LEFT JOIN inlist ON inlist.host = u.host
"""

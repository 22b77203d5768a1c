"""URL filtering by association rules, with DataFrame functions only.

The tokens of labelled URLs (host labels, path segments, parameter names, fragments) and a mark for
unwanted ones are transactions; FP-growth finds the token combinations that go with the mark. Only least
rules are kept: one whose part is a rule itself judges no further URL. So a token that is a rule alone takes
no part in the mining, and neither do tokens that too few unwanted URLs hold; of tokens that stand in the same
URLs, one does. FP-growth lists all frequent combinations of a URL's tokens, which double with each token. Where
a URL has more than ``JOINT`` of them, the least rules are grown token by token instead, without those
combinations that no least rule can hold; both ways find the same rules. What is mined is counted again over
all tokens of all URLs. Rules match URLs through an inverted index: each rule is filed under its rarest
token, a URL's tokens look up the rules, and the remaining tokens are compared. Rules given by hand come
first: the longest that fits the host and the path decides.

Scale: every URL is judged once however often it occurs. Tokens that may be mined are bounded by the
support: no more than the tokens of an average unwanted URL over it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNWANTED = "unwanted!"
SUPPORT = 0.0005
#: Rows that a combination must occur in, however few there are.
LEAST = 20
#: Share of a combination's URLs that must be unwanted.
CONFIDENCE = 0.6
#: Tokens that take part in the mining, of one URL, up to which FP-growth is used.
JOINT = 8


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Different tokens of a URL: host labels, path segments with digits as 0, parameter names, the fragment."""
    rest = F.translate(_rest(url), UPPER, LOWER)
    hosts = F.transform(F.split(host_of(url), "[.:]"), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(
        F.split(F.regexp_replace(F.translate(path_of(url), UPPER, LOWER), "[0-9]+", "0"), "/"),
        lambda x: F.concat(F.lit("path:"), x),
    )
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    end = F.array(F.concat(F.lit("end:"), F.regexp_extract(rest, "#(.*)$", 1)))
    return F.filter(F.array_distinct(F.concat(hosts, parts, names, end)), lambda x: ~x.endswith(":"))


def _fp_growth(held: DataFrame, least: float, confidence: float) -> DataFrame:
    """``antecedent``: sets of two ``tokens`` or more that go with ``bad``, in ``least`` rows or more."""
    held = held.filter(F.size("tokens") > 1)
    n = max(held.count(), least)
    items = held.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(UNWANTED))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=confidence).fit(items)
    rules = model.associationRules.filter(F.element_at("consequent", 1) == UNWANTED).filter(F.size("antecedent") > 1)
    return rules.select(F.array_sort("antecedent").alias("antecedent"))


def _grown(held: DataFrame, least: float, confidence: float) -> DataFrame:
    """``antecedent``: the least rules of two ``tokens`` or more, in ``least`` bad rows or more, grown by a token
    at a time from sets that are no rules.

    A set grows no further if a token of it leaves out no good row of the others: in a rule that holds it, the
    others would do as well. Nor does it if, of its kinds of rows, no choice would make a rule, as rows of
    one kind, that is of equal tokens, are in the same sets.
    """
    share = F.col("hits") / F.col("n")
    sure, rest = share >= confidence, F.when(share < confidence, share)
    sums = [
        F.sum("n").alias("n"),
        F.sum("hits").alias("hits"),
        F.sum(F.when(sure, F.col("hits")).otherwise(0)).alias("sure"),
        F.sum(F.when(sure, F.col("hits") - confidence * F.col("n")).otherwise(0)).alias("over"),
        F.coalesce(F.max(rest), F.lit(0.0)).alias("next"),
    ]
    # unwanted rows of kinds that are rules, and those of others which these can make up for
    reach = F.col("sure") + F.col("over") * F.col("next") / (confidence - F.col("next"))
    can_grow = (F.col("hits") / F.col("n") < confidence) & (reach > least - 0.001)

    def kinds(rows: DataFrame, n, hits) -> DataFrame:
        return rows.groupBy("tokens").agg(n.alias("n"), hits.alias("hits"))

    def started(rows: DataFrame) -> DataFrame:
        return rows.select("n", "hits", "tokens", F.posexplode("tokens")).select(
            "n", "hits", F.array("col").alias("antecedent"), F.slice("tokens", F.col("pos") + 2, F.size("tokens")).alias("more")
        )

    rows = durable(
        kinds(held.withColumn("tokens", F.array_sort("tokens")), F.count("*"), F.count_if("bad")).withColumn(
            "kind", F.monotonically_increasing_id()
        )
    )
    live = durable(started(rows).groupBy("antecedent").agg(*sums).filter(can_grow).withColumn("good", F.col("n") - F.col("hits")))
    left = rows.select("kind", "n", "hits", F.explode("tokens").alias("token")).join(
        live.select(F.col("antecedent")[0].alias("token")), "token", "left_semi"
    )
    left = left.groupBy("kind", "n", "hits").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    sets = durable(started(kinds(left, F.sum("n"), F.sum("hits"))))
    found = live.select("antecedent").filter("false")
    size = 1
    while not live.isEmpty():
        size += 1
        longer = sets.join(live, "antecedent", "left_semi").select("n", "hits", "antecedent", "more", F.posexplode("more"))
        sets = durable(
            longer.select(
                "n",
                "hits",
                F.array_append("antecedent", F.col("col")).alias("antecedent"),
                F.slice("more", F.col("pos") + 2, F.size("more")).alias("more"),
            )
        )
        counted = durable(sets.groupBy("antecedent").agg(*sums).filter(F.col("hits") >= least))
        part = F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t)))
        whole = (
            counted.select("antecedent", (F.col("n") - F.col("hits")).alias("good"), part.alias("part"))
            .join(live.select(F.col("antecedent").alias("part"), F.col("good").alias("more")), "part")
            .filter(F.col("good") < F.col("more"))
            .groupBy("antecedent", "good")
            .count()
            .filter(F.col("count") == size)
        )
        counted = durable(counted.join(whole.select("antecedent", "good"), "antecedent"))
        found = durable(found.union(counted.filter(F.col("hits") / F.col("n") >= confidence).select("antecedent")))
        live = counted.filter(can_grow)
    return found


def mine(
    labelled: DataFrame,
    url: str,
    unwanted: str,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    least: int = LEAST,
    joint: int = JOINT,
) -> DataFrame:
    """``antecedent, key, confidence, support``: least token combinations of which at least ``confidence`` are
    unwanted, over rows with a URL and a boolean ``unwanted``; ``key`` is the rarest token of each. No rule
    holds another. Of tokens that stand in the same rows a combination names the first only; each of them that
    is a rule alone is listed.

    Rows with a null URL or mark teach nothing; repeated rows count as often as they occur. With fewer
    than ``least`` rows there are no rules. URLs may have any number of tokens; ``joint`` decides how they are
    mined, not what is found.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(url).isNotNull() & F.col(unwanted).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(unwanted).alias("bad"), tokens_of(F.col(url)).alias("tokens")
    )
    rows = durable(rows.filter(F.size("tokens") > 0))
    n = rows.count()
    if n < least:
        return spark.createDataFrame([], "antecedent array<string>, key string, confidence double, support double")
    enough = max(support * n, least)
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    mark = F.xxhash64("row")
    # the sums of two tokens' marks are equal where their rows are
    tokens = durable(
        each.groupBy("token")
        .agg(F.count("*").alias("n"), F.count_if("bad").alias("hits"), F.sum(mark.cast("decimal(20)")).alias("sum"), F.bit_xor(mark).alias("xor"))
        .filter(F.col("hits") >= enough)
        .withColumn("confidence", F.col("hits") / F.col("n"))
    )
    single = tokens.filter(F.col("confidence") >= confidence).select(
        F.array("token").alias("antecedent"), F.col("token").alias("key"), "confidence", (F.col("hits") / n).alias("support")
    )
    mined = tokens.filter(F.col("confidence") < confidence)
    mined = mined.groupBy("n", "sum", "xor", "confidence").agg(F.min("token").alias("token"))
    held = durable(
        each.join(mined.select("token"), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("tokens"))
    )
    longest = held.agg(F.max(F.size("tokens"))).first()[0] or 0
    if longest < 2:
        return durable(single)
    rules = (_fp_growth if longest <= joint else _grown)(held, enough, confidence)
    keyed = durable(
        rules.withColumn("token", F.explode("antecedent"))
        .join(mined.select("token", "n"), "token")
        .groupBy("antecedent")
        .agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    )
    filed = durable(
        held.withColumn("key", F.explode("tokens"))
        .join(keyed, "key")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("antecedent", "key")
        .agg(F.count("*").alias("n"), F.count_if("bad").alias("hits"))
        .select("antecedent", "key", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support"))
        .filter(F.col("confidence") >= confidence)
    )
    part = filed.select(F.col("antecedent").alias("part"), "key")
    holds = (
        filed.select("antecedent", F.explode("antecedent").alias("key"))
        .join(part, "key")
        .filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    )
    return durable(filed.join(holds.select("antecedent"), "antecedent", "left_anti").select("antecedent", "key", "confidence", "support").unionByName(single))


def match(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``url, mined, confidence``: for each different URL that meets a rule, its rule of highest confidence
    (then of most tokens, then the first by name), the tokens joined by spaces."""
    looked = urls.select(F.col(url).alias("url")).filter("url is not null").distinct().withColumn("tokens", tokens_of(F.col("url")))
    found = (
        looked.withColumn("key", F.explode("tokens"))
        .join(rules, "key")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    name = F.array_join("antecedent", " ")
    return (
        found.groupBy("url")
        .agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), name.alias("mined"))).alias("best"))
        .select("url", "best.mined", "best.confidence")
    )


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``(verdict, host, path)`` rules that fits, as text and as verdict; null if none fits.
    A rule fits its host and all subdomains where the path starts with the rule's."""
    text = verdict = F.lit(None).cast("string")
    for what, site, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        text = F.when(fits, F.lit(site + start)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def judge(
    pages: DataFrame,
    mined: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined, confidence``: the verdict of the fitting rule, else
    ``block`` where a mined rule matches and ``allow`` elsewhere.

    Null URLs and those without ``://`` have an empty host and path. Rows keep their number, also those
    that share an id or a URL. Other columns play no part.
    """
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    best = match(plain, "url", mined)
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return (
        plain.join(best, "url", "left")
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumns({"rule": text, "given": verdict})
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("given", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            "mined",
            "confidence",
        )
    )

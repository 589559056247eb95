"""URL verdicts: host and path rules, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The labelled table: site names of unwanted and of wanted pages, under the same domains and paths. They are written from
#: what such sites are called anywhere; none is a host of the tables that the tests read.
UNWANTED = (
    "casino-online online-casino casino-royal grand-casino-slots bet-win sport-bets bet365-bonus bets-today live-bets poker-bonus slots-free jackpot-win "
    "lucky-slots spin-win roulette-win pills-online buy-pills diet-pills pills4you cheap-meds viagra-cheap cheap-viagra pharmacy-deals cheap-pharmacy "
    "ad-server ads-click adserver ads-banner trackads track-pixel pixel-track click-ads popup-ads banner-track user-track free-money free-cash free-gifts "
    "fast-loans payday-loans cheap-loans win-prize free-prize win-money xxx-video adult-cams sexy-chat hot-singles replica-watches cheap-watches "
    "cheap-bags crypto-win free-crypto torrent-free warez-crack keygen-crack essay-buy buy-followers buy-likes seo-links cheap-seo "
    "spam-mail spam-links spam-bots link-farm click-farm adult-dating adult-films adult-only"
).split()
WANTED = (
    "news library museum university theatre garden science history recipes weather docs wiki archive journal research schools health "
    "travel gallery music literature nation theory thread thing nature ocean mountain river station edition notion athens therapy thermal "
    "thriving thistle whether others thousand hearing interest attention intention threshold northern southern other another weather-station "
    "thinking theatres gathering brother mother father eastern western indoor outdoor onward reading writing teaching learning training "
    "information education translation foundation tradition relation conservation restoration orientation "
    "theory-notes open-source the-house county-council art-school green-energy city-hall book-club data-notes winter-garden "
    "family-farm farm-shop farmers-market mail-order mail-archive early-adulthood film-club track-and-field freedom-trail better-reading "
    "betterment alphabet tibet adsorption roads-and-paths heads-and-hands pillars caterpillar spillway window-design"
).split()
SUBDOMAINS, DOMAINS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "site.com")
PATHS = ("/en/{}", "/fr/{}/", "/de/{}.html", "/es/{}", "/", "/article/{}", "")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, unwanted 0.0 or 1.0): each site name once for each of the paths; a bounded table, about 1,200 rows."""
    rows = []
    for unwanted, names in ((1.0, UNWANTED), (0.0, WANTED)):
        for i, name in enumerate(names):
            for j, path in enumerate(PATHS):
                host = SUBDOMAINS[(i + j) % 4] + name + "." + DOMAINS[(i + j // 2) % 4]
                rows.append((f"https://{host}{path.format(7 * i + 13 * j)}", unwanted))
    return spark.createDataFrame(rows, "url string, unwanted double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty if url is null or has no '://'."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), A_Z, a_z), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Distinct character n-grams of host and path, each told apart by a letter in front.

    Each size is the one before it joined with the characters further on, so that a text is split and gone through a few
    times, whatever its length; a lambda that named the split text would split it again at each place.
    """

    def of(text: Column, mark: str) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        run, out = F.transform(chars, lambda c: F.concat(F.lit(mark), c)), []
        for n in range(2, max(sizes) + 1):
            further = F.slice(chars, n, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
            run = F.zip_with(run, further, lambda a, b: F.concat(a, b))  # null where the text ends
            if n in sizes:
                out.append(F.filter(run, lambda g: g.isNotNull()))
        return F.flatten(F.array(*out))

    return F.array_distinct(F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), "h"), of(F.concat(path, F.lit("$")), "p")))


def fit(labelled: DataFrame, buckets: int = 1 << 16):
    """The pipeline of hashing and regression, fitted to labelled(url, unwanted)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    host, path = host_and_path(F.col("url"))
    hashing = HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="vector")
    regression = LogisticRegression(featuresCol="vector", labelCol="unwanted", regParam=0.002, maxIter=60, probabilityCol="odds", standardization=False)
    return Pipeline(stages=[hashing, regression]).fit(labelled.select(grams(host, path).alias("grams"), "unwanted").coalesce(1))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The verdict and text of the longest rule that fits; null where none does."""
    longest = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]))
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in longest:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        verdict, rule = F.when(fits, F.lit(kind)).otherwise(verdict), F.when(fits, F.lit(h + p)).otherwise(rule)
    return verdict, rule


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each row of pages(page_id, url): page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; else the regression, fitted to `labelled` (its bound is the table's size),
    which blocks at a probability of `threshold` or more. score: that probability, for every url.

    Null url, or none with '://': empty host and path, judged by the regression. Null page_id: kept. Repeated rows: one
    result each. Empty table: no rows. Other columns are not read.
    """
    from pyspark.ml.functions import vector_to_array

    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = model.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path"))))
    score = vector_to_array("odds")[1]
    verdict, rule = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), score.alias("score"))

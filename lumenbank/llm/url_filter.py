"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbank.llm.common import saved

# The rules of the URL query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# Words of the labelled URLs below. Topics of unwanted hosts, of hosts that serve adverts or count visits,
# names that such hosts imitate, and ordinary words.
UNWANTED = (
    "adult bet bets bingo blackjack bonus bride casino cheap cialis click clickbait coupon coupons crypto dating deal diet discount download escort farm forex free gamble gambling gold jackpot keygen loan loans "
    "lottery lucky miracle mortgage nude payday pill pills poker porn prize profit promo replica rich roulette sale sex slots spam steroids torrent viagra voucher warez watches weightloss win winner xxx"
).split()
COUNTING = "ad ads adserver adserv adsystem advert affiliate beacon banner bidder clicks collect counter impression metrics pixel popunder redirect retarget stats sync tag tags telemetry track tracker tracking traffic".split()
IMITATED = "account bank billing confirm mail office pay secure signin support update verify wallet webmail".split()
ORDINARY = (
    "academy air archive art bank bird board book bread bridge care city class cloud club coast corner craft daily data design earth east field film fish flower food forest forum garden gate glass green group hall "
    "health hill history home house journal kitchen lake land law library light linux maker map market math medicine metal mill moon mountain museum music nature news north ocean open paper park photo plant play post "
    "press project radio rail review river road school science sea sky snow soft south space sport star stone store story street studio sun theatre times town trade travel tree valley view village walk water weather west wind wood world"
).split()
SUFFIXES, OFTEN_BAD, OFTEN_GOOD = ["com", "net", "org", "com", "net", "org", "info", "io"], ["top", "xyz", "click", "loan", "win", "bid", "icu"], ["edu", "gov", "de", "fr", "es", "eu", "uk"]

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "longest_value", "longest_label", "suffix_block", "word_block"]

#: Most labelled URLs that a fit takes, and most words and suffixes whose shares it keeps, the commonest.
FIT_ROWS, FIT_WORDS = 20_000, 2_000
FOLDS = 5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: then up to ``? #`` or the end."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.substr(whole, F.instr(whole, "://") + 3)).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``.

    A host asks for each of its suffixes at label borders in one equi-join,
    so millions of rules stay a hash lookup. The rows of one URL meet again
    in one array aggregation keyed by ``row_key``; a tie in length goes to
    the longer host, then to ``block``.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("row_key", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    fits = asked.join(rules, "rule_host").filter(F.startswith(F.col("path"), F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("row_key").agg(F.max(F.struct(F.length(name), F.length("rule_host"), F.col("rule_verdict"), name)).alias("best"))
    found = best.select("row_key", F.col("best.col4").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    return urls.join(found, "row_key", "left")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The same choice as :func:`match_rules` for a short literal rule list, as one expression without a join."""
    order = sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), reverse=True)
    fits = [(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), h + p, v) for h, p, v in order]
    pick = lambda k: reduce(lambda rest, f: F.when(f[0], F.lit(f[k])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(1), pick(2)


def entropy(text: Column) -> Column:
    """Bits a character of the distribution of a text's characters; zero for an empty text."""
    counts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda s, k: s - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path``; all are total, so an empty URL has zeros."""
    url = F.coalesce(F.col("url"), F.lit(""))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    values = F.transform(F.split(query, "&"), lambda p: F.length(F.regexp_replace(p, "^[^=]*=?", "")))
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)).cast("double"),
            "host_digits": F.length(F.regexp_replace("host", "[^0-9]", "")).cast("double"),
            "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
            "entropy": entropy(url),
            "host_entropy": entropy(F.col("host")),
            "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "longest_value": F.array_max(values).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "suffix": F.element_at(labels, -1),
            "words": F.array_distinct(F.filter(F.split("host", r"[^a-z]+"), lambda w: F.length(w) > 1)),
        }
    )


def labelled_table(unwanted=tuple(UNWANTED), counting=tuple(COUNTING), ordinary=tuple(ORDINARY), rows: int = 400) -> list[tuple[str, int, str]]:
    """The labelled URLs: url, 1 for block, and the family that made it.

    Made by rule from the word lists, ``rows`` of each family. Both classes have hyphens, digits, parameters, depth
    and the common suffixes, and half of the unwanted families hold no telling word.
    """
    r = random.Random(11)
    text = lambda n, chars: "".join(r.choice(chars) for _ in range(n))
    letters, hexes, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    scheme = lambda: r.choice(["http://", "https://"])
    number = lambda: r.choice(["", "", "", r.choice(["1", "2", "24", "360", "365", str(r.randint(1950, 2026))])])
    plain = lambda n=2: r.choice(["", "-", ""]).join(r.choice(ordinary) for _ in range(r.randint(1, n))) + number()
    slug = lambda: "-".join(r.choice(ordinary) for _ in range(r.randint(2, 6)))
    front = lambda: r.choice(["", "", "www.", "www.", "m.", "blog.", "shop.", "docs."])
    owner = lambda: r.choice(["", "", f"{r.choice(ordinary)}."])
    tail = lambda: r.choice(["", "", "/", ".html", "#top", "?page=2", "?utm_source=feed", f"?id={r.randint(1, 999)}", "?page=3&ref=x", "?q=" + r.choice(ordinary)])
    good, bad = SUFFIXES + OFTEN_GOOD, SUFFIXES + OFTEN_BAD
    common = lambda: r.choice(SUFFIXES) if r.random() < 0.7 else r.choice(bad)
    named = lambda: text(r.randint(4, 10), letters[: r.randint(4, 26)])
    spam = lambda: r.choice(["-", "-", "", "."]).join(r.sample([r.choice(unwanted), r.choice([*unwanted, *ordinary, "best", "online", "now", "x", "4u"])], 2))
    families = {
        "article": lambda: f"{scheme()}{front()}{plain()}.{owner()}{r.choice(good)}/{r.choice(['en', 'de', 'fr', 'es', 'news', 'post'])}/{r.randint(1, 2000)}{tail()}",
        "slug": lambda: f"{scheme()}{front()}{plain(3)}.{r.choice(good)}/{r.randint(2009, 2026)}/{r.randint(1, 12):02d}/{slug()}{tail()}",
        "deep": lambda: f"{scheme()}{front()}{plain()}.{r.choice(good)}/{'/'.join(r.choice(ordinary) for _ in range(r.randint(3, 7)))}{tail()}",
        "page": lambda: f"{scheme()}{front()}{plain()}.{r.choice(good)}{r.choice(['', '/', '/about', '/index.html', '/~' + r.choice(ordinary)])}",
        "shop": lambda: f"{scheme()}{front()}{plain()}.{r.choice(good)}/{r.choice(ordinary)}?{'&'.join(f'{r.choice(ordinary)}={r.choice([r.choice(ordinary), str(r.randint(1, 99999))])}' for _ in range(r.randint(1, 4)))}",
        "new name": lambda: f"{scheme()}{front()}{named()}{r.choice(['', '', '-' + named(), '-' + r.choice(ordinary)])}.{owner()}{r.choice(good)}/{r.choice(['en', 'de', 'fr', 'es', 'wiki'])}/{r.randint(1, 2000)}{tail()}",
        "service": lambda: f"{scheme()}{front()}{r.choice(IMITATED)}{r.choice(['', '-', '.'])}{plain()}.{owner()}{r.choice(good)}/{r.choice(['', 'login', 'en/' + str(r.randint(1, 999)), slug()])}{tail()}",
        "topic": lambda: f"{scheme()}{front()}{spam()}{r.choice(['', '', text(2, digits)])}.{owner()}{common()}/{r.choice(['', 'en/' + str(r.randint(1, 999)), slug(), 'de/' + str(r.randint(1, 999))])}{tail()}",
        "counter": lambda: f"{scheme()}{r.choice(counting)}{r.choice(['', '-', '.'])}{r.choice([*counting, *ordinary, text(2, digits)])}.{owner()}{common()}/{r.choice(['track', 'imp', 'b', 'c', 'click', 'pixel.gif', 'sync', 'r'])}{r.choice(['', '?' + '&'.join(text(r.randint(1, 3), letters) + '=' + text(r.randint(6, 32), hexes) for _ in range(r.randint(2, 7)))])}",
        "counted": lambda: f"{scheme()}{r.choice(['a', 'c', 'cdn', 's', 't', 'in', 'go'])}{number()}.{plain()}.{common()}/{text(r.randint(1, 3), letters)}?{'&'.join(text(r.randint(1, 3), letters) + '=' + text(r.randint(8, 40), hexes) for _ in range(r.randint(4, 9)))}",
        "random": lambda: f"{scheme()}{text(r.randint(12, 26), letters + digits)}.{r.choice(bad)}/{r.choice(['', text(8, hexes), text(16, hexes)])}",
        "imitation": lambda: f"{scheme()}{r.choice(IMITATED)}-{r.choice(IMITATED)}.{plain()}.{r.choice(ordinary)}{number()}.{text(5, letters)}.{r.choice(bad)}/{text(12, hexes)}/{r.choice(IMITATED)}.php{r.choice(['', '?session=' + text(24, hexes)])}",
        "address": lambda: f"http://{'.'.join(str(r.randint(1, 254)) for _ in range(4))}{r.choice(['', ':8080'])}/{text(r.randint(3, 10), hexes)}{r.choice(['', '.exe', '.php?id=' + text(12, hexes)])}",
    }
    block = ("topic", "counter", "counted", "random", "imitation", "address")
    return [("", 0, "empty")] * 10 + [(make(), int(name in block), name) for name, make in families.items() for _ in range(rows)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """:func:`labelled_table` as a frame (url, label)."""
    return spark.createDataFrame([row[:2] for row in labelled_table()], "url string, label int")


class UrlModel:
    """Boosted trees with the suffix and host-word statistics of the URLs they learned from."""

    def __init__(self, trees: GBTClassificationModel, suffixes: dict[str, float], words: dict[str, float], base: float):
        self.trees, self.suffixes, self.words, self.base = trees, suffixes, words, base

    @staticmethod
    def features(urls: DataFrame, suffixes: dict[str, float], words: dict[str, float], base: float) -> DataFrame:
        known = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]) if d else F.create_map().cast("map<string,double>")
        word = known(words)
        rates = F.transform("words", lambda w: F.coalesce(word[w], F.lit(base)))
        return lexical(urls).withColumns({"suffix_block": F.coalesce(known(suffixes)[F.col("suffix")], F.lit(base)), "word_block": F.coalesce(F.array_max(rates), F.lit(base))})

    @classmethod
    def fit(cls, labelled: DataFrame, trees: int = 20, depth: int = 4) -> UrlModel:
        """Learns from (url, label 1 = block); at most ``FIT_ROWS`` rows, those with the least hash.

        Shares of suffixes and words are smoothed with two rows of the overall
        share. A row learns from shares of the other FOLDS - 1 folds, so that its own label isn't in them.
        """
        host, path = split_url(F.col("url"))
        rows = labelled.select("url", "label").orderBy(F.xxhash64("url"), "url").limit(FIT_ROWS).withColumns({"row": F.monotonically_increasing_id(), "host": host, "path": path})
        seen = saved(lexical(rows).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))).coalesce(1))
        base = float(seen.agg(F.avg("label")).first()[0])
        share = lambda k, n: (k + 2 * base) / (n + 2)
        tally = lambda df, *keys: df.groupBy(*keys).agg(F.sum("label").alias("k"), F.count("*").alias("n"))
        common = lambda df, key: tally(df, key).filter("n >= 3").orderBy(F.desc("n"), key).limit(FIT_WORDS)
        each = seen.select("row", "fold", "label", F.explode("words").alias("w"))
        by_suffix, by_word = saved(common(seen, "suffix")), saved(common(each, "w"))

        def elsewhere(df: DataFrame, key: str, by: DataFrame) -> DataFrame:
            """A key's share in the other folds than one."""
            here = tally(df, key, "fold").withColumnsRenamed({"k": "own_k", "n": "own_n"})
            return F.broadcast(here.join(F.broadcast(by), key).select(key, "fold", share(F.col("k") - F.col("own_k"), F.col("n") - F.col("own_n")).alias("share")))

        own = each.join(elsewhere(each, "w", by_word), ["w", "fold"], "left").groupBy("row").agg(F.max(F.coalesce("share", F.lit(base))).alias("word_block"))
        ready = seen.join(elsewhere(seen, "suffix", by_suffix), ["suffix", "fold"], "left").withColumnRenamed("share", "suffix_block").join(own, "row", "left").fillna(base, ["word_block", "suffix_block"])
        frame = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready).select("row", "features", F.col("label").cast("double").alias("label")).coalesce(1).sortWithinPartitions("row")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=64, minInstancesPerNode=5).fit(frame)
        rates = lambda df: {r[0]: share(r.k, r.n) for r in df.collect()}
        return cls(model, rates(by_suffix), rates(by_word), base)

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``block_score`` from 0 to 1 to rows with ``url``, ``host`` and ``path``."""
        keep = urls.columns
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.features(urls, self.suffixes, self.words, self.base))
        return self.trees.transform(ready).select(*keep, vector_to_array("probability")[1].alias("block_score"))


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score for every row.

    Other columns of ``pages`` are ignored, so they may have any name. A null
    url, or one without ``://``, has an empty host and path and fits no rule.
    Repeated rows stay repeated. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return model.score(rows).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "block_score")

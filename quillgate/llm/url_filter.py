"""URL filtering: block and allow rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame functions. A tree level is one aggregation of gradient
histograms by (node, feature, bin); what reaches the driver is one split per
node. A trained model is an expression of nested CASE WHENs inside codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, line: str) -> Rule:
        verdict, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        return cls(verdict, host, slash + path)


RULES = tuple(map(Rule.parse, ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")))
#: Rules are written into the plan; longer lists belong in a table joined by host suffix.
MOST_RULES = 500


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; both empty without one or for null."""
    has = F.instr(url, "://") > 0
    rest = F.substr(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(empty), F.when(has, path).otherwise(empty)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null without one; the longer host breaks a tie."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are inlined, got {len(rules)}")
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a url, all double; null and empty urls give zeros."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    size = F.greatest(n, F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    each = {
        "length": n,
        "host_length": F.length(host),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / size,
        "entropy": entropy,
        "parameters": F.regexp_count(query, F.lit("[^&]+")),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")),
        "host_hyphens": F.regexp_count(host, F.lit("-")),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)),
    }
    return {k: v.cast("double") for k, v in each.items()}


#: Classes of last host labels: statistics of all of them in an array of fixed size, however many suffixes there are.
SUFFIX_CLASSES = 512
ONE_TASK = 10_000


def suffix(host: Column) -> Column:
    """The class of the last host label, by its hash."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_CLASSES)).cast("int")


@dataclass(frozen=True)
class Model:
    """Trees as (feature, threshold, left, right) or a leaf value; suffix scores by class of the last host label (0 where none was seen)."""

    base: float
    trees: tuple
    suffixes: dict[int, float]

    def margin(self, columns: dict[str, str]) -> Column:
        """The summed trees over the named columns, one for each feature."""

        def value(node) -> str:
            if isinstance(node, float):
                return f"{node!r}D"
            name, cut, left, right = node
            return f"CASE WHEN `{columns[name]}` <= {cut!r}D THEN {value(left)} ELSE {value(right)} END"

        return F.expr(" + ".join([f"{self.base!r}D", *map(value, self.trees)]))

    def suffix_score(self, host: Column) -> Column:
        table = ", ".join(f"{self.suffixes.get(i, 0.0)!r}D" for i in range(SUFFIX_CLASSES))
        return F.element_at(F.expr(f"array({table})"), suffix(host) + 1)


#: Labelled urls the default model is trained from: 1 is unwanted (adverts, gambling, pills, traps), 0 ordinary.
LABELLED = (
    (0, "https://www.riverstone.org/about"), (0, "https://news.harbor.com/en/2041"), (0, "http://library.maple.net/catalog/item/77"),
    (0, "https://www.oakfield.edu/courses/physics"), (0, "https://blog.willow.com/en/1532.html"), (0, "https://docs.granite.org/guide/install/"),
    (0, "http://museum.lakeside.org/de/412"), (0, "https://m.birchwood.net/fr/889"), (0, "https://www.cedar.com/es/300#top"),
    (0, "https://weather.coast.net/today"), (0, "https://recipes.kitchen.com/en/415?page=2"), (0, "http://www.orchard.org/en/98/"),
    (0, "https://forum.pioneer.net/thread/5521?page=2&ref=x"), (0, "https://wiki.summit.org/de/page"), (0, "https://science.valley.edu/papers/2019"),
    (0, "http://travel.meadow.com/fr/12"), (0, "https://www.parliament.example.org/en/7120"), (0, "https://m.garden.example.com/de/642"),
    (0, "https://blog.sailing.example.net/en/3411?utm_source=feed"), (0, "http://history.example.org/es/77.html"),
    (0, "https://www.farming.example.com/en/2207#top"), (0, "http://music.example.net/fr/935"), (0, "https://stories.example.org/en/4410/"),
    (0, "https://www.painting.example.net/de/151?page=2&ref=x"), (0, "http://bridge.example.com/en/6021.html"),
    (0, "https://m.theatre.example.org/fr/3305"), (0, "http://blog.hiking.example.com/es/204"), (0, "https://school.example.net/en/871/"),
    (0, "https://www.co-op.edu/members"), (0, "https://st-marys.edu/school/term"), (0, "https://north-lake.org/museum/opening/hours"),
    (0, "http://www.well-read.edu/books"), (0, "https://city-hall.org/council/minutes/2020"),
    (1, "http://casinowin88.com/win?id=1&b=2&c=3"), (1, "http://x7a81k2.biz/r?u=99182&v=2&w=1"), (1, "http://clk.adserv77.com/p?z=1&y=99&x=1821"),
    (1, "http://getrich2day.biz/now?aff=99&src=2&k=71"), (1, "http://pills24shop.com/buy?q=1&n=20&aff=7"), (1, "http://83.spin99.net/9912/8817/7716?a=1&b=2"),
    (1, "http://casino-royal-777.com/win?id=99&bonus=500&src=a1"), (1, "http://cheap-meds-4u.net/buy?p=12&aff=7781"),
    (1, "http://www.best-pills-online.com/order/now?x=1&y=2&z=3"), (1, "http://free-money-now.biz/get?uid=8817263&k=aa91"),
    (1, "https://hot-dates-777.com/join?c=88&a=12"), (1, "http://track-click.ads-net.com/r?id=8827361&to=77261&s=1"),
    (1, "http://win-big-slots.net/de/play?code=9912"), (1, "http://bet-365-bonus.com/fr/88271"), (1, "http://m.lucky-spin.com/en/4471"),
    (1, "http://www.cheap-watches.net/es/2210.html"), (1, "https://loan-fast-cash.org/apply?amount=1000&ref=88"),
    (1, "http://x9k2-promo.biz/7a71b2c9?u=771&v=2"), (1, "http://cdn-ads.click-farm.com/p/8812/9921/7716?z=1&y=9"),
    (1, "http://buy-followers.net/en/99"), (1, "https://diet-pills.example.com/en/102"), (1, "http://poker-bonus.example.net/de/7741?page=2&ref=x"),
    (1, "http://m.quick-loans.example.org/fr/412#top"), (1, "https://click-ads.example.com/en/3301/"), (1, "http://www.slot-games.example.net/es/981"),
    (1, "https://banner-swap.example.org/en/5502.html"), (1, "http://blog.free-gifts.example.com/de/77?utm_source=feed"),
    (1, "http://popup-ads.example.net/fr/2719"), (1, "http://lotto-win.example.org/en/640?page=2&ref=x"), (1, "https://www.seo-links.example.com/en/1187"),
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, y) for y, u in LABELLED], "url string, label int").coalesce(1)


def train(labelled: DataFrame, trees: int = 12, depth: int = 2, bins: int = 16, rate: float = 0.3, ridge: float = 1.0, bound: int = 1_000_000) -> Model:
    """Boosted trees for logistic loss over (url, label 0/1).

    ``bound`` is the most labelled rows used (the first by hash of the url);
    every other statistic covers all of them. Null urls or labels are left out.
    The driver sees bin edges, one row per suffix class and one split per tree node.
    Up to ONE_TASK rows are kept in one partition, which spares a shuffle per level;
    the trees are the same.
    """
    rows = labelled.filter("url IS NOT NULL AND label IN (0, 1)")
    if rows.limit(bound + 1).count() > bound:
        rows = rows.orderBy(F.xxhash64("url"), "url").limit(bound)
    host, path = split_url(F.col("url"))
    rows = rows.select("url", F.col("label").cast("double").alias("y"), host.alias("host"), path.alias("path"))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not total.n:
        return Model(0.0, (), {})
    rate_of = (total.p + 1) / (total.n + 2)
    odds = lambda p: F.log(p / (1 - p))
    prior = float(rows.sparkSession.range(1).select(odds(F.lit(rate_of))).first()[0])
    stats = rows.groupBy(suffix(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("p"))  # a row per class at most
    suffixes = {r.s: float(r.v) for r in stats.select("s", (odds((F.col("p") + 5 * rate_of) / (F.col("n") + 5)) - prior).alias("v")).collect()}
    shell = Model(prior, (), suffixes)
    features = lexical_features(F.col("url"), F.col("host"), F.col("path")) | {"suffix": shell.suffix_score(F.col("host"))}
    names = list(features)
    scratch = Scratch(rows.sparkSession, "urls")
    data = scratch.put(rows.select("y", *[v.alias(k) for k, v in features.items()]), "features")
    cuts = data.agg(*[F.sort_array(F.array_distinct(F.percentile_approx(k, [i / bins for i in range(1, bins)], 1000))).alias(k) for k in names]).first()
    bin_of = [f"size(filter(array({', '.join(f'{t!r}D' for t in cuts[k])}), t -> t < `{k}`))" for k in names]
    data = data.select("*", F.expr(f"array({', '.join(bin_of)})").alias("bins"))
    data = scratch.put(data, "bins")
    if total.n <= ONE_TASK:
        data = data.coalesce(1)
    grown: list = []
    for _ in range(trees):
        margin = Model(prior, tuple(grown), suffixes).margin({k: k for k in names})
        p = 1 / (1 + F.exp(-margin))
        scored = data.select("bins", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("w"))
        grown.append(_tree(scored, names, cuts, depth, rate, ridge))
    scratch.drop("features", "bins")
    return Model(prior, tuple(grown), suffixes)


def _tree(scored: DataFrame, names: list[str], cuts, depth: int, rate: float, ridge: float):
    """One tree on columns g (gradient), w (curvature) and bins; a level is one aggregation.

    A value's bin is the number of cuts below it, so ``bin <= b`` says ``value <= cuts[b]``.
    """
    paths = {"": "true"}  # node -> the condition of its rows
    splits: dict[str, tuple] = {}
    leaves: dict[str, float] = {}
    for _ in range(depth):
        node = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in paths.items()) + " END"
        hist = scored.select(F.expr(node).alias("node"), "g", "w", F.posexplode("bins").alias("f", "b")).filter("node IS NOT NULL")
        hist = hist.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("w").alias("w"))
        hist = hist.selectExpr(
            "node", "f", "b", "sum(g) OVER (PARTITION BY node, f ORDER BY b) AS gl", "sum(w) OVER (PARTITION BY node, f ORDER BY b) AS wl",
            "sum(g) OVER (PARTITION BY node, f) AS ga", "sum(w) OVER (PARTITION BY node, f) AS wa", "max(b) OVER (PARTITION BY node, f) AS most",
        )
        gain = f"gl * gl / (wl + {ridge}D) + (ga - gl) * (ga - gl) / (wa - wl + {ridge}D) - ga * ga / (wa + {ridge}D)"
        best = "max_by(struct(f, b, gl, wl, ga, wa, gain), struct(round(gain, 9), -f, -b)) AS s"
        hist = hist.filter("b < most").withColumn("gain", F.expr(gain)).groupBy("node").agg(F.expr(best))
        following = {}
        for r in hist.select("node", "s.*").collect():  # one row per node of this level
            if r.gain <= 1e-6:
                continue
            splits[r.node] = (names[r.f], float(cuts[names[r.f]][r.b]))
            for step, sign, g, w in (("l", "<=", r.gl, r.wl), ("r", ">", r.ga - r.gl, r.wa - r.wl)):
                following[r.node + step] = f"{paths[r.node]} AND bins[{r.f}] {sign} {r.b}"
                leaves[r.node + step] = rate * g / (w + ridge)
        paths = following
        if not paths:
            break

    def build(name: str):
        if name in splits:
            return (*splits[name], build(name + "l"), build(name + "r"))
        return float(leaves.get(name, 0.0))

    return build("")


def judge_urls(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (these names are replaced if present).

    A fitting rule decides; else the trees do: block at a score of ``threshold``
    or more. Null urls and urls without ``://`` have empty host and path, fit no
    rule and are scored on their (possibly empty) text. Rows are judged one by
    one, so repeated rows agree and an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    out = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    features = lexical_features(F.col("url"), F.col("host"), F.col("path")) | {"suffix": model.suffix_score(F.col("host"))}
    used = _used(model)
    out = out.withColumns({f"__f_{k}": v for k, v in features.items() if k in used})
    margin = model.margin({k: f"__f_{k}" for k in used})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-margin))
    out = out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", rule.alias("rule"), score.alias("score"), verdict.alias("__v"))
    return out.withColumn("verdict", F.coalesce("__v", F.when(F.col("score") >= threshold, "block").otherwise("allow"))).drop("__v")


def _used(model: Model) -> set[str]:
    def walk(node) -> set[str]:
        return set() if isinstance(node, float) else {node[0]} | walk(node[2]) | walk(node[3])

    return set().union(*map(walk, model.trees))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")

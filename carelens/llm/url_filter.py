"""URL filters: domain rules, then logistic regression on hashed character n-grams.

Everything is DataFrame and SQL expressions.  A rule (host, path prefix) fits
its host and all subdomains; the longest fitting rule decides.  Other urls are
judged by a logistic model over hashed n-grams of host and path, trained on a
small labelled url table.  Training runs as one SQL expression: the rows'
Gram matrix of shared n-grams is built once, and gradient ascent on the
log-likelihood updates one coefficient per row (the weights of a linear model
trained from zero are a combination of its rows), so a step costs rows**2.  The
labelled table is bounded by ``MOST_ROWS``.

A null url or one without ``://`` has an empty host and path and no n-grams: it
gets the model's verdict on no evidence (its intercept).  Repeated urls are
judged each, empty tables give empty results, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from carelens.llm.shared import cut

BUCKETS = 4096
MOST_ROWS = 2000

# Labelled urls (fixed values): hosts and paths of the kinds that a crawl should block, and ordinary ones.
BLOCKED = """
best-casino.com/win  mega-casino-slots.net/play  www.online-poker-win.org/bonus  free-bets-today.com/odds
sports-betting-tips.net/free  blog.bet-win.com/jackpot  lucky-jackpot.net/spin  slot-machines.org/free-spins
www.cheap-pills-online.com/buy  buy-pills.net/order  discount-pharmacy.org/cheap  m.viagra-cheap.com/pills
generic-meds.net/no-prescription  diet-pills.org/fat-burn  www.adult-videos.com/watch  adult-chat.net/cams
xxx-movies.org/free  blog.sex-x-tube.com/video  hot-x-cams.net/live  porn-x.com/xxx  www.adult-dating.org/girls
escort-girls.com/city  nude-x-pics.net/gallery  m.ads-server.com/click  ad-track.net/pixel  track-ads.org/banner
www.click-track.com/redirect  pop-ads.net/pop  banner-ads.org/serve  blog.ads.tracker-click.com/go  ad-click-tracking.net/c
spam-links.com/farm  www.link-farm.net/links  seo-spam.org/backlinks  content-farm.com/spin  m.spam-blog.net/post
farm-links.org/buy  payday-loans.com/fast  www.quick-cash-loan.net/apply  easy-money-win.org/rich  make-money-fast.com/now
blog.crypto-double.net/invest  replica-watches.com/shop  fake-rolex.net/cheap  www.cheap-handbags.org/outlet
crack-keygen.com/download  warez-torrent.net/free  m.free-download-crack.org/serial  hacked-games.net/cheats
win-free-iphone.com/prize  www.prize-winner.net/claim  free-gift-cards.org/win  cheap-followers.com/likes
blog.miracle-cure.net/order  hair-loss-pills.com/trial  bonus-bets.org/free  www.casino-bonus.net/welcome  xxx-adult.com/free
casino.example.com/en/5  m.win-casino.example.net/de/40  poker-win.example.org/fr/2  bets.example.com/en/61
www.free-betting.example.org/es/7  jackpot-win.example.com/en/12  pills.example.org/de/8  blog.cheap-meds.example.net/en/9
buy-cheap-pills.example.com/fr/33  adult.example.net/es/6  www.adult-xxx.example.org/en/71  x-cams.example.com/de/15
ads.example.org/en/4  m.ad-tracker.example.net/fr/18  track-click.example.com/en/90  spam.example.com/es/22
www.spam-links.example.net/en/3  link-farm.example.org/de/6  farm-spam.example.com/en/54  blog.free-spins.example.net/fr/1
loans.example.com/en/17  fast-cash.example.org/es/28  www.replica.example.net/en/36  warez.example.com/de/44
free-prize.example.org/en/8  m.slots.example.com/fr/19  www.cheap-viagra.example.net/en/77  blog.porn.example.org/es/5
""".split()
ALLOWED = """
example.com/en  www.example.org/de/12  blog.example.net/fr/3  news.example.com/world/2021  en.wikipedia.org/wiki/Tree
www.university.edu/physics  library.city.gov/books  www.museum.org/visit  docs.python.org/3/library
www.hospital.org/patients  school.k12.us/calendar  www.recipes.com/soup  weather.gov/forecast  www.gardening.net/roses
blog.travelnotes.com/italy  history.net/rome  science.org/doi  www.bbc.co.uk/news  www.lemonde.fr/politique
www.spiegel.de/kultur  elpais.com/cultura  www.nature.com/articles  arxiv.org/abs  github.com/project  m.example.com/es
stackoverflow.com/questions  www.thetimes.com/article  shop.books.com/fiction  forum.cooking.org/thread
photos.mountains.net/album  www.train-times.de/fahrplan  www.bank.com/about  maps.transport.org/bus  theatre.org/plays
www.church.org/sunday  gov.uk/tax  www.parliament.uk/bills  music.school.fr/cours  www.football.com/league
research.institute.org/report  www.theatre.es/obras  engineering.com/bridges  blog.writers.net/essay/5
www.farmers.org/market  nursery.gardens.com/plants  www.clinic.de/termine  therapist.net/about  www.thunder.org/en
m.thought.com/en/7  www.other.org/fr/1  blog.nation.net/de/4  www.edition.com/en/page  m.there.example.com/es
station.example.org/en/2  www.tradition.net/en  history.example.net/fr  www.north.org/en/8  thin.example.com/de
rather.example.net/en/3  www.shine.example.org/es/9  mention.example.com/fr/1  blog.onshore.net/en  www.hand.org/en
garden.example.org/en/5  www.weather.example.com/de/41  library.example.net/fr/7  m.teacher.example.org/es/20
athens.example.com/en/33  www.tennis.example.org/en/64  blog.letters.example.com/fr/9  northern.example.org/de/2
there.example.org/en/18  www.either.example.com/es/72  nature.example.net/de/13  thirteen.example.org/fr/55
blog.theory.example.com/en/86  www.lantern.example.org/de/30  within.example.com/en/4  m.leather.example.net/fr/3
thirty.example.org/es/11  onion.example.com/de/97  www.anthem.example.org/en/6  stationery.example.com/fr/21
mother.example.org/en/70  www.thesis.example.net/es/8  blog.heather.example.org/de/16  notion.example.com/en/25
""".split()


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, then up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (text, verdict) that fits, as a struct; null if none does.

    A rule's text is its host and path prefix.  Of equally long ones block wins,
    then the first in text order.
    """
    ordered = sorted({*rules}, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in reversed(ordered):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngram_buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host (3 to 5) and path (3 and 4); the last bucket is the intercept."""
    def grams(kind: str, text: Column, n: int) -> Column:
        # a lookahead finds every overlapping run in one pass over the text
        runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(runs, lambda g: F.pmod(F.xxhash64(F.concat(F.lit(kind), g)), F.lit(BUCKETS)).cast("int"))

    known = host != ""
    edged = F.when(known, F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")
    lowered = F.when(known, _lower(path)).otherwise("")
    found = [grams("h", edged, n) for n in (3, 4, 5)] + [grams("p", lowered, n) for n in (3, 4)]
    return F.array_distinct(F.concat(F.array(F.lit(BUCKETS)), *found))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: (url, blocked)."""
    def rows(urls, blocked):
        return (spark.range(1).select(F.explode(F.split(F.lit(" ".join(urls)), " ")).alias("u"))
                .select(F.concat(F.lit("http://"), "u").alias("url"), F.lit(blocked).alias("blocked")))

    return rows(BLOCKED, 1).unionByName(rows(ALLOWED, 0))


def train(labelled: DataFrame, steps: int = 300, rate: float = 16.0, decay: float = 0.0005) -> list[float]:
    """Weights by bucket, the intercept's last, from (url, blocked); at most ``MOST_ROWS`` labelled rows."""
    rows = labelled.where("url is not null and blocked is not null").limit(MOST_ROWS + 1)
    host, path = parts(F.col("url"))
    rows = rows.select(F.struct("url", F.col("blocked").cast("double").alias("y"),
                                ngram_buckets(host, path).alias("f")).alias("r"))
    one = rows.agg(F.sort_array(F.collect_list("r")).alias("rows"))
    one = one.select("rows", F.assert_true(F.size("rows") <= MOST_ROWS, F.lit("too many labelled urls")).alias("ok"))
    # normalised overlap of every two rows' buckets
    overlap = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(a["f"], b["f"]))
                                                        / F.sqrt(F.size(a["f"]) * F.size(b["f"]))))
    one = cut(one.select("rows", F.arrays_zip(F.col("rows.y").alias("y"), overlap.alias("k")).alias("train")))

    def step(a, _):
        def residual(x):
            margin = F.aggregate(F.zip_with(a, x["k"], lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
            return x["y"] - 1 / (1 + F.exp(-margin))
        return F.transform("train", lambda x, i: F.get(a, i) * (1 - decay) + residual(x) * rate / F.size("train"))

    start = F.transform("train", lambda x: F.lit(0.0))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    weights = (cut(one.select("rows", found.alias("a"))).select(F.explode(F.arrays_zip("rows", "a")).alias("z"))
               .select(F.explode("z.rows.f").alias("b"), (F.col("z.a") / F.sqrt(F.size("z.rows.f"))).alias("w"))
               .groupBy("b").agg(F.sum("w").alias("w")).collect())  # at most BUCKETS + 1 rows
    by_bucket = {r.b: r.w for r in weights}
    return [by_bucket.get(b, 0.0) for b in range(BUCKETS + 1)]


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: list[float]) -> DataFrame:
    """``pages`` with a ``url``, plus host, path, rule, verdict and the model's probability of block."""
    model = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a literal
    host, path = parts(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules),
                             "_f": ngram_buckets(F.col("host"), F.col("path"))})
    margin = F.aggregate("_f", F.lit(0.0), lambda s, b: s + F.get(model, b)) / F.sqrt(F.size("_f"))
    rows = rows.withColumn("probability", 1 / (1 + F.exp(-margin)))
    return rows.select(*pages.columns, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(
        "_rule.verdict", F.when(F.col("probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "probability")

"""Lists of a research desk: filters, queues, grids, prunes and briefs over
events, news, filings, facts and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspan.functions.stats import ratio

# The countries that a week's grid begins with.
COUNTRIES = ["US", "IL", "EA", "DE", "GB", "JP", "CN", "CA", "CH", "AU", "GLOBAL"]
WEEK = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def events_in(df: DataFrame, start: Column, end: Column, countries: list[str] | None = None, kinds: list[str] | None = None, least_importance: int = 1,
              watched: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Events of the days from ``start`` to ``end``; with ``watched`` tickers
    those that concern one of them, or none in particular."""
    cond = F.col("day").between(start, end) & (F.col("importance") >= least_importance)
    if countries:
        cond &= F.col("country").isin([c.upper() for c in countries])
    if kinds:
        cond &= F.col("kind").isin(kinds)
    if watched is not None:
        none = F.size(F.coalesce("tickers", F.array().cast("array<string>"))) == 0
        cond &= none | F.coalesce(F.arrays_overlap("tickers", F.array(*[F.lit(t) for t in watched]).cast("array<string>")), F.lit(False))
    if text:
        cond &= F.contains(F.lower("title"), F.lit(text.lower())) | F.contains("event_key", F.lit(text.lower()))
    return df.where(cond)


def week_grid(df: DataFrame, start: Column) -> DataFrame:
    """Events of the week from ``start`` counted by country and day, known countries first: ``place, country, mon .. sun, top``."""
    x = df.where(F.col("day").between(start, F.date_add(start, 6))).withColumn("at", F.datediff("day", start))
    place = F.array_position(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("country"))
    counted = x.groupBy("country").agg(*[F.count_if(F.col("at") == i).alias(n) for i, n in enumerate(WEEK)], F.max("importance").alias("top"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.when(place > 0, place).otherwise(len(COUNTRIES) + 1), "country")  # a row per country
    return counted.withColumn("place", F.row_number().over(w))


def decisions(meetings: DataFrame, rates: DataFrame, today: Column) -> DataFrame:
    """Per bank of ``meetings(bank, day, rate_series)`` the next and last meeting,
    days to go, meetings left this year, and the latest rate with its time by
    ``rates(series_id, ts, value)``."""
    m = meetings.groupBy("bank").agg(
        F.min(F.when(F.col("day") >= today, F.col("day"))).alias("next_day"), F.max(F.when(F.col("day") < today, F.col("day"))).alias("last_day"),
        F.count_if((F.col("day") >= today) & (F.year("day") == F.year(today))).alias("left_this_year"), F.max("rate_series").alias("series_id"))
    latest = rates.where("value IS NOT NULL").groupBy("series_id").agg(F.max_by("value", "ts").alias("rate"), F.max("ts").alias("rate_ts"))
    return m.join(latest, "series_id", "left").withColumn("days_to_go", F.datediff("next_day", today)).drop("series_id")


def active_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """``events(event_id, ts)`` with the windows ``(window_id, start, end)`` that
    are open then, both ends included: windows are spread over the days they
    touch and meet events by day."""
    spread = windows.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    return events.withColumn("day", F.to_date("ts")).join(spread, "day").where(F.col("ts").between(F.col("start"), F.col("end"))).select("event_id", "window_id")


def _blocks(windows: DataFrame) -> DataFrame:
    """``level, block, n, first_window``: windows ``(start, end)`` of whole numbers, the end left
    out, cut into blocks of powers of two, two at most of each size."""
    low = lambda k: -F.call_function("shiftright", -F.col("start"), k)
    high = lambda k: F.call_function("shiftright", F.col("end"), k)
    cut = lambda k: F.array(F.when((low(k) < high(k)) & (low(k) % 2 != 0), F.struct(k.alias("level"), low(k).alias("block"))),
                            F.when((low(k) < high(k)) & (high(k) % 2 != 0), F.struct(k.alias("level"), (high(k) - 1).alias("block"))))
    levels = F.sequence(F.lit(0), F.lit(62))
    return windows.select("n", "first_window", F.inline(F.filter(F.flatten(F.transform(levels, cut)), lambda x: x.isNotNull()))) \
        .groupBy("level", "block").agg(F.sum("n").alias("n"), F.min("first_window").alias("first_window"))


def open_counts(events: DataFrame, windows: DataFrame) -> DataFrame:
    """``event_id, n, first_window``: how many of ``windows(window_id, start, end)``
    are open at an event of ``events(event_id, ts)``, both ends included, and the
    least id; events in none go. What :func:`active_windows` gives, counted
    without its pairs: between two ends of windows the answer stays the same, so
    it is worked out for these ends only (each window is cut into blocks, an end
    asks for the blocks it lies in), and an event takes that of the last end
    before it in its hour or of the hour's beginning."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp"))
    hour = 3_600_000_000
    e = events.where("ts IS NOT NULL").select("event_id", micros("ts").alias("at")).withColumn("hour", F.floor(F.col("at") / hour))
    w = windows.select("window_id", micros("start").alias("start"), (micros("end") + 1).alias("end")).where(F.col("start") < F.col("end"))
    w = w.groupBy("start", "end").agg(F.count("*").alias("n"), F.min("window_id").alias("first_window"))
    blocks = _blocks(w)
    ends = w.select(F.explode(F.array("start", "end")).alias("at")).unionByName(e.select((F.col("hour") * hour).alias("at"))).distinct()
    levels = blocks.select("level").distinct()  # 63 at most
    asked = ends.join(F.broadcast(levels)).withColumn("block", F.call_function("shiftright", F.col("at"), F.col("level")))
    told = asked.join(blocks, ["level", "block"]).groupBy("at").agg(F.sum("n").alias("n"), F.min("first_window").alias("first_window"))
    known = ends.join(told, "at", "left").select("at", F.floor(F.col("at") / hour).alias("hour"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "first_window").alias("open"), F.lit(0).alias("side"))
    both = known.unionByName(e.withColumn("side", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("hour").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("open", F.last("open", ignorenulls=True).over(before)).where("side = 1 AND open.n > 0")
    return seen.groupBy("event_id").agg(F.sum("open.n").alias("n"), F.min("open.first_window").alias("first_window"))


def prune(stored: DataFrame, fresh: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Stored rows that the fresh parse of their group no longer has; none of a
    group whose parse has nothing, or less than half of what is stored."""
    n_stored = stored.groupBy(group).agg(F.count("*").alias("stored"))
    n_fresh = fresh.select(group, *keys).distinct().groupBy(group).agg(F.count("*").alias("parsed"))
    whole = n_stored.join(n_fresh, group).where(F.col("parsed") * 2 >= F.col("stored")).select(group)
    return stored.join(whole, group, "left_semi").join(fresh.select(group, *keys).distinct(), [group, *keys], "left_anti")


def job_status(runs: DataFrame) -> DataFrame:
    """Per job of ``runs(run_id, job, finished_at, status, message)``: its last
    run's time and status, the last that went well, the last that did something."""
    well = F.col("status") == "ok"
    return runs.groupBy("job").agg(
        F.max_by("finished_at", "run_id").alias("last_run"), F.max_by("status", "run_id").alias("last_status"), F.max(F.when(well, F.col("finished_at"))).alias("last_ok"),
        F.max(F.when(well & (F.coalesce("message", F.lit("")) != ""), F.col("finished_at"))).alias("last_work"))


def to_enrich(clusters: DataFrame, now: Column, threshold: int, limit: int = 20, hours: int = 72) -> DataFrame:
    """Recent clusters that nothing was added to yet, important ones and all
    filings and wires, the most important first. The limit is the queue's."""
    recent = F.col("last_seen") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))
    x = clusters.where(F.col("enriched_at").isNull() & recent & ((F.col("importance") >= threshold) | F.col("kind").isin("filing", "wire")))
    return x.orderBy(F.desc("importance"), F.desc("last_seen"), "cluster_id").limit(limit)


def stitched(clusters: DataFrame, items: DataFrame, filings: DataFrame) -> DataFrame:
    """Clusters with their items' ids, tickers (each once, the best score first)
    and filings: ``clusters(cluster_id)``, ``items(cluster_id, item_id, ticker,
    score, accession)``, ``filings(accession, form)``."""
    x = items.join(filings, "accession", "left")
    best = x.where("ticker IS NOT NULL").groupBy("cluster_id", "ticker").agg(F.max("score").alias("score"))
    tickers = best.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ticker"))), lambda t: t["ticker"]).alias("tickers"))
    told = x.groupBy("cluster_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set("form")).alias("forms"))
    return clusters.join(told, "cluster_id", "left").join(tickers, "cluster_id", "left")


def filings_list(filings: DataFrame, items: DataFrame, since: Column, tickers: list[str] | None = None, forms: list[str] | None = None, limit: int = 50) -> DataFrame:
    """The newest filings since a day, with the cluster that tells of each. The limit is the list's."""
    x = filings.where(F.col("filed") >= since)
    if tickers:
        x = x.where(F.col("ticker").isin([t.upper() for t in tickers]))
    if forms:
        x = x.where(F.col("form").isin(forms))
    told = items.where("accession IS NOT NULL").groupBy("accession").agg(F.min("cluster_id").alias("cluster_id"))
    return x.join(told, "accession", "left").orderBy(F.desc("filed"), "accession").limit(limit)


def upsides(values: DataFrame, prices: DataFrame, limit: int = 10) -> DataFrame:
    """``values(ticker, model, value)`` by model order ``blended``, ``base_dcf``, then others, against ``prices(ticker, price)``: the largest upsides."""
    rank = F.when(F.col("model") == "blended", 0).when(F.col("model") == "base_dcf", 1).otherwise(2)
    best = values.groupBy("ticker").agg(F.min_by(F.struct("model", "value"), F.struct(rank.alias("rank"), "model")).alias("v"))
    x = best.join(prices, "ticker").select("ticker", "v.model", "v.value", "price", ratio(F.col("v.value"), F.col("price")).alias("up")).withColumn("upside", F.col("up") - 1).drop("up")
    return x.where("upside IS NOT NULL").orderBy(F.desc("upside"), "ticker").limit(limit)


def brief(parts: dict[str, tuple[DataFrame, str, str, int]]) -> DataFrame:
    """The first rows of several lists as one: ``part, place, id, score``. Each
    part is (rows, id column, score column, how many), the highest scores first."""
    out = []
    for name, (df, id_col, score_col, n) in parts.items():
        top = df.where(F.col(score_col).isNotNull()).orderBy(F.desc(score_col), id_col).limit(n)
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score_col), id_col))  # n rows
        out.append(top.select(F.lit(name).alias("part"), place.alias("place"), F.col(id_col).cast("string").alias("id"), F.col(score_col).cast("double").alias("score")))
    return reduce(DataFrame.unionByName, out)


# What a filing is about by its items and form.
ITEM_EVENTS = [("earnings", ["2.02"]), ("m&a", ["1.01", "2.01"]), ("management", ["5.02"]), ("offering", ["3.02"])]


def event_type(text: Column, form: Column, items: Column, keywords: list[tuple[str, list[str]]]) -> Column:
    """What an item is about: a filing's items, then its form, then the first
    list of ``keywords`` that has a word in the text, else ``other``."""
    out = None
    for name, codes in ITEM_EVENTS:
        hit = form.startswith("8-K") & F.arrays_overlap(items, F.array(*[F.lit(c) for c in codes]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.when(form.isin("10-K", "10-Q", "20-F"), "earnings").when(form.startswith("SC 13"), "m&a").when(form == "4", "management")
    low = F.lower(text)
    for name, words in keywords:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name)
    return out.otherwise("other")


def direct_links(items: DataFrame, known: DataFrame) -> DataFrame:
    """Tickers that ``items(item_id, text)`` name outright, of those in
    ``known(ticker)``: with an exchange in front .95, a cashtag or in brackets .9,
    a bare word of four capitals or more in a text that isn't all capitals .6;
    the best for each item and ticker."""
    raw = F.replace("text", F.lit("’"), F.lit("'"))
    found = lambda p: F.regexp_extract_all(raw, F.lit(p), F.lit(1))
    mixed = F.lower(raw) != raw
    small = raw.rlike("\\p{Ll}")
    kinds = [(found("(?i)\\b(?:NASDAQ|NYSE|TASE|AMEX|LSE)\\s*:\\s*([A-Za-z][A-Za-z.]{0,7})\\b"), 0.95), (found("\\$([A-Za-z]{1,6})\\b"), 0.9), (found("\\(([A-Z][A-Z.]{0,6})\\)"), 0.9),
             (F.when(mixed & small, found("\\b([A-Z][A-Z.]{3,6})\\b")), 0.6)]
    rows = [items.select("item_id", F.explode(a).alias("t")).select("item_id", F.upper("t").alias("ticker"), F.lit(s).alias("score")) for a, s in kinds]
    return reduce(DataFrame.unionByName, rows).groupBy("item_id", "ticker").agg(F.max("score").alias("score")).join(known, "ticker", "left_semi")


def z_trail(df: DataFrame, last: Column, months: int = 12, window: int = 36, least: int = 6, bound: float = 5.0) -> DataFrame:
    """Mean z over indicators at each of the last ``months`` month starts. An
    indicator's z there is that of its last value at or before, against its last
    ``window`` values, ``least`` of them at least; a flat run gives 0."""
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(-(window - 1), 0)
    sd, n = F.stddev_samp("value").over(w), F.count("value").over(w)
    z = F.when(n >= least, F.when(sd > 0, F.greatest(F.lit(-bound), F.least(F.lit(bound), (F.col("value") - F.avg("value").over(w)) / sd))).otherwise(0.0))
    scored = df.where("value IS NOT NULL").withColumn("z", z).select("series_id", "ts", F.struct("z").alias("hit"), F.lit(0).alias("side"))
    days = F.sequence(F.add_months(F.trunc(last, "month"), -(months - 1)), F.trunc(last, "month"), F.expr("interval 1 month"))
    starts = df.select("series_id").distinct().withColumn("day", F.explode(days)).select("series_id", F.col("day").cast("timestamp_ntz").alias("ts"))
    both = starts.withColumn("side", F.lit(1)).unionByName(scored, allowMissingColumns=True)
    seen = F.last("hit", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("z", seen["z"]).where("side = 1 AND z IS NOT NULL").groupBy("ts").agg(F.avg("z").alias("z"), F.count("*").alias("n"))


def project(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cash flows year by year along paths of growth, margin and tax, and what
    they are worth: ``<keys>, pv, terminal, pv_terminal, ev``.

    ``df(base_revenue, growth_path, margin_path, tax_path, da_pct, sbc_pct,
    capex_pct, nwc_pct, sales_to_capital, mid_year, wacc, terminal_g,
    terminal_multiple, multiple_of)``: reinvestment by sales to capital where
    that is given, else capital spending less depreciation and working capital;
    no tax on losses; the terminal value by a multiple of ``ebitda``, ``ebit`` or
    ``revenue`` where one is given, else by growth over a spread of half a
    percent at least."""
    years = df.withColumns({"n": F.size("growth_path")}).select("*", F.posexplode(F.arrays_zip("growth_path", "margin_path", "tax_path")).alias("i", "p"))
    w = Window.partitionBy(*keys).orderBy("i")
    y = years.withColumn("rev", F.col("base_revenue") * F.product(1 + F.col("p.growth_path")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    y = y.withColumns({"more": F.col("rev") - F.lag("rev", 1).over(w), "ebit": F.col("rev") * F.col("p.margin_path"), "da": F.col("rev") * F.col("da_pct")})
    more = F.coalesce("more", F.col("rev") - F.col("base_revenue"))
    nopat = F.col("ebit") - F.greatest(F.lit(0.0), F.col("ebit")) * F.col("p.tax_path")
    reinvested = F.when(F.coalesce("sales_to_capital", F.lit(0.0)) != 0, ratio(more, F.col("sales_to_capital"))).otherwise(F.col("rev") * F.col("capex_pct") - F.col("da") + more * F.col("nwc_pct"))
    y = y.withColumn("cash", nopat - reinvested - F.col("rev") * F.coalesce("sbc_pct", F.lit(0.0)))
    y = y.withColumn("pv", F.col("cash") / F.pow(1 + F.col("wacc"), F.col("i") + F.when(F.col("mid_year"), 0.5).otherwise(1.0)))
    last = F.max_by(F.struct("cash", "ebit", "da", "rev"), "i").alias("last")
    one = [F.first(c).alias(c) for c in ("n", "wacc", "terminal_g", "terminal_multiple", "multiple_of")]
    x = y.groupBy(*keys).agg(F.sum("pv").alias("pv"), last, *one)
    base = F.when(F.col("multiple_of") == "ebitda", F.col("last.ebit") + F.col("last.da")).when(F.col("multiple_of") == "ebit", F.col("last.ebit")).otherwise(F.col("last.rev"))
    by_growth = F.col("last.cash") * (1 + F.col("terminal_g")) / F.greatest(F.col("wacc") - F.col("terminal_g"), F.lit(0.005))
    x = x.withColumn("terminal", F.coalesce(F.col("terminal_multiple") * base, by_growth))
    x = x.withColumn("pv_terminal", F.col("terminal") / F.pow(1 + F.col("wacc"), F.col("n")))
    return x.select(*keys, "pv", "terminal", "pv_terminal", (F.col("pv") + F.col("pv_terminal")).alias("ev"))

"""Matching records: places and gazetteer, notices and sales, spellings, captures, page lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions import ids
from recordlake.functions import lexicons as lx
from recordlake.functions import sequences as sq
from recordlake.functions import text as t
from recordlake.operators.signals import date_hint
from recordlake.session import cut_lineage


# ---- sales and notices -------------------------------------------------------------------------------

def match_notices(notices: DataFrame, sales: DataFrame, slack: int = 60, counted: bool = False) -> DataFrame:
    """JN3: same parcel, sale on or after the notice less some days; distinct (notice, parcel, sale).

    Both sides are made distinct before they meet.  ``counted``: a row for each sale of a parcel, with the number of its
    ``notices`` in place of a row for each; a parcel's notices and sales do not meet one by one then.
    """
    parcel = ["section", "number"]
    n = notices.select("date", *parcel).distinct()
    s = sales.select("id_mutation", "sale_date", *parcel).distinct()
    if not counted:
        n, s = n.alias("n"), s.alias("s")
        return n.join(s, (F.col("n.section") == F.col("s.section"))
                      & (F.col("n.number") == F.col("s.number"))
                      & (F.col("s.sale_date") >= F.date_sub(F.col("n.date"), slack))).select(
            "n.date", "n.section", "n.number", "s.id_mutation", "s.sale_date")
    # A parcel's list of days is bounded by the calendar.
    days = n.where(F.col("date").isNotNull()).groupBy(*parcel).agg(F.sort_array(F.collect_list(F.date_sub("date", slack))).alias("days"))
    until = _up_to(F.col("days"), F.col("sale_date"))
    return s.where(F.col("sale_date").isNotNull()).join(days, parcel).select(
        "section", "number", "id_mutation", "sale_date", until.cast("bigint").alias("notices")).where("notices > 0")


def _up_to(values: Column, most: Column) -> Column:
    """How many of the sorted values are at most that: halved until the place is found."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def halve(at, _):
        middle = F.shiftright(at["low"] + at["high"], 1)
        below = F.get(values, middle) <= most
        # once the place is found, what is left between low and high is empty
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(at["low"]).alias("low"), F.when(below, at["high"]).otherwise(middle).alias("high")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve, lambda at: at["low"])


# ---- places --------------------------------------------------------------------------------------------

def place_tokens(c) -> Column:
    """Stemmed significant tokens of a place name, distinct and sorted."""
    found = F.regexp_extract_all(t.fold(c), F.lit("([a-z]{3,})"), 1)
    kept = F.filter(found, lambda w: ~w.isin(lx.PLACE_PARTICLES))
    stem = F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.rlike("[sx]$"),
                                              F.regexp_replace(w, "[sx]$", ""))
                       .otherwise(w))
    return F.array_sort(F.array_distinct(stem))


def wanted_tokens(c) -> Column:
    """Tokens a feature must have: the label's tokens without street types."""
    return F.filter(place_tokens(c), lambda w: ~w.isin(lx.PLACE_TYPE_WORDS))


def confirm_places(candidates: DataFrame, gazetteer: DataFrame, citycode: str,
                   least: float = lx.MIN_PLACE_SCORE) -> DataFrame:
    """JN4: for each candidate label the first feature, by rank, that really names it.

    Features with the same tokens are merged first (only the best rank can win), and labels with the
    same tokens too.  Labels then meet features on the label's rarest token only, and the rest of the
    tokens are verified.
    """
    fit = gazetteer.where((F.col("citycode") == citycode) & F.col("type").isin("street", "locality")
                          & (F.col("score") >= least))
    feature = fit.withColumn("have", place_tokens("name")).groupBy("have").agg(
        F.min_by(F.struct("rank", "name", "lat", "lon", "score"), "rank").alias("feature"))
    labelled = candidates.select("label").distinct().withColumn("want", wanted_tokens("label"))
    want = labelled.where(F.size("want") > 0).select("want").distinct()
    posted = feature.select("have", "feature", F.explode("have").alias("token"))
    seen = posted.groupBy("token").agg(F.count("*").alias("df"))
    rarest = (want.select("want", F.explode("want").alias("token")).join(seen, "token")
              .groupBy("want").agg(F.min_by("token", F.struct("df", "token")).alias("token")))
    hit = (rarest.join(posted, "token")
           .where(F.size(F.array_except("want", "have")) == 0)
           .groupBy("want").agg(F.min_by("feature", F.col("feature.rank")).alias("feature")))
    return labelled.join(hit, "want").select("label", "feature.*")


def search_label(c) -> Column:
    """SG27: the place name only: cut at a dash or bracket, and after its capitalised name."""
    whole = F.translate(F.element_at(F.split(F.trim(t.col(c)), r"\s[-–(]\s|\s*[(\[]"), 1), "’", "'")
    return t.let(F.split(whole, r"\s+"), lambda ws: t.let(
        _first(ws, lambda w, i: (i > 0) & F.regexp_replace(w, "^[a-zA-Zà-ÿ]'", "").rlike(r"^\p{Lu}")
               & F.regexp_replace(w, "^[a-zA-Zà-ÿ]'", "").rlike(r"\p{Ll}")),
        lambda named: t.let(
            _first(ws, lambda w, i: (i > named) & w.rlike(r"^\p{Ll}")
                   & ~t.fold(w).isin(lx.PLACE_PARTICLES) & ~w.rlike("'$")),
            lambda end: F.array_join(F.when(end.isNotNull(), F.slice(ws, F.lit(1), end))
                                     .otherwise(ws), " "))))


def _first(items: Column, test) -> Column:
    """Index of the first element that passes, NULL when none does."""
    return F.array_min(F.filter(F.transform(items, lambda w, i: F.when(test(w, i), i)),
                                lambda i: i.isNotNull()))


# What a label must show to pass for the name of a place: (which labels, which facts, any of them being enough).
PLACE_RULES = [
    ("hamlet", lambda f: f["written"]),
    ("sure", lambda f: f["named"] | (f["linked"] & f["short"])),
    ("unsure", lambda f: f["named"] | f["landmark"]),
]


def _place_facts(label: Column, kind: Column) -> Column:
    """A label taken apart: its type word, then (behind a modifier) the tokens of the name."""
    parts = F.split(F.trim(label), r"\s+")
    head, rest = F.get(parts, 0), F.slice(parts, 2, F.size(parts))
    behind = F.when(t.fold(F.get(rest, 0)).isin(lx.PLACE_MODIFIERS), F.slice(rest, 2, F.size(rest))).otherwise(rest)
    tokens = F.regexp_extract_all(F.array_join(behind, " "), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    proper = lambda w: w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}")

    def facts(v: Column) -> Column:
        names = F.filter(v["tokens"], lambda w: ~t.fold(w).isin(lx.PLACE_PARTICLES))
        return t.let(names, lambda n: F.struct(
            F.when(kind == "lieu-dit", "hamlet").when((F.size(n) == 0) | label.rlike("-\\s*$"), "none")
            .when(t.fold(v["head"]).isin(lx.AMBIGUOUS_PLACE_TYPES), "unsure").otherwise("sure").alias("sort"),
            proper(F.trim(label)).alias("written"),
            (proper(F.get(n, 0)) & ~t.fold(F.get(n, 0)).isin(lx.PLACE_TYPE_WORDS)).alias("named"),
            t.fold(F.get(n, 0)).isin(lx.LANDMARKS).alias("landmark"),
            t.fold(F.get(v["tokens"], 0)).isin(lx.PLACE_LINKS).alias("linked"), (F.size(n) <= 3).alias("short")))
    return t.let(F.struct(head.alias("head"), tokens.alias("tokens")), facts)


def plausible(label, kind) -> Column:
    """SG27: could this be a real place name?"""
    def judged(f: Column) -> Column:
        passed = F.lit(False)
        for sort, test in PLACE_RULES:
            passed = passed | ((f["sort"] == sort) & test(f))
        return F.coalesce(passed, F.lit(False))
    return t.let(_place_facts(t.col(label), t.col(kind)), judged)


def unconfirmed(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """JN5: labels without a feature, plausible ones grouped by their folded clean form."""
    left = candidates.join(confirmed.select("label").distinct(), "label", "left_anti")
    clean = left.withColumn("clean", search_label("label"))
    return clean.where(plausible("clean", "kind")).groupBy(t.fold("clean").alias("key")).agg(
        F.min("clean").alias("label"), F.count("*").alias("mentions"))


def place_groups(confirmed: DataFrame) -> DataFrame:
    """AG19: places merged by name and rounded position: distinct items, meetings, main theme.

    ``confirmed`` has name, lat, lon, label, date, title and topic (one row per topic).  The main
    theme is the most frequent one, by name on a tie.
    """
    where = ["name", F.round("lat", 4).alias("lat4"), F.round("lon", 4).alias("lon4")]
    keys = ["name", "lat4", "lon4"]
    item = confirmed.select(*where, "date", "title", "topic", "label").distinct()
    base = item.groupBy(*keys).agg(F.count_distinct("date", "title").alias("items"),
                                   F.count_distinct("date").alias("meetings"),
                                   F.count_distinct("label").alias("spellings"))
    themes = item.select(*keys, "date", "title", "topic").distinct().groupBy(*keys, "topic").agg(
        F.count("*").alias("n"))
    main = themes.groupBy(*keys).agg(
        F.min_by("topic", F.struct((-F.col("n")).alias("minus"), "topic")).alias("main_theme"))
    return base.join(main, keys)


def near_pairs(points: DataFrame, metres: float) -> DataFrame:
    """GR4: pairs of places closer than a distance, in equirectangular metres.

    Positions are rounded to four decimals (about ten metres) and made distinct first, so the points
    of a grid cell are bounded by the cell, whatever the number of rows.  A point lies in one cell on the right
    and each of its nine cells is named once on the left, so a pair meets once and needs no second ``distinct``.
    """
    p = points.select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).distinct()
    step = metres / 110_574.0
    # A degree of longitude is shorter than one of latitude; the column width follows the latitude row.
    row = F.floor(F.col("lat") / step)
    width = step / F.greatest(F.cos(F.radians((F.abs(row) + 2) * step)), F.lit(0.01))
    cells = p.withColumn("row", row)
    left = cells.withColumn("dr", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn(
        "r", F.col("row") + F.col("dr"))
    width_r = step / F.greatest(F.cos(F.radians((F.abs(F.col("r")) + 2) * step)), F.lit(0.01))
    left = left.withColumn("c", F.floor(F.col("lon") / width_r)).withColumn(
        "c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    right = cells.withColumn("c", F.floor(F.col("lon") / width)).withColumnRenamed("row", "r")
    a, b = left.alias("a"), right.alias("b")
    return (a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c"))
                   & ((F.col("a.lat") < F.col("b.lat"))
                      | ((F.col("a.lat") == F.col("b.lat")) & (F.col("a.lon") < F.col("b.lon")))))
            .select(F.col("a.lat").alias("lat1"), F.col("a.lon").alias("lon1"),
                    F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2"))
            .withColumn("metres", metres_apart("lat1", "lon1", "lat2", "lon2"))
            .where(F.col("metres") < metres))


def metres_apart(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    x = (F.col(lon1) - F.col(lon2)) * 111_320.0 * F.cos(F.radians(F.col(lat1)))
    y = (F.col(lat1) - F.col(lat2)) * 110_574.0
    return F.sqrt(x * x + y * y)


def farthest(points: DataFrame, lat: float, lon: float) -> DataFrame:
    """GR4: the largest distance from a centre."""
    centre = points.withColumns({"_lat": F.lit(lat), "_lon": F.lit(lon)})
    return centre.agg(F.max(metres_apart("_lat", "_lon", "lat", "lon")).alias("metres"))


# ---- spellings -------------------------------------------------------------------------------------------

HOT_ROWS = 10_000           # rows of one key that meet in one task


def _met(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows that agree in `key`; a key with many rows on the left is dealt out, and its rows on the right go to every part."""
    hot = left.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(
        *key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_parts"))
    a = left.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("a"), "_parts"), F.lit(0)).cast("int"))
    b = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
    return a.drop("_parts").join(b.drop("_parts"), [*key, "_part"])


def _signs(c: Column) -> Column:
    """Which letters a text has, the second of a kind as a letter of its own and so on, each as one of 64 bits."""
    counted = t.let(F.array_sort(sq.letters(c)), lambda s: F.transform(
        s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x))))
    return F.aggregate(counted, F.lit(0).cast("bigint"), lambda s, h: s.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))))


def similar_spellings(names: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of distinct spellings whose ratio (``sequences.matching_ratio``) reaches ``least``; exact, the same either way round.

    A ratio r of lengths m, n leaves at most (1-r)(m+n) letters out of the common subsequence, an even number of them
    where m + n is even.  Of one more piece than that of the shorter name at least one stands unchanged in the longer,
    shifted back by no more than the letters left out of the shorter, and on by those left out of the longer.
    Spellings therefore meet on (piece, piece number, lengths); each letter that one of them has more often is one left
    out, which drops nearly all of what meets, and the common subsequence decides the rest.
    """
    n = names.select("name", t.fold("name").alias("f")).distinct().withColumns({"m": F.length("f"), "signs": _signs(F.col("f"))})
    ratio = (1 - least) / (1 - 1e-9)
    # Lengths that can reach the ratio with a name of length m; the shorter name is cut in pieces.
    longest = F.floor(F.col("m") * (2 - least) / least)
    pieces = (n.withColumn("len2", F.explode(F.sequence(F.col("m"), longest.cast("int"))))
              .withColumn("k", F.floor(ratio * (F.col("m") + F.col("len2"))).cast("int"))
              .withColumn("k", F.col("k") - (F.col("k") + F.col("m") + F.col("len2")) % 2)
              .withColumn("cuts", F.col("k") + 1)
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
              .withColumn("from", F.floor(F.col("i") * F.col("m") / F.col("cuts")).cast("int"))
              .withColumn("to", F.floor((F.col("i") + 1) * F.col("m") / F.col("cuts")).cast("int"))
              .withColumn("piece", F.substr("f", F.col("from") + 1, F.col("to") - F.col("from"))))
    spots = (pieces.select(F.col("m").alias("len1"), "len2", "i", "from", "to", "k").distinct()
             .withColumn("short", F.expr("(k - (len2 - len1)) div 2").cast("int"))
             .withColumn("at", F.explode(F.sequence(F.greatest(F.col("from") - F.col("short"), F.lit(0)),
                                                    F.col("from") + F.col("short") + F.col("len2") - F.col("len1"))))
             .where(F.col("at") + F.col("to") - F.col("from") <= F.col("len2")))
    probes = (n.join(spots, n["m"] == spots["len2"])
              .withColumn("piece", F.substr("f", F.col("at") + 1, F.col("to") - F.col("from"))))
    a = pieces.select("piece", "i", F.col("m").alias("len1"), "len2", "k", F.col("name").alias("a"), F.col("signs").alias("sa"))
    b = probes.select("piece", "i", "len1", "len2", F.col("name").alias("b"), F.col("signs").alias("sb")).distinct()
    met = (_met(a, b, ["piece", "i", "len1", "len2"])
           .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= F.col("k")))
           .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return met.withColumn("ratio", sq.matching_ratio(t.fold("a"), t.fold("b"))).where(F.col("ratio") >= least)


def canonical_names(names: DataFrame, name: str = "name", least: float = 0.85) -> DataFrame:
    """AG22: each spelling's canonical form: the most frequent canonical spelling that is close.

    Spellings are ranked by (count, name).  A spelling is canonical when no better canonical one is
    close to it; this settles in rounds, each of which decides every spelling whose better
    neighbours are decided.
    """
    counts = cut_lineage(names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(
        F.count("*").alias("n")))
    rank = F.struct((-F.col("n")).alias("minus"), "name")
    ranked = counts.withColumn("rank", rank)
    pairs = similar_spellings(counts, least).select("a", "b")
    both = pairs.union(pairs.select("b", "a"))
    better = cut_lineage(
        both.join(ranked.select(F.col("name").alias("a"), F.col("rank").alias("ra")), "a")
        .join(ranked.select(F.col("name").alias("b"), F.col("rank").alias("rb")), "b")
        .where(F.col("rb") < F.col("ra")).select("a", "b", "rb"))
    state = cut_lineage(counts.select("name", F.lit(None).cast("string").alias("canon")))
    while True:
        known = state.select(F.col("name").alias("b"), F.col("canon").alias("cb"))
        view = better.join(known, "b").groupBy("a").agg(
            F.min_by("b", F.when(F.col("cb") == F.col("b"), F.col("rb"))).alias("best"),
            F.min(F.when(F.col("cb").isNull(), F.col("rb"))).alias("open"),
            F.min(F.when(F.col("cb") == F.col("b"), F.col("rb"))).alias("best_rank"))
        # Decided: the best canonical neighbour is better than any open one, or nothing is open.
        answer = F.when(F.col("best_rank").isNotNull() & (
            F.col("open").isNull() | (F.col("best_rank") < F.col("open"))), F.col("best")).when(
            F.col("best_rank").isNull() & F.col("open").isNull(), F.col("name"))
        state = cut_lineage(state.join(view, state["name"] == view["a"], "left").select(
            "name", F.coalesce("canon", answer).alias("canon")))
        if state.where("canon IS NULL").isEmpty():
            return counts.join(state, "name")


# ---- captures and lists ------------------------------------------------------------------------------------

def dedupe_captures(captures: DataFrame, key: Column, ranks: list[str] | None = None) -> DataFrame:
    """AG23: one capture per meeting: best format first, then the earliest."""
    order = F.coalesce(F.nullif(F.array_position(
        F.array(*[F.lit(x) for x in (ranks or lx.FORMAT_RANK)]), F.col("mimetype")), F.lit(0)),
        F.lit(99))
    best = F.struct(order.alias("r"), "timestamp", "original")
    cols = [F.col(c) for c in captures.columns]
    return captures.withColumn("key", key).groupBy("key").agg(
        F.min_by(F.struct(*cols), best).alias("c")).select("key", "c.*")


def meeting_key(original) -> Column:
    """Digits of the file stem, or the stem itself when it has none."""
    stem = F.regexp_replace(F.try_url_decode(F.substring_index(t.col(original), "/", -1)), r"\.\w+$", "")
    digits = F.regexp_replace(stem, r"\D", "")
    return F.when(digits != "", digits).otherwise(F.lower(stem))


def choose_minutes(captures: DataFrame) -> DataFrame:
    """AG23 on an archive listing: minutes files only, with a date guessed from the name."""
    best = dedupe_captures(captures.where(F.col("original").rlike(lx.MINUTES_FILE)),
                           meeting_key("original"))
    name = F.replace(F.try_url_decode(F.substring_index("original", "/", -1)), F.lit(" "), F.lit(""))
    return best.withColumn("name", name).withColumn("date_hint", date_hint("name"))


def new_and_gone(site: DataFrame, known: DataFrame, url: str, host: Column) -> DataFrame:
    """JN6: addresses new on the trusted host, and known ones no longer listed."""
    s, k = site.select(url).distinct(), known.select(url).distinct()
    return (s.where(host).join(k, url, "left_anti").withColumn("change", F.lit("new"))
            .unionByName(k.join(s, url, "left_anti").withColumn("change", F.lit("gone"))))


def prune_cache(cache: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """JN7: cached rows still wanted."""
    return cache.join(keep.select(key).distinct(), key, "left_semi")


def cache_miss(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """JN7: keys not cached yet."""
    return keys.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


# ---- enrichment ------------------------------------------------------------------------------------------------

def enrich_hits(hits: DataFrame, items: DataFrame, meetings: DataFrame, item: str, meeting: str
                ) -> DataFrame:
    """JN9: title and meeting of each hit.  Spark broadcasts a side when its size allows."""
    return hits.join(items, item, "left").join(meetings, meeting, "left")


def parcel_mentions(mentions: DataFrame, meetings: DataFrame, parcels: DataFrame, parcel: str,
                    meeting: str, date: str) -> DataFrame:
    """JN10: per parcel: mentions, distinct meetings, first and last date.

    Mentions are counted per (parcel, meeting) before the joins.
    """
    counted = mentions.groupBy(parcel, meeting).agg(F.count("*").alias("n"))
    dated = counted.join(meetings.select(meeting, date), meeting)
    rolled = dated.groupBy(parcel).agg(
        F.sum("n").alias("mentions"), F.count("*").alias("meetings"),
        F.min(date).alias("first"), F.max(date).alias("last"))
    return rolled.join(parcels, parcel)


def folder_lookup(meetings: DataFrame, files: DataFrame, meeting: str, kind: str,
                  kinds: list[str]) -> DataFrame:
    """JN11: which artefacts exist for each meeting."""
    flags = files.groupBy(meeting).agg(
        *[F.bool_or(F.col(kind) == k).alias(f"has_{k}") for k in kinds])
    out = meetings.join(flags, meeting, "left")
    return out.withColumns({f"has_{k}": F.coalesce(f"has_{k}", F.lit(False)) for k in kinds})


def place_links(confirmed: DataFrame, unconfirmed_rows: DataFrame, keys: list[str], page: str
                ) -> DataFrame:
    """JN12: mentions per meeting and place, confirmed or not, with their pages."""
    both = confirmed.withColumn("confirmed", F.lit(True)).unionByName(
        unconfirmed_rows.withColumn("confirmed", F.lit(False)))
    return both.groupBy(*keys, "confirmed").agg(
        F.count_distinct(page).alias("pages"), F.min(page).alias("first_page"),
        F.max(page).alias("last_page"))


def money_threads(threads: DataFrame, thread: str, has_money: Column, least: int = 2) -> DataFrame:
    """JN13: threads with at least two members about money."""
    return threads.where(has_money).groupBy(thread).agg(F.count("*").alias("n")).where(
        F.col("n") >= least)

"""Buildings, rooms and places by text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import MILES_PER_KM, WALK_MPH, half_up, location_building, location_room, normalize_room
from wayfarer.operators.iterate import cut

#: The words that tell a place with an indoor map.
INDOOR_WORDS = ("gdc", "gates dell", "gates computer science", "melinda gates", "bill and melinda gates")


def suggest_buildings(buildings: DataFrame, q: str, limit: int = 6) -> DataFrame:
    """Dictionary rows by code prefix, name part or alias prefix, in dictionary order."""
    q = q.strip().lower()
    hit = (
        F.startswith(F.lower("code"), F.lit(q))
        | F.contains(F.lower("display_name"), F.lit(q))
        | F.contains(F.lower("full_name"), F.lit(q))
        | F.exists("aliases", lambda a: F.startswith(F.lower(a), F.lit(q)))
    )
    return buildings.filter(hit & F.lit(q != "")).orderBy("ord").limit(limit)


def search_rooms(nodes: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Rooms whose label contains the text, in label order; blank text finds none."""
    q = q.strip().lower()
    hits = nodes.filter((F.col("type") == "room") & F.contains(F.lower("label"), F.lit(q)) & F.lit(q != ""))
    return hits.orderBy(F.lower("label"), "label", "node_id").limit(limit)


def has_indoor_map(places: DataFrame, words=INDOOR_WORDS) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", "name", "address"))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(blob, F.lit(w))
    return places.withColumn("has_indoor_map", found)


def building_keys(buildings: DataFrame) -> DataFrame:
    """(key, code, hint): lower-case codes and aliases; a code wins over an alias, then the later building."""
    keys = buildings.select(
        "code",
        "ord",
        F.coalesce("search_hint", "full_name").alias("hint"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(1).alias("p"), F.lower("code").alias("key"))),
                F.transform("aliases", lambda a: F.struct(F.lit(0).alias("p"), F.lower(a).alias("key"))),
            )
        ).alias("k"),
    )
    best = F.max_by(F.struct("code", "hint"), F.struct("k.p", "ord")).alias("b")
    return keys.groupBy(F.col("k.key").alias("key")).agg(best).select("key", "b.code", "b.hint")


def canonical_building(texts: DataFrame, buildings: DataFrame, column: str = "building") -> DataFrame:
    """``canonical``: the building's code, or the text unchanged; ``hint``: the text expanded for a place search."""
    keys = building_keys(buildings)
    first = keys.select(F.col("key").alias("first_key"), F.col("hint").alias("first_hint"))
    t = texts.withColumn("key", F.lower(F.trim(column))).withColumn("first_key", F.split_part("key", F.lit(" "), F.lit(1)))
    first_word = F.when(F.contains(F.trim(column), F.lit(" ")), F.col("first_hint"))
    return (
        t.join(keys, "key", "left")
        .join(first, "first_key", "left")
        .withColumn("canonical", F.coalesce("code", column))
        .withColumn("expanded", F.coalesce("hint", first_word, F.trim(column)))
        .drop("key", "code", "hint", "first_key", "first_hint")
    )


def parse_location(texts: DataFrame, buildings: DataFrame, column: str = "location") -> DataFrame:
    """``building`` (canonical) and ``room`` of a location text."""
    parts = texts.withColumn("building", location_building(column)).withColumn("room", location_room(column))
    return canonical_building(parts, buildings).withColumn("building", F.col("canonical")).drop("canonical", "expanded")


def _grams(column, least: int = 1, most: int = 3):
    """Distinct pieces of 1 to 3 characters of a text."""
    text = F.col(column)
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(0))), lambda i: F.substr(text, i, F.lit(n)))
    short = lambda n: F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[short(n) for n in range(least, most + 1)]))


def resolve_room(queries: DataFrame, nodes: DataFrame, site: str = "site") -> DataFrame:
    """(query_id, node_id, tier) of the room that a text means, within a site.

    Tiers: 1 label contains the text; 2 equal letters and digits; 3 the same floor and number;
    4 the nearest number on that floor within 12, with the same suffix if one is given. Each tier
    is a join on equal values: the text's first letters, the compact text, the label, and the
    floor with the number's dozen and its neighbours. Texts and labels that a site has several times
    meet once, a label as its smallest node; a text of up to three letters takes its piece's first label.
    """
    pattern = r"^(\d+)\.(\d+)([a-z]?)$"
    part = lambda c, i: F.regexp_extract(c, pattern, i)
    compact = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    asked = queries.withColumn("q", F.lower(normalize_room("text"))).filter("q <> ''").select("query_id", site, "q")
    q = cut(asked.select(site, "q").distinct())
    q = q.withColumns({"q_floor": part("q", 1).try_cast("long").cast("string"), "q_no": part("q", 2).try_cast("long"), "q_end": part("q", 3)})
    rooms = nodes.filter("type = 'room'").groupBy(site, "label").agg(F.min("node_id").alias("node_id")).filter("label is not null")
    rooms = cut(rooms.withColumn("l", F.lower("label")))
    rooms = rooms.withColumns({"l_floor": part("l", 1), "l_no": part("l", 2).try_cast("long"), "l_end": part("l", 3)})
    # as the rows of a text are ordered: of tier 1 by label, of the others by gap, then by id
    none, blank = F.lit(0).cast("long"), F.lit("")
    hit = lambda df, tier, gap=none, l=blank, label=blank: df.select(
        site, "q", F.struct(F.lit(tier).alias("tier"), gap.alias("gap"), l.alias("l"), label.alias("label"), "node_id").alias("hit")
    )

    pieces = rooms.withColumn("gram", F.explode(_grams("l")))
    first = pieces.groupBy(site, "gram").agg(F.min(F.struct("l", "label", "node_id")).alias("b")).select(site, F.col("gram").alias("q"), "b.*")
    short = q.filter(F.length("q") <= 3).join(first, [site, "q"])
    long = q.filter(F.length("q") > 3).withColumn("gram", F.substring("q", 1, 3)).join(pieces, [site, "gram"]).filter(F.contains("l", F.col("q")))
    two = q.withColumn("key", compact("q")).filter(F.length("key") >= 2).join(rooms.withColumn("key", compact("l")), [site, "key"])
    three = q.withColumn("l", F.concat("q_floor", F.lit("."), F.col("q_no").cast("string"), "q_end")).join(rooms, [site, "l"])
    dozens = F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col("q_no") / 13) + i)
    floor_q = q.filter("q_no is not null").withColumn("dozen", F.explode(dozens)).withColumn("l_floor", F.col("q_floor"))
    four = floor_q.join(rooms.withColumn("dozen", F.floor(F.col("l_no") / 13)), [site, "l_floor", "dozen"])
    gap = F.abs(F.col("l_no") - F.col("q_no"))
    four = four.filter((gap <= 12) & ((F.col("q_end") == "") | (F.col("q_end") == F.col("l_end"))))
    named = [hit(df, 1, none, F.col("l"), F.col("label")) for df in (short, long)]
    found = reduce(DataFrame.unionByName, [*named, hit(two, 2), hit(three, 3), hit(four, 4, gap)])
    best = found.groupBy(site, "q").agg(F.min("hit").alias("hit"))
    return asked.join(best, [site, "q"]).select("query_id", "hit.node_id", "hit.tier")


#: Half the width of the search boxes, in degrees.
RINGS = (0.02, 0.06, 0.15)
#: Names with a text's rarest piece up to which all of them are read.
FEW_NAMES = 500


def _hits(asks: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    far = F.greatest(F.abs(F.col("lat") - F.col("qlat")), F.abs(F.col("lon") - F.col("qlon")))
    return asks.join(named, keys).filter(F.contains("low", F.col("text"))).select("query_id", "place_id", far.alias("far"))


def _nearest_names(asks: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """(query_id, place_id, far): at least the k nearest places whose name has the text, or all if fewer.

    ``asks`` (query_id, text, gram, qlat, qlon), ``named`` (place_id, low, gram, lat, lon). Texts and names meet by a piece
    of the text in boxes that hold k places on average; texts with fewer hits inside go on in boxes four times as wide.
    """
    spread = named.agg(F.countDistinct("place_id").alias("n"), F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("lost")).first()
    asked = asks.agg(F.min("qlat"), F.max("qlat"), F.min("qlon"), F.max("qlon")).first()
    span = max(spread[1] or 0.0, spread[2] or 0.0)
    width = span * (k / max(spread.n, 1)) ** 0.5
    wide = span if None in asked else max(span, asked[1] - asked[0], asked[3] - asked[2])
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    found, open_ = None, asks
    while width > 0 and width < wide and not spread.lost and not open_.isEmpty():
        box = lambda c: F.floor(F.col(c) / width)
        a = open_.withColumn("o", F.explode(offsets)).withColumns({"bx": box("qlat") + F.col("o.i"), "by": box("qlon") + F.col("o.j")}).drop("o").hint("merge")
        met = _hits(a, named.withColumns({"bx": box("lat"), "by": box("lon")}), ["gram", "bx", "by"])
        own = Window.partitionBy("query_id")
        top = met.withColumn("rn", F.row_number().over(own.orderBy("far", "place_id"))).filter(F.col("rn") <= k)
        hit = top.withColumn("inside", F.count_if(F.col("far") < width).over(own)).filter(F.col("inside") >= k)
        hit = cut(hit.select("query_id", "place_id", "far"))
        found = hit if found is None else found.unionByName(hit)
        open_ = cut(open_.join(hit.select("query_id").distinct(), "query_id", "left_anti"))
        width *= 4
    rest = _hits(open_, named, ["gram"])
    return rest if found is None else found.unionByName(rest)


def ring_place_search(queries: DataFrame, places: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, place_id, ring): places around a point whose name contains the text.

    The smallest box with three hits counts; else the largest with one; else all hits (ring 4).
    A text meets the names by its piece of three letters (or all of a shorter text) that fewest names have; where many
    have it, the nearest names are searched in boxes, as they alone decide the ring. A blank text finds nothing.
    """
    names = places.select("place_id", F.lower("name").alias("low"), "lat", "lon")
    p = cut(names.withColumn("gram", F.explode(_grams("low"))))
    sizes = p.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    q = queries.filter(F.trim("text") != "").select("query_id", F.lower(F.trim("text")).alias("text"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    size = F.least(F.length("text"), F.lit(3))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.substr(F.col("text"), i, size)))
    rarity = q.select("query_id", F.explode(pieces).alias("gram")).join(sizes, "gram", "left")
    rarest = rarity.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b")).select("query_id", "b.*")
    asks = cut(q.join(rarest.filter("n > 0"), "query_id"))
    few, many = asks.filter(F.col("n") <= FEW_NAMES).drop("n"), asks.filter(F.col("n") > FEW_NAMES).drop("n")
    hits = _hits(few, p, ["gram"])
    if not many.isEmpty():
        common = cut(p.join(many.select("gram").distinct(), "gram", "left_semi"))
        hits = hits.unionByName(_nearest_names(many, common, max(limit, 3)))
    far = F.col("far")
    ring = F.lit(4)
    for i, r in reversed(list(enumerate(RINGS, start=1))):
        ring = F.when(far <= r, i).otherwise(ring)
    own = Window.partitionBy("query_id")
    counted = hits.withColumn("ring", ring)
    for i in (1, 2, 3):
        counted = counted.withColumn(f"n{i}", F.count_if(F.col("ring") <= i).over(own))
    use = F.when(F.col("n1") >= 3, 1).when(F.col("n2") >= 3, 2).when(F.col("n3") >= 1, 3).otherwise(4)
    order = own.orderBy("far", "place_id")
    return (
        counted.withColumn("use", use)
        .filter("ring <= use")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= limit)
        .select("query_id", "place_id", F.col("use").alias("ring"))
    )


def local_buildings(queries: DataFrame, buildings: DataFrame, entrances: DataFrame) -> DataFrame:
    """(query_id, code, lat, lon): the building that the text names as a whole, or else by its first word, if its entrance is known.

    ``queries`` (query_id, text), ``entrances`` (code, lat, lon).
    """
    keys = building_keys(buildings).select("key", "code")
    text = F.lower(F.regexp_replace("text", r"^\s+|\s+$", ""))
    q = queries.select("query_id", text.alias("key"), F.regexp_extract(text, r"^\S*", 0).alias("first"))
    whole = q.join(keys, "key", "left").withColumnRenamed("code", "whole")
    both = whole.join(keys.select(F.col("key").alias("first"), F.col("code").alias("head")), "first", "left")
    return both.select("query_id", F.coalesce("whole", "head").alias("code")).join(entrances, "code").select("query_id", "code", "lat", "lon")


def place_search(queries: DataFrame, places: DataFrame, buildings: DataFrame, entrances: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, code, place_id, ring): a known building alone (ring 0); for any other text the places in rings around the point.

    A text that names a building without a known entrance is expanded before the rings are searched.
    """
    local = local_buildings(queries, buildings, entrances).select("query_id", "code", F.lit(None).cast(places.schema["place_id"].dataType).alias("place_id"), F.lit(0).alias("ring"))
    rest = queries.join(local.select("query_id"), "query_id", "left_anti")
    rest = canonical_building(rest, buildings, "text").select("query_id", F.col("expanded").alias("text"), "lat", "lon")
    found = ring_place_search(rest, places, limit).select("query_id", F.lit(None).cast("string").alias("code"), "place_id", "ring")
    return local.unionByName(found)


def parse_place_results(rows: DataFrame) -> DataFrame:
    """Place rows from geocoder rows (place_id, display_name, lat, lon as text)."""
    parts = F.transform(F.split("display_name", ","), lambda p: F.trim(p))
    return rows.select(
        F.col("place_id").cast("string").alias("place_id"),
        F.get(parts, 0).alias("name"),
        F.array_join(F.slice(parts, 2, 3), ", ").alias("address"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
    )


ROUTE_SCHEMA = (
    "code string, routes array<struct<distance: double, duration: double, geometry: struct<coordinates: array<array<double>>>>>"
)


def parse_route_results(rows: DataFrame, on_foot: bool = True) -> DataFrame:
    """(route_id, seq, lat, lon, distance_mi, duration_min) from route responses (route_id, body)."""
    first = F.get("r.routes", 0)
    miles = first.distance / 1000 * MILES_PER_KM
    minutes = F.when(F.lit(on_foot) & (first.duration > 0), half_up(first.duration / 60)).otherwise(half_up(miles / WALK_MPH * 60))
    return (
        rows.withColumn("r", F.from_json("body", ROUTE_SCHEMA))
        .filter((F.col("r.code") == "Ok") & (F.size(first.geometry.coordinates) > 0))
        .select(
            "route_id",
            F.posexplode(first.geometry.coordinates).alias("seq", "p"),
            miles.alias("distance_mi"),
            F.greatest(F.lit(1), minutes).cast("long").alias("duration_min"),
        )
        .select("route_id", "seq", F.get("p", 1).alias("lat"), F.get("p", 0).alias("lon"), "distance_mi", "duration_min")
    )

"""Floor rasters as cell tables (floor_id, x, y, passable): morphology, distances, regions, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.iterate import cut, min_labels

#: Margins of a page that hold no rooms, in shares of its size.
MARGINS = {"left": 0.10, "right": 0.10, "top": 0.10, "bottom": 0.18}


def crop_margins(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells in the margins become wall."""
    inside = (
        (F.col("x") >= int(width * MARGINS["left"]))
        & (F.col("x") < width - int(width * MARGINS["right"]))
        & (F.col("y") >= int(height * MARGINS["top"]))
        & (F.col("y") < height - int(height * MARGINS["bottom"]))
    )
    return cells.withColumn("passable", F.when(inside, F.col("passable")).otherwise(0))


def threshold_pixels(pixels: DataFrame, t: int = 200) -> DataFrame:
    return pixels.withColumn("passable", F.when(F.col("lum") > t, 1).otherwise(0))


def _line(cells: DataFrame, value: str, along: str, r: int, op) -> DataFrame:
    across = "y" if along == "x" else "x"
    w = Window.partitionBy("floor_id", across).orderBy(along).rangeBetween(-r, r)
    return cells.withColumn(value, op(value).over(w))


def box_morphology(cells: DataFrame, k: int, op: str, iterations: int = 1, kx: int | None = None, ky: int | None = None) -> DataFrame:
    """Dilate, erode, open or close the walls (passable 0) by a box, one pass along x and one along y.

    Cells beyond the table change nothing. ``kx`` and ``ky`` make line kernels.
    """
    rx, ry = (kx or k) // 2, (ky or k) // 2
    if op in ("open", "close"):
        one, two = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return box_morphology(box_morphology(cells, k, one, iterations, kx, ky), k, two, iterations, kx, ky)
    how = F.min if op == "dilate" else F.max
    out = cells
    for _ in range(iterations):
        for along, r in (("x", rx), ("y", ry)):
            if r:
                out = _line(out, "passable", along, r, how)
    return out


def seal_dash_gaps(cells: DataFrame, k: int = 21) -> DataFrame:
    """Wall where closing along x and closing along y both give wall."""
    a = box_morphology(cells, 1, "close", kx=k).select("floor_id", "x", "y", F.col("passable").alias("a"))
    b = box_morphology(cells, 1, "close", ky=k).select("floor_id", "x", "y", F.col("passable").alias("b"))
    both = a.join(b, ["floor_id", "x", "y"]).withColumn("sealed", F.greatest("a", "b"))
    return both.join(cells, ["floor_id", "x", "y"]).select("floor_id", "x", "y", F.least("passable", "sealed").alias("passable"))


def distance_to_wall(cells: DataFrame) -> DataFrame:
    """``dist``: exact distance to the nearest wall of the floor; ``dist255``: scaled to the floor's largest, cut to whole numbers.

    The first pass finds the nearest wall in the column; the second looks along the row no
    farther than that distance, since no farther column can be nearer. A row of the page is held as an
    array, so no cell is copied or joined.
    """
    col = Window.partitionBy("floor_id", "x").orderBy("y")
    up = F.last(F.when(F.col("passable") == 0, F.col("y")), True).over(col.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(F.when(F.col("passable") == 0, F.col("y")), True).over(col.rowsBetween(0, Window.unboundedFollowing))
    first = cells.withColumn("g", F.least(F.col("y") - up, down - F.col("y")))
    rows = first.groupBy("floor_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "passable", "g"))).alias("row"))

    def of(c, i):
        reach = F.coalesce(c.g, F.size("row")).cast("int")
        near = F.slice("row", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1)
        d2 = F.array_min(F.transform(near, lambda o: (o.x - c.x) * (o.x - c.x) + o.g * o.g))
        return F.struct(c.x.alias("x"), c.passable.alias("passable"), F.when(c.passable == 0, 0.0).otherwise(F.sqrt(d2)).alias("dist"))

    out = rows.select("floor_id", "y", F.inline(F.transform("row", of)))
    top = F.max("dist").over(Window.partitionBy("floor_id"))
    return out.withColumn("dist255", F.when(top > 0, F.floor(F.col("dist") / top * 255)).otherwise(0).cast("int")).select(
        "floor_id", "x", "y", "passable", "dist", "dist255"
    )


#: Cells of a row that one number holds, a bit each.
BITS = 64


def _shift(name: str, value, by) -> Column:
    return F.call_function(name, value, F.lit(by).cast("int"))


def cell_words(cells: DataFrame) -> DataFrame:
    """(floor_id, y, block, own, free, wall): 64 neighbouring cells of a row as the bits of three numbers.

    ``own`` marks cells with a row, ``free`` those with passable 1, ``wall`` those with 0. Cells combine
    before they are shuffled, and what follows handles a row for 64 of them.
    """
    bit = _shift("shiftleft", F.lit(1).cast("long"), F.col("x").cast("long").bitwiseAND(BITS - 1))
    held = lambda v: F.bit_or(F.when(F.col("passable") == v, bit).otherwise(0))
    block = F.shiftright(F.col("x").cast("long"), 6).alias("block")
    return cells.groupBy("floor_id", "y", block).agg(F.bit_or(bit).alias("own"), held(1).alias("free"), held(0).alias("wall"))


def _beside(words: DataFrame, names, along: str, r: int) -> DataFrame:
    """The named words with the cells within ``r`` of theirs along x or y, as far as these have rows."""
    own = F.col("own")
    if along == "y":
        near = Window.partitionBy("floor_id", "block").orderBy("y").rangeBetween(-r, r)
        return words.withColumns({n: F.bit_or(n).over(near).bitwiseAND(own) for n in names})
    row, far = Window.partitionBy("floor_id", "y").orderBy("block"), r // BITS + 1
    other = lambda n, q: F.coalesce(F.bit_or(n).over(row.rangeBetween(q, q)), F.lit(0).cast("long")) if q else F.col(n)
    wide = words.withColumns({f"{n}_{q + far}": other(n, q) for n in names for q in range(-far, far + 1)})

    def spread(n):
        at = lambda q: F.col(f"{n}_{q + far}")
        out = at(0)
        for q, t in (divmod(s, BITS) for s in range(1, r + 1)):
            out = out.bitwiseOR(F.shiftleft(at(-q), t)).bitwiseOR(F.shiftrightunsigned(at(q), t))
            if t:
                out = out.bitwiseOR(F.shiftrightunsigned(at(-q - 1), BITS - t)).bitwiseOR(F.shiftleft(at(q + 1), BITS - t))
        return out.bitwiseAND(own)

    return wide.withColumns({n: spread(n) for n in names}).select(words.columns)


def word_morphology(words: DataFrame, k: int, op: str, iterations: int = 1) -> DataFrame:
    """``box_morphology`` of the cells behind words."""
    if op in ("open", "close"):
        one, two = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return word_morphology(word_morphology(words, k, one, iterations), k, two, iterations)
    first, then = ("wall", "free") if op == "dilate" else ("free", "wall")
    for along in ("x", "y") * iterations if k // 2 else ():
        words = _beside(words, (first, then), along, k // 2)
        words = words.withColumn(then, F.col(then).bitwiseAND(F.bitwise_not(F.col(first))))
    return words


def _runs(words: DataFrame, name: str) -> DataFrame:
    """(floor_id, y, block, x0, x1): runs of cells in the words of one name; a run ends with its word."""
    edge = lambda before: F.col(name).bitwiseAND(F.bitwise_not(before))
    bits = lambda c: F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(c, i) == 1)
    sides = words.filter(F.col(name) != 0).select(
        "floor_id", "y", "block", edge(F.shiftleft(name, 1)).alias("l"), edge(F.shiftrightunsigned(name, 1)).alias("r")
    )
    x = lambda i: F.col("block") * BITS + i
    both = F.zip_with(bits(F.col("l")), bits(F.col("r")), lambda a, b: F.struct(x(a).alias("x0"), x(b).alias("x1")))
    return sides.select("floor_id", "y", "block", F.inline(both))


def _run_words(runs: DataFrame, name: str) -> DataFrame:
    """(floor_id, y, block, the named word) of runs."""
    bits = _shift("shiftrightunsigned", F.lit(-1).cast("long"), BITS - 1 - (F.col("x1") - F.col("x0")))
    word = _shift("shiftleft", bits, F.col("x0").bitwiseAND(BITS - 1))
    return runs.groupBy("floor_id", "y", "block").agg(F.bit_or(word).alias(name))


def _labelled_runs(words: DataFrame, name: str, connectivity: int = 8) -> DataFrame:
    """Runs with ``place``, the first cell's ``y * 2**20 + x``, and ``part``, a number that the runs of a component share."""
    runs = _runs(words, name).withColumn("place", F.col("y").cast("long") * 2**20 + F.col("x0"))
    runs = cut(runs.withColumn("run", F.monotonically_increasing_id()))
    slack = 1 if connectivity == 8 else 0
    block = lambda c: F.shiftright(c, 6)
    spot = lambda y, b, reach: F.struct(y.alias("y"), b.alias("block"), F.lit(reach).alias("reach"))
    under = F.transform(F.sequence(block(F.col("x0") - slack), block(F.col("x1") + slack)), lambda b: spot(F.col("y") - 1, b, slack))
    left = F.filter(F.array(spot(F.col("y") + 0, F.col("block") - 1, 1)), lambda _: F.col("x0").bitwiseAND(BITS - 1) == 0)
    ends = runs.select("floor_id", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("b"), F.inline(F.concat(under, left)))
    touch = runs.join(ends, ["floor_id", "y", "block"]).filter((F.col("b0") <= F.col("x1") + F.col("reach")) & (F.col("b1") >= F.col("x0") - F.col("reach")))
    labels = min_labels(runs.select(F.col("run").alias("node")), touch.select(F.col("run").alias("a"), "b"))
    return runs.join(labels, F.col("run") == F.col("node")).select("floor_id", "y", "block", "x0", "x1", "place", F.col("component").alias("part"))


def _run_cells(runs: DataFrame, cells: DataFrame, *more: str) -> DataFrame:
    """The cells of runs, x as in ``cells``."""
    x = F.col("x").cast(cells.schema["x"].dataType).alias("x")
    return runs.select("floor_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *more).select("floor_id", x, "y", *more)


def cell_components(cells: DataFrame, value: int = 1, connectivity: int = 8) -> DataFrame:
    """(floor_id, x, y, component) of cells of one value: runs of rows, joined where they touch, then labelled.

    A component is named by its smallest ``y * 2**20 + x`` within the floor.
    """
    runs = cut(_labelled_runs(cell_words(cells.filter(F.col("passable") == value)), "own", connectivity))
    named = runs.groupBy("part").agg(F.min("place").alias("component"))
    return _run_cells(runs.join(named, "part"), cells, "component")


def component_stats(labelled: DataFrame) -> DataFrame:
    size = lambda c: F.max(c) - F.min(c) + 1
    out = labelled.groupBy("floor_id", "component").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), size("x").alias("width"), size("y").alias("height")
    )
    return out.withColumn("aspect", F.greatest("width", "height") / F.least("width", "height"))


def passable_share(cells: DataFrame) -> DataFrame:
    return cells.groupBy("floor_id").agg((F.avg("passable") * 100).alias("percent"))


def corridor_component_vote(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """(floor_id, component): the component that holds most nodes (floor_id, x, y cells); the largest where none has any."""
    votes = labelled.join(nodes.select("floor_id", "x", "y", F.lit(1).alias("vote")), ["floor_id", "x", "y"], "left")
    tally = votes.groupBy("floor_id", "component").agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("area"))
    order = Window.partitionBy("floor_id").orderBy(F.desc(F.coalesce("votes", F.lit(0))), F.desc("area"), "component")
    return tally.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("floor_id", "component")


def main_component(labelled: DataFrame) -> DataFrame:
    """Cells of each floor's largest component."""
    sized = labelled.groupBy("floor_id", "component").count()
    order = Window.partitionBy("floor_id").orderBy(F.desc("count"), "component")
    best = sized.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("floor_id", "component")
    return labelled.join(best, ["floor_id", "component"], "left_semi")


def with_cells_passable(cells: DataFrame, marked: DataFrame, keep: bool = True) -> DataFrame:
    """Passable only where ``marked`` has the cell (or, with keep False, where it has not)."""
    m = marked.select("floor_id", "x", "y", F.lit(1).alias("m")).distinct()
    hit = F.col("m").isNotNull() if keep else F.col("m").isNull()
    return cells.join(m, ["floor_id", "x", "y"], "left").withColumn("passable", F.when(hit, F.col("passable")).otherwise(0)).drop("m")


def _node_votes(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(floor_id, part): what ``corridor_component_vote`` chooses among labelled runs."""
    whole = F.col("x").cast("long")
    at = nodes.filter(F.col("x") == whole).groupBy("floor_id", "y", whole.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("block", F.shiftright("x", 6))
    held = runs.join(at, ["floor_id", "y", "block"]).filter(F.col("x").between(F.col("x0"), F.col("x1")))
    votes = held.groupBy("part").agg(F.sum("n").alias("votes"), F.sum(F.col("n") - 1).alias("again"))
    tally = _sizes(runs).join(votes, "part", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = Window.partitionBy("floor_id").orderBy(F.desc(zero("votes")), F.desc(F.col("area") + zero("again")), "place")
    return tally.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("floor_id", "part")


def _sizes(runs: DataFrame) -> DataFrame:
    """(floor_id, part, area, place) of labelled runs."""
    return runs.groupBy("floor_id", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("place").alias("place"))


def _marked(words: DataFrame, runs: DataFrame, k: int, iterations: int = 1) -> DataFrame:
    """Words with ``m``, the cells of runs grown by a box as ``box_morphology`` dilates."""
    out = words.join(_run_words(runs, "m"), ["floor_id", "y", "block"], "left").withColumn("m", F.coalesce("m", F.lit(0).cast("long")))
    for along in ("x", "y") * iterations if k // 2 else ():
        out = _beside(out, ("m",), along, k // 2)
    return out


def corridor_network(cells: DataFrame, nodes: DataFrame, k: int = 19) -> DataFrame:
    """Cells of the corridor: doors sealed, the component of most nodes, grown back and kept where passable.

    Cells are read once, into words; only the corridor's own become rows again.
    """
    words = cut(cell_words(cells))
    runs = cut(_labelled_runs(word_morphology(words, k, "close"), "free"))
    best = runs.join(_node_votes(runs, nodes), ["floor_id", "part"], "left_semi")
    marked = _marked(words, best, k)
    back = cut(_labelled_runs(marked.withColumn("free", F.col("free").bitwiseAND(F.col("m"))), "free"))
    order = Window.partitionBy("floor_id").orderBy(F.desc("area"), "place")
    most = _sizes(back).withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("floor_id", "part")
    return _run_cells(back.join(most, ["floor_id", "part"], "left_semi"), cells)


def exterior_cells(cells: DataFrame, seal: int = 25, seal_rounds: int = 4, grow: int = 15, grow_rounds: int = 2, least: float = 20.0) -> DataFrame:
    """Passable cells outside: reachable from the border once gaps are sealed, then grown where walls are far."""
    words = cut(cell_words(cells))
    runs = cut(_labelled_runs(word_morphology(words, seal, "dilate", seal_rounds), "free", 4))
    ends = cells.groupBy("floor_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y")])
    border = runs.join(ends, "floor_id").filter("x0 = low_x or x1 = high_x or y = low_y or y = high_y").select("part").distinct()
    outside = cut(runs.join(border, "part", "left_semi"))
    grown = _marked(words, outside, grow, grow_rounds)
    far = distance_to_wall(cells).filter(F.col("dist") > least).select("floor_id", "x", "y")
    return _run_cells(outside, cells).union(_run_cells(_runs(grown, "m"), cells).join(far, ["floor_id", "x", "y"], "left_semi")).distinct()


def corridor_skeleton(cells: DataFrame, low: float = 8, high: float = 55, least_cells: int = 30, aspect: float = 1.5, small: int = 300) -> DataFrame:
    """Cells of the morphological skeleton of corridor-wide parts: wall distance in a band, parts long or small."""
    near = distance_to_wall(cells)
    band = near.withColumn("passable", ((F.col("dist") > low) & (F.col("dist") < high)).cast("int")).select("floor_id", "x", "y", "passable")
    band = cut(band)
    labelled = cut(cell_components(band, 1))
    stats = component_stats(labelled).filter((F.col("area") >= least_cells) & ((F.col("aspect") >= aspect) | (F.col("area") < small)))
    kept = labelled.join(stats.select("floor_id", "component"), ["floor_id", "component"], "left_semi").select("floor_id", "x", "y")
    now, skeleton = cut(kept), None
    while True:
        eroded = cut(_cross(now, erode=True))
        opened = _cross(eroded, erode=False)
        part = cut(now.join(opened, ["floor_id", "x", "y"], "left_anti"))
        skeleton = part if skeleton is None else skeleton.union(part)
        if eroded.isEmpty():
            return skeleton.distinct()
        now = eroded


CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def _moved(cells: DataFrame, steps) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    return cells.withColumn("o", F.explode(offsets)).select(
        "floor_id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")
    )


def _cross(cells: DataFrame, erode: bool) -> DataFrame:
    """Erode or dilate a set of cells by the five-cell cross."""
    hits = _moved(cells, CROSS).groupBy("floor_id", "x", "y").count()
    return hits.filter("count = 5").drop("count") if erode else hits.drop("count")


def skeleton_nodes(skeleton: DataFrame) -> DataFrame:
    """(floor_id, x, y, kind): cells with one neighbour are ends, with three or more junctions."""
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    skeleton = cut(skeleton)
    n = cut(_moved(skeleton, around).groupBy("floor_id", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    kind = F.when(F.col("n") == 1, "end").when(F.col("n") >= 3, "junction")
    return skeleton.join(n, ["floor_id", "x", "y"]).withColumn("kind", kind).filter("kind is not null").select("floor_id", "x", "y", "kind")


def region_boundary_edges(regions: DataFrame, scale: float = 3.0, cells: DataFrame | None = None) -> DataFrame:
    """(floor_id, a, b, steps, weight, ax, ay, bx, by): the meeting cells of least steps of each pair of touching regions.

    With ``cells`` one of the two must lie inside the raster's outermost rows and columns.
    """
    two = F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")))
    inner = lambda x, y: (F.col(x) > F.col("lox")) & (F.col(x) < F.col("hix")) & (F.col(y) > F.col("loy")) & (F.col(y) < F.col("hiy"))
    one = regions.withColumn("o", F.explode(two)).select(
        "floor_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("source_id").alias("sa"), F.col("steps").alias("da"), (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")
    )
    pair = one.join(regions.select("floor_id", "x", "y", F.col("source_id").alias("sb"), F.col("steps").alias("db")), ["floor_id", "x", "y"]).filter("sa <> sb")
    if cells is not None:
        ends = cells.groupBy("floor_id").agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")])
        pair = pair.join(ends, "floor_id").filter(inner("ax", "ay") | inner("x", "y"))
    swap = F.col("sa") > F.col("sb")
    meet = F.struct(
        (F.col("da") + F.col("db")).alias("steps"),
        F.when(swap, F.col("y")).otherwise(F.col("ay")).alias("ay"),
        F.when(swap, F.col("x")).otherwise(F.col("ax")).alias("ax"),
        F.when(swap, F.col("ay")).otherwise(F.col("y")).alias("by"),
        F.when(swap, F.col("ax")).otherwise(F.col("x")).alias("bx"),
    )
    best = pair.groupBy("floor_id", F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).agg(F.min(meet).alias("m"))
    return best.select("floor_id", "a", "b", "m.*", (F.col("m.steps") / scale).alias("weight"))


def _on_line(a, b, k, n) -> Column:
    """The coordinate, between ``a`` and ``b``, of a straight line's cell ``k`` of ``n``."""
    step = F.signum(b - a) * F.floor((F.abs(b - a) * 2 * k + n) / (2 * F.greatest(n, F.lit(1))))
    return F.when(n == 0, a).otherwise(a + step).cast("long")


def lines_clear(lines: DataFrame, cells: DataFrame, corners: bool = True) -> DataFrame:
    """(line_id, clear): no wall on the line; with ``corners`` no diagonal step between two walls either.

    Lines are dealt among tasks before their cells are counted out, however few files they come from.
    """
    n, k = F.col("n"), F.col("k")
    dealt = lines.select("line_id", "floor_id", "x0", "y0", "x1", "y1").repartition("line_id")
    steps = dealt.withColumn("n", F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))).cast("long"))
    steps = steps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    at = lambda c, i: _on_line(F.col(f"{c}0"), F.col(f"{c}1"), i, n)
    walk = steps.select("line_id", "floor_id", "k", at("x", k).alias("x"), at("y", k).alias("y"), at("x", k - 1).alias("bx"), at("y", k - 1).alias("by"))
    spot = lambda x, y, kind: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(kind).alias("kind"))
    own = F.array(spot("x", "y", 0))
    if corners:
        diagonal = (k > 0) & (F.col("x") != F.col("bx")) & (F.col("y") != F.col("by"))
        own = F.when(diagonal, F.array(spot("x", "y", 0), spot("x", "by", 1), spot("bx", "y", 1))).otherwise(own)
    spots = walk.select("line_id", "floor_id", "k", F.explode(own).alias("c")).select("line_id", "floor_id", "c.*", "k")
    walls = cells.filter("passable = 0").select("floor_id", "x", "y")
    hits = spots.join(walls, ["floor_id", "x", "y"], "left_semi").groupBy("line_id", "k", "kind").count()
    bad = hits.filter("kind = 0 or count = 2").select("line_id").distinct().withColumn("bad", F.lit(True))
    return lines.select("line_id").join(bad, "line_id", "left").select("line_id", F.col("bad").isNull().alias("clear"))


def rdp_simplify(paths: DataFrame, epsilon: float, cells: DataFrame | None = None) -> DataFrame:
    """Points (path_id, seq, x, y) of each polyline that offsets above epsilon from its spans' lines need, all polylines together.

    Offsets count to nine places; of equal ones the first point splits the span.
    With ``cells`` (floor_id too) a span is only drawn straight where its line of cells is clear;
    a blocked span is split at its middle point.
    """
    order = Window.partitionBy("path_id").orderBy("seq")
    rows = cut(paths.withColumn("at", F.row_number().over(order) - 1))
    ends = rows.groupBy("path_id").agg(F.min("at").alias("i"), F.max("at").alias("j"))
    open_ = cut(ends.filter("j > i"))
    kept = ends.select("path_id", F.explode(F.array("i", "j")).alias("at"))
    more = ["floor_id"] if cells is not None else []
    p = lambda a, n, *c: rows.select("path_id", F.col("at").alias(a), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), *c)
    while not open_.isEmpty():
        spans = cut(open_.join(p("i", 0, *more), ["path_id", "i"]).join(p("j", 1), ["path_id", "j"]).filter("j > i + 1"))
        inner = spans.join(rows.select("path_id", "at", "x", "y"), "path_id").filter("at > i and at < j")
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        area = F.abs(dx * (F.col("y0") - F.col("y")) - (F.col("x0") - F.col("x")) * dy)
        off = inner.withColumn("d", F.when(F.hypot(dx, dy) < 1e-10, 0.0).otherwise(F.round(area / F.hypot(dx, dy), 9)))
        far = off.groupBy("path_id", "i", "j").agg(F.max(F.struct("d", (-F.col("at")).alias("s"))).alias("m"))
        split = far.filter(F.col("m.d") > epsilon).select("path_id", "i", "j", (-F.col("m.s")).alias("k"))
        if cells is not None:
            flat = spans.join(split.select("path_id", "i", "j"), ["path_id", "i", "j"], "left_anti").filter(F.hypot(dx, dy) >= 1e-10)
            ends_ = {c: F.floor(c).cast("long") for c in ("x0", "y0", "x1", "y1")}
            sight = lines_clear(flat.withColumn("line_id", F.struct("path_id", "i", "j")).withColumns(ends_), cells).filter("not clear")
            middle = sight.select("line_id.*").withColumn("k", F.col("i") + F.floor((F.col("j") - F.col("i") + 1) / 2).cast("int"))
            split = split.unionByName(middle)
        split = cut(split)
        kept = cut(kept.union(split.select("path_id", "k")))
        open_ = cut(split.select("path_id", "i", F.col("k").alias("j")).union(split.select("path_id", F.col("k"), "j")))
    return rows.join(kept.distinct(), ["path_id", "at"], "left_semi").select(paths.columns)


def mask_text_regions(cells: DataFrame, labels: DataFrame, width: float = 1.0, height: float = 2.0, margin: int = 5) -> DataFrame:
    """Cells inside label boxes (floor_id, x, y centre, text) become passable."""
    half = F.ceil(F.length("text") * width / 2) + margin
    tall = F.lit(int(height) + margin)
    box = labels.select(
        "floor_id",
        F.explode(F.sequence((F.col("x") - half).cast("long"), (F.col("x") + half).cast("long"))).alias("x"),
        F.sequence((F.col("y") - tall).cast("long"), (F.col("y") + tall).cast("long")).alias("ys"),
    ).select("floor_id", "x", F.explode("ys").alias("y"), F.lit(1).alias("m"))
    return cells.join(box.distinct(), ["floor_id", "x", "y"], "left").withColumn("passable", F.coalesce("m", "passable")).drop("m")


def mask_exterior_hull(cells: DataFrame, rooms: DataFrame, k: int = 51, rounds: int = 2) -> DataFrame:
    """With three rooms or more, cells outside their hull, widened by the box, become wall."""
    from wayfarer.operators.spatial import convex_hulls

    many = rooms.groupBy("floor_id").count().filter("count >= 3").select("floor_id")
    hull = convex_hulls(rooms.join(many, "floor_id", "left_semi").select("floor_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    edges = F.transform(F.sequence(F.lit(1), F.size("hull")), lambda i: F.struct(F.get("hull", i - 1).alias("p"), F.get("hull", i % F.size("hull")).alias("q")))
    sided = cells.join(hull.withColumn("sides", edges), "floor_id", "left")
    inside = F.forall("sides", lambda s: (s.q.x - s.p.x) * (F.col("y") - s.p.y) - (s.q.y - s.p.y) * (F.col("x") - s.p.x) >= 0)
    mask = sided.select("floor_id", "x", "y", F.when(F.col("hull").isNull(), 0).otherwise(F.when(inside, 0).otherwise(1)).alias("passable"))
    wide = box_morphology(mask, k, "dilate", rounds).filter("passable = 0")
    return with_cells_passable(cells, wide)


def room_region_block(points: DataFrame, labelled: DataFrame, corridor: DataFrame, least: int = 3000, share: float = 0.15) -> DataFrame:
    """(floor_id, component) of room regions to block: of fitting size, around a room, without a corridor point."""
    total = labelled.groupBy("floor_id").agg(F.count(F.lit(1)).alias("total"))
    fit = labelled.groupBy("floor_id", "component").agg(F.count(F.lit(1)).alias("area")).join(total, "floor_id")
    fit = fit.filter((F.col("area") >= least) & (F.col("area") <= F.col("total") * share))
    held = labelled.join(points.select("floor_id", "x", "y"), ["floor_id", "x", "y"], "left_semi").select("floor_id", "component").distinct()
    walked = labelled.join(corridor.select("floor_id", "x", "y"), ["floor_id", "x", "y"], "left_semi").select("floor_id", "component").distinct()
    return fit.join(held, ["floor_id", "component"], "left_semi").join(walked, ["floor_id", "component"], "left_anti").select("floor_id", "component", "area")

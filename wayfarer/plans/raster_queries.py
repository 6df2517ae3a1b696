"""Registered queries over floor rasters and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfarer.operators import floor_paths as fp
from wayfarer.operators import raster as ra
from wayfarer.plans.registry import query, r6
from wayfarer.plans.sql_parts import least_costs
from wayfarer.sources import io

CUTX = "least(passable, CASE WHEN x>=4 AND x<44 AND y>=4 AND y<40 THEN 1 ELSE 0 END)"
few = lambda t: t("f_cells")

query("fil9_crop_margins", f"SELECT floor_id, x, y, {CUTX} AS passable FROM f_cells")(lambda t: ra.crop_margins(t("f_cells"), 48, 48))
query("fil10_threshold_pixels", "SELECT floor_id, x, y, CASE WHEN (x*7+y*13)%256>200 THEN 1 ELSE 0 END AS passable FROM f_cells")(
    lambda t: ra.threshold_pixels(t("f_cells").withColumn("lum", (F.col("x") * 7 + F.col("y") * 13) % 256)).drop("lum")
)
query("win9_box_morphology", "WITH a AS (SELECT floor_id, x, y, min(passable) OVER (PARTITION BY floor_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p FROM f_cells) SELECT floor_id, x, y, min(p) OVER (PARTITION BY floor_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS passable FROM a")(
    lambda t: ra.box_morphology(t("f_cells"), 3, "dilate")
)
LINE = "(PARTITION BY floor_id, {b} ORDER BY {a} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
query("win10_seal_dash_gaps", f"""WITH a AS (SELECT floor_id, x, y, passable, min(passable) OVER {LINE.format(a='x', b='y')} AS dx, min(passable) OVER {LINE.format(a='y', b='x')} AS dy FROM f_cells)
 SELECT floor_id, x, y, least(passable, greatest(max(dx) OVER {LINE.format(a='x', b='y')}, max(dy) OVER {LINE.format(a='y', b='x')})) AS passable FROM a""")(lambda t: ra.seal_dash_gaps(t("f_cells"), 5))
query("win11_distance_to_wall", f"""WITH c AS (SELECT * FROM f_cells), d AS (SELECT a.floor_id, a.x, a.y, a.passable, CASE WHEN a.passable=0 THEN 0 ELSE (SELECT sqrt(min(pow(a.x-b.x,2)+pow(a.y-b.y,2))) FROM c b WHERE b.floor_id=a.floor_id AND b.passable=0) END AS dist FROM c a)
 SELECT floor_id, x, y, round(dist,6) AS dist, CAST(floor(dist/max(dist) OVER (PARTITION BY floor_id)*255) AS INT) AS dist255 FROM d""")(lambda t: r6(ra.distance_to_wall(few(t)).drop("passable"), "dist"))
query("agg11_passable_share", "SELECT floor_id, round(avg(passable)*100,6) AS percent FROM f_cells GROUP BY floor_id")(lambda t: r6(ra.passable_share(t("f_cells")), "percent"))
LABELS = """w AS (SELECT floor_id, x, y, y*1048576+x AS k FROM f_cells WHERE passable=0), r AS (SELECT floor_id, k, k AS seen FROM w UNION SELECT r.floor_id, r.k, o.k FROM r JOIN w s ON s.k=r.seen AND s.floor_id=r.floor_id JOIN w o ON o.floor_id=s.floor_id AND abs(o.x-s.x)<=1 AND abs(o.y-s.y)<=1),
 lab AS (SELECT w.floor_id, w.x, w.y, min(seen) AS component FROM w JOIN r ON r.k=w.k AND r.floor_id=w.floor_id GROUP BY ALL)"""
walls = lambda t: ra.cell_components(t("f_cells"), 0, 8)
query("gra3_cell_components", f"WITH RECURSIVE {LABELS} SELECT * FROM lab")(walls)
query("agg9_component_stats", f"WITH RECURSIVE {LABELS} SELECT floor_id, component, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x)-min(x)+1 AS width, max(y)-min(y)+1 AS height, round(greatest(max(x)-min(x)+1,max(y)-min(y)+1)::DOUBLE/least(max(x)-min(x)+1,max(y)-min(y)+1),6) AS aspect FROM lab GROUP BY floor_id, component")(
    lambda t: r6(ra.component_stats(walls(t)), "aspect")
)
NOD = "SELECT floor_id, x, y FROM f_cells WHERE (x*3+y)%17=0"
query("agg10_corridor_component_vote", f"WITH RECURSIVE {LABELS}, n AS ({NOD}) SELECT floor_id, component FROM (SELECT lab.floor_id, component, count(n.x) AS v, count(*) AS area FROM lab LEFT JOIN n ON n.floor_id=lab.floor_id AND n.x=lab.x AND n.y=lab.y GROUP BY ALL) z QUALIFY row_number() OVER (PARTITION BY floor_id ORDER BY v DESC, area DESC, component)=1")(
    lambda t: ra.corridor_component_vote(walls(t), t.sql(NOD))
)
#: Rooms of seven by seven cells between walls; a closed form names them in the SQL.
ROOMS = "SELECT floor_id, x, y, CASE WHEN x%8=0 OR y%8=0 THEN 0 ELSE 1 END AS passable FROM f_cells"
query("joi26_room_contour_block", f"""WITH n AS ({NOD}), lab AS (SELECT floor_id, x, y, (y//8*8+1)*1048576+x//8*8+1 AS component FROM ({ROOMS}) r WHERE passable=1), f AS (SELECT floor_id, component, count(*) AS area, sum(count(*)) OVER (PARTITION BY floor_id) AS total FROM lab GROUP BY floor_id, component)
 SELECT floor_id, component, area FROM f WHERE area>=2 AND area<=total*0.5 AND (floor_id, component) IN (SELECT (floor_id, component) FROM lab JOIN n USING (floor_id, x, y)) AND (floor_id, component) NOT IN (SELECT (floor_id, component) FROM lab WHERE x=1)""")(
    lambda t: ra.room_region_block(t.sql(NOD), ra.cell_components(t.sql(ROOMS), 1, 4), t("f_cells").filter("x = 1"), 2, 0.5)
)
LAB = "SELECT floor_id, x, y, 'AB' AS text FROM f_cells WHERE x%16=8 AND y%16=8"
query("joi27_mask_text_regions", f"SELECT c.floor_id, c.x, c.y, CASE WHEN EXISTS (SELECT 1 FROM ({LAB}) l WHERE l.floor_id=c.floor_id AND abs(l.x-c.x)<=2 AND abs(l.y-c.y)<=3) THEN 1 ELSE passable END AS passable FROM f_cells c")(
    lambda t: ra.mask_text_regions(t("f_cells"), t.sql(LAB), margin=1)
)
query("joi28_mask_exterior_hull")(lambda t: ra.mask_exterior_hull(few(t), few(t).filter("x % 9 = 4 and y % 11 = 5 and x between 10 and 36"), 5, 1))
LN = "SELECT floor_id*10000+y*100+x AS line_id, floor_id, cast(x as bigint) AS x0, cast(y as bigint) AS y0, cast(x + (x*5+y*3)%11 - 5 as bigint) AS x1, cast(y + (x*3+y*7)%9 - 4 as bigint) AS y1 FROM f_cells WHERE x BETWEEN 6 AND 40 AND y BETWEEN 5 AND 41"
STEP = "(a0 + sign(a1-a0)*floor((abs(a1-a0)*2*k+n)/(2*greatest(n,1))))"
AXIS = lambda c, k: STEP.replace("a0", f"{c}0").replace("a1", f"{c}1").replace("*k+", f"*({k})+")
WHOLE = lambda c, k: f"cast({AXIS(c, k)} AS BIGINT)"
query("sca22_bresenham_clear", f"""WITH l AS (SELECT *, greatest(abs(x1-x0), abs(y1-y0)) AS n FROM ({LN}) z), s AS (SELECT *, unnest(range(n+1)) AS k FROM l), w AS MATERIALIZED (SELECT floor_id::BIGINT AS floor_id, x::BIGINT AS x, y::BIGINT AS y FROM f_cells WHERE passable=0),
 c AS MATERIALIZED (SELECT line_id, floor_id::BIGINT AS floor_id, k, {WHOLE('x','k')} AS x, {WHOLE('y','k')} AS y, {WHOLE('x','k-1')} AS bx, {WHOLE('y','k-1')} AS by_ FROM s),
 d AS MATERIALIZED (SELECT line_id, floor_id, x, y, bx, by_ FROM c WHERE k>0 AND x<>bx AND y<>by_), d1 AS MATERIALIZED (SELECT d.* FROM d JOIN w ON w.floor_id=d.floor_id AND w.x=d.x AND w.y=d.by_),
 bad AS (SELECT line_id FROM c JOIN w ON w.floor_id=c.floor_id AND w.x=c.x AND w.y=c.y UNION SELECT line_id FROM d1 JOIN w ON w.floor_id=d1.floor_id AND w.x=d1.bx AND w.y=d1.y)
 SELECT l.line_id, bad.line_id IS NULL AS clear FROM l LEFT JOIN bad ON bad.line_id=l.line_id""")(lambda t: ra.lines_clear(t.sql(LN), t("f_cells")))
SRC = "SELECT floor_id, x, y, row_number() OVER (PARTITION BY floor_id ORDER BY y, x) AS source_id FROM f_cells WHERE passable=1 AND x%12=5 AND y%12=7"
regions = lambda t: fp.multi_source_regions(t("f_cells"), t.sql(SRC))
GROWN = f"""src AS ({SRC}), free AS (SELECT floor_id, x, y FROM f_cells WHERE passable=1), dirs AS (SELECT * FROM (VALUES (1,0),(-1,0),(0,1),(0,-1)) v(i,j)),
 g(floor_id, x, y, source_id, steps, px, py) USING KEY (floor_id, x, y) AS (SELECT floor_id, x, y, source_id, 0, NULL::BIGINT, NULL::BIGINT FROM src
 UNION SELECT z.floor_id, nx, ny, m.s, st, m.px, m.py FROM (SELECT g.floor_id, g.x+i AS nx, g.y+j AS ny, min({{'s': g.source_id, 'py': g.y, 'px': g.x}}) AS m, min(g.steps)+1 AS st FROM g, dirs GROUP BY g.floor_id, g.x+i, g.y+j) z
  JOIN free f ON f.floor_id=z.floor_id AND f.x=nx AND f.y=ny LEFT JOIN recurring.g r ON r.floor_id=z.floor_id AND r.x=nx AND r.y=ny WHERE r.steps IS NULL)"""
query("gra12_multi_source_regions", f"WITH RECURSIVE {GROWN} SELECT floor_id, x, y, source_id, steps, px, py FROM g")(regions)
MEET = """mt AS (SELECT a.floor_id, least(a.source_id, b.source_id) AS a, greatest(a.source_id, b.source_id) AS b, min({'steps': a.steps+b.steps, 'ay': CASE WHEN a.source_id>b.source_id THEN b.y ELSE a.y END, 'ax': CASE WHEN a.source_id>b.source_id THEN b.x ELSE a.x END, 'by': CASE WHEN a.source_id>b.source_id THEN a.y ELSE b.y END, 'bx': CASE WHEN a.source_id>b.source_id THEN a.x ELSE b.x END}) AS m
 FROM g a JOIN g b ON a.floor_id=b.floor_id AND ((b.x=a.x+1 AND b.y=a.y) OR (b.x=a.x AND b.y=a.y+1)) WHERE a.source_id<>b.source_id GROUP BY 1, 2, 3)"""
bounds = lambda t, r: ra.region_boundary_edges(r, cells=t("f_cells"))
query("gra13_region_boundary_edges", f"WITH RECURSIVE {GROWN}, {MEET} SELECT floor_id, a, b, m.steps AS steps, round(m.steps/3.0,6) AS weight, m.ax AS ax, m.ay AS ay, m.bx AS bx, m.by AS by FROM mt")(lambda t: r6(bounds(t, regions(t)), "weight"))
TRACE = """tr AS (SELECT floor_id, a, b, 0 AS side, m.ax AS x, m.ay AS y, 0 AS k FROM mt UNION ALL SELECT floor_id, a, b, 1, m.bx, m.by, 0 FROM mt
 UNION ALL SELECT tr.floor_id, tr.a, tr.b, side, g.px, g.py, k+1 FROM tr JOIN g ON g.floor_id=tr.floor_id AND g.x=tr.x AND g.y=tr.y WHERE g.px IS NOT NULL)"""
query("gra14_trace_region_paths", f"WITH RECURSIVE {GROWN}, {MEET}, {TRACE} SELECT floor_id, a, b, string_agg(x::BIGINT::VARCHAR || ':' || y::BIGINT::VARCHAR, ',' ORDER BY side, CASE WHEN side=0 THEN -k ELSE k END) AS path FROM tr GROUP BY floor_id, a, b")(lambda t: trace(t))


def as_text(df, column="path"):
    return df.withColumn(column, F.array_join(F.transform(column, lambda p: F.concat_ws(":", p.x.cast("string"), p.y.cast("string"))), ","))


def trace(t):
    r = fp.cut(regions(t))
    return as_text(fp.trace_region_paths(r, bounds(t, r)).select("floor_id", "a", "b", "path"))


PAIR6 = "SELECT s_suppkey*10+k.k AS pair_id, s_suppkey AS floor_id, 1+(k.k*13+s_suppkey)%46 AS x0, 1+(k.k*7)%46 AS y0, 1+(k.k*29+20)%46 AS x1, 1+(k.k*31+s_suppkey+9)%46 AS y1 FROM supplier, range(10) AS k(k) WHERE s_suppkey%10=0"
FAR = "SELECT floor_id, x, y, passable, cast((x*7+y*3)%20 as double) AS dist FROM f_cells"
SNAP = "(SELECT pair_id, floor_id, c.y*1000+c.x AS spot FROM (SELECT pair_id, p.floor_id, c.x, c.y, row_number() OVER (PARTITION BY pair_id ORDER BY greatest(abs(c.x-p.x{i}),abs(c.y-p.y{i})), c.y, c.x) AS rn FROM ({p}) p JOIN f_cells c ON c.floor_id=p.floor_id AND c.passable=1) c WHERE rn=1)"
STEPS6 = f"""SELECT a.floor_id*1000000+a.y*1000+a.x AS a, b.floor_id*1000000+b.y*1000+b.x AS b, 1+8/(b.dist+1) AS w FROM ({FAR}) a JOIN ({FAR}) b ON a.floor_id=b.floor_id AND abs(a.x-b.x)+abs(a.y-b.y)=1 WHERE a.passable=1 AND b.passable=1"""
ENDS = lambda i: SNAP.format(i=i, p=PAIR6)
START6 = f"SELECT pair_id, floor_id*1000000+spot AS spot FROM {ENDS(0)} q"
query("gra6_grid_shortest_paths", f"WITH RECURSIVE {least_costs('d', START6, STEPS6)} SELECT q.pair_id, round(d.cost,6) AS cost FROM {ENDS(1)} q LEFT JOIN d ON d.pair_id=q.pair_id AND d.spot=q.floor_id*1000000+q.spot")(
    lambda t: r6(fp.grid_shortest_paths(t.sql(PAIR6), t.sql(FAR), weighted=True).select("pair_id", "cost"), "cost")
)


def cell_routes(t):
    """Walks between two cells, rides without waypoints, and walks on floors without a raster."""
    p = t.sql(PAIR6)
    point = lambda x, y: F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    walks = p.select(F.col("pair_id").alias("route_id"), F.lit(0).alias("part"), F.col("floor_id") + F.when(F.col("pair_id") % 7 == 0, 1).otherwise(0), F.array(point("x0", "y0"), point("x1", "y1")).alias("waypoints")).toDF("route_id", "part", "floor_id", "waypoints")
    rides = p.select("pair_id", F.lit(1), "floor_id", F.array().cast(fp.POINTS)).toDF("route_id", "part", "floor_id", "waypoints")
    return as_text(fp.route_cell_paths(walks.unionByName(rides), t.sql(FAR), simplify="halving"), "waypoints")


query("gra7_route_cell_paths")(cell_routes)
query("gra15_centre_paths")(
    lambda t: as_text(fp.centre_paths(fp.grid_shortest_paths(t.sql(PAIR6), t("f_cells")).filter("cost is not null").withColumnRenamed("pair_id", "path_id"), ra.distance_to_wall(t("f_cells")), 3)).select("path_id", "path")
)
NODE16 = "SELECT s_suppkey*100+k.k AS node_id, s_suppkey AS floor_id, 1+(k.k*11+s_suppkey)%46 AS x, 1+(k.k*17)%46 AS y FROM supplier, range(30) AS k(k) WHERE s_suppkey%10=0"
EDGE16 = f"SELECT node_id AS src, node_id+1 AS dst FROM ({NODE16}) n WHERE node_id%100<24 AND node_id%6<>5"
query("gra16_connect_isolated")(lambda t: fp.connect_isolated(t.sql(NODE16), t.sql(EDGE16), t("f_cells")).select("src", "dst", F.round("weight", 4).alias("weight")))
query("gra17_bridge_components")(lambda t: fp.bridge_components(t.sql(NODE16), t.sql(EDGE16), t("f_cells")).select("src", "dst", F.round("weight", 4).alias("weight")))


def building(t):
    """Edges of the building whose floors have detections and a raster; all its floors at once."""
    cells = t.sql("SELECT 'f' || cast(floor(floor_id/10) as varchar(9)) AS floor_id, x, y, passable FROM f_cells")
    floors = t.sql("SELECT DISTINCT floor_id, floor_num AS floor_no FROM f_detections").join(cells.select("floor_id").distinct(), "floor_id", "left_semi")
    seen = t("f_detections").join(floors.select("floor_id"), "floor_id", "left_semi")
    return fp.building_graph(cells, seen, floors, 48, 48, hull=5, margin=0)


query("gra23_building_graph_pipeline")(lambda t: building(t)["edges"].select("src", "dst", "inter_floor", F.round("weight", 4).alias("weight")))
query("gra18_exterior_cells")(lambda t: ra.exterior_cells(few(t).withColumn("passable", F.when((F.col("x") == 0) | (F.col("y") == 0), 1).otherwise(F.col("passable"))), 3, 1, 3, 1, 0.5))
#: The rooms again, with doors one cell wide that the sealing closes.
DOORS = "SELECT floor_id, x, y, CASE WHEN x=0 OR y=0 OR (x%8=0 AND y%8<>4) OR (y%8=0 AND x%8<>4) THEN 0 ELSE 1 END AS passable FROM f_cells"
query("gra19_corridor_network")(lambda t: ra.corridor_network(t.sql(DOORS), t.sql(NOD), 3))
query("gra20_corridor_skeleton")(lambda t: ra.corridor_skeleton(few(t), 0, 3, 4, 1.5, 3000))
query("gra21_skeleton_nodes")(lambda t: fp.hallway_nodes(ra.corridor_skeleton(few(t), 0, 3, 4, 1.5, 3000), t.sql("SELECT floor_id, x, y FROM f_cells WHERE x%15=4 AND y%15=4"), 6, 2.5))
PTH = "SELECT floor_id*100+y AS path_id, floor_id, x AS seq, x, y FROM f_cells WHERE passable=1"
query("gra8_greedy_visibility_simplify", f"SELECT path_id, seq FROM (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM ({PTH}) p WINDOW w AS (PARTITION BY path_id ORDER BY seq)) z WHERE px IS NULL OR nx IS NULL OR px<x-1 OR nx>x+1")(
    lambda t: fp.greedy_visibility_simplify(t.sql(PTH), t("f_cells")).select("path_id", "seq")
)
WAY = "SELECT route_id AS path_id, seq, x, y FROM f_waypoints"
SPAN = "round(abs((b.x-a.x)*(a.y-p.y)-(a.x-p.x)*(b.y-a.y))/nullif(sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)),0), 9)"
query("gra24_rdp_simplify", f"""WITH RECURSIVE p AS ({WAY}), r AS (SELECT path_id, min(seq) AS i, max(seq) AS j FROM p GROUP BY path_id UNION ALL SELECT path_id, CASE side WHEN 0 THEN i ELSE k END, CASE side WHEN 0 THEN k ELSE j END FROM (
  SELECT r.path_id, r.i, r.j, min({{'d': -{SPAN}, 's': p.seq}}).s AS k FROM r JOIN p a ON a.path_id=r.path_id AND a.seq=r.i JOIN p b ON b.path_id=r.path_id AND b.seq=r.j JOIN p ON p.path_id=r.path_id AND p.seq>r.i AND p.seq<r.j GROUP BY r.path_id, r.i, r.j HAVING max({SPAN}) > 0.1) z, (VALUES (0),(1)) v(side))
 SELECT DISTINCT path_id, seq FROM (SELECT path_id, i AS seq FROM r UNION ALL SELECT path_id, j FROM r) q""")(lambda t: ra.rdp_simplify(t.sql(WAY), 0.1).select("path_id", "seq"))
query("src2_decode_grid_cells", "SELECT floor_id::VARCHAR AS floor_id, x, y, passable FROM f_cells")(lambda t: io.decode_grid_cells(io.encode_grid_cells(t("f_cells"))).drop("dist"))
query("src3_write_grid_cells", """WITH s AS (SELECT floor_id, max(x)+1 AS width, max(y)+1 AS height FROM f_cells GROUP BY floor_id), b AS (SELECT c.floor_id, (y*width+x)//8 AS place, sum(passable*pow(2, 7-(y*width+x)%8))::INT AS v FROM f_cells c JOIN s ON s.floor_id=c.floor_id GROUP BY 1, 2)
 SELECT b.floor_id::VARCHAR AS "floorId", width, height, base64(unhex(string_agg(printf('%02x', v), '' ORDER BY place))) AS data FROM b JOIN s ON s.floor_id=b.floor_id GROUP BY b.floor_id, width, height""")(lambda t: io.encode_grid_cells(t("f_cells")).select("floorId", "width", "height", "data"))


def read_back(t):
    """Grids written as files, one folder per floor, read with the documents' schema and decoded."""
    from wayfarer.operators.iterate import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(t.spark)}/grids-{uuid.uuid4().hex}"
    io.write_grid_cells(t("f_cells"), folder)
    return io.decode_grid_cells(t.spark.read.schema(io.GRID_SCHEMA).json(folder)).drop("dist")


query("src3_written_grids_read_back", "SELECT floor_id::VARCHAR AS floor_id, x, y, passable FROM f_cells")(read_back)
DOC = lambda t: (
    t.sql("SELECT DISTINCT 'b' AS building_id, floor_id, floor_id AS name, floor_no FROM f_nodes"),
    t("f_nodes").withColumn("building_id", F.lit("b")),
    t("f_edges").withColumn("building_id", F.lit("b")),
)
query("src4_write_building_graph", """SELECT 'node' AS part, node_id AS a, NULL::BIGINT AS b, floor_id, round(x,5) AS x, round(y,5) AS y, label, type, NULL::DOUBLE AS weight, NULL::BOOLEAN AS inter_floor FROM f_nodes
 UNION ALL SELECT 'edge', src, dst, NULL, NULL, NULL, NULL, NULL, weight, inter_floor FROM f_edges UNION ALL SELECT 'floor', max(floor_no), NULL, floor_id, NULL, NULL, floor_id, NULL, NULL, NULL FROM f_nodes GROUP BY floor_id
 UNION ALL SELECT 'meta', (SELECT count(*) FROM f_nodes), (SELECT count(*) FROM f_edges), NULL, NULL, NULL, NULL, NULL, NULL, NULL""")(lambda t: document_parts(io.building_documents(*DOC(t))))


def document_parts(doc):
    """Every node, edge and floor of the nested documents, and their counts, as rows."""
    names = ["part", "a", "b", "floor_id", "x", "y", "label", "type", "weight", "inter_floor"]
    kinds = dict(zip(names, ["string", "long", "long", "string", "double", "double", "string", "string", "double", "boolean"]))
    row = lambda part, **c: [(F.lit(part) if n == "part" else c.get(n, F.lit(None))).cast(kinds[n]).alias(n) for n in names]
    n, e, f = F.col("n"), F.col("e"), F.col("f")
    nodes = doc.select(F.explode("nodes").alias("n")).select(*row("node", a=n.id, floor_id=n.floorId, x=n.x, y=n.y, label=n.label, type=n.type))
    edges = doc.select(F.explode("edges").alias("e")).select(*row("edge", a=e["from"], b=e.to, weight=e.weight, inter_floor=e.interFloor))
    floors = doc.select(F.explode("floors").alias("f")).select(*row("floor", a=f.pageIndex, floor_id=f.id, label=f["name"]))
    return nodes.union(edges).union(floors).union(doc.select(*row("meta", a=F.col("meta.nodes"), b=F.col("meta.edges"))))


def read_back(t):
    """Documents of buildings of 5,000 nodes, written as JSON and read again by the reader."""
    from wayfarer.operators.iterate import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(t.spark)}/building-{uuid.uuid4().hex}"
    of = lambda c: F.floor(F.col(c) / 5000).cast("string")  # a document is read whole by one task
    nodes = t("f_nodes").withColumn("building_id", of("node_id"))
    floors = nodes.select("building_id", "floor_id", F.col("floor_id").alias("name"), "floor_no").distinct()
    io.write_building_graph(floors, nodes, t("f_edges").withColumn("building_id", of("src")), path)
    found = io.read_building_graph(t.spark, f"{path}/*")
    nodes = found["nodes"].select(F.lit("node").alias("part"), F.col("node_id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "floor_id", F.round("x", 5).alias("value"))
    return nodes.union(found["edges"].select(F.lit("edge"), F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(None), "weight"))


query("src1_read_building_graph", "SELECT 'node' AS part, node_id AS a, NULL::BIGINT AS b, floor_id, round(x,5) AS value FROM f_nodes UNION ALL SELECT 'edge', src, dst, NULL, weight FROM f_edges")(read_back)

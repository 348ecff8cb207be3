"""Queries of stored tables, file lists and exports, with their SQL; they go with those of ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftlens.catalog import GUESS, LABEL_SQL, PIXEL, PIXELS_SQL, STATS_SQL, TOP, VOLUME, FILES, d, files, from_particles, masks, parts, query, rounded
from driftlens.operators import adaptive, background, classes, exports, filters, profiles, ranks
from driftlens.plans import pipeline
from driftlens.sources import adapters, frames, merges, rois, stores
from driftlens.streaming import runner

HALF = "2024-01-10 00:00:00"


def stats(spark, sf_dir):
    return rounded(profiles.image_stats(parts(spark, sf_dir), PIXEL, VOLUME), 5)


@query(STATS_SQL + " SELECT * FROM stats ORDER BY timestamp DESC LIMIT 1")
def image_stats_last(spark, sf_dir):
    return profiles.last_image(stats(spark, sf_dir))


@query(STATS_SQL + f" SELECT * EXCLUDE (junge), CASE WHEN timestamp < '{HALF}' THEN junge END AS junge FROM stats")
def image_stats_union(spark, sf_dir):
    """Image statistics stored in two tables, one without junge, and read as one."""
    rows, one, two = stats(spark, sf_dir), stores.scratch(spark, "stats"), stores.scratch(spark, "stats")
    early = F.col("timestamp") < F.lit(HALF).cast("timestamp_ntz")
    stores.append(rows.where(early), one)
    stores.append(rows.where(~early).drop("junge"), two)
    return stores.load(spark, one, two).drop("day")


@query(from_particles("SELECT event_id, timestamp, round(equivalent_diameter, 6) AS equivalent_diameter, CASE WHEN event_id >= 500 THEN round(solidity, 6) END AS solidity FROM particles"))
def stored_merge(spark, sf_dir):
    """Particles appended to three tables, one without solidity; two are merged, then all three, so that the second comes between."""
    rows = rounded(parts(spark, sf_dir).select("event_id", "timestamp", "equivalent_diameter", "solidity"))
    folder = stores.scratch(spark, "particles")
    pieces = [rows.where("event_id < 500").drop("solidity"), rows.where("event_id >= 500 AND event_id < 800"), rows.where("event_id >= 800")]
    for k, piece in enumerate(pieces):
        stores.append(piece, f"{folder}/{k}", about={"piece": k})
    for names in ((0, 2), (0, 1, 2)):
        merges.merge_in_parts(spark, [f"{folder}/{k}" for k in names], f"{folder}/all", 2)
    return merges.merged(spark, f"{folder}/all").drop("day")


@query(from_particles("SELECT filename AS path, row_number() OVER (ORDER BY filename) - 1 AS ord FROM (SELECT DISTINCT filename FROM particles)"))
def file_list(spark, sf_dir):
    """The names of the images written as a list, read back and put in order."""
    path = stores.scratch(spark, "files")
    stores.write_file_list(parts(spark, sf_dir).select(F.col("filename").alias("path")).distinct(), path)
    return ranks.numbered(stores.file_list(spark, path), "path")


@query(from_particles(FILES + ", c AS (SELECT timestamp, ord, floor(ord / ceil(n / 4.0))::bigint AS chunk FROM f) SELECT timestamp, ord, chunk, false AS is_background FROM c UNION ALL SELECT c.timestamp, c.ord, s.chunk, true FROM c CROSS JOIN (SELECT DISTINCT chunk FROM c WHERE chunk > 0) s WHERE c.ord < 5"))
def chunk_background_static(spark, sf_dir):
    f, n = files(spark, sf_dir)
    return exports.with_first_files(exports.chunked(f, 4, n), 5).select("timestamp", "ord", "chunk", "is_background")


@query(from_particles("SELECT event_id, CASE WHEN major_axis_length BETWEEN 10 AND 100 THEN round(major_axis_length, 6) END AS major_axis_length FROM particles"))
def range_null(spark, sf_dir):
    return rounded(filters.nulled_outside(parts(spark, sf_dir), "major_axis_length", 10, 100, ["major_axis_length"]).select("event_id", "major_axis_length"))


@query(from_particles("SELECT event_id, export_name, CASE WHEN event_id % 40 > 20 THEN maxr - minr END AS height, CASE WHEN event_id % 40 > 20 THEN maxc - minc END AS width FROM particles WHERE export_name <> 'not_exported'"))
def roi_join(spark, sf_dir):
    """Exported particles with the regions stored under the two halves of their name; small regions are not stored."""
    p = parts(spark, sf_dir)
    stored = p.where((F.col("export_name") != "not_exported") & (F.col("maxr") - F.col("minr") > 21))
    rois = stored.select(*exports.roi_place(F.col("export_name")), (F.col("maxr") - F.col("minr")).alias("height"), (F.col("maxc") - F.col("minc")).alias("width"))
    return exports.with_rois(p, rois).select("event_id", "export_name", "height", "width")


SPLIT = ", c AS (SELECT event_id, CASE WHEN solidity > 0.95::double THEN 'round' ELSE 'rough' END AS label FROM particles), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(event_id::varchar || '-7'), event_id) AS place, count(*) OVER (PARTITION BY label) AS size FROM c)"


@query(from_particles(SPLIT + " SELECT event_id, label, CASE WHEN place <= least(300, size - 1) THEN 'validation' ELSE 'training' END AS part FROM o"))
def class_split(spark, sf_dir):
    rows = parts(spark, sf_dir).select("event_id", F.when(F.col("solidity") > 0.95, "round").otherwise("rough").alias("label"))
    return classes.split_per_class(rows, "label", "event_id", 300, 7)


@query(PIXELS_SQL + ", b AS (SELECT a.frame, a.pos, avg(b.px) AS bg FROM pixels a JOIN pixels b ON a.pos = b.pos AND b.frame < a.frame AND b.frame >= a.frame - 300 WHERE a.frame >= 300 GROUP BY a.frame, a.pos) SELECT frame, pos::int AS pos, round(bg, 6) AS bg FROM b")
def bg_moving_wide(spark, sf_dir):
    """A window wider than a block of frames."""
    return rounded(background.moving_background(adapters.pixels(spark, sf_dir), 300).select("frame", "pos", "bg"))


ATTRIBUTES = {"project_name": "p", "station": "s", "latitude": 62.3, "longitude": 10.5, "depth": 4.0, "modified": "2024-02-03 04:05:06", "software_version": "driftlens 1"}
_UM = f"* {d(PIXEL)}"
ECOTAXA_SQL = f"""SELECT export_name || '.png' AS img_file_name, 0::double AS img_rank, export_name AS object_id, 62.3::double AS object_lat, 10.5::double AS object_lon,
strftime(timestamp, '%Y%m%d') AS object_date, strftime(timestamp, '%H%M%S') AS object_time, 4::double AS object_depth_min, 4::double AS object_depth_max,
round(major_axis_length {_UM}, 6) AS object_major, round(minor_axis_length {_UM}, 6) AS object_minor, round(equivalent_diameter {_UM}, 6) AS object_circ,
NULL::double AS process_id, 'driftlens 1' AS process_img_software_version, NULL::double AS process_img_resolution, {d(PIXEL)} AS process_particle_pixel_size_um,
'20240203' AS process_date, '040506' AS process_time, NULL::double AS acq_id, NULL::double AS sample_id, 'p-s' AS sample_stationid
FROM particles WHERE export_name <> 'not_exported'"""


def plain(table):
    """Column names without the marks that SQL needs quotes for."""
    return table.toDF(*[c.rstrip(".").replace("?m", "um") for c in table.columns])


@query(from_particles(ECOTAXA_SQL))
def ecotaxa_rows(spark, sf_dir):
    return rounded(plain(exports.interchange(parts(spark, sf_dir), PIXEL, ATTRIBUTES)))


@query("SELECT " + ", ".join(f"'{kind}' AS {name.rstrip('.').replace('?m', 'um')}" for name, (_, kind) in exports.INTERCHANGE.items()))
def ecotaxa_header(spark, sf_dir):
    return plain(exports.type_header(spark))


@query(from_particles("SELECT event_id, timestamp, export_name FROM particles WHERE export_name <> 'not_exported'"))
def stream_plan(spark, sf_dir):
    """A configured plan on the particles as a stream, read back from its target."""
    folder = stores.scratch(spark, "stream")
    settings = {"steps": {"exported": {"step": "driftlens.operators.filters.exported"}}}
    runner.run(adapters.event_stream(spark, sf_dir), settings, f"{folder}/rows", f"{folder}/log", available_now=True).awaitTermination()
    return runner.stored(spark, f"{folder}/rows").select("event_id", "timestamp", "export_name")


@query(from_particles("SELECT event_id FROM particles WHERE major_axis_length BETWEEN 10 AND 200 AND export_name <> 'not_exported'"))
def plan_again(spark, sf_dir):
    """A table stored with the settings that made it; its plan is built again with another upper limit."""
    path = stores.scratch(spark, "again")
    steps = {"range": {"step": "driftlens.operators.filters.in_range", "name": "major_axis_length", "low": 10, "high": 100}, "exported": {"step": "driftlens.operators.filters.exported"}}
    settings = {"general": {"pixel_size": PIXEL}, "steps": steps}
    pipeline.stored_with(pipeline.build(parts(spark, sf_dir), settings), settings, pipeline.Project(title="again"), path)
    return pipeline.again(spark, path, parts(spark, sf_dir), range__high=200)[0].select("event_id")


CLASSES = ("oil", "bubble", "oily_gas", "unclassified")


@query(from_particles(FILES + f""", c AS (SELECT timestamp, CASE WHEN {TOP} >= 0.5::double THEN replace({GUESS}, 'probability_', '') ELSE 'unclassified' END AS class FROM particles)
SELECT f.timestamp, floor(ord / ceil(n / 4.0))::bigint AS chunk, """ + ", ".join(f"round(count(*) FILTER (class = '{c}') / {d(VOLUME)}, 6) AS {c}" for c in CLASSES) + f", round(count(class) / {d(VOLUME)}, 6) AS total FROM f LEFT JOIN c USING (timestamp) GROUP BY ALL"))
def class_sink(spark, sf_dir):
    """Concentrations by class, written chunk by chunk; one chunk is written twice."""
    path, (f, n) = stores.scratch(spark, "classes"), files(spark, sf_dir)
    chunks = exports.chunked(f, 4, n).select("timestamp", "chunk")
    rows = rounded(classes.per_class(parts(spark, sf_dir), chunks.select("timestamp"), 0.5, VOLUME)).join(chunks, "timestamp")
    for of in ((0, 1), (1,), (2, 3)):
        stores.put(rows.where(F.col("chunk").isin(*of)), path, "chunk")
    return spark.read.parquet(path).withColumn("chunk", F.col("chunk").cast("long"))


COVERED, MOST = 60, 3


def plan_rows(spark, sf_dir):
    """Statistics of the frames of 8 x 8 pixels, with pixels of the larger particles; every 17th frame is broken."""
    px = adapters.pixels(spark, sf_dir).groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "px"))), lambda x: x["px"]).alias("px"))  # 64
    broken = F.col("frame") % 17 == 0
    time = F.timestamp_seconds(F.col("frame")).cast("timestamp_ntz")
    rows = masks(spark, sf_dir).join(px, "frame").select("frame", time.alias("timestamp"), F.lit(8).alias("rows"), "cols", F.lit(1).alias("channels"), "px",
                                                        F.when(~broken, F.col("dark")).alias("dark"), F.when(broken, F.lit("broken")).alias("error"))
    return pipeline.outputs(pipeline.statistics(rows, COVERED, MOST, "frame", export=True, min_length=3.0), PIXEL, VOLUME, "frame")


@query(LABEL_SQL + f""", n AS (SELECT frame, count(*) AS k FROM ms GROUP BY frame), c AS (SELECT frame, avg(dark::int) * 100 / {d(float(COVERED))} * 100 AS s FROM mask GROUP BY frame)
SELECT frame, CASE WHEN frame % 17 = 0 OR s >= 100 OR k > {MOST} THEN 0 ELSE coalesce(k, 0) END AS particle_count, CASE WHEN frame % 17 <> 0 THEN round(s, 6) END AS saturation,
       CASE WHEN frame % 17 = 0 THEN 'broken' WHEN s >= 100 THEN 'covered' WHEN k > {MOST} THEN k || ' particles' END AS reason FROM c LEFT JOIN n USING (frame)""")
def plan_frames(spark, sf_dir):
    """Every frame of a configured plan, with the reason of those that have no particles."""
    return rounded(plan_rows(spark, sf_dir).frames.select("frame", "particle_count", "saturation", "reason"))


@query(LABEL_SQL + f""", n AS (SELECT frame, count(*) AS k FROM ms GROUP BY frame), c AS (SELECT frame, avg(dark::int) * 100 / {d(float(COVERED))} * 100 AS s FROM mask GROUP BY frame),
x AS (SELECT ms.*, 4 * sqrt(greatest(round((vr + vc) / 2 + sqrt(((vr - vc) / 2) ** 2 + vrc ** 2), 9), 0)) AS major, 4 * sqrt(greatest(round((vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + vrc ** 2), 9), 0)) AS minor
  FROM ms JOIN n USING (frame) JOIN c USING (frame) WHERE frame % 17 <> 0 AND s < 100 AND k <= {MOST})
SELECT strftime(make_timestamp(x.frame * 1000000), 'D%Y%m%dT%H%M%S.%f') || '-PN' || (label - 1) AS export_name, (maxr - minr)::int AS rows, (maxc - minc)::int AS cols, round(sum(px), 6) AS total
FROM x JOIN pixels p ON p.frame = x.frame AND p.pos // 8 >= minr AND p.pos // 8 < maxr AND p.pos % 8 >= minc AND p.pos % 8 < maxc WHERE major > 3 AND minor > 2 GROUP BY ALL""")
def roi_store(spark, sf_dir):
    """Exported particles with their pixels from the bucketed table that the plan's rows were written to."""
    out, name = plan_rows(spark, sf_dir), f"rois_{uuid.uuid4().hex}"
    rois.write(out.rois, name, stores.scratch(spark, "rois"), 8)
    found = rois.with_pixels(spark, out.particles, name)
    return rounded(found.select("export_name", "rows", "cols", F.aggregate("px", F.lit(0.0), lambda a, x: a + x).alias("total")))


BINS, TILE = 16, 4


@query(PIXELS_SQL + f""", q AS (SELECT *, pos // 8 AS r, pos % 8 AS c, greatest(least(floor(px * {BINS}), {BINS - 1}), 0)::int AS b FROM pixels),
h AS (SELECT frame, r // {TILE} AS ti, c // {TILE} AS tj, b, count(*) AS n FROM q GROUP BY ALL), z AS (SELECT frame, ti, tj, sum(n) AS size, greatest(floor(0.9::double * sum(n)), 1) AS most FROM h GROUP BY ALL),
o AS (SELECT z.*, (SELECT sum(greatest(n - most, 0)) FROM h WHERE h.frame = z.frame AND h.ti = z.ti AND h.tj = z.tj) / {BINS}::double AS over FROM z),
s AS (SELECT o.*, g.b, (sum(least(coalesce(n, 0), most)) OVER (PARTITION BY o.frame, o.ti, o.tj ORDER BY g.b) + (g.b + 1) * over) / size AS share
      FROM o CROSS JOIN (SELECT unnest(range({BINS})) AS b) g LEFT JOIN h ON h.frame = o.frame AND h.ti = o.ti AND h.tj = o.tj AND h.b = g.b),
y AS (SELECT *, (r + 0.5::double) / {TILE} - 0.5 AS y, (c + 0.5::double) / {TILE} - 0.5 AS x FROM q),
w AS (SELECT frame, pos, px, b, greatest(least(floor(y) + i, 1), 0) AS ti, greatest(least(floor(x) + j, 1), 0) AS tj, abs(1 - i - (y - floor(y))) * abs(1 - j - (x - floor(x))) AS w FROM y, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
e AS (SELECT w.frame, w.pos, px, round(sum(w * share), 9) AS eq FROM w JOIN s ON s.frame = w.frame AND s.ti = w.ti AND s.tj = w.tj AND s.b = w.b GROUP BY ALL),
t AS (SELECT frame, quantile_cont(px, 0.5) AS med, quantile_cont(eq, 0.0075) AS low FROM e GROUP BY frame)
SELECT frame, pos::int AS pos, round(eq, 6) AS eq, px < 0.9::double * med AND eq < round(0.9::double * low, 9) AS dark FROM e JOIN t USING (frame)""")
def threshold_adaptive(spark, sf_dir):
    return rounded(adaptive.threshold_accurate(adapters.pixels(spark, sf_dir), 8, 8, 0.9, BINS, tile_rows=TILE, tile_cols=TILE))


@query(PIXELS_SQL + ", t AS (SELECT frame, min(px) AS low, quantile_cont(px, 0.8) AS high FROM pixels GROUP BY frame) SELECT frame, pos::int AS pos, round(coalesce((least(px, high) - low) / nullif(high - low, 0), 0), 6) AS im FROM pixels JOIN t USING (frame)")
def stretch(spark, sf_dir):
    return rounded(adaptive.stretched(adapters.pixels(spark, sf_dir)))


@query(PIXELS_SQL + ", t AS (SELECT frame, quantile_cont(px, 0.5) AS med FROM pixels GROUP BY frame) SELECT frame, pos::int AS pos, round(least(px + 0.8::double - med, 1), 6) AS im FROM pixels JOIN t USING (frame)")
def brighten(spark, sf_dir):
    return rounded(adaptive.brightened(adapters.pixels(spark, sf_dir), 0.8))


@query(from_particles(f", e AS (SELECT event_id, row_number() OVER (ORDER BY major_axis_length DESC, event_id) - 1 AS place FROM particles WHERE major_axis_length * {d(PIXEL)} < 8000 AND export_name <> 'not_exported') SELECT * FROM e"))
def montage_order(spark, sf_dir):
    """Exported particles up to a length, numbered from the longest."""
    rows = filters.exported(filters.shorter_than(parts(spark, sf_dir), PIXEL, 8000))
    return ranks.numbered(rows.select("event_id", "major_axis_length"), F.col("major_axis_length").desc(), "event_id", name="place").select("event_id", "place")


@query(PIXELS_SQL + " SELECT frame, pos::int AS pos, round(CASE WHEN pos // 8 >= 2 AND pos // 8 < 7 AND pos % 8 >= 1 AND pos % 8 < 6 THEN px ELSE 1 END, 6) AS im FROM pixels")
def mask_box(spark, sf_dir):
    return rounded(background.inside_box(adapters.pixels(spark, sf_dir), 8, 2, 7, 1, 6))


@query(PIXELS_SQL + " SELECT frame, pos::int AS pos, round(CASE WHEN (pos // 8 - 4) ** 2 + (pos % 8 - 4) ** 2 < 9 THEN px ELSE 0 END, 6) AS im FROM pixels")
def mask_circle(spark, sf_dir):
    return rounded(background.inside_circle(adapters.pixels(spark, sf_dir), 8, 8, 3.0))


@query(PIXELS_SQL + """, h AS (SELECT frame, pos, unnest([0, 1, 2]) AS channel, unnest([px, 1 - px, px * px]) AS px FROM pixels), t AS (SELECT frame, min(px) AS low, max(px) AS high FROM h GROUP BY frame)
SELECT frame, pos::int AS pos, round(min(px), 6) AS least, round(max((px - low) / (high - low)) FILTER (channel = 0), 6) AS r0, round(max((px - low) / (high - low)) FILTER (channel = 1), 6) AS r1, round(max((px - low) / (high - low)) FILTER (channel = 2), 6) AS r2
FROM h JOIN t USING (frame) GROUP BY frame, pos""")
def image_prep(spark, sf_dir):
    px = F.col("px")
    channels = adapters.pixels(spark, sf_dir).select("frame", "pos", F.posexplode(F.array(px, 1 - px, px * px)).alias("channel", "px"))
    out = background.prepared(channels)
    return rounded(out.select("frame", "pos", "least", *[F.get("ref", F.lit(k)).alias(f"r{k}") for k in range(3)]))


BYTES_SQL = "WITH px AS (SELECT vec_id AS frame, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), b AS (SELECT frame, pos, greatest(least(floor((e + 4) / 8 * 256), 255), 0)::bigint AS v, pos // 8 AS r, pos % 8 AS c FROM px)"


@query(BYTES_SQL + """, k AS (SELECT *, CASE WHEN (r + c) % 2 = 1 THEN 1 WHEN r % 2 = 0 THEN 0 ELSE 2 END AS colour FROM b), m AS (SELECT unnest([0, 1, 2]) AS want),
d AS (SELECT k.frame, k.pos, want, CASE WHEN k.colour = want THEN k.v ELSE (sum(n.v) + count(n.v) // 2) // count(n.v) END AS v
  FROM k CROSS JOIN m LEFT JOIN k n ON n.frame = k.frame AND n.colour = want AND abs(n.r - k.r) <= 1 AND abs(n.c - k.c) <= 1 AND n.pos <> k.pos AND (want <> 1 OR n.r = k.r OR n.c = k.c)
  WHERE k.frame % 4 = 3 GROUP BY k.frame, k.pos, want, k.colour, k.v)
SELECT frame, i::int AS i, round(v / 255.0::double, 6) AS px, CASE frame % 4 WHEN 0 THEN make_timestamp((1700000000 + frame) * 1000000 + frame) ELSE make_timestamp(frame * 1000000) END AS timestamp FROM (
  SELECT frame, pos AS i, v FROM b WHERE frame % 4 IN (0, 2) UNION ALL SELECT frame, pos * 3 + want, v FROM b CROSS JOIN m WHERE frame % 4 = 1 UNION ALL SELECT frame, pos * 3 + want, v FROM d)""")
def frame_formats(spark, sf_dir):
    """Frames as files of four formats, decoded; values by place in the decoded frame."""
    files = adapters.frame_files(spark, sf_dir)
    out = frames.frames(files.select("path", "content")).join(files.select("frame", "path"), "path")
    return rounded(out.select("frame", "timestamp", F.posexplode("px").alias("i", "px")))


@query(from_particles("SELECT event_id, round(major_axis_length, 6) AS major_axis_length, export_name FROM particles"))
def csv_table(spark, sf_dir):
    """Particles as separated values, stored as a table and read back."""
    folder = stores.scratch(spark, "values")
    rounded(parts(spark, sf_dir).select("event_id", "major_axis_length", "export_name")).write.csv(f"{folder}/csv", header=True)
    stores.from_csv(spark, f"{folder}/csv", f"{folder}/table")
    return rounded(spark.read.parquet(f"{folder}/table").withColumn("event_id", F.col("event_id").cast("long")))

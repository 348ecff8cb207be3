"""All queries of the library itself, with their SQL. Both read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import sizes
from driftlens.operators import background, classes, distributions, exports, filters, particles, profiles, series
from driftlens.sources import adapters

PIXEL, PATH = 28.0, 40.0
VOLUME = sizes.sample_volume(PIXEL, PATH)
KEY = ["timestamp"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show, and without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def d(x: float) -> str:
    return f"{x!r}::double"


PARTICLES_SQL = """particles AS (
  SELECT event_id, date_trunc('hour', ts) AS timestamp, value AS equivalent_diameter, value * 1.5::double AS major_axis_length,
    value * (0.2::double + 0.1::double * (event_id % 8)) AS minor_axis_length, 0.9::double + 0.01::double * (event_id % 10) AS solidity,
    ((user_id * 13) % 2048)::double AS minr, ((event_id * 7) % 2448)::double AS minc,
    ((user_id * 13) % 2048 + 1 + event_id % 40)::double AS maxr, ((event_id * 7) % 2448 + 1 + event_id % 30)::double AS maxc,
    (hour(ts) * 4)::double AS saturation, strftime(date_trunc('hour', ts), 'D%Y%m%dT%H%M%S.%f') || '.silc' AS filename,
    ((event_id * 7) % 100) / 100.0::double AS probability_oil, (1 - ((event_id * 7) % 100) / 100.0::double) * 0.6::double AS probability_bubble,
    (1 - ((event_id * 7) % 100) / 100.0::double) * 0.4::double AS probability_oily_gas,
    CASE WHEN event_type = 'error' THEN 'not_exported' ELSE strftime(date_trunc('hour', ts), 'D%Y%m%dT%H%M%S.%f') || '-PN' || event_id END AS export_name
  FROM events)"""
BINS_SQL = "bins(bin, dia, lo, hi, dd) AS (VALUES " + ", ".join(f"({k}, {d(a)}, {d(b)}, {d(c)}, {d(g)})" for k, (a, b, c, g) in enumerate(zip(sizes.mid_points(), sizes.limits(), sizes.limits()[1:], sizes.gradient(sizes.mid_points())))) + ")"
VOL_SQL = "(4.0::double / 3.0 * pi() * pow(dia / 2 * 1e-6, 3.0) * n * 1e9)"


def nd_sql(key: str, groups: str) -> str:
    """CTEs up to nd(key, bin, dia, dd, n)."""
    on = f"g.{key} = c.{key}" if key else "true"
    k, gk = (f"{key}, ", f"g.{key}, ") if key else ("", "")
    return f"""WITH {PARTICLES_SQL}, {BINS_SQL}, g AS ({groups}),
c AS (SELECT {k}bin, count(*)::double AS n FROM particles JOIN bins ON equivalent_diameter * {d(PIXEL)} >= lo AND (equivalent_diameter * {d(PIXEL)} < hi OR (bin = 51 AND equivalent_diameter * {d(PIXEL)} <= hi)) GROUP BY {k}bin),
nd AS (SELECT {gk}b.bin, b.dia, b.dd, coalesce(c.n, 0) AS n FROM g CROSS JOIN bins b LEFT JOIN c ON {on} AND b.bin = c.bin)"""


IMAGES = "SELECT DISTINCT timestamp FROM particles"
ND_IMAGE, ND_ALL = nd_sql("timestamp", IMAGES), nd_sql("", "SELECT 1 AS one")


def d50_cte(part: str) -> str:
    by = f"PARTITION BY {part} " if part else ""
    g = f"{part}, " if part else ""
    group = f"GROUP BY {part}" if part else ""
    return f"""v AS (SELECT *, {VOL_SQL} AS v FROM nd),
s AS (SELECT *, sum(v) OVER ({by}ORDER BY bin ROWS UNBOUNDED PRECEDING) / nullif(sum(v) OVER ({by.strip()}), 0) AS cs FROM v),
s2 AS (SELECT *, lead(cs) OVER ({by}ORDER BY bin) AS cs2, lead(dia) OVER ({by}ORDER BY bin) AS dia2 FROM s),
x AS (SELECT {g}max(bin) FILTER (cs <= 0.5) AS b, min(dia) AS first_dia, max(cs) AS top, arg_max(dia, bin) FILTER (cs <= 0.5) AS xd, arg_max(cs, bin) FILTER (cs <= 0.5) AS xc, arg_max(dia2, bin) FILTER (cs <= 0.5) AS xd2, arg_max(cs2, bin) FILTER (cs <= 0.5) AS xc2 FROM s2 {group}),
d50 AS (SELECT {g}CASE WHEN top IS NULL THEN NULL WHEN b IS NULL THEN first_dia ELSE coalesce(xd + (0.5 - xc) * (xd2 - xd) / nullif(xc2 - xc, 0), xd) END AS d50 FROM x)"""


def junge_cte(part: str, n: str) -> str:
    g, group = (f"{part}, ", f"GROUP BY {part}") if part else ("", "")
    use = f"{n} > 0 AND dia > 150 AND dia < 300"
    return f"SELECT {g}CASE WHEN count(*) FILTER ({use}) >= 2 THEN regr_slope(CASE WHEN {use} THEN ln({n}) END, CASE WHEN {use} THEN ln(dia) END) END AS junge"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.particles(spark, sf_dir)


def image_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.distribution(parts(spark, sf_dir), PIXEL, KEY)


@query(f"WITH {BINS_SQL} SELECT bin, round(dia, 6) AS dia, round(lo, 6) AS lo, round(hi, 6) AS hi, round(dd, 6) AS dd FROM bins")
def size_bins(spark, sf_dir):
    return rounded(sizes.size_bins(spark))


@query(ND_IMAGE + " SELECT timestamp, bin, n FROM nd")
def nd(spark, sf_dir):
    return image_nd(spark, sf_dir).select("timestamp", "bin", "n")


@query(ND_IMAGE + f" SELECT timestamp, bin, round({VOL_SQL} / {d(VOLUME)}, 6) AS vd FROM nd")
def vd(spark, sf_dir):
    return rounded(image_nd(spark, sf_dir).select("timestamp", "bin", sizes.volume(F.col("n"), F.col("dia"), VOLUME).alias("vd")))


@query(ND_ALL + f", i AS (SELECT count(DISTINCT timestamp) AS images FROM particles), f AS (SELECT min(bin) FILTER (n > 0) AS first FROM nd) SELECT bin, round(CASE WHEN bin = first THEN NULL ELSE n / ({d(VOLUME)} * images) / dd END, 6) AS nd FROM nd, i, f")
def nd_scaled(spark, sf_dir):
    p = parts(spark, sf_dir)
    images = F.broadcast(p.agg(F.countDistinct("timestamp").alias("images")))  # one row
    every = distributions.distribution(p, PIXEL, [])
    first = F.broadcast(every.where("n > 0").agg(F.min("bin").alias("first")))  # one row
    out = distributions.rescaled(every.crossJoin(images), F.lit(VOLUME) * F.col("images")).crossJoin(first)
    return rounded(out.select("bin", F.when(F.col("bin") != F.col("first"), F.col("nd")).alias("nd")))


@query(ND_IMAGE + f" SELECT timestamp, round(sum(n) / {d(VOLUME)}, 6) AS nc FROM nd GROUP BY timestamp")
def nc(spark, sf_dir):
    return rounded(image_nd(spark, sf_dir).groupBy("timestamp").agg((F.sum("n") / VOLUME).alias("nc")))


@query(ND_IMAGE + f" SELECT timestamp, round(sum({VOL_SQL} / {d(VOLUME)}), 6) AS vc FROM nd GROUP BY timestamp")
def vc(spark, sf_dir):
    return rounded(image_nd(spark, sf_dir).groupBy("timestamp").agg(F.sum(sizes.volume(F.col("n"), F.col("dia"), VOLUME)).alias("vc")))


NC_VC_SQL = f""", f AS (SELECT *, n / {d(VOLUME)} / dd AS sc, min(CASE WHEN n > 0 THEN bin END) OVER (PARTITION BY timestamp) AS first FROM nd),
t AS (SELECT timestamp, sum(n) / {d(VOLUME)} AS nc, sum({VOL_SQL} / {d(VOLUME)}) AS vc FROM nd GROUP BY timestamp),
j AS ({junge_cte('timestamp', 'sc')} FROM (SELECT timestamp, dia, CASE WHEN bin = first THEN NULL ELSE sc END AS sc FROM f) GROUP BY timestamp)"""


@query(ND_IMAGE + NC_VC_SQL + " SELECT timestamp, round(nc, 6) AS nc, round(vc, 6) AS vc, round(junge, 6) AS junge FROM t JOIN j USING (timestamp)")
def nc_vc(spark, sf_dir):
    return rounded(distributions.concentrations(image_nd(spark, sf_dir), KEY, VOLUME))


@query(ND_IMAGE + ", " + d50_cte("timestamp") + " SELECT timestamp, round(d50, 5) AS d50 FROM d50")
def d50_image(spark, sf_dir):
    return rounded(distributions.d50(image_nd(spark, sf_dir), KEY), 5)


@query(ND_ALL + ", " + d50_cte("") + " SELECT round(d50, 5) AS d50 FROM d50")
def d50_total(spark, sf_dir):
    one = distributions.distribution(parts(spark, sf_dir).withColumn("all", F.lit(1)), PIXEL, ["all"])
    return rounded(distributions.d50(one, ["all"]).select("d50"), 5)


@query(f"SELECT round({d(VOLUME)}, 9) AS sample_volume")
def sample_volume(spark, sf_dir):
    return spark.range(1).select(F.round(F.lit(VOLUME), 9).alias("sample_volume"))


@query(f"WITH {PARTICLES_SQL} SELECT count(DISTINCT timestamp) AS images FROM particles")
def count_images(spark, sf_dir):
    return parts(spark, sf_dir).agg(F.countDistinct("timestamp").alias("images"))


@query(ND_IMAGE + " SELECT timestamp, bin, round(n, 6) AS n FROM nd")
def vd_to_nd(spark, sf_dir):
    v = image_nd(spark, sf_dir).withColumn("v", sizes.volume(F.col("n"), F.col("dia")))
    return rounded(v.select("timestamp", "bin", sizes.number(F.col("v"), F.col("dia")).alias("n")))


@query(ND_IMAGE + " SELECT timestamp, round(sum(n), 6) AS nc FROM nd GROUP BY timestamp")
def vd_to_nc(spark, sf_dir):
    v = image_nd(spark, sf_dir).withColumn("v", sizes.volume(F.col("n"), F.col("dia")))
    return rounded(v.groupBy("timestamp").agg(F.sum(sizes.number(F.col("v"), F.col("dia"))).alias("nc")))


@query(ND_IMAGE + f", j AS ({junge_cte('timestamp', 'n')} FROM nd GROUP BY timestamp) SELECT timestamp, round(junge, 6) + 0.0::double AS junge FROM j")
def junge_slope(spark, sf_dir):
    return rounded(distributions.junge(image_nd(spark, sf_dir), KEY))


STATS_SQL = ND_IMAGE + NC_VC_SQL + ", " + d50_cte("timestamp") + f""", p AS (
  SELECT timestamp, min(filename) AS filename, max(saturation) AS saturation, count(*) AS particle_count FROM particles GROUP BY timestamp),
stats AS (
  SELECT timestamp, filename, particle_count, saturation, round(d50, 5) AS d50, round(nc, 5) AS nc, round(vc, 5) AS vc,
         round({d(VOLUME)}, 5) AS sample_volume, round(junge, 5) AS junge
  FROM p JOIN t USING (timestamp) JOIN j USING (timestamp) JOIN d50 USING (timestamp))"""


@query(STATS_SQL + " SELECT * FROM stats")
def image_stats(spark, sf_dir):
    return rounded(profiles.image_stats(parts(spark, sf_dir), PIXEL, VOLUME), 5)


SERIES_SQL = nd_sql("timestamp", "SELECT unnest(generate_series((SELECT min(timestamp) FROM particles), (SELECT max(timestamp) FROM particles), INTERVAL 1 HOUR)) AS timestamp")


@query(SERIES_SQL + ", " + d50_cte("timestamp") + ", w AS (SELECT timestamp, " + ", ".join(f"round(sum(CASE WHEN bin = {k} THEN {VOL_SQL} / {d(VOLUME)} END), 6) AS vd_{k}" for k in range(sizes.COUNT)) + " FROM nd GROUP BY timestamp) SELECT w.*, round(d50, 6) AS d50 FROM w LEFT JOIN d50 USING (timestamp)")
def timeseries_vd(spark, sf_dir):
    return rounded(series.volume_series(parts(spark, sf_dir), adapters.image_reference(spark, sf_dir), PIXEL, VOLUME))


def from_particles(sql: str) -> str:
    return f"WITH {PARTICLES_SQL} {sql}"


@query(from_particles("SELECT event_id FROM particles WHERE (minr + maxr) / 2 BETWEEN 400 AND 1400 AND (minc + maxc) / 2 BETWEEN 500 AND 2000"))
def crop(spark, sf_dir):
    return filters.crop(parts(spark, sf_dir), (400, 500), (1400, 2000)).select("event_id")


@query(from_particles("SELECT event_id FROM particles WHERE minor_axis_length / major_axis_length > 0.3 AND solidity > 0.95::double AND probability_oil > 0.85::double"))
def extract_oil_high(spark, sf_dir):
    return filters.extract_oil(parts(spark, sf_dir)).select("event_id")


@query(from_particles("SELECT event_id FROM particles WHERE minor_axis_length / major_axis_length > 0.3 AND solidity > 0.95::double AND probability_oil > 0.4::double AND probability_oil > probability_bubble AND probability_oil > probability_oily_gas"))
def extract_oil_low(spark, sf_dir):
    return filters.extract_oil(parts(spark, sf_dir), 0.4).select("event_id")


TRIM = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")


@query(from_particles(f"SELECT event_id, timestamp FROM particles WHERE timestamp > '{TRIM[0]}' AND timestamp < '{TRIM[1]}'"))
def trim(spark, sf_dir):
    return filters.trim(parts(spark, sf_dir), *TRIM).select("event_id", "timestamp")


@query(from_particles(f"SELECT CASE WHEN count(equivalent_diameter) > 0 THEN 'stats-' || strftime(min(timestamp), '%Y%m%dT%H%M%S') || '-' || strftime(max(timestamp), '%Y%m%dT%H%M%S') ELSE '' END AS outname FROM particles WHERE timestamp > '{TRIM[0]}' AND timestamp < '{TRIM[1]}'"))
def trim_name(spark, sf_dir):
    return filters.trim_name(filters.trim(parts(spark, sf_dir), *TRIM))


@query(from_particles("SELECT event_id FROM particles WHERE timestamp > (SELECT max(timestamp) FROM particles) - INTERVAL 86400 SECOND"))
def latest(spark, sf_dir):
    return filters.latest(parts(spark, sf_dir), 86400.0).select("event_id")


@query(from_particles("SELECT event_id FROM particles WHERE major_axis_length BETWEEN 10 AND 100"))
def range_filter(spark, sf_dir):
    return filters.in_range(parts(spark, sf_dir), "major_axis_length", 10, 100, complete=True).select("event_id")


@query(from_particles(f"SELECT event_id FROM particles WHERE major_axis_length * {d(PIXEL)} < 2000"))
def length_filter(spark, sf_dir):
    return filters.shorter_than(parts(spark, sf_dir), PIXEL, 2000).select("event_id")


@query(from_particles("SELECT event_id, export_name FROM particles WHERE export_name <> 'not_exported'"))
def exported(spark, sf_dir):
    return filters.exported(parts(spark, sf_dir)).select("event_id", "export_name")


@query(from_particles("SELECT event_id FROM particles WHERE major_axis_length > 20 AND minor_axis_length > 2"))
def exportable(spark, sf_dir):
    return filters.exportable(parts(spark, sf_dir), 20).select("event_id")


@query(from_particles(", e AS (SELECT event_id, row_number() OVER (ORDER BY timestamp, event_id) - 1 AS rn, count(*) OVER () AS n FROM particles WHERE export_name <> 'not_exported') SELECT event_id FROM e WHERE rn % greatest(round_even(n / 500.0, 0), 1)::bigint = 0"))
def stride_sample(spark, sf_dir):
    return filters.stride_sample(parts(spark, sf_dir), ["timestamp", "event_id"], 500).select("event_id")


@query(from_particles("SELECT event_id, equivalent_diameter FROM particles ORDER BY equivalent_diameter DESC NULLS LAST, event_id LIMIT 1 OFFSET 3"))
def nth_largest(spark, sf_dir):
    return filters.nth_by(parts(spark, sf_dir), "equivalent_diameter", 3).select("event_id", "equivalent_diameter")


@query(from_particles("SELECT event_id, major_axis_length FROM particles ORDER BY major_axis_length DESC NULLS LAST, event_id LIMIT 1 OFFSET 5"))
def nth_longest(spark, sf_dir):
    return filters.nth_by(parts(spark, sf_dir), "major_axis_length", 5).select("event_id", "major_axis_length")


GUESS = "CASE WHEN probability_oil >= probability_bubble AND probability_oil >= probability_oily_gas THEN 'probability_oil' WHEN probability_bubble >= probability_oily_gas THEN 'probability_bubble' ELSE 'probability_oily_gas' END"
TOP = "greatest(probability_oil, probability_bubble, probability_oily_gas)"


@query(from_particles(f"SELECT event_id, {GUESS} AS best_guess, round({TOP}, 9) AS best_guess_value FROM particles"))
def best_guess(spark, sf_dir):
    return rounded(classes.with_best_guess(parts(spark, sf_dir)).select("event_id", "best_guess", "best_guess_value"), 9)


@query(from_particles(f""", c AS (SELECT timestamp, CASE WHEN {TOP} >= 0.5::double THEN replace({GUESS}, 'probability_', '') ELSE 'unclassified' END AS class FROM particles),
i AS (SELECT unnest(generate_series((SELECT min(timestamp) FROM particles), (SELECT max(timestamp) FROM particles), INTERVAL 1 HOUR)) AS timestamp)
SELECT i.timestamp, """ + ", ".join(f"round(count(*) FILTER (class = '{c}') / {d(VOLUME)}, 6) AS {c}" for c in ("oil", "bubble", "oily_gas", "unclassified")) + f", round(count(class) / {d(VOLUME)}, 6) AS total FROM i LEFT JOIN c ON i.timestamp = c.timestamp GROUP BY i.timestamp"))
def per_class_conc(spark, sf_dir):
    return rounded(classes.per_class(parts(spark, sf_dir), adapters.image_reference(spark, sf_dir), 0.5, VOLUME))


@query(from_particles(f"SELECT {GUESS} AS best_guess, count(*) AS n FROM particles GROUP BY 1"))
def class_histogram(spark, sf_dir):
    return classes.with_best_guess(parts(spark, sf_dir)).groupBy("best_guess").agg(F.count("*").alias("n"))


@query(from_particles("SELECT least(floor(equivalent_diameter / 500 * 20), 19)::bigint AS z_bin, count(*) AS n FROM particles WHERE equivalent_diameter BETWEEN 0 AND 500 GROUP BY 1"))
def z_histogram(spark, sf_dir):
    v = F.col("equivalent_diameter")
    return parts(spark, sf_dir).where(v.between(0, 500)).groupBy(F.least(F.floor(v / 500 * 20), F.lit(19)).cast("long").alias("z_bin")).agg(F.count("*").alias("n"))


CONF = f", r AS (SELECT {GUESS} AS guess, CASE WHEN solidity > 0.95::double THEN 'probability_oil' ELSE 'probability_bubble' END AS truth FROM particles)"


def labelled(spark, sf_dir):
    p = classes.with_best_guess(parts(spark, sf_dir))
    return p.select(F.col("best_guess").alias("guess"), F.when(F.col("solidity") > 0.95, "probability_oil").otherwise("probability_bubble").alias("truth"))


@query(from_particles(CONF + " SELECT truth, guess, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM r GROUP BY truth, guess"))
def confusion(spark, sf_dir):
    return rounded(classes.confusion(labelled(spark, sf_dir), "truth", "guess"))


@query(from_particles(CONF + ", t AS (SELECT truth AS c, count(*) AS in_t, count(*) FILTER (truth = guess) AS hit FROM r GROUP BY 1), g AS (SELECT guess AS c, count(*) AS in_g FROM r GROUP BY 1) SELECT round(avg(2 * hit::double / (in_t + coalesce(in_g, 0))), 6) AS macro_f1, round(sum(hit)::double / sum(in_t), 6) AS agreement FROM t LEFT JOIN g ON t.c = g.c"))
def macro_f1(spark, sf_dir):
    return rounded(classes.macro_f1(labelled(spark, sf_dir), "truth", "guess"))


SPLIT = nd_sql("class", "SELECT DISTINCT class FROM particles").replace("WITH particles AS (", "WITH particles0 AS (", 1).replace(", bins(bin", f", particles AS (SELECT *, {GUESS} AS class FROM particles0), bins(bin", 1)


@query(SPLIT + f" SELECT class, bin, round({VOL_SQL}, 5) AS vd FROM nd")
def class_vd(spark, sf_dir):
    p = classes.with_best_guess(parts(spark, sf_dir)).withColumnRenamed("best_guess", "class")
    return rounded(distributions.distribution(p, PIXEL, ["class"]).select("class", "bin", sizes.volume(F.col("n"), F.col("dia")).alias("vd")), 5)


INTERP = """, aux AS (SELECT ts AS time, max(value) AS depth FROM events WHERE event_type = 'signup' GROUP BY ts), i AS (SELECT DISTINCT timestamp FROM particles),
a AS (SELECT i.timestamp, x.time AS t0, x.depth AS d0 FROM i ASOF LEFT JOIN aux x ON i.timestamp >= x.time),
b AS (SELECT a.*, y.time AS t1, y.depth AS d1 FROM a ASOF LEFT JOIN aux y ON a.timestamp <= y.time),
v AS (SELECT *, CASE WHEN t0 = t1 THEN d0 ELSE d0 + (d1 - d0) * (epoch_us(timestamp) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END AS z FROM b)"""


@query(from_particles(INTERP + " SELECT timestamp, round(z, 6) AS depth FROM v"))
def aux_interp(spark, sf_dir):
    return rounded(series.interpolated(parts(spark, sf_dir), adapters.auxiliary(spark, sf_dir), "depth"))


@query(from_particles(INTERP + " SELECT timestamp, round(coalesce(z, d0, d1), 6) AS depth FROM v"))
def depth_interp(spark, sf_dir):
    return rounded(series.interpolated(parts(spark, sf_dir), adapters.auxiliary(spark, sf_dir), "depth", clamp=True))


@query(from_particles("SELECT event_id, round(solidity, 6) AS solidity, NULL::double AS minor_axis_length FROM particles UNION ALL SELECT event_id, NULL, round(minor_axis_length, 6) FROM particles"))
def append_union(spark, sf_dir):
    p = rounded(parts(spark, sf_dir))
    return exports.append(p.select("event_id", "solidity"), p.select("event_id", "minor_axis_length"))


FILES = ", f AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM particles))"


def files(spark, sf_dir):
    """The images as a numbered list of files, and how many there are."""
    images = parts(spark, sf_dir).select("timestamp").distinct()
    return exports.numbered(images), images.count()


@query(from_particles(FILES + " SELECT timestamp, ord, floor(ord / ceil(n / 4.0))::bigint AS chunk FROM f"))
def chunk_block(spark, sf_dir):
    f, n = files(spark, sf_dir)
    return exports.chunked(f, 4, n)


@query(from_particles(FILES + " SELECT timestamp, ord, ord % 4 AS chunk FROM f"))
def chunk_interleave(spark, sf_dir):
    f, n = files(spark, sf_dir)
    return exports.chunked(f, 4, n, "interleave")


@query(from_particles(FILES + ", c AS (SELECT timestamp, ord, floor(ord / ceil(n / 4.0))::bigint AS chunk FROM f), s AS (SELECT chunk, min(ord) AS first FROM c GROUP BY chunk) SELECT timestamp, ord, chunk, false AS is_background FROM c UNION ALL SELECT c.timestamp, c.ord, s.chunk, true FROM s JOIN c ON c.ord >= s.first - 5 AND c.ord < s.first"))
def chunk_background(spark, sf_dir):
    f, n = files(spark, sf_dir)
    return exports.with_background_files(exports.chunked(f, 4, n), 5).select("timestamp", "ord", "chunk", "is_background")


@query(from_particles("SELECT event_id, CASE WHEN export_name <> 'not_exported' THEN timestamp END AS parsed FROM particles"))
def timestamp_parse(spark, sf_dir):
    name = F.concat(F.regexp_replace("export_name", "-PN.*$", ""), F.lit(".silc"))
    return parts(spark, sf_dir).select("event_id", exports.parse_timestamp(name).alias("parsed"))


@query(from_particles("SELECT event_id, " + ", ".join(f"{g}({a} {s} {e}, {z}) AS {a}" for a, s, e, g, z in (("minr", "-", "round_even((maxr - minr) * 0.3::double / 2, 0)", "greatest", "0.0::double"), ("maxr", "+", "round_even((maxr - minr) * 0.3::double / 2, 0)", "least", "2048.0::double"), ("minc", "-", "round_even((maxc - minc) * 0.3::double / 2, 0)", "greatest", "0.0::double"), ("maxc", "+", "round_even((maxc - minc) * 0.3::double / 2, 0)", "least", "2448.0::double"))) + " FROM particles"))
def expand_bbox(spark, sf_dir):
    return exports.expand_bbox(parts(spark, sf_dir), 0.3, 2048, 2448).select("event_id", "minr", "maxr", "minc", "maxc")


PIXELS_SQL = "WITH px AS (SELECT vec_id AS frame, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), pixels AS (SELECT frame, pos, (e + 4) / 8 AS px FROM px)"
BG_SQL = PIXELS_SQL + ", w AS (SELECT frame, pos, px, avg(px) OVER (PARTITION BY pos ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS bg, count(*) OVER (PARTITION BY pos ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS seen FROM pixels), bg AS (SELECT frame, pos, px, bg FROM w WHERE seen = 5)"


def moving(spark, sf_dir):
    return background.moving_background(adapters.pixels(spark, sf_dir), 5)


@query(BG_SQL + " SELECT frame, pos::int AS pos, round(bg, 6) AS bg FROM bg")
def bg_moving(spark, sf_dir):
    return rounded(moving(spark, sf_dir).select("frame", "pos", "bg"))


@query(PIXELS_SQL + ", b AS (SELECT pos, avg(px) AS bg FROM pixels WHERE frame < 5 GROUP BY pos) SELECT frame, pos::int AS pos, round(bg, 6) AS bg FROM pixels JOIN b USING (pos) WHERE frame >= 5")
def bg_static(spark, sf_dir):
    return rounded(background.static_background(adapters.pixels(spark, sf_dir), 5).select("frame", "pos", "bg"))


@query(BG_SQL + ", q AS (SELECT *, px - bg AS d FROM bg), s AS (SELECT frame, quantile_cont(d, 0.5) AS med, max(d) AS top FROM q GROUP BY frame) SELECT frame, pos::int AS pos, round(d + (0.5 - med) + (1 - (top + (0.5 - med))), 6) AS im FROM q JOIN s USING (frame)")
def correct_subtract(spark, sf_dir):
    return rounded(background.correct_subtract(moving(spark, sf_dir)))


@query(BG_SQL + ", q AS (SELECT *, px / greatest(bg, 1 / 255.0::double) AS d FROM bg), s AS (SELECT frame, quantile_cont(d, 0.5) AS med, min(d) AS low FROM q GROUP BY frame) SELECT frame, pos::int AS pos, round(least(greatest(d + (0.5 - med) - (low + (0.5 - med)), 0), 1), 6) AS im FROM q JOIN s USING (frame)")
def correct_divide(spark, sf_dir):
    return rounded(background.correct_divide(moving(spark, sf_dir)))


@query(BG_SQL + " SELECT frame, pos::int AS pos, round(least(greatest(px - bg + 215 / 255.0::double, 0), 1), 6) AS im FROM bg")
def correct_fast(spark, sf_dir):
    return rounded(background.correct_fast(moving(spark, sf_dir)))


MASK_SQL = PIXELS_SQL + ", m AS (SELECT frame, quantile_cont(px, 0.5) AS med FROM pixels GROUP BY frame), mask AS (SELECT frame, pos, px < 0.98::double * med AS dark FROM pixels JOIN m USING (frame))"


@query(MASK_SQL + " SELECT frame, pos::int AS pos, dark FROM mask")
def threshold_fast(spark, sf_dir):
    return background.threshold_fast(adapters.pixels(spark, sf_dir))


@query(MASK_SQL + " SELECT frame, round(avg(dark::int) * 100 / 30.0::double, 6) AS covered, avg(dark::int) * 100 / 30.0::double < 1 AS accepted FROM mask GROUP BY frame")
def coverage(spark, sf_dir):
    return rounded(background.coverage(background.threshold_fast(adapters.pixels(spark, sf_dir))))


@query(PIXELS_SQL + " SELECT floor(frame / 10)::bigint AS stack, pos::int AS pos, round(stddev_pop(px), 6) AS std, round(max(px), 6) AS max FROM pixels GROUP BY 1, 2")
def stack_summary(spark, sf_dir):
    return rounded(background.stack_summary(adapters.pixels(spark, sf_dir), 10))


def masks(spark, sf_dir):
    """Dark pixels of the frames of 8 x 8 pixels, a frame a row."""
    dark = background.threshold_fast(adapters.pixels(spark, sf_dir))
    return dark.groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dark"))), lambda x: x["dark"]).alias("dark")).withColumn("cols", F.lit(8))


LABEL_SQL = MASK_SQL.replace("WITH px AS", "WITH RECURSIVE px AS", 1) + """, dk AS (SELECT frame, pos, pos // 8 AS r, pos % 8 AS c FROM mask WHERE dark),
ed AS (SELECT a.frame, a.pos AS a, b.pos AS b FROM dk a JOIN dk b ON a.frame = b.frame AND a.pos <> b.pos AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
rc AS (SELECT frame, pos, pos AS root FROM dk UNION SELECT rc.frame, ed.b, rc.root FROM rc JOIN ed ON ed.frame = rc.frame AND ed.a = rc.pos WHERE rc.root < ed.b),
lb AS (SELECT dk.*, rt.root, dense_rank() OVER (PARTITION BY dk.frame ORDER BY rt.root) AS label FROM dk JOIN (SELECT frame, pos, min(root) AS root FROM rc GROUP BY 1, 2) rt USING (frame, pos)),
ms AS (SELECT frame, label::int AS label, count(*) AS area, min(r)::double AS minr, min(c)::double AS minc, max(r)::double + 1 AS maxr, max(c)::double + 1 AS maxc, var_pop(r) AS vr, var_pop(c) AS vc, covar_pop(r, c) AS vrc FROM lb GROUP BY frame, label)"""


@query(LABEL_SQL + " SELECT frame, label, area, minr, minc, maxr, maxc, round(4 * sqrt(greatest(round((vr + vc) / 2 + sqrt(((vr - vc) / 2) ** 2 + vrc ** 2), 9), 0)), 6) AS major_axis_length, round(4 * sqrt(greatest(round((vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + vrc ** 2), 9), 0)), 6) AS minor_axis_length, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter FROM ms")
def label_measure(spark, sf_dir):
    return rounded(particles.measured(particles.labelled(masks(spark, sf_dir))).drop("error"))


BOX = "abs(p.minr - g.minr) + abs(p.minc - g.minc) + abs(p.maxr - g.maxr) + abs(p.maxc - g.maxc)"


@query(from_particles(f", p AS (SELECT timestamp AS frame, event_id AS particle, minr, minc, maxr, maxc FROM particles), g AS (SELECT frame, particle AS region, particle % 50 AS ifocus, minr + 30 AS minr, minc + 30 AS minc, maxr + 30 AS maxr, maxc + 30 AS maxc FROM p), b AS (SELECT p.frame, p.particle, g.region, g.ifocus, row_number() OVER (PARTITION BY p.frame, p.particle ORDER BY {BOX}, g.region) AS k FROM p JOIN g ON p.frame = g.frame) SELECT p.particle, b.region::double AS region, b.ifocus::double AS ifocus, round(2.0::double + b.ifocus * 0.5::double, 6) AS z FROM p LEFT JOIN b ON p.frame = b.frame AND p.particle = b.particle AND k = 1"))
def merge_stats(spark, sf_dir):
    p = parts(spark, sf_dir).select(F.col("timestamp").alias("frame"), F.col("event_id").alias("particle"), "minr", "minc", "maxr", "maxc")
    moved = {c: F.col(c) + 30 for c in ("minr", "minc", "maxr", "maxc")}  # boxes of the regions, a little off those of the particles
    g = p.withColumns(moved).withColumnRenamed("particle", "region").withColumn("ifocus", F.col("region") % 50)
    return rounded(particles.merged(p, g, 2.0, 0.5).select("particle", F.col("region").cast("double").alias("region"), F.col("ifocus").cast("double").alias("ifocus"), "z"))

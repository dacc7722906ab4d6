"""Registered queries, each with DuckDB SQL for the same rows where SQL can say them. Floats are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..operators import documents, information, joins, kernels, moments, pixels, regions, search, sequence
from ..sources.files import packets
from ..sources.frames import bin_frames, frames, table
from ..sources.frames import pixels as long_form
from ..streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id AS k, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS f
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"""
Z = PX + """, im AS (SELECT y, x, avg(f) AS m, stddev_samp(f) AS s FROM px GROUP BY y, x),
z AS (SELECT k, y, x, (f - m) / nullif(s, 0) AS z FROM px JOIN im USING (y, x))"""
#: The pages with title, text, tags and url, as both sides see them.
PAGES = """pg AS (SELECT page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g') AS text,
  regexp_extract(html, 'lang="([a-z]+)"', 1) AS tags, url FROM pages)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def R(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(frames(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\n\\r]+", " ")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), plain.alias("text"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("tags"), "url")


# --- statistics of pixels ------------------------------------------------------------------------------------------

MOMENTS = """SELECT y, x, count(*) AS n, {mean}, {var}, {skew}, {kurt}, {lo}, {hi} FROM
(SELECT y, x, f, f - avg(f) OVER (PARTITION BY y, x) AS d FROM px) GROUP BY y, x""".format(
    mean=R("avg(f)", "mean"), var=R("var_samp(f)", "var_samp"), skew=R("sum(d * d * d) * sqrt(count(*)) / nullif(pow(sum(d * d), 1.5), 0)", "skew"),
    kurt=R("sum(d * d * d * d) * count(*) / nullif(sum(d * d) * sum(d * d), 0)", "kurt"), lo=R("min(f)", "fmin"), hi=R("max(f)", "fmax"),
)


@query(f"WITH {PX} {MOMENTS}")
def pixel_moments(spark, sf_dir):
    return rounded(moments.moments(px(spark, sf_dir), ["y", "x"]), "mean", "var_samp", "skew", "kurt", "fmin", "fmax")


@query(f"WITH {PX} SELECT y, x, {R('avg(f)', 'mean')} FROM px GROUP BY y, x")
def temporal_mean_image(spark, sf_dir):
    return rounded(pixels.mean_image(px(spark, sf_dir)), "mean")


@query(f"WITH {PX} SELECT k, y, x, {R('f - avg(f) OVER (PARTITION BY y, x)', 'f')} FROM px")
def mean_subtract(spark, sf_dir):
    return rounded(pixels.subtract_mean(px(spark, sf_dir)), "f")


@query(f"WITH {PX} SELECT k, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, {R('avg(f)', 'f')} FROM px GROUP BY ALL")
def bin_2x2(spark, sf_dir):
    return rounded(long_form(bin_frames(frames(spark, sf_dir)), 4), "f")


@query(f"WITH {PX} SELECT k, y, x, {R('(f - min(f) OVER (PARTITION BY k)) / nullif(max(f) OVER (PARTITION BY k) - min(f) OVER (PARTITION BY k), 0)', 'f')} FROM px")
def contrast_scale(spark, sf_dir):
    return rounded(long_form(pixels.contrast(frames(spark, sf_dir))), "f")


@query(f"""WITH {PX}, s AS (SELECT k, y, x, (f - min(f) OVER w) / nullif(max(f) OVER w - min(f) OVER w, 0) AS g FROM px WINDOW w AS (PARTITION BY k))
SELECT k, y, x, {R('pow(greatest(0, least(15, floor(g * 15))) / 15, 2)', 'f')} FROM s""")
def lut_map(spark, sf_dir):
    return rounded(long_form(pixels.lut(pixels.contrast(frames(spark, sf_dir)), [(i / 15) ** 2 for i in range(16)])), "f")


@query("SELECT vec_id AS k, round(CAST(embedding[20] AS DOUBLE), 6) + 0.0 AS f FROM embeddings")
def pixel_sample(spark, sf_dir):
    return rounded(pixels.sample(frames(spark, sf_dir), 2, 3), "f")


@query(f"WITH {Z} SELECT k, y, x, {R('z')} FROM z WHERE z > 1.5")
def zscore_threshold(spark, sf_dir):
    return rounded(pixels.above(pixels.z_scores(px(spark, sf_dir))), "z")


@query(f"""WITH {Z}, c AS (SELECT k, t, count(*) FILTER (z > t) AS n FROM z, (VALUES (1.0::DOUBLE), (1.5), (2.0), (2.5)) AS v(t) GROUP BY k, t)
SELECT k, t, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN n <= 4 OR t = 2.5 THEN t END NULLS LAST) AS r FROM c) WHERE r = 1""")
def threshold_sweep(spark, sf_dir):
    return pixels.sweep(pixels.z_scores(px(spark, sf_dir)), [1.0, 1.5, 2.0, 2.5], 4)


#: The moments of every prefix of a pixel's frames, in two passes: its mean, then the sums of powers of deviations from it.
PREFIXES = f"""WITH {PX}, o AS (SELECT *, count(*) OVER w AS n, avg(f) OVER w AS m1, min(f) OVER w AS fmin, max(f) OVER w AS fmax FROM px WINDOW w AS (PARTITION BY y, x ORDER BY k)),
s AS (SELECT o.y, o.x, o.k, o.n::DOUBLE AS n, o.m1, sum(pow(p.f - o.m1, 2)) AS m2, sum(pow(p.f - o.m1, 3)) AS m3, sum(pow(p.f - o.m1, 4)) AS m4, o.fmin, o.fmax
  FROM o JOIN px p ON p.y = o.y AND p.x = o.x AND p.k <= o.k GROUP BY o.y, o.x, o.k, o.n, o.m1, o.fmin, o.fmax)"""


@query(f"{PREFIXES} SELECT y, x, k, n, {R('m1')}, {R('m2')}, {R('m3')}, {R('m4')}, {R('fmin')}, {R('fmax')} FROM s")
def running_moments(spark, sf_dir):
    out = moments.running(px(spark, sf_dir), ["y", "x"]).drop("f")
    return rounded(out, "m1", "m2", "m3", "m4", "fmin", "fmax")


@query(f"""{PREFIXES}, d AS (SELECT y, x, k, n, m2, m1 - coalesce(lag(m1) OVER w, 0) AS dm1, m2 - coalesce(lag(m2) OVER w, 0) AS dm2, m3 - coalesce(lag(m3) OVER w, 0) AS dm3, m4 - coalesce(lag(m4) OVER w, 0) AS dm4
FROM s WINDOW w AS (PARTITION BY y, x ORDER BY k)) SELECT y, x, k, {R('dm1')}, {R('dm2')}, {R('dm3')}, {R('dm4')}, {R('dm2 / greatest(1, n - 1)', 'd_var')},
{R('dm3 * sqrt(greatest(1, n)) / nullif(pow(m2, 1.5), 0)', 'd_skew')}, {R('dm4 * n / nullif(m2 * m2, 0)', 'd_kurt')} FROM d""")
def differential_moments(spark, sf_dir):
    return rounded(moments.differential(px(spark, sf_dir), ["y", "x"]), "dm1", "dm2", "dm3", "dm4", "d_var", "d_skew", "d_kurt")


@query(f"WITH {PX} SELECT k, y, x, {R('f - lag(f) OVER (PARTITION BY y, x ORDER BY k)', 'd')} FROM px")
def temporal_difference(spark, sf_dir):
    return rounded(pixels.difference(px(spark, sf_dir)), "d")


@query(f"WITH {PX} SELECT k, y, x, {R('avg(f) OVER (PARTITION BY y, x ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)', 'template')} FROM px")
def moving_average_template(spark, sf_dir):
    return rounded(pixels.moving_template(px(spark, sf_dir)), "template")


@query()
def fixed_template(spark, sf_dir):
    return rounded(pixels.fixed_template(px(spark, sf_dir)), "template")


@query(f"""WITH {PX}, m AS (SELECT vec_id AS k, CAST(vec_id % 3 - 1 AS INTEGER) AS dy, CAST(vec_id % 5 - 2 AS INTEGER) AS dx FROM embeddings)
SELECT t.k, t.y, t.x, round(p.f, 6) + 0.0 AS f FROM px t JOIN m ON m.k = t.k LEFT JOIN px p ON p.k = t.k AND p.y = t.y - m.dy AND p.x = t.x - m.dx""")
def align_shift(spark, sf_dir):
    moved = pixels.shift(frames(spark, sf_dir), F.col("k") % 3 - 1, F.col("k") % 5 - 2)
    return rounded(long_form(moved), "f")


@query(f"""WITH {PX}, c AS (SELECT k, y, x, CASE WHEN (k + y + x) % 7 <> 0 THEN f END AS f FROM px)
SELECT k, y, x, {R('coalesce(f, last_value(f IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(f) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))', 'f')} FROM c WINDOW w AS (PARTITION BY y, x ORDER BY k)""")
def edge_infill(spark, sf_dir):
    holes = px(spark, sf_dir).withColumn("f", F.when((F.col("k") + F.col("y") + F.col("x")) % 7 != 0, F.col("f")))
    return rounded(pixels.fill_edges(holes), "f")


@query(f"""WITH {PX}, c AS (SELECT k, y, x, CASE WHEN (k + y + x) % 7 <> 0 THEN f END AS f FROM px)
SELECT k, y, x, {R('coalesce(f, avg(f) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), last_value(f IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))', 'f')} FROM c WINDOW w AS (PARTITION BY y, x ORDER BY k)""")
def edge_infill_mean(spark, sf_dir):
    holes = px(spark, sf_dir).withColumn("f", F.when((F.col("k") + F.col("y") + F.col("x")) % 7 != 0, F.col("f")))
    return rounded(pixels.fill_edges(holes, 4), "f")


@query(f"""WITH {PX}, n AS (SELECT p.k, p.y, p.x, p.f, e.f AS e, w.f AS w, s.f AS s, o.f AS o, (se.f - sw.f - ne.f + nw.f) / 4 AS xy FROM px p
JOIN px e ON e.k = p.k AND e.y = p.y AND e.x = p.x + 1 JOIN px w ON w.k = p.k AND w.y = p.y AND w.x = p.x - 1
JOIN px s ON s.k = p.k AND s.y = p.y + 1 AND s.x = p.x JOIN px o ON o.k = p.k AND o.y = p.y - 1 AND o.x = p.x
JOIN px se ON se.k = p.k AND se.y = p.y + 1 AND se.x = p.x + 1 JOIN px sw ON sw.k = p.k AND sw.y = p.y + 1 AND sw.x = p.x - 1
JOIN px ne ON ne.k = p.k AND ne.y = p.y - 1 AND ne.x = p.x + 1 JOIN px nw ON nw.k = p.k AND nw.y = p.y - 1 AND nw.x = p.x - 1),
h AS (SELECT k, y, x, (e - w) / 2 AS gx, (s - o) / 2 AS gy, (e - 2 * f + w) AS xx, (s - 2 * f + o) AS yy, xy FROM n)
SELECT k, y, x, {R('gx')}, {R('gy')}, {R('(xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)', 'l1')}, {R('(xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy)', 'l2')} FROM h""")
def gradient_hessian(spark, sf_dir):
    return rounded(pixels.gradients(frames(spark, sf_dir)), "gx", "gy", "l1", "l2")


@query(f"""WITH {PX}, b AS (SELECT k, y, x, f > 0 AS b FROM px),
e AS (SELECT p.k, p.y, p.x, count(*) FILTER (q.b) = 9 AS e FROM b p JOIN b q ON q.k = p.k AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL)
SELECT DISTINCT p.k, p.y, p.x FROM e p JOIN e q ON q.k = p.k AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 WHERE q.e""")
def morph_open(spark, sf_dir):
    return pixels.opened(frames(spark, sf_dir), F.lit(0.0))


@query(f"""WITH {PX}, b AS (SELECT k, y, x, f > 1 AS b FROM px),
e AS (SELECT p.k, p.y, p.x, count(*) FILTER (q.b) > 0 AS e FROM b p JOIN b q ON q.k = p.k AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL)
SELECT p.k, p.y, p.x FROM e p JOIN e q ON q.k = p.k AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY p.k, p.y, p.x HAVING count(*) FILTER (q.e) = 9""")
def morph_close(spark, sf_dir):
    return pixels.closed(frames(spark, sf_dir), F.lit(1.0))


@query(f"""WITH {PX}, g AS (SELECT *, f - min(f) OVER (PARTITION BY k) AS w FROM px), r AS (SELECT k, y, sum(f) AS s FROM px GROUP BY k, y), c AS (SELECT k, x, sum(f) AS s FROM px GROUP BY k, x),
m AS (SELECT k, sum(w * y) / nullif(sum(w), 0) AS cy_mass, sum(w * x) / nullif(sum(w), 0) AS cx_mass FROM g GROUP BY k)
SELECT k, cy, cx, {R('cy_mass')}, {R('cx_mass')} FROM m JOIN (SELECT k, arg_max(y, s) AS cy FROM r GROUP BY k) USING (k) JOIN (SELECT k, arg_max(x, s) AS cx FROM c GROUP BY k) USING (k)""")
def centroid_projection(spark, sf_dir):
    return rounded(pixels.mass_centres(frames(spark, sf_dir)), "cy_mass", "cx_mass")


# --- sequences -----------------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS r FROM events)
SELECT user_id, event_id, {R('CASE WHEN count(value) OVER w > 1 THEN (avg(r * value) OVER w - avg(r) OVER w * avg(value) OVER w) / nullif(avg(r * r) OVER w - avg(r) OVER w * avg(r) OVER w, 0) END', 'slope')}
FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def moving_slope(spark, sf_dir):
    return rounded(sequence.moving_slope(events(spark, sf_dir), ["user_id"], "event_id", "value"), "slope")


@query(f"""WITH t AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM events),
u AS (SELECT user_id, event_id, l, list_avg(l) AS m FROM t),
d AS (SELECT user_id, event_id, len(l) AS n, list_sum(list_transform(l, lambda v: pow(v - m, 2))) AS m2, list_sum(list_transform(l, lambda v: pow(v - m, 3))) AS m3, list_sum(list_transform(l, lambda v: pow(v - m, 4))) AS m4 FROM u)
SELECT user_id, event_id, {R('CASE WHEN n >= 4 THEN m3 * sqrt(n) / nullif(pow(m2, 1.5), 0) END', 'skew')}, {R('CASE WHEN n >= 4 THEN m4 * n / nullif(m2 * m2, 0) END', 'kurt')} FROM d""")
def moving_shape(spark, sf_dir):
    return rounded(sequence.moving_shape(events(spark, sf_dir), ["user_id"], "event_id", "value"), "skew", "kurt")


@query(f"""WITH RECURSIVE t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT user_id, event_id, r, value AS y FROM t WHERE r = 1 UNION ALL SELECT t.user_id, t.event_id, t.r, 0.3 * t.value + 0.7 * s.y FROM s JOIN t ON t.user_id = s.user_id AND t.r = s.r + 1)
SELECT user_id, event_id, round(y, 9) + 0.0 AS y FROM s""")
def lowpass_template(spark, sf_dir):
    out = sequence.lowpass(events(spark, sf_dir), ["user_id"], "event_id", "value")
    return out.withColumn("y", F.round("y", 9) + 0.0)  # ties at six places are common here


@query(f"""WITH d AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS day, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM d), s AS (SELECT *, avg(n - trend) OVER (PARTITION BY day % 7) AS season FROM t)
SELECT day, n, {R('trend')}, {R('season')}, {R('n - trend - season', 'rest')} FROM s""")
def decompose_trend_season(spark, sf_dir):
    daily = events(spark, sf_dir).groupBy(F.unix_date(F.to_date("ts")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(sequence.decompose(daily, "day", "n"), "trend", "season", "rest")


@query("""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS own FROM conversations), s AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS allotted, (turn + 1) * 150 AS elapsed FROM t)
SELECT conv_id, turn, allotted, elapsed, CASE WHEN allotted - elapsed < 0 THEN 'behind' WHEN allotted - elapsed < own THEN 'on-track' ELSE 'ahead' END AS status FROM s""")
def pacing_status(spark, sf_dir):
    own = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return sequence.pacing(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", own, (F.col("turn") + 1) * 150)


@query(f"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS past, count(*) OVER (PARTITION BY conv_id) AS total,
{R("CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / (count(*) OVER (PARTITION BY conv_id) - 1)::DOUBLE ELSE 1.0::DOUBLE END", 'done')} FROM conversations""")
def slide_progress(spark, sf_dir):
    return rounded(sequence.progress(table(spark, sf_dir, "conversations"), ["conv_id"], "turn"), "done")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(coalesce(text, '')) % 3 END AS idx FROM conversations)
SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY idx IS NULL, idx, CASE WHEN idx IS NULL THEN turn END) - 1 AS INTEGER) AS fragment FROM t""")
def fragment_reindex(spark, sf_dir):
    index = F.when(F.col("role") == "user", F.length(F.coalesce("text", F.lit(""))) % 3)
    return sequence.reindex(table(spark, sf_dir, "conversations"), ["conv_id"], index, "turn")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
s AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS h FROM t)
SELECT conv_id, turn, h, row_number() OVER (PARTITION BY conv_id, h ORDER BY turn) - 1 AS v FROM s""")
def slide_stack(spark, sf_dir):
    return sequence.stack(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")


@query("SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS number FROM conversations")
def list_counter(spark, sf_dir):
    return sequence.counters(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn")


@query("""WITH t AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT - 1 AS run FROM t)
SELECT user_id, run, any_value(event_type) AS event_type, min(event_id) AS low, max(event_id) AS high, count(*) AS n FROM s GROUP BY user_id, run""")
def block_runs(spark, sf_dir):
    return sequence.runs(events(spark, sf_dir), ["user_id"], "event_id", "event_type")


@query(f"""WITH t AS (SELECT user_id, event_id, value % 360 AS a FROM events), d AS (SELECT user_id, event_id, a - lag(a) OVER (PARTITION BY user_id ORDER BY event_id) + 180.0 AS d FROM t),
s AS (SELECT user_id, event_id, coalesce(d - 360.0 * floor(d / 360.0) - 180.0, 0) AS step FROM d)
SELECT user_id, event_id, {R('sum(step) OVER (PARTITION BY user_id ORDER BY event_id) / 360.0', 'turns')} FROM s""")
def unwrap_rotation(spark, sf_dir):
    return rounded(sequence.rotations(events(spark, sf_dir), ["user_id"], "event_id", F.col("value") % 360), "turns")


@query(f"SELECT event_type, {R('2 * avg(value * cos(event_id * 2 * pi() / 50))', 'i')}, {R('2 * avg(value * sin(event_id * 2 * pi() / 50))', 'q')} FROM events GROUP BY event_type")
def demodulate(spark, sf_dir):
    return rounded(sequence.demodulate(events(spark, sf_dir), ["event_type"], "event_id", "value", 50), "i", "q")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("""SELECT v.event_id, v.ts, s.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON s.ts <= v.ts""")
def event_frame_asof(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.where("event_type = 'signup'").select("ts", F.col("event_id").alias("signup"))
    return joins.as_of(e.where("event_type = 'view'").select("ts", "event_id"), right, "ts", "signup")


@query("""SELECT v.user_id, v.event_id, v.ts, s.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON s.user_id = v.user_id AND s.ts <= v.ts""")
def event_frame_asof_by_user(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup"))
    return joins.as_of(e.where("event_type = 'view'").select("user_id", "ts", "event_id"), right, "ts", "signup", by=["user_id"])


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet log from the events; every thirteenth line is broken."""
    line = F.concat(F.lit("s"), (F.col("event_id") % 2 + 1).cast("string"), F.lit("x"), (F.col("user_id") % 41 - 20).cast("string"), F.when(F.col("event_id") % 13 == 0, "?").otherwise("y"), F.floor(F.col("value")).cast("string"))
    return events(spark, sf_dir).select("event_id", line.alias("value"))


@query("""SELECT event_id, CAST(event_id % 2 + 1 AS INTEGER) AS sensor, CAST(user_id % 41 - 20 AS INTEGER) AS dx, CAST(floor(value) AS INTEGER) AS dy FROM events WHERE event_id % 13 <> 0""")
def sensor_decode(spark, sf_dir):
    return packets(packet_lines(spark, sf_dir))[0].drop("value")


@query("SELECT event_id, 's' || (event_id % 2 + 1) || 'x' || (user_id % 41 - 20) || '?' || CAST(floor(value) AS BIGINT) AS value FROM events WHERE event_id % 13 = 0")
def sensor_quarantine(spark, sf_dir):
    return packets(packet_lines(spark, sf_dir))[1]


@query(f"""WITH p AS (SELECT event_id // 3 AS bucket, event_id % 2 + 1 AS s, user_id % 41 - 20 AS dx, CAST(floor(value) AS BIGINT) AS dy FROM events WHERE event_id % 13 <> 0),
b AS (SELECT bucket, sum(dx) FILTER (s = 1) AS x1, sum(dy) FILTER (s = 1) AS y1, sum(dx) FILTER (s = 2) AS x2, sum(dy) FILTER (s = 2) AS y2 FROM p GROUP BY bucket)
SELECT bucket, y1::DOUBLE AS pitch, {R('y2::DOUBLE', 'roll')}, (x1 + x2) / 2.0::DOUBLE AS yaw FROM b WHERE x1 IS NOT NULL AND x2 IS NOT NULL""")
def sensor_pair(spark, sf_dir):
    return rounded(joins.sphere(joins.pair_sensors(packets(packet_lines(spark, sf_dir))[0], "event_id", 3)), "roll")


@query("SELECT event_id, CASE WHEN value >= 0 AND value < 140 THEN CAST(floor(value / 20) AS INTEGER) + 1 END AS zone FROM events")
def zone_assign(spark, sf_dir):
    return joins.zones(events(spark, sf_dir), F.col("value"), 0.0, 140.0).select("event_id", "zone")


@query(f"""WITH {Z}, h AS (SELECT * FROM z WHERE z > 2.0)
SELECT a.k, a.y * 8 + a.x AS a, b.y * 8 + b.x AS b, {R('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))', 'distance')} FROM h a JOIN h b ON a.k = b.k AND a.y * 8 + a.x < b.y * 8 + b.x AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2""")
def pixel_band_join(spark, sf_dir):
    hot = pixels.above(pixels.z_scores(px(spark, sf_dir)), 2.0).select("k", (F.col("y") * 8 + F.col("x")).alias("id"), "x", "y")
    return rounded(joins.near_pairs(hot, 2, 2.0, ["k"]), "distance")


# --- regions -------------------------------------------------------------------------------------------------------


@query(f"WITH {Z} SELECT k, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, {R('avg(x)', 'cx')}, {R('avg(y)', 'cy')} FROM z WHERE z > 1.5 GROUP BY k")
def roi_boxes(spark, sf_dir):
    return rounded(regions.boxes(pixels.above(pixels.z_scores(px(spark, sf_dir))), ["k"]), "cx", "cy")


MASK = "mk AS (SELECT *, (y // 4) * 2 + x // 4 AS roi, 1.0::DOUBLE / (1 + y + x) AS w FROM px)"


@query(f"WITH {PX}, {MASK} SELECT CAST(roi AS INTEGER) AS roi, k, {R('avg(f)', 'intensity')}, {R('sum(w * f) / sum(w)', 'weighted')} FROM mk GROUP BY roi, k")
def roi_trace(spark, sf_dir):
    return rounded(regions.traces(px(spark, sf_dir), spark.sql(regions.box_mask(8, 8, 4))), "intensity", "weighted")


@query(f"WITH {PX}, {MASK} SELECT CAST(roi AS INTEGER) AS roi, k, {R('sum(f)', 'm00')}, {R('sum(x * f)', 'm10')}, {R('sum(y * f)', 'm01')}, {R('sum(x * y * f)', 'm11')}, {R('sum(x * x * f)', 'm20')}, {R('sum(y * y * f)', 'm02')} FROM mk GROUP BY roi, k")
def roi_spatial_moments(spark, sf_dir):
    return rounded(regions.spatial_moments(px(spark, sf_dir), spark.sql(regions.box_mask(8, 8, 4))), "m00", "m10", "m01", "m11", "m20", "m02")


COMPONENTS = f"""WITH RECURSIVE {Z}, h AS (SELECT k, y, x FROM z WHERE z > 1.5),
g AS (SELECT k, y, x, y * 8 + x AS label FROM h UNION SELECT h.k, h.y, h.x, g.label FROM g JOIN h ON h.k = g.k AND abs(h.y - g.y) <= 1 AND abs(h.x - g.x) <= 1),
c AS (SELECT k, y, x, CAST(min(label) AS INTEGER) AS label FROM g GROUP BY k, y, x)"""


@query(f"{COMPONENTS} SELECT * FROM c")
def connected_components(spark, sf_dir):
    return regions.components(pixels.above(pixels.z_scores(px(spark, sf_dir))))


@query(f"""{COMPONENTS}, q AS (SELECT k, label, count(*) AS area FROM c GROUP BY k, label)
SELECT y, x, count(*) AS n, {R('avg(area)', 'mean_area')}, max(area) AS most FROM c JOIN q USING (k, label) GROUP BY y, x""")
def region_pixel_stats(spark, sf_dir):
    labelled = connected_components(spark, sf_dir)
    met = labelled.join(regions.boxes(labelled, ["k", "label"]).select("k", "label", "area"), ["k", "label"])
    return rounded(met.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("mean_area"), F.max("area").alias("most")), "mean_area")


def found_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of at least three pixels, as regions with an id."""
    boxes = regions.boxes(connected_components(spark, sf_dir), ["k", "label"]).where("area >= 3")
    return boxes.select((F.col("k") * 64 + F.col("label")).alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area")


REGIONS = f"{COMPONENTS}, q AS (SELECT k * 64 + label AS id, avg(x) AS x, avg(y) AS y, count(*) AS area FROM c GROUP BY k, label HAVING count(*) >= 3), e AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM q a JOIN q b ON a.id < b.id AND a.area // 8 = b.area // 8 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.25)"


@query(f"{REGIONS} SELECT a, b, {R('distance')} FROM e")
def roi_adjacency(spark, sf_dir):
    return rounded(regions.merge_edges(found_regions(spark, sf_dir), 0.25, 1), "distance")


@query(f"{REGIONS}, s AS (SELECT id, id AS other FROM q UNION SELECT s.id, CASE WHEN e.a = s.other THEN e.b ELSE e.a END FROM s JOIN e ON s.other IN (e.a, e.b)) SELECT id, min(other) AS roi FROM s GROUP BY id")
def roi_block_merge(spark, sf_dir):
    found = found_regions(spark, sf_dir)
    return regions.merged(found, regions.merge_edges(found, 0.25, 1))


@query(f"""WITH {PX}, m AS (SELECT p.k, p.y, p.x, p.f, max(q.f) AS most FROM px p JOIN px q ON q.k = p.k AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND (q.y <> p.y OR q.x <> p.x) GROUP BY ALL)
SELECT k, y, x, {R('f')} FROM m WHERE f >= most""")
def local_peaks(spark, sf_dir):
    return rounded(pixels.local_peaks(frames(spark, sf_dir)), "f")


GROWN = f"""WITH RECURSIVE {Z}, h AS (SELECT k, y, x FROM z WHERE z > 1.0),
g AS (SELECT k, y, x, y * 8 + x AS label FROM h UNION SELECT h.k, h.y, h.x, g.label FROM g JOIN h ON h.k = g.k AND abs(h.y - g.y) <= 1 AND abs(h.x - g.x) <= 1),
mild AS (SELECT k, y, x, CAST(min(label) AS INTEGER) AS label FROM g GROUP BY k, y, x)"""


@query(f"{GROWN} SELECT * FROM mild SEMI JOIN (SELECT DISTINCT m.k, m.label FROM mild m JOIN z ON z.k = m.k AND z.y = m.y AND z.x = m.x WHERE z.z > 2.5) s USING (k, label)")
def region_growing(spark, sf_dir):
    z = pixels.z_scores(px(spark, sf_dir))
    return regions.grown(regions.components(pixels.above(z, 1.0)), pixels.above(z, 2.5))


@query(f"""{GROWN}, j AS (SELECT k, y, x, y * 8 + x AS label FROM z WHERE z > 2.0 UNION SELECT q.k, q.y, q.x, j.label FROM j JOIN z q ON q.k = j.k AND abs(q.y - j.y) <= 1 AND abs(q.x - j.x) <= 1 WHERE q.z > 2.0),
c AS (SELECT k, y, x, CAST(min(label) AS INTEGER) AS label FROM j GROUP BY k, y, x)
SELECT k, c.label, mild.label AS parent, count(*) AS area FROM c JOIN mild USING (k, y, x) GROUP BY ALL""")
def region_hierarchy(spark, sf_dir):
    z = pixels.z_scores(px(spark, sf_dir))
    return regions.hierarchy(regions.components(pixels.above(z, 1.0)), regions.components(pixels.above(z, 2.0)))


# --- information ---------------------------------------------------------------------------------------------------


@query(f"WITH {Z} SELECT y, x, {R('avg(CASE WHEN z > 1 THEN 1.0::DOUBLE ELSE 0 END)', 'p')} FROM z GROUP BY y, x")
def activation_prob(spark, sf_dir):
    return rounded(information.activation(pixels.z_scores(px(spark, sf_dir)).withColumn("active", F.coalesce(F.col("z") > 1, F.lit(False))), ["y", "x"]), "p")


@query(f"""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, {R('-sum(p * log2(p))', 'bits')} FROM t GROUP BY user_id""")
def entropy(spark, sf_dir):
    return rounded(information.entropy(events(spark, sf_dir), ["user_id"], "event_type"), "bits")


@query(f"""WITH c AS (SELECT event_type AS a, user_id % 7 AS b, count(*)::DOUBLE AS c FROM events GROUP BY ALL),
t AS (SELECT c, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb, sum(c) OVER () AS n FROM c) SELECT {R('sum(c / n * log2(c * n / (ca * cb)))', 'bits')} FROM t""")
def mutual_information(spark, sf_dir):
    return rounded(information.mutual_information(events(spark, sf_dir).withColumn("b", F.col("user_id") % 7), "event_type", "b"), "bits")


PAIRS = f"""WITH {Z}, h AS (SELECT k, y * 8 + x AS u FROM z WHERE z > 1.5), n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), s AS (SELECT u, count(*) AS c FROM h GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM h a JOIN h b ON a.k = b.k AND a.u < b.u GROUP BY ALL)"""


def hot_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.above(pixels.z_scores(px(spark, sf_dir))).select("k", (F.col("y") * 8 + F.col("x")).alias("u"), "y", "x")


@query(f"{PAIRS} SELECT a, b, {R('p.c / n', 'p')}, {R('CASE WHEN p.c >= n THEN 1 ELSE ln(p.c * n / (x.c * y.c)) / nullif(-ln(p.c / n), 0) END', 'npmi')} FROM p JOIN s x ON x.u = a JOIN s y ON y.u = b, n")
def npmi_edges(spark, sf_dir):
    return rounded(information.npmi(hot_units(spark, sf_dir), "u", "k", frames(spark, sf_dir).count(), information.BOX), "p", "npmi")


@query(f"{PAIRS} SELECT a, b, {R('p.c / x.c::DOUBLE', 'p_b_given_a')} FROM p JOIN s x ON x.u = a")
def conditional_activation(spark, sf_dir):
    return rounded(information.conditional(hot_units(spark, sf_dir), "u", "k", information.BOX), "p_b_given_a")


@query(f"{PAIRS} SELECT unit, count(*) AS degree FROM (SELECT a AS unit FROM p UNION ALL SELECT b FROM p) GROUP BY unit")
def network_degrees(spark, sf_dir):
    return information.degrees(information.pair_counts(hot_units(spark, sf_dir), "u", "k", information.BOX))


@query("SELECT event_type, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 120 THEN 13 ELSE floor(value / 10) + 1 END AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def activity_histogram(spark, sf_dir):
    return information.histogram(events(spark, sf_dir), ["event_type"], "value", 0.0, 120.0, 12)


@query(f"""WITH h AS (SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) // 3600 AS BIGINT) AS h, avg(value) AS v FROM events GROUP BY ALL)
SELECT lag, {R('corr(a.v, b.v)', 'r')}, count(*) AS n FROM h a JOIN (VALUES (0), (1), (2), (3)) AS l(lag) ON a.event_type = 'view' JOIN h b ON b.event_type = 'click' AND b.h = a.h + lag GROUP BY lag""")
def lagged_correlation(spark, sf_dir):
    hourly = events(spark, sf_dir).groupBy("event_type", F.floor(F.unix_timestamp(F.date_trunc("HOUR", F.col("ts").cast("timestamp"))) / 3600).alias("h")).agg(F.avg("value").alias("v"))
    a, b = (hourly.where(F.col("event_type") == t) for t in ("view", "click"))
    return rounded(information.lagged_correlation(a, b, "h", "v", [0, 1, 2, 3]), "r")


# --- kernels and models --------------------------------------------------------------------------------------------


@query()
def phase_correlation(spark, sf_dir):
    f = frames(spark, sf_dir)
    image = pixels.mean_image(long_form(f)).agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "mean"))), lambda c: c["mean"]).alias("pixels"))
    return rounded(kernels.supervised(kernels.phase_correlation(f, image)), "dy", "dx", "peak")


@query()
def align_resample(spark, sf_dir):
    f = frames(spark, sf_dir)
    moves = phase_correlation(spark, sf_dir).select("k", "dy", "dx")
    return rounded(long_form(kernels.resample(f.join(moves, "k"))), "f")


@query()
def radon_orientation(spark, sf_dir):
    return kernels.orientation(frames(spark, sf_dir))


@query()
def block_bitrate(spark, sf_dir):
    return kernels.bitrates(table(spark, sf_dir, "documents"), "doc_id")


@query()
def gmm_activation(spark, sf_dir):
    e = events(spark, sf_dir)
    shapes = sequence.moving_slope(e, ["user_id"], "event_id", "value").join(sequence.moving_shape(e, ["user_id"], "event_id", "value"), ["user_id", "event_id"])
    return kernels.mixture(shapes, ["slope", "skew", "kurt"]).select("user_id", "event_id", "component", r6("probability").alias("probability"))


@query()
def pca_traces(spark, sf_dir):
    return kernels.principal_traces(frames(spark, sf_dir)).select("k", F.transform("trace", lambda v: F.round(v, 6)).alias("trace"))


# --- search --------------------------------------------------------------------------------------------------------


def hits(term: str) -> str:
    n = lambda c: f"len(regexp_extract_all(coalesce({c}, ''), '(?i){term}'))"
    return f"(20 * {n('title')} + 20 * {n('text')} + 10 * {n('tags')} + CASE WHEN regexp_matches(url, '(?i){term}') THEN 20 ELSE 0 END)"


def seen(term: str) -> str:
    return f"(regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, '') || chr(10) || coalesce(tags, ''), '(?i){term}'))"


def ranked(spark: SparkSession, sf_dir: str, said: str, lang: str | None = None) -> DataFrame:
    return search.matches(pages(spark, sf_dir), said, lang).select("pos", "score", "url")


@query(f"WITH {PAGES} SELECT pos, ({hits('tion')} + {hits('ing')})::BIGINT AS score, url FROM pg WHERE score <> 0")
def search_terms(spark, sf_dir):
    return ranked(spark, sf_dir, "the tion  ing")


@query(f"WITH {PAGES} SELECT pos, {hits('on the')}::BIGINT AS score, url FROM pg WHERE score <> 0")
def search_phrase(spark, sf_dir):
    return ranked(spark, sf_dir, '"on the"')


@query(f"WITH {PAGES} SELECT pos, (CASE WHEN {seen('ment')} THEN 0 ELSE {hits('tion')} END + {hits('ing')})::BIGINT AS score, url FROM pg WHERE score <> 0")
def search_negation(spark, sf_dir):
    return ranked(spark, sf_dir, "tion -ment ing")


@query(f"WITH {PAGES} SELECT pos, {hits('tion')}::BIGINT AS score, title FROM pg WHERE score <> 0 ORDER BY score DESC, pos LIMIT 10 OFFSET 10")
def search_page(spark, sf_dir):
    return search.matches(pages(spark, sf_dir), "tion").select("pos", "score", "title").orderBy(F.desc("score"), "pos").offset(10).limit(10)


@query(f"""WITH {PAGES}, h AS (SELECT pos, url, title, {hits('tion')}::BIGINT AS score, regexp_replace(text, '(?i)(tion)', '<span class="SearchResults__highlight">\\1</span>') AS t FROM pg),
s AS (SELECT *, trim(array_to_string(string_split(t, ' ')[1:25], ' ')) AS c FROM h WHERE score <> 0)
SELECT score, title, CASE WHEN c = '' THEN '' WHEN ends_with(c, '.') THEN c ELSE c || ' ...' END AS snippet, url FROM s ORDER BY score DESC, pos LIMIT 10""")
def search_snippet(spark, sf_dir):
    return search.search(pages(spark, sf_dir), "tion")


@query(f"WITH {PAGES}, n AS (SELECT count(*) AS n FROM pg WHERE {hits('tion')} <> 0) SELECT n, CASE WHEN n > 10 THEN range(4, least(6, CAST(ceil(n / 10.0) AS INTEGER)) + 1)::INTEGER[] ELSE [] END AS links FROM n")
def search_count_links(spark, sf_dir):
    counted = search.matches(pages(spark, sf_dir), "tion").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("links", F.when(F.col("n") > 10, fn.page_links(F.col("n"), F.lit(40))).otherwise(F.array().cast("array<int>")))


@query("SELECT page_id, regexp_replace(lower(url), '^http://', '') AS shown FROM pages")
def url_display(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.url_display(F.col("url")).alias("shown"))


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://[^/]*/(.*)$', 1) LIKE 'en/%'")
def language_filter(spark, sf_dir):
    path = F.regexp_extract("url", "^https?://[^/]*/(.*)$", 1)
    return table(spark, sf_dir, "pages").where(F.startswith(path, F.lit("en/"))).select("page_id", "url")


@query("""WITH l AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]*)/', 1) AS host, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)
SELECT host, target FROM l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE regexp_extract(p.url, '^https?://([^/]*)/', 1) = l.host AND regexp_extract(p.url, '^https?://[^/]*/(.*)$', 1) = l.target)""")
def dangling_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]*)/", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]*/(.*)$", 1).alias("path"), "html")
    links = p.select("host", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target")).distinct()
    return links.join(p.select("host", F.col("path").alias("target")), ["host", "target"], "left_anti")


# --- documents -----------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(text) AS digest, octet_length(encode(text)) AS n_bytes, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_words FROM t""")
def doc_merge(spark, sf_dir):
    return documents.merge(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", F.md5("text").alias("digest"), "n_bytes", "n_words")


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_words FROM documents")
def word_byte_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *documents.sizes(F.col("text")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'html' WHEN event_id % 2 = 0 THEN 'docx' ELSE 'pdf' END AS format, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'plain' END AS template FROM events""")
def config_merge(spark, sf_dir):
    text = lambda c: F.create_map(F.lit("format"), F.lit(c))
    default = F.create_map(F.lit("format"), F.lit("pdf"), F.lit("template"), F.lit("plain"))
    document = F.when(F.col("event_id") % 2 == 0, text("docx"))
    given = F.when(F.col("event_id") % 3 == 0, text("html"))
    own = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("template"), F.col("event_type")))
    return events(spark, sf_dir).select("event_id", documents.layered(default, document, given, own).alias("m")).select("event_id", F.col("m")["format"].alias("format"), F.col("m")["template"].alias("template"))


@query("""WITH t AS (SELECT conv_id, turn, '==' || upper(role)[1:2] || ' ' || regexp_replace(substr(coalesce(text, ''), 1, 20), '=', '', 'g') || '== end' AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(t, '==([A-Z]{2}) ([^=]*)==', '<span class="comment" data-by="\\1">\\2</span>', 'g') AS t FROM t""")
def comment_rewrite(spark, sf_dir):
    t = F.concat(F.lit("=="), F.substring(F.upper("role"), 1, 2), F.lit(" "), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 20), "=", ""), F.lit("== end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.rewrite_comments(t).alias("t"))


@query("SELECT doc_id, replace(replace(text, '<', '&lt;'), '>', '&gt;') AS text FROM documents WHERE regexp_matches(text, '[<>]')")
def escape_markup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[<>]"))
    return d.select("doc_id", fn.escape_html(F.col("text")).alias("text"))


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS event_type, CASE WHEN count(DISTINCT event_type) > 1 THEN count(DISTINCT event_type) || ' candidates' END AS problem FROM events GROUP BY user_id""")
def unique_choice(spark, sf_dir):
    return documents.only(events(spark, sf_dir).select("user_id", "event_type").distinct(), ["user_id"], "event_type")


@query("""SELECT event_id, CASE WHEN value < 50 THEN '-' ELSE '' END || lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown
FROM (SELECT event_id, value, abs(event_id * CASE WHEN value < 50 THEN -7 ELSE 7 END) AS s FROM events WHERE event_id > 0)""")
def durations(spark, sf_dir):
    return events(spark, sf_dir).where("event_id > 0").select("event_id", fn.duration(F.col("event_id") * F.when(F.col("value") < 50, -7).otherwise(7)).alias("shown"))


@query("""WITH t AS (SELECT conv_id, turn, '==' || upper(role)[1:2] || ' ' || regexp_replace(coalesce(text, ''), '=', '', 'g') || '== end' AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(t, '==([A-Z]{2}) ([^=]*)==', '<span class="comment" data-by="\\1">\\2</span>', 'g')) AS html, md5(regexp_replace(t, '==([A-Z]{2}) ([^=]*)==', '\\\\todo[author=\\1]{\\2}', 'g')) AS tex FROM t""")
def comment_rewrite_whole(spark, sf_dir):
    t = F.concat(F.lit("=="), F.substring(F.upper("role"), 1, 2), F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), "=", ""), F.lit("== end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(fn.rewrite_comments(t)).alias("html"), F.md5(fn.rewrite_comments(t, "tex")).alias("tex"))


@query("SELECT page_id, md5(replace(html, '</script>', '__SCRIPT_END__')) AS hidden, md5(html) AS shown FROM pages")
def script_end(spark, sf_dir):
    hidden = fn.hide_script_end(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(hidden).alias("hidden"), F.md5(fn.show_script_end(hidden)).alias("shown"))


@query("""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::DOUBLE AS page, CASE WHEN url LIKE '%ref=x%' THEN 'text' END AS ref, CASE WHEN url LIKE '%page=%' THEN 'number' END AS kind FROM pages""")
def query_parameters(spark, sf_dir):
    m = fn.typed_query_map(F.regexp_extract("url", r"\?([^#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", F.col("m")["page"]["number"].alias("page"), F.col("m")["ref"]["kind"].alias("ref"), F.col("m")["page"]["kind"].alias("kind"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS t FROM pages)
SELECT page_id, CASE WHEN t <> '' AND NOT regexp_full_match(t, '[0-9]+') THEN regexp_replace(t, '[^a-zA-Z0-9_:.-]', '', 'g') END AS name, count(*) AS n FROM l GROUP BY ALL""")
def named_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("t"))
    return links.groupBy("page_id", fn.slide_link(F.concat(F.lit("#/"), "t"))["name"].alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, 'out/' || event_type || '/f_' || event_id || '.pdf' AS path, 'f_' || event_id || '.pdf' AS base, '.pdf' AS ext FROM events""")
def path_parts(spark, sf_dir):
    name = F.concat(F.lit("f_"), F.col("event_id").cast("string"), F.lit(".png"))
    path = fn.png_to_pdf(fn.join_path(F.lit("out/"), F.col("event_type"), F.lit(""), name))
    return events(spark, sf_dir).select("event_id", path.alias("path")).select("event_id", "path", fn.base_name(F.col("path")).alias("base"), fn.extension(F.col("path")).alias("ext"))


@query("SELECT event_id, strftime(ts, '%I:%M %p') AS shown FROM events")
def clock_text(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.clock(F.col("ts")).alias("shown"))


@query("""SELECT lang, count(*) AS n, CASE lang WHEN 'de' THEN count(*) || ' Ergebnisse' WHEN 'fr' THEN count(*) || ' résultats' ELSE count(*) || ' results' END AS shown FROM documents GROUP BY lang""")
def localised_count(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("shown", fn.message({"en": "!count results", "de": "!count Ergebnisse", "fr": "!count résultats"}, F.col("lang"), "en", count=F.col("n")))


@query(f"""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS past, count(*) OVER (PARTITION BY conv_id) AS total FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id, turn, past, total, {R("CASE WHEN total > 1 THEN least(1, (past + CASE WHEN turn % 4 < 3 THEN turn % 4 / 3 * 0.9 ELSE 0 END) / (total - 1)) ELSE 1 END", 'done')} FROM t""")
def slide_progress_fragments(spark, sf_dir):
    slides = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return rounded(sequence.progress(slides, ["conv_id"], "turn", F.col("turn") % 4, F.lit(3)), "done")


@query("""SELECT conv_id, turn, md5(role || chr(10) || chr(9) || 'more' || chr(10) || role) AS tabs, md5(role || chr(10) || '  more') AS blanks FROM conversations""")
def slide_indent(spark, sf_dir):
    tabs = F.concat_ws("\n", F.concat(F.lit("\t\t"), "role"), F.lit("\t\t\tmore"), F.concat(F.lit("\t\t"), "role"))
    blanks = F.concat(F.lit("    "), "role", F.lit("\n      more"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(fn.deindent_slide(tabs)).alias("tabs"), F.md5(fn.deindent_slide(blanks)).alias("blanks"))


@query("""SELECT event_id, right('00' || (event_id % 250), 2) AS two, event_id % 97 AS number, lower(event_type) || '_' || event_id || '.png' AS file, event_type IN ('view', 'click') AS known, (event_id % 256) * 299 / 1000.0::DOUBLE + 0.114 AS bright, event_type || ' note' AS content, 'n' || event_id AS notes FROM events""")
def text_scalars(spark, sf_dir):
    i = F.col("event_id")
    notes = fn.slide_notes(F.concat("event_type", F.lit(" note\nNote: n"), i.cast("string")))
    t = events(spark, sf_dir).select("event_id", "event_type", fn.last_two(i % 250).alias("two"), fn.lead_int(F.concat(F.lit(" "), (i % 97).cast("string"), F.lit("px")), -1).cast("long").alias("number"), fn.clean_file_name(F.concat(F.lower("event_type"), F.lit(" -"), F.lit("_"), i.cast("string"), F.lit(".PNG"))).alias("file"), fn.brightness(F.concat(F.lit("rgb("), (i % 256).cast("string"), F.lit(", 0, 1)"))).alias("bright"), notes.alias("s"))
    return t.select("event_id", "two", "number", "file", F.col("event_type").isin("view", "click").alias("known"), "bright", F.rtrim(F.regexp_replace("s.content", "\n$", "")).alias("content"), "s.notes")


# --- streams -------------------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT event_type, value AS f, value - avg(value) OVER (PARTITION BY event_type) AS d FROM events)
SELECT event_type, count(*)::DOUBLE AS n, {R('avg(f)', 'm1')}, {R('sum(d * d) / count(*)', 'v2')}, {R('sum(d * d * d) * sqrt(count(*)) / nullif(pow(sum(d * d), 1.5), 0)', 'skew')}, {R('min(f)', 'lo')}, {R('max(f)', 'hi')} FROM t GROUP BY event_type""")
def stream_moments(spark, sf_dir):
    out = streams.stream_moments(streams.events(spark, sf_dir), ["event_type"], "value")
    skew = F.try_divide(F.col("m3") * F.sqrt("n"), F.pow("m2", F.lit(1.5)))
    return out.select("event_type", "n", r6("m1").alias("m1"), r6(F.col("m2") / F.col("n")).alias("v2"), r6(skew).alias("skew"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"""WITH t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events)
SELECT user_id AS "by", r // 16 AS chunk, count(*) AS n, {R('arg_min(value, r)', 'first')}, {R('arg_max(value, r)', 'last')}, {R('avg(value)', 'mean')} FROM t GROUP BY user_id, r // 16 HAVING count(*) = 16""")
def stream_chunks(spark, sf_dir):
    return rounded(streams.drained(streams.chunks(streams.events(spark, sf_dir), "user_id", "event_id", "value")), "first", "last", "mean")


@query(f"""WITH t AS (SELECT user_id AS "by", event_id AS o, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events) SELECT "by", o, {R('c', 'change')} FROM t WHERE abs(c) > 60""")
def stream_changes(spark, sf_dir):
    return rounded(streams.drained(streams.changes(streams.events(spark, sf_dir), "user_id", "event_id", "value", 60.0)), "change")


@query(f"""WITH t AS (SELECT time_bucket(INTERVAL '1 day', ts) AS low, event_type, count(*) AS n, {R('sum(value)', 'total')} FROM events GROUP BY ALL)
SELECT strftime(low, '%Y-%m-%d %H:%M:%S') AS low, event_type, n, total FROM t WHERE low + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_windows(spark, sf_dir):
    got = streams.drained(streams.windows(streams.events(spark, sf_dir), "ts", "1 day", "10 minutes", ["event_type"], "value"))
    return rounded(got.select(F.date_format("low", "yyyy-MM-dd HH:mm:ss").alias("low"), "event_type", "n", "total"), "total")


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT user_id, event_id, r, value AS y FROM t WHERE r = 1 UNION ALL SELECT t.user_id, t.event_id, t.r, 0.3 * t.value + 0.7 * s.y FROM s JOIN t ON t.user_id = s.user_id AND t.r = s.r + 1)
SELECT user_id AS "by", event_id AS o, round(y, 9) + 0.0 AS y FROM s""")
def stream_lowpass(spark, sf_dir):
    out = streams.drained(streams.lowpass(streams.events(spark, sf_dir), "user_id", "event_id", "value"))
    return out.withColumn("y", F.round("y", 9) + 0.0)


@query("""SELECT a.user_id, a.event_id AS frame, b.event_id AS trial FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '2 hours'
WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def stream_sync(spark, sf_dir):
    e = streams.events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    met = streams.synchronised(e.where("event_type = 'view'"), streams.events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type").where("event_type = 'click'"), "user_id", "ts", "2 HOURS")
    return streams.drained(met.select("user_id", F.col("event_id").alias("frame"), F.col("event_id_r").alias("trial")))


# --- relational coverage: what Spark supplies and the studied source has no part in ---------------------------------


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def rel_semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(f"""SELECT r_name, n_name, c_mktsegment, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, count(DISTINCT c_custkey) AS customers, CAST(grouping_id(r_name, n_name, c_mktsegment) AS BIGINT) AS gid
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rel_rollup(spark, sf_dir):
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.rollup("r_name", "n_name", "c_mktsegment").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.countDistinct("c_custkey").alias("customers"), F.grouping_id().cast("long").alias("gid"))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {R('avg(l_quantity)', 'quantity')} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("quantity"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def rel_set_operations(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).subtract(n.where("n_regionkey = 0").select("n_nationkey"))


@query("""SELECT * FROM (SELECT user_id, event_id, rank() OVER w AS rnk, CAST(ntile(4) OVER w AS INTEGER) AS quart, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE rnk <= 3""")
def rel_ranking(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    t = events(spark, sf_dir).select("user_id", "event_id", F.rank().over(w).cast("long").alias("rnk"), F.ntile(4).over(w).alias("quart"), F.lead("event_id").over(w).alias("next"))
    return t.where("rnk <= 3")


@query(f"""WITH w AS (SELECT ts, value, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS low FROM events)
SELECT strftime(low, '%Y-%m-%d %H:%M:%S') AS low, count(*) AS n, {R('avg(value)', 'mean')} FROM w GROUP BY low""")
def rel_sliding_windows(spark, sf_dir):
    t = events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))
    return t.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("low"), "n", "mean")


@query("""WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM t)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS low, count(*) AS n FROM s GROUP BY user_id, g""")
def rel_sessions(spark, sf_dir):
    t = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("low"), "n")


@query(f"""SELECT l_orderkey, {R('sum(l_extendedprice * (1 - l_discount))', 'revenue')} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > p_retailprice AND p_size < 10 GROUP BY l_orderkey""")
def rel_theta_join(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_extendedprice") > F.col("p_retailprice"))).where("p_size < 10")
    return t.groupBy("l_orderkey").agg(r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))

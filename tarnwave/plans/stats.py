"""Queries of frame statistics, regions, grouped statistics, slices and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwave.functions import scalars
from tarnwave.operators import frames, order, symbols, thresholds, windows
from tarnwave.operators.symbols import PERIOD
from tarnwave.plans.base import BITS, DEV, NEAREST, THR, Book, T, r6
from tarnwave.plans.base import windows as win
from tarnwave.plans.core import ISLANDS, LIT, binary, thresholded
from tarnwave.sources import views
from tarnwave.sources.stage import staged
from tarnwave.sources.views import PIXELS, SIGNAL, TRUTH

book = Book()
query = book.query
HEAD = f"WITH {SIGNAL}, {THR}, {DEV}"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# slices of a signal


@query("s3_range_scan", f"WITH {SIGNAL} SELECT lamp, frame, v FROM signal WHERE frame BETWEEN 100 AND 199")
def s3(spark, sf):
    return views.signal(spark, sf).filter(F.col("frame").between(100, 199))


@query("s4_strided_sample", f"WITH {SIGNAL}, z AS (SELECT lamp, greatest(1, count(*) // 60) AS stride, (count(*) + 59) // 60 AS up FROM signal GROUP BY lamp) SELECT lamp, frame, v, frame % up = 0 AS in_ceil FROM signal JOIN z USING (lamp) WHERE frame % stride = 0 AND frame // stride < 60")
def s4(spark, sf):
    rows = order.with_stats(views.signal(spark, sf), ["lamp"], n=F.count("*"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / 60))
    rows = rows.filter((F.col("frame") % stride == 0) & (F.floor(F.col("frame") / stride) < 60))
    return rows.select("lamp", "frame", "v", (F.col("frame") % F.ceil(F.col("n") / 60) == 0).alias("in_ceil"))


@query("s6_rate_parser", """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '30000/1001' WHEN 1 THEN CAST(user_id AS VARCHAR) || '/' || CAST(event_id % 3 AS VARCHAR) WHEN 2 THEN CAST(user_id AS VARCHAR) WHEN 3 THEN 'N/A' ELSE '25/' END AS rate FROM events)
    SELECT event_id, round(CASE len(p) WHEN 1 THEN TRY_CAST(p[1] AS DOUBLE) WHEN 2 THEN TRY_CAST(p[1] AS DOUBLE) / nullif(TRY_CAST(p[2] AS DOUBLE), 0) END, 6) AS fps FROM (SELECT event_id, string_split(rate, '/') AS p FROM r)""")
def s6(spark, sf):
    e = views.read(spark, sf, "events").select("event_id", "user_id")
    i = F.col("event_id") % 5
    user = F.col("user_id").cast("string")
    text = F.when(i == 0, "30000/1001").when(i == 1, F.concat(user, F.lit("/"), (F.col("event_id") % 3).cast("string"))).when(i == 2, user).when(i == 3, "N/A").otherwise("25/")
    return e.select("event_id", r6(scalars.rate(text), "fps"))


@query("s7_first_seconds", "SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE ts < t0 + INTERVAL 7 DAY GROUP BY user_id")
def s7(spark, sf):
    e = order.with_stats(views.read(spark, sf, "events"), ["user_id"], t0=F.min("ts"))
    return e.filter(F.col("ts") < F.col("t0") + F.expr("INTERVAL 7 DAYS")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("s9_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s9(spark, sf):
    return views.read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s11_truth_join", """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"bits":"' || quality || toxic || '"}' WHEN 1 THEN quality || toxic WHEN 2 THEN '{"bits":' ELSE '' END AS text FROM labels), p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN json_extract_string(text, '$.bits') WHEN doc_id % 4 = 1 THEN text END AS bits, doc_id % 4 >= 2 AS failed FROM t)
    SELECT doc_id, p.doc_id IS NOT NULL AS has_truth, bits, coalesce(failed, false) AS failed FROM documents d LEFT JOIN p USING (doc_id)""".replace("p.doc_id IS NOT NULL", "failed IS NOT NULL"))
def s11(spark, sf):
    """Documents with their truth where there is one: json first, then plain bits; what is neither is told as failed."""
    text = F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    i = F.col("doc_id") % 4
    said = F.when(i == 0, F.concat(F.lit('{"bits":"'), text, F.lit('"}'))).when(i == 1, text).when(i == 2, '{"bits":').otherwise("")
    t = views.read(spark, sf, "labels").select("doc_id", scalars.truth_bits(said).alias("bits"))
    d = views.read(spark, sf, "documents").select("doc_id").join(t.withColumn("failed", F.col("bits").isNull()), "doc_id", "left")
    return d.select("doc_id", F.col("failed").isNotNull().alias("has_truth"), "bits", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("p3_clear_levels", f"WITH {SIGNAL}, z AS (SELECT lamp, min(v) AS lo, max(v) AS hi FROM signal GROUP BY lamp) SELECT lamp, round(avg(CAST(v > (lo + hi) / 2 + 0.25 * (hi - lo) AS INT)), 6) AS clear_on, round(avg(CAST(v < (lo + hi) / 2 - 0.25 * (hi - lo) AS INT)), 6) AS clear_off, round(avg(CAST(abs(v - (lo + hi) / 2) <= 0.25 * (hi - lo) AS INT)), 6) AS between FROM signal JOIN z USING (lamp) GROUP BY lamp")
def p3(spark, sf):
    rows = order.with_stats(views.signal(spark, sf), ["lamp"], lo=F.min("v"), hi=F.max("v"))
    mid, quarter = (F.col("lo") + F.col("hi")) / 2, 0.25 * (F.col("hi") - F.col("lo"))
    share = lambda c, n: r6(F.avg(c.cast("double")), n)
    return rows.groupBy("lamp").agg(share(F.col("v") > mid + quarter, "clear_on"), share(F.col("v") < mid - quarter, "clear_off"), share(F.abs(F.col("v") - mid) <= quarter, "between"))


@query("p5_split", f"WITH {SIGNAL}, z AS (SELECT lamp, CAST(trunc(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS k FROM signal GROUP BY lamp) SELECT lamp, CASE WHEN frame < k THEN 'dev' ELSE 'test' END AS part, count(*) AS n, round(avg(v), 6) AS mean FROM signal JOIN z USING (lamp) GROUP BY ALL")
def p5(spark, sf):
    rows = order.with_stats(views.signal(spark, sf), ["lamp"], k=(F.count("*") * F.lit(0.3)).cast("long"))
    return rows.groupBy("lamp", F.when(F.col("frame") < F.col("k"), "dev").otherwise("test").alias("part")).agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


@query("p6_trim_slice", f"{HEAD}, {LIT}, z AS (SELECT lamp, min(frame) + 5 AS a, max(frame) - 5 AS b FROM bin WHERE bit = 1 GROUP BY lamp) SELECT lamp, frame - a AS frame, v FROM signal JOIN z USING (lamp) WHERE frame BETWEEN a AND b")
def p6(spark, sf):
    rows = binary(spark, sf)
    ends = rows.filter("bit = 1").groupBy("lamp").agg((F.min("frame") + 5).alias("a"), (F.max("frame") - 5).alias("b"))
    return rows.join(ends, "lamp").filter(F.col("frame").between(F.col("a"), F.col("b"))).select("lamp", (F.col("frame") - F.col("a")).alias("frame"), "v")


@query("p8_normal_deviation", f"{HEAD} SELECT lamp, frame, round(d / span, 6) AS dev, round((v - min(v) OVER (PARTITION BY lamp)) / span * 255, 6) AS scaled FROM dev")
def p8(spark, sf):
    rows = order.with_stats(thresholded(spark, sf), ["lamp"], lo=F.min("v"))
    return rows.select("lamp", "frame", r6((F.col("v") - F.col("thr")) / F.col("span"), "dev"), r6((F.col("v") - F.col("lo")) / F.col("span") * 255, "scaled"))


@query("p9_phase_fraction", f"WITH {SIGNAL}, {THR}, {win(1)} SELECT lamp, k, round((0.7::DOUBLE + k * {T}) % 1.0::DOUBLE, 6) AS frac FROM win")
def p9(spark, sf):
    sizes = views.signal(spark, sf).groupBy("lamp").agg(F.count("*").alias("n"))
    return symbols.bit_windows(sizes).select("lamp", "k", r6(scalars.phase_of(F.lit(0.7), F.col("k"), PERIOD), "frac"))


# frames of pixels

ARR = "fr AS (SELECT vec_id AS frame, label, CAST(embedding AS DOUBLE[]) AS px FROM embeddings)"


@query("a1_frame_maxima", f"WITH {ARR} SELECT frame, list_max(px) AS top FROM fr")
def a1(spark, sf):
    return views.frames(spark, sf).select("frame", F.array_max("pixels").alias("top"))


@query("a2_bright_mean", f"WITH {ARR} SELECT frame, round(list_avg(list_reverse_sort(px)[1:16]), 6) AS bright, round(list_avg(list_reverse_sort(px)[1:7]), 6) AS bright_ceil FROM fr")
def a2(spark, sf):
    return views.frames(spark, sf).select("frame", r6(frames.bright_mean(F.col("pixels"), 0.25), "bright"), r6(frames.bright_mean(F.col("pixels"), 0.1, ceil=True), "bright_ceil"))


@query("a4_eight_statistics", f"WITH {PIXELS} SELECT frame, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max, round(quantile_cont(v, 0.9), 6) AS p90, round(list_avg(list_reverse_sort(list(v))[1:6]), 6) AS top10, round(list_avg(list_reverse_sort(list(v))[1:16]), 6) AS top25, round(list_avg(list_reverse_sort(list(v))[1:32]), 6) AS top50, count(*) FILTER (v > 0.1::DOUBLE) AS bright FROM pixels GROUP BY frame")
def a4(spark, sf):
    px = F.col("pixels")
    return views.frames(spark, sf).select("frame", *[r6(frames.frame_statistic(px, n), n) for n in frames.STATISTICS], frames.above(px, F.lit(0.1)).alias("bright"))


SWITCHED = ("mean", "max", "p90")


@query("a3_switched_statistic", f"WITH {PIXELS} SELECT CAST(label AS BIGINT) AS label, CASE CAST(label AS BIGINT) % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'max' ELSE 'p90' END AS statistic, count(*) AS n, round(avg(s), 6) AS level FROM (SELECT frame, label, CASE CAST(label AS BIGINT) % 3 WHEN 0 THEN avg(v) WHEN 1 THEN max(v) ELSE quantile_cont(v, 0.9) END AS s FROM pixels GROUP BY frame, label) GROUP BY label")
def a3(spark, sf):
    """Each label's frames under the statistic that is named for it."""
    f = views.frames(spark, sf).withColumn("label", F.col("label").cast("long"))
    parts = [f.filter(F.col("label") % 3 == i).select("label", F.lit(n).alias("statistic"), frames.frame_statistic(F.col("pixels"), n).alias("s")) for i, n in enumerate(SWITCHED)]
    return union(parts).groupBy("label", "statistic").agg(F.count("*").alias("n"), r6(F.avg("s"), "level"))


@query("a13_bright_centroid", f"WITH {PIXELS}, z AS (SELECT frame, quantile_cont(v, 0.9) AS t FROM pixels GROUP BY frame) SELECT frame, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM pixels JOIN z USING (frame) WHERE v > t GROUP BY frame")
def a13(spark, sf):
    rows = views.frames(spark, sf).select("frame", frames.quantile(F.col("pixels"), 0.9).alias("t"), F.posexplode("pixels").alias("pos", "v")).filter("v > t")
    return rows.groupBy("frame").agg(r6(F.avg(F.col("pos") % 8), "cx"), r6(F.avg(F.floor(F.col("pos") / 8)), "cy"), F.count("*").alias("n"))


@query("a14_variance_map", f"WITH {PIXELS}, m AS (SELECT x, y, var_pop(v) AS var FROM pixels GROUP BY x, y) SELECT x, y, round(var, 6) AS var, round(var / max(var) OVER (), 6) AS share, round(max(var) OVER () / greatest(median(var) OVER (), 0.001), 4) AS ratio FROM m")
def a14(spark, sf):
    """The variance of each pixel, and the largest against a typical one (the median, 0.001 at least)."""
    m = staged(frames.variance_map(views.pixels(spark, sf)))
    top = m.agg(F.max("var").alias("top"), F.percentile("var", F.lit(0.5)).alias("mid"))
    return m.crossJoin(F.broadcast(top)).select("x", "y", r6("var"), r6(F.col("var") / F.col("top"), "share"), F.round(F.col("top") / F.greatest("mid", F.lit(0.001)), 4).alias("ratio"))


@query("a26_frame_roi_stats", f"WITH {PIXELS} SELECT frame, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std, round(avg(CAST(v >= 0.2::DOUBLE AS INT)), 6) AS full_share FROM pixels GROUP BY frame")
def a26(spark, sf):
    px = F.col("pixels")
    return views.frames(spark, sf).select("frame", r6(frames.mean(px), "mean"), r6(F.array_max(px), "max"), r6(frames.spread(px), "std"), r6(F.size(F.filter(px, lambda x: x >= 0.2)) / F.size(px), "full_share"))


@query("a27_scan_summary", f"WITH {PIXELS}, f AS (SELECT frame, avg(v) AS mean, max(v) AS top, avg(CAST(v >= 0.3::DOUBLE AS INT)) AS sat FROM pixels GROUP BY frame) SELECT round(quantile_cont(top, 0.99), 6) AS peak, count(*) FILTER (top < 0.2) AS black_frames, round(avg(sat), 6) AS saturated, round(avg(mean), 6) AS level FROM f")
def a27(spark, sf):
    px = F.col("pixels")
    f = views.frames(spark, sf).select(frames.mean(px).alias("mean"), F.array_max(px).alias("top"), (F.size(F.filter(px, lambda x: x >= 0.3)) / F.size(px)).alias("sat"), F.lit(1).alias("one"))
    peak = thresholds.quantiles(f, ["one"], "top", peak=0.99)
    rest = f.groupBy("one").agg(F.count_if(F.col("top") < 0.2).alias("black_frames"), r6(F.avg("sat"), "saturated"), r6(F.avg("mean"), "level"))
    return peak.join(rest, "one").select(r6("peak"), "black_frames", "saturated", "level")


@query("l3_pixel_z_scores", f"WITH {PIXELS} SELECT frame, x, y, round((v - avg(v) OVER (PARTITION BY x, y)) / (stddev_pop(v) OVER (PARTITION BY x, y) + 1e-6), 5) AS z FROM pixels")
def l3(spark, sf):
    rows = order.with_stats(views.pixels(spark, sf), ["x", "y"], m=F.avg("v"), s=F.stddev_pop("v"))
    return rows.select("frame", "x", "y", F.round((F.col("v") - F.col("m")) / (F.col("s") + 1e-6), 5).alias("z"))


@query("l4_active_pixels", f"WITH {PIXELS}, m AS (SELECT x, y, var_pop(v) AS var FROM pixels GROUP BY x, y) SELECT x, y FROM m WHERE var >= (SELECT max(var) * 0.8::DOUBLE FROM m)")
def l4(spark, sf):
    m = frames.variance_map(views.pixels(spark, sf))
    return m.crossJoin(F.broadcast(m.agg((F.max("var") * 0.8).alias("need")))).filter("var >= need").select("x", "y")


@query("l2_label_boxes", f"WITH {PIXELS}, hot AS (SELECT label, x, y, avg(v) AS m FROM pixels GROUP BY ALL), top AS (SELECT label, quantile_cont(m, 0.75) AS t FROM hot GROUP BY label), b AS (SELECT label, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n_px, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM hot JOIN top USING (label) WHERE m > t GROUP BY label) SELECT label, x0, y0, w, h, n_px, cx, cy, round(n_px / CAST(w * h AS DOUBLE), 6) AS fill, row_number() OVER (ORDER BY floor(cy / 4), cx, label) AS lamp FROM b WHERE n_px / CAST(w * h AS DOUBLE) >= 0.1")
def l2(spark, sf):
    hot = views.pixels(spark, sf).groupBy("label", "x", "y").agg(F.avg("v").alias("m"))
    rows = order.with_stats(hot, ["label"], t=F.percentile("m", F.lit(0.75))).filter("m > t")
    b = rows.groupBy("label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("n_px"), r6(F.avg("x"), "cx"), r6(F.avg("y"), "cy"))
    b = b.withColumn("fill", r6(F.col("n_px") / (F.col("w") * F.col("h")), "fill")).filter("fill >= 0.1")
    # lamps of one rig: a handful of rows, so one window over all of them is no burden
    return b.withColumn("lamp", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.floor(F.col("cy") / 4), "cx", "label")).cast("long"))


@query("l5_largest_component", f"""WITH RECURSIVE {PIXELS}, m AS (SELECT x, y, var_pop(v) AS var FROM pixels GROUP BY x, y), mk AS (SELECT x, y FROM m WHERE var >= (SELECT quantile_cont(var, 0.6) FROM m)),
    reach AS (SELECT x, y, y * 1000000 + x AS label FROM mk UNION SELECT b.x, b.y, a.label FROM reach a JOIN mk b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), lab AS (SELECT x, y, min(label) AS label FROM reach GROUP BY x, y), sz AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
    SELECT x, y FROM lab WHERE label = (SELECT label FROM sz ORDER BY n DESC, label LIMIT 1)""")
def l5(spark, sf):
    m = frames.variance_map(views.pixels(spark, sf)).withColumn("one", F.lit(1))
    mask = order.with_stats(m, ["one"], need=F.percentile("var", F.lit(0.6))).filter("var >= need").select("x", "y")
    labels = frames.components(staged(mask))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return labels.join(F.broadcast(best), "label").select("x", "y")


REFLECT = "CASE WHEN {0} < 0 THEN -{0} WHEN {0} > 7 THEN 14 - {0} ELSE {0} END"


@query("l5b_brightest_spot", f"""WITH {PIXELS}, first AS (SELECT label, min(frame) AS frame FROM pixels GROUP BY label), g AS (SELECT d, exp(-d * d / (2 * 2.6 * 2.6)) / sum(exp(-d * d / (2 * 2.6 * 2.6))) OVER () AS w FROM range(-7, 8) t(d)), px AS (SELECT p.* FROM pixels p JOIN first USING (label, frame)),
    t AS (SELECT px.label, px.x, px.y, a.w * b.w AS w, {REFLECT.format('(px.x + a.d)')} AS nx, {REFLECT.format('(px.y + b.d)')} AS ny FROM px, g a, g b), s AS (SELECT t.label, t.x, t.y, round(sum(t.w * n.v), 9) AS blur FROM t JOIN px n ON n.label = t.label AND n.x = nx AND n.y = ny GROUP BY ALL)
    SELECT CAST(label AS BIGINT) AS label, x AS cx, y AS cy, greatest(x - 2, 0) AS x0, greatest(y - 2, 0) AS y0 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY blur DESC, y, x) AS i FROM s) WHERE i = 1""")
def l5b(spark, sf):
    """The brightest spot of each label's first frame after a 15 x 15 Gaussian blur (mirrored at the border), and a box from it."""
    px = views.pixels(spark, sf)
    first = order.small(px.groupBy("label").agg(F.min("frame").alias("frame")))
    return frames.brightest_spot(staged(px.join(first, ["label", "frame"])), ["label"], 8, 8).select(F.col("label").cast("long").alias("label"), "cx", "cy", F.greatest(F.col("cx") - 2, F.lit(0)).cast("long").alias("x0"), F.greatest(F.col("cy") - 2, F.lit(0)).cast("long").alias("y0"))


@query("l6_box_variants", f"WITH {PIXELS}, b AS (SELECT s, d, CAST(round_even(4 + d * 4 - 2 * s, 0) AS BIGINT) AS x0, CAST(round_even(4 - 2 * s, 0) AS BIGINT) AS y0, CAST(greatest(1, round_even(4 * s, 0)) AS BIGINT) AS w FROM (SELECT unnest([0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0]::DOUBLE[]) AS s), (SELECT unnest([-0.5, -0.25, 0.0, 0.25, 0.5]::DOUBLE[]) AS d)) SELECT s AS scale, d AS shift, count(*) AS n, round(avg(v), 6) AS mean FROM b JOIN pixels ON x >= greatest(x0, 0) AND x < x0 + w AND y >= greatest(y0, 0) AND y < y0 + w GROUP BY ALL")
def l6(spark, sf):
    grid = spark.createDataFrame([(s, d) for s in (0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0) for d in (-0.5, -0.25, 0.0, 0.25, 0.5)], "scale double, shift double")
    side = F.greatest(F.lit(1), F.rint(4 * F.col("scale")).cast("long"))
    boxes = grid.select("scale", "shift", F.rint(4 + F.col("shift") * 4 - 2 * F.col("scale")).cast("long").alias("x0"), F.rint(4 - 2 * F.col("scale")).cast("long").alias("y0"), side.alias("w"), side.alias("h"))
    return frames.crop(views.pixels(spark, sf), boxes).groupBy("scale", "shift").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


@query("f8_average_hash", f"WITH {ARR} SELECT frame, array_to_string(list_transform(px, lambda x: CASE WHEN x > list_avg(px) THEN '1' ELSE '0' END), '') AS hash FROM fr")
def f8(spark, sf):
    return views.frames(spark, sf).select("frame", frames.average_hash(F.col("pixels")).alias("hash"))


# grouped statistics


@query("a5_gap_noise", f"{HEAD} SELECT lamp, round(avg(v) FILTER (v > thr) - avg(v) FILTER (v <= thr), 6) AS gap, round(sqrt((var_pop(v) FILTER (v > thr) + var_pop(v) FILTER (v <= thr)) / 2), 6) AS noise, round((avg(v) FILTER (v > thr) - avg(v) FILTER (v <= thr)) / sqrt((var_pop(v) FILTER (v > thr) + var_pop(v) FILTER (v <= thr)) / 2), 6) AS ratio FROM dev GROUP BY lamp")
def a5(spark, sf):
    on, off = F.when(F.col("v") > F.col("thr"), F.col("v")), F.when(F.col("v") <= F.col("thr"), F.col("v"))
    gap, noise = F.avg(on) - F.avg(off), F.sqrt((F.var_pop(on) + F.var_pop(off)) / 2)
    return thresholded(spark, sf).groupBy("lamp").agg(r6(gap, "gap"), r6(noise, "noise"), r6(gap / noise, "ratio"))


def two_groups_sql(src: str, thr: str) -> str:
    return f"SELECT lamp, max({thr}) AS thr, count(*) FILTER (v <= {thr}) AS nl, count(*) FILTER (v > {thr}) AS nh, avg(v) FILTER (v <= {thr}) AS ml, avg(v) FILTER (v > {thr}) AS mh, stddev_pop(v) FILTER (v <= {thr}) AS sl, stddev_pop(v) FILTER (v > {thr}) AS sh FROM {src} GROUP BY lamp"


#: The best split of each channel of a CTE named signal.
OTSU = f"""WITH z AS (SELECT lamp, min(v) AS lo, max(v) AS hi, count(*) AS n FROM signal GROUP BY lamp),
    b AS (SELECT lamp, lo, hi, n, CAST(trunc((v - lo) / (hi - lo) * 255) AS BIGINT) AS bin FROM signal JOIN z USING (lamp)),
    h AS (SELECT lamp, bin, max(lo) AS lo, max(hi) AS hi, max(n) AS n, count(*) AS c FROM b GROUP BY lamp, bin),
    q AS (SELECT *, sum(c) OVER w AS w0, sum(c * bin) OVER w AS m0, sum(c * bin) OVER (PARTITION BY lamp) AS mt FROM h WINDOW w AS (PARTITION BY lamp ORDER BY bin)),
    s AS (SELECT *, CASE WHEN w0 < n THEN w0 * (n - w0) * power(m0 / w0 - (mt - m0) / (n - w0), 2) / (CAST(n AS DOUBLE) * n) ELSE 0 END AS between FROM q),
    o AS (SELECT lamp, bin AS threshold_bin, lo, hi, lo + bin / 255.0::DOUBLE * (hi - lo) AS t, (lo + hi) / 2 AS mid FROM (SELECT *, row_number() OVER (PARTITION BY lamp ORDER BY round(between, 6) DESC, bin) AS i FROM s) WHERE i = 1),
    j AS (SELECT lamp, v, t, mid FROM signal JOIN o USING (lamp)),
    g AS ({two_groups_sql('j', 't')}),
    m AS ({two_groups_sql('j', 'mid')})
    SELECT o.lamp, threshold_bin, round(CASE WHEN g.nl >= 2 AND g.nh >= 2 THEN g.thr ELSE m.thr END, 6) AS threshold,
        round(CASE WHEN g.nl >= 2 AND g.nh >= 2 THEN abs(g.mh - g.ml) / greatest(sqrt((g.sl * g.sl + g.sh * g.sh) / 2), 0.5)
        WHEN m.nl >= 2 AND m.nh >= 2 THEN abs(m.mh - m.ml) / greatest(sqrt((m.sl * m.sl + m.sh * m.sh) / 2), 0.5) ELSE 0 END, 6) AS separation FROM o JOIN g USING (lamp) JOIN m USING (lamp)"""


@query("a6_otsu", OTSU.replace("WITH ", f"WITH {SIGNAL}, ", 1))
def a6(spark, sf):
    """The threshold that splits each channel best, and how far the two groups lie apart in units of their spread."""
    return thresholds.two_groups(order.with_stats(views.signal(spark, sf), ["lamp"], lo=F.min("v"), hi=F.max("v"), n=F.count("*"))).select("lamp", "threshold_bin", r6("threshold"), r6("separation"))


@query("a7_ambient", f"{HEAD} SELECT lamp, round(coalesce(avg(v) FILTER (v <= 180), avg(v)), 6) AS ambient FROM dev GROUP BY lamp")
def a7(spark, sf):
    return views.signal(spark, sf).groupBy("lamp").agg(r6(F.coalesce(F.avg(F.when(F.col("v") <= 180, F.col("v"))), F.avg("v")), "ambient"))


BLOCKS = f"WITH {SIGNAL}, b AS (SELECT lamp, frame // 260 AS block, avg(v) AS mean, count(*) AS n FROM signal GROUP BY ALL)"


@query("a8_block_means", f"{BLOCKS} SELECT lamp, block, round(mean, 6) AS mean, round(max(mean) OVER (PARTITION BY lamp) - min(mean) OVER (PARTITION BY lamp), 6) AS range FROM b WHERE n = 260")
def a8(spark, sf):
    b = views.signal(spark, sf).groupBy("lamp", F.floor(F.col("frame") / 260).alias("block")).agg(F.avg("v").alias("mean"), F.count("*").alias("n")).filter("n = 260")
    return order.with_stats(b, ["lamp"], range=F.max("mean") - F.min("mean")).select("lamp", "block", r6("mean"), r6("range"))


@query("a9_lit_drift", f"{HEAD}, l AS (SELECT lamp, v, row_number() OVER (PARTITION BY lamp ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY lamp) AS n FROM dev WHERE v > thr), b AS (SELECT lamp, i // greatest(1, n // 20) AS block, avg(v) AS mean FROM l GROUP BY ALL) SELECT lamp, count(*) AS blocks, round(max(mean) - min(mean), 6) AS drift FROM b WHERE block < 20 GROUP BY lamp")
def a9(spark, sf):
    lit = views.thresholded(spark, sf).filter("v > thr").select("lamp", "frame", "v")
    rows = order.with_stats(order.numbered(lit, ["lamp"], ["frame"], "i"), ["lamp"], n=F.count("*"))
    b = rows.groupBy("lamp", F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / 20))).alias("block")).agg(F.avg("v").alias("mean")).filter("block < 20")
    return b.groupBy("lamp").agg(F.count("*").alias("blocks"), r6(F.max("mean") - F.min("mean"), "drift"))


@query("a10_quantiles", f"WITH {SIGNAL} SELECT lamp, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95 FROM signal GROUP BY lamp")
def a10(spark, sf):
    q = thresholds.quantiles(views.signal(spark, sf), ["lamp"], "v", median=0.5, a=0.25, b=0.75, p5=0.05, p95=0.95)
    return q.select("lamp", r6("median"), r6(F.col("b") - F.col("a"), "iqr"), r6("p5"), r6("p95"))


@query("a11_longest_gap", f"{HEAD}, {LIT}, g AS (SELECT lamp, was AS start, frame - was AS gap FROM (SELECT lamp, frame, lag(frame) OVER (PARTITION BY lamp ORDER BY frame) AS was FROM bin WHERE bit = 1) WHERE was IS NOT NULL) SELECT lamp, gap, start FROM (SELECT *, row_number() OVER (PARTITION BY lamp ORDER BY gap DESC, start) AS i FROM g) WHERE i = 1")
def a11(spark, sf):
    lit = order.numbered(binary(spark, sf).filter("bit = 1").select("lamp", F.col("frame").alias("at")), ["lamp"], ["at"], "frame")
    gaps = windows.lagged(lit, v="at").filter("before is not null").select("lamp", (F.col("at") - F.col("before")).alias("gap"), F.col("before").alias("start"))
    return gaps.groupBy("lamp").agg(F.max("gap").alias("gap"), F.max_by("start", F.struct("gap", -F.col("start"))).alias("start"))


#: Levels above which a pixel is bright and a frame dark, and bright pixels of a lit frame.
BRIGHT, DARK, LIT_PIXELS, BLOCK = 0.15, 0.2, 8, 26
AUDIT = f"""WITH {PIXELS}, o AS (SELECT vec_id AS frame, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding = lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS dup FROM embeddings), f AS (SELECT label, frame, max(v) AS top, count(*) FILTER (v > {BRIGHT}) AS nb, avg(v) FILTER (v > {BRIGHT}) AS lvl, coalesce(avg(v) FILTER (v <= {BRIGHT}), avg(v)) AS amb, avg(x) FILTER (v > {BRIGHT}) AS cx, avg(y) FILTER (v > {BRIGHT}) AS cy FROM pixels GROUP BY label, frame),
    r AS (SELECT f.*, i, dup, nb > {LIT_PIXELS} AS lit FROM f JOIN o USING (frame)), l AS (SELECT *, row_number() OVER w - 1 AS j, lag(i) OVER w AS was FROM r WHERE lit WINDOW w AS (PARTITION BY label ORDER BY i)), ln AS (SELECT *, count(*) OVER (PARTITION BY label) AS nl FROM l), dr AS (SELECT label, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM (SELECT label, j // greatest(1, nl // 20) AS b, avg(cx) AS x, avg(cy) AS y FROM ln WHERE j // greatest(1, nl // 20) < 20 GROUP BY ALL) GROUP BY label),
    g AS (SELECT label, i - was AS gap, was AS start FROM l WHERE was IS NOT NULL), gm AS (SELECT label, gap - 1 AS gap, start FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gap DESC, start) AS q FROM g) WHERE q = 1), ps AS (SELECT label, max(m) - min(m) AS range FROM (SELECT label, i // {BLOCK} AS b, avg(amb) AS m FROM r GROUP BY ALL HAVING count(*) = {BLOCK}) GROUP BY label),
    a AS (SELECT label, count(*) AS frames_read, count(*) FILTER (dup) AS duplicated_frames, count(*) FILTER (top < {DARK}) AS black_frames, median(amb) AS amb FROM r GROUP BY label), b AS (SELECT label, min(i) AS first, max(i) AS last, count(*) AS nl, median(nb) AS size, quantile_cont(nb, 0.75) - quantile_cont(nb, 0.25) AS iqr, median(lvl) AS lvl, quantile_cont(lvl, 0.05) AS p5, quantile_cont(lvl, 0.95) AS p95 FROM l GROUP BY label)
    SELECT CAST(label AS BIGINT) AS label, frames_read, duplicated_frames, black_frames, round(frames_read / 260.0::DOUBLE, 4) AS length_s, '8x8' AS resolution, 260.0::DOUBLE AS fps, first AS dark_lead_in_frames, frames_read - 1 - last AS dark_lead_out_frames, round((last - first + 1) / 260.0::DOUBLE, 4) AS transmission_s, CAST(floor((last - first + 1) / {T}) AS BIGINT) AS bits_available, round(nl * 100.0::DOUBLE / (last - first + 1), 4) AS lit_share_of_span_pct, gap AS longest_unlit_gap_frames, round(gap / {T}, 4) AS longest_unlit_gap_bits, start AS longest_gap_starts_at_frame,
      CAST(floor(size) AS BIGINT) AS size_median_px, CAST(floor(iqr) AS BIGINT) AS size_iqr_px, round(lvl, 4) AS on_level_median, round(p5, 4) AS on_level_5, round(p95, 4) AS on_level_95, round(amb, 4) AS ambient_median, round(range, 4) AS ambient_range, round(lvl - amb, 4) AS contrast, round(range / (lvl - amb) * 100, 2) AS ambient_range_pct_of_contrast, round(dx, 4) AS drift_x_px, round(dy, 4) AS drift_y_px FROM a JOIN b USING (label) JOIN gm USING (label) JOIN dr USING (label) LEFT JOIN ps USING (label)"""


@query("a12_audit", AUDIT)
def a12(spark, sf):
    """Everything that is told of a recording (here: a label's frames): length, dark ends, gaps, size and level of its light, ambient, drift."""
    px = F.col("pixels")
    bright = F.filter(F.transform(px, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: p["v"] > BRIGHT)
    dark = F.filter(px, lambda v: v <= BRIGHT)
    mean_of = lambda xs, f: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, p: a + f(p)), F.size(xs))
    f = order.numbered(views.frames(spark, sf), ["label"], ["frame"], "i")
    f = order.chunked(f, ["label"], "i", 1, 0, lambda w: {"was": F.lag("pixels").over(w)})
    r = f.select("label", "i", F.array_max(px).alias("top"), F.size(bright).alias("nb"), mean_of(bright, lambda p: p["v"]).alias("lvl"), F.when(F.size(dark) > 0, frames.mean(dark)).otherwise(frames.mean(px)).alias("amb"), mean_of(bright, lambda p: (p["i"] % 8).cast("double")).alias("cx"), mean_of(bright, lambda p: F.floor(p["i"] / 8).cast("double")).alias("cy"), (px == F.col("was")).alias("dup"))
    r = staged(r)
    lit = order.numbered(r.filter(F.col("nb") > LIT_PIXELS), ["label"], ["i"], "j")
    lit = staged(order.with_stats(windows.lagged(lit, ["label"], v="i", name="before", frame="j"), ["label"], nl=F.count("*")))
    block = F.floor(F.col("j") / F.greatest(F.lit(1), F.floor(F.col("nl") / 20)))
    drift = lit.groupBy("label", block.alias("b")).agg(F.avg("cx").alias("x"), F.avg("cy").alias("y")).filter("b < 20").groupBy("label").agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    gap = lit.filter("before is not null").groupBy("label").agg((F.max(F.col("i") - F.col("before")) - 1).alias("gap"), F.max_by("before", F.struct(F.col("i") - F.col("before"), -F.col("before"))).alias("start"))
    seconds = r.groupBy("label", F.floor(F.col("i") / BLOCK).alias("b")).agg(F.avg("amb").alias("m"), F.count("*").alias("c")).filter(F.col("c") == BLOCK).groupBy("label").agg((F.max("m") - F.min("m")).alias("range"))
    whole = r.groupBy("label").agg(F.count("*").alias("frames_read"), F.count_if("dup").alias("duplicated_frames"), F.count_if(F.col("top") < DARK).alias("black_frames"))
    ends = lit.groupBy("label").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("nl").alias("nl"))
    q = thresholds.quantiles(r, ["label"], "amb", amb=0.5).join(thresholds.quantiles(lit.withColumn("nb", F.col("nb").cast("double")), ["label"], "nb", size=0.5, s25=0.25, s75=0.75), "label").join(thresholds.quantiles(lit, ["label"], "lvl", lvl=0.5, p5=0.05, p95=0.95), "label")
    t = whole.join(ends, "label").join(q, "label").join(gap, "label").join(drift, "label").join(seconds, "label", "left")
    span, contrast = F.col("last") - F.col("first") + 1, F.col("lvl") - F.col("amb")
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return t.select(F.col("label").cast("long").alias("label"), "frames_read", "duplicated_frames", "black_frames", r4(F.col("frames_read") / 260, "length_s"), F.lit("8x8").alias("resolution"), F.lit(260.0).alias("fps"), F.col("first").alias("dark_lead_in_frames"), (F.col("frames_read") - 1 - F.col("last")).alias("dark_lead_out_frames"), r4(span / 260, "transmission_s"), F.floor(span / PERIOD).alias("bits_available"), r4(F.col("nl") * 100 / span, "lit_share_of_span_pct"), F.col("gap").alias("longest_unlit_gap_frames"), r4(F.col("gap") / PERIOD, "longest_unlit_gap_bits"), F.col("start").alias("longest_gap_starts_at_frame"), F.floor("size").alias("size_median_px"), F.floor(F.col("s75") - F.col("s25")).alias("size_iqr_px"), r4(F.col("lvl"), "on_level_median"), r4(F.col("p5"), "on_level_5"), r4(F.col("p95"), "on_level_95"), r4(F.col("amb"), "ambient_median"), r4(F.col("range"), "ambient_range"), r4(contrast, "contrast"), F.round(F.col("range") / contrast * 100, 2).alias("ambient_range_pct_of_contrast"), r4(F.col("dx"), "drift_x_px"), r4(F.col("dy"), "drift_y_px"))


@query("a15_gap_histogram", f"{HEAD}, {LIT}, {ISLANDS}, k AS (SELECT lamp, unnest(range(1, 9)) AS k FROM (SELECT DISTINCT lamp FROM signal)), h AS (SELECT lamp, least(length, 8) AS k, count(*) AS c FROM rn GROUP BY ALL) SELECT lamp, k, round(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY lamp), 6) AS share FROM k LEFT JOIN h USING (lamp, k)")
def a15(spark, sf):
    from tarnwave.operators import runs

    rows = runs.runs(binary(spark, sf))
    h = rows.groupBy("lamp", F.least("length", F.lit(8)).cast("long").alias("k")).agg(F.count("*").alias("c"))
    grid = h.select("lamp").distinct().withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    full = grid.join(h, ["lamp", "k"], "left").fillna(0, ["c"])
    return order.with_stats(full, ["lamp"], t=F.sum("c")).select("lamp", "k", r6(F.col("c") / F.col("t"), "share"))


@query("a16_value_counts", f"{HEAD}, {LIT}, {ISLANDS} SELECT bit, length, count(*) AS n FROM rn GROUP BY ALL")
def a16(spark, sf):
    from tarnwave.operators import runs

    return runs.runs(binary(spark, sf)).groupBy("bit", "length").agg(F.count("*").alias("n"))


@query("a17_jitter", "WITH d AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM events), j AS (SELECT user_id, stddev_pop(dt) / avg(dt) AS jitter, count(*) AS n FROM d WHERE dt > 0 GROUP BY user_id) SELECT user_id, round(jitter, 6) AS jitter, jitter > 0.02 AS variable FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 5) JOIN j USING (user_id) WHERE n > 3")
def a17(spark, sf):
    e = order.numbered(views.read(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "frame")
    d = windows.lagged(e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], v="us").withColumn("dt", F.col("us") - F.col("before")).filter("dt > 0")
    enough = e.groupBy("user_id").agg(F.count("*").alias("times")).filter("times > 5")
    j = d.groupBy("user_id").agg((F.stddev_pop("dt") / F.avg("dt")).alias("jitter"), F.count("*").alias("n")).filter("n > 3").join(enough, "user_id")
    return j.select("user_id", r6("jitter"), (F.col("jitter") > 0.02).alias("variable"))


@query("a18_truth_summary", f"WITH {TRUTH}, t AS (SELECT stream, k // 64 AS part, string_agg(CAST(bit AS VARCHAR), '' ORDER BY k) || CASE WHEN (k // 64) % 5 = 3 THEN 'x' ELSE '' END AS bits FROM truth GROUP BY stream, k // 64) SELECT stream, part, CASE WHEN ok THEN length(bits) END AS n, CASE WHEN ok THEN length(replace(bits, '0', '')) END AS ones, CASE WHEN ok THEN length(replace(bits, '1', '')) END AS zeros, round(CASE WHEN ok THEN length(replace(bits, '0', '')) / CAST(length(bits) AS DOUBLE) END, 6) AS share FROM (SELECT *, regexp_full_match(bits, '[01]+') AS ok FROM t)")
def a18(spark, sf):
    """Bit texts of 64 symbols (some damaged on purpose): their figures where they are 0 and 1 alone, nulls where not."""
    c = F.array_sort(F.collect_list(F.struct("k", "bit")))
    t = views.truth(spark, sf).groupBy("stream", F.floor(F.col("k") / 64).alias("part")).agg(F.array_join(F.transform(c, lambda x: x["bit"].cast("string")), "").alias("bits"))
    t = t.withColumn("bits", F.concat("bits", F.when(F.col("part") % 5 == 3, "x").otherwise("")))
    ok = F.col("bits").rlike("^[01]+$")
    ones, n = F.length(F.regexp_replace("bits", "0", "")), F.length("bits")
    return t.select("stream", "part", F.when(ok, n).cast("long").alias("n"), F.when(ok, ones).cast("long").alias("ones"), F.when(ok, n - ones).cast("long").alias("zeros"), r6(F.when(ok, ones / n), "share"))


@query("a25_timings", "WITH m AS (SELECT user_id, event_type, median(value) AS ms FROM events GROUP BY ALL), s AS (SELECT user_id, sum(ms) AS total, count(*) AS stages FROM m GROUP BY user_id) SELECT user_id, stages, round(total, 6) AS total_ms, round(round(total / n, 9), 6) AS ms_per_frame FROM s JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)")
def a25(spark, sf):
    """Timings of stages (values by type, several runs of each): the median of each stage, their sum, and that for each frame."""
    e = views.read(spark, sf, "events")
    m = thresholds.quantiles(e, ["user_id", "event_type"], "value", ms=0.5)
    s = m.groupBy("user_id").agg(F.sum("ms").alias("total"), F.count("*").alias("stages")).join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    return s.select("user_id", "stages", r6("total", "total_ms"), r6(F.round(F.col("total") / F.col("n"), 9), "ms_per_frame"))


@query("p12_rates_and_periods", "SELECT event_id, round(260.0::DOUBLE / (1 + event_id % 130), 6) AS period, round(260.0::DOUBLE / (260.0::DOUBLE / (1 + event_id % 130)), 6) AS bps FROM events")
def p12(spark, sf):
    """Symbol periods in frames of rates in symbols a second, and back."""
    e = views.read(spark, sf, "events").select("event_id", scalars.period_of((1 + F.col("event_id") % 130).cast("double"), 260.0).alias("p"))
    return e.select("event_id", r6("p", "period"), r6(scalars.rate_of(F.col("p"), 260.0), "bps"))


@query("a21_median_over_lamps", f"{HEAD}, m AS (SELECT lamp, avg(v) AS mean, avg(CAST(v > thr AS INT)) AS lit FROM dev GROUP BY lamp) SELECT round(median(mean), 6) AS mean, round(median(lit), 6) AS lit FROM m")
def a21(spark, sf):
    per = binary(spark, sf).groupBy("lamp").agg(F.avg("v").alias("mean"), F.avg("bit").alias("lit"))
    return per.agg(r6(F.percentile("mean", F.lit(0.5)), "mean"), r6(F.percentile("lit", F.lit(0.5)), "lit"))


@query("a22_majority_baseline", f"WITH {TRUTH} SELECT stream, round(least(avg(bit), 1 - avg(bit)), 6) AS ber FROM truth GROUP BY stream")
def a22(spark, sf):
    return views.truth(spark, sf).groupBy("stream").agg(r6(F.least(F.avg("bit"), 1 - F.avg("bit")), "ber"))


@query("a24_half_drift", f"WITH {SIGNAL}, z AS (SELECT lamp, count(*) // 2 AS h FROM signal GROUP BY lamp) SELECT lamp, round(avg(v) FILTER (frame >= h) - avg(v) FILTER (frame < h), 6) AS drift FROM signal JOIN z USING (lamp) GROUP BY lamp")
def a24(spark, sf):
    rows = order.with_stats(views.signal(spark, sf), ["lamp"], h=F.floor(F.count("*") / 2))
    return rows.groupBy("lamp").agg(r6(F.avg(F.when(F.col("frame") >= F.col("h"), F.col("v"))) - F.avg(F.when(F.col("frame") < F.col("h"), F.col("v"))), "drift"))


@query("a29_range_guard", "SELECT user_id, CASE WHEN max(value) - min(value) < 20 THEN 50.0::DOUBLE ELSE round(avg(CAST(value > 50 AS INT)) * 100, 6) END AS lit_pct FROM events GROUP BY user_id")
def a29(spark, sf):
    e = views.read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.when(F.max("value") - F.min("value") < 20, F.lit(50.0)).otherwise(r6(F.avg((F.col("value") > 50).cast("double")) * 100, "x")).alias("lit_pct"))


# what sinks write


@query("k3_frame_times", f"WITH {SIGNAL} SELECT lamp, frame AS sample_index, frame + 217 AS video_frame_index, round((frame + 217) / 260.0::DOUBLE, 6) AS time_s_from_video_start, round(frame / 260.0::DOUBLE, 6) AS time_s_from_trim_start FROM signal")
def k3(spark, sf):
    f = F.col("frame")
    return views.signal(spark, sf).select("lamp", f.alias("sample_index"), (f + 217).alias("video_frame_index"), r6((f + 217) / F.lit(260.0), "time_s_from_video_start"), r6(f / F.lit(260.0), "time_s_from_trim_start"))


@query("k4_json_report", f"{HEAD} SELECT lamp, '{{\"lamp\":\"' || lamp || '\",\"n\":' || CAST(max(n) AS VARCHAR) || ',\"lit\":' || CAST(sum(CAST(v > thr AS INT)) AS VARCHAR) || '}}' AS report FROM dev GROUP BY lamp")
def k4(spark, sf):
    r = binary(spark, sf).groupBy("lamp").agg(F.count("*").alias("n"), F.sum("bit").alias("lit"))
    return r.select("lamp", F.to_json(F.struct("lamp", "n", "lit")).alias("report"))


@query("k5_bit_text", f"{HEAD}, {win(12)}, {NEAREST}, {BITS}, ens AS (SELECT lamp, k, max(bit) FILTER (phase_id = 0) AS b0, min(bit) = max(bit) AS safe FROM bits GROUP BY lamp, k HAVING count(*) = 12) SELECT lamp, k // 1000 AS part, string_agg(CASE WHEN safe THEN CAST(b0 AS VARCHAR) ELSE '?' END, '' ORDER BY k) AS bits FROM ens GROUP BY ALL")
def k5(spark, sf):
    """Bit strings of 1,000 symbols each, so that no row grows with the signal; written in order they are the text."""
    ens = symbols.ensemble(symbols.decode(thresholded(spark, sf), "nearest", symbols.phases(12)), 12)
    c = F.struct("k", F.when(F.col("safe"), F.col("b0").cast("string")).otherwise("?").alias("c"))
    parts = ens.groupBy("lamp", F.floor(F.col("k") / 1000).alias("part")).agg(F.array_sort(F.collect_list(c)).alias("s"))
    return parts.select("lamp", "part", F.array_join(F.transform("s", lambda x: x["c"]), "").alias("bits"))


@query("k6_pivot_table", f"{HEAD} SELECT CAST(frame // 1000 AS BIGINT) AS block, " + ", ".join(f"round(avg(v) FILTER (lamp = '{n}'), 6) AS \"{n}\"" for n in ("click", "error", "purchase", "signup", "view")) + " FROM dev GROUP BY ALL")
def k6(spark, sf):
    """Block means with a column for each channel that there is (its SQL names those of the test tables)."""
    p = views.signal(spark, sf).groupBy(F.floor(F.col("frame") / 1000).alias("block")).pivot("lamp").agg(F.avg("v"))
    return p.select("block", *[r6(n) for n in p.columns if n != "block"])


QUERIES, ORACLES = book.queries, book.oracles

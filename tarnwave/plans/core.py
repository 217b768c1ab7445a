"""Queries of thresholds, windows, runs and symbol decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators import order, runs, symbols, thresholds, windows
from tarnwave.operators.symbols import PERIOD
from tarnwave.plans.base import AVERAGE, BITS, CONFIDENT, DEV, NEAREST, THR, Book, T, r6
from tarnwave.plans.base import windows as win
from tarnwave.sources import views
from tarnwave.sources.stage import staged
from tarnwave.sources.views import SIGNAL

book = Book()
query = book.query


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def thresholded(spark, sf) -> DataFrame:
    """lamp, frame, v, thr, n, span."""
    return views.thresholded(spark, sf)


def binary(spark, sf) -> DataFrame:
    """The signal as bits against its fixed threshold."""
    return views.thresholded(spark, sf).withColumn("bit", (F.col("v") > F.col("thr")).cast("long"))


LIT = "bin AS (SELECT lamp, frame, v, thr, CAST(v > thr AS BIGINT) AS bit FROM dev)"
HEAD = f"WITH {SIGNAL}, {THR}, {DEV}"


@query("t1_fixed_threshold", f"WITH {SIGNAL} SELECT lamp, round((quantile_cont(v, 0.1) + quantile_cont(v, 0.9)) / 2, 6) AS thr, round((quantile_cont(v, 0.05) + quantile_cont(v, 0.95)) / 2, 6) AS thr_wide FROM signal GROUP BY lamp")
def t1(spark, sf):
    q = thresholds.quantiles(views.signal(spark, sf), ["lamp"], "v", a=0.1, b=0.9, c=0.05, d=0.95)
    return q.select("lamp", r6((F.col("a") + F.col("b")) / 2, "thr"), r6((F.col("c") + F.col("d")) / 2, "thr_wide"))


@query("t2_middle_thresholds", f"WITH {SIGNAL} SELECT lamp, round((min(v) + max(v)) / 2, 6) AS thr_mid, round(avg(v), 6) AS thr_mean FROM signal GROUP BY lamp")
def t2(spark, sf):
    return thresholds.middle(views.signal(spark, sf)).select("lamp", r6("thr_mid"), r6("thr_mean")).distinct()


def moving_sql(window: str, odd: bool, out: str, shares: tuple[str, str]) -> str:
    w = f"({window}) | 1" if odd else window
    return f"""WITH {SIGNAL}, sz0 AS (SELECT lamp, count(*) AS n FROM signal GROUP BY lamp), sz1 AS (SELECT lamp, n, CAST({w} AS BIGINT) AS w FROM sz0),
    sz AS (SELECT *, greatest(1, w // 8) AS step FROM sz1), kn AS (SELECT lamp, n, w, step, unnest(range((n - 1) // step + 1)) AS knot FROM sz),
    px AS (SELECT lamp, knot, w, n, step, unnest(range(w)) AS j FROM kn),
    q AS (SELECT p.lamp, knot, quantile_cont(v, {shares[0]}) AS lo, quantile_cont(v, {shares[1]}) AS hi FROM px p JOIN signal s ON s.lamp = p.lamp AND s.frame = least(greatest(knot * step - w // 2 + j, 0), n - 1) GROUP BY ALL),
    itp AS (SELECT s.lamp, s.frame, s.v, a.lo + (coalesce(b.lo, a.lo) - a.lo) * (CAST(s.frame - a.knot * z.step AS DOUBLE) / z.step) AS lo, a.hi + (coalesce(b.hi, a.hi) - a.hi) * (CAST(s.frame - a.knot * z.step AS DOUBLE) / z.step) AS hi
      FROM signal s JOIN sz z USING (lamp) JOIN q a ON a.lamp = s.lamp AND a.knot = s.frame // z.step LEFT JOIN q b ON b.lamp = s.lamp AND b.knot = a.knot + 1)
    SELECT lamp, frame, {out} FROM itp"""


QUARTER = "least(2600, greatest(51, n // 4))"


@query("t3_adaptive_threshold", moving_sql(QUARTER, False, "round((lo + hi) / 2, 6) AS thr", ("0.1", "0.9")))
def t3(spark, sf):
    return thresholds.adaptive(views.signal(spark, sf)).select("lamp", "frame", r6("thr"))


@query("t3b_adaptive_odd", moving_sql(QUARTER, True, "round((lo + hi) / 2, 6) AS thr", ("0.1", "0.9")))
def t3b(spark, sf):
    return thresholds.adaptive(views.signal(spark, sf), odd=True).select("lamp", "frame", r6("thr"))


@query("t5_local_normalise", moving_sql("260", True, "round((v - lo) / greatest(hi - lo, 1e-6) * 255, 6) AS scaled", ("0.05", "0.95")))
def t5(spark, sf):
    return thresholds.local_normal(views.signal(spark, sf), 260).select("lamp", "frame", r6("scaled"))


@query("t4_rolling_symbol_threshold", f"""WITH {SIGNAL}, m AS (SELECT lamp, greatest(CAST(floor(frame / {T}) AS BIGINT), 0) AS k, avg(v) AS mean FROM signal GROUP BY ALL),
    e AS (SELECT *, count(*) OVER (PARTITION BY lamp) AS n, first_value(mean) OVER (PARTITION BY lamp ORDER BY k) AS f, last_value(mean) OVER (PARTITION BY lamp ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
      sum(mean) OVER (PARTITION BY lamp ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS s FROM m)
    SELECT lamp, k, round((s + greatest(7 - k, 0) * f + greatest(k + 7 - (n - 1), 0) * l) / 15, 6) AS thr FROM e""")
def t4(spark, sf):
    means = symbols.symbol_means(views.signal(spark, sf), PERIOD, 0.0).withColumnRenamed("k", "frame")
    return windows.moving_average(means, 15, v="mean", name="thr").select("lamp", F.col("frame").alias("k"), r6("thr"))


BANDS = (0.0, 20.0, 60.0)


@query("t6_schmitt", f"""{HEAD}, b AS (SELECT unnest([0.0, 20.0, 60.0]::DOUBLE[]) AS band), x AS (SELECT lamp, band, frame, CASE WHEN v > thr + band THEN 1 WHEN v < thr - band THEN 0 WHEN frame = 0 THEN CAST(v > thr AS INT) END AS s FROM dev, b)
    SELECT lamp, band, frame, CAST(last_value(s IGNORE NULLS) OVER (PARTITION BY lamp, band ORDER BY frame) AS BIGINT) AS state FROM x""")
def t6(spark, sf):
    rows = views.thresholded(spark, sf).withColumn("band", F.explode(F.array(*map(F.lit, BANDS))))
    return thresholds.schmitt(rows, F.col("thr"), F.col("band"), ["lamp", "band"]).select("lamp", "band", "frame", "state")


@query("t7_bit_hysteresis", f"""{HEAD}, {win(1)}, {CONFIDENT}, z AS (SELECT lamp, CAST(d > 0 AS INT) AS s0, span FROM dev WHERE frame = 0),
    y AS (SELECT lamp, k, CASE WHEN x > 0.2 * span THEN 1 WHEN x < -0.2 * span THEN 0 WHEN k = 0 THEN s0 END AS s FROM val JOIN z USING (lamp))
    SELECT lamp, k, CAST(last_value(s IGNORE NULLS) OVER (PARTITION BY lamp ORDER BY k) AS BIGINT) AS state FROM y""")
def t7(spark, sf):
    rows = thresholded(spark, sf)
    first = rows.filter("frame = 0").select("lamp", "span", (F.col("v") > F.col("thr")).cast("int").alias("s0"))
    served = symbols.served(rows.withColumn("d", F.col("v") - F.col("thr")), [0.0])
    best = served.groupBy("lamp", "k").agg(F.max_by("d", F.struct(F.abs("d"), -F.col("frame"))).alias("x")).join(first, "lamp")
    return thresholds.schmitt(best, F.lit(0.0), 0.2 * F.col("span"), v="x", frame="k", start=F.when(F.col("k") == 0, F.col("s0"))).select("lamp", "k", "state")


@query("t8_threshold_shift", f"{HEAD} SELECT lamp, s AS shift, round(avg(CAST(v > thr + s * span AS DOUBLE)), 6) AS lit FROM dev, (SELECT unnest([-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3]::DOUBLE[]) AS s) GROUP BY ALL")
def t8(spark, sf):
    rows = thresholded(spark, sf).withColumn("shift", F.explode(F.array(*map(F.lit, (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)))))
    return rows.groupBy("lamp", "shift").agg(r6(F.avg((F.col("v") > F.col("thr") + F.col("shift") * F.col("span")).cast("double")), "lit"))


def ma_sql(w: int, src: str = "signal", v: str = "v", out: str = "ma") -> str:
    left, right = w // 2, w - 1 - w // 2
    return f"""(SELECT *, (sum({v}) OVER (PARTITION BY lamp ORDER BY frame ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) + greatest({left} - frame, 0) * first_value({v}) OVER (PARTITION BY lamp ORDER BY frame)
      + greatest(frame + {right} - (count(*) OVER (PARTITION BY lamp) - 1), 0) * last_value({v}) OVER (PARTITION BY lamp ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {w} AS {out} FROM {src})"""


@query("w1_moving_average", f"WITH {SIGNAL} " + " UNION ALL ".join(f"SELECT lamp, CAST({w} AS BIGINT) AS width, frame, round(ma, 6) AS ma FROM {ma_sql(w)}" for w in (3, 8, 29)))
def w1(spark, sf):
    s = views.signal(spark, sf)
    return union([windows.moving_average(s, w).select("lamp", F.lit(w).cast("long").alias("width"), "frame", r6("ma")) for w in (3, 8, 29)])


@query("w2_detrend", f"WITH {SIGNAL} SELECT lamp, frame, round(v - ma + avg(ma) OVER (PARTITION BY lamp), 6) AS flat, round(v - ma, 6) AS residue FROM {ma_sql(261)}")
def w2(spark, sf):
    s = windows.detrend(views.signal(spark, sf), 261)
    return windows.detrend(s.withColumnRenamed("flat", "centred"), 261, centre=False).select("lamp", "frame", r6("centred", "flat"), r6("flat", "residue"))


@query("w3_rolling_z", f"WITH {SIGNAL}, a AS (SELECT *, power(v - mu, 2) AS sq FROM {ma_sql(101, out='mu')}) SELECT lamp, frame, round((v - mu) / (sqrt(va) + 1e-6), 6) AS z FROM {ma_sql(101, 'a', 'sq', 'va')}")
def w3(spark, sf):
    return windows.rolling_z(views.signal(spark, sf), 101).select("lamp", "frame", r6("z"))


MEAN = "mu"


def z_sql(w: int, out: str) -> str:
    return f"SELECT lamp, frame, (v - mu) / (sqrt(va) + 1e-6) AS {out} FROM {ma_sql(w, f'(SELECT *, power(v - mu, 2) AS sq FROM {ma_sql(w, out=MEAN)})', 'sq', 'va')}"


@query("w3b_rolling_z_forms", f"WITH {SIGNAL}, e AS ({z_sql(100, 'z')}), o AS ({z_sql(101, 'z_odd')}) SELECT lamp, frame, round(z, 6) AS z, round(z_odd, 6) AS z_odd FROM e JOIN o USING (lamp, frame)")
def w3b(spark, sf):
    """Both forms for an even window: as it is, and made odd and centred."""
    both = windows.rolling_zs(views.signal(spark, sf), {"z": 100, "z_odd": 101})
    return both.select("lamp", "frame", r6("z"), r6("z_odd"))


@query("w4_lit_windows", f"{HEAD}, {LIT}, f AS (SELECT lamp, frame, sum(bit) OVER w AS c, count(*) OVER w AS n FROM bin WINDOW w AS (PARTITION BY lamp ORDER BY frame ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING)) SELECT lamp, frame, CAST(c AS BIGINT) AS lit_count, c >= 10 AS enough FROM f WHERE n = 26")
def w4(spark, sf):
    return windows.lit_windows(binary(spark, sf), 26, 10, lit="bit").select("lamp", "frame", "lit_count", "enough")


@query("w5_sustained_trim", f"""{HEAD}, {LIT}, f AS (SELECT lamp, frame, sum(bit) OVER w AS c, count(*) OVER w AS n FROM bin WINDOW w AS (PARTITION BY lamp ORDER BY frame ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING)),
    g AS (SELECT lamp, min(frame) AS a0, max(frame) AS b0 FROM f WHERE n = 26 AND c >= 16 GROUP BY lamp)
    SELECT lamp, CAST(coalesce(min(frame) FILTER (bit = 1 AND frame >= a0), 0) AS BIGINT) AS a, CAST(coalesce(max(frame) FILTER (bit = 1 AND frame <= b0 + 25), max(frame)) AS BIGINT) AS b, CAST(coalesce(max(a0), 0) AS BIGINT) AS window_start FROM bin LEFT JOIN g USING (lamp) GROUP BY lamp""")
def w5(spark, sf):
    return windows.sustained_trim(binary(spark, sf).withColumnRenamed("bit", "lit"), 26, 16)


@query("w6_edges", f"{HEAD}, {LIT} SELECT lamp, frame, bit FROM (SELECT *, lag(bit) OVER (PARTITION BY lamp ORDER BY frame) AS was FROM bin) WHERE was <> bit")
def w6(spark, sf):
    return runs.edges(binary(spark, sf)).select("lamp", "frame", "bit")


@query("w7_lit_span", f"{HEAD}, {LIT} SELECT lamp, min(frame) AS first_lit, max(frame) AS last_lit, max(frame) - min(frame) + 1 AS span FROM bin WHERE bit = 1 GROUP BY lamp")
def w7(spark, sf):
    return binary(spark, sf).filter("bit = 1").groupBy("lamp").agg(F.min("frame").alias("first_lit"), F.max("frame").alias("last_lit"), (F.max("frame") - F.min("frame") + 1).alias("span"))


@query("w10_local_peaks", f"""WITH {SIGNAL}, n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM signal WINDOW w AS (PARTITION BY lamp ORDER BY frame)),
    p AS (SELECT *, row_number() OVER (PARTITION BY lamp ORDER BY v DESC, frame) AS i FROM n WHERE v > l AND v >= r) SELECT lamp, frame, v, i AS place FROM p WHERE i <= 5""")
def w10(spark, sf):
    peaks = windows.local_peaks(views.signal(spark, sf))
    w = order.Window.partitionBy("lamp").orderBy(F.desc("v"), "frame")
    return peaks.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5").select("lamp", "frame", "v", "place")


@query("w11_edge_gaps", f"{HEAD}, {LIT}, e AS (SELECT lamp, frame, row_number() OVER (PARTITION BY lamp ORDER BY frame) AS i FROM (SELECT *, lag(bit) OVER (PARTITION BY lamp ORDER BY frame) AS was FROM bin) WHERE was <> bit), g AS (SELECT lamp, CAST(m AS BIGINT) AS m, a.frame - b.frame AS gap FROM e a JOIN (SELECT unnest([20, 50, 100]) AS m) t ON true JOIN e b USING (lamp) WHERE b.i = a.i - m) SELECT lamp, m, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM g GROUP BY ALL")
def w11(spark, sf):
    e = order.numbered(runs.edges(binary(spark, sf)).select("lamp", "frame"), ["lamp"], ["frame"], "i")
    return union([windows.lagged(e, by=m, v="frame", frame="i").filter("before is not null").groupBy("lamp").agg(F.lit(m).cast("long").alias("m"), F.count("*").alias("n"), r6(F.avg(F.col("frame") - F.col("before")), "mean_gap")) for m in (20, 50, 100)])


ISLANDS = "isl AS (SELECT *, sum(CASE WHEN was <> bit THEN 1 ELSE 0 END) OVER (PARTITION BY lamp ORDER BY frame) AS g FROM (SELECT *, lag(bit) OVER (PARTITION BY lamp ORDER BY frame) AS was FROM bin)), rn AS (SELECT lamp, g, max(bit) AS bit, min(frame) AS start, count(*) AS length FROM isl GROUP BY lamp, g)"


@query("r1_runs_inner", f"{HEAD}, {LIT}, {ISLANDS} SELECT lamp, length, count(*) AS n FROM (SELECT *, max(g) OVER (PARTITION BY lamp) AS z FROM rn) WHERE g > 0 AND g < z GROUP BY ALL")
def r1(spark, sf):
    return runs.runs(binary(spark, sf), partial=False).groupBy("lamp", "length").agg(F.count("*").alias("n"))


@query("r2_runs_all", f"{HEAD}, {LIT}, {ISLANDS} SELECT lamp, bit, start, length FROM rn")
def r2(spark, sf):
    return runs.runs(binary(spark, sf)).select("lamp", "bit", "start", "length")


@query("r3_run_of_each_frame", f"{HEAD}, {LIT}, {ISLANDS} SELECT lamp, frame, i.bit, length FROM isl i JOIN rn r USING (lamp, g)")
def r3(spark, sf):
    rows = runs.islands(binary(spark, sf))
    return rows.join(rows.groupBy("lamp", "island").agg(F.count("*").alias("length")), ["lamp", "island"]).select("lamp", "frame", "bit", "length")


@query("r4_safe_by_run", f"""{HEAD}, {win(12)}, {NEAREST}, {BITS}, ens AS (SELECT lamp, k AS frame, max(bit) FILTER (phase_id = 0) AS bit, CAST(min(bit) = max(bit) AS INT) AS safe FROM bits GROUP BY lamp, k HAVING count(*) = 12),
    {ISLANDS.replace('FROM bin', 'FROM ens')} SELECT length, count(*) AS n, round(avg(safe), 6) AS safe_share FROM isl JOIN rn USING (lamp, g) WHERE length <= 4 GROUP BY length HAVING count(*) > 20""")
def r4(spark, sf):
    ens = symbols.ensemble(symbols.decode(thresholded(spark, sf), "nearest", symbols.phases(12)), 12)
    rows = runs.islands(ens, bit="b0", frame="k")
    per = rows.join(rows.groupBy("lamp", "island").agg(F.count("*").alias("length")), ["lamp", "island"])
    return per.filter("length <= 4").groupBy("length").agg(F.count("*").alias("n"), r6(F.avg(F.col("safe").cast("double")), "safe_share")).filter("n > 20")


@query("r5_single_frame_runs", f"{HEAD}, {LIT}, {ISLANDS} SELECT lamp, start FROM (SELECT *, max(g) OVER (PARTITION BY lamp) AS z FROM rn) WHERE g > 0 AND g < z AND length = 1")
def r5(spark, sf):
    return runs.runs(binary(spark, sf), partial=False).filter("length = 1").select("lamp", "start")


@query("r6_hysteresis_sweep", f"""{HEAD}, b AS (SELECT unnest([0.0, 20.0, 60.0]::DOUBLE[]) AS band), x AS (SELECT lamp, band, frame, CASE WHEN v > thr + band THEN 1 WHEN v < thr - band THEN 0 WHEN frame = 0 THEN CAST(v > thr AS INT) END AS s FROM dev, b),
    st AS (SELECT lamp, band, frame, last_value(s IGNORE NULLS) OVER (PARTITION BY lamp, band ORDER BY frame) AS bit FROM x), i AS (SELECT *, sum(CASE WHEN was <> bit THEN 1 ELSE 0 END) OVER (PARTITION BY lamp, band ORDER BY frame) AS g FROM (SELECT *, lag(bit) OVER (PARTITION BY lamp, band ORDER BY frame) AS was FROM st)),
    rn AS (SELECT lamp, band, g, count(*) AS length FROM i GROUP BY ALL) SELECT lamp, band, count(*) AS n_runs, round(avg(CAST(length = 1 AS INT)), 6) AS single_share FROM (SELECT *, max(g) OVER (PARTITION BY lamp, band) AS z FROM rn) WHERE g > 0 AND g < z GROUP BY ALL""")
def r6_sweep(spark, sf):
    rows = views.thresholded(spark, sf).withColumn("band", F.explode(F.array(*map(F.lit, BANDS))))
    states = thresholds.schmitt(rows, F.col("thr"), F.col("band"), ["lamp", "band"])
    return runs.runs(states, ["lamp", "band"], False, "state").groupBy("lamp", "band").agg(F.count("*").alias("n_runs"), r6(F.avg((F.col("length") == 1).cast("double")), "single_share"))


@query("r7_subframe_edges", f"{HEAD} SELECT lamp, frame, round(frame - 1 + (thr - v0) / (v - v0), 6) AS at FROM (SELECT *, lag(v) OVER (PARTITION BY lamp ORDER BY frame) AS v0 FROM dev) WHERE (v > thr) <> (v0 > thr)")
def r7(spark, sf):
    rows = windows.lagged(views.thresholded(spark, sf), name="v0").filter((F.col("v") > F.col("thr")) != (F.col("v0") > F.col("thr")))
    return rows.select("lamp", "frame", r6(F.col("frame") - 1 + (F.col("thr") - F.col("v0")) / (F.col("v") - F.col("v0")), "at"))


@query("b1_bit_windows", f"WITH {SIGNAL}, {THR}, {win(1, '0.3')} SELECT lamp, k, lo, hi FROM win")
def b1(spark, sf):
    sizes = views.signal(spark, sf).groupBy("lamp").agg(F.count("*").alias("n"))
    return symbols.bit_windows(sizes, margin=0.3)


def decoded(rule: str):
    def run(spark, sf):
        return symbols.decode(thresholded(spark, sf), rule).select("lamp", "k", "bit", r6("margin"))

    return run


for _id, _rule, _sql in (("b2", "nearest", NEAREST), ("b3", "average", AVERAGE), ("b4", "confident", CONFIDENT)):
    query(f"{_id}_decode_{_rule}", f"{HEAD}, {win(1)}, {_sql}, {BITS} SELECT lamp, k, bit, round(margin, 6) AS margin FROM bits")(decoded(_rule))

CENTRES = f"c AS (SELECT lamp, n, k, k * {T} AS a, k * {T} + {T} AS b FROM win)"


@query("b5_decode_interpolated", f"""{HEAD}, {win(1)}, {CENTRES}, m AS (SELECT *, (a + b) / 2 AS x FROM c) SELECT m.lamp, k, round(f.d + (g.d - f.d) * (x - floor(x)), 6) AS value, CAST(f.d + (g.d - f.d) * (x - floor(x)) > 0 AS BIGINT) AS bit
    FROM m JOIN dev f ON f.lamp = m.lamp AND f.frame = CAST(floor(x) AS BIGINT) JOIN dev g ON g.lamp = m.lamp AND g.frame = least(CAST(floor(x) AS BIGINT) + 1, m.n - 1)""")
def b5(spark, sf):
    rows = thresholded(spark, sf).withColumn("d", F.col("v") - F.col("thr"))
    pairs = order.chunked(rows, ["lamp"], "frame", 0, 1, lambda w: {"next": F.coalesce(F.lead("d").over(w), F.col("d"))})
    k = F.floor(F.col("frame") / PERIOD)
    near = pairs.withColumn("k", F.explode(F.array(k - 1, k, k + 1)))
    a = F.col("k") * F.lit(PERIOD)
    x = (a + (a + PERIOD)) / 2
    near = near.filter((F.col("k") >= 0) & (F.col("k") < F.floor((F.col("n") - 1) / PERIOD)) & (F.floor(x) == F.col("frame")))
    value = F.col("d") + (F.col("next") - F.col("d")) * (x - F.floor(x))
    return near.select("lamp", "k", r6(value, "value"), (value > 0).cast("long").alias("bit"))


@query("b6_decode_weighted", f"""{HEAD}, {win(1)}, {CENTRES} SELECT c.lamp, k, round(sum(d * greatest(0, least(b, frame + 1) - greatest(a, frame))) / greatest(sum(greatest(0, least(b, frame + 1) - greatest(a, frame))), 1e-9), 6) AS value
    FROM c JOIN dev d ON d.lamp = c.lamp AND d.frame >= floor(a) AND d.frame < ceil(b) GROUP BY ALL""")
def b6(spark, sf):
    rows = thresholded(spark, sf).withColumn("d", F.col("v") - F.col("thr"))
    k = F.floor(F.col("frame") / PERIOD)
    near = rows.withColumn("k", F.explode(F.array(k - 1, k, k + 1)))
    a = F.col("k") * F.lit(PERIOD)
    b = a + PERIOD
    near = near.filter((F.col("k") >= 0) & (F.col("k") < F.floor((F.col("n") - 1) / PERIOD)) & (F.col("frame") >= F.floor(a)) & (F.col("frame") < F.ceil(b)))
    part = F.greatest(F.lit(0.0), F.least(b, F.col("frame") + 1.0) - F.greatest(a, F.col("frame").cast("double")))
    return near.groupBy("lamp", "k").agg(r6(F.sum(F.col("d") * part) / F.greatest(F.sum(part), F.lit(1e-9)), "value"))


@query("b6b_decode_true_centre", f"{HEAD}, {win(1)}, {CENTRES} SELECT c.lamp, k, round(d, 6) AS value FROM c JOIN dev d ON d.lamp = c.lamp AND d.frame = least(CAST(round_even((a + b) / 2, 0) AS BIGINT), c.n - 1)")
def b6b(spark, sf):
    rows = thresholded(spark, sf)
    k = F.floor(F.col("frame") / PERIOD)
    near = rows.withColumn("k", F.explode(F.array(k - 1, k, k + 1)))
    a = F.col("k") * F.lit(PERIOD)
    centre = F.least(F.rint((a + (a + PERIOD)) / 2), F.col("n") - 1.0)
    near = near.filter((F.col("k") >= 0) & (F.col("k") < F.floor((F.col("n") - 1) / PERIOD)) & (centre == F.col("frame")))
    return near.select("lamp", "k", r6(F.col("v") - F.col("thr"), "value"))


@query("b8_majority_vote", f"{HEAD}, {win(1)} SELECT w.lamp, k, CAST(avg(CAST(d > 0 AS INT)) > 0.5 AS BIGINT) AS bit, count(*) AS frames FROM win w JOIN dev d ON d.lamp = w.lamp AND d.frame BETWEEN w.lo AND w.hi GROUP BY ALL")
def b8(spark, sf):
    rows = symbols.served(thresholded(spark, sf), [0.0])
    return rows.groupBy("lamp", "k").agg((F.avg((F.col("v") > F.col("thr")).cast("double")) > 0.5).cast("long").alias("bit"), F.count("*").alias("frames"))


@query("b9_symbol_means", f"WITH {SIGNAL} SELECT lamp, greatest(CAST(floor((frame - CAST(0.7 AS DOUBLE)) / {T}) AS BIGINT), 0) AS k, round(avg(v), 6) AS mean FROM signal GROUP BY ALL")
def b9(spark, sf):
    return symbols.symbol_means(views.signal(spark, sf), PERIOD, 0.7).select("lamp", "k", r6("mean"))


ENS = "ens AS (SELECT lamp, k, max(bit) FILTER (phase_id = 0) AS b0, avg(bit) AS votes, min(bit) = max(bit) AS safe FROM bits GROUP BY lamp, k HAVING count(*) = 12)"


@query("b10_phase_ensemble", f"{HEAD}, {win(12)}, {CONFIDENT}, {BITS}, {ENS} SELECT lamp, k, b0, round(votes, 6) AS votes, safe FROM ens")
def b10(spark, sf):
    """The flagship: decode at 12 phases; a symbol is safe where all of them agree."""
    bits = symbols.decode(thresholded(spark, sf), "confident", symbols.phases(12))
    return symbols.ensemble(bits, 12).select("lamp", "k", "b0", r6("votes"), "safe")


@query("b11_agreement_with_majority", f"{HEAD}, {win(12)}, {NEAREST}, {BITS}, {ENS} SELECT lamp, round(avg(CAST(bit = CAST(votes > 0.5 AS BIGINT) AS INT)) * 100, 6) AS agreement_pct FROM bits JOIN ens USING (lamp, k) GROUP BY lamp")
def b11(spark, sf):
    bits = symbols.decode(thresholded(spark, sf), "nearest", symbols.phases(12))
    # equal to the majority: the larger share of the votes
    votes = symbols.ensemble(bits, 12)
    return votes.groupBy("lamp").agg(r6(F.avg(F.when(F.col("votes") > 0.5, F.col("votes")).otherwise(1 - F.col("votes"))) * 100, "agreement_pct"))


@query("b13_phase_by_margin", f"{HEAD}, {win(60)}, {CONFIDENT}, sc AS (SELECT lamp, phase_id, round(avg(abs(x)), 6) AS score FROM val GROUP BY ALL) SELECT lamp, phase_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lamp ORDER BY score DESC, phase_id) AS i FROM sc) WHERE i = 1")
def b13(spark, sf):
    bits = symbols.decode(thresholded(spark, sf), "confident", symbols.phases(60))
    scores = bits.groupBy("lamp", "phase_id").agg(r6(F.avg("margin"), "score"))
    return scores.groupBy("lamp").agg(F.max_by("phase_id", F.struct("score", -F.col("phase_id"))).alias("phase_id"), F.max("score").alias("score"))


def agreements_sql(a: str, b: str) -> str:
    return f"SELECT lamp, max(s) AS s FROM (SELECT x.lamp, off, avg(CAST(x.bit = y.bit AS INT)) AS s FROM {a} x JOIN (SELECT unnest([-1, 0, 1]) AS off) o ON true JOIN {b} y ON y.lamp = x.lamp AND y.k + off = x.k GROUP BY ALL) GROUP BY lamp"


@query("b16_rule_agreement", f"{HEAD}, {win(1)}, {NEAREST}, a AS (SELECT lamp, k, CAST(x > 0 AS BIGINT) AS bit FROM val), {CONFIDENT.replace('val AS', 'val2 AS')}, b AS (SELECT lamp, k, CAST(x > 0 AS BIGINT) AS bit FROM val2) SELECT lamp, round(s, 6) AS agreement FROM ({agreements_sql('a', 'b')})")
def b16(spark, sf):
    rows = thresholded(spark, sf)
    return symbols.agreement(symbols.decode(rows, "nearest"), symbols.decode(rows, "confident")).select("lamp", r6("agreement"))


BITS0 = f"{HEAD}, {win(1)}, {NEAREST}, {BITS}"


@query("a20_stream_stats", f"""{BITS0}, st AS (SELECT lamp, k AS frame, bit FROM bits), {ISLANDS.replace('FROM bin', 'FROM st')}
    SELECT lamp, CAST(sum(length) AS BIGINT) AS n_bits, round(100.0::DOUBLE * sum(bit * length) / sum(length), 6) AS ones_pct, round(100.0::DOUBLE * (count(*) - 1) / (sum(length) - 1), 6) AS flip_rate_pct, max(length) AS longest_run, round(avg(length), 6) AS mean_run_bits FROM rn GROUP BY lamp""")
def a20(spark, sf):
    return runs.stream_stats(symbols.decode(thresholded(spark, sf), "nearest"), frame="k")


@query("a19_margin_stats", f"{BITS0} SELECT lamp, round(median(margin) / max(span) * 100, 6) AS median_pct, round(min(margin) / max(span) * 100, 6) AS worst_pct, round(avg(CAST(margin < 0.05 * span AS INT)) * 100, 6) AS below_5_pct, round(avg(CAST(margin < 0.15 * span AS INT)) * 100, 6) AS below_15_pct FROM bits JOIN stats USING (lamp) GROUP BY lamp")
def a19(spark, sf):
    rows = thresholded(spark, sf)
    span = rows.groupBy("lamp").agg(F.max("span").alias("span"))
    bits = staged(symbols.decode(rows, "nearest").join(span, "lamp"))
    middle = thresholds.quantiles(bits, ["lamp"], "margin", middle=0.5)
    return bits.join(middle, "lamp").groupBy("lamp").agg(r6(F.max("middle") / F.max("span") * 100, "median_pct"), r6(F.min("margin") / F.max("span") * 100, "worst_pct"), *[r6(F.avg((F.col("margin") < p * F.col("span")).cast("double")) * 100, f"below_{round(100 * p)}_pct") for p in (0.05, 0.15)])


def shifted_bits(phase: str, thr: str, name: str) -> str:
    w = f"ceil({phase} + k * {T})"
    return f"""{name} AS (SELECT lamp, k, CAST(v > thr + {thr} AS BIGINT) AS bit FROM (SELECT lamp, n, thr, span, unnest(range(CAST(floor((n - {phase} - 1) / {T}) AS BIGINT))) AS k FROM stats) s
      JOIN signal g USING (lamp) WHERE g.frame = CAST(least(greatest(round_even({w} - CAST(0.5 AS DOUBLE) + {T} / 2, 0), 0), n - 1) AS BIGINT))"""


@query("b17_indicators", f"""{HEAD}, {win(12)}, {NEAREST}, {BITS}, {ENS}, z AS (SELECT lamp, k, b0 AS bit FROM ens), {shifted_bits(f"(((-0.15::DOUBLE * {T}) % {T}) + {T}) % {T}", "0", "pa")}, {shifted_bits(f"((0.15::DOUBLE * {T}) % {T})", "0", "pb")}, {shifted_bits("0", "-0.1::DOUBLE * span", "ta")}, {shifted_bits("0", "0.1::DOUBLE * span", "tb")},
    e AS (SELECT lamp, count(*) AS n_bits, avg(CAST(safe AS INT)) * 100 AS safe_pct, avg(b0) * 100 AS ones_pct FROM ens GROUP BY lamp), f AS (SELECT lamp, avg(CAST(bit <> was AS INT)) * 100 AS flip_pct FROM (SELECT *, lag(bit) OVER (PARTITION BY lamp ORDER BY k) AS was FROM z) WHERE was IS NOT NULL GROUP BY lamp),
    m AS (SELECT lamp, median(margin) / max(span) * 100 AS median_margin_pct FROM bits JOIN stats USING (lamp) SEMI JOIN ens USING (lamp, k) WHERE phase_id = 0 GROUP BY lamp), s1 AS ({agreements_sql('z', 'pa')}), s2 AS ({agreements_sql('z', 'pb')}), s3 AS ({agreements_sql('z', 'ta')}), s4 AS ({agreements_sql('z', 'tb')})
    SELECT lamp, n_bits, round(safe_pct, 6) AS safe_pct, round((s1.s + s2.s) * 50, 6) AS phase_stability_pct, round((s3.s + s4.s) * 50, 6) AS threshold_tolerance_pct, round(median_margin_pct, 6) AS median_margin_pct, round(ones_pct, 6) AS ones_pct, round(flip_pct, 6) AS flip_pct
    FROM e JOIN f USING (lamp) JOIN m USING (lamp) JOIN s1 USING (lamp) JOIN s2 USING (lamp) JOIN s3 USING (lamp) JOIN s4 USING (lamp)""")
def b17(spark, sf):
    return indicators(thresholded(spark, sf), "nearest").select("lamp", "n_bits", *[r6(c) for c in ("safe_pct", "phase_stability_pct", "threshold_tolerance_pct", "median_margin_pct", "ones_pct", "flip_pct")])


def indicators(rows: DataFrame, rule: str, margin: float = 0.0, n_phases: int = 12, shift: float = 0.1, keys: tuple[str, ...] = ("lamp",)) -> DataFrame:
    """How far a decode can be trusted: safe share, stability under shifts of phase and threshold, margins, ones, flips.

    rows: keys, frame, v, thr, n, span. Several keys give one row each, so a grid of settings is one query. All phases
    and shifted variants are decoded in one pass over the rows, whose bits are written once.
    """
    keys = list(keys)
    at = [*symbols.phases(n_phases), (-0.15 * PERIOD) % PERIOD, (0.15 * PERIOD) % PERIOD, 0.0, 0.0]
    bits = staged(symbols.decode(rows, rule, at, margin=margin, keys=keys, shifts=[0.0] * (n_phases + 2) + [-shift, shift]), "bits")
    own = bits.filter(F.col("phase_id") < n_phases)
    first = F.col("phase_id") == 0
    ens = own.groupBy(*keys, "k").agg(F.count("*").alias("c"), F.max(F.when(first, F.col("bit"))).alias("bit"), F.max(F.when(first, F.col("margin"))).alias("margin"), (F.min("bit") == F.max("bit")).alias("safe"))
    ens = staged(ens.filter(F.col("c") == n_phases), "ensemble")
    out = ens.groupBy(*keys).agg(F.count("*").alias("n_bits"), (F.avg(F.col("safe").cast("double")) * 100).alias("safe_pct"), (F.avg("bit") * 100).alias("ones_pct"))
    same = symbols.agreement(ens.select(*keys, "k", "bit"), bits.filter(F.col("phase_id") >= n_phases), keys=keys, more=["phase_id"])
    half = lambda a, b: (F.max(F.when(F.col("phase_id") == a, F.col("agreement"))) + F.max(F.when(F.col("phase_id") == b, F.col("agreement")))) * 50
    out = out.join(same.groupBy(*keys).agg(half(n_phases, n_phases + 1).alias("phase_stability_pct"), half(n_phases + 2, n_phases + 3).alias("threshold_tolerance_pct")), keys)
    span = rows.groupBy(*keys).agg(F.max("span").alias("span"))
    middle = thresholds.quantiles(ens, keys, "margin", middle=0.5)
    out = out.join(middle.join(span, keys).select(*keys, (F.col("middle") / F.col("span") * 100).alias("median_margin_pct")), keys)
    flips = windows.lagged(ens.select(*keys, "k", "bit"), keys, v="bit", frame="k").filter("before is not null").groupBy(*keys).agg((F.avg((F.col("bit") != F.col("before")).cast("double")) * 100).alias("flip_pct"))
    return out.join(flips, keys)


QUERIES, ORACLES = book.queries, book.oracles

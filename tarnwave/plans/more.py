"""Queries of decoding variants, context of symbols, tolerance sweeps, regions, learned models and cleaning studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwave.operators import clock, frames, learn, order, runs, similar, symbols, synth, thresholds, windows
from tarnwave.operators.symbols import PERIOD
from tarnwave.plans.base import BITS, CONFIDENT, DEV, NEAREST, THR, Book, T, r6
from tarnwave.plans.base import windows as win
from tarnwave.plans.clock import BITS01, EDGES, HEAD, MODEL_SQL_M3, SHORT, edge_frames, features, modelled, shorts
from tarnwave.plans.core import LIT, QUARTER, agreements_sql, binary, moving_sql, thresholded
from tarnwave.sources import views
from tarnwave.sources.stage import staged
from tarnwave.sources.views import ARR_LABEL, PIXELS, SIGNAL, TRUTH

book = Book()
query = book.query
#: Bits in which near frames' hashes differ at most.
NEAR_BITS = 19


def shifted_window(name: str, shift: float) -> str:
    """CTE of the confident rule's bits at another phase (a share of a symbol)."""
    ph = f"((({shift}::DOUBLE * {T}) % {T}) + {T}) % {T}"
    return f"{name} AS (SELECT lamp, k, CAST(d > 0 AS BIGINT) AS bit FROM (SELECT w.lamp, k, d, row_number() OVER (PARTITION BY w.lamp, k ORDER BY abs(d) DESC, e.frame) AS i FROM (SELECT lamp, k, ceil({ph} + k * {T}) AS lo, floor({ph} + k * {T} + {T}) AS hi FROM (SELECT lamp, unnest(range(CAST(floor((n - {ph} - 1) / {T}) AS BIGINT))) AS k FROM stats)) w JOIN dev e ON e.lamp = w.lamp AND e.frame BETWEEN lo AND greatest(lo, hi)) WHERE i = 1)"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("p2_lit_frames", f"WITH {PIXELS} SELECT frame, count(*) AS lit_px FROM pixels WHERE v > 0.15::DOUBLE GROUP BY frame HAVING count(*) > 8")
def p2(spark, sf):
    px = views.frames(spark, sf).select("frame", frames.above(F.col("pixels"), F.lit(0.15)).alias("lit_px"))
    return px.filter("lit_px > 8")


@query("p4_near_threshold", f"WITH {SIGNAL}, {THR}, {DEV} SELECT lamp, round(avg(CAST(abs(d) < 25 AS INT)) * 100, 6) AS near_pct, round(avg(CAST(v BETWEEN 60 AND 190 AS INT)) * 100, 6) AS mid_pct FROM dev GROUP BY lamp")
def p4(spark, sf):
    rows = thresholded(spark, sf)
    return rows.groupBy("lamp").agg(r6(F.avg((F.abs(F.col("v") - F.col("thr")) < 25).cast("double")) * 100, "near_pct"), r6(F.avg(F.col("v").between(60, 190).cast("double")) * 100, "mid_pct"))


@query("w9_duplicate_frames", f"WITH {ARR_LABEL}, h AS (SELECT frame, label, px, array_to_string(list_transform(px, lambda x: CASE WHEN x > list_avg(px) THEN '1' ELSE '0' END), '') AS hash FROM fr), q AS (SELECT *, lag(px) OVER w AS was, lag(hash) OVER w AS before FROM h WINDOW w AS (PARTITION BY label ORDER BY frame)) SELECT label, count(*) FILTER (px = was) AS duplicates, count(*) FILTER (hamming(hash, before) <= 12) AS alike, CAST(min(hamming(hash, before)) AS BIGINT) AS nearest, count(*) AS n FROM q GROUP BY label")
def w9(spark, sf):
    """Frames that repeat the whole frame before of their label, and those whose average hash is near it."""
    f = views.frames(spark, sf).select("frame", F.col("label").cast("long").alias("label"), "pixels", frames.average_hash(F.col("pixels")).alias("hash"))
    rows = order.numbered(f, ["label"], ["frame"], "i")
    rows = order.chunked(rows, ["label"], "i", 1, 0, lambda w: {"was": F.lag("pixels").over(w), "before": F.lag("hash").over(w)})
    far = frames.hamming(F.col("hash"), F.col("before"))
    return rows.groupBy("label").agg(F.count_if(F.col("pixels") == F.col("was")).alias("duplicates"), F.count_if(far <= 12).alias("alike"), F.min(F.when(F.col("before").isNotNull(), far)).alias("nearest"), F.count("*").alias("n"))


@query("f8_near_frames", f"WITH {ARR_LABEL}, h AS (SELECT frame, array_to_string(list_transform(px, lambda x: CASE WHEN x > list_avg(px) THEN '1' ELSE '0' END), '') AS hash FROM fr), c AS (SELECT hash, count(*) AS frames, min(frame) AS first FROM h GROUP BY hash) SELECT least(a.first, b.first) AS a, greatest(a.first, b.first) AS b, CAST(hamming(a.hash, b.hash) AS BIGINT) AS distance, a.frames + b.frames AS frames FROM c a JOIN c b ON a.hash < b.hash AND hamming(a.hash, b.hash) <= {NEAR_BITS}")
def f8_near(spark, sf):
    """Frames anywhere whose average hashes differ in NEAR_BITS bits at most; frames of one hash are told by the first one."""
    f = views.frames(spark, sf).select("frame", frames.hash_long(frames.average_hash(F.col("pixels"))).alias("hash"))
    pairs, members = similar.near_hashes(f, NEAR_BITS, bands=8)
    side = lambda s: members.select(F.col("hash").alias(s), F.col("first").alias(f"f{s}"), F.col("frames").alias(f"n{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), "distance", (F.col("na") + F.col("nb")).alias("frames"))


@query("b14_phase_by_eye", f"WITH {SIGNAL}, {THR}, {DEV}, p AS (SELECT i, i * 0.02::DOUBLE AS ph FROM range(142) t(i)), k AS (SELECT lamp, i, ph, unnest(range(CAST(ceil((n - 1 - (ph + {T} / 2)) / {T}) AS BIGINT))) AS k FROM stats, p), s AS (SELECT k.lamp, i, round(avg(abs(d)), 6) AS score FROM k JOIN dev d ON d.lamp = k.lamp AND d.frame = CAST(round_even(ph + {T} / 2 + k * {T}, 0) AS BIGINT) GROUP BY ALL) SELECT lamp, CAST(i AS BIGINT) AS phase_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lamp ORDER BY score DESC, i) AS r FROM s) WHERE r = 1")
def b14(spark, sf):
    settings = [(i * 0.02 + PERIOD / 2, PERIOD) for i in range(142)]
    s = clock.sampled_mean(thresholded(spark, sf), settings, F.abs(F.col("v") - F.col("thr"))).select("lamp", F.col("i").cast("long").alias("i"), r6("mean", "score"))
    return s.groupBy("lamp").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("phase_id"), F.max("score").alias("score"))


@query("b18_window_context", f"WITH {SIGNAL}, {THR}, {DEV}, {win(1)} SELECT w.lamp, k, count(*) FILTER (abs(d) > 0.35 * span) AS clean, bool_or(d > 0.35 * span) AND bool_or(d < -0.35 * span) AS both_levels FROM win w JOIN dev d ON d.lamp = w.lamp AND d.frame BETWEEN lo AND hi GROUP BY ALL")
def b18(spark, sf):
    rows = thresholded(spark, sf).withColumn("d", F.col("v") - F.col("thr"))
    need = 0.35 * F.col("span")
    return symbols.served(rows, [0.0]).groupBy("lamp", "k").agg(F.count_if(F.abs("d") > need).alias("clean"), (F.bool_or(F.col("d") > need) & F.bool_or(F.col("d") < -need)).alias("both_levels"))


@query("b19_disagreements", f"WITH {SIGNAL}, {THR}, {DEV}, {win(1)}, {NEAREST}, {CONFIDENT.replace('val AS', 'val2 AS')}, x AS (SELECT a.lamp, a.k, row_number() OVER (PARTITION BY a.lamp ORDER BY a.k) AS i FROM val a JOIN val2 b USING (lamp, k) WHERE (a.x > 0) <> (b.x > 0)) SELECT x.lamp, x.k, i AS place, string_agg(CAST(CAST(round(v) AS BIGINT) AS VARCHAR), ' ' ORDER BY d.frame) AS context FROM x JOIN win w USING (lamp, k) JOIN dev d ON d.lamp = x.lamp AND d.frame BETWEEN lo - 1 AND hi + 1 WHERE i <= 6 GROUP BY ALL")
def b19(spark, sf):
    """The first six symbols of each channel on which two rules differ, with the frames around them: a report."""
    rows = thresholded(spark, sf)
    a = symbols.decode(rows, "nearest").select("lamp", "k", "bit")
    b = symbols.decode(rows, "confident").select("lamp", "k", F.col("bit").alias("other"))
    first = order.numbered(a.join(b, ["lamp", "k"]).filter("bit <> other").select("lamp", "k"), ["lamp"], ["k"], "i").filter("i < 6")
    lo, hi = symbols.window(F.lit(0.0), F.col("k"), PERIOD)
    around = first.select("lamp", "k", (F.col("i") + 1).alias("place"), F.explode(F.sequence(lo - 1, hi + 1)).alias("frame"))
    got = around.join(rows.select("lamp", "frame", "v"), ["lamp", "frame"]).groupBy("lamp", "k", "place").agg(F.array_sort(F.collect_list(F.struct("frame", F.round("v").cast("long").cast("string").alias("t")))).alias("x"))
    return got.select("lamp", "k", "place", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("context"))


ADAPTIVE = moving_sql(QUARTER, False, "(lo + hi) / 2 AS thr", ("0.1", "0.9")).removeprefix(f"WITH {SIGNAL}, ").replace("SELECT lamp, frame, (lo", ", ad AS (SELECT lamp, frame, (lo") + ")"


def own_phase_sql(bits: str, name: str) -> str:
    return f"{name} AS (SELECT b.lamp, b.k, b.bit FROM {bits} b JOIN (SELECT lamp, phase_id FROM (SELECT lamp, phase_id, row_number() OVER (PARTITION BY lamp ORDER BY s DESC, phase_id) AS r FROM (SELECT lamp, phase_id, round(avg(margin), 6) AS s FROM {bits} GROUP BY lamp, phase_id)) WHERE r = 1) USING (lamp, phase_id))"


@query("b20_fixed_vs_adaptive", f"WITH {SIGNAL}, {THR}, {DEV}, {win(12)}, {NEAREST}, {BITS}, {ADAPTIVE}, bits2 AS (SELECT w.lamp, phase_id, k, CAST(v > ad.thr AS BIGINT) AS bit, abs(v - ad.thr) AS margin FROM win w JOIN dev d ON d.lamp = w.lamp AND d.frame = CAST(least(greatest(round_even(w.lo - CAST(0.5 AS DOUBLE) + {T} / 2, 0), 0), w.n - 1) AS BIGINT) JOIN ad ON ad.lamp = d.lamp AND ad.frame = d.frame), {own_phase_sql('bits', 'oa')}, {own_phase_sql('bits2', 'ob')}, za AS (SELECT lamp, k, bit FROM bits WHERE phase_id = 0), zb AS (SELECT lamp, k, bit FROM bits2 WHERE phase_id = 0), s1 AS ({agreements_sql('za', 'zb')}), s2 AS ({agreements_sql('oa', 'ob')}) SELECT s1.lamp, round(s1.s, 6) AS same_phase, round(s2.s, 6) AS own_phase FROM s1 JOIN s2 USING (lamp)")
def b20(spark, sf):
    """Agreement of decodes under the fixed and the moving threshold: both at phase 0, and each at its phase of largest margin."""
    s = thresholded(spark, sf)
    both = [staged(symbols.decode(x, "nearest", symbols.phases(12))) for x in (s, thresholds.adaptive(s.drop("thr")))]

    def own(bits: DataFrame) -> DataFrame:
        scores = bits.groupBy("lamp", "phase_id").agg(r6(F.avg("margin"), "score"))
        return bits.join(scores.groupBy("lamp").agg(F.max_by("phase_id", F.struct("score", -F.col("phase_id"))).alias("phase_id")), ["lamp", "phase_id"])

    same = symbols.agreement(*[x.filter("phase_id = 0") for x in both]).select("lamp", r6("agreement", "same_phase"))
    return same.join(symbols.agreement(*map(own, both)).select("lamp", r6("agreement", "own_phase")), "lamp")


def diagnosed(rows: DataFrame) -> DataFrame:
    """What the second decoder tells of a decode at phase 0 beside its bits. rows: lamp, frame, v, thr, n, span."""
    bits = staged(symbols.decode(rows, "confident", symbols.phases(12)), "bits")
    first = F.col("phase_id") == 0
    ens = bits.groupBy("lamp", "k").agg(F.count("*").alias("c"), F.avg("bit").alias("votes"), F.max(F.when(first, F.col("bit"))).alias("bit"), F.max(F.when(first, F.col("margin"))).alias("margin"), (F.min("bit") == F.max("bit")).alias("safe"))
    ens = staged(windows.lagged(ens.filter("c = 12"), v="bit", frame="k"))
    pct = lambda c, name: r6(F.avg(c.cast("double")) * 100, name)
    out = ens.groupBy("lamp").agg(F.count("*").alias("n_bits"), pct(F.col("safe"), "safe_bits_pct"), pct(F.col("bit"), "ones_pct"), pct(F.when(F.col("safe"), F.col("bit")), "ones_pct_safe_only"), pct(F.col("bit") != F.col("before"), "flip_rate_pct"), pct(F.greatest("votes", 1 - F.col("votes")), "agreement_across_phases_pct"))
    middle = thresholds.quantiles(ens, ["lamp"], "margin", middle=0.5).join(rows.groupBy("lamp").agg(F.max("span").alias("span")), "lamp")
    return out.join(middle.select("lamp", r6(F.col("middle") / F.col("span") * 100, "median_margin_pct")), "lamp")


ENS12 = f"{win(12)}, {CONFIDENT}, {BITS}, ens AS (SELECT lamp, k, max(bit) FILTER (phase_id = 0) AS bit, max(margin) FILTER (phase_id = 0) AS margin, avg(bit) AS votes, min(bit) = max(bit) AS safe FROM bits GROUP BY lamp, k HAVING count(*) = 12)"


@query("b12_decode_with_diagnostics", f"WITH {SIGNAL}, {THR}, {DEV}, {ENS12} SELECT lamp, count(*) AS n_bits, round(avg(CAST(safe AS INT)) * 100, 6) AS safe_bits_pct, round(avg(bit) * 100, 6) AS ones_pct, round(avg(bit) FILTER (safe) * 100, 6) AS ones_pct_safe_only, round(avg(CAST(bit <> was AS INT)) * 100, 6) AS flip_rate_pct, round(avg(greatest(votes, 1 - votes)) * 100, 6) AS agreement_across_phases_pct, round(median(margin) / max(span) * 100, 6) AS median_margin_pct FROM (SELECT *, lag(bit) OVER (PARTITION BY lamp ORDER BY k) AS was FROM ens) JOIN stats USING (lamp) GROUP BY lamp")
def b12(spark, sf):
    return diagnosed(thresholded(spark, sf))


@query("b15_phase_stability", f"WITH {SIGNAL}, {THR}, {DEV}, {win(1)}, {CONFIDENT}, {BITS}, {shifted_window('b1s', -0.15)}, {shifted_window('b2s', 0.15)} SELECT lamp, round(avg(CAST(bits.bit = b1s.bit AS INT)) * 100, 6) AS earlier_pct, round(avg(CAST(bits.bit = b2s.bit AS INT)) * 100, 6) AS later_pct FROM bits LEFT JOIN b1s USING (lamp, k) LEFT JOIN b2s USING (lamp, k) GROUP BY lamp")
def b15(spark, sf):
    """Bits that stay as they are, at the same place, when the phase moves by 0.15 of a symbol."""
    at = [0.0, (-0.15 * PERIOD) % PERIOD, (0.15 * PERIOD) % PERIOD]
    three = symbols.decode(thresholded(spark, sf), "confident", at).groupBy("lamp", "k").agg(*[F.max(F.when(F.col("phase_id") == i, F.col("bit"))).alias(f"b{i}") for i in range(3)])
    same = lambda i, name: r6(F.avg((F.col("b0") == F.col(f"b{i}")).cast("double")) * 100, name)
    return three.groupBy("lamp").agg(same(1, "earlier_pct"), same(2, "later_pct"))


@query("a23_confidence_shares", MODEL_SQL_M3 + f", {ENS12.replace('val AS', 'val9 AS').replace('FROM val)', 'FROM val9)')} SELECT lamp, count(*) AS n_bits, round(avg(CAST(m.bit = e.bit AS INT)) FILTER (safe) * 100, 6) AS agree_safe_pct, round(avg(CAST(m.bit = e.bit AS INT)) FILTER (NOT safe) * 100, 6) AS agree_unsafe_pct, round(avg(CAST(confidence > 0.9 AS INT)) * 100, 6) AS confident_pct, round(avg(CAST(confidence > 0.9 AND NOT safe AS INT)) * 100, 6) AS confident_and_unsafe_pct FROM m JOIN ens e USING (lamp, k) GROUP BY lamp")
def a23(spark, sf):
    """How sure a stored model is of its bits, also where the phases of the threshold rule disagree."""
    rows = thresholded(spark, sf)
    ens = symbols.ensemble(symbols.decode(rows, "confident", symbols.phases(12)), 12).select("lamp", "k", F.col("b0"), "safe")
    both = modelled(rows).join(ens, ["lamp", "k"])
    same, sure = (F.col("bit") == F.col("b0")).cast("double"), F.col("confidence") > 0.9
    pct = lambda c, name: r6(F.avg(c.cast("double")) * 100, name)
    return both.groupBy("lamp").agg(F.count("*").alias("n_bits"), pct(F.when(F.col("safe"), same), "agree_safe_pct"), pct(F.when(~F.col("safe"), same), "agree_unsafe_pct"), pct(sure, "confident_pct"), pct(sure & ~F.col("safe"), "confident_and_unsafe_pct"))


@query("b21_pair_alternation", f"WITH {SIGNAL}, {THR}, {DEV}, {win(1)}, {NEAREST}, {BITS} SELECT a.lamp, round(avg(CAST(a.bit <> b.bit AS INT)), 6) AS alternating FROM bits a JOIN bits b ON b.lamp = a.lamp AND b.k = a.k + 1 WHERE a.k % 2 = 0 GROUP BY a.lamp")
def b21(spark, sf):
    """Manchester test: how often the two symbols of a pair differ."""
    bits = symbols.decode(thresholded(spark, sf), "nearest")
    pair = bits.groupBy("lamp", F.floor(F.col("k") / 2).alias("pair")).agg(F.count("*").alias("n"), (F.min("bit") != F.max("bit")).alias("alternates")).filter("n = 2")
    return pair.groupBy("lamp").agg(r6(F.avg(F.col("alternates").cast("double")), "alternating"))


@query("b22_printable_share", f"WITH {SIGNAL}, {THR}, {DEV}, {win(1)}, {NEAREST}, {BITS}, c AS (SELECT lamp, a.off, (k - a.off) // 8 AS c, sum(bit << (7 - (k - a.off) % 8)) AS code, count(*) AS n FROM bits, range(4) a(off) WHERE k >= a.off GROUP BY ALL) SELECT lamp, CAST(off AS BIGINT) AS alignment, round(avg(CAST(code BETWEEN 32 AND 126 AS INT)), 6) AS printable FROM c WHERE n = 8 GROUP BY lamp, off")
def b22(spark, sf):
    bits = symbols.decode(thresholded(spark, sf), "nearest").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).filter("k >= a")
    at = F.col("k") - F.col("a")
    code = F.sum(F.col("bit") * F.pow(F.lit(2), 7 - at % 8).cast("long"))
    c = bits.groupBy("lamp", "a", F.floor(at / 8).alias("c")).agg(code.alias("code"), F.count("*").alias("n")).filter("n = 8")
    return c.groupBy("lamp", F.col("a").alias("alignment")).agg(r6(F.avg(F.col("code").between(32, 126).cast("double")), "printable"))


@query("c5_glitch_repeat_lags", f"{HEAD}, {SHORT}, v AS (SELECT DISTINCT lamp, frame + d AS frame FROM short, nn, (SELECT unnest([-1, 0, 1]) AS d) WHERE frame < n AND frame + d BETWEEN 0 AND n - 1), tr AS (SELECT f.frame, CAST(coalesce(c, 0) >= 3 AS INT) AS t FROM (SELECT unnest(range(n)) AS frame FROM nn) f LEFT JOIN (SELECT frame, count(*) AS c FROM v GROUP BY frame) USING (frame)), x AS (SELECT frame, t - avg(t) OVER () AS x FROM tr), z AS (SELECT sum(x * x) AS z FROM x), ac AS (SELECT l.lag, sum(a.x * b.x) / max(z) AS ac FROM x a JOIN range(1, 101) l(lag) ON true JOIN x b ON b.frame = a.frame + l.lag, z GROUP BY l.lag) SELECT lag, round(ac, 6) AS ac, row_number() OVER (ORDER BY round(ac, 6) DESC, lag) AS place FROM (SELECT CAST(lag AS BIGINT) AS lag, ac, lag(round(ac, 6)) OVER (ORDER BY ac.lag) AS l, lead(round(ac, 6)) OVER (ORDER BY ac.lag) AS r FROM ac) WHERE lag BETWEEN 4 AND 99 AND round(ac, 6) > l AND round(ac, 6) >= r ORDER BY place LIMIT 5")
def c5(spark, sf):
    """The five largest local peaks of the vote track's autocorrelation at lags 4 to 99."""
    n = views.signal(spark, sf).groupBy("lamp").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    s = shorts(spark, sf).crossJoin(F.broadcast(n)).filter("frame < n")
    v = s.select("lamp", "n", F.explode(F.array(*[F.col("frame") + d for d in (-1, 0, 1)])).alias("k")).filter("k between 0 and n - 1").distinct()
    votes = v.groupBy("k").agg(F.count("*").alias("c"))
    track = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).join(votes, "k", "left").select(F.lit("all").alias("lamp"), "k", (F.coalesce("c", F.lit(0)) >= 3).cast("double").alias("t"))
    ac = staged(clock.all_lags_of(staged(track), "t").filter(F.col("lag").between(1, 100)).select("lamp", "lag", r6("ac")))
    peaks = windows.local_peaks(ac, v="ac", frame="lag").filter(F.col("lag").between(4, 99))
    # lags of one short table
    place = F.row_number().over(Window.partitionBy("lamp").orderBy(F.desc("ac"), "lag")).cast("long")
    return peaks.withColumn("place", place).filter("place <= 5").select("lag", "ac", "place")


@query("c8_beat_candidates", f"{HEAD}, {LIT}, {EDGES}, g AS (SELECT round(1.8::DOUBLE + i * 0.005::DOUBLE, 3) AS period FROM range(300) t(i)), c AS (SELECT period, period / abs(period - round_even(period, 0)) AS beat FROM g WHERE abs(period - round_even(period, 0)) > 1e-6) SELECT lamp, period, round(avg(abs(frame / period - round_even(frame / period, 0)) * period), 6) AS distance, round(max(beat), 1) AS beat FROM edges, c WHERE beat > 19.5 AND beat < 21.5 GROUP BY lamp, period")
def c8(spark, sf):
    """Periods whose distance to a whole number of frames beats every 19.5 to 21.5 frames, and edges of each on its grid."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.round(F.lit(1.8) + i * F.lit(0.005), 3)))
    t = F.col("period")
    d = F.abs(t - F.rint(t))
    rows = edge_frames(spark, sf).withColumn("period", grid).filter((d > 1e-6) & (t / d > 19.5) & (t / d < 21.5))
    return rows.groupBy("lamp", "period").agg(r6(F.avg(clock.grid_distance(F.col("frame").cast("double"), t, F.lit(0.0))), "distance"), F.round(F.first(t / d), 1).alias("beat"))


@query("c10_distinct_best", f"WITH RECURSIVE {SIGNAL}, {THR}, {DEV}, {LIT}, {EDGES}, g AS (SELECT lamp, frame, 1.2::DOUBLE + p.i * 0.05::DOUBLE AS period FROM edges, range(96) p(i)), d AS (SELECT lamp, period, q.j, avg(abs((frame - q.j * (period / 40)) / period - round_even((frame - q.j * (period / 40)) / period, 0)) * period) AS d FROM g, range(40) q(j) GROUP BY ALL), s AS (SELECT lamp, period, row_number() OVER (PARTITION BY lamp ORDER BY round(min(d), 9), period) AS i FROM d GROUP BY lamp, period), r AS (SELECT lamp, 0::BIGINT AS i, []::DOUBLE[] AS best FROM (SELECT DISTINCT lamp FROM s) UNION ALL SELECT r.lamp, s.i, CASE WHEN len(best) < 6 AND len(list_filter(best, lambda y: abs(y - s.period) < 0.2)) = 0 THEN list_append(best, s.period) ELSE best END FROM r JOIN s ON s.lamp = r.lamp AND s.i = r.i + 1) SELECT lamp, unnest(range(len(best))) AS place, round(unnest(best), 6) AS period FROM r WHERE i = 96")
def c10(spark, sf):
    """The six best periods of each channel that lie at least 0.2 apart: greedy, over one short row of candidates."""
    s = clock.grid_score(edge_frames(spark, sf), clock.period_grid(1.2, 96, 0.05), 40)
    ranked = s.groupBy("lamp").agg(F.array_sort(F.collect_list(F.struct(F.round("score", 9).alias("score"), "period"))).alias("c"))
    far = lambda acc, x: F.when((F.size(acc) < 6) & ~F.exists(acc, lambda y: F.abs(y - x["period"]) < 0.2), F.array_append(acc, x["period"])).otherwise(acc)
    best = ranked.select("lamp", F.aggregate("c", F.array().cast("array<double>"), far).alias("best"))
    return best.select("lamp", F.posexplode("best").alias("place", "period")).select("lamp", F.col("place").cast("long").alias("place"), r6("period"))


MODEL_GRID = [(t, d) for t in (1.8, 2.2, 2.6, 3.0) for d in (0.3, 0.6)]
MODEL_SQL = f"""bits AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, CAST(('0x' || substr(md5('5:' || CAST(doc_id AS VARCHAR)), 1, 1))::BIGINT % 2 AS BIGINT) AS bit FROM documents), mg AS (SELECT * FROM (VALUES {', '.join(f"('{t}:{d}', {t}::DOUBLE, {d}::DOUBLE)" for t, d in MODEL_GRID)}) g(stream, t, d)),
    mf AS (SELECT stream, t, d, unnest(range(CAST(floor(n * t) AS BIGINT) - 1)) AS frame FROM mg, (SELECT count(*) AS n FROM bits)), mb AS (SELECT stream AS lamp, frame, CAST(sum(bit * greatest(0, least(frame + d, (k + 1) * t) - greatest(frame, k * t))) / max(d) > 0.5 AS BIGINT) AS bit FROM mf JOIN bits ON k BETWEEN CAST(floor(frame / t) AS BIGINT) - 1 AND CAST(floor((frame + d) / t) AS BIGINT) + 1 GROUP BY ALL)"""


def run_shares_sql(source: str, name: str) -> str:
    return f"{name}i AS (SELECT *, sum(CASE WHEN was <> bit THEN 1 ELSE 0 END) OVER (PARTITION BY lamp ORDER BY frame) AS g FROM (SELECT lamp, frame, bit, lag(bit) OVER (PARTITION BY lamp ORDER BY frame) AS was FROM {source})), {name}r AS (SELECT lamp, g, least(count(*), 8) AS length, max(g) OVER (PARTITION BY lamp) AS z FROM {name}i GROUP BY lamp, g), {name} AS (SELECT lamp, length, count(*) / sum(count(*)) OVER (PARTITION BY lamp) AS p FROM {name}r WHERE g > 0 AND g < z GROUP BY lamp, length)"


@query("c18_run_length_misfit", f"{HEAD}, {LIT}, {MODEL_SQL}, {run_shares_sql('bin', 'sa')}, {run_shares_sql('mb', 'sb')} SELECT a.lamp, b.lamp AS stream, round(sum(power(coalesce(x.p, 0) - coalesce(y.p, 0), 2) / (coalesce(x.p, 0) + coalesce(y.p, 0) + 1e-9)), 6) AS misfit FROM (SELECT DISTINCT lamp FROM sa) a, (SELECT DISTINCT lamp FROM sb) b, range(1, 9) l(length) LEFT JOIN sa x ON x.lamp = a.lamp AND x.length = l.length LEFT JOIN sb y ON y.lamp = b.lamp AND y.length = l.length GROUP BY a.lamp, b.lamp")
def c18(spark, sf):
    """How far each channel's run lengths lie from those of a clocked stream, over periods and exposures (columns of one synthesis)."""
    bits = views.read(spark, sf, "documents").select(F.lit("r").alias("one"), "doc_id")
    bits = staged(order.numbered(bits, ["one"], ["doc_id"], "k").select("k", synth.hash_bit(F.lit(5), F.col("doc_id")).alias("bit")))
    grid = F.explode(F.array(*[F.struct(F.lit(f"{t}:{d}").alias("stream"), F.lit(t).alias("t"), F.lit(d).alias("d")) for t, d in MODEL_GRID]))
    made = synth.exposed(bits.withColumn("g", grid).select("g.*", "k", "bit"), F.col("t"), F.col("d"), ["stream", "t", "d"])
    model = runs.runs(made.withColumn("bit", (F.col("v") > 0.5).cast("long")), ["stream"], False)
    seen = runs.runs(binary(spark, sf), partial=False)

    def shares(df, key):
        h = df.groupBy(key, F.least("length", F.lit(8)).alias("length")).agg(F.count("*").alias("c"))
        return staged(order.with_stats(h, [key], t=F.sum("c")).select(key, "length", (F.col("c") / F.col("t")).alias("p")))

    a, b = shares(seen, "lamp"), shares(model, "stream").withColumnRenamed("p", "q")
    grid_rows = a.select("lamp").distinct().crossJoin(F.broadcast(b.select("stream").distinct())).withColumn("length", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    both = grid_rows.join(a, ["lamp", "length"], "left").join(b, ["stream", "length"], "left").fillna(0.0, ["p", "q"])
    return both.groupBy("lamp", "stream").agg(r6(F.sum(F.pow(F.col("p") - F.col("q"), F.lit(2.0)) / (F.col("p") + F.col("q") + 1e-9)), "misfit"))


@query("c19_rule_quality_curve", f"WITH {SIGNAL}, {THR}, {DEV}, {win(12)}, {NEAREST}, a AS (SELECT 'nearest' AS rule, phase_id, x FROM val), {CONFIDENT.replace('val AS', 'val2 AS')}, b AS (SELECT 'confident' AS rule, phase_id, x FROM val2) SELECT rule, phase_id, round(avg(CAST(abs(x) < 25 AS INT)) * 100, 6) AS near_pct FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def c19(spark, sf):
    rows = thresholded(spark, sf)
    parts = [symbols.decode(rows, rule, symbols.phases(12)).withColumn("rule", F.lit(rule)) for rule in ("nearest", "confident")]
    return union(parts).groupBy("rule", "phase_id").agg(r6(F.avg((F.col("margin") < 25).cast("double")) * 100, "near_pct"))


@query("d2_synthesise_drift", f"WITH {BITS01}, f AS (SELECT stream, nb, CAST(floor(nb * 3.0) AS BIGINT) - 1 AS n, unnest(range(CAST(floor(nb * 3.0) AS BIGINT) - 1)) AS frame FROM nb), p AS (SELECT stream, n, frame, least(greatest(CAST(floor((frame + (j + 0.5::DOUBLE) / 32.0::DOUBLE * 0.8::DOUBLE) / 30.0::DOUBLE * 10.0::DOUBLE - 0.35::DOUBLE) AS BIGINT), 0), nb - 1) AS k FROM f, range(32) t(j)), x AS (SELECT p.stream, frame, max(n) AS n, sum(CASE WHEN bit = 1 THEN 0.85::DOUBLE ELSE 0.25::DOUBLE END) / 32 AS x FROM p JOIN truth t ON t.stream = p.stream AND t.k = p.k GROUP BY ALL) SELECT stream, frame, round(least(greatest(x + 0.1::DOUBLE * sin(2.5::DOUBLE * frame / (n - 1)), 0), 1), 6) AS v FROM x")
def d2(spark, sf):
    return synth.drifting(views.truth(spark, sf), drift=0.1).select("stream", "frame", r6("v"))


@query("e7_message_match", f"WITH {TRUTH}, m AS (SELECT stream, k // 8 AS c, string_agg(CAST(bit AS VARCHAR), '' ORDER BY k) AS w FROM truth GROUP BY ALL) SELECT count(*) AS n, round(avg(CAST(a.w = b.w AS INT)), 6) AS exact_share FROM m a JOIN m b USING (c) WHERE a.stream = 'toxic' AND b.stream = 'quality'")
def e7(spark, sf):
    c = F.array_sort(F.collect_list(F.struct("k", "bit")))
    m = views.truth(spark, sf).groupBy("stream", F.floor(F.col("k") / 8).alias("c")).agg(F.array_join(F.transform(c, lambda x: x["bit"].cast("string")), "").alias("w"))
    two = m.filter("stream = 'toxic'").select("c", "w").join(m.filter("stream = 'quality'").select("c", F.col("w").alias("u")), "c")
    return two.agg(F.count("*").alias("n"), r6(F.avg((F.col("w") == F.col("u")).cast("double")), "exact_share"))


BOXES = [(f"{s}:{d}", max(1, round(4 * s)), round(4 + 4 * d - 2 * s)) for s in (0.5, 1.0, 1.5) for d in (-0.25, 0.0, 0.25)]


@query("l7_region_candidates", f"""WITH {PIXELS}, b AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {w}, {x})" for b, w, x in BOXES)}) t(box, w, x0)), i AS (SELECT box, frame, avg(v) AS v FROM b JOIN pixels ON x >= greatest(x0, 0) AND x < x0 + w AND y >= 2 AND y < 2 + w GROUP BY ALL), t AS (SELECT box, (quantile_cont(v, 0.1) + quantile_cont(v, 0.9)) / 2 AS thr FROM i GROUP BY box),
    s AS (SELECT box, avg(v) FILTER (v > thr) - avg(v) FILTER (v <= thr) AS visibility, sqrt((var_pop(v) FILTER (v > thr) + var_pop(v) FILTER (v <= thr)) / 2) AS noise, stddev_pop(v) AS stability, avg(v) FILTER (v <= thr) AS ambient FROM i JOIN t USING (box) GROUP BY box), c AS (SELECT p.box AS a, q.box AS b, corr(p.v, q.v) AS c FROM i p JOIN i q ON p.frame = q.frame AND p.box <> q.box GROUP BY ALL)
    SELECT s.box, round(visibility, 6) AS visibility, round(noise, 6) AS noise, round(stability, 6) AS stability, round(ambient, 6) AS ambient, round(1 - max(c), 6) AS isolation FROM s JOIN c ON c.a = s.box GROUP BY ALL""")
def l7(spark, sf):
    """Region variants by five criteria: visibility, noise, stability, isolation and ambient."""
    grid = spark.createDataFrame(BOXES, "box string, w long, x0 long")
    boxes = grid.select("box", "x0", F.lit(2).cast("long").alias("y0"), "w", F.col("w").alias("h"))
    inside = staged(frames.crop(views.pixels(spark, sf), boxes).groupBy("box", "frame").agg(F.avg("v").alias("v")))
    s = thresholds.fixed(inside, keys=["box"])
    on, off = F.when(F.col("v") > F.col("thr"), F.col("v")), F.when(F.col("v") <= F.col("thr"), F.col("v"))
    crit = s.groupBy("box").agg(r6(F.avg(on) - F.avg(off), "visibility"), r6(F.sqrt((F.var_pop(on) + F.var_pop(off)) / 2), "noise"), r6(F.stddev_pop("v"), "stability"), r6(F.avg(off), "ambient"))
    pairs = clock.pair_correlation(inside, "box")
    near = pairs.select(F.col("a").alias("box"), "corr").unionByName(pairs.select(F.col("b").alias("box"), "corr")).groupBy("box").agg(r6(1 - F.max("corr"), "isolation"))
    return crit.join(near, "box")


@query("l1_pixel_clusters", None)
def l1(spark, sf):
    """K-means over z-scored pixel series at several k; the largest k whose clusters are large and apart."""
    return learn.pixel_clusters(views.pixels(spark, sf)).select("x", "y", "cluster", "k")


def labelled_features(spark, sf) -> DataFrame:
    """Window features of each channel's symbols with the ensemble's safe bits as labels, and whether they are of its first 30 %."""
    rows = thresholded(spark, sf)
    ens = symbols.ensemble(symbols.decode(rows, "nearest", symbols.phases(12)), 12).filter("safe").select("lamp", "k", F.col("b0").alias("label"))
    table = staged(features(rows).join(ens, ["lamp", "k"]))
    return order.with_stats(table, ["lamp"], __last=F.max("k")).withColumn("dev", F.col("k") < F.col("__last") * 0.3).drop("__last")


def agreed(scored: DataFrame) -> DataFrame:
    return scored.groupBy("lamp").agg(F.count("*").alias("n"), F.round(F.avg((F.col("bit") == F.col("label")).cast("double")), 3).alias("agree"))


@query("m2_fit_symbol_classifier", None)
def m2(spark, sf):
    """Logistic regression over window features against the ensemble's safe bits: fitted on the first 30 % of each channel, scored on the rest."""
    table = labelled_features(spark, sf)
    return agreed(learn.fit_and_score(table.filter("dev"), table.filter("not dev")))


@query("m5_leave_one_lamp_out", None)
def m5(spark, sf):
    """The same, each channel scored by a model that hasn't seen it; the models of all channels are fitted in the same passes."""
    return agreed(learn.leave_one_out(labelled_features(spark, sf), "lamp"))


@query("m6_disjoint_seeds", None)
def m6(spark, sf):
    """A classifier fitted on synthetic streams of some seeds and scored on those of others: error rates of model and threshold."""
    ids = staged(order.numbered(views.read(spark, sf, "labels").select(F.lit(1).alias("one"), "doc_id"), ["one"], ["doc_id"], "k").select("k"))
    seeded = ids.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(5))))
    bits = staged(seeded.select(F.col("seed").cast("string").alias("stream"), "k", synth.hash_bit(F.col("seed"), F.col("k")).alias("bit")))
    made = staged(synth.synthesise(bits, PERIOD, 0.7, noise=400.0).withColumnRenamed("stream", "lamp"))
    rows = thresholds.fixed(made)
    table = staged(features(rows, 0.7).join(bits.select(F.col("stream").alias("lamp"), "k", F.col("bit").alias("label")), ["lamp", "k"]))
    scored = learn.fit_and_score(table.filter("lamp < 4"), table.filter("lamp >= 4"))
    plain = symbols.decode(rows.filter("lamp >= 4"), "nearest", [0.7]).select("lamp", "k", F.col("bit").alias("nearest"))
    wrong = lambda c: F.round(F.avg((F.col(c) != F.col("label")).cast("double")), 3)
    return scored.join(plain, ["lamp", "k"]).groupBy("lamp").agg(F.count("*").alias("n"), wrong("bit").alias("ber_model"), wrong("nearest").alias("ber_nearest"))


QUERIES, ORACLES = book.queries, book.oracles

"""Queries that try many settings at once: the grid of decoding settings, tolerances, and one-factor sweeps.

Settings are columns of one plan. What all settings of a symbol need (the values of its frames) is gathered once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwave.operators import frames, learn, order, packed, scoring, symbols, synth, thresholds, windows
from tarnwave.operators.symbols import PERIOD
from tarnwave.plans.base import Book, T, r6
from tarnwave.plans.clock import BITS01, ber_sql, features, syn_signal, synth_sql
from tarnwave.plans.core import ma_sql, thresholded
from tarnwave.sources import views
from tarnwave.sources.stage import staged
from tarnwave.sources.views import PIXELS, SIGNAL

book = Book()
query = book.query

#: The grid: margins at a window's end, percentile pairs of the threshold, rules.
MARGINS, PAIRS, RULES = (0.0, 0.2, 0.3, 0.4, 0.5), (5, 10, 25), ("confident", "nearest", "average")
#: The phase of the synthetic stream, and the offsets (in symbols) that its tolerance is measured over.
TRUE_PHASE, OFFSETS = 0.7, [-0.5 + i * 0.05 for i in range(21)]


def thresholds_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, pair, thr: one row for each pair of percentiles."""
    shares = {f"{side}{p}": (p if side == "l" else 100 - p) / 100 for p in PAIRS for side in "lh"}
    q = thresholds.quantiles(rows, keys, "v", **shares).join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), ((F.col(f"l{p}") + F.col(f"h{p}")) / 2).alias("thr")) for p in PAIRS]))
    return order.small(q.select(*keys, "n", each.alias("s")).select(*keys, "n", "s.*"))


#: Of each setting: its column and what it stands for.
SETTINGS = [(f"{rule}_{pair}_{i}", rule, pair, margin) for rule in RULES for pair in PAIRS for i, margin in enumerate(MARGINS)]


def grid_words(rows: DataFrame, levels: DataFrame, at: list[float], keys: list[str]) -> DataFrame:
    """keys, phase_id, word, mask, and the packed bits of each setting. rows: keys, frame, v, n.

    The first frame of a symbol sees the others; the bits of all settings are columns, packed 64 to a long.
    """
    width = int(PERIOD) + 1
    first, seen = symbols.windowed(rows, F.col("v"), at, keys=keys)
    at_frame = lambda of: F.coalesce(*[F.when(frame == of, v) for frame, v in seen])
    centre = F.least(F.rint(F.col("lo") - 0.5 + PERIOD / 2), F.col("n") - 1.0)
    values = first.select(*keys, "phase_id", "k", "lo", *[at_frame(F.col("lo") + j).alias(f"__{j}") for j in range(width)], at_frame(centre).alias("mid"))
    phase = F.element_at(F.array(*map(F.lit, at)), F.col("phase_id").cast("int") + 1)
    values = values.withColumn("stop", phase + F.col("k") * F.lit(PERIOD) + PERIOD)
    cells = values.join(levels.groupBy(*keys).agg(*[F.max(F.when(F.col("pair") == p, F.col("thr"))).alias(f"thr{p}") for p in PAIRS]), keys)
    # what each rule says of the first one, two, ... frames of a window; a margin only tells how many there are
    steps: list[dict[str, str]] = [{f"d{p}_{j}": f"__{j} - thr{p}" for p in PAIRS for j in range(width)}]
    for j in range(width):
        before = {p: f"confident{p}_{j - 1}" if j else "cast(null as double)" for p in PAIRS}
        furthest = {f"confident{p}_{j}": f"case when d{p}_{j} is not null and ({was} is null or abs(d{p}_{j}) > abs({was})) then d{p}_{j} else {was} end" for p, was in before.items()}
        total, count = (" + ".join(x.format(i) for i in range(j + 1)) for x in ("coalesce(__{0}, 0D)", "cast(__{0} is not null as int)"))
        steps.append(furthest | {f"mean_{j}": f"({total}) / ({count})"})
    steps.append({f"f{i}": f"least(greatest(floor(stop - {m}D), lo) - lo, {width - 1})" for i, m in enumerate(MARGINS)})
    for step in steps:
        cells = cells.selectExpr("*", *[f"{x} as {name}" for name, x in step.items()])

    def value(rule: str, pair: int, margin: float) -> str:
        if rule == "nearest":
            return f"mid - thr{pair}"
        of = {"confident": f"confident{pair}_{{}}", "average": f"mean_{{}} - thr{pair}"}[rule]
        return f"case f{MARGINS.index(margin)} {' '.join(f'when {j} then {of.format(j)}' for j in range(width))} end"

    bits = cells.selectExpr(*keys, "phase_id", "k", *[f"cast({value(rule, pair, m)} > 0 as int) as {name}" for name, rule, pair, m in SETTINGS])
    return packed.pack(bits, [*keys, "phase_id"], [name for name, *_ in SETTINGS])


def each_setting(words: DataFrame, keep: list[str]) -> DataFrame:
    """A row of each word for each setting: keep, rule, pair, margin, bit."""
    each = ", ".join(f"struct('{rule}' as rule, {pair} as pair, {margin}D as margin, {name} as bit)" for name, rule, pair, margin in SETTINGS)
    return words.selectExpr(*keep, f"inline(array({each}))")


def validated(spark, sf) -> DataFrame:
    """rule, margin, pair, ber0_pct, ber_true_pct, tolerance_bits: the mean over the synthetic streams."""
    s = staged(synth.synthesise(views.truth(spark, sf), PERIOD, TRUE_PHASE).select("stream", "frame", "v"))
    levels = thresholds_of(s, ["stream"])
    sized = s.join(levels.select("stream", "n").distinct(), "stream")
    at = [(TRUE_PHASE + o * PERIOD) % PERIOD for o in OFFSETS] + [0.0]
    ref = staged(views.truth(spark, sf))
    n_ref = order.small(ref.groupBy("stream").agg(F.count("*").alias("n_ref")))
    words = each_setting(grid_words(sized, levels, at, ["stream"]), ["stream", "phase_id", "word", "mask"])
    run = ["phase_id", "rule", "pair", "margin"]
    e = staged(packed.best_rate(packed.offset_sums(words, packed.pack(ref, ["stream"]), 3, ["stream"], run), ["stream", *run], n_ref))
    keys = ["stream", "rule", "pair", "margin"]
    band = scoring.band(e.filter("phase_id < 21").withColumn("ok", F.col("ber") <= 0.01), "phase_id", "ok", 10, keys, 20)
    tol = band.select(*keys, F.coalesce((F.col("hi") - F.col("lo")) * F.lit(0.05), F.lit(0.0)).alias("tol"))
    each = e.groupBy(*keys).agg(F.max(F.when(F.col("phase_id") == 21, F.col("ber"))).alias("b0"), F.max(F.when(F.col("phase_id") == 10, F.col("ber"))).alias("bt"))
    return each.join(tol, keys).groupBy("rule", "margin", "pair").agg(r6(F.avg("b0") * 100, "ber0_pct"), r6(F.avg("bt") * 100, "ber_true_pct"), r6(F.avg("tol"), "tolerance_bits"))


def on_dev(spark, sf) -> DataFrame:
    """rule, margin, pair, safe_pct, stability_pct: the median over the first 30 % of each channel."""
    s = views.signal(spark, sf)
    sizes = order.small(s.groupBy("lamp").agg((F.count("*") * F.lit(0.3)).cast("long").alias("n")))
    dev = staged(s.join(sizes, "lamp").filter("frame < n").select("lamp", "frame", "v", "n"))
    levels = thresholds_of(dev, ["lamp"])
    keys, at = ["lamp", "rule", "pair", "margin"], [*symbols.phases(12), (-0.15 * PERIOD) % PERIOD, (0.15 * PERIOD) % PERIOD]
    words = each_setting(grid_words(dev, levels, at, ["lamp"]), ["lamp", "phase_id", "word", "mask"])
    own = F.col("phase_id") < 12
    of = lambda p, c: F.coalesce(F.max(F.when(F.col("phase_id") == p, F.col(c))), F.lit(0).cast("long"))
    # symbols that all 12 phases have, and those that all decode alike
    full = F.when(F.count_if(own) == 12, F.bit_and(F.when(own, F.col("mask")))).otherwise(0)
    alike = F.bit_and(F.when(own, F.col("bit"))).bitwiseOR(F.bitwise_not(F.bit_or(F.when(own, F.col("bit")))))
    ens = staged(words.groupBy(*keys, "word").agg(full.alias("full"), full.bitwiseAND(alike).alias("safe"), of(0, "bit").alias("b"), *[of(p, c).alias(f"{c}{n}") for p, n in ((12, "x"), (13, "y")) for c in ("bit", "mask")]))
    near = packed.with_sides(ens, keys, ("bitx", "maskx", "bity", "masky")).join(ens.select(*keys, "word", "full", "safe", "b"), [*keys, "word"])

    def agree(v: str) -> Column:
        """The best share of equal bits over offsets of -1, 0 and 1."""
        shares = []
        for o in (-1, 0, 1):
            there = packed.moved(f"mask{v}", o)
            m, w = F.sum(packed.met(there, F.col("full"))), F.sum(packed.apart(packed.moved(f"bit{v}", o), F.col("b"), there, F.col("full")))
            shares.append(F.try_divide(m - w, m))
        return F.greatest(*shares)

    out = near.groupBy(*keys).agg((F.try_divide(F.sum(F.bit_count("safe")), F.sum(F.bit_count("full"))) * 100).alias("safe"), ((agree("x") + agree("y")) * 50).alias("ps"))
    return out.groupBy("rule", "margin", "pair").agg(r6(F.percentile("safe", F.lit(0.5)), "safe_pct"), r6(F.percentile("ps", F.lit(0.5)), "stability_pct"))


VALUES = """vals AS (SELECT g.lamp, i, k, lo, stop, max(v) FILTER (frame = lo) AS v0, max(v) FILTER (frame = lo + 1) AS v1, max(v) FILTER (frame = lo + 2) AS v2, max(v) FILTER (frame = least(greatest(round_even(lo - 0.5::DOUBLE + {T} / 2, 0), 0), n - 1)) AS mid
      FROM (SELECT lamp, n, i, k, ceil(ph + k * {T}) AS lo, ph + k * {T} + {T} AS stop FROM (SELECT lamp, n, i, ph, unnest(range(CAST(floor((n - ph - 1) / {T}) AS BIGINT))) AS k FROM lv0, o)) g JOIN src s ON s.lamp = g.lamp AND s.frame BETWEEN lo AND lo + 2 GROUP BY ALL),
    lv AS (SELECT lamp, p AS pair, (q[j] + q[7 - j]) / 2 AS thr FROM lv0, (VALUES (5, 1), (10, 2), (25, 3)) t(p, j)),
    c AS (SELECT vals.*, pair, thr, margin, greatest(floor(stop - margin), lo) - lo AS f FROM vals JOIN lv USING (lamp), (SELECT unnest([0.0, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS margin)),
    x AS (SELECT lamp, i, k, pair, margin, unnest(['confident', 'nearest', 'average']) AS rule, unnest([CASE WHEN f >= 2 AND abs(v2 - thr) > greatest(abs(v0 - thr), abs(v1 - thr)) THEN v2 - thr WHEN f >= 1 AND abs(v1 - thr) > abs(v0 - thr) THEN v1 - thr ELSE v0 - thr END,
      mid - thr, CASE WHEN f >= 2 THEN (v0 + v1 + v2) / 3 WHEN f >= 1 THEN (v0 + v1) / 2 ELSE v0 END - thr]) AS x FROM c)""".replace("{T}", T)
LEVELS = "lv0 AS (SELECT lamp, count(*) AS n, quantile_cont(v, [0.05, 0.1, 0.25, 0.75, 0.9, 0.95]) AS q FROM src GROUP BY lamp)"
RUN = "rule || ':' || margin || ':' || pair"
VALIDATED = f"""WITH {BITS01}, {synth_sql('0.7::DOUBLE')}, src AS (SELECT * FROM syn), {LEVELS}, o AS (SELECT i, CASE WHEN i = 21 THEN 0::DOUBLE ELSE ((0.7::DOUBLE + (-0.5::DOUBLE + i * 0.05::DOUBLE) * {T}) % {T} + {T}) % {T} END AS ph FROM range(22) t(i)), {VALUES},
    p AS (SELECT lamp || '|' || {RUN} || '|' || i AS stream, lamp, k, CAST(x > 0 AS BIGINT) AS bit FROM x), r AS (SELECT s.stream, t.k, t.bit FROM (SELECT DISTINCT stream, lamp FROM p) s JOIN truth t ON t.stream = s.lamp), {ber_sql('p', 'r')},
    q AS (SELECT split_part(stream, '|', 1) AS lamp, split_part(stream, '|', 2) AS run, CAST(split_part(stream, '|', 3) AS INT) AS i, ber FROM ber), z AS (SELECT lamp, run, coalesce(max(i) FILTER (ber > 0.01 AND i < 10) + 1, 0) AS lo, coalesce(min(i) FILTER (ber > 0.01 AND i > 10 AND i < 21) - 1, 20) AS hi, bool_or(ber <= 0.01 AND i = 10) AS ok, max(ber) FILTER (i = 21) AS b0, max(ber) FILTER (i = 10) AS bt FROM q GROUP BY ALL)
    SELECT run, round(avg(b0) * 100, 6) AS ber0_pct, round(avg(bt) * 100, 6) AS ber_true_pct, round(avg(CASE WHEN ok THEN (hi - lo) * 0.05::DOUBLE ELSE 0 END), 6) AS tolerance_bits FROM z GROUP BY run"""
ON_DEV = f"""WITH {SIGNAL}, src AS (SELECT lamp, frame, v FROM signal JOIN (SELECT lamp, CAST(trunc(count(*) * 0.3::DOUBLE) AS BIGINT) AS n FROM signal GROUP BY lamp) USING (lamp) WHERE frame < n), {LEVELS}, o AS (SELECT i, CASE i WHEN 12 THEN ((-0.15::DOUBLE * {T}) % {T} + {T}) % {T} WHEN 13 THEN (0.15::DOUBLE * {T}) % {T} ELSE i * ({T} / 12) END AS ph FROM range(14) t(i)), {VALUES},
    b AS (SELECT lamp, {RUN} AS run, i, k, CAST(x > 0 AS BIGINT) AS bit FROM x), e AS (SELECT lamp, run, k, min(bit) = max(bit) AS safe, max(bit) FILTER (i = 0) AS bit FROM b WHERE i < 12 GROUP BY ALL HAVING count(*) = 12),
    a AS (SELECT lamp, run, i, max(s) AS s FROM (SELECT e.lamp, e.run, b.i, off, avg(CAST(e.bit = b.bit AS INT)) AS s FROM e, (SELECT unnest([-1, 0, 1]) AS off), b WHERE b.lamp = e.lamp AND b.run = e.run AND b.i >= 12 AND b.k + off = e.k GROUP BY ALL) GROUP BY ALL),
    l AS (SELECT e.lamp, e.run, avg(CAST(safe AS INT)) * 100 AS safe, max(ps) AS ps FROM e JOIN (SELECT lamp, run, sum(s) * 50 AS ps FROM a GROUP BY ALL) USING (lamp, run) GROUP BY ALL) SELECT run, round(median(safe), 6) AS safe_pct, round(median(ps), 6) AS stability_pct FROM l GROUP BY run"""


@query("x1_grid_search", f"WITH va AS ({VALIDATED}), de AS ({ON_DEV}), j AS (SELECT split_part(run, ':', 1) AS rule, CAST(split_part(run, ':', 2) AS DOUBLE) AS margin, CAST(split_part(run, ':', 3) AS BIGINT) AS pair, ber0_pct, ber_true_pct, tolerance_bits, safe_pct, stability_pct FROM va JOIN de USING (run)) SELECT *, row_number() OVER (ORDER BY ber0_pct, tolerance_bits DESC, rule, margin, pair) AS place, row_number() OVER (PARTITION BY rule ORDER BY ber0_pct, tolerance_bits DESC, margin, pair) = 1 AS best_of_rule FROM j")
def x1(spark, sf):
    """45 settings (five margins, three percentile pairs, three rules) by error rate and tolerance on synthetic streams, with their figures on the channels."""
    table = validated(spark, sf).join(on_dev(spark, sf), ["rule", "margin", "pair"])
    by = ["ber0_pct", F.desc("tolerance_bits")]
    # the table of settings: 45 rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by, "rule", "margin", "pair")).cast("long")
    first = F.row_number().over(Window.partitionBy("rule").orderBy(*by, "margin", "pair")) == 1
    return table.select("rule", "margin", F.col("pair").cast("long").alias("pair"), "ber0_pct", "ber_true_pct", "tolerance_bits", "safe_pct", "stability_pct", place.alias("place"), first.alias("best_of_rule"))


def tolerance_sql(periods: str, phases: str, cut: str = "") -> str:
    """CTE ber of the nearest rule on the synthetic streams over o(i, ph, per); cut: bits looked at."""
    n = f"least(n, CAST(floor({cut} * {T}) AS BIGINT))" if cut else "n"
    return f"""WITH {BITS01}, {synth_sql('0.7::DOUBLE')}, st AS (SELECT lamp, {n} AS n, thr FROM (SELECT lamp, count(*) AS n, (quantile_cont(v, 0.1) + quantile_cont(v, 0.9)) / 2 AS thr FROM syn GROUP BY lamp)), o AS (SELECT a.i * 100 + b.j AS i, ph, per FROM {periods} a, {phases} b),
    w AS (SELECT lamp, n, thr, i, ph, per, unnest(range(CAST(floor((n - ph - 1) / per) AS BIGINT))) AS k FROM st, o), p AS (SELECT w.lamp || ':' || i AS stream, k, CAST(s.v > thr AS BIGINT) AS bit FROM w JOIN syn s ON s.lamp = w.lamp AND s.frame = CAST(least(greatest(round_even(ceil(ph + k * per) - 0.5::DOUBLE + per / 2, 0), 0), n - 1) AS BIGINT)),
    r AS (SELECT t.stream || ':' || i AS stream, k, bit FROM truth t, o {f'WHERE k < {cut}' if cut else ''}), {ber_sql('p', 'r')}, q AS (SELECT split_part(stream, ':', 1) AS stream, CAST(split_part(stream, ':', 2) AS INT) AS i, ber FROM ber)"""


def timing_errors(spark, sf, at: list[float], periods: list[float], bits: int | None = None) -> DataFrame:
    """stream, phase_id, ber of the nearest rule at each phase and period beside it; bits: how many are looked at."""
    rows, ref = syn_signal(spark, sf, TRUE_PHASE), staged(views.truth(spark, sf))
    if bits:
        rows = rows.filter(F.col("frame") < int(bits * PERIOD)).withColumn("n", F.least("n", F.lit(int(bits * PERIOD)).cast("long")))
        ref = ref.filter(F.col("k") < bits)
    got = symbols.decode(rows, "nearest", at, periods=periods).withColumnRenamed("lamp", "stream")
    n_ref = order.small(ref.groupBy("stream").agg(F.count("*").alias("n_ref")))
    sums = packed.offset_sums(packed.pack(got, ["stream", "phase_id"]), packed.pack(ref, ["stream"]), 3, ["stream"], ["phase_id"])
    return packed.best_rate(sums, ["stream", "phase_id"], n_ref)


@query("e4_period_tolerance", f"{tolerance_sql(f'(SELECT i, {T} * (1 + (i - 10) / 100.0::DOUBLE) AS per FROM range(21) t(i))', '(SELECT 0 AS j, 0.7::DOUBLE AS ph)', '500')}, z AS (SELECT stream, coalesce(max(i // 100) FILTER (ber > 0.01 AND i < 1000) + 1, 0) AS lo, coalesce(min(i // 100) FILTER (ber > 0.01 AND i > 1000) - 1, 20) AS hi, bool_or(ber <= 0.01 AND i = 1000) AS ok, min(ber) AS best FROM q GROUP BY stream) SELECT stream, round(CASE WHEN ok THEN hi - lo ELSE 0 END, 6)::DOUBLE AS tolerance_pct, round(best, 6) AS best_ber FROM z")
def e4(spark, sf):
    """How far the assumed period may be off (21 steps over +-10 %, first 500 symbols): the band around the true one with at most 1 % errors."""
    e = timing_errors(spark, sf, [TRUE_PHASE] * 21, [PERIOD * (1 + (i - 10) / 100) for i in range(21)], 500)
    b = scoring.band(e.withColumn("ok", F.col("ber") <= 0.01), "phase_id", "ok", 10, ["stream"], 20)
    best = e.groupBy("stream").agg(r6(F.min("ber"), "best_ber"))
    return b.select("stream", r6(F.coalesce((F.col("hi") - F.col("lo")).cast("double"), F.lit(0.0)), "tolerance_pct")).join(best, "stream")


RULES = ("nearest", "average", "confident")


def rule_errors_sql(variants: str, cut: int | None = None) -> str:
    """A query for stream, rule, i, ber over variants (i, ph, per) of the synthetic streams; cut: symbols looked at."""
    n = f"least(n, CAST(floor({cut} * {T}) AS BIGINT))" if cut else "n"
    return f"""WITH st AS (SELECT lamp, {n} AS n, thr FROM (SELECT lamp, count(*) AS n, (quantile_cont(v, 0.1) + quantile_cont(v, 0.9)) / 2 AS thr
        FROM syn GROUP BY lamp)), o AS ({variants}),
    w AS (SELECT *, unnest(range(CAST(floor((n - ph - 1) / per) AS BIGINT))) AS k FROM st, o),
    b AS (SELECT *, ceil(ph + k * per) AS lo, greatest(floor((ph + k * per) + per), ceil(ph + k * per)) AS hi FROM w),
    x AS (SELECT b.lamp, i, k, s.frame, s.v - thr AS d, s.frame = least(greatest(round_even(lo - 0.5::DOUBLE + per / 2, 0), 0), n - 1) AS mid
        FROM b JOIN syn s ON s.lamp = b.lamp AND s.frame BETWEEN lo AND hi AND s.frame < n),
    d AS (SELECT lamp, i, k, unnest(['nearest', 'average', 'confident']) AS rule,
        unnest([max(d) FILTER (mid), avg(d), first(d ORDER BY abs(d) DESC, frame)]) AS d FROM x GROUP BY lamp, i, k),
    p AS (SELECT lamp || '|' || rule || '|' || i AS stream, lamp, k, CAST(d > 0 AS BIGINT) AS bit FROM d),
    r AS (SELECT s.stream, t.k, t.bit FROM (SELECT DISTINCT stream, lamp FROM p) s JOIN truth t ON t.stream = s.lamp {f'WHERE t.k < {cut}' if cut else ''}),
    {ber_sql('p', 'r')}
    SELECT split_part(stream, '|', 1) AS stream, split_part(stream, '|', 2) AS rule, CAST(split_part(stream, '|', 3) AS INT) AS i, ber FROM ber"""


def band_sql(src: str) -> str:
    """stream, rule, wide: steps of the band around variant 10 of 21 with at most 1 % errors."""
    return f"""SELECT stream, rule, CASE WHEN bool_or(ber <= 0.01 AND i = 10) THEN coalesce(min(i) FILTER (ber > 0.01 AND i BETWEEN 11 AND 20) - 1, 20)
        - coalesce(max(i) FILTER (ber > 0.01 AND i < 10) + 1, 0) ELSE 0 END AS wide FROM {src} GROUP BY stream, rule"""


RULE_TOLERANCES = f"""WITH {BITS01}, {synth_sql('0.7::DOUBLE')},
    whole AS ({rule_errors_sql(f"SELECT i, CASE WHEN i = 21 THEN 0::DOUBLE ELSE ((0.7::DOUBLE + (-0.5::DOUBLE + i * 0.05::DOUBLE) * {T}) % {T} + {T}) % {T} END AS ph, {T} AS per FROM range(22) t(i)")}),
    part AS ({rule_errors_sql(f"SELECT i, 0.7::DOUBLE AS ph, {T} * (1 + (i - 10) / 100.0::DOUBLE) AS per FROM range(21) t(i)", 500)}),
    f AS ({band_sql('whole')}), g AS ({band_sql('part')}),
    e AS (SELECT stream, rule, max(ber) FILTER (i = 10) AS bt, max(ber) FILTER (i = 21) AS b0 FROM whole GROUP BY stream, rule)
    SELECT stream, rule, round(bt * 100, 6) AS ber_true_pct, round(b0 * 100, 6) AS ber_phase0_pct, round(f.wide * 0.05::DOUBLE, 6) AS phase_tolerance_bits,
        CAST(g.wide AS DOUBLE) AS period_tolerance_pct FROM e JOIN f USING (stream, rule) JOIN g USING (stream, rule)"""


def rule_errors(rows: DataFrame, ref: DataFrame, at: list[float], periods: list[float]) -> DataFrame:
    """stream, rule, phase_id, ber of each rule of RULES at each phase and the period beside it; rows: syn_signal."""
    parts = [symbols.decode(rows, r, at, periods=periods).withColumn("rule", F.lit(r)) for r in RULES]
    got = reduce(DataFrame.unionByName, parts).withColumnRenamed("lamp", "stream")
    n_ref = order.small(ref.groupBy("stream").agg(F.count("*").alias("n_ref")))
    sums = packed.offset_sums(packed.pack(got, ["stream", "rule", "phase_id"]), packed.pack(ref, ["stream"]), 3, ["stream"], ["rule", "phase_id"])
    return packed.best_rate(sums, ["stream", "rule", "phase_id"], n_ref)


@query("e3_rule_tolerances", RULE_TOLERANCES)
def e3_rules(spark, sf):
    """Each rule's error rates at the true phase and at phase 0, and how far phase (of a symbol) and period (%, first 500
    symbols) may be off with at most 1 % errors.
    """
    rows, ref = syn_signal(spark, sf, TRUE_PHASE), staged(views.truth(spark, sf))
    whole = staged(rule_errors(rows, ref, [*((TRUE_PHASE + o * PERIOD) % PERIOD for o in OFFSETS), 0.0], [PERIOD] * 22))
    last = int(500 * PERIOD)
    part = rows.filter(F.col("frame") < last).withColumn("n", F.least("n", F.lit(last).cast("long")))
    part = rule_errors(part, ref.filter("k < 500"), [TRUE_PHASE] * 21, [PERIOD * (1 + (i - 10) / 100) for i in range(21)])
    keys = ["stream", "rule"]

    def wide(e: DataFrame, step: float, name: str) -> DataFrame:
        b = scoring.band(e.filter("phase_id < 21").withColumn("ok", F.col("ber") <= 0.01), "phase_id", "ok", 10, keys, 20)
        return b.select(*keys, r6(F.coalesce((F.col("hi") - F.col("lo")) * F.lit(step), F.lit(0.0)), name))

    at = [F.max(F.when(F.col("phase_id") == i, F.col("ber") * 100)).alias(name) for i, name in ((10, "ber_true_pct"), (21, "ber_phase0_pct"))]
    e = whole.groupBy(*keys).agg(*at).select(*keys, r6("ber_true_pct"), r6("ber_phase0_pct"))
    return e.join(wide(whole, 0.05, "phase_tolerance_bits"), keys).join(wide(part, 1.0, "period_tolerance_pct"), keys)


@query("e5_timing_surface", f"{tolerance_sql(f'(SELECT i, {T} * (1 + (i - 10) / 100.0::DOUBLE) AS per FROM range(21) t(i))', f'(SELECT j, ((0.7::DOUBLE + (-0.5::DOUBLE + j * 0.05::DOUBLE) * {T}) % {T} + {T}) % {T} AS ph FROM range(21) t(j))')} SELECT stream, CAST(i // 100 - 10 AS BIGINT) AS period_pct, CAST(i % 100 AS BIGINT) AS phase_step, round(ber, 6) AS ber, round(avg(CAST(ber <= 0.01 AS INT)) OVER (PARTITION BY stream), 6) AS robust FROM q")
def e5(spark, sf):
    """Error rates over 21 period errors (up to 10 %) by 21 phases, and the share of them with at most 1 % errors."""
    steps = [(p, q) for p in range(21) for q in range(21)]
    e = timing_errors(spark, sf, [(TRUE_PHASE + OFFSETS[q] * PERIOD) % PERIOD for _, q in steps], [PERIOD * (1 + (p - 10) / 100) for p, _ in steps])
    e = order.with_stats(staged(e), ["stream"], robust=F.avg((F.col("ber") <= 0.01).cast("double")))
    return e.select("stream", (F.floor(F.col("phase_id") / 21) - 10).alias("period_pct"), (F.col("phase_id") % 21).alias("phase_step"), r6("ber"), r6("robust"))


#: One factor at a time: widths of smoothing, shifts of the threshold (of the range), of the phase (of a symbol), of the period (%), and boxes.
SMOOTH, SHIFTS = (1, 3, 5, 7, 9), (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)
ERRORS = (-10.0, -3.0, -2.0, -1.0, -0.5, -0.2, 0.0, 0.2, 0.5, 1.0, 2.0, 3.0, 10.0)
BOXES = [(s, 0.0) for s in (0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0)] + [(1.0, d) for d in (-0.5, -0.25, 0.25, 0.5)]
#: Of each variant of a decode: factor, value, phase, shift, period. The base is the last one.
VARIANTS = [("threshold", x, 0.0, x, PERIOD) for x in SHIFTS] + [("phase", round(o, 2), (o * PERIOD) % PERIOD, 0.0, PERIOD) for o in OFFSETS] + [("period", e, 0.0, 0.0, PERIOD * (1 + e / 100)) for e in ERRORS] + [("base", 0.0, 0.0, 0.0, PERIOD)]
SWEPT = ("confident", "nearest")


def held_against(words: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """factor, value, rule, same_pct: the median over keys of the share of bits that equal the base's. Both packed by keys, rule, factor, value."""
    own = [*keys, "rule"]
    per = packed.same_share(words, base, own, ["factor", "value"])
    return per.groupBy("factor", "value", "rule").agg(r6(F.percentile(F.col("share") * 100, F.lit(0.5)), "same_pct"))


def both_rules(rows: DataFrame, keys: list[str], phases: list[float] | None = None, **variants) -> DataFrame:
    one, two = (symbols.decode(rows, r, phases or [0.0], keys=keys, **variants).withColumn("rule", F.lit(r)) for r in SWEPT)
    return one.unionByName(two)


def smoothings(raw: DataFrame) -> DataFrame:
    """lamp, frame, v, value: raw under each width of smoothing."""
    rows = windows.moving_averages(raw, {f"ma{w}": ("v", w) for w in SMOOTH})
    each = F.explode(F.array(*[F.struct(F.col(f"ma{w}").alias("v"), F.lit(float(w)).alias("value")) for w in SMOOTH]))
    return rows.select("lamp", "frame", each.alias("s")).select("lamp", "frame", "s.v", "s.value")


def boxed_signals(spark, sf) -> DataFrame:
    """value (a box's number), frame, v: the mean of each box in each frame."""
    grid = spark.createDataFrame([(float(i), round(4 + d * 4 - 2 * s), round(4 - 2 * s), max(1, round(4 * s))) for i, (s, d) in enumerate(BOXES)], "value double, x0 long, y0 long, w long")
    inside = frames.crop(views.pixels(spark, sf), grid.withColumn("h", F.col("w"))).groupBy("value", F.col("frame").alias("at")).agg(F.avg("v").alias("v"))
    return order.numbered(staged(inside), ["value"], ["at"], "frame").select("value", "frame", "v")


def swept_sql(src: str, o: str, key: str = "lamp") -> str:
    """CTEs of both rules' bits of src (key, frame, v) over variants o (i, ph, sh, per)."""
    return f"""st AS (SELECT {key}, count(*) AS n, (quantile_cont(v, 0.1) + quantile_cont(v, 0.9)) / 2 AS thr, max(v) - min(v) AS span FROM {src} GROUP BY {key}), w0 AS (SELECT {key}, n, thr, span, i, ph, sh, per, unnest(range(CAST(floor((n - ph - 1) / per) AS BIGINT))) AS k FROM st, {o}),
    w AS (SELECT *, ceil(ph + k * per) AS lo, greatest(floor((ph + k * per) + per), ceil(ph + k * per)) AS hi FROM w0), x AS (SELECT w.{key}, i, k, frame, v - (thr + sh * span) AS d, frame = least(greatest(round_even(lo - 0.5::DOUBLE + per / 2, 0), 0), n - 1) AS mid, frame <= hi AS inside FROM w JOIN {src} s ON s.{key} = w.{key} AND s.frame BETWEEN lo AND greatest(hi, lo + ceil(per))),
    bb AS (SELECT {key}, i, k, 'nearest' AS rule, CAST(d > 0 AS BIGINT) AS bit FROM x WHERE mid UNION ALL SELECT {key}, i, k, 'confident', CAST(d > 0 AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY {key}, i, k ORDER BY abs(d) DESC, frame) AS r FROM x WHERE inside) WHERE r = 1)"""


FACTORS = f"""WITH {SIGNAL}, o AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', {v}::DOUBLE, {ph!r}::DOUBLE, {sh}::DOUBLE, {per!r}::DOUBLE)" for i, (f, v, ph, sh, per) in enumerate(VARIANTS))}) t(i, factor, value, ph, sh, per)), {swept_sql('signal', 'o')}, p AS (SELECT a.lamp, a.i, a.rule, avg(CAST(a.bit = b.bit AS INT)) * 100 AS s FROM bb a JOIN bb b ON b.lamp = a.lamp AND b.rule = a.rule AND b.k = a.k AND b.i = {len(VARIANTS) - 1} GROUP BY ALL)
    SELECT factor, value, rule, round(median(s), 6) AS same_pct FROM p JOIN o USING (i) WHERE factor <> 'base' GROUP BY ALL"""
SMOOTHED = f"WITH {SIGNAL}, sm AS (" + " UNION ALL ".join(f"SELECT lamp || ':{w}' AS lamp, frame, ma AS v FROM {ma_sql(w)}" for w in SMOOTH) + f"), o AS (SELECT 0 AS i, 0::DOUBLE AS ph, 0::DOUBLE AS sh, {T} AS per), {swept_sql('sm', 'o')}, q AS (SELECT split_part(lamp, ':', 1) AS lamp, CAST(split_part(lamp, ':', 2) AS DOUBLE) AS value, rule, k, bit FROM bb), p AS (SELECT a.lamp, a.value, a.rule, avg(CAST(a.bit = b.bit AS INT)) * 100 AS s FROM q a JOIN q b ON b.lamp = a.lamp AND b.rule = a.rule AND b.k = a.k AND b.value = 1 GROUP BY ALL) SELECT 'smoothing' AS factor, value, rule, round(median(s), 6) AS same_pct FROM p GROUP BY ALL"
BOXED = f"WITH {PIXELS}, b AS (SELECT * FROM (VALUES {', '.join(f'({i}, {round(4 + d * 4 - 2 * s)}, {round(4 - 2 * s)}, {max(1, round(4 * s))})' for i, (s, d) in enumerate(BOXES))}) t(box, x0, y0, w)), src AS (SELECT box, row_number() OVER (PARTITION BY box ORDER BY frame) - 1 AS frame, avg(v) AS v FROM b JOIN pixels ON x >= greatest(x0, 0) AND x < x0 + w AND y >= greatest(y0, 0) AND y < y0 + w GROUP BY box, frame), o AS (SELECT 0 AS i, 0::DOUBLE AS ph, 0::DOUBLE AS sh, {T} AS per), {swept_sql('src', 'o', 'box')}, p AS (SELECT a.box, a.rule, avg(CAST(a.bit = b.bit AS INT)) * 100 AS s FROM bb a JOIN bb b ON b.rule = a.rule AND b.k = a.k AND b.box = 3 GROUP BY ALL) SELECT 'box' AS factor, CAST(box AS DOUBLE) AS value, rule, round(s, 6) AS same_pct FROM p"


@query("x3_one_factor_sweeps", f"SELECT * FROM ({FACTORS}) UNION ALL SELECT * FROM ({SMOOTHED}) UNION ALL SELECT * FROM ({BOXED})")
def x3(spark, sf):
    """Bits that keep their value as one factor moves, for five factors and two rules; the median over channels.

    Boxes are told by their number. Shifts of threshold, phase and period are variants of one pass over the rows.
    """
    rows = staged(thresholded(spark, sf))
    phases, shifts, periods = ([v[i] for v in VARIANTS] for i in (2, 3, 4))
    named = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(float(v)).alias("value")) for f, v, *_ in VARIANTS])
    own = ["rule", "factor", "value"]
    bits = packed.pack(both_rules(rows, ["lamp"], phases=phases, shifts=shifts, periods=periods), ["lamp", "rule", "phase_id"])
    bits = staged(bits.withColumn("f", F.element_at(named, F.col("phase_id").cast("int") + 1)).select("lamp", "f.factor", "f.value", "rule", "word", "mask", "bit"))
    moved = held_against(bits.filter("factor <> 'base'"), bits.filter("factor = 'base'"), ["lamp"])

    raw = rows.select("lamp", "frame", "v")
    sb = both_rules(thresholds.fixed(staged(smoothings(raw)), keys=["lamp", "value"]), ["lamp", "value"]).withColumn("factor", F.lit("smoothing"))
    sb = staged(packed.pack(sb, ["lamp", *own]))
    smoothed = held_against(sb, sb.filter("value = 1"), ["lamp"])

    bb = both_rules(thresholds.fixed(staged(boxed_signals(spark, sf)), keys=["value"]), ["value"]).withColumns({"factor": F.lit("box"), "all": F.lit(1)})
    bb = staged(packed.pack(bb, ["all", *own]))
    boxed = held_against(bb, bb.filter("value = 3"), ["all"])
    return moved.unionByName(smoothed).unionByName(boxed)


#: Amplitudes of noise on the synthetic streams.
NOISES = (8, 80)
#: Of each variant of a decode with known bits: factor, value, whether from the true phase, phase, shift, period.
TRUTHS = [(f, v, known, (ph + TRUE_PHASE * known) % PERIOD, sh, per) for f, v, ph, sh, per in VARIANTS[:-1] for known in (0, 1) if known or f != "phase"]
#: A phase of a smoothed stream.
STARTS = [("smoothing", 0.0, known, TRUE_PHASE * known, 0.0, PERIOD) for known in (0, 1)]


def noisy_sql(variants: list[tuple], smoothed: bool) -> str:
    """Rows of x3_error_rates for variants of the synthetic streams, or of each smoothing of them."""
    o = ", ".join(f"({i}, '{f}', {v}::DOUBLE, {known}, {ph!r}::DOUBLE, {sh}::DOUBLE, {per!r}::DOUBLE)" for i, (f, v, known, ph, sh, per) in enumerate(variants))
    widths = " UNION ALL ".join(f"SELECT lamp || ':{w}' AS lamp, frame, ma AS v FROM {ma_sql(w)}" for w in (SMOOTH if smoothed else ()))
    src = f"sm AS ({widths})" if smoothed else "sm AS (SELECT lamp || ':0' AS lamp, frame, v FROM signal)"
    return f"""WITH {BITS01}, {synth_sql("0.7::DOUBLE")},
    signal AS (SELECT lamp || ':' || a AS lamp, frame, v + a * (('0x' || substr(md5('17:' || frame), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5::DOUBLE) AS v
      FROM syn, (SELECT unnest([{", ".join(map(str, NOISES))}]) AS a)),
    {src}, o AS (SELECT * FROM (VALUES {o}) t(i, factor, value, known, ph, sh, per)), {swept_sql("sm", "o")},
    p AS (SELECT lamp || ':' || i || ':' || rule AS stream, k, bit FROM bb),
    r AS (SELECT q.stream, k, bit FROM (SELECT DISTINCT stream FROM p) q JOIN truth t ON t.stream = split_part(q.stream, ':', 1)),
    {ber_sql("p", "r")},
    e AS (SELECT CAST(split_part(stream, ':', 2) AS BIGINT) AS noise, CAST(split_part(stream, ':', 3) AS DOUBLE) AS width, CAST(split_part(stream, ':', 4) AS INT) AS i, split_part(stream, ':', 5) AS rule, ber FROM ber)
    SELECT factor, value + width AS value, rule, noise, round(avg(ber) FILTER (known = 0) * 100, 6) AS ber_start_pct, round(avg(ber) FILTER (known = 1) * 100, 6) AS ber_true_pct
    FROM e JOIN o USING (i) GROUP BY ALL"""


def known_errors(rows: DataFrame, ref: DataFrame, n_ref: DataFrame, variants: list[tuple]) -> DataFrame:
    """factor, value, rule, noise, ber_start_pct, ber_true_pct of rows (lamp, value, frame, v), lamp being stream:noise."""
    phases, shifts, periods = ([v[i] for v in variants] for i in (3, 4, 5))
    named = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(float(v)).alias("at"), F.lit(known).alias("known")) for f, v, known, *_ in variants])
    own = ["stream", "noise", "value", "rule", "phase_id"]
    bits = both_rules(thresholds.fixed(rows, keys=["lamp", "value"]), ["lamp", "value"], phases=phases, shifts=shifts, periods=periods)
    bits = bits.withColumns({"stream": F.substring_index("lamp", ":", 1), "noise": F.substring_index("lamp", ":", -1).cast("long")})
    sums = packed.offset_sums(packed.pack(bits.select(*own, "k", "bit"), own), packed.pack(ref, ["stream"]), 3, ["stream"], own[1:])
    e = packed.best_rate(sums, own, n_ref).withColumn("s", F.element_at(named, F.col("phase_id").cast("int") + 1))
    rate = lambda known, name: r6(F.avg(F.when(F.col("s.known") == known, F.col("ber"))) * 100, name)
    return e.groupBy("s.factor", (F.col("s.at") + F.col("value")).alias("value"), "rule", "noise").agg(rate(0, "ber_start_pct"), rate(1, "ber_true_pct"))


@query("x3_error_rates", f"SELECT * FROM ({noisy_sql(TRUTHS, False)}) UNION ALL SELECT * FROM ({noisy_sql(STARTS, True)})")
def x3_error_rates(spark, sf):
    """Error rates on streams of known bits at two noises as one factor moves: decoded from the first frame, and from the true phase.

    The mean over the streams. Offsets of the phase are told from the true phase alone.
    """
    ref = staged(views.truth(spark, sf))
    n_ref = order.small(ref.groupBy("stream").agg(F.count("*").alias("n_ref")))
    made = [synth.synthesise(ref, PERIOD, TRUE_PHASE, noise=float(a)).select(F.concat_ws(":", "stream", F.lit(a)).alias("lamp"), "frame", "v") for a in NOISES]
    raw = staged(reduce(DataFrame.unionByName, made))
    moved = known_errors(raw.withColumn("value", F.lit(0.0)), ref, n_ref, TRUTHS)
    return moved.unionByName(known_errors(staged(smoothings(raw)), ref, n_ref, STARTS))


TWELVE = f"o AS (SELECT i, i * ({T} / 12) AS ph, 0::DOUBLE AS sh, {T} AS per FROM range(12) t(i))"
BOX_SRC = f"""b AS (SELECT * FROM (VALUES {", ".join(f"({i}, {round(4 + d * 4 - 2 * s)}, {round(4 - 2 * s)}, {max(1, round(4 * s))})" for i, (s, d) in enumerate(BOXES))}) t(box, x0, y0, w)),
    src AS (SELECT CAST(box AS VARCHAR) AS lamp, row_number() OVER (PARTITION BY box ORDER BY frame) - 1 AS frame, avg(v) AS v
      FROM b JOIN pixels ON x >= greatest(x0, 0) AND x < x0 + w AND y >= greatest(y0, 0) AND y < y0 + w GROUP BY box, frame)"""
SAFE_SQL = """sf AS (SELECT lamp, rule, avg(CAST(lo = hi AS INT)) * 100 AS safe
      FROM (SELECT lamp, rule, k, min(bit) AS lo, max(bit) AS hi FROM bb GROUP BY ALL HAVING count(*) = 12) GROUP BY ALL)"""
BOX_QUALITY = f"""WITH {PIXELS}, {BOX_SRC}, {TWELVE}, {swept_sql("src", "o")}, {SAFE_SQL},
    g AS (SELECT lamp, (avg(v) FILTER (v > thr + 0.25 * span) - avg(v) FILTER (v < thr - 0.25 * span))
      / greatest(sqrt((var_pop(v) FILTER (v > thr + 0.25 * span) + var_pop(v) FILTER (v < thr - 0.25 * span)) / 2), 1e-9) AS gap FROM src JOIN st USING (lamp) GROUP BY lamp)
    SELECT 'box' AS factor, CAST(lamp AS DOUBLE) AS value, rule, round(safe, 6) AS phase_indep_pct, round(gap, 6) AS gap_over_noise FROM sf JOIN g USING (lamp)"""
SMOOTH_QUALITY = f"""WITH {SIGNAL}, sm AS ({" UNION ALL ".join(f"SELECT lamp || ':{w}' AS lamp, frame, ma AS v FROM {ma_sql(w)}" for w in SMOOTH)}), {TWELVE}, {swept_sql("sm", "o")}, {SAFE_SQL}
    SELECT 'smoothing' AS factor, CAST(split_part(lamp, ':', 2) AS DOUBLE) AS value, rule, round(median(safe), 6) AS phase_indep_pct, NULL::DOUBLE AS gap_over_noise FROM sf GROUP BY ALL"""


@query("x3_sweep_quality", f"SELECT * FROM ({BOX_QUALITY}) UNION ALL SELECT * FROM ({SMOOTH_QUALITY})")
def x3_quality(spark, sf):
    """Share of symbols that twelve phases decode alike, by box and by width of smoothing (the median over channels); of boxes
    the gap between lit and dark frames in units of their noise as well.
    """
    twelve = symbols.phases(12)

    def safe(rows: DataFrame, keys: list[str]) -> DataFrame:
        # symbols that all phases have, and those of them that all decode alike, a word at a time
        own = [*keys, "rule"]
        words = packed.pack(both_rules(rows, keys, phases=twelve), [*own, "phase_id"])
        full = F.when(F.count("*") == 12, F.bit_and("mask")).otherwise(F.lit(0).cast("long"))
        alike = F.bit_and("bit").bitwiseOR(F.bitwise_not(F.bit_or("bit")))
        words = words.groupBy(*own, "word").agg(F.bit_count(full).alias("n"), F.bit_count(full.bitwiseAND(alike)).alias("c"))
        return words.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("c").alias("c")).filter("n > 0").select(*own, (F.col("c") / F.col("n") * 100).alias("pct"))

    boxes = staged(thresholds.fixed(boxed_signals(spark, sf), keys=["value"]))
    edge = 0.25 * F.col("span")
    on, off = (F.when(side, F.col("v")) for side in (F.col("v") > F.col("thr") + edge, F.col("v") < F.col("thr") - edge))
    gaps = boxes.groupBy("value").agg(((F.avg(on) - F.avg(off)) / F.greatest(F.sqrt((F.var_pop(on) + F.var_pop(off)) / 2), F.lit(1e-9))).alias("gap"))
    # a row for each box
    boxed = safe(boxes, ["value"]).join(F.broadcast(gaps), "value").select(F.lit("box").alias("factor"), "value", "rule", r6("pct", "phase_indep_pct"), r6("gap", "gap_over_noise"))
    smooth = thresholds.fixed(staged(smoothings(views.signal(spark, sf))), keys=["lamp", "value"])
    per = safe(smooth, ["lamp", "value"]).groupBy("value", "rule").agg(r6(F.percentile("pct", F.lit(0.5)), "phase_indep_pct"))
    return boxed.unionByName(per.select(F.lit("smoothing").alias("factor"), "value", "rule", "phase_indep_pct", F.lit(None).cast("double").alias("gap_over_noise")))


@query("x2_best_per_candidate", None)
def x2(spark, sf):
    """The best of the grid's threshold settings, and six learned ones (three penalties, five or seven frames), by error rate on a stream they haven't seen."""
    bits = staged(views.truth(spark, sf))
    made = staged(thresholds.fixed(staged(synth.synthesise(bits, PERIOD, TRUE_PHASE, noise=160.0).withColumnRenamed("stream", "lamp"))))
    ref = bits.select(F.col("stream").alias("lamp"), "k", F.col("bit").alias("label"))
    runs = []
    for count, (first, last) in ((5, (-1, 3)), (7, (-2, 4))):
        table = staged(features(made, TRUE_PHASE, first, last).join(ref, ["lamp", "k"]))
        names = [c for c in table.columns if c.startswith("d_")] + ["frac"]
        for c in (0.1, 1.0, 10.0):
            scored = learn.fit_and_score(table.filter("lamp = 'quality'"), table.filter("lamp = 'toxic'"), names, c)
            runs.append(scored.agg(F.round(F.avg((F.col("bit") != F.col("label")).cast("double")) * 100, 3).alias("ber_pct")).select(F.lit("model").alias("candidate"), F.lit(f"{count} frames, C {c}").alias("setting"), "ber_pct"))
    plain = [symbols.decode(made.filter("lamp = 'toxic'"), r, [TRUE_PHASE]).join(ref, ["lamp", "k"]).agg(F.round(F.avg((F.col("bit") != F.col("label")).cast("double")) * 100, 3).alias("ber_pct")).select(F.lit("threshold").alias("candidate"), F.lit(r).alias("setting"), "ber_pct") for r in RULES]
    table = runs[0]
    for part in [*runs[1:], *plain]:
        table = table.unionByName(part)
    # nine rows
    best = F.row_number().over(Window.partitionBy("candidate").orderBy("ber_pct", "setting")) == 1
    return table.withColumn("best", best)


QUERIES, ORACLES = book.queries, book.oracles

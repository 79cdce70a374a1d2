"""Queries of forecasts, scores, calibration, bootstraps and selection (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import CLASSES, classify
from ..operators import bootstrap as boot
from ..operators import forecast as fc
from ..operators import scoring as sc
from ..operators.asof import calendar_lag
from .registry import Tables, query

PS = ["p_down", "p_flat", "p_up"]
CLASS = "CASE WHEN {0} > 0.05 THEN 'UP' WHEN {0} < -0.05 THEN 'DOWN' WHEN {0} IS NOT NULL THEN 'FLAT' END"
MOVES = f"SELECT *, {CLASS.format('r')} AS now, {CLASS.format('y')} AS truth FROM (SELECT w.series_id, w.week, CAST(year(w.week) AS INT) AS year, ln(w.value / p.value) AS r, ln(n.value / w.value) AS y FROM v_weekly w JOIN v_weekly p ON p.series_id = w.series_id AND p.week = w.week - 7 JOIN v_weekly n ON n.series_id = w.series_id AND n.week = w.week + 7)"
FREQ = "SELECT {by}, (count(*) FILTER (truth = 'DOWN') + {k}) / (count(*) + 3 * {k}) AS p_down, (count(*) FILTER (truth = 'FLAT') + {k}) / (count(*) + 3 * {k}) AS p_flat, (count(*) FILTER (truth = 'UP') + {k}) / (count(*) + 3 * {k}) AS p_up FROM ({moves}) m GROUP BY {by}"
BRIER = "(p_down - CAST(truth = 'DOWN' AS INT)) ** 2 + (p_flat - CAST(truth = 'FLAT' AS INT)) ** 2 + (p_up - CAST(truth = 'UP' AS INT)) ** 2"
LOGLOSS = "-ln(greatest(CASE truth WHEN 'DOWN' THEN p_down WHEN 'FLAT' THEN p_flat ELSE p_up END, 1e-9))"
SCORES = f"SELECT model, year, avg({BRIER}) AS brier, avg({LOGLOSS}) AS log_loss FROM v_probs GROUP BY ALL"
LONG = "SELECT model, row_id, unnest([{'c': 'DOWN', 'p': p_down}, {'c': 'FLAT', 'p': p_flat}, {'c': 'UP', 'p': p_up}]) AS x, truth FROM v_probs"
R3 = ", ".join(f"round({p}, 9) AS {p}" for p in PS)


def r9(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


def moves(t: Tables) -> DataFrame:
    """Weekly log returns, those of the next week, and the classes of both."""
    weekly = t.written.weekly
    w = calendar_lag(weekly.select("series_id", "week", "value"), ["series_id"], "week", ["value"], 1)
    after = weekly.select("series_id", F.date_sub("week", 7).alias("week"), F.col("value").alias("next_value"))
    got = w.join(after, ["series_id", "week"]).where("value_lag1 is not null")
    r, y = F.log(F.col("value") / F.col("value_lag1")), F.log(F.col("next_value") / F.col("value"))
    return got.select("series_id", "week", F.year("week").alias("year"), r.alias("r"), y.alias("y"), classify(r, 0.05).alias("now"), classify(y, 0.05).alias("truth"))


FEATURES = ["r", "abs_r"]


def folds(t: Tables) -> DataFrame:
    """Weekly rows with two features in the roles of each fold, a fold for every year with two years before it; a label is known a week after the next one ends."""
    from ..operators.datasets import walk_forward

    rows = moves(t).withColumns({"abs_r": F.abs("r"), "known": F.date_add("week", 14)})
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    return walk_forward(rows, list(range(first + 2, last + 1)) if first else [], "week", "known")


#: The same roles in SQL: w has fold and role for the rows of m.
ROLES = f"""
m AS ({MOVES}), y AS (SELECT DISTINCT year AS fold FROM m WHERE year >= (SELECT min(year) + 2 FROM m)),
f AS (SELECT m.*, fold, CASE WHEN year < fold - 1 THEN 'TRAIN' WHEN year = fold - 1 THEN 'CAL' ELSE 'TEST' END AS r0 FROM m JOIN y ON year <= fold),
b AS (SELECT fold, min(week) FILTER (r0 = 'CAL') AS cal, min(week) FILTER (r0 = 'TEST') AS test FROM f GROUP BY fold),
w AS (SELECT f.*, CASE WHEN r0 = 'TRAIN' AND week + 14 >= coalesce(cal, test) OR r0 = 'CAL' AND week + 14 >= test THEN 'PURGED' ELSE r0 END AS role FROM f JOIN b USING (fold))
"""


@query("m1_frequency", f"SELECT series_id, {R3} FROM ({FREQ.format(by='series_id', k=1, moves=MOVES)})")
def m1(t: Tables) -> DataFrame:
    return r9(fc.frequency(moves(t), ["series_id"], "truth"))


@query("m1b_frequency_jeffreys", f"SELECT series_id, {R3} FROM ({FREQ.format(by='series_id', k=0.5, moves=MOVES)})")
def m1b(t: Tables) -> DataFrame:
    return r9(fc.frequency(moves(t), ["series_id"], "truth", 0.5))


@query("m2_conditional_frequency", f"SELECT series_id, now, {R3} FROM ({FREQ.format(by='series_id, now', k=1, moves=MOVES)})")
def m2(t: Tables) -> DataFrame:
    return r9(fc.conditional_frequency(moves(t), ["series_id"], "now", "truth"))


def _soft(p: float, c: str) -> str:
    return f"CAST(CASE WHEN now = '{c}' THEN {1 - 2 * p} ELSE {p} END AS DOUBLE)"


def _of(name: str, sql: list[str]) -> str:
    return ", ".join(f"round({x}, 9) AS {name}_{c.lower()}" for x, c in zip(sql, CLASSES))


_TURNED = "CASE now WHEN 'UP' THEN 'DOWN' WHEN 'DOWN' THEN 'UP' ELSE 'FLAT' END"
_ONE = [f"CAST(now = '{c}' AS DOUBLE)" for c in CLASSES]


@query("m3_baselines", f"WITH m AS ({MOVES}), f AS ({FREQ.format(by='series_id', k=1, moves='SELECT * FROM m')}), h AS (SELECT series_id, (count(*) FILTER (now = truth) + 1) / (count(*) + 2) AS hit FROM m GROUP BY series_id) SELECT m.series_id, week, {_of('soft', [_soft(0.02, c) for c in CLASSES])}, {_of('blend', [f'0.1 * p_{c.lower()} + 0.9 * {o}' for c, o in zip(CLASSES, _ONE)])}, {_of('reversal', [f'CAST(CASE WHEN {_TURNED} = {chr(39)}{c}{chr(39)} THEN 0.96 ELSE 0.02 END AS DOUBLE)' for c in CLASSES])}, {_of('flat', ['CAST(0.02 AS DOUBLE)', 'CAST(0.96 AS DOUBLE)', 'CAST(0.02 AS DOUBLE)'])}, {_of('reliable', [f'(1 - hit) * p_{c.lower()} + hit * {o}' for c, o in zip(CLASSES, _ONE)])} FROM m JOIN f ON f.series_id = m.series_id JOIN h ON h.series_id = m.series_id")
def m3(t: Tables) -> DataFrame:
    """The last direction softened, blended with frequencies, reversed, always flat, and weighted by how often it was right."""
    m = moves(t)
    hits = m.groupBy("series_id").agg(((F.count_if(F.col("now") == F.col("truth")) + 1) / (F.count(F.lit(1)) + 2)).alias("hit"))
    both = m.join(fc.frequency(m, ["series_id"], "truth"), "series_id").join(hits, "series_id")
    now, freq = F.col("now"), [F.col(p) for p in PS]
    turned = F.when(now == "UP", "DOWN").when(now == "DOWN", "UP").otherwise(now)
    kinds = {"soft": fc.soft_direction(now, 0.02), "blend": fc.blend_onehot(freq, now), "reversal": fc.soft_direction(turned, 0.02), "flat": fc.soft_direction(F.lit("FLAT"), 0.02), "reliable": fc.blend_onehot(freq, now, F.col("hit"))}
    return r9(both.select("series_id", "week", *[x.alias(f"{k}_{c.lower()}") for k, xs in kinds.items() for x, c in zip(xs, CLASSES)]))


@query("m4_residual_cdf", f"WITH {ROLES}, p AS (SELECT fold, series_id, week, -0.1 * r AS mean FROM w WHERE role = 'TEST'), e AS (SELECT fold, series_id, y + 0.1 * r AS residual FROM w WHERE role IN ('TRAIN', 'CAL')) SELECT p.fold, p.series_id, p.week, count(*) AS n, round(count(*) FILTER (mean + residual < -0.05) / count(*), 9) AS p_down, round((count(*) - count(*) FILTER (mean + residual < -0.05) - count(*) FILTER (mean + residual > 0.05)) / count(*), 9) AS p_flat, round(count(*) FILTER (mean + residual > 0.05) / count(*), 9) AS p_up FROM p JOIN e ON e.fold = p.fold AND e.series_id = p.series_id GROUP BY ALL")
def m4(t: Tables) -> DataFrame:
    """Every fold's test rows by the residuals of what was known before them."""
    rows = folds(t)
    points = rows.where("role = 'TEST'").select("fold", "series_id", "week", (-0.1 * F.col("r")).alias("mean"))
    residuals = rows.where("role in ('TRAIN', 'CAL')").select("fold", "series_id", (F.col("y") + 0.1 * F.col("r")).alias("residual"))
    return r9(fc.residual_cdf(points, residuals, ["fold", "series_id"], "mean", "residual", 0.05).drop("mean"))


PEERS = 250


@query("m5_vol_historical", f"WITH {ROLES}, q AS (SELECT fold, series_id, week, ln(abs(r) + 1e-6) AS v FROM w WHERE role = 'TEST'), h AS (SELECT fold, series_id || '|' || week AS hid, ln(abs(r) + 1e-6) AS v, truth FROM w WHERE role IN ('TRAIN', 'CAL')), k AS (SELECT q.fold, q.series_id, q.week, h.truth FROM q JOIN h ON h.fold = q.fold QUALIFY row_number() OVER (PARTITION BY q.fold, q.series_id, q.week ORDER BY abs(q.v - h.v), h.hid) <= {PEERS}) SELECT fold, series_id, week, round(count(*) FILTER (truth = 'DOWN') / count(*), 6) AS p_down, round(count(*) FILTER (truth = 'UP') / count(*), 6) AS p_up FROM k GROUP BY ALL")
def m5(t: Tables) -> DataFrame:
    from ..operators.nearest import nearest_k

    key, vol = F.concat_ws("|", "series_id", F.col("week").cast("string")), F.log(F.abs("r") + 1e-6)

    def fit(train: DataFrame, cal: DataFrame, test: DataFrame) -> DataFrame:
        q = test.select(key.alias("id"), "fold", "series_id", "week", vol.alias("qv"))
        h = train.unionByName(cal).select(key.alias("hid"), vol.alias("hv"), "truth")
        near = nearest_k(q, h, "id", "qv", "hid", "hv", PEERS).join(h, "hid").join(q, "id")
        n = F.count(F.lit(1))
        return near.groupBy("fold", "series_id", "week").agg(F.round(F.count_if(F.col("truth") == "DOWN") / n, 6).alias("p_down"), F.round(F.count_if(F.col("truth") == "UP") / n, 6).alias("p_up"))

    return fc.per_fold(folds(t), fit)


@query("m6_logistic")
def m6(t: Tables) -> DataFrame:
    return fc.per_fold(folds(t), lambda train, _, test: fc.fit_logistic(train, test, FEATURES, "truth")).select("fold", "series_id", "week", *PS)


@query("m7_linear")
def m7(t: Tables) -> DataFrame:
    def fit(train: DataFrame, cal: DataFrame, test: DataFrame) -> DataFrame:
        ridge = fc.linear_distribution(train, cal, test.select("fold", "series_id", "week", *FEATURES), ["series_id"], FEATURES, "y", 0.05, 0.01)
        net = fc.fit_linear(train, ridge.withColumnRenamed("predicted", "ridge"), FEATURES, "y", 0.001, 0.25)
        return net.select("fold", "series_id", "week", "ridge", *PS, F.col("predicted").alias("elastic_net"))

    return fc.per_fold(folds(t), fit)


#: Levels of the quantiles that are boosted.
LEVELS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query("m29_quantile_boosting")
def m29(t: Tables) -> DataFrame:
    """Quantiles of the next return, boosted in each fold on what was known before it, and read as class probabilities."""
    from ..functions.probability import cdf_to_classes
    from ..operators.boosting import fit_quantiles

    rows = fc.cut(folds(t))
    got = fit_quantiles(rows.where("role in ('TRAIN', 'CAL')"), rows.where("role = 'TEST'").select("fold", "series_id", "week", *FEATURES), ["fold"], FEATURES, "y", LEVELS)
    return got.select("fold", "series_id", "week", *[p.alias(name) for p, name in zip(cdf_to_classes(F.col("quantiles"), LEVELS, 0.05), PS)])


def moved(df: DataFrame) -> DataFrame:
    return df.withColumns({"moved": (F.col("truth") != "FLAT").cast("int"), "up": F.when(F.col("truth") != "FLAT", (F.col("truth") == "UP").cast("int"))})


@query("m8_boosted")
def m8(t: Tables) -> DataFrame:
    fit = lambda train, _, test: fc.fit_gbt(moved(train), [test], FEATURES, "moved")[0]
    return fc.per_fold(folds(t), fit).select("fold", "series_id", "week", F.col("p_one").alias("p_move"))


@query("m9_hurdle")
def m9(t: Tables) -> DataFrame:
    """Move, then up given move, both calibrated on the fold's CAL rows, and composed to three classes."""
    from ..functions.probability import compose

    def fit(train: DataFrame, cal: DataFrame, test: DataFrame) -> DataFrame:
        for label, out in (("moved", "p_move"), ("up", "p_up_moved")):
            own_cal, own = fc.fit_logistic_binary(moved(train), [moved(cal), test], FEATURES, label)
            test = fc.calibrate_binary(own_cal, own, "p_one", label).drop("p_one").withColumnRenamed("calibrated", out)
        return test.select("fold", "series_id", "week", *[c.alias(p) for c, p in zip(compose("p_move", "p_up_moved"), PS)])

    return fc.per_fold(folds(t), fit)


def given_probabilities(t: Tables) -> DataFrame:
    """Probabilities of model m1 with their year as TEST of its fold and CAL of the next one."""
    rows = t.probs.where("model = 'm1'").select("row_id", "year", *PS, "truth")
    both = F.explode(F.array(F.struct(F.col("year").alias("fold"), F.lit("TEST").alias("role")), F.struct((F.col("year") + 1).alias("fold"), F.lit("CAL").alias("role"))))
    return rows.select("row_id", *PS, "truth", both.alias("at")).select("at.*", "row_id", *PS, "truth")


@query("m10_platt")
def m10(t: Tables) -> DataFrame:
    return fc.per_fold(given_probabilities(t), lambda _, cal, test: fc.calibrate_classes(cal, test, tuple(PS), "truth")).select("fold", "row_id", *PS)


@query("m11_isotonic")
def m11(t: Tables) -> DataFrame:
    return fc.per_fold(given_probabilities(t), lambda _, cal, test: fc.calibrate_classes(cal, test, tuple(PS), "truth", "isotonic")).select("fold", "row_id", *PS)


HAT = "CASE WHEN p_down >= p_flat AND p_down >= p_up THEN 'DOWN' WHEN p_flat >= p_up THEN 'FLAT' ELSE 'UP' END"


@query("m12_score", f"WITH p AS (SELECT *, {HAT} AS hat FROM v_probs), g AS (SELECT model, year, count(*) AS n, avg({BRIER}) AS brier, avg({LOGLOSS}) AS log_loss, avg(CAST(hat = truth AS DOUBLE)) AS accuracy, {', '.join(f'count(*) FILTER (hat = {chr(39)}{c}{chr(39)}) AS predicted_{c.lower()}, count(*) FILTER (truth = {chr(39)}{c}{chr(39)}) AS n_{c.lower()}, count(*) FILTER (truth = hat AND hat = {chr(39)}{c}{chr(39)}) AS tp_{c.lower()}' for c in CLASSES)} FROM p GROUP BY model, year) SELECT model, year, n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, predicted_down, predicted_flat, predicted_up, round(({' + '.join(f'CASE WHEN predicted_{c.lower()} + n_{c.lower()} > 0 THEN 2 * tp_{c.lower()} / (predicted_{c.lower()} + n_{c.lower()}) ELSE 0 END' for c in CLASSES)}) / 3, 6) AS macro_f1 FROM g")
def m12(t: Tables) -> DataFrame:
    return r9(sc.score(t.probs, ["model", "year"]), 6)


@query("m13_binary_score", "WITH r AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM v_binary) SELECT count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12), 1 - 1e-12)) ELSE ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) END), 6) AS log_loss, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS DOUBLE)), 6) AS accuracy, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def m13(t: Tables) -> DataFrame:
    return r9(sc.binary_score(t.binary, "p", "y"), 6)


def _reliability(bin_sql: str, last: int) -> str:
    return f"WITH l AS ({LONG}), b AS (SELECT model, x.c AS class, CAST({bin_sql} AS INT) AS bin, x.p AS p, CAST(x.c = truth AS DOUBLE) AS hit FROM l), g AS (SELECT m.model, c.class, CAST(b.bin AS INT) AS bin FROM (SELECT DISTINCT model FROM v_probs) m, (VALUES ('DOWN'), ('FLAT'), ('UP')) c(class), (SELECT unnest(range(0, {last + 1})) AS bin) b) SELECT g.model, g.class, g.bin, count(b.p) AS n, round(avg(b.p), 9) AS mean_p, round(avg(b.hit), 9) AS share FROM g LEFT JOIN b ON b.model = g.model AND b.class = g.class AND b.bin = g.bin GROUP BY ALL"


@query("m14_reliability", _reliability("least(floor(x.p * 10), 9)", 9))
def m14(t: Tables) -> DataFrame:
    return r9(sc.reliability(t.probs, ["model"]))


@query("m15_reliability_offset", _reliability("least(floor(x.p * 10 + 0.5), 10)", 10))
def m15(t: Tables) -> DataFrame:
    return r9(sc.reliability(t.probs, ["model"], offset=True))


@query("m16_calibration_error", f"WITH l AS ({LONG}), b AS (SELECT model, x.c AS c, least(floor(x.p * 10), 9) AS bin, x.p AS p, CAST(x.c = truth AS DOUBLE) AS hit FROM l), e AS (SELECT model, c, sum(n * abs(m - s)) / sum(n) AS e FROM (SELECT model, c, bin, count(*) AS n, avg(p) AS m, avg(hit) AS s FROM b GROUP BY ALL) GROUP BY ALL), t AS (SELECT model, sum(n * abs(m - s)) / sum(n) AS e FROM (SELECT model, least(floor(greatest(p_down, p_flat, p_up) * 10), 9) AS bin, count(*) AS n, avg(greatest(p_down, p_flat, p_up)) AS m, avg(CAST({HAT} = truth AS DOUBLE)) AS s FROM v_probs GROUP BY ALL) GROUP BY ALL) SELECT e.model, round(max(e.e) FILTER (c = 'DOWN'), 6) AS ece_down, round(max(e.e) FILTER (c = 'FLAT'), 6) AS ece_flat, round(max(e.e) FILTER (c = 'UP'), 6) AS ece_up, round(avg(e.e), 6) AS ece_mean, round(max(t.e), 6) AS ece_top FROM e JOIN t ON t.model = e.model GROUP BY e.model")
def m16(t: Tables) -> DataFrame:
    return r9(sc.calibration_error(t.probs, ["model"]), 6)


@query("m17_band_check", f"WITH l AS ({LONG}) SELECT model, count(*) AS n, round(avg(x.p), 6) AS mean_p, round(avg(CAST(x.c = truth AS DOUBLE)), 6) AS share FROM l WHERE x.p BETWEEN 0.55 AND 0.65 GROUP BY ALL")
def m17(t: Tables) -> DataFrame:
    return r9(sc.band_check(t.probs, ["model"], 0.55, 0.65), 6)


PAIRED = f"WITH l AS (SELECT row_id, year, day, model, {BRIER} AS loss FROM v_probs) SELECT a.row_id, a.year, a.day, a.loss AS loss_a, b.loss AS loss_b, a.loss - b.loss AS difference FROM l a JOIN l b ON a.row_id = b.row_id AND a.model = 'm1' AND b.model = 'm2'"


@query("m18_paired_losses", f"SELECT row_id, year, round(loss_a, 9) AS loss_a, round(loss_b, 9) AS loss_b, round(difference, 9) AS difference FROM ({PAIRED})")
def m18(t: Tables) -> DataFrame:
    return r9(sc.paired_losses(t.probs, "m1", "m2", ["year"]))


def block_table(t: Tables) -> DataFrame:
    """Summed differences and counts of blocks of 28 days, of which the calendar bounds the number."""
    p = sc.paired_losses(t.probs, "m1", "m2", ["day"])
    return p.groupBy(F.floor(F.datediff("day", F.lit("1992-01-01").cast("date")) / 28).alias("block")).agg(F.sum("difference").alias("total"), F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean"))


BLOCKS = f"SELECT row_number() OVER (ORDER BY block) - 1 AS i, total, n, mean, count(*) OVER () AS blocks FROM (SELECT CAST(floor((day - DATE '1992-01-01') / 28) AS BIGINT) AS block, sum(difference) AS total, count(*) AS n, avg(difference) AS mean FROM ({PAIRED}) GROUP BY ALL)"
DRAW = f"CAST(floor(((((draw * {boot.C} + place * {boot.A} + {boot.B}) % {boot.M}) * {boot.A} + {boot.B}) % {boot.M}) / 65536.0) AS BIGINT)"
INTERVAL = "SELECT count(*) AS draws, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.5), 6) AS middle, round(quantile_cont(s, 0.975), 6) AS high FROM s"


@query("m19_bootstrap_cluster", f"WITH b AS ({BLOCKS}), d AS (SELECT CAST(draw AS BIGINT) AS draw, CAST(place AS BIGINT) AS place, (SELECT max(blocks) FROM b) AS blocks FROM range(2000) r(draw), range((SELECT max(blocks) FROM b)) q(place)), s AS (SELECT draw, sum(total) / sum(n) AS s FROM d JOIN b ON b.i = {DRAW} % d.blocks GROUP BY draw) {INTERVAL}")
def m19(t: Tables) -> DataFrame:
    return r9(boot.cluster(block_table(t), "block", "total", "n", 2000), 6)


def _runs(count: str) -> str:
    return f"WITH b AS ({BLOCKS}), k AS (SELECT max(blocks) AS blocks FROM b), d AS (SELECT CAST(draw AS BIGINT) AS draw, CAST(place AS BIGINT) AS place, blocks FROM k, range(2000) r(draw), range((SELECT CAST(floor((blocks + 3) / 4) AS BIGINT) FROM k)) q(place)), o AS (SELECT draw, ({DRAW} % {count} + o) % blocks AS i, blocks FROM d, range(4) x(o) WHERE place * 4 + o < blocks), s AS (SELECT draw, avg(mean) AS s FROM o JOIN b ON b.i = o.i GROUP BY draw) {INTERVAL}"


@query("m20_bootstrap_block", _runs("greatest(blocks - 3, 1)"))
def m20(t: Tables) -> DataFrame:
    return r9(boot.moving(block_table(t), "block", "mean", 4, 2000), 6)


@query("m21_bootstrap_circular", _runs("blocks"))
def m21(t: Tables) -> DataFrame:
    return r9(boot.moving(block_table(t), "block", "mean", 4, 2000, circular=True), 6)


@query("m22_select_candidate", f"WITH s AS ({SCORES}), m AS (SELECT a.model, round(avg((a.brier / b.brier + a.log_loss / b.log_loss) / 2), 6) AS ratio, count(*) AS years FROM s a JOIN s b ON a.year = b.year AND b.model = 'm1' GROUP BY a.model) SELECT model, ratio, years, model = (SELECT min_by(model, {{'r': ratio, 'm': model}}) FROM m) AS chosen FROM m")
def m22(t: Tables) -> DataFrame:
    return sc.select_candidate(sc.score(t.probs, ["model", "year"]), "model", "year", "m1")


@query("m23_ablation", f"WITH s AS (SELECT model, avg({BRIER}) AS brier, avg({LOGLOSS}) AS log_loss FROM v_probs GROUP BY ALL) SELECT b.model, round(1 - b.brier / a.brier, 6) AS brier_gain, round(1 - b.log_loss / a.log_loss, 6) AS log_loss_gain, 1 - b.brier / a.brier >= 0.005 AND 1 - b.log_loss / a.log_loss >= 0.005 AS admitted FROM s a JOIN s b ON a.model = 'm1' AND b.model <> 'm1'")
def m23(t: Tables) -> DataFrame:
    s = sc.score(t.probs, ["model"])
    base = s.where("model = 'm1'").select(F.col("brier").alias("_b"), F.col("log_loss").alias("_l"))
    got = s.where("model != 'm1'").crossJoin(F.broadcast(base))
    b, g = 1 - F.col("brier") / F.col("_b"), 1 - F.col("log_loss") / F.col("_l")
    return got.select("model", F.round(b, 6).alias("brier_gain"), F.round(g, 6).alias("log_loss_gain"), ((b >= 0.005) & (g >= 0.005)).alias("admitted"))


@query("m24_contribution", f"WITH s AS ({SCORES}) SELECT a.year, round(a.brier - b.brier, 6) AS brier_contribution, round(a.log_loss - b.log_loss, 6) AS log_loss_contribution FROM s a JOIN s b ON a.year = b.year AND a.model = 'm1' AND b.model = 'm2'")
def m24(t: Tables) -> DataFrame:
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    s = sc.score(t.probs, ["model", "year"]).groupBy("year")
    return s.agg(*[F.round(pick("m1", c) - pick("m2", c), 6).alias(f"{c}_contribution") for c in ("brier", "log_loss")])


@query("m25_year_stability", f"WITH s AS ({SCORES}) SELECT a.model, count(*) AS years, count(*) FILTER (a.brier < b.brier AND a.log_loss < b.log_loss) AS better_years, count(*) FILTER (a.brier > b.brier AND a.log_loss > b.log_loss) = 0 AS never_worse FROM s a JOIN s b ON a.year = b.year AND a.model <> 'm1' AND b.model = 'm1' GROUP BY a.model")
def m25(t: Tables) -> DataFrame:
    return sc.year_stability(sc.score(t.probs, ["model", "year"]), "model", "m1")


@query("m26_association", f"SELECT series_id, round(corr(r, y), 6) AS correlation, round(avg(CAST(now = truth AS DOUBLE)), 6) AS label_agreement FROM ({MOVES}) GROUP BY ALL")
def m26(t: Tables) -> DataFrame:
    return moves(t).groupBy("series_id").agg(F.round(F.corr("r", "y"), 6).alias("correlation"), F.round(F.avg((F.col("now") == F.col("truth")).cast("double")), 6).alias("label_agreement"))


@query("m27_currency_sensitivity", "WITH w AS (SELECT week, b AS base, b * (0.9 + 0.2 * a / (SELECT max(a) FROM v_two_weekly)) AS converted FROM v_two_weekly), r AS (SELECT ln(x.base / y.base) AS r, ln(x.converted / y.converted) AS c FROM w x JOIN w y ON y.week = x.week - 7) SELECT round(corr(r, c), 6) AS correlation, round(avg(CAST((CASE WHEN r > 0.05 THEN 1 WHEN r < -0.05 THEN -1 ELSE 0 END) = (CASE WHEN c > 0.05 THEN 1 WHEN c < -0.05 THEN -1 ELSE 0 END) AS DOUBLE)), 6) AS class_agreement, round(stddev_samp(c), 6) AS converted_std FROM r")
def m27(t: Tables) -> DataFrame:
    top = t.two_weekly.agg(F.max("a").alias("top"))
    w = t.two_weekly.crossJoin(F.broadcast(top)).select("week", F.col("b").alias("base"), (F.col("b") * (0.9 + 0.2 * F.col("a") / F.col("top"))).alias("converted"))
    w = calendar_lag(w, [], "week", ["base", "converted"], 1).where("base_lag1 is not null")
    r = w.select(F.log(F.col("base") / F.col("base_lag1")).alias("r"), F.log(F.col("converted") / F.col("converted_lag1")).alias("c"))
    agree = (classify("r", 0.05) == classify("c", 0.05)).cast("double")
    return r.agg(F.round(F.corr("r", "c"), 6).alias("correlation"), F.round(F.avg(agree), 6).alias("class_agreement"), F.round(F.stddev_samp("c"), 6).alias("converted_std"))


HASHED = "CAST(sum(CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || chr(31) || {}), 1, 12)) AS BIGINT)) AS VARCHAR)"


@query("m28_freeze", f"SELECT 'same' AS plan, count(*) AS n, {HASHED.format('c_mktsegment')} AS hash_sum, true AS unchanged FROM customer UNION ALL SELECT 'edited', count(*), {HASHED.format(chr(39) + 'BUILDING' + chr(39))}, count(*) = count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer")
def m28(t: Tables) -> DataFrame:
    """A plan frozen by its hash, compared with itself in another order and with an edited one."""
    from ..sources.stores import check_freeze, fingerprint

    plan = t["customer"].select("c_custkey", "c_mktsegment")
    frozen = fingerprint(plan)
    same, edited = plan.repartition(3), plan.withColumn("c_mktsegment", F.lit("BUILDING"))
    return check_freeze(same, frozen).select(F.lit("same").alias("plan"), "*").union(check_freeze(edited, frozen).select(F.lit("edited"), "*"))

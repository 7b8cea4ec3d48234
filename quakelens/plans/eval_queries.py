"""Queries over graded outcomes, forecasts, evidence, proposals and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelens.functions import columns as C
from quakelens.operators import evidence, gate, governance, grading, lookups, stats
from quakelens.sources import projections as P
from quakelens.sources.projections import Query, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


# Outcomes: every customer is an incident; its nation's suppliers are the candidates, largest balance first.
def _graded(s, d):
    ranked = P.table(s, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey"))), 1, 5), lambda x: x["s_suppkey"].cast("string")).alias("ranked_candidates"))
    rows = P.table(s, d, "customer").join(ranked, F.col("c_nationkey") == F.col("s_nationkey"))
    k = F.col("c_custkey")
    return grading.grades(
        rows.select(
            k.cast("string").alias("bundle_id"), F.col("c_mktsegment").alias("family"), "ranked_candidates", F.get("ranked_candidates", 0).alias("root_cause"), (k % 6 == 0).alias("abstained"),
            F.when(k % 10 != 0, F.coalesce(F.get("ranked_candidates", (k % 7).cast("int")), F.lit("none"))).alias("target_service"), F.when(k % 4 == 0, "unknown").otherwise("slow").alias("fault_class_label"),
            F.when(k % 5 == 0, "slow").when(k % 5 < 4, "crash").alias("fault_class"), F.timestamp_seconds(k * 10).alias("onset_label"), F.when(k % 3 != 0, F.timestamp_seconds(k * 10 + k % 120)).alias("onset"),
        )
    )


GRADED = """SELECT *, CASE WHEN target IS NULL THEN 'not_applicable' WHEN NOT abstained AND rc = target THEN 'correct' ELSE 'incorrect' END AS root_cause_grade,
 CASE WHEN target IS NULL THEN 'not_applicable' WHEN place <= 3 THEN 'correct' ELSE 'incorrect' END AS top_k_grade,
 CASE WHEN k % 4 = 0 OR k % 5 = 4 THEN 'not_applicable' WHEN k % 5 = 0 THEN 'correct' ELSE 'incorrect' END AS fault_class_grade,
 CASE WHEN k % 3 <> 0 THEN (k % 120)::DOUBLE END AS onset_error, CASE WHEN k % 3 = 0 THEN 'not_applicable' WHEN k % 120 <= 60 THEN 'correct' ELSE 'incorrect' END AS onset_grade,
 CASE WHEN target IS NOT NULL THEN CASE WHEN abstained THEN 'incorrect' ELSE 'correct' END WHEN abstained THEN 'correct' ELSE 'incorrect' END AS abstention_grade
 FROM (SELECT *, list_position(ranked, target) AS place FROM (SELECT c_custkey AS k, c_mktsegment AS family, ranked, ranked[1] AS rc, c_custkey % 6 = 0 AS abstained, CASE WHEN c_custkey % 10 <> 0 THEN coalesce(ranked[c_custkey % 7 + 1], 'none') END AS target
 FROM customer JOIN (SELECT s_nationkey, list(CAST(s_suppkey AS VARCHAR) ORDER BY s_acctbal DESC, s_suppkey)[1:5] AS ranked FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey))"""
_ALL = ["root_cause_grade", "top_k_grade", "fault_class_grade", "onset_grade", "abstention_grade"]
LONG = "SELECT k, family, unnest([root_cause_grade, top_k_grade, fault_class_grade, onset_grade, abstention_grade]) AS verdict, unnest(['root_cause_grade', 'top_k_grade', 'fault_class_grade', 'onset_grade', 'abstention_grade']) AS grader FROM graded"
for _name, _column in (("e01_root_cause", "root_cause_grade"), ("e02_top_k", "top_k_grade"), ("e03_fault_class", "fault_class_grade"), ("e05_abstention", "abstention_grade")):
    add(_name, lambda s, d, c=_column: _graded(s, d).select("bundle_id", c), oracle(f"SELECT CAST(k AS VARCHAR) AS bundle_id, {_column} FROM graded", graded=GRADED))
add("e04_onset", lambda s, d: _graded(s, d).groupBy("onset_grade").agg(F.median("onset_error").alias("median_error"), F.count("*").alias("trials")), oracle("SELECT onset_grade, median(onset_error) AS median_error, count(*) AS trials FROM graded GROUP BY 1", graded=GRADED))
add("e08_headline", lambda s, d: grading.headline(_graded(s, d)).groupBy("family").agg(F.count_if("correct").alias("correct"), F.count("*").alias("trials")), oracle("SELECT family, count(*) FILTER (CASE WHEN root_cause_grade = 'not_applicable' THEN abstention_grade ELSE root_cause_grade END = 'correct') AS correct, count(*) AS trials FROM graded GROUP BY 1", graded=GRADED))
add("t05_truth_rank", lambda s, d: P.fx_outcomes(s, d).select("bundle_id", "truth", F.array_position("ranked_candidates", F.col("truth")).between(1, 3).alias("within")), oracle("SELECT bundle_id, truth, coalesce(list_position(ranked_candidates, truth), 0) BETWEEN 1 AND 3 AS within FROM fx_outcomes", "fx_outcomes"))
add(
    "a16_grader_summary", lambda s, d: grading.grader_summary(grading.long_grades(_graded(s, d), ["bundle_id", "family"], _ALL), ["grader"]),
    oracle("SELECT grader, count(*) AS trials, count(*) FILTER (verdict <> 'not_applicable') AS applicable, count(*) FILTER (verdict = 'correct') AS correct, round(count(*) FILTER (verdict <> 'not_applicable') / count(*), 6) AS coverage, round(count(*) FILTER (verdict = 'correct') / nullif(count(*) FILTER (verdict <> 'not_applicable'), 0), 6) AS accuracy FROM long_ GROUP BY 1", graded=GRADED, long_=LONG),
)
add("a15_baseline", lambda s, d: grading.baseline_summary(_graded(s, d).withColumns({"root_cause": F.when(~F.col("abstained"), F.col("root_cause")), "calls": F.size("ranked_candidates")}), "family"),
    oracle("SELECT family, count(*) FILTER ((target IS NOT NULL AND NOT abstained AND rc = target) OR (target IS NULL AND abstained)) AS correct, count(*) FILTER (target IS NOT NULL AND NOT abstained AND rc <> target) AS named_wrong, count(*) FILTER (target IS NOT NULL AND abstained) AS abstained_on_real, count(*) FILTER (target IS NULL AND NOT abstained) AS invented, round(avg(len(ranked)), 6) AS mean_calls FROM graded GROUP BY ROLLUP (family)", graded=GRADED))
add("j05_unmatched", lambda s, d: grading.unmatched(P.table(s, d, "orders").select(F.col("o_custkey").alias("bundle_id")), P.table(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("bundle_id"))),
    "SELECT DISTINCT o_custkey AS bundle_id, 'no label' AS finding FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT c_custkey, 'no outcome' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")


def _cited(s, d):
    cites = P.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("bundle_id")).agg(F.collect_set(F.when(F.col("l_linenumber") < 6, F.col("l_partkey"))).alias("cited_evidence"))
    return cites, P.table(s, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_partkey").alias("evidence_id"))


add("e06_evidence_validity", lambda s, d: grading.evidence_validity(*_cited(s, d)), "SELECT bundle_id, count(e) AS cited, count(*) FILTER (h) AS resolved, round(count(*) FILTER (h) / nullif(count(e), 0), 6) AS share FROM (SELECT k.o AS bundle_id, c.e, EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = k.o AND x.l_partkey = c.e AND x.l_returnflag <> 'N') AS h FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem) k LEFT JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS e FROM lineitem WHERE l_linenumber < 6) c USING (o)) GROUP BY 1")


def _proposals(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(k.alias("proposal_id"), F.when(k % 9 != 0, F.col("o_orderpriority")).alias("action"), F.col("o_orderstatus").alias("flag"), F.when(k % 8 != 0, F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("flag_label"), (k % 6).alias("service"), F.when(k % 7 == 0, -1).otherwise(k % 6).alias("service_label"))


add("e07_remediation", lambda s, d: grading.remediation_grade(_proposals(s, d), s.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "action string")).select("proposal_id", "remediation_grade"),
    "SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 8 = 0 THEN 'not_applicable' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'correct' ELSE 'incorrect' END AS remediation_grade FROM orders")
add("a17_task_scores", lambda s, d: grading.task_scores(P.fx_forecast(s, d).withColumn("value", F.col("outcome").cast("double")), ["task"], ["source"]), oracle("SELECT source, round(avg(x), 6) AS score, count(*) AS tasks FROM (SELECT source, task, avg(outcome::INT) AS x FROM fx_forecast GROUP BY ALL) GROUP BY 1", "fx_forecast"))


def _costs(s, d):
    return P.table(s, d, "orders").select(F.col("o_orderpriority").alias("tier"), (F.col("o_orderkey") % 17).alias("calls"), (F.col("o_totalprice") / 1e6).alias("usd"), F.floor(F.col("o_totalprice") / 100).alias("tokens"), (F.col("o_orderkey") % 997).alias("seconds"))


add("a18_cost_summary", lambda s, d: grading.cost_summary(_costs(s, d), ["tier"]),
    "WITH c AS (SELECT o_orderpriority AS tier, o_orderkey % 17 AS calls, o_totalprice / 1e6 AS usd, CAST(floor(o_totalprice / 100) AS BIGINT) AS tokens, o_orderkey % 997 AS seconds FROM orders), q AS (SELECT tier, list(seconds ORDER BY seconds) AS l FROM c GROUP BY 1) SELECT tier, mean_calls, mean_usd, median_usd, tokens, l[least(CAST(floor(0.5::DOUBLE * len(l)) AS BIGINT), len(l) - 1) + 1] AS p50_seconds, l[least(CAST(floor(0.95::DOUBLE * len(l)) AS BIGINT), len(l) - 1) + 1] AS p95_seconds FROM (SELECT tier, round(avg(calls), 6) AS mean_calls, round(avg(usd), 6) AS mean_usd, round(median(usd), 6) AS median_usd, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY 1) JOIN q USING (tier)")
add("a20_split_summary", lambda s, d: grading.split_summary(P.table(s, d, "customer").select(governance.split_of(F.col("c_custkey").cast("string")).alias("split"), F.col("c_mktsegment").alias("family"))).withColumn("families", F.array_join("families", ",")),
    "SELECT split, count(*) AS tasks, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM (SELECT c_mktsegment AS family, CASE WHEN f < 0.5 THEN 'train' WHEN f < 0.7 THEN 'validation' ELSE 'test_id' END AS split FROM (SELECT *, ('0x' || substr(sha256('split:' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS f FROM customer)) GROUP BY 1")


def _families(s, d):
    k = F.col("p_partkey") % 3
    return P.table(s, d, "part").select(F.when(k == 0, "train").when(k == 1, "test_id").otherwise("test_ood").alias("split"), F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("family"))


add("u04_split_soundness", lambda s, d: grading.split_soundness(_families(s, d)),
    "WITH p AS (SELECT p_partkey % 3 AS m, p_brand || p_type || p_size AS family FROM part) SELECT DISTINCT family, 'overlap' AS finding FROM p WHERE m = 2 AND family IN (SELECT family FROM p WHERE m = 0) UNION ALL SELECT DISTINCT family, 'never trained' FROM p WHERE m = 1 AND family NOT IN (SELECT family FROM p WHERE m = 0)")
add("a23_by_group", lambda s, d: stats.brier(grading.by_group(P.fx_forecast(s, d), P.table(s, d, "documents").filter("lang <> 'fr'").select("doc_id", "lang"), "doc_id"), ["lang"]), oracle("SELECT lang, round(avg((confidence - outcome::INT) ** 2), 6) AS brier FROM fx_forecast JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'fr') USING (doc_id) GROUP BY 1", "fx_forecast"))
add("a24_call_costs", lambda s, d: grading.call_costs(P.table(s, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens")), s.createDataFrame([("A", 3.0, 15.0), ("R", 0.25, 1.25)], "model string, input_price double, output_price double")),
    "SELECT model, count(*) AS calls, round(sum((l_partkey * i + l_suppkey * o) / 1e6), 6) AS usd, count(*) FILTER (i IS NULL) AS unpriced FROM (SELECT l_returnflag AS model, * FROM lineitem) LEFT JOIN (VALUES ('A', 3.0::DOUBLE, 15.0::DOUBLE), ('R', 0.25::DOUBLE, 1.25::DOUBLE)) v(model, i, o) USING (model) GROUP BY 1")

# Statistics
N_BOOT, SEED = stats.RESAMPLES, stats.SEED
_NAMED = f"SELECT *, ('0x' || md5(task::VARCHAR)[1:8])::BIGINT & {stats.BITS} AS bits FROM @source@ WHERE value IS NOT NULL"
_MIXED = f"SELECT * EXCLUDE h, xor(h, h >> 15) >> {31 - stats.WEIGHT_BITS} AS h FROM (SELECT * EXCLUDE h, (xor(h, h >> 12) * {stats.MIX[3]}) & {stats.BITS} AS h FROM (SELECT * EXCLUDE h, (xor(h, h >> 15) * {stats.MIX[2]}) & {stats.BITS} AS h FROM (SELECT *, (r * {stats.MIX[0]} + bits * {stats.MIX[1]} + {SEED}) & {stats.BITS} AS h FROM ({_NAMED}), range({N_BOOT}) t(r))))"
_WEIGHT = " + ".join(f"(h >= {step})::INT" for step in stats.STEPS)
TASKS = "SELECT source, doc_id AS task, outcome::INT::DOUBLE AS value FROM fx_forecast"


def _boot(source: str, by: str) -> str:
    return f"""SELECT {by}, estimate, tasks, lower, upper FROM (SELECT {by}, round(avg(value), 6) AS estimate, count(*) AS tasks FROM {source} GROUP BY 1) JOIN (
 SELECT {by}, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM (
  SELECT {by}, r, sum(w * value) / sum(w) AS m FROM (SELECT {by}, r, value, {_WEIGHT} AS w FROM ({_MIXED.replace('@source@', source)})) GROUP BY ALL HAVING sum(w) > 0) GROUP BY 1) USING ({by})"""


add("e09_bootstrap", lambda s, d: stats.bootstrap(P.fx_forecast(s, d).select("source", F.col("doc_id").alias("task"), F.col("outcome").cast("double").alias("value")), ["source"], N_BOOT), oracle(_boot("tasks", "source"), "fx_forecast", tasks=TASKS))


def _side(s, d, conf):
    return P.fx_forecast(s, d).filter(F.col("configuration") == conf).select(F.lit("g" if conf else "").alias("grader"), "task", F.col("outcome").cast("double").alias("value"))


PAIRED = "SELECT 'g' AS grader, task, a.outcome::INT::DOUBLE - b.outcome::INT AS value FROM fx_forecast a JOIN fx_forecast b USING (task) WHERE a.configuration = 'a' AND b.configuration = 'b'"
add("j06_paired", lambda s, d: stats.paired_differences(_side(s, d, "a"), _side(s, d, "b"), ["grader", "task"]), oracle("SELECT * FROM tasks", "fx_forecast", tasks=PAIRED))
add("e10_paired_bootstrap", lambda s, d: stats.paired_bootstrap(_side(s, d, "a"), _side(s, d, "b"), ["grader"], N_BOOT), oracle(f"SELECT *, lower > 0 OR upper < 0 AS excludes_zero FROM ({_boot('tasks', 'grader')})", "fx_forecast", tasks=PAIRED))
add("e17_compare", lambda s, d: gate.compare(_side(s, d, "a"), _side(s, d, "b"), N_BOOT),
    oracle(f"SELECT *, lower > 0 OR upper < 0 AS excludes_zero, (SELECT count(*) FILTER (n = 1) FROM (SELECT task, count(*) AS n FROM fx_forecast GROUP BY 1)) AS unpaired FROM ({_boot('tasks', 'grader')})", "fx_forecast", tasks=PAIRED))


def _checks(s, d, resamples=N_BOOT):
    named = lambda c: _side(s, d, c).withColumn("grader", F.lit("root_cause"))
    return gate.gate_checks(stats.paired_bootstrap(named("a"), named("b"), ["grader"], resamples))


def _verdict(s, d):
    b = lambda c: P.fx_forecast(s, d).filter(F.col("configuration") == c)
    error = lambda c: b(c).select(F.lit("c").alias("grader"), "task", F.pow(F.col("confidence") - F.col("outcome").cast("double"), 2).alias("value"))
    calibration = stats.paired_bootstrap(error("a"), error("b"), ["grader"], stats.RESAMPLES).select("estimate", "upper")
    costs = b("a").agg(F.median(F.col("n_chars") / 1e4).alias("candidate")).crossJoin(b("b").agg(F.median(F.col("n_chars") / 1e4).alias("baseline")))
    return gate.gate_verdict(_checks(s, d, stats.RESAMPLES), calibration, costs, b("a").agg(F.count_distinct("task").alias("tasks")))


_CHECKED = f"SELECT estimate, lower, CASE WHEN lower >= -0.03 THEN 'passed' WHEN estimate >= -0.03 THEN 'underpowered' ELSE 'regressed' END AS c FROM ({_boot('tasks', 'grader')})"
add("e18_gate_checks", lambda s, d: _checks(s, d).select("grader", "estimate", "lower", "check"), oracle(f"SELECT 'root_cause' AS grader, estimate, lower, c AS \"check\" FROM ({_CHECKED})", "fx_forecast", tasks=PAIRED))
ERRORS = "SELECT 'c' AS grader, task, pow(a.confidence - a.outcome::INT, 2) - pow(b.confidence - b.outcome::INT, 2) AS value FROM fx_forecast a JOIN fx_forecast b USING (task) WHERE a.configuration = 'a' AND b.configuration = 'b'"
add(
    "e18_gate_verdict", lambda s, d: _verdict(s, d),
    oracle(
        f"""SELECT n AS tasks, regressed, underpowered, CASE WHEN n < 10 THEN 'INCONCLUSIVE' WHEN regressed > 0 THEN 'FAIL_QUALITY' WHEN underpowered > 0 THEN 'INCONCLUSIVE'
 WHEN upper > 0.02 AND estimate <= 0.02 THEN 'INCONCLUSIVE' WHEN upper > 0.02 THEN 'FAIL_CALIBRATION' WHEN greatest(x, y) >= 0.01 AND y > 0 AND (x - y) / y > 0.2 THEN 'FAIL_COST' ELSE 'PASS' END AS verdict
 FROM (SELECT count(*) FILTER (c = 'regressed') AS regressed, count(*) FILTER (c = 'underpowered') AS underpowered FROM ({_CHECKED})), (SELECT estimate, upper FROM ({_boot("errors", "grader")})),
 (SELECT count(DISTINCT task) FILTER (configuration = 'a') AS n, median(n_chars / 1e4) FILTER (configuration = 'a') AS x, median(n_chars / 1e4) FILTER (configuration = 'b') AS y FROM fx_forecast)""",
        "fx_forecast", tasks=PAIRED, errors=ERRORS,
    ),
)
add("e11_percentile", lambda s, d: stats.percentile(P.fx_forecast(s, d), "confidence", ["source"], 0.9), oracle("SELECT source, round(quantile_cont(confidence, 0.9), 6) AS percentile FROM fx_forecast GROUP BY 1", "fx_forecast"))
add("e12_brier", lambda s, d: stats.brier(P.fx_forecast(s, d), ["configuration"]), oracle("SELECT configuration, round(avg((confidence - outcome::INT) ** 2), 6) AS brier FROM fx_forecast GROUP BY 1", "fx_forecast"))
BIN = "least(CAST(floor(confidence / 0.1::DOUBLE) AS BIGINT), 9)"
add("e13_bins", lambda s, d: stats.calibration_bins(P.fx_forecast(s, d)), oracle(f"SELECT b AS bin, coalesce(n, 0) AS predictions, round(coalesce(c, 0), 6) AS mean_confidence, round(coalesce(a, 0), 6) AS accuracy FROM range(10) r(b) LEFT JOIN (SELECT {BIN} AS b, count(*) AS n, avg(confidence) AS c, avg(outcome::INT) AS a FROM fx_forecast GROUP BY 1) USING (b)", "fx_forecast"))
CAL = f"SELECT {{g}} AS g, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, CAST(sum(n) AS BIGINT) AS predictions FROM (SELECT {{g}}, {BIN} AS b, count(*) AS n, abs(avg(confidence) - avg(outcome::INT)) AS gap FROM {{t}} GROUP BY ALL) GROUP BY 1"
add("e13_calibration", lambda s, d: stats.calibration(P.fx_forecast(s, d), ["configuration"]), oracle(f"SELECT g AS configuration, ece, mce, predictions FROM ({CAL.format(g='configuration', t='fx_forecast')})", "fx_forecast"))
SELECTIVE = "SELECT {g}, count(*) AS total, count(*) FILTER (answered) AS answered, round(count(*) FILTER (answered) / count(*), 6) AS coverage, round(coalesce(count(*) FILTER (answered AND outcome) / nullif(count(*) FILTER (answered), 0), 0), 6) AS selective_accuracy, round(count(*) FILTER (outcome) / count(*), 6) AS overall_accuracy FROM {t} GROUP BY 1"
add("e14_selective", lambda s, d: stats.selective(P.fx_forecast(s, d), ["configuration"]), oracle(SELECTIVE.format(g="configuration", t="fx_forecast"), "fx_forecast"))
add("e14_risk_coverage", lambda s, d: stats.risk_coverage(P.fx_forecast(s, d), ["configuration"]),
    oracle("SELECT configuration, threshold, round(k / t, 6) AS coverage, round(coalesce(r / nullif(k, 0), 0), 6) AS accuracy, round(1 - coalesce(r / nullif(k, 0), 0), 6) AS risk FROM (SELECT m.configuration, m.threshold, count(*) AS t, count(*) FILTER (answered AND confidence >= threshold) AS k, count(*) FILTER (answered AND outcome AND confidence >= threshold) AS r FROM (SELECT DISTINCT configuration, round(confidence, 6) AS threshold FROM fx_forecast UNION SELECT configuration, 0 FROM fx_forecast) m JOIN fx_forecast f USING (configuration) GROUP BY ALL)", "fx_forecast"))
TRIALS = "SELECT l_returnflag AS g, l_partkey % 200 AS task, count(*) AS n, count(*) FILTER (l_quantity > 25) AS c FROM lineitem GROUP BY ALL"
_FALL = lambda x: f"({x}::DOUBLE * ({x} - 1) * ({x} - 2))"
add("e15_reliability", lambda s, d: stats.reliability(P.table(s, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_partkey") % 200).alias("task"), (F.col("l_quantity") > 25).alias("outcome")), ["g"], 3),
    oracle(f"SELECT g, round(avg(CASE WHEN n - c < 3 THEN 1 ELSE 1 - {_FALL('(n - c)')} / {_FALL('n')} END), 6) AS pass_at_k, round(avg(CASE WHEN c < 3 THEN 0 ELSE {_FALL('c')} / {_FALL('n')} END), 6) AS pass_hat_k, count(*) AS tasks FROM trials GROUP BY 1", trials=TRIALS))
add("e16_all_metrics", lambda s, d: gate.all_metrics(P.fx_forecast(s, d), "source").select("source", "total", "coverage", "selective_accuracy", "brier", "ece", "mce"),
    oracle(f"SELECT nullif(g, 'all') AS source, total, coverage, selective_accuracy, brier, ece, mce FROM ({SELECTIVE.format(g='g', t='both_')}) JOIN ({CAL.format(g='g', t='both_')}) USING (g) JOIN (SELECT g, round(avg((confidence - outcome::INT) ** 2), 6) AS brier FROM both_ GROUP BY 1) USING (g)", "fx_forecast", both_="SELECT source AS g, * FROM fx_forecast UNION ALL SELECT 'all', * FROM fx_forecast"))
add("e19_kappa", lambda s, d: stats.kappa(P.fx_raters(s, d).withColumn("half", F.col("doc_id") % 2), ["half"]),
    oracle("SELECT half, n, round(o, 6) AS agreement, round(k, 6) AS kappa, n >= 60 AND k >= 0.4 AS trusted FROM (SELECT *, CASE WHEN e >= 1 THEN 0 ELSE (o - e) / (1 - e) END AS k FROM (SELECT *, p * q + (1 - p) * (1 - q) AS e FROM (SELECT doc_id % 2 AS half, count(*) AS n, avg((first = second)::INT) AS o, avg(first::INT) AS p, avg(second::INT) AS q FROM fx_raters GROUP BY 1)))", "fx_raters"))


def _cases(s, d):
    return P.fx_forecast(s, d).select(F.round("confidence", 2).alias("score"), (~F.col("outcome")).alias("faulted"))


CASES = "SELECT round(confidence, 2) AS score, NOT outcome AS faulted FROM fx_forecast"
CURVE = "SELECT score, round(h / tf, 6) AS sensitivity, round(1 - a / tq, 6) AS specificity, round(h / tf + 1 - a / tq - 1, 6) AS youden FROM (SELECT score, sum(f) OVER w AS h, sum(q) OVER w AS a, sum(f) OVER () AS tf, sum(q) OVER () AS tq FROM (SELECT score, count(*) FILTER (faulted) AS f, count(*) FILTER (NOT faulted) AS q FROM cases GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"
add("e20_threshold_curve", lambda s, d: stats.threshold_curve(_cases(s, d)), oracle(CURVE, "fx_forecast", cases=CASES))
add("e20_tuned_threshold", lambda s, d: stats.tuned_threshold(_cases(s, d)), oracle("SELECT qm AS quiet_max, fm AS faulted_min, qm < fm AS separable, round(CASE WHEN qm < fm THEN sqrt(qm * fm) ELSE s END, 6) AS threshold FROM (SELECT max(score) FILTER (NOT faulted) AS qm, min(score) FILTER (faulted) AS fm FROM cases), (SELECT max((youden, score))[2] AS s FROM curve)", "fx_forecast", cases=CASES, curve=CURVE))
add("e22_optimisation", lambda s, d: stats.optimisation_score(P.fx_forecast(s, d).withColumn("evidence", F.col("answered").cast("double"))).select("doc_id", "score"), oracle("SELECT doc_id, round(0.55::DOUBLE * outcome::INT + 0.30::DOUBLE * answered::INT + 0.15::DOUBLE * (1 - (confidence - outcome::INT) ** 2), 6) AS score FROM fx_forecast", "fx_forecast"))
add("e23_result_status", lambda s, d: gate.result_status(P.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("split"), (F.col("o_custkey") % 20).alias("run")).agg(F.count("*").alias("tasks")).withColumn("stub", F.col("run") % 4 == 0), P.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("split")).agg(F.floor(F.count("*") / 20).alias("available"))).select("split", "run", "quotable", F.array_join("caveats", ",").alias("caveats")),
    "SELECT split, run, c = '' AS quotable, c AS caveats FROM (SELECT split, run, concat_ws(',', CASE WHEN tasks < 30 THEN 'few tasks' END, CASE WHEN run % 4 = 0 THEN 'stub model' END, CASE WHEN tasks < available THEN 'stale' END) AS c FROM (SELECT o_orderpriority AS split, o_custkey % 20 AS run, count(*) AS tasks FROM orders GROUP BY ALL) JOIN (SELECT o_orderpriority AS split, count(*) // 20 AS available FROM orders GROUP BY 1) USING (split))")
add("e25_blind_sample", lambda s, d: gate.blind_sample(P.table(s, d, "labels"), "doc_id", ["quality", "toxic"], 50), "SELECT doc_id, sha256('blind:' || doc_id) AS ticket FROM labels ORDER BY 2 LIMIT 50")
add("e25_labelled_back", lambda s, d: gate.labelled_back(P.table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, " good ").when(F.col("toxic") == 1, " ").alias("verdict"))), "SELECT doc_id, ' good ' AS verdict FROM labels WHERE quality = 1")
add("w08_latest", lambda s, d: lookups.latest(P.table(s, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey"), "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
add("j09_membership", lambda s, d: lookups.membership(P.table(s, d, "documents").select("doc_id", "lang"), P.table(s, d, "labels"), "doc_id", "lang"), "SELECT lang, count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS awaiting FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
add("j10_profiles", lambda s, d: lookups.profiles(P.table(s, d, "nation").select(F.col("n_name").alias("service")), {"parts": P.table(s, d, "supplier").join(P.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("s_acctbal > 9000").select(F.col("n_name").alias("service"), F.col("s_name").alias("item"))}).withColumn("parts", F.array_join("parts", ",")),
    "SELECT n_name AS service, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS parts FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY 1")
add("j08_referential", lambda s, d: governance.referential_findings({"customer": (P.table(s, d, "customer").select(F.col("c_custkey").alias("k")), P.table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k"), "supplier": (P.table(s, d, "supplier").select(F.col("s_nationkey").alias("k")), P.table(s, d, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("k")), "k")}),
    "SELECT 'customer' AS rule, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'supplier', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3")
add("j08_one_owner", lambda s, d: governance.not_exactly_one(P.table(s, d, "orders"), "o_custkey", "o_orderstatus"), "SELECT o_custkey, count(DISTINCT o_orderstatus) AS owners FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 1")

# Evidence
_ASKED = "'q' || o_orderkey || chr(10) || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) || o_orderstatus"
add("v01_question_id", lambda s, d: P.table(s, d, "orders").select("o_orderkey", C.question_id("metric", F.concat(F.lit("q"), F.col("o_orderkey").cast("string")), F.col("o_orderdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus")).alias("evidence_id")), f"SELECT o_orderkey, 'ev_metric_' || substr(sha256({_ASKED}), 1, 12) AS evidence_id FROM orders")
HASHES = """SELECT l_orderkey, count(*) AS row_count, sha256(string_agg('{"l_partkey":"' || l_partkey || '","l_returnflag":"' || l_returnflag || '"}', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, '{"l_partkey":"' || l_partkey || '","l_returnflag":"' || l_returnflag || '"}')) AS result_sha256 FROM lineitem GROUP BY 1"""
add("v02_result_hash", lambda s, d: evidence.result_hashes(P.table(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey", "l_returnflag"]), HASHES)
add("v03_repeats", lambda s, d: evidence.without_repeats(P.table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", ["l_orderkey", "l_linenumber"]), "SELECT l_partkey, l_orderkey, l_linenumber, n - 1 AS repeats FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE r = 1")


def _runs(s, d):
    first = P.table(s, d, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("result_sha256"))
    again = P.table(s, d, "orders").filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus")).alias("result_sha256"))
    facts = P.table(s, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), (F.col("l_returnflag") != "R").alias("holds"))
    return first, again, facts


add("v04_re_execution", lambda s, d: evidence.re_execution(*_runs(s, d)), "SELECT o_orderkey AS evidence_id, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 5 <> 0 THEN 'same' WHEN coalesce(h, false) THEN 'drifted' ELSE 'mismatched' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
add("j13_cited_numbers", lambda s, d: evidence.cited_numbers(P.table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("evidence_id"), F.lit("price").alias("field"), (F.col("o_totalprice") * 0.15).alias("cited")), P.table(s, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.lit("price").alias("field"), F.col("l_extendedprice").alias("value"), F.lit("usd").alias("unit"))).select("claim_id", "holds"),
    "SELECT o_orderkey AS claim_id, coalesce(bool_or(abs(o_totalprice * 0.15::DOUBLE - l_extendedprice) <= greatest(abs(l_extendedprice) * 0.01::DOUBLE, 1e-9)), false) AS holds FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")


def _claims(s, d):
    return P.table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array("o_custkey", F.col("o_custkey") + 900)).alias("evidence_ids"))


COVER = "SELECT o_orderkey AS claim_id, 'cites nothing' AS finding FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'unknown evidence' FROM orders WHERE o_orderkey % 7 <> 0 AND (o_custkey NOT IN (SELECT c_custkey FROM customer) OR o_custkey + 900 NOT IN (SELECT c_custkey FROM customer))"
_HELD = lambda s, d: P.table(s, d, "customer").select(F.col("c_custkey").alias("evidence_id"))
add("v05_coverage", lambda s, d: evidence.coverage_findings(_claims(s, d), _HELD(s, d)), COVER)
add("v09_gated", lambda s, d: evidence.gated(_claims(s, d), evidence.coverage_findings(_claims(s, d), _HELD(s, d))).select("claim_id"), f"SELECT o_orderkey AS claim_id FROM orders WHERE o_orderkey NOT IN (SELECT claim_id FROM ({COVER}))")
add("w11_order", lambda s, d: evidence.out_of_order(P.table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("position"), F.col("o_orderdate").cast("timestamp").alias("at")), "o_custkey").select("o_custkey", "position"), "SELECT o_custkey, o_orderkey AS position FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders) WHERE o_orderdate > f")


def _votes(s, d):
    return P.table(s, d, "lineitem").select((F.col("l_orderkey") % 500).cast("string").alias("bundle_id"), (F.col("l_suppkey") % 5).cast("string").alias("hypothesis"), (F.col("l_partkey") % 40).alias("evidence_id"), (F.col("l_returnflag") != "R").alias("supports"))


BOARD = "SELECT bundle_id, hypothesis, f AS \"for\", a AS against, f - a AS support, f - a >= 2 AS suffices FROM (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS bundle_id, CAST(l_suppkey % 5 AS VARCHAR) AS hypothesis, count(DISTINCT l_partkey % 40) FILTER (l_returnflag <> 'R') AS f, count(DISTINCT l_partkey % 40) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY ALL)"
_REPORTS = lambda s, d: _votes(s, d).select("bundle_id").distinct().withColumns({"root_cause": (F.col("bundle_id").cast("int") % 5).cast("string"), "confidence": F.col("bundle_id").cast("int") / 500.0})
add("v08_board", lambda s, d: evidence.board(_votes(s, d)), BOARD)
add("v06_inconsistent", lambda s, d: evidence.inconsistent(_REPORTS(s, d), evidence.board(_votes(s, d))).select("bundle_id", "root_cause", "leading"), f"SELECT bundle_id, CAST(bundle_id::INT % 5 AS VARCHAR) AS root_cause, \"leading\" FROM (SELECT bundle_id, min((-support, hypothesis))[2] AS \"leading\" FROM ({BOARD}) GROUP BY 1) WHERE CAST(bundle_id::INT % 5 AS VARCHAR) <> \"leading\"")
add("v07_too_sure", lambda s, d: evidence.too_sure(_REPORTS(s, d), _votes(s, d).filter("evidence_id < 2").select("bundle_id", F.col("evidence_id").alias("kind"))).select("bundle_id"), "SELECT b AS bundle_id FROM (SELECT DISTINCT CAST(l_orderkey % 500 AS VARCHAR) AS b FROM lineitem) LEFT JOIN (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS b, count(DISTINCT l_partkey % 40) AS k FROM lineitem WHERE l_partkey % 40 < 2 GROUP BY 1) USING (b) WHERE b::INT / 500.0::DOUBLE > 0.8 AND coalesce(k, 0) < 2")
add("v20_fetch", lambda s, d: evidence.fetch(P.table(s, d, "customer").select(F.col("c_custkey").alias("evidence_id"), "c_name"), P.table(s, d, "orders").select((F.col("o_custkey") * 2).alias("evidence_id")).distinct()), "SELECT DISTINCT o_custkey * 2 AS evidence_id, c_name, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
add("v13_agreement", lambda s, d: governance.agreement(P.table(s, d, "orders"), "o_custkey", "o_orderstatus"), "SELECT o_custkey, count(*) AS reviews, CASE WHEN count(*) >= 2 THEN count(DISTINCT o_orderstatus) = 1 END AS agreed FROM orders GROUP BY 1")
add("v15_proposals", lambda s, d: governance.proposal_findings(P.table(s, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderpriority").alias("action"), F.col("o_custkey").alias("service"), (F.col("o_orderkey") % 4).alias("evidence"), (F.col("o_orderstatus") == "F").alias("approved")), s.createDataFrame([("1-URGENT", True), ("2-HIGH", False), ("5-LOW", True)], "action string, reversible boolean"), P.table(s, d, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("service"))).withColumn("findings", F.array_join("findings", ",")),
    "SELECT o_orderkey AS proposal_id, concat_ws(',', CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'not allowed' END, CASE WHEN o_orderkey % 4 = 0 THEN 'no evidence' END, CASE WHEN o_custkey % 9 = 0 THEN 'unknown target' END, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' THEN 'needs approval' END) AS findings FROM orders")
add("v16_executed", lambda s, d: governance.already_executed(P.table(s, d, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.when(F.col("l_returnflag") == "R", "executed").otherwise("proposed").alias("decision"))), "SELECT l_orderkey AS proposal_id, bool_or(l_returnflag = 'R') AS executed FROM lineitem GROUP BY 1")
add("v19_undeclared", lambda s, d: governance.undeclared(P.table(s, d, "part").select(F.col("p_brand").alias("flag"), F.col("p_type").alias("variant")), P.table(s, d, "part").filter("p_brand <> 'Brand#2' and p_size < 3").select(F.col("p_brand").alias("flag"), F.col("p_type").alias("variant")).distinct()),
    "WITH i AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand <> 'Brand#2' AND p_size < 3) SELECT DISTINCT p_brand AS flag, p_type AS variant, CASE WHEN p_brand NOT IN (SELECT p_brand FROM i) THEN 'unknown flag' ELSE 'unknown variant' END AS finding FROM part p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.p_brand = p.p_brand AND i.p_type = p.p_type)")


def _chain(s, d):
    """A record for each turn; a record's hash is of its own fields, and a turn of every fifth conversation is altered."""
    c = P.table(s, d, "conversations").select("conv_id", F.col("turn").alias("sequence"), "role", F.md5("text").alias("reason"))
    digest = lambda turn: F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), turn.cast("string")), 256)
    previous = F.when(F.col("sequence") == 0, "").otherwise(digest(F.col("sequence") - 1))
    altered = (F.col("conv_id") % 5 == 0) & (F.col("sequence") == 2)
    return c.withColumns({"previous_hash": previous, "record_hash": digest(F.col("sequence"))}).withColumn("record_hash", F.when(altered, "0").otherwise(F.col("record_hash")))


add("w07_chain", lambda s, d: governance.chain_breaks(_chain(s, d).withColumn("record_hash", F.when(F.col("record_hash") == "0", "0").otherwise(governance.record_hash(F.col("previous_hash"), [F.col("sequence").cast("string"), F.col("role"), F.col("reason")]))).withColumn("previous_hash", F.coalesce(F.when(F.col("sequence") == 0, ""), F.col("previous_hash"))), "conv_id", ["role", "reason"]),
    """WITH c AS (SELECT conv_id, turn AS q, role, md5(text) AS reason, CASE WHEN turn = 0 THEN '' ELSE sha256(conv_id || '|' || (turn - 1)) END AS previous FROM conversations),
 own AS (SELECT *, sha256(concat_ws('|', previous, q, role, reason)) AS h FROM c), held AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND q = 2 THEN '0' ELSE h END AS record FROM own)
 SELECT r.conv_id, min(r.q) AS first_break FROM held r LEFT JOIN held b ON b.conv_id = r.conv_id AND b.q = r.q - 1
 WHERE r.h <> r.record OR r.q <> 0 AND r.previous IS DISTINCT FROM b.record GROUP BY 1""")
add("w10_stalls", lambda s, d: governance.stalls(P.fx_calls(s, d).withColumn("held", F.floor(F.col("tokens") / 200)), "conv_id", "held", 1).select("conv_id", "round"), oracle("SELECT conv_id, round FROM (SELECT conv_id, round, tokens // 200 AS h, lag(tokens // 200) OVER (PARTITION BY conv_id ORDER BY round) AS p FROM fx_calls) WHERE h = p", "fx_calls"))
add("w10_repeated_calls", lambda s, d: governance.repeated_calls(P.fx_calls(s, d), "conv_id", "call"), oracle("SELECT conv_id, call, count(*) AS times FROM fx_calls GROUP BY ALL HAVING count(*) >= 3", "fx_calls"))


def _files(s, d):
    return P.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "lang", "source")


#: Every document is in the manifest but German ones; French files are gone, Spanish ones have other contents.
add(
    "v10_checksums", lambda s, d: governance.checksum_findings(_files(s, d).filter("lang <> 'fr'").select("name", F.when(F.col("lang") == "es", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256")), _files(s, d).filter("lang <> 'de'").select("name", "sha256")),
    "SELECT CAST(doc_id AS VARCHAR) AS name, CASE lang WHEN 'fr' THEN 'missing' WHEN 'de' THEN 'unlisted' ELSE 'changed' END AS finding FROM documents WHERE lang IN ('fr', 'de', 'es')",
)


def _reviews(s, d):
    both = P.table(s, d, "documents").join(P.table(s, d, "labels"), "doc_id")
    return both.select(F.col("doc_id").alias("incident_id"), F.when(F.col("quality") == 1, F.col("source")).alias("true_cause"), F.when(F.col("lang") != "en", F.col("lang")).alias("fault_class"), F.when(F.col("toxic") == 0, F.col("n_chars")).alias("onset"), F.col("doc_id").alias("received_at"))


add(
    "v14_promoted", lambda s, d: governance.promoted(_reviews(s, d), P.table(s, d, "conversations").select(F.col("conv_id").alias("incident_id")).distinct()).select("incident_id", F.array_join("remaining", ",").alias("remaining")),
    "SELECT doc_id AS incident_id, concat_ws(',', CASE WHEN quality IS DISTINCT FROM 1 THEN 'cause' END, CASE WHEN NOT coalesce(lang <> 'en', false) THEN 'fault class' END, CASE WHEN toxic IS DISTINCT FROM 0 OR n_chars IS NULL THEN 'onset' END) AS remaining FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT conv_id FROM conversations)",
)

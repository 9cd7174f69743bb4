"""Evaluation over labels, orders, lineitem and literal outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import Fixture, query, table

#: A paired outcome: quality and the reverse of toxic as the hits of two arms, strata by language and source.
OUT = """o AS (SELECT l.doc_id AS query_id, lang, source, CASE WHEN d.doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario, quality AS a, 1 - toxic AS b, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS c FROM labels l JOIN documents d USING (doc_id)),
arms AS (SELECT query_id, lang, scenario, 'a' AS arm, a AS hit FROM o UNION ALL SELECT query_id, lang, scenario, 'b', b FROM o UNION ALL SELECT query_id, lang, scenario, 'c', c FROM o)"""


def paired(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.length("text") > 1500).cast("int").alias("c"))
    scenario = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("query_id"), "lang", "source", scenario.alias("scenario"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"), "c")


def arms(spark, d):
    return paired(spark, d).select("query_id", "lang", "scenario", F.expr("stack(3, 'a', a, 'b', b, 'c', c) AS (arm, hit)"))


@query(f"WITH {OUT} SELECT arm, avg(hit) AS hit_rate, count(*) AS n FROM arms GROUP BY 1")
def a_10_arm_means(spark, d):
    return arms(spark, d).groupBy("arm").agg(F.avg("hit").alias("hit_rate"), F.count("*").alias("n"))


@query(f"WITH {OUT} SELECT arm, lang, scenario, count(*) AS n, avg(hit) AS hit FROM arms GROUP BY GROUPING SETS ((arm, lang, scenario), (arm, lang), (arm, scenario))")
def a_11_stratified(spark, d):
    return E.stratified(arms(spark, d), "arm", ["lang", "scenario"], ["hit"])


@query(f"WITH {OUT}, c AS (SELECT arm, lang, scenario, avg(hit) AS m FROM arms GROUP BY 1, 2, 3) SELECT arm, avg(m) AS macro, count(m) AS cells FROM c GROUP BY 1")
def a_12_macro_mean(spark, d):
    return E.macro_mean(arms(spark, d), "arm", ["lang", "scenario"], "hit")


@query(f"WITH {OUT}, c AS (SELECT arm, lang, scenario, avg(hit) AS m FROM arms GROUP BY 1, 2, 3) SELECT arm, avg(m) AS macro, count(m) AS cells FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def a_13_best_arm(spark, d):
    return E.best_arm(a_12_macro_mean(spark, d), "arm", "macro")


PRICES = Fixture("prices", "model string, input_price double, output_price double", [("1-URGENT", 0.15, 0.60), ("2-HIGH", 2.5, 10.0), ("3-MEDIUM", 0.02, 0.0)])
CALLS = "calls AS (SELECT o_orderstatus AS stack, o_orderpriority AS phase, o_orderpriority AS model, o_custkey AS input_tokens, o_orderkey % 1000 AS output_tokens FROM orders)"


def calls(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("stack"), F.col("o_orderpriority").alias("phase"), F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("input_tokens"), (F.col("o_orderkey") % 1000).alias("output_tokens"))


@query(
    f"WITH {PRICES.cte()}, {CALLS} SELECT stack, phase, count(*) AS calls, sum(input_tokens + output_tokens) AS tokens, sum((input_tokens * input_price + output_tokens * output_price) / 1e6) AS usd, grouping(stack, phase) AS slice FROM calls LEFT JOIN prices USING (model) GROUP BY CUBE (stack, phase)"
)
def a_14_ledger_cube(spark, d):
    return E.ledger(calls(spark, d), PRICES.df(spark, d))


@query(f"WITH {PRICES.cte()}, {CALLS} SELECT model, count(*) AS calls, sum((input_tokens * input_price + output_tokens * output_price) / 1e6) AS usd FROM calls LEFT JOIN prices USING (model) GROUP BY 1")
def j_20_priced_calls(spark, d):
    rows = calls(spark, d).join(F.broadcast(PRICES.df(spark, d)), "model", "left")
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6).alias("usd"))


@query(f"WITH {OUT} SELECT arm, count(*) AS answers, count(*) FILTER (hit = 1) AS correct, sum(CASE WHEN lang = 'en' AND hit = 1 THEN 1 ELSE 0 END) AS correct_en FROM arms GROUP BY 1")
def a_15_pilot_summary(spark, d):
    return arms(spark, d).groupBy("arm").agg(F.count("*").alias("answers"), F.count_if(F.col("hit") == 1).alias("correct"), F.sum(((F.col("lang") == "en") & (F.col("hit") == 1)).cast("int")).alias("correct_en"))


#: Each order is a query, its lines are the ranked pool, returned lines the hits.
@query(
    """WITH f AS (SELECT o_orderpriority AS type, o_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), k(cutoff) AS (VALUES (1), (3), (5), (10))
    SELECT type, cutoff, count(*) AS queries, avg(CASE WHEN coalesce(first <= cutoff, false) THEN 1 ELSE 0 END) AS hit_rate, avg(CASE WHEN coalesce(first <= cutoff, false) THEN 1.0 / first ELSE 0 END) AS mrr FROM f CROSS JOIN k GROUP BY 1, 2"""
)
def a_16_cutoff_sweep(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("hit"))
    types = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("type"))
    return E.cutoff_sweep(lines.join(types, "query_id"), ["type"])


@query("SELECT l_orderkey AS query_id, coalesce(1.0 / min(l_linenumber) FILTER (l_returnflag = 'R' AND l_linenumber <= 3), 0) AS rr FROM lineitem GROUP BY 1")
def w_02_reciprocal_rank(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.coalesce(1 / F.min(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 3), F.col("l_linenumber"))), F.lit(0.0)).alias("rr"))


MC = "least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))))"


@query(f"WITH {OUT}, n AS (SELECT lang, count(*) FILTER (a = 1 AND b = 0) AS b, count(*) FILTER (a = 0 AND b = 1) AS c FROM o GROUP BY 1) SELECT lang, b, c, CASE WHEN b + c = 0 THEN 1 ELSE round({MC}, 9) END AS p FROM n")
def z_01_mcnemar(spark, d):
    return E.discordant(paired(spark, d), ["lang"], "a", "b").withColumn("p", F.round("p", 9))


@query(f"WITH {OUT} SELECT count(*) FILTER (a = 1 AND b = 0) AS b, count(*) FILTER (a = 0 AND b = 1) AS c FROM o")
def a_17_discordant(spark, d):
    return E.discordant(paired(spark, d), [], "a", "b").select("b", "c")


@query(f"WITH {OUT}, s AS (SELECT lang, sum(a) AS k, count(*) AS n FROM o GROUP BY 1) SELECT lang, greatest(0, ((k / n::DOUBLE) + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) AS low, least(1, ((k / n::DOUBLE) + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) AS high FROM s")
def z_02_wilson(spark, d):
    rows = paired(spark, d).groupBy("lang").agg(F.sum("a").alias("k"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", low.alias("low"), high.alias("high"))


TESTS = Fixture("tests", "name string, p double", [("x", 0.0385), ("y", 0.0034), ("z", 0.7111), ("w", 0.0385), ("v", 0.5)])
TESTS.over("part", {
    "name": "'t' || p_partkey",
    "p": "CAST(p_partkey * 7919 % 1000 AS DOUBLE) / 1000",
})
HOLM = "SELECT name, p, least(1.0, max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)) AS holm FROM (SELECT name, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) AS s FROM tests)"


@query(f"WITH {TESTS.cte()}, h AS ({HOLM}) SELECT name, p, max(holm) OVER (PARTITION BY p) AS holm FROM h")
def z_03_holm(spark, d):
    rows = E.holm(TESTS.df(spark, d), "p")
    return rows.withColumn("holm", F.max("holm").over(Window.partitionBy("p")))


@query(f"WITH {TESTS.cte()}, h AS ({HOLM}) SELECT max(holm) AS most, min(holm) AS least, count(*) FILTER (holm < 0.05) AS significant FROM h")
def w_07_holm_running_max(spark, d):
    return E.holm(TESTS.df(spark, d), "p").agg(F.max("holm").alias("most"), F.min("holm").alias("least"), F.count_if(F.col("holm") < 0.05).alias("significant"))


CHI = Fixture("chi", "x double, df int", [(7.9512, 2), (0.0, 2), (3.0, 2), (40.0, 2), (1e-3, 2)])
CHI.over("part", {
    "x": "CAST(p_partkey % 500 AS DOUBLE) / 10",
    "df": "2",
})


@query(f"WITH {CHI.cte()} SELECT x, exp(-x / 2) AS p FROM chi")
def z_04_chi2_survival(spark, d):
    return CHI.df(spark, d).select("x", E.chi2_sf("x", "df").alias("p"))


@query(f"WITH {OUT}, s AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(a + b + c) AS t, sum((a + b + c) * (a + b + c)) AS t2 FROM o) SELECT 2.0 * (3 * (a * a + b * b + c * c) - t * t) / (3 * t - t2) AS q, 2 AS df, exp(-(2.0 * (3 * (a * a + b * b + c * c) - t * t) / (3 * t - t2)) / 2) AS p FROM s")
def z_05_cochran_q(spark, d):
    return E.cochran_q(paired(spark, d), ["a", "b", "c"])


@query(f"WITH {OUT} SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum((a + b + c) * (a + b + c)) AS squares, sum(a + b + c) AS total FROM o")
def a_18_cochran_sums(spark, d):
    row = F.col("a") + F.col("b") + F.col("c")
    return paired(spark, d).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum(row * row).alias("squares"), F.sum(row).alias("total"))


@query()
def z_06_bootstrap(spark, d):
    return E.bootstrap(paired(spark, d), ["lang"], "a", "b")


@query("SELECT 909 AS n, CAST(0.29 AS DOUBLE) AS psi, true AS enough")
def z_07_power(spark, d):
    n, psi = E.paired_sample_size(0.05, 0.80, 0.05, 0.85)
    return spark.createDataFrame([(n, round(psi, 9), E.achieved_power(n, 0.05, 0.05, psi) >= 0.8)], "n int, psi double, enough boolean")


@query(f"WITH {OUT}, n AS (SELECT scenario, count(*) AS n, avg(a) AS ra, avg(b) AS rb, count(*) FILTER (a = 1 AND b = 0) AS b, count(*) FILTER (a = 0 AND b = 1) AS c FROM o GROUP BY 1) SELECT scenario, n, ra, rb, b, c, CASE WHEN b + c = 0 THEN 1 ELSE round({MC}, 9) END AS p FROM n")
def z_08_stats_bundle(spark, d):
    rows = paired(spark, d)
    means = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.avg("a").alias("ra"), F.avg("b").alias("rb"))
    return means.join(E.discordant(rows, ["scenario"], "a", "b").withColumn("p", F.round("p", 9)), "scenario")


@query(f"WITH {OUT}, m AS (SELECT lang, avg(a) AS a, avg(b) AS b FROM o GROUP BY 1) SELECT bool_or(b - a > 0.05) AS killed, bool_and(a >= b) AS survives, count(*) FILTER (a < b) AS worse FROM m")
def z_09_verdict_clauses(spark, d):
    m = paired(spark, d).groupBy("lang").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return m.agg(F.bool_or(F.col("b") - F.col("a") > 0.05).alias("killed"), F.every(F.col("a") >= F.col("b")).alias("survives"), F.count_if(F.col("a") < F.col("b")).alias("worse"))


ANSWERS = Fixture(
    "ans",
    "id int, answer string, cited array<string>, retrieved array<string>, gold array<string>, group_ids array<string>",
    [
        (1, "ok [Source: a]", ["a"], ["a", "b"], ["a"], ["a", "c"]), (2, "ok", [], ["a"], ["a"], ["a", "c"]), (3, "bad", ["c", "a"], ["a"], ["a"], ["a", "c"]),
        (4, "I cannot confirm from the knowledge base.", [], [], [], []), (5, "x", ["c"], ["c"], ["a"], ["a", "c"]),
    ],
)
ANSWERS.over("documents", {
    "id": "doc_id",
    "answer": "CASE doc_id % 3 WHEN 0 THEN 'I cannot confirm from the knowledge base.' ELSE text END",
    "cited": "CASE doc_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('s' || (doc_id % 5)) ELSE array('s' || (doc_id % 5), 't' || (doc_id % 7)) END",
    "retrieved": "CASE doc_id % 11 WHEN 0 THEN array() ELSE array('s' || (doc_id % 5), 't' || (doc_id % 3)) END",
    "gold": "CASE WHEN doc_id % 6 = 0 THEN array() ELSE array('s' || (doc_id % 5)) END",
    "group_ids": "CASE doc_id % 5 WHEN 4 THEN array() ELSE array('s' || (doc_id % 5), 't' || (doc_id % 2)) END",
})


@query(
    f"""WITH {ANSWERS.cte()} SELECT id, len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(retrieved, x))) = 0 AS grounded, trim(answer) = 'I cannot confirm from the knowledge base.' AND len(gold) = 0 AS refused_well,
    len(list_filter(cited, lambda x: list_contains(group_ids, x) AND NOT list_contains(gold, x))) > 0 AS leak FROM ans"""
)
def z_10_content_axes(spark, d):
    from ..functions.text import is_refusal

    grounded = (F.size("cited") > 0) & (F.size(F.array_except("cited", "retrieved")) == 0)
    leak = F.arrays_overlap("cited", F.array_except("group_ids", "gold"))
    return ANSWERS.df(spark, d).select("id", grounded.alias("grounded"), (is_refusal("answer") & (F.size("gold") == 0)).alias("refused_well"), F.coalesce(leak, F.lit(False)).alias("leak"))


@query(f"WITH {ANSWERS.cte()} SELECT id, len(list_filter(cited, lambda x: NOT list_contains(retrieved, x))) = 0 AS subset, array_to_string(list_sort(list_filter(group_ids, lambda x: NOT list_contains(gold, x))), ',') AS leak_ids, list_sort(cited) = list_sort(retrieved) AS equal FROM ans")
def u_06_subset_and_leaks(spark, d):
    return ANSWERS.df(spark, d).select("id", (F.size(F.array_except("cited", "retrieved")) == 0).alias("subset"), F.array_join(F.array_sort(F.array_except("group_ids", "gold")), ",").alias("leak_ids"), (F.array_sort("cited") == F.array_sort("retrieved")).alias("equal"))


@query(f"WITH {ANSWERS.cte()} SELECT id, array_to_string(list_sort(list_filter(cited, lambda x: NOT list_contains(retrieved, x))), ',') AS added, array_to_string(list_sort(list_filter(retrieved, lambda x: NOT list_contains(cited, x))), ',') AS dropped FROM ans")
def u_03_citation_delta(spark, d):
    return ANSWERS.df(spark, d).select("id", F.array_join(F.array_sort(F.array_except("cited", "retrieved")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("retrieved", "cited")), ",").alias("dropped"))


THRESHOLDS = [x / 10 for x in range(0, 31, 5)]
SCORED = "s AS (SELECT doc_id, quality, length(text) / 1000.0 AS score FROM labels JOIN documents USING (doc_id)), sw AS (SELECT threshold, avg(CASE WHEN score < threshold THEN 1.0 ELSE 0 END) FILTER (quality = 0) AS refusal, avg(CASE WHEN score < threshold THEN 1.0 ELSE 0 END) FILTER (quality = 1) AS over_refusal FROM s CROSS JOIN (SELECT unnest(range(0, 31, 5)) / 10.0 AS threshold) GROUP BY 1)"


def swept(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", (F.length("text") / 1000).alias("score"))
    return E.sweep(rows.where("quality = 1"), rows.where("quality = 0"), THRESHOLDS)


@query(f"WITH {SCORED} SELECT threshold, refusal, over_refusal, refusal - over_refusal AS j FROM sw")
def a_19_sweep(spark, d):
    return swept(spark, d)


@query(f"WITH {SCORED}, b AS (SELECT threshold, refusal, over_refusal, refusal - over_refusal AS j, rank() OVER (ORDER BY round(refusal - over_refusal, 12) DESC) AS r FROM sw), t AS (SELECT *, row_number() OVER (ORDER BY threshold) AS i, count(*) OVER () AS n, max(threshold = 0.5) OVER () AS has FROM b WHERE r = 1) SELECT threshold, refusal, over_refusal, j FROM t WHERE (has AND threshold = 0.5) OR (NOT has AND i = (n + 1) // 2)")
def a_20_youden(spark, d):
    return E.youden(swept(spark, d), 0.5)


@query("SELECT lang AS category, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0 END) AS refusal_rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def a_22_refusal_rate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.rollup(F.col("lang").alias("category")).agg(F.avg((F.col("quality") == 0).cast("int")).alias("refusal_rate"), F.count("*").alias("n"))


@query(f"WITH {PRICES.cte()}, {CALLS}, u AS (SELECT stack, sum((input_tokens * input_price + output_tokens * output_price) / 1e6) AS usd, count(*) FILTER (output_tokens > 900) AS good FROM calls LEFT JOIN prices USING (model) GROUP BY 1), v(volume) AS (VALUES (100), (1000), (10000)) SELECT stack, volume, usd / nullif(good, 0) AS per_correct, usd / volume AS amortised FROM u CROSS JOIN v")
def a_25_cost_curve(spark, d):
    rows = calls(spark, d).join(F.broadcast(PRICES.df(spark, d)), "model", "left")
    usd = rows.groupBy("stack").agg(F.sum((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6).alias("usd"), F.count_if(F.col("output_tokens") > 900).alias("good"))
    volume = F.explode(F.array(F.lit(100), F.lit(1000), F.lit(10000))).alias("volume")
    return usd.select("stack", "usd", "good", volume).select("stack", "volume", (F.col("usd") / F.nullif("good", F.lit(0))).alias("per_correct"), (F.col("usd") / F.col("volume")).alias("amortised"))


@query(f"WITH {CALLS} SELECT avg(input_tokens / 1e4) * 3636 AS projected, avg(input_tokens / 1e4) * 3636 > 10.0 AS over_cap FROM calls")
def a_26_spend_projection(spark, d):
    projected = F.avg(F.col("input_tokens") / 1e4) * 3636
    return calls(spark, d).agg(projected.alias("projected"), (projected > 10.0).alias("over_cap"))


GROUNDED = Fixture("g", "slug string, ord int, passed boolean, reason string, claims array<string>", [("a", 1, True, None, []), ("a", 2, False, "claim_unsupported", ["x", "y"]), ("a", 3, False, "retrieval_empty", ["z"]), ("b", 1, True, None, [])])
GROUNDED.over("documents", {
    "slug": "'g' || (doc_id div 4)",
    "ord": "doc_id % 4",
    "passed": "doc_id % 5 <> 0",
    "reason": "CASE doc_id % 10 WHEN 0 THEN 'claim_unsupported' WHEN 5 THEN 'retrieval_empty' END",
    "claims": "CASE doc_id % 10 WHEN 0 THEN array(source, lang) WHEN 5 THEN array(source) ELSE array() END",
})


@query(f"WITH {GROUNDED.cte()} SELECT slug, bool_and(passed) AS passed, arg_min(reason, ord) FILTER (NOT passed) AS reason, array_to_string(flatten(list(claims ORDER BY ord)), ',') AS claims FROM g GROUP BY 1")
def a_24_combined_grounding(spark, d):
    return GROUNDED.df(spark, d).groupBy("slug").agg(F.every("passed").alias("passed"), F.min_by(F.when(~F.col("passed"), F.col("reason")), F.when(~F.col("passed"), F.col("ord"))).alias("reason"), F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "claims"))), lambda x: x["claims"])), ",").alias("claims"))


@query("SELECT count(*) AS sections, count(DISTINCT source) AS files, (SELECT count(*) FROM pages) AS pages FROM documents")
def a_29_counts(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("sections"), F.countDistinct("source").alias("files")).crossJoin(table(spark, d, "pages").agg(F.count("*").alias("pages")))


@query(f"WITH {OUT} SELECT arm, count(*) FILTER (hit = 1 AND lang <> 'es') AS grounded_correct FROM arms GROUP BY 1")
def a_30_grounded_correct(spark, d):
    return arms(spark, d).groupBy("arm").agg(F.count_if((F.col("hit") == 1) & (F.col("lang") != "es")).alias("grounded_correct"))


@query("SELECT zone, count(*) AS n, avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0 END) AS agreement FROM (SELECT quality, toxic, unnest(CASE WHEN doc_id % 3 = 0 THEN ['edge', 'control'] WHEN doc_id % 3 = 1 THEN ['edge'] ELSE ['control'] END) AS zone FROM labels) GROUP BY 1")
def a_31_zone_agreement(spark, d):
    zones = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("edge"), F.lit("control"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("edge"))).otherwise(F.array(F.lit("control")))
    rows = table(spark, d, "labels").select((F.col("quality") == 1 - F.col("toxic")).cast("int").alias("agree"), F.explode(zones).alias("zone"))
    return rows.groupBy("zone").agg(F.count("*").alias("n"), F.avg("agree").alias("agreement"))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents) SELECT doc_id, lang, place FROM r WHERE place <= 100")
def o_10_sha_sample(spark, d):
    key = F.sha2(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string")), 256)
    best = table(spark, d, "documents").select("doc_id", "lang", key.alias("k")).orderBy("k", "doc_id").limit(100)
    return best.select("doc_id", "lang", F.row_number().over(Window.orderBy("k", "doc_id")).alias("place"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) SELECT doc_id, source, place FROM r WHERE place <= 3")
def w_13_stratum_head(spark, d):
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", place.alias("place")).where("place <= 3")


@query("WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation) SELECT s.s_suppkey, r.n_nationkey FROM supplier s JOIN r ON s.s_suppkey % r.n = r.i")
def w_12_round_robin(spark, d):
    ordered = table(spark, d, "nation").select("n_nationkey", (F.row_number().over(Window.orderBy("n_name")) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    return table(spark, d, "supplier").join(F.broadcast(ordered), F.expr("s_suppkey % n = i")).select("s_suppkey", "n_nationkey")


GOLD = Fixture("cover", "wiki string, doc string", [("w1", "d1"), ("w1", "d2"), ("w2", "d2")])
GOLD.over("documents", {
    "wiki": "'w' || (doc_id div 3)",
    "doc": "'d' || (doc_id % 300)",
})


@query(f"WITH {GOLD.cte()}, e AS (SELECT wiki AS id, doc AS other FROM cover UNION ALL SELECT doc, wiki FROM cover UNION ALL SELECT wiki, wiki FROM cover UNION ALL SELECT doc, doc FROM cover) SELECT id, array_to_string(list_sort(list_distinct(list(other))), ',') AS gold FROM e GROUP BY 1")
def j_16_gold_map(spark, d):
    g = GOLD.df(spark, d)
    pair = lambda a, b: g.select(F.col(a).alias("id"), F.col(b).alias("other"))
    rows = pair("wiki", "doc").union(pair("doc", "wiki")).union(pair("wiki", "wiki")).union(pair("doc", "doc"))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("gold"))


@query("SELECT l_orderkey, l_linenumber, list_contains(['R', 'A'], l_returnflag) AND list_has_any([l_linestatus, l_returnflag], ['O', 'R']) AS hit FROM lineitem")
def j_17_hit_test(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.hit(F.col("l_returnflag"), F.array(F.lit("R"), F.lit("A")), F.array("l_linestatus", "l_returnflag"), F.array(F.lit("O"), F.lit("R"))).alias("hit"))


@query(f"WITH {OUT} SELECT x.query_id, x.hit AS base, y.hit AS other FROM arms x JOIN arms y ON x.query_id = y.query_id AND x.arm = 'a' AND y.arm = 'c'")
def j_18_paired_arms(spark, d):
    return arms(spark, d).groupBy("query_id").pivot("arm", ["a", "c"]).agg(F.max("hit")).select("query_id", F.col("a").alias("base"), F.col("c").alias("other"))


@query("WITH p AS (SELECT item_id, text FROM benchmark), b AS (SELECT doc_id, text AS body FROM documents) SELECT item_id, coalesce(body, p.text) AS text FROM p LEFT JOIN b ON doc_id = item_id * 30")
def j_21_rekey(spark, d):
    body = table(spark, d, "documents").select(F.col("doc_id").alias("gold"), F.col("text").alias("body"))
    return table(spark, d, "benchmark").withColumn("gold", F.col("item_id") * 30).join(body, "gold", "left").select("item_id", F.coalesce("body", "text").alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u_08_resume(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")

"""Run metrics, percentiles, windows and alerts, run comparison, retrieval, graphs and sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.operators import retrieval as R
from tamarack.plans.registry import query
from tamarack.session import table as t


@query("metric_ratios", """SELECT metric, num, den, coalesce(round(num / nullif(den, 0), 6), 0.0::DOUBLE) AS ratio, coalesce(round(100.0::DOUBLE * num / nullif(den, 0), 4), 0.0::DOUBLE) AS percentage FROM (
SELECT 'toxic_rate' AS metric, CAST(sum(toxic) AS BIGINT) AS num, count(*) AS den FROM labels UNION ALL SELECT 'quality_rate', CAST(sum(quality) AS BIGINT), count(*) FILTER (toxic = 0) FROM labels UNION ALL SELECT 'empty', 0, count(*) FILTER (toxic = 9) FROM labels)""")
def metric_ratios(spark, d):
    """Auditable ratios: numerator, denominator, ratio, percentage; nothing over nothing is zero."""
    lab = t(spark, d, "labels")
    a = lab.agg(F.sum("toxic").alias("a"), F.count("*").alias("b"), F.sum("quality").alias("c"), F.count_if(F.col("toxic") == 0).alias("e"), F.count_if(F.col("toxic") == 9).alias("f"))
    rows = a.select(F.explode(F.array(F.struct(F.lit("toxic_rate").alias("metric"), F.col("a").alias("num"), F.col("b").alias("den")), F.struct(F.lit("quality_rate").alias("metric"), F.col("c").alias("num"), F.col("e").alias("den")), F.struct(F.lit("empty").alias("metric"), F.lit(0).cast("long").alias("num"), F.col("f").alias("den")))).alias("m")).select("m.*")
    ratio = F.try_divide("num", "den")
    return rows.select("metric", "num", "den", F.coalesce(F.round(ratio, 6), F.lit(0.0)).alias("ratio"), F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("num"), F.col("den")), 4), F.lit(0.0)).alias("percentage"))


@query("gate_rollup", """SELECT coalesce(lang, 'all') AS scope, count(*) AS cases, count(*) FILTER (quality = 1) AS g1, count(*) FILTER (toxic = 0) AS g2, count(*) FILTER (quality = 1 AND toxic = 0 AND n_chars > 100) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def gate_rollup(spark, d):
    j = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id")
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("n_chars") > 100)
    return j.rollup("lang").agg(F.count("*").alias("cases"), F.count_if(F.col("quality") == 1).alias("g1"), F.count_if(F.col("toxic") == 0).alias("g2"), F.count_if(ok).alias("passed")).withColumn("scope", F.coalesce("lang", F.lit("all"))).drop("lang")


CATS_SQL = "c AS (SELECT doc_id, lang, list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN text LIKE '%@%' THEN 'contact' END], lambda x: x IS NOT NULL) AS cats FROM documents JOIN labels USING (doc_id))"


def _categories(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    cats = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "quality"), F.when(F.col("n_chars") < 300, "short"), F.when(F.contains("text", F.lit("@")), "contact")))
    return j.select("doc_id", "lang", cats.alias("cats"))


@query("failure_taxonomy", f"WITH {CATS_SQL} SELECT category, lang, count(*) AS n FROM (SELECT lang, unnest(cats) AS category FROM c) GROUP BY ALL")
def failure_taxonomy(spark, d):
    """Overlapping failure categories."""
    return _categories(spark, d).select("lang", F.explode("cats").alias("category")).groupBy("category", "lang").agg(F.count("*").alias("n"))


@query("failure_primary", f"WITH {CATS_SQL} SELECT coalesce(cats[1], 'none') AS primary_category, count(*) AS n FROM c GROUP BY ALL")
def failure_primary(spark, d):
    """Exclusive primary category by precedence."""
    return _categories(spark, d).groupBy(F.coalesce(F.get("cats", F.lit(0)), F.lit("none")).alias("primary_category")).agg(F.count("*").alias("n"))


@query("run_comparison", """WITH a AS (SELECT lang, round(avg(quality), 6) AS v FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY lang), b AS (SELECT lang, round(avg(quality), 6) AS v FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1 GROUP BY lang)
SELECT lang, a.v AS baseline, b.v AS run, round(b.v - a.v, 6) AS delta, CASE WHEN abs(b.v - a.v) <= 0.01 THEN 'tied' WHEN b.v > a.v THEN 'improved' ELSE 'regressed' END AS verdict FROM a JOIN b USING (lang)""")
def run_comparison(spark, d):
    """Two runs (even and odd ids) by scope: delta and verdict within a tolerance."""
    j = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    half = lambda r, name: F.round(F.avg(F.when(F.col("doc_id") % 2 == r, F.col("quality"))), 6).alias(name)
    g = j.groupBy("lang").agg(half(0, "baseline"), half(1, "run")).where("baseline is not null and run is not null")
    delta = F.col("run") - F.col("baseline")
    return g.select("lang", "baseline", "run", F.round(delta, 6).alias("delta"), F.when(F.abs(delta) <= 0.01, "tied").when(delta > 0, "improved").otherwise("regressed").alias("verdict"))


@query("percentiles_nearest", """SELECT lang, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n_chars, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(n_chars, 0.99) AS BIGINT) AS p99, max(n_chars) AS most FROM documents GROUP BY lang""")
def percentiles_nearest(spark, d):
    p = lambda q, name: F.expr(f"cast(percentile_disc({q}) within group (order by n_chars) as bigint)").alias(name)
    return t(spark, d, "documents").groupBy("lang").agg(p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.max("n_chars").alias("most"))


@query("quantiles_linear", """SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.95), 4) AS q95 FROM orders GROUP BY o_orderstatus""")
def quantiles_linear(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("q50"), F.round(F.percentile("o_totalprice", F.lit(0.95)), 4).alias("q95"))


@query("group_variance", """SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, round(stddev_pop(o_totalprice), 3) AS sd_pop, round(stddev_samp(o_totalprice), 3) AS sd_samp, len(list_distinct(list(o_orderstatus))) AS states FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def group_variance(spark, d):
    v = F.col("o_totalprice")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.stddev_pop(v), 3).alias("sd_pop"), F.round(F.stddev_samp(v), 3).alias("sd_samp"), F.size(F.collect_set("o_orderstatus")).cast("long").alias("states")).where("n > 1")


@query("two_level_mean", """WITH p AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT o_orderpriority, round(avg(m), 2) AS mean_of_means, count(*) AS n_groups FROM p GROUP BY o_orderpriority""")
def two_level_mean(spark, d):
    p = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return p.groupBy("o_orderpriority").agg(F.round(F.avg("m"), 2).alias("mean_of_means"), F.count("*").alias("n_groups"))


@query("group_advantage", """WITH g AS (SELECT event_id, (event_id - event_id % 8) // 8 AS grp, value FROM events), s AS (SELECT *, avg(value) OVER (PARTITION BY grp) AS m, stddev_samp(value) OVER (PARTITION BY grp) AS sd FROM g) SELECT event_id, round((value - m) / (coalesce(sd, 0) + 0.0001::DOUBLE), 3) AS advantage, coalesce(sd, 0) < 0.0001 AS flat FROM s""")
def group_advantage(spark, d):
    """Value relative to its group of eight: distance from the mean in sample deviations."""
    w = W.partitionBy("grp")
    g = t(spark, d, "events").select("event_id", ((F.col("event_id") - F.col("event_id") % 8) / 8).cast("long").alias("grp"), "value")
    s = g.withColumn("m", F.avg("value").over(w)).withColumn("sd", F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)))
    return s.select("event_id", F.round((F.col("value") - F.col("m")) / (F.col("sd") + 0.0001), 3).alias("advantage"), (F.col("sd") < 0.0001).alias("flat"))


WINDOWS_SQL = "w AS (SELECT event_id // 50 AS win, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.95) AS p95, max(value) AS most, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS refusal, avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass FROM events GROUP BY win)"


def windows(events):
    """Count-based tumbling windows of 50 steps."""
    bad = F.col("event_type") == "error"
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return events.groupBy(F.floor(F.col("event_id") / 50).alias("win")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"), F.max("value").alias("most"), share(bad).alias("refusal"), share(~bad).alias("pass"))


@query("health_windows", f"WITH {WINDOWS_SQL} SELECT CAST(win AS BIGINT) AS win, n, round(mean, 4) AS mean, round(p95, 4) AS p95, most, round(refusal, 4) AS refusal, round(pass, 4) AS pass FROM w")
def health_windows(spark, d):
    w = windows(t(spark, d, "events"))
    return w.select("win", "n", *(F.round(c, 4).alias(c) for c in ("mean", "p95")), "most", *(F.round(c, 4).alias(c) for c in ("refusal", "pass")))


ALERT_SQL = f"WITH {WINDOWS_SQL}, l AS (SELECT win, pass, lag(pass) OVER (ORDER BY win) AS pass0, mean, lag(mean) OVER (ORDER BY win) AS mean0, first_value(mean) OVER (ORDER BY win) AS base FROM w)"


@query("window_alerts", ALERT_SQL + """, e AS (SELECT win, unnest([CASE WHEN pass < 0.7 THEN 'pass_low' END, CASE WHEN pass < 0.78 AND pass0 < 0.78 THEN 'pass_twice' END, CASE WHEN mean >= greatest(50, 1.15::DOUBLE * base) AND mean0 >= greatest(50, 1.15::DOUBLE * base) THEN 'mean_twice' END]) AS alert FROM l) SELECT CAST(win AS BIGINT) AS win, alert FROM e WHERE alert IS NOT NULL""")
def window_alerts(spark, d):
    """Alerts of one window, and of two windows running, against the first window's mean."""
    by = W.orderBy("win")  # one row for each window of steps
    w = windows(t(spark, d, "events")).select("win", "pass", "mean")
    l = w.withColumn("pass0", F.lag("pass").over(by)).withColumn("mean0", F.lag("mean").over(by)).withColumn("limit", F.greatest(F.lit(50.0), 1.15 * F.first("mean").over(by)))  # noqa: E741
    alerts = F.array(F.when(F.col("pass") < 0.7, "pass_low"), F.when((F.col("pass") < 0.78) & (F.col("pass0") < 0.78), "pass_twice"), F.when((F.col("mean") >= F.col("limit")) & (F.col("mean0") >= F.col("limit")), "mean_twice"))
    return l.select("win", F.explode(F.array_compact(alerts)).alias("alert"))


@query("running_gate_stop", """WITH r AS (SELECT event_type, event_id, avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY event_type ORDER BY event_id) AS rate, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_type, min(event_id) FILTER (n >= 50 AND rate >= 0.35) AS stop_at, count(*) AS n FROM r GROUP BY event_type""")
def running_gate_stop(spark, d):
    """First event at which a running rate crosses the gate, after a warm-up of 50."""
    by = W.partitionBy("event_type").orderBy("event_id")
    r = t(spark, d, "events").select("event_type", "event_id", F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)).over(by).alias("rate"), F.row_number().over(by).alias("n"))
    return r.groupBy("event_type").agg(F.min(F.when((F.col("n") >= 50) & (F.col("rate") >= 0.35), F.col("event_id"))).alias("stop_at"), F.count("*").alias("n"))


@query("truncation_pivot", """SELECT lang, count(*) FILTER (n_chars <= 1000) AS complete, count(*) FILTER (n_chars > 1000 AND n_chars <= 4000) AS partial, count(*) FILTER (n_chars > 4000) AS cut FROM documents GROUP BY lang""")
def truncation_pivot(spark, d):
    status = F.when(F.col("n_chars") <= 1000, "complete").when(F.col("n_chars") <= 4000, "partial").otherwise("cut")
    return t(spark, d, "documents").withColumn("s", status).groupBy("lang").pivot("s", ["complete", "partial", "cut"]).agg(F.count(F.lit(1))).na.fill(0)


@query("size_histogram", """SELECT len(string_split(text, chr(10))) AS n_lines, count(*) AS n FROM documents GROUP BY n_lines""")
def size_histogram(spark, d):
    return t(spark, d, "documents").groupBy(F.size(F.split("text", "\n")).cast("long").alias("n_lines")).agg(F.count("*").alias("n"))


@query("uniqueness_ratio", """SELECT source, round(count(DISTINCT text) / count(*), 6) AS ratio, count(*) FILTER (text IS NULL) AS nulls FROM documents GROUP BY source""")
def uniqueness_ratio(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.round(F.countDistinct(F.sha2("text", 256)) / F.count("*"), 6).alias("ratio"), F.count_if(F.col("text").isNull()).alias("nulls"))


@query("generation_summary", """SELECT coalesce(event_type, 'all') AS intent, count(*) AS attempted, count(*) FILTER (value < 150) AS accepted, round(100.0::DOUBLE * count(*) FILTER (value >= 300) / count(*), 2) AS truncated_pct, CASE WHEN 100.0::DOUBLE * count(*) FILTER (value >= 300) / count(*) >= 5 THEN 'stop' ELSE 'go' END AS gate FROM events GROUP BY ROLLUP (event_type)""")
def generation_summary(spark, d):
    cut = 100.0 * F.count_if(F.col("value") >= 300) / F.count("*")
    g = t(spark, d, "events").rollup("event_type").agg(F.count("*").alias("attempted"), F.count_if(F.col("value") < 150).alias("accepted"), F.round(cut, 2).alias("truncated_pct"), F.when(cut >= 5, "stop").otherwise("go").alias("gate"))
    return g.withColumn("intent", F.coalesce("event_type", F.lit("all"))).drop("event_type")


# ---------------------------------------------------------------- retrieval and graphs

TERMS_SQL = """w AS (SELECT {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {t}), {p}t AS (SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest(ws) AS term FROM {p}w UNION ALL SELECT {k}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM {p}w WHERE len(ws) > 1) GROUP BY ALL)"""
DOC_TERMS, QUERY_TERMS = "d" + TERMS_SQL.format(k="doc_id", t="documents", p="d"), "q" + TERMS_SQL.format(k="item_id", t="benchmark", p="q")
COSINE_SQL = f"""{DOC_TERMS}, {QUERY_TERMS}, idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM dt GROUP BY term),
aw AS (SELECT item_id, term, tf * idf AS wq FROM qt JOIN idf USING (term)), bw AS (SELECT doc_id, term, tf * idf AS wd FROM dt JOIN idf USING (term)),
qn AS (SELECT item_id, sqrt(sum(wq * wq)) AS nq FROM aw GROUP BY item_id), dn AS (SELECT doc_id, sqrt(sum(wd * wd)) AS nd FROM bw GROUP BY doc_id),
cs AS (SELECT item_id, doc_id, sum(wq * wd) / (any_value(nq) * any_value(nd)) AS cosine FROM bw JOIN aw USING (term) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY item_id, doc_id)"""


@query("tfidf_topk", f"WITH {COSINE_SQL}, r AS (SELECT item_id, doc_id, round(cosine, 4) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 4) DESC, doc_id) AS INT) AS rank FROM cs) SELECT * FROM r WHERE rank <= 5")
def tfidf_topk(spark, d):
    return R.top_documents(t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark"), "doc_id", "item_id", 5)


HIT_SQL = "len(list_filter(terms, lambda x: contains(low, x))) / len(terms)"


@query("hybrid_retrieval", f"""WITH {COSINE_SQL}, h AS (SELECT item_id, doc_id, cosine, list_filter(string_split(lower(b.text), ' '), lambda x: x <> '') AS terms, lower(d.text) AS low FROM cs JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
r AS (SELECT item_id, doc_id, round(0.68::DOUBLE * cosine + 0.32::DOUBLE * ({HIT_SQL}), 4) AS score FROM h) SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r QUALIFY rank <= 5""")
def hybrid_retrieval(spark, d):
    """Cosine and term-hit fraction, fused; only pairs that share a term can score."""
    return R.top_documents(t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark"), "doc_id", "item_id", 5, hits=True)


LINKS_SQL = """l AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1))) AS links FROM pages), t AS (SELECT lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)) AS title, max(page_id) AS page_id FROM pages GROUP BY title)"""


@query("wiki_edges", f"WITH {LINKS_SQL}, e AS (SELECT page_id, unnest(links) AS link FROM l) SELECT e.page_id AS src, t.page_id AS dst, link FROM e JOIN t ON lower(link) = t.title")
def wiki_edges(spark, d):
    """Links that name another page's title; the last page of a title wins."""
    p = t(spark, d, "pages")
    links = p.select("page_id", F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))))).alias("link"))
    titles = p.groupBy(F.lower(F.regexp_extract("html", "<title>([A-Za-z]+)", 1)).alias("title")).agg(F.max("page_id").alias("dst"))
    return links.join(titles, F.lower("link") == F.col("title")).select(F.col("page_id").alias("src"), "dst", "link")


@query("induced_subgraph", f"WITH {LINKS_SQL}, e AS (SELECT page_id, unnest(links) AS link FROM l), g AS (SELECT link, count(*) AS n FROM e GROUP BY link ORDER BY n DESC, link LIMIT 18) SELECT a.link AS a, b.link AS b, count(*) AS n FROM e a JOIN e b ON a.page_id = b.page_id AND a.link < b.link WHERE a.link IN (SELECT link FROM g) AND b.link IN (SELECT link FROM g) GROUP BY ALL ORDER BY n DESC, a, b LIMIT 40")
def induced_subgraph(spark, d):
    """The 18 commonest nodes and the 40 strongest edges among them."""
    links = t(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)))).alias("link"))
    top = links.groupBy("link").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "link").limit(18)
    seen = links.join(F.broadcast(top.select("link")), "link", "left_semi")
    pairs = seen.alias("x").join(seen.alias("y"), (F.col("x.page_id") == F.col("y.page_id")) & (F.col("x.link") < F.col("y.link")))
    return pairs.groupBy(F.col("x.link").alias("a"), F.col("y.link").alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(40)


@query("events_tumbling", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM events GROUP BY ALL""")
def events_tumbling(spark, d):
    """Daily windows (batch form of the streaming extension)."""
    from tamarack.streaming.windows import daily

    return daily(t(spark, d, "events"))

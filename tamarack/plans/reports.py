"""Reports, guards and small aggregates over catalogs, runs and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.plans.recommend import CARS_SQL, cars
from tamarack.plans.registry import query
from tamarack.session import table as t


# ---------------------------------------------------------------- reports

BANDS = [(200000, "20万内"), (350000, "20-35万"), (600000, "35-60万")]


@query("enrichment_report", """WITH c AS (SELECT p_partkey AS id, p_brand, p_retailprice * 400 AS price, round(100.0::DOUBLE * (CASE WHEN p_size % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_type <> 'PROMO' THEN 1 ELSE 0 END + CASE WHEN p_partkey % 9 <> 0 THEN 1 ELSE 0 END + 1) / 4, 1) AS score FROM part),
b AS (SELECT CASE WHEN price < 200000 THEN '20万内' WHEN price < 350000 THEN '20-35万' WHEN price < 600000 THEN '35-60万' ELSE '60万以上' END AS band, count(*) AS n FROM c GROUP BY band), w AS (SELECT * FROM c ORDER BY score, id LIMIT 10)
SELECT 'average' AS part, '' AS name, round(avg(score), 1) AS value FROM c UNION ALL SELECT 'estimated', 'size', CAST(count(*) FILTER (p_size % 7 = 0) AS DOUBLE) FROM part UNION ALL SELECT 'estimated', 'link', CAST(count(*) FILTER (p_partkey % 9 = 0) AS DOUBLE) FROM part
UNION ALL SELECT 'band', band, CAST(n AS DOUBLE) FROM b UNION ALL SELECT 'worst', CAST(id AS VARCHAR), score FROM w""")
def enrichment_report(spark, d):
    """Average quality, estimated fields, price bands and the ten worst rows."""
    flags = [F.col("p_size") % 7 != 0, F.col("p_type") != "PROMO", F.col("p_partkey") % 9 != 0, F.lit(True)]
    c = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 400).alias("price"), F.round(100.0 * sum(F.when(f, 1).otherwise(0) for f in flags) / 4, 1).alias("score"), *(F.when(f, 0).otherwise(1).alias(f"lacks{i}") for i, f in enumerate(flags)))
    band = F.lit("60万以上")
    for most, name in reversed(BANDS):
        band = F.when(F.col("price") < most, name).otherwise(band)
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    one = c.agg(F.round(F.avg("score"), 1).alias("a"), F.sum("lacks0").alias("s"), F.sum("lacks2").alias("l")).select(F.explode(F.array(row("average", "", F.col("a")), row("estimated", "size", F.col("s")), row("estimated", "link", F.col("l")))).alias("r")).select("r.*")
    bands = c.groupBy(band.alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("band").alias("part"), "name", "value")
    worst = c.orderBy("score", "id").limit(10).select(F.lit("worst").alias("part"), F.col("id").cast("string").alias("name"), F.col("score").alias("value"))
    return one.unionByName(bands).unionByName(worst)


@query("group_of_groups", """WITH g AS (SELECT o_custkey, stddev_samp(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sd, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS least, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 1)
SELECT count(*) AS groups, count(*) FILTER (sd > 0) AS nonzero, round(count(*) FILTER (sd > 0) / count(*), 6) AS nonzero_ratio, count(*) FILTER (least = 1) AS all_one, count(*) FILTER (most = 0) AS all_zero, round(avg(sd), 6) AS sd_mean, round(min(sd), 6) AS sd_min, round(max(sd), 6) AS sd_max FROM g""")
def group_of_groups(spark, d):
    """Shares of groups that vary, are all one or all zero, and the spread of their deviations."""
    reward = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.stddev_samp(reward).alias("sd"), F.min(reward).alias("least"), F.max(reward).alias("most"), F.count("*").alias("n")).where("n > 1")
    n = F.count("*")
    return g.agg(n.alias("groups"), F.count_if(F.col("sd") > 0).alias("nonzero"), F.round(F.count_if(F.col("sd") > 0) / n, 6).alias("nonzero_ratio"), F.count_if(F.col("least") == 1).alias("all_one"), F.count_if(F.col("most") == 0).alias("all_zero"), F.round(F.avg("sd"), 6).alias("sd_mean"), F.round(F.min("sd"), 6).alias("sd_min"), F.round(F.max("sd"), 6).alias("sd_max"))


@query("counter_merge", """SELECT gate, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS gate, CAST(floor(value) AS BIGINT) % 7 AS n FROM events UNION ALL SELECT 'passed', CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END FROM events) GROUP BY gate""")
def counter_merge(spark, d):
    """The sum of the records' own histograms."""
    own = F.map_from_arrays(F.array(F.col("event_type"), F.lit("passed")), F.array(F.floor("value") % 7, F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).cast("long")))
    return t(spark, d, "events").select(F.explode(own).alias("gate", "n")).groupBy("gate").agg(F.sum("n").alias("n"))


@query("tag_counts", """WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1))) AS tag FROM pages) SELECT 'tag' AS kind, tag AS name, count(*) AS n FROM l GROUP BY tag UNION ALL SELECT 'degree', CAST(k AS VARCHAR), count(*) FROM (SELECT page_id, count(*) AS k FROM l GROUP BY page_id) GROUP BY k UNION ALL SELECT 'nodes', '', count(*) FROM pages""")
def tag_counts(spark, d):
    """Nodes of a graph, their tags and how many tags nodes have."""
    p = t(spark, d, "pages")
    l = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)))).alias("tag"))  # noqa: E741
    tags = l.groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("n")).select(F.lit("tag").alias("kind"), "name", "n")
    degrees = l.groupBy("page_id").agg(F.count("*").alias("k")).groupBy(F.col("k").cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit("degree").alias("kind"), "name", "n")
    return tags.unionByName(degrees).unionByName(p.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.lit("").alias("name"), "n"))


@query("count_by", """SELECT 'segment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL""")
def count_by(spark, d):
    """Counts of several fields in one pass."""
    pairs = F.array(F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("field"), F.col("c_nationkey").cast("string").alias("value")))
    return t(spark, d, "customer").select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


@query("wall_clock", """SELECT lang, n, CAST(ceil(n / 4.0) * 3 AS BIGINT) AS micro_steps, CAST(ceil(ceil(n / 4.0) * 3 / 16.0) AS BIGINT) AS optimizer_steps, round(ceil(n / 4.0) * 3 * 6.2521::DOUBLE, 2) AS compute_sec, round(round(ceil(n / 4.0) * 3 * 6.2521::DOUBLE, 2) * 1.15::DOUBLE, 2) AS wall_sec FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def wall_clock(spark, d, epochs: int = 3, micro: int = 4, accumulate: int = 16, step: float = 6.2521, overhead: float = 0.15):
    """Training time from a measured step: rounded-up batches, updates, compute and overhead."""
    steps = F.ceil(F.col("n") / micro) * epochs
    g = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("micro_steps", steps)
    compute = F.round(F.col("micro_steps") * step, 2)
    return g.select("lang", "n", "micro_steps", F.ceil(F.col("micro_steps") / accumulate).alias("optimizer_steps"), compute.alias("compute_sec"), F.round(compute * (1 + overhead), 2).alias("wall_sec"))


@query("terminal_distribution", """WITH l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS final, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id)
SELECT CASE WHEN answers = 0 THEN 'none' WHEN answers = 1 THEN 'one' ELSE 'many' END AS kind, count(*) AS conversations, count(*) FILTER (trim(coalesce(final, '')) <> '') AS nonempty FROM l GROUP BY kind""")
def terminal_distribution(spark, d):
    """Conversations by kind, and those whose last answer is not empty."""
    said = F.col("role") == "assistant"
    l = t(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("final"), F.count_if(said).alias("answers"))  # noqa: E741
    kind = F.when(F.col("answers") == 0, "none").when(F.col("answers") == 1, "one").otherwise("many")
    return l.groupBy(kind.alias("kind")).agg(F.count("*").alias("conversations"), F.count_if(F.trim(F.coalesce("final", F.lit(""))) != "").alias("nonempty"))


# ---------------------------------------------------------------- runs and windows


@query("window_by_intent", """SELECT CAST(event_id // 50 AS BIGINT) AS win, event_type AS intent, count(*) AS steps, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS fail_rate FROM events GROUP BY ALL""")
def window_by_intent(spark, d):
    """Means of each intent inside a window of 50 steps."""
    return t(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("win"), F.col("event_type").alias("intent")).agg(F.count("*").alias("steps"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)), 4).alias("fail_rate"))


@query("best_checkpoint", """SELECT p_brand, arg_min(p_partkey, CAST(p_size AS BIGINT) * 100000000 + p_partkey) AS checkpoint, min(p_size) AS loss FROM part GROUP BY p_brand""")
def best_checkpoint(spark, d):
    """Lowest loss, then the earliest."""
    return t(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("checkpoint"), F.min("p_size").alias("loss"))


@query("finite_means", """WITH v AS (SELECT user_id % 10 AS grp, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE value END AS loss FROM events)
SELECT grp, count(*) FILTER (NOT isfinite(loss)) AS bad, round(avg(CASE WHEN isfinite(loss) THEN loss END), 6) AS mean, count(*) FILTER (NOT isfinite(loss)) = 0 AS finite FROM v GROUP BY grp""")
def finite_means(spark, d):
    """Mean loss of the finite values, and whether any other was there; ``guards.require_finite`` raises on those."""
    k = F.col("event_id")
    loss = F.when(k % 97 == 0, float("nan")).when(k % 89 == 0, float("inf")).otherwise(F.col("value"))
    v = t(spark, d, "events").select((F.col("user_id") % 10).alias("grp"), loss.alias("loss"))
    fine = ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    return v.groupBy("grp").agg(F.count_if(~fine).alias("bad"), F.round(F.avg(F.when(fine, F.col("loss"))), 6).alias("mean"), (F.count_if(~fine) == 0).alias("finite"))


@query("recent_page", """SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 500""")
def recent_page(spark, d, n: int = 900):
    """The latest rows, at most 500 and at least one."""
    return t(spark, d, "events").select("event_id", "event_type", "value").orderBy(F.desc("event_id")).limit(max(1, min(n, 500)))


# ---------------------------------------------------------------- sets and guards


@query("duplicate_ids", """SELECT side, id, n FROM (SELECT 'labels' AS side, doc_id % 300 AS id, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'documents', doc_id, count(*) FROM documents GROUP BY ALL) WHERE n > 1""")
def duplicate_ids(spark, d):
    """Ids that are not unique on their side."""
    one = t(spark, d, "labels").select(F.lit("labels").alias("side"), (F.col("doc_id") % 300).alias("id"))
    return one.unionByName(t(spark, d, "documents").select(F.lit("documents").alias("side"), F.col("doc_id").alias("id"))).groupBy("side", "id").agg(F.count("*").alias("n")).where("n > 1")


@query("disjoint_lists", f"""WITH {CARS_SQL}, a AS (SELECT id, string_split(suitable_scenarios, ';') AS x, string_split(highlights, ';') AS y, [brand, CASE WHEN id % 5 = 0 THEN '续航' ELSE model END] AS z FROM car) SELECT id, NOT (list_has_any(x, y) OR list_has_any(x, z) OR list_has_any(y, z)) AS disjoint FROM a""")
def disjoint_lists(spark, d):
    """Whether three lists of a row share nothing."""
    c = cars(spark, d).select("id", F.split("suitable_scenarios", ";").alias("x"), F.split("highlights", ";").alias("y"), F.array(F.col("brand"), F.when(F.col("id") % 5 == 0, "续航").otherwise(F.col("model"))).alias("z"))
    return c.select("id", (~(F.arrays_overlap("x", "y") | F.arrays_overlap("x", "z") | F.arrays_overlap("y", "z"))).alias("disjoint"))


@query("restored_split", """WITH a AS (SELECT doc_id AS id, lang AS split, 'active' AS part FROM documents WHERE n_chars <= 2000 UNION ALL SELECT doc_id, lang, 'archived' FROM documents WHERE n_chars > 2000) SELECT split, part, count(*) AS n, min(id) AS first_id, count(*) - count(DISTINCT id) AS repeated FROM a GROUP BY ALL""")
def restored_split(spark, d):
    """Active and archived rows put together again by the split each one recorded, with a count of repeated ids."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("split"), "n_chars")
    both = docs.where("n_chars <= 2000").withColumn("part", F.lit("active")).unionByName(docs.where("n_chars > 2000").withColumn("part", F.lit("archived")))
    return both.groupBy("split", "part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), (F.count("*") - F.countDistinct("id")).alias("repeated"))


@query("boundary_filter", f"""WITH {CARS_SQL} SELECT id, brand FROM car WHERE id > 50 AND contains(lower(brand || ' ' || highlights || ' ' || model), 'm1') AND list_contains(string_split(highlights, ';'), '续航')""")
def boundary_filter(spark, d):
    """An id boundary, a tag and a keyword over joined fields."""
    c = cars(spark, d).where(F.col("id") > 50)
    return c.where(F.contains(F.lower(F.concat_ws(" ", "brand", "highlights", "model")), F.lit("m1")) & F.array_contains(F.split("highlights", ";"), "续航")).select("id", "brand")


@query("canonical_digest", """SELECT c_custkey, sha256('{"budget":' || c_custkey % 50 || ',"city":"' || c_mktsegment || '","family":' || c_custkey % 4 || '}') AS digest FROM customer""")
def canonical_digest(spark, d):
    """SHA-256 of compact JSON with sorted keys, whatever the order of the fields."""
    fields = {"family": (F.col("c_custkey") % 4), "city": F.col("c_mktsegment"), "budget": (F.col("c_custkey") % 50)}
    ordered = F.struct(*(fields[n].alias(n) for n in sorted(fields)))
    return t(spark, d, "customer").select("c_custkey", F.sha2(F.to_json(ordered), 256).alias("digest"))


@query("hashed_terms")
def hashed_terms(spark, d, buckets: int = 4096):
    """Term vectors in 4096 buckets without signs, L2-normed: the fallback where no vocabulary is held (own hash, so rows only)."""
    words = t(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("item_id", F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy("item_id")))
    return counts.select("item_id", "bucket", F.round(F.col("tf") / norm, 6).alias("weight"))

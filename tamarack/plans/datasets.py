"""Training-set construction and checks: hashing, splits, isolation, conversations, spans, text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions import text as X
from tamarack.plans.registry import query
from tamarack.session import table as t

KEY_SQL = r"lower(trim(regexp_replace({c}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"


def key_sql(c):
    return KEY_SQL.replace("{c}", c)


def order_hash(*cols):
    return F.sha2(F.concat_ws(":", F.lit("42"), *[F.col(c).cast("string") for c in cols]), 256)


@query("norm_hash_fingerprint", f"SELECT sha256(k) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, regexp_replace({key_sql('text')}, '[^ -~]', '', 'g') AS k FROM documents) GROUP BY k")
def norm_hash_fingerprint(spark, d):
    """SHA-256 of the ASCII identity key."""
    k = F.regexp_replace(X.ascii_key(F.col("text")), "[^ -~]", "")
    return t(spark, d, "documents").select(F.sha2(k, 256).alias("fingerprint"), "doc_id").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("norm_hash_nfkc")
def norm_hash_nfkc(spark, d):
    """SHA-256 of the NFKC identity key (no SQL counterpart)."""
    return t(spark, d, "documents").select(F.sha2(X.nfkc_key("text"), 256).alias("fingerprint"), "doc_id").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("isolation_pairs", """WITH h AS (SELECT DISTINCT source AS split, sha256(text) AS h FROM documents) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.split < b.split GROUP BY ALL""")
def isolation_pairs(spark, d):
    """Texts that two splits share. A hash has one row for each split, so pairs are bounded by splits, not by copies."""
    h = t(spark, d, "documents").select(F.col("source").alias("split"), F.sha2("text", 256).alias("h")).distinct()
    return h.alias("x").join(h.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.split") < F.col("y.split"))).groupBy(F.col("x.split").alias("a"), F.col("y.split").alias("b")).agg(F.count("*").alias("shared"))


@query("exclusion_antijoin", """SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE sha256(b.text) = sha256(d.text)) AND (lang, doc_id % 100) NOT IN (SELECT 'en', n_nationkey FROM nation)""")
def exclusion_antijoin(spark, d):
    docs = t(spark, d, "documents")
    toxic = t(spark, d, "labels").where("toxic = 1").select("doc_id")
    seen = t(spark, d, "benchmark").select(F.sha2("text", 256).alias("h")).distinct()
    pairs = t(spark, d, "nation").select(F.lit("en").alias("l"), F.col("n_nationkey").cast("long").alias("i"))
    kept = docs.join(toxic, "doc_id", "left_anti").withColumn("h", F.sha2("text", 256)).join(seen, "h", "left_anti")
    return kept.join(pairs, (F.col("lang") == F.col("l")) & (F.col("doc_id") % 100 == F.col("i")), "left_anti").select("doc_id", "lang")


@query("reconstruct_union", """WITH s AS (SELECT sha256(text) AS h, doc_id % 10 = 0 AS dev FROM documents) SELECT (SELECT count(*) FROM (SELECT h FROM s WHERE dev UNION ALL SELECT h FROM s WHERE NOT dev EXCEPT ALL SELECT h FROM s)) AS extra, (SELECT count(*) FROM (SELECT h FROM s EXCEPT ALL (SELECT h FROM s WHERE dev UNION ALL SELECT h FROM s WHERE NOT dev))) AS missing, (SELECT count(*) FROM (SELECT h FROM s WHERE dev INTERSECT SELECT h FROM s WHERE NOT dev)) AS shared""")
def reconstruct_union(spark, d):
    s = t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 10 == 0).alias("dev"))
    dev, train, both = s.where("dev").select("h"), s.where("not dev").select("h"), s.select("h")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = dev.unionAll(train)
    return n(parts.exceptAll(both), "extra").crossJoin(n(both.exceptAll(parts), "missing")).crossJoin(n(dev.intersect(train), "shared"))


@query("stratified_hash_split", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || lang || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'eval' ELSE 'train' END AS split FROM r""")
def stratified_hash_split(spark, d):
    """First tenth of each stratum (one row at least) in hash order."""
    by = W.partitionBy("lang")
    r = t(spark, d, "documents").select("doc_id", "lang", order_hash("lang", "doc_id").alias("h"))
    r = r.withColumn("rn", F.row_number().over(by.orderBy("h", "doc_id"))).withColumn("n", F.count("*").over(by))
    return r.select("doc_id", "lang", F.when(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), "eval").otherwise("train").alias("split"))


@query("group_argmin_pick", """SELECT source, arg_min(doc_id, sha256('42:' || source || ':' || CAST(doc_id AS VARCHAR))) AS doc_id FROM documents GROUP BY source""")
def group_argmin_pick(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", order_hash("source", "doc_id")).alias("doc_id"))


@query("quota_select", """WITH q AS (SELECT * FROM (VALUES ('en', 26), ('de', 6), ('fr', 26), ('es', 24)) v(lang, quota)) SELECT lang, doc_id FROM (SELECT d.lang, doc_id, quota, row_number() OVER (PARTITION BY d.lang ORDER BY sha256('42:' || d.lang || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents d JOIN q ON d.lang = q.lang) WHERE rn <= quota""")
def quota_select(spark, d):
    quota = spark.createDataFrame([("en", 26), ("de", 6), ("fr", 26), ("es", 24)], "lang string, quota int")
    r = t(spark, d, "documents").select("lang", "doc_id").join(F.broadcast(quota), "lang")
    return r.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(order_hash("lang", "doc_id"), "doc_id"))).where("rn <= quota").select("lang", "doc_id")


@query("hardness_topn", """SELECT doc_id FROM documents ORDER BY len(regexp_extract_all(text, '[0-9]')) DESC, n_chars DESC, sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""")
def hardness_topn(spark, d):
    return t(spark, d, "documents").orderBy(F.desc(F.regexp_count("text", F.lit("[0-9]"))), F.desc("n_chars"), order_hash("doc_id"), "doc_id").limit(50).select("doc_id")


@query("train_mix_concat", """(SELECT 'toxic' AS part, doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 16) UNION ALL (SELECT 'quality', doc_id FROM labels WHERE toxic = 0 AND quality = 1 ORDER BY doc_id LIMIT 32) UNION ALL (SELECT 'rest', doc_id FROM labels WHERE quality = 0 ORDER BY doc_id DESC LIMIT 24)""")
def train_mix_concat(spark, d):
    lab = t(spark, d, "labels")
    pick = lambda name, cond, order, n: lab.where(cond).orderBy(order).limit(n).select(F.lit(name).alias("part"), "doc_id")
    return pick("toxic", "toxic = 1", "doc_id", 16).unionByName(pick("quality", "toxic = 0 and quality = 1", "doc_id", 32)).unionByName(pick("rest", "quality = 0", F.desc("doc_id"), 24))


@query("resume_left_anti", """SELECT count(*) AS todo, min(doc_id) AS first_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, arg_max(quality, toxic * 10 + quality) AS q FROM labels GROUP BY doc_id) l WHERE l.doc_id = d.doc_id AND l.q >= 0)""")
def resume_left_anti(spark, d):
    """What is left to do: ids without a finished row; the last row of an id wins."""
    done = t(spark, d, "labels").groupBy("doc_id").agg(F.max_by("quality", F.col("toxic") * 10 + F.col("quality")).alias("q")).where("q >= 0")
    return t(spark, d, "documents").join(done, "doc_id", "left_anti").agg(F.count("*").alias("todo"), F.min("doc_id").alias("first_id"))


@query("id_join_gaps", """SELECT count(*) FILTER (d.doc_id IS NULL) AS extra, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def id_join_gaps(spark, d):
    j = t(spark, d, "documents").select(F.col("doc_id").alias("a")).join(t(spark, d, "labels").select(F.col("doc_id").alias("b")), F.col("a") == F.col("b"), "full_outer")
    return j.agg(F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"))


@query("snapshot_diff", """WITH b AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 3), a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 7 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 10 <> 5) SELECT CASE WHEN b.k IS NULL THEN 'created' ELSE 'overwritten' END AS change, count(*) AS n FROM a LEFT JOIN b ON a.k = b.k WHERE b.k IS NULL OR a.v IS DISTINCT FROM b.v GROUP BY ALL""")
def snapshot_diff(spark, d):
    k = F.col("p_partkey")
    before = t(spark, d, "part").where(k % 10 != 3).select(k.alias("kb"), F.col("p_size").alias("vb"))
    after = t(spark, d, "part").where(k % 10 != 5).select(k.alias("k"), F.when(k % 50 == 7, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    j = after.join(before, F.col("k") == F.col("kb"), "left").where("kb is null or not (v <=> vb)")
    return j.groupBy(F.when(F.col("kb").isNull(), "created").otherwise("overwritten").alias("change")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- conversations


@query("conversation_validate", """WITH w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
e AS (SELECT conv_id, turn, unnest([CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank content' END, CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'unknown role' END, CASE WHEN role = 'system' AND rn > 1 THEN 'late system' END, CASE WHEN role = before THEN 'repeated role' END, CASE WHEN rn = n AND role <> 'assistant' THEN 'no final answer' END]) AS message FROM w)
SELECT conv_id, turn, message FROM e WHERE message IS NOT NULL""")
def conversation_validate(spark, d):
    by = W.partitionBy("conv_id").orderBy("turn")
    w = t(spark, d, "conversations").withColumn("before", F.lag("role").over(by)).withColumn("rn", F.row_number().over(by)).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))
    rules = [
        (F.trim(F.coalesce("text", F.lit(""))) == "", "blank content"),
        (~F.col("role").isin("system", "user", "assistant", "tool"), "unknown role"),
        ((F.col("role") == "system") & (F.col("rn") > 1), "late system"),
        (F.col("role") == F.col("before"), "repeated role"),
        ((F.col("rn") == F.col("n")) & (F.col("role") != "assistant"), "no final answer"),
    ]
    return w.select("conv_id", "turn", F.explode(F.array_compact(F.array(*(F.when(c, m) for c, m in rules)))).alias("message"))


@query("first_user_last_assistant", """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id""")
def first_user_last_assistant(spark, d):
    user, bot = F.when(F.col("role") == "user", F.col("turn")), F.when(F.col("role") == "assistant", F.col("turn"))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", user).alias("first_user"), F.max_by("text", bot).alias("last_assistant"))


@query("last_n_turns", """SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def last_n_turns(spark, d):
    return t(spark, d, "conversations").withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("rn <= 3").select("conv_id", "turn", "role")


@query("step_sessions", """WITH s AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) SELECT conv_id, CAST(step AS BIGINT) AS step, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY conv_id, step""")
def step_sessions(spark, d):
    """Each assistant turn opens a step; following turns attach to it."""
    step = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy("turn"))
    return t(spark, d, "conversations").withColumn("step", step).groupBy("conv_id", "step").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


RENDER_SQL = "p AS (SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || coalesce(text, '') || chr(10) AS piece, length('<|' || role || '|>') + 1 AS head FROM conversations), o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY turn) - length(piece) AS pos FROM p)"


def rendered(conversations):
    """Turns with their rendered piece, the length of its header, and where it starts in the conversation."""
    p = conversations.select("conv_id", "turn", "role", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("piece"), (F.length("role") + 5).alias("head"))
    return p.withColumn("at", F.sum(F.length("piece")).over(W.partitionBy("conv_id").orderBy("turn")) - F.length("piece"))


@query("render_spans", f"WITH {RENDER_SQL} SELECT conv_id, turn, CAST(pos + head AS BIGINT) AS span_start, CAST(pos + length(piece) - 1 AS BIGINT) AS span_end FROM o WHERE role = 'assistant'")
def render_spans(spark, d):
    """Character offsets of assistant turns in the rendered conversation."""
    return rendered(t(spark, d, "conversations")).where("role = 'assistant'").select("conv_id", "turn", (F.col("at") + F.col("head")).cast("long").alias("span_start"), (F.col("at") + F.length("piece") - 1).cast("long").alias("span_end"))


@query("span_truncation", f"WITH {RENDER_SQL}, s AS (SELECT conv_id, pos + head AS a, pos + length(piece) - 1 AS b FROM o WHERE role = 'assistant'), k AS (SELECT conv_id, sum(b - a) AS total, sum(greatest(0, least(b, 4000) - a)) AS kept FROM s WHERE b > a GROUP BY conv_id) SELECT CASE WHEN kept = total THEN 'complete' WHEN kept = 0 THEN 'full' ELSE 'partial' END AS status, count(*) AS n FROM k GROUP BY ALL")
def span_truncation(spark, d):
    """How much assistant text a limit of 4000 characters leaves: complete, partial or fully cut."""
    a, b = F.col("at") + F.col("head"), F.col("at") + F.length("piece") - 1
    s = rendered(t(spark, d, "conversations")).where("role = 'assistant'").select("conv_id", a.alias("a"), b.alias("b")).where("b > a")
    k = s.groupBy("conv_id").agg(F.sum(F.col("b") - F.col("a")).alias("total"), F.sum(F.greatest(F.lit(0), F.least("b", F.lit(4000)) - F.col("a"))).alias("kept"))
    return k.groupBy(F.when(F.col("kept") == F.col("total"), "complete").when(F.col("kept") == 0, "full").otherwise("partial").alias("status")).agg(F.count("*").alias("n"))


@query("tool_order_match", """WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS acts FROM events GROUP BY user_id),
i AS (SELECT *, list_position(acts, 'view') AS v FROM a), j AS (SELECT *, CASE WHEN v > 0 THEN list_position(acts[v + 1:], 'click') END AS c FROM i), k AS (SELECT *, CASE WHEN c > 0 THEN list_position(acts[v + c + 1:], 'purchase') END AS p FROM j)
SELECT user_id, CAST(CASE WHEN coalesce(v, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(c, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(p, 0) > 0 THEN 1 ELSE 0 END AS INT) AS matched FROM k""")
def tool_order_match(spark, d):
    """How many of view, click, purchase occur in this order among a user's actions."""
    first = F.min(F.when(F.col("event_type") == "view", F.col("event_id"))).over(W.partitionBy("user_id"))
    e = t(spark, d, "events").withColumn("v", first)
    e = e.withColumn("c", F.min(F.when((F.col("event_type") == "click") & (F.col("event_id") > F.col("v")), F.col("event_id"))).over(W.partitionBy("user_id")))
    p = F.max(F.when((F.col("event_type") == "purchase") & (F.col("event_id") > F.col("c")), 1).otherwise(0))
    return e.groupBy("user_id").agg((F.max(F.when(F.col("v").isNotNull(), 1).otherwise(0)) + F.max(F.when(F.col("c").isNotNull(), 1).otherwise(0)) + p).cast("int").alias("matched"))


# ---------------------------------------------------------------- text functions


@query("chunk_documents", """SELECT doc_id, CAST(i // 440 AS INT) AS chunk_idx, substr(text, CAST(i + 1 AS BIGINT), 520) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 440)) AS i FROM documents)""")
def chunk_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 520, 440)).alias("chunk_idx", "content"))


@query("chunk_stats", """SELECT lang, CAST(sum(ceil(length(text) / 440.0)) AS BIGINT) AS chunks, count(*) AS docs FROM documents GROUP BY lang""")
def chunk_stats(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.sum(F.ceil(F.length("text") / 440)).cast("long").alias("chunks"), F.count("*").alias("docs"))


@query("distinct_ngrams", """WITH g AS (SELECT source, substr(x, CAST(i AS BIGINT), 4) AS gram FROM (SELECT source, x, unnest(range(1, length(x) - 2)) AS i FROM (SELECT source, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM documents) WHERE length(x) >= 4)) SELECT source, round(count(DISTINCT gram) / count(*), 6) AS distinct_4 FROM g GROUP BY source""")
def distinct_ngrams(spark, d):
    """Different character 4-grams over all of them, by source."""
    x = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    g = t(spark, d, "documents").select("source", F.explode(X.char_ngrams(x, 4)).alias("gram"))
    return g.groupBy("source").agg(F.round(F.countDistinct("gram") / F.count("*"), 6).alias("distinct_4"))


@query("text_forms", r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[\\/:*?"<>|\s]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug, CASE WHEN url = '' THEN url WHEN length(url) <= 4 THEN '***' ELSE '***' || right(url, 4) END AS masked, lower(regexp_replace(url, '[ \-_.]+', '', 'g')) AS compact, replace(replace(replace(url, 'http://', 'https://'), 'example.net', 'example.org'), '?ref=x', '') AS rewritten FROM pages""")
def text_forms(spark, d):
    """Slug, masked secret, compact name and ordered literal rewrites."""
    url = F.col("url")
    rewritten = F.replace(F.replace(F.replace(url, F.lit("http://"), F.lit("https://")), F.lit("example.net"), F.lit("example.org")), F.lit("?ref=x"), F.lit(""))
    return t(spark, d, "pages").select("page_id", X.slug(url).alias("slug"), X.masked_secret(url).alias("masked"), X.compact(url).alias("compact"), rewritten.alias("rewritten"))


@query("excerpt", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[#* -]+', ''))), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, CASE WHEN length(j) > 160 THEN left(j, 160) || '...' ELSE j END AS excerpt FROM (SELECT doc_id, array_to_string(ls, ' ') AS j FROM l)""")
def excerpt(spark, d):
    return t(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query("json_shape", """SELECT event_id, CAST(props ->> 'k' AS INT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.error') IS NOT NULL AS has_error, len(json_keys(props)) AS n_keys FROM events""")
def json_shape(spark, d):
    keys = F.json_object_keys("props")
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.array_contains(keys, "k").alias("has_k"), F.array_contains(keys, "error").alias("has_error"), F.size(keys).cast("long").alias("n_keys"))


@query("json_args_check", """WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"k": 1}' WHEN 1 THEN '{"k": "1"}' WHEN 2 THEN '{"k": true}' WHEN 3 THEN '{"k": 2, "x": 1}' ELSE '{}' END AS args FROM events) SELECT event_id, array_to_string(list_filter([CASE WHEN json_extract(args, '$.k') IS NULL THEN 'missing k' END, CASE WHEN json_type(args, '$.k') IS NOT NULL AND json_type(args, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'k is not an integer' END, CASE WHEN list_contains(json_keys(args), 'x') THEN 'unexpected x' END], lambda x: x IS NOT NULL), '; ') AS errors FROM a""")
def json_args_check(spark, d):
    """Typed arguments: required, extra and wrongly typed properties; a boolean is no integer."""
    pick = F.when(F.col("event_id") % 5 == 0, '{"k": 1}').when(F.col("event_id") % 5 == 1, '{"k": "1"}').when(F.col("event_id") % 5 == 2, '{"k": true}').when(F.col("event_id") % 5 == 3, '{"k": 2, "x": 1}').otherwise("{}")
    a = t(spark, d, "events").select("event_id", pick.alias("args"))
    keys = F.json_object_keys("args")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("args"), "$.k", "variant"))
    errors = F.array(F.when(~F.array_contains(keys, "k"), "missing k"), F.when(kind != "BIGINT", "k is not an integer"), F.when(F.array_contains(keys, "x"), "unexpected x"))
    return a.select("event_id", F.array_join(F.array_compact(errors), "; ").alias("errors"))

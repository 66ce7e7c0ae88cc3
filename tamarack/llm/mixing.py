"""Temperature mixing of sources, with DataFrame and SQL functions only.

Source token shares p become weights p**a / sum(p**a). The exponent a is bisected on a fixed grid: the
largest one whose weights reach the target entropy, raised where needed until no source repeats more
often than the limit. The budget is what the largest source yields when it is read once, so every document stays at
least once; a stated budget may be given instead. Budgets are realised as block permutations: documents fall into
blocks of their source by hash, every epoch has its own order of blocks, and a part epoch takes the blocks
from the front of its order until the budget is met to the nearest block.

Texts never move: a first pass sums tokens by source and block, and a second pass marks each document
from one small row of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.llm.common import documents, free_name, written

#: Production parameters: share of the largest possible entropy, epochs of a source at most, blocks of a source.
ENTROPY, REPEATS, BLOCKS = 0.9, 1.5, 1024
#: Exponents are multiples of 1 / GRID; a pass tests SECTION - 1 of them at once (two bisections).
GRID, SECTION = 1 << 20, 4
TOKEN = r"[^ \t\n\x0B\f\r]+"
#: Rows of the table of sources up to which it is broadcast; beyond that Spark chooses the join.
BROADCAST_SOURCES = 100_000


def token_count(text):
    """Number of stretches without white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def block_of(key):
    """Block of a row by hash of its id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") % BLOCKS


def block_key(source, epoch, block):
    """Place of a block in an epoch's permutation: blocks are read in the order of this key."""
    return F.md5(F.concat_ws("|", F.lit("epoch"), F.coalesce(source.cast("string"), F.lit("")), epoch.cast("string"), block.cast("string")))


def _search(shares: DataFrame, holds, lo: int, hi: int, largest: bool) -> int:
    """Grid exponent at the border of a monotone condition, by SECTION-fold bisection; one small job for each pass.

    ``holds(a)`` is an aggregate over ``shares``. ``largest``: the largest exponent that fulfils it (true up to
    it), else the smallest one (true from it on). The end ``lo`` (or ``hi``) is taken to fulfil it.
    """
    while lo < hi:
        inner = sorted({lo + (hi - lo) * i // SECTION for i in range(1, SECTION)} | {(lo + hi + largest) // 2})
        inner = [j for j in inner if (lo < j if largest else j < hi)]
        row = shares.agg(*(holds(j / GRID).alias(f"c{j}") for j in inner)).first()
        good = [j for j in inner if row[f"c{j}"]]
        bad = [j for j in inner if not row[f"c{j}"]]
        if largest:
            lo, hi = max([lo, *good]), min([hi, *(j - 1 for j in bad)])
        else:
            lo, hi = max([lo, *(j + 1 for j in bad)]), min([hi, *good])
    return lo


def _sum(x):
    """A sum of doubles that does not depend on the order of the rows: each is rounded to 20 decimals, the sum is exact."""
    return F.sum(x.cast("decimal(38,20)")).cast("double")


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The mixing exponent for a table with column ``p`` of positive shares; 1 where it is empty."""
    power = lambda a: F.pow("p", F.lit(a))
    wide = lambda a: F.log(_sum(power(a))) - F.lit(a) * _sum(power(a) * F.log("p")) / _sum(power(a)) >= F.lit(entropy) * F.log(F.count("p"))
    rare = lambda a: F.pow(F.max("p") / F.min("p"), F.lit(1.0 - a)) <= repeats
    if shares.isEmpty():
        return 1.0
    return max(_search(shares, wide, 0, GRID, True), _search(shares, rare, 0, GRID, False)) / GRID


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """One row for each source: tokens, weight, budget, full epochs, and the last block key of the part epoch (or null)."""
    sums = written(docs.select(F.col(source).alias("source"), block_of(F.col(id_col)).alias("block"), token_count(F.col(text)).alias("n")).groupBy("source", "block").agg(F.sum("n").alias("n")), "blocks")
    totals = sums.groupBy("source").agg(F.sum("n").alias("tokens"))
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = written(totals.withColumn("p", F.col("tokens") / F.lit(float(whole or 1))), "shares")
    real = shares.where("p > 0")
    a = exponent(real, entropy, repeats)
    z, reach = real.agg(_sum(F.pow("p", F.lit(a))), F.max(F.col("tokens") / F.pow("p", F.lit(a)))).first()
    total = float(budget) if budget is not None else (reach or 0.0) * (z or 0.0)
    weight = F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    sources = shares.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * total + 0.5))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)
    sources = sources.withColumn("epochs", full.cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    keyed = sums.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.n", "s.rest", block_key(F.col("b.source"), F.col("s.epochs"), F.col("b.block")).alias("key")).where("rest > 0")
    order = W.partitionBy("source").orderBy("key")  # at most BLOCKS rows of a source
    taken = keyed.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).where("2 * upto - n <= 2 * rest")
    cut = taken.groupBy("source").agg(F.max("key").alias("last_key"))
    return written(sources.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.source", "tokens", "weight", "budget", "epochs", "last_key"), "mix")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep_plan: bool = False, **params) -> DataFrame:
    """``docs`` with each row as often as its source's budget has it; ``keep_plan`` adds epoch, block and block_key.

    Order the rows of a source by epoch and block_key for the permutation. A null source is a source of its
    own, null texts count no tokens, a source without tokens is read once. Repeated rows count and come as often
    as they are there. Other columns stay as they are. Empty in, empty out.
    """
    sources = plan(docs, id_col, text, source, **params)
    key, full, last = free_name(docs, "mix_source"), free_name(docs, "mix_full"), free_name(docs, "mix_last")
    epoch, block, place = (free_name(docs, n) for n in ("epoch", "block", "block_key"))
    small = sources.select(F.col("source").alias(key), F.col("epochs").alias(full), F.col("last_key").alias(last))
    if sources.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    rows = docs.join(small, F.col(source).eqNullSafe(F.col(key))).withColumn(block, block_of(F.col(id_col)))
    more = F.when(block_key(F.col(source), F.col(full), F.col(block)) <= F.col(last), 1).otherwise(0)
    copies = F.col(full) + more
    repeated = rows.withColumn(epoch, F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))))
    if not keep_plan:
        return repeated.select(*docs.columns)
    return repeated.withColumn(place, block_key(F.col(source), F.col(epoch), F.col(block))).select(*docs.columns, epoch, block, place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document as often as the mixture has it, with its place in the block permutations."""
    return mix(documents(spark, sf_dir), keep_plan=True).select("doc_id", "source", "epoch", "block", "block_key")


SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n,
    CAST(concat('0x', substr(md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT) % {BLOCKS} AS block
  FROM documents),
b AS MATERIALIZED (SELECT source, block, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY source, block),
t AS MATERIALIZED (SELECT source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM b) AS p FROM b GROUP BY source),
l AS MATERIALIZED (SELECT list(p) AS ps, min(p) AS least, max(p) AS most, ln(count(*)) AS widest FROM t WHERE p > 0),
h(step, lo, hi) AS (
  SELECT 0, 0, {GRID}
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid - 1 END FROM (
    SELECT step, lo, hi, mid, ln(z) - a * list_sum(list_transform(ps, lambda x: pow(x, a) * ln(x))) / z >= {ENTROPY} * widest AS good FROM (
      SELECT step, lo, hi, mid, a, ps, widest, list_sum(list_transform(ps, lambda x: pow(x, a))) AS z FROM (
        SELECT step, lo, hi, (lo + hi + 1) // 2 AS mid, ((lo + hi + 1) // 2) / {GRID}.0::DOUBLE AS a FROM h WHERE lo < hi), l))),
r(step, lo, hi) AS (
  SELECT 0, 0, {GRID}
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN lo ELSE mid + 1 END, CASE WHEN good THEN mid ELSE hi END FROM (
    SELECT step, lo, hi, mid, pow(most / least, 1.0::DOUBLE - mid / {GRID}.0::DOUBLE) <= {REPEATS} AS good
    FROM (SELECT step, lo, hi, (lo + hi) // 2 AS mid FROM r WHERE lo < hi), l)),
a AS (SELECT greatest((SELECT max(lo) FROM h WHERE lo = hi), (SELECT max(lo) FROM r WHERE lo = hi)) / {GRID}.0::DOUBLE AS a),
z AS (SELECT sum(pow(p, a)) AS z, max(tokens / pow(p, a)) AS reach FROM t, a WHERE p > 0),
s0 AS (SELECT source, tokens, CASE WHEN p > 0 THEN CAST(floor(pow(p, a) / z * (reach * z) + 0.5) AS BIGINT) ELSE 0 END AS budget FROM t, a, z),
s AS (SELECT source, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs FROM s0),
k AS (
  SELECT b.source, b.n, budget - epochs * tokens AS rest,
    md5(concat_ws('|', 'epoch', coalesce(b.source, ''), CAST(epochs AS VARCHAR), CAST(b.block AS VARCHAR))) AS key
  FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source),
c AS (
  SELECT source, max(key) AS last_key FROM (
    SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k WHERE rest > 0)
  WHERE 2 * upto - n <= 2 * rest GROUP BY source),
m AS (
  SELECT d.doc_id, d.source, d.block, s.epochs + CASE WHEN md5(concat_ws('|', 'epoch', coalesce(d.source, ''), CAST(s.epochs AS VARCHAR), CAST(d.block AS VARCHAR))) <= c.last_key THEN 1 ELSE 0 END AS copies
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, epoch, block, md5(concat_ws('|', 'epoch', coalesce(source, ''), CAST(epoch AS VARCHAR), CAST(block AS VARCHAR))) AS block_key
FROM (SELECT doc_id, source, block, unnest(range(CAST(copies AS BIGINT))) AS epoch FROM m)
"""

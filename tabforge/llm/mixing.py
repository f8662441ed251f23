"""Mixing sources to target weights, block by block.

Each source's documents, in order of doc_id, are one stream of words cut into
blocks of ``BLOCK`` words. Output shards have about ``SHARD`` slots. Every shard
takes the whole part of each source's expected slots and draws the rest
multinomially. A source's slots are numbered through; number j is mapped by the
pseudorandom permutation of its epoch (j div blocks) to a block, so no block is
taken again before all others were. Blocks and documents meet by block number.

All arithmetic that decides is done on integers or on single double operations in a
fixed order, and all draws are hashes of counters, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.registry import query
from tabforge.operators.order import category_codes, running_sum, running_total
from tabforge.session import settle
from tabforge.sources.tables import load

BLOCK, SHARD = 128, 1024
#: A source is repeated at most so often.
EPOCHS = 3
SEED = 7
ROWS_PER_PART = 1_000_000
#: Expected slots are counted in such parts of a slot.
PARTS = 1024
#: Cells by which draws find their source.
CELLS = 1024
SHARDS_PER_RUN = 256
# Multipliers of the permutations, primes below 2**22.
PRIMES = [4194301, 4194287, 4194277, 4194271, 4194247, 4194217, 4194199, 4194191]

_WORD = r"[^\x20\x09-\x0D]+"


def _hashed(*parts: Column | str) -> Column:
    """60 uniform bits from the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def weighed(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> code, weight and target of every source.

    Targets are the water level: level times weight, or ``EPOCHS`` times the size
    where that is less. Sources are taken in order of size by weight; a source is
    full if the level that all later ones would have reaches it.
    """
    codes = category_codes(sizes, "source", "known")
    n_known = codes.count()
    sources = sizes.join(codes, "source", "left").withColumn(
        "code", F.coalesce("known", F.lit(n_known)).cast("long")
    )
    weight = F.col("code") % 3 + 1
    sources = settle(
        sources.select(
            "source", "source_size", "code", weight.alias("weight"),
            (F.lit(float(EPOCHS)) * F.col("source_size") / weight).alias("ratio"),
            (EPOCHS * F.col("source_size")).alias("most"),
        )
    )
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    full = running_total(sources, "ratio", "most").select("ratio", F.col("total_before").alias("full"))
    passed = running_total(sources, "ratio", "weight").select("ratio", F.col("total_before").alias("passed"))
    level = (F.lit(total or 0) - F.col("full")) / (F.lit(weights or 0) - F.col("passed"))
    levels = full.join(passed, "ratio").select("ratio", level.alias("level"))
    first = levels.where("ratio > level").agg(F.min(F.struct("ratio", "level")).alias("x")).first().x
    if first is None:  # no words at all
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn(
        "target",
        F.when(F.col("ratio") < first.ratio, F.col("most").cast("double")).otherwise(
            F.col("weight") * F.lit(first.level)
        ),
    )


def planned(sources: DataFrame) -> tuple[DataFrame, int, int]:
    """Per source its blocks and slots: whole ones of each shard, and ``rest`` by chance."""
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    parts = F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") * PARTS + 0.5)
    plan = sources.where("source_size > 0").withColumn("n_blocks", blocks).withColumn("parts", parts)
    plan = settle(plan)
    n_parts = plan.agg(F.sum("parts")).first()[0] or 0
    shards = max(1, -(-n_parts // (PARTS * SHARD)))
    each = PARTS * shards
    plan = plan.withColumn("whole", F.floor(F.col("parts") / each)).withColumn(
        "rest", F.col("parts") - F.col("whole") * each
    )
    return plan, shards, each


def slots(plan: DataFrame, shards: int, each: int) -> DataFrame:
    """(shard, code, j): every slot with its number among the slots of its source."""
    spark = plan.sparkSession
    rest = plan.agg(F.sum("rest")).first()[0] or 0
    # A source is cut into runs of shards first, so that no row becomes too many.
    runs = F.explode(F.expr(f"sequence(0, {(shards - 1) // SHARDS_PER_RUN})"))
    whole = plan.where("whole > 0").select("code", "whole", runs.alias("run"))
    low = f"run * {SHARDS_PER_RUN} * whole"
    high = f"least({shards}, (run + 1) * {SHARDS_PER_RUN}) * whole"
    whole = (
        whole.repartition("code", "run")
        .select("code", "whole", F.explode(F.expr(f"sequence({low}, {high} - 1)")).alias("j"))
        .select(F.expr("j div whole").alias("shard"), "code", "j")
    )
    draws = (rest + each // 2) // each
    if not draws:
        return whole
    wide = -(-rest // CELLS)
    before = running_total(plan, "code", "rest").select("code", F.col("total_before").alias("low"))
    bounds = plan.where("rest > 0").join(before, "code").select(
        "code", "whole", "low", (F.col("low") + F.col("rest")).alias("high")
    )
    bounds = bounds.withColumn(
        "cell", F.explode(F.expr(f"sequence(low div {wide}, (high - 1) div {wide})"))
    )
    drawn = (
        spark.range(shards).withColumnRenamed("id", "shard")
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("u", _hashed("shard", "draw") % rest)
        .withColumn("cell", F.expr(f"u div {wide}"))
        .join(bounds, "cell").where("low <= u AND u < high")
    )
    drawn = running_sum(
        drawn, F.lit(1), F.expr("shard div 4096"), ["shard", "draw"], ["code"], "rank"
    )
    extra = F.lit(shards) * F.col("whole") + F.col("rank")
    return whole.unionByName(drawn.select("shard", "code", extra.alias("j")))


def chosen(slot_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(shard, code, j, block): the block of every slot; slots past the last epoch are void."""
    own = slot_rows.join(plan.select("code", "n_blocks"), "code").where(
        F.col("j") < EPOCHS * F.col("n_blocks")
    )
    epoch = F.expr("j div n_blocks")
    prime = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.col("n_blocks") % p != 0)
    own = own.withColumn("mark", _hashed(F.lit("p"), "code", epoch)).withColumn("primes", prime)
    pick = F.get("primes", (F.col("mark") % F.size("primes")).cast("int"))
    block = (pick * (F.col("j") % F.col("n_blocks")) + F.expr("mark div 8 % n_blocks")) % F.col("n_blocks")
    return own.select("shard", "code", "j", block.alias("block"))


class Mix:
    """The mix of one table: sources, chosen blocks, and what is taken of each document.

    Sizes count words; a null text has none. Null sources are one source, the last
    one. Rows of one doc_id follow each other by size and text, null ids first;
    repeated rows are documents of their own. Other columns are not looked at.
    """

    def __init__(self, docs: DataFrame):
        text = F.col("text")
        self.docs = docs
        self.rows = settle(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"),
                F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
                F.xxhash64(text).alias("mark"),
            )
        )
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = settle(weighed(settle(sizes)))
        plan, shards, each = planned(self.sources)
        self.plan = settle(plan)
        self.chosen = chosen(slots(self.plan, shards, each), self.plan)

    def placed(self) -> DataFrame:
        """Documents with their source's columns and the place of their first word in its stream."""
        own = self.sources.withColumnRenamed("source", "_source")
        rows = self.rows.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        ranged = rows.withColumn("_range", F.lit(0))
        parts = -(-rows.count() // ROWS_PER_PART)
        if parts > 1:
            ranged = settle(
                rows.repartitionByRange(parts, "doc_id").withColumn("_range", F.spark_partition_id())
            )
        order = ["doc_id", "size", "mark"]
        return running_sum(ranged, F.col("size"), F.col("_range"), order, ["code"], "start").drop("_range")

    def pieces(self, placed: DataFrame) -> DataFrame:
        """Per document and block it has words in: first word, words, and times taken."""
        times = self.chosen.groupBy("code", "block").agg(F.count("*").alias("times"))
        low, high = F.col("start"), F.col("start") + F.col("size")
        each = placed.where("size > 0").withColumn(
            "block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})"))
        )
        first = F.greatest(low, F.col("block") * BLOCK)
        last = F.least(high, (F.col("block") + 1) * BLOCK)
        return each.join(times, ["code", "block"]).select(
            "doc_id", "code", "start", "size", "mark", (first - low).alias("first"),
            (last - first).alias("words"), "times",
        )

    def report(self) -> DataFrame:
        placed = settle(self.placed())
        taken = self.pieces(placed).groupBy("code", "start", "size").agg(
            F.sum(F.col("words") * F.col("times")).alias("taken")
        )
        return placed.join(taken, ["code", "start", "size"], "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )

    def documents(self) -> DataFrame:
        """What the mix takes, as rows of the input's columns.

        A row per document and round: round r holds, in their order and joined by
        single spaces, the words of the blocks that are taken at least r times.
        """
        pieces = self.pieces(self.placed()).groupBy("doc_id", "mark", "code", "start").agg(
            F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("pieces")
        )
        # Repeated rows are interchangeable: the n-th of them takes the n-th place.
        key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
        places = pieces.groupBy(key, "mark").agg(F.collect_list("pieces").alias("places"))
        turn = F.row_number().over(Window.partitionBy("key", "mark").orderBy("key"))
        rows = self.docs.select(
            F.struct("*").alias("row"), key, F.xxhash64("text").alias("mark")
        ).withColumn("turn", turn)
        rows = rows.join(places, ["key", "mark"]).where("turn <= size(places)")
        rows = rows.select(
            "row", F.get("places", F.col("turn") - 1).alias("pieces"),
            F.split(F.btrim("row.text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+").alias("words"),
        )
        rounds = F.expr("sequence(1, array_max(transform(pieces, p -> int(p.times))))")
        rows = rows.withColumn("round", F.explode(rounds))
        taken = F.expr(
            "array_join(flatten(transform(filter(pieces, p -> p.times >= round),"
            " p -> slice(words, int(p.first) + 1, int(p.words)))), ' ')"
        )
        rows = rows.select("row", taken.alias("taken"))
        own = {name: F.col("row").getField(name) for name in self.docs.columns}
        own["text"] = F.col("taken")
        if "n_chars" in own:
            own["n_chars"] = F.length("taken").cast(self.docs.schema["n_chars"].dataType)
        return rows.select(*[value.alias(name) for name, value in own.items()])


_H = "('0x' || substr(md5({0}), 1, 15))::BIGINT".format

SQL = f"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS code
      FROM d GROUP BY 1),
s AS (SELECT *, code % 3 + 1 AS weight, {EPOCHS}.0::DOUBLE * source_size / (code % 3 + 1) AS ratio FROM z),
l AS (SELECT DISTINCT ratio,
        ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum({EPOCHS} * source_size) FROM s x WHERE x.ratio < s.ratio), 0))::DOUBLE
        / ((SELECT sum(weight) FROM s) - coalesce((SELECT sum(weight) FROM s x WHERE x.ratio < s.ratio), 0))::DOUBLE AS level FROM s),
f AS (SELECT ratio, level FROM l WHERE ratio > level ORDER BY ratio LIMIT 1),
t AS (SELECT s.*, CASE WHEN f.ratio IS NULL THEN 0.0 WHEN s.ratio < f.ratio THEN ({EPOCHS} * source_size)::DOUBLE
                  ELSE weight * f.level END AS target FROM s LEFT JOIN f ON true),
b AS (SELECT *, ceil(source_size / {BLOCK})::BIGINT AS n_blocks FROM t WHERE source_size > 0),
p AS (SELECT *, floor(target * n_blocks / source_size * {PARTS} + 0.5)::BIGINT AS parts FROM b),
h AS (SELECT greatest(1, ceil(sum(parts) / {PARTS * SHARD}))::BIGINT AS shards FROM p),
w AS (SELECT *, parts // ({PARTS} * shards) AS whole, parts % ({PARTS} * shards) AS rest FROM p, h),
c AS (SELECT *, coalesce(sum(rest) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low,
             (sum(rest) OVER ())::BIGINT AS rests FROM w),
n AS (SELECT DISTINCT shards, rests, (rests + {PARTS} * shards // 2) // ({PARTS} * shards) AS draws FROM c),
u AS (SELECT shard, draw, {_H(f"'{SEED}:' || shard || ':' || draw")} % rests AS u
      FROM n, unnest(range(0, shards)) AS r(shard), unnest(range(0, draws)) AS q(draw) WHERE rests > 0),
x AS (SELECT code, whole * shards + row_number() OVER (PARTITION BY code ORDER BY shard, draw) - 1 AS j
      FROM u JOIN c ON low <= u AND u < low + rest),
j AS (SELECT code, j FROM c, unnest(range(0, whole * shards)) AS r(j) UNION ALL SELECT code, j FROM x),
k AS (SELECT code, j, n_blocks, {_H(f"'{SEED}:p:' || code || ':' || (j // n_blocks)")} AS mark,
             list_filter({PRIMES}, lambda q: n_blocks % q <> 0) AS primes
      FROM j JOIN c USING (code) WHERE j < {EPOCHS} * n_blocks),
m AS (SELECT code, (primes[mark % len(primes) + 1] * (j % n_blocks) + mark // 8 % n_blocks) % n_blocks AS block,
             count(*) AS times FROM k GROUP BY 1, 2),
o AS (SELECT d.*, t.code, t.source_size, t.target,
             (sum(size) OVER (PARTITION BY t.code ORDER BY doc_id) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT doc_id, sum((least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})) * times) AS taken
      FROM o JOIN m USING (code) WHERE start < (block + 1) * {BLOCK} AND start + size > block * {BLOCK} GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN g USING (doc_id)"""


@query("op3_mix_sources", SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(load(spark, sf_dir, "documents")).report()

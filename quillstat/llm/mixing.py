"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_PASSES = 3
#: Words of a block, unless the corpus is so small that fewer make at least MIN_SLOTS slots.
BLOCK_WORDS = 1024
MIN_SLOTS = 65536
#: With blocks of its own, a source has this many at least (one a word, if it has fewer words).
OWN_BLOCKS = 1024
#: 2^32 divided by the golden ratio, made odd: k * GOLDEN mod 2^32 walks the unit interval evenly.
GOLDEN = 2654435769
#: Cells of the unit interval in which slots meet the sources' shares.
CELLS = 4096
#: Parts of a source's rows in which they meet its figures, where there are too many sources to broadcast.
SALTS = 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """Targets of each source from (source, size) rows: shares by weight, at most ``most_passes`` times its size.

    What capped sources leave is reshared among the others by weight until none is above: with the sources in
    order of cap over weight, the water level is found at the first source that the level no longer fills.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("bigint")})
    alone = common.few(total)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = common.running(total, ["last", "source"], {"place": "one"}, alone, "sources")
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most_passes).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = common.running(ranked, ["ratio", "place"], {"caps": "cap", "weights": "weight"}, alone, "ratios")
    ranked = common.beside(ranked, alone, all_size=F.sum("source_size"), all_weight=F.sum("weight"))
    ranked = ranked.withColumn("level", (F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights")))
    # The first source whose cap the level doesn't exceed sets the level of it and all after it; from there on
    # levels only fall, so it is the highest of those that fit.
    ranked = common.beside(ranked, alone, fits=F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))))
    return ranked.select(
        "source",
        "place",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("fits"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS, min_slots: int = MIN_SLOTS, own_blocks: bool = False,
) -> DataFrame:
    """How many words a weighted mix takes from each document.

    Slot k of the schedule lies at k * GOLDEN mod 2^32 (a golden-ratio sequence, exact in integers) and goes to the
    source whose cumulative target share covers that point, so every stretch of the schedule holds the sources in
    their proportions. The r-th slot of a source takes block r of the source's documents laid end to end in hash
    order and cut into equal blocks of words, beginning anew after the last block, at most ``most_passes`` times.

    Blocks have one size for all sources, as in OP2_SQL; a source of few blocks then misses its target by up to a
    block or more. With ``own_blocks`` such a source is cut into at least OWN_BLOCKS smaller ones, and slots are dealt
    by targets over block sizes, so that it ends within a few thousandths of its size from its target.

    Result: the id, ``size`` (words), ``source_size``, ``target``, ``taken``. Documents without words take nothing
    and still get a row. Null sources are one source, ordered last. Rows repeating an id are documents of their
    own; rows equal in id, source and size share what is taken in any order. A text of any length may lie in several
    blocks. Other columns are ignored, whatever their names; an empty table gives no rows. Everything but word
    counting moves only (id, source, size).
    """
    spark = docs.sparkSession
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(common.WORD), F.lit(0)))
    sizes, _ = common.materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.cast("bigint").alias("size")), "sizes"
    )
    targets, _ = common.materialize(source_targets(sizes, weights, most_passes), "targets")
    total = int(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    block = max(1, min(block_words, total // min_slots), total >> 30)
    slots = max(1, round(total / block)) if total else 0
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {OWN_BLOCKS}"))).cast("bigint") if own_blocks else F.lit(block).cast("bigint")
    targets = targets.withColumn("width", own)
    if own_blocks:
        slots = round(targets.agg(F.coalesce(F.sum(F.col("target") / F.col("width")), F.lit(0.0))).first()[0])

    taken_of = schedule(spark, targets, slots, F.col("target") / F.col("width") if own_blocks else F.col("target"), most_passes)
    places = targets.select("source", "place", "width")
    alone = common.few(targets)
    known = _placed(sizes, places, alone).select("doc_id", "place", "size", "width")
    stream = common.bucketed_running(
        known.filter("size > 0").withColumn("h", common.hash60(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("/mix")))).withColumn("piece", F.shiftright("h", 48)),
        ["place"], "piece", ["h", "doc_id", "size"], {"start": "size"},
    )
    spans = stream.withColumn("stop", F.col("start") + F.col("size"))
    spans = spans.withColumn("block", F.explode(F.expr("sequence(start div width, (stop - 1) div width)")))
    overlap = F.least("stop", (F.col("block") + 1) * F.col("width")) - F.greatest("start", F.col("block") * F.col("width"))
    pieces = spans.join(taken_of, ["place", "block"], "left")
    taken = pieces.groupBy("place", "start", "doc_id", "size").agg(F.sum(overlap * F.coalesce("passes", F.lit(0))).alias("taken"))
    empty = known.filter("size = 0").select("place", F.lit(0).cast("bigint").alias("start"), "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    out = taken.unionByName(empty)
    about = targets.select("place", "source_size", "target")
    return _placed(out, about, alone, "place").select("doc_id", "size", "source_size", "target", "taken")


def _placed(rows: DataFrame, sources: DataFrame, alone: bool, key: str = "source") -> DataFrame:
    """Rows with what is known of their source: broadcast if there are few, else joined in SALTS parts of each source."""
    if alone:
        return rows.join(F.broadcast(sources), rows[key].eqNullSafe(sources[key])).drop(sources[key])
    sources = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return rows.join(sources, rows[key].eqNullSafe(sources[key]) & (rows["salt"] == sources["salt"])).drop(sources[key], "salt")


def schedule(spark, targets: DataFrame, slots: int, share: Column, most_passes: int) -> DataFrame:
    """(place, block, passes): how often the schedule takes each block of each source, slots being dealt by ``share``."""
    alone = common.few(targets)
    shares = targets.filter("source_size > 0").withColumn("share", share).withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")))
    shares = common.running(shares, ["place"], {"a": "share"}, alone, "shares").withColumn("b", F.col("a") + F.col("share"))
    shares = common.beside(shares, alone, all=F.sum("share"), last=F.max("place"))
    point = lambda c: F.floor(F.col(c) / F.col("all") * float(1 << 32)).cast("bigint")
    shares = shares.select("place", "blocks", point("a").alias("lo"), F.when(F.col("place") == F.col("last"), F.lit(1 << 32)).otherwise(point("b")).alias("hi"))
    width = (1 << 32) // CELLS
    cells = shares.filter("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}L, (hi - 1) div {width}L)")))
    k = spark.range(slots).withColumn("x", (F.col("id") * GOLDEN) % (1 << 32)).withColumn("cell", F.expr(f"x div {width}L"))
    owned = k.join(cells, "cell").filter("x >= lo AND x < hi").select("place", "blocks", "id", F.expr("id div 4096L").alias("piece"), F.lit(1).cast("bigint").alias("one"))
    ranks = common.bucketed_running(owned, ["place", "blocks"], "piece", ["id"], {"rank": "one"})
    ranks = ranks.filter(F.col("rank") < F.col("blocks") * most_passes)
    return ranks.groupBy("place", F.expr("rank % blocks").alias("block")).agg(F.count(F.lit(1)).alias("passes"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken (words taken over its size, to the nearest whole).

    Each source has blocks of its own, so that small ones meet their targets too. Since blocks follow each other in a
    source's stream, at most one document of a source is taken in part, so rounding changes a source by less than
    half a document. Documents without words (null texts among them) are kept once. Columns, names and texts stay as
    they are; rows of one id (or none) count together; an empty table gives none.
    """
    take = mix_sources(docs, **{"own_blocks": True} | options)
    id_col = options.get("id_col", "doc_id")
    named, times, copy = (common.free_name(docs, x) for x in ("taken_id", "times", "copy"))
    copies = take.groupBy(F.col("doc_id").alias(named)).agg(
        F.when(F.sum("size") == 0, F.lit(1)).otherwise(F.floor(F.sum("taken") / F.sum("size") + 0.5)).cast("int").alias(times)
    )
    held = docs.join(copies.filter(F.col(times) > 0), docs[id_col].eqNullSafe(copies[named]))
    again = held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return again.select(*[docs[f"`{c}`"] for c in docs.columns])


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each: see mix_sources."""
    return mix_sources(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, source_size * 3 AS cap FROM totals),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER w - cap) AS DOUBLE) / CAST(sum(weight) OVER () - (sum(weight) OVER w - weight) AS DOUBLE) AS level
  FROM weighed
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, place, source_size,
         least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0.0) * weight) AS target FROM levels),
setup AS (
  SELECT CAST(sum(source_size) AS BIGINT) AS total, greatest(1, least(1024, CAST(sum(source_size) AS BIGINT) // 65536), CAST(sum(source_size) AS BIGINT) >> 30) AS block FROM targets),
shares AS (
  SELECT place, block, total, CAST(ceil(source_size / block) AS BIGINT) AS blocks,
         sum(target) OVER w - target AS a, sum(target) OVER w AS b, sum(target) OVER () AS al, place = max(place) OVER () AS final
  FROM targets, setup WHERE source_size > 0
  WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
points AS (
  SELECT place, blocks, CAST(floor(a / al * 4294967296.0) AS BIGINT) AS lo, CASE WHEN final THEN 4294967296 ELSE CAST(floor(b / al * 4294967296.0) AS BIGINT) END AS hi FROM shares),
slots AS (
  SELECT k, (k * 2654435769) % 4294967296 AS x FROM (SELECT unnest(range(CAST(CASE WHEN total = 0 THEN 0 ELSE greatest(1, round(total / block)) END AS BIGINT))) AS k FROM setup)),
ranks AS (
  SELECT place, blocks, row_number() OVER (PARTITION BY place ORDER BY k) - 1 AS r FROM slots JOIN points ON x >= lo AND x < hi),
passes AS (SELECT place, r % blocks AS b, count(*) AS passes FROM ranks WHERE r < 3 * blocks GROUP BY ALL),
hashed AS (
  SELECT doc_id, place, size, source_size, target,
         CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '-'), '/mix')), 1, 15)) AS BIGINT) AS h
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
spans AS (
  SELECT *, sum(size) OVER (PARTITION BY place ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM hashed WHERE size > 0),
cut AS (
  SELECT spans.*, block, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block AS BIGINT) + 1)) AS b FROM spans, setup),
taken AS (
  SELECT cut.place, doc_id, size, source_size, target, start,
         sum((least(start + size, (cut.b + 1) * block) - greatest(start, cut.b * block)) * coalesce(passes, 0)) AS taken
  FROM cut LEFT JOIN passes ON cut.place = passes.place AND cut.b = passes.b GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM taken
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM hashed WHERE size = 0
"""

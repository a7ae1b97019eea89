"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, by code point with null last, get weights that repeat in the order
given, and share as many words as there are in all; a source's target stops at
``max_repeat`` times its own words, and what it leaves goes to the others by
weight. A source whose target stops there is taken whole, ``max_repeat`` times.
For the others blocks of equally many words are dealt by highest quotients
w / (2k - 1): first to the sources, by target, then within a source to its
shards, by words. What a shard cannot take (its quota is over ``max_repeat`` times
its words) goes to the source's other shards, those with the highest next
quotient first. A shard turns its words into whole passes and a remainder, which
is filled with its blocks in a seeded order (the last one partly). A source has
shards in proportion to its words, which a hash of the document picks; so a hot
source is spread over many tasks, and a small one is not scattered.

Edge cases: a null or blank text has no words and is taken 0 times; a source
without words has the target 0; null is a source of its own; documents of one id
are told apart by size and text, and equal rows are interchangeable (they share
a shard); an empty table gives an empty result; columns of other names are kept
by ``mix_texts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut, packed

SEED = "mix"


def sainte_lague(cells: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group dealt to its cells by the highest quotients weight / (2k - 1).

    Rounding every cell's fair share leaves the sum off by at most half the
    number of cells, and moves the final divisor little: a cell can still win or
    lose no more than weight * cells / (2 * sum of weights) + 2 seats. Only those
    quotients are compared, so the work is in proportion to the cells."""
    whole = Window.partitionBy(*group)
    total, n = F.sum(weight).over(whole), F.count("*").over(whole)
    share = F.when(total > 0, F.col(seats) * F.col(weight) / total).otherwise(0.0)
    cells = cells.withColumns({"_base": F.floor(share + 0.5).cast("long"), "_move": F.when(total > 0, F.ceil(F.col(weight) * n / (2 * total)) + 2).otherwise(0)})
    cells = cells.withColumn("_off", F.col(seats) - F.sum("_base").over(whole))
    most = F.least(F.abs("_off"), F.when(F.col("_off") < 0, F.least("_move", "_base")).otherwise(F.col("_move"))).cast("int")
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array(F.lit(None).cast("int")))
    tried = cells.withColumn("_step", F.explode(steps))
    up = F.col("_off") > 0
    k = F.when(up, F.col("_base") + F.col("_step")).otherwise(F.col("_base") - F.col("_step") + 1)
    # a seat is won by the highest quotient, the smaller key first; it is lost the other way round
    quotient = F.col(weight) / (2 * k - 1)
    by = Window.partitionBy(*group).orderBy(
        F.col("_step").isNull(), F.when(up, -quotient).otherwise(quotient), F.when(up, F.col(key)), F.col(key).desc(), "_step"
    )
    won = F.when(F.col("_step").isNotNull() & (F.row_number().over(by) <= F.abs("_off")), F.signum("_off")).otherwise(0)
    tried = tried.withColumn("_won", won.cast("long"))
    kept = [c for c in cells.columns if c not in ("_base", "_move", "_off")]
    return tried.groupBy(*group, key).agg(*[F.first(c).alias(c) for c in kept if c not in (*group, key)], (F.first("_base") + F.sum("_won")).alias("quota"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Adds ``_size``, ``_source`` (null last), ``_text`` (a hash) and ``_h``, the seeded order of documents."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col)))
    docs = docs.withColumns({"_size": size, "_source": source, "_text": F.md5(F.coalesce(F.col(text_col), F.lit("")))})
    return docs.withColumn("_h", F.md5(F.concat_ws(":", F.lit(SEED), F.col(id_col).cast("string"), F.col("_size").cast("string"), F.col("_text"))))


def _sharded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``_shard``, one of the source's ``_shards``."""
    picked = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("_shards")
    return rows.join(sources.select("_source", "_shards"), "_source").withColumn("_shard", picked).drop("_shards")


def _targets(sources: DataFrame, total: int, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """One row per source: its words, its target. Sorted by the share at which a source is full, a source is full
    if what those before it leave, dealt by weight to it and those behind it, would fill it."""
    turn = (F.row_number().over(Window.orderBy("_source")) - 1) % len(weights)
    rows = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("_full", max_repeat * F.col("source_size"))
    by = Window.orderBy(F.col("_full") / F.col("_w"), "_source")
    before = F.coalesce(F.sum("_full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_is_full", F.col("_full") * behind <= (F.lit(total) - before) * F.col("_w"))
    every = Window.partitionBy(F.lit(0))
    left = F.lit(total) - F.sum(F.when(F.col("_is_full"), F.col("_full")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("_is_full"), 0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_is_full"), F.col("_full").cast("double")).otherwise(left * F.col("_w") / open_weight)
    return rows.select("_source", "source_size", target.alias("target"), "_is_full")


def _block_hash(block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), "_source", F.col("_shard").cast("string"), block.cast("string")))


def decide(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeat: int = 3,
    block_words: int = 64,
    shard_words: int = 32768,
    max_shards: int = 65536,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, ``source_col`` and the columns to ``carry``, with ``_size``, ``source_size``, ``target``, ``passes`` (whole copies)
    and ``pieces`` (word ranges [lo, hi) taken once more).

    A source has a shard for each ``shard_words`` of its words (more words where there would be over ``max_shards``). A
    block has ``block_words`` words, more where a shard would have over 512, less where there would be under 4,096."""
    sized = _sized(docs, id_col, text_col, source_col)
    light = [id_col, source_col, "_size", "_source", "_text", "_h"]
    light = cut(sized.select(*dict.fromkeys(light)))
    by_source = cut(light.groupBy("_source").agg(F.sum("_size").alias("source_size")))
    total, n_sources, letters = by_source.agg(F.sum("source_size"), F.count("*"), F.sum(F.octet_length("_source"))).first()
    total = int(total or 0)
    per_shard = max(shard_words, -(-total // max_shards))
    block = max(1, min(max(block_words, per_shard // 512), total // 4096))
    targets = _targets(by_source, total, weights, max_repeat)
    shards = F.greatest(F.lit(1).cast("long"), F.expr(f"(source_size + {per_shard - 1}) div {per_shard}"))
    targets = cut(targets.withColumn("_shards", shards))
    # the words that are not in full sources, in blocks
    open_words = int(targets.where("not _is_full").agg(F.sum("target")).first()[0] or 0)
    seats = targets.where("not _is_full").withColumns({"_all": F.lit(0), "_seats": F.lit((2 * open_words + block) // (2 * block)).cast("long")})
    seats = sainte_lague(seats, ["_all"], "_source", "target", "_seats").select("_source", F.col("quota").alias("_blocks"))
    sources = targets.join(seats, "_source", "left")
    # a table of all sources is sent to every task only where its counted size is small
    small = n_sources <= 10_000 and (letters or 0) <= 1 << 20
    sources = F.broadcast(sources) if small else sources
    sharded = _sharded(light, sources)
    cells = sharded.groupBy("_source", "_shard").agg(F.sum("_size").alias("_words"))
    cells = cells.join(sources.select("_source", "source_size", "target", "_is_full", "_blocks"), "_source")
    dealt = sainte_lague(cells.where("not _is_full"), ["_source"], "_shard", "_words", "_blocks")
    # what is over a shard's bound goes to the others, as far as they have room
    most = F.col("_words") * max_repeat
    dealt = dealt.withColumn("_taken", F.least(F.col("quota") * block, most)).withColumn("_room", most - F.col("_taken"))
    over = F.sum(F.col("quota") * block - F.col("_taken")).over(Window.partitionBy("_source"))
    turn = Window.partitionBy("_source").orderBy((-F.col("_words") / (2 * F.col("quota") + 1)), "_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_room").over(turn), F.lit(0))
    dealt = dealt.withColumn("_taken", F.col("_taken") + F.greatest(F.lit(0), F.least(F.col("_room"), over - before)))
    full = cells.where("_is_full").withColumn("_taken", most)
    columns = ["_source", "_shard", "source_size", "target", "_words", "_taken"]
    cells = dealt.select(*columns).union(full.select(*columns))

    cells = cells.withColumn("passes", F.expr("_taken div greatest(_words, 1)"))
    cells = cells.withColumn("_rest", F.col("_taken") - F.col("passes") * F.col("_words"))
    n_blocks = F.expr(f"(_words + {block - 1}) div {block}")
    order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda b: F.struct(_block_hash(b).alias("h"), b.alias("b"))))
    cells = cells.withColumns({"_order": F.when(F.col("_rest") > 0, order), "_last": n_blocks - 1})
    # all blocks are full but the shard's last one, so the blocks that fit are counted, not added up
    short = F.expr(f"{block} - (_words - _last * {block})")
    at_last = F.array_position(F.transform("_order", lambda x: x["b"]), F.col("_last")) - 1
    fit = F.expr(f"_rest div {block}")
    fit = F.when(fit < at_last, fit).otherwise(F.expr(f"(_rest + {block} - (_words - _last * {block})) div {block}"))
    cells = cells.withColumns({"_fit": fit, "_at_last": at_last, "_short": short})
    filled = F.col("_fit") * block - F.when(F.col("_fit") > F.col("_at_last"), F.col("_short")).otherwise(0)
    cells = cells.select("_source", "_shard", "source_size", "target", "passes", F.get("_order", F.col("_fit").cast("int")).alias("_stop"), (F.col("_rest") - filled).alias("_part"))

    stream = Window.partitionBy("_source", "_shard").orderBy("_h", id_col, "_size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = _sharded(sized, sources) if carry else sharded
    rows = rows.select(*dict.fromkeys([id_col, source_col, *carry, "_size", "_source", "_shard", "_text", "_h"]))
    rows = rows.withColumn("_start", F.coalesce(F.sum("_size").over(stream), F.lit(0)))
    rows = rows.join(cells, ["_source", "_shard"])

    def piece(b: Column) -> Column:
        h = _block_hash(b)
        whole = (h < F.col("_stop.h")) | ((h == F.col("_stop.h")) & (b < F.col("_stop.b")))
        upto = b * block + F.when(whole, F.lit(block)).when(b == F.col("_stop.b"), F.col("_part")).otherwise(F.lit(0))
        lo = F.greatest(b * block - F.col("_start"), F.lit(0))
        return F.struct(lo.alias("lo"), F.least(upto - F.col("_start"), F.col("_size")).alias("hi"))

    blocks = F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + _size - 1) div {block}"))
    pieces = F.filter(F.transform(blocks, piece), lambda p: p["hi"] > p["lo"])
    empty = F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)")
    return rows.withColumn("pieces", F.when((F.col("_size") > 0) & F.col("_stop").isNotNull(), pieces).otherwise(empty))


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a row for each whole copy, and one with the words taken once more."""
    body = F.col("_doc")[text_col]  # a row carries its text once
    rows = packed(docs, _doc_id=F.col(id_col), _from=F.col(source_col))
    rows = decide(rows, id_col="_doc_id", text_col=f"_doc.`{text_col}`", source_col="_from", carry=("_doc",), **options)
    words = F.split(F.trim(body, F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1)
    part = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(words, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    copies = F.array_repeat(body, F.col("passes").cast("int"))
    texts = F.when(F.size("pieces") > 0, F.array_append(copies, part)).otherwise(copies)
    mixed = rows.where("_size > 0").select("_doc", F.explode(texts).alias("_copy"))
    new = {text_col: F.col("_copy")}
    if length_col in docs.columns:
        new[length_col] = F.char_length("_copy").cast(docs.schema[length_col].dataType)
    return mixed.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def op1_query(docs: DataFrame) -> DataFrame:
    extra = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    return decide(docs.select("doc_id", "text", "source")).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("passes") * F.col("_size") + extra).alias("taken")
    )

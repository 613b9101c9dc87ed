"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Targets. Each source gets its weight's share of all words; no target exceeds
``max_repeats`` times its source's size, and what that cuts off is shared again
by weight until no target is above (solved in closed form over the sources).

Quotas. All words are cut into equal blocks. The blocks are seats: they go to
sources by the highest quotients target / (2k + 1), then from each source to
groups of shards and from a group to its shards by size. Every level is an
exact highest-quotient apportionment over few rows (see ``sainte_lague``), so no
task ever holds more than ``FANOUT`` shards of a source, however large the
source is. A block has ``block_words`` words, or a power of two fewer where the
smallest target is less than ``FINE`` such blocks, so that small sources come
near their targets too; the last block of a shard may be cut short.

Selection. Documents are dealt to shards by a seeded hash and laid end to end
in hash order. A quota larger than a shard takes the whole shard as often as it
fits; the rest are distinct blocks of ``block_words`` picked by a seeded
permutation of the shard's blocks, the last one cut short so that a shard gives
exactly its quota. Blocks are never exploded: a document's share is arithmetic
over the few blocks it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import WORD, apart, n_words, pick
from graphloom.storage import materialize

FANOUT = 1024
#: Blocks of quota that the smallest target holds, at least, unless blocks are single words.
FINE = 32
#: Above this many sources the table of sources is joined by key instead of broadcast.
MAX_BROADCAST_SOURCES = 100_000
#: Strides of the block permutation: primes larger than any number of blocks in a shard.
STRIDES = (2147483647, 1000000007, 1000000009, 998244353)


def sainte_lague(parts: DataFrame, group: list[str], key: list[str], share: str, seats: str, out: str) -> DataFrame:
    """Deal ``seats`` (one number per group) to the rows of each group by highest quotients.

    The quotients of a row are share / 1, share / 3, share / 5 ...; ties go to
    the smaller key. With r = seats * share / total the result of a row lies
    between round(r * (n - s) / n) and round(r * (n + s) / n) for s rows and n
    seats, so only those of its quotients compete; over a group they are at
    most about three per row. Rows of share 0 get none.
    """
    whole = Window.partitionBy(*group)
    r = F.col(share) * F.col("_n") / F.col("_total")
    base = (
        parts.withColumn("_total", F.sum(share).over(whole).cast("double"))
        .withColumn("_s", F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(whole))
        .withColumn("_n", F.col(seats).cast("double"))
    )
    alive = (F.col(share) > 0) & (F.col("_n") > 0)
    low = F.greatest(F.floor(r * (F.col("_n") - F.col("_s")) / F.col("_n") + F.lit(0.5)) - 1, F.lit(0))
    high = F.floor(r * (F.col("_n") + F.col("_s")) / F.col("_n") + F.lit(0.5)) + 1
    base = base.withColumn("_low", F.when(alive, low).otherwise(0).cast("long")).withColumn("_high", F.when(alive, high).otherwise(0).cast("long"))
    base = base.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    tried = base.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))))
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_last("_quotient"), *[F.asc(k) for k in key], F.asc("_k"))
    tried = tried.withColumn("_quotient", F.col(share) / (2 * F.col("_k") + 1)).withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & F.col("_k").isNotNull()).cast("long"))
    names = [c for c in parts.columns if c not in (*group, *key)]
    return tried.groupBy(*group, *key).agg(*[F.first(c).alias(c) for c in names], (F.first("_low") + F.sum("_won")).alias(out))


def targets(sizes: DataFrame, max_repeats: int) -> DataFrame:
    """Add ``target`` to rows of (source_id, source_size, weight), one per source.

    In ascending order of limit per weight, sources are at their limit up to the
    first whose share of what the earlier ones left doesn't exceed its limit.
    """
    limit = F.col("source_size") * max_repeats
    order = Window.orderBy(F.col("_limit") / F.col("weight"), "source_id")
    everything = Window.partitionBy()
    df = (
        sizes.withColumn("_limit", limit)
        .withColumn("_before", F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_weights"))
        .withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_limit"))
        .withColumn("_level", F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.struct(F.col("_limit") / F.col("weight"), "source_id"))).over(everything))
    )
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))
    return df.withColumn("target", target).drop("_limit", "_before", "_weights", "_level", "_open")


def source_weights(sized: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """One row per source with its size, documents and weight; sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(F.col("source_id") - 1, F.lit(len(cycle))) + 1).cast("int"))
    return by.withColumn("source_id", rank.cast("long")).withColumn("weight", weight.cast("long"))


def _overlaps(block: int) -> Column:
    """For each block that a document touches: the words of the document in the part of the block that the rest of the quota picks."""
    begin, end, full_blocks = F.col("begin"), F.col("begin") + F.col("size"), F.col("_blocks")

    def one(b: Column) -> Column:
        place = F.pmod(b * F.col("_stride") + F.col("_shift"), F.greatest(full_blocks, F.lit(1)))
        length = (
            F.when(b >= full_blocks, F.when(F.col("_full") >= full_blocks, F.col("_part")).otherwise(0))
            .when(place < F.col("_full"), block)
            .when(place == F.col("_full"), F.col("_part"))
            .otherwise(0)
        )
        first = F.greatest(begin, b * block)
        return F.struct((first - begin).alias("start"), F.greatest(F.least(end, b * block + length) - first, F.lit(0)).alias("words"))

    touched = F.transform(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}")), one)
    none = F.array().cast("array<struct<start:bigint,words:bigint>>")
    return F.when((F.col("size") > 0) & ((F.col("_full") > 0) | (F.col("_part") > 0)), F.filter(touched, lambda x: x["words"] > 0)).otherwise(none)


def mix(
    docs: DataFrame,
    *,
    cycle: tuple[int, ...] = (5, 2, 1),
    block_words: int = 16,
    shard_words: int = 1 << 18,
    shard_docs: int = 4096,
    max_repeats: int = 3,
    seed: int = 17,
) -> DataFrame:
    """Decide how many words of each document a mix of all sources takes.

    ``docs`` has doc_id, text and source; other columns are ignored. Returns one
    row per input row: doc_id, source, text_hash (xxhash64 of the text), size,
    source_size, target, taken, copies (how often the whole text is taken) and
    spans (start word and words of what is taken once more, in order).

    Null or empty text: size 0, nothing taken. Null source: a source of its own,
    ranked last. Null doc_ids are documents like others. Repeated rows count
    each: they are collapsed to a number and dealt out again one by one, so that
    many of them spread over the shards. Sources come within a few blocks of
    their targets, the smallest ones within a few words. An empty table gives
    an empty result. Same input, same result.
    """
    slim = pick(docs, "doc_id", "text", "source")
    sized = materialize(slim.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = targets(source_weights(sized, cycle), max_repeats)
    # the least power of two that keeps FINE blocks in the smallest target
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    fine = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.coalesce(smallest, F.lit(1.0)) / FINE, F.lit(1.0)))))
    sources = sources.withColumn("_one", F.lit(1)).withColumn("block", F.least(F.lit(block_words), fine).cast("long"))
    sources = sources.withColumn("_blocks_all", F.round(F.col("_all") / F.col("block")).cast("long"))
    sources = sainte_lague(sources, ["_one"], ["source_id"], "target", "_blocks_all", "source_quota")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / shard_docs), F.lit(1))
    sources = materialize(sources.withColumn("n_shards", shards.cast("long")).select("source", "source_id", "source_size", "target", "source_quota", "block", "n_shards"), "mix-sources")
    small = F.broadcast if sources.count() <= MAX_BROADCAST_SOURCES else lambda df: df

    rows = sized.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("repeats"))
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).drop("repeats")
    hashed = materialize(rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "repeat")), "mix-rows")
    dealt = hashed.join(small(sources), hashed["source"].eqNullSafe(sources["source"])).select(hashed["*"], "source_id", "source_size", "target", "source_quota", "block", F.pmod("_h", F.col("n_shards")).alias("shard"))
    dealt = dealt.withColumn("shards", F.expr(f"shard div {FANOUT}"))

    per_shard = dealt.groupBy("source_id", "shards", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    groups = per_shard.groupBy("source_id", "shards").agg(F.sum("shard_size").alias("group_size"), F.first("source_quota").alias("source_quota"))
    groups = sainte_lague(groups, ["source_id"], ["shards"], "group_size", "source_quota", "group_quota").select("source_id", "shards", "group_quota")
    quotas = sainte_lague(per_shard.join(groups, ["source_id", "shards"]), ["source_id", "shards"], ["shard"], "shard_size", "group_quota", "quota")
    words = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * max_repeats)
    shift = F.xxhash64(F.lit(seed + 1), "source_id", "shard")
    quotas = (
        quotas.withColumn("_words", words)
        .withColumn("_copies", F.when(F.col("shard_size") > 0, F.expr("_words div shard_size")).otherwise(0))
        .withColumn("_rest", F.col("_words") - F.col("_copies") * F.col("shard_size"))
        .withColumn("_full", F.expr(f"_rest div {block_words}"))
        .withColumn("_part", F.expr(f"_rest % {block_words}"))
        .withColumn("_blocks", F.expr(f"shard_size div {block_words}"))
        .withColumn("_stride", F.element_at(F.array(*[F.lit(x) for x in STRIDES]), (F.pmod(shift, F.lit(len(STRIDES))) + 1).cast("int")).cast("long"))
        .withColumn("_shift", F.pmod(shift, F.greatest(F.col("_blocks"), F.lit(1))))
        .select("source_id", "shards", "shard", "_copies", "_full", "_part", "_blocks", "_stride", "_shift")
    )
    inside = Window.partitionBy("source_id", "shards", "shard").orderBy("_h", "doc_id", "text_hash", "repeat")
    placed = dealt.withColumn("begin", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    out = placed.join(quotas, ["source_id", "shards", "shard"]).withColumn("spans", _overlaps(block_words))
    taken = F.col("_copies") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"), F.col("_copies").alias("copies"), "spans")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each text as often as it is taken
    whole, and once more the taken words of a partly taken one. Untaken documents go.

    Repeated rows keep their own decisions: they are told apart by number.
    """
    decided = mix(docs, **options).filter("taken > 0").select("doc_id", "source", "text_hash", "copies", "spans")
    decided = materialize(decided, "mix-plan")
    key = ["doc_id", "source", "text_hash"]
    rows = apart(docs, "doc_id", "source", "text").withColumn("text_hash", F.xxhash64("text"))
    if decided.groupBy(*key).count().filter("count > 1").limit(1).count() > 0:
        rows = rows.withColumn("no", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
        decided = decided.withColumn("no", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies"), F.desc(F.size("spans")), "spans")))
        key = [*key, "no"]
    on = None
    for k in key:
        same = rows[k].eqNullSafe(decided[k])
        on = same if on is None else on & same
    joined = rows.join(decided, on).select("row", rows["doc_id"], rows["source"], "text", "copies", "spans")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = lambda own: F.array_join(F.flatten(F.transform(F.col("spans"), lambda s: F.slice(own, (s["start"] + 1).cast("int"), s["words"].cast("int")))), "")
    part = F.element_at(F.transform(F.array(pieces), cut), 1)  # a lambda's variable: the text is split once, not for every span
    whole = F.when(F.col("copies") > 0, F.array_repeat("text", F.col("copies").cast("int"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(whole, F.when(F.size("spans") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    flat = joined.select("row", "doc_id", "source", F.explode(texts).alias("made"))
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("made")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("made").cast(docs.schema["n_chars"].dataType)
    return flat.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])

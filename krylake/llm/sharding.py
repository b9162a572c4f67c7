"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. What propagates is not a document but the number of a text's
copies in a shard: in each round every text looks at where its copies are, and those elsewhere move
towards the shard that holds most, as far as the free quota of that shard allows. Documents without
links move for others: they fill what the linked ones leave free, so that in the end the shards'
row counts differ by one at most. Ranks are taken over salted parts, so neither a text that a third
of all rows share nor a shard is ever in one task.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from krylake.llm.common import forget, hot_keys, ranked, split_join, table, written

ROUND_ROWS = 100_000  # rows of a key that one window holds at most, about
RUN = 1000  # copies of a text that stay together when ranks are dealt out


def quota(shard: Column, rows: int, shards: int) -> Column:
    """Rows that a shard has in the end: the first rows % shards shards have one more."""
    return F.lit(rows // shards) + (shard < rows % shards).cast("long")


def propagated(state: DataFrame, rows: int, shards: int, rounds: int) -> DataFrame:
    """state (key, shard, n): where the copies of each text are; returns the same once none wants to move, or after `rounds` rounds of moves."""
    state = written(state)
    for i in range(rounds):
        top = state.groupBy("key").agg(F.max(F.struct("n", F.xxhash64("key", "shard").alias("h"), "shard")).alias("t"), F.count("*").alias("at")).filter("at > 1").select("key", F.col("t.shard").alias("target"))
        wishes = state.join(top, "key").filter("shard <> target")
        if wishes.isEmpty():
            break
        loads = state.groupBy("shard").agg(F.sum("n").alias("load"))
        left = wishes.groupBy("shard").agg(F.sum("n").alias("left"))
        asked = wishes.groupBy(F.col("target").alias("shard")).agg(F.sum("n").alias("asked"))
        # a shard a row: the share of what is asked of it that it has room for, counting what wants to leave as gone
        room = asked.join(loads, "shard", "left").join(left, "shard", "left").select(F.col("shard").alias("target"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (quota(F.col("shard"), rows, shards) - F.coalesce("load", F.lit(0)) + F.coalesce("left", F.lit(0))) / F.col("asked"))).alias("share"))
        room = written(room)
        if room.filter("share > 0").isEmpty():  # what still wishes to move finds no room
            break
        # whole rows move: the fraction left moves or stays by a hash
        part = F.col("n") * F.col("share")
        chance = F.pmod(F.xxhash64("key", "shard", F.lit(i)), F.lit(1 << 20)) / F.lit(1 << 20)
        moves = wishes.join(F.broadcast(room), "target").withColumn("m", (F.floor(part) + (chance < part - F.floor(part)).cast("long")).cast("long")).filter("m > 0")
        moves = moves.select("key", "shard", (-F.col("m")).alias("n")).unionByName(moves.select("key", F.col("target").alias("shard"), F.col("m").alias("n")))
        after = written(state.unionByName(moves).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        forget(state)
        state = after
    return state


def shard_rows(docs: DataFrame, shards: int = 24, rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs` (doc_id, text; others are ignored).

    Law `rows`: the shards' row counts are at most one apart. A null text is empty, size 8, and equal
    to no text but null ones and empty ones. Rows with a null or repeated doc_id are rows of their own.
    Labels propagate until none wants to move, `rounds` rounds at most. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    base = written(base.withColumn("row", F.monotonically_increasing_id()))
    rows = base.count()
    salts = max(64, -(-rows // ROUND_ROWS))
    copies = written(base.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"))
    told = written(split_join(base.select("row", "key"), copies, "key", hot_keys(base, "key"), "left"))
    linked = written(ranked(told.filter("copies IS NOT NULL").select("row", "key"), ["key"], "row", "nth", salts))
    # a text with more copies than a shard holds has to be cut whatever it does: it takes the roomiest shards when the others have settled
    sizes, begin, hot = [rows // shards + (s < rows % shards) for s in range(shards)], 0, []
    for r in copies.filter(F.col("copies") > max(1, rows // shards)).orderBy(F.desc("copies"), "key").collect():  # fewer than `shards`, or than 2 * shards rows in all
        hot.append((bytes(r["key"]), begin))
        begin += r["copies"]
    large = F.broadcast(docs.sparkSession.createDataFrame(hot, "key binary, begin long"))
    linked = linked.join(large, "key", "left")
    last = linked.filter("begin IS NOT NULL").select("row", (F.col("begin") + F.col("nth")).alias("nth"))
    linked = linked.filter("begin IS NULL").select("row", "key", "nth")
    first = linked.groupBy("key", F.pmod(F.xxhash64("key", F.pmod("nth", F.lit(shards))), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    state = propagated(first, rows, shards, rounds)
    # a text's copies in the order of their ranks go to its shards in turn; at most `shards` entries a text
    upto = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    spans = written(state.withColumn("end", F.sum("n").over(upto)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("spans")))
    group, run_of = F.struct("key", "nth"), F.xxhash64("key", F.floor(F.col("nth") / RUN))
    placed_in = split_join(linked, spans, "key", hot_keys(linked, "key"))
    wished = placed_in.select("row", group.alias("group"), run_of.alias("run"), F.filter("spans", lambda s: s["end"] > F.col("nth"))[0]["shard"].alias("shard"))
    # what a shard has too much of are whole groups, which move on together
    placed = written(ranked(wished, ["shard"], "group", "place", salts, by=F.col("run")).withColumn("stays", F.col("place") < quota(F.col("shard"), rows, shards)))
    # the rest fills up the shards, the roomiest first: large texts in one run each, whole groups, rows without links
    loads = {r["shard"]: r["n"] for r in placed.filter("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    room = [n - loads.get(s, 0) for s, n in enumerate(sizes)]
    order = sorted(range(shards), key=lambda s: (-room[s], s))
    bounds = [sum(room[s] for s in order[: i + 1]) for i in range(shards)]
    over = placed.filter("NOT stays").count()
    free = last.unionByName(ranked(told.filter("copies IS NULL").select("row"), [], "row", "nth", salts).select("row", (F.col("nth") + begin + over).alias("nth")))
    if over:
        free = free.unionByName(ranked(placed.filter("NOT stays"), [], "group", "at", salts, by=F.col("run")).select("row", (begin + F.col("at")).alias("nth")))
    nth_shard = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("nth")))
    filled = free.select("row", F.element_at(F.array(*map(F.lit, order)), nth_shard + 1).alias("shard"))
    assigned = placed.filter("stays").select("row", "shard").unionByName(filled)
    full = base.join(assigned, "row").withColumn("order", F.struct("doc_id", "row"))
    out = ranked(written(full), ["shard"], "order", "slot", salts)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """links, cut, least: pairs of documents with equal texts as stars, those whose ends lie in different shards, and the fewest that any assignment of such sizes cuts.

    assigned: what shard_rows gives for docs, doc_ids not repeated."""
    keys = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    sizes = assigned.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n").alias("room"))
    per = keys.join(assigned, "doc_id").groupBy("key", "shard").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("in_shards"))
    room = F.lit((sizes.first()["room"]) or 1)
    return per.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("in_shards") - 1).alias("cut"), F.sum(F.ceil(F.col("n") / room) - 1).alias("least"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))

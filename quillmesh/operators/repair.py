"""Repair of relations that stand for nothing: planned from evidence, confirmed by a digest, applied only if it still holds.

Objects may list related ids that no typed link stands behind. They may be cleared only in a space that ingests alone wrote, as
what was remembered by hand must stay. The plan tells what would be cleared, and its digest covers the space's kind, the ids
that were confirmed and every pair; who applies it names the digest that was seen.

The digest is a hash of sums: each pair is hashed on its own and the hashes' words are added, so that a space with any number of
pairs is digested with partial sums and no list of them is ever gathered.

Edge cases: an id listed twice is cleared twice and counts twice; ids that name no entity or concept of the space (dangling
ones, questions) are kept; a null list lists nothing; order is kept; spaces without records are unknown; an object that lists
itself is cleared unless a link says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of a space, the actions and source types that tell them, and the exit codes of refusals.
INGEST_ONLY, MIXED, UNKNOWN = "ingest-only", "mixed", "unknown"
REMEMBER, WRITERS, BY_HAND = "remember", ("ingest", "remember"), ("agent", "conversation")
EXITS = {"kind": 2, "confirm_list": 2, "backup_exists": 2, "digest_mismatch": 3}
#: Words of 32 bits in a pair's hash.
WORDS = 8


class Refused(Exception):
    """A repair that was not done; nothing was written. reason is a key of EXITS."""

    def __init__(self, reason: str, message: str, digest: str = ""):
        super().__init__(message)
        self.reason, self.digest, self.exit_code = reason, digest, EXITS[reason]


def untagged(records: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """records (space_id, id, name, what: log or source, tag) without a tag and not among confirmed (space_id, id)."""
    bare = records.filter(F.coalesce("tag", F.lit("")) == "")
    return bare if confirmed is None else bare.join(confirmed.select("space_id", "id").distinct(), ["space_id", "id"], "left_anti")


def classified(records: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(space_id, kind, untagged, actions, source_types) of records (space_id, id, name, what: log or source, tag).

    Mixed, whatever else: a log tagged or named (first word) `remember`, or a source told by an agent or a conversation. Else
    unknown: a record without a tag that is not confirmed, or no log of an ingest. Counts are maps by tag.
    """
    tag, log = F.coalesce("tag", F.lit("")), F.col("what") == "log"
    open_ = untagged(records, confirmed).groupBy("space_id").agg(F.count("*").alias("untagged"))
    first = F.regexp_extract(F.lower("name"), r"^\s*(\S+)", 1)
    hand = F.when(log, (tag == REMEMBER) | (F.coalesce(first, F.lit("")) == REMEMBER)).otherwise(tag.isin(*BY_HAND))
    told = records.groupBy("space_id").agg(F.coalesce(F.bool_or(hand), F.lit(False)).alias("_hand"), F.coalesce(F.bool_or(log & tag.isin(*WRITERS)), F.lit(False)).alias("_wrote"))
    tags = records.filter(tag != "").groupBy("space_id", "what", tag.alias("tag")).agg(F.count("*").alias("n"))

    def counts(what: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("tag", "n")))))

    maps = tags.groupBy("space_id").agg(counts("log").alias("actions"), counts("source").alias("source_types"))  # few tags
    made = told.join(open_, "space_id", "left").join(maps, "space_id", "left").withColumn("untagged", F.coalesce("untagged", F.lit(0)))
    kind = F.when(F.col("_hand"), MIXED).when((F.col("untagged") > 0) | ~F.col("_wrote"), UNKNOWN).otherwise(INGEST_ONLY)
    none = F.create_map().cast("map<string,bigint>")
    return made.select("space_id", kind.alias("kind"), "untagged", F.coalesce("actions", none).alias("actions"), F.coalesce("source_types", none).alias("source_types"))


def items(objects: DataFrame, linked: DataFrame) -> DataFrame:
    """(space_id, object_id, clear, keep) of objects (space_id, id, outbound) that list an object of their space which no link joins with them, either way round.

    linked (space_id, x, y) are unordered pairs, x <= y. Objects with nothing to clear have no row.
    """
    pair = [F.least("id", "to").alias("x"), F.greatest("id", "to").alias("y")]
    listed = objects.select("space_id", "id", F.posexplode("outbound").alias("pos", "to"))
    known = objects.select("space_id", F.col("id").alias("to")).distinct()
    gone = listed.join(known, ["space_id", "to"], "left_semi").select("space_id", "id", "to", *pair).distinct().join(linked.select("space_id", "x", "y"), ["space_id", "x", "y"], "left_anti")
    cleared = gone.groupBy("space_id", "id").agg(F.collect_set("to").alias("_gone"))  # an object's own list, which is a row already
    told = objects.join(cleared, ["space_id", "id"])
    return told.select("space_id", F.col("id").alias("object_id"), F.filter("outbound", lambda x: F.array_contains("_gone", x)).alias("clear"), F.filter("outbound", lambda x: x.isNull() | ~F.array_contains("_gone", x)).alias("keep"))


def _sums(rows: DataFrame, key: Column) -> DataFrame:
    """(space_id, n, sums): rows counted and the words of their keys' hashes added up."""
    h = F.sha2(key, 256)
    word = [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")).cast("string") for i in range(WORDS)]
    return rows.groupBy("space_id").agg(F.count("*").alias("n"), F.concat_ws(",", *word).alias("sums"))


def digest(kinds: DataFrame, plan: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(space_id, kind, cleared, digest) of kinds (space_id, kind) and plan (space_id, object_id, clear): one for the same kind, confirmed ids and pairs, in whatever order.

    A pair is the JSON of its two ids, so that no two pairs are written alike.
    """
    pairs = plan.select("space_id", "object_id", F.explode("clear").alias("to"))
    made = kinds.join(_sums(pairs, F.to_json(F.array("object_id", "to"))).withColumnRenamed("n", "cleared"), "space_id", "left")
    if confirmed is None:
        made = made.withColumns({"_n": F.lit(0), "_s": F.lit("")})
    else:
        own = _sums(confirmed.select("space_id", "id").distinct(), F.to_json(F.array("id")))
        made = made.join(own.select("space_id", F.col("n").alias("_n"), F.col("sums").alias("_s")), "space_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = F.concat_ws("|", "kind", number("_n"), F.coalesce("_s", F.lit("")), number("cleared"), F.coalesce("sums", F.lit("")))
    return made.select("space_id", "kind", F.coalesce("cleared", F.lit(0)).cast("long").alias("cleared"), F.sha2(text, 256).alias("digest"))

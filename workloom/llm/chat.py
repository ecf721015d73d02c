"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often store a conversation again after every turn. Each turn gets a rolling hash of the
turns up to it: the exclusive or of hashes of (position, role, text). Conversations are cut into blocks of
turn numbers: positions and hashes run within a block, and one row per block carries on what came before it, so
that no task holds a conversation. A conversation whose whole hash is a proper prefix hash of another one is absorbed
by an anti-join; equal conversations are one. Only what is left is rendered, long conversations in parts.

Texts are not moved until the last step; joins and groups see hashes and positions.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers of a block; bytes after which a rendered conversation goes on in another row.
BLOCK_TURNS = 1024
PART_BYTES = 64 << 20
_PLACE = ["conv", "block"]


def _blocks(turns, part_bytes):
    """``conv, block, before, n_turns, part, alone``: turns before a block, turns of its conversation, rendered part it is
    in, and whether it is the only block."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0)) + F.lit(32))
    counts = turns.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    conv = Window.partitionBy("conv")
    earlier = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return counts.select(*_PLACE, so_far("n").alias("before"), F.sum("n").over(conv).alias("n_turns"),
                         (F.count(F.lit(1)).over(conv) == 1).alias("alone"), F.floor(so_far("bytes") / F.lit(part_bytes)).cast("int").alias("part"))


def prefix_hashes(turns, blocks):
    """``conv, place, n_turns, hash_a, hash_b``: for every turn the hashes of the conversation up to it.

    Turns are ordered by turn number, nulls last, then role, nulls first, and text; the place counts from 1.
    """
    slim = turns.select(*_PLACE, "turn", "role", _text_hash().alias("text_hash")).join(blocks.select(*_PLACE, "before", "n_turns"), _PLACE)
    order = Window.partitionBy(*_PLACE).orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text_hash"))
    placed = slim.withColumn("place", F.col("before") + F.row_number().over(order))
    hashed = placed.select(*_PLACE, "place", "n_turns", *[
        F.xxhash64(F.lit(seed), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text_hash")).alias(c) for seed, c in ((11, "a"), (23, "b"))])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = hashed.groupBy(*_PLACE).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = whole.select(*_PLACE, *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"earlier_{c}") for c in "ab"])
    upto = Window.partitionBy(*_PLACE).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.join(carried, _PLACE).select(
        "conv", "place", "n_turns", *[F.col(f"earlier_{c}").bitwiseXOR(F.bit_xor(c).over(upto)).alias(f"hash_{c}") for c in "ab"])


def _text_hash():
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def maximal_conversations(hashes):
    """``conv, n_copies`` of every conversation that is no proper prefix of another one.

    Equal conversations keep the smallest id and are counted in ``n_copies``.
    """
    key = ["hash_a", "hash_b", "place"]
    whole = hashes.filter("place = n_turns").groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    proper = hashes.filter("place < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv", "n_copies")


def render_turn(role, text):
    """One turn in ChatML. Control tokens inside a text or a role lose their bars and are plain text."""
    def plain(x):
        return F.regexp_replace(F.coalesce(x, F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")

    return F.concat(F.lit(START), plain(role), F.lit("\n"), plain(text), F.lit(END), F.lit("\n"))


def format_chats(conversations, conv_id="conv_id", turn="turn", role="role", text="text", part_bytes=PART_BYTES):
    """``conv_id, part, n_turns, n_copies, text`` of the maximal conversations.

    A conversation is one row, part 0, unless it exceeds ``part_bytes``: then it goes on in further rows, cut between
    blocks of turns. A null role or text is rendered as empty. Rows with a null conversation id are one conversation of
    their own, with a null id. Repeated rows are repeated turns. Turns of equal number, or without one, are in one block,
    however many. Further columns are ignored.
    """
    turns = conversations.select(F.struct(F.col(conv_id)).alias("conv"), F.col(turn).cast("long").alias("turn"),
                                 F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # Turns without a number come last.
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK_TURNS)), F.lit((1 << 63) - 1)))
    scratch = Scratch(conversations.sparkSession, "chats")
    blocks = scratch.keep(_blocks(turns, part_bytes), "blocks")
    kept = maximal_conversations(scratch.keep(prefix_hashes(turns, blocks), "hashes"))
    rendered = turns.select(*_PLACE, F.struct(F.col("turn").isNull().alias("last"), "turn", "role", _text_hash().alias("h"),
                                              render_turn(F.col("role"), F.col("text")).alias("body")).alias("piece"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["body"]), "")
    about = ["conv", "part", "n_turns", "n_copies"]
    wanted = blocks.join(kept, "conv").select("block", "alone", *about)
    # Texts are moved once, by block; only those of conversations of several blocks meet a second time.
    texts = rendered.join(wanted, _PLACE).groupBy("block", "alone", *about).agg(body.alias("body"))
    several = texts.filter("NOT alone").withColumn("piece", F.struct("block", "body")).groupBy(*about).agg(body.alias("text"))
    texts = texts.filter("alone").select(*about, F.col("body").alias("text")).unionByName(several)
    return texts.select(F.col(f"conv.{conv_id}").alias("conv_id"), "part", "n_turns", "n_copies", "text")

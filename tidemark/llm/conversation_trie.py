"""Prefix trie of conversations, built as a burst trie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, new_folder, stage
from .ordered import running

#: Rows of turns that a container holds at most; a larger one bursts.
CONTAINER = 1_000
#: Conversations of one number that share opening turns, and how many turns they may share.
FAMILY = 20
OPENINGS = 4
#: Turns of a conversation, and parts of a head, that one key of a join holds.
BLOCK = 4096
SALTS = 32
#: Rows of several containers that are swept together.
SWEPT = 50_000

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"{NODES}, top boolean, p1 long, p2 long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """Each turn with a 128-bit id of role and text, in two halves, and the words of its text; null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.xxhash64(F.lit(1), role, F.lit("\0"), text).alias("t1"),
        F.xxhash64(F.lit(2), text, F.lit("\0"), role).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def rebuilt_turns(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation after it was rebuilt, as rows (conv_id, depth from 1, t1, t2, words), and all ids.

    A conversation c opens with the first h turns of conversation c - c % 20, h = crc32(c) % 4, and goes on with its own after
    the first h. Its turns are numbered by turn (null first), then role and text.
    """
    asc = [F.col(c).asc() for c in ("role", "text")]
    kept = [F.col(c) for c in ("conv_id", "t1", "t2", "words")]
    own = running(turn_ids(conversations), "conv_id", ["conv_id", "turn"], asc, [*kept, F.lit(1).cast("long").alias("n")], ("n",), (), folder)
    own = own.select(*kept, (F.col("run_n") - 1).alias("at"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % OPENINGS).alias("h")
    ids = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).select("conv_id", shared, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    # at most OPENINGS - 1 turns of a base meet the conversations of its family
    opening = own.where((F.col("at") < OPENINGS - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "t1", "t2", "words", "at")
    lent = ids.join(opening, "base").where("at < h").select("conv_id", "at", "t1", "t2", "words")
    short = lent.groupBy("conv_id").agg(F.count("*").alias("lent"))
    shift = ids.join(short, "conv_id", "left").select("conv_id", (F.coalesce("lent", F.lit(0)) - F.col("h")).alias("shift")).where("shift != 0")
    rest = own.withColumn("h", shared).where("at >= h")
    # few conversations have a base shorter than what they share: the others keep their numbers
    moved = rest.join(shift, "conv_id", "left").select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "t1", "t2", "words")
    turns = lent.unionByName(moved).select("conv_id", (F.col("at") + 1).alias("depth"), "t1", "t2", "words")
    return turns, ids.select("conv_id")


def _by_conversation(rows: DataFrame, about: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (conv_id, depth, ...) joined with one row a conversation, in blocks of depths, so that a long one is not one key.

    `about` holds `len`, its greatest depth.
    """
    spread = about.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / BLOCK))))
    return rows.withColumn("block", F.floor(F.col("depth") / BLOCK)).join(spread, ["conv_id", "block"], how).drop("block")


def _by_node(rows: DataFrame, nodes: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows joined with one row a node; a node's rows are dealt to SALTS keys."""
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")


def sweep(suffixes: list[tuple[bytes, int, list[int]]], above: int) -> list[list]:
    """The nodes of one container below a head of depth `above`, in one pass over its sorted suffixes.

    A suffix is (turn ids of 16 bytes each in one string, conversation, words of each turn). What neighbours have in common
    says which nodes close; a node closes after its children, whose parent it then names. The container's own top comes last.
    """
    suffixes.sort(key=lambda s: s[:2])
    path: list[list] = []  # open nodes: smallest member, members, children, leaves, saved, words, members that end here, rows of the children
    rows: list[list] = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            least, members, children, leaves, saved, words, ends, below = path.pop()
            for row in below:
                row[2] = least
            ended = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _EMPTY
            row = [least, above + len(path) + 1, None, members, children, leaves or 1, saved + (members - 1) * words, ended]
            rows.append(row)
            if path:
                up = path[-1]
                up[0], up[1], up[2], up[3], up[4] = min(up[0], least), up[1] + members, up[2] + 1, up[3] + row[5], up[4] + row[6]
                up[7].append(row)

    before = b""
    for ids, conv, words in suffixes:
        same = 0
        while same < len(path) and before[16 * same : 16 * same + 16] == ids[16 * same : 16 * same + 16]:
            same += 1
        close(same)
        for k in range(len(path), len(words)):
            path.append([conv, 0, 0, 0, 0, words[k], [], []])
        end = path[-1]
        end[0], end[1] = min(end[0], conv), end[1] + 1
        end[6].append(conv)
        before = ids
    close(0)
    return rows


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: rows sorted by container, conversation and depth; what it holds at a time is one container and some nodes."""
    out: list[list] = []
    held: list[tuple[bytes, int, list[int]]] = []
    open_container, open_conv, head = None, None, (0, 0, 0)

    def finish() -> None:
        rows = sweep(held, head[0])
        for row in rows:
            row += [False, None, None]
        rows[-1][8:] = [True, head[1], head[2]]
        out.extend(rows)
        held.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _SWEPT.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return batch

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        get = {f: batch.column(k).to_numpy(zero_copy_only=False) for k, f in enumerate(batch.schema.names)}
        ids = np.stack([get["t1"], get["t2"]], 1).astype("<i8").tobytes()
        words = get["words"].tolist()
        same = (get["conv_id"][1:] == get["conv_id"][:-1]) & (get["k1"][1:] == get["k1"][:-1]) & (get["k2"][1:] == get["k2"][:-1])
        begins = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]]).tolist()
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            container, conv = (int(get["k1"][a]), int(get["k2"][a])), int(get["conv_id"][a])
            if container != open_container:
                if held:
                    finish()
                    if len(out) >= SWEPT:
                        yield flush()
                open_container, open_conv, head = container, None, (int(get["depth"][a]) - 1, int(get["p1"][a]), int(get["p2"][a]))
            if conv == open_conv:  # the conversation goes on from the batch before
                held[-1] = (held[-1][0] + ids[16 * a : 16 * b], conv, held[-1][2] + words[a:b])
            else:
                held.append((ids[16 * a : 16 * b], conv, words[a:b]))
            open_conv = conv
    if held:
        finish()
    if out:
        yield flush()


def _end_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the sorted members that end at each head, as they stream by."""
    node, digest, done = None, None, []
    for batch in batches:
        for x1, x2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (x1, x2) == node:
                digest.update(b",%d" % conv)
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (x1, x2), hashlib.sha256(b"%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["x1", "x2", "ends_sha256"])
            done = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], ["x1", "x2", "ends_sha256"])


def prefix_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations: the columns of NODES.

    A burst trie: a node with more than `container` rows of turns at and below it is a trie head, the others hang below a
    head in containers of suffixes, which are dealt to shards, sorted and swept. A container bursts by next turn id as
    long as it is too large; the rows below every beginning are counted by its hash, so all bursts are known after one
    aggregate. What heads need of the containers and heads below them is a sum over their members: the words saved, and
    one entry of each container and each owned head at its smallest member.

    Turns are compared by 128-bit hashes of role and text. Null role or text is empty; rows without a conv_id are left
    out; rows of equal turn come in the order of role and text, and repeated rows are turns of their own. A conversation
    may be of any length: no step holds one whole, but a container that it fills alone. An empty table gives no row.
    Other columns are not looked at.
    """
    spark = conversations.sparkSession
    folder = new_folder(spark)
    turns, ids = rebuilt_turns(conversations, folder)
    ids = stage(ids, folder)
    hashed = turns.withColumns({"n": F.lit(1).cast("long"), "z1": F.xxhash64(F.lit(3), "t1", "t2", "depth"), "z2": F.xxhash64(F.lit(4), "t2", "t1", "depth")})
    kept = [F.col(c) for c in ("conv_id", "depth", "t1", "t2", "words", "z1", "z2", "n")]
    prefixes = running(hashed, "conv_id", ["conv_id", "depth"], [], kept, ("n", "words"), ("z1", "z2"), folder).select(
        "conv_id", "depth", "t1", "t2", "words",
        (F.col("run_words") - F.col("words")).alias("before"),
        F.col("run_z1").alias("x1"), F.col("run_z2").alias("x2"),
        F.col("run_z1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("run_z2").bitwiseXOR(F.col("z2")).alias("p2"),
    )
    rows = stage(_by_conversation(prefixes, prefixes.groupBy("conv_id").agg(F.max("depth").alias("len"))), folder)

    # heads: where more rows lie at and below a beginning than a container holds
    burst = rows.groupBy("x1", "x2").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("weight")).where(F.col("weight") > container)
    marked = _by_node(rows, burst.select("x1", "x2", F.lit(True).alias("burst")), ["x1", "x2"], "left")
    inside = F.when(F.col("burst"), F.col("depth"))
    routes = marked.groupBy("conv_id").agg(
        F.max("len").alias("len"),
        F.coalesce(F.max(inside), F.lit(0).cast("long")).alias("g"),
        F.coalesce(F.max(F.when(F.col("burst"), F.col("before") + F.col("words"))), F.lit(0).cast("long")).alias("head_words"),
        F.min_by(F.when(F.col("burst").isNull(), F.struct("x1", "x2")), F.when(F.col("burst").isNull(), F.col("depth"))).alias("key"),
    )
    routes = stage(routes, folder)
    tagged = stage(_by_conversation(rows.drop("len"), routes.select("conv_id", "len", "g", "head_words", F.col("key.x1").alias("k1"), F.col("key.x2").alias("k2"))), folder)

    shards = tagged.where("depth > g").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id", "depth")
    swept = stage(shards.select("k1", "k2", "conv_id", "depth", "t1", "t2", "words", "p1", "p2").mapInArrow(_swept, _SWEPT), folder)
    tops = swept.where("top")

    # heads from their members; the root is one, and every conversation its member
    zero = F.lit(0).cast("long")
    at_root = ids.join(routes, "conv_id", "left").select(
        "conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("before"), zero.alias("x1"), zero.alias("x2"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        F.coalesce("len", zero).alias("len"), F.coalesce("g", zero).alias("g"), F.coalesce("head_words", zero).alias("head_words"),
    )
    members = tagged.where("depth <= g").select(at_root.columns).unionByName(at_root)
    same = [F.max(c).alias(c) for c in ("depth", "words", "before", "p1", "p2")]
    heads = stage(members.groupBy("x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same), folder)
    born = heads.where("depth > 0").select("p1", "p2").unionAll(tops.select("p1", "p2")).groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    heads = heads.join(born.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "n_children"), ["x1", "x2"], "left").fillna(0, ["n_children"])
    heads = stage(heads, folder)

    # a conversation's entries: the heads that it owns are the last of its route, and it may own the container below them
    owned = heads.groupBy("conv_id").agg(F.min_by("before", "depth").alias("own_before"), (F.max_by("n_children", "depth") == 0).cast("long").alias("own_leaf"))
    entries = owned.join(tops.select("conv_id", F.col("saved_tokens").alias("below_saved"), F.col("n_leaves").alias("below_leaves")), "conv_id", "full")
    entries = entries.join(ids.join(routes.select("conv_id", "len"), "conv_id", "left").select("conv_id", F.coalesce("len", zero).alias("reach")), "conv_id")
    met = _by_conversation(members.drop("len"), entries.withColumnRenamed("reach", "len"), "left")
    repeats = F.col("head_words") - F.col("before")
    first = F.when(F.col("own_before").isNotNull(), F.col("head_words") - F.greatest("before", "own_before")).otherwise(0)
    sums = met.groupBy("x1", "x2").agg(
        F.sum(F.coalesce("own_leaf", zero) + F.coalesce("below_leaves", zero)).alias("n_leaves"),
        F.sum(repeats - first + F.coalesce("below_saved", zero)).alias("saved_tokens"),
    )
    ends = (
        members.where("depth = len").select("x1", "x2", "conv_id").repartition("x1", "x2").sortWithinPartitions("x1", "x2", "conv_id")
        .mapInArrow(_end_digests, "x1 long, x2 long, ends_sha256 string")
    )
    owners = heads.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top_heads = (
        heads.join(sums, ["x1", "x2"]).join(ends, ["x1", "x2"], "left").join(owners, ["p1", "p2"], "left").fillna(_EMPTY, ["ends_sha256"])
    )
    # nearly all containers may hang below the root, whose owner is the smallest conversation of all
    at_top = (F.col("p1") == 0) & (F.col("p2") == 0)
    least = ids.agg(F.min("conv_id").alias("m")).first()["m"]
    below = _by_node(tops.where(~at_top).drop("parent_conv_id"), owners, ["p1", "p2"], "inner")
    columns = [c.split()[0] for c in NODES.split(", ")]
    nodes = (
        swept.where("not top").select(columns)
        .unionByName(tops.where(at_top).withColumn("parent_conv_id", F.lit(least).cast("long")).select(columns))
        .unionByName(below.select(columns))
        .unionByName(top_heads.select(columns))
    )
    result = stage(nodes)
    clear(spark, folder)
    return result

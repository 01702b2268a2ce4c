"""The trie of all conversations' prefixes, built as a burst trie.

A turn's id is a digest of its role and text with its number of words, UNIT bytes; a conversation is the string of its
turns' ids. Equal conversations are one string with a count. All strings start in one container. A container of more
than `box_turns` turns bursts: it skips what its strings have in common (the common prefix of its least and greatest
string), leaves a trie head there, and deals the strings out to one container for each next turn id; so a round costs a
pass over oversized containers only, and a head always branches. What remains is small: containers are dealt over the
shards, sorted, and swept with a stack into nodes. A head's numbers are sums over the containers and strings below it,
each of which knows the heads on its path; such sums start on the map side, so a head with very many members or children
is one row for each task.

Cases: turns are ordered by turn (null first), role and a digest of the text; null roles and texts are empty; repeated
rows are turns of their own; rows with a null conv_id are left out; an empty table has no nodes; further columns are
ignored. Texts do not leave the scan. A conversation is gathered in one task, at some 100 bytes a turn.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stage_table

UNIT = 20  # bytes of a turn id: 16 of a digest, 4 of the number of words
BOX_TURNS = 4096
MOST_HEADS = 1 << 16  # of one round; containers grow instead of more of them
ID_BITS = 12  # members are written out in blocks of 2^ID_BITS ids
WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()

SEQUENCES = "key string, seq binary, conv_id long, n long, ends string"
NODES = (
    "box string, path array<string>, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, turn_id string"
)
STEP = "array<struct<depth:long,tail:long,turn_id:string>>"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]


def turn_digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits that stand for a role and a text."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversation_turns(rows: DataFrame, group: Column | None = None) -> DataFrame:
    """(grp, conv_id, turns): each conversation's turn ids in order, 2 x UNIT hexadecimal digits a turn. Conversations of
    one group (by default each its own) come to lie in one partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORDS))), 8, "0")
    conv = F.col("conv_id").cast("long")
    units = rows.where("conv_id is not null").select(
        (conv if group is None else group).alias("grp"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.concat(turn_digest(role, text), words).alias("unit"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "role", "unit")))
    joined = F.array_join(F.transform(in_order, lambda x: x["unit"]), "")
    return units.repartition("grp").groupBy("grp", "conv_id").agg(joined.alias("turns"))


def rebuilt_conversations(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): conversation c starts with the first crc32(c) % most turns of c - c % every, in place of as many
    of its own."""
    conv, size = F.col("conv_id").cast("long"), 2 * UNIT
    own = conversation_turns(rows, conv - conv % every)
    lead = F.max(F.when(F.col("conv_id") == F.col("grp"), F.substring("turns", 1, size * (most - 1)))).over(Window.partitionBy("grp"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most * size).cast("int")
    head = F.coalesce(F.substring(lead, F.lit(1), h), F.lit(""))
    tail = F.substring(F.col("turns"), h + 1, F.greatest(F.length("turns") - h, F.lit(0)))
    return own.select("conv_id", F.concat(head, tail).alias("turns"))


def _sequences(conversations: DataFrame) -> DataFrame:
    """One row for each distinct conversation: its string, the number and the least of its members, and the digest of
    all of them. Members are joined within blocks of ids; the blocks of one string then stream through its digest."""
    block = F.shiftright("conv_id", ID_BITS)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = (
        conversations.select("conv_id", F.unhex("turns").alias("seq")).withColumn("key", F.md5("seq"))
        .groupBy("key", block.alias("block")).agg(F.first("seq").alias("seq"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), ids.alias("ids"))
    )

    def run(batches):
        now, out = None, []
        for pdf in batches:
            for key, seq, conv, n, ids in zip(pdf["key"], pdf["seq"], pdf["conv_id"].tolist(), pdf["n"].tolist(), pdf["ids"], strict=True):
                if now is None or now[0] != key:
                    if now:
                        out.append((*now[:4], now[4].hexdigest()))
                    now = [key, seq, conv, n, hashlib.sha256(ids.encode())]
                else:
                    now[3] += n
                    now[4].update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "seq", "conv_id", "n", "ends"])
            out = []
        if now:
            yield pd.DataFrame([(*now[:4], now[4].hexdigest())], columns=["key", "seq", "conv_id", "n", "ends"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInPandas(run, SEQUENCES)


def _common(a: bytes, b: bytes) -> int:
    """How many turns two strings start with alike."""
    low, high = 0, min(len(a), len(b)) // UNIT
    while low < high:
        mid = (low + high + 1) // 2
        if a[: UNIT * mid] == b[: UNIT * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _last(seq: bytes, depth: int) -> tuple[str | None, int]:
    """Digest and words of a prefix's last turn."""
    if not depth:
        return None, 0
    unit = seq[UNIT * (depth - 1) : UNIT * depth]
    return unit[:16].hex(), struct.unpack(">I", unit[16:])[0]


def _heads(batches):
    """Of each oversized container: where it branches, and the chain of nodes down to there."""
    for pdf in batches:
        out = []
        for box, path, base, low, high in pdf[["box", "path", "base", "low", "high"]].itertuples(index=False):
            depth = _common(low, high)
            last = [_last(low, d) for d in range(base, depth + 1)]
            tail, steps = 0, []
            for d in range(depth, base - 1, -1):  # tail: words of the nodes from here down to the head, without it
                tail += last[d - base][1] if d < depth else 0
                steps.append({"depth": d, "tail": tail, "turn_id": last[d - base][0]})
            out.append((box, hashlib.md5(low[: UNIT * depth]).hexdigest(), list(path), base, depth, steps, last[-1][1], tail + last[-1][1]))
        yield pd.DataFrame(out, columns=["box", "head", "path", "base", "at", "steps", "own_words", "edge_words"])


def _sweep_box(rows: list[tuple], out: list[tuple]) -> None:
    """Nodes of one container from its sorted strings (box, path, base, seq, conv_id, n, ends); the first is its top."""
    box, path, base = rows[0][:3]
    nodes, stack, before = [], [], None  # node: depth, parent, n, conv_id, children, leaves, saved, ends, turn_id, words
    for _, _, _, seq, conv, n, ends in rows:
        size = len(seq) // UNIT
        common = base - 1 if before is None else _common(before, seq)
        del stack[common - base + 1 :]
        for d in range(common + 1, size + 1):
            parent = stack[-1] if stack else -1
            if parent >= 0:
                nodes[parent][4] += 1
            stack.append(len(nodes))
            nodes.append([d, parent, 0, conv, 0, 0, 0, NO_ENDS, *_last(seq, d)])
        end = nodes[stack[-1]]
        end[2], end[3], end[7], before = n, conv, ends, seq
    for node in reversed(nodes):
        node[5] += node[4] == 0
        node[6] += (node[2] - 1) * node[9]
        if node[1] >= 0:
            up = nodes[node[1]]
            up[2] += node[2]
            up[3] = min(up[3], node[3])
            up[5] += node[5]
            up[6] += node[6]
    for k, (d, parent, n, conv, children, leaves, saved, ends, turn_id, _) in enumerate(nodes):
        out.append((box if k == 0 else None, path if k == 0 else None, conv, d, None if parent < 0 else nodes[parent][3], n, children, leaves, saved, ends, turn_id))


def _sweep(batches):
    names = [c.split(" ")[0] for c in NODES.split(", ")]
    held, out = [], []

    def frame():
        made = pd.DataFrame(out, columns=names)
        made["parent_conv_id"] = made["parent_conv_id"].astype("Int64")
        out.clear()
        return made

    for pdf in batches:
        for row in zip(pdf["box"], pdf["path"], pdf["base"].tolist(), pdf["seq"], pdf["conv_id"].tolist(), pdf["n"].tolist(), pdf["ends"], strict=True):
            if held and held[0][0] != row[0]:
                _sweep_box(held, out)
                held = []
                if len(out) > 20_000:
                    yield frame()
            held.append(row)
    if held:
        _sweep_box(held, out)
    if out:
        yield frame()


def prefix_trie(conversations: DataFrame, box_turns: int = BOX_TURNS) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turns), as conversation_turns gives them: conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that members need not repeat, in the whole
    subtree), ends_sha256 (of the members that end here) and turn_id (of the last turn; null for the root)."""
    strings = stage_table(_sequences(conversations), "sequences")
    turns = F.floor(F.octet_length("seq") / UNIT).cast("int")
    total = strings.agg(F.coalesce(F.sum(turns + 1), F.lit(0))).first()[0]
    limit = max(box_turns, total // MOST_HEADS)  # so a round has at most MOST_HEADS heads, which are broadcast
    start = F.substring("seq", F.lit(1), (UNIT * F.col("base")).cast("int"))
    live = strings.select(F.lit(hashlib.md5(b"").hexdigest()).alias("box"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("base"), "seq", "conv_id", "n", "ends")
    boxes, stops, heads = [], [], []
    while True:
        sizes = live.groupBy("box").agg(
            F.sum(turns - F.col("base") + 1).alias("size"), F.count("*").alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"),
            F.first("path").alias("path"), F.first("base").alias("base"),
        )
        over = sizes.where((F.col("size") > limit) & (F.col("rows") > 1))
        over = stage_table(over.mapInPandas(_heads, f"box string, head string, path array<string>, base int, at int, steps {STEP}, own_words long, edge_words long"), "heads")
        if over.isEmpty():
            boxes.append(live)
            break
        heads.append(over)
        few = F.broadcast(over.select("box", "head", "at"))  # at most MOST_HEADS rows of 70 bytes
        boxes.append(live.join(few, "box", "left_anti"))
        down = stage_table(live.join(few, "box").withColumn("path", F.concat("path", F.array("head"))), "burst")
        stops.append(down.where(turns == F.col("at")).select("path", "head", "conv_id", "n", "ends"))
        live = down.where(turns > F.col("at")).withColumn("base", F.col("at") + 1).withColumn("box", F.md5(start)).drop("head", "at")
    columns = ["box", "path", "base", "seq", "conv_id", "n", "ends"]
    swept = _union([b.select(*columns) for b in boxes]).repartition("box").sortWithinPartitions("box", "seq").mapInPandas(_sweep, NODES)
    if not heads:
        return swept.select(*COLUMNS)
    swept = stage_table(swept, "swept")
    known = stage_table(_head_sums(_union(heads), _union(stops), swept.where("box is not null")), "sums")
    above = known.select(F.col("head").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    tops = swept.where("box is not null").withColumn("up", F.element_at("path", -1)).drop("parent_conv_id").join(above, "up", "left")
    chain = known.withColumn("up", F.try_element_at("path", F.lit(-1))).join(above, "up", "left").select("*", F.explode("steps").alias("s"))
    here = F.col("s.depth") == F.col("at")
    chain = chain.select(
        "conv_id", F.col("s.depth").alias("depth"), F.when(F.col("s.depth") == F.col("base"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(here, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("s.tail")).alias("saved_tokens"),
        F.when(here, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"), F.col("s.turn_id").alias("turn_id"),
    )
    return _union([swept.where("box is null").select(*COLUMNS), tops.select(*COLUMNS), chain.select(*COLUMNS)])


def _head_sums(heads: DataFrame, stops: DataFrame, tops: DataFrame) -> DataFrame:
    """Heads with conv_id, n_convs, n_children, n_leaves, saved_tokens and ends: first what containers and ending strings
    give to all heads on their path, then what each head's own chain gives to the heads above it."""
    none = F.lit(0).cast("long")
    boxes = tops.select(F.element_at("path", -1).alias("own"), F.explode("path").alias("head"), "conv_id", F.col("n_convs").alias("n"), "n_leaves", "saved_tokens")
    boxes = boxes.select("head", "conv_id", "n", "n_leaves", "saved_tokens", (F.col("head") == F.col("own")).cast("long").alias("child"), F.lit(None).cast("string").alias("ends"))
    ended = stops.select(F.col("head").alias("own"), F.explode("path").alias("head"), "conv_id", "n", "ends")
    ended = ended.select("head", "conv_id", "n", none.alias("n_leaves"), none.alias("saved_tokens"), none.alias("child"), F.when(F.col("head") == F.col("own"), F.col("ends")).alias("ends"))
    nested = heads.where(F.size("path") > 0).select(
        F.element_at("path", -1).alias("head"), F.lit(None).cast("long").alias("conv_id"), none.alias("n"), none.alias("n_leaves"), none.alias("saved_tokens"),
        F.lit(1).cast("long").alias("child"), F.lit(None).cast("string").alias("ends"),
    )
    sums = _union([boxes, ended, nested]).groupBy("head").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("boxed"), F.max("ends").alias("ends"),
    )
    found = stage_table(heads.join(sums, "head"), "heads")
    again = F.col("n_convs") - 1
    below = found.select(F.explode("path").alias("head"), (again * F.col("edge_words")).alias("chained")).groupBy("head").agg(F.sum("chained").alias("chained"))
    saved = F.col("boxed") + F.coalesce("chained", F.lit(0)) + again * F.col("own_words")
    return found.join(below, "head", "left").withColumn("saved_tokens", saved).drop("boxed", "chained")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_texts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null for the root)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = rows.select(role.alias("role"), text.alias("text")).withColumn("turn_id", turn_digest(F.col("role"), F.col("text")))
    said = said.groupBy("turn_id").agg(F.first(F.struct("role", "text")).alias("said"))
    return nodes.join(said, "turn_id", "left").select(*nodes.columns, "said.role", "said.text")

"""Repairing the structure of conversations by weighted CYK parsing.

A conversation's role initials should form `(s?(ua)+)?`. Its rows are parsed by a grammar in Chomsky normal form whose
nonterminals are pairs (p, q) of places in that pattern: (p, q) -> (p, r) (r, q) for every r, and terminal rules turn one
row, kept, given another role or deleted, into the step that it takes from p to q. Insertions are closed over at each gap.
A span's cell holds the least (cost, audit) of each nonterminal; spans are combined bottom-up by length. Since every
place r is allowed between two halves, all splits of a span give the same cell (tested), so each span is split once, in the
middle, and a conversation of n rows takes n - 1 combinations. Audits of equal cost over the same rows never are
prefixes of each other, so least audits of two halves make the least audit of the whole.

Texts pass through Spark twice: as digests, from which each conversation's faults and audit come, and as texts, which
stream beside their audit and are never held together. Both streams are sorted by conversation.

Cases: rows are ordered by turn (null first), role and a digest of the text; null roles and texts are one space; rows with a
null conv_id are left out; a conversation without rows has zeros, an empty audit and nothing repaired; roles with other
initials are never legal; repeated rows are duplicates; an empty table gives an empty result; further columns are
ignored. A conversation takes some 100 bytes a turn in one task, however long its texts are.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import small_batches

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
#: places in the pattern: before anything, after s, after u, after a; and the places where it may end
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
PLACES, ENDS = range(4), (0, 3)
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role that an insertion or another role must have there
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
CELLS = 50_000  # cells of short spans that a worker remembers
CACHED = 16  # rows of such a span

Cell = dict[tuple[int, int], tuple[int, str]]
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, pos long, edit string, role string, text string"


def combine(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in a.items():
        for q in PLACES:
            if (more := b.get((r, q))) is not None:
                found = (cost + more[0], audit + more[1])
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def insertions() -> Cell:
    """What any number of inserted rows can do."""
    one: Cell = {(p, p): (0, "") for p in PLACES} | {(p, STEPS[p, NEXT[p]]): (INSERT, "I") for p in PLACES}
    out = one
    while (more := combine(out, one)) != out:
        out = more
    return out


GAP = insertions()


def row_cell(kind: str) -> Cell:
    """What one row can do, and insertions after it. kind: x for a row that must go, else its initial (o for other
    ones), in capitals if it is truncated."""
    out: Cell = {(p, p): (DELETE, "D") for p in PLACES}
    if kind != "x":
        extra, initial = (TRUNCATED if kind.isupper() else 0), kind.lower()
        for p in PLACES:
            out[p, STEPS[p, NEXT[p]]] = (REROLE + extra, "R")
        for p in PLACES:
            if (p, initial) in STEPS:
                out[p, STEPS[p, initial]] = (KEEP + extra, "K")
    return combine(out, GAP)


_cells: dict[str, Cell] = {kind: row_cell(kind) for kind in "xsuaoSUAO"}


def span_cell(kinds: str) -> Cell:
    """The cell of a span of rows, from spans of 1, 2, 4, ... rows."""
    cells, size, n = [_cells[k] for k in kinds], 1, len(kinds)
    while len(cells) > 1:
        merged = []
        for k in range(0, len(cells) - 1, 2):
            if 2 * size > CACHED:
                merged.append(combine(cells[k], cells[k + 1]))
                continue
            name = kinds[k * size : min(n, (k + 2) * size)]
            if (known := _cells.get(name)) is None:
                if len(_cells) > CELLS:
                    for old in [x for x in _cells if len(x) > 1]:
                        del _cells[old]
                known = _cells[name] = combine(cells[k], cells[k + 1])
            merged.append(known)
        cells, size = merged + cells[len(merged) * 2 :], 2 * size
    return cells[0]


def parse(kinds: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation with rows of these kinds."""
    whole = combine(GAP, span_cell(kinds)) if kinds else GAP
    return min(whole[0, q] for q in ENDS if (0, q) in whole)


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it lacks its end."""
    body = F.btrim(text, F.lit(BLANKS))
    return body == "", ~F.right(body, F.lit(1)).isin(".", "!", "?")


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


class _Faults:
    """Faults of one conversation, whose rows come in order."""

    def __init__(self, conv: int):
        self.conv, self.kinds, self.count, self.illegal, self.initial = conv, [], {"b": 0, "d": 0, "t": 0, "k": 0}, 0, None
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, fault: str, initial: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        self.count[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        own = initial if initial in ("s", "u", "a") else "o"
        self.kinds.append("x" if fault in "bd" else own.upper() if fault == "t" else own)

    def report(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.distinct
        return self.conv, gaps, self.count["b"], self.count["d"], self.count["t"], self.illegal, *parse("".join(self.kinds))


def _rows(rows: DataFrame) -> DataFrame:
    plain = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *plain).withColumn("digest", F.md5("text"))


def audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conv_id in ids or rows."""
    said = _rows(rows)
    blank, cut = faults(F.col("text"))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    said = said.select("conv_id", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"))
    said = said.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    kind = F.when(F.col("blank"), "b").when(F.col("again"), "d").otherwise(F.when(F.col("cut"), "t").otherwise("k"))
    said = said.select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", kind.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).unionByName(rows.select(F.col("conv_id").cast("long").alias("conv_id")))
    every = every.where("conv_id is not null")  # with repeats, which the stream passes over
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "string"), ("fault", "string"), ("initial", "string"))]
    stream = said.unionByName(every.select("conv_id", F.lit(0).alias("part"), *nothing))
    stream = stream.withColumns({"at": F.coalesce("turn", F.lit(0)), "placed": F.col("turn").isNotNull()})

    def run(batches):
        now, out = None, []
        for pdf in batches:
            columns = [pdf[c].tolist() for c in ("conv_id", "part", "at", "placed", "fault", "initial")]
            for conv, part, turn, placed, fault, initial in zip(*columns, strict=True):
                if part:
                    now.add(turn if placed else None, fault, initial)
                    continue
                if now and now.conv == conv:
                    continue
                if now:
                    out.append(now.report())
                now = _Faults(conv)
            yield pd.DataFrame(out, columns=_names(REPORT))
            out = []
        if now:
            yield pd.DataFrame([now.report()], columns=_names(REPORT))

    order = ["conv_id", "part", "turn", "role", "digest"]
    stream = stream.repartition("conv_id").sortWithinPartitions(*order)
    return stream.select("conv_id", "part", "at", "placed", "fault", "initial").mapInPandas(run, REPORT)


def _edited(batches):
    """(report row, edit, role, text) of each repaired turn, and (report row, None, None, None) before a conversation's
    first; rows of a sorted stream, in which a conversation's report comes before its rows."""
    head, audit, at, place = None, "", 0, 0

    def inserted():
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            role = NEXT[place]
            place, at = STEPS[place, role], at + 1
            yield head, "I", NAMES[role], ""

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.part == 0:
                yield from inserted()
                head, audit, at, place = row, row.audit, 0, 0
                yield head, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            initial = row.role[:1] if edit == "K" else NEXT[place]
            place = STEPS[place, initial]
            yield head, edit, row.role if edit == "K" else NAMES[initial], row.text
    yield from inserted()


def _beside_audits(rows: DataFrame, report: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    nothing = F.lit(None).cast("string")
    said = _rows(rows).select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text", nothing.alias("numbers"), nothing.alias("audit"))
    numbers = F.concat_ws(",", *(F.col(c).cast("string") for c in _names(REPORT)[1:-1]))
    heads = report.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("digest"), nothing.alias("text"),
        numbers.alias("numbers"), "audit",
    )
    return said.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): what the audits in report make of rows; pos counts from 0."""

    def run(batches):
        out, pos = [], 0
        for head, edit, role, text in _edited(batches):
            if edit is None:
                pos = 0
                continue
            out.append((head.conv_id, pos, edit, role, text))
            pos += 1
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv_id", "pos", "edit", "role", "text"])
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "pos", "edit", "role", "text"])

    return _beside_audits(rows, report).mapInPandas(run, TURNS)


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conv_id of ids or rows with its faults, cost, audit and repaired_sha256, the digest of its repaired
    `role:text` lines."""
    names = [*_names(REPORT), "repaired_sha256"]

    def run(batches):
        out, now, digest, between = [], None, None, ""

        def closed():
            return now.conv_id, *map(int, now.numbers.split(",")), now.audit, digest.hexdigest()

        for head, edit, role, text in _edited(batches):
            if edit is not None:
                digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
                continue
            if now is not None:
                out.append(closed())
            now, digest, between = head, hashlib.sha256(), ""
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now is not None:
            out.append(closed())
        yield pd.DataFrame(out, columns=names)

    return _beside_audits(rows, audits(rows, ids)).mapInPandas(run, f"{REPORT}, repaired_sha256 string")


def damaged(rows: DataFrame, den: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) % den: 0 drops a row, 1 empties its text,
    2 takes its stops, 3 repeats it, 4 makes it the user's."""
    rows = rows.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    place = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % den
    return rows.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")

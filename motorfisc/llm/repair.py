"""Conversation repair: cheapest edits of a conversation's rows into one that alternates, by weighted interval parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import settle, table

#: What an edit costs; a truncated row that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: How far a conversation has come: nothing yet, a system row, a user's, an assistant's; and the two where it may end.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
#: Where a role leads from each state that it may follow.
_MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LEGAL = ("su", "ua", "au")
_SPACES = " \t\n\x0b\x0c\r"
#: Rows of the spans whose cells are kept for conversations to come.
_SHORT = 8
_PARSED = "key string, part long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost array<long>, audit array<string>"
_REPAIRED = "key string, at long, edit string, role string, text string"
#: Cells of a span: cells[p][q] is (cost, audit) of the cheapest edits that lead from state p to state q (ties: the
#: audit that is ASCII-least), or None.
Cells = tuple[tuple[tuple[int, str] | None, ...], ...]


def joined(left: Cells, right: Cells) -> Cells:
    """The binary rules: a span from p to q is one from p to r and one from r to q, for any r."""
    out = []
    for row in left:
        ways = [(a, right[r]) for r, a in enumerate(row) if a]
        out.append(tuple(min(((a[0] + b[q][0], a[1] + b[q][1]) for a, b in ways if b[q]), default=None) for q in STATES))
    return tuple(out)


@cache
def inserted() -> Cells:
    """The insertion closure: the cells of a span without rows, grown by one inserted row until none gets cheaper."""
    one: list[list[tuple[int, str] | None]] = [[(0, "") if p == q else None for q in STATES] for p in STATES]
    for role in "ua":
        for p, q in _MOVES[role].items():
            one[p][q] = (INSERT, "I")
    step, now = tuple(map(tuple, one)), None
    closed = step
    while now != closed:
        now, closed = closed, joined(closed, step)
    return closed


@cache
def row_cells(kind: str) -> Cells:
    """The cells of one row, with what is inserted beside it.

    Kinds are ``s``, ``u``, ``a`` and ``o`` (another role), in upper case if truncated, and ``x`` for a row that must go.
    """
    more, ways = TRUNCATED * kind.isupper(), {(p, p): [(DELETE, "D")] for p in STATES}
    if kind != "x":
        for p, q in _MOVES.get(kind.lower(), {}).items():
            ways.setdefault((p, q), []).append((KEEP + more, "K"))
        for role in "ua":
            for p, q in _MOVES[role].items():
                ways.setdefault((p, q), []).append((REROLE + more, "R"))
    own = tuple(tuple(min(ways.get((p, q), []), default=None) for q in STATES) for p in STATES)
    return joined(joined(inserted(), own), inserted())


def _up(spans: list[Cells]) -> Cells:
    """Neighbouring spans joined two by two, bottom up by their length, until one is left."""
    while len(spans) > 1:
        spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else inserted()


@lru_cache(1 << 16)
def _short(kinds: str) -> Cells:
    return _up([row_cells(k) for k in kinds])


def parsed(kinds: str) -> Cells:
    """The cells of all rows together.

    The grammar has a nonterminal for each pair of states, rules X(p, q) -> X(p, r) X(r, q) for spans and X(p, q) -> edit
    for rows. Every derivation of a span passes through some state wherever the span is split, so all splits give the
    same cells: one of each span is looked at, and the chart has the spans of a balanced tree only.
    """
    return _up([_short(kinds[i : i + _SHORT]) for i in range(0, len(kinds), _SHORT)])


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[START][q] for q in ENDS if cells[START][q])


def _kinds(initial: str, blank: bool, first: bool, truncated: bool, n: int) -> str:
    if blank or not first:
        return "x" * n
    kind = initial if initial in ("s", "u", "a") else "o"
    return (kind.upper() if truncated else kind) + "x" * (n - 1)


def _runs(keys: list[str]) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


class _Stretch:
    """Neighbouring rows of one conversation: their cells and counts."""

    def __init__(self, key: str, part: int) -> None:
        self.key, self.part, self.cells, self.first, self.last = key, part, None, None, None
        self.counts = [0, 0, 0, 0]

    def add(self, first: str, last: str, counts: list[int], cells: Cells) -> None:
        self.cells = joined(self.cells, cells) if self.cells else cells
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.first is None:
            self.first = first
        else:
            self.counts[3] += self.last + first not in _LEGAL
        self.last = last

    def row(self) -> tuple:
        flat = [c for row in self.cells for c in row]
        return (self.key, self.part, self.first, self.last, *self.counts, [c[0] if c else None for c in flat], [c[1] if c else None for c in flat])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order -> one row for each stretch of a conversation that this task has."""
    context = TaskContext.get()
    part, held = context.partitionId() if context else 0, None
    for batch in batches:
        done, keys = [], batch["key"].to_list()
        rows = list(zip(*[batch[c].to_list() for c in ("initial", "blank", "first", "truncated", "n")], strict=True))
        for a, b in _runs(keys):
            if held is None or held.key != keys[a]:
                done += [held.row()] if held else []
                held = _Stretch(keys[a], part)
            own = rows[a:b]
            blank = sum(r[4] for r in own if r[1])
            duplicate = sum(r[4] - bool(r[2]) for r in own if not r[1])
            truncated = sum(bool(r[2] and r[3] and not r[1]) for r in own)
            illegal = sum(r[4] - 1 for r in own) + sum(x[0] + y[0] not in _LEGAL for x, y in zip(own, own[1:], strict=False))
            held.add(own[0][0], own[-1][0], [blank, duplicate, truncated, illegal], parsed("".join(_kinds(*r) for r in own)))
        yield pd.DataFrame(done, columns=_names(_PARSED))
    if held:
        yield pd.DataFrame([held.row()], columns=_names(_PARSED))


def _join_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches in order -> one row for each conversation."""
    names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    held: _Stretch | None = None
    row = lambda s: (s.key, *s.counts, *cheapest(s.cells))
    for batch in batches:
        done = []
        for key, _, first, last, blank, duplicate, truncated, illegal, cost, audit in batch.itertuples(index=False, name=None):
            if held is None or held.key != key:
                done += [row(held)] if held else []
                held = _Stretch(key, 0)
            flat = [None if a is None else (int(c), a) for c, a in zip(cost, audit, strict=True)]
            held.add(first, last, [blank, duplicate, truncated, illegal], tuple(tuple(flat[i : i + len(STATES)]) for i in range(0, len(flat), len(STATES))))
        yield pd.DataFrame(done, columns=names)
    if held:
        yield pd.DataFrame([row(held)], columns=names)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class _Editor:
    """Goes through an audit with a conversation's rows: what the repaired conversation has, row by row."""

    def __init__(self, key: str, audit: str) -> None:
        self.key, self.audit, self.at, self.state, self.place = key, audit, 0, START, 0

    def _out(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return (self.key, self.place - 1, edit, role, text)

    def _next(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out("I", self._next(), "")

    def edits(self, role: str, text: str, n: int) -> Iterator[tuple]:
        for _ in range(n):
            yield from self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = _MOVES[role[0]][self.state]
                yield self._out(edit, role, text)
            elif edit == "R":
                yield self._out(edit, self._next(), text)


def _edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each conversation's audit and then its rows, in order -> its repaired rows, in order."""
    editor: _Editor | None = None
    for batch in batches:
        out: list[tuple] = []
        for key, audit, role, text, n in zip(*[batch[c].to_list() for c in ("key", "audit", "role", "text", "n")], strict=True):
            if audit is None:
                out += editor.edits(role, text, int(n))
            else:
                out += editor.inserts() if editor else ()
                editor = _Editor(key, audit)
        yield pd.DataFrame(out, columns=_names(_REPAIRED))
    if editor:
        yield pd.DataFrame(list(editor.inserts()), columns=_names(_REPAIRED))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired rows in order -> SHA-256 of each conversation's ``role:text`` lines, a line at a time."""
    now, digest = None, None
    for batch in batches:
        done = []
        for key, role, text in zip(batch["key"].to_list(), batch["role"].to_list(), batch["text"].to_list(), strict=True):
            if key != now:
                done += [(now, digest.hexdigest())] if digest else []
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "replace"))
        yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
    if digest:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["key", "repaired_sha256"])


def key_of(conv_id: Column) -> Column:
    """The id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (key, turn, role, text, digest, n): distinct rows with how often each occurs.

    Nulls of role and text become one space. Equal rows are counted in the tasks that read them, so that very many
    copies of one are one row from there on. A column ``n``, if there is one, is not looked at.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = conversations.select(key_of(F.col("conv_id")).alias("key"), "turn", space("role").alias("role"), space("text").alias("text"))
    return _counted(given.withColumn("n", F.lit(1).cast("long")))


def _counted(rows: DataFrame) -> DataFrame:
    return settle(rows.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.sha2("text", 256)))


def audits(rows: DataFrame) -> DataFrame:
    """``rows_of`` -> (key, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation with rows.

    The rows stand in the order of turn (nulls first), role and the text's SHA-256. They are sorted in ranges, so that a
    conversation with very many of them is parsed in many tasks; what each task has of it, a stretch with its cells, is
    joined afterwards. Texts are not moved: only their digests and what is known of them.
    """
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("key", "role", "digest").agg(F.min(order).alias("_first"))
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    told = rows.select("key", "turn", "role", "digest", "n", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    told = settle(told.join(firsts, ["key", "role", "digest"]).withColumn("first", order == F.col("_first")).drop("_first"))
    where = ["key", "turn", "role", "digest"]
    parts = told.repartitionByRange(*where).sortWithinPartitions(*where).select("key", "initial", "blank", "first", "truncated", "n").mapInPandas(_parse, _PARSED)
    stretches = settle(parts).repartition("key").sortWithinPartitions("key", "part")
    return stretches.mapInPandas(_join_stretches, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows_of`` and their ``audits`` -> (key, at, edit, role, text): the repaired conversations, each in order in one partition.

    A conversation's audit goes before its rows in the same sort, so neither is joined to the other nor held whole.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select("key", F.lit(0).alias("kind"), none(rows.schema["turn"].dataType).alias("turn"), none("string").alias("role"), none("string").alias("digest"), none("string").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    given = rows.select("key", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "n", none("string").alias("audit"))
    placed = heads.unionByName(given).repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "digest")
    return placed.select("key", "audit", "role", "text", "n").mapInPandas(_edit, _REPAIRED)


def digests(conversations: DataFrame) -> DataFrame:
    """``repaired`` -> (key, repaired_sha256); a conversation of which nothing is left has no row."""
    return conversations.mapInPandas(_hash, "key string, repaired_sha256 string")


def _gaps(rows: DataFrame) -> DataFrame:
    turn = F.col("turn").cast("decimal(38,0)")
    missing = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0))
    return rows.select("key", "turn").distinct().groupBy("key").agg(F.least(missing, F.lit((1 << 63) - 1)).cast("long").alias("gaps"))


def summary(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, ...) and the ``rows_of`` conversations -> faults, cost, audit and digest of every conversation of ``ids``.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text were there before) or
    truncated (the last character besides white space isn't one of . ! ?). Edits are Keep, Rerole (to user or
    assistant), Delete and Insert (a user's or an assistant's row without text); the repaired roles' initials are
    nothing, or an s at most and then pairs of u and a. A conversation without rows has zeros, an empty audit and the
    digest of nothing; rows without a conv_id are one conversation, with a null id. Gaps beyond the range of a long are
    the largest long. An empty table gives an empty one.

    The digest is defined over a conversation's whole text in order, so it is one task's work for each conversation; it
    holds one batch of rows at a time.
    """
    found = settle(audits(rows))
    told = found.join(_gaps(rows), "key", "left").join(digests(repaired(rows, found)), "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = ids.select("conv_id").distinct().withColumn("key", key_of(F.col("conv_id"))).join(told, "key", "left")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> ``rows_of`` the same with some rows damaged, by crc32 of ``conv_id:turn`` (null: a space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    given = conversations.select(key_of(F.col("conv_id")).alias("key"), "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return _counted(given.select("key", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    given = table(spark, sf_dir, "conversations")
    return summary(given, damaged(given))

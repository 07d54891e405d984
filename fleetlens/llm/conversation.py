"""Conversation structure repair: faults, the cheapest edits, and the repaired turns.

Each row is kept, given another role or deleted, and rows without text may be
inserted, so that roles come as an optional system row and then user and
assistant in turn. A dynamic program over four states (nothing yet, after
system, after user, after assistant) finds the cheapest edits; among equal
costs the string of edit initials that is least in ASCII wins. Two strings of
one state and cost never begin with each other, as what one has in excess
would cost something, so the least prefix of a state is all that is needed.

Edit strings are paths of a persistent tree: a state of the next row links to
its best parent, and prefixes are shared. A path knows its ancestors at powers
of two and the rolling hash of its string, so two strings are compared at
their longest common prefix, found by search; what the hashes call equal is
checked on the letters before it counts.

Rows travel without their texts: a fingerprint, the role and the marks of
faults are sorted by conversation and turn over range partitions, so a long
conversation is spread over tasks. A task sees pieces of bounded length; a
piece whose entry state is open is solved for each of them, and the pieces of
such conversations are chained afterwards, with whole pieces as links of the
same tree. Equal rows of one turn are one row with a count. Only the digest of
a repaired conversation needs its texts in order: they are streamed through it
in sorted order, holding one batch and the edit string.

Defined results: a null text or role is one space (so such a row is blank, or
has a role that cannot be kept), a null turn or key enters the damage as one
space and sorts first; the key stays null in the result. An empty role has no
initial and cannot be kept. Rows of one turn follow in the order of role and text fingerprint. Other
columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.session import staged

# Rows of a piece; hash modulus (a Mersenne prime) and base.
PIECE_ROWS = 4096
MODULUS, BASE = (1 << 61) - 1, 911_382_323
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
LEGAL_PAIRS = ("su", "ua", "au")
PIECE = (
    "conv_id long, done boolean, part int, piece int, blank long, duplicate long, truncated long, illegal long, distinct long, "
    "low long, high long, first_initial string, last_initial string, entries array<struct<q:int,r:int,cost:long,audit:string>>"
)
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# ---- the tree of edit strings -------------------------------------------------


class Path:
    """An edit string: its parent's string and a block of letters."""

    __slots__ = ("block", "hash", "size", "up")

    def __init__(self, parent: Path | None, block: str):
        self.block = block
        self.size, value = (parent.size, parent.hash) if parent else (0, 0)
        self.size += len(block)
        self.hash = extend_hash(value, block)
        # Ancestors 1, 2, 4, ... links back.
        self.up: list[Path] = []
        while parent is not None:
            self.up.append(parent)
            k = len(self.up) - 1
            parent = parent.up[k] if len(parent.up) > k else None

    def holder(self, at: int) -> Path:
        """The ancestor (or self) whose block holds letter ``at``, counted from 1."""
        node = self
        while node.up and node.up[0].size >= at:
            k = len(node.up) - 1
            while node.up[k].size < at:
                k -= 1
            node = node.up[k]
        return node

    def prefix_hash(self, size: int) -> int:
        if size == 0:
            return 0
        node = self.holder(size)
        before = node.size - len(node.block)
        parent = node.up[0].hash if node.up else 0
        return extend_hash(parent, node.block[: size - before])

    def letter(self, at: int) -> str:
        node = self.holder(at)
        return node.block[at - 1 - (node.size - len(node.block))]

    def text(self) -> str:
        blocks, node = [], self
        while True:
            blocks.append(node.block)
            if not node.up:
                return "".join(reversed(blocks))
            node = node.up[0]


def extend_hash(value: int, block: str) -> int:
    for c in block:
        value = (value * BASE + ord(c)) % MODULUS
    return value


def _same_prefix(a: Path, b: Path, size: int) -> bool:
    """Whether the first ``size`` letters agree, on the letters; shared links end the walk."""
    while size > 0:
        a, b = a.holder(size), b.holder(size)
        if a is b:
            return True
        start_a, start_b = a.size - len(a.block), b.size - len(b.block)
        low = max(start_a, start_b)
        if a.block[low - start_a : size - start_a] != b.block[low - start_b : size - start_b]:
            return False
        size = low
    return True


def is_less(a: Path, b: Path) -> bool:
    """Whether the string of ``a`` comes before that of ``b``."""
    if a is b:
        return False
    low, high = 0, min(a.size, b.size)
    if a.up and b.up and a.up[0] is b.up[0]:
        low = a.up[0].size
    # Hashes of longer prefixes differ as soon as one does, but for collisions.
    while low < high:
        middle = (low + high + 1) // 2
        if a.prefix_hash(middle) == b.prefix_hash(middle):
            low = middle
        else:
            high = middle - 1
    if not _same_prefix(a, b, low):
        return a.text() < b.text()
    if low == a.size or low == b.size:
        return a.size < b.size
    return a.letter(low + 1) < b.letter(low + 1)


States = list["tuple[int, Path] | None"]


def _better(new: tuple[int, Path], old: tuple[int, Path] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and is_less(new[1], old[1])


def _offer(states: States, at: int, cost: int, path: Path) -> None:
    if _better((cost, path), states[at]):
        states[at] = (cost, path)


def with_inserts(states: States) -> States:
    """The states after any inserts that may pay; the string's next letter is a row's."""
    out = list(states)
    for q in (START, SYSTEM, ASSISTANT):
        if (s := states[q]) and (out[USER] is None or s[0] + INSERT_COST <= out[USER][0]):
            _offer(out, USER, s[0] + INSERT_COST, Path(s[1], "I"))
    if (s := out[USER]) and (out[ASSISTANT] is None or s[0] + INSERT_COST <= out[ASSISTANT][0]):
        _offer(out, ASSISTANT, s[0] + INSERT_COST, Path(s[1], "I"))
    return out


def after_deletes(states: States, n: int) -> States:
    # Inserts before a delete are never less than those after it.
    return [s and (s[0] + n * DELETE_COST, Path(s[1], "D" * n)) for s in states]


def after_row(states: States, initial: str, truncated: bool) -> States:
    """The states after a row that need not be deleted."""
    before, out = with_inserts(states), [None] * 4
    extra = TRUNCATED_COST if truncated else 0
    for q, s in enumerate(before):
        if s is None:
            continue
        target = ASSISTANT if q == USER else USER
        # One of keep and rerole leads to the same state; a keep is the cheaper one.
        keeps = initial == ("a" if q == USER else "u")
        edits = [(DELETE_COST, "D", q), (KEEP_COST + extra, "K", target) if keeps else (REROLE_COST + extra, "R", target)]
        if q == START and initial == "s":
            edits.append((KEEP_COST + extra, "K", SYSTEM))
        for cost, letter, r in edits:
            if out[r] is None or s[0] + cost <= out[r][0]:
                _offer(out, r, s[0] + cost, Path(s[1], letter))
    return out


def finished(states: States) -> tuple[int, str]:
    """The cheapest whole string: (cost, string)."""
    end = with_inserts(states)
    best = end[START]
    if end[ASSISTANT] and _better(end[ASSISTANT], best):
        best = end[ASSISTANT]
    return best[0], best[1].text()


# ---- damage and faults ----------------------------------------------------------


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of key and turn names."""
    kind = F.pmod(F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn"))).cast("binary")), F.lit(20))
    base = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return base.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _fingerprint() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("print")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without texts: conv_id, turn, role, print, mark (1 first of its role and text, 2 row), n, blank, truncated.

    A row of mark 0 stands for each conversation, also for one without rows.
    """
    faults = rows.select("conv_id", "turn", "role", "text", "copies").select(
        "conv_id", "turn", "role", _fingerprint(), "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    # Copies within a turn are counted before the shuffle.
    alike = faults.groupBy("conv_id", "turn", "role", "print", "blank", "truncated").agg(F.sum("copies").alias("n"))
    return staged(alike, "conversation-rows")


def _sorted(seeds: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``_marked`` with the firsts of each role and text, in order over range partitions."""
    key = ["conv_id", "role", "print"]
    first = F.when(F.max(F.col("turn").isNull()), F.lit(None)).otherwise(F.min("turn")).cast("long")
    firsts = rows.groupBy(*key).agg(first.alias("turn")).withColumn("mark", F.lit(1))
    ids = seeds.select("conv_id").distinct().withColumn("mark", F.lit(0))
    every = ids.unionByName(firsts, allowMissingColumns=True).unionByName(rows.withColumn("mark", F.lit(2)), allowMissingColumns=True)
    order = ["conv_id", "turn", "role", "print"]
    names = ["conv_id", "turn", "role", "print", "mark", "n", "blank", "truncated"]
    return every.select(*names).repartitionByRange(*order).sortWithinPartitions(*order, "mark")


# ---- pieces and their chains ------------------------------------------------------


@dataclass
class Tally:
    """Counts over rows in order; two neighbours can be joined."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add_row(self, turn: int | None, initial: str, n: int) -> None:
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.last is not None and self.last + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.illegal += n - 1  # equal initials never follow each other legally
        self.first = initial if self.first is None else self.first
        self.last = initial

    def join(self, other: Tally) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.high is not None and self.high == other.low:
            self.distinct -= 1
        if self.last is not None and other.first is not None and self.last + other.first not in LEGAL_PAIRS:
            self.illegal += 1
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def values(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.low, self.high, self.first, self.last]


@dataclass
class Piece:
    """A run of rows of one conversation, solved from each entry state that is possible."""

    conv: int | None
    entries: list[int]
    number: int = 0
    rows: int = 0
    tally: Tally = field(default_factory=Tally)
    states: dict[int, States] = field(default_factory=dict)

    def __post_init__(self) -> None:
        root = Path(None, "")
        self.states = {q: [(0, root) if r == q else None for r in range(4)] for q in self.entries}

    def step(self, turn, initial: str, n: int, blank: bool, truncated: bool, first: bool) -> None:
        self.rows += 1
        self.tally.add_row(turn, initial, n)
        forced = n
        if blank:
            self.tally.blank += n
        else:
            self.tally.duplicate += n - 1 if first else n
            forced = n - 1 if first else n
            self.tally.truncated += truncated and first
        for q, states in self.states.items():
            if forced < n:
                states = after_row(states, initial, truncated)
            self.states[q] = after_deletes(states, forced) if forced else states

    def table(self) -> list[dict]:
        return [
            {"q": q, "r": r, "cost": s[0], "audit": s[1].text()}
            for q, states in self.states.items()
            for r, s in enumerate(states)
            if s is not None
        ]


def _initial(role: str) -> str:
    return role[:1] or " "


def _pieces(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition to pieces; conversations known to be whole are done."""
    from pyspark import TaskContext

    part, schema = TaskContext.get().partitionId(), pa.schema([
        ("conv_id", pa.int64()), ("done", pa.bool_()), ("part", pa.int32()), ("piece", pa.int32()),
        *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")],
        ("first_initial", pa.string()), ("last_initial", pa.string()),
        ("entries", pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ])
    out: list[list] = []

    def close(piece: Piece, done: bool) -> None:
        if done:
            cost, audit = finished(piece.states[START])
            table = [{"q": START, "r": START, "cost": cost, "audit": audit}]
        else:
            table = piece.table()
        out.append([piece.conv, done, part, piece.number, *piece.tally.values(), table])

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    piece: Piece | None = None
    first = False
    for batch in batches:
        names = ("conv_id", "turn", "role", "mark", "n", "blank", "truncated")
        for conv, turn, role, mark, n, blank, truncated in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if piece is None:
                # The conversation may have begun in the partition before.
                piece = Piece(conv, list(range(4)))
            elif conv != piece.conv:
                close(piece, done=piece.number == 0 and piece.entries == [START])
                piece, first = Piece(conv, [START]), False
            elif piece.rows >= piece_rows and (mark == 1 or not first):
                close(piece, done=False)
                piece = Piece(conv, list(range(4)), piece.number + 1)
            if mark == 1:
                first = True
            elif mark == 2:
                piece.step(turn, _initial(role), n, blank, truncated, first)
                first = False
        if len(out) >= 2000:
            yield flush()
    if piece is not None:
        # It may go on in the next partition.
        close(piece, done=False)
    if out:
        yield flush()


def _audit_row(conv, tally: Tally, cost: int, audit: str) -> list:
    return [conv, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations in order to their audits; holds the strings of at most four states."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    out: list[list] = []
    conv, states, tally = None, None, Tally()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for r in batch.to_pylist():
            if states is not None and r["conv_id"] != conv:
                out.append(_audit_row(conv, tally, *finished(states)))
                states = None
            if states is None:
                conv, tally = r["conv_id"], Tally()
                states = [(0, Path(None, "")), None, None, None]
            after: States = [None] * 4
            for e in r["entries"]:
                if s := states[e["q"]]:
                    # A piece without rows adds no letters.
                    path = Path(s[1], e["audit"]) if e["audit"] else s[1]
                    _offer(after, e["r"], s[0] + e["cost"], path)
            states = after
            values = [r[c] for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first_initial", "last_initial")]
            tally.join(Tally(*values))
        if len(out) >= 2000:
            yield flush()
    if states is not None:
        out.append(_audit_row(conv, tally, *finished(states)))
    if out:
        yield flush()


def audits(rows: DataFrame, conversations: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation: counts of faults, the cost and the string of the cheapest edits.

    ``rows`` has conv_id, turn, role, text and copies (see ``damaged``). Each conv_id of ``conversations`` gets a row,
    whether it has rows left or not.
    """
    seeds = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id"))
    solved = _sorted(seeds, _marked(rows)).mapInArrow(lambda batches: _pieces(batches, piece_rows), PIECE)
    pieces = staged(solved, "conversation-pieces")
    tally = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    only = F.col("entries")[0]
    done = pieces.where("done").select("conv_id", gaps, *tally, only["cost"].alias("cost"), only["audit"].alias("audit"))
    # Two conversations per range partition at most, and those longer than a piece.
    open_pieces = pieces.where("not done").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return done.unionByName(open_pieces.mapInArrow(_chained, AUDIT))


# ---- repaired turns ----------------------------------------------------------------


def _with_audits(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """The audit of a conversation, then its rows in order, conversation by conversation."""
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _fingerprint(), "text", F.col("copies").cast("int").alias("copies"))
    heads = audit.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    every = heads.unionByName(texts, allowMissingColumns=True)
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "print")
    return ordered.select("conv_id", "kind", "role", "text", "copies")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None, None) at the start of each conversation, then (conv_id, role, text) of its repaired rows."""
    conv, audit, at, out = None, "", 0, 0

    def role_of(role: str | None) -> str:
        # ``out`` counts the rows behind the optional system row.
        return role if role is not None else ("user", "assistant")[out % 2]

    for batch in batches:
        for key, kind, role, text, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies")], strict=True):
            if kind == 0:
                for _ in range(at, len(audit)):
                    yield conv, role_of(None), ""
                    out += 1
                conv, audit, at, out = key, text, 0, 0
                yield conv, None, None
                continue
            for _ in range(copies):
                while audit[at] == "I":
                    yield conv, role_of(None), ""
                    at, out = at + 1, out + 1
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                yield conv, role if edit == "K" else role_of(None), text
                if not (edit == "K" and role[:1] == "s"):
                    out += 1
    for _ in range(at, len(audit)):
        yield conv, role_of(None), ""
        out += 1


def repaired_turns(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation after the edits of its audit, from place 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.string()], ["conv_id", "place", "role", "text"]
        held, size, place = [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for conv, role, text in _repaired(batches):
            if role is None:
                place = 0
                continue
            held.append((conv, place, role, text))
            place, size = place + 1, size + len(text) + 32
            if size > 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return _with_audits(rows, audit).mapInArrow(each, "conv_id long, place long, role string, text string")


def digests(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns as ``role:text`` lines, hashed as they stream by."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        conv, state, some = None, None, False

        def flush() -> pa.RecordBatch:
            ids, values = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["conv_id", "repaired_sha256"])

        for key, role, text in _repaired(batches):
            if role is None:
                if state is not None:
                    held.append((conv, state.hexdigest()))
                if len(held) >= 2000:
                    yield flush()
                conv, state, some = key, hashlib.sha256(), False
            else:
                state.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                some = True
        if state is not None:
            held.append((conv, state.hexdigest()))
        if held:
            yield flush()

    return _with_audits(rows, audit).mapInArrow(each, "conv_id long, repaired_sha256 string")

"""Repair of the structure of conversations by signature deduplication.

A conversation's roles and faults make a short string, its signature. What the cheapest repair is depends on that
alone, so each distinct signature is solved once, however many conversations have it; the solutions are joined back and
their edits replayed on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: What has been put out so far: nothing, the system's row, a user's last, an assistant's last. A repaired conversation is
#: empty or ends with an assistant's row; roles are in the order of the pattern (s?(ua)+)?.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: After each state, the state after a row of the only one of user and assistant that may follow.
TURN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: By state, what it costs to end there: missing rows are inserted.
ENDING = (0, 2 * INSERT, INSERT, 0)
#: A letter that must go; others are a role's initial (x for none of s, u, a), in upper case if the row is truncated.
MUST_GO = "d"
#: Signatures up to this length are solved with remembered suffixes.
REMEMBERED = 48


def after_keeping(state: int, letter: str) -> int | None:
    """The state after a row is kept as it is, None where the pattern forbids it."""
    if letter == "s":
        return SYSTEM if state == NONE else None
    if letter in "ua" and TURN[state] == (USER if letter == "u" else ASSISTANT):
        return TURN[state]
    return None


def step(letter: str, following: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs, by state, of a suffix that begins with letter, from those of what follows it."""
    role, extra = letter.lower(), TRUNCATED * letter.isupper()
    least = []
    for state in range(4):
        ways = [DELETE + following[state]]
        if letter != MUST_GO:
            ways.append(REROLE + extra + following[TURN[state]])
            if (kept := after_keeping(state, role)) is not None:
                ways.append(extra + following[kept])
        least.append(min(ways))
    # rows may be inserted before this one; more than two in a row only lead back to a state
    return tuple(min(least[s], INSERT + least[TURN[s]], 2 * INSERT + least[TURN[TURN[s]]]) for s in range(4))


@lru_cache(1 << 16)
def suffix_costs(suffix: str) -> tuple[int, ...]:
    """step() by memoised recursion: signatures that end alike share the work."""
    return step(suffix[0], suffix_costs(suffix[1:])) if suffix else ENDING


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equally cheap audits the least in ASCII.

    An audit's letter and the state before it give the state after it, so taking the least letter that keeps the cost, again
    and again, gives the least audit: D, I, K, R in this order.
    """
    n = len(signature)
    costs: list[tuple[int, ...]] = [ENDING] * (n + 1)
    for i in range(n - 1, -1, -1):
        costs[i] = suffix_costs(signature[i:]) if n - i <= REMEMBERED else step(signature[i], costs[i + 1])
    audit, state, i = [], NONE, 0
    while i < n or costs[n][state]:
        best = costs[i][state]
        letter = signature[i] if i < n else MUST_GO
        extra, kept = TRUNCATED * letter.isupper(), None if letter == MUST_GO else after_keeping(state, letter.lower())
        if i < n and best == DELETE + costs[i + 1][state]:
            audit.append("D")
            i += 1
        elif best == INSERT + costs[i][TURN[state]]:
            audit.append("I")
            state = TURN[state]
        elif kept is not None and best == extra + costs[i + 1][kept]:
            audit.append("K")
            state, i = kept, i + 1
        else:
            audit.append("R")
            state, i = TURN[state], i + 1
    return costs[0][NONE], "".join(audit)


def spaced(column: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and stays of every row, damaged by rule: crc32 of "conv_id:turn" modulo 20 drops it (0, stays
    is false), empties its text (1), takes its . ! ? (2), repeats it (3) or makes it the user's (4). Nulls read as one
    space; conv_id and turn stay null."""
    what = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(what == 1, "").when(what == 2, F.translate(spaced("text"), ENDS, "")).otherwise(spaced("text"))
    role = F.when(what == 4, "user").otherwise(spaced("role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (what != 0).alias("stays"), F.when(what == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "stays", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows in one task, in the order of turn, nulls first, of one turn by role and a digest of the text."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "digest")


def by_conversation(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, tuple]]:
    """(whether a conversation begins, row) of rows in order."""
    last: list = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            yield last != [row[0]], row
            last = [row[0]]


class Reading:
    """What is gathered of one conversation while its rows are read in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.signature, self.seen, self.turns, self.last = conv_id, [], set(), [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, ends: bool) -> None:
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn not in self.turns[-1:]:
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.n_turns += 1
        repeated = (role, digest) in self.seen
        self.seen.add((role, digest))
        letter = initial if initial and initial in "sua" else "x"
        if blank or repeated:
            letter = MUST_GO
        elif not ends:
            letter = letter.upper()
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += letter.isupper()
        self.signature.append(letter)

    def row(self) -> dict:
        gaps = self.turns[-1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return {"conv_id": self.conv_id, "signature": "".join(self.signature), "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


FOUND = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
SOLVED = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal). Texts stay where they are: digests and flags move."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), (end == "").alias("blank"), end.isin(*ENDS).alias("ends"), "stays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for begins, (conv_id, turn, role, digest, blank, ends, stays) in by_conversation(batches, ["conv_id", "turn", "role", "digest", "blank", "ends", "stays"]):
            if begins:
                done += [now.row()] if now else []
                now = Reading(conv_id)
                if len(done) == 1000:
                    yield pa.RecordBatch.from_pylist(done, FOUND)
                    done = []
            if stays:
                now.add(turn, role, digest, blank, ends)
        yield pa.RecordBatch.from_pylist(done + ([now.row()] if now else []), FOUND)

    return in_arrow(in_order(narrow), "conversations", run, ddl(FOUND))


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("signature").to_pylist()
            costs, audits = zip(*map(solve, own), strict=True) if own else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], schema=SOLVED)

    return in_arrow(found.select("signature").distinct(), "conversations", run, ddl(SOLVED))


class Replay:
    """A conversation's edits applied to its rows in order; the repaired text goes into a running hash, a row at a time."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at, self.state, self.hash, self.empty = head, head["audit"], 0, NONE, hashlib.sha256(), True

    def out(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def turn(self, text: str) -> None:
        self.state = TURN[self.state]
        self.out("user" if self.state == USER else "assistant", text)

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.turn("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.turn(text)
        elif edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self.out(role, text)

    def row(self) -> dict:
        self.inserted()
        return {**self.head, "repaired_sha256": self.hash.hexdigest()}


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged by
    rule first (see damaged()).

    Each row's first fault counts: blank, duplicate (role and text of a row before it, whatever that one's faults),
    truncated. Rows are ordered by turn, nulls first, of one turn by role and the digest of the text; so repeated rows
    stand together, and all but the first are duplicates. A null conv_id is a conversation like others. Null roles and
    texts are one space: the first is no role that may stay, the second is blank. An empty role has no initial: it is
    counted as illegal beside others and can't be kept. A conversation of which nothing is left has zeros, an empty audit
    and the hash of nothing. Extra columns are ignored; an empty table gives no rows; very long texts are hashed whole.

    Texts move once, to be replayed; before that, digests and flags do. Signatures, not conversations, are solved. A
    conversation of any length is read as a stream, of which a task keeps a letter and a digest a row: a hash over its
    rows can't be spread. A signature that a third of all conversations have is one row of the solutions; it is joined to
    short rows, which AQE splits.
    """
    rows = damaged(conversations)
    found = signatures(rows)
    heads = found.join(solved(found), "signature").select(*[c for c in REPAIRED.names if c != "repaired_sha256"])
    names = [c for c in heads.columns if c != "conv_id"]
    texts = rows.where("stays").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"), F.lit(None).cast(heads.select(F.struct(*names)).dtypes[0][1]).alias("head"))
    empty = F.lit(None).cast("string")
    tops = heads.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), empty.alias("role"), empty.alias("text"), empty.cast("binary").alias("digest"), F.struct(*names).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for begins, (conv_id, role, text, head) in by_conversation(batches, ["conv_id", "role", "text", "head"]):
            if begins:
                done += [now.row()] if now else []
                now = Replay({"conv_id": conv_id, **head})
                if len(done) == 1000:
                    yield pa.RecordBatch.from_pylist(done, REPAIRED)
                    done = []
            else:
                now.add(role, text)
        yield pa.RecordBatch.from_pylist(done + ([now.row()] if now else []), REPAIRED)

    return in_arrow(in_order(tops.unionByName(texts), "kind"), "conversations", run, ddl(REPAIRED))

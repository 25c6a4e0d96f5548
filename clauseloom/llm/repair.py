"""Conversations damaged, inspected, and repaired by the cheapest edits, found on a suffix-shared automaton.

A conversation's rows, in order of their turns, have to read ``(s?(ua)+)?`` by the initials of their roles, without blank or repeated
rows. Edits are Keep (0), Rerole to user or assistant (3), Delete (4), and Insert of an empty user or assistant row
(3); a truncated row that stays adds 3; blank and repeated rows have to go. Of the cheapest edits the ones whose initials are least in
ASCII order are taken.

* A conversation's *signature* has one letter a row: the initial (``s u a``, ``o`` for others), upper-case where truncated, ``x`` where
  the row has to go. Cost and edits depend on it alone.
* What a row's best edit is depends on the rest of the signature only. Signatures are therefore read from the end: sorted by their reversals,
  equal suffixes of all conversations are next to each other and are one node, which is visited once. A node holds the least cost from
  each of the four grammar states (start, after s, after u, after a); nodes whose costs differ by a constant behave
  alike, so they are merged, and the cost-to-go and best edits of a node and state are worked out once per (merged node, letter).
  A task keeps the merged automaton, which has a few dozen nodes, and the path of the last signature. The first edit tells
  ties apart (edits of equal cost from one state have different initials), so best suffixes need no comparison.
* Rows are first told from repeated ones by a partial aggregate of the first turn of each (conversation, role, text digest). No text
  is moved for the signatures. Then the rows with their texts meet their audit once, in order, and are written out as a stream.

One conversation's rows are read by one task, in order, since its audit is one value and its digest is sequential. The sort before
spills, and the task holds a byte or two a row of the conversation, never its texts; a conversation that holds a third of all rows is a long
stream, not a large group.

Defined results: nulls of role and text, and of id and turn in the damage's hash, read as one space; a null id is a conversation of its own; rows
of one turn are ordered by role, then by digest of role and text; rows equal in all columns count each; conversations that the damage empties have
zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clauseloom.llm.common import named
from clauseloom.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and characters of an Arrow batch that is handed on.
BATCH_ROWS, BATCH_CHARS = 4096, 1_000_000
NEVER = 1 << 40


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: a row that the hash drops has no copies, one that it repeats has two."""
    space = F.lit(" ")
    at = F.concat(F.coalesce(named(conv_id).cast("string"), space), F.lit(":"), F.coalesce(named(turn).cast("string"), space))
    kind = F.crc32(at) % 20
    body = F.coalesce(named(text), space)
    return conversations.select(
        named(conv_id).alias("conv_id"), named(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(named(role), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digests() -> list[Column]:
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, h1, h2, letter, blank, first, copies)``: rows without texts, equal ones counted; ``first`` where
    no earlier row has that role and text. Conversations whose rows are all dropped keep one row without copies."""
    initial = F.substring("role", 1, 1)
    bare = F.rtrim("text", F.lit(BLANKS))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    here = F.col("copies") > 0
    slim = rows.select(
        "conv_id", "copies", *[F.when(here, c).alias(n) for c, n in (
            (F.col("turn"), "turn"), (F.col("role"), "role"), *zip(_digests(), ("h1", "h2"), strict=True),
            (F.when(F.substring(bare, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter)), "letter"), (F.length(bare) == 0, "blank"),
        )]
    )
    keys = ("conv_id", "turn", "role", "h1", "h2", "letter", "blank")
    counted = materialize(slim.groupBy(*keys).agg(F.sum("copies").alias("copies")), "repair-rows")
    # A struct orders a null turn first, and is not null itself.
    firsts = counted.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn")).alias("earliest"))
    firsts = firsts.select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "h1", "h2")], F.col("earliest.turn").alias("earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
    joined = counted.join(firsts, same, "left")
    return joined.select(*keys, F.col("turn").eqNullSafe(F.col("earliest")).alias("first"), "copies")


def _in_order(rows: DataFrame, *first: Column) -> DataFrame:
    """Conversations whole in their partition, rows in order."""
    return rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "h1", "h2"
    )


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
LEGAL = {"su", "ua", "au"}


def _signatures(kind: pa.DataType):
    """Counts and the reversed signature of each conversation, from rows in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "reversed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own: object = None
        open_, letters, blank, repeated, truncated, illegal, before, turns, least, most = False, [], 0, 0, 0, 0, "", 0, None, None

        def close() -> None:
            gaps = most - least + 1 - turns if turns else 0
            out.append((own, gaps, blank, repeated, truncated, illegal, "".join(reversed(letters))))

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 5, pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        size = 0
        for batch in batches:
            for conv, turn, letter, is_blank, first, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or conv != own:
                    if open_:
                        close()
                        size += len(letters) + 1
                        if size > BATCH_CHARS or len(out) >= BATCH_ROWS:
                            yield batch_of()
                            size = 0
                    open_, own, letters, blank, repeated, truncated, illegal, before, turns, least, most = True, conv, [], 0, 0, 0, 0, "", 0, None, None
                if not copies:
                    continue
                if turn is not None and (most is None or turn != most):
                    turns, least, most = turns + 1, turn if least is None else least, turn
                initial = letter.lower()
                illegal += (bool(before) and before + initial not in LEGAL) + copies - 1
                before = initial
                if is_blank:
                    blank += copies
                    letters.append("x" * copies)
                else:
                    fresh = 1 if first else 0
                    repeated += copies - fresh
                    truncated += fresh if letter.isupper() else 0
                    # Pieces of one letter each, as they are reversed as a whole.
                    letters += [letter * fresh, "x" * (copies - fresh)]
        if open_:
            close()
        if out:
            yield batch_of()

    return run


def signatures(rows: DataFrame) -> DataFrame:
    """``faults`` → ``(conv_id, gaps, blank, duplicate, truncated, illegal, reversed)``; ``reversed`` is the signature from its end."""
    field = rows.schema["conv_id"]
    ordered = _in_order(rows).select("conv_id", "turn", "letter", "blank", "first", "copies")
    return ordered.mapInArrow(_signatures(to_arrow_type(field.dataType)), f"conv_id {field.dataType.simpleString()}, {FACTS}, reversed string")


class Automaton:
    """Merged nodes: least costs from the four states, less the least of them. ``step`` puts a letter before a node."""

    def __init__(self) -> None:
        # After the last row: nothing is missing, "ua" is, "a" is, nothing is.
        self.costs: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple[str, ...], tuple[int, ...]]] = {}
        ends, self.end_edits = self._filled([0, NEVER, NEVER, 0], [""] * 4)
        self.end, self.end_cost = self._node(ends)

    def _node(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.numbers:
            self.numbers[key] = len(self.costs)
            self.costs.append(key)
        return self.numbers[key], least

    @staticmethod
    def _filled(costs: list[int], edits: list[str]) -> tuple[list[int], list[str]]:
        """The same where rows may be inserted first; at equal cost the lesser first edit wins."""
        best, after = list(costs), (USER, USER, ASSISTANT, USER)
        for _ in range(3):  # a cheapest chain of insertions is shorter
            best = [min(best[s], best[after[s]] + INSERT) for s in range(4)]
        made = []
        for state in range(4):
            # The chain from a state ends where its own row's edit is no worse.
            chain, at, cost = "", state, best[state]
            while cost < costs[at] or (cost == costs[at] and edits[at] > "I" and best[after[at]] + INSERT == cost):
                chain, at, cost = chain + "I", after[at], cost - INSERT
            made.append(chain + edits[at])
        return best, made

    def step(self, node: int, letter: str) -> tuple[int, int, tuple[str, ...], tuple[int, ...]]:
        """The node of ``letter`` before ``node``, its cost beyond that node's, and from each state the edits and the state they lead to."""
        if (node, letter) not in self.steps:
            rest, initial, broken = self.costs[node], letter.lower(), TRUNCATED if letter.isupper() else 0
            costs, edits, leads = [], [], []
            for state in range(4):
                options = [(rest[state] + DELETE, "D", state)]
                if letter != "x":
                    follows = ASSISTANT if state == USER else USER
                    options.append((rest[follows] + REROLE + broken, "R", follows))
                    if initial == ("a" if state == USER else "u"):
                        options.append((rest[follows] + KEEP + broken, "K", follows))
                    if initial == "s" and state == START:
                        options.append((rest[SYSTEM] + KEEP + broken, "K", SYSTEM))
                cost, edit, lead = min(options)
                costs.append(cost)
                edits.append(edit)
                leads.append(lead)
            full, made = self._filled(costs, edits)
            after = []
            for state, chain in enumerate(made):
                for _ in range(len(chain) - 1):
                    state = ASSISTANT if state == USER else USER
                after.append(leads[state])
            number, more = self._node(full)
            self.steps[node, letter] = number, more, tuple(made), tuple(after)
        return self.steps[node, letter]


class Path:
    """The nodes of the last signature, from the end of its rows; a further signature shares those of their common suffix."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.letters, self.nodes, self.costs, self.steps = "", [self.automaton.end], [self.automaton.end_cost], []
        self.audit: tuple[int, str] | None = None

    def read(self, letters: str) -> tuple[int, str]:
        """Cost and audit of a reversed signature."""
        if letters == self.letters and self.audit:
            return self.audit
        shared, most = 0, min(len(letters), len(self.letters))
        while shared < most and letters[shared] == self.letters[shared]:
            shared += 1
        del self.nodes[shared + 1 :], self.costs[shared + 1 :], self.steps[shared:]
        for letter in letters[shared:]:
            step = self.automaton.step(self.nodes[-1], letter)
            self.nodes.append(step[0])
            self.costs.append(self.costs[-1] + step[1])
            self.steps.append(step)
        self.letters = letters
        state, made = START, []
        for _, _, edits, leads in reversed(self.steps):
            made.append(edits[state])
            state = leads[state]
        made.append(self.automaton.end_edits[state])
        self.audit = self.costs[-1] + self.automaton.costs[self.nodes[-1]][START], "".join(made)
        return self.audit


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = Path()
    for batch in batches:
        read = [path.read(letters) for letters in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [*batch.columns[:-1], pa.array([r[0] for r in read], pa.int64()), pa.array([r[1] for r in read], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "cost", "audit"])


def audits(signed: DataFrame) -> DataFrame:
    """``signatures`` → the same with ``cost`` and ``audit`` for the signature. Equal suffixes are next to each other; conversations of equal
    signature may lie in several tasks."""
    signed = materialize(signed, "repair-signatures")  # the range exchange reads it twice
    spread = F.xxhash64("conv_id")
    ordered = signed.repartitionByRange("reversed", spread).sortWithinPartitions("reversed")
    kind = signed.schema["conv_id"].dataType.simpleString()
    return materialize(ordered.mapInArrow(_audits, f"conv_id {kind}, {FACTS}, cost long, audit string"), "repair-audits")


ROLES = {USER: "user", ASSISTANT: "assistant"}


def _edited(kind: pa.DataType):
    """Rows in order, each conversation led by its audit → the audit again (place 0), then the rows of the repaired conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, own, audit, at, place, state = 0, None, "", 0, 0, START

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            place += 1
            state = SYSTEM if place == 1 and edit == "K" and role[:1] == "s" else ASSISTANT if state == USER else USER
            out.append((own, place, edit, role if edit == "K" else ROLES[state], text))

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"]
            )
            out.clear()
            return made

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", "", "")
                at += 1

        for batch in batches:
            for conv, head, role, text, copies in zip(*batch.columns, strict=True):
                if head.as_py():
                    insertions()
                    own, audit, at, place, state = conv.as_py(), text.as_py(), 0, 0, START
                    out.append((own, 0, audit, None, None))
                else:
                    role, text = role.as_py(), text.as_py()
                    for _ in range(copies.as_py()):
                        insertions()
                        if audit[at] != "D":
                            put(audit[at], role, text)
                            size += len(text)
                        at += 1
                        if size > BATCH_CHARS or len(out) >= BATCH_ROWS:
                            yield batch_of()
                            size = 0
        insertions()
        if out:
            yield batch_of()

    return run


def edited_rows(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``damage`` rows and their ``audits`` → ``(conv_id, place, edit, role, text)`` in order within conversations: place 0 has the whole
    audit as its edit, places from 1 are the repaired rows."""
    none = F.lit(None)
    heads = audited.select(
        "conv_id", F.lit(True).alias("head"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"),
        F.lit(1).cast("long").alias("copies"), none.cast("long").alias("h1"), none.cast("long").alias("h2"),
    )
    body = rows.filter("copies > 0").select("conv_id", F.lit(False).alias("head"), "turn", "role", "text", "copies", *_digests())
    ordered = _in_order(heads.unionByName(body), F.desc("head")).select("conv_id", "head", "role", "text", "copies")
    kind = rows.schema["conv_id"].dataType
    return ordered.mapInArrow(_edited(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")


def _hashed(kind: pa.DataType):
    """The digest of each conversation's ``role:text`` lines, from ``edited_rows`` as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            done = []
            for conv, place, role, text in zip(*batch.columns, strict=True):
                place = place.as_py()
                if place == 0:
                    if digest:
                        done.append((own, digest.hexdigest()))
                    own, digest = conv.as_py(), hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place > 1 else ''}{role.as_py()}:{text.as_py()}".encode())
            if done:
                yield made(done)
        if digest:
            yield made([(own, digest.hexdigest())])

    return run


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The damaged table's repair: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` and ``edited_rows``."""
    rows = damage(conversations, conv_id, turn, role, text)
    audited = audits(signatures(faults(rows)))
    return audited, edited_rows(rows, audited)


def repaired_digests(audited: DataFrame, edited: DataFrame) -> DataFrame:
    """Audits with ``repaired_sha256``. The digest follows the rows in their order, without another exchange of texts."""
    kind = audited.schema["conv_id"].dataType
    hashed = edited.select("conv_id", "place", "role", "text").mapInArrow(
        _hashed(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, repaired_sha256 string"
    ).withColumnRenamed("conv_id", "of")
    return audited.join(hashed, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

"""Cheapest repair of conversations that should read ``(system)? (user assistant)+``.

Every row of a conversation is kept, given another role or deleted, and rows with an empty text may be
inserted anywhere.  The cheapest edits are found by a Viterbi search over four states (nothing yet,
system, user, assistant).  A state's survivor is a leaf of a tree of backpointers with reference counts:
a leaf that loses gives its branch back, and as long as all survivors descend from one edit, that edit
is final, is written to the audit and to the digest of the repaired text, and leaves the tree.  So a
conversation of any length is read as a stream, and only the stretch not yet agreed on is held.

Equal costs are decided by the whole unresolved suffixes of the survivors, ASCII-least first.  Their
order is carried along as short labels that compare as those suffixes do (a label extends another one
where its suffix extends the other's), so that a tie costs the same wherever the suffixes part.  A survivor that
another one beats whatever follows (the empty state behind an answer, mostly) is given up at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Cost of giving another role, of deleting, of inserting, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States by the initial of the last role; the empty state and the one after an assistant may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role initial) to the next state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ORDERLY = {"su", "ua", "au"}
#: What a row that is not kept as it is, or is added, becomes in each state it leads to.
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
#: (state, other): what the rest costs at most more from ``other`` than from ``state``.  From an assistant a
#: system row can be deleted where the empty state keeps it; an inserted answer leads from a user to there.
LEEWAY = {(START, ASSISTANT): DELETE, (SYSTEM, ASSISTANT): 0, (START, USER): DELETE + INSERT, (SYSTEM, USER): INSERT}
LEEWAY |= {(USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT}
WHITE = " \t\n\x0b\x0c\r"


class Node:
    """An edit; ``kids`` holds its references, those of edits that follow and one of its survivor."""

    __slots__ = ("parent", "kids", "letter", "line")

    def __init__(self, parent: Node | None, letter: str, line: bytes | None):
        self.parent, self.letter, self.line = parent, letter, line
        self.kids: set = set()
        if parent is not None:
            parent.kids.add(self)


class Search:
    """Viterbi search over the rows of one conversation, one row at a time."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = 0
        self.held = self.most_held = 0
        #: state: (cost, label, node)
        self.alive = {START: (0, "0", self.root)}
        self._settle({START: (0, "0", self.root, [])})

    def row(self, role: bytes, text: bytes, fault: str) -> None:
        """Take the next row; ``fault`` is '', 'blank', 'duplicate' or 'truncated'."""
        initial = role[:1].decode("latin-1")
        extra = TRUNCATED if fault == "truncated" else 0
        best: dict[int, tuple] = {}

        def offer(state, cost, label, node, edit):
            known = best.get(state)
            if known is None or (cost, label) < known[:2]:
                best[state] = (cost, label, node, [edit])

        for state, (cost, label, node) in self.alive.items():
            offer(state, cost + DELETE, label + "D", node, ("D", None))
            if fault in ("blank", "duplicate"):
                continue
            kept = NEXT.get((state, initial))
            if kept is not None:
                offer(kept, cost + extra, label + "K", node, ("K", role + b":" + text))
            changed = NEXT.get((state, "u"), NEXT.get((state, "a")))
            offer(changed, cost + REROLE + extra, label + "R", node, ("R", ROLE[changed] + b":" + text))
        self._settle(best)

    def _settle(self, best: dict[int, tuple]) -> None:
        """Let rows be inserted, keep one survivor a state, order them and write what is final."""
        for _ in range(3):
            for state, (cost, label, node, edits) in list(best.items()):
                after = NEXT.get((state, "u"), NEXT.get((state, "a")))
                known = best.get(after)
                if known is None or (cost + INSERT, label + "I") < known[:2]:
                    best[after] = (cost + INSERT, label + "I", node, [*edits, ("I", ROLE[after] + b":")])
        beaten = [s for (s, o), more in LEEWAY.items() if s in best and o in best and best[s][0] > best[o][0] + more]
        for state in beaten:  # can neither win nor tie any more
            best.pop(state, None)
        former = {id(n): n for _, _, n in self.alive.values()}
        for n in former.values():
            n.kids.add(None)  # held while its followers are made
        made: dict[str, Node] = {}
        alive = {}
        for state, (cost, label, node, edits) in sorted(best.items(), key=lambda b: b[1][1]):
            prefix = label[: len(label) - len(edits)]
            for n, (letter, line) in enumerate(edits):
                prefix += letter
                if prefix not in made:  # survivors with a common beginning share it
                    made[prefix] = Node(node, letter, line)
                    self.held += 1
                node = made[prefix]
            alive[state] = (cost, label, node)
        for _, _, node in alive.values():
            node.kids.add(None)
        current = {id(n) for _, _, n in alive.values()}
        for n in former.values():
            if id(n) not in current:
                self._release(n)
        self.most_held = max(self.most_held, self.held)
        self.alive = self._relabelled(alive)
        self._emit()

    @staticmethod
    def _relabelled(alive: dict[int, tuple]) -> dict[int, tuple]:
        """Labels of one character, or of another label and what follows it, in the order of the old ones."""
        short: list[tuple[str, str]] = []
        fresh = 0
        out = {}
        for state, (cost, label, node) in sorted(alive.items(), key=lambda b: b[1][1]):
            base = next(((o, s) for o, s in reversed(short) if label.startswith(o)), None)
            if base is None:
                new, fresh = str(fresh), fresh + 1
            else:
                new = base[1] + label[len(base[0]) :]
            short.append((label, new))
            out[state] = (cost, new, node)
        return out

    def _release(self, node: Node) -> None:
        node.kids.discard(None)
        while not node.kids and node.parent is not None:
            node.parent.kids.discard(node)
            self.held -= 1
            node = node.parent

    def _emit(self) -> None:
        while len(self.root.kids) == 1 and None not in self.root.kids:
            (self.root,) = self.root.kids
            self.root.parent = None
            self.held -= 1
            self._write(self.root)

    def _write(self, node: Node) -> None:
        self.audit.append(node.letter)
        if node.line is not None:
            self.digest.update(b"\n" + node.line if self.lines else node.line)
            self.lines += 1

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired rows)."""
        ends = [self.alive[s] for s in (START, ASSISTANT) if s in self.alive]
        cost, _, node = min(ends, key=lambda e: e[:2])
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for node in reversed(rest):
            self._write(node)
        return cost, "".join(self.audit), self.digest.hexdigest()


class Conversation:
    """Counts and the search of one conversation, fed with its rows in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.search = Search()
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = self.first_of = None

    def take(self, turn, role: bytes, text: bytes, digest: bytes, shape: str) -> None:
        if shape == "first":
            self.first_of = (turn, digest)
            return
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        initial = role.decode()[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ORDERLY
        self.initial = initial
        fault = shape
        if shape != "blank":
            if self.first_of == (turn, digest):
                self.first_of = None
            else:
                fault = "duplicate"
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.search.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        cost, audit, digest = self.search.finish()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows are read by turn, null turns first; rows of one turn by role and a digest of
    their content.  A null role or text is one space and a null id is an id of its own.  A role of no
    letters matches no place, so such a row gets another role or goes.  Where ``present`` is false a row
    counts only for its conversation to appear; a conversation without other rows has zeros, an empty
    audit and the digest of an empty text.  An empty table gives no row; other columns are left out.

    Later rows with the role and text of an earlier one are told from a first place per content, aggregated
    before the shuffle, which travels as a row of its own just before the row it names: no set of contents
    is held and no content is joined.  A conversation is one stream of one task (its digest and audit are one
    value each), with the unresolved stretch as the only state.
    """
    kind = rows.schema[conv_id].dataType.simpleString()
    when = rows.schema[turn].dataType.simpleString()
    space = F.lit(" ")
    content = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    core = F.rtrim(F.col("text"), F.lit(WHITE))
    closed = F.substring(core, -1, 1).isin(".", "!", "?")
    shape = F.when(~F.col("present"), "absent").when(core == "", "blank").when(closed, "").otherwise("truncated")
    given = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
    )
    given = given.withColumn("digest", F.unhex(F.md5(content.cast("binary")))).withColumn("shape", shape)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = given.where(F.col("shape").isin("", "truncated")).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("at"))
    first = first.select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit("").alias("text"), "digest", F.lit("first").alias("shape"))
    stream = given.select("conv_id", "turn", "role", F.when(F.col("present"), F.col("text")).otherwise("").alias("text"), "digest", "shape").unionByName(first)
    stream = stream.select("conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "digest", "shape")
    ahead = (F.col("shape") != "first").alias("row")
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", ahead)
    layout = f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    types = [to_arrow_type(rows.schema[conv_id].dataType), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, done = None, []
        for b in batches:
            for cid, at, who, said, digest, shape in zip(*(c.to_pylist() for c in b.columns)):
                if open_one is None or open_one.conv_id != cid:
                    if open_one is not None:
                        done.append(open_one.result())
                    open_one = Conversation(cid)
                if shape != "absent":
                    open_one.take(at, who, said, digest, shape)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done = []
        if open_one is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(open_one.result(), types)], names)

    return stream.mapInArrow(searched, layout)


def with_damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows dropped, emptied, unpunctuated, repeated or given to the user.

    crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 chooses: 0 drops the row (``present`` is false), 1
    empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in (conv_id, turn)])
    given = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"),
    )
    fate = F.col("fate")
    said = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    who = F.when(fate == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    damaged = given.select("conv_id", "turn", who.alias("role"), said.alias("text"), (fate != 0).alias("present"), copies.alias("copy"))
    return damaged.drop("copy")

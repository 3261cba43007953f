"""Operator 12: repair of conversation structure by a persistent audit DP.

A conversation's role initials must read ``(s?(ua)+)?``.  Rows are kept (K, no
cost), given the role user or assistant (R, 2) or deleted (D, 3; a must for
blank and duplicate rows); empty rows of user or assistant may be inserted (I,
2); a truncated row that stays costs 1 more.  The cheapest edits win, ties the
least string of letters.

The DP goes row by row and holds the best edits for each of four states
(nothing yet, after system, after user, after assistant).  Edits are nodes that
link to the edit before, so states share their common beginnings; each node has
its depth, a rolling hash of the letters up to it and ancestors 1, 2, 4, ...
steps back.  States of equal cost are told apart by their longest common prefix,
searched by hash over the ancestors and then verified letter by letter down to
the node that both share.  (No string of equal cost and rows is a prefix of
another, since each further letter costs, so the lesser beginning stays the
lesser one.)

What all states share is final: it is given out and forgotten, so memory holds
the undecided end of a conversation and not the conversation.  One shuffle by
conversation; rows stream through the task in their order, and duplicates are
found by a window on the same partitions.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: 0 nothing, 1 after system, 2 after user, 3 after assistant.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after a row of the one role that may follow, and that role.
TURN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
#: Nodes after which the shared beginning is given out.
NODES = 2048
MOD, BASE = (1 << 61) - 1, 1_000_003


class Edits:
    """Strings of edits as nodes of a tree; node 0 is the empty string."""

    def __init__(self, mod: int = MOD):
        self.mod = mod
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        up, back, k = [node], self.up[node], 0
        while k < len(back):  # the ancestor 2^(k+1) back is 2^k back from the one 2^k back
            node, k = back[k], k + 1
            up.append(node)
            back = self.up[node]
        self.letter.append(letter)
        self.depth.append(self.depth[up[0]] + 1)
        self.hash.append((self.hash[up[0]] * BASE + ord(letter)) % self.mod)
        self.up.append(up)
        return len(self.up) - 1

    def back(self, node: int, depth: int) -> int:
        """The ancestor of that depth."""
        off = self.depth[node] - depth
        while off:
            node = self.up[node][off.bit_length() - 1]
            off -= 1 << (off.bit_length() - 1)
        return node

    def spell(self, node: int, to: int = 0) -> str:
        """The letters after node ``to`` up to ``node``."""
        out = []
        while node != to:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Is the string of ``a`` before that of ``b``?"""
        if a == b:
            return False
        least = min(self.depth[a], self.depth[b])
        x, y = self.back(a, least), self.back(b, least)
        if self.hash[x] == self.hash[y]:  # one begins with the other, or the hash lies
            return self.depth[a] < self.depth[b] if self._same(x, y) else self.spell(a) < self.spell(b)
        for k in reversed(range(least.bit_length())):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] == self.letter[y] or not self._same(self.up[x][0], self.up[y][0]):
            return self.spell(a) < self.spell(b)
        return self.letter[x] < self.letter[y]

    def _same(self, a: int, b: int) -> bool:
        """Verifies that two strings of one hash and length are equal."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that all the strings go through."""
        root = nodes[0]
        for other in nodes[1:]:
            least = min(self.depth[root], self.depth[other])
            x, y = self.back(root, least), self.back(other, least)
            if x != y:
                for k in reversed(range(least.bit_length())):
                    if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                        x, y = self.up[x][k], self.up[y][k]
                x = self.up[x][0]
            root = x
        return root

    def regrow(self, root: int, tips: list[int]) -> tuple[Edits, dict[int, int]]:
        """A tree of what lies between ``root`` and the tips, and the tips' new nodes."""
        wanted = set()
        for node in tips:
            while node != root and node not in wanted:
                wanted.add(node)
                node = self.up[node][0]
        tree, new = Edits(self.mod), {root: 0}
        for node in sorted(wanted):  # a node is younger than the one before it
            new[node] = tree.add(new[self.up[node][0]], self.letter[node])
        return tree, new


class Repair:
    """The DP over one conversation.  ``give(edit, role, text)`` gets the edits
    in order as they become final; for a deleted row with its own role."""

    def __init__(self, give, nodes: int = NODES):
        self.give, self.limit, self.nodes = give, nodes, nodes
        self.tree, self.rows, self.at = Edits(), deque(), 0
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def _offer(self, best: list, state: int, cost: int, node: int, letter: str) -> None:
        """``best`` holds (cost, node, letter); the node of a tie is made to compare."""
        old = best[state]
        if old is None or cost < old[0]:
            best[state] = (cost, node, letter)
        elif cost == old[0]:
            a, b = (n if not x else self.tree.add(n, x) for n, x in ((node, letter), old[1:]))
            best[state] = (cost, a if self.tree.less(a, b) else b, "")

    def _made(self, best: list) -> list:
        return [x and (x[0], self.tree.add(x[1], x[2]) if x[2] else x[1]) for x in best]

    def _insert(self) -> None:
        """Insertions: a user row from any state, then an assistant row."""
        for sources, target in (((0, 1, 3), 2), ((2,), 3)):
            best = [x and (*x, "") for x in self.best]
            for s in sources:
                if self.best[s]:
                    self._offer(best, target, self.best[s][0] + 2, self.best[s][1], "I")
            self.best = self._made(best)

    def row(self, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        new, more = [None] * 4, int(fault == TRUNCATED)
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._offer(new, state, cost + 3, node, "D")
            if fault not in (BLANK, DUPLICATE):
                if (to := KEEP[state].get(role[:1])) is not None:
                    self._offer(new, to, cost + more, node, "K")
                self._offer(new, TURN[state][0], cost + 2 + more, node, "R")
        self.best = self._made(new)
        self._insert()
        # after an assistant row all goes on that can after nothing or a system row, but for
        # keeping a system row, and deleting that costs 3
        done = self.best[3]
        for state, gain in ((0, 3), (1, 0)):
            if done and self.best[state] and done[0] + gain < self.best[state][0]:
                self.best[state] = None
        if len(self.tree.up) > self.limit:
            self._settle()

    def _settle(self) -> None:
        tips = [x[1] for x in self.best if x]
        root = self.tree.shared(tips)
        self._give(self.tree.spell(root))
        self.tree, new = self.tree.regrow(root, tips)
        self.best = [x and (x[0], new[x[1]]) for x in self.best]
        self.limit = 2 * len(self.tree.up) + self.nodes

    def _give(self, letters: str) -> None:
        for letter in letters:
            if letter == "I":
                self.at, role = TURN[self.at]
                self.give(letter, role, "")
                continue
            role, text = self.rows.popleft()
            if letter == "K":
                self.at = KEEP[self.at][role[:1]]
            elif letter == "R":
                self.at, role = TURN[self.at]
            self.give(letter, role, text)

    def finish(self) -> int:
        """Gives out the rest and returns the cost."""
        best = [None]
        for state in ENDS:
            if self.best[state]:
                self._offer(best, 0, *self.best[state], "")
        (cost, node), = self._made(best)
        self._give(self.tree.spell(node))
        return cost


class Counts:
    """What is counted over a conversation's rows in their order."""

    def __init__(self):
        self.n = self.illegal = self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.last = self.low = self.high = None

    def row(self, turn, role: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.n > 0 and self.last + role[:1] not in LEGAL
        self.n, self.last = self.n + 1, role[:1]
        if turn is not None and turn != self.high:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal


def ordered_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """(conv, turn, role, text, present, fault): each conversation's rows in one
    task, by turn (nulls first), then role and text, with each row's first fault."""
    own = rows.select(rows[conv].alias("conv"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"), (F.coalesce(rows[present], F.lit(True)) if present else F.lit(True)).alias("present"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    own = own.repartition("conv").withColumn("key", F.when(F.col("present"), key))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "key").orderBy(F.col("turn").asc_nulls_first())))
    trimmed = F.rtrim("text", F.lit(WHITE))
    fault = (F.when(trimmed == "", F.lit(BLANK)).when(F.col("nth") > 1, F.lit(DUPLICATE))
             .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(0)))
    own = own.withColumn("fault", fault).sortWithinPartitions(F.col("conv").asc_nulls_first(), *order, "nth")
    return own.select("conv", "turn", "role", "text", "present", "fault")


def _conversations(batches, begin):
    """Walks sorted rows; ``begin()`` makes what takes a conversation's rows
    (``row``) and yields its output at the end (``finish(conv)``) and before."""
    held, now = None, None
    for batch in batches:
        for conv, turn, role, text, present, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if now is None or conv != held:
                if now is not None:
                    yield from now.finish(held)
                held, now = conv, begin()
            if present:
                yield from now.row(conv, turn, role, text, fault)
    if now is not None:
        yield from now.finish(held)


class _Audit:
    """One conversation's audit: counts, cost, letters and the repaired text's hash."""

    def __init__(self):
        self.counts, self.sha, self.letters, self.first = Counts(), hashlib.sha256(), [], True
        self.repair = Repair(self.give)

    def give(self, letter, role, text):
        self.letters.append(letter)
        if letter != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def row(self, conv, turn, role, text, fault):
        self.counts.row(turn, role, fault)
        self.repair.row(role, text, fault)
        return ()

    def finish(self, conv):
        cost = self.repair.finish()
        yield conv, *self.counts.values(), cost, "".join(self.letters), self.sha.hexdigest()


class _Rows:
    """One conversation's repaired rows."""

    def __init__(self):
        self.out, self.place = [], 0
        self.repair = Repair(self.give)

    def give(self, letter, role, text):
        if letter != "D":
            self.out.append((self.place, letter, role, text))
            self.place += 1

    def _drain(self, conv):
        out, self.out = self.out, []
        return [(conv, *r) for r in out]

    def row(self, conv, turn, role, text, fault):
        self.repair.row(role, text, fault)
        return self._drain(conv) if self.out else ()

    def finish(self, conv):
        self.repair.finish()
        return self._drain(conv)


def _mapped(rows: DataFrame, kind, columns: list[tuple[str, T.DataType]], conv: str, **names) -> DataFrame:
    ready = ordered_rows(rows, conv, **names)
    schema = T.StructType([T.StructField(conv, ready.schema["conv"].dataType), *[T.StructField(n, t) for n, t in columns]])
    arrow = T.StructType(schema.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out, size = to_arrow_schema(arrow), [], 0
        for r in _conversations(batches, kind):
            out.append(r)
            size += sum(len(x) for x in r if isinstance(x, str))
            if len(out) == 1000 or size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), own, strict=True)], schema=own)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), own, strict=True)], schema=own)
    return ready.mapInArrow(run, schema)


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows go by turn (null first), then role and text.  A null role or text is
    one space; null ids are one conversation.  Rows whose ``present`` is false
    only say that their conversation exists; one without others has zeros, an
    empty audit and the empty string's hash.  Repeated rows are duplicates; a
    role that begins neither with s, u nor a is never kept.  A very long
    conversation streams through its task (the hash of its whole text goes by
    it in order anyway) and a very long text is held once.  An empty table
    gives no rows; other columns are not read."""
    long = T.LongType()
    columns = [(c, long) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [(c, T.StringType()) for c in ("audit", "repaired_sha256")]
    return _mapped(rows, _Audit, columns, conv, turn=turn, role=role, text=text, present=present)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """The repaired conversations: (conv, place, edit, role, text), edits K, R
    and I.  Rows come out as soon as their edits are final.  Odd rows as in
    ``audit``."""
    columns = [("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    return _mapped(rows, _Rows, columns, conv, turn=turn, role=role, text=text, present=present)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32(conv_id:turn) % 20 (a null is one
    space): 0 drops the row (``present`` false), 1 empties the text, 2 removes
    its sentence ends, 3 repeats the row, 4 sets the role user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(rows["conv_id"].cast("string"), blank), F.lit(":"), F.coalesce(rows["turn"].cast("string"), blank))
    own = rows.select(rows["conv_id"], rows["turn"], F.coalesce(rows["role"], blank).alias("role"), F.coalesce(rows["text"], blank).alias("text"),
                      (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")
    return own.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), copies)

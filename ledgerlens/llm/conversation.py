"""Repair of conversations by a Viterbi search whose survivors coalesce.

A conversation's turns, in order, are edited at the least cost so that their
role initials are a system turn at most and then pairs of user and assistant:
``(s?(ua)+)?``.  Keep costs 0, Rerole (to user or assistant) 1, Delete 2 and
Insert of an empty user or assistant turn 5; a blank turn or a duplicate must be
deleted, and a truncated turn that stays costs 5 more.  The initials of the
edits in order, K, R, D and I, are the audit; of the cheapest edits the audit
that is least in ASCII order is taken.  It alone fixes the result: what a
reroled or inserted turn becomes follows from the turns before it.

One pass over the sorted turns keeps a survivor for each of four states: nothing
yet, after the system turn, after a user turn, after an assistant turn.  Their
edits form a tree of back pointers with reference counts.  A survivor that
another one beats whatever follows is dropped; as soon as all survivors share an
ancestor, the edits up to it are final and are emitted, and their nodes go.

Ties compare complete unresolved suffixes: survivors that have taken the same
turns never hold one suffix inside another, as it would have to go on with
inserts that cost more, so the order of their whole suffixes is settled at the
first difference and is carried along as a rank.

Turns are dealt out by conversation and streamed in order: nothing of the size
of a conversation is gathered.  A survivor carries the running digest of its
repaired turns and not the turns; what grows with a conversation is its audit,
and turns whose edits are open in :func:`repaired_turns`.  A digest of a whole
conversation is a chain, so one conversation is the work of one task; its turns
are sorted outside of Python, where they spill.

Defined cases: a null role or text is one space, so blank or of no known
initial; a null turn comes first and is no part of the gaps; null conversation
ids are one conversation; turns of equal number are ordered by role and text,
and equal rows are all there, the later ones duplicates; a conversation without
turns has an empty audit; an empty role has no initial and cannot be kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, map_arrow, slices

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NEXT = (USER, USER, ASSISTANT, USER)  # where a reroled or inserted turn leads
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_WHITE = " \t\n\x0b\x0c\r"
_END = ".!?"
AUDIT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Edit:
    """A node of the tree: one edit; ``refs`` counts its children and survivors."""

    __slots__ = ("after", "letter", "parent", "refs", "role")

    def __init__(self, parent: _Edit | None, letter: str, role: str | None):
        self.parent, self.letter, self.role, self.refs = parent, letter, role, 0
        self.after: dict[str, _Edit] = {}


class Digest:
    """SHA-256 of ``role:text`` lines, joined by line feeds; never changed in
    place, so survivors share it."""

    __slots__ = ("hash", "some")

    def __init__(self, state=None, some: bool = False):
        self.hash, self.some = state or hashlib.sha256(), some

    def add(self, role: str, text: bytes) -> Digest:
        state = self.hash.copy()
        state.update((b"\n" if self.some else b"") + role.encode() + b":")
        state.update(text)
        return Digest(state, True)


class Repair:
    """The search over one conversation; ``emitted`` gets the final edits as
    (letter, new role) and may be emptied at any time."""

    def __init__(self):
        self.root = _Edit(None, "", None)
        self.root.refs = 1
        # of each state: last edit, cost, rank of the suffix at the last turn, inserts since, digest
        self.live: list[tuple | None] = [(self.root, 0, 0, "", Digest()), None, None, None]
        self.emitted: list[tuple[str, str | None]] = []
        self._insert()

    def _child(self, parent: _Edit, letter: str, role: str | None) -> _Edit:
        node = _Edit(parent, letter, role)
        parent.after[letter] = node
        parent.refs += 1
        node.refs = 1
        return node

    def _release(self, node: _Edit) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            parent = node.parent
            del parent.after[node.letter]
            parent.refs -= 1
            node = parent

    def _insert(self) -> None:
        """Inserted turns, where they are cheaper than what reaches the state."""
        live = self.live
        for state, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for source in sources:
                s = live[source]
                if s is None:
                    continue
                old, new = live[state], (s[1] + INSERT, s[2], s[3] + "I")
                if old is None or new < old[1:4]:
                    node = self._child(s[0], "I", _ROLE[state])
                    live[state] = (node, *new, s[4].add(_ROLE[state], b""))
                    if old is not None:
                        self._release(old[0])

    def _settle(self) -> None:
        live, a = self.live, self.live[ASSISTANT]
        # what follows "nothing yet" follows an assistant turn too, with a system turn deleted at most
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            s = live[state]
            if a is not None and s is not None and s[1] > a[1] + more:
                self._release(s[0])
                live[state] = None
        root = self.root
        while root.refs == 1 and root.after:
            (root,) = root.after.values()
            self.emitted.append((root.letter, root.role))
            root.parent = None
        self.root = root

    def turn(self, role: str, text: bytes, unusable: bool, truncated: bool) -> None:
        """Take the next turn; ``unusable`` ones, blank or duplicate, must go."""
        live, initial = self.live, role[:1]
        best: list[tuple | None] = [None] * 4  # key, source, letter, new role
        for source, s in enumerate(live):
            if s is None:
                continue
            _, cost, rank, tail, _ = s
            ways = [(source, cost + DELETE, "D", None)]
            if not unusable:
                stay = cost + CUT_OFF * truncated
                if initial in _KEEP[source]:
                    ways.append((_KEEP[source][initial], stay, "K", role))
                ways.append((_NEXT[source], stay + REROLE, "R", _ROLE[_NEXT[source]]))
            for state, total, letter, new in ways:
                key = (total, rank, tail + letter)
                if best[state] is None or key < best[state][0]:
                    best[state] = (key, source, letter, new)
        order = {state: i for i, state in enumerate(sorted((s for s in range(4) if best[s]), key=lambda s: best[s][0][1:]))}
        after: list[tuple | None] = [None] * 4
        for state in order:
            (total, _, _), source, letter, new = best[state]
            digest = live[source][4]
            after[state] = (self._child(live[source][0], letter, new), total, order[state], "", digest if new is None else digest.add(new, text))
        for s in live:
            if s is not None:
                self._release(s[0])
        self.live = after
        self._insert()
        self._settle()

    def end(self) -> tuple[int, str]:
        """Emit what is left; returns the cost and the digest in hexadecimal."""
        _, last = min((s[1:4], s) for s in (self.live[START], self.live[ASSISTANT]) if s is not None)
        node, rest = last[0], []
        while node is not self.root:
            rest.append((node.letter, node.role))
            node = node.parent
        self.emitted += rest[::-1]
        return last[1], last[4].hash.hexdigest()


# --- Spark jobs ----------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that ``crc32(conv_id:turn) % 20`` chooses: 0 drops
    the turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it
    a user's.  A dropped turn stays as a row that is not ``live``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), fault.alias("fault"))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", _END, "")).otherwise(F.col("text")).alias("text"),
                    (F.col("fault") != 0).alias("live"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
            .drop("again"))


def _ordered(turns: DataFrame, key: str, live: Column | None) -> DataFrame:
    """Turns dealt out by conversation, in order, with their faults.  Only this
    exchange moves texts: what finds duplicates is clustered by it already."""
    rows = turns.select(F.col(key).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if live is None else live).alias("live"))
    gone = ~F.col("live")
    rows = rows.select("conv", "live", *[F.when(gone, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("turn", "role", "text")])
    again = F.row_number().over(Window.partitionBy("conv", "live", "role", "text").orderBy("turn")) > 1
    left = F.rtrim("text", F.lit(_WHITE))
    fault = (F.when(left == "", "blank").when(F.col("again"), "duplicate")
             .when(~F.contains(F.lit(_END), F.right(left, F.lit(1))), "truncated"))
    return (rows.repartition("conv").withColumn("again", again)
            .sortWithinPartitions("conv", "turn", "role", "text", "again")
            .select("conv", "turn", "role", F.col("text").cast("binary").alias("text"), F.when(F.col("live"), F.coalesce(fault, F.lit("none"))).alias("fault")))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, tuple | None]]:
    """Each conversation's key with each of its rows, and with None at its end."""
    now = none = object()
    for piece in slices(batches, "text"):
        for key, *row in zip(*(column(piece, c).to_pylist() for c in ("conv", "turn", "role", "text", "fault")), strict=True):
            if key != now:
                if now is not none:
                    yield now, None
                now = key
            yield key, row
    if now is not none:
        yield now, None


def _typed(turns: DataFrame, key: str) -> str:
    return f"`{key}` {turns.schema[key].dataType.simpleString()}"


def audits(turns: DataFrame, *, key: str = "conv_id", live: Column | None = None) -> DataFrame:
    """A row per conversation: its key; ``gaps`` in its turn numbers; how many
    turns are first of all ``blank``, ``duplicate`` and ``truncated``; how many
    neighbours have ``illegal`` initials; the ``cost``, the ``audit`` and the
    SHA-256 of the repaired ``role:text`` lines.  Rows that are not ``live``
    only tell that there is such a conversation."""
    schema = f"{_typed(turns, key)}, {AUDIT}"
    names = [key, *(x.split()[0] for x in AUDIT.split(", "))]
    kind = turns.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        fresh = lambda: (Repair(), dict.fromkeys(("blank", "duplicate", "truncated", "none"), 0), [])
        repair, seen, audit = fresh()
        first = last = before = None
        numbers = illegal = 0
        for conv, row in _conversations(batches):
            if row is None:
                cost, digest = repair.end()
                audit += [x for x, _ in repair.emitted]
                gaps = last - first + 1 - numbers if numbers else 0
                rows.append((conv, gaps, seen["blank"], seen["duplicate"], seen["truncated"], illegal, cost, "".join(audit), digest))
                repair, seen, audit = fresh()
                first = last = before = None
                numbers = illegal = 0
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows = []
                continue
            turn, role, text, fault = row
            if fault is None:
                continue
            if turn is not None and turn != last:
                first, last, numbers = (turn if first is None else first), turn, numbers + 1
            if before is not None and before + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            before = role[:1]
            seen[fault] += 1
            repair.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")
            if len(repair.emitted) >= 4096:
                audit.append("".join(x for x, _ in repair.emitted))
                repair.emitted.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in run(batches):  # keys that are all null have no type of their own
            yield b.set_column(0, key, b.column(0).cast(to_arrow_type(kind)))

    return map_arrow(_ordered(turns, key, live), typed, schema)


def repaired_turns(turns: DataFrame, *, key: str = "conv_id", live: Column | None = None) -> DataFrame:
    """Every edit in order: key, ``place`` (from 0), ``edit`` (K, R, D or I), the
    turn's ``old_role``, ``fault`` and ``turn`` (null for an insert), and ``role``
    and ``text`` of the repaired turn (null if deleted)."""
    schema = f"{_typed(turns, key)}, place long, edit string, old_role string, fault string, turn long, role string, text string"
    names = [key, "place", "edit", "old_role", "fault", "turn", "role", "text"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    kind = turns.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        rows: list[tuple] = []
        waiting: deque[tuple] = deque()
        repair, place = Repair(), 0

        def settled(conv: object) -> None:
            nonlocal place
            for letter, role in repair.emitted:
                turn, old, text, fault = waiting.popleft() if letter != "I" else (None, None, b"", None)
                rows.append((conv, place, letter, old, fault, turn, role, None if role is None else text.decode()))
                place += 1
            repair.emitted.clear()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t or to_arrow_type(kind)) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        for conv, row in _conversations(batches):
            if row is None:
                repair.end()
                settled(conv)
                repair, place = Repair(), 0
            elif row[3] is not None:
                turn, role, text, fault = row
                waiting.append((turn, role, text, fault))
                repair.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")
                settled(conv)
            if len(rows) >= 2_000:
                yield batch()
        if rows:
            yield batch()

    return map_arrow(_ordered(turns, key, live), run, schema)


def conversation_audits(conversations: DataFrame) -> DataFrame:
    """Audits of damaged conversations."""
    return audits(damaged(conversations), live=F.col("live"))


_WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The same by a table of states for each turn, in SQL.
ORACLE = f"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS f
  FROM keyed, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE f <> 0),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
placed AS (
  SELECT conv_id, turn, role, text, again,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
         substr(role, 1, 1) AS c, rtrim(text, {_WHITE_SQL}) AS stripped FROM marked),
turns AS (
  SELECT *, CASE WHEN stripped = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT regexp_matches(stripped, '[.!?]$') THEN 'truncated' ELSE 'none' END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         max(i) AS n FROM turns GROUP BY conv_id),
-- inserts before each turn and at the end: from a state, to a state, how many, their text
inserts AS (SELECT * FROM (VALUES ('', '', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''),
  ('', 'u', 'I', 'u'), ('', 'a', 'II', 'ua'), ('s', 'u', 'I', 'u'), ('s', 'a', 'II', 'ua'), ('u', 'a', 'I', 'a'), ('a', 'u', 'I', 'u')) v(was, st, ins, what)),
lines AS (SELECT was, st, ins, length(ins) * 5 AS cost,
                 list_transform(range(1, length(what) + 1), lambda j: CASE substr(what, j, 1) WHEN 'u' THEN 'user:' ELSE 'assistant:' END) AS made FROM inserts),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS st, {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} AS p FROM counts
  UNION ALL
  SELECT conv_id, i, st, min(p) FROM (
    SELECT b.conv_id, t.i, e.st,
           {{'cost': b.p.cost + x.cost + e.cost + CASE WHEN e.letter <> 'D' AND t.fault = 'truncated' THEN 5 ELSE 0 END,
             'audit': b.p.audit || x.ins || e.letter,
             'made': list_concat(list_concat(b.p.made, x.made), CASE WHEN e.letter = 'D' THEN []::VARCHAR[]
                       ELSE [CASE WHEN e.letter = 'K' THEN t.role WHEN e.st = 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text] END)}} AS p
    FROM paths b JOIN lines x ON x.was = b.st JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1
    JOIN (VALUES ('', 's', 'K', 's', 0), ('', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0), ('a', 'u', 'K', 'u', 0),
                 ('', 'u', 'R', '', 1), ('s', 'u', 'R', '', 1), ('u', 'a', 'R', '', 1), ('a', 'u', 'R', '', 1),
                 ('', '', 'D', '', 2), ('s', 's', 'D', '', 2), ('u', 'u', 'D', '', 2), ('a', 'a', 'D', '', 2)) e(was, st, letter, need, cost)
      ON e.was = x.st AND (e.need = '' OR e.need = t.c) AND (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate'))) s
  GROUP BY conv_id, i, st),
done AS (
  SELECT b.conv_id, min({{'cost': b.p.cost + x.cost, 'audit': b.p.audit || x.ins, 'made': list_concat(b.p.made, x.made)}}) AS p
  FROM paths b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN lines x ON x.was = b.st
  WHERE x.st IN ('', 'a') GROUP BY b.conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(d.p.cost, 0)::BIGINT AS cost,
       coalesce(d.p.audit, '') AS audit, sha256(coalesce(array_to_string(d.p.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""

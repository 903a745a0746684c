"""Conversation structure repair: the cheapest edits after which roles alternate, by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickloom.llm.text import byte_bounded
from tickloom.session import scratch_table

#: Different messages of one lattice; a longer conversation is a chain of lattices.
RUN = 128
#: What counts as white space here.
BLANKS = " \t\n\x0b\f\r"

_COST = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
#: States: nothing said yet, or the initial of the last role. Who may speak next.
_STATES = "0sua"
_NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
_NAME = {"u": "user", "a": "assistant"}

Best = tuple[int, str]  # cost, audit


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, turn, role, text, copies)``: rows that were left out, emptied, unpointed, repeated or given to the user.

    What happens to a row hangs on the CRC of its id and turn, modulo 20. A null role or text is one space, and a null id or
    turn counts as one space in the CRC.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)))
    rows = conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("harm"),
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _marks(messages: DataFrame) -> DataFrame:
    """Messages with what the lattice needs to know of them; ``print`` stands for the text."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return messages.select("id", "turn", "role", F.sha2("text", 256).alias("print"), F.left("role", F.lit(1)).alias("initial"), end.alias("end"), "copies")


def _units(messages: DataFrame) -> DataFrame:
    """One row for each different message of a turn, with its copies, and whether the conversation had it in an earlier turn.

    Copies are counted by a partial aggregate, and the first turn of a message is a partial aggregate too, so neither a
    long conversation nor a message that is said again and again is gathered anywhere.
    """
    units = _marks(messages).groupBy("id", "turn", "role", "print", "initial", "end").agg(F.sum("copies").alias("copies"))
    units = scratch_table(units)
    first = units.groupBy(F.col("id").alias("i"), F.col("role").alias("r"), F.col("print").alias("p")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")
    )
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p"))
    earlier = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return units.join(first, same).select("id", "turn", "role", "print", "initial", "end", "copies", earlier.alias("again"))


def _steps(state: str, symbol: tuple[str, bool, bool, int]) -> Iterator[tuple[str, int, str]]:
    """``(state after, cost, letters)`` for one message and its copies, which go in any case."""
    initial, forced, truncated, copies = symbol
    yield state, _COST["delete"] * copies, "D" * copies
    if forced:
        return
    rest, letters = _COST["delete"] * (copies - 1) + _COST["truncated"] * truncated, "D" * (copies - 1)
    if initial == _NEXT[state] or (state == "0" and initial == "s"):
        yield initial, _COST["keep"] + rest, "K" + letters
    yield _NEXT[state], _COST["rerole"] + rest, "R" + letters


def cheapest(symbols: tuple, entry: str, leave: str) -> Best | None:
    """The cheapest way through a lattice from one state to another; of equal cost the least audit, None if there is no way.

    Nodes are (messages done, state). Both searches take nodes by cost and then by progress; edges without cost always make
    progress, so a node's audit is final when it is taken. Cost follows from the letters, so no audit of a node is the
    beginning of another one of equal cost, and the least whole is made of least parts. The searches go on while the two
    heaps could still meet at the best cost, so all crossings of that cost are seen.
    """
    n = len(symbols)
    ahead: dict[tuple[int, str], Best] = {(0, entry): (0, "")}
    behind: dict[tuple[int, str], Best] = {(n, leave): (0, "")}
    front, back = [(0, 0, entry)], [(0, 0, leave)]
    best = 0 if n == 0 and entry == leave else None

    def reach(labels, others, heap, node, progress, cost, audit):
        nonlocal best
        old = labels.get(node)
        if old is None or (cost, audit) < old:
            labels[node] = (cost, audit)
            if old is None or cost < old[0]:
                heappush(heap, (cost, progress, node[1]))
            if node in others and (best is None or cost + others[node][0] < best):
                best = cost + others[node][0]

    while front and back and (best is None or front[0][0] + back[0][0] <= best):
        if (front[0][0], len(front)) <= (back[0][0], len(back)):
            price, i, state = heappop(front)
            cost, audit = ahead[(i, state)]
            if price > cost or i == n:
                continue
            reach(ahead, behind, front, (i, _NEXT[state]), i, cost + _COST["insert"], audit + "I")
            for after, price, letters in _steps(state, symbols[i]):
                reach(ahead, behind, front, (i + 1, after), i + 1, cost + price, audit + letters)
        else:
            price, left, state = heappop(back)
            i = n - left
            cost, audit = behind[(i, state)]
            if price > cost:
                continue
            for before in _STATES:
                if i < n and _NEXT[before] == state:
                    reach(behind, ahead, back, (i, before), left, cost + _COST["insert"], "I" + audit)
                for after, price, letters in _steps(before, symbols[i - 1]) if i else ():
                    if after == state:
                        reach(behind, ahead, back, (i - 1, before), left + 1, cost + price, letters + audit)
    if best is None:
        return None
    return best, min(ahead[x][1] + behind[x][1] for x in ahead if x in behind and ahead[x][0] + behind[x][0] == best)


def ways(symbols: tuple) -> list[tuple[str, str, int, str]]:
    """``(from, to, cost, audit)`` for all pairs of states that a lattice connects."""
    pairs = [(x, y) for x in _STATES for y in _STATES if not (y == "0" and x != "0") and not (y == "s" and x in "ua")]
    return [(x, y, *found) for x, y in pairs if (found := cheapest(symbols, x, y)) is not None]


#: Short conversations look alike.
_short_ways = lru_cache(maxsize=4096)(ways)


_RUN_COLUMNS = "turn long, role string, print string, part int, number long, opens string, closes string, first_turn long, last_turn long"
_RUN_COLUMNS += ", least long, turns long, blank long, duplicate long, truncated long, illegal long"
_WAYS = "ways array<struct<x: string, y: string, cost: long, audit: string>>"


def _runs(units: DataFrame) -> DataFrame:
    """Lattices of up to ``RUN`` neighbouring messages, in order of turns; a long conversation is spread over many tasks."""
    kind = units.schema["id"].dataType
    schema = f"id {kind.simpleString()}, {_RUN_COLUMNS}, {_WAYS}"
    ordered = units.repartitionByRange("id", "turn", "role", "print").sortWithinPartitions("id", "turn", "role", "print")

    def run(batches):
        from pyspark import TaskContext

        part, number, held, out = TaskContext.get().partitionId(), 0, [], []
        arrow = _arrow_schema(kind)
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == RUN or row["id"] != held[-1]["id"]):
                    out.append(_summary(held, part, number))
                    number, held = number + 1, []
                held.append(row)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if held:
            out.append(_summary(held, part, number))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return ordered.mapInArrow(run, schema)


def _arrow_schema(kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    names = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [pa.field("id", to_arrow_type(kind))] + [pa.field(name, names[t]) for name, t in (x.split() for x in _RUN_COLUMNS.split(", "))]
    way = pa.struct([("x", pa.string()), ("y", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema([*fields, pa.field("ways", pa.list_(way))])


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _summary(rows: list[dict], part: int, number: int) -> dict:
    symbols, blank, duplicate, truncated, illegal, turns = [], 0, 0, 0, 0, 0
    before = None
    for row in rows:
        copies, again, empty = row["copies"], row["again"], row["end"] == ""
        cut = not empty and not again and row["end"] not in ".!?"
        blank += copies if empty else 0
        duplicate += 0 if empty else copies - (not again)
        truncated += cut
        illegal += copies - 1 + (before is not None and not _legal(before["initial"], row["initial"]))
        turns += row["turn"] is not None and (before is None or before["turn"] != row["turn"])
        symbols.append((row["initial"], empty or again, cut, copies))
        before = row
    first, known = rows[0], [r["turn"] for r in rows if r["turn"] is not None]
    out = {k: first[k] for k in ("id", "turn", "role", "print")}
    out |= {"part": part, "number": number, "opens": first["initial"], "closes": before["initial"], "first_turn": first["turn"], "last_turn": before["turn"]}
    out |= {"least": min(known, default=None), "turns": turns, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal}
    return out | {"ways": [dict(zip(("x", "y", "cost", "audit"), way)) for way in (_short_ways if len(symbols) <= 16 else ways)(tuple(symbols))]}


def chained(runs: list[dict]) -> tuple[int, str, list[tuple[str, str]]]:
    """``(cost, audit, [(state, audit) of each run])`` of the cheapest way through the lattices of one conversation.

    Holds about a dozen bytes a message, as many as there are pairs of states; the audit itself has one.
    """
    best, back = {"0": (0, "")}, []
    for r in runs:
        reached: dict[str, Best] = {}
        came: dict[str, dict] = {}
        for way in r["ways"]:
            if way["x"] in best:
                cost, audit = best[way["x"]]
                found = (cost + way["cost"], audit + way["audit"])
                if way["y"] not in reached or found < reached[way["y"]]:
                    reached[way["y"]], came[way["y"]] = found, way
        best = reached
        back.append(came)
    ends = {"0": "", "a": "", "u": "I", "s": "II"}
    cost, audit, state = min((c + _COST["insert"] * len(ends[s]), a + ends[s], s) for s, (c, a) in best.items())
    pieces = []
    tail = ends[state]
    for came in reversed(back):
        way = came[state]
        state = way["x"]
        pieces.append((state, way["audit"] + tail))
        tail = ""
    return cost, audit, pieces[::-1]


_CHOSEN = "turn long, role string, print string, state string, piece string, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def chosen_edits(messages: DataFrame) -> DataFrame:
    """The edits of each run of messages, one row each; the row with ``whole`` also tells of the whole conversation.

    ``messages`` are ``(id, turn, role, text, copies)``. Order is by turn, nulls first, then role, then a digest of the text;
    copies stand side by side. A conversation with a null id is one of its own.
    """
    runs = _runs(_units(messages))
    kind = runs.schema["id"].dataType
    ordered = scratch_table(runs).repartition("id").sortWithinPartitions("id", "part", "number")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        names = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        arrow = pa.schema([pa.field("id", to_arrow_type(kind)), *(pa.field(name, names[t]) for name, t in (x.split() for x in _CHOSEN.split(", ")))])
        held, out = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["id"] != held[0]["id"]:
                    out += _told(held)
                    held = []
                held.append(row)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if held:
            out += _told(held)
        yield pa.RecordBatch.from_pylist(out, arrow)

    return scratch_table(ordered.mapInArrow(run, f"id {kind.simpleString()}, {_CHOSEN}"))


def _told(runs: list[dict]) -> list[dict]:
    cost, audit, pieces = chained(runs)
    out = [{"id": r["id"], "turn": r["turn"], "role": r["role"], "print": r["print"], "state": s, "piece": piece, "whole": False} for r, (s, piece) in zip(runs, pieces)]
    total = {k: sum(r[k] for r in runs) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(runs, runs[1:]):
        total["illegal"] += not _legal(a["closes"], b["opens"])
        total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    least = min((r["least"] for r in runs if r["least"] is not None), default=None)
    total["gaps"] = 0 if least is None else runs[-1]["last_turn"] - least + 1 - total["turns"]
    out[0] |= total | {"whole": True, "cost": cost, "audit": audit}
    for row in out:
        row.pop("turns", None)
    return out


def edited(state: str, letters: str, role: str) -> Iterator[tuple[str, bool]]:
    """``(role, has own text)`` of what the letters of one message leave."""
    for letter in letters:
        if letter == "K":
            state = role[:1]
            yield role, True
        elif letter in "RI":
            state = _NEXT[state]
            yield _NAME[state], letter == "R"


def repaired(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """``(id, place, role, text)``: the messages that are left, in order; inserted ones have an empty text.

    Texts move once, to the task of their conversation, and pass through it in order: a long conversation takes a task
    time but no memory.
    """
    kind = messages.schema["id"].dataType
    fields = ["id", "turn", "role", "print", "kind", "copies", "text", "state"]
    texts = messages.select("id", "turn", "role", F.sha2("text", 256).alias("print"), F.lit(1).alias("kind"), "copies", "text", F.lit(None).cast("string").alias("state"))
    moves = edits.select("id", "turn", "role", "print", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), F.col("piece").alias("text"), "state")
    both = byte_bounded(texts).select(*fields).unionByName(moves.select(*fields))
    ordered = both.repartition("id").sortWithinPartitions("id", "turn", "role", "print", "kind")

    def run(batches):
        walk, place, last = None, 0, None
        columns: list[list] = [[], [], [], []]

        def put(id_, found, text):
            nonlocal place
            for role, own in found:
                for column, value in zip(columns, (id_, place, role, text if own else "")):
                    column.append(value)
                place += 1

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["id"], row["turn"], row["role"], row["print"])
                if row["kind"] == 0:
                    if walk is not None:
                        put(last[0], walk.rest(), "")
                    place = place if last is not None and last[0] == row["id"] else 0
                    walk, last = _Walk(row["state"], row["text"]), (row["id"],)
                else:
                    extra = row["copies"]
                    if key != last:
                        put(row["id"], walk.message(row["role"]), row["text"])
                        last, extra = key, extra - 1
                    walk.at += extra
            full, columns = columns, [[], [], [], []]
            yield _batch(full, kind)
        if walk is not None:
            put(last[0], walk.rest(), "")
            yield _batch(columns, kind)

    return ordered.mapInArrow(run, f"id {kind.simpleString()}, place long, role string, text string")


def _batch(columns: list[list], kind) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["id", "place", "role", "text"])


class _Walk:
    """Goes through the letters of a run, message by message; the deletions of copies are stepped over by the caller."""

    def __init__(self, state: str, letters: str):
        self.state, self.letters, self.at = state, letters, 0

    def message(self, role: str) -> list[tuple[str, bool]]:
        """What the insertions before the next message and its own letter leave."""
        end = self.at
        while self.letters[end] == "I":
            end += 1
        return self._to(end + 1, role)

    def rest(self) -> list[tuple[str, bool]]:
        """What is inserted after the last message."""
        return self._to(len(self.letters), "")

    def _to(self, end: int, role: str) -> list[tuple[str, bool]]:
        found = list(edited(self.state, self.letters[self.at : end], role))
        self.at = end
        self.state = found[-1][0][:1] if found else self.state
        return found


def digests(messages: DataFrame) -> DataFrame:
    """``(id, repaired_sha256)`` of ``repaired``: ``role:text`` of its messages joined by line ends. Reads its rows as they come."""
    kind = messages.schema["id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        held, sha, ids, found = None, None, [], []
        for batch in batches:
            for id_, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sha is None or place == 0:
                    if sha is not None:
                        ids.append(held), found.append(sha.hexdigest())
                    held, sha = id_, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            ids.append(held), found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(found, pa.string())], names=["i", "repaired_sha256"])

    return messages.mapInArrow(run, f"i {kind.simpleString()}, repaired_sha256 string")


def reports(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each id of ``ids``: faults, cost and audit of the cheapest repair, digest of what it leaves.

    ``messages`` are ``(id, turn, role, text, copies)``, ``ids`` has one column ``id``. The first fault of a message counts: blank,
    duplicate (role and text were there before), truncated (does not end in a mark). Blank and duplicate ones must go. Of the cheapest edits the least audit is
    taken. A role without an initial can't be kept. Ids without messages get zeros and the digest of nothing; a null id is a
    conversation of its own; an empty table gives no rows; further columns are not read.
    """
    edits = chosen_edits(messages)
    whole = edits.where("whole").select(F.col("id").alias("w"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    prints = digests(repaired(messages, edits))
    nothing = hashlib.sha256(b"").hexdigest()
    out = ids.select("id").distinct()
    out = out.join(whole, F.col("id").eqNullSafe(F.col("w")), "left").join(prints, F.col("id").eqNullSafe(F.col("i")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(reports, repaired messages)`` of a table of conversations as it is; null roles and texts are one space."""
    columns = [F.coalesce(F.col(c).cast(StringType()), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))]
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), *columns, F.lit(1).cast("long").alias("copies"))
    edits = chosen_edits(rows)
    return reports(rows, rows.select("id")), repaired(rows, edits)

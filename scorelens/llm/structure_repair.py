"""Repair of the turn structure of conversations by an auction algorithm for shortest paths.

A conversation is legal if the initials of its roles are ``(s?(ua)+)?``. Its turns and four states (nothing yet, after a
system, user, assistant turn) span a lattice of integer costs: keep 0, give the role that is due 1, delete 2, insert an
empty turn of the role that is due 5, and 5 more for a truncated turn that stays. Blank and duplicate turns must go.

The shortest path is found by an auction. Every node has a price, at most its true cost to the end. A path grows from
its origin: if the price of its last node is below the best offer (arc cost and price of the node behind), the
price rises to the offer and the path contracts by a node, else it extends to the node that offers. When it arrives, the
prices along all cheapest paths are the true costs, so exactly the arcs of cheapest paths are tight and lead on to the end
by tight arcs. Taking the least letter among them at every node traces the cheapest edits that come first by ASCII.

The auction runs over ``BLOCK_TURNS`` turns at a time, from the end: the prices at a block's first nodes, auctioned from
each state, are the costs behind the block before it. So its work grows with the length of a conversation. Equal blocks
are remembered by the worker.

Turns are placed by range partitioned positions and reduced to one letter each where they lie; only these letters, as
many as the audit has, meet per conversation. Texts never do: the digest streams ordered pieces. A conversation's letters
are one value.

Rules: rows without a conversation id are no conversation. Null roles and texts are one space, null turns come first.
Rows of one turn are ordered by role and text. Repeated rows are duplicates. Extra columns are dropped. A role that is
empty or begins otherwise must be changed or go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.ordered_digest import ordered_sha256
from scorelens.operators.ranks import join_hot_values, ordered_index
from scorelens.storage import Scratch, materialize

RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of the role that is due, and that role's letter.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Letters of a turn by initial (s, u, a, other): sound, truncated, must go.
SOUND, TRUNCATED, DOOMED = "suao", "SUAO", "0123"
LEGAL_PAIRS = {"su", "ua", "au"}
WHITE = " \t\n\x0b\f\r"
BLOCK_TURNS = 8
#: Turns a chunk of a conversation's letters.
CHUNK = 4096
#: Blocks that a worker remembers.
REMEMBERED = 1 << 16


def _after(letter: str, state: int) -> int | None:
    """State after a kept turn; None where its role isn't due."""
    if state == START and letter == "s":
        return SYSTEM
    due = DUE[state]
    return due if letter == ("u" if due == USER else "a") else None


def _lattice(turns: str, behind: tuple[int, int, int, int] | None) -> list[list[tuple[int, str, int]]]:
    """Arcs (cost, letter, node) of every node; the last node is the destination.

    Node 4k + state stands before turn k. Behind the last turn the costs to the end are given; without them the
    conversation ends here, where a turn that is due may still be inserted.
    """
    end = 4 * (len(turns) + 1)
    arcs: list[list[tuple[int, str, int]]] = []
    for k, turn in enumerate(turns):
        initial, extra = turn.lower(), CUT if turn in TRUNCATED else 0
        for state in range(4):
            out = [(DELETE, "D", 4 * k + 4 + state), (INSERT, "I", 4 * k + DUE[state])]
            if turn not in DOOMED:
                kept = _after(initial, state)
                if kept is not None:
                    out.append((extra, "K", 4 * k + 4 + kept))
                out.append((RENAME + extra, "R", 4 * k + 4 + DUE[state]))
            arcs.append(out)
    for state in range(4):
        if behind is not None:
            arcs.append([(behind[state], "", end)])
        elif state in (START, ASSISTANT):
            arcs.append([(INSERT, "I", 4 * len(turns) + DUE[state]), (0, "", end)])
        else:
            arcs.append([(INSERT, "I", 4 * len(turns) + DUE[state])])
    arcs.append([])
    return arcs


def auction(arcs: list[list[tuple[int, str, int]]], price: list[int], origin: int) -> None:
    """Raise prices until the path from ``origin`` arrives at the last node. Every cycle must cost something."""
    end, path = len(arcs) - 1, [origin]
    while (node := path[-1]) != end:
        offer, onward = min((cost + price[following], following) for cost, _, following in arcs[node])
        if price[node] < offer:
            price[node] = offer
            if len(path) > 1:
                path.pop()
        else:
            path.append(onward)


@lru_cache(maxsize=REMEMBERED)
def _solve(turns: str, behind: tuple[int, int, int, int] | None) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs to the end from the four states before ``turns``, and for each the first cheapest edits and the state they lead to."""
    arcs = _lattice(turns, behind)
    end = len(arcs) - 1
    price = [0] * len(arcs)
    for state in range(4):
        auction(arcs, price, state)
    tight = [[(letter, j) for cost, letter, j in out if price[i] == cost + price[j]] for i, out in enumerate(arcs)]
    # nodes from which tight arcs lead to the end
    leads = [False] * end + [True]
    for first in range(end - 4, -1, -4):
        layer = range(first, first + 4)
        for _ in layer:  # inserts stay in the layer
            for i in layer:
                leads[i] = leads[i] or any(leads[j] for _, j in tight[i])
    routes = []
    for state in range(4):
        node, letters = state, []
        while True:
            letter, following = min((a for a in tight[node] if leads[a[1]]), key=lambda a: a[0])
            if following == end:
                break
            letters.append(letter)
            node = following
        routes.append(("".join(letters), node % 4))
    return tuple(price[:4]), tuple(routes)


def cheapest_edits(turns: str) -> tuple[int, str]:
    """Least cost of making the turns legal, and the letters of the edits."""
    cost, behind, solved = 0, None, []
    for first in range(len(turns) // BLOCK_TURNS * BLOCK_TURNS, -1, -BLOCK_TURNS):
        prices, routes = _solve(turns[first : first + BLOCK_TURNS], behind)
        least = min(prices)
        cost += least
        behind = tuple(p - least for p in prices)
        solved.append(routes)
    cost += behind[START]
    state, edits = START, []
    for routes in reversed(solved):
        letters, state = routes[state]
        edits.append(letters)
    return cost, "".join(edits)


def illegal_pairs(turns: str) -> int:
    """Adjacent turns whose initials may not follow each other."""
    initials = [SOUND[DOOMED.index(t)] if t in DOOMED else t.lower() for t in turns]
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def number_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos) with nulls filled and places from 1 on."""
    filled = rows.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    return ordered_index(filled, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "pos")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, fault, letter) of numbered turns; the first fault counts: blank, duplicate, truncated.

    A text is known by its SHA-256. Texts that one conversation repeats very often are joined apart, without a shuffle.
    """
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = materialize(turns.select(
        "conv_id", "pos", "turn", F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")), 256).alias("said"),
        (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("open"),
        F.substring("role", 1, 1).alias("initial"),
    ), "marked")
    firsts = materialize(marked.groupBy("conv_id", "said").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1"), "firsts")
    seen = join_hot_values(marked, firsts, ["conv_id", "said"], "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    kind = F.instr(F.lit("sua"), F.col("initial"))
    index = F.when((F.col("initial") == "") | (kind == 0), 4).otherwise(kind)
    letters = F.when(F.col("fault").isin("blank", "duplicate"), DOOMED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(SOUND)
    return seen.withColumn("fault", fault).select("conv_id", "pos", "turn", "fault", F.substring(letters, index, F.lit(1)).alias("letter"))


def letters_of(marked: DataFrame) -> DataFrame:
    """(conv_id, letters): one letter a turn in order, joined chunk by chunk."""

    def joined(group: list[str], place: str):
        ordered = F.sort_array(F.collect_list(F.struct(place, "letter")))
        return F.array_join(F.transform(ordered, lambda e: e["letter"]), "").alias("letter")

    chunks = marked.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).groupBy("conv_id", "chunk").agg(joined([], "pos"))
    return chunks.groupBy("conv_id").agg(joined([], "chunk")).withColumnRenamed("letter", "letters")


def plan_edits(letters: DataFrame) -> DataFrame:
    """(conv_id, letters) to (conv_id, illegal, cost, audit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1).to_pylist()
            plans = [cheapest_edits(t) for t in turns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([illegal_pairs(t) for t in turns], pa.int64()),
                 pa.array([c for c, _ in plans], pa.int64()), pa.array([a for _, a in plans], pa.string())],
                names=["conv_id", "illegal", "cost", "audit"],
            )

    kind = letters.schema["conv_id"].dataType.simpleString()
    return letters.select("conv_id", "letters").mapInArrow(run, f"conv_id {kind}, illegal long, cost long, audit string")


def edits_of(letters: str, audit: str) -> Iterator[tuple[int, str, str | None, str | None]]:
    """(pos, edit, new role, lines of empty turns before) of all turns that don't stay as they are.

    Turns inserted after the last one come with an empty edit.
    """
    state, pos, before = START, 1, []
    for edit in audit:
        if edit == "I":
            state = DUE[state]
            before.append(ROLE[state] + ":")
            continue
        role = None
        if edit == "K":
            state = SYSTEM if state == START and letters[pos - 1] in "sS" else DUE[state]
        elif edit == "R":
            state = DUE[state]
            role = ROLE[state]
        if edit != "K" or before:
            yield pos, edit, role, "\n".join(before) if before else None
        before, pos = [], pos + 1
    if before:
        yield pos, "", None, "\n".join(before)


def repaired_lines(turns: DataFrame, letters: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, pos, line): what numbered turns become; a line is null for a deleted turn and holds inserted ones before it."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, held, audit in zip(*[c.to_pylist() for c in batch.columns]):
                rows = list(edits_of(held, audit))
                for first in range(0, len(rows), 10_000):
                    part = rows[first : first + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv] * len(part), batch.schema.field(0).type), pa.array([r[0] for r in part], pa.int64())]
                        + [pa.array([r[k] for r in part], pa.string()) for k in (1, 2, 3)],
                        names=["conv_id", "pos", "edit", "new_role", "before"],
                    )

    changes = letters.join(plans.select("conv_id", "audit"), "conv_id").select("conv_id", "letters", "audit").mapInArrow(
        run, f"conv_id {kind}, pos long, edit string, new_role string, before string"
    )
    changes = materialize(changes, "changes")
    stays = F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text")
    line = F.when(F.col("edit") == "D", F.col("before")).otherwise(F.concat_ws("\n", "before", stays))
    changed = turns.join(changes.where("edit <> ''"), ["conv_id", "pos"], "left").select("conv_id", "pos", line.alias("line"))
    return changed.unionByName(changes.where("edit = ''").select("conv_id", "pos", F.col("before").alias("line")))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every conversation of ``rows`` (conv_id, turn, role, text).

    Returns (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    """
    with Scratch(rows.sparkSession) as scratch:
        turns = materialize(number_turns(rows), "turns")
        marked = materialize(faults(turns), "faults")
        turn = F.col("turn")
        counts = marked.groupBy("conv_id").agg(
            F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).alias("gaps"),
            *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
        )
        letters = materialize(letters_of(marked), "letters")
        plans = materialize(plan_edits(letters), "plans")
        digests = ordered_sha256(repaired_lines(turns, letters, plans), ["conv_id"], "pos", "line", "\n", "repaired_sha256")
        full = counts.join(plans, "conv_id").join(digests, "conv_id", "left")
        nothing = F.sha2(F.lit(""), 256)
        return scratch.keep(full.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)), "repaired")

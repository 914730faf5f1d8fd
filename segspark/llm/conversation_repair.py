"""Repair of the turn structure of conversations at the least cost.

The roles of a repaired conversation follow ``(s?(ua)+)?`` by their initials: nothing, or
an optional system turn and then user and assistant in turn.  Each turn is kept (K, 0),
given another role (R, 2) or deleted (D, 3); turns of the user or the assistant can be
inserted with an empty text (I, 2).  Blank turns and such that repeat an earlier turn of
their conversation must go; a truncated turn that stays costs 1 more.  Of the cheapest
repairs the one whose edits, in order, are least in ASCII is taken.

Where Spark works and where DuckDB does: Spark sorts all turns by conversation and turn
into ranges, whatever the length of a conversation, and deals blocks of ``BLOCK``
consecutive turns by hash.  In each block one recursive DuckDB query advances all
conversations of the block by a turn at a time and keeps, for each state of the grammar,
the least (cost, edits).  A conversation that is cut by blocks gets a table from every
state to every state in each; ``MERGED`` neighbouring tables at a time are joined by the same
query, dealt by hash again, until one is left.  So the search has no task that grows with a
conversation.  Only what is sequential by nature, the repaired text of a conversation, is
streamed by one task, which holds one batch and the edits.

Equal costs compare by whole edits in each state: two edits that have consumed the same
turns at the same cost are never prefixes of each other, since each letter has its cost, so
what follows cannot turn their order.

Defined results: a null role or text is one space; turns with a null number come first; turns
with equal numbers are ordered by role, then text (both by code point); a null conv_id is a
conversation of its own; a conversation that is named but has no turns has zeros, no edits
and the hash of the empty text; roles other than by their initial s, u or a fit nowhere; an
empty table gives an empty result; further columns are ignored.  A conversation's edits are
one string: it must fit in a task some hundred times over while tables are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from segspark.llm._hot import hot_from, join_unique
from segspark.llm._scratch import discard, materialize
from segspark.llm._sql import CRC_TABLE, ascii_bytes, crc32

#: Turns of a block, and tables that one step joins.
BLOCK, MERGED = 1024, 8
#: States of the grammar: before all, after s, after u, after a.
START, S, U, A = range(4)
#: What an initial leads to from each state that takes it.
STEPS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
#: Letters of a turn's fault: blank, duplicate, truncated, none.
BLANK, DUPLICATE, TRUNCATED, FINE = "bdt-"
ROLES = {"u": "user", "a": "assistant"}
_SPACES = " \t\n\x0b\x0c\r"


def _moves() -> pa.Table:
    """The cheapest ways from state to state over one turn, with the inserts before it, for
    each kind of turn: ``3 * (place of its initial in "sua", else 3) + (0 fine, 1 truncated,
    2 must go)``.  More than two inserts in a row lead nowhere new."""
    before = {(x, x): "" for x in range(4)}
    for _ in range(2):
        for (x, y), edits in list(before.items()):
            for initial in ROLES:
                if (z := STEPS[initial].get(y)) is not None:
                    before.setdefault((x, z), edits + "I")
    rows = []
    for at, initial in enumerate("sua-"):
        for fault in range(3):
            best: dict[tuple[int, int], tuple[int, str]] = {(x, x): (3, "D") for x in range(4)}
            for (x, y), inserts in before.items():
                for edit, cost, to in [("K", 0, initial), ("R", 2, "u"), ("R", 2, "a")] if fault < 2 else []:
                    if (z := STEPS.get(to, {}).get(y)) is not None:
                        way = (2 * len(inserts) + cost + fault, inserts + edit)
                        best[x, z] = min(best.get((x, z), way), way)
            rows += [(3 * at + fault, x, z, *way) for (x, z), way in best.items()]
    return pa.table(dict(zip(("kind", "src", "dst", "cost", "audit"), map(list, zip(*rows)))))


#: Each recursion advances every run by one item, whose kind names its moves.
ADVANCE = """
WITH RECURSIVE best(run, i, src, state, cost, audit) AS (
  SELECT run, 0::BIGINT, src, src, 0::BIGINT, '' FROM starts
  UNION ALL
  SELECT run, i, src, dst, least_way.cost, least_way.audit FROM (
    SELECT best.run, best.i + 1 AS i, best.src, moves.dst,
           min({'cost': best.cost + moves.cost, 'audit': best.audit || moves.audit}) AS least_way
    FROM best JOIN items ON items.run = best.run AND items.i = best.i JOIN moves ON moves.kind = items.kind AND moves.src = best.state
    GROUP BY ALL)
)
SELECT run, src, state AS dst, cost, audit FROM best JOIN sizes USING (run) WHERE best.i = sizes.n ORDER BY ALL
"""


def advance(run: np.ndarray, i: np.ndarray, kind: np.ndarray, moves: pa.Table, starts: pa.Table) -> pa.Table:
    """Run the recursion over items ``i`` = 0, 1, .. of each run: ``run, src, dst, cost, audit``."""
    size = np.bincount(run)
    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB"}) as db:
        db.register("items", pa.table({"run": run, "i": i, "kind": kind}))
        db.register("sizes", pa.table({"run": np.arange(len(size)), "n": size}))
        db.register("given_moves", moves)
        db.execute("CREATE TABLE moves AS SELECT kind::BIGINT AS kind, src::BIGINT AS src, dst::BIGINT AS dst, cost::BIGINT AS cost, audit FROM given_moves")
        db.register("given_starts", starts)
        db.execute("CREATE TABLE starts AS SELECT run::BIGINT AS run, src::BIGINT AS src FROM given_starts")
        return db.sql(ADVANCE).to_arrow_table()


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal to each other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, bool)
    a, b = column[1:], column[:-1]
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate(([True], differs))


def _pieces_schema(conv: DataType) -> StructType:
    return StructType([StructField("conv_id", conv), *StructType.fromDDL("piece long, src long, dst long, cost long, audit string, faults string")])


def _found(table: pa.Table, first: np.ndarray, piece: pa.Array, best: pa.Table, faults: list[str]) -> pa.Table:
    run = best["run"].combine_chunks()
    at = pa.array(first).take(run)
    columns = [table["conv_id"].combine_chunks().take(at), piece.take(at), *(best[c].combine_chunks().cast(pa.int64()) for c in ("src", "dst", "cost")), best["audit"].combine_chunks().cast(pa.string()), pa.array(faults, pa.string()).take(run)]
    return pa.table(columns, names=["conv_id", "piece", "src", "dst", "cost", "audit", "faults"])


def _ways_of_block(table: pa.Table) -> pa.Table:
    """``table``: the turns of a block (conv_id, block, seq, kind, fault)."""
    table = table.sort_by("seq")
    new = _changes(table["conv_id"])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    place = np.arange(len(run)) - first[run]
    # The first conversation may have begun in the block before: it can stand in any state.
    starts = [(0, s) for s in range(4)] + [(r, START) for r in range(1, len(first))]
    best = advance(run, place, table["kind"].to_numpy().astype(np.int64), _moves(), pa.table({"run": [r for r, _ in starts], "src": [s for _, s in starts]}))
    letters = "".join(table["fault"].to_pylist())
    bounds = [*first.tolist(), len(letters)]
    return _found(table, first, table["block"].combine_chunks(), best, [letters[a:b] for a, b in zip(bounds, bounds[1:])])


def _ways_of_pieces(table: pa.Table) -> pa.Table:
    """``table``: neighbouring pieces of one conversation (conv_id, piece, src, ..., group)."""
    table = table.sort_by([("piece", "ascending"), ("src", "ascending"), ("dst", "ascending")])
    new = _changes(table["piece"])
    first, item = np.flatnonzero(new), np.cumsum(new) - 1
    moves = pa.table([pa.array(item), *(table[c] for c in ("src", "dst", "cost", "audit"))], names=["kind", "src", "dst", "cost", "audit"])
    origin = table["src"].to_numpy()[item == 0]
    order = np.arange(len(first))
    best = advance(np.zeros(len(first), np.int64), order, order, moves, pa.table({"run": np.zeros(len(set(origin)), np.int64), "src": np.unique(origin)}))
    faults = "".join(table["faults"][int(x)].as_py() for x in first)
    return _found(table, first[:1], table["group"].combine_chunks(), best, [faults])


def cheapest_edits(ordered: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, faults`` of turns ``conv_id, role, text, seq`` whose ``seq``
    orders them by conversation and turn; ``faults`` has a letter for each turn."""
    stripped = F.btrim("text", F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\n"), F.md5(F.col("role").cast("binary")), F.md5(F.col("text").cast("binary")))
    turns = ordered.select(
        "conv_id",
        "seq",
        (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)).alias("place"),
        (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.md5(named.cast("binary")).alias("key"),
    )
    told = turns.filter("NOT blank").groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    told = materialize(told.select(F.col("key").alias("_told"), "first", "n"), "told-before")
    hot = told.filter(F.col("n") > hot_from(ordered.count())).select(F.col("_told").alias("hot"))
    seen = join_unique(turns, "key", told.drop("n"), "_told", hot)
    fault = F.when(F.col("blank"), BLANK).when(F.coalesce(F.col("seq") > F.col("first"), F.lit(False)), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    weight = F.when(F.col("fault") == FINE, 0).when(F.col("fault") == TRUNCATED, 1).otherwise(2)
    blocks = seen.select("conv_id", "seq", F.floor(F.col("seq") / BLOCK).alias("block"), "place", fault.alias("fault")).withColumn("kind", (3 * F.col("place") + weight).cast("long"))
    schema = _pieces_schema(ordered.schema["conv_id"].dataType)
    # Turns without texts are small, but what is done with them isn't: adaptive execution would
    # take all blocks for one small partition, so they are dealt to a stated number of tasks.
    tasks = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("conv_id", "block", "seq", "kind", "fault").repartition(tasks, "block")
    pieces = materialize(dealt.groupBy("block").applyInArrow(_ways_of_block, schema), "pieces")
    discard(told)
    whole, parts = _cut_apart(pieces)
    while parts is not None:
        grouped = parts.withColumn("group", F.floor(F.col("piece") / MERGED)).repartition(tasks, "conv_id", "group")
        joined = materialize(grouped.groupBy("conv_id", "group").applyInArrow(_ways_of_pieces, schema), "pieces")
        more, parts = _cut_apart(joined)
        whole = whole.unionByName(more)
    # Turns that are still due at the end are inserted there.
    due = F.when(F.col("dst") == U, "I").when(F.col("dst") == S, "II").otherwise("")
    ended = whole.filter(F.col("src") == START).select("conv_id", F.struct((F.col("cost") + 2 * F.length(due)).alias("cost"), F.concat("audit", due).alias("audit"), "faults").alias("way"))
    return ended.groupBy("conv_id").agg(F.min("way").alias("way")).select("conv_id", "way.cost", "way.audit", "way.faults")


def _cut_apart(pieces: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of conversations that have one, and those of the others, numbered from 0 in their
    conversation (None if there are none)."""
    from pyspark.sql import Window

    own = pieces.select("conv_id", "piece").distinct()
    several = own.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"))
    if several.isEmpty():
        return pieces, None
    # A piece stands for up to BLOCK turns; the numbering sees no edits.
    numbers = own.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select(F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")) - 1).cast("long").alias("_at"))
    numbers = materialize(numbers, "piece-numbers")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece"))
    parts = pieces.join(numbers, same).withColumn("piece", F.col("_at")).drop("_conv", "_piece", "_at")
    return pieces.join(numbers, same, "left_anti"), parts


class _Conversation:
    """Follows a conversation's edits along its turns."""

    def __init__(self, conv: object, audit: str, faults: str, cost: int):
        self.conv, self.audit, self.faults, self.cost = conv, audit, faults, cost
        self.at, self.state, self.rows = 0, START, 0
        self.illegal, self.before = 0, None
        self.turns, self.least, self.last = 0, None, None

    def _made(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        if role is None:
            role = ROLES["u" if self.state != U else "a"]
        self.state = STEPS[role[:1]][self.state]
        return edit, role, text

    def turn(self, number: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What stands in the repaired conversation up to and with this turn."""
        initial = role[:1]
        self.illegal += self.rows > 0 and self.before + initial not in ("su", "ua", "au")
        self.before, self.rows = initial, self.rows + 1
        if number is not None and number != self.last:
            self.turns, self.last = self.turns + 1, number
            self.least = number if self.least is None else self.least
        while (edit := self.audit[self.at]) == "I":
            self.at += 1
            yield self._made("I", None, "")
        self.at += 1
        if edit != "D":
            yield self._made(edit, role if edit == "K" else None, text)

    def end(self) -> Iterator[tuple[str, str, str]]:
        for _ in self.audit[self.at :]:
            yield self._made("I", None, "")

    def counts(self) -> dict:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED), "illegal": self.illegal, "cost": self.cost, "audit": self.audit}


class Repair:
    """Conversations (``conv_id, turn, role, text``) and their cheapest repair.

    ``named`` has further conv_ids to report, whose turns may all be missing."""

    def __init__(self, turns: DataFrame, named: DataFrame | None = None):
        plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
        dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order)
        self.ordered = materialize(dealt.withColumn("seq", F.monotonically_increasing_id()), "turns")
        self.edits = materialize(cheapest_edits(self.ordered), "edits")
        ids = (named if named is not None else turns).select("conv_id").distinct()
        edits = self.edits.withColumnRenamed("conv_id", "_conv")
        heads = ids.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        empty = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
        heads = heads.select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), empty("cost", 0), empty("audit", ""), empty("faults", ""))
        rows = self.ordered.select("conv_id", "seq", "turn", "role", "text", F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("faults"))
        self._stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
        self._conv = turns.schema["conv_id"]

    def _map(self, begin, take, end, made: list[str], ddl: str) -> DataFrame:
        """Stream the turns of each conversation: ``take`` gets each repaired turn, ``end`` and
        ``take`` may return a row."""
        schema = StructType([self._conv, *StructType.fromDDL(ddl)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, conv, state = to_arrow_schema(schema), None, None
            rows: list[tuple] = []

            def close() -> None:
                for x in conv.end():
                    add(conv, take(state, x))
                add(conv, end(state, conv))

            def add(conv: _Conversation, row: tuple | None) -> None:
                if row is not None:
                    rows.append((conv.conv, *row))

            def batch_of() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
                rows.clear()
                return out

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "seq", "turn", "role", "text", "cost", "audit", "faults")]
                for own, seq, turn, role, text, cost, audit, faults in zip(*columns):
                    if seq == -1:
                        if conv is not None:
                            close()
                        conv, state = _Conversation(own, audit, faults, cost), begin()
                    else:
                        for x in conv.turn(turn, role, text):
                            add(conv, take(state, x))
                if rows:
                    yield batch_of()
            if conv is not None:
                close()
                yield batch_of()

        return self._stream.mapInArrow(run, schema).select("conv_id", *made)

    def summary(self) -> DataFrame:
        """One row for each conversation: its faults, the cost, the edits and the hash of the
        repaired ``role:text`` lines."""

        def take(state: list, x: tuple[str, str, str]) -> None:
            state[0].update(("\n" * state[1] + f"{x[1]}:{x[2]}").encode())
            state[1] = True

        def end(state: list, conv: _Conversation) -> tuple:
            return (*conv.counts().values(), state[0].hexdigest())

        made = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        ddl = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
        return self._map(lambda: [hashlib.sha256(), False], take, end, made, ddl)

    def turns(self) -> DataFrame:
        """The repaired turns: ``conv_id, turn`` (numbered from 0), ``role, text, edit``."""

        def take(state: list, x: tuple[str, str, str]) -> tuple:
            state[0] += 1
            return (state[0] - 1, x[1], x[2], x[0])

        return self._map(lambda: [0], take, lambda state, conv: None, ["turn", "role", "text", "edit"], "turn long, role string, text string, edit string")


def damage(conversations: DataFrame) -> DataFrame:
    """The test damage of the query: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a turn, 1
    empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    turns = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    text: Column = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return Repair(damage(conversations), named=conversations).summary()


def _with(way: str, cost: str, edits: str) -> str:
    """SQL of a way (eight digits of its cost, then its edits) made longer; null stays null."""
    return f"lpad(CAST(CAST(substr({way}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({way}, 9) || '{edits}'"


_NAMED = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

#: One fold over the turns with a way for each state (e: none yet, s, u, a); what a repaired
#: turn becomes follows from how many stand before it.
OP11_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(ascii_bytes(_NAMED))} % 20 AS fate FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM r JOIN (VALUES (1), (2)) copies(copy) ON copy = 1 OR fate = 3 WHERE fate <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '(?s)([^ \\t\\n\\x0B\\f\\r])[ \\t\\n\\x0B\\f\\r]*$', 1) AS ending FROM d
), p AS (
  SELECT *, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         i > 1 AND lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS wrong FROM o
), f AS (
  SELECT *, substr(role, 1, 1) AS c, blank OR again AS must, CASE WHEN NOT blank AND NOT again AND ending NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS t FROM p
), w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_with("e", "3", "D")},
         least({_with("s", "3", "D")}, CASE WHEN NOT must AND c = 's' THEN {_with("e", "t", "K")} END),
         least({_with("u", "3", "D")}, CASE WHEN NOT must AND c = 'u' THEN {_with("to_u", "t", "K")} END, CASE WHEN NOT must THEN {_with("to_u", "2 + t", "R")} END),
         least({_with("a", "3", "D")}, CASE WHEN NOT must AND c = 'a' THEN {_with("to_a", "t", "K")} END, CASE WHEN NOT must THEN {_with("to_a", "2 + t", "R")} END)
  FROM (
    SELECT f.conv_id, f.i, must, c, t, e, s, u, a, least(e, s, a, {_with("u", "2", "I")}, {_with("e", "4", "II")}, {_with("s", "4", "II")}) AS to_u,
           least(u, {_with("e", "2", "I")}, {_with("s", "2", "I")}, {_with("a", "2", "I")}) AS to_a
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)
), best AS (
  SELECT conv_id, CAST(substr(way, 1, 8) AS BIGINT) AS cost, substr(way, 9) AS audit FROM (
    SELECT conv_id, least(e, a, {_with("u", "2", "I")}, {_with("s", "4", "II")}) AS way FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
), letters AS (
  SELECT conv_id, place, substr(audit, place, 1) AS ch FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS place FROM best)
), placed AS (
  SELECT *, count(*) FILTER (ch <> 'I') OVER up_to AS i, count(*) FILTER (ch <> 'D') OVER up_to - 1 AS k FROM letters WINDOW up_to AS (PARTITION BY conv_id ORDER BY place)
), made AS (
  SELECT placed.*, f.role, f.text, bool_or(k = 0 AND ch = 'K' AND f.c = 's') OVER (PARTITION BY placed.conv_id) AS led
  FROM placed LEFT JOIN f ON placed.conv_id IS NOT DISTINCT FROM f.conv_id AND placed.i = f.i AND ch <> 'I' WHERE ch <> 'D'
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN ch = 'K' THEN role WHEN (k + CAST(coalesce(led, FALSE) AS INT)) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body
  FROM made GROUP BY conv_id
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, sum(t) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM f GROUP BY conv_id
)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM best LEFT JOIN told ON best.conv_id IS NOT DISTINCT FROM told.conv_id LEFT JOIN lines ON best.conv_id IS NOT DISTINCT FROM lines.conv_id
"""

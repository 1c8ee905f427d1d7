"""Conversation structure repair over a suffix-shared automaton (DAWG) of role and fault signatures.

A row of a conversation becomes one symbol: the initial of its role (s, u, a, else o), upper-case when its text
is truncated, or x when it must be deleted (blank or duplicate). Edits: Keep 0, Rerole 3, Delete 4, Insert 3;
an undeleted truncated row adds 3; the roles that result must read (s?(ua)+)?.

* Signatures: rows are range-partitioned by (conv_id, turn, role, text) and cut, in that order, into pieces of
  ``piece_rows`` rows at most, so a conversation that holds a third of all rows is spread over many tasks.
* Automaton: the distinct signatures are sorted from their ends. A node is a suffix; signatures that end alike
  share its nodes, and each is minimised into the suffix below it plus one symbol. Per node and grammar state the
  cost-to-go and the best audit suffix are computed once, for each state in which the piece may end. A task
  keeps only the path to the current signature; a node on the border of two tasks is made in both.
* Conversations look their signature's node up. Those of several pieces are folded in two steps, within a
  partition and then over partitions, as (min, +) products of the nodes' tables, by a balanced tree.
* Ties take the ASCII-least audit. Among audits of one cost from state to state over the same rows none is a
  proper prefix of another (the rest would be inserts, which cost), so the least one stays least in any product.
* Repaired text: every piece takes the part of the audit that is its own. The SHA-256 of a conversation is a
  chain by definition: its pieces pass one task, in order, one at a time.

Defined cases: null role or text is one space; null turns come first; null conv_id is a conversation; rows of one
turn are ordered by role and text, and equal rows are duplicates of the first. A role that starts with no s, u or a
(or is empty) can't be kept. A very long text is hashed whole. No rows in, no rows out. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, parallelism, written
from penawar.session import ship_package

PIECE_ROWS = 256
PIECE_BYTES = 4_000_000
NO_ROWS_SHA = hashlib.sha256(b"").hexdigest()
BLANKS = r"[\x20\x09-\x0D]"

# ---- the grammar (s?(ua)+)? --------------------------------------------------------------
# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 or 3
STATES = range(4)
ENDS = (0, 3)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)  # the state after an inserted or reroled row
ROLE = ("user", "user", "assistant", "user")  # and that row's role
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

Table = list  # 4 x 4 of (cost, audit) or None: from a state before a suffix to a state after it


def _best(options):
    options = [x for x in options if x]
    return min(options) if options else None


def _add(x, cost: int, letters: str):
    return (x[0] + cost, letters + x[1]) if x else None


def _with_inserts(rows: Table) -> Table:
    """Inserts before the suffix: two lead from any state to any that can be reached."""
    out = []
    for q in STATES:
        one = NEXT[q]
        out.append([_best((rows[q][r], _add(rows[one][r], INSERT, "I"), _add(rows[NEXT[one]][r], 2 * INSERT, "II"))) for r in STATES])
    return out


def empty_suffix() -> Table:
    return _with_inserts([[(0, "") if q == r else None for r in STATES] for q in STATES])


def longer_suffix(symbol: str, below: Table) -> Table:
    """The node of ``symbol`` before the suffix of ``below``."""
    cut = TRUNCATED if symbol.isupper() else 0
    rows = []
    for q in STATES:
        kept = AFTER.get((q, symbol.lower()))
        rows.append([])
        for r in STATES:
            options = [_add(below[q][r], DELETE, "D")]
            if symbol != "x":
                options.append(_add(below[NEXT[q]][r], REROLE + cut, "R"))
                options.append(_add(below[kept][r], KEEP + cut, "K") if kept is not None else None)
            rows[-1].append(_best(options))
    return _with_inserts(rows)


def _automaton_task(batches):
    """Signatures in the order of their reversed text; the stack holds the nodes of the current one's suffixes."""
    stack, last = [empty_suffix()], ""
    for pdf in batches:
        costs, audits = [], []
        for sig in pdf["sig"]:
            back = sig[::-1]
            same = 0
            while same < min(len(back), len(last)) and back[same] == last[same]:
                same += 1
            del stack[same + 1:]
            for symbol in back[same:]:
                stack.append(longer_suffix(symbol, stack[-1]))
            last = back
            flat = [x or (None, None) for row in stack[-1] for x in row]
            costs.append([c for c, _ in flat])
            audits.append([a for _, a in flat])
        yield pd.DataFrame({"sig": pdf["sig"], "costs": costs, "audits": audits})


def automaton(signatures: DataFrame) -> DataFrame:
    """(sig, costs, audits): the entry node of every distinct signature; 16 values, from state to state."""
    back = F.reverse("sig")
    return (signatures.select("sig").distinct().repartitionByRange(parallelism(signatures.sparkSession), back).sortWithinPartitions(back)
            .mapInPandas(_automaton_task, "sig string, costs array<long>, audits array<string>"))


# ---- rows to pieces ----------------------------------------------------------------------

def _stripped() -> Column:
    return F.regexp_replace("text", f"{BLANKS}+$", "")


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, and the symbol of the first copy and of the others."""
    counted = (rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("key", F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"))))
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = counted.groupBy("conv_id", "key").agg(F.min(at).alias("first")).withColumnsRenamed({"conv_id": "conv_id2", "key": "key2"})
    d = counted.join(first, F.col("conv_id").eqNullSafe(F.col("conv_id2")) & (F.col("key") == F.col("key2")))
    end = _stripped()
    fault = (F.when(end == "", "blank").when(~at.eqNullSafe(F.col("first")), "duplicate")
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated"))
    return d.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _initial(role: str) -> str:
    return role[0] if role and role[0] in "sua" else "o"


_PIECE = ("conv_id long, part int, no int, sig string, roles array<string>, texts array<string>, blank long, duplicate long, "
          "truncated long, illegal long, first string, last string")
_LEGAL = {"su", "ua", "au"}


def _cut_task(piece_rows: int, piece_bytes: int):
    """Ordered rows to pieces. A piece has the texts of its rows, null for those that must go."""

    def run(batches):
        from pyspark import TaskContext

        part, out, held, no, conv, p = TaskContext.get().partitionId(), [], 0, 0, None, None

        def fresh():
            return {"conv_id": conv, "part": part, "no": no, "sig": "", "roles": [], "texts": [], "blank": 0, "duplicate": 0,
                    "truncated": 0, "illegal": 0, "first": None, "last": None, "bytes": 0}

        def add(role, text, kind):
            initial, gone = _initial(role), kind in ("blank", "duplicate")
            if kind:
                p[kind] += 1
            p["sig"] += "x" if gone else initial.upper() if kind else initial
            p["roles"].append(None if gone else role)
            p["texts"].append(None if gone else text)
            p["bytes"] += 100 + (0 if gone else len(text))
            p["illegal"] += p["last"] is not None and p["last"] + initial not in _LEGAL
            p["first"], p["last"] = p["first"] or initial, initial

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("conv_id", "role", "text", "copies", "fault")]):
                conv_id, role, text, copies, fault = (x.as_py() for x in row)
                for k in range(copies):
                    other = p is None or conv_id != conv
                    if other or len(p["sig"]) >= piece_rows or p["bytes"] >= piece_bytes:
                        if p is not None:
                            out.append(p)
                            held += p["bytes"]
                        conv, no = conv_id, 0 if other else no + 1
                        p = fresh()
                    add(role, text, fault if not k or fault == "blank" else "duplicate")
                    if held >= piece_bytes:
                        yield pa.RecordBatch.from_pylist(out, schema=_schema())
                        out, held = [], 0
        yield pa.RecordBatch.from_pylist(out + ([p] if p is not None else []), schema=_schema())

    return run


def _schema() -> pa.Schema:
    text = pa.list_(pa.string())
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("sig", pa.string()), ("roles", text), ("texts", text),
                      *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string())])


def pieces_of(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]
    dealt = _marked(rows).repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text", "copies", "fault").mapInArrow(_cut_task(piece_rows, piece_bytes), _PIECE)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on, how).drop(*[f"_k_{k}" for k in keys])


# ---- folding pieces ----------------------------------------------------------------------

_NODE = "costs array<long>, audits array<string>, ways array<string>"


def _product(a, b):
    """(costs, audits, ways) of two tables in a row; a way lists the states between the folded parts."""
    out = ([], [], [])
    for q in STATES:
        for r in STATES:
            best = _best((a[0][4 * q + m] + b[0][4 * m + r], a[1][4 * q + m] + b[1][4 * m + r], a[2][4 * q + m] + str(m) + b[2][4 * m + r])
                         if a[0][4 * q + m] is not None and b[0][4 * m + r] is not None else None for m in STATES)
            for c, x in zip(out, best or (None, None, None)):
                c.append(x)
    return out


def _fold_task(batches):
    kinds = {"costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "ways": pa.list_(pa.string())}
    for batch in batches:
        found = []
        for row in batch.column("parts"):
            nodes = [(x["costs"], x["audits"], [""] * 16) for x in row.as_py()]
            while len(nodes) > 1:
                nodes = [_product(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
            found.append(nodes[0])
        keys = [n for n in batch.schema.names if n != "parts"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array([f[i] for f in found], t) for i, t in enumerate(kinds.values())]],
                                         [*keys, *kinds])


def folded(parts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per ``keys`` the product of the tables in the order of ``at``, with sums and the illegal pairs at the seams.

    A group holds the pieces of one partition, or the partitions of one conversation."""
    order = F.sort_array(F.collect_list(F.struct(at, "first", "last", "costs", "audits")))
    sums = ("blank", "duplicate", "truncated", "illegal")
    g = parts.groupBy(*keys).agg(order.alias("parts"), *[F.sum(c).alias(c) for c in sums])
    seams = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: F.concat(a["last"], b["first"]))
    bad = F.size(F.filter(seams, lambda s: ~s.isin(*sorted(_LEGAL))))
    g = g.withColumns({"illegal": F.col("illegal") + bad, "first": F.get("parts", F.lit(0))["first"],
                       "last": F.element_at("parts", -1)["last"]})
    kept = [*keys, *sums, "first", "last"]
    one = F.get("parts", F.lit(0))
    single = g.where(F.size("parts") == 1).select(*kept, one["costs"].alias("costs"), one["audits"].alias("audits"),
                                                  F.array_repeat(F.lit(""), 16).alias("ways"))
    many = g.where(F.size("parts") > 1)
    node = many.select(*keys, "parts").mapInArrow(_fold_task, ", ".join(f"{k} {dict(many.dtypes)[k]}" for k in keys) + ", " + _NODE)
    return single.unionByName(_null_safe(many.select(*kept), node, keys).select(*kept, "costs", "audits", "ways"))


def _ways_down(above: DataFrame, below: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The states in which each part of a fold starts and ends: ``above`` has (keys, start, end, way)."""
    states = F.concat(F.col("start").cast("string"), F.col("way"), F.col("end").cast("string"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(at))  # parts of one fold, as collected by it
    numbered = below.withColumn("_n", rank)
    d = _null_safe(numbered, above.select(*keys, states.alias("_states")), keys)
    return (d.withColumn("start", F.expr("cast(substring(_states, _n, 1) as int)")).withColumn("end", F.expr("cast(substring(_states, _n + 1, 1) as int)"))
            .drop("_states", "_n"))


def _cell(col: str) -> Column:
    return F.get(col, 4 * F.col("start") + F.col("end"))


# ---- repaired text -----------------------------------------------------------------------

def repaired_lines(roles, texts, audit: str, state: int) -> list[str]:
    """The ``role:text`` lines of one piece that is entered in ``state``."""
    lines, row = [], 0
    for letter in audit:
        if letter == "I":
            lines.append(ROLE[state] + ":")
            state = NEXT[state]
            continue
        if letter == "R":
            lines.append(f"{ROLE[state]}:{texts[row]}")
            state = NEXT[state]
        elif letter == "K":
            lines.append(f"{roles[row]}:{texts[row]}")
            state = AFTER[state, _initial(roles[row])]
        row += 1
    return lines


def _sha_task(batches):
    conv, sha, begun, ids, shas = None, None, False, [], []
    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("conv_id", "roles", "texts", "audit", "start")]):
            conv_id, roles, texts, audit, start = (x.as_py() for x in row)
            if sha is None or conv_id != conv:
                if sha is not None:
                    ids.append(conv)
                    shas.append(sha.hexdigest())
                conv, sha, begun = conv_id, hashlib.sha256(), False
            for line in repaired_lines(roles, texts, audit, start):
                sha.update(("\n" if begun else "").encode() + line.encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], ["conv_id", "repaired_sha256"])
        ids, shas = [], []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def _lines_task(batches):
    for batch in batches:
        cols = [batch.column(c) for c in ("roles", "texts", "audit", "start")]
        lines = [repaired_lines(*[x.as_py() for x in row]) for row in zip(*cols)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "part", "no")], pa.array(lines, pa.list_(pa.string()))],
                                         ["conv_id", "part", "no", "lines"])


# ---- the operator ------------------------------------------------------------------------

def _clean(turns: DataFrame) -> DataFrame:
    return columns_of(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _solved(rows: DataFrame, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, pieces): cost, audit and tallies; pieces with their part of the audit and the state they start in."""
    pieces = written(pieces_of(rows, piece_rows), "repair-pieces")
    nodes = written(automaton(pieces), "repair-automaton")
    small = ["conv_id", "part", "no", "sig", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    tabled = written(pieces.select(*small).join(nodes, "sig").drop("sig"), "repair-tables")
    parts = written(folded(tabled, ["conv_id", "part"], "no"), "repair-parts")
    convs = written(folded(parts, ["conv_id"], "part"), "repair-conversations")
    ends = [F.struct(F.get("costs", F.lit(r)).alias("cost"), F.get("audits", F.lit(r)).alias("audit"), F.lit(r).alias("end"),
                     F.get("ways", F.lit(r)).alias("way")) for r in ENDS]
    best = F.array_min(F.filter(F.array(*ends), lambda x: x["cost"].isNotNull()))
    convs = convs.withColumn("best", best).withColumn("start", F.lit(0)).select("*", "best.*")
    by_part = _ways_down(convs, parts.select("conv_id", "part", "ways"), ["conv_id"], "part").withColumn("way", _cell("ways"))
    by_piece = _ways_down(by_part, tabled.select("conv_id", "part", "no", "audits"), ["conv_id", "part"], "no")
    own = by_piece.select("conv_id", "part", "no", "start", _cell("audits").alias("audit"))
    return convs, _null_safe(pieces.select("conv_id", "part", "no", "roles", "texts"), own, ["conv_id", "part", "no"])


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns that are missing between the first and the last."""
    wide = F.col("turn").cast("decimal(38,0)")
    return (rows.select("conv_id", "turn").distinct().groupBy("conv_id")
            .agg(F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(0)).try_cast("long").alias("gaps")))


def repair(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ship_package(turns.sparkSession)
    rows = _clean(turns)
    convs, pieces = _solved(rows, piece_rows)
    sha = (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").select("conv_id", "roles", "texts", "audit", "start")
           .mapInArrow(_sha_task, "conv_id long, repaired_sha256 string"))
    out = convs.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return _null_safe(_null_safe(out, turn_gaps(rows), ["conv_id"]), sha, ["conv_id"]).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_pieces(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv_id, part, no, lines): the repaired ``role:text`` lines; pieces in the order of (part, no)."""
    ship_package(turns.sparkSession)
    _, pieces = _solved(_clean(turns), piece_rows)
    return pieces.mapInArrow(_lines_task, "conv_id long, part int, no int, lines array<string>")


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations as the query damages them: by crc32(conv_id:turn) % 20, nulls as one space."""
    d = _clean(turns)
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return (d.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                     F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop("_copy"))


def repair_damaged(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``repair`` of the damaged conversations, with a row for every conversation of ``turns``."""
    found = repair(damaged(turns), piece_rows)
    every = _clean(turns).select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    # gaps beyond 64 bits stay null: told from a conversation without rows by the audit
    zero["gaps"] = F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return _null_safe(every, found, ["conv_id"], "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NO_ROWS_SHA)).alias("repaired_sha256"))

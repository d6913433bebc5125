"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation is a lattice of (rows read, last role written); its arcs delete,
insert, keep or rewrite a row at whole costs. The auction algorithm finds the
cheapest way through: a path grows from the start along the arc whose cost and
price of its end are least, and where that exceeds the price of its last node,
the price rises and the path is cut back. The prices it ends with are dual: on
every cheapest way the price falls by exactly the arc's cost. Among these tight
arcs, those that lead to the end are traced in ASCII order of the edits.

Rows are sorted into ranges of (conversation, turn). A conversation that lies
within one range and one chunk is solved on the spot. One of any other size is
a row of chunks: each is summed up by its costs between the roles at its
borders, prices go from the last chunk to the first, and roles from the first
to the last, by range and then over the ranges; so no task holds a conversation.
Only the digest of the repaired text reads it in order, as a stream.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions.ordering import attach
from .common import cut_lineage, groups_in_order, slices, temporary_tables

CHUNK_ROWS = 64
CHUNK_CHARS = 1 << 22

FAR = 1 << 60
#: States: nothing written, then the initial of the last role written.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: State after a row is kept, by state and initial; and the state a written row leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WRITTEN = (USER, USER, ASSISTANT, USER)
ROLES = (None, "system", "user", "assistant")
#: Edits that end a conversation, by the state after its last row, and their cost.
TAILS = ("", "II", "I", "")
TAIL_COSTS = (0, 4, 2, 0)
LEGAL = {"su", "ua", "au"}

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_SPACE = " \t\n\x0b\x0c\r"


def _arcs(state, initial, fault):
    """(edit, rows read, next state, cost) in ASCII order of the edits."""
    found = [("D", 1, state, 3), ("I", 0, WRITTEN[state], 2)]
    if fault not in (BLANK, DUPLICATE):
        extra = 1 if fault == TRUNCATED else 0
        if (state, initial) in KEPT:
            found.append(("K", 1, KEPT[state, initial], extra))
        found.append(("R", 1, WRITTEN[state], 2 + extra))
    return tuple(found)


#: A row is one number: its initial (other roles alike) and its fault.
INITIALS = ("s", "u", "a", "")
ARCS = [[_arcs(state, INITIALS[code & 3], code >> 2) for state in STATES] for code in range(16)]
LEAST = [min(cost for _, rows, _, cost in ARCS[code][START] + ARCS[code][USER] + ARCS[code][ASSISTANT] if rows) for code in range(16)]


class Auction:
    """Prices of the nodes of a lattice: node 4 * row + state, and the end behind the last row.

    ``exits`` are the costs from the states after the last row to the end. The
    first prices are feasible: at least what the rows that follow cost in any case.
    """

    def __init__(self, codes, exits):
        self.codes, self.exits = codes, exits
        self.end = 4 * len(codes) + 4
        price = min(exits)
        prices = [0] + [price] * 4
        for code in reversed(codes):
            price += LEAST[code]
            prices += [price] * 4
        self.prices = prices[::-1]

    def arcs(self, node):
        """(edit, next node, cost) of a node in ASCII order of the edits."""
        row, state = divmod(node, 4)
        if row == len(self.codes):
            return [("", self.end, self.exits[state])]
        return [(edit, 4 * (row + rows) + to, cost) for edit, rows, to, cost in ARCS[self.codes[row]][state]]

    def run(self, origin):
        """Cheapest cost from ``origin`` to the end; prices stay feasible for other origins."""
        prices, path = self.prices, [origin]
        while path[-1] != self.end:
            node = path[-1]
            least, following = FAR, None
            for _, to, cost in self.arcs(node):
                if cost + prices[to] < least:
                    least, following = cost + prices[to], to
            if prices[node] < least:
                prices[node] = least
                if len(path) > 1:
                    path.pop()
                elif least >= FAR:
                    return FAR
            elif following is None:
                return FAR
            else:
                path.append(following)
        return prices[origin]

    def trace(self, state):
        """The ASCII-least of the cheapest edits from ``state`` before the first row, and the state after the last."""
        self.run(state)
        prices = self.prices

        def tight(node):
            return [(edit, to) for edit, to, cost in self.arcs(node) if cost < FAR and prices[node] == cost + prices[to]]

        leads = [False] * (self.end + 1)
        leads[self.end] = True
        for row in range(len(self.codes), -1, -1):
            # Inserts stay on the row and two in a row reach every state that any number does.
            for _ in range(3):
                for node in range(4 * row, 4 * row + 4):
                    leads[node] = leads[node] or any(leads[to] for _, to in tight(node))
        node, edits = state, []
        while node // 4 < len(self.codes):
            edit, node = next((edit, to) for edit, to in tight(node) if leads[to])
            edits.append(edit)
        return "".join(edits), node % 4


def costs_between(codes):
    """Costs from each state before the rows to each after them, 16 numbers; FAR where there is no way."""
    table = [FAR] * 16
    if not codes:
        return [0 if k % 5 == 0 else FAR for k in range(16)]
    kept_system = any(code in (0, 4 * TRUNCATED) for code in codes)
    for after in STATES:
        auction = Auction(codes, [0 if state == after else FAR for state in STATES])
        for before in STATES:
            possible = (
                before == after == START or (after == SYSTEM and (before == SYSTEM or before == START and kept_system))
                or after in (USER, ASSISTANT)
            )
            if possible:
                table[4 * before + after] = auction.run(before)
    return table


def joined_costs(first, second):
    return [
        min(min(first[4 * a + b] + second[4 * b + c], FAR) for b in STATES) for a in STATES for c in STATES
    ]


def prices_before(costs, exits):
    """Prices of the states before rows with these costs, from those after them."""
    return [min(min(costs[4 * a + b] + exits[b], FAR) for b in STATES) for a in STATES]


def faults(roles, texts, seen):
    """Code of each row; ``seen`` are keys of earlier rows and is added to."""
    codes = []
    for role, text in zip(roles, texts):
        stripped, key = text.rstrip(_SPACE), row_key(role, text)
        fault = FINE
        if not stripped:
            fault = BLANK
        elif key in seen:
            fault = DUPLICATE
        elif stripped[-1] not in ".!?":
            fault = TRUNCATED
        seen.add(key)
        codes.append((INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3) + 4 * fault)
    return codes


def row_key(role, text):
    data = f"{len(role)}:{role}{text}".encode("utf-8")
    return hashlib.blake2b(data, digest_size=16).digest()


#: What is known of a stretch of rows: a sum over neighbours.
SUMMARY = (
    "n long, first_turn long, last_turn long, turns long, first_role string, last_role string, "
    "illegal long, blank long, duplicate long, truncated long"
)
_SUMMARY = [part.split()[0] for part in SUMMARY.split(", ")]


def summary(turns, roles, codes):
    known = [turn for turn in turns if turn is not None]
    initials = [role[:1] for role in roles]
    kinds = [code >> 2 for code in codes]
    return {
        "n": len(roles), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        "turns": len(set(known)), "first_role": initials[0] if roles else None, "last_role": initials[-1] if roles else None,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(TRUNCATED),
    }


def joined_summary(a, b):
    found = {name: a[name] + b[name] for name in ("n", "turns", "illegal", "blank", "duplicate", "truncated")}
    if a["last_turn"] is not None and a["last_turn"] == b["first_turn"]:
        found["turns"] -= 1
    if a["n"] and b["n"]:
        found["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    for name, one, other in (
        ("first_turn", a, b), ("first_role", a, b), ("last_turn", b, a), ("last_role", b, a)
    ):
        found[name] = one[name] if one[name] is not None else other[name]
    return found


def gaps(found):
    return 0 if found["first_turn"] is None else found["last_turn"] - found["first_turn"] + 1 - found["turns"]


def apply_edits(edits, state, roles, texts):
    """Repaired (role, text) rows."""
    place, rows = 0, []
    for edit in edits:
        if edit == "K":
            rows.append((roles[place], texts[place]))
            state = KEPT[state, roles[place][0]]
        elif edit in "RI":
            state = WRITTEN[state]
            rows.append((ROLES[state], texts[place] if edit == "R" else ""))
        place += edit != "I"
    return rows


def _lines(rows):
    return "\n".join(f"{role}:{text}" for role, text in rows)


def solve(turns, roles, texts):
    """Report of a whole conversation, and its repaired rows."""
    codes = faults(roles, texts, set())
    found = summary(turns, roles, codes)
    auction = Auction(codes, TAIL_COSTS)
    cost = auction.run(START)
    edits, state = auction.trace(START)
    edits += TAILS[state]
    rows = apply_edits(edits, START, roles, texts)
    report = {
        "gaps": gaps(found), **{name: found[name] for name in ("blank", "duplicate", "truncated", "illegal")},
        "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256(_lines(rows).encode("utf-8")).hexdigest(),
    }
    return report, rows


REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_REPORT = [part.split()[0] for part in REPORT.split(", ")]
_CHUNK = "conv_id long, part long, seq long"


def damage(conversations):
    """conv_id, turn, role, text after seeded damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes
    its role user. Nulls count as one space, except that ``conv_id`` and ``turn`` stay
    null in the result. Dropped rows remain as rows whose ``dropped`` is true.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(blank[0], F.lit(":"), blank[1]).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(blank[2]).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(blank[3], "[.!?]", "")).otherwise(blank[3]).alias("text"),
        (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def repair(rows, keep_rows=False, chunk_rows=CHUNK_ROWS, chunk_chars=CHUNK_CHARS):
    """One report per ``conv_id`` of ``rows`` (conv_id, turn, role, text, optional dropped and copy).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows of a conversation are taken by turn (null first), then role, the first 16
    characters and a hash of the text; ``copy`` tells apart rows that are equal. Null
    role or text counts as one space; null ``conv_id`` is a conversation. Dropped rows
    only tell that there is a conversation: without others it has zeros, an empty
    audit and the digest of an empty string. An empty table gives no rows. Other
    columns are not read.

    With ``keep_rows`` the result is the repaired conversations instead: conv_id,
    place (ascending, with gaps), role, text.
    """
    with temporary_tables() as owner:
        return owner.keep(_repair(rows, keep_rows, chunk_rows, chunk_chars))


def _repair(rows, keep_rows, chunk_rows, chunk_chars):
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    copy = F.col("copy") if "copy" in rows.columns else F.lit(1)
    space = F.lit(" ")
    named = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"),
        dropped.alias("dropped"), copy.alias("copy"), F.monotonically_increasing_id().alias("spread"),
    )
    # Equal rows are told apart last, so that a range can end among them.
    order = [
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"),
        F.substring("text", 1, 16), F.xxhash64("text"), F.col("spread"), F.col("copy"),
    ]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    arrays = "turns array<long>, roles array<string>, texts array<string>"
    streamed = cut_lineage(
        dealt.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(
            _stream(keep_rows, chunk_rows, chunk_chars), f"{_CHUNK}, {REPORT}, {arrays}"
        )
    )
    whole = streamed.where("seq is null")
    chunks = streamed.where("seq is not null").select("conv_id", "part", "seq", "turns", "roles", "texts")
    if chunks.isEmpty():
        pieces = None
    else:
        pieces, reports = _split(chunks)
    if keep_rows:
        found = whole.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), "roles", "texts")
        if pieces is not None:
            found = found.unionByName(pieces.select("conv_id", "part", "seq", "roles", "texts"))
        place = F.col("part") * (1 << 40) + F.col("seq") * (1 << 12) + F.col("at")
        return found.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")).select(
            "conv_id", place.alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text")
        )
    found = whole.select("conv_id", *_REPORT)
    if pieces is None:
        return found
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    digests = ordered.mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    return found.unionByName(attach(reports, digests, ["conv_id"], "inner").select("conv_id", *_REPORT))


def _stream(keep_rows, chunk_rows, chunk_chars):
    """Reports of conversations that surely lie in one chunk, and chunks of all others."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held, chars, seq, current, first = [], 0, 0, None, True
        out = []

        def chunk():
            nonlocal held, chars, seq
            turns, roles, texts = (list(c) for c in zip(*held)) if held else ([], [], [])
            out.append({"conv_id": current, "part": part, "seq": seq, "turns": turns, "roles": roles, "texts": texts})
            held, chars, seq = [], 0, seq + 1

        def whole():
            nonlocal held, chars
            report, rows = solve(*((list(c) for c in zip(*held)) if held else ([], [], [])))
            kept = {"roles": [r for r, _ in rows], "texts": [t for _, t in rows]} if keep_rows else {}
            out.append({"conv_id": current, **report, **kept})
            held, chars = [], 0

        begun = False
        for batch in batches:
            for piece in slices(batch, 1024):
                columns = [piece[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")]
                for conv_id, turn, role, text, gone in zip(*columns):
                    if begun and conv_id != current:
                        # The first conversation may have begun in the range before.
                        if first or seq:
                            chunk()
                        else:
                            whole()
                        first, seq = False, 0
                    begun, current = True, conv_id
                    if len(held) >= chunk_rows or (held and chars + len(text) > chunk_chars):
                        chunk()
                    if not gone:
                        held.append((turn, role, text))
                        chars += len(text)
                if out:
                    yield _batch(out, _STREAMED)
                    out = []
        if begun:
            chunk()
            yield _batch(out, _STREAMED)

    return run


_LONG, _TEXT = pa.int64(), pa.string()
_STREAMED = {
    "conv_id": _LONG, "part": _LONG, "seq": _LONG, **{c: _TEXT if c in ("audit", "repaired_sha256") else _LONG for c in _REPORT},
    "turns": pa.list_(_LONG), "roles": pa.list_(_TEXT), "texts": pa.list_(_TEXT),
}
_KEYS = ["conv_id", "part", "seq"]


def _batch(rows, types):
    return pa.RecordBatch.from_arrays([pa.array([row.get(c) for row in rows], t) for c, t in types.items()], names=list(types))


def _rows(batches):
    return (row for batch in batches for one in slices(batch, 16) for row in one.to_pylist())


def _mapped(df, function, types):
    """One dict in, one dict out."""

    def run(batches):
        for batch in batches:
            for one in slices(batch, 16):
                yield _batch([function(row) for row in one.to_pylist()], types)

    return df.mapInArrow(run, _ddl(types))


def _grouped(df, keys, order, function, types):
    """Lists of dicts of rows with equal ``keys``, sorted by ``order``, to lists of dicts."""

    def run(batches):
        for table in groups_in_order(batches, keys):
            yield _batch(function(table.to_pylist()), types)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, _ddl(types))


def _ddl(types):
    names = {_LONG: "long", _TEXT: "string", pa.binary(): "binary", pa.list_(_LONG): "array<long>", pa.list_(_TEXT): "array<string>"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in types.items())


_SUMMED = {c: _TEXT if c.endswith("role") else _LONG for c in _SUMMARY} | {"costs": pa.list_(_LONG)}


def _split(chunks):
    """Repaired pieces and reports of conversations that lie in several chunks."""
    key = {c: _LONG for c in _KEYS}
    chunks = attach(chunks, _seen_before(chunks), _KEYS)

    def sum_up(row):
        codes = faults(row["roles"], row["texts"], set(row["earlier"] or ()))
        return {
            **{c: row[c] for c in _KEYS}, **summary(row["turns"], row["roles"], codes),
            "costs": costs_between(codes), "codes": bytes(codes),
        }

    summed = cut_lineage(_mapped(chunks, sum_up, key | _SUMMED | {"codes": pa.binary()}))
    ranges = _grouped(
        summed.drop("codes"), ["conv_id", "part"], ["seq"], lambda rows: [_sum_of(rows)], {"conv_id": _LONG, "part": _LONG} | _SUMMED
    )

    # A conversation has at most one row per range here, however long it is.
    def price(rows):
        total, exits = _sum_of(rows), list(TAIL_COSTS)
        cost = prices_before(total["costs"], exits)[START]
        found = []
        for row in reversed(rows):
            found.append(
                {"conv_id": row["conv_id"], "part": row["part"], "exits": exits, "first": row is rows[0], "cost": cost, "gaps": gaps(total)}
                | {c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}
            )
            exits = prices_before(row["costs"], exits)
        return [row | {"first": int(row["first"])} for row in found]

    counted = {c: _LONG for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    priced = cut_lineage(
        _grouped(ranges, ["conv_id"], ["part"], price, {"conv_id": _LONG, "part": _LONG, "first": _LONG, "exits": pa.list_(_LONG)} | counted)
    )
    reports = priced.where("first = 1").select("conv_id", *counted)

    def lead(rows):
        """Prices behind each chunk, and the state it leads each state to."""
        exits, found = rows[0]["exits"], []
        for row in reversed(rows):
            after = [0] * 4
            auction = Auction(row["codes"], exits)
            # A state that no way leads on from leads nowhere; it is not entered either.
            for state, way in zip(STATES, prices_before(row["costs"], exits)):
                after[state] = auction.trace(state)[1] if way < FAR else state
            found.append({c: row[c] for c in _KEYS} | {"exits": exits, "leads": after})
            exits = prices_before(row["costs"], exits)
        found.reverse()
        through = list(STATES)
        for row in found:
            through = [row["leads"][state] for state in through]
        found[0]["through"] = through
        return found

    lists = {c: pa.list_(_LONG) for c in ("exits", "leads", "through")}
    with_exits = attach(summed.select(*_KEYS, "costs", "codes"), priced.select("conv_id", "part", "exits"), ["conv_id", "part"], "inner")
    led = cut_lineage(_grouped(with_exits, ["conv_id", "part"], ["seq"], lead, key | lists))

    def enter_ranges(rows):
        found, state = [], START
        for row in rows:
            found.append({"conv_id": row["conv_id"], "part": row["part"], "entry": state})
            state = row["through"][state]
        return found

    entries = _grouped(
        led.where("through is not null").select("conv_id", "part", "through"), ["conv_id"], ["part"], enter_ranges,
        {"conv_id": _LONG, "part": _LONG, "entry": _LONG},
    )

    def enter_chunks(rows):
        found, state = [], rows[0]["entry"]
        for row in rows:
            found.append({c: row[c] for c in _KEYS} | {"exits": row["exits"], "entry": state})
            state = row["leads"][state]
        return found

    entered = _grouped(
        attach(led.select(*_KEYS, "exits", "leads"), entries, ["conv_id", "part"], "inner"), ["conv_id", "part"], ["seq"],
        enter_chunks, key | {"exits": pa.list_(_LONG), "entry": _LONG},
    )

    def piece(row):
        codes = faults(row["roles"], row["texts"], set(row["earlier"] or ()))
        edits, after = Auction(codes, row["exits"]).trace(row["entry"])
        rows = apply_edits(edits, row["entry"], row["roles"], row["texts"])
        return {c: row[c] for c in _KEYS} | {
            "edits": edits, "after": after, "roles": [r for r, _ in rows], "texts": [t for _, t in rows],
        }

    made = key | {"edits": _TEXT, "after": _LONG, "roles": pa.list_(_TEXT), "texts": pa.list_(_TEXT)}
    pieces = cut_lineage(_mapped(attach(chunks, entered, _KEYS, "inner"), piece, made))
    return pieces.unionByName(_tails(pieces)), reports


def _seen_before(chunks):
    """Per chunk the keys of rows that an earlier chunk of its conversation has too."""
    types = {c: _LONG for c in _KEYS} | {"row_key": pa.binary()}

    def run(batches):
        for row in _rows(batches):
            keys = {row_key(role, text) for role, text in zip(row["roles"], row["texts"])}
            yield _batch([{c: row[c] for c in _KEYS} | {"row_key": one} for one in keys], types)

    keys = cut_lineage(chunks.select(*_KEYS, "roles", "texts").mapInArrow(run, _ddl(types)))
    first = keys.groupBy("conv_id", "row_key").agg(F.min(F.struct("part", "seq")).alias("first"))
    again = attach(keys, first, ["conv_id", "row_key"], "inner").where(F.struct("part", "seq") > F.col("first"))
    return again.groupBy(*_KEYS).agg(F.collect_list("row_key").alias("earlier"))


def _sum_of(rows):
    """Summary and costs of neighbouring stretches as one, with the keys of the first."""
    total = rows[0]
    for row in rows[1:]:
        total = total | joined_summary(total, row) | {"costs": joined_costs(total["costs"], row["costs"])}
    return total


def _tails(pieces):
    """The inserts that end a conversation, as pieces behind its last one."""
    last = pieces.groupBy("conv_id").agg(F.max_by("after", F.struct("part", "seq")).alias("after"), F.max("part").alias("part"))
    written = {1: ["user", "assistant"], 2: ["assistant"]}
    rows = last.where(F.col("after").isin(*written))
    one = F.col("after") == 2
    return rows.select(
        "conv_id", (F.col("part") + 1).alias("part"), F.lit(0).cast("long").alias("seq"),
        F.when(one, TAILS[2]).otherwise(TAILS[1]).alias("edits"), F.lit(ASSISTANT).cast("long").alias("after"),
        F.when(one, F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant"))).alias("roles"),
        F.when(one, F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.lit(""))).alias("texts"),
    )


def _digests(batches):
    """Audit and digest per conversation from its pieces in order; only the hash's state is held."""
    types = {"conv_id": _LONG, "audit": _TEXT, "repaired_sha256": _TEXT}
    current, state, audit, lines, begun = None, None, [], False, False

    def row():
        return {"conv_id": current, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}

    for one in _rows(batches):
        if not begun or one["conv_id"] != current:
            if begun:
                yield _batch([row()], types)
            current, state, audit, lines, begun = one["conv_id"], hashlib.sha256(), [], False, True
        audit.append(one["edits"])
        if one["roles"]:
            state.update((("\n" if lines else "") + _lines(zip(one["roles"], one["texts"]))).encode("utf-8"))
            lines = True
    if begun:
        yield _batch([row()], types)

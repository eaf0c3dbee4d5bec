r"""Repair of conversations at the least cost, so that roles alternate and no faulty turn stays.

A row's first fault counts: blank (only spaces and the controls 9 to 13), duplicate (its role and text were seen
earlier in the conversation), truncated (its last other character is not one of `.!?`). Edits: keep a row (0), rerole
it to user or assistant (1), delete it (2, required for blank and duplicate rows), insert an empty turn (5); a truncated
row that stays costs 5. The roles that remain start with s(ystem) at most once and then go user, assistant, user ...
assistant; a conversation may also end up empty.

The DP is over the rows that are retained (kept or reroled). Two neighbours i < j among them have all rows between them
deleted, which prefix sums of deletion costs price, and the turns inserted between them follow from their two roles. So
the best way on from row i in a role is a minimum over roles of (running minimum over later rows + inserts of the role
pair); the scan goes from the last row to the first and is linear. Of equally cheap repairs the one with the ASCII-least
audit (D, I, K, R for each edit, in order) is taken: the longest run of deletions first, then more inserts, then K
before R; a running minimum that only a strictly lower cost replaces holds the latest row, which is the longest run.

Two passes, each a shuffle by conversation and a stream through sorted partitions. The first carries no text, only its
digest, and gives one audit a conversation; a conversation takes about 200 bytes a row there. The second walks each
audit along the texts and holds one row at a time. A conversation is one row of the result with one character of audit
an edit, so one of many million turns has to fit in a row; its texts do not.

Cases: null texts and roles count as one space, null turns sort first, a null conv_id is a conversation of its own;
rows of equal turn go by role and then by the SHA-256 of their text, and identical rows lie side by side, the later one a
duplicate; texts are streamed whole at any length; an empty table gives an empty result; a conversation of which only
blank rows are left becomes empty; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, in_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: The state before the first retained row, and what follows the last one.
START, END = "^", "$"
#: Turns to insert between two retained roles that follow each other; a pair that is not here cannot.
INSERTS = {
    (START, "s"): "", (START, "u"): "", (START, "a"): "u", (START, END): "",
    ("s", "u"): "", ("s", "a"): "u", ("s", END): "ua",
    ("u", "a"): "", ("u", "u"): "a", ("u", END): "a",
    ("a", "u"): "", ("a", "a"): "u", ("a", END): "",
}
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as a rule on crc32 of `conv_id:turn` damages them; 0 copies are a dropped row.

    Of the remainder by 20: 0 drops the row, 1 empties its text, 2 takes its `.!?` away, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("fate"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, also of those without rows.

    rows: (conv_id, turn, role, text) and, if there is one, `copies`: how often the row stands there; 0 only names the conversation.
    """
    told = _told(rows)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    faults = told.select(
        "conv_id", "turn", "role", "digest", "copies", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")
    )
    ordered = faults.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    kind = arrow_kind(rows, "conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in counts), ("audit", pa.string())])

    def run(batches):
        yield from in_batches(_audited(_conversations(batches)), schema, lambda row: 256 + len(row[-1]))

    return ordered.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the turns of each repaired conversation, from 0 on; found: audits() of the same rows."""
    kind = arrow_kind(rows, "conv_id")
    schema = pa.schema([("conv_id", kind), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        told = ((c, k, role, text, edit) for c, turns in _walked(batches) for k, (role, text, edit) in enumerate(turns))
        yield from in_batches(told, schema, lambda row: 256 + 4 * len(row[3]))

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _beside(rows, found).mapInArrow(run, f"conv_id {kind}, position long, role string, text string, edit string")


def with_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found: audits() of rows, with repaired_sha256: the hash of the repaired `role:text`, joined by newlines."""
    counts = [c for c in found.columns if c not in ("conv_id", "audit")]
    kind = arrow_kind(rows, "conv_id")
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        def hashed():
            for head, turns in _walked(batches, counts):
                h, between = hashlib.sha256(), b""
                for role, text, _ in turns:
                    h.update(between + role.encode() + b":")
                    h.update(text.encode())
                    between = b"\n"
                yield (*head, h.hexdigest())

        yield from in_batches(hashed(), schema, lambda row: 512 + len(row[-2]))

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _beside(rows, found, counts).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repair_cost(initials: str, gone: list[bool], cut: list[bool]) -> tuple[int, str]:
    """The least cost of a conversation and its audit; rows by the initials of their roles, whether they must go, and whether they are truncated."""
    n = len(initials)
    deleted = [0] * (n + 1)  # deletion costs of the rows before each
    for i in range(n):
        deleted[i + 1] = deleted[i] + DELETE
    # for each role that may come next: cost from its row on plus the deletions before that row, the row, whether it is kept
    least: dict[str, tuple[int, int, bool]] = {END: (deleted[n], n, True)}

    def onward(role: str) -> tuple[int, int, int, bool, str]:
        return min((least[to][0] + INSERT * len(INSERTS[role, to]), -least[to][1], -len(INSERTS[role, to]), not least[to][2], to) for to in least if (role, to) in INSERTS)

    after: list[dict[str, tuple[int, int, int, bool, str]]] = [{} for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        stays = TRUNCATED if cut[i] else 0
        for role in "sua":
            if initials[i] != role and role == "s":
                continue
            after[i][role] = onward(role)
        for role, way in after[i].items():
            cost = stays + (KEEP if initials[i] == role else REROLE) + way[0] - deleted[i + 1]
            if role not in least or cost + deleted[i] < least[role][0]:
                least[role] = (cost + deleted[i], i, initials[i] == role)
    way = onward(START)
    cost, at, told = way[0], 0, []
    while True:
        _, row, inserts, rerole, to = way
        told.append("D" * (-row - at) + "I" * -inserts)
        if to == END:
            return cost, "".join(told)
        told.append("R" if rerole else "K")
        at, way = 1 - row, after[-row][to]


def _told(rows: DataFrame) -> DataFrame:
    copies: Column = F.col("copies") if "copies" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("int").alias("copies"))
    return told.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _beside(rows: DataFrame, found: DataFrame, more: list[str] = ()) -> DataFrame:
    """Each conversation's audit and then its rows in order, side by side in one partition."""
    told = _told(rows).filter("copies > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", "digest", *(F.lit(None).cast("long").alias(c) for c in more))
    nothing = {"turn": "long", "role": "string", "text": "string", "copies": "int", "digest": "binary"}
    heads = found.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), *more)
    both = heads.unionByName(told).withColumn("after", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "digest")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # a few rows at a time, as texts may be long
            yield from zip(*(c.to_pylist() for c in batch.slice(k, 256).columns))


def _conversations(batches) -> Iterator[tuple[object, list[tuple]]]:
    """Conversation and its rows (turn, initial, seen, blank, truncated), one at a time; no text."""
    held, rows, seen, begun = None, [], set(), False
    for conv, turn, role, digest, copies, blank, truncated in _rows(batches):
        if not begun or conv != held:
            if begun:
                yield held, rows
            held, rows, seen, begun = conv, [], set(), True
        for _ in range(copies):
            rows.append((turn, role[:1], (role, digest) in seen, blank, truncated))
            seen.add((role, digest))
    if begun:
        yield held, rows


def _audited(conversations) -> Iterator[tuple]:
    for conv, rows in conversations:
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        blank = [r[3] for r in rows]
        duplicate = [r[2] and not r[3] for r in rows]
        cut = [r[4] and not r[3] and not r[2] for r in rows]
        initials = [r[1] for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        cost, audit = repair_cost(initials, [a or b for a, b in zip(blank, duplicate)], cut)
        yield conv, gaps, sum(blank), sum(duplicate), sum(cut), illegal, cost, audit


def _walked(batches, more: list[str] = ()) -> Iterator[tuple]:
    """conv_id (with `more` and the audit, if asked for), and an iterator of the repaired turns, to be read before the next."""
    rows = _rows(batches)
    head = next(rows, None)
    while head is not None:
        conv, audit = head[0], head[1]
        after: list[tuple] = []

        def turns(conv=conv, audit=audit, after=after):
            expected, edits = "u", iter(audit)
            for row in rows:
                if row[1] is not None:  # the next conversation's audit
                    after.append(row)
                    break
                _, _, _, role, text, copies = row[:6]
                for _ in range(copies):
                    for edit in edits:
                        if edit != "I":
                            break
                        yield NAMES[expected], "", "I"
                        expected = "a" if expected == "u" else "u"
                    if edit == "D":
                        continue
                    stays = role if edit == "K" else NAMES[expected]
                    yield stays, text, edit
                    expected = "a" if stays[:1] == "u" else "u"
            for _ in edits:  # inserts at the end
                yield NAMES[expected], "", "I"
                expected = "a" if expected == "u" else "u"

        told = turns()
        yield ((conv, *head[7 : 7 + len(more)], audit) if more else conv), told
        for _ in told:
            pass
        head = after[0] if after else None

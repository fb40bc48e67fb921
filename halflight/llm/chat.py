"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags per segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around each role's turns, and which role may follow which.

    ``marks`` maps a role to what opens and closes its turns. A role without marks gets
    ``other_open``, its escaped name, ``other_name_end`` and ``other_close``. ``next_roles`` maps a
    state, the role of the turn before or empty at the start, to the roles that may come.
    ``loss_roles`` are learned. ``escape`` must not occur in a mark.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"),
        "assistant": ("<s> ", " </s>")})
    other_open: str = "<|role "
    other_name_end: str = "|>"
    other_close: str = "<|end|>"
    next_roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user",)})
    end_roles: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        """Strings that must not stand in a text; white space at their ends does not matter."""
        found = [m.strip() for pair in self.marks.values() for m in pair]
        found += [self.other_open.strip(), self.other_name_end, self.other_close]
        return sorted(set(found), key=lambda c: (-len(c), c))

    def escape_text(self, text: str, mark: str = "") -> str:
        """The escape doubled, and one after the first character of each control string, also of those
        that end in the ``mark`` behind the text."""
        e, doubled = self.escape, text.replace(self.escape, self.escape * 2)
        starts = "|".join(map(re.escape, self.controls()))
        whole = re.sub(rf"(?=(?:{starts}))(.)", lambda m: m[1] + e * (m.start() < len(doubled)),
                       doubled + mark, flags=re.S)
        return whole[:len(whole) - len(mark)]

    def unescape_text(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(rf"{e}({e}?)", r"\1", text)


SEGMENTS = ("conv_id {}, position long, kind string, segment string, loss boolean, "
            "state string, error string")


def segments_of(role: str | None, text: str | None, template: Template) -> list[tuple[str, str, bool]]:
    """``(kind, segment, loss)`` of one turn; a null role is the empty one, null text is empty."""
    role = role or ""
    if role in template.marks:
        opened, closed = template.marks[role]
    else:
        name_end = template.other_name_end
        opened = template.other_open + template.escape_text(role, name_end) + name_end
        closed = template.other_close
    body = template.escape_text(text or "", closed)
    return [("open", opened, False), ("text", body, role in template.loss_roles),
            ("close", closed, False)]


def format_chat(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per segment: ``conv_id, position, kind, segment, loss, state, error``.

    The segments of a conversation, joined by position, are its formatted text. ``error`` names a
    role that the machine does not allow in its state (on the turn's first segment), or an end in
    the wrong state (a last row of kind ``end`` without text); such conversations are formatted all
    the same, and the caller decides. Turns go by ``turn``, null first; equal turns by role and text,
    so repeated rows are repeated turns. Null conversations form one of their own. An empty table
    gives an empty result.

    A conversation is sorted into one partition and streamed: what a task holds is one batch and one
    state, however many turns a conversation has.
    """
    t = template or Template()
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, position, began = None, "", 0, False

        def ended(out):
            if began and state not in t.end_roles:
                out.append((conv, position, "end", "", False, state, f"ends after {state or 'nothing'}"))

        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                c = None if pd.isna(c) else c
                if not began or c != conv:
                    ended(out)
                    conv, state, position, began = c, "", 0, True
                name = role or ""
                error = None if name in t.next_roles.get(state, ()) else (
                    f"{name or 'no role'} after {state or 'the start'}")
                for n, (what, segment, loss) in enumerate(segments_of(role, text, t)):
                    out.append((c, position, what, segment, loss, name, None if n else error))
                    position += 1
                state = name
            yield _frame(out, kind)
        out = []
        ended(out)
        yield _frame(out, kind)

    return rows.mapInPandas(run, SEGMENTS.format(kind))


def _frame(out: list[tuple], kind: str) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["conv_id", "position", "kind", "segment", "loss", "state", "error"])
    if kind in ("bigint", "int"):
        df["conv_id"] = df["conv_id"].astype("Int64")
    return df


class Reader:
    """Reads a formatted stream back, piece by piece: turns as (role, text), and text under the mask.

    Only marks tell turns apart; the pieces may be cut anywhere between segments.
    """

    def __init__(self, template: Template):
        self.t = template
        self.opens = {o.strip(): r for r, (o, _) in template.marks.items()}
        every = "|".join(map(re.escape, template.controls()))
        self.control = re.compile(every)

    def turn(self, piece: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        first = self.control.match(piece)
        if first is None:
            raise ValueError(f"no turn opens at {piece[:40]!r}")
        if first[0] in self.opens:
            role = self.opens[first[0]]
            opened, closed = self.t.marks[role]
        else:
            name = piece[len(self.t.other_open):]
            role = name[:self.control.search(name).start()]
            opened = self.t.other_open + role + self.t.other_name_end
            role, closed = self.t.unescape_text(role), self.t.other_close
        if not (piece.startswith(opened) and piece.endswith(closed)):
            raise ValueError(f"turn of {role!r} is not closed")
        body = piece[len(opened):len(piece) - len(closed)]
        if self.control.search(body):
            raise ValueError("a control string stands inside a text")
        return role, self.t.unescape_text(body)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """All turns of a whole formatted conversation."""
        closing = {c.strip(): c for _, c in self.t.marks.values()} | {self.t.other_close: self.t.other_close}
        found, start = [], 0
        for m in self.control.finditer(formatted):
            if m[0] in closing:
                mark = closing[m[0]]
                end = m.end() + len(mark) - len(mark.rstrip())
                found.append(self.turn(formatted[start:end]))
                start = end
        if start != len(formatted):
            raise ValueError("text after the last turn")
        return found


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of formatted conversations, read from the segments alone; one row per conversation.

    ``segments`` must come as ``format_chat`` gives them: a conversation in one partition, by
    position. Streams; a task holds one turn's segments and two running digests.
    """
    t = template or Template()
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long, n_errors long, first_error string")
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(t)
        conv, began, held = None, False, []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0,
                    "chars": 0, "errors": 0, "first": None}

        def row():
            return (conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(),
                    s["chars"], s["errors"], s["first"])

        s = fresh()
        for batch in batches:
            out = []
            for c, what, segment, loss, error in zip(
                    batch["conv_id"], batch["kind"], batch["segment"], batch["loss"], batch["error"],
                    strict=True):
                c = None if pd.isna(c) else c
                if not began or c != conv:
                    if began:
                        out.append(row())
                    conv, began, held, s = c, True, [], fresh()
                if error:
                    s["errors"] += 1
                    s["first"] = s["first"] or error
                s["chars"] += len(segment)
                if loss:
                    learned = t.unescape_text(segment)
                    s["loss_chars"] += len(learned)
                    s["loss"].update(learned.encode("utf-8", "surrogatepass"))
                held.append(segment)
                if what == "close":
                    role, text = reader.turn("".join(held))
                    s["n"] += 1
                    s["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    held = []
            yield _digests(out, columns, kind)
        yield _digests([row()] if began else [], columns, kind)

    return segments.mapInPandas(run, schema)


def _digests(out: list[tuple], columns: list[str], kind: str) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=columns)
    if kind in ("bigint", "int"):
        df["conv_id"] = df["conv_id"].astype("Int64")
    return df


def oracle(template: Template | None = None) -> str:
    """DuckDB: what ``read_back`` reads from the formatted table, counted from the table itself."""
    t = template or Template()

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def escaped_length(column: str) -> str:
        counts = [f"(length({column}) - length(replace({column}, {quoted(c)}, ''))) // {len(c)}"
                  for c in [t.escape, *t.controls()]]
        return f"(length({column}) + {' + '.join(counts)})"

    def marks(sizes: dict[str, int], other: str) -> str:
        return "CASE r " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in sizes.items()) + f" ELSE {other} END"

    around = marks({k: len(a) + len(b) for k, (a, b) in t.marks.items()},
                   f"{len(t.other_open) + len(t.other_name_end) + len(t.other_close)} + {escaped_length('r')}")
    allowed = " OR ".join(
        f"(prev = {quoted(state)} AND r IN ({', '.join(map(quoted, roles))}))"
        for state, roles in t.next_roles.items())
    learnt = f"r IN ({', '.join(map(quoted, t.loss_roles))})"
    ending = f"last NOT IN ({', '.join(map(quoted, t.end_roles))})"
    said = quoted("</s>[INST] ok [/INST]")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))),
x AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS s, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM turns),
y AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY n), '') AS prev FROM x),
z AS (SELECT *, CASE WHEN NOT ({allowed}) THEN coalesce(nullif(r, ''), 'no role') || ' after '
  || coalesce(nullif(prev, ''), 'the start') END AS error, {around} + {escaped_length('s')} AS chars FROM y),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || s || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(s)) FILTER ({learnt}), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(s, '' ORDER BY n) FILTER ({learnt}), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(error)::BIGINT AS errors,
  arg_min(error, n) AS early, arg_max(r, n) AS last FROM z GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  errors + CASE WHEN {ending} THEN 1 ELSE 0 END AS n_errors,
  coalesce(early, CASE WHEN {ending} THEN 'ends after ' || coalesce(nullif(last, ''), 'nothing') END)
    AS first_error FROM c"""

"""Chat formatting: records of many layouts to canonical turns, and turns to one template.

A record's layout is recognised by a hash of its nested field paths, which
selects a declarative mapping.  The template marks turns and escapes its
control strings inside texts, so a formatted turn reads back exactly."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from epiframe.llm.common import slices

TURN, END, ESCAPE = "### ", "</turn>", "\\"
#: Role names of other layouts and the canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``turns`` lists (role, content path) in order, role a literal or, with a
    leading ``$``, a path.  With ``each`` the paths are within the items of
    that list.  Paths in ``optional`` may be missing.  ``order`` names a field
    that orders a conversation's records, where each record is one turn."""
    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    optional: tuple[str, ...] = ()
    order: str = ""

    def paths(self) -> set[str]:
        inner = {p for role, content in self.turns for p in (role[1:] if role[:1] == "$" else "", content) if p}
        return {f"{self.each}[].{p}" for p in inner} if self.each else inner | ({self.order} if self.order else set())


MAPPINGS = (
    Mapping("turn_row", (("$role", "text"),), order="turn"),
    Mapping("messages", (("$role", "content"),), each="messages"),
    Mapping("from_value", (("$from", "value"),), each="conversations"),
    Mapping("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
            optional=("system", "input")),
    Mapping("prompt", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("question", (("user", "context"), ("user", "question"), ("assistant", "answer")), optional=("context",)),
)


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths; list items add ``[]``.  A field that holds null is there."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


def _table(mappings) -> tuple[dict[int, Mapping], set[str]]:
    known: dict[int, Mapping] = {}
    for m in mappings:
        need = m.paths() - set(m.optional)
        for some in chain.from_iterable(combinations(m.optional, k) for k in range(len(m.optional) + 1)):
            known.setdefault(fingerprint(need | set(some)), m)
        if m.each:
            known.setdefault(fingerprint({m.each + "[]"}), m)
    return known, set().union(*(m.paths() | ({m.each + "[]"} if m.each else set()) for m in mappings))


class Layouts:
    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known, self.paths = _table(mappings)

    def select(self, record) -> Mapping | None:
        """The mapping for the record's fingerprint; fields that no mapping names do not count."""
        return self.known.get(fingerprint(field_paths(record) & self.paths)) if isinstance(record, dict) else None

    def turns(self, record) -> tuple[str | None, list[tuple[str, str]]]:
        """(layout, canonical (role, text) turns); (None, []) for an unknown layout."""
        m = self.select(record)
        if m is None:
            return None, []
        out = []
        for item in (record[m.each] if m.each else [record]):
            for role, content in m.turns:
                text = _get(item, content)
                if text is None and content in m.optional:
                    continue
                role = _text(_get(item, role[1:])) if role[:1] == "$" else role
                out.append((ROLES.get(role, role), _text(text)))
        return m.name, out


def _get(item, path):
    for key in path.split("."):
        item = item.get(key) if isinstance(item, dict) else None
    return item


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(END, ESCAPE + END).replace(TURN, ESCAPE + TURN)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, first and last + 1 character of the escaped text)."""
    head = TURN + escape(role).replace(":", ESCAPE + ":") + ": "
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; an error if it is none."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record",
                   mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, turn, layout, role, formatted, loss_start, loss_stop): a row per canonical turn.

    ``records`` holds JSON texts.  turn is the record's order field where its
    layout has one, else the place in the record.  loss_start and loss_stop
    mark the escaped text in ``formatted`` that is trained on (assistant
    turns), else null.  Null texts and roles are empty.  A record of unknown
    layout, or no JSON, gives one row with null layout and empty formatted.
    Formatting needs no grouping: a conversation of any length is spread."""
    def run(batches):
        layouts = Layouts(mappings)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                row, cols = [], {n: [] for n in ("turn", "layout", "role", "formatted", "loss_start", "loss_stop")}
                for i, text in enumerate(texts[a:b]):
                    try:
                        record = json.loads(text)
                    except ValueError:
                        record = None
                    layout, turns = layouts.turns(record)
                    own = _get(record, layouts.select(record).order) if layout and layouts.select(record).order else None
                    for k, (role, said) in enumerate(turns or [("", "")] * (layout is None)):
                        formatted, start, stop = format_turn(role, said) if layout else ("", None, None)
                        row.append(i)
                        values = (own if own is not None or layout == "turn_row" else k, layout, role, formatted,
                                  *((start, stop) if role == LOSS_ROLE else (None, None)))
                        for c, v in zip(cols.values(), values):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row, pa.int64())), pa.array(cols["turn"], pa.int64()),
                     *(pa.array(cols[n], pa.string()) for n in ("layout", "role", "formatted")),
                     *(pa.array(cols[n], pa.int64()) for n in ("loss_start", "loss_stop"))],
                    names=["id", *cols])

    pairs = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"id {kind}, turn long, layout string, role string, formatted string, "
                                 "loss_start long, loss_stop long").withColumnRenamed("id", id_col)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted turns.

    Turns are sorted by id, turn and text; a task reads them as a stream and
    keeps running hashes only, so a conversation of any length takes no more
    memory than one batch."""
    def run(batches):
        now, state = None, None

        def row():
            return {"id": [now], "n_turns": [state[0]], "turns_sha256": [state[1].hexdigest()], "loss_chars": [state[2]],
                    "loss_sha256": [state[3].hexdigest()], "formatted_chars": [state[4]]}

        for batch in batches:
            out = []
            for conv, text, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    loss = unescape(text[start:stop])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield _batch(out, kind)
        if state is not None:
            yield _batch([row()], kind)

    rows = formatted.select(F.col(id_col).alias("id"), "formatted", "loss_start", "loss_stop", "turn", "role")
    name = rows.schema["id"].dataType.simpleString()
    kind = to_arrow_type(rows.schema["id"].dataType)
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "formatted")
    return rows.mapInArrow(run, f"id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long").withColumnRenamed("id", id_col)


def _batch(rows: list[dict], kind) -> pa.RecordBatch:
    columns = {k: [v for r in rows for v in r[k]] for k in rows[0]}
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kind if k == "id" else pa.string() if k.endswith("sha256") else pa.int64()) for k, v in columns.items()],
        names=list(columns))

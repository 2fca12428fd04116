"""Chat formatting by schema fingerprints.

A record's layout is the sorted set of its nested field paths with their kinds; its fingerprint
is a hash of those. A declarative mapping is selected by fingerprint and says where the turns
are: paths, the fixed role of each, or names for a list of messages. Layouts that no mapping
was declared for are matched by the mappings' required paths, in order, and the choice is
remembered under the fingerprint.

The template writes an assistant turn as ``<s>text</s>`` and any other as
``[INST]role<newline>text[/INST]``. Inside roles and texts a backslash is doubled, and a
backslash is put before every control string and, in a role, before a newline; reading back
undoes exactly that, so any text survives. What is under the loss mask is the assistant texts.

A conversation is a run of rows sorted by (conversation, turn); turns are written, read back and
digested one by one, so a conversation of any length needs the memory of one turn.

Defined results: a null text or role is empty; a null conversation id is a conversation of its
own; equal turn numbers are ordered by role and then text; repeated rows are turns of their own;
a turn without a number comes first.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_PLAIN = re.compile(r"\\|(?=" + "|".join(re.escape(c) for c in CONTROL) + ")")
_MARK = re.compile(r"\\(.)|(" + "|".join(re.escape(c) for c in CONTROL) + r")|(\n)", re.DOTALL)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. parts: (path, role) of single texts; messages: (path, role names, text names) of a list."""

    name: str
    required: tuple[str, ...]
    parts: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    flat: tuple[str, str] | None = None


#: Layouts in public use.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), messages=("messages", ("role",), ("content",))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), messages=("conversations", ("from",), ("value",))),
    Mapping("instruction with input", ("instruction", "input", "output"), parts=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("instruction", ("instruction", "output"), parts=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction and response", ("instruction", "response"), parts=(("context", "system"), ("instruction", "user"), ("response", "assistant"))),
    Mapping("prompt and completion", ("prompt", "completion"), parts=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt and response", ("prompt", "response"), parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("question and answer", ("question", "answer"), parts=(("context", "system"), ("question", "user"), ("answer", "assistant"))),
    Mapping("one turn", ("role", "text"), flat=("role", "text")),
)
#: Names of the same role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested paths of a record with a sign for each leaf's kind; lists add [] to their name."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value), set()) or {at + "[]:none"}
    return {f"{at}:{'text' if isinstance(value, str) or value is None else 'number'}"}


def fingerprint(value) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths(value))).encode()).hexdigest()[:16]


class Layouts:
    """Selects mappings by fingerprint; at most ``most`` fingerprints are remembered."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS, most: int = 10_000):
        self.mappings, self.most, self.known = mappings, most, {}

    def select(self, record) -> Mapping | None:
        key = fingerprint(record)
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            there = {p.rsplit(":", 1)[0] for p in field_paths(record)}
            self.known[key] = next((m for m in self.mappings if there.issuperset(m.required)), None)
        return self.known[key]


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of a record, in order. Absent single texts make no turn."""
    if mapping.flat:
        return [(_text(record.get(mapping.flat[0])), _text(record.get(mapping.flat[1])))]
    if mapping.messages:
        path, roles, texts = mapping.messages
        found = []
        for m in record[path]:
            role = _text(next((m[r] for r in roles if m.get(r) is not None), ""))
            found.append((ROLES.get(role, role), _text(next((m[t] for t in texts if m.get(t) is not None), ""))))
        return found
    return [(role, _text(record[path])) for path, role in mapping.parts if record.get(path) not in (None, "")]


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\\" + m.group(), text)


def write_turn(role: str, text: str) -> str:
    """One turn as the template marks it."""
    if role == "assistant":
        return f"<s>{escape(text)}</s>"
    return "[INST]" + escape(role).replace("\n", "\\\n") + "\n" + escape(text) + "[/INST]"


def read_turns(formatted: str):
    """Yields (role, text, under the loss mask) of a formatted conversation."""
    role, held, mode = "", [], None
    at = 0
    for m in _MARK.finditer(formatted):
        held.append(formatted[at : m.start()])
        at = m.end()
        if m.group(1) is not None:
            held.append(m.group(1))
        elif m.group(3) is not None:
            if mode == "role":
                role, held, mode = "".join(held), [], "text"
            else:
                held.append("\n")
        else:
            mark = m.group(2)
            if mark in ("[INST]", "<s>"):
                if mode is not None or "".join(held):
                    raise ValueError("a turn starts inside another or after stray text")
                held, mode = [], "role" if mark == "[INST]" else "loss"
            elif mark == "[/INST]" and mode == "text":
                yield role, "".join(held), False
                held, mode = [], None
            elif mark == "</s>" and mode == "loss":
                yield "assistant", "".join(held), True
                held, mode = [], None
            else:
                raise ValueError(f"{mark} where no such turn is open")
    if mode is not None or formatted[at:]:
        raise ValueError("the last turn is open")


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, part, role, text from conv_id, turn and record (JSON). A record of an unknown layout or not JSON has layout null and one empty turn with the role ''."""
    id_type, turn_type = (records.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def scan(batches):
        import pyarrow as pa

        layouts = Layouts(mappings)
        for batch in batches:
            rows, parts, roles, texts, names = [], [], [], [], []
            for i, raw in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mapping = layouts.select(record) if isinstance(record, dict) else None
                for p, (role, text) in enumerate(turns_of(record, mapping) if mapping else [("", "")]):
                    for x, v in zip((rows, parts, roles, texts, names), (i, p, role, text, mapping.name if mapping else None), strict=True):
                        x.append(v)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id").take(at), "turn": batch.column("turn").take(at), "part": pa.array(parts, pa.int32()), "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string()), "layout": pa.array(names, pa.string())})

    return records.select("conv_id", "turn", "record").mapInArrow(scan, f"conv_id {id_type}, turn {turn_type}, part int, role string, text string, layout string")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part, formatted: a conversation is its rows' strings in order of (turn, part, role, text), and rows come sorted so."""
    id_type, turn_type = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [write_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "part": batch.column("part"), "formatted": pa.array(texts, pa.string())})

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    return ordered.select("conv_id", "turn", "part", "role", "text").mapInArrow(scan, f"conv_id {id_type}, turn {turn_type}, part int, formatted string")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from rows sorted by conversation: their turns, mask and digests."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        out, now, state = [], None, None

        def close():
            n, turns, loss_chars, loss, chars = state
            out.append((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            ids = pa.array(columns[0], type_of_ids)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in columns[1:])], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        type_of_ids = None
        for batch in batches:
            type_of_ids = batch.schema.field("conv_id").type
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(piece)
                for role, text, masked in read_turns(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if masked:
                        state[2] += len(text)
                        state[3].update(text.encode())
            if len(out) > 5000:
                yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    return formatted.mapInArrow(scan, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Formatted turns of rows (conv_id, turn, role, text), each taken as a record of its own."""
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return format_turns(canonical_turns(records))

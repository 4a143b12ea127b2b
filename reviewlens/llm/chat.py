"""Conversations of different layouts brought into one chat template, and read back from it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.text import bounded_batches

# Layouts by the nested fields that hold their turns. ``turns`` says how to read them: a list of
# objects with a role and a text field, or single fields that each are a turn of a role. Several
# fields of one role are one turn, joined by an empty line.
LAYOUTS = [
    {"name": "messages", "list": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value"},
    {"name": "dialog", "list": "dialog", "role": "speaker", "text": "text"},
    {"name": "instruction", "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction_short", "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "prompt", "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question", "fields": [("user", ["question"]), ("assistant", ["answer"])]},
    {
        "name": "system_prompt",
        "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])],
    },
]
# What layouts call the roles; any other role is kept as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that a tokenizer or template may take for markup; escaped inside texts and roles.
CONTROLS = [
    TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>",
    "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_READ = re.compile(
    re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.S
)


def escape(text: str) -> str:
    """Backslashes doubled, and one put behind the first character of every control string."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def paths_of(value, known: set[str], prefix: str = "") -> set[str]:
    """The nested field paths of a record that any layout knows; list items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, known, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({prefix + "[]"} & known, *(paths_of(v, known, prefix + "[]") for v in value))
    return {prefix} & known


def _layout_paths(layout: dict) -> set[str]:
    if "list" in layout:
        items = layout["list"] + "[]"
        return {items, f"{items}.{layout['role']}", f"{items}.{layout['text']}"}
    return {field for _, fields in layout["fields"] for field in fields}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def mappings(layouts: list[dict]) -> tuple[set[str], dict[str, dict]]:
    """All known paths, and the layout by fingerprint; an empty list of turns is a layout, too."""
    known = set().union(*map(_layout_paths, layouts))
    by_print = {}
    for layout in layouts:
        by_print[fingerprint(_layout_paths(layout))] = layout
        if "list" in layout:
            by_print[fingerprint({layout["list"] + "[]"})] = layout
    return known, by_print


def turns_of(record, layout: dict) -> list[tuple[str, str]]:
    """(role, text) in order; what is no string becomes its JSON, a null an empty text."""

    def plain(value) -> str:
        return value if isinstance(value, str) else "" if value is None else json.dumps(value)

    if "list" in layout:
        items = [m if isinstance(m, dict) else {layout["text"]: m} for m in record[layout["list"]]]
        turns = [(plain(m.get(layout["role"])), plain(m.get(layout["text"]))) for m in items]
    else:
        turns = [
            (role, "\n\n".join(p for p in (plain(record[f]) for f in fields) if p))
            for role, fields in layout["fields"]
        ]
    return [(ROLES.get(role, role), text) for role, text in turns]


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where in it the texts of the ``learned`` role stand."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _READ.findall(formatted)]


def format_chats(records: DataFrame, layouts: list[dict] | None = None) -> DataFrame:
    """Records of any known layout as formatted conversations.

    ``records``: conv_id, record (a JSON object). Result, one row per row: conv_id, layout, n_turns,
    formatted, loss_spans (start and stop, in code points, of the assistant's texts in ``formatted``).

    The paths of a record's nested fields, as far as any layout names them, are hashed; the hash
    selects the mapping that reads its turns. Fields unknown to all layouts do not count, so extra
    fields do no harm. A record with another set of fields, a null or broken JSON has a null layout
    and no turns. Null texts and roles are empty. Repeated rows give repeated results. Work is row
    by row; a record is held whole, as its formatted text is a single value.
    """
    bounded_batches(records.sparkSession)
    chosen = LAYOUTS if layouts is None else layouts

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_print = mappings(chosen)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            names, counts, texts, masks = [], [], [], []
            for raw in batch.column(1).to_pylist():
                layout, turns = None, []
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if isinstance(record, dict):
                    found = {k: [] if v is None else v for k, v in record.items() if f"{k}[]" in known}
                    record = record | found
                    paths = paths_of(record, known)
                    paths |= {f"{k}[]" for k in found} & known
                    layout = by_print.get(fingerprint(paths))
                if layout is not None:
                    turns = turns_of(record, layout)
                text, spans = render(turns)
                names.append(layout and layout["name"])
                counts.append(len(turns))
                texts.append(text)
                masks.append([{"start": a, "stop": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(masks, span),
                ],
                names=["conv_id", "layout", "n_turns", "formatted", "loss_spans"],
            )

    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), "record")
    return rows.mapInArrow(
        convert,
        "conv_id long, layout string, n_turns long, formatted string, "
        "loss_spans array<struct<start:long,stop:long>>",
    )


def records_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, record) from rows of conv_id, turn, role, text: the "messages" layout.

    Turns are ordered by turn, then role and text; a null counts as an empty role or text, and comes
    first as a turn. A null conv_id is a conversation of its own.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def digests(chats: DataFrame, learned: str = "assistant") -> DataFrame:
    """What is read back from formatted conversations: counts, and digests of turns and learned text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "turns": [], "loss": [], "sha": [], "chars": []}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                out["n"].append(len(turns))
                out["turns"].append(hashlib.sha256(whole.encode()).hexdigest())
                out["loss"].append(len(loss))
                out["sha"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["chars"].append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out.values())],
                schema=pa.schema(
                    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
                ),
            )

    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )

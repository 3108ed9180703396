"""Chat formatting by token-level assembly (operator 2).

Each segment of a conversation, a turn's text or a role's name, is encoded by itself, and the ids reserved for the
template's marks are spliced between the segments, so that no merge crosses a mark and no text can make one. In the
formatted text the marks are strings; control strings that occur in content are broken by an escape that can be undone.
Places of segments, and the mask of what is learned from, come from prefix sums over the segments' lengths.

The work on texts is done turn by turn before any shuffle; conversations are then read in order, so a task holds a turn
and the running digests, never a whole conversation.

Defined results: null text is empty; a null role is the empty role; a null conversation id is a conversation of its
own; turns are ordered by turn, role and text, null first, so repeated rows are turns of their own in a fixed order; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import partitions, read
from siftline.llm.packing import tokenizer

#: The template's marks. Reserved ids follow the vocabulary in this order.
BOS, EOS, USER, USER_END, SYSTEM, SYSTEM_END, ANSWER, ROLE, ROLE_END, TURN_END = MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")
FIRST_RESERVED = 50_257
RESERVED = {m: FIRST_RESERVED + k for k, m in enumerate(MARKS)}
ESCAPE = "\\"
#: The template: what opens and closes a turn of a role. Other roles are named between ROLE marks.
OPEN = {"user": (USER, USER_END), "system": (SYSTEM, SYSTEM_END), "assistant": (ANSWER, EOS)}
_CONTROL = re.compile("|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in sorted(MARKS, key=len, reverse=True)))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_MARK = re.compile("|".join(map(re.escape, sorted(MARKS, key=len, reverse=True))))


def escape(text: str) -> str:
    """The text with its escapes doubled, and an escape behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """A turn as (string, is a mark, is learned from)."""
    if role in OPEN:
        begin, end = OPEN[role]
        return [(begin, True, False), (escape(text), False, role == "assistant"), (end, True, False)]
    return [(ROLE, True, False), (escape(role), False, False), (ROLE_END, True, False), (escape(text), False, False), (TURN_END, True, False)]


def assemble(parts: list[tuple[str, bool, bool]], encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the segments with the reserved ids spliced in, and the mask of learned ids."""
    ids = [np.array([RESERVED[s]], dtype="<u4") if mark else encode(s) for s, mark, _ in parts]
    ends = np.cumsum([len(x) for x in ids])
    mask = np.zeros(int(ends[-1]) + 1, dtype=np.int8)
    for (_, _, learned), x, end in zip(parts, ids, ends, strict=True):
        if learned:
            mask[end - len(x)] += 1
            mask[end] -= 1
    return np.concatenate(ids), np.cumsum(mask[:-1]).astype(np.uint8)


_TURN = "conv_id long, turn long, role string, formatted string, ids binary, loss_mask binary, part int"


def format_turns(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row per turn: its formatted string, its ids (little-endian uint32) and its mask (a byte an id). Rows of one
    conversation by (turn, role, formatted), behind BOS, are its training example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        for b in batches:
            rows = []
            for c, t, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                parts = segments(role or "", text or "")
                ids, mask = assemble(parts, encode)
                rows.append((c, t, role, "".join(p[0] for p in parts), ids.tobytes(), mask.tobytes(), 0))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int32()]
            cols = [*zip(*rows, strict=True)] or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, types, strict=True)], names=[x.split()[0] for x in _TURN.split(", ")])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.mapInArrow(run, _TURN).drop("part")


def parse(ids: np.ndarray, mask: np.ndarray, text_of) -> list[tuple[str, str, str]]:
    """(role, text, learned text) of the turns in assembled ids: read from the ids alone."""
    out, role, at, end = [], None, 0, len(ids)
    of_id = {v: k for k, v in RESERVED.items()}
    opens = {v[0]: k for k, v in OPEN.items()}
    marks = [*np.flatnonzero(ids >= FIRST_RESERVED), end]
    for here, there in zip(marks[:-1], marks[1:], strict=True):
        mark, at = of_id[int(ids[here])], here + 1
        segment = unescape(text_of(ids[at:there]))
        if mark == ROLE:
            role = segment
        elif mark in opens or mark == ROLE_END:
            learned = unescape(text_of(ids[at:there][mask[at:there].astype(bool)]))
            out.append((role if mark == ROLE_END else opens[mark], segment, learned))
    return out


def digests(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """What the formatted turns of each conversation hold, read back from their ids, mask and strings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, now, state, rows = decoder(tokenizer_path), object(), None, []

        def close() -> None:
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4] + len(BOS), state[5] + 1))

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*zip(*rows, strict=True)] or [()] * 7, types, strict=True)], names=names)
        for b in batches:
            for c, formatted, ids, mask in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "ids", "loss_mask")), strict=True):
                if state is None or c != now:
                    close()
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                for role, text, learned in parse(ids, mask, text_of):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
                state[5] += len(ids)
            if len(rows) >= 4096:
                yield flush()
                rows = []
        close()
        yield flush()

    n = partitions(turns.sparkSession)
    order = ("conv_id", "turn", "role", "formatted")
    return turns.repartition(n, "conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long")


def decoder(path: str):
    """A function ids -> text, the inverse of tokenizer(path)."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
    pieces = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
    pieces |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return lambda ids: b"".join([pieces[i] for i in ids.tolist()]).decode()


def join_turns(turns: list[str]) -> str:
    """The formatted strings of a conversation's turns as one."""
    return BOS + "".join(turns)


def split_formatted(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted conversation: read from the string alone."""
    out, role, opens = [], "", {v[0]: k for k, v in OPEN.items()}
    found = [*_MARK.finditer(formatted)]
    for m, after in zip(found, [*found[1:], None], strict=True):
        text = unescape(formatted[m.end() : after.start() if after else None])
        if m[0] == ROLE:
            role = text
        elif m[0] in opens or m[0] == ROLE_END:
            out.append((opens.get(m[0], role), text))
    return out


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(own.coalesce(1))
    return digests(format_turns(rows, path), path).drop("n_ids")


def oracle() -> str:
    """The digests of the turns as they are, and the formatted length by the template's rules."""
    quoted = ", ".join(f"'{m}'" for m in MARKS)
    escaped = f"(length({{0}}) + length({{0}}) - length(replace({{0}}, chr(92), '')) + list_sum(list_transform([{quoted}], lambda m: (length({{0}}) - length(replace({{0}}, m, ''))) // length(m))))".format
    opened = " ".join(f"WHEN role = '{r}' THEN {sum(map(len, OPEN[r]))}" for r in OPEN)
    other = sum(map(len, (ROLE, ROLE_END, TURN_END)))
    says = "</s>[INST] ok [/INST]"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{says}' UNION ALL SELECT -1, 1, 'assistant', '{says}')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(BOS)} + SUM({escaped("text")} + CASE {opened} ELSE {other} + {escaped("role")} END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

"""Chat formatting of typed content parts, with an escape for control strings and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektorloom.llm.common import map_rows

#: The template. A turn is HEAD, the role, COLON, the content and END.
HEAD, COLON, END = "### ", ":\n", "\n</turn>\n"

#: What a text may not hold as it is, and what stands for it; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), ("<part ", "\\p"), (":\n", "\\c"))
_BACK = {escaped: plain for plain, escaped in ESCAPES}
_ESCAPED = re.compile(r"\\[\\hepc]")
_TURN = re.compile(r"### (.*?):\n(.*?)\n</turn>\n", re.DOTALL)

#: Tokens that one unit of a part takes: an image tile, a second of sound, a page.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 512.0}

PART = "struct<type:string,text:string,uri:string,units:double>"


def escape(text: str) -> str:
    for plain, escaped in ESCAPES:
        text = text.replace(plain, escaped)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: _BACK[found[0]], text)


class Flattener:
    """Visits the parts of one conversation: texts are escaped, all else becomes a numbered placeholder."""

    def __init__(self, tokens_per_unit: Mapping[str, float] = TOKENS_PER_UNIT):
        self.tokens_per_unit = tokens_per_unit
        self.attachments: list[dict] = []

    def visit(self, part: Mapping) -> str:
        kind = part["type"] or "text"
        return getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: Mapping) -> str:
        return escape(part["text"] or "")

    def attach(self, part: Mapping) -> str:
        kind, number = part["type"], len(self.attachments) + 1
        tokens = math.ceil((part["units"] or 0.0) * self.tokens_per_unit.get(kind, 0.0))
        self.attachments.append({"number": number, "type": kind, "uri": part["uri"], "tokens": tokens})
        return f"<part {escape(kind)} {number}/>"

    visit_image = visit_audio = visit_document = attach

    def visit_other(self, part: Mapping) -> str:
        """A kind that has no rule is referred to and counts no tokens."""
        return self.attach(part)


def format_turns(turns: list[dict], flattener: Flattener, learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and begin and length of each content that is learned from."""
    out, mask, at = [], [], 0
    for turn in turns:
        role = turn["role"] or ""
        head = HEAD + escape(role) + COLON
        content = "".join(map(flattener.visit, turn["parts"]))
        if role == learn:
            mask.append((at + len(head), len(content)))
        out.append(head + content + END)
        at += len(out[-1])
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a formatted conversation (placeholders stay as they are)."""
    return [(unescape(role), unescape(content)) for role, content in _TURN.findall(formatted)]


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order. ``turns`` has ``conv_id, turn, role`` and ``text`` or ``parts``."""
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    else:
        text = F.coalesce(F.col("text"), F.lit(""))
        parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("uri"), F.lit(None).alias("units")))
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def formatted(turns: DataFrame, learn: str = "assistant", tokens_per_unit: Mapping[str, float] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask`` (begin and length of each learned content),
    ``attachments`` (number, type, uri, tokens) and ``attached_tokens``.

    Turns come in the order of ``turn``; ties by role and content, a null turn first. Null roles and texts are empty;
    a null conversation id is a conversation of its own; parts may be null or empty. Other columns are not read. An
    empty table gives no rows. A conversation is one text, so it is put together in one task.
    """

    def make():
        def work(rows):
            out = {"conv_id": rows["conv_id"], "formatted": [], "mask": [], "attachments": [], "attached_tokens": []}
            for turns_of in rows["turns"]:
                flattener = Flattener(tokens_per_unit)
                text, mask = format_turns(turns_of, flattener, learn)
                out["formatted"].append(text)
                out["mask"].append([{"begin": b, "length": n} for b, n in mask])
                out["attachments"].append(flattener.attachments)
                out["attached_tokens"].append(sum(a["tokens"] for a in flattener.attachments))
            return out

        return work

    schema = (
        "conv_id long, formatted string, mask array<struct<begin:long,length:long>>, "
        "attachments array<struct<number:long,type:string,uri:string,tokens:long>>, attached_tokens long"
    )
    return map_rows(conversations(turns), make, schema)


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all read back from the text and its mask:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""

    def make():
        def work(rows):
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, mask in zip(rows["formatted"], rows["mask"]):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["begin"] : m["begin"] + m["length"]]) for m in mask)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(_sha256("".join(f"{role}\n{said}\n" for role, said in turns)))
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(_sha256(loss))
                out["formatted_chars"].append(len(text))
            return {"conv_id": rows["conv_id"], **out}

        return work

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_rows(chats.select("conv_id", "formatted", "mask"), make, schema)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the hash selects a declarative
mapping that turns prompt, instruction and message layouts into canonical turns.
Turns are rendered by a template whose markers cannot occur inside texts, since
texts are escaped reversibly, and read back from it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other public templates; all hold one of the characters that are escaped.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {v: k for k, v in _ESCAPES.items()} | {"\\n": "\n"}


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbn]", lambda m: _BACK[m[0]], text)


@dataclass(frozen=True)
class Turns:
    """Where turns come from: a list under ``each``, or (``each`` empty) the record itself."""

    each: str
    role: str  # a field, or =constant
    text: tuple[str, ...]  # fields, joined by a blank line where several have text


@dataclass(frozen=True)
class Mapping:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turns, ...]


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), ("system",), (Turns("", "=system", ("system",)), Turns("messages", "role", ("content",)))),
    Mapping("message_parts", ("messages[].role", "messages[].content[].text"), ("system",), (Turns("", "=system", ("system",)), Turns("messages", "role", ("content",)))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",), (Turns("", "=system", ("system",)), Turns("conversations", "from", ("value",)))),
    Mapping("turns", ("turns[].speaker", "turns[].text"), ("system",), (Turns("", "=system", ("system",)), Turns("turns", "speaker", ("text",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "context", "system"), (Turns("", "=system", ("system",)), Turns("", "=user", ("instruction", "input", "context")), Turns("", "=assistant", ("output",)))),
    Mapping("instruction_response", ("instruction", "response"), ("context", "system"), (Turns("", "=system", ("system",)), Turns("", "=user", ("instruction", "context")), Turns("", "=assistant", ("response",)))),
    Mapping("prompt_response", ("prompt", "response"), ("input", "system"), (Turns("", "=system", ("system",)), Turns("", "=user", ("prompt", "input")), Turns("", "=assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), (Turns("", "=system", ("system",)), Turns("", "=user", ("prompt",)), Turns("", "=assistant", ("completion",)))),
    Mapping("question_answer", ("question", "answer"), ("context", "system"), (Turns("", "=system", ("system",)), Turns("", "=user", ("context", "question")), Turns("", "=assistant", ("answer",)))),
    Mapping("question_response", ("question", "response"), ("system_prompt",), (Turns("", "=system", ("system_prompt",)), Turns("", "=user", ("question",)), Turns("", "=assistant", ("response",)))),
    Mapping("pairs", ("history[].prompt", "history[].response"), ("system",), (Turns("", "=system", ("system",)), Turns("history", "=user", ("prompt",)), Turns("history", "=assistant", ("response",)))),
)
#: Roles that layouts name otherwise.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = {p for m in MAPPINGS for p in (*m.required, *m.optional)}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths that lead to values: a.b for fields, [] for list items."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    """Hash of those paths that any mapping knows, so extra fields change nothing."""
    return hashlib.sha256("\n".join(sorted(found & _KNOWN)).encode()).hexdigest()


SELECT = {
    fingerprint({*m.required, *some}): m
    for m in reversed(MAPPINGS)
    for n in range(len(m.optional) + 1)
    for some in itertools.combinations(m.optional, n)
}


def select(found: set[str]) -> tuple[Mapping | None, str]:
    """The mapping of a record's paths and the fingerprint that selected it.

    Where all known paths together have no mapping, those of one mapping after another are tried, in the order of MAPPINGS.
    """
    whole = fingerprint(found)
    if whole in SELECT:
        return SELECT[whole], whole
    for m in MAPPINGS:
        if found >= set(m.required) and (mark := fingerprint(found & {*m.required, *m.optional})) in SELECT:
            return SELECT[mark], mark
    return None, whole


def _text(value) -> str:
    """A text; the texts of a list of content parts; '' for null; the JSON of anything else."""
    if isinstance(value, list) and any(isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
        return "".join(x["text"] for x in value if isinstance(x, dict) and isinstance(x.get("text"), str))
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record, mapping: Mapping, rename_roles: bool = True) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    if {t.each for t in mapping.turns if t.each} and all(t.each for t in mapping.turns if t.role != "=system"):
        each = next(t.each for t in mapping.turns if t.each)
        groups = [[(t, record)] for t in mapping.turns if not t.each] + [
            [(t, item) for t in mapping.turns if t.each] for item in record.get(each) or []
        ]
    else:
        groups = [[(t, record)] for t in mapping.turns]
    out = []
    for t, item in itertools.chain.from_iterable(groups):
        if not isinstance(item, dict) or (t.role == "=system" and not any(record.get(f) for f in t.text)):
            continue
        role = t.role[1:] if t.role[0] == "=" else _text(item.get(t.role))
        parts = [_text(item.get(f)) for f in t.text]
        text = parts[0] if len(parts) == 1 else "\n\n".join(p for p in parts if p)
        out.append((ROLES.get(role, role) if rename_roles else role, text))
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the loss mask, in code points of it."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


_TURN = re.compile(f"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; ValueError if it is none."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "id long, layout string, fingerprint string, text string, mask array<struct<start:long,end:long>>"


def format_records(records: DataFrame, id_col: str = "id", json_col: str = "record") -> DataFrame:
    """``id, layout, fingerprint, text, mask`` of heterogeneous JSON records.

    Defined cases: a record that is null, no JSON object, or of no known layout gets
    layout 'unknown' and null text and mask, so nothing is lost silently. Null or
    missing values are empty texts; other JSON values keep their JSON form. An
    empty message list gives no turns and an empty text. Extra fields and
    columns are ignored, whatever their names; repeated rows each get a row. A record that fits several layouts takes the first of
    MAPPINGS. A very long text is held as a whole, escaped once. No rows, no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch["id"], batch["record"], strict=True):
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                found = paths(value) if isinstance(value, dict) else set()
                mapping, mark = select(found)
                key = None if pd.isna(key) else int(key)
                if mapping is None and found & {"messages[]", "conversations[]", "turns[]", "history[]"}:
                    rows.append((key, "empty", mark, "", []))
                elif mapping is None:
                    rows.append((key, "unknown", mark, None, None))
                else:
                    text, mask = render(canonical(value, mapping, not mapping.name.startswith("message")))
                    rows.append((key, mapping.name, mark, text, [{"start": a, "end": b} for a, b in mask]))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if c == "id" else object) for i, c in enumerate(("id", "layout", "fingerprint", "text", "mask"))})

    return records.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("record")).mapInPandas(run, FORMATTED)


READ = "id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"


def read_formatted(formatted: DataFrame) -> DataFrame:
    """``id, turns, loss_text, formatted_chars`` read back from formatted texts and masks; null texts have no turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, mask in zip(batch["id"], batch["text"], batch["mask"], strict=True):
                text = text or ""
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in (mask if mask is not None else []))
                rows.append((None if pd.isna(key) else int(key), [{"role": r, "text": t} for r, t in read_back(text)], loss, len(text)))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if c == "id" else object) for i, c in enumerate(("id", "turns", "loss_text", "formatted_chars"))})

    return formatted.select("id", "text", "mask").mapInPandas(run, READ)


def records_of_rows(rows: DataFrame) -> DataFrame:
    """One JSON record a conversation, of (conv_id, turn, role, text) rows, in one of several layouts by a hash of its id.

    A conversation of roles other than user, assistant and system has layout 'messages', which keeps roles as they
    are; a question and its answer may be a prompt and response. Turns are ordered by turn, then role and text; null roles
    and texts are empty. Rows without a conv_id are one conversation, of layout 'messages'. A conversation is gathered in one task, since its
    turns are one record.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    named = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    kind = F.when(F.forall("m", lambda x: x["role"].isin("user", "assistant", "system")), F.pmod(F.xxhash64("conv_id"), F.lit(4))).otherwise(0)
    pair = (F.size("m") == 2) & (F.col("m")[0]["role"] == "user") & (F.try_element_at("m", F.lit(2))["role"] == "assistant")
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    each = lambda f: F.transform("m", f)
    messages = F.to_json(F.struct(each(lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    said = F.to_json(F.struct(each(lambda x: F.struct(other(x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations")))
    turns = F.to_json(F.struct(each(lambda x: F.struct(x["role"].alias("speaker"), x["content"].alias("text"))).alias("turns")))
    asked = F.to_json(F.struct(F.col("m")[0]["content"].alias("prompt"), F.try_element_at("m", F.lit(2))["content"].alias("response")))
    chosen = named.withColumn("kind", F.when(F.col("conv_id").isNull(), 0).otherwise(kind))
    record = F.when(F.col("kind") == 1, said).when(F.col("kind") == 2, turns).when((F.col("kind") == 3) & pair, asked).otherwise(messages)
    return chosen.select(F.col("conv_id").alias("id"), record.alias("record"))


def op6_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_formatted(format_records(records_of_rows(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g'))
              + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

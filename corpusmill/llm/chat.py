"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed to a fingerprint; the fingerprint selects a declarative mapping that says
where turns, roles and texts lie, so prompt, instruction and message layouts all become the same turns. A template
then marks the turns of each conversation. Control strings inside texts, of this template and of others, are escaped
reversibly, and a mask marks what a model is trained on: each assistant text, without the marks around it. A table with
a row for each turn is a table of records too: each row has its own fingerprint, and its mapping makes one turn of it.

Defined results: null texts and roles are empty; turns are ordered by number, ties by role and text, repeated rows
stay repeated; rows without a conversation id form one conversation of their own; a record that no mapping fits, or
that is no JSON object, has the layout null and no turns; an empty table gives no rows. Fields and columns that no
mapping names are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, tune


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. `each` is the path of a list of turns with `role` and `text` in it; with `number`
    the record is a turn itself, of that number and of the conversation at `conversation`, and its role stays as it is;
    else `fixed` lists (role, path) pairs in order. `optional` paths may be missing."""

    name: str
    each: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    number: str | None = None
    conversation: str = ""

    def required(self) -> frozenset[str]:
        if self.number is not None:
            named = [self.conversation, self.number, self.role, self.text]
        else:
            named = [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"] if self.each is not None else [p for _, p in self.fixed]
        return frozenset(p for p in named if p not in self.optional)

    def known(self) -> frozenset[str]:
        return self.required() | frozenset(self.optional)


#: Names that other layouts give to the three roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Rows of turns come first: whatever other columns a table has, it is one of turns.
TURN_ROWS = (
    Mapping("turn row", conversation="conv_id", number="turn", role="role", text="text"),
    Mapping("indexed row", conversation="conversation_id", number="index", role="author", text="content"),
)
MAPPINGS = (
    *TURN_ROWS,
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("conversations", each="conversations", role="from", text="value"),
    Mapping("dialog", each="dialog", role="speaker", text="utterance"),
    Mapping("nested messages", each="data.messages", role="author.role", text="content"),
    Mapping("prompt", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt and completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("instruction", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("question", fixed=(("system", "system_prompt"), ("user", "question"), ("assistant", "answer")), optional=("system_prompt",)),
)


def paths_of(value: object, at: str = "") -> set[str]:
    """Paths of the leaves; the entries of a list share one path. A null has the path of its field."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value))
    return {at} if at else set()


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _index(mappings: tuple[Mapping, ...]) -> tuple[frozenset[str], dict[str, Mapping]]:
    """All paths that mappings know; fingerprint of each set of paths that a mapping accepts -> mapping."""
    found: dict[str, Mapping] = {}
    for m in mappings:
        sets = [m.required()]
        for p in m.optional:
            sets += [s | {p} for s in sets]
        for s in sets:
            found.setdefault(fingerprint(s), m)
    return frozenset().union(*(m.known() for m in mappings)), found


def _get(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of one record. Paths outside all mappings do not count; a record that carries the paths of
    several mappings takes the first that it satisfies."""
    known, index = _index_of(mappings)
    paths = paths_of(record) & known
    m = index.get(fingerprint(paths)) or next((m for m in mappings if m.required() <= paths), None)
    if m is None:
        return None, []
    if m.number is not None:
        return m.name, [(_text(_get(record, m.role)), _text(_get(record, m.text)))]
    if m.each is not None:
        pairs = [(_text(_get(t, m.role)), _text(_get(t, m.text))) for t in _get(record, m.each) or []]
    else:
        pairs = [(role, _text(_get(record, p))) for role, p in m.fixed if p in paths]
    return m.name, [(ROLES.get(r, r), t) for r, t in pairs]


_CACHE: dict = {}


def _index_of(mappings: tuple[Mapping, ...]):
    if mappings not in _CACHE:
        _CACHE[mappings] = _index(mappings)
    return _CACHE[mappings]


def number_of(record: object, layout: str | None, mappings: tuple[Mapping, ...] = MAPPINGS) -> int | None:
    """The turn's own number in a record that is one turn; null is one, too."""
    path = next((m.number for m in mappings if m.name == layout), None)
    value = _get(record, path) if path else None
    return int(value) if isinstance(value, int | float) else None


def turns_of_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records (conv_id, record: a JSON text) -> conv_id, layout, turn, role, text; a record without turns keeps one row with nulls."""
    tune(records.sparkSession)
    rows_of_turns = {m.name for m in mappings if m.number is not None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column("conv_id").to_pylist(), b.column("record").to_pylist(), strict=True):
                try:
                    record = json.loads(text or "null")
                    layout, turns = turns_of(record, mappings)
                except (ValueError, RecursionError):
                    record, layout, turns = None, None, []
                if layout in rows_of_turns:
                    rows.append((i, layout, number_of(record, layout, mappings), *turns[0]))
                else:
                    rows += [(i, layout, k, r, t) for k, (r, t) in enumerate(turns)] or [(i, layout, None, None, None)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "layout", "turn", "role", "text"])

    return records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")).mapInArrow(run, "conv_id long, layout string, turn long, role string, text string")


def turns_of_table(table: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text of a table with a row for each turn: every row is a record with a fingerprint of its own."""
    m = next((m for m in mappings if m.number is not None and {m.conversation, m.number, m.role, m.text} <= set(table.columns)), None)
    if m is None:
        raise ValueError(f"no mapping for fields {sorted(table.columns)}")
    known = {p.split(".")[0].removesuffix("[]") for k in mappings for p in k.known()}
    record = F.to_json(F.struct(*[F.col(c) for c in table.columns if c in known]), {"ignoreNullFields": "false"})
    return turns_of_records(table.select(F.col(m.conversation).alias("conv_id"), record.alias("record")), mappings).select("conv_id", "turn", "role", "text")


# The template. Only marks contain "<|"; texts never do once escaped.
OPEN, HEAD, CLOSE = "<|turn|>", "<|says|>", "<|over|>\n"
LEARNED = "assistant"
#: What tokenizers and templates give a meaning to; "<|" starts the marks of this template and of many others.
CONTROLS = (
    "<|", "<s>", "</s>", "<bos>", "<eos>", "<pad>", "<unk>", "<mask>", "<start_of_turn>", "<end_of_turn>", "<<SYS>>", "<</SYS>>", "<think>", "</think>", "<tool_call>", "</tool_call>", "[INST]", "[/INST]",
    "[BOS]", "[EOS]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[UNK]", "[AVAILABLE_TOOLS]", "[/AVAILABLE_TOOLS]", "[TOOL_CALLS]", "[TOOL_RESULTS]", "[/TOOL_RESULTS]",
)
#: What stands for the first character of a control string in a text.
ENTITIES = {"<": "&lt;", "[": "&#91;"}


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """Text in which no control string occurs. Each must start with a character of ENTITIES."""
    text = text.replace("&", "&amp;")
    for c in controls:
        text = text.replace(c, ENTITIES[c[0]] + c[1:])
    return text


def unescape(text: str) -> str:
    for plain, entity in ENTITIES.items():
        text = text.replace(entity, plain)
    return text.replace("&amp;", "&")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans (code points) that are learned from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{HEAD}", escape(text)
        parts += [head, body, CLOSE]
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition(HEAD)
        out.append((unescape(role), unescape(rest.removesuffix(CLOSE))))
    return out


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, formatted, loss_spans.

    Rows arrive sorted, so a task holds one conversation at a time, which is one output row."""
    tune(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list) -> pa.RecordBatch:
            made = [(c, *render(t)) for c, t in done]
            spans = [[{"first": a, "end": b} for a, b in s] for *_, s in made]
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array(spans, pa.list_(_SPAN))], ["conv_id", "formatted", "loss_spans"])

        done, current, own = [], None, []
        for b in batches:
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if own and c != current:
                    done.append((current, own))
                    own = []
                current = c
                own.append((role, text))
            if done:
                yield out(done)
                done = []
        if own:
            yield out([(current, own)])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<first: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[s["first"] : s["end"]]) for s in spans)
                rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), _sha(learned), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op4_chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns_of_table(rows)))


def _escaped(column: str) -> str:
    """The SQL of escape()."""
    out = f"replace({column}, '&', '&amp;')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{ENTITIES[c[0]]}{c[1:]}')"
    return out


ORACLE = {
    "op4_chat_fingerprints": f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length({_escaped("role")}) + length({_escaped("text")}) + {len(OPEN + HEAD + CLOSE)} AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
}

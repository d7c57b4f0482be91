"""Chat records of many layouts as canonical turns, and turns as training text with a loss mask.

A record is one JSON object. The paths of all its fields, however nested (``messages[].content``), are hashed to
a fingerprint; the fingerprint selects one of the declared layouts, once for all records alike. A layout fits
when all paths that it needs are there; of several the one whose paths have most steps, then the first. A layout
says where the turns are: a list with a role and a text in each element, or one field or more per turn.

The text marks every turn as ``### role: text</turn>`` and a line end. Inside of roles and texts a backslash,
``##`` and ``</turn>`` (in roles also ``: ``) are broken up by a backslash, so no text can hold a mark, and
``read_back`` takes every backslash away again. The loss mask is a list of code point ranges: the texts of the
learned roles as they stand in the formatted text, without marks.

- A record that is NULL, no JSON object or fits no layout (an empty list of turns fits none) has NULL for
  ``layout`` and ``turns``; one that is not an object has no fingerprint either. All rows stay.
- A NULL text or role, or a turn without the key, is empty. Numbers, lists and objects as texts are their JSON.
  Surrogates without a partner become ``?``. A field that a layout calls optional gives no turn if it is absent or NULL.
- Repeated rows are alike; of a key that stands twice in an object the last counts. An empty table gives no rows.
- Texts of any length are formatted whole; a conversation is one value and so must fit into a row.
- Other columns pass through; the columns that a function adds replace those of the same name.

``turns_of_rows`` gathers tables with a row per turn: ordered by turn (NULL first), ties by role and text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

HEAD, BETWEEN, END = "### ", ": ", "</turn>\n"
LEARNED = ("assistant",)
#: Fingerprints whose layout a task keeps in mind.
REMEMBERED = 10_000


@dataclass(frozen=True)
class Turns:
    """A list of turns at ``path``; ``role`` and ``text`` are paths from its elements. ``roles`` renames roles.

    An element without the path ``text`` is read at ``instead``.
    """

    name: str
    path: str
    role: str
    text: str
    instead: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def needs(self) -> set[str]:
        return {f"{self.path}.{self.role}", f"{self.path}.{self.text}"}

    def read(self, record: dict) -> list[tuple[str, str]]:
        found = []
        for turn in follow(record, self.path):
            role = plain("".join(map(plain, follow(turn, self.role))))
            texts = follow(turn, self.text) or (follow(turn, self.instead) if self.instead else [])
            found.append((self.roles.get(role, role), "".join(map(plain, texts))))
        return found


@dataclass(frozen=True)
class Field:
    """One turn: the values of ``paths`` that are not empty, with ``joint`` between them."""

    role: str
    paths: tuple[str, ...]
    optional: bool = False
    joint: str = "\n"


@dataclass(frozen=True)
class Fields:
    """One turn per field; the first path of a field that is not optional must be there."""

    name: str
    fields: tuple[Field, ...]

    def needs(self) -> set[str]:
        return {f.paths[0] for f in self.fields if not f.optional}

    def read(self, record: dict) -> list[tuple[str, str]]:
        found = []
        for f in self.fields:
            values = [v for path in f.paths for v in follow(record, path) if v is not None]
            if values or not f.optional:
                found.append((f.role, f.joint.join(text for text in map(plain, values) if text)))
        return found


Layout = Turns | Fields

SYSTEM = Field("system", ("system",), optional=True)
LAYOUTS: tuple[Layout, ...] = (
    Turns("messages", "messages[]", "role", "content"),
    Turns("message_parts", "messages[]", "role", "content[].text", "content"),
    Turns("conversations", "conversations[]", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Turns("dialog", "dialog.turns[]", "speaker", "utterance"),
    Fields("instruction", (SYSTEM, Field("user", ("instruction", "input")), Field("assistant", ("output",)))),
    Fields("prompt", (SYSTEM, Field("user", ("prompt",)), Field("assistant", ("response",)))),
)


def follow(node, path: str) -> list:
    """All values at a path: ``a.b[].c``."""
    nodes = [node]
    for step in path.split("."):
        name, lists = step.rstrip("[]"), step.count("[]")
        nodes = [n[name] for n in nodes if isinstance(n, dict) and name in n]
        for _ in range(lists):
            nodes = [e for n in nodes if isinstance(n, list) for e in n]
    return nodes


def plain(value) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


def field_paths(record: dict) -> set[str]:
    """The paths of all fields and list elements; dots, brackets and backslashes in names are escaped."""
    found, rest = set(), [("", record)]
    while rest:
        at, node = rest.pop()
        if isinstance(node, dict):
            rest += [(f"{at}.{re.sub(r'([.\[\]\\])', r'\\\1', key)}".removeprefix("."), value) for key, value in node.items()]
        elif isinstance(node, list):
            rest += [(f"{at}[]", value) for value in node]
        if at:
            found.add(at)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()


def choose(paths: set[str], layouts: tuple[Layout, ...]) -> Layout | None:
    fitting = [layout for layout in layouts if layout.needs() <= paths]
    steps = lambda layout: sum(1 + path.count(".") + path.count("[]") for path in layout.needs())
    return max(fitting, key=steps, default=None)


def row_function(kind: T.StructType, compute: Callable) -> Callable[..., Column]:
    """An Arrow function of rows: ``compute`` gets the plain values of the columns, and returns a dict."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [compute(*values) for values in zip(*(column.to_pylist() for column in batch.flatten()))]
            yield pa.array(rows, to_arrow(kind))

    applied = F.arrow_udf(run, kind)
    return lambda *columns: applied(F.struct(*columns))


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return pa.int64() if isinstance(kind, T.LongType) else pa.string()


def with_parts(df: DataFrame, value: Column, names: dict[str, str]) -> DataFrame:
    """Add fields of a struct as columns; a generator keeps the function from running once per column."""
    found = df.withColumn("__parts", F.explode(F.array(value)))
    return found.withColumns({name: F.col("__parts")[part] for name, part in names.items()}).drop("__parts")


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` of the JSON objects in column ``record``."""
    kind = T.StructType(
        [T.StructField("fingerprint", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", T.ArrayType(TURN))]
    )
    known: dict[str, Layout | None] = {}

    def read(text: str | None):
        try:
            value = json.loads(text) if text else None
        except (ValueError, RecursionError):
            value = None
        if not isinstance(value, dict):
            return {"fingerprint": None, "layout": None, "turns": None}
        paths = field_paths(value)
        mark = fingerprint(paths)
        if mark not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[mark] = choose(paths, layouts)
        layout = known[mark]
        if layout is None:
            return {"fingerprint": mark, "layout": None, "turns": None}
        return {"fingerprint": mark, "layout": layout.name, "turns": [{"role": r, "text": t} for r, t in layout.read(value)]}

    return with_parts(df, row_function(kind, read)(F.col(record)), {name: name for name in ("fingerprint", "layout", "turns")})


def layout_report(canonical: DataFrame) -> DataFrame:
    """``fingerprint``, ``layout``, ``rows``: what layouts a corpus has, and which of them no declaration covers."""
    return canonical.groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("rows"))


def turns_of_rows(df: DataFrame, key: str, order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` and ``turns`` from a table with a row per turn."""
    turn = F.struct(
        F.col(order).alias("order"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(BETWEEN, ":\\ ")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(df: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Add ``formatted`` and ``loss`` (ranges ``start``, ``stop`` of code points) for the turns in ``turns``."""
    kind = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(SPAN))])

    def write(turns):
        if turns is None:
            return {"formatted": None, "loss": None}
        parts, loss, at = [], [], 0
        for turn in turns:
            role, text = turn["role"] or "", escape(turn["text"] or "")
            head = f"{HEAD}{escape_role(role)}{BETWEEN}"
            if role in learned:
                loss.append({"start": at + len(head), "stop": at + len(head) + len(text)})
            parts += [head, text, END]
            at += len(head) + len(text) + len(END)
        return {"formatted": "".join(parts), "loss": loss}

    return with_parts(df, row_function(kind, write)(F.col("turns")), {"formatted": "formatted", "loss": "loss"})


def read_back(df: DataFrame) -> DataFrame:
    """Replace ``turns`` by those read from ``formatted``, and add ``loss_text``: what the mask covers, unescaped."""
    kind = T.StructType([T.StructField("turns", T.ArrayType(TURN)), T.StructField("loss_text", T.StringType())])

    def read(formatted, loss):
        if formatted is None:
            return {"turns": None, "loss_text": None}
        turns = []
        for piece in formatted.split(END)[:-1]:
            role, _, text = piece.removeprefix(HEAD).partition(BETWEEN)
            turns.append({"role": unescape(role), "text": unescape(text)})
        return {"turns": turns, "loss_text": "".join(unescape(formatted[s["start"] : s["stop"]]) for s in loss or ())}

    return with_parts(df, row_function(kind, read)(F.col("formatted"), F.col("loss")), {"turns": "turns", "loss_text": "loss_text"})


def turns_digest(turns: Column) -> Column:
    """SHA-256 of role, line end, text, line end of every turn."""
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)

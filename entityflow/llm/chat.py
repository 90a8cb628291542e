"""Operator 5: chat formatting that links tool calls with their results.

A message (conv_id, turn, role, text) is an assistant's tool calls, if its text is a JSON object with ``tool_calls`` (a
list of id, name, arguments and optionally depends_on, ids of calls whose results it needs); a tool's result, if it is
an object with ``tool_call_id`` and ``content``; else a plain message. ``link`` reads each message once into events,
validates the arguments against the tool's schema (a JSON schema with type, required, properties,
additionalProperties, items and enum), joins results to calls by (conv_id, call id), orders events topologically and
gives each as canonical JSON: sorted keys, no spaces, no escapes but those JSON needs.

The order is by (order_turn, order_depth, turn, part): an event keeps its own turn, at depth 0, unless an event that it
needs comes no earlier; then it takes that event's place, one deeper. A result needs its call, a call the results of
those it depends on.

Scale: parsing is a row expression. One hash join by conversation and id; equal ids are pre-aggregated to the first
call and the first result, so no bucket is paired with itself. Depths are found by rounds over the calls that depend on
others alone, one round for each link of the longest chain, each written to the shared folder. No event is gathered by
conversation, so one conversation may hold any share of all rows.

Cases: null and empty texts and texts that are no such JSON are plain messages; a null text has ``text`` null. Of calls
(or results) with one id in a conversation the first by turn, part and JSON is linked, the others have the error
``duplicate id``; exactly repeated rows are told apart by nothing, and all count as the first. A result without a call has the
error ``no call``; a call without a result is not linked. Calls in a cycle have the error ``cycle`` and their own turn.
A tool without a schema takes any object. JSON with NaN, Infinity or a number beyond doubles, or nested too deep to be
read, is a plain message; half a surrogate pair is written as its escape. A very long text is one row. No rows: no rows. Extra columns are not returned.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import materialize, only

RESULT = ["conv_id", "turn", "part", "kind", "call_id", "linked", "errors", "order_turn", "order_depth", "json"]

_EVENT = "array<struct<kind:string,call_id:string,needs:array<string>,errors:array<string>,json:string>>"
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON: keys sorted by code point, no spaces, characters as they are but for halves of surrogate pairs."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _plain(text: str) -> str:
    """A name as UTF-8 can hold it."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is no JSON number that a double holds")
    return value


def parse(text: str):
    """The JSON value of a text; ValueError where it is none, or holds a number beyond doubles, NaN or Infinity."""
    return json.loads(text, parse_float=_finite, parse_constant=_finite)


def _is(value, kind) -> bool:
    """Whether a value has a JSON schema's type, or one of a list of types; an unknown type has no values."""
    if isinstance(kind, list):
        return any(_is(value, k) for k in kind)
    whole = isinstance(value, int) and not isinstance(value, bool)
    if kind == "integer":
        return whole or (isinstance(value, float) and value.is_integer())
    if kind == "number":
        return whole or isinstance(value, float)
    return isinstance(value, _TYPES.get(kind, ()))


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` breaks in ``schema``, as texts in order of the path."""
    out = []
    if "type" in schema and not _is(value, schema["type"]):
        kind = schema["type"]
        return [f"{at}: not {'/'.join(map(str, kind)) if isinstance(kind, list) else kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += validate(x, schema["items"], f"{at}[{i}]")
    return out


def events(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The events of one message."""
    plain = {"kind": "message", "call_id": None, "needs": [], "errors": [], "json": canonical({"role": role, "text": text})}
    try:
        found = parse(text) if text and text.lstrip().startswith("{") else None
        return _tool_events(found, schemas) or [plain]
    except (ValueError, RecursionError):
        return [plain]


def _tool_events(found, schemas: dict[str, dict]) -> list[dict]:
    if not isinstance(found, dict):
        return []
    calls = found.get("tool_calls")
    if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        out = []
        for c in calls:
            errors = [_plain(e) for e in validate(c.get("arguments"), {"type": "object"} | schemas.get(str(c.get("name")), {}))]
            needs = [_plain(str(n)) for n in c["depends_on"]] if isinstance(c.get("depends_on"), list) else []
            body = {"arguments": c.get("arguments"), "id": c["id"], "name": c.get("name")} | ({"depends_on": needs} if needs else {})
            out.append({"kind": "call", "call_id": _plain(c["id"]), "needs": needs, "errors": errors, "json": canonical(body)})
        return out
    if isinstance(found.get("tool_call_id"), str) and "content" in found:
        body = canonical({"content": found["content"], "id": found["tool_call_id"]})
        return [{"kind": "result", "call_id": _plain(found["tool_call_id"]), "needs": [], "errors": [], "json": body}]
    return []


def read(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, part, kind, call_id, needs, errors, json): one row per event."""

    def of(role: pa.Array, text: pa.Array) -> pa.Array:
        strings = pa.list_(pa.string())
        kind = pa.struct([("kind", pa.string()), ("call_id", pa.string()), ("needs", strings), ("errors", strings), ("json", pa.string())])
        return pa.array([events(r.as_py(), t.as_py(), schemas) for r, t in zip(role, text, strict=True)], pa.list_(kind))

    of.__annotations__ = {"role": pa.Array, "text": pa.Array, "return": pa.Array}
    parsed = only(messages, "conv_id", "turn", "role", "text")
    parsed = parsed.select("conv_id", "turn", F.posexplode(F.arrow_udf(of, _EVENT)("role", "text")).alias("part", "e"))
    return parsed.select("conv_id", "turn", "part", "e.*")


def _firsts(found: DataFrame, kind: str) -> DataFrame:
    """(conv, call_id, first) of each id's first event of a kind."""
    place = F.struct("turn", "part", "json")
    return found.filter(F.col("kind") == kind).groupBy("conv", "call_id").agg(F.min(place).alias(f"{kind}_first"))


def _later(turn, at_turn, at_depth, own):
    """The place of an event of ``turn`` behind one at (at_turn, at_depth): ``own`` picks turn or depth."""
    behind = at_turn >= turn
    return F.when(behind, at_turn).otherwise(turn) if own == "turn" else F.when(behind, at_depth + 1).otherwise(F.lit(0))


def call_places(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, call_id, at_turn, at_depth) of each linked call; null places are calls in or behind a cycle."""
    edges = calls.select("conv", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need"))
    # Only needs that have a call and a result can be waited for.
    both = calls.select("conv", F.col("call_id").alias("need")).join(
        results.select("conv", F.col("call_id").alias("need"), F.col("turn").alias("result_turn")), ["conv", "need"]
    )
    edges = materialize(edges.join(both, ["conv", "need"]), "call-needs")
    waiting = edges.select("conv", "call_id").distinct()
    free = calls.join(waiting, ["conv", "call_id"], "left_anti")
    done = materialize(free.select("conv", "call_id", F.col("turn").alias("at_turn"), F.lit(0).alias("at_depth")), "call-places")
    left = edges
    while not left.isEmpty():
        placed = done.select("conv", F.col("call_id").alias("need"), "at_turn", "at_depth")
        tried = left.join(placed, ["conv", "need"], "left")
        t = _later(F.col("result_turn"), F.col("at_turn"), F.col("at_depth"), "turn")
        d = _later(F.col("result_turn"), F.col("at_turn"), F.col("at_depth"), "depth")
        tried = tried.groupBy("conv", "call_id").agg(
            F.first("turn").alias("turn"), F.max(F.struct(t.alias("t"), d.alias("d"))).alias("m"), F.count_if(F.col("at_turn").isNull()).alias("open")
        )
        ready = tried.filter("open = 0").select(
            "conv", "call_id", _later(F.col("turn"), F.col("m.t"), F.col("m.d"), "turn").alias("at_turn"), _later(F.col("turn"), F.col("m.t"), F.col("m.d"), "depth").alias("at_depth")
        )
        ready = materialize(ready, "call-places")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        left = materialize(left.join(ready.select("conv", "call_id"), ["conv", "call_id"], "left_anti"), "call-needs")
    return done.unionByName(left.select("conv", "call_id").distinct().withColumns({"at_turn": F.lit(None).cast("bigint"), "at_depth": F.lit(None).cast("int")}))


def link(messages: DataFrame, *, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per event: conv_id, turn, part, kind, call_id, linked, errors, order_turn, order_depth and json."""
    found = read(messages, schemas or {}).withColumn("turn", F.col("turn").cast("bigint"))
    found = materialize(found.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))), "chat-events")
    first = {kind: materialize(_firsts(found, kind), f"first-{kind}s") for kind in ("call", "result")}
    place = F.struct("turn", "part", "json")
    calls = found.filter(F.col("kind") == "call").join(first["call"], ["conv", "call_id"]).filter(place.eqNullSafe(F.col("call_first")))
    calls = calls.select("conv", "call_id", F.coalesce("turn", F.lit(-1)).alias("turn"), "needs").dropDuplicates(["conv", "call_id"])
    results = first["result"].select("conv", "call_id", F.coalesce("result_first.turn", F.lit(-1)).alias("turn"))
    links = materialize(
        call_places(materialize(calls, "calls"), results)
        .join(first["call"], ["conv", "call_id"], "full")
        .join(first["result"], ["conv", "call_id"], "full"),
        "call-links",
    )
    plain = found.filter(F.col("kind") == "message").withColumns(
        {"linked": F.lit(False), "order_turn": F.col("turn"), "order_depth": F.lit(0)}
    )
    rest = found.filter(F.col("kind") != "message").join(links, ["conv", "call_id"])
    is_call = F.col("kind") == "call"
    mine = place.eqNullSafe(F.when(is_call, F.col("call_first")).otherwise(F.col("result_first")))
    has_call = F.col("call_first").isNotNull()
    cyclic = has_call & F.col("at_turn").isNull()
    extra = F.array_compact(
        F.array(
            F.when(~mine, F.lit("duplicate id")),
            F.when(~is_call & ~has_call, F.lit("no call")),
            F.when(is_call & mine & cyclic, F.lit("cycle")),
        )
    )
    turn = F.coalesce("turn", F.lit(-1))
    call_turn, call_depth = F.coalesce("at_turn", "call_first.turn", F.lit(-1)), F.coalesce("at_depth", F.lit(0))
    of_call = {"turn": call_turn, "depth": call_depth}
    behind = {own: _later(turn, call_turn, call_depth, own) for own in of_call}
    order = {own: F.when(~mine | ~has_call, turn if own == "turn" else F.lit(0)).when(is_call, of_call[own]).otherwise(behind[own]) for own in of_call}
    rest = rest.withColumns(
        {
            "linked": mine & has_call & F.col("result_first").isNotNull(),
            "errors": F.concat("errors", extra),
            "order_turn": order["turn"],
            "order_depth": order["depth"],
        }
    )
    return plain.select(*RESULT).unionByName(rest.select(*RESULT)).withColumn("errors", F.array_join("errors", "; "))


#: Turns of a chain of calls in ``from_turns``.
CHAIN = 8
#: The tool that ``from_turns`` calls: a prompt of text, and a limit that must be a whole number.
ANSWER = {
    "answer": {
        "type": "object",
        "required": ["prompt"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string"}, "limit": {"type": ["integer", "null"]}},
    }
}


def from_turns(conversations: DataFrame) -> DataFrame:
    """Conversations without tools as tool dialogues: a user's turn calls ``answer``, the next turn is the result.

    A call needs the one before it within a chain of ``CHAIN`` turns. Made to occur in whole tables: a prompt that ends in
    a question mark needs the next call too, which makes a cycle with it; a prompt of more than 100 characters has an
    argument that its schema does not know, and one with a digit a limit that is no whole number.
    """
    turn = lambda t: F.concat_ws(":", F.lit("turn"), t.cast("string"))
    t, prompt = F.col("turn"), F.coalesce("text", F.lit(""))
    before = F.when((t >= 2) & (t % CHAIN >= 2), turn(t - 2))
    after = F.when(F.rtrim(prompt).endswith("?") & (t % CHAIN < CHAIN - 2), turn(t + 2))
    arguments = F.struct(
        F.col("text").alias("prompt"),
        F.when(prompt.rlike("[0-9]"), 0.5).alias("limit"),
        F.when(F.length(prompt) > 100, F.length(prompt)).alias("length"),
    )
    call = F.struct(
        turn(t).alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"),
        F.array_compact(F.array(before, after)).alias("depends_on"),
    )
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    said = F.to_json(F.struct(turn(t - 1).alias("tool_call_id"), prompt.alias("content")))
    text = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", said).otherwise(F.col("text"))
    return only(conversations, "conv_id", "turn", "role", "text").withColumn("text", text)

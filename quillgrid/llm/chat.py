"""Operator 8: chat formatting with linked tool calls.

Input rows are messages (conv_id, turn, role, text). A text that is a JSON object may carry tool calls
({"content", "tool_calls": [{"id", "name", "arguments"}]}, also in the form with "function"), a tool
result ({"tool_call_id", "content"}), or tools and their schemas ({"tools": [{"name", "parameters"}]}); any
other text is plain content. Calls and results are joined by conversation and identifier. Messages are then
ordered topologically: a result follows its call, and a call follows the results that its arguments
name as {"$ref": identifier}; otherwise turns keep their order. Arguments are validated against the
schema that the conversation declares, or else against `schemas`. Every message becomes one line of
canonical JSON: sorted keys, no spaces, no escapes but those that JSON demands.

Joins are on (conversation, identifier) and work on calls only. A message stays a row throughout: messages are put in
order by ranges of (conversation, place), and positions follow from the counts of the ranges before, so that a
conversation may be spread over any number of tasks and is never gathered.

Order. With place(u) the greater of (turn of u, 0) and (a, d + 1) over the places (a, d) of the messages that u waits for, sorting by
place, then turn, is topological. Where all that is waited for lies in earlier turns, place(u) is (turn, 0). Only connected groups of
waiting messages with an edge that does not are worked on: each in one pass over its edges, if it has at most
GROUP_EDGES, which holds a few numbers an edge and no texts; greater groups step by step over all of them at once.
The number of jobs depends neither on how many messages wait nor on cycles.

Defined results: a null text is empty content, a null role "unknown", a null turn sorts last; rows with a
null conv_id form one conversation of their own. Of several calls with one identifier the first counts
and the others are `duplicate`; a result without its call is `orphan`, a call without a result `open`.
Messages that wait for each other, or for such, keep their turns and are `cycle`. Equal turns keep the order of the table.
Repeated rows each give a line; an empty table gives none; extra columns are ignored. JSON may be nested to any depth and
texts may have any length. Half a surrogate pair, which a JSON escape can name but no text can hold, becomes U+FFFD; numbers
of more digits than Python reads (4300) leave the text plain content.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .components import components

#: Edges of a connected group of waiting messages that one task puts in order at once.
GROUP_EDGES = 1_000_000
#: Messages in a range of the ordered table.
RANGE = 200_000
#: The place of a message without a turn.
_LAST = 2**62

_PARSED = "conv_id bigint, turn bigint, uid bigint, role string, content string, extra string, calls array<struct<id: string, name: string, arguments: string, refs: array<string>>>, result_of string, tools array<struct<name: string, parameters: string>>"


_LONE = re.compile("[\ud800-\udfff]")
_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)', re.S)
_quoted = json.JSONEncoder(ensure_ascii=False).encode


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces; numbers that are not finite become null. Works to any depth."""
    out: list[str] = []
    todo: list = [(value,)]  # strings are told as they are, values are wrapped
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (v,) = x
        if isinstance(v, dict):
            todo.append("}")
            for n, k in enumerate(sorted(v, reverse=True)):
                todo += [(v[k],), ("," if n < len(v) - 1 else "") + _quoted(k) + ":"]
            todo.append("{")
        elif isinstance(v, list):
            todo.append("]")
            for n, own in enumerate(reversed(v)):
                todo.append((own,))
                if n < len(v) - 1:
                    todo.append(",")
            todo.append("[")
        elif isinstance(v, float) and not math.isfinite(v):
            out.append("null")
        else:
            out.append(_quoted(v))
    return "".join(out)


def _deep(text: str):
    """The value of a JSON text that is nested too deep for the library's parser."""
    top: list = []
    stack: list = [top]
    keys: list = [None]  # of each open object the key that waits for its value; None elsewhere
    want = "value"  # or: first (value or end), key, first key, colon, next
    at, end = 0, len(text.rstrip(" \t\n\r"))

    def put(v):
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = v
        else:
            stack[-1].append(v)

    while at < end:
        m = _TOKEN.match(text, at)
        if not m or want == "next" and len(stack) == 1:
            raise ValueError("not JSON")
        at, token = m.end(), m[1]
        if want in ("value", "first") and token not in ("]", "}", ",", ":"):
            if token in ("{", "["):
                own = {} if token == "{" else []
                put(own)
                stack.append(own)
                keys.append(None)
                want = "first key" if token == "{" else "first"
            else:
                put(json.loads(token))
                want = "next"
        elif want in ("key", "first key") and token[0] == '"':
            keys[-1], want = json.loads(token), "colon"
        elif want == "colon" and token == ":":
            want = "value"
        elif want == "next" and token == ",":
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif want in ("next", "first", "first key") and len(stack) > 1 and token == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop()
            keys.pop()
            want = "next"
        else:
            raise ValueError("not JSON")
    if len(stack) > 1 or not top:
        raise ValueError("not JSON")
    return top[0]


def _whole(value):
    """The value without halves of surrogate pairs."""
    fit = lambda s: _LONE.sub("�", s)
    out = [value]
    todo: list = [(out, 0)]
    while todo:
        where, at = todo.pop()
        v = where[at]
        if isinstance(v, str):
            where[at] = fit(v)
        elif isinstance(v, list):
            todo += [(v, i) for i in range(len(v))]
        elif isinstance(v, dict):
            where[at] = own = {fit(k): x for k, x in v.items()}
            todo += [(own, k) for k in own]
    return out[0]


def _loaded(text: str):
    """The value of a JSON text; ValueError if it is none."""
    try:
        got = json.loads(text)
    except RecursionError:
        got = _deep(text)
    return _whole(got) if "\\ud" in text or "\\uD" in text else got


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        got = _loaded(text)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def _word(value) -> str:
    """A name or identifier as text."""
    return value if isinstance(value, str) else canonical(value)


def _references(value) -> list[str]:
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$ref"), str):
                out.append(v["$ref"])
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
    return sorted(set(out))


def parse(text: str | None) -> dict:
    """What a message carries: content, calls, result_of, tools and other keys."""
    got = _object(text)
    if got is None or not any(isinstance(got.get(k), t) for k, t in (("tool_calls", list), ("tool_call_id", str), ("tools", list))):
        return {"content": text or "", "extra": None, "calls": [], "result_of": None, "tools": []}
    calls, tools = [], []
    for c in got.get("tool_calls") if isinstance(got.get("tool_calls"), list) else []:
        if isinstance(c, dict):
            f = c["function"] if isinstance(c.get("function"), dict) else c
            args = f.get("arguments")
            if isinstance(args, str):
                try:
                    args = _loaded(args)
                except ValueError:
                    pass
            calls.append({"id": None if c.get("id") is None else _word(c["id"]), "name": _word(f.get("name") or ""), "arguments": canonical(args), "refs": _references(args)})
    for t in got.get("tools") if isinstance(got.get("tools"), list) else []:
        if isinstance(t, dict):
            f = t["function"] if isinstance(t.get("function"), dict) else t
            tools.append({"name": _word(f.get("name") or ""), "parameters": canonical(f.get("parameters"))})
    content = got.get("content")
    rest = {k: v for k, v in got.items() if k not in ("content", "tool_calls", "tool_call_id", "tools", "role")}
    of = got.get("tool_call_id")
    return {"content": content if isinstance(content, str) else "" if content is None else canonical(content), "extra": canonical(rest) if rest else None, "calls": calls, "result_of": of if isinstance(of, str) else None, "tools": tools}


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return (isinstance(value, int) or isinstance(value, float) and value.is_integer()) and not isinstance(value, bool)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def faults(value, schema) -> list[str]:
    """Where a value breaks a JSON schema (type, enum, const, properties, required, additionalProperties, items, bounds).

    A reference ({"$ref": ...}) stands for a value that is not known yet and fits any schema. Works to any depth.
    """
    out: list[str] = []
    todo: list = [(value, schema, None)]  # with the way there as (way of the parent, key); or the text of a fault
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(_faults_at(*x))
    return out


def _at(way) -> str:
    parts = []
    while way:
        way, key = way
        parts.append(f"/{key}")
    return "".join(reversed(parts))


def _faults_at(value, schema, way) -> list:
    """The faults of the value itself, and what is to be looked at inside of it, in order."""
    if not isinstance(schema, dict) or isinstance(value, dict) and isinstance(value.get("$ref"), str):
        return []
    out: list = []
    say = lambda what: out.append(f"{_at(way) or '$'}: {what}")
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
    if kinds and not any(isinstance(k, str) and _is(value, k) for k in kinds):
        say("not " + "|".join(map(_word, kinds)))
        return out
    if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]):
        say("not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        say("not the constant")
    if _is(value, "number"):
        if _is(schema.get("minimum"), "number") and value < schema["minimum"]:
            say("below minimum")
        if _is(schema.get("maximum"), "number") and value > schema["maximum"]:
            say("above maximum")
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if _is(schema.get(low), "integer") and len(value) < schema[low]:
            say("too short")
        if _is(schema.get(high), "integer") and len(value) > schema[high]:
            say("too long")
    if isinstance(value, dict):
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        for k in schema.get("required") if isinstance(schema.get("required"), list) else []:
            if isinstance(k, str) and k not in value:
                out.append(f"{_at((way, k))}: missing")
        for k in sorted(value):
            if k in known:
                out.append((value[k], known[k], (way, k)))
            elif schema.get("additionalProperties") is False:
                out.append(f"{_at((way, k))}: unknown")
            else:
                out.append((value[k], schema.get("additionalProperties"), (way, k)))
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        out += [(v, schema["items"], (way, i)) for i, v in enumerate(value)]
    return out


def parsed(messages: DataFrame) -> DataFrame:
    names = [f.strip().split()[0] for f in ("conv_id", "turn", "uid", "role", "content", "extra", "calls", "result_of", "tools")]
    call = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string()))]))
    tool = pa.list_(pa.struct([("name", pa.string()), ("parameters", pa.string())]))

    def run(batches):
        for part in batches:
            got = [parse(t) for t in part.column("text").to_pylist()]
            pick = lambda k, t: pa.array([g[k] for g in got], t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "uid", "role")), pick("content", pa.string()), pick("extra", pa.string()), pick("calls", call), pick("result_of", pa.string()), pick("tools", tool)], names)

    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.monotonically_increasing_id().alias("uid"), F.coalesce("role", F.lit("unknown")).alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PARSED)


def linked_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (caller, place, id, name, arguments, refs, link) and results (uid, conv_id, id, caller, link)."""
    calls = rows.select("conv_id", "turn", F.col("uid").alias("caller"), F.posexplode("calls").alias("place", "c")).select("conv_id", "turn", "caller", "place", "c.*")
    # the first call of each identifier, by an aggregate that combines per task, as one identifier may be in any number of calls
    place = F.struct(F.coalesce("turn", F.lit(_LAST)).alias("turn"), "caller", "place")
    firsts = calls.where("id is not null").groupBy(F.col("conv_id").alias("c2"), F.col("id").alias("i2")).agg(F.min(place).alias("first"))
    results = rows.where("result_of is not null").select("uid", "conv_id", F.col("result_of").alias("id"))
    answered = results.select(F.col("conv_id").alias("c3"), F.col("id").alias("i3")).distinct()
    same = lambda c, i: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("id") == F.col(i))
    calls = calls.join(firsts, same("c2", "i2"), "left").join(answered, same("c3", "i3"), "left")
    link = F.when(F.col("first").isNotNull() & (F.col("first") != place), "duplicate").when(F.col("i3").isNull(), "open").otherwise("linked")
    calls = calls.withColumn("link", link).drop("c2", "i2", "c3", "i3", "first")
    results = results.join(firsts.select("c2", "i2", F.col("first.caller").alias("caller")), same("c2", "i2"), "left")
    results = results.withColumn("link", F.when(F.col("caller").isNull(), "orphan").otherwise("linked")).drop("c2", "i2")
    return calls, results


def waits_of(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(u, on): results wait for their calls, and calls for the results that their arguments name."""
    answers = results.where("caller is not null").select(F.col("uid").alias("u"), F.col("caller").alias("on"))
    asked = calls.select("conv_id", F.col("caller").alias("u"), F.explode("refs").alias("ref"))
    known = results.where("link = 'linked'").select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), F.col("uid").alias("on"))
    needs = asked.join(known, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("ref") == F.col("i2"))).select("u", "on")
    return answers.union(needs).where("u != on").distinct()


def places_of(u: np.ndarray, on: np.ndarray, turn_u: np.ndarray, turn_on: np.ndarray) -> list[tuple]:
    """(uid, after, depth, cycle) of all messages of a group, given as its edges; the messages nobody waits for come last."""
    place = dict(zip(u.tolist(), zip(turn_u.tolist(), [0] * len(u)))) | dict(zip(on.tolist(), zip(turn_on.tolist(), [0] * len(on))))
    open_of: dict[int, int] = dict.fromkeys(place, 0)
    asked_by: dict[int, list[int]] = {}
    for a, b in zip(u.tolist(), on.tolist()):
        open_of[a] += 1
        asked_by.setdefault(b, []).append(a)
    ready, done = [x for x, n in open_of.items() if not n], set()
    while ready:
        b = ready.pop()
        done.add(b)
        after, depth = place[b]
        for a in asked_by.get(b, ()):
            place[a] = max(place[a], (after, depth + 1))
            open_of[a] -= 1
            if not open_of[a]:
                ready.append(a)
    return [(x, *p, x not in done) for x, p in place.items()]


_PLACES = "uid bigint, after bigint, depth bigint, cycle boolean"
_EDGE = ("component", "u", "on", "turn_u", "turn_on")


def _grouped_places(edges: DataFrame) -> DataFrame:
    """The places of groups of a bounded number of edges, each group in one task."""
    names = [f.split()[0] for f in _PLACES.split(", ")]

    def run(batches):
        held = None
        for part in batches:
            cols = [part.column(c).to_numpy() for c in _EDGE]
            if held is not None:
                cols = [np.append(a, b) for a, b in zip(held, cols)]
            fresh = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            last = int(fresh[-1]) if len(fresh) else 0
            if last:
                yield told([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield told(held)

    def told(cols):
        rows = []
        edge = np.append(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, len(cols[0]))
        for a, b in zip(np.append(0, edge), edge):
            rows += places_of(*(c[a:b] for c in cols[1:]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return edges.select(*_EDGE).repartition("component").sortWithinPartitions("component").mapInArrow(run, _PLACES)


def _stepped_places(edges: DataFrame) -> DataFrame:
    """The places of groups of any size: each step settles the messages that wait for settled ones only."""
    ends = edges.select(F.col("u").alias("uid"), F.col("turn_u").alias("turn")).union(edges.select("on", "turn_on")).distinct()
    first = ends.join(edges.select(F.col("u").alias("uid")), "uid", "left_anti")
    settled = fresh = stage(first.select("uid", F.col("turn").alias("after"), F.lit(0).cast("bigint").alias("depth")), "places")
    left = edges
    while not fresh.isEmpty():
        known = settled.select(F.col("uid").alias("on"), "after", "depth")
        each = left.join(known, "on", "left").groupBy("u").agg(
            F.max("turn_u").alias("turn"), F.count_if(F.col("after").isNull()).alias("open"), F.max(F.struct("after", (F.col("depth") + 1).alias("depth"))).alias("m"))
        m = F.greatest("m", F.struct(F.col("turn").alias("after"), F.lit(0).cast("bigint").alias("depth")))
        fresh = stage(each.where("open = 0").select(F.col("u").alias("uid"), m.alias("m")).select("uid", "m.after", "m.depth"), "places")
        settled = settled.union(fresh)
        left = stage(left.join(fresh.select(F.col("uid").alias("u")), "u", "left_anti"), "waits")
    waiting = ends.join(settled.select("uid"), "uid", "left_anti").select("uid", F.col("turn").alias("after"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("cycle"))
    return settled.withColumn("cycle", F.lit(False)).union(waiting)


def placed(rows: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame | None:
    """(uid, after, depth, cycle) of the messages whose place may not be their turn; None if there is none."""
    turns = rows.select("uid", F.coalesce("turn", F.lit(_LAST)).alias("turn"))
    of = lambda end: turns.select(F.col("uid").alias(end), F.col("turn").alias(f"turn_{end}"))
    edges = stage(waits_of(calls, results).join(of("u"), "u").join(of("on"), "on"), "waits")
    if edges.where("turn_on >= turn_u").isEmpty():
        return None
    groups = components(edges.select("u", F.col("on").alias("v"))).withColumnRenamed("node", "u")
    edges = stage(edges.join(groups, "u"), "waits")
    sizes = edges.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("turn_on") >= F.col("turn_u")).alias("moved")).where("moved > 0")
    edges = stage(edges.join(sizes.select("component", "n"), "component"), "waits")
    small, large = edges.where(F.col("n") <= GROUP_EDGES), edges.where(F.col("n") > GROUP_EDGES)
    out = _grouped_places(small)
    return out if large.isEmpty() else out.union(_stepped_places(stage(large, "waits")))


_LINES = "pid int, local bigint, conv_id bigint, turn bigint, role string, n_calls bigint, links string, valid boolean, line string"


def formatted(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, position, turn, role, n_calls, links, valid, line) of every message.

    links holds the link of each call, then that of the message as a result; valid is false if an argument
    breaks its schema; position counts from 0 within a conversation.
    """
    rows = stage(parsed(messages), "messages")
    calls, results = linked_calls(rows)
    declared = rows.select("conv_id", "turn", "uid", F.posexplode("tools").alias("at", "t")).select("conv_id", "t.name", "t.parameters", "turn", "uid", "at")
    declared = declared.groupBy("conv_id", "name").agg(F.max_by("parameters", F.struct("turn", "uid", "at")).alias("parameters"))
    declared = declared.select(F.col("conv_id").alias("c2"), F.col("name").alias("n2"), "parameters")
    calls = calls.join(declared, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("name") == F.col("n2")), "left")
    calls = calls.groupBy("caller").agg(F.sort_array(F.collect_list(F.struct("place", "id", "name", "arguments", "link", "parameters"))).alias("made"))
    out = rows.drop("calls", "tools").join(calls.withColumnRenamed("caller", "uid"), "uid", "left")
    out = out.join(results.select("uid", F.col("link").alias("answer")), "uid", "left")
    places = placed(rows, *linked_calls(rows))
    turn = F.coalesce("turn", F.lit(_LAST))
    if places is None:
        out = out.withColumns({"cycle": F.lit(False), "after": turn, "depth": F.lit(0).cast("bigint")})
    else:
        moved = F.col("after").isNotNull() & ~F.coalesce("cycle", F.lit(False))
        out = out.join(places, "uid", "left").withColumns({"cycle": F.coalesce("cycle", F.lit(False)), "after": F.when(moved, F.col("after")).otherwise(turn), "depth": F.when(moved, F.col("depth")).otherwise(0)})
    sent = messages.sparkSession.sparkContext.broadcast(schemas or {})
    names = [f.split()[0] for f in _LINES.split(", ")]

    def run(batches):
        pid = TaskContext.get().partitionId()
        conv, seen = None, 0
        for part in batches:
            done = [line(r, sent.value) for r in part.to_pylist()]
            local = []
            for c in part.column("conv_id").to_pylist():
                conv, seen = (c, seen + 1) if seen and c == conv else (c, 1)
                local.append(seen)
            cols = list(zip(*done)) if done else [[]] * 4
            told = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([pid] * part.num_rows, pa.int32()), pa.array(local, pa.int64()), *(part.column(c) for c in ("conv_id", "turn", "role")), *told], names)

    ranges = max(1, -(-rows.count() // RANGE), min(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    picked = out.select("conv_id", "turn", "role", "content", "extra", "result_of", "made", "answer", "cycle", "after", "depth", "uid").withColumn("turn_", turn)
    keys = ["conv_id", "after", "depth", "turn_", "uid"]
    lines = stage(picked.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(run, _LINES), "lines")
    # a conversation that goes over several ranges: what the ranges before hold of it
    held = lines.groupBy("pid", "conv_id").agg(F.max("local").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = held.withColumn("before", before).where("before > 0").select(F.col("pid").alias("p2"), F.col("conv_id").alias("c2"), "before")
    lines = lines.join(several, (F.col("pid") == F.col("p2")) & F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    position = F.col("local") - 1 + F.coalesce("before", F.lit(0))
    return lines.select("conv_id", position.alias("position"), "turn", "role", "n_calls", "links", "valid", "line")


def line(r: dict, schemas: dict[str, dict]) -> tuple[int, str, bool, str]:
    """n_calls, links, valid and the canonical line of a message."""
    body: dict = {"role": r["role"], "content": r["content"]}
    if r["extra"]:
        body["extra"] = _loaded(r["extra"])
    wrong: list[str] = []
    made = r["made"] or []
    if made:
        body["tool_calls"] = []
        for c in made:
            args = _loaded(c["arguments"])
            schema = _loaded(c["parameters"]) if c["parameters"] else schemas.get(c["name"])
            own = faults(args, schema)
            wrong += own
            body["tool_calls"].append({"id": c["id"], "name": c["name"], "arguments": args, "link": c["link"], **({"errors": own} if own else {})})
    links = [c["link"] for c in made]
    if r["result_of"] is not None:
        body |= {"tool_call_id": r["result_of"], "link": r["answer"]}
        links.append(r["answer"])
    if r["cycle"]:
        body["cycle"] = True
        links.append("cycle")
    return len(made), ",".join(links), not wrong, canonical(body)


#: For tables whose texts are all plain content.
ORACLE_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, turn, role, 0::BIGINT AS n_calls, '' AS links, true AS valid,
  '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS line
FROM conversations
"""

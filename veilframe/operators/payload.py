"""Text slots of chat payloads: every string and key of a JSON tree with its path, put back by path.

Walking and setting are Python on one payload at a time; all that decides anything is joins over the slots.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "array<struct<path:string,where:string,is_key:boolean,text:string>>"
#: Fields whose strings are read by nobody but programs.
_PLAIN = {("model",), ("messages", "role"), ("messages", "tool_call_id"), ("messages", "tool_calls", "id"), ("messages", "tool_calls", "type"), ("messages", "tool_calls", "function", "name"), ("messages", "content", "type"), ("tools", "type"), ("tools", "function", "name"), ("functions", "name"), ("choices", "finish_reason"), ("choices", "message", "role"), ("choices", "delta", "role"), ("choices", "message", "tool_calls", "id"), ("choices", "message", "tool_calls", "type"), ("choices", "message", "tool_calls", "function", "name"), ("id",), ("object",)}


def _strings(node, path: tuple = ()) -> Iterator[tuple[tuple, str, bool]]:
    """Paths, strings and whether each is a key, in document order."""
    stack: list = [(node, path)]
    while stack:
        node, path = stack.pop()
        if isinstance(node, str):
            yield path, node, False
        elif isinstance(node, dict):
            yield from ((path, k, True) for k in node)
            stack += [(v, (*path, k)) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(v, (*path, k)) for k, v in reversed(list(enumerate(node)))]


def _where(path: tuple) -> str | None:
    """What part of a request or reply a string is, if it is one of those that carry text."""
    names = tuple(x for x in path if isinstance(x, str))
    match names:
        case ("messages", "content") | ("messages", "content", "text"):
            return "content"
        case ("messages", "name"):
            return "name"
        case ("messages", "tool_calls", "function", "arguments") | ("choices", "message" | "delta", "tool_calls", "function", "arguments"):
            return "arguments"
        case ("tools" | "functions", *_, "description"):
            return "description"
        case ("metadata" | "prediction", *_) | ("user",):
            return names[0]
        case ("choices", "message" | "delta", "content") | ("choices", "text"):
            return "reply"
    return "plain" if names in _PLAIN else None


_KEYS = {"model", "messages", "role", "content", "name", "tool_calls", "tool_call_id", "id", "type", "function", "arguments", "text", "tools", "functions", "description", "parameters", "properties", "metadata", "prediction", "user", "choices", "message", "delta", "index", "finish_reason", "temperature", "max_tokens", "stream", "n", "top_p", "stop", "object", "required", "enum", "items", "default"}


def slots(payloads: DataFrame) -> DataFrame:
    """(payload_id, status, path, where, is_key, text) of every string and of every key that no known field is called.

    ``where`` is null for what no known field explains.  A null payload or one that is no JSON is one row with
    status ``invalid`` and nothing else; a payload without a string has no row.
    """

    def run(payload: pd.Series) -> pd.Series:
        out = []
        for p in payload:
            try:
                tree = json.loads(p)
            except (TypeError, ValueError, RecursionError):
                out.append(None)
                continue
            out.append([{"path": json.dumps(path), "where": None if key else _where(path), "is_key": key, "text": t} for path, t, key in _strings(tree) if not (key and t in _KEYS)])
        return pd.Series(out, dtype=object)

    found = payloads.select("payload_id", F.pandas_udf(run, SLOT)("payload").alias("_slots"))
    bad = found.where("_slots is null").select("payload_id", F.lit("invalid").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("where", "string"), ("is_key", "boolean"), ("text", "string"))))
    return found.select("payload_id", F.lit("ok").alias("status"), F.explode("_slots").alias("s")).select("payload_id", "status", "s.path", "s.where", "s.is_key", "s.text").unionByName(bad)


def put_back(payloads: DataFrame, changed: DataFrame) -> DataFrame:
    """payloads with ``status`` and the texts of changed (payload_id, path, text) set at their paths.

    Null or broken payloads keep what they are, with status ``invalid``; so do those with a change whose path isn't
    there or holds no string, with status ``no_such_path``: then nothing of it is changed.
    """
    texts = changed.groupBy("payload_id").agg(F.collect_list(F.struct("path", "text")).alias("_texts"))

    def run(payload: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for p, ts in zip(payload, texts):
            try:
                tree = json.loads(p)
            except (TypeError, ValueError, RecursionError):
                out.append((p, "invalid"))
                continue
            try:
                for t in ts if ts is not None else []:
                    *way, last = json.loads(t["path"])
                    node = tree
                    for k in way:
                        node = node[k]
                    if not isinstance(node[last], str):
                        raise KeyError(t["path"])
                    node[last] = t["text"]
            except (LookupError, TypeError, ValueError):
                out.append((p, "no_such_path"))
                continue
            out.append((json.dumps(tree, ensure_ascii=False, separators=(",", ":")), "ok"))
        return pd.DataFrame(out, columns=["payload", "status"])

    done = payloads.join(texts, "payload_id", "left").withColumn("_done", F.pandas_udf(run, "payload string, status string")("payload", "_texts"))
    return done.withColumn("payload", F.col("_done.payload")).withColumn("status", F.col("_done.status")).drop("_texts", "_done")


def json_survived(before: Column, after: Column) -> Column:
    """Whether what was JSON before still is."""
    return F.try_parse_json(before).isNull() | F.try_parse_json(after).isNotNull()


def leftovers(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(payload_id) of payloads with sensitive text in a string or key that no known field explains; entities have (payload_id, path)."""
    return entities.join(found.where(F.col("where").isNull()).select("payload_id", "path").distinct(), ["payload_id", "path"], "left_semi").select("payload_id").distinct()


def protect_requests(payloads: DataFrame, protect_texts, guidance: str | None = None) -> DataFrame:
    """(payload_id, payload, status) of requests (payload_id, scope, payload), all slots of one protected in its scope.

    ``protect_texts`` takes (scope, turn, text), where turn is (payload_id, slot), and gives (scope, turn, status,
    protected_text, found): found says whether anything but allowed values is in the text.  A request with a blocked
    or refused slot, or with anything found in a field that isn't known, is not sent: payload null, status
    ``blocked``.  ``guidance`` goes before the messages as a system message.
    """
    found = slots(payloads.select("payload_id", "payload"))
    named = found.where("status = 'ok' and coalesce(where, '') <> 'plain'").join(payloads.select("payload_id", "scope"), "payload_id")
    turn = F.to_json(F.struct("payload_id", "path", "is_key"))
    done = protect_texts(named.select("scope", turn.alias("turn"), "text"))
    key = F.from_json("turn", f"payload_id {payloads.schema['payload_id'].dataType.simpleString()}, path string, is_key boolean")
    done = done.withColumn("_k", key).select("_k.*", F.col("status").alias("slot_status"), "protected_text", "found")
    done = done.join(found.select("payload_id", "path", "where", "is_key"), ["payload_id", "path", "is_key"])
    bad = done.where((F.col("slot_status") != "ok") | (F.col("found") & F.col("where").isNull())).select("payload_id").distinct().withColumn("_bad", F.lit(True))
    changed = done.where("where is not null and not is_key").select("payload_id", "path", F.col("protected_text").alias("text"))
    out = put_back(payloads.select("payload_id", "payload"), changed).join(bad, "payload_id", "left")
    out = out.withColumn("status", F.when(F.col("_bad"), "blocked").otherwise(F.col("status")))
    body = F.col("payload")
    if guidance is not None:
        lead = json.dumps({"role": "system", "content": guidance}, ensure_ascii=False, separators=(",", ":"))
        body = F.regexp_replace(body, r'"messages":\[', F.lit('"messages":[' + lead.replace("\\", "\\\\").replace("$", "\\$") + ","))
    return out.select("payload_id", F.when(F.col("status") == "ok", body).alias("payload"), "status")


def restore_replies(replies: DataFrame, restore_texts) -> DataFrame:
    """(payload_id, payload, status) of replies (payload_id, scope, payload), prose and arguments of calls restored.

    ``restore_texts`` takes (scope, response_id, text) and gives (scope, response_id, restored_text).  Arguments that
    were JSON before and would not be after stay as they came.
    """
    found = slots(replies.select("payload_id", "payload")).where("where in ('reply', 'arguments') and not is_key")
    named = found.join(replies.select("payload_id", "scope"), "payload_id").withColumn("response_id", F.to_json(F.struct("payload_id", "path")))
    back = restore_texts(named.select("scope", "response_id", "text")).select("response_id", "restored_text")
    text = F.when((F.col("where") == "arguments") & ~json_survived(F.col("text"), F.col("restored_text")), F.col("text")).otherwise(F.col("restored_text"))
    return put_back(replies.select("payload_id", "payload"), named.join(back, "response_id").select("payload_id", "path", text.alias("text")))


def summary(by_type: Column) -> Column:
    """'2 EMAIL, 1 PHONE' of a map of counts, types in order."""
    return F.concat_ws(", ", F.transform(F.array_sort(F.map_keys(by_type)), lambda k: F.concat_ws(" ", F.element_at(by_type, k).cast("string"), k)))

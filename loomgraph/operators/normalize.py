"""Episodes of chat, calls, analytics and records as readable text, with the policy that their source implies.

Everything is an expression on the metadata's JSON text: labelled lines from the
fields that are there, in a fixed order, by the kind of source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VISIBILITY
from ..security import merged, policy

#: Words in a source type that tell its kind, in the order in which they are looked for.
KINDS = {"chat": ("slack",), "call": ("call", "meeting", "transcript"), "event": ("analytics", "event", "metric"), "record": ("crm", "record")}

#: Labels of lines, and the fields that each may come from (the first one that is there).
CHAT = {"Workspace": ("workspaceId",), "Channel": ("channel",), "Channel ID": ("channelId",), "Sender": ("userId",), "Sender name": ("userName",), "Thread": ("threadTs",)}
TITLE = ("title", "meetingTitle", "callTitle")
EVENT = {"Event": ("event", "eventName", "name", "metric"), "Actor": ("actor", "userId", "accountId"), "Value": ("value", "count", "amount")}
EVENT_OBJECTS = {"Dimensions": ("dimensions",), "Identity": ("identity", "traits"), "Properties": ("context", "properties")}
RECORD = {"Record type": ("recordType", "objectType", "type"), "Record ID": ("recordId", "id", "externalId"), "Owner": ("owner", "ownerId", "accountOwner"), "Stage/status": ("stage", "status", "lifecycleStage")}
RECORD_OBJECTS = {"Associations": ("associations", "relatedRecords"), "Fields": ("fields", "properties")}

#: The provider of a kind's policy (None: what the metadata names, or the kind's own name), and what it is inherited from.
PROVIDERS = {"chat": ("slack", False, ("channelId", "sourceId")), "call": ("call", True, ("callId", "meetingId", "recordingId")), "event": ("analytics", True, ("eventId", "eventName")), "record": ("crm", True, ("recordId", "id", "externalId"))}


def kind_of(source_type: Column) -> Column:
    """chat, call, event or record; null for others."""
    low = F.lower(source_type)
    has = lambda words: low.rlike("|".join(words))
    return F.coalesce(*[F.when(has(words), kind) for kind, words in KINDS.items()])


class _Fields:
    """Fields of a JSON text; empty ones count as absent."""

    def __init__(self, json: Column):
        self.json = json

    def get(self, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(self.json, f"$.{n}"), F.lit("")) for n in names])

    def items(self, *names: str) -> Column:
        """Elements of the first of these that is a list with elements, as texts (objects as JSON)."""
        lists = [F.from_json(F.get_json_object(self.json, f"$.{n}"), "array<string>") for n in names]
        return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _lines(table: dict[str, tuple[str, ...]], fields: _Fields) -> list[Column]:
    return [_line(label, fields.get(*names)) for label, names in table.items()]


def _each(items: Column, text, between: str = "\n") -> Column:
    """Rendered elements of a list, joined; null for a null list.  Elements that aren't objects stand for themselves."""
    return F.when(items.isNotNull(), F.array_join(F.filter(F.transform(items, lambda x: F.when(x.startswith("{"), text(_Fields(x))).otherwise(x)), lambda x: x != ""), between))


def _object(label: str, value: Column) -> Column:
    return F.when(value.startswith("{") | value.startswith("["), _line(label, value))


def _chat(m: _Fields, content: Column) -> Column:
    reply = lambda r: F.concat(F.coalesce(r.get("user", "userId"), F.lit("user")), F.lit(" @ "), F.coalesce(r.get("ts", "timestamp"), F.lit("unknown")), F.lit(": "), F.coalesce(r.get("text", "content"), F.lit("")))
    file = lambda f: F.concat_ws(" | ", F.coalesce(f.get("name", "title", "filename"), F.lit("attachment")), f.get("mimetype", "filetype"), f.get("url_private", "url", "permalink"), f.get("text", "summary"))
    part = lambda b: F.concat_ws(": ", b.get("type"), F.coalesce(b.get("text.text"), b.get("text")))
    reaction = lambda r: F.concat(F.coalesce(r.get("name"), F.lit("reaction")), F.lit("="), F.coalesce(r.get("count"), F.lit("1")))
    more = {"Thread replies:\n": _each(m.items("threadMessages", "replies"), reply), "Structured blocks:\n": _each(m.items("blocks"), part), "Attachments:\n": _each(m.items("files", "attachments"), file), "Reactions: ": _each(m.items("reactions"), reaction, ", ")}
    return F.concat_ws("\n", *_lines(CHAT, m), _line("Message", content), *[F.concat(F.lit(label), text) for label, text in more.items()])


def _call(m: _Fields, content: Column) -> Column:
    turn = lambda t: F.concat(
        F.coalesce(F.concat(F.lit("["), t.get("timestamp", "startTime", "time"), F.lit("] ")), F.lit("")), F.coalesce(t.get("speaker", "name", "user"), F.lit("Speaker")),
        F.coalesce(F.concat(F.lit(" speakerId="), t.get("speakerId")), F.lit("")), F.coalesce(F.concat(F.lit(" confidence="), t.get("confidence")), F.lit("")), F.lit(": "), F.coalesce(t.get("text", "content", "message"), F.lit("")),
    )
    listed = lambda label, name: _line(label, F.array_join(m.items(name), ", "))
    said = F.nullif(F.trim(_each(m.items("turns", "transcriptTurns"), turn)), F.lit(""))
    lead = [_line("Title", m.get(*TITLE)), listed("Participants", "participants")]
    text = F.concat(F.lit("Transcript:\n"), content)
    whole = F.concat_ws("\n", *lead, F.when(content != "", text), F.concat(F.lit("Structured turns:\n"), said), listed("Decisions", "decisions"), listed("Action items", "actionItems"))
    return F.when(said.isNotNull(), whole).otherwise(F.concat_ws("\n", *lead, _object("Speaker map", m.get("speakerMap")), text))


def _event(m: _Fields, content: Column) -> Column:
    return F.concat_ws("\n", *_lines(EVENT, m), F.when(content != "", _line("Details", content)), *[_object(label, m.get(*names)) for label, names in EVENT_OBJECTS.items()])


def _record(m: _Fields, content: Column) -> Column:
    return F.concat_ws("\n", *_lines(RECORD, m), *[_object(label, m.get(*names)) for label, names in RECORD_OBJECTS.items()], _line("Record content", content))


def normalized(source_type: Column, metadata: Column, content: Column) -> Column:
    """Content as its kind of source is written; other kinds stay as they are."""
    kind, m, text = kind_of(source_type), _Fields(metadata), F.coalesce(content, F.lit(""))
    return F.coalesce(*[F.when(kind == name, written(m, text)) for name, written in (("chat", _chat), ("call", _call), ("event", _event), ("record", _record))], content)


def source_policy(source_type: Column, metadata: Column) -> Column:
    """The policy that a source's metadata implies: users and groups that may or may not see it."""
    kind, m = kind_of(source_type), _Fields(metadata)
    provider = F.coalesce(*[F.when(kind == k, F.coalesce(m.get("provider"), F.lit(p)) if named else F.lit(p)) for k, (p, named, _) in PROVIDERS.items()])
    inherited = F.coalesce(*[F.when(kind == k, m.get(*names)) for k, (_, _, names) in PROVIDERS.items()])
    label = F.coalesce(m.get("classification"), F.when(kind == "event", "analytics"))
    none = F.array().cast("array<string>")

    def entries_of(names: tuple[str, ...], what: str, access: str) -> Column:
        ids = F.filter(F.coalesce(m.items(*names), none), lambda x: x != "")
        return F.transform(ids, lambda i: F.struct(provider.alias("provider"), i.alias("id"), F.lit(what).alias("type"), F.lit(access).alias("access"), F.lit(None).cast("string").alias("name")))

    entries = [entries_of(("visibleUserIds", "allowedUserIds"), "user", "allow"), entries_of(("visibleGroupIds", "allowedGroupIds"), "group", "allow"), entries_of(("deniedUserIds",), "user", "deny"), entries_of(("deniedGroupIds",), "group", "deny")]
    only = lambda c: F.when(kind.isNotNull(), c)
    lists = [none.alias(n) for n in ("allowedPrincipals", "deniedPrincipals", "allowedGroups", "deniedGroups")]
    acl = F.when(kind.isNotNull(), F.concat(*entries)).otherwise(F.array().cast(VISIBILITY["sourceAcl"].dataType))
    return F.struct(*lists, only(label).alias("classification"), only(inherited).alias("inheritedFrom"), provider.alias("sourceSystem"), acl.alias("sourceAcl"))


def normalize(episodes: DataFrame) -> DataFrame:
    """Episodes with their normalized content, the metadata marked as normalized with the length of the original, and the
    policies of source, metadata and episode as one."""
    data = F.coalesce("metadata", F.lit("{}"))
    mark = F.concat(F.lit('"normalized":true,"originalContentLength":'), F.length(F.coalesce("content", F.lit(""))), F.lit("}"))
    marked = F.concat(F.regexp_replace(data, r"\s*\}\s*$", ""), F.when(F.regexp_replace(data, r"\s", "") == "{}", "").otherwise(","), mark)
    said = policy(F.get_json_object(data, "$.visibility"))
    inferred = merged(source_policy(F.col("source_type"), data), F.when(F.get_json_object(data, "$.visibility").isNotNull(), said))
    own = merged(inferred, F.col("visibility")) if "visibility" in episodes.columns else inferred
    return episodes.withColumns({"content": normalized(F.col("source_type"), data, F.col("content")), "metadata": marked, "visibility": own})

"""Records of SaaS services (JSON texts) as episodes: content, id, date, plain metadata, and the record's own access list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import VISIBILITY

#: Where a record says who may see it, and fields that aren't metadata.
LISTS = {
    ("user", "allow"): ("permissions.users", "permissions.allowed_users", "acl.users", "acl.allowed_users", "visibility.users", "visibility.allowed_users", "visible_user_ids"),
    ("group", "allow"): ("permissions.groups", "permissions.teams", "permissions.allowed_groups", "acl.groups", "acl.teams", "acl.allowed_groups", "visibility.groups", "visibility.teams", "visibility.allowed_groups", "visible_group_ids"),
    ("user", "deny"): ("permissions.denied_users", "acl.denied_users", "visibility.denied_users"),
    ("group", "deny"): ("permissions.denied_groups", "acl.denied_groups", "visibility.denied_groups"),
}
NOT_METADATA = ("content", "text", "body", "description", "message")


def _some(payload: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, f"$.{p}")), F.lit("")) for p in paths])


def content_of(payload: Column) -> Column:
    """The first content field, under the title where there is one; else the title; else the record."""
    title, text = _some(payload, *X.TITLE_FIELDS), _some(payload, *X.CONTENT_FIELDS)
    return F.when(text.isNotNull(), F.concat_ws("\n\n", title, text)).otherwise(F.coalesce(title, payload))


def plain_metadata(payload: Column, skip: tuple[str, ...] = NOT_METADATA) -> Column:
    """The fields with plain values, as JSON text."""
    fields = F.from_json(payload, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: v.isNotNull() & ~k.isin(list(skip)) & ~k.startswith("_") & ~v.startswith("{") & ~v.startswith("[")))


def _ids(payload: Column, paths: tuple[str, ...]) -> Column:
    """Ids of the first list that is there; of objects their id."""
    lists = [F.from_json(F.get_json_object(payload, f"$.{p}"), "array<string>") for p in paths]
    ids = F.transform(F.coalesce(*lists, F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.id")).otherwise(x))
    return F.filter(ids, lambda x: x.isNotNull() & (x != ""))


def record_policy(payload: Column, provider: str) -> Column:
    """A record's access list as policy: principals and groups by provider, and the same as source entries."""
    ids = {key: _ids(payload, paths) for key, paths in LISTS.items()}
    led = lambda key, lead: F.transform(ids[key], lambda i: F.concat(F.lit(lead), i))
    entry = lambda key: F.transform(ids[key], lambda i: F.struct(F.lit(provider).alias("provider"), i.alias("id"), F.lit(key[0]).alias("type"), F.lit(key[1]).alias("access"), F.lit(None).cast("string").alias("name")))
    return F.struct(
        led(("user", "allow"), f"{provider}:user:").alias("allowedPrincipals"),
        led(("user", "deny"), f"{provider}:user:").alias("deniedPrincipals"),
        led(("group", "allow"), f"{provider}:").alias("allowedGroups"),
        led(("group", "deny"), f"{provider}:").alias("deniedGroups"),
        F.lit(None).cast("string").alias("classification"),
        _some(payload, "id", "external_id").alias("inheritedFrom"),
        F.lit(provider).alias("sourceSystem"),
        F.concat(*[entry(key) for key in LISTS]).cast(VISIBILITY["sourceAcl"].dataType).alias("sourceAcl"),
    )


def to_episodes(records: DataFrame, provider: str, model: str, scheme: str = "saas", template: str | None = None) -> DataFrame:
    """Records (payload, JSON text) as episodes; a record without an id is named by a hash of its text."""
    p = F.col("payload")
    name = F.coalesce(_some(p, "id", "external_id"), F.md5(p))
    return records.select(
        F.lit(provider).alias("source_type"),
        F.concat(F.lit(f"{scheme}://{provider}/{model}/"), name).alias("source_id"),
        (X.render(template, p) if template else content_of(p)).alias("content"),
        X.detect_date(p).alias("valid_at"),
        plain_metadata(p).alias("metadata"),
        record_policy(p, provider).alias("visibility"),
    )

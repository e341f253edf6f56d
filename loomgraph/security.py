"""Row-level visibility as one Column builder, used by every operator that reads rows for someone.

A policy may be a struct, or a JSON string of it (parsed first; text that can't be
parsed is hidden, never public).  Rules: bypass sees everything; without a context
only rows whose lists are all empty, deny lists included; with one, any matching
deny hides, no allow list shows, and otherwise an allow must match.  Labels of
classification never grant or deny.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import VISIBILITY


@dataclass(frozen=True)
class Access:
    """Who asks: ids, groups, roles, and accounts by provider."""

    principal_id: str | None = None
    principal_ids: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    source_accounts: dict[str, str] = field(default_factory=dict)
    bypass: bool = False

    def principals(self) -> list[str]:
        own = ([self.principal_id] if self.principal_id else []) + list(self.principal_ids)
        return own + [f"role:{r}" for r in self.roles] + [f"{p}:user:{a}" for p, a in self.source_accounts.items()]


BYPASS = Access(bypass=True)


def policy(column: Column | str) -> Column:
    """A policy stored as JSON text, as struct."""
    return F.from_json(F.col(column) if isinstance(column, str) else column, VISIBILITY)


def _list(p: Column, name: str) -> Column:
    return F.coalesce(p[name], F.array().cast("array<string>"))


def _entries(p: Column, access: str) -> Column:
    """Source entries of a kind of access."""
    return F.filter(F.coalesce(p["sourceAcl"], F.array().cast(VISIBILITY["sourceAcl"].dataType)), lambda e: F.coalesce(e["access"], F.lit("allow")) == access)


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _entry_matches(e: Column, who: Access) -> Column:
    """Strict by type: a group key never matches a user entry."""
    key = F.concat_ws(":", e["provider"], e["type"], e["id"])
    groups = _texts([g for g in who.groups])
    accounts = _texts([f"{p}:{a}" for p, a in who.source_accounts.items()])
    named = F.array_contains(groups, key) | (e["type"].isin("group") & F.array_contains(groups, F.concat_ws(":", e["provider"], e["id"])))
    user = F.array_contains(accounts, F.concat_ws(":", e["provider"], e["id"])) | F.array_contains(_texts(who.principals()), key)
    role = F.array_contains(_texts(list(who.roles)), e["id"]) | F.array_contains(_texts(who.principals()), F.concat(F.lit("role:"), e["id"]))
    return F.when(e["type"].isin("user", "account"), user).when(e["type"].isin("group", "channel", "workspace"), named).when(e["type"] == "role", role).otherwise(F.lit(False))


def _public(p: Column) -> Column:
    """All lists are empty, deny lists included."""
    lists = [_list(p, n) for n in ("allowedPrincipals", "deniedPrincipals", "allowedGroups", "deniedGroups")]
    empty = F.coalesce(F.size(p["sourceAcl"]), F.lit(0)) <= 0
    for values in lists:
        empty = empty & (F.size(values) == 0)
    return empty


def _open(p: Column) -> Column:
    """No list allows anyone in particular."""
    return (F.size(_list(p, "allowedPrincipals")) == 0) & (F.size(_list(p, "allowedGroups")) == 0) & (F.size(_entries(p, "allow")) == 0)


def matched(p: Column, access: Access, kind: str) -> Column:
    """What of a policy's lists of a kind (allow or deny) names the one who asks."""
    own = "allowed" if kind == "allow" else "denied"
    key = lambda e: F.concat_ws(":", e["provider"], e["type"], e["id"])
    named = F.transform(F.filter(_entries(p, kind), lambda e: _entry_matches(e, access)), key)
    return F.concat(F.array_intersect(_list(p, f"{own}Principals"), _texts(access.principals())), F.array_intersect(_list(p, f"{own}Groups"), _texts(list(access.groups))), named)


def visible(p: Column | str, access: Access | None) -> Column:
    """True where the policy lets access see the row; a null policy is public."""
    p = F.col(p) if isinstance(p, str) else p
    if access is not None and access.bypass:
        return F.lit(True)
    if access is None:
        return _public(p)
    principals, groups = _texts(access.principals()), _texts(list(access.groups))
    hit = lambda entries: F.exists(entries, lambda e: _entry_matches(e, access))
    denied = F.arrays_overlap(_list(p, "deniedPrincipals"), principals) | F.arrays_overlap(_list(p, "deniedGroups"), groups) | hit(_entries(p, "deny"))
    allow = F.arrays_overlap(_list(p, "allowedPrincipals"), principals) | F.arrays_overlap(_list(p, "allowedGroups"), groups) | hit(_entries(p, "allow"))
    return ~denied & (_open(p) | allow)


def visible_rows(df: DataFrame, access: Access | None, column: str = "visibility") -> DataFrame:
    return df.filter(visible(column, access))


def simulate(p: Column | str, access: Access | None) -> Column:
    """allowed, the reason (bypass, public, no_context, denied, no_allow_list, allowed or no_match), and the matched entries of
    the deny and allow lists.  A matched deny is the reason whatever else matches."""
    p = F.col(p) if isinstance(p, str) else p
    none = _texts([])
    if access is None or access.bypass:
        seen = visible(p, access)
        reason = F.lit("bypass") if access is not None else F.when(seen, "public").otherwise("no_context")
        return F.struct(seen.alias("allowed"), reason.alias("reason"), none.alias("denied_by"), none.alias("allowed_by"))
    deny, allow = matched(p, access, "deny"), matched(p, access, "allow")
    reason = F.when(F.size(deny) > 0, "denied").when(_open(p), "no_allow_list").when(F.size(allow) > 0, "allowed").otherwise("no_match")
    return F.struct(reason.isin("no_allow_list", "allowed").alias("allowed"), reason.alias("reason"), deny.alias("denied_by"), allow.alias("allowed_by"))


def warning(p: Column | str) -> Column:
    """A warning where a label sounds restricted but no list restricts; else null."""
    p = F.col(p) if isinstance(p, str) else p
    label = F.lower(F.coalesce(p["classification"], F.lit("")))
    sounds = label.rlike("restrict|confidential|secret|private|only|internal")
    return F.when(sounds & visible(p, None), F.concat(F.lit("classification '"), p["classification"], F.lit("' has no access list")))


def merged(a: Column, b: Column) -> Column:
    """Both policies as one: united lists, the first label that isn't null, all source entries."""
    both = lambda n: F.array_distinct(F.concat(_list(a, n), _list(b, n)))
    none = F.array().cast(VISIBILITY["sourceAcl"].dataType)
    fields = [both(n).alias(n) for n in ("allowedPrincipals", "deniedPrincipals", "allowedGroups", "deniedGroups")]
    fields += [F.coalesce(a[n], b[n]).alias(n) for n in ("classification", "inheritedFrom", "sourceSystem")]
    return F.struct(*fields, F.concat(F.coalesce(a["sourceAcl"], none), F.coalesce(b["sourceAcl"], none)).alias("sourceAcl"))

"""Access control: a truth table, and the rules that it rests on."""

import pytest
from pyspark.sql import functions as F

from loomgraph.schema import VISIBILITY
from loomgraph.security import BYPASS, Access, merged, policy, simulate, visible, warning

ENTRY = lambda kind, number, access="allow", provider="slack": {"provider": provider, "id": number, "type": kind, "access": access, "name": None}
LISTS = ("allowedPrincipals", "deniedPrincipals", "allowedGroups", "deniedGroups")


def row(spark, **given):
    value = {n: [] for n in LISTS} | {"classification": None, "inheritedFrom": None, "sourceSystem": None, "sourceAcl": []} | given
    return spark.createDataFrame([(value,)], f"p {VISIBILITY.simpleString()}")


def allowed(df, access):
    return df.select(visible("p", access).alias("v")).first().v


CHANNEL = {"sourceAcl": [ENTRY("channel", "C1"), ENTRY("user", "U2", "deny")]}
CASES = [
    (CHANNEL, Access(groups=("slack:channel:C1",)), True),
    (CHANNEL, Access(groups=("slack:channel:C1",), source_accounts={"slack": "U2"}), False),
    ({"allowedGroups": ["security"]}, None, False),
    ({"allowedGroups": ["security"]}, BYPASS, True),
    ({"allowedGroups": ["security"]}, Access(groups=("security",)), True),
    ({"allowedGroups": ["security"]}, Access(groups=("product",)), False),
    ({"classification": "security-only"}, None, True),
    ({"sourceAcl": [ENTRY("group", "security-team")]}, None, False),
    ({"sourceAcl": [ENTRY("group", "security-team")]}, Access(groups=("slack:security-team",)), True),
    ({"deniedGroups": ["contractors"]}, None, False),
    ({"deniedGroups": ["contractors"]}, Access(), True),
    ({"deniedGroups": ["contractors"]}, Access(groups=("contractors",)), False),
    ({}, Access(), True),
    ({"allowedPrincipals": ["role:admin"]}, Access(roles=("admin",)), True),
    ({"allowedPrincipals": ["u1"]}, Access(principal_id="u1"), True),
    ({"allowedPrincipals": ["u1"], "deniedPrincipals": ["u1"]}, Access(principal_id="u1"), False),
    ({"sourceAcl": [ENTRY("role", "admin")]}, Access(roles=("admin",)), True),
    ({"sourceAcl": [ENTRY("account", "A7")]}, Access(source_accounts={"slack": "A7"}), True),
    ({"sourceAcl": [ENTRY("unknown", "C1")]}, Access(groups=("slack:unknown:C1",)), False),
    ({"sourceAcl": [ENTRY("user", "U1")]}, Access(groups=("slack:user:U1",)), False),
]


@pytest.mark.parametrize("given, access, want", CASES)
def test_truth_table(spark, given, access, want):
    df = row(spark, **given)
    assert allowed(df, access) is want
    assert df.select(simulate("p", access).alias("s")).first().s.allowed is want


def test_policy_as_text_is_parsed_and_never_public(spark):
    text = '{"sourceAcl":[{"provider":"slack","id":"security","type":"group","access":"allow"}]}'
    df = spark.createDataFrame([(text,)], "t string").withColumn("p", policy("t"))
    assert not allowed(df, None) and not allowed(df, Access(groups=("product",))) and allowed(df, Access(groups=("slack:security",)))


def test_warning_and_merge(spark):
    df = row(spark, classification="security-only")
    assert "security-only" in df.select(warning("p").alias("w")).first().w
    both = row(spark, allowedGroups=["a"]).select(F.col("p").alias("a")).crossJoin(row(spark, allowedGroups=["a", "b"], sourceAcl=[ENTRY("user", "U1")]).select(F.col("p").alias("b")))
    m = both.select(merged(F.col("a"), F.col("b")).alias("m")).first().m
    assert m.allowedGroups == ["a", "b"] and len(m.sourceAcl) == 1

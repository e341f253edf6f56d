"""Frames of questions, and whether citations answer them."""

from pyspark.sql import functions as F

from loomgraph.plans import coverage as V


def frame(spark, question, **known):
    rows = spark.createDataFrame([(1, question)], "id long, question string").withColumns({k: F.lit(v) for k, v in known.items()})
    r = V.frames(rows).first()
    return r.subjects, r.slots, r.sensitive, r.strict


def test_frames(spark):
    assert frame(spark, "What is the status of Acme Corp (ACX), and once more after a long while of IBM's database?") == ([["Acme Corp", "ACX"], ["IBM"]], ["status"], False, True)
    assert frame(spark, "Who owns the access key?") == ([], ["owner", "security"], True, False)
    assert frame(spark, "What Happened") == ([], ["status"], False, False)
    assert frame(spark, "Is It OK") == ([["OK"]], [], False, True)
    assert frame(spark, None) == ([], [], False, False) and frame(spark, "x", strict=False)[3] is False
    known = spark.createDataFrame([(1, "x", [[" acme "], ["it"]], ["risk", "made up"])], "id long, question string, subjects array<array<string>>, slots array<string>")
    r = V.frames(known).first()
    assert (r.subjects, r.slots, r.strict) == ([["acme"]], ["risk"], True)


def assess(spark, question, *contents, quote=None):
    q = spark.createDataFrame([(1, question)], "id long, question string")
    c = spark.createDataFrame([(1, f"C{i}", t, quote) for i, t in enumerate(contents, 1)], "id long, citation string, content string, quote string")
    r = V.assess(q, c).first()
    return r.can_answer, r.missing, r.supported


def test_strict_subjects(spark):
    asked = "What is the status of Acme Payments Gateway?"
    assert assess(spark, asked) == (False, ["No supporting search results were returned for Acme Payments Gateway."], [])
    assert assess(spark, asked, "An incident at Globex") == (False, ["No returned citation is explicitly bound to Acme Payments Gateway or a clear alias."], [])
    assert assess(spark, asked, "The gateway for payments has an incident", None, "nothing") == (True, [], ["C1"])
    assert assess(spark, asked, "Acme Payments Gateway") == (False, ["No returned citation supports the requested coverage: status."], [])
    assert assess(spark, asked, "seen", quote="Acme Payments Gateway is blocked") == (True, [], ["C1"])


def test_slots_and_sensitive_questions(spark):
    assert assess(spark, "why and when?", "because of rain") == (True, ["Evidence did not clearly cover requested slot: timeline."], ["C1"])
    assert assess(spark, "tell me", "a", "b") == (True, [], ["C1", "C2"]) and assess(spark, "why?") == (True, [], [])
    two = "Does Acme Corp share the token of Initech Labs?"
    assert assess(spark, two, "Acme Corp has a secret")[0] and not assess(spark, two.replace("token", "desk"), "Acme Corp has a desk")[0]
    q = spark.createDataFrame([(1, "risk of Acme Corp", False)], "id long, question string, strict boolean")
    c = spark.createDataFrame([(1, "C1", "risk at Globex")], "id long, citation string, content string")
    r = V.assess(q, c).first()
    assert (r.can_answer, r.missing) == (False, ["No returned citation is sufficiently bound to the requested process/object: Acme Corp."])

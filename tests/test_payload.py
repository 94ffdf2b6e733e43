"""The parsed payload of events: first well-formed element of a name, decoded once."""

from triagelake.functions.payload import with_payload


def test_payload_of_odd_texts(spark):
    texts = {
        '<Data Name="a">1</Data><Data Name="b">x y</Data>': {"a": "1", "b": "x y"},
        '<Data Name="a">1</Data><Data Name="a">2</Data><Data Name="b">3</Data>': {"a": "1", "b": "3"},
        '<Data Name="b">&amp;lt;</Data><Data Name="a"></Data>': {"b": "&lt;", "a": ""},
        '<Data Name="a">&lt;</Data><Data Name="a">&gt;</Data><Data Name="">&#65;</Data>': {"a": "<", "": "A"},
        '<Data Name="a&amp;b">c</Data><Data Name="x">d<</Data>': {"a&amp;b": "c"},
        "": {},
        "&amp;": {},
        None: None,
    }
    df = spark.createDataFrame([(x,) for x in texts], "payload_xml string")
    assert {r["payload_xml"]: r["payload"] for r in with_payload(df).collect()} == texts


def test_names_are_looked_up_only_where_they_repeat(spark):
    df = spark.createDataFrame([('<Data Name="a">1</Data>',)], "payload_xml string").select("payload_xml")
    plan = with_payload(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (size(array_distinct" in plan

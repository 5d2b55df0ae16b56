"""Messages as text."""

from chronolane.functions import cdr, message_text

SCHEMA = "===\n".join(
    [
        "bool flag\nint8 small\nuint8 octet\nfloat32 single\nfloat64 double\nstring name\nuint8[] data\nfloat64[3] three\nstring[] names\ndemo/Item item\ndemo/Item[] items\ndemo/Nothing[] nothings\n",
        "MSG: demo/Item\nint32 id\ndemo/Place[] places\n",
        "MSG: demo/Place\nfloat64 x\nfloat64 y\n",
        "MSG: demo/Nothing\n",
    ]
)
VALUE = {
    "flag": True, "small": -5, "octet": 200, "single": 0.1, "double": 0.1, "name": "it's\na\ttab", "data": bytes(range(33)), "three": [1.0, 2.5, 1e300], "names": ["a", "b c"],
    "item": {"id": 7, "places": []}, "items": [{"id": 1, "places": [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]}, {"id": 2, "places": []}], "nothings": [],
}
TEXT = """flag: true
small: -5
octet: 200
single: 0.1
double: 0.10000000000000001
name: 'it''s\\na\\ttab'
data: [<33 items>]
three: [1, 2.5, 1.0000000000000001e+300]
names: ['a', 'b c']
item:
  id: 7
  places: []
items:
  - id: 1
    places:
      - x: 1
        y: 2
      - x: 3
        y: 4
  - id: 2
    places: []
nothings: []
"""


def test_text(spark):
    good = cdr.encode(SCHEMA, VALUE)
    rows = [("/a", 1, 0, good), ("/a", 2, 1, good[:40]), ("/a", 3, 2, b""), ("/a", 4, 3, None)]
    df = spark.createDataFrame(rows, "topic string, timestamp_ns long, seq long, payload binary")
    got = {r["seq"]: r for r in message_text.rendered(df, SCHEMA).collect()}
    assert got[0]["text"] == TEXT and got[0]["error"] is None
    assert all(got[k]["text"] is None and got[k]["error"] for k in (1, 2, 3))
    long = next(r for r in message_text.rendered(df, SCHEMA, 2, True).collect() if r["seq"] == 0)["text"]
    assert "three:\n  - 1\n  - 2.5\n  - 1.0000000000000001e+300\nnames: ['a', 'b c']\n" in long and long.count("\n") == TEXT.count("\n") + 33 + 3
    assert message_text.rendered(df.where("false"), SCHEMA).count() == 0
    assert "\n".join(message_text.lines(cdr.parse(SCHEMA), {**VALUE, "nothings": [{"empty": None}] * 2})).endswith("nothings:\n  - {}\n  - {}")

"""Layout of hand-made spans."""

from pyspark.sql import functions as F

from lawmill.operators import layout as Y

_SPANROWS = [
    ("d", 1, 0, 0, 10.0, 0, 36.0, 10.0, 0, 36.0, 10.0, 90.0, 20.0, "A", "F", 11.04), ("d", 1, 0, 0, 10.0, 0, 36.0, 10.0, 1, 102.0, 10.0, 120.0, 20.0, "B", "F", 12.0),
    ("d", 1, 1, 0, 5.0, 0, 0.0, 5.0, 0, 0.25, 5.0, 9.0, 8.0, "top & <b>", "G", 9.0), ("d", 1, 2, 1, 1.0, 0, 0.0, 1.0, 0, 0.0, 1.0, 2.0, 2.0, "image", "F", 1.0),
    ("d", 2, 0, 0, 3.0, 0, 0.0, 3.0, 0, 0.0, 3.0, 4.0, 4.0, "  ", "F", 1.0),
]


def test_markdown(spark):
    assert [tuple(r) for r in Y.markdown(spark.createDataFrame(_SPANROWS, Y.SPAN)).collect()] == [("d", "\ntop & <b>\n      A  B\n")]


def test_elements(spark):
    made = Y.elements(spark.createDataFrame(_SPANROWS, Y.SPAN)).select(F.posexplode("elements").alias("i", "e"))
    got = [(r["i"], r["e"]["text"], r["e"]["bbox"][0], r["e"]["font"], r["e"]["size"]) for r in made.collect()]
    assert got == [(0, "top & <b>", 0.2, "G", 9.0), (1, "A", 36.0, "F", 11.0), (2, "B", 102.0, "F", 12.0)]


def test_html(spark):
    sizes = spark.createDataFrame([("d", 1, 595.0, 842.0), ("d", 3, 1.0, 2.0)], "doc string, page int, width double, height double")
    got = {r["page"]: r["html"] for r in Y.html(spark.createDataFrame(_SPANROWS, Y.SPAN), sizes).collect()}
    assert got[1].split("\n")[1:3] == [
        "<div class='text-line' style='left:36.0px;top:10.0px;font-size:12.0px;font-family:F;'>AB</div>",
        "<div class='text-line' style='left:0.0px;top:5.0px;font-size:9.0px;font-family:G;'>top &amp; &lt;b&gt;</div>",
    ]
    assert got[3].split("\n") == ["<div class='page' style='width:1.0px;height:2.0px;' data-page='3'>", "</div>"]

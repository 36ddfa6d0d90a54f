"""Text of notices: dates, whole tables, pages."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "whole"),
    [
        ("The table people will be dropped.", True), ("people is being migrated next week", True), ("We are retiring the table people soon", True), ("Removal of the people table is planned", True),
        ("the decommissioning of raw.people starts", True), ("people gets renamed", True), ("The entire table changes", True), ("a table-level change", True), ("PEOPLE TABLE IS TO BE ARCHIVED", True),
        ("Column area_code of people will change its format", False), ("The column id on people. It will be dropped", False), ("people are fine, others dropped", False), ("dropping the column x of table y in people", False),
        ("removal from people", False), ("nothing here", False), (None, False), ("", False), ("people", False),
    ],
)
def test_whole_table(spark, said, whole):
    assert one(spark, said, lambda t: text.whole_table(t, F.lit("PEOPLE"))) is whole


@pytest.mark.parametrize(
    ("said", "date"),
    [
        ("effective 2026-09-18, then 2026-10-01", "2026-09-18"), ("on 18 September 2026.", "2026-09-18"), ("from Sept 3, 2027 on", "2027-09-03"), ("by October 7", "2025-10-07"), ("2026-13-40 or 1 May 2026", "2026-05-01"),
        ("May I ask", ""), ("31 February 2026", ""), ("", ""), (None, ""), ("room 12-2026-09", ""), ("the 5 march 2026 and 4 april 2026", "2026-03-05"),
    ],
)
def test_dates(spark, said, date):
    assert one(spark, said, lambda t: text.parse_date(t, 2025)) == date


def test_pages(spark):
    page = "<html><script>x < 1</script><p>A&amp;B  \n</p><table><tr><td>1</td><td>2</td></tr></table>3 &lt; 4<br/>end < 5  "
    assert one(spark, page, text.strip_html) == "A&B\n\n1\t2\n\n3 < 4\nend < 5"

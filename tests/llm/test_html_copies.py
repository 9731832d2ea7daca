import pytest

from addrloom.llm import html_text as H


@pytest.mark.parametrize("pages_a_part", [500, 4])
def test_copies_do_not_erase_each_other(spark, pages_a_part):
    page = lambda own: f"<div>Top</div><p>{own}</p><div>End</div>"
    rows = [(i, f"http://a.org/p?q={i}", page("Same text")) for i in range(30)]  # copies only: nothing to tell lines apart
    rows += [(100 + i, f"http://b.org/a?q={i}", page("First text")) for i in range(30)]
    rows += [(200 + i, f"http://b.org/b?q={i}", page("Second text")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, pages_a_part=pages_a_part).collect()}
    want = {i: "Top Same text End" if i < 100 else "First text" if i < 200 else "Second text" for i, _, _ in rows}
    assert got == want

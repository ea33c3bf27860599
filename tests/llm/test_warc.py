import hashlib
import uuid

import pytest

from chronowarn.llm.queries import ORACLES, QUERIES
from chronowarn.llm.warc import arc_text, parse_arc, parse_warc, read_warc, round_trip
from chronowarn.session import checkpoint_root

FOLDER = "/root/testdata/sf0.001"


def test_query_equals_sql(spark, sql, sorted_rows):
    assert sorted_rows(QUERIES["op4_warc"](spark, FOLDER)) == sql(ORACLES["op4_warc"])


def test_lengths_rule_not_contents():
    tricky = "line\nhttp://x 1 2 text/html 5\r\n\r\nWARC/1.1\r\n" * 3
    data = "\n".join(arc_text(i, f"http://a/{i} b", html, 1 + i % 2) for i, html in enumerate([tricky, "", "é\U0001F600", "\n\n"])).encode() + b"\n"
    rows = list(parse_arc(data))
    assert [b.decode() for *_, b in rows] == [tricky, "", "é\U0001F600", "\n\n"] and [f["version"] for f, *_ in rows] == [1, 2, 1, 2]
    for bad in (data[:-20], b"http://x only three fields\n", b"a b c d notanumber\n"):
        with pytest.raises(ValueError):
            list(parse_arc(bad))
    with pytest.raises(ValueError):
        list(parse_warc(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc\r\n\r\n"))


def test_awkward_pages(spark):
    long = "<p>" + "x y " * 400_000
    same = "s" * 100
    pages = [(None, "http://n", same), (1, None, None), (2, "", ""), (5, "http://a b/é", same), (4, "http://c", same), (4, "http://c", same), (9, "http://c", "s" * 99),
             (8, "http://c", "s" * 99), (10, "u", long), (11, "u", long), (12, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20), (5, "http://other", "different " * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS payload_digest", "1 AS version")
    root = f"{checkpoint_root(spark)}/test-warc-{uuid.uuid4().hex}"
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"], r["block_ok"]) for r in round_trip(df, root).collect()), key=str)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        first = min((p for p, _, h in pages if (h or "").encode() == body and p is not None), default=None)
        again = len(body) >= 100 and page is not None and page != first
        want.append((page is None, page or 0, len(body), "revisit" if again else "response", first if again else None, hashlib.sha256(body).hexdigest(), True))
    assert got == sorted(want, key=str)
    ids = [r["record_id"] for r in read_warc(spark, f"{root}/warc").collect()]
    assert len(set(ids)) == len(ids) - 1  # but for the row given twice
    empty = round_trip(df.where("false"), f"{root}-empty")
    assert empty.collect() == []

import duckdb
import pyarrow as pa

from kinelog.llm import urls as U


def page(*links):
    return "".join(links)


def canonical(to):
    return f'<link rel="canonical" href="{to}">'


def refresh(to):
    return f'<meta http-equiv="refresh" content="0; url={to}">'


ROWS = [
    (1, "http://WWW.Example.com/en/a", None),
    (2, "http://x.example.com/en/a?b", ""),
    (3, "http://a.example.org/one", refresh("http://b.example.org/two")),
    (4, "http://b.example.org/two/", canonical("//c.example.org/three")),
    (5, "https://c.example.org/three.html?utm_source=x#top", canonical("http://shop.net/fr/bad")),
    (6, "http://d.example.org/four", canonical("/five")),
    (7, "http://d.example.org/five", refresh("http://e.example.org/six") + canonical("http://shop.net/es/bad")),
    (8, "http://e.example.org/six", canonical("http://good.com/")),
    (9, "shop.net/fr/x", canonical("http://shop.net/fr/bad")),
    (10, None, canonical("http://shop.net/fr/bad")),
    (11, "http://shop.net", None),
    (12, "http://f.example.org/x?page=1&ref=z", canonical("relative/path")),
    (13, "http://f.example.org/x?page=1", canonical("http://shop.net/fr/bad")),
    (13, "http://f.example.org/x?page=1", canonical("http://shop.net/fr/bad")),
    (None, "http://f.example.org/x?page=2", None),
    (14, "http://ÄB.net/es/", None),
    (15, "ftp://u@h:80?x://y/en/", None),
    (16, "://a.net/fr/", None),
]


def frame(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, verdict string")


def test_aliases_and_precedence(spark):
    got = {r.page_id: r for r in U.judge(frame(spark)).collect()}
    assert len(U.judge(frame(spark)).collect()) == len(ROWS)
    assert (got[1].rule, got[1].verdict, got[1].host) == ("www.example.com/en/", "allow", "www.example.com")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    for k in (3, 4, 5, 12, 13):  # aliases of shop.net/fr/bad
        assert (got[k].rule, got[k].verdict, got[k].decided_by) == (None, "block", "alias"), k
    for k in (6, 7, 8):  # blocked by one alias, allowed by another
        assert (got[k].verdict, got[k].decided_by) == ("allow", "alias"), k
    for k in (9, 10, 11, 15, None):
        assert (got[k].rule, got[k].verdict, got[k].decided_by) == (None, "allow", "default"), k
    assert (got[9].host, got[9].path, got[10].host) == ("", "", "")
    assert (got[14].host, got[14].verdict) == ("Äb.net", "block")
    assert (got[15].host, got[15].path) == ("u@h:80", "")
    assert got[16].verdict == "block"


def test_malformed_urls_join_nothing(spark):
    rows = [(1, "no scheme", canonical("http://shop.net/fr/bad")), (2, "nor here", canonical("http://fine.org/a")), (3, "http://fine.org/a", None)]
    got = {r.page_id: (r.verdict, r.decided_by) for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ("allow", "default") for k in (1, 2, 3)}


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.register("pages", pa.table({k: [r[i] for r in ROWS] for i, k in enumerate(("page_id", "url", "html"))}))
    want = sorted(con.execute(U.ORACLE).fetchall(), key=str)
    assert sorted(map(tuple, U.judge(frame(spark)).collect()), key=str) == want


def test_empty_table_and_no_rules(spark):
    assert U.judge(frame(spark).limit(0)).count() == 0
    assert {r.verdict for r in U.judge(frame(spark), ()).collect()} == {"allow"}

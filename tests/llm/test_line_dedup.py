from pyspark.sql import functions as F

from eddyline.llm import line_dedup as L


def brute(rows, ratio=0.1, least=3):
    pages, seen = {}, {}
    for site, text in rows:
        pages[site] = pages.get(site, 0) + 1
        for b in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[site, b] = seen.get((site, b), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for site, text in rows:
        if text is None:
            out.append((site, None))
        else:
            out.append((site, "\n".join(x for x in text.split("\n") if (site, x.strip(" \t\r")) not in bad)))
    return out


def test_matches_brute_force_with_nulls_and_small_sites(spark):
    rows = [("a", f"menu\nbody {i}\n\n menu \nfoot" if i % 2 else f"body {i}") for i in range(40)]
    rows += [(None, "menu\nx"), (None, "menu\ny"), (None, "menu"), ("b", "menu"), ("b", None), ("b", "")]
    rows += [("a", "rare"), ("a", "rare\nrare")]
    df = spark.createDataFrame([(s, t, 1) for s, t in rows], "site string, text string, n_lines int")
    out = L.drop_site_boilerplate(df, F.col("site"), "text")
    assert out.columns == ["site", "text", "n_lines", "n_lines_", "n_dropped"]
    key = lambda r: (r[0] or "", r[0] is None, r[1] or "", r[1] is None)
    assert sorted(((r.site, r.text) for r in out.collect()), key=key) == sorted(brute(rows), key=key)
    assert {r.text for r in out.filter("n_dropped > 0").collect()} >= {"x", "y", ""}


def test_no_python_in_the_plan(spark, docs):
    plan = L.drop_site_boilerplate(docs, F.col("source"), "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_html_and_host(spark):
    df = spark.createDataFrame([("HTTP://Ex.Org:80/a?b", "<p>One <b>two</b></p><script>x</script>three<br>4", 1),
                                (None, None, 2), ("nothing", "", 3)], "url string, html string, i int")
    r = [tuple(x) for x in df.select(L.url_host("url"), L.html_lines("html")).collect()]
    assert r[0][0] == "ex.org" and [x for x in r[0][1].split("\n") if x] == ["One two", "three", "4"]
    assert r[1] == (None, None) and r[2] == ("", "")


def test_odd_rows_and_empty_table(odd, none):
    out = L.drop_site_boilerplate(odd, F.col("source"), "text")
    assert out.count() == odd.count() and out.filter("doc_id = 2").first().text is None
    assert L.drop_site_boilerplate(none, F.col("source"), "text").count() == 0

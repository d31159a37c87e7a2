import pytest
from pyspark.sql import functions as F

from retinue.llm import line_spread, preferences, url_lists


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")


def test_preferences(spark):
    chosen = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "x"), (3, 0, "user", None), (3, 1, None, "y"), (None, 0, "user", "z"), (5, 0, "user", "only")])
    rejected = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "?"), (2, 0, "user", "x"), (3, 0, "user", None), (3, 1, None, "y"), (3, 1, None, "y")])
    rows = {r.pair_id: r for r in preferences.format_preferences(chosen.withColumn("side", F.lit(1)), rejected).collect()}
    assert set(rows) == {1, 2, 3, 5}
    one = rows[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 1
    assert one.chosen == "<|assistant|>\ngood<|end|>\n" and [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["good<|end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad<|end|>"] and one.rejected.endswith("?<|end|>\n")
    assert (rows[2].n_prompt_turns, rows[2].chosen, rows[2].rejected) == (1, "", "")
    assert rows[3].n_prompt_turns == 2 and rows[3].chosen == "" and rows[3].rejected == "<||>\ny<|end|>\n"
    assert rows[5].prompt == "" and rows[5].rejected == ""
    assert preferences.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_url_keys(spark):
    urls = ["https://u:p@A.B.Example.com:80/x/y/?q#f", "http://localhost", "nonsense", ""]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_lists.keys_of(F.col("url")).alias("k")).collect()
    assert sorted(rows[0].k) == sorted(["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x/y"])
    assert rows[1].k == ["localhost"] and rows[2].k == [""]


@pytest.mark.parametrize("bucket", [7, 100, url_lists.BUCKET])
def test_captures_see_the_list_of_their_time(spark, bucket):
    entries = [("bad.com", 10, "block"), ("bad.com", 50, "remove"), ("bad.com", 90, "block"), ("ok.bad.com", 20, "allow"), ("bad.com/p", 5, "block"),
               ("tie.com", 3, "allow"), ("tie.com", 3, "block"), (None, 1, "block"), ("bad.com", None, "block"), ("bad.com", 1, "odd")]
    captures = [(1, "http://bad.com/", t) for t in (9, 10, 49, 50, 89, 90, 500)] + [(2, "http://ok.bad.com/", 15), (2, "http://ok.bad.com/", 25), (3, "http://bad.com/p?x", 60), (4, "http://tie.com", 3), (5, None, 20), (6, "http://bad.com/", None), (4, "http://tie.com", 3)]
    listed = spark.createDataFrame(entries, "key string, time long, action string")
    seen = spark.createDataFrame(captures, "page_id long, url string, fetched long")
    rows = {(r.page_id, r.fetched): r for r in url_lists.filter_captures(seen.withColumn("key", F.lit("x")), listed, bucket).collect()}
    assert {t: rows[1, t].kept for t in (9, 10, 49, 50, 89, 90, 500)} == {9: True, 10: False, 49: False, 50: True, 89: True, 90: False, 500: False}
    assert not rows[2, 15].kept and rows[2, 25].kept and rows[2, 25].action == "allow" and rows[2, 25].n_active == 2
    assert not rows[3, 60].kept and rows[3, 60].key == "bad.com/p" and not rows[4, 3].kept and rows[4, 3].n_rows == 2
    assert rows[5, 20].kept and rows[6, None].kept and rows[6, None].n_active == 0
    assert url_lists.filter_captures(seen, listed.limit(0), bucket).filter("NOT kept").count() == 0
    assert url_lists.filter_captures(seen.limit(0), listed, bucket).count() == 0


def plain_lines(rows, least):
    sites = {}
    for _, source, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                sites.setdefault(line, set()).add(source or "")
    shared = {line for line, found in sites.items() if len(found) >= least}
    out = []
    for i, _, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if line not in shared]
        out.append((i or -1, sum(bool(line.strip(" \t\x0b\x0c\r")) for line in lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_spread(spark):
    rows = [(k, f"s{k % 9}", f"own {k}\nshared\n\nfour {k % 4}\nthree\n") for k in range(40)]
    rows = [(k, s, t if k % 9 < 7 or k > 30 else t.replace("three", "3")) for k, s, t in rows]
    rows += [(100 + k, f"s{k}", "few\n \nfew") for k in range(4)] + [(200 + k, f"t{k % 3000}", "wide\nx") for k in range(600)]
    rows += [(None, None, "shared\nn"), (None, "", None), (7, "s1", ""), (300, "s0", "z\n" * 20_000), (301, "s0", "z\n" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("line", F.lit(1)).repartition(6)
    for least in (2, 4, 5, 9):
        found = line_spread.remove_shared_lines(docs, least).collect()
        assert sorted(((r.doc_id or -1, r.n_lines, r.n_removed, r.text) for r in found), key=str) == plain_lines(rows, least)
    assert line_spread.remove_shared_lines(docs.limit(0)).count() == 0
    plan = line_spread.remove_shared_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))

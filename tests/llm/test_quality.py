from collections import defaultdict
from itertools import count

import duckdb
import pyarrow as pa

import corpus_pipeline
from kinelog import llm
from kinelog.llm import quality as Q

PROSE = "Aber dies ist ein ganz anderer Satz. " * 2
ROWS = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, " ".join(f"w{i}" for i in range(60)) + "."), (5, "a b c " * 40), (6, "x | y | z\n" + " ".join(f"v{i}" for i in range(70)) + "!"),
    (7, "LOUD WORDS HERE!!\n" * 20), (8, "Click here to see.\n" + " ".join(f"q{i}" for i in range(55)) + ".\nno end\nno end"), (9, "\x1c\x85 " * 60), (10, "été## ñ$$ über%% " * 25),
    (11, " ".join(f"k{i}" for i in range(300_000))), (4, " ".join(f"w{i}" for i in range(60)) + "."), (None, "one two"), (12, "ß\x0b\x0cÄ\r\n" * 30), (13, "A B C."), (14, "Ǆ Ⅷ ª\n" * 20),
]


def test_odd_rows_equal_the_sql(spark):
    con = duckdb.connect()
    rows = [r for r in ROWS if r[0] is not None][:11] + ROWS[13:]
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    found = con.execute(Q.ORACLE)
    names = [d[0] for d in found.description]
    df = Q.clean_lines(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string"), with_text=False)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = Q.clean_lines(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].clean_text is None and by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[6].kept and by[6].n_bad_lines == 1 and not by[6].clean_text.startswith("x |")
    assert by[8].kept and "no end" not in by[8].clean_text and by[8].n_bad_lines == 2 and by[8].n_dup_lines == 1
    assert by[None].n_words == 2
    assert Q.clean_lines(docs.limit(0)).count() == 0


def test_repeated_words_equal_a_plain_count():
    for text in ("a b c a b c", "a a a a", "a b c d", "a b", "", "a b a b a b x"):
        w = text.split()
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        plain = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})
        assert Q.judge(text, defaultdict(count().__next__))[0][4] == plain


#: One text in each of four scripts, of lines with their own marks, and one line each that breaks off.
SCRIPTS = {
    "hindi": ("यह एक साधारण वाक्य है जो पूरा होता है।", "यह पंक्ति अधूरी है और"),
    "chinese": ("这 是 一个 完整 的 句子。", "这 一 行 没有"),
    "arabic": ("هل هذه جملة كاملة وواضحة؟", "هذا السطر بلا نهاية"),
    "thai": ("นี่คือประโยคหนึ่ง ที่ ไม่มี เครื่องหมาย", None),
}


def learned(n=8):
    """Texts of which most share a footer, some share nearly all they have, and each has lines of its own."""
    own = lambda k: "\n".join(" ".join(f"w{k}of{i}and{j}" for j in range(9)) + "." for i in range(8))
    rows = [(k, own(k) + "\nFollow this page to read more.") for k in range(n)]
    copy = "\n".join(f"The same sentence number {i} stands in all of these." for i in range(6))
    rows += [(100 + k, copy + f"\nBut the end {k} differs.") for k in range(5)]
    return rows + [(200 + k, "\n".join([SCRIPTS[s][0]] * 3 + [x for x in SCRIPTS[s][1:] if x])) for k, s in enumerate(SCRIPTS)] + [(300, None), (301, "")]


def test_learned_boilerplate_and_scripts_equal_the_sql(spark):
    rows = learned()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    found = con.execute(Q.sql(5, 100))
    names = [d[0] for d in found.description]
    got = Q.clean_lines(spark.createDataFrame(rows, "doc_id long, text string"), recurs=5, share=100)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    by = {r.doc_id: r for r in got.collect()}
    assert all("Follow" not in by[k].clean_text and by[k].n_bad_lines == 1 and by[k].kept for k in range(8))
    # Copies are mostly common lines, so nothing is taken from them; four texts are too few for a common line.
    assert all(by[100 + k].n_bad_lines == 0 for k in range(5))
    assert not Q.common_lines(spark.createDataFrame(rows, "doc_id long, text string"), 9, 100)
    assert [by[200 + k].n_bad_lines for k in range(4)] == [1, 1, 1, 0]


def test_rows_repeated_under_other_ids_are_one_text(spark):
    rows = [(k, "One line that recurs.\nAnd one more of it.") for k in range(60)]
    assert not Q.common_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, 1000)


def listed():
    """One text for each phrase in a line that no other rule fails, then lines that hold one in another way or none whole. With each the bad lines."""
    own = "\n".join(" ".join(f"w{i}and{j}" for j in range(9)) + "." for i in range(8)) + "\n"
    rows = [(f"We say {p.title()} to all.", 1) for p in Q.BOILERPLATE]
    rows += [("You may SİGN İN TO it, or clicK here.", 1), ("Xclick hereX.", 1), ("Click\nhere.", 1), ("Please click  here.", 0), ("A " * 40 + "privacy policy", 1), ("Terms of use.\nTERMS OF USE.\nTerms of uſe.", 2)]
    return [(k, own + t, n) for k, (t, n) in enumerate(rows)] + [(900, None, 0), (901, "", 0), (902, "Click here.", 1)]


def test_query_equals_its_sql_and_removes_lines_with_phrases(spark, tmp_path):
    rows = listed()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(llm.oracle_sql()["op8_line_quality"])
    names = [d[0] for d in found.description]
    got = llm.queries()["op8_line_quality"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    assert {r.doc_id: r.n_bad_lines for r in got.collect()} == {d: n for d, _, n in rows}


def test_pipeline_removes_lines_with_phrases(spark):
    rows = [(d, t, None, None, 0) for d, t, n in listed() if d < len(Q.BOILERPLATE)]
    kept = corpus_pipeline.clean(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert len(kept) == len(rows) and not any("We say" in r.text for r in kept)

import re

import duckdb
import pyarrow as pa
import pytest

from kinelog.llm import licences as L

SF = "/root/testdata/sf0.001"
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
ROWS = [
    (1, None), (2, ""), (3, " .,- "), (4, "Released under the MIT License. Under the MIT license; UNDER THE MIT LICENSE"), (5, "under the mit license"), (5, "under the mit license"),
    (6, "the mit license under"), (7, "Apache License, Version 2.0 and CC BY-NC 4.0 cc by nc"), (8, "Licensed under CC BY-SA 4.0."), (9, f"© 2020 Ω\n{GRANT}"), (10, GRANT.replace("obtaining", "who gets")),
    (11, GRANT.replace("person", "body").replace("copy", "piece")), (12, GRANT.replace("hereby", "here")), (13, "This work is licensed under the GNU General Public License, version 3."),
    (14, "licensed under the gnu general public license version 2 licensed under the gnu lesser general public license"), (15, "under the m\u0130t license"), (16, "\u212a under the mit license"),
    (17, "license " * 5000 + "under the mit license"), (18, "under under the the mit mit license license"), (19, "version 2"), (20, "general public license version 3"), (22, "under the \u212a under the mit licen\u212ae"), (21, "mit licenseé under the mit licenseÉ"),
]
KINDS = "doc_id long, text string"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@pytest.fixture
def found(spark, monkeypatch):
    def run(rows):
        docs = spark.createDataFrame([(*r, "x", 0) for r in rows], KINDS + ", found string, words int")
        monkeypatch.setattr(L, "table", lambda *_: docs)
        return sorted((tuple(r) for r in L.op12_rare_word_index(spark, "").select(*NAMES).collect()), key=str)

    return run


def test_odd_rows_equal_the_sql(found):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in ROWS], "text": pa.array([r[1] for r in ROWS], pa.string())}))
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({L.ORACLE})").fetchall()
    assert found(ROWS) == sorted(want, key=str)


def test_places_of_phrases_equal_a_plain_search(found):
    by = {r[0]: r for r in found(ROWS)}
    for doc_id, text in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = sorted((i, t.label) for t in L.PHRASES for i in range(len(words)) if words[i : i + len(t.passage.split())] == t.passage.split())
        first, last = (hits[0][0], hits[-1][0]) if hits else (None, None)
        assert by[doc_id][1:6] == (len(words), len(hits), first, last, ",".join(sorted({x for _, x in hits}))), doc_id


def test_labels_of_passages(found):
    by = {r[0]: r[6:] for r in found([*ROWS, (None, "under the mit license")])}
    assert by[9] == ("mit", 1.0) and by[13] == ("gpl-3", 1.0) and by[8] == ("cc-by-sa", 1.0) and by[None] == ("mit", 1.0)
    assert by[11] == ("mit", 0.9) and by[12] == ("", 0.0)  # words replaced; a key phrase broken
    assert by[14] == ("gpl-2", 1.0) and by[20] == ("", 0.0) and by[15] == ("", 0.0)


def test_empty_table_and_no_word_of_a_licence(found):
    assert found([]) == []
    assert found([(1, "a b"), (2, None)]) == [(1, 2, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0)]


def test_no_python_in_the_plan(spark):
    plan = L.op12_rare_word_index(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.split("== Physical Plan ==")[1].count("regexp_extract_all") == 1

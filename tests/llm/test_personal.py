import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelog.llm import personal as P


@pytest.fixture(scope="module")
def field():
    return P.Field(P.labelled())


def plain_base(text):
    """The contract's patterns as they stand."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1@.+-% (9\n", max_size=40), st.text(alphabet="0123456789 .-+", max_size=60), st.text()))
def test_base_spans_equal_the_plain_patterns(text):
    assert P.base_spans(text) == plain_base(text)


def test_table_equals_the_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = P.op10_random_field(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in P.KINDS[:4])
        every = r.spans.split(",") if r.spans else []
        assert set(P.joined(base).split(",")) - {""} <= set(every)
        for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r.doc_id]):
            assert f"secret:{m.start(1)}:{m.end(1)}" in every
        assert all(s.split(":")[0] == "secret" for s in set(every) - set(P.joined(base).split(",")))


def test_field_on_rows_it_has_not_seen(field):
    random_rows = P.labelled(20)[::3]
    got = field.spans([t for t, _ in random_rows])
    right = sum(sorted(g) == sorted((k, t.index(t[a:b], a), b) for k, a, b in s) for g, (t, s) in zip(got, random_rows))
    assert right / len(random_rows) > 0.85


def test_viterbi_equals_every_path(field):
    rng = np.random.default_rng(3)
    x = rng.integers(0, len(field.number) + 1, (30, 4, 11))
    steps = field._steps()
    for row, labels in zip(x, field.decode(x)):
        scores = field.emit[row].sum(1)

        def total(path):
            full = (0, *path, 0)
            return sum(scores[i, y] for i, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(full, full[1:]))

        assert total(tuple(labels)) == pytest.approx(max(map(total, itertools.product(range(len(P.LABELS)), repeat=4))))


def test_gradient_equals_differences():
    field = P.Field(P.labelled(1)[:6])
    sequences = [([[0, 1, 2], [1, 3, 4]], [5, 6]), ([[2, 2, 0], [4, 1, 1]], [0, 3])]
    (x, y), = field._batches(sequences)

    def loss():
        scores, steps, out = field.emit[x].sum(2), field._steps(), 0
        for s, gold in zip(scores, y):
            def total(path):
                full = (0, *path, 0)
                return sum(s[i, k] for i, k in enumerate(path)) + sum(steps[a, b] for a, b in zip(full, full[1:]))
            out += np.logaddexp.reduce([total(p) for p in itertools.product(range(len(P.LABELS)), repeat=2)]) - total(gold)
        return out

    grads = [np.zeros_like(field.emit), np.zeros_like(field.step)]
    field._add(x, y, grads, 1.0)
    for w, g, at in ((field.emit, grads[0], (1, 5)), (field.emit, grads[0], (2, 0)), (field.step, grads[1], (5, 6)), (field.step, grads[1], (0, 3)), (field.step, grads[1], (0, 0))):
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_odd_texts(spark, field):
    rows = [(1, None), (2, ""), (3, "a" * 300_000 + "@b"), (4, "1" * 300_000), (5, "1.1." * 50_000), (6, "+" * 100_000), (None, "x@y.zz"), (None, "x@y.zz"), (7, "clean words only")]
    got = P.find(spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, spans string"), True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].spans == by[2].spans == by[7].spans == "" and by[1].redacted_text is None
    assert by[None].spans == "email:0:6" and by[None].redacted_text == "[email]"
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


#: Written by hand, apart from the training table; spans stand between two bars: kind, then text.
UNSEEN = """
Please reach Mr. |name:Daniel Okafor| about the lease.
Our nurse saw patient |name:Maria Lopez| on 3 May 2021.
Frau |name:Krüger| wohnt seit 1998 in Mainz.
Yours sincerely, Dr. |name:Helen M. Brandt|, 14 June
Invoice sent to Mrs. |name:O'Neill| in 2016.
The contact: |name:Yuki|, room 12
You can ring |phone:020 7946 0958| after 18:00.
Tel: |phone:01 42 68 53 00| ou par courrier
Mobile |phone:0171-2345678|, Montag bis Freitag
fax |phone:212-555-0199| or write to us
Call |phone:(415) 555-2671| for 10% off
Her cell |phone:646.555.0123| is off at 9:30
ssn |id:078-05-1120| was printed in 1938
His social number |id:219-09-9999| leaked.
Pay to IBAN |iban:DE89 3704 0044 0532 0130 00| by 2024-02-01
iban: |iban:GB29 NWBK 6016 1331 9268 19|, ref 77
Account |iban:FR1420041010050500013M02606| was closed.
konto |iban:NL91ABNA0417164300| bis 31.12.2023
export API_TOKEN=|secret:9f86d081884c7d659a2feaa0c55ad015|
"password": "|secret:kJ8sQ2mZp4Lr7Tn1Xv5B7q|",
Authorization: Bearer |secret:ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p67q|
the api key |secret:sk-4f9Qm2ZxT8vLk1Rb6Yw3Ns5Hd0Jp7q| expired in 2022
passwd |secret:b1946ac92492d2347c6235b4d2611184| please rotate
secret: |secret:aZ3xT9kQ1mW7rL5vB2nC8yD4|
server |ip:203.0.113.77| answered in 30 ms
mail |email:jo.smith@mail.example.net|, room 4
On 12/04/1997 the 3 teams met at 10:30.
Version 3.11.4 fixes 27 bugs since v2.9.0.
The token of thanks cost $12,500 in 2019.
commit 4b825dc642cb6eb9a060e54bf8d69288fbee4904 adds tests
checksum e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855
ISBN 978-0-306-40615-7, page 211
Chapters 3-7 and 12-19 cover 1914-1918.
order 1234567890123 shipped on 2020-11-30
He scored 34 21 17 9 in four quarters.
Flight LH1234 left gate B22 at 06:55.
id 550e8400-e29b-41d4-a716-446655440000 was created
See https://example.org/a/20190304 for 5 more.
The name is 7 letters long.
Population rose from 1,204,334 to 1,310,002.
Temperatures of 21.5 and 19.8 in room 101
phone batteries last 2 days
"""


def unseen():
    rows = []
    for line in UNSEEN.strip().split("\n"):
        text, spans = "", []
        for k, part in enumerate(line.split("|")):
            if k % 2:
                kind, part = part.split(":", 1)
                spans.append((kind, len(text), len(text) + len(part)))
            text += part
        rows.append((text, spans))
    return rows


def test_recall_and_precision_by_kind_on_an_independent_set(field):
    rows = unseen()
    found = [every for _, every in P.all_spans([t for t, _ in rows], field)]
    hit, wanted, given = {}, {}, {}
    for (_, spans), every in zip(rows, found):
        for counts, some in ((wanted, spans), (given, every), (hit, set(spans) & set(every))):
            for kind, _, _ in some:
                counts[kind] = counts.get(kind, 0) + 1
    print({k: (hit.get(k, 0), wanted.get(k, 0), given.get(k, 0)) for k in P.KINDS})
    for kind, n in wanted.items():
        assert hit.get(kind, 0) >= 0.6 * n, kind
    assert sum(hit.values()) >= 0.85 * sum(wanted.values()) and sum(hit.values()) >= 0.85 * sum(given.values())
    assert not {t for t, _ in rows} & {t for t, _ in P.labelled()}


def test_long_words_count_whole(field):
    assert P.shape("ab1" * 60) == "xd" * 60 and P.shape("a" * 300 + "7") == "xd"
    assert P.account("GB29NWBK60161331926819") and not P.account("GB28NWBK60161331926819")


#: Sentences a review found wrong; the labelled table was widened after they were seen, so they show no independent figure.
CLEAN_AFTER_CUES = (
    "Contact Us page", "Patient Care 2020", "Dr Pepper is sweet", "Name Value 3", "merged into release-1.2.3", "md5 9e107d9d372bb6826bd81d3542a419d6", "model 555-0199 sold", "part 123-45-6789",
    "The match on 12 34 56", "see foo_bar_baz1_long_identifier_name here", "upgrade numpy-1.26.4 today", "Python 3.12.1 and lib-2.0.1.tar",
)
FOUND_WITHOUT_OLD_CUES = {"WhatsApp |07700 900123": "phone", "Set GITHUB_PAT to |ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p67q": "secret", "sincerely, |Jane Doe": "name"}


def test_negatives_of_cue_words_and_more_cues(field):
    for text, (_, every) in zip(CLEAN_AFTER_CUES, P.all_spans(list(CLEAN_AFTER_CUES), field)):
        assert not every, text
    for marked, kind in FOUND_WITHOUT_OLD_CUES.items():
        text, start = marked.replace("|", ""), marked.index("|")
        assert P.all_spans([text], field)[0][1] == [(kind, start, len(text))], text

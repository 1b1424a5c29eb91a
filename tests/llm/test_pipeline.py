import random
from collections import defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline as C
from kinelog.llm import decontamination, personal, quality

from .test_jaccard import brute as brute_links

SF = "/root/testdata/sf0.001"


def brute(rows, benchmark):
    """doc_id -> ids: the stages one after the other in plain Python."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kept = []
    for d, t in rows:
        figures, text = quality.judge(t or "", defaultdict(iter(range(10**9)).__next__))
        if figures[6]:
            kept.append((d, text))
    classes = brute_links(kept)
    kept = [(d, t) for d, t in kept if classes[d][1] == d]
    items = [decontamination.tokens(b) for b in benchmark]

    def dirty(text):
        doc = decontamination.Items([(0, b) for b in benchmark])
        ids = doc.numbers(text)
        return any(decontamination.coverage(ids, own) >= 0.6 * len(own) for _, own in doc.items)

    kept = [(d, t) for d, t in kept if not dirty(t)]
    assert items
    field = personal.Field(personal.labelled())
    kept = [(d, personal.redacted(t, personal.all_spans([t], field)[0][1])) for d, t in kept]
    return {d: model.encode(t, add_bos=True, add_eos=True) for d, t in kept}


def test_stages_and_columns():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    benchmark = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = C.run(spark, SF).collect()
    want = brute(rows, benchmark)
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) > 50


def test_odd_rows_in_every_stage(spark):
    rng = random.Random(2)
    prose = " ".join(f"Word{rng.randrange(10**6)}" for _ in range(80)) + "."
    rows = [(None, None, None, None, None), (1, prose, "en", None, 5), (1, prose, "en", None, 5), (2, "", None, "s", 0), (None, prose, None, None, None), (3, prose + " More " * 3 + ".", "en", "s", 1), (4, prose.replace("0", "7") * 900, "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string, own_text int"
    docs = spark.createDataFrame([(*r, True, "x", 1) for r in rows], kind)
    for name, stage in C.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            if name != "encoding":
                assert out.columns == list(C.COLUMNS)
            n = out.count()
            assert n == 0 if some is not docs else n > 0
    once = C.deduplicate(spark, docs, SF).collect()
    assert sorted([r.doc_id for r in once], key=str) == [1, 2, 4, None, None]

import corpus_pipeline
from palimpsest.llm import line_crf
from palimpsest.llm.shared import written
from palimpsest.llm.tokens import default_tokenizer, encoder
from tests.llm.test_dedup import WORD, brute_join, brute_lines, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, sample):
    docs, after = sample["documents"], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == sample["documents"].columns
    kept = {r.doc_id for r in line_crf.assess(sample["documents"], sample["labels"]).collect() if r.kept}
    texts = {r.doc_id: r.text for r in after["quality_rules"]}
    assert set(texts) == kept
    lines = {i: t for i, t in brute_lines(list(texts.items())).items() if WORD.search(t) or t == texts[i]}
    assert {r.doc_id: r.text for r in after["line_dedup"]} == lines
    order = sorted(lines)
    classes, _ = brute_join([lines[i] for i in order])
    assert {r.doc_id for r in after["ngram_join"]} == {order[c] for c in classes}
    items = [shingle_set(r.text) for r in sample["benchmark"].collect()]
    clean = {i for i in {order[c] for c in classes} if not any(s and len(s & shingle_set(lines[i])) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in after["decontamination"]} == clean
    coder = encoder(default_tokenizer()).tokenizer
    want = {i: len(coder.encode(lines[i], add_special_tokens=False).ids) + 1 for i in clean}
    got = {}
    for p in after["packing"]:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    assert corpus_pipeline.run(spark, SF).count() == len(after["packing"])

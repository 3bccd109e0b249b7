import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from reelforge.llm import pii


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = {"en": "the and of to in cat dog home tree", "fr": "le la et de un chat chien maison arbre"}
    rows, originals = [], []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choices(vocabulary[lang].split() + [f"{lang}{k}" for k in "abcdefghij"], k=120))
        rows.append((i, f"{text} mail kfs.{i:02d}@mail0.example.com", lang, f"s{i % 4}", 0))
        originals.append(rows[-1])
    rows += [(100 + i, originals[i][1], originals[i][2], "s0", 0) for i in range(10)]
    rows += [(200 + i, originals[i][1].replace(originals[i][1].split()[60], "edited", 1), originals[i][2], "s1", 0) for i in range(10, 20)]
    rows += [(300, None, "en", "s0", 0), (301, "", None, None, 0), (302, "12345 !!", "fr", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([r.asDict() for r in docs.collect()])
    assert sorted(r["doc_id"] for r in seen[0]) == sorted(r[0] for r in rows if r[0] < 300)
    assert sorted(r["doc_id"] for r in seen[1]) == list(range(60))
    assert all("mail0.example.com" not in r["text"] and pii.PATTERN.search(r["text"]) for r in seen[2])
    assert {r["doc_id"] for r in seen[3]} <= set(range(60)) and len(seen[3]) > 30
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in seen[3]}
    assert len(seen[4]) == len(seen[3])
    for r in seen[4]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_eos=True) and r["decoded"] == texts[r["doc_id"]]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r.asDict()) for r in run.collect()) == sorted(map(str, seen[4]))

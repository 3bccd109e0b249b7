import math
import zlib

from reelforge.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string"
WORDS = {"en": "the cat sat on the mat and then went home", "fr": "le chat est sur la table et puis il rentre", "de": "der hund schläft auf dem sofa und träumt gern"}


def rows():
    out = []
    for i in range(120):
        lang = sorted(WORDS)[i % 3]
        parts = WORDS[lang].split()
        out.append((i, " ".join(parts[(i + k) % len(parts)] for k in range(6)), lang, "x"))
    return out


def test_predictions(spark):
    extra = [(500, None, "en", ""), (501, "", None, ""), (502, "123 ²!", "de", ""), (503, "中文", None, ""), (504, "schlafen träumen", None, ""), (None, "the cat", "en", ""), (505, "the " * 50_000, None, ""), (505, "the " * 50_000, None, "")]
    docs = spark.createDataFrame(rows() + extra, SCHEMA)
    seen = docs.withColumn("r", langid.remainder()).select("doc_id", "r").filter("doc_id is not null").collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 4 for r in seen)
    model = langid.fit(docs.filter(langid.remainder() != 2), least=1)
    got = [tuple(r) for r in langid.predict(docs, model).collect()]
    assert len(got) == 128
    by = {r[0]: r for r in got}
    assert all(by[i][1] == lang for i, _, lang, _ in rows())
    assert [by[i][1:] for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503][1:] == ("de", 1 / 3)  # nothing known: ties go to the smaller name
    assert by[504][1] == "de" and by[None][1] == "en" and by[505][1] == "en"
    assert all(0 <= r[2] <= 1 for r in got)


def test_backoff_goes_to_shorter_grams(spark):
    model = langid.fit(spark.createDataFrame(rows(), SCHEMA), least=1)
    assert (model.word("the") == model.weights[model.place[0, "the"]]).all()
    known = [model.weights[model.place[4, g]] for g in langid.grams("thex", 4) if (4, g) in model.place]
    assert known and abs(model.word("thex") - sum(known) / len(known)).max() < 1e-12
    assert (4, " zcz") not in model.place and model.word("zcz") is not None and model.word("中") is None


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, "the cat", None, "")], SCHEMA)
    assert [tuple(r) for r in langid.predict(docs, langid.fit(docs)).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.filter(langid.remainder() != 2))
    held = langid.predict(docs.filter(langid.remainder() == 2), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)


def test_stage_drops_the_undetermined(spark):
    docs = spark.createDataFrame([*rows(), (900, "12345", None, ""), (901, "the cat", None, "")], SCHEMA)
    kept = langid.keep_identified(docs, least=0.5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(120), 901]
    assert kept.filter("doc_id = 901").first().lang == "en"


def test_keep_identified_with_clashing_columns(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", i, "x", 0.5) for i in range(40)]
    rows += [(90, "the dog", None, 90, "y", 0.5), (91, None, "en", 91, "y", 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang_pred int, lang_pred string, lang_score double")
    got = langid.keep_identified(frame)
    assert got.columns == frame.columns
    found = {r.doc_id: r for r in got.collect()}
    assert sorted(found) == [*range(40), 90] and found[90].lang == "en" and found[90].lang_pred == "y" and found[7]._lang_pred == 7


def brute_score(texts, labelled, least=1):
    """The word-first backoff with plain dictionaries over all labelled texts."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    langs = sorted({lang for _, lang in labelled})
    counts = {}
    for text, lang in labelled:
        for word in letters(text):
            pieces = [(0, word)] + [(1, c) for c in word] + [(n, f" {word} "[i : i + n]) for n in (2, 3, 4) for i in range(len(word) + 3 - n)]
            for piece in pieces:
                counts.setdefault(piece, dict.fromkeys(langs, 0))[lang] += 1
    counts = {k: v for k, v in counts.items() if sum(v.values()) >= least}
    total = {(n, lang): sum(v[lang] for (kind, _), v in counts.items() if kind == n) for n in range(5) for lang in langs}
    kinds = {n: sum(kind == n for kind, _ in counts) for n in range(5)}
    log = lambda n, gram, lang: math.log((counts[n, gram][lang] + 0.5) / (total[n, lang] + 0.5 * kinds[n]))
    out = []
    for text in texts:
        sums = dict.fromkeys(langs, 0.0)
        words = letters(text or "")
        for word in words:
            for n in (0, 4, 3, 2, 1):
                pieces = [word] if n == 0 else list(word) if n == 1 else [f" {word} "[i : i + n] for i in range(len(word) + 3 - n)]
                known = [p for p in pieces if (n, p) in counts]
                if known:
                    for lang in langs:
                        sums[lang] += sum(log(n, p, lang) for p in known) / len(known)
                    break
        best = max(langs, key=lambda lang: (sums[lang], [-ord(c) for c in lang]))
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())) if words else ("und", 0.0))
    return out


def test_scores_match_brute_force(spark):
    labelled = [(text, lang) for _, text, lang, _ in rows()]
    asked = ["the dog", "schlafsofa", "qqq thematte", "chats zzz", "", None, "12 !", "träumerei le xyz", "mat mat mat der"]
    model = langid.fit(spark.createDataFrame(rows(), SCHEMA), least=1)
    docs = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(asked)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for i, (lang, score) in enumerate(brute_score(asked, labelled)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, (asked[i], got[i], lang, score)

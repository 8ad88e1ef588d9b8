import random

import corpus_pipeline
from gridcast.llm import queries
from test_dart_minhash import brute as classes_of

SOUNDS = {"en": ["the", "and", "ing", "ra", "lo"], "de": ["sch", "ung", "ein", "ber", "ü"]}


def text(rng, lang, lines):
    return "\n".join(" ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(3)) + str(rng.randrange(50)) for _ in range(9)) for _ in range(lines))


def corpus(spark, folder):
    rng = random.Random(12)
    texts = [text(rng, "en" if i % 3 else "de", 6) for i in range(60)]
    item = text(rng, "en", 3)
    header = "All of these pages begin with one and the same line of text"
    texts[5] = texts[4]
    texts[7] = texts[6].replace("\n", " \n") + " tail"
    texts[10] = texts[10][:100] + " " + item.replace("\n", " ")
    for i in range(20, 30):
        texts[i] = header + "\n" + texts[i]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(70, None, None, None, None), (71, "", "en", "s1", 0), (72, "12 34 !!", "en", "s1", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short test item never seen here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(enumerate(texts)), header


def test_stages(spark, tmp_path):
    texts, header = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["language_id"]) == set(texts)
    lines = seen["line_dedup"]
    assert 5 not in lines and lines[20] == texts[20] and lines[21] == texts[21].removeprefix(header + "\n")
    kept = classes_of(list(lines.items()))
    assert set(seen["minhash_dedup"]) == {i for i, c in kept.items() if i == c}
    assert set(seen["minhash_dedup"]) - set(seen["decontamination"]) == {10}
    assert set(seen["source_mix"]) <= set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_every_operator_has_its_query():
    names = set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.ORACLES) <= names and len(corpus_pipeline.STAGES) == 5

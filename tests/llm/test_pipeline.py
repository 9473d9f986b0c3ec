import corpus_pipeline
from cases import documents, odd_texts, prose
from rosterkit.llm.packing import PieceTokenizer, default_tokenizer

from test_decontamination import brute_force as leaks
from test_simhash import components, fingerprint
from test_toxicity import labelled


def write(spark, folder, texts, toxic, items, ids=None):
    documents(spark, texts, ids).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{number}"
        function(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append({r.doc_id: r for r in docs.collect()} if number < 4 else docs.collect())
    return out


def test_stages_by_brute_force(spark, tmp_path):
    texts, toxic = labelled(240)
    near = prose(9000, 400)
    leak = prose(9100, 40)
    boiler = "alpha beta gamma delta all words are the same alpha rho sigma tau"
    texts += [near, near + " tail", near, prose(9200, 50) + " " + leak + " " + prose(9201, 50), None, ""]
    texts += [prose(9300 + i, 80) + "\n" + boiler for i in range(8)]
    folder = str(tmp_path / "data")
    write(spark, folder, texts, toxic, [(1, leak), (2, prose(5, 3))])
    clean, lines, unique, safe, packed = staged(spark, folder)
    columns = documents(spark, []).columns
    assert all(list(r.asDict()) == columns for part in (clean, lines, unique, safe) for r in part.values())
    assert sum(toxic[i] and i in clean for i in range(240)) <= 6 and sum(not toxic[i] and i not in clean for i in range(240)) <= 4
    assert all(boiler not in (r.text or "") for r in lines.values()) and set(lines) == set(clean)
    ids = sorted(lines)
    groups = components(ids, [fingerprint(lines[i].text) for i in ids])
    assert sorted(unique) == sorted(set(groups))
    for i, (_, n_hit, _) in zip(sorted(safe), leaks([unique[i].text for i in sorted(unique)], [(1, leak), (2, prose(5, 3))], 10)):
        assert (safe[i].text == unique[i].text) == (n_hit == 0)
    assert leak not in " ".join(r.text or "" for r in safe.values()) and all(r.text is None or r.n_chars == len(r.text) for r in safe.values())
    tokens = PieceTokenizer(default_tokenizer()).encode([safe[i].text for i in sorted(safe)])[0]
    assert sum(r.length for r in packed) == len(tokens)
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_odd_documents(spark, tmp_path):
    folder = str(tmp_path / "odd")
    texts = odd_texts()
    write(spark, folder, texts, [], [], [None, None] + list(range(len(texts) - 2)))
    assert staged(spark, folder)[4]
    folder = str(tmp_path / "empty")
    write(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0

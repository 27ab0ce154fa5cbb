"""The pipeline on a small corpus with one document of each kind."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    words = {"en": [f"th{i}ing" for i in range(400)], "es": [f"ción{i}ñ" for i in range(400)]}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    leak = say("en", 30)
    rows = [(i, say("en" if i % 2 else "es", rnd.randint(60, 120)), "en" if i % 2 else "es") for i in range(200)]
    base = rows[3][1].split(" ")
    near = [*base]
    near[10] = "edited"
    rows += [(300, rows[3][1], "en"), (301, " ".join(near), "en"), (302, say("en", 30) + " " + leak + " " + say("en", 20), "en"), (303, "1234 5678 !!", "en"), (304, None, "en"), (305, "", "en")]
    docs = [(*r, f"src{r[0] % 3}", len(r[1] or "")) for r in rows]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {300, 301, 302, 303, 304, 305} and ids >= set(range(200))
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "weights", "token_files"]

"""The pipeline's stages, each on what the one before kept."""

import random

import corpus_pipeline

from densekit.llm import minhash, quality


def test_stages(spark):
    rng = random.Random(3)

    def line():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(12))

    clean = [(i, "\n".join(line() for _ in range(8)), "en", f"s{i % 3}") for i in range(90)]
    shared = clean[3][1].split("\n")[2:6]
    rows = [
        *clean, (200, clean[0][1], "en", "s0"), (201, clean[1][1].replace("a", "a", 1).rsplit(" ", 1)[0], "en", "s1"),
        (202, "\n".join([line(), *shared, line(), line(), line(), line()]), "en", "s2"), (203, "too short", "en", "s0"),
        (204, "\n".join(" ".join(w + "$$$" for w in line().split()) for _ in range(8)), "en", "s0"), (205, None, None, None),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns, name
        kept.append({r.doc_id: r for r in docs.collect()})
    good, lines, near, mixed = kept
    assert set(good) == {*range(90), 200, 201, 202}
    assert 200 not in lines and all(not set(shared) & set(lines[202].text.split("\n")) for _ in [0])
    assert all(lines[i].text == clean[i][1] and lines[i].n_chars == len(clean[i][1]) for i in range(90))
    assert set(range(90)) <= set(near) and set(mixed) <= set(near)
    encoded = corpus_pipeline.encoding_stage(spark, docs, "").collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in encoded) and len(encoded) == docs.count()


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, empty texts, repeated rows and columns named like results: values of other columns stay."""
    rng = random.Random(4)
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(70)) for _ in range(12)]
    texts = [None, "", " ", "x", *words, words[0], "\n".join(w[:200] for w in words)]
    layout = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, `class` string, target string, n_lines string"
    rows = [(i if i != 6 else None, t, None if i % 2 else "en", None if i % 3 else "s", None, f"k{i}", i, "c", "t", "n") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    for table in (rows, []):
        docs = spark.createDataFrame(table, layout)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, docs, "").cache()
            assert done.schema.simpleString() == docs.schema.simpleString()
            docs = done
        found = docs.collect()
        assert all(r.kept == f"k{r.size}" and r.n_lines == "n" for r in found)
        assert {r.text for r in found} <= set(words[:12]) | {r[1] for r in rows}
        assert corpus_pipeline.encoding_stage(spark, docs, "").count() == len(found)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in quality.quality_rules(docs).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in rows.select("doc_id").collect()} <= kept
    assert rows.filter("not round_trip").count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (3, text + " tail"), (9, "other words here"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs).collect()) == [3, 9]

"""Token alignment, spelling variants and the quality classifier against plain versions of themselves."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from densekit.llm import alignment, boosting, classifier, queries, spelling

CLASH = "doc_id long, text string, lang string, word string, n long, score double, block string, pair long, statistics string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "w", 1, 0.5, "b", 2, "s") for i, t in rows], CLASH)


# 11: token alignment


@pytest.fixture(scope="module")
def libraries():
    a, b = alignment.default_paths()
    tokenizer = Tokenizer.from_file(a)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=b)


def brute_align(rows, libraries):
    """Whole texts, all pairs of tokens of a text by their bytes."""
    tokenizer, processor = libraries
    to_byte = {c: b for b, c in enumerate(alignment.byte_characters())}

    def both(text):
        if not text:
            return [], []
        a = [(i, bytes(to_byte[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in processor.encode(text):
            p = processor.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode()))
        spelled = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == spelled == b"".join(x for _, x in b) else ([], [])

    def spans(tokens):
        ends = np.cumsum([0, *(len(x) for _, x in tokens)]).tolist()
        return [(i, s, e) for (i, _), s, e in zip(tokens, ends, ends[1:])]

    every, links = [], collections.Counter()
    for i, t in rows:
        a, b = map(spans, both(t))
        own = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
        links.update(own)
        every.append((i, a, b, own))
    most = collections.defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    out = []
    for i, a, b, own in every:
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ";".join(
            ",".join(str(x) for x, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(x) for x, s, e in b if lo <= s and e <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        )
        out.append((i, len(a), len(b), len(cuts), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), groups))
    return collections.Counter(out)


ODD_TEXTS = [
    None, "", " ", "\n", "  \n ", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "don't stop, it's 3.14!!", "né 日本 𝒳𝒴 ≠ x​y", "x▁y z",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "tab\there\r\nend", "a\x1cb \x85c", "é ́x ﬁ ½, ²: Ⅷ. ٣!", "日本語\n日本語, x", "The The  The", "'s 've '", "a\x00b",
    "&&& ### |a|b| x>y </s>>", "...\n...\n ...", "a,b;c:d e-f_g (h) [i]{j}", "ß" * 50, "🙂🙂 🙂\n🙂,🙂", "　wide　space", "word " * 60,
]


@pytest.mark.parametrize("block,cache", [(40, 0), (1 << 20, 1 << 20)])
def test_alignment_of_odd_texts(spark, monkeypatch, libraries, block, cache):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "CACHE_BYTES", cache)
    alignment._aligner.cache_clear()
    rows = [(None if i == 7 else i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "\n"), (5, "a"), (5, "another")]
    got = alignment.align(table(spark, rows).repartition(3), *alignment.default_paths())
    assert collections.Counter(map(tuple, got.collect())) == brute_align(rows, libraries)


def test_alignment_of_random_texts(spark, libraries):
    rng = random.Random(11)
    parts = ["a", "the", "ing", "é", "日", "𝒳", " ", " ", " ", "\n", ".", ",", "'", "s", "7", "&", ">", "<", "\t", " ", "́", "½", "_", "Ünd", "▁"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    got = alignment.align(table(spark, rows), *alignment.default_paths())
    assert collections.Counter(map(tuple, got.collect())) == brute_align(rows, libraries)


def test_alignment_of_the_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect() if len(r.text) < 3000]
    got = alignment.align(docs.filter("length(text) < 3000"), *alignment.default_paths())
    assert collections.Counter(map(tuple, got.collect())) == brute_align(rows, libraries)


def test_alignment_without_safe_cuts(spark, monkeypatch, libraries):
    """Vocabularies that allow no cut are aligned text by text."""
    init = alignment._Segments.__init__

    def unsafe(self, a, b):
        init(self, a, b)
        self.safe = False

    aligner = alignment.Aligner(*alignment._files(*alignment.default_paths()))
    whole = aligner.block(ODD_TEXTS)
    monkeypatch.setattr(alignment._Segments, "__init__", unsafe)
    again = alignment.Aligner(*alignment._files(*alignment.default_paths())).block(ODD_TEXTS)
    for side in ("a", "b"):
        x, y = (b.per_document(getattr(b, side).counts) for b in (whole, again))
        assert x.tolist() == y.tolist() and sum(x) > 0


def test_plain_segments_are_encoded_without_spans(monkeypatch, libraries):
    """Runs of plain segments are cut by their decoded bytes alone, as spans would cut them."""
    files = alignment._files(*alignment.default_paths())
    texts = ["Words, don't stop: it's 3.14 né 日本 𝒳𝒴 ≠ x\u200by", "ß" * 9 + " The the", "a\nb <|endoftext|> <0x0A>"]
    spans = []
    for side in (alignment._A, alignment._B):
        encode = side.encode
        monkeypatch.setattr(side, "encode", lambda self, text, encode=encode: spans.append(text) or encode(self, text))
    got = alignment.Aligner(*files).block(texts)
    assert spans == []
    monkeypatch.setattr(alignment.Aligner, "_counted", lambda *_: None)
    want = alignment.Aligner(*files).block(texts)
    assert len(spans) == 2 * len(got.a.counts)
    assert got.counts.tolist() == want.counts.tolist()

    def told(block):
        """ids and sizes of each segment, in the documents' order"""
        sides = []
        for t in (block.a, block.b):
            at = np.cumsum([0, *t.counts])
            sides.append([list(zip(t.ids[at[i] : at[i + 1]].tolist(), t.sizes[at[i] : at[i + 1]].tolist())) for i in block.which.tolist()])
        return sides

    assert told(got) == told(want)


def test_alignment_query(spark, libraries):
    alignment._aligner.cache_clear()
    got = queries.QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    full = alignment.align(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), *alignment.default_paths())
    want = {(r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in full.collect()}
    assert {(r.doc_id, r.groups_sha256) for r in got.collect()} == want


# 12: spelling variants


def brute_words(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(12)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 11))) for _ in range(60)]
    words = list(base)
    for w in base:
        for _ in range(3):
            at, c = rng.randrange(len(w)), rng.choice("abcÀ×")
            words.append(rng.choice([w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c + w[at:]]))
    texts = [" ".join(rng.choice(words[: rng.randint(5, len(words))]) for _ in range(90)) for _ in range(60)]
    chain = " ".join(["aaaaaaaa"] * 3 + ["aaaaaaab"] * 6 + ["aaaaaabb"] * 12 + ["aaaaabbb"] * 24 + ["aaaabbbb"] * 48 + ["aaabbbbb"] * 96)
    return [(None if i % 9 == 2 else i, t) for i, t in enumerate([None, "", " 12 ", chain, "ABCDE Abcde abcde abcdf " * 3, *texts, texts[0], texts[0]])]


def test_variants(spark, spelled):
    want = brute_variants(spelled)
    got = spelling.variants(table(spark, spelled))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(r[2] not in (r[0], r[1]) for r in rows)  # chains of more than one step


def test_near_pairs_of_short_alphabet(spark):
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"))
    pairs = [tuple(sorted(r)) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_a_crowd_that_shares_a_half_is_not_paired(spark):
    """Rows of the join stay near the number of words though all share their first half."""
    rng = random.Random(14)
    words = sorted({"stemstem" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    size = spelling.F.char_length("word")
    keys = df.select(spelling.F.explode(spelling._keys(size, spelling.F.lit(0))).alias("key")).groupBy("key").count()
    met = keys.selectExpr("sum(count * count)").first()[0]
    assert met < 20 * len(words)


def test_exploded_keys_of_words_are_not_broadcast(spark, monkeypatch, spelled):
    """A file of words is small, its keys are many times that: no join may gather them."""
    plans = []

    def noted(df, pin=spelling.pin):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df)

    monkeypatch.setattr(spelling, "pin", noted)
    got = noted(spelling.variants(table(spark, spelled)))
    assert len(plans) >= 5 and sum(plan.count("SortMergeJoin") for plan in plans) >= 5
    assert not any("Broadcast" in plan for plan in plans)
    assert got.count() == len(brute_words(spelled))


def test_variants_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_variants(rows)


# 13: quality classifier


def test_trees_learn_what_a_line_cannot():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert np.isfinite(trees.value).all() and trees.feature.shape == (80, 15)


def slow_score(trees, row):
    margin = trees.base
    for t in range(len(trees.feature)):
        node = 0
        for _ in range(trees.depth):
            node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
        margin += trees.value[t, node - (2**trees.depth - 1)]
    return 1 / (1 + np.exp(-margin))


def test_flat_traversal_equals_walking():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(500, 3)), 1)  # ties
    trees = boosting.fit(x, (x.sum(axis=1) > 0).astype(float), boosting.Growth(trees=9, depth=3))
    assert np.allclose(trees.score(x), [slow_score(trees, r) for r in x])


def test_a_histogram_split_is_the_best_split():
    """One tree of depth one against all cuts of all features."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=200) > 4).astype(float)
    growth = boosting.Growth(trees=1, depth=1)
    trees = boosting.fit(x, y, growth)
    g, h = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))

    def gain(f, c):
        left = x[:, f] <= c
        return sum(g[s].sum() ** 2 / (h[s].sum() + growth.ridge) for s in (left, ~left))

    cuts = [(f, c + 0.5) for f in range(3) for c in range(8)]
    assert gain(trees.feature[0, 0], trees.cut[0, 0]) == pytest.approx(max(gain(*c) for c in cuts))


def test_one_class_or_no_rows():
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).score(np.ones((3, 2))).tolist() == [0.5] * 3
    assert (boosting.fit(np.ones((9, 2)), np.ones(9)).score(np.ones((3, 2))) > 0.9).all()


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_quality_trees"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    judged = got.merge(labels, on="doc_id")
    judged = judged[judged.held_out]
    assert len(judged) > 60 and (judged.predicted == judged.quality).mean() > 0.97
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = table(spark, [(i, f"word {i % 7} " * (i % 5 + 1)) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 5 > 2)) for i in range(200)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", spelling.F.when(classifier.held_out("doc_id"), 1 - spelling.F.col("quality")).otherwise(spelling.F.col("quality")))
    one, two = (sorted(map(tuple, classifier.classify(docs, x).collect())) for x in (labels, flipped))
    assert one == two and len({r[2] for r in one}) > 1


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 0), (1, 1)], [(4, 1), (None, 0)]])
def test_odd_labels_and_texts(spark, labels):
    rows = [(None, None), (1, ""), (1, " \n"), (2, "#" * 5000), (3, "a " * 30000), (4, "é日本\n\n|"), (4, "é日本\n\n|")]
    docs = table(spark, rows)
    got = classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert len({r.score for r in got}) == 1


def test_empty_tables(spark):
    none = table(spark, [])
    assert alignment.align(none, *alignment.default_paths()).count() == spelling.variants(none).count() == 0
    assert classifier.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0

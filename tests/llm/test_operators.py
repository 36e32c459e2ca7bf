"""The operators on odd rows, on empty tables, and against plain versions of themselves."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from densekit.llm import bpe, html, impact, line_dedup, minhash, mixing, passages, pii, quality, queries, sharding
from densekit.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, class int, copies int"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns named like results."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 12) for _ in range(900))
    plain = [prose(rng, rng.randint(60, 90)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = [
        None, "", " \n\t ", "word", "two words", "a\nb\nc", "a\nb\nc\nd", "x " * 400, "#### $$$ %%% " * 30, long, long + " end",
        plain[0] + "\nmail bob@site.org or +1 (042) 555-7845, 10.0.0.1, 4111 1111 1111 1111.",
        plain[1] + " " + passage + " " + plain[2], plain[3] + " " + passage, "x@y x@y.z_@a.b 1.2.3.4.5.6.7.8 999.1.1.1",
        "one\ntwo\nthree\n\nfour\nfive", "zero\none\ntwo\nthree\n\nfour", "é日本 <|endoftext|> it's x", *plain, *plain[:9],
    ]
    rows = [
        (None if i % 17 == 5 else i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "sé"][i % 4], None if t is None else len(t), "x", "y", 1, 2)
        for i, t in enumerate(texts)
    ]
    return [*rows, rows[11], rows[11], rows[0], rows[1]]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


RUNS = {
    "quality": lambda d: quality.quality_rules(d), "lines": lambda d: line_dedup.line_dedup(d), "mix": lambda d: mixing.plan_mix(d),
    "bpe": lambda d: bpe.decode(bpe.encode(d, bpe.default_path()), bpe.default_path(), text="decoded"),
    "minhash": lambda d: minhash.near_duplicates(d), "shards": lambda d: sharding.assign(d), "pii": lambda d: pii.by_document(d, pii.pii_spans(d)),
    "html": lambda d: html.extract(d, "text", "main"),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_row(odd, none, odd_rows, name):
    assert RUNS[name](odd).count() == len(odd_rows)
    assert RUNS[name](none).count() == 0


def test_odd_rows_elsewhere(odd, odd_rows):
    long = [r for r in odd_rows if r[1] and len(r[1].split()) > 5000]
    spans = passages.repeated_passages(odd).collect()
    assert {r[0] for r in long} <= {r.doc_id for r in spans} and all(r.n_words >= 50 for r in spans)
    assert minhash.drop_near_duplicates(odd).columns == odd.columns
    assert pii.redact(odd, pii.pii_spans(odd)).select("doc_id", "text", "kept").count() == len(odd_rows)


def test_empty_tables(spark, none):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert impact.top_k(vectors, vectors, 5).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert mixing.mix(none).count() == minhash.drop_near_duplicates(none).count() == 0
    assert pii.redact(none, pii.pii_spans(none)).count() == 0
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# 1: top-k


def brute_top(rows, k):
    use = [
        (i, [np.floor(256 * float(x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, a in use:
        scores = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in use if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows_of_block", [7, 4096])
def test_top_k(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(impact, "INDEX_ROWS", rows_of_block)
    monkeypatch.setattr(impact, "ENOUGH", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(9)] + [(200, [1.0, None]), (201, None), (202, [float("nan")] * 6)]
    rows += [(203, [float("inf")] * 6), (204, []), (205, [0.5]), (None, [1.0] * 6), (206, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, impact.top_k(df, df, 5).collect())) == brute_top(rows, 5)


def test_top_k_broadcasts_no_queries(spark, monkeypatch):
    """A block of queries goes to every block of the index: however small their file is, these copies may not be gathered."""
    for name, size in (("INDEX_ROWS", 7), ("QUERY_ROWS", 2), ("MOST_MET", 3)):
        monkeypatch.setattr(impact, name, size)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = impact.top_k(df, df, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 5)


def clamped_top(rows, k):
    whole = {i: [min(max(int(np.floor(256 * x)) if abs(x) < 1e15 else int(np.sign(x)) * 2**63, -(2**63)), 2**63 - 1) for x in v] for i, v in rows}
    out = []
    for q, a in whole.items():
        scores = [(min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), i) for i, b in whole.items() if i != q]
        scores.sort(key=lambda s: (-s[0], s[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows_of_block", [3, 4096])
@pytest.mark.parametrize("size, dims", [(2e6, 600), (1e7, 3), (3e4, 40), (2.0**30, 8), (1e300, 2)])
def test_top_k_of_large_components(spark, monkeypatch, rows_of_block, size, dims):
    """At 2^31 and beyond, and with scores beyond 2^53 and beyond a long."""
    monkeypatch.setattr(impact, "INDEX_ROWS", rows_of_block)
    monkeypatch.setattr(impact, "ENOUGH", 2)
    rng = np.random.default_rng(int(size) % 97)
    rows = [(i, [float(x) for x in rng.choice([-size, -size / 3, 0.01, size / 7, size, size * 0.999999], dims)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, impact.top_k(df, df, 4).collect())) == clamped_top(rows, 4)


# 2: quality rules


def brute_counts(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), len(lines))


def test_counts(odd, odd_rows):
    got = quality.measure(odd).select(*quality.COUNTS, "_lines").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_counts(r[1]) for r in odd_rows)


def brute_mcd(xs, rules):
    """Concentration steps on the rows of one group; distances are cut at the bin that holds the support."""
    x = np.array(xs)
    mean, inverse = np.sort(x, axis=0)[(len(x) - 1) // 2], np.eye(x.shape[1])
    for step in range(rules.steps + 1):
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        if step == rules.steps:
            return d
        bins = np.floor(np.log2(d + 2.0**-20) * 16)
        near = x[bins <= np.sort(bins)[int(np.ceil(rules.support * len(x))) - 1]]
        cov = np.cov(near.T, bias=True) * quality.consistency(x.shape[1], rules.support)
        mean = near.mean(axis=0)
        inverse = np.linalg.inv(cov + np.diag(np.maximum(0, 1 - np.diag(cov))))


def test_outliers_against_numpy(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(50, 400)), "en", "a" if i % 3 else "b", 0) for i in range(240)]
    rows += [(500 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "a", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rules = quality.Rules()
    got = {r.doc_id: r for r in quality.quality_rules(docs, rules).collect()}
    for source in "ab":
        part = [r for r in rows if r[3] == source]
        xs = []
        for r in part:
            n, chars, symbols, dup, repeat, lines = brute_counts(r[1])
            values = (np.log(n), np.log(chars / n), symbols / chars, dup / lines, repeat / n)
            xs.append([v / f for v, f in zip(values, rules.floors)])
        for r, d in zip(part, brute_mcd(xs, rules)):
            assert got[r[0]].distance == pytest.approx(d, rel=1e-3, abs=1e-3)
    assert not any(got[500 + i].kept for i in range(20))
    assert all(got[i].kept for i in range(240))


def test_consistency_of_normal_rows():
    x = np.random.default_rng(1).normal(size=(200_000, 5))
    d = (x * x).sum(axis=1)
    for support in (0.55, 0.75):
        near = x[d <= np.quantile(d, support)]
        assert quality.consistency(5, support) * near.var(axis=0).mean() == pytest.approx(1, rel=0.02)


@pytest.mark.parametrize("share", [0.3, 0.4])
def test_much_junk_is_rejected(spark, share):
    """A third and two fifths of a source are junk of one kind; clean prose stays."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(100, 360)), "en", "a", 0) for i in range(400)]
    junk = int(400 * share / (1 - share))
    rows += [(1000 + i, " ".join(w + "#&" for w in prose(rng, rng.randint(100, 360)).split()), "en", "a", 0) for i in range(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    assert kept == set(range(400))


# 3: BPE


def test_bpe_like_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    vocabulary, library = bpe.Vocabulary(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "ab  \n\t\r'stdell.,!0123é日本\U0001f600​\x1c\x85\xa0　́\xdfЖ\xb2Ⅷ\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", "a" * 3001, "<|endoftext|><|endoftext|>x <|endoftext|", " " * 999 + "a", "it's we'LL I'm they're"]
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary.token_bytes)
    got = [encoder.encode(texts[i : i + 700]) for i in range(0, len(texts), 700)]
    ids = [x for part in got for x in part.to_pylist()]
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x for part in got for x in decoder.decode(part).to_pylist()] == texts
    import pyarrow as pa

    junk = [[rng.randrange(50257) for _ in range(rng.randint(0, 6))] for _ in range(2000)]
    assert decoder.decode(pa.array(junk, pa.list_(pa.int32()))).to_pylist() == library.decode_batch(junk, skip_special_tokens=False)


def test_bpe_digests(spark, odd, odd_rows):
    rows = queries.digests(bpe.decode(bpe.encode(odd, bpe.default_path()), bpe.default_path(), text="decoded")).collect()
    texts = collections.Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in odd_rows)
    assert collections.Counter(r.decoded_sha256 for r in rows) == texts


# 4: HTML


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article>x<br>y &amp;&nbsp;z</article>", "x y & z"),
    ("<nav><a>Menu</a></nav><article><h1>Title</h1><p>To.</p><p>A long paragraph of prose.</article><footer>foot</footer>", "Title\nTo.\nA long paragraph of prose."),
    ("<div class='cookie-notice'>We use</div><main><p>Body</p><form>Mail</form><section id=comments>Nice</section></main>", "Body"),
    ("<div class=ad>never closed <article><p>hey", "hey"),
    ("<div class='site-header'>Site</div><article><div class=article-header><h1>T</h1></div><p>Some text.</p></article>"
     "<section id=comments><article><p>Nice one, thanks a lot for it.</p></article></section>"
     "<article class='comment'><p>And another one of these.</p></article>", "T\nSome text."), ("<script>var t = '</p>';</script><style>p{}</style>", ""),
    ("<body><div id='sidebar'>links</div><h1>T</h1><p>Enough words to stand out here.</p></body>", "T\nEnough words to stand out here."),
])
def test_html(page, text):
    assert html.main_text(page) == text


STORY = "<h1>T</h1>" + "<p>A paragraph of the story with enough words to stand out.</p>" * 4
STORY_TEXT = "\n".join(["T"] + ["A paragraph of the story with enough words to stand out."] * 4)


@pytest.mark.parametrize("page, text", [
    (f"<body><div class='with-sidebar'>{STORY}</div></body>", STORY_TEXT),
    (f"<body><div id='no-sidebar'>{STORY}</div></body>", STORY_TEXT),
    (f"<body><div class='sidebar-layout'>{STORY}<div class=ad>Buy this.</div></div></body>", STORY_TEXT),
    (f"<body><div class='comments-open'>{STORY}<div id=comments><p>Nice one, thanks.</p></div></div></body>", STORY_TEXT),
    (f"<div class='story'>{STORY}</div><article class='teaser'><p>An ordinary paragraph about some other story.</p></article>", STORY_TEXT),
    (f"<div>{STORY}</div><div id=comments>{'<p>I have read this and have very much more to say about it.</p>' * 9}</div>", STORY_TEXT),
])
def test_html_by_mass(page, text):
    assert html.main_text(page) == text


PROSE = "This paragraph is long enough to be the content of a page and says one thing after another."


@pytest.mark.parametrize("page, text", [
    ("<article><p>He read the <span class=notice>notice</span> on the door and <b class=ad>went</b> on his long way home.</p></article>",
     "He read the notice on the door and went on his long way home."),
    (f"<article><p>{PROSE}</p><div class=related-work><p>{PROSE} So does this.</p></div></article>", f"{PROSE}\n{PROSE} So does this."),
    (f"<article><p>{PROSE}</p><div class=share-price><p>{PROSE} Up.</p></div></article>", f"{PROSE}\n{PROSE} Up."),
    (f"<article><p>{PROSE}</p><ul class=menu-items><li>{PROSE} Soup.</li></ul></article>", f"{PROSE}\n{PROSE} Soup."),
    # the same name over links, where the ratio is low
    (f"<article><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><ul class=menu-items>" + "<li><a><i>x</i></a></li>" * 12 + "</ul></article>", "\n".join([PROSE] * 3)),
    # names that say nothing else bar prose too
    (f"<article><p>{PROSE}</p><div class='related-posts'><p>{PROSE} Elsewhere.</p></div><p>{PROSE} End.</p></article>", f"{PROSE}\n{PROSE} End."),
    (f"<article><p>{PROSE}</p><p>{PROSE}</p><div class='reader-comments-archive'><p>{PROSE} Me too.</p></div></article>", f"{PROSE}\n{PROSE}"),
    (f"<body><title>Title</title><p>{PROSE}</p></body>", PROSE),
])
def test_html_names_and_ratios(page, text):
    assert html.main_text(page) == text


def test_html_time_is_linear():
    """Unmatched end tags in deep pages: a second for 100,000 of them."""
    started = time.perf_counter()
    assert html.main_text("<div>" * 4000 + "</b></i></span>" * 100_000 + PROSE) == PROSE
    assert time.perf_counter() - started < 10


def test_html_of_long_pages():
    assert len(html.main_text("<" * 30000)) == 30000
    assert html.main_text("<div>" * 9000 + "x") == "x"


# 5: lines


def test_lines(spark, con):
    differences_ = differences(queries.QUERIES["op5_line_dedup"](spark, "/root/testdata/sf0.001"), con, queries.CHECKS["op5_line_dedup"])
    assert differences_ is None


def test_lines_by_hand(spark):
    rows = [(2, "z\na\nb\n\nc\nd\nq"), (1, "a\nb\nc\nd"), (3, "a\nb"), (1, "a\nb\nc\nd"), (None, "m\nn\no\nm\nn\no")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r.doc_id or 0, r.text, r.n_removed) for r in got)
    assert texts == [(0, "m\nn\no", 3), (1, "a\nb\nc\nd", 0), (1, "a\nb\nc\nd", 0), (2, "z\n\nq", 4), (3, "a\nb", 0)]


# 6: shards


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards(odd, odd_rows, shards):
    rows = sharding.assign(odd, shards).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) == (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(odd_rows)


def test_rows_stay_in_their_own_shard(spark):
    """Only what is above a shard's share moves on."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    arc_of, orders = sharding.ring(8)
    slot = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 64 - sharding.SLOT_BITS).cast("int")
    own = F.get(F.lit([o[0] for o in orders]), F.get(F.lit(arc_of), slot))
    rows = sharding.assign(docs).withColumn("own", own).collect()
    loads = collections.Counter(r.own for r in rows)
    assert sum(r.own != r.shard for r in rows) == sum(max(0, n - 500) for n in loads.values())


# 7: personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            out += [(kind, m.start(), m.end())] if good else []
    return out


def test_base_spans(spark, odd, odd_rows):
    rng = random.Random(4)
    more = [(1000 + i, "".join(rng.choice("ab@.-_ +01259()é\n") for _ in range(80))) for i in range(300)]
    more += [(2000, "1" * 5000), (2001, "a" * 5000 + "@b.c"), (2002, "+" + "1 " * 4000), (2003, "a.b@c.d " * 700), (2004, "1.2.3." * 900)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = collections.Counter()
    for r in pii.by_document(docs, pii.pii_spans(docs)).collect():
        got[(r.doc_id, tuple((s.kind, s.start, s.end) for s in r._spans if s.base))] += 1
    assert got == collections.Counter((i, tuple(brute_spans(t))) for i, t in [*((r[0], r[1]) for r in odd_rows), *more])


def test_model_adds_what_looks_validated(spark):
    """Emails whose host the base pattern misses stand where validated ones do; look-alikes without an address do not."""
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 5)} mail {word(rng)}@{word(rng)}.org. {prose(rng, 5)}") for i in range(400)]
    rows += [(1000 + i, f"{prose(rng, 5)} 12@@34 x@ {prose(rng, 5)}") for i in range(200)]
    rows += [(2000, "please mail bob@café.org. thanks a lot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.pii_spans(docs)
    assert spans.filter("base").count() == 400
    added = spans.filter("not base").count()
    assert added <= 3 and spans.select("kind").distinct().count() == 1


def test_model_finds_what_the_checks_miss(spark):
    """Planted national phones, spelled-out mails, cards with a wrong digit and IPv6 addresses among validated spans and look-alikes."""
    rng = random.Random(16)

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(good):
        digits = number(15)
        return next(digits + c for c in "0123456789" if luhn(digits + c) == good)

    good = {
        "phone": lambda: f"call +49 ({number(3)}) {number(3)}-{number(4)}", "email": lambda: f"mail {word(rng)}.{word(rng)}@{word(rng)}.org",
        "card": lambda: f"card {card(True)}", "ip": lambda: f"host {'.'.join(str(rng.randint(1, 255)) for _ in range(4))}",
    }
    planted = {
        "phone": lambda: f"call 030 {number(3)} {number(4)}", "email": lambda: f"mail {word(rng)} at {word(rng)} dot org",
        "card": lambda: f"card {card(False)}", "ip": lambda: "host " + ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)),
    }
    junk = [
        lambda: f"order {number(4)}-{number(6)}", lambda: "12@@34", lambda: f"@{word(rng)}", lambda: f"isbn 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: "x" + number(9) + "x", lambda: "0000000000",
    ]
    rows, want = [], []
    for kind in good:
        rows += [(len(rows) + i, f"{prose(rng, 4)} {good[kind]()} {prose(rng, 4)}") for i in range(200)]
        for _ in range(40):
            head, what = prose(rng, 4), planted[kind]()
            start = len(head) + 1 + what.index(" ") + 1
            want.append((len(rows), kind, start, len(head) + 1 + len(what)))
            rows.append((len(rows), f"{head} {what} {prose(rng, 4)}"))
    first_junk = len(rows)
    rows += [(first_junk + i, f"{prose(rng, 4)} {junk[i % len(junk)]()} {prose(rng, 4)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {(r.doc_id, s.kind, s.start, s.end) for r in pii.by_document(docs, pii.pii_spans(docs)).collect() for s in r._spans if not s.base}
    assert len(added & set(want)) >= 0.8 * len(want)
    assert len(added - set(want)) <= 0.05 * len(added)


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a b@c.de, 1.2.3.4 z"), (2, None), (3, "none")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in pii.redact(docs, pii.pii_spans(docs)).collect()) == [(1, "a [EMAIL], [IP] z"), (2, None), (3, "none")]


def test_wanted_texts_are_shuffled_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(minhash, "full_sets", lambda texts, size: made.append(texts) or texts.withColumn("shingles", F.array(F.lit(1).cast("long"))))
    docs = spark.createDataFrame([(i % 30, f"some words of text {i % 30}") for i in range(60)], "doc_id long, text string")
    classes = minhash.gathered(minhash.pin(minhash.sketches(docs, 3)))
    sets = minhash.sets_of(docs, classes, classes.select("class"), 3)
    assert sets.count() == classes.count() == 30  # of equal rows one
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the sides of the join


def test_pii_trees_learn_from_all_candidates(spark, monkeypatch):
    learnt = []

    class Recorder(pii.GBTClassifier):
        def fit(self, rows):
            learnt.append(rows.agg(F.sum("_n") if "_n" in rows.columns else F.count("*")).first()[0])
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Recorder)
    n = 24_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, concat('mail a', id, '@b.org now'), concat('nr ', 1000000000 + id)) as text")
    assert pii.pii_spans(docs).filter("base").count() == n // 2
    wide = pii.found_spans(docs).filter("not base").count()
    assert wide >= n and abs(learnt[0] / wide - 0.7) < 0.02


# 8: mixing


def brute_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [3, 1, 2] * len(sizes)))
    total, targets, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(targets.values())
        each = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if each[s] > 2 * sizes[s]]
        if not over:
            return targets | each
        targets |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)


def test_mixing(odd, odd_rows):
    sizes = collections.Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    rows = mixing.plan_mix(odd).collect()
    targets = brute_targets(dict(sizes))
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
    assert mixing.mix(odd).count() == sum(r.copies for r in rows)
    assert mixing.mix(odd).columns == odd.columns


# 9: passages


def brute_covered(docs, n):
    seen = collections.defaultdict(set)
    for key, w in docs.items():
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add((key, i))
    covered = collections.defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for key, i in places:
                covered[key].update(range(i, i + n))
    return {k: v for k, v in covered.items() if v}


def test_passages(spark):
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (49, 50, 55, 120)]
    texts = [f"{prose(rng, rng.randint(0, 60))} {rng.choice(shared)} {prose(rng, rng.randint(0, 60))}" for _ in range(40)]
    texts += [prose(rng, 200) for _ in range(20)] + [texts[0], None, "", "a b", " ".join(texts[1].split()[5:]), shared[3][:-1]]
    docs = {i: (t or "").split() for i, t in enumerate(texts)}
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start, r.end))
    assert dict(got) == brute_covered(docs, 50)


def test_passages_that_end_in_a_frequent_phrase(spark):
    rng = random.Random(42)
    phrase = prose(rng, 30)
    lead = [prose(rng, 20) for _ in range(30)]  # of 21 no suffix of their own is kept in both texts
    texts = [f"{prose(rng, 40)} {phrase} {prose(rng, 40)}" for _ in range(200)]
    texts += [f"{prose(rng, 40)} {words} {phrase} {prose(rng, 40)}" for words in lead for _ in range(2)]
    docs = {i: t.split() for i, t in enumerate(texts)}
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start, r.end))
    assert dict(got) == brute_covered(docs, 50)


def test_repeated_rows_are_no_repeat(spark):
    text = prose(random.Random(9), 80)
    rows = [(1, text), (1, text), (2, prose(random.Random(10), 80))]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


# 10: near duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(40, 120)).split() for _ in range(30)]
    texts = [None, "", "  ", "One", "one", "one two", "ONE  two", "É a", "é a"]
    for _ in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word(rng)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_components(rows, size, percent)


def test_links_within_a_crowd(spark):
    """1,000 look-alikes just below the threshold, 40 pairs of them above it."""
    rng = random.Random(21)
    core = [f"c{i}" for i in range(240)]
    texts, pairs = [], {}
    for i in range(1000):
        own = [f"u{i}x{j}" for j in range(28)]
        texts.append(" ".join(core + own))
        if i < 40:
            texts.append(" ".join(core + own[:10] + [f"v{i}x{j}" for j in range(18)]))
            pairs[len(texts) - 1] = len(texts) - 2
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(i, texts[i]) for i in order]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()
    assert {r.doc_id: r.component_id for r in found if not r.kept} == pairs


@pytest.mark.parametrize("filter_bits, buckets", [(1 << 25, 1 << 20), (64 * 8, 64)])
def test_links_within_a_crowd_of_several_templates(spark, monkeypatch, filter_bits, buckets):
    """3,000 look-alikes: most in one component, others of a second template, all of one crowd; whatever the tables' sizes."""
    monkeypatch.setattr(minhash, "FILTER_BITS", filter_bits)
    monkeypatch.setattr(minhash, "BUCKETS", buckets)
    rng = random.Random(22)
    core, other = [f"c{i}" for i in range(200)], [f"d{i}" for i in range(40)]
    texts = []
    for i in range(1500):  # near copies of one text: one component
        texts.append(core + other[: 40 - i % 3] + [f"n{i}x{j}" for j in range(i % 3)])
    for i in range(1400):  # look-alikes of the core, no two similar but for 50 pairs
        own = [f"u{i}x{j}" for j in range(40)]
        texts.append(core[:195] + own)
        if i < 50:
            texts.append(core[:195] + own[:22] + [f"v{i}x{j}" for j in range(18)])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()
    sizes = collections.Counter(r.component_id for r in found)
    # an element that a tenth of two sets' unions keeps apart: what all pairs say
    assert sorted(sizes.values(), reverse=True)[:52] == [1500, *[2] * 50, 1]


def test_one_row_of_a_group_stays(spark):
    """Null ids, repeated rows, one id with several texts."""
    rng = random.Random(23)
    one, two = prose(rng, 90), prose(rng, 90)
    near = one.rsplit(" ", 1)[0] + " else"
    layout = "doc_id long, text string, source string, m map<string,int>"
    rows = [(None, one, "a", {"k": 1}), (None, one, "b", None), (None, one, None, None), (None, near, "a", None), (None, two, "x", None)]
    rows += [(None, None, "e", None), (None, "", "e", None), (4, " ", "e", None), (4, " ", "e", None)]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, layout)).collect()
    assert sorted(str(r.source) for r in kept if r.text and r.text.strip()) in (["a", "x"], ["b", "x"], ["None", "x"]) and len(kept) == 6
    rows = [(7, one, "a", {"k": 2})] * 3 + [(7, near, "b", None), (9, one, "c", None), (None, one, "d", None), (3, two, "x", None), (3, two, "x", None)]
    for n in (1, 4):
        kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, layout).repartition(n)).collect()
        assert sorted(r.doc_id for r in kept) == [3, 7]


def test_components(spark):
    rng = random.Random(12)
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [(f"s{0:04d}", f"s{i:04d}") for i in range(1, 50)]
    edges += [("p", "p"), ("q", "r"), ("r", "q")]
    rng.shuffle(edges)
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({roots[f"{i:04d}"] for i in range(61)}) == 1 and len({roots[f"s{i:04d}"] for i in range(50)}) == 1
    assert len(set(roots.values())) == 3 and roots["q"] == roots["r"]

"""Each operator against a brute-force version, on a small table of awkward rows and on the small test tables."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import common, html, language, line_dedup, media, mixing, ngram_join, packing, quality, registry, sharding, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, token int, rank int, mark string, host string, _keep string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120)
    rows = [(1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, "   \n\t"), (7, "one two"), (8, "One TWO"), (9, "\n".join(["same line"] * 40))]
    for i in range(10, 40):  # near copies of one text
        w = base.split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, text(r.randint(1, 200)) + "\nShared Line\n" + text(5)) for i in range(40, 70)]
    rows += [(70, text(40_000)), (71, "x" * 100_000), (72, "a  b\x0bc\x0cd\r\ne\x1cf 　g\x85h"), (None, base), (None, None), (73, "日本語 テスト привет мир " * 8)]
    out = []
    for k, (i, t) in enumerate(rows):
        source = None if k % 11 == 3 else "hot" if k % 3 == 0 else f"s{k % 5}"
        out.append((i, t, None if k % 7 == 2 else ("en", "fr")[k % 2], source, None if t is None else len(t), k, "c", 1, 2, "m", "h", "k"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return common.checkpointed(spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(t):
    return WORD.findall(t or "")


# 1


def stats(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_figures(docs):
    got = Counter((r.doc_id, *(r[k] for k in quality.STATS), r.base_failed) for r in quality.quality_rules(docs).collect())
    want = Counter((i, *(s := stats(t)), s[0] < 20 or 100 * s[4] > 30 * s[0]) for i, t in texts(docs))
    assert got == want


def test_quality_host_verdict(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short text"
    rows = [(i, good, "a") for i in range(50)] + [(50 + i, bad if i else good, "b") for i in range(40)] + [(100 + i, good, f"g{i % 9}") for i in range(90)] + [(200, good, None), (201, good, "tiny"), (202, bad, "lone")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[50] and not got[51] and got[0] and got[100] and got[200] and got[201] and not got[202]


# 2


def test_script_ranges_and_viterbi():
    assert language.scripts_of("abc") == 1 and language.scripts_of("привет") == 1 << language.NAMES.index("cyrillic") and language.scripts_of("") == 0
    r = np.random.default_rng(1)
    lengths = np.array([5, 1, 7, 3])
    scores = r.normal(size=(16, 3)).astype(np.float32)
    got, at = language.viterbi(scores, lengths, 0.7), 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert value(got[at : at + n]) == pytest.approx(best, abs=1e-4)
        at += n


def test_language_held_out_and_spans(spark, real):
    model = language.train(real)
    out = language.identified(real, model).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and len(out) > 100
    a, b = (next(t for i, t in texts(real.where(F.col("lang") == x)) if t.count(" ") > 60) for x in ("en", "de"))
    mixed = " ".join(a.split()[:60] + b.split()[:60])
    (row,) = language.identified(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert [s.lang for s in row.spans] == ["en", "de"] and 0.3 < row.score < 0.8


def test_language_awkward(docs, none):
    out = language.identified(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (4, 5, 6)} == {"und"}
    assert all(r.lang_pred in ("en", "fr", "und") for r in out)
    assert language.identified(none).count() == 0
    assert {r.lang_pred for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_all(spark):
    r = random.Random(9)
    words = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)] for i in range(300)}
    rows = [(8 * i + k, " ".join(r.choices(w, k=20)), lang) for i, (lang, w) in enumerate(words.items()) for k in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language.train(table)
    assert set(model.languages) == set(words)
    got = {x.doc_id: x.lang_pred for x in language.identified(table, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.99


def test_marks_and_ascii_narrowing():
    assert language.cleaned("हिन्दी में 12 ²x_ýz don't") == "हिन्दी में x ýz don t".replace("ý", "ý")
    assert [language.scripts_of(c) for c in "ଓසཀ"] == [1 << language.NAMES.index(n) for n in ("oriya", "sinhala", "tibetan")]
    n = 1 << language.BUCKET_BITS
    flat = np.zeros((n, 3), np.float32)
    latin, greek = (1 << language.NAMES.index(x) for x in ("latin", "greek"))
    m = language.Model(["de", "el", "en"], flat, flat, {latin: np.array([True, False, True]), greek: np.array([False, True, False]), 0: np.ones(3, bool)})
    scores, _ = m.words("plain λόγος")
    assert (scores[0] < -1e3).tolist() == [False, True, False] and (scores[1] < -1e3).tolist() == [True, False, True]


def test_long_texts_in_parts(monkeypatch):
    r = np.random.default_rng(2)
    n = 1 << language.BUCKET_BITS
    m = language.Model(list("abc"), r.normal(size=(n, 3)).astype(np.float32), r.normal(size=(n, 3)).astype(np.float32), {0: np.ones(3, bool)})
    letters = random.Random(5)
    text = " ".join("".join(letters.choice("abcdefgé") for _ in range(letters.randint(1, 7))) for _ in range(3000))
    scores, count = m.words(text)
    whole = language.viterbi(scores, np.array([len(scores)]), 3.0)
    monkeypatch.setattr(language, "LONG_PART", 700)
    got, own = m.labels(text, 3.0)
    assert (got == whole).all() and (own == count).all() and len(set(whole.tolist())) == 3


def test_viterbi_many_labels():
    scores = np.zeros((3, 700), np.float32)
    scores[[0, 1, 2], [650, 300, 299]] = 9
    assert language.viterbi(scores, np.array([2, 1]), 1.0).tolist() == [650, 300, 299]


# 3


def test_folding():
    assert toxicity.folded("1D10T") == toxicity.folded("idiot") == toxicity.folded("іԁiоt") == toxicity.folded("ÍDÏÖT!!") == toxicity.folded("id​iot")
    assert toxicity.folded(" x--y_z ") == " x y z "
    for text in ("ⓘdiot", "𝐢𝐝𝐢𝐨𝐭", "𝓘𝓓𝓘𝓞𝓣", "🄸🄳🄸🄾🅃", "ᎥᎠᎥoᎢ", "ⁱdiot", "ＩＤＩＯＴ", "𝟏𝐝𝟏𝟎𝐭", "ⅰⅾiot", "ⅠⅮⅠOT"):
        assert toxicity.folded(text) == toxicity.folded("idiot"), text
    assert toxicity.folded("№ ½ 日本 ω") == toxicity.folded("½ 日本 w")


def test_exceptions_and_length():
    m = toxicity.Model({" bad": 2.0, " bad b": 1.0}, [" not bad"], np.zeros(4))
    a = m.automaton()
    assert toxicity.hits(" bad boy ", a) == (2.0, 1) and toxicity.hits(" not bad ", a) == (0.0, 0) and toxicity.hits(" embad ", a) == (0.0, 0)
    assert toxicity.features(" bad ", a)[2] > toxicity.features(" bad" + " word" * 50 + " ", a)[2]


def test_toxic_terms_explain_labels():
    # term 0 marks the toxic, 1 always stands by it but also in clean texts, 2 is everywhere, 3 marks others
    y = [1] * 40 + [1] * 20 + [0] * 100
    terms = [[0, 1, 2]] * 40 + [[2, 3]] * 20 + [[1, 2]] * 20 + [[2]] * 79 + [[]]
    assert toxicity.explaining(y, terms, 4) == [0, 3]
    assert toxicity.explaining([], [], 0) == toxicity.explaining([1, 0], [[], []], 3) == []


def test_penalty_from_folds():
    r = random.Random(1)
    y = [int(i % 4 == 0) for i in range(400)]
    terms = [sorted({0} * v | {r.randrange(1, 60) for _ in range(2)}) if False else sorted(({0} if v else set()) | {r.randrange(1, 60) for _ in range(2)}) for v in y]
    penalty = toxicity.chosen_penalty(y, terms, [1 + i % 3 for i in range(400)], 60)
    assert penalty in toxicity.PENALTIES and toxicity.explaining(y, terms, 60, penalty)[0] == 0
    assert toxicity.chosen_penalty([1], [[]], [1], 3) == max(toxicity.PENALTIES)


@pytest.mark.parametrize("seed", range(6))
def test_hits_by_brute_force(seed):
    """Matches of the automaton, one for each place with the heaviest term, outside of any exception phrase."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    m = toxicity.Model({" " + word(): r.random() for _ in range(8)}, [f" {word()} {word()}" for _ in range(6)], np.array([-1.0, 0.5, 0.7, 0.3]))
    for _ in range(60):
        text = f" {' '.join(word() for _ in range(r.randint(0, 30)))} "
        spared = {p for phrase in m.exceptions for a in range(len(text)) if text.startswith(phrase, a) for p in range(a, a + len(phrase))}
        at = {a: max(w for t, w in m.terms.items() if text.startswith(t, a)) for a in range(len(text)) if any(text.startswith(t, a) for t in m.terms)}
        at = {a: w for a, w in at.items() if a not in spared}
        total, n = toxicity.hits(text, m.automaton())
        assert n == len(at) and total == pytest.approx(sum(at.values()))
        x = toxicity.features(text, m.automaton())
        words_ = len(text.split())
        assert x == pytest.approx([1, math.log1p(total), math.log1p(100 * total / (words_ + 20)), float(n > 0)])


def test_toxic_term_density():
    found = toxicity.term_density("harmless " * 400 + "badword " + "stemmed stemming stems")
    assert found[" bad" + "w"] is False and found[" stem"] is True and found[" stemm"] is False


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.scored(d, toxicity.train(d, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert sum(r.predicted for r in out if r.toxic) > 0.8 * sum(r.toxic for r in out)
    assert sum(r.predicted for r in out if not r.toxic) < 0.01 * len(out)


def test_toxicity_awkward(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (2, None, 0), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert toxicity.scored(none, toxicity.train(none, labels.limit(0))).count() == 0


# 4


def test_encoder_is_the_tokenizers_own(real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    own = packing.encoder(packing.default_tokenizer())
    cases = [x for _, x in texts(real.limit(100))] + ["", " ", "a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n<|endoftext| >", " <|endoftext|> " * 500, "12３ ½", "é \U0001F600\x00", "\n\n  x  \n", " " * 999]
    assert all(own(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in cases)


def check_packed(rows, source):
    own = packing.encoder(packing.default_tokenizer())
    ids = {t: np.append(own(t), np.uint32(0)).astype("<u4") for t in set(source.values())}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        own_ids = ids[source[r.doc_id]]
        assert r.doc_tokens == len(own_ids) and zlib.crc32(own_ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert sorted(seqs) == list(range(len(seqs)))
    return by, seqs


def test_encoder_long_runs():
    """Texts on which the pattern would step back over a run of white space, and texts of many parts, as the library does them."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, library = packing.encoder(path), Tokenizer.from_file(path)
    r = random.Random(1)
    cases = [c * 2_000_000 for c in " \na"] + ["x" + " " * 5000 + "y z", "x" + "\n" * 5000 + " y", " " * 4096, " " * 4097 + "a", "ab\u3000" * 3000 + "\u3000" * 5000 + "c", "a" + "\t " * 4000 + "\x1c b", "\x1c" * 9000 + "x", "it's 12 words. " * 60_000]
    cases += ["".join(r.choice(["a", "b", " ", "  ", "\n", " " * 4100, "'s", "1", "é", "\u3000", "\x85", "!", "\x1f", "\u200b"]) for _ in range(400)) for _ in range(20)]
    for text in cases:
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_hashed_words_of_long_texts(monkeypatch):
    r = random.Random(2)
    texts_ = [" ".join(r.choice(["a", "bb", "ccc é", "\n", "x" * 300]) for _ in range(r.randrange(200))).encode() for _ in range(50)] + [b"", b"  ", b"z" * 5000]
    whole = common.hashed_words(texts_)
    assert whole[1].tolist() == [len(t.split()) for t in texts_]
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, common.hashed_words(texts_)))


def test_arrow_batches_are_cut_by_bytes(spark):
    df = spark.range(3000).select(F.lit("x" * 10_000).alias("text"))
    sizes = common.in_arrow(df, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 10 and max(r.n for r in sizes) < 2 * common.ARROW_BYTES


def test_packing_round_trip(real):
    rows = packing.packed(real).collect()
    source = dict(texts(real))
    by, seqs = check_packed(rows, source)
    assert all(sum(r.length for r in by[i]) == by[i][0].doc_tokens for i in source)
    assert sum(r.length for r in rows) / (1024 * len(seqs)) > 0.98


def test_packing_awkward(spark, docs, none):
    rows = packing.packed(docs.where("doc_id IS NOT NULL")).collect()
    check_packed(rows, {i: t or "" for i, t in texts(docs) if i is not None})
    assert sum(r.doc_id == 2 and r.start == 0 for r in rows) == 2
    assert packing.packed(docs).where("doc_id IS NULL").agg(F.sum("length")).first()[0] == sum(len(packing.encoder(packing.default_tokenizer())(t or "")) + 1 for i, t in texts(docs) if i is None)
    assert packing.packed(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_shortest_pack_first(seed):
    r = random.Random(seed)
    h = Counter(r.randint(1, 1024 if seed % 2 else 90) for _ in range(r.randint(1, 3000)))
    patterns = packing.shortest_pack_first(h)
    placed = Counter()
    for p, n in patterns:
        assert sum(s * k for s, k in p) <= 1024 and n > 0
        for s, k in p:
            placed[s] += k * n
    assert placed == h
    slots = packing.Slots(patterns)
    assert len({(int(a), int(b)) for s in h for a, b in zip(*slots.place(s, np.arange(h[s])))}) == sum(h.values())


# 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href=/x>Menu</a></nav>
<div class="cookie-notice">Cookies</div><div class="post-12 body"><h1>Head &amp; line</h1><p>First <b>bold
 text</b>&nbsp;here.<p>Second &#233; <a href="/l">link</a> text<br>more<form><input>Form</form></p><div class="ad slot-3">Buy</div><p hidden>no</p></div>
<div id="comments"><p>Great article</p></div><aside>Side</aside><footer>&copy; f</footer></body></html>"""


def own_text(page):
    found = html.read(page)
    good = html.own_article(found)
    return "\n".join(t for e, t in found if id(e) in good)


def test_html_page():
    assert own_text(PAGE) == "Head & line\nFirst bold text here.\nSecond é link text more"
    found = html.read(PAGE)
    good = html.own_article(found)
    assert {">".join([x.name for x in html.ancestors(e)][::-1]) for e, _ in found if id(e) in good} == {">html>body>div.body.post-"}


def test_html_consensus(spark, none):
    long = "<p>" + "word " * 80 + "</p>"
    page = lambda body: f"<html><body><div class='teaser'>{body[0]}</div><div class='main'>{body[1]}</div></body></html>"
    rows = [(i, "http://h/a", page(("<p>t</p>", long)), 1) for i in range(9)] + [(9, "http://h/b", page((long, "<p>the article</p>")), 1), (10, None, page((long, "<p>s</p>")), 1), (11, "http://h/c", None, 1), (12, "x", "", 1), (13, "http://q/", "plain &lt; text", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, paths int")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    assert got[9] == "the article" and got[10].startswith("word") and got[11] == got[12] == "" and got[13] == "plain < text" and len(got) == 14
    assert html.extracted(pages.limit(0)).count() == 0


def test_html_articles_of_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    import html as entities

    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_html_classes_of_articles():
    assert own_text("<body class='no-sidebar'><main class='share'><p>text</p><div id=top-nav>n</div></main></body>") == "text"
    assert own_text("<body><div class='share-story'><p>some text here</p></div></body>") == "some text here"  # no other container


@pytest.mark.parametrize(
    "page",
    ["<", "<div", "<div class='x", "<!-- open", "</div></div>text", "<p>a<p>b</b></i>c", "<script>x", '<a b="' + "<" * 500, "<div x='" * 300_000, '<a title="x ' * 300_000 + ">", "<a '\">\" " * 300_000, "<!" * 1_000_000, "<div>" * 100_000 + "a b" + "</div>" * 100_000,
     "<b>" * 50_000 + "<p>a b" * 50_000, "<ul><li>" * 50_000, "<div>" * 50_000 + "</span>" * 100_000, "<div " + "class " * 300_000 + ">a b", "<td><p>x y" * 100_000],
)
def test_html_broken_markup(page):
    began = time.time()
    own_text(page)
    assert time.time() - began < 8  # a quadratic reader takes minutes


def test_html_vote_decides(spark):
    """Boilerplate without a telling tag or class: the same text on a host's pages, and containers that most pages reject."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    page = lambda k: f"<html><body><div class=a><p>Sold by the yard since ever</p></div><div class=b><h1>{words(k, 3)}</h1><p>{words(k, 60)}</p></div><div class=c><p>{words(k + 100, 9)}</p></div></body></html>"
    short = lambda k: f"<html><body><div class=e><a href=/>{words(k, 5)}</a></div><div class=b><p>{words(k, 40)}</p></div></body></html>"
    odd = f"<html><body><div class=e>{words(7, 30)}</div><div class=b><p>{words(9, 40)}</p></div></body></html>"
    odder = f"<html><body><p>{words(8, 4)}</p><div class=e>{words(7, 30)}</div><div class=b><p>{words(9, 40)}</p></div></body></html>"
    rows = [(k, "http://h/", page(k)) for k in range(12)] + [(20 + k, "http://g/", short(k)) for k in range(8)] + [(30, "http://g/", odd), (31, "http://g/", odder)]
    rows += [(40, "http://alone/", page(40)), (41, None, odder)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    for k in range(12):
        assert got[k] == "\n".join([words(k, 3), words(k, 60), words(k + 100, 9)]) != own_text(page(k))
    assert got[31] == f"{words(8, 4)}\n{words(9, 40)}" != own_text(odder)  # the host's pages reject e
    assert got[30] == own_text(odd) and got[41] == own_text(odder) and got[40] == own_text(page(40))


TEASER = "<div class=teaser><p>Five words of a teaser</p></div>"
STORY = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "<div class=post><ul>{}</ul></div>", "<div class=post><section>{}</section></div>"])
@pytest.mark.parametrize("telling", ["<p class='notice'>We use cookies</p>", "<p class=ad>Buy this now</p>", "<li class='related'>Read this as well</li>", "<p id=newsletter>Sign up for mail</p>", "<figure class='promo'><p>Buy that now</p></figure>", "<h3 class='share'>Share this</h3>"])
def test_html_telling_block_goes_alone(shell, telling):
    body = f"<h2 id='advert-{1}'>Heading</h2><p>{STORY[0]}</p>{telling}<p>{STORY[1]} <span class=ad>x</span></p><ul><li>{STORY[2]}</ul>"
    page = f"<html><body><nav><a href=/>Home</a></nav>{shell.format(body)}<footer>f</footer></body></html>"
    assert own_text(page) == "\n".join(["Heading", STORY[0], STORY[1] + " x", STORY[2]])


def test_html_telling_block_goes_alone_over_a_host(spark):
    page = lambda k: f"<html><body>{TEASER}<article><h1>Title {k}</h1><p>{STORY[k % 3]} {k}</p><p class='notice'>Notice {k}</p></article></body></html>"
    plain = lambda k: f"<html><body><div class=post><h1 id=related-{k}>Title {k}</h1><p>{STORY[k % 3]} {k}</p><p class=ad>Ad {k}</p></div></body></html>"
    rows = [(k, "http://h/", page(k)) for k in range(10)] + [(20 + k, "http://g/", plain(k)) for k in range(10)] + [(40, "http://one/", page(0)), (41, "http://two/", plain(0))]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i % 20 % 10}\n{STORY[i % 20 % 10 % 3]} {i % 20 % 10}" if i < 40 else f"Title 0\n{STORY[0]} 0" for i, _, _ in rows}


def test_html_vote_counts_copies_once_for_repeats(spark):
    page = "<body><div class=a><p>one and the same article</p></div></body>"
    got = html.extracted(spark.createDataFrame([(k, "http://h/", page) for k in range(9)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"one and the same article"}


def test_html_keeps_whole_articles(spark):
    story = " ".join(["story"] * 80)
    split = f"<html><body><article><h1>Title</h1><p>lead</p><div class=story><p>{story}</p></div></article></body></html>"
    lead = f"<html><body><div class=page><p>lead</p><div class=story><p>{story}</p></div></div></body></html>"
    two = f"<html><body><ul><li><a href=/>Home page</a></ul><div class=a><p>{story}</p></div><div class=b><p>the shorter section</p></div></body></html>"
    minority = f"<html><body><div class=story><p>read more below</p></div><div class=essay><p>{story}</p></div></body></html>"
    plain = f"<html><body><div class=story><p>{story}</p></div></body></html>"
    rows = [(i, "http://a/", split) for i in range(5)] + [(i, "http://b/", lead) for i in range(5, 10)] + [(i, "http://c/", two) for i in range(10, 15)] + [(i, "http://d/", plain) for i in range(15, 75)] + [(75, "http://d/", minority)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == f"Title\nlead\n{story}" and got[5] == f"lead\n{story}" and got[15] == story
    assert got[10].endswith(f"{story}\nthe shorter section") and got[75] == f"read more below\n{story}"


# 6


def dedup(rows, at_least=10):
    key = lambda x: x.strip(common.SPACES).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    return lambda t: [x for x in (t or "").split("\n") if not (key(x) and len(seen[key(x)]) >= at_least)]


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_line_dedup(spark, docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = texts(docs)
        keep = dedup(rows)
        bitmaps = {(r.doc_id, r.tkey): r.keep for r in line_dedup.keep_bitmaps(docs).collect()}
        got = Counter((r.doc_id, r.text) for r in line_dedup.stage(spark, docs, "").collect())
        assert got == Counter((i, None if t is None else "\n".join(keep(t))) for i, t in rows)
        assert len(bitmaps) == len({(i, t) for i, t in rows if len(keep(t)) < len((t or "").split("\n"))})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup_keep_first(spark, docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        gone = {(r.doc_id, r.pos) for r in line_dedup.dropped_lines(d, keep_first=True).collect()}
        seen, want = set(), set()
        for i, t in sorted(texts(d)):
            for p, x in enumerate((t or "").split("\n")):
                k = x.strip(common.SPACES).lower() if x.isascii() else x.strip(common.SPACES)
                k = "".join(c.lower() if c.isascii() else c for c in x.strip(common.SPACES))
                if k and k in seen:
                    want.add((i, p))
                seen.add(k)
        assert gone == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


# 7


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and rows and mixing.mixed(none).count() == 0
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, free = {}, sum(size.values()), set(size)
    while True:  # stop what is above three times its size, share the rest anew
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    source = {(r.doc_id, len(words(r.text))): r.source for r in docs.collect()}
    longest, taken = Counter(), Counter()
    for r in mixing.mixed(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect():
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len(r.shards or []) == r.times
    for r in rows:
        s = next(k for k, v in size.items() if v == r.source_size and target[k] == pytest.approx(r.target))
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] + 1
    assert source
    assert sorted(map(tuple, mixing.mixed(docs.repartition(9)).drop("mark", "shards").collect()), key=str) == sorted(map(tuple, mixing.mixed(docs).drop("mark", "shards").collect()), key=str)


def quantile(total, marked, drawn, u):
    """Smallest x at which the hypergeometric distribution passes u, by whole numbers."""
    upto, every = 0, math.comb(total, drawn)
    for x in range(max(0, drawn - total + marked), min(drawn, marked) + 1):
        upto += math.comb(marked, x) * math.comb(total - marked, drawn - x)
        if upto > u * every:
            return x
    return min(drawn, marked)


def test_hypergeometric(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        total = r.choice([0, 1, 2, 5, 40, 700, 5000])
        rows.append((total, r.randint(0, total), r.randint(0, total), r.choice([0.0, r.random(), 1 - 2.0**-52])))
    got = spark.createDataFrame(rows, "a long, b long, c long, u double").select("*", mixing.hypergeometric(F.col("a"), F.col("b"), F.col("c"), F.col("u")).alias("x")).collect()
    for g in got:
        if 0 < g.u < 1 - 2.0**-50:
            assert g.x == quantile(g.a, g.b, g.c, Fraction(g.u)), g
        assert max(0, g.c - g.a + g.b) <= g.x <= min(g.b, g.c)


@pytest.mark.parametrize("fold", [1024, 3])
def test_split_tree_quotas(spark, monkeypatch, fold):
    monkeypatch.setattr(mixing, "FOLD", fold)
    start = {i: (i * 37) % 90 for i in range(1, 12)}
    draw = lambda *x: Fraction(int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:13], 16), 1 << 52)
    nodes = {0: dict(start)}
    for level in range(3):
        after = {}
        for node, q in nodes.items():
            folds = defaultdict(dict)
            for i, n in sorted(q.items()):
                if n:
                    folds[(i - 1) // fold][i] = n
            total = sum(q.values())
            left, x = total // 2, {}
            for f, own in sorted(folds.items()):
                whole = sum(own.values())
                take = quantile(total, whole, left, draw("fold", level, node, f))
                total, left = total - whole, left - take
                for i, n in sorted(own.items()):
                    x[i] = quantile(whole, n, take, draw("quota", level, node, i))
                    whole, take = whole - n, take - x[i]
            after[2 * node] = x
            after[2 * node + 1] = {i: q[i] - x[i] for i in x}
        nodes = after
    want = {(i, node): n for node, q in nodes.items() for i, n in q.items() if n}
    got = mixing.split_tree(spark.createDataFrame(list(start.items()), "i long, q long"), 3).collect()
    assert {(r.i, r.shard): r.q for r in got} == want and len(got) == len(want)
    per = Counter()
    for r in got:
        per[r.shard] += r.q
    assert max(per.values()) - min(per.values()) <= 3 and sum(per.values()) == sum(start.values())


def test_blocks_are_dealt_by_quota(spark):
    copies = [(i, b, c) for i in (1, 2, 5) for b in range(40 * i) for c in (1, 2)]
    df = spark.createDataFrame(copies, "i long, block int, copy int")
    got = mixing.dealt(df, 3).collect()
    quotas = {(r.i, r.shard): r.q for r in mixing.split_tree(df.groupBy("i").agg(F.count("*").alias("q")), 3).collect()}
    assert sorted((r.i, r.block, r.copy) for r in got) == copies and Counter((r.i, r.shard) for r in got) == quotas
    for i in (1, 2, 5):
        own = sorted((r for r in got if r.i == i), key=lambda r: hashlib.md5(f"deal:{i}:{r.block}:{r.copy}".encode()).hexdigest()[:13])
        assert [r.shard for r in own] == sorted(r.shard for r in own)


def test_running_sums(spark):
    rows = [(f"s{i:03}" if i else None, i * i % 17) for i in range(200)]
    got = common.running(spark.createDataFrame(rows, "s string, n long").repartition(5), ["s"], {"before": "n"}, 7).collect()
    n, upto = 0, 0
    for s, k in sorted(rows, key=lambda r: r[0] or ""):
        assert next((r.rank, r.before) for r in got if r.s == s) == (n, upto)
        n, upto = n + 1, upto + k


def marked(rows):
    """The size of all rows that share source, block and mark."""
    out = Counter()
    for source, block, size, mark in rows:
        out[source, block, mark] += size
    return out


def test_mixing_stage_takes_what_the_mix_takes(spark):
    rows = [(1, "three equal words", "a", "s", "p", 1)] * 300 + [(k, f"words of row {k}", "a", "s", "p", 1) for k in range(2, 200)] + [(k, "w " * 30, "b", "s", "p", 1) for k in range(200, 240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _shard string, _place string, times int").repartition(7)
    for blocks in (1, 4):
        m = mixing.mixed(df, blocks=blocks)
        per = {r.doc_id: r for r in m.groupBy("doc_id").agg(F.sum("times").alias("n"), F.count_distinct("times").alias("kinds")).collect()}
        assert all(r.kinds == 1 for r in per.values())
    per = Counter({r.doc_id: r.n for r in mixing.mixed(df).groupBy("doc_id").agg(F.sum("times").alias("n")).collect()})
    out = mixing.stage(spark, df, SF)
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == +per


def test_cut_block(spark):
    sizes = [(i * 7919) % 23 for i in range(3000)]
    rows = [(None if i % 3 == 0 else str(i % 3), i % 2, size, hashlib.md5(b"%d" % i).hexdigest()) for i, size in enumerate(sizes)]
    rows += rows[:50]
    whole = Counter()
    for source, block, size, _ in rows:
        whole[source, block] += size
    left = {k: [0, n // 3, n // 2, n - 1, 1, n // 7][i] for i, (k, n) in enumerate(sorted(whole.items(), key=str))}
    got = mixing.cut_block(spark.createDataFrame([(*r, left[r[:2]]) for r in rows], "source string, block int, size long, mark string, left long")).collect()
    want, upto = Counter(), Counter()
    for (source, block, mark), size in sorted(marked(rows).items(), key=lambda r: r[0][2]):
        before = upto[source, block]
        want[source, block, mark, 2 * before + size <= 2 * left[source, block]] += size
        upto[source, block] += size
    have = Counter()
    for r in got:
        have[r.source, r.block, r.mark, r.extra] += r.size
    assert len(got) == len(rows) and +have == +want


def test_mixing_shuffles_in_shards(spark, real):
    rows = mixing.placed(real).collect()
    place = defaultdict(list)
    for r in rows:
        place[r.doc_id].append((r["__kf_shard"], r["__kf_place"]))
    assert {r["__kf_shard"] for r in rows} == set(range(16)) and len({p for x in place.values() for p in x}) == len(rows)
    out = [r.doc_id for r in mixing.stage(spark, real, SF).collect()]
    assert out == [r.doc_id for r in sorted(rows, key=lambda r: (r["__kf_shard"], r["__kf_place"]))]
    assert sum(a == b for a, b in zip(out, out[1:])) < len(out) // 20


def test_mixing_plan_is_native(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 8


def test_hilbert_curve():
    cells = list(itertools.product(range(8), repeat=3))
    at = {sharding.hilbert_index(c, 3): c for c in cells}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(511))


def test_sharding(docs, none, real):
    for df in (docs, real):
        rows = sharding.sharded(df).collect()
        per = defaultdict(list)
        for r in rows:
            per[r.shard].append(r)
        n = df.count()
        assert len(rows) == n and set(per) <= set(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
        assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in per.values())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in texts(df))
        line = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in line] == sorted(r.curve for r in line)
    assert sharding.sharded(none).count() == 0


def test_curve_of_rows(docs, real):
    """The place of each text on the curve, from quantiles counted by hand."""
    for df in (docs, real):
        texts_ = defaultdict(list)
        for r in df.select("text", "source", "lang").collect():
            texts_[r.text or ""].append([(x is not None, x or "") for x in (r.source, r.lang)])
        groups = {t: (min(x[0] for x in rows), min(x[1] for x in rows), 8 + len(t.encode()), len(rows)) for t, rows in texts_.items()}
        total, most = sum(g[3] for g in groups.values()), 1 << sharding.BITS
        q = []
        for d in range(3):
            before, sums = 0, {}
            for value in sorted({g[d] for g in groups.values()}, key=lambda v: (v[0], v[1].encode()) if d < 2 else v):
                sums[value] = min(before * most // total, most - 1)
                before += sum(g[3] for g in groups.values() if g[d] == value)
            q.append(sums)
        want = Counter()
        for t, g in groups.items():
            want[zlib.crc32(t.encode()), g[2], sharding.hilbert_index(tuple(q[d][g[d]] for d in range(3)), sharding.BITS)] += g[3]
        got = sharding.sharded(df).collect()
        assert Counter((r.text_crc32, r.size, r.curve) for r in got) == want
        assert Counter((r.doc_id, r.source, r.lang) for r in got) == Counter((r.doc_id, r.source, r.lang) for r in df.select("doc_id", "source", "lang").collect())
    ranges = sharding.shard_ranges(sharding.sharded(real), ["source", "lang", "size"]).collect()
    assert len(ranges) == 24 and sum(r.n for r in ranges) == real.count() and all(r.low_size <= r.high_size for r in ranges)


def test_shards_prune(spark, real):
    """A filter on any one dimension leaves out most shards; shards by a hash of the id leave out none."""
    meta = real.select("doc_id", "lang", "source", F.octet_length("text").alias("bytes"))
    laid = sharding.sharded(real).select("doc_id", "shard").join(meta, "doc_id")
    hashed = meta.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(24)))

    def read(df, dim, share):
        """Mean share of shards that a filter on one value (or on the values between two near quantiles) reads."""
        ranges = sharding.shard_ranges(df, [dim]).collect()
        values = sorted(r[0] for r in meta.where(F.col(dim).isNotNull()).select(dim).collect())
        asked = [(values[int(len(values) * q)], values[min(len(values) - 1, int(len(values) * (q + share)))]) for q in np.arange(0.05, 0.95, 0.1)]
        return np.mean([sum(r[f"low_{dim}"] is not None and r[f"low_{dim}"] <= b and r[f"high_{dim}"] >= a for r in ranges) / len(ranges) for a, b in asked])

    assert sum(r.n for r in sharding.shard_ranges(laid, ["lang"]).collect()) == real.count()
    for dim in ("source", "lang", "bytes"):
        assert read(laid, dim, 0.0) < 0.75 * read(hashed, dim, 0.0), dim


def test_sharding_tells_long_names_apart(spark):
    rows = [(i, f"text {i}", "en", f"https://www.example.com/{i % 16:02}") for i in range(320)]
    rows += [(1000 + i, "copy", "en", "https://www.example.com/00") for i in range(160)] + [(2000, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    values = df.withColumn("v", sharding.code("source")).groupBy("v").agg(F.count("*").alias("n"))
    q = {r.v: r.q_v for r in sharding.quantised(values, ["v"], "n").collect()}
    names, upto, want = sorted(q), 0, {}
    count = Counter("" if x[3] is None else "v" + x[3] for x in rows)
    ends = [-(-i * len(rows) // 16) for i in range(1, 16)]
    at = []
    for x in names:
        at += [x for e in ends if upto < e <= upto + count[x]]
        upto += count[x]
    want = {x: len([c for c in at if c < x]) for x in names}
    assert q == want and max(q.values()) >= 8
    by = defaultdict(set)
    source = {i: s for i, _, _, s in rows}
    for r in sharding.sharded(df, 8).collect():
        by[r.shard].add(source[r.doc_id])
    assert sum(map(len, by.values())) < 17 * 4


# 9


def test_media(docs, none):
    rows = media.media_columns(docs, keep_media=True).collect()
    want = Counter()
    for i, t in texts(docs):
        b = (t or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    for r in rows:
        (track,) = media.read_container(r.media)
        assert (track.codec, track.handler, track.timescale, track.duration) == ("raw ", "soun", 48000, r.payload_bytes)
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert all(r.media[a:b] == media.read_payload(r.media, track)[576 * k : 576 * (k + 1)] for k, (a, b) in zip(track.keys, track.ranges(track.keys)))
    assert media.media_columns(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 576 * 130 + 7])
def test_media_sizes(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    raw = media.write_container(payload)
    (track,) = media.read_container(raw)
    assert media.read_payload(raw, track) == payload
    with pytest.raises((ValueError, struct.error)):
        media.read_container(raw[:-1])


def fragmented(samples):
    """A file whose movie box has no samples and whose fragments have one run each; every third sample is a sync sample."""
    empty = media.write_container(b"")
    cut = empty.index(b"mdat") - 4
    moov = empty.index(b"moov") - 4
    trex = media.box(b"mvex", media.full_box(b"trex", struct.pack(">IIIII", 1, 1, 0, 5, 0x10000)))
    own = empty[moov + 8 : cut] + trex
    raw = empty[:moov] + media.box(b"moov", own)
    for k in range(0, len(samples), 4):
        part = samples[k : k + 4]
        rows = b"".join(struct.pack(">II", len(x), 0 if (k + i) % 3 == 0 else 0x10000) for i, x in enumerate(part))
        moof = lambda offset: media.box(b"moof", media.full_box(b"mfhd", struct.pack(">I", k)), media.box(b"traf", media.full_box(b"tfhd", struct.pack(">I", 1), flags=0x20000), media.full_box(b"trun", struct.pack(">Ii", len(part), offset), rows, flags=0x601)))  # noqa: B023, E731
        raw += moof(len(moof(0)) + 8) + media.box(b"mdat", *part)
    return raw


def test_media_fragments_and_small_sizes():
    samples = [bytes([k]) * (1 + k % 7) for k in range(23)]
    raw = fragmented(samples)
    (t,) = media.read_container(raw)
    assert media.read_payload(raw, t) == b"".join(samples) and t.keys.tolist() == list(range(0, 23, 3))
    assert [raw[a:b] for a, b in t.ranges(t.keys)] == samples[::3]
    for bits, sizes in ((4, [3, 15, 0, 7, 1]), (8, [200, 0, 9]), (16, [60_000, 2])):
        plain = media.write_container(bytes(sum(sizes)), unit=sum(sizes))
        packed = bytes((a << 4) | b for a, b in zip([*sizes, 0][::2], [*sizes, 0][1::2])) if bits == 4 else np.array(sizes, {8: "u1", 16: ">u2"}[bits]).tobytes()
        stsz, stsc = plain.index(b"stsz") - 4, plain.index(b"stsc") - 4
        body = media.full_box(b"stz2", struct.pack(">II", bits, len(sizes)), packed)
        t = media.Track(tables={})
        data = memoryview(plain[stsc : stsc + 28] + body + media.full_box(b"stco", struct.pack(">II", 1, 8)))
        t.tables = {b"stsc": (8, 28), b"stz2": (36, 0), b"stco": (28 + len(body) + 8, 0)}
        data = memoryview(bytes(data[:20]) + struct.pack(">II", len(sizes), 1) + bytes(data[28:]))
        media.sample_table(data, t)
        assert t.sizes.tolist() == sizes and t.offsets.tolist() == (8 + np.cumsum(sizes) - sizes).tolist(), stsz


def test_media_files_have_a_status(spark):
    good = media.write_container(b"x" * 5000)
    rows = [("good", good), ("cut", good[:-10]), ("text", b"this is no container at all"), ("none", None), ("empty", b""), ("nothing", media.box(b"free", b"1234")), ("tables", good.replace(b"stsz", b"stsX")), ("far", good.replace(b"stco", b"stcX"))]
    got = {r.path: r for r in media.media_files(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert {p: r.status.split(":")[0] for p, r in got.items()} == {"good": "OK", "cut": "BROKEN", "text": "BROKEN", "none": "EMPTY", "empty": "EMPTY", "nothing": "NO_TRACKS", "tables": "BROKEN", "far": "BROKEN"}
    (t,) = got["good"].tracks
    assert (t.codec, t.duration, t.samples) == ("raw", 5000, 9) and [good[k.start : k.end] for k in t.keyframes] == [b"x" * 576]


def test_media_counts_are_held_against_the_file(spark):
    """Tables of a few bytes that claim thousands of millions of samples."""
    most, good = 0xFFFFFFFF, media.write_container(b"x" * 5000)

    def swapped(kind, *numbers):
        at = good.index(kind) + 8
        return good[:at] + struct.pack(f">{len(numbers)}I", *numbers) + good[at + 4 * len(numbers) :]

    run = media.full_box(b"trun", struct.pack(">I", most))
    moof = lambda n: media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", struct.pack(">I", 1)), *[media.full_box(b"trun", struct.pack(">I", 4000))] * n, run * (n == 1)))
    rows = [("stsz", swapped(b"stsz", 1, most)), ("stsz2", swapped(b"stsz", 7, most)), ("stsc", swapped(b"stsc", 1, 1, most, 1)), ("chunk", swapped(b"stsc", 1, most, 1, 1)), ("trun", good + moof(1)), ("truns", good + moof(200)), ("stco", swapped(b"stco", most)), ("stss", swapped(b"stss", most))]
    got = {r.path: r.status for r in media.media_files(spark.createDataFrame([(p, bytearray(c)) for p, c in [*rows, ("good", good)]], "path string, content binary")).collect()}
    assert got.pop("good") == "OK" and {p for p, x in got.items() if x.startswith("BROKEN")} >= set(got) - {"stsc"}, got


# 10


def components(rows, width=5):
    sets = []
    for i, t in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (i, x)), (b, (j, y)) in itertools.combinations(enumerate(sets), 2):
        if i is not None and j is not None and x and 100 * len(x & y) >= 75 * len(x | y):
            root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)].append(i)
    return Counter((i, len(s), min(low[find(k)]) if i is not None else None) for k, (i, s) in enumerate(sets))


def test_ngram_join(docs, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == components(texts(docs))
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("edits,limits", [(3, {}), (8, {}), (8, {"hot": 10}), (3, {"hot": 7, "long_bucket": 20}), (8, {"long_bucket": 9})])
def test_ngram_join_large_group(spark, edits, limits):
    r = random.Random(edits)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits).collect())
    assert got == components(rows)


def test_ngram_join_shared_passage(spark):
    """Thousands of documents that share a passage of most of their words and aren't alike, with some near copies among them."""
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(i, f"{passage} " + " ".join(f"{i}x{k}" for k in range(60 + i % 9))) for i in range(5000)]
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(0, 5000, 500)]
    for limits in ({}, {"hot": 500, "long_bucket": 300}):
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **limits).collect()}
        assert got == {i: i if i < 10_000 else i - 10_000 for i, _ in rows}


def test_buckets_in_any_batches():
    """Candidate pairs and large buckets of a sorted partition don't depend on how it is cut into batches, but for pivots of long buckets."""
    r = np.random.default_rng(4)
    token = np.sort(r.integers(0, 40, 3000))
    rows = np.c_[token, r.integers(20, 30, 3000), r.integers(0, 3, 3000), r.integers(0, 500, 3000), token]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]

    def out(size, long_bucket):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[i : i + size, c])) for c in range(5)], names=["bucket", "n", "place", "cls", "token"]) for i in range(0, len(rows), size)]
        return {tuple(x.values()) for b in ngram_join.bucket_pairs(75, long_bucket)(iter(batches)) for x in b.to_pylist()}

    whole = out(3000, 10**6)
    assert out(100, 10**6) == whole
    kept = lambda x: {t for t in x if t[0] == 1}
    assert kept(out(70, 30)) == kept(whole)  # rows that the second round joins are all there


@pytest.mark.parametrize("kind", ["smallint", "int", "string"])
def test_ids_of_any_type(spark, kind):
    text = "\n".join(["a shared line", "one two three four five six seven"])
    df = spark.createDataFrame([(i, text) for i in range(12)] + [(None, text)] * 2, "doc_id long, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    low = {"string": "0"}.get(kind, 0)
    assert {r.component_id for r in ngram_join.jaccard_components(df).collect()} == {low, None}
    bitmaps = line_dedup.keep_bitmaps(df).collect()
    assert len(bitmaps) == 13 and len(line_dedup.keep_bitmaps(df, at_least=14).collect()) == 0  # rows without id are one document by their text
    first = {r.doc_id for r in line_dedup.keep_bitmaps(df.where("doc_id IS NOT NULL"), keep_first=True).collect()}
    assert len(first) == 11 and {"string": "=0"}.get(kind, 0) not in first


def test_fragments_follow_the_order():
    r = np.random.default_rng(1)
    cells = r.poisson(3, 1 << 12).astype(np.uint32)
    cells[r.integers(0, 1 << 12, 40)] += 5000
    order = ngram_join.Order(cells)
    tokens = np.sort(r.integers(0, 2**64 - 1, 4000, dtype=np.uint64))
    laid = ngram_join.ordered(tokens, np.array([len(tokens)]), order.rare)
    frag = order.fragment(laid, 8)
    assert (np.diff(frag) >= 0).all() and set(frag.tolist()) >= {0, 1}


def test_ngram_join_counts_links(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base[: 60 + i % 30] + [f"x{i}"])) for i in range(60)] + [(60 + i, f"y{i} y y y y y{i}") for i in range(5)] + [(65, rows_) for rows_ in [" ".join(base[:60] + ["x0"])]]
    r.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    classes = {frozenset(x) for x in sets.values()}
    want = {i: sum(100 * len(x & y) >= 75 * len(x | y) for y in classes) - 1 for i, x in sets.items()}
    got = {x.doc_id: x.n_links for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), count_links=True).collect()}
    assert got == want and max(want.values()) > 20


def test_size_bands(spark):
    """No two sizes that may link are more than a band apart."""
    n = [r.b for r in spark.range(1, 3000).select(ngram_join.size_band(F.col("id"), 75).alias("b")).collect()]
    assert all(n[min(4 * k // 3, 2999) - 1] - n[k - 1] in (0, 1) for k in range(1, 3000))


def test_parity_bits_bound():
    r = np.random.default_rng(3)
    for _ in range(60):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 900), dtype=np.uint64))
        y = np.unique(np.r_[x[: r.integers(0, len(x) + 1)], r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64)])
        a, b = ngram_join.parity_bits(np.r_[x, y], np.array([len(x), len(y)]))
        assert ngram_join.differing(a, b) <= len(np.setxor1d(x, y))


# the pipeline


def test_stages(spark, docs, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for (name, stage), empty in itertools.product(corpus_pipeline.STAGES[:4], (False, True)):
        out = stage(spark, none if empty else docs, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert out.count() == 0 if empty else out.count() > 0
    rows = quality.stage(spark, docs, SF).collect()
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality.quality_rules(docs).collect()}
    assert Counter((r.doc_id, r.text, r.n) for r in rows) == Counter((r.doc_id, r.text, r.n) for r in docs.collect() if verdict[(r.doc_id, len(words(r.text)))])
    left = ngram_join.stage(spark, docs, SF).collect()
    best = {(i, n): c for (i, n, c) in components(texts(docs))}
    assert {r.doc_id for r in left if r.doc_id is not None} == {i for (i, n), c in best.items() if i is not None and i == c}
    mixed = Counter((r.doc_id, r.text) for r in mixing.stage(spark, docs, SF).collect())
    times = {(r.doc_id, r.size): r.times for r in mixing.mixed(docs).collect()}
    have = Counter((r.doc_id, r.text) for r in docs.collect())
    assert mixed == Counter({k: n * times[(k[0], len(words(k[1])))] for k, n in have.items() if times[(k[0], len(words(k[1])))]})


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    # the same stages by hand, the last by brute force
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.checkpointed(stage(spark, docs, "/root/testdata/sf0.001"))
    encode, want = packing.encoder(packing.default_tokenizer()), Counter()
    for i, t in texts(docs):
        ids = [*encode(t or "").tolist(), packing.END]
        for a in range(0, len(ids), packing.LENGTH):
            own = ids[a : a + packing.LENGTH]
            want[i, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    taken = defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= packing.LENGTH and [o for o, _ in sorted(x)] == list(itertools.accumulate((n for _, n in sorted(x)[:-1]), initial=0)) for x in taken.values())


def test_pipeline_without_rows(spark, tmp_path, none):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert len(registry.QUERIES) == 10 and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


